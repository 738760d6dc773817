"""Path predicates and scalars as columns; all bytewise and case-sensitive."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
RELEVANT = ("so", "a", "h", "hpp", "hxx", "c")
SYSTEM = ("/usr/lib", "/usr/include", "/lib/", "/lib64/")
NOISE = ("/proc/", "/sys/", "/dev/", "/run/", "/tmp/", "pipe:", "socket:", "anon_inode:")
HEADERS = ("h", "hpp", "hxx", "hh", "H", "inl", "tcc")
ORCHESTRATORS = (
    "cmake", "ccmake", "cmake3", "ctest", "cpack", "make", "gmake", "mingw32-make", "ninja", "samu", "meson", "autoconf",
    "automake", "configure", "pkg-config", "pkgconf", "sh", "bash", "dash", "zsh", "fish", "python3", "python", "perl",
)


def starts_with_any(path: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def file_name(path: Column) -> Column:
    """Last segment, less trailing slashes and ``/.``; empty for ``..``."""
    name = F.regexp_extract(path, r"([^/]*?)(?:/+\.?)*\z", 1)
    return F.when(name.isin("..", "."), F.lit("")).otherwise(name)


def extension(path: Column) -> Column:
    """What follows the last dot of the name; empty for dot-files and plain names."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)\z", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*\z", "")


def is_relevant(raw: Column) -> Column:
    """No noise, and the last segment holds ``.so`` or has a listed extension; one pattern, so that it is looked at once."""
    last = rf"(^|/)([^/]*\.so[^/]*|[^/]+\.({'|'.join(RELEVANT)}))(/+\.?)*\z"
    return (raw != "") & ~starts_with_any(raw, NOISE) & raw.rlike(last)


def is_system(path: Column) -> Column:
    return starts_with_any(path, SYSTEM)


def is_orchestrator(comm: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(comm, r"[0-9.]+\z", ""), r"-+\z", "")
    return comm.isin(*ORCHESTRATORS) | base.isin(*ORCHESTRATORS)


def in_subproject(path: Column) -> Column:
    return path.rlike(r"(^|/)subprojects/[^/]+")


def is_dropped_header(path: Column) -> Column:
    return ~is_system(path) & extension(path).isin(*HEADERS) & ~in_subproject(path)


def normalized(raw: Column, cwd: Column) -> Column:
    """Lexical path: relative to ``cwd``, ``.`` dropped, ``..`` pops, the root too."""
    full = F.when(raw.startswith("/"), raw).otherwise(F.concat(cwd, F.lit("/"), raw))
    root = F.when(full.startswith("/"), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.split(full, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(
        parts,
        root,
        lambda stack, x: F.when(x == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(x))),
    )
    return F.regexp_replace(F.array_join(kept, "/"), "^/+", "/")


def soname_base(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(name, ".so", 1), "^lib", "")


def soname_name(name: Column) -> Column:
    """Library name of a ``.so`` file name, null if there is none."""
    return F.when(name.contains(".so") & (soname_base(name) != ""), soname_base(name))


def soname_version(name: Column) -> Column:
    version = F.regexp_extract(name, r"^.*?\.so\.([0-9].*)\z", 1)
    return F.when(soname_name(name).isNotNull() & (version != ""), version)


def local_name(path: Column) -> Column:
    return F.coalesce(soname_name(file_name(path)), F.regexp_replace(stem(path), "^lib", ""))
