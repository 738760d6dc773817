"""Package database and operating system files as tables.

``files`` have file_name, content and pos (the order in which they are read);
of equal keys the last read stays.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unix_lines(content: Column | str) -> Column:
    """A text whose lines end in a line feed alone."""
    return F.regexp_replace(content, "\r\n", "\n")


def status_stanzas(files: DataFrame) -> DataFrame:
    """(pos, nth, pkg_key, version, src_name) of each stanza with a package and a version."""
    rows = files.select("pos", F.posexplode(F.split(unix_lines("content"), r"\n(?:\n)+")).alias("nth", "stanza")).withColumn("stanza", F.concat(F.lit("\n"), F.col("stanza")))
    package, arch, version = (F.regexp_extract("stanza", rf"(?s)^.*\n{name}: ([^\n]*)", 1) for name in ("Package", "Architecture", "Version"))
    source = F.regexp_extract("stanza", r"(?s)^.*\nSource: [ \t]*([^\s]*)", 1)
    key = F.when(arch.isin("", "all"), package).otherwise(F.concat(package, F.lit(":"), arch))
    kept = rows.filter((package != "") & (version != ""))
    return kept.select("pos", "nth", key.alias("pkg_key"), version.alias("version"), F.when((source != "") & (source != package), source).alias("src_name"))


def package_meta(files: DataFrame) -> DataFrame:
    """(pkg_key, version, src_name): the last version, and the last source that was named."""
    at = F.struct("pos", "nth")
    named = F.max_by("src_name", F.when(F.col("src_name").isNotNull(), at))
    return status_stanzas(files).groupBy("pkg_key").agg(F.max_by("version", at).alias("version"), named.alias("src_name"))


def package_files(files: DataFrame) -> DataFrame:
    """(path, pkg_key) of ``*.list`` files: absolute paths but ``/.``; the package is the file's stem."""
    stem = F.regexp_replace("file_name", r"\.list\z", "")
    rows = files.filter(F.col("file_name").rlike(r".\.list\z")).select("pos", stem.alias("pkg_key"), F.posexplode(F.split(unix_lines("content"), "\n")).alias("nth", "path"))
    rows = rows.filter(F.col("path").startswith("/") & (F.col("path") != "/."))
    return rows.groupBy("path").agg(F.max_by("pkg_key", F.struct("pos", "nth")).alias("pkg_key"))


def os_release(files: DataFrame, *by: str) -> DataFrame:
    """(key, value) of ``key=value`` lines without the quotes around values; the last of a key stays. With ``by``, of each of those apart."""
    rows = files.select(*by, "pos", F.posexplode(F.split(unix_lines("content"), "\n")).alias("nth", "line")).filter(F.contains("line", F.lit("=")))
    value = F.btrim(F.regexp_extract("line", r"(?s)^[^=]*=(.*)\z", 1), F.lit('"'))
    rows = rows.select(*by, "pos", "nth", F.substring_index("line", "=", 1).alias("key"), value.alias("value"))
    return rows.groupBy(*by, "key").agg(F.max_by("value", F.struct("pos", "nth")).alias("value"))


def distro(release: DataFrame, *by: str) -> DataFrame:
    """One row: ``ID-VERSION_ID``, the ID alone, or ``linux``. With ``by``, one for each of those."""
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    row = release.groupBy(*by).agg(F.coalesce(of("ID"), F.lit("linux")).alias("id"), F.coalesce(of("VERSION_ID"), F.lit("")).alias("version"))
    return row.select(*by, F.when(F.col("version") == "", F.col("id")).otherwise(F.concat_ws("-", "id", "version")).alias("distro"))


#: Fields of an event record: bytes 1-4 pid, 5-8 name length, 9 kind, 13-268 name; numbers are little-endian.
RECORD, NAME = 268, 256
OPEN, FORK = 0, 1


def number(column: str, at: int, size: int) -> Column:
    """An unsigned little-endian number of ``size`` bytes."""
    digits = F.concat(*[F.substring(F.hex(column), 2 * (at + k) - 1, 2) for k in range(size - 1, -1, -1)])
    return F.conv(digits, 16, 10).cast("long")


def events(records: DataFrame) -> DataFrame:
    """(seq, pid, is_fork, raw_path) of ``records`` (seq, record); short records are left out.

    The name ends at its length, its last NULs go, and what isn't UTF-8 is
    replaced. Kinds other than a fork are opens; an open may have no path.
    """
    whole = records.filter(F.length("record") >= RECORD)
    size = F.least(number("record", 5, 4), F.lit(NAME)).cast("int")
    name = F.expr("make_valid_utf8(cast(substring(record, 13, size) as string))")
    rows = whole.select("seq", "record", size.alias("size"), number("record", 1, 4).alias("pid"), (number("record", 9, 1) == FORK).alias("is_fork"))
    return rows.select("seq", "pid", "is_fork", F.when(~F.col("is_fork"), F.regexp_replace(name, "\\x00+\\z", "")).alias("raw_path"))


def opens(decoded: DataFrame) -> DataFrame:
    """Opens with a path."""
    return decoded.filter("NOT is_fork AND raw_path <> ''").select("seq", "pid", "raw_path")


def parent_of(status: DataFrame) -> DataFrame:
    """(pid, ppid) from process status texts; null where no line names the parent."""
    found = F.regexp_extract("status", r"(?m)^PPid:\s*(\d+)", 1)
    return status.select("pid", F.when(found != "", found.cast("long")).alias("ppid"))


def process_names(facts: DataFrame) -> DataFrame:
    """(pid, comm): the last name recorded of each process, trimmed; empty where it couldn't be read (``content`` is null then).

    ``facts`` have pid, kind (``comm`` or ``cwd``), content and seq.
    """
    name = F.coalesce(F.btrim("content", F.lit(" \t\n\x0b\f\r")), F.lit(""))
    return facts.filter("kind = 'comm'").groupBy("pid").agg(F.max_by(name, "seq").alias("comm"))


def process_directories(facts: DataFrame) -> DataFrame:
    """(pid, cwd): the last directory of each process that could be read; processes without one have no row."""
    return facts.filter("kind = 'cwd' and content is not null").groupBy("pid").agg(F.max_by("content", "seq").alias("cwd"))
