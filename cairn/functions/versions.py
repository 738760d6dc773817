"""Versions and package URLs as columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def looks_like_version(x: Column) -> Column:
    return x.rlike(r"^[0-9][0-9.+-]*\z")


def from_revision(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"^v*([0-9][0-9.+-]*)\z", 1), F.lit(""))


def from_dirname(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"^.*-([0-9][0-9.+]*)\z", 1), F.lit(""))


def from_archive(x: Column) -> Column:
    return from_dirname(F.regexp_replace(x, r"\.(tar\.gz|tar\.xz|tar\.bz2|tar\.zst|zip)\z", ""))


def dirname_base(x: Column) -> Column:
    return F.regexp_replace(x, r"-[0-9][0-9.+]*\z", "")


def encoded(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("+"), F.lit("%2B")), F.lit(":"), F.lit("%3A"))


def purl(kind: str, name: Column, version: Column) -> Column:
    """Package URL of a lock-file package: ``kind`` is cargo, npm, pypi or golang."""
    plus = F.replace(version, F.lit("+"), F.lit("%2B"))
    if kind == "npm":
        name, plus = F.regexp_replace(name, "^@", "%40"), encoded(version)
    elif kind == "pypi":
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        name = F.translate(name, "_." + upper, "--" + upper.lower())
    elif kind == "cargo":
        plus = encoded(version)
    return F.concat(F.lit(f"pkg:{kind}/"), name, F.lit("@"), plus)


def yarn_name(spec: Column) -> Column:
    return F.nullif(F.regexp_extract(spec, "^(@?[^@]*)@", 1), F.lit(""))


def purl_type(distro: Column) -> Column:
    """Package type of a distribution, by prefix."""
    kinds = {"deb": ("ubuntu", "debian"), "rpm": ("fedora", "rhel", "centos", "rocky", "almalinux"), "alpm": ("arch", "manjaro")}
    out = F.lit("generic")
    for kind, names in kinds.items():
        for n in names:
            out = F.when(distro.startswith(n), F.lit(kind)).otherwise(out)
    return out


def system_purl(name: Column, version: Column, arch: Column, source: Column, distro: Column) -> Column:
    query = F.concat_ws("&", F.concat(F.lit("arch="), arch), F.concat(F.lit("distro="), distro), F.concat(F.lit("upstream="), source))
    space = F.substring_index(distro, "-", 1)
    return F.when(version != "unknown", F.concat(F.lit("pkg:"), purl_type(distro), F.lit("/"), space, F.lit("/"), name, F.lit("@"), encoded(version), F.lit("?"), query))


def local_purl(name: Column, version_or_hash: Column) -> Column:
    return F.concat(F.lit("pkg:generic/"), name, F.lit("@"), encoded(version_or_hash))


def is_hex_hash(x: Column) -> Column:
    return x.rlike(r"^[0-9a-fA-F]{40,}\z")
