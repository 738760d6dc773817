"""Owners of paths from the captured answers of package managers.

``answers`` have manager, path, ok and stdout (what ``dpkg -S``, ``pacman -Qo``
or ``rpm -qf`` said of a path); ``versions`` have pkg_key, ok and stdout (what
``dpkg-query -W`` said). Commands are never run here. Every parser gives
(path, name, version, arch, src_name) of the paths that were answered; of
repeated answers for a path the least stays.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order in which managers are looked for.
MANAGERS = ("dpkg", "pacman", "rpm")
SPACE = r"[ \t\n\x0b\f\r]+"
COLUMNS = ("name", "version", "arch", "src_name")


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def answered(answers: DataFrame, manager: str) -> DataFrame:
    return answers.filter((F.col("manager") == manager) & F.coalesce("ok", F.lit(False))).select("path", F.coalesce("stdout", F.lit("")).alias("stdout"))


def one_a_path(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.min(F.struct(*COLUMNS)).alias("v")).select("path", "v.*")


def dpkg(answers: DataFrame, versions: DataFrame) -> DataFrame:
    """The first line that is no diversion names the package, with its architecture; a version that wasn't told is ``unknown``."""
    lines = F.filter(F.split(F.regexp_replace(F.regexp_replace("stdout", "\n\\z", ""), "\r\n", "\n"), "\n"), lambda x: ~F.ltrim(x, F.lit(" \t\x0b\f\r")).startswith("diversion"))
    none = F.col("stdout") == ""
    key = trimmed(F.substring_index(F.get(lines, 0), ": ", 1))
    found = answered(answers, "dpkg").filter(~none).select("path", key.alias("pkg_key")).filter("pkg_key is not null")
    told = versions.filter("ok").groupBy("pkg_key").agg(F.min(trimmed(F.coalesce("stdout", F.lit("")))).alias("version"))
    rows = found.join(told, "pkg_key", "left")
    arch = F.when(F.col("pkg_key").contains(":"), F.regexp_extract("pkg_key", "(?s)^[^:]*:(.*)", 1))
    return one_a_path(rows.select("path", F.substring_index("pkg_key", ":", 1).alias("name"), F.coalesce("version", F.lit("unknown")).alias("version"), arch.alias("arch"), F.lit(None).cast("string").alias("src_name")))


def pacman(answers: DataFrame) -> DataFrame:
    """The second and third word after ``owned``; an answer without them is none."""
    words = F.split(trimmed(F.col("stdout")), SPACE)
    at = F.array_position(words, "owned").cast("int")
    rows = answered(answers, "pacman").select("path", at.alias("at"), words.alias("words")).filter("at > 0 and size(words) >= at + 3")
    none = F.lit(None).cast("string")
    return one_a_path(rows.select("path", F.get("words", F.col("at") + 1).alias("name"), F.get("words", F.col("at") + 2).alias("version"), none.alias("arch"), none.alias("src_name")))


def rpm(answers: DataFrame) -> DataFrame:
    """Name and version, parted by the first space; without one the version is ``unknown``."""
    said = trimmed(F.col("stdout"))
    none = F.lit(None).cast("string")
    version = F.when(said.contains(" "), F.regexp_extract(said, r"(?s)^[^ ]* (.*)\z", 1)).otherwise("unknown")
    return one_a_path(answered(answers, "rpm").select("path", F.substring_index(said, " ", 1).alias("name"), version.alias("version"), none.alias("arch"), none.alias("src_name")))


def detected(which: DataFrame, *by: str) -> DataFrame:
    """One row: the first manager that was found (``which``: manager, ok), or ``none``. With ``by``, one for each of those."""
    rank = F.array_position(F.array(*map(F.lit, MANAGERS)), F.col("manager"))
    best = F.min_by("manager", F.when(F.coalesce("ok", F.lit(False)) & (rank > 0), rank))
    return which.groupBy(*by).agg(F.coalesce(best, F.lit("none")).alias("manager"))


def owners(answers: DataFrame, versions: DataFrame) -> DataFrame:
    """(path, manager, name, version, arch, src_name): of each path the first manager, in the fixed order, that has an answer.

    One aggregate over all answers; a manager that said nothing usable is
    passed over.
    """
    parts = [dpkg(answers, versions), pacman(answers), rpm(answers)]
    rows = None
    for rank, (manager, part) in enumerate(zip(MANAGERS, parts)):
        part = part.select("path", F.struct(F.lit(rank).alias("rank"), F.lit(manager).alias("manager"), *COLUMNS).alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("path").agg(F.min("v").alias("v")).select("path", "v.manager", *[f"v.{c}" for c in COLUMNS])
