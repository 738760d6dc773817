"""Wrap files of vendored subprojects as an index of their directories.

``wraps`` have wrap_path (relative to the subproject folder), content and pos.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import paths, versions

#: Fixed keys of a wrap file.
KEYS = ("directory", "url", "revision", "source_url", "source_filename")


def parsed(wraps: DataFrame) -> DataFrame:
    """(wrap_path, pos, redirect and the fixed keys): last of equal keys; in a redirect section only its file name counts."""
    rows = wraps.select("wrap_path", "pos", F.posexplode(F.split("content", "\n")).alias("nth", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r")))
    rows = rows.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    in_file = Window.partitionBy("wrap_path", "pos").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.last(F.when(F.col("line").startswith("["), F.col("line")), ignorenulls=True).over(in_file)
    rows = rows.withColumn("redirects", F.coalesce(section == "[wrap-redirect]", F.lit(False)))
    key, value = F.btrim(F.substring_index("line", "=", 1)), F.btrim(F.regexp_extract("line", "(?s)^[^=]*=(.*)$", 1))
    rows = rows.withColumn("key", F.when(F.contains("line", F.lit("=")) & ~F.col("line").startswith("["), key)).withColumn("value", value)
    of = lambda name, redirects: F.max_by("value", F.when((F.col("key") == name) & (F.col("redirects") == redirects), F.col("nth")))
    found = rows.groupBy("wrap_path", "pos").agg(of("filename", True).alias("redirect"), *[of(k, False).alias(k) for k in KEYS])
    return wraps.select("wrap_path", "pos").join(found, ["wrap_path", "pos"], "left")


def place(path: Column) -> Column:
    """A path below the subproject folder without ``.`` and ``..``."""
    return paths.normalized(path, F.lit(""))


def resolved(wraps: DataFrame) -> DataFrame:
    """Each top-level wrap with its fields, those of the redirect's target where it has one; without that target it goes.

    Targets are paths: ``./a/../b.wrap`` is ``b.wrap``.
    """
    every = parsed(wraps)
    top = every.filter(F.col("wrap_path").rlike(r"^[^/]+\.wrap\z"))
    fields = [F.col(k).alias(f"to_{k}") for k in KEYS]
    target = every.select(place(F.col("wrap_path")).alias("target"), *fields)
    joined = top.join(target, place(top.redirect) == target.target, "left").filter("redirect is null or target is not null")
    name = F.regexp_replace("wrap_path", r"\.wrap\z", "")
    return joined.select(name.alias("wrap_name"), "pos", *[F.when(F.col("redirect").isNull(), F.col(k)).otherwise(F.col(f"to_{k}")).alias(k) for k in KEYS])


def commit(heads: DataFrame) -> DataFrame:
    """(dirname, commit): twelve digits of a checked-out hash, from the head itself or from the ref it names.

    ``heads`` have dirname, name (HEAD, or a ref's path) and content.
    """
    rows = heads.withColumn("content", F.btrim("content", F.lit(" \t\r\n")))
    head = rows.filter("name = 'HEAD'").select("dirname", F.col("content").alias("head"), F.when(F.col("content").startswith("ref: "), F.btrim(F.substring("content", 6, 1 << 30))).alias("name"))
    ref = rows.select("dirname", "name", F.col("content").alias("ref"))
    both = head.join(ref, ["dirname", "name"], "left")
    of = lambda c: F.when(versions.is_hex_hash(F.col(c)), F.substring(c, 1, 12))
    return both.select("dirname", F.coalesce(of("head"), of("ref")).alias("commit")).filter("commit is not null")


def index(wraps: DataFrame, heads: DataFrame) -> DataFrame:
    """(dirname, name, version, url) of the wraps; of one directory the last wrap stays."""
    rows = resolved(wraps).withColumn("dirname", F.coalesce("directory", "wrap_name"))
    rows = rows.join(commit(heads), "dirname", "left")
    version = F.coalesce(versions.from_revision(F.col("revision")), versions.from_archive(F.col("source_filename")), versions.from_dirname(F.col("dirname")), F.col("commit"))
    last = F.max_by(F.struct(F.col("wrap_name").alias("name"), version.alias("version"), F.coalesce("url", "source_url").alias("url")), F.struct("pos", "wrap_name")).alias("v")
    return rows.groupBy("dirname").agg(last).select("dirname", "v.*")
