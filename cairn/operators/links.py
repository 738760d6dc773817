"""Canonical paths from a table of symbolic links.

``links`` has the links of a file system (path, target), as they are found in
their real directories. A path is followed link by link from its start, as a
kernel does: ``..`` leaves the directory that a link leads to, and more than
``LIMIT`` links followed in one path are an error (so are cycles).

The links are closed over themselves first: each round replaces a target's
leading link by what that link has come to, so that what a pointer spans
doubles, and chains of n links take log2(n) rounds. Paths then take one round
for each link that stands in them, not for each that is followed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.sources.store import stage

#: Fixed value: links that one path may follow.
LIMIT = 40


def segments(path: Column) -> Column:
    """Names of a path; ``.`` and empty ones are none."""
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def without_ups(names: Column, checked: Column) -> Column:
    """Names after ``..`` are taken that follow one of the first ``checked`` names, which are known to be no links; at the root they go."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("plain"))
    step = lambda a, x: F.when(
        a["plain"] & (x["name"] == ".."), F.struct(F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))).alias("out"), F.lit(True).alias("plain"))
    ).otherwise(F.struct(F.concat(a["out"], F.array(x["name"])).alias("out"), (a["plain"] & (x["at"] < checked)).alias("plain")))
    placed = F.transform(names, lambda x, i: F.struct(x.alias("name"), i.alias("at")))
    return F.aggregate(placed, start, step)["out"]


def joined(names: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(names, "/"))


def targets(links: DataFrame) -> DataFrame:
    """(link, names): where each link leads, from the root; ``..`` at the start leave the link's own, real directory."""
    own = segments(F.col("path"))
    parent = F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))
    names = F.when(F.col("target").startswith("/"), segments(F.col("target"))).otherwise(F.concat(parent, segments(F.col("target"))))
    checked = F.when(F.col("target").startswith("/"), 0).otherwise(F.size(parent))
    rows = links.filter("target <> ''").select(joined(own).alias("link"), without_ups(names, checked).alias("names"))
    return rows.groupBy("link").agg(F.min("names").alias("names"))


def leading(rows: DataFrame, to: DataFrame) -> DataFrame:
    """``rows`` (id, names) with their shortest prefix, of those before any ``..``, that is a link of ``to``: at, to_names, to_followed; null if none is."""
    up = F.array_position("names", "..")
    known = F.when(up > 0, up.cast("int") - 1).otherwise(F.size("names"))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(known, F.lit(1))), lambda i: joined(F.slice("names", F.lit(1), i)))
    tried = rows.filter(known > 0).select("id", F.posexplode(prefixes).alias("pos", "link"))
    found = tried.join(to, "link").groupBy("id").agg(F.min_by(F.struct((F.col("pos") + 1).alias("at"), "to_names", "to_followed"), "pos").alias("m"))
    return rows.join(found.select("id", "m.*"), "id", "left")


def stepped(rows: DataFrame, to: DataFrame) -> DataFrame:
    """One round over ``rows`` (id, names, followed): a leading link is replaced, else a ``..`` behind real directories is taken."""
    has = F.col("at").isNotNull()
    rest = F.slice("names", F.col("at") + 1, F.size("names"))
    up = F.array_position("names", "..").cast("int")
    names = F.when(has, F.concat("to_names", rest)).when(up > 0, without_ups(F.col("names"), up)).otherwise(F.col("names"))
    followed = F.col("followed") + F.when(has, F.col("to_followed") + 1).otherwise(0)
    return leading(rows, to).select("id", names.alias("names"), followed.alias("followed"), (has | (up > 0)).alias("open"))


def pointers(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("link"), F.col("names").alias("to_names"), F.col("followed").alias("to_followed"))


def followed_to_end(rows: DataFrame, to: DataFrame | None, limit: int) -> DataFrame:
    """``rows`` (id, names, followed) after as many rounds as any needs; each is over the limit, closed or found to lead on in a round.

    Without ``to`` the rows are links that are followed through each other.
    """
    rows = rows.withColumn("open", F.lit(True))
    done = None
    while True:
        if to is None:
            # All links stay, as others lead through them; what is over the limit does so in any case.
            rest = rows.filter(F.col("open") & (F.col("followed") <= limit))
            closed = rows.filter(~(F.col("open") & (F.col("followed") <= limit)))
            rows = stage(stepped(rest.drop("open"), pointers(rows)).unionByName(closed.withColumn("open", F.lit(False))))
            if rows.filter(F.col("open") & (F.col("followed") <= limit)).isEmpty():
                return rows.drop("open")
            continue
        rows = stage(stepped(rows.drop("open"), to))
        ended = rows.filter(~F.col("open") | (F.col("followed") > limit)).drop("open")
        done = ended if done is None else done.unionByName(ended)
        rows = rows.filter(F.col("open") & (F.col("followed") <= limit))
        if rows.isEmpty():
            return done


def canonical(paths: DataFrame, links: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``paths`` (path, absolute) with canonical, followed and error.

    ``canonical`` is null and ``error`` says why where more than ``limit``
    links are followed; ``followed`` is then null, as a cycle has no number.
    Repeated paths are repeated; a null path has no canonical one.
    """
    closed = followed_to_end(stage(targets(links).select(F.col("link").alias("id"), "names", F.lit(0).alias("followed"))), None, limit)
    ends = stage(pointers(closed))
    distinct = paths.select("path").filter("path is not null").distinct().select(F.col("path").alias("id"), segments(F.col("path")).alias("names"), F.lit(0).alias("followed"))
    done = followed_to_end(distinct, ends, limit)
    fine = F.col("followed") <= limit
    row = done.select(F.col("id").alias("path"), F.when(fine, joined(F.col("names"))).alias("canonical"), F.when(fine, F.col("followed")).cast("long").alias("followed"), F.when(~fine, F.lit("too many links")).alias("error"))
    return paths.join(row, "path", "left")
