"""From open events to deduplicated components.

One shuffle makes paths distinct before any look-up, look-ups are left joins
that the optimiser broadcasts while they are small, and one shuffle on the
component key keeps the first by (type, path) with an aggregate, not a sort.
"""

from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths, versions
from cairn.sources.store import stage

#: Component types in their fixed order.
ECOSYSTEM, LOCAL, SYSTEM, UNKNOWN = "ecosystem_package", "local_file", "system_package", "system_unknown"
COLUMNS = ("name", "version", "arch", "src_name", "hash", "purl", "vcs_url", "path", "type")


def with_process(opens: DataFrame, process: DataFrame, project: str) -> DataFrame:
    """Opens with the opener's comm (default empty) and cwd (default the project)."""
    found = opens.join(process.select("pid", "comm", "cwd"), "pid", "left")
    return found.withColumn("comm", F.coalesce("comm", F.lit(""))).withColumn("cwd", F.coalesce("cwd", F.lit(project)))


def relevant_paths(opens: DataFrame, process: DataFrame, project: str, orchestrators: bool = False) -> DataFrame:
    """Distinct normalised paths of relevant opens, those of build tools left out."""
    rows = with_process(opens.filter(paths.is_relevant(F.col("raw_path"))), process, project)
    if not orchestrators:
        rows = rows.filter(~paths.is_orchestrator(F.col("comm")))
    return rows.select(paths.normalized(F.col("raw_path"), F.col("cwd")).alias("path")).distinct()


def content_hash(content: F.Column) -> F.Column:
    """Hash of a file's content; null where it can't be read."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def existing(found: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that are in ``files`` (path, canonical, content), with canonical path and content hash."""
    return found.join(files, "path").select("path", "canonical", content_hash(F.col("content")).alias("hash"))


def arch_of(pkg_key: F.Column) -> F.Column:
    """What follows the first colon of a package key."""
    return F.when(pkg_key.contains(":"), F.regexp_extract(pkg_key, "^[^:]*:(.*)", 1))


def last_wins(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """One row a key: the values with the greatest pos."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "pos").alias("v")).select(key, *[F.col(f"v.{v}").alias(v) for v in values])


def with_package(files: DataFrame, pkg_file: DataFrame, pkg_meta: DataFrame) -> DataFrame:
    """Paths with pkg_key (by path, else by canonical path), version and source of the package."""
    owners = last_wins(pkg_file, "path", "pkg_key")
    meta = last_wins(pkg_meta, "pkg_key", "version", "src_name")
    again = owners.select(F.col("path").alias("canonical"), F.col("pkg_key").alias("pkg_key_again"))
    found = files.join(owners, "path", "left").join(again, "canonical", "left")
    found = found.withColumn("pkg_key", F.coalesce("pkg_key", "pkg_key_again")).drop("pkg_key_again")
    return found.join(meta, "pkg_key", "left").withColumn("version", F.when(F.col("pkg_key").isNotNull(), F.coalesce("version", F.lit("unknown"))))


def subproject_dirs(path) -> F.Column:
    """Names that follow a ``subprojects`` segment, in order; such a name may itself be ``subprojects``."""
    return F.regexp_extract_all(path, F.lit(r"(?<![^/])subprojects/(?=([^/]+))"), F.lit(1))


def with_subproject(files: DataFrame, subproject: DataFrame) -> DataFrame:
    """Paths with sub_name, sub_version and sub_url: the first indexed directory, else the first one's own name.

    ``files`` is read once: its candidate directories are looked up in place
    and folded again by path.
    """
    dirs = subproject_dirs(F.col("path"))
    entry = subproject.select("dirname", F.struct("name", "version", "url").alias("entry"))
    tried = files.select("*", F.get(dirs, 0).alias("_first"), F.posexplode_outer(dirs).alias("_pos", "dirname")).join(entry, "dirname", "left")
    rest = [F.first(c).alias(c) for c in files.columns if c != "path"]
    rows = tried.groupBy("path").agg(*rest, F.first("_first").alias("_first"), F.min_by("entry", F.when(F.col("entry").isNotNull(), F.col("_pos"))).alias("sub"))
    known = F.col("sub").isNotNull()
    return rows.select(
        *files.columns,
        F.when(known, F.col("sub.name")).otherwise(versions.dirname_base(F.col("_first"))).alias("sub_name"),
        F.when(known, F.col("sub.version")).otherwise(versions.from_dirname(F.col("_first"))).alias("sub_version"),
        F.col("sub.url").alias("sub_url"),
    )


def components(files: DataFrame, pkg_file: DataFrame, pkg_meta: DataFrame, subproject: DataFrame) -> DataFrame:
    """A component for each existing path (path, canonical, hash), headers of the project itself left out."""
    kept = files.filter(~paths.is_dropped_header(F.col("path")))
    rows = with_subproject(with_package(kept, pkg_file, pkg_meta), subproject)
    path, name = F.col("path"), paths.file_name(F.col("canonical"))
    kind = F.when(paths.is_system(path) & F.col("pkg_key").isNotNull(), SYSTEM).when(paths.is_system(path), UNKNOWN).otherwise(LOCAL)
    rows = rows.withColumn("type", kind)
    package, local = F.col("type") == SYSTEM, F.col("type") == LOCAL
    own = F.coalesce("sub_name", paths.soname_name(name), F.regexp_replace(paths.stem(path), "^lib", ""))
    version = F.when(F.col("sub_name").isNotNull(), F.col("sub_version")).otherwise(paths.soname_version(name))
    arch = arch_of(F.col("pkg_key"))
    return rows.select(
        F.when(package, F.substring_index("pkg_key", ":", 1)).when(local, own).otherwise(paths.file_name(path)).alias("name"),
        F.when(package, F.col("version")).when(local, version).alias("version"),
        F.when(package, arch).alias("arch"),
        F.when(package, F.col("src_name")).alias("src_name"),
        F.when(local, F.coalesce("hash", F.lit("sha256:error"))).alias("hash"),
        F.lit(None).cast("string").alias("purl"),
        F.when(local, F.col("sub_url")).alias("vcs_url"),
        "path",
        "type",
    )


def component_key() -> F.Column:
    """Packages and unknown system files share names; files of one subproject are one."""
    return (
        F.when(F.col("type") == SYSTEM, F.col("name"))
        .when(F.col("type") == UNKNOWN, paths.soname_base(F.col("name")))
        .when((F.col("type") == LOCAL) & paths.in_subproject(F.col("path")), F.concat(F.lit("meson:"), F.col("name")))
        .when(F.col("type") == ECOSYSTEM, F.concat(F.lit("eco:"), F.col("purl")))
        .otherwise(F.col("path"))
    )


def first_of_key(rows: DataFrame) -> DataFrame:
    """One component a key, the least by (type, path)."""
    best = F.min_by(F.struct(*COLUMNS), F.struct("type", "path")).alias("c")
    return rows.groupBy(component_key().alias("key")).agg(best).select("c.*")


def doubled(pointers: DataFrame) -> DataFrame:
    """``pointers`` (pid, up, depth) followed until they leave the table; those that never do, in cycles, are dropped.

    Each round doubles the steps taken, so a chain of n takes log2(n) rounds.
    """
    rounds = pointers.count().bit_length() + 1
    for _ in range(rounds):
        on = pointers.select(F.col("pid").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_more"))
        pointers = stage(pointers.join(on, "up", "left").select("pid", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")))
        if pointers.join(pointers.select(F.col("pid").alias("up")), "up", "left_semi").isEmpty():
            return pointers
    return pointers.join(pointers.select(F.col("pid").alias("up")), "up", "left_anti")


def doubled(pointers: DataFrame) -> DataFrame:
    """``pointers`` (pid, up, depth) followed until they leave the table; those that never do, in cycles, are dropped.

    Each round doubles the steps taken, so a chain of n takes log2(n) rounds.
    """
    rounds = pointers.count().bit_length() + 1
    for _ in range(rounds):
        on = pointers.select(F.col("pid").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_more"))
        pointers = stage(pointers.join(on, "up", "left").select("pid", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")))
        if pointers.join(pointers.select(F.col("pid").alias("up")), "up", "left_semi").isEmpty():
            return pointers
    return pointers.join(pointers.select(F.col("pid").alias("up")), "up", "left_anti")


#: So many links between processes are followed in one task (16 bytes each); more in rounds over all tasks.
SMALL = 1_000_000


def walked(root: int):
    """Task over all links (up, pid): breadth first from ``root``."""

    def run(batches):
        below = defaultdict(list)
        for batch in batches:
            for up, pid in zip(batch.column("up").to_pylist(), batch.column("pid").to_pylist()):
                below[up].append(pid)
        depth, todo = {root: 0}, deque([root])
        while todo:
            up = todo.popleft()
            for pid in below[up]:
                if pid not in depth:
                    depth[pid] = depth[up] + 1
                    todo.append(pid)
        yield pa.RecordBatch.from_arrays([pa.array(depth.keys(), pa.int64()), pa.array(depth.values(), pa.int64())], ["pid", "depth"])

    return run


def descendants(forks: DataFrame, root: int, small: int = SMALL) -> DataFrame:
    """(pid, depth) of the processes forked from ``root``, directly or not, with the least depth; any depth, cycles too.

    The links are counted first: up to ``small`` of them are followed in one
    task, more by ``spread``, with the same result.
    """
    edges = stage(forks.select(F.col("parent_pid").cast("long").alias("up"), F.col("child_pid").cast("long").alias("pid")).filter((F.col("up") != F.col("pid")) & (F.col("pid") != root)).distinct())
    if edges.count() > small:
        return spread(edges, root)
    # An empty part has no task; a link that leads nowhere stands for it.
    more = edges.sparkSession.range(1).select(F.lit(None).cast("long").alias("up"), F.lit(None).cast("long").alias("pid"))
    return edges.unionByName(more).coalesce(1).mapInArrow(walked(root), "pid long, depth long")


def spread(edges: DataFrame, root: int) -> DataFrame:
    """``descendants`` over distinct links (up, pid) of any number.

    A process forked once points to its parent; pointers are doubled until
    they end at the root, at a process that several forked, or nowhere. Only
    the processes that several forked (reused ids) are then relaxed, one round
    for each of them on a path.
    """
    spark = edges.sparkSession
    parents = edges.groupBy("pid").agg(F.count("*").alias("n"), F.min("up").alias("up"))
    single = doubled(parents.filter("n = 1").select("pid", "up", F.lit(1).cast("long").alias("depth")))
    several = parents.filter("n > 1").select("pid")
    ends = edges.join(several, "pid", "left_semi").join(single.select(F.col("pid").alias("up"), F.col("up").alias("_end"), "depth"), "up", "left")
    ends = stage(ends.select("pid", F.coalesce("_end", "up").alias("up"), (F.coalesce("depth", F.lit(0)) + 1).alias("step")))
    known = spark.createDataFrame([(root, 0)], "pid long, depth long")
    fresh = known
    while not fresh.isEmpty():
        reached = ends.join(fresh.select(F.col("pid").alias("up"), "depth"), "up").groupBy("pid").agg(F.min(F.col("depth") + F.col("step")).alias("depth"))
        fresh = stage(reached.join(known.select("pid", F.col("depth").alias("_had")), "pid", "left").filter("_had is null or depth < _had").select("pid", "depth"))
        known = stage(known.unionByName(fresh).groupBy("pid").agg(F.min("depth").alias("depth")))
    below = single.join(known.select(F.col("pid").alias("up"), F.col("depth").alias("_base")), "up").select("pid", (F.col("depth") + F.col("_base")).alias("depth"))
    return known.unionByName(below)


def with_parent(known: DataFrame, forks: DataFrame) -> DataFrame:
    """(pid, parent_pid): by fork, else what the process itself names (``known``: pid, ppid)."""
    parents = forks.groupBy(F.col("child_pid").alias("pid")).agg(F.min("parent_pid").alias("parent_pid"))
    return known.join(parents, "pid", "left").select("pid", F.coalesce("parent_pid", "ppid").alias("parent_pid"))


def counters(rows: DataFrame) -> DataFrame:
    """Sums over processors of counters (counter, cpu, n)."""
    return rows.groupBy("counter").agg(F.sum("n").alias("total"))
