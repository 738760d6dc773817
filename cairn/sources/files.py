"""Real files: walks, contents and hashes.

Listing reads no content. Where content is wanted, files are chosen by their
paths before any is opened, and a task holds one file at a time. ``hashes``
goes through Spark's own listing, which leaves out files of no bytes and names
that begin with ``_`` or a dot; ``walk``, ``texts`` and ``hashed`` go to the
store from the tasks and have them all.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources import lockfiles
from cairn.sources.store import stage
from cairn.sources.tracefile import opened

#: Files up to this size are read by Spark as one row; longer ones are hashed as streams.
WHOLE = 256 << 20
ERROR = "sha256:error"


def read(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``; those that can't be read or are gone give no rows once content is asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return reader.load(root)


def relative(path: Column, root: str) -> Column:
    """What follows ``root`` in a file's path, whatever its scheme."""
    bare = root.rstrip("/")
    bare = "/" + bare[5:].lstrip("/") if bare.startswith("file:") else bare
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), f"^.*?\\Q{bare}\\E/+", "")


def listed_path() -> Column:
    """A file's path as the listing has it, which is what files are chosen by; there it is encoded as a URL."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, length) of the files below ``root``."""
    return read(spark, root).select("path", relative(F.col("path"), root).alias("rel_path"), "length")


def listing(root: str):
    """Task: what lies in each folder (rel_path) below ``root``; nothing where it can't be listed."""

    def run(batches):
        from pyarrow import fs

        store, base = opened(root)
        for batch in batches:
            out: list = []
            for folder in batch.column("rel_path").to_pylist():
                try:
                    found = store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                except OSError:
                    continue
                out += [(f"{folder}/{x.base_name}".lstrip("/"), x.type == fs.FileType.Directory, x.size or 0) for x in found if x.type in (fs.FileType.Directory, fs.FileType.File)]
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64()))], ["rel_path", "folder", "length"])

    return run


def walk(spark: SparkSession, root: str, depth: int = lockfiles.DEPTH, skipped=lockfiles.SKIPPED) -> DataFrame:
    """(rel_path, length) of the files below ``root``, down to ``depth`` folders; what lies in ``skipped`` ones is never listed.

    One round a level, each of which lists its folders in parallel. Links to
    folders are followed.
    """
    folders, out = spark.createDataFrame([("",)], "rel_path string"), None
    for _ in range(depth + 1):
        rows = stage(folders.repartition("rel_path").mapInArrow(listing(root), "rel_path string, folder boolean, length long"))
        files = rows.filter("NOT folder").select("rel_path", "length")
        out = files if out is None else out.unionByName(files)
        folders = rows.filter(F.col("folder") & ~F.element_at(F.split("rel_path", "/"), -1).isin(*skipped)).select("rel_path")
        if folders.isEmpty():
            break
    return out


def texts(rows: DataFrame, root: str) -> DataFrame:
    """(rel_path, content) of files below ``root``; content is null where it can't be read or isn't UTF-8."""

    def run(batches):
        store, base = opened(root)
        for batch in batches:
            for rel_path in batch.column("rel_path").to_pylist():
                try:
                    with store.open_input_stream(f"{base}/{rel_path}") as file:
                        content = file.read().decode()
                except (OSError, UnicodeDecodeError):
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([rel_path]), pa.array([content], pa.string())], ["rel_path", "content"])

    return rows.select("rel_path").mapInArrow(run, "rel_path string, content string")


def lock_files(spark: SparkSession, root: str, names=lockfiles.ORDER, depth: int = lockfiles.DEPTH) -> DataFrame:
    """(rel_path, content) of the lock files that a walk from ``root`` comes to; no other file is opened. Content that isn't UTF-8 is null."""
    found = walk(spark, root, depth)
    return texts(found.filter(lockfiles.in_walk(F.col("rel_path"), names, depth)), root)


def wrap_files(spark: SparkSession, project: str) -> tuple[DataFrame, DataFrame]:
    """Wraps (wrap_path, content, pos) and checked-out heads (dirname, name, content) of a project's subproject folder.

    Redirects lead into subprojects, so wraps are looked for further down too.
    """
    root = f"{project}/subprojects"
    found = stage(walk(spark, root, skipped=("node_modules",)))
    path = F.col("rel_path")
    wraps = texts(found.filter(path.endswith(".wrap")), root).filter("content is not null")
    heads = texts(found.filter(path.rlike(r"^[^/]+/[.]git/(HEAD|refs/heads/.+)\z")), root).filter("content is not null")
    split = heads.select(F.substring_index("rel_path", "/", 1).alias("dirname"), F.regexp_replace("rel_path", r"^[^/]+/[.]git/", "").alias("name"), "content")
    return wraps.select(path.alias("wrap_path"), "content", F.lit(0).alias("pos")), split


def streamed(batches):
    """Task: hashes of files read in small pieces; none for a path that isn't there, null for one that can't be read or needn't be."""
    from pyarrow import fs

    for batch in batches:
        kept, out = [], []
        for path, wanted in zip(batch.column("path").to_pylist(), batch.column("wanted").to_pylist()):
            sha, said = hashlib.sha256(), None
            try:
                store, at = opened(path)
                if store.get_file_info(at).type == fs.FileType.NotFound:
                    continue
                if wanted:
                    with store.open_input_stream(at) as file:
                        while piece := file.read(1 << 16):
                            sha.update(piece)
                    said = sha.hexdigest()
            except OSError:
                pass
            kept.append((path, wanted))
            out.append(said)
        columns = list(zip(*kept)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(out, pa.string())], ["path", "wanted", "sha"])


def hashed(paths: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(path, hash) of the ``paths`` that are there, each opened by the task that has it; ``sha256:error`` for folders and what can't be read.

    Where ``wanted`` is given and doesn't hold, a path is only looked for and
    its hash is null. Memory is a small piece of one file, however long it is.
    """
    known = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    rows = paths.select("path", known.alias("wanted")).filter("path is not null").mapInArrow(streamed, "path string, wanted boolean, sha string")
    return rows.select("path", F.when(F.col("wanted"), F.coalesce(F.concat(F.lit("sha256:"), F.col("sha")), F.lit(ERROR))).alias("hash"))


def hashes(spark: SparkSession, root: str, wanted: Column | None = None, whole: int = WHOLE) -> DataFrame:
    """(rel_path, hash) of the files below ``root``, of those whose ``rel_path`` is ``wanted`` if given; ``sha256:error`` where one can't be read.

    ``wanted`` is put to the listing, so that other files are never opened.
    """
    at = relative(listed_path(), root)
    rows = read(spark, root)
    if wanted is not None:
        rows = rows.withColumn("rel_path", at).filter(wanted).drop("rel_path")
    every = rows.select("path", "length")
    small = rows.filter(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("sha"))
    large = hashed(every.filter(F.col("length") > whole).repartition("path"))
    done = every.join(small.select("path", F.concat(F.lit("sha256:"), F.col("sha")).alias("hash")).unionByName(large), "path", "left")
    return done.select(relative(F.col("path"), root).alias("rel_path"), F.coalesce("hash", F.lit(ERROR)).alias("hash"))


def written(files: DataFrame, root: str) -> None:
    """Write ``files`` (rel_path, content) as real files below ``root``, by the tasks that hold them; a null content leaves what can't be read.

    The latter is a folder in the file's place, which no store opens as a file.
    """

    def run(batches):
        store, base = opened(root)
        for batch in batches:
            for rel_path, content in zip(batch.column("rel_path").to_pylist(), batch.column("content").to_pylist()):
                path = f"{base}/{rel_path}"
                store.create_dir(path if content is None else path.rpartition("/")[0], recursive=True)
                if content is not None:
                    with store.open_output_stream(path) as file:
                        file.write(content.encode())
        yield from ()

    files.select("rel_path", "content").mapInArrow(run, "done boolean").collect()
