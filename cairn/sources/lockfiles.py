"""Lock files (path, content) as (name, version, ecosystem, purl, is_dev) rows.

Files come whole, one row each. JSON is read as variants (of equal keys in an
object the last counts) and text is split to lines by Spark; only TOML, which
Spark can't read, goes through a small Python task, a file at a time. A file
that can't be parsed gives no rows. ``parsed`` reads each text once: files
whose tools ran are written by name, and each parser reads its own.
"""

from __future__ import annotations

import pyarrow as pa
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import versions
from cairn.sources.store import stage, written

#: Directories never looked into, how deep lock files are looked for, and who must have run.
SKIPPED = ("target", "node_modules", ".git", "__pycache__", ".venv", "venv", "env", "vendor", ".tox", "dist", "build", ".cache", ".mypy_cache", ".pytest_cache")
DEPTH = 5
RAN = {
    "cargo": ("cargo", "rustc", "rustdoc", "clippy-driver"),
    "npm": ("npm", "node", "yarn", "pnpm", "npx", "corepack"),
    "pypi": ("uv", "hatch", "pdm"),
    "golang": ("go",),
}
RAN_PREFIXES = {"pypi": ("pip", "python")}
#: Parsers in the order in which their rows count; the first of equal packages stays.
ORDER = ("Cargo.lock", "package-lock.json", "yarn.lock", "Pipfile.lock", "poetry.lock", "requirements.txt", "go.sum")
ECOSYSTEM = {"Cargo.lock": "cargo", "package-lock.json": "npm", "yarn.lock": "npm", "Pipfile.lock": "pypi", "poetry.lock": "pypi", "requirements.txt": "pypi", "go.sum": "golang"}


def in_walk(path: Column, names, depth: int = DEPTH) -> Column:
    """Whether a walk of ``depth`` directories comes to a relative path with one of these file names."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    near = (F.size(dirs) <= depth) & ~F.arrays_overlap(dirs, F.array(*map(F.lit, SKIPPED)))
    return F.element_at(parts, -1).isin(*names) & near


def found(files: DataFrame, name: str, depth: int = DEPTH) -> DataFrame:
    """``files`` (rel_path, content) of this name that a walk of ``depth`` directories comes to."""
    return files.filter(in_walk(F.col("rel_path"), [name], depth))


def eco_rows(rows: DataFrame, kind: str, is_dev: Column | None = None) -> DataFrame:
    """Rows with name and version as packages of ecosystem ``kind``."""
    purl = versions.purl(kind, F.col("name"), F.col("version"))
    return rows.select("name", "version", F.lit(kind).alias("ecosystem"), purl.alias("purl"), (F.lit(False) if is_dev is None else is_dev).alias("is_dev"))


def lines(files: DataFrame) -> DataFrame:
    """(rel_path, pos, line): lines without their ends."""
    return files.select("rel_path", F.posexplode(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")).alias("pos", "line"))


TOML_COLUMNS = ["name", "version", "source", "category", "groups"]


def toml_file(content: str | None) -> list[list]:
    """The package tables of a TOML file; none where any isn't as it should be."""
    import tomllib

    try:
        packages = tomllib.loads(content or "").get("package") or []
        rows = [[p["name"], p["version"], p.get("source"), p.get("category"), p.get("groups", [])] for p in packages]
    except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError):
        return []
    texts = [x for row in rows for x in row[:2] + [y for y in row[2:4] if isinstance(y, str)]]
    if not all(isinstance(x, str) for x in texts) or not all(isinstance(r[4], list) for r in rows):
        return []
    return [[*r[:2], *(y if isinstance(y, str) else None for y in r[2:4]), [str(g) for g in r[4]]] for r in rows]


def toml_packages(batches):
    """Task: the packages of TOML files; one file is in Python at a time, and rows leave some thousands at a time."""
    types = [pa.string()] * 4 + [pa.list_(pa.string())]
    out: list = []
    record = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], TOML_COLUMNS)
    for batch in batches:
        for content in batch.column("content"):
            out += toml_file(content.as_py())
            if len(out) >= 4096:
                yield record(out)
                out = []
    yield record(out)


def toml_rows(files: DataFrame) -> DataFrame:
    return files.select("content").mapInArrow(toml_packages, "name string, version string, source string, category string, groups array<string>")


def cargo(files: DataFrame) -> DataFrame:
    """Packages from a registry or a git source."""
    rows = toml_rows(files).filter(F.col("source").startswith("registry+") | F.col("source").startswith("git+"))
    return eco_rows(rows, "cargo")


def poetry(files: DataFrame) -> DataFrame:
    """All packages; development ones by category or by groups without ``main``."""
    is_dev = F.coalesce(F.col("category") == "dev", F.lit(False)) | ((F.size("groups") > 0) & ~F.array_contains("groups", "main"))
    return eco_rows(toml_rows(files), "pypi", is_dev)


def members(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row for each member of an object column: name, value; none where it isn't an object."""
    spark = rows.sparkSession
    kept = "".join(f"{k}, " for k in keep)
    return spark.sql(f"SELECT {kept}m.key AS name, m.value AS value FROM {{rows}}, LATERAL variant_explode({column}) m WHERE startswith(schema_of_variant({column}), 'OBJECT')", rows=rows)


def text_of(path: str) -> Column:
    """A member of ``value`` if it is a text."""
    return F.when(F.expr(f"schema_of_variant(variant_get(value, '{path}', 'variant'))") == "STRING", F.expr(f"variant_get(value, '{path}', 'string')"))


def flag_of(path: str) -> Column:
    """A member of ``value`` if it is true."""
    return F.coalesce(F.expr(f"schema_of_variant(variant_get(value, '{path}', 'variant'))") == "BOOLEAN", F.lit(False)) & F.coalesce(F.expr(f"try_variant_get(value, '{path}', 'boolean')"), F.lit(False))


@contextmanager
def repeated_keys(spark: SparkSession):
    """Within, JSON objects may have equal keys; the last counts."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents(files: DataFrame) -> DataFrame:
    """``files`` that are JSON, as ``doc``, parsed once and written; ``major`` is the lock file version (1 if it has none)."""
    number = F.expr("try_variant_get(doc, '$.lockfileVersion', 'bigint')")
    whole = F.expr("schema_of_variant(variant_get(doc, '$.lockfileVersion', 'variant'))") == "BIGINT"
    with repeated_keys(files.sparkSession):
        # In brackets, what follows a document isn't overlooked: it is a second element, or no JSON.
        docs = files.select("rel_path", F.expr("try_parse_json(concat('[', content, ']'))").alias("doc")).filter("doc is not null and variant_get(doc, '$[1]', 'variant') is null")
        docs = docs.select("rel_path", F.expr("variant_get(doc, '$[0]', 'variant')").alias("doc")).filter("doc is not null")
        return stage(docs.withColumn("major", F.when(whole & (number >= 0), number).otherwise(F.lit(1))))


def npm_rows(docs: DataFrame) -> DataFrame:
    """Packages of both forms (flat, name, version, dev): one map from version 2 on, nested ones before.

    In the flat form names are install paths, the project itself left out. In
    the nested form a package without a version goes with all below it, and
    each level is a round, however deep.
    """
    below = F.expr("cast(variant_get(value, '$.dependencies', 'variant') as string)")
    fields = ("name", text_of("$.version").alias("version"), flag_of("$.dev").alias("dev"))
    level = docs.select((F.col("major") >= 2).alias("flat"), F.expr("CASE WHEN major >= 2 THEN variant_get(doc, '$.packages', 'variant') ELSE variant_get(doc, '$.dependencies', 'variant') END").alias("deps"))
    out = None
    while True:
        rows = members(level.filter("deps is not null"), "deps", "flat").select("flat", *fields, F.when(~F.col("flat"), below).alias("below"))
        rows = stage(rows.filter("version is not null and not (flat and name = '')"))
        out = rows if out is None else out.unionByName(rows)
        deeper = rows.filter("below is not null")
        if deeper.isEmpty():
            name = F.when(F.col("flat"), F.regexp_replace("name", "^node_modules/", "")).otherwise(F.col("name"))
            return out.select("flat", name.alias("name"), "version", "dev")
        with repeated_keys(docs.sparkSession):
            level = deeper.select("flat", F.expr("try_parse_json(below)").alias("deps"))


def npm_flat(files: DataFrame) -> DataFrame:
    """Lock files from version 2 on."""
    return eco_rows(npm_rows(documents(files).filter("major >= 2")), "npm", F.col("dev"))


def npm_nested(files: DataFrame) -> DataFrame:
    """Lock files of version 1."""
    return eco_rows(npm_rows(documents(files).filter("major < 2")), "npm", F.col("dev"))


def yarn(files: DataFrame) -> DataFrame:
    """Classic stanzas: the first ``version`` line under a header gives the version of the header's first name."""
    rows = lines(files).withColumn("text", F.btrim("line", F.lit(" \t\r")))
    rows = rows.filter(~F.col("text").startswith("#"))
    head = (F.col("text") != "") & ~F.col("line").startswith(" ") & ~F.col("line").startswith("\t")
    spec = F.btrim(F.btrim(F.substring_index(F.regexp_replace("text", ":+$", ""), ",", 1)), F.lit('"'))
    in_file = Window.partitionBy("rel_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stanza", F.sum((head | (F.col("text") == "")).cast("int")).over(in_file)).withColumn("spec", F.when(head, spec))
    version = F.when(F.col("spec").isNull() & F.col("text").startswith("version "), F.btrim(F.btrim(F.substring("text", 9, 1 << 30)), F.lit('"')))
    rows = rows.groupBy("rel_path", "stanza").agg(F.max("spec").alias("spec"), F.min_by(version, F.when(version.isNotNull(), F.col("pos"))).alias("version"))
    return eco_rows(rows.filter("version is not null").select(versions.yarn_name(F.col("spec")).alias("name"), "version").filter("name is not null"), "npm")


def pipfile(files: DataFrame) -> DataFrame:
    """The default section, then the development one."""
    sections = "stack(2, variant_get(doc, '$.default', 'variant'), false, variant_get(doc, '$.develop', 'variant'), true) AS (deps, is_dev)"
    rows = members(documents(files).selectExpr(sections).filter("deps is not null"), "deps", "is_dev")
    rows = rows.select("is_dev", "name", F.regexp_replace(text_of("$.version"), "^(==)+", "").alias("version"))
    return eco_rows(rows.filter("version is not null"), "pypi", F.col("is_dev"))


def requirements(text: DataFrame) -> DataFrame:
    """``name==version`` lines; what follows ``;`` is cut, paths and options are not packages."""
    line = F.btrim("line")
    kept = text.filter((line != "") & ~line.startswith("#") & ~line.startswith("-"))
    pin = F.btrim(F.substring_index(line, ";", 1))
    name, version = F.btrim(F.substring_index(pin, "==", 1)), F.btrim(F.regexp_extract(pin, "^.*?==(.*)", 1))
    kept = kept.filter(pin.contains("==")).select(name.alias("name"), version.alias("version"))
    return eco_rows(kept.filter("NOT contains(name, '/') AND NOT contains(version, '/')"), "pypi")


def go_sum(text: DataFrame) -> DataFrame:
    """``module version hash`` lines; those of go.mod files are not packages."""
    line = F.btrim("line")
    part = F.split(line, " ", 3)
    kept = text.filter((line != "") & ~line.startswith("//")).select(F.get(part, 0).alias("name"), F.get(part, 1).alias("version"))
    return eco_rows(kept.filter("version IS NOT NULL AND NOT endswith(version, '/go.mod')"), "golang")


def npm_lock(files: DataFrame) -> DataFrame:
    """Both forms; each text is parsed once."""
    return eco_rows(npm_rows(documents(files)), "npm", F.col("dev"))


PARSERS = {
    "Cargo.lock": cargo,
    "package-lock.json": npm_lock,
    "yarn.lock": yarn,
    "Pipfile.lock": pipfile,
    "poetry.lock": poetry,
    "requirements.txt": lambda files: requirements(lines(files)),
    "go.sum": lambda files: go_sum(lines(files)),
}


def ran(ecosystem: str) -> Column:
    """Whether a process name belongs to the tools of an ecosystem."""
    out = F.col("comm").isin(*RAN[ecosystem])
    for prefix in RAN_PREFIXES.get(ecosystem, ()):
        out = out | F.col("comm").startswith(prefix)
    return out


def gated(rows: DataFrame, process: DataFrame, ecosystem: str) -> DataFrame:
    """``rows`` if any process of the ecosystem's tools ran, else none."""
    return rows.sparkSession.sql("SELECT r.* FROM {rows} r WHERE EXISTS (SELECT 1 FROM {tools})", rows=rows, tools=process.filter(ran(ecosystem)))


def tools_ran(process: DataFrame) -> DataFrame:
    """(ecosystem, ran) of the four ecosystems, in one pass."""
    found = process.agg(*[F.coalesce(F.bool_or(ran(e)), F.lit(False)).alias(e) for e in RAN])
    return found.select(F.explode(F.array(*[F.struct(F.lit(e).alias("ecosystem"), F.col(e).alias("ran")) for e in RAN])).alias("x")).select("x.*")


def by_name(files: DataFrame, process: DataFrame | None = None) -> dict[str, DataFrame]:
    """Lock files that a walk comes to and whose tools ran (``process`` tells; without it all), by name.

    Each text is read once and written once to a folder of its name, so that a
    parser's scan has no other files.
    """
    name = F.element_at(F.split("rel_path", "/"), -1)
    rows = files.filter(in_walk(F.col("rel_path"), ORDER)).select("rel_path", "content", name.alias("lock"))
    if process is not None:
        kinds = F.create_map(*[F.lit(x) for pair in ECOSYSTEM.items() for x in pair])
        # Four rows at most.
        rows = rows.withColumn("ecosystem", F.element_at(kinds, F.col("lock"))).join(F.broadcast(tools_ran(process).filter("ran")), "ecosystem", "left_semi").drop("ecosystem")
    every = files.sparkSession.read.schema("rel_path string, content string, lock string").parquet(written(rows, "lock"))
    return {n: every.filter(F.col("lock") == n).select("rel_path", "content") for n in ORDER}


def parsed(files: DataFrame, process: DataFrame | None = None) -> DataFrame:
    """Packages of all lock files whose tools ran, with the ``rank`` of their parser."""
    out = None
    for rank, (name, own) in enumerate(by_name(files, process).items()):
        part = PARSERS[name](own).withColumn("rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    return out


def detected(files: DataFrame, process: DataFrame, include_dev: bool = False) -> DataFrame:
    """Packages of all lock files whose tools ran, development ones left out unless asked for, each once."""
    rows = parsed(files, process)
    return once(rows if include_dev else rows.filter("NOT is_dev"))


def once(rows: DataFrame) -> DataFrame:
    """One row for each (ecosystem, name, version): the first by parser, if rows have a ``rank``, then by purl."""
    rank = [F.col("rank")] if "rank" in rows.columns else []
    first = F.min_by(F.struct("purl", "is_dev"), F.struct(*rank, "purl", "is_dev")).alias("v")
    return rows.groupBy("ecosystem", "name", "version").agg(first).select("ecosystem", "name", "version", "v.purl", "v.is_dev")


def as_components(rows: DataFrame) -> DataFrame:
    """Packages as report components."""
    none = F.lit(None).cast("string")
    return rows.select("name", "version", none.alias("arch"), none.alias("src_name"), none.alias("hash"), "purl", none.alias("vcs_url"), F.concat(F.lit("ecosystem:"), F.col("ecosystem")).alias("path"), F.lit("ecosystem_package").alias("type"))
