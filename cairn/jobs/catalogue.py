"""Registered queries over whole tables, each beside the SQL that says the same."""

from pyspark.sql import functions as F

from cairn.functions import paths, versions
from cairn.jobs import lock_queries, system_queries
from cairn.jobs.registry import QUERIES, SQL, query
from cairn.operators import links, report, trace
from cairn.sources import files as real_files
from cairn.sources import lockfiles
from cairn.sources.bundle import PROJECT, sql, table
from cairn.sources.store import new_folder, stage


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def any_prefix(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{p}')" for p in prefixes) + ")"


def s_file(x: str) -> str:
    name = rf"regexp_extract({x}, '([^/]*?)(?:/+\.?)*\z', 1)"
    return f"(CASE WHEN {name} IN ('.', '..') THEN '' ELSE {name} END)"


def s_ext(x: str) -> str:
    return rf"regexp_extract({s_file(x)}, '^.+\.([^.]*)\z', 1)"


def s_relevant(x: str) -> str:
    return f"({x} <> '' AND NOT {any_prefix(x, paths.NOISE)} AND (contains({s_file(x)}, '.so') OR {s_ext(x)} IN ({quoted(paths.RELEVANT)})))"


def s_orchestrator(x: str) -> str:
    base = rf"regexp_replace(regexp_replace({x}, '[0-9.]+\z', ''), '-+\z', '')"
    return f"({x} IN ({quoted(paths.ORCHESTRATORS)}) OR {base} IN ({quoted(paths.ORCHESTRATORS)}))"


def s_normal(raw: str, cwd: str) -> str:
    full = f"(CASE WHEN starts_with({raw}, '/') THEN {raw} ELSE {cwd} || '/' || {raw} END)"
    parts = f"list_transform(list_filter(string_split({full}, '/'), lambda x: x <> '' AND x <> '.'), lambda x: [x])"
    fold = f"list_reduce({parts}, lambda a, x: CASE WHEN x[1] = '..' THEN a[:len(a) - 1] ELSE list_concat(a, x) END, CASE WHEN starts_with({full}, '/') THEN ['/'] ELSE []::VARCHAR[] END)"
    return f"regexp_replace(array_to_string({fold}, '/'), '^/+', '/')"


def s_base(x: str) -> str:
    return f"regexp_replace(split_part({x}, '.so', 1), '^lib', '')"


def s_soname(x: str) -> str:
    return f"(CASE WHEN contains({x}, '.so') AND {s_base(x)} <> '' THEN {s_base(x)} END)"


def s_soversion(x: str) -> str:
    return rf"(CASE WHEN {s_soname(x)} IS NOT NULL THEN nullif(regexp_extract({x}, '^.*?\.so\.([0-9].*)\z', 1), '') END)"


IN_SUB = "regexp_matches({0}, '(^|/)subprojects/[^/]+')"
OPENED = f"SELECT o.seq, o.pid, o.raw_path, coalesce(p.comm, '') AS comm, coalesce(p.cwd, '{PROJECT}') AS cwd FROM {sql('open_event')} o LEFT JOIN {sql('process')} p USING (pid)"
UNIQUE = f"SELECT DISTINCT {s_normal('raw_path', 'cwd')} AS path FROM ({OPENED}) WHERE {s_relevant('raw_path')} AND NOT {s_orchestrator('comm')}"
FILE_TABLE = f"""SELECT path, CASE WHEN starts_with(path, '/lib/') THEN '/usr' || path ELSE path END AS canonical, CASE WHEN min(seq) % 5 <> 0 THEN 'content of ' || path END AS content
    FROM (SELECT seq, {s_normal('raw_path', 'cwd')} AS path FROM ({OPENED}) WHERE seq % 7 <> 0) WHERE path <> '' GROUP BY path"""
EXISTING = f"SELECT u.path, f.canonical, 'sha256:' || sha256(f.content) AS hash FROM ({UNIQUE}) u JOIN ({FILE_TABLE}) f USING (path)"


def opens(spark, sf_dir):
    return table(spark, sf_dir, "open_event")


def opened(spark, sf_dir):
    return trace.with_process(opens(spark, sf_dir), table(spark, sf_dir, "process"), PROJECT)


def unique_paths(spark, sf_dir):
    return trace.relevant_paths(opens(spark, sf_dir), table(spark, sf_dir, "process"), PROJECT)


_FILES: dict = {}


def file_table(spark, sf_dir):
    """A bundle's files (path, canonical, content), written once a session: most paths opened, some of them unreadable."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _FILES:
        path = F.col("path")
        rows = opened(spark, sf_dir).filter("seq % 7 <> 0").select("seq", paths.normalized(F.col("raw_path"), F.col("cwd")).alias("path")).filter(path != "")
        rows = rows.groupBy("path").agg(F.min("seq").alias("first"))
        canonical = F.when(path.startswith("/lib/"), F.concat(F.lit("/usr"), path)).otherwise(path)
        _FILES[key] = stage(rows.select("path", canonical.alias("canonical"), F.when(F.col("first") % 5 != 0, F.concat(F.lit("content of "), path)).alias("content")))
    return _FILES[key]


def files(spark, sf_dir):
    return trace.existing(unique_paths(spark, sf_dir), file_table(spark, sf_dir))


def predicate(name: str, column, statement: str):
    @query(name, f"SELECT seq, raw_path FROM {sql('open_event')} WHERE {statement}")
    def run(spark, sf_dir):
        return opens(spark, sf_dir).filter(column(F.col("raw_path"))).select("seq", "raw_path")


predicate("flt_relevant", paths.is_relevant, s_relevant("raw_path"))
predicate("flt_system_path", paths.is_system, any_prefix("raw_path", paths.SYSTEM))
predicate("flt_in_subproject", paths.in_subproject, IN_SUB.format("raw_path"))
predicate("flt_empty_path", lambda x: x != "", "raw_path <> ''")
predicate("flt_local_header", lambda x: ~paths.is_dropped_header(x), f"NOT (NOT {any_prefix('raw_path', paths.SYSTEM)} AND {s_ext('raw_path')} IN ({quoted(paths.HEADERS)}) AND NOT {IN_SUB.format('raw_path')})")


def scalar(name: str, column, statement: str):
    @query(name, f"SELECT seq, {statement} AS result FROM {sql('open_event')}")
    def run(spark, sf_dir):
        return opens(spark, sf_dir).select("seq", column(F.col("raw_path")).alias("result"))


scalar("fn_normalize", lambda x: paths.normalized(x, F.lit(PROJECT)), s_normal("raw_path", f"'{PROJECT}'"))
scalar("fn_soname_base", lambda x: paths.soname_base(paths.file_name(x)), s_base(s_file("raw_path")))
scalar("fn_unknown_name", paths.file_name, s_file("raw_path"))
scalar("fn_purl_local", lambda x: versions.local_purl(paths.file_name(x), F.concat(F.lit("sha256:"), F.sha2(x, 256))), f"'pkg:generic/' || {s_file('raw_path')} || '@sha256%3A' || sha256(raw_path)")
scalar("fn_local_name", paths.local_name, f"coalesce({s_soname(s_file('raw_path'))}, regexp_replace(regexp_replace({s_file('raw_path')}, '(.)\\.[^.]*\\z', '\\1'), '^lib', ''))")


@query("fn_soname_name_version", f"SELECT seq, {s_soname(s_file('raw_path'))} AS name, {s_soversion(s_file('raw_path'))} AS version FROM {sql('open_event')}")
def fn_soname_name_version(spark, sf_dir):
    name = paths.file_name(F.col("raw_path"))
    return opens(spark, sf_dir).select("seq", paths.soname_name(name).alias("name"), paths.soname_version(name).alias("version"))


@query("flt_orchestrator", f"SELECT pid, comm FROM {sql('process')} WHERE {s_orchestrator('comm')}")
def flt_orchestrator(spark, sf_dir):
    return table(spark, sf_dir, "process").filter(paths.is_orchestrator(F.col("comm"))).select("pid", "comm")


@query("join_event_comm", f"SELECT seq, comm FROM ({OPENED})")
def join_event_comm(spark, sf_dir):
    return opened(spark, sf_dir).select("seq", "comm")


@query("join_event_cwd", f"SELECT seq, cwd FROM ({OPENED})")
def join_event_cwd(spark, sf_dir):
    return opened(spark, sf_dir).select("seq", "cwd")


QUERIES["agg_distinct_paths"], SQL["agg_distinct_paths"] = unique_paths, UNIQUE


@query("flt_exists", EXISTING)
def flt_exists(spark, sf_dir):
    """Paths that exist after the build, with what is known of the file."""
    return files(spark, sf_dir)


@query("semi_exists", f"SELECT path FROM ({UNIQUE}) WHERE path IN (SELECT path FROM ({FILE_TABLE}))")
def semi_exists(spark, sf_dir):
    return unique_paths(spark, sf_dir).join(file_table(spark, sf_dir).select("path"), "path", "left_semi")


@query("src_file_hash", f"SELECT path, coalesce('sha256:' || sha256(content), 'sha256:error') AS hash FROM ({FILE_TABLE})")
def src_file_hash(spark, sf_dir):
    """Hashes of real files, one for each path; those that can't be read give an error.

    Folders are written with a ``=`` behind their names and files with a ``-``,
    so that a path may be a file and also lead to others.
    """
    root = new_folder(spark, "files")
    rows = file_table(spark, sf_dir).select(F.concat(F.replace("path", F.lit("/"), F.lit("=/")), F.lit("-")).alias("rel_path"), "content")
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // 5000)), "rel_path")
    real_files.written(rows, root)
    found = real_files.hashed(rows.select(F.concat(F.lit(f"{root}/"), "rel_path").alias("path")))
    stored = F.expr(f"substring(path, {len(root) + 2}, length(path) - {len(root) + 2})")
    return found.select(F.replace(stored, F.lit("=/"), F.lit("/")).alias("path"), "hash")


@query("flt_orch_switch", UNIQUE.replace(f" AND NOT {s_orchestrator('comm')}", ""))
def flt_orch_switch(spark, sf_dir):
    """Paths with those of build tools."""
    return trace.relevant_paths(opens(spark, sf_dir), table(spark, sf_dir, "process"), PROJECT, orchestrators=True)


@query("agg_counts", f"SELECT pid, count(*) AS opens, count(DISTINCT raw_path) AS paths, count(*) FILTER ({s_relevant('raw_path')}) AS relevant FROM {sql('open_event')} GROUP BY pid")
def agg_counts(spark, sf_dir):
    raw = F.col("raw_path")
    return opens(spark, sf_dir).groupBy("pid").agg(F.count("*").alias("opens"), F.countDistinct(raw).alias("paths"), F.count_if(paths.is_relevant(raw)).alias("relevant"))


@query("agg_known_pids", f"SELECT pid, min(seq) AS first_seq FROM {sql('open_event')} GROUP BY pid")
def agg_known_pids(spark, sf_dir):
    return opens(spark, sf_dir).groupBy("pid").agg(F.min("seq").alias("first_seq"))


OWNERS = f"(SELECT path, arg_max(pkg_key, pos) AS pkg_key FROM {sql('pkg_file')} GROUP BY path)"
META = f"(SELECT pkg_key, arg_max(struct_pack(v := version, s := src_name), pos) AS m FROM {sql('pkg_meta')} GROUP BY pkg_key)"
PACKAGED = f"""SELECT f.path, f.canonical, f.hash, coalesce(a.pkg_key, b.pkg_key) AS pkg_key,
    CASE WHEN coalesce(a.pkg_key, b.pkg_key) IS NOT NULL THEN coalesce(m.m.v, 'unknown') END AS version, m.m.s AS src_name
    FROM ({EXISTING}) f LEFT JOIN {OWNERS} a ON a.path = f.path LEFT JOIN {OWNERS} b ON b.path = f.canonical LEFT JOIN {META} m ON m.pkg_key = coalesce(a.pkg_key, b.pkg_key)"""


@query("agg_map_last_wins", f"SELECT path, pkg_key FROM {OWNERS}")
def agg_map_last_wins(spark, sf_dir):
    return trace.last_wins(table(spark, sf_dir, "pkg_file"), "path", "pkg_key")


def packaged(spark, sf_dir):
    return trace.with_package(files(spark, sf_dir), table(spark, sf_dir, "pkg_file"), table(spark, sf_dir, "pkg_meta"))


WALKED = f"""(WITH RECURSIVE link AS (SELECT * FROM {sql('link')}), walk(path, cur, n, step) AS (
        SELECT path, path, 0, 0 FROM ({EXISTING}) WHERE starts_with(path, '/')
        UNION ALL SELECT path, CASE WHEN m IS NULL THEN regexp_replace(cur, '^((?:/[^/]+)*?)/[^/]+/\\.\\.(/|\\z)', '\\1\\2')
                ELSE CASE WHEN starts_with(m.target, '/') THEN '' ELSE regexp_replace(m.path, '/[^/]+\\z', '') || '/' END || m.target || substr(cur, length(m.path) + 1) END, n + CASE WHEN m IS NULL THEN 0 ELSE 1 END, step + 1
            FROM (SELECT w.path, w.cur, w.n, w.step, arg_min(struct_pack(path := l.path, target := l.target), length(l.path)) FILTER (l.path IS NOT NULL) AS m FROM walk w LEFT JOIN link l ON w.cur = l.path OR starts_with(w.cur, l.path || '/') GROUP BY ALL)
            WHERE n <= 40 AND (m IS NOT NULL OR contains(cur, '/..')))
    SELECT path, CASE WHEN max(n) <= 40 THEN arg_max(cur, step) END AS canonical FROM walk GROUP BY path)"""


@query("join_path_pkg_canonical", f"SELECT f.path, w.canonical, coalesce(a.pkg_key, b.pkg_key) AS pkg_key FROM ({EXISTING}) f LEFT JOIN {WALKED} w USING (path) LEFT JOIN {OWNERS} a ON a.path = f.path LEFT JOIN {OWNERS} b ON b.path = w.canonical")
def join_path_pkg_canonical(spark, sf_dir):
    """Packages by path, else by the path that the bundle's links lead to."""
    found = files(spark, sf_dir).drop("canonical")
    led = links.canonical(found.select("path").filter(F.col("path").startswith("/")), table(spark, sf_dir, "link")).select("path", "canonical")
    rows = trace.with_package(found.join(led, "path", "left"), table(spark, sf_dir, "pkg_file"), table(spark, sf_dir, "pkg_meta"))
    return rows.select("path", "canonical", "pkg_key")


@query("join_pkg_version", f"SELECT path, version, src_name FROM ({PACKAGED})")
def join_pkg_version(spark, sf_dir):
    return packaged(spark, sf_dir).select("path", "version", "src_name")


@query("join_path_pkg", f"SELECT path, a.pkg_key, split_part(a.pkg_key, ':', 1) AS name, CASE WHEN contains(a.pkg_key, ':') THEN regexp_extract(a.pkg_key, '^[^:]*:(.*)', 1) END AS arch FROM ({EXISTING}) f JOIN {OWNERS} a USING (path)")
def join_path_pkg(spark, sf_dir):
    owned = files(spark, sf_dir).join(trace.last_wins(table(spark, sf_dir, "pkg_file"), "path", "pkg_key"), "path")
    return owned.select("path", "pkg_key", F.substring_index("pkg_key", ":", 1).alias("name"), trace.arch_of(F.col("pkg_key")).alias("arch"))


@query("join_pkg_source", f"SELECT path, src_name FROM ({PACKAGED}) WHERE pkg_key IS NOT NULL")
def join_pkg_source(spark, sf_dir):
    return packaged(spark, sf_dir).filter("pkg_key is not null").select("path", "src_name")


DIRS = "list_transform(list_filter(range(1, len(string_split(path, '/'))), lambda i: string_split(path, '/')[i] = 'subprojects'), lambda i: string_split(path, '/')[i + 1])"
TRIED = f"SELECT path, arg_min(struct_pack(n := s.name, v := s.version, u := s.url), nth) AS e FROM (SELECT path, unnest({DIRS}) AS d, generate_subscripts({DIRS}, 1) AS nth FROM ({EXISTING})) JOIN {sql('subproject')} s ON s.dirname = d GROUP BY path"
SUBBED = f"""SELECT path, coalesce(t.e.n, regexp_replace(({DIRS})[1], '-[0-9][0-9.+]*\\z', '')) AS sub_name,
    CASE WHEN t.e IS NOT NULL THEN t.e.v ELSE nullif(regexp_extract(({DIRS})[1], '^.*-([0-9][0-9.+]*)\\z', 1), '') END AS sub_version, t.e.u AS sub_url
    FROM ({EXISTING}) LEFT JOIN ({TRIED}) t USING (path)"""


@query("join_subproject_fallback", SUBBED)
def join_subproject_fallback(spark, sf_dir):
    return trace.with_subproject(files(spark, sf_dir), table(spark, sf_dir, "subproject")).select("path", "sub_name", "sub_version", "sub_url")


@query("join_subproject", f"SELECT path, sub_name, sub_version, sub_url FROM ({SUBBED}) WHERE sub_url IS NOT NULL")
def join_subproject(spark, sf_dir):
    """Paths under an indexed subproject."""
    return join_subproject_fallback(spark, sf_dir).filter("sub_url is not null")


SYSTEM = any_prefix("p.path", paths.SYSTEM)
NAME = s_file("p.canonical")
STEM = rf"regexp_replace(regexp_replace({s_file('p.path')}, '(.)\.[^.]*\z', '\1'), '^lib', '')"
COMPONENTS = f"""SELECT CASE type WHEN 'system_package' THEN split_part(pkg_key, ':', 1) WHEN 'local_file' THEN own ELSE file END AS name,
        CASE type WHEN 'system_package' THEN version WHEN 'local_file' THEN local_version END AS version,
        CASE WHEN type = 'system_package' AND contains(pkg_key, ':') THEN regexp_extract(pkg_key, '^[^:]*:(.*)', 1) END AS arch,
        CASE WHEN type = 'system_package' THEN src_name END AS src_name, CASE WHEN type = 'local_file' THEN coalesce(hash, 'sha256:error') END AS hash,
        NULL::VARCHAR AS purl, CASE WHEN type = 'local_file' THEN sub_url END AS vcs_url, path, type
    FROM (SELECT p.*, u.sub_url, {s_file('p.path')} AS file, coalesce(u.sub_name, {s_soname(NAME)}, {STEM}) AS own,
            CASE WHEN u.sub_name IS NOT NULL THEN u.sub_version ELSE {s_soversion(NAME)} END AS local_version,
            CASE WHEN {SYSTEM} AND p.pkg_key IS NOT NULL THEN 'system_package' WHEN {SYSTEM} THEN 'system_unknown' ELSE 'local_file' END AS type
        FROM ({PACKAGED}) p JOIN ({SUBBED}) u ON u.path = p.path
        WHERE NOT (NOT {SYSTEM} AND {s_ext('p.path')} IN ({quoted(paths.HEADERS)}) AND NOT {IN_SUB.format('p.path')}))"""
KEY = f"CASE type WHEN 'system_package' THEN name WHEN 'system_unknown' THEN {s_base('name')} ELSE CASE WHEN type = 'local_file' AND {IN_SUB.format('path')} THEN 'meson:' || name WHEN type = 'ecosystem_package' THEN 'eco:' || purl ELSE path END END"


def first_sql(rows: str) -> str:
    return f"SELECT * EXCLUDE (k, n) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY type, path) AS n FROM (SELECT *, {KEY} AS k FROM ({rows}))) WHERE n = 1"


def components(spark, sf_dir):
    return trace.components(files(spark, sf_dir), *(table(spark, sf_dir, t) for t in ("pkg_file", "pkg_meta", "subproject")))


QUERIES["fn_to_component"], SQL["fn_to_component"] = components, COMPONENTS


@query("fn_identify", f"SELECT path, type, name FROM ({COMPONENTS}) WHERE type <> 'local_file'")
def fn_identify(spark, sf_dir):
    """System paths by their package or as unknown."""
    return components(spark, sf_dir).filter("type <> 'local_file'").select("path", "type", "name")


@query("fn_identify_local", f"SELECT path, name, version, hash, vcs_url FROM ({COMPONENTS}) WHERE type = 'local_file'")
def fn_identify_local(spark, sf_dir):
    """Local files by subproject, library name or stem, with their hash."""
    return components(spark, sf_dir).filter("type = 'local_file'").select("path", "name", "version", "hash", "vcs_url")


@query("agg_component_dedup", first_sql(COMPONENTS))
def agg_component_dedup(spark, sf_dir):
    return trace.first_of_key(components(spark, sf_dir))


agg_eco_dedup, ECO = QUERIES["agg_eco_dedup"], SQL["agg_eco_dedup"]


REPORT = f"{first_sql(COMPONENTS)} UNION ALL SELECT name, version, NULL, NULL, NULL, purl, NULL, 'ecosystem:' || ecosystem, 'ecosystem_package' FROM ({ECO})"


@query("set_union_report", REPORT)
def set_union_report(spark, sf_dir):
    return agg_component_dedup(spark, sf_dir).unionByName(lockfiles.as_components(agg_eco_dedup(spark, sf_dir)))


@query("report_components", REPORT)
def report_components(spark, sf_dir):
    return report.ordered(set_union_report(spark, sf_dir))


@query("sort_components", f"SELECT *, row_number() OVER (PARTITION BY type ORDER BY name, version NULLS FIRST, path) AS place FROM ({REPORT})")
def sort_components(spark, sf_dir):
    """The report's order, told by places within each type."""
    return report.numbered(set_union_report(spark, sf_dir))


@query("anti_eco_insert", f"SELECT * FROM ({REPORT}) WHERE type = 'ecosystem_package' AND 'eco:' || purl NOT IN (SELECT {KEY} FROM ({COMPONENTS}))")
def anti_eco_insert(spark, sf_dir):
    """Packages whose key no traced component has."""
    packages = lockfiles.as_components(agg_eco_dedup(spark, sf_dir))
    known = components(spark, sf_dir).select(trace.component_key().alias("key"))
    return packages.withColumn("key", trace.component_key()).join(known, "key", "left_anti").drop("key")


@query("snk_log_counts", f"SELECT 'paths' AS counter, count(*) AS n FROM ({UNIQUE}) UNION ALL SELECT 'ecosystem', count(*) FROM ({ECO}) UNION ALL SELECT 'components', count(*) FROM ({REPORT})")
def snk_log_counts(spark, sf_dir):
    """What a run logs."""
    counted = lambda name, rows: rows.agg(F.lit(name).alias("counter"), F.count("*").alias("n"))
    out = counted("paths", unique_paths(spark, sf_dir)).unionByName(counted("ecosystem", agg_eco_dedup(spark, sf_dir)))
    return out.unionByName(counted("components", set_union_report(spark, sf_dir)))


RUN = ("2026-01-02T03:04:05+00:00", 'make "all"', PROJECT)


@query("snk_report_json", f"SELECT name, version, arch, src_name, hash, purl, vcs_url, path, type AS component_type FROM ({REPORT})")
def snk_report_json(spark, sf_dir):
    """The report's JSON lines, read back."""
    lines = report.report_document(set_union_report(spark, sf_dir), *map(F.lit, RUN), F.lit(None).cast("int"))
    fields = "name string, version string, arch string, src_name string, hash string, purl string, vcs_url string, path string, component_type string"
    return lines.filter("part = 1").select(F.from_json(F.regexp_replace("line", "^,", ""), fields).alias("c")).select("c.*")


DISTRO = "ubuntu-24.04"
SYSTEM_PURL = f"CASE WHEN type = 'system_package' AND version <> 'unknown' THEN 'pkg:deb/ubuntu/' || name || '@' || replace(replace(version, '+', '%2B'), ':', '%3A') || '?' || concat_ws('&', 'arch=' || arch, 'distro={DISTRO}', 'upstream=' || src_name)"
CDX = f"""SELECT type, path, name, {SYSTEM_PURL}
        WHEN type = 'local_file' THEN 'pkg:generic/' || name || '@' || replace(replace(coalesce(version, hash), '+', '%2B'), ':', '%3A') WHEN type = 'ecosystem_package' THEN purl END AS purl,
    CASE WHEN type = 'local_file' THEN coalesce(version, hash) ELSE version END AS version,
    CASE WHEN type = 'local_file' AND hash <> 'sha256:error' THEN substr(hash, 8) END AS sha256,
    CASE WHEN type <> 'ecosystem_package' THEN path END AS occurrence FROM ({REPORT})"""


@query("fn_cdx_component", CDX)
def fn_cdx_component(spark, sf_dir):
    return report.bom_rows(report_components(spark, sf_dir), F.lit(DISTRO))


SYSTEM_ROW = f"SELECT 0 AS place, 'operating-system' AS type, NULL AS path, '{DISTRO.split('-')[0]}' AS name, NULL AS purl, '{DISTRO.split('-')[1]}' AS version, NULL AS sha256, NULL AS occurrence"


@query("set_prepend_os", f"{SYSTEM_ROW} UNION ALL SELECT 1, type, path, name, purl, version, sha256, occurrence FROM ({CDX})")
def set_prepend_os(spark, sf_dir):
    return report.with_system(fn_cdx_component(spark, sf_dir), F.lit(DISTRO))


@query("snk_cdx", f"SELECT CASE WHEN place = 0 THEN 'os-component' ELSE purl END AS ref, CASE WHEN place = 0 THEN type ELSE 'library' END AS type, name, version, purl, CASE WHEN sha256 IS NOT NULL THEN 'SHA-256' END AS alg, sha256, occurrence FROM ({SYSTEM_ROW} UNION ALL SELECT 1, type, path, name, purl, version, sha256, occurrence FROM ({CDX}))")
def snk_cdx(spark, sf_dir):
    """The bill of materials' JSON lines, read back."""
    lines = report.bom_document(set_prepend_os(spark, sf_dir), F.lit(RUN[0]), F.lit(RUN[2]), "cairn", "1")
    fields = "`bom-ref` string, type string, name string, version string, purl string, hashes array<struct<alg:string,content:string>>, evidence struct<occurrences:array<struct<location:string>>>"
    c = lines.filter("part = 1").select(F.from_json(F.regexp_replace("line", "^,", ""), fields).alias("c"))
    first = lambda x: F.get(x, 0)
    return c.select(F.col("c.bom-ref").alias("ref"), "c.type", "c.name", "c.version", "c.purl", first(F.col("c.hashes"))["alg"].alias("alg"), first(F.col("c.hashes"))["content"].alias("sha256"), first(F.col("c.evidence.occurrences"))["location"].alias("occurrence"))


FORKED = f"""(WITH RECURSIVE edges AS (SELECT DISTINCT parent_pid, child_pid FROM {sql('fork_edge')} WHERE child_pid <> parent_pid AND child_pid <> 1),
    tree(pid, depth) USING KEY (pid) AS (SELECT 1::BIGINT, 0::BIGINT UNION SELECT n.pid, n.depth FROM
        (SELECT f.child_pid AS pid, min(t.depth) + 1 AS depth FROM tree t JOIN edges f ON f.parent_pid = t.pid GROUP BY f.child_pid) n LEFT JOIN recurring.tree r ON r.pid = n.pid WHERE r.pid IS NULL OR n.depth < r.depth)
    SELECT pid, depth FROM tree)"""


def forks(spark, sf_dir):
    return table(spark, sf_dir, "fork_edge")


@query("rec_descendants", f"SELECT pid, depth FROM {FORKED}")
def rec_descendants(spark, sf_dir):
    return trace.descendants(forks(spark, sf_dir), 1)


@query("flt_pid_tracked", f"SELECT o.seq, o.pid FROM {sql('open_event')} o SEMI JOIN (SELECT pid FROM {FORKED}) t USING (pid)")
def flt_pid_tracked(spark, sf_dir):
    return opens(spark, sf_dir).join(trace.descendants(forks(spark, sf_dir), 1), "pid", "left_semi").select("seq", "pid")


@query("semi_tracked_pid", f"SELECT p.pid, p.comm FROM {sql('process')} p SEMI JOIN (SELECT pid FROM {FORKED}) t USING (pid)")
def semi_tracked_pid(spark, sf_dir):
    return table(spark, sf_dir, "process").join(trace.descendants(forks(spark, sf_dir), 1), "pid", "left_semi").select("pid", "comm")


def dirname_scalar(name: str, column, statement: str):
    """Version rules over directory-like names made from part sizes and keys."""
    dirname = "concat(CASE WHEN p_size % 4 = 0 THEN 'v' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN 'zlib-' WHEN p_size % 3 = 1 THEN 'a-1.2-' ELSE '' END, CAST(p_size AS STRING), '.', CAST(p_partkey % 10 AS STRING), CASE WHEN p_size % 7 = 0 THEN '-rc1' WHEN p_size % 7 = 1 THEN '.tar.gz' WHEN p_size % 7 = 2 THEN '+b:1' ELSE '' END)"

    @query(name, f"SELECT p_partkey, x, {statement} AS result FROM (SELECT p_partkey, {dirname} AS x FROM part)")
    def run(spark, sf_dir):
        rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(dirname).alias("x"))
        return rows.select("p_partkey", "x", column(F.col("x")).alias("result"))


FROM_DIR = r"nullif(regexp_extract({0}, '^.*-([0-9][0-9.+]*)\z', 1), '')"
dirname_scalar("fn_looks_like_version", versions.looks_like_version, r"regexp_matches(x, '^[0-9][0-9.+-]*\z')")
dirname_scalar("fn_version_from_revision", versions.from_revision, r"nullif(regexp_extract(x, '^v*([0-9][0-9.+-]*)\z', 1), '')")
dirname_scalar("fn_version_from_dirname", versions.from_dirname, FROM_DIR.format("x"))
dirname_scalar("fn_version_from_archive", versions.from_archive, FROM_DIR.format(r"regexp_replace(x, '\.(tar\.gz|tar\.xz|tar\.bz2|tar\.zst|zip)\z', '')"))
dirname_scalar("fn_name_from_dirname", versions.dirname_base, r"regexp_replace(x, '-[0-9][0-9.+]*\z', '')")
dirname_scalar("fn_encode_version", versions.encoded, "replace(replace(x, '+', '%2B'), ':', '%3A')")
dirname_scalar("fn_purl_cargo", lambda x: versions.purl("cargo", F.lit("c"), x), "'pkg:cargo/c@' || replace(replace(x, '+', '%2B'), ':', '%3A')")
dirname_scalar("fn_purl_npm", lambda x: versions.purl("npm", F.concat(F.lit("@s/"), x), x), "'pkg:npm/%40s/' || x || '@' || replace(replace(x, '+', '%2B'), ':', '%3A')")
dirname_scalar("fn_yarn_name", lambda x: versions.yarn_name(F.concat(F.lit("@s/"), x, F.lit("@^1"))), "'@s/' || x")
dirname_scalar("fn_purl_pypi", lambda x: versions.purl("pypi", F.concat(F.lit("A_b."), x), x), "'pkg:pypi/a-b-' || translate(x, '_.', '--') || '@' || replace(x, '+', '%2B')")
dirname_scalar("fn_purl_golang", lambda x: versions.purl("golang", F.lit("m/x"), x), "'pkg:golang/m/x@' || replace(x, '+', '%2B')")
dirname_scalar("fn_purl_system", lambda x: versions.system_purl(F.lit("p"), x, F.lit(None).cast("string"), F.lit("s"), F.lit("fedora-40")), "'pkg:rpm/fedora/p@' || replace(replace(x, '+', '%2B'), ':', '%3A') || '?distro=fedora-40&upstream=s'")
