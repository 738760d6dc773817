"""Lock-file queries over whole files; the SQL states what they must give over the rows the files were made of."""

from pyspark.sql import functions as F

from cairn.jobs.registry import query
from cairn.sources import files as real_files
from cairn.sources import lockfiles
from cairn.sources.bundle import sql, table
from cairn.sources.store import new_folder

PART = "(SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS f, p_partkey AS p, p_size AS size, p_size || '.0.' || p_partkey % 10 || CASE WHEN p_size % 5 = 0 THEN '+b' ELSE '' END AS v FROM part)"
SEEN, WHOLE = "f % 8 NOT IN (0, 1)", "f % 9 <> 4"


def packages(ecosystem: str, rows: str) -> str:
    name = {"npm": "regexp_replace(name, '^@', '%40')", "pypi": "translate(name, '_.ABCDEFGHIJKLMNOPQRSTUVWXYZ', '--abcdefghijklmnopqrstuvwxyz')"}.get(ecosystem, "name")
    return f"SELECT name, version, '{ecosystem}' AS ecosystem, 'pkg:{ecosystem}/' || {name} || '@' || replace(version, '+', '%2B') AS purl, is_dev FROM ({rows})"


CARGO = packages("cargo", f"SELECT 'c' || p AS name, v AS version, false AS is_dev FROM {PART} WHERE {SEEN} AND {WHOLE} AND p % 4 IN (0, 1)")
FLAT = packages("npm", f"SELECT CASE WHEN p % 6 = 5 THEN 'x/node_modules/' WHEN p % 3 = 0 THEN '@s/' ELSE '' END || 'n' || p AS name, v AS version, p % 5 = 0 AS is_dev FROM {PART} WHERE {SEEN} AND {WHOLE} AND f % 3 <> 0 AND p % 7 NOT IN (3, 4)")
NEST = f"(SELECT * FROM {PART} WHERE {SEEN} AND {WHOLE} AND f % 3 = 0 AND p % 4 = 0)"
NESTED = packages(
    "npm",
    f"""SELECT 'n' || p AS name, v AS version, false AS is_dev FROM {NEST} WHERE p % 28 <> 0 UNION ALL SELECT 'n' || p || '-a', '1.' || p, true FROM {NEST} WHERE p % 28 <> 0
        UNION ALL SELECT 'n' || p || '-b', '2', false FROM {NEST} WHERE p % 28 <> 0 UNION ALL SELECT 'n' || p || '-c', '3', false FROM {NEST}""",
)
YARN = packages("npm", f"SELECT CASE WHEN p % 4 = 1 THEN '@s/' ELSE '' END || 'y' || p AS name, size || '.' || p % 10 AS version, false AS is_dev FROM {PART} WHERE {SEEN} AND p % 4 <> 3 AND p % 5 <> 0")
PIPFILE = packages("pypi", f"SELECT s || p AS name, CASE WHEN p % 7 = 1 THEN '=' ELSE '' END || v AS version, s = 'e' AS is_dev FROM {PART}, (VALUES ('d'), ('e')) t(s) WHERE {SEEN} AND {WHOLE} AND p % 9 <> 2")
POETRY = packages("pypi", f"SELECT 'Po_' || p AS name, v AS version, p % 5 IN (0, 2) AS is_dev FROM {PART} WHERE {SEEN} AND {WHOLE}")
PINS = r"""SELECT trim(split_part(pin, '==', 1)) AS name, trim(regexp_extract(pin, '^.*?==(.*)', 1)) AS version, false AS is_dev FROM (
    SELECT trim(split_part(trim(line), ';', 1)) AS pin FROM {0} WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND NOT starts_with(trim(line), '-'))
    WHERE contains(pin, '==') AND NOT contains(pin, '/')"""
MODULES = "SELECT part[1] AS name, part[2] AS version, false AS is_dev FROM (SELECT string_split(trim(line), ' ') AS part FROM {0} WHERE trim(line) <> '' AND NOT starts_with(trim(line), '//')) WHERE NOT ends_with(part[2], '/go.mod')"


def in_files(lines: str) -> str:
    return f"(SELECT * FROM {sql(lines)} WHERE CAST(floor(pos / 40) AS BIGINT) % 8 NOT IN (0, 1))"


REQUIREMENTS, GO = packages("pypi", PINS.replace("{0}", sql("requirement_line"))), packages("golang", MODULES.replace("{0}", sql("go_sum_line")))
STATEMENTS = {
    "Cargo.lock": CARGO,
    "package-lock.json": f"{FLAT} UNION ALL {NESTED}",
    "yarn.lock": YARN,
    "Pipfile.lock": PIPFILE,
    "poetry.lock": POETRY,
    "requirements.txt": packages("pypi", PINS.replace("{0}", in_files("requirement_line"))),
    "go.sum": packages("golang", MODULES.replace("{0}", in_files("go_sum_line"))),
}
TOOLS = {
    "cargo": "comm IN ('cargo', 'rustc', 'rustdoc', 'clippy-driver')",
    "npm": "comm IN ('npm', 'node', 'yarn', 'pnpm', 'npx', 'corepack')",
    "pypi": "(starts_with(comm, 'pip') OR starts_with(comm, 'python') OR comm IN ('uv', 'hatch', 'pdm'))",
    "golang": "comm = 'go'",
}


def gate(ecosystem: str) -> str:
    return f"EXISTS (SELECT 1 FROM {sql('process')} WHERE {TOOLS[ecosystem]})"


def union(names=lockfiles.ORDER) -> str:
    return " UNION ALL ".join(f"SELECT *, {lockfiles.ORDER.index(n)} AS rank FROM ({STATEMENTS[n]}) WHERE {gate(lockfiles.ECOSYSTEM[n])}" for n in names)


def once(rows: str) -> str:
    return f"SELECT * EXCLUDE (rank, n) FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, name, version ORDER BY rank, purl, is_dev) AS n FROM ({rows})) WHERE n = 1"


DETECTED = once(f"SELECT * FROM ({union()}) WHERE NOT is_dev")


def locks(spark, sf_dir, *names):
    """Lock files of these bundle tables, or all."""
    out = None
    for name in names or ["lock_files"]:
        part = table(spark, sf_dir, name)
        out = part if out is None else out.unionByName(part)
    return out


def parser(name: str, statement: str, parse, bundle: str, file_name: str):
    @query(name, statement)
    def run(spark, sf_dir):
        return parse(lockfiles.found(table(spark, sf_dir, bundle), file_name))


parser("src_cargo_lock", CARGO, lockfiles.cargo, "cargo_lock", "Cargo.lock")
parser("src_npm_v2", FLAT, lockfiles.npm_flat, "package_lock", "package-lock.json")
parser("src_npm_v1", NESTED, lockfiles.npm_nested, "package_lock_v1", "package-lock.json")
parser("src_yarn_v1", YARN, lockfiles.yarn, "yarn_lock", "yarn.lock")
parser("src_pipfile", PIPFILE, lockfiles.pipfile, "pipfile_lock", "Pipfile.lock")
parser("src_poetry", POETRY, lockfiles.poetry, "poetry_lock", "poetry.lock")


@query("src_requirements", REQUIREMENTS)
def src_requirements(spark, sf_dir):
    return lockfiles.requirements(table(spark, sf_dir, "requirement_line"))


@query("src_go_sum", GO)
def src_go_sum(spark, sf_dir):
    return lockfiles.go_sum(table(spark, sf_dir, "go_sum_line"))


@query("rec_npm_v1", f"SELECT version, count(*) AS packages, count_if(is_dev) AS dev FROM ({NESTED}) GROUP BY version")
def rec_npm_v1(spark, sf_dir):
    rows = lockfiles.npm_nested(lockfiles.found(locks(spark, sf_dir, "package_lock_v1"), "package-lock.json"))
    return rows.groupBy("version").agg(F.count("*").alias("packages"), F.count_if("is_dev").alias("dev"))


DIRS = "CASE f % 8 WHEN 2 THEN 'app' || f || '/a/b/c/d/' ELSE 'app' || f || '/' END"


@query("src_lockfile_walk", f"SELECT DISTINCT {DIRS} || name AS rel_path FROM {PART}, (VALUES ('Cargo.lock'), ('poetry.lock'), ('yarn.lock')) t(name) WHERE {SEEN}")
def src_lockfile_walk(spark, sf_dir):
    """Lock files found in a folder of real files, by their paths alone."""
    root = new_folder(spark, "project")
    real_files.written(locks(spark, sf_dir, "cargo_lock", "poetry_lock", "yarn_lock"), root)
    return real_files.lock_files(spark, root).select("rel_path")


def gated(name: str, file_name: str, bundle: str):
    ecosystem = lockfiles.ECOSYSTEM[file_name]

    @query(name, f"SELECT * FROM ({STATEMENTS[file_name]}) WHERE {gate(ecosystem)}")
    def run(spark, sf_dir):
        rows = lockfiles.PARSERS[file_name](lockfiles.found(locks(spark, sf_dir, bundle), file_name))
        return lockfiles.gated(rows, table(spark, sf_dir, "process"), ecosystem)


gated("flt_eco_gate_cargo", "Cargo.lock", "cargo_lock")
gated("flt_eco_gate_npm", "yarn.lock", "yarn_lock")
gated("flt_eco_gate_python", "requirements.txt", "requirements")
gated("flt_eco_gate_go", "go.sum", "go_sum")


@query("agg_any_comm", " UNION ALL ".join(f"SELECT '{e}' AS ecosystem, {gate(e)} AS ran" for e in TOOLS))
def agg_any_comm(spark, sf_dir):
    """Whether any process of each ecosystem's tools ran, in one pass."""
    return lockfiles.tools_ran(table(spark, sf_dir, "process"))


@query("semi_eco_gate", f"SELECT * EXCLUDE (rank) FROM ({union()})")
def semi_eco_gate(spark, sf_dir):
    """Rows of every parser whose tools ran."""
    return lockfiles.parsed(locks(spark, sf_dir), table(spark, sf_dir, "process")).drop("rank")


@query("set_union_parsers", " UNION ALL ".join(STATEMENTS[n] for n in lockfiles.ORDER if lockfiles.ECOSYSTEM[n] in ("npm", "pypi")))
def set_union_parsers(spark, sf_dir):
    """All packages of npm and pypi, whichever parser they came from."""
    return lockfiles.parsed(locks(spark, sf_dir)).filter("ecosystem in ('npm', 'pypi')").drop("rank")


@query("flt_dev", f"SELECT * EXCLUDE (rank) FROM ({union()}) WHERE NOT is_dev")
def flt_dev(spark, sf_dir):
    return semi_eco_gate(spark, sf_dir).filter("NOT is_dev")


@query("agg_eco_dedup", DETECTED)
def agg_eco_dedup(spark, sf_dir):
    return lockfiles.detected(locks(spark, sf_dir), table(spark, sf_dir, "process"))


@query("set_union_ecosystems", once(union()))
def set_union_ecosystems(spark, sf_dir):
    """All ecosystems with development packages."""
    return lockfiles.detected(locks(spark, sf_dir), table(spark, sf_dir, "process"), True)
