"""Hand-derived cases of the path, version and lock-file rules."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import paths, versions
from cairn.operators import trace
from cairn.sources import lockfiles


def values(spark, column, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


RELEVANT = {
    "/proc/77/fd": False, "/sys/class/net": False, "socket:[9]": False, "": False, "/opt/tool/ld": False, "lib/engine.cpp": False,
    "/usr/lib/aarch64-linux-gnu/libz.so.1": True, "/usr/include/zlib.h": True, "./out/libbar.a": True, ".h": False, "/a/.c": False,
    "foo.": False, "x.sock": True, "a.so/": True, "a.h/.": True, "/tmp/a.so": False, "../tmp/a.so": True, "A.H": False, "x.hh": False,
    "libx.so.d/readme": False, "d.h/..": False, "/proc": False, "a.so/.c": False, ".so": True, "x.so.//./": True, "m.hxx": True,
}
NORMAL = {"/a/b/../c.h": "/a/c.h", "//a///b": "/a/b", "/a/": "/a", "/../x.so": "x.so", "/a/../../b": "b", "/..": "", "/": "/", "../../shared/./z.a": "/home/shared/z.a"}
SYSTEM = {"/usr/lib64/a.so": True, "/usr/libexec/a.so": True, "/usr/include/a.h": True, "/lib/a.so": True, "/usr/local/lib/a.so": False, "/lib32/a.so": False, "/lib": False, "lib/a.so": False}
ORCHESTRATOR = {"make": True, "python3.11": True, "bash5": True, "python-3": True, "cmake3": True, "gcc-12": False, "cc1": False, "": False, "3.11": False}


@pytest.mark.parametrize(
    "column, cases",
    [
        (paths.is_relevant, RELEVANT),
        (lambda x: paths.normalized(x, F.lit("/home/user/project")), NORMAL),
        (paths.is_system, SYSTEM),
        (paths.is_orchestrator, ORCHESTRATOR),
        (paths.soname_base, {"libz.a": "z.a", "config.h": "config.h", "lib.so": "", "libx.so.bak": "x"}),
        (paths.soname_version, {"libssl.so.3.0.0": "3.0.0", "libfoo-bar.so": None, "libx.so.bak": None, "libsong.so.1.so.2": "1.so.2"}),
        (paths.soname_name, {"libssl.so.3.0.0": "ssl", "libfoo-bar.so": "foo-bar", "lib.so": None}),
        (versions.from_dirname, {"zlib-1.3.1": "1.3.1", "a-1.2-3": "3", "a-1.2-rc1": None}),
        (versions.dirname_base, {"zlib-1.3.1": "zlib", "a-1.2-3": "a-1.2", "a-1.2-rc1": "a-1.2-rc1"}),
        (versions.from_revision, {"v1.3.1": "1.3.1", "vv2": "2", "main": None, "1.0-2": "1.0-2"}),
        (versions.from_archive, {"zlib-1.2.13.tar.gz": "1.2.13", "zlib-1.2.13.tgz": None}),
        (versions.yarn_name, {"express@^4.18.2": "express", "@babel/core@^7.0.0": "@babel/core", "none": None}),
        (lambda x: versions.purl("pypi", x, F.lit("1.0")), {"Foo__Bar.baz": "pkg:pypi/foo--bar-baz@1.0"}),
        (lambda x: versions.purl("npm", x, F.lit("1.0+b")), {"@babel/core": "pkg:npm/%40babel/core@1.0%2Bb"}),
    ],
)
def test_scalar_rules(spark, column, cases):
    assert dict(zip(cases, values(spark, column, list(cases)))) == cases


def test_system_purl(spark):
    row = spark.range(1).select(versions.system_purl(*[F.lit(x) for x in ("openssl", "3.0.2-0ubuntu1.18", "amd64")], F.lit(None).cast("string"), F.lit("ubuntu-22.04"))).first()
    assert row[0] == "pkg:deb/ubuntu/openssl@3.0.2-0ubuntu1.18?arch=amd64&distro=ubuntu-22.04"


def lines(spark, *text):
    return spark.createDataFrame([(i, x) for i, x in enumerate(text)], "pos int, line string")


def test_lock_lines(spark):
    got = lockfiles.requirements(lines(spark, "a==1.0 ; python_version>'3'", "b==1.0 # note", "c===1.0", "a>=1.0", "-r x.txt", "# c", "", "git/x==1"))
    assert sorted((r.name, r.version) for r in got.collect()) == [("a", "1.0"), ("b", "1.0 # note"), ("c", "=1.0")]
    got = lockfiles.go_sum(lines(spark, "m v1.0.0/go.mod h1:x", "m v2.0.0+incompatible h1:x", "// n", "", "alone"))
    assert [(r.version, r.purl) for r in got.collect()] == [("v2.0.0+incompatible", "pkg:golang/m@v2.0.0%2Bincompatible")]


def report(spark, files, pkg_file=(), pkg_meta=(), sub=()):
    table = spark.createDataFrame(
    [(*f, *([None] * (3 - len(f)))) if len(f) < 3 else f for f in [(p, p, f"sha256:{i}") if isinstance(p, str) else p for i, p in enumerate(files)]], "path string, canonical string, hash string")
    rows = trace.components(table, spark.createDataFrame(list(pkg_file), "path string, pkg_key string, pos long"), spark.createDataFrame(list(pkg_meta), "pkg_key string, version string, src_name string, pos long"), spark.createDataFrame(list(sub), "dirname string, name string, version string, url string"))
    return {r.path: r for r in trace.first_of_key(rows).collect()}


def test_one_component_a_key(spark):
    got = report(spark, ["/usr/lib/a.so", "/usr/lib/b.so"], [("/usr/lib/a.so", "p:amd64", 1), ("/usr/lib/b.so", "p:i386", 1)], [("p:amd64", "1", "src", 1)])
    assert [(r.name, r.version, r.arch, r.src_name, r.type) for r in got.values()] == [("p", "1", "amd64", "src", "system_package")]
    assert len(report(spark, ["/usr/lib/libq.so.1", "/usr/lib/libq.so.2"])) == 1
    got = report(spark, ["/usr/lib/libq.so", "/usr/lib/other.a"], [("/usr/lib/other.a", "q", 1)])
    assert [(r.type, r.version) for r in got.values()] == [("system_package", "unknown")]
    got = report(spark, [("/lib/libc.so.6", "/usr/lib/libc.so.6", None)], [("/usr/lib/libc.so.6", "libc6:amd64", 1)])
    assert got["/lib/libc.so.6"].name == "libc6"


def test_local_files(spark):
    got = report(spark, ["/p/subprojects/zlib-1.3.1/a.h", "/p/subprojects/zlib-1.3.1/b.h", "/p/inc/x.h", "/p/libm.so.2.4", ("/p/u.a", "/p/u.a", None)])
    assert {(r.name, r.version) for r in got.values()} == {("zlib", "1.3.1"), ("m", "2.4"), ("u", None)}
    assert got["/p/u.a"].hash == "sha256:error"
    indexed = report(spark, ["/p/subprojects/none/subprojects/zz/a.h"], sub=[("zz", "wrapped", "9", "https://x")])
    assert [(r.name, r.version, r.vcs_url) for r in indexed.values()] == [("wrapped", "9", "https://x")]
    inner = report(spark, ["/p/subprojects/subprojects/zz/a.h", "/p/subprojects/subprojects/b-2.1/c.h"], sub=[("zz", "wrapped", "9", "https://x")])
    assert {(r.name, r.version) for r in inner.values()} == {("wrapped", "9"), ("subprojects", None)}


@pytest.mark.parametrize("small", [trace.SMALL, 0])
def test_descendants(spark, small):
    def descended(spark, edges):
        return {r.pid: r.depth for r in trace.descendants(spark.createDataFrame(edges, "parent_pid long, child_pid long"), 1, small).collect()}

    assert descended(spark, [(1, 2), (2, 3), (3, 4), (9, 10), (5, 5), (None, 7)]) == {1: 0, 2: 1, 3: 2, 4: 3}
    assert descended(spark, [(7, 8)]) == {1: 0} and descended(spark, []) == {1: 0}
    chain = [(i, i + 1) for i in range(1, 501)]
    assert descended(spark, chain) == {i: i - 1 for i in range(1, 502)}
    # Reused ids: several parents, cycles on and off the tree, a way back to the root.
    edges = [(1, 2), (2, 3), (3, 2), (3, 4), (1, 4), (4, 5), (20, 21), (21, 20), (21, 22), (5, 1), (5, 6), (9, 6), (6, 7), (2, 7)]
    assert descended(spark, edges) == {1: 0, 2: 1, 3: 2, 4: 1, 5: 2, 6: 3, 7: 2}


def test_plans_of_the_trace_stay_in_the_jvm(spark):
    """No Python but for TOML, no cross join, and generated code that isn't too large to compile."""
    import __spark_entry__

    queries = __spark_entry__.queries()
    for name in ("agg_component_dedup", "agg_distinct_paths", "set_union_report"):
        frame = queries[name](spark, "/root/testdata/sf0.001")
        plan = frame._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))
        assert name == "set_union_report" or not any(x in plan for x in ("Python", "Arrow"))
        assert frame.count() > 50
    stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(queries["agg_distinct_paths"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan())
    assert all(stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.size()))
