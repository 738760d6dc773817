"""Hand-derived cases of lock files, package database, wraps, event records and documents."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cairn.operators import report
from cairn.sources import lockfiles, packages, wraps
from cairn.sources.store import stage


def files(spark, *content):
    rows = [(f"p{i}/x.lock", c) for i, c in enumerate(content)]
    return spark.createDataFrame(rows, "rel_path string, content string")


def pins(frame):
    return sorted((r.name, r.version, r.is_dev) for r in frame.collect())


def test_toml(spark):
    lock = '[[package]]\nname = "a"\nversion = "1+b"\nsource = "registry+x"\n[[package]]\nname = "b"\nversion = "2"\n[[package]]\nname = "c"\nversion = "3"\nsource = "sparse+x"\n'
    rows = lockfiles.cargo(files(spark, lock, lock + "[[", None, "", '[[package]]\nname = "d"\nsource = "git+x"\n', 'package = 5')).collect()
    assert [(r.name, r.purl) for r in rows] == [("a", "pkg:cargo/a@1%2Bb")]
    part = '[[package]]\nname = "{}"\nversion = "1"\n{}\n'
    kinds = {"a": 'groups = ["dev", "test"]', "b": 'groups = ["main", "dev"]', "c": "groups = []", "d": 'category = "dev"', "e": 'category = "main"'}
    rows = lockfiles.poetry(files(spark, "".join(part.format(k, v) for k, v in kinds.items())))
    assert {r.name: r.is_dev for r in rows.collect()} == {"a": True, "b": False, "c": False, "d": True, "e": False}


def test_npm(spark):
    flat = {"lockfileVersion": 3, "packages": {"": {"version": "0"}, "node_modules/a/node_modules/b": {"version": "1", "dev": True}, "lib": {"version": "2", "dev": "yes"}, "node_modules/n": {"version": 5}, "node_modules/l": {"link": True}}}
    nested = {"dependencies": {"a": {"version": "1", "dependencies": {"b": {"dev": True, "version": "2", "dependencies": {"c": {"version": "3"}}}}}, "gone": {"dependencies": {"d": {"version": "4"}}}}}
    texts = [json.dumps(x) for x in (flat, nested, {"lockfileVersion": "3", "packages": {"x": {"version": "9"}}}, [1], {"packages": 3, "lockfileVersion": 2})] + ["{", None, json.dumps(flat) + "[[{"]
    table = files(spark, *texts)
    assert pins(lockfiles.npm_flat(table)) == [("a/node_modules/b", "1", True), ("lib", "2", False)]
    assert pins(lockfiles.npm_nested(table)) == [("a", "1", False), ("b", "2", True), ("c", "3", False)]


def test_yarn_and_pipfile(spark):
    lock = '# yarn lockfile v1\n\nlodash@^4.0:\n  version "4.17"\n  version "5"\n\n"@s/x@^1", "@s/x@^2":\r\n  resolved "y"\r\n  version "1.5"\r\n\nplain:\n  version "1"\n\nq@*:\n  version: 1\nr@1:\n  # note\n  version 2\n\n  version "3"\n'
    assert pins(lockfiles.yarn(files(spark, lock, None))) == [("@s/x", "1.5", False), ("lodash", "4.17", False), ("r", "2", False)]
    lock = {"_meta": {}, "default": {"Flask": {"version": "==2.0"}, "odd": {"version": "=====1"}, "no": {"version": 3}}, "develop": {"black": {"version": "==23"}}}
    assert pins(lockfiles.pipfile(files(spark, json.dumps(lock)))) == [("Flask", "2.0", False), ("black", "23", True), ("odd", "=1", False)]


def test_of_equal_keys_the_last_counts(spark):
    text = '{"lockfileVersion": 1, "lockfileVersion": 2, "packages": {"a": {"version": "1"}, "a": {"version": "2", "version": "3"}}, "dependencies": {"b": {"version": "4", "dependencies": {"c": {"version": "5"}, "c": {"version": "6"}}}}}'
    assert pins(lockfiles.npm_flat(files(spark, text))) == [("a", "3", False)]
    nested = text.replace('"lockfileVersion": 2, ', "")
    assert pins(lockfiles.npm_nested(files(spark, nested))) == [("b", "4", False), ("c", "6", False)]
    assert pins(lockfiles.pipfile(files(spark, '{"default": {"x": {"version": "==1"}}, "default": {"y": {"version": "==2"}, "y": {"version": "==3"}}}'))) == [("y", "3", False)]
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_walk_gates_and_detection(spark):
    names = ["go.sum", "a/b/c/d/e/go.sum", "a/b/c/d/e/f/go.sum", "x/vendor/go.sum", "go.sum/x", "vendors/go.sum"]
    table = spark.createDataFrame([(n, "m v1 h1:x\nm v2/go.mod h1:y\n") for n in names], "rel_path string, content string")
    assert sorted(r.rel_path for r in lockfiles.found(table, "go.sum").collect()) == ["a/b/c/d/e/go.sum", "go.sum", "vendors/go.sum"]
    ran = lambda *comms: spark.createDataFrame([(c,) for c in comms], "comm string")
    assert lockfiles.detected(table, ran("python3.11", "gopls")).count() == 0
    assert pins(lockfiles.detected(table, ran("go"))) == [("m", "v1", False)]
    assert [lockfiles.gated(table, ran(c), "pypi").count() > 0 for c in ("pip3", "python3.11", "uv", "uvx", "")] == [True, True, True, False, False]
    both = spark.createDataFrame([("package-lock.json", '{"lockfileVersion": 2, "packages": {"d": {"version": "1", "dev": true}}}'), ("yarn.lock", 'd@1:\n  version "1"\n')], "rel_path string, content string")
    assert pins(lockfiles.detected(both, ran("npm"))) == [("d", "1", False)]
    assert pins(lockfiles.detected(both, ran("npm"), True)) == [("d", "1", True)]


def test_package_database(spark):
    text = "Package: a\nStatus: deinstall\nArchitecture: amd64\nVersion: 1:2\nSource: src (3)\n\nPackage: b\nArchitecture: all\nVersion: 1\nSource: b\n\nPackage: c\n\nVersion: 9\n\n\nPackage: b\nVersion: 2"
    table = spark.createDataFrame([(1, "status", text)], "pos long, file_name string, content string")
    assert sorted(map(tuple, packages.package_meta(table).collect())) == [("a:amd64", "1:2", "src"), ("b", "2", None)]
    lists = spark.createDataFrame([(1, "a:amd64.list", "/.\n/usr\n/usr/a\nrel\n"), (2, "b.list", "/usr\n"), (3, "c.md5sums", "/usr\n"), (4, ".list", "/x")], "pos long, file_name string, content string")
    assert sorted(map(tuple, packages.package_files(lists).collect())) == [("/usr", "b"), ("/usr/a", "a:amd64")]


@pytest.mark.parametrize("text, want", [('ID=debian\nVERSION_ID="12"\n', "debian-12"), ("ID=arch", "arch"), ("", "linux"), ('A="x=y"\nVERSION_ID=""\nID="u"', "u")])
def test_distro(spark, text, want):
    table = spark.createDataFrame([(0, text)], "pos long, content string")
    assert packages.distro(packages.os_release(table)).collect() == [(want,)]


def test_wraps(spark):
    h = "0123456789abcdef" * 3
    table = spark.createDataFrame(
        [
            (1, "a.wrap", "[wrap-git]\nurl = u\nrevision = v2.1\nurl = w\n"),
            (2, "b.wrap", "directory = b-1.5\n#url = n\n[wrap-file]\nsource_filename = b.tgz\n"),
            (3, "c.wrap", "[wrap-redirect]\nfilename = d/subprojects/c.wrap\n"),
            (4, "d/subprojects/c.wrap", "[wrap-git]\nrevision = HEAD\n"),
            (5, "e.wrap", "[wrap-redirect]\nfilename = none.wrap\n"),
            (6, "f.wrap", "[wrap-git]\ndirectory = b-1.5\nrevision = 7\n"),
            (7, "g.wrap", ""),
        ],
        "pos long, wrap_path string, content string",
    )
    heads = spark.createDataFrame([("c", "HEAD", "ref: refs/heads/m\n"), ("c", "refs/heads/m", h + "\n"), ("g", "HEAD", h.upper()), ("a", "HEAD", "short")], "dirname string, name string, content string")
    got = {r.dirname: (r.name, r.version, r.url) for r in wraps.index(table, heads).collect()}
    assert got == {"a": ("a", "2.1", "w"), "b-1.5": ("f", "7", None), "c": ("c", h[:12], None), "g": ("g", h[:12].upper(), None)}


def test_event_records(spark):
    def record(pid, name, kind=0, size=None):
        return pid.to_bytes(4, "little") + (len(name) if size is None else size).to_bytes(4, "little") + bytes([kind, 9, 9, 9]) + name.ljust(256, b"\0")

    rows = [record(4_000_000_000, b"/a/\xffb"), record(2, b"x", 1), record(3, b"", 0), record(4, b"/c\0\0", 7), record(5, b"/d", 0, 4_000_000_000), record(6, b"/cut", 0, 2), b"short", record(7, b"/e") + b"more"]
    decoded = packages.events(spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(rows)], "seq long, record binary"))
    assert [tuple(r) for r in packages.opens(decoded).orderBy("seq").collect()] == [(0, 4_000_000_000, "/a/�b"), (3, 4, "/c"), (4, 5, "/d"), (5, 6, "/c"), (7, 7, "/e")]
    assert [r.pid for r in decoded.filter("is_fork").collect()] == [2] and decoded.count() == 7
    status = spark.createDataFrame([(1, "Name: a\nPPid:\t12\nTracerPid: 3"), (2, "Name: PPid: 4")], "pid long, status string")
    assert [tuple(r) for r in packages.parent_of(status).orderBy("pid").collect()] == [(1, 12), (2, None)]


COMPONENT = "name string, version string, arch string, src_name string, hash string, purl string, vcs_url string, path string, type string"


@pytest.mark.parametrize("exit_code", [0, None])
def test_documents_are_json(spark, exit_code):
    rows = [("z", "1", "amd64", None, None, None, None, "/usr/lib/z", "system_package"), ('q"\n', None, None, None, "sha256:ab", None, "u", "/p/q", "local_file"), ("b", "2", None, None, None, "pkg:npm/b@2", None, "ecosystem:npm", "ecosystem_package"), ("u", None, None, None, None, None, None, "/lib/u", "system_unknown")]
    table = stage(spark.createDataFrame(rows, COMPONENT).repartition(3))
    when, command, directory = F.lit("2026-01-01T00:00:00+00:00"), F.lit('make "x"'), F.lit("/home/u/proj/")
    made = report.report_document(table, when, command, directory, F.lit(exit_code).cast("int"))
    got = json.loads("".join(r.line for r in made.collect()))
    assert (got["exit_code"], got["build_command"]) == (exit_code, 'make "x"')
    assert [(c["component_type"], c["name"]) for c in got["components"]] == [("ecosystem_package", "b"), ("local_file", 'q"\n'), ("system_package", "z"), ("system_unknown", "u")]
    assert "version" not in got["components"][1]
    bom = report.with_system(report.bom_rows(table, F.lit("ubuntu-24.04")), F.lit("ubuntu-24.04"))
    got = json.loads("".join(r.line for r in report.bom_document(bom, when, directory, "cairn", "1").collect()))
    assert got["specVersion"] == "1.6" and got["metadata"]["component"]["name"] == "proj"
    assert [c.get("bom-ref") for c in got["components"]] == ["os-component", "pkg:npm/b@2", 'pkg:generic/q"\n@sha256%3Aab', "pkg:deb/ubuntu/z@1?arch=amd64&distro=ubuntu-24.04", None]
    assert got["components"][2]["hashes"] == [{"alg": "SHA-256", "content": "ab"}] and "hashes" not in got["components"][3]
    empty = json.loads("".join(r.line for r in report.report_document(table.limit(0), when, command, directory, F.lit(1)).collect()))
    assert empty["components"] == []


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
