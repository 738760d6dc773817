"""Symlink closure against the system's own, real files, and reports in one evaluation."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import links, report, trace
from cairn.sources import files


def tree(root, seed):
    """A folder with directories and links of all kinds; its links as (path, target) and paths to look up, all below /."""
    rng, made = random.Random(seed), []
    dirs = [root]
    for i in range(12):
        dirs.append(os.path.join(rng.choice(dirs), f"d{i}"))
        os.makedirs(dirs[-1])
    for i in range(30):
        at = os.path.join(rng.choice(dirs), f"l{i}")
        goal = rng.choice(dirs + [m[0] for m in made] or dirs)
        target = rng.choice([goal, os.path.relpath(goal, os.path.dirname(at)), os.path.relpath(goal, os.path.dirname(at)) + "/../" + os.path.basename(rng.choice(dirs)), "./" + os.path.relpath(goal, os.path.dirname(at)), f"l{rng.randrange(40)}", "//" + goal.lstrip("/") + "/."])
        os.symlink(target, at)
        made.append((at, target))
    made += [(f"{root}/r{i}", f"r{1 - i}") for i in range(2)]
    for at, target in made[-2:]:
        os.symlink(target, at)
    ends = [m[0] for m in made] + dirs
    paths = {f"{rng.choice(ends)}/{rng.choice(['', 'x.so', *[os.path.basename(e) for e in ends]])}".rstrip("/") for _ in range(150)} | {m[0] for m in made}
    return made, sorted(paths)


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, target string")


def real(path):
    """What the system says: the canonical path, whatever is missing at its end, or None where links go round."""
    try:
        return os.path.realpath(path, strict=True)
    except FileNotFoundError:
        return os.path.realpath(path)
    except NotADirectoryError:
        return os.path.realpath(path)
    except OSError:
        return None


def test_links_as_the_system_follows_them(spark, tmp_path):
    made, paths = [], []
    for seed in range(3):
        root = str(tmp_path / f"t{seed}")
        os.makedirs(root)
        one, two = tree(root, seed)
        made, paths = made + one, paths + two
    rows = spark.createDataFrame([(p,) for p in [*paths, paths[0]]], "path string")
    got = links.canonical(rows, table(spark, made)).collect()
    assert len(got) == len(paths) + 1
    assert {r.path: r.canonical for r in got} == {p: real(p) for p in paths}
    assert any(r.error for r in got) and all((r.error is None) == (r.canonical is not None) for r in got)


def test_limit_and_chains(spark):
    made = [(f"/c{i}", f"c{i + 1}") for i in range(60)] + [("/round", "round"), ("/a", "b/x"), ("/b", "/a"), ("/up", "../../etc"), ("/empty", "")]
    paths = ["/c60/f", "/c20/f", "/c19/f", "/c59", "/round/x", "/a/y", "/b", "/up/z", "/plain//./q", "/", "/empty/x", None]
    got = {r.path: (r.canonical, r.followed, r.error) for r in links.canonical(spark.createDataFrame([(p,) for p in paths], "path string"), table(spark, made)).collect()}
    over = (None, None, "too many links")
    assert got == {
        "/c60/f": ("/c60/f", 0, None), "/c20/f": ("/c60/f", 40, None), "/c19/f": over, "/c59": ("/c60", 1, None), "/round/x": over, "/a/y": over, "/b": over,
        "/up/z": ("/etc/z", 1, None), "/plain//./q": ("/plain/q", 0, None), "/": ("/", 0, None), "/empty/x": ("/empty/x", 0, None), None: (None, None, None),
    }
    none = table(spark, [])
    assert [r.canonical for r in links.canonical(spark.createDataFrame([("/a/b",)], "path string"), none).collect()] == ["/a/b"]
    assert links.canonical(spark.createDataFrame([], "path string"), table(spark, made)).count() == 0


@pytest.fixture
def project(tmp_path):
    texts = {"a.so": b"one", "sub dir/b+c%20.h": b"h", "big.bin": b"x" * 300_000, "damaged.a": b"d", "go.sum": b"m v1 h1:x\n", "a/b/c/d/e/go.sum": b"deep", "a/b/c/d/e/f/go.sum": b"deeper", "node_modules/yarn.lock": b"no", "x/Cargo.lock": b"\xff\xfe"}
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text)
    (tmp_path / ".damaged.a.crc").write_bytes(b"crc\0" + (512).to_bytes(4, "big") + bytes(4))
    return str(tmp_path), texts


def test_hashes_of_files(spark, project):
    root, texts = project
    want = {p: "sha256:" + hashlib.sha256(t).hexdigest() for p, t in texts.items()} | {"damaged.a": files.ERROR}
    for path, whole in ((root, files.WHOLE), (f"file://{root}/", 1000)):
        assert {r.rel_path: r.hash for r in files.hashes(spark, path, whole=whole).collect()} == want


def test_hashes_by_path(spark, project):
    root, texts = project
    empty = os.path.join(root, "empty.h")
    open(empty, "w").close()
    paths = spark.createDataFrame([(f"{root}/a.so",), (empty,), (f"file://{root}/go.sum",), (f"{root}/none",), (f"{root}/a/b",), (None,), (empty,)], "path string").repartition(3)
    sha = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    want = [(f"{root}/a.so", sha(b"one")), (empty, sha(b"")), (empty, sha(b"")), (f"file://{root}/go.sum", sha(texts["go.sum"])), (f"{root}/a/b", files.ERROR)]
    assert sorted(map(tuple, files.hashed(paths).collect())) == sorted(want)


def test_only_wanted_files_are_opened(spark, project):
    root, texts = project
    chosen = files.hashes(spark, root, F.col("rel_path").rlike("[.](h|bin)$"))
    assert {r.rel_path for r in chosen.collect()} == {"sub dir/b+c%20.h", "big.bin"}
    metrics = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "file_path" in metrics


def test_walk(spark, project, tmp_path):
    root, texts = project
    for path in ("_deps/go.sum", ".hidden/go.sum", "empty/yarn.lock", "vendor/x/go.sum"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("" if path.startswith("empty") else "n v2 h1:y\n")
    os.symlink("_deps", f"{root}/again")
    every = {r.rel_path: r.length for r in files.walk(spark, root, 9, ()).collect()}
    assert every == {p: len(t) for p, t in texts.items()} | {"_deps/go.sum": 10, ".hidden/go.sum": 10, "empty/yarn.lock": 0, "vendor/x/go.sum": 10, "again/go.sum": 10, ".damaged.a.crc": 12}
    found = {r.rel_path: r.content for r in files.lock_files(spark, f"file://{root}").collect()}
    assert found == {"go.sum": "m v1 h1:x\n", "a/b/c/d/e/go.sum": "deep", "x/Cargo.lock": None, "_deps/go.sum": "n v2 h1:y\n", ".hidden/go.sum": "n v2 h1:y\n", "again/go.sum": "n v2 h1:y\n", "empty/yarn.lock": ""}
    assert files.walk(spark, f"{root}/nowhere").count() == 0


COMPONENT = "name string, version string, arch string, src_name string, hash string, purl string, vcs_url string, path string, type string"


def components(spark, n):
    kinds = (trace.ECOSYSTEM, trace.LOCAL, trace.SYSTEM, trace.UNKNOWN)
    rows = [(f"n{i * 7 % 50}", None if i % 3 == 0 else f"{i % 5}", None, None, None, None, None, f"/p/{i}", kinds[0 if i % 10 else i % 4]) for i in range(n)]
    return spark.createDataFrame(rows, COMPONENT).repartition(5)


def test_places_without_a_window_over_components(spark):
    rows = components(spark, 700)
    got = report.numbered(rows).collect()
    want, seen = sorted(rows.collect(), key=lambda r: (r.type, r.name, r.version is not None, r.version or "", r.path)), {}
    for r in want:
        seen[r.type] = seen.get(r.type, 0) + 1
        assert next(x.place for x in got if x.path == r.path) == seen[r.type]
    assert len(got) == 700 and report.numbered(rows.limit(0)).count() == 0


def test_reports_scan_what_components_scan_once(spark):
    """Printed plans, reuse not deducted: few scans, and no second evaluation for the documents."""
    import __spark_entry__

    queries = __spark_entry__.queries()
    scans = lambda name: queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    assert scans("report_components") < 25
    assert scans("snk_report_json") <= 4 and scans("snk_cdx") <= 4
