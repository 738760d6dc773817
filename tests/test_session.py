"""A captured build, from flat records and real files to both documents."""

import hashlib
import json
import os

from cairn.jobs import session

PROJECT = "/home/u/proj"
FILES = {
    "/usr/lib/libz.so.1.3": b"z", "/usr/include/zlib.h": b"h", "/usr/lib/libown.so.2": b"own", f"{PROJECT}/libm.so.2.4": b"m", f"{PROJECT}/inc/local.h": b"l", f"{PROJECT}/empty.a": b"", f"{PROJECT}/subprojects/png-1.6/png.h": b"p", f"{PROJECT}/subprojects/w/w.c": b"w",
    f"{PROJECT}/subprojects/w.wrap": b"[wrap-git]\nurl = https://w.example\nrevision = main\n", f"{PROJECT}/subprojects/w/.git/HEAD": b"ref: refs/heads/main\n", f"{PROJECT}/subprojects/w/.git/refs/heads/main": b"0123456789abcdef" * 3 + b"\n",
    f"{PROJECT}/package-lock.json": json.dumps({"lockfileVersion": 3, "packages": {"": {}, "node_modules/@s/a": {"version": "1.0"}, "node_modules/d": {"version": "2", "dev": True}}}).encode(), f"{PROJECT}/node_modules/x/yarn.lock": b'y@1:\n  version "1"\n', f"{PROJECT}/sub/go.sum": b"m v1 h1:x\n",
}
OPENED = [
    (10, "/usr/lib/libz.so.1"), (10, "/usr/include/zlib.h"), (10, "/lib/libown.so.2"), (10, "libm.so.2.4"), (10, "inc/local.h"), (11, "../empty.a"), (10, "subprojects/png-1.6/png.h"), (10, "subprojects/w/w.c"), (10, "gone.so"), (10, "/proc/self/maps.so"),
    (12, "by-make.a"), (99, "libm.so.2.4"), (10, "/round/x.so"),
]


def record(pid, name, kind=0):
    return pid.to_bytes(4, "little") + len(name).to_bytes(4, "little") + bytes([kind, 0, 0, 0]) + name.encode().ljust(256, b"\0")


def captured(spark, tmp_path):
    root = tmp_path / "machine"
    for path, content in (FILES | {f"{PROJECT}/by-make.a": b"made"}).items():
        at = root / path.lstrip("/")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)
    os.symlink("libz.so.1.3", root / "usr/lib/libz.so.1")
    os.symlink("usr/lib", root / "lib")
    (tmp_path / "trace").mkdir()
    (tmp_path / "trace/cpu0").write_bytes(b"".join(record(p, n) for p, n in OPENED[:6]) + record(10, "", 1))
    (tmp_path / "trace/cpu1").write_bytes(b"".join(record(p, n) for p, n in OPENED[6:]) + b"torn")
    facts = [(10, "comm", "cc1\n", 1), (11, "comm", "ld\n", 1), (12, "comm", "make\n", 1), (13, "comm", "node\n", 1), (10, "cwd", PROJECT, 1), (11, "cwd", f"{PROJECT}/inc", 2)]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    return session.Capture(
        trace=str(tmp_path / "trace"), root=str(root), project=PROJECT, command="make all", timestamp="2026-01-01T00:00:00+00:00", exit_code=0,
        facts=table(facts, "pid long, kind string, content string, seq long"), links=table([("/usr/lib/libz.so.1", "libz.so.1.3"), ("/lib", "usr/lib")], "path string, target string"),
        status=table([(0, "status", "Package: zlib1g\nArchitecture: amd64\nVersion: 1:1.3\nSource: zlib\n\nPackage: zlib1g-dev\nVersion: 1:1.3\n")], "pos long, file_name string, content string"),
        lists=table([(0, "zlib1g:amd64.list", "/usr/lib/libz.so.1.3\n"), (1, "zlib1g-dev.list", "/usr/include/zlib.h\n")], "pos long, file_name string, content string"),
        release=table([(0, 'ID=debian\nVERSION_ID="12"\n')], "pos long, content string"),
    )


def document(folder):
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
    return json.loads("".join(open(f"{folder}/{p}").read() for p in parts))


def test_from_trace_to_documents(spark, tmp_path):
    capture = captured(spark, tmp_path)
    rows = session.run(spark, capture, str(tmp_path / "out"))
    sha = lambda path: "sha256:" + hashlib.sha256(FILES[path]).hexdigest()
    got = {r.path: (r.type, r.name, r.version, r.hash) for r in rows.collect()}
    # Headers of the project itself are none of its parts; what make opened isn't looked at.
    assert got == {
        "/usr/lib/libz.so.1": ("system_package", "zlib1g", "1:1.3", None), "/usr/include/zlib.h": ("system_package", "zlib1g-dev", "1:1.3", None), "/lib/libown.so.2": ("system_unknown", "libown.so.2", None, None),
        f"{PROJECT}/libm.so.2.4": ("local_file", "m", "2.4", sha(f"{PROJECT}/libm.so.2.4")), f"{PROJECT}/subprojects/png-1.6/png.h": ("local_file", "png", "1.6", sha(f"{PROJECT}/subprojects/png-1.6/png.h")),
        f"{PROJECT}/subprojects/w/w.c": ("local_file", "w", "0123456789ab", sha(f"{PROJECT}/subprojects/w/w.c")), "ecosystem:npm": ("ecosystem_package", "@s/a", "1.0", None),
        f"{PROJECT}/empty.a": ("local_file", "empty", None, sha(f"{PROJECT}/empty.a")),
    }
    report, bom = (document(tmp_path / "out" / x) for x in ("report", "bom"))
    assert [c["component_type"] for c in report["components"]] == sorted(c["component_type"] for c in report["components"]) and len(report["components"]) == len(got)
    assert (report["exit_code"], report["project_dir"], report["build_command"]) == (0, PROJECT, "make all")
    assert [c.get("bom-ref") for c in bom["components"]][:2] == ["os-component", "pkg:npm/%40s/a@1.0"]
    assert "pkg:deb/debian/zlib1g@1%3A1.3?arch=amd64&distro=debian-12&upstream=zlib" in {c["purl"] for c in bom["components"] if "purl" in c}


def test_options(spark, tmp_path):
    rows = session.components(spark, captured(spark, tmp_path), include_orchestrators=True, include_dev=True).collect()
    assert f"{PROJECT}/by-make.a" in {r.path for r in rows} and {r.name for r in rows if r.type == "ecosystem_package"} == {"@s/a", "d"}
