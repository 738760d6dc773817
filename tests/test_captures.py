"""Captured answers, syscall lines, layouts, flat trace files, resumable intake and stalls."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import syscalls
from cairn.sources import layouts, owners, packages, tracefile, wraps
from cairn.streaming import ingest, resume, watchdog

ALL = "ffffffffffffffff"
LINES = {
    "61 0xffffffffffffffff": "wait4(pid=-1)", "61 0x10": "wait4(pid=16)", "247 0x1 0x80000000 9": "waitid(id=2147483648)", "7 0x1 0x3 0x3e8": "poll(nfds=3, timeout=1000ms)", f"7 0x1 0x{ALL} 0x8000000000000000": "poll(nfds=18446744073709551615, timeout=∞)",
    "7": "poll(nfds=0, timeout=0ms)", "271 1 2 0x0": "ppoll(nfds=2, timeout=∞)", "271 1 2 0x7f": "ppoll(nfds=2)", "23 0xA": "select(nfds=10)", "270 5 0 0 0 0": "pselect6(nfds=5, timeout=∞)", "270 5 0 0 0 1": "pselect6(nfds=5)",
    "232 1 2 3 0x0": "epoll_wait(timeout=0ms)", f"281 1 2 3 {ALL}": "epoll_wait(timeout=∞)", "441 1 2 3 64": "epoll_wait(timeout=100ms)", "202 1 0x189 3": "futex(op=0x189)", "202": "futex(op=0x0)", "0 0x3": "read(fd=3)", "35": "nanosleep", "230 x": "nanosleep",
    "999 0x1": "syscall#999", "0x3e7": "syscall#999", "3d": "syscall#61", "": "running", "running": "running", "   ": "   ", "zz": "syscall#18446744073709551615", "-1 0x0": "syscall#18446744073709551615", "0061 7": "wait4(pid=7)", "+23 1": "select(nfds=1)",
    "18446744073709551615": "syscall#18446744073709551615", "99999999999999999999": "syscall#18446744073709551615", "0 0x10000000000000000": "read(fd=0)", "0 zz": "read(fd=0)", "0 0x0x3": "read(fd=3)", "0\t0x3  4": "read(fd=3)",
}


def test_syscall_lines(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*LINES, None])], "i int, x string")
    got = [r.said for r in syscalls.with_decoded(rows, "x", "said").orderBy("i").collect()]
    # "3d" is no decimal number, so it is read as a hexadecimal one: 61, which is a call with a form.
    want = LINES | {"3d": "wait4(pid=0)"}
    assert dict(zip(LINES, got)) == want and got[-1] == "running"


ANSWERS = [
    ("dpkg", "/a", True, "diversion by d from: /a\n  diversion by d to: /b\nliba:amd64: /a\nother: /a\n"), ("dpkg", "/b", True, "diversion by x from: /b\n"), ("dpkg", "/c", False, "libc: /c"), ("dpkg", "/d", True, "libd: /d\r\n"), ("dpkg", "/e", True, ""), ("dpkg", "/e2", True, None),
    ("pacman", "/b", True, "/b is owned by pb 1.0-1\n"), ("pacman", "/c", True, "/c is owned by"), ("pacman", "/a", True, "/a is owned by pa 9-9"), ("pacman", "/e", None, "/e is owned by x 1"),
    ("rpm", "/c", True, " rc 2-3 x\n"), ("rpm", "/e", True, "re\n"), ("rpm", "/f", False, "rf 1"), ("apk", "/f", True, "f 1"),
]


def test_owners_by_the_first_manager_that_answers(spark):
    answers = spark.createDataFrame(ANSWERS, "manager string, path string, ok boolean, stdout string")
    versions = spark.createDataFrame([("liba:amd64", True, " 1:2-3\n"), ("libd", False, "9")], "pkg_key string, ok boolean, stdout string")
    got = {r.path: (r.manager, r.name, r.version, r.arch) for r in owners.owners(answers, versions).collect()}
    assert got == {"/a": ("dpkg", "liba", "1:2-3", "amd64"), "/b": ("pacman", "pb", "1.0-1", None), "/c": ("rpm", "rc", "2-3 x", None), "/d": ("dpkg", "libd", "unknown", None), "/e": ("rpm", "re", "unknown", None)}
    assert owners.owners(answers.limit(0), versions.limit(0)).count() == 0


@pytest.mark.parametrize("rows, want", [([("rpm", True), ("pacman", True), ("dpkg", False)], "pacman"), ([("apk", True), ("rpm", None)], "none"), ([], "none"), ([("rpm", True)], "rpm")])
def test_detected_manager(spark, rows, want):
    assert owners.detected(spark.createDataFrame(rows, "manager string, ok boolean")).collect() == [(want,)]


FORK = "name: x\nformat:\n\tfield:unsigned short common_type;\toffset:0;\tsize:2;\tsigned:0;\n\n\tfield:pid_t child_pid;\toffset:20;\tsize:4;\tsigned:1;\r\n\tfield:u64 big;\toffset:24;\tsize:8;\tsigned:0;\n"
OPEN = "    field:const char * filename;    offset: 16 ;    size:8;    signed:0;\n field:int nope;  size:4;\n field:int odd;  offset:x;  size:4;\n"


def test_layouts(spark):
    texts = spark.createDataFrame([("h", "fork", 0, None), ("h", "fork", 1, FORK), ("h", "fork", 2, FORK.replace("20", "99")), ("h", "open", 0, OPEN), ("g", "fork", 0, "")], "host string, event string, rank int, content string")
    fields = [("fork", "child_pid"), ("fork", "big"), ("open", "filename"), ("open", "nope"), ("open", "odd"), ("fork", "common_type")]
    wanted = spark.createDataFrame([(h, e, f, 40, 4, 1) for h in "hgf" for e, f in fields], "host string, event string, field string, offset int, size int, signed int")
    found = layouts.layout(texts, wanted)
    got = {(r.host, r.field): (r.offset, r.size, r.signed, r.warning) for r in found.collect()}
    missing, none = (40, 4, True, "field not found"), (40, 4, True, "format file not found")
    assert {f: got["h", f] for _, f in fields} == {"child_pid": (20, 4, True, None), "big": (24, 8, False, None), "filename": (16, 8, False, None), "nope": missing, "odd": missing, "common_type": (0, 2, False, None)}
    assert got["g", "child_pid"] == missing and got["g", "filename"] == none and got["f", "big"] == none
    record = bytearray(range(1, 21)) + bytearray((-5).to_bytes(4, "little", signed=True)) + bytearray((1 << 63).to_bytes(8, "little"))
    records = spark.createDataFrame([("h", "fork", record), ("h", "fork", record[:22]), ("h", "other", record), ("h", "fork", None)], "host string, event string, record binary")
    rows = layouts.decoded(records, found, ["child_pid", "big", "common_type"]).collect()
    want = [(-5, -(1 << 63), 0x0201), (None, None, 0x0201), (None, None, None), (None, None, None)]
    assert sorted(map(str, (tuple(r)[2:] for r in rows))) == sorted(map(str, want))


def record(pid, name, kind=0, size=None):
    return pid.to_bytes(4, "little") + (len(name) if size is None else size).to_bytes(4, "little") + bytes([kind, 9, 9, 9]) + name.ljust(256, b"\0")


def test_flat_files(spark, tmp_path):
    rng = random.Random(2)
    whole = {f"{k}.bin": b"".join(record(rng.randrange(1 << 32), b"/f%d" % i, rng.randrange(2)) for i in range(n)) for k, n in enumerate((0, 1, 977))}
    for name, data in whole.items():
        (tmp_path / name).write_bytes(data + (b"\x01" * 267 if name == "2.bin" else b""))
    (tmp_path / "_done").write_bytes(b"x" * 500)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        rows = tracefile.records(spark, path, split=packages.RECORD * 100)
        assert rows.rdd.getNumPartitions() == 1 + 10
        got = {(os.path.basename(r.path), r["at"]): bytes(r.record) for r in rows.collect()}
        want = {(n, i): d[i * 268 : i * 268 + 268] for n, d in whole.items() for i in range(len(d) // 268)}
        assert got == want | {("2.bin", 977): b"\x01" * 267}
    numbered = rows.select(F.col("at").alias("seq"), "record")
    assert packages.events(numbered).count() == 978
    assert tracefile.records(spark, str(tmp_path / "0.bin")).count() == 0


def trace_of(n, seed=1):
    rng, rows = random.Random(seed), []
    for seq in range(n):
        if seq % 11 == 4:
            continue
        name = rng.choice([b"/a", b"/\xff\xfe", b"/b" * 100, b""])
        made = record(rng.randrange(50), name, rng.choice([0, 0, 1, 7]), rng.choice([None, None, 300, 4_000_000_000]))
        rows.append((seq, bytearray(made[:100] if rng.random() < 0.1 else made)))
    return rows


def counts_of(rows):
    size = lambda r: int.from_bytes(r[4:8], "little")
    whole = [bytes(r) for _, r in rows if len(r) >= 268]
    opens = [r for r in whole if r[8] != 1]

    def valid(r):
        try:
            r[12 : 12 + min(256, size(r))].decode()
            return True
        except UnicodeDecodeError:
            return False

    seqs = [s for s, _ in rows]
    return {"records": len(rows), "short": len(rows) - len(whole), "overlong": sum(size(r) > 256 for r in opens), "invalid": sum(not valid(r) for r in opens), "opens": len(opens), "forks": len(whole) - len(opens), "dropped": max(seqs) - min(seqs) + 1 - len(seqs)}


def test_intake_stops_and_goes_on(spark, tmp_path):
    rows = trace_of(400)
    schema = "seq long, record binary"
    arrivals, kept, once = (str(tmp_path / x) for x in ("arrivals", "kept", "once"))
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).repartition(3).write.mode("append").parquet(arrivals)
        resume.advance(spark, arrivals, kept, 2)
        sofar = [r for i in range(k + 1) for r in rows[i::3]]
        assert resume.landed(spark, kept).count() == sum(len(r) >= 268 for _, r in sofar)
        assert resume.totals(resume.counted(spark, kept)).first().asDict() == counts_of(sofar)
        # Nothing new: nothing changes.
        resume.advance(spark, arrivals, kept, 2)
        assert resume.totals(resume.counted(spark, kept)).first().records == len(sofar)
    resume.advance(spark, arrivals, once)
    key = lambda r: (r.seq, r.pid, r.is_fork, r.raw_path or "")
    assert sorted(map(key, resume.landed(spark, kept).collect())) == sorted(map(key, resume.landed(spark, once).collect())) == sorted(map(key, packages.events(spark.createDataFrame(rows, schema)).collect()))
    # A batch that is run again after a failure replaces what it had left; one without counters isn't there yet.
    batch = spark.createDataFrame(rows[:40], schema)
    resume.taken_in(once)(batch, 7)
    before = resume.landed(spark, once).count()
    resume.taken_in(once)(batch, 7)
    assert resume.landed(spark, once).count() == before
    packages.events(batch).write.parquet(f"{once}/events/batch=8")
    assert resume.landed(spark, once).count() == before


def silences(rows):
    """Brute force: (session, since, alive) of rows (session, second, pid, kind)."""
    out, newest = [], max(r[1] for r in rows)
    for session in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == session), key=lambda r: (r[1], r[3] == "exit"))
        times = sorted({r[1] for r in own})
        for at, following in zip(times, [*times[1:], newest]):
            if following - at >= 10:
                alive = set()
                for _, t, pid, kind in own:
                    if t <= at:
                        (alive.discard if kind == "exit" else alive.add)(pid)
                out.append((session, at, sorted(alive)))
    return sorted(out)


def test_stalls(spark, tmp_path):
    rng, at, rows = random.Random(4), 0, []
    for _ in range(300):
        at += rng.choice([0, 1, 3, 9, 10, 11, 40])
        rows.append((rng.randrange(3), at, rng.randrange(6), rng.choice(["fork", "open", "exit"])))
    table = spark.createDataFrame(rows, "session long, second long, pid long, kind string").select("session", F.timestamp_seconds("second").alias("ts"), "pid", "kind")
    table.coalesce(1).write.parquet(str(tmp_path / "trace"))
    shown = lambda got: sorted((r.session, r.since, r.alive) for r in got.select("session", F.unix_seconds("since").alias("since"), "alive").collect())
    assert shown(ingest.drained(spark, str(tmp_path / "trace"), watchdog.stalls, watchdog.STALL)) == silences(rows)
    # The same in batches: state goes on, and timers tell the silences of sessions that have nothing in a batch.
    times = sorted({r[1] for r in rows})
    for k in range(4):
        low, high = times[k * len(times) // 4], times[min((k + 1) * len(times) // 4, len(times) - 1)] if k < 3 else 1 << 40
        table.filter(F.unix_seconds("ts").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "parts"))
    assert shown(ingest.drained(spark, str(tmp_path / "parts"), watchdog.stalls, watchdog.STALL, 1)) == silences(rows)


def test_a_stream_reads_its_own_folder_only(spark, tmp_path):
    for name, n in (("trace", 3), ("trace2", 40)):
        spark.range(n).write.parquet(str(tmp_path / name))
    assert ingest.drained(spark, str(tmp_path / "trace"), lambda r: r, "id long").count() == 3


def test_line_ends_and_paths(spark):
    table = spark.createDataFrame([(0, 'ID="ubuntu"\r\nVERSION_ID="22.04"\r\n')], "pos long, content string")
    assert packages.distro(packages.os_release(table)).collect() == [("ubuntu-22.04",)]
    lists = spark.createDataFrame([(1, "a.list", "/usr\r\n/usr/a\r\n")], "pos long, file_name string, content string")
    assert sorted(r.path for r in packages.package_files(lists).collect()) == ["/usr", "/usr/a"]
    status = spark.createDataFrame([(1, "status", "Package: a\r\nVersion: 1\r\n\r\nPackage: b\r\nVersion: 2\r\n")], "pos long, file_name string, content string")
    assert sorted((r.pkg_key, r.version) for r in packages.package_meta(status).collect()) == [("a", "1"), ("b", "2")]
    redirect = "[wrap-redirect]\nfilename = {}\n"
    given = [(i, f"w{i}.wrap", redirect.format(x)) for i, x in enumerate(["./sub/real.wrap", "sub/../sub//real.wrap", "sub/real.wrap", "sub/other.wrap"])] + [(9, "sub/real.wrap", "[wrap-git]\nrevision = 5\n")]
    got = wraps.resolved(spark.createDataFrame(given, "pos long, wrap_path string, content string")).collect()
    assert sorted((r.wrap_name, r.revision) for r in got) == [("w0", "5"), ("w1", "5"), ("w2", "5")]


def test_process_facts(spark):
    facts = spark.createDataFrame([(1, "comm", " cc1\n", 1), (1, "comm", None, 5), (2, "comm", None, 1), (2, "comm", "ld\n", 2), (1, "cwd", "/a", 1), (1, "cwd", "/b", 2), (1, "cwd", None, 3), (3, "cwd", None, 1)], "pid long, kind string, content string, seq long")
    assert sorted(map(tuple, packages.process_names(facts).collect())) == [(1, ""), (2, "ld")]
    assert [tuple(r) for r in packages.process_directories(facts).collect()] == [(1, "/b")]
