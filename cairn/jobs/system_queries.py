"""Package database, wraps, operating system, event records and process facts."""

from pyspark.sql import functions as F

from cairn.functions import syscalls, versions
from cairn.jobs.registry import query
from cairn.operators import report, trace
from cairn.sources import layouts, owners, packages, tracefile, wraps
from cairn.sources.bundle import folder, sql, table
from cairn.sources.store import new_folder
from cairn.streaming import ingest, resume, watchdog

STATUS = """SELECT 'lib' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN ':amd64' ELSE '' END AS pkg_key, '1:' || p_size AS version, CASE WHEN p_partkey % 4 = 0 THEN 'src' || p_partkey END AS src_name, 0 AS pos FROM part WHERE p_partkey % 5 <> 0
    UNION ALL SELECT 'lib' || p_partkey, 'again', 'other', 1 FROM part WHERE p_partkey % 10 = 2"""
LISTED = """SELECT 'lib' || p_partkey || CASE WHEN p_size % 2 = 0 THEN ':amd64' ELSE '' END AS pkg_key, p_partkey AS pos, unnest(['/usr/share', '/usr/lib/lib' || p_partkey || '.so', '/usr/share/' || CAST(floor(p_partkey / 3) AS BIGINT)]) AS path FROM part WHERE p_size % 7 <> 0"""
RELEASE = """SELECT 'NAME_' || r_regionkey AS key, r_name || '=x' AS value, r_regionkey AS pos FROM region UNION ALL SELECT 'LAST', '' || r_regionkey, r_regionkey FROM region
    UNION ALL SELECT 'ID', lower(r_name), r_regionkey FROM region UNION ALL SELECT 'VERSION_ID', r_regionkey || '.04', r_regionkey FROM region"""
WRAPS = """SELECT 'w' || s || '.wrap' AS wrap_path, s, CASE WHEN k = 2 THEN CASE s % 3 WHEN 0 THEN './' WHEN 1 THEN 'sub' || s || '/../' ELSE '' END || 'sub' || s || '/real.wrap' END AS redirect, CASE k WHEN 1 THEN 'dir' || s WHEN 3 THEN 'w-2.' || CAST(floor(s / 2) AS BIGINT) END AS directory,
        CASE k WHEN 0 THEN 'https://g.example/w' || s WHEN 1 THEN '' WHEN 4 THEN 'https://h.example' END AS url, CASE k WHEN 0 THEN 'v1.' || s WHEN 4 THEN 'main' END AS revision,
        CASE WHEN k = 1 THEN 'https://f.example/a=b' END AS source_url, CASE WHEN k = 1 THEN 'w-3.' || s || '.tar.xz' END AS source_filename FROM (SELECT s_suppkey AS s, s_suppkey % 5 AS k FROM supplier)
    UNION ALL SELECT 'sub' || s_suppkey || '/real.wrap', s_suppkey, NULL, NULL, NULL, '4.' || s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 2 = 0"""
FIELDS = "directory, url, revision, source_url, source_filename"
RESOLVED = f"""SELECT 'w' || s AS wrap_name, s, {FIELDS} FROM ({WRAPS}) WHERE redirect IS NULL AND NOT contains(wrap_path, '/')
    UNION ALL SELECT 'w' || s_suppkey, s_suppkey, NULL, NULL, '4.' || s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 5 = 2 AND s_suppkey % 2 = 0"""
COMMITS = "SELECT 'w' || s_suppkey AS dirname, substr(CASE WHEN s_suppkey % 3 = 0 THEN sha1('' || s_suppkey) ELSE sha1('m' || s_suppkey) END, 1, 12) AS \"commit\" FROM supplier WHERE s_suppkey % 3 <> 2"
INDEX = f"""SELECT dirname, arg_max(wrap_name, s) AS name, arg_max(version, s) AS version, arg_max(url, s) AS url FROM (
    SELECT coalesce(directory, wrap_name) AS dirname, wrap_name, s, coalesce(url, source_url) AS url,
        coalesce(CASE s % 5 WHEN 0 THEN '1.' || s WHEN 1 THEN '3.' || s WHEN 2 THEN '4.' || s WHEN 3 THEN '2.' || CAST(floor(s / 2) AS BIGINT) END, (SELECT c."commit" FROM ({COMMITS}) c WHERE c.dirname = wrap_name)) AS version FROM ({RESOLVED})) GROUP BY dirname"""


@query("src_dpkg_status", f"SELECT pkg_key, arg_max(version, pos) AS version, arg_max(src_name, pos) FILTER (src_name IS NOT NULL) AS src_name FROM ({STATUS}) GROUP BY pkg_key")
def src_dpkg_status(spark, sf_dir):
    return packages.package_meta(table(spark, sf_dir, "status"))


@query("src_dpkg_list", f"SELECT path, arg_max(pkg_key, pos) AS pkg_key FROM ({LISTED}) GROUP BY path")
def src_dpkg_list(spark, sf_dir):
    return packages.package_files(table(spark, sf_dir, "lists"))


@query("src_os_release", f"SELECT key, arg_max(value, pos) AS value FROM ({RELEASE}) GROUP BY key")
def src_os_release(spark, sf_dir):
    return packages.os_release(table(spark, sf_dir, "os_release"))


@query("fn_distro", f"SELECT (SELECT arg_max(value, pos) FROM ({RELEASE}) WHERE key = 'ID') || '-' || (SELECT arg_max(value, pos) FROM ({RELEASE}) WHERE key = 'VERSION_ID') AS distro")
def fn_distro(spark, sf_dir):
    return packages.distro(src_os_release(spark, sf_dir))


@query("src_wrap_ini", f"SELECT wrap_path, redirect, {FIELDS} FROM ({WRAPS})")
def src_wrap_ini(spark, sf_dir):
    return wraps.parsed(table(spark, sf_dir, "wraps")).drop("pos")


@query("join_wrap_redirect", f"SELECT wrap_name, {FIELDS} FROM ({RESOLVED})")
def join_wrap_redirect(spark, sf_dir):
    return wraps.resolved(table(spark, sf_dir, "wraps")).drop("pos")


@query("src_git_head", COMMITS)
def src_git_head(spark, sf_dir):
    return wraps.commit(table(spark, sf_dir, "git_heads"))


@query("src_wrap_index", INDEX)
def src_wrap_index(spark, sf_dir):
    return wraps.index(table(spark, sf_dir, "wraps"), table(spark, sf_dir, "git_heads"))


@query("fn_is_hex_hash", "SELECT 'w' || s_suppkey AS dirname, 'HEAD' AS name, s_suppkey % 3 = 0 AS result FROM supplier UNION ALL SELECT 'w' || s_suppkey, 'refs/heads/main', true FROM supplier")
def fn_is_hex_hash(spark, sf_dir):
    return table(spark, sf_dir, "git_heads").select("dirname", "name", versions.is_hex_hash(F.regexp_replace("content", "\n$", "")).alias("result"))


EVENTS = f"SELECT seq, pid, seq % 9 = 0 AS is_fork, raw_path FROM {sql('open_event')} WHERE seq % 50 <> 7"


def decoded(spark, sf_dir):
    return packages.events(table(spark, sf_dir, "raw_event"))


@query("src_ring_drain", f"SELECT seq, pid, raw_path FROM ({EVENTS}) WHERE NOT is_fork AND raw_path <> ''")
def src_ring_drain(spark, sf_dir):
    return packages.opens(decoded(spark, sf_dir))


@query("st_flush_barrier", f"SELECT count(*) AS events, count(DISTINCT pid) AS pids, max(seq) AS last_seq FROM ({EVENTS})")
def st_flush_barrier(spark, sf_dir):
    """All events that lay there when the stream was told to end have been read."""
    rows = ingest.drained(spark, folder(spark, sf_dir, "raw_event"), lambda r: packages.events(r).select("seq", "pid"), "seq long, pid long")
    return rows.agg(F.count("*").alias("events"), F.countDistinct("pid").alias("pids"), F.max("seq").alias("last_seq"))


@query("st_lazy_pid", f"SELECT DISTINCT pid FROM ({EVENTS})")
def st_lazy_pid(spark, sf_dir):
    """Processes first seen by a fork or by an open."""
    return ingest.drained(spark, folder(spark, sf_dir, "raw_event"), lambda r: packages.events(r).select("pid").dropDuplicates(["pid"]), "pid long")


@query("st_late_pids", f"SELECT pid, coalesce(trim(comm), '') AS comm, cwd FROM (SELECT DISTINCT pid FROM ({EVENTS})) LEFT JOIN {sql('process')} USING (pid)")
def st_late_pids(spark, sf_dir):
    return ingest.late(st_lazy_pid(spark, sf_dir), table(spark, sf_dir, "process"))


PPID = "SELECT DISTINCT 1000 + user_id AS pid, CASE WHEN user_id % 4 <> 0 THEN 1 + user_id % 7 END AS ppid FROM events"


@query("src_proc_ppid", PPID)
def src_proc_ppid(spark, sf_dir):
    return packages.parent_of(table(spark, sf_dir, "proc_status"))


@query("join_child_parent", f"SELECT pid, coalesce(parent_pid, ppid) AS parent_pid FROM ({PPID}) LEFT JOIN (SELECT child_pid AS pid, min(parent_pid) AS parent_pid FROM {sql('fork_edge')} WHERE parent_pid > 0 GROUP BY child_pid) USING (pid)")
def join_child_parent(spark, sf_dir):
    forks = table(spark, sf_dir, "fork_edge").filter("parent_pid > 0")
    return trace.with_parent(packages.parent_of(table(spark, sf_dir, "proc_status")), forks)


LOSSY = "(SELECT event_id AS seq, event_id % 50 <> 7 AS whole, event_id % 9 = 0 AS fork FROM events WHERE event_id % 31 <> 3)"
LOSSES = {"records": "true", "short": "NOT whole", "overlong": "whole AND NOT fork AND seq % 40 = 9 AND seq % 37 <> 5", "invalid": "whole AND NOT fork AND seq % 37 = 5", "opens": "whole AND NOT fork", "forks": "whole AND fork"}


@query("agg_percpu_sum", " UNION ALL ".join(f"SELECT '{k}' AS counter, count_if({v}) AS total FROM {LOSSY}" for k, v in LOSSES.items() if k in ("short", "overlong", "invalid")))
def agg_percpu_sum(spark, sf_dir):
    """Counters of faulty records kept for each processor, summed."""
    seen = resume.counters(table(spark, sf_dir, "lossy_event")).join(table(spark, sf_dir, "lossy_event").select("seq", "cpu"), "seq")
    by_cpu = seen.groupBy("cpu").agg(F.count_if(~F.col("_whole")).alias("short"), F.count_if("_overlong").alias("overlong"), F.count_if("_invalid").alias("invalid"))
    return trace.counters(by_cpu.unpivot("cpu", ["short", "overlong", "invalid"], "counter", "n"))


@query("st_overflow", "SELECT " + ", ".join(f"count_if({v}) AS {k}" for k, v in LOSSES.items()) + f", max(seq) - min(seq) + 1 - count(*) AS dropped FROM {LOSSY}")
def st_overflow(spark, sf_dir):
    """Short, overlong, invalid and dropped records of a stream, counted while it is taken in."""
    kept = new_folder(spark, "intake")
    resume.advance(spark, folder(spark, sf_dir, "lossy_event"), kept, 2)
    return resume.totals(resume.counted(spark, kept))


@query("st_partial", f"SELECT CAST(stop AS INTEGER) AS stop, count(*) AS events, count(DISTINCT pid) AS pids, max(seq) AS last_seq FROM ({EVENTS}) JOIN (VALUES (0), (1), (2)) t(stop) ON seq % 3 <= stop GROUP BY stop")
def st_partial(spark, sf_dir):
    """What a trace gives at each of three stops; files arrive between them and the same intake goes on."""
    arrivals, kept, out = new_folder(spark, "arrivals"), new_folder(spark, "intake"), None
    for stop in range(3):
        table(spark, sf_dir, "raw_event").filter(F.col("seq") % 3 == stop).write.mode("append").parquet(arrivals)
        resume.advance(spark, arrivals, kept, 2)
        sofar = resume.landed(spark, kept).agg(F.lit(stop).alias("stop"), F.count("*").alias("events"), F.countDistinct("pid").alias("pids"), F.max("seq").alias("last_seq"))
        # Later stops add to the folder, so each report is written as it is.
        rows = spark.createDataFrame(sofar.collect(), sofar.schema)
        out = rows if out is None else out.unionByName(rows)
    return out


_FLAT: dict = {}


def flat_trace(spark, sf_dir):
    """Whole records as flat files, with a torn one at the end of the last."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _FLAT:
        rows = table(spark, sf_dir, "raw_event").filter(F.length("record") == packages.RECORD)
        torn = spark.range(1).select(F.lit(1 << 60).alias("seq"), F.unhex(F.repeat(F.lit("EE"), F.lit(100))).alias("record"))
        _FLAT[key] = new_folder(spark, "flat")
        tracefile.write_flat(rows.unionByName(torn).repartitionByRange("seq").sortWithinPartitions("seq"), _FLAT[key], "seq")
    return _FLAT[key]


@query("src_ring_drain_files", f"SELECT seq, pid, raw_path FROM ({EVENTS}) WHERE NOT is_fork AND raw_path <> ''")
def src_ring_drain_files(spark, sf_dir):
    """Opens of flat binary files, long ones read by several tasks; numbers come from the files' first ones and the places in them."""
    rows = tracefile.records(spark, flat_trace(spark, sf_dir))
    first = F.regexp_extract("path", r"([0-9]+)\.bin\z", 1).cast("long")
    # Records that a recorder had cut short aren't in flat files: one number in fifty is missing.
    rank = F.floor(first / 50) * 49 + first % 50 - F.when(first % 50 > 7, 1).otherwise(0) + F.col("at")
    seq = F.floor(rank / 49) * 50 + rank % 49 + F.when(rank % 49 >= 7, 1).otherwise(0)
    return packages.opens(packages.events(rows.select(seq.cast("long").alias("seq"), "record")))


WANTED = [("fork", "parent_pid", 24, 4, 1), ("fork", "child_pid", 32, 4, 1), ("openat", "filename", 16, 8, 0)]


def tp_layout(spark, sf_dir):
    fields = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("event", "field", "offset", "size", "signed"), row)]) for row in WANTED])
    wanted = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("host"), F.inline(fields))
    return layouts.layout(table(spark, sf_dir, "tp_format"), wanted)


@query(
    "src_tp_format",
    """SELECT r_regionkey AS host, event, field, CAST(CASE WHEN r_regionkey = 3 THEN preset WHEN field = 'filename' THEN 24 + r_regionkey WHEN field = 'parent_pid' THEN 8 + 4 * r_regionkey WHEN r_regionkey = 4 THEN preset ELSE 16 + 4 * r_regionkey END AS INTEGER) AS "offset",
        size, field <> 'filename' AS signed, CASE WHEN r_regionkey = 3 THEN 'format file not found' WHEN r_regionkey = 4 AND field = 'child_pid' THEN 'field not found' END AS warning
    FROM region, (VALUES ('fork', 'parent_pid', 24, 4), ('fork', 'child_pid', 32, 4), ('openat', 'filename', 16, 8)) t(event, field, preset, size)""",
)
def src_tp_format(spark, sf_dir):
    """Where fields lie by hosts' format files, or by default with a warning."""
    return tp_layout(spark, sf_dir)


@query(
    "src_tp_events",
    """SELECT event_id AS seq, user_id % 5 AS host, CASE WHEN event_id % 2 = 0 THEN 'fork' ELSE 'openat' END AS event,
        CASE WHEN event_id % 2 = 0 AND (event_id % 17 <> 3 OR user_id % 5 = 0) THEN user_id END AS parent_pid, CASE WHEN event_id % 2 = 0 AND event_id % 17 <> 3 THEN CASE WHEN user_id % 7 = 0 THEN -2 ELSE 1000 + event_id END END AS child_pid,
        CASE WHEN event_id % 2 = 1 AND event_id % 17 <> 3 THEN event_id + 4294967296 END AS filename FROM events""",
)
def src_tp_events(spark, sf_dir):
    """Events of five hosts, decoded by their own layouts."""
    return layouts.decoded(table(spark, sf_dir, "raw_context"), tp_layout(spark, sf_dir), ["parent_pid", "child_pid", "filename"])


ANSWERED = {
    "dpkg": "SELECT '/usr/lib/o' || p AS path, CASE p % 5 WHEN 1 THEN 'o' || p || ', other' ELSE 'libo' || p END AS name, CASE WHEN p % 5 <> 1 AND p % 4 <> 2 THEN '1:' || size ELSE 'unknown' END AS version, CASE WHEN p % 5 = 0 THEN 'amd64' END AS arch FROM o WHERE p % 3 <> 0 AND p % 5 NOT IN (2, 4)",
    "pacman": "SELECT '/usr/lib/o' || p AS path, 'pk' || p AS name, '1.' || size || '-1' AS version, NULL AS arch FROM o WHERE p % 4 = 0",
    "rpm": "SELECT '/usr/lib/o' || p AS path, 'rp' || p AS name, CASE WHEN p % 6 = 1 THEN 'unknown' ELSE '2.' || size || '-3' END AS version, NULL AS arch FROM o WHERE p % 5 <> 4",
}
ASKED = "WITH o AS (SELECT p_partkey AS p, p_size AS size FROM part) "


def answer_query(manager: str, parse):
    @query(f"src_{manager}_cli", f"{ASKED} SELECT path, name, version, arch, CAST(NULL AS VARCHAR) AS src_name FROM ({ANSWERED[manager]})")
    def run(spark, sf_dir):
        return parse(table(spark, sf_dir, "answer"), table(spark, sf_dir, "answer_version"))


answer_query("dpkg", owners.dpkg)
answer_query("pacman", lambda answers, _: owners.pacman(answers))
answer_query("rpm", lambda answers, _: owners.rpm(answers))


@query(
    "join_owner_chain",
    ASKED + "SELECT * EXCLUDE (rank), CAST(NULL AS VARCHAR) AS src_name FROM (" + " UNION ALL ".join(f"SELECT *, '{m}' AS manager, {i} AS rank FROM ({rows})" for i, (m, rows) in enumerate(ANSWERED.items())) + ") QUALIFY row_number() OVER (PARTITION BY path ORDER BY rank) = 1",
)
def join_owner_chain(spark, sf_dir):
    """Owners of paths by the first manager that has an answer."""
    return owners.owners(table(spark, sf_dir, "answer"), table(spark, sf_dir, "answer_version"))


@query("src_pm_detect", "SELECT n_name AS host, CASE WHEN n_nationkey % 2 = 0 THEN 'dpkg' WHEN n_nationkey % 3 = 0 THEN 'pacman' WHEN n_nationkey % 5 = 0 THEN 'rpm' ELSE 'none' END AS manager FROM nation")
def src_pm_detect(spark, sf_dir):
    return owners.detected(table(spark, sf_dir, "which"), "host")


@query(
    "fn_decode_syscall",
    f"""SELECT seq, CASE CAST(seq % 21 AS INTEGER) WHEN 0 THEN 'wait4(pid=' || v || ')' WHEN 1 THEN 'wait4(pid=-1)' WHEN 2 THEN 'waitid(id=' || v || ')' WHEN 3 THEN 'poll(nfds=' || v || ', timeout=1000ms)' WHEN 4 THEN 'poll(nfds=' || v || ', timeout=∞)'
        WHEN 5 THEN 'ppoll(nfds=' || v || ', timeout=∞)' WHEN 6 THEN 'ppoll(nfds=' || v || ')' WHEN 7 THEN 'select(nfds=' || v || ')' WHEN 8 THEN 'pselect6(nfds=' || v || ', timeout=∞)' WHEN 9 THEN 'pselect6(nfds=' || v || ')' WHEN 10 THEN 'epoll_wait(timeout=' || v || 'ms)'
        WHEN 11 THEN 'epoll_wait(timeout=∞)' WHEN 12 THEN 'epoll_wait(timeout=0ms)' WHEN 13 THEN 'futex(op=0x' || lower(hex(v)) || ')' WHEN 14 THEN 'read(fd=' || v || ')' WHEN 15 THEN 'nanosleep' WHEN 17 THEN 'syscall#18446744073709551615' WHEN 18 THEN 'running' WHEN 19 THEN 'running'
        ELSE 'syscall#' || (v + 500) END AS result FROM {sql('syscall_line')}""",
)
def fn_decode_syscall(spark, sf_dir):
    return syscalls.with_decoded(table(spark, sf_dir, "syscall_line"), "line", "result").select("seq", "result")


STALLS = f"""WITH w AS (SELECT session, epoch_ms(ts) AS ms, pid, kind FROM {sql('watched')}),
    gaps AS (SELECT session, ms FROM (SELECT session, ms, lead(ms) OVER (PARTITION BY session ORDER BY ms) AS following, (SELECT max(ms) FROM w) AS newest FROM (SELECT DISTINCT session, ms FROM w) AS d) AS e WHERE coalesce(following, newest) - ms >= 10000),
    states AS (SELECT g.session, g.ms AS since_ms, w.pid, arg_max(w.kind, w.ms * 2 + CASE WHEN w.kind = 'exit' THEN 1 ELSE 0 END) AS kind FROM gaps g JOIN w ON w.session = g.session AND w.ms <= g.ms GROUP BY g.session, g.ms, w.pid)
    SELECT session, since_ms, pid, kind <> 'exit' AS alive FROM states"""


def told(spark, sf_dir):
    return ingest.drained(spark, folder(spark, sf_dir, "watched"), watchdog.told, watchdog.TOLD)


@query("st_watchdog", f"SELECT session, since_ms, count_if(alive) AS n_alive, coalesce(string_agg(pid, ',' ORDER BY pid) FILTER (alive), '') AS alive FROM ({STALLS}) GROUP BY session, since_ms")
def st_watchdog(spark, sf_dir):
    """Silences of ten seconds and more, with the processes alive in them."""
    return watchdog.texts(told(spark, sf_dir))


@query("sort_alive_pids", f"SELECT session, since_ms, CAST(row_number() OVER (PARTITION BY session, since_ms ORDER BY pid) AS INTEGER) AS place, pid FROM ({STALLS}) WHERE alive")
def sort_alive_pids(spark, sf_dir):
    """The processes alive in each silence, by number."""
    return watchdog.ranks(told(spark, sf_dir))


@query("fn_project_name", f"SELECT pid, CASE WHEN cwd IS NULL THEN 'unknown' ELSE regexp_extract(cwd, '([^/]+)/*$', 1) END AS name FROM {sql('process')}")
def fn_project_name(spark, sf_dir):
    return table(spark, sf_dir, "process").select("pid", report.project_name(F.col("cwd")).alias("name"))


@query("src_proc_comm", f"SELECT pid, arg_max(coalesce(trim(content, ' ' || chr(10)), ''), seq) AS comm FROM {sql('proc_fact')} WHERE kind = 'comm' GROUP BY pid")
def src_proc_comm(spark, sf_dir):
    return packages.process_names(table(spark, sf_dir, "proc_fact"))


@query("src_proc_cwd", f"SELECT pid, arg_max(content, seq) AS cwd FROM {sql('proc_fact')} WHERE kind = 'cwd' AND content IS NOT NULL GROUP BY pid")
def src_proc_cwd(spark, sf_dir):
    return packages.process_directories(table(spark, sf_dir, "proc_fact"))


@query(
    "fn_purl_type",
    """SELECT s_suppkey AS host, ['ubuntu', 'fedora', 'manjaro', 'rocky', 'linux', 'debian', 'alpine'][s_suppkey % 7 + 1] || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '-' || s_suppkey END AS distro,
        ['deb', 'rpm', 'alpm', 'rpm', 'generic', 'deb', 'generic'][s_suppkey % 7 + 1] AS result FROM supplier""",
)
def fn_purl_type(spark, sf_dir):
    """Package types of hosts by their release files."""
    hosts = packages.distro(packages.os_release(table(spark, sf_dir, "host_release"), "host"), "host")
    return hosts.select("host", "distro", versions.purl_type(F.col("distro")).alias("result"))
