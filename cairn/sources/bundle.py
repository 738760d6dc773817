"""Capture-bundle tables derived from the given tables.

``TABLES`` are single statements that any ANSI engine reads alike; ``{name}``
is a given table. ``FILES`` hold whole texts (lock files, package database,
wraps, event records) put together from rows for Spark's parsers; what they
must give back is stated over the given tables by themselves. A real bundle
has the same columns as Parquet. Names carry the keys of the given tables, so
there are more of them as the tables grow.
"""

from pyspark.sql import DataFrame, SparkSession

from cairn.sources.store import written

PROJECT = "/home/u/proj"
FEW = "CAST(CAST(floor(event_id / 32) AS BIGINT) AS STRING)"

TABLES = {
    "open_event": f"""
        SELECT event_id AS seq, 1000 + user_id AS pid, CASE CAST(event_id % 16 AS INT)
            WHEN 0 THEN concat('/usr/lib/x86_64-linux-gnu/libp', {FEW}, '.so.', CAST(event_id % 3 AS STRING))
            WHEN 1 THEN concat('/usr/include/p', {FEW}, '/api.h')
            WHEN 2 THEN concat('/proc/', CAST(user_id AS STRING), '/maps')
            WHEN 3 THEN concat('/tmp/cc', {FEW}, '.a')
            WHEN 4 THEN concat('../lib', {FEW}, '/libq', CAST(event_id % 7 AS STRING), '.a')
            WHEN 5 THEN concat('./src/m', {FEW}, '.c')
            WHEN 6 THEN concat('//opt///x', {FEW}, '/./lib.so')
            WHEN 7 THEN concat(CASE WHEN event_id % 64 = 7 THEN 'subprojects/' ELSE '' END, 'subprojects/zlib-1.', {FEW}, '/inc/z', CAST(event_id % 29 AS STRING), '.h')
            WHEN 8 THEN concat('src/f', {FEW}, '.cpp')
            WHEN 9 THEN concat('inc/h', {FEW}, '.hpp')
            WHEN 10 THEN concat('/usr/lib64/libw', {FEW}, '.so')
            WHEN 11 THEN concat('/usr/local/lib/libl', {FEW}, '.so.2.', CAST(event_id % 4 AS STRING))
            WHEN 12 THEN ''
            WHEN 13 THEN concat('/lib/x86_64-linux-gnu/libp', {FEW}, '.so.', CAST(event_id % 3 AS STRING))
            WHEN 14 THEN concat('/../r', {FEW}, '.so')
            ELSE concat('sub/../../up', {FEW}, '/libu-', CAST(event_id % 3 AS STRING), '.a/') END AS raw_path
        FROM {{events}}""",
    "process": """
        SELECT DISTINCT CASE WHEN user_id % 11 = 0 THEN -1 - user_id ELSE 1000 + user_id END AS pid, CASE CAST(user_id % 12 AS INT) WHEN 0 THEN 'cc1' WHEN 1 THEN 'make' WHEN 2 THEN 'python3.11' WHEN 3 THEN 'cargo'
            WHEN 4 THEN 'node' WHEN 5 THEN 'go' WHEN 6 THEN 'gcc-12' WHEN 7 THEN 'bash5' WHEN 8 THEN 'ld' WHEN 9 THEN 'python-3' WHEN 10 THEN 'clang' ELSE '' END AS comm,
            CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('/home/u/proj/d', CAST(user_id AS STRING)) END AS cwd
        FROM {events}""",
    "fork_edge": """
        SELECT DISTINCT CASE WHEN user_id % 13 = 7 THEN -1 WHEN user_id = 0 THEN 1 ELSE 1000 + CAST(floor(user_id / 2) AS BIGINT) END AS parent_pid, 1000 + user_id AS child_pid
        FROM {events}
        UNION SELECT 1000 + user_id, 1000 + CAST(floor(user_id / 2) AS BIGINT) FROM {events} WHERE user_id % 17 = 3
        UNION SELECT 1000 + CAST(floor(user_id / 3) AS BIGINT), 1000 + user_id FROM {events} WHERE user_id % 19 = 5""",
    "pkg_file": """
        SELECT concat('/usr/lib/x86_64-linux-gnu/libp', CAST(p_partkey AS STRING), '.so.', CAST(p_size % 3 AS STRING)) AS path,
            concat('libp', CAST(p_partkey AS STRING), CASE WHEN p_size % 2 = 0 THEN ':amd64' ELSE '' END) AS pkg_key, p_partkey AS pos FROM {part}
        UNION ALL SELECT concat('/usr/include/p', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING), '/api.h'), concat('p', CAST(p_partkey AS STRING), '-dev'), p_partkey FROM {part}""",
    "pkg_meta": """
        SELECT concat('libp', CAST(p_partkey AS STRING), CASE WHEN p_size % 5 = 0 THEN ':i386' ELSE ':amd64' END) AS pkg_key, concat('1:', CAST(p_size AS STRING), '.0+dfsg') AS version,
            CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat('src', CAST(p_size % 9 AS STRING)) END AS src_name, p_partkey AS pos FROM {part}
        UNION ALL SELECT concat('p', CAST(p_partkey AS STRING), '-dev'), CAST(p_size AS STRING), NULL, p_partkey FROM {part}""",
    "subproject": """
        SELECT concat('zlib-1.', CAST(2 * s_suppkey AS STRING)) AS dirname, concat('zlib', CAST(s_suppkey AS STRING)) AS name, concat('1.', CAST(s_suppkey AS STRING), '.wrap') AS version, 'https://zlib.example/z.tar.gz' AS url FROM {supplier}""",
    "link": """
        SELECT '/lib' AS path, 'usr/lib' AS target FROM {region} WHERE r_regionkey = 0
        UNION ALL SELECT '/usr/lib64', '../lib64' FROM {region} WHERE r_regionkey = 0
        UNION ALL SELECT '/lib64', 'usr/lib/wide/..' FROM {region} WHERE r_regionkey = 0
        UNION ALL SELECT '/usr/lib/wide', '/usr/lib/x86_64-linux-gnu' FROM {region} WHERE r_regionkey = 0
        UNION ALL SELECT concat('/usr/lib/x86_64-linux-gnu/libp', CAST(p_partkey AS STRING), '.so.1'), concat('libp', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 3 = 2 THEN '.so.2' ELSE '.so.0' END) FROM {part} WHERE p_partkey % 3 <> 0
        UNION ALL SELECT concat('/usr/lib/x86_64-linux-gnu/libp', CAST(p_partkey AS STRING), '.so.2'), concat('../x86_64-linux-gnu/libp', CAST(p_partkey AS STRING), '.so.1') FROM {part} WHERE p_partkey % 3 <> 0
        UNION ALL SELECT concat('/opt/x', CAST(s_suppkey AS STRING)), concat('x', CAST(s_suppkey + 1 AS STRING)) FROM {supplier} WHERE s_suppkey % 50 <> 49""",
    "proc_fact": """
        SELECT 1000 + user_id AS pid, 'comm' AS kind, CASE WHEN event_id % 7 = 3 THEN NULL ELSE concat(CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END, 'cc', CAST(event_id % 5 AS STRING), chr(10)) END AS content, event_id AS seq FROM {events}
        UNION ALL SELECT 1000 + user_id, 'cwd', CASE WHEN event_id % 3 <> 0 OR user_id % 6 = 1 THEN NULL ELSE concat('/home/u/proj/d', CAST(event_id % 11 AS STRING)) END, event_id FROM {events}""",
    "answer": """
        SELECT 'dpkg' AS manager, concat('/usr/lib/o', CAST(p_partkey AS STRING)) AS path, p_partkey % 3 <> 0 AS ok, CASE CAST(p_partkey % 5 AS INT)
            WHEN 0 THEN concat('diversion by x from: /a', chr(10), 'libo', CAST(p_partkey AS STRING), ':amd64: /usr/lib/o', chr(10)) WHEN 1 THEN concat('o', CAST(p_partkey AS STRING), ', other: /usr/lib/o', chr(10))
            WHEN 2 THEN concat('  diversion by x to: /b', chr(10)) WHEN 3 THEN concat('libo', CAST(p_partkey AS STRING), ': /usr/lib/o') ELSE '' END AS stdout FROM {part}
        UNION ALL SELECT 'pacman', concat('/usr/lib/o', CAST(p_partkey AS STRING)), p_partkey % 2 = 0, CASE WHEN p_partkey % 4 = 2 THEN 'error: No package owns it' ELSE concat('/usr/lib/o is owned by pk', CAST(p_partkey AS STRING), ' 1.', CAST(p_size AS STRING), '-1', chr(10)) END FROM {part}
        UNION ALL SELECT 'rpm', concat('/usr/lib/o', CAST(p_partkey AS STRING)), p_partkey % 5 <> 4, concat('rp', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 6 = 1 THEN chr(10) ELSE concat(' 2.', CAST(p_size AS STRING), '-3', chr(10)) END) FROM {part}""",
    "answer_version": """
        SELECT concat('libo', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 5 = 0 THEN ':amd64' ELSE '' END) AS pkg_key, p_partkey % 4 <> 2 AS ok, concat('1:', CAST(p_size AS STRING), chr(10)) AS stdout FROM {part}""",
    "which": "SELECT n_name AS host, m AS manager, CASE m WHEN 'dpkg' THEN n_nationkey % 2 = 0 WHEN 'pacman' THEN n_nationkey % 3 = 0 ELSE n_nationkey % 5 = 0 END AS ok FROM {nation} CROSS JOIN (SELECT 'rpm' AS m UNION ALL SELECT 'dpkg' UNION ALL SELECT 'pacman') AS managers",
    "syscall_line": """
        SELECT event_id AS seq, user_id AS v, CASE CAST(event_id % 21 AS INT) WHEN 0 THEN concat('61 0x', hex(user_id), ' 0x0 0x0 0x0 0x0 0x0 0x7ff 0x7ff') WHEN 1 THEN '61 0xffffffffffffffff 0x0' WHEN 2 THEN concat('247 0x1 0x', hex(user_id))
            WHEN 3 THEN concat('7 0x7f 0x', hex(user_id), ' 0x3e8') WHEN 4 THEN concat('7 0x7f 0x', hex(user_id), ' 0xffffffffffffffff') WHEN 5 THEN concat('271 0x1 0x', hex(user_id), ' 0x0') WHEN 6 THEN concat('271 0x1 0x', hex(user_id), ' 0x55')
            WHEN 7 THEN concat('23 0x', hex(user_id)) WHEN 8 THEN concat('270 0x', hex(user_id), ' 0x0 0x0 0x0 0x0') WHEN 9 THEN concat('270 0x', hex(user_id), ' 0x0 0x0 0x0 0x1') WHEN 10 THEN concat('232 0x3 0x7f 0x20 0x', hex(user_id))
            WHEN 11 THEN '281 0x3 0x7f 0x20 0xffffffffffffffff' WHEN 12 THEN '441 0x3' WHEN 13 THEN concat('202 0x7f 0x', hex(user_id)) WHEN 14 THEN concat('0 0x', hex(user_id)) WHEN 15 THEN '35 0x7f' WHEN 16 THEN concat(CAST(user_id + 500 AS STRING), '  0x1')
            WHEN 17 THEN concat('zz ', CAST(user_id AS STRING)) WHEN 18 THEN '' WHEN 19 THEN 'running' ELSE concat('0x', hex(user_id + 500), ' gg') END AS line FROM {events}""",
    "watched": """
        SELECT user_id % 20 AS session, date_trunc('millisecond', ts) AS ts, 1000 + user_id AS pid, CASE event_type WHEN 'signup' THEN 'fork' WHEN 'purchase' THEN 'exit' ELSE 'open' END AS kind FROM {events}""",
    "requirement_line": """
        SELECT p_partkey AS pos, CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN concat('Pkg_', CAST(p_partkey AS STRING), '.x==', CAST(p_size AS STRING), '.1')
            WHEN 1 THEN concat('a', CAST(p_size AS STRING), '==1.0 ; python_version>''3''') WHEN 2 THEN '# note' WHEN 3 THEN '-r base.txt' WHEN 4 THEN concat('b', CAST(p_size AS STRING), '>=2')
            WHEN 5 THEN concat('c===', CAST(p_size AS STRING)) WHEN 6 THEN concat('git/x==', CAST(p_size AS STRING)) ELSE concat('  d==', CAST(p_partkey AS STRING), '+local  ') END AS line FROM {part}""",
    "go_sum_line": """
        SELECT p_partkey AS pos, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN concat('example.com/m', CAST(p_partkey AS STRING), ' v1.', CAST(p_size AS STRING), '.0 h1:x=')
            WHEN 1 THEN concat('example.com/m', CAST(p_size AS STRING), ' v1.0.0/go.mod h1:y=') WHEN 2 THEN '// note' WHEN 3 THEN '' ELSE concat('example.com/n v2.', CAST(p_size AS STRING), '.0+incompatible h1:z=') END AS line FROM {part}""",
}


def little(column: str) -> str:
    """Hex digits of a number's four low bytes, lowest first."""
    digits = f"lpad(hex({column}), 8, '0')"
    return "concat(" + ", ".join(f"substring({digits}, {k}, 2)" for k in (7, 5, 3, 1)) + ")"


#: Forty packages a file; some files lie where nobody looks or can't be parsed.
FILE = "CAST(floor(p_partkey / 40) AS BIGINT)"
PLACE = "CASE f % 8 WHEN 0 THEN concat('app', f, '/target/') WHEN 1 THEN concat('app', f, '/a/b/c/d/e/') WHEN 2 THEN concat('app', f, '/a/b/c/d/') ELSE concat('app', f, '/') END"
BROKEN = "CASE WHEN f % 9 = 4 THEN '[[{' ELSE '' END"


def lock_file(name: str, entry: str, text: str, where: str = "true", sep: str = "\\n") -> str:
    """A statement that joins one entry a part to whole files."""
    rows = f"SELECT {FILE} AS f, p_partkey AS p, p_size AS size FROM {{part}}"
    joined = f"SELECT f, listagg(entry, '{sep}') WITHIN GROUP (ORDER BY p) AS body FROM (SELECT f, p, {entry} AS entry FROM ({rows}) WHERE {where}) GROUP BY f"
    return f"SELECT concat({PLACE}, '{name}') AS rel_path, {text} AS content FROM ({joined})"


VERSION = "concat(size, '.0.', p % 10, CASE WHEN size % 5 = 0 THEN '+b' ELSE '' END)"
TOML = "concat('[[package]]\\nname = \"', {0}, '\"\\nversion = \"', " + VERSION + ", '\"\\n', {1})"
FILES = {
    "cargo_lock": lock_file(
        "Cargo.lock",
        TOML.format("concat('c', p)", "CASE p % 4 WHEN 0 THEN 'source = \"registry+https://r.example/i\"\\n' WHEN 1 THEN 'source = \"git+https://g.example/c\"\\n' WHEN 2 THEN '' ELSE 'source = \"path+file:///c\"\\n' END"),
        f"concat('version = 3\\n\\n', body, {BROKEN})",
    ),
    "poetry_lock": lock_file(
        "poetry.lock",
        TOML.format("concat('Po_', p)", "CASE p % 5 WHEN 0 THEN 'category = \"dev\"\\n' WHEN 1 THEN 'category = \"main\"\\n' WHEN 2 THEN 'groups = [\"dev\", \"test\"]\\n' WHEN 3 THEN 'groups = [\"main\", \"dev\"]\\n' ELSE '' END"),
        f"concat(body, {BROKEN})",
    ),
    "package_lock": lock_file(
        "package-lock.json",
        f"""concat(CASE WHEN p % 11 = 3 AND p % 6 <> 5 AND p % 3 <> 0 THEN concat('"node_modules/n', p, '": {{"version": "0", "dev": true}}, ') ELSE '' END, '"node_modules/', CASE WHEN p % 6 = 5 THEN 'x/node_modules/' WHEN p % 3 = 0 THEN '@s/' ELSE '' END, 'n', p, '": {{',
            CASE p % 7 WHEN 3 THEN '"version": 1' WHEN 4 THEN '"link": true' ELSE concat('"version": "', {VERSION}, '"') END, CASE WHEN p % 5 = 0 THEN ', "dev": true' ELSE '' END, '}}')""",
        f"""concat('{{"lockfileVersion": ', 2 + f % 2, ', "packages": {{"": {{"version": "0"}}, ', body, '}}}}', {BROKEN})""",
        "f % 3 <> 0",
        ", ",
    ),
    "package_lock_v1": lock_file(
        "package-lock.json",
        f"""concat('"n', p, '": {{', CASE WHEN p % 28 = 0 THEN '' ELSE concat('"version": "', {VERSION}, '", ') END, '"dependencies": {{"n', p, '-a": {{"version": "1.', p, '", "dev": true, "dependencies": {{"n', p, '-b": {{"version": "2"}}}}}}}}}}, "n', p, '-c": {{"version": "3"}}')""",
        f"""concat('{{"dependencies": {{', body, '}}}}', {BROKEN})""",
        "f % 3 = 0 AND p % 4 = 0",
        ", ",
    ),
    "yarn_lock": lock_file(
        "yarn.lock",
        """concat(CASE p % 4 WHEN 0 THEN concat('y', p, '@^1.0:') WHEN 1 THEN concat('"@s/y', p, '@^1", "@s/y', p, '@^2":') WHEN 2 THEN concat('# note\\ny', p, '@*:\\n  resolved "x"') ELSE concat('y', p, ':') END,
            CASE WHEN p % 5 = 0 THEN '\\n  version: 1' ELSE concat('\\n  version "', size, '.', p % 10, '"\\n  version "9"') END, '\\n')""",
        "concat('# yarn lockfile v1\\n\\n', body)",
    ),
    "pipfile_lock": lock_file(
        "Pipfile.lock",
        f"""concat('"d', p, '": {{"version": ', CASE WHEN p % 9 = 2 THEN '7' ELSE concat('"', CASE WHEN p % 7 = 1 THEN '=====' ELSE '==' END, {VERSION}, '"') END, '}}')""",
        f"""concat('{{"default": {{', body, '}}, "develop": {{', replace(body, '"d', '"e'), '}}}}', {BROKEN})""",
        "true",
        ", ",
    ),
    "requirements": f"SELECT concat({PLACE}, 'requirements.txt') AS rel_path, body AS content FROM (SELECT CAST(floor(pos / 40) AS BIGINT) AS f, listagg(line, '\\r\\n') WITHIN GROUP (ORDER BY pos) AS body FROM ({TABLES['requirement_line']}) GROUP BY 1)",
    "go_sum": f"SELECT concat({PLACE}, 'go.sum') AS rel_path, body AS content FROM (SELECT CAST(floor(pos / 40) AS BIGINT) AS f, listagg(line, '\\n') WITHIN GROUP (ORDER BY pos) AS body FROM ({TABLES['go_sum_line']}) GROUP BY 1)",
    "status": """
        SELECT f AS pos, 'status' AS file_name, replace(listagg(stanza, '\\n') WITHIN GROUP (ORDER BY p, stanza), '\\n', CASE WHEN f % 2 = 1 THEN '\\r\\n' ELSE '\\n' END) AS content FROM (
            SELECT CAST(floor(p_partkey / 500) AS BIGINT) AS f, p_partkey AS p, concat('Package: lib', p_partkey, '\\n', CASE p_partkey % 3 WHEN 0 THEN 'Architecture: amd64\\n' WHEN 1 THEN 'Architecture: all\\n' ELSE '' END,
                'Description: text\\n more: text\\n', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('Version: 1:', p_size, '\\n') END,
                CASE p_partkey % 4 WHEN 0 THEN concat('Source: src', p_partkey, ' (1.0)\\n') WHEN 1 THEN concat('Source: lib', p_partkey, '\\n') ELSE '' END) AS stanza FROM {part}
            UNION ALL SELECT 1000000000, p_partkey, concat('Package: lib', p_partkey, '\\nVersion: again\\nSource: other\\n') FROM {part} WHERE p_partkey % 10 = 2) GROUP BY f""",
    "lists": """
        SELECT p_partkey AS pos, concat('lib', p_partkey, CASE WHEN p_size % 2 = 0 THEN ':amd64' ELSE '' END, CASE WHEN p_size % 7 = 0 THEN '.md5sums' ELSE '.list' END) AS file_name,
            replace(concat('/.\\n/usr/share\\n/usr/lib/lib', p_partkey, '.so\\nrelative\\n\\n/usr/share/', CAST(floor(p_partkey / 3) AS BIGINT)), '\\n', CASE WHEN p_partkey % 4 = 1 THEN '\\r\\n' ELSE '\\n' END) AS content FROM {part}""",
    "wraps": """
        SELECT s_suppkey AS pos, concat('w', s_suppkey, '.wrap') AS wrap_path, CASE s_suppkey % 5
            WHEN 0 THEN concat('# note\\n[wrap-git]\\nurl = https://g.example/w', s_suppkey, '\\nrevision = v1.', s_suppkey, '\\n')
            WHEN 1 THEN concat('[wrap-file]\\ndirectory = dir', s_suppkey, '\\nsource_url = https://f.example/a=b\\nsource_filename = w-3.', s_suppkey, '.tar.xz\\n[provide]\\nurl = \\n')
            WHEN 2 THEN concat('[wrap-redirect]\\nfilename = ', CASE s_suppkey % 3 WHEN 0 THEN './' WHEN 1 THEN concat('sub', s_suppkey, '/../') ELSE '' END, 'sub', s_suppkey, '/real.wrap\\nrevision = 9\\n')
            WHEN 3 THEN concat('[wrap-file]\\r\\ndirectory = w-2.', CAST(floor(s_suppkey / 2) AS BIGINT), '\\r\\n')
            ELSE '[wrap-git]\\nrevision = main\\nurl=https://h.example' END AS content FROM {supplier}
        UNION ALL SELECT s_suppkey, concat('sub', s_suppkey, '/real.wrap'), concat('[wrap-git]\\nrevision = 4.', s_suppkey, '\\n') FROM {supplier} WHERE s_suppkey % 2 = 0""",
    "git_heads": """
        SELECT concat('w', s_suppkey) AS dirname, 'HEAD' AS name, CASE s_suppkey % 3 WHEN 0 THEN concat(sha1(CAST(s_suppkey AS STRING)), '\\n') WHEN 1 THEN 'ref: refs/heads/main\\n' ELSE 'ref: refs/heads/none' END AS content FROM {supplier}
        UNION ALL SELECT concat('w', s_suppkey), 'refs/heads/main', concat(sha1(concat('m', s_suppkey)), '\\n') FROM {supplier}""",
    "os_release": """
        SELECT r_regionkey AS pos, replace(concat('NAME_', r_regionkey, '="', r_name, '=x"\\nno value\\nLAST=', r_regionkey, '\\nID=', lower(r_name), '\\nVERSION_ID="', r_regionkey, '.04"'), '\\n', CASE WHEN r_regionkey % 2 = 1 THEN '\\r\\n' ELSE '\\n' END) AS content FROM {region}""",
    "host_release": """
        SELECT s_suppkey AS host, s_suppkey AS pos, replace(concat('NAME=x\\nID=', element_at(array('ubuntu', 'fedora', 'manjaro', '"rocky"', 'linux', 'debian', 'alpine'), CAST(s_suppkey % 7 AS INT) + 1), '\\nVERSION_ID="', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE CAST(s_suppkey AS STRING) END, '"\\n'), '\\n', CASE WHEN s_suppkey % 2 = 1 THEN '\\r\\n' ELSE '\\n' END) AS content FROM {supplier}""",
    "raw_event": f"""
        SELECT seq, unhex(concat({little("pid")}, {little("(CASE WHEN seq % 40 = 9 THEN 4000000000 ELSE length(raw_path) END)")}, CASE WHEN seq % 9 = 0 THEN '01' WHEN seq % 9 = 1 THEN '07' ELSE '00' END, '000000',
            CASE WHEN seq % 50 = 7 THEN '' ELSE rpad(hex(encode(raw_path, 'utf-8')), 512, '0') END)) AS record FROM ({TABLES['open_event']})""",
    "lossy_event": f"""
        SELECT e.seq, CAST(e.seq % 4 AS INT) AS cpu, CASE WHEN seq % 37 = 5 AND length(record) >= 268 THEN unhex(concat(substring(hex(record), 1, 8), '02000000', substring(hex(record), 17, 8), 'FFFE', substring(hex(record), 29))) ELSE record END AS record
        FROM (SELECT seq, unhex(concat({little("pid")}, {little("(CASE WHEN seq % 40 = 9 THEN 4000000000 ELSE length(raw_path) END)")}, CASE WHEN seq % 9 = 0 THEN '01' ELSE '00' END, '000000',
            CASE WHEN seq % 50 = 7 THEN '' ELSE rpad(hex(encode(raw_path, 'utf-8')), 512, '0') END)) AS record FROM ({TABLES['open_event']})) e WHERE seq % 31 <> 3""",
    "tp_format": f"""
        SELECT host, event, rank, content FROM (
            SELECT r_regionkey AS host, event, rank, CASE WHEN r_regionkey = 3 OR (r_regionkey = 1 AND rank = 0) THEN NULL
                WHEN event = 'fork' THEN concat('name: sched_process_fork\\nformat:\\n\\tfield:unsigned short common_type;\\toffset:0;\\tsize:2;\\tsigned:0;\\n\\n\\tfield:pid_t parent_pid;\\toffset:', 8 + 4 * r_regionkey, ';\\tsize:4;\\tsigned:1;\\n',
                    CASE WHEN r_regionkey = 4 THEN '' ELSE concat('\\tfield:pid_t child_pid;\\toffset:', 16 + 4 * r_regionkey, ';\\tsize:4;\\tsigned:1;\\n') END)
                ELSE concat('    field:int __syscall_nr;    offset:8;    size:4;    signed:1;\\n    field:const char * filename;    offset: ', 24 + r_regionkey, ';    size:8;    signed:0;\\n') END AS content
            FROM {{region}} CROSS JOIN (SELECT 'fork' AS event UNION ALL SELECT 'openat') AS events CROSS JOIN (SELECT 0 AS rank UNION ALL SELECT 1) AS ranks)""",
    "raw_context": """
        SELECT seq, host, event, CASE WHEN cut THEN substring(whole, 1, 12) ELSE whole END AS record FROM (
            SELECT event_id AS seq, user_id % 5 AS host, CASE WHEN event_id % 2 = 0 THEN 'fork' ELSE 'openat' END AS event, event_id % 17 = 3 AS cut,
                CASE WHEN event_id % 2 = 0 THEN unhex(rpad(concat(repeat('AA', CAST(CASE WHEN user_id % 5 IN (3) THEN 24 ELSE 8 + 4 * (user_id % 5) END AS INT)), """ + little("user_id") + """, repeat('BB', 4), CASE WHEN user_id % 7 = 0 THEN 'FEFFFFFF' ELSE """ + little("1000 + event_id") + """ END), 200, 'CC'))
                    ELSE unhex(rpad(concat(repeat('AA', CAST(CASE WHEN user_id % 5 = 3 THEN 16 ELSE 24 + user_id % 5 END AS INT)), """ + little("event_id") + """, '01000000'), 200, '00')) END AS whole FROM {events})""",
    "proc_status": "SELECT DISTINCT 1000 + user_id AS pid, CASE WHEN user_id % 4 = 0 THEN 'Name: x' ELSE concat('Name: x\\nPPid:\\t', 1 + user_id % 7, '\\nTracerPid: 3') END AS status FROM {events}",
}
#: All lock files of a project, as one table.
LOCKS = ("cargo_lock", "package_lock", "package_lock_v1", "yarn_lock", "pipfile_lock", "poetry_lock", "requirements", "go_sum")
FILES["lock_files"] = " UNION ALL ".join(f"SELECT rel_path, content FROM ({FILES[name]}) AS {name}" for name in LOCKS)
GIVEN = ("events", "part", "supplier", "region", "nation")
_STAGED: dict = {}


def folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where a bundle table lies: written once a session, like a bundle's own Parquet; only the given tables it needs are read."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _STAGED:
        text = (TABLES | FILES)[name]
        for g in GIVEN:
            if f"{{{g}}}" in text:
                spark.read.parquet(f"{sf_dir}/{g}.parquet").createOrReplaceTempView(f"cairn_{g}")
                text = text.replace(f"{{{g}}}", f"cairn_{g}")
        _STAGED[key] = written(spark.sql(text))
    return _STAGED[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(folder(spark, sf_dir, name))


def sql(name: str) -> str:
    """The same statement over tables of their own names."""
    return "(" + TABLES[name].format(**{g: g for g in GIVEN}) + ")"
