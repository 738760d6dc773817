"""The operators' queries over whole tables, and SQL for those that SQL can express."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, decontaminate, language, near_join, neighbours, packing, prefix_trie, quality_rules, secrets, sharding, suffix_dedup, turn_repair, wavelet
from .common import shared_dir
from .stages import held_out

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
CONTROL = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_profiles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identified(docs, held_out(3, 1)(F.col("doc_id")))


def op2_chat_masks(spark, sf_dir):
    columns = ["conv_id", "turn", "role", "text"]
    given = table(spark, sf_dir, "conversations").select(*columns)
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path(BYTE_BPE)
    return chat.digests(chat.formatted(given.unionByName(extra), path), path)


def op3_bounded_ring(spark, sf_dir):
    rows = sharding.sharded(table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_chosen_path_join(spark, sf_dir):
    return near_join.classed(table(spark, sf_dir, "documents"))


def op5_sum_of_squares(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_suffix_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark, sf_dir):
    done = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_neighbour_voting(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    voters = neighbours.fitted(docs, table(spark, sf_dir, "labels"), held_out(5, 0))
    return neighbours.scored(docs, voters, held_out(5, 0))


def op9_wavelet_shards(spark, sf_dir):
    path = f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE))
    return wavelet.read_documents(spark, path)


def op10_likelihood_ratio(spark, sf_dir):
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("score")


def op11_burst_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_target_alignment(spark, sf_dir):
    done = turn_repair.repaired(turn_repair.damaged(table(spark, sf_dir, "conversations")))
    return done.select("conv_id", *turn_repair.FIGURES, "audit", F.sha2(turn_repair.lines("turns"), 256).alias("repaired_sha256"))


def op13_assignment_lexing(spark, sf_dir):
    spans = F.col("spans")
    counts = [F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    base = secrets.joined(F.filter(spans, lambda s: s["kind"] != "literal"))
    return secrets.found(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secrets.joined(spans).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_language_profiles, op2_chat_masks, op3_bounded_ring, op4_chosen_path_join, op5_sum_of_squares, op6_suffix_decontamination, op7_suffix_dedup, op8_neighbour_voting, op9_wavelet_shards, op10_likelihood_ratio, op11_burst_trie, op12_target_alignment, op13_assignment_lexing)}
QUERIES["pipeline"] = corpus_pipeline.run



def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a short ASCII text, bit by bit."""
    steps = f"list_transform(range(8 * length({text})), lambda k: CASE WHEN k % 8 = 0 THEN CAST(ascii(substr({text}, CAST(k // 8 AS INTEGER) + 1, 1)) AS BIGINT) ELSE 0 END)"
    return f"xor(list_reduce({steps}, lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295), 4294967295)"


SQL = {
    "op2_chat_masks": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (SELECT *,
                length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) AS text_size,
                length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g')) AS role_size FROM turns)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(text_size + role_size + length('<|turn|><|text|><|end|>') + 1)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op6_suffix_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        sizes AS (SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS key
            FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
        places AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS key
            FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
        found AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x USING (n, key)),
        hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_burst_trie": f"""
        WITH t AS (SELECT conv_id AS c, turn, sha256(length(r) || ':' || r || x)[1:32] AS token, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words
            FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
        own AS (SELECT c, token, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, token, words) AS i FROM t),
        ids AS (SELECT c, c - c % 20 AS b, {crc32_sql('CAST(c AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT c FROM own)),
        made AS (SELECT ids.c, i, token, words FROM ids JOIN own ON own.c = ids.b WHERE i <= h UNION ALL SELECT ids.c, i, token, words FROM ids JOIN own ON own.c = ids.c WHERE i > h),
        steps AS (SELECT c, row_number() OVER w AS d, string_agg(token, '') OVER (w ROWS UNBOUNDED PRECEDING) AS p, words FROM made WINDOW w AS (PARTITION BY c ORDER BY i)
            UNION ALL SELECT c, 0, '', 0 FROM ids),
        ends AS (SELECT p, string_agg(c, ',' ORDER BY c) AS e FROM (SELECT c, arg_max(p, d) AS p FROM steps GROUP BY c) GROUP BY p),
        nodes AS (SELECT p, d, min(c) AS c, count(*) AS n, any_value(words) AS words FROM steps GROUP BY p, d),
        kids AS (SELECT p[:length(p) - 32] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
        sums AS (SELECT s.p, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (k.k IS NULL) AS leaves
            FROM nodes n LEFT JOIN kids k USING (p) JOIN steps s ON s.c = n.c AND s.d <= n.d GROUP BY s.p)
        SELECT n.c AS conv_id, n.d AS depth, up.c AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.e, '')) AS ends_sha256
        FROM nodes n JOIN sums s USING (p) LEFT JOIN kids k USING (p) LEFT JOIN ends e USING (p) LEFT JOIN nodes up ON n.d > 0 AND up.p = n.p[:length(n.p) - 32]""",
    "op12_target_alignment": f"""
        WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
        rows AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM given, LATERAL (SELECT unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows),
        faulty AS (SELECT *, CASE WHEN role = '' THEN ' ' ELSE role[1] END AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
        pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM faulty),
        counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
            count_if(fault = 'truncated') AS truncated, count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
        edits(op, price) AS (VALUES ('D', 3), ('K', 0), ('R', 2)),
        added(ins) AS (VALUES (''), ('I'), ('II')),
        best(conv_id, i, state, cost, audit, body) AS (
            SELECT conv_id, 0, s, c, a, b FROM (SELECT DISTINCT conv_id FROM counts), (VALUES ('', 0, '', ''), ('u', 2, 'I', 'user:' || chr(10)), ('a', 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))) t(s, c, a, b)
            UNION ALL
            SELECT conv_id, i, state, v.cost, v.audit, v.body FROM (
                SELECT conv_id, i, state, arg_min(struct_pack(cost := cost, audit := audit, body := body), struct_pack(cost := cost, audit := audit)) AS v FROM (
                    SELECT conv_id, i, CASE ins WHEN '' THEN st WHEN 'I' THEN CASE st WHEN 'u' THEN 'a' ELSE 'u' END ELSE CASE st WHEN 'u' THEN 'u' ELSE 'a' END END AS state, cost + 2 * length(ins) AS cost, audit || ins AS audit,
                        body || CASE ins WHEN '' THEN '' WHEN 'I' THEN CASE st WHEN 'u' THEN 'assistant:' ELSE 'user:' END || chr(10)
                            ELSE CASE st WHEN 'u' THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END || chr(10) END AS body
                    FROM (SELECT b.conv_id, r.i, e.op, CASE e.op WHEN 'D' THEN b.state WHEN 'K' THEN r.initial ELSE CASE b.state WHEN 'u' THEN 'a' ELSE 'u' END END AS st,
                            b.cost + e.price + CASE WHEN e.op <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END AS cost, b.audit || e.op AS audit,
                            b.body || CASE e.op WHEN 'D' THEN '' WHEN 'K' THEN r.role || ':' || r.text || chr(10) ELSE CASE b.state WHEN 'u' THEN 'assistant:' ELSE 'user:' END || r.text || chr(10) END AS body
                        FROM best b JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1 CROSS JOIN edits e
                        WHERE e.op = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (e.op = 'R' OR (r.initial = 's' AND b.state = '') OR (r.initial = 'u' AND b.state <> 'u') OR (r.initial = 'a' AND b.state = 'u')))), added)
                GROUP BY conv_id, i, state)),
        ended AS (SELECT b.conv_id, arg_min(struct_pack(cost := cost, audit := audit, body := body), struct_pack(cost := cost, audit := audit)) AS v
            FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i WHERE b.state IN ('', 'a') GROUP BY b.conv_id)
        SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
            CAST(coalesce(e.v.cost, 0) AS BIGINT) AS cost, coalesce(e.v.audit, '') AS audit, sha256(coalesce(e.v.body[:length(e.v.body) - 1], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
