"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire.llm import (
    attribution, byte_codec, decontamination, hilbert, interaction, kneser_ney, neardup, outliers, packing, pages, pieces, repair, replies,
)
from tidewire.llm.common import table, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[plan.__name__] = plan
    return plan


@_query
def op1_kneser_ney_quality(spark: SparkSession, folder: str) -> DataFrame:
    model = kneser_ney.QualityModel(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return model.judged().drop("row_key")


@_query
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.digests(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE["op2_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, w[i:i + n - 1] AS win FROM (SELECT item, w, least(len(w), 10) AS n,
         unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM (SELECT doc_id, w, n,
         unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
h AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


@_query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


@_query
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.NearDuplicates(table(spark, folder, "documents"), size=2).result()
    return found.select("doc_id", "n_shingles", "component_id",
                        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE["op4_near_duplicates"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i
        FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
pairs AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, pairs.b FROM r JOIN pairs ON pairs.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.low AS component_id, d.doc_id = m.low AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(node) AS low FROM r GROUP BY 1) m ON m.doc_id = d.doc_id
"""


@_query
def op5_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert.sharded(table(spark, folder, "documents"))


@_query
def op6_token_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document; tokens over a line end go by ``most``."""
    return attribution.attributed(
        table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), rule="most")


@_query
def op7_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.judged(table(spark, folder, "documents")).drop("row_key")


@_query
def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.extracted(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@_query
def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@_query
def op10_reply_order(spark: SparkSession, folder: str) -> DataFrame:
    return replies.reply_ordered(table(spark, folder, "conversations"))


@_query
def op11_filter_interaction(spark: SparkSession, folder: str) -> DataFrame:
    audit = interaction.InteractionAudit(spark, f"{folder.rstrip('/')}/documents.parquet", table(spark, folder, "labels"))
    return audit.update().result()


ORACLE["op11_filter_interaction"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT '' AS filter_order, 0 AS seen UNION ALL
      SELECT filter_order || chr(65 + i), seen | (1 << i) FROM o, (SELECT unnest([0, 1, 2, 3, 4]) AS i) WHERE (seen >> i) & 1 = 0),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
         CAST(coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))), 0) AS INT) AS before
      FROM (SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS step FROM o WHERE length(filter_order) = 5)),
r AS (SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n * good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


@_query
def op12_lightest_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.Repair(table(spark, folder, "conversations")).result()


ORACLE["op12_lightest_repair"] = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
       coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
m AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(key) + 1),
         lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b),
         CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM m WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
         WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
moves(p, ins, mid) AS (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2),
         (2, 'I', 3), (3, '', 3), (3, 'I', 2)),
acts(mid, letter, initial, q, price) AS (VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0),
         (3, 'K', 'u', 2, 0), (0, 'R', NULL, 2, 3), (1, 'R', NULL, 2, 3), (2, 'R', NULL, 3, 3), (3, 'R', NULL, 2, 3),
         (0, 'D', NULL, 0, 4), (1, 'D', NULL, 1, 4), (2, 'D', NULL, 2, 4), (3, 'D', NULL, 3, 4)),
ids AS (SELECT DISTINCT conv_id FROM conversations),
st AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM ids
  UNION ALL
  SELECT conv_id, n, state, cost, audit FROM (
    SELECT st.conv_id, f.n, acts.q AS state, st.cost + 3 * len(ins) + price + CASE WHEN fault = 't' AND letter <> 'D' THEN 3 ELSE 0 END AS cost,
           st.audit || ins || letter AS audit, row_number() OVER (PARTITION BY st.conv_id, acts.q ORDER BY
           st.cost + 3 * len(ins) + price + CASE WHEN fault = 't' AND letter <> 'D' THEN 3 ELSE 0 END, st.audit || ins || letter) AS place
    FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.n = st.n + 1 JOIN moves ON moves.p = st.state
    JOIN acts ON acts.mid = moves.mid AND (acts.initial IS NULL OR acts.initial = f.initial)
    WHERE letter = 'D' OR fault NOT IN ('b', 'd')) WHERE place = 1),
tail(state, fin, price) AS (VALUES (0, '', 0), (1, 'II', 6), (2, 'I', 3), (3, '', 0)),
size_of AS (SELECT conv_id, max(n) AS n FROM st GROUP BY 1),
best AS (SELECT conv_id, cost, audit FROM (SELECT st.conv_id, cost + price AS cost, audit || fin AS audit, row_number() OVER (
           PARTITION BY st.conv_id ORDER BY cost + price, audit || fin) AS place FROM st JOIN tail USING (state)
           JOIN size_of s ON s.conv_id IS NOT DISTINCT FROM st.conv_id AND s.n = st.n) WHERE place = 1),
letters AS (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS i, audit FROM best),
used AS (SELECT *, substr(audit, i, 1) AS letter, count(*) FILTER (WHERE substr(audit, i, 1) <> 'I') OVER (
           PARTITION BY conv_id ORDER BY i) AS n FROM letters),
kept AS (SELECT used.conv_id, i, letter, role, text, count(*) FILTER (WHERE letter <> 'K' OR f.initial <> 's') OVER (
           PARTITION BY used.conv_id ORDER BY i) AS turn_no FROM used LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM used.conv_id
           AND f.n = used.n AND letter <> 'I' WHERE letter <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN turn_no % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
           CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS body FROM kept GROUP BY 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
           count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
           count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


@_query
def op13_byte_codec(spark: SparkSession, folder: str) -> DataFrame:
    return byte_codec.digests(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))
