"""The registered queries of this package, with SQL where SQL can give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.support import scratch_root, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add


@query("op5_token_counts")
def token_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.token_counts import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op8_token_files")
def token_file_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.token_files import read_token_files, write_token_files

    folder = f"{scratch_root(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


@query("op1_best_fit_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op10_exact_top_k", TOP_K_SQL)
def top_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)



DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, i, i + least(13, len(w)) - 1) AS g
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), m AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m) x, unnest(range(x.i, x.i + x.n)) AS t(p) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) y GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


@query("op6_benchmark_decontamination", DECONTAMINATION_SQL)
def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def fold(column: str, n: int):
    """crc32 of an id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


@query("op2_language_id")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.language import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, use=fold("id", 3) != 1)
    judged = identify(docs, model, keep=["doc_id"])
    return judged.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "lang_share")


@query("op4_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), use=fold("id", 5) != 0)
    judged = score(docs, model, keep=["doc_id"])
    return judged.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op7_class_lm_scores")
def class_lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.class_lm import train_and_score

    scored = train_and_score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return scored.select(
        "doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op9_html_extraction")
def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.html_tree import extract_text

    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i, i + 4) END AS g
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id WHERE a.g IN (SELECT g FROM f) GROUP BY ALL
), l AS (
  SELECT x, y FROM c JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= 75 * (a.n + b.n - k)
), r AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION
  SELECT l.y, r.root FROM r JOIN l ON r.id = l.x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY id) m ON m.id = d.doc_id
"""


@query("op3_ngram_jaccard_join", JACCARD_SQL)
def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op11_hard_negatives", HARD_NEGATIVES_SQL)
def hard_negative_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label, every=100, positives=5, negatives=5, low=80, high=100)


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 15) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT *, CASE k % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS w FROM s
), o AS (
  SELECT *, sum(n) OVER () AS total, sum(w) OVER () AS weights,
    coalesce(sum(3 * n) OVER before, 0) AS n_before, coalesce(sum(w) OVER before, 0) AS w_before
  FROM w WINDOW before AS (ORDER BY n * (10 // w), k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, (total - n_before) * w > 3 * n * (weights - w_before) AS stops FROM o
), l AS (
  SELECT *, total - coalesce(sum(3 * n) FILTER (WHERE stops) OVER (), 0) AS rest,
    weights - coalesce(sum(w) FILTER (WHERE stops) OVER (), 0) AS left_weight FROM c
), t AS (
  SELECT source, n, CASE WHEN stops THEN CAST(3 * n AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / CAST(left_weight AS DOUBLE) END AS target,
    CASE WHEN stops THEN 3 * n ELSE (w * rest) // left_weight END AS budget FROM l
), p AS (
  SELECT d.*, t.n, t.target, t.budget, CASE WHEN t.n > 0 THEN t.budget // t.n ELSE 0 END AS passes,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
  CAST(passes * size + greatest(0, least(size, budget - passes * n - size_before)) AS BIGINT) AS taken FROM p
"""


@query("op12_source_mixing", MIXING_SQL)
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults by a hash of conversation and turn; nulls are one space. A
    dropped row stays as one that only names its conversation."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("fault"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("absent"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


# Every state keeps its cheapest edits as a struct, so the least struct is the cheapest,
# then first in ASCII order.
REPAIR_SQL = r"""
WITH RECURSIVE h AS (
  SELECT *, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' ||
      coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
      lambda a, b: xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1)) + b)) AS crc
  FROM conversations
), f AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(crc, CAST(4294967295 AS BIGINT)) % 20 AS fault FROM h
), d AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, row_number() OVER () AS u,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM f, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)
), n AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS earlier, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS core
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, u)
), o AS (
  SELECT *, min(i) OVER (PARTITION BY conv_id, role, text) < i AS again FROM n
), r AS MATERIALIZED (
  SELECT *, core = '' AS blank, core <> '' AND again AS duplicate,
    core <> '' AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') AS cut, substr(role, 1, 1) AS letter FROM o
), ids AS (SELECT DISTINCT conv_id FROM conversations),
p AS (
  SELECT conv_id, 0 AS i, {'c': 0, 'a': '', 't': ''} AS s0, {'c': 1000000, 'a': '', 't': ''} AS s1,
    {'c': 2, 'a': 'I', 't': 'user:'} AS s2, {'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'} AS s3 FROM ids
  UNION ALL
  SELECT conv_id, i, s0, s1, least(s2, {'c': s3.c + 2, 'a': s3.a || 'I', 't': s3.t || chr(10) || 'user:'}), s3 FROM (
    SELECT conv_id, i, s0, s1, s2, least(s3, {'c': s2.c + 2, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'}) AS s3 FROM (
      SELECT conv_id, i, s0, s1, least(s2, {'c': s0.c + 2, 'a': s0.a || 'I', 't': 'user:'},
        {'c': s1.c + 2, 'a': s1.a || 'I', 't': s1.t || chr(10) || 'user:'}) AS s2, s3 FROM (
        SELECT p.conv_id, r.i,
          {'c': s0.c + 3, 'a': s0.a || 'D', 't': s0.t} AS s0,
          least({'c': s1.c + 3, 'a': s1.a || 'D', 't': s1.t},
            {'c': CASE WHEN letter = 's' AND NOT gone THEN s0.c + cut ELSE 1000000 END, 'a': s0.a || 'K', 't': line}) AS s1,
          least({'c': s2.c + 3, 'a': s2.a || 'D', 't': s2.t},
            {'c': CASE WHEN letter = 'u' AND NOT gone THEN s0.c + cut ELSE 1000000 END, 'a': s0.a || 'K', 't': line},
            {'c': CASE WHEN letter = 'u' AND NOT gone THEN s1.c + cut ELSE 1000000 END, 'a': s1.a || 'K', 't': s1.t || chr(10) || line},
            {'c': CASE WHEN letter = 'u' AND NOT gone THEN s3.c + cut ELSE 1000000 END, 'a': s3.a || 'K', 't': s3.t || chr(10) || line},
            {'c': CASE WHEN gone THEN 1000000 ELSE s0.c + 2 + cut END, 'a': s0.a || 'R', 't': 'user:' || text},
            {'c': CASE WHEN gone THEN 1000000 ELSE s1.c + 2 + cut END, 'a': s1.a || 'R', 't': s1.t || chr(10) || 'user:' || text},
            {'c': CASE WHEN gone THEN 1000000 ELSE s3.c + 2 + cut END, 'a': s3.a || 'R', 't': s3.t || chr(10) || 'user:' || text}) AS s2,
          least({'c': s3.c + 3, 'a': s3.a || 'D', 't': s3.t},
            {'c': CASE WHEN letter = 'a' AND NOT gone THEN s2.c + cut ELSE 1000000 END, 'a': s2.a || 'K', 't': s2.t || chr(10) || line},
            {'c': CASE WHEN gone THEN 1000000 ELSE s2.c + 2 + cut END, 'a': s2.a || 'R', 't': s2.t || chr(10) || 'assistant:' || text}) AS s3
        FROM p JOIN (SELECT conv_id, i, text, letter, role || ':' || text AS line, blank OR duplicate AS gone, CAST(cut AS INTEGER) AS cut FROM r) r
          ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = p.i + 1)))
), e AS (
  SELECT conv_id, least(s0, s3) AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM p) WHERE back = 1
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
    count_if(cut) AS truncated, count_if(i > 1 AND substr(earlier, 1, 1) || letter NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256
FROM ids LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM ids.conv_id JOIN e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


@query("op13_conversation_repair", REPAIR_SQL)
def repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.conversations import repair_report

    return repair_report(damaged(table(spark, sf_dir, "conversations")), absent="absent")
