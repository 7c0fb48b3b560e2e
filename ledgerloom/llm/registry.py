"""Queries of this subpackage: op1 to op13 over the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, filter_audit, hard_negatives, html_text, near_dedup, pii, quality_classifier, quality_rules, suffix_dedup, token_files, toxicity, url_rules
from ._store import pick, stored

#: The key of the pseudonyms in the queries; a production run passes its own secret.
KEY = "synthetic-tables"
#: The listed rules of the url query.
URL_RULES = [
    url_rules.Listed("allow", "org", "/"),
    url_rules.Listed("block", "example.org", "/es/"),
    url_rules.Listed("block", "example.org", "/en/1"),
    url_rules.Listed("allow", "com", "/fr/"),
    url_rules.Listed("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the box keeps a public tokenizer's file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymise(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), KEY, found="kinds")
    return docs.selectExpr("doc_id", "text", "cast(size(kinds) as long) as n_replaced", "array_join(kinds, ',') as kinds")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    label = F.col("label").cast("long")
    return hard_negatives.mine(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    digests = stored(out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), "repeats")
    suffix_dedup.release(out)
    return digests


#: Sets, pairs and reachability in full: for small tables only.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 80 * (p.n + q.n - m)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)
"""

AUDIT_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS f
  FROM w LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
m AS (
  SELECT part, filter_order, s.step, strpos('ABCDE', filter_order[s.step]) AS i, f, good, toxic,
    list_bool_or(list_transform(range(1, s.step), lambda j: f[strpos('ABCDE', filter_order[j])])) AS gone FROM d, s),
c AS (
  SELECT part, filter_order, step, any_value(i) AS i,
    count(*) FILTER (NOT coalesce(gone, false) AND NOT f[i]) AS kept, count(*) FILTER (NOT coalesce(gone, false) AND f[i]) AS removed,
    count(*) FILTER (coalesce(gone, false) AND f[i]) AS redundant, count(*) FILTER (f[i] AND len(list_filter(f, lambda y: y)) = 1) AS unique_fails,
    count(*) FILTER (NOT coalesce(gone, false) AND f[i] AND good) AS good_lost, count(*) FILTER (NOT coalesce(gone, false) AND f[i] AND toxic) AS toxic_lost
  FROM m GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM c
"""

NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

#: Every 50-byte string of every text, as hexadecimal digits: for small tables only.
REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
p AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY ALL),
e AS (SELECT doc_id, b AS a, lead(a, 1, NULL) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM p UNION ALL SELECT doc_id, -1, 0 FROM d)),
t AS (SELECT e.doc_id, string_agg(substring(h, CAST(2 * e.a + 1 AS BIGINT), CAST(2 * (coalesce(e.b, n) - e.a) AS BIGINT)), '' ORDER BY e.a) AS kept FROM e JOIN d USING (doc_id) GROUP BY e.doc_id),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM p GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""

QUERIES = [op1_html_text, op2_url_rules, op3_bpe_codec, op4_quality_neighbours, op5_pii_pseudonyms, op6_near_dedup, op7_line_labels, op8_decontaminate, op9_toxicity, op10_token_files, op11_filter_audit, op12_hard_negatives, op13_suffix_dedup]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """Twins of the queries whose results are defined without their methods. All others' methods or digests are beyond SQL; tests hold them against brute-force versions."""
    return {"op6_near_dedup": NEAR_SQL, "op11_filter_audit": AUDIT_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_suffix_dedup": REPEATS_SQL}
