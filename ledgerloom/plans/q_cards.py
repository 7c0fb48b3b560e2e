"""Queries of merging, matching, ranking and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, matching, ranking, registry
from ..operators.gates import INTERN
from .views import choice, table

FRIENDS = ("idiot", "clown", "absent term")
TERMS = ("the", "de", "und", "license", "the")
SUFFIXES = ("intern", "internship", "stage")


def card_merge(spark: SparkSession, d: str) -> DataFrame:
    """Line items as observations of the posting l_partkey, in the order of order and line."""
    url = F.concat(F.lit("https://x.test/"), "l_partkey", F.lit("?s="), (F.col("l_suppkey") % 3).cast("string"))
    cards = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("key"),
        (F.col("l_orderkey") * 100000000000 + F.col("l_linenumber") * 10000000000 + F.col("l_suppkey") * 1000000 + F.round(F.col("l_extendedprice") * 100).cast("long") % 1000000).alias("ord"),
        url.alias("url"),
        F.repeat(F.lit("s"), (F.col("l_quantity").cast("int")) % 7).alias("snippet"),
        F.concat(F.lit("q"), (F.col("l_suppkey") % 12).cast("string")).alias("discoveryQuery"),
        F.array().cast("array<string>").alias("alternateUrls"),
    )
    out = dedup.merge_cards(cards)
    return out.select("key", "url", F.length("snippet").cast("long").alias("snippet_chars"), F.col("discoveryQuery").alias("queries"), F.array_join(F.array_sort("alternateUrls"), " ").alias("alternates"), F.col("n_merged").cast("long").alias("n_merged"))


def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("company"), F.col("p_name").alias("title"), choice(F.col("p_partkey"), ("Milano, Italia", "Milan, Italy", "Rome")).alias("location"))
    out = dedup.near_duplicates(p)
    return out.select("near_key", "n", F.array_join(F.transform("ords", lambda x: x.cast("string")), ",").alias("ords"))


def history_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Orders of 1999 on against earlier ones: company = customer, url by price, role by priority."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("norm_company"), (F.floor(F.col("o_totalprice") / 5000)).alias("url_norm"), F.col("o_orderpriority").alias("role_key"), F.year("o_orderdate").alias("y"))
    old = o.filter("y < 1999")
    new = o.filter("y >= 1999").drop("y")
    return matching.history_verdict(new, old, old.filter("role_key like '1%'")).select("o_orderkey", "reason", "company_known")


def match_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Customers against parts by id, name and alias; names repeat, ids are sometimes shared or absent."""
    k = F.col("c_custkey")
    names = tuple(f"{a} {b}" for a in ("small", "red", "blue") for b in ("ring", "widget", "sprocket"))
    incoming = table(spark, d, "customer").select(k.alias("in_id"), F.when(k % 3 == 0, (k % 400).cast("string")).when(k % 3 == 1, "").alias("ext_id"), F.when(k % 5 == 0, F.concat(F.lit("firm "), (k % 250).cast("string"))).when(k % 5 == 1, F.concat(F.lit("aka "), (k % 90).cast("string"))).otherwise(choice(k, names)).alias("norm"))
    p = F.col("p_partkey")
    canon = table(spark, d, "part").select(p.alias("idx"), F.when(p < 300, p.cast("string")).when(p < 320, (p - 300).cast("string")).alias("ext_id"), F.when(p < 200, F.concat(F.lit("firm "), p.cast("string"))).otherwise(F.col("p_name")).alias("norm"))
    aliases = table(spark, d, "supplier").select(F.concat(F.lit("aka "), F.col("s_suppkey").cast("string")).alias("alias_norm"), F.col("s_suppkey").cast("string").alias("ext_id"))
    return matching.match_ladder(incoming, canon, aliases).select("in_id", "rung", "kind", "matched_idx")


def fuzzy_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Names of eight words with one word changed, and names that begin others."""
    p = F.col("p_partkey")
    long = F.concat_ws(" ", F.lit("a b c d e f"), "p_name", F.concat(F.lit("w"), (p % 9).cast("string")))
    left = table(spark, d, "part").select(F.when(p % 10 == 0, F.col("p_name")).otherwise(long).alias("norm"))
    right = table(spark, d, "part").select(F.when(p % 7 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(long).alias("norm")).filter("length(norm) > 3")
    return matching.fuzzy_candidates(left, right).select("l_norm", "r_norm", F.round("ratio", 6).alias("ratio"))


def identity_index(spark: SparkSession, d: str) -> DataFrame:
    return matching.unique_index(table(spark, d, "part").withColumnRenamed("p_partkey", "idx"), "p_name").withColumnRenamed("idx", "first_idx")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 9 == 0, "Design internship").otherwise("Report").alias("title"))
    return ranking.with_score(docs, F.col("title"), F.col("text"), list(FRIENDS), list(TERMS)).select("doc_id", "score", "reasons")


def prefilter_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.round("score", 9).alias("score"), F.array_join("reasons", ";").alias("reasons"))


def prefilter_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    return ranking.split_top(scored, 100, [F.col("score").desc(), F.col("doc_id")], "doc_id").select("doc_id", "top")


def false_friend_hits(spark: SparkSession, d: str) -> DataFrame:
    return ranking.term_hits(table(spark, d, "documents"), F.coalesce("text", F.lit("")), list(FRIENDS))


def fanout_roundrobin(spark: SparkSession, d: str) -> DataFrame:
    areas = table(spark, d, "nation").select(F.col("n_regionkey").alias("area"), F.col("n_regionkey").alias("area_ord"), F.lower("n_name").alias("term"), F.col("n_nationkey").alias("term_ord"))
    return ranking.fan_out(areas, list(SUFFIXES)).select("query", "area", F.col("turn").cast("long").alias("turn"))


def tag_areas(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    where = F.concat(choice(k, ("design intern", "design intern ux", "ux stage")), F.lit(" — Milan"), F.when(k % 2 == 0, F.concat(F.lit(" + "), choice(F.floor(k / 3), ("ux stage", "other")))).otherwise(""))
    areas, queries = ranking.tag(where, [("design intern", "A"), ("design intern ux", "B"), ("ux stage", "B"), ("ux stage", "C")])
    return table(spark, d, "customer").select("c_custkey", F.array_join(areas, ",").alias("areas"), F.array_join(queries, ",").alias("queries"))


def _companies(spark: SparkSession, d: str) -> DataFrame:
    roles = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.round("o_totalprice").cast("long").cast("string").alias("score"))
    all_ = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "score")))
    from ..functions.cells import number_items

    return roles.groupBy("o_custkey").agg(all_.alias("a")).select(
        "o_custkey",
        number_items(F.transform("a", lambda x: F.concat(F.lit("Role "), x["o_orderkey"].cast("string")))).alias("Matching Job Titles"),
        number_items(F.transform("a", lambda x: x["score"])).alias("Matching Score"),
        F.lit("Milan").alias("Locations"),
        F.lit("").alias("Job Links"),
    )


def explode_roles(spark: SparkSession, d: str) -> DataFrame:
    out = registry.explode_roles(_companies(spark, d), "o_custkey")
    return out.select("o_custkey", F.col("i").cast("long").alias("i"), "role_title", F.col("role_Matching Score").alias("score"), F.col("role_Locations").alias("place"))


def company_rollup_numbered(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "pertinente").otherwise("adiacente").alias("label"), F.round("o_totalprice").alias("score"), F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("theme"))
    return registry.regroup(o, "o_custkey", "label", "score", "o_orderkey", ["title"], ["theme"]).select("o_custkey", F.col("n_roles").cast("long").alias("n_roles"), F.col("best_rank").cast("long").alias("best_rank"), "best_score", "title", "theme")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Customers planned by nation; those with an order over 400000 count as searched."""
    planned = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("area"))
    done = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("key"))
    return registry.coverage(planned, done, "key", "area")


def harvest_delta(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    was = o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit("n").alias("note"))
    now = o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.date_format(F.when(F.col("o_orderkey") % 15 == 0, F.lit("2020-01-02").cast("timestamp")).otherwise(F.col("o_orderdate").cast("timestamp")), "dd/MM/yyyy").alias("day"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("n").alias("note"))
    return matching.value_changes(was, now, "o_orderkey", ["status", "day", "note"], ("day",))


def append_only(spark: SparkSession, d: str) -> DataFrame:
    ladder = match_ladder(spark, d)
    incoming = table(spark, d, "customer").select(F.col("c_custkey").alias("in_id"), "c_name")
    new, later = registry.append_only(incoming, ladder)
    return new.select("in_id", F.lit("added").alias("fate")).unionByName(later.select("in_id", F.lit("deferred").alias("fate")))


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Parts as previous roles with two urls each; the urls of small parts are taken."""
    p = table(spark, d, "part")
    prev = p.select(F.col("p_partkey").alias("role_id"), F.array(F.concat_ws("/", "p_name", "p_brand"), F.col("p_partkey").cast("string")).alias("urls"))
    taken = p.filter("p_size < 3").select(F.concat_ws("/", "p_name", "p_brand").alias("url"))
    return registry.carry_forward(prev, taken).select("role_id")


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    out = registry.first_seen(k % 3 == 0, F.lit("2026-01-01"), F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(""), F.lit("2025-12-31"))
    return table(spark, d, "orders").select("o_orderkey", out.alias("first_seen"))


def enrich_roles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    roles = table(spark, d, "part").select(k.alias("role_id"), (k % 150).alias("url_norm"), F.when(k % 2 == 0, F.col("p_brand")).otherwise(" ").alias("posted"))
    sup = table(spark, d, "supplier")
    evidence = sup.select(F.col("s_suppkey").alias("url_norm"), F.col("s_name").alias("posted"))
    checks = sup.filter("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("url_norm"), F.lit("Employer verified active").alias("status"))
    return registry.enrich(roles, evidence, checks).select("role_id", "posted", "check_status")


def seed_columns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.concat_ws("/", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 40).cast("string")).alias("norm"), F.when(F.col("c_custkey") % 3 == 0, "mine").otherwise("").alias("owner"))
    s = table(spark, d, "supplier").select(F.concat_ws("/", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 40).cast("string")).alias("norm"), F.col("s_name").alias("owner"))
    return registry.seed(c, s, "norm", ["owner"]).select("c_custkey", "owner")


def evidence_fill(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(" ").alias("posted"), F.lit("").alias("search_query"), F.col("p_brand").alias("url"))
    return registry.evidence_fill(p, ["posted", "search_query", "url"])


def status_census(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(choice(F.col("o_orderkey"), ("New job found", "To contact", "Contacted", "??")).alias("status"))
    return registry.census(o, "status", registry.STATUSES, {"To contact": "Not started"})


def migrate_review(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("Name"), choice(F.col("c_custkey"), ("To contact", "Contacted")).alias("Status"), F.col("c_mktsegment").alias("Gone"))
    out, _ = registry.migrate(old, ["id", "Company", "Status", "Recall"], {"Name": "Company"}, {"Status": {"To contact": "Not started"}})
    return out.select("id", F.col("Company").alias("company"), F.col("Status").alias("status"), F.col("Recall").alias("recall"))


def union_latest(spark: SparkSession, d: str) -> DataFrame:
    """Two logs of statuses in one; the later source wins."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    a = c.filter(k % 2 == 0).select(k.alias("key"), F.lit("old").alias("status"), F.lit(1).alias("src"))
    b = c.filter(k % 3 == 0).select(k.alias("key"), F.lit("new").alias("status"), F.lit(2).alias("src"))
    return dedup.latest(a.unionByName(b), "key", "src").select("key", "status")


_FIRM = "CASE WHEN c_custkey % 5 = 0 THEN 'firm ' || (c_custkey % 250) WHEN c_custkey % 5 = 1 THEN 'aka ' || (c_custkey % 90) ELSE ['small ring', 'small widget', 'small sprocket', 'red ring', 'red widget', 'red sprocket', 'blue ring', 'blue widget', 'blue sprocket'][CAST(c_custkey % 9 AS INT) + 1] END"
_LADDER = f"""WITH i AS (SELECT c_custkey AS in_id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 400 AS VARCHAR) WHEN c_custkey % 3 = 1 THEN '' END AS ext_id, {_FIRM} AS norm FROM customer),
  c AS (SELECT p_partkey AS idx, CASE WHEN p_partkey < 300 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey < 320 THEN CAST(p_partkey - 300 AS VARCHAR) END AS ext_id, CASE WHEN p_partkey < 200 THEN 'firm ' || p_partkey ELSE p_name END AS norm FROM part),
  ids AS (SELECT ext_id, count(*) AS n, min(idx) AS idx FROM c WHERE ext_id IS NOT NULL GROUP BY 1), nm AS (SELECT norm, count(*) AS n, min(idx) AS idx FROM c GROUP BY 1),
  al AS (SELECT 'aka ' || s_suppkey AS norm, sum(n) AS n, min(idx) AS idx FROM supplier JOIN ids ON ids.ext_id = CAST(s_suppkey AS VARCHAR) GROUP BY 1),
  j AS (SELECT in_id, coalesce(i.ext_id, '') <> '' AS has_id, ids.n AS id_n, ids.idx AS id_idx, nm.n AS nm_n, nm.idx AS nm_idx, al.n AS al_n, al.idx AS al_idx FROM i LEFT JOIN ids USING (ext_id) LEFT JOIN nm USING (norm) LEFT JOIN al USING (norm)),
  r AS (SELECT in_id, CASE WHEN has_id THEN 'id' WHEN nm_n IS NOT NULL THEN 'name' WHEN al_n IS NOT NULL THEN 'alias' ELSE 'none' END AS rung, CASE WHEN has_id THEN coalesce(id_n, 0) ELSE coalesce(nm_n, al_n, 0) END AS n,
    CASE WHEN has_id THEN id_idx WHEN nm_n IS NOT NULL THEN nm_idx ELSE al_idx END AS idx FROM j),
  l AS (SELECT in_id, rung, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 AND rung = 'id' THEN 'ambiguous' WHEN n > 1 THEN 'needs_human' ELSE 'unmatched' END AS kind, CASE WHEN n = 1 THEN idx END AS matched_idx FROM r)"""
_SCORED = r"""(SELECT doc_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN doc_id % 9 = 0 THEN 0.3::DOUBLE WHEN regexp_matches(text, '(?i)\b(?:{intern})\b') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
  - CASE WHEN regexp_matches(text, '(?i)\b(?:idiot|clown|absent term)\b') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + h / 5.0::DOUBLE * 0.25::DOUBLE)) AS score,
  array_to_string(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'intern-signal-in-title' WHEN regexp_matches(text, '(?i)\b(?:{intern})\b') THEN 'intern-signal-in-snippet' END,
    CASE WHEN regexp_matches(text, '(?i)\bidiot\b') THEN 'false-friend:idiot' WHEN regexp_matches(text, '(?i)\bclown\b') THEN 'false-friend:clown' END, CASE WHEN h > 0 THEN 'query-terms:' || h || '/5' END], lambda x: x IS NOT NULL), ';') AS reasons
  FROM (SELECT doc_id, coalesce(text, '') AS text, 2 * regexp_matches(coalesce(text, ''), '(?i)(?:^|[^A-Za-z0-9_])the(?:$|[^A-Za-z0-9_])')::INT + regexp_matches(coalesce(text, ''), '(?i)(?:^|[^A-Za-z0-9_])de(?:$|[^A-Za-z0-9_])')::INT
    + regexp_matches(coalesce(text, ''), '(?i)(?:^|[^A-Za-z0-9_])und(?:$|[^A-Za-z0-9_])')::INT + regexp_matches(coalesce(text, ''), '(?i)(?:^|[^A-Za-z0-9_])license(?:$|[^A-Za-z0-9_])')::INT AS h FROM documents))"""


_SCORED = _SCORED.replace("{intern}", INTERN)
_LONG = "'a b c d e f ' || p_name || ' w' || (p_partkey % 9)"
_ORDERED = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS m, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS score FROM orders"

SQL = {
    "card_merge": """WITH c AS (SELECT l_partkey AS key, l_orderkey * 100000000000 + l_linenumber * 10000000000 + l_suppkey * 1000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 1000000 AS ord,
        'https://x.test/' || l_partkey || '?s=' || (l_suppkey % 3) AS url, CAST(l_quantity AS INT) % 7 AS len, 'q' || (l_suppkey % 12) AS q FROM lineitem),
      g AS (SELECT key, arg_min(url, ord) AS url, CAST(max(len) AS BIGINT) AS snippet_chars, list_reduce(list(q ORDER BY ord), lambda s, x: CASE WHEN contains(s, x) THEN s ELSE s || ' + ' || x END) AS queries, list_distinct(list(url)) AS urls, count(*) - 1 AS n_merged FROM c GROUP BY key)
      SELECT key, url, snippet_chars, queries, array_to_string(list_sort(list_filter(urls, lambda u: u <> url)), ' ') AS alternates, n_merged FROM g""",
    "near_duplicates": """SELECT near_key, count(*) AS n, array_to_string(list(k ORDER BY k), ',') AS ords FROM (SELECT p_partkey AS k, 'x:' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) || '|' || p_name || '|' || CASE WHEN p_partkey % 3 < 2 THEN 'milan' ELSE 'rome' END AS near_key FROM part) GROUP BY 1 HAVING count(*) > 1""",
    "history_antijoin": """WITH o AS (SELECT o_orderkey, o_custkey AS c, CAST(floor(o_totalprice / 5000) AS BIGINT) AS u, o_orderpriority AS r, year(o_orderdate) AS y FROM orders), h AS (SELECT * FROM o WHERE y < 1999)
      SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.c = o.c AND h.u = o.u) THEN 'same URL in history' WHEN EXISTS (SELECT 1 FROM h WHERE h.c = o.c AND h.r = o.r AND h.r LIKE '1%') THEN 'same company+title+location in history' END AS reason,
      EXISTS (SELECT 1 FROM h WHERE h.c = o.c) AS company_known FROM o WHERE y >= 1999""",
    "match_ladder": _LADDER + " SELECT in_id, rung, kind, matched_idx FROM l",
    "append_only": _LADDER + " SELECT in_id, CASE WHEN kind = 'unmatched' THEN 'added' ELSE 'deferred' END AS fate FROM l WHERE kind <> 'matched'",
    "fuzzy_candidates": f"""WITH l AS (SELECT DISTINCT CASE WHEN p_partkey % 10 = 0 THEN p_name ELSE {_LONG} END AS n FROM part), r AS (SELECT DISTINCT CASE WHEN p_partkey % 7 = 0 THEN split_part(p_name, ' ', 1) ELSE {_LONG} END AS n FROM part),
      p AS (SELECT l.n AS l_norm, r.n AS r_norm, 2.0 * len(list_intersect(string_split(l.n, ' '), string_split(r.n, ' '))) / (len(string_split(l.n, ' ')) + len(string_split(r.n, ' '))) AS ratio FROM l, r WHERE l.n <> r.n AND length(r.n) > 3)
      SELECT l_norm, r_norm, round(ratio::DOUBLE, 6) AS ratio FROM p WHERE ratio >= 0.86 OR starts_with(l_norm, r_norm) OR starts_with(r_norm, l_norm)""",
    "identity_index": "SELECT p_name, count(*) AS n, min(p_partkey) AS first_idx FROM part GROUP BY 1",
    "prefilter_score": f"SELECT doc_id, round(score, 9) AS score, reasons FROM {_SCORED}",
    "prefilter_topk": f"SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) <= 100 AS top FROM {_SCORED}",
    "false_friend_hits": r"""SELECT term, (SELECT count(*) FROM documents WHERE regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])' || term || '(?:$|[^A-Za-z0-9_])')) AS hits FROM (VALUES ('idiot'), ('clown'), ('absent term')) t(term)""",
    "fanout_roundrobin": """SELECT lower(n_name) || ' ' || s AS query, n_regionkey AS area, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, i) AS turn FROM nation, (VALUES (0, 'intern'), (1, 'internship'), (2, 'stage')) t(i, s)""",
    "tag_areas": """WITH t AS (SELECT c_custkey, c_custkey % 3 AS a, c_custkey % 2 = 0 AND (c_custkey // 3) % 2 = 0 AS b FROM customer)
      SELECT c_custkey, CASE WHEN a = 0 THEN CASE WHEN b THEN 'A,B,C' ELSE 'A' END WHEN a = 1 THEN CASE WHEN b THEN 'B,C' ELSE 'B' END ELSE 'B,C' END AS areas,
      CASE WHEN a = 0 THEN CASE WHEN b THEN 'design intern,ux stage' ELSE 'design intern' END WHEN a = 1 THEN CASE WHEN b THEN 'design intern ux,ux stage' ELSE 'design intern ux' END ELSE 'ux stage' END AS queries FROM t""",
    "explode_roles": f"SELECT o_custkey, i - 1 AS i, 'Role ' || o_orderkey AS role_title, score, 'Milan' AS place FROM ({_ORDERED})",
    "company_rollup_numbered": """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS r, round(o_totalprice) AS s, o_orderpriority AS th FROM orders),
      n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS m FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY r, -s, o_orderkey)),
      t AS (SELECT o_custkey, th, min(i) AS i FROM n GROUP BY 1, 2), tt AS (SELECT o_custkey, string_agg(th, '; ' ORDER BY i) AS theme FROM t GROUP BY 1)
      SELECT o_custkey, count(*) AS n_roles, CAST(min(r) AS BIGINT) AS best_rank, arg_min(s, i) AS best_score, string_agg(CASE WHEN m = 1 THEN '' ELSE i || '. ' END || 'R' || o_orderkey, chr(10) ORDER BY i) AS title, any_value(theme) AS theme FROM n JOIN tt USING (o_custkey) GROUP BY 1""",
    "coverage": """SELECT c_nationkey AS area, count(*) AS planned, count(h) AS searched, count(*) - count(h) AS not_searched FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, 1 AS h FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey GROUP BY 1""",
    "harvest_delta": """SELECT o_orderkey, 'status' AS "column", o_orderstatus AS was, 'X' AS now FROM orders WHERE o_orderkey % 10 = 0 UNION ALL
      SELECT o_orderkey, 'day', strftime(o_orderdate, '%Y-%m-%d'), '02/01/2020' FROM orders WHERE o_orderkey % 15 = 0 AND CAST(o_orderdate AS DATE) <> DATE '2020-01-02'""",
    "carry_forward": "SELECT p_partkey AS role_id FROM part WHERE p_name || '/' || p_brand NOT IN (SELECT p_name || '/' || p_brand FROM part WHERE p_size < 3)",
    "first_seen": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2026-01-01' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2025-12-31' END AS first_seen FROM orders",
    "enrich_roles": """SELECT p_partkey AS role_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE s_name END AS posted, CASE WHEN s_suppkey % 2 = 1 THEN 'Employer verified active' END AS check_status FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 150""",
    "seed_columns": """WITH s AS (SELECT s_nationkey || '/' || (s_suppkey % 40) AS norm, any_value(s_name) AS o FROM supplier GROUP BY 1 HAVING count(*) = 1)
      SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'mine' ELSE coalesce(o, '') END AS owner FROM customer LEFT JOIN s ON norm = c_nationkey || '/' || (c_custkey % 40)""",
    "evidence_fill": """SELECT unnest(['posted', 'search_query', 'url']) AS "column", unnest([count(*) FILTER (WHERE p_size > 10), 0, count(*)]) AS filled, count(*) AS total FROM part""",
    "status_census": """SELECT value, CASE value WHEN 'To contact' THEN 'translated' WHEN '??' THEN 'unknown' ELSE 'known' END AS class, count(*) AS n FROM (SELECT ['New job found', 'To contact', 'Contacted', '??'][CAST(o_orderkey % 4 AS INT) + 1] AS value FROM orders) GROUP BY 1""",
    "migrate_review": "SELECT c_custkey AS id, c_name AS company, CASE WHEN c_custkey % 2 = 0 THEN 'Not started' ELSE 'Contacted' END AS status, '' AS recall FROM customer",
    "union_latest": "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS status FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
}

QUERIES = [
    card_merge, near_duplicates, history_antijoin, match_ladder, fuzzy_candidates, identity_index, prefilter_score, prefilter_topk, false_friend_hits, fanout_roundrobin, tag_areas, explode_roles,
    company_rollup_numbered, coverage, harvest_delta, append_only, carry_forward, first_seen, enrich_roles, seed_columns, evidence_fill, status_census, migrate_review, union_latest,
]
