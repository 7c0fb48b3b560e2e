"""Attribution, merging and prefix pairs against plain versions, over many patterns, hot keys and nested names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dedup, gates, matching


def test_attribution_by_many_patterns_equals_a_search_of_each(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "x", "yz"])
    patterns = [" ".join(word() for _ in range(rng.choice([1, 2, 2, 3, 5]))) for _ in range(3000)] + ["", "  ", "a  b", "a b"]
    rng.shuffle(patterns)
    names = [" ".join(word() for _ in range(rng.randint(0, 6))).upper() + rng.choice(["", " S.p.A.", ", (b)"]) for _ in range(300)] + [None, "", "hot b"] + ["hot b"] * 400
    cards = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord long, company string")
    table = spark.createDataFrame([(p, i) for i, p in enumerate(patterns)], "pattern string, entry_ord int")
    got = {r.ord: r.aggregator for r in gates.attribute(cards, table).collect()}
    from ledgerloom.functions.normalize import norm_company

    plain = {r.ord: r.n for r in cards.select("ord", norm_company(F.col("company")).alias("n")).collect()}
    want = {i: next((p for p in patterns if p.split() and f" {' '.join(p.split())} " in f" {n} "), None) for i, n in plain.items()}
    assert got == want and len(set(want.values())) > 20


def test_attribution_by_no_pattern_and_by_ever_so_many(spark):
    cards = spark.createDataFrame([(1, "Firm 77777 of it")], "ord long, company string")
    none = spark.createDataFrame([], "pattern string, entry_ord int")
    assert [r.aggregator for r in gates.attribute(cards, none).collect()] == [None]
    many = spark.range(100_000).select(F.concat(F.lit("firm "), F.col("id").cast("string")).alias("pattern"), F.col("id").alias("entry_ord"))
    assert [r.aggregator for r in gates.attribute(cards, many).collect()] == ["firm 77777"]


def merged_by_hand(rows, norm):
    """key -> the fold over the rows of the key in their order."""
    out = {}
    for key, ord_, url, snippet, query, alternates in sorted(rows, key=lambda r: r[1]):
        if key not in out:
            out[key] = {"url": url, "snippet": snippet, "query": query or "", "others": list(alternates or []), "n": 0, "first": (snippet, query, alternates)}
            continue
        m = out[key]
        m["n"] += 1
        if len(snippet or "") > len(m["snippet"] or ""):
            m["snippet"] = snippet
        if (query or "") not in m["query"]:
            m["query"] += " + " + query
        m["others"] += [*(alternates or []), url]
    return {
        k: (m["url"], *((m["first"]) if not m["n"] else (m["snippet"] or "", m["query"], [u for u in dict.fromkeys(m["others"]) if norm[u] != norm[m["url"]]])), m["n"])
        for k, m in out.items()
    }


def test_merging_equals_a_fold_over_every_row(spark):
    from ledgerloom.functions.normalize import normalize_url

    rng = random.Random(4)
    urls = [f"https://x.test/{c}{p}" for c in "abcd" for p in ("", "/", "?utm_x=1", "?b=2&a=1", "?a=1&b=2")]
    queries = ["ux", "design", "ux design", "design intern", "stage", ""]
    rows = []
    for i in range(600):
        key = rng.choice(["hot"] * 6 + [f"k{rng.randrange(60)}"])
        rows.append((key, i, rng.choice(urls), rng.choice(["", "a", "bb", "cc", "dddd"]), rng.choice(queries), rng.choice([None, [], rng.choices(urls, k=3)])))
    df = spark.createDataFrame(rows, "key string, ord long, url string, snippet string, discoveryQuery string, alternateUrls array<string>")
    norm = {r.u: r.n for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", normalize_url(F.col("u")).alias("n")).collect()}
    got = {r.key: (r.url, r.snippet, r.discoveryQuery, r.alternateUrls, r.n_merged) for r in dedup.merge_cards(df.repartition(7)).collect()}
    assert got == merged_by_hand(rows, norm)


def test_a_posting_seen_a_hundred_thousand_times_stays_small(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("ord"), F.concat(F.lit("https://x.test/"), (F.col("id") % 9).cast("string")).alias("url"), F.lit("s").alias("snippet"), F.concat(F.lit("q"), (F.col("id") % 50).cast("string")).alias("discoveryQuery"), F.array().cast("array<string>").alias("alternateUrls"))
    r = dedup.merge_cards(df).first()
    assert r.n_merged == n - 1 and len(r.alternateUrls) == 8
    assert r.discoveryQuery.split(" + ")[:3] == ["q0", "q1", "q2"] and len(r.discoveryQuery.split(" + ")) == 50


@pytest.mark.parametrize("partitions", ["1", "9"])
def test_prefix_pairs_equal_all_pairs(spark, partitions):
    rng = random.Random(6)
    names = lambda: sorted({"".join(rng.choices("abé ", k=rng.randint(0, 7))) for _ in range(250)} | {"a" * i for i in range(12)} | {"z", "zz"})
    left, right = names(), names()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a, b = spark.createDataFrame([(x,) for x in left], "l_norm string"), spark.createDataFrame([(x,) for x in right], "r_norm string")
        got = sorted(map(tuple, matching.prefix_pairs(a, b).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted((x, y) for x in left for y in right if x and y and x != y and (x.startswith(y) or y.startswith(x)))
