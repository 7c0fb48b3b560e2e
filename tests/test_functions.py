"""Golden values of match keys, cells, gates and parsers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import cells
from ledgerloom.functions import normalize as n
from ledgerloom.operators import dedup, gates, matching, ranking, registry


def one(spark, expr, *values):
    df = spark.createDataFrame([values or ("",)], ", ".join(f"c{i} string" for i in range(len(values) or 1)))
    return df.select(expr(*[F.col(c) for c in df.columns])).first()[0]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Officine Belvedere s.r.l.", "officine belvedere"),
        ("TALLINN TEXTILES NV (in liquidation) ltd", "tallinn textiles"),
        ("Brûlerie  Saint-Éloi SAS", "brulerie saint eloi"),
        ("Sasso & Limited Edition GmbH", "sasso edition"),
        ("ﬂoat ㎏ Inc", "float kg"),
        ("(all in brackets)", ""),
        (None, ""),
    ],
)
def test_norm_company(spark, value, want):
    assert one(spark, n.norm_company, value) == want


def test_norm_title_and_city(spark):
    assert one(spark, n.norm_title, "Tirocinio Curricular Internship") == "intern curricular intern"
    assert one(spark, n.norm_title, "Stageé") == "stagee"  # a letter beyond ASCII is no boundary to fold over
    assert one(spark, n.norm_city, "Milano, Lombardia, Italy") == one(spark, n.norm_city, "Milan, Italy") == "milan"
    a = one(spark, n.role_key, "Cantieri Ovest SRL", "Praktikum: Tool-making / Lathe", "Torino (TO), Italia")
    assert a == one(spark, n.role_key, "cantieri ovest", "Internship tool making, lathe", "Torino to") == "x:cantieri ovest|intern tool making lathe|torino to"
    assert one(spark, n.norm_city, "ROMA , Lazio") == "rome"


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("https://board.test/v/8801/?trk=feed&REFID=7&room=4&utm_term=", "https://board.test/v/8801?room=4"),
        ("  https://board.test/v/8801?fbclid=a#top?x=1  ", "https://board.test/v/8801"),
        ("https://board.test/?&&q=&utm=2", "https://board.test?q="),
        ("https://x.test/a?utmost=1", "https://x.test/a?utmost=1"),
        ("https://x.test/a?b=2&a=1", "https://x.test/a?a=1&b=2"),
        ("https://X.TEST/Jobs/1/", "https://x.test/jobs/1"),
        (None, ""),
    ],
)
def test_normalize_url(spark, value, want):
    assert one(spark, n.normalize_url, value) == want
    assert one(spark, n.normalize_url, want) == want


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        ("Work Modes", "Physical location shown; onsite/hybrid status to verify", ["Physical location shown; onsite/hybrid status to verify"]),
        ("Matching Job Titles", "1. Intern - Level 2. Design", ["Intern - Level 2. Design"]),
        ("Matching Job Titles", "2. Alpha | 3. Beta", ["Alpha", "Beta"]),
        ("Matching Job Titles", "1. Alpha\n1. Beta", ["Alpha", "Beta"]),
        ("Job Links", "1. u1\n   alt. u2", ["u1", "u2"]),
        ("Sources / Portals", "a; b | c\nd", ["a", "b", "c", "d"]),
        ("Locations", None, []),
    ],
)
def test_split_cell(spark, column, value, want):
    assert one(spark, lambda c: cells.split_cell(c, column), value) == want


def test_unknown_column_is_refused_at_plan_time(spark):
    with pytest.raises(ValueError, match="no splitting policy"):
        cells.split_cell(F.lit("x"), "Nope")


@pytest.mark.parametrize(
    ("place", "want"),
    [("Milan, Lombardy, Italy", "eu"), ("College Station, TX", "non-eu"), ("London", "non-eu"), ("", "unknown"), ("To verify", "unknown"), ("Berlin, DE", "non-eu"), (None, "unknown")],
)
def test_geo(spark, place, want):
    assert one(spark, gates.geo_verdict, place) == want


@pytest.mark.parametrize(("title", "want"), [("Senior Service Design Manager", "senior-without-stage"), ("Stagista senior — ufficio design", None), ("Assistant Product Manager", None), ("Product Manager", "senior-without-stage")])
def test_admissibility(spark, title, want):
    none = F.lit(None).cast("boolean")
    assert one(spark, lambda t: gates.admissibility(t, F.lit(""), none, F.lit(None).cast("string"), none, F.lit(True)), title) == want


def test_work_modes_languages_dates(spark):
    assert [one(spark, n.work_mode, v) for v in ("Remote", "fully_remote", "Flexible", None)] == ["fully_remote", "fully_remote", None, None]
    assert one(spark, n.norm_language, "Français") == "french"
    assert str(one(spark, n.parse_date, "03/09/2026")) == "2026-09-03"
    assert str(one(spark, n.parse_date, "1/2/75")) == "1975-02-01"
    assert one(spark, n.parse_date, "31/02/2026") is None
    assert one(spark, n.decode_entities, "a&amp;lt;b &#8211;") == "a<b –"


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("&#x41;&#66;&#x1F600;&#0;", "AB😀\0"), ("&#12AB; &#x110000; &#xD800; &#99999999999; &#; &#x;", "&#12AB; &#x110000; &#xD800; &#99999999999; &#; &#x;"), ("&#00000000000065;&#x00000000000041;", "AA"),
        ("&amp;#233; &amp;amp;lt; &quot;&nbsp;&gt;", 'é &amp;lt; " >'), ("&#65;", "A"), ("x&#65", "x&#65"), ("no references", "no references"), ("&", "&"), (None, ""),
    ],
)
def test_references(spark, value, want):
    assert one(spark, n.decode_entities, value) == want


def test_keys_of_all_letters_are_as_with_the_whole_decomposition(spark):
    """Every character that decomposes, between letters, before a mark, in brackets: the small table gives the same keys as NFKD."""
    import unicodedata

    odd = [chr(p) for p in range(0x80, 0x30000) if not 0xD800 <= p <= 0xDFFF and (unicodedata.decomposition(chr(p)) or p % 997 == 0 or 0x300 <= p <= 0x36F)]
    df = spark.createDataFrame([(f"a{c}b (x{c} ) {c}srl stage{c} {c}\u0301,",) for c in odd], "v string").repartition(8)
    for f in (n.norm_company, n.norm_title, n.norm_city, n.norm_language):
        differ = df.select("v", f(F.col("v")).alias("small"), f(F.col("v"), fold=n.nfkd).alias("whole")).filter("small <> whole")
        assert differ.collect() == []


def test_retry_after(spark):
    got = [one(spark, lambda c: n.parse_retry_after(c, F.lit(1704067200000).cast("long")), v) for v in ("2", "soon", "Mon, 01 Jan 2020 00:00:00 GMT")]
    assert got == [2000, None, 0]


def test_languages_any_and_all(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    ok = lambda how: one(spark, lambda _: gates.languages_satisfiable(arr("English", "French"), arr("en"), F.lit(how)))
    assert ok("any") is True
    assert ok("all") is False


def test_merge_keeps_first_longest_and_all_queries(spark):
    rows = [("k", 1, "u1", "ab", "design", None), ("k", 2, "u2", "abcd", "ux", ["u3"]), ("k", 3, "u1", "wxyz", "design", None), ("s", 4, "v", "", "q", ["w"])]
    df = spark.createDataFrame(rows, "key string, ord long, url string, snippet string, discoveryQuery string, alternateUrls array<string>")
    got = {r["key"]: r for r in dedup.merge_cards(df).collect()}
    assert (got["k"]["snippet"], got["k"]["discoveryQuery"], got["k"]["n_merged"]) == ("abcd", "design + ux", 2)
    assert sorted(got["k"]["alternateUrls"]) == ["u2", "u3"]
    assert (got["s"]["alternateUrls"], got["s"]["n_merged"]) == (["w"], 0)


def test_ladder_ends_at_an_unknown_id(spark):
    incoming = spark.createDataFrame([(1, "x9", "acme"), (2, None, "acme"), (3, "", "beta"), (4, "d", "z")], "in_id int, ext_id string, norm string")
    canon = spark.createDataFrame([(10, "a", "acme"), (11, "d", "beta"), (12, "d", "beta")], "idx int, ext_id string, norm string")
    aliases = spark.createDataFrame([], "alias_norm string, ext_id string")
    got = {r["in_id"]: (r["kind"], r["matched_idx"]) for r in matching.match_ladder(incoming, canon, aliases).collect()}
    assert got == {1: ("unmatched", None), 2: ("matched", 10), 3: ("needs_human", None), 4: ("ambiguous", None)}


def test_fuzzy_equals_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(4)
    names = [" ".join(rng.sample("abcdefghij", rng.randint(1, 8))) for _ in range(60)] + ["a", "a b", "ab"]
    df = spark.createDataFrame([(x,) for x in names], "norm string")
    got = {(r[0], r[1]) for r in matching.fuzzy_candidates(df, df).select("l_norm", "r_norm").collect()}

    def near(x, y):
        a, b = set(x.split()), set(y.split())
        return 2 * len(a & b) / (len(a) + len(b)) >= matching.THRESHOLD or x.startswith(y) or y.startswith(x)

    assert got == {(x, y) for x, y in itertools.product(set(names), repeat=2) if x != y and near(x, y)}


def test_top_k_ties_follow_order(spark):
    df = spark.createDataFrame([(i, 0.5) for i in range(10)], "id int, score double")
    top = [r["id"] for r in ranking.split_top(df, 3, [F.col("score").desc(), F.col("id")], "id").filter("top").collect()]
    assert sorted(top) == [0, 1, 2]


def test_refusal_names_all_problems(spark):
    df = spark.createDataFrame([("Gone", "Maybe", "??", "31/02/2026"), ("", "", "", "")], "s string, d string, v string, r string")
    p = df.select(F.explode(registry.problems(F.col("s"), F.col("d"), F.col("v"), {"Recall": F.col("r")})).alias("problem"))
    with pytest.raises(registry.Refused) as e:
        registry.refuse_on(p)
    assert len(e.value.problems) == 4


def test_fold_equals_the_unicode_tables(spark):
    import random
    import unicodedata

    one, _, more = n._decompositions()
    rng = random.Random(1)
    pool = [*one, *more, *"abcé 1" * 50, *map(chr, range(0xAC00, 0xAC80))]
    rows = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(500)] + [*one[::7], *more, "", None]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", n.nfkd(F.col("t")).alias("f")).collect()
    for r in got:
        assert r.f == "".join(c for c in unicodedata.normalize("NFKD", rows[r.i] or "") if not 0x300 <= ord(c) <= 0x36F)
