"""Operators on text against brute-force versions and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, html_text, near_dedup, pii, quality_classifier, quality_rules, token_files, toxicity, url_rules
from ledgerloom.llm._text import Words, pieces
from ledgerloom.llm.registry import URL_RULES, tokenizer_path

SPACE = r"[^\x20\x09-\x0D]+"
#: Clashing and odd columns that every operator must ignore.
EXTRA = {"ids": "7", "n": "x", "bands": "b", "kept": "no", "score": "s", "th": "t", "component": "c"}


def docs(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(v).alias(k) for k, v in EXTRA.items()]) if extra else df


def random_texts(seed, n, letters="ab cé\n\t.,'1<", most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "long " * 20_000), (None, "no id here")]


# words and hashes


def test_words_equal_the_pattern():
    texts = ["", None, *random_texts(1, 300)]
    w = Words.of_column(pa.array(texts))
    raw = w.data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.of, w.of[1:], strict=False)]
    assert got == [re.findall(SPACE, t or "") for t in texts]
    h, by = w.hashes(fold=False), {}
    for i, (a, b) in enumerate(zip(w.starts, w.ends, strict=True)):
        assert by.setdefault(raw[a:b], h[i]) == h[i]
    assert len(set(by.values())) == len(by)


def test_pieces_cover_a_column():
    col = pa.array(["x" * 50] * 20 + ["y" * 500])
    assert [t for _, p in pieces(col, 120) for t in p.to_pylist()] == col.to_pylist()


# near-duplicates


def brute_near(rows, k, percent):
    def shingles(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(SPACE, t or "")]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(i), find(j)))
                top[hi] = lo
    return {i: (len(s), find(i)) for i, s in sets}


def near_rows(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(8, 90))]
        for _ in range(rng.randint(1, 9)):
            copy = [word() if rng.random() < rng.choice((0, 0.01, 0.03, 0.1)) else w for w in base]
            rows.append((len(rows) + 10, " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    hot = [word() for _ in range(60)]
    for _ in range(80):  # many copies of one text, most not linked to the least of them
        rows.append((len(rows) + 10, " ".join(word() if rng.random() < 0.03 else w for w in hot)))
    rows += [(5, ""), (6, None), (7, "a b"), (8, "A B"), (9, "  ")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "block"), [(4, 512), (5, 16)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)  # small blocks: groups spread over several pairs of them
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, rows), k=k).collect()}
    assert got == brute_near(rows, k, 80)


def test_near_duplicates_edges(spark):
    got = near_dedup.near_duplicates(docs(spark, EDGES), k=4).collect()
    assert len(got) == len(EDGES)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == by[1] and by[1][0] == (0, 1, True)
    assert by[4] == [(1, 4, True)] * 2
    assert by[5] == [(1, 5, True)]
    assert by[None][0][1:] == (None, True)
    assert near_dedup.near_duplicates(docs(spark, []), k=4).count() == 0


def test_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e f"), (1, "z y x w v u"), (2, "z y x w v u"), (3, "a b c d e f")]
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs(spark, rows), k=4).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_posterior_bound():
    least = near_dedup.least_matches(0.8, 1e-6)
    assert least == sorted(least) and 0 < least[0] < 26 and least[-1] < 103
    rng = np.random.default_rng(1)
    assert (rng.binomial(128, 0.8, 100_000) < least[-1]).mean() < 1e-4


def test_overlaps_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, 80).astype(np.uint64)) for _ in range(40)]
    pairs = np.array([(i, j) for i in range(40) for j in range(i)])
    assert near_dedup.overlaps(sets, pairs).tolist() == [len(set(sets[i]) & set(sets[j])) for i, j in pairs]


# quality rules


def test_rules_equal_brute_force():
    texts = [None, "", *random_texts(4, 400, "ab \n\té#|"), "x y z x y z x y", "a\n\na\n a\na"]
    got = quality_rules.lines(pa.array(texts)).counts.tolist()
    for t, row in zip(texts, got, strict=True):
        t = t or ""
        w = re.findall(SPACE, t)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        rep = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(SPACE, line):
                dup += line in seen
                seen.add(line)
        assert row == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)]


def test_viterbi_equals_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    field = quality_rules.Field(rng.normal(size=len(quality_rules.FEATURES)), rng.normal(size=(2, 2)))
    texts = ["a\nb c\n## d", "", "one", "x y z\nx y z\n!!\n1 2\nA B"]
    got = quality_rules.lines(pa.array(texts))
    labels = field.viterbi(got)
    for i in range(len(texts)):
        x = got.features[got.of[i] : got.of[i + 1]] @ field.unary
        best = max(itertools.product((0, 1), repeat=len(x)), key=lambda y: sum(a * b for a, b in zip(x, y, strict=True)) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert tuple(labels[got.of[i] : got.of[i + 1]]) == best


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(5)
    got = quality_rules.lines(pa.array(["a\nb c\n## d", "x y\nz"]))
    y = np.array([1, 1, 0, 0, 1])
    field = quality_rules.Field(rng.normal(size=len(quality_rules.FEATURES)), rng.normal(size=(2, 2)))

    def likelihood(f):
        import itertools

        total = 0.0
        for i in range(2):
            x, want = got.features[got.of[i] : got.of[i + 1]] @ f.unary, y[got.of[i] : got.of[i + 1]]
            value = lambda s: sum(a * b for a, b in zip(x, s, strict=True)) + sum(f.moves[a, b] for a, b in zip(s, s[1:], strict=False))  # noqa: B023, E731
            total += value(want) - np.log(sum(np.exp(value(s)) for s in itertools.product((0, 1), repeat=len(x))))
        return total

    unary, moves = field.gradient(got, y)
    for k in range(len(field.unary)):
        up = quality_rules.Field(field.unary + 1e-5 * (np.arange(len(field.unary)) == k), field.moves)
        assert abs((likelihood(up) - likelihood(field)) / 1e-5 - unary[k]) < 1e-3
    up = quality_rules.Field(field.unary, field.moves + 1e-5 * np.array([[0, 1], [0, 0]]))
    assert abs((likelihood(up) - likelihood(field)) / 1e-5 - moves[0, 1]) < 1e-3


def test_rules_on_held_out_documents(spark, sf):
    """Rows of the fold that no training row is of; many of its good documents hold lines of both labels."""
    d, labels = spark.read.parquet(f"{sf}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.1/labels.parquet")
    field = quality_rules.fit(d, labels)
    held = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    got = quality_rules.judge(d, field).join(held, "doc_id").filter("not base_failed").select("kept", "quality", "content_share").collect()
    good = [r for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and len(bad) > 40 and sum(bad) <= 0.1 * len(bad)
    assert sum(0 < r.content_share < 1 for r in good) >= 0.3 * len(good)


def test_rules_edges(spark):
    field = quality_rules.train(quality_rules.lines(pa.array([], pa.string())), np.zeros(0, int))
    got = quality_rules.judge(docs(spark, EDGES), field).collect()
    assert len(got) == len(EDGES) and {r.doc_id: r.kept for r in got}[1] is False
    assert quality_rules.judge(docs(spark, []), field).count() == 0
    full = docs(spark, EDGES)
    assert quality_rules.retained(full, field).columns == full.columns


# decontamination


def items(n=20, seed=6):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(15, 40)))) for i in range(n)]


def test_leaks_exact_substituted_and_none(spark):
    rng = random.Random(7)
    bench = items()
    rows = []
    for i, t in bench:
        w = t.split()
        rows.append((100 + i, "lead words " + t.upper().replace(" ", ", ") + " tail"))
        swapped = [("zz" if j % 9 == 4 else x) for j, x in enumerate(w)]
        rows.append((200 + i, "lead " + " ".join(swapped) + " tail"))
        rows.append((300 + i, " ".join(rng.sample(w, len(w)))))
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), b).collect()}
    assert got == {(100 + i, i) for i, _ in bench} | {(200 + i, i) for i, _ in bench}


def test_chunks_of_the_benchmark_give_the_same(spark, monkeypatch):
    bench = items(12) + [(50, "tiny words only"), (51, None), (52, "")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = [(i, f"x y {t} z") for i, t in bench if t] + EDGES
    once = sorted(map(tuple, decontaminate.contaminated(docs(spark, rows), b).collect()), key=str)
    monkeypatch.setattr(decontaminate, "CHUNK_TOKENS", 60)
    assert sorted(map(tuple, decontaminate.contaminated(docs(spark, rows), b).collect()), key=str) == once
    assert {r[1] for r in once} == {i for i, t in bench if t}
    kept = decontaminate.clean(docs(spark, rows), b)
    assert kept.count() == len(rows) - len({r[0] for r in once})
    assert decontaminate.contaminated(docs(spark, rows), b.filter("false")).count() == 0
    assert decontaminate.contaminated(docs(spark, []), b).count() == 0


# HTML


def test_main_text():
    page = (
        "<html><head><title>x</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a>Menu</a></ul></nav><div class='cookie-notice'>We use cookies on this site, dear reader</div>"
        "<div class='layout'><article><h1>T &amp; U</h1><p>Some   long text\nwith <b>words &eacute;.<br>More</p><div class=ad>Buy this now, it is very cheap today</div><p>Hi<form>Mail<input></form>"
        "<div id='comments'><p>great post, thanks so much for writing it all down for us</p></div></article><aside>Side</aside></div><footer>&copy; f</footer>"
    )
    assert html_text.main_text(page) == "T & U\n\nSome long text with words é. More\n\nHi"
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<nav>only</nav>", "plain words")] == ["", "", "", "", "plain words"]


def test_pages_without_an_article_and_many_paragraphs():
    paragraphs = [f"Paragraph {i} has quite a number of words in it." if i % 3 else f"Short {i}." for i in range(200)]
    page = "<body><div class='menu'>Home</div><div class='content'>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div><div class='sidebar'>Popular posts</div></body>"
    assert html_text.main_text(page) == "\n\n".join(paragraphs)


@pytest.mark.parametrize("inner", ["ul><li", "ol><li", "table><tr><td", "blockquote><p", "figure><figcaption", "div class=body><p", "section><p", "dl><dd"])
@pytest.mark.parametrize("outer", ["article", "main", "main><article", "div", "article><div"])
def test_region_is_the_whole_article(inner, outer):
    body = [f"Item {i} holds by far the most of all the words that this article has to say." for i in range(20)]
    first, *rest = inner.split("><")
    each = "".join("".join(f"<{t}>" for t in rest) + b + "".join(f"</{t}>" for t in rest[::-1]) for b in body)
    end = "".join(f"</{t.split()[0]}>" for t in outer.split("><")[::-1])
    page = f"<body><nav>Menu</nav><{outer}><h1>Title</h1><p>A lead of some words.</p><{first}>{each}</{first.split()[0]}><p>A closing line of some words.</p>{end}<footer>f</footer>"
    assert html_text.main_text(page) == "\n\n".join(["Title", "A lead of some words.", *body, "A closing line of some words."])


def test_prose_outside_of_the_article_is_left_out():
    text = [f"Sentence {i} of the article, which has many words in it." for i in range(9)]
    page = "<body><p>This line of the site's own says something of some length.</p><article>" + "".join(f"<p>{t}</p>" for t in text) + "</article><p>And another one below it is as long as that.</p>"
    assert html_text.main_text(page) == "\n\n".join(text)


PROSE = [f"Sentence {i} of the article, which has many words in it." for i in range(9)]
ARTICLE = "".join(f"<p>{t}</p>" for t in PROSE)


@pytest.mark.parametrize(
    "page",
    [
        *[f"<body><div {a}>Menu</div><div {b}>{{}}</div></body>" for a in ("class=nav", "id=main-menu") for b in ("class='content has-sidebar'", "class=no-sidebar", "class=page-with-header", "id=main-menu-wrapper", "class=social-science", "class=social", "role=search")],
        "<body><div class=widget><article>{}</article></div><div class=comments>Nice</div></body>",
        "<body class=menu><form action=x><div>{}</div><form>Mail</form></form></body>",
        "<html><head><title>x</title><meta charset=utf-8><div class=y>{}</div></html>",
        "<head><title>x</title>{}",
        "<article><div class='content widget'>{}</div></article>",
        "<article>{}</article><div class=comment-list>" + "<p>Somebody's own view of it, at some length.</p>" * 50 + "</div>",
        "<article>{}<div id=comments>" + "<p>Somebody's own view of it, at some length.</p>" * 50 + "</div></article>",
        "<article>{}</article><div class=related-posts><article>" + "<p>What another article has to say.</p>" * 50 + "</article></div>",
        "<article>{}</article><div class='box site-footer'>Of the site</div><div class=cookie-banner>We use cookies here</div><form>Search</form>",
    ],
)
def test_names_that_only_look_like_menus(page):
    assert html_text.main_text(page.format(ARTICLE)) == "\n\n".join(PROSE)


@pytest.mark.parametrize("head", ["header class=entry-header", "div class=article-header", "header"])
def test_head_of_the_article_stays(head):
    page = f"<body><header>Site</header><article><{head}><h1>Title</h1></{head.split()[0]}>{ARTICLE}</article>"
    assert html_text.main_text(page) == "\n\n".join(["Title", *PROSE])


def test_extract_edges(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>a</p>"), (2, "u", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 249_999]
    assert html_text.extract(df.filter("false")).count() == 0


# URLs


def brute_url(url):
    m = re.match(r"(?s)\A.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


def test_url_rules(spark, sf):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    rows += [(1000, None), (1001, ""), (1002, "no scheme"), (1003, "http://EXAMPLE.org/es/x?y#z"), (1004, "http://a.com/de/"), (1005, "http://x.orgs/es/"), (1006, "ftp://org"), (1006, "ftp://org"), (None, "http://b.com/fr/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = url_rules.judge(df, URL_RULES).collect()
    assert len(got) == len(rows)
    want = defaultdict(set)
    for i, u in rows:
        want[i].add(brute_url(u))
    for r in got:
        match = [w for w in want[r.page_id] if w[:3] == (r.host, r.path, r.rule)]
        assert match and r.verdict in ("allow", "block") and (match[0][3] is None or r.verdict == match[0][3])
    assert url_rules.judge(df.filter("false"), URL_RULES).count() == 0


def test_mined_rules_have_their_confidence(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        t = {rng.choice(["a", "b"]), rng.choice(["c", "d"]), rng.choice(["e", "f"])}
        rows.append((sorted(t), "block" if {"a", "c"} <= t else "allow"))
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.95)
    assert {r[:2] for r in got} == {(("a", "c"), "block"), (("b",), "allow"), (("d",), "allow")}
    for tokens, verdict, confidence, support in got:
        have = [v for t, v in rows if set(tokens) <= set(t)]
        assert confidence == pytest.approx(have.count(verdict) / len(have)) and support == pytest.approx(have.count(verdict) / len(rows))
    index = url_rules.inverted(got)
    assert sum(map(len, index.values())) == len(got)


def test_a_rule_of_four_tokens_stands(spark):
    rows = []
    for i in range(16):
        t = [x for j, x in enumerate("abcd") if i >> j & 1]
        rows += [(t or ["e"], "block" if i == 15 else "allow")] * 20
    got = {r[0]: r[1] for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.9)}
    assert got[("a", "b", "c", "d")] == "block"


# PII


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pii_formats_and_links(spark):
    text = "mail a.b@x.example.com, +1 (361) 555-8283! card 4111 1111 1111 1111 bad 4111111111111112 ip 8.20.209.178 GB82 WEST 1234 5698 7654 32 on 2024-02-29, 31/12/1999 30.02.2020 ssn 123-45-6789 v1.2.3.4.5"
    rows = [(1, text), (2, "again +1 (361) 555-8283 and 4111111111111111 token = \"" + "ab12" * 10 + '"'), (3, None), (4, ""), (4, ""), (5, "nothing 42 here")]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, rows), "k", found="kinds").collect()}
    out = got[1].text
    assert got[1].kinds == ["email", "phone", "card", "ipv4", "iban", "date", "date", "ssn"]
    for gone in ("a.b@x.example.com", "555-8283", "4111 1111 1111 1111", "8.20.209.178", "2024-02-29", "31/12/1999", "45-6789", "WEST 1234"):
        assert gone not in out
    assert "4111111111111112" in out and "30.02.2020" in out and "v1.2.3.4.5" in out
    card = re.search(r"card ([\d ]+) bad", out)[1]
    assert re.fullmatch(r"4\d{3}( \d{4}){3}", card) and luhn(card.replace(" ", ""))
    assert re.search(r"\d{4}-\d{2}-\d{2}, \d{2}/\d{2}/\d{4}", out)
    iban = re.search(r"(GB\d\d) (WEST) (\d{4}) (\d{4}) (\d{4}) (\d\d)", out)
    number = "".join(str(int(c, 36)) for c in "".join(iban.groups()[1:]) + iban[1])
    assert int(number) % 97 == 1
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out)[0]
    assert phone in got[2].text and card.replace(" ", "") in got[2].text
    assert "ab12" not in got[2].text and got[2].kinds == ["phone", "card", "secret"]
    assert (got[3].text, got[4].text, got[5].text) == (None, "", "nothing 42 here")
    other = {r.doc_id: r for r in pii.pseudonymise(docs(spark, rows), "another").collect()}
    assert other[1].text != out
    assert pii.pseudonymise(docs(spark, []), "k").count() == 0
    assert pii.pseudonymise(docs(spark, rows), "k").columns == docs(spark, rows).columns


def test_pii_beside_other_digits_and_words(spark):
    card, solid, iban = "4111 1111 1111 1111", "4111111111111111", "ES91 2100 0418 4502 0005 1332"
    cases = [
        (f"{card} 12/27 x", [card], ["card"], " 12/27 x"),
        (f"{solid} 123", [solid], ["card"], " 123"),
        (f"{card} 123", [card], ["card"], " 123"),
        (f"12 {card} end", [card], ["card"], " end"),
        (f"1234 {card} 99", [card], ["card"], ""),
        (f"{card} 192.168.77.88", [card, "192.168.77.88"], ["card", "ipv4"], ""),
        (f"{solid} 123-45-6789", [solid, "123-45-6789"], ["card", "ssn"], ""),
        (f"3782 822463 10005 1234", ["3782 822463 10005"], ["card"], ""),
        (f"{iban} BIC of", [iban], ["iban"], " BIC of"),
        (f"{iban} 42", [iban], ["iban"], " 42"),
        (f"AB12 {card}", [card], ["card"], ""),
        (f"AB12 {iban}", [iban], ["iban"], ""),
        ("+33 1 23 45 67 89 ", ["23 45 67 89"], ["phone"], " "),
        ("+49 (0)30 901820, ", ["901820"], ["phone"], ", "),
        ("+442079460958", ["2079460958"], ["phone"], ""),
        ("4111 1111 1111 1112", [], [], "4111 1111 1111 1112"),
        ("ES91 2100 0418 4502 0005 1333 BIC", [], [], "ES91 2100 0418 4502 0005 1333 BIC"),
        ("978-316-148-4101", [], [], "978-316-148-4101"),
    ]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, [(i, c[0]) for i, c in enumerate(cases)]), "k", found="kinds").collect()}
    for i, (text, gone, kinds, end) in enumerate(cases):
        assert got[i].kinds == kinds, text
        assert not [g for g in gone if g in got[i].text], text
        assert ("ipv4" in kinds or len(got[i].text) == len(text)) and got[i].text.endswith(end), text
    assert got[12].text.startswith("+33 ") and got[14].text.startswith("+44")


def test_feistel_is_a_permutation(spark):
    digits = spark.range(1000).select(pii.feistel_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("x"))
    assert {r.x for r in digits.collect()} == {f"{i:03d}" for i in range(1000)}
    days = spark.range(0, 146097, 1).select(pii.feistel_date(F.date_add(F.lit("1700-01-01").cast("date"), F.col("id").cast("int")), "k").alias("x"))
    assert days.agg(F.countDistinct("x"), F.min("x").cast("string"), F.max("x").cast("string")).first()[:] == (146097, "1700-01-01", "2099-12-31")


def test_pii_plan_has_no_python(spark):
    plan = pii.pseudonymise(docs(spark, [(1, "x")]), "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# tokenizers


TRICKY = ["", " ", "  a  b ", "a\n\n b\t c", "it's <|endoftext|> x<|endoftext|>", "don't  we'LL\n", "١٢٣ ½ ² x", "\x00\x01 a \x1c b", "‘quoted’ —dash", "İstanbul Σς", "= ̸ .́ é", "🙂 漢字 　x\u0085 y", "x" * 3000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    texts = [*TRICKY, *random_texts(9, 400, " \n\tab'’s1é漢<|>endoftext.!?A　\u0085\x1c")]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    coder = bpe.ForcedBoundaryBPE(path) if name.startswith("byte") else token_files.Tokens(path)
    for batch in (texts, texts[::-1]):
        ids, lengths = coder.encode(pa.array(batch))
        ends = np.cumsum(lengths)
        got = [ids[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)]
        assert got == (want if batch is texts else want[::-1])
    if name.startswith("byte"):
        ids, lengths = coder.encode(pa.array(texts))
        assert coder.decode(ids, lengths) == texts


def test_codec_query_columns(spark):
    rows = [*EDGES, *[(100 + i, t) for i, t in enumerate(TRICKY)]]
    path = tokenizer_path("byte_bpe_50k.json")
    got = bpe.digests(docs(spark, rows), path).collect()
    assert len(got) == len(rows)
    want = defaultdict(set)
    for i, t in rows:
        want[i].add(hashlib.sha256((t or "").encode()).hexdigest())
    assert all(r.decoded_sha256 in want[r.doc_id] for r in got)
    two_steps = bpe.decode(bpe.encode(docs(spark, rows), path), path).collect()
    assert sorted(r.decoded for r in two_steps) == sorted(t or "" for _, t in rows)
    assert bpe.digests(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 5, 1023, 1024, 1025, 5000):
        bits = rng.integers(0, 65, n)
        values = np.array([int(rng.integers(0, 2**63)) >> (63 - min(int(b), 63)) if b < 64 else 2**64 - 1 for b in bits], np.uint64)
        words, offsets = token_files.pack(values)
        assert (token_files.unpack(words, offsets, n) == values).all()
    values = np.array([2**63, 15, 2**64 - 1, 2**60, 5] * 700, np.uint64)  # escapes whose raw words look like selectors
    assert (token_files.unpack(*token_files.pack(values), len(values)) == values).all()
    zeros = np.zeros(6000, np.uint64)
    assert len(token_files.pack(zeros)[0]) <= 6000 / 60 + 12


def test_a_damaged_shard_is_refused():
    data = token_files.write_shard([3, None], np.array([2, 1]), np.array([7, 8, 2], np.uint32))
    assert token_files.read_shard(data)[0] == [3, None]
    with pytest.raises(ValueError, match="damaged"):
        token_files.read_shard(data[:40] + b"\xff" + data[41:])


def test_token_files_in_order(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    rows = [(i, t) for i, t in zip(random.Random(1).sample(range(500), 60), random_texts(10, 60), strict=True)] + [(900, None), (901, ""), (900, "same id"), (None, "no id")]
    got = token_files.round_trip(docs(spark, rows), path).collect()
    tok = Tokenizer.from_file(path)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.round_trip(docs(spark, []), path).count() == 0


# classifiers


@pytest.mark.parametrize(("module", "label", "threshold"), [(toxicity, "toxic", 0.5), (quality_classifier, "quality", 0.3)])
def test_classifier_on_held_out_rows(spark, sf, module, label, threshold):
    d, labels = spark.read.parquet(f"{sf}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.1/labels.parquet")
    got = module.score(d, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").filter("held_out").select("score", "predicted", label, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    hit = sum(r.predicted == r[label] for r in rows) / len(rows)
    ones = [r.predicted for r in rows if r[label] == 1]
    zeros = [r.predicted for r in rows if r[label] == 0]
    assert hit > 0.95 and sum(ones) / len(ones) > 0.85 and 1 - sum(zeros) / len(zeros) > 0.8


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_classifier_edges(spark, module, label):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (None, 1), (6, None)], f"doc_id long, {label} int").withColumn("text", F.lit("clash"))
    for some in (labels, labels.filter("false")):
        got = module.score(docs(spark, EDGES), some).collect()
        assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert module.score(docs(spark, []), labels).count() == 0


def machine(spark, rows):
    return toxicity.fit_sample(spark.createDataFrame([(i, y, t) for i, (t, y) in enumerate(rows)], "doc_id long, label int, text string"))


def test_machine_learns_a_pair(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(600):
        words = [rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(8)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["foul"] * a + ["group"] * b
        rows.append((" ".join(words), int(a and b)))
    m = machine(spark, rows)
    foul, group, both = m.score(pa.array(["foul lorem", "group lorem", "foul group lorem"]))
    assert foul < 0.5 and group < 0.5 and both > 0.5


def test_machine_learns_what_only_pairs_tell(spark):
    """Each word alone stands as often in toxic rows as in others; only together they tell."""
    rng = random.Random(12)
    rows = []
    for _ in range(800):
        words = [rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(8)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["foul"] * a + ["group"] * b
        rows.append((" ".join(words), int(a == b)))
    m = machine(spark, rows)
    foul, group, both, none = m.score(pa.array(["foul lorem", "group lorem", "foul group lorem", "lorem"]))
    assert max(foul, group) < 0.5 < min(both, none)


def test_machine_pairwise_part_equals_the_double_sum():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(0.1, np.arange(9, dtype=np.uint64), rng.normal(size=9), rng.normal(size=(9, 3)), np.ones(1 << 22, bool))
    term, of = np.array([0, 3, 5, 8, 1]), np.array([0, 4, 4, 5])
    got, _ = m.parts(term, of)
    for i in range(3):
        t = term[of[i] : of[i + 1]]
        want = 0.1 + m.weights[t].sum() + sum(m.factors[x] @ m.factors[y] for k, x in enumerate(t) for y in t[:k])
        assert got[i] == pytest.approx(want)
