"""Parsers, readers, the paged source and the guard, in batch and streaming."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.registry import Refused
from ledgerloom.sources import cards, files, paged
from ledgerloom.streaming import guard

SERP = """<ul><li><div data-entity-urn="urn:li:jobPosting:11"><h3 class="base-search-card__title"> UX &amp; Design </h3><h4 class="base-search-card__subtitle"><a>Acme</a></h4>
<span class="job-search-card__location"> Milan </span><a class="base-card__full-link" href="https://x.test/j/11?trk=1">x</a><time>2 days ago</time></div><li><div>advert</div>
<li><div data-entity-urn="urn:li:jobPosting:12"><h3 class="base-search-card__title">Second</h3></div></ul>"""


def test_guest_cards(spark):
    got = cards.as_cards(cards.guest_cards(spark.createDataFrame([(SERP, "q")], "html string, query string"))).orderBy("sourceJobId").collect()
    assert [(r.title, r.company, r.location, r.url, r.snippet) for r in got] == [
        ("UX & Design", "Acme", "Milan", "https://x.test/j/11", "posted: 2 days ago"),
        ("Second", "", "", "https://www.linkedin.com/jobs/view/12/", ""),
    ]


def test_article_cards_part_at_last_dash(spark):
    html = '<article class="job-card"><div class="job-card-title"><a href="https://c.test/x-77">Stage</a></div><div class="job-card-work-place"><a>Nazca - Lab srl - Milano (MI)</a></div><i class="data_pubblicazione">01/02/2026<'
    r = cards.article_cards(spark.createDataFrame([(html, "q")], "html string, query string")).first()
    assert (r.company, r.location, r.sourceJobId, r.posted) == ("Nazca - Lab srl", "Milano (MI)", "cerc:77", "01/02/2026")


def test_posting(spark):
    html = '<div class="show-more-less-html__markup x">One<br>two &amp; <b>three</b></p></div>No longer accepting applications'
    r = spark.range(1).select(cards.posting(F.lit(html)).alias("p")).first().p
    assert (r.desc, r.closed) == ("One\ntwo & three", True)


def test_boards(spark):
    bodies = {
        "greenhouse": {"jobs": [{"id": 1, "title": "Design Intern", "location": {"name": "Milan"}, "absolute_url": "u1"}, {"id": 2, "title": "Cook", "absolute_url": "u2"}]},
        "lever": [{"id": "a", "text": "Design lead", "workplaceType": "remote", "hostedUrl": "u3"}],
        "ashby": {"jobs": [{"id": "z", "title": "Intern", "isRemote": True, "workplaceType": "Hybrid"}, {"id": "y", "title": "Intern", "isListed": False}]},
    }
    got = {k: cards.board_cards(spark.createDataFrame([("b", "Co", json.dumps(v)), ("c", "Co", "not json")], "board string, company string, body string"), k, ["design intern"]).collect() for k, v in bodies.items()}
    assert [r.title for r in got["greenhouse"]] == ["Design Intern"]
    assert [(r.workMode, r.location) for r in got["lever"]] == [("fully_remote", "To verify")]
    assert [(r.sourceJobId, r.workMode) for r in got["ashby"]] == [("ashby:z", "hybrid")]
    with pytest.raises(ValueError, match="one, two"):
        cards.check_boards([("two", "b", "c"), ("one", "b", "c")])


def test_a_failing_source_is_reported(spark):
    def fails():
        raise OSError("down")

    found, report = cards.discover({"good": lambda: spark.createDataFrame([("t", 1)], "title string, ord long"), "bad": fails})
    assert found.count() == 1
    assert [r["status"] for r in report] == ["ok", "error"]


def test_a_capped_source_says_so(spark):
    df = spark.createDataFrame([(f"t{i:04d}",) for i in range(5010)], "title string")
    found, report = cards.discover({"all": lambda: df})
    assert found.count() == 5010 and (report[0]["status"], report[0]["cards"]) == ("ok", 5010)
    for n in (1, 7):
        found, report = cards.discover({"some": lambda n=n: df.repartition(n)}, cap=3)
        assert sorted(r.title for r in found.collect()) == ["t0000", "t0001", "t0002"]
        assert (report[0]["status"], report[0]["cards"]) == ("capped", 3)


def test_tsv_of_another_width_is_refused(spark, tmp_path):
    p = tmp_path / "run.tsv"
    p.write_text("a\tb\nx\ty\nz\n[note\tq\n")
    with pytest.raises(Refused, match="1 fields"):
        files.read_tsv(spark, str(p), ["a", "b"])
    p.write_text("a\tb\nx\ty\n\tq\n[note\tq\n")
    assert [r.a for r in files.read_tsv(spark, str(p), ["a", "b"]).collect()] == ["x"]


def test_history_round_trip(spark, tmp_path):
    p = tmp_path / "h.csv"
    header = ";".join(files.REGISTRY)
    cells = dict.fromkeys(files.REGISTRY, "") | {files.NAME: "Acme S.p.A.", "Matching Job Titles": '"1. UX Intern — Milan\n2. ""Lead"""', "Job Links": "https://x.test/1?utm_x=1", "Locations": "Milano"}
    p.write_text("﻿" + header + "\n" + ";".join(cells[c] for c in files.REGISTRY) + "\n" + header + "\n")
    urls, keys = files.history(files.read_semicolon(spark, str(p), (files.NAME,)))
    assert [tuple(r) for r in urls.collect()] == [("acme", "https://x.test/1")]
    assert sorted(r.role_key for r in keys.collect()) == ["x:acme|lead|milan", "x:acme|ux intern|milan"]
    with pytest.raises(Refused):
        files.read_semicolon(spark, str(p), ("Nope",))


def test_log_skips_torn_lines_and_last_wins(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"key":"a","cards":[]}\n{"key":"a","cards":[{"title":"t","url":"u"}]}\n{"key":"b","ca')
    got = files.read_log(spark, str(p)).collect()
    assert [(r.key, len(r.cards)) for r in got] == [("a", 1)]


def test_small_lists(spark, tmp_path):
    a = tmp_path / "agg.csv"
    a.write_text("# c\npattern;note\norienta;x;y\n")
    assert [(r.pattern, r.note) for r in files.read_aggregators(spark, str(a)).collect()] == [("orienta", "x;y")]
    t = tmp_path / "t.txt"
    t.write_text("# c\nhttps://a.test\nLab;https://b.test\nTab\thttps://c.test\n")
    assert [(r.label, r.url) for r in files.read_targets(spark, str(t)).collect()] == [("", "https://a.test"), ("Lab", "https://b.test"), ("Tab", "https://c.test")]


def test_paged_source_resumes(spark, tmp_path):
    for q, p in (("a", "x"), ("a", "y")):
        (tmp_path / q / p).mkdir(parents=True)
        for i in range(2):
            (tmp_path / q / p / f"{i}.html").write_text(f"{q}{p}{i}")
    spark.dataSource.register(paged.PagedSource)
    read = lambda done: spark.read.format("paged").options(root=str(tmp_path), queries="a|b", places="x|y", done=done).load()
    assert sorted(r.html for r in read("").collect()) == ["ax0", "ax1", "ay0", "ay1"]
    assert sorted(r.html for r in read("a — x").collect()) == ["ay0", "ay1"]


def loop(outcomes, **limits):
    g = guard.Guard(**limits)
    for o in outcomes:
        g.see(o)
    return g


def test_guard_rules():
    assert loop(["error"] * 7 + ["ok"] + ["error"] * 7).stopped is False
    assert loop(["error"] * 4 + ["gone"] + ["error"] * 4).reason.startswith("error")
    assert loop(["403", "ok"]).unsent == 1
    assert loop(["429"] * 5).reason == "blocked: 5 x HTTP 429"
    assert loop((["429"] * 5 + ["ok"]) * 2, max_cooldowns=3).cooldowns == 2
    assert "no success" in loop(["429"] * 10, max_cooldowns=3).reason


def test_guard_in_batch_and_stream_equals_the_loop(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = [(f"s{i % 5}", i, rng.choice(["ok", "error", "429", "gone"])) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, seq long, outcome string")
    want = {s: loop([o for x, _, o in rows if x == s], max_cooldowns=2) for s in {r[0] for r in rows}}
    got = {r.source: r for r in guard.health(df, max_cooldowns=2).collect()}
    assert all(got[s].requests == g.requests and got[s].reason == g.reason for s, g in want.items())
    for i in range(2):
        df.filter(f"seq % 2 >= 0 and seq between {i * 150} and {i * 150 + 149}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = guard.health_stream(stream, max_cooldowns=2).writeStream.queryName("guard_out").format("memory").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    last = {r.source: r for r in spark.table("guard_out").orderBy("requests", "unsent").collect()}
    assert set(last) == set(want)
    assert all(last[s].requests == g.requests and last[s].unsent == g.unsent for s, g in want.items())


def hot_rows(seed, n, hot=0.7):
    import random

    rng = random.Random(seed)
    kinds = ["ok"] * 6 + ["error"] * 5 + ["429", "gone", "other"] + ["403"] * (seed % 3 == 0)
    return [("hot" if rng.random() < hot else rng.choice(["a", "b", None, "c"]), i * 7 % n, rng.choices(kinds[: rng.choice([7, len(kinds)])])[0]) for i in range(n)]


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"max_cooldowns": 0}), (3, {"max_429": 2, "max_errors": 5, "max_cooldowns": 3}), (4, {"max_429": 1, "max_errors": 9, "max_cooldowns": 40}), (5, {"max_429": 30, "max_errors": 4})])
def test_a_hot_source_over_many_chunks_equals_the_loop(spark, seed, limits):
    rows = hot_rows(seed, 1501)
    df = spark.createDataFrame(rows, "source string, seq long, outcome string")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = guard._chunks(df)
        assert chunks.filter("source = 'hot'").select("chunk").distinct().count() > 5
        got = {r.source: r.asDict() for r in guard.health(df, **limits).collect()}
        sent = {(r.source, r.seq): r.sent for r in guard.drained(df, **limits).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for s in {r[0] for r in rows}:
        own, g = sorted((r for r in rows if r[0] == s), key=lambda r: r[1]), guard.Guard(**limits)
        for _, seq, outcome in own:
            assert sent[s, seq] == (not g.stopped)
            g.see(outcome)
        assert got[s] == g.row(s), (s, limits)


def test_guard_of_nothing_and_without_python(spark):
    empty = spark.createDataFrame([], "source string, seq long, outcome string")
    assert guard.health(empty).collect() == [] and guard.drained(empty).collect() == []
    plan = guard.health(empty.union(empty))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_watch_of_one_source():
    w = guard.Watch(10, 100)
    seen = [x for t, o in ((0, "ok"), (5, "429"), (7, "ok"), (14, "429"), (15, "ok"), (200, "ok")) for x in w.see(t, o)]
    assert seen == [("cooldown", 5), ("held", 7), ("held", 14), ("resumed", 15), ("silent", 15)]
    assert w.due() == [300] and list(w.pass_to(300)) == [("silent", 200)] and w.due() == []


@pytest.mark.parametrize("batches", [1, 4])
def test_timers_equal_a_plain_loop_however_the_stream_is_cut(spark, tmp_path, batches):
    import random

    rng = random.Random(batches)
    hour = 3_600_000
    rows = sorted({(rng.randrange(0, 400 * hour), f"s{rng.randrange(6)}", rng.choice(["ok", "429", "ok"])) for _ in range(150)} | {(t * hour, "s9", "ok") for t in (1, 2)})
    df = spark.createDataFrame([(s, i, o, t) for i, (t, s, o) in enumerate(rows)], "source string, seq long, outcome string, ms long").selectExpr("source", "seq", "outcome", "timestamp_millis(ms) as ts")
    for i in range(batches):
        df.filter(f"seq div {-(-len(rows) // batches)} = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = guard.watched(stream, 5 * hour, 20 * hour, "1 hour").writeStream.queryName(f"watched{batches}").format("memory").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(200)
    watches, want = {}, []
    for t, s, o in rows:
        want += [(s, *x) for x in watches.setdefault(s, guard.Watch(5 * hour, 20 * hour)).see(t, o)]
    mark = rows[-1][0] - hour - 1  # timers before the watermark have run out
    for s, w in watches.items():
        while any(t <= mark for t in w.due()):
            want += [(s, *x) for x in w.pass_to(mark)]
    assert sorted(map(tuple, spark.table(f"watched{batches}").collect())) == sorted(want)
    assert any(k == "silent" and s == "s9" for s, k, _ in want) and any(k == "resumed" for _, k, _ in want)
