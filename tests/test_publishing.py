"""Verdicts, roles, publishing, profiles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import publishing as pub
from ledgerloom.operators import workflow
from ledgerloom.operators.registry import Refused
from ledgerloom.sources import profiles


def test_labels(spark):
    rows = [("exclude", False, None), ("shortlist", False, None), ("shortlist", True, 80), ("review", True, None)]
    df = spark.createDataFrame(rows, "d string, r boolean, s int")
    assert [r[0] for r in df.select(pub.label(F.col("d"), F.col("r"), F.col("s"))).collect()] == ["fuori profilo", "non_risolto", "pertinente", "adiacente"]
    with pytest.raises(Exception, match="score out of range"):
        spark.createDataFrame([("shortlist", True, 101)], df.schema).select(pub.label(F.col("d"), F.col("r"), F.col("s"))).collect()


@pytest.fixture
def rows(spark):
    cards = spark.createDataFrame([("1", "A | B", "Co", "Milan", "https://x.test/1", "portal"), ("2", "C", "Co", "Rome", "https://x.test/2", "portal"), ("3", "D", "Co", "Rome", "https://x.test/3", "portal")], "sourceJobId string, title string, company string, location string, url string, source string")
    posts = spark.createDataFrame([("1", "we  want\nyou", False), ("2", "", True)], "sourceJobId string, desc string, closedOnPage boolean")
    schema = "id string, label string, score int, quotes array<string>, ground string, company string, url string, location string, workMode string, stageNature boolean, applicationOpen boolean, requiredLanguages array<string>, languageRequirement string"
    none = (None,) * 7
    v = [("1", "pertinente", 90, ["want you"], None, None, "https://co.test/1", *none[:1], "hybrid", None, None, ["it"], None), ("2", "adiacente", 50, ["nope"], None, None, None, None, None, None, None, None, None), ("9", "odd", None, None, None, None, None, None, None, None, None, None, None)]
    return cards, spark.createDataFrame(v, schema), posts


def test_problems_are_all_named(rows):
    cards, verdicts, posts = rows
    got = {r.id: r.problems for r in pub.judged(verdicts, cards, posts).collect()}
    assert got == {"1": [], "2": ["description not read: 2", "quote not in the text: 2"], "9": ["no such card: 9", "unknown label: 9"]}
    assert [r.sourceJobId for r in pub.unresolved(cards, verdicts).collect()] == ["3"]


def test_declared_and_new_roles(spark, rows):
    cards, verdicts, posts = rows
    j = pub.judged(verdicts, cards, posts)
    d = {r.id: r for r in pub.declared(j).collect()}
    assert (d["1"].applicationOpen, d["1"].languageRequirement, d["2"].applicationOpen, d["2"].requiredLanguages) == (True, "all", False, None)
    got = pub.new_roles(j, spark.createDataFrame([("https://x.test/2?utm_x=1",)], "url string")).collect()
    assert [(r.title, r.url, r.alternates, r.mode) for r in got] == [("A / B", "https://co.test/1", ["https://x.test/1"], "Hybrid (dichiarato)")]


def test_versions_are_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "table")
    assert pub.publish(spark.range(2), path) == 1
    assert pub.publish(spark.range(3), path, expected_version=1) == 2
    with pytest.raises(Refused, match="version 2"):
        pub.publish(spark.range(9), path, expected_version=1)
    assert pub.published(spark, path).count() == 3
    with pytest.raises(Refused):
        pub.gate_counts(3, 2, 1)


def test_upsert_and_notes(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(map(tuple, pub.upsert(a, b, "k").collect())) == [(1, "a"), (2, "c")]
    n = spark.range(1).select(pub.merged_notes(F.lit("Match score: 7/100. fine"), F.lit("mine"), F.lit("2026-01-01")).alias("n")).first().n
    assert (n.scores, n.note) == ("7", "fine\n— nota della persona (2026-01-01): mine")


def test_profile(tmp_path):
    (tmp_path / "A2-p.md").write_text("- master_id: `m1`\n### UX\n**Presenza nel percorso:** alta\n**Termini di ricerca:** ux design, ui\n**Termini di ricerca bis:** no\n### Law\n**Presenza nel percorso:** Non prevista\n**Termini di ricerca:** law\n`termini:` set design; stage\n")
    (tmp_path / "A3-c.yaml").write_text("master_id: m1\nedition: ED1\nhistory_file: h.csv\njob_languages:\n  - it\n  - en\n")
    config, who = profiles.load(tmp_path, ["intern"])
    assert config.areas == {"UX": ["ux design", "ui"]} and config.false_friends == ["set design", "stage"] and config.admitted_languages == ["it", "en"]
    assert (who["master_id"], who["edition"]) == ("m1", "ED1")
    assert config.pairs() == [("ux design intern", "UX"), ("ui intern", "UX")]
    (tmp_path / "A3-c.yaml").write_text("master_id: other\n")
    with pytest.raises(Refused) as e:
        profiles.load(tmp_path, [])
    assert len(e.value.problems) == 2


def test_refused_rows_are_kept_and_old_versions_go(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(5)
    for i in range(5):
        assert pub.publish(df.limit(i + 1), path, i, keep=3) == i + 1
    assert pub.versions(spark, path) == [3, 4, 5]
    with pytest.raises(Refused, match="version 5, not 2; its rows are in"):
        pub.publish(df.limit(2), path, 2, aside=True)
    with pytest.raises(Refused):
        pub.publish(df.limit(1), path, 2)
    (kept,) = pub.refused(spark, path)
    assert spark.read.parquet(kept).count() == 2
    assert pub.published(spark, path).count() == 5
    assert pub.refused(spark, str(tmp_path / "none")) == []


def test_steps_wait_for_the_rows_that_were_looked_at(spark, tmp_path):
    ran = []
    steps = {n: (lambda done, n=n: ran.append(n) or (done["a"] if n == "b" else spark.range(3))) for n in ("a", "b", "c")}
    path = str(tmp_path)
    done, waits, word = workflow.run_steps(spark, path, steps, {})
    assert (list(done), waits, ran) == (["a"], "a", ["a"])
    with pytest.raises(Refused, match="not what is there"):
        workflow.run_steps(spark, path, steps, {"a": "no such"})
    done, waits, more = workflow.run_steps(spark, path, steps, {"a": word})
    assert (list(done), waits, ran) == (["a", "b"], "b", ["a", "b"])
    pub.publish(spark.range(4), f"{path}/a")  # what was confirmed has changed
    with pytest.raises(Refused, match="a: what was confirmed"):
        workflow.run_steps(spark, path, steps, {"a": word, "b": more})
    _, waits, _ = workflow.run_steps(spark, path, steps, {"a": workflow.token(spark, f"{path}/a"), "b": more})
    assert waits is None and ran == ["a", "b", "c"]
