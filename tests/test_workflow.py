"""Commands, refusals and the paged source's lanes."""

from __future__ import annotations

import json
import time

import pytest

from ledgerloom import __main__ as cli
from ledgerloom.operators import publishing, registry, workflow
from ledgerloom.sources import paged


@pytest.fixture()
def tables(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return str(tmp_path / name)

    return put


def test_discover_read_and_resume(spark, tables, tmp_path, capsys):
    cards = [(i, f"Design intern {i}", "Acme", "Milan, Italy", f"https://x.test/{i % 3}", "", None, [], None, "portal", "design intern") for i in range(6)]
    c = tables("cards", cards, "ord long, title string, company string, location string, url string, snippet string, sourceJobId string, alternateUrls array<string>, workMode string, source string, discoveryQuery string")
    a = tables("agg", [("orienta", 1)], "pattern string, entry_ord int")
    u, k = tables("urls", [("acme", "https://x.test/0")], "norm_company string, url_norm string"), tables("keys", [], "norm_company string, role_key string")
    args = ["discover", "--cards", c, "--aggregators", a, "--urls", u, "--keys", k, "--areas", json.dumps({"A": ["design"]}), "--out", str(tmp_path / "run")]
    assert cli.main(args) == 0
    got = {r.outcome: r.n for r in publishing.published(spark, str(tmp_path / "run")).groupBy("outcome").count().withColumnRenamed("count", "n").collect()}
    assert got == {"merged": 3, "duplicate": 1, "kept": 2}
    assert cli.main(args) == 2 and "checkpoint" in capsys.readouterr().out
    assert cli.main([*args, "--resume"]) == 0
    assert cli.main(["queries"]) == 0 and "guest_cards" in capsys.readouterr().out


def test_verify_admit_doctor_and_review(spark, tables, tmp_path, capsys):
    pages = tables("pages", [("<title>UX intern</title> apply now", True, "ok", "")], "html string, reachable boolean, kind string, detail string")
    assert cli.main(["verify", "--pages", pages, "--out", str(tmp_path / "v")]) == 0
    assert publishing.published(spark, str(tmp_path / "v")).first().status.startswith(("Employer verified", "To verify"))
    rows = tables("declared", [("Senior manager", True, "onsite", True, ["de"], "all")], "title string, stageNature boolean, workMode string, applicationOpen boolean, requiredLanguages array<string>, languageRequirement string")
    assert cli.main(["admit", "--declared", rows, "--languages", "english", "--out", str(tmp_path / "a")]) == 0
    assert publishing.published(spark, str(tmp_path / "a")).first().ground == "mandatory-language"
    companies = tables("co", [("Acme", "Gone", "Review", "", "31/02/2026")], "`Company / Outreach Account` string, `Contact Search Status` string, `Outreach Decision` string, `Verification Status` string, `Last Checked` string")
    assert cli.main(["doctor", "--companies", companies, "--out", str(tmp_path / "d")]) == 0
    assert {r.check: r.n for r in publishing.published(spark, str(tmp_path / "d")).collect() if r.n} == {"status": 1, "Last Checked": 1}
    review = ["init-review", "--companies", companies, "--columns", workflow.NAME, "--to", str(tmp_path / "r")]
    assert [cli.main(review), cli.main(review), cli.main([*review, "--force"])] == [0, 2, 0]


def test_stage_refuses_with_the_number_of_all_problems(spark):
    df = spark.range(1500).selectExpr("concat('p', id) as problem")
    with pytest.raises(registry.Refused) as e:
        registry.refuse_on(df, most=7)
    assert (e.value.n, len(e.value.problems)) == (1500, 7) and "1500" in str(e.value)
    registry.refuse_on(df.filter("false"))


def test_one_rate_for_all_lanes(spark, tmp_path):
    for q in "ab":
        (tmp_path / q / "x").mkdir(parents=True)
        for i in range(12 if q == "a" else 2):
            (tmp_path / q / "x" / f"{i}.html").write_text(f"{q}{i}")
    spark.dataSource.register(paged.PagedSource)
    read = spark.read.format("paged").option("root", str(tmp_path)).option("queries", "a|b").option("places", "x")
    assert read.load().count() == 14
    assert read.option("pages", "3").load().count() == 5
    began = time.time()
    assert read.option("pages", "3").option("gap_seconds", "0.2").option("lanes", "2").load().count() == 5
    assert time.time() - began >= 0.8
    reader = paged.PagedReader({"root": str(tmp_path), "queries": "a|b", "places": "x|y", "gap_seconds": "1", "done": "a — y"})
    assert [p.pairs for p in reader.partitions()] == [[("a", "x", 0), ("b", "x", 2), ("b", "y", 3)]]


def test_resume_is_asked_for():
    paged.check_resume(False, False)
    paged.check_resume(True, True)
    with pytest.raises(registry.Refused):
        paged.check_resume(True, False)
