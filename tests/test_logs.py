"""Line numbers over files and splits, the run log, and the paged source as a stream."""

from __future__ import annotations

import json
import os
import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerloom.operators.registry import Refused
from ledgerloom.sources import files, lines, paged, runlog

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_of_several_files_and_splits(spark, tmp_path, small_splits):
    want = []
    for name, n in (("b", 400), ("a", 37), ("c", 1), ("d", 0)):
        rows = ["" if i % 11 == 3 else f"{name} {i} " + "x" * (i % 50) for i in range(n)]
        (tmp_path / name).write_text("".join(r + "\n" for r in rows))
        want += [(name, i, r) for i, r in enumerate(rows, 1)]
    df = lines.read_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert sorted((r.file.rpartition("/")[2], r.line, r.value) for r in df.collect()) == sorted(want)
    some = df.filter("value like 'b%'").select("line", "value").collect()
    assert all(r.value.startswith(f"b {r.line - 1} ") for r in some) and len(some) > 300


def test_a_bad_row_is_named_by_its_line(spark, tmp_path, small_splits):
    p = tmp_path / "run.tsv"
    p.write_text("".join("one\ttwo\n" for _ in range(5000)) + "only one\n")
    with pytest.raises(Refused, match="run.tsv, line 5001: 1 fields"):
        files.read_tsv(spark, str(p), ["a", "b"])


def test_the_newest_file_of_a_log_wins_though_it_is_the_larger(spark, tmp_path):
    for i, (name, pad) in enumerate((("z.jsonl", 1), ("a.jsonl", 900))):
        p = tmp_path / name
        p.write_text("".join(json.dumps({"key": f"k{k}", "cards": [{"title": f"{i}", "url": "u" * pad}]}) + "\n" for k in range(3)))
        os.utime(p, (1000 + i, 1000 + i))
    assert {(r.key, r.cards[0].title) for r in files.read_log(spark, str(tmp_path)).collect()} == {("k0", "1"), ("k1", "1"), ("k2", "1")}


def test_order_of_rows_in_several_csv_files(spark, tmp_path):
    (tmp_path / "2.csv").write_text("url;v\n" + "".join(f"https://x.test/{i};new{i}\n" for i in range(50)))
    (tmp_path / "1.csv").write_text("url;v\nhttps://x.test/1;old\nhttps://x.test/99;kept\n")
    got = {r.url_norm: r.v for r in files.sidecar(files.read_semicolon(spark, str(tmp_path)), ("url",)).collect()}
    assert got["https://x.test/1"] == "new1" and got["https://x.test/99"] == "kept" and len(got) == 51


SCHEMA = "key string, n long"


def log_of(spark, path):
    return [(r.key, r.n, r.batch, r.seq) for r in runlog.read(spark, path, SCHEMA).orderBy("batch", "seq").collect()]


def test_run_log_keeps_the_order_of_its_writing(spark, tmp_path, small_splits):
    path = str(tmp_path / "log")
    assert log_of(spark, path) == []
    first = spark.range(3).select(F.lit("a").alias("key"), F.col("id").alias("n"))
    runlog.append(first.orderBy("n"), path)
    second = spark.range(200).select(F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("key"), F.col("id").alias("n"))
    runlog.append(second.repartition(5).orderBy(F.desc("n")), path)
    runlog.append(first.filter("n > 5"), path)  # a batch without rows
    want = [("a", i, 0, i) for i in range(3)]
    want += [(f"k{(199 - i) % 7}", 199 - i, 1, i) for i in range(200)]
    assert log_of(spark, path) == want
    last = {r.key: r.n for r in runlog.latest(runlog.read(spark, path, SCHEMA), "key").collect()}
    assert last == {"a": 2} | {f"k{i}": i for i in range(7)}


def test_an_append_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(40).select(F.lit("a").alias("key"), F.col("id").alias("n"))
    runlog.append(rows.filter("n < 2"), path)
    with pytest.raises(Exception, match="torn off"):
        runlog.append(rows.repartition(4).withColumn("n", F.when(F.col("n") == 39, F.raise_error(F.lit("torn off")).cast("long")).otherwise(F.col("n"))), path)
    runlog.append(rows.filter("n = 7"), path)
    assert log_of(spark, path) == [("a", 0, 0, 0), ("a", 1, 0, 1), ("a", 7, 1, 0)]
    with pytest.raises(Exception, match="never overwritten"):
        rows.write.format("runlog").mode("overwrite").save(path)


def test_a_torn_line_is_skipped_and_counted(spark, tmp_path):
    path = tmp_path / "log"
    runlog.append(spark.range(3).select(F.lit("é\n").alias("key"), F.col("id").alias("n")).orderBy("n").coalesce(1), str(path))
    data = next((path / "data").glob("*.jsonl"))
    text = data.read_text().split("\n")
    data.write_text("\n".join([text[0], text[1][:9], text[2]]) + "\n")
    assert log_of(spark, str(path)) == [("é\n", 0, 0, 0), ("é\n", 2, 0, 2)]


def test_two_commits_never_share_a_batch(tmp_path):
    (tmp_path / "data").mkdir()
    writers = [runlog.RunLogWriter(str(tmp_path)) for _ in range(8)]
    threads = [threading.Thread(target=w.commit, args=([runlog.Written(0, f"{i}.jsonl", 1)],)) for i, w in enumerate(writers)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = sorted((tmp_path / "commits").iterdir())
    assert [p.name for p in found] == [f"{i:012d}.jsonl" for i in range(8)]
    assert {json.loads(p.read_text())["file"] for p in found} == {f"{i}.jsonl" for i in range(8)}


class Breaking(paged.Pages):
    """Fails at one unit once, after it has given some of its pages."""

    def fetch(self, query, place, page):
        flag = os.path.join(self.root, "broken")
        if (query, place, page) == ("b", "y", 1) and not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("cut off")
        with open(os.path.join(self.root, "asked"), "a") as f:
            f.write(f"{query}{place}{page}\n")
        return super().fetch(query, place, page)


class BreakingSource(paged.PagedSource):
    pages = Breaking

    @classmethod
    def name(cls):
        return "breaking"


def saved_pages(root, queries, places):
    for q in queries:
        for p in places:
            (root / q / p).mkdir(parents=True)
            for i in range(3):
                (root / q / p / f"{i}.html").write_text(f"{q}{p}{i}")


def test_a_run_that_is_cut_off_gives_each_page_once(spark, tmp_path):
    saved_pages(tmp_path, "abc", "xy")
    options = {"root": str(tmp_path), "queries": "a|b|c", "places": "x|y", "units_per_batch": "2", "lanes": "1"}
    to = str(tmp_path / "out")
    with pytest.raises(Exception, match="cut off"):
        paged.collect(spark, options, to, BreakingSource)
    with pytest.raises(Refused, match="resume"):
        paged.collect(spark, options, to, BreakingSource)
    got = paged.collect(spark, options, to, BreakingSource, resume=True).collect()
    assert sorted(r.html for r in got) == sorted(f"{q}{p}{i}" for q in "abc" for p in "xy" for i in range(3))
    assert [r.ord for r in sorted(got, key=lambda r: r.ord)][:4] == [0, 1, 2, 1 << 32]
    asked = (tmp_path / "asked").read_text().split()
    assert asked.count("ax0") == 1 and asked.count("bx0") == 2  # only the batch that was cut off is asked for again
    assert sorted(r.html for r in paged.collect(spark, options, to, BreakingSource, resume=True).collect()) == sorted(r.html for r in got)
    with pytest.raises(Exception, match="other queries"):
        paged.collect(spark, options | {"queries": "b|a|c|d"}, to, BreakingSource, resume=True)


def test_queries_may_be_added_to_a_checkpoint(spark, tmp_path):
    saved_pages(tmp_path, "ab", "x")
    options = {"root": str(tmp_path), "queries": "a", "places": "x"}
    to = str(tmp_path / "out")
    assert paged.collect(spark, options, to).count() == 3
    got = paged.collect(spark, options | {"queries": "a|b"}, to, resume=True)
    assert sorted(r.html for r in got.collect()) == ["ax0", "ax1", "ax2", "bx0", "bx1", "bx2"]
    assert paged.collect(spark, options | {"queries": ""}, str(tmp_path / "none")).count() == 0
