"""History anti-join, the matching ladder, and fuzzy candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import dice
from ..storage import ship, stored

THRESHOLD = 0.86


def history_verdict(cards: DataFrame, urls: DataFrame, keys: DataFrame) -> DataFrame:
    """cards with ``reason`` (null if fresh) and ``company_known``.

    cards: norm_company, url_norm, role_key. urls: norm_company, url_norm. keys:
    norm_company, role_key. Left joins on distinct keys keep one row per card; the
    planner broadcasts a history that is small and shuffles one that isn't.
    """
    by_url = urls.select("norm_company", "url_norm").distinct().withColumn("u", F.lit(True))
    by_key = keys.select("norm_company", "role_key").distinct().withColumn("k", F.lit(True))
    known = urls.select("norm_company").union(keys.select("norm_company")).distinct().withColumn("c", F.lit(True))
    out = cards.join(by_url, ["norm_company", "url_norm"], "left").join(by_key, ["norm_company", "role_key"], "left").join(known, "norm_company", "left")
    reason = F.when(F.col("u"), "same URL in history").when(F.col("k"), "same company+title+location in history")
    return out.select(*cards.columns, reason.alias("reason"), F.coalesce("c", F.lit(False)).alias("company_known"))


def identity(canon: DataFrame, *columns: str) -> DataFrame:
    """canon with n_<column>, the number of rows that hold the row's value; 0 for an empty one."""
    for c in columns:
        n = F.count(F.lit(1)).over(Window.partitionBy(c))
        canon = canon.withColumn(f"n_{c}", F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", n).otherwise(F.lit(0)))
    return canon


def unique_index(canon: DataFrame, column: str, value: str = "idx") -> DataFrame:
    """column, n, value: how many rows hold a key, and the least of their indexes. Keys stay map-side aggregated."""
    some = canon.filter(F.coalesce(F.col(column).cast("string"), F.lit("")) != "")
    return some.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias(value))


def match_ladder(incoming: DataFrame, canon: DataFrame, aliases: DataFrame) -> DataFrame:
    """incoming(in_id, ext_id, norm) -> kind, matched_idx, rung: id, then name, then alias.

    An id decides alone: one row is a match, several are ambiguous, none is unmatched,
    without a look at the name. A name or alias on several rows needs a person.
    canon: idx, ext_id, norm. aliases: alias_norm, ext_id.
    """
    ids, names = unique_index(canon, "ext_id"), unique_index(canon, "norm")
    alias = aliases.join(ids, "ext_id").groupBy("alias_norm").agg(F.sum("n").alias("n"), F.min("idx").alias("idx"))
    out = (
        incoming.join(ids.select("ext_id", F.col("n").alias("id_n"), F.col("idx").alias("id_idx")), "ext_id", "left")
        .join(names.select("norm", F.col("n").alias("nm_n"), F.col("idx").alias("nm_idx")), "norm", "left")
        .join(alias.select(F.col("alias_norm").alias("norm"), F.col("n").alias("al_n"), F.col("idx").alias("al_idx")), "norm", "left")
    )
    has_id = F.coalesce(F.col("ext_id").cast("string"), F.lit("")) != ""
    rung = F.when(has_id, "id").when(F.col("nm_n").isNotNull(), "name").when(F.col("al_n").isNotNull(), "alias").otherwise("none")
    out = out.withColumn("rung", rung)
    n = F.when(F.col("rung") == "id", F.coalesce("id_n", F.lit(0))).when(F.col("rung") == "name", F.col("nm_n")).when(F.col("rung") == "alias", F.col("al_n")).otherwise(0)
    idx = F.when(F.col("rung") == "id", F.col("id_idx")).when(F.col("rung") == "name", F.col("nm_idx")).otherwise(F.col("al_idx"))
    several = F.when(F.col("rung") == "id", "ambiguous").otherwise("needs_human")
    kind = F.when(n == 1, "matched").when(n > 1, several).otherwise("unmatched")
    return out.withColumn("kind", kind).select(*incoming.columns, "rung", "kind", F.when(F.col("kind") == "matched", idx).alias("matched_idx"))


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, name, in_l, in_r, carried in the order of part and name -> (l_norm, r_norm) of which one begins the other.

    Names that begin the one at hand are a chain, each beginning the next: a stack holds it.
    """
    part, stack = None, []
    for batch in batches:
        left, right = [], []
        for p, name, in_l, in_r, carried in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                part, stack = p, []
            while stack and not name.startswith(stack[-1][0]):
                stack.pop()
            for other, o_l, o_r in () if carried else stack:
                if o_l and in_r:
                    left.append(other)
                    right.append(name)
                if o_r and in_l:
                    left.append(name)
                    right.append(other)
            if name:
                stack.append((name, in_l, in_r))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["l_norm", "r_norm"])


def prefix_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_norm, r_norm) of left(l_norm) and right(r_norm), each distinct, of which one is a beginning of the other and not all of it.

    A range join over sorted names: what begins with a name follows it in one interval. All
    names are sorted once, in ranges; each range is read in order, with the names of earlier
    ranges that begin its first one, as no others of them reach into it. Empty names begin none.
    """
    ship(left.sparkSession)
    both = left.select(F.col("l_norm").alias("name"), F.lit(True).alias("l"), F.lit(False).alias("r")).union(right.select("r_norm", F.lit(False), F.lit(True)))
    both = both.groupBy("name").agg(F.max("l").alias("in_l"), F.max("r").alias("in_r")).filter("name <> ''")
    both = stored(both.repartitionByRange("name").withColumn("part", F.spark_partition_id()), "names")
    firsts = both.groupBy("part").agg(F.min("name").alias("first"))
    begins = firsts.select("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda i: F.left("first", i))).alias("name")).filter("name is not null")
    carried = begins.join(both.withColumnRenamed("part", "home"), "name").filter("home < part").select("part", "name", "in_l", "in_r", F.lit(True).alias("carried"))
    rows = both.select("part", "name", "in_l", "in_r", F.lit(False).alias("carried")).union(carried)
    return rows.repartition("part").sortWithinPartitions("part", "name").mapInArrow(_nested, "l_norm string, r_norm string")


def fuzzy_candidates(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (l_norm, r_norm) of different names whose words have Dice >= threshold, or one of which begins the other.

    Not a cross join. Dice of t or more needs a common word among the rarest of either
    name: with n words at least ceil(n t / (2 - t)) are common, so one of the first
    n - that + 1 words, by rising frequency, is. Names whose numbers of words are too far
    apart are left out within that join. The prefix rule is a range join of sorted names.
    """
    l_, r_ = left.select(F.col("norm").alias("l_norm")).distinct(), right.select(F.col("norm").alias("r_norm")).distinct()
    words = lambda df, c: df.select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("w")).filter("w <> ''")
    lw, rw = words(l_, "l_norm"), words(r_, "r_norm")
    common = lw.select("w").union(rw.select("w")).groupBy("w").agg(F.count(F.lit(1)).alias("f"))

    def prefix(df, c):
        ranked = df.join(common, "w").groupBy(c).agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("ws"))
        n = F.size("ws")
        keep = n - F.ceil(n * F.lit(threshold / (2 - threshold)) - F.lit(1e-9)).cast("int") + 1
        return ranked.select(c, n.alias(f"n_{c}"), F.explode(F.slice("ws", F.lit(1), keep)).alias("x")).select(c, f"n_{c}", F.col("x.w").alias("w"))

    # of n and m words at most the lesser number are common, so Dice is at most twice that through n + m
    n, m = F.col("n_l_norm"), F.col("n_r_norm")
    alike = 2 * F.least(n, m) >= (n + m) * F.lit(threshold) - 1e-9
    by_words = prefix(lw, "l_norm").join(prefix(rw, "r_norm"), "w").filter(alike).select("l_norm", "r_norm").distinct()
    pairs = by_words.union(prefix_pairs(l_, r_)).distinct().filter("l_norm <> r_norm")
    ratio = dice(F.col("l_norm"), F.col("r_norm"))
    begins = F.col("l_norm").startswith(F.col("r_norm")) | F.col("r_norm").startswith(F.col("l_norm"))
    return pairs.withColumn("ratio", ratio).filter((F.col("ratio") >= threshold) | begins)


def value_changes(was: DataFrame, now: DataFrame, key: str, columns: list[str], dates: tuple[str, ...] = ()) -> DataFrame:
    """key, column, was, now of every value that differs; an empty new value changes nothing."""
    from ..functions.normalize import same_value, text

    a = was.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    b = now.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("was"), F.col(f"b_{c}").alias("now"), same_value(F.col(f"a_{c}"), F.col(f"b_{c}"), c in dates).alias("same")) for c in columns])
    out = a.join(b, key).select(key, F.explode(cells).alias("x")).select(key, "x.*")
    return out.filter((F.trim(text(F.col("now"))) != "") & ~F.col("same")).drop("same")
