"""Relevance score, top-K with both sides kept, query fan-out, and area tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import LEFT, RIGHT, text
from .gates import intern_signal

#: Keys that are broadcast at most.
MOST_BROADCAST = 100_000


def literal_words(term: str) -> str:
    """A term as a pattern between ASCII word boundaries."""
    safe = "".join("\\" + ch if ch in r".*+?^${}()|[]\/-" else ch for ch in term)
    return f"(?i){LEFT}{safe}{RIGHT}"


def stands_in(hay: Column, low: Column, term: str) -> Column:
    """Whether a term stands in ``hay`` as words; ``low`` is hay in lower case, which is searched first as that is cheap."""
    found = hay.rlike(literal_words(term))
    return F.contains(low, F.lit(term.lower())) & found if term.isascii() else found


def with_score(df: DataFrame, title: Column, snippet: Column, false_friends: list[str], terms: list[str]) -> DataFrame:
    """df with ``score`` (0..1) and ``reasons``. Terms are counted as often as they are listed.

    Each text is searched once for each term, in a projection of its own: within the
    branches of the score and of the reasons the searches would be repeated.
    """
    friends, terms = [t for t in false_friends if t], [t for t in terms if t]
    each = list(dict.fromkeys([*friends, *terms]))
    names = df.columns
    hay = F.concat(text(title), F.lit("\n"), text(snippet))
    out = df.select(*[F.col(f"`{c}`") for c in names], text(title).alias("_title"), hay.alias("_hay"), F.lower(hay).alias("_low"))
    flags = [intern_signal(F.col("_title")).alias("_in_title"), F.when(intern_signal(F.col("_title")), False).otherwise(intern_signal(F.col("_hay"))).alias("_in_text")]
    flags += [stands_in(F.col("_hay"), F.col("_low"), t).alias(f"_t{i}") for i, t in enumerate(each)]
    out = out.select(*[F.col(f"`{c}`") for c in names], *flags)
    flag = lambda t: F.col(f"_t{each.index(t)}")
    first = F.coalesce(*[F.when(flag(t), t) for t in friends]) if friends else F.lit(None).cast("string")
    hits = sum((flag(t).cast("int") for t in terms), F.lit(0))
    value = F.lit(0.3) + F.when(F.col("_in_title"), 0.3).when(F.col("_in_text"), 0.15).otherwise(0.0) - F.when(first.isNotNull(), 0.25).otherwise(0.0)
    if terms:
        value = value + hits / F.lit(float(len(terms))) * F.lit(0.25)
    reasons = F.array(
        F.when(F.col("_in_title"), "intern-signal-in-title").when(F.col("_in_text"), "intern-signal-in-snippet"),
        F.concat(F.lit("false-friend:"), first),
        F.when(hits > 0, F.concat(F.lit("query-terms:"), hits.cast("string"), F.lit(f"/{len(terms)}"))) if terms else F.lit(None).cast("string"),
    )
    return out.select(*[F.col(f"`{c}`") for c in names], F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("score"), F.array_compact(reasons).alias("reasons"))


def term_hits(df: DataFrame, hay: Column, terms: list[str]) -> DataFrame:
    """term, hits: how many rows each term stands in, zero included. One pass, one row out before the unpivot."""
    df = df.select(hay.alias("_hay"), F.lower(hay).alias("_low"))
    sums = [F.count_if(stands_in(F.col("_hay"), F.col("_low"), t)).alias(f"t{i}") for i, t in enumerate(terms)]
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("hits")) for i, t in enumerate(terms)])
    return df.agg(*sums).select(F.explode(pairs).alias("x")).select("x.*")


def split_top(df: DataFrame, k: int, order: list[Column], key: str) -> DataFrame:
    """df with ``top``: true for the first k rows. Only k keys are found by a sort, so no window spans the table.

    ``order`` should end with a unique column. The k keys are broadcast up to MOST_BROADCAST of them.
    """
    first = df.orderBy(*order).limit(k).select(key).withColumn("top", F.lit(True))
    return df.join(F.broadcast(first) if k <= MOST_BROADCAST else first, key, "left").withColumn("top", F.coalesce("top", F.lit(False)))


def round_robin(df: DataFrame, area: str, within: list[str], area_order: str) -> DataFrame:
    """df with ``slot``: the first of each area, then the second of each, and so on."""
    turn = F.row_number().over(Window.partitionBy(area).orderBy(*within))
    return df.withColumn("turn", turn).withColumn("slot", F.struct("turn", area_order))


def fan_out(areas: DataFrame, suffixes: list[str]) -> DataFrame:
    """areas(area, area_ord, term, term_ord) x suffixes -> query, area, in round-robin order by (turn, area_ord)."""
    each = areas.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("suffix_ord"), F.lit(s).alias("suffix")) for i, s in enumerate(suffixes)])))
    each = each.select("area", "area_ord", "term_ord", F.col("s.suffix_ord").alias("suffix_ord"), F.trim(F.concat_ws(" ", "term", F.col("s.suffix"))).alias("query"))
    return round_robin(each, "area", ["term_ord", "suffix_ord"], "area_ord").select("query", "area", "area_ord", "turn")


def tag(provenance: Column, pairs: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(areas, queries) of a card, in fan-out order, from (query, area) pairs and its joined provenance."""
    heads = F.transform(F.split(provenance, r" \+ "), lambda x: F.split_part(x, F.lit(" — "), F.lit(1)))
    known = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(a).alias("a")) for q, a in pairs])
    hit = F.filter(known, lambda p: F.array_contains(heads, p["q"]))
    return F.array_distinct(F.transform(hit, lambda p: p["a"])), F.array_distinct(F.transform(hit, lambda p: p["q"]))
