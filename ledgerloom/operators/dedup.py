"""Merging of observations of one posting, and the report of near-duplicates.

The merge depends on order: it is a fold over each posting's queries and urls, in the
order of their first places. Rows that are alone under their key pass by the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import normalize_url, role_key, text


def card_key(source: Column, job_id: Column, url: Column) -> Column:
    """source:id, or url:... for a card without an id; an empty id counts as none."""
    return F.when(text(job_id) != "", F.concat_ws(":", source, job_id)).otherwise(F.concat(F.lit("url:"), normalize_url(url)))


def fold_queries(queries: Column) -> Column:
    """Joined by " + " in order; one that is a substring of what is there is left out."""
    step = lambda acc, q: F.when(F.contains(acc, q), acc).otherwise(F.concat(acc, F.lit(" + "), q))
    return F.aggregate(F.slice(queries, 2, 1_000_000_000), F.element_at(queries, 1), step)


def merge_cards(cards: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """One row per key: the first card, with the longest snippet, all queries and the other urls; n_merged counts the rest.

    cards: key, ord, url, snippet, discoveryQuery, alternateUrls and any other columns,
    which are the first card's. A query or url that comes again changes nothing, so each
    counts by its first place alone: these are found before anything meets at the key, which
    then has as many rows as it has different queries and urls, however often it was seen.
    """
    rest = [c for c in cards.columns if c not in (key, order)]
    row = F.struct(F.col(order), *[F.col(c) for c in rest])
    # the first of the longest snippets wins; min_by and max_by merge on the map side
    grouped = cards.groupBy(key).agg(
        F.min_by(row, order).alias("first"),
        F.max_by(text(F.col("snippet")), F.struct(F.length(text(F.col("snippet"))), -F.col(order))).alias("long"),
        F.count(F.lit(1)).alias("n"),
    )
    none = F.array().cast("array<string>")
    urls = F.transform(F.concat(F.coalesce("alternateUrls", none), F.array("url")), lambda u, i: F.struct(F.lit("u").alias("kind"), u.alias("value"), i.alias("i")))
    query = F.array(F.struct(F.lit("q").alias("kind"), text(F.col("discoveryQuery")).alias("value"), F.lit(0).alias("i")))
    items = cards.select(key, order, F.explode(F.concat(query, urls)).alias("x")).select(key, order, "x.*")
    if isinstance(cards.schema[order].dataType, T.IntegralType):  # one number for both is aggregated by hashing, a pair by sorting
        at = F.col(order).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("i")
    else:
        at = F.struct(F.col(order), "i")
    items = items.groupBy(key, "kind", "value").agg(F.min(at).alias("at"))
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "value")))).alias(kind)
    items = items.groupBy(F.col(key).alias("_key")).agg(listed("q"), listed("u"))
    both = grouped.join(items, F.col(key).eqNullSafe(F.col("_key")))
    values = lambda kind: F.transform(kind, lambda x: x["value"])
    single = F.col("n") == 1
    out = {c: F.col(f"first.{c}") for c in rest}
    out["snippet"] = F.when(single, F.col("first.snippet")).otherwise(F.col("long"))
    out["discoveryQuery"] = F.when(single, F.col("first.discoveryQuery")).otherwise(fold_queries(values("q")))
    out["alternateUrls"] = F.when(single, F.col("first.alternateUrls")).otherwise(F.filter(values("u"), lambda u: normalize_url(u) != normalize_url(F.col("first.url"))))
    return both.select(F.col(key), F.col(f"first.{order}").alias(order), *[e.alias(c) for c, e in out.items()], (F.col("n") - 1).alias("n_merged"))


def near_duplicates(cards: DataFrame, company: str = "company", title: str = "title", location: str = "location", fold=None) -> DataFrame:
    """Groups of more than one card under one role key: key, n, ords (ascending). They are reported, never merged."""
    names = {"fold": fold} if fold else {}
    keyed = cards.withColumn("near_key", role_key(F.col(company), F.col(title), F.col(location), **names))
    return keyed.groupBy("near_key").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("ord")).alias("ords")).filter("n > 1")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: what a log of repeated saves holds now."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(row, order).alias("r")).select("r.*")
