"""URL filters: listed rules first, then association rules mined from what these label.

Listed rules name a host (with its subdomains) and a path prefix; the longest that fits
decides. The urls that they decide are labelled transactions of tokens: host labels,
top-level domain, path segments, file ending, query keys. FP-growth mines frequent
token combinations together with the label; rules whose confidence or support is too
low, or which a shorter rule makes needless, are pruned. Any other url is matched by an
inverted index of the rules that are left: each is filed under its rarest token.

The combinations of one long url are many, so what can't be in a rule that stands is left
out before mining: of tokens that stand in the very same transactions all but one (a rule
with one of them is as sure as with all), and tokens of one verdict only, which are rules
by themselves. Where a transaction still has over LONG frequent tokens, the same rules are
found size by size instead: only sets that no part of stands in the same transactions, and
that both verdicts have, are made larger.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import pick, ship, stored

SUPPORT = 0.01
CONFIDENCE = 0.9
#: The verdict where no rule of either sort fits.
DEFAULT = "allow"
#: Frequent tokens of one transaction beyond which sets are grown by size: FP-growth goes through 2**LONG of them.
LONG = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABEL = "="


@dataclass(frozen=True)
class Listed:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for null or without ://."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    pick_ = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(pick_(1), _UPPER, _LOWER), pick_(2)


def listed_rule(host: Column, path: Column, rules: list[Listed]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest is tried first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a url; runs of digits are one token."""
    labels = F.split(host, r"\.")
    top = F.concat(F.lit("t:"), F.element_at(labels, -1))
    named = F.transform(labels, lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(F.lower(path), "[/_.-]+"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    both = F.array_distinct(F.concat(F.array(top), named, segments, keys))
    return F.filter(both, lambda x: F.length(x) > 2)


Rule = tuple[tuple[str, ...], str, float, float]


def frequent(labelled: DataFrame, least: int) -> dict[str, tuple[int, int]]:
    """(transactions, of which blocked) of each frequent token of labelled(tokens, verdict), the most frequent first.

    Of tokens that stand in the very same transactions only the first by name is there.
    There are at most as many as the mean number of tokens divided by support.
    """
    named = labelled.withColumn("id", F.monotonically_increasing_id())
    block = F.count_if(F.col("verdict") == "block").alias("n_block")
    in_same = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    each = named.select("id", "verdict", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), block, *in_same)
    some = each.filter(F.col("n") >= least).groupBy("n", "n_block", "x1", "x2").agg(F.min("token").alias("token"))
    return {r.token: (r.n, r.n_block) for r in sorted(some.collect(), key=lambda r: (-r.n, r.token))}


def _count(baskets: DataFrame, sets: list[frozenset[str]], uses: dict[str, tuple[int, int]]) -> dict[frozenset[str], tuple[int, int]]:
    """(transactions, of which blocked) that hold each of the sets."""
    filed: dict[str, list[int]] = {}
    for i, x in enumerate(sets):
        filed.setdefault(min(x, key=lambda t: (uses[t][0], t)), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, list[int]] = {}
        for batch in batches:
            for items in batch.column(0).to_pylist():
                have = frozenset(items)
                for i in (i for t in have for i in filed.get(t, ()) if sets[i] <= have):
                    c = n.setdefault(i, [0, 0])
                    c[0] += 1
                    c[1] += _LABEL + "block" in have
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), *[pa.array([c[j] for c in n.values()], pa.int64()) for j in (0, 1)]], ["i", "n", "b"])

    rows = baskets.mapInArrow(run, "i long, n long, b long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect()
    return {sets[r.i]: (r.n, r.b) for r in rows}


def _grown(baskets: DataFrame, uses: dict[str, tuple[int, int]], least: int, total: int, confidence: float) -> list[Rule]:
    """The rules that stand, by sets of one token, of two, and so on: a set goes on if it is rarer than each of its parts and both verdicts have it."""
    rules, level = [], {frozenset([t]): c for t, c in uses.items()}
    while level:
        rules += [r for x, c in level.items() for r in _rules(tuple(sorted(x)), *c, least, total, confidence)]
        alive = {x: c for x, c in level.items() if 0 < c[1] < c[0]}
        larger, starts = [], {}
        for x in alive:
            starts.setdefault(tuple(sorted(x))[:-1], []).append(max(x))
        for start, ends in starts.items():
            for i, a in enumerate(sorted(ends)):
                for b in sorted(ends)[i + 1 :]:
                    y = frozenset((*start, a, b))
                    if all(y - {t} in alive for t in y):
                        larger.append(y)
        found = _count(baskets, larger, uses) if larger else {}
        level = {y: c for y, c in found.items() if c[0] >= least and all(c[0] < alive[y - {t}][0] for t in y)}
    return rules


def _rules(tokens_: tuple[str, ...], n: int, blocked: int, least: int, total: int, confidence: float) -> list[Rule]:
    """The rules that one set of tokens gives."""
    return [(tokens_, v, m / n, m / total) for v, m in (("block", blocked), ("allow", n - blocked)) if m >= least and m / n >= confidence]


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[Rule]:
    """(tokens, verdict, confidence, support) of the rules that stand, from labelled(tokens, verdict).

    Support and confidence bound the rules that come to the driver.
    """
    if labelled.isEmpty():
        return []
    ship(labelled.sparkSession)
    total = labelled.count()
    least = math.ceil(support * total)
    uses = frequent(labelled, least)
    mixed = {t: c for t, c in uses.items() if 0 < c[1] < c[0]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            items = [[*sorted(mixed.keys() & have), _LABEL + verdict] for have, verdict in rows]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], ["items"])

    baskets = labelled.select("tokens", "verdict").mapInArrow(run, "items array<string>")
    rows = [r for t, c in uses.items() if t not in mixed for r in _rules((t,), *c, least, total, confidence)]
    if mixed and baskets.agg(F.max(F.size("items"))).first()[0] > LONG + 1:
        rows += _grown(baskets, mixed, least, total, confidence)
    elif mixed:
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence, numPartitions=max(2, baskets.sparkSession.sparkContext.defaultParallelism)).fit(baskets)
        found = model.associationRules.filter(F.element_at("consequent", 1).startswith(_LABEL))
        found = found.filter(~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
        rows += [(tuple(sorted(r[0])), r[1][0][len(_LABEL) :], r[2], r[3]) for r in found.select("antecedent", "consequent", "confidence", "support").collect()]
    rows.sort(key=lambda r: (len(r[0]), -r[2], -r[3], r[0]))
    kept: list[Rule] = []
    filed: dict[tuple[str, str], list[tuple[frozenset[str], float]]] = {}
    for r in rows:  # a rule stands if no shorter one of the same verdict is as sure
        have = frozenset(r[0])
        if not any(k <= have and sure >= r[2] for t in r[0] for k, sure in filed.get((r[1], t), ())):
            kept.append(r)
            filed.setdefault((r[1], r[0][0]), []).append((have, r[2]))
    return kept


def inverted(rules: list[Rule]) -> dict[str, list[tuple[frozenset[str], str, tuple]]]:
    """Rules by the token that the fewest rules hold."""
    uses: dict[str, int] = {}
    for r in rules:
        for t in r[0]:
            uses[t] = uses.get(t, 0) + 1
    index: dict[str, list[tuple[frozenset[str], str, tuple]]] = {}
    for tokens_, verdict, confidence, support in rules:
        key = min(tokens_, key=lambda t: (uses[t], t))
        # surest first, then best supported, then more tokens, then by name
        index.setdefault(key, []).append((frozenset(tokens_), verdict, (-confidence, -support, -len(tokens_), tokens_)))
    return index


def judge(pages: DataFrame, rules: list[Listed], support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (the mined rule used, if any) of every row of pages(page_id, url).

    A url that neither a listed nor a mined rule fits is allowed. Null urls and those without :// have an empty host and path. Repeated rows stay;
    other columns are ignored, whatever their names.
    """
    ship(pages.sparkSession)
    pages = pick(pages, "page_id", "url")
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    cut = cut.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))
    cut = stored(cut, "urls")
    index = inverted(mine(cut.filter("verdict is not null").select("tokens", "verdict"), support, confidence))
    schema = T.StructType([*cut.schema.fields[:5], T.StructField("mined", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, mined = batch.column(4).to_pylist(), []
            for i, have in enumerate(batch.column(5).to_pylist()):
                best = None
                if verdicts[i] is None:
                    have = frozenset(have or ())
                    fits = [r for t in have for r in index.get(t, ()) if r[0] <= have]
                    best = min(fits, key=lambda r: r[2]) if fits else None
                    verdicts[i] = best[1] if best else DEFAULT
                mined.append(" & ".join(sorted(best[0])) if best else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(mined, pa.string())], schema.names)

    return cut.mapInArrow(run, schema)
