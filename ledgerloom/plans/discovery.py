"""The discovery pipeline: cards through the ordered gates, each row leaving by one named outcome.

The order of the gates is part of the meaning: place, attribution, admissibility,
merging, history, score. Every gate only adds to the column ``outcome``, so no row is
lost between stages, and the counts of all outcomes add up to the cards seen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.normalize import key_of, latin, norm_city, norm_company, norm_title, normalize_url
from ..operators import dedup, gates, matching, ranking


@dataclass
class Config:
    """What a run looks for. ``areas`` maps an area to its search terms, in order."""

    areas: dict[str, list[str]]
    internship_terms: list[str] = field(default_factory=lambda: ["intern"])
    false_friends: list[str] = field(default_factory=list)
    top_k: int = 100
    admitted_languages: list[str] | None = None
    fold: object = latin

    def pairs(self) -> list[tuple[str, str]]:
        """(query, area) of the fan-out: the first of each area, then the second of each, and so on."""
        each = [[(f"{t} {s}".strip(), a) for t in terms for s in self.internship_terms] for a, terms in self.areas.items()]
        return [q[i] for i in range(max(map(len, each), default=0)) for q in each if i < len(q)]


def run(cards: DataFrame, config: Config, aggregators: DataFrame, history: tuple[DataFrame, DataFrame]) -> DataFrame:
    """cards with outcome (non-eu, unresolved, excluded, merged, duplicate, kept or dropped), ground and score.

    cards: the columns of a card with a unique ``ord``. history: (norm_company,
    url_norm) and (norm_company, role_key). One row out for each row in.
    """
    fold = config.fold
    df = gates.with_outcome(cards, gates.geo_verdict(F.col("location")) == "non-eu", "non-eu")
    df = gates.attribute(df, aggregators, fold=fold)
    df = gates.with_outcome(df, F.col("aggregator").isNotNull(), "unresolved")
    # a card states no languages, so that ground has nothing to read here
    ground = gates.admissibility(F.col("title"), F.col("snippet"), F.lit(None).cast("boolean"), F.col("workMode"), F.lit(None).cast("boolean"), F.lit(True))
    df = df.withColumn("ground", F.when(F.col("outcome").isNull(), ground))
    df = gates.with_outcome(df, F.col("ground").isNotNull(), "excluded")
    df = df.withColumn("key", dedup.card_key(F.col("source"), F.col("sourceJobId"), F.col("url")))
    open_ = df.filter("outcome is null").drop("outcome", "ground", "aggregator")
    merged = dedup.merge_cards(open_)
    # each column is folded once
    keyed = merged.withColumns({"norm_company": norm_company(F.col("company"), fold), "url_norm": normalize_url(F.col("url")), "_title": norm_title(F.col("title"), fold), "_city": norm_city(F.col("location"), fold)})
    keyed = keyed.withColumn("role_key", key_of(F.col("norm_company"), F.col("_title"), F.col("_city"))).drop("_title", "_city")
    fresh = matching.history_verdict(keyed, *history)
    scored = ranking.with_score(fresh, F.col("title"), F.col("snippet"), config.false_friends, [t for ts in config.areas.values() for t in ts])
    scored = scored.withColumn("score", F.when(F.col("reason").isNull(), F.col("score")))
    first = scored.filter("reason is null").orderBy(F.col("score").desc(), "ord").limit(config.top_k).select("ord").withColumn("top", F.lit(True))
    # at most top_k rows
    ended = scored.join(F.broadcast(first), "ord", "left")
    areas, _ = ranking.tag(F.col("discoveryQuery"), config.pairs())
    ended = ended.select("ord", F.when(F.col("reason").isNotNull(), "duplicate").when(F.col("top"), "kept").otherwise("dropped").alias("ended"), "score", "n_merged", areas.alias("areas"))
    out = df.drop("key").join(ended, "ord", "left")
    return out.withColumn("outcome", F.coalesce("outcome", "ended", F.lit("merged"))).drop("ended")


#: By what a card may leave.
OUTCOMES = ("non-eu", "unresolved", "excluded", "merged", "duplicate", "kept", "dropped")


def write_run(outcomes: DataFrame, path: str) -> dict[str, int]:
    """Write all rows in a folder per outcome below ``path``; the report is counted in the same pass, and written beside them.

    The report has the cards seen, those of each outcome, of each ground of exclusion, and
    those of none of these, which is 0: outcomes add up to the cards seen.
    """
    n, is_ = F.count(F.lit(1)), lambda c, v: F.count_if(F.col(c) == v)
    seen = Observation("run")
    metrics = [n.alias("seen"), *[is_("outcome", o).alias(o) for o in OUTCOMES], *[is_("ground", g).alias(f"excluded: {g}") for g in gates.GROUNDS]]
    metrics.append(F.count_if(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))).alias("other"))
    outcomes.observe(seen, *metrics).write.partitionBy("outcome").parquet(f"{path}/rows")
    report = {k: int(v) for k, v in seen.get.items()}
    outcomes.sparkSession.createDataFrame(list(report.items()), "name string, n long").coalesce(1).write.json(f"{path}/report")
    return report


def counters(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
