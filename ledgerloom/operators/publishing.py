"""From judged cards to the registry: declared fields, new roles and companies, staged and published tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import split_scores
from ..functions.normalize import collapse, contains_quote, normalize_url, text
from .dedup import latest
from .registry import LABELS, NEW_ROW, Refused

#: How a work mode is written in a cell.
WORK_MODE_CELLS = {"onsite": "On-site (dichiarato)", "hybrid": "Hybrid (dichiarato)", "fully_remote": "Fully remote (dichiarato)", "to_verify": "To verify"}
ALL_LABELS = (*LABELS, "fuori profilo", "escluso")


def label(decision: Column, described: Column, score: Column) -> Column:
    """The label of a decision. An exclusion needs no description; a score outside 0..100 is an error."""
    out_of_range = described & (decision != "exclude") & score.isNotNull() & ~score.between(0, 100)
    value = F.when(decision == "exclude", "fuori profilo").when(~described, "non_risolto").when(decision == "shortlist", "pertinente").otherwise("adiacente")
    return F.when(out_of_range, F.raise_error(F.lit("score out of range"))).otherwise(value)


def score_without_description(described: Column, score: Column) -> Column:
    return ~described & score.isNotNull()


def judged(verdicts: DataFrame, cards: DataFrame, postings: DataFrame) -> DataFrame:
    """verdicts with their card and posting, and ``problems`` (array) of each; verdicts(id, label, quotes, ground, ...)."""
    c = cards.select(F.col("sourceJobId").alias("id"), F.struct("title", "company", "location", "url", "source").alias("card"))
    p = postings.select(F.col("sourceJobId").alias("id"), F.struct("desc", "closedOnPage").alias("posting"))
    n = verdicts.groupBy("id").agg(F.count(F.lit(1)).alias("n_verdicts"))
    out = verdicts.join(n, "id").join(c, "id", "left").join(p, "id", "left")
    named = lambda bad, what: F.when(bad, F.concat(F.lit(f"{what}: "), text(F.col("id"))))
    included = F.col("label").isin(*LABELS)
    missing = F.exists(F.coalesce("quotes", F.array().cast("array<string>")), lambda q: ~contains_quote(F.col("posting.desc"), q))
    checks = [
        named(F.col("n_verdicts") > 1, "verdict given twice"),
        named(F.col("card").isNull(), "no such card"),
        named(~F.coalesce(F.col("label").isin(*ALL_LABELS), F.lit(False)), "unknown label"),
        named(included & (F.trim(text(F.col("posting.desc"))) == ""), "description not read"),
        named(included & missing, "quote not in the text"),
        named((F.col("label") == "escluso") & (text(F.col("ground")) == ""), "no ground given"),
    ]
    return out.withColumn("problems", F.array_compact(F.array(*checks))).drop("n_verdicts")


def unresolved(cards: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cards that no verdict speaks of."""
    return cards.join(verdicts.select(F.col("id").alias("sourceJobId")).distinct(), "sourceJobId", "left_anti").withColumn("reason", F.lit("no verdict"))


def declared(rows: DataFrame) -> DataFrame:
    """What the admissibility rules read, of included verdicts and of those that the rules are to exclude."""
    some = rows.filter(F.col("label").isin(*LABELS) | (F.col("ground") == "admit"))
    wanted = F.coalesce("requiredLanguages", F.array().cast("array<string>"))
    return some.select(
        "id",
        F.col("card.title").alias("title"),
        F.coalesce(F.nullif("company", F.lit("")), "card.company").alias("company"),
        F.col("card.url").alias("url"),
        F.coalesce("stageNature", F.lit(True)).alias("stageNature"),
        F.coalesce("applicationOpen", ~F.coalesce("posting.closedOnPage", F.lit(False))).alias("applicationOpen"),
        F.when(F.size(wanted) > 0, wanted).alias("requiredLanguages"),
        F.when(F.size(wanted) > 0, F.coalesce("languageRequirement", F.lit("all"))).alias("languageRequirement"),
        F.nullif("workMode", F.lit("")).alias("workMode"),
    )


def new_roles(rows: DataFrame, excluded_urls: DataFrame) -> DataFrame:
    """Roles of included verdicts whose url the rules didn't exclude. A verdict's own url leads, the portal's becomes an alternate."""
    out = excluded_urls.select(normalize_url(F.col("url")).alias("url_norm")).distinct()
    own = F.nullif("url", F.lit(""))
    cell = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WORK_MODE_CELLS.items() for x in kv]), F.col("workMode")), F.lit("Not stated"))
    roles = rows.filter(F.col("label").isin(*LABELS)).select(
        "id",
        "label",
        "score",
        F.regexp_replace(collapse(F.col("card.title")), r"\s*\|\s*", " / ").alias("title"),
        F.coalesce(F.nullif("company", F.lit("")), "card.company").alias("company"),
        F.coalesce(F.nullif("location", F.lit("")), "card.location").alias("location"),
        F.coalesce(own, "card.url").alias("url"),
        F.when(own.isNotNull(), F.array("card.url")).otherwise(F.array().cast("array<string>")).alias("alternates"),
        cell.alias("mode"),
        normalize_url(F.col("card.url")).alias("url_norm"),
    )
    return roles.join(out, "url_norm", "left_anti").drop("url_norm")


def new_company_values(df: DataFrame, defaults: dict[str, str] = NEW_ROW) -> DataFrame:
    """Columns that people own start at their defaults; all others stay."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items()})


def exported(review: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """The registry's columns and the id; what the review doesn't hold comes out empty."""
    return review.select(*[(text(F.col(f"`{c}`")) if c in review.columns else F.lit("")).alias(c) for c in [*columns, id_column]])


def merged_notes(machine: Column, human: Column, day: Column) -> Column:
    """struct(scores, note): a person's note is appended, under a mark, and never lost."""
    parts = split_scores(machine)
    own = F.trim(text(human))
    note = F.when(own == "", parts["notes"]).when(parts["notes"] == "", own).otherwise(F.concat(parts["notes"], F.lit("\n— nota della persona ("), day, F.lit("): "), own))
    return F.struct(parts["scores"].alias("scores"), note.alias("note"))


def upsert(held: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows by key, the fresh ones winning."""
    both = held.withColumn("_turn", F.lit(0)).unionByName(fresh.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, "_turn").drop("_turn")


def latest_run(runs: DataFrame, before: str | None = None, good_only: bool = True) -> DataFrame:
    """The last run (name, ok) by name, before a name if one is given."""
    some = runs.filter("ok") if good_only else runs
    some = some.filter(F.col("name") < before) if before else some
    return some.orderBy(F.col("name").desc()).limit(1)


def first_reason(events: DataFrame, key: str, order: str, reason: str) -> DataFrame:
    """The first reason given for each key: later ones don't replace it."""
    return events.filter(F.col(reason).isNotNull()).groupBy(key).agg(F.min_by(reason, order).alias(reason))


def publish(df: DataFrame, path: str, expected_version: int | None = None, keep: int | None = None, aside: bool = False) -> int:
    """Write a new version beside the old ones and move the pointer, unless another writer moved it since ``expected_version``.

    A version is complete before it can be seen; a refusal leaves what is published
    untouched. With ``aside`` the rows of a refused writer are kept beside it (refused()),
    and the refusal says where. Of old versions the newest ``keep`` in all stay (all by
    default): a reader that has begun to read one has that long. Returns the new version.
    """
    spark = df.sparkSession
    now = current_version(spark, path)

    def refuse(why: str, staged: str | None = None) -> None:
        to = f"{path}/refused-{uuid.uuid4().hex}"
        if aside and staged is None:
            df.write.parquet(to)
        elif aside and not fs.rename(p(staged), p(to)):
            raise OSError(f"{staged} could not be kept as {to}")
        elif staged is not None and not aside:
            fs.delete(p(staged), True)
        raise Refused([f"{why}; its rows are in {to}" if aside else why])

    fs, p = _fs(spark, path)
    if expected_version is not None and now != expected_version:
        refuse(f"{path} is at version {now}, not {expected_version}")
    staged = f"{path}/.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    to = p(f"{path}/v{now + 1}")
    if fs.exists(to) or not fs.rename(p(staged), to):
        refuse(f"{path}: version {now + 1} was published meanwhile", staged)
    if keep is not None:
        for old in versions(spark, path):
            if old <= now + 1 - max(keep, 1):
                fs.delete(p(f"{path}/v{old}"), True)
    return now + 1


def refused(spark: SparkSession, path: str) -> list[str]:
    """Where the rows of refused writers are, in the order of their names."""
    fs, p = _fs(spark, path)
    if not fs.exists(p(path)):
        return []
    return sorted(f"{path}/{s.getPath().getName()}" for s in fs.listStatus(p(path)) if s.getPath().getName().startswith("refused-"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are there, ascending."""
    fs, p = _fs(spark, path)
    if not fs.exists(p(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p(path))]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def current_version(spark: SparkSession, path: str) -> int:
    """The published version, 0 for none."""
    return max(versions(spark, path), default=0)


def published(spark: SparkSession, path: str) -> DataFrame:
    version = current_version(spark, path)
    if not version:
        raise Refused([f"nothing is published in {path}"])
    return spark.read.parquet(f"{path}/v{version}")


def gate_counts(built: int, staged: int, evidence: int) -> None:
    """Refuse to publish unless every built role was staged and has evidence."""
    problems = [f"{staged} roles staged of {built}"] * (staged != built) + [f"evidence for {evidence} roles of {built}"] * (evidence != built)
    if problems:
        raise Refused(problems)
