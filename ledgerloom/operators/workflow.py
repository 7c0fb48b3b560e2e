"""Whole steps of the registry's workflow: staging, health report, first review, reading report, pooled calls."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import norm_company, normalize_url, parse_date, text
from ..storage import ship
from . import publishing, registry

#: Columns that people own, and those that hold dates.
OWNED = ("Contact Search Status", "Contact Name", "Contact Role", "Contact Email / LinkedIn", "Outreach Decision", "Previously Contacted?", "First Contact Date", "Recall")
DATES = ("Last Checked", "First Contact Date", "Recall")
NAME = "Company / Outreach Account"


def row_problems(companies: DataFrame) -> DataFrame:
    """company, problem: every closed cell and date of the registry that is not as it should be."""
    have = [c for c in DATES if c in companies.columns]
    found = registry.problems(F.col("`Contact Search Status`"), F.col("`Outreach Decision`"), F.col("`Verification Status`"), {c: F.col(f"`{c}`") for c in have})
    return companies.select(F.col(f"`{NAME}`").alias("company"), F.explode(found).alias("problem"))


def stage(companies: DataFrame, evidence: DataFrame, checks: DataFrame, owned: DataFrame, to: str | None = None, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """(companies, roles) as they are to be published: validated, exploded, enriched, seeded; written below ``to`` if that is given.

    evidence(url_norm, ...) and checks(url_norm, status) join the roles by url; owned
    are earlier companies, whose people's cells fill empty ones. Problems refuse the
    whole step unless ``lenient``. Without ``to`` it is a dry run.
    """
    if not lenient:
        registry.refuse_on(row_problems(companies))
    keyed = companies.withColumn("company_key", norm_company(F.col(f"`{NAME}`")))
    roles = registry.explode_roles(keyed, "company_key").withColumn("url_norm", normalize_url(F.col("`role_Job Links`")))
    roles = registry.enrich(roles, evidence, checks)
    columns = [c for c in OWNED if c in companies.columns and c in owned.columns]
    earlier = owned.select(norm_company(F.col(f"`{NAME}`")).alias("company_key"), *[F.col(f"`{c}`") for c in columns])
    staged = registry.seed(keyed, earlier, "company_key", columns)
    if to is not None:
        publishing.publish(staged, f"{to}/companies")
        publishing.publish(roles, f"{to}/roles")
    return staged, roles


def doctor(companies: DataFrame) -> DataFrame:
    """check, n: how many rows have each kind of trouble; zero counts included."""
    kinds = [*("status", "decision", "verification"), *[c for c in DATES if c in companies.columns]]
    found = row_problems(companies).groupBy(F.split_part("problem", F.lit(":"), F.lit(1)).alias("check")).agg(F.count(F.lit(1)).alias("found"))
    name = norm_company(F.col(f"`{NAME}`"))
    twice = companies.groupBy(name.alias("k")).agg(F.count(F.lit(1)).alias("m")).agg(F.coalesce(F.sum(F.when((F.col("m") > 1) & (F.col("k") != ""), F.col("m"))), F.lit(0)).alias("found")).select(F.lit("name on several rows").alias("check"), "found")
    nameless = companies.agg(F.count_if(F.trim(text(F.col(f"`{NAME}`"))) == "").alias("found")).select(F.lit("no name").alias("check"), "found")
    every = companies.sparkSession.createDataFrame([(k,) for k in [*kinds, "name on several rows", "no name"]], "check string")
    counts = found.unionByName(twice).unionByName(nameless)
    return every.join(counts, "check", "left").select("check", F.coalesce("found", F.lit(0)).alias("n"))


def init_review(registry_rows: DataFrame, columns: list[str], path: str, force: bool = False) -> int:
    """Publish a first review of the given columns (empty where the registry has none). One that is there is kept, unless forced."""
    there = publishing.current_version(registry_rows.sparkSession, path)
    if there and not force:
        raise registry.Refused([f"{path} holds a review already (version {there})"])
    cells = [(text(F.col(f"`{c}`")) if c in registry_rows.columns else F.lit("")).alias(c) for c in columns]
    return publishing.publish(registry_rows.select(*cells), path, there)


def token(spark: SparkSession, path: str) -> str:
    """A word for exactly the rows that are published in ``path``, in any order."""
    rows = publishing.published(spark, path)
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(20,0)")), F.lit(0))).first()
    return hashlib.sha256(f"{path.rpartition('/')[2]} {publishing.current_version(spark, path)} {n} {total}".encode()).hexdigest()[:12]


def run_steps(spark: SparkSession, path: str, steps: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], confirmed: dict[str, str]) -> tuple[dict[str, DataFrame], str | None, str | None]:
    """(tables of the steps that are done, the step that waits for a person, the token to confirm it with).

    Steps run in order, each from the tables of those before, and are published below
    ``path``; one that is there already isn't run again. The next one runs only when the
    result of the last was confirmed with its token, so what a person has looked at is what
    goes on: a token of other rows is refused. The last step needs no confirmation.
    """
    done: dict[str, DataFrame] = {}
    for i, (name, step) in enumerate(steps.items(), 1):
        at = f"{path}/{name}"
        if not publishing.current_version(spark, at):
            publishing.publish(step(done), at, 0)
        done[name] = publishing.published(spark, at)
        if i < len(steps):
            now = token(spark, at)
            if name not in confirmed:
                return done, name, now
            if confirmed[name] != now:
                raise registry.Refused([f"{name}: what was confirmed is not what is there"])
    return done, None, None


def carried_and_new(previous: DataFrame, new: DataFrame, urls: str = "urls") -> DataFrame:
    """Previous roles none of whose urls is among the new ones', then the new ones; ``carried`` tells them apart."""
    taken = new.select(F.explode(urls).alias("url"))
    return registry.carry_forward(previous, taken).withColumn("carried", F.lit(True)).unionByName(new.withColumn("carried", F.lit(False)), allowMissingColumns=True)


def unconfirmed(themes: Column, areas: list[str]) -> Column:
    """The themes that are among the areas nobody has confirmed, in their order."""
    return F.array_intersect(themes, F.array(*map(F.lit, areas)).cast("array<string>"))


def distinct_queries(queries: DataFrame, query: str = "query", order: str = "ord") -> DataFrame:
    """Each query once, with its first place."""
    return queries.groupBy(query).agg(F.min(order).alias(order))


def undeclarable(sources: DataFrame, name: str = "source", says: str = "undeclarable") -> DataFrame:
    """source: the sources that cannot declare a work mode, each once. One that doesn't say (null) counts itself."""
    return sources.select(F.explode(F.coalesce(says, F.array(name))).alias("source")).distinct()


def read_report(postings: DataFrame, held: DataFrame, answers: DataFrame) -> DataFrame:
    """postings(sourceJobId, ...) with ``fate``: withoutId, alreadyRead, read, empty, gone or unread.

    held(sourceJobId) are those of earlier runs, answers(sourceJobId, desc, gone) what
    this run was given; a posting that it wasn't asked for, or that it couldn't reach, is unread.
    """
    before = held.select("sourceJobId").distinct().withColumn("_held", F.lit(True))
    now = answers.groupBy("sourceJobId").agg(F.max(F.coalesce("gone", F.lit(False))).alias("_gone"), F.max(F.trim(text(F.col("desc")))).alias("_desc"))
    fate = (
        F.when(F.trim(text(F.col("sourceJobId"))) == "", "withoutId")
        .when(F.col("_held"), "alreadyRead")
        .when(F.col("_gone"), "gone")
        .when(F.col("_desc").isNull(), "unread")
        .when(F.col("_desc") == "", "empty")
        .otherwise("read")
    )
    return postings.join(before, "sourceJobId", "left").join(now, "sourceJobId", "left").withColumn("fate", fate).drop("_held", "_gone", "_desc")


def pooled(df: DataFrame, call: Callable[[dict], str | None], width: int, out: str = "answer") -> DataFrame:
    """df with the answer of ``call`` to each row, from at most ``width`` calls at a time.

    A call that raises answers null, and ``<out>_error`` says what it raised. Rows keep
    their columns, by which they can be put in order again.
    """
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType())])

    def answer(row: dict) -> tuple[str | None, str | None]:
        try:
            return call(row), None
        except Exception as e:  # noqa: BLE001  one call's failure is its own
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [answer(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([x[i] for x in both], pa.string()) for i in (0, 1)]], schema.names)

    return df.repartition(width).mapInArrow(run, schema)


def typed_dates(companies: DataFrame) -> DataFrame:
    """company, column, value of every date cell that is text but no date."""
    have = [c for c in DATES if c in companies.columns]
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.trim(text(F.col(f"`{c}`"))).alias("value")) for c in have])
    rows = companies.select(F.col(f"`{NAME}`").alias("company"), F.explode(each).alias("x")).select("company", "x.*")
    return rows.filter((F.col("value") != "") & parse_date(F.col("value")).isNull())
