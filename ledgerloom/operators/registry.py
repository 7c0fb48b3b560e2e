"""The registry of companies and roles: exploding, enriching, validating, regrouping, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import at_index, number_items, split_cell
from ..functions.normalize import parse_date, text

#: Closed vocabularies.
STATUSES = ("New job found", "Job not suitable", "Not started", "Potential contact", "Contact found", "Contacted", "Job found")
DECISIONS = ("Review", "Yes", "No")
VERIFICATION_PREFIXES = ("Employer verified active", "Portal verified", "Legacy result", "Blocked", "To verify")
LABELS = ("pertinente", "adiacente")
#: What the columns that people own start as in a new row.
NEW_ROW = {"Contact Search Status": "New job found", "Outreach Decision": "Review", "Previously Contacted?": "To verify"}


class Refused(ValueError):
    """Input that breaks the contract; carries the problems found and their number, which may be greater."""

    def __init__(self, problems: list[str], n: int | None = None):
        self.problems, self.n = problems, len(problems) if n is None else n
        super().__init__("; ".join(problems[:10]) + (f" ({self.n} problems)" if self.n > 10 else ""))


def explode_roles(companies: DataFrame, key: str, title: str = "Matching Job Titles", shared: tuple[str, ...] = ("Job Links", "Locations", "Matching Score")) -> DataFrame:
    """One row per title, with the value of the same index of each shared column, or its first."""
    # each cell is split once a company, not once a role
    cells = companies.select(key, split_cell(F.col(f"`{title}`"), title).alias("titles"), *[split_cell(F.col(f"`{c}`"), c).alias(f"cells{j}") for j, c in enumerate(shared)])
    roles = F.transform("titles", lambda t, i: F.struct(i.alias("i"), t.alias("role_title"), *[at_index(F.col(f"cells{j}"), i).alias(f"role_{c}") for j, c in enumerate(shared)]))
    return cells.select(key, F.explode(roles).alias("r")).select(key, "r.*")


def regroup(roles: DataFrame, key: str, label: str, score: str, order: str, numbered: list[str], distinct: list[str]) -> DataFrame:
    """Roles -> companies: best first (label, then falling score, then order), numbered and distinct cells, n_roles."""
    rank = F.array_position(F.array(*map(F.lit, LABELS)), F.col(label))
    best = F.struct(rank.alias("r"), (-F.coalesce(F.col(score).cast("double"), F.lit(0.0))).alias("s"), F.col(order).alias("o"), *[F.col(c).cast("string").alias(c) for c in dict.fromkeys([*numbered, *distinct])])
    grouped = roles.groupBy(key).agg(F.array_sort(F.collect_list(best)).alias("all"))

    def values(c: str) -> Column:
        return F.transform("all", lambda x: x[c])

    cells = [number_items(values(c)).alias(c) for c in numbered]
    cells += [F.array_join(F.array_distinct(values(c)), "; ").alias(c) for c in distinct if c not in numbered]
    return grouped.select(key, F.size("all").alias("n_roles"), F.element_at("all", 1)["r"].alias("best_rank"), (-F.element_at("all", 1)["s"]).alias("best_score"), *cells)


def enrich(roles: DataFrame, evidence: DataFrame, checks: DataFrame, key: str = "url_norm") -> DataFrame:
    """Left joins on the url: a non-empty evidence value fills an empty cell of the same name, checks add ``status``."""
    ev = evidence.select(key, *[F.col(c).alias(f"e_{c}") for c in evidence.columns if c != key])
    out = roles.join(ev, key, "left").join(checks.select(key, F.col("status").alias("check_status")), key, "left")
    fill = lambda c: F.coalesce(F.nullif(F.trim(text(F.col(c))), F.lit("")), F.col(f"e_{c}")) if c in roles.columns else F.col(f"e_{c}")
    names = [c for c in evidence.columns if c != key]
    return out.select(*[c for c in roles.columns if c not in names], *[fill(c).alias(c) for c in names], "check_status")


def seed(companies: DataFrame, owned: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fill empty cells from the one row of ``owned`` with the same key; a key on several rows seeds nothing."""
    row = F.struct(*[F.col(c) for c in columns])
    one = owned.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first(row).alias("r")).filter("n = 1")
    out = companies.join(one.select(key, "r"), key, "left")
    return out.select(*[c for c in companies.columns if c not in columns], *[F.coalesce(F.nullif(text(F.col(c)), F.lit("")), F.col(f"r.{c}"), F.lit("")).alias(c) for c in columns])


def problems(status: Column, decision: Column, verification: Column, dates: dict[str, Column]) -> Column:
    """What is wrong with a row's closed cells, as texts; an empty cell never is."""
    bad = lambda c, ok, name: F.when((text(c) != "") & ~ok, F.concat(F.lit(f"{name}: "), text(c)))
    verified = F.exists(F.array(*map(F.lit, VERIFICATION_PREFIXES)), lambda p: F.startswith(text(verification), p))
    checks = [bad(status, text(status).isin(*STATUSES), "status"), bad(decision, text(decision).isin(*DECISIONS), "decision"), bad(verification, verified, "verification")]
    checks += [bad(c, parse_date(c).isNotNull(), name) for name, c in dates.items()]
    return F.array_compact(F.array(*checks))


def refuse_on(df: DataFrame, column: str = "problem", most: int = 1000) -> None:
    """Raise if there is a problem, with the number of all and the first ``most`` in order of their texts."""
    n = df.count()
    if n:
        raise Refused([r[0] for r in df.select(column).orderBy(column).limit(most).collect()], n)


def evidence_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, filled, total: one aggregate row, then unpivoted."""
    sums = [F.coalesce(F.sum((F.trim(text(F.col(c))) != "").cast("long")), F.lit(0)).alias(f"c{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count(F.lit(1)).alias("total"), *sums)
    return row.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(columns)])).alias("x")).select("x.column", "x.filled", "total")


def coverage(planned: DataFrame, done: DataFrame, key: str, area: str) -> DataFrame:
    """area, planned, searched, not_searched of each area."""
    seen = done.select(key).distinct().withColumn("hit", F.lit(1))
    out = planned.join(seen, key, "left").groupBy(area).agg(F.count(F.lit(1)).alias("planned"), F.count("hit").alias("searched"))
    return out.withColumn("not_searched", F.col("planned") - F.col("searched"))


def conflicts(current: Column, incoming: Column, date: bool = False) -> Column:
    """Would writing ``incoming`` destroy a different value?"""
    from ..functions.normalize import same_value

    return (F.trim(text(current)) != "") & ~same_value(current, incoming, date)


def first_seen(is_new: Column, run_date: Column, sidecar: Column, last_checked: Column) -> Column:
    """The run's date for a new or re-found role; else what the sidecar says, else the last check."""
    return F.when(is_new, run_date).otherwise(F.coalesce(F.nullif(text(sidecar), F.lit("")), last_checked))


def carry_forward(previous: DataFrame, new_urls: DataFrame, role: str = "role_id") -> DataFrame:
    """Previous roles none of whose urls (array ``urls``) is among new_urls(url)."""
    taken = previous.select(role, F.explode("urls").alias("url")).join(new_urls.select("url").distinct(), "url", "left_semi").select(role).distinct()
    return previous.join(taken, role, "left_anti")


def append_only(incoming: DataFrame, ladder: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, rows deferred to a person) of incoming(in_id, ...), by the ladder's verdicts."""
    judged = incoming.join(ladder.select("in_id", "kind"), "in_id")
    return judged.filter("kind = 'unmatched'").drop("kind"), judged.filter("kind in ('ambiguous', 'needs_human')")


def migrate(old: DataFrame, columns: list[str], renamed: dict[str, str], translate: dict[str, dict[str, str]]) -> tuple[DataFrame, dict[str, list[str]]]:
    """(old in the new layout, carried/added/dropped names): columns by name, old values translated, new ones empty."""
    from ..functions.normalize import lookup

    back = {v: k for k, v in renamed.items()}
    source = lambda c: c if c in old.columns else back.get(c)
    cell = lambda c: F.lit("") if source(c) not in old.columns else lookup(F.col(f"`{source(c)}`"), translate[c]) if c in translate else F.col(f"`{source(c)}`")
    names = {"carried": [c for c in columns if source(c) in old.columns], "added": [c for c in columns if source(c) not in old.columns]}
    names["dropped"] = [c for c in old.columns if c not in {source(c) for c in columns}]
    return old.select(*[cell(c).alias(c) for c in columns]), names


def census(values: DataFrame, column: str, known: tuple[str, ...], translated: dict[str, str]) -> DataFrame:
    """value, class (known, translated, unknown) and n of a column before a migration."""
    c = F.col(column)
    kind = F.when(c.isin(*known), "known").when(c.isin(*translated), "translated").otherwise("unknown") if translated else F.when(c.isin(*known), "known").otherwise("unknown")
    return values.groupBy(c.alias("value"), kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def blanked(df: DataFrame, columns: list[str]) -> DataFrame:
    """A copy with the named columns empty; a name that is missing is refused, as its data would slip through."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise Refused([f"no column {c!r}" for c in missing])
    return df.select(*[F.lit(None).cast(t).alias(c) if c in columns else F.col(f"`{c}`") for c, t in df.dtypes])


def windowed_islands(df: DataFrame, key: str, order: str, ok: Column, error: Column) -> DataFrame:
    """df with ``streak``: errors in a row up to here, reset by a success only."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("island", F.sum(ok.cast("long")).over(w))
    inner = Window.partitionBy(key, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("streak", F.sum(error.cast("long")).over(inner))


def send_times(df: DataFrame, key: str, order: list[str], arrival: str, gap: int) -> DataFrame:
    """df with ``send_at``: each request waits for its turn, ``gap`` after the one before, in closed form."""
    w = Window.partitionBy(key).orderBy(*order)
    i = (F.row_number().over(w) - 1).cast("long")
    free = F.max(F.col(arrival) - F.col("i") * F.lit(gap)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("i", i).withColumn("send_at", free + F.col("i") * F.lit(gap)).drop("i")
