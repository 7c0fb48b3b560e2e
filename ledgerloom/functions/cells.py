"""Cells that hold several values: splitting, numbering, joining, scores in notes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import collapse, text


@dataclass(frozen=True)
class Policy:
    """How a column's cells are split; pipes and new lines always separate."""

    semicolon: bool = False
    numbered: bool = False
    alternates: bool = False


#: The policy of each column that may hold several values.
POLICIES = {
    "Matching Job Titles": Policy(numbered=True),
    "Matching Score": Policy(numbered=True),
    "Job Links": Policy(numbered=True, alternates=True),
    "Locations": Policy(numbered=True),
    "Master-fit Themes": Policy(semicolon=True),
    "Work Modes": Policy(),
    "Sources / Portals": Policy(semicolon=True),
}
_MARK = "\u0001"


def split_cell(c: Column, column: str) -> Column:
    """The values of a cell of ``column``; a column without a policy is refused when the plan is built.

    A numbering counts only if the cell starts with "1." and the numbers at item
    boundaries run from 1 without a gap.
    """
    if column not in POLICIES:
        raise ValueError(f"no splitting policy for column {column!r}")
    p = POLICIES[column]
    raw = F.regexp_replace(text(c), "\r\n?", "\n")
    parts = F.split(raw, "\n")
    if p.numbered:
        edge = r"(?:^|\n|\|)\s*(\d+)\.\s+"
        numbers = F.regexp_extract_all(raw, F.lit(edge), F.lit(1))
        run = F.transform(F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1))), lambda i: i.cast("string"))
        items = F.slice(F.split(F.regexp_replace(raw, edge, _MARK), _MARK), 2, 1_000_000)
        parts = F.when(raw.rlike(r"^\s*1\.\s") & (numbers == run), items).otherwise(parts)
    if p.alternates:
        parts = F.flatten(F.transform(parts, lambda x: F.split(x, r"(?i)(?:^|\s)alt\.\s+")))
    parts = F.flatten(F.transform(parts, lambda x: F.split(x, r"\s*\|\s*|\s*;\s*" if p.semicolon else r"\s*\|\s*")))
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\d+\.\s*", ""), r"^\s+", ""), r"\s+$", ""))), lambda x: x != "")


def number_items(items: Column, sep: str = "\n") -> Column:
    """"1. a", "2. b", ...; a single value stays as it is."""
    many = F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), sep)
    return F.when(F.size(items) == 1, F.element_at(items, 1)).otherwise(many)


def unnumber(c: Column) -> Column:
    return F.regexp_replace(text(c), r"^\d+\.\s*", "")


def split_alternates(c: Column) -> Column:
    """struct(primary, alternates) of one entry of links."""
    parts = F.filter(F.split(text(c), r"(?i)(?:^|\s)alt\.\s+"), lambda x: F.trim(x) != "")
    parts = F.transform(parts, lambda x: F.trim(x))
    return F.struct(F.get(parts, 0).alias("primary"), F.when(F.size(parts) > 1, F.slice(parts, 2, 1_000_000)).otherwise(F.array().cast("array<string>")).alias("alternates"))


def at_index(items: Column, i: Column) -> Column:
    """The i-th value (from 0), else the first: cells that share one index may hold one common value."""
    return F.coalesce(F.get(items, i), F.get(items, F.lit(0)))


SCORE = r"(?i)match score:\s*(\d{1,3})/100\.?\s*"


def scores_of(notes: Column) -> Column:
    return F.regexp_extract_all(text(notes), F.lit(SCORE), F.lit(1))


def without_scores(notes: Column) -> Column:
    return collapse(F.regexp_replace(text(notes), SCORE, ""))


def split_scores(notes: Column) -> Column:
    """struct(scores, notes): all scores as one cell, and the notes without them."""
    found = scores_of(notes)
    return F.struct(F.when(F.size(found) > 0, number_items(found, " | ")).otherwise("").alias("scores"), without_scores(notes).alias("notes"))


def split_notes(notes: Column, labels: tuple[str, ...] = ("Compatible", "Borderline", "Excluded")) -> Column:
    """Numbered notes, cut only where a number stands before a label."""
    return F.filter(F.split(text(notes), rf"(?:^|(?<=\s))\d+\. (?=(?:{'|'.join(labels)}))"), lambda x: F.trim(x) != "")


def sanitise(c: Column) -> Column:
    """A cell for ;-separated files: tabs, line ends and semicolons become one space."""
    return F.trim(F.regexp_replace(text(c), "[\t\r\n;]+", " "))
