"""Hand-written profile and cohort files: read on the driver, as they configure a plan rather than feed it."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from ..operators.registry import Refused
from ..plans.discovery import Config

#: Markers of the profile's fields.
PRESENCE, TERMS, NOT_FORESEEN, FALSE_FRIENDS = "**Presenza nel percorso:**", "**Termini di ricerca", "non prevista", "`termini:`"


@dataclass(frozen=True)
class Area:
    name: str
    presence: str
    terms: tuple[str, ...]


def areas(markdown: str) -> list[Area]:
    """Sections of the third level, each with its presence and the first line of search terms."""
    found: list[dict] = []
    here: dict | None = None
    for line in markdown.splitlines():
        if line.startswith("##"):
            here = None
            if line.startswith("### "):
                here = {"name": line[4:].strip(), "presence": None, "terms": None}
                found.append(here)
        elif here is not None and PRESENCE in line and here["presence"] is None:
            here["presence"] = line.split(PRESENCE, 1)[1].strip()
        elif here is not None and TERMS in line and here["terms"] is None:
            _, _, listed = line.split(TERMS, 1)[1].partition(":**")
            here["terms"] = tuple(t.strip() for t in listed.split(",") if t.strip())
    return [Area(a["name"], a["presence"] or "", a["terms"] or ()) for a in found]


def scalar(text: str, name: str) -> str | None:
    """The value of ``name:`` in a list, a bold line or YAML."""
    for line in text.splitlines():
        key, colon, value = line.partition(":")
        if colon and key.strip(" -*`\"_#>") == name:
            value = value.strip().strip("*`\" ")
            if value:
                return value
    return None


def listing(text: str, name: str) -> list[str]:
    """The ``- item`` lines below ``name:``."""
    out: list[str] = []
    inside = False
    for line in text.splitlines():
        if inside and line.strip().startswith("- "):
            out.append(line.strip()[2:].strip())
        else:
            inside = line.strip() == f"{name}:"
    return out


def false_friends(markdown: str) -> list[str]:
    return [t.strip() for line in markdown.splitlines() if FALSE_FRIENDS in line for t in line.split(FALSE_FRIENDS, 1)[1].split(";") if t.strip()]


def load(folder: str | Path, terms: list[str], top_k: int = 100) -> tuple[Config, dict]:
    """(config, identity) of a folder with one profile and one cohort file; refused if they don't belong together."""
    folder = Path(folder)
    profiles, cohorts = sorted(folder.glob("A2-*.md")), sorted(folder.glob("A3-*.yaml"))
    problems = [f"{len(x)} {what} files in {folder}, not one" for x, what in ((profiles, "profile"), (cohorts, "cohort")) if len(x) != 1]
    if problems:
        raise Refused(problems)
    a2, a3 = profiles[0].read_text(encoding="utf-8"), cohorts[0].read_text(encoding="utf-8")
    ids = scalar(a2, "master_id"), scalar(a3, "master_id")
    if not ids[0] or ids[0] != ids[1]:
        problems.append(f"profile of {ids[0]!r}, cohort of {ids[1]!r}")
    if not scalar(a3, "history_file"):
        problems.append("the cohort names no history_file")
    if problems:
        raise Refused(problems)
    wanted = {a.name: list(a.terms) for a in areas(a2) if a.terms and not a.presence.lower().startswith(NOT_FORESEEN)}
    config = Config(wanted, terms, false_friends(a2), top_k, listing(a3, "job_languages") or None)
    return config, {"master_id": ids[0], "edition": scalar(a3, "edition") or "", "history_file": scalar(a3, "history_file"), "places": listing(a3, "geography_priority")}
