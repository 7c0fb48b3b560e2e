"""Parsers of saved pages and board payloads into cards, one row per posting.

Every field of a card is read from the card's own block, never from arrays over the
whole page: a malformed block costs itself, not its neighbours.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import decode_entities, strip_tags, text, work_mode
from ..operators.gates import intern_signal, match_query
from ..storage import stored

CARD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "company", "location", "url", "snippet", "posted", "sourceJobId", "poster")]
    + [T.StructField("alternateUrls", T.ArrayType(T.StringType())), T.StructField("workMode", T.StringType())]
    + [T.StructField("source", T.StringType()), T.StructField("discoveryQuery", T.StringType()), T.StructField("ord", T.LongType())]
)
OPEN = "To verify"


def as_cards(df: DataFrame) -> DataFrame:
    """df with exactly the columns of a card; missing ones are null, an empty id is none."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CARD]
    return df.select(*cols).withColumn("sourceJobId", F.nullif("sourceJobId", F.lit("")))


def blocks(pages: DataFrame, html: str, mark: str) -> DataFrame:
    """A row per block of a page: what follows each ``mark``. pos counts from 1."""
    return pages.select("*", F.posexplode(F.split(text(F.col(html)), mark)).alias("pos", "block")).filter("pos > 0")


def _clean(c: Column) -> Column:
    return decode_entities(strip_tags(c))


def guest_cards(pages: DataFrame, html: str = "html", query: str = "query") -> DataFrame:
    """Search result pages of list items; a block without id or title is no card. The url ends at its query."""
    got = lambda p: F.regexp_extract(F.col("block"), "(?s)" + p, 1)
    anchor = got(r"(<a[^>]*base-card__full-link[^>]*>)")
    href = F.regexp_extract(anchor, 'href="([^"]*)"', 1)
    b = blocks(pages, html, "<li>").withColumn("job", got(r'data-entity-urn="urn:li:jobPosting:(\d+)"')).withColumn("t", got(r'base-search-card__title">\s*(.*?)\s*</h3>'))
    posted = _clean(got(r"<time[^>]*>(.*?)</time>"))
    b = b.filter("job <> '' and t <> ''").select(
        "*",
        _clean(F.col("t")).alias("title"),
        _clean(got(r"base-search-card__subtitle[^>]*>(.*?)</a>")).alias("company"),
        _clean(got(r'job-search-card__location">\s*(.*?)\s*</span>')).alias("location"),
        F.split_part(F.when(href != "", href).otherwise(F.concat(F.lit("https://www.linkedin.com/jobs/view/"), "job", F.lit("/"))), F.lit("?"), F.lit(1)).alias("url"),
        F.when(posted != "", F.concat(F.lit("posted: "), posted)).otherwise("").alias("snippet"),
        F.nullif(posted, F.lit("")).alias("posted"),
        F.col("job").alias("sourceJobId"),
        F.lit("linkedin").alias("source"),
        F.col(query).alias("discoveryQuery"),
    )
    return b


def posting(html: Column) -> Column:
    """struct(desc, closed) of one posting's page: its description block only."""
    block = F.regexp_extract(text(html), r"(?s)show-more-less-html__markup[^>]*>(.*?)</div>", 1)
    lines = F.regexp_replace(F.regexp_replace(block, r"<(?:br|/p|/li|/h\d)[^>]*>", "\n"), "<[^>]+>", " ")
    desc = F.regexp_replace(decode_entities(F.replace(lines, F.lit("&nbsp;"), F.lit(" "))), "[ \t]+", " ")
    return F.struct(F.regexp_replace(desc, r"^\s+|\s+$", "").alias("desc"), F.contains(text(html), F.lit("No longer accepting applications")).alias("closed"))


def article_cards(pages: DataFrame, html: str = "html", query: str = "query") -> DataFrame:
    """Pages of job-card articles: company and location part at the last " - ", the id ends the url."""
    got = lambda p, i=1: F.regexp_extract(F.col("block"), "(?s)" + p, i)
    clean = lambda c: F.trim(F.regexp_replace(F.replace(F.regexp_replace(c, "<[^>]+>", " "), F.lit("&amp;"), F.lit("&")), r"\s+", " "))
    link = r'job-card-title.*?<a href="([^"]+)">(.*?)</a>'
    b = blocks(pages, html, '<article class="job-card"').withColumn("url", got(link)).filter("url <> ''")
    place = clean(got(r"job-card-work-place.*?<a[^>]*>(.*?)</a>"))
    b = b.withColumn("place", F.when(place == "", OPEN).otherwise(place)).withColumn("day", got(r'data_pubblicazione">(\d{2}/\d{2}/\d{4})<'))
    parted = F.col("place").rlike("^.+ - ")
    job = F.regexp_extract("url", r"-(\d+)$", 1)
    return b.select(
        "*",
        clean(got(link, 2)).alias("title"),
        F.when(parted, F.trim(F.regexp_extract("place", "^(.+) - (.*)$", 1))).otherwise(F.col("place")).alias("company"),
        F.when(parted, F.trim(F.regexp_extract("place", "^(.+) - (.*)$", 2))).otherwise(OPEN).alias("location"),
        F.when(F.col("day") != "", F.concat(F.lit("pubblicato il "), "day")).otherwise("").alias("snippet"),
        F.nullif("day", F.lit("")).alias("posted"),
        F.when(job != "", F.concat(F.lit("cerc:"), job)).alias("sourceJobId"),
        F.lit("cercolavoro").alias("source"),
        F.col(query).alias("discoveryQuery"),
    )


BOARD_KINDS = ("greenhouse", "lever", "ashby")
_GREENHOUSE = "struct<jobs: array<struct<id: bigint, title: string, location: struct<name: string>, absolute_url: string>>>"
_LEVER = "array<struct<id: string, text: string, categories: struct<location: string>, workplaceType: string, hostedUrl: string>>"
_ASHBY = "struct<jobs: array<struct<id: string, title: string, location: string, employmentType: string, isListed: boolean, jobUrl: string, descriptionPlain: string, workplaceType: string>>>"


def check_boards(boards: list[tuple[str, str, str]]) -> None:
    """Refuse unknown kinds, all of them at once, before any plan is built."""
    bad = sorted({k for k, *_ in boards if k not in BOARD_KINDS})
    if bad:
        raise ValueError(f"unknown board kinds: {', '.join(bad)}")


def _wanted(queries: list[str], title: Column) -> Column:
    out = F.lit(False)
    for q in queries:
        out = out | match_query(F.lit(q), title)
    return out


def board_cards(payloads: DataFrame, kind: str, queries: list[str] = ()) -> DataFrame:
    """payloads(board, company, body) of one kind of board -> cards. A body that isn't JSON gives none."""
    check_boards([(kind, "", "")])
    if kind == "greenhouse":
        j = payloads.select("board", "company", F.explode(F.from_json("body", _GREENHOUSE)["jobs"]).alias("j")).filter(_wanted(queries, F.col("j.title")))
        cols = [F.col("j.title"), F.coalesce(F.nullif("j.location.name", F.lit("")), F.lit(OPEN)), F.col("j.absolute_url"), F.lit(""), F.col("j.id").cast("string"), F.lit(None).cast("string"), F.concat(F.lit("ats:"), "board")]
    elif kind == "lever":
        j = payloads.select("board", "company", F.explode(F.from_json("body", _LEVER)).alias("j")).filter(_wanted(queries, F.col("j.text")))
        cols = [F.col("j.text"), F.coalesce(F.nullif("j.categories.location", F.lit("")), F.lit(OPEN)), F.col("j.hostedUrl"), F.lit(""), F.col("j.id"), work_mode(F.col("j.workplaceType")), F.concat(F.lit("ats:"), "board")]
    else:
        j = payloads.select("board", "company", F.explode(F.from_json("body", _ASHBY)["jobs"]).alias("j"))
        hay = F.concat_ws(" ", "j.title", F.coalesce("j.employmentType", F.lit("")))
        j = j.filter(F.coalesce("j.isListed", F.lit(True)) & intern_signal(hay))
        url = F.coalesce(F.nullif("j.jobUrl", F.lit("")), F.concat(F.lit("https://jobs.ashbyhq.com/"), "board", F.lit("/"), "j.id"))
        cols = [F.col("j.title"), F.coalesce(F.nullif("j.location", F.lit("")), F.lit(OPEN)), url, F.left(text(F.col("j.descriptionPlain")), F.lit(500)), F.concat(F.lit("ashby:"), "j.id"), work_mode(F.col("j.workplaceType")), F.concat(F.lit("ashby:"), "board")]
    names = ("title", "location", "url", "snippet", "sourceJobId", "workMode", "discoveryQuery")
    return j.select("company", F.lit("employer").alias("source"), *[c.alias(n) for c, n in zip(cols, names, strict=True)])


#: Sources read at a time.
AT_ONCE = 8


def discover(sources: dict[str, object], cap: int | None = None) -> tuple[DataFrame | None, list[dict]]:
    """(union of the cards of all sources, a report of each). A source that fails is reported and gives no cards.

    sources: name -> function without arguments that returns cards. Each is read once, some
    at a time: its cards are written, counted on the way, and the union reads what was
    written. Of a source with more than ``cap`` cards the first by ord, and by all other
    columns where ord is the same, stay; it is reported as capped, with the number of cards that stay.
    """

    def one(name: str, source) -> tuple[DataFrame | None, dict]:
        try:
            seen = Observation(f"cards of {name}")
            cards = stored(as_cards(source()).observe(seen, F.count(F.lit(1)).alias("n")), "cards")
            n = seen.get["n"]
            capped = cap is not None and n > cap
            if capped:
                cards = cards.orderBy("ord", *[c for c in cards.columns if c != "ord"]).limit(cap)
            return cards, {"id": name, "status": "capped" if capped else "ok", "cards": cap if capped else n, "reason": f"{cap} of {n} cards" if capped else None}
        except Exception as e:  # noqa: BLE001  whatever one source raises, the others go on
            return None, {"id": name, "status": "error", "cards": 0, "reason": f"{type(e).__name__}: {e}"}

    with ThreadPoolExecutor(AT_ONCE) as pool:
        done = list(pool.map(one, sources, sources.values()))
    found = None
    for cards, _ in done:
        if cards is not None:
            found = cards if found is None else found.unionByName(cards)
    return found, [report for _, report in done]
