"""Ordered eligibility gates. A gate only judges rows that no earlier gate has, and an undeclared field never excludes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import LEFT, RIGHT, is_known_language, norm_company, norm_language, text

#: Place names that tell the side of a location.
EU_PLACES = (
    "italy italia milan milano rome roma turin torino naples napoli bologna florence venice france paris germany berlin munich spain madrid barcelona "
    "austria vienna netherlands amsterdam belgium brussels portugal lisbon sweden stockholm denmark copenhagen ireland dublin greece athens finland helsinki "
    "poland warsaw europe eu"
).split()
US_STATES = (
    "alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho illinois indiana iowa kansas kentucky louisiana "
    "maine maryland massachusetts michigan minnesota mississippi missouri montana nebraska nevada hampshire jersey mexico york carolina dakota ohio oklahoma "
    "oregon pennsylvania rhode tennessee texas utah vermont virginia washington wisconsin wyoming"
).split()
OTHER_PLACES = "uk england london canada toronto india china beijing shanghai singapore dubai uae australia sydney brasil brazil mexico chile colombia japan tokyo korea seoul".split()
STATE_CODES = "AK AL AR AZ CA CO CT DC DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE NH NJ NM NV NY OH OK OR PA RI SC SD TN TX UT VA VT WA WI WV WY".split()
#: Vocabularies of titles and texts, as patterns between word boundaries.
INTERN = (
    r"interns?|internships?|stages?|stagist[aie]|stagiaires?|stageur|tirocini|tirocinio|tirocinant[ei]|working students?|werkstudent(?:in)?|curricular|"
    r"curriculare|curricolare|praktikant(?:in)?|praktikum|becas?|becari[oa]s?"
)
SENIOR = "senior|manager|director|head of|vice president|vp|principal"
OUTRIGHT = "senior|head of|vice president|vp|principal"
NOT_CLEARLY = "junior|jr|assistant|assistante|assistente|trainee|alternant|alternante|alternance|apprenti|apprentie|apprentissage"
CLOSED = "no longer accepting|this job is closed|offerta chiusa|position filled|scaduto"
CHALLENGES = ("cf-challenge", "challenge-platform", "unusual traffic", "access denied", "request blocked", "just a moment...", "verifying you are human")
APPLY = "apply|candidati|invia (?:il tuo )?curriculum|bewerbung"
GROUNDS = ("senior-without-stage", "fully-remote", "closed-ad", "mandatory-language")


def words(pattern: str) -> str:
    return f"(?i){LEFT}(?:{pattern}){RIGHT}"


def geo_verdict(location: Column) -> Column:
    """eu, non-eu or unknown. A trailing two-letter code counts as a US state first, as written in capitals."""
    eu = words("|".join([*EU_PLACES, "european union"]))
    far = words("|".join([*US_STATES, *OTHER_PLACES, "united states", "district of columbia", "united kingdom", r"u\.?s\.?a?"]))
    place = F.trim(text(location))
    return (
        F.when(place == "", "unknown")
        .when(place.rlike(rf"{LEFT}(?:{'|'.join(STATE_CODES)})\.?$"), "non-eu")
        .when(place.rlike(far) & ~place.rlike(eu), "non-eu")
        .when(place.rlike(eu), "eu")
        .otherwise("unknown")
    )


def intern_signal(c: Column) -> Column:
    return c.rlike(words(INTERN))


def clearly_senior(title: Column) -> Column:
    return title.rlike(words(SENIOR)) & (title.rlike(words(OUTRIGHT)) | ~title.rlike(words(NOT_CLEARLY)))


def languages_satisfiable(required: Column, admitted: Column, requirement: Column, fold=None) -> Column:
    """True unless both lists name known languages and the required ones aren't met; ``requirement`` is all, or any by default."""
    names = {"fold": fold} if fold else {}
    known = lambda a: F.transform(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: is_known_language(x, **names)), lambda x: norm_language(x, **names))
    want, have = known(required), known(admitted)
    met = F.when(requirement == "all", F.size(F.array_except(want, have)) == 0).otherwise(F.arrays_overlap(want, have))
    return (F.size(want) == 0) | (F.size(have) == 0) | met


def admissibility(title: Column, snippet: Column, stage_nature: Column, work_mode: Column, application_open: Column, languages_ok: Column) -> Column:
    """The first ground that fires, or null."""
    title, hay = text(title), F.concat(text(title), F.lit("\n"), text(snippet))
    stage = F.coalesce(stage_nature, intern_signal(hay))
    return (
        F.when(clearly_senior(title) & ~stage, GROUNDS[0])
        .when(work_mode == "fully_remote", GROUNDS[1])
        .when((application_open == F.lit(False)) | hay.rlike(f"(?i){CLOSED}"), GROUNDS[2])
        .when(~languages_ok, GROUNDS[3])
    )


def attribute(cards: DataFrame, aggregators: DataFrame, company: str = "company", fold=None) -> DataFrame:
    """cards with ``aggregator``, the first pattern of aggregators(pattern, entry_ord) whose words stand side by side in the company's name.

    An inverted index of runs of words: each distinct name is taken apart into the runs
    that are as long as some pattern, which join the patterns by equality. A pattern that
    stands there several times counts by its first entry. Patterns may be any number.
    """
    names = {"fold": fold} if fold else {}
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    index = aggregators.select("entry_ord", "pattern", words(F.col("pattern")).alias("w")).filter("size(w) > 0")
    index = index.groupBy(F.array_join("w", " ").alias("run"), F.size("w").alias("n")).agg(F.min(F.struct("entry_ord", "pattern")).alias("entry"))
    lengths = index.agg(F.sort_array(F.collect_set("n")).alias("n")).first()[0]  # as many as patterns differ in length
    known = cards.select(F.col(company).alias("_name")).distinct()
    known = known.select("_name", words(norm_company(F.col("_name"), **names)).alias("w"))
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    every = F.flatten(F.array(*[F.when(F.size("w") >= n, of_length(F.lit(n))).otherwise(F.array().cast("array<string>")) for n in lengths]).cast("array<array<string>>"))
    runs = known.select("_name", F.explode(F.array_distinct(every)).alias("run"))
    found = runs.join(index, "run").groupBy("_name").agg(F.min("entry")["pattern"].alias("aggregator"))
    return cards.join(found, F.col(company) == F.col("_name"), "left").drop("_name")


def with_outcome(df: DataFrame, condition: Column, outcome: str | Column) -> DataFrame:
    """Set ``outcome`` where it is still open and the condition holds."""
    if "outcome" not in df.columns:
        df = df.withColumn("outcome", F.lit(None).cast("string"))
    to = F.lit(outcome) if isinstance(outcome, str) else outcome
    return df.withColumn("outcome", F.when(F.col("outcome").isNull() & F.coalesce(condition, F.lit(False)), to).otherwise(F.col("outcome")))


def match_query(query: Column, title: Column) -> Column:
    """Any term of more than two characters of the query stands in the title."""
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda t: F.length(t) > 2)
    return F.exists(terms, lambda t: F.contains(F.lower(title), t))


def is_challenge(body: Column) -> Column:
    head = F.lower(F.left(text(body), F.lit(20_000)))
    return F.exists(F.array(*map(F.lit, CHALLENGES)), lambda m: F.contains(head, m))


def response_kind(status: Column) -> Column:
    return F.when(status.isin(403, 429), "blocked").when(status.isin(404, 410), "gone").when(status.between(200, 299), "ok").otherwise("error")


def probe_kind(status: Column, error: Column, body: Column) -> Column:
    """Classes of a probe's response, most telling first."""
    return (
        F.when(error.rlike("(?i)allowlist"), "allowlist_blocked")
        .when(error.isNotNull(), "network_error")
        .when(status == 429, "rate_limited")
        .when(status == 403, "forbidden")
        .when(is_challenge(body), "challenge")
        .when(status.between(200, 299), "ok")
        .otherwise("http_error")
    )


def page_signals(body: Column) -> dict[str, Column]:
    """title (120 characters at most), has_intern and has_apply of the first 120 000 characters."""
    head = F.left(text(body), F.lit(120_000))
    title = F.regexp_extract(text(body), "(?is)<title>(.*?)</title>", 1)
    return {
        "title": F.left(F.trim(F.regexp_replace(title, r"\s+", " ")), F.lit(120)),
        "has_intern": intern_signal(head),
        "has_apply": head.rlike(f"(?i){APPLY}"),
    }


def verify_status(reachable: Column, kind: Column, detail: Column, title: Column, has_intern: Column, has_apply: Column) -> Column:
    why = F.when(kind == "gone", F.concat(F.lit("posting removed ("), detail, F.lit(")"))).otherwise(detail)
    return (
        F.when(~reachable, F.concat(F.lit("Blocked — "), why))
        .when(has_apply, "Employer verified active")
        .when((text(title) == "") & ~has_intern, "To verify — page returned no readable content (soft 404 or JS-rendered shell)")
        .otherwise("To verify — apply path not visible on the employer page (may be JS-rendered)")
    )


#: Countries that a place may name.
COUNTRIES = (
    "austria;belgium;bulgaria;croatia;cyprus;czechia;czech republic;denmark;estonia;finland;france;germany;greece;hungary;ireland;latvia;lithuania;luxembourg;"
    "malta;netherlands;poland;portugal;romania;slovakia;slovenia;spain;sweden;norway;switzerland;united kingdom;european union"
).split(";")


def place_side(location: Column) -> Column:
    """Yes for Italy, No for another known country, else null."""
    tokens = F.transform(F.split(F.lower(text(location)), ","), lambda x: F.trim(x))
    return F.when(F.arrays_overlap(tokens, F.array(F.lit("italy"), F.lit("italia"))), "Yes").when(F.arrays_overlap(tokens, F.array(*map(F.lit, COUNTRIES))), "No")
