"""Queries of match keys, cells, gates and page signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, normalize
from ..operators import gates, registry
from .views import choice, table

#: DuckDB twin of normalize_url over the column ``url``.
SQL_URL = r"""
lower((SELECT CASE WHEN len(kept) > 0 THEN head || '?' || array_to_string(list_sort(kept), '&') ELSE head END FROM (SELECT
  regexp_replace(split_part(regexp_replace(trim(coalesce({0}, '')), '#.*$', ''), '?', 1), '/+$', '') AS head,
  list_filter(string_split(CASE WHEN contains(regexp_replace(trim(coalesce({0}, '')), '#.*$', ''), '?') THEN substr(regexp_replace(trim(coalesce({0}, '')), '#.*$', ''), instr(regexp_replace(trim(coalesce({0}, '')), '#.*$', ''), '?') + 1) ELSE '' END, '&'),
    lambda p: p <> '' AND NOT (lower(split_part(p, '=', 1)) = 'utm' OR starts_with(lower(split_part(p, '=', 1)), 'utm_') OR lower(split_part(p, '=', 1)) IN ('refid', 'trackingid', 'trk', 'trkinternal', 'originalreferer', 'fbclid', 'gclid', 'mc_cid', 'mc_eid'))) AS kept)))
"""
SQL_COMPANY = r"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({0})), '\([^)]*\)', ' ', 'g'), '\b(?:s\.?p\.?a\.?|s\.?r\.?l\.?|s\.?a\.?s\.?|ltd|limited|gmbh|sas|sarl|bv|nv|sl|sa|inc|llc|spa|srl)\b', ' ', 'gi'), '[^a-z0-9]+', ' ', 'g'))"
SQL_TITLE = r"trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '\b(?:praktikant(?::in)?|beca(?:rio/a)?|tirocinante|internship|stagiaire|tirocinio|praktikum|stagista|stageur|intern|stage)\b', 'intern', 'gi'), '[^a-z0-9]+', ' ', 'g'))"
#: Fixed values of the twins, written out here and not taken from the code that they check.
SQL_INTERN = (
    r"interns?|internships?|stages?|stagist[aie]|stagiaires?|stageur|tirocini|tirocinio|tirocinant[ei]|working students?|werkstudent(?:in)?|curricular|"
    r"curriculare|curricolare|praktikant(?:in)?|praktikum|becas?|becari[oa]s?"
)
SQL_SENIOR, SQL_OUTRIGHT = "senior|manager|director|head of|vice president|vp|principal", "senior|head of|vice president|vp|principal"
SQL_JUNIOR = "junior|jr|assistant|assistante|assistente|trainee|alternant|alternante|alternance|apprenti|apprentie|apprentissage"
SQL_CLOSED = "no longer accepting|this job is closed|offerta chiusa|position filled|scaduto"
SQL_APPLY = "apply|candidati|invia (?:il tuo )?curriculum|bewerbung"
SQL_EU = (
    "italy italia milan milano rome roma turin torino naples napoli bologna florence venice france paris germany berlin munich spain madrid barcelona "
    "austria vienna netherlands amsterdam belgium brussels portugal lisbon sweden stockholm denmark copenhagen ireland dublin greece athens finland "
    "helsinki poland warsaw europe eu"
).split()
SQL_STATES = (
    "alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho illinois indiana iowa kansas kentucky louisiana "
    "maine maryland massachusetts michigan minnesota mississippi missouri montana nebraska nevada hampshire jersey mexico york carolina dakota ohio "
    "oklahoma oregon pennsylvania rhode tennessee texas utah vermont virginia washington wisconsin wyoming"
).split()
SQL_OTHER = (
    "uk england london canada toronto india china beijing shanghai singapore dubai uae australia sydney brasil brazil mexico chile colombia japan tokyo "
    "korea seoul"
).split()
SQL_CODES = (
    "AK AL AR AZ CA CO CT DC DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE NH NJ NM NV NY OH OK OR PA RI SC SD TN TX UT VA VT WA WI WV "
    "WY"
).split()
#: Places that name each of these terms, for the queries of places.
TERMS = (*[x.title() for x in SQL_EU], *SQL_STATES, *[x.upper() for x in SQL_OTHER], *SQL_CODES, "European Union", "District of Columbia", "U.S.A", "us", "United Kingdom", "Romeville", "Parisian", "Atlantis")
ENDS = ("", ", Lombardy, Italy", ", TX", " (remote)", ", UK", "x", ", In.")

PLACES = ("Milan, Lombardy, Italy", "College Station, TX", "London", "", "To verify", "Berlin, Germany", "Berlin, DE", "Toronto, Canada")
FIRMS = ("Acme S.p.A.", "Nova Gmbh (Group)", "Orienta Agenzia", "Kering SA", "Orientamento Srl", "Best Jobs Board", "Società Générale Müller SA", "Ateliér Žižka (Łódź) Srl")
TITLES = ("Senior Designer", "Stage Manager Intern", "Product Manager", "Assistant Product Manager", "Design Internship", "Head of Sales", "UX stagista", "Clerk", "Ingénieur qualité stagiaire")
MODES = ("On-site", "hybrid", "fully_remote", "Flexible", "REMOTE")
TONGUES = ("Inglese", "it", "deutsch", "klingon", "Español")


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", normalize.normalize_url(F.col("url")).alias("url_norm"))


def url_dedup(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "pages").select("page_id", normalize.normalize_url(F.col("url")).alias("url_norm"))
    return keyed.groupBy("url_norm").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


def host_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(normalize.host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def page_signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in gates.page_signals(F.col("html")).items()])


def verify_status(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in gates.page_signals(F.col("html")).items()])
    reachable, kind = F.col("page_id") % 5 != 0, choice(F.col("page_id"), ("gone", "error"))
    status = gates.verify_status(reachable, kind, F.lit("HTTP 404"), F.col("title"), F.col("has_intern"), F.col("has_apply"))
    return p.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def html_block_parse(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.cards import blocks

    b = blocks(table(spark, d, "pages"), "html", "<li>")
    return b.select("page_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("block", 'href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_replace(F.split_part("block", F.lit("</li>"), F.lit(1)), "<[^>]+>", " ")).alias("label"))


def geo_gate(spark: SparkSession, d: str) -> DataFrame:
    """Places that name every term, with every ending in turn."""
    k = F.col("p_partkey")
    c = table(spark, d, "part").select(F.concat(choice(k, TERMS), choice(F.floor(k / len(TERMS)), ENDS)).alias("place"))
    return c.groupBy("place", gates.geo_verdict(F.col("place")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def place_side(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", choice(F.col("c_custkey"), PLACES).alias("place"))
    return c.select("c_custkey", gates.place_side(F.col("place")).alias("side"))


def company_keys(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "customer").select("c_custkey", F.concat(choice(F.col("c_custkey"), FIRMS), F.lit(" "), F.col("c_name")).alias("firm"))
    return s.select("c_custkey", normalize.norm_company(F.col("firm")).alias("norm"), normalize.company_id(F.col("firm")).alias("company_id"))


def role_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", choice(F.col("c_custkey"), FIRMS).alias("firm"), choice(F.floor(F.col("c_custkey") / 7), TITLES).alias("title"), choice(F.floor(F.col("c_custkey") / 3), PLACES).alias("place"))
    return c.select("c_custkey", normalize.role_key(F.col("firm"), F.col("title"), F.col("place")).alias("role_key"))


def attribution(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "customer").select("c_custkey", choice(F.col("c_custkey"), FIRMS).alias("company"))
    patterns = spark.createDataFrame([("orienta", 1), ("jobs board", 2), ("board", 3), ("absent", 4)], "pattern string, entry_ord int")
    hits = gates.attribute(s, patterns).groupBy(F.col("aggregator").alias("pattern")).agg(F.count(F.lit(1)).alias("hits"))
    return patterns.select("pattern").join(F.broadcast(hits), "pattern", "left").select("pattern", F.coalesce("hits", F.lit(0)).alias("hits"))


def admissibility(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    p = p.select("p_partkey", F.concat_ws(" ", choice(k, TITLES), "p_name").alias("title"), F.when(k % 11 == 0, "Offerta chiusa").otherwise("").alias("snippet"), normalize.work_mode(choice(F.floor(k / 8), MODES)).alias("mode"), F.when(k % 13 == 0, F.lit(False)).alias("open"), F.when(k % 17 == 0, F.lit(True)).alias("stage"), F.array(choice(F.floor(k / 5), TONGUES)).alias("want"))
    ok = gates.languages_satisfiable(F.col("want"), F.array(F.lit("english"), F.lit("italian")), F.lit("all"))
    return p.select("p_partkey", gates.admissibility(F.col("title"), F.col("snippet"), F.col("stage"), F.col("mode"), F.col("open"), ok).alias("ground"))


def work_modes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", choice(F.col("c_custkey"), MODES).alias("m"), choice(F.col("c_custkey"), TONGUES).alias("t"))
    return c.select("c_custkey", normalize.work_mode(F.col("m")).alias("work_mode"), normalize.norm_language(F.col("t")).alias("language"), normalize.is_known_language(F.col("t")).alias("known"))


def date_parse(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    written = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "dd/MM/yyyy")).when(F.col("o_orderkey") % 4 == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:00:00"))).otherwise(F.lit("31/02/2026"))
    o = table(spark, d, "orders").select("o_orderkey", written.alias("w"))
    return o.select("o_orderkey", normalize.parse_date(F.col("w")).alias("day"), normalize.detect_date_format(F.col("w")).alias("fmt"))


def retry_after(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 90).cast("string")).when(F.col("event_id") % 3 == 1, "soon").otherwise("Mon, 01 Jan 2024 00:00:09 GMT").alias("h"))
    return e.select("event_id", normalize.parse_retry_after(F.col("h"), F.lit(1704067200000).cast("long")).alias("wait_ms"), normalize.backoff_ms(F.col("event_id") % 6, F.lit(0.5)).alias("backoff_ms"))


def response_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (200, 403, 404, 410, 429, 500, 204))), (k % 7 + 1).cast("int"))
    body = F.when(k % 5 == 0, "Just a moment...").otherwise("fine")
    error = F.when(k % 19 == 0, "timeout").when(k % 23 == 0, "blocked by allowlist")
    e = table(spark, d, "events").select(gates.response_kind(status).alias("kind"), gates.probe_kind(status, error, body).alias("probe"))
    return e.groupBy("kind", "probe").agg(F.count(F.lit(1)).alias("n"))


def multivalue_split(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("1. "), "c_name", F.lit(" | 2. "), "c_mktsegment")).when(F.col("c_custkey") % 4 == 1, F.concat("c_name", F.lit("\n"), "c_mktsegment")).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("1. Intern - Level 2. "), "c_name")).otherwise(F.concat(F.lit("2. "), "c_name", F.lit(" | 3. x"))).alias("cell"))
    items = cells.split_cell(F.col("cell"), "Matching Job Titles")
    return c.select("c_custkey", F.size(items).cast("long").alias("n"), F.array_join(items, "~").alias("items"))


def score_from_notes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Match score: "), (F.col("c_custkey") % 100).cast("string"), F.lit("/100. good "), F.when(F.col("c_custkey") % 3 == 0, "Match score: 7/100. more").otherwise("end")).alias("notes"))
    return c.select("c_custkey", cells.split_scores(F.col("notes")).alias("s")).select("c_custkey", "s.scores", "s.notes")


def closed_set_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    status, decision, verified = choice(k, ("New job found", "Contacted", "Gone", "")), choice(k, ("Review", "Maybe", "Yes")), choice(k, ("Blocked — x", "Verified", "", "To verify", "Portal verified ok"))
    date = F.when(k % 7 == 0, "31/02/2026").otherwise(F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yyyy"))
    o = table(spark, d, "orders").select("o_orderkey", registry.problems(status, decision, verified, {"Recall": date}).alias("p"))
    return o.select("o_orderkey", F.explode("p").alias("problem"))


def note_split(spark: SparkSession, d: str) -> DataFrame:
    """One to three numbered notes, with numbers inside them that separate nothing."""
    k = F.col("c_custkey")
    one = F.concat(F.lit("1. Compatible "), "c_name", F.lit(" has 2. inside"))
    two = F.when(k % 3 > 0, F.concat(F.lit(" 2. Borderline "), "c_mktsegment")).otherwise("")
    notes = F.concat(one, two, F.when(k % 3 > 1, " 3. Excluded for 4. reasons").otherwise(""))
    split = F.transform(cells.split_notes(notes), lambda x: F.trim(x))
    return table(spark, d, "customer").select("c_custkey", F.size(split).cast("long").alias("n"), F.array_join(split, "~").alias("notes"))


def _pick(values: tuple[str, ...], k: str) -> str:
    return "CASE CAST(({}) % {} AS INT) {} END".format(k, len(values), " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)))


_SIGNALS = rf"""SELECT page_id, left(trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')), 120) AS title,
  regexp_matches(left(html, 120000), '(?i)\b(?:{SQL_INTERN})\b') AS has_intern, regexp_matches(left(html, 120000), '(?i){SQL_APPLY}') AS has_apply FROM pages"""
_EU, _FAR = "|".join([*SQL_EU, "european union"]), "|".join([*SQL_STATES, *SQL_OTHER, "united states", "district of columbia", "united kingdom", r"u\.?s\.?a?"])
_GEO = rf"CASE WHEN trim({{0}}) = '' THEN 'unknown' WHEN regexp_matches(trim({{0}}), '\b(?:{'|'.join(SQL_CODES)})\.?$') THEN 'non-eu' WHEN regexp_matches({{0}}, '(?i)\b(?:{_FAR})\b') AND NOT regexp_matches({{0}}, '(?i)\b(?:{_EU})\b') THEN 'non-eu' WHEN regexp_matches({{0}}, '(?i)\b(?:{_EU})\b') THEN 'eu' ELSE 'unknown' END"
_CITY = "CASE WHEN {0} = '' THEN '' ELSE coalesce(map {{'milano': 'milan', 'roma': 'rome', 'torino': 'turin', 'italia': 'italy'}}[{0}], {0}) END".format(r"trim(regexp_replace(regexp_replace(lower(trim(split_part(place, ',', 1))), '[^a-z\s]+', ' ', 'g'), '\s+', ' ', 'g'))")
_MODE = r"CASE regexp_replace(lower(trim({0})), '[\s_-]', '', 'g') WHEN 'onsite' THEN 'onsite' WHEN 'hybrid' THEN 'hybrid' WHEN 'remote' THEN 'fully_remote' WHEN 'fullyremote' THEN 'fully_remote' END"
_TONGUE = "CASE strip_accents(lower({0})) WHEN 'inglese' THEN 'english' WHEN 'it' THEN 'italian' WHEN 'deutsch' THEN 'german' WHEN 'espanol' THEN 'spanish' ELSE strip_accents(lower({0})) END"

SQL = {
    "note_split": """SELECT c_custkey, CAST(c_custkey % 3 + 1 AS BIGINT) AS n, 'Compatible ' || c_name || ' has 2. inside' || CASE WHEN c_custkey % 3 > 0 THEN '~Borderline ' || c_mktsegment ELSE '' END || CASE WHEN c_custkey % 3 > 1 THEN '~Excluded for 4. reasons' ELSE '' END AS notes FROM customer""",
    "url_normalize": f"SELECT page_id, {SQL_URL.format('url')} AS url_norm FROM pages",
    "url_dedup": f"SELECT url_norm, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, {SQL_URL.format('url')} AS url_norm FROM pages) GROUP BY url_norm",
    "host_of": r"SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
    "page_signals": _SIGNALS,
    "verify_status": f"""SELECT CASE WHEN page_id % 5 = 0 THEN 'Blocked — ' || CASE WHEN page_id % 2 = 0 THEN 'posting removed (HTTP 404)' ELSE 'HTTP 404' END WHEN has_apply THEN 'Employer verified active'
      WHEN title = '' AND NOT has_intern THEN 'To verify — page returned no readable content (soft 404 or JS-rendered shell)' ELSE 'To verify — apply path not visible on the employer page (may be JS-rendered)' END AS status, count(*) AS n FROM ({_SIGNALS}) GROUP BY 1""",
    "html_block_parse": """SELECT page_id, i AS pos, regexp_extract(b, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(split_part(b, '</li>', 1), '<[^>]+>', ' ', 'g')) AS label
      FROM (SELECT page_id, unnest(string_split(html, '<li>')) AS b, unnest(range(len(string_split(html, '<li>')))) AS i FROM pages) WHERE i > 0""",
    "geo_gate": f"SELECT place, {_GEO.format('place')} AS verdict, count(*) AS n FROM (SELECT {_pick(TERMS, 'p_partkey')} || {_pick(ENDS, f'p_partkey // {len(TERMS)}')} AS place FROM part) GROUP BY ALL",
    "place_side": f"SELECT c_custkey, CASE WHEN place LIKE '%Italy' THEN 'Yes' WHEN place LIKE '%Germany' THEN 'No' END AS side FROM (SELECT c_custkey, {_pick(PLACES, 'c_custkey')} AS place FROM customer)",
    "company_keys": f"SELECT c_custkey, norm, 'polids-' || left(sha1(norm), 8) AS company_id FROM (SELECT c_custkey, {SQL_COMPANY.format('firm')} AS norm FROM (SELECT c_custkey, {_pick(FIRMS, 'c_custkey')} || ' ' || c_name AS firm FROM customer))",
    "role_keys": f"""SELECT c_custkey, 'x:' || {SQL_COMPANY.format('firm')} || '|' || {SQL_TITLE.format('title')} || '|' || {_CITY} AS role_key
      FROM (SELECT c_custkey, {_pick(FIRMS, 'c_custkey')} AS firm, {_pick(TITLES, 'c_custkey // 7')} AS title, {_pick(PLACES, 'c_custkey // 3')} AS place FROM customer)""",
    "attribution": f"""WITH s AS (SELECT ' ' || {SQL_COMPANY.format('firm')} || ' ' AS n FROM (SELECT {_pick(FIRMS, 'c_custkey')} AS firm FROM customer)),
      a AS (SELECT CASE WHEN contains(n, ' orienta ') THEN 'orienta' WHEN contains(n, ' jobs board ') THEN 'jobs board' WHEN contains(n, ' board ') THEN 'board' WHEN contains(n, ' absent ') THEN 'absent' END AS hit FROM s)
      SELECT pattern, count(hit) AS hits FROM (VALUES ('orienta'), ('jobs board'), ('board'), ('absent')) t(pattern) LEFT JOIN a ON hit = pattern GROUP BY pattern""",
    "admissibility": rf"""SELECT p_partkey, CASE WHEN regexp_matches(title, '(?i)\b(?:{SQL_SENIOR})\b') AND (regexp_matches(title, '(?i)\b(?:{SQL_OUTRIGHT})\b') OR NOT regexp_matches(title, '(?i)\b(?:{SQL_JUNIOR})\b'))
        AND NOT (p_partkey % 17 = 0 OR regexp_matches(title || chr(10) || snippet, '(?i)\b(?:{SQL_INTERN})\b')) THEN 'senior-without-stage'
      WHEN mode = 'fully_remote' THEN 'fully-remote' WHEN p_partkey % 13 = 0 OR regexp_matches(title || chr(10) || snippet, '(?i){SQL_CLOSED}') THEN 'closed-ad'
      WHEN lang IN ('german', 'spanish') THEN 'mandatory-language' END AS ground
      FROM (SELECT p_partkey, {_pick(TITLES, 'p_partkey')} || ' ' || p_name AS title, CASE WHEN p_partkey % 11 = 0 THEN 'Offerta chiusa' ELSE '' END AS snippet, {_MODE.format(_pick(MODES, 'p_partkey // 8'))} AS mode, {_TONGUE.format(_pick(TONGUES, 'p_partkey // 5'))} AS lang FROM part)""",
    "work_modes": f"SELECT c_custkey, {_MODE.format('m')} AS work_mode, {_TONGUE.format('t')} AS language, t <> 'klingon' AS known FROM (SELECT c_custkey, {_pick(MODES, 'c_custkey')} AS m, {_pick(TONGUES, 'c_custkey')} AS t FROM customer)",
    "date_parse": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS day, CASE o_orderkey % 4 WHEN 0 THEN 'iso' WHEN 1 THEN 'dmy' WHEN 3 THEN 'dmy' END AS fmt FROM orders""",
    "retry_after": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 90) * 1000 WHEN 2 THEN 9000 END AS wait_ms, CAST(floor(0.5 * least(8000, 1000 * pow(2, event_id % 6))) AS BIGINT) AS backoff_ms FROM events""",
    "response_classes": """WITH e AS (SELECT event_id AS k, CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 410 WHEN 4 THEN 429 WHEN 5 THEN 500 ELSE 204 END AS s FROM events)
      SELECT CASE WHEN s IN (403, 429) THEN 'blocked' WHEN s IN (404, 410) THEN 'gone' WHEN s < 300 THEN 'ok' ELSE 'error' END AS kind,
      CASE WHEN k % 19 = 0 THEN 'network_error' WHEN k % 23 = 0 THEN 'allowlist_blocked' WHEN s = 429 THEN 'rate_limited' WHEN s = 403 THEN 'forbidden' WHEN k % 5 = 0 THEN 'challenge' WHEN s < 300 THEN 'ok' ELSE 'http_error' END AS probe, count(*) AS n FROM e GROUP BY ALL""",
    "multivalue_split": """SELECT c_custkey, CAST(CASE c_custkey % 4 WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS n, CASE c_custkey % 4 WHEN 0 THEN c_name || '~' || c_mktsegment WHEN 1 THEN c_name || '~' || c_mktsegment WHEN 2 THEN 'Intern - Level 2. ' || c_name ELSE c_name || '~x' END AS items FROM customer""",
    "score_from_notes": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '1. ' || (c_custkey % 100) || ' | 2. 7' ELSE CAST(c_custkey % 100 AS VARCHAR) END AS scores, CASE WHEN c_custkey % 3 = 0 THEN 'good more' ELSE 'good end' END AS notes FROM customer""",
    "closed_set_problems": """SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 4 = 2 THEN 'status: Gone' END, CASE WHEN o_orderkey % 3 = 1 THEN 'decision: Maybe' END, CASE WHEN o_orderkey % 5 = 1 THEN 'verification: Verified' END, CASE WHEN o_orderkey % 7 = 0 THEN 'Recall: 31/02/2026' END], lambda x: x IS NOT NULL)) AS problem FROM orders""",
}

QUERIES = [
    url_normalize, url_dedup, host_of, page_signals, verify_status, html_block_parse, geo_gate, place_side, company_keys, role_keys, attribution, admissibility, work_modes, date_parse,
    retry_after, response_classes, multivalue_split, score_from_notes, closed_set_problems, note_split,
]
