"""Queries of parsers, file readers and whole workflow steps, over inputs laid on the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells, normalize
from ..operators import gates, publishing, registry, workflow
from ..sources import cards, files, paged, runlog
from ..storage import fresh
from ..streaming import guard
from . import q_runs
from .views import choice, table

def ck() -> Column:
    return F.col("c_custkey")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", ck().cast("string").alias("k"))


def guest_cards(spark: SparkSession, d: str) -> DataFrame:
    """Search pages of one card, one advert and one block without a title each."""
    c = _customers(spark, d)
    html = F.concat(
        F.lit('<ul><li><div data-entity-urn="urn:li:jobPosting:'), "k", F.lit('"><h3 class="base-search-card__title">\n '), "c_name", F.lit(' &amp; Co </h3><h4 class="base-search-card__subtitle x"><a href="#">'), "c_mktsegment",
        F.lit('</a></h4><span class="job-search-card__location"> Milan, Italy </span>'),
        F.when(ck() % 2 == 1, F.concat(F.lit('<a class="base-card__full-link" href="https://x.test/j/'), "k", F.lit('?trk=1">x</a>'))).otherwise(""),
        F.when(ck() % 3 == 1, F.concat(F.lit("<time>"), (ck() % 9).cast("string"), F.lit(" days ago</time>"))).otherwise(""),
        F.lit('</div></li><li><div>advert</div></li><li data-entity-urn="urn:li:jobPosting:7"></ul>'),
    )
    got = cards.as_cards(cards.guest_cards(c.select(html.alias("html"), F.concat(F.lit("q"), "k").alias("query"))))
    return got.select("sourceJobId", "title", "company", "location", "url", "snippet", "posted", "discoveryQuery")


def posting_pages(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit('<p>x</p><div class="show-more-less-html__markup y">'), "c_name", F.lit("<br>two &lt;b&gt; <b>three</b></p>last</div>"), F.when(ck() % 4 == 0, "No longer accepting applications").otherwise(""))
    return _customers(spark, d).select("c_custkey", cards.posting(html).alias("p")).select("c_custkey", "p.desc", "p.closed")


def article_cards(spark: SparkSession, d: str) -> DataFrame:
    place = F.when(ck() % 3 == 0, F.concat("c_mktsegment", F.lit(" - Nazca srl - Milano (MI)"))).when(ck() % 3 == 1, "Torino").otherwise("")
    html = F.concat(
        F.lit('<article class="job-card"><div class="job-card-title"><a href="https://c.test/x'), F.when(ck() % 2 == 0, F.concat(F.lit("-"), "k")).otherwise(""), F.lit('">'), "c_name", F.lit('</a></div><div class="job-card-work-place"><a>'), place,
        F.lit("</a></div>"), F.when(ck() % 5 == 0, '<i class="data_pubblicazione">01/02/2026</i>').otherwise(""), F.lit('<article class="job-card">no link'),
    )
    got = cards.as_cards(cards.article_cards(_customers(spark, d).select(html.alias("html"), F.lit("q").alias("query"))))
    return got.select("title", "company", "location", "url", "snippet", "sourceJobId")


def _board(spark: SparkSession, d: str, kind: str, body) -> DataFrame:
    payloads = _customers(spark, d).select(F.concat(F.lit("b"), "k").alias("board"), F.col("c_name").alias("company"), F.when(ck() % 11 == 0, "not json").otherwise(body).alias("body"))
    got = cards.as_cards(cards.board_cards(payloads, kind, ["design intern"]))
    return got.select("company", "title", "location", "url", "snippet", "sourceJobId", "workMode", "discoveryQuery", "source")


def board_greenhouse(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(ck() % 4 == 0, "Cook").otherwise("Junior Designer")
    body = F.concat(F.lit('{"jobs":[{"id":'), "k", F.lit(',"title":"'), title, F.lit('","location":{"name":"'), F.when(ck() % 3 == 0, "").otherwise("Milan"), F.lit('"},"absolute_url":"https://g.test/'), "k", F.lit('"}]}'))
    return _board(spark, d, "greenhouse", body)


def board_lever(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit('[{"id":"l'), "k", F.lit('","text":"Design '), "k", F.lit('","categories":{"location":"'), F.when(ck() % 3 == 0, "").otherwise("Rome"), F.lit('"},"workplaceType":"'), choice(ck(), ("on-site", "Remote", "unspecified")), F.lit('","hostedUrl":"https://l.test/'), "k", F.lit('"}]'))
    return _board(spark, d, "lever", body)


def board_ashby(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(
        F.lit('{"jobs":[{"id":"a'), "k", F.lit('","title":"'), choice(ck(), ("UX Intern", "Lead", "Stage UX")), F.lit('","location":"Berlin","isListed":'), F.when(ck() % 5 == 0, "false").otherwise("true"), F.lit(',"jobUrl":"'),
        F.when(ck() % 2 == 0, "https://a.test/x").otherwise(""), F.lit('","descriptionPlain":"'), F.repeat(F.lit("d"), (ck() % 7 * 100).cast("int")), F.lit('","workplaceType":"Hybrid"}]}'),
    )
    return _board(spark, d, "ashby", body).withColumn("snippet", F.length("snippet").cast("long").cast("string"))


def discover_union(spark: SparkSession, d: str) -> DataFrame:
    """Three sources: one whole, one cut, one that fails when it is read; the cards of each, and the reports."""
    c = _customers(spark, d).select(F.col("c_name").alias("title"), ck().alias("ord"), F.lit("x").alias("url"))
    bad = c.withColumn("title", F.raise_error(F.lit("unreachable")).cast("string"))
    found, report = cards.discover({"small": lambda: c.filter("ord <= 10").withColumn("source", F.lit("small")), "large": lambda: c.withColumn("source", F.lit("large")), "bad": lambda: bad}, cap=40)
    counts = found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("last"))
    said = spark.createDataFrame([(r["id"], r["status"], r["cards"]) for r in report], "source string, status string, cards long")
    return said.join(counts, "source", "left").select("source", "status", "cards", "n", "last")


def semicolon_files(spark: SparkSession, d: str) -> DataFrame:
    """Cells with separators, quotes and line ends, written and read again."""
    c = _customers(spark, d).select("k", F.concat_ws("|", F.concat(F.lit('"q" '), "c_name"), "c_mktsegment").alias("a"), F.concat(F.lit("x;y\n"), "k", F.lit("\t z ")).alias("b"))
    path = fresh(spark, "semicolon")
    files.write_semicolon(c, path, ["k", "a", "b"])
    return files.read_semicolon(spark, path, ("k", "a", "b")).select("k", "a", "b")


def _lines(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = fresh(spark, name)
    lines.toDF("value").write.text(path)
    return path


def _two_files(spark: SparkSession, d: str, line: Column, name: str, cut: int) -> str:
    """Lines of the customers up to ``cut`` in one file, written first, and of the others in another; each in the order of its keys."""
    path = fresh(spark, name)
    for i, part in enumerate((ck() <= cut, ck() > cut)):
        _customers(spark, d).filter(part).orderBy("c_custkey").coalesce(1).select(line.alias("value")).write.text(f"{path}/{i}")
    return f"{path}/*"


def tsv_files(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(ck() % 7 == 0, "").when(ck() % 7 == 1, F.concat(F.lit("[note] "), "k", F.lit("\tx"))).otherwise(F.concat("c_name", F.lit("\t"), "c_mktsegment", F.when(ck() % 2 == 0, "\r").otherwise("")))
    """Rows of two files with the lines on which they stand."""
    got = files.read_tsv(spark, _two_files(spark, d, line, "tsv", 40), ["name", "segment"])
    return got.select("name", "segment", F.regexp_extract("n.file", r"/(\d)/[^/]*$", 1).alias("file"), F.col("n.line").alias("line"))


def target_files(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(ck() % 5 == 0, "# skip").when(ck() % 5 == 1, "").when(ck() % 5 == 2, F.concat("c_name", F.lit("; https://t.test/"), "k")).otherwise(F.concat(F.lit("https://t.test/"), "k"))
    return files.read_targets(spark, _lines(spark, _customers(spark, d).select(line), "targets")).select("label", "url")


def aggregator_files(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(ck() % 5 == 0, "# skip").when(ck() % 5 == 1, F.concat("c_name", F.lit(" ; note; more"))).otherwise(F.col("c_mktsegment"))
    """Patterns of two files, and the line on which each stands first and last."""
    got = files.read_aggregators(spark, _two_files(spark, d, line, "aggregators", 40)).withColumn("at", F.struct(F.regexp_extract("entry_ord.file", r"/(\d)/[^/]*$", 1).alias("file"), F.col("entry_ord.line").alias("line")))
    ends = got.groupBy("pattern", "note").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("a"), F.max("at").alias("b"))
    return ends.select("pattern", "note", "n", F.col("a.file").alias("first_file"), F.col("a.line").alias("first_line"), F.col("b.file").alias("last_file"), F.col("b.line").alias("last_line"))


def log_files(spark: SparkSession, d: str) -> DataFrame:
    """A log of JSON lines, a fifth of them torn, that was added to once: what was added last counts, though its file is the larger."""
    key = lambda n: F.concat(F.lit('{"key":"k'), (ck() % n).cast("string"), F.lit('","cards":[{"title":"'), "c_mktsegment", F.lit('","url":"u'), "k")
    torn = F.when(ck() % 5 == 0, "").otherwise('"}]}')
    first = F.concat(key(70), torn)
    path = _lines(spark, _customers(spark, d).filter("c_custkey <= 60").orderBy("c_custkey").coalesce(1).select(first), "log")
    _customers(spark, d).filter("c_custkey > 60").orderBy("c_custkey").coalesce(1).select(first.alias("value")).write.mode("append").text(path)
    return files.read_log(spark, path).select("key", F.get("cards", 0)["title"].alias("title"), F.get("cards", 0)["url"].alias("url"), F.size("cards").cast("long").alias("n"))


def run_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of two batches, each written by several tasks: the place of every row, and which row of a key counts."""
    path = fresh(spark, "runlog")
    units = _customers(spark, d).select(F.concat(F.lit("u"), (ck() % 90).cast("string")).alias("key"), F.col("c_name").alias("title"), "c_custkey")
    runlog.append(units.filter("c_custkey <= 100").orderBy("c_custkey"), path)
    runlog.append(units.filter("c_custkey > 100").orderBy(F.desc("c_custkey")), path)
    log = runlog.read(spark, path, "key string, title string, c_custkey long")
    last = runlog.latest(log, "key").select("key", F.lit(True).alias("current"), "batch", "seq")
    return log.join(last, ["key", "batch", "seq"], "left").select("key", "title", "batch", "seq", F.coalesce("current", F.lit(False)).alias("current"))


def resumed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 20 units, read as a stream that is stopped after a batch of eight units and taken up again: each page once."""
    root, to = fresh(spark, "pages"), fresh(spark, "collected")
    place = Window.partitionBy("query", "place").orderBy("c_custkey")
    pages = _customers(spark, d).select(F.lower("c_mktsegment").alias("query"), F.concat(F.lit("p"), (F.col("c_nationkey") % 4).cast("string")).alias("place"), F.col("c_name").alias("html"), "c_custkey")
    pages.withColumn("page", F.row_number().over(place) - 1).drop("c_custkey").repartition("query", "place").write.partitionBy("query", "place").parquet(root)
    options = {"root": root, "queries": "automobile|building|furniture|household|machinery", "places": "p0|p1|p2|p3", "units_per_batch": "8", "lanes": "2"}
    paged.collect(spark, options, to, paged.StoredPages, batches=1)
    return paged.collect(spark, options, to, paged.StoredPages, resume=True)


def sidecar_rows(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d).select(F.concat(F.lit("https://S.test/"), (ck() % 40).cast("string"), F.lit("/?utm_x="), "k").alias("url"), F.col("c_name").alias("posted"), ck().alias("idx"))
    return files.sidecar(c, ("url", "posted")).select("url_norm", "posted")


def history_keys(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d).select(
        F.when(ck() % 9 == 0, "").otherwise(F.concat(F.lit("Firm "), (ck() % 60).cast("string"), F.lit(" S.p.A."))).alias(files.NAME),
        F.concat(F.lit("https://h.test/"), (ck() % 30).cast("string"), F.lit(" | https://h.test/b?trk=1")).alias("Job Links"), F.lit("Milano, Italia").alias("Locations"), F.lit("1. UX Stage — two seats\n2. Clerk").alias("Matching Job Titles"),
    )
    urls, keys = files.history(c)
    return urls.select("norm_company", F.col("url_norm").alias("value")).unionByName(keys.select("norm_company", F.col("role_key").alias("value")))


def text_cleaning(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d)
    return c.select(
        "c_custkey",
        normalize.strip_seat_suffix(F.concat("c_name", F.when(ck() % 2 == 0, " — 2 seats").otherwise("-x"))).alias("title"),
        normalize.decode_entities(F.concat("c_mktsegment", F.lit(" &amp; &lt;b&gt; &#233;&#x41; &amp;amp; &quot;"))).alias("decoded"),
        normalize.contains_quote(F.concat("c_name", F.lit("  and\n more")), F.when(ck() % 3 == 0, F.concat("c_name", F.lit(" and more"))).otherwise("and  less")).alias("quoted"),
        gates.match_query(choice(ck(), ("ux design", "of it", "customer")), F.concat(F.lit("A "), "c_name")).alias("matches"),
        registry.conflicts(F.when(ck() % 2 == 0, "").otherwise("01/02/2026"), choice(ck(), ("2026-02-01", "03/02/2026")), date=True).alias("conflict"),
    )


def _verdicts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = _customers(spark, d)
    found = c.filter(ck() % 10 != 0).select(F.col("k").alias("sourceJobId"), F.concat("c_name", F.lit(" | UX")).alias("title"), F.col("c_mktsegment").alias("company"), F.lit("Milan").alias("location"), F.concat(F.lit("https://p.test/"), "k").alias("url"), F.lit("portal").alias("source"))
    read = c.filter(ck() % 7 != 0).select(F.col("k").alias("sourceJobId"), F.concat(F.lit("Work on  "), "c_name").alias("desc"), (ck() % 4 == 0).alias("closedOnPage"))
    quote = F.when(ck() % 5 == 0, F.array(F.lit("absent"))).otherwise(F.array(F.concat(F.lit("Work on "), "c_name")))
    said = c.select("c_custkey", F.col("k").alias("id"), choice(ck(), ("pertinente", "adiacente", "escluso", "odd")).alias("label"), quote.alias("quotes"), F.when(ck() % 8 == 2, "").otherwise("far").alias("ground"), (ck() % 100).alias("score"))
    said = said.select("*", F.when(ck() % 6 == 1, F.concat(F.lit("https://own.test/"), "id")).alias("url"), F.lit("").alias("company"), F.lit("").alias("location"), choice(ck(), ("onsite", "", "hybrid")).alias("workMode"))
    said = said.select("*", F.lit(None).cast("boolean").alias("stageNature"), F.lit(None).cast("boolean").alias("applicationOpen"), F.when(ck() % 3 == 0, F.array(F.lit("en"))).alias("requiredLanguages"), F.lit(None).cast("string").alias("languageRequirement")).drop("c_custkey")
    return said.unionByName(said.filter("id = '5'")), found, read


def judged_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each verdict, and the cards that none speaks of."""
    said, found, read = _verdicts(spark, d)
    problems = publishing.judged(said, found, read).select("id", F.explode("problems").alias("problem"))
    silent = publishing.unresolved(found, said.filter("id <> '1'")).select(F.col("sourceJobId").alias("id"), F.col("reason").alias("problem"))
    return problems.unionByName(silent)


def new_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of included verdicts, but for excluded urls, with the defaults of what people own."""
    said, found, read = _verdicts(spark, d)
    out = found.filter("cast(sourceJobId as long) % 4 = 0").select(F.upper("url").alias("url"))
    roles = publishing.new_roles(publishing.judged(said.dropDuplicates(["id"]), found, read).filter("card is not null"), out)
    roles = publishing.new_company_values(roles)
    return roles.select("id", "label", "title", "company", "url", F.array_join("alternates", ",").alias("alternates"), "mode", F.col("`Outreach Decision`").alias("decision"))


def declared_fields(spark: SparkSession, d: str) -> DataFrame:
    said, found, read = _verdicts(spark, d)
    out = publishing.declared(publishing.judged(said.dropDuplicates(["id"]), found, read))
    return out.select("id", "company", "stageNature", "applicationOpen", F.array_join("requiredLanguages", ",").alias("languages"), "languageRequirement", "workMode")


def confirmed_steps(spark: SparkSession, d: str) -> DataFrame:
    """Two steps with a person between: the run waits, is confirmed with the token of what it made, and goes on."""
    path, c = fresh(spark, "steps"), _customers(spark, d)
    steps = {"judged": lambda _: c.filter(ck() % 3 == 0).select("c_custkey", F.upper("c_name").alias("name")), "built": lambda done: done["judged"].withColumn("built", F.length("name").cast("long"))}
    _, waits, word = workflow.run_steps(spark, path, steps, {})
    done, left, _ = workflow.run_steps(spark, path, steps, {waits: word})
    return done["built"].withColumn("waited_for", F.lit(waits)).withColumn("waits_for", F.lit(left).cast("string"))


def refused_rows(spark: SparkSession, d: str) -> DataFrame:
    """A writer that knew an old version is refused and its rows are kept aside; of four versions two stay."""
    path, c = fresh(spark, "kept"), _customers(spark, d).select("c_custkey", "c_name")
    for i in range(4):
        publishing.publish(c.filter(ck() % 4 <= i), path, i, keep=2)
    try:
        publishing.publish(c.filter(ck() % 10 == 0), path, 2, aside=True)
    except registry.Refused:
        held = spark.read.parquet(*publishing.refused(spark, path)).withColumn("what", F.lit("refused"))
        both = publishing.published(spark, path).withColumn("what", F.lit("published")).unionByName(held)
        return both.withColumn("versions", F.lit(",".join(map(str, publishing.versions(spark, path)))))
    raise AssertionError("an outdated writer was not refused")


def published_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two versions; a writer that knew only the first is refused, and the second is what is read."""
    path, c = fresh(spark, "published"), _customers(spark, d).select("c_custkey", "c_name")
    publishing.publish(c.limit(3), path)
    publishing.publish(c.withColumn("c_name", F.upper("c_name")), path, 1)
    try:
        publishing.publish(c.limit(1), path, 1)
    except registry.Refused:
        return publishing.published(spark, path)
    raise AssertionError("an outdated writer was not refused")


def exported_history(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d).select(F.col("c_name").alias("Name"), F.when(ck() % 2 == 0, F.col("c_mktsegment")).alias("Segment"), "k", F.lit("private").alias("Notes"))
    out = publishing.exported(registry.blanked(c, ["Notes"]), ["Name", "Segment", "Notes", "Absent"], "k")
    return out.select("k", F.col("Name").alias("name"), F.col("Segment").alias("segment"), F.col("Notes").alias("notes"), F.col("Absent").alias("absent"))


def first_reasons(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("error", "signup"), F.col("event_type")).alias("reason"))
    return publishing.first_reason(e, "user_id", "event_id", "reason").select("user_id", "reason")


def artifact_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Rows written in a folder per outcome, and read again."""
    path = fresh(spark, "artifacts")
    files.write_artifacts(_customers(spark, d).select("c_custkey", F.col("c_mktsegment").alias("outcome")), path)
    return spark.read.parquet(path).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


def _registry(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d)
    return c.select(
        F.when(ck() % 10 == 0, "").otherwise(F.concat(F.lit("Firm "), (ck() % 300).cast("string"), F.lit(" Srl"))).alias(workflow.NAME),
        choice(ck(), ("New job found", "Contacted", "Gone")).alias("Contact Search Status"), choice(ck(), ("Review", "Yes")).alias("Outreach Decision"), choice(ck(), ("To verify", "Blocked — x", "Odd", "")).alias("Verification Status"),
        F.when(ck() % 6 == 0, "31/02/2026").otherwise("01/02/2026").alias("Last Checked"), F.when(ck() % 3 == 0, F.col("c_name")).otherwise("").alias("Contact Name"),
        F.concat(F.lit("1. Role a"), "k", F.lit("\n2. Role b")).alias("Matching Job Titles"), F.concat(F.lit("https://r.test/"), "k").alias("Job Links"), F.lit("Milan").alias("Locations"), F.lit("90").alias("Matching Score"),
    )


def doctor_report(spark: SparkSession, d: str) -> DataFrame:
    return workflow.doctor(_registry(spark, d))


def typed_dates(spark: SparkSession, d: str) -> DataFrame:
    return workflow.typed_dates(_registry(spark, d)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def staged_roles(spark: SparkSession, d: str) -> DataFrame:
    """Staged leniently and published; an earlier review gives the contact where it is empty and one row has it."""
    c = _customers(spark, d)
    evidence = c.filter(ck() % 2 == 0).select(F.concat(F.lit("https://r.test/"), "k").alias("url_norm"), F.col("c_mktsegment").alias("posted"))
    checks = c.filter(ck() % 3 == 0).select(F.concat(F.lit("https://r.test/"), "k").alias("url_norm"), F.lit("seen").alias("status"))
    owned = c.filter(ck() % 300 < 50).filter("c_custkey < 300").select(F.concat(F.lit("FIRM "), "k").alias(workflow.NAME), F.concat(F.lit("Ms "), "k").alias("Contact Name"))
    path = fresh(spark, "stage")
    companies, _ = workflow.stage(_registry(spark, d), evidence, checks, owned, path, lenient=True)
    roles = publishing.published(spark, f"{path}/roles")
    named = publishing.published(spark, f"{path}/companies").select("company_key", F.col("`Contact Name`").alias("contact"), F.regexp_extract("`Job Links`", r"(\d+)$", 1).alias("k"))
    roles = roles.select(F.regexp_extract("url_norm", r"(\d+)$", 1).alias("k"), F.col("i").cast("long").alias("i"), "role_title", "posted", "check_status")
    return roles.join(named.drop("company_key"), "k")


def first_review(spark: SparkSession, d: str) -> DataFrame:
    """A first review, a second that is refused, and a third that is forced."""
    path, c = fresh(spark, "review"), _customers(spark, d).select(F.col("c_name").alias("Name"), "k")
    workflow.init_review(c.limit(5), ["Name"], path)
    try:
        workflow.init_review(c, ["Name"], path)
    except registry.Refused:
        workflow.init_review(c, ["k", "Name", "Recall"], path, force=True)
    return publishing.published(spark, path).select("k", F.col("Name").alias("name"), F.col("Recall").alias("recall"))


def read_fates(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d)
    postings = c.select(F.when(ck() % 10 == 0, "").otherwise(F.col("k")).alias("sourceJobId"))
    answers = c.filter(ck() % 4 != 0).select(F.col("k").alias("sourceJobId"), F.when(ck() % 5 == 0, " ").otherwise("text").alias("desc"), (ck() % 7 == 0).alias("gone"))
    return workflow.read_report(postings, c.filter(ck() % 6 == 1).select(F.col("k").alias("sourceJobId")), answers).groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


def carried_roles(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d)
    was = c.filter("c_custkey <= 100").select(ck().alias("role_id"), F.array((ck() % 30).cast("string"), F.concat(F.lit("x"), "k")).alias("urls"))
    now = c.filter("c_custkey > 100").filter(ck() % 30 < 10).select(ck().alias("role_id"), F.array((ck() % 30).cast("string")).alias("urls"))
    return workflow.carried_and_new(was, now).select("role_id", "carried")


def run_sets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct queries with their first place, sources that can't declare a work mode, and themes nobody has confirmed."""
    c = _customers(spark, d)
    queries = workflow.distinct_queries(c.select(F.concat(F.lit("q"), (ck() % 7).cast("string")).alias("query"), ck().alias("ord"))).select(F.lit("query").alias("what"), F.col("query").alias("value"), F.col("ord").alias("n"))
    silent = c.select(F.concat(F.lit("s"), (ck() % 5).cast("string")).alias("source"), F.when(ck() % 5 > 1, F.array(F.lit("ats"), F.lit("board"))).alias("undeclarable"))
    silent = workflow.undeclarable(silent).select(F.lit("undeclarable").alias("what"), F.col("source").alias("value"), F.lit(0).cast("long").alias("n"))
    themes = c.select(F.explode(workflow.unconfirmed(F.array("c_mktsegment", F.lit("UX")), ["UX", "BUILDING"])).alias("value"))
    return queries.unionByName(silent).unionByName(themes.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unconfirmed").alias("what"), "value", "n"))


def pooled_calls(spark: SparkSession, d: str) -> DataFrame:
    """A call for each customer, three at a time; every ninth raises."""
    c = _customers(spark, d).select("c_custkey", "c_name")
    return workflow.pooled(c, lambda r: r["c_name"].upper() if r["c_custkey"] % 9 else 1 / 0, 3).select("c_custkey", "answer", F.split_part("answer_error", F.lit(":"), F.lit(1)).alias("error"))


def drained_batch(spark: SparkSession, d: str) -> DataFrame:
    """What each source's stop left unsent, when three errors in a row stop it."""
    out = guard.drained(q_runs._responses(spark, d), max_429=10**9, max_errors=3)
    return out.groupBy("source").agg(F.count_if("sent").alias("sent"), F.count_if(~F.col("sent")).alias("unsent"))


_GEN = "(SELECT c_custkey, c_custkey AS ck, c_name, c_mktsegment, CAST(c_custkey AS VARCHAR) AS k FROM customer)"
_LABEL = "['pertinente', 'adiacente', 'escluso', 'odd'][CAST(ck % 4 AS INT) + 1]"
_ORG = f"(SELECT *, CASE WHEN ck % 10 = 0 THEN '' ELSE 'firm ' || (ck % 300) END AS name, ck % 3 = 2 AS s, ck % 4 = 2 AS v, ck % 6 = 0 AS d FROM {_GEN})"
SQL = {
    "guest_cards": f"""SELECT k AS "sourceJobId", c_name || ' & Co' AS title, c_mktsegment AS company, 'Milan, Italy' AS location, CASE WHEN ck % 2 = 1 THEN 'https://x.test/j/' || k ELSE 'https://www.linkedin.com/jobs/view/' || k || '/' END AS url,
      CASE WHEN ck % 3 = 1 THEN 'posted: ' || (ck % 9) || ' days ago' ELSE '' END AS snippet, CASE WHEN ck % 3 = 1 THEN (ck % 9) || ' days ago' END AS posted, 'q' || k AS "discoveryQuery" FROM {_GEN}""",
    "posting_pages": f"SELECT c_custkey, c_name || chr(10) || 'two <b> three ' || chr(10) || 'last' AS desc, ck % 4 = 0 AS closed FROM {_GEN}",
    "article_cards": f"""SELECT c_name AS title, CASE ck % 3 WHEN 0 THEN c_mktsegment || ' - Nazca srl' WHEN 1 THEN 'Torino' ELSE 'To verify' END AS company, CASE ck % 3 WHEN 0 THEN 'Milano (MI)' ELSE 'To verify' END AS location,
      'https://c.test/x' || CASE WHEN ck % 2 = 0 THEN '-' || k ELSE '' END AS url, CASE WHEN ck % 5 = 0 THEN 'pubblicato il 01/02/2026' ELSE '' END AS snippet, CASE WHEN ck % 2 = 0 THEN 'cerc:' || k END AS "sourceJobId" FROM {_GEN}""",
    "board_greenhouse": f"""SELECT c_name AS company, 'Junior Designer' AS title, CASE WHEN ck % 3 = 0 THEN 'To verify' ELSE 'Milan' END AS location, 'https://g.test/' || k AS url, '' AS snippet, k AS "sourceJobId", NULL::VARCHAR AS "workMode", 'ats:b' || k AS "discoveryQuery", 'employer' AS source FROM {_GEN} WHERE ck % 11 <> 0 AND ck % 4 <> 0""",
    "board_lever": f"""SELECT c_name AS company, 'Design ' || k AS title, CASE WHEN ck % 3 = 0 THEN 'To verify' ELSE 'Rome' END AS location, 'https://l.test/' || k AS url, '' AS snippet, 'l' || k AS "sourceJobId", CASE ck % 3 WHEN 0 THEN 'onsite' WHEN 1 THEN 'fully_remote' END AS "workMode", 'ats:b' || k AS "discoveryQuery", 'employer' AS source FROM {_GEN} WHERE ck % 11 <> 0""",
    "board_ashby": f"""SELECT c_name AS company, CASE ck % 3 WHEN 0 THEN 'UX Intern' ELSE 'Stage UX' END AS title, 'Berlin' AS location, CASE WHEN ck % 2 = 0 THEN 'https://a.test/x' ELSE 'https://jobs.ashbyhq.com/b' || k || '/a' || k END AS url, CAST(least(500, ck % 7 * 100) AS VARCHAR) AS snippet, 'ashby:a' || k AS "sourceJobId", 'hybrid' AS "workMode", 'ashby:b' || k AS "discoveryQuery", 'employer' AS source
      FROM {_GEN} WHERE ck % 11 <> 0 AND ck % 5 <> 0 AND ck % 3 <> 1""",
    "discover_union": """WITH c AS (SELECT 'small' AS source, c_custkey AS o FROM customer WHERE c_custkey <= 10 UNION ALL SELECT 'large', c_custkey FROM customer),
      n AS (SELECT source, count(*) AS all_, least(count(*), 40) AS n FROM c GROUP BY 1), r AS (SELECT source, o, row_number() OVER (PARTITION BY source ORDER BY o) AS i FROM c)
      SELECT n.source, CASE WHEN all_ > 40 THEN 'capped' ELSE 'ok' END AS status, n AS cards, n, max(o) FILTER (WHERE i <= 40) AS last FROM n JOIN r USING (source) GROUP BY n.source, all_, n UNION ALL SELECT 'bad', 'error', 0, NULL, NULL""",
    "semicolon_files": f"""SELECT k, '"q" ' || c_name || '|' || c_mktsegment AS a, 'x y ' || k || '  z' AS b FROM {_GEN}""",
    "tsv_files": f"""SELECT name, segment, file, line FROM (SELECT c_name AS name, c_mktsegment AS segment, CASE WHEN ck <= 40 THEN '0' ELSE '1' END AS file, row_number() OVER (PARTITION BY ck <= 40 ORDER BY ck) AS line, ck FROM {_GEN}) WHERE ck % 7 > 1""",
    "target_files": f"SELECT CASE WHEN ck % 5 = 2 THEN c_name ELSE '' END AS label, 'https://t.test/' || k AS url FROM {_GEN} WHERE ck % 5 > 1",
    "aggregator_files": f"""WITH l AS (SELECT CASE WHEN ck % 5 = 1 THEN c_name ELSE c_mktsegment END AS pattern, CASE WHEN ck % 5 = 1 THEN 'note; more' ELSE '' END AS note, CASE WHEN ck <= 40 THEN '0' ELSE '1' END AS file,
        row_number() OVER (PARTITION BY ck <= 40 ORDER BY ck) AS line, ck FROM {_GEN})
      SELECT pattern, note, count(*) AS n, arg_min(file, ck) AS first_file, arg_min(line, ck) AS first_line, arg_max(file, ck) AS last_file, arg_max(line, ck) AS last_line FROM l WHERE ck % 5 > 0 GROUP BY pattern, note""",
    "log_files": f"SELECT 'k' || (ck % 70) AS key, arg_max(c_mktsegment, ck) AS title, 'u' || max(ck) AS url, 1 AS n FROM {_GEN} WHERE ck % 5 <> 0 GROUP BY ck % 70",
    "run_log": """WITH r AS (SELECT 'u' || (c_custkey % 90) AS key, c_name AS title, CASE WHEN c_custkey <= 100 THEN 0 ELSE 1 END AS batch, row_number() OVER (PARTITION BY c_custkey <= 100 ORDER BY CASE WHEN c_custkey <= 100 THEN c_custkey ELSE -c_custkey END) - 1 AS seq FROM customer)
      SELECT key, title, CAST(batch AS BIGINT) AS batch, seq, row_number() OVER (PARTITION BY key ORDER BY batch DESC, seq DESC) = 1 AS current FROM r""",
    "resumed_pages": """WITH p AS (SELECT lower(c_mktsegment) AS query, 'p' || (c_nationkey % 4) AS place, CAST(row_number() OVER (PARTITION BY c_mktsegment, c_nationkey % 4 ORDER BY c_custkey) - 1 AS INT) AS page, c_name AS html, c_nationkey % 4 AS i FROM customer)
      SELECT query, place, page, html, ((list_position(['automobile', 'building', 'furniture', 'household', 'machinery'], query) - 1) * 4 + i) * 4294967296 + page AS ord FROM p""",
    "sidecar_rows": f"SELECT 'https://s.test/' || (ck % 40) AS url_norm, arg_max(c_name, ck) AS posted FROM {_GEN} GROUP BY 1",
    "history_keys": f"""WITH r AS (SELECT 'firm ' || (ck % 60) AS n, ck % 30 AS u FROM {_GEN} WHERE ck % 9 <> 0) SELECT DISTINCT n AS norm_company, unnest(['https://h.test/' || u, 'https://h.test/b', 'x:' || n || '|ux intern|milan', 'x:' || n || '|clerk|milan']) AS value FROM r""",
    "text_cleaning": f"""SELECT c_custkey, c_name || CASE WHEN ck % 2 = 0 THEN '' ELSE '-x' END AS title, c_mktsegment || ' & <b> éA &amp; "' AS decoded, ck % 3 = 0 AS quoted, ck % 3 = 2 AS matches, ck % 2 = 1 AS conflict FROM {_GEN}""",
    "judged_verdicts": f"""WITH v AS (SELECT *, {_LABEL} AS label FROM {_GEN}), w AS (SELECT * FROM v UNION ALL SELECT * FROM v WHERE ck = 5)
      SELECT k AS id, unnest(list_filter([CASE WHEN ck = 5 THEN 'verdict given twice: ' || k END, CASE WHEN ck % 10 = 0 THEN 'no such card: ' || k END, CASE WHEN label = 'odd' THEN 'unknown label: ' || k END, CASE WHEN ck % 4 < 2 AND ck % 7 = 0 THEN 'description not read: ' || k END,
        CASE WHEN ck % 4 < 2 AND (ck % 5 = 0 OR ck % 7 = 0) THEN 'quote not in the text: ' || k END, CASE WHEN label = 'escluso' AND ck % 8 = 2 THEN 'no ground given: ' || k END], lambda x: x IS NOT NULL)) AS problem FROM w UNION ALL SELECT '1', 'no verdict'""",
    "new_roles": f"""SELECT k AS id, {_LABEL} AS label, c_name || ' / UX' AS title, c_mktsegment AS company, CASE WHEN ck % 6 = 1 THEN 'https://own.test/' || k ELSE 'https://p.test/' || k END AS url, CASE WHEN ck % 6 = 1 THEN 'https://p.test/' || k ELSE '' END AS alternates,
      ['On-site (dichiarato)', 'Not stated', 'Hybrid (dichiarato)'][CAST(ck % 3 AS INT) + 1] AS mode, 'Review' AS decision FROM {_GEN} WHERE ck % 4 = 1 AND ck % 10 <> 0""",
    "declared_fields": f"""SELECT k AS id, CASE WHEN ck % 10 <> 0 THEN c_mktsegment END AS company, true AS "stageNature", NOT (ck % 7 <> 0 AND ck % 4 = 0) AS "applicationOpen", CASE WHEN ck % 3 = 0 THEN 'en' END AS languages, CASE WHEN ck % 3 = 0 THEN 'all' END AS "languageRequirement", CASE ck % 3 WHEN 0 THEN 'onsite' WHEN 2 THEN 'hybrid' END AS "workMode" FROM {_GEN} WHERE ck % 4 < 2""",
    "confirmed_steps": "SELECT c_custkey, upper(c_name) AS name, CAST(length(c_name) AS BIGINT) AS built, 'judged' AS waited_for, NULL::VARCHAR AS waits_for FROM customer WHERE c_custkey % 3 = 0",
    "refused_rows": "SELECT c_custkey, c_name, 'published' AS what, '3,4' AS versions FROM customer UNION ALL SELECT c_custkey, c_name, 'refused', '3,4' FROM customer WHERE c_custkey % 10 = 0",
    "published_versions": "SELECT c_custkey, upper(c_name) AS c_name FROM customer",
    "exported_history": f"SELECT k, c_name AS name, CASE WHEN ck % 2 = 0 THEN c_mktsegment ELSE '' END AS segment, '' AS notes, '' AS absent FROM {_GEN}",
    "first_reasons": "SELECT user_id, arg_min(event_type, event_id) AS reason FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1",
    "artifact_buckets": "SELECT c_mktsegment AS outcome, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1",
    "doctor_report": f"""WITH o AS (SELECT * FROM {_ORG}), t AS (SELECT name, count(*) AS m FROM o GROUP BY 1)
      SELECT unnest(['status', 'decision', 'verification', 'Last Checked', 'no name', 'name on several rows']) AS "check", unnest([(SELECT count(*) FROM o WHERE s), 0, (SELECT count(*) FROM o WHERE v), (SELECT count(*) FROM o WHERE d), (SELECT count(*) FROM o WHERE name = ''), (SELECT CAST(coalesce(sum(m), 0) AS BIGINT) FROM t WHERE m > 1 AND name <> '')]) AS n""",
    "typed_dates": f"""SELECT 'Last Checked' AS "column", '31/02/2026' AS value, count(*) AS n FROM {_ORG} WHERE d""",
    "staged_roles": f"""SELECT k, i AS i, CASE i WHEN 0 THEN 'Role a' || k ELSE 'Role b' END AS role_title, CASE WHEN ck % 2 = 0 THEN c_mktsegment END AS posted, CASE WHEN ck % 3 = 0 THEN 'seen' END AS check_status,
      CASE WHEN ck % 3 = 0 THEN c_name WHEN ck % 10 <> 0 AND ck % 300 BETWEEN 1 AND 49 THEN 'Ms ' || (ck % 300) ELSE '' END AS contact FROM {_GEN}, (VALUES (0), (1)) r(i)""",
    "first_review": f"SELECT k, c_name AS name, '' AS recall FROM {_GEN}",
    "read_fates": f"SELECT CASE WHEN ck % 10 = 0 THEN 'withoutId' WHEN ck % 6 = 1 THEN 'alreadyRead' WHEN ck % 4 = 0 THEN 'unread' WHEN ck % 7 = 0 THEN 'gone' WHEN ck % 5 = 0 THEN 'empty' ELSE 'read' END AS fate, count(*) AS n FROM {_GEN} GROUP BY 1",
    "carried_roles": f"SELECT c_custkey AS role_id, ck <= 100 AS carried FROM {_GEN} WHERE CASE WHEN ck <= 100 THEN ck % 30 NOT IN (SELECT c_custkey % 30 FROM customer WHERE c_custkey > 100 AND c_custkey % 30 < 10) ELSE ck % 30 < 10 END",
    "run_sets": f"""SELECT 'query' AS what, 'q' || (ck % 7) AS value, min(ck) AS n FROM {_GEN} GROUP BY ALL UNION ALL SELECT 'undeclarable', unnest(['s0', 's1', 'ats', 'board']), 0
      UNION ALL SELECT 'unconfirmed', 'UX', count(*) FROM customer UNION ALL SELECT 'unconfirmed', 'BUILDING', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' HAVING count(*) > 0""",
    "pooled_calls": "SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN upper(c_name) END AS answer, CASE WHEN c_custkey % 9 = 0 THEN 'ZeroDivisionError' END AS error FROM customer",
    "drained_batch": f"""WITH i AS (SELECT *, sum((outcome = 'ok')::INT) OVER (PARTITION BY source ORDER BY seq) AS island FROM {q_runs._RESP}), s AS (SELECT *, sum((outcome = 'error')::INT) OVER (PARTITION BY source, island ORDER BY seq) AS streak FROM i),
      stop AS (SELECT source, min(seq) FILTER (WHERE streak >= 3) AS last FROM s GROUP BY 1) SELECT source, count(*) FILTER (WHERE last IS NULL OR seq <= last) AS sent, count(*) FILTER (WHERE seq > last) AS unsent FROM s JOIN stop USING (source) GROUP BY 1""",
}

QUERIES = [
    guest_cards, posting_pages, article_cards, board_greenhouse, board_lever, board_ashby, discover_union, semicolon_files, tsv_files, target_files, aggregator_files, log_files, run_log, resumed_pages, sidecar_rows, history_keys, text_cleaning,
    judged_verdicts, new_roles, declared_fields, published_versions, confirmed_steps, refused_rows, exported_history, first_reasons, artifact_buckets, doctor_report, typed_dates, staged_roles, first_review, read_fates, carried_roles, run_sets, pooled_calls, drained_batch,
]
