"""Queries of the operators on facts, phrases, shares, records and deliveries, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import phrases, signals
from ..functions import text as T
from ..operators import delivery, focus, html, quality, ranks, records, rules, tables
from ..operators.skew import join_counted
from ..sources.tables import table
from . import reference_queries as R

#: Parameters of the queries.
FOCUS_RULES = (
    ("freight", 10, r"freight|cold-chain|pallet", "*", "core", "freight and storage", "companies that ship goods"),
    ("people", 20, r"payroll|reception cover|mailroom", "service;audience;positioning", "core", "staffing for offices", "offices short of staff"),
    ("food", 20, r"bakery|smoked|tinned|allergen", "product;service", "secondary", "food supply", "kitchens and shops"),
    ("legal", 30, r"lease reviews|dispute|handbooks", "*", "exclude", "legal advice", "companies in disputes"),
    ("print", 40, r"label printing|cartons|pouches", "product;specialism", "secondary", "packaging and labels", "brands with goods to pack"),
)
ANGLES = (("goods", ("product",)), ("open-a", ("*",)), ("people", ("audience", "service")), ("open-b", ("*", "positioning")))
PERSONA_TEMPLATES = (("t1", ("Finance lead", "Owner")), ("t2", ("*",)), ("t3", ("Owner", "Operations lead")), ("t4", ("*",)))
STATUS_CLASSES = (("qualified", ("valid", "verified")), ("review", ("catch all", "unknown")), ("excluded", ("bounced",)))
SHARE_LIMITS = {"department": 0.12, "title": 0.004, "source": 0.2}
APPROVED = ["company_description", "job_title", "job_department"]
SAMPLES = 25

Query = Callable[[SparkSession, str], DataFrame]


def _rules(spark):
    rows = [(i, *r) for i, r in enumerate(FOCUS_RULES)]
    return focus.read_focus_rules(spark.createDataFrame(rows, "position int, id string, priority int, pattern string, signal_types string, fit_tier string, focus string, buyer_phrase string"))


def _signals(spark, d, *columns):
    return table(spark, d, "site_signals", ["signal_id", *columns])


def focus_rule_match(spark, d):
    found = _rules(spark)
    s = _signals(spark, d, "signal_type", "focus", "evidence").where("focus IS NOT NULL")
    index = focus.first_focus_rule(F.col("signal_type"), F.col("focus"), F.col("evidence"), found)
    ids = F.array(*[F.lit(r.rule_id) for r in found])
    return s.select("signal_id", F.get(ids, index).alias("rule_id"))


def focus_resolve(spark, d):
    leads = R._domains(spark, d, "company_name").where("domain <> ''")
    company = tables.first_per_key(leads.where("company_name IS NOT NULL"), "domain", F.col("row_idx"), ["company_name"])
    s = _signals(spark, d, "domain", "signal_type", "focus", "evidence").where("focus IS NOT NULL").join(company, "domain", "left")
    return focus.resolved(s, _rules(spark)).select("signal_id", "resolved.*")


def signal_normalize(spark, d):
    texts = _signals(spark, d, "observation").where("observation IS NOT NULL").select("signal_id", F.col("observation").alias("text"))
    return signals.with_company_signal(texts, "text").select("signal_id", "signal.*")


def evidence_signals(spark, d):
    texts = _signals(spark, d, "evidence").where("evidence IS NOT NULL").select("signal_id", F.posexplode(F.split("evidence", "\n")).alias("line_no", "line"))
    return signals.with_company_signal(texts, "line").select("signal_id", "line_no", "signal.*")


def clause_shorten(spark, d):
    return _signals(spark, d, "evidence").where("evidence IS NOT NULL").select("signal_id", signals.shortened_clause(F.col("evidence"), 8).alias("clause"))


def phrase_shorten(spark, d):
    return R._leads(spark, d, "company_description").where("company_description IS NOT NULL").select("row_idx", signals.shortened(T.plain(F.col("company_description")), 5).alias("short"))


def generic_focus(spark, d):
    s = _signals(spark, d, "evidence").where("evidence IS NOT NULL").select("signal_id", F.get(F.split("evidence", "\n"), F.lit(0)).alias("line"))
    made = s.select("signal_id", phrases.generic_focus(F.col("line"), 6).alias("f"))
    return made.select("signal_id", "f.value", "f.error")


def phrase_checks(spark, d):
    s = _signals(spark, d, "focus", "signal_type", "observation").where("focus IS NOT NULL")
    return s.select("signal_id", phrases.phrase_flaw(F.col("observation"), 6).alias("flaw"), phrases.focus_flaw(F.lit(None).cast("string"), F.lower("focus")).alias("focus_flaw"), phrases.buyer_phrase(F.col("signal_type"), F.lower("focus"), 5).alias("buyer"), phrases.has_long_dash(F.col("observation")).alias("dash"))


def plain_text(spark, d):
    return table(spark, d, "fetch_results", ["fetch_id", "body"]).where("body IS NOT NULL").select("fetch_id", F.length(signals.plain_text(F.col("body"))).cast("long").alias("length"))


def text_counts(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", T.word_total(F.col("text")).cast("long").alias("n_words"), F.length(T.tidy(F.col("text"))).cast("long").alias("tidy_length"))


def digest_column(spark, d):
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 1500).alias("digest"))


def first_domain(spark, d):
    leads = R._leads(spark, d, "email", "website")
    given = F.nullif(T.domain_of(F.regexp_extract(F.coalesce("email", F.lit("")), "@([^@]+)$", 1)), F.lit(""))
    return leads.select("row_idx", F.coalesce(given, F.nullif(T.domain_of(F.col("website")), F.lit("")), F.lit("")).alias("domain"))


def angle_choice(spark, d):
    return _signals(spark, d, "signal_type").select("signal_id", records.listed(F.col("signal_type"), list(ANGLES), last_open=True).alias("angle"))


def persona_templates(spark, d):
    found = rules.with_rule(R._leads(spark, d, "job_title").where("job_title IS NOT NULL"), F.col("job_title"), R._rules(spark, d), ["persona", "hook"])
    return found.select("row_idx", F.array_join(records.all_listed(F.coalesce("persona", F.lit("")), list(PERSONA_TEMPLATES)), ",").alias("templates"))


def status_class(spark, d):
    label = F.coalesce(T.label_key(F.col("email_status")), F.lit(""))
    return R._leads(spark, d, "email_status").select("row_idx", F.coalesce(records.listed(label, list(STATUS_CLASSES)), F.lit("review")).alias("class"))


def _graded(spark, d):
    """Leads with ranks of their fitness: e-mail, company, contact, copy, and their sum's class."""
    leads = R._domains(spark, d, "email", "email_status", "first_name", "job_title", "job_seniority")
    label = F.coalesce(T.label_key(F.col("email_status")), F.lit(""))
    ranked = F.coalesce(records.listed(label, [("2", ("valid", "verified")), ("0", ("bounced",))]), F.lit("1")).cast("int")
    mail = F.when(T.email_syntax_ok(F.col("email")), ranked).otherwise(0)
    company = F.when(F.col("domain") != "", 2).otherwise(1)
    title = F.coalesce(rules.first_rule(F.col("job_title"), R._rules(spark, d)), F.lit(9999))
    contact = F.when(F.coalesce(F.trim("job_title"), F.lit("")) == "", 0).when(title < 30, 2).otherwise(1)
    copy = F.when(T.given_name(F.coalesce("first_name", F.lit(""))) != "", 2).otherwise(0)
    held = leads.withColumns({"key": F.coalesce(T.email_key(F.col("email")), F.lit("")), "mail": mail, "company": company, "contact": contact, "copy": copy, "title": title})
    least = F.least("mail", "company", "contact", "copy")
    return held.withColumn("outreach", F.when(least == 2, 3).when(least == 1, 2).otherwise(1))


def dedupe_by_fit(spark, d):
    best = F.struct("outreach", "mail", "company", "contact", "copy", -F.col("row_idx"))
    found = tables.with_winner(_graded(spark, d).withColumn("key", F.nullif("key", F.lit(""))), "key", best)
    return found.select("row_idx", "key", "winner", "copies")


def contact_sequencing(spark, d):
    leads = _graded(spark, d).where("domain <> '' AND outreach >= 2 AND copy > 0")
    seniority = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("Founder/Owner", "C-Suite", "Vice President", "Director", "Manager", "Senior", "entry"))), F.col("job_seniority")).cast("int"), F.lit(0)), F.lit(99))
    held = leads.withColumn("seniority", seniority)
    order = [-F.col("outreach"), -F.col("contact"), -F.col("mail"), -F.col("company"), -F.col("copy"), F.col("title"), F.col("seniority")]
    out = ranks.ranked(held, ["domain"], [*order, ranks.range_bucket(R._leads(spark, d), "row_idx")], [F.col("row_idx")], out="contact_rank", size="contact_count")
    return out.select("row_idx", "domain", "contact_rank", "contact_count", F.when(F.col("contact_rank") == 1, "primary").otherwise("later-wave").alias("status"))


def _facts_by_row(spark, d):
    """Each lead row with the candidates of its domain's website and its own fields, resolved."""
    kinds = "array<struct<at:int,source:string,confidence:double,rule_id:string,priority:int,tier:string>>"
    found = _rules(spark)
    s = _signals(spark, d, "domain", "status", "signal_type", "focus", "evidence", "confidence")
    best = tables.first_per_key(s, "domain", F.struct((-F.col("confidence")).alias("c"), F.col("signal_id").alias("i")), ["status", "signal_type", "focus", "evidence", "confidence"])
    leads = R._domains(spark, d, *APPROVED).join(best, "domain", "left")

    def candidate(at, source, confidence, kind, focus_text, evidence):
        i = focus.first_focus_rule(kind, focus_text, evidence, found)
        pick = lambda values, other: F.coalesce(F.get(F.array(*map(F.lit, values)), i), F.lit(other))
        return F.struct(F.lit(at).alias("at"), F.lit(source).alias("source"), confidence.alias("confidence"), pick([r.rule_id for r in found], focus.GENERIC).alias("rule_id"), pick([r.priority for r in found], focus.GENERIC_PRIORITY).alias("priority"), pick([r.tier for r in found], "exclude").alias("tier"))

    site = F.when((F.col("status") == "ok") & F.col("focus").isNotNull(), candidate(0, "website", F.col("confidence"), F.col("signal_type"), F.col("focus"), F.col("evidence")))
    fields = [F.when(F.coalesce(F.trim(c), F.lit("")) != "", candidate(i + 1, f"input:{c}", F.lit(0.5), F.lit("service"), F.col(c), F.lit(None).cast("string"))) for i, c in enumerate(APPROVED)]
    return leads.select("row_idx", "status", F.array_compact(F.array(site, *fields)).cast(kinds).alias("candidates"))


def candidate_selection(spark, d):
    rows = _facts_by_row(spark, d)
    pick = focus.chosen(F.col("candidates"), F.col("status").isin("ok", "no_signal"), APPROVED, 2)
    return rows.withColumn("c", pick).select("row_idx", F.col("c.candidate.source").alias("source"), F.col("c.candidate.rule_id").alias("rule_id"), F.array_join("c.fields", ",").alias("fields"))


def corroborated_rules(spark, d):
    each = _facts_by_row(spark, d).select("row_idx", F.inline("candidates")).where("source LIKE 'input:%' AND tier <> 'exclude'")
    return focus.corroborated(each, "row_idx", 2)


def focus_gaps(spark, d):
    index = focus.first_focus_rule(F.col("signal_type"), F.col("focus"), F.col("evidence"), _rules(spark))
    tiers = F.array(*[F.lit(r.tier) for r in _rules(spark)])
    s = _signals(spark, d, "domain", "signal_type", "focus", "evidence").where("focus IS NOT NULL").withColumn("tier", F.coalesce(F.get(tiers, index), F.lit("unmatched")))
    first = tables.first_per_key(s, "domain", F.col("signal_id"), ["signal_id", "tier"])
    sets = first.where("tier IN ('unmatched', 'exclude')")
    counted = sets.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    # The first samples of each set: rows beyond them are dropped before the shuffle (top-k of a window).
    place = F.row_number().over(Window.partitionBy("tier").orderBy("signal_id"))
    return sets.withColumn("k", place).where(F.col("k") <= SAMPLES).join(F.broadcast(counted), "tier").select("tier", "n", "k", "signal_id", "domain")


def _values(spark, d):
    leads = R._domains(spark, d, "job_department", "job_title", "list_source")
    return quality.representatives(leads, "domain", "row_idx", {"department": F.col("job_department"), "title": F.col("job_title"), "source": F.col("list_source")}).withColumnRenamed("domain", "key")


def batch_shares(spark, d):
    shares = quality.value_shares(_values(spark, d), "key", SHARE_LIMITS)
    return shares.where("over").select("kind", "value", "n", "allowed", F.round(F.col("n") / F.col("total"), 4).alias("share")).orderBy("kind", "value")


def quality_flags(spark, d):
    keys = _values(spark, d)
    over = quality.overflow_keys(keys, "key", {k: k for k in SHARE_LIMITS}, quality.value_shares(keys, "key", SHARE_LIMITS))
    rows = R._domains(spark, d).where("domain <> ''").withColumnRenamed("domain", "key")
    return quality.flagged(rows, "key", over, list(SHARE_LIMITS)).select("row_idx", "flags")


def exact_pitch_capacity(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "text", "source", "company_domain"]).where("text IS NOT NULL AND company_domain IS NOT NULL")
    first = tables.first_per_key(docs.select("doc_id", F.col("company_domain").alias("key"), T.opening_words(F.col("text"), 2).alias("pitch"), F.coalesce("source", F.lit("")).alias("angle")), "key", F.col("doc_id"), ["pitch", "angle"])
    return quality.pitch_capacity(first, "pitch", "angle", {"mail": 4, "note": 2}, 0.01).where("over").select("value", "n", "allowed")


def evidence_choice(spark, d):
    s = _signals(spark, d, "status", "observation", "evidence", "facts")
    texts = F.transform("facts", lambda f: f["evidence"])
    return s.select("signal_id", F.length(records.evidence_text(F.col("status"), F.col("observation"), F.col("evidence"), texts)).cast("long").alias("length"))


def homepage_choice(spark, d):
    pages = table(spark, d, "fetch_results", ["fetch_id", "url", "status_code", "body", "provider"]).withColumn("domain", T.domain_of(F.col("url")))
    kind = F.when(F.col("url").startswith("https://www."), 2).when(F.col("url").startswith("https://"), 1).otherwise(3)
    number = kind + F.when(F.col("provider") == "firecrawl", 3).otherwise(0)
    good = F.coalesce(F.col("status_code").between(200, 299) & (F.trim("body") != ""), F.lit(False))
    number = (number * F.lit(10**12) + F.col("fetch_id")).cast("long")
    return records.first_success(pages, "domain", number, good, ["fetch_id"]).select("domain", "fetch_id", "found")


def decision_match(spark, d):
    s = _signals(spark, d, "domain", "focus", "status")
    return records.matched(R.distinct_domains(spark, d), s, "domain", "signal_id", ["focus", "status"]).select("domain", "focus", "status", "error")


def resume_pending(spark, d):
    done = _signals(spark, d, "domain", "status").where("status = 'ok'").select("domain").distinct()
    return R.distinct_domains(spark, d).join(done, "domain", "left_anti").select("domain")


def facts_json(spark, d):
    s = _signals(spark, d, "facts").where("size(facts) > 0")
    rest = F.filter("facts", lambda f: ~f.eqNullSafe(F.get("facts", F.lit(0))))
    chosen = F.slice(F.concat(F.slice("facts", 1, 1), rest), 1, 3)
    return s.select("signal_id", F.size(rest).cast("long").alias("others"), F.to_json(F.transform(chosen, lambda f: F.struct(f["focus"].alias("focus"), f["evidence"].alias("evidence"))), {"ignoreNullFields": "false"}).alias("facts"))


def record_json(spark, d):
    s = _signals(spark, d, "status", "focus", "pages_fetched")
    text = F.when(F.col("signal_id") % 5 == 0, F.lit("[1, 2]")).when(F.col("signal_id") % 5 == 1, F.lit("{broken")).otherwise(F.to_json(F.struct("status", "focus", "pages_fetched")))
    back = s.select("signal_id", records.parsed_records(text, "status string, focus string, pages_fetched int", ["status"]).alias("r"))
    return back.select("signal_id", F.col("r").isNotNull().alias("parsed"), F.coalesce("r.focus", F.lit("")).alias("focus"), F.coalesce("r.pages_fetched", F.lit(0)).alias("pages"))


def context_map(spark, d):
    leads = R._domains(spark, d, "job_title").select("row_idx", F.col("website").alias("Web Site"), F.col("job_title").alias("Title"), "domain")
    made = records.context(leads, {"domain": F.concat(F.lit("https://"), "domain"), "title": F.upper("Title")})
    return made.select("row_idx", F.array_join(F.array_sort(F.map_keys("context")), ",").alias("names"), F.element_at("context", "title").alias("title"), F.element_at("context", "web_site").alias("site"), F.element_at("context", "domain").alias("domain"))


def cache_keys(spark, d):
    s = _signals(spark, d, "domain", "focus", "evidence")
    return s.select("signal_id", records.cache_key([F.lit("v1"), F.col("domain")], {"focus": F.col("focus"), "evidence": F.col("evidence")}).alias("key"))


def number_text(spark, d):
    e = table(spark, d, "events", ["event_id", "value"])
    return e.select("event_id", records.two_decimals(F.col("value")).alias("text"), records.clamped(F.col("value") / 100).alias("share"))


def usage_sums(spark, d):
    s = _signals(spark, d, "domain", "pages_fetched", "http_cache_hits", "signal_cache_hit")
    rows = s.agg(F.sum("pages_fetched").alias("pages"), F.sum("http_cache_hits").alias("hits"), F.count_if("signal_cache_hit").alias("cached"), F.count("domain").alias("rows"))
    domains = s.where("domain IS NOT NULL").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("domains")).scalar()
    return rows.select("pages", "hits", "cached", (F.col("rows") - domains).alias("avoided"))


def cohort_counts(spark, d):
    pages = R.pool_balanced_variants(spark, d)
    return pages.groupBy("pool", "variant").agg(F.count(F.lit(1)).alias("companies"))


def usage_totals(spark, d):
    e = table(spark, d, "events", ["event_type", "value"])
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("value") > 50).alias("large"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("hundredths"))


def blocked_evidence(spark, d):
    s = _signals(spark, d, "evidence").where("evidence IS NOT NULL")
    return s.where(T.first_phrase(F.col("evidence"), ("cookies", "accept all", "all rights reserved")) == "").select("signal_id")


def focus_errors(spark, d):
    """The first three distinct errors of each domain's facts."""
    found = focus_resolve(spark, d).where("error <> ''").join(_signals(spark, d, "domain"), "signal_id")
    first = found.groupBy("domain", "error").agg(F.min("signal_id").alias("at"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy("at"))
    few = first.withColumn("k", place).where("k <= 3")
    return few.groupBy("domain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "error"))), lambda x: x["error"]), "; ").alias("errors"))


def assigned_variants(spark, d):
    """The variant of a row's company, for every row."""
    variants = R.balanced_variants(spark, d)
    return join_counted(R._domains(spark, d).where("domain <> ''"), variants, "domain").select("row_idx", "variant")


def delivery_ledger(spark, d):
    leads = R._domains(spark, d, "email", "first_name", "company_name").withColumn("key", F.nullif(T.email_key(F.col("email")), F.lit("")))
    held = leads.withColumn("domain", F.nullif("domain", F.lit("")))
    return delivery.ledger(held, "row_idx", "key", "domain", ["first_name", "company_name"])


def copy_review_queue(spark, d):
    """Of the delivered rows, the first of each combination of department, persona and source."""
    ledger = delivery_ledger(spark, d).where("status = 'included'").select("row_idx")
    leads = rules.with_rule(R._leads(spark, d, "job_title", "job_department", "list_source"), F.col("job_title"), R._rules(spark, d), ["persona", "hook"])
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("job_department", "persona", "list_source")]
    return leads.join(ledger, "row_idx").groupBy(*keys).agg(F.min("row_idx").alias("row_idx"))


def ready_rows(spark, d):
    return _graded(spark, d).where("outreach = 3").select("row_idx")


def domain_top_facts(spark, d):
    """The three best facts of each domain's pages: the best sentence, the best paragraph, then the others; no focus twice."""
    pages = R._pages(spark, d)
    told = html.with_candidates(pages, out="cands").select("domain", "fetch_id", F.inline("cands"))
    told = signals.with_company_signal(told, "text").select("domain", "kind", F.lower("signal.focus").alias("fk"), F.struct((-F.col("score")).alias("s"), F.length("text").alias("l"), "fetch_id", "place", F.col("signal.focus").alias("focus"), "text").alias("key"))
    each = told.groupBy("domain", "fk").agg(F.min("key").alias("any"), F.min(F.when(F.col("kind") == "paragraph", F.col("key"))).alias("par"))
    first = each.groupBy("domain").agg(F.min("any").alias("b"), F.min("par").alias("p"))
    forced = first.select("domain", F.inline(F.array(F.struct(F.lit(0).alias("turn"), F.col("b").alias("key")), F.struct(F.lit(1).alias("turn"), F.col("p").alias("key"))))).where("key IS NOT NULL")
    every = forced.unionByName(each.select("domain", F.lit(2).alias("turn"), F.col("any").alias("key"))).where("key.focus <> ''")
    once_each = every.groupBy("domain", F.lower("key.focus").alias("fk")).agg(F.min(F.struct("turn", "key")).alias("r"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy("r"))  # only three rows of a domain per task are shuffled
    return once_each.withColumn("rank", place).where("rank <= 3").select("domain", "rank", "r.key.focus", F.col("r.key.text").alias("evidence"), F.round(-F.col("r.key.s"), 2).alias("confidence"))


def row_facts(spark, d):
    """The facts that a row's own fields state: each field with more than a placeholder, in order; no (focus, evidence) twice."""
    cells = tables.unpivoted(table(spark, d, "leads", ["row_idx", *[f for f, _ in R.FIELDS]]), "row_idx", R.FIELDS)
    told = signals.with_company_signal(cells, "value").where("signal.focus <> ''")
    row = F.struct("pos", "header", "confidence", F.col("signal.signal_type").alias("signal_type"), F.col("signal.focus").alias("focus"))
    first = told.groupBy("row_idx", F.lower("signal.focus").alias("fk"), F.lower("value").alias("ek")).agg(F.min(row).alias("r"))
    return first.select("row_idx", "r.header", "r.confidence", "r.signal_type", "r.focus")


def primary_fact(spark, d):
    """A signal's first fact, else one derived from its evidence or observation; its own fields come first."""
    s = _signals(spark, d, "signal_type", "focus", "observation", "evidence", "facts")
    text = F.coalesce(F.nullif("evidence", F.lit("")), "observation", F.lit(""))
    held = signals.with_company_signal(s.withColumn("_t", F.get(F.split(text, "\n"), F.lit(0))), "_t", "_s")
    first = F.get("facts", F.lit(0))
    own = lambda name: F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(f"_s.{name}"))
    there = first.isNotNull()
    return held.select("signal_id", F.when(there, first["signal_type"]).otherwise(own("signal_type")).alias("signal_type"), F.when(there, first["focus"]).otherwise(own("focus")).alias("focus"))


def _home(spark, d):
    pages = table(spark, d, "fetch_results", ["fetch_id", "url", "final_url", "body", "status_code", "provider"]).withColumn("domain", T.domain_of(F.col("url")))
    good = F.coalesce(F.col("status_code").between(200, 299) & (F.trim("body") != ""), F.lit(False))
    return pages, good


def site_status(spark, d):
    """What a domain's pages come to: ``fetch_error``, ``redirect_mismatch``, ``no_signal`` or ``ok``."""
    pages, good = _home(spark, d)
    home = records.first_success(pages, "domain", F.col("fetch_id"), good, ["final_url"])
    some = html.with_candidates(html.with_page(pages.where(good)), out="c").where("size(c) > 0").select("domain").distinct().withColumn("some", F.lit(True))
    same = T.same_site(F.col("domain"), T.domain_of(F.col("final_url")))
    status = F.when(~F.col("found"), "fetch_error").when(~same, "redirect_mismatch").when(F.col("some").isNull(), "no_signal").otherwise("ok")
    return home.join(some, "domain", "left").select("domain", status.alias("status"))


def rendered_choice(spark, d):
    """Whether the rendered page of a domain is preferred: the direct one scores below 0.86, and less than the rendered one."""
    pages, good = _home(spark, d)
    told = html.with_candidates(html.with_page(pages.where(good)), out="c").select("domain", "provider", F.coalesce(F.array_max(F.transform("c", lambda x: x["score"])), F.lit(0.0)).alias("score"))
    best = told.groupBy("domain").agg(F.max(F.when(F.col("provider") != "firecrawl", F.col("score"))).alias("direct"), F.max(F.when(F.col("provider") == "firecrawl", F.col("score"))).alias("rendered"))
    return best.select("domain", "direct", "rendered", (F.col("rendered").isNotNull() & (F.coalesce("direct", F.lit(0.0)) < 0.86) & (F.col("rendered") > F.coalesce("direct", F.lit(0.0)))).alias("use_rendered"))


def row_fingerprint(spark, d):
    """A hash of what a row says, whatever the names and the order of its columns elsewhere; blank and NULL alike."""
    leads = R._leads(spark, d, "email", "company_name", "website")
    return leads.select("row_idx", F.sha2(F.concat_ws("\x1f", *[F.concat(F.lit(f"{c}="), F.coalesce(T.stripped(F.col(c)), F.lit(""))) for c in ("company_name", "email", "website")]), 256).alias("fingerprint"))


def unfenced(spark, d):
    """Texts without code fences around them."""
    text = F.concat(F.lit("```json\n"), "focus", F.lit("\n```"))
    return _signals(spark, d, "focus").where("focus IS NOT NULL").select("signal_id", T.unfenced(F.when(F.col("signal_id") % 2 == 0, text).otherwise(F.col("focus"))).alias("text"))


def replay_join(spark, d):
    """Jobs joined back to their rows by number; a job without its row, and a row without a job, are kept apart by ``found``."""
    jobs = _signals(spark, d, "status").select((F.col("signal_id") * 3).alias("row_idx"), "status")
    return jobs.join(R._leads(spark, d, "email"), "row_idx", "left").select("row_idx", "status", F.col("email").isNotNull().alias("found"))


def queries() -> dict[str, Query]:
    every = (
        focus_rule_match, focus_resolve, signal_normalize, evidence_signals, clause_shorten, phrase_shorten, generic_focus, phrase_checks, plain_text, text_counts, digest_column, first_domain,
        angle_choice, persona_templates, status_class, dedupe_by_fit, contact_sequencing, candidate_selection, corroborated_rules, focus_gaps, batch_shares, quality_flags, exact_pitch_capacity,
        evidence_choice, homepage_choice, decision_match, resume_pending, facts_json, record_json, context_map, cache_keys, number_text, usage_sums, cohort_counts, usage_totals, blocked_evidence,
        focus_errors, assigned_variants, delivery_ledger, copy_review_queue, ready_rows, domain_top_facts, row_facts, primary_fact, site_status, rendered_choice, row_fingerprint, unfenced, replay_join,
    )
    return {f.__name__: f for f in every}
