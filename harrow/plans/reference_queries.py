"""One query for each data-processing operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import sha_mod
from ..operators import delivery, html, ranks, rules, tables
from ..operators.skew import join_counted
from ..sources.tables import spread, table

#: Parameters of the queries.
VARIANTS = 5
TTL_HOURS = 168
BUDGET_MICROS = 50_000_000_000
BANNED = ("spare parts", "second shift", "walk round", "thank you", "vielen dank")
POOLS = (("alpha", ("finance", "sales")), ("beta", ("operations", "hr")), ("gamma", ("*",)), ("delta", ("*", "marketing")))
FIELDS = [("company_description", 0.7), ("job_title", 0.6), ("job_department", 0.5)]
TEMPLATE = "Hi {{ first_name }}, a note on {{company_name}} for {{ job_title }} ({not_a_field})"

Query = Callable[[SparkSession, str], DataFrame]


def _leads(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "leads", ["row_idx", *columns])


def _domains(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _leads(spark, d, "website", *columns).withColumn("domain", T.domain_of(F.col("website")))


def header_normalize(spark, d):
    parts = F.explode(F.split("header_line", F.concat(F.lit("\\Q"), F.col("delim_char"), F.lit("\\E"))))
    return table(spark, d, "lead_files").select("file_id", parts.alias("header")).withColumn("key", T.header_key(F.col("header")))


def domain_canonicalize(spark, d):
    return _domains(spark, d).select("row_idx", "domain")


def label_normalize(spark, d):
    return _leads(spark, d, "job_department").select("row_idx", T.label_key(F.col("job_department")).alias("label"))


def email_normalize(spark, d):
    return _leads(spark, d, "email").select("row_idx", T.email_key(F.col("email")).alias("email_key"))


def email_syntax_gate(spark, d):
    return _leads(spark, d, "email").select("row_idx", T.email_syntax_ok(F.col("email")).alias("valid"))


def first_name_clean(spark, d):
    return _leads(spark, d, "first_name").select("row_idx", T.given_name(F.col("first_name")).alias("given"))


def company_short_name(spark, d):
    return _leads(spark, d, "company_name").select("row_idx", T.brand_name(F.col("company_name")).alias("brand"))


def opening_key(spark, d):
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", T.opening_words(F.col("text"), 4).alias("opening"))


def word_counts(spark, d):
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


def sentence_split(spark, d):
    s = table(spark, d, "documents", ["doc_id", "text"]).where("text IS NOT NULL").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first_sentence"))


def url_normalize(spark, d):
    return table(spark, d, "fetch_results", ["fetch_id", "final_url"]).select("fetch_id", T.url_normal(F.col("final_url")).alias("normal_url"))


def brand_hint(spark, d):
    return table(spark, d, "fetch_results", ["fetch_id", "url"]).select("fetch_id", T.brand_hint(T.domain_of(F.col("url"))).alias("brand"))


def redirect_match(spark, d):
    pages = table(spark, d, "fetch_results", ["fetch_id", "url", "final_url"])
    return pages.select("fetch_id", T.same_site(T.domain_of(F.col("url")), T.domain_of(F.col("final_url"))).alias("matches"))


def merge_render(spark, d):
    leads = _leads(spark, d, "first_name", "company_name", "job_title")
    return leads.select("row_idx", T.rendered(TEMPLATE, {c: F.col(c) for c in leads.columns}).alias("message"))


def banned_phrase_first(spark, d):
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", T.first_phrase(F.col("text"), BANNED).alias("phrase"))


def verbatim_quote(spark, d):
    s = table(spark, d, "site_signals", ["signal_id", "focus", "evidence"])
    return s.select("signal_id", T.is_quoted_in(F.col("focus"), F.col("evidence")).alias("verbatim"))


def name_leak(spark, d):
    return _leads(spark, d, "company_name", "company_description").select("row_idx", T.name_leaks(F.col("company_name"), F.col("company_description")).alias("leaks"))


def evidence_check(spark, d):
    return table(spark, d, "site_signals", ["signal_id", "evidence"]).where("evidence IS NOT NULL").select("signal_id", T.evidence_flaw(F.col("evidence")).alias("flaw"))


def copied_run(spark, d):
    s = table(spark, d, "site_signals", ["signal_id", "observation", "evidence"])
    return s.select("signal_id", T.shares_run(F.col("observation"), F.col("evidence"), 3).alias("copied"))


def acceptable_text(spark, d):
    s = table(spark, d, "site_signals", ["signal_id", "evidence"]).where("evidence IS NOT NULL")
    return s.select("signal_id", T.acceptable(F.col("evidence")).alias("fine"), F.round(T.candidate_score(F.col("evidence"), F.lit("paragraph"), F.lit("/about")), 4).alias("score"))


def case_acronyms(spark, d):
    return _leads(spark, d, "job_title").select("row_idx", T.lower_but_acronyms(F.col("job_title")).alias("title"))


def lead_profile(spark, d):
    leads = table(spark, d, "leads", ["row_idx", "email", "first_name", "company_name", "website", "email_status"])
    return tables.profile(leads, ["email", "first_name", "company_name", "website", "email_status"], T.domain_of(F.col("website")), F.coalesce(T.email_key(F.col("email")), F.lit("")))


def distinct_domains(spark, d):
    return _domains(spark, d).where("domain <> ''").groupBy("domain").agg(F.min("row_idx").alias("first_row"))


def company_assignment_key(spark, d):
    leads = _domains(spark, d, "email", "company_name")
    name, email = F.coalesce(T.label_key(F.col("company_name")), F.lit("")), F.coalesce(T.email_key(F.col("email")), F.lit(""))
    identity = F.when(name != "", F.concat(F.lit("company-name:"), name)).when(email != "", F.concat(F.lit("contact:"), email)).otherwise(F.concat(F.lit("row:"), F.col("row_idx")))
    return leads.select("row_idx", F.when(F.col("domain") != "", F.col("domain")).otherwise(F.concat(F.lit("fallback:"), F.sha2(identity, 256))).alias("company_key"))


def company_context(spark, d):
    leads = _domains(spark, d, "company_name", "job_title").where("domain <> ''")
    rank = F.coalesce(rules.first_rule(F.col("job_title"), _rules(spark, d)), F.lit(9999))
    named = F.when(~F.coalesce(T.stripped(F.col("company_name")), F.lit("")).isin(""), F.struct("row_idx", "company_name"))
    titled = F.when(F.col("job_title").isNotNull(), F.struct(rank.alias("rank"), "row_idx", "job_title"))
    groups = leads.groupBy("domain").agg(F.min(named).alias("n"), F.min(titled).alias("t"))
    return groups.select("domain", F.col("n.company_name").alias("company_name"), F.col("t.job_title").alias("best_title"))


def status_counts(spark, d):
    return _leads(spark, d, "email_status").groupBy(F.coalesce(T.label_key(F.col("email_status")), F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _rules(spark, d):
    return rules.read_rules(table(spark, d, "title_hooks"), ["persona", "hook"])


def title_hook_match(spark, d):
    found = rules.with_rule(_leads(spark, d, "job_title").where("job_title IS NOT NULL"), F.col("job_title"), _rules(spark, d), ["persona", "hook"])
    return found.select("row_idx", F.col("rule_priority").alias("priority"), "persona")


def lead_signal_left_join(spark, d):
    signals = table(spark, d, "site_signals", ["signal_id", "domain", "status", "confidence"])
    best = tables.first_per_key(signals, "domain", F.struct((-F.col("confidence")).alias("c"), F.col("signal_id").alias("i")), ["signal_id", "status"])
    return _domains(spark, d).join(best, "domain", "left").select("row_idx", "domain", "signal_id", "status")


def fallback_unpivot(spark, d):
    return tables.unpivoted(table(spark, d, "leads", ["row_idx", *[f for f, _ in FIELDS]]), "row_idx", FIELDS)


def pending_anti_join(spark, d):
    fetched = table(spark, d, "fetch_results", ["url"]).select(T.domain_of(F.col("url")).alias("domain")).distinct()
    return distinct_domains(spark, d).join(fetched, "domain", "left_anti").select("domain", "first_row")


def variant_pool_match(spark, d):
    leads = _leads(spark, d, "job_department")
    return tables.pooled(leads, F.coalesce(T.label_key(F.col("job_department")), F.lit("")), list(POOLS)).select("row_idx", "pool")


def stable_variant(spark, d):
    keys = distinct_domains(spark, d)
    return keys.select("domain", sha_mod(F.concat(F.lit("variant:"), F.col("domain")), VARIANTS).alias("variant"))


def balanced_variants(spark, d):
    return ranks.balanced(distinct_domains(spark, d).select("domain"), "domain", "balance:", VARIANTS).select("domain", "variant")


def pool_balanced_variants(spark, d):
    leads = tables.pooled(_domains(spark, d, "job_department").where("domain <> ''"), F.coalesce(T.label_key(F.col("job_department")), F.lit("")), list(POOLS))
    first = tables.first_per_key(leads, "domain", F.col("row_idx"), ["pool"])
    sized = first.withColumn("n", F.size(F.split("pool", ",")))
    return ranks.balanced(sized, "domain", "balance:", F.col("n"), group=["pool"]).select("domain", "pool", "variant")


def email_dedupe_winner(spark, d):
    leads = _leads(spark, d, "email", "updated_at").withColumn("key", F.nullif(T.email_key(F.col("email")), F.lit("")))
    return tables.with_winner(leads, "key", F.struct("updated_at", -F.col("row_idx"))).select("row_idx", "key", "winner", "copies")


def contact_ranking(spark, d):
    leads = _domains(spark, d, "job_title", "job_seniority").where("domain <> ''")
    title = F.coalesce(rules.first_rule(F.col("job_title"), _rules(spark, d)), F.lit(9999))
    seniority = F.coalesce(F.array_position(F.array(*map(F.lit, ("Founder/Owner", "C-Suite", "Vice President", "Director", "Manager", "Senior", "entry"))), F.col("job_seniority")), F.lit(0))
    seniority = F.when(seniority > 0, seniority).otherwise(F.lit(99))
    held = leads.withColumns({"t": title, "s": seniority.cast("int")})
    out = ranks.ranked(held, ["domain"], [F.col("t"), F.col("s"), ranks.range_bucket(_leads(spark, d), "row_idx")], [F.col("row_idx")], out="contact_rank", size="contact_count")
    return out.select("row_idx", "domain", "contact_rank", "contact_count")


def share_overflow(spark, d):
    docs = table(spark, d, "documents", ["text", "company_domain"]).where("text IS NOT NULL AND company_domain IS NOT NULL")
    pairs = docs.select(T.opening_words(F.col("text"), 2).alias("value"), F.col("company_domain").alias("company")).where("value <> ''")
    return ranks.overflow(pairs, "value", "company", "overflow:", 20)


def opening_share(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "text", "company_domain"]).where("text IS NOT NULL AND company_domain IS NOT NULL")
    first = tables.first_per_key(docs.withColumn("opening", T.opening_words(F.col("text"), 2)), "company_domain", F.col("doc_id"), ["opening"])
    counts = first.groupBy("opening").agg(F.count(F.lit(1)).alias("companies"))
    total = counts.agg(F.sum("companies").alias("total")).select(F.lit(1).alias("one"), "total")
    shared = counts.withColumn("one", F.lit(1)).join(total, "one")
    return shared.select("opening", "companies", F.round(F.col("companies") / F.col("total"), 6).alias("share"))


def first_per_key(spark, d):
    return tables.first_per_key(_domains(spark, d, "email").where("domain <> ''"), "domain", F.col("row_idx"), ["row_idx", "email"])


def chunk_waves(spark, d):
    return ranks.chunked(distinct_domains(spark, d), "first_row", 5, 8, over=_leads(spark, d).withColumnRenamed("row_idx", "first_row")).select("domain", "call_no", "wave_no")


def facts_concat_distinct(spark, d):
    signals = table(spark, d, "site_signals", ["signal_id", "domain", "facts"])
    own = signals.select("domain", F.lit(1).alias("source"), F.col("signal_id").alias("id"), F.posexplode("facts").alias("pos", "f")).select("domain", "source", "id", F.col("pos").cast("int").alias("pos"), F.col("f.focus").alias("focus"), F.col("f.evidence").alias("evidence"))
    rows = _domains(spark, d, "company_description").where("domain <> '' AND trim(coalesce(company_description, '')) <> ''")
    given = rows.select("domain", F.lit(2).alias("source"), F.col("row_idx").alias("id"), F.lit(0).alias("pos"), F.lit("").alias("focus"), F.col("company_description").alias("evidence"))
    every = own.unionByName(given)
    first = F.min(F.struct("source", "id", "pos", "focus", "evidence")).alias("r")
    return every.groupBy("domain", F.lower("focus").alias("fk"), F.lower("evidence").alias("ek")).agg(first).select("domain", "r.source", "r.id", "r.focus", "r.evidence")


def cached_union_fresh(spark, d):
    cached = table(spark, d, "fetch_results", ["url", "from_cache"]).where("from_cache").select(T.domain_of(F.col("url")).alias("domain")).distinct().withColumn("origin", F.lit("cache"))
    fresh = distinct_domains(spark, d).select("domain").join(cached, "domain", "left_anti").withColumn("origin", F.lit("fresh"))
    return cached.unionByName(fresh)


def _entries(spark, d):
    return table(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "value"])


def _now(spark, d):
    return F.lit(_entries(spark, d).agg(F.max("ts")).first()[0])  # one value: the clock of a run


def cache_ttl_lookup(spark, d):
    found = tables.latest_valid(_entries(spark, d), ["event_type", "user_id"], "ts", _now(spark, d), TTL_HOURS, ["event_id"])
    return found.select("event_type", "user_id", "event_id")


def cache_prune_count(spark, d):
    return tables.expired(_entries(spark, d), "ts", _now(spark, d), TTL_HOURS).groupBy("event_type").agg(F.count(F.lit(1)).alias("removed"))


def running_budget(spark, d):
    micros = F.greatest(F.round(F.col("value") * 1_000_000), F.lit(0.0)).cast("long")
    spent = ranks.running_total(_entries(spark, d), "event_id", micros, out="spent_micros")
    return spent.select("event_id", "spent_micros", (F.col("spent_micros") >= BUDGET_MICROS).alias("exhausted"))


def usage_split(spark, d):
    return ranks.split_total(_entries(spark, d).select("event_id", "user_id"), ["user_id"], "event_id", 1000).select("event_id", "user_id", "share")


def included_held_split(spark, d):
    leads = _domains(spark, d, "email").withColumn("key", F.coalesce(T.email_key(F.col("email")), F.lit("")))
    fit = leads.where((F.col("key") != "") & (F.col("domain") != "") & T.email_syntax_ok(F.col("email")))
    return delivery.included_held(fit, "row_idx", "key", "domain").select("row_idx", "status")


def _pages(spark, d):
    return html.with_page(spread(table(spark, d, "fetch_results", ["fetch_id", "url", "final_url", "body"]).where("body IS NOT NULL"))).withColumn("domain", T.domain_of(F.col("url")))


def page_extract(spark, d):
    p = F.col("page")
    return _pages(spark, d).select("fetch_id", p["title"].alias("title"), p["meta_description"].alias("description"), F.size(p["headings"]).alias("n_headings"), F.size(p["paragraphs"]).alias("n_paragraphs"), F.size(p["links"]).alias("n_links"))


def page_candidates(spark, d):
    return html.page_candidates(_pages(spark, d)).select("fetch_id", "kind", "text", "score")


def page_top_facts(spark, d):
    return html.top_candidates(_pages(spark, d), 3)


def page_digest(spark, d):
    return html.digest(_pages(spark, d), "domain", "fetch_id")


def link_rank(spark, d):
    return html.with_ranked_links(_pages(spark, d), limit=2).select("fetch_id", "next_links")


def queries() -> dict[str, Query]:
    every = (
        header_normalize, domain_canonicalize, label_normalize, email_normalize, email_syntax_gate, first_name_clean, company_short_name, opening_key, word_counts, sentence_split,
        url_normalize, brand_hint, redirect_match, merge_render, banned_phrase_first, verbatim_quote, name_leak, evidence_check, copied_run, acceptable_text, case_acronyms,
        lead_profile, distinct_domains, company_assignment_key, company_context, status_counts, title_hook_match, lead_signal_left_join, fallback_unpivot, pending_anti_join,
        variant_pool_match, stable_variant, balanced_variants, pool_balanced_variants, email_dedupe_winner, contact_ranking, share_overflow, opening_share, first_per_key, chunk_waves,
        facts_concat_distinct, cached_union_fresh, cache_ttl_lookup, cache_prune_count, running_budget, usage_split, included_held_split,
        page_extract, page_candidates, page_top_facts, page_digest, link_rank,
    )
    return {f.__name__: f for f in every}
