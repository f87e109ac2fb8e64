"""The same queries in SQL, as DuckDB runs it. Written for itself, not generated from the plans."""

from __future__ import annotations

#: Fixed values, written out here as well, so that the statements do not share a mistake with the plans.
COMPANY_ENDINGS = (
    "corp", "corporation", "inc", "incorporated", "llc", "ltd", "limited", "&", "and",
)
BRAND_ENDINGS = (
    "company", "corporation", "holdings", "limited", "services", "service", "group", "inc", "ltd", "llc", "co",
)
COMPANY_STOP_WORDS = (
    "and", "associates", "company", "corp", "corporation", "group", "inc", "llc", "limited", "ltd", "partners", "the",
)
PLACEHOLDERS = (
    "-", "n/a", "na", "none", "not available", "not revealed", "unknown",
)
NAVIGATION_WORDS = (
    "home", "about", "us", "our", "services", "products", "contact", "team", "menu", "login", "sign", "in", "up", "learn", "more", "click", "here", "read", "next", "back", "privacy",
    "policy", "terms", "conditions", "careers", "news", "resources", "solutions", "industries", "support", "search", "to", "find", "out",
)
BLOCKED_PHRASES = (
    "accept cookies", "cookie policy", "privacy policy", "terms of use", "all rights reserved", "subscribe to our newsletter", "javascript is disabled", "page not found",
    "access denied", "contact us today", "learn more", "cookies help us", "world-leading", "world leading", "industry-leading", "industry leading", "best-in-class",
    "best in class", "number one", "#1",
)
CUT_WORDS = (
    "advis", "commer", "comp", "financ", "int", "intern", "internat", "manag", "servic", "solut", "transact",
)
BUSINESS_VERBS = (
    r"\b(help|helps|support|supports|provide|provides|offer|offers|speciali[sz]e|speciali[sz]es|advise|advises|manage|manages|build|builds|deliver|delivers|"
    r"serve|serves|work with|works with|enable|enables|acquire|acquires|acquiring|buy|buys|buying|invest|invests|investing)\b"
)
#: The parameters of the queries.
VARIANTS = 5
TTL_HOURS = 168
BUDGET_MICROS = 50_000_000_000
BANNED = (
    "spare parts", "second shift", "walk round", "thank you", "vielen dank",
)
POOLS = (("alpha", ("finance", "sales")), ("beta", ("operations", "hr")), ("gamma", ("*",)), ("delta", ("*", "marketing")))
FIELDS = [("company_description", 0.7), ("job_title", 0.6), ("job_department", 0.5)]
TEMPLATE = "Hi {{ first_name }}, a note on {{company_name}} for {{ job_title }} ({not_a_field})"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def label(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), '^ | $', '', 'g')"


def email(c: str) -> str:
    return f"lower({strip(c)})"


def domain(c: str) -> str:
    t = strip(f"coalesce({c}, '')")
    full = f"(CASE WHEN contains({t}, '://') THEN {t} ELSE 'https://' || {t} END)"
    authority = f"regexp_extract({full}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
    host = f"regexp_extract(regexp_replace({authority}, '^.*@', ''), '^([^:]*)', 1)"
    return f"regexp_replace(regexp_replace(lower({host}), '\\.+$', ''), '^www\\.', '')"


def words(c: str) -> str:
    return f"regexp_extract_all({c}, '[A-Za-z0-9]+(?:[&''-][A-Za-z0-9]+)*')"


def plain(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), '^[ \\t\\r\\n|•-]+|[ \\t\\r\\n|•-]+$', '', 'g')"


def opening(c: str, n: int) -> str:
    return f"array_to_string(list_slice(regexp_extract_all(lower({c}), '[a-z0-9'']+'), 1, {n}), ' ')"


def match_form(c: str) -> str:
    return f"lower(regexp_replace(regexp_replace(translate({c}, '\"''“”‘’`…', '        '), '\\s+', ' ', 'g'), '^[ .,;:!?-]+|[ .,;:!?-]+$', '', 'g'))"


def brand(h: str) -> str:
    lab = f"regexp_replace(regexp_extract(regexp_replace(lower({h}), '^www\\.', ''), '^([^.]*)', 1), '[^a-z0-9]', '', 'g')"
    cases = " ".join(f"WHEN {lab} LIKE '%{e}' AND length({lab}) >= {len(e) + 5} THEN regexp_replace({lab}, '{e}$', '')" for e in BRAND_ENDINGS)
    return f"(CASE {cases} ELSE {lab} END)"


def first_phrase(c: str, phrases: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({c}), {_q(p.lower())}) THEN {_q(p)}" for p in phrases) + f" WHEN {c} IS NOT NULL THEN '' END"


def _in(items: tuple[str, ...]) -> str:
    return ", ".join(map(_q, items))


_DOMAINS = f"dom AS (SELECT *, {domain('website')} AS domain FROM leads)"
_FIRST_DOMAINS = "fd AS (SELECT domain, min(row_idx) AS first_row FROM dom WHERE domain <> '' GROUP BY domain)"
_RULES = "(SELECT min(priority) FROM title_hooks h WHERE regexp_matches(l.job_title, h.title_pattern, 'i'))"
_VALID = (
    f"(length({email('email')}) BETWEEN 3 AND 254 AND regexp_full_match({email('email')}, '[A-Za-z0-9.!#$%&''*+/=?^_`{{|}}~-]{{1,64}}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\\.)+[A-Za-z]{{2,63}}')"
    f" AND NOT regexp_matches(regexp_extract({email('email')}, '^([^@]*)@', 1), '^\\.|\\.$|\\.\\.'))"
)


def _pool(c: str) -> str:
    exact = "list_filter([" + ", ".join(f"CASE WHEN {c} IN ({_in(labels)}) THEN '{name}' END" for name, labels in POOLS) + "], lambda x: x IS NOT NULL)"
    rest = "[" + ", ".join(f"'{name}'" for name, labels in POOLS if "*" in labels) + "]"
    return f"array_to_string(CASE WHEN len({exact}) > 0 THEN {exact} ELSE {rest} END, ',')"


def _runs(c: str, n: int) -> str:
    w = f"list_transform({words(c)}, lambda w: lower(w))"
    return f"list_transform(range(1, greatest(len({w}) - {n - 2}, 1)), lambda i: array_to_string(list_slice({w}, i, i + {n - 1}), ' '))"


def _url() -> str:
    t = f"regexp_replace({strip('final_url')}, '#.*$', '')"
    auth = f"regexp_replace(regexp_extract({t}, '^[^:]*://([^/?]*)', 1), '^.*@', '')"
    return f"""
    WITH p AS (SELECT fetch_id, lower(regexp_extract({t}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
      regexp_replace(lower(regexp_extract({auth}, '^([^:]*)', 1)), '\\.+$', '') AS host, regexp_extract({auth}, ':([0-9]+)$', 1) AS port,
      regexp_extract({t}, '^[^:]*://[^/?]*([^?]*)', 1) AS path, regexp_extract({t}, '(\\?.+)$', 1) AS query FROM fetch_results)
    SELECT fetch_id, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' || host
      || CASE WHEN port = '' OR (scheme = 'https' AND port = '443') OR (scheme = 'http' AND port = '80') THEN '' ELSE ':' || port END
      || CASE WHEN path = '' THEN '/' ELSE path END || query END AS normal_url FROM p"""


def _redirect() -> str:
    return f"""
    WITH h AS (SELECT fetch_id, {domain('url')} AS a, {domain('final_url')} AS b FROM fetch_results), x AS (SELECT *, {brand('a')} AS ba, {brand('b')} AS bb FROM h)
    SELECT fetch_id, a = b OR ends_with(b, '.' || a) OR ends_with(a, '.' || b) OR (least(length(ba), length(bb)) >= 5 AND (contains(ba, bb) OR contains(bb, ba))) AS matches FROM x"""


def _profile() -> str:
    cols = ("email", "first_name", "company_name", "website", "email_status")
    blank = ", ".join(f"count(*) FILTER ({c} IS NULL OR regexp_full_match({c}, '[\\s\\p{{Z}}\\p{{Cf}}]*')) AS blank_{c}" for c in cols)
    return f"""
    WITH {_DOMAINS}, d AS (SELECT domain AS k, count(*) AS n FROM dom WHERE domain <> '' GROUP BY 1), e AS (SELECT {email('email')} AS k, count(*) AS n FROM leads WHERE {email('email')} <> '' GROUP BY 1)
    SELECT count(*) AS row_count, {blank},
      (SELECT coalesce(sum(n), 0)::BIGINT FROM d) AS domain_rows, (SELECT count(*) FROM d) AS unique_domains, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM d) AS repeated_domain_rows,
      (SELECT coalesce(sum(n), 0)::BIGINT FROM e) AS email_rows, (SELECT count(*) FROM e) AS unique_emails, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM e) AS repeated_email_rows
    FROM leads"""


def _score(c: str) -> str:
    n = f"len(string_split_regex({strip(c)}, '\\s+'))"
    return f"round(least(0.96, 0.66 + 0.04 + CASE WHEN regexp_matches({c}, {_q(BUSINESS_VERBS)}, 'i') THEN 0.08 ELSE 0.0 END + CASE WHEN {n} BETWEEN 8 AND 24 THEN 0.04 ELSE 0.0 END), 4)::DOUBLE"


def _acceptable(c: str) -> str:
    w = f"string_split_regex({strip(c)}, '\\s+')"
    return f"""(len({w}) BETWEEN 6 AND 42 AND ({first_phrase(c, BLOCKED_PHRASES)}) = ''
      AND NOT regexp_matches({c}, '\\b\\d+(?:\\.\\d+)?%|\\b\\d+[kmb]\\+?\\b|\\b\\d+\\+\\s+years?\\b|\\b(?:million|billion)\\b', 'i')
      AND length({c}) - length(replace({c}, '|', '')) <= 1 AND length({c}) - length(replace({c}, '/', '')) <= 3
      AND NOT regexp_matches({c}, 'https?://|www\\.|\\S@\\S', 'i') AND NOT regexp_matches(lower({c}), '^(?:visit|click|shop|browse|contact|download)\\b|^\\(?see\\b')
      AND regexp_replace(lower({w}[-1]), '[^a-z]', '', 'g') NOT IN ({_in(CUT_WORDS)}))"""


def _flaw(c: str) -> str:
    found = f"regexp_extract_all(lower({c}), '[a-z]+')"
    return f"""CASE WHEN len({words(c)}) < 4 THEN 'short'
      WHEN regexp_matches({c}, '\\b(?:(?:we|this (?:site|website)) uses? cookies|accept (?:all )?cookies|cookie (?:policy|preferences|consent)|manage (?:your )?(?:cookies|consent)|consent preferences|all rights reserved)\\b', 'i') THEN 'notice'
      WHEN len({found}) > 0 AND len(list_filter({found}, lambda w: w NOT IN ({_in(NAVIGATION_WORDS)}))) = 0 THEN 'navigation' ELSE '' END"""


def _leaks() -> str:
    own = f"list_filter(list_transform({words('company_name')}, lambda w: lower(w)), lambda w: w NOT IN ({_in(COMPANY_STOP_WORDS)}))"
    said = f"list_transform({words('company_description')}, lambda w: lower(w))"
    return f"""WITH w AS (SELECT row_idx, {own} AS own, {said} AS said FROM leads)
      SELECT row_idx, coalesce(len(own) > 0 AND len(said) > 0 AND ((length(own[1]) >= 4 AND said[1] = own[1]) OR len(list_distinct(list_intersect(own, said))) >= 2), false) AS leaks FROM w"""


def _brand_name() -> str:
    c = "company_name"
    ends = "|".join(COMPANY_ENDINGS)
    cut = f"regexp_replace({c}, '\\s*(?:\\||\\(|\\[|[–—]|\\s-\\s).*$', '', 's')"
    kept = f"regexp_replace({strip(cut)}, '(?:\\s+[,.;:-]*(?:{ends})[,.;:-]*)+$', '', 'i')"
    short = f"regexp_replace(regexp_extract({kept}, '^(\\S+(?:\\s+\\S+){{0,3}})', 1), '\\s+', ' ', 'g')"
    acronym = f"regexp_extract({c}, '\\(([A-Z][A-Z0-9&.-]{{1,9}})\\)', 1)"
    p = "'^[ ,.;:&/-]+|[ ,.;:&/-]+$'"
    return f"SELECT row_idx, CASE WHEN {acronym} <> '' THEN regexp_replace({acronym}, {p}, '', 'g') ELSE regexp_replace({short}, {p}, '', 'g') END AS brand FROM leads"


def _given() -> str:
    t = f"list_transform(string_split_regex({strip('first_name')}, '\\s+'), lambda w: regexp_replace(w, '^[ ,;:.]+|[ ,;:.]+$', '', 'g'))"
    kept = f"list_filter(list_transform(list_filter({t}, lambda w: lower(w) NOT IN ('dr', 'mr', 'mrs', 'ms', 'prof')), lambda w: regexp_replace(w, '^[^\\pL]+', '')), lambda w: w <> '')"
    return f"SELECT row_idx, coalesce({kept}[1], '') AS given FROM leads"


def _message() -> str:
    import re

    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", TEMPLATE)
    return "SELECT row_idx, " + " || ".join(_q(p) if i % 2 == 0 else f"coalesce({p}, '')" for i, p in enumerate(parts)) + " AS message FROM leads"


def _case() -> str:
    def letters(w: str) -> str:
        return f"regexp_replace({w}, '[^A-Za-z]', '', 'g')"

    return f"SELECT row_idx, array_to_string(list_transform(string_split_regex({strip('job_title')}, '\\s+'), lambda w: CASE WHEN length({letters('w')}) >= 2 AND {letters('w')} = upper({letters('w')}) THEN w ELSE lower(w) END), ' ') AS title FROM leads"


def _unpivot() -> str:
    parts = [f"SELECT row_idx, {i + 1} AS pos, '{h}' AS header, {plain(h)} AS value, {c}::DOUBLE AS confidence FROM leads" for i, (h, c) in enumerate(FIELDS)]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL AND value <> '' AND lower(value) NOT IN ({_in(PLACEHOLDERS)})"


_SENIORITY = ("Founder/Owner", "C-Suite", "Vice President", "Director", "Manager", "Senior", "entry")


def oracle_sql() -> dict[str, str]:
    marked = f"regexp_replace({plain('text')}, '([.!?])\\s+', '\\1' || chr(31), 'g')"
    split = f"list_filter(list_transform(string_split({marked}, chr(31)), lambda s: {plain('s')}), lambda s: s <> '')"
    limbs = "list_transform(range(0, 16), lambda i: ('0x' || substr(sha256('variant:' || domain), (i * 4 + 1)::BIGINT, 4))::BIGINT)"
    seniority = "CASE job_seniority " + " ".join(f"WHEN {_q(s)} THEN {i + 1}" for i, s in enumerate(_SENIORITY)) + " ELSE 99 END"
    now = "(SELECT max(ts) FROM events)"
    age = f"epoch_us({now}) - epoch_us(ts)"
    micros = TTL_HOURS * 3_600_000_000
    identity = f"CASE WHEN coalesce({label('company_name')}, '') <> '' THEN 'company-name:' || {label('company_name')} WHEN coalesce({email('email')}, '') <> '' THEN 'contact:' || {email('email')} ELSE 'row:' || row_idx END"
    return {
        "header_normalize": "SELECT file_id, header, regexp_replace(regexp_replace(lower(trim(header)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM (SELECT file_id, unnest(string_split(header_line, delim_char)) AS header FROM lead_files)",
        "domain_canonicalize": f"SELECT row_idx, {domain('website')} AS domain FROM leads",
        "label_normalize": f"SELECT row_idx, {label('job_department')} AS label FROM leads",
        "email_normalize": f"SELECT row_idx, {email('email')} AS email_key FROM leads",
        "email_syntax_gate": f"SELECT row_idx, coalesce({_VALID}, false) AS valid FROM leads",
        "first_name_clean": _given(),
        "company_short_name": _brand_name(),
        "opening_key": f"SELECT doc_id, {opening('text', 4)} AS opening FROM documents",
        "word_counts": f"SELECT doc_id, len({words('text')}) AS n_words FROM documents",
        "sentence_split": f"SELECT doc_id, len({split}) AS n_sentences, coalesce({split}[1], '') AS first_sentence FROM documents WHERE text IS NOT NULL",
        "url_normalize": _url(),
        "brand_hint": f"SELECT fetch_id, {brand(domain('url'))} AS brand FROM fetch_results",
        "redirect_match": _redirect(),
        "merge_render": _message(),
        "banned_phrase_first": f"SELECT doc_id, {first_phrase('text', BANNED)} AS phrase FROM documents",
        "verbatim_quote": f"SELECT signal_id, coalesce({match_form('focus')} <> '' AND contains({match_form('evidence')}, {match_form('focus')}), false) AS verbatim FROM site_signals",
        "name_leak": _leaks(),
        "evidence_check": f"SELECT signal_id, {_flaw('evidence')} AS flaw FROM site_signals WHERE evidence IS NOT NULL",
        "copied_run": f"SELECT signal_id, coalesce(list_has_any({_runs('observation', 3)}, {_runs('evidence', 3)}), false) AS copied FROM site_signals",
        "acceptable_text": f"SELECT signal_id, {_acceptable('evidence')} AS fine, {_score('evidence')} AS score FROM site_signals WHERE evidence IS NOT NULL",
        "case_acronyms": _case(),
        "lead_profile": _profile(),
        "distinct_domains": f"WITH {_DOMAINS}, {_FIRST_DOMAINS} SELECT * FROM fd",
        "company_assignment_key": f"SELECT row_idx, CASE WHEN {domain('website')} <> '' THEN {domain('website')} ELSE 'fallback:' || sha256({identity}) END AS company_key FROM leads",
        "company_context": f"""WITH {_DOMAINS}, r AS (SELECT l.*, coalesce({_RULES}, 9999) AS rank FROM dom l WHERE domain <> '')
          SELECT domain, arg_min(company_name, row_idx) FILTER (company_name IS NOT NULL AND {strip('company_name')} <> '') AS company_name,
            arg_min(job_title, rank * 1000000000000 + row_idx) FILTER (job_title IS NOT NULL) AS best_title FROM r GROUP BY domain""",
        "status_counts": f"SELECT coalesce({label('email_status')}, '') AS status, count(*) AS n FROM leads GROUP BY 1",
        "title_hook_match": f"WITH m AS (SELECT row_idx, {_RULES} AS priority FROM leads l WHERE job_title IS NOT NULL) SELECT row_idx, m.priority, persona FROM m LEFT JOIN title_hooks h ON h.priority = m.priority",
        "lead_signal_left_join": f"""WITH {_DOMAINS}, s AS (SELECT domain, signal_id, status FROM site_signals WHERE domain IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain ORDER BY confidence DESC NULLS LAST, signal_id) = 1)
          SELECT row_idx, dom.domain, signal_id, status FROM dom LEFT JOIN s ON s.domain = dom.domain""",
        "fallback_unpivot": _unpivot(),
        "pending_anti_join": f"WITH {_DOMAINS}, {_FIRST_DOMAINS} SELECT * FROM fd WHERE domain NOT IN (SELECT {domain('url')} FROM fetch_results)",
        "variant_pool_match": f"SELECT row_idx, {_pool(f'''coalesce({label('job_department')}, '')''')} AS pool FROM leads",
        "stable_variant": f"WITH {_DOMAINS}, {_FIRST_DOMAINS} SELECT domain, list_reduce({limbs}, lambda a, b: (a * 65536 + b) % {VARIANTS}) AS variant FROM fd",
        "balanced_variants": f"WITH {_DOMAINS}, {_FIRST_DOMAINS} SELECT domain, ((row_number() OVER (ORDER BY sha256('balance:' || domain)) - 1) % {VARIANTS})::INT AS variant FROM fd",
        "pool_balanced_variants": f"""WITH {_DOMAINS}, p AS (SELECT domain, arg_min({_pool(f'''coalesce({label('job_department')}, '')''')}, row_idx) AS pool FROM dom WHERE domain <> '' GROUP BY domain)
          SELECT domain, pool, ((row_number() OVER (PARTITION BY pool ORDER BY sha256('balance:' || domain)) - 1) % len(string_split(pool, ',')))::INT AS variant FROM p""",
        "email_dedupe_winner": f"""WITH k AS (SELECT row_idx, nullif({email('email')}, '') AS key, updated_at FROM leads), w AS (SELECT *, first_value(row_idx) OVER (PARTITION BY key ORDER BY updated_at DESC NULLS LAST, row_idx) AS winner, count(*) OVER (PARTITION BY key) AS copies FROM k WHERE key IS NOT NULL)
          SELECT row_idx, key, winner, copies FROM w WHERE copies > 1""",
        "contact_ranking": f"""WITH {_DOMAINS}, r AS (SELECT row_idx, domain, coalesce({_RULES}, 9999) AS t, {seniority} AS s FROM dom l WHERE domain <> '')
          SELECT row_idx, domain, row_number() OVER (PARTITION BY domain ORDER BY t, s, row_idx) AS contact_rank, count(*) OVER (PARTITION BY domain) AS contact_count FROM r""",
        "share_overflow": f"""WITH p AS (SELECT DISTINCT {opening('text', 2)} AS value, company_domain AS company FROM documents WHERE text IS NOT NULL AND company_domain IS NOT NULL)
          SELECT value, company FROM p WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY value ORDER BY sha256('overflow:' || value || ':' || company)) > 20""",
        "opening_share": f"""WITH f AS (SELECT company_domain, arg_min({opening('text', 2)}, doc_id) AS opening FROM documents WHERE text IS NOT NULL AND company_domain IS NOT NULL GROUP BY 1)
          SELECT opening, count(*) AS companies, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM f GROUP BY opening""",
        "first_per_key": f"WITH {_DOMAINS} SELECT domain, row_idx, email FROM dom WHERE domain <> '' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY row_idx) = 1",
        "chunk_waves": f"WITH {_DOMAINS}, {_FIRST_DOMAINS}, r AS (SELECT domain, row_number() OVER (ORDER BY first_row) - 1 AS k FROM fd) SELECT domain, k // 5 + 1 AS call_no, k // 40 + 1 AS wave_no FROM r",
        "facts_concat_distinct": f"""WITH {_DOMAINS}, own AS (SELECT domain, 1 AS source, signal_id AS id, unnest(range(1, len(facts) + 1)) AS pos, facts FROM site_signals),
          every AS (SELECT domain, source, id, pos - 1 AS pos, facts[pos].focus AS focus, facts[pos].evidence AS evidence FROM own UNION ALL SELECT domain, 2, row_idx, 0, '', company_description FROM dom WHERE domain <> '' AND trim(coalesce(company_description, '')) <> '')
          SELECT domain, source, id, focus, evidence FROM every QUALIFY row_number() OVER (PARTITION BY domain, lower(focus), lower(evidence) ORDER BY source, id, pos) = 1""",
        "cached_union_fresh": f"""WITH {_DOMAINS}, {_FIRST_DOMAINS}, c AS (SELECT DISTINCT {domain('url')} AS domain FROM fetch_results WHERE from_cache)
          SELECT domain, 'cache' AS origin FROM c UNION ALL SELECT domain, 'fresh' FROM fd WHERE domain NOT IN (SELECT domain FROM c)""",
        "cache_ttl_lookup": f"SELECT event_type, user_id, event_id FROM events WHERE {age} <= {micros} QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1",
        "cache_prune_count": f"SELECT event_type, count(*) AS removed FROM events WHERE ts IS NULL OR {age} > {micros} GROUP BY 1",
        "running_budget": f"WITH s AS (SELECT event_id, sum(greatest(round(value * 1000000), 0)::BIGINT) OVER (ORDER BY event_id)::BIGINT AS spent_micros FROM events) SELECT event_id, spent_micros, spent_micros >= {BUDGET_MICROS} AS exhausted FROM s",
        "usage_split": "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, user_id, 1000 // n + CASE WHEN k <= 1000 % n THEN 1 ELSE 0 END AS share FROM r",
        "included_held_split": f"""WITH RECURSIVE {_DOMAINS}, f AS (SELECT row_idx, domain, {email('email')} AS key FROM dom WHERE domain <> '' AND {email('email')} <> '' AND {_VALID}),
          walk AS (SELECT row_idx, key, domain, 'open' AS status FROM f UNION ALL
            SELECT row_idx, key, domain, CASE WHEN first THEN 'included' WHEN bool_or(first) OVER (PARTITION BY key) OR bool_or(first) OVER (PARTITION BY domain) THEN 'held' ELSE 'open' END
            FROM (SELECT *, row_idx = min(row_idx) OVER (PARTITION BY key) AND row_idx = min(row_idx) OVER (PARTITION BY domain) AS first FROM walk WHERE status = 'open'))
          SELECT row_idx, status FROM walk WHERE status <> 'open'""",
    }
