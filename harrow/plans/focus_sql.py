"""SQL, as DuckDB runs it, for the queries on facts, phrases, shares, records and deliveries; all lists are written out here."""

from __future__ import annotations

from . import reference_sql
from .reference_sql import _DOMAINS, _FIRST_DOMAINS, _RULES, _VALID, _given, domain, email, label, opening, plain, strip, words

_FOCUS = """rules(i, id, pattern, kinds, tier, priority) AS (VALUES
  (1, 'freight', 'freight|cold-chain|pallet', '*', 'core', 10), (2, 'people', 'payroll|reception cover|mailroom', 'service;audience;positioning', 'core', 20),
  (3, 'food', 'bakery|smoked|tinned|allergen', 'product;service', 'secondary', 20), (4, 'legal', 'lease reviews|dispute|handbooks', '*', 'exclude', 30), (5, 'print', 'label printing|cartons|pouches', 'product;specialism', 'secondary', 40))"""
_BY_RULE = "(SELECT min(i) FROM rules r WHERE regexp_matches(concat_ws(' | ', s.focus, s.evidence), r.pattern, 'i') AND (r.kinds = '*' OR list_contains(string_split(r.kinds, ';'), s.signal_type)))"
_WEAK = "['a', 'an', 'and', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with']"
_WEAK_CLAUSE = "['a', 'an', 'and', 'for', 'in', 'of', 'or', 'the', 'to', 'with']"


def _split(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')"


def _kept(few: str, least: int, weak: str, outer: str) -> str:
    strong = f"list_transform({few}, lambda w, i: CASE WHEN list_contains({weak}, lower(regexp_replace(w, '^[{outer}]+|[{outer}]+$', '', 'g'))) THEN 0 ELSE i END)"
    return f"least(len({few}), greatest({least}, coalesce(list_max({strong}), 0)))"


def _shortened(c: str, most: int) -> str:
    few = f"list_slice({_split(c)}, 1, {most})"
    return f"CASE WHEN len({_split(c)}) <= {most} THEN {c} ELSE regexp_replace(array_to_string(list_slice({few}, 1, {_kept(few, 2, _WEAK, ',;:.-')}), ' '), '[,;:.-]+$', '') END"


def _clause(c: str, most: int) -> str:
    """A shortened clause; ``c`` must be a column."""
    text = f"regexp_replace({plain(c)}, '[.!?]+$', '')"
    clauses = f"list_transform(string_split_regex({text}, '\\s*(?:[;:]|\\s+[–—]\\s+|\\s+(?:that|which|while|whereas)\\s+)\\s*'), lambda x: {_split(plain('x'))})"
    fitting = f"list_filter({clauses}, lambda x: len(x) BETWEEN 5 AND {most})"
    few = f"list_slice({_split(text)}, 1, {most})"
    cut = f"regexp_replace(array_to_string(list_slice({few}, 1, {_kept(few, 5, _WEAK_CLAUSE, ',;:-')}), ' '), '[,;:-]+$', '')"
    return f"CASE WHEN len({_split(text)}) <= {most} THEN {text} WHEN len({fitting}) > 0 THEN array_to_string({fitting}[1], ' ') ELSE {cut} END"


def _signal(source: str, keys: str, text: str) -> str:
    """(keys, signal_type, focus, observation) of the sentences ``text`` of ``source``."""
    openings = (
        ("we\\s+help\\b", "your team helps", "audience", "helping "), ("we\\s+support\\b", "your team supports", "audience", "supporting "), ("we\\s+provide\\b", "your team provides", "service", ""), ("we\\s+offer\\b", "your team offers", "product", ""),
        ("we\\s+work\\s+with\\b", "your team works with", "audience", "working with "), ("we\\s+speciali[sz]e\\s+in\\b", "your team specializes in", "specialism", ""),
        ("our\\s+(?:firm|company|team)\\s+helps\\b", "your team helps", "audience", "helping "), ("our\\s+(?:firm|company|team)\\s+provides\\b", "your team provides", "service", ""),
    )
    cases = []
    for pattern, begins, kind, prefix in openings:
        rest = f"regexp_extract(t, '^{pattern}(.*)$', 1, 'i')"
        cases.append(f"WHEN regexp_matches(t, '^{pattern}', 'i') THEN ['{kind}', '{prefix}' || {plain(rest)}, '{begins}' || {rest}]")
    for pattern, kind, focus, begins in (
        ("^supplier\\s+(?:to|of)\\s+(.+)$", "product", "", "your team supplies "), ("^discover\\s+how\\s+we\\s+help\\s+(.+)$", "audience", "helping ", "your team helps "),
        ("^discover\\s+(.+?)(?:\\s+at\\s+[A-Z].+|\\s+in\\s+[A-Z].+)$", "product", "", "your team offers "), ("\\b(?:ability\\s+to\\s+|designed\\s+to\\s+)?provides?\\s+(.+)$", "service", "", "your team provides "),
    ):
        part = f"regexp_extract(t, '{pattern}', 1, 'i')"
        cases.append(f"WHEN regexp_matches(t, '{pattern}', 'i') THEN ['{kind}', '{focus}' || {part}, '{begins}' || {part}]")
    word = "[A-Z][\\pL\\pM\\pN_&''.-]+"
    team = f"^{word}(?:\\s+{word}){{{{0,3}}}}\\s+(helps|supports|serves|offers|provides|advises|manages|builds|delivers|enables)\\b".replace("{{", "{").replace("}}", "}")
    verb, rest = f"regexp_extract(t, '{team}', 1)", f"regexp_extract(t, '{team}(.*)$', 2)"
    cases.append(
        f"WHEN regexp_matches(t, '{team}') THEN [CASE WHEN {verb} IN ('helps', 'supports', 'serves') THEN 'audience' WHEN {verb} = 'offers' THEN 'product' ELSE 'service' END,"
        f" CASE {verb} WHEN 'helps' THEN 'helping ' WHEN 'supports' THEN 'supporting ' WHEN 'serves' THEN 'serving ' ELSE '' END || {plain(rest)}, 'your team ' || {verb} || {rest}]"
    )
    cases.append("WHEN described <> '' THEN ['positioning', regexp_replace(d, '^(?:an?|the)\\s+', '', 'i'), 'your team is ' || d]")
    low = "lower(substr(t, 1, 1)) || substr(t, 2)"
    return f"""WITH a AS (SELECT {keys}, regexp_replace(regexp_replace({plain(text)}, '[.!?]+$', ''), '^(?:world[- ]class|premier|industry[- ]leading)\\s+', '', 'i') AS t FROM {source}),
      b AS (SELECT *, regexp_extract(t, '^.+?\\s+is\\s+((?:an?|the)\\s+.+?)(?:\\s+that\\b|\\s+which\\b|$)', 1, 'i') AS described FROM a), c AS (SELECT *, {_clause('described', 15)} AS d FROM b),
      r AS (SELECT *, CASE {' '.join(cases)} ELSE ['specialism', {low}, 'your site highlights ' || {low}] END AS s FROM c), x AS (SELECT *, s[1] AS signal_type, s[2] AS f, s[3] AS o FROM r)
      SELECT {keys}, signal_type, {_clause('f', 15)} AS focus, {_clause('o', 15)} AS observation FROM x"""


def _generic() -> str:
    promotional = "\\b(?:best|world[- ]class|industry[- ]leading|market[- ]leading|premier|unique|delicious|forward[- ]thinking|innovative|trusted|leading)\\b"
    v = "line"
    for p in ("\\b(?:since|est(?:ablished)?\\.?)\\s+(?:18|19|20)\\d{2}\\b", "(?:,?\\s*(?:&|and)\\s+more)\\b", promotional, "\\s+with confidence\\b", "^(?:helping|partner(?:ing)? with|supporting|working with|providing|offering|speciali[sz]ing in)\\s+"):
        v = f"regexp_replace({v}, '{p}', '', 'gi')"

    def tidy(c: str) -> str:
        return f"regexp_replace(regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), '^[ ,;:.-]+|[ ,;:.-]+$', '', 'g'), '\\s+([,;:])', '\\1', 'g')"

    def letters(w: str) -> str:
        return f"regexp_replace({w}, '[^A-Za-z]', '', 'g')"

    case = f"array_to_string(list_transform(string_split_regex({strip('short')}, '\\s+'), lambda w: CASE WHEN length({letters('w')}) >= 2 AND {letters('w')} = upper({letters('w')}) THEN w ELSE lower(w) END), ' ')"
    return f"""WITH l AS (SELECT signal_id, string_split(evidence, chr(10))[1] AS line FROM site_signals WHERE evidence IS NOT NULL), a AS (SELECT *, regexp_extract({tidy(v)}, '^([^,;]*)', 1) AS one FROM l),
      b AS (SELECT *, {tidy("regexp_replace(one, '\\s+(?:and|&)\\s+.*$', '', 'is')")} AS cut FROM a), c AS (SELECT *, {_shortened('cut', 6)} AS short FROM b), e AS (SELECT *, {case} AS made FROM c),
      f AS (SELECT *, CASE WHEN regexp_matches(line, '\\b(?:the\\s+)?best\\b', 'i') THEN 'superlative' WHEN len({words('made')}) < 2 THEN 'thin' ELSE '' END AS error FROM e)
      SELECT signal_id, CASE WHEN error = '' THEN made ELSE '' END AS value, error FROM f"""


_SENIORITY = "CASE job_seniority WHEN 'Founder/Owner' THEN 1 WHEN 'C-Suite' THEN 2 WHEN 'Vice President' THEN 3 WHEN 'Director' THEN 4 WHEN 'Manager' THEN 5 WHEN 'Senior' THEN 6 WHEN 'entry' THEN 7 ELSE 99 END"
_CLASS = f"CASE WHEN coalesce({label('email_status')}, '') IN ('valid', 'verified') THEN 2 WHEN coalesce({label('email_status')}, '') = 'bounced' THEN 0 ELSE 1 END"
_GRADED = f"""{_DOMAINS}, gn AS ({_given()}), g0 AS (SELECT l.row_idx, domain, job_seniority, coalesce({email('email')}, '') AS key, CASE WHEN {_VALID} THEN {_CLASS} ELSE 0 END AS mail, CASE WHEN domain <> '' THEN 2 ELSE 1 END AS company,
  coalesce({_RULES}, 9999) AS title, CASE WHEN coalesce(trim(job_title), '') = '' THEN 0 WHEN coalesce({_RULES}, 9999) < 30 THEN 2 ELSE 1 END AS contact, CASE WHEN coalesce(gn.given, '') <> '' THEN 2 ELSE 0 END AS copy FROM dom l LEFT JOIN gn USING (row_idx)),
  graded AS (SELECT *, CASE least(mail, company, contact, copy) WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS outreach FROM g0)"""
_CANDIDATES = f"""{_DOMAINS}, {_FOCUS}, best AS (SELECT * FROM site_signals WHERE domain IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain ORDER BY confidence DESC NULLS LAST, signal_id) = 1),
  raw AS (SELECT row_idx, status, 0 AS pos, 'website' AS source, confidence, b.signal_type, b.focus, b.evidence FROM dom JOIN best b USING (domain) WHERE status = 'ok' AND b.focus IS NOT NULL
    UNION ALL SELECT row_idx, NULL, 1, 'input:company_description', 0.5, 'service', company_description, NULL FROM dom WHERE trim(coalesce(company_description, '')) <> ''
    UNION ALL SELECT row_idx, NULL, 2, 'input:job_title', 0.5, 'service', job_title, NULL FROM dom WHERE trim(coalesce(job_title, '')) <> ''
    UNION ALL SELECT row_idx, NULL, 3, 'input:job_department', 0.5, 'service', job_department, NULL FROM dom WHERE trim(coalesce(job_department, '')) <> ''),
  cand AS (SELECT row_idx, pos, source, confidence, coalesce(rules.id, 'generic-compression') AS rule_id, coalesce(rules.tier, 'exclude') AS tier, coalesce(rules.priority, 1000000) AS priority FROM (SELECT *, {_BY_RULE} AS k FROM raw s) m LEFT JOIN rules ON rules.i = m.k)"""
_VALUES = """keys AS (SELECT domain AS key, arg_min({v: job_department}, row_idx).v AS department, arg_min({v: job_title}, row_idx).v AS title, arg_min({v: list_source}, row_idx).v AS source FROM dom WHERE domain <> '' GROUP BY domain),
  cells AS (SELECT key, 'department' AS kind, lower(department) AS value, 0.12 AS cap, 1 AS p FROM keys UNION ALL SELECT key, 'title', lower(title), 0.004, 2 FROM keys UNION ALL SELECT key, 'source', lower(source), 0.2, 3 FROM keys),
  shares AS (SELECT kind, value, p, count(*) AS n, (SELECT count(*) FROM keys) AS total, any_value(cap)::DOUBLE AS cap FROM cells WHERE value <> '' GROUP BY kind, value, p),
  over AS (SELECT *, floor(total * cap)::BIGINT AS allowed FROM shares WHERE n / total > cap)"""
_LEDGER = f"""{_DOMAINS}, led AS (SELECT row_idx, nullif({email('email')}, '') AS key, nullif(domain, '') AS domain, first_name, company_name FROM dom),
  open AS (SELECT row_idx, key, domain FROM led WHERE key IS NOT NULL AND domain IS NOT NULL AND trim(coalesce(first_name, '')) <> '' AND trim(coalesce(company_name, '')) <> ''),
  walk AS (SELECT row_idx, key, domain, 'open' AS status FROM open UNION ALL
    SELECT row_idx, key, domain, CASE WHEN first THEN 'included' WHEN bool_or(first) OVER (PARTITION BY key) OR bool_or(first) OVER (PARTITION BY domain) THEN 'held' ELSE 'open' END
    FROM (SELECT *, row_idx = min(row_idx) OVER (PARTITION BY key) AND row_idx = min(row_idx) OVER (PARTITION BY domain) AS first FROM walk WHERE status = 'open')),
  taken AS (SELECT * FROM walk WHERE status = 'included'),
  ledger AS (SELECT l.row_idx, CASE WHEN t.row_idx IS NOT NULL THEN 'included' ELSE 'held' END AS status,
    CASE WHEN t.row_idx IS NOT NULL THEN '' WHEN trim(coalesce(first_name, '')) = '' THEN 'missing:first_name' WHEN trim(coalesce(company_name, '')) = '' THEN 'missing:company_name' WHEN l.key IS NULL THEN 'missing:email' WHEN l.domain IS NULL THEN 'missing:company'
      WHEN a.row_idx < l.row_idx THEN 'used:email' ELSE 'used:company' END AS reason
    FROM led l LEFT JOIN taken t ON t.row_idx = l.row_idx LEFT JOIN taken a ON a.key = l.key LEFT JOIN taken b ON b.domain = l.domain)"""


def _listed(c: str, options: list[tuple[str, tuple[str, ...]]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} IN ({', '.join(repr(x) for x in labels)}) THEN '{name}'" for name, labels in options) + f" ELSE {other} END"


def oracle_sql() -> dict[str, str]:
    first_line = "(SELECT signal_id, line_no, line FROM (SELECT signal_id, unnest(range(0, len(string_split(evidence, chr(10))))) AS line_no, string_split(evidence, chr(10)) AS parts FROM site_signals WHERE evidence IS NOT NULL), LATERAL (SELECT parts[line_no + 1] AS line))"
    core = reference_sql.oracle_sql()
    tail = "regexp_extract(coalesce(email, ''), '@([^@]+)$', 1)"
    return {
        "focus_rule_match": f"WITH {_FOCUS} SELECT signal_id, rules.id AS rule_id FROM (SELECT signal_id, {_BY_RULE} AS k FROM site_signals s WHERE focus IS NOT NULL) m LEFT JOIN rules ON rules.i = m.k",
        "signal_normalize": _signal("(SELECT * FROM site_signals WHERE observation IS NOT NULL)", "signal_id", "observation"),
        "evidence_signals": _signal(first_line, "signal_id, line_no::INT AS line_no", "line").replace("SELECT signal_id, line_no::INT AS line_no, signal_type", "SELECT signal_id, line_no, signal_type"),
        "clause_shorten": f"SELECT signal_id, {_clause('evidence', 8)} AS clause FROM site_signals WHERE evidence IS NOT NULL",
        "phrase_shorten": f"WITH p AS (SELECT row_idx, {plain('company_description')} AS t FROM leads WHERE company_description IS NOT NULL) SELECT row_idx, {_shortened('t', 5)} AS short FROM p",
        "generic_focus": _generic(),
        "text_counts": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN len(regexp_extract_all(regexp_replace(text, '[\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}]', 'a', 'g'), '\\b[a''-]+\\b')) END AS n_words, length(regexp_replace(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^[ ,;:.-]+|[ ,;:.-]+$', '', 'g'), '\\s+([,;:])', '\\1', 'g')) AS tidy_length FROM documents",
        "digest_column": "SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 1500) AS digest FROM documents",
        "first_domain": f"SELECT row_idx, coalesce(nullif({domain(tail)}, ''), nullif({domain('website')}, ''), '') AS domain FROM leads",
        "angle_choice": f"SELECT signal_id, {_listed('signal_type', [('goods', ('product',)), ('people', ('audience', 'service')), ('open-b', ('positioning',))], repr('open-b'))} AS angle FROM site_signals",
        "persona_templates": f"WITH m AS (SELECT row_idx, {_RULES} AS priority FROM leads l WHERE job_title IS NOT NULL) SELECT row_idx, CASE h.persona WHEN 'Finance lead' THEN 't1' WHEN 'Owner' THEN 't1,t3' WHEN 'Operations lead' THEN 't3' ELSE 't2,t4' END AS templates FROM m LEFT JOIN title_hooks h ON h.priority = m.priority",
        "status_class": f"SELECT row_idx, CASE coalesce({label('email_status')}, '') WHEN 'valid' THEN 'qualified' WHEN 'verified' THEN 'qualified' WHEN 'bounced' THEN 'excluded' ELSE 'review' END AS class FROM leads",
        "dedupe_by_fit": f"WITH {_GRADED}, w AS (SELECT row_idx, key, first_value(row_idx) OVER (PARTITION BY key ORDER BY outreach DESC, mail DESC, company DESC, contact DESC, copy DESC, row_idx) AS winner, count(*) OVER (PARTITION BY key) AS copies FROM graded WHERE key <> '') SELECT * FROM w WHERE copies > 1",
        "contact_sequencing": f"""WITH {_GRADED}, r AS (SELECT row_idx, domain, row_number() OVER (PARTITION BY domain ORDER BY outreach DESC, contact DESC, mail DESC, company DESC, copy DESC, title, {_SENIORITY}, row_idx) AS contact_rank, count(*) OVER (PARTITION BY domain) AS contact_count FROM graded WHERE domain <> '' AND outreach >= 2 AND copy > 0)
          SELECT *, CASE WHEN contact_rank = 1 THEN 'primary' ELSE 'later-wave' END AS status FROM r""",
        "ready_rows": f"WITH {_GRADED} SELECT row_idx FROM graded WHERE outreach = 3",
        "candidate_selection": f"""WITH {_CANDIDATES}, site AS (SELECT * FROM cand WHERE source = 'website'), st AS (SELECT row_idx, status FROM dom LEFT JOIN best USING (domain)),
          own AS (SELECT * FROM site QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY rule_id = 'generic-compression', priority, confidence DESC, pos) = 1),
          inp AS (SELECT * FROM cand WHERE source <> 'website' AND rule_id <> 'generic-compression' AND tier <> 'exclude'),
          grp AS (SELECT row_idx, rule_id, min(pos) AS a, min(priority) AS p, string_agg(substr(source, 7), ',' ORDER BY pos) AS fields FROM inp GROUP BY 1, 2 HAVING count(DISTINCT lower(source)) >= 2 QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY min(pos), min(priority)) = 1),
          pick AS (SELECT i.* EXCLUDE (pos), g.fields FROM inp i JOIN grp g USING (row_idx, rule_id) QUALIFY row_number() OVER (PARTITION BY i.row_idx ORDER BY i.pos, i.priority) = 1),
          anyone AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY pos, priority) = 1)
          SELECT st.row_idx, CASE WHEN o.row_idx IS NOT NULL THEN o.source WHEN st.status IN ('ok', 'no_signal') THEN NULL WHEN p.row_idx IS NOT NULL THEN p.source ELSE y.source END AS source,
            CASE WHEN o.row_idx IS NOT NULL THEN o.rule_id WHEN st.status IN ('ok', 'no_signal') THEN NULL WHEN p.row_idx IS NOT NULL THEN p.rule_id ELSE y.rule_id END AS rule_id,
            CASE WHEN o.row_idx IS NOT NULL OR st.status IN ('ok', 'no_signal') THEN '' WHEN p.row_idx IS NOT NULL THEN p.fields WHEN y.source LIKE 'input:%' THEN substr(y.source, 7) ELSE '' END AS fields
          FROM st LEFT JOIN own o USING (row_idx) LEFT JOIN pick p USING (row_idx) LEFT JOIN anyone y USING (row_idx)""",
        "corroborated_rules": f"WITH {_CANDIDATES} SELECT row_idx, rule_id, count(DISTINCT lower(source)) AS n_sources FROM cand WHERE source LIKE 'input:%' AND tier <> 'exclude' GROUP BY 1, 2 HAVING n_sources >= 2",
        "focus_gaps": f"""WITH {_FOCUS}, m AS (SELECT domain, signal_id, {_BY_RULE} AS k FROM site_signals s WHERE focus IS NOT NULL AND domain IS NOT NULL), f AS (SELECT domain, signal_id, coalesce(tier, 'unmatched') AS tier FROM m LEFT JOIN rules ON rules.i = m.k QUALIFY row_number() OVER (PARTITION BY domain ORDER BY signal_id) = 1),
          g AS (SELECT * FROM f WHERE tier IN ('unmatched', 'exclude')) SELECT tier, count(*) OVER (PARTITION BY tier) AS n, row_number() OVER (PARTITION BY tier ORDER BY signal_id) AS k, signal_id, domain FROM g QUALIFY k <= 25""",
        "batch_shares": f"WITH {_DOMAINS}, {_VALUES} SELECT kind, value, n, allowed, round(n / total, 4) AS share FROM over",
        "quality_flags": f"""WITH {_DOMAINS}, {_VALUES}, o AS (SELECT c.key, c.kind, c.p FROM cells c JOIN over v ON v.kind = c.kind AND v.value = c.value QUALIFY row_number() OVER (PARTITION BY c.kind, c.value ORDER BY sha256('quality-overflow:' || c.kind || ':' || c.value || ':' || c.key)) > greatest(v.allowed, 1)),
          f AS (SELECT key, string_agg(kind, '; ' ORDER BY p) AS flags FROM o GROUP BY key) SELECT row_idx, flags FROM dom JOIN f ON f.key = dom.domain""",
        "exact_pitch_capacity": f"""WITH k AS (SELECT company_domain AS key, arg_min({opening('text', 2)}, doc_id) AS pitch, arg_min(coalesce(source, ''), doc_id) AS angle FROM documents WHERE text IS NOT NULL AND company_domain IS NOT NULL GROUP BY 1),
          a AS (SELECT angle, count(*) AS c FROM k GROUP BY 1), v AS (SELECT lower(pitch) AS value, count(*) AS n, arg_min(angle, key) AS angle FROM k WHERE pitch <> '' GROUP BY 1),
          x AS (SELECT value, n, greatest(floor((SELECT count(*) FROM k) * 0.01 + 1e-12), ceil(c / CASE angle WHEN 'mail' THEN 4 WHEN 'note' THEN 2 ELSE 1 END))::BIGINT AS allowed FROM v JOIN a USING (angle)) SELECT * FROM x WHERE n > greatest(allowed, 1)""",
        "evidence_choice": """WITH e AS (SELECT signal_id, status, observation, evidence, list_filter(list_transform(facts, lambda f: f.evidence), lambda x: x <> '') AS own FROM site_signals),
          j AS (SELECT *, CASE WHEN coalesce(len(own), 0) > 0 THEN own ELSE list_filter([evidence], lambda x: x <> '') END AS parts FROM e)
          SELECT signal_id, length(CASE WHEN coalesce(status, '') NOT IN ('ok', 'no_signal', 'redirect_mismatch') THEN '' WHEN regexp_matches(regexp_replace(coalesce(observation, ''), 'https?://[^\\s\\]<>]+', '', 'g'), '[\\pL\\pN]') THEN observation
            WHEN status = 'ok' THEN array_to_string(list_transform(list_filter(list_transform(parts, lambda x, i: {'x': x, 'first': list_position(parts, x) = i}), lambda y: y.first), lambda y: y.x), chr(10)) ELSE '' END) AS length FROM j""",
        "homepage_choice": f"""WITH p AS (SELECT fetch_id, {domain('url')} AS domain, CASE WHEN url LIKE 'https://www.%' THEN 2 WHEN url LIKE 'https://%' THEN 1 ELSE 3 END + CASE WHEN provider = 'firecrawl' THEN 3 ELSE 0 END AS attempt, coalesce(status_code BETWEEN 200 AND 299 AND trim(body) <> '', false) AS good FROM fetch_results),
          g AS (SELECT domain, max(good) AS found FROM p GROUP BY 1) SELECT p.domain, fetch_id, found FROM p JOIN g USING (domain) WHERE good = found QUALIFY row_number() OVER (PARTITION BY p.domain ORDER BY CASE WHEN found THEN attempt ELSE -attempt END, CASE WHEN found THEN fetch_id ELSE -fetch_id END) = 1""",
        "decision_match": f"""WITH {_DOMAINS}, {_FIRST_DOMAINS}, s AS (SELECT lower(trim(domain)) AS k, focus, status FROM site_signals WHERE domain IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(domain)) ORDER BY signal_id) = 1)
          SELECT domain, focus, status, CASE WHEN k IS NULL THEN 'not in the response' ELSE '' END AS error FROM fd LEFT JOIN s ON s.k = lower(trim(domain))""",
        "resume_pending": f"WITH {_DOMAINS}, {_FIRST_DOMAINS} SELECT domain FROM fd WHERE domain NOT IN (SELECT domain FROM site_signals WHERE status = 'ok' AND domain IS NOT NULL)",
        "usage_sums": "SELECT sum(pages_fetched)::BIGINT AS pages, sum(http_cache_hits)::BIGINT AS hits, count(*) FILTER (signal_cache_hit) AS cached, count(domain) - count(DISTINCT domain) AS avoided FROM site_signals",
        "cohort_counts": f"SELECT pool, variant, count(*) AS companies FROM ({core['pool_balanced_variants']}) GROUP BY 1, 2",
        "usage_totals": "SELECT event_type, count(*) AS calls, count(*) FILTER (value > 50) AS large, sum(round(value * 100)::BIGINT)::BIGINT AS hundredths FROM events GROUP BY 1",
        "blocked_evidence": "SELECT signal_id FROM site_signals WHERE evidence IS NOT NULL AND NOT regexp_matches(lower(evidence), 'cookies|accept all|all rights reserved')",
        "assigned_variants": f"WITH {_DOMAINS}, {_FIRST_DOMAINS}, v AS (SELECT domain, ((row_number() OVER (ORDER BY sha256('balance:' || domain)) - 1) % 5)::INT AS variant FROM fd) SELECT row_idx, variant FROM dom JOIN v USING (domain)",
        "row_facts": f"""WITH c AS ({core['fallback_unpivot']}), s AS ({_signal('c', 'row_idx, pos, header, value, confidence', 'value')})
          SELECT row_idx, header, confidence, signal_type, focus FROM s WHERE focus <> '' QUALIFY row_number() OVER (PARTITION BY row_idx, lower(focus), lower(value) ORDER BY pos) = 1""",
        "row_fingerprint": f"SELECT row_idx, sha256('company_name=' || coalesce({strip('company_name')}, '') || chr(31) || 'email=' || coalesce({strip('email')}, '') || chr(31) || 'website=' || coalesce({strip('website')}, '')) AS fingerprint FROM leads",
        "unfenced": f"SELECT signal_id, {strip('focus')} AS text FROM site_signals WHERE focus IS NOT NULL",
        "replay_join": "SELECT s.signal_id * 3 AS row_idx, status, email IS NOT NULL AS found FROM site_signals s LEFT JOIN leads l ON l.row_idx = s.signal_id * 3",
        "delivery_ledger": f"WITH RECURSIVE {_LEDGER} SELECT * FROM ledger",
        "copy_review_queue": f"""WITH RECURSIVE {_LEDGER}, m AS (SELECT l.row_idx, coalesce(job_department, '') AS job_department, coalesce(list_source, '') AS list_source, {_RULES} AS priority FROM leads l JOIN ledger USING (row_idx) WHERE status = 'included')
          SELECT job_department, coalesce(persona, '') AS persona, list_source, min(row_idx) AS row_idx FROM m LEFT JOIN title_hooks h ON h.priority = m.priority GROUP BY 1, 2, 3""",
        "number_text": "SELECT event_id, coalesce(printf('%.2f', value), '') AS text, greatest(0, least(1, coalesce(value / 100, 0)))::DOUBLE AS share FROM events",
        "context_map": f"WITH {_DOMAINS} SELECT row_idx, 'domain,row_idx,title,web_site' AS names, coalesce(upper(job_title), '') AS title, coalesce(website, '') AS site, 'https://' || domain AS domain FROM dom",
        "record_json": "SELECT signal_id, signal_id % 5 NOT IN (0, 1) AND status IS NOT NULL AS parsed, CASE WHEN signal_id % 5 NOT IN (0, 1) AND status IS NOT NULL THEN coalesce(focus, '') ELSE '' END AS focus, CASE WHEN signal_id % 5 NOT IN (0, 1) AND status IS NOT NULL THEN coalesce(pages_fetched, 0) ELSE 0 END AS pages FROM site_signals",
    }
