"""ANSI SQL (as DuckDB runs it) for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from ..functions.missing import STAND_INS

#: White space and characters without width, for a character class.
_INV = r"\s\p{Z}\p{Cf}\x{0085}"
_OUTER = r"\p{Pi}\p{Pf}'\"`<>(){}\[\],;:.!*|\\"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _bare(c: str) -> str:
    tight = f"lower(regexp_replace({c}, {_q(f'[{_INV}]+')}, '', 'g'))"
    return f"regexp_replace({tight}, {_q(f'^[{_OUTER}]+|[{_OUTER}]+$')}, '', 'g')"


def _mail(c: str) -> str:
    t = f"regexp_replace({_bare(c)}, '^mailto:', '')"
    return f"CASE WHEN regexp_full_match({t}, '[^@/]+@[^@/.]+(\\.[^@/.]+)+') THEN {t} END"


def _web(c: str) -> str:
    t = f"regexp_replace({_bare(c)}, '^(https?:)?(//)?(www\\.)?', '')"
    place = f"regexp_replace(regexp_replace(regexp_extract({t}, '^([^?]*)', 1), '^([^/]*?):(80|443)(/|$)', '\\1\\3'), '[./]+$', '')"
    query = f"regexp_extract({t}, '\\?(.*)$', 1)"
    whole = f"CASE WHEN {query} = '' THEN {place} ELSE {place} || '?' || array_to_string(list_sort(string_split({query}, '&')), '&') END"
    return f"CASE WHEN regexp_full_match({place}, '[^@/.\\s]+(\\.[^@/.\\s]+)+(/.*)?') THEN {whole} END"


_CONTACT = f"""
raw AS (SELECT *, {_mail('email')} AS own_mail, {_web('website')} AS own_web, {_mail('website')} AS other_mail, {_web('email')} AS other_web FROM leads),
contact AS (
  SELECT *, coalesce(own_mail, other_mail) AS mail,
         coalesce(own_web, CASE WHEN email NOT LIKE '%@%' THEN other_web END) AS web
  FROM raw)
"""

P5_FOUND = f"""
WITH {_CONTACT},
g AS (SELECT row_idx, min(row_idx) OVER (PARTITION BY mail, web) AS first FROM contact
      WHERE email IS NOT NULL AND website IS NOT NULL AND mail IS NOT NULL AND web IS NOT NULL)
SELECT first AS row_idx_a, row_idx AS row_idx_b FROM g WHERE row_idx <> first
"""

P5_COPIES = f"""
WITH {_CONTACT},
g AS (SELECT row_idx, CASE WHEN email IS NOT NULL AND website IS NOT NULL AND mail IS NOT NULL AND web IS NOT NULL THEN mail || ' ' || web ELSE '#' || row_idx END AS k FROM contact)
SELECT min(row_idx) AS row_idx, count(*) AS copies FROM g GROUP BY k
"""


def _real(c: str) -> str:
    tight = f"lower(regexp_replace({c}, {_q(f'[{_INV}]+')}, '', 'g'))"
    bare = f"lower(regexp_replace(regexp_replace({c}, {_q(f'[{_INV}]+')}, ' ', 'g'), '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g'))"
    words, together = ", ".join(map(_q, STAND_INS)), ", ".join(_q(w.replace(" ", "")) for w in STAND_INS)
    return f"""({c} IS NOT NULL AND {bare} <> '' AND {bare} NOT IN ({words}) AND replace({bare}, ' ', '') NOT IN ({together})
      AND NOT regexp_full_match({tight}, '(?:asdf|sdfg|dfgh|qwert|werty|wertz|zxcv|xcvb|yxcv|hjkl|jkl|uiop)+[a-zö]{{0,4}}|(?:test|abc|xyz|foo|bar|dummy|sample|blah?|lorem)+\\d*')
      AND replace({tight}, substr({tight}, 1, 1), '') <> '' AND regexp_matches({tight}, '\\pL.*\\pL') AND NOT {_cut(c)})"""


def _cut(c: str) -> str:
    return f"regexp_matches(coalesce({c}, ''), {_q(f'(?:\\.{{3,}}|…)[{_INV}]*$')})"


P6_FOUND = f"""
WITH {_CONTACT},
s AS (SELECT list_source, min(trust_rank) AS t FROM list_sources WHERE list_source IS NOT NULL GROUP BY 1),
r AS (SELECT row_idx, mail, coalesce(t, 2147483647) AS tr, updated_at, {_real('job_title')} AS title,
        web IS NOT NULL AND NOT {_cut("CASE WHEN contains(website, '@') THEN email ELSE website END")} AS site
      FROM contact LEFT JOIN s USING (list_source) WHERE mail IS NOT NULL)
SELECT min(row_idx) AS row_idx,
  coalesce((list(row_idx ORDER BY tr, updated_at DESC, row_idx) FILTER (title))[1], 0) AS title_row_idx,
  coalesce((list(row_idx ORDER BY tr, updated_at DESC, row_idx) FILTER (site))[1], 0) AS website_row_idx
FROM r GROUP BY mail HAVING count(*) > 1
"""


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_FOUND, "p5_copies": P5_COPIES, "p6_found": P6_FOUND}
