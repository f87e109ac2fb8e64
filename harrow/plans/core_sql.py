"""SQL, as DuckDB runs it, for the queries of the general problems."""

from __future__ import annotations

#: Written out here as well, so that the statement does not share a mistake with the operator.
_WORDS = (
    "n/a", "n.a", "na", "none", "null", "nil", "nan", "unknown", "tbd", "tba", "tbc", "x", "xx", "xxx", "to be confirmed", "to be announced", "to be determined",
    "not available", "not applicable", "not provided", "not known", "missing", "empty", "blank", "undefined", "no value", "no data",
)
_INV = r"\s\p{Z}\p{Cf}\x{0085}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}"
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"
_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rejected() -> str:
    words = ", ".join(_q(w) for w in _WORDS)
    tight = ", ".join(_q(w.replace(" ", "")) for w in _WORDS)
    return rf"""
WITH f AS (SELECT *, regexp_escape(delim_char) AS d, string_split(header_line, delim_char) AS h FROM lead_files),
g AS (SELECT *, '(?:"[^"]*(?:""[^"]*)*"|[^"' || d || '\r\n]*)' AS field FROM f),
r AS (SELECT line_id, raw_line, g.*, list_position(h, 'Email') AS e, list_position(h, 'Company name') AS c FROM raw_leads LEFT JOIN g USING (file_id)),
p AS (SELECT *, regexp_full_match(raw_line, field || '(?:' || d || field || ')*') AS quoted,
  regexp_extract_all(delim_char || raw_line, d || '(' || field || ')', 1) AS cells FROM r),
v AS (SELECT *, CASE WHEN cells[e] LIKE '"%' THEN replace(substr(cells[e], 2, length(cells[e]) - 2), '""', '"') ELSE cells[e] END AS mail,
  CASE WHEN cells[c] LIKE '"%' THEN replace(substr(cells[c], 2, length(cells[c]) - 2), '""', '"') ELSE cells[c] END AS name FROM p),
n AS (SELECT *, lower(regexp_replace(name, '^[{_INV}]+|[{_INV}]+$', '', 'g')) AS low,
  lower(regexp_replace(regexp_replace(name, '[{_INV}]+', ' ', 'g'), '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g')) AS bare FROM v)
SELECT line_id, CASE
  WHEN raw_line IS NULL OR field IS NULL THEN 'column_count'
  WHEN NOT quoted THEN 'quoting'
  WHEN len(cells) <> len(h) THEN 'column_count'
  WHEN NOT regexp_full_match(regexp_replace(mail, '^[{_INV}]+|[{_INV}]+$', '', 'g'), '(?:[^@{_INV}]+@{_HOST})?') THEN 'email'
  ELSE 'company_name' END AS reason
FROM n WHERE raw_line IS NULL OR field IS NULL OR NOT quoted OR len(cells) <> len(h)
  OR NOT regexp_full_match(regexp_replace(mail, '^[{_INV}]+|[{_INV}]+$', '', 'g'), '(?:[^@{_INV}]+@{_HOST})?')
  OR bare = '' OR bare IN ({words}) OR replace(bare, ' ', '') IN ({tight}) OR NOT regexp_matches(name, '\pL') OR regexp_matches(name, '\x{{FFFD}}|[\x00-\x09\x0B\x0C\x0E-\x1F\x7F-\x9F]')
  OR low IN ('true', 'false', 'yes', 'no') OR regexp_full_match(low, '#[a-z0-9/]+[!?]?')
  OR regexp_full_match(low, '[+-]?[\d.,'' ]+(?:e[+-]?\d+|[%a-z€$£]{{1,3}})?')
  OR regexp_full_match(low, '\d{{1,2}}[. -]+(?:{_MONTHS})[a-z]*[. -]+\d{{2,4}}|(?:{_MONTHS})[a-z]*[. -]+\d{{1,2}}[, -]+\d{{2,4}}')
  OR regexp_full_match(low, '[^\s@]+@[^\s@]+') OR regexp_full_match(low, '(?:[a-z]+:)?//\S+|www\.\S+|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|org|net|example|io|de|fr|es|eu|uk|co)(?:[/?:]\S*)?')
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": _rejected()}
