from __future__ import annotations

import re

import pytest

from harrow.operators.row_parse import RowSchema, loaded_rows, parse_rows

FILES = [(1, "a.csv", ",", "Email,Company name,Website"), (2, "b.csv", "|", "First name|Email|Company name"), (3, "c.tsv", "\t", "Name\tCity")]

CASES = [
    (1, "a@b.example,Acme Foods,w", None),
    (1, '"a@b.example","Acme, ""Foods""\nInc",w', None),
    (1, ' a@b.example ,"A",', None),
    (1, 'a@b.example,Ac"me,w', "quoting"),
    (1, 'a@b.example,"Acme,w', "quoting"),
    (1, 'a@b.example,"Acme" x,w', "quoting"),
    (1, "a@b.example,Acme\nFoods,w", "quoting"),
    (1, "a@b.example,Acme", "column_count"),
    (1, "a@b.example,Acme,w,", "column_count"),
    (1, "", "column_count"),
    (1, ",Acme,w", None),
    (1, " ,Acme,w", None),
    (1, '"",Acme,w', None),
    (1, '" \n",Acme,w', None),
    (1, "\u00a0\u200b,Acme,w", None),
    (2, "x||Acme", None),
    (1, ",N/A,w", "company_name"),
    (1, ",,w", "company_name"),
    (1, "n/a,Acme,w", "email"),
    (1, "-,Acme,w", "email"),
    (1, "a b@c.example,Acme,w", "email"),
    (1, "a@b@c.example,Acme,w", "email"),
    (1, "a@example,Acme,w", "email"),
    (1, "a@-b.example,Acme,w", "email"),
    (1, "a@b-.example,Acme,w", "email"),
    (1, "a@b_c.example,Acme,w", "email"),
    (1, "a@b--c.example,Acme,w", None),
    (1, "a@b.example,,w", "company_name"),
    (1, "a@b.example,N/A,w", "company_name"),
    (1, "a@b.example,#REF!,w", "company_name"),
    (1, "a@b.example,TRUE,w", "company_name"),
    (1, "a@b.example,12.5,w", "company_name"),
    (1, "a@b.example,2024-05-01,w", "company_name"),
    (1, "a@b.example,www.x.example,w", "company_name"),
    (1, "a@b.example,me@x.example,w", "company_name"),
    (1, "a@b.example,Ac�me Foods,w", "company_name"),
    (1, "a@b.example,Acme\x07,w", "company_name"),
    (1, "a@b.example,3Acme Foods,w", None),
    (1, "a@b.example,“Acme” Foods,w", None),
    (2, "|a@b.example|Acme", None),
    (2, 'x|"a@b.example"|"Acme | Co"', None),
    (3, "anything\tgoes", None),
    (9, "a@b.example,Acme,w", "column_count"),
    (1, None, "column_count"),
    (None, "a@b.example,Acme,w", "column_count"),
    (1, "a@b.example,Acme " + "x" * 200_000 + ",w", None),
    (1, 'a@b.example,"' + '""' * 50_000 + 'Acme",w', None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(i, f, r, "clash") for i, (f, r, _) in enumerate(CASES)], "line_id long, file_id int, raw_line string, email string")
    files = spark.createDataFrame(FILES, "file_id int, file_name string, delim_char string, header_line string")
    return rows, files


def test_reasons(parsed):
    rows, files = parsed
    got = {r.line_id: r.parse_reason for r in parse_rows(rows, files).select("line_id", "parse_reason").collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES)}


def test_loaded_fields(parsed):
    rows, files = parsed
    got = {r.line_id: r for r in loaded_rows(rows, files, ["Email", "Company name", "City"]).collect()}
    at = {line: i for i, (_, line, _) in enumerate(CASES)}
    assert set(got) == {i for i, (_, _, want) in enumerate(CASES) if want is None}
    assert got[1].company_name == 'Acme, "Foods"\nInc'
    quoted = got[at['x|"a@b.example"|"Acme | Co"']]
    assert (quoted.email, quoted.company_name) == ("a@b.example", "Acme | Co")
    other = got[at["anything\tgoes"]]
    assert (other.email, other.city) == (None, "goes")


def test_patterns_are_anchored_and_growing():
    schema = RowSchema.of(";", "A;Email;Company name")
    assert re.fullmatch(r"A|Email|Company name", schema.header[0])
    assert schema.position("email") == 1 and schema.position("none") is None
    assert schema.whole_row("Email", "Company name").startswith(r"\A") and schema.whole_row("Email", "Company name").endswith(r"\z")
