from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from harrow.functions import text as T
from harrow.functions.hashing import sha_mod
from harrow.functions.missing import is_blank, is_stand_in


def values(spark, make, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("make", "inputs", "wanted"),
    [
        (T.header_key, [" Job Title ", "E-mail (work)", None], ["job_title", "e_mail_work", None]),
        (T.domain_of, ["https://WWW.Acme.example:443/a?b", "acme.example/x", "user@acme.example", "//acme.example", "", None, "www.www.x.example."], ["acme.example", "acme.example", "acme.example", "", "", "", "www.x.example"]),
        (T.email_syntax_ok, ["a.b+c@x-y.example", "a..b@x.example", ".a@x.example", "a@x", "a@@x.example", None, "x" * 65 + "@x.example"], [True, False, False, False, False, False, False]),
        (T.given_name, ["Dr. Ana", "  mr ,José ", "1Bob", "--", None], ["Ana", "José", "Bob", "", ""]),
        (T.brand_name, ["Acme Trading Co (ATC) Ltd", "Big River Foods & Ltd", "One | Two", "A B C D E Inc."], ["ATC", "Big River Foods", "One", "A B C D"]),
        (lambda c: T.opening_words(c, 2), ["Hello, World again", "", None], ["hello world", "", None]),
        (T.word_total, ["piqué d'été well-known", ""], [3, 0]),
        (T.sentences, ["One. Two!  Three", " - "], [["One.", "Two!", "Three"], []]),
        (T.url_normal, ["HTTP://Acme.example:80#x", "https://a.example:8443/p?q=1#f", "ftp://a.example", None], ["http://acme.example/", "https://a.example:8443/p?q=1", None, None]),
        (T.brand_hint, ["acmeservices.example", "abco.example"], ["acme" + "services", "abco"]),
        (lambda c: T.first_phrase(c, ("b c", "a")), ["A b C", "xa", "q", None], ["b c", "a", "", None]),
        (T.lower_but_acronyms, ["CEO Of IT dept"], ["CEO of IT dept"]),
        (T.tidy, [" a ,  b; ."], ["a, b"]),
        (T.evidence_flaw, ["two words", "we use cookies on this fine site", "home about us contact", "a real piece of evidence"], ["short", "notice", "navigation", ""]),
        (is_stand_in, ["n/a", "T B D", "Unknown.", "real", None, "..."], [True, True, True, False, True, True]),
        (is_blank, [" ​ ", "", None, "x"], [True, True, True, False]),
    ],
)
def test_values(spark, make, inputs, wanted):
    got = values(spark, make, inputs)
    assert got == wanted


def test_brand_hint_keeps_five(spark):
    assert values(spark, T.brand_hint, ["northstarservices.example", "abcdservice.example"]) == ["northstar", "abcdservice"]


def test_same_site(spark):
    df = spark.createDataFrame([("acme.example", "www.acme.example"), ("acme.example", "shop.acme.example"), ("northstar.example", "northstargroup.example"), ("abc.example", "xyz.example")], "a string, b string")
    assert [r.v for r in df.select(T.same_site(F.col("a"), F.col("b")).alias("v")).collect()] == [True, True, True, False]


def test_shared_runs(spark):
    df = spark.createDataFrame([("a b c d", "x B C D y"), ("a b", "a b"), (None, "a")], "a string, b string")
    assert [r.v for r in df.select(T.shares_run(F.col("a"), F.col("b"), 3).alias("v")).collect()] == [True, False, False]


def test_rendered(spark):
    df = spark.createDataFrame([("Ana", None)], "n string, m string")
    assert df.select(T.rendered("Hi {{ n }}{{m}} {x}", {"n": F.col("n"), "m": F.col("m")}).alias("v")).first().v == "Hi Ana {x}"
    with pytest.raises(KeyError, match="q, z"):
        T.rendered("{{ z }} {{ q }}", {})


def test_sha_mod(spark):
    keys = ["northstar.example", "a", ""]
    for n in (5, 7, 1000):
        assert values(spark, lambda c, n=n: sha_mod(c, n), keys) == [int(hashlib.sha256(k.encode()).hexdigest(), 16) % n for k in keys]
