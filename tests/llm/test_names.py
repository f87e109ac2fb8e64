from __future__ import annotations

import random

import pytest

from harrow.llm import near_cores
from harrow.llm.edit_tree import distance
from harrow.llm.names import asked_keys, asked_parts, candidate_pairs, edit_kinds, nearest, own_keys, own_parts, parsed, spelling_classes, spelling_pairs


@pytest.mark.parametrize(
    ("name", "core", "business"),
    [
        ("Stavvukbim Baltut Logistics Ltd", "stavvukbimbaltut", ["logistics"]), (" the Stávvukbim  Baltut Log. Limited (SBL)", "stavvukbimbaltut", ["logistics"]), ("Baltut, Stavvukbim Txtls LLC", "stavvukbimbaltut", ["textiles"]),
        ("StavvukbimBaltut Services", "stavvukbimbaltut", ["services"]), ("d0xfugbal & fikgub recruitment", "doxfugbalfikgub", ["recruitment"]), ("Acme", "acme", []),
        ("n/a", "", []), ("Freelance", "", []), ("self employed", "", []), ("", "", []), ("12345", "", []), ("---", "", []),
    ],
)
def test_parsed(name, core, business):
    got = parsed(name)
    assert (got[0], got[3]) == (core, business)


def test_pairs(spark):
    names = ["Stavvukbim Baltut Logistics Ltd"] * 9 + ["Stavvukbim Baltut"] + ["stavvykbim baltut logistics"] * 2 + ["Stavvukbim B. Logistics", "Stavvukbim Baltut Dental"] + ["Kidbokpiv Dittin Robotics"] * 3 + ["Kidbokpiv-Ditin Robotics AB", "n/a", "N/A", None, " ", "Zzz" + "q" * 5000]
    df = spark.createDataFrame([(n, "clash") for n in names], "company_name string, name string")
    pairs = {(r.name_a, r.name_b) for r in spelling_pairs(df).collect()}
    one = ["Stavvukbim B. Logistics", "Stavvukbim Baltut", "Stavvukbim Baltut Logistics Ltd", "stavvykbim baltut logistics"]
    two = ["Kidbokpiv Dittin Robotics", "Kidbokpiv-Ditin Robotics AB"]
    assert pairs == {(a, b) for group in (one, two) for a in group for b in group if a < b}
    classes = {r.name: (r.canonical, r.spellings) for r in spelling_classes(df).collect()}
    assert classes["stavvykbim baltut logistics"] == ("Stavvukbim Baltut Logistics Ltd", 4)
    assert classes["Stavvukbim Baltut Dental"] == ("Stavvukbim Baltut Dental", 1)


def test_ties_join(spark):
    df = spark.createDataFrame([("Kidbokpiv Dittin Robotics",), ("Kidbokpiw Dittin Robotics",)], "company_name string")
    assert [tuple(r) for r in spelling_pairs(df).collect()] == [("Kidbokpiv Dittin Robotics", "Kidbokpiw Dittin Robotics")]


def edited(text: str, rng: random.Random) -> str:
    i, c, kind = rng.randrange(len(text)), rng.choice("abcdeo"), rng.random()
    return text[:i] + (c + text[i + 1 :] if kind < 0.25 else c + text[i:] if kind < 0.5 else text[i + 1 :] if kind < 0.75 else text[i + 1 : i + 2] + text[i : i + 1] + text[i + 2 :])


def test_no_near_core_is_missed():
    rng = random.Random(3)
    for _ in range(3000):
        s = "".join(rng.choice("abcdeo") for _ in range(rng.randint(6, 60 if rng.random() < 0.2 else 22)))
        t = edited(s, rng)
        t = edited(t, rng) if len(s) >= 10 and rng.random() < 0.7 else t
        if len(t) < 4 or not 0 < distance(s, t) <= (2 if len(s) >= 10 else 1):
            continue
        met = set(own_keys(t)) & set(asked_keys(s))
        assert met, (s, t)
        assert any(k[0] == "W" or set(own_parts(t, k)) & set(asked_parts(s, k)) for k in met), (s, t)


def test_keys_that_many_share(spark):
    rng = random.Random(5)
    cores = sorted({"stavvukbim" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(150)})
    df = spark.createDataFrame([(c, i + 1, "clash") for i, c in enumerate(cores)], "core string, n long, key string").select("core", "n")
    wanted = {(a, b) for i, a in enumerate(cores) for b in cores[i + 1 :] if distance(a, b) <= 2}
    for many in (5, 1000):
        assert {(r.core, r.to) for r in candidate_pairs(df, many=many).collect()} == wanted


def test_kinds_of_edits():
    pairs = [("abcd", "abdc"), ("abcd", "abcdd"), ("abcd", "abxcd"), ("abcd", "abxd"), ("abcd", "axcx"), ("abc", "bc"), ("abc", "abcx")]
    assert [edit_kinds(a, b) for a, b in pairs] == [["swap"], ["double"], ["letter"], ["other"], ["other"] * 2, ["letter"], ["letter"]]


def test_pairs_within_the_edits_allowed(spark, monkeypatch):
    rng = random.Random(7)
    cores = {"".join(rng.choice("abcdeö") for _ in range(rng.randint(4, 30))) for _ in range(60)}
    for c in sorted(cores):
        cores |= {edited(c, rng), edited(edited(c, rng), rng)}
    counted = {c: rng.randint(1, 3) for c in sorted(cores) if len(c) >= 4}
    df = spark.createDataFrame(list(counted.items()), "core string, n long")
    allowed = lambda d, core: d == 1 and len(core) >= 6 or d == 2 and len(core) >= 10
    wanted = {(a, b, d) for a, n in counted.items() for b, m in counted.items() if a != b and (m > n or m == n and b < a) and allowed(d := distance(a, b), a)}
    assert len(wanted) > 100
    assert {(r.core, r.to, r.d) for r in candidate_pairs(df).collect()} == wanted
    best = {r.core: r.m for r in nearest(df).where("d = 1").collect()}
    monkeypatch.setattr(near_cores, "ROUND_FORMS", 5000)  # in rounds, the same
    assert {(r.core, r.to, r.d) for r in candidate_pairs(df).collect()} == wanted
    assert {r.core: r.m for r in nearest(df).where("d = 1").collect()} == best


def test_crowded_cores_write_no_more(spark):
    rng = random.Random(11)
    cores = sorted({"stavvukb" + "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4)) for _ in range(1500)})

    def written() -> int:
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        candidate_pairs(spark.createDataFrame([(c, 1) for c in cores], "core string, n long")).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (written() - before) / len(cores) < 4000
