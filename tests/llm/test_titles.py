from __future__ import annotations

import random

import pytest

from harrow.llm.edit_tree import EditTree, distance
from harrow.llm.title_map import TitleIndex, map_titles

ENTRIES = [(10, "owner"), (10, "founder"), (10, "co-founder"), (20, "chief executive officer"), (20, "ceo"), (20, "managing director"), (40, "vp sales"), (40, "head of sales"), (40, "sales director"), (80, "chief information officer"), (80, "it director"), (80, "head of it"), (170, "logistics director"), (240, "head of learning and development"), (220, "head of research and development"), (340, "store manager")]


def slow_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein by the textbook table."""
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    last: dict[str, int] = {}
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, l = last.get(b[j - 1], 0), match
            if a[i - 1] == b[j - 1]:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, l - 1] + (i - k - 1) + 1 + (j - l - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_tree_finds_what_brute_force_finds():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    tree = EditTree(words)
    queries = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    for q, hits in zip(queries, tree.within(queries, [2] * len(queries)), strict=True):
        want = {w for w in set(words) if slow_distance(q, w) <= 2}
        assert {tree.words[n] for _, n in hits} == want
        assert all(d == slow_distance(q, tree.words[n]) for d, n in hits)
        assert all(distance(q, w) == slow_distance(q, w) for w in words[:20])


@pytest.fixture(scope="module")
def index():
    return TitleIndex(ENTRIES, 990)


@pytest.mark.parametrize(
    ("title", "priority"),
    [
        ("Owner", 10), ("OWNER.", 10), ("co founder", 10), ("Cofounder – DACH", 10), ("C.E.O.", 20), ("Interim CEO, parental cover", 20), ("Managing Dirctor", 20), ("Director, Managing", 20),
        ("chief executve oficer", 20), ("Geschäftsführerin", 20), ("Head of IT", 80), ("heda of it", 80), ("IT-Leiter", 80), ("hd of sales", 40), ("Sales (Head of)", 40), ("SVP, Sales", 40),
        ("Logistics_Director", 170), ("Dir. Logistics", 170), ("Store manager / Owner", 10), ("head of l&d", 240), ("Head of R & D", 220), ("Head Of Learning And Deve...", 240), ("logistics dire…", 170),
        ("Stage Manager", 990), ("Owner's nephew", 990), ("Dog owner", 990), ("Assistant to the CEO", 990), ("PA to Managing Director", 990), ("Head Chef", 990), ("Funeral Director", 990),
        ("n/a", 990), ("x" * 50_000, 990), ("???", 990), ("Head of...", 990),
    ],
)
def test_titles(index, title, priority):
    assert index.look_up([title]) == [priority]


def test_order_of_a_batch_does_not_matter(index):
    titles = ["Ownr", "sales directro", "managing directer", "store manger", "Owner & store manager"]
    assert index.look_up(titles) == [index.look_up([t])[0] for t in titles] == index.look_up(titles[::-1])[::-1]


def test_frame(spark):
    hooks = spark.createDataFrame([(10, "owner|founder", "o"), (99, ".*", "z"), (None, "x", "y")], "priority int, title_pattern string, persona string")
    df = spark.createDataFrame([("Owner", 1), ("Owner", 2), (" ​", 3), (None, 4), ("cook", 5)], "job_title string, title_priority int")
    assert [r.title_priority for r in map_titles(df, hooks).collect()] == [10, 10, None, None, 99]
    none = map_titles(df, hooks.where("priority = 10"))
    assert [r.title_priority for r in none.collect()] == [10, 10, None, None, None]
