from __future__ import annotations

import base64
import random
from pathlib import Path

import pytest

from harrow.llm.encode import DEFAULT_FILE, PATTERN, ByteEncoder, with_ids
from harrow.llm.packing import Tier, pack, plan

pytestmark = pytest.mark.skipif(not Path(DEFAULT_FILE).exists(), reason="no tokenizer here")


@pytest.fixture(scope="module")
def ours():
    return ByteEncoder.from_lines(Path(DEFAULT_FILE).read_bytes())


@pytest.fixture(scope="module")
def theirs():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(DEFAULT_FILE).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_reference_encoder(ours, theirs, data):
    import pandas as pd

    texts = pd.read_parquet(f"{data}/documents.parquet").text.tolist()
    rng = random.Random(1)
    letters = [*"etaoin shrdlu'S\n\t", "é", "ß", "中", "😀", " ", "\x00", "\x85", "<|endoftext|>", "don't", "0123"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["a" * 3000, "ab" * 1500, "=" * 500, "😀" * 100, " " * 300 + "x", None, ""]
    assert ours.encode(texts) == [theirs.encode_ordinary(t) if t else [] for t in texts]


def test_frame(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in with_ids(df).orderBy("doc_id").collect()]
    assert got[1:] == [(2, []), (3, []), (3, [])] and len(got[0][1]) == 2


TIERS = [Tier(1, 10), Tier(2, 40), Tier(3, 100)]


def test_plan_places_every_item_and_fills():
    rng = random.Random(2)
    histogram: dict[int, int] = {}
    for _ in range(5000):
        s = rng.randint(1, 100)
        histogram[s] = histogram.get(s, 0) + 1
    placed: dict[int, int] = {}
    for p in plan(dict(histogram), TIERS):
        assert p.used <= TIERS[p.tier].capacity and p.times > 0
        floor = TIERS[p.tier - 1].capacity if p.tier else 0
        assert max(p.items) > floor
        for s, n in p.items.items():
            placed[s] = placed.get(s, 0) + n * p.times
    assert placed == histogram
    assert plan({}, TIERS) == []


def test_pack(spark):
    sizes = [(i, s) for i, s in enumerate([5] * 400 + [250, 30, 7, 0, 100, 101, 1] + [3] * 50)] + [(9999, None), (9999, None)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    got = pack(df, TIERS, group_calls=4, bucket_rows=50).toPandas()
    assert sorted(got.doc_id.unique()) == sorted({i for i, _ in sizes})
    held = got.dropna(subset=["call_no"])
    caps = {1: 10, 2: 40, 3: 100}
    used = held.groupby(["limit_id", "call_no"]).tokens.sum().reset_index()
    assert (used.tokens <= used.limit_id.map(caps)).all()
    assert used.tokens.sum() / used.limit_id.map(caps).sum() > 0.95
    split = held[held.part_no > 1].doc_id.unique()
    assert {dict(sizes)[i] for i in split} == {250, 101}
    assert (held.groupby("doc_id").tokens.sum() == held.groupby("doc_id").doc_id.first().map(dict(sizes))).all()
    assert got.call_no.isna().sum() == 3
    again = pack(df.repartition(5).orderBy("tokens"), TIERS, group_calls=4, bucket_rows=50).toPandas()
    order = ["doc_id", "part_no", "limit_id", "call_no"]
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
