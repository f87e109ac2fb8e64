"""Pairs of strings within two edits, found by what they have in common with up to two letters taken out.

Each edit takes one letter at most from each of two strings, so strings within two edits have a
form in common in which each lacks two letters at most. The forms of a whole string are as
telling as the string itself: however many strings there are, those that share a form are within
four edits of each other. (Keys of a part are shared by ever more strings as a table grows.)

Forms are never written out. They are hashed for a whole batch at once, from sums over the
letters before, between and behind those taken out, dealt to buckets by their hash, and packed as
32 bits each with the strings of their batch beside them. A bucket is sorted and its pairs are
compared letter by letter, so equal hashes of different forms change nothing. Buckets are taken in
rounds of bounded size, whose shuffle files are released before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edit_tree import distance

#: Letters up to which a string's forms are few enough (301); longer ones are found by keys of their ends.
LONGEST = 24
#: Forms in a bucket, which one task holds, and in a round, whose shuffle files exist at one time.
BUCKET_FORMS, ROUND_FORMS = 2_000_000, 1 << 27
#: Strings that are hashed and packed together; fits the 14 bits beside the number of letters taken out.
PIECE = 8192
#: Pairs that are compared at one time.
COMPARED = 100_000

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_BACK, _BACK_TWICE = (np.uint64(pow(int(_BASE), -k, 1 << 64)) for k in (1, 2))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def letters_out(n: int) -> int:
    """Letters that are taken out of a string of n letters: strings of fewer than ten are found with one edit."""
    return 0 if n < 4 else 1 if n < 10 else 2


def forms_of(n: int) -> int:
    """How many forms a string of n letters has, itself included."""
    return (0, n + 1, 1 + n + n * (n - 1) // 2)[letters_out(n)]


def _mixed(h: np.ndarray, letters: int) -> np.ndarray:
    h = h + np.uint64(letters * int(_STEP) % (1 << 64))
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def form_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """The hashes of the forms of strings of one length (rows of code points), by the number of letters taken out."""
    count, n = codes.shape
    power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE)], dtype=np.uint64)
    letter = (codes.astype(np.uint64) + np.uint64(1)) * _STEP
    letter = (letter ^ (letter >> np.uint64(31))) * _MIX * power
    upto = np.zeros((count, n + 1), dtype=np.uint64)
    np.cumsum(letter, axis=1, out=upto[:, 1:])
    whole = upto[:, -1:]
    out = [_mixed(whole, n), _mixed(upto[:, :-1] + (whole - upto[:, 1:]) * _BACK, n - 1)]
    if letters_out(n) == 2:
        i, j = np.triu_indices(n, 1)
        out.append(_mixed(upto[:, i] + (upto[:, j] - upto[:, i + 1]) * _BACK + (whole - upto[:, j + 1]) * _BACK_TWICE, n - 2))
    return out


def _codes(texts: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(texts), n)


def packed_forms(texts: list[str], counts: np.ndarray, buckets: int, rounds: int, part: int) -> Iterator[tuple]:
    """(bucket, hashes, places, texts, counts) of the forms of PIECE texts at most; a place is that of the text and, in the upper two bits, the letters taken out."""
    lengths = np.array([len(t) for t in texts])
    found = []
    for n in np.unique(lengths):
        if not letters_out(n):
            continue
        rows = np.flatnonzero(lengths == n)
        for out, h in enumerate(form_hashes(_codes([texts[r] for r in rows], int(n)))):
            bucket = (h >> np.uint64(34)) % np.uint64(buckets)
            place = np.broadcast_to((rows.astype(np.uint64) | np.uint64(out << 14))[:, None], h.shape)
            entry = (bucket << np.uint64(48)) | ((h & np.uint64(0xFFFFFFFF)) << np.uint64(16)) | place
            found.append(entry[bucket % np.uint64(rounds) == part] if rounds > 1 else entry.ravel())
    if not found:
        return
    entries = np.unique(np.concatenate(found))
    bucket = (entries >> np.uint64(48)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
        place = (entries[a:b] & np.uint64(0xFFFF)).astype(np.uint16)
        held, at = np.unique(place & np.uint16(0x3FFF), return_inverse=True)
        place = (place & np.uint16(0xC000)) | at.astype(np.uint16)
        yield int(bucket[a]), ((entries[a:b] >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), place.tobytes(), "\n".join([texts[k] for k in held]), counts[held].astype(np.int64).tobytes()


class _Letters:
    """Strings as padded matrices of code points, aligned at the left and at the right."""

    def __init__(self, texts: list[str]) -> None:
        self.lengths = np.array([len(t) for t in texts], dtype=np.int16)
        width = int(self.lengths.max(initial=1))
        self.left = _codes([t.ljust(width, "\0") for t in texts], width)
        self.right = _codes([t.rjust(width, "\0") for t in texts], width)

    def compared(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of different strings: whether they are one edit apart, and whether they have one length and differ in two places."""
        n, m = self.lengths[a], self.lengths[b]
        x, y = self.left[a], self.left[b]
        differ = x != y
        places = differ.sum(axis=1)
        first = differ.argmax(axis=1)
        behind = (self.right[a] != self.right[b])[:, ::-1].argmax(axis=1)
        rows, second = np.arange(len(a)), np.minimum(first + 1, x.shape[1] - 1)
        swap = (places == 2) & (first + behind == n - 2) & (x[rows, first] == y[rows, second]) & (x[rows, second] == y[rows, first])
        same = n == m
        shorter = np.minimum(n, m)
        return np.where(same, (places == 1) | swap, (abs(n - m) == 1) & (first + behind >= shorter)), same & (places == 2) & ~swap


def near_in_bucket(part: pd.DataFrame) -> pd.DataFrame:
    """(core, n, to, m, d) of the pairs within the edits allowed that meet in a bucket."""
    texts: list[str] = []
    owners, outs = [], []
    for place, held in zip(part["places"], part["texts"], strict=True):
        p = np.frombuffer(place, dtype=np.uint16)
        owners.append((p & np.uint16(0x3FFF)).astype(np.int64) + len(texts))
        outs.append((p >> np.uint16(14)).astype(np.int8))
        texts += held.split("\n")
    counts = np.concatenate([np.frombuffer(c, dtype=np.int64) for c in part["counts"]])
    key = np.concatenate([np.frombuffer(h, dtype=np.uint32) for h in part["hashes"]])
    order = np.argsort(key, kind="stable")
    key, owner, out = key[order], np.concatenate(owners)[order], np.concatenate(outs)[order]
    same = np.r_[key[1:] == key[:-1], False]
    shared = same | np.r_[False, same[:-1]]
    key, owner, out = key[shared], owner[shared], out[shared]
    used, owner = np.unique(owner, return_inverse=True)
    texts, counts = [texts[u] for u in used], counts[used]
    letters = _Letters(texts)
    one: list[np.ndarray] = []
    two: list[np.ndarray] = []
    asked: list[np.ndarray] = []
    at, apart, total = np.arange(len(key)), 1, np.int64(max(1, len(texts)))
    while True:  # each with the one so many places behind it that shares its form
        at = at[at + apart < len(key)]
        at = at[key[at] == key[at + apart]]
        if not len(at):
            break
        for k in range(0, len(at), COMPARED):
            i = at[k : k + COMPARED]
            j = i + apart
            a, b, most = owner[i], owner[j], np.maximum(out[i], out[j])
            kept = a != b
            a, b, most = np.minimum(a, b)[kept], np.maximum(a, b)[kept], most[kept]
            single, double = letters.compared(a, b)
            pair = a * total + b
            one.append(pair[single & (most < 2)])  # with two letters out they would be met again and again
            two.append(pair[~single & ((most < 2) | double)])
            asked.append(pair[~single & (most == 2) & ~double])
        apart += 1
    rows = []
    joined = lambda parts: np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.int64)
    for d, pairs in ((1, joined(one)), (2, joined(two)), (0, joined(asked))):
        for a, b in zip((pairs // total).tolist(), (pairs % total).tolist(), strict=True):
            x, y, n, m = texts[a], texts[b], counts[a], counts[b]
            if n > m or n == m and x < y:
                x, y, n, m = y, x, m, n
            if len(x) < 6 or d != 1 and len(x) < 10:
                continue
            if d or distance(x, y) == 2:
                rows.append((x, n, y, m, d or 2))
    return pd.DataFrame(rows, columns=["core", "n", "to", "m", "d"])


def near_rounds(cores: DataFrame, forms: int) -> Iterator[DataFrame]:
    """(core, n, to, m, d) of cores up to LONGEST letters, in rounds; ``forms``: how many they have together. A pair may come more than once."""
    tasks = cores.sparkSession.sparkContext.defaultParallelism
    rounds = -(-forms // ROUND_FORMS)
    buckets = min(65_535, max(4 * tasks, -(-forms // BUCKET_FORMS)))
    short = cores.where(F.length("core").between(4, LONGEST)).select("core", "n")
    for part in range(rounds):

        def packed(batches: Iterator[pd.DataFrame], part: int = part) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts, counts = batch["core"].tolist(), batch["n"].to_numpy()
                for k in range(0, len(texts), PIECE):
                    rows = list(packed_forms(texts[k : k + PIECE], counts[k : k + PIECE], buckets, rounds, part))
                    yield pd.DataFrame(rows, columns=["bucket", "hashes", "places", "texts", "counts"])

        dealt = short.mapInPandas(packed, "bucket int, hashes binary, places binary, texts string, counts binary")
        yield dealt.groupBy("bucket").applyInPandas(near_in_bucket, "core string, n long, to string, m long, d int")
