"""The main body of pages, told from page furniture by a linear-chain conditional random field.

A page is a chain of leaf blocks (lines with visible text). Each block has features of its
markup (tag, the containers around it, link), of its wording (words, the first and last two,
length, closing character) and of its place. The field has two labels; its weights were
trained by ``train_boilerplate`` on labelled pages and are kept in ``boilerplate_model.json``.
Blocks are labelled jointly by the Viterbi algorithm. A page that shows an error, filler or
a demand for scripts instead of content has no main body.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import once
from .page_words import FURNITURE, MENU_WORDS, NEUTRAL, is_filler, is_menu, is_notice
from .pages import Block, blocks_of, plain_blocks

MODEL_FILE = Path(__file__).with_name("boilerplate_model.json")

_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*|\d+|[^\w\s]")
#: The same for lower case ASCII, for which sets of letters are faster than classes.
_PLAIN_TOKEN = re.compile(r"[a-z]+(?:['-][a-z]+)*|[0-9]+|[^\w\s]")
#: The same once more as bytes: lower case with 0 for digits and a gap for _, and what is no sign.
_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789_", b"abcdefghijklmnopqrstuvwxyz000000000 ")
_NO_SIGNS = bytes(c for c in range(128) if chr(c).isalnum() or chr(c).isspace() or chr(c) in "_-'")


def _size(n: int) -> int:
    """The class of a number of tokens."""
    return 0 if n < 2 else 1 if n < 4 else 2 if n < 7 else 3 if n < 11 else 4 if n < 20 else 5


def _end(text: str) -> str:
    """The class of a text's closing character."""
    return text[-1] if not text[-1].isalnum() else "0" if text[-1].isdigit() else "a"


def joins(sign: str, low: str) -> bool:
    """Whether each ``sign`` in a text stands between two letters or digits."""
    last = len(low) - 1
    at = low.find(sign)
    while at >= 0:
        if not (0 < at < last and low[at - 1].isalnum() and low[at + 1].isalnum()):
            return False
        at = low.find(sign, at + 1)
    return True


def _alone(low: str) -> bool:
    """Whether no 0 in a text stands beside a letter, or a sign that may join words."""
    at = low.find("0")
    while at >= 0:
        before, after = low[at - 1 : at], low[at + 1 : at + 2]
        if before.isalpha() or after.isalpha() or before in ("-", "'") or after in ("-", "'"):
            return False
        at = low.find("0", at + 1)
    return True


def tokens_of(text: str) -> list[str]:
    """The words, numbers (as 0) and signs of a text, lower case."""
    if not text.isascii():
        low = _DIGITS.sub("0", text.lower())
        return (_PLAIN_TOKEN if low.isascii() else _TOKEN).findall(low)
    raw = text.encode()
    low = raw.translate(_LOW).decode()
    if "0" in low:
        while "00" in low:
            low = low.replace("00", "0")
        if not _alone(low):
            return _PLAIN_TOKEN.findall(low)
    if not joins("-", low) or not joins("'", low):
        return _PLAIN_TOKEN.findall(low)
    for sign in set(raw.translate(None, _NO_SIGNS).decode()):
        low = low.replace(sign, f" {sign} ")
    return low.split()


def _menu_feature(menu: int, words: int) -> str:
    return f"m={'all' if menu == words else 'most' if 2 * menu > words else 'few'}{min(menu, 3)}"


def text_features(text: str) -> tuple[list[str], int, str]:
    """Features of a block's wording, its size class and its closing character's class."""
    low = tokens_of(text)
    size, end = _size(len(low)), _end(text)
    out = ["w=" + w for w in dict.fromkeys(low)]
    out += [f"n={size}", f"e={end}", f"ne={size}{end}"]
    if low:
        out += ["f=" + " ".join(low[:2]), "z=" + " ".join(low[-2:])]
        menu = sum(map(MENU_WORDS.__contains__, low))
        if menu:
            out.append(_menu_feature(menu, len(low)))
    return out, size, end


def place_features(block: Block, size: int, end: str, place: int, left: int) -> list[str]:
    """Features of a block's markup and place; ``place`` and ``left`` count the blocks before and after it, up to a bound."""
    tag, kind = block.tag, block.container
    out = [f"t={tag}", f"c={kind}", f"l={block.linked}", f"tn={tag}{size}", f"te={tag}{end}", f"tc={tag}|{kind}", f"p={place}", f"r={left}", f"cn={kind}{size}{end}", f"a={block.path}", f"at={block.path}|{tag}"]
    if block.classes:
        out += [f"k={w}" for w in re.split(r"[\s_-]+", _DIGITS.sub("0", block.classes))]
    return out


def features(block: Block, place: int, count: int) -> list[str]:
    """The features of a block that is number ``place`` of ``count`` in its page."""
    words, size, end = text_features(block.text)
    return words + place_features(block, size, end, min(place, 4), min(count - 1 - place, 5))


class ChainField:
    """Weights of the field: for each feature how much it speaks for 'main', and label transitions."""

    def __init__(self, weights: dict[str, float], transitions: list[list[float]], fresh: list[list[float]], start: list[float]) -> None:
        self.weights = weights
        self.transitions = transitions
        self.fresh = fresh
        self.start = start
        self.worded: dict[str, tuple[float, int, str]] = {}
        self.placed: dict[tuple, float] = {}
        self.sized: dict[tuple[int, str], float] = {}
        #: Classes of containers with 0 for numbers, as their features have them.
        self.classes: dict[str, str] = {}
        #: The weights of words, without their feature's prefix.
        self.words = {f[2:]: v for f, v in weights.items() if f.startswith("w=")}

    @classmethod
    def load(cls, path: Path = MODEL_FILE) -> ChainField:
        d = json.loads(path.read_text())
        return cls(d["weights"], d["transitions"], d["fresh"], d["start"])

    def wording(self, text: str) -> tuple[float, int, str]:
        """The summed weights of ``text_features``, and size and end class, without building the features."""
        low = tokens_of(text)
        n = len(low)
        size = _size(n)
        end = _end(text)
        get, words = self.weights.get, self.words
        total = self.sized.get((size, end))
        if total is None:
            if len(self.sized) > 10_000:
                self.sized.clear()
            total = self.sized[size, end] = get(f"n={size}", 0.0) + get(f"e={end}", 0.0) + get(f"ne={size}{end}", 0.0)
        if low:
            total += get("f=" + " ".join(low[:2]), 0.0) + get("z=" + " ".join(low[-2:]), 0.0)
            each = set(low)
            total += sum([words[w] for w in each if w in words])
            if not MENU_WORDS.isdisjoint(each):
                total += get(_menu_feature(sum(map(MENU_WORDS.__contains__, low)), n), 0.0)
        return total, size, end

    def scores(self, blocks: list[Block]) -> list[float]:
        """How much each block speaks for 'main'. Repeated wordings and surroundings are looked up (memory is bounded)."""
        get = self.weights.get
        n = len(blocks)
        out = []
        for i, b in enumerate(blocks):
            worded = self.worded.get(b.text)
            if worded is None:
                if len(self.worded) > 50_000:
                    self.worded.clear()
                worded = self.wording(b.text)
                if len(b.text) < 200:
                    self.worded[b.text] = worded
            left = n - 1 - i
            classes = self.classes.get(b.classes)
            if classes is None:
                if len(self.classes) > 50_000:
                    self.classes.clear()
                classes = self.classes[b.classes] = _DIGITS.sub("0", b.classes)
            key = (b.tag, b.linked, b.path, classes, worded[1], worded[2], i if i < 4 else 4, left if left < 5 else 5)
            placed = self.placed.get(key)
            if placed is None:
                if len(self.placed) > 200_000:
                    self.placed.clear()
                placed = self.placed[key] = sum([get(f, 0.0) for f in place_features(b, key[4], key[5], key[6], key[7])])
            out.append(worded[0] + placed)
        return out

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely labels of a page's blocks (Viterbi); True is main."""
        if not blocks:
            return []
        scores = self.scores(blocks)
        a, b = self.start[0], self.start[1] + scores[0]
        back = []
        for block, s in zip(blocks[1:], scores[1:], strict=True):
            t = self.fresh if block.fresh else self.transitions
            aa, ba, ab, bb = a + t[0][0], b + t[1][0], a + t[0][1], b + t[1][1]
            back.append((ba > aa, bb > ab))
            a, b = max(aa, ba), max(ab, bb) + s
        label = b > a
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def judged(blocks: list[Block], labels: list[bool]) -> tuple[str, list[Block]]:
    """What a page's main blocks amount to, and those blocks.

    ``notice``/``filler``: every main block is a notice or filler, or says nothing; ``content``
    if one says something; ``empty`` without a main block or with headings only.
    """
    main = [b for b, y in zip(blocks, labels, strict=True) if y and b.tag != "noscript"]
    notice = filler = 0
    for t in sorted([b.text for b in main], key=len):  # one with content decides, and short ones are read fastest
        if is_filler(t):
            filler += 1
        elif is_notice(t):
            notice += 1
        elif not (NEUTRAL.match(t) or is_menu(t)):
            return "content", main
    if not notice and not filler:
        # No main block says anything: a notice may stand among what looks like furniture.
        rest = [b.text for b in blocks if b not in main and not b.linked and not FURNITURE.match(b.text) and not is_menu(b.text)]
        notice, filler = sum(map(is_notice, rest)), sum(map(is_filler, rest))
    if notice or filler:
        return ("notice" if notice >= filler else "filler"), main
    return "empty", main


def main_lines(body: str | None, field: ChainField, excerpt: bool = False) -> list[int]:
    """The numbers of the lines of a body (or page excerpt) that belong to its main part."""
    blocks = plain_blocks(body) if excerpt and body else blocks_of(body)
    kind, main = judged(blocks, field.decode(blocks))
    return [] if kind in ("notice", "filler") else list(dict.fromkeys(b.line for b in main))


_FIELD: list[ChainField] = []


def field_here() -> ChainField:
    """The trained field, loaded once per process."""
    if not _FIELD:
        _FIELD.append(ChainField.load())
    return _FIELD[0]


def with_main_lines(df: DataFrame, text: str, out: str = "main_lines", excerpt: bool = False) -> DataFrame:
    """Add the numbers (from 1) of the lines that belong to the main body, as an array.

    NULL, empty and blank texts, and pages without a main body, get an empty array. Texts are
    taken whole, whatever their length. Rows are treated one by one: no shuffle.
    """

    @F.pandas_udf("array<int>")
    def lines(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = field_here()
        for part in parts:
            yield pd.Series([main_lines(t, field, excerpt) for t in part], dtype=object)

    return df.withColumn(out, once(lines)(F.col(text).cast("string")))


def found_main(pages: DataFrame, signals: DataFrame) -> DataFrame:
    """(rec, rec_id, line_no) of every main line of fetch_results.body and site_signals.evidence."""
    body = with_main_lines(pages.select("fetch_id", "body"), "body").select(F.lit("body").alias("rec"), F.col("fetch_id").alias("rec_id"), F.explode("main_lines").alias("line_no"))
    evidence = with_main_lines(signals.select("signal_id", "evidence"), "evidence", excerpt=True).select(F.lit("evidence").alias("rec"), F.col("signal_id").alias("rec_id"), F.explode("main_lines").alias("line_no"))
    return body.unionByName(evidence)


def main_text(df: DataFrame, text: str, out: str = "main_text", excerpt: bool = False) -> DataFrame:
    """Add the main body's text: its lines without markup, joined by line breaks; '' if there is none, NULL for NULL."""

    @F.pandas_udf("string")
    def joined(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = field_here()
        for part in parts:
            result = []
            for t in part:
                if t is None:
                    result.append(None)
                    continue
                blocks = plain_blocks(t) if excerpt else blocks_of(t)
                kind, main = judged(blocks, field.decode(blocks))
                result.append("" if kind in ("notice", "filler") else "\n".join(b.text for b in main))
            yield pd.Series(result, dtype=object)

    return df.withColumn(out, once(joined)(F.col(text).cast("string")))
