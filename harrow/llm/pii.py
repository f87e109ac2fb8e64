"""Personal data in free text: found through disguises, replaced by typed placeholders.

Texts pass transducers that undo disguises (look-alike characters, characters without width,
``[at]``/``DOT`` spellings, numbers in words) and keep for every piece of the result where in
the source it came from. Mail addresses, phone numbers, identity numbers and street addresses
are found in the normal form by their grammar, names by a lexicon and by salutations; the
spans are then mapped back, so what comes out is text exactly as it stands in the source.

The names are all those of columns of given names and surnames. Up to a documented bound they
are broadcast; more are joined by hash with the words of the documents, with the same result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import once
from ..operators.skew import join_counted

KINDS = ("email", "phone", "id", "address", "name")

# -- disguises ----------------------------------------------------------------------------------

#: Characters that look like ASCII ones (full width, mathematical and circled ones follow from NFKC).
_LOOKS_LIKE = dict(zip("аАвВеЕкКмМнНоОрРсСтТуУхХіІјЈѕЅԁӏοΟαΑεΕιΙκΚνΝρΡτΤυΥχΧ‐‑‒–−＠﹫．。", "aABBeEkKMMHHoOpPcCTTyYxXiIjJsSdloOaAeEiIkKvNpPtTuYxX-----@@..", strict=True))
_WIDTHLESS = "​‌‍⁠­﻿"
_AT = r"(?:at|AT|At|@|arroba|ät|chez)"
_DOT = r"(?:dot|DOT|Dot|\.|punkt|Punkt|point|punto)"
_DISGUISE = re.compile(
    rf"""(?P<at>\ ?[\[({{<]\ ?{_AT}\ ?[\])}}>]\ ?) | (?P<dot>\ ?[\[({{<]\ ?{_DOT}\ ?[\])}}>]\ ?) |
    (?P<at2>\ AT\ (?=[\w-]+(?:\ DOT\ |\.)[\w-])) | (?P<dot2>(?<=[a-z0-9])\ DOT\ (?=[a-z0-9])) |
    (?P<at3>(?<=\w)\ at\ (?=[\w-]+\ dot\ [\w-]+)) | (?P<dot3>(?<=[a-z0-9])\ dot\ (?=[a-z]{{2,}}\b)) |
    (?P<gone>[{_WIDTHLESS}]+)""",
    re.X,
)
#: What each alternative of _DISGUISE holds; with brackets, found by its own pattern.
_BRACKETED = re.compile(rf"[\[({{<]\ ?(?:{_AT}|{_DOT})\ ?[\])}}>]")
_SPELT = (" AT ", " DOT ", " dot ", *_WIDTHLESS)
_PROSE_AT = re.compile(r"(?<![\w.+-])([\w-]*[\d._+-][\w.+-]*\w)( at )(?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}\b)")
#: Digits in words (English, German, French, Spanish).
_SPOKEN = {
    w: str(d)
    for d, words in enumerate(
        ("zero oh null zéro cero nought", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")
    )
    for w in words.split()
}
_SPOKEN_RUN = re.compile(rf"(?<!\w)(?:(?:plus|\+)[ -])?(?:(?:(?:double|triple)[ -])?(?:{'|'.join(_SPOKEN)})[ ,-]+){{5,}}(?:{'|'.join(_SPOKEN)})(?!\w)", re.I)
#: The second and third number of a run, in texts without case.
_SPOKEN_PAIR = re.compile(rf"[ ,-](?:{'|'.join(_SPOKEN)})[ ,-]+(?:(?:double|triple)[ -])?(?:{'|'.join(_SPOKEN)})(?!\w)")


@dataclass
class Normal:
    """A normal form and the source spans of its replaced pieces (start in form, start in source, length in form, length in source)."""

    text: str
    pieces: list[tuple[int, int, int, int]] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the normal form."""
        return (self._at(start, False), self._at(end, True)) if self.pieces else (start, end)

    def _at(self, i: int, end: bool) -> int:
        k = bisect_right(self.starts, i - 1 if end else i) - 1
        if k < 0:
            return i
        n, s, nl, sl = self.pieces[k]
        return s + (sl if end else 0) if (i - 1 if end else i) < n + nl else s + sl + (i - n - nl)


def _single(c: str) -> str:
    if c in _LOOKS_LIKE:
        return _LOOKS_LIKE[c]
    n = ord(c)
    if not (0xFF01 <= n <= 0xFF5E or 0x1D400 <= n <= 0x1D7FF or 0x2460 <= n <= 0x24FF):
        return c  # only forms of letters and digits that serve as disguise; signs such as º have a meaning of their own
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() else c


def _caseless(text: str) -> str:
    """Folded case, with I and its dot as one letter, as patterns that ignore case compare."""
    return text.casefold() if text.isascii() else text.casefold().replace("i̇", "i")


_SINGLES: dict[int, str] = {}


def normal_form(text: str) -> Normal:
    """Undo the disguises of a text."""
    t = text
    ascii_only = t.isascii()
    if not ascii_only:
        for c in set(t):
            if ord(c) > 127 and ord(c) not in _SINGLES:
                _SINGLES[ord(c)] = _single(c)
        t = t.translate(_SINGLES)
    cuts: list[tuple[int, int, str]] = []
    if any(sign in t for sign in _SPELT) or _BRACKETED.search(t):
        for m in _DISGUISE.finditer(t):
            kind = m.lastgroup
            cuts.append((m.start(), m.end(), "" if kind == "gone" else "@" if kind.startswith("at") else "."))
    if " at " in t:
        cuts += [(m.start(2), m.end(2), "@") for m in _PROSE_AT.finditer(t)]
    if _SPOKEN_PAIR.search(_caseless(t)):
        for m in _SPOKEN_RUN.finditer(t):
            digits, times = "", 1
            for w in re.findall(r"[^\W\d_]+", _caseless(m[0])):
                if w in ("double", "triple"):
                    times = 2 if w == "double" else 3
                elif w == "plus":
                    digits += "+"
                else:
                    digits += _SPOKEN[w] * times
                    times = 1
            cuts.append((m.start(), m.end(), digits))
    if not cuts:
        return Normal(t)
    cuts.sort()
    out, pieces, at, length = [], [], 0, 0
    for a, b, new in cuts:
        if a < at:
            continue
        out.append(t[at:a])
        length += a - at
        pieces.append((length, a, len(new), b - a))
        out.append(new)
        length += len(new)
        at = b
    out.append(t[at:])
    return Normal("".join(out), pieces, [p[0] for p in pieces])


# -- grammars -----------------------------------------------------------------------------------

_EMAIL = re.compile(r"(?<![\w.+@-])[A-Za-z0-9_](?:[\w.+%'-]*[\w+])?(?:@| @ | @|@ )(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w@])")
_RUN = re.compile(r"\d[\d ()./<-]{4,}")
_EXT = r"(?:,?\ ?(?:ext\.?|extension|x|Durchwahl|poste|Nst\.)\ ?\d{1,6})?"
#: Characters behind a run that a match and what it looks ahead to may take: the longest extension and, behind it, a unit.
_BEYOND = len(", extension 123456") + len(" units") + 2
_PHONE = re.compile(
    rf"""(?<![\w.,:/#£€$-])(?:
    \+\d{{1,3}}[ .-]?(?:\(0\)[ ]?)?\d(?:[ ./-]?\d){{6,12}} |
    00[1-9]\d[ .-]?(?:\(0\)[ ]?)?\d(?:[ ./-]?\d){{6,12}} |
    \(0?\d{{2,5}}\)[ ]?\d{{3,8}}(?:[ -]\d{{2,6}}){{0,2}} |
    1[ .-]\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}} | \d{{3}}\.\d{{3}}\.\d{{4}} | \d{{3}}-\d{{3}}-\d{{4}} | \d{{3}}\ \d{{3}}\ \d{{4}} |
    0[1-9]\d{{2,3}}\ \d{{6,8}} | 0[1-9]\d{{1,3}}/\d{{6,9}} | 0[1-9]\d{{1,3}}\ \d{{3,4}}\ \d{{4}} | 0[1-9](?:\ \d\d){{4}} | 0[1-9]\d{{8,9}} |
    555-01\d\d | \d{{3}}-\d{{4}}(?=,?\ ?(?:ext|x|extension)\.?\ ?\d)
    ){_EXT}(?![\w]|[.,:/-]\d)""",
    re.X,
)
#: A number in words has no groups; these are the forms of ten digits that _PHONE takes in groups alone.
_SPOKEN_PHONE = re.compile(r"\+?1?[2-9]\d\d[2-9]\d{6}")
_ID = re.compile(
    r"""(?<![\w.,:/#£€$+-])(?:
    [A-Z]{2}\ ?\d\d\ ?\d\d\ ?\d\d\ ?[A-D] | [XYZ]-?\d{7}-?[A-Z]{1,2} | \d{8}-?[A-Z] | [A-Z]{2}\d{6}<\d |
    \d{3}-\d\d-\d{4} | \d{3}\ \d\d\ \d{4} | \d\d\ \d{3}\ \d{3}\ \d{3} | [0-9]\ \d\d\ \d\d\ \d\d\ \d{3}\ \d{3}(?:\ \d\d)? | \d{9}
    )(?!\w|[.,:/-]\d|\ ?(?:%|km|kg|units|EUR|USD))""",
    re.X,
)
_UP = "A-ZÀ-ÖØ-ÞŁŚŻĆČŠŽ"
_LOW = "a-zà-öø-ÿłśżćčšžąęńő"
_PLACE = rf"(?:(?:Port|Bad|St\.?|New|Upper|Lower|Great|Little|San|Santa)\ )?[{_UP}][{_LOW}]+(?:[\ -](?:Cross|Green|Park|Bay|Regis))?"
_STREET = r"(?:Street|Road|Lane|Close|Avenue|Ave\.?|Blvd\.?|Boulevard|Way|Row|Quay|Drive|Court|Gardens|Terrace|Crescent|Square|Place|Mews|Hill|Walk)"
_AFTER = rf"(?:,\ (?!T:|E:){_PLACE}(?:,?\ [A-Z]{{1,2}}\d{{1,2}}[A-Z]?\ \d[A-Z]{{2}}\b|,\ [A-Z]{{2}}\ \d{{5}}(?:-\d{{4}})?\b|,?\ \d{{5}}\b)?)?"
_CODE_PLACE = rf"(?:,\ (?:[A-Z]-)?\d{{4,5}}\ {_PLACE})?"
_ADDRESS = re.compile(
    rf"""(?<![\w.#-])(?:
    (?:(?:Flat|Apt|Unit|Suite|Apartment)\ \d+[A-Za-z]?,\ )?\d{{1,5}}[A-Za-z]?\ [{_UP}][\w'’]+(?:\ [{_UP}][\w'’]+)?\ {_STREET}\b(?:,\ (?:Apt|Suite|Flat|Unit|Floor)\.?\ \d+[A-Za-z]?)?{_AFTER} |
    [{_UP}][\w'’]+\ (?:Cottage|House|Farm|Lodge|Barn|Manor),\ (?:\d+[a-z]?\ )?[{_UP}][\w'’]+\ {_STREET}\b{_AFTER} |
    (?:P\.\ ?O\.|PO|P\.O)\ Box\ \d+{_AFTER} | (?:Postfach|Apartado|B\.P\.|BP)\ \d+{_CODE_PLACE} |
    [{_UP}][\w-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer)\ \d+\ ?[a-z]?\b{_CODE_PLACE} |
    (?:Am|An\ der|An\ den|Im|Zum|Zur|Auf\ der|Unter\ den)\ [{_UP}][\w-]+\ \d+\ ?[a-z]?\b{_CODE_PLACE} |
    (?:Calle|Avenida|Avda\.|Plaza|Paseo|C/|Camino|Ronda)\ ?(?:de\ (?:la\ |los\ |las\ )?)?[{_UP}][\w]+,?\ \d+(?:,\ \d+\ ?[º°ª](?:\ [A-Z]\b|\ (?:izq|dcha)\.?)?)?{_CODE_PLACE} |
    \d+(?:\ (?:bis|ter|quater))?,?\ (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours|square)(?:\ (?:de\ la|des|du|de|aux|à)|\ (?:de\ )?l['’]|\ d['’])?\ ?[{_UP}][\w'’-]+(?:\ [{_UP}][\w'’-]+)?{_CODE_PLACE}
    )""",
    re.X,
)

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PARTICLE = re.compile(r"\s(?:van\sder|van\sden|van|von\sder|von|zu|de\sla|de\slos|de|del|della|di|da|dos|den|der|le|la|af|ter|bin|el|al)\s", re.I)
_TITLES = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herrn|Herr|Frau|Madame|Monsieur|Mme|Mlle|señora|señor|señorita|Señora|Señor|Sra|Sr|Signor|Signora)"
_TITLED = re.compile(rf"(?<!\w){_TITLES}\.?\s((?:[{_UP}]\.\s)?[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?(?:\s[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?)?)")
_TITLE_BEFORE = re.compile(rf"(?<!\w)(?:{_TITLES}|M)\.?\s$")
_INITIALS_BEFORE = re.compile(rf"(?<![\w.])(?:[{_UP}]\.\s?)+$")
_INITIALS_AFTER = re.compile(rf"(?:\s[{_UP}]\.)+(?!\w)")
_FRENCH = re.compile(r"\b(?:les|des|nous|répond|habite|une|votre|est|aux)\b", re.I)
_NO_NAMES = frozenset("team all everyone sir madam colleagues friends damen herren there".split())


@dataclass
class NameLexicon:
    """Given names and surnames, lower case."""

    given: frozenset[str]
    surnames: frozenset[str]

    def __post_init__(self) -> None:
        self.both = self.given | self.surnames


def _is(word: str, names: frozenset[str]) -> bool:
    low = word.lower()
    return low in names or ("-" in low and all(p in names for p in low.split("-")))


def names_in(text: str, lexicon: NameLexicon, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of personal names in a normal form, outside the spans that are taken."""
    known = lexicon.both
    hits = set()
    for w in set(_WORD.findall(text.lower())):
        if w in known:
            hits.add(w)
        elif "'" in w or "’" in w or "-" in w:
            bare = w.removesuffix("'s").removesuffix("’s")
            if bare in known or ("-" in bare and all(p in known for p in bare.split("-"))):
                hits.add(w)
    out: list[tuple[int, int]] = []
    if hits:
        spots = [(m.start(), m[0]) for m in _WORD.finditer(text) if m[0].lower() in hits]
        at = -1
        for start, word in spots:
            bare = re.sub(r"['’][sS]$", "", word)
            end = start + len(bare)
            if start < at or any(a < end and start < b for a, b in taken):
                continue
            upper = bare[0].isupper()
            given, surname = _is(bare, lexicon.given), _is(bare, lexicon.surnames)
            first, last = start, end
            if given:
                if bare == word:
                    stop = end
                    if m := _INITIALS_AFTER.match(text, end):
                        stop = m.end()
                    gap = stop
                    if m := _PARTICLE.match(text, stop):
                        gap = m.end()
                    elif text[stop : stop + 1] in (" ", " "):
                        gap = stop + 1
                    nxt = _WORD.match(text, gap) if gap > stop else None
                    follow = re.sub(r"['’][sS]$", "", nxt[0]) if nxt else ""
                    if follow and _is(follow, lexicon.surnames) and follow[0].isupper() == upper:
                        last = gap + len(follow)
                    elif stop > end and upper:
                        last = stop
                    elif not upper:
                        continue
                elif not upper:
                    continue
            elif surname:
                if not upper:
                    continue
                titled = _TITLE_BEFORE.search(text, max(0, start - 14), start)
                degree = titled and titled[0].startswith(("Dr", "Prof"))  # may stand before a name in any order
                if m := _INITIALS_BEFORE.search(text, max(0, start - 12), start):
                    if m[0].rstrip() != "M." or not _FRENCH.search(text):
                        first = m.start()
                elif bare == word and (degree or not titled) and text[end : end + 2] == ", ":
                    nxt = _WORD.match(text, end + 2)
                    if nxt and _is(re.sub(r"['’][sS]$", "", nxt[0]), lexicon.given) and nxt[0][0].isupper():
                        last = end + 2 + len(re.sub(r"['’][sS]$", "", nxt[0]))
                        if nxt[0] == text[end + 2 : last] and (m := _INITIALS_AFTER.match(text, last)):
                            last = m.end()
            out.append((first, last))
            at = last
    for m in _TITLED.finditer(text):
        a, b = m.span(1)
        if m[1].lower().split()[0] in _NO_NAMES or any(x < b and a < y for x, y in out) or any(x < b and a < y for x, y in taken):
            continue
        first = re.match(r"(?:\S\.\s)?\S+", m[1])[0].rstrip("'’")
        out.append((a, a + len(first)))
    return sorted(out)


def find(text: str | None, lexicon: NameLexicon) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every item in a text, in order, without overlaps; offsets count code points of the source."""
    if not text or text.isspace():
        return []
    form = normal_form(text)
    t = form.text
    spans: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def take(a: int, b: int, kind: str) -> None:
        if not any(x < b and a < y for x, y in taken):
            taken.append((a, b))
            spans.append((a, b, kind))

    if "@" in t:
        for m in _EMAIL.finditer(t):
            if not (" " in m[0] and m[0].split("@")[0].strip().isdigit()):
                take(m.start(), m.end(), "email")
    for m in _ADDRESS.finditer(t):
        take(m.start(), m.end(), "address")
    for at, _, length, _ in form.pieces:
        if _SPOKEN_PHONE.fullmatch(t, at, at + length) and not t[at + length : at + length + 1].isalnum():
            take(at, at + length, "phone")
    upto = 0
    for run in _RUN.finditer(t):
        a, b = max(upto, run.start() - 8), min(len(t), run.end() + _BEYOND)
        for pattern, kind in ((_ID, "id"), (_PHONE, "phone")):
            for m in pattern.finditer(t, a, b):
                if m.start() >= run.end():  # it belongs to the next run, which sees all of it
                    break
                take(m.start(), m.end(), kind)
        upto = run.end() if run.end() - run.start() < 40 else run.start()
    for a, b in names_in(t, lexicon, taken):
        take(a, b, "name")
    out = []
    for a, b, kind in sorted(spans):
        x, y = form.source(a, b)
        out.append((x, y, kind))
    return out


def masked(text: str | None, lexicon: NameLexicon) -> str | None:
    """The text with each item replaced by its kind in brackets; NULL for NULL."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find(text, lexicon):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


# -- DataFrames ---------------------------------------------------------------------------------

#: Most names that are broadcast.
SOME_NAMES = 100_000


def all_names(people: DataFrame, given: str = "first_name", surname: str = "last_name") -> DataFrame:
    """(w, given, surname): every given name and surname of a table, lower case, each word once.

    Blank values, values with digits and single letters are left out.
    """

    def words(column: str, first: bool) -> DataFrame:
        word = F.explode(F.split(F.lower(F.trim(F.col(column).cast("string"))), r"[\s -]+"))
        return people.select(word.alias("w")).where(r"w rlike '^[\\p{L}\\p{M}]{2,}$'").withColumns({"given": F.lit(first), "surname": F.lit(not first)})

    return words(given, True).unionByName(words(surname, False)).groupBy("w").agg(F.max("given").alias("given"), F.max("surname").alias("surname"))


def candidates(text: str | None) -> list[str]:
    """Every word of a text that ``names_in`` may look up, lower case, each once."""
    if not text:
        return []
    form = normal_form(text).text
    words = {*_WORD.findall(form.lower()), *(w.lower() for w in _WORD.findall(form))}
    words |= {re.sub(r"['’]s$", "", w) for w in words}
    return sorted(words | {p for w in words if "-" in w for p in w.split("-")})


def lexicon_of(names: DataFrame, bound: int = SOME_NAMES) -> NameLexicon | None:
    """The lexicon of all of ``all_names``; None if there are more than ``bound``."""
    few = names.limit(bound + 1).collect()
    return None if len(few) > bound else NameLexicon(frozenset(r.w for r in few if r.given), frozenset(r.w for r in few if r.surname))


def _by_names(documents: DataFrame, people: DataFrame, text: str, out: str, kind: str, read: Callable, bound: int) -> DataFrame:
    """Add ``read(text, lexicon)`` for each text, where the lexicon holds all names of ``people`` that the text may need.

    Up to ``bound`` names are broadcast. More are joined by hash with the words of each
    distinct text (by its SHA-256), and each text gets the names among its own words.
    """
    names = all_names(people)
    if (lexicon := lexicon_of(names, bound)) is not None:
        return _with_lexicon(documents, lexicon, text, out, kind, read)

    @F.pandas_udf("array<string>")
    def words_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([candidates(t) for t in part], dtype=object)

    @F.pandas_udf(kind)
    def reading(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, given, surnames in parts:
            none = ()
            yield pd.Series([read(t, NameLexicon(frozenset(none if g is None else g), frozenset(none if n is None else n))) for t, g, n in zip(texts, given, surnames, strict=True)], dtype=object)

    whole = F.col(text).cast("string")
    words = documents.select(F.sha2(whole, 256).alias("_hw_text"), F.explode(once(words_of)(whole)).alias("w"))
    met = join_counted(words, names, "w").groupBy("_hw_text").agg(
        F.collect_set(F.when(F.col("given"), F.col("w"))).alias("_hw_given"), F.collect_set(F.when(F.col("surname"), F.col("w"))).alias("_hw_surnames")
    )
    held = documents.withColumn("_hw_text", F.sha2(whole, 256)).join(met, "_hw_text", "left")
    return held.withColumn(out, once(reading)(whole, "_hw_given", "_hw_surnames")).drop("_hw_text", "_hw_given", "_hw_surnames")


def _with_lexicon(documents: DataFrame, lexicon: NameLexicon, text: str, out: str, kind: str, read: Callable) -> DataFrame:
    """Add ``read(text, lexicon)`` for each text, with one broadcast lexicon. No shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf(kind)
    def reading(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for part in parts:
            yield pd.Series([read(t, known) for t in part], dtype=object)

    return documents.withColumn(out, once(reading)(F.col(text).cast("string")))


_ITEMS = "array<struct<start:int,end:int,kind:string,pii_text:string>>"


def _items(text: str | None, lexicon: NameLexicon) -> list[dict]:
    return [{"start": a, "end": b, "kind": k, "pii_text": text[a:b]} for a, b, k in find(text, lexicon)]


def with_items(documents: DataFrame, lexicon: NameLexicon, text: str = "text", out: str = "items") -> DataFrame:
    """Add the items of each text: array of (start, end, kind, pii_text), offsets in code points from 0.

    NULL, empty and blank texts get an empty array. Whole texts are searched. No shuffle.
    """
    return _with_lexicon(documents, lexicon, text, out, _ITEMS, _items)


def found_items(documents: DataFrame, people: DataFrame, bound: int = SOME_NAMES) -> DataFrame:
    """(doc_id, kind, pii_text): each distinct item of each document; up to ``bound`` names are broadcast."""
    found = _by_names(documents.select("doc_id", "text"), people, "text", "items", _ITEMS, _items, bound)
    distinct = F.array_distinct(F.transform("items", lambda i: F.struct(i["kind"].alias("kind"), i["pii_text"].alias("pii_text"))))
    return found.select("doc_id", F.explode(distinct).alias("item")).select("doc_id", "item.kind", "item.pii_text")


def with_masked(documents: DataFrame, people: DataFrame, text: str = "text", out: str = "masked", bound: int = SOME_NAMES) -> DataFrame:
    """Add the text with typed placeholders in place of personal data; NULL stays NULL and empty text empty. Up to ``bound`` names are broadcast."""
    return _by_names(documents, people, text, out, "string", masked, bound)
