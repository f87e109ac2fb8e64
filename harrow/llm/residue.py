"""Records that hold template residue, filler, error pages or demands for scripts instead of content.

Two lines of evidence are brought together.

*Whole pages.* The blocks of a page's main body (see ``boilerplate``) are judged one by one.
If none says anything of its own and some are notices or filler, the page is one. Any other
page counts if its whole main text, with numbers and the page's own names masked, recurs as
a template: on several hosts where it holds a weaker cue, on more of them where it holds none.

*Slots.* Records of the same template are aligned on the words next to each variable-like
token: tokens with the same words before (or after) them form a column of the template. A
column that differs between records is a slot, and a slot that still has a variable name, a
default or a blank in it was not filled. A column is part of the text, which speaks of such
a token, if neither side of it varies, it stands on several hosts, and no record has other
words in its place in the same sentence. Columns are found by map-side combined aggregation
over all records, other words by a join of sentences on the words beside a token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from operator import or_
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import settled
from ..operators.skew import attach_counted
from ..session import checkpointed
from .boilerplate import field_here, joins, judged
from .pages import Block, blocks_of

#: A variable's name: of any length, five words at most (more are prose), in which brackets of one kind hold letters only.
_NAME = r"[A-Za-z][A-Za-z0-9_.-]*?(?:\ [A-Za-z0-9_.-]+?){0,4}?"
_LETTERS = r"[A-Za-z][A-Za-z_]*(?:\ [A-Za-z_]+){0,4}"
#: The ways in which templates write a variable.
VARIABLE = re.compile(
    rf"""\{{\{{\s*[^{{}}\n]+\}}\}} | \{{%\s*[^%\n]+%\}} | <%=?\s*[^%\n]+%> | \$\{{{_NAME}\}} | \#\{{{_NAME}\}} | \[\[\s*{_NAME}\s*\]\] | @@{_NAME}@@ | %%{_NAME}%% | \*\|{_NAME}\|\* | \b__{_NAME}__\b | (?<![A-Za-z])__{_NAME}__ |
    (?<![\w\#])\#(?=[^\#]{{2}}){_LETTERS}\#(?!\w) | (?<![\w$])\$(?=[^$]{{2}}){_LETTERS}\$(?!\w) | \{{{_NAME}\}} | \[(?=[^\]]{{2}}){_LETTERS}\] | <(?=[^>]{{2}}){_LETTERS}>""",
    re.X,
)
#: Printf-style fields, which in error texts alone are template fields.
PRINTF = re.compile(r"%(?:\([A-Za-z_]\w*\))?[sdrifx]\b|\{\d?\}")
#: Defaults that ask to be replaced.
DEFAULT = re.compile(
    r"(?-i:\bTODO\b|\bFIXME\b|\bTBD\b)|^(?:X{3,}\s*)+$|\bINSERT\s+[A-Z]+(?:\s+[A-Z]+)*\s+HERE\b|\((?:add|insert|enter)\b[^)]*\)|\byour\s+(?:text|heading|title|content|company\s+name|tagline|logo)\s+(?:goes\s+)?here\b|^(?:type|add|enter|insert)\s+(?:your|a|the)\s+[\w ]{1,30}\s+here\.?$",
    re.I,
)
_BLANK = re.compile(r"\b(?:to|in|of|at|by|from|with|dear|hello|hi|choose)\s+(?=[,!?](?:\s|$))", re.I)
_WEAK = frozenset(
    "error sorry oops unavailable denied blocked please try browser page server request session loading address link access visitor visitors service shop app application content site "
    "fehler leider entschuldigung gesperrt blockiert bitte versuchen seite anfrage sitzung adresse zugriff besucher dienst wartung inhalt "
    "erreur désolé désolée désolés indisponible refusé refusée bloqué bloquée veuillez réessayer réessayez navigateur serveur requête chargement lien accès visiteur visiteurs maintenance contenu "
    "sentimos disponible denegado bloqueado favor intente inténtelo navegador página servidor solicitud sesión cargando dirección enlace acceso visitante visitantes servicio tienda mantenimiento contenido sitio".split()
)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORDS = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_NUMBER = re.compile(r"\d+")
#: For ASCII: lower case with 0 for digits and gaps for signs, without those - and ' that join no words.
_LOW = bytes(ord(c.lower()) if c.isalpha() else ord("0") if c.isdigit() else ord(c) if c in "-'" else ord(" ") for c in map(chr, range(128))) + bytes(128)
_LOOSE = re.compile(r"(?<![a-z0])[-']|[-'](?![a-z0])")
#: Addresses whose host is written plainly.
_PLAIN_HOST = re.compile(r"https?://([a-z0-9.-]+)(?:[/?#]|$)")


#: _WORDS and the sign of a field, for Java.
_LINE_WORDS = r"\{\}|[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
#: Pages, and their length, that a task keeps the reading of; both bound memory, not results.
KEPT_PAGES, KEPT_LENGTH = 5_000, 20_000
#: Sentences whose words a task keeps; it bounds memory, not results.
KEPT_SENTENCES = 50_000
#: Most fields that are broadcast to the sentences.
SOME_FIELDS = 10_000
#: Most words that are looked for in a sentence before it is taken apart; more are found after it, with the same result.
SOME_WORDS = 50


def _signed(t: str) -> bool:
    """Whether a text has what every variable has some of."""
    return "{" in t or "[" in t or "$" in t or "%" in t or "@" in t or "#" in t or "<" in t or "*|" in t or "__" in t


def _quick(t: str) -> bool:
    """Whether a text has what every variable, default or blank has some of."""
    if _signed(t) or " ," in t or " !" in t or " ?" in t or "TODO" in t or "FIXME" in t or "TBD" in t:
        return True
    low = t.casefold()
    if "here" in low and ("your" in low or "nsert" in low or "enter" in low or "add" in low or "type" in low):
        return True
    return "xxx" in low or "(add" in low or "(insert" in low or "(enter" in low


def sentences_of(text: str) -> list[str]:
    """The sentences of texts of blocks, in which single blanks part words; a line break parts the texts."""
    return text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, with 0 for numbers."""
    if not text.isascii():
        return _WORDS.findall(_NUMBER.sub("0", text.lower()))
    low = text.encode().translate(_LOW).decode()
    if "0" in low:
        while "00" in low:
            low = low.replace("00", "0")
    return (low if joins("-", low) and joins("'", low) else _LOOSE.sub(" ", low)).split()


def slots_of(texts: list[str]) -> tuple[bool, list[tuple[str, str, str]]]:
    """Whether an unfilled field is certain, and the (words before, words after, token) of each possible one.

    Certain are a token that is all there is of a sentence, and a default that asks to be replaced.
    """
    sure, found = fields_of(texts)
    return sure, [f[:3] for f in found]


def fields_of(texts: list[str]) -> tuple[bool, list[tuple[str, str, str, str, str]]]:
    """As ``slots_of``, with all words of the sentence before and after each field, up to the next field (see ``line_of``)."""
    return fields_in([s for t in texts for s in _SENTENCE.split(t)])


def fields_in(sentences: list[str]) -> tuple[bool, list[tuple[str, str, str, str, str]]]:
    """``fields_of`` of texts that are cut into sentences."""
    sure, found = False, []
    for sentence in sentences:
        if _quick(sentence):
            if DEFAULT.search(sentence):
                sure = True
            for m in [*VARIABLE.finditer(sentence), *_BLANK.finditer(sentence)]:
                token = m[0].strip() if m.re is VARIABLE else ""
                edge = m.start() if token else m.end()
                before = [w.lower() for w in _WORDS.findall(sentence[:edge])][-2:]
                after = [w.lower() for w in _WORDS.findall(sentence[m.end() :])][:2]
                if not before and not after:
                    sure = True
                else:
                    found.append((" ".join(before) if len(before) == 2 else "", " ".join(after) if len(after) == 2 else "", token, line_of(sentence[:edge]).removesuffix(" $").rpartition("{}")[2].strip(), line_of(sentence[m.end() :]).removeprefix("^ ").partition("{}")[0].strip()))
    return sure, found


def line_of(sentence: str) -> str:
    """The words of a sentence between ^ and $, with {} for each field."""
    if _signed(sentence):
        at, words = 0, []
        for m in VARIABLE.finditer(sentence):
            words += [*_WORDS.findall(sentence[at : m.start()].lower()), "{}"]
            at = m.end()
        words += _WORDS.findall(sentence[at:].lower())
    else:
        words = _WORDS.findall(sentence.lower())
    return " ".join(["^", *words, "$"])


def paragraphs(blocks: list[Block]) -> list[str]:
    """The texts of blocks; a line that continues the element of the line before is joined to it."""
    out: list[str] = []
    last = None
    for b in blocks:
        if last is not None and b.tag == f"in-{last}" and out:
            out[-1] += " " + b.text
        else:
            out.append(b.text)
            last = b.tag.removeprefix("in-").rstrip(".")
    return out


def unfilled_error(text: str | None) -> bool:
    """Whether an error text is itself an unfilled template."""
    return bool(text) and bool(VARIABLE.search(text) or PRINTF.search(text) or re.search(r"\bTODO\b|\bFIXME\b", text))


def host_of(url: str | None) -> str:
    if url and (plain := _PLAIN_HOST.match(url)):
        return plain[1].removeprefix("www.")
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def template_of(texts: list[str], host: str, known: dict[str, list[str]] | None = None) -> list[str]:
    """The words of a page with numbers and the names of its host masked; ``known`` keeps the words of sentences that come again in texts with other letters than ASCII."""
    known = {} if known is None else known
    text = "\n".join(texts)
    words: list[str] = words_of(text) if text.isascii() else []
    for t in () if text.isascii() else texts:
        if t.isascii():
            words += words_of(t)
            continue
        for s in sentences_of(t):
            if (found := known.get(s)) is None:
                if len(known) > KEPT_SENTENCES:
                    known.clear()
                found = words_of(s)
                if len(s) < 500:
                    known[s] = found
            words += found
    stem = re.sub(r"[^a-z]", "", host.split(".")[0])
    own = {w for w in set(words) if len(w) > 3 and w in stem} if stem else ()
    return ["*" if w in own else w for w in words] if own else words


def _cued(words: set[str]) -> bool:
    """Whether one of a page's words, or a part of one, is a weak cue."""
    return not _WEAK.isdisjoint(words) or any(not _WEAK.isdisjoint(w.replace("’", "-").replace("'", "-").split("-")) for w in words if not w.isalnum())


def signs(df: DataFrame) -> DataFrame:
    """One row for each record with something to judge: fetch_id, sure, host, template (its hash), cue, slots.

    Rows without ``fetch_id`` hold in ``lines`` the distinct sentences of many records, with {} for each field.
    """
    schema = "fetch_id long, sure boolean, host string, template string, cue boolean, slots array<struct<before:string,after:string,token:string,pre:string,post:string>>, lines array<string>"

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = field_here()
        known: dict[tuple[str, str | None], tuple] = {}
        worded: dict[str, list[str]] = {}

        def read(body: str | None, host: str, sentences: set[str]) -> tuple[bool, list[dict], str | None, bool]:
            """Whether a page is residue for certain, its possible fields, its template's hash, and whether it holds a cue."""
            blocks = blocks_of(body)
            kind, main = judged(blocks, field.decode(blocks))
            text = "\n".join(paragraphs(blocks))
            cut = sentences_of(text) if text else []
            sure, slots = fields_in(cut) if _quick(text) else (False, [])
            sentences.update(cut)
            sure = sure or kind in ("notice", "filler")
            template, cue = None, False
            if not sure and main:
                words = template_of([b.text for b in main], host, worded)
                each = set(words)
                template = sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest() if each - {"*", "0"} else None
                cue = _cued(each)
            return sure, [dict(zip(("before", "after", "token", "pre", "post"), slot, strict=True)) for slot in dict.fromkeys(slots)], template, cue

        for part in parts:
            rows = []
            sentences: set[str] = set()
            for fetch_id, url, body, error in zip(part["fetch_id"], part["url"], part["body"], part["error"], strict=True):
                host = host_of(url)
                if (seen := known.get((host, body))) is None:  # the same page fetched again is read once
                    seen = read(body, host, sentences)
                    if len(known) > KEPT_PAGES:
                        known.clear()
                    if len(body or "") < KEPT_LENGTH:
                        known[host, body] = seen
                sure, slots, template, cue = seen
                if unfilled_error(error):
                    sure, template = True, None
                if sure or slots or template:
                    rows.append((fetch_id, sure, host, template, cue, slots, None))
            rows.append((None, False, None, None, False, [], [VARIABLE.sub(" {} ", t) if _signed(t) else t for t in sentences]))
            yield pd.DataFrame(rows, columns=["fetch_id", "sure", "host", "template", "cue", "slots", "lines"]).astype({"fetch_id": "Int64"})

    columns = ["fetch_id", *[F.col(c).cast("string").alias(c) for c in ("url", "body", "error")]]
    return df.select(*columns).where("fetch_id IS NOT NULL").mapInPandas(judge, schema)


def filled(lines: DataFrame, fields: DataFrame) -> DataFrame:
    """The (pre, post) of ``fields`` between which some line has other words.

    Lines are sentences with {} for each field. They and fields meet on two neighbouring words,
    those before a field or those behind it. Up to SOME_FIELDS fields are broadcast, and lines
    without the words beside any of them are passed over before they are taken apart; more
    fields are joined by hash, with the same result.
    """
    ends = F.split("pre", " ").alias("a"), F.split("post", " ").alias("b")
    asked = fields.select("pre", "post").distinct().select("pre", "post", *ends)
    key = F.when(F.size("a") > 1, F.array_join(F.slice("a", -2, 2), " ")).when(F.size("b") > 1, F.array_join(F.slice("b", 1, 2), " "))
    asked = asked.select("pre", "post", key.alias("key")).where("key IS NOT NULL")
    few = [r.key for r in asked.select("key").distinct().limit(SOME_FIELDS + 1).collect()]
    if not few:
        return fields.select("pre", "post").limit(0)
    words = F.concat(F.array(F.lit("^")), F.regexp_extract_all("line", F.lit(_LINE_WORDS), F.lit(0)), F.array(F.lit("$")))
    lines = lines.select(settled(F.lower("line")).alias("line"))
    telling = sorted({max(k.split(" "), key=len) for k in few})
    if len(telling) <= SOME_WORDS and not {"^", "$"} & set(telling):
        lines = lines.where(reduce(or_, [F.contains("line", F.lit(w)) for w in telling]))
    lines = lines.select(settled(words).alias("words"))
    if len(few) <= SOME_FIELDS:
        asked = F.broadcast(asked)
        lines = lines.where(F.exists("words", lambda w: w.isin(telling)))
    pairs = F.array_distinct(F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1), lambda x, y: F.concat(x, F.lit(" "), y)))
    met = lines.select(F.array_join("words", " ").alias("line"), F.explode(pairs).alias("key")).join(asked, "key")
    rest = F.expr("CASE WHEN pre = '' THEN concat(' ', line, ' ') WHEN locate(concat(' ', pre, ' '), concat(' ', line, ' ')) > 0 THEN substring(concat(' ', line, ' '), locate(concat(' ', pre, ' '), concat(' ', line, ' ')) + length(pre) + 1) END")
    gap = F.expr("CASE WHEN post = '' THEN split(trim(rest), ' ')[0] WHEN pre = '' THEN element_at(split(trim(substring(rest, 1, locate(concat(' ', post, ' '), rest) - 1)), ' '), -1) WHEN locate(concat(' ', post, ' '), rest) > 1 THEN trim(substring(rest, 1, locate(concat(' ', post, ' '), rest) - 1)) END")
    return met.withColumn("rest", rest).withColumn("gap", gap).where("gap NOT IN ('', '^', '$') AND NOT contains(gap, '{}')").select("pre", "post").distinct()


def found_residue(df: DataFrame, hosts: int = 3, hosts_alone: int = 10) -> DataFrame:
    """(fetch_id) of the records that are residue, each once.

    A blank or NULL body alone is none. A page with a weak cue needs its template on
    ``hosts`` hosts or more, one without on ``hosts_alone``. Other columns of ``df`` are not looked at; an empty table gives
    an empty result. Texts are taken whole.
    """
    seen = checkpointed(signs(df))
    total = seen.where("fetch_id IS NOT NULL").count()
    sure = seen.where("sure").select("fetch_id")
    open_slots = seen.where("NOT sure").select("fetch_id", "host", F.posexplode("slots").alias("at", "slot")).select(
        "fetch_id", "host", "at", F.col("slot.token").alias("token"), F.col("slot.pre").alias("pre"), F.col("slot.post").alias("post"),
        F.when(F.col("slot.before") != "", F.concat(F.lit("< "), "slot.before")).alias("left"),
        F.when(F.col("slot.after") != "", F.concat(F.lit("> "), "slot.after")).alias("right"),
    )
    keyed = open_slots.select("fetch_id", "at", "host", "token", "pre", "post", F.explode(F.array("left", "right")).alias("key")).where("key IS NOT NULL")
    columns = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("token").alias("t0"), F.max("token").alias("t1"), F.min("host").alias("h0"), F.max("host").alias("h1")
    )
    columns = columns.select("key", "n", F.expr("t0 <> t1").alias("varies"), F.expr("h0 <> h1").alias("spread"))
    sides = attach_counted(keyed, columns, "key", total * 2).groupBy("fetch_id", "at", "pre", "post").agg(F.max("varies").alias("varies"), F.max("spread").alias("spread"))
    constant = checkpointed(sides.where("NOT varies AND spread").select("fetch_id", "at", "pre", "post"))
    lines = seen.where("fetch_id IS NULL").select(F.explode("lines").alias("line"))
    spoken = constant.join(filled(lines, constant), ["pre", "post"], "left_anti").select("fetch_id", "at")
    unfilled = open_slots.join(spoken, ["fetch_id", "at"], "left_anti").select("fetch_id")
    pages = seen.where("template IS NOT NULL").select("fetch_id", "template", "host", "cue")
    repeated = pages.groupBy("template", "host").agg(F.count(F.lit(1)).alias("c"), F.max("cue").alias("cue")).groupBy("template").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("n"), F.max("cue").alias("weak"))
    repeated = repeated.where(F.col("k") >= F.when(F.col("weak"), hosts).otherwise(hosts_alone)).select("template", "n")
    recurrent = attach_counted(pages, repeated, "template", total).select("fetch_id")
    return sure.unionByName(unfilled).unionByName(recurrent).distinct()
