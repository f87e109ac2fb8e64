"""Variant spellings of organisation names, attributed to canonical forms by a noisy channel.

A name is parsed into its core (the proper name's words, longest first, without accents),
its line of business (in full or short) and what tells nothing (article, legal form,
initials in brackets). Spellings with the same core are counted together. Frequent cores are
the candidate canonical forms of rarer ones. For a core, the hypotheses are the candidates
within two edits (one, if it has fewer than ten letters) and the core itself:

* candidate: log of its count, minus the costs of the edits between them;
* the core itself: log of its count, minus the cost of another company being called so by
  chance (letters times the entropy of a letter, minus the log of the number of cores).

The cost of an edit is minus the log of its rate, which is learned from the table: how often
long names are typed with one swap, doubled or halved letter, added or missing letter, or
other letter. The hypothesis with the maximum posterior wins. Cores with the second word as
an initial only go to the most frequent core they abbreviate. Lines of business then divide
a core: two names that state different ones name different companies, and a name that states
none goes to the most frequent one.

Candidates are found by exact keys, never by comparing all. Cores up to 24 letters meet in the
forms that they have in common with up to two letters taken out (see ``near_cores``). Of longer
cores, two edits leave one of a core's two ends with one edit at most, and strings within one edit have a form in common in
which each lacks a letter at most; these forms are the keys. Cores of a key that many share
are divided by the rest of them with up to two letters taken out, which two strings within two
edits have in common. So no pair is lost, and no key holds many cores unless they are near
each other.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions.barrier import once
from ..functions.missing import STAND_INS
from ..session import checkpointed, released
from . import near_cores
from .edit_tree import distance
from .near_cores import LONGEST

#: Words that say that there is no employer.
NO_EMPLOYER = frozenset(
    "freelance freelancer self-employed selfemployed unemployed independent retired student private individual myself none various confidential stealth sole-trader contractor jobless between-jobs not-employed no-company nocompany".split()
)
#: Legal forms and words around a name, without dots, lower case.
LEGAL = frozenset(
    "ltd limited llc inc incorporated corp corporation co company gmbh ag kg ohg ug gbr mbh ab aktiebolag bv nv srl spa sarl sas sa plc llp lp oy as aps pty pte se ev eg holding holdings group gruppe the and und et y".split()
)
#: Lines of business that a name may state.
BUSINESS = (
    "logistics", "engineering", "finance", "software", "robotics", "international", "recruitment", "foods", "dental", "packaging", "textiles", "consulting",
    "construction", "services", "security", "legal", "energy", "marine", "media", "laboratories", "insurance", "electronics", "pharma", "chemicals", "motors",
    "printing", "design", "analytics", "technologies", "systems", "solutions", "properties", "travel", "catering", "furniture", "plastics", "optics",
)
_SHORT = {"sw": "software", "int": "international", "intl": "international", "mdia": "media", "enrg": "energy", "nrgy": "energy", "labs": "laboratories", "lab": "laboratories", "food": "foods", "svc": "services", "svcs": "services", "engrg": "engineering", "mfg": "manufacturing", "tech": "technologies", "pkg": "packaging"}
_LEET = str.maketrans("01357", "olest")
_BRACKET = re.compile(r"\([^()]{1,12}\)")
_DOTTED = re.compile(r"\b(?:\w\.){2,}\w?(?!\w)\.?|\b(?:\w\.){2,}")
_CAMEL = re.compile(r"(?<=[a-z]{3})(?=[A-Z][a-z]{2})")
_TOKEN = re.compile(r"[^\W_]+\.?")


def business_of(token: str, dotted: bool) -> tuple[str, ...]:
    """The lines of business that a word states in full or may shorten."""
    if token in BUSINESS:
        return (token,)
    if token in _SHORT:
        return (_SHORT[token],)
    if len(token) < 2 or len(token) > 9:
        return ()
    if dotted or len(token) >= 4:
        begun = tuple(b for b in BUSINESS if b.startswith(token))
        if begun:
            return begun
    if len(token) >= 3 and not re.search(r"[aeiou].*[aeiou]", token):
        squeezed = tuple(b for b in BUSINESS if b[0] == token[0] and b[-1] == token[-1] and _subsequence(token, b) and not (set(re.sub(r"[aeiou]", "", b)) - set(token)))
        if squeezed:
            return squeezed
        if re.fullmatch(r"[^aeiou]+", token):
            return tuple(b for b in BUSINESS if b[0] == token[0] and _subsequence(token, b) and len(b) <= 2 * len(token) + 2)
    if len(token) >= 5:
        for b in BUSINESS:
            if -2 < len(b) - len(token) < 2 and _one_edit(token, b):
                return (b,)
    return ()


def _one_edit(a: str, b: str) -> bool:
    """Whether two different strings are one insertion, deletion, substitution or swap of neighbours apart."""
    n, m = len(a), len(b)
    i = 0
    while i < n and i < m and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and j < m - i and a[n - 1 - j] == b[m - 1 - j]:
        j += 1
    x, y = a[i : n - j], b[i : m - j]
    return max(len(x), len(y)) <= 1 or (len(x) == 2 and x == y[::-1])


def _subsequence(short: str, text: str) -> bool:
    it = iter(text)
    return all(c in it for c in short)


def parsed(name: str) -> tuple[str, str, str, list[str]]:
    """(core, first word, initial, lines of business) of a name; core '' if it names no company.

    ``initial`` is the letter that stands for the second word, or ''.
    """
    text = unicodedata.normalize("NFKD", name)
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    text = _BRACKET.sub(" ", text)
    flat = re.sub(r"\s+", " ", text).strip().casefold()
    bare = re.sub(r"^[^\w]+|[^\w]+$", "", flat)
    if not re.search(r"[^\W\d_]{2}", bare) or bare in STAND_INS or bare in NO_EMPLOYER or bare.replace(" ", "-") in NO_EMPLOYER or bare.replace(" ", "") in NO_EMPLOYER:
        return "", "", "", []
    text = _DOTTED.sub(lambda m: " " + re.sub(r"[^\w]", "", m[0]) + " " if len(re.sub(r"\W", "", m[0])) <= 5 else m[0], text)
    text = _CAMEL.sub(" ", text)
    words: list[str] = []
    business: list[str] = []
    initial = ""
    for t in _TOKEN.findall(text):
        dotted = t.endswith(".")
        w = t.rstrip(".").casefold()
        if any(c.isalpha() for c in w):
            w = w.translate(_LEET)
        if w in LEGAL:
            continue
        if len(w) == 1:
            initial = initial or w
            continue
        found = business_of(w, dotted) if not business else ()
        if found:
            business = list(found)
        else:
            words.append(w)
    words = sorted(words, key=lambda w: (-len(w), w)) if len(words) == 2 else words
    core = "".join(words)
    if len(core) < 3:
        return "", "", "", []
    return core, words[0] if len(words) > 1 or initial else "", initial if len(words) == 1 else "", business


#: Cores of a key above which they are divided by what is left of them.
SHARED_BY_MANY = 200
#: Kinds of edits, and of how many places and letters one of them is in a core of n letters.
EDITS = {"swap": lambda n: n, "double": lambda n: 2 * n, "letter": lambda n: 27 * n, "other": lambda n: 25 * n}
#: Letters of a remainder from which it is divided by keys of its own segments instead.
LONG = 40


def _half(n: int) -> int:
    """Letters of the first and of the last part of a core of n letters: an even number, half of it or less, 16 at most."""
    return min(16, n // 4 * 2)


def _without_one(text: str) -> set[str]:
    return {text[:i] + text[i + 1 :] for i in range(len(text))}


def own_keys(core: str) -> list[str]:
    """Keys under which a core is found.

    Two edits leave one of its ends (disjoint first and last parts) with one edit at most, and
    strings within one edit have a form in common in which each lacks one letter or none. Cores
    of fewer than ten letters are found whole as well, with one edit.
    """
    n = len(core)
    found = {f"W:{x}" for x in {core} | _without_one(core)} if 4 <= n < 10 else set()
    if n >= 8:
        h = _half(n)
        for side, part in (("P", core[:h]), ("S", core[-h:])):
            found |= {f"{side}{h}:{x}" for x in {part} | _without_one(part)}
    return sorted(found)


def asked_keys(core: str) -> list[str]:
    """Keys under which the cores within the edits allowed to this one are found: its own ends may be one letter shorter or longer than theirs."""
    n = len(core)
    if n < 6:
        return []
    found = {f"W:{x}" for x in {core} | _without_one(core)} if n < 10 else set()
    for h in {_half(m) for m in (range(max(8, n - 2), n + 3) if n >= 10 else range(10, n + 2))}:
        for side, end in (("P", lambda k: core[:k]), ("S", lambda k: core[n - k :])):
            found |= {f"{side}{h}:{x}" for x in {end(h - 1), end(h)} | _without_one(end(h)) | (_without_one(end(h + 1)) if h < n else set())}
    return sorted(found)


def thinned(rest: str) -> set[str]:
    """A string with up to two letters taken out."""
    one = _without_one(rest)
    return {rest} | one | {r for x in one for r in _without_one(x)}


def _rest(core: str, side: str, k: int) -> str:
    return core[k:] if side == "P" else core[: len(core) - k]


def own_parts(core: str, key: str) -> list[str]:
    """What the cores of a key that many share are divided by: the rest without the key's end, thinned or, if long, by its own keys."""
    rest = _rest(core, key[0], int(key[1 : key.index(":")]))
    return sorted((thinned(rest) if len(rest) <= LONG + 2 else set()) | (set(own_keys(rest)) if len(rest) > LONG - 2 else set()))


def asked_parts(core: str, key: str) -> list[str]:
    """The same of a core that asks, whose end may be one letter shorter or longer."""
    head, _, form = key.partition(":")
    side, h = head[0], int(head[1:])
    out: set[str] = set()
    for k in (h - 1, h, h + 1):
        end = core[:k] if side == "P" else core[max(0, len(core) - k) :]
        if form == end or form in _without_one(end):
            rest = _rest(core, side, k)
            out |= thinned(rest) if len(rest) <= LONG else set(asked_keys(rest))
    return sorted(out)


def _listed(make, *columns: str) -> Column:
    """``make`` of the columns, in Arrow batches, one row for each item."""

    @F.pandas_udf("array<string>")
    def made(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([make(*row) for row in zip(*part, strict=True)], dtype=object)

    @F.pandas_udf("array<string>")
    def made_of_one(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([make(x) for x in part], dtype=object)

    return F.explode(once(made if len(columns) > 1 else made_of_one)(*columns))


def near_rounds(cores: DataFrame, many: int = SHARED_BY_MANY) -> Iterator[DataFrame]:
    """(core, n, to, m, d): each core with the more frequent cores within the edits allowed to it, d edits apart.

    The rounds together have every pair, some more than once. The last is of pairs of which one core at least is above LONGEST letters.
    """
    sizes = {r.k: r.c for r in cores.groupBy(F.length("core").alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}
    yield from near_cores.near_rounds(cores, sum(near_cores.forms_of(k) * c for k, c in sizes.items() if k <= LONGEST))
    if any(k > LONGEST for k in sizes):
        yield _apart(_met_by_ends(cores.where(F.length("core") > LONGEST - 2), many).where(F.greatest(F.length("core"), F.length("to")) > LONGEST))


def candidate_pairs(cores: DataFrame, many: int = SHARED_BY_MANY) -> DataFrame:
    """The pairs of ``near_rounds``, each once."""
    met = cores.sparkSession.createDataFrame([], "core string, n long, to string, m long, d int")
    for part in near_rounds(cores, many):
        met = met.unionByName(part)
    return met.distinct()


def nearest(cores: DataFrame) -> DataFrame:
    """(core, n, kinds, d, m, to): of the pairs of ``near_rounds``, the most frequent ``to`` for each core and kinds of edits.

    Nothing else can be the best candidate, and there are six rows for a core at most, however many pairs it has.
    """
    best = lambda df: df.groupBy("core", "n", "kinds", "d").agg(F.max("top").alias("top"))
    parts = []
    for part in near_rounds(cores):
        if parts:
            released(cores.sparkSession)
        parts.append(checkpointed(best(part.select("core", "n", "d", F.struct("m", "to").alias("top"), once(_kinds)("core", "to").alias("kinds")))))
    if not parts:
        return cores.sparkSession.createDataFrame([], "core string, n long, kinds array<string>, d int, m long, to string")
    near = parts[0] if len(parts) == 1 else checkpointed(best(reduce(DataFrame.unionByName, parts)))
    return near.select("core", "n", "kinds", "d", "top.m", "top.to")


def _met_by_ends(cores: DataFrame, many: int) -> DataFrame:
    """(core, n, to, m) of cores that may be near each other. Pairs are tested where they meet, before anything else is shuffled."""
    held = cores.select(F.col("core").alias("to"), F.col("n").alias("m"), _listed(own_keys, "core").alias("key"))
    asked = cores.where("length(core) >= 6").select("core", "n", _listed(asked_keys, "core").alias("key"))
    near = "(m > n OR (m = n AND to < core)) AND abs(length(core) - length(to)) <= 2 AND levenshtein(core, to, 4) >= 0"
    shared = checkpointed(held.where("key NOT LIKE 'W%'").groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > many).select("key"))
    if shared.isEmpty():
        return asked.join(held, "key").where(near).select("core", "n", "to", "m")
    met = asked.join(shared, "key", "left_anti").join(held, "key").where(near).select("core", "n", "to", "m")
    divided_held = held.join(shared, "key", "left_semi").select("to", "m", "key", _listed(own_parts, "to", "key").alias("part"))
    divided_asked = asked.join(shared, "key", "left_semi").select("core", "n", "key", _listed(asked_parts, "core", "key").alias("part"))
    met = met.unionByName(divided_asked.join(divided_held, ["key", "part"]).where(near).select("core", "n", "to", "m"))
    return met


def _apart(met: DataFrame) -> DataFrame:
    """The pairs with their distance, each once, within the edits allowed."""
    met = met.distinct().withColumn("d", once(_edits)("core", "to"))
    return met.where((F.col("d") == 1) | (F.col("d") == 2) & (F.length("core") >= 10))


def edit_kinds(a: str, b: str) -> list[str]:
    """The kinds of the one or two edits between two strings."""
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    j = next((j for j, (x, y) in enumerate(zip(a[: i - 1 if i else None : -1], b[: i - 1 if i else None : -1], strict=False)) if x != y), min(len(a), len(b)) - i)
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    if len(x) == len(y) == 2 and x == y[::-1]:
        return ["swap"]
    if len(x) + len(y) == 1:
        c = x or y
        longer = a if x else b
        return ["double" if c in (longer[i - 1 : i], longer[i + 1 : i + 2]) else "letter"]
    if len(x) == len(y) == 1:
        return ["other"]
    return ["letter" if len(x) != len(y) else "other"] * 2


@F.pandas_udf(ArrayType(StringType()))
def _kinds(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_kinds(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def _is_kind(kind: str):
    return lambda k: F.when(k == kind, k)


@dataclass(frozen=True)
class Channel:
    """What was learned: the rate of each kind of edit in a name, the entropy of a letter, and how many cores there are."""

    rates: dict[str, float]
    entropy: float
    cores: int

    def cost(self, kinds: Column, letters: Column) -> Column:
        """The summed costs of edits in a core of so many letters."""
        each = F.lit(0.0)
        for kind, choices in EDITS.items():
            each = each + F.size(F.array_compact(F.transform(kinds, _is_kind(kind)))) * (F.log(choices(letters).cast("double")) - math.log(self.rates[kind]))
        return each

    def by_chance(self, letters: Column) -> Column:
        """The cost of another company of the same name."""
        return F.greatest(F.lit(0.0), letters * self.entropy - math.log(max(self.cores, 1)))

    @property
    def mean_cost(self) -> float:
        """The cost of an edit whose kind is not known, in a word of eight letters."""
        return sum(math.log(c(8)) - math.log(self.rates[k]) for k, c in EDITS.items()) / len(EDITS)


def learned(near: DataFrame, cores: DataFrame) -> Channel:
    """The channel of a table. Counts are taken over all its cores; only a dozen numbers come to the driver.

    An edit counts if it is the only one between a core of ten letters or more and one ten times
    as frequent; a kind that was never seen counts half a time.
    """
    sure = near.where("d = 1 AND length(core) >= 10 AND 10 * n <= m").groupBy("core").agg(F.max("n").alias("n"), F.max_by("kinds", F.struct("m", "to")).alias("kinds"))
    seen = {r.kind: r.n for r in sure.select(F.explode("kinds").alias("kind"), "n").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    each = cores.select(F.explode(F.split("core", "")).alias("c"), (1 / F.length("core")).alias("share")).where("c <> ''")  # a long core counts as much as a short one
    letters = each.groupBy("c").agg(F.sum("share").alias("k"))
    whole = letters.agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.log("k")).alias("klogk")).first()
    typed = cores.agg(F.count(F.lit(1)).alias("cores"), F.coalesce(F.sum(F.when(F.length("core") >= 10, F.col("n"))), F.lit(0)).alias("n")).first()
    entropy = math.log(whole["all"]) - whole["klogk"] / whole["all"] if whole["all"] else 1.0
    return Channel({kind: (seen.get(kind, 0) + 0.5) / (typed["n"] + 100) for kind in EDITS}, entropy, typed["cores"])


@F.pandas_udf(IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def parsed_names(names: DataFrame) -> DataFrame:
    """name, n, core, first, initial, business of each distinct name that names a company."""
    schema = "name string, n long, core string, first string, initial string, business array<string>"

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(name, n, *parsed(name)) for name, n in zip(part["name"], part["n"], strict=True)]
            yield pd.DataFrame([r for r in rows if r[2]], columns=["name", "n", "core", "first", "initial", "business"])

    return names.mapInPandas(parse, schema)


def _roots(links: DataFrame, column: str = "core") -> DataFrame:
    """(core, root): where following the links ends. Each link goes to a more frequent core, so there are no cycles."""
    at = checkpointed(links)
    while True:
        step = at.select(F.col(column).alias("parent"), F.col("parent").alias("next"))
        at2 = checkpointed(at.join(step, "parent", "left").select(column, F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")))
        moved = at2.where("moved").isEmpty()
        at = at2.select(column, "parent")
        if moved:
            return at.withColumnRenamed("parent", "root")


def companies(df: DataFrame, name: str = "company_name") -> DataFrame:
    """(name, company) of each distinct spelling that names a company; equal company means the same one.

    NULL, blank values and stand-ins name none and are left out. Spellings are kept exactly as
    stored. Work is done on distinct spellings, so repeated rows cost one aggregation with
    map-side combination. An empty table gives an empty result.
    """
    names = df.select(F.col(name).cast("string").alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    parts = checkpointed(parsed_names(names))
    whole = parts.where("initial = ''")
    cores = checkpointed(whole.groupBy("core").agg(F.sum("n").alias("n"), F.max("first").alias("first")))
    near = nearest(cores)
    channel = learned(near, cores)
    letters = F.length("core")
    posterior = F.log("m") - channel.cost(F.col("kinds"), letters)
    likely = posterior > F.log("n") - channel.by_chance(letters)
    best = near.where(likely).groupBy("core").agg(F.max_by("to", F.struct(posterior, "to")).alias("parent"))
    roots = _roots(best)
    rooted = cores.select("core", "n", "first").join(roots, "core", "left").select("core", "n", "first", F.coalesce("root", "core").alias("root"))
    rooted = checkpointed(rooted)
    # Second words as initials: the most frequent core whose first word agrees up to one edit.
    short = parts.where("initial <> ''").select("first", "initial")
    deletions = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(64))))))
    full = rooted.where("first <> ''").groupBy(F.col("first").alias("word"), F.expr("substring(core, length(first) + 1, 1)").alias("initial")).agg(F.max(F.struct("n", "root")).alias("top"))
    full = full.select("word", "initial", "top.n", "top.root", F.explode(deletions(F.col("word"))).alias("key"))
    asked = short.select("first", "initial").distinct().select("first", "initial", F.explode(deletions(F.col("first"))).alias("key"))
    fits = asked.hint("merge").join(full, ["key", "initial"]).where("levenshtein(first, word) <= 2")
    held = fits.groupBy("first", "initial").agg(F.max_by("root", F.struct(F.log("n") - F.lit(channel.mean_cost) * F.levenshtein("first", "word"), "root")).alias("root"))
    abbreviated = parts.where("initial <> ''").join(held, ["first", "initial"], "left").select("name", "n", "business", F.coalesce("root", F.concat("first", F.lit(" "), "initial")).alias("root"))
    placed = checkpointed(whole.join(rooted.select("core", "root"), "core").select("name", "n", "business", "root").unionByName(abbreviated))
    # Lines of business divide a root; a name that leaves it open goes to the most frequent one it may mean.
    stated = placed.where("size(business) = 1").groupBy("root", F.col("business")[0].alias("b")).agg(F.sum("n").alias("bn"))
    options = stated.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("bn", "b")), asc=False).alias("options"))  # at most len(BUSINESS) for each root
    chosen = placed.join(options, "root", "left")
    fitting = F.filter("options", lambda o: (F.size("business") == 0) | F.array_contains("business", o["b"]))
    open_one = F.coalesce(F.get(fitting, F.lit(0))["b"], F.get("business", F.lit(0)), F.lit(""))
    line = F.when(F.size("business") == 1, F.col("business")[0]).otherwise(open_one)
    return chosen.select("name", F.concat_ws("|", "root", line).alias("company"))


def spelling_pairs(df: DataFrame, name: str = "company_name") -> DataFrame:
    """(name_a, name_b): every pair of different spellings of one company, name_a first by code points.

    The pairs of one company are as many as its distinct spellings make; rows do not matter.
    """
    classes = checkpointed(companies(df, name))
    a, b = classes.select("company", F.col("name").alias("name_a")), classes.select("company", F.col("name").alias("name_b"))
    return a.join(b, "company").where("name_a < name_b").select("name_a", "name_b")


def spelling_classes(df: DataFrame, name: str = "company_name") -> DataFrame:
    """(name, canonical, spellings): each spelling with its company's most frequent spelling and their number."""
    classes = companies(df, name)
    counts = df.select(F.col(name).cast("string").alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    both = classes.join(counts, "name")
    top = both.groupBy("company").agg(F.max_by("name", F.struct("n", "name")).alias("canonical"), F.count(F.lit(1)).alias("spellings"))
    return both.join(top, "company").select("name", "canonical", "spellings")
