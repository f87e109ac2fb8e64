"""Free-typed titles led to the entries of a reference list.

A title is cut at its separators into pieces. Every run of pieces, in a canonical wording
(abbreviations spelled out, headword last, no function words), goes in batches through
BK-trees over the reference forms under the unrestricted Damerau-Levenshtein distance: first
with no edits allowed, and what no form covers then with edits by its length. A candidate
counts only if also each word of it agrees with its counterpart, so a different word of
similar spelling is no match. Cut-off titles go through a tree of beginnings of the forms.
The smallest priority number of all denoted entries wins.

Other names of roles (other languages, synonyms) are a table of (form, name): names are forms
of their entry, in the tree like all others. Without a table the built-in list is used.

A reference list of up to MAX_ENTRIES rows is one index, longer ones are sharded by form and
the winners of the shards merged; an index is built once and broadcast, so rows never move:
the operator is one narrow pass without a shuffle, and a title that occurs in many rows is
looked up once per batch of rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import once
from ..functions.missing import is_blank
from .edit_tree import EditTree, distance

#: Largest reference list of one index, and most shards of longer ones.
MAX_ENTRIES = 20_000
MAX_SHARDS = 50

#: Rows of a task whose titles are looked up together, and titles whose results a worker keeps; both bound memory, not results.
LOOKED_UP_AT_ONCE = 100_000
KEPT_TITLES = 300_000

#: Other names of roles, as "reference form: names", used where no table of them is
#: given. Wording, order and abbreviation of the reference forms themselves need no entry here.
ALIASES = """
owner: business owner; owner operator; proprietor; founder owner; owner founder; inhaber; inhaberin; gründer; gründerin; propriétaire; fondateur; fondatrice; propietario; fundador; cofounder; co owner
chief executive officer: chief executive; geschäftsführer; geschäftsführerin; directeur général; directrice générale; director general; directora general; managing director md; vorstandsvorsitzender; pdg; gerente general; consejero delegado
chief financial officer: chief finance officer; fd; leiter finanzen; finanzleiter; directeur financier; director financiero; financial director; head of finance; finanzdirektor; kaufmännischer leiter; vp finance
chief revenue officer: cro; vertriebsleiter; leiter vertrieb; directeur commercial; director comercial; commercial director; vp of sales; verkaufsleiter; jefe de ventas
chief marketing officer: marketingleiter; leiter marketing; directeur marketing; director de marketing; chief brand officer
chief operating officer: chief operations officer; betriebsleiter; leiter betrieb; directeur des opérations; director de operaciones; vp operations
chief technology officer: chief technical officer; technischer leiter; directeur technique; director técnico; engineering director; vp technology; head of technology; technical director
chief information officer: information technology director; it leiter; leiter it; directeur informatique; director de informática; head of information technology; edv leiter
chief people officer: chief human resources officer; chro; chief hr officer; head of hr; human resources director; hr head; personalleiter; leiter personal; directeur des ressources humaines; drh; director de recursos humanos; people director; head of people; vp people; vp human resources
general counsel: gc; group general counsel; chief legal officer; clo; leiter recht; rechtsleiter; directeur juridique; director jurídico; leiter rechtsabteilung
procurement director: procurement head; head of procurement; purchasing director; einkaufsleiter; leiter einkauf; directeur des achats; chief procurement officer; procurement manager; director de compras; vp procurement
chief product officer: cpo product; cpo; vp product; vp product management; produktleiter; leiter produkt; directeur produit; director de producto; head of product management
chief data officer: cdo; head of analytics; data director; data and analytics director; head of data and analytics; data analytics director; leiter daten; vp data
chief information security officer: chief info security officer; information security director; security director; leiter sicherheit; head of information security; sicherheitsleiter; rssi
quality director: qa manager; quality manager; qualitätsleiter; leiter qualität; directeur qualité; director de calidad; head of quality assurance; qm leiter
facilities manager: facility manager; facilities management head; head of facilities management; facilities director; leiter facility management; gebäudeleiter; responsable des services généraux
logistics director: scm manager; supply chain director; head of supply chain; leiter logistik; logistikleiter; directeur logistique; director de logística; logistics manager; responsable logistique
customer success director: cs director customer success; customer success manager; cs director; leiter kundenerfolg; vp customer success; chief customer officer
communications director: comms director; head of comms; pr manager; corporate communications director; director corporate communications; pressesprecher; leiter kommunikation; kommunikationsleiter; directeur de la communication; pr director; head of corporate communications
project manager: program manager; project manager pmp; projektleiter; projektleiterin; chef de projet; jefe de proyecto; projektmanager; pm
sustainability director: esg and sustainability director; esg director; head of esg; chief sustainability officer; cso sustainability; nachhaltigkeitsleiter; leiter nachhaltigkeit; directeur développement durable; sustainability manager
research director: r and d director; research and development director; head of r and d; head of research; forschungsleiter; leiter forschung; directeur de la recherche; director de investigación; vp research
chief compliance officer: cco compliance; compliance director; regulatory compliance manager; regulatory compliance director; leiter compliance; compliance leiter; responsable conformité
training manager: l and d manager; head of l and d; learning and development manager; learning and development director; ausbildungsleiter; leiter schulung; schulungsleiter; responsable formation; head of training; training director
ecommerce director: ecommerce lead head; head of ecom; ecommerce manager; leiter ecommerce; ecommerce leiter; responsable ecommerce; vp ecommerce
design director: chief design officer; head of creative; chief creative officer; vp design; leiter design; directeur artistique; director creativo; designleiter
site manager: building site manager; bauleiter; bauleiterin; construction site manager; chef de chantier; jefe de obra; construction director
plant manager: works manager; produktionsleiter; leiter produktion; werkleiter; werksleiter; production manager; production director; directeur d'usine; jefe de planta; director de planta
warehouse manager: lagerleiter; lagerleiterin; leiter lager; responsable d'entrepôt; jefe de almacén; warehouse director; warehousing manager
fleet manager: fuhrparkleiter; leiter fuhrpark; fleet and transport manager; responsable de flotte; transport director; jefe de flota; fuhrparkmanager
partnerships director: head of alliances and partnerships; alliances director; vp partnerships; partnership director; partnerships manager; alliances and partnerships director; head of alliances; leiter partnerschaften
property manager: head of real estate; immobilienverwalter; hausverwalter; leiter immobilien; property director; head of property; real estate manager; gestionnaire immobilier
practice manager: surgery practice manager; surgery manager; medical practice manager; praxismanager; praxismanagerin; praxisleiter; dental practice manager
store manager: filialleiter; filialleiterin; shop manager; marktleiter; gérant de magasin; jefe de tienda; retail store manager; ladenleiter; gestor de tienda
tax director: vp tax; group tax head; group head of tax; leiter steuern; steuerleiter; tax manager; directeur fiscal; chief tax officer
internal audit director: chief audit executive; cae; internal audit manager; leiter interne revision; leiter revision; audit director; head of audit; directeur de l'audit interne; revisionsleiter
"""

#: Abbreviations in titles and what they stand for.
SHORT = {
    "dir": "director", "dirctor": "director", "direetor": "director", "mgr": "manager", "mngr": "manager", "mgmt": "management", "hd": "head",
    "chf": "chief", "off": "officer", "ofc": "officer", "exec": "executive", "info": "information", "mktg": "marketing", "mkt": "marketing",
    "eng": "engineering", "engg": "engineering", "ops": "operations", "cust": "customer", "dev": "development", "devt": "development",
    "proj": "project", "prog": "programme", "whse": "warehouse", "ecom": "ecommerce", "gen": "general", "sustainab": "sustainability",
    "fin": "finance", "acct": "accounting", "tech": "technology", "purch": "purchasing", "procmt": "procurement", "corp": "corporate",
    "natl": "national", "intl": "international", "asst": "assistant", "sr": "senior", "jr": "junior", "svp": "vp", "evp": "vp", "avp": "vp",
    "prod": "product", "qual": "quality", "log": "logistics", "pres": "president", "snr": "senior", "comm": "communications", "comms": "communications",
}

#: Words before or after a role that leave it what it is.
AROUND = frozenset("interim acting group regional senior global european national international lead executive principal joint founding divisional the area district country co".split())

#: Words that make a title serve someone in a role instead of holding it.
SERVING = frozenset("assistant secretary pa ea aide intern deputy trainee student apprentice nephew".split())

_HEADS = ("director", "manager", "head")
_DROP = frozenset(("of", "and", "the", "for", "de", "du"))
_CUT = re.compile(r"(?:\.{3,}|…)\s*$")
_INITIALS = re.compile(r"\b(?:[a-z]\s?\.\s?){2,5}[a-z]?\b\.?|\b[a-z](?:\.[a-z]){1,4}\b\.?")
_SEPARATORS = re.compile(r"\s*[,;/|&()\[\]\"“”+–—:]\s*|\s+-+\s+|\s+(?:and|und|et|y)\s+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def spelled(text: str) -> str:
    """Lower case, one space between words, dotted initials joined, known short words spelled out."""
    t = unicodedata.normalize("NFKC", text).casefold()
    t = "".join(" " if c == "_" or c.isspace() else c for c in t if unicodedata.category(c) != "Cf")
    t = _INITIALS.sub(lambda m: re.sub(r"[^a-z]", "", m[0]) + " ", t)
    t = re.sub(r"\br\s*(?:&|and|\+)\s*d\b", "research and development", t)
    t = re.sub(r"\bl\s*(?:&|and|\+)\s*d\b", "learning and development", t)
    t = re.sub(r"\be\s*-?\s*commerce\b", "ecommerce", t)
    t = re.sub(r"\bco\s*-?\s*(?=founder|owner)", "co", t)
    t = re.sub(r"\bvice[\s-]+president\b", "vp", t)
    return re.sub(r"\s+", " ", t).strip()


def words_of(piece: str) -> list[str]:
    """The words of a piece, spelled out, without dots and hyphens."""
    return [SHORT.get(w, w) for w in _WORD.findall(piece)]


def canonical(words: list[str]) -> str:
    """A wording that does not depend on order: function words dropped, the headword last."""
    kept = [w for w in words if w not in _DROP]
    while len(kept) > 1 and kept[0] in AROUND and not (kept[0] == "executive" and kept[1] == "officer"):
        kept = kept[1:]
    while len(kept) > 1 and kept[-1] in AROUND:
        kept = kept[:-1]
    if len(kept) > 1 and kept[0] in _HEADS:
        kept = [*kept[1:], kept[0]]
    return " ".join(kept)


def threshold(text: str) -> int:
    """How many edits a form of this length may differ by."""
    n = len(text)
    return 0 if n < 5 else 1 if n < 9 else 2 if n < 18 else 3


def words_agree(typed: str, form: str, known: frozenset[str]) -> bool:
    """Whether each word is a misspelling of its counterpart; a known other word is none."""
    a, b = typed.split(), form.split()
    if len(a) != len(b):
        joined_a, joined_b = "".join(a), "".join(b)
        return len(joined_b) >= 7 and distance(joined_a, joined_b) <= (0 if len(joined_b) < 9 else 1 if len(joined_b) < 16 else 2) and abs(len(a) - len(b)) == 1
    short_edits = 0
    for x, y in zip(a, b, strict=True):
        if x == y:
            continue
        if x in known:
            return False
        n = max(len(x), len(y))
        limit = 1 if n < 7 else 2 if n < 12 else 3
        if (n < 4 and len(x) < len(y) - 1) or distance(x, y) > limit:
            return False
        short_edits += n < 4
    return short_edits < len(b)


class TitleIndex:
    """The reference forms and the BK-trees over them; built once per worker process."""

    def __init__(self, entries: list[tuple[int, str]], catch_all: int | None, names: list[tuple[str, str]] | None = None, vocabulary: frozenset[str] | None = None) -> None:
        """``entries``: (priority, reference form); ``catch_all``: priority of what denotes none.

        ``names``: (reference form, other name); ``vocabulary``: the words of all forms, where the entries are a part of them.
        """
        self.catch_all = catch_all
        self.forms: dict[str, int] = {}
        self.own: set[str] = set()
        self.raw: dict[str, int] = {}
        by_form = {}
        for priority, form in sorted(entries):
            self._add(form, priority)
            self.own.add(canonical(words_of(spelled(form))))
            by_form.setdefault(canonical(words_of(spelled(form))), priority)
        for form, name in known_names() if names is None else names:
            priority = by_form.get(canonical(words_of(spelled(form))))
            if priority is not None:
                self._add(name, priority)
        self.known = (vocabulary_of(entries) if vocabulary is None else vocabulary) | AROUND | SERVING
        self.tree = EditTree(sorted(self.forms, key=lambda f: (-len(f), f)))
        #: The forms that begin with what is in the tree of beginnings: from four letters, from nine on at every third.
        self.begun: dict[str, set[str]] = {}
        for raw in self.raw:
            for n in [n for n in range(4, len(raw)) if n < 9 or n % 3 == 0]:
                self.begun.setdefault(raw[:n], set()).add(raw)
        self.prefix_tree = EditTree(sorted(self.begun))
        self.memory: dict[str, int | None] = {}

    def _add(self, form: str, priority: int) -> None:
        words = words_of(spelled(form))
        key = canonical(words)
        if not key:
            return
        self.forms[key] = min(priority, self.forms.get(key, priority))
        kept = [w for w in words if w not in ("the",)]
        orders = [" ".join(kept)]
        head = next((h for h in _HEADS if h in (kept[0], kept[-1])), None)
        if head:
            rest = " ".join(w for w in (kept[1:] if kept[0] == head else kept[:-1]) if w != "of" or head not in kept)
            rest = rest.removeprefix("of ")
            orders += [f"{rest} {head}", f"{head} {rest}", f"{head} of {rest}"]
        for order in orders:
            self.raw[order] = min(priority, self.raw.get(order, priority))

    # -- lookup ---------------------------------------------------------------------------

    def _pieces(self, text: str) -> tuple[list[list[str]], list[str]]:
        """The words of each piece of a spelled-out title; for a cut-off one also what it may begin, longest first."""
        cut = bool(_CUT.search(text))
        text = _CUT.sub("", text)
        at, spans = 0, []
        for m in [*_SEPARATORS.finditer(text), None]:
            spans.append((at, m.start() if m else len(text)))
            at = m.end() if m else at
        pieces = [(a, w) for a, b in spans if (w := words_of(text[a:b]))]
        stubs = []
        if cut:
            for a, _ in pieces:
                stub = [w for w in words_of(text[a:]) if w != "the"]
                while len(stub) > 1 and stub[0] in AROUND:
                    stub = stub[1:]
                stubs.append(" ".join(stub))
        return [w for _, w in pieces], stubs

    @staticmethod
    def _runs(pieces: list[list[str]]) -> list[tuple[str, range]]:
        """The wording of each run of up to four pieces and the pieces it covers; none for a headword that two subjects share.

        Such a headword ("head of a and b", "a and b director") is a wording of the subject that lacks it.
        """
        out = [(canonical([w for p in pieces[i:j] for w in p]), range(i, j)) for i in range(len(pieces)) for j in range(i + 1, min(len(pieces), i + 4) + 1)]
        for a, b in zip(pieces, pieces[1:], strict=False):
            for one, other in ((a, b), (b, a)):
                head = next((w for w in (one[0], one[-1]) if w in _HEADS), None)
                if head and len(one) > 1 and not set(other) & set(_HEADS):
                    out.append((canonical([*other, head]), range(0)))
        return out

    def _near(self, queries: list[str], limits: list[int]) -> dict[str, list[tuple[int, str]]]:
        """For each wording the (distance, form) of all forms within its limit."""
        return {q: [(d, self.tree.words[at]) for d, at in hits] for q, hits in zip(queries, self.tree.within(queries, limits), strict=True)}

    def _typed(self, words: list[str]) -> list[str]:
        """Wordings under which a misspelled piece is looked up."""
        plain = canonical(words)
        kept = plain.split()
        out = [plain]
        if len(kept) > 1 and kept[0] not in _HEADS and any(abs(len(kept[0]) - len(h)) <= 2 and kept[0][:1] in "dhmae" for h in _HEADS):
            head = next((h for h in _HEADS if kept[0] not in self.known and distance(kept[0], h) <= (1 if h == "head" else 2)), None)
            if head:
                rest = kept[1:]
                if len(rest) > 1 and len(rest[0]) <= 3 and rest[0] not in self.known and distance(rest[0], "of") <= 1:
                    rest = rest[1:]
                out.append(" ".join([*rest, head]))
        if len(kept) > 2 and kept[-1] in _HEADS and len(kept[0]) <= 3 and kept[0] not in self.known and distance(kept[0], "of") <= 1:
            out.append(" ".join(kept[1:]))
        return out

    def look_up(self, titles: list[str]) -> list[int | None]:
        """The priority that each title denotes; the catch-all's if none, NULL if there is no catch-all."""
        forms = [spelled(t) for t in titles]
        each = list(dict.fromkeys(forms))
        known = dict(zip(each, self._look_up(each), strict=True))
        return [known[f] for f in forms]

    def _look_up(self, titles: list[str]) -> list[int | None]:
        denoted: list[set[int]] = [set() for _ in titles]
        cut = [self._pieces(title) for title in titles]
        serving = [not pieces or any(p[0] in SERVING or p[-1] in SERVING or "assistant" in p for p in pieces) for pieces, _ in cut]
        runs = [[] if none else self._runs(pieces) for none, (pieces, _) in zip(serving, cut, strict=True)]
        wordings = list(dict.fromkeys(q for each in runs for q, _ in each))
        as_is = self._near(wordings, [0] * len(wordings))
        queries: list[tuple[int, str]] = []
        stubs: list[tuple[int, list[str]]] = []
        for n, (pieces, begun) in enumerate(cut):
            if serving[n]:
                continue
            covered: set[int] = set()
            for q, places in runs[n]:
                for _, form in as_is[q]:
                    denoted[n].add(self.forms[form])
                    covered.update(places)
            if begun and len(pieces) - 1 not in covered:
                stubs.append((n, begun))
            queries += [(n, q) for i, p in enumerate(pieces) if i not in covered for q in self._typed(p)]
            if len(pieces) in (2, 3) and not covered:
                queries += [(n, q) for q in self._typed([w for p in pieces for w in p])]
        unique = list(dict.fromkeys(q for _, q in queries))
        near = self._near(unique, [threshold(q) for q in unique])
        for n, q in queries:
            # Another name of a role may differ by one edit only: it is farther from the list itself.
            good = [(d, self.forms[f]) for d, f in near[q] if (d < 2 or f in self.own) and words_agree(q, f, self.known)]
            if good:
                denoted[n].add(min(good)[1])
        for n, priority in self._stubs(stubs):
            denoted[n].add(priority)
        return [min(found) if found else self.catch_all for found in denoted]

    def _stubs(self, stubs: list[tuple[int, list[str]]]) -> list[tuple[int, int]]:
        """Cut-off titles: the entry that their text, as it is or else within edits, begins."""
        asked = [(n, t, t if len(t) < 9 else t[: len(t) // 3 * 3]) for n, texts in stubs for t in texts if len(t) >= 4]
        exact: dict[int, set[int]] = {}
        hits = self.prefix_tree.within([q for _, _, q in asked], [0] * len(asked))
        for (n, text, _), near in zip(asked, hits, strict=True):
            if n not in exact:
                priorities = {self.raw[r] for _, at in near for r in self.begun[self.prefix_tree.words[at]] if r.startswith(text) and r != text}
                if priorities:
                    exact[n] = priorities
        out = [(n, min(found)) for n, found in exact.items() if len(found) <= 2]
        unsure = [(n, texts[0][: len(texts[0]) // 3 * 3]) for n, texts in stubs if n not in exact and texts and len(texts[0]) >= 9]
        hits = self.prefix_tree.within([s for _, s in unsure], [1 if len(s) < 12 else 2 for _, s in unsure])
        for (n, stub), near in zip(unsure, hits, strict=True):
            near = [(d, self.prefix_tree.words[at]) for d, at in near if len(self.prefix_tree.words[at]) >= 9]
            if near:
                best = min(d for d, _ in near)
                priorities = {self.raw[r] for d, begun in near if d == best for r in self.begun[begun]}
                if 0 < len(priorities) <= 2:
                    out.append((n, min(priorities)))
        return out


def known_names() -> list[tuple[str, str]]:
    """The built-in (reference form, other name) pairs."""
    lines = [line.partition(":") for line in ALIASES.strip().splitlines()]
    return [(form, name) for form, _, names in lines for name in names.split(";")]


def vocabulary_of(entries: list[tuple[int, str]]) -> frozenset[str]:
    """The words of the reference forms."""
    return frozenset(w for _, form in entries for w in canonical(words_of(spelled(form))).split())


def title_entries(hooks: DataFrame) -> tuple[list[tuple[int, str]], int | None]:
    """(priority, form) of every alternative of a rule table, and the catch-all's priority.

    The catch-all is the row whose pattern is ``.*``. A table above MAX_SHARDS * MAX_ENTRIES rows is refused.
    """
    most = MAX_SHARDS * MAX_ENTRIES
    rows = hooks.select("priority", "title_pattern").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} reference entries")
    entries, catch_all = [], None
    for r in rows:
        if r.priority is None or r.title_pattern is None:
            continue
        if r.title_pattern.strip() in (".*", ".+", ""):
            catch_all = r.priority
        else:
            entries += [(int(r.priority), form) for form in r.title_pattern.split("|") if form.strip()]
    return entries, catch_all


def title_names(names: DataFrame | None, bound: int = 1_000_000) -> list[tuple[str, str]]:
    """(reference form, other name) of a table with the columns ``form`` and ``name``; the built-in ones for None."""
    if names is None:
        return known_names()
    rows = names.select("form", "name").where("form IS NOT NULL AND name IS NOT NULL").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} other names")
    return [tuple(r) for r in rows]


def map_titles(df: DataFrame, hooks: DataFrame, title: str = "job_title", out: str = "title_priority", names: DataFrame | None = None) -> DataFrame:
    """Add the priority of the reference entry that each title denotes; ``names`` has other names of entries (form, name).

    Titles without a visible character, and NULL, get NULL. A title that denotes no entry gets
    the catch-all's priority (NULL without a catch-all). Equal titles get equal results. All
    columns of ``df`` stay; a column named as ``out`` is replaced. An empty table stays empty.
    """
    entries, catch_all = title_entries(hooks)
    others, vocabulary = title_names(names), vocabulary_of(entries)
    ordered = sorted(entries, key=lambda e: (canonical(words_of(spelled(e[1]))), e))
    shards = [ordered[i : i + MAX_ENTRIES] for i in range(0, len(ordered), MAX_ENTRIES)] or [[]]
    found = [_lookup(df, TitleIndex(shard, None, others, vocabulary))(F.col(title).cast("string")) for shard in shards]
    best = found[0] if len(found) == 1 else F.array_min(F.array(*found))  # NULLs are passed over
    seen = F.regexp_replace(F.col(title).cast("string"), r"[\p{Z}\p{C}\s]+", "") != ""
    return df.withColumn(out, F.when(seen, F.coalesce(best, F.lit(catch_all).cast("int"))))


def _lookup(df: DataFrame, index: TitleIndex):
    """The look-up in one index as a column function; the index is broadcast (bounded by MAX_ENTRIES)."""
    shared = df.sparkSession.sparkContext.broadcast(index)

    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        waiting: list[pd.Series] = []
        rows = 0
        for texts in batches:
            waiting.append(texts)
            rows += len(texts)
            if rows >= LOOKED_UP_AT_ONCE:
                yield from answered(index, waiting)
                waiting, rows = [], 0
        yield from answered(index, waiting)

    def answered(index: TitleIndex, parts: list[pd.Series]) -> Iterator[pd.Series]:
        there = dict.fromkeys(t for texts in parts for t in texts.dropna().unique())
        new = [t for t in there if t not in index.memory]
        if len(index.memory) + len(new) > KEPT_TITLES:
            index.memory.clear()
            new = list(there)
        index.memory.update(zip(new, index.look_up(new), strict=True))
        local = {t: index.memory[t] for t in there}
        for texts in parts:
            yield texts.map(local.get).astype("Int32")

    @F.pandas_udf("int")
    def lookup(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from mapped(parts)

    return once(lookup)


def found_titles(leads: DataFrame, hooks: DataFrame) -> DataFrame:
    """(row_idx, priority) of every row with a visible job title."""
    return map_titles(leads.select("row_idx", "job_title"), hooks, out="priority").where("priority IS NOT NULL").select("row_idx", "priority")


def unmatched_titles(leads: DataFrame, hooks: DataFrame) -> DataFrame:
    """(job_title, n) of the titles that denote no entry, with their number of rows."""
    _, catch_all = title_entries(hooks)
    mapped = map_titles(leads.select("job_title"), hooks, out="priority").where(~is_blank(F.col("job_title")))
    none = F.col("priority").eqNullSafe(F.lit(catch_all).cast("int"))
    return mapped.where(none).groupBy("job_title").agg(F.count(F.lit(1)).alias("n"))
