"""Text normalizers and predicates as column expressions. NULL in gives NULL out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words dropped from the end of a company name.
COMPANY_ENDINGS = ("corp", "corporation", "inc", "incorporated", "llc", "ltd", "limited", "&", "and")
#: Generic endings of host labels, in the order in which they are tried.
BRAND_ENDINGS = ("company", "corporation", "holdings", "limited", "services", "service", "group", "inc", "ltd", "llc", "co")
#: Words of company names that say nothing.
COMPANY_STOP_WORDS = ("and", "associates", "company", "corp", "corporation", "group", "inc", "llc", "limited", "ltd", "partners", "the")
#: Cell values that count as empty.
PLACEHOLDERS = ("-", "n/a", "na", "none", "not available", "not revealed", "unknown")
#: Words of navigation labels.
NAVIGATION_WORDS = (
    "home", "about", "us", "our", "services", "products", "contact", "team", "menu", "login", "sign", "in", "up", "learn", "more", "click", "here", "read", "next", "back",
    "privacy", "policy", "terms", "conditions", "careers", "news", "resources", "solutions", "industries", "support", "search", "to", "find", "out",
)
#: Phrases of page text that is no evidence, then promotional ones.
BLOCKED_PHRASES = (
    "accept cookies", "cookie policy", "privacy policy", "terms of use", "all rights reserved", "subscribe to our newsletter", "javascript is disabled", "page not found",
    "access denied", "contact us today", "learn more", "cookies help us", "world-leading", "world leading", "industry-leading", "industry leading", "best-in-class",
    "best in class", "number one", "#1",
)
#: Last words that show a cut-off text.
CUT_WORDS = ("advis", "commer", "comp", "financ", "int", "intern", "internat", "manag", "servic", "solut", "transact")
#: Verbs that describe what a business does.
BUSINESS_VERBS = (
    r"\b(help|helps|support|supports|provide|provides|offer|offers|speciali[sz]e|speciali[sz]es|advise|advises|manage|manages|build|builds|deliver|delivers|"
    r"serve|serves|work with|works with|enable|enables|acquire|acquires|acquiring|buy|buys|buying|invest|invests|investing)\b"
)

#: What notices about cookies and rights say, claims in numbers, and openings that tell the reader what to do.
NOTICES = (
    r"(?i)\b(?:(?:we|this (?:site|website)) uses? cookies|accept (?:all )?cookies|cookie (?:policy|preferences|consent)|manage (?:your )?(?:cookies|consent)|consent preferences|all rights reserved)\b"
)
METRICS = r"(?i)\b\d+(?:\.\d+)?%|\b\d+[kmb]\+?\b|\b\d+\+\s+years?\b|\b(?:million|billion)\b"
ORDERS = r"^(?:visit|click|shop|browse|contact|download)\b|^\(?see\b"

_WORD = r"([A-Za-z0-9]+(?:[&'-][A-Za-z0-9]+)*)"
_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def stripped(col: Column) -> Column:
    """Outer white space of any script removed."""
    return F.regexp_replace(col, _ENDS, "")


def header_key(col: Column) -> Column:
    """A header as lower snake case."""
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(col)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def label_key(col: Column) -> Column:
    """A label in lower case with single spaces for all but letters a-z and digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "), "^ | $", "")


def email_key(col: Column) -> Column:
    """A mail address for comparison: outer white space off, lower case."""
    return F.lower(stripped(col))


def domain_of(col: Column) -> Column:
    """The host of an address without user, port, closing dots and one leading ``www.``; '' if there is none."""
    text = stripped(F.coalesce(col, F.lit("")))
    full = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))
    authority = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_extract(F.regexp_replace(authority, "^.*@", ""), "^([^:]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"\.+$", ""), r"^www\.", "")


def email_syntax_ok(col: Column) -> Column:
    """Whether a text is an ordinary mail address; false for NULL."""
    email = email_key(F.coalesce(col, F.lit("")))
    local = F.regexp_extract(email, "^([^@]*)@", 1)
    shape = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}$"
    return F.length(email).between(3, 254) & email.rlike(shape) & ~local.rlike(r"^\.|\.$|\.\.") & ~email.contains("\n")


def given_name(col: Column) -> Column:
    """The first word with a letter that is no form of address; '' if there is none."""
    words = F.filter(F.transform(F.split(stripped(col), r"\s+"), lambda w: F.regexp_replace(w, r"^[ ,;:.]+|[ ,;:.]+$", "")), lambda w: ~F.lower(w).isin("dr", "mr", "mrs", "ms", "prof"))
    named = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}]+", "")), lambda w: w != "")
    return F.coalesce(F.get(named, F.lit(0)), F.lit(""))


def brand_name(col: Column, words: int = 4) -> Column:
    """A short company name: an acronym in brackets, else the first words without legal endings and additions."""
    acronym = F.regexp_extract(col, r"\(([A-Z][A-Z0-9&.-]{1,9})\)", 1)
    cut = F.regexp_replace(col, r"(?s)\s*(?:\||\(|\[|[–—]|\s-\s).*$", "")
    ends = "|".join(COMPANY_ENDINGS)
    kept = F.regexp_replace(stripped(cut), rf"(?i)(?:\s+[,.;:-]*(?:{ends})[,.;:-]*)+$", "")
    short = F.regexp_replace(F.regexp_extract(kept, rf"^(\S+(?:\s+\S+){{0,{words - 1}}})", 1), r"\s+", " ")
    punctuation = r"^[ ,.;:&/-]+|[ ,.;:&/-]+$"
    return F.when(acronym != "", F.regexp_replace(acronym, punctuation, "")).otherwise(F.regexp_replace(short, punctuation, ""))


def opening_words(col: Column, n: int) -> Column:
    """The first n words (letters a-z, digits, apostrophes) in lower case."""
    return F.array_join(F.slice(F.regexp_extract_all(F.lower(col), F.lit("([a-z0-9']+)"), F.lit(1)), 1, n), " ")


def words(col: Column) -> Column:
    """The words of ASCII letters and digits, joined by inner ``& ' -``."""
    return F.regexp_extract_all(col, F.lit(_WORD), F.lit(1))


def word_total(col: Column) -> Column:
    """The number of words, of any script, with inner apostrophes and hyphens."""
    return F.size(F.regexp_extract_all(col, F.lit(r"(?U)\b[\w'-]+\b"), F.lit(0)))


def plain(col: Column) -> Column:
    """White space collapsed; outer white space, hyphens, bars and bullets removed."""
    return F.regexp_replace(F.regexp_replace(col, r"\s+", " "), "^[ \t\r\n|•-]+|[ \t\r\n|•-]+$", "")


def sentences(col: Column) -> Column:
    """The sentences of a text, each as ``plain``, without blank ones."""
    return F.filter(F.transform(F.split(plain(col), r"(?<=[.!?])\s+"), plain), lambda s: s != "")


def url_normal(col: Column) -> Column:
    """An http(s) address with lower-case host, without fragment and default port, path at least ``/``; NULL for others."""
    t = F.regexp_replace(stripped(col), "#.*$", "")
    scheme = F.lower(F.regexp_extract(t, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_replace(F.regexp_extract(t, "^[^:]*://([^/?]*)", 1), "^.*@", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(authority, "^([^:]*)", 1)), r"\.+$", "")
    port = F.regexp_extract(authority, ":([0-9]+)$", 1)
    path = F.regexp_extract(t, "^[^:]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(t, r"(\?.+)$", 1)
    default = (port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    whole = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), query)
    return F.when(scheme.isin("http", "https") & (host != ""), whole)


def brand_hint(host: Column) -> Column:
    """The letters and digits of a host's first label, without one generic ending if five characters remain."""
    label = F.regexp_replace(F.regexp_extract(F.regexp_replace(F.lower(host), r"^www\.", ""), "^([^.]*)", 1), "[^a-z0-9]", "")
    out = label
    for end in reversed(BRAND_ENDINGS):
        out = F.when(label.endswith(end) & (F.length(label) >= len(end) + 5), F.regexp_replace(label, f"{end}$", "")).otherwise(out)
    return out


def same_site(domain: Column, final_host: Column) -> Column:
    """Whether two hosts are the same, one below the other, or share a brand of five characters or more."""
    a, b = F.regexp_replace(F.lower(domain), r"^www\.", ""), F.regexp_replace(F.lower(final_host), r"^www\.", "")
    x, y = brand_hint(a), brand_hint(b)
    related = (a == b) | b.endswith(F.concat(F.lit("."), a)) | a.endswith(F.concat(F.lit("."), b))
    return related | ((F.least(F.length(x), F.length(y)) >= 5) & (x.contains(y) | y.contains(x)))


def first_phrase(col: Column, phrases: tuple[str, ...]) -> Column:
    """The first of the phrases that a text contains, without regard to case; '' if none."""
    low = F.lower(col)
    out = F.lit("")
    for phrase in reversed(phrases):
        out = F.when(low.contains(phrase.lower()), phrase).otherwise(out)
    return F.when(col.isNotNull(), out)


def match_form(col: Column) -> Column:
    """A text for literal comparison: quotes and ellipses as spaces, spaces collapsed, outer punctuation off, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.translate(col, "\"'“”‘’`…", "        "), r"\s+", " "), "^[ .,;:!?-]+|[ .,;:!?-]+$", ""))


def unfenced(col: Column) -> Column:
    """A text without a code fence (with or without a language) around it, outer white space off."""
    return stripped(F.regexp_replace(F.regexp_replace(stripped(col), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def is_quoted_in(quote: Column, text: Column) -> Column:
    """Whether a quote stands word for word in a text; false for a blank quote or NULL."""
    q = match_form(quote)
    return F.coalesce((q != "") & match_form(text).contains(q), F.lit(False))


def name_leaks(company: Column, phrase: Column) -> Column:
    """Whether a phrase begins with the company's first word (four letters or more) or shares two of its words."""
    own = F.filter(F.transform(words(company), F.lower), lambda w: ~w.isin(*COMPANY_STOP_WORDS))
    said = F.transform(words(phrase), F.lower)
    first = F.get(own, F.lit(0))
    begins = (F.length(first) >= 4) & (F.get(said, F.lit(0)) == first)
    return F.coalesce((F.size(own) > 0) & (F.size(said) > 0) & (begins | (F.size(F.array_intersect(F.array_distinct(own), F.array_distinct(said))) >= 2)), F.lit(False))


def shares_run(a: Column, b: Column, n: int) -> Column:
    """Whether two texts share a run of n words or more; linear in their lengths, by the overlap of their n-word runs."""

    def runs(col: Column) -> Column:
        w = F.transform(words(col), F.lower)
        count = F.greatest(F.size(w) - (n - 1), F.lit(0))
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.coalesce(F.arrays_overlap(runs(a), runs(b)), F.lit(False))


def lower_but_acronyms(col: Column) -> Column:
    """Each word in lower case unless it has two capital letters or more and no small one."""

    def case(w: Column) -> Column:
        letters = F.regexp_replace(w, "[^A-Za-z]", "")
        return F.when((F.length(letters) >= 2) & (letters == F.upper(letters)), w).otherwise(F.lower(w))

    return F.array_join(F.transform(F.split(stripped(col), r"\s+"), case), " ")


def tidy(col: Column) -> Column:
    """White space collapsed, outer punctuation off, no space before comma, semicolon and colon."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col, r"\s+", " "), r"^[ ,;:.-]+|[ ,;:.-]+$", ""), r"\s+([,;:])", "$1")


def evidence_flaw(col: Column) -> Column:
    """Why a text is no evidence: too short, a notice, or navigation; '' if it may be evidence."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit("([a-z]+)"), F.lit(1)))
    navigation = (F.size(found) > 0) & (F.size(F.array_except(found, F.array(*map(F.lit, NAVIGATION_WORDS)))) == 0)
    return F.when(F.size(words(col)) < 4, "short").when(col.rlike(NOTICES), "notice").when(navigation, "navigation").otherwise("")


def acceptable(col: Column, least: int = 6) -> Column:
    """Whether a sentence may describe a business: 6 to 42 words, no boilerplate, promotion, metric, address or order to the reader."""
    low = F.lower(col)
    parts = F.split(stripped(col), r"\s+")
    last = F.regexp_replace(F.lower(F.element_at(parts, -1)), "[^a-z]", "")
    bars, slashes = F.length(col) - F.length(F.translate(col, "|", "")), F.length(col) - F.length(F.translate(col, "/", ""))
    return (
        F.size(parts).between(least, 42)
        & ~low.rlike("|".join(BLOCKED_PHRASES))
        & ~col.rlike(METRICS)
        & (bars <= 1)
        & (slashes <= 3)
        & ~col.rlike(r"(?i)https?://|www\.|\S@\S")
        & ~low.rlike(ORDERS)
        & ~last.isin(*CUT_WORDS)
    )


def candidate_score(text: Column, kind: Column, path: Column) -> Column:
    """How well a sentence describes a business, by where it stands, what it says and how long it is; at most 0.96."""
    base = F.when(kind == "meta", 0.84).when(kind == "heading", 0.72).when(kind == "paragraph", 0.66).otherwise(0.56)
    n = F.size(F.split(stripped(text), r"\s+"))
    score = base + F.when(F.lower(path).rlike("about|service|solution"), 0.04).otherwise(0.0) + F.when(text.rlike("(?i)" + BUSINESS_VERBS), 0.08).otherwise(0.0) + F.when(n.between(8, 24), 0.04).otherwise(0.0)
    return F.least(F.lit(0.96), score)


def rendered(template: str, fields: dict[str, Column]) -> Column:
    """A template with ``{{ name }}`` fields filled from columns (NULL as ''); unknown fields are an error here and now."""
    import re

    parts = re.split(r"\{\{\s*([A-Za-z_]\w*)\s*\}\}", template)
    missing = sorted({n for n in parts[1::2] if n not in fields})
    if missing:
        raise KeyError("missing merge fields: " + ", ".join(missing))
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(fields[p].cast("string"), F.lit("")) for i, p in enumerate(parts)])
