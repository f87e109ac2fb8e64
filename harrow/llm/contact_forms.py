"""Content of mail addresses and web addresses, apart from the form they are written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import INVISIBLE, is_stand_in

#: Punctuation that may stand around a value without being part of it.
_OUTER = r"\p{Pi}\p{Pf}'\"`<>(){}\[\],;:.!*|\\"
_WEB_OPENING = r"\A(?:https?:)?(?://)?(?:www\.)?"
#: A default port after the host, and what may close a place.
_WEB_CLOSING = r"(?<=\A[^/]{1,255}):(?:80|443)(?=/|\z)|[./]+\z"
_WEB_HOST = r"\A[^@/.\s]+(?:\.[^@/.\s]+)+(?:/.*)?\z"
_MAIL = r"\A[^@/]+@[^@/.]+(?:\.[^@/.]+)+\z"


def bare(col: Column) -> Column:
    """Lower case, without any white space (also invisible) and without outer punctuation."""
    tight = F.lower(F.regexp_replace(col, rf"[{INVISIBLE}]+", ""))
    return F.regexp_replace(tight, rf"\A[{_OUTER}]+|[{_OUTER}]+\z", "")


def mail_content(col: Column) -> Column:
    """The content of a mail address, NULL if the text is none."""
    text = F.regexp_replace(bare(col), r"\Amailto:", "")
    return F.when(text.rlike(_MAIL), text)


def web_content(col: Column) -> Column:
    """The content of a web address (host, path, sorted parameters), NULL if it has no host.

    Scheme, ``www.``, a default port, a closing slash and the order of parameters are form.
    """
    text = F.regexp_replace(bare(col), _WEB_OPENING, "")
    place = F.regexp_replace(F.regexp_extract(text, r"\A([^?]*)", 1), _WEB_CLOSING, "")
    query = F.regexp_extract(text, r"\?(.*)\z", 1)
    sorted_query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    whole = F.when(query == "", place).otherwise(F.concat(place, F.lit("?"), F.when(query.contains("&"), sorted_query).otherwise(query)))
    return F.when(place.rlike(_WEB_HOST), whole)


def with_contact(df: DataFrame, email: str = "email", website: str = "website", mail: str = "_hw_mail", web: str = "_hw_web") -> DataFrame:
    """Add what is a mail address and what is a web address in the two fields, even exchanged.

    Blank values and stand-ins give NULL. A field counts for what it is: a web address in the
    e-mail field is the web address unless the website field has one, and the other way round.
    The contents are those of mail_content and web_content, worked out step by step so that no
    pattern runs twice on a row.
    """
    first, second = F.col("_hw_1"), F.col("_hw_2")
    df = df.withColumns({"_hw_1": bare(F.col(email)), "_hw_2": bare(F.col(website))})
    as_mail = F.when(first.rlike(_MAIL), first).when(second.contains("@"), F.when(second.rlike(_MAIL), second))
    # The web address: the website field unless that holds the mail address (or nothing) and the e-mail field holds none.
    as_web = F.when(second.isNotNull() & (second != "") & ~second.rlike(_MAIL), second).otherwise(F.when(~first.contains("@"), first))
    df = df.withColumns({mail: F.regexp_replace(as_mail, r"\Amailto:", ""), "_hw_w": F.regexp_replace(as_web, _WEB_OPENING, "")}).drop("_hw_1", "_hw_2")
    asked = F.instr("_hw_w", "?")
    df = df.withColumn("_hw_q", asked).withColumns(
        {
            "_hw_place": F.regexp_replace(F.when(F.col("_hw_q") > 0, F.substring(F.col("_hw_w"), F.lit(1), F.col("_hw_q") - 1)).otherwise(F.col("_hw_w")), _WEB_CLOSING, ""),
            "_hw_query": F.when(F.col("_hw_q") > 0, F.substring(F.col("_hw_w"), F.col("_hw_q") + 1, F.length("_hw_w"))).otherwise(F.lit("")),
        }
    )
    query = F.when(F.col("_hw_query").contains("&"), F.array_join(F.array_sort(F.split("_hw_query", "&")), "&")).otherwise(F.col("_hw_query"))
    whole = F.when(F.col("_hw_query") == "", F.col("_hw_place")).otherwise(F.concat(F.col("_hw_place"), F.lit("?"), query))
    return df.withColumn(web, F.when(F.col("_hw_place").rlike(_WEB_HOST), whole)).drop("_hw_w", "_hw_q", "_hw_place", "_hw_query")


def cut_off(col: Column) -> Column:
    """True for text that ends in dots which mark an omission."""
    return F.coalesce(col.rlike(rf"(?:\.{{3,}}|…)[{INVISIBLE}]*\z"), F.lit(False))


def real_text(col: Column) -> Column:
    """True for text that is no blank, stand-in, keyboard junk or cut-off value.

    Keyboard junk: runs along the rows of a keyboard, words typed to try a field, one character
    repeated, or fewer than two letters.
    """
    tight = F.lower(F.regexp_replace(col, rf"[{INVISIBLE}]+", ""))
    junk = (
        tight.rlike(r"\A(?:asdf|sdfg|dfgh|qwert|werty|wertz|zxcv|xcvb|yxcv|hjkl|jkl|uiop)+[a-zö]{0,4}\z")
        | tight.rlike(r"\A(?:test|abc|xyz|foo|bar|dummy|sample|blah?|lorem)+\d*\z")
        | tight.rlike(r"\A(.)\1*\z")
        | ~tight.rlike(r"\p{L}.*\p{L}")
    )
    return F.coalesce(~(is_stand_in(col) | junk | cut_off(col)), F.lit(False))
