"""Addresses in relation to other addresses, as column expressions (RFC 3986)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; what would climb above the root stays at the root."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    start = F.array().cast("array<string>")

    def step(kept: Column, s: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(s == ".", kept).when(s == "..", F.when(F.size(kept) > 1, up).otherwise(kept)).otherwise(F.concat(kept, F.array(s)))

    walked = F.aggregate(segments, start, step)
    closed = F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.array_join(closed, "/")).otherwise(path)


def resolved(base: Column, link: Column) -> Column:
    """The whole address that a link on the page at ``base`` leads to; of a link with a scheme only that is put in lower case."""
    of_its_own = F.concat(F.lower(F.regexp_extract(link, "^([^:]*)", 1)), F.regexp_extract(link, r"(?s)^[^:]*(:.*)$", 1))
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    own_path, rest = F.regexp_extract(link, "^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*([?#].*)$", 1)
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), of_its_own)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, _without_dots(own_path), rest))
        .when(own_path == "", F.concat(site, path, F.when(rest.startswith("?"), F.lit("")).otherwise(query), rest))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, own_path)), rest))
    )
