"""Rows of delimited files: load what conforms to its schema, explain what does not.

For each schema (delimiter plus ordered header) one anchored regular expression
describes a whole loadable row. A row that it accepts is loaded. A row that it
rejects passes through prefix patterns, each anchored at the start and one
requirement longer than the one before (RFC 4180 quoting, number of fields, then
the checked fields); the first that does not match names the failure.

Every pattern uses possessive repetition: they never backtrack, so cost is linear
in the row's length and long rows cannot overflow the matcher's stack.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import settled
from ..functions.missing import INVISIBLE, is_stand_in, visible

REASONS = ("quoting", "column_count", "email", "company_name")
#: Most schemas of one load: each becomes patterns of the plan.
MAX_SCHEMAS = 1_000
#: Most files whose schema numbers are broadcast.
SOME_FILES = 500_000

#: Java's white-space class for the e-mail pattern.
_WS = INVISIBLE
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9-]))*+"
_HOST = rf"{_LABEL}(?:\.{_LABEL})++"

#: A name that needs no closer look: starts with a letter that is no web prefix, has no
#: digit, control, undecodable or address character, and at least two words.
_PLAIN_NAME = r"(?!(?i:https?:|www\.))\p{L}[\p{L}\p{M}&.'’-]*+(?: [\p{L}\p{M}&.'’-]++)++"

#: Spreadsheet errors and truth values, lower case.
_NOT_NAMES = ("#ref!", "#value!", "#n/a", "#name?", "#div/0!", "#num!", "#null!", "#error!", "true", "false", "yes", "no")
_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


@dataclass(frozen=True)
class RowSchema:
    """Delimiter and ordered header names of a delimited file."""

    delimiter: str
    header: tuple[str, ...]

    @classmethod
    def of(cls, delimiter: str, header_line: str) -> RowSchema:
        names = tuple(h.strip().strip('"') for h in header_line.split(delimiter))
        return cls(delimiter, names)

    def position(self, name: str) -> int | None:
        wanted = name.casefold()
        return next((i for i, h in enumerate(self.header) if h.casefold() == wanted), None)

    @property
    def _d(self) -> str:
        return "".join(f"\\x{{{ord(c):x}}}" for c in self.delimiter)

    @property
    def field(self) -> str:
        """Any field of RFC 4180: quoted with doubled inner quotes, or bare."""
        return rf'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{self._d}\r\n]*+)'

    @property
    def email(self) -> str:
        """A field whose trimmed content is blank or a mail address."""
        space = rf"[{_WS}&&[^{self._d}\r\n]]*+"
        bare = rf'{space}(?:[^@{_WS}"{self._d}]++@{_HOST}{space})?+'
        quoted = rf'"[{_WS}]*+(?:(?:[^@{_WS}"]|"")++@{_HOST}[{_WS}]*+)?+"'
        return f"(?:{quoted}|{bare})"

    def prefix(self, fields: dict[int, str], upto: int) -> str:
        """Pattern of the first ``upto`` fields; ``fields`` overrides single positions."""
        return self._d.join(fields.get(i, self.field) for i in range(upto))

    def quoting_ok(self) -> str:
        return rf"\A{self.field}(?:{self._d}{self.field})*+\z"

    def count_ok(self) -> str:
        return rf"\A{self.field}(?:{self._d}{self.field}){{{len(self.header) - 1}}}+\z"

    def email_ok(self, name: str) -> str | None:
        i = self.position(name)
        return None if i is None else rf"\A{self.prefix({i: self.email}, i + 1)}(?:{self._d}|\z)"

    def whole_row(self, email: str, company: str) -> str:
        """The anchored pattern of a whole loadable row whose company is a plain name."""
        special: dict[int, str] = {}
        if (i := self.position(email)) is not None:
            special[i] = self.email
        if (i := self.position(company)) is not None:
            special[i] = rf'(?:"{_PLAIN_NAME}"|{_PLAIN_NAME})'
        return rf"\A{self.prefix(special, len(self.header))}\z"

    def each_field(self) -> str:
        """Pattern whose successive matches have the raw fields of a row with a delimiter put before it as group 1."""
        return rf"{self._d}({self.field})"

    def capture(self, position: int) -> str:
        """Pattern whose group 1 is the raw field at ``position``."""
        before = "".join(self.field + self._d for _ in range(position))
        return rf"\A{before}({self.field})(?:{self._d}|\z)"


def unquoted(raw: Column) -> Column:
    """A raw field's content: outer quotes removed, doubled quotes halved."""
    inner = F.regexp_replace(F.regexp_replace(raw, r'(?s)\A"(.*)"\z', "$1"), '""', '"')
    return F.when(raw.startswith('"'), inner).otherwise(raw)


def bad_company_name(value: Column) -> Column:
    """True unless the text is a name with letters (see RowParse for the cases)."""
    text = F.lower(visible(value))
    return (
        is_stand_in(value)
        | text.isin(*_NOT_NAMES)
        | ~value.rlike(r"\p{L}")
        | value.rlike(r"\x{FFFD}|[\p{Cc}&&[^\r\n]]")
        | text.rlike(r"\A#[a-z0-9/]+[!?]?\z")
        | text.rlike(r"\A[+-]?[\d.,' ]+(?:e[+-]?\d+|[%a-z€$£]{1,3})?\z")
        | text.rlike(rf"\A(?:\d{{1,2}}[. -]+(?:{_MONTHS})[a-z]*[. -]+\d{{2,4}}|(?:{_MONTHS})[a-z]*[. -]+\d{{1,2}}[, -]+\d{{2,4}}|\d{{4}}-\d\d?-\d\d?t[\d:.z+-]+)\z")
        | text.rlike(r"\A[^\s@]+@[^\s@]+\z")
        | text.rlike(r"\A(?:[a-z]+:)?//\S+\z|\Awww\.\S+\z|\A[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|org|net|example|io|de|fr|es|eu|uk|co)(?:[/?:]\S*)?\z")
    )


def schemas(files: DataFrame) -> tuple[dict[int, RowSchema], DataFrame]:
    """The numbered distinct schemas of a file list, and (file_id, schema number) of each file.

    Only distinct (delimiter, header) pairs come to the driver, where they become patterns of
    the plan; more than MAX_SCHEMAS are refused rather than cut. Files stay a table: up to
    SOME_FILES (two numbers each) are marked for broadcast, so that rows need no shuffle; more
    are joined by hash, with the same result.
    """
    spark = files.sparkSession
    usable = files.where("file_id IS NOT NULL AND delim_char <> '' AND header_line IS NOT NULL").select("file_id", "delim_char", "header_line")
    pairs = usable.select("delim_char", "header_line").distinct().limit(MAX_SCHEMAS + 1).collect()
    if len(pairs) > MAX_SCHEMAS:
        raise ValueError(f"more than {MAX_SCHEMAS} schemas: split the load by schema")
    pairs = sorted(map(tuple, pairs))
    found = {i: RowSchema.of(*pair) for i, pair in enumerate(pairs)}
    numbers = spark.createDataFrame([(*pair, i) for i, pair in enumerate(pairs)], "delim_char string, header_line string, _hw_schema int")
    own = usable.join(F.broadcast(numbers), ["delim_char", "header_line"]).groupBy("file_id").agg(F.min("_hw_schema").alias("_hw_schema"))
    return found, F.broadcast(own) if files.limit(SOME_FILES + 1).count() <= SOME_FILES else own


def per_schema(found: dict[int, RowSchema], value, otherwise: Column) -> Column:
    """One expression of the row's own schema; ``otherwise`` where ``value`` gives None or the schema is unknown."""
    out = otherwise
    for number, schema in found.items():
        if (own := value(schema)) is not None:
            out = F.when(F.col("_hw_schema") == number, own).otherwise(out)
    return out


def parse_rows(rows: DataFrame, files: DataFrame, line: str = "raw_line", email: str = "Email", company: str = "Company name") -> DataFrame:
    """Add ``parse_reason`` (NULL: loadable) and ``parse_fields`` (array of contents, in header order).

    A row's file must be in ``files`` (of a file listed twice the first schema counts); a row of
    an unknown file, and a NULL line, gets the reason ``column_count``. A schema without one of
    the checked columns skips that check; a blank e-mail is loadable. Other columns of ``rows``
    pass through, whatever their names. One narrow pass over the rows, which stay where they are.
    """
    found, own = schemas(files)
    return _parsed(rows, found, own, line, email, company).drop("_hw_schema")


def _parsed(rows: DataFrame, found: dict[int, RowSchema], own: DataFrame, line: str, email: str, company: str) -> DataFrame:
    raw = F.col(line)

    def name_of(schema: RowSchema) -> Column | None:
        i = schema.position(company)
        return None if i is None else unquoted(F.regexp_extract(raw, schema.capture(i), 1))

    def has_name(schema: RowSchema) -> Column | None:
        return None if schema.position(company) is None else F.lit(True)

    def email_ok(schema: RowSchema) -> Column | None:
        pattern = schema.email_ok(email)
        return None if pattern is None else raw.rlike(pattern)

    known, true, text = F.lit(False), F.lit(True), F.lit(None).cast("string")
    tests = {
        "_hw_whole": per_schema(found, lambda s: raw.rlike(s.whole_row(email, company)), known),
        "_hw_name": per_schema(found, name_of, text),
        "_hw_named": per_schema(found, has_name, known),
    }
    out = rows.join(own, "file_id", "left").withColumns(tests)
    bad_name = F.col("_hw_named") & bad_company_name(F.col("_hw_name"))
    broken = (
        F.when(~per_schema(found, lambda s: raw.rlike(s.quoting_ok()), true), "quoting")
        .when(~per_schema(found, lambda s: raw.rlike(s.count_ok()), known), "column_count")
        .when(~per_schema(found, email_ok, true), "email")
        .when(bad_name, "company_name")
    )
    reason = F.when(raw.isNull(), "column_count").when(F.col("_hw_whole") & ~bad_name, text).otherwise(broken)
    reason = settled(reason)  # a later filter on the verdict would else be pushed down with a copy of every pattern
    cells = per_schema(found, lambda s: F.regexp_extract_all(F.concat(F.lit(s.delimiter), raw), F.lit(s.each_field()), F.lit(1)), F.lit(None).cast("array<string>"))
    out = out.withColumn("parse_reason", reason).drop(*tests)
    return out.withColumn("parse_fields", F.when(F.col("parse_reason").isNull(), F.transform(cells, unquoted)))


def rejected_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(line_id, reason) of the records that cannot be loaded."""
    out = parse_rows(rows.select("line_id", "file_id", "raw_line"), files)
    return out.where("parse_reason IS NOT NULL").select("line_id", F.col("parse_reason").alias("reason"))


def loaded_rows(rows: DataFrame, files: DataFrame, names: list[str]) -> DataFrame:
    """The loadable records as columns: line_id, file_id and one string column per name.

    A name that a file's header lacks is NULL in that file's rows.
    """
    found, own = schemas(files)
    out = _parsed(rows.select("line_id", "file_id", "raw_line"), found, own, "raw_line", "Email", "Company name").where("parse_reason IS NULL")
    columns = []
    for name in names:
        value = per_schema(found, lambda s, name=name: None if (i := s.position(name)) is None else F.col("parse_fields")[i], F.lit(None).cast("string"))
        columns.append(value.alias(re.sub(r"\W+", "_", name).lower()))
    return out.select("line_id", "file_id", *columns)
