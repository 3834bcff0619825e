"""Search queries: three dialects, parsed on the driver, as one Column over a row.

A (flat paths): words are substrings of the folded path; an item at the root counts as /name.
B (namespaces): words are substrings of the folded name, or of the folded path of the
  parent, or, if they have a slash, of both joined by a slash; a backslash means a slash.
C (literal): the whole query is a substring of the path, in its own case.
In A and B words are parted by Unicode blanks, all must match, and `ext:X` (the last one
counts) asks for the text after the last dot of the name. An empty query matches all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.names import extension

_BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
LIMITS = {"A": 512, "B": 4096}
LITERAL_UNITS = 512


@dataclass(frozen=True)
class Query:
    dialect: str
    tokens: tuple[str, ...]
    ext: str | None = None


def parse(raw: str, dialect: str = "B") -> Query:
    """The words and the extension of a query; ValueError if it is too long."""
    if dialect == "C":
        if len(raw.encode("utf-16-le", "surrogatepass")) // 2 > LITERAL_UNITS:
            raise ValueError("literal too long")
        return Query("C", (raw,) if raw else ())
    if len(raw.encode("utf-8", "surrogatepass")) > LIMITS[dialect]:
        raise ValueError("query too long")
    tokens, ext = [], None
    for word in filter(None, _BLANKS.split(raw)):
        if word.startswith("ext:"):
            ext = word[4:].lower()
        else:
            tokens.append((word.replace("\\", "/") if dialect == "B" else word).lower())
    return Query(dialect, tuple(tokens), ext)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def name_tests(query: Query, folded: Column) -> Column:
    """Whether the folded name alone satisfies all words."""
    return all_of([F.contains(folded, F.lit(t)) for t in query.tokens])


def entry_predicate(query: Query, folded: Column, parent: Column) -> Column:
    """Dialect B over a folded name and the folded path of its parent. Cheap tests first."""

    def word(t: str) -> Column:
        found = F.contains(folded, F.lit(t)) | F.contains(parent, F.lit(t))
        return found | F.contains(F.concat(parent, F.lit("/"), folded), F.lit(t)) if "/" in t else found

    return all_of([extension_is(query, folded), *map(word, query.tokens)])


def extension_is(query: Query, folded_name: Column) -> Column:
    return F.lit(True) if query.ext is None else F.coalesce(extension(folded_name) == query.ext, F.lit(False))


def path_predicate(query: Query, path: Column) -> Column:
    """Dialects A and C over a whole path."""
    if query.dialect == "C":
        return all_of([F.contains(path, F.lit(t)) for t in query.tokens])
    folded = F.lower(path)
    whole = F.when(F.contains(folded, F.lit("/")), folded).otherwise(F.concat(F.lit("/"), folded))
    base = F.substring_index(folded, "/", -1)
    return all_of([extension_is(query, base), *[F.contains(whole, F.lit(t)) for t in query.tokens]])


def raw_literal(raw: Column, needle: bytes) -> Column:
    """Dialect C over raw UTF-16 bytes: the needle at a whole unit, never across halves of two."""
    return F.hex(raw).rlike(f"^(?:[0-9A-F]{{4}})*?{needle.hex().upper()}") if needle else F.lit(True)


def unit_order(path: Column) -> Column:
    """Sorts as UTF-16 units do: characters beyond the basic plane come before U+E000."""
    return F.encode(path, "UTF-16BE")


def folded_bytes(raw: bytes) -> bytes:
    """A raw UTF-16LE name folded for matching: units that are no text become the byte 0xFF.

    No query contains that byte, so nothing matches a broken unit or across it.
    """
    text = raw.decode("utf-16-le", "surrogatepass")
    runs = re.split("[\ud800-\udfff]", text)
    return b"\xff".join(r.replace("\\", "/").lower().encode() for r in runs)


#: Hex of a UTF-16LE unit that is half of a pair without the other half, after what is text.
_BROKEN_UNIT = r"\G((?:..[^D].|..D[0-7]|..D[89AB]..D[C-F])*+)..D[89A-F]"


def raw_runs(raw: Column) -> Column:
    """The folded runs of text in a raw UTF-16LE name, parted by units that are no text; a whole name is one run."""
    runs = F.split(F.regexp_replace(F.hex(raw), _BROKEN_UNIT, "$1-"), "-")
    return F.transform(runs, lambda r: F.lower(F.translate(F.decode(F.unhex(r), "UTF-16LE"), "\\", "/")))


def whole_text(raw: Column) -> Column:
    """A raw name as text; null if it has a unit that is no text."""
    return F.when(~F.hex(raw).rlike(_BROKEN_UNIT), F.decode(raw, "UTF-16LE"))


def raw_predicate(query: Query, runs: Column) -> Column:
    """Dialect B over raw_runs() of a name: no word lies across a broken unit, and the extension must be text after the last dot."""

    def word(t: str) -> Column:
        return F.exists(runs, lambda run: F.contains(run, F.lit(t)))

    return all_of([extension_is(query, F.element_at(runs, -1)), *map(word, query.tokens)])
