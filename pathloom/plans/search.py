"""Whole searches: pages with totals over one source, merged over several, pages of a snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.names import of_category, path_key, shard_of
from pathloom.functions.query import Query, entry_predicate, extension_is, name_tests, parse, path_predicate, raw_literal, raw_predicate, raw_runs, unit_order, whole_text
from pathloom.operators.namespace import directories, full_path, is_directory, with_parent
from pathloom.session import held

PAGE = ["source", "slot", "object", "path", "name", "is_directory"]
PAGE_SCHEMA = "source string, slot long, object long, path string, name string, is_directory boolean"


@dataclass(frozen=True)
class Page:
    """rows (PAGE columns), and the total with whether it is exact or a lower bound."""

    rows: DataFrame
    total: int
    exact: bool
    skipped: int
    #: (zones read, all zones) of a stored search state.
    zones: tuple[int, int] = (0, 0)


def matches(entries: DataFrame, raw: str, kind: str = "all", dirs: DataFrame | None = None) -> DataFrame:
    """Every entry that a dialect B query matches, with its path.

    entries that are located (plans.stored) hold their parents' paths, and the search is one scan. Else
    kind, category and extension, which need no path, are tested below the join with directories.
    A match whose parent the root doesn't reach fails the search instead of being left out.
    """
    query = parse(raw, "B")
    folded = F.lower(F.translate("name", "\\", "/"))
    some = entries.where(of_category(kind, F.col("attributes"), folded) & extension_is(query, folded))
    joined = some if "parent_path" in entries.columns else with_parent(some, held(directories(entries) if dirs is None else dirs), "left")
    words = Query("B", query.tokens)
    lost = F.coalesce("parent_path", F.raise_error(F.lit("an entry's parent can't be resolved")).cast("string"))
    found = joined.where(name_tests(words, folded) | entry_predicate(words, folded, F.lower(lost)))
    return (
        found.withColumn("path", F.coalesce(full_path(), F.raise_error(F.lit("an entry's parent can't be resolved")).cast("string")))
        .withColumn("is_directory", is_directory(F.col("attributes")))
        .select(*PAGE)
    )


def page(entries: DataFrame, raw: str, limit: int = 20, kind: str = "all", dirs: DataFrame | None = None, valid=None) -> Page:
    """The first `limit` matches of one source in slot order.

    The search stops at the first match beyond the limit: the total is then a lower bound,
    that match included. Matches with an invalid name (valid: a Column) count in the total
    and in skipped, but take no place on the page.
    """
    if not 0 <= limit <= 1024:
        raise ValueError("limit")
    found = matches(entries, raw, kind, dirs)
    usable = found if valid is None else found.where(valid)
    first = usable.orderBy("slot").limit(limit + 1).collect()  # at most 1025 rows; a page leaves no table
    rows = entries.sparkSession.createDataFrame(first[:limit], PAGE_SCHEMA)
    if valid is None:
        return Page(rows, len(first), len(first) <= limit, 0)
    if len(first) <= limit:  # all usable matches are here; the rest are skipped
        skipped = found.where(~valid).count()
        return Page(rows, len(first) + skipped, True, skipped)
    skipped = found.where(~valid & (F.col("slot") <= first[limit - 1].slot)).count() if limit else 0
    return Page(rows, limit + skipped + 1, False, skipped)


def merged(pages: list[Page], limit: int) -> Page:
    """Pages of several sources as one: by lower-case path, then source and slot."""
    rows = pages[0].rows
    for p in pages[1:]:
        rows = rows.unionByName(p.rows)
    rows = rows.orderBy(F.lower("path"), "source", "slot").limit(limit)
    return Page(rows, sum(p.total for p in pages), all(p.exact for p in pages), sum(p.skipped for p in pages))


def path_matches(rows: DataFrame, raw: str, dialect: str = "A") -> DataFrame:
    """rows (id, path) that a query over whole paths matches."""
    return rows.where(path_predicate(parse(raw, dialect), F.col("path")))


def first_in_order(rows: DataFrame, raw: str, limit: int = 50, dialect: str = "A") -> DataFrame:
    """The first matches in path order, component by component: a top-k in each task, then of those."""
    return path_matches(rows, raw, dialect).orderBy(path_key(F.col("path"))).limit(limit)


def export(rows: DataFrame, raw: str, path: str, nul: bool = False, dialect: str = "A") -> None:
    """Writes all matching paths as text files, one a line or each ended by NUL; no limit."""
    found = path_matches(rows, raw, dialect).select("path")
    if not nul:
        found = found.select(F.replace(F.replace("path", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")).alias("path"))
    found.write.option("lineSep", "\0" if nul else "\n").text(path)


def summary(rows: DataFrame, raw: str, limit: int | None = None, dialect: str = "A") -> DataFrame:
    """(matches, checksum, complete): the number of matches and the sum of id + 1; with a limit, of the first by id."""
    found = path_matches(rows, raw, dialect)
    if limit is not None:
        found = found.orderBy("id").limit(limit)
    complete = F.lit(True) if limit is None else F.count("*") < limit
    return found.agg(F.count("*").alias("matches"), F.coalesce(F.sum(F.col("id") + 1), F.lit(0)).alias("checksum"), complete.alias("complete"))


def raw_matches(entries: DataFrame, raw: str) -> DataFrame:
    """entries (.., name_raw) whose raw names match a dialect B query; name is null if the raw name is no text.

    Such rows count as matches and as skipped, but can't be shown.
    """
    found = entries.where(raw_predicate(parse(raw, "B"), raw_runs(F.col("name_raw"))))
    return found.withColumn("name", whole_text(F.col("name_raw")))


def literal_first(rows: DataFrame, raw: str, limit: int = 50) -> DataFrame:
    """(id, path, total): the first matches of a dialect C query over raw UTF-16 names, by code units, and how many there are."""
    parse(raw, "C")
    found = rows.where(raw_literal(F.encode("path", "UTF-16LE"), raw.encode("utf-16-le"))).select("id", "path")
    total = found.agg(F.count("*").alias("total"))
    first = found.orderBy(unit_order(F.col("path")), "id").limit(limit)
    return first.join(F.broadcast(total), F.lit(True)).select("id", "path", "total")  # the total is one row


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: the version and the query that it belongs to, and the key of its last row."""

    version: int
    query: str
    dialect: str
    shard: int
    path: str
    id: int


def next_page(rows: DataFrame, raw: str, after: Cursor | None, size: int, shards: int = 64, dialect: str = "A", version: int = 0) -> DataFrame:
    """(shard, path, id) of the page after a cursor, in the order of these three; ids tell equal paths apart.

    rows must be those of `version`; a cursor of another version or query is refused. The cursor is a
    key, so a page costs the same however far it is.
    """
    if not 1 <= size <= 1024:
        raise ValueError("page size")
    found = path_matches(rows, raw, dialect).withColumn("shard", shard_of(F.col("path"), shards))
    if after is not None:
        if (after.version, after.query, after.dialect) != (version, raw, dialect):
            raise ValueError("the cursor belongs to another version or query")
        at = F.struct(F.lit(after.shard).alias("shard"), F.lit(after.path).alias("path"), F.lit(after.id).cast("long").alias("id"))
        found = found.where((F.col("shard") >= after.shard) & (F.struct("shard", "path", F.col("id").cast("long").alias("id")) > at))
    return found.orderBy("shard", "path", "id").limit(size).select("shard", "path", "id")


def cursor_of(page: DataFrame, raw: str, dialect: str = "A", version: int = 0) -> Cursor | None:
    """The cursor after a page of next_page(); None after an empty one."""
    last = page.orderBy(F.desc("shard"), F.desc("path"), F.desc("id")).first()
    return None if last is None else Cursor(version, raw, dialect, last.shard, last.path, last.id)
