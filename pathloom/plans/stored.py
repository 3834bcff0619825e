"""Search state that is stored, so that no search derives it again: segments under one manifest.

SearchState keeps, for one version of a namespace, its entries with their parents' paths and the bits of
their trigrams, its directories with their paths, and trigram postings. All tables of a state are named by
one manifest, which comes into being by one rename: a refresh that fails anywhere before leaves the state
that was there, and searches go on from it.

A refresh writes a segment: the rows that are new or have a new path, the keys of older rows that they
replace or that went, new places of directories, and postings of the new rows. It compares only the shards
of the namespace's store that are in other folders than before. So what is written follows the change;
rows below a moved directory count as changed, for their paths do. Rows of a segment that a later one's
keys name are dead. Segments of like size are merged, so there are few, and each row is rewritten a
logarithmic number of times.

Rows of a segment are numbered in the order of their slots, blocks are 64 of them, and zones are stretches
of blocks in files of their own, with the slots they hold: a page scans zones in the order of slots and
stops at the first match beyond its limit.

IndexState is the same for flat rows (id, path), written whole.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.names import ordinary_directory
from pathloom.functions.query import parse
from pathloom.operators import index, namespace, ranks
from pathloom.operators.grams import bits as row_bits
from pathloom.operators.grams import bits_of, postings
from pathloom.operators.inventory import net
from pathloom.plans import search
from pathloom.session import held, ship, written
from pathloom.streaming.store import ORPHAN_AGE, Files, Manifest, NotReady, Store

FORMAT = 2
ENTRY = ["source", "object", "parent", "name", "attributes", "slot"]
CHILD = ["source", "parent", "name"]
SCHEMAS = {
    "located": "source string, object long, parent long, name string, attributes int, slot long, parent_path string, parent_depth int, row long, low long, high long, zone int",
    "dirs": "source string, object long, path string, depth int",
    "gone": "source string, parent long, name string",
    "lost": "source string, object long",
    "postings": "gram string, zone int, blocks array<bigint>",
}
#: A zone has at least so many rows, and a segment at most so many zones.
ZONE, ZONES = 1 << 14, 4096
#: A segment is merged into the one before it if that has at most RATIO times its rows, or if there are more than SEGMENTS.
RATIO, SEGMENTS = 4, 6
NO_SLOT = -(1 << 63)


@dataclass(frozen=True)
class Segment:
    number: int
    folder: str
    first_row: int
    rows: int
    zone_rows: int
    #: Tables that have rows.
    tables: tuple[str, ...]


@dataclass(frozen=True)
class Snapshot:
    """A state: the segments, oldest first, and what they were made from."""

    number: int
    version: int
    segments: tuple[Segment, ...]
    next_row: int
    #: Folders of the namespace's parts by shard, if it came from a store.
    parts: dict[str, str] | None = None
    format: int = FORMAT


def _folders(m: Manifest) -> dict[str, str]:
    return {k: folder for k, (folder, _, _) in m.parts.items()}


def searched(parent: Column, name: Column) -> Column:
    """The folded text whose trigrams hold those of every word that matches."""
    return F.concat(F.coalesce(F.lower(parent), F.lit("")), F.lit("/"), F.lower(F.translate(name, "\\", "/")))


def grams_of(raw: str) -> list[str]:
    return sorted({t[i : i + 3] for t in parse(raw, "B").tokens for i in range(len(t) - 2)})


class View:
    """One state, to read and to search; hold it with SearchState.view() while frames of it are in use."""

    def __init__(self, state: SearchState, snapshot: Snapshot):
        self.spark, self.path, self.snapshot, self.files = state.spark, state.path, snapshot, state

    def _rows(self, table: str, wanted: Callable[[Segment], Column | None] | None = None, segments: tuple[Segment, ...] | None = None) -> DataFrame:
        """The rows of a table in all segments, dead ones too, with the segment's number; wanted narrows each segment, or leaves it out (None)."""
        out = None
        for s in self.snapshot.segments if segments is None else segments:
            condition = F.lit(True) if wanted is None else wanted(s)
            if table in s.tables and condition is not None:
                rows = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{s.folder}/{table}").where(condition).withColumn("segment", F.lit(s.number))
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], f"{SCHEMAS[table]}, segment int") if out is None else out

    def _live(self, table: str, keys: str, wanted=None, segments: tuple[Segment, ...] | None = None) -> DataFrame:
        rows, on = self._rows(table, wanted, segments), [c.split()[0] for c in SCHEMAS[keys].split(", ")]
        if not any(keys in s.tables for s in (self.snapshot.segments if segments is None else segments)):
            return rows
        dead = self._rows(keys, None, segments).groupBy(*[F.col(c).alias(f"_{c}") for c in on]).agg(F.max("segment").alias("_upto"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
        joined = rows.join(dead, same, "left")  # few keys: broadcast if their files are small
        return joined.where(F.col("_upto").isNull() | (F.col("segment") >= F.col("_upto"))).select(*rows.columns)

    def located(self, wanted=None, segments: tuple[Segment, ...] | None = None) -> DataFrame:
        """The live entries with their parents' paths; wanted narrows segments by zone."""
        return self._live("located", "gone", wanted, segments)

    def directories(self, segments: tuple[Segment, ...] | None = None) -> DataFrame:
        return self._live("dirs", "lost", None, segments)

    def entries(self) -> DataFrame:
        return self.located().select(*ENTRY)

    def _signed(self, raw: str, rows: DataFrame) -> DataFrame:
        """Without rows that lack a bit of the words' trigrams, which are stored with the rows."""
        grams = grams_of(raw)
        if not grams:
            return rows
        low, high = (F.lit(b).cast("long") for b in bits_of(grams))
        return rows.where((F.col("low").bitwiseAND(low) == low) & (F.col("high").bitwiseAND(high) == high))

    def matches(self, raw: str, kind: str = "all", indexed: bool = False) -> DataFrame:
        """Every entry that a dialect B query matches; indexed reads only zones with blocks that have all trigrams of the words."""
        wanted, rows = None, None
        if indexed and (grams := grams_of(raw)):
            postings = self._rows("postings").where(F.col("gram").isin(grams)).select("segment", "zone", "gram", F.explode("blocks").alias("block"))
            blocks = postings.groupBy("segment", "zone", "block").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
            blocks = written(blocks.select("segment", "zone", "block"), "blocks")
            zones: dict[int, list[int]] = {}
            for r in blocks.select("segment", "zone").distinct().collect():  # at most ZONES of a segment
                zones.setdefault(r.segment, []).append(r.zone)
            wanted = lambda s: F.col("zone").isin(zones[s.number]) if s.number in zones else None
            rows = self.located(wanted).withColumn("block", index.block_of(F.col("row"))).join(blocks.select("block"), "block", "left_semi")
        rows = self.located(wanted) if rows is None else rows
        return search.matches(self._signed(raw, rows), raw, kind)

    def zones(self) -> list[tuple[int, int, int]]:
        """(first slot, segment, zone) of all zones, by slot; at most ZONES of each segment."""
        return sorted((first, s.number, zone) for s in self.snapshot.segments for zone, first in self.files.zones(s))

    def page(self, raw: str, limit: int = 20, kind: str = "all", valid: Column | None = None) -> search.Page:
        """search.page() from as few zones as it needs: first one, then four times as many, in the order of slots."""
        if not 0 <= limit <= 1024:
            raise ValueError("limit")
        zones, at, step, kept, skipped = self.zones(), 0, 1, [], 0
        fine = F.lit(True) if valid is None else valid
        while at < len(zones):
            upto = min(len(zones), at + step)
            ranges: dict[int, tuple[int, int]] = {}
            for _, segment, zone in zones[at:upto]:  # a segment's zones ascend with their slots
                low, high = ranges.get(segment, (zone, zone))
                ranges[segment] = min(low, zone), max(high, zone)
            wanted = lambda s, ranges=ranges: F.col("zone").between(*ranges[s.number]) if s.number in ranges else None
            found = search.matches(self._signed(raw, self.located(wanted)), raw, kind)
            kept += found.where(fine).orderBy("slot").limit(limit + 1).collect()
            at, step = upto, step * 4
            kept.sort(key=lambda r: NO_SLOT if r.slot is None else r.slot)
            safe = [r for r in kept if at == len(zones) or (NO_SLOT if r.slot is None else r.slot) < zones[at][0]]
            if len(safe) > limit:
                break
        else:
            safe = kept
        rows, whole = safe[:limit], len(safe) <= limit
        if valid is not None:
            last = None if whole else F.coalesce("slot", F.lit(NO_SLOT)) <= (NO_SLOT if not rows or rows[-1].slot is None else rows[-1].slot)
            read = {(s, z) for _, s, z in zones[:at]}
            most = {s: max(z for t, z in read if t == s) for s, _ in read}
            found = search.matches(self.located(lambda s: F.col("zone") <= most[s.number] if s.number in most else None), raw, kind)
            skipped = found.where(~fine if whole else ~fine & (F.lit(limit > 0) & last)).count()
        made = self.spark.createDataFrame(rows, search.PAGE_SCHEMA)
        if valid is None:
            return search.Page(made, len(rows) if whole else limit + 1, whole, 0, (at, len(zones)))
        return search.Page(made, len(rows) + skipped + (not whole), whole, skipped, (at, len(zones)))


class SearchState(Files):
    """The search state of a namespace, below a folder."""

    def __init__(self, spark: SparkSession, path: str, zone: int = ZONE, orphan_age: float = ORPHAN_AGE):
        super().__init__(spark, path)
        self.zone, self.orphan_age = zone, orphan_age

    # states

    def snapshot(self) -> Snapshot | None:
        known = self._numbers("states")
        if not known:
            return None
        found = json.loads(self._text(f"states/{known[-1]:012d}.json"))
        if found.get("format") != FORMAT:
            return None
        return Snapshot(**found | {"segments": tuple(Segment(**s | {"tables": tuple(s["tables"])}) for s in found["segments"])})

    def version(self) -> int:
        """The version of the namespace that the state was made from; 0 if there is none."""
        s = self.snapshot()
        return s.version if s else 0

    def view(self) -> View:
        """The newest state. It stays readable until two later ones were made and its folders are older than orphan_age."""
        s = self.snapshot()
        if s is None:
            raise NotReady("no search state")
        return View(self, s)

    def directories_of(self, m: Manifest) -> DataFrame | None:
        """The directories of a store's version, if the state was made from these rows."""
        s = self.snapshot()
        if s is None or s.parts != _folders(m):
            return None
        return View(self, s).directories().select("source", "object", "path", "depth")

    def apply(self, prepared: Snapshot) -> None:
        """Makes a prepared state the newest one: one rename, which fails only if another writer was first."""
        self._put(f"states/{prepared.number:012d}.json", json.dumps(asdict(prepared)))
        self._clean()

    def _clean(self) -> None:
        known = self._numbers("states")
        for n in known[:-2]:
            self._fs.delete(self._at(f"states/{n:012d}.json"), False)
        live = {s["folder"] for n in known[-2:] for s in json.loads(self._text(f"states/{n:012d}.json"))["segments"]}
        self._sweep("s=", live, self.orphan_age)

    # writing

    def _write(self, number: int, first_row: int, located: DataFrame, tables: dict[str, DataFrame]) -> Segment:
        """Writes a segment's tables to a folder of its own; located are ENTRY columns with parent_path and parent_depth."""
        folder = f"s={number}-{uuid.uuid4().hex}"
        first_row = -(-first_row // index.BLOCK) * index.BLOCK
        placed = ranks.numbered(written(located, "located"), [F.coalesce("slot", F.lit(NO_SLOT)), F.col("object"), F.col("name")], "row")
        rows = placed.count()
        zone_rows = -(-max(self.zone, math.ceil(rows / ZONES)) // index.BLOCK) * index.BLOCK
        ship(self.spark)
        text = searched(F.col("parent_path"), F.col("name"))
        bits = F.arrow_udf(row_bits, "low long, high long")(text)
        named, zones = [], []
        if rows:
            whole = placed.withColumns({"zone": F.floor(F.col("row") / zone_rows).cast("int"), "row": F.col("row") + first_row, "bits": bits})
            whole = whole.withColumns({"low": F.col("bits.low"), "high": F.col("bits.high")}).drop("bits")
            self._table(folder, "located", whole.repartition("zone").sortWithinPartitions("zone", "row"), "zone")
            read = self.spark.read.schema(SCHEMAS["located"]).parquet(f"{self.path}/{folder}/located")
            grams = read.select("zone", index.block_of(F.col("row")).alias("block"), text.alias("text")).mapInArrow(postings, SCHEMAS["postings"])
            self._table(folder, "postings", grams.repartition("gram").sortWithinPartitions("gram"))
            zones = read.groupBy("zone").agg(F.min(F.coalesce("slot", F.lit(NO_SLOT))).alias("slot")).collect()  # at most ZONES
            named = ["located", "postings"]
        self._put(f"{folder}/zones.json", json.dumps(sorted((r.zone, r.slot) for r in zones)))
        for table, frame in tables.items():
            self._table(folder, table, frame)
            if self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{folder}/{table}").head(1):
                named.append(table)
        return Segment(number, folder, first_row, rows, zone_rows, tuple(named))

    def zones(self, segment: Segment) -> list[tuple[int, int]]:
        """(zone, its first slot) of a segment."""
        return [tuple(z) for z in json.loads(self._text(f"{segment.folder}/zones.json"))]

    def _table(self, folder: str, table: str, frame: DataFrame, by: str | None = None) -> None:
        columns = [f"cast(`{c}` as {kind}) as `{c}`" for c, kind in (x.split() for x in SCHEMAS[table].split(", "))]
        out = frame.selectExpr(*columns).write
        (out.partitionBy(by) if by else out).parquet(f"{self.path}/{folder}/{table}")

    def save(self, entries: DataFrame, version: int, parts: dict[str, str] | None = None) -> None:
        """Stores everything for a version of a namespace, as one segment."""
        before = self.snapshot()
        number = before.number + 1 if before else 1
        dirs = written(namespace.directories(entries), "dirs")
        segment = self._write(number, 0, namespace.with_parent(entries.select(*ENTRY), held(dirs), "left"), {"dirs": dirs})
        self.apply(Snapshot(number, version, (segment,), segment.first_row + segment.rows, parts))

    def prepare(self, entries: DataFrame, version: int, parts: dict[str, str] | None = None, old: DataFrame | None = None) -> Snapshot | None:
        """The state for a later version, written but not yet in force; None if nothing changed.

        entries and old are the namespace's rows now and as the state has them, or only those that may
        differ; old None: as the state has them.
        """
        view = self.view()
        before = view.snapshot
        old = view.entries() if old is None else old.select(*ENTRY)
        changed = written(net(entries.select(*ENTRY), old), "changed-entries")
        if not changed.head(1):
            return None
        came = changed.where("n > 0").withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select(*ENTRY)
        gone = changed.where("n < 0").select(*CHILD).distinct()
        directory = ordinary_directory(F.col("attributes"))
        known, tables = view.directories().select("source", "object", "path", "depth"), {}
        form = ["source", "object", "parent", "name"]
        turned = written(changed.where(directory).groupBy(*form).agg(F.sum("n").alias("n")).where("n <> 0"), "turned")
        if turned.head(1):
            fresh, stale = namespace.moved_directories(known, turned.where("n < 0"), turned.where("n > 0"))
            fresh, stale = written(fresh, "fresh"), written(stale, "stale")
            parents = stale.select("source", F.col("object").alias("parent"))
            below = view.located().join(parents, ["source", "parent"], "left_semi")
            again = written(below.join(gone, [below[c].eqNullSafe(gone[c]) for c in CHILD], "left_anti").select(*ENTRY), "again")
            came, gone = came.unionByName(again), gone.unionByName(again.select(*CHILD)).distinct()
            known = known.join(stale, ["source", "object"], "left_anti").unionByName(fresh)
            tables = {"dirs": fresh, "lost": stale}
        number = before.number + 1
        segment = self._write(number, before.next_row, namespace.with_parent(came, known, "left"), {"gone": gone} | tables)
        return Snapshot(number, version, (*before.segments, segment), segment.first_row + segment.rows, parts)

    def refresh(self, entries: DataFrame, version: int) -> bool:
        """Brings the state to a later version of the namespace; False, and nothing is written, if no row changed."""
        prepared = self.prepare(entries, version)
        if prepared is not None:
            self.apply(prepared)
            self.merge()
        return prepared is not None

    def follow(self, store: Store) -> bool:
        """Brings the state to the newest version of a store, from the shards that differ; whole the first time."""
        m, s = store.manifest(), self.snapshot()
        if m is None:
            raise NotReady("no version")
        parts = _folders(m)
        if s is None:
            self.save(store.rows(m), m.version, parts)
            return True
        if s.parts == parts:
            return False
        was = s.parts or {}
        mine, now = ([f for k, f in x.items() if y.get(k) != f] for x, y in ((was, parts), (parts, was)))
        if s.parts is not None and store.there(mine):
            prepared = self.prepare(store.parts(m, now), m.version, parts, store.parts(m, mine))
        else:  # the store has removed what the state was made from
            prepared = self.prepare(store.rows(m), m.version, parts)
        self.apply(prepared or replace(s, number=s.number + 1, version=m.version, parts=parts))
        self.merge()
        return prepared is not None

    def merge(self) -> bool:
        """Merges the newest segments of like size into one, with a state of its own; False if there is nothing to merge."""
        view = self.view()
        s = view.snapshot
        at = len(s.segments) - 1
        while at > 0 and (s.segments[at - 1].rows <= RATIO * max(1, sum(x.rows for x in s.segments[at:])) or at + 1 > SEGMENTS):
            at -= 1
        if at == len(s.segments) - 1:
            return False
        some = s.segments[at:]
        tables = {"dirs": view.directories(some).select("source", "object", "path", "depth")}
        if at:  # what lies before them still needs their keys
            tables |= {t: view._rows(t, None, some).drop("segment").distinct() for t in ("gone", "lost")}
        rows = view.located(None, some).select(*ENTRY, "parent_path", "parent_depth")
        merged = self._write(some[-1].number, s.next_row, rows, tables)
        self.apply(replace(s, number=s.number + 1, segments=(*s.segments[:at], merged), next_row=merged.first_row + merged.rows))
        return True

    # searching

    def page(self, raw: str, limit: int = 20, kind: str = "all", valid: Column | None = None) -> search.Page:
        return self.view().page(raw, limit, kind, valid)

    def matches(self, raw: str, kind: str = "all", indexed: bool = False) -> DataFrame:
        return self.view().matches(raw, kind, indexed)


class IndexState:
    """Rows (id, path) with their postings and signatures, each a table of one store's version."""

    TABLES = ("rows", "postings", "signatures")

    def __init__(self, spark: SparkSession, path: str):
        self.stores = {t: Store(spark, f"{path.rstrip('/')}/{t}") for t in self.TABLES}

    def version(self) -> int:
        """The version that the last of the tables has; 0 if there is none."""
        m = self.stores[self.TABLES[-1]].manifest()
        return m.cursor if m else 0

    def save(self, rows: DataFrame, version: int) -> None:
        """Stores rows with their index."""
        made = {"rows": rows.select("id", "path"), "postings": index.postings(rows), "signatures": index.signatures(rows)}
        for t in self.TABLES:
            self.stores[t].publish(made[t], self.stores[t].ticket(), "", "", version)

    def read(self, table: str) -> DataFrame:
        if len({(m.cursor if (m := s.manifest()) else 0) for s in self.stores.values()}) != 1 or not self.version():
            raise NotReady("the stored tables are not of one version")
        return self.stores[table].read()

    def search(self, raw: str) -> DataFrame:
        return index.indexed_search(self.read("rows"), self.read("postings"), self.read("signatures"), raw)
