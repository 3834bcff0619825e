"""Bringing a store to its journal's end: windows are replayed until the end stays put, and only then is anything published.

A namespace listed while a journal goes on must not be published with an earlier cursor. So each
attempt works on a candidate that nobody sees: it reads the window up to the journal's end, applies
it with the listing as it is now, and asks for the end again. What the candidate replaced is kept as
an undo segment: for each parent the children it had when the attempt first touched it. An attempt
that fails leaves the store as it was; the segment of one that succeeds takes its version back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.names import ROOT, retained
from pathloom.operators import journal
from pathloom.session import written
from pathloom.streaming.maintain import KEY
from pathloom.streaming.store import Manifest, NotReady, Store, shard


@dataclass
class Replayed:
    """What a replay did."""

    cursor: int
    windows: int = 0
    records: int = 0
    widened: int = 0
    attempts: int = 1
    undo_entries: int = 0
    #: The folder of the undo segment; None if no row changed.
    undo: str | None = None
    reasons: list[str] = field(default_factory=list)


class Replay:
    """A store, the listing as it is now, the records of [first, next) and what the journal holds: (journal id, first, lowest, next).

    budget: bytes of the records of one attempt; None: any number. most_windows: a journal that is never quiet for so
    long ends the attempt with ReconcileError. attempts: how often a failed attempt is begun anew.
    """

    def __init__(
        self, store: Store, listing: Callable[[], DataFrame], records: Callable[[int, int], DataFrame], holds: Callable[[], tuple[str, int, int, int]],
        root: int = ROOT, budget: int | None = None, most_windows: int = 64, attempts: int = 3,
        known: Callable[[Manifest], DataFrame | None] = lambda m: None,
    ):
        self.store, self.listing, self.records, self.holds, self.root, self.known = store, listing, records, holds, root, known
        self.budget, self.most_windows, self.attempts = budget, most_windows, attempts

    def _end(self, m: Manifest, cursor: int) -> int:
        """Where the journal ends; ReconcileError if it no longer holds the cursor or is another one."""
        journal_id, first, lowest, following = self.holds()
        row = self.store.spark.range(1).select(F.lit(journal_id).alias("j"), F.lit(m.journal).alias("c"))
        if not row.select(retained("j", F.lit(first), F.lit(lowest), F.lit(following), "c", F.lit(cursor))).first()[0]:
            raise journal.ReconcileError("the journal does not hold the cursor")
        return following

    def sync(self) -> Replayed:
        """Publishes the namespace at the journal's end, or raises what the last attempt failed with and leaves the store as it was."""
        reasons: list[str] = []
        for attempt in range(1, self.attempts + 1):
            try:
                done = self._attempt()
                done.attempts, done.reasons = attempt, reasons
                return done
            except (journal.ReconcileError, NotReady) as e:
                reasons.append(str(e))
                if attempt == self.attempts or "does not hold" in str(e):
                    raise
        raise ValueError("attempts")

    def _attempt(self) -> Replayed:
        m = self.store.manifest()
        if m is None:
            raise NotReady("no version to start from")
        ticket, seed = self.store.ticket(m), self.store.rows(m)
        rows, cursor, touched, known, left = seed, m.cursor, None, self.known(m), self.budget
        done = Replayed(cursor)
        start = cursor
        following = self._end(m, cursor)
        while cursor != following:
            if done.windows + done.widened >= self.most_windows:
                raise journal.ReconcileError("the journal is never quiet")
            window = journal.window(self.records(start, following).where(F.col("source") == m.source), start, following)
            bad = F.count_if(F.col("object").isNull() | F.col("parent").isNull())
            facts = window.agg(F.count("*").alias("n"), F.coalesce(F.sum(journal.record_bytes(F.col("name"))), F.lit(0)).alias("size"), bad.alias("bad")).first()
            if facts.bad:
                raise journal.ReconcileError("malformed records")
            if left is not None and facts.size > left:
                raise journal.ReplayBudgetError(f"{facts.size} bytes of records, {left} allowed")
            try:
                after, hit = journal.changed(rows, window, self.listing().where(F.col("source") == m.source), self.root, known=known)
            except journal.ReconcileError:
                end = self._end(m, start)
                if end == following:  # later records can't explain it
                    raise
                following = end
                done.widened += 1
                continue
            left = None if left is None else left - facts.size
            done.windows, done.records = done.windows + 1, done.records + facts.n
            if hit is not None:
                hit = hit.select(*KEY).distinct()
                touched = hit if touched is None else written(touched.unionByName(hit).distinct(), "touched")
                rows, known = written(after.select(*seed.columns), "candidate"), None
            cursor = start = following
            following = self._end(m, cursor)
        done.cursor = cursor
        if cursor == m.cursor:
            return done
        if touched is None:
            self.store.advance(ticket, cursor)
            return done
        undo = f"undo/v={m.version + 1}-{uuid.uuid4().hex}"
        try:
            done.undo_entries = self._saved(seed, touched, undo)
            parts = [r[0] for r in touched.select(shard(KEY, m.shards)).distinct().collect()]  # a row a shard
            self.store.publish(rows, ticket, m.source, m.journal, cursor, None, KEY, m.shards, parts)
        except Exception:
            self.store.remove(undo)
            raise
        for name in self.store._names("undo"):  # what took back versions before this one
            if int(name.split("=")[1].split("-")[0]) <= m.version:
                self.store.remove(f"undo/{name}")
        done.undo = undo
        return done

    def _saved(self, seed: DataFrame, touched: DataFrame, folder: str) -> int:
        """Writes (source, parent, old): the children of touched parents as the seed has them, null for a parent without any; the number of rows."""
        old = seed.join(touched, KEY, "left_semi").select(*KEY, F.struct(*seed.columns).alias("old"))
        none = touched.join(old.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, F.lit(None).cast(old.schema["old"].dataType).alias("old"))
        path = f"{self.store.path}/{folder}"
        old.unionByName(none).write.parquet(path)
        return self.store.spark.read.schema(T.StructType([*touched.select(*KEY).schema.fields, old.schema["old"]])).parquet(path).count()


def undone(store: Store, undo: str, rows: DataFrame) -> DataFrame:
    """rows of the version that a replay published, as they were before it."""
    saved = store.spark.read.parquet(f"{store.path}/{undo}")
    kept = rows.join(saved.select(*KEY).distinct(), KEY, "left_anti")
    return kept.unionByName(saved.where("old is not null").select("old.*").select(*rows.columns))


def roll_back(store: Store, undo: str, cursor: int) -> Manifest:
    """Publishes the rows before a replay, with the cursor they had, as the newest version; NotReady if something was published since."""
    m = store.manifest()
    if m is None or not undo.startswith(f"undo/v={m.version}-"):
        raise NotReady("overtaken: the undo segment is of another version")
    saved = store.spark.read.parquet(f"{store.path}/{undo}")
    parts = [r[0] for r in saved.select(shard(KEY, m.shards)).distinct().collect()]  # a row a shard
    rows = undone(store, undo, store.rows(m))
    return store.publish(rows, store.ticket(m), m.source, m.journal, cursor, None, KEY, m.shards, parts, reset=True)
