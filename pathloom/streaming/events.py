"""An inventory (path, kind) kept current from batches of changes, with a correction from a listing where they don't suffice.

A batch counts as a whole: if it tells of a loss, holds an unusable path or more changes than the queue
takes, or has renames that depend on each other, its changes are dropped, and the listing is published.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.inventory import QUEUE, CorrectionNeeded, applied
from pathloom.session import written
from pathloom.streaming.pairing import batch_verdict
from pathloom.streaming.store import Manifest, NotReady, Store, changed_shards

KEY, SHARDS = ["path"], 16


class Follower:
    """The function for foreachBatch (or the sink of pairing.Pairs) that keeps the store of an inventory; the store's cursor counts epochs."""

    def __init__(self, store: Store, listing: Callable[[], DataFrame], source: str = "", most: int = QUEUE, attempts: int = 4):
        self.store, self.listing, self.source, self.most, self.attempts = store, listing, source, most, attempts
        self.applied = self.corrected = self.unchanged = 0
        #: Batches that told of a loss, by its kind; `overflow` and `dependent` are those that could not be applied as they were.
        self.losses: Counter = Counter()

    def bootstrap(self) -> None:
        """Version 1 from the listing."""
        self.store.publish(self.listing().select("path", "kind"), self.store.ticket(), self.source, "events", 0, None, KEY, SHARDS, first=True)

    def _publish(self, m: Manifest, rows: DataFrame, cursor: int) -> bool:
        """Publishes the shards that differ; False if none does."""
        touched = [r.shard for r in changed_shards(self.store.rows(m), rows, shards=m.shards).collect()]  # at most SHARDS
        if not touched:
            self.store.advance(self.store.ticket(m), cursor)
            return False
        self.store.publish(rows, self.store.ticket(m), self.source, "events", cursor, None, KEY, m.shards, touched)
        return True

    def __call__(self, changes: DataFrame, epoch: int) -> None:
        m = self.store.manifest()
        if m is None:
            raise NotReady("no version to start from")
        if m.cursor > epoch:  # a restart repeats this one
            return
        changes = written(changes if self.source == "" else changes.where(F.col("source") == self.source), "changes")
        verdict = batch_verdict(changes, self.most)
        if not verdict["apply"]:
            self.losses.update([*verdict["kinds"], *(["overflow"] if verdict["overflow"] else [])])
            self.correct(epoch + 1)
            return
        rename = F.col("kind") == "rename"
        ordered = changes.select(
            F.col("seq"), "kind", F.when(~rename, F.col("path")).alias("path"), F.when(rename, F.col("source_path")).alias("source"), F.when(rename, F.col("path")).alias("target")
        )
        try:
            rows = written(applied(self.store.rows(m), ordered, self.listing().select("path", "kind"), self.most), "inventory")
        except CorrectionNeeded:
            self.losses["dependent"] += 1
            self.correct(epoch + 1)
            return
        if self._publish(m, rows, epoch + 1):
            self.applied += 1
        else:
            self.unchanged += 1

    def correct(self, cursor: int) -> None:
        """Publishes the listing; tries again while it is overtaken."""
        for attempt in range(self.attempts):
            try:
                self._publish(self.store.manifest(), written(self.listing().select("path", "kind"), "listing"), cursor)
                self.corrected += 1
                return
            except NotReady as e:
                if "overtaken" not in str(e) or attempt + 1 == self.attempts:
                    raise
