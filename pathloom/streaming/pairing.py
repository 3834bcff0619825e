"""Pairing of renames in a stream of change notices, by source.

State is the last old name that waits for its new one, and the order reached. The very
next notice of the source must be a new name in less than MOST_MS; else the old name is
a loss. An old name that waits when its time is over is a loss as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import journal
from pathloom.operators.journal import loss_kind
from pathloom.session import ship, written

MOST_MS = 100
NOTICES = "source string, seq long, at_ms long, action string, path string"
CHANGES = "source string, seq long, kind string, path string, source_path string, loss boolean"
STATE = "seq long, at_ms long, path string"
#: A source's notices of a micro-batch, as they are held, and how many are rows of Python at a time.
HELD, STEP = pa.schema([("seq", pa.int64()), ("at_ms", pa.int64()), ("action", pa.string()), ("path", pa.large_string())]), 1 << 14


def paired(rows: list[tuple], waiting: tuple | None, most_ms: int = MOST_MS) -> tuple[list[tuple], tuple | None]:
    """(seq, at_ms, action, path) rows in order -> (seq, kind, path, source_path, loss) rows, and what waits now."""
    out = []
    for seq, at, action, path in rows:
        if waiting is not None:
            if action == "new" and at - waiting[1] < most_ms:
                out.append((seq, "rename", path, waiting[2], False))
                waiting = None
                continue
            out.append((waiting[0], "loss", waiting[2], None, True))
            waiting = None
        if action == "lost":
            out.append((seq, "loss", None, path, True))
        elif action == "old":
            waiting = (seq, at, path)
        elif action == "new":
            out.append((seq, "loss", path, None, True))
        else:
            out.append((seq, "remove" if action == "removed" else "refresh", path, None, False))
    return out, waiting


def in_order(parts: Iterable[pd.DataFrame], step: int = STEP) -> Iterator[list[tuple]]:
    """Lists of (seq, at_ms, action, path) by seq: all notices are held as Arrow columns, and only `step` of them as rows."""
    pieces = [[pa.array(p[f.name], f.type, from_pandas=True) for f in HELD] for p in parts]
    columns = [list(c) for c in zip(*pieces)]
    del pieces
    held = pa.table([pa.concat_arrays(columns.pop(0)) for _ in HELD], HELD)  # a column's pieces go before the next one is joined
    order = pc.sort_indices(held["seq"])
    for at in range(0, len(order), step):
        some = held.take(order.slice(at, step))
        yield list(zip(*(c.to_pylist() for c in some.columns)))


def rename_stream(notices: DataFrame, most_ms: int = MOST_MS, wait_ms: int | None = 2000) -> DataFrame:
    """The changes in a stream of notices; a source's state is one waiting name.

    A name that waits longer than wait_ms is a loss. None: it waits for the next notice, for
    streams that end when their input does (a stream with timeouts has always more to do).
    """
    ship(notices.sparkSession)

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting = state.get if state.exists else None
        names = [c.split()[0] for c in CHANGES.split(", ")]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], waiting[0], "loss", waiting[2], None, True)], columns=names)
            return
        for rows in in_order(parts):
            out, waiting = paired(rows, waiting, most_ms)
            yield pd.DataFrame([(key[0], *r) for r in out], columns=names)
        if waiting is None:
            if state.exists:
                state.remove()
        else:
            state.update((int(waiting[0]), int(waiting[1]), waiting[2]))
            if wait_ms is not None:
                state.setTimeoutDuration(wait_ms)

    return notices.groupBy("source").applyInPandasWithState(advance, CHANGES, STATE, "append", "NoTimeout" if wait_ms is None else "ProcessingTimeTimeout")


def still_waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The losses (as rows of CHANGES) that a stream's state still holds when its input has ended: names that wait."""
    held = spark.read.format("statestore").load(checkpoint).select("key.source", "value.groupState.*")
    return held.where("seq is not null").selectExpr("source", "seq", "'loss' AS kind", "path", "CAST(NULL AS STRING) AS source_path", "TRUE AS loss")


def batch_verdict(changes: DataFrame, most: int = 256) -> dict:
    """Whether a batch of changes may be applied: not if it holds a loss or more changes than the queue takes."""
    rows = batch_verdicts(changes.withColumn("_", F.lit(0)), ["_"], most).first()
    if rows is None:
        return {"apply": True, "losses": 0, "kinds": [], "overflow": False}
    return {"apply": rows.applies, "losses": rows.losses, "kinds": rows.kinds, "overflow": rows.changes > most}


def batch_verdicts(changes: DataFrame, batch: list[str], most: int = 256) -> DataFrame:
    """batch_verdict() of every batch at once: (batch columns, changes, losses, kinds, applies); kinds are those of its losses."""
    kinds = F.sort_array(F.collect_set(loss_kind()))  # a handful of kinds there are
    told = changes.groupBy(*batch).agg(F.count("*").alias("changes"), F.count_if("loss").alias("losses"), kinds.alias("kinds"))
    return told.withColumn("applies", (F.col("losses") == 0) & (F.col("changes") <= most))


class Pairs:
    """Pairing by micro-batch, without state in Python: the function for foreachBatch.

    An old name that is its source's last notice waits for the next batch, in a table of the epoch; all
    others are paired by rename_pairs(), whose stretches spread a source over tasks. A name that has waited
    for wait_ms before the latest notice of any source is a loss. An epoch that a restart repeats reads what
    the one before left and writes its own tables anew, so changes come once. sink(changes, epoch) gets them.
    """

    def __init__(self, spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], most_ms: int = MOST_MS, wait_ms: int | None = 2000):
        self.spark, self.path, self.sink, self.most_ms, self.wait_ms = spark, path.rstrip("/"), sink, most_ms, wait_ms

    def waiting(self, epoch: int) -> DataFrame:
        """(NOTICES) the old names that wait after an epoch."""
        if epoch < 0:
            return self.spark.createDataFrame([], NOTICES)
        return self.spark.read.schema(NOTICES).parquet(f"{self.path}/waiting/epoch={epoch}")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        batch = written(batch.selectExpr(*[c.split()[0] for c in NOTICES.split(", ")]), "notices")
        carried = self.waiting(epoch - 1)
        every = batch.unionByName(carried)
        last = every.groupBy("source").agg(F.max_by(F.struct("seq", "at_ms", "action", "path"), "seq").alias("last")).select("source", "last.*").where("action = 'old'")
        if self.wait_ms is not None:
            now = batch.agg(F.max("at_ms")).first()[0]
            last = last.where(F.lit(now).isNull() | (F.lit(now) - F.col("at_ms") < self.wait_ms))
        last.write.mode("overwrite").parquet(f"{self.path}/waiting/epoch={epoch}")
        kept = self.waiting(epoch)
        self.sink(journal.rename_pairs(every.join(kept, ["source", "seq"], "left_anti"), self.most_ms), epoch)
