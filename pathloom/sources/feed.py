"""A journal as a stream: a Python data source whose offset is (journal id, usn).

A journal is a folder: `bounds.json` tells its id and what it holds (first, lowest, next), and below
`segments` lie folders `FIRST-NEXT` of record batches in Parquet (a column `data`, usn.decode()'s format),
each with the records from FIRST up to, but without, NEXT. A new segment comes before the bounds that tell
of it; old ones go after the bounds that don't. Bounds and segments are read by pyarrow's file systems, on
the driver only to plan, on executors to decode: a partition for about SPLIT_BYTES of files, however few
segments or files there are. A file is split between its row groups, which append() keeps small.

A start that the journal no longer holds, or one of another journal, is a gap: its only row has no usn,
which maintain.Maintainer answers with a rebuild from the listing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from pathloom.session import ship
from pathloom.sources import usn
from pathloom.streaming.maintain import JOURNAL
from pathloom.streaming.store import Files

NAME = "pathloom_journal"
#: Bytes of files for each partition, as they are on disk (about 70,000 records), unless there were more than MOST_PARTITIONS of them.
SPLIT_BYTES, MOST_PARTITIONS = 1 << 20, 1 << 14
#: Bytes of a row group before compression, about SPLIT_BYTES on disk.
GROUP_BYTES = 4 << 20
KINDS = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]


def _opened(path: str):
    """(file system, path) for pyarrow."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def bounds(path: str) -> dict:
    """{journal, first, lowest, next} of a journal; ValueError if they contradict each other."""
    files, at = _opened(path)
    with files.open_input_stream(f"{at}/bounds.json") as f:
        found = json.loads(f.read())
    if not 0 <= found["first"] <= found["next"] or not 0 <= found["lowest"] <= found["next"]:
        raise ValueError(f"bounds {found}")
    return found


@dataclass
class Stretch(InputPartition):
    """Pieces (file, first byte, end) of segments, and the records wanted of them; without pieces, a gap."""

    pieces: list[tuple[str, int, int]]
    start: int = 0
    end: int = 0


def stretches(files: list[tuple[str, int]], split: int, most: int) -> list[list[tuple[str, int, int]]]:
    """Files (path, size) cut into pieces (path, first byte, end) of at most `split` bytes; small pieces share a list."""
    split = max(split, -(-sum(size for _, size in files) // most))
    out, room = [], 0
    for path, size in files:
        for low in range(0, size, split):
            high = min(low + split, size)
            if not out or high - low > room:
                out.append([])
                room = split
            out[-1].append((path, low, high))
            room -= high - low
    return out


def groups(meta, low: int, high: int) -> list[int]:
    """The row groups of a Parquet file that start from byte low up to, but without, high."""
    first = [meta.row_group(k).column(0) for k in range(meta.num_row_groups)]
    starts = [c.data_page_offset if c.dictionary_page_offset is None else min(c.dictionary_page_offset, c.data_page_offset) for c in first]
    return [k for k, at in enumerate(starts) if low <= at < high]


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.source, self.start = options["path"].rstrip("/"), options["source"], options.get("start")

    def initialOffset(self) -> dict:
        b = bounds(self.path)
        return {"journal": b["journal"], "usn": int(self.start if self.start is not None else max(b["first"], b["lowest"]))}

    def latestOffset(self) -> dict:
        b = bounds(self.path)
        return {"journal": b["journal"], "usn": b["next"]}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        from pyarrow import fs

        b = bounds(self.path)
        if start["journal"] != end["journal"] or not max(b["first"], b["lowest"]) <= start["usn"] <= b["next"]:
            return [Stretch([])]
        files, at = _opened(self.path)
        held = []
        for found in files.get_file_info(fs.FileSelector(f"{at}/segments")):
            first, _, following = found.base_name.partition("-")
            if found.type == fs.FileType.Directory and following.isdigit() and int(first) < end["usn"] and int(following) > start["usn"]:
                held += [(f.path, f.size) for f in files.get_file_info(fs.FileSelector(found.path)) if f.base_name.endswith(".parquet")]
        return [Stretch(pieces, start["usn"], end["usn"]) for pieces in stretches(sorted(held), SPLIT_BYTES, MOST_PARTITIONS)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.pieces:
            yield _batch([(self.source, *[None] * (len(KINDS) - 1))])
            return
        import pyarrow.parquet as pq

        files, _ = _opened(self.path)
        for path, low, high in partition.pieces:
            with files.open_input_file(path) as f:
                held = pq.ParquetFile(f)
                for batch in held.iter_batches(batch_size=usn.BUFFERS, row_groups=groups(held.metadata, low, high), columns=["data"]):
                    rows = []
                    for data in batch.column("data").to_pylist():
                        for obj, parent, at, reason, attributes, raw, _ in usn.decode(data or b""):
                            if partition.start <= at < partition.end:
                                signed = [x - (1 << 64) if x >> 63 else x for x in (obj, parent)]
                                rows.append((self.source, at, None, *signed, reason, attributes - (1 << 32) if attributes >> 31 else attributes, usn.text(raw)))
                    if rows:
                        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Journal rows as an Arrow batch."""
    columns = list(zip(*rows)) or [[]] * len(KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], [c.split()[0] for c in JOURNAL.split(", ")])


class Journal(DataSource):
    """Options: path, source (the name that rows get), start (a usn; default: the first one held)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return JOURNAL

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


def stream(spark: SparkSession, path: str, source: str, start: int | None = None) -> DataFrame:
    """The records of a journal as a stream of journal rows."""
    ship(spark)
    spark.dataSource.register(Journal)
    reader = spark.readStream.format(NAME).option("path", path).option("source", source)
    return (reader if start is None else reader.option("start", str(start))).load()


class Folder(Files):
    """Writes a journal: segments, bounds, and what is dropped from it."""

    def append(self, records: DataFrame, first: int, following: int) -> None:
        """Adds the records from first up to following as a segment."""
        some = records.where((F.col("usn") >= first) & (F.col("usn") < following))
        usn.encoded(some).select("data").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{self.path}/segments/{first}-{following}")

    def tell(self, journal: str, first: int, following: int, lowest: int = 0) -> None:
        """Replaces the bounds."""
        at, hidden = self._at("bounds.json"), f"bounds.{uuid.uuid4().hex}"
        self._put(hidden, json.dumps({"journal": journal, "first": first, "lowest": lowest, "next": following}))
        self._fs.delete(at, False)
        self._fs.rename(self._at(hidden), at)

    def drop(self, before: int) -> None:
        """Removes segments that end at or before a usn."""
        for name in self._names("segments"):
            if name.partition("-")[2].isdigit() and int(name.partition("-")[2]) <= before:
                self._fs.delete(self._at(f"segments/{name}"), True)

    def holds(self) -> tuple[str, int, int, int]:
        """What Maintainer asks for: (journal id, first, lowest, next)."""
        b = json.loads(self._text("bounds.json"))
        return b["journal"], b["first"], b["lowest"], b["next"]
