"""Binary journal records (versions 2 and 3) and directory listings as rows.

A batch decodes wholly or not at all: one bad record refuses the batch. Decoding is the
one place that needs Python on rows; it runs on Arrow batches.
"""

from __future__ import annotations

import re
import struct
from collections import namedtuple
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.names import CREATED, DELETED, any_bit
from pathloom.session import ship

MOST_BYTES, MOST_RECORDS, MOST_UNITS = 64 * 1024, 2048, 255
#: Buffers in an Arrow batch that Python makes.
BUFFERS = 64
#: The fields of a record in their order; ids have 8 bytes in version 2 and 16 in version 3.
FIELDS = "length major minor object parent usn time reason cause security attributes name_bytes name_at"
FORMS = {2: struct.Struct("<IHH8s8sqqIIIIHH"), 3: struct.Struct("<IHH16s16sqqIIIIHH")}
Record = namedtuple("Record", FIELDS)
#: Units that a name must not hold.
FORBIDDEN = frozenset("\0/\\".encode("utf-16-le")[::2])
SCHEMA = "batch_id long, object binary, parent binary, usn long, reason long, attributes long, name_raw binary, name string, major int"


class RecordError(ValueError):
    """A batch that can't be trusted."""


def _record(data: bytes, at: int, majors: tuple[int, ...]) -> tuple[Record, bytes]:
    """The record at a place, with its raw name; RecordError names every field that is wrong."""
    room = len(data) - at
    form = FORMS.get(int.from_bytes(data[at + 4 : at + 6], "little")) if room >= 8 else None
    if form is None or room < form.size:
        raise RecordError(f"byte {at}: no record of a known version")
    r = Record._make(form.unpack_from(data, at))
    raw = data[at + r.name_at : at + r.name_at + r.name_bytes]
    units = struct.unpack(f"<{len(raw) // 2}H", raw[: len(raw) // 2 * 2])
    wrong = {
        "major": r.major not in majors,
        "minor": r.minor != 0,
        "length": r.length % 8 != 0 or not form.size <= r.length <= room,
        "name_bytes": r.name_bytes % 2 != 0 or not 1 <= len(units) <= MOST_UNITS,
        "name_at": r.name_at % 2 != 0 or not form.size <= r.name_at <= r.length - r.name_bytes,
        "name": not FORBIDDEN.isdisjoint(units),
    }
    if bad := [field for field, is_wrong in wrong.items() if is_wrong]:
        raise RecordError(f"byte {at}: {', '.join(bad)}")
    return r, raw


def decode(data: bytes, majors: tuple[int, ...] = (2,)) -> list[tuple]:
    """(object, parent, usn, reason, attributes, raw name, major) of each record; ids as integers."""
    if len(data) > MOST_BYTES:
        raise RecordError(f"{len(data)} bytes in a batch, {MOST_BYTES} allowed")
    out, at = [], 0
    while at < len(data):
        r, raw = _record(data, at, majors)
        at += r.length
        out.append((int.from_bytes(r.object, "little"), int.from_bytes(r.parent, "little"), r.usn, r.reason, r.attributes, raw, r.major))
        if len(out) > MOST_RECORDS:
            raise RecordError(f"over {MOST_RECORDS} records in a batch")
    return out


def encode(records: list[tuple], major: int = 2) -> bytes:
    """A batch of (object, parent, usn, reason, attributes, raw name), for tests and replays."""
    form, wide, out = FORMS[major], 8 * (major - 1), []
    for obj, parent, at, why, attributes, raw in records:
        length = -(-(form.size + len(raw)) // 8) * 8
        r = Record(length, major, 0, obj.to_bytes(wide, "little"), parent.to_bytes(wide, "little"), at, 0, why, 0, 0, attributes, len(raw), form.size)
        out.append((form.pack(*r) + raw).ljust(length, b"\0"))
    return b"".join(out)


def text(raw: bytes) -> str | None:
    """A raw name as text; None if it has units that are no text."""
    try:
        return raw.decode("utf-16-le")
    except UnicodeDecodeError:
        return None


def records(batches: DataFrame, majors: tuple[int, ...] = (2,)) -> DataFrame:
    """The records of rows (batch_id, data): ids as 16 big-endian bytes, name null if it is no text."""

    def decoded(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [
                (b, o.to_bytes(16, "big"), p.to_bytes(16, "big"), *rest[:3], rest[3], text(rest[3]), rest[4])
                for b, data in zip(part.column("batch_id").to_pylist(), part.column("data").to_pylist())
                for o, p, *rest in decode(data or b"", majors)
            ]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int32()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    ship(batches.sparkSession)
    return batches.select("batch_id", "data").mapInArrow(decoded, SCHEMA)


def files(spark: SparkSession, path: str, stream: bool = False, majors: tuple[int, ...] = (2,)) -> DataFrame:
    """The records of a folder of batch files, read once or as a stream of new files."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    found = reader.format("binaryFile").load(path)
    return records(found.select(F.xxhash64("path").alias("batch_id"), F.col("content").alias("data")), majors)


def journal_rows(decoded: DataFrame, source: str) -> DataFrame:
    """Decoded records as journal rows; ids wider than 64 bits are refused when they are read."""
    def narrow(c: str):
        wide = F.hex(F.substring(c, 1, 8)) != "0" * 16
        low = F.conv(F.hex(F.substring(c, 9, 8)), 16, -10).cast("long")
        return F.when(wide, F.raise_error(F.lit("an id is wider than 64 bits")).cast("long")).otherwise(low)

    return decoded.select(
        F.lit(source).alias("source"), "usn", F.lit(None).cast("timestamp").alias("ts"), narrow("object").alias("object"),
        narrow("parent").alias("parent"), "reason", F.col("attributes").cast("int").alias("attributes"), "name",
    )


#: What is read of a buffer's entries (format, place), the bytes before the name, and how entries are aligned.
Layout = namedtuple("Layout", "fields head align")
NOTICE = Layout({"following": ("<I", 0), "action": ("<I", 4), "size": ("<I", 8)}, 12, 4)
ENTRY = Layout({"following": ("<I", 0), "attributes": ("<I", 56), "size": ("<I", 60), "object": ("<Q", 96)}, 104, 8)
NOTICE_NAME_BYTES = 4096
DOTS = (".".encode("utf-16-le"), "..".encode("utf-16-le"))


def _chained(data: bytes, layout: Layout, most: int, last_ends: bool) -> Iterator[tuple[dict, bytes]]:
    """(fields, raw name) of entries that each tell where the next one is; RecordError names what is wrong with one.

    last_ends: nothing but padding may follow the last entry.
    """
    at = 0
    while True:
        room = len(data) - at
        if room < layout.head:
            raise RecordError(f"byte {at}: truncated")
        f = {k: struct.unpack_from(form, data, at + place)[0] for k, (form, place) in layout.fields.items()}
        end, following = layout.head + f["size"], f["following"]
        wrong = {
            "size": not 0 < f["size"] <= most or f["size"] % 2 != 0 or end > room,
            "following": following != 0 and (following % layout.align != 0 or not end <= following < room),
            "rest": last_ends and following == 0 and room - end >= layout.align,
        }
        if bad := [field for field, is_wrong in wrong.items() if is_wrong]:
            raise RecordError(f"byte {at}: {', '.join(bad)}")
        yield f, data[at + layout.head : at + end]
        if not following:
            return
        at += following


def decode_notices(data: bytes, most: int = MOST_RECORDS) -> tuple[list[tuple[int, str | None]], str | None]:
    """((action, name) of each notice of a buffer, the kind of loss it ends with or None).

    A malformed notice, or one more than `most`, is a loss: what came before it counts, what follows can't be trusted.
    A name is a relative path with neither empty nor dot parts, colons or NUL; it is None if it is no text.
    """
    out = []
    try:
        for f, raw in _chained(data, NOTICE, NOTICE_NAME_BYTES, True) if data else ():
            if len(out) == most:
                return out, "user_overflow"
            units = raw.decode("utf-16-le", "surrogatepass")
            if re.search(r"[\0:]", units) or any(part in ("", ".", "..") for part in re.split(r"[\\/]", units)):
                return out, "invalid_event"
            out.append((f["action"], text(raw)))
    except RecordError:
        return out, "invalid_event"
    return out, None


def decode_listing(data: bytes, parent: int) -> list[tuple]:
    """(object, parent, attributes, raw name) of a listing buffer (entries with ids); dot entries left out, any wrong entry refuses the buffer."""
    out = []
    for f, raw in _chained(data, ENTRY, 2 * MOST_UNITS, False) if data else ():
        if not FORBIDDEN.isdisjoint(struct.unpack(f"<{len(raw) // 2}H", raw)):
            raise RecordError("name")
        if raw in DOTS:
            continue
        if f["object"] == 0:
            raise RecordError("object")
        out.append((f["object"], parent, f["attributes"], raw))
    return out


def _in_batches(rows: DataFrame, batch: dict, pack, columns: list[str], order: str, schema: str) -> DataFrame:
    """rows packed by pack(list of rows in order, batch) into `data`, one buffer for each value of the batch columns.

    Rows come to Python sorted, and those of one buffer are held at a time. The caller's batch columns bound
    the rows of a buffer, so no list grows with a group.
    """
    names, labels = [order, *[c for c in columns if c != order]], list(batch)
    keys = [f"_{n}" for n in labels]

    def told(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
        for part in parts:
            key, row = (zip(*(part.column(c).to_pylist() for c in some)) for some in (keys, names))
            yield from zip(key, row)

    def made(buffers: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*buffers), (c.split() for c in schema.split(", ")))]
        return pa.RecordBatch.from_arrays(arrays, [*labels, "data"])

    def packed(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for key, held in groupby(told(parts), itemgetter(0)):
            done.append((*key, pack([dict(zip(names, row)) for _, row in held], dict(zip(labels, key)))))
            if len(done) == BUFFERS:
                yield made(done)
                done = []
        if done:
            yield made(done)

    ship(rows.sparkSession)
    dealt = rows.select(*[c.alias(k) for k, c in zip(keys, batch.values())], *names).repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *names).mapInArrow(packed, schema)


def encoded(journal: DataFrame, each: int = 256, major: int = 2) -> DataFrame:
    """(batch_id, data): journal rows (usn, object, parent, reason, attributes, name) as batches of records."""

    def pack(rows: list[dict], _: dict) -> bytes:
        return encode([(r["object"], r["parent"], r["usn"], r["reason"], r["attributes"], r["name"].encode("utf-16-le")) for r in rows], major)

    # at most `each` rows in a batch, as a usn is unique in a journal
    batch = {"batch_id": F.floor(F.col("usn") / each).cast("long")}
    return _in_batches(journal, batch, pack, ["usn", "object", "parent", "reason", "attributes", "name"], "usn", "batch_id long, data binary")


def encode_notices(notices: list[tuple[int, str]]) -> bytes:
    """A buffer of (action, name), for tests and replays."""
    out = []
    for k, (action, name) in enumerate(notices):
        raw = name.encode("utf-16-le")
        size = -(-(12 + len(raw)) // 4) * 4
        out.append(struct.pack("<III", size if k + 1 < len(notices) else 0, action, len(raw)) + raw.ljust(size - 12, b"\0"))
    return b"".join(out)


#: Actions of notices.
ACTIONS = {1: "added", 2: "removed", 3: "modified", 4: "old", 5: "new"}


def notices(buffers: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """(source, seq, at_ms, action, path) of buffers (source, first, at_ms, data): seq counts on from first.

    Where a buffer can't be read further, or a notice has an unknown action, the action is `lost` and path the kind of loss.
    """

    def decoded(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for source, first, at, data in zip(*(part.column(c).to_pylist() for c in ("source", "first", "at_ms", "data"))):
                told, loss = decode_notices(data or b"", most)
                found = [(ACTIONS[action], name) if action in ACTIONS else ("lost", "invalid_event") for action, name in told]
                rows += [(source, first + k, at, *x) for k, x in enumerate(found + ([("lost", loss)] if loss else []))]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["source", "seq", "at_ms", "action", "path"])

    ship(buffers.sparkSession)
    return buffers.select("source", "first", "at_ms", "data").mapInArrow(decoded, "source string, seq long, at_ms long, action string, path string")


def packed_notices(rows: DataFrame, each: int = 16) -> DataFrame:
    """(source, first, at_ms, data): notices (source, seq, at_ms, action, path) as buffers of stretches of seq, told at the earliest time."""
    codes = {name: code for code, name in ACTIONS.items()}

    def pack(rows: list[dict], _: dict) -> bytes:
        return encode_notices([(codes[r["action"]], r["path"]) for r in rows])

    timed = rows.withColumn("first", (F.floor(F.col("seq") / each) * each).cast("long"))
    times = timed.groupBy("source", "first").agg(F.min("at_ms").alias("at_ms"))
    batch = {"source": F.col("source"), "first": F.col("first")}
    return _in_batches(timed, batch, pack, ["seq", "action", "path"], "seq", "source string, first long, data binary").join(times, ["source", "first"])


def encode_listing(entries: list[tuple[int, int, bytes]]) -> bytes:
    """A listing buffer of (object, attributes, raw name), for tests and replays; the inverse of decode_listing."""
    out = []
    for k, (identity, attributes, raw) in enumerate(entries):
        size = -(-(104 + len(raw)) // 8) * 8
        entry = bytearray(size)
        struct.pack_into("<I", entry, 0, size if k + 1 < len(entries) else 0)
        struct.pack_into("<II", entry, 56, attributes, len(raw))
        struct.pack_into("<Q", entry, 96, identity)
        entry[104 : 104 + len(raw)] = raw
        out.append(bytes(entry))
    return b"".join(out)


def packed_listings(entries: DataFrame, each: int = 256) -> DataFrame:
    """(source, parent, part, data): children of each directory as listing buffers, by stretches of object, dot entries in the lead."""

    def pack(rows: list[dict], batch: dict) -> bytes:
        dots = [(batch["parent"], 16, n.encode("utf-16-le")) for n in (".", "..")]
        return encode_listing(dots + [(r["object"], r["attributes"], r["name"].encode("utf-16-le")) for r in rows])

    batch = {"source": F.col("source"), "parent": F.col("parent"), "part": F.floor(F.col("object") / each).cast("long")}
    return _in_batches(entries, batch, pack, ["object", "attributes", "name"], "object", "source string, parent long, part long, data binary")


def listings(buffers: DataFrame) -> DataFrame:
    """(source, object, parent, attributes, name_raw, name) of listing buffers (source, parent, data); name null if it is no text."""

    def decoded(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [
                (source, *entry, text(entry[-1]))
                for source, parent, data in zip(*(part.column(c).to_pylist() for c in ("source", "parent", "data")))
                for entry in decode_listing(data or b"", parent)
            ]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            names = ["source", "object", "parent", "attributes", "name_raw", "name"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    ship(buffers.sparkSession)
    schema = "source string, object long, parent long, attributes long, name_raw binary, name string"
    return buffers.select("source", "parent", "data").mapInArrow(decoded, schema)


def batch_statistics(decoded: DataFrame) -> DataFrame:
    """One row of what records() told: records, batches, creations, deletions, reasons (the union of all bits), majors (those met)."""
    return decoded.agg(
        F.count("*").alias("records"), F.countDistinct("major", "batch_id").alias("batches"),
        F.count_if(any_bit(F.col("reason"), CREATED)).alias("creations"), F.count_if(any_bit(F.col("reason"), DELETED)).alias("deletions"),
        F.bit_or("reason").alias("reasons"), F.sort_array(F.collect_set("major")).alias("majors"),
    )
