"""Versions of a namespace or inventory: parts in Parquet folders, and a manifest for each version.

A version exists once its manifest does. Every attempt writes to a folder of its own, and the
manifest, which names the folder of each part, comes into being by a rename that refuses to
replace: of two writers one wins, and the other's folder is unused. Parts are hash shards of a
key, so a small change writes the shards it touches, and the manifest carries the others over.
The manifest also holds the journal cursor, so neither moves alone. Readers pin a version by a
lease; only what no manifest names is removed. Files are reached through Spark's file systems,
so a store may lie anywhere Spark can write.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.names import shard_of

EMPTY, PENDING, VALIDATED, FAILED, PINNED, STOPPED = "empty", "pending", "validated", "failed", "readers_pinned", "stopped"
#: Schema version of manifests; another one means: rebuild.
FORMAT = 2
SHARDS = 64


class NotReady(RuntimeError):
    """The state must not be saved, or the candidate was overtaken."""


@dataclass(frozen=True)
class Manifest:
    version: int
    source: str
    journal: str
    cursor: int
    records: int
    checksum: int
    #: For each shard: the folder below the store, the number of rows, the sum of their hashes.
    parts: dict[str, tuple[str, int, int]] = field(default_factory=dict)
    schema: str = ""
    key: tuple[str, ...] = ()
    shards: int = 1
    state: str = VALIDATED
    format: int = FORMAT


def total(rows: DataFrame) -> Column:
    """A sum over rows that their order doesn't change and repeated rows don't cancel."""
    return F.coalesce(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def checksum(rows: DataFrame) -> tuple[int, int]:
    """(number, sum of hashes) of the rows."""
    n, h = rows.agg(F.count("*"), total(rows)).first()
    return n, int(h)


def shard(key: list[str], shards: int) -> Column:
    """The shard of a row by the columns of its key."""
    return shard_of(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in key]), shards) if key else F.lit(0)


def changed_shards(old: DataFrame, new: DataFrame, key: str = "path", shards: int = SHARDS) -> DataFrame:
    """(shard): hash shards in which two tables differ; repeated rows count as often as they are there."""
    def sums(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(shard([key], shards).alias("shard")).agg(F.struct(F.count("*"), total(rows)).alias(name))

    return sums(old, "a").join(sums(new, "b"), "shard", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("shard")


def overwrite_shards(new: DataFrame, changed: DataFrame, path: str, key: str = "path", shards: int = SHARDS) -> None:
    """Writes just the changed shards of a table partitioned by shard, and removes those left without rows."""
    spark = new.sparkSession
    some = new.withColumn("shard", shard([key], shards)).join(changed, "shard", "left_semi")
    some.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for r in changed.join(some.select("shard").distinct(), "shard", "left_anti").collect():  # at most `shards` rows
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={r.shard}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Files:
    """Small files and folders below a path, through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _put(self, name: str, text: str) -> None:
        """Writes a small file whole or not at all; refuses to replace one."""
        hidden = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(hidden, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        refuse = self.spark.sparkContext._gateway.new_array(kinds, 1)
        refuse[0] = kinds.NONE
        try:
            context.rename(hidden, self._at(name), refuse)
        except Exception:
            self._fs.delete(hidden, False)
            if self._fs.exists(self._at(name)):
                raise NotReady(f"overtaken: {name} was published by another writer") from None
            raise

    def _text(self, name: str) -> str:
        found = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
        finally:
            found.close()

    def _numbers(self, folder: str) -> list[int]:
        """The numbers of the files N.json in a folder, ascending."""
        return sorted(int(n[:-5]) for n in self._names(folder) if n.endswith(".json"))

    def remove(self, folder: str) -> None:
        """Removes a folder, if it is there."""
        self._fs.delete(self._at(folder), True)

    def _sweep(self, prefix: str, live: set[str], age: float) -> list[str]:
        """Removes folders that start with a prefix, are not live and were not touched for `age` seconds; a writer may still fill younger ones."""
        at = self._at("")
        if not self._fs.exists(at):
            return []
        before = self._jvm.java.lang.System.currentTimeMillis() - age * 1000
        gone = [s for s in self._fs.listStatus(at) if s.getPath().getName().startswith(prefix) and s.getPath().getName() not in live and s.getModificationTime() <= before]
        for s in gone:
            self._fs.delete(s.getPath(), True)
        return [s.getPath().getName() for s in gone]


#: Seconds after which a folder that no manifest names is a crashed writer's.
ORPHAN_AGE = 24 * 3600.0


class Store(Files):
    """Published versions below a folder."""

    def __init__(self, spark: SparkSession, path: str, most_versions: int = 2, most_leases: int = 8, orphan_age: float = ORPHAN_AGE):
        super().__init__(spark, path)
        self.most_versions, self.most_leases, self.orphan_age = most_versions, most_leases, orphan_age
        self._signals, self._stopped, self._error = 0, False, None
        self._leases: dict[str, int] = {}

    # versions

    def versions(self) -> list[int]:
        return self._numbers("manifests")

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The manifest of a version, the newest by default; None if there is none or its format is unknown."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            return None
        found = json.loads(self._text(f"manifests/{version or known[-1]:012d}.json"))
        if found.get("format") != FORMAT:
            return None
        return Manifest(**found | {"key": tuple(found["key"]), "parts": {k: tuple(p) for k, p in found["parts"].items()}})

    def folders(self, version: int | None = None) -> list[str]:
        """The folders that hold a version's rows."""
        m = self.manifest(version)
        if m is None:
            raise NotReady("no version")
        return [f"{self.path}/{folder}" for folder, _, _ in m.parts.values()]

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m is None:
            raise NotReady("no version")
        return self.rows(m)

    def rows(self, m: Manifest) -> DataFrame:
        """The rows of a manifest."""
        return self.parts(m, [folder for folder, _, _ in m.parts.values()])

    def parts(self, m: Manifest, folders: list[str]) -> DataFrame:
        """The rows of some folders of parts, with a manifest's schema."""
        schema = T.StructType.fromJson(json.loads(m.schema))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def there(self, folders: list[str]) -> bool:
        """Whether folders of parts were not removed yet."""
        return all(self._fs.exists(self._at(f)) for f in folders)

    def verify(self, version: int | None = None) -> bool:
        """Whether a version's rows are those that were published."""
        m = self.manifest(version)
        return checksum(self.read(version)) == (m.records, m.checksum)

    def ticket(self, m: Manifest | None = None) -> tuple[int, int]:
        """What a candidate must present: the signals and the version it was made from, that of a manifest or the newest."""
        m = m or self.manifest()
        return self._signals, m.version if m else 0

    def signal(self) -> None:
        """Something changed: candidates made before are out of date."""
        self._signals += 1

    def publish(
        self, rows: DataFrame, ticket: tuple[int, int], source: str, journal: str, cursor: int, check=None,
        key: list[str] | None = None, shards: int = SHARDS, touched: list[int] | None = None, first: bool = False, reset: bool = False,
    ) -> Manifest:
        """Writes rows as the next version and commits it, unless the ticket is out of date.

        key: the columns whose hash deals rows to shards; without it there is one. touched: the only
        shards that are written, of a version with the same key; the others are carried over.
        check(rows) raises to refuse what is written. first: refuses if there is a version already.
        reset: the cursor may go back, as the journal itself has.
        With more live versions than allowed, and readers on the old ones, nothing is published
        until leases end.
        """
        before = self._ready(cursor)
        if first and before is not None:
            raise NotReady("there is a version already")
        key, shards = list(key or []), shards if key else 1
        if touched is not None:
            if before is None or before.key != tuple(key) or before.shards != shards:
                raise NotReady("shards of another key")
            rows = rows.where(shard(key, shards).isin(touched))
        version = ticket[1] + 1
        folder = f"v={version}-{uuid.uuid4().hex}"
        try:
            cut = rows.withColumn("shard", shard(key, shards))
            (cut.repartition("shard") if key else cut).write.partitionBy("shard").parquet(f"{self.path}/{folder}")
            schema = T.StructType(rows.schema.fields)
            names = [n.removeprefix("shard=") for n in self._names(folder) if n.startswith("shard=")]
            every = [f"{self.path}/{folder}/shard={n}" for n in names]
            written = self.spark.read.schema(schema).parquet(*every) if every else self.spark.createDataFrame([], schema)
            if check is not None:
                check(written)
            sums = written.groupBy(shard(key, shards).alias("shard")).agg(F.count("*").alias("n"), total(written).alias("h")).collect()  # a row a shard
            parts = {k: p for k, p in before.parts.items() if int(k) not in touched} if touched is not None else {}
            parts |= {str(r.shard): (f"{folder}/shard={r.shard}", r.n, int(r.h)) for r in sums}
            return self._commit(ticket, Manifest(version, source, journal, cursor, 0, 0, parts, schema.json(), tuple(key), shards), reset)
        except Exception as e:
            self._error = str(e)
            self._fs.delete(self._at(folder), True)
            raise

    def advance(self, ticket: tuple[int, int], cursor: int) -> Manifest:
        """The newest version again with a later cursor: a manifest, and no rows."""
        before = self._ready(cursor)
        if before is None:
            raise NotReady("no version")
        return self._commit(ticket, replace(before, version=ticket[1] + 1, cursor=cursor))

    def _ready(self, cursor: int) -> Manifest | None:
        if self._stopped or cursor < 0:
            raise NotReady("stopped" if self._stopped else "cursor")
        self.vacuum()
        if len(self.versions()) >= self.most_versions:
            raise NotReady(PINNED)
        return self.manifest()

    def _commit(self, ticket: tuple[int, int], m: Manifest, reset: bool = False) -> Manifest:
        newest = self.manifest()
        if ticket != (self._signals, newest.version if newest else 0):
            raise NotReady("overtaken")
        if not reset and newest and newest.source == m.source and newest.journal == m.journal and m.cursor < newest.cursor:
            raise NotReady(f"the cursor would go back from {newest.cursor} to {m.cursor}")
        m = replace(m, records=sum(n for _, n, _ in m.parts.values()), checksum=sum(h for _, _, h in m.parts.values()))
        self._put(f"manifests/{m.version:012d}.json", json.dumps(asdict(m)))
        self._error = None
        return m

    def compact(self, files: int) -> Manifest:
        """The newest version again in so many files, with the same cursor."""
        m = self.manifest()
        return self.publish(self.rows(m).repartition(files), self.ticket(m), m.source, m.journal, m.cursor, key=list(m.key), shards=m.shards)

    def sparse(self, row_bytes: int = 64, file_bytes: int = 32 << 20) -> bool:
        """Whether the newest version has more than twice the files that its rows need."""
        m, files = self.manifest(), len(self.read().inputFiles())
        return files > 2 * max(1, m.records * row_bytes // file_bytes)

    # readers

    def lease(self, version: int | None = None) -> str:
        """Pins a version; the lease is to be given back."""
        if len(self._leases) >= self.most_leases:
            raise NotReady("too many readers")
        m = self.manifest(version)
        if m is None:
            raise NotReady("no version")
        key = uuid.uuid4().hex
        self._leases[key] = m.version
        self._put(f"leases/{key}", str(m.version))
        return key

    def leased(self, key: str) -> DataFrame:
        return self.read(self._leases[key])

    def release(self, key: str) -> None:
        self._leases.pop(key, None)
        self._fs.delete(self._at(f"leases/{key}"), False)

    def vacuum(self) -> list[int]:
        """Removes versions that are neither the newest nor leased, and their folders unless a later version carries them over.

        Folders of crashed writers, which no manifest names, go once they are older than orphan_age.
        """
        known = self.versions()
        held = {int(self._text(f"leases/{k}") or 0) for k in self._names("leases") if not k.endswith((".tmp", ".crc"))}
        gone = [v for v in known[:-1] if v not in held]
        folders = {v: {f for f, _, _ in m.parts.values()} if (m := self.manifest(v)) else set() for v in known}
        live = set().union(*(folders[v] for v in known if v not in gone))
        for v in gone:
            self._fs.delete(self._at(f"manifests/{v:012d}.json"), False)
            for folder in folders[v] - live:
                self._fs.delete(self._at(folder), True)
        self._sweep("v=", {f.split("/")[0] for f in live}, self.orphan_age)
        return gone

    def status(self) -> dict:
        """version, cursor, records, state and error, for monitors."""
        m = self.manifest()
        state = STOPPED if self._stopped else FAILED if self._error else EMPTY if m is None else VALIDATED
        facts = {k: v for k, v in asdict(m).items() if k not in ("parts", "schema")} if m else {"version": 0, "cursor": 0, "records": 0}
        return facts | {"state": state, "error": self._error}

    def stop(self) -> None:
        """No more versions; readers keep what they have."""
        self._stopped = True
