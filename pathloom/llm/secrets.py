"""Secret scans with an incremental blob ledger. Built-in functions only.

Every version of a text is a blob, addressed by its SHA-256. The ledger is a folder with two
Parquet tables: every version ever seen (path, blob), a path being a doc_id, and every
(blob, rule version) pair ever scanned, with what was found. A scan takes a text of each blob
with pairs that the ledger lacks, applies just the missing rules and appends the pairs;
findings are joined back to all paths of a blob, those of this run (report) or of all runs
(history). Changing a rule changes its version, so only that rule runs again.
Both tables are sets: what a crashed or repeated run appends twice counts once.

Spans come from built-in functions: the texts between matches (split) and the matches
(regexp_extract_all) alternate, so running sums of their lengths are the positions.

Defined results: a null text is the empty blob; blanks and empty texts have no spans; very long
texts are scanned whole, by one task; texts that are equal under several doc_ids share one scan
(rows that repeat both doc_id and text are each scanned, and their pairs merge); spans that
start together are in the order of the rules; repeated rows and null doc_ids keep their rows;
an empty table gives no rows; further columns are ignored (or kept, by redacted(), whatever
their names).
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.session import shared_dir, written


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group has at least `least` characters are findings."""

    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        return f"{self.kind}-" + hashlib.sha256(f"{self.pattern}\n{self.group}\n{self.least}".encode()).hexdigest()[:12]


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
_STRETCH = re.compile(r"\[[^\[\]\\]+\]\+")
SPAN = "struct<start: bigint, kind: int, stop: bigint>"
#: Lengths are summed in blocks of this many, so that n matches cost about n * BLOCK steps, not n * n.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where body repeats it or uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """For each of the lengths, the sum of those before it."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
        lambda b: _total(F.slice(lengths, b * BLOCK + 1, BLOCK)),
    )
    return let(
        blocks,
        lambda sums: let(
            F.transform(sums, lambda x, b: _total(F.slice(sums, F.lit(1), b))),
            lambda offsets: F.transform(
                lengths,
                lambda x, i: F.get(offsets, F.floor(i / BLOCK).cast("int"))
                + _total(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)),
            ),
        ),
    )


def spans(text: Column, rule: Rule, order: int) -> Column:
    """The findings of one rule in a text: array of (start, kind, stop), in code points."""
    # a rule that is one class of characters takes whole stretches, so the short ones need not even match
    tight = rule.group == 0 and bool(_STRETCH.fullmatch(rule.pattern))
    pattern = f"{rule.pattern[:-1]}{{{rule.least},}}" if tight else rule.pattern
    none = F.array().cast(f"array<{SPAN}>")

    def placed(found: Column) -> Column:
        def structs(between: Column) -> Column:
            gaps = F.transform(F.slice(between, F.lit(1), F.size(found)), lambda p: F.length(p).cast("long"))
            sizes = F.transform(found, lambda m: F.length(m).cast("long"))
            return let(
                gaps,
                lambda g: let(
                    sizes,
                    lambda s: let(
                        F.zip_with(g, s, lambda a, b: a + b),
                        lambda both: let(
                            _before(both),
                            lambda at: F.transform(
                                s,
                                lambda size, i: F.struct(
                                    (F.get(at, i) + F.get(g, i)).alias("start"),
                                    F.lit(order).alias("kind"),
                                    (F.get(at, i) + F.get(g, i) + size).alias("stop"),
                                ),
                            ),
                        ),
                    ),
                ),
            )

        placed_all = let(F.split(text, pattern, -1), structs)
        if tight:
            return placed_all
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
        return let(
            values,
            lambda v: let(placed_all, lambda all_: F.filter(all_, lambda x, i: F.length(F.get(v, i)) >= rule.least)),
        )

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)),
    )


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class Ledger:
    """The two tables of a ledger below a folder of any store that Spark reaches."""

    VERSIONS, PAIRS = "path {id}, blob binary", f"blob binary, rule string, spans array<{SPAN}>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = at.getFileSystem(conf).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def versions(self, id_type: str = "long") -> DataFrame:
        """(path, blob): every version that a run has seen."""
        return self._table("versions", self.VERSIONS.format(id=id_type)).distinct()

    def pairs(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, rule, spans): what has been scanned by these versions of the rules; may repeat pairs."""
        return self._table("pairs", self.PAIRS).where(F.col("rule").isin([r.version for r in rules]))

    def add(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")


def scan(docs: DataFrame, versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The new rows of the ledger, written: (blob, rule, spans) for each pair that the ledger lacks.

    docs (doc_id, text); versions (path, blob) of the same rows.
    """
    seen = ledger.pairs(rules).groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # a row has as many as there are rules
    todo = (
        versions.groupBy("blob").agg(F.min("path").alias("rep"))
        .join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>"))).where(F.size("seen") < len(rules))
    )
    todo = written(todo.select(F.col("blob").alias("wanted"), "rep", "seen"), "unscanned")
    # a text of each blob: by doc_id and blob, as versions of a document share a doc_id and ids may be null
    texts = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("blob", blob(F.col("text")))
        .join(todo, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("blob") == F.col("wanted")))
    )
    none = F.lit(None).cast(f"array<{SPAN}>")
    found = F.array(
        *[
            F.struct(
                F.lit(r.version).alias("rule"),
                F.when(F.array_contains("seen", r.version), none).otherwise(spans(F.col("text"), r, k)).alias("spans"),
            )
            for k, r in enumerate(rules)
        ]
    )
    new = texts.select("blob", F.explode(found).alias("pair")).where("pair.spans is not null").select("blob", "pair.*")
    # rows that repeat a doc_id and a text repeat its pairs, with equal spans
    return written(new.groupBy("blob", "rule").agg(F.first("spans").alias("spans")), "ledger-rows")


def _findings(ledger: Ledger, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) of blobs with findings, ordered."""
    pairs = ledger.pairs(rules).where(F.size("spans") > 0)
    return pairs.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"))


def found_in(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(versions, findings): (path, blob) of every row, and (blob, spans) of blobs with findings, ordered.

    Versions and pairs that the ledger lacks are appended to it. Without a path, the ledger is
    a new one in the shared folder.
    """
    spark = docs.sparkSession
    ledger = Ledger(spark, ledger_path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    versions = written(docs.select(F.col("doc_id").alias("path"), blob(F.col("text")).alias("blob")), "versions")
    ledger.add("pairs", scan(docs, versions, ledger, rules))
    known, v, b = ledger.versions(versions.schema["path"].dataType.simpleString()), F.col("path"), F.col("blob")
    known = known.select(v.alias("p"), b.alias("k"))
    ledger.add("versions", versions.distinct().join(known, v.eqNullSafe(F.col("p")) & (b == F.col("k")), "left_anti"))
    return versions, _findings(ledger, rules)


def _digest(rules: tuple[Rule, ...]) -> list[Column]:
    """n_<kind> for each rule, and the list of spans as a string; both from a column spans."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    listed = F.array_join(
        F.transform("spans", lambda s: F.concat(F.get(kinds, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ","
    )

    def number(kind: int) -> Column:  # a default argument of a lambda would be taken for the index of its element
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return [*[number(k).alias(f"n_{r.kind}") for k, r in enumerate(rules)], listed.alias("spans")]


def history(spark: SparkSession, ledger_path: str, rules: tuple[Rule, ...] = RULES, id_type: str = "long") -> DataFrame:
    """(path, blob, n_<kind> for each rule, spans): every recorded version with findings, from the ledger alone."""
    ledger = Ledger(spark, ledger_path)
    return ledger.versions(id_type).join(_findings(ledger, rules), "blob").select("path", "blob", *_digest(rules))


def report(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_<kind> for each rule, base_sha256, spans) for each row of docs (doc_id, text)."""
    versions, findings = found_in(docs, ledger_path, rules)
    digests = findings.select("blob", *_digest(rules))
    joined = versions.join(digests, "blob", "left").withColumn("spans", F.coalesce("spans", F.lit("")))
    return joined.select(
        F.col("path").alias("doc_id"),
        *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in rules],
        F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


def redacted(docs: DataFrame, mark: str = "[REDACTED]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret in text replaced by the mark (overlapping spans by one), n_chars kept in step."""
    _, findings = found_in(docs, None, rules)
    # spans in order of start, joined where they overlap
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start: bigint, stop: bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] > s["start"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))),
    )
    cuts = findings.select("blob", merged.alias("cuts"))
    # the columns of docs travel as one struct, so their names meet no other
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", blob(F.col("text")).alias("blob")).join(cuts, "blob", "left")
    text = F.col("text")

    def rebuilt(cut: Column) -> Column:
        kept = F.transform(
            cut,
            lambda c, i: let(
                F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(cut, i - 1)["stop"]),
                lambda at: F.substring(text, (at + 1).cast("int"), (c["start"] - at).cast("int")),
            ),
        )
        last = F.element_at(cut, -1)["stop"]
        return F.concat(F.array_join(kept, mark), F.lit(mark), F.substring(text, (last + 1).cast("int"), F.length(text)))

    untouched = F.col("cuts").isNull()
    out = rows.select("row", untouched.alias("untouched"), F.when(untouched, text).otherwise(let(F.col("cuts"), rebuilt)).alias("new"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("new")
        old = F.col("row")[c]
        return F.when(F.col("untouched"), old).otherwise(F.length("new").cast("long")) if c == "n_chars" else old

    return out.select(*[column(c).alias(c) for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (
  SELECT doc_id, 'assign' AS kind, 0 AS o, 6 AS least,
    string_split_regex(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS p,
    regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
    regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g FROM d
  UNION ALL SELECT doc_id, 'access', 1, 20, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 'hex', 2, 24, string_split_regex(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}') FROM d),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
v AS (SELECT doc_id, kind, o, length(m[i]) AS size,
        list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start
      FROM u WHERE length(g[i]) >= least),
s AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
        string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, o) AS spans FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""

QUERIES = {"op3_secrets": op3}
ORACLES = {"op3_secrets": SQL}
