"""Inventories: rows (path, kind) with kind file or directory, and what changes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.names import under, valid_change_path
from pathloom.session import written


class CorrectionNeeded(RuntimeError):
    """A batch of changes can't be applied; the inventory must be listed anew."""


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, old_kind, new_kind) of paths that were added, removed or changed kind."""
    a, b = old.select("path", F.col("kind").alias("old_kind")), new.select("path", F.col("kind").alias("new_kind"))
    return a.join(b, "path", "full_outer").where(~F.col("old_kind").eqNullSafe(F.col("new_kind")))


def overlaid(base: DataFrame, overlay: DataFrame, key: str = "id") -> DataFrame:
    """base with the rows of overlay in place of its own; an overlay row without a path deletes."""
    return base.join(overlay.select(key), key, "left_anti").unionByName(overlay.where("path is not null"))


def removed(inventory: DataFrame, top: str) -> DataFrame:
    """inventory without a path and all below it."""
    return inventory.where(~under(F.col("path"), F.lit(top)))


def renamed(inventory: DataFrame, source: str, target: str) -> DataFrame:
    """inventory with a path and all below it moved; what the target held before goes."""
    if source == target:
        return inventory
    if f"{source}/".startswith(f"{target}/") or f"{target}/".startswith(f"{source}/"):
        raise ValueError("overlapping paths")
    kept = removed(inventory, target)
    moved = F.concat(F.lit(target), F.substring(F.col("path"), F.lit(len(source) + 1), F.length("path")))
    return kept.withColumn("path", F.when(under(F.col("path"), F.lit(source)), moved).otherwise(F.col("path")))


def net(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(the columns, n): rows whose numbers differ, n more in expected or, negative, in found.

    One shuffle of sums made before it, instead of a set difference each way.
    """
    columns = expected.columns
    both = expected.withColumn("n", F.lit(1)).unionByName(found.select(*columns).withColumn("n", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")


def differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(the columns, side): rows that only one of two tables has, as often as it has more of them."""
    each = net(expected, found).withColumn("side", F.when(F.col("n") > 0, "missing").otherwise("extra"))
    times = F.explode(F.array_repeat(F.lit(0), F.abs("n").cast("int")))
    return each.select(*expected.columns, "side", times).select(*expected.columns, "side")


def missing_ancestors(inventory: DataFrame) -> DataFrame:
    """(path): directories above some path that the inventory lacks."""
    parts = F.split("path", "/")
    above = inventory.where(F.contains("path", F.lit("/"))).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")
    )
    return above.distinct().join(inventory.where("kind = 'directory'").select("path"), "path", "left_anti")


def measures(inventory: DataFrame) -> DataFrame:
    """(entries, directories, deepest, path_bytes): what limits are set on; the root counts as a directory."""
    return inventory.agg(
        F.count("*").alias("entries"),
        (F.count_if(F.col("kind") == "directory") + 1).alias("directories"),
        F.coalesce(F.max(F.size(F.split("path", "/"))), F.lit(0)).alias("deepest"),
        F.coalesce(F.sum(F.octet_length("path")), F.lit(0)).cast("long").alias("path_bytes"),
    )


def within(inventory: DataFrame, entries: int = 4096, dirs: int = 128, depth: int = 16, path_bytes: int = 1 << 20) -> bool:
    """Whether an inventory keeps the limits of the bounded engine (files may be one deeper)."""
    m = measures(inventory).first()
    deep = inventory.where((F.col("kind") == "directory") & (F.size(F.split("path", "/")) > depth))
    return (
        m.entries <= entries and m.directories <= dirs and m.deepest <= depth + 1 and m.path_bytes <= path_bytes
        and not inventory.where(F.octet_length("path") > 4096).head(1) and not deep.head(1)
    )


def bad_changes(changes: DataFrame) -> DataFrame:
    """Rows of changes (seq, kind, path, source, target) with an unusable path; one spoils its batch."""
    rename = F.col("kind") == "rename"
    fine = F.when(rename, valid_change_path(F.col("source")) & valid_change_path(F.col("target"))).otherwise(valid_change_path(F.col("path")))
    return changes.where(~fine)


def dependent_renames(changes: DataFrame, inventory: DataFrame) -> DataFrame:
    """(seq): renames to a live directory whose source overlaps an earlier change.

    Such a batch must be corrected from a listing, not applied. Overlap is joined on
    equality: a path overlaps another if it equals it or one of its ancestors, so each
    path is exploded into its ancestors. Of all changes to a path only the first counts,
    so a directory with many changes and many renames makes no pairs of them.
    """
    touched = (
        changes.select(F.col("seq").alias("earlier"), F.explode(F.when(F.col("kind") == "rename", F.array("source", "target")).otherwise(F.array("path"))).alias("touched"))
        .groupBy("touched").agg(F.min("earlier").alias("earlier"))
    )
    renames = changes.where("kind = 'rename'").select("seq", "source", "target")

    def ancestors(df: DataFrame, column: str) -> DataFrame:
        parts = F.split(column, "/")
        return df.withColumn("at", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))

    at_or_above = ancestors(renames.select("source").distinct(), "source").join(touched.withColumnRenamed("touched", "at"), "at")
    below = ancestors(touched, "touched").groupBy(F.col("at").alias("source")).agg(F.min("earlier").alias("earlier"))
    first = at_or_above.select("source", "earlier").unionByName(below).groupBy("source").agg(F.min("earlier").alias("earlier"))
    overlapping = renames.join(first, "source").where("earlier < seq")
    live = inventory.where("kind = 'directory'").select(F.col("path").alias("target"))
    return overlapping.select("seq", "target").distinct().join(live, "target", "left_semi").select("seq")


def refreshed(inventory: DataFrame, listing: DataFrame, tops: DataFrame) -> DataFrame:
    """inventory with each path of tops (path), and all below, as the listing has it now."""
    def below(df: DataFrame) -> DataFrame:
        parts = F.split("path", "/")
        hit = (
            df.withColumn("at", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
            .join(tops.select(F.col("path").alias("at")).distinct(), "at", "left_semi")
        )
        return hit.select("path").distinct()

    return inventory.join(below(inventory), "path", "left_anti").unionByName(listing.join(below(listing), "path", "left_semi").select(*inventory.columns))


QUEUE = 256


def _tops(path: str) -> Column:
    """A path and all paths above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _effects(inventory: DataFrame, changes: DataFrame, listing: DataFrame) -> DataFrame:
    """(seq, top, fill, origin): what each change does to a path and all below it.

    All that was there goes; fill tells what comes: nothing, what the listing has, or what the
    inventory had below origin. A file that was renamed is there if the listing has it.
    """
    targets, sources = (x.select(F.col("path").alias(c), F.col("kind").alias(f"{c}_kind")) for x, c in ((listing, "target"), (inventory, "source")))
    plain = changes.where("kind <> 'rename'").select(
        "seq", F.col("path").alias("top"), F.when(F.col("kind") == "refresh", "listing").otherwise("nothing").alias("fill"), F.lit(None).cast("string").alias("origin")
    )
    renames = changes.where("kind = 'rename' and source <> target").select("seq", "source", "target").join(targets, "target", "left").join(sources, "source", "left")
    left = renames.select("seq", F.col("source").alias("top"), F.lit("nothing").alias("fill"), F.lit(None).cast("string").alias("origin"))
    # nothing before a rename to a directory touches its source, so the inventory has it as it is then
    moves = (F.col("target_kind") == "directory") & F.col("source_kind").isNotNull()
    came = renames.where(F.col("target_kind").isNotNull()).select(
        "seq", F.col("target").alias("top"), F.when(moves, "move").otherwise("listing").alias("fill"), F.when(moves, F.col("source")).alias("origin")
    )
    return plain.unionByName(left).unionByName(came)


def _kinds_at(asked: DataFrame, effects: DataFrame, inventory: DataFrame, listing: DataFrame) -> DataFrame:
    """asked (seq, path) with kind: what was there before the change seq, null for nothing."""
    every = asked.select("seq", "path", F.explode(_tops("path")).alias("top"))
    told = effects.select("seq", F.lit(None).cast("string").alias("path"), "top", F.struct("seq", "top", "fill", "origin").alias("effect"))
    marked = told.unionByName(every.withColumn("effect", F.lit(None).cast(told.schema["effect"].dataType)))
    before = Window.partitionBy("top").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    last = marked.withColumn("effect", F.last("effect", ignorenulls=True).over(before)).where(F.col("path").isNotNull() & F.col("effect").isNotNull())
    last = last.groupBy("seq", "path").agg(F.max_by("effect", "effect.seq").alias("effect"))
    place = F.when(F.col("effect.fill") == "move", F.concat("effect.origin", F.substring("path", F.length("effect.top") + 1, F.length("path")))).otherwise(F.col("path"))
    found = asked.select("seq", "path").distinct().join(last, ["seq", "path"], "left").withColumn("at", place)
    old, now = (x.select(F.col("path").alias("at"), F.col("kind").alias(n)) for x, n in ((inventory, "old_kind"), (listing, "new_kind")))
    fill = F.col("effect.fill")
    kind = F.when(fill.isNull() | (fill == "move"), F.col("old_kind")).when(fill == "listing", F.col("new_kind"))
    return found.join(old, "at", "left").join(now, "at", "left").select("seq", "path", kind.alias("kind"))


def applied(inventory: DataFrame, changes: DataFrame, listing: DataFrame, most: int | None = QUEUE) -> DataFrame:
    """inventory after an ordered batch of changes (seq, kind, path, source, target), at most so many.

    Refreshes and rename targets look at the listing, the state at the end of the batch. Inventories hold
    all directories above what they hold. Of all changes
    at or above a path the last one decides what is there, so a batch is a few joins, however long it is.
    CorrectionNeeded for unusable paths, dependent renames, or a rename that changes a kind or into itself.
    """
    changes = written(changes.select("seq", "kind", "path", "source", "target"), "changes")
    if most is not None and changes.count() > most:
        raise CorrectionNeeded("more changes than the queue holds")
    inside = F.col("source") != F.col("target")
    inside &= under(F.col("source"), F.col("target")) | under(F.col("target"), F.col("source"))
    if bad_changes(changes).head(1) or changes.where((F.col("kind") == "rename") & inside).head(1) or dependent_renames(changes, listing).head(1):
        raise CorrectionNeeded("unusable or dependent changes")
    effects = written(_effects(inventory, changes, listing), "effects")
    renames = changes.where("kind = 'rename' and source <> target").join(listing.select(F.col("path").alias("target"), F.col("kind").alias("target_kind")), "target")
    was = _kinds_at(renames.select("seq", F.col("source").alias("path")), effects, inventory, listing)
    if renames.select("seq", "target_kind").join(was, "seq").where("kind <> target_kind").head(1):
        raise CorrectionNeeded("a rename changes a kind")

    last = effects.groupBy("top").agg(F.max_by(F.struct("seq", "fill", "origin"), F.struct("seq", F.col("fill") != "nothing")).alias("e")).select("top", "e.*")

    def decided(rows: DataFrame) -> DataFrame:
        """rows (path, ...) with the last effect at or above each, null without one."""
        hit = rows.select("path").distinct().select("path", F.explode(_tops("path")).alias("top")).join(last, "top")
        return rows.join(hit.groupBy("path").agg(F.max_by(F.struct("seq", "top", "fill", "origin"), "seq").alias("e")), "path", "left")

    columns = inventory.columns
    kept = decided(inventory).where("e is null").select(*columns)
    fresh = decided(listing).where("e.fill = 'listing'").select(*columns)
    moves = last.where("fill = 'move'").select("seq", F.col("top").alias("to"), "origin")
    carried = inventory.select(*columns, F.explode(_tops("path")).alias("origin")).join(moves, "origin")
    moved = carried.withColumn("path", F.concat("to", F.substring("path", F.length("origin") + 1, F.length("path"))))
    moved = decided(moved).where("e.fill = 'move' and e.seq = seq").select(*columns)
    return kept.unionByName(fresh).unionByName(moved)
