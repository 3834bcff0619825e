"""Namespaces: entries (source, object, parent, name, attributes, slot) as a graph with paths.

An object may have several entries (hard links); an ordinary directory has one. The root
is no entry. Keys always include the source: equal ids of two sources are unrelated.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.names import DEPTH, PATH_UNITS, ROOT, is_directory, ordinary_directory, ordinary_object, valid_name
from pathloom.session import dropped, held, written

KEY = ["source", "object"]


def _doubled(steps: DataFrame, root: int, most: int) -> DataFrame:
    """steps (source, object, up, path, depth) climbed to the root, by doubling.

    Each round joins every open row with the row of the ancestor it has reached, so a
    depth of n takes log2(n) joins. Rows whose ancestor is missing fall out; rows on a
    cycle stay open past the last round and fall out then.
    """
    state = written(steps, "climb")
    for _ in range(math.ceil(math.log2(max(2, most))) + 1):
        climbing = F.col("up") != root
        if not state.where(climbing).head(1):
            break
        above = state.select("source", F.col("object").alias("up"), F.col("up").alias("top"), F.col("path").alias("head"), F.col("depth").alias("more"))
        climbed = (
            state.where(climbing).join(held(above), ["source", "up"])
            .select("source", "object", F.col("top").alias("up"), F.concat("head", F.lit("/"), "path").alias("path"), (F.col("depth") + F.col("more")).alias("depth"))
            .where(F.col("depth") <= most)
        )
        following = written(state.where(~climbing).unionByName(climbed), "climb")
        dropped(state)
        state = following
    return state.where(F.col("up") == root)


def directories(entries: DataFrame, root: int = ROOT, most: int = DEPTH) -> DataFrame:
    """(source, object, path, depth) of every directory that the root reaches, and of the root.

    path has slashes and starts with the source: the root's is `source/`.
    """
    own = entries.where(ordinary_directory(F.col("attributes"))).select(
        "source", "object", F.col("parent").alias("up"), F.col("name").alias("path"), F.lit(1).alias("depth")
    )
    reached = _doubled(own, root, most).select("source", "object", F.concat("source", F.lit("/"), "path").alias("path"), "depth")
    roots = entries.select("source").distinct().select(
        "source", F.lit(root).cast("long").alias("object"), F.concat("source", F.lit("/")).alias("path"), F.lit(0).alias("depth")
    )
    return reached.unionByName(roots)


def with_parent(entries: DataFrame, dirs: DataFrame, how: str = "inner") -> DataFrame:
    """entries with parent_path: each directory's path is made once, then joined to its entries."""
    found = dirs.select("source", F.col("object").alias("parent"), F.col("path").alias("parent_path"), F.col("depth").alias("parent_depth"))
    return entries.join(found, ["source", "parent"], how)


def full_path(parent: str = "parent_path", name: str = "name", depth: str = "parent_depth"):
    """The path of an entry: the root's path ends in a slash already."""
    return F.when(F.col(depth) == 0, F.concat(parent, name)).otherwise(F.concat(F.col(parent), F.lit("/"), F.col(name)))


def paths(entries: DataFrame, dirs: DataFrame | None = None, root: int = ROOT) -> DataFrame:
    """entries with path and is_directory; entries that the root doesn't reach fall out."""
    dirs = directories(entries, root) if dirs is None else dirs
    return with_parent(entries, held(dirs)).withColumn("path", full_path()).withColumn("is_directory", is_directory(F.col("attributes")))


def alias_parents(entries: DataFrame) -> DataFrame:
    """(source, object, parents): all parents of each object, sorted."""
    return entries.groupBy(*KEY).agg(F.sort_array(F.collect_set("parent")).alias("parents"))


def descendants(entries: DataFrame, tops: DataFrame, most: int = DEPTH) -> DataFrame:
    """(source, object, top, distance): directories at or below the directories of tops (source, object).

    top is the nearest one. Every directory climbs by doubling until it meets a top: a round
    joins each open row with the row of the ancestor it has reached, so a depth of n takes
    log2(n) joins, and an object has one row whatever the number of tops above it.
    """
    known = tops.select("source", "object").distinct()
    own = entries.where(ordinary_directory(F.col("attributes"))).select("source", "object", F.col("parent").alias("up")).distinct()
    state = written(
        own.join(known.select("source", F.col("object").alias("up"), F.lit(True).alias("at_up")), ["source", "up"], "left")
        .join(known, KEY, "left_anti")
        .select("source", "object", "up", F.when(F.col("at_up"), F.col("up")).alias("top"), F.lit(1).alias("distance")),
        "below",
    )
    for _ in range(math.ceil(math.log2(max(2, most))) + 1):
        going = state.where("top is null")
        if not going.head(1):
            break
        above = state.select("source", F.col("object").alias("up"), F.col("up").alias("next"), F.col("top").alias("its"), F.col("distance").alias("more"))
        climbed = (
            going.join(held(above), ["source", "up"]).select("source", "object", F.col("next").alias("up"), F.col("its").alias("top"), (F.col("distance") + F.col("more")).alias("distance"))
            .where(F.col("distance") <= most).distinct()
        )
        following = written(state.where("top is not null").unionByName(climbed), "below")
        dropped(state)
        state = following
    found = state.where("top is not null").groupBy(*KEY).agg(F.min_by(F.struct("top", "distance"), F.struct("distance", "top")).alias("at"))
    return known.select("source", "object", F.col("object").alias("top"), F.lit(0).alias("distance")).unionByName(found.select("source", "object", "at.*"))


def violations_at(entries: DataFrame, touched: DataFrame, root: int = ROOT, old: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """violations() where only the children of touched parents (source, parent) have changed since `old`, which had none.

    known: directories() of old. With it only directories that moved, and what lies below them, get their
    places anew; without it all do. Either way what a move pushes beyond a limit is found, however far below.
    """
    keys = ["source", "parent"]
    touched = touched.select(*keys).distinct()
    some = written(entries.join(touched, keys, "left_semi"), "touched")
    objects = some.where(ordinary_directory(F.col("attributes"))).select(*KEY).distinct()
    if known is None or old is None:
        dirs = written(directories(entries, root), "dirs")
        outside, long = written(entries.join(_parents(dirs), keys, "left_anti"), "outside"), long_paths(entries, dirs)
        if outside.head(1):  # of these, what a touched parent has or what is below one of its directories
            outside = outside.join(touched.unionByName(_parents(descendants(entries, objects))).distinct(), keys, "left_semi")
    else:
        form = ["source", "object", "parent", "name"]
        was = old.join(touched, keys, "left_semi").where(ordinary_directory(F.col("attributes"))).select(*form, F.lit(-1).alias("n"))
        now = some.where(ordinary_directory(F.col("attributes"))).select(*form, F.lit(1).alias("n"))
        turned = written(was.unionByName(now).groupBy(*form).agg(F.sum("n").alias("n")).where("n <> 0"), "turned")
        fresh, void = moved_directories(known, turned.where("n < 0"), turned.where("n > 0"))
        fresh, void = written(fresh, "fresh"), written(void, "void")
        lost = void.join(fresh, KEY, "left_anti")
        dirs = known.join(void, KEY, "left_anti").unionByName(fresh)
        outside = some.join(_parents(dirs), keys, "left_anti").unionByName(entries.join(_parents(lost), keys, "left_semi")).distinct()
        long = long_paths(some, dirs).unionByName(long_paths(entries, fresh)).distinct()
    return _counted(
        {
            "bad_row": bad_rows(some, root),
            "repeated_name": repeated_names(some),
            "directory_names": directories_with_names(entries.join(objects, KEY, "left_semi")),
            "unreachable": outside,
            "long_path": long,
        }
    )


def _parents(dirs: DataFrame) -> DataFrame:
    return dirs.select("source", F.col("object").alias("parent"))


def long_paths(entries: DataFrame, dirs: DataFrame, most: int = PATH_UNITS) -> DataFrame:
    """The entries below dirs whose path has more than `most` UTF-16 units.

    Names have at most 255 units, so only directories near the limit are joined, and there are hardly any.
    """
    near = dirs.where(F.octet_length("path") > most - 3 * 256)  # a unit has at most three bytes
    path = full_path()  # no text has more units than bytes
    return with_parent(entries, near).where((F.octet_length(path) > most) & (F.octet_length(F.encode(path, "UTF-16LE")) > 2 * most))


def _counted(checks: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("check"), "n") for k, df in checks.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def without_subtree(entries: DataFrame, top: int) -> DataFrame:
    """entries outside the subtree of an excluded directory (and without the directory)."""
    tops = entries.where(F.col("object") == top).select("source", "object").distinct()
    gone = descendants(entries, tops).select("source", F.col("object").alias("parent")).distinct()
    return entries.where(F.col("object") != top).join(gone, ["source", "parent"], "left_anti")


def pruned(entries: DataFrame, removed: DataFrame) -> DataFrame:
    """entries without the subtrees of removed directories; names elsewhere of objects inside stay."""
    gone = descendants(entries, removed).select("source", F.col("object").alias("parent")).distinct()
    own = removed.select("source", "object").distinct()
    return entries.join(gone, ["source", "parent"], "left_anti").join(own, KEY, "left_anti")


def reachable(entries: DataFrame, root: int = ROOT) -> DataFrame:
    """entries whose chain of parents ends at the root."""
    return entries.join(directories(entries, root).select("source", F.col("object").alias("parent")), ["source", "parent"], "left_semi")


def unreachable(entries: DataFrame, root: int = ROOT, most: int = DEPTH) -> DataFrame:
    """entries whose parent is missing, no ordinary directory, on a cycle or too deep."""
    return entries.join(directories(entries, root, most).select("source", F.col("object").alias("parent")), ["source", "parent"], "left_anti")


def moved_directories(known: DataFrame, removed: DataFrame, added: DataFrame, most: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(fresh, stale): new places (source, object, path, depth) at and below changed directories, and the (source, object) whose old place is void.

    known are directories() before; removed and added the rows (source, object, parent, name) of ordinary
    directories that went and came. What lies below is found by the ancestors of stored paths and keeps its
    path from the nearest changed directory on; only changed directories climb, by doubling, each from the
    changed directory above its new place to the next.
    """
    changed = written(removed.select(*KEY).unionByName(added.select(*KEY)).distinct(), "changed")
    tops = known.join(changed, KEY, "left_semi").select("source", F.col("path").alias("at"), F.col("object").alias("top"), F.col("depth").alias("top_depth"))
    lines = known.where("depth > 0").select(*KEY, "path", "depth", F.explode(above("path")).alias("at")).join(tops, ["source", "at"])
    nearest = lines.groupBy(*KEY, "path", "depth").agg(F.max_by(F.struct("top", "at", "top_depth"), "top_depth").alias("t"))
    rest = F.substring("path", F.length("t.at") + 1, F.length("path"))
    under = written(nearest.select(*KEY, "t.top", rest.alias("rest"), (F.col("depth") - F.col("t.top_depth")).alias("more")), "under")

    void = under.select(*KEY).unionByName(changed).distinct()
    named = F.concat(F.lit("/"), "name")
    at_parent = under.select("source", F.col("object").alias("parent"), F.col("top").alias("up"), "rest", "more")
    new_parent = changed.join(under, KEY, "left_anti").select("source", F.col("object").alias("parent"), F.col("object").alias("up"), F.lit("").alias("rest"), F.lit(0).alias("more"))
    climbing = added.join(at_parent.unionByName(new_parent), ["source", "parent"]).select(*KEY, "up", F.concat("rest", named).alias("path"), (F.col("more") + 1).alias("depth"))
    base = known.join(void, KEY, "left_anti").select("source", F.col("object").alias("parent"), F.col("path").alias("head"), F.col("depth").alias("deep"))
    whole = F.when(F.col("deep") == 0, F.concat("head", "name")).otherwise(F.concat("head", named))
    placed = added.join(base, ["source", "parent"]).select(*KEY, F.lit(None).cast("long").alias("up"), whole.alias("path"), (F.col("deep") + 1).alias("depth"))
    state = written(climbing.unionByName(placed), "climb")
    for _ in range(math.ceil(math.log2(max(2, most))) + 1):
        going = state.where("up is not null")
        if not going.head(1):
            break
        upper = state.select("source", F.col("object").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"), F.col("depth").alias("deep"))
        climbed = going.join(upper, ["source", "up"]).select(*KEY, F.col("next").alias("up"), F.concat("head", "path").alias("path"), (F.col("depth") + F.col("deep")).alias("depth"))
        following = written(state.where("up is null").unionByName(climbed.where(F.col("depth") <= most)), "climb")
        dropped(state)
        state = following
    moved = state.where(F.col("up").isNull() & (F.col("depth") <= most)).select(*KEY, "path", "depth")
    heads = moved.select("source", F.col("object").alias("top"), F.col("path").alias("head"), F.col("depth").alias("deep"))
    carried = under.join(changed, KEY, "left_anti").join(heads, ["source", "top"]).select(*KEY, F.concat("head", "rest").alias("path"), (F.col("deep") + F.col("more")).alias("depth"))
    return moved.unionByName(carried.where(F.col("depth") <= most)), void


def refreshed_directories(known: DataFrame, old: DataFrame, new: DataFrame, most: int = DEPTH) -> DataFrame:
    """The directories() of `new` from those of `old` (known): only what changed, and what lies below it, gets a new place."""
    form = ["source", "object", "parent", "name"]
    a, b = (x.where(ordinary_directory(F.col("attributes"))).select(*form, F.lit(n).alias("n")) for x, n in ((old, -1), (new, 1)))
    changed = written(a.unionByName(b).groupBy(*form).agg(F.sum("n").alias("n")).where("n <> 0"), "changed")
    if not changed.head(1):
        return known
    fresh, stale = moved_directories(known, changed.where("n < 0"), changed.where("n > 0"), most)
    return known.join(stale, KEY, "left_anti").unionByName(fresh)


def above(path: str):
    """The path itself and the paths of all directories above it; the root's ends in a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def refreshed_paths(old_paths: DataFrame, old: DataFrame, new: DataFrame, changed: DataFrame, root: int = ROOT, dirs: DataFrame | None = None) -> DataFrame:
    """The paths of `new`, made anew only at and below the changed directories (source, object).

    old_paths are the paths of `old`, dirs its directories if they are stored; the rest of the paths
    is kept as it is.
    """
    below = descendants(old, changed).unionByName(descendants(new, changed)).select("source", F.col("object").alias("parent")).distinct()
    below = held(written(below, "below"))
    kept = old_paths.join(below, ["source", "parent"], "left_anti")
    dirs = directories(new, root) if dirs is None else refreshed_directories(dirs, old, new)
    fresh = paths(new.join(below, ["source", "parent"], "left_semi"), dirs)
    return kept.unionByName(fresh.select(*old_paths.columns))


def repeated_names(entries: DataFrame) -> DataFrame:
    """(source, parent, name, n) of names that a directory has more than once."""
    return entries.groupBy("source", "parent", "name").agg(F.count("*").alias("n")).where("n > 1")


def directories_with_names(entries: DataFrame) -> DataFrame:
    """(source, object, n) of ordinary directories with more than one name."""
    return entries.where(ordinary_directory(F.col("attributes"))).groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def differing_attributes(entries: DataFrame) -> DataFrame:
    """(source, object, n) of objects whose names disagree on attributes."""
    return entries.groupBy(*KEY).agg(F.count_distinct("attributes").alias("n")).where("n > 1")


def bad_rows(entries: DataFrame, root: int = ROOT, strict: bool = False) -> DataFrame:
    """entries with an invalid name or identity; strict also rejects an object that is its own parent."""
    fine = valid_name(F.col("name")) & (F.col("object") != 0) & (F.col("parent") != 0) & (F.col("object") != root)
    if strict:
        fine &= F.col("object") != F.col("parent")
    return entries.where(~F.coalesce(fine, F.lit(False)))


def violations(entries: DataFrame, root: int = ROOT, strict: bool = False) -> DataFrame:
    """(check, n): how many rows or groups break each rule; a namespace may be published if none does."""
    dirs = written(directories(entries, root), "dirs")
    checks = {
        "bad_row": bad_rows(entries, root, strict),
        "repeated_name": repeated_names(entries),
        "directory_names": directories_with_names(entries),
        "unreachable": entries.join(_parents(dirs), ["source", "parent"], "left_anti"),
        "long_path": long_paths(entries, dirs),
    }
    if strict:
        checks["attributes"] = differing_attributes(entries)
    return _counted(checks)


def ordinary(entries: DataFrame, root: int = ROOT) -> DataFrame:
    """entries without the volume's own objects."""
    return entries.where(ordinary_object(F.col("object"), root) & ordinary_object(F.col("parent"), root))
