"""All queries of the engine over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import names
from pathloom.functions.names import path_key
from pathloom.functions.query import entry_predicate, parse
from pathloom.operators import index, inventory, journal, namespace, ranks
from pathloom.plans import search
from pathloom.plans.stored import SearchState
from pathloom.session import shared_dir, written
from pathloom.sources import fixtures, listing
from pathloom.sources.fixtures import DOC_PATHS, FLAT_PATHS, INV_NEW, INV_OLD, JOURNAL, JOURNAL_AFTER, NS_AFTER, NS_BROKEN, NS_ENTRIES, NS_LINKS, NS_NOW

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = fixtures.sql(oracle)
        return f

    return add


def tree(entries: str) -> str:
    """SQL of entries e, directories d (object, path, depth) and paths p (entry columns, path, parent_path)."""
    return f"""
WITH RECURSIVE e AS ({entries}),
d(object, path, depth) AS (
  SELECT CAST(5 AS BIGINT), 'd:/', 0
  UNION ALL
  SELECT e.object, CASE WHEN d.depth = 0 THEN d.path || e.name ELSE d.path || '/' || e.name END, d.depth + 1 FROM e JOIN d ON e.parent = d.object
  WHERE e.attributes & 1040 = 16 AND d.depth < 1024),
p AS (
  SELECT e.*, CASE WHEN d.depth = 0 THEN d.path || e.name ELSE d.path || '/' || e.name END AS path, lower(d.path) AS pf, lower(e.name) AS nf,
    e.attributes & 16 <> 0 AS is_directory, d.path AS parent_path
  FROM e JOIN d ON e.parent = d.object)
"""


NS = tree(NS_ENTRIES)
PAGE = "SELECT source, slot, object, path, name, is_directory FROM p WHERE "


def entries(spark, d) -> DataFrame:
    return fixtures.view(spark, d, NS_ENTRIES)


def flat(spark, d) -> DataFrame:
    return fixtures.view(spark, d, FLAT_PATHS)


def notes(spark, d) -> DataFrame:
    return fixtures.view(spark, d, JOURNAL)


_STATES: dict = {}


def stored(spark, d, name: str = "saved", make=None) -> SearchState:
    """A search state, made once in a session for tables that stay the same (known by their files, sizes and times): of the entries, or as make() does."""
    files = []
    for t in ("region", "nation", "customer", "orders"):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{t}.parquet")
        s = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
        files.append((at.toString(), s.getLen(), s.getModificationTime()))
    key = name, spark.sparkContext.applicationId, tuple(files)
    if key not in _STATES:
        state = new_state(spark) if make is None else make(spark, d)
        if make is None:
            state.save(entries(spark, d), 1)
        _STATES[key] = state
    return _STATES[key]


def new_state(spark, **limits) -> SearchState:
    """A search state in a folder of its own."""
    return SearchState(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}", **limits)


# paths


@query("path_resolve", NS + "SELECT source, object, parent, name, path, is_directory FROM p")
def path_resolve(spark, d):
    return namespace.paths(entries(spark, d)).select("source", "object", "parent", "name", "path", "is_directory")


@query("hardlink_paths", tree(NS_LINKS) + "SELECT object, path FROM p")
def hardlink_paths(spark, d):
    return namespace.paths(fixtures.view(spark, d, NS_LINKS)).select("object", "path")


@query("alias_parents", f"SELECT source, object, list_sort(list(DISTINCT parent)) AS parents FROM ({NS_LINKS}) GROUP BY source, object")
def alias_parents(spark, d):
    return namespace.alias_parents(fixtures.view(spark, d, NS_LINKS))


@query("directory_depths", NS + "SELECT depth, count(*) AS n, max(length(path)) AS longest FROM d GROUP BY depth")
def directory_depths(spark, d):
    return namespace.directories(entries(spark, d)).groupBy("depth").agg(F.count("*").alias("n"), F.max(F.length("path")).cast("long").alias("longest"))


# searches over a namespace (dialect B)


def found(name: str, raw: str, where: str, kind: str = "all"):
    @query(name, NS + PAGE + where)
    def run(spark, d):
        return stored(spark, d).matches(raw, kind)


def has(word: str) -> str:
    joined = f" OR contains(pf || '/' || nf, '{word}')" if "/" in word else ""
    return f"(contains(nf, '{word}') OR contains(pf, '{word}'){joined})"


found("search_and_tokens", "asia customer ext:pdf", f"{has('asia')} AND {has('customer')} AND nf LIKE '%.pdf'")
found("search_ext", "ext:PDF ext:docx", "nf LIKE '%.docx'")
found("search_path_token", "nation_12/customer#00000", has("nation_12/customer#00000"))
found("search_backslash", r"ASIA\NATION_1 12", f"{has('asia/nation_1')} AND {has('12')}")
found("search_empty", " 　 ", "TRUE")
found("search_absent", "no such name anywhere", f"{has('no')} AND {has('such')} AND {has('name')} AND {has('anywhere')}")
found("search_category_images", "9", f"NOT is_directory AND nf LIKE '%.png' AND {has('9')}", "images")
found("search_category_documents", "europe", f"NOT is_directory AND (nf LIKE '%.pdf' OR nf LIKE '%.docx') AND {has('europe')}", "documents")
found("search_category_archives", "", "NOT is_directory AND (nf LIKE '%.zip' OR nf LIKE '%.gz')", "archives")
found("search_category_folders", "america", f"is_directory AND {has('america')}", "folders")
found("search_category_files", "customer#000000001", f"NOT is_directory AND {has('customer#000000001')}", "files")
found("root_double_slash", "d://as", has("d://as"))
found("root_single_slash", "d:/asia", has("d:/asia"))


@query("slot_page_lower_bound", NS + f", m AS (SELECT * FROM p WHERE {has('asia')} ORDER BY slot LIMIT 26) SELECT slot, path, count(*) OVER () AS total, FALSE AS total_exact FROM (SELECT *, row_number() OVER (ORDER BY slot) AS i FROM m) QUALIFY i <= 25")
def slot_page_lower_bound(spark, d):
    found_page = stored(spark, d).page("asia", 25)
    return found_page.rows.select("slot", "path", F.lit(found_page.total).cast("long").alias("total"), F.lit(found_page.exact).alias("total_exact"))


@query("limit_zero", NS + f"SELECT CAST(least(count(*), 1) AS BIGINT) AS total, count(*) = 0 AS total_exact FROM p WHERE {has('asia')}")
def limit_zero(spark, d):
    p = stored(spark, d).page("asia", 0)
    return spark.createDataFrame([(p.total, p.exact)], "total long, total_exact boolean")


@query("multi_source_merge", tree(NS_ENTRIES) + f""", q AS (SELECT source, slot, path FROM p WHERE {has('00001')} ORDER BY slot LIMIT 40),
r AS (SELECT 'e:' AS source, slot, 'e:' || substr(path, 3) AS path FROM p WHERE {has('00001')} ORDER BY slot LIMIT 40)
SELECT * FROM (SELECT * FROM q UNION ALL SELECT * FROM r) ORDER BY lower(path), source, slot LIMIT 50""")
def multi_source_merge(spark, d):
    one = stored(spark, d).view().located()
    two = one.withColumn("source", F.lit("e:")).withColumn("parent_path", F.concat(F.lit("e:"), F.expr("substr(parent_path, 3)")))
    return search.merged([search.page(x, "00001", 40) for x in (one, two)], 50).rows.select("source", "slot", "path")


@query("records_per_source", f"SELECT source, count(*) AS records, count(*) FILTER (attributes & 16 <> 0) AS directories FROM (SELECT * FROM ({NS_ENTRIES}) AS a UNION ALL SELECT 'e:', object, parent, name, attributes, slot FROM ({NS_LINKS}) AS b) AS c GROUP BY source")
def records_per_source(spark, d):
    both = entries(spark, d).unionByName(fixtures.view(spark, d, NS_LINKS).withColumn("source", F.lit("e:")))
    return both.groupBy("source").agg(F.count("*").alias("records"), F.count_if(names.is_directory(F.col("attributes"))).alias("directories"))


# searches over whole paths (dialects A and C)

FLAT = f"WITH f AS (SELECT id, path, lower(CASE WHEN contains(path, '/') THEN path ELSE '/' || path END) AS low FROM ({FLAT_PATHS}) AS a)"
DOCS = f"WITH f AS (SELECT id, path FROM ({DOC_PATHS}) AS a)"


@query("search_flat", FLAT + "SELECT id, path FROM f WHERE contains(low, 'e') AND contains(low, '/en') AND low LIKE '%.html'")
def search_flat(spark, d):
    return search.path_matches(flat(spark, d), "E /EN ext:html")


@query("search_literal_case", FLAT + "SELECT id, path FROM f WHERE contains(path, '.com/')")
def search_literal_case(spark, d):
    return search.path_matches(flat(spark, d), ".com/", "C")


@query("topk_component_order", DOCS + "SELECT id, path FROM f WHERE contains(path, 'src1') ORDER BY string_split(path, '/') LIMIT 50")
def topk_component_order(spark, d):
    return search.first_in_order(fixtures.view(spark, d, DOC_PATHS), "src1").select("id", "path")


@query("match_checksum", DOCS + "SELECT count(*) AS matches, CAST(sum(id + 1) AS BIGINT) AS checksum, TRUE AS complete FROM f WHERE contains(path, 'src2')")
def match_checksum(spark, d):
    return search.summary(fixtures.view(spark, d, DOC_PATHS), "src2")


@query("first50_vs_complete", DOCS + """SELECT 'first50' AS mode, count(*) AS matches, CAST(sum(id + 1) AS BIGINT) AS checksum, count(*) < 50 AS complete FROM (SELECT * FROM f WHERE contains(path, 'en/') ORDER BY id LIMIT 50)
UNION ALL SELECT 'complete', count(*), CAST(sum(id + 1) AS BIGINT), TRUE FROM f WHERE contains(path, 'en/')""")
def first50_vs_complete(spark, d):
    rows = fixtures.view(spark, d, DOC_PATHS)
    first, whole = search.summary(rows, "en/", 50), search.summary(rows, "en/")
    return first.withColumn("mode", F.lit("first50")).unionByName(whole.withColumn("mode", F.lit("complete")))


@query("keyset_page_2", DOCS + """SELECT * FROM (SELECT CAST(CAST('0x' || substr(md5(path), 1, 8) AS BIGINT) % 64 AS INTEGER) AS shard, path, id FROM f WHERE contains(path, 'doc')) ORDER BY shard, path, id LIMIT 100 OFFSET 100""")
def keyset_page_2(spark, d):
    rows = fixtures.view(spark, d, DOC_PATHS)
    return search.next_page(rows, "doc", search.cursor_of(search.next_page(rows, "doc", None, 100), "doc"), 100)


@query("keyset_pages_by_path", DOCS + "SELECT path, id FROM f WHERE contains(path, 'doc') ORDER BY path, id LIMIT 100 OFFSET 100")
def keyset_pages_by_path(spark, d):
    rows = fixtures.view(spark, d, DOC_PATHS)
    after = search.cursor_of(search.next_page(rows, "doc", None, 100, shards=1), "doc")
    return search.next_page(rows, "doc", after, 100, shards=1).select("path", "id")


# rules of a namespace

BROKEN = f"WITH e AS ({NS_BROKEN})"


def broken(spark, d) -> DataFrame:
    return fixtures.view(spark, d, NS_BROKEN)


@query("validate_dup_parent_name", BROKEN + "SELECT source, parent, name, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 1")
def validate_dup_parent_name(spark, d):
    return namespace.repeated_names(broken(spark, d))


@query("validate_multi_dir", BROKEN + "SELECT source, object, count(*) AS n FROM e WHERE attributes & 1040 = 16 GROUP BY ALL HAVING count(*) > 1")
def validate_multi_dir(spark, d):
    return namespace.directories_with_names(broken(spark, d))


@query("validate_orphans", tree(NS_BROKEN) + "SELECT source, object, parent, name FROM e WHERE parent NOT IN (SELECT object FROM d)")
def validate_orphans(spark, d):
    return namespace.unreachable(broken(spark, d)).select("source", "object", "parent", "name")


@query("reachable_entries", tree(NS_BROKEN) + "SELECT source, object, parent, name FROM e WHERE parent IN (SELECT object FROM d)")
def reachable_entries(spark, d):
    return namespace.reachable(broken(spark, d)).select("source", "object", "parent", "name")


@query("validate_attr_conflict", BROKEN + "SELECT source, object, count(DISTINCT attributes) AS n FROM e GROUP BY ALL HAVING count(DISTINCT attributes) > 1")
def validate_attr_conflict(spark, d):
    return namespace.differing_attributes(broken(spark, d))


@query("validate_rows", BROKEN + """SELECT source, object, name FROM (SELECT source, object, parent, CASE object % 97 WHEN 1 THEN '' WHEN 2 THEN '..' WHEN 3 THEN name || ':x' WHEN 4 THEN repeat('é', 256) ELSE name END AS name FROM e)
WHERE length(name) NOT BETWEEN 1 AND 255 OR name IN ('.', '..') OR contains(name, ':') OR object = 0 OR parent = 0 OR object = 5""")
def validate_rows(spark, d):
    k = F.col("object") % 97
    odd = F.when(k == 1, "").when(k == 2, "..").when(k == 3, F.concat("name", F.lit(":x"))).when(k == 4, F.repeat(F.lit("é"), 256)).otherwise(F.col("name"))
    return namespace.bad_rows(broken(spark, d).withColumn("name", odd)).select("source", "object", "name")


@query("internal_filter", f"SELECT object & 31 AS object, count(*) AS n FROM (SELECT object & 31 AS object, 5 AS parent FROM ({NS_ENTRIES}) AS a) AS b WHERE object >= 24 OR object = 5 GROUP BY ALL")
def internal_filter(spark, d):
    low = entries(spark, d).withColumn("object", F.col("object").bitwiseAND(F.lit(31))).withColumn("parent", F.lit(5))
    return namespace.ordinary(low).groupBy("object").agg(F.count("*").alias("n"))


BELOW = "b(object) AS (SELECT CAST({top} AS BIGINT) UNION SELECT e.object FROM e JOIN b ON e.parent = b.object WHERE e.attributes & 1040 = 16)"


@query("exclude_subtree", f"WITH RECURSIVE e AS ({NS_ENTRIES}), {BELOW.format(top=1002)} SELECT source, object, parent, name FROM e WHERE object <> 1002 AND parent NOT IN (SELECT object FROM b)")
def exclude_subtree(spark, d):
    return namespace.without_subtree(entries(spark, d), 1002).select("source", "object", "parent", "name")


@query("subtree_distances", f"WITH RECURSIVE e AS ({NS_ENTRIES}), b(object, distance) AS (SELECT CAST(1002 AS BIGINT), 0 UNION ALL SELECT e.object, b.distance + 1 FROM e JOIN b ON e.parent = b.object WHERE e.attributes & 1040 = 16) SELECT object, distance FROM b")
def subtree_distances(spark, d):
    tops = spark.createDataFrame([("d:", 1002)], "source string, object long")
    return namespace.descendants(entries(spark, d), tops).select("object", "distance")


@query("prune_removed", f"WITH RECURSIVE e AS ({NS_ENTRIES}), r AS (SELECT object FROM e WHERE object BETWEEN 2001 AND 2004), b(object) AS (SELECT object FROM r UNION SELECT e.object FROM e JOIN b ON e.parent = b.object WHERE e.attributes & 1040 = 16) SELECT object, parent, name FROM e WHERE parent NOT IN (SELECT object FROM b) AND object NOT IN (SELECT object FROM r)")
def prune_removed(spark, d):
    all_ = entries(spark, d)
    return namespace.pruned(all_, all_.where("object between 2001 and 2004")).select("object", "parent", "name")


@query("scoped_semi_join", f"WITH e AS ({NS_ENTRIES}) SELECT source, object, parent, name FROM e WHERE parent IN (SELECT object FROM e WHERE object % 10 = 3 AND object < 10000000) OR object IN (SELECT object FROM e WHERE object % 10 = 3 AND object < 10000000)")
def scoped_semi_join(spark, d):
    all_ = entries(spark, d)
    return listing.projected(all_, all_.where("object % 10 = 3 and object < 10000000"), objects=True).select("source", "object", "parent", "name")


# journals and maintenance

J = f"j AS ({JOURNAL})"
TOLD = "t AS (SELECT * FROM j)"


@query("replay_window", f"WITH {J} SELECT source, usn, object, parent, reason, name FROM j WHERE usn >= 100 AND usn < 400")
def replay_window(spark, d):
    return journal.replay(notes(spark, d), 100, 400).select("source", "usn", "object", "parent", "reason", "name")


@query("journal_bounds", f"WITH {J} SELECT source, min(usn) AS first, max(usn) + 1 AS next, count(*) AS n FROM j GROUP BY source")
def journal_bounds(spark, d):
    return journal.bounds(notes(spark, d))


@query("retained_cursor", f"WITH {J}, b AS (SELECT min(usn) + 10 AS first, max(usn) + 1 AS next FROM j) SELECT usn, usn % 2 = 0 AND usn >= first AND usn <= next AS kept FROM j, b")
def retained_cursor(spark, d):
    all_ = notes(spark, d)
    b = all_.agg(F.min("usn").alias("first"), F.max("usn").alias("last")).first()
    probes = all_.select("usn", F.lit(0).alias("journal"), (F.col("usn") % 2).cast("int").alias("asked"))
    kept = names.retained("journal", F.lit(b["first"] + 10), F.lit(b["first"]), F.lit(b["last"] + 1), "asked", F.col("usn"))
    return probes.select("usn", kept.alias("kept"))


@query("reason_mask_or", f"WITH {J} SELECT source, count(*) AS records, count(*) FILTER (reason & 256 <> 0) AS creations, count(*) FILTER (reason & 512 <> 0) AS deletions, bit_or(reason) AS reasons FROM j GROUP BY source")
def reason_mask_or(spark, d):
    return journal.statistics(notes(spark, d))


@query("latest_dir_record", f"WITH {J} SELECT source, object, usn, parent, name, attributes FROM j WHERE attributes & 1040 = 16 AND reason & 8448 <> 0 QUALIFY row_number() OVER (PARTITION BY source, object ORDER BY usn DESC) = 1")
def latest_dir_record(spark, d):
    return journal.latest_directories(notes(spark, d))


@query("dirty_parents", f"WITH e AS ({NS_ENTRIES}), {J}, {TOLD} SELECT DISTINCT source, parent FROM t UNION SELECT DISTINCT e.source, e.parent FROM e JOIN t ON e.object = t.object")
def dirty_parents(spark, d):
    return journal.dirty_parents(entries(spark, d), notes(spark, d))


DIRTY = f"WITH e AS ({NS_ENTRIES}), l AS ({NS_NOW}), {J}, {TOLD}, dirty AS (SELECT DISTINCT parent FROM t UNION SELECT DISTINCT e.parent FROM e JOIN t ON e.object = t.object)"


@query("replace_children", DIRTY + "SELECT source, object, parent, name FROM e WHERE parent NOT IN (SELECT parent FROM dirty) UNION ALL SELECT source, object, parent, name FROM l WHERE parent IN (SELECT parent FROM dirty)")
def replace_children(spark, d):
    old, now = entries(spark, d), fixtures.view(spark, d, NS_NOW)
    return journal.replaced(old, journal.dirty_parents(old, notes(spark, d)), now).select("source", "object", "parent", "name")


CHANGED = ", a AS (SELECT source, parent, name, object, attributes FROM e WHERE parent IN (SELECT parent FROM dirty)), b AS (SELECT source, parent, name, object, attributes FROM l WHERE parent IN (SELECT parent FROM dirty)), c AS (SELECT source, parent FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION SELECT source, parent FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))"


@query("unchanged_parents", DIRTY + CHANGED + "SELECT 'd:' AS source, parent FROM dirty WHERE parent NOT IN (SELECT parent FROM c WHERE parent % 3 <> 0)")
def unchanged_parents(spark, d):
    old, now = entries(spark, d), fixtures.view(spark, d, NS_NOW)
    dirty = written(journal.dirty_parents(old, notes(spark, d)), "dirty")
    return dirty.join(journal.changed_parents(old, now, dirty).where("parent % 3 <> 0"), ["source", "parent"], "left_anti")


@query("discover_closure", f"WITH RECURSIVE l AS ({NS_ENTRIES}), b(object) AS (SELECT object FROM l WHERE object IN (1001, 2010) UNION SELECT l.object FROM l JOIN b ON l.parent = b.object WHERE l.attributes & 1040 = 16) SELECT object, parent, name FROM l WHERE parent IN (SELECT object FROM b)")
def discover_closure(spark, d):
    all_ = entries(spark, d)
    starts = all_.where("object in (1001, 2010)").select("source", "object")
    return journal.discovered(all_, all_.limit(0).select("source", "object"), starts).select("object", "parent", "name")


#: A namespace after a journal, from the listing: children of dirty parents and of directories new to it as listed, the rest as it was, and of that what the root reaches.
AFTER = f"""WITH RECURSIVE e AS ({NS_ENTRIES}), l AS ({NS_AFTER}), t AS ({JOURNAL_AFTER}),
dirty AS (SELECT DISTINCT parent FROM t UNION SELECT DISTINCT e.parent FROM e JOIN t ON e.object = t.object),
fresh(object) AS (SELECT object FROM l WHERE attributes & 1040 = 16 AND parent IN (SELECT parent FROM dirty) AND object NOT IN (SELECT object FROM e WHERE attributes & 1040 = 16)
  UNION SELECT l.object FROM l JOIN fresh ON l.parent = fresh.object WHERE l.attributes & 1040 = 16),
listed AS (SELECT parent FROM dirty UNION SELECT object FROM fresh),
c AS (SELECT * FROM e WHERE parent NOT IN (SELECT parent FROM listed) UNION ALL SELECT * FROM l WHERE parent IN (SELECT parent FROM listed)),
r(object) AS (SELECT CAST(5 AS BIGINT) UNION SELECT c.object FROM c JOIN r ON c.parent = r.object WHERE c.attributes & 1040 = 16)
SELECT source, object, parent, name, attributes FROM c WHERE parent IN (SELECT object FROM r)"""


def after_tables(spark, d) -> list[DataFrame]:
    """A namespace, its listing and its journal, as tables in files, which they are where they come from."""
    return [written(fixtures.view(spark, d, text), name) for name, text in (("old", NS_ENTRIES), ("listing", NS_AFTER), ("journal", JOURNAL_AFTER))]


@query("apply_journal", AFTER)
def apply_journal(spark, d):
    """Directories made, moved, moved into a made one, and deleted with all below; files told and untold."""
    old, now, told = after_tables(spark, d)
    return journal.applied(old, told, now).select("source", "object", "parent", "name", "attributes")


@query("apply_journal_small", AFTER.replace(JOURNAL_AFTER, f"SELECT * FROM ({JOURNAL_AFTER}) AS few WHERE usn < 8"))
def apply_journal_small(spark, d):
    """The seven records of directories alone, beside apply_journal: time against the number of records at one inventory."""
    old, now, told = after_tables(spark, d)
    return journal.applied(old, told.where("usn < 8"), now).select("source", "object", "parent", "name", "attributes")


@query("expected_actions", f"WITH {J}, x AS (SELECT object, parent, name, CASE WHEN usn % 3 = 0 THEN reason ELSE reason | 1 END AS mask FROM j) SELECT x.*, EXISTS (SELECT 1 FROM j WHERE j.object = x.object AND j.parent = x.parent AND j.name = x.name AND j.reason & x.mask = x.mask) AS seen FROM x")
def expected_actions(spark, d):
    all_ = notes(spark, d)
    mask = F.when(F.col("usn") % 3 == 0, F.col("reason")).otherwise(F.col("reason").bitwiseOR(F.lit(1)))
    return journal.expected_actions(all_, all_.select("object", "parent", "name", mask.alias("mask")))


@query("link_changes", f"WITH e AS ({NS_LINKS}) SELECT DISTINCT source, parent FROM e WHERE object IN (SELECT 4000000 + user_id FROM events WHERE event_type = 'purchase')")
def link_changes(spark, d):
    told_ = notes(spark, d).select(
        "source", (F.col("object") + 3000000).alias("object"), F.when(F.col("reason") == 8192, 65536).otherwise(0).cast("long").alias("reason")
    )
    return journal.link_changes(told_, fixtures.view(spark, d, NS_LINKS))


NOTICES = f"""n AS (SELECT 'u' || CAST(user_id % 10 AS STRING) AS source, event_id AS seq, CAST(event_id * 37 % 1000 + event_id * 60 AS BIGINT) AS at_ms,
  CASE event_type WHEN 'click' THEN 'old' WHEN 'purchase' THEN 'new' WHEN 'error' THEN 'removed' ELSE 'modified' END AS action, 'p_' || CAST(event_id AS STRING) AS path FROM {{events}})"""


PAIRS = f"WITH {NOTICES}, w AS (SELECT *, lead(action) OVER o AS na, lag(action) OVER o AS pa, lead(at_ms) OVER o - at_ms AS gap, at_ms - lag(at_ms) OVER o AS back, lag(path) OVER o AS pp FROM n WINDOW o AS (PARTITION BY source ORDER BY seq))" + """
SELECT source, seq, CASE WHEN action = 'new' AND coalesce(pa = 'old' AND back < 1500, FALSE) THEN 'rename' WHEN action = 'removed' THEN 'remove' WHEN action IN ('old', 'new') THEN 'loss' ELSE 'refresh' END AS kind, path,
  CASE WHEN action = 'new' AND coalesce(pa = 'old' AND back < 1500, FALSE) THEN pp END AS source_path,
  action IN ('old', 'new') AND NOT (action = 'new' AND coalesce(pa = 'old' AND back < 1500, FALSE)) AS loss
FROM w WHERE NOT (action = 'old' AND coalesce(na = 'new' AND gap < 1500, FALSE))"""


@query("rename_pairs", PAIRS)
def rename_pairs(spark, d):
    notices = fixtures.view(spark, d, f"WITH {NOTICES} SELECT * FROM n")
    return journal.rename_pairs(notices, 1500)


@query("undo_first_value", "SELECT user_id AS key, arg_min(event_type, event_id) AS old FROM events GROUP BY user_id")
def undo_first_value(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return journal.first_values(events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("old")))


@query("adjacent_duplicates", f"WITH e AS ({NS_BROKEN}) SELECT source, parent, name, object FROM e QUALIFY lag(name) OVER (PARTITION BY source, parent ORDER BY name, object) = name")
def adjacent_duplicates(spark, d):
    return ranks.adjacent_repeats(broken(spark, d), ["source", "parent"], "name", ["object"]).select("source", "parent", "name", "object")


# inventories


def old_inventory(spark, d) -> DataFrame:
    return fixtures.view(spark, d, INV_OLD)


INV = f"WITH a AS ({INV_OLD}), b AS ({INV_NEW})"


@query("inventory_diff", INV + "SELECT coalesce(a.path, b.path) AS path, a.kind AS old_kind, b.kind AS new_kind FROM a FULL JOIN b ON a.path = b.path WHERE a.kind IS DISTINCT FROM b.kind")
def inventory_diff(spark, d):
    return inventory.diff(old_inventory(spark, d), fixtures.view(spark, d, INV_NEW))


@query("changed_path_count", INV + "SELECT count(*) AS changed FROM a FULL JOIN b ON a.path = b.path WHERE a.kind IS DISTINCT FROM b.kind")
def changed_path_count(spark, d):
    return inventory.diff(old_inventory(spark, d), fixtures.view(spark, d, INV_NEW)).agg(F.count("*").alias("changed"))


@query("missing_extra", INV + "SELECT path, kind, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT path, kind, 'extra' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def missing_extra(spark, d):
    return inventory.differences(old_inventory(spark, d), fixtures.view(spark, d, INV_NEW))


@query("overlay_merge", DOCS + ", o AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE path || '.new' END AS path FROM f WHERE id % 3 = 0) SELECT id, path FROM f WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT id, path FROM o WHERE path IS NOT NULL")
def overlay_merge(spark, d):
    base = fixtures.view(spark, d, DOC_PATHS)
    overlay = base.where("id % 3 = 0").select("id", F.when(F.col("id") % 4 != 0, F.concat("path", F.lit(".new"))).alias("path"))
    return inventory.overlaid(base, overlay)


@query("prefix_remove", f"WITH a AS ({INV_OLD}) SELECT path, kind FROM a WHERE path <> 'en/src3' AND NOT starts_with(path, 'en/src3/')")
def prefix_remove(spark, d):
    return inventory.removed(old_inventory(spark, d), "en/src3")


@query("prefix_rename", f"WITH a AS ({INV_OLD}) SELECT CASE WHEN starts_with(path, 'en/src3/') THEN 'fr/src4' || substr(path, 8) ELSE path END AS path, kind FROM a WHERE NOT starts_with(path, 'fr/src4/')")
def prefix_rename(spark, d):
    return inventory.renamed(old_inventory(spark, d), "en/src3", "fr/src4")


@query("ancestor_presence", f"WITH f AS (SELECT path FROM ({DOC_PATHS}) AS a WHERE path IS NOT NULL) SELECT DISTINCT p AS path FROM (SELECT unnest([string_split(path, '/')[1], string_split(path, '/')[1] || '/' || string_split(path, '/')[2]]) AS p FROM f)")
def ancestor_presence(spark, d):
    return inventory.missing_ancestors(fixtures.view(spark, d, DOC_PATHS).select("path", F.lit("file").alias("kind")))


@query("directory_count", f"WITH a AS ({INV_OLD}) SELECT count(*) AS entries, count(*) FILTER (kind = 'directory') + 1 AS directories, CAST(max(len(string_split(path, '/'))) AS INTEGER) AS deepest, CAST(sum(strlen(path)) AS BIGINT) AS path_bytes FROM a")
def directory_count(spark, d):
    return inventory.measures(old_inventory(spark, d))


CHANGES = f"""c AS (SELECT id AS seq, CASE id % 3 WHEN 0 THEN 'rename' WHEN 1 THEN 'refresh' ELSE 'remove' END AS kind, CASE WHEN id % 3 <> 0 THEN path END AS path,
  CASE WHEN id % 3 = 0 THEN lang_dir END AS source, CASE WHEN id % 3 = 0 THEN 'moved/d' || CAST(id % 8 AS STRING) END AS target
  FROM (SELECT doc_id AS id, lang || '/' || source || '/doc_' || CAST(doc_id AS STRING) AS path, lang || '/' || source AS lang_dir FROM {{documents}} WHERE lang IS NOT NULL AND source IS NOT NULL) AS x)"""


@query("dependent_rename", f"WITH {CHANGES}, t AS (SELECT seq, unnest(CASE WHEN kind = 'rename' THEN [source, target] ELSE [path] END) AS p FROM c) SELECT DISTINCT c.seq FROM c JOIN t ON t.seq < c.seq AND (t.p = c.source OR starts_with(t.p, c.source || '/') OR starts_with(c.source, t.p || '/')) WHERE c.kind = 'rename' AND c.target IN ('moved/d0', 'moved/d3', 'moved/d5')")
def dependent_rename(spark, d):
    changes = fixtures.view(spark, d, f"WITH {CHANGES} SELECT * FROM c")
    live = spark.createDataFrame([("moved/d0", "directory"), ("moved/d3", "directory"), ("moved/d5", "directory"), ("moved/d1", "file")], "path string, kind string")
    return inventory.dependent_renames(changes, live)


@query("unsafe_changes", f"WITH {CHANGES}, x AS (SELECT seq, kind, CASE seq % 7 WHEN 1 THEN '/' || path WHEN 2 THEN path || '/..' WHEN 3 THEN path || ':s' ELSE path END AS path, source, target FROM c) SELECT seq, kind FROM x WHERE kind <> 'rename' AND seq % 7 IN (1, 2, 3)")
def unsafe_changes(spark, d):
    k = F.col("seq") % 7
    odd = F.when(k == 1, F.concat(F.lit("/"), "path")).when(k == 2, F.concat("path", F.lit("/.."))).when(k == 3, F.concat("path", F.lit(":s"))).otherwise(F.col("path"))
    changes = fixtures.view(spark, d, f"WITH {CHANGES} SELECT * FROM c").withColumn("path", odd)
    return inventory.bad_changes(changes).select("seq", "kind")


# the index

GRAMS = FLAT + ", g AS (SELECT DISTINCT id // 64 AS block, unnest(list_transform(range(1, length(low) - 1), lambda i: substr(low, i, 3))) AS gram FROM f WHERE length(low) >= 3)"


@query("trigram_postings", GRAMS + "SELECT gram, count(*) AS blocks, CAST(min(block) AS BIGINT) AS first, CAST(max(block) AS BIGINT) AS last FROM g GROUP BY gram")
def trigram_postings(spark, d):
    return index.postings(flat(spark, d)).groupBy("gram").agg(F.count("*").alias("blocks"), F.min("block").alias("first"), F.max("block").alias("last"))


@query("indexed_search", FLAT + "SELECT id, path FROM f WHERE contains(low, 'example') AND contains(low, '1') AND contains(low, '/f')")
def indexed_search(spark, d):
    rows = flat(spark, d)
    return index.indexed_search(rows, index.postings(rows), index.signatures(rows), "example 1 /f")


@query("block_ids", DOCS + "SELECT id // 64 AS block, count(*) AS n, min(path) AS first FROM f GROUP BY block")
def block_ids(spark, d):
    rows = fixtures.view(spark, d, DOC_PATHS)
    return rows.groupBy(index.block_of(F.col("id")).alias("block")).agg(F.count("*").alias("n"), F.min("path").alias("first"))


# the rest


@query("percentile_nearest_rank", "WITH v AS (SELECT event_type, list_sort(list(value)) AS s FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, s[CAST(ceil((len(s) - 1) * 0.5) AS INTEGER) + 1] AS p50, s[CAST(ceil((len(s) - 1) * 0.95) AS INTEGER) + 1] AS p95 FROM v")
def percentile_nearest_rank(spark, d):
    return ranks.nearest_ranks(spark.read.parquet(f"{d}/events.parquet"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("synthetic_corpus", """SELECT id, 'C:/corpus/项目/workspace_' || printf('%03d', id // 4096 % 64) || '/src/module_' || printf('%03d', id // 64 % 64) || '/' ||
  replace(['report_%.pdf', '报告_%.docx', 'image_%.png', 'source_%.rs', 'invoice_%.txt', 'ab_notes_%.md', 'backup_%.zip', '日志_%.log', 'video_%.mp4', 'readme_%.md'][id % 10 + 1], '%', printf('%08d', id)) AS path FROM range(20000) AS r(id)""")
def synthetic_corpus(spark, d):
    return listing.synthetic(spark, 20_000)


@query("extensions", FLAT + "SELECT path, CASE WHEN contains(string_split(path, '/')[-1], '.') THEN string_split(string_split(path, '/')[-1], '.')[-1] END AS ext, string_split(path, '/')[-1] AS base FROM f")
def extensions(spark, d):
    base = names.basename(F.col("path"))
    return flat(spark, d).select("path", names.extension(base).alias("ext"), base.alias("base"))


@query("scan_exclusions", DOCS + ", p AS (SELECT id, CASE id % 4 WHEN 0 THEN 'target/' || path WHEN 1 THEN 'a/.git/' || path WHEN 2 THEN path || '/work' ELSE path END AS path FROM f) SELECT id, path FROM p WHERE id % 4 >= 2")
def scan_exclusions(spark, d):
    k = F.col("id") % 4
    odd = F.when(k == 0, F.concat(F.lit("target/"), "path")).when(k == 1, F.concat(F.lit("a/.git/"), "path")).when(k == 2, F.concat("path", F.lit("/work"))).otherwise(F.col("path"))
    return listing.kept(fixtures.view(spark, d, DOC_PATHS).withColumn("path", odd))


@query("path_inventory", DOCS + "SELECT path, 'file' AS kind FROM f UNION ALL SELECT DISTINCT p, 'directory' FROM (SELECT unnest([string_split(path, '/')[1], string_split(path, '/')[1] || '/' || string_split(path, '/')[2]]) AS p FROM f)")
def path_inventory(spark, d):
    return listing.inventory(fixtures.view(spark, d, DOC_PATHS))


#: A namespace of which every fiftieth customer is a reparse directory.
REPARSED = f"SELECT source, object, parent, name, CASE WHEN object BETWEEN 1000000 AND 9999999 AND object % 50 = 9 THEN 1040 ELSE attributes END AS attributes FROM ({NS_ENTRIES}) AS r"
LEFT_OUT = ["CHINA", "Customer#000000007", "BRAZIL"]
WALKED = f"""WITH RECURSIVE e AS ({REPARSED}), d(object, path, level) AS (SELECT CAST(5 AS BIGINT), '', 0
  UNION ALL SELECT e.object, CASE WHEN d.path = '' THEN e.name ELSE d.path || '/' || e.name END, d.level + 1 FROM e JOIN d ON e.parent = d.object WHERE e.attributes & 1040 = 16 AND e.name NOT IN {tuple(LEFT_OUT)}),
y AS (SELECT e.*, p.path, p.level, row_number() OVER (ORDER BY p.level, p.path) AS i FROM (SELECT e.object, e.parent, CASE WHEN d.path = '' THEN e.name ELSE d.path || '/' || e.name END AS path, d.level FROM e JOIN d ON e.parent = d.object) AS p JOIN e ON e.object = p.object AND e.parent = p.parent)
SELECT source, object, parent, name, path, level, 'entries' AS reason FROM y WHERE i <= (SELECT 30 + count(*) FROM {{customer}}) + (SELECT count(*) // 2 FROM {{orders}}) AND attributes & 1024 = 0 AND NOT (attributes & 16 <> 0 AND name IN {tuple(LEFT_OUT)})"""


@query("bounded_scan", WALKED)
def bounded_scan(spark, d):
    """A tree discovered level by level until the budget of entries is used up."""
    from pathloom.sources import scan

    budget = 30 + spark.read.parquet(f"{d}/customer.parquet").count() + spark.read.parquet(f"{d}/orders.parquet").count() // 2
    tree_ = written(fixtures.view(spark, d, REPARSED), "tree")
    found = scan.scanned(scan.listed_from(tree_), spark.createDataFrame([("d:", 5)], "source string, object long"), scan.Limits(entries=budget, directories=None), LEFT_OUT)
    return found.rows.select("source", "object", "parent", "name", "path", "level", F.lit(found.reason).alias("reason"))


@query("verified_listings", f"""WITH e AS ({NS_ENTRIES}), l AS ({NS_BROKEN}), a AS ({NS_AFTER}), dirs AS (SELECT object, parent, name FROM e WHERE attributes & 1040 = 16),
s AS (SELECT parent, sum(144 + 2 * length(name)) AS size, count(*) AS n, count(*) - count(DISTINCT name) AS again FROM l GROUP BY parent)
SELECT 'd:' AS source, dirs.object AS parent, r.reason, CASE WHEN r.reason IS NULL THEN coalesce(s.n, 0) END AS entries FROM dirs LEFT JOIN s ON s.parent = dirs.object, LATERAL (SELECT CASE
  WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.object = dirs.object AND a.parent = dirs.parent AND a.name = dirs.name AND a.attributes & 1040 = 16) THEN 'identity' WHEN s.size > 4500 THEN 'budget' WHEN s.again > 0 THEN 'repeated_name' END AS reason) AS r""")
def verified_listings(spark, d):
    """Listings of all directories, some of which changed while they were listed, are too large or tell a name twice."""
    from pathloom.sources import scan

    old, now = written(entries(spark, d), "old"), fixtures.view(spark, d, NS_AFTER)
    asked = [scan.directory_tags(now), scan.directory_tags(old)]
    dirs = old.where(names.ordinary_directory(F.col("attributes"))).select("source", "object")
    rows, refused = scan.verified(scan.listed_from(broken(spark, d)), dirs, lambda some: asked.pop()(some), 4500)
    counts = rows.groupBy("source", "parent").agg(F.count("*").alias("n"))
    told = dirs.withColumnRenamed("object", "parent").join(refused, ["source", "parent"], "left").join(counts, ["source", "parent"], "left")
    return told.select("source", "parent", "reason", F.when(F.col("reason").isNull(), F.coalesce("n", F.lit(0))).alias("entries"))


@query("scope_repeats", f"SELECT source, object, parent, name, count(*) AS n FROM (SELECT source, object, parent, name FROM ({NS_ENTRIES}) AS a UNION ALL SELECT source, object, parent, name FROM ({NS_ENTRIES}) AS b WHERE object % 5 = 2) AS c GROUP BY ALL HAVING count(*) > 1")
def scope_repeats(spark, d):
    all_ = entries(spark, d)
    return listing.repeated_objects(all_.unionByName(all_.where("object % 5 = 2")))


@query("names_of_object", f"SELECT source, object, list_sort(list(DISTINCT parent || '/' || name)) AS names, FALSE AS excess FROM ({NS_LINKS}) AS a GROUP BY source, object")
def names_of_object(spark, d):
    named = listing.names_of(fixtures.view(spark, d, NS_LINKS))
    return named.withColumn("names", F.sort_array(F.transform("names", lambda n: F.concat(n["parent"].cast("string"), F.lit("/"), n["name"]))))


@query("replay_masked", f"WITH {J} SELECT source, usn, reason FROM j WHERE usn >= 50 AND usn < 900 AND reason & 8448 <> 0")
def replay_masked(spark, d):
    return journal.window(notes(spark, d), 50, 900, 0x2100).select("source", "usn", "reason")


@query("namespace_violations", tree(NS_BROKEN) + """SELECT 'bad_row' AS "check", count(*) FILTER (length(name) NOT BETWEEN 1 AND 255 OR name IN ('.', '..') OR contains(name, ':') OR contains(name, '/')) AS n FROM e
UNION ALL SELECT 'repeated_name', count(*) FROM (SELECT 1 FROM e GROUP BY parent, name HAVING count(*) > 1)
UNION ALL SELECT 'directory_names', count(*) FROM (SELECT 1 FROM e WHERE attributes & 1040 = 16 GROUP BY object HAVING count(*) > 1)
UNION ALL SELECT 'unreachable', count(*) FROM e WHERE parent NOT IN (SELECT object FROM d)
UNION ALL SELECT 'long_path', count(*) FROM p WHERE length(path) > 32760
UNION ALL SELECT 'attributes', count(*) FROM (SELECT 1 FROM e GROUP BY object HAVING count(DISTINCT attributes) > 1)""")
def namespace_violations(spark, d):
    return namespace.violations(broken(spark, d), strict=True)


@query("stream_rename_state", PAIRS)
def stream_rename_state(spark, d):
    """The pairs of a stream of notices, and what still waits in its state when the input has ended."""
    from pathloom.streaming import pairing

    base = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    text = NOTICES.split(" AS (", 1)[1].rsplit(")", 1)[0]
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*")
    stream = spark.sql(text, events=events)
    out = pairing.rename_stream(stream, 1500, None).writeStream.option("checkpointLocation", f"{base}/log").option("path", f"{base}/out")
    out.format("parquet").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema(pairing.CHANGES).parquet(f"{base}/out")
    return told.unionByName(pairing.still_waiting(spark, f"{base}/log"))


@query("stream_apply", AFTER)
def stream_apply(spark, d):
    """A namespace kept current from a stream of journal records in several micro-batches."""
    from pathloom.streaming import maintain
    from pathloom.streaming.store import Store

    base = f"{shared_dir(spark)}/apply-{uuid.uuid4().hex}"
    old, now, told = after_tables(spark, d)
    store = Store(spark, f"{base}/store")
    maintain.bootstrap(store, old, "d:", "j", 0)
    last = told.agg(F.max("usn")).first()[0]
    for low, high in ((0, 50), (50, last // 2), (last // 2, last + 1)):  # one file each, so each is a micro-batch
        told.where((F.col("usn") >= low) & (F.col("usn") < high)).coalesce(1).write.mode("append").parquet(f"{base}/journal")
    maintain.follow(spark, f"{base}/journal", maintain.Maintainer(store, lambda: now), f"{base}/log", files=1).awaitTermination()
    return store.read().select("source", "object", "parent", "name", "attributes")


@query("stream_journal_source", AFTER.replace("SELECT source, object, parent, name, attributes FROM c WHERE", "SELECT 'followed' AS state, source, object, parent, name, attributes FROM c WHERE") + " UNION ALL SELECT 'expired', source, object, parent, name, attributes FROM l")
def stream_journal_source(spark, d):
    """A store that follows a journal by its own source: two runs from one checkpoint; then the journal has dropped what comes next, and the listing is taken."""
    from pathloom.sources import feed
    from pathloom.streaming import maintain

    store, base = new_store(spark, "feed", most_versions=8)
    old, now, told = after_tables(spark, d)
    maintain.bootstrap(store, old, "d:", "j", 0)
    last, folder = told.agg(F.max("usn")).first()[0], feed.Folder(spark, f"{base}/journal")
    maintainer = maintain.Maintainer(store, lambda: now, holds=folder.holds)

    def run() -> None:
        maintain.started(feed.stream(spark, folder.path, "d:"), maintainer, f"{base}/log").awaitTermination()

    for low, high in ((0, last // 2), (last // 2, last + 1)):
        folder.append(told, low, high)
        folder.tell("j", 0, high)
        run()
    followed = store.lease()
    folder.append(told.withColumn("usn", F.col("usn") + last + 1000), last + 1000, 2 * last + 1001)
    folder.tell("j", last + 1000, 2 * last + 1001)
    folder.drop(last + 1000)
    run()
    columns = ["source", "object", "parent", "name", "attributes"]
    return store.leased(followed).select(F.lit("followed").alias("state"), *columns).unionByName(store.read().select(F.lit("expired").alias("state"), *columns))


@query("replay_until_quiet", AFTER.replace("SELECT source, object, parent, name, attributes FROM c WHERE", "SELECT 'replayed' AS state, (SELECT max(usn) + 1 FROM t) AS cursor, source, object, parent, name, attributes FROM c WHERE") + " UNION ALL SELECT 'undone', 0, source, object, parent, name, attributes FROM e")
def replay_until_quiet(spark, d):
    """A store brought to the end of a journal that goes on during the replay, published once; and the same rows taken back by the undo segment."""
    from pathloom.streaming import maintain, replay

    store, _ = new_store(spark, "quiet", most_versions=4)
    old, now, told = after_tables(spark, d)
    maintain.bootstrap(store, old, "d:", "j", 0)
    last = told.agg(F.max("usn")).first()[0]
    ends = [last + 1, last + 1, last // 2, 50]
    done = replay.Replay(store, lambda: now, lambda first, following: told, lambda: ("j", 0, 0, ends.pop())).sync()
    columns = ["source", "object", "parent", "name", "attributes"]
    after = store.rows(store.manifest(2))
    cursor = F.lit(store.manifest(2).cursor).cast("long").alias("cursor")
    before = replay.undone(store, done.undo, after)
    return after.select(F.lit("replayed").alias("state"), cursor, *columns).unionByName(before.select(F.lit("undone").alias("state"), F.lit(0).cast("long").alias("cursor"), *columns))


@query("nearest_known", f"WITH RECURSIVE e AS ({NS_ENTRIES}), k AS (SELECT object FROM e WHERE object IN (1001, 1003, 2002, 2007)), w(parent, at_) AS (SELECT object, object FROM e WHERE object >= 1000000 AND attributes & 16 <> 0 UNION ALL SELECT w.parent, e.parent FROM w JOIN e ON e.object = w.at_ WHERE w.at_ NOT IN (SELECT object FROM k)) SELECT 'd:' AS source, parent, at_ AS known FROM w WHERE at_ IN (SELECT object FROM k)")
def nearest_known(spark, d):
    all_ = entries(spark, d)
    asked = all_.where(names.is_directory(F.col("attributes")) & (F.col("object") >= 1000000)).select("source", F.col("object").alias("parent"))
    return journal.nearest_known(asked, all_, all_.where("object in (1001, 1003, 2002, 2007)").select("source", "object"))


RENAMED = f"SELECT source, object, parent, CASE WHEN object IN (2003, 2008) THEN name || '_renamed' ELSE name END AS name, attributes, slot FROM ({NS_ENTRIES}) AS r"


@query("refresh_paths", tree(RENAMED) + "SELECT source, object, parent, name, path, is_directory FROM p")
def refresh_paths(spark, d):
    old, new = entries(spark, d), fixtures.view(spark, d, RENAMED)
    changed = old.where("object in (2003, 2008)").select("source", F.col("parent").alias("object"))
    before = namespace.paths(old).select("source", "object", "parent", "name", "path", "is_directory")
    return namespace.refreshed_paths(before, old, new, changed)


SHARD = "CAST(coalesce(CAST('0x' || substr(md5(path), 1, 8) AS BIGINT) % 64, 0) AS INTEGER)"


@query("changed_shards", INV + f" SELECT DISTINCT {SHARD} AS shard FROM (SELECT path FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT path FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))")
def changed_shards(spark, d):
    from pathloom.streaming.store import changed_shards as shards

    return shards(old_inventory(spark, d), fixtures.view(spark, d, INV_NEW))


@query("journal_decode", f"WITH {J} SELECT 'd:' AS source, usn, object, parent, reason, attributes, name FROM j")
def journal_decode(spark, d):
    """Records packed into binary batches and decoded again."""
    from pathloom.sources import usn

    decoded = usn.journal_rows(usn.records(usn.encoded(notes(spark, d))), "d:")
    return decoded.select("source", "usn", "object", "parent", "reason", "attributes", "name")


@query("stored_refresh", tree(RENAMED) + "SELECT source, object, path FROM p")
def stored_refresh(spark, d):
    """A stored search state brought from one version to the next, then searched for everything."""
    state = new_state(spark)
    state.save(entries(spark, d), 1)
    state.refresh(fixtures.view(spark, d, RENAMED), 2)
    return state.matches("").select("source", "object", "path")


#: The third version of a namespace: directories moved below others and one below a moved one, one gone with all it had, names added.
TWICE = f"""SELECT source, object, CASE WHEN object IN (2001, 2006) THEN CAST(1003 AS BIGINT) WHEN object = 2012 THEN CAST(2001 AS BIGINT) WHEN object = 1000012 THEN CAST(2012 AS BIGINT) ELSE parent END AS parent,
  CASE WHEN object IN (2003, 2008) THEN name || '_renamed' WHEN object % 1000 = 7 THEN name || '.v3' ELSE name END AS name, attributes, slot FROM ({NS_ENTRIES}) AS t
  WHERE object <> 2010 AND parent <> 2010 AND parent NOT IN (SELECT 1000000 + c_custkey FROM {{customer}} WHERE c_nationkey = 10)
UNION ALL SELECT source, object + 300000000, parent, 'third_' || name, attributes, slot + 300000000 FROM ({NS_ENTRIES}) AS u WHERE object % 500 = 3 AND object >= 10000000
  AND parent NOT IN (SELECT 1000000 + c_custkey FROM {{customer}} WHERE c_nationkey = 10)"""


def refreshed_twice(spark, d) -> SearchState:
    """A state after two refreshes by way of a store, whose segments were merged: a shard's files change only if its rows do."""
    store, _ = new_store(spark, "twice", most_versions=3)
    state = new_state(spark)
    for k, text in enumerate((NS_ENTRIES, RENAMED, TWICE)):
        store.publish(fixtures.view(spark, d, text), store.ticket(), "d:", "j", k, key=["source", "parent"], shards=16)
        state.follow(store)
    return state


@query("state_after_two_refreshes", tree(TWICE) + "SELECT source, object, slot, path, is_directory FROM p")
def state_after_two_refreshes(spark, d):
    return refreshed_twice(spark, d).matches("").select("source", "object", "slot", "path", "is_directory")


@query("state_indexed_search", tree(TWICE) + f"SELECT source, object, path FROM p WHERE {has('third_')} AND {has('nation_1')} AND {has('/third_o')}")
def state_indexed_search(spark, d):
    """Zones and blocks by postings, rows by stored signatures, of a state whose rows lie in several segments."""
    return stored(spark, d, "twice", refreshed_twice).matches("third_ nation_1 /third_o", indexed=True).select("source", "object", "path")


@query("state_page_stops_early", tree(TWICE) + f", m AS (SELECT * FROM p WHERE {has('europe')} ORDER BY slot, path LIMIT 41) SELECT slot, path, 41 AS total, FALSE AS total_exact FROM m ORDER BY slot, path LIMIT 40")
def state_page_stops_early(spark, d):
    """A page of a common word, from the first zones in the order of slots."""
    page = stored(spark, d, "twice", refreshed_twice).page("europe", 40)
    return page.rows.select("slot", "path", F.lit(page.total).cast("int").alias("total"), F.lit(page.exact).alias("total_exact"))


# binary sources, raw names, scopes

TWO_MAJORS = "count(*) FILTER (reason & 256 <> 0) AS creations, count(*) FILTER (reason & 512 <> 0) AS deletions, bit_or(reason) AS reasons"


@query("decoded_statistics", f"WITH {J} SELECT count(*) AS records, count(DISTINCT (usn % 2, usn // 256)) AS batches, {TWO_MAJORS}, [2, 3] AS majors FROM j")
def decoded_statistics(spark, d):
    """Batches of both versions of records, decoded and summed up."""
    from pathloom.sources import usn

    all_ = notes(spark, d)
    batches = usn.encoded(all_.where("usn % 2 = 0")).unionByName(usn.encoded(all_.where("usn % 2 = 1"), major=3))
    return usn.batch_statistics(usn.records(batches, (2, 3)))


@query("listing_decode", f"SELECT source, object, parent, CAST(attributes AS BIGINT) AS attributes, name FROM ({NS_ENTRIES}) AS e")
def listing_decode(spark, d):
    """Directories packed into listing buffers, dot entries with them, and decoded again."""
    from pathloom.sources import usn

    return usn.listings(usn.packed_listings(entries(spark, d))).select("source", "object", "parent", "attributes", "name")


BUFFERED = f"""{NOTICES.replace("n AS (", "raw AS (", 1)}, n AS (SELECT source, seq // 16 * 16 + row_number() OVER (PARTITION BY source, seq // 16 ORDER BY seq) - 1 AS seq,
  min(at_ms) OVER (PARTITION BY source, seq // 16) AS at_ms, action, path FROM raw)"""


def buffered(spark, d) -> DataFrame:
    """Notices that went through binary buffers of up to 16."""
    from pathloom.sources import usn

    return usn.notices(usn.packed_notices(fixtures.view(spark, d, f"WITH {NOTICES} SELECT * FROM n")))


@query("notice_decode", f"WITH {BUFFERED} SELECT source, seq, at_ms, action, path FROM n")
def notice_decode(spark, d):
    return buffered(spark, d)


PAIRS_BUFFERED = PAIRS.replace(NOTICES, BUFFERED, 1)


@query("notice_changes", PAIRS_BUFFERED)
def notice_changes(spark, d):
    """From buffers of notices to changes: renames paired, losses told."""
    return journal.rename_pairs(buffered(spark, d), 1500)


VERDICT = "SELECT source, seq // 100 AS batch, count(*) AS changes, count(*) FILTER (loss) AS losses, coalesce(list_sort(list(DISTINCT {kind}) FILTER (loss)), []) AS kinds, count(*) FILTER (loss) = 0 AND count(*) <= 3 AS applies FROM ({pairs}) AS c GROUP BY source, batch"


@query("batch_verdicts", VERDICT.format(kind="'unpaired_rename'", pairs=PAIRS))
def batch_verdicts(spark, d):
    from pathloom.streaming.pairing import batch_verdicts as verdicts

    changes = rename_pairs(spark, d).withColumn("batch", F.floor(F.col("seq") / 100).cast("long"))
    return verdicts(changes, ["source", "batch"], 3)


#: Buffers of which every seventh has lost its last three bytes: what tells of their last notice is lost.
TORN = f"""{BUFFERED.replace("n AS (SELECT source, seq //", "whole AS (SELECT source, seq //", 1)}, n AS (SELECT source, seq, at_ms, CASE WHEN torn THEN 'lost' ELSE action END AS action, CASE WHEN torn THEN 'invalid_event' ELSE path END AS path
  FROM (SELECT *, seq // 16 % 7 = 3 AND seq = max(seq) OVER (PARTITION BY source, seq // 16) AS torn FROM whole) AS x)"""
PAIRS_TORN = PAIRS.replace(NOTICES, TORN, 1).replace("action IN ('old', 'new')", "action IN ('old', 'new', 'lost')").replace("AS kind, path,", "AS kind, CASE WHEN action <> 'lost' THEN path END AS path,")
PAIRS_TORN = PAIRS_TORN.replace("THEN pp END AS source_path", "THEN pp WHEN action = 'lost' THEN path END AS source_path")


def torn(spark, d) -> DataFrame:
    from pathloom.sources import usn

    buffers = usn.packed_notices(fixtures.view(spark, d, f"WITH {NOTICES} SELECT * FROM n"))
    cut = F.when(F.floor(F.col("first") / 16) % 7 == 3, F.expr("substring(data, 1, length(data) - 3)")).otherwise(F.col("data"))
    return usn.notices(buffers.withColumn("data", cut))


@query("torn_notice_changes", PAIRS_TORN)
def torn_notice_changes(spark, d):
    """Changes from buffers some of which break off: what came before the break counts, and the break is a loss."""
    return journal.rename_pairs(torn(spark, d), 1500)


@query("losses_by_kind", VERDICT.format(kind="CASE WHEN path IS NULL THEN source_path ELSE 'unpaired_rename' END", pairs=PAIRS_TORN))
def losses_by_kind(spark, d):
    """Of each batch the kinds of losses, and whether its changes may be applied."""
    from pathloom.streaming.pairing import batch_verdicts as verdicts

    changes = journal.rename_pairs(torn(spark, d), 1500).withColumn("batch", F.floor(F.col("seq") / 100).cast("long"))
    return verdicts(changes, ["source", "batch"], 3)


@query("stream_pairs_in_batches", PAIRS)
def stream_pairs_in_batches(spark, d):
    """Renames paired over several micro-batches and a restart; names that wait at the end are losses."""
    from pathloom.streaming import pairing

    base = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    told = fixtures.view(spark, d, f"WITH {NOTICES} SELECT * FROM n")
    pairs = pairing.Pairs(spark, base, lambda changes, epoch: changes.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}"), 1500, None)
    last, epoch = told.agg(F.max("seq")).first()[0], -1
    for k in range(4):
        told.where(F.floor(F.col("seq") * 4 / (last + 1)) == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if k % 2:  # the stream runs twice, over two files each time, one a batch
            stream = spark.readStream.schema(pairing.NOTICES).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
            out = stream.writeStream.foreachBatch(pairs).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
            out.awaitTermination()
            epoch = max(epoch, out.lastProgress["batchId"])
    columns = [c.split()[0] for c in pairing.CHANGES.split(", ")]
    done = spark.read.schema(pairing.CHANGES).parquet(*[f"{base}/out/epoch={k}" for k in range(epoch + 1)]).select(columns)
    return done.unionByName(pairs.waiting(epoch).selectExpr("source", "seq", "'loss' AS kind", "path", "CAST(NULL AS STRING) AS source_path", "TRUE AS loss"))


CUT = f"SELECT object, CASE WHEN object % 7 = 3 THEN [lower(substr(name, 1, 3)), lower(substr(name, 4))] ELSE [lower(name)] END AS runs, name FROM ({NS_ENTRIES}) AS e"


@query("raw_search", f"SELECT object, CASE WHEN object % 7 <> 3 THEN name END AS name FROM ({CUT}) AS c WHERE len(list_filter(runs, lambda r: contains(r, 'er_1'))) > 0 AND len(list_filter(runs, lambda r: contains(r, 'ord'))) > 0 AND runs[-1] LIKE '%.pdf' OR len(list_filter(runs, lambda r: contains(r, 'rder_2'))) > 0 AND runs[-1] LIKE '%.png'")
def raw_search(spark, d):
    """Names of which every seventh has half of a surrogate pair after its third letter: no word lies across it."""
    whole, k = F.encode("name", "UTF-16LE"), F.lit(6)
    cut = F.concat(F.substring(whole, F.lit(1), k), F.lit(b"\x00\xd8"), F.substring(whole, F.lit(7), F.octet_length(whole)))
    rows = entries(spark, d).select("object", F.when(F.col("object") % 7 == 3, cut).otherwise(whole).alias("name_raw"))
    found = search.raw_matches(rows, "er_1 ord ext:pdf").unionByName(search.raw_matches(rows, "rder_2 ext:png"))
    return found.select("object", "name")


WIDE = "SELECT id, CASE id % 3 WHEN 0 THEN '𝄞' WHEN 1 THEN 'ﬀ' ELSE 'z' END || path AS path FROM f"


@query("literal_unit_order", DOCS + f", w AS ({WIDE}), m AS (SELECT id, path FROM w WHERE contains(path, 'src1/doc')) SELECT id, path, (SELECT count(*) FROM m) AS total FROM m ORDER BY CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END, path LIMIT 40")
def literal_unit_order(spark, d):
    """The first 40 by UTF-16 units, where characters of the higher planes come before U+FB00."""
    first = F.when(F.col("id") % 3 == 0, "𝄞").when(F.col("id") % 3 == 1, "ﬀ").otherwise("z")
    rows = fixtures.view(spark, d, DOC_PATHS).withColumn("path", F.concat(first, F.col("path")))
    return search.literal_first(rows, "src1/doc", 40)


@query("signed_search", FLAT + "SELECT id, path FROM f WHERE contains(low, 'example.net') AND contains(low, '/en/') AND contains(low, '7')")
def signed_search(spark, d):
    return index.signed_search(index.record_signatures(flat(spark, d)), "example.net /en/ 7")


MOVED = f"m AS (SELECT source, usn, object, CASE WHEN usn % 4 = 0 THEN object - object % 5 + (object + 2) % 5 ELSE parent END AS parent, reason, attributes, name FROM ({JOURNAL}) AS j)"


#: The records in order, with the parents that directories have got by them: each is held against the chain of its parent as it is before it.
SCOPED = f"""WITH RECURSIVE e AS ({NS_ENTRIES}), {MOVED}, o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY usn) AS i FROM m),
k AS MATERIALIZED (SELECT map(list(object), list(parent)) AS up FROM e WHERE attributes & 1040 = 16),
s(i, usn, told, gone, out) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), MAP {{{{}}}}::MAP(BIGINT, BIGINT), FALSE, FALSE
  UNION ALL SELECT x.i, x.usn, CASE WHEN x.attributes & 1040 = 16 AND (x.above OR x.own) THEN map_concat(x.told, MAP([x.object], [x.parent])) ELSE x.told END, x.above, x.object = 2003
  FROM (SELECT o.*, s.told, {{above}} AS above, {{own}} AS own FROM s JOIN o ON o.i = s.i + 1 CROSS JOIN k) AS x)
SELECT m.source, m.usn, m.object, m.parent FROM s JOIN m ON m.usn = s.usn WHERE NOT s.gone AND NOT s.out"""
CHAIN = "coalesce(list_reduce([CAST(o.{at} AS BIGINT)] || range(8), lambda a, n: CASE WHEN a IS NULL OR a IN (5, 2003) THEN a ELSE coalesce(s.told[a], k.up[a]) END) = 2003, FALSE)"


@query("scope_records", SCOPED.replace("{above}", CHAIN.format(at="parent")).replace("{own}", CHAIN.format(at="object")).replace("MAP {{}}", "MAP {}"))
def scope_records(spark, d):
    """Records outside a subtree that directories join and leave by the records before."""
    records = fixtures.view(spark, d, f"WITH {MOVED} SELECT * FROM m")
    return journal.in_scope(records, entries(spark, d), 2003).select("source", "usn", "object", "parent")


@query("export_lines", DOCS + "SELECT CASE id % 3 WHEN 0 THEN replace(path, '/', '\\\\') ELSE path END AS line FROM f WHERE contains(path, 'src2')")
def export_lines(spark, d):
    """All matches written as escaped lines of text, and read again."""

    rows = fixtures.view(spark, d, DOC_PATHS)
    rows = rows.withColumn("path", F.when(F.col("id") % 3 == 0, F.translate("path", "/", "\\")).otherwise(F.col("path")))
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    search.export(rows, "src2", path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("background_count", DOCS + "SELECT 'complete' AS state, count(*) AS n FROM f WHERE contains(path, 'src3')")
def background_count(spark, d):
    from pathloom.plans.jobs import CountJob

    job = CountJob(search.path_matches(fixtures.view(spark, d, DOC_PATHS), "src3"))
    n = job.wait()
    return spark.createDataFrame([(job.state, n)], "state string, n long")


# versions and maintenance


def new_store(spark, name: str, **limits):
    """A store in a folder of its own, and the folder."""
    from pathloom.streaming.store import Store

    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return Store(spark, f"{base}/store", **limits), base


@query("leased_version", INV + "SELECT 'leased' AS version, path, kind FROM a UNION ALL SELECT 'newest', path, kind FROM b")
def leased_version(spark, d):
    """A version that a reader pins outlives two later ones and a vacuum; the newest one is compacted."""
    store, _ = new_store(spark, "leased", most_versions=4)
    store.publish(old_inventory(spark, d), store.ticket(), "", "", 1)
    key = store.lease()
    store.publish(fixtures.view(spark, d, INV_NEW), store.ticket(), "", "", 2)
    store.compact(2)
    store.vacuum()
    return store.leased(key).select(F.lit("leased").alias("version"), "path", "kind").unionByName(store.read().select(F.lit("newest").alias("version"), "path", "kind"))


@query("refresh_below", INV + """, t AS (SELECT unnest(['en/src1', 'fr/src2', 'de']) AS top)
SELECT path, kind FROM a WHERE NOT EXISTS (SELECT 1 FROM t WHERE a.path = top OR starts_with(a.path, top || '/')) UNION ALL SELECT path, kind FROM b WHERE EXISTS (SELECT 1 FROM t WHERE b.path = top OR starts_with(b.path, top || '/'))""")
def refresh_below(spark, d):
    """An inventory with some subtrees as a listing has them now."""
    tops = spark.createDataFrame([("en/src1",), ("fr/src2",), ("de",)], "path string")
    return inventory.refreshed(old_inventory(spark, d), fixtures.view(spark, d, INV_NEW), tops).select("path", "kind")


@query("expired_cursor", f"WITH l AS ({NS_NOW}) SELECT source, object, parent, name, attributes, CAST((SELECT max(usn) + 1 FROM ({JOURNAL}) AS j) AS BIGINT) AS cursor FROM l")
def expired_cursor(spark, d):
    """The journal has dropped what a store's cursor stands at: one rebuild from the listing, at the journal's end."""
    from pathloom.streaming import maintain

    store, _ = new_store(spark, "expired")
    old, now, told = entries(spark, d), fixtures.view(spark, d, NS_NOW), notes(spark, d)
    maintain.bootstrap(store, old, "d:", "j", 0)
    last = told.agg(F.max("usn")).first()[0]
    maintain.Maintainer(store, lambda: now, holds=lambda: ("j", 50, 50, last + 1))(told, 0)
    return store.read().select("source", "object", "parent", "name", "attributes", F.lit(store.manifest().cursor).cast("long").alias("cursor"))


def of_source(source: str, told: str) -> str:
    """SQL of a source's rows after the records `told` of it."""
    dirty = f"(SELECT parent FROM j WHERE {told} UNION SELECT e.parent FROM e JOIN j ON e.object = j.object WHERE {told})"
    return f"""SELECT '{source}' AS source, object, parent, name, attributes FROM e WHERE parent NOT IN {dirty} UNION ALL SELECT '{source}', object, parent, name, attributes FROM l WHERE parent IN {dirty}"""


@query("stream_two_sources", f"WITH e AS ({NS_ENTRIES}), l AS ({NS_NOW}), {J} {of_source('d:', 'usn % 2 = 1')} UNION ALL {of_source('e:', 'j.object % 4 = 1')}")
def stream_two_sources(spark, d):
    """One stream keeps the stores of two sources current; the records of one never move the other."""
    from pathloom.streaming import maintain

    old, now, told = entries(spark, d), fixtures.view(spark, d, NS_NOW), notes(spark, d)
    other = F.lit("e:").alias("source")
    kept = []
    for source in ("d:", "e:"):
        store, base = new_store(spark, "two")
        maintain.bootstrap(store, old.withColumn("source", F.lit(source)), source, "j", 0)
        listed = now.withColumn("source", F.lit(source))
        kept.append(maintain.Maintainer(store, lambda listed=listed: listed))
    both = told.where("usn % 2 = 1").unionByName(told.where("object % 4 = 1").withColumn("source", other))
    both.write.parquet(f"{base}/journal")
    maintain.follow(spark, f"{base}/journal", maintain.each(kept), f"{base}/log", files=1000).awaitTermination()
    a, b = (m.store.read().select("source", "object", "parent", "name", "attributes") for m in kept)
    return a.unionByName(b)
