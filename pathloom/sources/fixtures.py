"""The driver's tables seen as namespaces, paths, journals and inventories.

Each view is one SQL text that Spark and DuckDB both run; {table} stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NS_ENTRIES = """
SELECT 'd:' AS source, CAST(1000 + r_regionkey AS BIGINT) AS object, CAST(5 AS BIGINT) AS parent, r_name AS name, 16 AS attributes, CAST(1000 + r_regionkey AS BIGINT) AS slot FROM {region}
UNION ALL SELECT 'd:', CAST(2000 + n_nationkey AS BIGINT), CAST(1000 + n_regionkey AS BIGINT), n_name, 16, CAST(2000 + n_nationkey AS BIGINT) FROM {nation}
UNION ALL SELECT 'd:', CAST(1000000 + c_custkey AS BIGINT), CAST(2000 + c_nationkey AS BIGINT), c_name, 16, CAST(1000000 + c_custkey AS BIGINT) FROM {customer}
UNION ALL SELECT 'd:', CAST(10000000 + o_orderkey AS BIGINT), CAST(1000000 + o_custkey AS BIGINT),
  'order_' || CAST(o_orderkey AS STRING) || CASE o_orderstatus WHEN 'P' THEN '.pdf' WHEN 'F' THEN '.docx' ELSE '.png' END, 32, CAST(10000000 + o_orderkey AS BIGINT) FROM {orders}
"""

NS_LINKS = """
SELECT 'd:' AS source, CAST(3000000 + s_suppkey AS BIGINT) AS object, CAST(5 AS BIGINT) AS parent, s_name AS name, 16 AS attributes, CAST(3000000 + s_suppkey AS BIGINT) AS slot FROM {supplier}
UNION ALL SELECT DISTINCT 'd:', CAST(4000000 + l_partkey AS BIGINT), CAST(3000000 + l_suppkey AS BIGINT), 'part_' || CAST(l_partkey AS STRING) || '.dat', 32, CAST(100000000 * l_suppkey + l_partkey AS BIGINT) FROM {lineitem}
"""

#: ns_entries with faults: repeated names, a second name of a directory, orphans, a cycle, differing attributes.
NS_BROKEN = f"""
SELECT * FROM ({NS_ENTRIES}) AS a
UNION ALL SELECT source, object + 50000000, parent, name, attributes, slot + 50000000 FROM ({NS_ENTRIES}) AS b WHERE object BETWEEN 10000000 AND 10000050
UNION ALL SELECT source, object, CAST(1000 AS BIGINT), name || '_again', attributes, slot + 60000000 FROM ({NS_ENTRIES}) AS c WHERE object BETWEEN 2003 AND 2006
UNION ALL SELECT source, object + 70000000, object + 80000000, 'lost_' || name, attributes, slot + 70000000 FROM ({NS_ENTRIES}) AS e WHERE object BETWEEN 1000001 AND 1000020
UNION ALL SELECT source, object, parent, 'other_' || name, 33, slot + 90000000 FROM ({NS_ENTRIES}) AS f WHERE object BETWEEN 10000100 AND 10000120
UNION ALL SELECT 'd:', CAST(91000000 AS BIGINT), CAST(91000001 AS BIGINT), 'ring_a', 16, CAST(91000000 AS BIGINT)
UNION ALL SELECT 'd:', CAST(91000001 AS BIGINT), CAST(91000000 AS BIGINT), 'ring_b', 16, CAST(91000001 AS BIGINT)
"""

FLAT_PATHS = """
SELECT page_id AS id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM {pages}
"""

DOC_PATHS = """
SELECT doc_id AS id, lang || '/' || source || '/doc_' || CAST(doc_id AS STRING) || '.txt' AS path FROM {documents} WHERE lang IS NOT NULL AND source IS NOT NULL
"""

JOURNAL = """
SELECT 'd:' AS source, event_id AS usn, ts, CAST(1000000 + user_id AS BIGINT) AS object, CAST(2000 + user_id % 25 AS BIGINT) AS parent,
  CAST(CASE event_type WHEN 'signup' THEN 256 WHEN 'error' THEN 512 WHEN 'click' THEN 4096 WHEN 'purchase' THEN 8192 ELSE 32768 END AS BIGINT) AS reason,
  CASE WHEN user_id % 3 = 0 THEN 16 ELSE 32 END AS attributes, 'n_' || CAST(event_id AS STRING) AS name FROM {events}
"""

#: The namespace as it is after changes: some children renamed, removed, added.
NS_NOW = f"""
SELECT source, object, parent, CASE WHEN object % 11 = 3 THEN name || '.new' ELSE name END AS name, attributes, slot FROM ({NS_ENTRIES}) AS a WHERE object < 10000000 OR object % 7 <> 2
UNION ALL SELECT source, object + 200000000, parent, 'added_' || name, attributes, slot + 200000000 FROM ({NS_ENTRIES}) AS b WHERE object >= 10000000 AND object % 13 = 1
"""

#: The namespace after changes of directories: nation 2001 moved below region 1003, customer 1000012 into a new directory, nation 2010 gone
#: with all below, new directories 2100 and 2200, each with another one below and files in that, orders renamed; and names that no record tells of.
NS_AFTER = f"""
SELECT source, object, CASE WHEN object = 2001 THEN CAST(1003 AS BIGINT) WHEN object = 1000012 THEN CAST(2100 AS BIGINT) ELSE parent END AS parent,
  CASE WHEN object >= 10000000 AND object % 11 = 3 THEN name || '.new' WHEN object > 1000000 AND object % 17 = 5 THEN name || '_untold' ELSE name END AS name, attributes, slot
  FROM ({NS_ENTRIES}) AS a WHERE object <> 2010 AND parent <> 2010 AND parent NOT IN (SELECT 1000000 + c_custkey FROM {{customer}} WHERE c_nationkey = 10)
UNION ALL SELECT 'd:', CAST(d AS BIGINT), CAST(p AS BIGINT), 'new_' || CAST(d AS STRING), 16, CAST(d AS BIGINT) FROM (SELECT 2100 AS d, 1002 AS p UNION ALL SELECT 2101, 2100 UNION ALL SELECT 2200, 1001 UNION ALL SELECT 2201, 2200) AS n
UNION ALL SELECT source, object + 400000000, CAST(CASE WHEN object % 2 = 0 THEN 2101 ELSE 2201 END AS BIGINT), 'deep_' || name, attributes, slot + 400000000 FROM ({NS_ENTRIES}) AS b WHERE object >= 10000000 AND object % 50 = 7
"""

#: What a journal tells of these changes: first of the directories, then of every second order.
JOURNAL_AFTER = f"""
SELECT 'd:' AS source, CAST(usn AS BIGINT) AS usn, CAST(object AS BIGINT) AS object, CAST(parent AS BIGINT) AS parent, CAST(reason AS BIGINT) AS reason, 16 AS attributes, name FROM (
  SELECT 1 AS usn, 2100 AS object, 1002 AS parent, 256 AS reason, 'new_2100' AS name UNION ALL SELECT 2, 2200, 1001, 256, 'new_2200'
  UNION ALL SELECT 3, object, parent, 4096, name FROM ({NS_ENTRIES}) AS x WHERE object = 2001 UNION ALL SELECT 4, object, 1003, 8192, name FROM ({NS_ENTRIES}) AS y WHERE object = 2001
  UNION ALL SELECT 5, object, parent, 4096, name FROM ({NS_ENTRIES}) AS z WHERE object = 1000012 UNION ALL SELECT 6, object, 2100, 8192, name FROM ({NS_ENTRIES}) AS v WHERE object = 1000012
  UNION ALL SELECT 7, object, parent, 512, name FROM ({NS_ENTRIES}) AS w WHERE object = 2010) AS s
UNION ALL SELECT 'd:', o_orderkey + 100, CAST(10000000 + o_orderkey AS BIGINT), CAST(1000000 + o_custkey AS BIGINT), CAST(32768 AS BIGINT), 32, 'order' FROM {{orders}}
  WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT c_custkey FROM {{customer}} WHERE c_nationkey = 10)
"""

INV_OLD = f"SELECT path, CASE WHEN id % 17 = 0 THEN 'directory' ELSE 'file' END AS kind FROM ({DOC_PATHS}) AS p"
INV_NEW = f"""
SELECT CASE WHEN id % 7 = 1 THEN path || '.moved' ELSE path END AS path, CASE WHEN id % 5 = 0 THEN 'directory' ELSE 'file' END AS kind FROM ({DOC_PATHS}) AS p WHERE id % 11 <> 4
"""


def sql(text: str) -> str:
    """A view's text for DuckDB, where the tables have their own names."""
    return re.sub(r"\{(\w+)\}", r"\1", text).replace("AS STRING", "AS VARCHAR")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view over the tables in a folder."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})
