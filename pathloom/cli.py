"""Queries from a shell: python -m pathloom.cli --store DIR query [--type T] [--limit N] WORDS, or status.

Beside these, of an index of paths in DIR: `build N` makes one of N synthetic paths, `scan ROOT` one of the
files below a folder, `find [--complete] WORDS` searches it, and `bench WORDS` tells seconds with the index and without.

Exit codes: 0, 1 if the store can't answer, 2 for wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom import service
from pathloom.plans import search
from pathloom.plans.stored import IndexState
from pathloom.sources import listing
from pathloom.session import local_session
from pathloom.streaming.store import NotReady, Store

#: So many files of a folder are scanned, unless the caller wants more.
SCAN_MOST = 20_000


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pathloom")
    top.add_argument("--store", default=".", help="folder of published versions")
    commands = top.add_subparsers(dest="op", required=True)
    commands.add_parser("status")
    q = commands.add_parser("query")
    q.add_argument("--type", dest="filter", choices=service.KINDS, default="all")
    q.add_argument("--limit", type=int, default=service.LIMIT)
    q.add_argument("--json", action="store_true", help="the whole response instead of paths")
    q.add_argument("--nul", action="store_true", help="paths end with NUL")
    q.add_argument("words", nargs="+")
    commands.add_parser("build").add_argument("rows", type=int)
    s = commands.add_parser("scan")
    s.add_argument("--most", type=int, default=SCAN_MOST, help="so many files, the first by path")
    s.add_argument("root")
    f = commands.add_parser("find")
    f.add_argument("--complete", action="store_true", help="all matches instead of the first 50 by id")
    f.add_argument("words", nargs="+")
    commands.add_parser("bench").add_argument("words", nargs="+")
    return top


def scanned(spark: SparkSession, root: str, most: int = SCAN_MOST) -> DataFrame:
    """(id, path) of the first `most` files below a folder by path, without excluded directories."""
    first = listing.kept(listing.files(spark, root), listing.WALK_LEAVES_OUT).orderBy("path").limit(most)
    # one task orders the rows, `most` of them at most
    return first.select((F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("id"), "path")


def _indexed(asked: argparse.Namespace, spark: SparkSession) -> dict:
    """Runs build, scan, find or bench; what it has to tell."""
    state, began = IndexState(spark, asked.store), time.perf_counter()
    if asked.op in ("build", "scan"):
        state.save(listing.synthetic(spark, asked.rows) if asked.op == "build" else scanned(spark, asked.root, asked.most), state.version() + 1)
        return {"rows": state.read("rows").count(), "seconds": round(time.perf_counter() - began, 3)}
    raw = " ".join(asked.words)
    if asked.op == "find":
        return search.summary(state.search(raw), "", None if asked.complete else 50).first().asDict()
    told = {}
    for way, found in (("indexed", state.search(raw)), ("scanned", search.path_matches(state.read("rows"), raw))):
        began = time.perf_counter()
        told |= {"matches": found.count(), way: round(time.perf_counter() - began, 3)}
    return told


def main(args: list[str] | None = None, spark=None) -> int:
    try:
        asked = parser().parse_args(args)
        if asked.op == "query":
            wanted = service.request(json.dumps({"op": "query", "query": " ".join(asked.words), "filter": asked.filter, "limit": asked.limit}))
    except SystemExit as e:
        return int(e.code or 0)
    except ValueError as e:
        print(f"invalid {e}", file=sys.stderr)
        return 2
    spark = spark or local_session()
    if asked.op in ("build", "scan", "find", "bench"):
        try:
            print(json.dumps(_indexed(asked, spark)))
        except NotReady as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    store = Store(spark, asked.store)
    if asked.op == "status":
        print(json.dumps(store.status()))
        return 0
    try:
        rows, version = store.read(), store.manifest().version
    except NotReady as e:
        print(e, file=sys.stderr)
        return 1
    found = service.respond(search.page(rows, wanted["query"], wanted["limit"], wanted["filter"]), version)
    sys.stdout.write(json.dumps(found, ensure_ascii=False) + "\n" if asked.json else service.lines([f["path"] for f in found["files"]], asked.nul))
    return 0


if __name__ == "__main__":
    sys.exit(main())
