"""The library object over several sources, and the command line's index of paths."""

import json

import pytest

from pathloom import cli, service
from pathloom.library import Library
from pathloom.plans.stored import SearchState
from pathloom.streaming.maintain import JOURNAL
from pathloom.streaming.store import NotReady
from test_namespace import D, F_, table

NEW = 0x100


def both(spark, more=()):
    """The listing of two sources."""
    one = table(spark, [(100, 5, "a", D), (200, 100, "f.txt", F_), *more])
    return one.unionByName(table(spark, [(300, 5, "f.md", F_)]).selectExpr(*["'e:' AS source" if c == "source" else c for c in one.columns]))


def test_library_follows_its_sources(spark, tmp_path):
    now, held = both(spark), {"next": 3}
    holds = lambda: ("j", 0, 0, held["next"])
    library = Library(spark, str(tmp_path / "l"))
    with pytest.raises(NotReady):
        library.search("f")
    assert not library.status()["ready"] and not library.answer(service.request('{"op":"query","query":"f"}'))["ready"]
    for source in ("d:", "e:"):
        library.open(source, lambda: now, holds)
    assert [r.path for r in library.search("f").rows.collect()] == ["d:/a/f.txt", "e:/f.md"]
    assert library.status()["total"] == 3 and library.status()["error"] is None

    now, held["next"], before = both(spark, [(201, 100, "g.txt", F_)]), 20, library.version()
    records = spark.createDataFrame([("d:", 10, None, 201, 100, NEW, F_, "g.txt")], JOURNAL)
    assert library.refresh(records) and library.version() > before
    found = library.answer(service.request('{"op":"query","query":"txt"}'))
    assert [f["path"] for f in found["files"]] == ["d:/a/f.txt", "d:/a/g.txt"] and found["total_exact"] and found["error"] is None

    def lost():
        raise OSError("the journal is away")

    library.maintainers["d:"].holds = lost
    assert not library.refresh(records)
    found = library.answer(service.request('{"op":"query","query":"txt"}'))
    assert len(found["files"]) == 2 and "the journal is away" in found["error"]
    library.maintainers["d:"].holds = holds
    assert library.refresh(records) and library.status()["error"] is None

    again = Library(spark, str(tmp_path / "l"))
    again.open("d:", lambda: pytest.fail("what is published needs no listing"), holds)
    assert again.states["d:"].version() == again.maintainers["d:"].store.manifest().version and again.search("ext:txt").total == 2

    def full(*_):
        raise OSError("the disk is full")

    whole, SearchState._table = SearchState._table, full  # the namespace goes on, its search state can't be written
    now, held["next"] = both(spark, [(201, 100, "g.txt", F_), (202, 100, "h.txt", F_)]), 35
    try:
        assert not library.refresh(spark.createDataFrame([("d:", 25, None, 202, 100, NEW, F_, "h.txt")], JOURNAL))
    finally:
        SearchState._table = whole
    found = library.answer(service.request('{"op":"query","query":"txt"}'))
    assert found["ready"] and len(found["files"]) == 2 and "the disk is full" in found["error"]
    assert library.refresh(spark.createDataFrame([], JOURNAL)) and library.search("txt").total == 3
    library.stop()
    held["next"] = 40
    assert not library.refresh(spark.createDataFrame([("d:", 30, None, 200, 100, NEW, F_, "f.txt")], JOURNAL)) and library.search("txt").total == 3


def test_command_line_indexes(spark, tmp_path, capsys):
    def told(*args):
        code = cli.main(["--store", str(tmp_path / "i"), *args], spark)
        return code, json.loads(capsys.readouterr().out) if code == 0 else None

    assert told("find", "x") == (1, None) and told("build", "many")[0] == 2
    assert told("build", "1000")[1]["rows"] == 1000
    assert told("find", "ext:pdf")[1] == {"matches": 50, "checksum": sum(10 * k + 1 for k in range(50)), "complete": False}
    assert told("find", "--complete", "ext:pdf")[1] == {"matches": 100, "checksum": sum(10 * k + 1 for k in range(100)), "complete": True}
    assert told("bench", "invoice")[1]["matches"] == 100
    for name in ("b/two.txt", "a/one.txt", "target/three.txt"):
        (tmp_path / "files" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / name).write_text("x")
    assert told("scan", str(tmp_path / "files"))[1]["rows"] == 2
    assert told("find", "one")[1] == {"matches": 1, "checksum": 1, "complete": True}
    assert told("scan", "--most", "1", str(tmp_path / "files"))[1]["rows"] == 1
