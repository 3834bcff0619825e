"""One object over the published state of several sources: open, refresh, search, status, stop.

Below a folder each source has the store of its namespace and its stored search state. A search
reads stored state only and goes on answering from it while a refresh fails; the answer then says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom import service
from pathloom.functions.names import ROOT
from pathloom.plans import search
from pathloom.plans.stored import SearchState
from pathloom.streaming import maintain
from pathloom.streaming.store import NotReady, Store

#: What a journal holds now: (journal id, first, lowest, next).
Holds = Callable[[], tuple[str, int, int, int]]


class Library:
    """Sources by name; a source is known once open() has been called for it."""

    def __init__(self, spark: SparkSession, path: str, root: int = ROOT):
        self.spark, self.path, self.root = spark, path.rstrip("/"), root
        self.maintainers: dict[str, maintain.Maintainer] = {}
        self.states: dict[str, SearchState] = {}
        self.errors: dict[str, str] = {}

    def open(self, source: str, listing: Callable[[], DataFrame], holds: Holds) -> None:
        """Loads what is published of a source, or publishes its listing as version 1 with the journal's end as cursor.

        A published cursor that the journal no longer holds is found by the next refresh(), which then rebuilds.
        """
        at = f"{self.path}/{source.encode().hex()}"  # names of sources may hold what paths can't
        store = Store(self.spark, f"{at}/names")
        if store.manifest() is None:
            journal_id, _, _, following = holds()
            maintain.bootstrap(store, listing().where(F.col("source") == source), source, journal_id, following, self.root)
        state = self.states[source] = SearchState(self.spark, f"{at}/search")
        self.maintainers[source] = maintain.Maintainer(store, listing, self.root, holds=holds, known=state.directories_of)
        self.states[source].follow(store)

    def refresh(self, records: DataFrame) -> bool:
        """Applies journal records, each source its own; False if one failed, which keeps what it had."""
        for source, maintainer in self.maintainers.items():
            try:
                maintainer(records, 0)
                self.states[source].follow(maintainer.store)
                self.errors.pop(source, None)
            except Exception as e:  # told with every answer until a refresh succeeds
                self.errors[source] = f"{source} {type(e).__name__}: {e}".split("\n")[0]
        return not self.errors

    def search(self, raw: str, limit: int = service.LIMIT, kind: str = "all") -> search.Page:
        """One page of all sources."""
        if not self.states:
            raise NotReady("no source is open")
        return search.merged([state.page(raw, limit, kind) for state in self.states.values()], limit)

    def version(self) -> int:
        """Grows whenever what a search reads has changed."""
        return sum(state.version() for state in self.states.values())

    def _error(self) -> str | None:
        return "; ".join([*self.errors.values(), "results may be out of date"]) if self.errors else None

    def answer(self, asked: dict) -> dict:
        """The response to a checked request of service.request()."""
        try:
            return service.respond(self.search(asked["query"], asked["limit"], asked["filter"]), self.version(), error=self._error())
        except NotReady as e:
            return service.unavailable(str(e))

    def status(self) -> dict:
        """A response without files: the number of names in all sources, and what went wrong last."""
        if not self.maintainers:
            return service.unavailable("no source is open")
        records = sum(m.store.manifest().records for m in self.maintainers.values())
        facts = {"ready": True, "pending": False, "error": self._error(), "version": self.version()}
        return facts | {"total": records, "total_exact": True, "skipped": 0, "files": []}

    def stop(self) -> None:
        """No more versions of any source; searches go on."""
        for m in self.maintainers.values():
            m.store.stop()
