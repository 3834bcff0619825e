"""A bounded memory of computed values, for words that come again and again."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """memo[key] computes make(key) once and keeps it while it is in use.

    Two generations of at most `most` keys each: when the young one is full it becomes
    the old one, and what is asked for again moves back. Keys longer than `longest`
    are computed each time, so memory is bounded whatever the input.
    """

    def __init__(self, make: Callable, most: int = 250_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > self.longest:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


_LOADED: dict = {}


def once(kind: str, key, load: Callable):
    """load(), once in each Python worker for a key; a worker serves tasks of many stages, and keeps what the last kind of them loaded."""
    if _LOADED.get(kind, (None,))[0] != key:
        _LOADED.clear()  # before the new one is loaded, so that the two are never held together
        _LOADED[kind] = (key, load())
    return _LOADED[kind][1]
