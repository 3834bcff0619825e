"""Notices of a source are given out in order, a few rows at a time, from the columns they are held in."""

import random

import pandas as pd

from pathloom.streaming import pairing


def test_notices_come_in_order_in_lists_of_bounded_length():
    rng = random.Random(3)
    rows = [(k, k * 60 + rng.randint(0, 50), rng.choice(["old", "new", "removed", "modified"]), f"p{k}é" if k % 9 else None) for k in range(5000)]
    mixed = rng.sample(rows, len(rows))
    parts = [pd.DataFrame([("s", *r) for r in mixed[at : at + 700]], columns=["source", "seq", "at_ms", "action", "path"]) for at in range(0, 5000, 700)]
    lists = list(pairing.in_order(iter(parts), 512))
    assert max(map(len, lists)) == 512 and [r for some in lists for r in some] == rows
    out, waiting = [], None
    for some in lists:
        told, waiting = pairing.paired(some, waiting, 250)
        out += told
    assert (out, waiting) == pairing.paired(rows, None, 250)
