"""Near copies against all pairs: no link between groups is missed."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from test_operators import component, plain_shingles, words

from tonelake.llm import simhash_dedup


@pytest.mark.parametrize("block", [2048, 5])
def test_no_link_is_missed(spark, block):
    """Copies of a text that is not there itself, with edits that put many pairs just above and below the similarity."""
    rng, rows = random.Random(5), []
    common = words(rng, 40, 4000)
    for f in range(12):
        base = words(rng, rng.choice((30, 60, 120, 300)), 4000).split()
        for k in range(14):
            t = list(base)
            for _ in range(max(1, len(base) // 50) if k else 0):
                t[rng.randrange(len(t))] = f"other{rng.randrange(10 ** 6)}"
            rows.append((1000 * f + (13 - k if f % 2 else k), " ".join(t) + (f" {common}" if k % 3 == 0 else "")))
    rows += [(90_000 + k, f"{common} {common} number {k}") for k in range(20)] + [(95_000, "x y"), (95_001, "X  y"), (95_002, "y x"), (95_003, ""), (95_004, None)]
    sets = {i: plain_shingles(t) for i, t in rows}
    near = {i: set() for i in sets}
    for i, j in combinations(sets, 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            near[i].add(j)
            near[j].add(i)
    kept = [r.doc_id for r in simhash_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()]
    assert sorted(kept) == sorted({component(near, i) for i in sets}) and len(kept) < len(rows) - 40


def test_second_trials_take_every_pair_of_other_heads():
    rows = np.zeros((4, 8 + simhash_dedup.SKETCH), np.int64)
    rows[:, 4], rows[:, 5], rows[:, 6], rows[:, 7] = range(4), range(4), 100, (0, 0, 1, 2)
    names = ["bucket", "a", "b", "part", "item", "rank", "n", "head", *[f"s{k}" for k in range(simhash_dedup.SKETCH)]]
    batches = simhash_dedup._propose(0.8, True)(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names)]))
    got = [p for b in batches for p in zip(*b.to_pydict().values(), strict=True)]
    assert sorted(got) == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
