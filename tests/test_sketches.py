"""Sketches above their capacity against exact counts, one-shot and combined."""

import random
from collections import Counter

import pytest

from readprism.operators import sketches

SIZE = 300
PERCENT = 3.0


def drawn(seed, n, head):
    """Few sequences that are frequent among many more distinct ones than a sketch holds."""
    rng = random.Random(seed)
    frequent = ["ACGT" * (i + 1) for i in range(head)]
    return [("s" if rng.random() < 0.9 else None, rng.choice(frequent).lower() if rng.random() < 0.5 else "".join(rng.choice("ACGT") for _ in range(24))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "sample string, seq string").repartition(4)


def check(state, rows):
    counts, totals = Counter((p, s.upper()) for p, s in rows if s), Counter(p for p, s in rows if s)
    listed = {(r["sample"], r["seq"]): (r["cnt"], r["off"]) for r in sketches.frequent(state, least_percent=PERCENT, size=SIZE).collect()}
    for key, (most, off) in listed.items():
        assert off >= sketches.error_share(SIZE) * totals[key[0]] > off - 1
        assert most - off <= counts[key] <= most, key
    assert {key for key, c in counts.items() if 100 * c >= PERCENT * totals[key[0]]} <= set(listed)
    about = {r["sample"]: r["sequences"] for r in sketches.distinct(state).collect()}
    for part in totals:
        true = sum(k[0] == part for k in counts)
        assert abs(about[part] - true) <= 5 * 1.04 / 2**6 * true
    assert {r["sample"]: r["n"] for r in state.collect()} == dict(totals)


def test_combined_states_keep_the_bound(spark, tmp_path):
    parts = [drawn(i, 4_000, 9) + [("s", "")] for i in range(4)]
    whole = [row for part in parts for row in part]
    assert len(set(whole)) > 10 * SIZE
    for i, part in enumerate(parts):
        sketches.accumulate(frame(spark, part), size=SIZE, lg_k=12).write.parquet(str(tmp_path / str(i)))
    stored = [spark.read.parquet(str(tmp_path / str(i))) for i in range(4)]
    left, right = sketches.combine(*stored[:2]), sketches.combine(*stored[2:])
    check(sketches.accumulate(frame(spark, whole), size=SIZE, lg_k=12), whole)
    check(sketches.combine(*stored), whole)
    check(sketches.combine(left, right), whole)


def test_below_capacity_all_is_exact(spark):
    rows = [("a", "ACGT")] * 50 + [("a", "AC")] * 30 + [("b", "acgt")] * 7
    state = sketches.combine(sketches.accumulate(frame(spark, rows[:40])), sketches.accumulate(frame(spark, rows[40:])))
    got = {(r["sample"], r["seq"]): r["cnt"] for r in sketches.frequent(state).collect()}
    assert got == {("a", "ACGT"): 50, ("a", "AC"): 30, ("b", "ACGT"): 7}
    assert {r["sample"]: r["sequences"] for r in sketches.distinct(state).collect()} == {"a": 2, "b": 1}


def test_edges(spark):
    nothing = sketches.accumulate(spark.createDataFrame([], "sample string, seq string"))
    assert not sketches.frequent(nothing).collect() and not sketches.distinct(sketches.combine(nothing, nothing)).collect()
    with pytest.raises(ValueError, match="lists all of more than"):
        sketches.frequent(nothing, least_percent=0.01)
