from datetime import datetime, timedelta

import pytest

from codeweft.operators import hotkeys

BASE = datetime(2025, 1, 1)


def brute(rows, n=3):
    best = {}
    for t, k, s, w, *_ in rows:
        if None not in (t, k, s, w) and s != t:
            best[(t, k, s)] = max(best.get((t, k, s), w), w)
    out = set()
    for key in {x[:2] for x in best}:
        mine = sorted(((w, -s) for (t, k, s), w in best.items() if (t, k) == key), reverse=True)[:n]
        out |= {(*key, -s) for w, s in mine}
    return out


@pytest.mark.parametrize("held,kept", [(1 << 19, 1 << 18), (40, 10)])
def test_latest_of_hot_keys(spark, monkeypatch, held, kept):
    """Ties, repeated rows, nulls, self-loops, a hot key, clashing extra columns; with tables that overflow, too."""
    monkeypatch.setattr(hotkeys, "HELD", held)
    monkeypatch.setattr(hotkeys, "KEPT", kept)
    rows = [(1 if i % 3 else i % 7, "calls" if i % 2 else "imports", (i * 7919) % 101, BASE + timedelta(minutes=(i * 31) % 17), "x") for i in range(900)]
    rows += rows[:50] + [(None, "calls", 1, BASE, "x"), (1, None, 1, BASE, "x"), (1, "calls", None, BASE, "x"), (1, "calls", 2, None, "x"), (5, "calls", 5, BASE, "x")]
    df = spark.createDataFrame(rows, "target_id long, kind string, source_id long, written_at timestamp, place string").repartition(5)
    got = hotkeys.latest_per_key(df, ["target_id", "kind"], "source_id", "written_at", 3, "target_id")
    assert {(r["target_id"], r["kind"], r["source_id"]) for r in got.collect()} == brute(rows)
    assert got.count() == len(brute(rows))
    assert hotkeys.latest_per_key(df.limit(0), ["target_id", "kind"], "source_id", "written_at").count() == 0


def test_only_states_are_shuffled(spark):
    """A key with very many rows sends n rows from each task."""
    df = spark.range(0, 40_000, 1, 4).selectExpr("0L AS k", "id AS m", "timestamp_micros(id) AS w")
    got = hotkeys.latest_per_key(df, ["k"], "m", "w", 3)
    rows = got._jdf.queryExecution().executedPlan().toString()
    assert rows.count("Exchange") == 1 and [r["m"] for r in got.orderBy("place").collect()] == [39_999, 39_998, 39_997]


def test_load(spark):
    df = spark.createDataFrame([(1, "a")] * 6 + [(2, "a")] * 3 + [(None, "b")], "t long, kind string")
    got = [(r["t"], r["n_rows"], r["share"], r["place"]) for r in hotkeys.key_load(df, ["t", "kind"], 2).orderBy("place").collect()]
    assert got == [(1, 6, 0.6, 1), (2, 3, 0.3, 2)]
    assert hotkeys.key_load(df.limit(0), ["t", "kind"]).count() == 0
