import random

from codeweft.llm.topn import top_n_per_group


def test_equals_brute_force_with_ties_copies_and_hot_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 0, 1, 2]), rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), rng.choice([None, float("nan"), float("inf"), 0.0, -0.0, 0.5, 0.25]), "x") for _ in range(400)]
    rows += [(0, "a", k, 0.5, "y") for k in range(100, 600)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "community int, kind string, id int, rank double, place string")
    best = {}
    for c, k, i, r, _ in rows:
        if None not in (c, k, i, r) and r == r:
            best[c, k, i] = max(r, best.get((c, k, i), r))
    want = set()
    for g in {x[:2] for x in best}:
        want |= {(*g, x[2]) for x in sorted((x for x in best if x[:2] == g), key=lambda x: (-best[x], x[2]))[:5]}
    got = top_n_per_group(df, ["community", "kind"], "rank", "id", 5)
    assert {tuple(r)[:3] for r in got.collect()} == want
    assert top_n_per_group(df.limit(0), ["community", "kind"], "rank", "id").count() == 0


def test_places_are_the_same_with_any_number_of_salts(spark):
    df = spark.createDataFrame([(1, k, float(k % 3)) for k in range(50)], "g int, id int, s double")
    a, b = ([tuple(r) for r in top_n_per_group(df, ["g"], "s", "id", 7, n).orderBy("place").collect()] for n in (1, 16))
    assert a == b and [x[1] for x in a] == [2, 5, 8, 11, 14, 17, 20]
