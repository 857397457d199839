import random

from millrace.llm.ranking import first_places, rank_items

S = ["x", "y", "z"]
SCHEMA = "g long, i long, x double, y double, z double, rank_x string"


def brute(rows, weights):
    best = {}
    for g, i, *vs, _ in rows:
        if g is None or i is None:
            continue
        vs = [None if v is None or v != v else v for v in vs]
        old = best.get((g, i), [None] * 3)
        best[g, i] = [max((w for w in p if w is not None), default=None) for p in zip(old, vs)]
    out = {}
    for g in {k[0] for k in best}:
        items = {i: v for (h, i), v in best.items() if h == g}
        for i, v in items.items():
            ranks = []
            for k in range(3):
                merit = lambda x: (x is not None, x or 0.0)
                a = [merit(w[k]) for w in items.values()]
                b = merit(v[k])
                ranks.append(sum(x > b for x in a) + 1 + (sum(x == b for x in a) - 1) / 2)
            order = sorted(zip(ranks, weights))
            half, total, low, high = sum(weights) / 2, 0, None, None
            for r in sorted(set(ranks)):
                total = sum(w for x, w in order if x <= r)
                low = r if low is None and total >= half - 1e-12 else low
                high = r if high is None and total > half + 1e-12 else high
            out[g, i] = (*ranks, (low + high) / 2, sum(r * w for r, w in zip(ranks, weights)) / sum(weights))
    return out


def sample():
    random.seed(3)
    value = lambda: random.choice([None, float("nan"), float("-inf"), 0.0, -0.0, 1.0, 2.0, random.random() * 1e6, -5.0])
    rows = [(random.choice([1, 1, 1, 2, 3]), random.randint(1, 60), value(), value(), value(), "z") for _ in range(200)]
    return rows + rows[:5] + [(None, 1, 1.0, 1.0, 1.0, "z"), (1, None, 1.0, 1.0, 1.0, "z"), (9, 1, None, None, None, "z")]


def test_against_brute_force_in_both_ways(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    for weights in ([1.0, 1.0, 1.0], [3.0, 1.0, 1.0]):
        expected = brute(rows, weights)
        for group_rows in (10_000, 20):  # whole groups, and large ones in ranges
            got = {(r["g"], r["i"]): tuple(r)[2:] for r in rank_items(df, "g", "i", S, weights, group_rows).collect()}
            assert got.keys() == expected.keys()
            assert all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], expected[k]))


def test_places_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, 5, 1.0, 1.0, 1.0, ""), (1, 4, 1.0, 1.0, 1.0, ""), (1, 3, 9.0, 0.0, 1.0, ""), (1, 2, 1e300, 0.0, 0.0, "")], SCHEMA)
    got = sorted((r["place"], r["i"]) for r in first_places(rank_items(df, "g", "i", S), "g", "i", 3).collect())
    assert got == [(1, 4), (2, 5), (3, 3)]
    assert rank_items(df.limit(0), "g", "i", S).count() == 0
