import math

import pytest

from millrace.llm import mixing


def test_temperatures():
    shares = [0.7, 0.2, 0.1, 0.0]
    a, w = mixing.temperature_weights(shares, entropy=0.95)
    assert 0 < a < 1 and abs(-sum(x * math.log(x) for x in w if x) - 0.95) < 1e-6 and w[3] == 0
    b, v = mixing.temperature_weights(shares, limits=[1, 0.3, 0.25, 1])
    assert v[1] <= 0.3 + 1e-9 and v[2] <= 0.25 + 1e-9 and 0 < b < 1
    assert mixing.temperature_weights([0.0], entropy=1.0) == (0.0, [0.0]) and mixing.temperature_weights(shares[:3], entropy=math.log(3))[0] == 0.0
    own = mixing._entropy(shares)
    for aim in (0.05, 0.3, own - 0.01, own, own + 0.01, 1.05):  # below the shares' own entropy the exponent is beyond 1
        a, w = mixing.temperature_weights(shares, entropy=aim)
        assert abs(mixing._entropy(w) - aim) < 1e-6 and abs(sum(w) - 1) < 1e-9 and (a > 1) == (aim < own)
    for bad in ({"entropy": 2.0}, {"limits": [0.1, 0.1, 0.1, 1]}):
        with pytest.raises(ValueError):
            mixing.temperature_weights(shares, **bad)
    with pytest.raises(ValueError):
        mixing.temperature_weights([0.5, 0.5], entropy=0.1)


def build(spark, monkeypatch, rows, targets, **more):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 7)  # many blocks
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    t = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    mixed, report = mixing.mix_documents(sized, t, sized=sized, **more)
    return mixed.collect(), {(r["mix_name"], r["source"]): r for r in report.collect()}


def test_budgets_and_repeats(spark, monkeypatch):
    rows = [(i, "big", 10) for i in range(100)] + [(1000 + i, "small", 5) for i in range(4)] + [(2000, None, 9), (2001, "big", 0)]
    mixed, report = build(spark, monkeypatch, rows, [("m", "big", 0.5, 1), ("m", "small", 0.4, 3), ("m", "gone", 0.1, 9), ("m", "small", 0.4, 3), ("n", "small", 1.0, 2)])
    assert report["m", "small"]["actual_tokens"] == 60 and report["m", "small"]["most_repeats"] == 3  # all it may give
    assert report["m", "big"]["planned_tokens"] == 510 and abs(report["m", "big"]["actual_tokens"] - 510) <= 5
    assert report["m", "gone"]["actual_tokens"] == 0 and abs(sum(report["m", s]["actual_share"] for s in ("big", "small", "gone")) - 1) < 1e-5
    assert report["n", "small"]["actual_share"] == 1.0 and len(report) == 4
    assert report["m", "small"]["undelivered_tokens"] == round(0.4 * 1020) - 60 and report["m", "small"]["share_of_total"] == round(60 / 1020, 6)
    assert all(r["repeats"] <= 3 for r in mixed) and len({(r["mix_name"], r["doc_id"]) for r in mixed}) == len(mixed)


def test_a_larger_total_and_an_empty_table(spark, monkeypatch):
    rows = [(i, "s", 3) for i in range(30)]
    _, report = build(spark, monkeypatch, rows, [("m", "s", 1.0, 4)], total_tokens=200)
    assert abs(report["m", "s"]["actual_tokens"] - 200) <= 2 and report["m", "s"]["most_repeats"] == 3
    mixed, report = build(spark, monkeypatch, [], [("m", "s", 1.0, 4), ("m", None, None, None)])
    assert mixed == [] and report["m", "s"]["actual_share"] == 0.0


def test_texts(spark):
    docs = spark.createDataFrame([(1, "one two three", "a", 0), (1, "one two three", "a", 0), (2, None, "a", 0), (3, "", "b", 0), (4, "x", None, 0)], "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    mixed, _ = mixing.mix_documents(docs, targets)
    assert [r["doc_id"] for r in mixed.collect()] == [1, 1]


def test_a_mix_of_tempered_weights(spark, monkeypatch):
    rows = [(i, "big", 10) for i in range(300)] + [(1000 + i, "mid", 10) for i in range(60)] + [(2000 + i, "small", 10) for i in range(20)]
    targets = [("m", "big", 0.5, 4), ("m", "mid", 0.3, 4), ("m", "small", 0.2, 4), ("m", "gone", 0.0, 4)]
    shares = [300 / 380, 60 / 380, 20 / 380]
    for by, given in (("entropy", {"entropy": mixing._entropy([0.5, 0.3, 0.2])}), ("limits", {"limits": [4 * s for s in shares]})):
        mixed, report = build(spark, monkeypatch, rows, targets, weights=by)
        _, w = mixing.temperature_weights(shares, **given)
        assert all(abs(report["m", s]["actual_tokens"] - x * 3800) <= 6 for s, x in zip(("big", "mid", "small"), w)) and report["m", "gone"]["actual_tokens"] == 0
        assert abs(sum(report["m", s]["target_share"] for s in ("big", "mid", "small", "gone")) - 1) < 1e-9 and max(r["repeats"] for r in mixed) <= 4
