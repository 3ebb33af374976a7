import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabwright.operators import order_stats as O


@pytest.mark.parametrize("kind", ["ties", "spread", "one value", "two values"])
def test_selection_matches_sorting(spark, kind):
    rng = random.Random(3)
    make = {
        "ties": lambda: 7.0 if rng.random() < 0.5 else float(rng.randrange(50)),
        "spread": lambda: rng.gauss(0, 1e6),
        "one value": lambda: 4.0,
        "two values": lambda: float(rng.random() < 0.5),
    }[kind]
    values = [make() for _ in range(2500)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    ranks = [0, 1, 624, 1249, 1250, 2498, 2499]
    n, found = O.order_statistics(df, {"x": lambda n: ranks}, small_rows=8)["x"]
    ordered = sorted(values)
    assert n == 2500 and found == {r: ordered[r] for r in ranks}


def test_median_is_exact_and_ignores_null(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,), (None,)], "x long")
    assert O.medians(df, ["x"]) == {"x": 2.5}
    assert O.medians(df.filter("false"), ["x"]) == {"x": None}


def test_nan_sorts_last(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)] * 10, "x double")
    n, found = O.order_statistics(df, {"x": lambda n: [0, 19, 20]}, small_rows=2)["x"]
    assert found[0] == 1.0 and found[19] == 2.0 and np.isnan(found[20])


def test_many_ranks_share_one_search_of_each_row(spark):
    """An expression for each rank and row would make the plan, and the work on a row, grow with the ranks."""
    rng = random.Random(5)
    special = [float("inf")] * 90 + [float("-inf")] * 70 + [float("nan")] * 80 + [0.0, -0.0] * 60
    values = [*special, *(round(rng.gauss(0, 10), 2) for _ in range(9640))]
    df = spark.createDataFrame([(v, i, None) for i, v in enumerate(values)] + [(None, None, None)], "x double, y long, z int").repartition(3)
    ranks = list(range(0, 10_000, 9))
    found = O.order_statistics(df, {"x": lambda n: ranks, "y": lambda n: ranks, "z": lambda n: [0]}, small_rows=40)
    ordered = sorted(values, key=lambda v: (np.isnan(v), v))
    assert found["x"][0] == 10_000 and list(found["x"][1]) == ranks
    assert np.array_equal([found["x"][1][r] for r in ranks], [ordered[r] for r in ranks], equal_nan=True)
    assert found["y"] == (10_000, {r: float(r) for r in ranks}) and found["z"] == (0, {})


def test_groups_share_passes_without_a_row_for_each_group(spark, monkeypatch):
    """Each pass takes a row of the table once, however many groups there are."""
    rng = random.Random(9)
    special = [float("inf")] * 60 + [float("-inf")] * 50 + [float("nan")] * 70 + [0.0, -0.0] * 40
    values = {
        "a": [*special, *(round(rng.gauss(0, 10), 2) for _ in range(4000))],
        "b": [rng.gauss(0, 1e6) for _ in range(40_000)],
        "c": [4.0] * 300,
        "d": [rng.random() for _ in range(20)],
        "e": [],
        "else": [1.0] * 100,
    }
    rows = [(k, v) for k, some in values.items() for v in some] + [("a", None), ("e", None), (None, 2.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    passes, placed = [], O._placed
    monkeypatch.setattr(O, "_placed", lambda *args: passes.append(placed(*args)) or passes[-1])
    ranks = lambda n: sorted({0, n // 100, n // 2, n - 1}) if n else []
    found = O.group_order_statistics(df, "k", "v", dict.fromkeys("abcde", ranks), small_rows=2)
    for k in "abcde":
        ordered = sorted(values[k], key=lambda v: (np.isnan(v), v))
        assert found[k][0] == len(ordered) and list(found[k][1]) == ranks(len(ordered))
        assert np.array_equal([*found[k][1].values()], [ordered[r] for r in found[k][1]], equal_nan=True)
    assert len(passes) > 2 and all(p.count() <= sum(len(values[k]) for k in "abcde") for p in passes)
    assert not any("Generate" in p._jdf.queryExecution().toString() for p in passes)
    assert O.group_order_statistics(df, "k", "v", {}) == {}
    with pytest.raises(TypeError):
        O.group_order_statistics(df, "v", "k", {1.0: ranks})


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.floats(0, 1))
def test_nearest_quantile(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    want = sorted(values)[round((len(values) - 1) * q)]
    assert O.nearest_quantiles(df, {"x": [q]}, small_rows=3) == {"x": {q: float(want)}}


def test_approximate_quantiles(spark):
    got = O.nearest_quantiles(spark.range(1001), {"id": [0.25, 0.75]}, approx=True)
    assert abs(got["id"][0.25] - 250) <= 1 and abs(got["id"][0.75] - 750) <= 1


def test_mode_takes_the_lowest_on_ties(spark):
    rows = [(c,) for c in ["b", "b", "a", "a", None, None, None]]
    df = spark.createDataFrame(rows, "c string")
    assert O.modes(df, ["c"]) == {"c": "a"}
    assert O.modes(df.filter("c is null"), ["c"]) == {"c": None}


def test_text_columns_are_refused(spark):
    with pytest.raises(TypeError):
        O.medians(spark.createDataFrame([("a",)], "c string"), ["c"])
