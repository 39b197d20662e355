import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.spikes import spikes

SCHEMA = "id long, s1 string, s2 string, pos int, value double, piece long, readings string"


def series(n, level=100.0, noise=0.05, seed=1):
    return level * np.exp(np.random.default_rng(seed).normal(0, noise, n))


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = spikes(df, id_col="id", source=["s1", "s2"], position="pos", value="value").collect()
    assert len({r["id"] for r in out}) == len(out)
    return {r["id"]: r["reason"] for r in out}


def rows_of(values, start=0, s1="a", s2="x"):
    return [(start + i, s1, s2, i + 1, None if v is None else float(v), 7, "clash") for i, v in enumerate(values)]


def test_spikes_level_changes_stuck_and_impossible(spark):
    v = list(series(80))
    v[20] *= 3
    v[40], v[41], v[42] = v[40] / 3, v[41] / 3, v[42] / 3
    v[60:68] = [v[60]] * 8
    v[5], v[70], v[71] = -1.0, 5e6, None
    assert found(spark, rows_of(v)) == {20: "off_level", 40: "off_level", 41: "off_level", 42: "off_level", 5: "impossible", 70: "impossible", **{i: "stuck" for i in range(60, 68)}}


def test_a_level_that_stays_is_no_case(spark):
    v = np.r_[series(40), series(40, level=300, seed=2)]
    assert found(spark, rows_of(v)) == {}


@pytest.mark.parametrize("size", [5, 6, 7])
def test_a_burst_after_which_the_source_is_back(spark, size):
    v = series(80)
    v[30 : 30 + size] *= 4
    assert found(spark, rows_of(v)) == {i: "off_level" for i in range(30, 30 + size)}


def test_repeats_and_five_equal_values_count_once(spark):
    v = list(series(40))
    v[10:15] = [v[10]] * 5
    v[30] *= 4
    rows = rows_of(v)
    assert found(spark, rows + rows[28:33] + rows[8:16]) == {30: "off_level"}


def test_nulls_everywhere(spark):
    v = list(series(30))
    v[12] *= 5
    rows = rows_of(v, s1=None) + [(100, None, None, None, 0.0, None, None), (101, None, None, None, 5.0, None, None), (102, "b", "b", 1, None, None, None), (103, "b", "b", 2, float("nan"), None, None)]
    assert found(spark, rows) == {12: "off_level", 100: "impossible"}


def test_positions_may_begin_below_one(spark):
    v = list(series(40))
    v[0], v[20] = v[0] * 5, v[20] * 5
    rows = [(i, s1, s2, pos - 3, *rest) for i, s1, s2, pos, *rest in rows_of(v)]
    assert found(spark, rows) == {0: "off_level", 20: "off_level"}


@pytest.mark.parametrize("step", [1, 10, 50, 100])
def test_gaps_between_positions_change_nothing(spark, step):
    v = list(series(60))
    v[20] *= 3
    v[40:48] = [v[40]] * 8
    rows = [(i, s1, s2, pos * step, *rest) for i, s1, s2, pos, *rest in rows_of(v)]
    assert found(spark, rows) == {20: "off_level", **{i: "stuck" for i in range(40, 48)}}


def test_pieces_flag_what_the_uncut_filter_flags(spark):
    from tidemark.operators.spikes import flag_series

    g = np.random.default_rng(5)
    v = 100 * np.exp(np.cumsum(g.normal(0, 0.005, 6000)) + g.normal(0, 0.05, 6000))
    at = g.choice(6000, 60, replace=False)
    v[at] *= np.where(g.random(60) < 0.5, 3.0, 0.3)
    v[2000:2010] = v[2000]
    off, held = flag_series(v[None, :], np.ones((1, 6000), bool))
    want = {int(i): "stuck" if held[0, i] else "off_level" for i in np.flatnonzero(off[0] | held[0])}
    got = found(spark, rows_of(v))
    assert len(want) > 60 and len(set(want.items()) ^ set(got.items())) <= 1


def test_many_rows_at_one_position_or_without_one(spark):
    v = list(series(3000))
    rows = [(i, "a", "x", None if i % 2 else 7, float(x), None, "c") for i, x in enumerate(v)] + [(9000, "a", "x", None, -3.0, None, "c")] * 500
    assert found(spark, rows) == {9000: "impossible"}


def test_short_sources_and_empty_tables(spark):
    assert found(spark, rows_of([1.0, 100.0, 1.0])) == {}
    assert found(spark, []) == {}


def test_a_long_source_is_cut_without_changing_the_result(spark):
    v = series(3000, noise=0.03)
    at = [3, 255, 256, 257, 700, 1023, 1024, 1500, 2047, 2999 - 8]
    for i in at:
        v[i] *= 2.5
    v[511:518] = v[511]
    got = found(spark, rows_of(v))
    assert {i for i, r in got.items() if r == "off_level"} == set(at)
    assert {i for i, r in got.items() if r == "stuck"} == set(range(511, 518))


def test_many_sources_of_unlike_length(spark):
    rows, want = [], set()
    for k in range(60):
        v = series(20 + k, level=10.0 + k, seed=k)
        v[10] *= 4
        want.add(k * 1000 + 10)
        rows += rows_of(v, start=k * 1000, s1=f"s{k}")
    assert set(found(spark, rows)) == want


def test_other_columns_are_left_alone(spark):
    df = spark.createDataFrame(rows_of(series(20)), SCHEMA).withColumn("tm_s0", F.lit(1)).withColumn("r", F.lit(2))
    assert spikes(df, id_col="id", source=["s1", "s2"], position="pos", value="value").columns == ["id", "value", "reason"]


@pytest.mark.parametrize("noise", [0.01, 0.1, 0.2])
def test_no_false_alarm_on_plain_noise(spark, noise):
    rows = [r for k in range(40) for r in rows_of(series(100, noise=noise, seed=k), start=k * 1000, s1=f"s{k}")]
    assert len(found(spark, rows)) <= 1
