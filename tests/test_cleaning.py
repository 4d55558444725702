import datetime

import numpy as np
import pytest

from fathomline.operators import cleaning


def naive(v, threshold, rounds=None):
    v, done = v.copy(), 0
    while rounds is None or done < rounds:
        bend = np.diff(v, 2)
        if np.isnan(bend).all():
            break
        size = np.abs(bend) / np.nanstd(bend)
        at = int(np.nanargmax(size))
        if not size[at] > threshold:
            break
        v[at + 1] = np.nan
        done += 1
    return v


def series(seed, n=120, holes=True):
    rng = np.random.default_rng(seed)
    v = np.round(np.cumsum(rng.normal(size=n)), 3)
    v[rng.integers(0, n, 6)] += rng.normal(size=6) * 60
    if holes:
        v[rng.integers(0, n, 5)] = np.nan
    return v


@pytest.mark.parametrize("rounds", [1, 3, None])
def test_spikes_by_order_of_size_are_those_of_repeated_search(rounds):
    for seed in range(40):
        v = series(seed, n=int(np.random.default_rng(seed).integers(3, 160)) + 6)
        got = v.copy()
        got[cleaning.spikes_of(v, 3.0, rounds)] = np.nan
        assert np.array_equal(got, naive(v, 3.0, rounds), equal_nan=True)


def test_spikes_of_short_flat_and_missing_series():
    for v in ([], [1.0], [1.0, 9.0], [2.0] * 9, [np.nan] * 5):
        assert len(cleaning.spikes_of(np.array(v, dtype=float), 3.0, None)) == 0


def test_without_spikes_keeps_rows_null_keys_and_clashing_names(spark):
    rows = [(k, i, None if np.isnan(x) else float(x), f"r{k}{i}") for k, seed in ((None, 1), ("a", 2)) for i, x in enumerate(series(seed))]
    rows.append(("b", 0, float("nan"), "rb0"))
    df = spark.createDataFrame(rows, "key string, at int, value double, _v string")
    got = {(r.key, r.at): (r.clean, r._v) for r in cleaning.without_spikes(df, ["key"], ["at"], "value", 3.0, None).collect()}
    assert len(got) == len(rows)
    for k, seed in ((None, 1), ("a", 2)):
        want = naive(series(seed), 3.0)
        assert [got[k, i][0] for i in range(len(want))] == [None if np.isnan(x) else x for x in want]
        assert got[k, 5][1] == f"r{k}5"
    assert got["b", 0][0] is None
    assert cleaning.without_spikes(df.limit(0), ["key"], ["at"], "value").count() == 0


def test_in_water_drops_the_ends_in_the_air(spark):
    rows = [(k, i, v) for k in (None, "a") for i, v in enumerate([0.0, 30.0, 31.0, None, 5.0, 30.5, 31.0, 30.2, float("nan"), 0.2])]
    rows += [("flat", i, 1.0) for i in range(4)] + [("void", 0, None)]
    got = sorted((str(r.k), r.i) for r in cleaning.in_water(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "i", "v").collect())
    assert got == [(k, i) for k in ("None", "a") for i in range(1, 7)]


def test_fixes_forget_what_came_before_the_last(spark):
    rows = [
        ("s", 1, False, 10, None, None), ("s", 2, False, None, 5.0, None), ("s", 3, True, None, None, 1.0), ("s", 4, True, None, None, 2.0),
        ("s", 5, False, 19, None, None), ("s", 6, False, 20, None, None), ("s", 7, None, None, 7.0, None), ("s", 8, True, None, None, 3.0), (None, 1, True, None, None, 9.0),
    ]
    df = spark.createDataFrame(rows, "ship string, at int, fix boolean, ens int, gps double, lat double")
    found = cleaning.fixes(df, ["ship"], ["at"], "fix", "ens", "gps")
    assert {(r.ship, r.at): (r.ens, r.gps, r.lat) for r in found.collect()} == {("s", 3): (10, 5.0, 1.0), ("s", 4): (None, None, 2.0), ("s", 8): (20, 7.0, 3.0), (None, 1): (None, None, 9.0)}
    asked = spark.createDataFrame([("s", n) for n in (9, 10, 15, 20, 21, None)] + [(None, 10)], "ship string, ens int")
    got = {(r.ship, r.ens): (r.lat, r.gps) for r in cleaning.positioned(asked, found, ["ship"], ["at"], "ens", ["lat", "gps"]).collect()}
    assert got == {("s", 9): (None, None), ("s", 10): (1.0, 5.0), ("s", 15): (2.0, 6.0), ("s", 20): (3.0, 7.0), ("s", 21): (None, None), ("s", None): (None, None), (None, 10): (None, None)}


def test_positioned_takes_the_last_of_equal_numbers_and_skips_missing_values(spark):
    found = spark.createDataFrame([(1, 0, 0.0, 1.0), (2, 0, 4.0, None), (3, 5, None, 6.0), (4, 10, 14.0, 16.0)], "at int, ens int, lat double, lon double")
    got = {r.ens: (r.lat, r.lon) for r in cleaning.positioned(spark.range(0, 11).selectExpr("int(id) as ens"), found, [], ["at"], "ens", ["lat", "lon"]).collect()}
    assert got[0] == (4.0, None) and got[5] == (9.0, 6.0) and got[8] == (12.0, 12.0)
    assert cleaning.positioned(spark.range(0).selectExpr("int(id) as ens"), found, [], ["at"], "ens", ["lat"]).count() == 0


def test_hours_set_moves_whole_hours(spark):
    t = datetime.datetime(2024, 1, 1)
    h = datetime.timedelta(hours=1)
    rows = [("a", t, t + 3 * h + h / 3), ("a", t + h, t + 4 * h), ("a", t + 2 * h, None), ("b", t, None), (None, t, t - 2 * h)]
    got = {(r.k, r.ts): r.set for r in cleaning.hours_set(spark.createDataFrame(rows, "k string, ts timestamp_ntz, true timestamp_ntz"), ["k"], "ts", "true").collect()}
    assert got == {("a", t): t + 3 * h, ("a", t + h): t + 4 * h, ("a", t + 2 * h): t + 5 * h, ("b", t): t, (None, t): t - 2 * h}
