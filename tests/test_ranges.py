"""Range joins and positions against plain loops."""

import random
from datetime import datetime, timedelta

import pytest

from tallyglass.functions.ordering import global_position
from tallyglass.operators import incidents


@pytest.mark.parametrize("lookback,until", [(180, None), (180, 45), (0, 0), (0, None), (7.5, 3)])
def test_near_alerts(spark, lookback, until):
    rnd = random.Random(int(lookback))
    start = datetime(2024, 1, 1)
    when = lambda: start + timedelta(seconds=rnd.choice([rnd.randint(0, 90_000), 60 * rnd.randint(0, 1500)]))
    alerts = [(i, rnd.choice(["hot", "hot", "cold", None]), when()) for i in range(40)]
    data = [(i, rnd.choice(["hot", "hot", "hot", "cold", None]), when()) for i in range(150)]
    found = incidents.near_alerts(spark.createDataFrame(alerts, "a long, key string, fired_at timestamp"),
                                  spark.createDataFrame(data, "d long, key string, ts timestamp"), "key", lookback, until=until)
    got = sorted((r["a"], r["d"]) for r in found.collect())
    want = sorted((a, d) for a, k, t in alerts for d, k2, u in data if k and k == k2 and u >= t - timedelta(minutes=lookback)
                  and (until is None or u <= t + timedelta(minutes=until)))
    assert got == want


def test_pairs_that_fail_are_only_those_of_the_end_slots(spark):
    start = datetime(2024, 1, 1)
    data = spark.createDataFrame([(i, "hot", start + timedelta(minutes=i)) for i in range(3000)], "d long, key string, ts timestamp")
    alerts = spark.createDataFrame([(i, "hot", start + timedelta(minutes=700 * i, seconds=30)) for i in range(4)], "a long, key string, fired_at timestamp")
    empty = data.limit(0)
    assert incidents.near_alerts(alerts, empty, "key", 60).count() == 0
    assert incidents.near_alerts(alerts, data, "key", 60).count() == sum(3000 - max(0, 700 * i - 59) for i in range(4))


def test_positions_of_strings_and_nulls(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randint(0, 2), f"id-{rnd.randint(0, 60):03d}") for _ in range(300)] + [("a", 1, None)] * 2
    df = spark.createDataFrame(rows, "label string, major int, name string").repartition(5)
    got = global_position(df, ["label"], ["major"], "name").collect()
    assert len(got) == len(rows)
    for label in ("a", "b", None):
        mine = sorted((r for r in got if r["label"] == label), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(mine)))
        keys = [(r["major"], r["name"] or "") for r in mine]
        assert keys == sorted(keys)
    assert global_position(df.limit(0), ["label"], [], "name").count() == 0
