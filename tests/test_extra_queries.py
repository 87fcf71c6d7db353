import datetime
import random

from graphloom.plans import extra_queries


def test_single_flight_looks_at_any_earlier_call(spark):
    at = lambda minute, second=0: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=minute, seconds=second)
    rows = [(1, "u", "a", at(0)), (2, "u", "a", at(30)), (3, "u", "a", at(30)), (4, "u", "b", at(30)), (5, "u", "a", at(90)), (6, "u", "a", at(150, 1)), (7, "u", "a", at(150, 1)), (8, None, "a", at(0)), (9, None, "a", at(1)), (10, "u", None, at(1)), (11, "u", "a", None)]
    rng = random.Random(3)
    rows += [(100 + i, rng.choice("vw"), "c", at(rng.randrange(1500), rng.choice((0, 0, 30)))) for i in range(60)]
    want = sorted(i for i, u, t, ts in rows if not any(None not in (u, t, ts) and (u, t) == (v, s) and y is not None and y < ts <= y + datetime.timedelta(hours=1) for _, v, s, y in rows))
    df = spark.createDataFrame(rows, "event_id long, user_id string, event_type string, ts timestamp")
    assert {1, 4, 6, 7, 8, 9, 10, 11} <= set(want) and not {2, 3, 5} & set(want)
    assert sorted(r["seq"] for r in extra_queries.single_flight(df).collect()) == want
