"""Profiles from folded states against the profile of all events."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.profile import profile
from tidemark.plans.base import events
from tidemark.streaming.profiles import fold, profile_of, states

SF = "/root/testdata/sf0.001"


def values(df):
    return {r.user: [round(v, 9) + 0.0 for v in r[1:]] for r in df.collect()}


@pytest.mark.parametrize("cuts", [[], [1704400000], [1704153600, 1704153601, 1705000000, 1706000000]])
def test_states_of_any_cut_give_the_profile(spark, cuts):
    e = events(spark, SF).select("user", "ts", "action", "event_id")
    # equal seconds, also across a cut, and accounts of one event
    more = spark.createDataFrame([(1000, 1704400000, 0, -1), (1000, 1704400000, 1, -2), (1001, 1704399999, 2, -3)], e.schema)
    e = e.unionByName(more).cache()
    bounds, state = [0, *cuts, 1 << 40], None
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        new = states(e.filter((F.col("ts") >= lo) & (F.col("ts") < hi)), ["user"])
        state = new if state is None else fold(state, new, ["user"]).checkpoint()
    assert values(profile_of(state, ["user"])) == values(profile(e, ["user"]))


def test_a_cut_inside_a_second(spark):
    rows = [(1, 100, 0, 1), (1, 100, 1, 2), (1, 160, 2, 3)]
    e = spark.createDataFrame(rows, "user long, ts long, action long, event_id long")
    state = fold(states(e.filter("event_id = 1"), ["user"]), states(e.filter("event_id > 1"), ["user"]), ["user"])
    assert values(profile_of(state, ["user"])) == values(profile(e, ["user"]))


def test_older_events_are_refused(spark):
    e = spark.createDataFrame([(1, 100, 0, 1), (1, 50, 1, 2)], "user long, ts long, action long, event_id long")
    with pytest.raises(Exception, match="older than"):
        fold(states(e.filter("ts = 100"), ["user"]), states(e.filter("ts = 50"), ["user"]), ["user"]).collect()
