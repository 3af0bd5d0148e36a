"""One pick a station and phase of an event, told without a row a pair in a shuffle."""

import pytest
from catalogflow.plans import queries as core

from .test_larger import made, same


@pytest.fixture(autouse=True)
def prepared(spark):
    core.prepare(spark)


@pytest.mark.parametrize("ids", ["range", "range % 550"])
def test_best_picks_need_no_window_over_pairs(spark, tmp_path, ids):
    events = f"SELECT {ids} AS event_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (range * 7919 % 20011) SECOND AS ts, range % 7 AS user_id, ['purchase', 'view', 'click'][range % 3 + 1] AS event_type, 100.0 AS value FROM range(900)"
    folder = made(tmp_path, events=events)
    got = same(spark, folder, "w05_one_pick_a_station", "events")
    assert len(got) > 100 and len(got) == len({(r.idx, r.station, r.phase) for r in got})
    if ids == "range":
        found = core.queries()["w05_one_pick_a_station"](spark, folder)
        assert "row_number()" not in found._jdf.queryExecution().optimizedPlan().toString()
