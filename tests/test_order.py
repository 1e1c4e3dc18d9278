"""Reads that promise an order give their rows in it."""

import pytest
from conftest import SMALL

from epiweave.operators import aggregates, snapshot
from epiweave.sources import testdata

READS = {
    "weekly_trends": lambda s: (aggregates.weekly_trends(testdata.hosp(s, SMALL)), lambda r: (r.week_ending_date, r.virus)),
    "ari_history": lambda s: (snapshot.ari_history(testdata.ari(s, SMALL)), lambda r: (-r.week_end.toordinal(), r.geography)),
    "risk_distribution": lambda s: (aggregates.risk_distribution(testdata.ari(s, SMALL)), lambda r: (-r["count"], r.label)),
    "wastewater_states": lambda s: (aggregates.wastewater_states(testdata.ww(s, SMALL)), lambda r: (-r.avg_percentile, r.state)),
    "age_heatmap": lambda s: (
        aggregates.age_heatmap(testdata.hosp(s, SMALL)),
        lambda r: (r.week_ending_date, r.age_group, r.surveillance_network),
    ),
    "season_comparison": lambda s: (
        aggregates.season_comparison(testdata.hosp(s, SMALL)),
        lambda r: (r.surveillance_network, r.season, r.mmwr_week),
    ),
}


@pytest.mark.parametrize("name", READS)
def test_order(spark, name):
    frame, key = READS[name](spark)
    found = frame.collect()
    assert len(found) > 1 and found == sorted(found, key=key)
