"""Mean daily rates that equal a threshold, in any order of the facts."""

import datetime as dt

from gridcast.operators import clean
from gridcast.operators import quality as Q

DAY = dt.date(2024, 1, 1)
FACTS = "station string, date date, total_points long, orig_missing long, orig_missing_rate double"


def _facts(spark, orders):
    """Days of several stations from rates given as (missing, points)."""
    rows = [(s, DAY + dt.timedelta(i), n, m, m / n if n else 0.0) for s, o in orders.items() for i, (m, n) in enumerate(o)]
    return spark.createDataFrame(rows, FACTS).coalesce(1)


def test_mean_rate_at_the_threshold_is_exact(spark):
    # 40 days whose rates add up to 8: sums of doubles miss the mean of 0.2 on one side or the other.
    rates = [(1, 3)] * 12 + [(2, 3)] * 3 + [(1, 7)] * 14 + [(0, 1)] * 11
    up = sorted(rates, key=lambda r: r[0] / r[1])
    orders = {"up": up, "down": up[::-1], "given": rates, **{f"turned {k}": rates[k:] + rates[:k] for k in range(1, 40)}}
    summary = Q.station_summary(_facts(spark, orders))
    assert {r["avg_daily_missing_rate"] for r in summary.collect()} == {0.2}
    assert clean.bad_stations(summary, 0.2).count() == 0
    assert clean.candidate_stations(summary, 0.2).count() == len(orders)


def test_mean_rate_of_no_points_is_zero(spark):
    assert Q.station_summary(_facts(spark, {"a": [(0, 0), (1, 2)]})).first()["avg_daily_missing_rate"] == 0.25
