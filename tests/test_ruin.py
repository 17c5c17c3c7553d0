"""A portfolio that loses all it has, and metrics that are a half at the last place."""

import datetime as dt
import math

import pytest
from compare import assert_same

from tidemark import plans
from tidemark.operators import portfolio, rules
from tidemark.plans import portfolios


def test_ruin_is_no_error(spark):
    rows = [("p", dt.date(2026, 1, k), "S", price, weight) for k, (price, weight) in enumerate([(10.0, 1.0), (0.001, 0.0), (0.001, 0.0), (1.0, 1.0), (2.0, 0.5)], 1)]
    df = spark.createDataFrame(rows, "portfolio string, date date, symbol string, close double, weight double")
    days = portfolio.master_portfolio_cost(df, 5.0, 1000.0)
    found = portfolios.reported(days).orderBy("date").collect()
    assert [r.equity for r in days.orderBy("date").collect()] == [1000.0, 0.0, 0.0, 0.0, 0.0]
    assert [r.log_equity for r in found][1:] == [-math.inf] * 4 and found[1].daily_return == -1 and [r.drawdown for r in found[1:]] == [-1] * 4
    assert all(math.isnan(r.cash_weight) for r in found[1:]) and all(math.isnan(r.daily_return) for r in found[2:])


@pytest.mark.parametrize("close", [0.5, 70.35])
def test_halves_of_the_last_place(spark, duck, tmp_path, close):
    """ROIs that end in a half of the fourth place, from prices of two places."""
    events = [(2 * k + j, dt.datetime(2026, 1, 1 + j), k, "view", value) for k in range(200) for j, value in enumerate((8.0, round(close + 8 * (k + 1) * 0.0001 * 6.25, 4)))]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duck.cursor()
    con.execute(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert_same(plans.queries()["psychology_state"](spark, str(tmp_path)), con, plans.oracle_sql()["psychology_state"])


def test_long_numbers_have_the_digits_of_their_double(spark, duck):
    """As C's printf writes them: Java has zeros behind a double's shortest digits."""
    numbers = [sign * 7.7 * 3.0**k + k / 7 for k in range(38) for sign in (1, -1)] + [99999999999.9999, 1e11, 1e14 + 0.03125, -95516354916179.0156, 2.0**53 + 2, math.inf, -math.inf]
    found = rules.psychology(spark.createDataFrame([(x, -abs(x), 0.5) for x in numbers], "roi double, drawdown double, win_rate double")).collect()
    for r in found:
        if r.state == "fear":
            roi, fall = duck.execute("SELECT printf('%.4f', ?::DOUBLE), printf('%.4f', ?::DOUBLE)", [r.roi, r.drawdown]).fetchall()[0]
            said = [f"drawdown {fall} is beyond fear threshold"]
            assert r.reason == "; ".join([f"ROI {roi} is below fear threshold"] * (r.roi <= -0.03) + said)
