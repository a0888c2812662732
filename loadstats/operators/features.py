"""One shared feature builder for training and serving.

Calendar terms, lags and trailing statistics are computed per city over the
full history; date-range filters are applied afterwards (T6). Differences and
percentage changes are taken one step back, so no feature contains the
current target (T4); the target's own scaling is never a feature (T5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from .frames import POS, framed, sliding, with_position
from .series import pct_change_expr

# Lags and the trailing window in hours, and its statistics.
LAGS = (24, 48, 168)
DAY = 24
ROLLING = ("mean", "std", "min", "max")


def forecast_features(df: DataFrame, col: str = "demand") -> tuple[DataFrame, list[str]]:
    """Calendar, lag and trailing-window features in one windowed pass."""
    t = F.col("timestamp")
    base = df.select("*", F.hour(t).alias("hour"), cal.dayofweek_mon0(t).alias("dayofweek"),
                     F.dayofmonth(t).alias("day"), F.month(t).alias("month"))

    def feats(w):
        lag = lambda n: F.lag(col, n).over(w)
        return [*[lag(n).alias(f"demand_lag_{n}h") for n in LAGS],
                (lag(1) - lag(25)).alias("demand_diff_1d_prev"),
                pct_change_expr(lag(1), lag(25)).alias("demand_pct_change_1d_prev")]

    rolling = {(DAY, stat): f"demand_rolling_{stat}_{DAY}h" for stat in ROLLING}
    placed = framed(with_position(base, "city"), feats, back=max(LAGS), positioned=True)
    out = sliding(placed, col, rolling, positioned=True).drop(POS)
    cyc = []
    for name, period in cal.CYCLE_PERIODS.items():
        cyc += [cal.cyclical(name, period, "sin").alias(f"{name}_sin"), cal.cyclical(name, period, "cos").alias(f"{name}_cos")]
    out = out.select("*", *cyc, cal.is_weekend("dayofweek").alias("is_weekend"), *cal.day_part_onehot("hour"))
    names = [f"{n}_{f}" for n in cal.CYCLE_PERIODS for f in ("sin", "cos")]
    names += ["is_weekend", *[f"day_part_{i}" for i in range(4)], *[f"demand_lag_{n}h" for n in LAGS], *rolling.values(),
              "demand_diff_1d_prev", "demand_pct_change_1d_prev"]
    return out, names
