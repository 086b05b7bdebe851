"""Dates, pitch geometry and match-clock expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitchgrid.settings import (
    AGE_FACTOR_OLD, AGE_FACTOR_YOUNG, AGE_OLD, AGE_YOUNG, LANE_LEFT_FROM, LANE_RIGHT_BELOW,
    YEAR_DAYS,
)


def naive_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone is."""
    t = ts.cast("timestamp_ntz")
    minutes = (F.unix_date(t.cast("date")).cast("bigint") * 24 + F.hour(t)) * 60 + F.minute(t)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def naive_text(instant: Column) -> Column:
    """Inverse of reading naive microseconds as an instant: yyyy-MM-dd HH:mm:ss text."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01").cast("timestamp_ntz")).cast("string")


def iso_date(text: Column) -> Column:
    """First ten characters as a date, null where they are not one."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def day_month_year(text: Column) -> Column:
    """dd/mm/yyyy or dd/mm/yy (20yy)."""
    year = F.split_part(text, F.lit("/"), F.lit(3))
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.try_to_date(
        F.concat_ws("-", full, F.split_part(text, F.lit("/"), F.lit(2)), F.split_part(text, F.lit("/"), F.lit(1))),
        "y-M-d",
    )


def age_on(birth: Column, on: Column) -> Column:
    return F.round(F.datediff(on, birth) / YEAR_DAYS, 2)


def age_factor(age: Column) -> Column:
    slope = (AGE_FACTOR_OLD - AGE_FACTOR_YOUNG) / (AGE_OLD - AGE_YOUNG)
    return (
        F.when(age.isNull(), 1.0)
        .when(age <= AGE_YOUNG, AGE_FACTOR_YOUNG)
        .when(age >= AGE_OLD, AGE_FACTOR_OLD)
        .otherwise(F.round(AGE_FACTOR_YOUNG + slope * (age - AGE_YOUNG), 4))
    )


def lane(y: Column) -> Column:
    return F.when(y >= LANE_LEFT_FROM, "left").when(y < LANE_RIGHT_BELOW, "right").when(
        y.isNotNull(), "central")


def toward_right(x: Column, attacks_right: bool = True) -> Column:
    return x if attacks_right else 100.0 - x


def third(x: Column) -> Column:
    return F.when(x < 100.0 / 3, "own").when(x > 200.0 / 3, "att").when(x.isNotNull(), "mid")


def rescale_x(x: Column) -> Column:
    return x * 100.0 / 120.0


def rescale_y(y: Column) -> Column:
    return y * 100.0 / 80.0


def goal_difference(side: Column, home: Column, away: Column) -> Column:
    return F.when(side == "HOME", home - away).otherwise(away - home)
