"""Holidays by rules against dates written down by hand."""

from datetime import date, datetime, timedelta

import pytest

from tidepanel.functions.calendars import easter, holidays, weekday
from tidepanel.operators.features import country_calendar, holiday_features

#: Easter Sundays of 1995 to 2030 (month, day), as printed in almanacs.
EASTERS = [(4, 16), (4, 7), (3, 30), (4, 12), (4, 4), (4, 23), (4, 15), (3, 31), (4, 20), (4, 11), (3, 27), (4, 16), (4, 8), (3, 23), (4, 12), (4, 4), (4, 24), (4, 8), (3, 31), (4, 20), (4, 5), (3, 27), (4, 16), (4, 1), (4, 21), (4, 12), (4, 4), (4, 17), (4, 9), (3, 31), (4, 20), (4, 5), (3, 28), (4, 16), (4, 1), (4, 21)]


def test_easter_of_36_years():
    assert [easter(y) for y in range(1995, 2031)] == [date(y, *md) for y, md in zip(range(1995, 2031), EASTERS)]


def test_german_days_of_30_years():
    for y, md in zip(range(1995, 2025), EASTERS):
        sunday = date(y, *md)
        want = {date(y, 1, 1), date(y, 5, 1), date(y, 10, 3), date(y, 12, 25), date(y, 12, 26)} | {sunday + timedelta(k) for k in (-2, 1, 39, 50)} | ({date(2017, 10, 31)} if y == 2017 else set())
        assert {d for d, _ in holidays("DE", [y])} == want
    assert [d for d, n in holidays("DE", [2024]) if n in ("Karfreitag", "Christi Himmelfahrt", "Pfingstmontag")] == [date(2024, 3, 29), date(2024, 5, 9), date(2024, 5, 20)]


#: Federal days off in the United States, by hand.
FEDERAL = {
    2004: "01-01 01-19 02-16 05-31 07-04 07-05 09-06 10-11 11-11 11-25 12-24 12-25 12-31",
    2011: "01-01 01-17 02-21 05-30 07-04 09-05 10-10 11-11 11-24 12-25 12-26",
    2020: "01-01 01-20 02-17 05-25 07-03 07-04 09-07 10-12 11-11 11-26 12-25",
    2021: "01-01 01-18 02-15 05-31 06-18 06-19 07-04 07-05 09-06 10-11 11-11 11-25 12-24 12-25 12-31",
    2022: "01-01 01-17 02-21 05-30 06-19 06-20 07-04 09-05 10-10 11-11 11-24 12-25 12-26",
    2024: "01-01 01-15 02-19 05-27 06-19 07-04 09-02 10-14 11-11 11-28 12-25",
}


def test_days_of_the_united_states():
    for y, days in FEDERAL.items():
        assert sorted({d.strftime("%m-%d") for d, _ in holidays("US", [y])}) == days.split(), y
    whole = holidays("US", range(1990, 2020))
    assert len({d for d, n in whole if n == "Thanksgiving"}) == 30 and all(d.weekday() == 3 and 22 <= d.day <= 28 for d, n in whole if n == "Thanksgiving")
    assert not [n for _, n in whole if n.startswith("Juneteenth")]
    assert weekday(12, 0, -1)(2024) == date(2024, 12, 30) and {d for d, _ in holidays("FR", [2024])} >= {date(2024, 4, 1), date(2024, 7, 14)}
    with pytest.raises(ValueError, match="XX"):
        holidays("XX", [2024])


def test_calendar_of_the_years_in_the_data(spark):
    stamps = [datetime(2021, 7, 5, 13), datetime(2021, 7, 6), datetime(2023, 12, 24), datetime(2023, 12, 25, 23, 59), None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(stamps)], "i int, ds timestamp_ntz, name string")
    days = country_calendar(df, "US")
    assert {r[0].year for r in days.select("date").collect()} == {2021, 2022, 2023}
    got = {r.i: r for r in holiday_features(df, "US", distance=True).collect()}
    assert [got[i].is_holiday for i in range(4)] == [1, 0, 0, 1]
    assert (got[1].days_to_holiday, got[1].days_since_holiday) == (62, 1) and (got[2].days_to_holiday, got[2].days_since_holiday) == (1, 31)
    assert got[3].days_to_holiday == 0 and len(got) == 5 and got[0].name == "x"
    assert holiday_features(df.limit(0), "DE").count() == 0
