"""Public holidays of a country from rules: fixed days, weekdays counted in a month,
days from Easter, each within the years it is kept, and days off in lieu."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

Rule = Callable[[int], date]
MON, THU = 0, 3


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar (the anonymous computus)."""
    golden, century, rest = year % 19, year // 100, year % 100
    moon = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    week = (32 + 2 * (century % 4) + 2 * (rest // 4) - moon - rest % 4) % 7
    late = (golden + 11 * moon + 22 * week) // 451
    month, day = divmod(moon + week - 7 * late + 114, 31)
    return date(year, month, day + 1)


def fixed(month: int, day: int) -> Rule:
    return lambda year: date(year, month, day)


def from_easter(days: int) -> Rule:
    return lambda year: easter(year) + timedelta(days)


def weekday(month: int, day_of_week: int, nth: int) -> Rule:
    """The nth such weekday of the month (Monday is 0); -1 is the last one."""

    def find(year: int) -> date:
        if nth > 0:
            first = date(year, month, 1)
            return first + timedelta((day_of_week - first.weekday()) % 7 + 7 * (nth - 1))
        last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
        return last - timedelta((last.weekday() - day_of_week) % 7 + 7 * (-nth - 1))

    return find


#: Per country (name, rule, first year, last year or None, moved), where
#: moved days also count on the Friday before a Saturday or the Monday after a Sunday.
COUNTRIES: dict[str, list[tuple[str, Rule, int, int | None, bool]]] = {
    "US": [
        ("New Year's Day", fixed(1, 1), 1871, None, True),
        ("Martin Luther King Jr. Day", weekday(1, MON, 3), 1986, None, False),
        ("Washington's Birthday", weekday(2, MON, 3), 1971, None, False),
        ("Memorial Day", weekday(5, MON, -1), 1971, None, False),
        ("Juneteenth", fixed(6, 19), 2021, None, True),
        ("Independence Day", fixed(7, 4), 1871, None, True),
        ("Labor Day", weekday(9, MON, 1), 1894, None, False),
        ("Columbus Day", weekday(10, MON, 2), 1970, None, False),
        ("Veterans Day", fixed(11, 11), 1978, None, True),
        ("Thanksgiving", weekday(11, THU, 4), 1942, None, False),
        ("Christmas Day", fixed(12, 25), 1871, None, True),
    ],
    "DE": [
        ("Neujahr", fixed(1, 1), 1990, None, False),
        ("Karfreitag", from_easter(-2), 1990, None, False),
        ("Ostermontag", from_easter(1), 1990, None, False),
        ("Erster Mai", fixed(5, 1), 1990, None, False),
        ("Christi Himmelfahrt", from_easter(39), 1990, None, False),
        ("Pfingstmontag", from_easter(50), 1990, None, False),
        ("Tag der Deutschen Einheit", fixed(10, 3), 1990, None, False),
        ("Reformationstag", fixed(10, 31), 2017, 2017, False),
        ("Erster Weihnachtstag", fixed(12, 25), 1990, None, False),
        ("Zweiter Weihnachtstag", fixed(12, 26), 1990, None, False),
    ],
    "FR": [
        ("Jour de l'an", fixed(1, 1), 1811, None, False),
        ("Lundi de Pâques", from_easter(1), 1886, None, False),
        ("Fête du Travail", fixed(5, 1), 1919, None, False),
        ("Fête de la Victoire", fixed(5, 8), 1982, None, False),
        ("Ascension", from_easter(39), 1802, None, False),
        ("Lundi de Pentecôte", from_easter(50), 1886, None, False),
        ("Fête nationale", fixed(7, 14), 1880, None, False),
        ("Assomption", fixed(8, 15), 1802, None, False),
        ("Toussaint", fixed(11, 1), 1802, None, False),
        ("Armistice", fixed(11, 11), 1922, None, False),
        ("Noël", fixed(12, 25), 1802, None, False),
    ],
}


def holidays(country: str, years: range | list[int]) -> list[tuple[date, str]]:
    """(date, name) of the years, in order. A day off in lieu may lie in the year
    before; those that lie in the years asked for are given."""
    if country not in COUNTRIES:
        raise ValueError(f"no calendar for {country!r}, only for {', '.join(sorted(COUNTRIES))}")
    wanted, out = set(years), set()
    for year in sorted({y + k for y in wanted for k in (0, 1)}):
        for name, rule, first, last, moved in COUNTRIES[country]:
            if year < first or (last is not None and year > last):
                continue
            day = rule(year)
            out.add((day, name))
            shift = {5: -1, 6: 1}.get(day.weekday(), 0) if moved else 0
            if shift:
                out.add((day + timedelta(shift), f"{name} (observed)"))
    return sorted(x for x in out if x[0].year in wanted)
