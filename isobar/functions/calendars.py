"""Calendars: microsecond ordinals to date components and back, on small axis arrays.

Ordinals count microseconds from 1970-01-01 of the calendar itself. Spark's own
timestamps are proleptic Gregorian, so axes of other calendars keep integers.
"""

from __future__ import annotations

import re

import numpy as np

DAY_US = 86_400_000_000
#: Names of one calendar.
SAME = {"standard": "standard", "gregorian": "standard", "proleptic_gregorian": "proleptic_gregorian", "noleap": "noleap", "365_day": "noleap", "all_leap": "all_leap", "366_day": "all_leap", "360_day": "360_day", "julian": "julian"}
GREGORIAN_LIKE = ("standard", "gregorian", "proleptic_gregorian")
MONTH_STARTS = {n: np.r_[0, np.cumsum([31, 28 + (n == 366), 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])] for n in (365, 366)}
COMPONENTS = ("year", "month", "day", "hour", "minute", "second", "micro")


def kind_of(calendar: str) -> str:
    try:
        return SAME[calendar.lower()]
    except KeyError:
        raise ValueError(f"unknown calendar {calendar!r}") from None


def _eras(y: np.ndarray, m: np.ndarray, d: np.ndarray, century: bool) -> np.ndarray:
    """Days from March of year 0, leap days last in a year that starts in March."""
    y = y - (m <= 2)
    days = 365 * y + y // 4 + (153 * ((m + 9) % 12) + 2) // 5 + d - 1
    return days - y // 100 + y // 400 if century else days


#: Days of 1970-01-01 by the two counts.
EPOCH = {c: int(_eras(np.array(1970), np.array(1), np.array(1), c)) for c in (True, False)}
#: In the mixed calendar Gregorian dates begin on 1582-10-15, the day after Julian 1582-10-04.
SWITCH = int(_eras(np.array(1582), np.array(10), np.array(15), True)) - EPOCH[True]
JULIAN_EPOCH = int(_eras(np.array(1582), np.array(10), np.array(5), False)) - SWITCH


def days_of(y, m, d, calendar: str) -> np.ndarray:
    """Days from 1970-01-01 of the calendar."""
    kind = kind_of(calendar)
    y, m, d = (np.asarray(x, np.int64) for x in (y, m, d))
    if kind == "360_day":
        return (y - 1970) * 360 + (m - 1) * 30 + d - 1
    if kind in ("noleap", "all_leap"):
        n = 365 if kind == "noleap" else 366
        return (y - 1970) * n + MONTH_STARTS[n][m - 1] + d - 1
    if kind == "julian":
        return _eras(y, m, d, False) - EPOCH[False]
    greg = _eras(y, m, d, True) - EPOCH[True]
    if kind == "standard":
        early = (y * 10000 + m * 100 + d) < 15821015
        return np.where(early, _eras(y, m, d, False) - JULIAN_EPOCH, greg)
    return greg


def _from_eras(days: np.ndarray, century: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if century:
        era = days // 146097
        rest = days - era * 146097
        yoe = (rest - rest // 1460 + rest // 36524 - rest // 146096) // 365
        day = rest - (365 * yoe + yoe // 4 - yoe // 100)
        y = yoe + era * 400
    else:
        era = days // 1461
        rest = days - era * 1461
        yoe = np.minimum(rest // 365, 3)
        day = rest - 365 * yoe
        y = yoe + era * 4
    mp = (5 * day + 2) // 153
    d = day - (153 * mp + 2) // 5 + 1
    m = np.where(mp < 10, mp + 3, mp - 9)
    return y + (m <= 2), m, d


def date_of(days, calendar: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Year, month and day of days from 1970-01-01 of the calendar."""
    kind = kind_of(calendar)
    days = np.asarray(days, np.int64)
    if kind == "360_day":
        return days // 360 + 1970, days % 360 // 30 + 1, days % 30 + 1
    if kind in ("noleap", "all_leap"):
        n = 365 if kind == "noleap" else 366
        day = days % n
        m = np.searchsorted(MONTH_STARTS[n], day, "right")
        return days // n + 1970, m, day - MONTH_STARTS[n][m - 1] + 1
    if kind == "julian":
        return _from_eras(days + EPOCH[False], False)
    found = _from_eras(days + EPOCH[True], True)
    if kind == "standard":
        old = _from_eras(days + JULIAN_EPOCH, False)
        return tuple(np.where(days < SWITCH, a, b) for a, b in zip(old, found))
    return found


def ordinal(calendar: str, year, month=1, day=1, hour=0, minute=0, second=0, micro=0) -> np.ndarray:
    """Microseconds from 1970-01-01 00:00 of the calendar."""
    time = ((np.asarray(hour, np.int64) * 60 + minute) * 60 + second) * 1_000_000 + micro
    return days_of(year, month, day, calendar) * DAY_US + time


def components(us, calendar: str) -> dict[str, np.ndarray]:
    us = np.asarray(us, np.int64)
    days, rest = us // DAY_US, us % DAY_US
    y, m, d = date_of(days, calendar)
    return dict(zip(COMPONENTS, (y, m, d, rest // 3_600_000_000, rest // 60_000_000 % 60, rest // 1_000_000 % 60, rest % 1_000_000)))


def days_in_month(year, month, calendar: str) -> np.ndarray:
    year, month = np.asarray(year, np.int64), np.asarray(month, np.int64)
    after = month == 12
    return days_of(np.where(after, year + 1, year), np.where(after, 1, month + 1), 1, calendar) - days_of(year, month, 1, calendar)


def parse_date(text: str) -> tuple[int, ...]:
    """Year, month, day, hour, minute, second, micro of a CF reference date; parts left out are those of 2000-01-01."""
    m = re.match(r"\s*(-?\d{1,6})(?:-(\d{1,2})(?:-(\d{1,2}))?)?(?:[ T](\d{1,2})(?::(\d{1,2}))?(?::(\d{1,2})(?:\.(\d{1,6}))?)?)?", text)
    if not m:
        raise ValueError(f"not a date: {text!r}")
    y, mo, d, h, mi, s, f = m.groups()
    return int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), int((f or "0").ljust(6, "0"))


UNIT_US = {"day": DAY_US, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}
SHORT = {"d": "day", "h": "hour", "hr": "hour", "min": "minute", "s": "second", "sec": "second", "ms": "millisecond", "us": "microsecond"}


def decode(values, units: str, calendar: str) -> np.ndarray:
    """Ordinals of numbers in CF units `X since date`; months and years step by calendar, days past a month's end go to it."""
    unit, _, since = units.partition(" since ")
    if not since:
        raise ValueError(f"units {units!r} do not say since when")
    unit = unit.strip().lower()
    unit = SHORT.get(unit, SHORT.get(unit.rstrip("s"), unit.rstrip("s")))
    ref = parse_date(since)
    values = np.asarray(values, float)
    if unit in ("month", "year"):
        steps = np.floor(values).astype(np.int64) * (12 if unit == "year" else 1)
        total = ref[0] * 12 + ref[1] - 1 + steps
        year, month = total // 12, total % 12 + 1
        day = np.minimum(ref[2], days_in_month(year, month, calendar))
        return ordinal(calendar, year, month, day, *ref[3:])
    if unit not in UNIT_US:
        raise ValueError(f"unknown unit in {units!r}")
    start = ordinal(calendar, *ref)
    whole = np.floor(values)
    return start + whole.astype(np.int64) * UNIT_US[unit] + np.rint((values - whole) * UNIT_US[unit]).astype(np.int64)


def encode(us, units: str, calendar: str) -> np.ndarray:
    """Numbers in `X since date` of ordinals, X of fixed length."""
    unit, _, since = units.partition(" since ")
    unit = unit.strip().lower().rstrip("s")
    return (np.asarray(us, np.int64) - ordinal(calendar, *parse_date(since))) / UNIT_US[unit]
