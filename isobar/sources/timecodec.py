"""Decoding of numeric time by its CF units and calendar."""

from __future__ import annotations

import logging

import numpy as np

from ..functions import calendars as C
from ..plans.model import Axis, GridDataset

log = logging.getLogger(__name__)


def is_decodable(a: Axis) -> bool:
    return " since " in str(a.attrs.get("units", ""))


def decode_axis(a: Axis) -> Axis:
    """Time as ordinals of its calendar (standard if none is said); bounds share units and calendar."""
    calendar = a.attrs.get("calendar")
    if calendar is None:
        log.warning("%s says no calendar; standard is taken", a.name)
        calendar = "standard"
    units = a.attrs["units"]
    of = lambda x: None if x is None else C.decode(x, units, calendar)
    attrs = {k: v for k, v in a.attrs.items() if k not in ("units", "calendar")}
    return Axis(a.name, of(a.values), of(a.lo), of(a.hi), attrs | {"encoded_units": units}, calendar)


def decode_time(ds: GridDataset) -> GridDataset:
    """Every time axis decoded; those without `since` in their units stay, with a warning. No time axis is an error."""
    found = [a for a in ds.axes.values() if "T" in a.keys()]
    if not found:
        raise KeyError("No time axis was found to decode.")
    for a in found:
        if a.decoded:
            continue
        if not is_decodable(a):
            log.warning("%s has no units that say since when; it stays undecoded", a.name)
            continue
        ds = ds.with_axis(decode_axis(a))
    return ds


def encode_axis(a: Axis, units: str = "days since 1970-01-01") -> Axis:
    """Decoded time as numbers again."""
    of = lambda x: None if x is None else C.encode(x, units, a.calendar)
    return Axis(a.name, np.asarray(of(a.values)), of(a.lo), of(a.hi), {k: v for k, v in a.attrs.items() if k != "encoded_units"} | {"units": units, "calendar": a.calendar})
