"""Written times: every reading of a text, as seconds UTC of its first moment and as bounds in decimal years."""

from __future__ import annotations

import calendar
import datetime as dt
import functools
import re
import zoneinfo

_UTC = zoneinfo.ZoneInfo("UTC")
_EPOCH = dt.datetime(1970, 1, 1)
_MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_name) if m} | {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m}

# Hours east of UTC of abbreviations, for values whose lab has no zone that uses them.
_ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "BST": 1, "WEST": 1, "CET": 1, "WAT": 1, "CEST": 2, "EET": 2, "CAT": 2,
    "SAST": 2, "EEST": 3, "MSK": 3, "EAT": 3, "IST": 5.5, "SGT": 8, "HKT": 8, "AWST": 8, "JST": 9, "KST": 9,
    "ACST": 9.5, "AEST": 10, "ACDT": 10.5, "AEDT": 11, "NZST": 12, "NZDT": 13, "NST": -3.5, "NDT": -2.5, "AST": -4,
    "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,]\d+)?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"(?P<z>[Zz]|[+-]\d\d(?::?\d\d)?|\[[A-Za-z_+\-0-9/]+\]|[A-Za-z]+[/_+-][A-Za-z0-9_+/-]+|[A-Z]{2,5})"
_CLOCK = rf"(?:(?:[Tt]|\s+|,\s*){_TIME}(?:\s*{_ZONE})?)?"
_MONTH = r"(?P<mon>[A-Za-z]{3,9})\.?"
_SHAPES = [
    ("iso", re.compile(rf"(?P<y>\d{{4}})-(?P<m>\d\d)-(?P<d>\d\d){_CLOCK}", re.A)),
    ("slash", re.compile(rf"(?P<y>\d{{4}})[/.](?P<m>\d{{1,2}})[/.](?P<d>\d{{1,2}}){_CLOCK}", re.A)),
    ("month", re.compile(r"(?P<y>\d{4})-(?P<m>\d\d)(?:-XX)?", re.A)),
    ("year", re.compile(r"(?P<y>\d{4})(?:-XX-XX)?", re.A)),
    ("compact", re.compile(rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)(?:[Tt](?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?(?:\.\d+)?(?:\s*{_ZONE})?)?", re.A)),
    ("month_first", re.compile(rf"{_MONTH}\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}){_CLOCK}", re.A)),
    ("day_first", re.compile(rf"(?:[A-Za-z]{{3,9}},?\s+)?(?P<d>\d{{1,2}})[ -]{_MONTH}[ -](?P<y>\d{{4}}){_CLOCK}", re.A)),
]
_NUMBERS = re.compile(rf"(?P<a>\d{{1,2}})([/.-])(?P<b>\d{{1,2}})\2(?P<y>\d{{4}}){_CLOCK}", re.A)
_SECONDS, _MILLIS = re.compile(r"\d{10}", re.A), re.compile(r"\d{13}", re.A)
_DECIMAL = re.compile(r"(\d{4}\.\d+)", re.A)
_BOUNDS = re.compile(r"\[\s*(\d{4}(?:\.\d+)?)\s*[:,]\s*(\d{4}(?:\.\d+)?)\s*\]|(\d{4}\.\d+)\s*-\s*(\d{4}(?:\.\d+)?)", re.A)
EXISTS_FROM, EXISTS_TO = 1, 9999


@functools.lru_cache(maxsize=1024)
def zone(name: str | None) -> zoneinfo.ZoneInfo | None:
    if not name:
        return None
    try:
        return zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None


def decimal_year(text: str) -> int:
    """00:00 UTC of the day of a decimal year: day number int((fraction + 1e-10) * days of the year)."""
    v = float(text)
    year = int(v)
    days = int((v % 1 + 1e-10) * (366 if calendar.isleap(year) else 365))
    return int((dt.datetime(year, 1, 1) + dt.timedelta(days=days) - _EPOCH).total_seconds())


@functools.lru_cache(maxsize=4096)
def _abbreviation(name: str, tz: str | None, year: int) -> float | None:
    """Seconds east of UTC that a zone means by an abbreviation on some day of a year, else the general ones."""
    z = zone(tz)
    if z is not None:
        for day in range(365):
            at = dt.datetime(year, 1, 1, 12, tzinfo=z) + dt.timedelta(days=day)
            if at.tzname() == name:
                return at.utcoffset().total_seconds()
    hours = _ABBREVIATIONS.get(name)
    return None if hours is None else hours * 3600


def _in_zone(at: dt.datetime, z: zoneinfo.ZoneInfo, whole_day: bool) -> int | None:
    """Seconds of a local time: the first of two; None in a gap (a day then begins at the gap's end)."""
    aware = at.replace(tzinfo=z)
    try:
        utc = aware.astimezone(_UTC)
        if utc.astimezone(z).replace(tzinfo=None) != at:
            if not whole_day:
                return None
            utc = at.replace(tzinfo=z, fold=0).astimezone(_UTC)
            first = (utc.replace(tzinfo=None) - _EPOCH).total_seconds()
            after = at.replace(tzinfo=z, fold=1).utcoffset() - at.replace(tzinfo=z, fold=0).utcoffset()
            return int(first - max(0.0, after.total_seconds())) if after else int(first)
    except (OverflowError, ValueError):
        return None
    return int((utc.replace(tzinfo=None) - _EPOCH).total_seconds())


def _clock(y: int, m: int, d: int, g: dict) -> dt.datetime | None:
    """The written date and time; None where there is none such."""
    try:
        hour = int(g.get("h") or 0)
        if g.get("ap"):
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if g["ap"] in "pP" else 0)
        return dt.datetime(y, m, d, hour, int(g.get("mi") or 0), int(g.get("s") or 0))
    except ValueError:
        return None


def _zoned(at: dt.datetime, written: str, tz: str | None) -> int | None:
    """Seconds of a time with its own zone: an offset, a zone name or an abbreviation."""
    if written in "Zz":
        east = 0.0
    elif written[0] in "+-":
        hh, mm = int(written[1:3]), int(written[-2:]) if len(written) > 3 else 0
        if hh > 18 or mm > 59:
            return None
        east = (hh * 3600 + mm * 60) * (-1 if written[0] == "-" else 1)
    else:
        name = written.strip("[]")
        named = zone(name) if name not in _ABBREVIATIONS and ("/" in name or written[0] == "[") else None
        if named is not None:
            return _in_zone(at, named, False)
        east = _abbreviation(name, tz, at.year)
        if east is None:
            return None
    return int((at - _EPOCH).total_seconds() - east)


def decimal_of(day: dt.date) -> float:
    """year + (day of the year - 0.5) / days of the year."""
    return day.year + (day.timetuple().tm_yday - 0.5) / (366 if calendar.isleap(day.year) else 365)


def _last_day(y: int, m: int) -> dt.date:
    """Last day of a month that counts for bounds; that of February is always the 28th."""
    return dt.date(y, m, 28 if m == 2 else calendar.monthrange(y, m)[1])


#: (format, seconds UTC or None, lo, hi); None: what is written under the format does not exist.
Reading = tuple[str, int | None, float | None, float | None]


def _dated(label: str, y: int, m: int, d: int, g: dict, tz: str | None, until: dt.date | None = None) -> list[Reading]:
    """The readings of a date under one format: as local time and, with a zone to tell it from, as UTC."""
    at = _clock(y, m, d, g)
    if at is None:
        return [(label, None, None, None)]
    lo, hi = decimal_of(at.date()), decimal_of(until or at.date())
    if g.get("z"):
        return [(label, _zoned(at, g["z"], tz), lo, hi)]
    z = zone(tz)
    local = (label, _in_zone(at, z or _UTC, not g.get("h")), lo, hi)
    return [local] if z is None else [local, (label + UTC, int((at - _EPOCH).total_seconds()), lo, hi)]


UTC = "~utc"  # ends the format of a time without a zone that is read as UTC instead of local time


def readings(text: str | None, tz: str | None = None) -> list[Reading]:
    """Every reading (format, start, lo, hi) of a text under every format it is written in.

    start: seconds UTC of the first moment, None where no such date or local time exists; lo and
    hi: decimal years of the first and last day covered, as written. A date of numbers only is
    read as dmy and as mdy; a time without a zone as local time of tz and, marked ~utc, as UTC.
    Null, empty and unreadable texts have none; a text may be of any length.
    """
    t = (text or "").strip()
    try:
        if _SECONDS.fullmatch(t) or _MILLIS.fullmatch(t):
            s, label = (int(t), "epoch_s") if len(t) == 10 else (int(t) // 1000, "epoch_ms")
            day = decimal_of((_EPOCH + dt.timedelta(seconds=s)).date())
            return [(label, s, day, day)]
        if m := _DECIMAL.fullmatch(t):
            return [("decimal", decimal_year(m[1]), float(m[1]), float(m[1]))]
        if m := _BOUNDS.fullmatch(t):
            a, b = float(m[1] or m[3]), float(m[2] or m[4])
            return [("bounds", decimal_year(m[1] or m[3]), min(a, b), max(a, b))]
    except (ValueError, OverflowError):
        return []
    if m := _NUMBERS.fullmatch(t):
        g, a, b, y = m.groupdict(), int(m["a"]), int(m["b"]), int(m["y"])
        return _dated("dmy", y, b, a, g, tz) + _dated("mdy", y, a, b, g, tz)
    for label, shape in _SHAPES:
        if m := shape.fullmatch(t):
            g, y = m.groupdict(), int(m["y"])
            if g.get("mon"):
                month = _MONTHS.get(g["mon"].lower())
                if month is None:
                    continue
            else:
                month = int(g.get("m") or 1)
            if label == "year" and len(t) == 4:
                return [(f, s, float(y), float(y)) for f, s, _, _ in _dated(label, y, 1, 1, g, tz)]
            until = None
            if label in ("month", "year") and 1 <= month <= 12 and y:
                until = dt.date(y, 12, 31) if label == "year" else _last_day(y, month)
            return _dated(label, y, month, int(g.get("d") or 1), g, tz, until)
    return []


def alternatives(found: list[Reading]) -> str:
    """What a set of readings leaves open: format:class joined by |, one class per moment, x for none."""
    moments: dict[int, int] = {}
    return "|".join(f"{f}:{'x' if s is None else moments.setdefault(s, len(moments))}" for f, s, _, _ in found)


def mixture(sets: list[tuple[tuple[tuple[str, float], ...], float]], pseudo: float = 1.0, rounds: int = 50) -> dict[str, float]:
    """Expectation-maximisation of a source's format weights; sets: ((format, likelihood), ...) and how many values have it.

    Each value gives every format under which it can be parsed the share that weight times
    likelihood has; the weights are these shares summed, with pseudo values of each format.
    """
    formats = sorted({f for s, _ in sets for f, _ in s})
    weight = dict.fromkeys(formats, 1 / max(1, len(formats)))
    for _ in range(rounds):
        count = dict.fromkeys(formats, pseudo)
        for s, n in sets:
            total = sum(weight[f] * like for f, like in s)
            for f, like in s:
                count[f] += n * (weight[f] * like / total if total > 0 else 1 / len(s))
        whole = sum(count.values()) or 1.0
        moved = max((abs(count[f] / whole - weight[f]) for f in formats), default=0.0)
        weight = {f: c / whole for f, c in count.items()}
        if moved < 1e-9:
            break
    return weight
