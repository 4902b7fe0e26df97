"""Delimited records: quote-aware assembly, strict parsing, checks of name and date."""

from __future__ import annotations

import csv
import datetime
import functools
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

# The names of the column that holds the taxon, and what a taxon may not hold.
NAME_COLUMNS = ("name", "strain", "accession")
NAME_FORBIDDEN = "()[],:;'�"
YEARS = (1900, 2100)

csv.field_size_limit(min(sys.maxsize, 2**31 - 1))


@functools.lru_cache(maxsize=64)
def _after_quote(sep: str) -> re.Pattern:
    return re.compile(f'"( *)(?={re.escape(sep)}|\\Z)|"')


def _tidy(rec: str, sep: str) -> str:
    """Without the blanks between a closing quote and the separator or end; the csv reader knows none there.

    A quote closes a field if the quotes up to it are even in number.
    """
    out, at, even = [], 0, True
    for m in _after_quote(sep).finditer(rec):
        even = not even
        if even and m[1]:
            out.append(rec[at : m.start() + 1])
            at = m.end()
    return "".join([*out, rec[at:]])


def _stray(fields: list[str], rec: str, sep: str) -> bool:
    """Whether the reader has let a quote pass in a field that does not open with one."""
    at = 0
    for f in fields:
        while rec[at : at + 1] == " " and sep != " ":
            at += 1
        if rec[at : at + 1] == '"':
            at += len(f) + f.count('"') + 2
        elif '"' in f:
            return True
        else:
            at += len(f)
        at += len(sep)
    return False


def split_record(rec: str, sep: str) -> tuple[list[str] | None, str | None]:
    """(fields, None), or (None, what the csv reader said) of a record that breaks the quoting.

    The fields are those of the strict csv reader and its structural exceptions are captured.
    Blanks after a closing quote are taken out before it, and line breaks, which it allows
    within quotes only, stand as characters that the record lacks; a quote inside a field that
    does not open with one is found on its output. One trailing carriage return and blanks
    around fields are ignored.
    """
    rec = rec[:-1] if rec.endswith("\r") else rec
    if '" ' in rec:
        rec = _tidy(rec, sep)
    breaks = {}
    if "\n" in rec or "\r" in rec:
        spare = (c for c in map(chr, range(0xE000, 0x110000)) if c not in rec)
        breaks = {next(spare): "\n", next(spare): "\r"}
        for c, b in breaks.items():
            rec = rec.replace(b, c)
    try:
        rows = list(csv.reader([rec], delimiter=sep, strict=True, skipinitialspace=True))
    except csv.Error as e:
        return None, str(e)
    fields = rows[0] if rows and rows[0] else [""]
    if '"' in rec and _stray(fields, rec, sep):
        return None, "quote in an unquoted field"
    for c, b in breaks.items():
        fields = [f.replace(c, b) for f in fields]
    return [f.strip(" ") for f in fields], None


def header_of(line: str | None, sep: str) -> tuple[list[str], int | None, int | None] | None:
    """(columns, index of the name column, index of the date column) of a header line."""
    if line is None:
        return None
    fields, _ = split_record(line.lstrip("﻿"), sep)
    if fields is None:
        return None
    low = [f.lower() for f in fields]
    name = next((i for i, f in enumerate(low) if f in NAME_COLUMNS), None)
    date = next((i for i, f in enumerate(low) if "date" in f), None)
    return fields, name, date


def good_name(name: str) -> bool:
    return bool(name) and not any(
        c.isspace() or c in NAME_FORBIDDEN or unicodedata.category(c) == "Cc" for c in name
    )


_YEAR = re.compile(r"[0-9]{4}(?:\.[0-9]+)?")
_DAY = re.compile(r"([0-9]{4})-([0-9]{2}|XX)-([0-9]{2}|XX)")


def good_date(text: str) -> bool:
    """A decimal year, [lo:hi] of two, YYYY-MM-DD, YYYY-MM-XX or YYYY-XX-XX; empty counts as good."""
    if not text or _YEAR.fullmatch(text):
        return not text or YEARS[0] <= float(text) <= YEARS[1]
    if text[0] == "[" and text[-1] == "]":
        ends = text[1:-1].split(":")
        return (
            len(ends) == 2
            and all(_YEAR.fullmatch(x) for x in ends)
            and YEARS[0] <= float(ends[0]) <= float(ends[1]) <= YEARS[1]
        )
    m = _DAY.fullmatch(text)
    if not m or not YEARS[0] <= int(m[1]) <= YEARS[1]:
        return False
    if m[2] == "XX":
        return m[3] == "XX"
    if not 1 <= int(m[2]) <= 12:
        return False
    if m[3] == "XX":
        return True
    try:
        datetime.date(int(m[1]), int(m[2]), int(m[3]))
    except ValueError:
        return False
    return True


def separator(file_name: str | None) -> str:
    return "\t" if (file_name or "").lower().endswith(".tsv") else ","


def check_record(rec: str | None, sep: str, header) -> tuple[str | None, str | None, list[str] | None]:
    """(reason or None, detail, fields)."""
    fields, said = split_record(rec or "", sep)
    if fields is None:
        return "quoting", said, None
    if header is None or len(fields) != len(header[0]):
        want = "no header" if header is None else f"{len(header[0])} columns in the header"
        return "columns", f"{len(fields)} fields, {want}", fields
    name = fields[header[1]] if header[1] is not None else ""
    if not good_name(name):
        return "name", name, fields
    date = fields[header[2]] if header[2] is not None else ""
    if not good_date(date):
        return "date", date, fields
    return None, None, fields


def assemble(lines: Iterable[str], sep: str) -> Iterator[str]:
    """Physical lines to records: a quote that opens a field keeps the record open over line ends."""
    opens = re.compile(f'(?:^|{re.escape(sep)}) *"')
    held: str | None = None
    for line in lines:
        held = line if held is None else held + "\n" + line
        at, is_open = 0, False
        while m := opens.search(held, at):
            close = m.end()
            while True:
                close = held.find('"', close)
                if close < 0:
                    is_open = True
                    break
                if held[close + 1 : close + 2] == '"':
                    close += 2
                    continue
                break
            if is_open:
                break
            at = close + 1
        if not is_open:
            yield held
            held = None
    if held is not None:
        yield held
