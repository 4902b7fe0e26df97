"""Rows that fail to parse: valid rows loaded, the others kept with the reason."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.kernels import records as K
from cladeflow.runtime import dimension_join, materialize

_SCHEMA = "line_id bigint, file_name string, reason string, detail string, name string, date string, further map<string,string>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    headers: dict = {}
    for b in batches:
        out = []
        for line_id, file_name, rec, head in zip(b["line_id"], b["file_name"], b["raw_line"], b["_head"]):
            sep = K.separator(file_name)
            if (sep, head) not in headers:
                if len(headers) > 10_000:
                    headers.clear()
                headers[sep, head] = K.header_of(head, sep)
            header = headers[sep, head]
            reason, detail, fields = K.check_record(rec, sep, header)
            name = date = further = None
            if reason in (None, "date"):
                name = fields[header[1]]
                date = fields[header[2]] if header[2] is not None else None
                further = {c: f for i, (c, f) in enumerate(zip(header[0], fields)) if i not in header[1:]}
            out.append((line_id, file_name, reason, detail, name, date or None, further))
        yield pd.DataFrame(out, columns=["line_id", "file_name", "reason", "detail", "name", "date", "further"])


def parse_records(lines: DataFrame) -> DataFrame:
    """One row per record: reason and detail where it can't be loaded, else name, date, further (also with the reason date).

    lines: line_id, file_name, line_no, raw_line; further columns are ignored. Line 1 of a file
    is its header (with several, the one of the smallest line_id) and no record. A null raw_line
    counts as an empty record; a record of a file without a header, or with a header that can't
    be read, has the reason columns; repeated records stay. An empty table gives an empty table.
    A header without a name column makes all its records fail with the reason name.
    """
    src = lines.select("line_id", "file_name", "line_no", "raw_line")
    heads = src.where(F.col("line_no") == 1).groupBy("file_name").agg(F.min_by("raw_line", "line_id").alias("_head"))
    heads = materialize(heads, "headers")
    rows = src.where(F.coalesce(F.col("line_no") != 1, F.lit(True))).drop("line_no")
    joined = dimension_join(rows, heads, ["file_name"], "line_id")
    return joined.select("line_id", "file_name", "raw_line", "_head").mapInPandas(_parse, _SCHEMA)


def split_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loaded rows, rejected rows with their reason), from one pass over the lines."""
    parsed = materialize(parse_records(lines), "records")
    good = parsed.where(F.col("reason").isNull()).select("line_id", "file_name", "name", "date", "further")
    return good, parsed.where(F.col("reason").isNotNull()).select("line_id", "file_name", "reason", "detail")
