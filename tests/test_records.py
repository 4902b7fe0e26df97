import json

import pytest
from pyspark.sql import functions as F

from cladeflow.kernels import records as K
from cladeflow.kernels import timestamps as T
from cladeflow.operators.bad_rows import parse_records, split_records
from cladeflow.operators.nested import flatten_records, record_items
from cladeflow.operators.references import name_orphans, orphans
from cladeflow.operators.times import normalise_times, order_evidence
from cladeflow.plans import record_queries

RECORDS = "record_id bigint, tree_id string, auspice_json string, sequences string, insertions string, path string, nodes string"


def _chain(n):
    node = {"name": f"n{n}"}
    for k in range(n - 1, -1, -1):
        node = {"name": f"n{k}", "children": [node]}
    return json.dumps({"tree": node})


def test_nested_shapes(spark):
    tree = {"tree": {"name": "r", "branch_attrs": {"mutations": {"nuc": ["A1T", "A1T", None], "g": "X5Y", "h": None}}, "children": [None, {"name": "a", "children": {"name": "b", "branch_attrs": None}}, {"name": "c", "children": []}]}}
    rows = [
        (1, "t", json.dumps(tree), '{"x": {"5": "A", "6": null}, "y": {}}', '[{"taxon": "x", "sites": [{"pos": 3, "bases": "TT"}, null]}, null]', "p", "n"),
        (2, "t", json.dumps({"tree": [{"name": "r1"}, None, {"name": "r2"}]}), '{"x": [[7, "C"]], "y": []}', "null", None, None),
        (3, "t", '{"tree": {"name": "r"}} x', '{"x": {"5": "A"}', "", None, None),
        (4, None, None, None, None, None, None),
        (5, "t", "[]", "{}", "{}", None, None),
        (6, "t", '{"tree": null}', '{"x": {"1": "A"}}{', '{"taxon": 1}', None, None),
    ]
    got = sorted(map(tuple, record_items(spark.createDataFrame(rows, RECORDS)).collect()))
    assert got == sorted(
        [
            (1, "node", "", "0"), (1, "node", "0", "0.1"), (1, "node", "0.1", "0.1.0"), (1, "node", "0", "0.2"),
            (1, "mutation", "0", "nuc:A1T"), (1, "mutation", "0", "g:X5Y"), (1, "site", "x", "5:A"), (1, "insertion", "x", "3:TT"),
            (2, "node", "", "0"), (2, "node", "", "2"), (2, "site", "x", "7:C"),
        ]
    )


def test_nested_depth_and_empty(spark):
    df = spark.createDataFrame([(1, "t", _chain(120), None, None, None, None)], RECORDS)
    t = flatten_records(df)
    assert t["nodes"].count() == 121
    assert t["nodes"].where("name = 'n120'").first()["path"].count(".") == 120
    assert record_items(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "rec,want",
    [
        ("a,2001,x", None), ('"a",2001,"x, y"', None), (' "a" , 2001 , "x ""q"" y" ', None), ('a,2001,"x\ny"', None), ("a,2001,x\r", None),
        ("a,,x", None), ('"a"b,2001,x', "quoting"), ('a,20"01,x', "quoting"), ('a,"2001,x', "quoting"), ("a,2001", "columns"), ("", "columns"),
        (None, "columns"), ("a b,2001,x", "name"), (",2001,x", "name"), ("a\x07,2001,x", "name"), ("a;b,2001,x", "name"), ("a,2001-02-29,x", "date"),
        ("a,2100.1,x", "date"), ("a,[2001.5:2001.2],x", "date"), ("a,[2001.1:2001.2],x", None), ("a,2001-XX-XX,x", None), ("a,2001-13-XX,x", "date"),
        ('a b,"2001,x', "quoting"), ('a,2001,""', None), ("a,2001,x\r\r", None),
    ],
)
def test_record_reasons(rec, want):
    assert K.check_record(rec, ",", K.header_of("﻿name,the_date,z", ","))[0] == want


def test_assemble():
    assert list(K.assemble(['a,"x', 'y ""q""', 'z",c', "d,e", 'f,"g'], ",")) == ['a,"x\ny ""q""\nz",c', "d,e", 'f,"g']


def test_bad_rows(spark):
    schema = "line_id bigint, file_name string, line_no int, raw_line string, reason string, _head string"
    rows = [
        (1, "f.csv", 1, "strain,date,country", "r", "h"), (2, "f.csv", 2, "a,2001,c", None, None), (3, "f.csv", 3, None, None, None),
        (4, "g.tsv", 2, "a\t2001", None, None), (5, None, 2, "a", None, None), (6, "f.csv", 4, "b,2001," + "x" * 300_000, None, None),
        (7, "f.csv", 2, "a,2001,c", None, None), (8, "f.csv", None, "a b,2001,c", None, None),
    ]
    good, bad = split_records(spark.createDataFrame(rows, schema))
    assert sorted(r["line_id"] for r in good.collect()) == [2, 6, 7]
    assert sorted((r["line_id"], r["reason"]) for r in bad.collect()) == [(3, "columns"), (4, "columns"), (5, "columns"), (8, "name")]
    assert parse_records(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize(
    "text,tz,want",
    [
        ("2021-03-28T02:30:00", "Europe/Berlin", []), ("2021-10-31 02:30", "Europe/Berlin", [("iso", 1635640200)]),
        ("1600000000", None, [("epoch_s", 1600000000)]), ("1600000000999", "Asia/Tokyo", [("epoch_ms", 1600000000)]),
        ("2020-02-30", None, []), ("2020-XX-XX", "Asia/Kolkata", [("year", 1577817000)]), ("Mar 5, 2020 12:01 AM", None, [("month_first", 1583366460)]),
        ("2020-01-01T00:00:00.999999999+05:30", None, [("iso", 1577817000)]), ("2020-07-01 12:00 CDT", "America/Chicago", [("iso", 1593622800)]),
        ("2020-07-01T12:00:00[Asia/Tokyo]", "America/Chicago", [("iso", 1593572400)]), ("Wed, 01 Jul 2020 12:00:00 -0330", None, [("day_first", 1593617400)]),
        ("[2020.5, 2021.5]", None, [("bounds", T.decimal_year("2020.5"))]), ("", None, []), (None, None, []), ("n/a", None, []), ("00/00/2020", None, []),
        ("x" * 100_000, None, []), ("20200101T010203", None, [("compact", 1577840523)]), ("2020-01-01T25:00:00Z", None, []), ("13/01/2020", None, [("dmy", 1578873600)]),
    ],
)
def test_readings(text, tz, want):
    assert [(f, s) for f, s, _, _ in T.readings(text, tz) if s is not None and not f.endswith(T.UTC)] == want


def test_reading_bounds():
    lo_hi = lambda t, tz=None: T.readings(t, tz)[0][2:]
    assert lo_hi("2017-02-XX") == (2017 + 31.5 / 365, 2017 + (31 + 28 - 0.5) / 365) and lo_hi("2016-XX-XX")[1] == 2016 + 365.5 / 366
    assert lo_hi("2017") == (2017.0, 2017.0) and lo_hi("[2015.5:2013.25]") == (2013.25, 2015.5) and lo_hi("2020." + "5" * 500)[0] == pytest.approx(2020.5555)
    assert lo_hi("2017-12-31T23:30:00+14:00") == (2017 + 364.5 / 365,) * 2  # the day as written
    assert T.readings("2021-03-28T02:30:00", "Europe/Berlin") == [("iso", None, *lo_hi("2021-03-28")), ("iso~utc", 1616898600, *lo_hi("2021-03-28"))]
    assert T.readings("2020-01-01 00:00 " + "a_" * 50_000)[0][1] is None


def test_times_mixture(spark):
    v = [(k, lab, s) for k, (lab, s) in enumerate([(1, "25/12/2020"), (1, "13/01/2020"), (1, "20/01/2020"), (1, "03/04/2020"), (2, "01/02/2020"), (3, "01/02/2020"), (None, "2020-01-01"), (1, None), (9, "x")] + [(1, f"{d}/01/2020") for d in range(14, 25)])]
    values = spark.createDataFrame(v, "id bigint, lab int, s string").withColumn("tz", F.lit("clash")).withColumn("format", F.lit("clash"))
    labs = spark.createDataFrame([(1, None, None), (2, "UTC", "mdy"), (2, "UTC", "mdy"), (3, "UTC", None)], "lab int, tz string, date_order string")
    got = {r["id"]: r for r in normalise_times(values, labs, "id", "lab", ["s"]).collect()}
    assert got[3]["format"] == "dmy" and got[3]["status"] == "ok"  # the source's other values decide
    assert got[4]["format"] == "mdy" and got[4]["posterior"] > 0.999  # declared
    assert got[5]["status"] == "ambiguous" and got[5]["start_s"] is None
    assert got[6]["status"] == "ok" and got[8]["status"] == "unreadable" and 7 not in got
    assert normalise_times(values.limit(0), labs, "id", "lab", ["s"]).count() == 0


def test_times_declared_order(spark):
    # what does not exist under the declared order is not read under the other, a local time in a gap not as UTC
    v = [(1, 1, "12/25/2020"), (2, 1, "25/12/2020"), (3, 1, "05/05/2020"), (4, 3, "05/05/2020"), (5, 2, "10/04/2015 02:25"), (6, 2, "04/10/2015 12:00"), (6, 2, "04/10/2015 12:00"), (7, 3, "x" * 200)]
    labs = spark.createDataFrame([(1, "UTC", "dmy"), (2, "Australia/Sydney", "mdy"), (3, None, None)], "lab int, tz string, date_order string")
    values = spark.createDataFrame(v, "id bigint, lab int, s string")
    got = {r["id"]: r for r in normalise_times(values, labs, "id", "lab", ["s"], keep=("lab",)).collect()}
    assert got[1]["status"] == "nonexistent" and got[1]["start_s"] is None and got[2]["start_s"] == 1608854400
    assert got[3]["status"] == got[4]["status"] == "ok" and got[4]["start_s"] == 1588636800 and got[4]["lab"] == 3  # both orders mean one day
    assert got[5]["status"] == "nonexistent" and got[6]["start_s"] == 1428631200 and got[7]["status"] == "unreadable"
    seen = {r["source"]: r for r in order_evidence(values, labs, "id", "lab", ["s"]).collect()}
    # without a declared order the gap tells that the first is no mdy; the other two may be either
    assert (seen[1]["n_read"], seen[2]["n_read"], seen[2]["n_ambiguous"], seen[2]["n_agree"]) == (3, 3, 2, 0)


def test_reader_gives_the_fields(monkeypatch):
    import csv

    monkeypatch.setattr(csv, "reader", lambda *a, **k: iter([["from", "the", "reader"]]))
    assert K.split_record("a,b,c", ",") == (["from", "the", "reader"], None)


def _ts(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def test_orphans(spark):
    tgt = [("t", "a", "2020-01-01", "2020-06-01"), ("t", "a", "2020-05-01", "2020-07-01"), ("t", "b", "2021-01-01", None), (None, "c", "2020-01-01", None), ("t", "a", "2020-01-01", "2020-06-01")]
    targets = _ts(spark.createDataFrame(tgt, "k1 string, k2 string, loaded_at string, deleted_at string"), "loaded_at", "deleted_at")
    ref = [(1, "t", "a", "2020-06-15"), (2, "t", "a", "2020-07-01"), (3, "t", "b", "2020-01-01"), (4, "t", "z", "2020-01-01"), (5, None, "b", "2022-01-01"), (6, None, None, "2022-01-01"), (7, "t", "a", None), (8, "t", "a", "2019-01-01")]
    refs = _ts(spark.createDataFrame(ref, "id bigint, k1 string, k2 string, at string"), "at").withColumn("reason", F.lit("x")).withColumn("loaded_at", F.lit("y"))
    run = lambda m, **kw: {(r["id"], r["reason"]) for r in orphans(refs, targets, ["k1", "k2"], "id", "at", match=m, **kw).collect()}
    simple = {(2, "deleted"), (3, "late"), (4, "missing"), (8, "late")}
    assert run("simple") == simple
    assert run("simple", rows_per_salt=1) == simple
    assert run("partial") == simple
    assert run("full") == simple | {(5, "incomplete")}
    assert orphans(refs.limit(0), targets, ["k1", "k2"], "id", "at").count() == 0
    assert orphans(refs, targets.limit(0), ["k1", "k2"], "id", "at").where("reason = 'missing'").count() == 6


def _ladder(n):
    """Text of a ladder of n levels, with mutations; made without recursion."""
    head = '{"name": "n%d", "branch_attrs": {"mutations": {"nuc": ["A%dT", null, "A%dT"], "g": "x"}}, "children": [null, '
    return '{"tree": ' + "".join(head % (k, k + 1, k + 1) for k in range(n)) + '{"na\\u006de": "tip", "node_attrs": {"div": 0.5}}' + "]}" * n + "}"


def test_nested_beyond_the_parser(spark):
    n = 700
    deep = _ladder(n)
    shallow = _ladder(6)
    sites = '{"x": {"5": "A"}, "y": ' + "[" * 1500 + "]" * 1500 + "}"
    rows = [
        (1, "t", deep, sites, None, None, None), (2, "t", deep[:-1], sites[:-1], None, None, None), (3, "t", deep + " x", None, None, None, None),
        (4, "t", deep.replace('"name": "n9"', '"name": "n9", "name": "n9"'), None, None, None, None), (5, "t", shallow, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    got = [tuple(r) for r in record_items(df).collect()]
    path = lambda k: ".".join(["0"] + ["1"] * k)
    want = lambda i, n: [(i, "node", path(k - 1) if k else "", path(k)) for k in range(n + 1)] + [(i, "mutation", path(k), m) for k in range(n) for m in (f"nuc:A{k + 1}T", "g:x")]
    assert sorted(got) == sorted(want(1, n) + want(4, n) + want(5, 6) + [(1, "site", "x", "5:A")])
    names = {r["path"]: (r["name"], r["node_attrs"]) for r in flatten_records(df)["nodes"].where("record_id = 1").collect()}
    assert names[path(n)] == ("tip", '{"div":0.5}') and names["0"] == ("n0", None)


def test_nested_text_agrees_with_json():
    from cladeflow.kernels import nested_text as N

    for text in ("{}", " [1, -0.5e3, true, null, {\"a\": []}] ", '"x"', '"\\u00e9\\n"', "0", "[[],{}]", '{"a": {"a": 1}}'):
        assert N.is_whole(text) and json.loads(text) is not NotImplemented, text
        assert json.loads(N.pruned(text)) == json.loads(text)
    for text in ("", " ", "{", "[1,]", "[1 2]", "01", "{a: 1}", '{"a" 1}', '{"a": 1,}', "NaN", "nul", '"\t"', '"\\x"', "[1]]", "{]", "1 1", ","):
        assert not N.is_whole(text), text
    lists = list(N.tree_nodes('{"x": {"children": [{}]}, "tree": [{"name": "a", "children": {"b": [{"children": [{}]}], "children": "c"}}, null, {}]}'))
    assert N.tree_nodes('{"tree": {"children": [{"children": [{}]}], "name": "a", "children": {"name": "b"}}}') == [("0.0", "0", '{"name":"b"}'), ("0", "", '{"name":"a"}')]
    assert lists == [("0.0", "0", '{"b":[{"children": [{}]}]}'), ("0", "", '{"name":"a"}'), ("2", "", "{}")]


@pytest.mark.parametrize("name", sorted(record_queries.SQL))
def test_record_sql(compare, name):
    compare(record_queries.QUERIES[name], record_queries.SQL[name])


def test_record_queries_run(spark, small):
    for name, q in record_queries.QUERIES.items():
        assert q(spark, small).count() > 0, name


def test_name_orphans_columns(spark, small):
    from cladeflow.runtime import read

    df = name_orphans(read(spark, small, "metadata"), read(spark, small, "sequence_names"), read(spark, small, "nodes"))
    assert df.columns == ["table_name", "row_id", "reason", "ref_month"]
