"""Deeply nested tree records to related flat tables.

Everything is a projection: a record's tree is walked level by level with nested ``transform``
calls that attach the ancestor's path and the child's index, ``flatten`` joins the arrays of a
level, and one ``inline`` per target table emits the rows. The levels are the steps of one
``aggregate`` over a sequence as long as the record could be deep, which does nothing once a
level is empty: all levels in one projection, without a shuffle. The SQL parser refuses more than
1,000 levels of brackets; what it rejects and could be that deep is read with an explicit stack.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.kernels import nested_text as N
from cladeflow.runtime import materialize

_NODE = (
    "struct<name:string,children:variant,node_attrs:variant,"
    "branch_attrs:struct<mutations:map<string,array<string>>>>"
)
_ONE = "struct<branch_attrs:struct<mutations:map<string,string>>>"


def whole_json(col: str) -> Column:
    """Variant of a text that is one valid JSON value as a whole, else null.

    The parser stops after the first value, so the text is also parsed inside one and two pairs
    of brackets: what follows the first value then breaks the array or makes it longer.
    """
    c = f"`{col}`"
    return F.expr(
        f"case when json_array_length(concat('[', {c}, ']')) = 1 and json_array_length(concat('[[', {c}, ']]')) = 1 "
        f"then try_parse_json({c}) end"
    )


def last_of_repeated_keys(df: DataFrame) -> None:
    """Lets the session's JSON parser read objects with repeated keys, of which the last counts."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def rejected(df: DataFrame, record_id: str, json_col: str) -> DataFrame:
    """(record_id, text) of the texts that the SQL parser rejects and that may only be too deep or too long for it."""
    c = F.col(json_col)
    opened = F.length(c) - F.length(F.translate(c, "{[", ""))
    # the parse is repeated for such texts only
    doubtful = F.when((opened >= 900) | (F.length(c) >= 1_000_000), whole_json(json_col).isNull())
    return df.select(F.col(record_id).alias("record_id"), c.alias("text")).where(doubtful)


def _deep_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["record_id", "path", "owner", "text"]
    for b in batches:
        for i, text in zip(b["record_id"], b["text"]):
            if not N.is_whole(text):
                continue
            rows, size = [], 0
            for node in N.tree_nodes(text):
                rows.append((i, *node))
                size += sum(map(len, node))
                if size > 4_000_000:
                    yield pd.DataFrame(rows, columns=cols)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=cols)


def _pruned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b = b[b["text"].map(N.is_whole).astype(bool)]
        yield b.assign(text=b["text"].map(N.pruned))


def _id_type(df: DataFrame) -> str:
    return f"record_id {df.schema['record_id'].dataType.simpleString()}"


def _node(v: Column, path: Column, owner: Column) -> Column:
    return F.struct(
        path.alias("path"),
        owner.alias("owner"),
        F.try_variant_get(v, "$", _NODE).alias("s"),
        F.try_variant_get(v, "$", _ONE).alias("one"),
    )


def _entries(v: Column) -> Column:
    """The entries of an array; anything else counts as an array of one."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def _present(level: Column) -> Column:
    return F.filter(level, lambda n: n["s"].isNotNull())


def _children(level: Column) -> Column:
    below = F.transform(
        level,
        lambda n: F.transform(
            _entries(n["s"]["children"]),
            lambda c, k: _node(c, F.concat(n["path"], F.lit("."), k.cast("string")), n["path"]),
        ),
    )
    return _present(F.flatten(below))


def _row(n: Column) -> Column:
    lists, ones = n["s"]["branch_attrs"]["mutations"], n["one"]["branch_attrs"]["mutations"]
    genes = F.transform(
        F.coalesce(F.map_keys(ones), F.array().cast("array<string>")),
        lambda g: F.struct(
            g.alias("gene"),
            F.array_distinct(
                F.filter(F.coalesce(F.try_element_at(lists, g), F.array(F.try_element_at(ones, g))), lambda m: m.isNotNull())
            ).alias("mutations"),
        ),
    )
    return F.struct(
        n["owner"].alias("parent_path"),
        n["path"].alias("path"),
        n["s"]["name"].alias("name"),
        n["s"]["node_attrs"].cast("string").alias("node_attrs"),
        F.filter(genes, lambda g: F.size(g["mutations"]) > 0).alias("genes"),
    )


def tree_levels(df: DataFrame, record_id: str, json_col: str) -> DataFrame:
    """(record_id, nodes array) per record; materialised in the shared folder.

    Nulls, empty and damaged texts and records without a tree give no rows. Of repeated keys in
    one object the last counts. Repeated records are kept apart only by their record_id. A
    record that is too deep for the SQL parser has a row per node.
    """
    last_of_repeated_keys(df)
    doc = whole_json(json_col)
    # no tree is deeper than its text has opening braces
    most = F.length(json_col) - F.length(F.replace(F.col(json_col), F.lit("{"), F.lit("")))
    base = df.select(F.col(record_id).alias("record_id"), doc.alias("_d"), most.alias("_most")).where(F.col("_d").isNotNull())
    tree = F.try_variant_get("_d", "$.tree", "variant")
    as_list = F.try_variant_get("_d", "$.tree", "array<variant>")
    roots = F.when(
        as_list.isNotNull(), F.transform(as_list, lambda c, k: _node(c, k.cast("string"), F.lit("")))
    ).otherwise(F.array(_node(tree, F.lit("0"), F.lit(""))))
    at = base.select("record_id", "_most", _present(roots).alias("_roots"))
    level = at.schema["_roots"].dataType.simpleString()
    rows = at.select(F.transform("_roots", _row).alias("x")).schema["x"].dataType.simpleString()
    acc = f"struct<at:{level},rows:array<{rows}>>"  # a list of rows per level, joined once at the end
    start = F.struct(F.col("_roots").alias("at"), F.array().cast(f"array<{rows}>").alias("rows")).cast(acc)

    def step(a: Column, _: Column) -> Column:
        deeper = F.struct(
            _children(a["at"]).alias("at"), F.concat(a["rows"], F.array(F.transform(a["at"], _row))).alias("rows")
        ).cast(acc)
        return F.when(F.size(a["at"]) == 0, a).otherwise(deeper)

    walked = F.aggregate(F.sequence(F.lit(0), F.col("_most")), start, step, lambda a: F.flatten(a["rows"]))
    out = at.select("record_id", walked.alias("nodes"))
    deep = rejected(df, record_id, json_col)
    deep = deep.mapInPandas(_deep_nodes, f"{_id_type(deep)}, path string, owner string, text string")
    node = _node(F.expr("try_parse_json(text)"), F.col("path"), F.col("owner"))
    deep = deep.select("record_id", node.alias("n")).select("record_id", F.array(_row(F.col("n"))).cast(rows).alias("nodes"))
    return materialize(out.unionByName(deep), "levels")


def node_table(levels: DataFrame) -> DataFrame:
    """One row per node: record_id, parent_path ("" for a root), path, name, node_attrs (JSON)."""
    return levels.select("record_id", F.inline("nodes")).drop("genes")


def mutation_table(levels: DataFrame) -> DataFrame:
    """One row per distinct mutation on the branch above a node: record_id, path, gene, mutation."""
    per_node = F.transform(
        "nodes",
        lambda n: F.flatten(
            F.transform(
                n["genes"],
                lambda g: F.transform(
                    g["mutations"], lambda m: F.struct(n["path"].alias("path"), g["gene"].alias("gene"), m.alias("mutation"))
                ),
            )
        ),
    )
    return levels.select("record_id", F.inline(F.flatten(per_node)))


def taxon_items(df: DataFrame, record_id: str, json_col: str, value_name: str) -> DataFrame:
    """Rows (record_id, taxon, pos, value) of a text taxon -> position -> value.

    Read shapes, also mixed in one text: {taxon: {pos: value}}, {taxon: [[pos, value], ...]} and
    [{taxon, sites: [{pos, <value_name>}, ...]}]; one object where an array is usual counts as an
    array of one. Entries without taxon, position or value are no rows; a text that is not valid
    JSON as a whole gives none.
    """
    last_of_repeated_keys(df)
    site = f"struct<pos:string,{value_name}:string>"
    src = df.select(F.col(record_id).alias("record_id"), whole_json(json_col).alias("_d")).where(F.col("_d").isNotNull())
    deep = rejected(df, record_id, json_col)
    deep = deep.mapInPandas(_pruned, f"{_id_type(deep)}, text string").select("record_id", F.expr("try_parse_json(text)").alias("_d"))
    src = src.unionByName(deep.where(F.col("_d").isNotNull()))
    get = lambda kind: F.try_variant_get("_d", "$", kind)
    listed, listed_one = f"struct<taxon:string,sites:array<{site}>>", f"struct<taxon:string,sites:{site}>"
    src = src.select(
        "record_id",
        get("map<string,map<string,string>>").alias("_maps"),
        get("map<string,array<array<string>>>").alias("_pairs"),
        F.coalesce(get(f"array<{listed}>"), F.array(get(listed))).alias("_many"),
        F.coalesce(get(f"array<{listed_one}>"), F.array(get(listed_one))).alias("_one"),
    )
    item = lambda t, p, v: F.struct(t.alias("taxon"), p.alias("pos"), v.alias("value"))
    empty = "array<struct<taxon:string,pos:string,value:string>>"
    from_maps = F.flatten(
        F.transform(
            F.map_entries("_maps"),
            lambda e: F.coalesce(
                F.transform(F.map_entries(e["value"]), lambda x: item(e["key"], x["key"], x["value"])),
                F.array().cast(empty),
            ),
        )
    )
    from_pairs = F.flatten(
        F.transform(
            F.map_entries("_pairs"),
            lambda e: F.coalesce(
                F.transform(e["value"], lambda x: item(e["key"], F.get(x, F.lit(0)), F.get(x, F.lit(1)))), F.array().cast(empty)
            ),
        )
    )
    from_many = F.flatten(
        F.transform(
            "_many",
            lambda e: F.coalesce(
                F.transform(e["sites"], lambda x: item(e["taxon"], x["pos"], x[value_name])), F.array().cast(empty)
            ),
        )
    )
    from_one = F.transform("_one", lambda e: item(e["taxon"], e["sites"]["pos"], e["sites"][value_name]))
    parts = [F.coalesce(x, F.array().cast(empty)) for x in (from_maps, from_pairs, from_many, from_one)]
    rows = F.filter(
        F.concat(*parts), lambda x: x["taxon"].isNotNull() & x["pos"].isNotNull() & x["value"].isNotNull()
    )
    return src.select("record_id", F.inline(rows))


def flatten_records(df: DataFrame) -> dict[str, DataFrame]:
    """The four related tables of exported tree records.

    df: record_id, auspice_json, sequences, insertions (further columns are ignored).
    nodes -> record_id, path; mutations -> nodes by (record_id, path); sites and insertions ->
    record_id and taxon. An empty df gives empty tables.
    """
    lv = tree_levels(df, "record_id", "auspice_json")
    return {
        "nodes": node_table(lv),
        "mutations": mutation_table(lv),
        "sites": taxon_items(df, "record_id", "sequences", "state"),
        "insertions": taxon_items(df, "record_id", "insertions", "bases"),
    }


def record_items(df: DataFrame) -> DataFrame:
    """All four tables in one: record_id, kind, owner_key, item_key."""
    t = flatten_records(df)
    kind = lambda d, k, owner, key: d.select("record_id", F.lit(k).alias("kind"), owner.alias("owner_key"), key.alias("item_key"))
    join = lambda a, b: F.concat(F.col(a), F.lit(":"), F.col(b))
    return (
        kind(t["nodes"], "node", F.col("parent_path"), F.col("path"))
        .unionByName(kind(t["mutations"], "mutation", F.col("path"), join("gene", "mutation")))
        .unionByName(kind(t["sites"], "site", F.col("taxon"), join("pos", "value")))
        .unionByName(kind(t["insertions"], "insertion", F.col("taxon"), join("pos", "value")))
    )
