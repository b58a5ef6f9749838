"""Nested JSON records as chunk texts: each top node by its class, nested ones by path.

Values stay JSON text in the order of their keys, compactly printed. A null or broken record gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count
from ..storage import stored
from .chunking import bundles

#: Fixed classes of the top nodes; others are counted by ``unmapped``.
CLASSES = {
    "basics": "whole", "changelog": "whole", "trivia": "whole",
    "abilities": "ability", "innate_abilities": "ability", "invoked_abilities": "ability",
    "guide": "nested", "profile": "profile",
}


def _fields(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def _items(json: Column) -> Column:
    return F.from_json(json, "array<string>")


def _is(json: Column, bracket: str) -> Column:
    return F.coalesce(F.ltrim(json).startswith(bracket), F.lit(False))


def top_nodes(records: DataFrame) -> DataFrame:
    """(record_id, name, node, json) of records (record_id, json); ``name`` is the profile's, else the id."""
    name = F.coalesce(F.nullif(F.get_json_object("json", "$.profile.name"), F.lit("")), F.col("record_id").cast("string"))
    return records.select("record_id", name.alias("name"), F.explode(_fields(F.col("json"))).alias("node", "json"))


def unmapped(nodes: DataFrame) -> DataFrame:
    """How many records have a node that no class is known for."""
    return nodes.where(~F.col("node").isin(list(CLASSES))).groupBy("node").agg(F.count("*").alias("n"))


def flatten(nodes: DataFrame) -> DataFrame:
    """(..., path, item_no, text): objects by dotted path, lists of objects by item, all else whole, at any depth.

    ``nodes`` has path and json. An item is named by its title, its name or its number. A frontier of objects
    is opened level by level, each stored once, until none is left.
    """
    kept = [c for c in nodes.columns if c not in ("path", "json")]
    level, leaves = nodes.withColumn("item_no", F.lit(0)), []
    while True:
        level = stored(level.withColumn("is_object", _is(F.col("json"), "{")), "frontier")
        objects, others = level.where("is_object").drop("is_object"), level.where("NOT is_object").drop("is_object")
        objects_in = _is(F.get(_items(F.col("json")), F.lit(0)), "{")
        of_objects = _is(F.col("json"), "[") & F.coalesce(objects_in, F.lit(False))
        leaves.append(others.where(~of_objects).select(*kept, "path", "item_no", F.col("json").alias("text")))
        item = others.where(of_objects).select(*kept, "path", F.posexplode(_items(F.col("json"))).alias("item_no", "text"))
        title = F.coalesce(*[F.nullif(F.get_json_object("text", f"$.{k}"), F.lit("")) for k in ("title", "name")], F.concat(F.lit("item_"), "item_no"))
        leaves.append(item.select(*kept, F.concat_ws(".", F.nullif("path", F.lit("")), title).alias("path"), "item_no", "text"))
        if objects.isEmpty():
            return reduce(DataFrame.unionByName, leaves)
        level = objects.select(*kept, "path", "item_no", F.explode(_fields(F.col("json"))).alias("k", "json"))
        level = level.select(*kept, F.concat_ws(".", F.nullif("path", F.lit("")), "k").alias("path"), "item_no", "json")


def bundled(lists: DataFrame, budget: int) -> DataFrame:
    """(..., chunk_index, text): the items of each row's JSON list joined by bars while their tokens fit the budget."""
    kept = [c for c in lists.columns if c != "json"]
    items = lists.select(*kept, F.filter(_items(F.col("json")), lambda x: x.isNotNull()).alias("items")).where(F.size("items") > 0)
    at = items.withColumn("b", bundles(F.transform("items", token_count), budget))
    numbers = F.sequence(F.lit(0), F.element_at("b", -1))
    each = at.select(*kept, "items", "b", F.explode(numbers).alias("chunk_index"))
    mine = F.filter(F.arrays_zip("items", "b"), lambda z: z["b"] == F.col("chunk_index"))
    return each.select(*kept, "chunk_index", F.array_join(F.transform(mine, lambda z: z["items"]), " | ").alias("text"))


def dispatch(nodes: DataFrame, budget: int = 480, long_tokens: int = 100) -> DataFrame:
    """(record_id, name, primary_node, sub_node, chunk_index, text) of top nodes, by CLASSES.

    Whole nodes stay as they are; an ability gives its core and bundles of its notes; nested ones are
    flattened; a profile's texts of more than ``long_tokens`` tokens stand alone, its other fields are ``metadata``.
    """
    keys = ["record_id", "name", F.col("node").alias("primary_node")]
    of = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    classed = nodes.withColumn("class", F.element_at(of, F.col("node")))
    is_list = (F.col("class") == "ability") & _is(F.col("json"), "[")
    whole = classed.where((F.col("class") == "whole") | (F.col("class") == "ability") & ~_is(F.col("json"), "["))
    out = [whole.select(*keys, F.lit("root").alias("sub_node"), F.lit(0).alias("chunk_index"), F.col("json").alias("text"))]

    each = classed.where(is_list).select(*keys, F.explode(_items(F.col("json"))).alias("json"))
    title = F.coalesce(*[F.nullif(F.get_json_object("json", f"$.{k}"), F.lit("")) for k in ("name", "id")], F.lit("Unknown_Ability"))
    raw = F.array_join(F.transform(F.map_entries(F.map_filter(_fields(F.col("json")), lambda k, v: k != "notes")), _pair), ",")
    core = each.select("record_id", "name", "primary_node", F.concat(title, F.lit(".core")).alias("sub_node"), F.lit(0).alias("chunk_index"), F.concat(F.lit("{"), raw, F.lit("}")).alias("text"))
    told = each.select("record_id", "name", "primary_node", F.concat(title, F.lit(".notes")).alias("sub_node"), F.get_json_object("json", "$.notes").alias("json"))
    out += [core, bundled(told.where(_is(F.col("json"), "[")), budget)]

    nested = flatten(classed.where(F.col("class") == "nested").select(*keys, F.lit("").alias("path"), "json"))
    out.append(nested.select("record_id", "name", "primary_node", F.col("path").alias("sub_node"), F.col("item_no").alias("chunk_index"), "text"))

    fields = classed.where(F.col("class") == "profile").select(*keys, _fields(F.col("json")).alias("f"))
    long, short = (F.map_filter("f", test) for test in (lambda k, v: _is_long(v, long_tokens), lambda k, v: ~_is_long(v, long_tokens)))
    alone = fields.select("record_id", "name", "primary_node", F.explode(long).alias("sub_node", "text")).withColumn("chunk_index", F.lit(0))
    rest = fields.withColumn("short", short).where(F.size("short") > 0)
    metadata = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("short"), _pair), ","), F.lit("}"))
    out += [alone, rest.select("record_id", "name", "primary_node", F.lit("metadata").alias("sub_node"), F.lit(0).alias("chunk_index"), metadata.alias("text"))]
    return reduce(DataFrame.unionByName, out)


def _pair(entry: Column) -> Column:
    """``"key":value`` again; texts, which the reader unquoted, are quoted, everything that reads as other JSON isn't."""
    bare = entry["value"].rlike(r"^\s*[\[{]") | entry["value"].rlike(r"^(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false)$")
    return F.concat(_quoted(entry["key"]), F.lit(":"), F.when(entry["value"].isNull(), "null").when(bare, entry["value"]).otherwise(_quoted(entry["value"])))


def _quoted(text: Column) -> Column:
    """A JSON text: the written array of it without its brackets."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def _is_long(value: Column, tokens: int) -> Column:
    return F.coalesce((token_count(value) > tokens) & ~value.rlike(r"^\s*[\[{]"), F.lit(False))
