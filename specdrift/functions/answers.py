"""Answers found in providers' output, and schemas reduced to what all providers take, as Spark variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specdrift.plans.shared import discard, stored

#: Fields whose content is looked at before all others, and how deep.
TEXT_FIELDS = ("result", "response", "text", "content", "message")
DEEPEST = 6
#: Keys that not every provider's schemas may have.
OMITTED = ("$schema", "minLength", "propertyNames")

_CHILD = "array<struct<place:struct<rank:int,pos:int>,v:variant>>"


def _children(v: Column) -> Column:
    """Members of an object, text fields first, or elements of an array, with their places; null for all else."""
    rank = lambda key: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(f) for f in TEXT_FIELDS]), key), F.lit(0)), F.lit(len(TEXT_FIELDS) + 1)).cast("int")
    fields = F.transform(F.map_entries(v.try_cast("map<string,variant>")), lambda e, i: F.struct(F.struct(rank(e["key"]).alias("rank"), i.alias("pos")).alias("place"), e["value"].alias("v")))
    items = F.transform(v.try_cast("array<variant>"), lambda e, i: F.struct(F.struct(F.lit(0).alias("rank"), i.alias("pos")).alias("place"), e.alias("v")))
    return F.coalesce(fields, items)


def _is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _answer(v: Column, deep: bool = False) -> Column:
    """The object itself if it has an id and a verdict, both texts (not where that is too ``deep``); of a text that holds an
    object, that object."""
    own = _is_text(F.try_variant_get(v, "$.id", "variant")) & _is_text(F.try_variant_get(v, "$.verdict", "variant"))
    text = F.when(_is_text(v), v.cast("string"))
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(own & F.lit(not deep), v).when(F.contains(text, F.lit("{")), F.try_parse_json(inner))


def salvaged(outputs: DataFrame, key: str, output: str) -> DataFrame:
    """(key, answer string): the first answer, as JSON, in each provider's output; null if there is none.

    Looked at are the whole output, then its lines from the last, where they are objects. An answer is an object with id and verdict, or
    the object in a text, found by going down objects and arrays six levels deep, text fields before the other
    members, these in the order of their names. One projection: variants are opened in rounds, and what is found
    early is carried along. Rows that repeat a key give one.
    """
    whole = F.trim(F.col(output))
    lines = F.concat(F.array(whole), F.reverse(F.split(F.col(output), "\n", -1)))
    tried = outputs.select(F.col(key).alias("key"), F.posexplode(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))).alias("cand", "t"))
    rows = tried.filter(F.startswith("t", F.lit("{"))).select("key", "cand", F.array().cast("array<struct<rank:int,pos:int>>").alias("path"), F.try_parse_json("t").alias("v"))
    rows = rows.filter("v is not null").select("key", "cand", "path", "v", _answer(F.col("v")).alias("answer"))
    for depth in range(1, DEEPEST + 2):
        kept = F.array(F.struct(F.lit(None).cast("struct<rank:int,pos:int>").alias("place"), F.col("v").alias("v"))).cast(_CHILD)
        opened = rows.withColumn("c", F.explode(F.when(F.col("answer").isNotNull(), kept).otherwise(_children(F.col("v")))))
        path = F.when(F.col("c.place").isNull(), F.col("path")).otherwise(F.concat("path", F.array("c.place")))
        rows = opened.select("key", "cand", path.alias("path"), F.col("c.v").alias("v"), "answer").withColumn("answer", F.coalesce("answer", _answer(F.col("v"), depth > DEEPEST)))
    found = rows.filter("answer is not null").select("key", F.struct("cand", "path", F.to_json("answer").alias("json")).alias("a"))
    best = found.groupBy("key").agg(F.min("a").alias("a"))
    return outputs.select(F.col(key).alias("key")).distinct().join(best, "key", "left").select(F.col("key").alias(key), F.col("a.json").alias("answer"))


def portable_schemas(schemas: DataFrame, key: str, schema: str, omitted: tuple[str, ...] = OMITTED) -> DataFrame:
    """(key, schema string): JSON schemas without the keys ``omitted``, at any depth; members in the order of their names. Text
    that is no JSON gives null. Keys must be unique.

    Variants are opened level by level, leaving those keys out, and put together again from the deepest level up.
    """
    top = schemas.select(F.col(key).alias("key"), F.array().cast("array<int>").alias("at"), F.lit(None).cast("string").alias("name"), F.try_parse_json(F.col(schema)).alias("v"))
    parts, now = [], top.filter("v is not null")
    while True:
        fields = F.map_entries(F.col("v").try_cast("map<string,variant>"))
        kind = F.when(fields.isNotNull(), "object").when(F.col("v").try_cast("array<variant>").isNotNull(), "array").otherwise("plain")
        # variants cannot be grouped or written as they are everywhere; their JSON can
        now = stored(now.select("key", "at", "name", kind.alias("kind"), F.to_json("v").alias("json")), "schema")
        parts.append(now)
        if now.filter("kind <> 'plain'").isEmpty():
            break
        v = F.parse_json("json")
        fields = F.filter(F.map_entries(v.try_cast("map<string,variant>")), lambda e: ~e["key"].isin(*omitted))
        fields = F.transform(fields, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("v")))
        items = F.transform(v.try_cast("array<variant>"), lambda e: F.struct(F.lit(None).cast("string").alias("name"), e.alias("v")))
        opened = now.filter("kind <> 'plain'").select("key", "at", F.posexplode(F.coalesce(fields, items)).alias("i", "c"))
        now = opened.select("key", F.concat("at", F.array("i")).alias("at"), "c.name", "c.v")
    built = None
    for part in reversed(parts):
        if built is None:
            whole = part.select("key", "at", "name", "json")
        else:
            quoted = F.regexp_extract(F.to_json(F.struct("name")), r'^\{"name":(.*)\}$', 1)
            label = F.when(F.col("name").isNull(), F.col("json")).otherwise(F.concat(quoted, F.lit(":"), F.col("json")))
            place = F.struct(F.element_at("at", -1).alias("i"), label.alias("s"))
            inner = built.groupBy("key", F.slice("at", 1, F.size("at") - 1).alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["s"]), ",").alias("inner"))
            body = F.coalesce("inner", F.lit(""))
            json = F.when(F.col("kind") == "object", F.concat(F.lit("{"), body, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.col("json"))
            whole = part.join(inner, ["key", "at"], "left").select("key", "at", "name", json.alias("json"))
        built = whole
    out = stored(schemas.select(F.col(key).alias("key")).join(built.select("key", F.col("json").alias("schema")), "key", "left").select(F.col("key").alias(key), "schema"), "schemas")
    discard(*parts)
    return out
