"""Nested JSON to flat tables that keep parent-child links.

Spark reads the text once, into VARIANT, and lays the levels out as nested
Arrow lists. The child tables then come from the lists' offsets: parent-index
kernels number the children, and keys follow by vectorised take. No row is
looked at in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import parse_json


@dataclass(frozen=True)
class Level:
    """One level of nesting: path leads from the parent object to the list (or
    lone object) of children; fields are read as (name, SQL type). With lone,
    a parent without the path stands for its own only child."""

    name: str
    path: tuple[str, ...]
    fields: tuple[tuple[str, str], ...]
    lone: bool = False


def let(v: Column, then) -> Column:
    """then(v), with v worked out once however often then uses it."""
    return F.transform(F.array(v), then)[0]


def _decoded(v: Column) -> Column:
    """The JSON that a string holds, however often it was encoded: decoded until
    it is no string any more. NULL for what is no string, and for a string that
    holds no JSON. Each encoding puts quotes around, which the next one has to
    escape, so n of them make a text of 2**(n + 1) - 2 characters at least:
    the logarithm of the length bounds the rounds."""
    inner = lambda x: parse_json(F.try_variant_get(x, "$", "string"))
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    rounds = lambda x: F.sequence(F.lit(1), F.floor(F.log2(F.length(F.try_variant_get(x, "$", "string")) + 2)).cast("int"))
    return F.when(is_text(v), F.aggregate(rounds(v), inner(v), lambda x, _: F.when(is_text(x), inner(x)).otherwise(x)))


def as_struct(v: Column, fields: list[tuple[str, str]]) -> Column:
    """The fields of an object as a struct, NULL where missing or of another
    type; NULL for what is no object, be it as text or not. One look at the
    object finds them all."""
    kind = "struct<" + ",".join(f"`{f}`:{t}" for f, t in fields) + ">"
    get = lambda x: F.try_variant_get(x, "$", kind)
    return F.coalesce(get(v), get(_decoded(v)))


def as_list(v: Column) -> Column:
    """array<variant> of a list, or of a lone object; NULL for anything else."""
    items = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.when(F.try_variant_get(x, "$", "struct<`_`:variant>").isNotNull(), F.array(x)))
    return F.coalesce(items(v), let(_decoded(v), items))


def _objects(v: Column | None, parent: Column, levels: list[Level]) -> Column:
    """The children of one level, each with its own. parent has the first step of
    the level's path as a field; v is what stands in for a lone child."""
    level, rest = levels[0], levels[1:]
    node = parent[level.path[0]]
    for step in level.path[1:]:
        node = as_struct(node, [(step, "variant")])[step]
    items = let(node, as_list)
    if level.lone and v is not None:
        items = F.coalesce(items, F.when(parent.isNotNull(), F.array(v)))
    wanted = [*level.fields, *([(rest[0].path[0], "variant")] if rest else [])]

    def one(x: Column) -> Column:
        return let(as_struct(x, wanted), lambda s: F.struct(s.isNotNull().alias("is_object"), *[s[f].alias(f) for f, _ in level.fields], *([_objects(x, s, rest).alias("children")] if rest else [])))

    return F.transform(items, one)


def _emit(batches: Iterator[pa.RecordBatch], depth: int, levels: list[Level]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, keys = batch.column("children"), [batch.column("key")]
        for d in range(depth + 1):
            # for a list array: the row of each child, and its place in the row
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            parent = pa.array(np.repeat(np.arange(len(lists)), sizes))
            place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            child = lists.flatten()
            keys = [k.take(parent) for k in keys] + [pa.array(place, pa.int64())]
            if d < depth:
                lists = pc.struct_field(child, "children")
        keep = child.field("is_object")
        columns = keys + [child.field(f) for f, _ in levels[depth].fields]
        names = ["key", *(f"{x.name}_no" for x in levels[: depth + 1]), *(f for f, _ in levels[depth].fields)]
        yield pa.RecordBatch.from_arrays(columns, names).filter(keep)


def layout(df: DataFrame, *, key: str, text: str, levels: list[Level]) -> DataFrame:
    """(key, children): the JSON of every row as nested lists. Text that is NULL,
    blank or not valid JSON gives no children; so does valid JSON that isn't an
    object. Nothing is shuffled, so a frequent key weighs nothing."""
    v = parse_json(F.col(text).cast("string"))
    return df.select(F.col(key).cast("long").alias("key"), let(v, lambda x: let(as_struct(x, [(levels[0].path[0], "variant")]), lambda s: _objects(x, s, levels))).alias("children"))


def flatten(nested: DataFrame, levels: list[Level], depth: int) -> DataFrame:
    """The table of one level: key, the place of each ancestor and of the object
    itself (counted from 0, elements that aren't objects included), and the
    level's fields, NULL where missing or of another type. Only objects make
    rows. Link to the parent: key and all numbers but the last. Rows that repeat
    a record repeat its children, which count once; records that share a key
    (or have none) but differ keep the children of each."""
    types = {"int": "int", "long": "long", "double": "double", "boolean": "boolean", "string": "string"}
    schema = ["key long", *(f"{x.name}_no long" for x in levels[: depth + 1]), *(f"{f} {types[t]}" for f, t in levels[depth].fields)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(batches, depth, levels)

    return nested.select("key", "children").mapInArrow(emit, ", ".join(schema)).distinct()


def outline(nested: DataFrame, levels: list[Level], depths: tuple[int, ...]) -> DataFrame:
    """The places of the objects of several levels, in one pass: key and the
    number at each level down to the deepest asked for; -1 below an object's own
    level. Repeated records count once."""
    names = [f"{x.name}_no" for x in levels[: max(depths) + 1]]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in depths:
                for b in _emit(iter([batch]), d, levels):
                    below = pa.array(np.full(b.num_rows, -1), pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(k) for k in range(d + 2)] + [below] * (len(names) - d - 1), ["key", *names])

    return nested.select("key", "children").mapInArrow(emit, ", ".join(["key long", *(f"{n} long" for n in names)])).distinct()


#: The trace of a boundary probe: attempts (or the record itself), the load
#: results of each, and the accesses of each load result.
TRACE = [
    Level("attempt", ("attempts",), (("attempt", "int"), ("skipped", "boolean")), lone=True),
    Level("load", ("hydration_trace", "load_results"), (("repo", "string"), ("branch", "string"), ("requested_hydration", "string"), ("symbol_collection_type", "string"), ("lazy_loaded_at_return", "boolean"))),
    Level("access", ("accesses",), (("kind", "string"), ("ms", "double"), ("symbol_id", "string"))),
]
