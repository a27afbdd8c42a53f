"""Deeply nested records to flat tables that keep parent and child linked.

Every node gets a Dewey label, the ordinals on the path from the root. A child's label
extends its parent's, so the parent key is the label without its last place, and the
path of names without ordinals says which table a node belongs to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "key long, path string, dewey array<int>, title string, fields string"


def _reject(name: str) -> None:
    raise ValueError(name)


def parse(body: str | None) -> object:
    """The JSON value of a text, None if the text is no valid JSON. The non-standard NaN and Infinity are invalid."""
    if not body:
        return None
    try:
        return json.loads(body, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None


def members(value: object) -> list:
    """(place, object) of the members that are objects.

    A lone object or bare string stands for an array of one, a bare string for an object
    with that title. Null members and members of any other type keep their place and
    yield nothing; a value of any other type has no members.
    """
    if isinstance(value, dict | str):
        value = [value]
    if not isinstance(value, list):
        return []
    return [(i, {"title": x} if isinstance(x, str) else x) for i, x in enumerate(value) if isinstance(x, dict | str)]


def walk(node: dict, shape: dict, path: str, label: tuple[int, ...], out: list) -> None:
    """Appends (path, label, object, names below it) for the nodes below ``node`` that ``shape`` names, parents first."""
    for field, below in shape.items():
        for place, child in members(node.get(field)):
            out.append((f"{path}/{field}", (*label, place), child, below))
            walk(child, below, f"{path}/{field}", (*label, place), out)


def nodes(df: DataFrame, key: str, body: str, root: tuple[str, ...], section_id: str, section: str, shapes: dict[str, dict]) -> DataFrame:
    """(key, path, dewey, title, fields) for every object of the named sections.

    ``root`` leads to the array of sections, ``shapes`` maps a section id to the nested
    names of the arrays to take. The first place of ``dewey`` is the section's place in
    that array, each further place that of an object in its array, all from 0.
    ``fields`` holds all else of the object as JSON: everything but a title that is text and
    the members that are nodes of their own. Rows with a null key or a body that
    is null, cut off or without the root array give nothing; other sections are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("path", pa.string()), ("dewey", pa.list_(pa.int32())), ("title", pa.string()), ("fields", pa.string())])
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = parse(text)
                for name in root:
                    value = value.get(name) if isinstance(value, dict) else None
                found: list = []
                for place, holder in members(value) if isinstance(value, list | dict) else []:
                    sid = holder.get(section_id)
                    shape = shapes.get(sid) if isinstance(sid, str) else None
                    if shape and isinstance(holder.get(section), dict):
                        walk(holder[section], shape, sid, (place,), found)
                for path, label, node, below in found:
                    title = node.get("title")
                    rest = {a: b for a, b in node.items() if not (isinstance(b, str) if a == "title" else a in below and isinstance(b, dict | list | str))}
                    for column, cell in zip(rows, (k, path, label, title if isinstance(title, str) else None, json.dumps(rest, ensure_ascii=False) if rest else None)):
                        column.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return df.where(F.col(key).isNotNull() & F.col(body).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(body).alias("body")).mapInArrow(run, NODE_SCHEMA)


def dewey_key(key: Column, label: Column) -> Column:
    return F.concat_ws(".", key.cast("string"), F.array_join(label.cast("array<string>"), "."))


def table_of(all_nodes: DataFrame, path: str) -> DataFrame:
    """The flat table of one schema path: node_key, parent_key (the label without its last place), ordinals, title, fields."""
    label = F.col("dewey")
    return all_nodes.where(F.col("path") == path).select(dewey_key(F.col("key"), label).alias("node_key"), dewey_key(F.col("key"), F.slice(label, F.lit(1), F.size(label) - 1)).alias("parent_key"), F.col("key"), label.alias("dewey"), "title", "fields")


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}


def typed(value: object, kind: str) -> object:
    """The value of a column of that type, None if it is of any other. A whole number may be written as text."""
    if kind == "long":
        if isinstance(value, str) and value.isascii() and value.isdigit() and len(value) < 19:
            return int(value)
        return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63 else None
    return value if isinstance(value, {"string": str, "boolean": bool}[kind]) else None


def columns_of(flat: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(node_key, parent_key, key, title, the named columns, rest) of a ``table_of``.

    ``fields`` maps a column to the name of its field and its type: string, boolean or long.
    ``rest`` is the JSON of all fields that no column holds: others, and those of another
    type than their column's. A field that is null is null in its column and not in the rest.
    """
    names = ["node_key", "parent_key", "key", "title"]
    schema = pa.schema([("node_key", pa.string()), ("parent_key", pa.string()), ("key", pa.int64()), ("title", pa.string()), *((c, _ARROW[t]) for c, (_, t) in fields.items()), ("rest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[list] = [[] for _ in fields]
            rests: list[str | None] = []
            for text in batch.column("fields").to_pylist():
                held = json.loads(text) if text else {}
                for column, (name, kind) in zip(cells, fields.values()):
                    column.append(typed(held.get(name), kind))
                    if column[-1] is not None or held.get(name, 0) is None:
                        del held[name]
                if held.get("title", 0) is None:
                    del held["title"]
                rests.append(json.dumps(held, ensure_ascii=False, separators=(",", ":")) if held else None)
            made = [pa.array(c, _ARROW[t]) for c, (_, t) in zip(cells, fields.values())]
            yield pa.RecordBatch.from_arrays([*[batch.column(n).cast(schema.field(n).type) for n in names], *made, pa.array(rests, pa.string())], schema=schema)

    ddl = ", ".join(["node_key string, parent_key string, key long, title string", *(f"{c} {t}" for c, (_, t) in fields.items()), "rest string"])
    return flat.select(*names, "fields").mapInArrow(run, ddl)
