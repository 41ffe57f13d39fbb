"""Deeply nested records to flat tables, linked by interval labels.

``label_nodes`` walks each JSON payload depth first and gives every object or
array member named by the layout a pre-order and a post-order number.  Node A
lies inside node B exactly if ``B.pre < A.pre and A.post < B.post``, so the
parent of any node can be found from the two numbers alone.  ``link_children``
does so with one window per record: nodes of one entity never contain each
other, so the only candidate is the last one opened before the child, and the
post-order numbers tell whether it is still open.

The walk is tolerant of writer versions: a payload may be wrapped in another
object, members may be missing or null, a list may be given as a single object,
as an object keyed by the child's key or as a JSON string, and a set of named
values may be an object, a list of name/value pairs or a JSON string.

Defined results: null and unreadable payloads give no rows (``unreadable_records``
lists them); null members of arrays are skipped but keep their index; repeated
deliveries give equal rows once the table is made distinct; very deep payloads
are walked with an explicit stack, so depth is bounded only by the JSON reader;
further columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entity:
    """One kind of node: the member holding it, the attribute naming it, and what it contains.

    kind ``objects``: a list of objects; ``arrays``: a list of anything, named by
    its index; ``pairs``: named values.
    """

    name: str
    member: str
    key: str | None = None
    kind: str = "objects"
    children: tuple[Entity, ...] = ()


@dataclass(frozen=True)
class Layout:
    """A root entity: recognised by any of ``keys``, which also name it in that order."""

    name: str
    keys: tuple[str, ...]
    children: tuple[Entity, ...] = field(default=())


DOCUMENT = Layout(
    "document",
    ("document_id", "metadata.document_id"),
    (
        Entity(
            "page",
            "pages",
            "pdf_page_number",
            children=(Entity("element", "elements", "element_id", children=(Entity("table_row", "rows", kind="arrays"),)),),
        ),
    ),
)
RELATIONSHIP = Layout("relationship", ("relationship_id",), (Entity("signal", "comparison", kind="pairs"),))

NODE_SCHEMA = (
    "record_id long, delivery long, entity string, pre int, post int, depth int, node_key string, attributes string"
)
_ARROW = pa.schema(
    [
        ("record_id", pa.int64()),
        ("delivery", pa.int64()),
        ("entity", pa.string()),
        ("pre", pa.int32()),
        ("post", pa.int32()),
        ("depth", pa.int32()),
        ("node_key", pa.string()),
        ("attributes", pa.string()),
    ]
)


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value) if isinstance(value, int | float) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _decoded(value: object) -> object:
    """A member that may have been written as a JSON string."""
    if isinstance(value, str) and value.strip()[:1] in ("[", "{"):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def _at(obj: dict, dotted: str) -> object:
    value: object = obj
    for part in dotted.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def _members(entity: Entity, holder: object) -> Iterator[tuple[str | None, object]]:
    """The nodes of an entity in a holder, whatever shape the writer chose."""
    value = _decoded(holder.get(entity.member)) if isinstance(holder, dict) else None
    if value is None:
        return
    if entity.kind == "pairs":
        if isinstance(value, dict):
            if set(value) <= {"name", "value"} and isinstance(value.get("name"), str):
                value = [value]
            else:
                value = [{"name": k, "value": v} for k, v in value.items()]
        for pair in value if isinstance(value, list) else ():
            if isinstance(pair, dict) and pair.get("name") is not None and pair.get("value") is not None:
                yield f"{_text(pair['name'])}={_text(pair['value'])}", pair
    elif entity.kind == "arrays":
        for i, row in enumerate(value if isinstance(value, list) else list(value.values()) if isinstance(value, dict) else ()):
            if row is not None:
                yield str(i), row
    elif isinstance(value, list):
        for x in map(_decoded, value):
            if isinstance(x, dict):
                yield _text(x.get(entity.key)), x
    elif isinstance(value, dict):
        inner = {c.member for c in entity.children}
        if entity.key in value or inner & value.keys() or not all(isinstance(_decoded(v), dict | None) for v in value.values()):
            yield _text(value.get(entity.key)), value
        else:
            for k, x in value.items():
                x = _decoded(x)
                if isinstance(x, dict):
                    own = _text(x.get(entity.key))
                    yield (own if own is not None else k), x


def _roots(value: object, layouts: tuple[Layout, ...]) -> Iterator[tuple[Layout, str | None, dict]]:
    """Unwrap a payload down to the objects a layout recognises."""
    todo = [value]
    while todo:
        value = _decoded(todo.pop())
        if isinstance(value, list):
            todo.extend(reversed(value))
        elif isinstance(value, dict):
            for layout in layouts:
                if layout.keys[0] in value or any(e.member in value for e in layout.children):
                    name = next((t for k in layout.keys if (t := _text(_at(value, k))) is not None), None)
                    yield layout, name, value
                    break
            else:
                todo.extend(v for v in value.values() if isinstance(_decoded(v), dict | list))


def label_payload(payload: str, layouts: tuple[Layout, ...]) -> list[tuple] | None:
    """(entity, pre, post, depth, key, attributes) of every node; None if the payload cannot be read."""
    try:
        value = json.loads(payload.lstrip("\ufeff"))
    except (ValueError, RecursionError):
        return None
    nodes: list[list] = []
    pre = post = 0
    for layout, name, root in _roots(value, layouts):
        # an explicit stack; a node is closed once its children are exhausted
        stack: list[tuple[list, Iterator]] = []

        def opened(entity: str, key: str | None, obj: object, children: tuple[Entity, ...], depth: int) -> tuple[list, Iterator]:
            nonlocal pre
            used = {c.member for c in children}
            scalars = {k: v for k, v in obj.items() if k not in used} if isinstance(obj, dict) else obj
            node = [entity, pre, 0, depth, key, json.dumps(scalars, ensure_ascii=False)]
            pre += 1
            nodes.append(node)
            return node, ((c, k, x) for c in children for k, x in _members(c, obj))

        stack.append(opened(layout.name, name, root, layout.children, 0))
        while stack:
            node, children = stack[-1]
            step = next(children, None)
            if step is None:
                node[2] = post
                post += 1
                stack.pop()
            else:
                entity, key, obj = step
                stack.append(opened(entity.name, key, obj, entity.children, len(stack)))
    return [tuple(n) for n in nodes]


def label_nodes(
    df: DataFrame, record_id: str = "record_id", payload: str = "payload", layouts: tuple[Layout, ...] = (DOCUMENT, RELATIONSHIP)
) -> DataFrame:
    """Node rows of every readable payload (``NODE_SCHEMA``)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rid, delivery, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out += [(rid, delivery, *node) for node in label_payload(text, layouts) or ()]
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return (
        df.select(
            F.col(record_id).cast("long").alias("record_id"), F.xxhash64(payload).alias("delivery"), F.col(payload).alias("payload")
        )
        .where(F.col("payload").isNotNull())
        .mapInArrow(walk, NODE_SCHEMA)
    )


def unreadable_records(df: DataFrame, record_id: str = "record_id", payload: str = "payload") -> DataFrame:
    """Ids of records whose payload is null or no JSON, judged by the JVM's reader."""
    bad = F.col(payload).isNull() | F.try_parse_json(payload).isNull()
    return df.where(bad).select(F.col(record_id).alias("record_id")).distinct()


def link_children(nodes: DataFrame, parent_of: dict[str, str]) -> DataFrame:
    """Every node with the key and number of the parent whose interval contains it.

    parent_of: the parent entity of each child entity.  One pass for all pairs.
    """
    w = Window.partitionBy("record_id", "delivery").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    out = nodes
    for parent in sorted(set(parent_of.values())):
        opened = F.when(F.col("entity") == parent, F.struct("pre", "post", "node_key"))
        out = out.withColumn(f"_{parent}", F.last(opened, ignorenulls=True).over(w))
    found = F.lit(None).cast("struct<pre:int,post:int,node_key:string>")
    for child, parent in parent_of.items():
        holds = (F.col("entity") == child) & (F.col(f"_{parent}.post") > F.col("post"))
        found = F.when(holds, F.col(f"_{parent}")).otherwise(found)
    return (
        out.withColumn("_found", found)
        .where(F.col("_found").isNotNull())
        .select("record_id", "entity", "pre", "post", "depth", "node_key", "attributes", F.col("_found.pre").alias("parent_pre"), F.col("_found.node_key").alias("parent_key"))
    )


PARENTS = {"page": "document", "element": "page", "table_row": "element", "signal": "relationship"}


def flat_links(records: DataFrame) -> DataFrame:
    """(record_id, child_kind, parent_key, child_key) of every node below a root."""
    nodes = label_nodes(records)
    return (
        link_children(nodes, PARENTS)
        .select("record_id", F.col("entity").alias("child_kind"), "parent_key", F.col("node_key").alias("child_key"))
        .distinct()
    )


def entity_table(nodes: DataFrame, entity: str, parent: str, schema: str) -> DataFrame:
    """The flat table of one entity: keys, interval and the attributes named in a DDL schema."""
    linked = link_children(nodes, {entity: parent})
    return linked.select(
        "record_id", "pre", "post", "parent_key", F.col("node_key").alias("own_key"), F.from_json("attributes", schema).alias("a")
    ).select("record_id", "pre", "post", "parent_key", "own_key", "a.*")
