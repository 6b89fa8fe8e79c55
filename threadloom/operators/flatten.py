"""Deeply nested records to flat, linked rows, by vectorised structural indexing.

The JSON texts of a batch are indexed together by :mod:`threadloom.operators.structure`: bitmaps of quotes, brackets and delimiters, depth by
prefix sums, spans and containers by one sort; the same index tells whether a text is one complete JSON value, so nothing is decoded.
Python touches only the objects that are listed, and builds their paths from their containers.

Defined results: every object that is an element of an array is a node; null elements count as places but are no nodes; a text that
is not one complete JSON value (cut off, empty, NaN) gives no nodes of its own; texts may be nested to any depth and hold numbers of any
length; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import structure

_NODES = "row_id bigint, node_path string, parent_path string, body string"
_SCHEMA = pa.schema([("row_id", pa.int64()), ("node_path", pa.string()), ("parent_path", pa.string()), ("body", pa.string())])
#: Characters of an output batch: paths are as long as texts are deep, so rows are no measure of a batch.
_BATCH_CHARS = 16 << 20


def _listed(index: structure.Index, body: bool) -> Iterator[tuple[int, str, str, str | None]]:
    """(text, path, path of the nearest node around it or '', the object's text) of the objects that are elements of an array."""
    kind, holder, place, at, end = index.kind, index.holder, index.place, index.at, index.end
    nodes = np.flatnonzero((kind == structure.OPEN_OBJECT) & (holder >= 0) & (kind[np.maximum(holder, 0)] == structure.OPEN_ARRAY))
    known: dict[int, tuple[str, str]] = {}  # container -> (path, path of the nearest node at or around it), of one text
    text = -1
    for i in nodes.tolist():
        if index.doc[i] != text:
            text = int(index.doc[i])
            known.clear()
        array = int(holder[i])
        if array not in known:
            steps, c = [], array
            while c >= 0 and c not in known:
                up = int(holder[c])
                if up >= 0:
                    steps.append(f"[{place[c]}]" if kind[up] == structure.OPEN_ARRAY else "." + structure.unescaped(index.data[at[c - 2] + 1 : end[c - 2] - 1]))
                c = up
            path, near = known[c] if c >= 0 else ("", "")
            known[array] = path + "".join(reversed(steps)), near
        path, near = known[array]
        path = f"{path}[{place[i]}]"
        known[i] = path, path
        yield text, path, near, index.raw(i).decode("utf-8", "replace") if body else None


def index(texts: list[str | None]) -> list[list[tuple[str, str, str]]]:
    """For each text its nodes: (path, path of the nearest node around it or '', the object's text)."""
    out: list[list[tuple[str, str, str]]] = [[] for _ in texts]
    for first, part in structure.parts(pa.array(texts, pa.string())):
        for text, path, up, body in _listed(structure.Index(part), True):
            out[first + text].append((path, up, body))
    return out


def _emit(batches: Iterator[pa.RecordBatch], body: bool) -> Iterator[pa.RecordBatch]:
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

    for batch in batches:
        rows: list[tuple] = []
        ids, places, nested, bodies = (batch[k].to_pylist() for k in ("row_id", "place", "nested", "body"))
        for row, i, inner, own_body in zip(ids, places, nested, bodies):
            own = f"content[{i}]"
            rows.append((row, own, "", own_body))
            if inner:
                rows += [(row, f"{own}.content[{j}]", own, text) for j, text in enumerate(inner) if text is not None]
        chars = 0
        for first, part in structure.parts(batch["input"]):
            for text, path, up, object_ in _listed(structure.Index(part), body):
                row, own = ids[first + text], f"content[{places[first + text]}]"
                rows.append((row, f"{own}.input{path}", f"{own}.input{up}" if up else own, object_))
                chars += len(path) + len(up) + (len(object_) if object_ else 0)
                if chars > _BATCH_CHARS:
                    yield packed(rows)
                    rows, chars = [], 0
        yield packed(rows)


def nodes(rows: DataFrame, body: bool = True) -> DataFrame:
    """(row_id, node_path, parent_path, body) of every object that is an element of an array in message.content, ``input`` included.

    ``body=False`` leaves the objects' own JSON text out (null) and spares its encoding.
    """
    blocks = rows.select("row_id", F.posexplode("message.content").alias("place", "block")).where("block IS NOT NULL")
    inner = F.transform("block.content", lambda x: F.when(x.isNotNull(), F.to_json(x) if body else F.lit("")))
    text = F.to_json(F.struct("block.type", "block.text", "block.thinking", "block.name", "block.id", "block.tool_use_id", "block.is_error")) if body else F.lit(None).cast("string")
    out = blocks.select("row_id", "place", F.col("block.input").alias("input"), inner.alias("nested"), text.alias("body")).mapInArrow(lambda b: _emit(b, body), _NODES)
    return out


def messages(rows: DataFrame) -> DataFrame:
    """The message table: one row for each input row, its scalars and the number of its blocks."""
    return rows.select("row_id", "sessionId", "uuid", "parentUuid", "type", "timestamp", F.col("message.role").alias("role"), F.col("message.model").alias("model"), F.col("message.id").alias("message_id"), F.coalesce(F.size("message.content"), F.lit(0)).alias("n_blocks"))


def blocks(rows: DataFrame) -> DataFrame:
    """The block table: one row for each block, linked to its message by row_id and to its tool call by tool_use_id."""
    exploded = rows.select("row_id", F.posexplode("message.content").alias("place", "block")).where("block IS NOT NULL")
    return exploded.select("row_id", F.concat(F.lit("content["), F.col("place").cast("string"), F.lit("]")).alias("node_path"), "place", *[F.col(f"block.{c}").alias(c) for c in ("type", "text", "thinking", "name", "id", "tool_use_id", "is_error", "input")])
