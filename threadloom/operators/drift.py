"""Schemas that drift between files: one consistent table, and a list of every change.

Each complete JSON record is reduced in parallel to tagged paths (object, field, set of JSON types), read from the structural index of a batch;
fusing the schemas of all records is then a union of type sets, which retains every alternative type of a path.  ``changes`` compares the
fused schema of a record kind in a file with the latest earlier file of the same producer that has the kind.  It works in two passes: the
first fuses shapes and no values, the second reads the values of the fields that came or went, to tell which were renamed.  ``unified`` splits
paths with several types into one typed branch each, beside a canonical text column.

Defined results: incomplete lines and lines that are no objects are no records (nesting and numbers may be of any size); a null field is
absent; of a key that an object holds twice the last counts; repeated lines count once; files of one producer with equal ``file_seq`` are
compared with the greatest smaller one and not with each other (the greatest file_id stands for the earlier number); files
without file_id or file_seq are not compared; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators import scans, structure
from threadloom.util import checkpoint

#: JSON types by name; a set of types is a number with the bits of its members.
TYPES = ("array", "boolean", "number", "object", "string")
_ARRAY, _BOOLEAN, _NUMBER, _OBJECT, _STRING = (1 << k for k in range(5))
_GROUP = [("file_id", pa.int64()), ("producer", pa.string()), ("file_seq", pa.int32()), ("record_kind", pa.string())]
_TAGS = "file_id bigint, producer string, file_seq int, record_kind string, parent string, field string, types int"
_TAG_SCHEMA = pa.schema([*_GROUP, ("parent", pa.string()), ("field", pa.string()), ("types", pa.int32())])
_VALUES = "file_id bigint, record_kind string, parent string, field string, types int, value bigint"
_VALUE_SCHEMA = pa.schema([_GROUP[0], _GROUP[3], ("parent", pa.string()), ("field", pa.string()), ("types", pa.int32()), ("value", pa.int64())])
#: Names of changed fields sent to the tasks of the second pass; beyond, the pass reads the values of all fields.
NAMES = 50_000


class _Records:
    """Kinds and fields of the complete records of a batch of lines."""

    def __init__(self, lines: pa.Array):
        index = self.index = structure.Index(lines)
        n, kind = len(lines), index.kind
        self.record = np.zeros(n, bool)
        self.kinds = np.zeros(n, np.int64)  # places in ``kind_names``
        self.kind_names = ["session_meta"]
        keys, name, self.names = index.names()
        number = {x: k for k, x in enumerate(self.names)}
        roots = np.flatnonzero(index.holder < 0)
        roots = roots[np.r_[True, index.doc[roots][1:] != index.doc[roots][:-1]]] if roots.size else roots
        roots = roots[kind[roots] == structure.OPEN_OBJECT]
        self.record[index.doc[roots]] = True
        holder, doc = index.holder[keys], index.doc[keys]
        root_of = np.full(n, -1)
        root_of[index.doc[roots]] = roots
        self.values = keys + 2

        def last(of: np.ndarray, wanted: str) -> np.ndarray:
            """For each line the value of its object's field, or -1."""
            out = np.full(n, -1)
            if wanted in number:
                hit = (name == number[wanted]) & (of[doc] == holder)
                np.maximum.at(out, doc[hit], self.values[hit])
            return out

        payload = last(root_of, "payload")
        is_object = (payload >= 0) & (kind[np.maximum(payload, 0)] == structure.OPEN_OBJECT) if kind.size else np.zeros(n, bool)
        inner = np.where(is_object, payload, -1)
        self._name_kinds(last(np.where(inner < 0, -2, inner), "type"), last(root_of, "type"), last(root_of, "record_type"))

        # Fields, one depth of objects after the other: each depth once, its containers by the numbers of their paths.
        of_container = np.full(kind.size, -1)
        of_container[np.where(is_object, payload, root_of)[self.record]] = 0
        self.paths = [""]
        deep = np.zeros(kind.size, np.int64)
        opening = (kind == structure.OPEN_OBJECT) | (kind == structure.OPEN_ARRAY)
        deep = np.cumsum(opening.astype(np.int64) - ((kind == structure.CLOSE_OBJECT) | (kind == structure.CLOSE_ARRAY)))[keys] if keys.size else keys
        order = np.argsort(deep, kind="stable")
        edges = np.r_[np.flatnonzero(np.r_[True, np.diff(deep[order]) > 0]), order.size] if order.size else np.zeros(1, np.int64)
        skip = [number[x] for x in ("type", "record_type") if x in number]
        path, chosen, known = [], [], {}
        for a, b in zip(edges[:-1], edges[1:]):
            at = order[a:b]
            at = at[of_container[holder[at]] >= 0]
            if not at.size:
                if deep[order[a]] > 1:  # no object goes on to this depth
                    break
                continue
            _, lasts = np.unique((holder[at] * (len(self.names) + 1) + name[at])[::-1], return_index=True)
            at = np.sort(at[at.size - 1 - lasts])
            p = of_container[holder[at]]
            body = (p == 0) & np.isin(name[at], skip)
            at, p = at[~body], p[~body]
            chosen.append(at)
            path.append(p)
            held = kind[self.values[at]] == structure.OPEN_OBJECT
            joint, back = np.unique(p[held] * len(self.names) + name[at[held]], return_inverse=True)
            new = []
            for x in joint.tolist():
                if x not in known:
                    known[x] = len(self.paths)
                    self.paths.append(f"{self.paths[x // len(self.names)]}{self.names[x % len(self.names)]}.")
                new.append(known[x])
            of_container[self.values[at[held]]] = np.array(new, np.int64)[back]
        none = np.zeros(0, np.int64)
        chosen_ = np.concatenate(chosen) if chosen else none
        self.path, self.name = (np.concatenate(path) if path else none), (name[chosen_] if chosen_.size else none)
        self.values = self.values[chosen_] if chosen_.size else none
        self.doc = index.doc[self.values] if self.values.size else none
        first = np.frombuffer(index.data, np.uint8)[index.at[self.values]] if self.values.size else none
        by_kind = np.array([_OBJECT, 0, _ARRAY, 0, 0, 0, _STRING, _NUMBER])
        self.types = by_kind[kind[self.values]] if self.values.size else none
        self.types = np.where((self.types == _NUMBER) & ((first == 0x74) | (first == 0x66)), _BOOLEAN, np.where((self.types == _NUMBER) & (first == 0x6E), 0, self.types))
        present = self.types > 0  # null is absent
        for x in ("path", "name", "values", "doc", "types"):
            setattr(self, x, getattr(self, x)[present])

    def _name_kinds(self, *candidates: np.ndarray) -> None:
        left = self.record.copy()
        numbers = {"session_meta": 0}
        for tokens in candidates:
            has = np.flatnonzero(left & (tokens >= 0))
            has = has[self.index.kind[tokens[has]] == structure.STRING]
            has = has[self.index.end[tokens[has]] - self.index.at[tokens[has]] > 2]
            if has.size:
                coded = structure.spans(self.index.b, self.index.at[tokens[has]] + 1, self.index.end[tokens[has]] - 1).dictionary_encode()
                ids = np.array([numbers.setdefault(structure.unescaped(x), len(numbers)) for x in coded.dictionary.to_pylist()])
                self.kinds[has] = ids[coded.indices.to_numpy(zero_copy_only=False)]
                left[has] = False
        self.kind_names = list(numbers)


def _records(batch: pa.RecordBatch) -> Iterator[tuple[int, _Records]]:
    for first, part in structure.parts(batch["line"]):
        yield first, _Records(part)


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = list(zip(*(batch[k].to_pylist() for k in ("file_id", "producer", "file_seq"))))
        seen: dict[tuple, int] = {}
        for first, r in _records(batch):
            groups: dict[tuple, int] = {}
            group = np.full(len(r.record), -1)
            for k in np.flatnonzero(r.record).tolist():
                group[k] = groups.setdefault((*files[first + k], r.kind_names[r.kinds[k]]), len(groups))
            known = list(groups)
            for g in known:  # the file has the kind, even without a field
                seen.setdefault((*g, None, None), 0)
            if not r.values.size:
                continue
            joint = (group[r.doc] * len(r.paths) + r.path) * len(r.names) + r.name
            order = np.argsort(joint, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(joint[order]) > 0])
            types = np.bitwise_or.reduceat(r.types[order], starts)
            for x, t in zip(joint[order][starts].tolist(), types.tolist()):
                x, n = divmod(x, len(r.names))
                g, p = divmod(x, len(r.paths))
                tag = (*known[g], r.paths[p], r.names[n])
                seen[tag] = seen.get(tag, 0) | t
        columns = list(zip(*((*k, t) for k, t in seen.items()))) or [[]] * len(_TAG_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TAG_SCHEMA)], schema=_TAG_SCHEMA)


def tags(lines: DataFrame) -> DataFrame:
    """Distinct tags of (file_id, producer, file_seq, line) with the set of their types; a row with a null field marks that the file has the
    kind."""
    every = lines.select("file_id", "producer", F.col("file_seq").cast("int").alias("file_seq"), "line").mapInArrow(_tagged, _TAGS)
    return every.groupBy("file_id", "producer", "file_seq", "record_kind", "parent", "field").agg(F.bit_or("types").alias("types"))


def _canonical(kind: int, raw: bytes) -> bytes:
    """Equal values of one type have equal forms: strings unescaped, numbers by their value."""
    if kind == _STRING:
        return structure.unescaped(raw[1:-1]).encode()
    text = raw.decode()
    if text.lstrip("-").isdigit():
        return text.encode() if len(text) > 16 or abs(int(text)) >= 2**53 else repr(float(text)).encode()
    value = repr(float(text))
    return raw if "inf" in value else value.encode()


def values(lines: DataFrame, names: set[tuple[str, str, str]] | None) -> DataFrame:
    """(file_id, record_kind, parent, field, types, value): the distinct values, hashed, of the strings and numbers of the named
    (record_kind, parent, field); None: of all fields."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, out = batch["file_id"].to_pylist(), {}
            for first, r in _records(batch):
                plain = np.flatnonzero((r.types == _STRING) | (r.types == _NUMBER))
                joint = (r.kinds[r.doc[plain]] * len(r.paths) + r.path[plain]) * max(1, len(r.names)) + r.name[plain]
                fields, back = np.unique(joint, return_inverse=True)
                named = []
                for x in fields.tolist():
                    x, n = divmod(x, len(r.names))
                    k, p = divmod(x, len(r.paths))
                    named.append((r.kind_names[k], r.paths[p], r.names[n]))
                keep = np.array([names is None or x in names for x in named], bool)[back] if fields.size else np.zeros(0, bool)
                plain, back = plain[keep], back[keep]
                tokens = r.values[plain]
                raw = structure.spans(r.index.b, r.index.at[tokens], r.index.end[tokens]).to_pylist()
                for k, f, t, v in zip(r.doc[plain].tolist(), back.tolist(), r.types[plain].tolist(), raw):
                    out[(files[first + k], *named[f], t, v)] = None
            rows = {(*x[:5], xxhash.xxh3_64_intdigest(_canonical(x[4], x[5])) - 2**63): None for x in out}
            columns = list(zip(*rows)) or [[]] * len(_VALUE_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _VALUE_SCHEMA)], schema=_VALUE_SCHEMA)

    return lines.select("file_id", "line").mapInArrow(read, _VALUES)


def changes(lines: DataFrame) -> DataFrame:
    """(file_id, record_kind, field_path, change), one row for each change against the producer's earlier file."""
    tagged = checkpoint(tags(lines))
    # For each file of a kind the one before: the greatest file_id of the number before.
    has = tagged.where("field IS NULL AND file_seq IS NOT NULL AND file_id IS NOT NULL").select("file_id", "record_kind", "file_seq", F.to_json(F.struct("producer", "record_kind")).alias("of"))
    numbers = has.groupBy("of", "file_seq").agg(F.max("file_id").alias("latest"))
    before = scans.running_last(numbers, "of", ["file_seq"], F.col("latest"), "before", strict=True).where("before IS NOT NULL").select("of", "file_seq", "before")
    pairs = checkpoint(has.join(before, ["of", "file_seq"]).select("record_kind", "file_id", "before"))
    # Each schema counts as the new one of its own file and as the old one of the files after it.
    roles = pairs.select("record_kind", F.col("file_id").alias("of"), "file_id", "before", F.lit(False).alias("is_old")).unionByName(pairs.select("record_kind", F.col("before").alias("of"), "file_id", "before", F.lit(True).alias("is_old")))
    fields = tagged.where("field IS NOT NULL").select(F.col("file_id").alias("of"), "record_kind", "parent", "field", "types")
    key = ["record_kind", "file_id", "before", "parent"]
    both = fields.join(roles, ["of", "record_kind"]).groupBy(*key, "field").agg(
        F.coalesce(F.bit_or(F.when(~F.col("is_old"), F.col("types"))), F.lit(0)).alias("new"), F.coalesce(F.bit_or(F.when(F.col("is_old"), F.col("types"))), F.lit(0)).alias("old")
    )
    both = checkpoint(both.where(f"new <> old OR (new & old & {_OBJECT}) <> 0"))
    change = F.when(F.col("old") == 0, "added").when(F.col("new") == 0, "removed").otherwise("retyped")
    differ = both.where("new <> old").select(*key, "field", change.alias("change"))
    # Fields inside an object are compared where both files have the object.
    objects = both.where(f"(new & old & {_OBJECT}) <> 0").select("record_kind", "file_id", F.concat("parent", "field", F.lit(".")).alias("parent"))
    moved = checkpoint(differ.where("parent = ''").unionByName(differ.where("parent <> ''").join(objects, ["record_kind", "file_id", "parent"], "left_semi")))
    # A rename needs a field that came and one that went in the same object.
    came_or_went = moved.where("change <> 'retyped'").groupBy(key).agg(F.min("change").alias("a"), F.max("change").alias("b")).where("a <> b").select(key)
    asked = moved.where("change <> 'retyped'").join(came_or_went, key, "left_semi")
    asked = checkpoint(asked.select(*key, "field", "change", F.when(F.col("change") == "added", F.col("file_id")).otherwise(F.col("before")).alias("of")))
    names = asked.select("record_kind", "parent", "field").distinct().limit(NAMES + 1).collect()  # names of fields: the schema, not data
    if not names:
        return moved.select("file_id", "record_kind", F.concat("parent", "field").alias("field_path"), "change")
    held = values(lines, {tuple(x) for x in names} if len(names) <= NAMES else None).withColumnRenamed("file_id", "of")
    sharing = held.join(asked, ["of", "record_kind", "parent", "field"]).groupBy(*key, "types", "value").agg(
        F.collect_set(F.when(F.col("change") == "added", F.col("field"))).alias("new"), F.collect_set(F.when(F.col("change") == "removed", F.col("field"))).alias("old")
    )
    shared = sharing.where("size(new) > 0 AND size(old) > 0").select(*key, "old", F.explode("new").alias("new_field")).select(*key, "new_field", F.explode("old").alias("old_field"))
    shared = shared.groupBy(*key, "new_field", "old_field").agg(F.count(F.lit(1)).alias("shared"))
    # Where several names share values, the pair that each side likes best is the rename; rows here are pairs of changed fields.
    best = lambda mine, other: F.row_number().over(Window.partitionBy(*key, mine).orderBy(F.desc("shared"), other))
    renamed = checkpoint(shared.withColumn("a", best("new_field", "old_field")).withColumn("b", best("old_field", "new_field")).where("a = 1 AND b = 1").select(*key, "new_field", "old_field"))
    plain = moved.join(renamed.select(*key, F.col("new_field").alias("field")).unionByName(renamed.select(*key, F.col("old_field").alias("field"))), [*key, "field"], "left_anti")
    listed = plain.select(*key, "field", "change").unionByName(renamed.select(*key, F.col("new_field").alias("field"), F.lit("renamed").alias("change")))
    return listed.select("file_id", "record_kind", F.concat("parent", "field").alias("field_path"), "change")


def type_names(types: Column) -> Column:
    """The sorted names of a set of types."""
    return F.filter(F.array(*[F.lit(x) for x in TYPES]), lambda x, k: F.getbit(types, k) == 1)


def fused(lines: DataFrame) -> DataFrame:
    """(record_kind, field_path, types, files): the union schema of all files, every alternative type retained."""
    t = tags(lines).where("field IS NOT NULL").groupBy("record_kind", F.concat("parent", "field").alias("field_path"), "producer", "file_id").agg(F.bit_or("types").alias("types"))
    return t.groupBy("record_kind", "field_path").agg(F.bit_or("types").alias("types"), F.count(F.lit(1)).alias("files")).select("record_kind", "field_path", type_names(F.col("types")).alias("types"), "files")


def as_lines(rows: DataFrame, source: str) -> DataFrame:
    """Rows of a typed record table as lines of JSON (nulls left out), so that every format passes through one reader."""
    place = [c for c in ("row_id", "file_id", "line_no", "ingested_at") if c in rows.columns]
    body = [F.col(f"`{c}`") for c in rows.columns if c not in place]
    return rows.select(F.lit(source).alias("src_table"), F.col("file_id"), F.col("line_no"), F.to_json(F.struct(*body)).alias("line"))


def _object_paths(schema: list) -> list[tuple[tuple[str, ...], str, list[str]]]:
    """(keys, dotted path, types) of every path through objects, top-level fields first.  A dotted parent that can be read in two ways
    (a key that holds a dot) gives a path for each."""
    fields: dict[str, list] = {}
    for row in schema:
        fields.setdefault(row["parent"], []).append(row)
    out, left = [], [("", ())]
    while left:
        parent, keys = left.pop()
        for row in fields.get(parent, ()):
            path = (*keys, row["field"])
            out.append((path, parent + row["field"], row["types"]))
            if "object" in row["types"]:
                left.append((f"{parent}{row['field']}.", path))
    return sorted(out, key=lambda x: (len(x[0]) > 1, x[1], x[0]))


def _located(value: Column, keys: tuple[str, ...]) -> tuple[Column, str]:
    """(variant, path in it) of the keys.  Paths have no escapes, so a key that no quotes can hold is looked up in a map."""
    path = "$"
    for key in keys:
        if key and "'" not in key:
            path += f"['{key}']"
        elif key and '"' not in key:
            path += f'["{key}"]'
        else:
            value, path = F.try_element_at(F.try_variant_get(value, path, "map<string,variant>"), F.lit(key)), "$"
    return value, path


def unified(lines: DataFrame, split: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One consistent table of (src_table, file_id, line_no, line): record_kind and, for each field of any format, within objects at any
    depth too (``<object>.<field>``, as ``changes`` names them), the canonical text in ``<field>`` and, where formats differ in its type, a
    branch ``<field>__<type>`` for each alternative.  Arrays are not entered.  ``split``: fields with types for which there is a branch in
    any case, so that tables of different data agree.

    The column list is the fused schema (metadata: one entry for each path) and is read to plan the table.
    """
    marked = lines.select("*", F.lit(None).cast("string").alias("producer"), F.lit(0).alias("file_seq"))
    schema = tags(marked).where("field IS NOT NULL").groupBy("parent", "field").agg(F.bit_or("types").alias("types")).select("parent", "field", type_names(F.col("types")).alias("types")).collect()
    record = F.try_parse_json("line")
    kept = lines.select(*lines.columns, record.alias("__v")).where(F.schema_of_variant("__v").startswith("OBJECT"))
    payload = F.try_variant_get("__v", "$.payload", "variant")
    is_object = F.coalesce(F.schema_of_variant(payload).startswith("OBJECT"), F.lit(False))
    kept = kept.withColumn("__b", F.when(is_object, payload).otherwise(F.col("__v")))
    text = lambda v, path: F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))
    kind = F.coalesce(F.when(is_object, text(payload, "$.type")), text("__v", "$.type"), text("__v", "$.record_type"), F.lit("session_meta"))
    columns = []
    used = {"src_table", "src_file_id", "src_line_no", "record_kind"}

    def free(name: str) -> str:
        """``name``, or with a number where a column has it already (columns compare without letter case)."""
        k, new = 1, name
        while new.lower() in used:
            k, new = k + 1, f"{name}_{k + 1}"
        used.add(new.lower())
        return new

    prefix = {"string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}
    for keys, name, types in _object_paths(schema):
        holder, path = _located(F.col("__b"), keys)
        value = F.try_variant_get(holder, path, "variant")
        columns.append(F.try_variant_get(holder, path, "string").alias(free(name)))
        wanted = sorted({*(types if len(types) > 1 else ()), *(split or {}).get(name, ())})
        if wanted:
            for t in wanted:
                shape = F.schema_of_variant(value)
                is_t = shape.startswith(prefix[t]) if t in prefix else shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
                branch = F.try_variant_get(holder, path, {"number": "double", "boolean": "boolean"}.get(t, "string"))
                columns.append(F.when(is_t, branch).alias(free(f"{name}__{t}")))
    return kept.select("src_table", F.col("file_id").alias("src_file_id"), F.col("line_no").alias("src_line_no"), kind.alias("record_kind"), *columns)
