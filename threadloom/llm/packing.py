"""Filling containers of fixed capacity: shortest-pack-first over the length histogram.

Only the histogram (at most ``capacity`` numbers, whatever the size of the corpus) comes to the driver.  Lengths are placed longest first;
each goes to the packing pattern with the most room, and a pattern stands for as many containers as its count.  The patterns are
then joined back by rank: documents of a length are numbered, and slot after slot of the patterns takes the next numbers.
The slot table is broadcast if it has at most ``SLOTS`` rows, and joined by length otherwise; documents are numbered by a range-partitioned
sort, so a length that a third of the documents share is spread like any other.  The tokenizer's file is read on the driver and sent to the
tasks, up to ``TOKENIZER_BYTES``.

A document larger than a container is cut into full containers and a rest; the rest is packed like a document.

Defined results: null and empty texts have 0 tokens and no container; equal texts are packed each; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import os
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.util import checkpoint, dealt, numbered

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLOTS, TOKENIZER_BYTES = 100_000, 64 << 20

_ENCODINGS: dict[int, object] = {}
# The usual split of byte-level BPE into contractions, words, numbers, marks and white space.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(ranks_file: bytes):
    """The byte-level BPE of a ranks file, once for each Python worker."""
    key = hash(ranks_file)
    if key not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding(f"ranks-{key}", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64())])
    if os.path.getsize(tokenizer) > TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} is larger than {TOKENIZER_BYTES} bytes")
    with open(tokenizer, "rb") as file:
        ranks = documents.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks.value)
        for batch in batches:
            counts = [len(encode.encode_ordinary(t)) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64())], schema=schema)

    return dealt(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(count, "doc_id bigint, tokens bigint")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """[(lengths of the pattern with their numbers, containers of this pattern)] that hold the histogram exactly."""
    room: dict[int, list[tuple[Counter, int]]] = defaultdict(list)
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            most = max((r for r, packs in room.items() if packs and r >= length), default=None)
            if most is None:  # new containers for all that is left, as many in each as fit
                each = capacity // length
                for times, count in ((each, left // each), (left % each, 1)):
                    if times and count:
                        room[capacity - times * length].append((Counter({length: times}), count))
                break
            pattern, count = room[most].pop()
            used = min(count, left)
            if count > used:
                room[most].append((pattern, count - used))
            grown = Counter(pattern)
            grown[length] += 1
            room[most - length].append((grown, used))
            left -= used
    merged: dict[tuple, int] = defaultdict(int)
    for packs in room.values():
        for pattern, count in packs:
            merged[tuple(sorted(pattern.items(), reverse=True))] += count
    return [(Counter(dict(p)), n) for p, n in sorted(merged.items(), reverse=True)]


def pack(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, tokens, container): every piece of every document with its container."""
    spark = sized.sparkSession
    pieces = checkpoint(
        sized.where("tokens > 0").select("doc_id", "tokens", F.floor((F.col("tokens") - 1) / capacity).cast("bigint").alias("full"))
        .select("doc_id", "full", F.col("full").alias("part"), (F.col("tokens") - F.col("full") * capacity).alias("size"))
    )
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, slots, lowest, at = 0, [], {}, 0
    for size in sorted(histogram):
        lowest[size] = at
        at += histogram[size]
    taken: dict[int, int] = dict(lowest)
    for pattern, count in shortest_pack_first(histogram, capacity):
        for size, times in pattern.items():
            slots.append((size, taken[size], taken[size] + times * count, times, first))
            taken[size] += times * count
        first += count
    order = numbered(pieces, ["size", "doc_id", "part"], "rank")
    table = spark.createDataFrame(slots, "size bigint, low bigint, high bigint, times bigint, first bigint")
    placed = order.join(F.broadcast(table) if len(slots) <= SLOTS else table, (order["size"] == table["size"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.select("doc_id", "part", order["size"].alias("tokens"), (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("times"))).cast("bigint").alias("container"))
    # Full containers of cut documents: numbered from the end of the packed ones, without a shuffle of the others.
    cut = numbered(pieces.where("full > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("part")), ["doc_id", "part"], "k")
    return placed.unionByName(cut.select("doc_id", "part", F.lit(capacity).cast("bigint").alias("tokens"), (F.col("k") + first).alias("container")))
