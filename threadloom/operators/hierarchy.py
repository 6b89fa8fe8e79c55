"""Parent-child rows to full hierarchies, by Euler tours and list ranking.

Every node has two tour elements, its entry (2v) and its exit (2v+1).  The entry of a node is followed by the entry of its first
child or by its own exit, an exit by the entry of the next sibling or by the parent's exit.  The sum of +1 for each entry and
-1 for each exit from an element to the end of its tour gives the depth, the number of elements gives the place; a node's
descendants are the nodes whose intervals lie in its own, its ancestors those whose intervals hold it.

The ranking has three steps, so that trees of any depth take few rounds over little data:

1. Nodes are numbered in delivery order and cut into blocks of at most ``block`` nodes.  A block ranks, in numpy, the stretches of
   the tour that lie inside it.  It first peels leaves, then the leaves that come up, and so on: what is left are the loops inside the block.
   Their tour elements become dead ends, so that what hangs below them ends there and has no root.
2. Only the stretches (one for each place where a tour enters a block) are ranked across blocks, by pointer doubling with joins and
   checkpoints: rounds grow with the logarithm of the stretches in the longest tour.  A round in which no stretch
   reaches its end proves that the rest run in loops.
3. Blocks add the ranks of their stretches to the ranks inside.

Peeling across blocks would take a round of joins for each level of the deepest chain (297 levels in 28,000 nodes of the test data), so loops
that run through several blocks are exposed by step 2 instead.

Defined results: ids compare without letter case and come out in lower case; rows with a null id are no nodes; the first row
in ``order`` (then the smallest parent) gives a repeated id's parent; a node whose parent is null or missing is a root of
depth 0; on or below a loop the root is '' and the depth -1; an id that is its own parent is a loop.  An empty table gives
an empty result.  Other columns are ignored, whatever their names.

Paths and descendants of all nodes are read from the tour itself: with the nodes in the order of their entries, a node of depth d
has the last node of each depth below d before it as its ancestors.  Chunks of the tour begin with the ancestors of their first node,
so that one pass over the chunks gives every path, and no (node, ancestor) pair is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.util import checkpoint, numbered, shuffle_partitions

BLOCK = 50_000
CHUNK = 5_000
#: Ids in an output batch: paths are as long as the trees are deep, so rows are no measure of a batch.
_BATCH_IDS = 200_000
#: In place of the element that follows: the tour ends in a loop.
DEAD = -2
_HEADS = "head bigint, next bigint, steps bigint, weight bigint, root bigint"
_NODES = "uuid string, root_uuid string, depth int, entry bigint, exit bigint, root_is_dangling boolean"


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


class _Block:
    """The stretches of the tour inside one block."""

    def __init__(self, nodes: pa.Table, notes: pa.Table):
        nid, pid = _column(nodes, "nid"), _column(nodes, "pid")
        order = np.argsort(nid, kind="stable")
        self.order, self.nid, pid = order, nid[order], pid[order]
        nid = self.nid
        m = self.m = nid.size
        kind, a, b = _column(notes, "kind"), _column(notes, "a"), _column(notes, "b")
        attached = dict(zip(a[kind == 0].tolist(), b[kind == 0].tolist()))  # node here -> first foreign child
        leaves_to = dict(zip(a[kind == 1].tolist(), b[kind == 1].tolist()))  # foreign parent -> element after our last child
        at = np.searchsorted(nid, pid)
        local = (pid >= 0) & (at < m) & (nid[np.minimum(at, m - 1)] == pid)
        self.next = np.full(2 * m, -1, np.int64)  # index here, or -1: the stretch ends
        self.out = np.full(2 * m, -1, np.int64)  # element of another block that follows the end, or -1: the tour ends
        self.next[0::2] = 2 * np.arange(m) + 1
        hung = np.array([k for k in attached], np.int64)
        hung_at = np.searchsorted(nid, hung) if hung.size else hung
        has_foreign = np.zeros(m, bool)
        first_foreign = np.full(m, -1, np.int64)
        if hung.size:
            has_foreign[hung_at] = True
            first_foreign[hung_at] = [attached[int(k)] for k in hung]
        child = np.flatnonzero(pid >= 0)
        child = child[np.lexsort((nid[child], pid[child]))]
        heads = [2 * np.flatnonzero(pid < 0)]
        if child.size:
            parents = pid[child]
            starts = np.r_[True, parents[1:] != parents[:-1]]
            ends = np.r_[starts[1:], True]
            inner = np.flatnonzero(~ends)
            self.next[2 * child[inner] + 1] = 2 * child[inner + 1]
            firsts, lasts = child[starts], child[ends]
            own = local[firsts]
            self.next[2 * at[firsts[own]]] = 2 * firsts[own]
            holder = at[lasts[own]]
            tail = 2 * lasts[own] + 1
            plain = ~has_foreign[holder]
            self.next[tail[plain]] = 2 * holder[plain] + 1
            self.next[tail[~plain]] = -1
            self.out[tail[~plain]] = 2 * first_foreign[holder[~plain]]
            for last in lasts[~own]:
                self.out[2 * last + 1] = leaves_to[int(pid[last])]
            heads.append(2 * firsts[~own])
            with_own = np.zeros(m, bool)
            with_own[at[firsts[own]]] = True
        else:
            with_own = np.zeros(m, bool)
        bare = np.flatnonzero(has_foreign & ~with_own)
        self.next[2 * bare] = -1
        self.out[2 * bare] = 2 * first_foreign[bare]
        heads.append(2 * np.flatnonzero(has_foreign) + 1)
        self.heads = np.concatenate(heads)
        loop = self._peeled(np.where(local, at, -1))
        for element in (2 * loop, 2 * loop + 1):
            self.next[element], self.out[element] = -1, DEAD
        self._rank()

    def _peeled(self, parent: np.ndarray) -> np.ndarray:
        """Nodes that are left when leaves are peeled as long as there are any: those of the loops inside the block."""
        children = np.bincount(parent[parent >= 0], minlength=self.m)
        left = np.ones(self.m, bool)
        leaves = np.flatnonzero(children == 0)
        while leaves.size > 64:
            left[leaves] = False
            up = parent[leaves]
            up, less = np.unique(up[up >= 0], return_counts=True)
            children[up] -= less
            leaves = up[children[up] == 0]
        # Few leaves a round: the rest goes node by node.
        stack, count, above = leaves.tolist(), children.tolist(), parent.tolist()
        while stack:
            v = stack.pop()
            left[v] = False
            p = above[v]
            if p >= 0:
                count[p] -= 1
                if count[p] == 0:
                    stack.append(p)
        return np.flatnonzero(left)

    def _rank(self) -> None:
        n = 2 * self.m
        weight = np.tile(np.array([1, -1], np.int64), self.m)
        jump = np.where(self.next < 0, np.arange(n), self.next)
        ended = self.next < 0
        steps = np.where(ended, 0, 1).astype(np.int64)
        total = np.where(ended, 0, weight)
        for _ in range(max(1, int(n).bit_length()) + 1):
            steps, total, jump = steps + steps[jump], total + total[jump], jump[jump]
        self.reaches = ended[jump] & (self.out[jump] != DEAD)  # False: the element lies on or below a loop inside the block
        self.tail, self.steps, self.total = jump, steps + 1, total + weight[jump]

    def stretches(self) -> pa.Table:
        h = self.heads
        tail = self.tail[h]
        out = np.where(self.reaches[h], self.out[tail], DEAD)
        element = lambda i: 2 * self.nid[i // 2] + i % 2
        root = np.where(out == -1, self.nid[tail // 2], -1)  # none where the tour ends in a loop
        return pa.table({"head": element(h), "next": pa.array(out, mask=out < 0), "steps": self.steps[h], "weight": self.total[h], "root": pa.array(root, mask=root < 0)})


def _stretches(nodes: pa.Table, notes: pa.Table) -> pa.Table:
    empty = pa.schema([("head", pa.int64()), ("next", pa.int64()), ("steps", pa.int64()), ("weight", pa.int64()), ("root", pa.int64())])
    return _Block(nodes, notes).stretches().cast(empty) if nodes.num_rows else empty.empty_table()


def _finish(nodes: pa.Table, notes: pa.Table) -> pa.Table:
    schema = pa.schema([("uuid", pa.string()), ("root_uuid", pa.string()), ("depth", pa.int32()), ("entry", pa.int64()), ("exit", pa.int64()), ("root_is_dangling", pa.bool_())])
    if not nodes.num_rows:
        return schema.empty_table()
    block = _Block(nodes, notes)
    kind = _column(notes, "kind")
    solved = notes.filter(pa.array(kind == 2))
    n = 2 * block.m
    steps, weight, name, dangling = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    names = solved["root_uuid"].to_pylist()
    where = 2 * np.searchsorted(block.nid, _column(solved, "a") // 2) + _column(solved, "a") % 2
    tails = block.tail[where]  # a stretch has one head and one tail, so its head's rank is kept at its tail
    steps[tails] = _column(solved, "b") - block.steps[where]
    weight[tails] = _column(solved, "weight") - block.total[where]
    name[tails] = np.arange(len(names))
    dangling[tails] = _column(solved, "dangling") > 0
    at = 2 * np.arange(block.m)
    tail = block.tail[at]
    good = block.reaches[at] & (name[tail] >= 0)
    depth = np.where(good, -(block.total[at] + weight[tail]), -1)
    entry = np.where(good, -(block.steps[at] + steps[tail]), 0)
    out = at + 1
    exit_ = np.where(good, -(block.steps[out] + steps[block.tail[out]]), 0)
    names.append("")
    root = pa.array(names, pa.string()).take(pa.array(np.where(good, name[tail], len(names) - 1)))
    uuids = nodes["uuid"].combine_chunks().take(pa.array(block.order))
    return pa.table([uuids, root, pa.array(depth.astype(np.int32)), pa.array(entry), pa.array(exit_), pa.array(good & dangling[tail])], schema=schema)


def _ranked(stretches: DataFrame) -> DataFrame:
    """Steps, weights and roots to the end of the tour for each stretch that has one."""
    known = checkpoint(stretches)
    while True:
        left = known.where("next IS NOT NULL")
        follow = known.select(F.col("head").alias("next"), F.col("next").alias("next2"), F.col("steps").alias("steps2"), F.col("weight").alias("weight2"), F.col("root").alias("root2"))
        moved = left.join(follow, "next").select("head", F.col("next2").alias("next"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("weight") + F.col("weight2")).alias("weight"), F.col("root2").alias("root"))
        new = checkpoint(moved)
        done = known.where("next IS NULL")
        if new.where("next IS NULL").isEmpty():  # every stretch left runs in a loop (or none is left)
            return done
        known = done.unionByName(new)


def hierarchy(rows: DataFrame, node: str = "uuid", parent: str = "parentUuid", order: str = "row_id", block: int = BLOCK) -> DataFrame:
    """(uuid, root_uuid, depth, entry, exit, root_is_dangling) of every distinct id; see the module's docstring.

    ``entry`` and ``exit`` count from the end of the root's tour (…, -2, -1); ``(exit - entry - 1) / 2`` is the number of descendants.
    ``root_is_dangling``: the root names a parent that is no id of the table.
    """
    nodes = (
        rows.select(F.lower(F.col(node)).alias("uuid"), F.lower(F.col(parent)).alias("p"), F.col(order).alias("o"))
        .where("uuid IS NOT NULL")
        .groupBy("uuid")
        .agg(F.min(F.struct("o", "p")).alias("first"))
        .select("uuid", F.col("first.p").alias("p"), F.col("first.o").alias("o"))
    )
    nodes = numbered(nodes, ["o", "uuid"], "nid").select("nid", "uuid", "p")
    ids = nodes.select(F.col("uuid").alias("p"), F.col("nid").alias("pid"))
    # Rows with a null parent stay out of the join, where they would all meet in one partition.
    linked = (
        nodes.where("p IS NOT NULL").join(ids, "p", "left").select("nid", "uuid", "pid", F.col("pid").isNull().alias("dangling"))
        .unionByName(nodes.where("p IS NULL").select("nid", "uuid", F.lit(None).cast("bigint").alias("pid"), F.lit(False).alias("dangling")))
        .withColumn("block", F.floor(F.col("nid") / block).cast("bigint"))
    )
    linked = checkpoint(linked)
    groups = (
        linked.where((F.col("pid").isNotNull()) & (F.floor(F.col("pid") / block) != F.col("block")))
        .groupBy("pid", "block").agg(F.min("nid").alias("first"))
        .withColumn("then", F.lead("first").over(Window.partitionBy("pid").orderBy("block")))
        .withColumn("place", F.row_number().over(Window.partitionBy("pid").orderBy("block")))
    )
    groups = checkpoint(groups)
    empty = [F.lit(None).cast("string").alias("root_uuid"), F.lit(None).cast("bigint").alias("weight"), F.lit(0).cast("bigint").alias("dangling")]
    lone = groups.where("place = 1").select(F.floor(F.col("pid") / block).cast("bigint").alias("block"), F.lit(0).alias("kind"), F.col("pid").alias("a"), F.col("first").alias("b"), *empty)
    tails = groups.select("block", F.lit(1).alias("kind"), F.col("pid").alias("a"), F.coalesce(2 * F.col("then"), 2 * F.col("pid") + 1).alias("b"), *empty)
    notes = lone.unionByName(tails)
    inside = linked.select("block", "nid", "pid", "uuid")
    stretches = inside.drop("uuid").groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(_stretches, _HEADS)
    ranked = _ranked(stretches)
    roots = linked.where("pid IS NULL").select(F.col("nid").alias("root"), F.col("uuid").alias("root_uuid"), F.col("dangling").cast("bigint").alias("dangling"))
    solved = ranked.join(roots, "root").select(F.floor(F.col("head") / (2 * block)).cast("bigint").alias("block"), F.lit(2).alias("kind"), F.col("head").alias("a"), F.col("steps").alias("b"), "root_uuid", "weight", "dangling")
    return inside.groupBy("block").cogroup(notes.unionByName(solved).groupBy("block")).applyInArrow(_finish, _NODES)


def _climbed(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """(uuid, sound, via): where each node leads to inside its block.  sound: to a row without a parent (true) or into a loop (false);
    null: to a parent that is not in the block, whose id is via."""

    def climb(uuids: list[str], parents: list[str | None]) -> pa.RecordBatch:
        place = {u: k for k, u in enumerate(uuids)}
        m = len(uuids)
        up = np.fromiter((-1 if p is None else place.get(p, -1) for p in parents), np.int64, m)
        top = np.where(up < 0, np.arange(m), up)
        for _ in range(m.bit_length() + 1):
            top = top[top]
        loops = up[top] >= 0
        via = pa.array(parents, pa.string()).take(pa.array(top, mask=loops))
        sound = pa.array(~loops, mask=~loops & via.is_valid().to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([pa.array(uuids, pa.string()), sound, via], names=["uuid", "sound", "via"])

    uuids: list[str] = []
    parents: list[str | None] = []
    for batch in batches:
        uuids += batch["uuid"].to_pylist()
        parents += batch["p"].to_pylist()
        while len(uuids) >= block:
            yield climb(uuids[:block], parents[:block])
            uuids, parents = uuids[block:], parents[block:]
    if uuids:
        yield climb(uuids, parents)


def rooted(rows: DataFrame, node: str = "uuid", parent: str = "parentUuid", order: str = "row_id", block: int = BLOCK) -> DataFrame:
    """(uuid, sound): whether each distinct id leads up to a row whose parent is null, by the rules of ``hierarchy`` for ids and repeats.

    Links inside a block of delivery order are followed in numpy; only the ids by which blocks refer to each other are joined and followed
    across blocks by pointer doubling.
    """
    nodes = (
        rows.select(F.lower(F.col(node)).alias("uuid"), F.lower(F.col(parent)).alias("p"), F.col(order).alias("o"))
        .where("uuid IS NOT NULL").groupBy("uuid").agg(F.min(F.struct("o", "p")).alias("first")).select("uuid", F.col("first.p").alias("p"), F.col("first.o").alias("o"))
    )
    laid = nodes.repartitionByRange(shuffle_partitions(rows.sparkSession), "o", "uuid").sortWithinPartitions("o", "uuid").select("uuid", "p")
    ends = checkpoint(laid.mapInArrow(lambda b: _climbed(b, block), "uuid string, sound boolean, via string"))
    asked = ends.where("via IS NOT NULL").select(F.col("via").alias("uuid")).distinct()
    hops = checkpoint(asked.join(ends, "uuid", "left").select("uuid", F.when(F.col("via").isNull(), F.coalesce("sound", F.lit(False))).alias("sound"), "via"))
    # An id that blocks ask for either ends inside its own block, or asks on.
    last = followed(hops.where("via IS NOT NULL").select(F.col("uuid").alias("v"), F.col("via").alias("to")))
    done = hops.where("via IS NULL").select("uuid", "sound")
    far = last.join(done.select(F.col("uuid").alias("last"), "sound"), "last", "left").select(F.col("v").alias("uuid"), F.coalesce("sound", F.lit(False)).alias("sound"))
    solved = done.unionByName(far).select(F.col("uuid").alias("via"), F.col("sound").alias("far"))
    return ends.where("via IS NULL").select("uuid", "sound").unionByName(ends.where("via IS NOT NULL").join(solved, "via").select("uuid", F.col("far").alias("sound")))


def followed(pointers: DataFrame) -> DataFrame:
    """(v, last): the end of each pointer chain (v -> to); null for chains that end in a loop.  Pointer doubling."""
    known = checkpoint(pointers.select("v", "to", F.lit(False).alias("done")))
    while True:
        ahead = known.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("done").alias("done2"))
        moved = known.where("NOT done").join(ahead, "to", "left")
        moved = checkpoint(moved.select("v", F.coalesce("to2", "to").alias("to"), (F.col("to2").isNull() | F.col("done2")).alias("done")))
        before = known.where("done")
        if moved.where("done").isEmpty():  # those left run in loops (or none is left)
            return before.select("v", F.col("to").alias("last")).unionByName(moved.select("v", F.lit(None).cast(pointers.schema["to"].dataType).alias("last")))
        known = before.unionByName(moved)


def _stabbed(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (inner, outer) of one root where outer's interval holds inner's, as an equi-join on aligned buckets.

    An interval lies in at most two buckets of the power of two next above its length, so outer gives two rows at most and inner one for each
    power that outer has; pairs are made only where the sizes fit, never over all nodes of a root.
    """
    power = F.ceil(F.log2(F.greatest(F.col("exit") - F.col("entry"), F.lit(1)).cast("double"))).cast("int")
    bucket = lambda at, k: F.floor(at / F.pow(F.lit(2.0), k)).cast("bigint")
    held = outer.withColumn("__k", power).withColumn("__b", F.explode(F.array_distinct(F.array(bucket(F.col("entry"), F.col("__k")), bucket(F.col("exit"), F.col("__k"))))))
    powers = sorted(r["__k"] for r in outer.select(power.alias("__k")).distinct().collect())  # at most 63 numbers
    asked = inner.withColumn("__k", F.explode(F.array(*[F.lit(k) for k in powers]).cast("array<int>"))).withColumn("__b", bucket(F.col("entry"), F.col("__k")))
    a, b = asked.alias("a"), held.alias("b")
    on = (F.col("a.root_uuid") == F.col("b.root_uuid")) & (F.col("a.__k") == F.col("b.__k")) & (F.col("a.__b") == F.col("b.__b"))
    return a.join(b, on & (F.col("b.entry") <= F.col("a.entry")) & (F.col("b.exit") >= F.col("a.exit")))


def _asked(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    return tree.join(wanted.select(F.lower("uuid").alias("uuid")).distinct(), "uuid", "left_semi").where("depth >= 0")


def ancestors(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uuid, ancestor, ancestor_depth) for the ids in ``wanted.uuid``, the node itself included: nodes whose interval holds the
    wanted one.  Nodes on or below loops have no ancestors."""
    pairs = _stabbed(_asked(tree, wanted), tree.where("depth >= 0"))
    return pairs.select(F.col("a.uuid"), F.col("b.uuid").alias("ancestor"), F.col("b.depth").alias("ancestor_depth"))


def paths(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uuid, path): the ids from the root down to each wanted node."""
    steps = ancestors(tree, wanted).groupBy("uuid").agg(F.sort_array(F.collect_list(F.struct("ancestor_depth", "ancestor"))).alias("steps"))
    return steps.select("uuid", F.transform("steps", lambda s: s["ancestor"]).alias("path"))


def descendants(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uuid, descendant, distance) of the wanted nodes, without the nodes themselves."""
    pairs = _stabbed(tree.where("depth > 0"), _asked(tree, wanted)).where(F.col("a.uuid") != F.col("b.uuid"))
    return pairs.select(F.col("b.uuid").alias("uuid"), F.col("a.uuid").alias("descendant"), (F.col("a.depth") - F.col("b.depth")).alias("distance"))


def _toured(tree: DataFrame, chunk: int) -> DataFrame:
    """(depth, uuid, own): the nodes of trees in the order of the tour, chunk by chunk; rows that are not the chunk's own are the
    ancestors of its first node and come before it."""
    laid = numbered(tree.where("depth >= 0").select("root_uuid", "entry", "exit", "depth", "uuid"), ["root_uuid", "entry"], "nth")
    laid = checkpoint(laid.withColumn("chunk", F.floor(F.col("nth") / chunk).cast("bigint")))
    heads = laid.where(F.col("nth") % chunk == 0)
    above = _stabbed(heads, laid).where(F.col("a.uuid") != F.col("b.uuid")).select("a.chunk", "b.nth", "b.depth", "b.uuid", F.lit(False).alias("own"))
    every = laid.select("chunk", "nth", "depth", "uuid", F.lit(True).alias("own")).unionByName(above)
    return every.repartition("chunk").sortWithinPartitions("chunk", "nth").select("depth", "uuid", "own")


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, indices, lengths): the paths of the rows of its own, one after the other, as places in ids."""
    stack: list[str] = []
    for batch in batches:
        uuids = batch["uuid"].to_pylist()
        ids = stack + uuids
        at = list(range(len(stack)))
        indices: list[int] = []
        lengths: list[int] = []
        for k, (depth, own) in enumerate(zip(batch["depth"].to_pylist(), batch["own"].to_pylist()), len(stack)):
            del at[depth:]
            at.append(k)
            if own:
                indices += at
                lengths.append(depth + 1)
                if len(indices) > _BATCH_IDS:
                    yield pa.array(ids, pa.string()), np.array(indices, np.int64), np.array(lengths, np.int64)
                    indices, lengths = [], []
        if lengths:
            yield pa.array(ids, pa.string()), np.array(indices, np.int64), np.array(lengths, np.int64)
        stack = [ids[k] for k in at]


def _path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, indices, lengths in _stacked(batches):
        ends = np.cumsum(lengths)
        path = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), ids.take(pa.array(indices)))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(indices[ends - 1])), path], names=["uuid", "path"])


def _descendant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, indices, lengths in _stacked(batches):
        ends = np.cumsum(lengths)
        own = np.repeat(ends - 1, lengths)  # the place of the path's node
        distance = own - np.arange(indices.size)
        kept = distance > 0
        columns = [ids.take(pa.array(indices[kept])), ids.take(pa.array(indices[own[kept]])), pa.array(distance[kept].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["uuid", "descendant", "distance"])


def all_paths(tree: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(uuid, path) of every node: the ids from the root down to it.  Nodes on or below loops have an empty path."""
    lost = tree.where("depth < 0").select("uuid", F.array().cast("array<string>").alias("path"))
    return _toured(tree, chunk).mapInArrow(_path_rows, "uuid string, path array<string>").unionByName(lost)


def all_descendants(tree: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(uuid, descendant, distance) of every node, without the nodes themselves; none on or below loops."""
    return _toured(tree, chunk).mapInArrow(_descendant_rows, "uuid string, descendant string, distance int")
