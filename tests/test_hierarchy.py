import random

import pytest

from threadloom.operators import hierarchy as h

SCHEMA = "uuid string, parentUuid string, row_id long, entry string, nid int, block string"


def brute(rows):
    parent = {}
    for u, p, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[2]):
        parent.setdefault(u.lower(), None if p is None else p.lower())
    out = {}
    for u in parent:
        x, depth, seen = u, 0, {u}
        while (p := parent[x]) is not None and p in parent:
            if p in seen:
                x, depth = "", -1
                break
            seen.add(p)
            x, depth = p, depth + 1
        out[u] = (x, depth)
    return out, parent


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)  # clashing names of internal columns


@pytest.mark.parametrize(("n", "block", "seed"), [(60, 4, 0), (500, 16, 1), (500, 1000, 2)])
def test_random_forests_with_loops(spark, n, block, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        r = rng.random()
        p = None if r < 0.05 else f"missing{i}" if r < 0.1 else f"N{rng.randrange(max(0, i - 20), i + (4 if rng.random() < 0.05 else 1))}"
        rows.append((f"n{i}" if rng.random() < 0.5 else f"N{i}", p))
    rng.shuffle(rows)
    rows = [(*r, k) for k, r in enumerate(rows)] + [(*r, n + k) for k, r in enumerate(rows[:7])]
    rows.append((None, "n1", 9999))
    want, parent = brute(rows)
    tree = h.hierarchy(frame(spark, rows), block=block).cache()
    sound = {r.uuid: r.sound for r in h.rooted(frame(spark, rows), block=block).collect()}
    assert sound == {u: bool(root) and parent[root] is None for u, (root, _) in want.items()}
    got = {r.uuid: (r.root_uuid, r.depth) for r in tree.collect()}
    assert got == want
    children = {u: 0 for u in want}
    for u, (_, d) in want.items():
        x = u
        while d > 0:
            x, d = parent[x], d - 1
            children[x] += 1
    for r in tree.collect():
        if r.depth >= 0:
            assert (r.exit - r.entry - 1) // 2 == children[r.uuid]
            assert r.root_is_dangling == (parent[r.root_uuid] is not None)
    asked = [u for u in want if want[u][1] >= 0][:15]
    wanted = spark.createDataFrame([(u.upper(),) for u in asked], "uuid string")
    for r in h.paths(tree, wanted).collect():
        path, x = [], r.uuid
        while x is not None and x in parent:
            path.append(x)
            x = parent[x]
        assert r.path == path[::-1]
    below = {(r.uuid, r.descendant) for r in h.descendants(tree, wanted).collect()}
    assert below == {(a, u) for u in want if want[u][1] > 0 for a in asked if a != u and a in _up(u, parent)}
    tree.unpersist()


def _up(u, parent):
    out, x = set(), u
    while x is not None and x in parent and x not in out:
        out.add(x)
        x = parent[x]
    return out


def test_long_chain_across_blocks_and_wide_parent(spark):
    rows = [(f"c{i}", f"c{i - 1}" if i else None, i) for i in range(400)] + [(f"w{i}", "C0", 400 + i) for i in range(300)]
    got = {r.uuid: r.depth for r in h.hierarchy(frame(spark, rows), block=32).collect()}
    assert got["c399"] == 399 and got["w299"] == 1 and len(got) == 700


def test_defined_results(spark):
    assert h.hierarchy(frame(spark, [])).count() == 0
    assert h.hierarchy(frame(spark, [(None, None, 1), (None, "a", 2)])).count() == 0
    got = {r.uuid: (r.root_uuid, r.depth) for r in h.hierarchy(frame(spark, [("A", "a", 1), ("b", "A", 2), ("c", None, 3), ("C", "b", 4)])).collect()}
    assert got == {"a": ("", -1), "b": ("", -1), "c": ("c", 0)}


@pytest.mark.parametrize(("n", "block", "chunk"), [(300, 16, 1), (300, 1000, 7), (300, 64, 5000)])
def test_paths_and_descendants_of_all_nodes(spark, n, block, chunk):
    rng = random.Random(n + chunk)
    rows = [(f"n{i}", None if i % 100 == 0 else f"N{i + 1}" if i % 100 == 70 else f"N{rng.randrange(max(i - 3, i // 100 * 100), i)}", i) for i in range(n)]
    want, parent = brute(rows)
    assert any(d < 0 for _, d in want.values()) and max(d for _, d in want.values()) > 5
    tree = h.hierarchy(frame(spark, rows), block=block).cache()
    sound = {r.uuid: r.sound for r in h.rooted(frame(spark, rows), block=block).collect()}
    assert sound == {u: bool(root) and parent[root] is None for u, (root, _) in want.items()}
    up = {}
    for u, (_, depth) in want.items():
        up[u] = [u] if depth >= 0 else []
        for _ in range(depth):
            up[u].append(parent[up[u][-1]])
    got = h.all_paths(tree, chunk).collect()
    assert len(got) == len(want) and {r.uuid: r.path for r in got} == {u: x[::-1] for u, x in up.items()}
    pairs = [tuple(r) for r in h.all_descendants(tree, chunk).collect()]
    assert sorted(pairs) == sorted((a, u, k) for u, x in up.items() for k, a in enumerate(x) if k)
    tree.unpersist()


def test_paths_of_an_empty_table(spark):
    tree = h.hierarchy(frame(spark, []))
    assert h.all_paths(tree).count() == 0 and h.all_descendants(tree).count() == 0
