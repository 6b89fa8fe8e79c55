from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import packing


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 400), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    patterns = packing.shortest_pack_first(histogram, 60)
    held = Counter()
    for pattern, count in patterns:
        assert sum(k * n for k, n in pattern.items()) <= 60 and count > 0
        for k, n in pattern.items():
            held[k] += n * count
    assert held == Counter(histogram)
    least = -(-sum(k * n for k, n in histogram.items()) // 60)
    assert sum(c for _, c in patterns) <= 2 * least + 1


def test_pack(spark):
    sizes = [(i, 5 + i * 37 % 90) for i in range(300)] + [(1000 + i, 50) for i in range(200)] + [(2000, 250), (2001, 200), (3000, 0), (3001, None)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    rows = packing.pack(df, capacity=100).collect()
    total, containers = Counter(), Counter()
    for r in rows:
        total[r.doc_id] += r.tokens
        containers[r.container] += r.tokens
    assert total == {k: n for k, n in sizes if n} and max(containers.values()) <= 100
    parts = Counter(r.doc_id for r in rows)
    assert parts[2000] == 3 and parts[2001] == 2 and all(n == 1 for k, n in parts.items() if k < 2000)
    assert sum(containers.values()) / (100 * len(containers)) > 0.8 and set(containers) == set(range(len(containers)))
    assert packing.pack(df.limit(0), capacity=100).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "a b" * 5000, "x"), (5, "<|endoftext|>", "x")], "doc_id long, text string, tokens string")
    got = {r.doc_id: r.tokens for r in packing.sizes(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 5000 and got[5] > 1
    text = "Naïve  text,\n don't stop 123!"
    code = packing.encoding(open(packing.TOKENIZER, "rb").read())
    assert code.decode(code.encode_ordinary(text)) == text
