import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import leakage


def distance(a, b, whole=False):
    """Least edit distance of a to any stretch of b (whole: to b), by the table."""
    row = np.arange(len(b) + 1) if whole else np.zeros(len(b) + 1, int)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = np.array(new)
    return int(row[-1] if whole else row.min())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=80), st.lists(st.sampled_from("abcd"), max_size=40))
def test_myers(a, b):
    assert leakage.myers(a, b) == distance(a, b)
    assert leakage.myers(a, b, True) == distance(a, b, True)


def word(rng):
    return "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))


RNG = random.Random(1)
PASSAGE = [word(RNG) for _ in range(80)]
OTHER = [word(RNG) for _ in range(60)]
FILL = " ".join(word(RNG) for _ in range(120))


def held(*texts):
    items = leakage.Items([(1, " ".join(PASSAGE).capitalize() + "."), (2, " ".join(OTHER)), (3, None or "")])
    return [set(x) for x in leakage.scan(list(texts), items, items.automaton())]


def test_marks_do_not_matter():
    p = PASSAGE
    wrapped = "\n".join("> " + " ".join(p[i : i + 7]) for i in range(0, 80, 7))
    numbered = "\n".join(f"   {n}\t" + " ".join(p[i : i + 7]) for n, i in enumerate(range(0, 80, 7), 40))
    diff = "\n".join("+" + " ".join(p[i : i + 7]) for i in range(0, 80, 7))
    broken = " ".join(w if k % 4 else w[:2] + "-\n" + w[2:] for k, w in enumerate(p))
    hidden = " ".join(w[:3] + "​" + w[3:] for w in p)
    tags = "<p>" + " ".join(w if k % 3 else f"<b>{w}</b>" for k, w in enumerate(p)) + "</p>"
    forms = [" ".join(p), " ".join(p).upper(), wrapped, numbered, diff, broken, hidden, tags, ", ".join(p), "**" + "** **".join(p) + "**", " ".join(p), "|".join(p), "&nbsp;".join(p)]
    assert held(*[FILL + "\n\n" + f + "\n\n" + FILL for f in forms]) == [{1}] * len(forms)


def test_parts_and_exchanges():
    p = PASSAGE
    swap = lambda w, every, start=3: [x if k % every != start else "other" for k, x in enumerate(w)]
    yes = [p[10:35], p[55:80], p[:25], swap(p, 8), swap(p[20:60], 8), p[5:30] + ["x"] * 9 + OTHER[:3]]
    no = [p[10:34], p[60:80], swap(p, 5), p[:20] + FILL.split() + p[20:40], OTHER[:24], FILL.split()]
    assert held(*[FILL + " " + " ".join(x) + " " + FILL for x in yes]) == [{1}] * len(yes)
    assert held(*[FILL + " " + " ".join(x) + " " + FILL for x in no]) == [set()] * len(no)
    assert held(" ".join(p[:40] + OTHER[:40])) == [{1, 2}]


def test_tables(spark):
    docs = spark.createDataFrame([(1, " ".join(PASSAGE), "x"), (1, " ".join(PASSAGE), "x"), (2, None, "x"), (3, "", "x"), (4, FILL * 50 + " " + " ".join(OTHER), "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, " ".join(PASSAGE), "q"), (7, " ".join(PASSAGE), "q"), (8, " ".join(OTHER), "q"), (9, None, "q"), (None, "a", "q"), (10, "one two", "q")], "item_id long, passage string, text string")
    for block in (1, 100):
        assert sorted((r.doc_id, r.item_id, r.errors) for r in leakage.leaks(docs, items, block=block).collect()) == [(1, 7, 0), (4, 8, 0)]
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0


def test_words_put_in_and_left_out():
    p = PASSAGE
    part = p[10:36]
    two_exchanged_one_in = [*part[:4], "other", *part[5:11], "put", *part[11:18], "other", *part[19:]]
    one_out = part[:12] + p[35:36] and [*p[10:22], *p[23:37]]
    assert held(*[FILL + " " + " ".join(x) + " " + FILL for x in (two_exchanged_one_in, one_out)]) == [{1}, {1}]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 55), st.lists(st.tuples(st.sampled_from("xio"), st.integers(2, 22)), max_size=3, unique_by=lambda e: e[1] // 4))
def test_runs_within_the_budget_are_found(at, edits):
    run = PASSAGE[at : at + 25]
    out = list(run)
    for kind, k in sorted(edits, key=lambda e: -e[1]):
        if kind == "x":
            out[k] = "exchanged"
        elif kind == "i":
            out.insert(k, "inserted")
        else:
            del out[k]
    assert held(FILL + " " + " ".join(out) + " " + FILL) == [{1}]


def test_short_passages():
    for n in (8, 9, 16, 20):
        passage = OTHER[:n]
        items = leakage.Items([(1, " ".join(passage))])
        find = lambda w, items=items: leakage.scan([FILL + " " + " ".join(w) + " " + FILL], items, items.automaton())[0]
        for k in range(1, n - 1):
            assert find([*passage[:k], "other", *passage[k + 1 :]]) == {1: (n, 1)}
        assert find(passage) == {1: (n, 0)} and find(passage[: n - 2]) == {} and find([w if k % 3 else "other" for k, w in enumerate(passage)]) == {}


def test_errors_are_the_least_and_words_those_held():
    p = PASSAGE
    one = [*p[:12], "other", *p[13:40]]
    text = " ".join(one) + " " + FILL + " " + " ".join(p[:30])
    items = leakage.Items([(1, " ".join(p))])
    assert leakage.scan([text], items, items.automaton()) == [{1: (40, 0)}]
    assert leakage.scan([" ".join(p[5:45])], items, items.automaton()) == [{1: (40, 0)}]


def test_long_tags_do_not_break_a_run():
    p = PASSAGE
    tag = '<span title="' + "x " * 400 + '">'
    assert held(" ".join(p[:12]) + tag + " " + " ".join(p[12:25])) == [{1}]
