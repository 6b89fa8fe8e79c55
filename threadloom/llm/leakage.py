"""Evaluation passages that leak into the corpus: pigeonhole edit matching.

A passage is held by a document that has at least ``RUN`` running words of it (or all, if it has fewer), with at most one word in
``PER_ERROR`` exchanged, left out or put in.  Within any ``RUN`` running words there are at most ``RUN // PER_ERROR`` errors, so of that budget
plus one whole pieces one is unbroken: passages are cut into pieces of at most ``PIECE`` words, short enough that any run holds
budget plus one whole pieces.  An Aho-Corasick automaton finds exact piece hits in one pass over a document's letters and digits.  Every
run of the passage around a hit is then verified with Myers' bit-parallel edit distance over words; runs that lack more words than the
budget allows are left out before, which loses none.

The items are a stated set: they are read in blocks of ``block`` items, each block's automaton is shipped to the tasks and the
documents are passed once for each block.  Documents are never shuffled.

Defined results: text compares by words after letter case, markup, zero-width marks, line prefixes (quote, diff and line-number marks) and
hyphenation are taken off; documents or passages that are null or blank hold nothing; the first and last word of a run must stand in the
document, in line with the words next to them (an exchanged word at the edge cannot be told from a shorter quotation with other text
beside it, which is no case); repeated documents count each by doc_id; equal rows give one result row; empty tables give an empty result.
``words`` counts the passage's words that lie in runs held, ``errors`` is the least distance of such a run.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.util import dealt

RUN, PER_ERROR, PIECE = 25, 8, 5
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("words", pa.int32()), ("errors", pa.int32())])

_HIDDEN = re.compile("[­​-‏⁠﻿*_`~]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_PREFIX = re.compile(r"^[ \t]*(?:\d+(?:\t|[ ]*[|:][ ])|[>+|#-]+(?=[ \t\w])|\[\d+\])[ \t]*", re.M)
_BREAK = re.compile(r"(?<=\w)[-‐‑]\s*\n\s*(?=\w)")
_JOIN = re.compile(r"(?<=\w)[-‐‑'’](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text, without the marks that may be set between or into them."""
    if not text:
        return []
    t = _HIDDEN.sub("", text)
    if "<" in t:
        t = _TAG.sub(lambda m: " " if m.group(0)[:3].lower() in ("<br", "<p>", "</p", "<li", "</l", "<di", "</d", "<td", "</t") else "", t)
    if "&" in t:
        t = html.unescape(t)
    t = _PREFIX.sub("", t)
    if "\n" in t:
        t = _BREAK.sub("", t)
    t = _JOIN.sub("", t)
    return _WORD.findall(t.lower())


def myers(pattern: list, text: list, whole: bool = False) -> int:
    """Least edit distance between ``pattern`` and any stretch of ``text`` (``whole``: and all of it), over words, bit-parallel (integers of
    any width)."""
    m = len(pattern)
    if not m:
        return len(text) if whole else 0
    peq: dict = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | (1 << i)
    full, top, carry = (1 << m) - 1, 1 << (m - 1), int(whole)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | carry) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        best = min(best, score)
    return score if whole else best


class Items:
    """Pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words: dict[int, list[str]] = {}
        self.pieces: dict[str, list[tuple[int, int, int]]] = {}  # piece -> (item, its first word, its words)
        for item, passage in items:
            w = words(passage)
            if not w:
                continue
            self.words[item] = w
            run = min(RUN, len(w))
            size = min(PIECE, run // (run // PER_ERROR + 1)) if run >= PER_ERROR else run
            for at in range(0, len(w) - size + 1, size):
                self.pieces.setdefault("".join(w[at : at + size]), []).append((item, at, size))

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for piece in self.pieces:
            a.add_word(piece, (piece, len(piece)))
        a.make_automaton()
        return a

    def held(self, doc: list[str], hits: list[tuple[int, str]]) -> dict[int, tuple[int, int]]:
        """item -> (words held, errors) of the passages that ``doc`` holds; hits: (start in the joined text, piece)."""
        starts = np.cumsum([0] + [len(w) for w in doc])
        runs: dict[int, set[tuple[int, int]]] = {}
        for start, piece in hits:
            at = int(np.searchsorted(starts, start, side="right")) - 1
            for item, k, size in self.pieces[piece]:
                n = len(self.words[item])
                run = min(RUN, n)
                runs.setdefault(item, set()).update((s, at - k) for s in range(max(0, k + size - run), min(k, n - run) + 1))
        out = {}
        for item, candidates in runs.items():
            best = self._verify(self.words[item], doc, candidates)
            if best:
                out[item] = best
        return out

    @staticmethod
    def _verify(passage: list[str], doc: list[str], runs: set[tuple[int, int]]) -> tuple[int, int] | None:
        """(words held, errors) over the runs (first word in the passage, shift to the document), or None."""
        run = min(RUN, len(passage))
        budget = run // PER_ERROR
        held: set[int] = set()
        least = None
        n = len(doc)
        for shift in sorted({d for _, d in runs}):
            near = set(doc[max(0, shift - budget) : max(0, shift + len(passage) + budget)])
            lacking = np.cumsum([0] + [w not in near for w in passage])
            for s in sorted(s for s, d in runs if d == shift):
                if lacking[s + run] - lacking[s] > budget:
                    continue
                words_ = passage[s : s + run]
                a, b = s + shift, s + shift + run  # the run's place in the document, if nothing is left out or put in
                if a >= 0 and doc[a:b] == words_:
                    errors = 0
                else:
                    errors = budget + 1
                    for i in range(max(0, a - budget), min(n, a + budget + 1)):
                        if doc[i] != words_[0] or (i != a and doc[i + 1 : i + 2] != words_[1:2] and doc[i + 2 : i + 3] != words_[2:3]):
                            continue
                        for j in range(max(i + 1, b - budget), min(n, b + budget) + 1):
                            if doc[j - 1] != words_[-1] or (j != b and doc[j - 2 : j - 1] != words_[-2:-1] and doc[j - 3 : j - 2] != words_[-3:-2]):
                                continue
                            if abs(j - i - run) <= budget:
                                errors = min(errors, myers(words_, doc[i:j], True))
                if errors <= budget:
                    held.update(range(s, s + run))
                    least = errors if least is None else min(least, errors)
        return None if least is None else (len(held), least)


def scan(texts: list[str | None], items: Items, automaton) -> list[dict[int, tuple[int, int]]]:
    out = []
    for text in texts:
        doc = words(text)
        joined = "".join(doc)
        hits = [(end - length + 1, piece) for end, (piece, length) in automaton.iter(joined)] if joined and items.pieces else []
        out.append(items.held(doc, hits) if hits else {})
    return out


def leaks(documents: DataFrame, items: DataFrame, block: int = 2_000) -> DataFrame:
    """(doc_id, item_id, words, errors): every document with every passage that it holds."""
    spark = documents.sparkSession
    rows = items.select("item_id", "passage").where("item_id IS NOT NULL AND passage IS NOT NULL").distinct().orderBy("item_id", "passage")
    stated = [(r["item_id"], r["passage"]) for r in rows.toLocalIterator()]
    out = None
    for at in range(0, max(1, len(stated)), block):
        part = spark.sparkContext.broadcast(stated[at : at + block])

        def find(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            held = Items(part.value)
            automaton = held.automaton() if held.pieces else None
            for batch in batches:
                ids = batch["doc_id"].to_pylist()
                found = scan(batch["text"].to_pylist(), held, automaton) if automaton else []
                rows = [(i, item, *v) for i, f in zip(ids, found) for item, v in f.items()]
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

        hits = dealt(documents.select("doc_id", "text").where("text IS NOT NULL")).mapInArrow(find, "doc_id bigint, item_id bigint, words int, errors int")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.min("errors").alias("errors"))
