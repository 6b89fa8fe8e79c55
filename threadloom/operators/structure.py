"""Structural index of a batch of JSON texts, in numpy.

The texts lie end to end.  Bitmaps of quotes, brackets and delimiters, and the parity of quotes, tell structure from text; the tokens of all
texts are then checked against the grammar by their neighbours, and one sort by nesting depth gives every token its container, its
place among the container's elements and every bracket its partner.  Nothing recurses and nothing is done depth by depth, so texts may be
nested to any depth and numbers may have any number of digits.

A text is good if it is one complete JSON value (NaN and Infinity are none).  Tokens of other texts are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY, COMMA, COLON, STRING, SCALAR = range(8)
#: Bytes of text indexed at once; a longer text is indexed alone.
PART = 4 << 20

_CLASS = np.full(256, SCALAR, np.uint8)
for _k, _c in enumerate(b'{}[],:"'):
    _CLASS[_c] = _k
_STRUCTURAL = _CLASS <= COLON
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_LITERAL = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")


def parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first, slice) of an array of strings, each slice of about ``PART`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes), 0
    while at < len(texts):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + PART, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


class Index:
    """Tokens of the good texts, in order: ``at``, ``end`` (byte range), ``kind``, ``doc``, ``holder`` (token of the container, or -1),
    ``place`` (elements of the container before it), ``partner`` (of an opening bracket the closing one), ``key`` (is the name of a field)."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        n = len(texts)
        self.good = np.zeros(n, bool)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.r_[0, np.cumsum(sizes + 1)[:-1]] if n else np.zeros(0, np.int64)
        whole = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), texts)
        self.data = pc.binary_join(whole, "\n")[0].as_buffer().to_pybytes() if n else b""
        b = self.b = np.frombuffer(self.data, np.uint8)
        for name in ("at", "end", "doc", "holder", "place", "partner"):
            setattr(self, name, np.zeros(0, np.int64))
        self.kind, self.key = np.zeros(0, np.uint8), np.zeros(0, bool)
        if not b.size:
            return
        bad = np.zeros(n, bool)
        doc_of = lambda where: np.searchsorted(starts, where, side="right") - 1

        slash = np.flatnonzero(b == 0x5C)
        escaping = slash
        quote = b == 0x22
        if slash.size:  # a character is escaped after an odd run of backslashes
            run = np.r_[True, np.diff(slash) != 1]
            first = slash[run][np.cumsum(run) - 1]
            escaping = slash[(slash - first) % 2 == 0]
            after = escaping[escaping + 1 < b.size] + 1
            quote[after] = False
        toggles = quote.copy()
        per_doc = np.add.reduceat(quote, np.minimum(starts, b.size - 1), dtype=np.int64)
        per_doc[sizes == 0] = 0
        odd = (per_doc & 1) == 1
        bad |= odd
        ends = starts + sizes
        toggles[ends[odd & (ends < b.size)]] ^= True  # an open string ends with its text
        inside = np.bitwise_xor.accumulate(toggles)
        wrong = np.flatnonzero((b < 0x20) & inside)
        bad[doc_of(wrong)] = True
        if escaping.size:
            escaping = escaping[inside[escaping]]
            follows = np.minimum(escaping + 1, b.size - 1)
            fault = ~_ESCAPES[b[follows]]
            unicode_ = b[follows] == 0x75
            for k in range(2, 6):
                fault |= unicode_ & ~_HEX[b[np.minimum(escaping + k, b.size - 1)]]
            bad[doc_of(escaping[fault])] = True

        scalar = ~inside & ~quote & ~_STRUCTURAL[b] & ~_BLANK[b]
        begins = scalar.copy()
        begins[1:] &= ~scalar[:-1]
        opens = quote & inside
        at = np.flatnonzero(begins | opens | (_STRUCTURAL[b] & ~inside))
        if not at.size:
            return
        kind = np.where(begins[at], SCALAR, _CLASS[b[at]]).astype(np.uint8)
        doc = doc_of(at)
        end = at + 1
        last = scalar.copy()
        last[:-1] &= ~scalar[1:]
        end[kind == SCALAR] = np.flatnonzero(last) + 1
        keep = ~bad[doc]
        at, kind, doc, end = at[keep], kind[keep], doc[keep], end[keep]
        shut = np.flatnonzero(quote & ~inside)
        end[kind == STRING] = shut[~bad[doc_of(shut)]] + 1

        self._check_literals(at, end, kind, doc, bad)
        at, kind, doc, end = self._balanced(at, kind, doc, end, bad)
        if not at.size:
            return
        self.at, self.end, self.kind, self.doc = at, end, kind, doc
        self._nest()
        bad[doc[self._misplaced()]] = True
        keep = ~bad[doc]
        where = np.cumsum(keep) - 1  # containers and partners belong to the same text, so they stay or go together
        for name in ("at", "end", "kind", "doc", "place", "key"):
            setattr(self, name, getattr(self, name)[keep])
        self.holder = np.where(self.holder[keep] < 0, -1, where[self.holder[keep]])
        self.partner = np.where(self.partner[keep] < 0, -1, where[self.partner[keep]])
        self.good[self.doc] = True

    def _check_literals(self, at: np.ndarray, end: np.ndarray, kind: np.ndarray, doc: np.ndarray, bad: np.ndarray) -> None:
        words = np.flatnonzero(kind == SCALAR)
        if words.size:
            coded = spans(self.b, at[words], end[words]).dictionary_encode()
            wrong = np.array([_LITERAL.fullmatch(x) is None for x in coded.dictionary.to_pylist()], bool)
            bad[doc[words[wrong[coded.indices.to_numpy(zero_copy_only=False)]]]] = True

    @staticmethod
    def _balanced(at: np.ndarray, kind: np.ndarray, doc: np.ndarray, end: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, ...]:
        """The tokens without texts whose brackets do not close, or close before they open."""
        keep = ~bad[doc]
        at, kind, doc, end = at[keep], kind[keep], doc[keep], end[keep]
        if not at.size:
            return at, kind, doc, end
        step = np.isin(kind, (OPEN_OBJECT, OPEN_ARRAY)).astype(np.int64) - np.isin(kind, (CLOSE_OBJECT, CLOSE_ARRAY))
        deep = np.cumsum(step)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        base = deep[first] - step[first]
        last = np.r_[first[1:], doc.size] - 1
        bad[doc[first[(np.minimum.reduceat(deep, first) < base) | (deep[last] != base)]]] = True
        keep = ~bad[doc]
        return at[keep], kind[keep], doc[keep], end[keep]

    def _nest(self) -> None:
        kind, n = self.kind, self.kind.size
        opening = (kind == OPEN_OBJECT) | (kind == OPEN_ARRAY)
        step = opening.astype(np.int64) - ((kind == CLOSE_OBJECT) | (kind == CLOSE_ARRAY))
        outer = np.cumsum(step) - opening  # texts are balanced, so each begins at depth 0
        heads = np.flatnonzero(opening)
        # A container heads the group of its elements, and is itself an element of a group one level up.
        level = np.r_[outer, outer[heads] + 1]
        token = np.r_[np.arange(n), heads]
        order = np.lexsort((token, level))
        token, is_head = token[order], order >= n
        latest = np.maximum.accumulate(np.where(is_head, np.arange(order.size), -1))
        commas = np.cumsum(~is_head & (kind[token] == COMMA))
        self.holder, self.place, self.partner = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1)
        member = ~is_head
        held = member & (latest >= 0)
        self.holder[token[held]] = token[latest[held]]
        self.place[token[held]] = commas[held] - commas[latest[held]]
        # The next element of an opening bracket's own group is its closing one.
        group = np.flatnonzero(member)
        here = opening[token[group]]
        after = np.r_[group[1:], -1]
        self.partner[token[group[here]]] = token[after[here]]
        before = np.r_[COLON, kind[:-1]]
        within = (self.holder >= 0) & (kind[np.maximum(self.holder, 0)] == OPEN_OBJECT)
        self.key = (kind == STRING) & within & np.isin(before, (OPEN_OBJECT, COMMA))

    def _misplaced(self) -> np.ndarray:
        """Tokens that may not stand after the one before them."""
        kind, doc = self.kind, self.doc
        value = np.isin(kind, (OPEN_OBJECT, OPEN_ARRAY, STRING, SCALAR))
        ended = np.isin(kind, (CLOSE_OBJECT, CLOSE_ARRAY, SCALAR)) | ((kind == STRING) & ~self.key)
        first = np.r_[True, doc[1:] != doc[:-1]]
        before = np.r_[COLON, kind[:-1]]
        after_key, after_value = np.r_[False, self.key[:-1]], np.r_[False, ended[:-1]]
        within = (self.holder >= 0) & (kind[np.maximum(self.holder, 0)] == OPEN_OBJECT)
        fits = np.select(
            [first, after_key, after_value, before == OPEN_OBJECT, before == OPEN_ARRAY, before == COMMA],
            [
                value, kind == COLON, np.isin(kind, (COMMA, CLOSE_OBJECT, CLOSE_ARRAY)) & ((self.holder >= 0) | (kind != COMMA)),
                self.key | (kind == CLOSE_OBJECT), value | (kind == CLOSE_ARRAY), np.where(within, self.key, value),
            ], value,
        )
        last = np.r_[first[1:], True]
        heads = np.flatnonzero(self.partner >= 0)
        crossed = np.zeros(kind.size, bool)
        crossed[heads] = kind[self.partner[heads]] != kind[heads] + 1
        return ~fits | (last & ~ended) | crossed

    def raw(self, token: int) -> bytes:
        """The text of a token; of an opening bracket all to its partner."""
        return self.data[self.at[token] : self.end[self.partner[token] if self.partner[token] >= 0 else token]]

    def names(self) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(tokens that name a field, the number of each one's name, the names)."""
        keys = np.flatnonzero(self.key)
        coded = spans(self.b, self.at[keys] + 1, self.end[keys] - 1).dictionary_encode()
        raw = [unescaped(x) for x in coded.dictionary.to_pylist()]
        number = {name: k for k, name in enumerate(dict.fromkeys(raw))}
        return keys, np.array([number[x] for x in raw], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if keys.size else keys, list(number)


def spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an array of binary values."""
    sizes = ends - starts
    offsets = np.r_[0, np.cumsum(sizes)]
    held = b[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    return pa.Array.from_buffers(pa.large_binary(), sizes.size, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(held)])


def unescaped(raw: bytes) -> str:
    """The text of a JSON string without its quotes; half of a surrogate pair becomes a replacement character."""
    if b"\\" not in raw:
        return raw.decode("utf-8", "replace")
    return json.loads(b'"' + raw + b'"').encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Digits(str):
    """A number of more digits than an integer is read from; its digits."""


def number(raw: str) -> int | float | Digits:
    if re.fullmatch(r"-?\d+", raw):
        return int(raw) if len(raw) <= 4000 else Digits(raw)
    return float(raw)


def value(text: str | None) -> tuple[bool, object]:
    """(is one complete JSON value, the value); nested to any depth, a repeated key counts by its last value."""
    index = Index(pa.array([text], pa.string()))
    if not index.good[0]:
        return False, None
    kinds, keys, at, end = index.kind.tolist(), index.key.tolist(), index.at.tolist(), index.end.tolist()
    root: list = []
    stack: list = [root]
    name: list = [None]
    for k, kind in enumerate(kinds):
        if kind in (COMMA, COLON):
            continue
        if kind in (CLOSE_OBJECT, CLOSE_ARRAY):
            stack.pop()
            name.pop()
            continue
        raw = index.data[at[k] : end[k]]
        if keys[k]:
            name[-1] = unescaped(raw[1:-1])
            continue
        new = {} if kind == OPEN_OBJECT else [] if kind == OPEN_ARRAY else unescaped(raw[1:-1]) if kind == STRING else {b"true": True, b"false": False, b"null": None}[raw] if raw[:1] in b"tfn" else number(raw.decode())
        if isinstance(stack[-1], dict):
            stack[-1][name[-1]] = new
        else:
            stack[-1].append(new)
        if kind in (OPEN_OBJECT, OPEN_ARRAY):
            stack.append(new)
            name.append(None)
    return True, root[0]
