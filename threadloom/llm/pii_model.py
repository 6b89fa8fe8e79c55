"""Character-level bidirectional LSTM with a CRF layer, in numpy.

The cell uses clipped-linear activations (gates clip to [0, 1], candidate and output to [-1, 1]), which a CPU evaluates
without exponentials.  A step takes two characters: its input weights are the sum of one table row for each, kept ready for all
pairs, so a step is a gather, one small matrix product and a few element-wise operations over a batch of windows of about the
same length.  Every character has its own emission (two output layers read a step's state), and the CRF runs over characters.

Decoding is exact.  A bound of three states (O, any B, any I; the best of each group's scores) gives for every character the most that a
stretch outside O around it can gain over staying in O.  Where that is negative the best path is in O; these characters cut a window into
islands, and Viterbi over all tags runs over the islands alone.
"""

from __future__ import annotations

import numpy as np

from .pii_labels import TYPES

TAGS = 1 + 2 * len(TYPES)  # O, then B and I of each type
PAD, OTHER, OTHER_UPPER, OTHER_LOWER, OTHER_MARK = 0, 1, 2, 3, 4
VOCABULARY = 104


def _table() -> np.ndarray:
    table = np.full(0x10000, OTHER_MARK, dtype=np.uint8)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        if 32 <= c < 127:
            table[c] = c - 32 + 5
        elif c in (9, 10, 13):
            table[c] = 101 if c == 10 else 5
        elif c > 127:
            s = chr(c)
            table[c] = OTHER_UPPER if s.isupper() else OTHER_LOWER if s.isalpha() else 5 if s.isspace() else OTHER_MARK
        else:
            table[c] = OTHER
    table[0x2019] = table[0x2018] = ord("'") - 27
    return table


_TABLE = None


def encode(text: str) -> np.ndarray:
    """Character classes of a text, one for each code point."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _table()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return _TABLE[np.minimum(points, 0xFFFF)]


class Tagger:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.array(v, dtype=np.float32) for k, v in weights.items()}
        h = self.hidden = self.w["uf"].shape[0]
        self.pairs, self.recurrent = {}, {}
        for d in "fb":  # padding closes all gates and so clears the state
            first, second = self.w[f"e{d}0"], self.w[f"e{d}1"]
            first[PAD, : 3 * h] = -1e4
            first[PAD, 3 * h :] = 0
            both = (first[:, None, :] + second[None, :, :]).reshape(-1, 4 * h)
            self.pairs[d] = np.ascontiguousarray(both[:, : 3 * h]), np.ascontiguousarray(both[:, 3 * h :])
            self.recurrent[d] = np.ascontiguousarray(self.w[f"u{d}"][:, : 3 * h]), np.ascontiguousarray(self.w[f"u{d}"][:, 3 * h :])

    def _run(self, x: np.ndarray, d: str, out: np.ndarray) -> None:
        steps, b = x.shape
        h = self.hidden
        (gate_rows, new_rows), (gate_u, new_u) = self.pairs[d], self.recurrent[d]
        state, cell, r = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32), np.empty((b, h), np.float32)
        g, gm = np.empty((b, 3 * h), np.float32), np.empty((b, 3 * h), np.float32)
        n, nm = np.empty((b, h), np.float32), np.empty((b, h), np.float32)
        for t in range(steps - 1, -1, -1) if d == "b" else range(steps):
            np.take(gate_rows, x[t], axis=0, out=g, mode="clip")
            np.take(new_rows, x[t], axis=0, out=n, mode="clip")
            g += np.matmul(state, gate_u, out=gm)
            n += np.matmul(state, new_u, out=nm)
            np.clip(g, 0.0, 1.0, out=g)
            np.clip(n, -1.0, 1.0, out=n)
            cell *= g[:, h : 2 * h]
            n *= g[:, :h]
            cell += n
            np.clip(cell, -1.0, 1.0, out=r)
            np.multiply(r, g[:, 2 * h :], out=state)
            out[t] = state

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (tags, characters, batch) of character classes (characters, batch); an even number of characters."""
        steps, b = x.shape[0] // 2, x.shape[1]
        h = self.hidden
        pairs = x[0::2].astype(np.intp)
        pairs *= VOCABULARY
        pairs += x[1::2]
        both = np.empty((2, steps, b, h), np.float32)
        self._run(pairs, "f", both[0])
        self._run(pairs, "b", both[1])
        e = np.empty((TAGS, steps, 2, b), np.float32)
        for k in (0, 1):
            w = self.w[f"wo{k}"]
            part = np.dot(w[:h].T, both[0].reshape(-1, h).T)
            part += np.dot(w[h:].T, both[1].reshape(-1, h).T)
            part += self.w[f"bo{k}"][:, None]
            e[:, :, k] = part.reshape(TAGS, steps, b)
        return e.reshape(TAGS, 2 * steps, b)

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tag paths (batch, characters) as uint8; positions beyond a window's length are 0."""
        return self.decode_emissions(self.emissions(x), lengths) if x.size else np.zeros(x.shape[::-1], np.uint8)

    def decode_emissions(self, e: np.ndarray, lengths: np.ndarray, unsure: np.ndarray | None = None) -> np.ndarray:
        """``decode`` from scores (tags, characters, batch).  ``unsure`` (batch, characters): those that may lie outside O, if known."""
        _, steps, b = e.shape
        tags = np.zeros((b, steps), np.uint8)
        unsure = self.unsure(e, lengths) if unsure is None else unsure
        edge = np.diff(np.pad(unsure, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1]  # rows come in order, so begins and ends pair up
        size = last - first
        order = np.argsort(size, kind="stable")
        for at in range(0, order.size, 4096):
            part = order[at : at + 4096]
            self._viterbi(e, row[part], first[part], size[part], lengths, tags)
        return tags

    def unsure(self, e: np.ndarray, lengths: np.ndarray, inner: np.ndarray | None = None) -> np.ndarray:
        """(batch, characters): whether a stretch outside O that holds the character may gain over O.  ``inner`` (batch): begins inside
        a text, so that a stretch may come in from the left."""
        trans, start = self.w["trans"], self.w["start"]
        _, steps, b = e.shape
        own = {"B": slice(1, None, 2), "I": slice(2, None, 2)}
        beyond = np.arange(steps)[:, None] >= lengths[None, :]
        m = {k: e[s].max(axis=0) - e[0] for k, s in own.items()}
        for k in m:
            m[k][beyond] = -1e9
        stay = trans[0, 0]
        move = {(j, k): np.float32(trans[own[j]][:, own[k]].max() - stay) for j in own for k in own}
        enter = {k: np.float32(trans[0, own[k]].max() - stay) for k in own}
        leave = {k: np.float32(trans[own[k], 0].max() - stay) for k in own}
        fore, hind = {k: np.empty_like(m[k]) for k in own}, {k: np.empty_like(m[k]) for k in own}
        for k in own:
            fore[k][0] = m[k][0] + (np.float32(start[own[k]].max() - start[0]) if inner is None else np.where(inner, np.float32(0), np.float32(start[own[k]].max() - start[0])))
            hind[k][steps - 1] = 0
        last = lengths - 1
        for t in range(1, steps):
            for k in own:
                best = np.maximum(fore["B"][t - 1] + move["B", k], fore["I"][t - 1] + move["I", k])
                np.maximum(best, enter[k], out=best)
                np.add(best, m[k][t], out=fore[k][t])
        for t in range(steps - 2, -1, -1):
            after = {k: hind[k][t + 1] + m[k][t + 1] for k in own}
            end = t >= last
            for k in own:
                best = np.maximum(after["B"] + move[k, "B"], after["I"] + move[k, "I"])
                np.maximum(best, np.where(end, np.float32(0), leave[k]), out=hind[k][t])
        return ((np.maximum(fore["B"] + hind["B"], fore["I"] + hind["I"]) >= -1e-3) & ~beyond).T

    def _viterbi(self, e: np.ndarray, row: np.ndarray, first: np.ndarray, size: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> None:
        """Viterbi over islands, whose neighbours are in O; sets their tags."""
        trans, n, longest = self.w["trans"], row.size, int(size.max())
        scores = np.empty((longest, TAGS, n), np.float32)
        scores[0] = np.where(first == 0, self.w["start"][:, None], trans[0][:, None]) + e[:, first, row]
        for t in range(1, longest):
            lo = int(np.searchsorted(size, t, side="right"))  # islands are sorted by length, so those that go on are a tail
            best = (scores[t - 1, :, None, lo:] + trans[:, :, None]).max(axis=0)
            np.add(best, e[:, first[lo:] + t, row[lo:]], out=scores[t, :, lo:])
        # Backwards each island asks for its own tag's best predecessor only.
        leave = np.where(first + size < lengths[row], trans[:, 0][:, None], 0)
        tag = np.zeros(n, np.int64)
        for t in range(longest - 1, -1, -1):
            lo, on = int(np.searchsorted(size, t, side="right")), int(np.searchsorted(size, t + 1, side="right"))
            tag[on:] = (scores[t, :, on:] + trans[:, tag[on:]]).argmax(axis=0)
            tag[lo:on] = (scores[t, :, lo:on] + leave[:, lo:on]).argmax(axis=0)
            tags[row[lo:], first[lo:] + t] = tag[lo:]
