"""Personal information inside free text, found by a character-level BiLSTM-CRF and replaced by typed placeholders.

Texts are cut into overlapping windows, whose characters are scored together in numpy.  Every character takes its scores from the window in which
it lies farthest from an edge, and the CRF is decoded once over the joined scores of the whole text, so windows cannot disagree about a
span.  Runs of one type become spans, ended at the edges of their words, and an exact check of each span's form follows.  The
weights are trained by ``pii_train`` and shipped with the package (their path is a parameter).  Texts are never shuffled: tagging is a map
over the scan.

Defined results: null, empty and blank texts hold nothing; equal rows count each; a text longer than a window is tagged over its whole
length; an empty table gives an empty result.  Other columns do not matter.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.pii_labels import TYPES
from threadloom.llm.pii_model import PAD, Tagger, encode
from threadloom.util import dealt

WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
WINDOW, STRIDE, BATCH = 512, 448, 512
MARGIN = (WINDOW - STRIDE) // 2
STRIPE = 256
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}

_TAGGERS: dict[str, Tagger] = {}


def tagger(path: str = WEIGHTS) -> Tagger:
    """The tagger, loaded once for each Python worker."""
    if path not in _TAGGERS:
        with np.load(path) as weights:
            _TAGGERS[path] = Tagger(dict(weights))
    return _TAGGERS[path]


def _scored(windows: list[tuple[np.ndarray, int]], model: Tagger) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """(scores (tags, characters, windows), characters that may lie in a span (windows, characters), [(start, end, start and end of the
    centre)]) of windows (text, start)."""
    ranges = []
    for codes, s in windows:
        e = min(len(codes), s + WINDOW)
        ranges.append((s, e, s + (MARGIN if s else 0), e - (MARGIN if e < len(codes) else 0)))
    x = np.full((len(windows), WINDOW), PAD, np.uint8)
    for i, ((codes, _), (s, e, _, _)) in enumerate(zip(windows, ranges)):
        x[i, : e - s] = codes[s:e]
    scores = model.emissions(np.ascontiguousarray(x.T))
    unsure = model.unsure(scores, np.array([e - s for s, e, _, _ in ranges]), np.array([s > 0 for s, _, _, _ in ranges]))
    return scores, unsure, ranges


def _starts(codes: np.ndarray) -> list[int]:
    return list(range(0, max(1, len(codes) - 2 * MARGIN), STRIDE))


def _long(codes: np.ndarray, model: Tagger) -> np.ndarray:
    """Tags of a text of many windows: ``STRIPE`` windows are scored at a time, and decoded up to a character that is surely in no span."""
    out, starts = [], _starts(codes)
    base, left, maybe = 0, np.zeros((model.w["start"].size, 0), np.float32), np.zeros(0, bool)
    for first in range(0, len(starts), STRIPE):
        scores, unsure, ranges = _scored([(codes, s) for s in starts[first : first + STRIPE]], model)
        left = np.concatenate([left, *[scores[:, lo - s : hi - s, i] for i, (s, _, lo, hi) in enumerate(ranges)]], axis=1)
        size = left.shape[1]
        maybe = np.r_[maybe, np.zeros(size - maybe.size, bool)]
        for i, (s, e, _, _) in enumerate(ranges):
            a, b = max(s, base), min(e, base + size)
            maybe[a - base : b - base] |= unsure[i, a - s : b - s]
        cut = size
        if first + STRIPE < len(starts):
            sure = np.flatnonzero(~maybe[: max(1, size - WINDOW)])
            if not sure.size:
                continue
            cut = int(sure[-1])
        out.append(model.decode_emissions(left[:, :, None], np.array([size]), maybe[None])[0, :cut])
        base, left, maybe = base + cut, left[:, cut:], maybe[cut:]
    return np.concatenate(out)


def tags(texts: list[str], model: Tagger) -> list[np.ndarray]:
    """Tags of every character of every text."""
    codes = [encode(t) for t in texts]
    out = [np.zeros(len(c), np.uint8) for c in codes]
    order = sorted((k for k, c in enumerate(codes) if 0 < len(c) <= WINDOW), key=lambda k: len(codes[k]))
    for first in range(0, len(order), BATCH):
        part = order[first : first + BATCH]
        lengths = np.array([len(codes[k]) for k in part])
        steps = int(lengths.max()) + int(lengths.max()) % 2
        x = np.full((len(part), steps), PAD, np.uint8)
        for j, k in enumerate(part):
            x[j, : lengths[j]] = codes[k]
        for k, got in zip(part, model.decode(np.ascontiguousarray(x.T), lengths)):
            out[k][:] = got[: len(codes[k])]
    # Longer texts: the windows of several are scored together, and their joined scores decoded together.
    order = sorted((k for k, c in enumerate(codes) if len(c) > WINDOW), key=lambda k: len(codes[k]))
    at = 0
    while at < len(order):
        part, windows = [], []
        while at < len(order) and (not part or len(windows) + len(_starts(codes[order[at]])) <= STRIPE):
            windows += [(len(part), s) for s in _starts(codes[order[at]])]
            part.append(order[at])
            at += 1
        if len(windows) > STRIPE:
            out[part[0]] = _long(codes[part[0]], model)
            continue
        scores, unsure, ranges = _scored([(codes[part[j]], s) for j, s in windows], model)
        lengths = np.array([len(codes[k]) for k in part])
        joined = np.zeros((scores.shape[0], int(lengths.max()), len(part)), np.float32)
        maybe = np.zeros((len(part), int(lengths.max())), bool)
        for i, ((j, _), (s, e, lo, hi)) in enumerate(zip(windows, ranges)):
            joined[:, lo:hi, j] = scores[:, lo - s : hi - s, i]
            maybe[j, s:e] |= unsure[i, : e - s]
        for k, n, got in zip(part, lengths, model.decode_emissions(joined, lengths, maybe)):
            out[k][:] = got[:n]
    return out


_SHAPE = {
    "email": re.compile(r"[\w.+-]+(?:@|%40|\s+@\s+|\s*[\[(]at[\])]\s*)[a-z][\w-]*(?:\.|\s*\(dot\)\s*)\w", re.I),
    "phone": re.compile(r"(?:\D*\d){7,15}\D*$"),
    "id_number": re.compile(r"(?:\D*\d){6,14}\D*$"),
    "street_address": re.compile(r"(?=.*(?<!\w)\d+[a-z]?(?!\w))(?=.*[^\W\d_]{3}).*[ ,]", re.S),
    "person_name": re.compile(r"(?=.*[^\W\d_]{3})\S+[\s,.-]+\S", re.S),
}


_SALUTATION = re.compile(r"(?:(?:hi|hello|hey|dear|yours|thanks|regards|mr|mrs|ms|dr|prof)\b[.,]?[ \t]+)+", re.I)
_JOINTS = {"email": ".+-_%", "phone": "-./", "id_number": "-./"}


def _whole(text: str, s: int, e: int, name: str) -> tuple[int, int]:
    """The range, led on to the edges of its words (for mail addresses and numbers: with the marks that join their parts)."""
    joints, n = _JOINTS.get(name, ""), len(text)
    escape = lambda k: k > 0 and text[k] in "nrt" and text[k - 1] == "\\"
    while s > 0 and not escape(s - 1) and (
        text[s - 1].isalnum() and (text[s].isalnum() or text[s] in joints) or text[s - 1] in joints and text[s].isalnum() and s > 1 and text[s - 2].isalnum() and not escape(s - 2)
    ):
        s -= 1
    while e < n and (text[e].isalnum() and (text[e - 1].isalnum() or text[e - 1] in joints) or text[e] in joints and text[e - 1].isalnum() and e + 1 < n and text[e + 1].isalnum()):
        e += 1
    return s, e


def spans(text: str, tag: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, type) of the runs of one type whose text has the form of the type."""
    at = np.flatnonzero(tag)
    out: list[tuple[int, int, str]] = []
    if not at.size:
        return out
    kind = (tag.astype(int) + 1) // 2
    begins = (kind > 0) & ((tag % 2 == 1) | (kind != np.r_[0, kind[:-1]]))
    for s in np.flatnonzero(begins):
        e = s + 1
        while e < len(tag) and kind[e] == kind[s] and not begins[e]:
            e += 1
        name = TYPES[kind[s] - 1]
        s, e = _whole(text, int(s), e, name)
        if out and s < out[-1][1]:  # two runs in one word: the first has it
            s = out[-1][1]
        if name == "person_name" and (greeting := _SALUTATION.match(text, s, e)):
            s = greeting.end()
        value = text[s:e]
        if name in ("phone", "id_number") and text[s - 1 : s] == "_" and s > 1 and text[s - 2].isalnum():  # a number within a name, like call_0098
            continue
        if _SHAPE[name].match(value) and not (name == "email" and (value.lower().startswith("git@") or text[e : e + 1] == ":" and text[e + 1 : e + 2].isalnum())):
            out.append((int(s), int(e), name))
    return out


def found(texts: list[str | None], model: Tagger) -> list[list[tuple[int, int, str]]]:
    """Spans of each text; equal texts of a batch are tagged once."""
    distinct = list(dict.fromkeys(t for t in texts if t and not t.isspace()))
    known = {t: spans(t, g) for t, g in zip(distinct, tags(distinct, model))}
    return [known.get(t, []) if t else [] for t in texts]


def redact(text: str, marks: list[tuple[int, int, str]]) -> str:
    for s, e, name in reversed(marks):
        text = f"{text[:s]}{PLACEHOLDERS[name]}{text[e:]}"
    return text


def tagged(rows: DataFrame, weights: str = WEIGHTS, redacted: bool = False) -> DataFrame:
    """(src_table, row_id, types, text) for rows of (src_table, row_id, text); ``text`` only where it is to be redacted."""
    fields = [("src_table", pa.string()), ("row_id", pa.int64()), ("types", pa.list_(pa.string())), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tagger(weights)
        for batch in batches:
            texts = batch["text"].to_pylist()
            marks = found(texts, model)
            types = [sorted({m[2] for m in k}) for k in marks]
            new = [redact(t, k) if t and k else t for t, k in zip(texts, marks)] if redacted else [None] * len(texts)
            yield pa.RecordBatch.from_arrays([batch["src_table"], batch["row_id"], pa.array(types, pa.list_(pa.string())), pa.array(new, pa.string())], schema=pa.schema(fields))

    return dealt(rows.select("src_table", F.col("row_id").cast("bigint"), "text")).mapInArrow(run, "src_table string, row_id bigint, types array<string>, text string")


def texts(basic_session: DataFrame, new_format: DataFrame) -> DataFrame:
    """(src_table, row_id, text) of the free text of both tables."""
    a = basic_session.select(F.lit("basic_session").alias("src_table"), "row_id", F.col("message.content").alias("text"))
    b = new_format.select(F.lit("new_format").alias("src_table"), "row_id", F.col("payload.message").alias("text"))
    return a.unionByName(b).where("text IS NOT NULL")
