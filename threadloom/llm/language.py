"""Which language a text is in: a naive Bayes classifier over the character n-grams of its words.

It is fitted here, on the documents that carry a language label: about ``SAMPLE`` of them, taken by hash of the id.  Labels may be wrong at times;
a wrong one changes the shares of n-grams little.  The model is a table of ``BUCKETS`` x languages, whatever the size of the corpus.  The score of
a text is a sum over its words, and a word's scores are kept, since texts share their words.

Defined results: labels compare by their first part in lower case ('EN-us' is 'en'); null, blank and undetermined labels ('und', 'mul',
'zxx') are none; without any label there is no model; a text without words has no language.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.sampling import sampled
from threadloom.util import dealt

SAMPLE, BUCKETS, LANGUAGES = 4_000, 1 << 14, 16
LONGEST = 4


def buckets(word: str) -> list[int]:
    """The n-grams of a word of letters, begin and end marked, of up to ``LONGEST`` characters, as places in the table."""
    text = f"^{word}$"
    return [zlib.crc32(text[k : k + n].encode()) % BUCKETS for n in range(1, LONGEST + 1) for k in range(len(text) - n + 1)]


def counts(words: Counter[str]) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for word, n in words.items():
        np.add.at(out, buckets(word), n)
    return out


class Languages:
    """Log shares of n-grams by language."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.names = sorted(tables)
        shares = np.array([tables[name] for name in self.names]) + 0.1
        self.table = np.log(shares / shares.sum(axis=1, keepdims=True)).T.copy()
        self.english = self.names.index("en") if "en" in self.names else -1

    def scores(self, word: str) -> np.ndarray:
        return self.table[buckets(word)].sum(axis=0)


def fit(documents: DataFrame, words: Callable[[str | None], Counter[str]], sample: int = SAMPLE) -> Languages | None:
    """A model from the labelled documents, or None without any.  documents: doc_id, text, lang; words: the words of a text."""
    if "lang" not in documents.columns:
        return None
    label = F.nullif(F.lower(F.regexp_extract(F.trim("lang"), "^([A-Za-z]{2,3})(?:[-_]|$)", 1)), F.lit(""))
    named = documents.select("doc_id", "text", label.alias("lang")).where("lang IS NOT NULL AND lang NOT IN ('und', 'mul', 'zxx')")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                held = words(text)
                if held:
                    total[name] = total.get(name, 0) + counts(held)
        for name, table in total.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * at.size, pa.string()), pa.array(at, pa.int64()), pa.array(table[at])], names=["lang", "bucket", "n"])

    some = sampled(named, "doc_id", sample)
    totals = dealt(some.select("lang", "text")).mapInArrow(count, "lang string, bucket bigint, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most BUCKETS rows for each two- or three-letter label that the sample holds.
    tables: dict[str, np.ndarray] = {}
    for r in totals.toLocalIterator():
        tables.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    kept = sorted(tables, key=lambda k: -tables[k].sum())[:LANGUAGES]
    return Languages({k: tables[k] for k in kept}) if kept else None
