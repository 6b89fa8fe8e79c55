"""Reading level of each document: a linear pairwise ranker with isotonic calibration.

Every document's prose (without code, log lines, headings and quoted evaluation passages) is reduced to a few syntax and vocabulary features
in one pass.  The ranker learns from pairs of rated documents whose ratings differ, so raters' scales need not agree; isotonic
regression (pool adjacent violators) turns its scores into levels.  It is fitted on about ``sample`` rated documents, taken by hash of
the id, and of their pairs on ``PAIRS`` drawn at random, less those whose ratings do not differ enough; features, scores and levels are computed for all documents.

Evaluation passages are a stated set of at most ``PASSAGES`` characters, which is checked before their word sequences are sent to the tasks.

Defined results: a document is English if the classifier of :mod:`threadloom.llm.language` says so of its prose, whatever its own lang column says
(without any language label every document with prose is); a document without prose (null, blank, only code) has no level; null ratings do
not count, and a rating delivered twice counts once; without any rated pair every level is null; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.language import Languages, fit
from threadloom.llm.leakage import words
from threadloom.llm.sampling import sampled
from threadloom.util import checkpoint, dealt

SAMPLE = 20_000
PAIRS = 60_000
GRAM = 4
PASSAGES = 50_000_000
FEATURES = ("sentence_words", "word_chars", "long_words", "very_long_words", "short_words", "subordinate", "commas", "nominal", "verbal", "connective", "prepositions")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("english", pa.bool_()), ("n_words", pa.int64()), ("features", pa.list_(pa.float64()))])

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_NOT_PROSE = re.compile(
    r"\s*(?:#{1,6}\s|\d{4}-\d\d-\d\d[T ]\d\d:|[>+|]|\d+\t|\$ |@@|\w+\[\w+\]:|(?:DEBUG|INFO|WARN|ERROR)\b|[\[{]\s*[\[{\"\]}]|\s{4,}\S|(?:def|fn|class|import|from|return|let|const|for|if)\b.*[:;{(]\s*$)"
)
_LEAD = re.compile(r"^\s*(?:(?:[*•-]|\d+[.)])\s+)?(?:[\[<(]?(?:user|assistant|agent|system|human|tool)[\]>)]*\s*:\s+)?", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_BREAK = re.compile(r"(?<=\w)-\s*\n\s*(?=\w)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

_SUBORDINATE = set("while when unless although though before after because until since if whereas whether which that insofar inasmuch notwithstanding provided".split())
_CONNECTIVE = set("consequently moreover accordingly furthermore nevertheless therefore hence thus however contrast follows practice".split())
_PREPOSITION = set("of in under within across by with to for on at from between through over".split())
_NOMINAL = re.compile(r"(?:tion|sion|ity|ment|ness|ance|ence|ism|ship|bility|ations?|ities)s?$")
_VERBAL = re.compile(r"(?:is|iz|ifi|at)(?:e|es|ed|ing)$")


def prose(text: str | None, quoted: Passages | None = None) -> list[list[str]]:
    """Sentences of prose as lists of words in lower case."""
    if not text or text.isspace():
        return []
    t = _BREAK.sub("", _FENCE.sub("\n", text.replace("\r\n", "\n").replace("\r", "\n")))
    out = []
    for line in t.split("\n"):
        if not line or _NOT_PROSE.match(line):
            continue
        for sentence in _SENTENCE.split(_LEAD.sub("", line, count=1)):
            w = [x.lower() for x in _WORD.findall(sentence)]
            if not w or (quoted is not None and quoted.hold(sentence, w)):
                continue
            w.append("," * sentence.count(","))
            out.append(w)
    return out


class Passages:
    """Word sequences of evaluation passages."""

    def __init__(self, passages: list[str]):
        self.grams: set[str] = set()
        self.vocabulary: set[str] = set()
        for p in passages:
            w = words(p)
            self.vocabulary.update(w)
            self.grams.update(" ".join(w[k : k + GRAM]) for k in range(max(0, len(w) - GRAM + 1)))

    def hold(self, sentence: str, rough: list[str]) -> bool:
        """Whether a good part of the sentence runs along a passage; ``rough``: its words, for a test that most sentences fail."""
        if sum(map(self.vocabulary.__contains__, rough)) < max(2, 0.25 * len(rough)):
            return False
        w = words(sentence)
        hits = sum(" ".join(w[k : k + GRAM]) in self.grams for k in range(max(0, len(w) - GRAM + 1)))
        return hits > 0 and (hits + GRAM - 1) >= 0.3 * len(w)


def vocabulary(text: str | None) -> Counter[str]:
    """The words of a text's prose."""
    return Counter(w for s in prose(text) for w in s[:-1])


class Profile:
    """Features and language of prose; what they need of a word is kept, since texts share their words."""

    def __init__(self, languages: Languages | None = None):
        self.languages = languages
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 8 + (len(languages.names) if languages else 0)))

    def _row(self, word: str) -> int:
        """The row of the table that holds a word's traits."""
        row = self.known.get(word)
        if row is None:
            row = self.known[word] = len(self.known)
            if row >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            n = len(word)
            self.table[row, :8] = (n, n >= 7, n >= 11, n <= 3, n > 6 and _NOMINAL.search(word) is not None, n > 7 and _VERBAL.search(word) is not None, word in _CONNECTIVE, word in _PREPOSITION)
            if self.languages:
                self.table[row, 8:] = self.languages.scores(word)
        return row

    def features(self, sentences: list[list[str]]) -> tuple[bool, int, list[float] | None]:
        """(is English, words, features) of sentences of :func:`prose`."""
        count: Counter[str] = Counter()
        commas = 0
        for s in sentences:
            count.update(s)
            commas += len(s[-1])
            count[s[-1]] -= 1
        if len(self.known) > 400_000:  # the rows of one text stay together
            self.known.clear()
        held = [(c, self._row(x)) for x, c in count.items() if c > 0 and x and x[0] != ","]
        if not held:
            return False, 0, None
        weights = np.array([c for c, _ in held], float)
        n = int(weights.sum())
        total = weights @ self.table[[row for _, row in held]]
        english = self.languages is None or int(np.argmax(total[8:])) == self.languages.english
        k = len(sentences)
        subordinate = sum(not _SUBORDINATE.isdisjoint(s) for s in sentences) / k
        chars, long_, very, short, nominal, verbal, connective, preposition = (total[:8] / n).tolist()
        return english, n, [float(np.log1p(n / k)), chars / 10, long_, very, short, subordinate, commas / n, nominal, verbal, connective, preposition]


def profiled(documents: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(doc_id, english, n_words, features) of every document; passages of ``items`` (a stated set) are no prose."""
    passages: list[str] = []
    if items is not None:
        stated = items.select("passage").where("passage IS NOT NULL").distinct()
        size = stated.agg(F.sum(F.length("passage"))).first()[0] or 0
        if size > PASSAGES:
            raise ValueError(f"passages of {size} characters are no stated set of at most {PASSAGES}")
        passages = [r["passage"] for r in stated.collect()]
    languages = fit(documents, vocabulary)
    shared = documents.sparkSession.sparkContext.broadcast((Passages(passages) if passages else None, languages))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, model = shared.value
        of = Profile(model)
        for batch in batches:
            got = [of.features(prose(t, grams)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.list_(pa.float64()))], schema=_SCHEMA)

    return dealt(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(profile, "doc_id bigint, english boolean, n_words bigint, features array<double>")


class Ranker:
    """score = (f - mean) / scale . weights; level = isotonic step function of the score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, knots: np.ndarray, levels: np.ndarray):
        self.mean, self.scale, self.weights, self.knots, self.levels = mean, scale, weights, knots, levels

    @staticmethod
    def fit(x: np.ndarray, rating: np.ndarray, pairs: int = PAIRS, rounds: int = 300, seed: int = 0) -> Ranker | None:
        rng = np.random.default_rng(seed)
        if len(x) < 2 or np.ptp(rating) == 0:
            return None
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - mean) / scale
        a, b = rng.integers(len(x), size=(2, pairs))
        gap = rating[a] - rating[b]
        keep = np.abs(gap) >= 0.5
        if not keep.any():
            keep = gap != 0
        d, weight = (z[a] - z[b])[keep] * np.sign(gap[keep])[:, None], np.minimum(np.abs(gap[keep]), 2)
        w = np.zeros(x.shape[1])
        step = 1.0 / (0.25 * (d * d).sum(axis=1).mean())
        for _ in range(rounds):  # logistic loss over pairs, by gradient descent with momentum-free steps
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            w += step * ((p * weight) @ d / weight.sum() - 1e-3 * w)
        score = z @ w
        order = np.argsort(score, kind="stable")
        knots, levels = pool_adjacent_violators(score[order], rating[order])
        return Ranker(mean, scale, w, knots, levels)

    def level(self, x: np.ndarray) -> np.ndarray:
        score = ((x - self.mean) / self.scale) @ self.weights
        return np.interp(score, self.knots, self.levels)


def pool_adjacent_violators(score: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the least-squares non-decreasing fit, with the mean score of each block as its knot; scores in ascending order."""
    blocks: list[list[float]] = []  # sum of values, number, sum of scores
    for s, v in zip(score, value):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, s2 = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][2] += s2
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def levels(documents: DataFrame, ratings: DataFrame, items: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, english, n_words, level) of every document; level is null without prose."""
    known = checkpoint(profiled(documents, items))
    votes = ratings.where("rating IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "rater_id", "rating").distinct().groupBy("doc_id").agg(F.avg("rating").alias("rating"))
    rated = checkpoint(known.where("english AND features IS NOT NULL").select("doc_id", "features").join(votes, "doc_id"))
    got = sampled(rated, "doc_id", sample).orderBy("doc_id").select("features", "rating").toPandas()
    ranker = Ranker.fit(np.array(got["features"].tolist()), got["rating"].to_numpy(float)) if len(got) else None
    if ranker is None:
        return known.select("doc_id", "english", "n_words", F.lit(None).cast("double").alias("level"))
    shared = documents.sparkSession.sparkContext.broadcast(ranker)
    schema = pa.schema([("doc_id", pa.int64()), ("english", pa.bool_()), ("n_words", pa.int64()), ("level", pa.float64())])

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch["features"].to_pylist()
            has = np.array([v is not None for v in f], bool)
            out = np.full(len(f), np.nan)
            if has.any():
                out[has] = shared.value.level(np.array([v for v in f if v is not None]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["english"], batch["n_words"], pa.array(out, mask=~has)], schema=schema)

    return known.mapInArrow(grade, "doc_id bigint, english boolean, n_words bigint, level double")
