import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import language, reading

EASY = "The key is old. The team saves the file and the box needs it. We can stop the run now. "
HARD = "Consequently, the idempotent instrumentation of previously unobserved derivations problematises the probabilistic supersession, insofar as the retroactive materialisation necessitates an otherwise heterogeneous disambiguation. "


def test_prose():
    text = "# Heading words\nUser: Some prose here. More of it?\n```\ncode here\n```\n2026-01-01T00:00:00Z ERROR [x] log line\n* A list item\n> quoted line\n$ run it\n{\"a\": 1}\nThe end-\ning is joined.\r\nLast"
    assert [s[:-1] for s in reading.prose(text)] == [["some", "prose", "here"], ["more", "of", "it"], ["a", "list", "item"], ["the", "ending", "is", "joined"], ["last"]]
    passage = "Halfway through the audit a courier called Jor reshuffled the amber ledger page thereby costing Osk exactly nine credits"
    held = reading.Passages([passage])
    assert reading.prose(passage + ". The key is old.", held) == [["the", "key", "is", "old", ""]]
    assert reading.prose(None) == reading.prose(" \n") == []


GERMAN = "Die Sitzung ersetzt den alten Eintrag nach dem Neustart und der Index prüft das Feld. Jede Regel gilt für alle neuen Dateien."
FRENCH = "Le journal rejette la prochaine exécution et la session trouve le dossier partagé. Chaque règle vaut pour les nouveaux fichiers."


def test_language():
    texts = {"en": EASY + HARD, "de": GERMAN, "fr": FRENCH}
    model = language.Languages({k: language.counts(reading.vocabulary(v)) for k, v in texts.items()})
    of = reading.Profile(model)
    assert of.features(reading.prose("We keep the old runs. Further derivations need consequently more files."))[0]
    for other in ("Der Eintrag ist nach dem Neustart neu und die Sitzung alt.", "La règle rejette les fichiers de la session.", "Ersetzt der Index den Eintrag?"):
        assert not of.features(reading.prose(other))[0]
    assert of.features([]) == (False, 0, None) and reading.Profile().features(reading.prose(EASY))[0]


def test_language_is_learnt_from_labels_that_may_be_wrong(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        name, text = [("en", EASY), ("de", GERMAN), ("fr", FRENCH), ("en", HARD)][i % 4]
        label = [name, name.upper() + "-xx", None, "und", "en"][i % 5] if rng.random() < 0.6 else name
        words = text.split()
        rows.append((i, " ".join(words[k] for k in rng.integers(len(words), size=20)), label))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.english for r in reading.profiled(docs).collect()}
    assert np.mean([got[i] == (i % 4 in (0, 3)) for i in range(240)]) > 0.98


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40))
def test_isotonic(values):
    knots, levels = reading.pool_adjacent_violators(np.arange(len(values), dtype=float), np.array(values, float))
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    assert np.allclose(levels, list(dict.fromkeys(_steps(values))))
    if len(values) <= 5:
        assert sum((np.array(values) - _steps(values)) ** 2) <= min(_error(values, c) for c in _monotone(values)) + 1e-9


def _steps(values):
    blocks = [[v, 1] for v in values]
    k = 0
    while k < len(blocks) - 1:
        if blocks[k][0] / blocks[k][1] >= blocks[k + 1][0] / blocks[k + 1][1]:
            blocks[k] = [blocks[k][0] + blocks[k + 1][0], blocks[k][1] + blocks[k + 1][1]]
            del blocks[k + 1]
            k = max(0, k - 1)
        else:
            k += 1
    return np.array([s / n for s, n in blocks for _ in range(n)])


def _monotone(values):
    grid = sorted(set(values))
    out = [[]]
    for _ in values:
        out = [c + [g] for c in out for g in grid if not c or g >= c[-1]]
    return out


def _error(values, c):
    return sum((v - x) ** 2 for v, x in zip(values, c))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, ratings = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/level_ratings.parquet")
    train = reading.levels(docs, ratings.where("doc_id % 3 > 0")).select("doc_id", "english", "level")
    votes = ratings.where("rating IS NOT NULL AND doc_id % 3 = 0").distinct().groupBy("doc_id").agg({"rating": "avg"}).toDF("doc_id", "r")
    got = train.join(votes, "doc_id").where("english AND level IS NOT NULL").toPandas()
    assert len(got) > 100 and np.corrcoef(got.level, got.r)[0, 1] > 0.9
    clear = got[(got.r <= 3) | (got.r >= 4)]
    assert ((clear.level >= 3.5) == (clear.r >= 4)).mean() > 0.95


def test_tables(spark):
    rows = [(i, (EASY if i % 2 else HARD) * (1 + i % 3), "x") for i in range(20)] + [(100, None, "x"), (101, "", "x"), (102, "```\ncode\n```", "x"), (103, EASY * 2000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, level string")
    ratings = spark.createDataFrame([(i, 1, 1 if i % 2 else 5) for i in range(20)] * 2 + [(1, 2, None), (None, 1, 3), (999, 1, 3)], "doc_id long, rater_id int, rating int")
    got = {r.doc_id: r.level for r in reading.levels(docs, ratings).collect()}
    assert len(got) == 24 and got[100] is got[101] is got[102] is None and got[103] < 2 and got[0] > 4 and got[1] < 2
    assert all(r.level is None for r in reading.levels(docs, ratings.limit(0)).collect())
    assert reading.levels(docs.limit(0), ratings).count() == 0
