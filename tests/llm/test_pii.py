import numpy as np
import pytest

from threadloom.llm import pii, pii_forms, pii_labels, pii_model, pii_train


@pytest.fixture(scope="module")
def model():
    return pii.tagger()


CASES = [
    ("I signed in as emric+logs@post.example.org and got a blank page.", {"email"}), ("The account is achterison50 @ example.com. The key is old.", {"email"}),
    ("Send the trace to silotti-kaspar (at) mail (dot) example when it is done.", {"email"}), ("cc https://sso.example/reset?user=corin_drossison%40mail.example, then close", {"email"}),
    ("text me at +49 30 23125 055 after the deploy", {"phone"}), ("Call 1-808-555-0161 if the run hangs.", {"phone"}), ("contact;(312) 555-0149;weekdays", {"phone"}),
    ("The form asks for it, mine is <SSN 976-23-5059>.", {"id_number"}), ("remove passport number X2102779 from the seed data", {"id_number"}), ("row 12: Steuer-ID 32 764 979 738;active;3", {"id_number"}),
    ("Ship the test device to 121 Ferrow Drive, Apt 38C, Altenbruch-Süd.", {"street_address"}), ("I live at Calle de Hollowell 125, 2.º B, 99301 Vallombre.", {"street_address"}),
    ("Thanks, Mira Mardakova", {"person_name"}), ("reviewed by Vellelund, Mira", {"person_name"}), ("SELKA ZANNENFELD asked for this change.", {"person_name"}), ("Ask A. Strandotti about the old parser.", {"person_name"}),
    ("Co-authored-by: Mira Strandanwe <mira.strandanwe@example.com>", {"person_name", "email"}),
    ("Clone git@forge.example:larkmoor/render.git first.", set()), ("Pin @driftwood/render@7.16.5 in the lock file.", set()), ("The Dalia theme and the Quill editor share one font.", set()),
    ("Commit aa2d5eaceb broke line 4966.", set()), ("Listen on 192.0.2.36:6638 instead.", set()), ("Build 2026.44.4617-rc3 is out.", set()), ("latitude 41.8078, longitude 32.3670", set()),
    ("Cold Lane, Warm Lane and Drive 7 are queue names.", set()), ("Bren Harbor is the 29th rehearsal of Project Larkspur.", set()), ("petra.rs imports halla.rs at line 2748.", set()),
]


@pytest.mark.parametrize(("text", "types"), CASES)
def test_cases(model, text, types):
    assert {m[2] for m in pii.found([text], model)[0]} == types


def test_long_texts_are_tagged_over_their_whole_length(model):
    filler = "The parser compares the default filter. " * 60
    text = filler + "Thanks, Mira Mardakova. " + filler + "Call 1-808-555-0161 if the run hangs. " + filler
    marks = pii.found([text], model)[0]
    assert [text[s:e] for s, e, _ in marks] == ["Mira Mardakova", "1-808-555-0161"]
    assert pii.redact(text, marks) == filler + "Thanks, [NAME]. " + filler + "Call [PHONE] if the run hangs. " + filler
    assert pii.found(["a" * 100_000], model) == [[]]


PLAIN = [
    ("write to bob@uni.edu now", ["bob@uni.edu"]), ("maria.gonzalez@acme.org", ["maria.gonzalez@acme.org"]), ("Ask John Smith about it", ["John Smith"]), ("Wei Chen wrote this", ["Wei Chen"]), ("by Pedro Almeida", ["Pedro Almeida"]),
    ("My SSN is SSN 078-05-1120.", ["SSN 078-05-1120"]), ("742 Evergreen Terrace, Springfield", ["742 Evergreen Terrace, Springfield"]), ("call 06 12 34 56 78", ["06 12 34 56 78"]), ("Visual Studio is slow", []), ("I use Visual Studio", []), ("The call id is call_0098075674 and the port is 2499.", []),
]


@pytest.mark.parametrize(("text", "values"), PLAIN)
def test_plain_forms(model, text, values):
    assert [text[s:e] for s, e, _ in pii.found([text], model)[0]] == values


def test_unseen_forms(model):
    """Names, words, domains, formats and sentences that training does not see, by whole spans."""
    for kind, (precision, recall) in pii_train.unseen(model, 1_500).items():
        assert (precision, recall) > ((0.9, 0.75) if kind == "person_name" else (0.97, 0)) and recall > (0.75 if kind == "person_name" else 0.95), kind


def test_held_out_forms_are_no_training_forms():
    forms = pii_forms
    for a, b in ((forms._GIVEN, forms._GIVEN_HELD), (forms._FAMILY, forms._FAMILY_HELD), (forms._PHONES, forms._PHONES_HELD), (forms._IDS, forms._IDS_HELD), (forms._SENTENCES, forms._SENTENCES_HELD), (forms._TOPS, forms._TOPS_HELD), (forms._STREETS, forms._STREETS_HELD)):
        assert not set(a) & set(b)


@pytest.mark.parametrize("copies", [2, 9, 400])
def test_windows_agree(model, copies):
    filler = "The parser compares the default filter. "
    text = "".join(filler * k + "Thanks, Mira Mardakova. " for k in range(copies if copies < 100 else 60)) * (1 if copies < 100 else 2)
    marks = pii.found([text, text[:-1], "short"], model)
    assert {text[s:e] for s, e, _ in marks[0]} == {"Mira Mardakova"} and len(marks[0]) == text.count("Mira") and marks[1] == marks[0]


def test_edges(model):
    assert pii.found([None, "", "  \n", "x", "é"], model) == [[], [], [], [], []]
    assert pii.found([], model) == []


def test_islands_give_the_viterbi_path(model):
    def plain(e, n):
        score, back = model.w["start"] + e[:, 0], []
        for t in range(1, n):
            best = score[:, None] + model.w["trans"]
            back.append(best.argmax(0))
            score = best.max(0) + e[:, t]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    texts = [t for t, _ in CASES]
    lengths = np.array([len(t) for t in texts])
    x = np.zeros((lengths.max() + lengths.max() % 2, len(texts)), np.uint8)
    for j, t in enumerate(texts):
        x[: len(t), j] = pii_model.encode(t)
    e, got = model.emissions(x), model.decode(x, lengths)
    for j, n in enumerate(lengths):
        assert list(got[j, :n]) == plain(e[:, :, j], n)


def test_gradient():
    rng = np.random.default_rng(0)
    w = pii_model.Tagger(pii_train.initial(5, rng)).w
    low = np.zeros(20, np.float32)
    low[15:] = -1
    lengths = np.array([9, 6])
    x, y = rng.integers(5, 100, (10, 2)), rng.integers(0, 11, (10, 2))
    for j, n in enumerate(lengths):
        x[n:, j] = y[n:, j] = 0
    _, g = pii_train.loss_and_gradient(w, x, y, lengths, low)
    for k in g:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        a, b = ({q: v.copy() for q, v in w.items()} for _ in "ab")
        a[k][i] += 1e-2
        b[k][i] -= 1e-2
        slope = (pii_train.loss_and_gradient(a, x, y, lengths, low)[0] - pii_train.loss_and_gradient(b, x, y, lengths, low)[0]) / 2e-2
        assert slope == pytest.approx(g[k][i], rel=0.03, abs=1e-4)


def test_agreement_with_labels_on_held_out_rows(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/basic_session.parquet").select("message.content").where("content IS NOT NULL").collect()
    texts = sorted({r.content for r in rows})
    both = found = wanted = 0
    for text, marks in zip(texts, pii.found(texts, model)):
        got, want = {m[2] for m in marks}, {pii_labels.TYPES[k] for _, _, k in pii_labels.label(text)}
        both, found, wanted = both + len(got & want), found + len(got), wanted + len(want)
    assert both >= 0.98 * found and both >= 0.98 * wanted and wanted > 100


def test_tables(spark):
    a = spark.createDataFrame([(1, ("u", "Thanks, Mira Mardakova"), "t"), (1, ("u", "Thanks, Mira Mardakova"), "t"), (2, None, "t"), (3, ("u", None), "t")], "row_id long, message struct<role:string,content:string>, src_table string")
    b = spark.createDataFrame([(1, ("Call 1-808-555-0161 now.",), "x")], "row_id long, payload struct<message:string>, text string")
    out = pii.tagged(pii.texts(a, b), redacted=True).collect()
    assert sorted((r.src_table, r.row_id, tuple(r.types), r.text) for r in out) == [("basic_session", 1, ("person_name",), "Thanks, [NAME]")] * 2 + [("new_format", 1, ("phone",), "Call [PHONE] now.")]
    assert pii.tagged(pii.texts(a.limit(0), b.limit(0))).count() == 0
