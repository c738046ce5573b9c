"""Subjects against a plain reading of the rule, hand-written sentences, held-out labels, and versions without each part."""

import re
import unicodedata

import pytest

from lookout.llm import q8_subjects, subjects


def fold(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def brute(sentence, terms, weight):
    """A sentence's raw sum by subject: every term tried at every place, terms inside longer ones left out."""
    words = re.findall(r"[a-z0-9]+", fold(sentence))
    spans = []
    for a in range(len(words)):
        for b in range(a + 1, min(len(words), a + 6) + 1):
            for i in terms.get(" ".join(words[a:b]), ()):
                spans.append((a, b, i))
    kept = {i for a, b, i in spans if not any(x <= a and b <= y and (y - x) > (b - a) for x, y, _ in spans)}
    sums = {}
    for i in kept:
        s = subjects.vocabulary()[i][0]
        sums[s] = sums.get(s, 0) + weight[i]
    return len(words), sums


PLAIN = [
    ("Light cannot escape a black hole once it has crossed the horizon.", "science"),
    ("We moved the service to Kubernetes last week.", "software"),
    ("The central bank left interest rates unchanged.", "finance"),
    ("A second dose of the vaccine is due in autumn.", "health"),
    ("Our cruise stopped at three islands.", "travel"),
    ("The shop offered me a full refund.", "retail"),
    ("The supermarket lowered its prices for fruit.", "retail"),
    ("Two defenders were sent off before the striker scored.", "sport"),
    ("The supreme court overturned the verdict.", "law"),
    ("Volunteers handed out soup and blankets to homeless people.", "charity"),
    ("Every pupil in the class wrote an essay about trees.", "education"),
    ("Geologists found a fossil in the upper layer.", "science"),
    ("Der Arzt schrieb ihr ein Rezept gegen Fieber.", "health"),
    ("El equipo ganó el partido y la copa.", "sport"),
    ("The compiler rejects this function because of a syntax error.", "software"),
    ("Wir haben den Flug und das Hotel gestern gebucht.", "travel"),
    ("Los alumnos aprueban el examen en la universidad.", "education"),
    ("She donated half of her prize to an orphanage.", "charity"),
    ("The plaintiff may appeal against the ruling.", "law"),
    ("Shares fell after the company reported a loss of revenue.", "finance"),
    ("Mix the flour with two eggs and some butter.", "other"),
    ("The curtains in the kitchen are blue.", "other"),
    ("He painted the fence on Saturday.", "other"),
    ("The record was played again, and the bank of the river was muddy.", "other"),
]


def test_plain_sentences(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PLAIN)] + [(100 + i, f"Nothing number {i} to report here.") for i in range(300)], "doc_id long, text string")
    got = {}
    for r in subjects.subject_areas(docs).collect():
        got.setdefault(r.doc_id, []).append(r.subject)
    assert {t: got[i] for i, (t, want) in enumerate(PLAIN) if got[i] != [want]} == {}


def test_scores_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = subjects.fitted(subjects.document_hits(docs))
    terms = {}
    for i, (_, _, t) in enumerate(subjects.vocabulary()):
        terms.setdefault(t, []).append(i)
    for sentence, _ in PLAIN:
        n, sums = brute(sentence, terms, model.weight)
        count, words, hits = subjects.term_hits(sentence)
        assert (count, words) == (1, n)
        got = model.scores(*hits[0]) if hits else {}
        assert got == pytest.approx({s: x * min(1.2, 1 / (0.6 + 0.4 * n / model.mean)) for s, x in sums.items()})


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/subject_labels.parquet")


def test_calibration_and_held_out_labels(labelled):
    limit, report = subjects.calibrate(*labelled)
    assert limit == subjects.thresholds()
    assert report["all"][1] > 0.95 and min(held for _, held in report.values()) > 0.9


def test_every_part_decides(spark):
    """Rarity, length and threshold each change the answer for a sentence with one term that mostly belongs to its subject."""
    model = lambda df, docs: subjects.rarity(df, docs)
    assert model(1, 10_000) == subjects.MOST_RARE > model(100, 10_000) > model(300, 10_000) > model(5_000, 10_000) == subjects.LEAST_RARE
    filler = [(100 + i, f"Nothing number {i} to report here.") for i in range(400)]
    short, long_ = "They met the umpire.", "They met the umpire on the way from the old house behind the hill to the place where the others had been waiting."
    judged = lambda rows, **k: {r.doc_id: r.subject for r in subjects.subject_areas(spark.createDataFrame(rows, "doc_id long, text string"), **k).where("doc_id < 100").collect()}
    assert judged([(1, short), (2, long_), *filler]) == {1: "sport", 2: "other"}  # length
    assert judged([(1, short), *[(200 + i, "The umpire left.") for i in range(300)], *filler]) == {1: "other"}  # rarity
    assert judged([(1, short), *filler], limit=dict.fromkeys(subjects.thresholds(), 1.1)) == {1: "other"}  # threshold


def test_batches_as_single_documents(spark, sf):
    hits = subjects.materialize(subjects.document_hits(spark.read.parquet(f"{sf}/documents.parquet")), "hits")
    model, want = subjects.fitted(hits), []
    for r in hits.collect():
        want += [(r.doc_id, s) for s in model.assigned(r.n_sentences, [(h.words, h.terms) for h in r.hits])]
    assert sorted(want) == sorted(map(tuple, q8_subjects.p8_found(spark, sf).collect()))


def test_cases(spark):
    text = "The court was busy all afternoon. They passed the test with interest."
    docs = spark.createDataFrame(
        [(1, None, "s"), (2, "", "s"), (3, " .. ​", "s"), (4, text, "s"), (5, "The M0RTGAGE was ﬁne. Die Förder­er kamen. Ein Satz. Noch einer. Und 5", "s"), (5, "A nurse. " * 30_000, "s"), (None, "A nurse.", "s"), (6, "the exam timetable", "s"), (7, "Seen on silent-dentist.example in June.", "s")],
        "doc_id long, text string, subject string",
    )
    got = sorted((str(r.doc_id), r.subject) for r in subjects.subject_areas(docs).collect())
    assert got == sorted([("4", "other"), ("5", "finance"), ("5", "charity"), ("5", "health"), ("None", "health"), ("6", "education"), ("7", "other")])
    assert subjects.subject_areas(docs.limit(0)).count() == 0


def test_queries(spark, sf):
    found = q8_subjects.p8_found(spark, sf).collect()
    assert {r.subject for r in found} <= {s for s, _, _ in subjects.vocabulary()} | {"other"}
    shares = q8_subjects.p8_composition(spark, sf).collect()
    assert sum(r.documents for r in shares) == len(set(found)) and all(0 < r.share <= 1 for r in shares)


def test_sentences():
    assert len(subjects.sentences('"We\'ve seen it twice," it says, "and now it was missing." A next one.\r\nA third  A fourth? About 3.5 units.')) == 3
    assert len(subjects.sentences("Start | Contact | house Then more follows. And what of it? Unas 9 veces.")) == 3
    assert len(subjects.sentences("Really? Yes. About time.")) == 3
