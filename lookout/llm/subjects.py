"""Subject areas of documents from curated weighted terms.

A multi-pattern automaton (Aho-Corasick) finds the terms of subject_terms.tsv (a parameter) in the normalized sentences
of a text. The list grades every term by hand: 1 for what belongs to one subject only, 0.6 for what mostly does, 0.3 for
a word of several meanings. A sentence's score for a subject is the sum of its different terms' weight times rarity
(:func:`rarity`, from document frequencies over all documents), normalized by the sentence's length against the corpus's
mean (:func:`length_norm`). A sentence deals with every subject whose score reaches that subject's threshold, calibrated
on hand labels (:func:`calibrate`, subject_thresholds.tsv): a word of several meanings never decides alone, a term that
mostly belongs to a subject does where it is rare enough and the sentence short enough. A document gets every subject
that reaches the share of its sentences, else ``other``.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.session import materialize, spread

_HERE = os.path.dirname(__file__)
TERMS = os.path.join(_HERE, "subject_terms.tsv")
#: subject and threshold, as calibrate() finds them on half of the labelled documents of sf0.1.
THRESHOLDS = os.path.join(_HERE, "subject_thresholds.tsv")
OTHER = "other"
#: The share of sentences that makes a subject of a document: TESTDATA's rule.
SHARE = 0.2
#: Rarity is 1 for a term of one document in a hundred and stays between these.
LEAST_RARE, MOST_RARE = 0.7, 1.25
#: Length normalization: how much a sentence's length counts (0: not at all), and the most that a short one gains.
SLOPE, MOST_NORM = 0.4, 1.2

_BROKEN = regex.compile(r"[ÂÃâÅ][\x80-\xbfŒœŠšŸŽžƒˆ˜–-›€™]{1,2}")
_HIDDEN = regex.compile(r"[\p{Cf}\p{Mn}\p{Cc}--[\t\n\r]]", regex.V1)
_DIGIT_IN_WORD = re.compile(
    r"[01](?:(?<=[^\W\d_][01])(?=[^\W\d_])|(?<=0)(?<![^\W_]0)(?=[^\W\d_])|(?<=1)(?<![^\W_]1)(?=[^\W\d_]{2})|(?<=[^\W\d_]{2}[01])(?![^\W_]))"
)
_LEGIBLE = re.compile(r"[^\W_]")
_WORD = re.compile(r"[^\W_]+")
#: Sentences end at line ends and at end marks with closing quotes before white space.
_MARK = re.compile("([.!?…][\"”“’'»)]{0,2})\\s+")
_LINES = re.compile(r"[\r\n\u2028\u2029]+")
#: A row of at least three items between bars ends after the first word behind its last bar.
_BARS = re.compile(r"(\|[^|\n]*\| \S+)\s+(?!\|)")
#: Host names, links and addresses say nothing of a subject: words joined by dots with a hyphen, digit, second dot or @.
_DOTTED = re.compile(r"[\w/]\.[^\W\d_]{2}|:/")
_HOST = re.compile(r"(?<!\S)(?:\S*(?:://|@|www\.)\S+|(?=\S*[-\d]|[^\s.]+\.[^\s.]+\.[^\s.])\W*[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w-]))")
#: A question and an answer that begins with a quantity (in any of the three languages) are one sentence.
_ANSWER = regex.compile(r"(?<=\?)\s+(?=(?:(?:about|around|roughly|nearly|almost|over|under|only|just|at least|up to|etwa|rund|circa|fast|nur|unos|unas|casi|solo|cerca de|alrededor de)\s+)?\p{N})", regex.IGNORECASE)
#: Endings of the last word of a term by language: the regular plurals and cases.
_ENDINGS = {"en": ("s", "es"), "de": ("e", "en", "n", "er", "s"), "es": ("s", "es")}


def _repaired(m: regex.Match) -> str:
    try:
        return m.group().encode("cp1252").decode("utf-8")
    except UnicodeError:
        return m.group()


def plain(text: str) -> str:
    """Lower case without accents, hidden characters, compatibility forms, broken encodings and digits read for letters."""
    if not text.isascii():
        text = _BROKEN.sub(_repaired, text)
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
    text = text.casefold()
    return _DIGIT_IN_WORD.sub(lambda m: "o" if m.group() == "0" else "l", text)


def sentences(text: str) -> list[str]:
    """The sentences of a text that hold a letter or digit. What goes before a row of links' end is only sought where there are bars."""
    if "?" in text:
        text = _ANSWER.sub("\x00", text)
    if "|" in text:
        text = _BARS.sub("\\1\n", text)
    return [s.replace("\x00", " ") for s in _LINES.split(_MARK.sub("\\1\n", text)) if _LEGIBLE.search(s)]


@cache
def vocabulary(path: str = TERMS) -> tuple[tuple[str, float, str], ...]:
    """(subject, weight, term in normal form), each term of a subject once, with its regular endings unless these are listed."""
    with open(path, encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f][1:]
    listed: dict[tuple[str, str], float] = {}
    grown: dict[tuple[str, str], float] = {}
    for subject, language, weight, terms in rows:
        for t in terms.split("; "):
            term = " ".join(_WORD.findall(plain(t)))
            listed[subject, term] = max(float(weight), listed.get((subject, term), 0.0))
            if len(term) > 3:
                more = [term + e for e in _ENDINGS.get(language, ())]
                if language == "en" and term[-1] == "y":
                    more.append(term[:-1] + "ies")
                for m in more:
                    grown[subject, m] = max(float(weight), grown.get((subject, m), 0.0))
    return tuple((s, w, t) for (s, t), w in sorted({**grown, **listed}.items()))


@cache
def thresholds(path: str = THRESHOLDS) -> dict[str, float]:
    with open(path, encoding="utf-8") as f:
        return {s: float(x) for s, x in (line.rstrip("\n").split("\t") for line in list(f)[1:])}


@cache
def automaton(path: str = TERMS) -> ahocorasick.Automaton:
    """Terms between spaces, over text whose words are joined by single spaces."""
    made: dict[str, list[int]] = {}
    for i, (_, _, term) in enumerate(vocabulary(path)):
        made.setdefault(f" {term} ", []).append(i)
    a = ahocorasick.Automaton()
    for term, numbers in made.items():
        a.add_word(term, (len(term), tuple(numbers)))
    a.make_automaton()
    return a


def _outer(spans: list[tuple[int, int, tuple[int, ...]]]) -> list[int]:
    """The terms of (start, -end, numbers) that don't lie within a longer one: the timetable of "exam timetable" is no journey's."""
    if len(spans) == 1:
        return list(spans[0][2])
    hits, reached = set(), 1
    for _, end, numbers in sorted(spans):  # by start, longest first: one lies within an earlier one if it ends no later
        if end < reached:
            hits.update(numbers)
            reached = end
    return sorted(hits)


def term_hits(text: str | None, path: str = TERMS) -> tuple[int, int, list[tuple[int, list[int]]]]:
    """The numbers of sentences and of words, and of each sentence that holds terms its number of words and the terms' numbers."""
    if not text or not _LEGIBLE.search(text):
        return 0, 0, []
    lines = [" ".join(_WORD.findall(_HOST.sub(" ", x) if _DOTTED.search(x) else x)) for x in sentences(plain(text))]
    # All sentences at once, each between blanks and a line end, which no term holds.
    joined, ends, at = " " + " \n ".join(lines) + " ", [], 0
    for x in lines:
        at += len(x) + 3
        ends.append(at)
    counts = [x.count(" ") + 1 for x in lines]
    # Hits come in order of their ends, so sentences come one after the other.
    found, spans, k = [], [], 0
    for end, (n, numbers) in automaton(path).iter(joined):
        if end - n + 1 >= ends[k]:
            if spans:
                found.append((counts[k], _outer(spans)))
                spans = []
            k = bisect_right(ends, end - n + 1)
        spans.append((end - n + 1, -end, numbers))
    if spans:
        found.append((counts[k], _outer(spans)))
    return len(lines), sum(counts), found


def rarity(df: int, docs: int) -> float:
    """1 for a term of one document in a hundred, more for rarer ones, less for commoner ones, in logarithms of the share."""
    return min(MOST_RARE, max(LEAST_RARE, math.log((docs + 1) / (df + 1)) / math.log(100)))


def length_norm(words: int, mean: float) -> float:
    """1 for a sentence of the corpus's mean length, less for a longer one (pivoted length normalization)."""
    return min(MOST_NORM, 1.0 / (1.0 - SLOPE + SLOPE * words / mean))


class Model:
    """What scoring needs: each term's subject and its weight times rarity, the mean length, the thresholds by subject."""

    def __init__(self, weight: list[float], subject: list[str], mean: float, limit: dict[str, float], share: float = SHARE):
        self.weight, self.subject, self.mean, self.limit, self.share = weight, subject, mean, limit, share

    def scores(self, words: int, terms: list[int]) -> dict[str, float]:
        """A sentence's score by subject."""
        sums: dict[str, float] = {}
        for t in terms:
            sums[self.subject[t]] = sums.get(self.subject[t], 0.0) + self.weight[t]
        norm = length_norm(words, self.mean)
        return {s: x * norm for s, x in sums.items()}

    def assigned(self, n: int, hits: list[tuple[int, list[int]]]) -> list[str]:
        """The subjects of a document of n sentences."""
        counts: dict[str, int] = {}
        for words, terms in hits:
            for s, x in self.scores(words, terms).items():
                if x >= self.limit[s]:
                    counts[s] = counts.get(s, 0) + 1
        return sorted(s for s, c in counts.items() if c >= self.share * n - 1e-9) or [OTHER]


    def assigned_rows(self, n_sentences: pa.Array, hits: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The same for a batch of documents at once: row numbers and subjects."""
        subjects = sorted(set(self.subject))
        place = {s: i for i, s in enumerate(subjects)}
        of_term, weight, limit = np.array([place[s] for s in self.subject]), np.array(self.weight), np.array([self.limit[s] for s in subjects])
        k, n = len(subjects), n_sentences.to_numpy(zero_copy_only=False)
        words, lists = hits.flatten().flatten()
        doc, sentence, term = (pc.list_parent_indices(hits).to_numpy(), pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy())
        sums = np.bincount(sentence * k + of_term[term], weights=weight[term], minlength=len(words) * k).reshape(len(words), k)
        norm = np.minimum(MOST_NORM, 1.0 / (1.0 - SLOPE + SLOPE * words.to_numpy() / self.mean))
        deals = sums * norm[:, None] >= limit
        counts = np.stack([np.bincount(doc, weights=deals[:, i], minlength=len(n)) for i in range(k)], axis=1) if k else np.zeros((len(n), 0))
        reached = counts >= self.share * n[:, None] - 1e-9
        alone = np.flatnonzero(~reached.any(axis=1))
        rows, which = np.nonzero(reached)
        named = [subjects[i] for i in which] + [OTHER] * len(alone)
        return pa.array(np.concatenate([rows, alone]), pa.int64()), pa.array(named, pa.string())


_HITS = "doc_id bigint, n_sentences int, n_words bigint, hits array<struct<words:int,terms:array<int>>>"


def document_hits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = TERMS) -> DataFrame:
    """Per row of ``docs`` what :func:`term_hits` finds; null, empty and illegible texts have no row."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, ns, ws, words, terms, sizes, hits = [], [], [], [], [], [0], [0]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, total, found = term_hits(t, path)
                if n:
                    ids.append(i)
                    ns.append(n)
                    ws.append(total)
                    for count, numbers in found:
                        words.append(count)
                        terms += numbers
                        sizes.append(len(terms))
                    hits.append(len(words))
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(terms, pa.int32()))
            sentences_ = pa.StructArray.from_arrays([pa.array(words, pa.int32()), lists], names=["words", "terms"])
            columns = [pa.array(ids, pa.int64()), pa.array(ns, pa.int32()), pa.array(ws, pa.int64()), pa.ListArray.from_arrays(pa.array(hits, pa.int32()), sentences_)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_sentences", "n_words", "hits"])

    return spread(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))).mapInArrow(batches, _HITS)


def fitted(hits: DataFrame, path: str = TERMS, limit: dict[str, float] | None = None, share: float = SHARE) -> Model:
    """The model for a corpus: rarity and mean length over all its documents. One number per term reaches the driver."""
    per_doc = hits.select(F.explode(F.array_distinct(F.flatten("hits.terms"))).alias("term")).groupBy("term").count()
    df = {r.term: r["count"] for r in per_doc.collect()}
    # The mean over documents of their own means, so that no document of very many sentences sets it.
    docs, mean = hits.agg(F.count(F.lit(1)), F.coalesce(F.round(F.avg(F.col("n_words") / F.col("n_sentences")), 3), F.lit(1.0))).first()
    listed = vocabulary(path)
    return Model([w * rarity(df.get(i, 0), docs) for i, (_, w, _) in enumerate(listed)], [s for s, _, _ in listed], mean, thresholds() if limit is None else limit, share)


def subject_areas(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = TERMS, limit: dict[str, float] | None = None, share: float = SHARE) -> DataFrame:
    """doc_id, subject: one row per subject of a document, ``other`` if it has none; illegible texts are no cases.

    Rows that repeat a doc_id are judged each on its own. An empty table gives an empty result.
    """
    hits = materialize(document_hits(docs, doc_id, text, path), "subject-hits")
    model = fitted(hits, path, limit, share)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, names = model.assigned_rows(b.column("n_sentences"), b.column("hits"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), names], names=["doc_id", "subject"])

    return hits.mapInArrow(batches, "doc_id bigint, subject string").withColumnRenamed("doc_id", doc_id)


#: Thresholds that calibrate() tries: from above what one word of several meanings can reach (0.3 * MOST_RARE * MOST_NORM).
GRID = tuple(round(0.46 + 0.02 * i, 2) for i in range(28))


def calibrate(docs: DataFrame, labels: DataFrame, bound: int = 20_000, path: str = TERMS, rare: bool = True, normed: bool = True) -> tuple[dict[str, float], dict[str, dict[str, tuple[float, float]]]]:
    """(thresholds by subject, F1 by subject and overall as (fitted half, held-out half)).

    At most ``bound`` labelled documents (those of smallest hash) are used; rarity and mean length come from all
    documents. Half of the labelled ones, by hash, fit: a subject's threshold lies a third (in logarithms) above
    the lower end of the longest run of grid values with the best F1 of its own labels: a decisive sentence's score has a
    long tail downwards. The other half is only measured. ``rare`` and ``normed`` switch rarity and
    length normalization off, to measure what they do.
    """
    clean = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where("subject is not null and subject <> ''").distinct()
    ids = clean.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(bound)
    all_hits = materialize(document_hits(docs, path=path), "subject-hits")
    model = fitted(all_hits, path, {})
    if not rare:
        model.weight = [w for _, w, _ in vocabulary(path)]
    if not normed:
        model.mean = float("inf")
    truth: dict[int, set] = {}
    for r in clean.join(ids, "doc_id", "left_semi").collect():
        truth.setdefault(r.doc_id, set()).add(r.subject)
    labelled = all_hits.join(ids, "doc_id", "left_semi").withColumn("_half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)))
    rows = []
    for r in labelled.collect():
        best: dict[str, list[float]] = {}
        for h in r.hits:
            for s, x in model.scores(h.words, h.terms).items():
                best.setdefault(s, []).append(x)
        # The share is reached if the k-th best sentence reaches the threshold.
        k = max(1, math.ceil(model.share * r.n_sentences - 1e-9))
        rows.append((r["_half"], truth[r.doc_id], {s: sorted(x, reverse=True)[k - 1] if len(x) >= k else 0.0 for s, x in best.items()}))

    def f1(half: int, subject: str, t: float) -> tuple[int, int, int]:
        right = said = wanted = 0
        for h, want, at in rows:
            if h == half:
                got = at.get(subject, 0.0) >= t
                right, said, wanted = right + (got and subject in want), said + got, wanted + (subject in want)
        return right, said, wanted

    limit, report = {}, {}
    total = [[0, 0, 0], [0, 0, 0]]
    score = lambda c: 2 * c[0] / max(1, c[1] + c[2])
    for subject in sorted({s for s, _, _ in vocabulary(path)}):
        fits = [score(f1(0, subject, t)) for t in GRID]
        runs, top = [], max(fits)
        for i, x in enumerate(fits):
            if x == top:
                if runs and runs[-1][-1] == i - 1:
                    runs[-1].append(i)
                else:
                    runs.append([i])
        run = max(runs, key=len)
        limit[subject] = round(GRID[run[0]] ** (2 / 3) * GRID[run[-1]] ** (1 / 3), 2)
        for half in (0, 1):
            for j, x in enumerate(f1(half, subject, limit[subject])):
                total[half][j] += x
        report[subject] = tuple(score(f1(half, subject, limit[subject])) for half in (0, 1))
    report["all"] = tuple(score(t) for t in total)
    return limit, report
