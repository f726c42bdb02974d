"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, maps homoglyphs and fullwidth forms to Latin letters, and turns digits and signs inside words into the letters
they stand for. The folded text is its words between single blanks; a word with accents stands there with and without them, as accents
tell words of some languages apart and disguise those of others.

The lexicon holds whole words (" w ") and beginnings of words (" w"). A few fixed terms are always in it; the others are learned from
labelled rows: terms found in significantly more toxic than clean documents are candidates, and a greedy cover keeps one only
while it still explains toxic documents that no kept term explains, so that the words of a toxic document copied many
times do not enter. Its weight is the log ratio of its rates. Phrases of two words around a term that clean documents have and
toxic ones don't become exceptions, beside the fixed ones: such a hit counts nothing.

A document's score is a logistic function of the logarithms of its summed weights and of their density, the same sum divided by the length. It is
fitted on the same rows.

Labelled rows are joined to texts as a bounded sample (``max_labelled``, in the order of a hash of doc_id), the only thing here
that is broadcast besides the lexicon. All its significant terms reach the cover, and all its exceptions the lexicon. Repeated texts count once.

Null, empty and wordless texts have no hits and get the score of a clean document. Repeated rows get a row each. Labels that are null are ignored;
of several labels of a doc_id the highest counts, of several texts the one with the smallest hash. Without labelled toxic rows, and where no term is
significant, only the fixed terms are used. An empty table
gives an empty result. Columns beyond those named are ignored, or kept by ``without_toxic``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heapreplace
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetables.llm.base import Steps, column, held_out, slices, text_key

# fixed values: insults that are in every lexicon
BASE_TERMS = ["idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "imbecile"]
# fixed values: phrases in which such a word insults nobody
BASE_EXCEPTIONS = ["trash can", "trash bin", "trash bag", "clown fish", "pond scum", "soap scum", "loser bracket"]
# fixed values: letters that look like Latin ones
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i",
              "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ɩ": "i", "ı": "i", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
              "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w"}
# fixed values: digits and signs that stand for letters inside words
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

BASE_WEIGHT = 6.0
MAX_LABELLED = 20_000
PREFIXES = (4, 5, 6)
SIGNIFICANT = 30.0       # likelihood ratio statistic
MIN_RATIO = 4              # of the rates of a term in toxic and clean documents
SHORT = 30                 # words added to each text, so that one weak term does not decide on a text of a few words
THRESHOLD = 0.7

_letters = str.maketrans({**HOMOGLYPHS, "ß": "ss"})
_digits = str.maketrans(SUBSTITUTES)
_marks = re.compile("[\u0300-\u036f]")
_words = re.compile(r"[^\W\d_]+")


def accented(text: str | None) -> list[str]:
    """The folded words of a text, with their accents."""
    if not text:
        return []
    t = text.lower()
    if not t.isascii():
        t = _marks.sub("", unicodedata.normalize("NFKC", t.translate(_letters)))
    if any(c in t for c in SUBSTITUTES):
        t = " ".join(_decode(x) for x in t.split())
    return _words.findall(t)


@lru_cache(1 << 16)
def _bare(word: str) -> str:
    return "".join(_words.findall(_marks.sub("", unicodedata.normalize("NFKD", word))))


def bare(word: str) -> str:
    """A folded word without its accents."""
    return word if word.isascii() else _bare(word)


def fold(text: str | None) -> list[str]:
    """The folded words of a text, without accents."""
    return [bare(w) for w in accented(text)]


def spellings(words: list[str]) -> tuple[list[str], list[int]]:
    """What terms are looked for in: each word, and after one with accents the same without; and which word each belongs to."""
    out, of = [], []
    for i, w in enumerate(words):
        out.append(w)
        of.append(i)
        if (b := bare(w)) != w:
            out.append(b)
            of.append(i)
    return out, of


def _decode(token: str) -> str:
    """Letters for the digits and signs within a word that has letters; signs at its ends are no part of it."""
    core = token.strip("$@")
    return core.translate(_digits) if any(c.isalpha() for c in core) else core


def features(words: list[str]) -> set[str]:
    """Terms a document may add to a lexicon: its words, and the beginnings of the longer ones."""
    out = set()
    for w in set(spellings(words)[0]):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIXES if len(w) > n)
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    model: tuple[float, float, float] = (-4.0, 2.5, 0.3)      # of a constant, log(1 + weight), log(1 + weight per 100 words)
    _machine: ahocorasick.Automaton | None = None

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for term, w in self.weights.items():
                self._machine.add_word(term, (term, w))
            self._machine.make_automaton()
        return self._machine

    def hits(self, words: list[str]) -> list[tuple[int, str, float]]:
        """(word, term, weight): for each word with a term, the heaviest one, unless an exception phrase holds the word."""
        if not words or not self.weights:
            return []
        spelled, of = spellings(words)
        text = " " + " ".join(spelled) + " "
        best: dict[int, tuple[float, str]] = {}
        for end, (term, w) in self.machine().iter(text):
            start = end - len(term) + 1
            if w > best.get(start, (0.0, ""))[0]:
                best[start] = (w, term)
        out = []
        if best:
            number = {}
            at = 0
            for i, w in zip(of, spelled):
                number[at] = i
                at += len(w) + 1
            heaviest: dict[int, tuple[float, str]] = {}
            for start, found in best.items():
                heaviest[number[start]] = max(found, heaviest.get(number[start], found))
            for i, (w, term) in sorted(heaviest.items()):
                if not any(p in self.exceptions for p in phrases(words, i)):
                    out.append((i, term, w))
        return out

    def inputs(self, words: list[str], hits: list | None = None) -> tuple[float, float]:
        total = sum(w for _, _, w in (self.hits(words) if hits is None else hits))
        return log(1 + total), log(1 + 100 * total / (SHORT + len(words)))

    def score(self, words: list[str], hits: list | None = None) -> float:
        a, b = self.inputs(words, hits)
        z = self.model[0] + self.model[1] * a + self.model[2] * b
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def phrases(words: list[str], i: int) -> list[str]:
    """The word with its neighbour before and after it, without accents."""
    near = [bare(w) for w in words[max(i - 1, 0):i + 2]]
    return [" ".join(near[:2])] * (i > 0) + [" ".join(near[-2:])] * (i + 1 < len(words))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int) -> DataFrame:
    """(text, y) of at most ``max_labelled`` labelled documents outside the test fold, each text once."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")) \
        .filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    few = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("k"), "text").join(F.broadcast(few), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("k", "y", "text")).alias("r")).select("r.*")      # so that rows are bounded as well as ids
    return one.groupBy("k").agg(F.max(F.struct("y", "text")).alias("r")).select("r.text", "r.y")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean) document counts of a task, and under a null term the number of documents."""
    for part in slices(batches, "text"):
        counts = (Counter(), Counter())
        n = [0, 0]
        for t, y in zip(column(part, "text").to_pylist(), column(part, "y").to_pylist()):
            counts[y != 0].update(features(accented(t)))
            n[y != 0] += 1
        terms = list(counts[0] | counts[1])
        yield pa.record_batch({"term": pa.array(terms + [None], pa.string()), "toxic": pa.array([counts[1][t] for t in terms] + [n[1]], pa.int64()),
                               "clean": pa.array([counts[0][t] for t in terms] + [n[0]], pa.int64())})


def _ratio_statistic(toxic: str, clean: str, n_toxic: int, n_clean: int):
    """Likelihood ratio statistic of a term's document counts against equal rates."""
    t, c = F.col(toxic), F.col(clean)
    p = (t + c) / F.lit(n_toxic + n_clean)
    part = lambda k, e: F.when((k > 0) & (e > 0), k * F.log(k / e)).otherwise(0.0)
    return 2 * (part(t, p * n_toxic) + part(c, p * n_clean) + part(F.lit(n_toxic) - t, (1 - p) * n_toxic) + part(F.lit(n_clean) - c, (1 - p) * n_clean))


def _found(lexicon: Lexicon, number: dict[str, int]):
    """The numbers of the terms in each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for t in column(part, "text").to_pylist():
                text = " " + " ".join(spellings(accented(t))[0]) + " "
                rows.append(sorted({number[term] for _, (term, _) in lexicon.machine().iter(text)}))
            yield pa.record_batch({"found": pa.array(rows, pa.list_(pa.int32()))})
    return run


def _around(lexicon: Lexicon):
    """The phrases around the hits of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = map(accented, column(part, "text").to_pylist())
            rows = [sorted({p for i, _, _ in lexicon.hits(w) for p in phrases(w, i)}) for w in words]
            yield pa.record_batch({"around": pa.array(rows, pa.list_(pa.string()))})
    return run


def _log_ratio(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    return log((toxic + 0.5) / (n_toxic + 1)) - log((clean + 0.5) / (n_clean + 1))


def _cover(found: list[np.ndarray], terms: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> list[str]:
    """Terms in the order of how much they say about toxic documents that no earlier one explains, while that is significant.

    ``found`` has the numbers of the terms of each document. What a term explains only shrinks, so the last value of those further down bounds theirs.
    """
    names, rates = list(terms), [_log_ratio(*c, n_toxic, n_clean) for c in terms.values()]
    doc = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
    number = np.concatenate(found) if found else np.zeros(0, np.int32)
    doc = doc[np.argsort(number, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(names)))])
    open_, text_order = np.ones(len(found), bool), {t: i for i, t in enumerate(sorted(names))}
    # of terms that explain as many, a whole word says more than a beginning
    entry = lambda k, n: (-n * rates[k], not names[k].endswith(" "), -len(names[k]), -text_order[names[k]], n, k)
    heap = [entry(k, int(first[k + 1] - first[k])) for k in range(len(names)) if first[k + 1] > first[k]]
    heapify(heap)
    kept = []
    while heap:
        *_, n, k = heap[0]
        mine = doc[first[k]:first[k + 1]]
        now = int(open_[mine].sum())
        if now < n:
            heapreplace(heap, entry(k, now)) if now else heappop(heap)
            continue
        if n * log(max(n_toxic + n_clean, 2) / max(n_toxic, 1)) * 2 < SIGNIFICANT:
            break
        heappop(heap)
        kept.append(names[k])
        open_[mine] = False
    return kept


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Lexicon:
    steps = Steps(docs.sparkSession, "toxicity")
    sample = steps.keep(labelled_sample(docs, labels, label, max_labelled), "sample")
    counts = steps.keep(sample.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "terms")
    n = counts.filter("term IS NULL").first()
    n_toxic, n_clean = (int(n.toxic), int(n.clean)) if n else (0, 0)
    weights = {f" {t} ": BASE_WEIGHT for t in BASE_TERMS}
    if not n_toxic or not n_clean:
        return Lexicon(weights, set(BASE_EXCEPTIONS))
    statistic = _ratio_statistic("toxic", "clean", n_toxic, n_clean)
    strong = counts.filter(F.col("term").isNotNull() & (F.col("toxic") * n_clean > MIN_RATIO * F.col("clean") * n_toxic)).withColumn("s", statistic) \
        .filter(F.col("s") >= SIGNIFICANT).orderBy("term").collect()
    terms = {r.term: (r.toxic, r.clean) for r in strong}
    rate = lambda t: _log_ratio(*terms[t], n_toxic, n_clean)
    if terms:
        wide = Lexicon({t: rate(t) for t in terms}, set())
        toxic_docs = sample.filter("y <> 0").mapInArrow(_found(wide, {t: i for i, t in enumerate(terms)}), "found array<int>").toArrow()["found"]
        kept = _cover([f.values.to_numpy() for f in toxic_docs], terms, n_toxic, n_clean)
        weights |= {t: rate(t) for t in kept}
    lexicon = Lexicon(weights, set(BASE_EXCEPTIONS))
    around = sample.filter("y = 0").mapInArrow(_around(lexicon), "around array<string>") \
        .select(F.explode("around").alias("p")).groupBy("p").agg(F.count("*").alias("n")).filter("n >= 3")
    common = {r.p for r in around.collect()}
    if common:
        toxic_too = sample.filter("y <> 0").mapInArrow(_phrases_of(common), "p string").distinct().collect()
        lexicon.exceptions |= common - {r.p for r in toxic_too}
    points = sample.mapInArrow(_inputs(lexicon), "a double, b double, y double").groupBy("a", "b", "y").agg(F.count("*").alias("n"))
    lexicon.model = _fit(np.array([[r.a, r.b, r.y, r.n] for r in points.collect()]))
    return lexicon


def _phrases_of(wanted: set[str]):
    def run(batches):
        for part in slices(batches, "text"):
            found = set()
            for t in column(part, "text").to_pylist():
                words = fold(t)
                found |= wanted & {" ".join(words[i:i + 2]) for i in range(len(words) - 1)}
            yield pa.record_batch({"p": pa.array(sorted(found), pa.string())})
    return run


def _inputs(lexicon: Lexicon):
    def run(batches):
        for part in slices(batches, "text"):
            rows = [lexicon.inputs(accented(t)) for t in column(part, "text").to_pylist()]
            yield pa.record_batch({"a": pa.array([r[0] for r in rows], pa.float64()), "b": pa.array([r[1] for r in rows], pa.float64()),
                                   "y": pa.array([float(y != 0) for y in column(part, "y").to_pylist()], pa.float64())})
    return run


def _fit(points: np.ndarray, ridge: float = 0.5) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; slopes are kept from falling below zero."""
    x = np.column_stack([np.ones(len(points)), points[:, 0], points[:, 1]])
    y, n = points[:, 2], points[:, 3]
    use = [0, 1, 2]
    while True:
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (n * (y - p)) - ridge * np.array([0.01, 1, 1]) * w
            h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.diag([0.01, 1, 1])
            step = np.zeros(3)
            step[use] = np.linalg.solve(h[np.ix_(use, use)], g[use])
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        bad = [i for i in use[1:] if w[i] < 0]
        if not bad:
            return float(w[0]), float(w[1]), float(w[2])
        use.remove(min(bad, key=lambda i: w[i]))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score and the hits (term, weight) of each row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            scores, hits = [], []
            for t in column(part, "text").to_pylist():
                words = accented(t)
                found = shared.value.hits(words)
                scores.append(shared.value.score(words, found))
                hits.append([{"term": term.strip(), "weight": w} for _, term, w in found])
            kind = pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64())]))
            yield pa.record_batch({"doc_id": column(part, "doc_id"), "score": pa.array(scores, pa.float64()), "hits": pa.array(hits, kind)})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, hits array<struct<term:string,weight:double>>")


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all its columns, without the rows whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield part.filter(pa.array([shared.value.score(accented(t)) < threshold for t in column(part, "text").to_pylist()], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
