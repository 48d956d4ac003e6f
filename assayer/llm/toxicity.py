"""Toxicity by a classifier whose scores may not move when identity terms are swapped."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.labelled import remainder, sample
from assayer.llm.shared import table
from assayer.llm.words import text_chunks

#: Labelled documents used for fitting; documents and lower bound on the toxic share a feature needs.
ROWS, SUPPORT, PRECISION = 6000, 4, 0.35
#: Words of a sentence whose identity terms are swapped.
LONGEST = 200
#: Weight of the counterfactual penalty, of the ridge, and steps.
PENALTY, RIDGE, STEPS = 10.0, 0.02, 300
MODULUS, HELD_OUT, ACCEPT = 4, 2, 0.3
#: Identity terms that replace one another, by language.
IDENTITIES = (
    ("women", "men", "gay", "lesbian", "black", "white", "asian", "jewish", "muslim", "christian", "immigrant", "refugee", "disabled", "transgender", "mexican", "african"),
    ("frauen", "männer", "schwul", "schwarz", "weiß", "jüdisch", "muslimisch", "christlich", "ausländer", "flüchtling", "behindert"),
    ("femmes", "hommes", "noir", "blanc", "juif", "musulman", "chrétien", "immigré", "réfugié", "handicapé"),
    ("mujeres", "hombres", "negro", "blanco", "judío", "musulmán", "cristiano", "inmigrante", "refugiado"),
)
TERMS = frozenset(t for x in IDENTITIES for t in x)
WORD, SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[^.!?\n]+")


def features(word: str) -> list[str]:
    """A word, and its beginnings of three to six letters."""
    return [f"={word}", *(word[:n] for n in range(3, min(7, len(word) + 1)))]


def swaps(sentence: list[str]) -> list[list[str]]:
    """The sentence with each of its identity terms replaced by each other one of the term's list."""
    out = []
    for at, word in enumerate(sentence):
        for terms in IDENTITIES:
            if word in terms:
                out += [[*sentence[:at], other, *sentence[at + 1 :]] for other in terms if other != word]
    return out


def digest(text: str) -> tuple[list[str], list[str]]:
    """(distinct words, distinct sentences that name an identity) of a text, sorted: all that ``fit`` needs of it. A sentence
    of more than LONGEST words counts as several."""
    found, named = set(), set()
    for m in SENTENCE.finditer(text.lower()):
        words = (w.group() for w in WORD.finditer(m.group()))
        while own := list(islice(words, LONGEST)):
            found.update(own)
            if not TERMS.isdisjoint(own):
                named.add(" ".join(own))
    return sorted(found), sorted(named)


@dataclass
class Model:
    index: dict[str, int]
    weight: np.ndarray
    offset: float

    def scores(self, texts: list[bytes], cache: dict[str, tuple]) -> np.ndarray:
        out = np.full(len(texts), self.offset)
        for i, raw in enumerate(texts):
            known: set[int] = set()
            for w in {m.group() for m in WORD.finditer(raw.decode("utf-8", "replace").lower())}:
                own = cache.get(w)
                if own is None:
                    if len(cache) > 500_000:
                        cache.clear()
                    own = cache[w] = tuple(self.index[f] for f in features(w) if f in self.index)
                if own:
                    known.update(own)
            if known:
                out[i] += self.weight[sorted(known)].sum()
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _bound(k, n):
    """Wilson's lower bound, at 95 %, of a share of k in n; of numbers or columns."""
    p, z = k / n, 1.96
    return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)


def _selected(rows: list[set[str]], labels: np.ndarray) -> list[str]:
    """Features of at least SUPPORT toxic documents whose share of toxic ones is, at 95 %, above PRECISION."""
    toxic, all_ = Counter(), Counter()
    for row, y in zip(rows, labels, strict=True):
        all_.update(row)
        if y:
            toxic.update(row)
    return [f for f, k in toxic.items() if k >= SUPPORT and _bound(k, all_[f]) > PRECISION]


def _indexed(selected: list[str]) -> dict[str, int]:
    """Identity terms are features whether selected or not, so that what a corpus ties to them is seen and held even."""
    return {f: i for i, f in enumerate(sorted({*selected, *(f"={t}" for t in TERMS)}))}


def _of(words: Iterable[str], index: dict[str, int]) -> list[int]:
    """The features of words that the index has, in its order: sums of floats come out alike whatever order sets have."""
    return sorted({index[f] for w in words for f in features(w) if f in index})


def fit(rows: list[tuple[list[str], list[str], int]], penalty: float = PENALTY) -> Model:
    """``train`` on (words, identity sentences, label) of texts that are few enough to hold."""
    y = np.array([label for *_, label in rows], float)
    index = _indexed(_selected([{f for w in words for f in features(w)} for words, _, _ in rows], y))
    return train(index, [_of(words, index) for words, _, _ in rows], y, sorted({s for _, own, _ in rows for s in own}), penalty)


def train(index: dict[str, int], known: list[list[int]], y: np.ndarray, sentences: list[str], penalty: float = PENALTY) -> Model:
    """Logistic regression over the features present in texts, by gradient steps on log loss, a ridge, and the mean squared
    change of the logit (counterfactual logit pairing; Garg et al., 2019) between each labelled sentence that names an
    identity and the same with the term swapped for each other of its list.

    Without rows of both classes every text scores alike."""
    if len(set(y.tolist())) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Model({}, np.zeros(0), float(np.log(share / (1 - share))))
    pairs = [(_of(s.split(), index), _of(other, index)) for s in sentences for other in swaps(s.split())]

    def matrix(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(int), np.array([j for x in lists for j in x], int)

    (r, c), (ra, ca), (rb, cb) = matrix(known), matrix([a for a, _ in pairs]), matrix([b for _, b in pairs])
    n, k = len(y), len(index)
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    m, v, rate = np.zeros(k + 1), np.zeros(k + 1), 0.1
    for step in range(1, STEPS + 1):
        z = np.bincount(r, w[c], n) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(c, d[r], k) + RIDGE / n * w
        if pairs:
            gap = (np.bincount(ra, w[ca], len(pairs)) - np.bincount(rb, w[cb], len(pairs))) * 2 * penalty / len(pairs)
            g += np.bincount(ca, gap[ra], k) - np.bincount(cb, gap[rb], k)
        g = np.append(g, d.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(index, w, float(b))


def fit_sampled(sampled: DataFrame, penalty: float = PENALTY) -> Model:
    """``train`` on (doc_id, text, label), whose words stay with the executors: features are counted and selected there, and what reaches
    the driver is the selected ones, the places of those that each text has, and the distinct sentences that name an identity."""
    kind = sampled.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, labels in text_chunks(batches, 1):
            words, named = zip(*(digest(t.decode("utf-8", "replace")) for t in texts), strict=True)
            lists = [pa.array(x, pa.list_(pa.string())) for x in (words, named)]
            yield pa.RecordBatch.from_arrays([ids, labels, *lists], names=["doc_id", "label", "words", "named"])

    digests = table(sampled.mapInArrow(read, f"doc_id {kind}, label int, words array<string>, named array<string>"), "digests")
    starts = lambda w: F.transform(F.filter(F.lit([3, 4, 5, 6]), lambda n: n <= F.length(w)), lambda n: F.substring(w, F.lit(1), n))
    found = F.array_distinct(F.flatten(F.transform("words", lambda w: F.concat(F.array(F.concat(F.lit("="), w)), starts(w)))))
    counted = digests.select("label", F.explode(found).alias("feature")).groupBy("feature").agg(F.sum("label").alias("k"), F.count("*").alias("n"))
    chosen = counted.where((F.col("k") >= SUPPORT) & (_bound(F.col("k"), F.col("n")) > PRECISION)).select("feature")
    index = _indexed([r["feature"] for r in chosen.collect()])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [_of(words, index) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(at, pa.list_(pa.int32()))], names=["doc_id", "label", "at"])

    placed = digests.select("doc_id", "label", "words").mapInArrow(place, f"doc_id {kind}, label int, at array<int>").orderBy("doc_id", "label").toArrow()
    sentences = sorted(r["s"] for r in digests.select(F.explode("named").alias("s")).distinct().collect())
    return train(index, placed["at"].to_pylist(), placed["label"].to_numpy().astype(float), sentences, penalty)


def score(docs: DataFrame, labels: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT, rows: int = ROWS) -> DataFrame:
    """(doc_id, held_out boolean, score double) for each row of (doc_id, text), fitted on ``labels`` (doc_id, toxic).

    Whole texts are scored; null and empty ones by the intercept. Labels come from at most ``rows`` documents outside the
    held-out remainder; only the text goes into the score. A null doc_id is not held out. Repeated
    rows each come back; extra columns are ignored.
    """
    model = fit_sampled(sample(docs, labels, "toxic", modulus, held_out, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple] = {}
        for ids, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.scores(texts, cache))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "score")
