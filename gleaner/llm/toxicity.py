"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their prefixes of 4 to 6 characters (so that inflected forms of one stem meet), hashed
to numbers. The machine adds a weight for each term present and, through ``RANK`` factors per term, a weight for each
pair of terms present, which an additive model cannot learn: an insult next to the mention of a group, say.

It is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` of each class, those of least hash), whose terms go to
the driver; only terms whose presence differs significantly between the classes get weights. Scoring is a narrow map with
the model in a broadcast; it never grows beyond the terms of the sample.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import with_columns_from_text

#: Labelled rows of each class that are used at most.
SAMPLE_ROWS = 6_000
RANK = 4
HASH_BITS = 24
PREFIXES = (4, 5, 6)
#: Least log-likelihood ratio (G squared) and least documents of a term in the model.
MIN_RATIO, MIN_DOCUMENTS = 12.0, 3
EPOCHS, BATCH, STEP = 40, 256, 0.3
#: Penalties of weights and of factors.
DECAY, FACTOR_DECAY = 1e-5, 1e-2
THRESHOLD = 0.3
#: Words whose place in the model a worker remembers.
REMEMBERED = 500_000

_WORD = re.compile(r"\w+")

SCHEMA = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def hashed_terms(word: str) -> list[int]:
    """The numbers of a lower-cased word's terms."""
    mask = (1 << HASH_BITS) - 1
    out = [zlib.crc32(b"w" + word.encode("utf-8", "replace")) & mask]
    out += [zlib.crc32(b"p" + word[:n].encode("utf-8", "replace")) & mask for n in PREFIXES if len(word) >= n]
    return out


def document_terms(text: str | None) -> np.ndarray:
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.array([t for w in words for t in hashed_terms(w)], np.uint32))


@dataclass
class Machine:
    """Terms (sorted), their weights and factors, and the intercept."""

    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    intercept: float

    def __post_init__(self):
        self.place = {int(t): i for i, t in enumerate(self.terms)}
        self.memory: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.terms, self.weights, self.factors, self.intercept

    def __setstate__(self, state):
        self.__init__(*state)

    def raw(self, owner: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Scores before the logistic function, of ``n`` rows whose (row, place) pairs are given, sorted by row."""
        linear = np.bincount(owner, self.weights[at], n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            pairs += np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n)
        return self.intercept + linear + pairs / 2

    def scores(self, texts) -> np.ndarray:
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        memory, place = self.memory, self.place
        owner, at = [], []
        for row, text in enumerate(texts):
            mine: set[int] = set()
            for word in set(_WORD.findall(text.lower())):
                known = memory.get(word)
                if known is None:
                    known = memory[word] = tuple(place[t] for t in hashed_terms(word) if t in place)
                if known:
                    mine.update(known)
            owner += [row] * len(mine)
            at += sorted(mine)
        raw = self.raw(np.array(owner, np.int64), np.array(at, np.int64), len(texts))
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def _ratio(in_one: np.ndarray, ones: float, in_zero: np.ndarray, zeros: float) -> np.ndarray:
    """G squared of the two-by-two table of presence and class."""
    total = np.zeros(len(in_one))
    share = (in_one + in_zero) / (ones + zeros)
    for seen, n in ((in_one, ones), (in_zero, zeros)):
        for count, expected in ((seen, n * share), (n - seen, n * (1 - share))):
            total += np.where(count > 0, count * np.log(np.maximum(count, 1e-12) / np.maximum(expected, 1e-12)), 0)
    return 2 * total


def train(rows: list[np.ndarray], labels: np.ndarray, sizes: tuple[int, int] | None = None, seed: int = 7) -> Machine:
    """A machine from sampled rows (their terms) and labels; ``sizes`` are the whole classes' (0, 1) row counts, to
    which the sampled classes are weighted. Without rows of both classes it predicts the prior alone."""
    ones = int(labels.sum())
    zeros = len(labels) - ones
    n0, n1 = sizes or (zeros, ones)
    prior = (n1 + 0.5) / (n0 + n1 + 1)
    intercept = float(np.log(prior / (1 - prior)))
    empty = Machine(np.empty(0, np.uint32), np.empty(0), np.empty((0, RANK)), intercept)
    if not ones or not zeros:
        return empty
    # Counts by sorting alone; places are looked up for the few chosen terms only, which keeps the driver's memory small.
    terms, in_all = np.unique(np.concatenate(rows), return_counts=True)
    seen, times = np.unique(np.concatenate([r for r, y in zip(rows, labels) if y]), return_counts=True)
    in_one = np.zeros(len(terms))
    in_one[np.searchsorted(terms, seen)] = times
    chosen = (_ratio(in_one, ones, in_all - in_one, zeros) >= MIN_RATIO) & (in_all >= MIN_DOCUMENTS)
    terms = terms[chosen]
    if not len(terms):
        return empty
    places = []
    for row in rows:
        found = np.minimum(np.searchsorted(terms, row), len(terms) - 1)
        places.append(found[terms[found] == row])
    owner, at = np.repeat(np.arange(len(rows)), [len(p) for p in places]), np.concatenate(places)
    n_terms = len(terms)
    rng = np.random.default_rng(seed)
    machine = Machine(terms, np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, RANK)), intercept)
    weight = np.where(labels == 1, n1 / ones, n0 / zeros)
    weight = weight / weight.mean()
    first = np.searchsorted(owner, np.arange(len(rows) + 1))
    # Adagrad: each parameter's steps shrink with the gradients it has seen.
    seen_w, seen_v, seen_b = np.full(n_terms, 1e-8), np.full((n_terms, RANK), 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            batch = order[start : start + BATCH]
            counts = first[batch + 1] - first[batch]
            local = np.repeat(np.arange(len(batch)), counts)
            skip = np.repeat(first[batch] - np.append(0, np.cumsum(counts)[:-1]), counts)
            mine = at[np.arange(len(local)) + skip]
            raw = machine.raw(local, mine, len(batch))
            error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[batch]) * weight[batch] / len(batch)
            touched, back = np.unique(mine, return_inverse=True)
            gw = np.bincount(back, error[local], len(touched)) + DECAY * machine.weights[touched]
            seen_w[touched] += gw**2
            v = machine.factors[mine]
            sums = np.stack([np.bincount(local, v[:, f], len(batch)) for f in range(RANK)], 1)
            pull = error[local][:, None] * (sums[local] - v)
            gv = np.stack([np.bincount(back, pull[:, f], len(touched)) for f in range(RANK)], 1)
            gv += FACTOR_DECAY * machine.factors[touched]
            seen_v[touched] += gv**2
            machine.weights[touched] -= STEP * gw / np.sqrt(seen_w[touched])
            machine.factors[touched] -= STEP * gv / np.sqrt(seen_v[touched])
            gb = error.sum()
            seen_b += gb**2
            machine.intercept -= STEP * gb / np.sqrt(seen_b)
    return machine


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Machine:
    """Fits on at most ``sample_rows`` labelled rows of each class, chosen by the hash of their id among the rows where
    ``usable`` (a condition on ``doc_id``) holds. Only ids and labels are sorted for the choice, and only the chosen
    documents' terms reach the driver. Null ids and labels are left out; a document labelled twice counts once."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
    )
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [document_terms(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], ["label", "terms"])

    sampled = rows.mapInArrow(terms, "label int, terms binary").collect()
    # In the order of their content, so that a fit doesn't depend on how the rows arrived.
    sampled.sort(key=lambda r: (r["label"], bytes(r["terms"])))
    return train(
        [np.frombuffer(r["terms"], np.uint32) for r in sampled],
        np.array([r["label"] for r in sampled], np.int64),
        (sizes.get(0, 0), sizes.get(1, 0)),
    )


def score(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` (probability of the label 1, of the whole text) and ``predicted``.

    Null and empty texts, and texts without a known term, get the score of the intercept; repeated rows are
    independent; an empty table stays empty; columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def rows_of(texts):
        return [(float(s), int(s >= threshold)) for s in shared.value.scores(texts)]

    return with_columns_from_text(docs, rows_of, SCHEMA, text)
