"""Benchmark decontamination: a broadcast set of normalised test n-grams against the token windows of each document.

The test side is turned into windows of word numbers (numbered by the benchmark's own vocabulary). A document's words
are mapped to those numbers, a rolling hash over the numbers finds candidate windows in the broadcast set, and every hit
is verified word by word before its words count.

The broadcast holds one block of test items whose texts are at most ``BLOCK_BYTES`` long together. A larger benchmark is
cut into such blocks, and the documents pass through one narrow map after the other, so that nothing grows beyond the
bound and nothing is shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import ASCII_LOWER, WORD, batched, unused

WINDOW = 13
#: Contaminated: hit words are at least one in so many.
ONE_IN = 20
#: Bytes of test texts that are broadcast together.
BLOCK_BYTES = 32 << 20

_WORD = re.compile(WORD)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(ASCII_LOWER))


def _hashes(numbers: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every run of ``length`` numbers, by doubling; numbers are from 0 on."""
    base = numbers.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    out, done, power, size = None, 0, base, 1
    left = length
    while left:
        if left & 1:
            if out is None:
                out, done = power, size
            else:
                n = len(power) - done
                out = out[:n] * np.uint64(pow(int(_MULTIPLIER), size, 1 << 64)) + power[done : done + n]
                done += size
        left >>= 1
        if left:
            power = power[:-size] * np.uint64(pow(int(_MULTIPLIER), size, 1 << 64)) + power[size:]
            size *= 2
    return out[: len(numbers) - length + 1]


class Windows:
    """The windows of a block of test items, by length."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.numbers: dict[str, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)]
            if not ids:
                continue
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                # Items without an id have windows, but no name to report.
                found.setdefault(tuple(ids[i : i + size]), set()).update([] if item_id is None else [item_id])
        self.by_length: dict[int, tuple[np.ndarray, dict[tuple[int, ...], set[str]]]] = {}
        for length in sorted({len(k) for k in found}):
            own = {k: v for k, v in found.items() if len(k) == length}
            keys = _hashes(np.array([x for k in own for x in k]), length)[::length]
            self.by_length[length] = (np.unique(keys), own)

    def hits(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of ``text``, its hit places (start, end) and the items they belong to."""
        words = words_of(text)
        get = self.numbers.get
        numbers = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(numbers >= 0)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not len(known):
            return len(words), spans, items
        # Only runs of known words can hold a window.
        cuts = np.flatnonzero(np.diff(known) != 1) + 1
        for run in np.split(known, cuts):
            start, size = int(run[0]), len(run)
            own = numbers[start : start + size]
            for length, (keys, windows) in self.by_length.items():
                if size < length:
                    break
                found = _hashes(own, length)
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                for i in np.flatnonzero(keys[at] == found).tolist():
                    named = windows.get(tuple(own[i : i + length].tolist()))
                    if named is not None:
                        spans.append((start + i, start + i + length))
                        items |= named
        return len(words), spans, items


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Union of the places as a flat list: start, end, start, end …"""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark in blocks of at most ``block_bytes`` of text (or one longer item), one on the driver at a time."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where(
        F.col("text").isNotNull()
    )
    block: list[tuple[str | None, str]] = []
    size = 0
    for row in rows.toLocalIterator(prefetchPartitions=False):
        length = len(row["text"].encode())
        if block and size + length > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["item"], row["text"]))
        size += length
    yield block


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    one_in: int = ONE_IN,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds ``n_words``, ``spans`` (hit word ranges: start, end, …), ``items`` (sorted ids of the items whose windows
    occur), ``n_hit`` (words inside a hit) and ``contaminated`` (hits, and at least one word in ``one_in`` is hit).

    Null and empty texts have no words and are clean; items without words have no window; items without id still hit,
    unnamed; repeated items count once; an empty benchmark marks nothing; repeated document rows are independent;
    columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    made = docs
    marked = unused(docs, "__marked")
    chained = False
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block, window))
        before = [F.col(marked)] if chained else []
        made = made.withColumn(marked, _scan(shared, chained)(F.col(text), *before))
        chained = True
    new = ["n_words", "spans", "items", "n_hit", "contaminated"]
    keep = [c for c in docs.columns if c.lower() not in new]
    m = F.col(marked)
    n_hit = F.aggregate(
        F.transform(m["spans"], lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    out = made.select(*[made[f"`{c}`"] for c in keep], m["n_words"].alias("n_words"), m["spans"].alias("spans"), m["items"].alias("items"), n_hit.alias("n_hit"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


#: The windows of the block that a worker met last.
_BUILT: dict[str, Windows] = {}


def _scan(shared, chained: bool):
    def windows() -> Windows:
        name, items, window = shared.value
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Windows(items, window)
        return _BUILT[name]

    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = windows()
        for batch in batches:
            yield _struct([known.hits(t) for part in batched(batch) for t in part], None)

    def further(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = windows()
        for batch, before in batches:
            yield _struct([known.hits(t) for part in batched(batch) for t in part], before.to_pylist())

    if chained:
        further.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
        return F.arrow_udf(further, _STATE)
    first.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(first, _STATE)


def _struct(found: list, before: list | None) -> pa.StructArray:
    n_words, spans, items = [], [], []
    for i, (n, places, named) in enumerate(found):
        if before is not None:
            flat = before[i]["spans"]
            places = places + list(zip(flat[::2], flat[1::2]))
            named = named | set(before[i]["items"])
        n_words.append(n)
        spans.append(merged(places))
        items.append(sorted(named))
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
        names=["n_words", "spans", "items"],
    )


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    # A left column of the marks could clash with a column of the documents, so the marks go into fresh names.
    held = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)], docs["text"].alias("text"))
    kept = mark(held, benchmark, **settings).where(~F.col("contaminated"))
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
