"""Embedding of section texts and exact vector retrieval."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import lexicons as lx
from gleaner.functions import similarity
from gleaner.functions import text as tx
from gleaner.sources import vector_store

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]
SECTION_KEY = ("doc_ord", "section_ord", "chunk_index")
#: Query vectors that are broadcast together.
QUERY_BLOCK = 20_000
#: Query vectors and stored vectors of a tile: its scores stay in a core's cache while they are summed.
QUERY_TILE, STORED_TILE = 128, 512


def embedding_text(
    retrieval: str = "retrieval_text", project: str = "project", title: str = "title", content: str = "content"
) -> Column:
    """The retrieval text, else project, title and content, whole."""
    parts = F.concat_ws("\n", *[tx.text_or_empty(c) for c in (project, title, content)])
    return F.when(tx.text_or_empty(retrieval) != "", F.col(retrieval)).otherwise(parts)


def hashed_embedder(width: int = 64) -> Embedder:
    """Stand-in model: mean of hashed word features, scaled to unit length. Needs no model file.

    Where the signs of a text's words cancel each other out, they are left away, so only a text without words is zero.
    """

    def embed(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            vector = np.zeros(width, dtype=np.float32)
            hashes = [zlib.crc32(word.encode("utf-8")) for word in text.lower().split()]
            for h in hashes:
                vector[h % width] += 1.0 if h & 0x80000000 else -1.0
            if not vector.any():
                for h in hashes:
                    vector[h % width] += 1.0
            norm = float(np.linalg.norm(vector))
            out.append(vector / norm if norm else vector)
        return out

    return embed


def _mean(vectors: np.ndarray, weights: Sequence[int]) -> np.ndarray:
    mean = np.average(vectors, axis=0, weights=weights)
    norm = float(np.linalg.norm(mean))
    return (mean / norm if norm else mean).astype(np.float32)


def embed_texts(
    rows: DataFrame,
    text: str,
    make_embedder: Callable[[], Embedder] = hashed_embedder,
    batch: int = lx.EMBEDDING_BATCH,
    out: str = "embedding",
    window: int = lx.EMBEDDING_CHARS,
) -> DataFrame:
    """Add a vector column. The model is made once per task and is called with ``batch`` texts at a time.

    A model takes ``window`` characters; a longer text is embedded window by window, and its vector is the mean of theirs,
    weighted by length and scaled to unit length, so that no part of it is lost.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make_embedder()
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            parts = [[t[i : i + window] for i in range(0, max(1, len(t)), window)] for t in texts]
            flat = [p for part in parts for p in part]
            vectors: list = []
            for start in range(0, len(flat), batch):
                vectors.extend(embed(flat[start : start + batch]))
            pooled, at = [], 0
            for part in parts:
                own = np.asarray(vectors[at : at + len(part)], dtype=np.float32)
                at += len(part)
                pooled.append((own[0] if len(part) == 1 else _mean(own, [len(p) for p in part])).tolist())
            yield frame.assign(**{out: pooled})

    return rows.mapInPandas(run, schema)


def build_vectors(
    sections: DataFrame,
    stored: DataFrame,
    make_embedder: Callable[[], Embedder] = hashed_embedder,
    version: int = lx.VECTOR_VERSION,
) -> DataFrame:
    """Vectors for the sections that have none yet; append the result with ``vector_store.append_vectors``."""
    keyed = sections.withColumn("section_key", vector_store.section_key())
    missing = vector_store.missing_sections(keyed, stored, version)
    texts = missing.select("section_key", embedding_text().alias("_text"))
    return embed_texts(texts, "_text", make_embedder).select("section_key", "embedding")


def with_norm(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Store the squared norm next to the vector, so a search computes only the dot product."""
    return vectors.withColumn("sq_norm", similarity.squared_norm(vector))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """One row per ``size`` rows of a task, every column a list."""
    schema = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                offsets = pa.array([0, part.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.concat_arrays([c])) for c in part.columns]
                yield pa.RecordBatch.from_arrays(lists, names=part.schema.names)

    return rows.mapInArrow(run, schema)


def _by_width(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, components (by position) and squared norms of the vectors of each width that have a direction."""
    widths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(vectors), 0))
    out = {}
    for width in np.unique(widths[widths > 0]):
        places = np.flatnonzero(widths == width)
        flat = vectors.take(pa.array(places)).flatten().cast(pa.float64())
        whole = np.asarray(flat.is_valid()).reshape(-1, width).all(axis=1)
        values = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).reshape(-1, width)[whole].T)
        squares = np.zeros(values.shape[1])
        for component in values:
            squares += component * component
        usable = ~(squares <= 0)
        out[int(width)] = places[whole][usable], np.ascontiguousarray(values[:, usable]), squares[usable]
    return out


def _cosines(queries: pa.ListArray, vectors: pa.ListArray) -> np.ndarray:
    """Cosines of all pairs; 0 as in ``similarity.cosine``. Products are summed in the order of the components, so the
    values are those of a sum row by row."""
    out = np.zeros((len(queries), len(vectors)))
    right = _by_width(vectors)
    for width, (rows, q, q_sq) in _by_width(queries).items():
        columns, v, v_sq = right.get(width, (np.empty(0, int),) * 3)
        if not len(rows) or not len(columns):
            continue
        dots, product = np.zeros((len(rows), len(columns))), np.empty((len(rows), len(columns)))
        for a, b in zip(q, v):
            np.multiply(a[:, None], b[None, :], out=product)
            dots += product
        out[np.ix_(rows, columns)] = dots / np.sqrt(q_sq[:, None] * v_sq[None, :])
    return out


def similarities(
    queries: DataFrame,
    vectors: DataFrame,
    key: Sequence[str],
    exclude_self: str | None = None,
    block_rows: int = QUERY_BLOCK,
    at_least: float | None = None,
    best: int | None = None,
) -> DataFrame:
    """Cosine of every query vector with every stored vector, as one scan of the stored side per block of queries.

    ``queries`` holds ``(query_id, query_vector)``. The stored vectors are never moved before the top-k; the queries are
    broadcast, in blocks of about ``block_rows`` (by the hash of their id) where there are more. Both sides are packed, so
    that a row of the product is a tile of pairs. Pairs below ``at_least``, and those that are not among a tile's ``best``
    of their question (ties stay), need not leave the tile.
    """
    stored = _packed(vectors.select(*key, F.col("embedding").alias("_embedding")), STORED_TILE)
    q = queries.select("query_id", "query_vector")
    schema = T.StructType(
        [q.schema["query_id"], *[vectors.schema[c] for c in key], T.StructField("semantic_score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for batch in batches:
                for i in range(batch.num_rows):
                    cell = {name: batch.column(name).slice(i, 1).flatten() for name in batch.schema.names}
                    scores = _cosines(cell["query_vector"], cell["_embedding"])
                    keep = np.ones(scores.shape, bool)
                    if exclude_self is not None:
                        own = cell["query_id"].to_numpy(zero_copy_only=False)[:, None]
                        keep &= own != cell[exclude_self].to_numpy(zero_copy_only=False)[None, :]
                    if at_least is not None:
                        keep &= ~(scores < at_least)
                    if best is not None and scores.shape[1] > best + 1:
                        # One more than asked for, as the vector itself may be among them.
                        least = np.partition(scores, -best - 1, axis=1)[:, -best - 1]
                        keep &= ~(scores < least[:, None])
                    row, column = np.nonzero(keep)
                    row_of, column_of = pa.array(row), pa.array(column)
                    columns = [cell["query_id"].take(row_of), *[cell[c].take(column_of) for c in key]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(scores[row, column])], names=schema.names)

    blocks = max(1, -(-queries.count() // block_rows))
    out = None
    for block in range(blocks):
        own = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        tiles = stored.join(F.broadcast(_packed(own, QUERY_TILE)))
        scored = tiles.mapInArrow(run, schema)
        out = scored if out is None else out.unionByName(scored)
    return out


def threshold_rank(scored: DataFrame, key: Sequence[str], threshold: float = lx.SIMILARITY_THRESHOLD) -> DataFrame:
    """Every candidate at or above the threshold, ranked by similarity, ties in corpus order."""
    window = Window.partitionBy("query_id").orderBy(F.col("semantic_score").desc(), *key)
    return scored.filter(F.col("semantic_score") >= threshold).withColumn("rank", F.row_number().over(window))


def half_up(value: Column) -> Column:
    """Round half towards positive infinity, as scores are reported."""
    return F.floor(value + F.lit(0.5))


def vector_top_k(scored: DataFrame, key: Sequence[str], k: int = lx.SEMANTIC_RESULTS) -> DataFrame:
    """The k most similar rows with positive similarity; the window is planned with a group limit before the shuffle."""
    window = Window.partitionBy("query_id").orderBy(F.col("semantic_score").desc(), *key)
    ranked = scored.filter("semantic_score > 0").withColumn("rank", F.row_number().over(window))
    return ranked.filter(F.col("rank") <= k).withColumns(
        {"score": half_up(F.col("semantic_score") * 10).cast("int"), "match_type": F.lit("semantic")}
    )


def guard_candidates(
    candidates: DataFrame, key: Sequence[str] = SECTION_KEY, limit: int | None = None
) -> DataFrame:
    """Candidates with a title and a content; with ``limit``, among the first so many of each question in order."""
    if limit is None:
        return candidates.filter(F.col("title").isNotNull() & F.col("content").isNotNull())
    window = Window.partitionBy("query_id").orderBy(*key)
    first = candidates.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= limit).drop("_n")
    return first.filter(F.col("title").isNotNull() & F.col("content").isNotNull())
