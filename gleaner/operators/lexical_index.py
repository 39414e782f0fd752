"""A stored lexical index of blocks with their highest points, and a top-k that skips blocks.

``write`` cuts and scores the corpus once. Sections are laid out in an order that keeps similar ones together and fall into
blocks of ``1 << BLOCK_BITS``. Below one path the index holds, as Parquet,

* ``blocks``: one row for each block, with its sections' keys, for each of its words (or rules) the highest points in the
  block, and its postings ``(word, place, points)`` by word, where a word is a place among the block's words;
* ``titles``: the distinct titles that a question may quote.

Blocks come from one pass over the sections in their order, so no posting is moved or joined. At question time needles, which are
sent to every task, meet the words of blocks, not the texts, and the corpus is neither cut nor shuffled again. The
highest points bound what any section of a block can score. Each question's blocks of highest bound are scored first, which
gives it a threshold (its k-th best score so far); of the others only those are scored whose bound reaches it, so the result
is that of a full scan. Points are added up by numpy inside the tasks that read the blocks, and k rows for each task and
question leave them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import lexicons as lx
from gleaner.operators import lexical
from gleaner.operators.needle_sums import POINTS, Needles, total
from gleaner.session import bounded_broadcast, materialise

BLOCK_BITS = 4
#: Blocks of a question that are scored before the others, to get a threshold.
FIRST = 4
#: Questions of one pass over the blocks.
QUESTIONS = 2_000
#: Cells (section, question) whose sums a task holds at once.
CELLS = 1 << 16
#: Blocks that a task makes together, or reads at once.
BLOCKS = 64


@dataclass
class Index:
    """The tables of a written index."""

    titles: DataFrame
    blocks: DataFrame
    key: tuple[str, ...]


@dataclass
class Found:
    """``matches`` as ``lexical.search`` gives them, and per question the ``blocks`` that could match, those ``scored`` and
    those ``skipped``."""

    matches: DataFrame
    report: DataFrame


def write(
    sections: DataFrame,
    path: str,
    key: Sequence[str] = lexical.SECTION_KEY,
    cluster: Sequence[str] = ("project",),
    stop: Sequence[str] = lx.STOP_TOKENS,
    groups: Sequence[tuple[str, Sequence[str]]] = lx.CONCEPTS,
    bonus: Sequence[tuple[str, str, str, int]] = lx.INTENT_BONUS,
) -> Index:
    """Write the index of ``sections`` below ``path``. Similar sections should be near each other by ``cluster`` (columns);
    within it they keep the order of ``key``. Keys must be unique."""
    spark = sections.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    forms = [c for c in ("title_forms",) if c in sections.columns]
    columns = dict.fromkeys([*key, *cluster, "title", "content", "project", "aliases", "role", *forms])
    order = [*cluster, *key]
    laid = sections.select(*columns).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    # A number holds the partition above and the place below, so a block never spans two partitions.
    laid = laid.withColumn("sid", F.monotonically_increasing_id())
    fields = lexical.section_fields(laid, ("sid", *key), stop, groups, bonus, partitioned=True)
    with _batches(spark, BLOCKS << BLOCK_BITS):
        _blocks(fields, key).write.parquet(f"{path}/blocks")
    quotable = spark.read.parquet(f"{path}/blocks").select(F.explode("titles").alias("title")).distinct()
    quotable.write.parquet(f"{path}/titles")
    return read(spark, path, key)


@contextmanager
def _batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is executed inside reads, and sends to Python, so many rows at once: a block is a long row."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name in names:
            spark.conf.set(name, before[name])


def _blocks(fields: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``blocks`` from ``section_fields`` by ``sid`` and ``key``, in order of ``sid`` within each task."""
    kinds = {k: fields.schema[k].dataType for k in key}
    ints, strings = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("keys", T.ArrayType(T.StructType([T.StructField(k, v) for k, v in kinds.items()]))),
            *[T.StructField(f"post_{c}", ints) for c in ("word", "place", *POINTS)],
            T.StructField("top_word", strings),
            *[T.StructField(f"top_{c}", ints) for c in POINTS],
            T.StructField("titles", strings),
        ]
    )

    def lists(values: np.ndarray | pa.Array, ends: np.ndarray) -> pa.ListArray:
        held = values if isinstance(values, pa.Array) else pa.array(values, pa.int32())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)

    def made(rows: pa.Table) -> pa.RecordBatch:
        own = rows["fields"].combine_chunks()
        lanes = dict(zip((*POINTS, "words"), own.flatten().flatten(), strict=True))
        sid = rows["sid"].to_numpy()
        block, begins = np.unique(sid >> BLOCK_BITS, return_index=True)
        field_row = np.repeat(np.arange(len(sid)), own.value_lengths().to_numpy())
        row_block = np.searchsorted(begins, np.arange(len(sid)), "right") - 1
        field = np.repeat(np.arange(len(field_row)), lanes["words"].value_lengths().fill_null(0).to_numpy())
        coded = lanes["words"].flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        if coded.null_count:
            field, code = field[~np.isnan(code)], code[~np.isnan(code)].astype(np.int64)
        names = coded.dictionary
        spot = (row_block[field_row[field]] * len(names) + code) * len(sid) + field_row[field]
        by = np.argsort(spot, kind="stable")
        spot, field = spot[by], field[by]
        first = np.flatnonzero(np.append(True, spot[1:] != spot[:-1])) if len(spot) else np.zeros(0, np.int64)
        word, row = np.divmod(spot[first], len(sid))
        posts = []
        for p, reduce in zip(POINTS, (np.add, *[np.maximum] * 5)):
            values = lanes[p].to_numpy()
            posts.append(reduce.reduceat(values[field], first) if len(first) else values[:0])
        top = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        tops = [np.maximum.reduceat(p, top) if len(top) else p for p in posts]
        at, code_of = np.divmod(word[top], max(1, len(names)))
        post_ends = np.searchsorted(row_block[row], np.arange(len(block) + 1))
        top_ends = np.searchsorted(at, np.arange(len(block) + 1))
        nth = np.repeat(np.arange(len(top)), np.diff(np.append(top, len(word))))
        local = nth - top_ends[row_block[row]]
        title = pc.starts_with(names, f"{lexical._RULE}p").to_numpy(zero_copy_only=False)
        quoted = np.flatnonzero(title[code_of])
        quotable = pc.utf8_slice_codeunits(names.take(pa.array(code_of[quoted])), 2)
        keys = pa.StructArray.from_arrays([rows[k].combine_chunks() for k in key], names=list(key))
        columns = [pa.array(block), lists(keys, np.append(begins, len(sid)))]
        columns += [lists(v, post_ends) for v in (local, sid[row] & ((1 << BLOCK_BITS) - 1), *posts)]
        columns += [lists(names.take(pa.array(code_of)), top_ends), *(lists(v, top_ends) for v in tops)]
        columns.append(lists(quotable, np.searchsorted(at[quoted], np.arange(len(block) + 1))))
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last block's rows, more of them may come
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            block = rows["sid"].to_numpy() >> BLOCK_BITS
            starts = np.append(0, np.flatnonzero(block[1:] != block[:-1]) + 1)
            for a, b in zip(starts[:-1:BLOCKS], np.append(starts[BLOCKS:-1:BLOCKS], starts[-1])):
                yield made(rows.slice(a, b - a))
            held = rows.slice(starts[-1])
        if held is not None:
            yield made(held)

    return fields.mapInArrow(run, schema)


def read(spark: SparkSession, path: str, key: Sequence[str] = lexical.SECTION_KEY) -> Index:
    return Index(spark.read.parquet(f"{path}/titles"), spark.read.parquet(f"{path}/blocks"), tuple(key))


def titles(index: Index) -> DataFrame:
    """The distinct titles of the indexed sections that a question may quote, as ``title``."""
    return index.titles


def _asked(postings: DataFrame) -> Iterator[Needles]:
    """The questions in groups of ``QUESTIONS``."""
    held = materialise(postings.select("query_id", "needle", "nt", "nx", "nc", "nr"))
    ids = [r["query_id"] for r in held.select("query_id").distinct().orderBy("query_id").toLocalIterator()]
    for start in range(0, len(ids), QUESTIONS):
        own = held if len(ids) <= QUESTIONS else held.where(F.col("query_id").isin(ids[start : start + QUESTIONS]))
        yield Needles.of(own.toArrow())


def _cut(batch: pa.RecordBatch, prefix: str, names: Sequence[str], start: int, stop: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Lengths and contents of list columns in rows ``start`` to ``stop``."""
    columns = [batch.column(f"{prefix}_{n}").slice(start, stop - start) for n in names]
    ends = columns[0].offsets.to_numpy()
    return np.diff(ends), [c.flatten() for c in columns]


def _numbers(columns: Sequence[pa.Array]) -> np.ndarray:
    return np.array([c.to_numpy(zero_copy_only=False) for c in columns], np.int64)


def _bounds(index: Index, asked: Needles) -> DataFrame:
    """``(block, question, bound)`` of all blocks in which a section could score; ``question`` is a place in ``asked.ids``."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        step = max(1, CELLS // max(1, len(known.ids)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                stop = min(start + step, batch.num_rows)
                sizes, (words, *points) = _cut(batch, "top", ("word", *POINTS), start, stop)
                place = np.repeat(np.arange(stop - start), sizes)
                _, bound = total(known.posted(place, _numbers(points), words, np.arange(len(words)), stop - start))
                row, question = np.nonzero(bound)
                blocks = batch.column("block").to_numpy()[start:stop]
                columns = [blocks[row], question.astype(np.int32), bound[row, question].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "question", "bound"])

    columns = index.blocks.select("block", *[f"top_{c}" for c in ("word", *POINTS)])
    return columns.mapInArrow(run, "block long, question int, bound long")


def _exact(index: Index, asked: Needles, due: DataFrame, k: int, least: np.ndarray | None = None) -> DataFrame:
    """``(question, keys, score and its parts)``: of each task, the sections of the ``due`` (block, question) that are among
    the k best there, with all that tie with the last of them; and that reach the question's ``least`` score, if given."""
    shared = index.blocks.sparkSession.sparkContext.broadcast((asked, least))
    names = ("score", "direct", "phrase", "coverage", "technical", "concept", "intent")
    per_block = due.groupBy("block").agg(F.collect_list("question").alias("due"))
    posts = [f"post_{c}" for c in ("word", "place", *POINTS)]
    rows = index.blocks.select("block", "top_word", *posts).join(bounded_broadcast(per_block), "block")

    def prune(found: list[np.ndarray], least: np.ndarray) -> list[np.ndarray]:
        question, score = found[0], found[3]
        order = np.lexsort((-score, question))
        own = question[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(own)))
        ranked = score[order]
        last = ranked[np.minimum(first + k, first + sizes) - 1]
        full = sizes >= k
        least[own[first[full]]] = np.maximum(least[own[first[full]]], last[full])
        kept = order[ranked >= np.repeat(last, sizes)]
        return [f[kept] for f in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, least = shared.value
        size, width = len(known.ids), 1 << BLOCK_BITS
        least = np.zeros(size) if least is None else least.astype(np.float64)
        step = max(1, CELLS // max(1, size * width))
        held: list[np.ndarray] | None = None
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                stop = min(start + step, batch.num_rows)
                sizes, (word, place, *points) = _cut(batch, "post", ("word", "place", *POINTS), start, stop)
                tops, (words,) = _cut(batch, "top", ("word",), start, stop)
                n = (stop - start) * width
                (word, place), points = _numbers([word, place]), _numbers(points)
                word, place = word + np.repeat(np.cumsum(tops) - tops, sizes), place + np.repeat(np.arange(stop - start), sizes) * width
                asking = batch.column("due").slice(start, stop - start)
                wanted = np.zeros((stop - start, size), bool)
                row = np.repeat(np.arange(stop - start), np.diff(asking.offsets.to_numpy()))
                wanted[row, asking.flatten().to_numpy()] = True
                sums = known.posted(place, points, words, word, n) * np.repeat(wanted, width, axis=0)
                coverage, score = total(sums)
                at, question = np.nonzero((score > 0) & (score >= least))
                blocks = batch.column("block").to_numpy()[start:stop]
                parts = [score, sums[0], sums[5], coverage, sums[1], sums[3], sums[4]]
                new = [question, blocks[at // width], at % width, *(p[at, question].astype(np.int64) for p in parts)]
                held = prune(new if held is None else [np.concatenate(p) for p in zip(held, new)], least)
        if held is not None:
            columns = [pa.array(held[0].astype(np.int32)), pa.array(held[1]), pa.array(held[2].astype(np.int32))]
            columns += [pa.array(h) for h in held[3:]]
            yield pa.RecordBatch.from_arrays(columns, ["question", "block", "place", *names])

    schema = "question int, block long, place int, " + ", ".join(f"{n} long" for n in names)
    return rows.mapInArrow(run, schema)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """Rows whose score is among the k highest of their question, with all that equal the last of them."""
    rank = F.rank().over(Window.partitionBy("question").orderBy(F.col("score").desc()))
    return pairs.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def search(index: Index, postings: DataFrame, k: int) -> Found:
    """The k best sections for each question of ``postings`` (see ``lexical.question_postings``), ties by key.

    One pass over the highest points gives the bounds; two passes over the blocks that are due give the scores. Bounds,
    one row for each question and block that could match, stay in the shared folder.
    """
    matches, reports, spark = None, None, index.blocks.sparkSession
    for asked in _asked(postings):
        with _batches(spark, BLOCKS):
            bounds = materialise(_bounds(index, asked))
        place = F.row_number().over(Window.partitionBy("question").orderBy(F.col("bound").desc(), "block"))
        first = bounds.withColumn("_place", place).where(F.col("_place") <= FIRST).drop("_place")
        first = materialise(first)
        with _batches(spark, BLOCKS):
            best = materialise(_best(_exact(index, asked, first, k), k))
        # A question without k matches has no threshold yet; a bound equal to it may still win by its key.
        threshold = best.groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        threshold = materialise(threshold.where(F.col("n") >= k).select("question", "least"))
        least = np.zeros(len(asked.ids))
        for r in threshold.toLocalIterator():
            least[r["question"]] = r["least"]
        rest = bounds.join(bounded_broadcast(first.select("block", "question")), ["block", "question"], "left_anti")
        rest = rest.join(bounded_broadcast(threshold), "question", "left")
        rest = materialise(rest.where("least IS NULL OR bound >= least").select("block", "question"))
        with _batches(spark, BLOCKS):
            best = materialise(_best(best.unionByName(_exact(index, asked, rest, k, least)), k))
        keyed = best.join(index.blocks.select("block", "keys"), "block")
        ids = spark.createDataFrame(
            list(enumerate(asked.ids.to_pylist())), f"question int, query_id {postings.schema['query_id'].dataType.simpleString()}"
        )
        keyed = keyed.withColumn("_key", F.get("keys", F.col("place"))).join(F.broadcast(ids), "question")
        keyed = keyed.select("query_id", *[F.col(f"_key.{c}").alias(c) for c in index.key], *lexical.COMPONENTS, "score")
        keyed = keyed.withColumn("match_type", lexical.match_type(F.col("direct") > 0, F.col("concept") > 0))
        done = first.select("question").unionAll(rest.select("question")).groupBy("question").agg(F.count(F.lit(1)).alias("scored"))
        counts = bounds.groupBy("question").agg(F.count(F.lit(1)).alias("blocks")).join(done, "question")
        report = counts.join(F.broadcast(ids), "question").select(
            "query_id", "blocks", "scored", (F.col("blocks") - F.col("scored")).alias("skipped")
        )
        matches = keyed if matches is None else matches.unionByName(keyed)
        reports = report if reports is None else reports.unionByName(report)
    if matches is None:
        kind = postings.schema["query_id"].dataType.simpleString()
        fields = [f"{c} {index.blocks.schema['keys'].dataType.elementType[c].dataType.simpleString()}" for c in index.key]
        parts = ", ".join(f"{c} long" for c in (*lexical.COMPONENTS, "score"))
        matches = spark.createDataFrame([], f"query_id {kind}, {', '.join(fields)}, {parts}, match_type string")
        reports = spark.createDataFrame([], f"query_id {kind}, blocks long, scored long, skipped long")
    return Found(lexical.top_k(matches, k, index.key), reports)
