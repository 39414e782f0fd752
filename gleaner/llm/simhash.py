"""SimHash near-duplicates with bit-sliced comparison.

Every text gets a 64-bit fingerprint: the majority of each bit over the hashes of its word shingles. Distinct
fingerprints within the radius are linked, and connected documents share a class.

Candidates come from exact keys: the bits are cut into radius + 2 blocks, of which two at least are equal within the
radius, so fingerprints meet in one of the buckets named by two blocks and their bits. In a bucket, fingerprints are
compared bit-sliced: bit planes are stored vertically, one machine word holds one bit of 64 fingerprints; for each
distance between rows, the planes are compared with themselves shifted, the differences are added up in carry-save
counters for all rows at once, and the comparison is abandoned as soon as every row has exceeded the radius. A bucket
links its fingerprints by a spanning forest, not by all pairs; buckets of more than ``TILE`` fingerprints are cut into
tiles, and each pair of tiles is a task's work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import shuffle_partitions, with_columns_from_text
from gleaner.llm.components import connected
from gleaner.session import materialise

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a bucket that are compared as one piece; larger buckets are tiled.
TILE = 2048
#: Rows that a task compares together.
ROWS = 1 << 16
#: Bit planes compared before it is asked whether any row is still within the radius.
PLANES = 8

_SCHEMA = T.StructType([T.StructField("fingerprint", T.LongType())])


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """Fingerprint as a signed 64-bit number; 0 without words."""
    parts = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z is lowered, only ASCII blanks split
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = (ends - np.fromiter(map(len, parts), np.int64, len(parts)) - 1).tolist()
        shingles = [joined[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        block = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8)
        counts += np.unpackbits(block, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE) -> DataFrame:
    """Adds ``fingerprint`` (long) of whole texts; null and empty texts, and such of blanks only, have 0."""

    def rows_of(texts):
        return [(fingerprint(t, words),) for t in texts]

    return with_columns_from_text(docs, rows_of, _SCHEMA, text)


class Planes:
    """Fingerprints stored vertically: plane b holds bit b of every row, 64 rows to a word."""

    def __init__(self, fingerprints: np.ndarray):
        self.n = len(fingerprints)
        self.words = (self.n + 63) // 64
        bits = np.unpackbits(fingerprints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = np.zeros((64, self.words + 1), np.uint64)
        for b in range(64):
            self.planes[b, : self.words] = pack(bits[:, b], self.words)

    def within(self, lag: int, asked: np.ndarray, radius: int) -> np.ndarray:
        """Of the rows in the bit set ``asked``: those that differ from the row ``lag`` further in at most ``radius``
        bits, as a bit set."""
        counters = [np.zeros(self.words, np.uint64) for _ in range(radius.bit_length())]
        over = ~asked
        for start in range(0, 64, PLANES):
            own = self.planes[start : start + PLANES]
            for plane in own[:, : self.words] ^ shifted(own, lag, self.words):
                carry = plane
                for i, counter in enumerate(counters):
                    counters[i], carry = counter ^ carry, counter & carry
                over |= carry
            over |= exceeds(counters, radius)
            if (over == ~np.uint64(0)).all():
                break
        return ~over


def pack(bits: np.ndarray, words: int) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    out = np.zeros(words * 8, np.uint8)
    out[: len(packed)] = packed
    return out.view("<u8").astype(np.uint64)


def shifted(planes: np.ndarray, lag: int, words: int) -> np.ndarray:
    """The planes moved ``lag`` rows down: row i shows row i + lag."""
    skip, bits = divmod(lag, 64)
    out = np.zeros((len(planes), words), np.uint64)
    if skip >= words:
        return out
    out[:, : words - skip] = planes[:, skip:words] >> np.uint64(bits)
    if bits:
        out[:, : words - skip] |= planes[:, skip + 1 : words + 1] << np.uint64(64 - bits)
    return out


def exceeds(counters: list[np.ndarray], limit: int) -> np.ndarray:
    """Rows whose counter (bits from the lowest) is above ``limit``."""
    above = np.zeros_like(counters[0])
    equal = ~np.zeros_like(counters[0])
    for i in reversed(range(len(counters))):
        if limit >> i & 1:
            equal &= counters[i]
        else:
            above |= equal & counters[i]
            equal &= ~counters[i]
    return above


def forest(group: np.ndarray, fingerprints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row of its root) that connect, within each group (rows sorted by it), all rows whose fingerprints are
    within the radius."""
    label = np.arange(len(group))
    rows = np.arange(len(group))
    lag = 1
    while len(rows):
        sizes = np.bincount(np.unique(group[rows], return_inverse=True)[1])
        rows = rows[np.repeat(sizes > lag, sizes)]  # groups whose last distance is done leave
        if not len(rows):
            break
        own = group[rows]
        planes = Planes(fingerprints[rows])
        # Until a third of the rows could leave, the planes stay as they are.
        sizes = np.sort(sizes[sizes > lag])
        until = max(lag + 1, int(np.repeat(sizes, sizes)[len(rows) // 3]))
        for distance in range(lag, until):
            same = np.zeros(len(own), bool)
            same[: len(own) - distance] = own[: len(own) - distance] == own[distance:]
            if not same.any():
                continue
            asked = pack(same, planes.words)
            close = planes.within(distance, asked, radius)
            at = np.flatnonzero(np.unpackbits(close.astype("<u8").view(np.uint8), bitorder="little")[: len(own)])
            a, b = rows[at], rows[at + distance]
            unlike = label[a] != label[b]
            if unlike.any():
                for x, y in zip(label[a[unlike]].tolist(), label[b[unlike]].tolist()):
                    while label[x] != x:
                        x = int(label[x])
                    while label[y] != y:
                        y = int(label[y])
                    label[max(x, y)] = min(x, y)
                while (label[label] != label).any():
                    label = label[label]
        lag = until
    child = np.flatnonzero(label != np.arange(len(label)))
    return child, label[child]


def block_keys(radius: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Pairs of bit ranges (start, width), of radius + 2 blocks of 64 bits."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    ranges = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return [(x, y) for i, x in enumerate(ranges) for y in ranges[i + 1 :]]


def link_forest(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``nodes(node, fp)`` with distinct fingerprints → links ``(a, b)`` that connect all nodes within the radius."""
    keys = []
    for (a, wa), (b, wb) in block_keys(radius):
        bits_a = F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << wa) - 1))
        bits_b = F.shiftrightunsigned("fp", b).bitwiseAND(F.lit((1 << wb) - 1))
        keys.append(F.shiftleft(bits_a, wb) + bits_b)
    keyed = nodes.select("node", "fp", F.posexplode(F.array(*keys)).alias("pair", "bits"))
    counts = keyed.groupBy("pair", "bits").count().where(F.col("count") > 1)
    met = keyed.join(counts, ["pair", "bits"])
    tiles = F.ceil(F.col("count") / F.lit(tile)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    placed = (
        met.withColumn("tiles", tiles)
        .withColumn("mine", mine)
        .withColumn("other", other)
        .select(
            "pair", "bits", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "node", "fp"
        )
    )
    key = ["pair", "bits", "low", "high"]
    dealt = placed.repartition(shuffle_partitions(nodes.sparkSession), *key).sortWithinPartitions(*key)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(columns: list[np.ndarray]) -> pa.RecordBatch:
            changed = np.zeros(len(columns[0]), bool)
            for c in columns[:4]:
                changed[1:] |= c[1:] != c[:-1]
            child, root = forest(np.cumsum(changed), columns[5].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(columns[4][child]), pa.array(columns[4][root])], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
            if len(held[0]) < ROWS:
                continue
            # The last group may go on in the next batch.
            last = np.zeros(len(held[0]), bool)
            for c in held[:4]:
                last |= c != c[-1]
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield linked([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield linked(held)

    return dealt.mapInArrow(link, "a long, b long")


def _with_components(grouped: DataFrame, radius: int) -> DataFrame:
    """``grouped``, whose ``fp`` are distinct, with ``component``: one number for all fingerprints that links reach."""
    found = connected(link_forest(grouped.select(F.col("fp").alias("node"), "fp"), radius))
    made = grouped.join(found, F.col("fp") == F.col("node"), "left")
    return made.select(*grouped.columns, F.coalesce("component", "fp").alias("component"))


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row: the fingerprint as 16 hex digits and the smallest doc_id that
    links reach.

    Texts without words (null, empty, blanks) have fingerprint zero and link like any other; equal fingerprints are one
    node, so copies are never paired; repeated rows stay; rows without doc_id link too, and their component is null only
    if nothing but such rows is in it; an empty table gives an empty result.
    """
    prints = materialise(
        with_fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", words)
        .select("doc_id", F.col("fingerprint").alias("fp"))
    )
    grouped = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = _with_components(grouped, radius)
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_class(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """``docs``, one row of each class of ``near_duplicates``: the one of the smallest id (rows without id come last), of
    several such the one whose text has the least MD5, and of rows with equal id and text that of the least other columns.

    So a class of rows without id keeps one of them, repeated rows stay once, and rows that share an id but not a class
    are judged each in its own. Null texts and texts without words are one class, as in ``near_duplicates``; an empty table
    stays empty.
    """
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    own, value = F.col(names[doc_id]).cast("long"), F.coalesce(F.col(names[text]), F.lit(""))
    key = ["__unnamed", "__id", "__digest"]  # without nulls, so that it joins
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumns(
        {"__unnamed": own.isNull(), "__id": F.coalesce(own, F.lit(0)), "__digest": F.unhex(F.md5(value.cast("binary")))}
    )
    prints = with_fingerprints(held.select(*key, F.col(names[text]).alias("text")), "text", words)
    rows = prints.groupBy(F.col("fingerprint").alias("fp"), *key).count()
    grouped = materialise(rows.groupBy("fp").agg(F.min(F.struct(*key, "count")).alias("least")))
    least = _with_components(grouped, radius).groupBy("component").agg(F.min("least").alias("least"))
    chosen = materialise(least.select("least.*"))
    single, several = chosen.where("count = 1").select(*key), chosen.where("count > 1").select(*key)
    kept = held.join(single, key, "left_semi").select(*names.values())
    if not several.isEmpty():
        alike = held.join(several, key, "left_semi").groupBy(*key).agg(F.min(F.struct(*names.values())).alias("row"))
        kept = kept.unionByName(alike.select("row.*"))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
