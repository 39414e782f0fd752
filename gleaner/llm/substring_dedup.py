"""Removal of long byte strings that also start in an earlier document, by run-length indexes of repetitive pieces.

A window is a string of ``LENGTH`` bytes. Its anchor is the k-gram in it of least hash (the leftmost one), so equal
windows have equal anchors wherever they stand, and a text falls into pieces: stretches of windows with one anchor. The
job, in which equal windows always meet in one group:

1. Equal texts are collapsed (in the tasks that read them, then by text), so that a text is indexed once however many
   copies it has; a copy of at least ``LENGTH`` bytes is covered by the first of them.
2. Groups of texts hand the hashes of their anchors, each once, to groups of hashes, which give back those of more than
   one text.
3. Groups of texts hand the pieces at those anchors, each distinct one once and with its smallest document, to groups of
   hashes. There the distinct pieces become a run-length index (``run_length_index``), every piece is streamed through it,
   and each of its windows gets the smallest document that has the same window.
4. Groups of texts remove what their windows share with smaller documents.

A passage that many documents share travels once per group of texts, not once per document. The sizes of groups are set by
parameters and the bytes of the corpus; texts are shuffled once, in a form that all steps read. Every group of texts writes to
every group of hashes, so groups are as large as memory allows; the indexes of a group of hashes stand one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import shuffle_partitions
from gleaner.llm.run_length_index import RunLengthIndex

LENGTH = 50
#: Bytes of an anchor.
ANCHOR = 20
#: Bytes of text in a group of texts, and bytes of text behind a group of hashes; of small tables, there are as many
#: groups as shuffle partitions. The messages between them grow with the product of their numbers.
TEXT_GROUP = 16 << 20
HASH_GROUP = 16 << 20
#: Indexes of a group of hashes; one at a time is in memory, and a small one stays in the processor's cache.
INDEXES = 16
#: Texts a reading task remembers to drop their copies.
REMEMBERED = 100_000
#: Window starts that are hashed together.
STRETCH = 1 << 16
#: Bytes of a group's texts that are cut together.
CUT = 1 << 20

_B = 0x9E3779B97F4A7C15
_HASH_BYTES = 6

_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _power(e: int) -> np.uint64:
    return np.uint64(pow(_B, e, 1 << 64))


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` bytes, by doubling."""
    current, width, out, done, left = _TABLE[data], 1, None, 0, size
    while left:
        if left & 1:
            if out is None:
                out, done = current, width
            else:
                n = len(current) - done
                out = out[:n] * _power(width) + current[done : done + n]
                done += width
        left >>= 1
        if left:
            current = current[:-width] * _power(width) + current[width:]
            width *= 2
    out = out[: len(data) - size + 1]
    out = out ^ (out >> np.uint64(31))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    out, width = values, 1
    while 2 * width <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < size:
        more = size - width
        out = np.minimum(out[:-more], out[more:])
    return out


def pieces(data: np.ndarray, ends: np.ndarray, length: int, anchor: int):
    """Pieces of concatenated texts (which end at ``ends``): hash of the anchor, first window start, windows."""
    span = length - anchor + 1
    low = np.uint64((1 << 20) - 1)
    found = []
    text_of = None
    for start in range(0, max(0, len(data) - length + 1), STRETCH):
        part = data[start : start + STRETCH + length - 1]
        hashes = _gram_hashes(part, anchor)
        least = _sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), span)
        where = (least & low).astype(np.int64)
        first = start + np.arange(len(where))
        # Windows must end within the text they start in.
        text_of = np.searchsorted(ends, first[[0, -1]], side="right")
        cuts = ends[text_of[0] : text_of[1] + 1]
        valid = np.ones(len(where), bool)
        for end in cuts.tolist():
            valid[max(0, end - length + 1 - start) : max(0, end - start)] = False
        new = np.append(True, where[1:] != where[:-1]) | np.append(True, ~valid[:-1])
        begin = np.flatnonzero(new & valid)
        if not len(begin):
            continue
        stop = np.append(np.flatnonzero(new | ~valid), len(where))
        size = stop[np.searchsorted(stop, begin, side="right")] - begin
        found.append((hashes[where[begin]], first[begin], size))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _pressed(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def _opened(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), kind)


def _short(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64((1 << 8 * _HASH_BYTES) - 1)


def _as_bytes(short: np.ndarray) -> bytes:
    return _pressed(short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES])


def _as_hashes(data: bytes) -> np.ndarray:
    flat = _opened(data, np.uint8).reshape(-1, _HASH_BYTES)
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, :_HASH_BYTES] = flat
    return out.view("<u8").reshape(-1).astype(np.uint64)


class Texts:
    """A group's distinct texts in the order of their digests, one after the other, with their smallest documents."""

    def __init__(self, table: pa.Table):
        held: dict[str, list] = {}
        for key, doc, text in zip(table["key"].to_pylist(), table["doc_id"].to_pylist(), table["text"]):
            known = held.setdefault(key, [doc, None])
            known[0] = min(known[0], doc)
            if known[1] is None and text.is_valid:
                known[1] = text.as_buffer()
        self.keys = sorted(held)
        self.docs = np.array([held[k][0] for k in self.keys], np.int64)
        self.data = np.frombuffer(b"".join(held[k][1] for k in self.keys), np.uint8)
        self.ends = np.cumsum([held[k][1].size for k in self.keys]).astype(np.int64)

    def pieces(self, length: int, anchor: int):
        hashes, first, windows = pieces(self.data, self.ends, length, anchor)
        return hashes, first, windows, np.searchsorted(self.ends, first, side="right")


def group_numbers(size: int, least: int) -> tuple[int, int]:
    """How many groups of texts and of hashes ``size`` bytes of text have, ``least`` of either at least."""
    return max(least, -(-size // TEXT_GROUP)), max(least, -(-size // HASH_GROUP))


def _group_of(hashes: np.ndarray, groups: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(groups)).astype(np.int32)


def _by_group(hashes: np.ndarray, groups: int, parts: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each group that occurs, with the places of its hashes, by part and within it in their order, and the parts' sizes."""
    fine = _group_of(hashes, groups * parts)
    order = np.argsort(fine, kind="stable")
    group, part = np.divmod(fine[order], parts)
    starts = np.flatnonzero(np.append(True, np.diff(group) != 0)) if len(group) else []
    for a, b in zip(starts, np.append(starts[1:], len(order)) if len(starts) else []):
        yield int(group[a]), order[a:b], np.bincount(part[a:b], minlength=parts).astype(np.int32)


def distinct_texts(docs: DataFrame, groups: int, length: int) -> DataFrame:
    """``(g, key, doc_id, text)``: texts of at least ``length`` bytes, less the copies a reading task sees (a copy with a
    smaller id leaves its id, without the text)."""
    source = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text")).where(
        F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)
    )
    keyed = source.select(F.md5("text").alias("key"), "doc_id", "text")

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            rows, bare = [], []
            for i, (key, doc) in enumerate(zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist())):
                known = seen.get(key)
                if known is None or doc < known:
                    rows.append(i)
                    bare.append(known is not None)
                    seen[key] = doc
            if len(seen) > REMEMBERED:
                seen.clear()
            kept = batch.take(pa.array(rows, pa.int64()))
            text = pc.if_else(pa.array(bare, pa.bool_()), pa.scalar(None, pa.binary()), kept.column("text"))
            yield pa.RecordBatch.from_arrays([kept.column("key"), kept.column("doc_id"), text], ["key", "doc_id", "text"])

    made = keyed.mapInArrow(collapse, "key string, doc_id long, text binary")
    return made.select(F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("g"), "key", "doc_id", "text")


def sent_anchors(table: pa.Table, hash_groups: int, length: int, anchor: int) -> pa.Table:
    """What a group of texts sends to each group of hashes: every anchor hash once, and whether several of its texts have
    it, so that what meets at a hash is bounded by the groups of texts, not by the places."""
    own = Texts(table)
    hashes, _, _, text = own.pieces(length, anchor)
    rows = []
    for h, at, _ in _by_group(hashes, hash_groups):
        short, texts = _short(hashes[at]), text[at]
        order = np.argsort(short, kind="stable")
        short, texts = short[order], texts[order]
        first = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
        last = np.append(first[1:], len(short)) - 1
        rows.append((h, _as_bytes(short[first]), _pressed(texts[first] != texts[last])))  # texts ascend within a hash
    g = table["g"][0].as_py()
    return pa.table(
        {
            "h": pa.array([r[0] for r in rows], pa.int32()),
            "g": pa.array([g] * len(rows), pa.int32()),
            "hashes": pa.array([r[1] for r in rows], pa.binary()),
            "several": pa.array([r[2] for r in rows], pa.binary()),
        }
    )


def repeated_anchors(table: pa.Table) -> pa.Table:
    """Of a group of hashes: for each group of texts, those of its hashes that more than one text has."""
    hashes, several, groups = [], [], []
    for g, h, s in zip(table["g"].to_pylist(), table["hashes"].to_pylist(), table["several"].to_pylist()):
        found = _as_hashes(h)
        hashes.append(found)
        several.append(_opened(s, bool))
        groups.append(np.full(len(found), g, np.int32))
    hashes, several, groups = np.concatenate(hashes), np.concatenate(several), np.concatenate(groups)
    order = np.argsort(hashes, kind="stable")
    hashes, several, groups = hashes[order], several[order], groups[order]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    sizes = np.diff(np.append(starts, len(hashes)))
    # A text is in one group only, so a hash of two groups is one of two texts.
    keep = np.repeat((sizes > 1) | np.logical_or.reduceat(several, starts), sizes)
    hashes, groups = hashes[keep], groups[keep]
    order = np.argsort(groups, kind="stable")
    hashes, groups = hashes[order], groups[order]
    starts = np.flatnonzero(np.append(True, np.diff(groups) != 0)) if len(groups) else np.empty(0, np.int64)
    stops = np.append(starts[1:], len(groups)) if len(starts) else starts
    return pa.table(
        {
            "g": pa.array(groups[starts], pa.int32()),
            "hashes": pa.array([_as_bytes(hashes[a:b]) for a, b in zip(starts, stops)], pa.binary()),
        }
    )


def marked(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """``(key, doc_id, n_removed, n_spans, kept)`` of the smallest document of each distinct text of at least ``length``
    bytes; ``kept`` is the text that is left (characters that lost a part are gone), or with ``digest`` the SHA-256 of all
    bytes that are left."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    text_groups, hash_groups = group_numbers(size, shuffle_partitions(docs.sparkSession))
    texts = distinct_texts(docs, text_groups, length)

    def anchors(table: pa.Table) -> pa.Table:
        return sent_anchors(table, hash_groups, length, anchor)

    def offered(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {name: [] for name in _OFFER}
        if left.num_rows and right.num_rows:
            own, g = Texts(left), left["g"][0].as_py()
            wanted = np.unique(np.concatenate([_as_hashes(h) for h in right["hashes"].to_pylist()]))
            hashes, first, windows, text = own.pieces(length, anchor)
            short = _short(hashes)
            hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)] == short)
            hashes, first, windows, text = hashes[hit], first[hit], windows[hit], text[hit]
            # Each distinct piece is numbered; its windows are judged once for all places where it stands.
            data = own.data.tobytes()
            numbers: dict[bytes, int] = {}
            number = np.empty(len(first), np.int64)
            for i, (a, n) in enumerate(zip(first.tolist(), windows.tolist())):
                number[i] = numbers.setdefault(data[a : a + n + length - 1], len(numbers))
            strings = list(numbers)
            least = np.full(len(strings), np.iinfo(np.int64).max)
            np.minimum.at(least, number, own.docs[text])
            hash_of = np.empty(len(strings), np.uint64)
            hash_of[number] = hashes
            for h, at, counts in _by_group(hash_of, hash_groups, INDEXES):
                chosen = [strings[i] for i in at.tolist()]
                sizes = np.append(counts, np.fromiter(map(len, chosen), np.int32, len(chosen)))
                _offer(out, h, g, 0, at, least[at], sizes, np.frombuffer(b"".join(chosen), np.uint8))
            if len(first):
                _offer(out, g % hash_groups, g, 1, np.diff(first, prepend=0), np.diff(text, prepend=0), number.astype(np.int32), np.empty(0, np.uint8))
        return pa.table({n: pa.array(out[n], t) for n, t in _OFFER.items()})

    def judged(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        offers = []
        for r in rows:
            if not r["kind"]:
                listed = _opened(r["c"], np.int32).astype(np.int64)
                counts, ends = (np.append(0, np.cumsum(x)).tolist() for x in (listed[:INDEXES], listed[INDEXES:]))
                data = zstandard.ZstdDecompressor().decompress(r["d"], max_output_size=1 << 31)
                offers.append((counts, ends, data, _opened(r["b"], np.int64), [], []))
        for part in range(INDEXES):
            strings, owners, numbers = {}, [], []
            for counts, ends, data, docs_of, _, _ in offers:
                a, b = counts[part], counts[part + 1]
                numbers.append(np.empty(b - a, np.int64))
                for i, doc in zip(range(a, b), docs_of[a:b].tolist()):
                    number = strings.setdefault(data[ends[i] : ends[i + 1]], len(strings))
                    if number == len(owners):
                        owners.append(doc)
                    elif doc < owners[number]:
                        owners[number] = doc
                    numbers[-1][i - a] = number
            if not strings:
                continue
            known = list(strings)
            index = RunLengthIndex(known, np.array(owners, np.int64), length)
            found = index.window_owners(known)
            lengths = np.fromiter(map(len, known), np.int64, len(known))
            starts = np.cumsum(lengths) - lengths
            windows = lengths - length + 1
            for own, (*_, made, owned) in zip(numbers, offers):
                n = windows[own]
                at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                made.append(n)
                owned.append(found[at])
        out = {name: [] for name in _OFFER}
        offered = iter(offers)
        for r in rows:
            if r["kind"]:
                for name in _OFFER:
                    out[name].append(r[name])
            else:
                *_, made, owned = next(offered)
                _offer(out, r["h"], r["g"], 0, _opened(r["a"], np.int64), np.concatenate(made), np.empty(0, np.int32), np.concatenate(owned).view(np.uint8))
        return pa.table({n: pa.array(out[n], t) for n, t in _OFFER.items()})

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _OUT.items()})
        own = Texts(left)
        taken = np.zeros(len(own.data), bool)  # starts of windows that go
        verdicts, places = [], []
        for r in right.to_pylist():
            (places if r["kind"] else verdicts).append(r)
        if places and verdicts:
            numbers = np.concatenate([_opened(r["a"], np.int64) for r in verdicts])
            counts = np.concatenate([_opened(r["b"], np.int64) for r in verdicts])
            owners = np.concatenate([_opened(r["d"], np.int64) for r in verdicts])
            place_of = np.empty(len(numbers), np.int64)
            place_of[numbers] = np.cumsum(counts) - counts
            count_of = np.empty(len(numbers), np.int64)
            count_of[numbers] = counts
            (r,) = places
            first, text = np.cumsum(_opened(r["a"], np.int64)), np.cumsum(_opened(r["b"], np.int64))
            number = _opened(r["c"], np.int32)
            n = count_of[number]
            for a in range(0, len(first), 1 << 17):
                part = slice(a, a + (1 << 17))
                own_n = n[part]
                within = np.arange(own_n.sum()) - np.repeat(np.cumsum(own_n) - own_n, own_n)
                owner = owners[np.repeat(place_of[number[part]], own_n) + within]
                start = np.repeat(first[part], own_n) + within
                taken[start[owner < np.repeat(own.docs[text[part]], own_n)]] = True
        begins = np.append(0, own.ends[:-1])
        blocks = np.flatnonzero(np.append(True, begins[1:] // CUT != begins[:-1] // CUT))
        n_removed, n_spans, kept = [], [], []
        for first, last in zip(blocks, np.append(blocks[1:], len(begins))):
            low, high = begins[first], own.ends[last - 1]
            # A window ends within its text, so nothing reaches into a block or a text from before.
            change = taken[low:high].astype(np.int8)
            change[length:] -= taken[low : high - length]
            covered = np.cumsum(change, dtype=np.int32) > 0
            opens = covered.copy()
            opens[1:] &= ~covered[:-1]
            at = begins[first:last] - low
            opens[at] = covered[at]  # a span ends with its text
            n_removed.append(np.add.reduceat(covered, at, dtype=np.int64))
            n_spans.append(np.add.reduceat(opens, at, dtype=np.int64))
            for a, b, n in zip(at.tolist(), (own.ends[first:last] - low).tolist(), n_removed[-1].tolist()):
                rest = own.data[low + a : low + b]
                rest = (rest[~covered[a:b]] if n else rest).tobytes()
                kept.append(hashlib.sha256(rest).hexdigest().encode() if digest else rest.decode("utf-8", "ignore").encode())
        return pa.table(
            {
                "key": pa.array(own.keys, pa.string()),
                "doc_id": pa.array(own.docs, pa.int64()),
                "n_removed": pa.array(np.concatenate(n_removed), pa.int64()),
                "n_spans": pa.array(np.concatenate(n_spans), pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    shared = (
        texts.groupBy("g").applyInArrow(anchors, "h int, g int, hashes binary, several binary")
        .groupBy("h").applyInArrow(repeated_anchors, "g int, hashes binary")
    )
    offer = ", ".join(f"{n} {'int' if t == pa.int32() else 'binary'}" for n, t in _OFFER.items())
    verdict = (
        texts.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(offered, offer)
        .groupBy("h").applyInArrow(judged, offer)
    )
    return texts.groupBy("g").cogroup(verdict.groupBy("g")).applyInArrow(
        removed, "key string, doc_id long, n_removed long, n_spans long, kept binary"
    )


#: kind 0: numbers, documents (then: window counts), lengths behind the counts by index, and bytes (then: owners) of pieces;
#: kind 1: where they stand.
_OFFER = {
    "h": pa.int32(), "g": pa.int32(), "kind": pa.int32(),
    "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "d": pa.binary(),
}
_OUT = {
    "key": pa.string(), "doc_id": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(),
}


def _offer(out: dict, h: int, g: int, kind: int, *arrays: np.ndarray) -> None:
    for name, value in zip(_OFFER, (h, g, kind, *map(_pressed, arrays))):
        out[name].append(value)


def _joined(docs: DataFrame, text: str, doc_id: str, length: int, anchor: int, digest: bool) -> DataFrame:
    """``docs`` with ``__n`` bytes, ``__short`` text and the marks of its text, where it is the first that has it."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = marked(own, length, anchor, digest).select(
        F.col("key").alias("__key"), F.col("doc_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in ("n_removed", "n_spans", "kept")]
    )
    value = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(value).cast("long")
    # Texts that nothing can be removed from: too short, or of no known order.
    free = (n < length) | F.col(doc_id).isNull()
    left = F.when(free, F.sha2(value, 256).cast("binary") if digest else value)
    keyed = docs.withColumns({"__n": n, "__free": left, "__key": F.md5(value), "__id": F.col(doc_id).cast("long")}).drop(text)
    return keyed.join(marks, ["__key", "__id"], "left")


def _outcome(joined: DataFrame, digest: bool) -> DataFrame:
    nothing = F.lit(hashlib.sha256(b"").hexdigest().encode() if digest else b"")
    free, known = F.col("__free").isNotNull(), F.col("__kept").isNotNull()
    return joined.withColumns(
        {
            "__kept": F.when(free, F.col("__free")).when(known, F.col("__kept")).otherwise(nothing),
            "__n_removed": F.when(free, F.lit(0)).when(known, F.col("__n_removed")).otherwise(F.col("__n")),
            "__n_spans": F.when(free, F.lit(0)).when(known, F.col("__n_spans")).otherwise(F.lit(1)),
        }
    )


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row.

    Null texts are empty; texts of less than ``length`` bytes lose nothing; rows without id neither lose bytes nor take
    them from others; rows of equal id are one document's and take nothing from each other; equal texts keep theirs in the
    smallest document only; an empty table gives an empty result. Texts are judged as they came, as bytes, whole.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = _outcome(_joined(own, "text", "doc_id", length, anchor, True), True)
    return made.select(
        "doc_id",
        F.col("__n").alias("n_bytes"),
        F.col("__n_removed").cast("long").alias("n_removed"),
        F.col("__n_spans").cast("long").alias("n_spans"),
        F.col("__kept").cast("string").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``docs``, its columns in their order, with the removed bytes gone from the text; characters of which a part was
    removed go whole, and null texts stay null. The same cases as ``digests``."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(text).isNotNull().alias("__there"))
    made = _outcome(_joined(held, names[text], names[doc_id], length, anchor, False), False)
    whole = F.when(F.col("__there"), F.col("__kept").cast("string"))
    return made.select(*[(whole if c == text else F.col(n)).alias(c) for c, n in names.items()])
