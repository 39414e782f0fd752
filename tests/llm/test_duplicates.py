"""SimHash, run-length index, substring removal and Order MinHash against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import components, order_minhash, simhash, substring_dedup
from gleaner.llm.run_length_index import NOBODY, RunLengthIndex
from tests.llm.helpers import as_set, documents, odd_rows, prose


def plain_fingerprint(text, n=4):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
         .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = [prose(rng, 120) for _ in range(5)]
    rows = odd_rows(3, 10)
    for i in range(60):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w)))
    got = simhash.near_duplicates(documents(spark, rows))
    prints = [plain_fingerprint(t) for _, t in rows]
    n = len(rows)
    root = closure(range(n), [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root[i]] = min(least.get(root[i], doc_id), doc_id)
    want = [(d, f"{prints[i]:016x}", least.get(root[i])) for i, (d, _) in enumerate(rows)]
    assert as_set(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("tile", [7, 2048])
def test_links_connect_what_is_within_the_radius(spark, tile):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 12, np.uint64)
    prints = {0, (1 << 64) - 1}
    for _ in range(300):
        f = int(rng.choice(seeds))
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            f ^= 1 << int(b)
        prints.add(f)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p, p) for p in signed], "node long, fp long")
    found = {r["node"]: r["component"] for r in components.connected(simhash.link_forest(nodes, tile=tile)).collect()}
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    want = closure(signed, pairs)
    assert {s: found.get(s, s) for s in signed} == want


def test_counters_and_planes():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 62, 300, np.uint64)
    f[150:] = f[:150] ^ np.uint64(0b1011)
    planes = simhash.Planes(f)
    for lag in (1, 64, 150, 299):
        asked = simhash.pack(np.arange(300) < 300 - lag, planes.words)
        bits = np.unpackbits(planes.within(lag, asked, 3).astype("<u8").view(np.uint8), bitorder="little")[:300]
        want = [i + lag < 300 and (int(f[i]) ^ int(f[i + lag])).bit_count() <= 3 for i in range(300)]
        assert bits.astype(bool).tolist() == want


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{1000 + i: 1000 for i in range(1, 50)}}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(150):
        alphabet = rng.choice([b"ab", b"abc", b"\x00a\xf4"])
        window = rng.choice([8, 9, 12, 17])
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        owners = np.array([rng.randint(0, 9) for _ in strings])
        index = RunLengthIndex(strings, owners, window)
        patterns = [bytes(rng.choice(alphabet + b"z") for _ in range(rng.randint(1, 25))) for _ in range(4)] + strings[:2]
        lengths, _ = index.matching_statistics(patterns)
        judged = index.window_owners(patterns)
        k = 0
        for p in patterns:
            for i in range(len(p)):
                n = 0
                while i + n < len(p) and any(p[i : i + n + 1] in s for s in strings):
                    n += 1
                w = p[i : i + window]
                owner = min([int(o) for s, o in zip(strings, owners) if len(w) == window and w in s], default=NOBODY)
                assert (lengths[k], judged[k]) == (n, owner)
                k += 1


def brute_removal(rows, length=50):
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1 if doc_id is not None else 0):
            w = data[i : i + length]
            first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1 if doc_id is not None else 0):
            if first[data[i : i + length]] < doc_id:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, kept))
    return out


@pytest.mark.parametrize("group", [3_000, 1 << 22])
def test_substring_removal(spark, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "TEXT_GROUP", group)
    monkeypatch.setattr(substring_dedup, "HASH_GROUP", group)
    rng = random.Random(group)
    passages = [prose(rng, rng.randint(5, 40)) for _ in range(10)]
    rows = odd_rows(5, 10)
    for _ in range(80):
        text = " ".join(rng.choice(passages + [prose(rng, 10)] * 6) for _ in range(rng.randint(0, 4)))
        if text and rng.random() < 0.4:
            k = rng.randrange(len(text))
            text = text[:k] + "Z" + text[k + 1 :]
        rows.append((rng.randint(0, 60), text))
    rows += [(998, "x" * 200), (999, "x" * 49), (1000, "x" * 50), (1001, "y" * 49), (1002, "y" * 49)]
    docs = documents(spark, rows)
    want = brute_removal(rows)
    got = as_set(substring_dedup.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted([(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in want], key=repr)
    texts = substring_dedup.without_repeats(docs)
    assert texts.columns == docs.columns
    kept = [(d, None if t is None else k.decode("utf-8", "ignore")) for (d, t), (*_, k) in zip(rows, want)]
    assert as_set(texts, "doc_id", "text") == sorted(kept, key=repr)
    assert substring_dedup.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("indexes", "cut"), [(1, 1 << 20), (5, 700)])
def test_substring_removal_in_small_steps(spark, monkeypatch, indexes, cut):
    monkeypatch.setattr(substring_dedup, "INDEXES", indexes)
    monkeypatch.setattr(substring_dedup, "CUT", cut)
    monkeypatch.setattr(substring_dedup, "TEXT_GROUP", 1 << 24)
    rng = random.Random(indexes)
    passages = [prose(rng, 30) for _ in range(6)] + ["z" * 50]
    rows = [(i, " ".join(rng.sample(passages, rng.randint(0, 3)) + [prose(rng, 12)])) for i in range(60)] + [(100, "z" * 50), (101, "z" * 51)]
    got = as_set(substring_dedup.digests(documents(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted([(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute_removal(rows)], key=repr)


def test_messages_between_groups():
    """With a partition for each 16 MB of text, there are no more groups than partitions."""
    for size in (1 << 30, 10 << 30):
        texts, hashes = substring_dedup.group_numbers(size, size >> 24)
        assert texts * hashes <= (size >> 24) ** 2


def test_index_searches_runs_only_for_other_bytes(monkeypatch):
    rng = random.Random(2)
    strings = list({"".join(rng.choice("abcd") for _ in range(60)).encode() for _ in range(300)})
    index = RunLengthIndex(strings, np.arange(len(strings)), 50)
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, **kw: (searched.append(np.size(v) if a is index.key else 0), search(a, v, **kw))[1])
    assert (index.window_owners(strings)[::60] == np.arange(len(strings))).all()
    assert sum(searched) < sum(map(len, strings)) / 2


def plain_entries(text):
    """Slots by the operator's own hashes, but with dictionaries and sorting in Python."""
    import re

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    tokens = re.findall(r"[^\t\n\x0b\f\r ]{1,8}", text or "")
    if not tokens:
        return []
    k = order_minhash.K
    kmers = [tuple((tokens[i + j] if i + j < len(tokens) else None) for j in range(k)) for i in range(max(1, len(tokens) - k + 1))]
    schema = ", ".join(f"t{j} string" for j in range(k))
    hashes = [r[0] for r in spark.createDataFrame(kmers, schema).select(F.xxhash64(*[f"t{j}" for j in range(k)])).collect()]
    clear = (1 << 63) - 1 - ((1 << 24) - 1)
    seen, numbered = {}, []
    for i, h in enumerate(hashes):
        head = (h & clear) >> 24
        numbered.append((head, seen.get(head, 0), i))
        seen[head] = seen.get(head, 0) + 1
    rows = spark.createDataFrame([(a, b) for a, b, _ in numbered], "a long, b int").select(F.xxhash64("a", "b")).collect()
    slots = {}
    for (_, _, i), (h,) in zip(numbered, rows):
        slots.setdefault((h & clear) >> 57, []).append(((h & clear) >> 24, i))
    out = []
    for s in sorted(slots):
        least = sorted(sorted(slots[s])[: order_minhash.TUPLE], key=lambda x: x[1])
        h = spark.createDataFrame([([x[0] for x in least],)], "a array<long>").select(F.xxhash64("a")).first()[0]
        out.append(f"{s:03X}{((h & (1 << 64) - 1) >> 28):09X}")
    return out


def test_order_minhash_entries(spark):
    texts = ["", None, "one", "a b a b a b c", "x" * 100, "the quick brown fox " * 5, " \n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["s"] for r in df.select("i", order_minhash.entries(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_entries(t), t


@pytest.mark.parametrize("range_rows", [4, 2_000])
def test_order_minhash_neighbours(spark, monkeypatch, range_rows):
    monkeypatch.setattr(order_minhash.with_next, "__defaults__", (range_rows,))
    rng = random.Random(1)
    rows = [(i * 7 - 20, prose(rng, rng.randint(0, 50))) for i in range(40)] + [(1000, ""), (1001, None), (1002, "é\U0001F600x")]
    got = {r["doc_id"]: r for r in order_minhash.compare_with_next(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited"] == text[: len(text) - half] + following[:half]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len({r["fingerprint"] for r in got.values() if not (r["n_chars"])}) == 1
    long = [r for r in got.values() if r["n_chars"] > 100]
    assert sum(r["near_edited"] for r in long) > 2 * sum(r["near_next"] for r in long)
    one = order_minhash.compare_with_next(documents(spark, [(5, "a b c d")])).collect()
    assert [(r["edited"], r["near_next"]) for r in one] == [("a b a b"[:4] + "a b c d"[:3], 1.0)]
    assert order_minhash.compare_with_next(documents(spark, [])).count() == 0
    assert order_minhash.compare_with_next(documents(spark, odd_rows())).count() == len(odd_rows())


def test_anchors_travel_once_a_group_of_texts():
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(300))
    alone = ["x" * 5000, "".join(rng.choice("ijkl") for _ in range(400)) * 3]  # repeat themselves, no other text
    groups = {0: [shared + str(i) * 60 for i in range(9)] + alone[:1], 1: alone[1:], 2: ["-" * 70 + shared]}
    sent, places = [], {}
    for g, texts in groups.items():
        table = pa.table({"g": [g] * len(texts), "key": [str(i) for i in range(len(texts))], "doc_id": list(range(len(texts))),
                          "text": pa.array([t.encode() for t in texts], pa.binary())})
        hashes, _, _, text = substring_dedup.Texts(table).pieces(50, 20)
        for h, t in zip(substring_dedup._short(hashes).tolist(), text.tolist()):
            places.setdefault(h, set()).add((g, t))
        made = substring_dedup.sent_anchors(table, 3, 50, 20)
        out = [h for b in made["hashes"].to_pylist() for h in substring_dedup._as_hashes(b).tolist()]
        assert sorted(out) == sorted(set(substring_dedup._short(hashes).tolist()))
        sent.append(made)
    sent, got = pa.concat_tables(sent), set()
    for h in set(sent["h"].to_pylist()):
        for r in substring_dedup.repeated_anchors(sent.filter(pc.equal(sent["h"], h))).to_pylist():
            got |= {(r["g"], x) for x in substring_dedup._as_hashes(r["hashes"]).tolist()}
    assert got == {(g, h) for h, at in places.items() if len(at) > 1 for g, _ in at}
