"""Shards against a plain heap, with groups that stay together, hot groups, ties and gapless slots."""

import heapq
import random
import zlib
from collections import Counter

import pytest

from gleaner.llm import sharding
from tests.llm.helpers import documents, odd_rows


@pytest.mark.parametrize("seed", range(200))
def test_runs_are_dealt_like_single_groups(seed):
    rng = random.Random(seed)
    shards = rng.randint(1, 9)
    schedule, heap = sharding.Schedule(shards), [(0, s) for s in range(shards)]
    for size in sorted({rng.randint(1, 60) for _ in range(12)}, reverse=True):
        count, want = rng.randint(1, 60), [0] * shards
        for _ in range(count):
            load, s = heapq.heappop(heap)
            want[s] += 1
            heapq.heappush(heap, (load + size, s))
        assert schedule.deal(size, count) == want
        assert schedule.loads == {s: load for load, s in heap}


def plain(rows, shards=8):
    """Loads of the plain schedule."""
    groups = Counter()
    for _, text in rows:
        groups[text or ""] += len((text or "").encode()) + 1
    loads = [0] * shards
    for size in sorted(groups.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    return loads


def check(rows, placed, shards=8):
    got = placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert len(got) == len(rows)
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r[0], r[1], r[2]) for r in got) == sizes
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    loads, slots, homes = [0] * shards, {}, {}
    for r in got:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
        homes.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert loads == plain(rows, shards)
    assert all(len(h) == 1 for h in homes.values())
    for own in slots.values():
        own.sort(key=lambda s: s[0])
        assert [s for s, _ in own] == list(range(len(own)))
        ids = [i for _, i in own]
        assert ids == sorted(ids, key=lambda i: (i is None, i or 0))


def test_odd_rows(spark):
    rows = odd_rows(2, 60)
    df = documents(spark, rows).selectExpr("*", "1 AS size", "2 AS slot", "3 AS same", "4 AS row", "5 AS at", "6 AS part")
    placed = sharding.place(df.repartition(3))
    assert placed.columns.count("size") == 1 and {"same", "row", "at", "part", "text", "n_tokens"} <= set(placed.columns)
    check(rows, placed)


def test_hot_group_and_equal_sizes(spark):
    rng = random.Random(8)
    rows = [(i if i % 7 else None, "the same footer") for i in range(400)]
    rows += [(1000 + i, f"{rng.randint(0, 9999):04d}" * rng.choice([1, 1, 1, 5])) for i in range(800)]
    rng.shuffle(rows)
    check(rows, sharding.place(documents(spark, rows).repartition(5), keep=["doc_id"]))
    check(rows, sharding.place(documents(spark, rows), shards=3), 3)


def test_hot_value_is_spread_over_parts(spark):
    rows = documents(spark, [(i, "x") for i in range(4000)], extra=False).selectExpr("doc_id", "1 AS same")
    dealt, parts = sharding.numbered(rows, "same", [rows["doc_id"]])
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    assert sorted(r["before"] for r in parts.collect())[0] == 0


def test_small_tables(spark):
    assert sharding.place(documents(spark, [])).count() == 0
    check([(5, None)], sharding.place(documents(spark, [(5, None)])))


def test_written_shards(spark, tmp_path):
    rows = odd_rows(4, 20)
    sharding.write_shards(documents(spark, rows, extra=False), str(tmp_path / "shards"), shards=4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(rows)
