"""Substring joins without a cross join.

``contains_join`` pairs every haystack with every needle it contains. Needles of three or more characters are anchored
on one of their 3-grams, so the join is an equi join on grams followed by an exact check; shorter needles are anchored
on their whole text against the haystack's 1- or 2-grams. The result is exact for any input size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.session import bounded_broadcast, fits_broadcast, materialise

GRAM = 3
#: Keys of either side that meet at one link in one place.
TILE = 4096


def grams(text: Column, *sizes: int) -> Column:
    """Distinct character n-grams of a text for the given sizes.

    The text is cut into characters once; taking substrings by position would walk it from the start each time.
    """

    def starting(chars: Column, size: int):
        return lambda i: F.concat(*[F.get(chars, i + offset) for offset in range(size)])

    def build(chars: Column) -> Column:
        parts = []
        for size in sizes:
            starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - size, F.lit(0)))
            found = chars if size == 1 else F.transform(starts, starting(chars, size))
            parts.append(F.when(F.size(chars) >= size, found).otherwise(F.array().cast("array<string>")))
        return F.array_distinct(parts[0] if len(parts) == 1 else F.concat(*parts))

    return tx.let(F.split(text, ""), build)


def anchor(needle: Column, max_size: int = GRAM) -> Column:
    """The gram a needle is looked up by: its middle, which avoids the frequent prefixes and suffixes of a language."""
    size = F.least(F.length(needle), F.lit(max_size))
    start = F.floor((F.length(needle) - size) / 2).cast("int") + 1
    return F.substring(needle, start, size)


def anchor_by_rarity(needles: DataFrame, needle: str = "needle", size: int = GRAM) -> DataFrame:
    """Add ``_gram``: for each needle its gram shared with the fewest other needles (the whole needle if shorter).

    Meant for small needle tables. It spreads needles evenly over grams, so a probe meets few false candidates.
    """
    each = needles.withColumn(
        "_gram", F.explode(F.when(F.length(needle) <= size, F.array(needle)).otherwise(grams(F.col(needle), size)))
    )
    shared = each.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    best = each.join(shared, "_gram").groupBy(*needles.columns)
    return best.agg(F.min(F.struct("_n", "_gram")).alias("_best")).select(
        *needles.columns, F.col("_best._gram").alias("_gram")
    )


def all_grams(text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    return grams(text, *sizes)


def word_grams(word: Column) -> Column:
    """Grams under which a needle may find a word: the whole word when it is that short, else its 2- and 3-grams."""
    return F.when(F.length(word) <= 2, F.array(word)).otherwise(grams(word, 2, 3))


def contains_join(
    haystacks: DataFrame,
    needles: DataFrame,
    haystack: str = "haystack",
    needle: str = "needle",
    sizes: tuple[int, ...] = (1, 2, 3),
    small: str = "needles",
) -> DataFrame:
    """All ``(haystack, needle)`` pairs with the needle inside the haystack, keeping both sides' columns.

    Both inputs should hold distinct strings; join wide rows back by string afterwards. ``sizes`` are the gram sizes
    that occur among the needles (the largest stands for itself and more) and ``small`` names the side whose size is
    checked for a broadcast. Broadcast needles are checked where their gram meets the haystack, so no candidate leaves
    its task. Otherwise a gram row holds the haystack's 128-bit id, not its text; texts come back by id for the
    candidates alone. That costs a row for each candidate: cut long haystacks into words first (``contained_words``).
    A needle carries a single gram, so a gram found in a third of all haystacks costs that many probes and never a
    product of two large groups; without a broadcast AQE splits the hot gram.
    """
    text = F.col(haystack)
    right = needles.filter(F.length(needle) >= min(sizes))
    if small == "needles" and max(sizes) >= GRAM:
        right = anchor_by_rarity(right, needle, max(sizes))
        if fits_broadcast(right):
            left = haystacks.withColumn("_gram", F.explode(all_grams(text, sizes)))
            return left.join(F.broadcast(right), "_gram").filter(F.contains(text, F.col(needle))).drop("_gram")
    else:
        right = right.withColumn("_gram", anchor(F.col(needle), max(sizes)))
    named = haystacks.withColumns({"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.reverse(text))})
    left = named.select("_h1", "_h2", F.explode(all_grams(text, sizes)).alias("_gram"))
    if small != "needles":
        left = bounded_broadcast(left)
    candidates = left.join(right, "_gram").drop("_gram")
    found = candidates.join(named, ["_h1", "_h2"]).filter(F.contains(text, F.col(needle)))
    return found.drop("_h1", "_h2")


def possible_needles(needles: DataFrame, haystacks: DataFrame, haystack: str = "haystack", needle: str = "needle") -> DataFrame:
    """The needles that are no longer than the longest haystack and have no more runs of blanks than any haystack has:
    for phrases out of whole texts sought in titles, which leaves few to index and broadcast."""

    def blanks(text: str) -> Column:
        return F.regexp_count(text, F.lit(r"\s+"))

    longest, most = haystacks.agg(F.max(F.length(haystack)), F.max(blanks(haystack))).first()
    return needles.filter((F.length(needle) <= (longest or 0)) & (blanks(needle) <= (most or 0)))


def contained_words(words: DataFrame, needles: DataFrame, word: str = "word", needle: str = "needle", size: int = GRAM) -> DataFrame:
    """``contains_join`` for a vocabulary: all ``(word, needle)`` pairs, needles of ``size`` or more characters.

    Words are short, so they travel with their grams and candidates are checked where they meet, broadcast or not.
    """
    right = bounded_broadcast(anchor_by_rarity(needles.filter(F.length(needle) >= size), needle, size))
    left = words.withColumn("_gram", F.explode(grams(F.col(word), size)))
    return left.join(right, "_gram").filter(F.contains(F.col(word), F.col(needle))).drop("_gram")


def linked_pairs(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str], link: str) -> DataFrame:
    """Every pair of a left and a right key that have a ``link`` in common, once; ``(*left_key, *right_key)``.

    Rows are a key and one of its links. The pairs may be as many as left times right keys, so they are written from the join
    where they arise: a pair comes from the least of its common links only, which takes no comparison with other pairs.
    Keys that meet at one link are cut into tiles of about ``TILE`` by ``TILE``, so a frequent link is spread over tasks, and
    what is shuffled follows the rows.
    """
    spark = left.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def side(rows: DataFrame, key: Sequence[str], name: str) -> DataFrame:
        links = rows.groupBy(*key).agg(F.array_sort(F.collect_set(link)).alias("_links"))
        each = links.select(*key, "_links", F.posexplode("_links").alias("_at", "_link"))
        return materialise(each.select(*key, "_link", F.slice("_links", F.lit(1), F.col("_at")).alias(f"_before_{name}")))

    def tiles(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("_link").agg(F.ceil(F.count(F.lit(1)) / TILE).alias(f"_{name}"))

    lefts, rights = side(left, left_key, "left"), side(right, right_key, "right")
    sizes = bounded_broadcast(materialise(tiles(lefts, "left").join(tiles(rights, "right"), "_link")))

    def dealt(rows: DataFrame, key: Sequence[str], name: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64(*key), F.col(f"_{name}")).alias(f"_tile_{name}")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_{other}") - 1)).alias(f"_tile_{other}")
        rows = rows.join(sizes, "_link").select(*key, "_link", f"_before_{name}", own, every)
        return rows.repartition(partitions, "_link", "_tile_left", "_tile_right")

    found = dealt(lefts, left_key, "left", "right").hint("merge").join(
        dealt(rights, right_key, "right", "left"), ["_link", "_tile_left", "_tile_right"]
    )
    return found.filter(~F.arrays_overlap("_before_left", "_before_right")).select(*left_key, *right_key)
