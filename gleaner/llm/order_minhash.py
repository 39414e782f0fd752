"""Document fingerprints by Order MinHash. DataFrame expressions only, and one shuffle of the texts.

A text is cut into tokens (runs of other than blanks, of at most ``TOKEN`` characters each, so that texts without blanks
have tokens too); its k-mers are ``K`` consecutive tokens, numbered by occurrence, so that a second occurrence is another
element. Every numbered k-mer is hashed once; some bits of the hash deal it to one of ``SLOTS`` slots (one-permutation
hashing). In each slot the ``TUPLE`` least hashes are taken, put back into the order of the text, and hashed together: the
signature agrees in a slot only if both texts have the same minimal k-mers there in the same order, which is what makes it
sensitive to edit distance. The likeness of two fingerprints is the share of equal slots among those that either has.

The expressions walk a text a constant number of times: the k-mers are sorted as packed longs (hash, position), runs of
equal hashes give the occurrence numbers, and a second sort (slot, hash, position) brings the minima of each slot together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.text import let

TOKEN = 8
K = 2
#: A power of two, at most 2 ** 10.
SLOTS = 64
TUPLE = 2
#: Bits of a packed long that hold the position; positions beyond start anew.
PLACE_BITS = 24
#: Documents per range of ids when neighbours are looked up, and ranges at most (beyond, they hold more documents).
RANGE_ROWS = 2_000
MAX_RANGES = 100_000

_PLACE = (1 << PLACE_BITS) - 1


def _head(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE_BITS)


def entries(text: Column) -> Column:
    """The slots a text fills, in order, each as 12 hex digits (slot, tuple hash); null counts as empty."""
    slot_bits = SLOTS.bit_length() - 1
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\s]{{1,{TOKEN}}}"), F.lit(0))
    clear = F.lit((1 << 63) - 1 - _PLACE)

    def packed(h: Column, place: Column) -> Column:
        return h.bitwiseAND(clear).bitwiseOR(place.cast("long").bitwiseAND(F.lit(_PLACE)))

    def kmers(t: Column) -> Column:
        last = F.greatest(F.size(t) - K, F.lit(0))
        return F.when(F.size(t) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda i: packed(F.xxhash64(*[F.get(t, i + j) for j in range(K)]), i),
            )
        )

    def numbered(s: Column) -> Column:
        """Sorted (hash, position) → (slot and hash of the numbered k-mer, position): the n-th of a run is number n."""
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (_head(F.get(s, i)) != _head(F.get(s, i - 1)))
        )
        return let(
            starts,
            lambda b: F.flatten(
                F.transform(
                    b,
                    lambda first, r: F.transform(
                        F.slice(s, first + 1, F.coalesce(F.get(b, r + 1), F.size(s)) - first),
                        lambda x, n: packed(F.xxhash64(_head(x), n), x),
                    ),
                )
            ),
        )

    def slot(x: Column) -> Column:
        return F.shiftrightunsigned(x, 63 - slot_bits)

    def fields(m: Column) -> Column:
        """Sorted numbered k-mers → one field per filled slot."""
        firsts = F.filter(
            F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (slot(F.get(m, i)) != slot(F.get(m, i - 1)))
        )

        def field(i: Column) -> Column:
            least = F.filter(F.slice(m, i + 1, TUPLE), lambda x: slot(x) == slot(F.get(m, i)))
            in_order = F.sort_array(F.transform(least, lambda x: F.struct(x.bitwiseAND(F.lit(_PLACE)).alias("at"), _head(x).alias("h"))))
            joined = F.xxhash64(F.transform(in_order, lambda x: x["h"]))
            return F.concat(
                F.lpad(F.hex(slot(F.get(m, i))), 3, "0"), F.lpad(F.hex(F.shiftrightunsigned(joined, 28)), 9, "0")
            )

        return F.transform(firsts, field)

    none = F.array().cast("array<string>")
    made = let(
        F.sort_array(let(tokens, kmers)),
        lambda s: F.when(F.size(s) == 0, none).otherwise(let(F.sort_array(numbered(s)), fields)),
    )
    return made


def fingerprint(slots: Column) -> Column:
    return F.array_join(slots, "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those that either fills; 1 for two texts without tokens."""
    either = F.size(F.array_union(F.transform(a, lambda x: F.substring(x, 1, 3)), F.transform(b, lambda x: F.substring(x, 1, 3))))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def with_fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``slots`` and ``fingerprint`` of whole texts (null and empty: none, the empty string). Equal texts have equal
    fingerprints; a narrow map; columns of these names are replaced."""
    made = df.withColumn("slots", entries(F.col(text)))
    return made.withColumn("fingerprint", fingerprint(F.col("slots")))


def with_next(df: DataFrame, order: str, values: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``next_<value>`` of the row that follows in descending ``order`` (nulls last; after the last: the first).

    Ids are cut into ranges at quantiles; each range is one window partition, which also gets a copy of the next range's
    first row, so the rows are shuffled once and no window spans the table. Rows of equal id follow each other in an
    order by the hash of their values.
    """
    spark = df.sparkSession
    # Two passes over the id column alone: the count, then the range bounds.
    total = df.count()
    n = min(MAX_RANGES, max(1, -(-total // range_rows)))
    bounds = []
    if n > 1:
        shares = F.lit(",".join(str(i / n) for i in range(1, n)))
        found = df.agg(F.percentile_approx(order, F.split(shares, ",").cast("array<double>"), 100 * n)).first()[0]
        bounds = sorted(set(found or []))
    # Ranges are numbered from 1 by the bounds at or below an id; ids that are null are in range 0.
    number = F.coalesce(1 + _bounds_below(F.col(order), bounds), F.lit(0))
    ranged = df.withColumn("__range", number)
    tops = {r["__range"]: r["top"] for r in ranged.groupBy("__range").agg(F.max(order).alias("top")).collect()}
    down = sorted(tops, reverse=True)
    # (range that hands out its first row, range whose last row needs it)
    handed = [(giver, taker) for giver, taker in zip(down[1:] + down[:1], down)]
    gives = spark.createDataFrame(
        [(giver, tops[giver], taker) for giver, taker in handed] or [(None, None, None)],
        "__range int, __top long, __taker int",
    )
    # One row per range: bounded by the number of ranges, each of which holds about ``range_rows`` documents.
    placed = ranged.join(F.broadcast(gives), "__range", "left")
    copy = F.col(order).eqNullSafe(F.col("__top"))
    placed = placed.withColumn(
        "__at",
        F.explode(
            F.when(
                copy,
                F.array(
                    F.struct(F.col("__range").alias("range"), F.lit(0).alias("copy")),
                    F.struct(F.col("__taker").alias("range"), F.lit(1).alias("copy")),
                ),
            ).otherwise(F.array(F.struct(F.col("__range").alias("range"), F.lit(0).alias("copy"))))
        ),
    )
    tie = F.xxhash64(*[F.col(v) for v in values])
    window = Window.partitionBy(F.col("__at.range")).orderBy(F.col("__at.copy"), F.col(order).desc_nulls_last(), tie)
    following = placed.withColumns({f"next_{v}": F.lead(v).over(window) for v in values})
    return following.where(F.col("__at.copy") == 0).drop("__range", "__top", "__taker", "__at")


def _bounds_below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below the value (null for null), by binary search in a constant array."""
    if not bounds:
        return F.when(value.isNotNull(), F.lit(0))
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    reached = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= value, at + step).otherwise(at))
    return F.when(value.isNotNull(), reached)


def compare_with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every whole text and of its edited text (the last half of its code points replaced by as many
    first ones of the next document, in descending ``doc_id``), and the likenesses to both neighbours.

    Returns ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``. Null texts are empty;
    a single row is its own neighbour; rows without id come last; repeated rows are neighbours of each other; an empty
    table stays empty.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("slots", entries(F.col("text")))
    paired = with_next(own, "doc_id", ["text", "slots"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.left(F.col("next_text"), half))
    made = paired.withColumns({"n_chars": n.cast("long"), "edited": edited})
    made = made.select("doc_id", "n_chars", "edited", "slots", "next_slots", entries(F.col("edited")).alias("edited_slots"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited",
        fingerprint(F.col("slots")).alias("fingerprint"),
        fingerprint(F.col("edited_slots")).alias("edited_fingerprint"),
        likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"),
        likeness(F.col("slots"), F.col("next_slots")).alias("near_next"),
    )
