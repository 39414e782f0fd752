"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Whole texts are encoded, without special tokens. The library's regex engine works on a bounded stretch at a time: long
texts are cut first at boundaries no pattern match can cross (an ASCII letter followed by a blank or a line break), and
very long runs of white space, which overflow the engine's stack, are handed over as the single match they are.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.llm.common import with_columns_from_text

#: Characters per stretch given to the library at once.
STRETCH = 1 << 16
#: White space runs of this length and more are taken out of the text before the library's regex sees them.
LONG_BLANKS = 10_000

_BOUNDARY = re.compile(r"[A-Za-z](?=[ \n])")
_BLANKS = regex.compile(r"\p{White_Space}{%d,}" % LONG_BLANKS)

SCHEMA = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


class Codec:
    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimal = {rank: str(rank) for rank in ranks.values()}

    def stretches(self, text: str) -> list[str]:
        """``text`` cut at safe boundaries into stretches of about ``STRETCH`` characters; their concatenation is it."""
        out, start = [], 0
        while len(text) - start > STRETCH:
            cut = _BOUNDARY.search(text, start + STRETCH)
            if cut is None:
                break
            out.append(text[start : cut.end()])
            start = cut.end()
        out.append(text[start:])
        return out

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG_BLANKS:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        start = 0
        for run in _BLANKS.finditer(text):
            # The run without its last character is one match, unless the text ends with the run.
            end = run.end() if run.end() == len(text) else run.end() - 1
            for stretch in self.stretches(text[start : run.start()]):
                ids += self.encoding.encode_ordinary(stretch)
            ids += self.encoding._encode_single_piece(text[run.start() : end].encode())
            start = end
        for stretch in self.stretches(text[start:]):
            ids += self.encoding.encode_ordinary(stretch)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


@functools.lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def _settings(rank_file: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(df: DataFrame, text: str = "text", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``n_tokens`` and ``ids`` of whole texts.

    Null and empty texts give no tokens; repeated rows and ties are independent rows; an empty table stays empty;
    columns named like the new ones are replaced. The rank file is read on the workers, by path.
    """

    def rows_of(texts):
        use = codec(*_settings(rank_file, pattern))
        return [(len(ids), ids) for ids in map(use.encode, texts)]

    return with_columns_from_text(df, rows_of, SCHEMA, text)


def decode(df: DataFrame, ids: str = "ids", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``decoded`` (bytes of the token ids; null ids give no bytes); a column of that name is replaced."""
    import pyarrow as pa
    from collections.abc import Iterator

    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        use = codec(*_settings(rank_file, pattern))
        for batch in batches:
            yield pa.array([use.decode(v.as_py() or []) for v in batch], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn("decoded", F.arrow_udf(run, T.BinaryType())(F.col(ids)))


def round_trip_digests(
    df: DataFrame, text: str = "text", rank_file: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Encode and decode every text in one pass, keeping only the count and the digests of ids and decoded bytes.

    The same cases as ``encode``; the digests of an empty text are those of no bytes.
    """

    def rows_of(texts):
        use = codec(*_settings(rank_file, pattern))
        names = use.decimal
        for text in texts:
            ids = use.encode(text)
            listed = ",".join([names[i] for i in ids])
            yield (
                len(ids),
                hashlib.sha256(listed.encode()).hexdigest(),
                hashlib.sha256(use.decode(ids)).hexdigest(),
            )

    return with_columns_from_text(df, rows_of, DIGESTS, text)
