"""Token counts against the tokenizers library, the codec against tiktoken piece by piece and against exact round trips."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from gleaner.llm import byte_bpe, token_counts
from gleaner.llm.token_pattern import pre_tokenizer, pre_tokens
from tests.llm.helpers import as_set, documents, odd_rows

ODD = ["", "a" * 5000, "aaa <|endoftext|> b<|endoftext|>", "\x1c \x85  x  y\n\n z", "'s's 'll", " " * 30_000 + "x",
       "x" + " " * 30_000, "²½x Ⅷ_a", "é" * 300 + "1" * 300 + "!" * 300, "don't DON'T 'sx"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_equal_the_library(spark, library):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abé1! \n'sT東") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    rows = [*enumerate(texts), (500, None), *odd_rows()]
    got = token_counts.count_tokens(documents(spark, rows), limit=10)
    assert got.columns.count("n_tokens") == 1
    want = []
    for doc_id, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 10))
    assert as_set(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_plain_pattern_is_the_pattern():
    rng = random.Random(6)
    for text in ODD + ["".join(chr(rng.choice([32, 39, 65, 115, 49, 95, 0xB2, 0x1C, 0x85, 0x3000, 0x660, 0x301])) for _ in range(80)) for _ in range(200)]:
        assert pre_tokens(text) == pre_tokenizer().findall(text)


def test_codec_encodes_each_match_separately(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = byte_bpe.Codec(path, public_tokenizers.PATTERN)
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(path, "rb"))}
    rows = [*enumerate(ODD), (90, ("lorem ipsum 12,5\n" * 20_000) + "z" * 100_000), (91, "\u3000" * 20_000 + "x"), *odd_rows(2)]

    def merged(piece: bytes) -> list[int]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    want = []
    for doc_id, text in rows:
        ids, known = [], {}
        for piece in regex.findall(public_tokenizers.PATTERN, text or ""):
            if piece not in known:
                known[piece] = merged(piece.encode()) if len(piece) < 400 else codec.encoding._encode_single_piece(piece.encode())
            ids += known[piece]
        listed = ",".join(map(str, ids)).encode()
        want.append((doc_id, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = byte_bpe.round_trip_digests(documents(spark, rows))
    assert as_set(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    back = byte_bpe.decode(byte_bpe.encode(documents(spark, odd_rows(2))))
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())
    assert byte_bpe.encode(documents(spark, [])).count() == 0


def test_stretches_join_to_the_text():
    codec = byte_bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "ab cd\n" * 40_000
    stretches = codec.stretches(text)
    assert "".join(stretches) == text and len(stretches) > 2
    assert codec.encode(text) == codec.encoding.encode_ordinary(text)
