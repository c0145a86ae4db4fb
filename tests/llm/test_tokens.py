import random

import numpy as np
import pytest

from lineloom.llm import bpe, token_counts
from lineloom.llm.registry import vocabulary_path

BYTES, PIECES = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "a", "b", "the", "ing", "'", "'s", "1", "é", "\x85", "\xa0", "\x1c", "日", "!", "\t", "<|endoftext|>", "<s>", "²", "​", "▁", "🙂", "\x00"]
FIXED = ["", " ", "  a", "a  ", "a \n b", "don't I'll 's", "½ ² a1b2", "日本語 一二三", "a" * 3000, "ab" * 700, "Ⅷ ١٢٣", "<|endoftext|> b <|endof", " " * 5000, "▁a ▁▁b", "abcd" * 900 + " " * 2500]


def texts():
    random.seed(4)
    return FIXED + ["".join(random.choices(PARTS, k=random.randint(1, 40))) for _ in range(3000)]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(BYTES), bpe.vocabulary(BYTES)
    for t, e in zip(texts(), lib.encode_batch(texts(), add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == e.ids, t
        assert own.decode(own.encode(t)) == lib.decode(e.ids, skip_special_tokens=False) == t


def test_decode_of_broken_bytes():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(BYTES), bpe.vocabulary(BYTES)
    random.seed(5)
    for _ in range(300):
        ids = [random.randrange(50_257) for _ in range(random.randint(0, 30))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids, skip_special_tokens=False)


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    small, large = bpe.Bpe(BYTES), bpe.vocabulary(BYTES)
    assert all(small.encode(t) == large.encode(t) for t in texts()[:300])


def test_counts_equal_the_library(monkeypatch):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [len(x) for x in lib.encode(texts())]
    assert token_counts.counter(PIECES).count_texts(texts()) == want
    monkeypatch.setattr(token_counts, "CACHE", 100)
    assert token_counts.PieceCounter(PIECES).count_texts(texts()) == want


def test_very_long_pre_tokens_equal_the_library():
    """Rounds apply a rank at once, and wait where a new pair comes first."""
    import sentencepiece

    random.seed(9)
    long = ["a" * 5001, "ab" * 5000, "the" * 9000, "banana" * 3000 + "x", "=-" * 4000, "".join(random.choice("etaoinshrdlu") for _ in range(40_000)), "".join(random.choice(["th", "e", "the", "ing", "in", "1", "éé", "日"]) for _ in range(20_000))]
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.counter(PIECES).count_texts(long) == [len(x) for x in lib.encode(long)]


def test_wrong_vocabulary_is_refused():
    with pytest.raises(ValueError):
        bpe.Bpe(vocabulary_path("word_bpe_49k.json"))


@pytest.mark.parametrize("packed", [False, True])
def test_frames(odd, clashing, empty, packed):
    for df in (odd, clashing):
        done = bpe.decode(bpe.encode(df, BYTES, packed=packed), BYTES)
        rows = done.collect()
        assert len(rows) == df.count() and len(done.columns) == len(set(done.columns))
        assert all(r["decoded"] == (r["text"] or "") for r in rows)
        counted = token_counts.count_tokens(df, PIECES).collect()
        assert [r["n_tokens"] for r in counted if not r["text"]] == [0, 0]
    assert bpe.decode(bpe.encode(empty, BYTES, packed=packed), BYTES).count() == 0
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_queries_equal_the_libraries(spark, small):
    import hashlib
    import struct

    import sentencepiece
    from tokenizers import Tokenizer

    from lineloom.llm.registry import QUERIES

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    rows = QUERIES["op1_bpe_round_trip"](spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    rows = QUERIES["op10_token_counts"](spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        n = len(pieces.encode(docs[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 4096)
