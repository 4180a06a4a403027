import random

import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import wordids as W

public_tokenizers = pytest.importorskip("public_tokenizers")

BITS = ["a", "b", "It", "'s", "'", "s", " ", "  ", "\n", "\t", "\r\n", ".", ",", "(", "é", "ñ", "×", "÷",
        "ß", " ", "　", " ", "\u0085", " ", "1", "23", "日本", "🙂", "\x1c", "\x00",
        "<|endoftext|>", "▁", "é", "ſ", "ﬁ", "-", "_", "​", "﻿", "don't", "they'll"]


def texts(n=4000, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def reference(special):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = special
    return lambda t: tok.encode(t, add_special_tokens=False).ids


def pieces_reference():
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return lambda t: model.encode(t[1:])


def encoded(enc, texts):
    ids, count = enc.encode(pa.array(texts, pa.string()))
    edge = np.concatenate(([0], np.cumsum(count)))
    return [ids[a:b].tolist() for a, b in zip(edge, edge[1:])]


@pytest.mark.parametrize("special", [False, True])
def test_byte_bpe_equals_whole_texts(special):
    mine, want = texts(), reference(special)
    assert encoded(W.byte_bpe(None, special), mine) == [want(t) for t in mine]


def test_piece_bpe_equals_whole_texts():
    mine, want = [" " + t for t in texts(seed=2)], pieces_reference()
    assert encoded(W.piece_bpe(None), mine) == [want(t) for t in mine]


def test_forgetting_long_pieces_and_equal_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(W, "MEMORY_PIECES", 20)
    monkeypatch.setattr(W, "LONG_PIECE", 3)
    enc, want = W.byte_bpe(None, True), reference(True)
    enc.forget()
    mine = texts(300, 3) + ["x" * 20_000, None]
    for a in range(0, len(mine), 40):
        part = mine[a:a + 40]
        assert encoded(enc, part) == [want(t or "") for t in part]
    monkeypatch.setattr(W, "MEMORY_PIECES", 10_000)
    monkeypatch.setattr(W, "span_hash", lambda d, a, b: (b - a).astype(np.uint64) % np.uint64(2))
    enc.forget()
    for _ in range(2):
        assert encoded(enc, mine) == [want(t or "") for t in mine]
    enc.forget()


def test_faithful_pieces():
    enc = W.piece_bpe(None)
    data = " a▁b plain".encode()
    code, _ = enc.codes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert enc.faithful[code].tolist() == [False, True]
