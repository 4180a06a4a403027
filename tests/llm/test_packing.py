import zlib

import numpy as np
import pytest

from helpers import documents
from shelfwise.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = ["", None, "one", " lead", "trail ", "two  spaces", "a\n b", "a \nb", "tab\t x",
         "It's we'll they'd 's ' s", "né Ünï  nbsp  x", " em  ", "日本語 テキスト",
         "<|endoftext|> is <|endoftext|>text", "\x1c a \x1f b", "line\r\n\r\n  indented",
         "a" * 30_000, "word " * 5000, "mixed 123 4 5.6, (x) [y]", "🙂 🙂🙂 x"]


def ids_of(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tok.encode(text or "", add_special_tokens=False).ids + [1]


def test_every_id_in_one_piece_of_a_gapless_window(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, "one"), (None, "null id")]
    docs = documents(spark, rows, tmp_path / "d")
    pieces = P.pack(docs).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        assert p.length > 0 and len(p.ids) == 4 * p.length
    assert set(by_doc) == {d for d, _ in rows}
    for d, t in rows:
        want = np.array(ids_of(t), "<u4")
        mine = sorted((p for p in by_doc[d]), key=lambda p: p.start)
        copies = sum(1 for x, _ in rows if x == d)
        got = b"".join(bytes(p.ids) for p in mine)
        assert len(got) == 4 * len(want) * copies
        if copies == 1:
            assert got == want.tobytes() and {p.doc_tokens for p in mine} == {len(want)}
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, mine in by_seq.items():
        at = 0
        for p in sorted(mine, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or s == max(by_seq)


def test_report_and_whole_sequences(spark, tmp_path):
    docs = documents(spark, [(i, t) for i, t in enumerate(TEXTS)], tmp_path / "d")
    pieces = P.pack(docs)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in P.pieces_report(docs).collect()}
    assert crc == {(p.doc_id, p.start): zlib.crc32(bytes(p.ids)) for p in pieces.collect()}
    whole = P.sequences(pieces).collect()
    total = sum(len(ids_of(t)) for t in TEXTS)
    assert sum(len(r.ids) // 4 - r.n_pad for r in whole) == total
    assert sum(r.n_pad > 0 for r in whole) <= 1
    for r in whole:
        n = len(r.ids) // 4
        assert n == 2048 or (n & (n - 1) == 0 and r.n_pad == 0)


def test_names_of_special_tokens_are_special_as_in_a_plain_call():
    assert ids_of("a <|endoftext|> b").count(50256) == 1


def test_empty_table(spark, tmp_path):
    assert P.pack(documents(spark, [], tmp_path / "d")).count() == 0
