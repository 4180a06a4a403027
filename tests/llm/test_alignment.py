import hashlib
import random
from collections import Counter, defaultdict

import pytest

from helpers import documents, words
from shelfwise.llm import alignment as A
from shelfwise.llm import wordids
from test_wordids import texts

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def plain():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    spell = wordids.byte_spelling(tok)

    def piece(i):
        s = model.id_to_piece(i)
        return bytes([int(s[3:5], 16)]) if s.startswith("<0x") else s.replace("▁", " ").encode()

    def tokens(text):
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        return [(i, spell[i]) for i in a], [(i, piece(i)) for i in b]

    return tokens


def spans(tokens):
    at = 0
    for i, raw in tokens:
        yield i, at, at + len(raw)
        at += len(raw)


def brute(rows, tokens):
    """Overlaps, groups and counts straight from the definition."""
    out, held = [], Counter()
    for d, text in rows:
        a, b = tokens(text) if text else ([], [])
        want = (" " + text).encode() if text else b""
        if b"".join(r for _, r in a) != want or b"".join(r for _, r in b) != want:
            a, b = [], []
        a, b = list(spans(a)), list(spans(b))
        # B tokens that end after an A token begins and begin before it ends
        links, k = [], 0
        for i, s, e in a:
            while k < len(b) and b[k][2] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][1] < e:
                links.append((i, b[j][0]))
                j += 1
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, s, z in a if start <= s and z <= e) + "|"
                          + ",".join(str(i) for i, s, z in b if start <= s and z <= e)
                          if len(ends) < 400 else (start, e))
            start = e
        if len(ends) >= 400:        # the same, without a square of a long text's tokens
            parts = []
            for side in (a, b):
                at, cut = 0, []
                for start, e in groups:
                    mine = []
                    while at < len(side) and side[at][2] <= e:
                        mine.append(str(side[at][0]))
                        at += 1
                    cut.append(",".join(mine))
                parts.append(cut)
            groups = [f"{x}|{y}" for x, y in zip(*parts)]
        held.update(set(links))
        out.append((d, len(a), len(b), len(ends), links, ";".join(groups)))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return sorted((str(d), na, nb, ng, len(ls), sum(held[x] == most[x[0]] for x in ls),
                   sum(held[x] for x in ls),
                   hashlib.sha256(g.encode()).hexdigest() if na else "")
                  for d, na, nb, ng, ls, g in out)


def rows_of(df):
    return sorted((str(r.doc_id), *list(r)[1:]) for r in df.collect())


def corpus():
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(texts(250, 11))]
    rows += [(1000 + i, " ".join(words(rng, rng.randint(1, 60)))) for i in range(60)]
    rows += [(1000, rows[-1][1]), (None, "null id"), (None, "null id"), (2000, None), (2001, ""),
             (2002, " "), (2003, "a▁b stays out"), (2004, "  two  spaces "), (2005, "x" * 3000)]
    return rows


def test_equals_brute_force_in_small_parts(spark, tmp_path, monkeypatch, plain):
    monkeypatch.setattr(A, "SLICE_BYTES", 700)
    monkeypatch.setattr(A, "FLUSH", 300)
    rng = random.Random(10)
    rows = corpus()
    long = " ".join(words(rng, 900))            # several parts
    rows += [(3000, long), (3001, long + "\n\nend"), (3002, long[:2000] + " a▁b " + long[2000:]),
             (3003, "the the " * 600)]
    docs = documents(spark, rows, tmp_path / "d")
    want = brute(rows, plain)
    assert rows_of(A.report(docs)) == want
    assert rows_of(A.report(docs, broadcast_pairs=0)) == want      # counts by join


def test_alignments_hold_the_groups_and_links(spark, plain):
    rows = [(1, "tokenization of unbelievable wörds"), (2, "a▁b"), (3, None)]
    got = {r.doc_id: r for r in A.alignments(documents(spark, rows)).collect()}
    a, b = (list(spans(x)) for x in plain(rows[0][1]))
    r = got[1]
    assert list(r.a) == [i for i, *_ in a] and list(r.b) == [i for i, *_ in b]
    links = [(x, y) for x, (_, s, e) in enumerate(a) for y, (_, t, f) in enumerate(b)
             if s < f and t < e]
    assert list(zip(r.link_a, r.link_b)) == links
    ends = {e for *_, e in a} & {e for *_, e in b}
    assert list(r.a_group) == [sum(e <= s for e in ends) for _, s, _ in a]
    assert list(r.b_group) == [sum(e <= s for e in ends) for _, s, _ in b]
    assert got[2].a == [] and got[3].link_b == []


def test_no_documents(spark, tmp_path):
    none = documents(spark, [], tmp_path / "n")
    assert A.report(none).columns == A.REPORT and A.report(none).count() == 0
    assert rows_of(A.report(documents(spark, [(1, None)]))) == [("1", 0, 0, 0, 0, 0, 0, "")]
