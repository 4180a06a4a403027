import hashlib
import random
import re
from collections import Counter

import pytest

from helpers import documents
from shelfwise.llm import repeats as R


def brute(rows, t):
    count = Counter()
    for _, x in rows:
        b = (x or "").encode()
        count.update(b[i:i + t] for i in range(len(b) - t + 1))
    out = []
    for d, x in rows:
        b = (x or "").encode()
        gone, until = bytearray(len(b)), 0
        for i in range(len(b) - t + 1):
            if count[b[i:i + t]] > 1:
                lo = max(i, until)
                gone[lo:i + t] = b"\x01" * (i + t - lo)
                until = i + t
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))),
                    hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)

    def letters(n):
        return "".join(rng.choice("abcdeé \n") for _ in range(n))

    shared = [letters(n) for n in (380, 399, 400, 401, 430, 700, 1500)]
    rows = []
    for i in range(60):
        text = letters(rng.randrange(900))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(max(1, len(s) // 4))
            text += s[a:] + letters(rng.randrange(300))
        rows.append((i, text))
    base = letters(2500)
    for i in range(12):                     # near copies
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = "#"
        rows.append((100 + i, "".join(t)))
    rows += [(200, "a" * 2000), (201, "ab" * 600), (202, None), (203, ""), (204, "x" * 399),
             (205, "y" * 400), (206, letters(600) * 2)]
    return rows + [rows[0], rows[1], (None, shared[-1]), (None, letters(500))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, tmp_path, seed):
    rows = corpus(seed)
    got = R.remove_repeats(documents(spark, rows, tmp_path / "d")).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, 400))


def test_long_texts_in_pieces(spark, tmp_path, monkeypatch):
    """A text longer than a piece is cut into overlapping pieces."""
    monkeypatch.setattr(R, "PIECE", 1000)
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh") for _ in range(9000))
    rows = [(1, a + "!" + a[2000:6500]), (2, a[500:5200] + "?"), (3, a[::-1])]
    got = R.remove_repeats(documents(spark, rows, tmp_path / "d")).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, 400))


def test_empty_table(spark, tmp_path):
    assert R.remove_repeats(documents(spark, [], tmp_path / "d")).count() == 0
