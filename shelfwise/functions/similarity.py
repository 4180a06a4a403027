"""Ratcliff/Obershelp similarity (Python's ``difflib`` ratio) as a per-group helper.

Spark has no built-in for this measure (``levenshtein`` is a different one),
so the best-candidate search runs in pandas inside ``applyInPandas`` over
groups whose size the caller bounds (a bucket of values x a chunk of the
candidate pool).  Nothing here touches the driver.
"""

from __future__ import annotations

import sys
from difflib import SequenceMatcher

import numpy as np
import pandas as pd

# The helpers below run inside Python workers.  Pickling them by value ships
# their code with the task, so the workers need nothing of this package
# installed or on their path (the standard library and pandas suffice).
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # an older pickler: the package must then be importable by workers
    pass


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all texts as numbers, the text of each)."""
    size = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return code, np.repeat(np.arange(len(texts)), size)


def upper_bounds(words: list[str], texts: list[str]) -> np.ndarray:
    """difflib's ``quick_ratio`` of every word with every text: twice the
    letters that both have, in any order, over the letters of both.  Letters
    are counted once a text, and pairs are made by letter in numpy."""
    code, at = _codes(texts)
    alphabet = np.unique(code, return_counts=True)[0]
    mine, of = _codes(words)
    place = np.searchsorted(alphabet, mine)
    known = place < len(alphabet)
    known[known] = alphabet[place[known]] == mine[known]
    shared = np.zeros((len(words), len(texts)), np.int32)
    in_words = np.zeros((len(alphabet), len(words)), np.int32)
    in_texts = np.zeros((len(alphabet), len(texts)), np.int32)
    np.add.at(in_words, (place[known], of[known]), 1)
    np.add.at(in_texts, (np.searchsorted(alphabet, code), at), 1)
    for n in np.flatnonzero(in_words.any(axis=1)).tolist():
        rows, cols = np.flatnonzero(in_words[n]), np.flatnonzero(in_texts[n])
        shared[np.ix_(rows, cols)] += np.minimum.outer(in_words[n, rows], in_texts[n, cols])
    both = np.add.outer([len(w) for w in words], [len(t) for t in texts])
    return np.where(both > 0, 2.0 * shared / np.maximum(both, 1), 1.0)


def best_match(word: str, candidates, cutoff: float, bounds=None):
    """Best ``(score, candidate)`` with ``score >= cutoff``, else ``None``.

    Same choice as ``difflib.get_close_matches(word, candidates, n=1,
    cutoff)``: the highest ratio wins and a tie goes to the greater string.
    Candidates are compared from the highest upper bound down, until none left
    can reach the best ratio found.
    """
    if bounds is None:
        bounds = upper_bounds([word], candidates)[0]
    s = SequenceMatcher()
    s.set_seq2(word)
    best = None
    near = np.flatnonzero(bounds >= cutoff)
    for i in near[np.argsort(-bounds[near], kind="stable")].tolist():
        if best is not None and bounds[i] < best[0]:
            break
        s.set_seq1(candidates[i])
        r = s.ratio()
        if r >= cutoff and (best is None or (r, candidates[i]) > best):
            best = (r, candidates[i])
    return best


def score_group(values: pd.DataFrame, pool: pd.DataFrame, cutoff: float,
                kind: str) -> pd.DataFrame:
    """Best candidate of one pool chunk for each value.

    ``values``: column ``raw``.  ``pool``: columns ``text`` and ``canonical``.
    ``kind='canonical'`` compares the raw text as given (case and padding
    count); ``kind='key'`` compares its stripped lower-case form with alias
    keys.  Values without a candidate at or above ``cutoff`` give no row.
    """
    texts = pool["text"].tolist()
    target = dict(zip(pool["text"], pool["canonical"]))
    rows = []
    raws = [r for r in values["raw"].tolist() if r is not None]
    if texts and raws:
        words = [str(r) if kind == "canonical" else str(r).lower().strip() for r in raws]
        for raw, word, bounds in zip(raws, words, upper_bounds(words, texts)):
            b = best_match(word, texts, cutoff, bounds)
            if b is not None:
                rows.append((raw, b[0], b[1], target[b[1]]))
    return pd.DataFrame(rows, columns=["raw", "score", "match", "canonical"])


SCORE_SCHEMA = "raw string, score double, match string, canonical string"
