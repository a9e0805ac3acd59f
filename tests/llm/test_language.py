import random

import numpy as np
import pyarrow as pa
import pytest

from wayfold.llm import language as lg


def spelt_by_hand(sample: str, word: str) -> int:
    """Phrases of a word, by looking for substrings of the sample."""
    n, at = 0, " "
    for ch in word:
        if at + ch in sample:
            at += ch
        else:
            n += bool(at)
            at = ch if ch in sample else ""
            n += not at
    return n + bool(at)


@pytest.mark.parametrize("few", [0, 32, 10**6])
def test_words_spelt_side_by_side_equal_substring_search(monkeypatch, few):
    monkeypatch.setattr(lg.Parser, "FEW", few)
    monkeypatch.setattr(lg.Parser, "LIMIT", 50)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 9)))
    sample = {k: " " + " ".join(sorted({word() for _ in range(60)})) + " " for k in ("x", "y", "z")}
    texts = ["", " ", "12 3", "日本 q" + "abc" * 50] + [" ".join(word() + rnd.choice(["", "7", "-", "Z"]) for _ in range(30)) for _ in range(20)]
    p = lg.Parser(sample)
    for part in (texts[:9], texts[9:], texts[::-1]):
        letters = [["".join(c for c in w if c.isalpha()) for w in t.lower().split()] for t in part]
        want = [[sum(map(len, ws)), *(sum(spelt_by_hand(sample[k], w) for w in ws if w) for k in p.langs)] for ws in letters]
        assert (p.parse(part) == np.array(want)).all()
    assert lg.Parser({}).parse(["a b", ""]).tolist() == [[2], [0]]


def test_pieces_hold_every_text(monkeypatch):
    monkeypatch.setattr(lg, "BATCH_CHARACTERS", 10)
    texts = ["abc", None, "", "x" * 40, "defg", "hij", "k" * 9]
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["row", "text"])
    got = list(lg._in_pieces([b, b.slice(2)], None))
    assert [k for x, _ in got for k in x.column(0).to_pylist()] == [*range(7), *range(2, 7)]
    assert [t for _, ts in got for t in ts] == [t or "" for t in texts + texts[2:]]
    assert all(sum(map(len, ts)) <= 10 or len(ts) == 1 for _, ts in got)
