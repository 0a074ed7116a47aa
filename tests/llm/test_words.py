"""The vectorised tokeniser against a regular expression."""

import random
import re

import numpy as np

from vellumgrid.llm import words as W

WORD = re.compile(r"[^\W_]+")


def check(texts):
    ids = {}
    for c in W.chunks(texts):
        for k in range(c.hi - c.lo):
            want = WORD.findall((texts[c.lo + k] or "").lower())
            got = c.hashes[c.bounds[k] : c.bounds[k + 1]].tolist()
            assert len(got) == len(want)
            for w, h in zip(want, got):
                assert ids.setdefault(w, h) == h
    assert len(set(ids.values())) == len(ids)


def test_random_texts():
    rnd = random.Random(3)
    alphabet = "aAbBzZ09 _-'\n\t.,éÉßüÜñ中文字²٣Ωжα\U0001d400\U0001f600"
    check(["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(500)] + [None, "", "x"])


def test_long_texts(monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 64)
    rnd = random.Random(3)
    long = " ".join("w" * rnd.randint(1, 20) + str(rnd.randint(0, 9)) for _ in range(500))
    check([long, "a b", long + "é", "x" * 1000, None])


def test_ngrams():
    h = np.arange(5, dtype=np.uint64)
    a = W.ngrams(h, 3)
    assert len(a) == 3 and len(set(a.tolist())) == 3
    assert len(W.ngrams(h, 6)) == 0
    assert (W.ngrams(h[1:4], 3) == a[1]).all()
    assert W.ngrams(h[::-1].copy(), 3)[0] != a[2]
