"""Suffix arrays in op4 get only what differing cut-outs may share."""

import random

import numpy as np

from faultline.llm import substring_dedup as D


def brute(strings, low, length):
    least = {}
    for s, n in zip(strings, low, strict=True):
        for k in range(len(s) - length + 1):
            least[s[k : k + length]] = min(n, least.get(s[k : k + length], n))
    return [[least[s[k : k + length]] for k in range(len(s) - length + 1)] for s in strings]


def arrays(monkeypatch):
    sizes, real = [], D.suffix_array
    monkeypatch.setattr(D, "suffix_array", lambda text: sizes.append(len(text)) or real(text))
    return sizes


def test_one_passage_between_differing_ends_needs_no_suffix_array(monkeypatch):
    rng, sizes, p = random.Random(4), arrays(monkeypatch), D.Repeats()
    some = lambda n: bytes(rng.randrange(256) for _ in range(n))
    strings, anchor = [], []
    for k in range(40):
        passage = some(80)
        strings += [some(9) + passage + some(5), some(3) + passage + some(11), passage]
        anchor += [k] * 3
    low = np.array([rng.randrange(1000) for _ in strings])
    got = D.smallest_ids(strings, low, np.array(anchor), p)
    assert [x.tolist() for x in got] == brute(strings, low.tolist(), p.length)
    assert sum(sizes) == 0


def test_overlapping_passages_still_meet_in_suffix_arrays(monkeypatch):
    rng, sizes = random.Random(8), arrays(monkeypatch)
    p = D.Repeats(length=5, anchor=3)
    for letters in (b"a", b"ab", b"abcd"):
        for _ in range(30):
            strings = list({bytes(rng.choice(letters) for _ in range(rng.randrange(5, 30))) for _ in range(rng.randrange(1, 12))})
            low = np.array([rng.randrange(50) for _ in strings])
            got = D.smallest_ids(strings, low, np.zeros(len(strings), np.int64), p)
            assert [x.tolist() for x in got] == brute(strings, low.tolist(), p.length)
    assert sum(sizes) > 0
