"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from framequery.llm import variants

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, n string, root string"


def brute_counts(rows, noise, min_length, min_count):
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= min_length and n >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, noise=31, min_length=7, min_count=2, ratio=10):
    words = brute_counts(rows, noise, min_length, min_count)
    form, out = {}, {}
    close = {w: [v for v in words if near(w, v)] for w in words}
    for w, others in close.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(close[w]), None if form[w] is None else words[form[w]])
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    base = ["".join(rnd.choice("abeéÀß×") for _ in range(rnd.randint(5, 9))) for _ in range(60)]
    words = [w for w in base for _ in range(rnd.choice([1, 3, 40]))]
    for w in base[:30]:  # misspellings, and misspellings of those
        k = rnd.randrange(len(w))
        wrong = w[:k] + rnd.choice("abé") + w[k + 1 :]
        words += [wrong] * 4 + [wrong + "b"] * 2 + [w[:k] + w[k:k + 1] + w[k:]] * 2
    words += ["aaaaaaa"] * 300 + ["aaaaaab"] * 30 + ["aaaaabb"] * 3 + ["aaaaaaaa"] * 2 + ["ABCDEFGH", "abcdefgh"] * 5 + ["ÀBCDEFGH"] * 3
    texts = [None, "", " \t\n", "x", "1234 ££ 日本語 абв", "é" * 9, "z" * 5000]
    for _ in range(80):
        texts.append("".join(rnd.choice(words) + rnd.choice([" ", "-", "'", "Ā", "3", "\n"]) for _ in range(rnd.randint(1, 60))))
    texts += [texts[20]] * 3 + [" ".join(rnd.choice(words) for _ in range(3000))]
    out = list(enumerate(texts)) + [(20, texts[20]), (None, texts[30])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("noise", [1, 3, 31])
def test_equals_brute_force(spark, rows, noise):
    got = {r.word: tuple(r)[1:] for r in variants.spelling_variants(frame(spark, rows), noise=noise).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = brute(rows, noise)
    assert got == want
    assert any(form for form, *_ in want.values()) and any(n > 1 for *_, n, _ in want.values())


def test_ties_take_the_smallest(spark):
    rows = [(0, "abcdefx abcdefx abcdefz abcdefz " + "abcdefg " * 20 + "abcdefé " * 20)]
    got = {r.word: r.form for r in variants.spelling_variants(frame(spark, rows), noise=1 << 32).collect()}
    assert got == {"abcdefx": "abcdefg", "abcdefz": "abcdefg", "abcdefg": None, "abcdefé": None}


def test_roots_follow_chains(spark):
    """Forms of forms: each is ten times as frequent as the one before."""
    words = [("abcdefghi"[:k] + "z" * (9 - k), 10**k) for k in range(0, 4)]
    rows = [(k, f"{w} " * (2 * n)) for k, (w, n) in enumerate(words)]
    got = {r.word: (r.form, r.root) for r in variants.spelling_variants(frame(spark, rows), noise=1 << 33).collect()}
    names = [w for w, _ in words]
    assert got == {w: (names[k + 1] if k < 3 else None, names[3]) for k, w in enumerate(names)}


def test_nothing_to_find(spark):
    assert variants.spelling_variants(frame(spark, [])).count() == 0
    assert variants.spelling_variants(frame(spark, [(1, None), (None, ""), (2, "short words only")])).count() == 0


def test_pieces_keep_runs_whole():
    rnd = random.Random(2)
    text = "".join(rnd.choice("aé€ ÿ1×") for _ in range(3000)) + "é" * 500 + " " + "a" * 300
    raw = np.frombuffer(text.encode(), np.uint8)
    for size in (1, 7, 100, 10_000):
        parts = [p.tobytes() for p in variants.pieces(raw, size)]
        assert b"".join(parts) == raw.tobytes()
        assert [m for p in parts for m in re.findall(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+", p)] == [w.encode() for w in RUN.findall(text)]


def test_neighbourhoods_are_whole_and_distinct():
    alphabet = np.array(sorted(map(ord, "abc")), np.uint64)
    every = np.full((1, variants.SEGMENT_BITS // 8), 255, np.uint8)
    for word in ("aab", "abcabca", "bbbb"):
        got = [c for _, c in variants.neighbourhood([word], alphabet, every)]
        want = {word[:k] + word[k + 1 :] for k in range(len(word))}
        want |= {word[:k] + x + word[k + 1 :] for k in range(len(word)) for x in "abc"} - {word}
        want |= {word[:k] + x + word[k:] for k in range(len(word) + 1) for x in "abc"}
        assert len(got) == len(want) and set(got) == want


def test_hashes_of_candidates_are_those_of_words(spark):
    """A filter of all near words passes each of them: hashes put together equal hashes of the text."""
    words = ["abcdefg", "abcdefgh", "abxdefg", "bcdefgh", "aabcdefg"]
    bits = variants.vocabulary_filter(spark.createDataFrame([(w,) for w in words], "word string"), len(words))
    got = {c for _, c in variants.neighbourhood(["abcdefg"], np.array(sorted(map(ord, "abcdefghx")), np.uint64), bits)}
    assert {"abcdefgh", "abxdefg", "aabcdefg"} <= got and len(got) < 8
