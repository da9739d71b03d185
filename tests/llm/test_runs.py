"""Periodic runs against plain loops over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from labelloom.llm import periodic_runs
from labelloom.llm.periodic_runs import collapsed, runs_of


def smallest_period(word):
    border = [0] * len(word)
    for i in range(1, len(word)):
        k = border[i - 1]
        while k and word[i] != word[k]:
            k = border[k - 1]
        border[i] = k + (word[i] == word[k])
    return len(word) - border[-1]


def plain_runs(word, least=12):
    found = []
    for p in range(1, len(word) // 2 + 1):
        x = 0
        while x + p < len(word):
            if word[x] != word[x + p]:
                x += 1
                continue
            start = x
            while x + p < len(word) and word[x] == word[x + p]:
                x += 1
            end = x + p
            if end - start >= max(least, 2 * p) and smallest_period(word[start:end]) == p:
                found.append((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def listed(runs):
    return [tuple(r) for r in runs.tolist()]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def samples():
    dice = random.Random(3)
    out = [[], [1], [0] * 11, [0] * 12, [0] * 500, fibonacci(700), [0, 1] * 30 + [1, 0] * 30]
    for letters in (2, 3, 8):
        out += [[dice.randrange(letters) for _ in range(dice.randrange(400))] for _ in range(25)]
    for _ in range(120):  # periods of periods, with seams between highly periodic regions
        root = [dice.randrange(2) for _ in range(dice.randrange(1, 6))]
        block = root * dice.randrange(1, 30) + [dice.randrange(2) for _ in range(dice.randrange(4))]
        turn = dice.randrange(len(block) + 1)
        whole = (block[turn:] + block[:turn]) * dice.randrange(1, 5)
        out.append([dice.randrange(3) for _ in range(dice.randrange(30))] + whole[:len(whole) - dice.randrange(len(block))]
                   + root[::-1] * dice.randrange(20) + [dice.randrange(2) for _ in range(dice.randrange(20))])
    for _ in range(60):  # q-periodic stretches that meet, in either turn
        root = [dice.randrange(3) for _ in range(dice.randrange(1, 7))]
        word = []
        for _ in range(dice.randrange(2, 5)):
            turn = dice.randrange(len(root))
            word += ((root * 60)[turn:])[:dice.randrange(1, 150)]
        out.append(word)
    return out


def test_runs_equal_plain_loops_one_by_one_and_together():
    words = samples()
    together = runs_of([np.array(w, np.int64) for w in words])
    for word, runs in zip(words, together):
        expected = plain_runs(word)
        assert listed(runs) == expected
        assert listed(runs_of([np.array(word, np.int64)])[0]) == expected


def test_nested_squares_of_long_periods():
    dice = random.Random(5)
    word = [dice.randrange(4) for _ in range(40)]
    for _ in range(5):
        word = word + word + [dice.randrange(4) for _ in range(3)]
    assert listed(runs_of([np.array(word, np.int64)])[0]) == plain_runs(word)


def test_names_that_collide_are_replaced(monkeypatch):
    good, tried = periodic_runs.window_names, []

    def names(codes, longest, seed):
        tried.append(seed)
        found = good(codes, longest, seed)
        return [np.zeros_like(n) for n in found] if seed == 1 else found

    monkeypatch.setattr(periodic_runs, "window_names", names)
    word = [1, 2, 3] * 6 + [4, 5]
    assert listed(runs_of([np.array(word, np.int64)])[0]) == [(0, 18, 3)]
    assert tried == [1, 2]


def test_least_is_bounded():
    with pytest.raises(ValueError):
        runs_of([np.zeros(20, np.int64)], 5)


def test_collapsed_words_keep_the_first_period():
    words = [b"x"] + [b"a", b"b"] * 8 + [b"y"]
    assert collapsed(words, np.array([[1, 16, 2]])) == b"x a b y"


def expected_row(doc_id, text):
    words = (text or "").split(" ") if text else []
    words = [w for w in words if w]
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    row = (doc_id, len(runs)) + (top + (1000 * top[1] // top[2],) if top else (None,) * 4)
    return row + (hashlib.sha256("".join(f"{s},{size},{p}\n" for s, size, p in runs).encode()).hexdigest(),
                  hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def test_digests_of_documents_with_odd_rows(llm, documents):
    dice = random.Random(9)
    tails = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    rows = [(None, None), (None, "a b " * 10), (1, ""), (2, "   "), (3, None), (4, "é ü " * 9), (4, "é ü " * 9)]
    rows += [(i, " ".join(dice.choice("abcdefgh") for _ in range(dice.randrange(1, 200)))) for i in tails]
    rows += [(tails[0], ""), (tails[1], None), (900, "lang " * 5000)]
    docs = documents(*rows)
    changed = docs.withColumn("text", periodic_runs.repeated_tail(docs["doc_id"], docs["text"]))
    got = periodic_runs.run_digests(periodic_runs.periodic_runs(changed)).collect()
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert order(got) == order(expected_row(*r) for r in rows)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_white_space_is_that_of_ascii(llm, documents):
    docs = documents((7, "a\u00a0b\tc\x0bd\x0ce\rf\n" * 3))
    row = periodic_runs.periodic_runs(docs).collect()[0]
    assert [tuple(r) for r in row["runs"]] == [(0, 15, 5)]
    assert row["collapsed"] == "a\u00a0b c d e f"
