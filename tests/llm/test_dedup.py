"""Near-duplicate groups and line dedup against brute force."""

import hashlib
import random
import string

import numpy as np
import pytest

from labelloom.llm import near_dup
from labelloom.llm.components import components
from labelloom.llm.cuckoo import CuckooFilter
from labelloom.llm.line_dedup import LineIndex

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    words = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(rows):
    """doc_id -> smallest reachable id, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_groups_match_brute_force(documents):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(160)]
    rows = [(100, " ".join(base))]
    for i in range(70):  # copies of one text with ever more edits, some of them chained
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, "Same TEXT again and again here") for i in range(5)]
    rows += [(300, "short one"), (301, "SHORT\tone"), (302, None), (303, ""), (304, " \n"), (305, "short two")]
    want, sizes = groups(rows)
    got = {r.doc_id: r for r in near_dup.near_duplicates(documents(*rows)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_buckets_of_texts_that_are_not_alike_are_compared_in_slices(documents, monkeypatch):
    """A long passage that all share puts many into one bucket; some are near copies of each other."""
    monkeypatch.setattr(near_dup, "SLICE", 3)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = [f"q{rng.randrange(10 ** 6)}" for _ in range(34)]
        rows.append((i, " ".join(passage + own)))
        if i % 7 == 0:
            own[3] = "changed"
            rows.append((1000 - i, " ".join(passage + own)))
    want, _ = groups(rows)
    assert len(set(want.values())) == 60
    for percent in (85, 80):
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(*rows), percent).collect()}
        assert got == want


def test_sketch_bound_follows_from_the_threshold():
    assert near_dup.most_differing_bits(85) == 100 and near_dup.most_differing_bits(80) == 116


def test_rows_without_id_repeated_ids_and_empty_tables(documents):
    text = "one two three four five six"
    rows = near_dup.near_duplicates(documents((None, text), (4, text), (4, text), (7, text), (8, "else"), (9, "else"))).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [
        (-1, -1), (4, 4), (4, 4), (7, 4), (8, 8), (9, 8)]
    assert near_dup.near_duplicates(documents((1, text)).limit(0)).count() == 0


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64)) for n in (5, 300, 2000)]
    sets.append(np.concatenate([sets[1][20:], sets[0]]))
    maps = near_dup.parity_bitmaps(np.concatenate(sets), np.array([len(s) for s in sets]))
    for i in range(4):
        for j in range(4):
            bits = sum(int(x).bit_count() for x in maps[i] ^ maps[j])
            assert bits <= len(np.setxor1d(sets[i], sets[j]))


def test_components_of_chains_and_stars(llm):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 120)] + [(7, 7), (40, 39)]
    got = {r.node: r.root for r in components(llm.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(100, 120)} == {100} and got[40] == 39
    assert components(llm.createDataFrame([], "u long, v long")).count() == 0


def test_filter_knows_what_went_in():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2 ** 63, 60_000, dtype=np.uint64)
    f = CuckooFilter.for_keys(len(keys))
    f.insert(keys[:40_000])
    f.insert(keys[40_000:])
    f = CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 2 ** 63, 50_000, dtype=np.uint64)).mean() < 0.001
    f.delete(keys[:20_000])
    assert f.contains(keys[20_000:]).all() and f.contains(keys[:20_000]).mean() < 0.001
    with pytest.raises(ValueError):
        f.insert(rng.integers(0, 2 ** 63, 500_000, dtype=np.uint64))


def lines_by_hand(rows):
    holders = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


FIRST = [(3, "a shared line here\nown line of three\nshort"), (5, "A Shared LINE here \nx\na shared line here"),
         (6, None), (7, ""), (None, "a shared line here"), (8, "ééééééééé\nown line of eight"), (9, "éééééééééé\n\n")]
SECOND = [(1, "own line of three\néééééééééé"), (10, "own line of eight\ta\nshort"), (11, "x" * 100_000 + "\nshort")]


def digests(index, docs):
    return sorted((tuple(r) for r in index.digests(docs).collect()), key=str)


def test_lines_are_dropped_inserted_and_given_back(documents):
    a, both = documents(*FIRST), documents(*FIRST, *SECOND)
    one = LineIndex.build(a, keys_per_shard=2)
    assert digests(one, a) == lines_by_hand(FIRST)
    two = one.insert(documents(*SECOND), keys_per_shard=2)
    assert digests(two, both) == lines_by_hand([*FIRST, *SECOND])
    assert two.insert(documents(*SECOND)).refs.exceptAll(two.refs).isEmpty()
    back = two.delete(documents(*SECOND))
    assert digests(back, a) == lines_by_hand(FIRST)
    without = two.delete(documents((3, ""), (77, "")))
    left = [r for r in [*FIRST, *SECOND] if r[0] != 3]
    assert digests(without, documents(*left)) == lines_by_hand(left)
    known = {bytes(r.key) for r in without.refs.collect()}
    hashes = np.array([int.from_bytes(k[:8], "little") for k in known], np.uint64)
    filters = [CuckooFilter.from_bytes(r["filter"]) for r in without.filters.collect()]
    assert sum(f.size for f in filters) == len(known)
    assert all(any(f.contains(np.array([h]))[0] for f in filters) for h in hashes)


def test_index_of_two_halves(documents):
    rows = [*FIRST, *SECOND, *[(100 + i, f"a line of many documents\nline number {i % 7} of a few") for i in range(40)]]
    for keys_per_shard in (2, 200_000):
        index = LineIndex.of(documents(*rows), keys_per_shard)
        assert digests(index, documents(*rows)) == lines_by_hand(rows)
        plain = LineIndex.build(documents(*rows), keys_per_shard)
        assert index.refs.exceptAll(plain.refs).isEmpty() and plain.refs.exceptAll(index.refs).isEmpty()


def test_an_insertion_leaves_other_shards_alone(documents):
    index = LineIndex.build(documents(*[(i, f"line number {i} of the first") for i in range(60)]), keys_per_shard=10)
    assert index.shards == 6
    before = {r.shard: (bytes(r["filter"]), r.n) for r in index.filters.collect()}
    after = index.insert(documents((100, "one more line to come")), keys_per_shard=10)
    now = {r.shard: (bytes(r["filter"]), r.n) for r in after.filters.collect()}
    assert sum(now[s] != before[s] for s in before) == 1 and sum(n for _, n in now.values()) == 61
    grown = after.insert(documents(*[(200 + i, f"line number {i} of the second") for i in range(90)]), keys_per_shard=10)
    assert grown.shards == 6 and grown.keys == 151
    dealt = grown.insert(documents(*[(400 + i, f"line number {i} of the third") for i in range(200)]), keys_per_shard=10)
    assert dealt.shards > 6 and dealt.keys == 351
    for state in (grown, dealt):
        hashes = np.array([int.from_bytes(bytes(r.key)[:8], "little") for r in state.refs.collect()], np.uint64)
        filters = [CuckooFilter.from_bytes(r["filter"]) for r in state.filters.collect()]
        assert sum(f.size for f in filters) == len(hashes) == state.keys
        assert all(any(f.contains(np.array([h]))[0] for f in filters) for h in hashes)


def test_no_lines(documents):
    empty = documents((1, "x")).limit(0)
    index = LineIndex.build(empty)
    assert index.digests(empty).count() == 0 and index.insert(documents((1, "a line that counts"))).keys == 1
