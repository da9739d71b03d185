"""Vocabularies by bounds against plain counting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.operators import terms


def plain(rows, max_features, min_documents):
    corpus, documents = Counter(), Counter()
    for grams in rows:
        corpus.update(grams)
        documents.update(set(grams))
    kept = [(-corpus[t], t, documents[t]) for t in corpus if documents[t] >= min_documents]
    return [(t, -c, d) for c, t, d in sorted(kept)[:max_features]]


@pytest.fixture(scope="module")
def lists():
    """Gram lists with a long tail, ties and rows without grams."""
    dice = random.Random(4)
    names = [f"t{i}" for i in range(400)]
    weights = [1 / (1 + i) for i in range(400)]
    return [(i % 5, dice.choices(names, weights, k=dice.randrange(40))) for i in range(300)] + [
        (2, []), (3, ["once"] * 50), (4, ["rare", "rare"])]


@pytest.fixture(scope="module")
def grams(spark, lists):
    return spark.createDataFrame(lists, "fold int, grams array<string>").persist()


@pytest.mark.parametrize("buckets", [1, 64, 1 << 20])
@pytest.mark.parametrize("features,documents", [(20, 2), (20, 60), (390, 1)])
def test_no_term_is_lost(monkeypatch, grams, lists, buckets, features, documents):
    monkeypatch.setattr(terms, "BUCKETS", buckets)
    got = [tuple(r) for r in terms.vocabulary(grams, features, documents).collect()]
    assert got == plain([g for _, g in lists], features, documents)


@pytest.mark.parametrize("buckets", [7, 1 << 20])
@pytest.mark.parametrize("features", [5, 10_000])
def test_vocabularies_outside_folds(monkeypatch, grams, lists, buckets, features):
    monkeypatch.setattr(terms, "BUCKETS", buckets)
    got = terms.fold_vocabularies(grams, 5, features, 2).collect()
    for fold in range(5):
        mine = sorted(((r.term, r.corpus_count, r.document_count) for r in got if r.fold == fold),
                      key=lambda r: (-r[1], r[0]))
        assert mine == plain([g for f, g in lists if f != fold], features, 2)


def test_only_terms_of_large_buckets_are_counted(monkeypatch, grams, lists):
    """With terms apart from each other the first pass of twice the terms is enough."""
    counted = []
    count = terms._counts

    def watch(rows, folds, buckets=None):
        out = count(rows, folds, buckets)
        counted.append(out.count())
        return out

    monkeypatch.setattr(terms, "_counts", watch)
    assert len(terms.vocabulary(grams, 10).collect()) == 10
    assert counted == [20]


def test_no_rows(grams):
    assert terms.vocabulary(grams.limit(0)).count() == 0
    assert terms.fold_vocabularies(grams.limit(0)).count() == 0
