"""Sketches of sets in the n-gram join: they lose no link, and only sets that may link are compared whole."""

import random

import numpy as np

from tests.llm.test_corpus import random_sets, slow_components, words
from tracerage.llm import ngram_join


def test_sketches_lose_no_link():
    rng = np.random.default_rng(11)
    sets = []
    for n in (1, 5, 31, 63, 64, 65, 90, 128, 300, 1000):
        for base in random_sets(rng, 6, n):
            sets.append(base)
            for gone, new in ((n // 9, n // 9), (n // 5, 0), (n // 10, n // 10), (n // 6, n // 40), (n // 4, 0)):
                sets.append(np.unique(np.concatenate([rng.permutation(base)[: n - gone], random_sets(rng, 1, new)[0]])))
    sizes = np.array([len(s) for s in sets])
    sketches = [ngram_join.sketch(s) for s in sets]
    assert all(len(s) <= 8 * len(x) <= max(64, 2 * len(s)) for s, x in zip(sets, sketches, strict=True))
    links = {(i, j) for j in range(len(sets)) for i in range(j) if ngram_join.linked(sets[i], sets[j])}
    classes, found = ngram_join.size_class(sizes), ngram_join.Groups(len(sets))
    for c in np.unique(classes).tolist():
        here = np.flatnonzero((classes == c) | (classes == c + 1))
        for i, j in ngram_join.sketch_candidates([sketches[k] for k in here], sizes[here]):
            found.join(int(here[i]), int(here[j]))
        # Pairs of one group are known, pairs within a side are another tile's.
        assert not ngram_join.sketch_candidates([sketches[k] for k in here], sizes[here], np.full(len(here), 7))
        assert not ngram_join.sketch_candidates([sketches[k] for k in here], sizes[here], None, np.ones(len(here)))
    assert len(links) > 100 and all(found.find(i) == found.find(j) for i, j in links)
    # Sets of 90 elements and more without a common one never meet.
    apart = {found.find(i) for i in range(0, len(sets), 6) if sizes[i] >= 90}
    assert len(apart) == sum(sizes[i] >= 90 for i in range(0, len(sets), 6))


def test_only_sets_that_may_link_are_compared_whole(spark, monkeypatch):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [words(rng, 60) + " " + passage + " " + words(rng, 60) for _ in range(60)]
    texts += [" ".join(t.split()[2:]) for t in texts[:3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, sets_of = [], ngram_join._sets_of

    def counted(docs, rows, nodes, *rest):
        asked.append(nodes.distinct().count())
        return sets_of(docs, rows, nodes, *rest)

    monkeypatch.setattr(ngram_join, "_sets_of", counted)
    sizes, comps = slow_components(texts)
    assert len(set(comps)) == 60
    assert sorted(map(tuple, ngram_join.jaccard_components(docs).collect())) == sorted(zip(range(63), sizes, comps, strict=True))
    assert asked and sum(asked) <= 6
