"""Counts of phrases are added up in tasks and cross the shuffle in packs."""

from collections import Counter

import numpy as np
import pyarrow as pa

from tracerage.llm import phrases
from tracerage.llm.common import utf8


def test_a_scan_hands_on_packs_not_rows(spark):
    df = spark.createDataFrame([(f"rare{i} pair{i} common word", "en") for i in range(3000)], "text string, lang string").repartition(3)
    counted = phrases.scan(df, {}, 0, 3, 3, 4, 5)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Aggregate" not in plan
    found = {(r.lang, r.words, r.phrase): r.n for r in counted.collect()}
    assert len(found) == 6002 and found["en", 1, "common"] == found["en", 1, "word"] == 3000


def test_packs_add_up_whatever_tasks_hold(monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 7)
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 64, 40, np.uint64)
    want, bare, packs = Counter(), Counter(), []
    held = phrases.Held(5)
    for _ in range(60):
        mine, lang = rng.choice(40, 6, replace=False), "dé"[rng.integers(2)]
        count = rng.integers(1, 9, 6)
        packs += held.add_named(lang, 2, hashes[mine], count, pa.array([f"w{i} é" for i in mine]))
        packs += held.add(3, hashes[mine])
        want.update({(lang, f"w{i} é"): int(c) for i, c in zip(mine, count, strict=True)})
        bare.update(hashes[mine].tolist())
    packs += [*held.bare_packs(), *held.named_packs()]
    got, by_hash = Counter(), Counter()
    for r in range(5):
        mine = [b.filter(pa.compute.equal(b.column("range"), r)) for b in packs]
        for row in (x for b in phrases.added_up(iter(mine), 9) for x in b.to_pylist()):
            if row["phrase"] is None:
                by_hash[row["hash"] % (1 << 64)] += row["n"]
            else:
                assert (row["lang"], row["phrase"]) not in got
                got[row["lang"], row["phrase"]] += row["n"]
    assert got == want and by_hash == {h: n for h, n in bare.items() if n >= 9}


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 8)  # longer chunks have powers of their own
    monkeypatch.setattr(phrases, "_known", [])
    data, offsets = utf8(pa.array(["über THE, the\tend", "", "the", "The end", ". ,", "thе"]))
    starts, ends, hashes, rows, joined = phrases.words_of(data, offsets)
    words = phrases.phrases_at(data, starts, ends, np.arange(len(starts)), 1).to_pylist()
    assert words == ["über", "the", "the", "end", "the", "the", "end", "thе"] and rows.tolist() == [0, 0, 0, 0, 2, 3, 3, 5]
    assert len(set(hashes.tolist())) == len(set(words)) and len(set(zip(hashes.tolist(), words, strict=True))) == len(set(words))
    assert joined.tolist() == [True, False, True, False, False, True, False, False]
    assert phrases.phrases_at(data, starts, ends, np.array([0, 2, 5]), 2).to_pylist() == ["über the", "the end", "the end"]


def test_ranges_grow_with_the_texts(spark, monkeypatch):
    asked, scan = [], phrases.scan
    monkeypatch.setattr(phrases, "RANGE", 1000)
    monkeypatch.setattr(phrases, "scan", lambda *a: asked.append(a[-1]) or scan(*a))
    df = spark.createDataFrame([("über one two three", "en")] * 1000 + [(None, None)], "text string, lang string")
    f, _ = phrases.count_phrases(df)
    assert set(asked) == {7} and f.count() == 9 and {r.f for r in f.collect()} == {1000}
