"""SentencePiece codec, conversation repair and phrase mining against the library, brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import cache

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracerage.llm import conversations, phrases, piece_codec
from tracerage.llm.queries import OP12_SQL, OP13_SQL
from tracerage.llm.token_counts import tokenizer_path

MODEL = "piece_bpe_32k.model"


# SentencePiece codec


@pytest.fixture(scope="module")
def codec():
    return piece_codec.PrefixCodec(tokenizer_path(MODEL), most_words=500, most_pairs=5000)


def test_ids_equal_the_library_on_odd_texts(codec):
    rng = random.Random(1)
    pool = [p for p in codec.pieces if not p.startswith("<0x")]
    odd = " \n\tabcdeéİßΩжя中日🙂▁.,0123<>s\x00́"
    texts = ["", " ", "\n", "  a  b \n\n c", " " * 1000, "▁" * 37 + "the", "\n" * 50, "a" * 20000, "🙂" * 3000, "<s> </s> <unk> <0x41>"]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    texts += ["".join(rng.choice("aeinrst ") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == codec.model.encode(text), repr(text)
        assert codec.decode(ids) == codec.model.decode(ids)


def test_last_tokens_are_those_of_every_prefix(codec):
    for text in ("▁unbelievable", "▁aaaaaaa", "▁é中x", "▁▁▁the"):
        table = codec.last_tokens(text)
        for end in range(1, len(text) + 1):
            symbols = list(text[:end])
            for _, symbols in codec.merges(text[:end]):
                pass
            assert codec.pieces[table[end - 1]] == symbols[-1] if table[end - 1] >= 0 else symbols[-1] not in codec.ids


def test_neighbours_stay_apart_as_merges_say(codec):
    rng = random.Random(2)
    for _ in range(3000):
        a, b = rng.choice(list(codec.last_after)), rng.choice(list(codec.last_after))
        both = codec.pieces[a] + codec.pieces[b]
        symbols = list(both)
        for _, symbols in codec.merges(both):
            pass
        assert codec._apart(a, b) == (symbols == [codec.pieces[a], codec.pieces[b]])


def test_codec_on_tables(spark, codec):
    rows = [(1, "Hello  world\n"), (1, "Hello  world\n"), (None, "x" * 100000), (3, None), (4, ""), (5, "▁ mark")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    made = piece_codec.encode(docs)
    got = sorted((r.doc_id or -1, r.ids, r.decoded) for r in made.collect())
    assert got == sorted((i or -1, codec.model.encode(t or ""), codec.model.decode(codec.model.encode(t or ""))) for i, t in rows)
    back = piece_codec.decode(made)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == [(i, d) for i, _, d in got]
    assert piece_codec.encode(docs.limit(0)).count() == 0
    assert piece_codec.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).orderBy("doc_id").collect() == [(1, None), (2, "")]


# Conversations


def rows_after_damage(rows):
    shown = lambda x: " " if x is None else str(x)
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        k = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = "user" if k == 4 else shown(role), "" if k == 1 else re.sub("[.!?]", "", shown(text)) if k == 2 else shown(text)
        kept += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def cheapest(rows):
    """All that find_repairs() tells of a conversation, from all edits of all suffixes."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = lambda last, r: r == "s" and last == "" or r == "u" and last in ("", "s", "a") or r == "a" and last == "u"

    @cache
    def best(i, last, inserted=0):
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        for r, role in (("u", "user"), ("a", "assistant")):
            if inserted < 3 and follows(last, r) and (rest := best(i, r, inserted + 1)):
                ways.append((rest[0] + 3, "I" + rest[1], (role + ":", *rest[2])))
        if i < len(rows):
            if rest := best(i + 1, last):
                ways.append((rest[0] + 4, "D" + rest[1], rest[2]))
            _, own, text = rows[i]
            for r, role, cost, letter in ((own[:1], own, 0, "K"), ("u", "user", 3, "R"), ("a", "assistant", 3, "R")):
                if faults[i] in ("", "truncated") and follows(last, r) and (rest := best(i + 1, r)):
                    ways.append((rest[0] + cost + 3 * (faults[i] == "truncated"), letter + rest[1], (f"{role}:{text}", *rest[2])))
        return min(ways, key=lambda w: w[:2]) if ways else None

    cost, audit, repaired = best(0, "")
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(3)
    roles = [None, "", "user", "assistant", "system", "tool", "user", "assistant"]
    texts = [None, "", " ", "Hi.", "Hi", "Yes!", "ok? ", "a\n", "longer."]
    rows = [(rng.choice([None, 2**53 + 1, *range(150)]), rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for _ in range(1500)]
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 50}." * (1 + 200 * (t == 7))) for t in range(700)]  # long, with repeats far apart
    return rows


def test_repairs_equal_all_edits(spark, talk):
    df = spark.createDataFrame([(*r, "x") for r in talk], "conv_id long, turn long, role string, text string, kind string").repartition(3)
    damaged = conversations.damage(df)
    want = {c: cheapest(v) for c, v in rows_after_damage(talk).items() if c != 900}
    for spill in (8, 1 << 20):
        got = {r[0]: tuple(r)[1:] for r in conversations.find_repairs(damaged, spill=spill).collect()}
        assert set(got) == set(want) | {900} and {c: got[c] for c in want} == want
    repairs = conversations.find_repairs(damaged)
    made = {}
    for r in conversations.apply_repairs(damaged, repairs).collect():
        made.setdefault(r.conv_id, []).append((r.position, f"{r.role}:{r.text}"))
    for conv, digest in ((r.conv_id, r.repaired_sha256) for r in repairs.collect()):
        assert hashlib.sha256("\n".join(x for _, x in sorted(made.get(conv, []))).encode()).hexdigest() == digest
    assert conversations.find_repairs(damaged.limit(0)).count() == 0


def test_repairs_equal_their_sql(spark, talk):
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", pa.table(dict(zip(["conv_id", "turn", "role", "text"], map(list, zip(*talk, strict=True)), strict=True))))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, conversations.find_repairs(conversations.damage(df)).collect()), key=key) == sorted(con.sql(OP12_SQL).fetchall(), key=key)


# Phrases


def slow_collocations(rows, least=10, top=2000):
    f, n, out = Counter(), Counter(), []
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = Counter()
    for p, a in found.items():
        if len(p) == 4:
            for sub in (p[:3], (p[0], *p[2:])):
                inside[sub] = max(inside[sub], a)
    for p, a in found.items():
        score, _, left, right = min((10**6 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1))
        if 100 * inside[p] < 50 * a:
            out.append((p[0], -score, -a, " ".join(p[1:]).encode(), left, right))
    ranked, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return ranked


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    made = [(i, None if i % 50 == 0 else " ".join(rng.choice(["a", "B", "b.", "c", "D;", "e\tf", "g\n", "é", "ÉÀ", "..", "x,y", "zz"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", None, "und", "de", "de", "de"])) for i in range(500)]
    return [*made, (None, "the very same words again and again. " * 400, "en"), (7, "", "fr"), (7, "", "fr")]


def test_phrases_equal_brute_force_and_sql(spark, texts):
    df = spark.createDataFrame([(*r, "x", 1) for r in texts], "doc_id long, text string, lang string, phrase string, n long").repartition(4)
    want = slow_collocations(texts)
    for shards, slots in ((3, 1 << 24), (2, 8)):  # of 8 slots, nearly all are frequent at once
        assert sorted(map(tuple, phrases.collocations(df, shards=shards, slots=slots).collect())) == sorted(want)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(texts, columns=["doc_id", "text", "lang"]))
    assert sorted(con.sql(f"select lang, rank, phrase, a, l, r, n, score from ({OP13_SQL})").fetchall()) == sorted(want)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_products_of_counts_may_pass_64_bits(spark):
    """The score's arithmetic alone, on counts of a large corpus."""
    big = [(9 * 10**15, 10**16 - 1, 10**16 - 3), (10**10, 10**10, 10**12), (10, 11, 12)]
    df = spark.createDataFrame(big, "a long, l long, r long")
    got = df.select(F.expr(phrases.SCORE).alias("s")).collect()
    assert [r.s for r in got] == [10**6 * a * a // (x * y) for a, x, y in big]


def test_a_phrase_is_counted_once_a_shard_from_its_step_on(spark):
    """Late words start late and still see every shard."""
    rows = [(i, "late pair here" if i > 900 else f"w{i} x{i}", "en") for i in range(1000)]
    f, sizes = phrases.count_phrases(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least=10, shards=3)
    got = {r.phrase: r.f for r in f.collect()}
    assert got == {p: 99 for p in ("late", "pair", "here", "late pair", "pair here", "late pair here")}
    assert sizes.collect() == [("en", 901 * 2 + 99 * 3)]
