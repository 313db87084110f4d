"""Phrase collocations by dynamic itemset counting (operator 13)."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import lean, lower_ascii, materialise, mix64, shared_dir, small_batches, text_chunks, worker_cache

#: Bytes that end a word, and bytes that end a piece as well.
GAPS = b" \t"
STOPS = b".,;:!?\n\v\f\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)] = 1
_KIND[list(STOPS)] = 2
_LOWER = lower_ascii(np.arange(256, dtype=np.uint8))
_BYTE = np.where(_KIND == 0, mix64(_LOWER.astype(np.uint64) + np.uint64(1)), np.uint64(0))
NEVER = 255
#: Bytes of a chunk of texts, counts that a task holds before it hands them on, and bytes of texts whose counts make a range.
CHUNK, HELD, RANGE = 2 << 20, 1 << 21, 32 << 20
#: Slots of one of Spark's bitmaps.
BITS = 32_768
#: floor(10^6 a a / (l r)) in decimals: exact below 10^16 occurrences.
SCORE = "(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends, hashes, rows, joined`` of the words of a chunk of texts; A to Z hash as a to z.

    ``joined`` tells whether a word and the next one stand in one piece.
    """
    none = np.zeros(0, np.int64)
    kind = _KIND[data]
    inside = kind == 0
    if not inside.any():
        return none, none, none.astype(np.uint64), none, none.astype(bool)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    joined = np.zeros(len(starts), bool)
    joined[:-1] = rows[1:] == rows[:-1]
    after = np.searchsorted(starts, np.flatnonzero(kind == 2))
    joined[after[after > 0] - 1] = False
    # A polynomial in each byte's place in the chunk, divided by that of the word's start; other bytes are 0.
    powers, inverse = _powers(len(data))
    return starts, ends, mix64(np.add.reduceat(_BYTE[data] * powers, starts) * inverse[starts]), rows, joined


_known: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64; those of a usual chunk are kept."""
    if not _known:
        _known.append(_powers_of(CHUNK))
    return tuple(p[:n] for p in (_known[0] if n <= CHUNK else _powers_of(n)))


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = [np.full(n, x, np.uint64) for x in (0x9FB21C651E98DF25, pow(0x9FB21C651E98DF25, -1, 1 << 64))]
    for p in out:
        p[0] = 1
        np.cumprod(p, out=p)
    return out[0], out[1]


def phrase_hashes(hashes: np.ndarray, joined: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, from 1: the hash of the phrase that begins at each word, and whether there is one."""
    out = [(hashes, np.ones(len(hashes), bool))]
    for n in range(1, longest):
        before, there = out[-1]
        made, ok = before.copy(), np.zeros(len(hashes), bool)
        if len(hashes) > n:
            made[:-n] = mix64(before[:-n] * np.uint64(0xD1342543DE82EF95) + hashes[n:])
            ok[:-n] = there[:-n] & joined[n - 1 : len(hashes) - 1]
        out.append((made, ok))
    return out


class Scan:
    """One scan of a shard: counts of the phrases that are active at this step.

    ``reached[n]`` has for each slot of hashes the step from which phrases of n words in it count as
    maybe frequent. A phrase both of whose parts (all but the last word, all but the first) are so
    far maybe frequent is counted by hash, for one cycle of ``shards`` steps; one that is maybe
    frequent itself is counted by its words, for one cycle from then on. Single words, few as they
    are, are counted as such from the first step. Phrases that share a slot may start earlier than
    needed, never later or for less than a cycle.
    """

    def __init__(self, reached: dict[int, np.ndarray], step: int, shards: int, longest: int):
        self.reached, self.step, self.shards, self.longest = reached, step, shards, longest

    def due(self, since: np.ndarray) -> np.ndarray:
        return (since <= self.step) & (self.step < since + self.shards)

    def since(self, n: int, hashes: np.ndarray) -> np.ndarray:
        table = self.reached.get(n)
        return np.full(len(hashes), NEVER, np.int16) if table is None else table[slot_of(hashes, len(table))].astype(np.int16)

    def counts(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> Iterator[tuple[int, np.ndarray, tuple | None]]:
        """``words, hashes, named`` of a chunk for each length: a hash for each occurrence, or distinct ones with ``named`` = ``counts, rows, phrases``."""
        starts, ends, hashes, rows, joined = words_of(data, offsets)
        if not len(starts):
            return
        hashes = mix64(hashes ^ langs[rows])
        before = np.zeros(0, np.int16)
        for n, (own, there) in enumerate(phrase_hashes(hashes, joined, self.longest), 1):
            if n > 1:
                since = np.full(len(own), NEVER, np.int16)
                since[:-1] = np.maximum(before[:-1], before[1:])
                maybe = there & self.due(since)
                if maybe.any():
                    yield n, own[maybe], None
            before = self.since(n, own)
            due = np.flatnonzero(there & self.due(before if n > 1 else np.zeros(len(own), np.int16)))
            if len(due):
                order = np.argsort(own[due])
                keys, count, new = runs(own[due[order]])
                at = due[order[new]]
                yield n, keys, (count, rows[at], phrases_at(data, starts, ends, at, n))


def runs(ordered: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of an ordered array, how often each comes (or its sum of weights), and where it begins."""
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(ordered))) if weights is None else np.add.reduceat(weights, new) if len(new) else weights[:0]
    return ordered[new], count.astype(np.int64), new


def phrases_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The phrases of n words that begin at the given words, in lower case, a space between words."""
    sizes = [ends[at + k] - starts[at + k] for k in range(n)]
    offsets = np.zeros(len(at) + 1, np.int64)
    np.cumsum(sum(sizes) + (n - 1), out=offsets[1:])
    out = np.full(offsets[-1], 0x20, np.uint8)
    to = offsets[:-1]
    for k, size in enumerate(sizes):
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + step] = _LOWER[data[np.repeat(starts[at + k], size) + step]]
        to = to + size + 1
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.string())


class Held:
    """Counts of a task, added up and handed on in packs: one for each range of hashes that has any.

    Within a task, as within a chunk, phrases of a language with equal hashes of 64 bits are one; over
    tasks, named ones are told apart by their words.
    """

    schema = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("words", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("phrases", pa.string())])

    def __init__(self, ranges: int):
        self.ranges, self.bare, self.named, self.bare_size, self.named_size = ranges, {}, {}, 0, 0

    def add(self, n: int, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.bare.setdefault(n, []).append(hashes)
        self.bare_size += len(hashes)
        if self.bare_size >= HELD:
            yield from self.bare_packs()

    def add_named(self, lang: str, n: int, hashes: np.ndarray, count: np.ndarray, phrases: pa.Array) -> Iterator[pa.RecordBatch]:
        self.named.setdefault((lang, n), []).append((hashes, count, phrases))
        # A phrase counts for its bytes too, however long it is.
        self.named_size += len(hashes) + phrases.nbytes // 32
        if self.named_size >= HELD:
            yield from self.named_packs()

    def bare_packs(self) -> Iterator[pa.RecordBatch]:
        for n in list(self.bare):
            keys, count, _ = runs(np.sort(np.concatenate(self.bare.pop(n))))
            yield self.pack(None, n, keys, count, None)
        self.bare_size = 0

    def named_packs(self) -> Iterator[pa.RecordBatch]:
        for lang, n in list(self.named):
            hashes, count, phrases = zip(*self.named.pop((lang, n)), strict=True)
            hashes = np.concatenate(hashes)
            order = np.argsort(hashes)
            keys, count, new = runs(hashes[order], np.concatenate(count)[order])
            yield self.pack(lang, n, keys, count, pa.chunked_array(phrases).combine_chunks().take(pa.array(order[new])))
        self.named_size = 0

    def pack(self, lang: str | None, n: int, keys: np.ndarray, count: np.ndarray, phrases: pa.Array | None) -> pa.RecordBatch:
        at, _, new = runs(((keys >> np.uint64(32)) * np.uint64(self.ranges)) >> np.uint64(32))
        offsets = np.append(new, len(keys)).astype(np.int32)
        packed = lambda x: pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets * np.int32(8)), pa.py_buffer(np.ascontiguousarray(x))])
        # No phrase has a line feed: it ends a piece.
        joined = pa.nulls(len(at), pa.string()) if phrases is None else pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), phrases), "\n")
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), n, np.int32)), packed(keys), packed(count), joined], schema=self.schema)


def added_up(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """``lang, words, phrase, hash, n`` of all packs of a range: sums by phrase, and by hash those of ``least`` or more."""
    bare, named = {}, {}
    numbers = lambda packs, kind: np.frombuffer(b"".join(packs.to_pylist()), kind)
    for batch in batches:
        for n in pc.unique(batch.column("words")).to_pylist():
            mine = batch.filter(pc.equal(batch.column("words"), n))
            some = mine.filter(pc.is_null(mine.column("phrases")))
            if len(some):
                bare.setdefault(n, []).append((numbers(some.column("hashes"), np.uint64), numbers(some.column("counts"), np.int64)))
            some = mine.filter(pc.is_valid(mine.column("phrases")))
            if len(some):
                phrases = pc.split_pattern(some.column("phrases"), "\n")
                langs = some.column("lang").take(pc.list_parent_indices(phrases))
                named.setdefault(n, []).append(pa.table([langs, phrases.flatten(), numbers(some.column("hashes"), np.int64), numbers(some.column("counts"), np.int64)], ["lang", "phrase", "hash", "n"]))
    for n, packs in bare.items():
        keys = np.concatenate([k for k, _ in packs])
        order = np.argsort(keys)
        keys, count, _ = runs(keys[order], np.concatenate([c for _, c in packs])[order])
        much = count >= least
        yield from counted_rows(n, pa.nulls(int(much.sum()), pa.string()), pa.nulls(int(much.sum()), pa.string()), keys[much].view(np.int64), count[much])
    for n, packs in named.items():
        sums = pa.concat_tables(packs).group_by(["lang", "phrase", "hash"]).aggregate([("n", "sum")]).combine_chunks()
        yield from counted_rows(n, *(sums.column(c) for c in ("lang", "phrase", "hash", "n_sum")))


def counted_rows(n: int, lang, phrase, hashes, count) -> list[pa.RecordBatch]:
    return pa.table([lang, pa.array(np.full(len(lang), n, np.int32)), phrase, hashes, count], ["lang", "words", "phrase", "hash", "n"]).to_batches(max_chunksize=1 << 16)


def slot_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def scan(docs: DataFrame, reached: dict[int, np.ndarray], step: int, shards: int, longest: int, least_here: int, ranges: int) -> DataFrame:
    """``lang, words, phrase, hash, n`` of one shard: exact counts, and without lang and phrase those by hash of ``least_here`` or more.

    A task adds its counts up and packs them by ``ranges`` of hashes, and Spark deals out the packs by
    range: rare phrases, nearly all there are, cost a few bytes each and no row.
    """
    # Tables are sparse, or of few values: compressed, they are small; a worker unpacks those of a step once.
    sent = docs.sparkSession.sparkContext.broadcast({n: zlib.compress(t.tobytes(), 1) for n, t in reached.items()})
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = worker_cache(("phrases", run_id), lambda: {n: np.frombuffer(zlib.decompress(t), np.uint8) for n, t in sent.value.items()})
        work, held = Scan(tables, step, shards, longest), Held(ranges)
        for batch in batches:
            named = batch.column("lang").dictionary_encode()
            names = named.dictionary.to_pylist()
            codes = named.indices.to_numpy()
            own = np.array([hash_text(name) for name in names], np.uint64)
            for lo, hi, data, offsets in text_chunks(batch.column("text"), CHUNK):
                here = codes[lo:hi]
                for n, keys, found in work.counts(data, offsets, own[here]):
                    if found is None:
                        yield from held.add(n, keys)
                        continue
                    count, rows, phrases = found
                    for code in np.unique(here[rows]).tolist():
                        mine = np.flatnonzero(here[rows] == code)
                        yield from held.add_named(names[code], n, keys[mine], count[mine], phrases.take(pa.array(mine)))
        yield from held.bare_packs()
        yield from held.named_packs()

    def reduce_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added_up(batches, least_here)

    packs = docs.select("lang", "text").mapInArrow(lean(run), "range int, lang string, words int, hashes binary, counts binary, phrases string")
    return packs.repartitionById(ranges, F.col("range")).mapInArrow(lean(reduce_packs), "lang string, words int, phrase string, hash long, n long")


def hash_text(text: str) -> int:
    """64 bits of a short text."""
    out = 0xCBF29CE484222325
    for b in text.encode():
        out = (out ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return out


def sharded(docs: DataFrame, shards: int) -> tuple[list[DataFrame], int]:
    """``lang, text`` in shards of about equal size, each in a folder of its own (a scan reads its shard only), and all texts' bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    have = {c.lower() for c in docs.columns}
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in have else F.lit("und")
    picked = docs.select(lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    path = f"{shared_dir(spark).rstrip('/')}/phrase-shards-{uuid.uuid4().hex}"
    dealt = picked.withColumn("shard", F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    seen = Observation("phrase-shards")
    dealt.observe(seen, F.sum(F.octet_length("text")).alias("bytes")).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    every = spark.read.schema("lang string, text string, shard int").parquet(path)
    return [every.where(F.col("shard") == s) for s in range(shards)], seen.get.get("bytes") or 0


def count_phrases(docs: DataFrame, least: int = 10, longest: int = 3, shards: int = 3, slots: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """``lang, words, phrase, f`` of all phrases with f >= least, and ``lang, n`` of all words.

    Dynamic itemset counting: shards are scanned in a cycle, all lengths at once. A phrase that has
    ``least`` occurrences in all has a ``shards``-th part of them in some shard, so it is maybe
    frequent once a scan counts that many. From the next shard on it is counted by its words until
    it has seen every shard once, and longer phrases both of whose parts are maybe frequent are
    counted by hash, until they have seen every shard once too. Nothing frequent is missed, and
    counts that are kept are exact and over all shards. Rare phrases are shuffled once, as hashes,
    and never stored.

    What is maybe frequent is told to tasks by tables of ``slots`` bytes: they bound what is sent
    and what the driver holds, decide what is counted needlessly, never a result.
    """
    (parts, size), tables, reached = sharded(docs, shards), [], {}
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // shards // RANGE))
    step, until, bits, here = 0, shards, slots.bit_length() - 1, -(-least // shards)
    while step < until:
        counted = materialise(scan(parts[step % shards], reached, step, shards, longest, here, ranges), f"phrases-{step}")
        tables.append(counted.where("phrase is not null"))
        slot = (F.shiftrightunsigned("hash", 64 - bits) + 1).alias("slot")
        found = counted.where(F.col("phrase").isNull() | ((F.col("words") == 1) & (F.col("n") >= here))).select("words", slot)
        # Bitmaps of 32,768 slots each: what the driver gets is bounded by the number of slots.
        maps = found.groupBy("words", F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
        for n in {r["words"] for r in maps}:
            table = reached.get(n, np.full(slots, NEVER, np.uint8)).copy()
            fresh = False
            for r in maps:
                if r["words"] == n:
                    part = table[(r["bucket"] - 1) * BITS : r["bucket"] * BITS]
                    new = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")[: len(part)].astype(bool) & (part == NEVER)
                    part[new] = step + 1
                    fresh |= bool(new.any())
            if fresh:
                reached = reached | {n: table}
                until = max(until, step + 1 + shards)
        step += 1
    counted = reduce(DataFrame.unionByName, tables)
    totals = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    sizes = counted.where("words = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    return materialise(totals, "phrases"), sizes


def _joined(first: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("w", first, length), " ")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, share: int = 50, shards: int = 3, slots: int = 1 << 24) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    Phrases of 2 to ``longest`` words within a piece of text with ``a`` >= ``least`` occurrences. A
    phrase is cut where floor(10^6 a a / (l r)) is least (of equals, first), l and r being the
    occurrences of its two parts; n counts the language's words. A phrase is left out if a longer
    candidate around it has at least ``share`` percent of its occurrences. Order: score and a from
    the largest, then the phrase's bytes.

    Exact: decimals of 38 digits hold every product as long as no count passes 10^16. Counts are
    summed within tasks before anything is shuffled, by language and phrase, so neither a hot
    language nor a hot word meets in one task; joins are one row to one. Null texts are empty, a
    null lang is ``und``; repeated rows count again; an empty table gives an empty table; other
    columns are ignored, doc_id too.
    """
    f, sizes = count_phrases(docs, least, longest, shards, slots)
    candidates = f.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(1, F.col("k")).alias("left"), F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")).alias("w")).withColumn("right", F.array_join("w", " ")).drop("w")
    known = f.select("lang", F.col("phrase").alias("part"), F.col("f").alias("n_part"))
    cuts = cuts.join(known.withColumnsRenamed({"part": "left", "n_part": "l"}), ["lang", "left"]).join(known.withColumnsRenamed({"part": "right", "n_part": "r"}), ["lang", "right"])
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # Every shorter phrase of two words or more within a candidate, with the candidate's occurrences.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    around = candidates.where("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
