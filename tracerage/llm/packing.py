"""Best-fit packing planned over a histogram of lengths (operator 6)."""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GROUP, doc_columns, hash_order, lean, materialise, range_slot, running_sum, slices, worker_cache
from .token_counts import tokenizer_path

#: The id that ends each document.
END = 0
_LOW = [chr(i) for i in range(0x21, 0x180) if not 0x7F <= i <= 0xA0]


def _set(kind: str) -> str:
    return "".join(re.escape(c) for c in _LOW if unicodedata.category(c)[0] == kind)


#: The pre-tokens of the vocabulary file, for texts of plain Latin letters and signs.
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_set('L')}]+|[{_set('N')}]|[^\\s{_set('L')}{_set('N')}]+")
#: A word with anything else goes to the library as it is: other scripts, marks, controls, a capital whose
#: lower case is two characters, and what may be a special token.
ODD = re.compile("[^!-~\xa1-įı-ſ]|<\\|")
#: A letter, then stops up to white space: between them is always a border of pre-tokens. Not after a
#: letter whose lower case ends in a combining mark, which joins the stops.
LONGER = "".join(c for c in map(chr, range(0x10000)) if c.isalpha() and len(c.lower()) > 1)
STOPS = rf"([^\PL{LONGER}])([.,;:!?]+)(\s|$)"


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class WordIds:
    """Ids of texts, word by word from a worker's cache that holds about ``most`` bytes.

    No pre-token crosses white space, so a text's ids are its words' ids in a row. A word is a run
    of bytes without ASCII white space, or the stops at its end; all distinct words of a chunk of
    texts are looked up at once. Pre-tokens of unknown words go to the library as one text, in which
    tokens that end a pre-token tell where each one stops. A word with any odd character goes to it
    by itself. When the cache is full, the half of the words that was not met for longest goes.
    """

    #: About what a key takes beside its characters: two objects, their places, some ids.
    EACH = 200

    def __init__(self, path: str, most: int = 64 << 20):
        from tokenizers import Tokenizer

        self.model, self.most = Tokenizer.from_file(path), most
        self.model.no_truncation()
        self.model.no_padding()
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.slots: dict[str, int] = {"": 0}
        self.starts, self.lengths, self.met = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0
        self.turn = self.held = 0

    def forget(self) -> None:
        kept = self.met > np.median(self.met)
        kept[0] = True
        places = np.cumsum(kept) - 1
        self.slots = {w: int(places[s]) for w, s in self.slots.items() if kept[s]}
        lengths = self.lengths[kept]
        ids = self.store[_ranges(self.starts[kept], lengths)]
        self.store, self.used = ids.copy(), len(ids)
        self.starts, self.lengths, self.met = np.cumsum(lengths) - lengths, lengths, self.met[kept]
        self.held = sum(map(len, self.slots)) + self.EACH * len(self.slots)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """New slots for words that have none."""
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.zeros(self.used + len(ids), np.uint32)])
        self.store[self.used : self.used + len(ids)] = ids
        self.slots |= dict(zip(words, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.met = np.concatenate([self.met, np.full(len(words), self.turn)])
        self.used += len(ids)
        self.held += sum(map(len, words)) + self.EACH * len(words)

    def learn(self, words: list[str]) -> None:
        odd = [w for w in words if ODD.search(w)]
        if odd:
            made = [self.encode(w) for w in odd]
            self.keep(odd, np.concatenate(made), np.array([len(m) for m in made]))
        splits = {}
        for w in words if not odd else [w for w in words if w not in self.slots]:
            low = w.lower()
            if low.isalpha():
                splits[w] = (low,)
            elif low[:-1].isalpha() and not low[-1].isalnum():
                splits[w] = (low[:-1], low[-1])
            else:
                splits[w] = SPLIT.findall(low)
        unknown = list({p for parts in splits.values() for p in parts if p not in self.slots})
        for lo in range(0, len(unknown), 4096):  # what the library makes of a text is many times its size
            new = unknown[lo : lo + 4096]
            ids = self.encode(" ".join(new))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(new):
                made = [self.encode(p) for p in new]
                ids, stops = np.concatenate(made), np.cumsum([len(m) for m in made])
            self.keep(new, ids, np.diff(stops, prepend=0))
        rest = [w for w in splits if w not in self.slots]
        if rest:
            parts = np.array([self.slots[p] for w in rest for p in splits[w]], np.int64)
            lengths = self.lengths[parts]
            ids = self.store[_ranges(self.starts[parts], lengths)]
            before = np.concatenate([[0], np.cumsum(lengths)])
            self.keep(rest, ids, np.diff(before[np.cumsum([len(splits[w]) for w in rest])], prepend=0))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has. A null text has none."""
        texts = pc.replace_substring_regex(texts.fill_null("").cast(pa.large_string()), STOPS, r"\1 \2\3")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.held > self.most:
            self.forget()
        self.turn += 1
        slots = list(map(self.slots.get, words))
        if None in slots:
            missing = [w for w, s in zip(words, slots, strict=True) if s is None]
            self.learn(missing)
            slots = list(map(self.slots.__getitem__, words))
        here = np.array(slots, np.int64)
        self.met[here] = self.turn
        at = here[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        ids = self.store[_ranges(self.starts[at], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(ends)


def pieces(docs: DataFrame, tokenizer: str, size: int, chunk: int = 2 << 20) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents' ids and an id 0, cut if longer than a sequence.

    Texts are taken in chunks of about ``chunk`` bytes, which bounds the memory of a worker by that
    or by the longest text.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(doc_ids: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        full = np.full(len(ids) + len(counts), END, "<u4")
        full[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        counts = counts + 1
        first = np.cumsum(counts) - counts
        pieces_of = -(-counts // size)
        doc = np.repeat(np.arange(len(counts)), pieces_of)
        piece = _ranges(np.zeros(len(counts), np.int64), pieces_of)
        start = piece * size
        length = np.minimum(size, counts[doc] - start)
        data = memoryview(full.tobytes())
        sums = [zlib.crc32(data[4 * lo : 4 * hi]) for lo, hi in zip((first[doc] + start).tolist(), (first[doc] + start + length).tolist(), strict=True)]
        return [doc_ids.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache(("packing", tokenizer), lambda: WordIds(tokenizer_path(tokenizer)))
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(), chunk):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(cut(part.column("doc_id"), *words.ids(part.column("text"))), names)

    return docs.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: ``(runs, sequences)``.

    A run ``(length, from, to, sequence, each, offset)`` puts the pieces of a length with ranks in
    [from, to) into successive sequences, ``each`` of them side by side from ``offset``. A piece
    goes to the fullest sequence with room; those with equal room are handled together, so the
    work and the plan grow with the number of lengths, not of pieces.
    """
    free: list[int] = []  # rooms that some sequences have, ascending
    rooms: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
    runs, used = [], 0

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in rooms:
                rooms[room] = []
                insort(free, room)
            rooms[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                room = free[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    free.pop(at)
            else:
                room, first = size, used
                n = -(-left // (size // length))
                used += n
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, size - room))
                give(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if left and n:  # fewer are left than one of these sequences takes
                runs.append((length, rank, rank + left, first, left, size - room))
                give(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            give(room, first, n)
    return runs, used


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", size: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A document is its ids and an id 0. Only the histogram of piece lengths (``size`` rows at most)
    reaches the driver, where the plan is made over counts; pieces get their rank within their
    length, in ranges of hashes so that one frequent length is spread over tasks, and take the slot
    that the plan has for that rank. Sequences are gapless from offset 0.

    Null and empty texts are one piece of length 1. Repeated rows are packed each on its own; null
    doc_ids are kept; an empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    made = materialise(pieces(doc_columns(docs, "doc_id", "text"), tokenizer, size), "pieces")
    histogram = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    runs, _ = plan(histogram, size)
    by_length: dict[int, list] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(tuple(run))
    shape = "length long, slots long, runs array<struct<lo:long,hi:long,sequence:long,each:long,at:long>>"
    slots = spark.createDataFrame([(k, max(1, -(-histogram[k] // GROUP)), v) for k, v in by_length.items()], shape)
    # At most ``size`` lengths, and runs as many as their number bounds: broadcast.
    rows = made.join(F.broadcast(slots.select("length", "slots")), "length")
    rows = rows.withColumn("order", hash_order("doc_id", "piece", "ids_crc32")).withColumn("slot", range_slot("order", "slots")).withColumn("one", F.lit(1))
    ranked = running_sum(rows, ["length"], ["order", "doc_id", "piece"], "one", "rank")
    placed = ranked.join(F.broadcast(slots.select("length", "runs")), "length").withColumn("r", F.expr("filter(runs, r -> r.lo <= rank and rank < r.hi)[0]"))
    placed = placed.withColumn("sequence_id", F.expr("r.sequence + (rank - r.lo) div r.each")).withColumn("offset", F.expr("r.at + (rank - r.lo) % r.each * length"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
