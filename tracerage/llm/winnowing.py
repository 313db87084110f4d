"""Document fingerprints by winnowing (operator 3)."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, hash_order, mix64, range_slot, worker_cache

GRAM, WINDOW = 24, 64


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """32-bit hashes of all runs of ``gram`` code points; of the whole text if it is shorter.

    Runs double in length: the hash of 2m code points is that of the first m times a power of the
    base plus that of the next m, so it takes log2(gram) passes over the text.
    """
    if not len(codes):
        return np.zeros(0, np.uint64)
    n, base = min(gram, len(codes)), 0x9E3779B97F4A7C15
    part, have, out, taken = mix64(codes.astype(np.uint64) + np.uint64(1)), 1, None, 0
    total = len(codes) - n + 1
    while True:
        if n & have:
            piece = part[taken : taken + total]
            out = piece if out is None else out * np.uint64(pow(base, have, 1 << 64)) + piece
            taken += have
        if have * 2 > n:
            break
        part = part[:-have] * np.uint64(pow(base, have, 1 << 64)) + part[have:]
        have *= 2
    return mix64(out) >> np.uint64(32)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Chosen ``(hash << 32 | position)`` in order of position.

    Of each window of ``window`` successive hashes the smallest is chosen, of equal ones the
    rightmost. Texts that share gram + window - 1 code points in a row share a chosen hash. A text
    with fewer hashes than a window gives its smallest; an empty text gives none.
    """
    hashes = gram_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), gram)
    if not len(hashes):
        return hashes
    at = np.arange(len(hashes), dtype=np.uint64)
    low = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - at)  # the least has the rightmost position
    n, have, out, taken = min(window, len(low)), 1, None, 0
    total = len(low) - n + 1
    while True:
        if n & have:
            piece = low[taken : taken + total]
            out = piece if out is None else np.minimum(out, piece)
            taken += have
        if have * 2 > n:
            break
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    chosen = out[keep]
    return chosen & ~np.uint64(0xFFFFFFFF) | (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of chosen hashes; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(chosen: np.ndarray) -> str:
    """Base64 of little-endian pairs (position, hash), each an unsigned 32-bit integer."""
    return base64.b64encode(chosen.astype("<u8").tobytes()).decode()


def half_replaced(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows dealt over buckets that follow each other: ``bucket, ghost, tie``, key and text.

    Rows go by key, null keys first, rows of one key by a hash of their text (``tie``). A bucket
    also gets, as a ghost, the first row of the next bucket that has rows (the last bucket that of
    the first one), so each row's successor is in its own bucket and every text is shuffled once.
    Buckets are cut at quantiles of the key; a key that fills several of them, and the rows without
    one, are cut by ranges of the hash too. The driver only sees the cuts and each bucket's least
    key and hash.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    many = Counter(int(np.clip(c, -(2.0**63), 2.0**63 - 1024)) for c in cuts)
    edges = sorted(many)
    # Keys from edge i on fill the slots from base i + 1 on; the edge itself all but the last of them.
    base = np.cumsum([buckets, 1, *(many[e] for e in edges)])[:-1].tolist()
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    at = F.size(F.filter(longs(edges), lambda e: e <= F.col(key))) if edges else F.lit(0)
    rows = docs.withColumn("tie", hash_order("text")).withColumn("__at", at)
    width = F.when(F.col(key).isNull(), buckets)
    start = F.when(F.col(key).isNull(), 0)
    if edges:
        edge = F.get(longs(edges), F.col("__at") - 1)
        width = width.when(F.col(key) == edge, F.get(longs([many[e] for e in edges]), F.col("__at") - 1))
        last = F.get(longs([many[e] - 1 for e in edges]), F.col("__at") - 1)
        start = start.when((F.col(key) == edge) | (F.col("__at") == 0), F.get(longs(base), F.col("__at"))).otherwise(F.get(longs(base), F.col("__at")) + last)
    else:
        start = start.otherwise(F.lit(buckets))
    rows = rows.withColumn("__width", width.otherwise(1)).withColumn("__start", start)
    rows = rows.withColumn("bucket", (F.col("__start") + range_slot("tie", "__width")).cast("int")).drop("__at", "__width", "__start")
    least = rows.groupBy("bucket").agg(F.min(F.struct(F.col(key).isNotNull().alias("has"), F.col(key).alias("k"), "tie")).alias("least")).select("bucket", "least.k", "least.tie").collect()
    ordered = sorted((tuple(r) for r in least), key=lambda r: r[0])
    if not ordered:
        return rows.withColumn("ghost", F.lit(False))
    first = spark.createDataFrame([(b, k, tie, ordered[i - 1][0]) for i, (b, k, tie) in enumerate(ordered)], "b int, k long, t long, home int")
    # One row for each bucket: bounded by their number, so it is broadcast.
    marked = rows.join(F.broadcast(first), (F.col("bucket") == F.col("b")) & F.col(key).eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t")), "left")
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("ghost"))
    homes = F.when(F.col("home").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("home").alias("b"), F.lit(True).alias("ghost"))))
    return marked.withColumn("x", F.explode(homes)).select(F.col("x.b").alias("bucket"), F.col("x.ghost").alias("ghost"), "tie", *docs.columns)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Winnowed fingerprints of every whole text and of its half-replaced text, with likenesses.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    The next document is the one with the next larger doc_id, after the last the first. Null
    doc_ids come first, so where there is one it follows the last document; rows of one doc_id go by
    a hash of their text. A null text is empty; its fingerprint is the empty string and is like
    another empty one (1.0) and unlike any other (0.0). A single document is its own successor. Every
    row gives a row. An empty table gives an empty table; other columns are ignored.
    """
    docs = doc_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache()
        held: tuple | None = None  # bucket, doc_id, text, chosen

        def finish(doc: tuple, following: tuple) -> tuple:
            _, doc_id, text, chosen = doc
            edited = half_replaced(text, following[2])
            again = winnow(edited, gram, window)
            sets = [np.unique(x >> np.uint64(32)) for x in (chosen, again, following[3])]
            return doc_id and int(doc_id), len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), as_text(chosen), as_text(again), likeness(sets[0], sets[1]), likeness(sets[0], sets[2])

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for pdf in batches:
            out = []
            for bucket, ghost, doc_id, text in zip(pdf["bucket"], pdf["ghost"], pdf["doc_id"], pdf["text"], strict=True):
                if held is not None and held[0] == bucket:
                    now = (bucket, doc_id, text, winnow(text, gram, window))
                    out.append(finish(held, now))
                    held = None if ghost else now
                elif not ghost:
                    held = (bucket, doc_id, text, winnow(text, gram, window))
                # else a second ghost of a repeated key: the first has served
                if len(out) >= 256:
                    yield _frame(out, names)
                    out = []
            if out:
                yield _frame(out, names)

    dealt = with_next(docs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "ghost", F.col("doc_id").asc_nulls_first(), "tie", "text").drop("tie")
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))  # as strings, ids keep all their digits beside nulls in pandas
    return dealt.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    out["doc_id"] = pd.array([r[0] for r in rows], "Int64")
    return out
