"""Token counts by a two-tier lookup of pre-token lengths (operator 1)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import doc_columns, worker_cache
from .heavy import heavy_hitters

META = "▁"
PIECES = re.compile(r"\n[^ \n]*| +[^ \n]*")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its one leading space.

    No piece of the vocabulary has the space mark anywhere but at its start or a line feed beside
    another character, so no merge crosses a boundary between a character and a space or a line
    feed. Lengths of pre-tokens therefore add up to the length of the text. A pre-token that
    begins with a line feed has no space before it; any other has one, or more that are kept.
    """
    if META in text:
        text = text.replace(META, " ")
    words = text.replace("\n", " \n").split(" ")
    if "" in words:
        words = [p if p[0] == "\n" else p[1:] for p in PIECES.findall(" " + text)]
    return words


class Encoder:
    """Lengths from the library itself, kept in a bounded cache of the worker."""

    def __init__(self, path: str, most: int = 500_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most = most
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.additive = not any(META in p.lstrip(META) or ("\n" in p and len(p) > 1) for p in pieces)

    def length(self, key: str) -> int:
        """Of a pre-token as pre_tokens() gives it; the library puts one space before any text."""
        n = len(self.model.encode(key)) if key else 1
        return n - 1 if key[:1] == "\n" else n


class Misses(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, key: str) -> int:
        if len(self) >= self.encoder.most:
            self.clear()
        n = self[key] = self.encoder.length(key)
        return n


class Lookup(dict):
    """First tier: the broadcast table. What it lacks goes to the worker's cache."""

    def __init__(self, blob: tuple[bytes, bytes], misses: Misses):
        keys, lengths = blob
        super().__init__(zip(keys.decode().split("\0"), np.frombuffer(lengths, np.uint16).tolist(), strict=True) if lengths else ())
        self.misses = misses

    def __missing__(self, key: str) -> int:
        return self.misses[key]


def frequent_table(docs: DataFrame, size: int, longest: int, path: str) -> tuple[bytes, bytes]:
    """Lengths of frequent pre-tokens as one compact blob, of at most ``size`` keys of ``longest`` characters."""

    def keys_of(batch: pa.RecordBatch) -> Iterator[dict]:
        counts: Counter = Counter()
        for text in batch.column("text").to_pylist():
            if text:
                counts.update(pre_tokens(text))
                if len(counts) > 4 * size:
                    yield {k: c for k, c in counts.items() if c > 1 and len(k) <= longest and "\0" not in k}
                    counts = Counter()
        yield {k: c for k, c in counts.items() if c > 1 and len(k) <= longest and "\0" not in k}

    encoder = Encoder(path)
    keys = sorted(k for k, _ in heavy_hitters(docs, keys_of, "string", size))
    return "\0".join(keys).encode(), np.array([encoder.length(k) for k in keys], np.uint16).tobytes()


def count_tokens(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = 4096, table_size: int = 1 << 15, longest_key: int = 48) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, as the library counts them.

    A broadcast table of at most ``table_size`` frequent pre-tokens of at most ``longest_key``
    characters answers most look-ups; others go through the library once per worker cache. No
    pre-token is shuffled: the table comes from bounded summaries. It decides speed, never a count.

    Null and empty texts count 0 bytes and tokens. Repeated rows give repeated rows; a null doc_id
    is kept; an empty table gives an empty table; other columns are ignored.
    """
    spark, docs = docs.sparkSession, doc_columns(docs, "doc_id", "text")
    path = tokenizer_path(tokenizer)
    if not Encoder(path).additive:
        raise ValueError(f"{tokenizer} has pieces that cross words; its lengths don't add up")
    table = spark.sparkContext.broadcast(frequent_table(docs.select("text"), table_size, longest_key, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        misses = worker_cache(("token_counts", tokenizer), lambda: Misses(Encoder(tokenizer_path(tokenizer))))
        get = Lookup(table.value, misses).__getitem__
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column("text").to_pylist():
                n_bytes.append(len(text.encode()) if text else 0)
                n_tokens.append(sum(map(get, pre_tokens(text))) if text else 0)
            n_tokens = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), n_tokens, pc.greater(n_tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
