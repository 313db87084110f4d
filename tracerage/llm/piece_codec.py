"""SentencePiece encoding by a table of prefixes' last tokens, and decoding (operator 11)."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_columns, lean, worker_cache
from .token_counts import META, pre_tokens, tokenizer_path

#: In a prefix table: a character that no piece holds. It merges with nothing and is spelt in bytes.
UNKNOWN = -1


class PrefixCodec:
    """Ids of texts as the merges of a model give them, without merging texts.

    The merges of every prefix of a text end in one certain token, and a row of tokens is what the
    merges give if and only if they give each two neighbours again from the two put together. So
    the last token of a prefix is the one piece that ends there (an automaton finds those) and that
    stays apart from the last token of what is before it. Read backwards, the table gives the ids.

    ``pairs`` remembers tests of neighbours, and ``words`` ids of pre-tokens; each is emptied when
    it is full, so a worker's memory has a bound.
    """

    def __init__(self, path: str, most_words: int = 300_000, most_pairs: int = 1_000_000, longest: int = 64):
        import ahocorasick
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(META in p.lstrip(META) or ("\n" in p and len(p) > 1) for p in (self.pieces[i] for i in plain)):
            raise ValueError("the model has pieces that cross words; pre-tokens can't be encoded one by one")
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.lengths = [len(p) for p in self.pieces]
        # What the merges of a piece do at its two ends, as (score, symbol after it) from the first merge on.
        self.first_after: dict[int, list[tuple[float, str]]] = {}
        self.last_after: dict[int, list[tuple[float, str]]] = {}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            if self._follow(i):  # a piece that its own merges miss is never an id
                self.automaton.add_word(self.pieces[i], i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.most_words, self.most_pairs, self.longest = most_words, most_pairs, longest

    def merges(self, text: str) -> Iterator[tuple[float, list[str]]]:
        """Score of each merge of a short text, and the symbols after it: best score first, of equals the leftmost."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = max((self.scores.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == float("-inf"):
                return
            symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
            yield best, symbols

    def _follow(self, i: int) -> bool:
        piece = self.pieces[i]
        first, last, symbols = [(float("inf"), piece[0])], [(float("inf"), piece[-1])], list(piece)
        for score, symbols in self.merges(piece):
            first.append((score, symbols[0]))
            last.append((score, symbols[-1]))
        self.first_after[i], self.last_after[i] = first, last
        return len(symbols) == 1

    def _apart(self, left: int, right: int) -> bool:
        """Whether the merges of two tokens put together keep them apart.

        Both go on side by side, the better score first and the left one of equals; a merge over
        the border comes first if it is better than the next one on the left and no worse than the
        next one on the right.
        """
        a, b, i, j, get = self.last_after[left], self.first_after[right], 0, 0, self.scores.get
        none = (float("-inf"), "")
        while True:
            next_a = a[i + 1] if i + 1 < len(a) else none
            next_b = b[j + 1] if j + 1 < len(b) else none
            over = get(a[i][1] + b[j][1])
            if over is not None and over > next_a[0] and over >= next_b[0]:
                return False
            if next_a is none and next_b is none:
                return True
            if next_a[0] >= next_b[0]:
                i += 1
            else:
                j += 1

    def apart(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(left, right)
        return known

    def last_tokens(self, text: str) -> array:
        """For each prefix of a text its last token; UNKNOWN where that is a character without a piece."""
        table, lengths, apart, pairs = array("i", [UNKNOWN]) * len(text), self.lengths, self.apart, self.pairs
        filled = -1
        for end, token in self.automaton.iter(text):
            if end == filled:
                continue
            start = end - lengths[token]
            before = table[start] if start >= 0 else UNKNOWN
            known = True if before == UNKNOWN else pairs.get(before << 20 | token)
            if known is None:
                known = apart(before, token)
            if known:
                table[end] = token
                filled = end
        return table

    def encode_symbols(self, text: str) -> tuple[int, ...]:
        """Ids of a text in which spaces are already marks: the table, read from its end."""
        table, at, out = self.last_tokens(text), len(text) - 1, []
        while at >= 0:
            token = table[at]
            if token == UNKNOWN:
                out.extend(self.bytes[b] for b in reversed(text[at].encode("utf-8", "replace")))
                at -= 1
            else:
                out.append(token)
                at -= self.lengths[token]
        out.reverse()
        return tuple(out)

    def encode_word(self, key: str) -> tuple[int, ...]:
        """Of a pre-token as pre_tokens() gives it."""
        ids = self.encode_symbols((key if key[:1] == "\n" else META + key).replace(" ", META))
        if len(key) <= self.longest:
            if len(self.words) >= self.most_words:
                self.words.clear()
            self.words[key] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, without begin or end."""
        if not text:
            return []
        get, make = self.words.get, self.encode_word
        return list(chain.from_iterable([get(k) or make(k) for k in pre_tokens(text)]))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library puts it together."""
        return self.model.decode(ids)


def encode(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id, ids, decoded`` of every whole text: ids as the library gives them, and their text again.

    Narrow: each row is encoded where it is read, nothing is shuffled or broadcast. Null and empty
    texts have no ids and the empty text. Characters that no piece holds become byte tokens. Spaces
    and their mark U+2581 are the same to the model, so the mark comes back as a space. Repeated
    rows give repeated rows; a null doc_id is kept; an empty table gives an empty table; other
    columns are ignored. A text of any length is encoded whole.
    """
    docs = doc_columns(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_cache(("piece_codec", tokenizer), lambda: PrefixCodec(tokenizer_path(tokenizer)))
        for batch in batches:
            ids, ends, decoded = array("i"), array("i", [0]), []
            for text in batch.column("text").to_pylist():
                own = codec.encode(text)
                ids.extend(own)
                ends.append(len(ids))
                decoded.append(codec.decode(own) if own else "")
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.mapInArrow(lean(run), "doc_id long, ids array<int>, decoded string")


def decode(rows: DataFrame, tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id`` and ``ids``; null ids give a null text, no ids the empty one."""
    picked = rows.selectExpr("cast(doc_id as long) as doc_id", "cast(ids as array<int>) as ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_cache(("piece_codec", tokenizer), lambda: PrefixCodec(tokenizer_path(tokenizer)))
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) if ids else "" for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return picked.mapInArrow(lean(run), "doc_id long, text string")
