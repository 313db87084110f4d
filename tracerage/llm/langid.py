"""Language identification: family first, then pairwise linear SVMs within it (operator 7)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_columns, lean, small_batches, text_chunks, worker_cache

DIM = 4096
UNKNOWN = "und"
#: Letters and all bytes of other alphabets as they are; the rest is a gap.
_KEEP = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def vectors(texts: pa.Array, dim: int = DIM) -> Iterator[np.ndarray]:
    """Unit vectors of hashed byte pairs and triples of lower-case texts, a block of rows at a time."""
    lowered = pa.array([(t or "").lower() for t in texts.to_pylist()], pa.string())
    for lo, hi, data, offsets in text_chunks(lowered):
        rows = hi - lo
        counts = np.zeros(rows * dim, np.float64)
        if len(data) > 1:
            code = _KEEP[data].astype(np.uint32)
            row = np.repeat(np.arange(rows), np.diff(offsets))
            for n in (2, 3):
                if len(code) < n:
                    continue
                gram = code[: len(code) - n + 1].copy()
                for j in range(1, n):
                    gram = gram * np.uint32(257) + code[j : len(code) - n + 1 + j]
                slot = (gram * np.uint32(2654435761) >> np.uint32(12)) % np.uint32(dim)
                whole = row[: len(gram)] == row[n - 1 :]
                counts += np.bincount(row[: len(gram)][whole] * dim + slot[whole], minlength=rows * dim)
        x = np.sqrt(counts.reshape(rows, dim)).astype(np.float32)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        yield x / np.maximum(norm, 1e-12)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, steps: int = 40) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge) by accelerated gradient steps; y is 1 or -1.

    Steps are of a problem whose curvature spans a factor of about 20, so 40 leave next to nothing.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1))).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    scale = np.float32(c / len(y))
    step = np.float32(1.0 / (1.0 + 2 * c * float(weight.max()) * 2.0))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v)) * weight
        after = v - step * (v - 2 * scale * len(y) / 2 * (x.T @ (y * slack)) / len(y) * 2)
        v = after + np.float32(k / (k + 3)) * (after - w)
        w = after
    return w


def families_of(names: list[str], centroids: np.ndarray) -> dict[str, int]:
    """Average-linkage clusters of languages, about the square root of their number."""
    groups = [[i] for i in range(len(names))]
    like = centroids @ centroids.T
    while len(groups) > max(1, round(len(names) ** 0.5)):
        _, a, b = max((float(np.mean(like[np.ix_(groups[a], groups[b])])), -a, -b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        a, b = -a, -b
        groups[a] += groups.pop(b)
    return {names[i]: k for k, g in enumerate(groups) for i in g}


@dataclass
class Model:
    """Weights for each family against the rest, and for each pair of languages of a family."""

    families: dict[str, int] = field(default_factory=dict)
    rest: dict[int, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    #: Mean vector of each language, and the least likeness to it by class of length (see calibrate).
    centres: dict[str, np.ndarray] = field(default_factory=dict)
    floors: dict[str, np.ndarray] = field(default_factory=dict)

    def likeness(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest language and the cosine to its mean, of rows of vectors."""
        names = sorted(self.centres)
        like = x @ np.stack([self.centres[n] for n in names]).T
        best = like.argmax(1)
        return np.array(names, object)[best], like[np.arange(len(x)), best]

    def known(self, x: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Which rows are as much like their nearest language as texts of their length are."""
        if not self.floors:
            return np.ones(len(x), bool)
        names, like = self.likeness(x)
        return np.array([v >= self.floors[n][length_class(k)] for n, v, k in zip(names, like, lengths, strict=True)], bool)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores of rows of vectors."""
        squash = lambda m: 1 / (1 + np.exp(-3.0 * m))
        out, score = np.full(len(x), UNKNOWN, object), np.zeros(len(x))
        if not self.families:
            return out, score
        kinds = sorted(set(self.families.values()))
        if len(kinds) > 1:
            margins = np.stack([x @ self.rest[k][:-1] + self.rest[k][-1] for k in kinds], 1)
            chosen, sure = margins.argmax(1), squash(margins.max(1))
        else:
            chosen, sure = np.zeros(len(x), int), np.ones(len(x))
        for at, kind in enumerate(kinds):
            rows = np.flatnonzero(chosen == at)
            names = sorted(n for n, k in self.families.items() if k == kind)
            votes, wins = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for i, a in enumerate(names):
                for j in range(i + 1, len(names)):
                    w = self.pairs[a, names[j]]
                    p = squash(x[rows] @ w[:-1] + w[-1])
                    votes[:, i] += (p >= 0.5) + 1e-3 * p
                    votes[:, j] += (p < 0.5) + 1e-3 * (1 - p)
                    wins[:, i] += p
                    wins[:, j] += 1 - p
            best = votes.argmax(1)
            out[rows] = np.array(names, object)[best]
            share = wins[np.arange(len(rows)), best] / (len(names) - 1) if len(names) > 1 else 1.0
            score[rows] = sure[rows] * share
        return out, np.clip(score, 0, 1)


#: Texts of 2^LONGEST characters and more are one class of length.
LONGEST = 12


def length_class(n: int) -> int:
    return min(max(n, 1).bit_length() - 1, LONGEST)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _usable(docs: DataFrame) -> DataFrame:
    """``lang, text`` of the labelled documents that have a letter and aren't held out: all of them."""
    usable = doc_columns(docs, "doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    return usable.select("lang", "text")


def _sums(rows: pd.DataFrame, weight: str) -> pd.DataFrame:
    """One row of summed ``vector`` and ``weight`` of the rows of a ``task``."""
    total = np.zeros(len(rows["vector"].iloc[0]) // 8)
    for v in rows["vector"]:
        total += np.frombuffer(v, np.float64)
    return pd.DataFrame({"task": [rows["task"].iloc[0]], "vector": [total.tobytes()], weight: [rows[weight].sum()]})


def _added(parts: DataFrame) -> list[tuple[str, np.ndarray, float]]:
    """``task``, the sum of its ``vector`` and of its ``n`` over all tasks' rows, added up in groups first."""
    schema = "task string, vector binary, n double"
    some = parts.withColumn("__some", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("task", "__some").applyInPandas(lambda rows: _sums(rows, "n"), schema)
    return sorted((r["task"], np.frombuffer(r["vector"]), r["n"]) for r in some.groupBy("task").applyInPandas(lambda rows: _sums(rows, "n"), schema).collect())


def _rows_of(tasks: dict[str, tuple[np.ndarray, float]]) -> pa.RecordBatch:
    names = list(tasks)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([tasks[t][0].tobytes() for t in names], pa.binary()), pa.array([float(tasks[t][1]) for t in names], pa.float64())], ["task", "vector", "n"])


def fit(docs: DataFrame, per_language: int = 1000) -> Model:
    """A model from all labelled documents that are not held out.

    One pass gives each language's mean. In a second one every task trains SVMs on its own documents,
    as soon as it holds ``per_language`` of a language, or four times as many in all (this bounds its
    memory), and at its end; a
    model's weights are the mean of those that all blocks gave, each counted by its documents. The
    driver only gets one vector a language or SVM.
    """
    usable = _usable(docs)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        total: dict[str, list] = {}
        for batch in batches:
            langs, at = np.array(batch.column("lang").to_pylist(), object), 0
            for x in vectors(batch.column("text")):
                for lang in set(langs[at : at + len(x)].tolist()):
                    mine = x[langs[at : at + len(x)] == lang]
                    kept = total.setdefault(lang, [np.zeros(DIM), 0])
                    kept[0] += mine.sum(0, dtype=np.float64)
                    kept[1] += len(mine)
                at += len(x)
        yield _rows_of(total)

    means = _added(usable.mapInArrow(lean(summed), "task string, vector binary, n double"))
    if not means:
        return Model()
    centres = {lang: (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32) for lang, v, _ in means}
    names = sorted(centres)
    model = Model(families_of(names, np.stack([centres[n] for n in names])), centres=centres)
    kinds = sorted(set(model.families.values()))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if model.families[a] == model.families[b]]
    # An SVM's languages with their sign.
    tasks = {f"f{k}": {n: 1 if model.families[n] == k else -1 for n in names} for k in kinds} if len(kinds) > 1 else {}
    tasks |= {f"p{i}": {a: 1, b: -1} for i, (a, b) in enumerate(pairs)}
    if not tasks:
        return model

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        total: dict[str, list] = {}
        held: dict[str, list[np.ndarray]] = {}

        def train() -> None:
            stacks = {lang: np.stack(rows) for lang, rows in held.items()}
            for task, signs in tasks.items():
                mine = [lang for lang in sorted(stacks) if lang in signs]
                y = np.concatenate([np.full(len(stacks[lang]), signs[lang], np.float32) for lang in mine]) if mine else np.zeros(0, np.float32)
                # A block of one side alone says what that side is like: the other's mean stands against it.
                x = [stacks[lang] for lang in mine]
                if len(y) and (y == y[0]).all():
                    other = [centres[lang] for lang, sign in signs.items() if sign != y[0]]
                    x, y = [*x, np.stack(other)], np.concatenate([y, np.full(len(other), -y[0], np.float32)])
                if not len(y):
                    continue
                n = sum(len(stacks[lang]) for lang in mine)
                kept = total.setdefault(task, [np.zeros(DIM + 1), 0])
                kept[0] += n * train_svm(np.concatenate(x), y).astype(np.float64)
                kept[1] += n
            held.clear()

        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for x in vectors(batch.column("text")):
                for lang, v in zip(langs[at : at + len(x)], x, strict=True):
                    rows = held.setdefault(lang, [])
                    rows.append(v.copy())
                    if len(rows) >= per_language or sum(map(len, held.values())) >= 4 * per_language:
                        train()
                at += len(x)
        train()
        yield _rows_of(total)

    for task, v, n in _added(usable.mapInArrow(lean(trained), "task string, vector binary, n double")):
        w, at = (v / n).astype(np.float32), int(task[1:])
        if task[0] == "f":
            model.rest[at] = w
        else:
            model.pairs[pairs[at]] = w
    return model


#: Likenesses (0 to 1) are counted in so many steps; a floor is the lower border of its quantile's step.
STEPS = 1 << 12


def calibrate(docs: DataFrame, model: Model, share: float = 0.002, margin: float = 0.9) -> Model:
    """``model`` with the least likeness that texts of a language and length have to its mean.

    From all labelled documents that aren't held out: each text whole, and a window of it of 8, 16, 32,
    ... characters at a hashed place, so short texts are judged by short ones. Of a language's and
    class's likenesses the ``share`` quantile times ``margin`` is the floor, from counts of steps of
    likeness that tasks add up; a class that wasn't met takes the next shorter one's, and nothing is
    asked of texts shorter than 8 characters.
    """
    if not model.centres:
        return model
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def windows(text: str) -> list[str]:
        out, place = [text], zlib.crc32(text.encode("utf-8", "replace"))
        for k in range(3, LONGEST):
            if 1 << k < len(text):
                at = place % (len(text) - (1 << k))
                out.append(text[at : at + (1 << k)])
        return [t for t in out if any(map(str.isalpha, t))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        met: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            texts = [t for text in batch.column("text").to_pylist() for t in windows(text)]
            at = 0
            for x in vectors(pa.array(texts, pa.string())):
                names, like = sent.value.likeness(x)
                steps = np.clip((like * STEPS).astype(np.int64), 0, STEPS - 1)
                for name, text, step in zip(names.tolist(), texts[at : at + len(x)], steps.tolist(), strict=True):
                    met.setdefault((name, length_class(len(text))), np.zeros(STEPS, np.int64))[step] += 1
                at += len(x)
        rows = [(name, size, step, int(c[step])) for (name, size), c in met.items() for step in np.flatnonzero(c).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["lang", "size", "step", "n"])

    floors = {n: np.zeros(LONGEST + 1) for n in model.centres}
    counts = _usable(docs).select("text").mapInArrow(lean(run), "lang string, size int, step int, n long").groupBy("lang", "size", "step").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang", "size")
    placed = counts.withColumns({"upto": F.sum("n").over(w.orderBy("step")), "total": F.sum("n").over(w)})
    least = placed.where(F.col("upto") > (F.col("total") - 1) * share).groupBy("lang", "size").agg((F.min("step") / STEPS).alias("least"))
    for r in sorted(least.collect(), key=lambda r: (r["lang"], r["size"])):
        if r["size"] >= 3:
            floors[r["lang"]][r["size"] :] = margin * r["least"]
    return replace(model, floors=floors)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``lang_pred, score`` beside all columns of ``docs``, in place of any of these names.

    A null text or one without a letter is ``und`` with score 0, and so is, if the model is calibrated,
    one that isn't like its nearest language. The model sees the whole text and
    nothing else. Repeated rows give repeated rows; an empty table gives an empty table.
    """
    spark, docs = docs.sparkSession, docs.drop("lang_pred", "score")
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in batches:
            texts = batch.column("text")
            found, strange, at = [], [], 0
            for x in vectors(texts):
                found.append(sent.value.predict(x))
                strange.append(~sent.value.known(x, [len(t or "") for t in texts[at : at + len(x)].to_pylist()]))
                at += len(x)
            lang = np.concatenate([a for a, _ in found]) if found else np.zeros(0, object)
            score = np.concatenate([b for _, b in found]) if found else np.zeros(0)
            strange = np.concatenate(strange) if strange else np.zeros(0, bool)
            lang[strange], score[strange] = UNKNOWN, 0.0
            blank = np.array([not t or not any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
            lang[blank], score[blank] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(lean(run), schema)


def identify(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    rows = doc_columns(docs, "doc_id", "text")
    return predict(rows, fit(docs, per_language)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least_score: float = 0.25) -> DataFrame:
    """All columns of ``docs``, without documents that have no letter, are like no language or score below chance.

    What is like a language is learnt from all labelled documents (see fit and calibrate). A missing ``lang``
    is filled with the prediction; what a document says of itself stays. Null texts go. Repeated rows
    stay as they are; an empty table gives an empty table.
    """
    plain = docs.drop("lang_pred", "score")
    found = predict(plain, calibrate(docs, fit(docs))).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*plain.columns) if "lang" in plain.columns else found.select(*plain.columns)
