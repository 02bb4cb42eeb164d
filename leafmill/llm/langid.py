"""Language identification by a string kernel.

A text is the set of its character n-grams of ORDERS (a blended spectrum, by presence), hashed to fixed dimensions; the kernel
of two texts is the size of their sets' intersection over the root of the product of their sizes. Landmarks give the
Nyström approximation of the kernel's feature space, in which a ridge regression for each language against the rest is fitted in
closed form. Scoring a batch is two matrix products: presence bits by landmarks, then kernel values by weights.

Training takes a bounded sample: of every language the TRAIN_PER_LANG rows with the smallest hashes of doc_id, of
those whose crc32(doc_id as text) mod 4 is not 2 and whose lang is not null, at most TRAIN_ALL in all (one of each language, if
there are more languages); LANDMARKS of them are landmarks, at least one of each language. Every whole text is scored: one of more than
PIECE characters in pieces of that length, whose values count by their characters. lang, source and doc_id are no inputs of a prediction.

Defined results: null text or text without a letter is `und` with score 0; so is every text if nothing can be learned
(an empty table, or only null lang); ties go to the language that sorts first; repeated rows get a row each, and count as rows of the
sample; columns named lang_pred or lang_score are replaced, others are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import lean, pick

ORDERS = (1, 2, 3, 4)
#: Dimensions of an order's hashed n-grams.
DIMS = 1 << 12
TRAIN_PER_LANG, TRAIN_ALL, LANDMARKS, RIDGE = 256, 4096, 128, 0.01
#: Bits of the classes in which hashes of ids are counted.
CLASS_BITS = 18
#: Characters of a text that are scored together; hashed n-grams of far more would fill all dimensions.
PIECE = 1 << 14
#: Rows of a matrix product.
BLOCK = 256
#: Margin between the best two languages that counts as certain.
CERTAIN = 0.5
_MIX = np.uint32(2654435761)


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text: the hashed n-grams that it holds."""
    out = np.zeros((len(texts), len(ORDERS) * DIMS), np.float32)
    shift = np.uint32(32 - int(np.log2(DIMS)))
    for row, text in zip(out, texts, strict=True):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        gram = np.zeros(len(codes), np.uint32)
        for k, order in enumerate(ORDERS):
            n = len(codes) - order + 1
            if n <= 0:
                break
            gram = (gram[:n] * np.uint32(0x01000193)) ^ codes[order - 1 :] if order > 1 else codes
            row[k * DIMS + ((gram * _MIX) >> shift)] = 1
    return out


def lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def pieces(text: str) -> list[str]:
    """The text cut every PIECE characters; a last piece of less than a quarter of that stays with the one before."""
    cuts = [0, *range(PIECE, max(len(text) - PIECE // 4, 1), PIECE), len(text)]
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass
class Model:
    """Languages; landmarks' bits over the root of their number, and the weights of each language."""

    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        return (bits @ self.landmarks.T) / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))

    def values(self, texts: list[str]) -> np.ndarray:
        """A row for each text: the value of each language, the mean of its pieces' by their characters."""
        own = [pieces(t) for t in texts]
        flat = [(k, p) for k, parts in enumerate(own) for p in parts]
        out = np.zeros((len(texts), len(self.langs)))
        for i in range(0, len(flat), BLOCK):
            at, part = zip(*flat[i : i + BLOCK], strict=True)
            share = np.array([len(p) / max(len(texts[k]), 1) for k, p in flat[i : i + BLOCK]])
            np.add.at(out, list(at), self.kernel(presence(list(part))) @ self.weights * share[:, None])
        return out

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score grows with the margin to the second language."""
        values = self.values(texts)
        best = values.argmax(1)
        if len(self.langs) == 1:
            return [self.langs[0]] * len(texts), np.clip(values[:, 0], 0, 1).astype(float)
        second = np.partition(values, -2, axis=1)[:, -2]
        margin = values[np.arange(len(texts)), best] - second
        return [self.langs[i] for i in best], np.clip(margin / CERTAIN, 0, 1).astype(float)


def fit(packed: list[bytes], langs: list[str]) -> Model:
    """Nyström features of the landmarks (taken from each language in turn), then ridge regressions of -1 and 1. packed: presence bits, a row of bytes for each text."""

    def scaled(rows) -> np.ndarray:
        bits = np.stack([np.unpackbits(np.frombuffer(packed[i], np.uint8)) for i in rows]).astype(np.float32)
        return bits / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))

    names = sorted(set(langs))
    place = {name: k for k, name in enumerate(names)}
    which = np.array([place[x] for x in langs])
    turn = np.array([np.sum(which[:i] == c) for i, c in enumerate(which)])
    chosen = np.lexsort((which, turn))[: max(LANDMARKS, len(names))]
    marks = scaled(chosen)
    every = range(len(packed))
    k = np.concatenate([scaled(every[i : i + BLOCK]) @ marks.T for i in range(0, len(packed), BLOCK)]).astype(np.float64)
    values, vectors = np.linalg.eigh(k[chosen])
    kept = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = k @ root
    share = np.bincount(which, minlength=len(names))
    weight = (len(which) / (len(names) * share))[which][:, None]  # each language counts alike
    targets = np.where(which[:, None] == np.arange(len(names)), 1.0, -1.0)
    gram = features.T @ (features * weight) + RIDGE * len(which) * np.eye(features.shape[1]) / 100
    solved = np.linalg.solve(gram, features.T @ (targets * weight))
    return Model(names, marks, (root @ solved).astype(np.float32))


def sample(docs: DataFrame) -> DataFrame:
    """lang, text: the bounded training sample."""
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang").where("lang is not null and text is not null")
    rows = rows.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 != 2)
    many = rows.select("lang").distinct().count()
    each = max(min(TRAIN_PER_LANG, TRAIN_ALL // max(many, 1)), 1)
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    # Counts of classes of hashes tell up to which class the smallest ones lie, so that no language's rows are ranked whole.
    hashed = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("class", F.shiftright("h", 64 - CLASS_BITS))
    upto = Window.partitionBy("lang").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("count").over(upto), F.lit(0))
    last = hashed.groupBy("lang", "class").count().withColumn("before", before).where(F.col("before") < each).groupBy(F.col("lang").alias("l_lang")).agg(F.max("class").alias("last"))
    # The ids are ranked without their texts, then the texts of those ids are looked up. Rows that share an id are ranked once more.
    low = hashed.join(last, F.col("lang") == F.col("l_lang")).where(F.col("class") <= F.col("last")).select("lang", "doc_id", "h")
    ranked = low.withColumn("k", F.row_number().over(first)).where(F.col("k") <= each)
    wanted = ranked.select(F.col("doc_id").alias("s_id"), F.col("lang").alias("s_lang")).distinct()
    found = rows.join(F.broadcast(wanted), rows["doc_id"].eqNullSafe(wanted["s_id"]) & (rows["lang"] == wanted["s_lang"]))  # TRAIN_ALL rows or one a language
    again = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))
    return found.select("lang", "doc_id", "text", F.xxhash64("doc_id").alias("h")).withColumn("k", F.row_number().over(again)).where(F.col("k") <= each).select("lang", "doc_id", "text")


def trained(docs: DataFrame) -> Model | None:
    """The model, or None if there is nothing to learn from. Only presence bits come to the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.packbits(presence([t])[0].astype(bool)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["lang", "doc_id", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted((r["lang"], str(r["doc_id"]), bytes(r["bits"])) for r in sample(docs).mapInArrow(lean(bits), f"lang string, doc_id {kind}, bits binary").collect())
    if not rows:
        return None
    return fit([b for _, _, b in rows], [lang for lang, _, _ in rows])


def identified(docs: DataFrame) -> DataFrame:
    """docs with lang_pred and lang_score in place of such columns."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs))  # landmarks of fixed width: LANDMARKS, or one a language
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    at = [c.lower() for c in names].index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "lang_pred string", "lang_score double"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                texts = part.column(at).to_pylist()
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                known = [j for j, t in enumerate(texts) if own and lettered(t)]
                if known:
                    found, values = own.decide([texts[j] for j in known])
                    for j, name, value in zip(known, found, values, strict=True):
                        lang[j], score[j] = name, value
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "lang_score"])

    return rows.mapInArrow(lean(predict), schema)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    rows = identified(docs.select("doc_id", "text", "lang"))
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return rows.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
