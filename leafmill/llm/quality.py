"""Quality classification by an interpolated modified Kneser-Ney model of characters.

Trusted texts (labels.quality = 1) train a model of ORDER characters for each language: counts of all their n-grams
are gathered by a shuffle, then sharded by context. Lower orders use continuation counts; the three discounts of
an order come from its counts of counts. A document's perplexity is compared with its language's threshold, the QUANTILE of the
perplexities of trusted texts that were held out of training; above it the document is rejected.

Scoring joins the documents with the model a shard at a time: a shard holds every n-gram whose context hashes to it,
at most SHARD_ROWS rows, and is sent to the tasks as packed arrays; each pass adds up, per document, the logarithms of
the n-grams whose context lies in the shard. A small model has one shard. All counts come from all trusted texts.

Defined results: null or empty text has perplexity null and is not kept; a document of a language (null is one) without trusted
text has threshold null and is kept, for nothing is known against it; without held-out texts the threshold is that of the training texts; repeated
rows get a row each; very long texts are scored whole, in blocks; columns other than doc_id, lang and text are not read, whatever their names; a doc_id labelled both ways is not trusted; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import arrow_rows, filter_of, lean, may_hold, pick, stored

ORDER = 4
QUANTILE = 0.995
#: Share of trusted texts that are held out of training and set the threshold.
HELD_OUT = 5
#: Rows of a model shard: about 24 bytes each in every executor's worker.
SHARD_ROWS = 1_500_000
#: Width of a perplexity class (natural logarithm) in the exact quantile.
BIN = 1e-4
#: Rows of a batch that a task hands to Python.
BATCH_ROWS = 1000
#: Characters of a block of texts.
BLOCK_CHARS = 1 << 20
START = 2  # code of the text's begin; no text holds it after cleaning
_MIX = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    """The characters of a text, lower-cased, as 16 bits each; rarer planes fold, white space and control characters become a space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c > 0xFFFF, 0xE000 | (c & 0xFFF), c)
    c = np.where(c <= 0x20, 0x20, c)
    return c.astype(np.uint64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram of ORDER characters that ends at each character of the texts (the begin is padded), and where each text starts."""
    parts = []
    pad = np.full(ORDER - 1, START, np.uint64)
    for t in texts:
        parts += [pad, codes(t)]
    c = np.concatenate(parts)
    packed = np.zeros(len(c) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        packed = (packed << np.uint64(16)) | c[i : i + len(packed)]
    sizes = np.array([len(p) for p in parts[1::2]])
    first = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    keep = np.concatenate([np.arange(f, f + n) for f, n in zip(first, sizes, strict=True)])
    return packed[keep], np.concatenate([[0], np.cumsum(sizes)])


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def counted(trusted: DataFrame) -> DataFrame:
    """lang, gram, n: how often each n-gram of ORDER characters ends somewhere in the trusted texts (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pd.Series]] = {}

        def summed(lang: str) -> pd.Series:
            whole = pd.concat(held[lang])
            return whole.groupby(level=0).sum()

        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang and t]
                for a, b in blocks(own):
                    keys, n = np.unique(grams(own[a:b])[0], return_counts=True)
                    held.setdefault(lang, []).append(pd.Series(n, keys))
                    if sum(map(len, held[lang])) > 2_000_000:  # bounded memory: what is counted so far goes on
                        held[lang] = [summed(lang)]
                        if len(held[lang][0]) > 1_000_000:
                            yield rows(lang, held.pop(lang)[0])
        for lang in sorted(held):
            yield rows(lang, summed(lang))

    def rows(lang: str, n: pd.Series) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(n.index.to_numpy().view(np.int64)), pa.array(n.to_numpy().astype(np.int64))], ["lang", "gram", "n"])

    return trusted.select("lang", "text").mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _suffix(gram: str, order: int):
    """The last `order` characters of a packed n-gram."""
    return F.col(gram).bitwiseAND((1 << (16 * order)) - 1) if order < 4 else F.col(gram)


def discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 of modified Kneser-Ney from an order's counts of counts; where those are too few, fixed discounts."""
    t = [F.sum((F.col("n") == k).cast("double")).alias(f"t{k}") for k in (1, 2, 3, 4)]
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    enough = (F.col("t1") > 0) & (F.col("t2") > 0) & (F.col("t3") > 0)
    d = [F.when(enough, F.greatest(F.least(k - (k + 1) * y * F.col(f"t{k + 1}") / F.col(f"t{k}"), F.lit(k - 0.05)), F.lit(0.05))).otherwise(0.5 * k) for k in (1, 2, 3)]
    return counts.groupBy("lang").agg(*t).select("lang", *[x.alias(f"d{k}") for k, x in zip((1, 2, 3), d, strict=True)])


def model(trusted: DataFrame) -> DataFrame:
    """lang, level, key, p, back: for every n-gram seen (level 1 to ORDER) its interpolated probability, and for every
    context (level -1 to -(ORDER - 1); 0 is the empty one) the weight that it leaves to the next shorter one.

    Probabilities are built from the shortest order up, each a join of an order's counts with the order below.
    """
    highest = stored(counted(trusted), "quality-counts")
    counts = {ORDER: highest}
    for order in range(ORDER - 1, 0, -1):  # in how many n-grams one longer it is the end
        longer = counts[order + 1].select("lang", _suffix("gram", order).alias("short"))
        counts[order] = stored(longer.groupBy("lang", F.col("short").alias("gram")).agg(F.count("*").alias("n")), f"quality-counts-{order}")
    out, lower = [], None
    for order in range(1, ORDER + 1):
        d = discounts(counts[order]).withColumnRenamed("lang", "d_lang")
        c = counts[order].join(F.broadcast(d), F.col("lang") == F.col("d_lang"))  # a row a language
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = c.select("lang", "gram", "n", cut.alias("cut"), F.shiftrightunsigned("gram", 16).alias("context"))
        sums = c.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"), F.count("*").alias("kinds"))
        sums = sums.withColumn("back", F.col("freed") / F.col("total"))
        s = sums.select(F.col("lang").alias("s_lang"), F.col("context").alias("s_context"), "total", "back")
        c = c.join(s, (F.col("lang") == F.col("s_lang")) & (F.col("context") == F.col("s_context")))
        own = (F.col("n") - F.col("cut")) / F.col("total")
        if lower is None:
            # Below single characters stands a uniform distribution over the 2^16 codes.
            p = c.select("lang", "gram", (own + F.col("back") / 65536).alias("p"))
        else:
            low = lower.select(F.col("lang").alias("l_lang"), F.col("gram").alias("l_gram"), F.col("p").alias("l_p"))
            c = c.withColumn("short", _suffix("gram", order - 1))
            p = c.join(low, (F.col("lang") == F.col("l_lang")) & (F.col("short") == F.col("l_gram")), "left").select(
                "lang", "gram", (own + F.col("back") * F.coalesce("l_p", F.lit(1.0 / 65536))).alias("p")
            )
        lower = stored(p, f"quality-p{order}")
        out.append(lower.select("lang", F.lit(order).alias("level"), F.col("gram").alias("key"), "p"))
        out.append(sums.select("lang", F.lit(1 - order).alias("level"), F.col("context").alias("key"), F.col("back").alias("p")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


class Lookup:
    """Values of 64-bit keys in an open-addressing table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64).view(np.uint64), np.full(1 << bits, np.nan)
        self.free = np.ones(1 << bits, bool)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            open_ = self.free[at]
            tried, first = np.unique(at[open_], return_index=True)
            won = left[open_][first]
            self.keys[tried], self.values[tried], self.free[tried] = keys[won], values[won], False
            stay = ~np.isin(left, won)
            left, at = left[stay], (at[stay] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """NaN where a key is missing."""
        at = self.slot(keys)
        found = self.keys[at] == keys
        out = np.where(found, self.values[at], np.nan)
        todo = np.flatnonzero(~found & ~self.free[at])
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & ~self.free[at]
            todo, at = todo[go], at[go]
        return out


def _in_shard(gram: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """Which n-grams a shard scores: by the two characters before the last, which every context of two or more holds."""
    last = (gram >> np.uint64(16)) & np.uint64(0xFFFFFFFF)
    return ((last * np.uint64(1000003)) >> np.uint64(12)) % np.uint64(shards) == np.uint64(shard)


def _shard_column(last, shards: int):
    return F.pmod(F.shiftright(last.cast("bigint") * 1000003, 12), F.lit(shards))


def log_probabilities(gram: np.ndarray, tables: dict[int, Lookup]) -> np.ndarray:
    """Natural logarithm of the probability of each packed n-gram's last character after the others."""
    out = np.zeros(len(gram))
    left = np.arange(len(gram))
    for order in range(ORDER, 0, -1):
        own = gram if order == ORDER else gram & np.uint64((1 << (16 * order)) - 1)
        p = tables[order].get(own)
        hit = ~np.isnan(p)
        out[left[hit]] += np.log(p[hit])
        left, gram, own = left[~hit], gram[~hit], own[~hit]
        if not len(left):
            return out
        back = tables[1 - order].get(own >> np.uint64(16))
        out[left] += np.log(np.where(np.isnan(back), 1.0, np.maximum(back, 1e-12)))
    out[left] -= np.log(65536.0)
    return out


def shards_of(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // SHARD_ROWS))


def fetched(rows: DataFrame, shard: int, shards: int) -> dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """One shard of a model, by language and level, as sorted arrays. Levels with a context of less than two characters are in every shard."""
    key = F.col("key")
    above = F.when(F.col("level") > 0, F.shiftrightunsigned(key, 16)).otherwise(key).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    own = F.lit(True)
    if shards > 1:
        own = F.col("level").isin(-1, 0, 1, 2) | (_shard_column(above, shards) == shard)
    found = rows.where(own).select(F.coalesce("lang", F.lit("")).alias("lang"), F.col("level").cast("tinyint").alias("level"), "key", "p").toArrow()
    langs = found.column("lang").combine_chunks().dictionary_encode()
    names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
    level, key, p = (found.column(c).to_numpy() for c in ("level", "key", "p"))
    out: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for i, lang in enumerate(names):
        for k in np.unique(level[code == i]):
            part = np.flatnonzero((code == i) & (level == k))
            part = part[np.argsort(key[part])]
            out.setdefault(lang, {})[int(k)] = key[part], p[part]
    return out


def scored(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored: docs (doc_id, lang, text and further columns but text) with n_chars and loss: the summed negative logarithm of their characters' probabilities; null without a model of the language."""
    spark = docs.sparkSession
    shards = shards_of(rows)
    names = [c for c in docs.columns if c != "text"]
    out, all_sent = docs.withColumns({"n_chars": F.lit(0).cast("bigint"), "loss": F.lit(0.0)}), []
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"), "n_chars bigint", "loss double"])
    for shard in range(shards):
        sent = spark.sparkContext.broadcast(fetched(rows, shard, shards))  # about SHARD_ROWS, and the pairs of characters
        all_sent.append(sent)
        keeps_text = shard < shards - 1
        out = out.mapInArrow(lean(_scorer(sent, out.columns, names, shard, shards, keeps_text)), kinds + (", text string" if keeps_text else ""))
        if keeps_text:
            out = stored(out, "quality-part")
            sent.destroy()
    out = stored(out, "quality-scores")
    all_sent[-1].destroy()
    return out


def _scorer(sent, columns: list[str], names: list[str], shard: int, shards: int, keeps_text: bool):
    """A pass over the documents that adds what one shard knows."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, dict[int, Lookup]] = {}
        empty = (np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            column = dict(zip(columns, batch.columns, strict=True))
            langs, texts = [x or "" for x in column["lang"].to_pylist()], column["text"].to_pylist()
            sizes, loss = np.zeros(len(texts), np.int64), np.array(column["loss"].to_pylist(), float)
            for lang in sorted(set(langs)):
                if lang not in sent.value:
                    some = [i for i, x in enumerate(langs) if x == lang]
                    loss[some], sizes[some] = np.nan, [len(codes(texts[i])) if texts[i] else 0 for i in some]
                    continue
                if lang not in tables:
                    tables[lang] = {k: Lookup(keys.view(np.uint64), p) for k in range(1 - ORDER, ORDER + 1) for keys, p in [sent.value[lang].get(k, empty)]}
                own = [i for i, x in enumerate(langs) if x == lang and texts[i]]
                for a, b in blocks([texts[i] for i in own]):
                    part = own[a:b]
                    gram, at = grams([texts[i] for i in part])
                    sizes[part] = np.diff(at)
                    mine = np.ones(len(gram), bool) if shards == 1 else _in_shard(gram, shard, shards)
                    value = np.zeros(len(gram))
                    value[mine] = log_probabilities(gram[mine], tables[lang])
                    loss[part] -= np.add.reduceat(value, at[:-1])
            arrays = [column[c] for c in names] + [pa.array(sizes), pa.array(loss, from_pandas=True)] + ([column["text"]] if keeps_text else [])
            yield pa.RecordBatch.from_arrays(arrays, [*names, "n_chars", "loss"] + (["text"] if keeps_text else []))

    return score


def thresholds(known: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """lang, limit: the smallest class of log-perplexity (lang, logp) at or below which the quantile of a language's rows lie."""
    bins = known.groupBy("lang", F.ceil(F.col("logp") / BIN).alias("bin")).count()
    up = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("lang")
    return (
        bins.withColumns({"upto": F.sum("count").over(up), "all": F.sum("count").over(whole)})
        .where(F.col("upto") >= F.ceil(F.col("all") * F.lit(quantile)))
        .groupBy("lang")
        .agg((F.min("bin") * F.lit(BIN)).alias("limit"))
    )


def classified(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, keep: one row per document."""
    spark = docs.sparkSession
    trusted = (
        pick(labels, l_id="doc_id", quality="quality").groupBy("l_id").agg(F.min("quality").alias("q")).where("q = 1").select("l_id", (F.pmod(F.xxhash64("l_id"), F.lit(HELD_OUT)) == 0).alias("held_out"))
    )
    rows = pick(docs, doc_id="doc_id", lang="lang", text="text").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.col("lang").isNull().alias("no_lang"), "text")
    # The filter keeps most other texts out of the join's shuffle.
    near = may_hold(rows.withColumn("key", F.xxhash64("doc_id")), "key", filter_of(trusted.select(F.xxhash64("l_id").alias("key")), "key"))
    known = near.join(trusted, near["doc_id"] == trusted["l_id"]).where(F.length("text") > 0)
    with arrow_rows(spark, BATCH_ROWS):
        learned = stored(model(known.where("not held_out")), "quality-model")
        every = scored(rows.select("doc_id", "no_lang", "lang", "text"), learned)
    logp = F.col("loss") / F.col("n_chars")
    every = every.withColumn("logp", F.when(F.col("n_chars") > 0, logp))
    of = every.select("doc_id", "lang", "logp").where("logp is not null").join(trusted, F.col("doc_id") == F.col("l_id"))
    both = thresholds(of.where("held_out"), quantile).select("lang", "limit", F.lit(0).alias("p")).unionByName(thresholds(of, quantile).select("lang", "limit", F.lit(1).alias("p")))
    limit = both.groupBy("lang").agg(F.min_by("limit", "p").alias("limit")).withColumnRenamed("lang", "t_lang")
    few = limit.limit(10_001).count() <= 10_000  # languages
    joined = every.join(F.broadcast(limit) if few else limit, every["lang"] == F.col("t_lang"), "left")
    return joined.select(
        "doc_id",
        F.when(~F.col("no_lang"), F.col("lang")).alias("lang"),
        F.coalesce("n_chars", F.lit(0)).alias("n_chars"),
        F.exp("logp").alias("perplexity"),
        F.exp("limit").alias("threshold"),
        F.coalesce(F.when(F.col("n_chars") == 0, False), F.col("logp") <= F.col("limit"), F.lit(True)).alias("keep"),
    )
