"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose some of the words of a short span and ignore the others, so a substituted word at an ignored place
leaves the seed equal. Seeds of training documents are joined with seeds of benchmark items on (mask, hash). Around
each hit the two texts are aligned on its diagonal, and equal words are counted in every window of WINDOW words of the item
that holds the hit's first words, as many as the shortest mask has (in the whole item, if it is shorter): with SHARE of them
equal in one of the windows, the document contains the passage.

Items of FEW to MIN_MASKED - 1 words have masks of their own, SHORT_MASKS, of which one fits wherever SHARE of their words are equal.
Items of fewer words must stand in the document as they are: their one seed is the whole item.

Words: lower-cased runs of digits, letters a-z and code points from U+0080.

Defined results: null and empty texts match nothing, nor do items without words; repeated rows and rows with one doc_id are reported once,
as are equal item_ids; a null doc_id or item_id is an id of its own; very long texts are read whole, and past the join rows hold only the words
around a hit; columns other than doc_id, item_id and text are not read, whatever their names; an empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import pick, stored, union

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MASKS = ("11101011", "110110011", "1101010011")
#: Items of fewer words get SHORT_MASKS too, and items of fewer than FEW words only their whole sequence.
MIN_MASKED, FEW = 11, 8
#: Any two substitutions in 8, 9 or 10 words leave a place for one of these or of MASKS.
SHORT_MASKS = ("1111", "11101", "1010011")
WINDOW, SHARE = 16, 0.75
#: Words before a hit at which overlaps_sql sets its only window; overlaps counts in all windows.
BEFORE = 4
#: Places by which a window may begin before a hit, whose mask has SPAN places at least.
SPAN = min(map(len, MASKS))
REACH = WINDOW - SPAN
#: Benchmark seeds that are broadcast, each with the item's words that a window around it may reach: 300 bytes at most; more are joined by a shuffle.
BROADCAST_SEEDS = 200_000


def hashes(text: Column) -> Column:
    """The hashed words of text."""
    return F.array_remove(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def seeds(rows: DataFrame, words: str, at: str, masks: list[str]) -> DataFrame:
    """rows, once for each position and mask, with the position as `at` and the hash as `seed`."""
    n = F.size(words)
    shortest = min(map(len, masks))
    placed = rows.where(n >= shortest).withColumn(at, F.explode(F.sequence(F.lit(0), n - shortest)))
    chosen = [
        F.when(F.col(at) + len(mask) <= n, F.xxhash64(F.lit(mask), *[F.get(words, F.col(at) + i) for i, c in enumerate(mask) if c == "1"]))
        for mask in masks
    ]
    return placed.withColumn("seed", F.explode(F.array(*chosen))).where("seed is not null")


def masks_of(sizes: set[int]) -> list[str]:
    """The masks that items of these numbers of words need."""
    return list(dict.fromkeys([*MASKS, *(SHORT_MASKS if any(FEW <= n < MIN_MASKED for n in sizes) else ()), *("1" * n for n in sorted(sizes) if n < FEW)]))


def item_seeds(items: DataFrame, sizes: set[int]) -> DataFrame:
    """b_seed, item_id, j, size, start, item_around (the item's words from start on that a window around j may reach): items' seeds, with the masks for their size."""
    size = F.size("item_words")
    parts = [seeds(items.where(size >= FEW), "item_words", "j", list(MASKS))]
    if any(FEW <= n < MIN_MASKED for n in sizes):
        parts.append(seeds(items.where((size >= FEW) & (size < MIN_MASKED)), "item_words", "j", list(SHORT_MASKS)))
    parts += [seeds(items.where(size == n), "item_words", "j", ["1" * n]) for n in sorted(sizes) if n < FEW]
    start = _clipped(F.col("j") - REACH, size)
    around = F.slice("item_words", start + 1, REACH + WINDOW)
    return union(parts).select(F.col("seed").alias("b_seed"), "item_id", "j", size.alias("size"), start.alias("start"), around.alias("item_around"))


def _clipped(start: Column, size: Column) -> Column:
    return F.greatest(F.least(start, size - WINDOW), F.lit(0))


def _around(i: Column) -> tuple[Column, Column]:
    """The words that a window around a hit at i may reach, and the place of the first of them: rows after the join hold these and not the whole text."""
    first = F.greatest(i - REACH, F.lit(0))
    return F.slice("words", first + 1, REACH + WINDOW), first


def _matched() -> tuple[Column, Column]:
    """The most equal words in a window around a hit, and the windows' width."""
    size, i, j, start, (_, first) = F.col("size"), F.col("i"), F.col("j"), F.col("start"), _around(F.col("i"))
    width = F.least(size, F.lit(WINDOW))
    places = F.sequence(start, _clipped(j, size) + width - 1)
    equal = lambda p: F.get("around", F.when(p + i - j >= first, p + i - j - first)) == F.get("item_around", p - start)
    # A bit for each place; the windows are the runs of WINDOW bits, and a run over the end counts less than the window at the end.
    bits = F.aggregate(places, F.lit(0), lambda all_, p: all_ * 2 + F.when(equal(p), 1).otherwise(0))
    return F.greatest(*[F.bit_count(F.shiftright(bits, k).bitwiseAND(F.lit((1 << WINDOW) - 1))) for k in range(REACH + 1)]), width


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, matched (most equal words in a window), width of that window, first_word (where the first window's hit begins)."""
    items = stored(
        pick(benchmark, item_id="item_id", text="text").select("item_id", hashes(F.col("text")).alias("item_words")).where(F.size("item_words") > 0),
        "decontam-items",
    )
    sizes = {r["n"] for r in items.select(F.least(F.size("item_words"), F.lit(MIN_MASKED)).alias("n")).distinct().collect()}  # MIN_MASKED rows at most
    masks = masks_of(sizes)
    wanted = item_seeds(items, sizes)
    texts = pick(docs, doc_id="doc_id", text="text").select("doc_id", hashes(F.col("text")).alias("words"))
    around, _ = _around(F.col("i"))
    if wanted.limit(broadcast_seeds + 1).count() <= broadcast_seeds:
        placed = seeds(texts, "words", "i", masks).select("doc_id", "i", "seed", around.alias("around"))
        hits = placed.join(F.broadcast(wanted), placed["seed"] == wanted["b_seed"])
    else:
        texts = stored(texts.withColumn("row", F.monotonically_increasing_id()), "decontam-words")
        placed = seeds(texts, "words", "i", masks).select("row", "i", "seed")
        found = stored(placed.join(wanted, placed["seed"] == wanted["b_seed"]).drop("seed", "b_seed").distinct(), "decontam-hits")
        # A document's words go through one join, with the places of all its hits.
        spots = found.groupBy(F.col("row").alias("s_row")).agg(F.collect_set("i").alias("spots"))
        some = spots.join(texts, spots["s_row"] == texts["row"]).select("doc_id", "s_row", "words", F.explode("spots").alias("s_i"))
        near = some.select("doc_id", "s_row", "s_i", _around(F.col("s_i"))[0].alias("around"))
        hits = found.join(near, (found["row"] == near["s_row"]) & (found["i"] == near["s_i"]))
    matched, width = _matched()
    return (
        hits.select("doc_id", "item_id", "i", matched.alias("matched"), width.alias("width"))
        .where(F.col("matched") >= F.when(F.col("width") < FEW, F.col("width")).otherwise(F.ceil(F.col("width") * SHARE)))
        .groupBy("doc_id", "item_id")
        .agg(F.max("matched").cast("bigint").alias("matched"), F.max("width").cast("bigint").alias("width"), F.min("i").cast("bigint").alias("first_word"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark passage."""
    leaked = overlaps(docs, benchmark).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["__leaked"]), "left_anti")


def overlaps_sql(docs: str = "documents", benchmark: str = "benchmark") -> str:
    """overlaps in SQL, but with one window for each hit, without SHORT_MASKS and without items of fewer than FEW words: what it reports, overlaps reports as well."""
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w != '')"

    def seeded(source: str, key: str, at: str) -> str:
        return " union all ".join(
            f"select {key}, words, {at}, '{k}|' || "
            + " || ' ' || ".join(f"words[{at} + {i + 1}]" for i, c in enumerate(mask) if c == "1")
            + f" as seed from {source} where {at} + {len(mask)} <= len(words)"
            for k, mask in enumerate(MASKS)
        )

    return f"""
with d as (select doc_id, words, unnest(range(0, len(words))) as i from (select doc_id, {words} as words from {docs})),
b as (select item_id, words, unnest(range(0, len(words))) as j from (select item_id, {words} as words from {benchmark}) where len(words) >= {FEW}),
ds as ({seeded("d", "doc_id", "i")}),
bs as ({seeded("b", "item_id", "j")}),
hits as (
  select doc_id, item_id, i, j, ds.words as dw, bs.words as bw, least(len(bs.words), {WINDOW}) as width,
    greatest(least(j - {BEFORE}, len(bs.words) - {WINDOW}), 0) as start
  from ds join bs using (seed)),
counted as (
  select doc_id, item_id, i, width,
    len(list_filter(range(start, start + width), lambda p: p + i - j >= 0 and p + i - j < len(dw) and dw[p + i - j + 1] = bw[p + 1])) as matched
  from hits)
select doc_id, item_id, max(matched)::bigint as matched, max(width)::bigint as width, min(i)::bigint as first_word
from counted where matched >= ceil(width * {SHARE}) group by doc_id, item_id
"""
