"""N-gram Jaccard join with set-relation skipping.

Documents link when their sets of distinct 5-word shingles have a Jaccard similarity of 3/4 or more; a document's component
is what links reach. No pair is enumerated that can't change a component:

1. Equal sets are one class (one pass over the texts, fingerprints of 128 bits).
2. Classes that agree in their smallest shingle under one of four hash orders are compared with one leader each. A
   member's answers are derived from its leader's: distances are a metric, so what is too far from the leader is too far from the member.
3. An index of shingles holds, for each class, the shingles of its prefix (a quarter of its set, frequent shingles last): linked sets
   share one. Each shingle lists groups, not members, with bounds of their sizes and positions. Lists are
   cut into blocks by size; blocks, then pairs, whose positions leave too few shingles to share are skipped, and
   then pairs of which too few indexed shingles are shared.
4. The leaders of candidate groups are compared exactly. Where the radius of the groups leaves it open whether members link,
   and the groups are not connected yet, each member is reduced to what sets it apart from its leader, and so are the members of the
   smaller group. From the leader's answer and the differences that two sets share follows what the sets share: no text is read for a pair.

Defined results: null text, empty text and text without words have an empty set, n_shingles 0 and their own component; a null
doc_id takes no part (component null); repeated rows each have a row of the result; rows with one doc_id are one document with the
links of all its texts; very long texts are hashed whole, piece by piece; columns other than doc_id and text are not read, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import arrow_rows, lean, pick, stored, union
from leafmill.llm.graph import components
from leafmill.llm.shingles import common, mixed, sets, signed

#: Frequent shingles that are known to all tasks, at most; they only set the order in which a set's shingles are indexed.
HOT_SHINGLES = 200_000
#: Shingles that a task counts together, and how often one must be among them to be told.
COUNT_SHINGLES, TELL = 1_000_000, 4
#: Shingles that a task puts in order at once for the index.
INDEX_SHINGLES = 1_000_000
#: Shingles of an index bucket, and the least number of buckets.
BUCKET, BUCKETS = 250_000, 16
#: Entries of a block of an index list, and of a list that is paired in the task that gathered it; longer ones are cut up over tasks.
BLOCK, LONG = 512, 4096
#: Rows of a batch that a task hands to Python.
BATCH_ROWS = 500
#: Pairs of entries that are looked at together.
STEP = 250_000
#: Sets, and their shingles, of a block of a group whose members are compared by their differences.
DIFFERENCE_SETS, DIFFERENCE_SHINGLES = 256, 1 << 18
#: Of the overlap that a link takes, one in so many shingles must be shared near the front of both sets.
EARLY = 32
#: Bits of the filter that keeps texts nobody compares out of a shuffle.
FILTER_BITS = 1 << 24


def profiles(docs: DataFrame) -> DataFrame:
    """kind 0: a document's id, n and its set's fingerprint (f1, f2) and smallest members (ORDERS); kind 1: a shingle (f1) and in how many (n) of a task's different sets it is."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()

        def told() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            keys, n = keys[n >= TELL], n[n >= TELL]
            held.clear()
            seen.clear()
            zero = np.zeros(len(keys), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(zero + 1), pa.array(zero), pa.array(n.astype(np.int64)), signed(keys), *[pa.array(zero)] * (1 + len(ORDERS))], _PROFILE)

        for batch in batches:
            own = sets(batch.column(1).to_pylist())
            shape = np.zeros((3 + len(ORDERS), len(own)), np.uint64)
            for i, s in enumerate(own):
                if len(s):
                    other = mixed(s + _SALTS[0])
                    shape[:3, i] = len(s), np.sum(other, dtype=np.uint64), np.bitwise_xor.reduce(mixed(other))
                    shape[3:, i] = other.min(), *[mixed(s + salt).min() for salt in _SALTS[1:]]
                    key = (int(shape[1, i]), int(shape[2, i]))
                    if key not in seen:
                        seen.add(key)
                        held.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(own), np.int64)), batch.column(0), *map(signed, shape)], _PROFILE)
            if sum(map(len, held)) >= COUNT_SHINGLES:
                yield told()
        yield told()

    return docs.mapInArrow(lean(profile), ", ".join(f"{c} long" for c in _PROFILE))


#: Hash orders by whose smallest shingle sets find a leader, one round each.
ORDERS = ("m1", "m2", "m3", "m4")
_SALTS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64) for k in range(len(ORDERS))]
_PROFILE = ["kind", "doc_id", "n", "f1", "f2", *ORDERS]


def filtered(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id may be in ids (id): a filter of fixed size that lets all of them through, and few others."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit")
    slots = ids.select(bit).select(F.floor(F.col("bit") / 64).alias("slot"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("one"))
    slots = slots.groupBy("slot").agg(F.bit_or("one").alias("set"))
    asked = docs.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    found = asked.join(F.broadcast(slots), F.floor(asked["bit"] / 64) == slots["slot"])  # FILTER_BITS / 64 rows at most
    return found.where(F.expr("shiftrightunsigned(`set`, cast(bit % 64 as int)) & 1L = 1L")).select("doc_id", "text")


def with_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b: doc_ids) with both texts, ta and tb."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    some = filtered(docs, ids)
    left = some.select(F.col("doc_id").alias("la"), F.col("text").alias("ta"))
    right = some.select(F.col("doc_id").alias("rb"), F.col("text").alias("tb"))
    whole = pairs.join(left, pairs["a"] == left["la"]).select(*pairs.columns, "ta")
    return whole.join(right, whole["b"] == right["rb"]).select(*pairs.columns, "ta", "tb")


class _Sets:
    """The sets of texts that come again and again, as those of leaders do."""

    def __init__(self) -> None:
        self.kept: dict[int, tuple[str, np.ndarray]] = {}

    def __call__(self, key: int, text: str) -> np.ndarray:
        if key not in self.kept or self.kept[key][0] != text:
            if len(self.kept) >= 64:
                self.kept.clear()
            self.kept[key] = text, sets([text])[0]
        return self.kept[key][1]


def compared(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, shared, na, nb: the exact sizes of each pair's sets and of what they share. pairs: a, b (doc_ids)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Sets()
        for batch in batches:
            left = sets(batch.column(2).to_pylist())
            right = map(known, batch.column(1).to_pylist(), batch.column(3).to_pylist())
            numbers = np.array([[common(x, y), len(x), len(y)] for x, y in zip(left, right, strict=True)], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, numbers.T)], ["a", "b", "shared", "na", "nb"])

    return with_texts(docs, pairs.select("a", "b")).mapInArrow(lean(compare), "a long, b long, shared long, na long, nb long")


LINKED = "na > 0 and nb > 0 and 100 * shared >= 75 * (na + nb - shared)"
DISTANCE = "case when na + nb > 0 then 1 - shared / cast(na + nb - shared as double) else 1.0D end"


def led(docs: DataFrame, heads: DataFrame, by: str) -> DataFrame:
    """a, b, far: heads (rep, n and ORDERS) that link with the leader b of those that agree in `by`, and their distance."""
    leaders = heads.groupBy(by).agg(F.min(F.struct("rep", "n")).alias("first"), F.max("rep").alias("last")).where("first.rep < last")
    # Stored, so that the join deals both sides itself and can split a key that many heads share.
    leaders = stored(leaders.select(F.col(by).alias("key"), F.col("first.rep").alias("b"), F.col("first.n").alias("nb")), "jaccard-leaders")
    pairs = heads.join(leaders, heads[by] == leaders["key"]).where("rep <> b and 4 * n >= 3 * nb and 4 * nb >= 3 * n").select(F.col("rep").alias("a"), "b").distinct()
    found = compared(docs, stored(pairs, "jaccard-led"))
    return stored(found.where(LINKED).groupBy("a").agg(F.min("b").alias("b"), F.first(F.expr(DISTANCE)).alias("far")), "jaccard-links")


def postings(docs: DataFrame, members: DataFrame, hot: DataFrame, buckets: int) -> DataFrame:
    """bucket and packed columns: the index, each shingle with the groups in whose members' prefixes it is."""
    spark = docs.sparkSession
    common_ = sorted((r["f1"], r["count"]) for r in hot.collect())  # HOT_SHINGLES rows at most
    keys = np.array([k for k, _ in common_], np.int64).view(np.uint64)
    order = np.argsort(keys)
    rank = np.log2(np.maximum([c for _, c in common_], 1)).astype(np.int8) if common_ else np.zeros(0, np.int8)
    sent = spark.sparkContext.broadcast((keys[order], rank[order]))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_rank = sent.value
        for batch in batches:
            packed, sizes = [], []
            for s in sets(batch.column(1).to_pylist()):
                n = len(s)
                if n and len(hot_keys):
                    at = np.searchsorted(hot_keys, s)
                    at[at == len(hot_keys)] = 0
                    frequent = np.where(hot_keys[at] == s, hot_rank[at] + 1, 0)
                    s = s[np.lexsort((s, frequent))] if frequent.any() else s
                packed.append(s[: n - (3 * n + 3) // 4 + 1].tobytes() if n else b"")
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "prefix"])

    own = docs.mapInArrow(lean(prefix), "doc_id long, n long, prefix binary").where("n > 0")
    grouped = own.join(members, own["doc_id"] == members["rep"]).select("gid", "n", "prefix")
    shift = np.uint64(64 - int(np.log2(buckets)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            tok, gid, n, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((gid, tok))
            tok, gid, n, at = tok[order], gid[order], n[order], at[order]
            new = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (gid[1:] != gid[:-1])]))
            columns = [tok[new], gid[new], np.minimum.reduceat(n, new), np.maximum.reduceat(n, new), np.minimum.reduceat(at, new), np.maximum.reduceat(at, new)]
            bucket = (columns[0] >> shift).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            columns[0] = (columns[0] >> np.uint64(16)).astype(np.uint32)  # with the bucket, 32 bits more: a false match is found out later
            ranges = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), *[pa.array([c[i:j].tobytes() for i, j in ranges], pa.binary()) for c in columns]], ["bucket", *_PACKED])

        for batch in batches:
            for gid, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tok = np.frombuffer(blob, np.uint64)
                held.append((tok, np.full(len(tok), gid, np.int64), np.full(len(tok), n, np.int32), np.arange(len(tok), dtype=np.int32)))
                if sum(len(x[0]) for x in held) >= INDEX_SHINGLES:
                    yield from packed()
        if held:
            yield from packed()

    return grouped.mapInArrow(lean(index), "bucket long, " + ", ".join(f"{c} binary" for c in _PACKED))


_PACKED = ["tok", "gid", "n_low", "n_high", "at_low", "at_high"]
_KINDS = [np.uint32, np.int64, np.int32, np.int32, np.int32, np.int32]


def candidates(index: DataFrame, buckets: int) -> DataFrame:
    """a, b: pairs of groups whose members may link."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[list[bytes]]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(c)[k].as_py() for c in range(7)]
                by_bucket.setdefault(row[0], []).append(row[1:])
        for key in sorted(by_bucket):
            parts = by_bucket.pop(key)
            long: list[tuple[int, list[np.ndarray]]] = []
            for columns in _bucket_pairs(*[np.frombuffer(b"".join(p[k] for p in parts), kind) for k, kind in enumerate(_KINDS)], long=long, longest=LONG):
                yield _told(columns)
            for tok, entries in long:
                for at in range(0, len(entries[0]), BLOCK):
                    block = [x[at : at + BLOCK] for x in entries]
                    numbers = None, None, None, None, (key << 32) | tok, at // BLOCK, *_bounds(block)
                    yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in numbers], pa.array([np.concatenate(block).tobytes()], pa.binary())], _FOUND)

    schema = ", ".join(f"{c} long" for c in _FOUND[:-1]) + ", entries binary"
    found = stored(index.repartition(buckets, "bucket").mapInArrow(lean(join), schema), "jaccard-found")
    pairs, blocks = found.where("tok is null").select("a", "b", "c", "need"), found.where("tok is not null").drop("a", "b", "c", "need")
    if not blocks.isEmpty():
        pairs = pairs.unionByName(long_pairs(blocks))
    return pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("need").alias("need")).where("c >= need").select("a", "b")


#: a, b, c, need of a pair, or a block of a long list: its shingle, place, bounds and entries.
_FOUND = ["a", "b", "c", "need", "tok", "block", "low", "high", "front", "rest", "entries"]


def _told(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), *[pa.nulls(n, pa.int64())] * 6, pa.nulls(n, pa.binary())], _FOUND)


def long_pairs(blocks: DataFrame) -> DataFrame:
    """a, b, c, need from the blocks of long lists: each two blocks of a list whose bounds allow a link are one piece of work, dealt over all tasks."""
    own, other = (blocks.select("tok", *[F.col(c).alias(f"{c}{k}") for c in ("block", "low", "high", "front", "rest")]) for k in (1, 2))
    kept = "block1 <= block2 and 4 * high1 >= 3 * low2 and 7 * (least(front1, front2) + 1 + least(rest1, rest2)) >= 3 * (low1 + low2)"
    work = stored(own.join(other, "tok").where(kept).select("tok", "block1", "block2"), "jaccard-work")
    left, right = (blocks.select(F.col("tok").alias(f"t{k}"), F.col("block").alias(f"k{k}"), F.col("entries").alias(f"entries{k}")) for k in (1, 2))
    work = work.join(left, (F.col("tok") == F.col("t1")) & (F.col("block1") == F.col("k1"))).join(right, (F.col("tok") == F.col("t2")) & (F.col("block2") == F.col("k2")))
    work = work.select((F.col("block1") == F.col("block2")).alias("same"), "entries1", "entries2")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same, x, y = (batch.column(c)[k].as_py() for c in range(3))
                x, y = (np.frombuffer(e, np.int64).reshape(5, -1) for e in (x, y))
                i, j = np.triu_indices(x.shape[1], 1) if same else (v.ravel() for v in np.indices((x.shape[1], y.shape[1])))
                yield pa.RecordBatch.from_arrays([*map(pa.array, _links(x, i, y, j))], ["a", "b", "c", "need"])

    return work.mapInArrow(lean(pair), "a long, b long, c long, need long")


def _lists(tok, gid, n_low, n_high, at_low, at_high) -> tuple[np.ndarray, ...]:
    """The entries of a bucket, one for each shingle and group, by shingle, then size; all but the shingle as 64 bits."""
    order = np.lexsort((gid, tok))
    tok, gid, n_low, n_high, at_low, at_high = (x[order] for x in (tok, gid, n_low, n_high, at_low, at_high))
    new = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (gid[1:] != gid[:-1])]))
    tok, gid = tok[new], gid[new]
    n_low, n_high, at_low, at_high = (f.reduceat(x, new) for f, x in ((np.minimum, n_low), (np.maximum, n_high), (np.minimum, at_low), (np.maximum, at_high)))
    length = np.diff(np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1], [True]])))
    shared = np.repeat(length > 1, length)  # a shingle of one group makes no pair
    order = np.flatnonzero(shared)
    order = order[np.lexsort((n_low[order], tok[order]))]
    return tok[order], *(x[order].astype(np.int64) for x in (gid, n_low, n_high, at_low, at_high))


def _bounds(block: list[np.ndarray]) -> tuple[int, int, int, int]:
    """Of entries: the least size, the largest, the last place, and the most shingles behind a place."""
    _, n_low, n_high, at_low, at_high = block
    return int(n_low.min()), int(n_high.max()), int(at_high.max()), int((n_high - 1 - at_low).max())


def _links(x, i: np.ndarray, y, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """a, b (smaller, larger): groups that may link, of the entries i of x with the entries j of y; c: how many of these shingles they share early enough, need: how many in all they must.

    A link takes an overlap of `least` shared shingles (3/7 of both sizes). The k-th of them from the front has least - k behind it,
    so it stands before place n - least + k in either set: with k = 1 + least / EARLY, at least k shared shingles stand before that place. k is
    less where a set's indexed quarter ends before that place. For groups, sizes and places are taken at the end of their range that keeps more pairs.
    """
    (a, low, high, at, last), (b, low2, high2, at2, last2) = ([v[k] for v in z] for z, k in ((x, i), (y, j)))
    least = (3 * (low + low2) + 6) // 7
    k = 1 + (3 * (high + high2) + 6) // 7 // EARLY
    ok = (at < high - (3 * (high + low2) + 6) // 7 + k) & (at2 < high2 - (3 * (high2 + low) + 6) // 7 + k)
    ok &= (4 * high >= 3 * low2) & (4 * high2 >= 3 * low) & (a != b)
    ok &= np.minimum(last, last2) + 1 + np.minimum(high - 1 - at, high2 - 1 - at2) >= least
    a, b, least, most = a[ok], b[ok], least[ok], (3 * np.maximum(high, high2)[ok] + 3) // 4
    need = np.minimum(1 + least // EARLY, least - most + 1)
    return _counted(np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int64), need)


def _bucket_pairs(*columns: np.ndarray, long: list | None = None, longest: int = LONG) -> Iterator[tuple[np.ndarray, ...]]:
    """What _links tells of a bucket's index lists. With long, lists of more than `longest` entries are put there instead, as shingle and entries."""
    if not len(columns[0]):
        return
    tok, *entries = _lists(*columns)
    edge = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1], [True]])) if len(tok) else np.zeros(1, int)
    held: list[tuple[np.ndarray, ...]] = []
    length = np.diff(edge)
    if long is not None:
        long += [(int(tok[edge[k]]), [x[edge[k] : edge[k + 1]] for x in entries]) for k in np.flatnonzero(length > longest)]
        length = np.where(length > longest, 0, length)

    def full() -> bool:
        return sum(len(x[0]) for x in held) > STEP

    def told() -> tuple[np.ndarray, ...]:
        out = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return out

    for n in np.unique(length[length > 1]):
        runs = edge[:-1][length == n]
        if n <= BLOCK // 4:
            left, right = np.triu_indices(n, 1)
            step = max(1, STEP // len(left))
            for k in range(0, len(runs), step):
                base = runs[k : k + step, None]
                held.append(_links(entries, (base + left).ravel(), entries, (base + right).ravel()))
                if full():
                    yield told()
            continue
        for run in runs:
            cuts = [*range(run, run + n, BLOCK), run + n]
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            bound = [_bounds([x[a:b] for x in entries]) for a, b in spans]
            for p, (a, b) in enumerate(spans):
                low, high, front, rest = bound[p]
                for q in range(p, len(spans)):
                    low2, _, front2, rest2 = bound[q]
                    if 4 * high < 3 * low2:
                        break  # sizes only grow from here
                    if 7 * (min(front, front2) + 1 + min(rest, rest2)) < 3 * (low + low2):
                        continue
                    if p == q:
                        i, j = (a + v for v in np.triu_indices(b - a, 1))
                    else:
                        i, j = (v.ravel() for v in np.meshgrid(np.arange(a, b), np.arange(*spans[q]), indexing="ij"))
                    held.append(_links(entries, i, entries, j))
                    if full():
                        yield told()
    if held:
        yield told()


def _counted(a: np.ndarray, b: np.ndarray, c: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, with its counts summed and the least need."""
    if not len(a):
        return a, b, c, need
    order = np.lexsort((b, a))
    a, b, c, need = a[order], b[order], c[order], need[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[new], b[new], np.add.reduceat(c, new), np.minimum.reduceat(need, new)


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    docs = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint"), "text")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        rows = stored(profiles(docs), "jaccard-profiles")
        files = rows.where("kind = 0").drop("kind")
        known = files.where("doc_id is not null")
        if known.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return of_classes(files, class_components(docs, rows))
    # Rows that share a doc_id: each different text gets an id of its own, and those of a doc_id are linked.
    own = stored(docs.where("doc_id is not null").distinct().withColumn("row", F.monotonically_increasing_id()), "jaccard-rows")
    found = linked(own.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("f"), F.col("component_id").alias("c"))
    found = stored(own.select("doc_id", "row").join(found, F.col("row") == F.col("f")).select("doc_id", "row", "c"), "jaccard-found-rows")
    first = found.groupBy("doc_id").agg(F.min("row").alias("b"))
    together = found.join(first, "doc_id").select(F.col("row").alias("a"), "b").unionByName(found.select(F.col("row").alias("a"), F.col("c").alias("b")))
    parts = stored(components(together), "jaccard-components")
    roots = found.join(parts, found["row"] == parts["vertex"], "left").select("doc_id", F.coalesce("component", "row").alias("root"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("least"))
    answer = roots.join(least, "root").groupBy(F.col("doc_id").alias("of")).agg(F.min("least").alias("component_id"))
    return files.join(answer, files["doc_id"] == answer["of"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def class_components(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """k_n, k_f1, k_f2 (a set), component. docs: doc_id (null, or once each), text; rows: their profiles."""
    files = rows.where("kind = 0")
    classes = files.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), *[F.min(m).alias(m) for m in ORDERS])
    classes = stored(classes, "jaccard-classes")
    members = classes.select("rep", "n", F.col("rep").alias("gid"), F.lit(0.0).alias("far"))
    links, heads = [], classes
    for by in ORDERS:
        found = led(docs, heads, by)
        links.append(found.select("a", "b"))
        new = found.select(F.col("a").alias("la"), F.col("b").alias("lb"), F.col("far").alias("lfar"))
        members = members.join(new, members["gid"] == new["la"], "left").select(
            "rep", "n", F.coalesce("lb", "gid").alias("gid"), (F.col("far") + F.coalesce("lfar", F.lit(0.0))).alias("far")
        )
        members = stored(members, "jaccard-members")
        heads = heads.join(new, heads["rep"] == new["la"], "left_anti")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(BUCKETS, 1 << int(np.ceil(np.log2(max(total // 4 // BUCKET, 1)))))
    pairs = stored(candidates(postings(docs, members.select("rep", "gid"), frequent(rows), buckets), buckets), "jaccard-candidates")
    checked = stored(compared(docs, pairs).select("a", "b", F.expr(LINKED).alias("link"), F.expr(DISTANCE).alias("far")), "jaccard-checked")
    links.append(checked.where("link").select("a", "b"))
    parts = stored(components(union(links)), "jaccard-components")
    late = stored(open_links(docs, checked.where("not link").select("a", "b", "far"), members, parts), "jaccard-late")
    if not late.isEmpty():
        again = parts.select(F.col("vertex").alias("a"), F.col("component").alias("b"))
        parts = stored(components(again.unionByName(late)), "jaccard-components")
    known = classes.join(parts, classes["rep"] == parts["vertex"], "left")
    return known.select(F.col("n").alias("k_n"), F.col("f1").alias("k_f1"), F.col("f2").alias("k_f2"), F.coalesce("component", "rep").alias("component"))


def of_classes(files: DataFrame, known: DataFrame) -> DataFrame:
    """Each document's row from what is known of its set."""
    same = (files["n"] == known["k_n"]) & (files["f1"] == known["k_f1"]) & (files["f2"] == known["k_f2"])
    told = files.where("n > 0").join(known, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    empty = files.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return told.unionByName(empty)


def frequent(rows: DataFrame) -> DataFrame:
    """f1, count: the most frequent shingles, down to the power of two that leaves HOT_SHINGLES of them at most."""
    counts = stored(rows.where("kind = 1").groupBy("f1").agg(F.sum("n").alias("count")), "jaccard-frequent")
    of = sorted(((r["k"], r["many"]) for r in counts.groupBy(F.floor(F.log2("count")).alias("k")).agg(F.count("*").alias("many")).collect()), reverse=True)  # a row for each power
    least, many = 63, 0
    for k, n in of:
        if (many := many + n) > HOT_SHINGLES:
            break
        least = k
    return counts.where(F.floor(F.log2("count")) >= least)


def open_links(docs: DataFrame, apart: DataFrame, members: DataFrame, parts: DataFrame) -> DataFrame:
    """a, b: links between members of groups whose leaders (a, b, far) don't link, where by their distances they still may and nothing connects the groups yet.

    With A and B what sets x and y apart from the leader of x's group (members of one of the two only), x and y share
    |leader| - |missing in x| - |missing in y| + |A and B| shingles.
    """
    slack = 0.25 + 1e-9
    size = members.groupBy("gid").agg(F.max("far").alias("r"), F.count("*").alias("many"), F.sum("n").alias("words"))
    sa, sb = (size.select(*[F.col(c).alias(f"{c}_{k}") for c in size.columns]) for k in "ab")
    pa_, pb = (parts.select(F.col("vertex").alias(v), F.col("component").alias(c)) for v, c in (("va", "ca"), ("vb", "cb")))
    left = apart.join(sa, F.col("a") == F.col("gid_a")).join(sb, F.col("b") == F.col("gid_b")).where(f"far - r_a - r_b <= {slack} and (r_a > 0 or r_b > 0)")
    left = left.join(pa_, F.col("a") == F.col("va"), "left").join(pb, F.col("b") == F.col("vb"), "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    # Of the larger group the leader answers; of the smaller one come those members that its radius leaves open.
    large = F.col("many_a") >= F.col("many_b")
    left = stored(left.select(F.when(large, F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(large, F.col("b")).otherwise(F.col("a")).alias("small"), "far", F.when(large, F.col("r_a")).otherwise(F.col("r_b")).alias("r")), "jaccard-open")
    of = members.select(F.col("gid").alias("of"), F.col("rep").alias("b"), F.col("n").alias("n"), F.col("far").alias("own"))
    other = left.join(of, F.col("small") == F.col("of")).where(f"far - r - own <= {slack}").select(F.col("lead").alias("a"), "b", "n").distinct()
    other = stored(other, "jaccard-open-members")
    leads = other.groupBy("a").agg(F.count("*").alias("y_many"), F.sum("n").alias("y_words"))
    leads = leads.join(size, leads["a"] == size["gid"]).select("a", _blocks("many", "words").alias("xs"), _blocks("y_many", "y_words").alias("ys"))
    own = of.join(leads.select("a"), F.col("of") == F.col("a")).select("a", "b")
    asked = own.withColumn("side", F.lit(0)).unionByName(other.select("a", "b").withColumn("side", F.lit(1)))
    apart_ = with_texts(docs, stored(asked, "jaccard-asked")).mapInArrow(lean(_differences), "a long, b long, side int, lead_n long, n long, missing long, other binary")
    apart_ = apart_.join(leads.withColumnRenamed("a", "lead"), F.col("a") == F.col("lead"))
    mine = F.when(F.col("side") == 0, F.col("xs")).otherwise(F.col("ys"))
    theirs = F.when(F.col("side") == 0, F.col("ys")).otherwise(F.col("xs"))
    block, against = F.pmod(F.xxhash64("b"), mine).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), theirs - 1)).alias("against")
    dealt = apart_.select("a", "b", "side", "lead_n", "n", "missing", "other", block, against)
    x, y = (F.when(F.col("side") == k, F.col("block")).otherwise(F.col("against")).alias(c) for k, c in ((0, "x"), (1, "y")))
    dealt = dealt.select("a", "b", "side", "lead_n", "n", "missing", "other", x, y)
    return dealt.groupBy("a", "x", "y").applyInArrow(_linked_by_differences, "a long, b long")


def _blocks(many: str, words: str) -> Column:
    return F.expr(f"cast(greatest(ceil({many} / {DIFFERENCE_SETS}), ceil({words} / {DIFFERENCE_SHINGLES})) as bigint)")


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What sets each text (b) apart from its leader's (a): the shingles that only one of them has, and how many of the leader's are missing."""
    known = _Sets()
    for batch in batches:
        rows = []
        for a, text, own in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), sets(batch.column(4).to_pylist()), strict=True):
            lead = known(a, text)
            shared = common(own, lead)
            rows.append((len(lead), len(own), len(lead) - shared, np.setxor1d(own, lead, assume_unique=True).tobytes()))
        columns = zip(*rows, strict=True) if rows else [()] * 4
        numbers = [pa.array(c, kind) for c, kind in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int32()), *numbers], ["a", "b", "side", "lead_n", "n", "missing", "other"])


def _linked_by_differences(rows: pa.Table) -> pa.Table:
    """For each set of side 1 one of side 0 that it links with, if there is one."""
    _, b, side, lead_n, n, missing = (rows.column(k).to_numpy() for k in range(6))
    other = [np.frombuffer(x, np.uint64) for x in rows.column(6).to_pylist()]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found: list[tuple[int, int]] = []
    if len(left) and len(right):
        tok, at = np.concatenate([other[k] for k in left]), np.repeat(np.arange(len(left)), [len(other[k]) for k in left])
        order = np.argsort(tok)
        tok, at = tok[order], at[order]
        for k in right:
            low, high = np.searchsorted(tok, other[k]), np.searchsorted(tok, other[k], "right")
            times = high - low
            places = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
            shared = lead_n[k] - missing[k] - missing[left] + np.bincount(at[places], minlength=len(left))
            links = 100 * shared >= 75 * (n[k] + n[left] - shared)
            if links.any():
                found.append((b[left[links.argmax()]], b[k]))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def linked_sql(docs: str = "documents") -> str:
    """linked in SQL, for tables whose doc_ids are neither null nor repeated: every pair of documents with a common shingle is counted."""
    return f"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from {docs}),
s as (
  select distinct doc_id, hash(list_slice(words, i, i + 4)) as shingle from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from d where len(words) >= 5)
  union all
  select doc_id, hash(words) from d where len(words) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 75 * (a.n + b.n - shared)),
edges as (select x, y from links union all select y, x from links),
reach(doc_id, other) as (select x, x from edges union select r.doc_id, e.y from reach r join edges e on r.other = e.x),
least as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(least.component_id, d.doc_id) as component_id
from d left join n on d.doc_id = n.doc_id left join least on d.doc_id = least.doc_id
"""
