"""Mixing sources to target weights by Poisson replication.

Each source s has a target share w_s of the mixture. A document of s is repeated Poisson(rate_s) times, with
rate_s = w_s * size of the mixture / size of s, so its expected repetitions meet the target. The Poisson value is the
inverse of the distribution function at a number in [0, 1) that only the seed and doc_id determine: no state, no
second pass, the same copies on every run and every partitioning. The copies are then dealt out by a hash and sorted by it.

Defined results: a null source is a source of its own; a null doc_id hashes as the empty string; repeated rows get
equal counts; null and empty texts have size 0 and are replicated like others; a source of size 0 has rate 0; an empty
table gives an empty mixture. Columns named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import pick, replaced

#: A Poisson variable of a large rate is a sum of independent ones of at most this rate, so exp(-rate) never underflows.
PIECE_RATE = 8.0
#: Values of the distribution function that are tabulated: at rate 8 the rest is below 1e-30, and the hash has 52 bits.
TABLE = 72
#: Sources that are looked up by a broadcast; more are joined by a salted shuffle.
BROADCAST_SOURCES = 10_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(16**13))


def cumulative(rate: Column) -> Column:
    """P(N <= k) for k = 0 .. TABLE - 1, summed in order."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TABLE - 1)).cast("array<double>"), start, step, lambda a: a["all"])


def rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, epochs: float) -> DataFrame:
    """source, rate: the mean repetitions of a document. Without weights a source's target is its share of characters to the power temperature."""
    size = (
        pick(docs, source="source", text="text")
        .groupBy("source")
        .agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).alias("size"))
    )
    if weights is None:
        target = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        target = F.lit(0.0)
        for source, weight in weights.items():
            target = F.when(F.col("source") == source, F.lit(float(weight))).otherwise(target)
    size = size.withColumn("target", target)
    whole = size.agg(F.sum("size").alias("all_size"), F.sum("target").alias("all_target"))
    share = F.col("target") / F.col("all_target")
    rate = F.when((F.col("size") > 0) & (F.col("all_target") > 0), share * (F.col("all_size") * F.lit(float(epochs))) / F.col("size")).otherwise(0.0)
    return size.join(F.broadcast(whole)).select("source", rate.alias("rate"))  # whole is one row


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """The mixture: docs' columns, copy_no (from 0) and mix_key, the global order of the shuffle."""
    table = rates(docs, weights, temperature, epochs)
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE_RATE), F.lit(1)).cast("int")
    table = table.select(F.col("source").alias("__source"), pieces.alias("__pieces"), cumulative(F.col("rate") / pieces).alias("__cdf"))
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    key = F.col("`source`").eqNullSafe(F.col("__source"))
    if few:
        with_rate = docs.join(F.broadcast(table), key)
    else:
        salted = docs.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        dealt = table.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("bigint"))
        with_rate = salted.join(dealt, key & (F.col("__salt") == F.col("__to"))).drop("__salt", "__to")
    doc = F.coalesce(F.col("`doc_id`").cast("string"), F.lit(""))
    drawn = F.transform(
        F.sequence(F.lit(1), F.col("__pieces")),
        lambda p: F.size(F.filter("__cdf", lambda c: c <= uniform(F.lit(str(seed)), doc, p.cast("string")))),
    )
    count = F.aggregate(drawn, F.lit(0), lambda a, x: a + x)
    copies = (
        with_rate.withColumn("__n", count)
        .where("__n > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .withColumn("__key", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}/order"), doc, F.col("__copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint"))
    )
    out = replaced(docs, {"copy_no": F.col("__copy"), "mix_key": F.col("__key")})
    return copies.repartition(F.col("__key")).sortWithinPartitions("__key").select(*out)


def mix_sql(docs: str = "documents", temperature: float = 0.5, seed: int = 17) -> str:
    """DuckDB SQL for mix(docs) with the default weights."""
    return f"""
with recursive size as (select source, sum(coalesce(length(text), 0))::bigint as size from {docs} group by source),
target as (select *, pow(size::double, {temperature}) as target from size),
rate as (
  select source, case when size > 0 and sum(target) over () > 0
    then target / sum(target) over () * (sum(size) over ())::double / size else 0 end as rate from target),
piece as (select source, greatest(ceil(rate / {PIECE_RATE}), 1)::int as pieces, rate / greatest(ceil(rate / {PIECE_RATE}), 1) as r from rate),
cdf(source, pieces, r, k, p, c) as (
  select source, pieces, r, 0, exp(-r), exp(-r) from piece
  union all
  select source, pieces, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) from cdf where k < {TABLE - 1}),
tab as (select source, pieces, list(c order by k) as cs from cdf group by source, pieces),
drawn as (
  select d.*, list_sum(list_transform(range(1, t.pieces + 1), lambda piece:
    len(list_filter(t.cs, lambda c: c <= ('0x' || substr(md5('{seed}|' || coalesce(d.doc_id::varchar, '') || '|' || piece::varchar), 1, 13))::bigint::double / {16**13}.0))))::int as n
  from {docs} d join tab t on d.source is not distinct from t.source)
select doc_id, text, lang, source, n_chars, copy_no,
  ('0x' || substr(md5('{seed}/order|' || coalesce(doc_id::varchar, '') || '|' || copy_no::varchar), 1, 15))::bigint as mix_key
from (select *, unnest(range(0, n))::int as copy_no from drawn)
"""
