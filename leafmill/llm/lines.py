"""Line deduplication by a deletion-neighbourhood join.

Two lines are duplicates if at most one word must be substituted, inserted or deleted to turn one into the other (a
line equal but for white space is one too). A line is removed if a duplicate of it stands earlier, by doc_id and line.

Each line of MIN_NEAR words or more emits the hash of itself and of every variant with one word deleted; equal variants join. A
substitution joins two variants with the same place deleted, an insertion joins a line with another's variant.
Only the earliest line of each variant is kept as partner, so no group makes pairs of its members. The edit distance of the
partners is verified on their words.

Before that, lines that can't have a partner are set aside: of a line's words in three parts, one edit leaves two
unchanged, so a line that has no two parts in common with a different line has no near duplicate. The hash of a sequence is the
exclusive or of the hashes of its words with their places, so all variants of a line come from running sums.

Defined results: blank lines stay; lines of fewer than MIN_NEAR words are only compared for equality; null text stays null;
other columns stay as they are, but n_lines, n_exact and n_near are
replaced; very long lines and texts are taken whole, a line's variants by running sums over its words;
rows with equal doc_id and text count as one document, and lines at one place of one doc_id as equally early: both stay
unless an earlier line is a duplicate; a null doc_id comes before any other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import filter_of, may_hold, pick, replaced, stored

MIN_NEAR = 5
_SPACE = " \t\r\f\x0B"
#: Keys that a filter of fixed size is made from before the exact join; with more, the join comes alone.
FILTER_KEYS = 4_000_000


def _place(doc_id: Column, line_no: Column) -> Column:
    """Orders lines by document and line; one number, so that sums of it aggregate in hashed rows."""
    return (F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(-(2**63)).cast("decimal(20,0)")) * F.lit(2**32).cast("decimal(11,0)") + line_no.cast("decimal(11,0)")).cast("decimal(38,0)")


def _parts(words: Column, n: Column) -> Column:
    """Keys of which any line one edit away has one, too: two of the three parts of its words, and the same as the longer of two lines."""

    def key(of: Column, side: int, *parts: Column) -> Column:
        return F.xxhash64(of, F.lit(side), *parts)

    def keys(of: Column) -> list[Column]:
        first = F.floor(of / 3).cast("int")
        last = F.floor((of - first) / 2).cast("int")
        end = lambda k: F.slice(words, n - k + 1, k)
        return [key(of, 0, F.slice(words, 1, of - last)), key(of, 1, end(of - first)), key(of, 2, F.slice(words, 1, first), end(last))]

    return F.array(*keys(n), *keys(n - 1))


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _raw_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, line, raw: the lines of docs, with spaces for other blanks, and their hash."""
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("text_hash", F.xxhash64("text"))
    for blank in _SPACE[1:]:
        rows = rows.withColumn("text", F.replace("text", F.lit(blank), F.lit(" ")))
    lines = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("raw", F.xxhash64("line"))


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, raw, n, k1, k2 (their words' hash of 128 bits), place and parts of the lines of docs that aren't blank."""
    words = _raw_lines(docs).withColumn("words", _words(F.col("line"))).withColumn("n", F.size("words")).where("n > 0")
    return words.select(
        "doc_id",
        "text_hash",
        "line_no",
        "raw",
        "n",
        F.xxhash64("words").alias("k1"),
        F.xxhash64(F.lit(1), "words").alias("k2"),
        _place(F.col("doc_id"), F.col("line_no")).alias("place"),
        F.when(F.col("n") >= MIN_NEAR, _parts(F.col("words"), F.col("n"))).otherwise(F.array().cast("array<bigint>")).alias("parts"),
    )


def _with_partner(docs: DataFrame, table: DataFrame, filter_keys: int) -> DataFrame:
    """k1, k2, line, place (of its first occurrence): different lines that may have a near duplicate."""
    parts = table.where(F.col("n") >= MIN_NEAR).select("k1", "raw", F.explode("parts").alias("part"))
    common = stored(parts.groupBy("part").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("part"), "lines-parts")
    small = common.count() <= filter_keys
    if small:
        parts = may_hold(parts, "part", filter_of(common, "part"))
    wanted = parts.join(common.withColumnRenamed("part", "p"), F.col("part") == F.col("p")).select(F.col("raw").alias("w")).distinct()
    wanted = stored(wanted, "lines-wanted")
    lines = _raw_lines(docs)
    if small:
        lines = may_hold(lines, "raw", filter_of(wanted, "w"))
    kept = lines.join(wanted, lines["raw"] == wanted["w"], "left_semi").withColumn("words", _words(F.col("line")))
    keyed = kept.select(F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2"), F.array_join("words", " ").alias("line"), _place(F.col("doc_id"), F.col("line_no")).alias("place"))
    return stored(keyed.groupBy("k1", "k2", "line").agg(F.min("place").alias("place")), "lines-candidates")


def _variants(lines: DataFrame) -> DataFrame:
    """k1, k2, place, v, gone: the hash of each line (gone = -1) and of it without the word at place `gone`."""
    placed = lines.repartition("k1", "k2").select("k1", "k2", "place", F.posexplode(F.split("line", " ")).alias("j", "w"))
    hashed = placed.select("k1", "k2", "place", "j", F.xxhash64("w", "j").alias("here"), F.xxhash64("w", F.col("j") - 1).alias("shifted"))
    whole = Window.partitionBy("k1", "k2")
    upto = whole.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.select(
        "*",
        F.bit_xor("here").over(upto).alias("here_to"),
        F.bit_xor("shifted").over(upto).alias("shifted_to"),
        F.bit_xor("here").over(whole).alias("here_all"),
        F.bit_xor("shifted").over(whole).alias("shifted_all"),
    )
    without = F.col("here_to").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("shifted_to")).bitwiseXOR(F.col("shifted_all"))
    own = F.struct(without.alias("v"), F.col("j").alias("gone"))
    line = F.struct(F.col("here_all").alias("v"), F.lit(-1).alias("gone"))
    out = F.when(F.col("j") == 0, F.array(line, own)).otherwise(F.array(own))
    return sums.select("k1", "k2", "place", F.explode(out).alias("e")).select("k1", "k2", "place", "e.v", "e.gone")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether at most one word differs, is missing or is added between two arrays of words."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))  # padded with nulls
    first = F.array_position(same, False)  # from 1; 0: equal
    rest = lambda x, at: F.slice(x, F.greatest(at, F.lit(1)), F.size(x))
    return (
        (first == 0)
        | (rest(a, first + 1) == rest(b, first + 1))
        | (rest(a, first + 1) == rest(b, first))
        | (rest(a, first) == rest(b, first + 1))
    )


def near_duplicates(docs: DataFrame, table: DataFrame, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """k1, k2: different lines that have an earlier line within one edit."""
    lines = _with_partner(docs, table, filter_keys)
    entries = stored(_variants(lines), "lines-variants")
    again = stored(entries.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v"), "lines-repeated")
    if again.count() <= filter_keys:  # most variants stand alone and go no further
        entries = stored(may_hold(entries, "v", filter_of(again, "v")), "lines-variants")
    earliest = entries.groupBy("v", "gone").agg(F.min("place").alias("m"), F.count("*").alias("c"))
    by_hash = earliest.groupBy("v").agg(
        F.min(F.when(F.col("gone") < 0, F.col("m"))).alias("as_line"),
        F.min(F.when(F.col("gone") >= 0, F.col("m"))).alias("as_variant"),
        F.sum("c").alias("all"),
    )
    by_hash = by_hash.where(F.col("all") > 1).withColumnRenamed("v", "h_v")
    both = earliest.join(by_hash, earliest["v"] == by_hash["h_v"])
    partner = F.when(F.col("gone") < 0, F.col("as_variant")).otherwise(F.least("m", "as_line"))
    partners = both.select(F.col("v").alias("p_v"), F.col("gone").alias("p_gone"), partner.alias("partner")).where("partner is not null")
    found = (
        entries.join(partners, (entries["v"] == partners["p_v"]) & (entries["gone"] == partners["p_gone"]))
        .where(F.col("partner") < F.col("place"))
        .groupBy("k1", "k2")
        .agg(F.min("partner").alias("partner"))
    )
    text = lines.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), "line")
    other = lines.select(F.col("place").alias("o_place"), F.col("line").alias("o_line"))
    pairs = found.join(text, (found["k1"] == text["t1"]) & (found["k2"] == text["t2"]))
    pairs = pairs.join(other, pairs["partner"] == other["o_place"])
    return pairs.where(_one_edit(F.split("line", " "), F.split("o_line", " "))).select("k1", "k2").distinct()


def removed_lines(docs: DataFrame, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """doc_id, text_hash, line_no, near: the lines that go; near, if no earlier line is equal."""
    table = stored(split_lines(docs), "lines")
    near = near_duplicates(docs, table, filter_keys).select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.lit(True).alias("near"))
    firsts = table.groupBy("k1", "k2").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    told = firsts.join(near, (firsts["k1"] == near["n1"]) & (firsts["k2"] == near["n2"]), "left")
    told = told.where("near or last > first").select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), "first", F.coalesce("near", F.lit(False)).alias("near"))
    told = stored(told, "lines-told")  # so that the join deals both sides itself and can split a line that very many documents have
    gone = table.join(told, (table["k1"] == told["f1"]) & (table["k2"] == told["f2"])).where(F.col("near") | (F.col("place") > F.col("first")))
    return gone.select("doc_id", "text_hash", "line_no", (F.col("place") == F.col("first")).alias("near"))


def with_counts(docs: DataFrame, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """docs with their text replaced by the lines that stay, n_lines, n_exact and n_near: lines that aren't blank, those removed as equal and as near."""
    gone = removed_lines(docs, filter_keys).distinct().groupBy("doc_id", "text_hash").agg(
        F.collect_list("line_no").alias("__gone"),
        F.count_if(~F.col("near")).alias("__exact"),
        F.count_if("near").alias("__near"),
    )
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__gone", "__exact", "__near")
    rows = docs.withColumn("__text_hash", F.xxhash64("text"))
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["__id"]) & (rows["__text_hash"] == gone["__hash"]), "left")
    lines = F.split(F.col("text"), "\n")
    left = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(F.col("__gone"), i), x)), lambda x: x.isNotNull()), "\n")
    )
    filled = F.size(F.filter(lines, lambda x: F.rlike(x, F.lit("[^ \\t\\r\\f\\x0B]"))))
    new = {
        "text": left,
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(filled).cast("bigint"),
        "n_exact": F.coalesce("__exact", F.lit(0)).cast("bigint"),
        "n_near": F.coalesce("__near", F.lit(0)).cast("bigint"),
    }
    return joined.select(*replaced(docs, new))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with repeated lines removed (n_chars follows, where it is a column), without documents that had lines and lost all."""
    out = with_counts(docs).where((F.col("n_lines") == 0) | (F.col("n_exact") + F.col("n_near") < F.col("n_lines")))
    kinds = dict(docs.dtypes)
    columns = [F.length("text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)


def counts_sql(docs: str = "documents") -> str:
    """DuckDB SQL for doc_id, text, n_lines, n_exact, n_near; every variant is compared by its words."""
    return f"""
with d as (select row_number() over () as r, doc_id, text from {docs}),
l as (select r, doc_id, unnest(range(0, len(string_split(text, chr(10))))) as line_no, unnest(string_split(text, chr(10))) as raw from d),
w as (select r, doc_id, line_no, raw, list_filter(regexp_split_to_array(raw, '[ \\t\\r\\f\\x0B]+'), lambda x: x <> '') as words from l),
f as (select *, array_to_string(words, ' ') as line, struct_pack(d := doc_id, l := line_no) as place from w where len(words) > 0),
firsts as (select line, any_value(words) as words, min(place) as first from f group by line),
near_lines as (select * from firsts where len(words) >= {MIN_NEAR}),
e as (
  select line, first, md5(line) as v, -1 as gone from near_lines
  union all
  select line, first, md5(array_to_string(list_concat(words[:gone], words[gone + 2:]), ' ')), gone
  from (select *, unnest(range(0, len(words))) as gone from near_lines)),
g as (select v, gone, min(first) as m from e group by v, gone),
h as (select v, min(m) filter (where gone < 0) as as_line, min(m) filter (where gone >= 0) as as_variant from g group by v),
near as (
  select distinct e.line from e join g on e.v = g.v and e.gone = g.gone join h on e.v = h.v
  where case when e.gone < 0 then h.as_variant < e.first else g.m < e.first or h.as_line < e.first end),
told as (
  select f.*, firsts.first, f.place > firsts.first as later, near.line is not null as is_near
  from f join firsts on f.line = firsts.line left join near on f.line = near.line),
gone as (
  select r, count(*) as n_lines, count(*) filter (where later) as n_exact, count(*) filter (where is_near and not later) as n_near,
    list(line_no) filter (where later or is_near) as nos
  from told group by r),
kept as (
  select l.r, string_agg(raw, chr(10) order by line_no) as text from l left join gone on l.r = gone.r
  where gone.nos is null or not list_contains(gone.nos, l.line_no) group by l.r)
select d.doc_id, case when d.text is null then null else coalesce(kept.text, '') end as text,
  coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_exact, 0)::bigint as n_exact, coalesce(n_near, 0)::bigint as n_near
from d left join gone on d.r = gone.r left join kept on d.r = kept.r
"""
