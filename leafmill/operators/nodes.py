"""Queries over `nodes` (tree.NODES): everything is keyed by doc_id, so one partitioning serves all of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T


def of_type(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("type").isin(*types))


def under(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """top (a node_id of tops) with every node of its subtree: a range join inside each document."""
    t = tops.select(F.col("doc_id").alias("t_doc"), F.col("node_id").alias("top"), F.col("last_id").alias("t_last"))
    return nodes.join(t, (nodes["doc_id"] == t["t_doc"]) & nodes["node_id"].between(t["top"], t["t_last"])).drop("t_doc", "t_last")


def without(nodes: DataFrame, *types: str) -> DataFrame:
    """nodes but the subtrees of some types: a running maximum of where such a subtree ends, no join."""
    order = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    end = F.max(F.when(F.col("type").isin(*types), F.col("last_id"))).over(order)
    return nodes.withColumn("__end", end).where(F.col("__end").isNull() | (F.col("node_id") > F.col("__end"))).drop("__end")


def piece() -> Column:
    """What a node adds to the text of its ancestors."""
    raw_break = (F.col("type") == "RawInline") & F.startswith(F.lower("text"), F.lit("<br"))
    return (
        F.when(F.col("type").isin("Str", "Code", "CodeBlock", "Math"), F.col("text"))
        .when(F.col("type").isin("Space", "SoftBreak", "LineBreak") | raw_break, " ")
        .otherwise("")
    )


def text_of(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """doc_id, node_id, text for each of tops: the text of its subtree in document order, notes skipped."""
    inner = under(without(nodes, "Note"), tops).where(piece() != "")
    text = inner.groupBy("doc_id", "top").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", piece().alias("p")))), lambda x: x["p"]), "").alias("text"))
    keys = tops.select(F.col("doc_id").alias("k_doc"), F.col("node_id").alias("k_node"))
    return keys.join(text, (keys["k_doc"] == text["doc_id"]) & (keys["k_node"] == text["top"]), "left").select(F.col("k_doc").alias("doc_id"), F.col("k_node").alias("node_id"), F.coalesce("text", F.lit("")).alias("text"))


def errors(nodes: DataFrame) -> DataFrame:
    """doc_id, error of the documents that couldn't be read; what has no row per document leaves them out."""
    return nodes.where("kind = 'error'").select("doc_id", F.col("text").alias("error"))


def links(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, url, title of links and images."""
    return of_type(nodes, "Link", "Image").select("doc_id", "node_id", "type", F.col("target.url").alias("url"), F.col("target.title").alias("title"))


def link_counts(nodes: DataFrame) -> DataFrame:
    return of_type(nodes, "Link").groupBy(F.col("target.url").alias("url")).agg(F.count("*").alias("n"))


def headings(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, level, ident, text: headings don't lie in each other, so the last one that began tells whose text a node is; notes are skipped."""
    order = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("type") == "Header"
    rows = nodes.select("doc_id", "node_id", "last_id", "type", "level", F.col("attr.id").alias("ident"), piece().alias("piece"))
    head = F.last(F.when(is_head, F.struct(F.col("node_id").alias("id"), F.col("last_id").alias("last"))), ignorenulls=True).over(order)
    rows = rows.withColumns({"head": head, "note": F.max(F.when(F.col("type") == "Note", F.col("last_id"))).over(order)})
    inner = rows.where(F.col("node_id") <= F.col("head.last")).withColumn("piece", F.when(F.col("note").isNull() | (F.col("node_id") > F.col("note")), F.col("piece")).otherwise(""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "piece"))), lambda x: x["piece"]), "")
    own = lambda c: F.max(F.when(is_head, F.col(c))).alias(c)
    return inner.groupBy("doc_id", F.col("head.id").alias("node_id")).agg(own("level"), own("ident"), text.alias("text"))


def word_counts(nodes: DataFrame) -> DataFrame:
    """doc_id, n_words: Str nodes with a letter or digit; null for a document that couldn't be read."""
    word = (F.col("type") == "Str") & F.rlike("text", F.lit(r"[\p{L}\p{N}]"))
    return nodes.groupBy("doc_id").agg(F.when(~F.bool_or(F.col("kind") == "error"), F.count_if(word)).alias("n_words"))


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind", "type").agg(F.count("*").alias("n"))


def sections(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, level, ident, number, first_id, last_id, parent: the sections that headings open.

    A section ends before the next heading of its level or above. Numbers count per level, a shallower heading starts deeper
    ones anew, levels that are left out show as 0, and headings of class unnumbered don't count.
    """
    doc = Window.partitionBy("doc_id")
    heads = of_type(nodes, "Header").withColumn("seq", F.row_number().over(doc.orderBy("node_id")))
    heads = heads.withColumn("counts", ~F.array_contains(F.coalesce("attr.classes", F.array().cast("array<string>")), "unnumbered")).withColumn("top", F.min("level").over(doc))
    until = doc.orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    out = heads
    # Where the counter of level k last began anew: after the last heading above k.
    for k in range(1, 7):
        out = out.withColumn(f"reset{k}", F.coalesce(F.max(F.when(F.col("level") < k, F.col("seq"))).over(until), F.lit(0)))
    for k in range(1, 7):
        since = Window.partitionBy("doc_id", f"reset{k}").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"n{k}", F.sum(F.when((F.col("level") == k) & F.col("counts"), 1).otherwise(0)).over(since))
    numbers = F.transform(F.sequence(F.col("top"), F.col("level")), lambda k: F.element_at(F.array(*[F.col(f"n{i}") for i in range(1, 7)]), k).cast("string"))
    out = out.withColumn("number", F.when(F.col("counts"), F.array_join(numbers, ".")))
    # The next heading at this level or above, and the last one above: of all levels, by running extremes.
    after = doc.orderBy("node_id").rowsBetween(1, Window.unboundedFollowing)
    before = doc.orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    nexts = F.least(*[F.when(F.lit(k) <= F.col("level"), F.min(F.when(F.col("level") == k, F.col("node_id"))).over(after)) for k in range(1, 7)])
    parents = F.greatest(*[F.when(F.lit(k) < F.col("level"), F.max(F.when(F.col("level") == k, F.col("node_id"))).over(before)) for k in range(1, 7)])
    ends = nodes.where("kind = 'doc'").select(F.col("doc_id").alias("e_doc"), F.col("last_id").alias("e_last"))
    out = out.withColumn("next", nexts).withColumn("parent", parents)
    return out.join(ends, out["doc_id"] == ends["e_doc"]).select(
        "doc_id", "node_id", "level", F.col("attr.id").alias("ident"), "number", F.col("node_id").alias("first_id"), F.coalesce(F.col("next") - 1, F.col("e_last")).alias("last_id"), "parent"
    )


def toc(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """doc_id, place, level, number, ident, text: headings down to a depth, but those that are unnumbered and unlisted."""
    heads = headings(nodes).select(F.col("doc_id").alias("h_doc"), F.col("node_id").alias("h_node"), "text")
    hidden = of_type(nodes, "Header").where(F.array_contains("attr.classes", "unnumbered") & F.array_contains("attr.classes", "unlisted")).select(F.col("doc_id").alias("x_doc"), F.col("node_id").alias("x_node"))
    s = sections(nodes).where(F.col("level") <= depth)
    s = s.join(hidden, (s["doc_id"] == hidden["x_doc"]) & (s["node_id"] == hidden["x_node"]), "left_anti")
    order = Window.partitionBy("doc_id").orderBy("node_id")
    return s.join(heads, (s["doc_id"] == heads["h_doc"]) & (s["node_id"] == heads["h_node"])).select("doc_id", F.row_number().over(order).alias("place"), "level", "number", "ident", "text")


def path_of(template: str, number: Column, section: Column, heading: Column, ident: Column) -> Column:
    """A chunk's path: %n its number, %s the section's number, %h the heading, %i the identifier; slashes go."""
    out = F.lit(template)
    for mark, value in (("%n", number), ("%s", section), ("%h", heading), ("%i", ident)):
        out = F.replace(out, F.lit(mark), F.replace(F.coalesce(value, F.lit("")), F.lit("/"), F.lit("")))
    return out


def chunks(nodes: DataFrame, level: int = 1, template: str = "%s-%i.html") -> DataFrame:
    """doc_id, chunk_no, level, ident, number, path, prev_path, next_path, up_path, first_id, last_id: a document cut at headings of `level` and above; what stands before the first is chunk 0."""
    cut = sections(nodes).where(F.col("level") <= level)
    text = headings(nodes).select(F.col("doc_id").alias("h_doc"), F.col("node_id").alias("h_node"), F.col("text").alias("heading"))
    cut = cut.join(text, (cut["doc_id"] == text["h_doc"]) & (cut["node_id"] == text["h_node"]))
    order = Window.partitionBy("doc_id").orderBy("first_id")
    roots = nodes.where("kind = 'doc'")
    first = cut.groupBy("doc_id").agg(F.min("first_id").alias("f")).withColumnRenamed("doc_id", "f_doc")
    rest = roots.join(first, roots["doc_id"] == first["f_doc"], "left").where("f is null and last_id > 0 or f > 1")
    before = rest.select("doc_id", F.lit(0).alias("level"), F.lit("").alias("ident"), F.lit("0").alias("number"), F.lit(1).alias("first_id"), F.lit(None).cast("int").alias("parent"), F.lit("").alias("heading"))
    every = cut.select("doc_id", "level", "ident", "number", "first_id", "parent", "heading").unionByName(before)
    ends = roots.select(F.col("doc_id").alias("e_doc"), F.col("last_id").alias("e_last"))
    every = every.withColumn("chunk_no", F.row_number().over(order)).withColumn("next_first", F.lead("first_id").over(order))
    every = every.join(ends, every["doc_id"] == ends["e_doc"]).withColumn("path", path_of(template, F.lpad(F.col("chunk_no").cast("string"), 3, "0"), F.col("number"), F.col("heading"), F.col("ident")))
    every = every.withColumns({"prev_path": F.lag("path").over(order), "next_path": F.lead("path").over(order), "last_id": F.coalesce(F.col("next_first") - 1, F.col("e_last"))})
    above = every.select(F.col("doc_id").alias("u_doc"), F.col("first_id").alias("u_first"), F.col("path").alias("up_path"))
    return every.join(above, (every["doc_id"] == above["u_doc"]) & (every["parent"] == above["u_first"]), "left").select("doc_id", "chunk_no", "level", "ident", "number", "path", "prev_path", "next_path", "up_path", "first_id", "last_id")


def unique_idents(rows: DataFrame, base: str, by: list[str], order: list[str]) -> DataFrame:
    """rows with `ident`: base, or base-1, base-2 .. , the first of them that none of the rows before has got.

    Only names that agree but for numbers at their ends can meet, so each such family is named by itself: by a window where no base has a
    number, by going through its rows in order where one has.
    """
    numbers = r"(-[0-9]+)+\z"
    keys = [*by, "__root"]
    told = rows.withColumn("__root", F.regexp_replace(base, numbers, ""))
    told = told.withColumn("__mixed", F.max((F.col(base) != F.col("__root")).cast("int")).over(Window.partitionBy(*keys)) == 1)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    simple = told.where("not __mixed").withColumn("ident", F.when(n == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))
    mixed = told.where("__mixed")

    def named(family: pa.Table) -> pa.Table:
        used: set[str] = set()
        idents = []
        family = family.sort_by([(c, "ascending") for c in order])
        for name in family.column(base).to_pylist():
            k, own = 0, name
            while own in used:
                k += 1
                own = f"{name}-{k}"
            used.add(own)
            idents.append(own)
        return family.append_column("ident", pa.array(idents, pa.string()))

    whole = simple.unionByName(mixed.groupBy(*keys).applyInArrow(named, simple.schema))
    return whole.drop("__root", "__mixed")


def resolve(uses: DataFrame, definitions: DataFrame, key: str = "key", value: str = "value", seq: str = "seq", last: bool = True) -> DataFrame:
    """uses with the definition of their key in the same document: the last one (links, notes) or the first (headings); null where there is none."""
    best = (F.max_by if last else F.min_by)(value, seq).alias("resolved")
    d = definitions.groupBy("doc_id", key).agg(best).select(F.col("doc_id").alias("d_doc"), F.col(key).alias("d_key"), "resolved")
    return uses.join(d, (uses["doc_id"] == d["d_doc"]) & (uses[key] == d["d_key"]), "left").drop("d_doc", "d_key")


def cited(references: DataFrame, citations: DataFrame) -> DataFrame:
    """references (doc_id, id, ..) that are cited; a citation of * cites all."""
    all_ = citations.where("ref_id = '*'").select(F.col("doc_id").alias("a_doc")).distinct()
    some = citations.select(F.col("doc_id").alias("c_doc"), F.col("ref_id")).distinct()
    whole = references.join(all_, references["doc_id"] == all_["a_doc"], "left_semi")
    rest = references.join(all_, references["doc_id"] == all_["a_doc"], "left_anti")
    return whole.unionByName(rest.join(some, (rest["doc_id"] == some["c_doc"]) & (rest["id"].cast("string") == some["ref_id"]), "left_semi"))


def unused(definitions: DataFrame, uses: DataFrame, key: str = "key") -> DataFrame:
    """definitions that no use names."""
    u = uses.select(F.col("doc_id").alias("u_doc"), F.col(key).alias("u_key"))
    return definitions.join(u, (definitions["doc_id"] == u["u_doc"]) & (definitions[key] == u["u_key"]), "left_anti")


# --- rewriting nodes in place -----------------------------------------------------------------------------------------


def shift_headers(nodes: DataFrame, by: int) -> DataFrame:
    """Header levels plus `by`; those that end at 0 or below become paragraphs."""
    head, level = F.col("type") == "Header", F.col("level") + by
    return nodes.withColumns({"type": F.when(head & (level <= 0), "Para").otherwise(F.col("type")), "level": F.when(head & (level > 0), level).when(~head, F.col("level"))})


def retyped(nodes: DataFrame, old: str, new: str) -> DataFrame:
    """Nodes of one type as another of the same shape: Plain to Para, Link to Span."""
    out = nodes.withColumn("type", F.when(F.col("type") == old, new).otherwise(F.col("type")))
    return out.withColumn("target", F.when(F.col("type") != new, F.col("target"))) if old == "Link" else out


def capitalized(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("text", F.when(F.col("type") == "Str", F.upper("text")).otherwise(F.col("text")))


def without_comments(nodes: DataFrame) -> DataFrame:
    raw = (F.col("type").isin("RawBlock", "RawInline")) & F.startswith("fmt", F.lit("html"))
    return nodes.withColumn("text", F.when(raw, T.strip_comments(F.col("text"))).otherwise(F.col("text")))


def valid_xml_ids(nodes: DataFrame) -> DataFrame:
    """Identifiers that don't begin with a letter get id_ before them, and links to them follow."""
    bad = lambda c: (c != "") & ~F.rlike(c, F.lit(r"^\p{L}"))
    ident, url = F.col("attr.id"), F.col("target.url")
    new = F.when(F.col("attr").isNotNull(), F.col("attr").withField("id", F.when(bad(ident), F.concat(F.lit("id_"), ident)).otherwise(ident)))
    to = F.substring(url, F.lit(2), F.length(url))
    link = F.when(F.startswith(url, F.lit("#")) & bad(to), F.concat(F.lit("#id_"), to)).otherwise(url)
    return nodes.withColumns({"attr": new, "target": F.when(F.col("target").isNotNull(), F.col("target").withField("url", link))})


def east_asian_breaks(nodes: DataFrame) -> DataFrame:
    """Without soft breaks between two wide characters."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("ord")
    wide = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FF01}-\x{FF60}\x{20000}-\x{3FFFD}]"
    left, right = F.lag("text").over(w), F.lead("text").over(w)
    drop = (F.col("type") == "SoftBreak") & F.rlike(left, F.lit(wide + r"\z")) & F.rlike(right, F.lit("^" + wide))
    return nodes.withColumn("__drop", F.coalesce(drop, F.lit(False))).where("not __drop").drop("__drop")


def best_outputs(nodes: DataFrame, rank: Column) -> DataFrame:
    """Of each notebook output (a Div of class output) only the best-ranked block, ties to the first."""
    outputs = nodes.where((F.col("type") == "Div") & F.array_contains("attr.classes", "output")).select(F.col("doc_id").alias("o_doc"), F.col("node_id").alias("o_node"))
    inner = nodes.join(outputs, (nodes["doc_id"] == outputs["o_doc"]) & (nodes["parent_id"] == outputs["o_node"]))
    k = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy(rank, "ord"))
    lost = inner.withColumn("k", k).where("k > 1").select(F.col("doc_id").alias("l_doc"), F.col("node_id").alias("l_first"), F.col("last_id").alias("l_last"))
    return nodes.join(lost, (nodes["doc_id"] == lost["l_doc"]) & nodes["node_id"].between(F.col("l_first"), F.col("l_last")), "left_anti")


def slide_level(nodes: DataFrame) -> DataFrame:
    """doc_id, slide_level: the least level of a heading with content right below it; 6 without one, null for a document that couldn't be read."""
    top = nodes.where("depth = 1")
    nxt = F.lead("type").over(Window.partitionBy("doc_id").orderBy("ord"))
    found = top.withColumn("nxt", nxt).where(F.col("type") == "Header").where(~F.coalesce(F.col("nxt"), F.lit("Header")).isin("Header", "HorizontalRule"))
    levels = found.groupBy("doc_id").agg(F.min("level").alias("l")).withColumnRenamed("doc_id", "l_doc")
    docs = nodes.where("kind in ('doc', 'error')").select("doc_id", "kind")
    return docs.join(levels, docs["doc_id"] == levels["l_doc"], "left").select("doc_id", F.when(F.col("kind") == "doc", F.coalesce("l", F.lit(6))).alias("slide_level"))


def table_shapes(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, n_rows, n_cols of each table."""
    rows = nodes.where("type = 'cell'").groupBy("doc_id", F.col("parent_id").alias("node_id"), "cell.row").agg(F.sum("cell.colspan").alias("width"))
    return rows.groupBy("doc_id", "node_id").agg(F.count("*").alias("n_rows"), F.max("width").alias("n_cols"))


def media(rows: DataFrame, id: str, path: str, content: str) -> DataFrame:
    """path, sha1, n_bytes: a keyed store in which the last of a path wins; unsafe paths are named by their digest."""
    kept = rows.groupBy(path).agg(F.max_by(content, id).alias("content"))
    unsafe = F.startswith(path, F.lit("/")) | F.contains(path, F.lit("..")) | F.rlike(path, F.lit("^[a-z]+:"))
    digest = F.sha1("content")
    suffix = F.regexp_extract(path, r"(\.[A-Za-z0-9]+)\z", 1)
    return kept.select(F.when(unsafe, F.concat(digest, suffix)).otherwise(F.col(path)).alias("path"), digest.alias("sha1"), F.octet_length("content").cast("bigint").alias("n_bytes"))
