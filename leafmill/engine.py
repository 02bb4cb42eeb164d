"""Documents as tables: readers and writers by format name, applied to columns of text or bytes."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leafmill import tree
from leafmill.extensions import applied, checked, takes_names
from leafmill.sinks import registry as sinks
from leafmill.sources import registry as sources
from leafmill.sources.markdown import KNOWN

DOCS = "doc_id bigint, ast string, status string, error string"
#: Calls within each other that readers and writers may make: they recurse into nested elements, and Python's own limit ends at about a thousand.
CALLS = 1_000_000
#: Nodes of a batch that goes back to Spark.
ROWS = 20_000


def _deep() -> None:
    """Lets a worker follow deeply nested documents; calls from Python to Python take no C stack."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), CALLS))


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def split_format(name: str) -> tuple[str, frozenset, frozenset]:
    """`format+extension-extension` as its parts."""
    import re

    m = re.fullmatch(r"([\w]+)((?:[+-]\w+)*)", name)
    if not m:
        raise ValueError(f"{name} is no format")
    found = re.findall(r"([+-])(\w+)", m[2])
    return m[1], frozenset(x for s, x in found if s == "+"), frozenset(x for s, x in found if s == "-")


def reader(name: str) -> Callable[[str | bytes], dict]:
    """The reader of a format with extensions; an unknown name is an error here, on the driver."""
    base, plus, minus = split_format(name)
    if base not in sources.READERS:
        raise ValueError(f"{base} is no input format")
    f = sources.READERS[base]
    if not plus and not minus:
        return f
    if takes_names(f):
        checked(plus | minus, KNOWN)
        return partial(f, plus=plus, minus=minus)
    checked(plus | minus)
    if base == "html" and "open_references" in minus:
        f = partial(f, open_references=False)
    return partial(applied, f, plus, minus)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if a scan would give fewer parts than there are cores: parsing takes longer than moving the text. Larger inputs stay as they are."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, len(df.inputFiles())
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if max(files, size // split) >= cores else df.repartition(2 * cores)


def read_documents(df: DataFrame, format: str, id: str = "doc_id", content: str = "text") -> DataFrame:
    """DOCS: the documents of a table, one row each, as JSON trees; a document that can't be read has status `error` and what was wrong."""
    parse = reader(format)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out.append((i, json.dumps(parse(text if text is not None else ""), ensure_ascii=False), "ok", None))
                except Exception as e:  # a bad document is a row with its error, not a failed job
                    out.append((i, None, "error", _told(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], [], []), (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["doc_id", "ast", "status", "error"])

    return spread(df.select(F.col(id).cast("bigint"), F.col(content))).mapInArrow(convert, DOCS)


def _schema() -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(tree.NODES))


def _packed(held: list[list], schema: pa.Schema) -> pa.RecordBatch:
    """The columns of schema from rows of all of tree.COLUMNS."""
    columns = dict(zip(tree.COLUMNS, zip(*held, strict=True), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _node_batches(parse: Callable[[str], dict], schema: pa.Schema, keep: frozenset[str] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: id, content, and as a third column, if there is one, what was wrong before."""
    _deep()
    for batch in batches:
        held: list[list] = []
        known = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for i, text, error in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), known, strict=True):
            try:
                own = [tree.error_list(i, error)] if error is not None else tree.flat(i, parse(text if text is not None else ""))
            except Exception as e:
                own = [tree.error_list(i, _told(e))]
            held.extend(own if keep is None else tree.under(own, keep))
            if len(held) >= ROWS:
                yield _packed(held, schema)
                held = []
        if held:
            yield _packed(held, schema)


def read_nodes(df: DataFrame, format: str, id: str = "doc_id", content: str = "text", keep: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """tree.NODES: all nodes of the documents of a table, read and flattened in one pass; a document that can't be read is one row of kind `error` with what was wrong.

    With keep only the roots, the nodes right below them and the subtrees of nodes of these types leave the reader; their numbers are those of the whole tree.
    With columns only these of tree.NODES are made.
    """
    whole = StructType.fromDDL(tree.NODES)
    kind = whole if columns is None else StructType([whole[c] for c in columns])
    parse, schema, types = reader(format), to_arrow_schema(kind), None if keep is None else frozenset(keep)
    return spread(df.select(F.col(id).cast("bigint"), F.col(content))).mapInArrow(lambda b: _node_batches(parse, schema, types, b), kind)


def _telling(formats: list[str], value: Callable[[dict], tuple], schema: pa.Schema, texts: Callable[[tuple], Iterator[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches in, told batches out; texts makes (format, id, content, what was wrong before) of a row. The last column is what was wrong; the fields before it are null then."""
    parsers = {name: reader(name) for name in formats}
    nothing = (None,) * (len(schema) - 3)

    def told(name: str, content: str | bytes | None, error: str | None) -> tuple:
        if error is not None:
            return *nothing, error
        try:
            with tree.in_runs():
                doc = parsers[name](content if content is not None else "")
            return *value(doc), None
        except Exception as e:  # as in read_documents
            return *nothing, _told(e)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out = [(name, i, *told(name, content, error)) for row in zip(*(c.to_pylist() for c in part.columns), strict=True) for name, i, content, error in texts(row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return tell


def read_values(df: DataFrame, formats: list[str], value: Callable[[dict], tuple], fields: str, id: str = "doc_id", content: str = "text", format: str = "format") -> DataFrame:
    """format, doc_id, fields (a DDL string) and error: what value tells of each document's tree, read and told in one pass, so that no node leaves the reader and nothing is shuffled. The column format says which of formats a row is in.

    value gets trees in which a node Run may stand for the words of a plain text (tree.in_runs). A document that can't be read or told is a row with null fields
    and its error, which is null in all other rows: a document without text has its fields. The rows stay where they are: see spread.
    """
    kind = StructType.fromDDL(f"format string, doc_id bigint, {fields}, error string")
    return df.select(format, F.col(id).cast("bigint"), content).mapInArrow(_telling(formats, value, to_arrow_schema(kind), lambda row: iter([(*row, None)])), kind)


def reread_values(df: DataFrame, source: str, targets: list[str], value: Callable[[dict], tuple], fields: str, id: str = "doc_id", content: str = "text") -> DataFrame:
    """read_values of documents that are read from source, written in each of targets and read again, all in one pass, so that what is written never leaves the worker. A document that can't be written has its error, too."""
    parse, kind = reader(source), StructType.fromDDL(f"format string, doc_id bigint, {fields}, error string")
    writers = []
    for target in targets:
        base, plus, minus = split_format(target)
        checked(plus | minus, KNOWN)
        writers.append((target, sinks.writer(base), base in sinks.RUNS))

    def texts(row: tuple) -> Iterator[tuple]:
        i, text = row
        try:
            with tree.in_runs():
                doc, error = json.dumps(parse(text if text is not None else "")), None
        except Exception as e:
            doc, error = None, _told(e)
        for target, write, runs in writers:
            made, wrong = None, error
            if doc is not None:
                try:
                    own = json.loads(doc)
                    made = write(own if runs else tree.unrun(own))
                except Exception as e:
                    wrong = _told(e)
            yield target, i, made, wrong

    return df.select(F.col(id).cast("bigint"), content).mapInArrow(_telling(targets, value, to_arrow_schema(kind), texts), kind)


def nodes(docs: DataFrame) -> DataFrame:
    """tree.NODES of documents (DOCS), with a row of kind `error` for each that couldn't be read."""
    schema = _schema()
    error = F.when(F.col("status") != "ok", F.coalesce("error", F.lit("")))
    return docs.select("doc_id", "ast", error.alias("error")).mapInArrow(lambda b: _node_batches(json.loads, schema, None, b), tree.NODES)


def transform(docs: DataFrame, f: Callable[[dict], dict]) -> DataFrame:
    """DOCS with f applied to every document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        for batch in batches:
            new = [json.dumps(f(json.loads(x)), ensure_ascii=False) if x is not None else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), batch.column(2), batch.column(3)], ["doc_id", "ast", "status", "error"])

    return docs.select("doc_id", "ast", "status", "error").mapInArrow(apply, DOCS)


def render(docs: DataFrame, format: str) -> DataFrame:
    """doc_id, output, error: documents (DOCS) in a format; binary for packages like epub. A document that can't be read or written has a null output and what was wrong."""
    base, plus, minus = split_format(format)
    checked(plus | minus, KNOWN)
    write, binary = sinks.writer(base), base in sinks.BINARY
    kind = pa.binary() if binary else pa.string()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        for batch in batches:
            out, errors = [], []
            for ast, status, error in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                made = None
                if status == "ok":
                    try:
                        made, error = write(json.loads(ast)), None
                    except Exception as e:  # as in read_documents
                        error = _told(e)
                out.append(made)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind), pa.array(errors, pa.string())], ["doc_id", "output", "error"])

    return docs.select("doc_id", "ast", "status", "error").mapInArrow(convert, f"doc_id bigint, output {'binary' if binary else 'string'}, error string")


def convert(df: DataFrame, source: str, target: str, id: str = "doc_id", content: str = "text") -> DataFrame:
    """doc_id, output, error: the documents of a table from one format to another, read and written in one pass. A document that can't be read or written has a null output and what was wrong."""
    parse = reader(source)
    base, plus, minus = split_format(target)
    checked(plus | minus, KNOWN)
    write, binary = sinks.writer(base), base in sinks.BINARY
    kind = pa.binary() if binary else pa.string()

    def made(text: str | bytes | None) -> tuple[str | bytes | None, str | None]:
        try:
            return write(parse(text if text is not None else "")), None
        except Exception as e:  # as in read_documents
            return None, _told(e)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        for batch in batches:
            out = [made(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], kind), pa.array([e for _, e in out], pa.string())], ["doc_id", "output", "error"])

    return spread(df.select(F.col(id).cast("bigint"), F.col(content))).mapInArrow(both, f"doc_id bigint, output {'binary' if binary else 'string'}, error string")


def convert_many(df: DataFrame, source: str, targets: list[str], id: str = "doc_id", content: str = "text") -> DataFrame:
    """doc_id, format, output, error: each document read once and written in several text formats."""
    parse = reader(source)
    writers = []
    for target in targets:
        base, plus, minus = split_format(target)
        checked(plus | minus, KNOWN)
        if base in sinks.BINARY:
            raise ValueError(f"{target} is no text format")
        writers.append((target, sinks.writer(base)))

    def made(write: Callable[[dict], str], doc: dict | None, error: str | None) -> tuple[str | None, str | None]:
        try:
            return (write(doc), None) if doc is not None else (None, error)
        except Exception as e:  # as in read_documents
            return None, _told(e)

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, rows = batch.slice(at, 200), []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    try:
                        doc, error = parse(text if text is not None else ""), None
                    except Exception as e:
                        doc, error = None, _told(e)
                    rows += [(i, target, *made(write, doc, error)) for target, write in writers]
                columns = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 3), strict=True)], ["doc_id", "format", "output", "error"])

    return spread(df.select(F.col(id).cast("bigint"), F.col(content))).mapInArrow(many, "doc_id bigint, format string, output string, error string")
