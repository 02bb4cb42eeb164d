"""Queries that read formats: each document is told where it is read, and plain words take a short way to the same tree."""

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill import engine, tree
from leafmill.plans import formats
from leafmill.sources import light


@pytest.mark.parametrize("name", ["read_light", "read_markdown", "read_xml", "read_wiki", "round_trips"])
def test_no_node_is_shuffled(spark, sf, name):
    plan = formats.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan


@pytest.mark.parametrize("name", ["read_xml", "read_wiki", "round_trips"])
def test_texts_are_dealt_out_once_for_all_formats(spark, sf, name):
    plan = formats.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") <= 1 and plan.count("MapInArrow") == 1 and plan.count("Relation [") == 1


LONG = "Some words that stand for a text, and more of them until it is long, "
ODD = [LONG + "end", LONG + " two spaces", LONG + "a full stop.", LONG.strip() + ",, no mark ,,", "Ünï " * 30, LONG + "line\n" + LONG + "line", LONG + "\t tab", LONG + "x &amp; y", "wide\u3000space and\u00a0more " * 5, " " + LONG, LONG + "mark*s _here_", "", LONG + "\n\n" + LONG + "more"]


@pytest.mark.parametrize("family,name", [(k, n) for k in ("xml", "wiki", "light") for n in formats.READ[k]])
def test_runs_stand_for_their_words(spark, family, name):
    rows = [(k, "en", "web", [p]) for k, p in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, ps array<string>")
    texts = [r.text for r in formats.spelled(docs, formats.READ[family][name]).collect()]
    assert texts == [r.text for r in formats.spelled_each(docs, {name: formats.READ[family][name]}).orderBy(F.col("doc_id")).collect()]
    read, some = engine.reader(name), 0
    for text in [*texts, *ODD]:
        whole = short = None
        try:
            whole = read(text)
            with tree.in_runs():
                short = read(text)
        except Exception as e:
            assert whole is None, e
            continue
        some += short != whole
        assert tree.unrun(short) == whole and (short == whole or formats.told(short) == formats.told(whole))
    assert some


@pytest.mark.parametrize("name", formats.ROUND)
def test_runs_are_written_and_read_as_their_words(name):
    from leafmill.sinks import registry as sinks

    write, read, some = sinks.writer(name), engine.reader(name), 0
    for text in [*ODD, "# H\n\n" + LONG + "end\n\n" + LONG + "*" + LONG + "end* x `Str ` " + LONG + "\n", '`"t": "Run", "c": "x"` {"t": "Run", "c": "a b"} ' + LONG, "Zitat Größe, naïve Wörter überall hier und noch viele mehr davon"]:
        whole = engine.reader("markdown")(text)
        with tree.in_runs():
            short = engine.reader("markdown")(text)
        assert tree.unrun(short) == whole
        out = write(whole)
        assert write(short) == out
        with tree.in_runs():
            again = read(out)
        some += again != read(out)
        assert tree.unrun(again) == read(out)
    assert some


def test_prefixes_of_attributes():
    from leafmill.sources import xml

    before = xml.re.compile(r"\b(xlink|l|xml|text|office|table|draw|w|r|epub):(?=\w+\s*=)")
    for text in ['<a xlink:href="x" l:href ="y" xml:id="z" axml:id="q" a.w:b="1">', "xml:l:foo=1 :w:r:x=2 r:x = r:y", "text: x=1 epub:type='a' é:w=1 éw:w=1"]:
        assert xml._PREFIX.sub("-", text) == before.sub(r"\1-", text)


@pytest.mark.parametrize("name", sorted(light.LANGUAGES))
def test_plain_words_hold_no_mark(name):
    text = "Some words, and CamelCase 12. End; then"
    short, long = light.Reader(light.LANGUAGES[name]), light.Reader(light.LANGUAGES[name])
    assert not short.sign.search("word and word")
    long.sign = light.re.compile("")
    assert short.inlines(text) == long.inlines(text)


def test_headings_are_looked_up_only_for_a_link_that_needs_one(monkeypatch):
    from leafmill.sources import markdown

    seen = []
    blocks = markdown._Reader.blocks
    monkeypatch.setattr(markdown._Reader, "blocks", lambda self, lines: seen.append(len(lines)) or blocks(self, lines))
    link = lambda text: markdown.read_markdown(text)["blocks"][-1]["c"][0]["c"][2][0]
    assert link("# A b\n\n[x](http://example.com/1)\n") == "http://example.com/1" and len(seen) == 1
    assert link("# A b\n\n[A b]\n") == "#a-b" and len(seen) == 3


FIELDS = [x.split(" ")[0] for x in formats.TOLD.split(", ")]


def test_a_failure_is_no_document_without_text(spark):
    rows = [(k, 1, "") for k in formats.READ["xml"]] + [("docbook", 2, "<section><para>a</section>"), ("docbook", 3, None), ("docbook", 4, "<para>a b</para>"), ("latex", 5, "a b")]
    docs = spark.createDataFrame(rows, "format string, doc_id long, text string")
    got = {(r.format, r.doc_id): r for r in engine.read_values(docs, list(formats.READ["xml"]), formats.told, formats.TOLD).collect()}
    assert len(got) == len(rows)
    for k, error in ((("docbook", 2), "ParseError: mismatched tag"), (("latex", 5), "KeyError: 'latex'")):
        assert got[k].error.startswith(error) and all(got[k][f] is None for f in FIELDS)
    for k in (*((k, 1) for k in formats.READ["xml"]), ("docbook", 3)):
        assert got[k].error is None and got[k].words == "" and got[k].n_headings == 0
    assert got["docbook", 4].error is None and got["docbook", 4].words == "a b"


def test_what_cannot_be_told_is_a_failure(spark):
    docs = spark.createDataFrame([("html", 1, "<p>a</p>"), ("html", 2, "")], "format string, doc_id long, text string")
    got = sorted(engine.read_values(docs, ["html"], lambda doc: (doc["blocks"][0]["t"],), "first string").collect(), key=lambda r: r.doc_id)
    assert [(r.first, r.error is None) for r in got] == [("Para", True), (None, False)] and got[1].error.startswith("IndexError")


def test_a_failure_to_write_is_no_document_without_text(spark, monkeypatch):
    from leafmill.sinks import registry as sinks

    def write(doc):
        raise ValueError("not this one") if "bad" in str(doc) else KeyError("nor that")

    monkeypatch.setitem(sinks.WRITERS, "native", write)
    docs = spark.createDataFrame([(1, "bad"), (2, "")], "doc_id long, text string")
    got = {(r.format, r.doc_id): r for r in engine.reread_values(docs, "markdown", ["json", "native"], formats.told, formats.TOLD).collect()}
    assert len(got) == 4 and got["json", 1].words == "bad" and got["json", 2].words == "" and got["json", 1].error is got["json", 2].error is None
    for k, error in ((1, "ValueError: not this one"), (2, "KeyError: 'nor that'")):
        assert got["native", k].error == error and all(got["native", k][f] is None for f in FIELDS)


def test_read_xml_reads_signs_of_markup(spark, tmp_path):
    odd = ["a&b", "<i>", "a<b", "x]]>y", "&lt;", "&amp", "a>b", "en"]
    rows = [(k, x, y, "Some text\nin two lines") for k, (x, y) in enumerate((x, y) for x in odd for y in (odd[0], odd[2], "web"))]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(formats.oracle_sql()["read_xml"])
    order = [d[0] for d in want.description]
    got = formats.queries()["read_xml"](spark, str(tmp_path))
    assert got.columns == order
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(key(r) for r in got.collect()) == sorted(key(r) for r in want.fetchall())


def test_read_xml_gives_no_result_where_xml_has_no_sign(spark, tmp_path):
    spark.createDataFrame([(1, "a\x01b", "web", "Some text"), (2, "en", "web", "")], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.format, r.doc_id): r for r in formats.queries()["read_xml"](spark, str(tmp_path)).collect()}
    why = {(r.format, r.doc_id): r.error for r in formats.read_each(spark, str(tmp_path), "xml").collect()}
    assert len(got) == len(why) == 2 * len(formats.READ["xml"])
    for k, r in got.items():
        failed = k[1] == 1 and k[0] != "html"
        assert (r.n_headings is None) == failed == (why[k] is not None) and (not failed or all(r[f] is None for f in FIELDS))
    assert why["fb2", 1].startswith("ParseError")
