"""Readers, writers, node operators and the registered queries against DuckDB."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill import engine
from leafmill.functions import text as T
from leafmill.operators import nodes as N
from leafmill.operators import trees
from leafmill.plans import queries as P
from leafmill.sinks.registry import BINARY, WRITERS
from leafmill.sources.html import read_html
from leafmill.sources.markdown import read_markdown
from leafmill.sources.registry import READERS
from leafmill.sources.structured import bibtex_references, parse_csv, ris_references
from leafmill.tree import plain, rows

SAMPLE = """# Hi there

A *b* **c** `d` [l](http://u.x)

- a
- b

1. x
2. y

| a | b |
|---|---|
| 1 | 2 |

> q
"""


def types(doc):
    return [b["t"] for b in doc["blocks"]]


def test_markdown_blocks():
    assert types(read_markdown(SAMPLE)) == ["Header", "Para", "BulletList", "OrderedList", "Table", "BlockQuote"]
    d = read_markdown("- [ ] to do\n- [x] done\n", "gfm")
    assert [plain([b for b in i]) for i in d["blocks"][0]["c"]] == ["☐ to do", "☒ done"]
    d = read_markdown("x[^1] [r] [h]\n\n[^1]: n\n\n    more\n\n[r]: http://r 'T'\n\n# h\n")
    kinds = [x["t"] for x in d["blocks"][0]["c"]]
    assert kinds == ["Str", "Note", "Space", "Link", "Space", "Link"]
    assert d["blocks"][0]["c"][3]["c"][2] == ["http://r", "T"] and d["blocks"][0]["c"][5]["c"][2][0] == "#h"
    assert [b["c"][1][0] for b in read_markdown("# b\n\n# b\n\n# b\n")["blocks"]] == ["b", "b-1", "b-2"]


def test_markdown_inlines():
    para = lambda s, d="markdown": read_markdown(s, d)["blocks"][0]["c"]
    assert [x["t"] for x in para("***x*** ~~s~~ H~2~O x^2^ $m$")] == ["Emph", "Space", "Strikeout", "Space", "Str", "Subscript", "Str", "Space", "Str", "Superscript", "Space", "Math"]
    assert para('"a" -- b...')[0]["t"] == "Quoted"
    assert para("[see @a, p. 3; @b]")[0]["t"] == "Cite" and len(para("[see @a; @b]")[0]["c"][0]) == 2
    assert para("a `x``y` ``z`z``")[-1]["c"][1] == "z`z"
    assert para("*not closed")[0]["t"] == "Str"


def test_markdown_extensions():
    para = lambda s, f: engine.reader(f)(s)["blocks"][0]
    assert para("==m==", "markdown+mark")["c"][0]["c"][0][1] == ["mark"]
    assert [x["t"] for x in para("a\nb", "markdown+hard_line_breaks")["c"]] == ["Str", "LineBreak", "Str"]
    assert [x["t"] for x in para("a\nb", "markdown+ignore_line_breaks")["c"]] == ["Str", "Str"]
    assert para("[[p|t]]", "markdown+wikilinks_title_after_pipe")["c"][0]["c"][2][0] == "p"
    assert para("\\(x\\)", "markdown+tex_math_single_backslash")["c"][0]["t"] == "Math"
    assert para("> [!NOTE]\n> x", "gfm")["t"] == "Div"
    assert para("'a' -- b", "markdown-smart")["c"][0]["c"] == "'a'"
    with pytest.raises(ValueError):
        engine.reader("markdown+nothing")("x")


def test_html_soup():
    d = read_html('<p>a<b>x<p>y<ul><li>1<li>2</ul><script>var t="</p>";</script><table><tr><th>h</th></tr><tr><td>v</td></tr></table>')
    assert types(d)[:3] == ["Para", "Para", "BulletList"] and types(d)[-1] == "Table"
    assert len(d["blocks"][2]["c"]) == 2


@pytest.mark.parametrize("name", ["json", "native", "xml", "html", "docbook", "jats", "latex", "mediawiki", "dokuwiki", "org", "rst", "textile", "jira", "asciidoc", "typst", "docx", "odt", "man", "t2t", "djot", "commonmark_x", "gfm"])
def test_round_trips(name):
    d = read_markdown(SAMPLE)
    back = READERS[name](WRITERS[name](d))
    assert [t for t in types(back) if t != "Div"][:1] in (["Header"], ["Para"])
    want = {"Header", "Para", "BulletList", "OrderedList", "Table"}
    assert want <= set(types(back))
    assert "there" in plain(back["blocks"]) and "c" in plain(back["blocks"])


def test_every_writer_takes_every_node():
    d = read_markdown(SAMPLE + "\nT\n:   D\n\n``` py\nx\n```\n\n| l\n| m\n\n![c](i.png)\n\n---\n\nn^[note] \"q\" $x$ [s]{.smallcaps} <b>r</b>\n\n::: {.d}\nx\n:::\n")
    for name, write in WRITERS.items():
        out = write(d)
        assert isinstance(out, bytes) == (name in BINARY) and (out or name in ("bibtex", "biblatex"))
        assert write({"meta": {}, "blocks": []}) is not None
    assert len(WRITERS) >= 75 and len(READERS) >= 51


def test_nodes_invariants():
    r = list(rows(7, read_markdown(SAMPLE)))
    assert [x["node_id"] for x in r] == list(range(len(r))) and r[0]["parent_id"] is None
    for x in r[1:]:
        assert x["parent_id"] < x["node_id"] <= x["last_id"] <= r[x["parent_id"]]["last_id"]


def test_bibliographies():
    refs = bibtex_references('@string{j="Jour"}\n@article{a, author={Doe, Jane and {The Corp}}, title={A {B}}, journal=j # " X", year=2001, pages={1--3}, crossref={p}}\n@book{p, publisher="Pub", title={Proc}}')
    assert refs[0]["author"] == [{"family": "Doe", "given": "Jane"}, {"literal": "The Corp"}]
    assert refs[0]["publisher"] == "Pub" and refs[0]["container-title"] == "Jour X" and refs[0]["page"] == "1–3"
    assert ris_references("TY  - JOUR\nAU  - Doe, J\nSP  - 1\nEP  - 4\nER  - \n")[0]["page"] == "1-4"
    d = trees.cite(read_markdown("@a says [p. @b, p. 3]."), [{"id": "a", "author": [{"family": "Doe"}], "issued": {"date-parts": [[2001]]}, "title": "T"}])
    assert "Doe (2001)" in plain(d["blocks"]) and d["blocks"][-1]["c"][0][0] == "refs"


def test_csv():
    assert parse_csv('a, "b ""c""\nd",\n\n1,2,3\n') == [["a", 'b "c"\nd', ""], ["1", "2", "3"]]


def test_trees():
    d = trees.sections(read_markdown("# a\n\nx\n\n### b\n\n# c\n"), number=True)
    assert [dict(map(tuple, b["c"][0][2]))["number"] for b in d["blocks"]] == ["1", "2"]
    assert dict(map(tuple, d["blocks"][0]["c"][1][2]["c"][0][2]))["number"] == "1.0.1"
    assert trees.sections(d) == d
    toc = trees.table_of_contents(read_markdown("# a\n\n## b\n\n# c\n"))
    assert len(toc["c"]) == 2 and toc["c"][0][1]["t"] == "BulletList"
    assert trees.template("$if(a)$x$a$$else$y$endif$ $for(l)$[$l$]$sep$,$endfor$ $$", {"a": "1", "l": ["p", "q"]}) == "x1 [p],[q] $"
    up = trees.typed({"Str": lambda n: {"t": "Str", "c": n["c"].upper()}, "Emph": lambda n: []})(read_markdown("a *b*"))
    assert plain(up["blocks"]).strip() == "A"


def test_node_operators(spark):
    df = spark.createDataFrame([(1, "# a\n\nx[^n] [l](u)\n\n## b\n\ny\n\n# c\n\n[^n]: no"), (2, "no heading")], "doc_id long, text string")
    nodes = engine.read_nodes(df, "markdown").cache()
    s = {r["ident"]: r for r in N.sections(nodes).collect()}
    assert [s[k]["number"] for k in "abc"] == ["1", "1.1", "2"]
    assert s["a"]["last_id"] == s["c"]["first_id"] - 1 and s["b"]["parent"] == s["a"]["first_id"]
    ch = N.chunks(nodes).where("doc_id = 1").orderBy("chunk_no").collect()
    assert [r["path"] for r in ch] == ["1-a.html", "2-c.html"] and ch[0]["next_path"] == ch[1]["path"]
    assert {r["doc_id"]: r["n_words"] for r in N.word_counts(nodes).collect()} == {1: 7, 2: 2}
    assert [r["text"] for r in N.headings(nodes).orderBy("node_id").collect()] == ["a", "b", "c"]
    assert N.links(nodes).count() == 1
    assert N.shift_headers(nodes, -1).where("type = 'Header'").count() == 1


def test_bad_documents_are_rows(spark):
    df = spark.createDataFrame([(1, "{"), (2, '{"blocks": [], "meta": {}}')], "doc_id long, text string")
    got = {r["doc_id"]: r["status"] for r in engine.read_documents(df, "json").collect()}
    assert got == {1: "error", 2: "ok"}


def test_no_document_vanishes(spark):
    deep = "<h1>top</h1>" + "<div>" * 1500 + '<p><a href="u">in</a> ' + "<b>" * 1500 + "x"
    pages = spark.createDataFrame([(1, deep), (2, '<p><a href="u">y</a>')], "doc_id long, text string")
    nodes = engine.read_nodes(pages, "html")
    assert N.link_counts(nodes).collect() == [("u", 2)] and N.errors(nodes).count() == 0
    assert {r["doc_id"]: r["n_words"] for r in N.word_counts(nodes).collect()} == {1: 3, 2: 1}
    assert [r["text"] for r in N.headings(nodes).collect()] == ["top"]
    less = pages.where("doc_id = 2").unionByName(spark.createDataFrame([(3, deep.replace("<div>" * 1000, "").replace("<b>" * 1000, ""))], "doc_id long, text string"))
    for target in ("plain", "markdown", "html"):
        assert {r["doc_id"]: (r["output"] is None, r["error"]) for r in engine.convert(less, "html", target).collect()} == {2: (False, None), 3: (False, None)}
    assert {r["doc_id"]: (r["output"] is None) == (r["error"] is not None) for r in engine.convert(pages, "html", "html").collect()} == {1: True, 2: True}

    bad = spark.createDataFrame([(1, "{"), (2, '{"blocks": [], "meta": {}}')], "doc_id long, text string")
    for nodes in (engine.read_nodes(bad, "json"), engine.nodes(engine.read_documents(bad, "json"))):
        assert [r["doc_id"] for r in N.errors(nodes).where("error <> ''").collect()] == [1]
        assert {r["doc_id"]: r["n_words"] for r in N.word_counts(nodes).collect()} == {1: None, 2: 0}
        assert {r["doc_id"]: r["slide_level"] for r in N.slide_level(nodes).collect()} == {1: None, 2: 6}
    got = {r["doc_id"]: (r["output"] is None, r["error"] is None) for r in engine.convert(bad, "json", "plain").collect()}
    assert got == {1: (True, False), 2: (False, True)}


def test_text_functions(spark):
    one = spark.range(1)
    f = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert f(T.roman(lit(1994))) == "MCMXCIV" and f(T.roman(lit(0))) == "" and f(T.roman(lit(4000))) == "?"
    assert f(T.expand_tabs(lit("a\tb\n\tc"))) == "a   b\n    c\n"
    assert f(T.identifier(lit("1. Hello, World_x!"))) == "hello-world_x" and f(T.identifier(lit("12"))) == "section"
    assert f(T.collapse_path(lit("a/./b/../c"))) == "a/c" and f(T.collapse_path(lit("../x"))) == "../x"
    assert f(T.normal_date(lit("7 March 2020"))) == "2020-03-07" and f(T.normal_date(lit("x"))) is None
    assert f(T.superscript(lit("12"))) == "¹²" and f(T.superscript(lit("a"))) is None
    assert f(T.smart(lit("\"a\" -- it's..."))) == "“a” – it’s…"
    assert f(T.excise_lines(lit("a\nb\nc"), -2, None)) == "b\nc"
    assert f(T.image_type(lit(b"\x89PNG\r\n\x1a\n1234").cast("binary"))) == "png"
    assert f(T.in_inches(T.dimension(lit("2.54cm")))) == pytest.approx(1)
    assert f(T.mime_type(lit("a/b.PNG?x"))) == "image/png"


@pytest.mark.parametrize("name", sorted(P.ORACLE))
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    df = P.QUERIES[name](spark, sf)
    got = df.collect()
    want = con.execute(P.ORACLE[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(key([r[c] for c in order]) for r in got) == sorted(key(r) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(P.QUERIES) - set(P.ORACLE)))
def test_other_queries_run(spark, sf, name):
    assert P.QUERIES[name](spark, sf).count() > 0


def test_streaming(spark, tmp_path):
    from leafmill.streaming import documents as S

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.md").write_text(f"[x](u{i % 2})")
    got = []
    S.run_available(S.link_counts(S.arriving(spark, str(tmp_path / "in"), "md"), "markdown"), lambda df, _: got.append({r["url"]: r["n"] for r in df.collect()}), str(tmp_path / "cp"), "complete")
    assert got[-1] == {"u0": 2, "u1": 1}


def test_fuzz_readers():
    rng = random.Random(1)
    chars = "ab *_`[]()<>#-+|=\n\\~^$!&;:'\"{}@1."
    for name, read in READERS.items():
        if name in ("json", "ipynb", "opml", "csljson", "endnotexml", "xml", "docbook", "jats", "bits", "fb2", "tei", "native", *BINARY, "xlsx"):
            continue
        for _ in range(15):
            text = "".join(rng.choice(chars) for _ in range(rng.randrange(80)))
            assert "blocks" in read(text)


def test_unique_identifiers_take_the_first_free_number(spark):
    bases = ["b", "b-1", "b", "c", "c", "b-1", "b", "d-2", "d-2", "c", "e-1-1", "e-1", "e-1"]
    df = spark.createDataFrame([(g, i, b) for g in (1, 2) for i, b in enumerate(bases)], "g long, i long, base string")

    def named(names):
        used, out = set(), []
        for b in names:
            k, own = 0, b
            while own in used:
                k += 1
                own = f"{b}-{k}"
            used.add(own)
            out.append(own)
        return out

    got = {(r["g"], r["i"]): r["ident"] for r in N.unique_idents(df, "base", ["g"], ["i"]).collect()}
    want = named(bases)
    assert want[:3] == ["b", "b-1", "b-2"] and got == {(g, i): x for g in (1, 2) for i, x in enumerate(want)}


def test_nodes_that_are_kept_have_their_numbers(spark):
    df = spark.createDataFrame([(1, SAMPLE)], "doc_id long, text string")
    whole = {r["node_id"]: r for r in engine.read_nodes(df, "markdown").collect()}
    some = engine.read_nodes(df, "markdown", keep=("Header",)).collect()
    assert all(whole[r["node_id"]] == r for r in some) and {r["type"] for r in some} >= {"Doc", "Header", "Para", "Str"}
    assert len(some) < len(whole) and N.headings(engine.read_nodes(df, "markdown", keep=("Header",))).collect()[0]["text"] == "Hi there"


def test_extensions_of_every_reader():
    assert engine.reader("html+raw_tex")("<h1>a</h1>")["blocks"][0]["c"][1][0] == "a"
    assert engine.reader("html-auto_identifiers")("<h1>a</h1>")["blocks"][0]["c"][1][0] == ""
    assert engine.reader("html-native_divs-native_spans")("<div><p><span>a</span></p></div>")["blocks"] == engine.reader("html")("<p>a</p>")["blocks"]
    for bad in ("html+nothing", "nothing"):
        with pytest.raises(ValueError):
            engine.reader(bad)


def test_convert_many(spark):
    df = spark.createDataFrame([(1, "*a*"), (2, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["format"]): r["output"] for r in engine.convert_many(df, "markdown", ["html", "latex"]).collect()}
    assert got == {(1, "html"): "<p><em>a</em></p>\n", (1, "latex"): "\\emph{a}\n", (2, "html"): "\n", (2, "latex"): "\n"}
    bad = engine.convert_many(df, "ipynb", ["html"]).collect()
    assert all(r["output"] is None and r["error"] for r in bad if r["doc_id"] == 1)
    with pytest.raises(ValueError):
        engine.convert_many(df, "markdown", ["docx"])


def test_html_tables():
    t = read_html("<table><colgroup><col width='30%'><col width='*'></colgroup><tr><th>a</th><td>b</td></tr><tr><th>c</th><td>d</td></tr></table>")["blocks"][0]["c"]
    assert [w.get("c") for _, w in t[2]] == [0.3, 0.7] and t[4][0][1] == 1 and not t[3][1]
    t = read_html("<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>1</td></tr></tbody><tbody><tr><th>x</th></tr><tr><td>2</td></tr></tbody></table>")["blocks"][0]["c"]
    assert len(t[3][1]) == 1 and [(len(b[2]), len(b[3])) for b in t[4]] == [(0, 1), (1, 1)]


def test_literal_escapes():
    d = READERS["native"]('[Para [Str "\\8217\\1234\\&5\\"\\\\n"]]')
    assert d["blocks"][0]["c"][0]["c"] == '\u2019\u04d25"\\n'


def test_latex_quantities_and_macros():
    text = lambda s: plain(READERS["latex"](s)["blocks"])
    assert text(r"\SI{30}{\milli\meter}") == "30\u00a0mm" and text(r"\SIrange{10}{20}{\gram}") == "10\u00a0g–20\u00a0g"
    assert text("\\newcommand{\\x}[2][o]{#1#2}\n\\x{a} \\x[b]{c}").split() == ["oa", "bc"]
    d = READERS["latex"]("a ``b 'c' d'' \\footnotemark{} e\n\\footnotetext{note}")
    assert [x["t"] for x in d["blocks"][0]["c"] if x["t"] in ("Quoted", "Note")] == ["Quoted", "Note"]
