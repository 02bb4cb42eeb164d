"""Queries that write and read every text format: documents made from the table, and what they must look like in each format.

A document has a heading, the paragraphs of its text (letters, commas and spaces), a paragraph with emphasis, code and a link, and a list. FORMATS
says how each format spells these; the same spelling is what a writer must give, in SQL, and what a reader is given, in Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import engine, tree

#: Marks in a spelling and the SQL of what stands for them.
MARKS = {"id": "doc_id::varchar", "lang": "lang", "source": "source", "p": "p"}


@dataclass
class Spelling:
    """With {id}, {lang}, {source} and, in para, {p}."""

    head: str
    para: str
    mixed: str
    list: str
    sep: str = "\n\n"
    start: str = ""
    end: str = "\n"


def _marked(e: str, s: str, c: str, link: str) -> str:
    return f"Text {e} and {s} and {c} and {link}"


def _items(item: str, start: str = "", end: str = "", sep: str = "\n") -> str:
    return start + sep.join(item.replace("{x}", x) for x in ("{lang}", "{source}")) + end


_MD = Spelling("# Doc {id}", "{p}", _marked("*{lang}*", "**{source}**", "`code{id}`", "[link](http://example.com/{id})"), _items("- {x}"))


def _bbcode(head: str) -> Spelling:
    return Spelling(head, "{p}", _marked("[i]{lang}[/i]", "[b]{source}[/b]", "[code]code{id}[/code]", "[url=http://example.com/{id}]link[/url]"), _items("[*]{x}", "[list]\n", "\n[/list]"))


def _docbook(ident: str, link: str) -> Spelling:
    return Spelling(
        "  <title>Doc {id}</title>", "  <para>\n    {p}\n  </para>",
        "  <para>\n    " + _marked("<emphasis>{lang}</emphasis>", '<emphasis role="strong">{source}</emphasis>', "<literal>code{id}</literal>", link) + "\n  </para>",
        _items("    <listitem>\n      <para>\n        {x}\n      </para>\n    </listitem>", '  <itemizedlist spacing="compact">\n', "\n  </itemizedlist>"),
        "\n", f'<section {ident}="doc-{{id}}">\n', "\n</section>\n",
    )


_JATS = Spelling(
    "  <title>Doc {id}</title>", "  <p>{p}</p>",
    "  <p>" + _marked("<italic>{lang}</italic>", "<bold>{source}</bold>", "<monospace>code{id}</monospace>", '<ext-link xlink:href="http://example.com/{id}">link</ext-link>') + "</p>",
    _items("    <list-item>\n      <p>{x}</p>\n    </list-item>", '  <list list-type="bullet">\n', "\n  </list>"), "\n", '<sec id="doc-{id}">\n', "\n</sec>\n",
)
_HTML = Spelling(
    '<h1 id="doc-{id}">Doc {id}</h1>', "<p>{p}</p>", "<p>" + _marked("<em>{lang}</em>", "<strong>{source}</strong>", "<code>code{id}</code>", '<a href="http://example.com/{id}">link</a>') + "</p>",
    _items("<li>{x}</li>", "<ul>\n", "\n</ul>"), "\n",
)


def _slide(start: str, end: str) -> Spelling:
    return Spelling("<h1>Doc {id}</h1>", _HTML.para, _HTML.mixed, _HTML.list, "\n", start, end + "\n")


_ADOC = Spelling("== Doc {id}", "{p}", _marked("_{lang}_", "*{source}*", "`code{id}`", "http://example.com/{id}[link]"), _items("* {x}"))
_LATEX = Spelling(
    "\\section{Doc {id}}\\label{doc-{id}}", "{p}", _marked("\\emph{{lang}}", "\\textbf{{source}}", "\\texttt{code{id}}", "\\href{http://example.com/{id}}{link}"),
    _items("\\item\n  {x}", "\\begin{itemize}\n\\tightlist\n", "\n\\end{itemize}"),
)

WRITTEN: dict[str, dict[str, Spelling]] = {
    "markdown": {k: _MD for k in ("markdown", "commonmark", "commonmark_x", "gfm", "markdown_github", "markdown_strict", "markdown_phpextra", "markdown_mmd")}
    | {"markua": Spelling("{id: doc-{id}}\n# Doc {id}", "{p}", _MD.mixed, _items("* {x}")), "djot": Spelling(_MD.head, "{p}", _marked("_{lang}_", "*{source}*", "`code{id}`", "[link](http://example.com/{id})"), _MD.list)},
    "wiki": {
        "mediawiki": Spelling("= Doc {id} =", "{p}", _marked("''{lang}''", "'''{source}'''", "<code>code{id}</code>", "[http://example.com/{id} link]"), _items("* {x}")),
        "dokuwiki": Spelling("====== Doc {id} ======", "{p}", _marked("//{lang}//", "**{source}**", "''%%code{id}%%''", "[[http://example.com/{id}|link]]"), _items("  * {x}")),
        "zimwiki": Spelling("====== Doc {id} ======", "{p}", _marked("//{lang}//", "**{source}**", "''code{id}''", "[[http://example.com/{id}|link]]"), _items("* {x}")),
        "xwiki": Spelling('= Doc {id} {{id name="doc-{id}" /}}=', "{p}", _marked("//{lang}//", "**{source}**", "##code{id}##", "[[link>>http://example.com/{id}]]"), _items("* {x}")),
        "jira": Spelling("h1. {anchor:doc-{id}}Doc {id}", "{p}", _marked("_{lang}_", "*{source}*", "{{code{id}}}", "[link|http://example.com/{id}]"), _items("* {x}")),
        "textile": Spelling("h1(#doc-{id}). Doc {id}", "{p}", _marked("_{lang}_", "*{source}*", "@code{id}@", '"link":http://example.com/{id}'), _items("* {x}")),
    },
    "light": {
        "plain": Spelling("Doc {id}", "{p}", _marked("_{lang}_", "{source}", "code{id}", "link"), _items("- {x}")),
        "org": Spelling("* Doc {id}\n:PROPERTIES:\n:CUSTOM_ID: doc-{id}\n:END:", "{p}", _marked("/{lang}/", "*{source}*", "=code{id}=", "[[http://example.com/{id}][link]]"), _items("- {x}")),
        "asciidoc": _ADOC, "asciidoctor": _ADOC, "asciidoc_legacy": _ADOC,
        "muse": Spelling("* Doc {id}", "{p}", _marked("*{lang}*", "**{source}**", "<code>code{id}</code>", "[[http://example.com/{id}][link]]"), _items(" - {x}")),
        "t2t": Spelling("= Doc {id} =", "{p}", _marked("//{lang}//", "**{source}**", "``code{id}``", "[link http://example.com/{id}]"), _items("- {x}")),
        "haddock": Spelling("= Doc {id}\n#doc-{id}#", "{p}", _marked("/{lang}/", "__{source}__", "@code{id}@", "<http://example.com/{id} link>"), _items("-   {x}")),
        "typst": Spelling("= Doc {id}\n<doc-{id}>", "{p}", _marked("#emph[{lang}]", "#strong[{source}]", "`code{id}`", '#link("http://example.com/{id}")[link]'), _items("- {x}")),
    },
    "bbcode": {"bbcode": _bbcode("[u][b]Doc {id}[/b][/u]"), "bbcode_phpbb": _bbcode("[u][b]Doc {id}[/b][/u]"), "bbcode_steam": _bbcode("[h1]Doc {id}[/h1]"), "bbcode_fluxbb": _bbcode("[h]Doc {id}[/h]"), "bbcode_hubzilla": _bbcode("[h1]Doc {id}[/h1]"), "bbcode_xenforo": _bbcode("[HEADING=1]Doc {id}[/HEADING]")},
    "xml": {
        "docbook": _docbook("xml:id", '<link xlink:href="http://example.com/{id}">link</link>'), "docbook5": _docbook("xml:id", '<link xlink:href="http://example.com/{id}">link</link>'), "docbook4": _docbook("id", '<ulink url="http://example.com/{id}">link</ulink>'),
        "jats": _JATS, "jats_archiving": _JATS, "jats_publishing": _JATS, "jats_articleauthoring": _JATS,
        "tei": Spelling(
            "  <head>Doc {id}</head>", "  <p>{p}</p>", "  <p>" + _marked('<hi rendition="simple:italic">{lang}</hi>', '<hi rendition="simple:bold">{source}</hi>', '<seg type="code">code{id}</seg>', '<ref target="http://example.com/{id}">link</ref>') + "</p>",
            _items("    <item>\n      <p>{x}</p>\n    </item>", '  <list type="unordered">\n', "\n  </list>"), "\n", '<div type="level1" xml:id="doc-{id}">\n', "\n</div>\n"),
        "html": _HTML, "html4": _HTML, "html5": _HTML,
    },
    "slides": {
        "revealjs": _slide('<div class="reveal"><div class="slides">\n<section>\n', "\n</section>\n</div></div>"), "dzslides": _slide("<section>\n", "\n</section>"),
        **{k: _slide('<div class="slide">\n', "\n</div>") for k in ("s5", "slidy", "slideous")},
    },
    "tex": {
        "latex": _LATEX,
        "beamer": Spelling("\\begin{frame}{Doc {id}}\n{first}", "{p}", _LATEX.mixed, _LATEX.list, end="\n\\end{frame}\n"),
        "context": Spelling("\\startsectionlevel[title={Doc {id}},reference={doc-{id}}]", "{p}", _marked("{\\em {lang}}", "{\\bf {source}}", "\\type{code{id}}", "\\goto{link}[url(http://example.com/{id})]"), _items("\\item\n  {x}", "\\startitemize[packed]\n", "\n\\stopitemize"), end="\n\n\\stopsectionlevel\n"),
    },
}

_READ_ONLY = {
    "creole": Spelling("= Doc {id}", "{p}", _marked("//{lang}//", "**{source}**", "{{{code{id}}}}", "[[http://example.com/{id}|link]]"), _items("* {x}")),
    "twiki": Spelling("---+ Doc {id}", "{p}", _marked("_{lang}_", "*{source}*", "=code{id}=", "[[http://example.com/{id}][link]]"), _items("   * {x}")),
    "tikiwiki": Spelling("!Doc {id}", "{p}", _marked("''{lang}''", "__{source}__", "-+code{id}+-", "[http://example.com/{id}|link]"), _items("*{x}")),
    "vimwiki": Spelling("= Doc {id} =", "{p}", _marked("_{lang}_", "*{source}*", "`code{id}`", "[[http://example.com/{id}|link]]"), _items("* {x}")),
    "rst": Spelling("Doc {id}\n===========", "{p}", _marked("*{lang}*", "**{source}**", "``code{id}``", "`link <http://example.com/{id}>`__"), _items("- {x}")),
    "fb2": Spelling(
        "<title><p>Doc {id}</p></title>", "<p>{p}</p>", "<p>" + _marked("<emphasis>{lang}</emphasis>", "<strong>{source}</strong>", "<code>code{id}</code>", '<a l:href="http://example.com/{id}">link</a>') + "</p>", _items("<p>{x}</p>"), "\n",
        '<?xml version="1.0" encoding="UTF-8"?>\n<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><body><section>\n', "\n</section></body></FictionBook>\n"),
    "man": Spelling(".SH Doc {id}", ".PP\n{p}", ".PP\n" + _marked("\\f[I]{lang}\\f[R]", "\\f[B]{source}\\f[R]", "\\f[CR]code{id}\\f[R]", "link"), _items(".IP \\(bu 2\n{x}"), "\n"),
}

READ: dict[str, dict[str, Spelling]] = {
    "markdown": {k: _MD for k in ("markdown", "commonmark", "commonmark_x", "gfm", "markdown_github", "markdown_strict", "markdown_phpextra", "markdown_mmd")} | {"djot": WRITTEN["markdown"]["djot"]},
    "wiki": {k: WRITTEN["wiki"][k] for k in ("mediawiki", "dokuwiki", "textile")} | {"jira": Spelling("h1. Doc {id}", "{p}", WRITTEN["wiki"]["jira"].mixed, WRITTEN["wiki"]["jira"].list)} | {k: _READ_ONLY[k] for k in ("creole", "twiki", "tikiwiki", "vimwiki")},
    "light": {"org": WRITTEN["light"]["org"], "asciidoc": _ADOC, "muse": WRITTEN["light"]["muse"], "t2t": WRITTEN["light"]["t2t"], "rst": _READ_ONLY["rst"], "typst": WRITTEN["light"]["typst"]},
    "xml": {"docbook": _docbook("id", '<ulink url="http://example.com/{id}">link</ulink>'), "jats": _JATS, "tei": WRITTEN["xml"]["tei"], "html": _HTML, "fb2": _READ_ONLY["fb2"]},
    "tex": {"latex": _LATEX, "man": _READ_ONLY["man"]},
}
#: What some formats can't say.
LACKS = {"fb2": {"items"}, "man": {"url"}}
#: Formats that are written and read again.
ROUND = ("json", "native", "xml", "ipynb", "docx", "odt", "epub")

_PARA = r"[^\p{L} ,]"


def _split(spelling: str) -> list[str]:
    return re.split(r"\{(id|lang|source|p)\}", spelling)


def _sql_text(spelling: str) -> str:
    """A spelling as a SQL expression."""
    parts = [f"'{x.replace(chr(39), chr(39) * 2)}'" if k % 2 == 0 else MARKS[x] for k, x in enumerate(_split(spelling)) if k % 2 or x]
    return "(" + " || ".join(parts) + ")" if parts else "''"


def _spark_text(spelling: str, p: Column | None = None) -> Column:
    of = {"id": F.col("doc_id").cast("string"), "lang": F.col("lang"), "source": F.col("source"), "p": p}
    parts = [F.lit(x) if k % 2 == 0 else of[x] for k, x in enumerate(_split(spelling)) if k % 2 or x]
    return F.concat(*parts) if parts else F.lit("")


def _paragraphs_sql() -> str:
    return rf"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '{_PARA}', '', 'g'), ' +', ' ', 'g'))), lambda x: x <> '')"


def documents(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """doc_id, lang, source, ps: the paragraphs of each whole text, without signs that a format could take for its own. With dealt, spread over the cores as they are stored, once for all formats."""
    line = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, _PARA, ""), " +", " "))
    ps = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), lambda x: x != "")
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", "text")
    return (engine.spread(rows) if dealt else rows).select("doc_id", "lang", "source", ps.alias("ps"))


def _spelling(s: Spelling) -> Column:
    blocks = F.concat(F.array(_spark_text(s.head)), F.transform("ps", lambda p: _spark_text(s.para, p)), F.array(_spark_text(s.mixed), _spark_text(s.list)))
    return F.concat(_spark_text(s.start), F.array_join(blocks, s.sep), _spark_text(s.end))


def spelled(docs: DataFrame, s: Spelling) -> DataFrame:
    """doc_id, text: documents in a format."""
    return docs.select("doc_id", _spelling(s).alias("text"))


def spelled_each(docs: DataFrame, spellings: dict[str, Spelling]) -> DataFrame:
    """format, doc_id, text: documents in each of the formats, one text at a time, from paragraphs that are made once."""
    rows = docs.select("*", F.explode(F.array(*[F.lit(k) for k in spellings])).alias("format"))
    text = F.lit(None).cast("string")
    for name, s in spellings.items():
        text = F.when(F.col("format") == name, _spelling(s)).otherwise(text)
    return rows.select("format", "doc_id", text.alias("text"))


def spelled_sql(name: str, s: Spelling) -> str:
    """What a writer must give."""
    if "{first}" in s.head:  # the heading holds what follows
        head = _sql_text(s.head.replace("{first}", ""))
        whole = f"{head} || array_to_string(list_concat(list_transform(ps, lambda p: {_sql_text(s.para)}), [{_sql_text(s.mixed)}, {_sql_text(s.list)}]), '{s.sep}')"
    else:
        whole = f"array_to_string(list_concat([{_sql_text(s.head)}], list_transform(ps, lambda p: {_sql_text(s.para)}), [{_sql_text(s.mixed)}, {_sql_text(s.list)}]), '{s.sep}')"
    return f"select '{name}' as format, doc_id, {_sql_text(s.start)} || {whole} || {_sql_text(s.end)} as output from d"


def written(family: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return engine.convert_many(spelled(documents(spark, d), _MD), "markdown", list(WRITTEN[family])).select("format", "doc_id", "output")

    return run


def written_sql(family: str) -> str:
    every = " union all ".join(spelled_sql(k, s) for k, s in WRITTEN[family].items())
    return f"with d as (select doc_id, lang, source, {_paragraphs_sql()} as ps from documents) {every}"


TOLD = "words string, n_headings bigint, level int, n_emph bigint, n_strong bigint, n_code bigint, n_items bigint, url string"


def told(doc: dict) -> tuple:
    """TOLD of a tree: its words and code in order, headings and their deepest level, emphasis, code, list items and the greatest address."""
    words: list[str] = []
    levels: list[int] = []
    urls: list[str] = []
    n = {"Emph": 0, "Strong": 0, "Code": 0, "item": 0}

    def visit(xs: list[dict]) -> None:
        for x in xs:
            t = x["t"]
            if t == "Str" or t == "Run":
                words.append(x["c"])
            elif t == "Para" or t == "Plain":
                visit(x["c"])
            elif t != "Space" and t not in tree.LEAVES:
                if t == "Code":
                    words.append(x["c"][1])
                elif t == "Header":
                    levels.append(x["c"][0])
                elif t in ("Link", "Image"):
                    urls.append(x["c"][2][0])
                if t in n:
                    n[t] += 1
                for role, ys in tree.parts(x):
                    n["item"] += role == "item"
                    visit(ys)

    visit(doc["blocks"])
    return " ".join(words), len(levels), max(levels, default=None), n["Emph"], n["Strong"], n["Code"], n["item"], max(urls, default=None)


def told_sql(names: list[str]) -> str:
    rows = " union all ".join(
        f"""select '{k}' as format, doc_id, 'Doc ' || doc_id || ' ' || case when len(ps) > 0 then array_to_string(ps, ' ') || ' ' else '' end || 'Text ' || lang || ' and ' || source || ' and code' || doc_id || ' and link ' || lang || ' ' || source as words,
  1::bigint as n_headings, 1::int as level, 1::bigint as n_emph, 1::bigint as n_strong, 1::bigint as n_code, {0 if "items" in LACKS.get(k, ()) else 2}::bigint as n_items, {"null" if "url" in LACKS.get(k, ()) else "'http://example.com/' || doc_id"} as url from d"""
        for k in names
    )
    return f"with d as (select doc_id, lang, source, {_paragraphs_sql()} as ps from documents) {rows}"


def referenced(docs: DataFrame) -> DataFrame:
    """documents for XML and HTML: the signs of lang and source that would be markup are references."""
    of = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return docs.withColumns({k: of(F.col(k)) for k in ("lang", "source")})


def read_each(spark: SparkSession, d: str, family: str) -> DataFrame:
    """format, doc_id, TOLD, error: each document in each format of a family; one that can't be read has null in place of TOLD, and what was wrong."""
    docs = documents(spark, d, dealt=True)
    return engine.read_values(spelled_each(referenced(docs) if family == "xml" else docs, READ[family]), list(READ[family]), told, TOLD)


def read(family: str):
    """The columns that the SQL has: n_headings is null only where a document couldn't be read, and read_each says why."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return read_each(spark, d, family).drop("error")

    return run


def round_trips_each(spark: SparkSession, d: str) -> DataFrame:
    """As read_each."""
    return engine.reread_values(spelled(documents(spark, d, dealt=True), _MD), "markdown", list(ROUND), told, TOLD)


def round_trips(spark: SparkSession, d: str) -> DataFrame:
    return round_trips_each(spark, d).drop("error")


def queries() -> dict:
    return {f"write_{k}": written(k) for k in WRITTEN} | {f"read_{k}": read(k) for k in READ} | {"round_trips": round_trips}


def oracle_sql() -> dict[str, str]:
    return {f"write_{k}": written_sql(k) for k in WRITTEN} | {f"read_{k}": told_sql(list(READ[k])) for k in READ} | {"round_trips": told_sql(list(ROUND))}
