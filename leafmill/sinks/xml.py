"""Trees to XML vocabularies: one renderer, and for each vocabulary a table of elements."""

from __future__ import annotations

from dataclasses import dataclass, field
from xml.sax.saxutils import escape as _escape

from leafmill.tree import QUOTES, cells, meta_text, plain


def esc(s: str) -> str:
    return _escape("".join(ch for ch in s if ch in "\t\n\r" or ch >= " "))


def q(s: str) -> str:
    return esc(s).replace('"', "&quot;")


def tag(name: str, body: str, **attrs: str) -> str:
    """An element; name may hold attributes."""
    a = "".join(f' {k.rstrip("_").replace("__", ":")}="{q(v)}"' for k, v in attrs.items() if v)
    return f"<{name}{a}>{body}</{name.split(' ')[0]}>"


@dataclass
class Vocabulary:
    """Element names; a name may carry attributes, None leaves the content bare."""

    names: dict[str, str | None] = field(default_factory=dict)
    section: str | None = None  # headings become nested elements of this name with a title
    section_title: str = "title"
    link: tuple[str, str] = ("link", "href")
    image: tuple[str, str] = ("img", "src")
    ident: str = "id"
    wrap: tuple[str, str] = ("", "")
    line_break: str = "<br/>"
    item: str = "li"
    title: str = ""  # wraps the document's title
    quote: bool = True
    table: dict[str, str] = field(default_factory=lambda: {"table": "table", "head": "thead", "body": "tbody", "row": "tr", "th": "th", "td": "td", "caption": "caption"})
    raw: tuple[str, ...] = ()
    item_wrap: str | None = None  # what holds an item's text
    layout: str = ""  # "lines": block elements on lines of their own, their content indented; "text": paragraphs' text on lines of its own, too
    tight: str = ""  # an attribute of lists whose items are Plain
    levels: bool = False  # sections say their level
    compact: tuple[str, ...] = ()  # lists that take `tight`


class Renderer:
    def __init__(self, v: Vocabulary) -> None:
        self.v = v

    def named(self, key: str, body: str, **attrs: str) -> str:
        name = self.v.names.get(key, None)
        return tag(name, body, **attrs) if name else body

    def inlines(self, xs: list[dict]) -> str:
        return "".join(map(self.inline, xs))

    def inline(self, n: dict) -> str:
        t, c, v = n["t"], n.get("c"), self.v
        if t == "Str":
            return esc(c)
        if t == "Run":  # letters, spaces and commas
            return c
        if t in ("Space", "SoftBreak"):
            return " " if t == "Space" else "\n"
        if t == "LineBreak":
            return v.line_break
        if t == "Quoted":
            a, b = QUOTES[c[0]["t"]]
            return a + self.inlines(c[1]) + b
        if t == "Code":
            return self.named("Code", esc(c[1]))
        if t == "Math":
            return self.named("Math", esc(c[1]))
        if t == "RawInline":
            return c[1] if c[0] in v.raw else ""
        if t == "Link":
            return tag(v.link[0], self.inlines(c[1]), **{v.link[1]: c[2][0]})
        if t == "Image":
            return f'<{v.image[0]} {v.image[1].replace("__", ":")}="{q(c[2][0])}"/>'
        if t == "Note":
            return self.named("Note", self.blocks(c))
        if t in ("Span", "Cite"):
            return self.inlines(c[1])
        return self.named(t, self.inlines(c))

    def blocks(self, xs: list[dict]) -> str:
        if not self.v.section:
            return "\n".join(y for y in map(self.block, xs) if y)
        out, i = [], 0
        while i < len(xs):
            if xs[i]["t"] != "Header":
                out.append(self.block(xs[i]))
                i += 1
                continue
            level, j = xs[i]["c"][0], i + 1
            while j < len(xs) and not (xs[j]["t"] == "Header" and xs[j]["c"][0] <= level):
                j += 1
            title = tag(self.v.section_title, self.inlines(xs[i]["c"][2]))
            inner = "\n".join(x for x in (title, self.blocks(xs[i + 1 : j])) if x)
            attrs = {"type": f"level{level}"} if self.v.levels else {}
            out.append(self.around(self.v.section, inner, **attrs, **{self.v.ident: xs[i]["c"][1][0]}))
            i = j
        return "\n".join(y for y in out if y)

    def around(self, name: str, body: str, **attrs: str) -> str:
        """An element that holds others: on lines of their own and indented, if the vocabulary is laid out so. Lines that begin with a null are kept as they are."""
        if not self.v.layout:
            return tag(name, f"\n{body}\n", **attrs)
        inner = "\n".join(line if line.startswith("\0") or not line else "  " + line for line in body.split("\n"))
        return tag(name, f"\n{inner}\n" if body else "", **attrs)

    def item(self, body: list[dict]) -> str:
        return self.around(self.v.item, self.blocks(body)) if self.v.layout else tag(self.v.item, self.blocks(body))

    def laid(self, n: dict) -> str | None:
        """Blocks that have a layout of their own."""
        t, c, v = n["t"], n.get("c"), self.v
        if t in ("Plain", "Para"):
            return self.around(v.names[t], self.inlines(c)) if v.layout == "text" else None
        if t == "CodeBlock":
            lang = c[0][1][0] if c[0][1] else ""
            code = esc(c[1]).split("\n")
            if v.layout == "text":
                return "\n".join([f'<{v.names[t]}{f" language={chr(34)}{q(lang)}{chr(34)}" if lang else ""}>', *["\0" + x for x in code], f"\0</{v.names[t].split()[0]}>"])
            return "\n".join([f"<{v.names[t]}>" + code[0], *["\0" + x for x in code[1:]]]) + f"</{v.names[t].split()[0]}>"
        if t in ("BulletList", "OrderedList"):
            items = c if t == "BulletList" else c[1]
            name = v.names[t]
            if t == "OrderedList":
                name += self.numbering(c[0])
            if v.tight and t in v.compact and all(b["t"] != "Para" for x in items for b in x[:1]):
                name += v.tight
            return self.around(name, "\n".join(map(self.item, items)))
        if t == "BlockQuote":
            return self.around(v.names[t], self.blocks(c))
        if t == "DefinitionList":
            tight = v.tight if t in v.compact and all(b["t"] != "Para" for _, defs in c for d in defs for b in d[:1]) else ""
            entries = []
            for term, defs in c:
                head = self.around(v.names["Term"], self.inlines(term)) if v.layout == "text" else tag(v.names["Term"], self.inlines(term))
                body = "\n".join([head, *[self.around(v.names["Definition"], self.blocks(d)) for d in defs]])
                entries.append(self.around(v.names["Entry"], body) if v.names.get("Entry") else body)
            return self.around(v.names[t] + tight, "\n".join(entries))
        return None

    def numbering(self, a: list) -> str:
        """Attributes of an ordered list's numbers."""
        return ""

    def block(self, n: dict) -> str:
        t, c, v = n["t"], n.get("c"), self.v
        if v.layout and (laid := self.laid(n)) is not None:
            return laid
        if t == "Plain":
            return self.named("Plain", self.inlines(c))
        if t == "Para":
            return self.named("Para", self.inlines(c))
        if t == "Header":
            return self.named(f"Header{c[0]}" if f"Header{c[0]}" in v.names else "Header", self.inlines(c[2]), **{v.ident: c[1][0]})
        if t == "CodeBlock":
            return self.named("CodeBlock", esc(c[1]))
        if t == "RawBlock":
            return c[1] if c[0] in v.raw else ""
        if t == "HorizontalRule":
            return v.names.get("Rule") or ""
        if t == "Div":
            return self.named("Div", self.blocks(c[1]), **{v.ident: c[0][0]})
        if t == "Figure":
            return self.named("Figure", self.blocks(c[2]) + (self.named("FigureCaption", self.blocks(c[1][1])) if c[1][1] else ""))
        if t == "LineBlock":
            return self.named("LineBlock", v.line_break.join(map(self.inlines, c)))
        if t in ("BulletList", "OrderedList"):
            return self.named(t, "\n" + "\n".join(map(self.item, c if t == "BulletList" else c[1])) + "\n")
        if t == "DefinitionList":
            return self.named("DefinitionList", "".join(self.named("Entry", self.named("Term", self.inlines(term)) + "".join(self.named("Definition", self.blocks(d)) for d in defs)) for term, defs in c))
        if t == "Table":
            return self.tabular(n)
        return self.named(t, self.blocks(c))

    def tabular(self, n: dict) -> str:
        e, rows = self.v.table, {}
        for part, row, cell in cells(n):
            spans = {k: str(x) for k, x in (("rowspan", cell[2]), ("colspan", cell[3])) if x > 1}
            rows.setdefault((part == "head", row), []).append(tag(e["th"] if part == "head" else e["td"], self.blocks(cell[4]), **spans))
        line = lambda r: tag(e["row"], "".join(r))
        head, body = [line(r) for (h, _), r in rows.items() if h], [line(r) for (h, _), r in rows.items() if not h]
        caption = tag(e["caption"], self.blocks(n["c"][1][1])) if n["c"][1][1] and e["caption"] else ""
        parts = caption + (tag(e["head"], "\n".join(head)) if head and e["head"] else "\n".join(head)) + (tag(e["body"], "\n".join(body)) if e["body"] else "\n".join(body))
        return tag(e["table"], parts)

    def document(self, doc: dict) -> str:
        title = meta_text(doc["meta"].get("title"))
        a, b = self.v.wrap
        return a.replace("{title}", esc(title)) + self.blocks(doc["blocks"]).replace("\0", "") + b + "\n"


_inline = {"Emph": "emphasis", "Strong": "emphasis role=\"strong\"", "Strikeout": "emphasis role=\"strikethrough\"", "Underline": "emphasis role=\"underline\"", "Superscript": "superscript", "Subscript": "subscript", "Code": "literal", "Note": "footnote", "Quoted": "quote"}
_db = Vocabulary(names=_inline | {"Para": "para", "Plain": "para", "BlockQuote": "blockquote", "CodeBlock": "programlisting", "BulletList": "itemizedlist", "OrderedList": "orderedlist", "DefinitionList": "variablelist", "Entry": "varlistentry", "Term": "term", "Definition": "listitem", "LineBlock": "literallayout", "Figure": "figure", "Math": "literal"}, section="section", layout="text", tight=' spacing="compact"', compact=("BulletList", "OrderedList", "DefinitionList"), link=("link", "xlink__href"), image=("imagedata", "fileref"), ident="xml__id", item="listitem", line_break="\n", raw=("docbook",), table={"table": "informaltable", "head": "thead", "body": "tbody", "row": "row", "th": "entry", "td": "entry", "caption": ""})
_db4 = Vocabulary(**(_db.__dict__ | {"link": ("ulink", "url"), "ident": "id"}))
_jats = Vocabulary(names={"Emph": "italic", "Strong": "bold", "Strikeout": "strike", "Underline": "underline", "SmallCaps": "sc", "Superscript": "sup", "Subscript": "sub", "Code": "monospace", "Note": "fn", "Para": "p", "Plain": "p", "BlockQuote": "disp-quote", "CodeBlock": "preformat", "BulletList": 'list list-type="bullet"', "OrderedList": 'list list-type="order"', "DefinitionList": "def-list", "Entry": "def-item", "Term": "term", "Definition": "def", "LineBlock": "verse-group", "Figure": "fig", "FigureCaption": "caption", "Math": "tex-math", "Div": "boxed-text"}, section="sec", layout="lines", link=("ext-link", "xlink__href"), image=("inline-graphic", "xlink__href"), item="list-item", raw=("jats",))
_tei = Vocabulary(names={"Emph": 'hi rendition="simple:italic"', "Strong": 'hi rendition="simple:bold"', "Strikeout": 'hi rendition="simple:strikethrough"', "Superscript": 'hi rendition="simple:superscript"', "Subscript": 'hi rendition="simple:subscript"', "SmallCaps": 'hi rendition="simple:smallcaps"', "Code": "seg type=\"code\"", "Note": "note", "Para": "p", "Plain": "p", "BlockQuote": "quote", "CodeBlock": "ab type=\"codeblock\"", "BulletList": 'list type="unordered"', "OrderedList": 'list type="ordered"', "DefinitionList": 'list type="gloss"', "Term": "label", "Definition": "item", "LineBlock": "l", "Figure": "figure", "FigureCaption": "figDesc", "Math": "formula", "Rule": "<milestone unit=\"undefined\" type=\"separator\" rendition=\"line\"/>"}, section="div", layout="lines", levels=True, section_title="head", link=("ref", "target"), image=("graphic", "url"), ident="xml__id", item="item", line_break="<lb/>", raw=("tei",), table={"table": "table", "head": "", "body": "", "row": "row", "th": "cell role=\"label\"", "td": "cell", "caption": "head"})
_fb2 = Vocabulary(names={"Emph": "emphasis", "Strong": "strong", "Strikeout": "strikethrough", "Superscript": "sup", "Subscript": "sub", "Code": "code", "Para": "p", "Plain": "p", "BlockQuote": "cite", "CodeBlock": "p", "Term": "p", "Definition": "cite", "Math": "code", "Rule": "<empty-line/>"}, section="section", section_title="title", link=("a", "l__href"), image=("image", "l__href"), item="p", line_break="<empty-line/>", wrap=('<?xml version="1.0" encoding="UTF-8"?>\n<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><book-title>{title}</book-title></title-info></description><body>\n', "\n</body></FictionBook>"), table={"table": "table", "head": "", "body": "", "row": "tr", "th": "th", "td": "td", "caption": ""})
_odf = Vocabulary(names={"Emph": 'text:span text:style-name="Emphasis"', "Strong": 'text:span text:style-name="Strong_20_Emphasis"', "Strikeout": 'text:span text:style-name="Strikeout"', "Underline": 'text:span text:style-name="Underline"', "Superscript": 'text:span text:style-name="Superscript"', "Subscript": 'text:span text:style-name="Subscript"', "Code": 'text:span text:style-name="Source_20_Text"', "Para": 'text:p text:style-name="Text_20_body"', "Plain": "text:p", "CodeBlock": 'text:p text:style-name="Preformatted_20_Text"', "BulletList": 'text:list text:style-name="List_20_1"', "OrderedList": 'text:list text:style-name="L1"', "Term": 'text:p text:style-name="Definition_20_Term"', "Rule": '<text:p text:style-name="Horizontal_20_Line"/>', **{f"Header{i}": f'text:h text:style-name="Heading_20_{i}" text:outline-level="{i}"' for i in range(1, 7)}}, link=("text:a", "xlink__href"), image=("draw:image", "xlink__href"), ident="xml__id", item="text:list-item", line_break="<text:line-break/>", table={"table": "table:table", "head": "table:table-header-rows", "body": "", "row": "table:table-row", "th": "table:table-cell", "td": "table:table-cell", "caption": ""})
_icml = Vocabulary(names={k: f'CharacterStyleRange AppliedCharacterStyle="CharacterStyle/{v}"' for k, v in (("Emph", "Italic"), ("Strong", "Bold"), ("Strikeout", "Strikeout"), ("Underline", "Underline"), ("Superscript", "Superscript"), ("Subscript", "Subscript"), ("Code", "Code"))} | {k: f'ParagraphStyleRange AppliedParagraphStyle="ParagraphStyle/{v}"' for k, v in (("Para", "Paragraph"), ("Plain", "Paragraph"), ("CodeBlock", "CodeBlock"), ("BlockQuote", "Blockquote"), *((f"Header{i}", f"Header{i}") for i in range(1, 7)))}, link=("HyperlinkTextSource", "Name"), image=("Link", "LinkResourceURI"), ident="Self", item="Content", line_break="<Br/>", wrap=('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Document><Story>', "</Story></Document>"))

VOCABULARIES = {"docbook": _db, "docbook5": _db, "docbook4": _db4, "jats": _jats, "jats_archiving": _jats, "jats_publishing": _jats, "jats_articleauthoring": _jats, "tei": _tei, "fb2": _fb2, "opendocument": _odf, "icml": _icml}


#: What a list's numbers are called.
_DOCBOOK_NUMBERS = {"Decimal": "arabic", "Example": "arabic", "UpperAlpha": "upperalpha", "LowerAlpha": "loweralpha", "UpperRoman": "upperroman", "LowerRoman": "lowerroman"}
_JATS_NUMBERS = {"Decimal": "order", "DefaultStyle": "order", "Example": "order", "UpperAlpha": "alpha-upper", "LowerAlpha": "alpha-lower", "UpperRoman": "roman-upper", "LowerRoman": "roman-lower"}


class Docbook(Renderer):
    def numbering(self, a: list) -> str:
        style = _DOCBOOK_NUMBERS.get(a[1]["t"])
        return (f' numeration="{style}"' if style else "") + (f' startingnumber="{a[0]}"' if a[0] != 1 else "")


class Tei(Renderer):
    def numbering(self, a: list) -> str:
        return f' n="{a[0]}"' if a[0] != 1 else ""


class Jats(Renderer):
    def laid(self, n: dict) -> str | None:
        if n["t"] != "OrderedList":
            return super().laid(n)
        (start, style, _), items = n["c"]
        return self.around(f'list list-type="{_JATS_NUMBERS[style["t"]]}"', "\n".join(map(self.item, items)))


_RENDERERS = {"docbook": Docbook, "docbook5": Docbook, "docbook4": Docbook, "tei": Tei, **{k: Jats for k in VOCABULARIES if k.startswith("jats")}}


def render(doc: dict, name: str) -> str:
    return _RENDERERS.get(name, Renderer)(VOCABULARIES[name]).document(doc)


# --- HTML -------------------------------------------------------------------------------------------------------------

#: HTML elements of inlines and blocks.
_HTML = Vocabulary(
    names={"Emph": "em", "Strong": "strong", "Underline": "u", "Strikeout": "del", "Superscript": "sup", "Subscript": "sub", "Para": "p", "BlockQuote": "blockquote", "BulletList": "ul", "OrderedList": "ol", "DefinitionList": "dl", "Term": "dt", "Definition": "dd", "Rule": "<hr />", "Figure": "figure", "FigureCaption": "figcaption"},
    raw=("html", "html4", "html5"), line_break="<br />\n",
)
_LIST_TYPES = {"Decimal": "1", "LowerAlpha": "a", "UpperAlpha": "A", "LowerRoman": "i", "UpperRoman": "I"}
_ALIGNS = {"AlignLeft": "left", "AlignRight": "right", "AlignCenter": "center"}


def attributes(a: list, html5: bool = True) -> str:
    out = (f' id="{q(a[0])}"' if a[0] else "") + (f' class="{q(" ".join(a[1]))}"' if a[1] else "")
    known = ("title", "style", "width", "height", "lang", "dir", "alt", "src", "href", "rel", "target", "role", "start", "type", "name", "value", "colspan", "rowspan")
    seen: set[str] = set()
    for k, v in a[2]:
        name = k if k in known or k.startswith(("data-", "aria-")) or ":" in k or not html5 else f"data-{k}"
        if name not in seen:
            seen.add(name)
            out += f' {name}="{q(v)}"'
    return out


class Html(Renderer):
    """HTML with notes at the end, and identifiers, classes and keys kept."""

    def __init__(self, html5: bool = True, sections: bool = False) -> None:
        super().__init__(_HTML)
        self.html5, self.sections, self.notes = html5, sections, []

    def inline(self, n: dict) -> str:
        t, c = n["t"], n.get("c")
        if t == "Code":
            return f"<code{attributes(c[0])}>{esc(c[1])}</code>"
        if t == "Link":
            title = f' title="{q(c[2][1])}"' if c[2][1] else ""
            return f'<a href="{q(c[2][0])}"{attributes(c[0])}{title}>{self.inlines(c[1])}</a>'
        if t == "Image":
            title = f' title="{q(c[2][1])}"' if c[2][1] else ""
            alt = f' alt="{q(plain(c[1]))}"' if c[1] else ""
            return f'<img src="{q(c[2][0])}"{title}{alt}{attributes(c[0])} />'
        if t == "Math":
            kind = "inline" if c[0]["t"] == "InlineMath" else "display"
            a, b = ("\\(", "\\)") if kind == "inline" else ("\\[", "\\]")
            return f'<span class="math {kind}">{a}{esc(c[1])}{b}</span>'
        if t == "SmallCaps":
            return f'<span class="smallcaps">{self.inlines(c)}</span>'
        if t == "Span":
            return f"<span{attributes(c[0])}>{self.inlines(c[1])}</span>"
        if t == "Cite":
            return f'<span class="citation" data-cites="{q(" ".join(x["citationId"] for x in c[0]))}">{self.inlines(c[1])}</span>'
        if t == "Note":
            self.notes.append("")
            k = len(self.notes)
            back = f'<a href="#fnref{k}" class="footnote-back" role="doc-backlink">↩︎</a>'
            body = self.blocks(c)
            self.notes[k - 1] = f'<li id="fn{k}">{body[: -len("</p>")] + back + "</p>" if body.endswith("</p>") else body + back}</li>'
            return f'<a href="#fn{k}" class="footnote-ref" id="fnref{k}" role="doc-noteref"><sup>{k}</sup></a>'
        return super().inline(n)

    def item(self, body: list[dict]) -> str:
        if body and body[0]["t"] in ("Plain", "Para") and body[0]["c"] and body[0]["c"][0].get("c") in ("☐", "☒"):
            first = self.inlines(body[0]["c"][2:])
            box = f'<label><input type="checkbox"{" checked=\"\"" if body[0]["c"][0]["c"] == "☒" else ""} />{first}</label>'
            return tag("li", (box if body[0]["t"] == "Plain" else f"<p>{box}</p>") + ("\n" + self.blocks(body[1:]) if body[1:] else ""))
        return super().item(body)

    def block(self, n: dict) -> str:
        t, c = n["t"], n.get("c")
        if t == "Header":
            level = min(c[0], 6)
            return f"<h{level}{attributes(c[1])}>{self.inlines(c[2])}</h{level}>"
        if t == "CodeBlock":
            return f"<pre{attributes(c[0])}><code>{esc(c[1])}</code></pre>"
        if t == "Div":
            section = self.html5 and "section" in c[0][1]
            a = [c[0][0], [x for x in c[0][1] if not (section and x == "section")], c[0][2]]
            return f"<{'section' if section else 'div'}{attributes(a)}>\n{self.blocks(c[1])}\n</{'section' if section else 'div'}>"
        if t == "OrderedList":
            start, style = c[0][0], _LIST_TYPES.get(c[0][1]["t"])
            return f"<ol{f' start={chr(34)}{start}{chr(34)}' if start != 1 else ''}{f' type={chr(34)}{style}{chr(34)}' if style else ''}>\n" + "\n".join(map(self.item, c[1])) + "\n</ol>"
        if t == "LineBlock":
            return '<div class="line-block">' + self.v.line_break.join(map(self.inlines, c)) + "</div>"
        if t == "Table":
            return self.html_table(n)
        return super().block(n)

    def html_table(self, n: dict) -> str:
        a, caption, specs, *_ = n["c"]
        parts: dict[str, dict[int, list[str]]] = {"head": {}, "body": {}, "foot": {}}
        col: dict[int, int] = {}
        for part, row, cell in cells(n):
            at = col.get(row, 0)
            col[row] = at + cell[3]
            align = _ALIGNS.get(cell[1]["t"]) or (_ALIGNS.get(specs[at][0]["t"]) if at < len(specs) else None)
            name = "th" if part == "head" else "td"
            style = f' style="text-align: {align};"' if align else ""
            spans = "".join(f' {k}="{v}"' for k, v in (("rowspan", cell[2]), ("colspan", cell[3])) if v > 1)
            parts[part].setdefault(row, []).append(f"<{name}{style}{spans}>{self.blocks(cell[4])}</{name}>")
        out = [f"<table{attributes(a)}>"]
        if caption[1]:
            out.append(f"<caption>{self.blocks(caption[1])}</caption>")
        for part, name in (("head", "thead"), ("body", "tbody"), ("foot", "tfoot")):
            if parts[part]:
                out += [f"<{name}>", *("<tr>\n" + "\n".join(r) + "\n</tr>" for r in parts[part].values()), f"</{name}>"]
        return "\n".join([*out, "</table>"])

    def document(self, doc: dict) -> str:
        body = self.blocks(doc["blocks"])
        if self.notes:
            tag_ = "section" if self.html5 else "div"
            body += f'\n<{tag_} id="footnotes" class="footnotes" role="doc-endnotes">\n<hr />\n<ol>\n' + "\n".join(self.notes) + f"\n</ol>\n</{tag_}>"
        return body + "\n"


def to_html(doc: dict) -> str:
    return Html().document(doc)


def to_html4(doc: dict) -> str:
    return Html(html5=False).document(doc)


# --- serialised trees, outlines ---------------------------------------------------------------------------------------


def to_xml(doc: dict) -> str:
    """The tree itself: an element for each node."""

    def attrs(a: list) -> str:
        return (f' id="{q(a[0])}"' if a[0] else "") + (f' class="{q(" ".join(a[1]))}"' if a[1] else "") + "".join(f' {k}="{q(v)}"' for k, v in a[2] if k.isidentifier())

    def one(n: dict) -> str:
        from leafmill.tree import parts

        t, c = n["t"], n.get("c")
        if t == "Str":
            return esc(c)
        if t == "Run":
            return c
        if t == "Space":
            return " "
        if c is None:
            return f"<{t} />"
        if t in ("Code", "CodeBlock"):
            return f"<{t}{attrs(c[0])}>{esc(c[1])}</{t}>"
        if t == "Math":
            return f'<{t} math-type="{c[0]["t"]}">{esc(c[1])}</{t}>'
        if t in ("RawInline", "RawBlock"):
            return f'<{t} format="{q(c[0])}">{esc(c[1])}</{t}>'
        a = ""
        if t == "Header":
            a = f' level="{c[0]}"{attrs(c[1])}'
        elif t in ("Link", "Image"):
            a = f' {"href" if t == "Link" else "src"}="{q(c[2][0])}" title="{q(c[2][1])}"{attrs(c[0])}'
        elif t in ("Div", "Span", "Figure", "Table"):
            a = attrs(c[0])
        elif t == "Quoted":
            a = f' quote-type="{c[0]["t"]}"'
        elif t == "OrderedList":
            a = f' start="{c[0][0]}" number-style="{c[0][1]["t"]}" number-delim="{c[0][2]["t"]}"'
        if t == "Table":
            row = lambda r: f"<row{attrs(r[0])}>" + "".join(f'<cell alignment="{x[1]["t"]}" row-span="{x[2]}" col-span="{x[3]}"{attrs(x[0])}>{"".join(map(one, x[4]))}</cell>' for x in r[1]) + "</row>"
            rows = lambda rs: "".join(map(row, rs))
            specs = "".join(f'<colspec alignment="{s[0]["t"]}" width="{s[1].get("c", 0)}" />' for s in c[2])
            bodies = "".join(f'<body row-head-columns="{b[1]}"{attrs(b[0])}><header>{rows(b[2])}</header>{rows(b[3])}</body>' for b in c[4])
            return f"<Table{a}><Caption>{''.join(map(one, c[1][1]))}</Caption><colspecs>{specs}</colspecs><head{attrs(c[3][0])}>{rows(c[3][1])}</head>{bodies}<foot{attrs(c[5][0])}>{rows(c[5][1])}</foot></Table>"
        if t == "Figure":
            return f"<Figure{a}><Caption>{''.join(map(one, c[1][1]))}</Caption>{''.join(map(one, c[2]))}</Figure>"
        body = "".join("".join(map(one, xs)) if not role else f"<{role}>{''.join(map(one, xs))}</{role}>" for role, xs in parts(n))
        return f"<{t}{a}>{body}</{t}>"

    meta = "".join(f'<entry key="{q(k)}">{esc(meta_text(v))}</entry>' for k, v in doc["meta"].items())
    return f"<document><meta>{meta}</meta><blocks>{''.join(map(one, doc['blocks']))}</blocks></document>\n"


def to_opml(doc: dict) -> str:
    """An outline of the headings, what stands below one as its note."""
    from leafmill.sinks.markup import render as light

    def outline(xs: list[dict]) -> str:
        out, i = "", 0
        while i < len(xs):
            if xs[i]["t"] != "Header":
                i += 1
                continue
            level, j = xs[i]["c"][0], i + 1
            while j < len(xs) and not (xs[j]["t"] == "Header" and xs[j]["c"][0] <= level):
                j += 1
            inner = xs[i + 1 : j]
            first = next((k for k, b in enumerate(inner) if b["t"] == "Header"), len(inner))
            note = light({"meta": {}, "blocks": inner[:first]}, "markdown").strip() if first else ""
            out += f'<outline text="{q(Html().inlines(xs[i]["c"][2]))}"' + (f' _note="{q(note).replace(chr(10), "&#10;")}"' if note else "") + f">\n{outline(inner[first:])}</outline>\n"
            i = j
        return out

    return f'<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n<head><title>{esc(meta_text(doc["meta"].get("title")))}</title></head>\n<body>\n{outline(doc["blocks"])}</body>\n</opml>\n'
