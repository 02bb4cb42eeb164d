"""XML vocabularies to tree: one reader, and for each vocabulary the roles of its elements. And office packages, whose parts are XML."""

from __future__ import annotations

import io
import posixpath
import html
import re
import zipfile
from dataclasses import dataclass, field
from functools import lru_cache
from xml.etree import ElementTree as ET

from leafmill.sources.html import read_html
from leafmill.tree import BREAK, NO_ATTR, attr, making_runs, node, simple_table, trimmed, unique_identifiers, unrun, words


@lru_cache(4096)
def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def local(e: ET.Element) -> str:
    return _local(e.tag)


def get(e: ET.Element, *names: str) -> str:
    """An attribute by its local name."""
    for k, v in e.attrib.items():
        if _local(k) in names:
            return v
    return ""


@dataclass
class Roles:
    inline: dict[str, str] = field(default_factory=dict)
    code: set[str] = field(default_factory=set)
    para: set[str] = field(default_factory=set)
    quote: set[str] = field(default_factory=set)
    pre: set[str] = field(default_factory=set)
    section: set[str] = field(default_factory=set)
    title: set[str] = field(default_factory=set)
    bullets: set[str] = field(default_factory=set)
    numbers: set[str] = field(default_factory=set)
    item: set[str] = field(default_factory=set)
    defs: dict[str, tuple[str, str, str]] = field(default_factory=dict)  # list: entry, term, definition
    link: set[str] = field(default_factory=set)
    image: set[str] = field(default_factory=set)
    note: set[str] = field(default_factory=set)
    table: set[str] = field(default_factory=set)
    row: set[str] = field(default_factory=set)
    cell: set[str] = field(default_factory=set)
    head: set[str] = field(default_factory=set)
    skip: set[str] = field(default_factory=set)
    line_break: set[str] = field(default_factory=set)
    rule: set[str] = field(default_factory=set)
    div: set[str] = field(default_factory=set)
    math: set[str] = field(default_factory=set)


class Reader:
    def __init__(self, roles: Roles) -> None:
        self.r, self.notes = roles, {}

    def inlines(self, e: ET.Element) -> list[dict]:
        out = words(e.text or "")
        for c in e:
            out += self.inline(c)
            out += words(c.tail or "")
        return _merged(out)

    def inline(self, c: ET.Element) -> list[dict]:
        t, r = local(c), self.r
        if t in r.skip or not t:
            return []
        kind = r.inline.get(f"{t}:{get(c, 'role', 'rendition', 'toggle', 'style-name')}") or r.inline.get(t)
        if kind:
            return [node(kind, self.inlines(c)) if kind != "Quoted" else node("Quoted", {"t": "DoubleQuote"}, self.inlines(c))]
        if t in r.code:
            return [node("Code", NO_ATTR, "".join(c.itertext()))]
        if t in r.math:
            return [node("Math", {"t": "DisplayMath" if "disp" in t else "InlineMath"}, "".join(c.itertext()).strip())]
        if t in r.link:
            url = get(c, "href", "url", "target") or ("#" + get(c, "linkend", "rid") if get(c, "linkend", "rid") else "")
            if get(c, "type") == "note" and url[1:] in self.notes:
                return [node("Note", self.notes[url[1:]])]
            inner = trimmed(self.inlines(c))
            return [node("Link", NO_ATTR, inner or words(url), [url, get(c, "title")])]
        if t in r.image:
            return [node("Image", NO_ATTR, [], [get(c, "fileref", "href", "url", "src"), ""])]
        if t in r.note:
            return [node("Note", self.blocks(c))]
        if t in r.line_break:
            return [BREAK]
        return self.inlines(c)

    def blocks(self, e: ET.Element, level: int = 1) -> list[dict]:
        out: list[dict] = []
        run: list[dict] = words(e.text or "")

        def flush() -> None:
            inl = trimmed(_merged(run))
            if inl:
                out.append(node("Para", inl))
            run.clear()

        for c in e:
            found = self.block(c, level)
            if found is None:
                run.extend(self.inline(c))
            else:
                flush()
                out += found
            run.extend(words(c.tail or ""))
        flush()
        return out

    def block(self, c: ET.Element, level: int) -> list[dict] | None:
        t, r = local(c), self.r
        if not t or t in r.skip:
            return []
        if t in r.section:
            title = next((x for x in c if local(x) in r.title), None)
            rest = ET.Element("rest")
            rest.extend(x for x in c if x is not title)
            head = [node("Header", level, attr(get(c, "id")), trimmed(self.title(title)))] if title is not None else []
            return head + self.blocks(rest, level + 1)
        if t in r.title:
            return [node("Header", max(level - 1, 1), attr(get(c, "id")), trimmed(self.title(c)))]
        if t in r.para:
            inner = [x for x in c if self.is_block(x)]
            if inner:
                return self.blocks(c, level)
            inl = trimmed(self.inlines(c))
            return [node("Para", inl)] if inl else []
        if t in r.quote:
            return [node("BlockQuote", self.blocks(c, level))]
        if t in r.pre:
            lang = get(c, "language", "lang")
            return [node("CodeBlock", attr("", [lang] if lang else []), "".join(c.itertext()).strip("\n"))]
        if t in r.bullets or t in r.numbers:
            kind = get(c, "list-type", "type")
            items = [self.tight(self.blocks(x, level)) for x in c if local(x) in r.item]
            ordered = kind in ("order", "ordered", "alpha-lower", "alpha-upper", "roman-lower", "roman-upper") or (t in r.numbers and t not in r.bullets)
            style = {"alpha-lower": "LowerAlpha", "alpha-upper": "UpperAlpha", "roman-lower": "LowerRoman", "roman-upper": "UpperRoman"}.get(kind, "DefaultStyle")
            return [node("OrderedList", [1, {"t": style}, {"t": "DefaultDelim"}], items) if ordered else node("BulletList", items)]
        if t in r.defs:
            entry, term, body = r.defs[t]
            pairs = []
            for x in c.iter():
                if local(x) == entry:
                    terms = [trimmed(self.inlines(y)) for y in x if local(y) == term]
                    pairs.append([terms[0] if terms else [], [self.tight(self.blocks(y, level)) for y in x if local(y) == body]])
            return [node("DefinitionList", pairs)]
        if t in r.table:
            return [self.tabular(c, level)]
        if t in r.rule:
            return [node("HorizontalRule")]
        if t in r.div:
            return self.blocks(c, level)
        if t in r.math and "disp" in t:
            return [node("Para", self.inline(c))]
        return None

    def title(self, e: ET.Element) -> list[dict]:
        paras = [x for x in e if local(x) in self.r.para]
        return [y for p in paras for y in [*self.inlines(p), {"t": "Space"}]] if paras else self.inlines(e)

    def is_block(self, c: ET.Element) -> bool:
        r, t = self.r, local(c)
        return t in r.quote | r.pre | r.bullets | r.numbers | r.table | r.para or t in r.defs

    def tight(self, blocks: list[dict]) -> list[dict]:
        return [node("Plain", b["c"]) if b["t"] == "Para" else b for b in blocks] if sum(b["t"] == "Para" for b in blocks) <= 1 else blocks

    def tabular(self, e: ET.Element, level: int) -> dict:
        r, rows, head = self.r, [], None
        caption = next((trimmed(self.title(x)) for x in e.iter() if local(x) in ("title", "caption", "head") and x is not e), None)
        in_head = {id(x) for h in e.iter() if local(h) in r.head for x in h.iter()}
        for x in e.iter():
            if local(x) in r.row:
                own = [y for y in x if local(y) in r.cell]
                cells = [self.tight(self.blocks(y, level)) for y in own]
                is_head = id(x) in in_head or (own and all(local(y) == "th" or get(y, "role") == "label" for y in own))
                if is_head and head is None and not rows:
                    head = cells
                else:
                    rows.append(cells)
        return simple_table(head, rows, caption=caption)


def _merged(xs: list[dict]) -> list[dict]:
    if len(xs) < 2:
        return list(xs)
    if any(x["t"] == "Run" and (k and xs[k - 1]["t"] in ("Str", "Run") or xs[k + 1 : k + 2] and xs[k + 1]["t"] == "Str") for k, x in enumerate(xs)):
        xs = unrun(xs)
    out: list[dict] = []
    for x in xs:
        if x["t"] in ("Space", "SoftBreak") and out and out[-1]["t"] in ("Space", "SoftBreak"):
            continue
        if x["t"] == "Str" and out and out[-1]["t"] == "Str":
            out[-1] = node("Str", out[-1]["c"] + x["c"])
        else:
            out.append(x)
    return out


#: Element names of the vocabularies.
_cals = dict(table={"informaltable", "table"}, row={"row", "tr"}, cell={"entry", "td", "th"}, head={"thead"})
DOCBOOK = Roles(
    inline={"emphasis": "Emph", "emphasis:strong": "Strong", "emphasis:bold": "Strong", "emphasis:strikethrough": "Strikeout", "emphasis:underline": "Underline", "superscript": "Superscript", "subscript": "Subscript", "quote": "Quoted", "foreignphrase": "Emph", "citetitle": "Emph"}, code={"literal", "code", "command", "filename", "option", "varname", "function", "classname", "userinput", "computeroutput", "constant", "parameter"}, para={"para", "simpara", "formalpara"}, quote={"blockquote", "epigraph"}, pre={"programlisting", "screen", "literallayout", "synopsis"},
    section={"section", "sect1", "sect2", "sect3", "sect4", "sect5", "chapter", "appendix", "preface", "part", "simplesect", "bibliography", "glossary"}, title={"title", "bridgehead"}, bullets={"itemizedlist", "simplelist"}, numbers={"orderedlist", "procedure"}, item={"listitem", "member", "step"}, defs={"variablelist": ("varlistentry", "term", "listitem"), "glosslist": ("glossentry", "glossterm", "glossdef")}, link={"link", "ulink", "xref"}, image={"imagedata", "graphic"}, note={"footnote"}, skip={"info", "articleinfo", "bookinfo", "sectioninfo", "chapterinfo", "indexterm", "anchor", "subtitle"}, div={"note", "warning", "tip", "important", "caution", "example", "figure", "informalfigure", "mediaobject", "imageobject", "sidebar"}, **_cals,
)
JATS = Roles(
    inline={"italic": "Emph", "bold": "Strong", "strike": "Strikeout", "underline": "Underline", "sc": "SmallCaps", "sup": "Superscript", "sub": "Subscript"}, code={"monospace"}, para={"p"}, quote={"disp-quote"}, pre={"code", "preformat"}, section={"sec", "app", "book-part", "abstract", "ack", "ref-list"}, title={"title"}, bullets={"list"}, numbers={"list"}, item={"list-item"}, defs={"def-list": ("def-item", "term", "def")}, link={"ext-link", "xref", "uri"}, image={"inline-graphic", "graphic"}, note={"fn"}, table={"table-wrap", "table"}, row={"tr"}, cell={"td", "th"}, head={"thead"}, skip={"front", "article-meta", "journal-meta", "book-meta", "label", "ref"}, line_break={"break"}, rule={"hr"}, div={"body", "back", "fig", "boxed-text", "caption", "sec-meta", "fn-group", "book-body", "named-book-part-body"}, math={"tex-math", "inline-formula", "disp-formula"},
)
FB2 = Roles(inline={"emphasis": "Emph", "strong": "Strong", "strikethrough": "Strikeout", "sup": "Superscript", "sub": "Subscript", "style": "Emph"}, code={"code"}, para={"p", "subtitle", "text-author"}, quote={"cite", "epigraph", "annotation"}, section={"section"}, title={"title"}, link={"a"}, image={"image"}, table={"table"}, row={"tr"}, cell={"td", "th"}, skip={"description", "binary"}, div={"body", "poem", "stanza"}, rule={"empty-line"})
TEI = Roles(inline={"hi": "Emph", "emph": "Emph", "hi:simple:bold": "Strong", "hi:simple:strikethrough": "Strikeout", "hi:simple:superscript": "Superscript", "hi:simple:subscript": "Subscript", "q": "Quoted"}, code={"seg"}, para={"p"}, quote={"quote"}, pre={"ab"}, section={"div"}, title={"head"}, bullets={"list"}, numbers={"list"}, item={"item"}, link={"ref", "ptr"}, image={"graphic"}, note={"note"}, table={"table"}, row={"row"}, cell={"cell"}, skip={"teiHeader"}, line_break={"lb"}, div={"text", "body", "figure"}, math={"formula"})


def _entity(m: re.Match) -> str:
    """A named entity of HTML, which has the ISO names; one that isn't known stays readable text."""
    found = html.unescape(m[0])
    return found if found != m[0] else f"&amp;{m[1]};"


#: The colon after a known prefix of an attribute; the search goes from colon to colon.
_PREFIX = re.compile(":(?:" + "|".join(rf"(?<=\b{p}:)" for p in ("xlink", "l", "xml", "text", "office", "table", "draw", "w", "r", "epub")) + r")(?=\w+\s*=)")


def _parse(text: str | bytes) -> ET.Element:
    if isinstance(text, str):
        text = re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", text)
        text = re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)(\w+);", _entity, text)
        text = _PREFIX.sub("-", text) if "xmlns" not in text else text
        text = text.replace("xml-id=", "id=").replace("xlink-href=", "href=").replace("l-href=", "href=")
    return ET.fromstring(text)


def _read(text: str, roles: Roles, title: str, top: tuple[str, ...]) -> dict:
    root = _parse(text if not isinstance(text, str) or text.lstrip().startswith(("<?xml", "<!DOCTYPE", "<article", "<book", "<chapter", "<FictionBook", "<TEI")) else f"<article>{text}</article>")
    r, meta = Reader(roles), {}
    every = [(local(e), e) for e in root.iter()]
    titles = title.split("|")
    for name, e in every:
        if name in titles and "title" not in meta:
            meta["title"] = {"t": "MetaInlines", "c": trimmed(r.title(e))}
    for name, b in every:
        if name == "body" and get(b, "name") == "notes":
            for s in b.iter():
                if local(s) == "section" and get(s, "id"):
                    rest = ET.Element("rest")
                    rest.extend(x for x in s if local(x) not in roles.title)
                    r.notes[get(s, "id")] = r.blocks(rest)
    bodies = [e for name, e in every if name in top and get(e, "name") != "notes"] or [root]
    blocks = [x for b in bodies for x in r.blocks(b)]
    return {"meta": meta, "blocks": unique_identifiers(blocks)}


def read_docbook(text: str) -> dict:
    root = _parse(text if text.lstrip().startswith("<") and text.count("<article") + text.count("<book") + text.count("<?xml") else f"<article>{text}</article>")
    r, meta = Reader(DOCBOOK), {}
    for c in list(root):
        if local(c) == "title":
            meta["title"] = {"t": "MetaInlines", "c": trimmed(r.inlines(c))}
            root.remove(c)
        elif local(c) in ("info", "articleinfo", "bookinfo") and c.find("{*}title") is not None:
            meta["title"] = {"t": "MetaInlines", "c": trimmed(r.inlines(c.find("{*}title")))}
    return {"meta": meta, "blocks": unique_identifiers(r.blocks(root))}


def read_jats(text: str) -> dict:
    return _read(text, JATS, "article-title|book-title", ("body", "book-body"))


def read_fb2(text: str) -> dict:
    return _read(text, FB2, "book-title", ("body",))


def read_tei(text: str) -> dict:
    return _read(text, TEI, "", ("body",))


def read_tree(text: str) -> dict:
    """The tree's own XML form."""
    root = ET.fromstring(text)
    inline_empty = {"SoftBreak", "LineBreak", "HorizontalRule"}

    def kids(e: ET.Element, inline: bool) -> list[dict]:
        out = words(e.text or "") if inline else []
        for c in e:
            out.append(one(c))
            if inline:
                out += words(c.tail or "")
        return _merged(out)

    def a(e: ET.Element) -> list:
        known = {"id", "class", "level", "href", "src", "title", "format", "math-type", "quote-type", "start", "number-style", "number-delim"}
        return attr(e.get("id", ""), e.get("class", "").split(), [[k, v] for k, v in e.attrib.items() if k not in known])

    def one(e: ET.Element) -> dict:
        t = e.tag
        if t in inline_empty or t == "Space":
            return {"t": t}
        if t in ("Code", "CodeBlock"):
            return node(t, a(e), e.text or "")
        if t == "Math":
            return node(t, {"t": e.get("math-type", "InlineMath")}, e.text or "")
        if t in ("RawInline", "RawBlock"):
            return node(t, e.get("format", ""), e.text or "")
        if t == "Header":
            return node(t, int(e.get("level", "1")), a(e), kids(e, True))
        if t in ("Link", "Image"):
            return node(t, a(e), kids(e, True), [e.get("href", e.get("src", "")), e.get("title", "")])
        if t == "Span":
            return node(t, a(e), kids(e, True))
        if t == "Div":
            return node(t, a(e), kids(e, False))
        if t == "Quoted":
            return node(t, {"t": e.get("quote-type", "DoubleQuote")}, kids(e, True))
        if t in ("BulletList", "OrderedList", "LineBlock"):
            items = [kids(x, t == "LineBlock") for x in e]
            return node(t, items) if t != "OrderedList" else node(t, [int(e.get("start", "1")), {"t": e.get("number-style", "DefaultStyle")}, {"t": e.get("number-delim", "DefaultDelim")}], items)
        if t == "DefinitionList":
            pairs: list = []
            for x in e:
                if x.tag == "term":
                    pairs.append([kids(x, True), []])
                elif pairs:
                    pairs[-1][1].append(kids(x, False))
            return node(t, pairs)
        if t == "Figure":
            return node(t, a(e), [None, kids(e.find("Caption"), False)], [one(x) for x in e if x.tag != "Caption"])
        if t == "Table":
            known = ("alignment", "row-span", "col-span", "row-head-columns")
            own = lambda x: attr(x.get("id", ""), x.get("class", "").split(), [[k, v] for k, v in x.attrib.items() if k not in ("id", "class", *known)])
            cell = lambda x: [own(x), {"t": x.get("alignment")}, int(x.get("row-span")), int(x.get("col-span")), kids(x, False)]
            rows = lambda x: [[own(r), [cell(y) for y in r]] for r in x.findall("row")]
            specs = [[{"t": s.get("alignment")}, {"t": "ColWidth", "c": float(s.get("width"))} if float(s.get("width")) else {"t": "ColWidthDefault"}] for s in e.find("colspecs")]
            head, foot = e.find("head"), e.find("foot")
            bodies = [[own(b), int(b.get("row-head-columns")), rows(b.find("header")), rows(b)] for b in e.findall("body")]
            return node(t, a(e), [None, kids(e.find("Caption"), False)], specs, [own(head), rows(head)], bodies, [own(foot), rows(foot)])
        return node(t, kids(e, t not in ("BlockQuote", "Note")))

    meta = {x.get("key"): {"t": "MetaString", "c": x.text or ""} for x in root.iter("entry")}
    return {"meta": meta, "blocks": [one(e) for e in root.find("blocks")]}


# --- packages ---------------------------------------------------------------------------------------------------------


class _Zip:
    def __init__(self, content: bytes) -> None:
        self.z = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.z.namelist())

    def xml(self, name: str, before=lambda content: content) -> ET.Element | None:
        return ET.fromstring(before(self.z.read(name))) if name in self.names else None

    def rels(self, part: str) -> dict[str, str]:
        root = self.xml(f"{posixpath.dirname(part)}/_rels/{posixpath.basename(part)}.rels")
        return {e.get("Id"): e.get("Target") for e in root} if root is not None else {}


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


_RUNS = re.compile(rb'(?:<w:r><w:t xml:space="preserve">[^<\n\r]*</w:t></w:r>){2,}')


def _together(content: bytes) -> bytes:
    """Texts without properties that follow each other as one; in text no tag begins, other than in a comment or a section of characters."""
    if b"<!" in content:
        return content
    return _RUNS.sub(lambda m: m[0].replace(b'</w:t></w:r><w:r><w:t xml:space="preserve">', b""), content)


@lru_cache(64)
def _styles(content: bytes) -> dict[str, tuple[str, str]]:
    """Name and base of each style; many documents share theirs."""
    styles: dict[str, tuple[str, str]] = {}
    for s in ET.fromstring(content):
        if local(s) == "style":
            name, based = s.find(f"{_W}name"), s.find(f"{_W}basedOn")
            styles[get(s, "styleId")] = (get(name, "val") if name is not None else "", get(based, "val") if based is not None else "")
    return styles


@lru_cache(64)
def _numbers(content: bytes) -> dict[tuple[str, str], str]:
    """The number format of each list and level."""
    n, numbers = ET.fromstring(content), {}
    abstract = {get(x, "abstractNumId"): {get(lv, "ilvl"): get(lv.find(f"{_W}numFmt"), "val") for lv in x.findall(f"{_W}lvl")} for x in n.findall(f"{_W}abstractNum")}
    for x in n.findall(f"{_W}num"):
        for lvl, fmt in abstract.get(get(x.find(f"{_W}abstractNumId"), "val"), {}).items():
            numbers[get(x, "numId"), lvl] = fmt
    return numbers


def read_docx(content: bytes) -> dict:
    """A word processor's document: styles by their names, numbering, notes, links, tables."""
    z = _Zip(content)
    rels, part = z.rels("word/document.xml"), z.xml("word/document.xml", _together if making_runs() else lambda content: content)
    styles = _styles(z.z.read("word/styles.xml")) if "word/styles.xml" in z.names else {}
    numbers = _numbers(z.z.read("word/numbering.xml")) if "word/numbering.xml" in z.names else {}
    notes: dict[str, ET.Element] = {}
    for kind in ("footnote", "endnote"):
        root = z.xml(f"word/{kind}s.xml")
        notes |= {f"{kind}{get(x, 'id')}": x for x in root} if root is not None else {}

    def style_name(sid: str, seen: int = 0) -> str:
        name, based = styles.get(sid, (sid, ""))
        return name.lower() if re.match(r"heading \d|title|block text|source code|quote|definition", name.lower()) or not based or seen > 9 else style_name(based, seen + 1)

    def run(r: ET.Element) -> list[dict]:
        props, out = r.find(f"{_W}rPr"), []
        for c in r:
            t = local(c)
            if t in ("t", "delText"):
                out += words(c.text or "")
            elif t == "tab":
                out.append({"t": "Space"})
            elif t in ("br", "cr"):
                out.append(BREAK)
            elif t in ("footnoteReference", "endnoteReference"):
                note = notes.get(t.removesuffix("Reference") + get(c, "id"))
                out.append(node("Note", blocks(note) if note is not None else []))
            elif t == "drawing":
                for b in c.iter():
                    if local(b) == "blip":
                        out.append(node("Image", NO_ATTR, [], [rels.get(get(b, "embed"), ""), ""]))
        if props is not None and out:
            on = lambda k: (p := props.find(f"{_W}{k}")) is not None and get(p, "val") not in ("0", "false", "none")
            if (rs := props.find(f"{_W}rStyle")) is not None and "verbatim" in get(rs, "val").lower():
                from leafmill.tree import plain

                return [node("Code", NO_ATTR, plain(out))]
            va = props.find(f"{_W}vertAlign")
            for key, kind in (("smallCaps", "SmallCaps"), ("strike", "Strikeout"), ("u", "Underline"), ("b", "Strong"), ("i", "Emph")):
                if on(key):
                    out = [node(kind, out)]
            if va is not None and get(va, "val") in ("superscript", "subscript"):
                out = [node(get(va, "val").capitalize(), out)]
        return out

    def inl(p: ET.Element) -> list[dict]:
        out: list[dict] = []
        for c in p:
            t = local(c)
            if t == "r":
                new = run(c)
                if new and out and len(new) == 1 and len(out) and new[0]["t"] == out[-1]["t"] and new[0]["t"] in ("Emph", "Strong", "Underline", "Strikeout"):
                    out[-1] = node(new[0]["t"], _merged(out[-1]["c"] + new[0]["c"]))
                else:
                    out += new
            elif t == "hyperlink":
                url = rels.get(get(c, "id"), "") or "#" + get(c, "anchor")
                out.append(node("Link", NO_ATTR, inl(c), [url, ""]))
            elif t in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple"):  # insertions are accepted, deletions dropped
                out += inl(c)
        return _merged(out)

    def blocks(e: ET.Element) -> list[dict]:
        out: list[dict] = []
        for c in e:
            t = local(c)
            if t == "tbl":
                rows = [[tight(blocks(tc)) for tc in tr.findall(f"{_W}tc")] for tr in c.findall(f"{_W}tr")]
                out.append(simple_table(rows[0], rows[1:]) if rows else simple_table(None, []))
            elif t in ("sdt", "sdtContent"):
                out += blocks(c)
            elif t == "p":
                props = c.find(f"{_W}pPr")
                sid = get(props.find(f"{_W}pStyle"), "val") if props is not None and props.find(f"{_W}pStyle") is not None else ""
                name = style_name(sid)
                inl_ = trimmed(inl(c))
                num = props.find(f"{_W}numPr") if props is not None else None
                if m := re.match(r"heading (\d)", name):
                    out.append(node("Header", int(m[1]), NO_ATTR, inl_))
                elif name == "title":
                    meta["title"] = {"t": "MetaInlines", "c": inl_}
                elif "source code" in name:
                    from leafmill.tree import plain

                    text = "\n".join(plain(x) for x in _split(inl(c)))
                    if out and out[-1]["t"] == "CodeBlock":
                        out[-1] = node("CodeBlock", NO_ATTR, out[-1]["c"][1] + "\n" + text)
                    else:
                        out.append(node("CodeBlock", NO_ATTR, text))
                elif not inl_:
                    continue
                elif num is not None and num.find(f"{_W}numId") is not None:
                    lvl = get(num.find(f"{_W}ilvl"), "val") if num.find(f"{_W}ilvl") is not None else "0"
                    fmt = numbers.get((get(num.find(f"{_W}numId"), "val"), lvl), "bullet")
                    out.append(("item", int(lvl), fmt, inl_))
                elif name in ("block text", "quote", "intense quote"):
                    if out and isinstance(out[-1], dict) and out[-1]["t"] == "BlockQuote":
                        out[-1]["c"].append(node("Para", inl_))
                    else:
                        out.append(node("BlockQuote", [node("Para", inl_)]))
                else:
                    out.append(node("Para", inl_))
        return _listed(out)

    def tight(bs: list[dict]) -> list[dict]:
        return [node("Plain", b["c"]) if b["t"] == "Para" and len(bs) == 1 else b for b in bs]

    meta: dict = {}
    body = blocks(part.find(f"{_W}body"))
    return {"meta": meta, "blocks": unique_identifiers(body)}


def _split(xs: list[dict]) -> list[list[dict]]:
    out: list[list[dict]] = [[]]
    for x in xs:
        if x["t"] == "LineBreak":
            out.append([])
        else:
            out[-1].append(x)
    return out


#: Number formats of list levels.
_FORMATS = {"decimal": "Decimal", "lowerLetter": "LowerAlpha", "upperLetter": "UpperAlpha", "lowerRoman": "LowerRoman", "upperRoman": "UpperRoman"}


def _listed(xs: list) -> list[dict]:
    """Runs of items (level, format, inlines) as nested lists."""
    out, i = [], 0

    def take(i: int, level: int) -> tuple[dict, int]:
        fmt, items = xs[i][2], []
        while i < len(xs) and isinstance(xs[i], tuple) and xs[i][1] >= level:
            if xs[i][1] > level and items:
                inner, i = take(i, xs[i][1])
                items[-1].append(inner)
                continue
            if xs[i][2] != fmt:
                break
            items.append([node("Plain", xs[i][3])])
            i += 1
        return (node("BulletList", items) if fmt == "bullet" else node("OrderedList", [1, {"t": _FORMATS.get(fmt, "DefaultStyle")}, {"t": "Period"}], items)), i

    while i < len(xs):
        if isinstance(xs[i], tuple):
            block, i = take(i, xs[i][1])
            out.append(block)
        else:
            out.append(xs[i])
            i += 1
    return out


def read_xlsx(content: bytes) -> dict:
    """A workbook: a heading and a dense table for each sheet, blank rows at its end dropped."""
    z = _Zip(content)
    shared: list[str] = []
    if (s := z.xml("xl/sharedStrings.xml")) is not None:
        shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in s]
    rels, blocks = z.rels("xl/workbook.xml"), []
    for k, sheet in enumerate(e for e in z.xml("xl/workbook.xml").iter() if local(e) == "sheet"):
        root = z.xml("xl/" + rels.get(get(sheet, "id"), "").lstrip("/").removeprefix("xl/"))
        cells: dict[tuple[int, int], str] = {}
        for c in root.iter() if root is not None else []:
            if local(c) != "c":
                continue
            m = re.match(r"([A-Z]+)(\d+)", get(c, "r"))
            col = 0
            for ch in m[1]:
                col = col * 26 + ord(ch) - 64
            value = next((x.text or "" for x in c if local(x) == "v"), "")
            kind = get(c, "t")
            text = shared[int(value)] if kind == "s" and value else "".join(c.itertext()) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value
            if text:
                cells[int(m[2]), col] = re.sub(r"\.0$", "", text)
        blocks.append(node("Header", 2, attr(f"sheet-{k + 1}"), words(get(sheet, "name"))))
        if cells:
            rows, cols = [r for r, _ in cells], [c for _, c in cells]
            grid = [[[node("Plain", words(cells[r, c]))] if (r, c) in cells else [] for c in range(min(cols), max(cols) + 1)] for r in range(min(rows), max(rows) + 1)]
            blocks.append(simple_table(grid[0], grid[1:]))
    return {"meta": {}, "blocks": blocks}


def read_pptx(content: bytes) -> dict:
    """Slides: a heading from the title (or the slide's number), then its text."""
    z = _Zip(content)
    rels, blocks = z.rels("ppt/presentation.xml"), []
    for k, sld in enumerate(e for e in z.xml("ppt/presentation.xml").iter() if local(e) == "sldId"):
        rid = next((v for key, v in sld.attrib.items() if key.endswith("}id")), "")
        root = z.xml("ppt/" + rels.get(rid, ""))
        title, body = None, []
        for sp in root.iter() if root is not None else []:
            if local(sp) == "tbl":
                rows = [[[node("Plain", words("".join(t.text or "" for t in tc.iter() if local(t) == "t")))] for tc in tr if local(tc) == "tc"] for tr in sp if local(tr) == "tr"]
                body.append(simple_table(rows[0] if rows else None, rows[1:]))
            if local(sp) != "sp":
                continue
            kind = next((get(p, "type") for p in sp.iter() if local(p) == "ph"), "")
            paras = []
            for p in sp.iter():
                if local(p) == "p":
                    level = next((get(x, "lvl") for x in p if local(x) == "pPr"), "")
                    text = words("".join((t.text or "") if local(t) == "t" else "" for t in p.iter()))
                    if text:
                        paras.append((level, text))
            if kind in ("title", "ctrTitle") and title is None:
                title = [x for _, t in paras for x in t]
            elif kind in ("dt", "ftr", "sldNum"):
                continue
            else:
                body += _listed([("item", int(lv), "bullet", t) if lv else node("Para", t) for lv, t in paras])
        blocks += [node("Header", 2, attr(f"slide-{k + 1}"), title or words(f"Slide {k + 1}")), *body]
    return {"meta": {}, "blocks": blocks}


def read_odt(content: bytes) -> dict:
    """An OpenDocument text: styles with what they inherit, lists, notes, tables."""
    z = _Zip(content)
    root = z.xml("content.xml")
    props: dict[str, set[str]] = {}
    parents: dict[str, str] = {}
    numbered: set[str] = {"L1"}
    for src in (z.xml("styles.xml"), root):
        for s in src.iter() if src is not None else []:
            if local(s) == "style":
                name, found = get(s, "name"), set()
                parents[name] = get(s, "parent-style-name")
                for p in s:
                    if local(p) == "text-properties":
                        found |= {"Emph"} if get(p, "font-style") == "italic" else set()
                        found |= {"Strong"} if get(p, "font-weight") == "bold" else set()
                        found |= {"Strikeout"} if get(p, "text-line-through-style") not in ("", "none") else set()
                        found |= {"Underline"} if get(p, "text-underline-style") not in ("", "none") else set()
                        found |= {"Superscript"} if get(p, "text-position").startswith("super") else {"Subscript"} if get(p, "text-position").startswith("sub") else set()
                props[name] = found
            elif local(s) == "list-style" and any(local(x) == "list-level-style-number" for x in s):
                numbered.add(get(s, "name"))
    fixed = {"Emphasis": "Emph", "Strong": "Strong", "Strikeout": "Strikeout", "Underline": "Underline", "Superscript": "Superscript", "Subscript": "Subscript", "Source_Text": "Code", "Strong_20_Emphasis": "Strong", "Source_20_Text": "Code"}

    def kinds(name: str, seen: int = 0) -> set[str]:
        if name in fixed:
            return {fixed[name]}
        return props.get(name, set()) | (kinds(parents[name], seen + 1) if parents.get(name) and seen < 20 else set())

    def inl(e: ET.Element) -> list[dict]:
        out = words(e.text or "")
        for c in e:
            t = local(c)
            if t == "span":
                inner = inl(c)
                for k in sorted(kinds(get(c, "style-name"))):
                    inner = [node("Code", NO_ATTR, "".join(c.itertext()))] if k == "Code" else [node(k, inner)]
                out += inner
            elif t == "a":
                out.append(node("Link", NO_ATTR, inl(c), [get(c, "href"), ""]))
            elif t == "s":
                out.append({"t": "Space"})
            elif t == "tab":
                out.append({"t": "Space"})
            elif t == "line-break":
                out.append(BREAK)
            elif t == "note":
                body = next((x for x in c if local(x) == "note-body"), None)
                out.append(node("Note", blocks(body) if body is not None else []))
            elif t == "frame":
                out += [node("Image", NO_ATTR, [], [get(x, "href"), ""]) for x in c if local(x) == "image"]
            elif t not in ("bookmark", "bookmark-start", "bookmark-end", "annotation", "sequence-decls"):
                out += inl(c)
            out += words(c.tail or "")
        return _merged(out)

    def blocks(e: ET.Element, ordered: bool = False) -> list[dict]:
        out = []
        for c in e:
            t = local(c)
            if t == "h":
                out.append(node("Header", int(get(c, "outline-level") or "1"), attr(get(c, "id")), trimmed(inl(c))))
            elif t == "p":
                style = get(c, "style-name")
                if "Preformatted" in style:
                    out.append(node("CodeBlock", NO_ATTR, "".join(c.itertext())))
                elif "Horizontal" in style:
                    out.append(node("HorizontalRule"))
                elif inner := trimmed(inl(c)):
                    out.append(node("BlockQuote", [node("Para", inner)]) if "Quot" in style else node("Para", inner))
            elif t == "list":
                is_ordered = get(c, "style-name") in numbered or (ordered and not get(c, "style-name"))
                items = [[node("Plain", b["c"]) if b["t"] == "Para" and k == 0 else b for k, b in enumerate(blocks(i, is_ordered))] for i in c if local(i) in ("list-item", "list-header")]
                out.append(node("OrderedList", [1, {"t": "Decimal"}, {"t": "Period"}], items) if is_ordered else node("BulletList", items))
            elif t == "table":
                rows, head = [], None
                for r in c.iter():
                    if local(r) == "table-row":
                        row = [[node("Plain", b["c"]) if b["t"] == "Para" else b for b in blocks(x)] for x in r if local(x) == "table-cell"]
                        in_head = any(r in list(h) for h in c if local(h) == "table-header-rows")
                        if in_head and head is None:
                            head = row
                        else:
                            rows.append(row)
                out.append(simple_table(head, rows))
            elif t in ("section", "text", "index-body", "table-of-content") and t != "table-of-content":
                out += blocks(c)
        return out

    body = next(e for e in root.iter() if local(e) == "text" and "office" in e.tag)
    return {"meta": {}, "blocks": unique_identifiers(blocks(body))}


def read_epub(content: bytes) -> dict:
    """An e-book: the items of the spine in order, found by the manifest, each read as HTML; identifiers and links are told apart by file."""
    z = _Zip(content)
    opf_path = next(e for e in z.xml("META-INF/container.xml").iter() if local(e) == "rootfile").get("full-path")
    opf, base = z.xml(opf_path), posixpath.dirname(opf_path)
    manifest = {get(e, "id"): e.get("href") for e in opf.iter() if local(e) == "item"}
    title = next((e.text for e in opf.iter() if local(e) == "title"), None)
    meta, blocks = ({"title": {"t": "MetaInlines", "c": words(title)}} if title else {}), []
    from leafmill.tree import walk

    for ref in (e for e in opf.iter() if local(e) == "itemref"):
        if ref.get("idref") not in manifest:
            raise ValueError(f"the manifest has no {ref.get('idref')}")
        path = posixpath.normpath(posixpath.join(base, manifest[ref.get("idref")]))
        name = posixpath.basename(path)

        def own(n: dict, name: str = name) -> dict | None:
            if n["t"] == "Header" and n["c"][1][0]:
                return node("Header", n["c"][0], [f"{name}#{n['c'][1][0]}", *n["c"][1][1:]], n["c"][2])
            if n["t"] == "Link" and n["c"][2][0] and "://" not in n["c"][2][0]:
                url = n["c"][2][0]
                return node("Link", n["c"][0], n["c"][1], [f"#{name}{url}" if url.startswith("#") else f"#{posixpath.basename(url)}", n["c"][2][1]])
            return None

        page = read_html(z.z.read(path).decode("utf-8"))
        blocks += [node("Para", [node("Span", attr(name), [])]), *walk(page["blocks"], own)]
    return {"meta": meta, "blocks": blocks}
