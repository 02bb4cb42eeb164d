"""HTML to tree: the standard tokenizer, and rules for tags that HTML lets an author leave out."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

from leafmill.tree import BREAK, NO_ATTR, attr, node, simple_table, trimmed, unique_identifiers, words

#: Elements by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
DROPPED = {"script", "style", "head", "template", "noscript", "iframe", "object", "svg", "math", "select", "textarea", "button"}
SIMPLE = {"em": "Emph", "i": "Emph", "strong": "Strong", "b": "Strong", "u": "Underline", "ins": "Underline", "s": "Strikeout", "del": "Strikeout", "strike": "Strikeout", "sup": "Superscript", "sub": "Subscript"}
SECTIONING = {"div", "section", "article", "aside", "nav", "main", "header", "footer", "details", "summary", "address", "fieldset", "form", "center", "dialog", "menu"}
#: What a new element closes when it is open, up to the nearest element that holds such.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}


class _Element:
    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class _Builder(HTMLParser):
    """Elements and strings as a tree, with unclosed and stray tags put right."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("#root", {})
        self.open = [self.root]
        self.first: dict[str, _Element] = {}  # of each tag, in the order of the document

    def close_to(self, tags: set[str], within: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in within:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES:
            tags, within = CLOSES[tag]
            for _ in tags:
                self.close_to(tags, within)
        elif tag in BLOCK:
            # A block ends open inline elements and an open paragraph.
            while len(self.open) > 1 and (self.open[-1].tag == "p" or self.open[-1].tag in SIMPLE or self.open[-1].tag in ("span", "font", "code", "small", "big")):
                self.open.pop()
        e = _Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(e)
        self.first.setdefault(tag, e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in BLOCK and tag not in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _attr(e: _Element, drop: tuple = ()) -> list:
    kvs = [[k.removeprefix("data-"), v] for k, v in e.attrs.items() if k not in ("id", "class", *drop)]
    return attr(e.attrs.get("id", ""), e.attrs.get("class", "").split(), kvs)


def _text(e) -> str:
    out, left = [], [e]
    while left:
        x = left.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        else:
            left.extend(reversed(x.children))
    return "".join(out)


def _find(e: _Element, tag: str):
    for c in e.children:
        if isinstance(c, _Element):
            if c.tag == tag:
                return c
            found = _find(c, tag)
            if found:
                return found
    return None


def _inlines(children: list) -> list[dict]:
    out: list[dict] = []
    for c in children:
        if isinstance(c, str):
            new = words(c)
            if new and out and new[0]["t"] in ("Space", "SoftBreak") and out[-1]["t"] in ("Space", "SoftBreak", "LineBreak"):
                new = new[1:]
            out += new
            continue
        t = c.tag
        if t == "script" and c.attrs.get("type", "").startswith("math/tex"):
            out.append(node("Math", {"t": "DisplayMath" if "display" in c.attrs["type"] else "InlineMath"}, _text(c)))
            continue
        if t in DROPPED:
            continue
        if t in SIMPLE:
            _spaced(out, _inlines(c.children), lambda xs, t=t: node(SIMPLE[t], xs))
        elif t == "br":
            while out and out[-1]["t"] in ("Space", "SoftBreak"):
                out.pop()
            out.append(BREAK)
        elif t == "kbd":
            out.append(node("Span", [c.attrs.get("id", ""), ["kbd", *c.attrs.get("class", "").split()], []], _inlines(c.children)))
        elif t in ("code", "tt", "samp", "var"):
            a = _attr(c)
            if t != "code":
                a = [a[0], [{"samp": "sample", "var": "variable"}.get(t, t), *a[1]] if t != "tt" else a[1], a[2]]
            out.append(node("Code", a, " ".join(_text(c).split())))
        elif t == "a":
            if "href" in c.attrs:
                a = _attr(c, ("href", "title", "name"))
                a[0] = a[0] or c.attrs.get("name", "")
                _spaced(out, _inlines(c.children), lambda xs, a=a, c=c: node("Link", a, xs, [c.attrs["href"].strip(), c.attrs.get("title", "")]))
            else:
                out.append(node("Span", _attr(c, ("name",)) if c.attrs.get("id") else attr(c.attrs.get("name", ""), c.attrs.get("class", "").split()), _inlines(c.children)))
        elif t == "img":
            out.append(node("Image", _attr(c, ("src", "alt", "title")), words(c.attrs.get("alt", "")), [c.attrs.get("src", ""), c.attrs.get("title", "")]))
        elif t == "q":
            out.append(node("Quoted", {"t": "DoubleQuote"}, _inlines(c.children)))
        elif t in ("span", "mark", "dfn", "bdo", "small", "abbr", "cite", "time", "label"):
            a = _attr(c)
            if t == "span" and (a[1] == ["smallcaps"] or _SMALL.search(c.attrs.get("style", ""))):
                out.append(node("SmallCaps", _inlines(c.children)))
                continue
            out.append(node("Span", a if t in ("span", "label", "time", "bdo") else [a[0], [t, *a[1]], a[2]], _inlines(c.children)))
        elif t == "input" and c.attrs.get("type") == "checkbox":
            out.append(node("Str", "☒" if "checked" in c.attrs else "☐"))
        elif t not in VOID:
            out += _inlines(c.children)
    return out


def _spaced(out: list[dict], xs: list[dict], make) -> None:
    """An element's node, with the spaces at its ends outside of it."""
    space = lambda x: x["t"] in ("Space", "SoftBreak")
    if xs and space(xs[0]) and not (out and space(out[-1])):
        out.append(xs[0])
    inner = trimmed(xs) if xs and (space(xs[0]) or space(xs[-1])) else xs
    out.append(make(inner))
    if len(xs) > 1 and space(xs[-1]):
        out.append(xs[-1])


def _blocks(children: list, tight: bool = False) -> list[dict]:
    """Blocks; runs of inline content become Plain (tight) or Para."""
    out: list[dict] = []
    run: list = []

    def flush() -> None:
        inlines = trimmed(_inlines(run))
        if inlines:
            out.append(node("Plain", inlines))
        run.clear()

    for c in children:
        if isinstance(c, str) or (c.tag not in BLOCK and not any(isinstance(x, _Element) and x.tag in BLOCK for x in c.children)):
            run.append(c)
            continue
        flush()
        t = c.tag
        if t in DROPPED:
            continue
        if t == "p":
            inlines = trimmed(_inlines(c.children))
            if inlines:
                out.append(node("Para", inlines))
        elif t in ("h1", "h2", "h3", "h4", "h5", "h6"):
            out.append(node("Header", int(t[1]), _attr(c), trimmed(_inlines(c.children))))
        elif t in ("ul", "menu"):
            out.append(node("BulletList", _items(c)))
        elif t == "ol":
            style = _number_style(c)
            start = c.attrs.get("start", "1")
            out.append(node("OrderedList", [int(start) if start.lstrip("-").isdigit() else 1, {"t": style}, {"t": "DefaultDelim"}], _items(c)))
        elif t == "dl":
            pairs: list = []
            for x in c.children:
                if isinstance(x, _Element) and x.tag == "dt":
                    term = trimmed(_inlines(x.children))
                    if pairs and not pairs[-1][1]:  # several terms of one definition
                        pairs[-1][0] += [BREAK, *term]
                    else:
                        pairs.append([term, []])
                elif isinstance(x, _Element) and x.tag == "dd":
                    pairs = pairs or [[[], []]]
                    pairs[-1][1].append(_blocks(x.children))
            out.append(node("DefinitionList", pairs))
        elif t == "blockquote":
            out.append(node("BlockQuote", [_para(b) for b in _blocks(c.children)]))
        elif t == "pre":
            inner = _find(c, "code")
            a = _attr(c)
            if inner and inner.attrs.get("class"):
                a = [a[0], a[1] + [x.removeprefix("language-") for x in inner.attrs["class"].split()], a[2]]
            out.append(node("CodeBlock", a, _text(c).removeprefix("\n").removesuffix("\n")))
        elif t == "hr":
            out.append(node("HorizontalRule"))
        elif t == "figure":
            caption = _find(c, "figcaption")
            rest = [x for x in c.children if x is not caption]
            out.append(node("Figure", _attr(c), [None, _blocks(caption.children) if caption else []], _blocks(rest)))
        elif t == "table":
            out.append(_table(c))
        elif t in SECTIONING:
            a = _attr(c)
            out.append(node("Div", a if t == "div" else [a[0], ([t] if t == "section" else []) + a[1], a[2]], _blocks(c.children)))
        else:
            out += _blocks(c.children)
    flush()
    if not tight and any(b["t"] == "Para" for b in out):
        out = [_para(b) for b in out]
    return out


def _para(b: dict) -> dict:
    return node("Para", b["c"]) if b["t"] == "Plain" else b


def _items(e: _Element) -> list[list[dict]]:
    out: list[list[dict]] = []
    for c in e.children:
        if isinstance(c, _Element) and c.tag == "li":
            out.append(_blocks(c.children))
        elif isinstance(c, _Element) or c.strip():  # stray content of a list belongs to the item before
            more = _blocks([c])
            if out:
                out[-1] += more
            elif more:
                out.append(more)
    return [[_para(b) for b in item] if any(b["t"] == "Para" for b in item) else item for item in out]


#: Numbers of lists by their type and their style.
_TYPES = {"1": "Decimal", "a": "LowerAlpha", "A": "UpperAlpha", "i": "LowerRoman", "I": "UpperRoman"}
_STYLES = {"lower-roman": "LowerRoman", "upper-roman": "UpperRoman", "lower-alpha": "LowerAlpha", "upper-alpha": "UpperAlpha", "decimal": "Decimal"}
_SMALL = re.compile(r"font-variant:\s*small-caps")


def _number_style(e: _Element) -> str:
    if e.attrs.get("type") in _TYPES:
        return _TYPES[e.attrs["type"]]
    named = re.search(r"list-style(?:-type)?:\s*([a-z-]+)", e.attrs.get("style", ""))
    for word in ([named[1]] if named else []) + e.attrs.get("class", "").split():
        if word in _STYLES:
            return _STYLES[word]
    return "DefaultStyle"


#: Alignments.
_ALIGN = {"left": "AlignLeft", "right": "AlignRight", "center": "AlignCenter"}


def _cell(e: _Element) -> list:
    style = e.attrs.get("style", "").replace(" ", "").lower()
    align = _ALIGN.get(e.attrs.get("align", "").lower()) or next((v for k, v in _ALIGN.items() if f"text-align:{k}" in style), "AlignDefault")
    span = lambda k: int(e.attrs[k]) if e.attrs.get(k, "").isdigit() and int(e.attrs[k]) > 0 else 1
    return [_attr(e, ("rowspan", "colspan", "align", "style")), {"t": align}, span("rowspan"), span("colspan"), _blocks(e.children)]


def _table(e: _Element) -> dict:
    caption = next((c for c in e.children if isinstance(c, _Element) and c.tag == "caption"), None)
    # Parts in their order: kind, attributes, and each row with its elements.
    parts: list[tuple[str, list, list]] = []
    columns: list[_Element] = []

    def collect(x: _Element, part: list | None) -> None:
        for c in x.children:
            if not isinstance(c, _Element):
                continue
            if c.tag in ("thead", "tbody", "tfoot"):
                parts.append((c.tag, _attr(c), []))
                collect(c, parts[-1][2])
            elif c.tag == "tr":
                if part is None:
                    if not parts or parts[-1][0] != "bare":
                        parts.append(("bare", NO_ATTR, []))
                own = [y for y in c.children if isinstance(y, _Element) and y.tag in ("td", "th")]
                (parts[-1][2] if part is None else part).append((own, [_attr(c), [_cell(y) for y in own]]))
            elif c.tag == "col":
                columns.append(c)
            elif c.tag == "colgroup":
                collect(c, part)

    collect(e, None)
    heads = lambda row: bool(row[0]) and all(y.tag == "th" for y in row[0])
    head = [r for kind, _, rows in parts if kind == "thead" for r in rows]
    bodies = [(a, list(rows)) for kind, a, rows in parts if kind in ("tbody", "bare") and rows]
    bare = next((kind for kind, _, rows in parts if kind in ("tbody", "bare") and rows), "") == "bare"
    if not head and bare and heads(bodies[0][1][0]):
        head.append(bodies[0][1].pop(0))
    made = []
    for a, rows in bodies:
        k = next((i for i, r in enumerate(rows) if not heads(r)), 0)  # rows of heads at a body's top; a body of heads alone has none
        made.append([a, _row_heads(rows[k:]), [r for _, r in rows[:k]], [r for _, r in rows[k:]]])
    foot = [r for kind, _, rows in parts if kind == "tfoot" for _, r in rows]
    every = [r for _, r in head] + [r for b in made for r in b[2] + b[3]] + foot
    n = max([sum(c[3] for c in r[1]) for r in every] or [0])
    if not n:
        return simple_table(None, [])
    first = next((r for r in [r for b in made for r in b[3]] + [r for _, r in head]), None)
    aligns = [c[1]["t"] for c in first[1] for _ in range(c[3])] if first else []
    widths = _widths(columns, n)
    specs = [[{"t": aligns[i] if i < len(aligns) else "AlignDefault"}, widths[i]] for i in range(n)]
    return node("Table", _attr(e), [None, _blocks(caption.children) if caption else []], specs, [NO_ATTR, [r for _, r in head]], made or [[NO_ATTR, 0, [], []]], [NO_ATTR, foot])


def _row_heads(rows: list) -> int:
    """How many columns at the front are heads in every row; a head may reach over several rows."""
    least, held = None, []  # held: columns that reach down, with the rows left
    for own, _ in rows:
        wide = sum(w for w, _ in held)
        held = [(w, k - 1) for w, k in held if k > 1]
        for y in own:
            if y.tag != "th":
                break
            span = lambda k: int(y.attrs[k]) if y.attrs.get(k, "").isdigit() and int(y.attrs[k]) > 0 else 1  # noqa: B023, E731
            wide += span("colspan")
            if span("rowspan") > 1:
                held.append((span("colspan"), span("rowspan") - 1))
        least = wide if least is None else min(least, wide)
    return least or 0


def _widths(columns: list[_Element], n: int) -> list[dict]:
    """Of columns that say so, as shares; what is left over goes to those with a star."""
    said: list[float | None] = []
    for c in columns:
        m = re.search(r"width:\s*([\d.]+)%", c.attrs.get("style", "")) or re.match(r"([\d.]+)%", c.attrs.get("width", ""))
        said += [float(m[1]) / 100 if m else None] * (int(c.attrs["span"]) if c.attrs.get("span", "").isdigit() else 1)
    if len(said) != n or all(x is None for x in said):
        return [{"t": "ColWidthDefault"}] * n
    rest = max(1 - sum(x for x in said if x is not None), 0) / max(sum(x is None for x in said), 1)
    return [{"t": "ColWidth", "c": round(rest, 6) if x is None else x} if (x or rest) else {"t": "ColWidthDefault"} for x in said]


#: A script or style, in which nothing is a reference, or an ampersand that begins no numeric reference, with the name that it begins and that a semicolon closes.
_AMPERSAND = re.compile(r"(?is)<(script|style)\b.*?</\1|&(?!#[0-9]+;|#x[0-9a-f]+;)([a-z][a-z0-9]*;)?")


def _kept(m: re.Match) -> str:
    return m[0] if m[1] or m[2] in html5 else f"&amp;{m[2] or ''}"


def read_html(text: str, main_only: bool = False, open_references: bool = True) -> dict:
    """A document; with main_only, of a page that has a main element only that; without open_references, with &amp and the like as they stand if no semicolon closes them."""
    b = _Builder()
    b.feed(text if open_references else _AMPERSAND.sub(_kept, text))
    b.close()
    title, html = b.first.get("title"), b.first.get("html")
    meta = {}
    if title:
        meta["title"] = {"t": "MetaInlines", "c": trimmed(words(_text(title)))}
    if html and html.attrs.get("lang"):
        meta["lang"] = {"t": "MetaString", "c": html.attrs["lang"]}
    head = b.first.get("head")
    for e in head.children if head else []:
        if isinstance(e, _Element) and e.tag == "meta" and e.attrs.get("name"):
            meta[e.attrs["name"]] = {"t": "MetaString", "c": e.attrs.get("content", "")}
    top = (b.first.get("main") if main_only else None) or b.first.get("body") or b.root
    blocks = _blocks(top.children)
    return {"meta": meta, "blocks": unique_identifiers(blocks)}



