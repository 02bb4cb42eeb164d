"""The syntax tree: documents as nested dictionaries while they are parsed or rendered, and as rows (`nodes`) in tables.

A node is {"t": type, "c": content} in the public JSON form of the tree: a document is {"meta": {..}, "blocks": [..]}.
Attributes are [identifier, [class, ..], [[key, value], ..]]. In a table, node_id is the preorder number and last_id that of
the last descendant, so that the subtree of a is the range a.node_id .. a.last_id of its document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

NO_ATTR = ["", [], []]
INLINE = {"Str", "Space", "Emph", "Strong", "Underline", "Strikeout", "Superscript", "Subscript", "SmallCaps", "Quoted", "Cite", "Code", "SoftBreak", "LineBreak", "Math", "RawInline", "Link", "Image", "Note", "Span"}

NODES = (
    "doc_id bigint, node_id int, parent_id int, ord int, depth int, last_id int, kind string, type string, level int, text string, fmt string, "
    "attr struct<id:string,classes:array<string>,kvs:array<struct<k:string,v:string>>>, target struct<url:string,title:string>, "
    "lst struct<start:int,style:string,delim:string>, cell struct<align:string,rowspan:int,colspan:int,part:string,row:int,col:int>"
)


def node(t: str, *c) -> dict:
    """node("Emph", children) or node("Header", level, attr, children): one argument is the content, several are its list."""
    return {"t": t} if not c else {"t": t, "c": c[0] if len(c) == 1 else list(c)}


def attr(identifier: str = "", classes: list[str] | None = None, kvs: list | None = None) -> list:
    return [identifier, classes or [], [list(x) for x in kvs or []]]


SPACE, SOFT, BREAK = {"t": "Space"}, {"t": "SoftBreak"}, {"t": "LineBreak"}


_RUNS = re.compile(r"[ \t\n\r]+|[^ \t\n\r]+")


#: Characters that a text must have to become a Run, and whether readers make them now.
RUN = 40
_in_runs = False


@contextmanager
def in_runs() -> Iterator[None]:
    """Readers called within give long plain text as one node Run, which stands for the Str and Space nodes of its text: for callers that ask for no single word. unrun() spells them out."""
    global _in_runs
    before, _in_runs = _in_runs, True
    try:
        yield
    finally:
        _in_runs = before


def making_runs() -> bool:
    return _in_runs


def bare(text: str) -> bool:
    """Whether a text has only letters, spaces and commas, and some letter."""
    return text.replace(" ", "").replace(",", "").isalpha()


def run(text: str, known: bool = False) -> dict | None:
    """A bare text (known: it is one) with single spaces between its words as a Run, where such are made."""
    return {"t": "Run", "c": text} if _in_runs and len(text) >= RUN and "  " not in text and text[0] != " " and text[-1] != " " and (known or bare(text)) else None


def unrun(xs):
    """A tree, or any part of it, with Str and Space nodes in place of each Run."""
    if isinstance(xs, dict):
        return {k: unrun(v) for k, v in xs.items()}
    if isinstance(xs, list):
        return [y for x in xs for y in (words(x["c"]) if isinstance(x, dict) and x.get("t") == "Run" else [unrun(x)])]
    return xs


def words(text: str) -> list[dict]:
    """Text as Str and Space nodes; line ends are soft breaks."""
    if _in_runs and len(text) >= RUN:
        inner = text.strip(" \t\n\r")
        if one := run(inner):
            if len(inner) == len(text):
                return [one]
            start = text.index(inner[0])
            return [*each_word(text[:start]), one, *each_word(text[start + len(inner) :])]
    return each_word(text)


def each_word(text: str) -> list[dict]:
    """words without a Run: for text that others may be joined to."""
    return [] if not text else [{"t": "Str", "c": run} if run[0] not in " \t\n\r" else SOFT if "\n" in run else SPACE for run in _RUNS.findall(text)]


def trimmed(inlines: list[dict]) -> list[dict]:
    """Without spaces and breaks at the ends."""
    a, b = 0, len(inlines)
    while a < b and inlines[a]["t"] in ("Space", "SoftBreak", "LineBreak"):
        a += 1
    while b > a and inlines[b - 1]["t"] in ("Space", "SoftBreak", "LineBreak"):
        b -= 1
    return inlines[a:b]


def parts(n: dict) -> list[tuple[str, list[dict]]]:
    """The lists of children of a node, each with the name of its role."""
    t, c = n["t"], n.get("c")
    if t in ("Para", "Plain", "Emph", "Strong", "Underline", "Strikeout", "Superscript", "Subscript", "SmallCaps", "BlockQuote", "Note"):
        return [("", c)]
    if t == "Header":
        return [("", c[2])]
    if t in ("Div", "Span", "Quoted"):
        return [("", c[1])]
    if t in ("Link", "Image"):
        return [("", c[1])]
    if t == "Cite":
        return [("", c[1])]
    if t == "BulletList":
        return [("item", x) for x in c]
    if t == "OrderedList":
        return [("item", x) for x in c[1]]
    if t == "LineBlock":
        return [("line", x) for x in c]
    if t == "DefinitionList":
        return [y for term, defs in c for y in [("term", term), *[("definition", d) for d in defs]]]
    if t == "Figure":
        return [("caption", c[1][1]), ("", c[2])]
    if t == "Table":
        return [("caption", c[1][1]), *[("cell", cell[4]) for _, _, cell in cells(n)]]
    return []


def cells(table: dict) -> Iterator[tuple[str, int, list]]:
    """part (head, body or foot), row number over the table, and each cell."""
    _, _, _, head, bodies, foot = table["c"]
    row = 0
    for part, rows in (("head", head[1]), *[("body", b[2] + b[3]) for b in bodies], ("foot", foot[1])):
        for r in rows:
            for cell in r[1]:
                yield part, row, cell
            row += 1


def simple_table(head: list[list[dict]] | None, rows: list[list[list[dict]]], aligns: list[str] | None = None, caption: list[dict] | None = None) -> dict:
    """A table of cells (blocks) without spans."""
    n = max([len(r) for r in rows] + [len(head or [])] + [0])
    aligns = (aligns or []) + ["AlignDefault"] * n
    row = lambda r: [NO_ATTR, [[NO_ATTR, {"t": "AlignDefault"}, 1, 1, c] for c in list(r) + [[]] * (n - len(r))]]
    return node("Table", NO_ATTR, [None, [node("Plain", caption)] if caption else []], [[{"t": aligns[i]}, {"t": "ColWidthDefault"}] for i in range(n)], [NO_ATTR, [row(head)] if head else []], [[NO_ATTR, 0, [], [row(r) for r in rows]]], [NO_ATTR, []])


def walk(nodes: list[dict], f: Callable[[dict], list[dict] | dict | None]) -> list[dict]:
    """Every node rewritten from the leaves up: f gives None to keep it, a node, or a list to put in its place."""
    out = []
    for n in nodes:
        n = mapped(n, lambda xs: walk(xs, f))
        new = f(n)
        out += [n] if new is None else new if isinstance(new, list) else [new]
    return out


def mapped(n: dict, f: Callable[[list[dict]], list[dict]]) -> dict:
    """n with f applied to each of its lists of children."""
    t, c = n["t"], n.get("c")
    if t in ("Para", "Plain", "Emph", "Strong", "Underline", "Strikeout", "Superscript", "Subscript", "SmallCaps", "BlockQuote", "Note"):
        return node(t, f(c))
    if t == "Header":
        return node(t, c[0], c[1], f(c[2]))
    if t in ("Div", "Span", "Quoted", "Cite"):
        return node(t, c[0], f(c[1]))
    if t in ("Link", "Image"):
        return node(t, c[0], f(c[1]), c[2])
    if t in ("BulletList", "LineBlock"):
        return node(t, [f(x) for x in c])
    if t == "OrderedList":
        return node(t, c[0], [f(x) for x in c[1]])
    if t == "DefinitionList":
        return node(t, [[f(term), [f(d) for d in defs]] for term, defs in c])
    if t == "Figure":
        return node(t, c[0], [c[1][0], f(c[1][1])], f(c[2]))
    if t == "Table":
        row = lambda r: [r[0], [[*cell[:4], f(cell[4])] for cell in r[1]]]
        rows = lambda rs: [row(r) for r in rs]
        return node(t, c[0], [c[1][0], f(c[1][1])], c[2], [c[3][0], rows(c[3][1])], [[b[0], b[1], rows(b[2]), rows(b[3])] for b in c[4]], [c[5][0], rows(c[5][1])])
    return n


#: Quotation marks by type.
QUOTES = {"SingleQuote": ("‘", "’"), "DoubleQuote": ("“", "”")}


def plain(nodes: list[dict]) -> str:
    """The text of nodes: breaks are spaces, notes are skipped."""
    out = []
    for n in nodes:
        t = n["t"]
        if t in ("Str", "Run"):
            out.append(n["c"])
        elif t in ("Space", "SoftBreak", "LineBreak"):
            out.append(" ")
        elif t in ("Code", "CodeBlock", "Math"):
            out.append(n["c"][1])
        elif t == "RawInline":
            out.append(" " if n["c"][1].lower().startswith("<br") else "")
        elif t == "Quoted":
            a, b = QUOTES[n["c"][0]["t"]]
            out.append(a + plain(n["c"][1]) + b)
        elif t != "Note":
            out += [plain(x) for _, x in parts(n)]
    return "".join(out)


def meta_text(value: dict | None) -> str:
    """A metadata value as text."""
    if not value:
        return ""
    t, c = value["t"], value.get("c")
    return c if t == "MetaString" else plain(c) if t in ("MetaInlines", "MetaBlocks") else str(c).lower() if t == "MetaBool" else ""


COLUMNS = [c.split(" ", 1)[0] for c in re.split(r", (?![^<]*>)", NODES)]
_ID, _PARENT, _ORD, _DEPTH, _LAST, _KIND, _TYPE, _LEVEL, _TEXT, _FMT, _ATTR, _TARGET, _LST, _CELL = range(1, len(COLUMNS))


def rows(doc_id: int | None, doc: dict) -> Iterator[dict]:
    """The nodes of a document in preorder, under a root row."""
    for r in flat(doc_id, doc):
        yield dict(zip(COLUMNS, r, strict=True))


def flat(doc_id: int | None, doc: dict) -> list[list]:
    """rows as lists in the order of COLUMNS."""
    out = [_row(doc_id, 0, None, 0, 0, "doc", "Doc")]

    def visit(n: dict, parent: int, place: int, depth: int) -> None:
        t, c = n["t"], n.get("c")
        me = len(out)
        r = _row(doc_id, me, parent, place, depth, "inline" if t in INLINE else "block", t)
        out.append(r)
        if t == "Str":
            r[_TEXT] = c
            return
        if t in LEAVES:
            return
        if t in ("Code", "CodeBlock"):
            r[_ATTR], r[_TEXT] = _attr(c[0]), c[1]
        elif t == "Math":
            r[_FMT], r[_TEXT] = c[0]["t"], c[1]
        elif t in ("RawInline", "RawBlock"):
            r[_FMT], r[_TEXT] = c
        elif t == "Header":
            r[_LEVEL], r[_ATTR] = c[0], _attr(c[1])
        elif t in ("Div", "Span", "Figure", "Table"):
            r[_ATTR] = _attr(c[0])
        elif t in ("Link", "Image"):
            r[_ATTR], r[_TARGET] = _attr(c[0]), {"url": c[2][0], "title": c[2][1]}
        elif t == "OrderedList":
            r[_LST] = {"start": c[0][0], "style": c[0][1]["t"], "delim": c[0][2]["t"]}
        elif t == "Quoted":
            r[_FMT] = c[0]["t"]
        elif t == "Cite":
            r[_TEXT] = ";".join(x["citationId"] for x in c[0])
        inner = [("cell", cell_[4], (part, row, cell_)) for part, row, cell_ in cells(n)] if t == "Table" else []
        lists = [(role_, xs, None) for role_, xs in parts(n) if t != "Table" or role_ == "caption"] + inner
        i = 0
        col: dict[int, int] = {}
        for role_, xs, info in lists:
            if not role_:
                for x in xs:
                    visit(x, me, i, depth + 1)
                    i += 1
                continue
            g = len(out)
            group = _row(doc_id, g, me, i, depth + 1, "group", role_)
            out.append(group)
            i += 1
            if info:
                part, row, cell_ = info
                group[_CELL] = {"align": cell_[1]["t"], "rowspan": cell_[2], "colspan": cell_[3], "part": part, "row": row, "col": col.get(row, 0)}
                group[_ATTR] = _attr(cell_[0])
                col[row] = col.get(row, 0) + cell_[3]
            for k, x in enumerate(xs):
                visit(x, g, k, depth + 2)
            group[_LAST] = len(out) - 1
        r[_LAST] = len(out) - 1

    for i, b in enumerate(doc["blocks"]):
        visit(b, 0, i, 1)
    out[0][_LAST] = len(out) - 1
    return out


def under(found: list[list], types: frozenset[str]) -> list[list]:
    """Of a document's rows the root, those right below it, and the subtrees of nodes of these types."""
    out, end = [], -1
    for r in found:
        if r[_TYPE] in types and r[_LAST] > end:
            end = r[_LAST]
        if r[_ID] <= end or r[_DEPTH] <= 1:
            out.append(r)
    return out


def error_row(doc_id: int | None, error: str) -> dict:
    """In place of the nodes of a document that can't be read."""
    return dict(zip(COLUMNS, error_list(doc_id, error), strict=True))


def error_list(doc_id: int | None, error: str) -> list:
    r = _row(doc_id, 0, None, 0, 0, "error", "Error")
    r[_TEXT] = error
    return r


LEAVES = {"Space", "SoftBreak", "LineBreak", "HorizontalRule"}


def _row(doc_id, node_id, parent, place, depth, kind, t) -> list:
    return [doc_id, node_id, parent, place, depth, node_id, kind, t, None, None, None, None, None, None, None]


def _attr(a: list) -> dict:
    return {"id": a[0], "classes": list(a[1]), "kvs": [{"k": k, "v": v} for k, v in a[2]]}


def identifier(text: str) -> str:
    """A heading's identifier, as functions.text.identifier makes it."""
    kept = "".join(ch for ch in text.lower() if ch.isalnum() or ch in "_-. \t\r\n")
    joined = "-".join(kept.split())
    while joined and not joined[0].isalpha():
        joined = joined[1:]
    return joined or "section"


def every(blocks: list[dict]) -> Iterator[dict]:
    """All nodes in preorder."""
    left = list(reversed(blocks))
    while left:
        n = left.pop()
        yield n
        if n["t"] not in LEAVES and n["t"] != "Str" and n["t"] != "Run":
            for _, xs in reversed(parts(n)):
                left.extend(reversed(xs))


def headers(blocks: list[dict]) -> list[dict]:
    """The headings of every, without a look at each word."""
    found: list[dict] = []

    def visit(xs: list[dict]) -> None:
        for n in xs:
            t = n["t"]
            if t == "Str" or t == "Space" or t == "Run" or t in LEAVES:
                continue
            if t == "Para" or t == "Plain":
                if len(n["c"]) > 1 or n["c"] and n["c"][0]["t"] != "Run":
                    visit(n["c"])
                continue
            if t == "Header":
                found.append(n)
            for _, ys in parts(n):
                visit(ys)

    visit(blocks)
    return found


def unique_identifiers(blocks: list[dict]) -> list[dict]:
    """blocks, in which headers without an identifier have got one from their text; one that is taken gets -1, -2, .. ."""
    heads = headers(blocks)
    used = {n["c"][1][0] for n in heads if n["c"][1][0]}
    for n in heads:
        level, (own, classes, kvs), text = n["c"]
        if own:
            continue
        base, k = identifier(plain(text)), 0
        name = base
        while name in used:
            k += 1
            name = f"{base}-{k}"
        used.add(name)
        n["c"] = [level, [name, classes, kvs], text]
    return blocks
