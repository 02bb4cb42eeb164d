"""Rewriting whole trees: what moves or nests nodes and so can't be a column expression. Each takes and gives a document; engine.transform applies it to a table."""

from __future__ import annotations

import re
from collections.abc import Callable

from leafmill.tree import NO_ATTR, SPACE, attr, cells, identifier, mapped, node, plain, simple_table, trimmed, unique_identifiers, walk, words


def sections(doc: dict, number: bool = False, base: int | None = None) -> dict:
    """Headings with what follows them as Divs of class section; a second application changes nothing."""
    flat = [b for b in doc["blocks"]]
    levels = [b["c"][0] for b in flat if b["t"] == "Header"]
    top = base or (min(levels) if levels else 99)
    counters: list[int] = [0] * 10

    def build(bs: list[dict]) -> list[dict]:
        out, i = [], 0
        while i < len(bs):
            b = bs[i]
            if b["t"] != "Header":
                out.append(mapped(b, build) if b["t"] == "Div" and "section" not in b["c"][0][1] else b)
                i += 1
                continue
            level, (ident, classes, kvs), text = b["c"]
            j = i + 1
            while j < len(bs) and not (bs[j]["t"] == "Header" and bs[j]["c"][0] <= level):
                j += 1
            kvs = list(kvs)
            if number and "unnumbered" not in classes and not any(k == "number" for k, _ in kvs):
                counters[level] += 1
                for k in range(level + 1, 10):
                    counters[k] = 0
                kvs.append(["number", ".".join(str(counters[k]) for k in range(top, level + 1))])
            out.append(node("Div", [ident, ["section", *classes], kvs], [node("Header", level, ["", classes, kvs], text), *build(bs[i + 1 : j])]))
            i = j
        return out

    return doc | {"blocks": build(flat)}


def table_of_contents(doc: dict, depth: int = 3) -> dict:
    """A bullet list of links to the headings down to a depth; notes and links in them go."""
    heads: list[tuple[int, list, list[dict]]] = []

    def collect(n: dict) -> None:
        if n["t"] == "Header" and n["c"][0] <= depth and not {"unnumbered", "unlisted"} <= set(n["c"][1][1]):
            heads.append((n["c"][0], n["c"][1], n["c"][2]))

    walk(unique_identifiers(doc["blocks"]), collect)

    def entries(xs: list) -> list[list[dict]]:
        out, i = [], 0
        while i < len(xs):
            level, a, text = xs[i]
            j = i + 1
            while j < len(xs) and xs[j][0] > level:
                j += 1
            clean = walk(text, lambda n: [] if n["t"] == "Note" else n["c"][1] if n["t"] == "Link" else None)
            item = [node("Plain", [node("Link", attr(f"toc-{a[0]}" if a[0] else ""), clean, [f"#{a[0]}", ""])])]
            inner = entries(xs[i + 1 : j])
            out.append(item + ([node("BulletList", inner)] if inner else []))
            i = j
        return out

    return node("BulletList", entries(heads))


def with_toc(doc: dict, depth: int = 3) -> dict:
    return doc | {"blocks": [table_of_contents(doc, depth), *unique_identifiers(doc["blocks"])]}


def shift_headers(doc: dict, by: int) -> dict:
    """Levels plus by; what lands at 0 or below becomes a paragraph, a first heading that lands at 0 the title."""
    blocks, meta = list(doc["blocks"]), doc["meta"]
    if by < 0 and blocks and blocks[0]["t"] == "Header" and blocks[0]["c"][0] + by == 0:
        meta = meta | {"title": {"t": "MetaInlines", "c": blocks[0]["c"][2]}}
        blocks = blocks[1:]

    def move(n: dict) -> dict | None:
        if n["t"] != "Header":
            return None
        level = n["c"][0] + by
        return node("Header", level, *n["c"][1:]) if level > 0 else node("Para", n["c"][2])

    return {"meta": meta, "blocks": walk(blocks, move)}


def typed(rules: dict[str, Callable[[dict], dict | list[dict] | None]], topdown: bool = False) -> Callable[[dict], dict]:
    """A filter from functions by node type: None keeps a node, a node or list replaces it, an empty list deletes it. Top down, a function that gives (node, False) stops the descent."""

    def apply(n: dict):
        f = rules.get(n["t"])
        return f(n) if f else None

    def down(xs: list[dict]) -> list[dict]:
        out = []
        for x in xs:
            got = apply(x)
            stop = isinstance(got, tuple)
            got = got[0] if stop else got
            for y in [x] if got is None else got if isinstance(got, list) else [got]:
                out.append(y if stop else mapped(y, down))
        return out

    return lambda doc: doc | {"blocks": down(doc["blocks"]) if topdown else walk(doc["blocks"], apply)}


def without_notes(doc: dict) -> dict:
    return typed({"Note": lambda n: node("Str", "")})(doc)


def without_links(doc: dict) -> dict:
    return typed({"Link": lambda n: node("Span", n["c"][0], n["c"][1])})(doc)


def literal_quotes(doc: dict) -> dict:
    """Quotations as spans with the marks as text."""
    marks = {"SingleQuote": ("‘", "’"), "DoubleQuote": ("“", "”")}
    return typed({"Quoted": lambda n: node("Span", NO_ATTR, [node("Str", marks[n["c"][0]["t"]][0]), *n["c"][1], node("Str", marks[n["c"][0]["t"]][1])])})(doc)


def without_formatting(inlines: list[dict]) -> list[dict]:
    """Only what is text: code and math as strings, breaks as spaces, notes gone."""
    out: list[dict] = []
    for n in inlines:
        t, c = n["t"], n.get("c")
        if t in ("Str", "Space", "SoftBreak"):
            out.append(n)
        elif t in ("Code", "Math"):
            out.append(node("Str", c[1]))
        elif t == "LineBreak":
            out.append(SPACE)
        elif t == "Quoted":
            out += words(plain([n]))
        elif t in ("Emph", "Strong", "Underline", "Strikeout", "Superscript", "Subscript", "SmallCaps"):
            out += without_formatting(c)
        elif t in ("Span", "Link", "Image", "Cite"):
            out += without_formatting(c[1])
    return out


def figures(doc: dict) -> dict:
    """Paragraphs that hold one captioned image as figures."""

    def make(n: dict) -> dict | None:
        if len(n["c"]) == 1 and n["c"][0]["t"] == "Image" and n["c"][0]["c"][1]:
            a, text, target = n["c"][0]["c"]
            return node("Figure", [a[0], [], []], [None, [node("Plain", text)]], [node("Plain", [node("Image", ["", a[1], a[2]], text, target)])])
        return None

    return typed({"Para": make})(doc)


def figure_divs(doc: dict) -> dict:
    """Figures as Divs, for formats that have none."""
    return typed({"Figure": lambda n: node("Div", [n["c"][0][0], ["figure", *n["c"][0][1]], n["c"][0][2]], [*n["c"][2], node("Div", attr("", ["caption"]), n["c"][1][1])])})(doc)


def lines_to_paragraphs(doc: dict) -> dict:
    return typed({"LineBlock": lambda n: node("Para", [x for i, line in enumerate(n["c"]) for x in ([{"t": "LineBreak"}] if i else []) + line])})(doc)


def tight(blocks: list[dict]) -> bool:
    """Whether every item begins with plain text or a tight list."""
    return all(not i or i[0]["t"] == "Plain" or (i[0]["t"] in ("BulletList", "OrderedList") and tight(i[0]["c"] if i[0]["t"] == "BulletList" else i[0]["c"][1])) for i in blocks)


def compact(items: list[list[dict]]) -> list[list[dict]]:
    """Items of a list whose only paragraph is the last one made tight, if no other item has a paragraph."""
    paras = [b for i in items for b in i if b["t"] == "Para"]
    if len(paras) == 1 and items and items[-1] and items[-1][-1]["t"] == "Para":
        return [*items[:-1], [*items[-1][:-1], node("Plain", items[-1][-1]["c"])]]
    return items


def to_inlines(blocks: list[dict], separator: list[dict] | None = None) -> list[dict]:
    """Blocks as one run of inlines."""
    separator = [SPACE, node("Str", "¶"), SPACE] if separator is None else separator
    out: list[list[dict]] = []
    for b in blocks:
        t, c = b["t"], b.get("c")
        if t in ("Para", "Plain"):
            out.append(c)
        elif t == "LineBlock":
            out.append([x for i, line in enumerate(c) for x in ([{"t": "LineBreak"}] if i else []) + line])
        elif t == "CodeBlock":
            out.append([node("Code", c[0], c[1])])
        elif t == "RawBlock":
            out.append([node("RawInline", *c)])
        elif t == "Header":
            out.append(c[2])
        elif t in ("BlockQuote",):
            out.append(to_inlines(c, separator))
        elif t in ("Div", "Figure"):
            out.append(to_inlines(c[1] if t == "Div" else c[2], separator))
        elif t in ("BulletList", "OrderedList"):
            out.append(to_inlines([x for i in (c if t == "BulletList" else c[1]) for x in i], separator))
        elif t == "DefinitionList":
            out.append([x for term, defs in c for x in [*term, node("Str", ":"), SPACE, *to_inlines([y for d in defs for y in d], separator)]])
        elif t == "Table":
            rows: dict[int, list[dict]] = {}
            for _, r, cell in cells(b):
                rows.setdefault(r, []).extend(([SPACE] if r in rows else []) + to_inlines(cell[4], separator))
            out.append([x for i, r in enumerate(rows.values()) for x in ([{"t": "LineBreak"}] if i else []) + r])
    return [x for i, xs in enumerate(out) for x in (separator if i else []) + xs]


def legacy_table(table: dict) -> dict:
    """Spans cut to single cells with their content in the upper left, one head row; further head rows join the body."""
    specs = table["c"][2]
    grid: dict[int, dict[int, list[dict]]] = {}
    taken: set[tuple[int, int]] = set()
    heads = 0
    for part, r, cell in cells(table):
        col = 0
        while (r, col) in taken:
            col += 1
        for i in range(cell[2]):
            for j in range(cell[3]):
                taken.add((r + i, col + j))
        grid.setdefault(r, {})[col] = cell[4]
        heads += part == "head" and r == 0 and not heads
    rows = [[grid[r].get(k, []) for k in range(len(specs))] for r in sorted(grid)]
    has_head = bool(table["c"][3][1])
    out = simple_table(rows[0] if has_head else None, rows[1:] if has_head else rows, [s[0]["t"] for s in specs])
    out["c"][0], out["c"][1], out["c"][2] = table["c"][0], table["c"][1], specs
    return out


def prefixed_ids(doc: dict, ident: str, files: set[str]) -> dict:
    """Identifiers of one file among several told apart by its name; links to them, and to the other files, follow."""

    def change(n: dict) -> dict | None:
        t, c = n["t"], n.get("c")
        add = lambda a: [f"{ident}__{a[0]}", *a[1:]] if a[0] else a
        if t == "Header":
            return node(t, c[0], add(c[1]), c[2])
        if t in ("Div", "Span"):
            return node(t, add(c[0]), c[1])
        if t == "Link":
            path, _, frag = c[2][0].partition("#")
            if not path and frag:
                return node(t, c[0], c[1], [f"#{ident}__{frag}", c[2][1]])
            if path in files:
                name = identifier(path)
                return node(t, c[0], c[1], [f"#{name}" + (f"__{frag}" if frag else ""), c[2][1]])
        return None

    return doc | {"blocks": walk(doc["blocks"], change)} if len(files) > 1 else doc


def concatenated(docs: list[dict]) -> dict:
    """Documents one after another; of a metadata key the last one counts."""
    meta: dict = {}
    for d in docs:
        meta |= d["meta"]
    return {"meta": meta, "blocks": [b for d in docs for b in d["blocks"]]}


def emphasised_spaces(doc: dict) -> dict:
    """Blanks at the ends of emphasis moved out of it."""

    def out(n: dict) -> list[dict] | None:
        c = n["c"]
        core = trimmed(c)
        if len(core) == len(c):
            return None
        first = c.index(core[0]) if core else len(c)
        return [*c[:first], node(n["t"], core), *c[first + len(core) :]] if core else c

    return typed({t: out for t in ("Emph", "Strong", "Underline", "Strikeout")})(doc)


# --- citations --------------------------------------------------------------------------------------------------------

#: Labels of locators.
_LABELS = {"p.": "page", "pp.": "page", "page": "page", "pages": "page", "chap.": "chapter", "chapter": "chapter", "sec.": "section", "section": "section", "vol.": "volume", "volume": "volume", "fig.": "figure", "figure": "figure", "§": "section", "para.": "paragraph", "n.": "note", "bk.": "book"}


def locator(suffix: str) -> tuple[str, str, str]:
    """Label, value and rest of a citation's suffix; without a label, a number is a page."""
    m = re.match(r"\s*,?\s*(?:(pp?\.|pages?|chap\.|chapter|sec\.|section|vol\.|volume|fig\.|figure|§|para\.|n\.|bk\.)\s*)?((?:\d+|[ivxlc]+\b)(?:\s*[-–,]\s*(?:\d+|[ivxlc]+\b))*)(.*)$", suffix, re.S)
    if not m:
        return "", "", suffix
    return _LABELS.get(m[1] or "p.", "page"), m[2].strip(), m[3]


def _surname(ref: dict) -> str:
    people = ref.get("author") or ref.get("editor") or []
    names = [p.get("family") or p.get("literal", "") for p in people]
    if not names:
        return ref.get("title", ref.get("id", ""))
    return names[0] if len(names) == 1 else f"{names[0]} and {names[1]}" if len(names) == 2 else f"{names[0]} et al."


def _year(ref: dict) -> str:
    parts = (ref.get("issued") or {}).get("date-parts") or [[]]
    return str(parts[0][0]) if parts[0] else "n.d."


def bibliography_entry(ref: dict) -> list[dict]:
    """One entry in author-date style."""
    people = ref.get("author") or ref.get("editor") or []
    names = [p.get("literal") or f"{p.get('family', '')}, {p.get('given', '')}".strip(", ") if i == 0 else p.get("literal") or f"{p.get('given', '')} {p.get('family', '')}".strip() for i, p in enumerate(people)]
    who = ", ".join(names[:-1]) + (", and " if len(names) > 1 else "") + names[-1] if names else ""
    out = words(f"{who.rstrip('.')}. {_year(ref)}. " if who else f"{_year(ref)}. ")
    title = words(ref.get("title", ""))
    if ref.get("container-title"):
        out += [node("Quoted", {"t": "DoubleQuote"}, [*title, node("Str", ".")]), SPACE, node("Emph", words(ref["container-title"]))]
        tail = "".join([f" {ref['volume']}" if ref.get("volume") else "", f" ({ref['issue']})" if ref.get("issue") else "", f": {ref['page']}" if ref.get("page") else ""])
        out += words(tail + ".")
    else:
        out += [node("Emph", title), *words("." + (f" {ref['publisher-place']}:" if ref.get("publisher-place") else "") + (f" {ref['publisher']}." if ref.get("publisher") else ""))]
    if ref.get("DOI"):
        url = f"https://doi.org/{ref['DOI']}"
        out += [SPACE, node("Link", NO_ATTR, [node("Str", url)], [url, ""]), node("Str", ".")]
    return out


def cite(doc: dict, references: list[dict] | None = None) -> dict:
    """Citations rendered in author-date style and the bibliography of what is cited in Div#refs (at the end, if there is none).

    References come from the metadata and from `references`; those in the document win. A key that isn't known shows in bold with a question mark.
    """
    from leafmill.sources.structured import unmeta

    own = unmeta(doc["meta"]["references"]) if "references" in doc["meta"] else []
    known = {r["id"]: r for r in [*(references or []), *own]}
    used: dict[str, None] = {}
    nocite = doc["meta"].get("nocite")
    for n in nocite["c"] if nocite and nocite["t"] == "MetaInlines" else []:
        if n["t"] == "Cite":
            for c in n["c"][0]:
                used |= dict.fromkeys(known) if c["citationId"] == "*" else {c["citationId"]: None}

    def one(c: dict, bare: bool) -> list[dict]:
        ref = known.get(c["citationId"])
        if not ref:
            return [node("Strong", [node("Str", f"{c['citationId']}?")])]
        used[c["citationId"]] = None
        label, value, rest = locator(plain(c["citationSuffix"]))
        text = ([] if bare or c["citationMode"]["t"] == "SuppressAuthor" else [*words(_surname(ref)), SPACE]) + [node("Str", _year(ref))]
        if value:
            text += words(f", {'' if label == 'page' else label + ' '}{value}")
        rest = rest if not rest or rest[:1] in " ,;." else f", {rest}"
        return ([*c["citationPrefix"], SPACE] if c["citationPrefix"] else []) + text + words(rest)

    def render(n: dict) -> dict:
        cs = n["c"][0]
        if cs[0]["citationMode"]["t"] == "AuthorInText" and cs[0]["citationId"] in known:
            inner = [x for i, c in enumerate(cs) for x in ([node("Str", ";"), SPACE] if i else []) + one(c, i == 0)]
            shown = [*words(_surname(known[cs[0]["citationId"]])), SPACE, node("Str", "("), *inner, node("Str", ")")]
        else:
            shown = [node("Str", "("), *[x for i, c in enumerate(cs) for x in ([node("Str", ";"), SPACE] if i else []) + one(c, False)], node("Str", ")")]
        return node("Cite", cs, shown)

    blocks = walk(doc["blocks"], lambda n: render(n) if n["t"] == "Cite" else None)
    refs = sorted((known[k] for k in used if k in known), key=lambda r: (_surname(r).casefold(), _year(r), r.get("title", "")))
    entries = [node("Div", attr(f"ref-{r['id']}", ["csl-entry"]), [node("Para", bibliography_entry(r))]) for r in refs]
    if not entries:
        return doc | {"blocks": blocks}
    placed = False

    def place(n: dict) -> dict | None:
        nonlocal placed
        if n["t"] == "Div" and n["c"][0][0] == "refs":
            placed = True
            return node("Div", n["c"][0], n["c"][1] + entries)
        return None

    blocks = walk(blocks, place)
    return doc | {"blocks": blocks if placed else [*blocks, node("Div", attr("refs", ["references", "csl-bib-body"]), entries)]}


# --- templates --------------------------------------------------------------------------------------------------------


def template(text: str, context: dict) -> str:
    """A template with its variables: $name$, ${name}, $if(name)$ .. $else$ .. $endif$, $for(name)$ .. $sep$ .. $endfor$, $$ for a dollar."""
    token = re.compile(r"\$\$|\$\{?\s*(if|for)\(([\w.-]+)\)\s*\}?\$?|\$(else|endif|endfor|sep)\$|\$\{\s*([\w.-]+)\s*\}|\$([\w.-]+)\$")

    def look(name: str, scope: dict):
        v = scope
        for part in name.split("."):
            v = v.get(part) if isinstance(v, dict) else None
        return v

    def shown(v) -> str:
        return "" if v in (None, False) else "true" if v is True else "".join(map(shown, v)) if isinstance(v, list) else str(v)

    def run(i: int, scope: dict, live: bool) -> tuple[str, int, str]:
        out = ""
        while m := token.search(text, i):
            out += text[i : m.start()] if live else ""
            i = m.end()
            if m[0] == "$$":
                out += "$" if live else ""
            elif m[1] == "if":
                v = look(m[2], scope)
                yes = bool(v) and v != []
                a, i, end = run(i, scope, live and yes)
                b = ""
                if end == "else":
                    b, i, _ = run(i, scope, live and not yes)
                out += a + b
            elif m[1] == "for":
                v = look(m[2], scope)
                items = v if isinstance(v, list) else [v] if v not in (None, "", False) else []
                begin, parts, sep = i, [], ""
                for k, x in enumerate(items or [None]):
                    inner = scope | {m[2]: x, "it": x}
                    a, i, end = run(begin, inner, live and bool(items))
                    if end == "sep":
                        s, i, _ = run(i, inner, live and bool(items))
                        sep = s if k == 0 else sep
                    parts.append(a)
                out += sep.join(parts)
            elif m[3]:
                return out, i, m[3]
            elif live:
                out += shown(look(m[4] or m[5], scope))
        return out + (text[i:] if live else ""), len(text), ""

    return run(0, context, True)[0]


def joined_lines(doc: dict) -> dict:
    """Soft breaks as spaces."""
    return typed({"SoftBreak": lambda n: SPACE})(doc)


