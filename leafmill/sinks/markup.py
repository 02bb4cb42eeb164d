"""Trees to light markup: one renderer whose formats differ in a table of marks and a few rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from leafmill.tree import QUOTES, cells, identifier, plain


@dataclass
class Format:
    """How a format writes things. Inline marks are (before, after); a missing one leaves the content bare."""

    marks: dict[str, tuple[str, str]] = field(default_factory=dict)
    escape: Callable[[str], str] = lambda s: s
    code: Callable[[str], str] = lambda s: s
    link: Callable[[str, str, str], str] = lambda text, url, title: text
    image: Callable[[str, str, str], str] = lambda text, url, title: text
    header: Callable[[int, str, list], str] = lambda level, text, a: text
    code_block: Callable[[str, list], str] = lambda text, classes: "\n".join("    " + x for x in text.split("\n"))
    quote: Callable[[str], str] = lambda body: indented(body, "  ")
    rule: str = "-" * 20
    line_break: str = "\n"
    bullet: Callable[[int], str] = lambda depth: "- "
    number: Callable[[int, int, str], str] = lambda depth, n, style: f"{n}. "
    hanging: bool = True  # further blocks of an item are indented under it
    math: tuple[str, str] = ("$", "$")
    display: tuple[str, str] = ("$$", "$$")
    term: Callable[[str], str] = lambda text: text
    definition: Callable[[str], str] = lambda body: indented(body, "    ", "  : ")
    table: Callable[[list[str], list[list[str]], list[str], str], str] | None = None
    note: Callable[[int, str], tuple[str, str]] = lambda n, body: (f"[{n}]", f"[{n}] {body}")
    quotes: bool = True
    raw: tuple[str, ...] = ()
    lines: Callable[[list[str]], str] = lambda xs: "\n".join(xs)
    div: Callable[[str, list], str] = lambda body, a: body
    soft: str = "\n"  # a line end of the source
    own_ids: bool = False  # headings show only identifiers that don't follow from their text
    list_around: Callable[[str, bool], str] = lambda body, ordered: body


def indented(text: str, by: str, first: str | None = None) -> str:
    lines = text.split("\n")
    return "\n".join(((first if i == 0 and first is not None else by) + x).rstrip() if x or i == 0 else x for i, x in enumerate(lines))


def grid(head: list[str], rows: list[list[str]]) -> str:
    """An ASCII grid table."""
    every = ([head] if any(head) else []) + rows
    widths = [max([max(map(len, (r[i] if i < len(r) else "").split("\n"))) for r in every] + [1]) for i in range(len(every[0]) if every else 0)]
    edge = lambda ch: "+" + "+".join(ch * (w + 2) for w in widths) + "+"
    out = [edge("-")]
    for k, r in enumerate(every):
        cols = [(r[i] if i < len(r) else "").split("\n") for i in range(len(widths))]
        for j in range(max(map(len, cols))):
            out.append("|" + "|".join(f" {c[j] if j < len(c) else '':<{w}} " for c, w in zip(cols, widths, strict=True)) + "|")
        out.append(edge("=" if k == 0 and any(head) else "-"))
    return "\n".join(out)


class Renderer:
    def __init__(self, f: Format) -> None:
        self.f, self.notes, self.depth = f, [], 0

    def inline(self, n: dict) -> str:
        t, c, f = n["t"], n.get("c"), self.f
        if t == "Str":
            return f.escape(c)
        if t == "Run":
            return " ".join(map(f.escape, c.split(" ")))
        if t in ("Space", "SoftBreak"):
            return " " if t == "Space" else f.soft
        if t == "LineBreak":
            return f.line_break
        if t in ("Emph", "Strong", "Underline", "Strikeout", "Superscript", "Subscript", "SmallCaps"):
            a, b = f.marks.get(t, ("", ""))
            inner = self.inlines(c)
            # Marks stand at the words, not at blanks.
            core = inner.strip(" \n")
            return inner.replace(core, a + core + b, 1) if core else inner
        if t == "Quoted":
            a, b = QUOTES[c[0]["t"]] if f.quotes else {"SingleQuote": ("'", "'"), "DoubleQuote": ('"', '"')}[c[0]["t"]]
            return a + self.inlines(c[1]) + b
        if t == "Code":
            return f.code(c[1])
        if t == "Math":
            a, b = f.math if c[0]["t"] == "InlineMath" else f.display
            return a + c[1] + b
        if t == "RawInline":
            return c[1] if c[0] in f.raw else ""
        if t == "Link":
            return f.link(self.inlines(c[1]), c[2][0], c[2][1])
        if t == "Image":
            return f.image(self.inlines(c[1]), c[2][0], c[2][1])
        if t == "Note":
            k = len(self.notes)
            self.notes.append("")
            mark, self.notes[k] = f.note(k + 1, self.blocks(c))
            return mark
        if t in ("Span", "Cite"):
            return self.inlines(c[1])
        return ""

    def inlines(self, xs: list[dict]) -> str:
        return "".join(map(self.inline, xs))

    def blocks(self, xs: list[dict], tight: bool = False) -> str:
        out = [y for y in map(self.block, xs) if y is not None]
        return ("\n" if tight else "\n\n").join(out)

    def item(self, mark: str, body: list[dict], tight: bool) -> str:
        self.depth += 1
        text = self.blocks(body, tight)
        self.depth -= 1
        return indented(text, " " * len(mark), mark) if self.f.hanging else mark + text

    def block(self, n: dict) -> str | None:
        t, c, f = n["t"], n.get("c"), self.f
        if t in ("Para", "Plain"):
            return self.inlines(c)
        if t == "Header":
            a = ["", *c[1][1:]] if f.own_ids and c[1][0] == identifier(plain(c[2])) else c[1]
            return f.header(c[0], self.inlines(c[2]).replace("\n", " "), a)
        if t == "CodeBlock":
            return f.code_block(c[1], c[0][1])
        if t == "BlockQuote":
            return f.quote(self.blocks(c))
        if t == "HorizontalRule":
            return f.rule
        if t == "RawBlock":
            return c[1] if c[0] in f.raw else None
        if t == "Div":
            return f.div(self.blocks(c[1]), c[0])
        if t == "Figure":
            caption = self.blocks(c[1][1])
            return "\n\n".join(x for x in (self.blocks(c[2]), caption) if x)
        if t == "LineBlock":
            return f.lines([self.inlines(x) for x in c])
        if t in ("BulletList", "OrderedList"):
            items = c if t == "BulletList" else c[1]
            tight = all(not i or i[0]["t"] != "Para" for i in items)
            out = []
            for k, i in enumerate(items):
                mark = f.bullet(self.depth + 1) if t == "BulletList" else f.number(self.depth + 1, c[0][0] + k, c[0][1]["t"])
                out.append(self.item(mark, i, tight))
            return f.list_around(("\n" if tight else "\n\n").join(out), t == "OrderedList")
        if t == "DefinitionList":
            return "\n\n".join("\n".join([f.term(self.inlines(term)), *[f.definition(self.blocks(d)) for d in defs]]) for term, defs in c)
        if t == "Table":
            head, rows = [], {}
            for part, row, cell in cells(n):
                text = self.blocks(cell[4], True)
                (head if part == "head" and row == 0 else rows.setdefault(row, [])).extend([text] + [""] * (cell[3] - 1))
            aligns = [s[0]["t"] for s in c[2]]
            caption = self.blocks(c[1][1])
            if f.table:
                return f.table(head, list(rows.values()), aligns, caption)
            return grid(head, list(rows.values())) + (f"\n\n: {caption}" if caption else "")
        return None

    def document(self, doc: dict) -> str:
        body = self.blocks(doc["blocks"])
        notes = [x for x in self.notes if x]
        return "\n\n".join([x for x in (body, *notes) if x]) + "\n"


def pipes(head: list[str], rows: list[list[str]], aligns: list[str], caption: str) -> str:
    """A pipe table."""
    flat = lambda r: [x.replace("\n", " ").replace("|", "\\|") for x in r]
    n = len(aligns)
    every = [flat(head) or [""] * n, *map(flat, rows)]
    every = [r + [""] * (n - len(r)) for r in every]
    widths = [max(3, *(len(r[i]) for r in every)) for i in range(n)]
    line = lambda r: "| " + " | ".join(f"{x:<{w}}" for x, w in zip(r, widths, strict=True)) + " |"
    mark = {"AlignLeft": lambda w: ":" + "-" * (w + 1), "AlignRight": lambda w: "-" * (w + 1) + ":", "AlignCenter": lambda w: ":" + "-" * w + ":", "AlignDefault": lambda w: "-" * (w + 2)}
    sep = "|" + "|".join(mark[a](w) for a, w in zip(aligns, widths, strict=True)) + "|"
    return "\n".join([line(every[0]), sep, *map(line, every[1:])]) + (f"\n\n: {caption}" if caption else "")


def _chars(signs: str, by: str = "\\") -> Callable[[str], str]:
    return lambda s: "".join(by + ch if ch in signs else ch for ch in s)


def _ticks(s: str) -> str:
    n = 1
    while "`" * n in s:
        n += 1
    pad = " " if s.startswith("`") or s.endswith("`") else ""
    return "`" * n + pad + s + pad + "`" * n


def _attrs(a: list) -> str:
    inner = " ".join([*(["#" + a[0]] if a[0] else []), *("." + x for x in a[1]), *(f'{k}="{v}"' for k, v in a[2])])
    return "{" + inner + "}" if inner else ""


def _fence(text: str, classes: list) -> str:
    n = 3
    while "`" * n in text:
        n += 1
    return f"{'`' * n}{' ' + classes[0] if classes else ''}\n{text}\n{'`' * n}"


def _titled(url: str, title: str) -> str:
    return f'{url} "{title}"' if title else url


def _rows(mark: str, head_mark: str | None = None) -> Callable:
    """Tables of wikis: a line for each row."""
    h = head_mark or mark
    flat = lambda r: [x.replace("\n", " ") for x in r]

    def table(head: list[str], rows: list[list[str]], aligns: list[str], caption: str) -> str:
        out = [h + " " + f" {h} ".join(flat(head)) + " " + h] if any(head) else []
        return "\n".join(out + [mark + " " + f" {mark} ".join(flat(r)) + " " + mark for r in rows])

    return table


def _wikitable(head, rows, aligns, caption) -> str:
    out = ['{| class="wikitable"'] + ([f"|+ {caption}"] if caption else [])
    if any(head):
        out += ["|-"] + [f"! {x}" for x in head]
    for r in rows:
        out += ["|-"] + [f"| {x}" for x in r]
    return "\n".join([*out, "|}"])


def _org_table(head, rows, aligns, caption) -> str:
    line = lambda r: "| " + " | ".join(x.replace("\n", " ") for x in r) + " |"
    return "\n".join(([f"#+caption: {caption}"] if caption else []) + ([line(head), "|" + "+".join("-" * 3 for _ in aligns) + "|"] if any(head) else []) + [line(r) for r in rows])


def _adoc_table(head, rows, aligns, caption) -> str:
    out = ([f".{caption}"] if caption else []) + (["[options=\"header\",]"] if any(head) else []) + ["|==="]
    return "\n".join(out + ["".join(f"|{x} " for x in r).rstrip() for r in ([head] if any(head) else []) + rows] + ["|==="])


def _tag(name: str) -> tuple[str, str]:
    return f"<{name}>", f"</{name}>"


_UNDER = {1: "=", 2: "-", 3: "~", 4: "^", 5: "'", 6: '"'}
_md = dict(
    escape=_chars("\\`*_[]<>$^~#|"), code=_ticks, raw=("html", "markdown"), rule="-" * 72, line_break="\\\n", hanging=True, code_block=_fence,
    link=lambda text, url, title: f"<{url}>" if text == url else f"[{text}]({_titled(url, title)})", image=lambda text, url, title: f"![{text}]({_titled(url, title)})",
    header=lambda level, text, a: "#" * level + " " + text + (" " + _attrs(["", a[1], a[2]]) if a[1] or a[2] else ""), quote=lambda body: indented(body, "> "), bullet=lambda d: "- ", number=lambda d, n, s: f"{n}. ".ljust(4), quotes=False,
    table=pipes, note=lambda n, body: (f"[^{n}]", f"[^{n}]: " + indented(body, "    ", "")), definition=lambda body: indented(body, "    ", ":   "), lines=lambda xs: "\n".join("| " + x for x in xs), div=lambda body, a: f"::: {_attrs(a)}\n{body}\n:::" if _attrs(a) else body,
)
_md_marks = {"Emph": ("*", "*"), "Strong": ("**", "**"), "Strikeout": ("~~", "~~"), "Superscript": ("^", "^"), "Subscript": ("~", "~"), "Underline": ("[", "]{.underline}"), "SmallCaps": ("[", "]{.smallcaps}")}
_html_marks = _md_marks | {"Superscript": _tag("sup"), "Subscript": _tag("sub"), "Underline": _tag("u"), "SmallCaps": ("", "")}
_cm = _md | {"header": lambda level, text, a: "#" * level + " " + text, "div": lambda body, a: f"<div>\n\n{body}\n\n</div>" if _attrs(a) else body, "escape": _chars("\\`*_[]<>#")}

FORMATS: dict[str, Format] = {
    "markdown": Format(marks=_md_marks, **_md),
    "commonmark": Format(marks=_html_marks | {"Strikeout": _tag("s")}, **_cm),
    "commonmark_x": Format(marks=_md_marks, **_md),
    "gfm": Format(marks=_html_marks, **_cm),
    "markdown_github": Format(marks=_html_marks, **_cm),
    "markdown_strict": Format(marks=_html_marks, **(_cm | {"line_break": "  \n", "code_block": lambda text, classes: indented(text, "    ")})),
    "markdown_phpextra": Format(marks=_html_marks, **(_cm | {"line_break": "  \n"})),
    "markdown_mmd": Format(marks=_md_marks, **(_cm | {"line_break": "  \n"})),
    "markua": Format(marks=_md_marks, **(_cm | {"header": lambda level, text, a: (f"{{id: {a[0]}}}\n" if a[0] else "") + "#" * level + " " + text, "bullet": lambda d: "* ", "rule": "* * *", "soft": " "})),
    "plain": Format(marks={"Emph": ("_", "_")}, quote=lambda body: indented(body, "  "), link=lambda t, u, x: t, image=lambda t, u, x: f"[{t}]" if t else "", number=lambda d, n, s: f"{n}. ".ljust(4)),
    "ansi": Format(marks={"Emph": ("\x1b[3m", "\x1b[23m"), "Strong": ("\x1b[1m", "\x1b[22m"), "Underline": ("\x1b[4m", "\x1b[24m"), "Strikeout": ("\x1b[9m", "\x1b[29m")}, header=lambda level, text, a: f"\x1b[1m{text}\x1b[22m", code=lambda s: f"\x1b[7m{s}\x1b[27m", link=lambda t, u, x: f"\x1b]8;;{u}\x1b\\{t}\x1b]8;;\x1b\\", quote=lambda b: indented(b, "│ ")),
    "rst": Format(
        marks={"Emph": ("*", "*"), "Strong": ("**", "**"), "Superscript": (":sup:`", "`"), "Subscript": (":sub:`", "`")}, escape=_chars("\\*`|"), code=lambda s: f"``{s}``", link=lambda t, u, x: u if t == u else f"`{t} <{u}>`__", image=lambda t, u, x: f"|{t or u}|",
        header=lambda level, text, a: f"{text}\n{_UNDER[min(level, 6)] * max(len(text), 1)}", code_block=lambda text, classes: (f".. code:: {classes[0]}\n\n" if classes else "::\n\n") + indented(text, "   "), quote=lambda b: indented(b, "   "), number=lambda d, n, s: f"{n}. ", math=(":math:`", "`"), display=(":math:`", "`"), note=lambda n, b: (f" [{n}]_", f".. [{n}]\n" + indented(b, "   ")), definition=lambda b: indented(b, "   "), lines=lambda xs: "\n".join("| " + x for x in xs), raw=("rst",), rule="-" * 14),
    "org": Format(
        marks={"Emph": ("/", "/"), "Strong": ("*", "*"), "Underline": ("_", "_"), "Strikeout": ("+", "+"), "Superscript": ("^{", "}"), "Subscript": ("_{", "}")}, code=lambda s: f"={s}=", link=lambda t, u, x: f"[[{u}]]" if t == u else f"[[{u}][{t}]]", image=lambda t, u, x: f"[[{u}]]",
        header=lambda level, text, a: "*" * level + " " + text + (f"\n:PROPERTIES:\n:CUSTOM_ID: {a[0]}\n:END:" if a[0] else ""), code_block=lambda text, classes: f"#+begin_src {classes[0]}\n{indented(text, '  ')}\n#+end_src" if classes else f"#+begin_example\n{indented(text, '  ')}\n#+end_example", quote=lambda b: f"#+begin_quote\n{b}\n#+end_quote", rule="-" * 14, line_break="\\\\\n", math=("\\(", "\\)"), display=("\\[", "\\]"), table=_org_table, note=lambda n, b: (f"[fn:{n}]", f"[fn:{n}] {b}"), term=lambda t: f"- {t} ::", definition=lambda b: indented(b, "  "), lines=lambda xs: "#+begin_verse\n" + "\n".join(xs) + "\n#+end_verse", raw=("org",)),
    "mediawiki": Format(soft=" ", marks={"Emph": ("''", "''"), "Strong": ("'''", "'''"), "Underline": _tag("u"), "Strikeout": _tag("s"), "Superscript": _tag("sup"), "Subscript": _tag("sub")}, code=lambda s: f"<code>{s}</code>", link=lambda t, u, x: f"[{u} {t}]" if "://" in u else f"[[{u}|{t}]]", image=lambda t, u, x: f"[[File:{u}|{t}]]", header=lambda level, text, a: "=" * level + " " + text + " " + "=" * level, code_block=lambda text, classes: f'<syntaxhighlight lang="{classes[0]}">{text}</syntaxhighlight>' if classes else f"<pre>{text}</pre>", quote=lambda b: f"<blockquote>{b}\n</blockquote>", rule="-----", line_break="<br />\n", bullet=lambda d: "*" * d + " ", number=lambda d, n, s: "#" * d + " ", hanging=False, math=("<math display=\"inline\">", "</math>"), display=("<math display=\"block\">", "</math>"), table=_wikitable, note=lambda n, b: (f"<ref>{b}</ref>", ""), term=lambda t: f"; {t}", definition=lambda b: f": {b}", raw=("mediawiki", "html")),
    "dokuwiki": Format(soft=" ", marks={"Emph": ("//", "//"), "Strong": ("**", "**"), "Underline": ("__", "__"), "Strikeout": _tag("del"), "Superscript": _tag("sup"), "Subscript": _tag("sub")}, code=lambda s: f"''%%{s}%%''", link=lambda t, u, x: f"[[{u}|{t}]]", image=lambda t, u, x: f"{{{{{u}|{t}}}}}", header=lambda level, text, a: "=" * (7 - level) + " " + text + " " + "=" * (7 - level), code_block=lambda text, c: f"<code{' ' + c[0] if c else ''}>\n{text}\n</code>", quote=lambda b: indented(b, "> "), rule="----", line_break="\\\\\n", bullet=lambda d: "  " * d + "* ", number=lambda d, n, s: "  " * d + "- ", hanging=False, table=_rows("|", "^"), note=lambda n, b: (f"(({b}))", ""), raw=("dokuwiki",)),
    "zimwiki": Format(soft=" ", marks={"Emph": ("//", "//"), "Strong": ("**", "**"), "Underline": ("__", "__"), "Strikeout": ("~~", "~~"), "Superscript": ("^{", "}"), "Subscript": ("_{", "}")}, code=lambda s: f"''{s}''", link=lambda t, u, x: f"[[{u}|{t}]]", image=lambda t, u, x: f"{{{{{u}}}}}", header=lambda level, text, a: "=" * (7 - level) + " " + text + " " + "=" * (7 - level), code_block=lambda text, c: f"'''\n{text}\n'''", quote=lambda b: indented(b, "> "), rule="----", bullet=lambda d: "\t" * (d - 1) + "* ", number=lambda d, n, s: "\t" * (d - 1) + f"{n}. ", hanging=False, table=_rows("|")),
    "xwiki": Format(soft=" ", marks={"Emph": ("//", "//"), "Strong": ("**", "**"), "Underline": ("__", "__"), "Strikeout": ("--", "--"), "Superscript": ("^^", "^^"), "Subscript": (",,", ",,")}, code=lambda s: f"##{s}##", link=lambda t, u, x: f"[[{t}>>{u}]]", image=lambda t, u, x: f"[[image:{u}]]", header=lambda level, text, a: "=" * level + " " + text + " " + (f'{{{{id name="{a[0]}" /}}}}' if a[0] else "") + "=" * level, code_block=lambda text, c: f"{{{{code{' language=' + chr(34) + c[0] + chr(34) if c else ''}}}}}\n{text}\n{{{{/code}}}}", quote=lambda b: indented(b, "> "), rule="----", bullet=lambda d: "*" * d + " ", number=lambda d, n, s: "1" * d + ". ", hanging=False, table=_rows("|", "|="), note=lambda n, b: (f"{{{{footnote}}}}{b}{{{{/footnote}}}}", "")),
    "textile": Format(soft=" ", quotes=False, marks={"Emph": ("_", "_"), "Strong": ("*", "*"), "Underline": ("+", "+"), "Strikeout": ("-", "-"), "Superscript": ("^", "^"), "Subscript": ("~", "~")}, code=lambda s: f"@{s}@", link=lambda t, u, x: f'"{t}":{u}', image=lambda t, u, x: f"!{u}({t})!" if t else f"!{u}!", header=lambda level, text, a: f"h{level}" + (f"(#{a[0]})" if a[0] else "") + f". {text}", code_block=lambda text, c: f"bc. {text}", quote=lambda b: f"bq. {b}", rule="<hr />", bullet=lambda d: "*" * d + " ", number=lambda d, n, s: "#" * d + " ", hanging=False, table=_rows("|"), note=lambda n, b: (f"[{n}]", f"fn{n}. {b}")),
    "jira": Format(soft=" ", marks={"Emph": ("_", "_"), "Strong": ("*", "*"), "Underline": ("+", "+"), "Strikeout": ("-", "-"), "Superscript": ("^", "^"), "Subscript": ("~", "~")}, code=lambda s: f"{{{{{s}}}}}", link=lambda t, u, x: f"[{t}|{u}]" if t != u else f"[{u}]", image=lambda t, u, x: f"!{u}!", header=lambda level, text, a: f"h{level}. " + (f"{{anchor:{a[0]}}}" if a[0] else "") + text, code_block=lambda text, c: f"{{code{':' + c[0] if c else ''}}}\n{text}\n{{code}}", quote=lambda b: f"{{quote}}\n{b}\n{{quote}}", rule="----", bullet=lambda d: "*" * d + " ", number=lambda d, n, s: "#" * d + " ", hanging=False, table=_rows("|", "||")),
    "asciidoc": Format(own_ids=True, marks={"Emph": ("_", "_"), "Strong": ("*", "*"), "Underline": ("[.underline]#", "#"), "Strikeout": ("[line-through]*", "*"), "Superscript": ("^", "^"), "Subscript": ("~", "~")}, code=lambda s: f"`{s}`", link=lambda t, u, x: u if t == u else f"{u}[{t}]" if "://" in u else f"link:{u}[{t}]", image=lambda t, u, x: f"image:{u}[{t}]", header=lambda level, text, a: (f"[[{a[0]}]]\n" if a[0] else "") + "=" * (level + 1) + " " + text, code_block=lambda text, c: (f"[source,{c[0]}]\n" if c else "") + f"----\n{text}\n----", quote=lambda b: f"____\n{b}\n____", rule="'''''", line_break=" +\n", bullet=lambda d: "*" * d + " ", number=lambda d, n, s: "." * d + " ", hanging=False, math=("latexmath:[", "]"), display=("latexmath:[", "]"), table=_adoc_table, note=lambda n, b: (f"footnote:[{b}]", ""), term=lambda t: f"{t}::", definition=lambda b: indented(b, "  ")),
    "muse": Format(marks={"Emph": ("*", "*"), "Strong": ("**", "**"), "Strikeout": _tag("del"), "Superscript": _tag("sup"), "Subscript": _tag("sub"), "Underline": ("_", "_")}, code=lambda s: f"<code>{s}</code>", link=lambda t, u, x: f"[[{u}][{t}]]", image=lambda t, u, x: f"[[{u}][{t}]]", header=lambda level, text, a: "*" * level + " " + text, code_block=lambda text, c: f"<example>\n{text}\n</example>", quote=lambda b: f"<quote>\n{b}\n</quote>", bullet=lambda d: " - ", table=_rows("|", "||"), term=lambda t: f" {t} ::"),
    "t2t": Format(soft=" ", marks={"Emph": ("//", "//"), "Strong": ("**", "**"), "Underline": ("__", "__"), "Strikeout": ("--", "--")}, code=lambda s: f"``{s}``", link=lambda t, u, x: f"[{t} {u}]", image=lambda t, u, x: f"[{u}]", header=lambda level, text, a: "=" * level + " " + text + " " + "=" * level, code_block=lambda text, c: f"```\n{text}\n```", quote=lambda b: indented(b, "\t"), number=lambda d, n, s: "+ ", table=_rows("|", "||")),
    "djot": Format(marks={"Emph": ("_", "_"), "Strong": ("*", "*"), "Underline": ("[", "]{.underline}"), "Strikeout": ("{-", "-}"), "Superscript": ("^", "^"), "Subscript": ("~", "~")}, **{k: v for k, v in _md.items() if k not in ("div",)}),
    "haddock": Format(marks={"Emph": ("/", "/"), "Strong": ("__", "__")}, code=lambda s: f"@{s}@", link=lambda t, u, x: f"<{u} {t}>" if t != u else f"<{u}>", image=lambda t, u, x: f"<<{u} {t}>>" if t else f"<<{u}>>", bullet=lambda d: "-   ", header=lambda level, text, a: "=" * level + " " + text + (f"\n#{a[0]}#" if a[0] else ""), code_block=lambda text, c: indented(text, "> ", "> "), number=lambda d, n, s: f"({n}) ", math=("\\(", "\\)"), display=("\\[", "\\]"), term=lambda t: f"[{t}]:"),
    "vimdoc": Format(marks={"Emph": ("_", "_")}, code=lambda s: f"`{s}`", link=lambda t, u, x: u if t == u else f"{t} {u}", header=lambda level, text, a: (("=" if level == 1 else "-") * 80 + "\n" if level < 3 else "") + (text.upper() if level == 3 else text) + (f"*{a[0]}*".rjust(max(80 - len(text), len(a[0]) + 3)) if a[0] else ""), code_block=lambda text, c: f">{c[0] if c else ''}\n{indented(text, '    ')}\n<"),
    "typst": Format(marks={"Emph": ("#emph[", "]"), "Strong": ("#strong[", "]"), "Underline": ("#underline[", "]"), "Strikeout": ("#strike[", "]"), "Superscript": ("#super[", "]"), "Subscript": ("#sub[", "]"), "SmallCaps": ("#smallcaps[", "]")}, escape=_chars("\\`*_[]<>$#@~"), code=lambda s: f"`{s}`", link=lambda t, u, x: f'#link("{u}")[{t}]', image=lambda t, u, x: f'#image("{u}")', header=lambda level, text, a: "=" * level + " " + text + (f"\n<{a[0]}>" if a[0] else ""), code_block=lambda text, c: f"```{c[0] if c else ''}\n{text}\n```", quote=lambda b: f"#quote(block: true)[\n{b}\n]", rule="#horizontalrule", line_break="#linebreak()\n", number=lambda d, n, s: "+ ", display=("$ ", " $"), note=lambda n, b: (f"#footnote[{b}]", ""), term=lambda t: f"/ {t}: #block[", definition=lambda b: f"{b}\n]", table=lambda h, rows, a, cap: f"#table(\n  columns: {len(a)},\n" + (("  table.header(" + ", ".join(f"[{x}]" for x in h) + "),\n") if any(h) else "") + "".join("  " + ", ".join(f"[{x}]" for x in r) + ",\n" for r in rows) + ")"),
}
FORMATS |= {"asciidoctor": FORMATS["asciidoc"], "asciidoc_legacy": FORMATS["asciidoc"]}


def _bbcode(**more) -> Format:
    base = dict(
        marks={"Emph": ("[i]", "[/i]"), "Strong": ("[b]", "[/b]"), "Underline": ("[u]", "[/u]"), "Strikeout": ("[s]", "[/s]"), "Superscript": ("[sup]", "[/sup]"), "Subscript": ("[sub]", "[/sub]")}, code=lambda s: f"[code]{s}[/code]", link=lambda t, u, x: f"[url={u}]{t}[/url]" if t != u else f"[url]{u}[/url]", image=lambda t, u, x: f"[img]{u}[/img]",
        header=lambda level, text, a: ["[u][b]{}[/b][/u]", "[b]{}[/b]", "[u]{}[/u]", "{}"][min(level, 4) - 1].format(text), soft=" ", list_around=lambda body, ordered: f"[list{'=1' if ordered else ''}]\n{body}\n[/list]", quotes=False, code_block=lambda text, c: f"[code{'=' + c[0] if c else ''}]{text}\n[/code]", quote=lambda b: f"[quote]\n{b}\n[/quote]", rule="* * *", bullet=lambda d: "[*]", number=lambda d, n, s: "[*]", hanging=False,
    )
    return Format(**(base | more))


FORMATS |= {
    "bbcode": _bbcode(),
    "bbcode_steam": _bbcode(header=lambda level, text, a: f"[h{min(level, 3)}]{text}[/h{min(level, 3)}]", rule="[hr][/hr]"),
    "bbcode_phpbb": _bbcode(),
    "bbcode_fluxbb": _bbcode(header=lambda level, text, a: f"[h]{text}[/h]"),
    "bbcode_hubzilla": _bbcode(header=lambda level, text, a: f"[h{level}]{text}[/h{level}]", rule="[hr]"),
    "bbcode_xenforo": _bbcode(header=lambda level, text, a: f"[HEADING={min(level, 3)}]{text}[/HEADING]", rule="[hr][/hr]"),
}


def render(doc: dict, name: str) -> str:
    return Renderer(FORMATS[name]).document(doc)
