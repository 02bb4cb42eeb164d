"""Light markup to tree: one reader that goes a line at a time, and for each language a table of its marks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

from leafmill.tree import BREAK, NO_ATTR, attr, bare, headers, node, plain, run, simple_table, trimmed, unique_identifiers, words


@dataclass
class Language:
    """pairs: (opening mark, closing mark, node type); marks are plain text. Patterns are regular expressions on a line."""

    pairs: list[tuple[str, str, str]] = field(default_factory=list)
    code: list[tuple[str, str]] = field(default_factory=list)
    links: list[tuple[str, Callable[[re.Match], tuple[str, str] | None]]] = field(default_factory=list)
    images: list[tuple[str, Callable[[re.Match], tuple[str, str]]]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    heading: Callable[[str], tuple[int, str] | None] = lambda line: None
    under: str = ""  # characters that underline headings, best first
    bullet: str = ""  # group 1 is the mark, its length or indent the depth
    number: str = ""
    flat: bool = False  # depth by the mark's length, not by indent
    fences: list[tuple[str, str, int]] = field(default_factory=list)  # opening, closing, group with the language (0: none)
    quotes: list[tuple[str, str]] = field(default_factory=list)
    quote_line: str = ""
    rule: str = r"-{4,}\s*$"
    row: str = ""  # what cells stand between
    head: str = ""  # what head cells stand between
    term: str = ""  # groups: term, definition
    comment: str = ""
    raw_fences: list[tuple[str, str, str]] = field(default_factory=list)
    line_break: str = ""
    indent_code: bool = False
    clean: Callable[[str], str] = lambda s: s
    tables: list[tuple[str, str]] = field(default_factory=list)
    word_bound: bool = False
    idents: str = "text"  # what headings are called: text, none, under or sections
    smart: bool = False  # quotes, dashes and dots are set
    hard: bool = False  # a line end is a line break


@lru_cache(256)
def _signs(openings: tuple[str, ...]) -> tuple[re.Pattern, list[str]]:
    """What is no sign: no mark has it, and no pattern of a link, image, note or break matches without a sign. And the marks of letters, spaces and commas alone: without signs no block begins, and no inline but by these."""
    marks = "".join(p[0] for p in openings)
    sign = re.compile(r"[^\w\s" + "".join(c for c in ",.;" if c not in marks) + "]") if not re.search(r"[^\W_]|\s", marks) else re.compile("")
    return sign, [p for p in openings if bare(p) or not p.strip(" ,")]


@lru_cache(256)
def _compiled(patterns: tuple[str, ...]) -> list[re.Pattern]:
    return [re.compile(p) for p in patterns]


class Reader:
    def __init__(self, lang: Language) -> None:
        self.lang = lang
        self.sign, self.own = _signs(tuple(p[0] for p in [*lang.pairs, *lang.code]))
        self.quick = bool(self.sign.pattern) and not lang.under
        self.footnotes: dict[str, list[dict]] = {}
        self.underlines: list[str] = []  # marks of headings in the order in which they appear, the level of each its place

    # --- inlines ----------------------------------------------------------------------------------------------------

    def inlines(self, text: str) -> list[dict]:
        lang, out, buffer, i = self.lang, [], "", 0
        if self.bare(text) or not self.sign.search(text) and "_" not in text:
            return words(lang.clean(text))
        firsts = {p[0][0] for p in lang.pairs} | {c[0][0] for c in lang.code}

        def flush() -> None:
            nonlocal buffer
            if buffer:
                out.extend(words(lang.clean(buffer)))
                buffer = ""

        shown = [*lang.links, *lang.images]
        patterns = [(p, f, "Link" if k < len(lang.links) else "Image") for k, (p, (_, f)) in enumerate(zip(_compiled(tuple(p for p, _ in shown)), shown, strict=True))]
        notes = _compiled(tuple(lang.notes))
        brk = re.compile(lang.line_break) if lang.line_break else None
        every = [*([brk] if brk else []), *notes, *(p for p, _, _ in patterns)]
        starts = [-1] * len(every)  # where each of them matches next
        first = re.compile("[" + re.escape("".join(sorted(firsts))) + "]").search if firsts else lambda *_: None
        while i < len(text):
            for k, p in enumerate(every):
                if starts[k] < i:
                    starts[k] = m.start() if (m := p.search(text, i)) else len(text)
            m = first(text, i)
            nearest = min([m.start() if m else len(text), *starts])
            if nearest > i:  # nothing can begin before
                buffer += text[i:nearest]
                i = nearest
                continue
            found = None
            if brk and (m := brk.match(text, i)):
                found = [BREAK], m.end()
            for p in notes:
                if not found and (m := p.match(text, i)):
                    key = m[1]
                    body = self.footnotes.get(key) if key in self.footnotes else [node("Para", trimmed(self.inlines(key)))]
                    found = [node("Note", body)], m.end()
            if not found and text[i] in firsts:
                for a, b in lang.code:
                    if text.startswith(a, i) and (end := text.find(b, i + len(a))) > i + len(a) - 1 and end > i:
                        found = [node("Code", NO_ATTR, text[i + len(a) : end])], end + len(b)
                        break
            if not found:
                for p, f, kind in patterns:
                    m = p.match(text, i)
                    got = m and f(m)
                    if got:
                        url, shown = got
                        inner = self.inlines(shown) if kind == "Link" and shown != url else words(shown)
                        found = [node(kind, NO_ATTR, inner, [url, ""])], m.end()
                        break
            if not found and text[i] in firsts:
                for a, b, kind in lang.pairs:
                    if not text.startswith(a, i):
                        continue
                    if lang.word_bound and i and text[i - 1].isalnum():
                        continue
                    after = text[i + len(a) : i + len(a) + 1]
                    end = self.close(text, i + len(a), b)
                    if after and not after.isspace() and end > i + len(a):
                        found = [node(kind, self.inlines(text[i + len(a) : end]))], end + len(b)
                        break
            if found:
                flush()
                out += found[0]
                i = found[1]
            else:
                buffer += text[i]
                i += 1
        flush()
        return out

    def bare(self, text: str) -> bool:
        """Whether a text has only letters, spaces and commas, and none of them is a mark."""
        if not self.sign.pattern or not bare(text):
            return False
        return not self.own or not any(mark in text for mark in self.own)

    def close(self, text: str, i: int, mark: str) -> int:
        while (end := text.find(mark, i)) >= 0:
            follows = text[end + len(mark) : end + len(mark) + 1]
            if not text[end - 1].isspace() and not (self.lang.word_bound and follows.isalnum()):
                return end
            i = end + 1
        return -1

    # --- blocks -----------------------------------------------------------------------------------------------------

    def blocks(self, lines: list[str]) -> list[dict]:
        lang, out, para, i = self.lang, [], [], 0

        def flush() -> None:
            if para:
                inl = trimmed(self.inlines("\n".join(para)))
                if inl:
                    out.append(node("Para", inl))
                para.clear()

        while i < len(lines):
            line = lines[i]
            if not line.strip():
                flush()
                i += 1
                continue
            if self.quick and line[0].isalpha() and self.bare(line):
                if not para and (i + 1 == len(lines) or not lines[i + 1].strip()) and (one := run(line, known=True)):
                    out.append(node("Para", [one]))
                else:
                    para.append(line.strip())
                i += 1
                continue
            if lang.comment and re.match(lang.comment, line):
                i += 1
                continue
            done = self.fenced(lines, i)
            if done:
                flush()
                out += done[0]
                i = done[1]
                continue
            if head := lang.heading(line):
                flush()
                out.append(node("Header", head[0], NO_ATTR, trimmed(self.inlines(head[1].strip()))))
                i += 1
                continue
            if lang.under and not para and i + 1 < len(lines) and (m := re.match(rf"([{re.escape(lang.under)}])\1+\s*$", lines[i + 1])) and len(lines[i + 1].strip()) >= min(len(line.strip()), 4):
                out.append(self.underlined(m[1], line))
                i += 2
                continue
            if lang.under and not para and i + 2 < len(lines) and re.match(rf"([{re.escape(lang.under)}])\1+\s*$", line) and lines[i + 2].strip() == line.strip():
                out.append(self.underlined(line[0] * 2, lines[i + 1]))
                i += 3
                continue
            if lang.rule and re.match(lang.rule, line):
                flush()
                out.append(node("HorizontalRule"))
                i += 1
                continue
            if self.item(line):
                flush()
                block, i = self.list_at(lines, i)
                out.append(block)
                continue
            if lang.term and (m := re.match(lang.term, line)):
                flush()
                pairs = []
                while i < len(lines) and (m := re.match(lang.term, lines[i])):
                    body = [m[2]]
                    i += 1
                    while i < len(lines) and lines[i][:1] in (" ", "\t") and lines[i].strip() and not re.match(lang.term, lines[i]):
                        body.append(lines[i].strip())
                        i += 1
                    pairs.append([trimmed(self.inlines(m[1].strip())), [[node("Plain", trimmed(self.inlines("\n".join(body))))]]])
                out.append(node("DefinitionList", pairs))
                continue
            if (lang.row and line.lstrip().startswith(lang.row)) or (lang.head and line.lstrip().startswith(lang.head)):
                flush()
                rows, head = [], None
                while i < len(lines) and (lines[i].lstrip().startswith(lang.row) or (lang.head and lines[i].lstrip().startswith(lang.head))):
                    t = lines[i].strip()
                    i += 1
                    if re.fullmatch(r"[|+\-:= ]+", t) and "-" in t:
                        if rows and head is None and len(rows) == 1:
                            head = rows.pop()
                        continue
                    is_head = bool(lang.head) and t.startswith(lang.head) and (lang.head != lang.row)
                    mark = lang.head if is_head else lang.row
                    cells = [c.strip() for c in t.removeprefix(mark).removesuffix(mark).removesuffix(lang.row).split(mark)]
                    row = [[node("Plain", trimmed(self.inlines(c)))] if c else [] for c in cells]
                    if is_head and not rows and head is None:
                        head = row
                    else:
                        rows.append(row)
                out.append(simple_table(head, rows))
                continue
            if lang.quote_line and re.match(lang.quote_line, line):
                flush()
                body = []
                while i < len(lines) and re.match(lang.quote_line, lines[i]):
                    body.append(re.sub(lang.quote_line, "", lines[i], count=1))
                    i += 1
                out.append(node("BlockQuote", self.blocks(body)))
                continue
            if lang.indent_code and not para and line.startswith((" ", "\t")):
                body = []
                while i < len(lines) and (lines[i].startswith((" ", "\t")) or (not lines[i].strip() and i + 1 < len(lines) and lines[i + 1].startswith((" ", "\t")))):
                    body.append(lines[i])
                    i += 1
                cut = min((len(x) - len(x.lstrip()) for x in body if x.strip()), default=0)
                out.append(node("CodeBlock", NO_ATTR, "\n".join(x[cut:] for x in body)))
                continue
            para.append(line.strip())
            i += 1
        flush()
        return out

    def fenced(self, lines: list[str], i: int):
        lang = self.lang
        for a, b, g in lang.fences:
            if m := re.match(a, lines[i]):
                rest = lines[i][m.end() :]
                if (end := re.search(b, rest)) and g >= 0:
                    return [node("CodeBlock", attr("", [m[g]] if g and m[g] else []), rest[: end.start()])], i + 1
                body, j = [rest] if rest.strip() else [], i + 1
                while j < len(lines) and not re.search(b, lines[j]):
                    body.append(lines[j])
                    j += 1
                if j < len(lines) and (tail := lines[j][: re.search(b, lines[j]).start()]).strip():
                    body.append(tail)
                return [node("CodeBlock", attr("", [m[g]] if g > 0 and m[g] else []), "\n".join(body))], j + 1
        for a, b in lang.quotes:
            if m := re.match(a, lines[i]):
                rest = lines[i][m.end() :]
                if end := re.search(b, rest):
                    return [node("BlockQuote", self.blocks([rest[: end.start()]]))], i + 1
                body, j, depth = [rest], i + 1, 1
                while j < len(lines):
                    if re.search(b, lines[j]):
                        depth -= 1
                        if not depth:
                            break
                    elif re.match(a, lines[j]):
                        depth += 1
                    body.append(lines[j])
                    j += 1
                if j < len(lines):
                    body.append(lines[j][: re.search(b, lines[j]).start()])
                return [node("BlockQuote", self.blocks(body))], j + 1
        for a, b, name in lang.raw_fences:
            if re.match(a, lines[i]):
                body, j = [], i + 1
                while j < len(lines) and not re.match(b, lines[j]):
                    body.append(lines[j])
                    j += 1
                return [node("RawBlock", name, "\n".join(body))], j + 1
        return None

    def item(self, line: str):
        """Whether it is a bullet, its depth and its text."""
        for ordered, pattern in ((False, self.lang.bullet), (True, self.lang.number)):
            if pattern and (m := re.match(pattern, line)):
                depth = len(m[1].strip()) if self.lang.flat else len(m[0]) - len(m[0].lstrip())
                return ordered, depth, line[m.end() :], m
        return None

    def list_at(self, lines: list[str], i: int):
        ordered, depth, _, m = self.item(lines[i])
        start = re.search(r"\d+", m[0])
        items: list[list[dict]] = []
        while i < len(lines):
            found = self.item(lines[i])
            if found and found[1] > depth and items:
                block, i = self.list_at(lines, i)
                items[-1].append(block)
                continue
            if not found or found[1] != depth or found[0] != ordered:
                break
            text = [found[2].strip()]
            i += 1
            while i < len(lines) and lines[i].strip() and not self.item(lines[i]) and lines[i][:1] in (" ", "\t"):
                text.append(lines[i].strip())
                i += 1
            if i + 1 < len(lines) and not lines[i].strip() and (nxt := self.item(lines[i + 1])) and nxt[1] >= depth and not self.lang.flat:
                i += 1
            items.append([node("Plain", trimmed(self.inlines("\n".join(text))))])
        return (node("OrderedList", [int(start[0]) if start else 1, {"t": "Decimal" if start else "DefaultStyle"}, {"t": "Period" if start else "DefaultDelim"}], items) if ordered else node("BulletList", items)), i

    def document(self, text: str) -> dict:
        blocks = self.blocks(text.replace("\r", "").expandtabs(8).split("\n"))
        return {"meta": {}, "blocks": named(blocks, self.lang.idents)}

    def underlined(self, mark: str, text: str) -> dict:
        if mark not in self.underlines:
            self.underlines.append(mark)
        return node("Header", self.underlines.index(mark) + 1, NO_ATTR, trimmed(self.inlines(text.strip())))


def named(blocks: list[dict], how: str) -> list[dict]:
    """Headings as a language names them: from their text, not at all, with underscores, or by sections around them."""
    if how == "none":
        return blocks
    if how == "text":
        return unique_identifiers(blocks)
    used: dict[str, int] = {}

    def fresh(base: str) -> str:
        used[base] = used.get(base, 0) + 1
        return base if used[base] == 1 else f"{base}-{used[base] - 1}" if how == "sections" else f"{base}_{used[base]}"

    if how == "under":
        for n in headers(blocks):
            if not n["c"][1][0]:
                base = "_" + re.sub(r"[ .-]+", "_", re.sub(r"[^\w .-]", "", plain(n["c"][2]).lower())).strip("_")
                n["c"] = [n["c"][0], [fresh(base), *n["c"][1][1:]], n["c"][2]]
        return blocks
    out, i = [], 0
    while i < len(blocks):
        if blocks[i]["t"] != "Header":
            out.append(blocks[i])
            i += 1
            continue
        level, a, text = blocks[i]["c"]
        own = fresh(a[0] or re.sub(r"[^\w]+", "-", plain(text)).strip("-") or "s")
        j = i + 1
        while j < len(blocks) and not (blocks[j]["t"] == "Header" and blocks[j]["c"][0] <= level):
            j += 1
        head = node("Header", level, ["", a[1], a[2]], text)
        out.append(node("Div", [own, ["section"], []], [head, *named(blocks[i + 1 : j], how)]))
        i = j
    return out


def _equals(most: int = 6) -> Callable[[str], tuple[int, str] | None]:
    def heading(line: str):
        m = re.match(r"(={1,6})\s*(.*?)\s*=*\s*$", line)
        return (len(m[1]), m[2]) if m and m[2] and len(m[1]) <= most else None

    return heading


def _down(line: str):
    m = re.match(r"\s*(={2,6})\s*(.*?)\s*=*\s*$", line)
    return (7 - len(m[1]), m[2]) if m and m[2] else None


def _marks(sign: str, gap: str = r"\s+") -> Callable[[str], tuple[int, str] | None]:
    def heading(line: str):
        m = re.match(rf"({re.escape(sign)}{{1,6}}){gap}(.*)$", line)
        return (len(m[1]), m[2]) if m else None

    return heading


def _h(line: str):
    m = re.match(r"h([1-6])(?:\([^)]*\))?\.\s+(.*)$", line)
    return (int(m[1]), m[2]) if m else None


def _twiki(line: str):
    m = re.match(r"---(\+{1,6})!*\s*(.*)$", line)
    return (len(m[1]), m[2]) if m else None


def _bang(line: str):
    m = re.match(r"(!{1,6})\s*(.*)$", line)
    return (len(m[1]), m[2]) if m else None


def _org(line: str):
    m = re.match(r"(\*+)\s+(?:(TODO|DONE)\s+)?(.*?)(?:\s+:[\w@:]+:)?\s*$", line)
    return (min(len(m[1]), 6), m[3]) if m and m[3] else None


def _adoc(line: str):
    m = re.match(r"(={1,6})\s+(.*)$", line)
    return (max(len(m[1]) - 1, 1), m[2]) if m else None


def _pod(line: str):
    m = re.match(r"=head([1-6])\s+(.*)$", line)
    return (int(m[1]), m[2]) if m else None


_bar = lambda m: (m[1].strip(), (m[2] or m[1]).strip())
_bare = (r"(?:https?|ftp)://[^\s<>\[\]|]*[^\s<>\[\]|.,;:!?'\")]", lambda m: (m[0], m[0]))
_wiki_link = (r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]", _bar)
_brace = (r"\{\{([^}|]+)(?:\|([^}]*))?\}\}", lambda m: (m[1].strip(), (m[2] or "").strip()))

LANGUAGES = {
    "creole": Language(pairs=[("**", "**", "Strong"), ("//", "//", "Emph")], code=[("{{{", "}}}")], links=[_wiki_link, _bare], images=[_brace], heading=_equals(), bullet=r"\s*(\*+)\s+", number=r"\s*(#+)\s+", flat=True, fences=[(r"\{\{\{\s*$", r"^\}\}\}", 0)], row="|", head="|=", line_break=r"\\\\"),
    "mediawiki": Language(pairs=[("'''''", "'''''", "Strong"), ("'''", "'''", "Strong"), ("''", "''", "Emph"), ("<u>", "</u>", "Underline"), ("<s>", "</s>", "Strikeout"), ("<del>", "</del>", "Strikeout"), ("<sup>", "</sup>", "Superscript"), ("<sub>", "</sub>", "Subscript")], code=[("<code>", "</code>"), ("<nowiki>", "</nowiki>"), ("<tt>", "</tt>")], links=[(r"\[\[(?!File:|Image:)([^\]|]+)(?:\|([^\]]*))?\]\]", _bar), (r"\[((?:https?|ftp|mailto):[^\s\]]+)(?:\s+([^\]]*))?\]", _bar), _bare], images=[(r"\[\[(?:File|Image):([^\]|]+)(?:\|([^\]]*))?\]\]", lambda m: (m[1].strip(), (m[2] or "").rpartition("|")[2]))], notes=[r"<ref(?:\s[^>]*)?>(.*?)</ref>"], heading=_equals(), bullet=r"(\*+)\s*", number=r"(#+)\s*", flat=True, fences=[(r"<(?:syntaxhighlight|source)(?:\s+lang=\"?(\w+)\"?)?[^>]*>", r"</(?:syntaxhighlight|source)>", 1), (r"<pre>", r"</pre>", 0)], quotes=[(r"<blockquote>", r"</blockquote>")], term=r";\s*(.*?)\s*:\s*(.*)$", line_break=r"<br ?/?>", indent_code=True, clean=lambda s: re.sub(r"<!--.*?-->|</?\w+[^>]*>", "", s, flags=re.S)),
    "dokuwiki": Language(pairs=[("**", "**", "Strong"), ("//", "//", "Emph"), ("__", "__", "Underline"), ("<del>", "</del>", "Strikeout"), ("<sup>", "</sup>", "Superscript"), ("<sub>", "</sub>", "Subscript")], code=[("''%%", "%%''"), ("''", "''"), ("%%", "%%")], links=[_wiki_link, _bare], images=[_brace], notes=[r"\(\((.*?)\)\)"], heading=_down, bullet=r"( {2,}\*)\s+", number=r"( {2,}-)\s+", fences=[(r"<(?:code|file)(?:\s+(\w+))?[^>]*>", r"</(?:code|file)>", 1)], quote_line=r">\s?", row="|", head="^", line_break=r"\\\\(?=\s|$)", indent_code=True),
    "vimwiki": Language(pairs=[("*", "*", "Strong"), ("_", "_", "Emph"), ("~~", "~~", "Strikeout"), ("^", "^", "Superscript"), (",,", ",,", "Subscript")], code=[("`", "`")], links=[_wiki_link, _bare], images=[_brace], heading=_equals(), bullet=r"\s*([*-])\s+", number=r"\s*(\d+\.|#)\s+", fences=[(r"\{\{\{\s*(?:class=)?\"?(\w*)\"?.*$", r"^\}\}\}", 1)], row="|", comment=r"%%", word_bound=True, term=r"(.+?)::\s+(.*)$"),
    "textile": Language(pairs=[("**", "**", "Strong"), ("*", "*", "Strong"), ("__", "__", "Emph"), ("_", "_", "Emph"), ("??", "??", "Emph"), ("-", "-", "Strikeout"), ("+", "+", "Underline"), ("^", "^", "Superscript"), ("~", "~", "Subscript")], code=[("@", "@"), ("<code>", "</code>")], links=[(r'"([^"\n]+?)(?:\([^)]*\))?":(\S*[^\s.,;:!?)])', lambda m: (m[2], m[1]))], images=[(r"!([^\s!()]+)(?:\(([^)]*)\))?!", lambda m: (m[1], m[2] or ""))], heading=_h, bullet=r"(\*+)\s+", number=r"(#+)\s+", flat=True, fences=[(r"<pre>(?:<code>)?", r"(?:</code>)?</pre>", 0)], quote_line=r"bq\.\s+", row="|", head="|_.", word_bound=True),
    "jira": Language(pairs=[("*", "*", "Strong"), ("_", "_", "Emph"), ("-", "-", "Strikeout"), ("+", "+", "Underline"), ("^", "^", "Superscript"), ("~", "~", "Subscript"), ("??", "??", "Emph")], code=[("{{", "}}")], links=[(r"\[([^\]|]+)\|([^\]]+)\]", lambda m: (m[2], m[1])), (r"\[((?:https?|mailto):[^\]]+)\]", lambda m: (m[1], m[1])), _bare], images=[(r"!([^\s!|]+)(?:\|[^!]*)?!", lambda m: (m[1], ""))], heading=_h, bullet=r"([*-]+)\s+", number=r"(#+)\s+", flat=True, fences=[(r"\{code(?::(\w+))?[^}]*\}", r"\{code\}", 1), (r"\{noformat\}", r"\{noformat\}", 0)], quotes=[(r"\{quote\}", r"\{quote\}")], quote_line=r"bq\.\s+", row="|", head="||", word_bound=True, line_break=r"\\\\"),
    "twiki": Language(pairs=[("*", "*", "Strong"), ("__", "__", "Strong"), ("_", "_", "Emph")], code=[("=", "=")], links=[(r"\[\[([^\]]+)\](?:\[([^\]]*)\])?\]", _bar), _bare], heading=_twiki, bullet=r"( {3,}\*)\s+", number=r"( {3,}\d+\.?)\s+", fences=[(r"<verbatim>", r"</verbatim>", 0), (r"<pre>", r"</pre>", 0)], row="|", term=r"\s+\$\s+(.*?):\s+(.*)$", word_bound=True, rule=r"-{3,}\s*$"),
    "tikiwiki": Language(pairs=[("__", "__", "Strong"), ("''", "''", "Emph"), ("===", "===", "Underline"), ("--", "--", "Strikeout")], code=[("-+", "+-")], links=[(r"\(\(([^)|]+)(?:\|([^)]*))?\)\)", _bar), (r"\[([^\]|]+)(?:\|([^\]]*))?\]", _bar), _bare], heading=_bang, bullet=r"(\*+)\s*", number=r"(#+)\s*", flat=True, fences=[(r"\{CODE\([^)]*\)\}", r"\{CODE\}", 0)], row="||", term=r";(.*?):(.*)$"),
    "muse": Language(pairs=[("***", "***", "Strong"), ("**", "**", "Strong"), ("*", "*", "Emph"), ("_", "_", "Underline"), ("<em>", "</em>", "Emph"), ("<strong>", "</strong>", "Strong"), ("<del>", "</del>", "Strikeout"), ("<sup>", "</sup>", "Superscript"), ("<sub>", "</sub>", "Subscript")], code=[("=", "="), ("<code>", "</code>")], links=[(r"\[\[([^\]]+)\](?:\[([^\]]*)\])?\]", _bar), _bare], heading=_marks("*"), bullet=r"\s+(-)\s+", number=r"\s+(\d+\.)\s+", fences=[(r"<example>", r"</example>", 0), (r"\{\{\{", r"\}\}\}", 0)], quotes=[(r"<quote>", r"</quote>")], row="|", head="||", term=r"\s+(.+?)\s+::\s+(.*)$", comment=r"; |#\w+ ", word_bound=True),
    "t2t": Language(pairs=[("**", "**", "Strong"), ("//", "//", "Emph"), ("__", "__", "Underline"), ("--", "--", "Strikeout")], code=[("``", "``"), ('""', '""')], links=[(r"\[([^\]\s][^\]]*?)\s+(\S+)\]", lambda m: (m[2], m[1])), _bare], images=[(r"\[([^\]\s]+\.(?:png|jpe?g|gif|svg))\]", lambda m: (m[1], ""))], heading=_equals(), bullet=r"\s*(-)\s+", number=r"\s*(\+)\s+", fences=[(r"```\s*$", r"^```", 0)], quote_line=r"\t| {8}", row="|", head="||", comment=r"%", rule=r"[-=_]{20,}\s*$", term=r":\s+(.*)()$"),
    "haddock": Language(pairs=[("__", "__", "Strong"), ("/", "/", "Emph")], code=[("@", "@"), ("'", "'")], links=[(r"<(\w+:[^\s>]+)(?:\s+([^>]*))?>", _bar), (r"\[([^\]]+)\]\(([^)]+)\)", lambda m: (m[2], m[1])), _bare], images=[(r"<<([^\s>]+)(?:\s+([^>]*))?>>", lambda m: (m[1], m[2] or ""))], heading=_equals(), bullet=r"\s*([*-])\s+", number=r"\s*(\(\d+\)|\d+\.)\s+", fences=[(r"@\s*$", r"^@\s*$", 0)], term=r"\[(.*?)\]:?\s+(.*)$", word_bound=True),
    "asciidoc": Language(pairs=[("**", "**", "Strong"), ("*", "*", "Strong"), ("__", "__", "Emph"), ("_", "_", "Emph"), ("^", "^", "Superscript"), ("~", "~", "Subscript"), ("[.underline]#", "#", "Underline"), ("[line-through]#", "#", "Strikeout")], code=[("`+", "+`"), ("``", "``"), ("`", "`")], links=[(r"(?:link:)?((?:https?|ftp|mailto):[^\s\[\]<>]+)\[([^\]]*)\]", _bar), (r"link:([^\s\[\]]+)\[([^\]]*)\]", _bar), (r"<<([^,>]+)(?:,([^>]*))?>>", lambda m: ("#" + m[1], m[2] or m[1])), _bare], images=[(r"image::?([^\s\[\]]+)\[([^\]]*)\]", lambda m: (m[1], m[2]))], notes=[r"footnote:\[([^\]]*)\]"], heading=_adoc, bullet=r"\s*(\*+|-)\s+", number=r"\s*(\.+|\d+\.)\s+", flat=True, fences=[(r"----+\s*$", r"^----+\s*$", 0), (r"\.\.\.\.+\s*$", r"^\.\.\.\.+\s*$", 0)], quotes=[(r"____+\s*$", r"^____+\s*$")], rule=r"'{3,}\s*$", term=r"(.+?)::\s*(.*)$", comment=r"//|\[[\w,=\"\s-]*\]\s*$|:[\w-]+:", row="|", tables=[(r"\|===", r"\|===")], line_break=r" \+(?=\n|$)", word_bound=True),
    "djot": Language(pairs=[("*", "*", "Strong"), ("_", "_", "Emph"), ("{-", "-}", "Strikeout"), ("{+", "+}", "Underline"), ("^", "^", "Superscript"), ("~", "~", "Subscript"), ("{=", "=}", "Span_mark")], code=[("``", "``"), ("`", "`")], links=[(r"\[([^\]]+)\]\(([^)]*)\)", lambda m: (m[2], m[1])), (r"<((?:https?|mailto):[^>\s]+)>", lambda m: (m[1], m[1]))], images=[(r"!\[([^\]]*)\]\(([^)]*)\)", lambda m: (m[2], m[1]))], heading=_marks("#"), bullet=r"\s*([*+-])\s+", number=r"\s*(\d+[.)])\s+", fences=[(r"`{3,}\s*(\w*)\s*$", r"^`{3,}\s*$", 1), (r"~{3,}\s*(\w*)\s*$", r"^~{3,}\s*$", 1)], quote_line=r">\s?", row="|", rule=r"\s*([*-]\s*){3,}$", line_break=r"\\\n", word_bound=True),
    "typst": Language(pairs=[("*", "*", "Strong"), ("_", "_", "Emph"), ("#emph[", "]", "Emph"), ("#strong[", "]", "Strong"), ("#underline[", "]", "Underline"), ("#strike[", "]", "Strikeout"), ("#super[", "]", "Superscript"), ("#sub[", "]", "Subscript"), ("#smallcaps[", "]", "SmallCaps")], code=[("`", "`")], links=[(r'#link\("([^"]*)"\)(?:\[([^\]]*)\])?', _bar), _bare], images=[(r'#image\("([^"]*)"[^)]*\)', lambda m: (m[1], ""))], notes=[r"#footnote\[([^\]]*)\]"], heading=_marks("="), bullet=r"\s*(-)\s+", number=r"\s*(\+|\d+\.)\s+", fences=[(r"```(\w*)\s*$", r"^```\s*$", 1)], quotes=[(r"#quote(?:\([^)]*\))?\[", r"\]\s*$")], row="|", term=r"/\s+(.*?):\s+(.*)$", comment=r"//|#(?:set|show|let|import)\b", line_break=r"\\(?=\n|$)", word_bound=True),
    "org": Language(pairs=[("*", "*", "Strong"), ("/", "/", "Emph"), ("_", "_", "Underline"), ("+", "+", "Strikeout"), ("^{", "}", "Superscript"), ("_{", "}", "Subscript")], code=[("=", "="), ("~", "~")], links=[(r"\[\[(?!\S+\.(?:png|jpe?g|gif|svg)\]\])([^\]]+)\](?:\[([^\]]*)\])?\]", _bar), _bare], images=[(r"\[\[(?:file:)?([^\]]+\.(?:png|jpe?g|gif|svg))\]\]", lambda m: (m[1], ""))], notes=[r"\[fn:([\w-]+)\]", r"\[fn::([^\]]*)\]"], heading=_org, bullet=r"\s*([+-])\s+", number=r"\s*(\d+[.)])\s+", fences=[(r"\s*#\+(?:begin|BEGIN)_(?:src|SRC)(?:\s+(\w+))?.*$", r"^\s*#\+(?:end|END)_(?:src|SRC)", 1), (r"\s*#\+(?:begin|BEGIN)_(?:example|EXAMPLE).*$", r"^\s*#\+(?:end|END)_(?:example|EXAMPLE)", 0)], quotes=[(r"\s*#\+(?:begin|BEGIN)_(?:quote|QUOTE)\s*$", r"^\s*#\+(?:end|END)_(?:quote|QUOTE)")], raw_fences=[(r"\s*#\+(?:begin|BEGIN)_(?:export|EXPORT)\s+html", r"\s*#\+(?:end|END)_(?:export|EXPORT)", "html"), (r"\s*:PROPERTIES:", r"\s*:END:", "drawer")], row="|", comment=r"\s*#\+\w+:|# ", term=r"\s*[-+]\s+(.+?)\s+::\s+(.*)$", line_break=r"\\\\(?=\n|$)", rule=r"-{5,}\s*$", word_bound=True),
    "rst": Language(pairs=[("**", "**", "Strong"), ("*", "*", "Emph"), (":sup:`", "`", "Superscript"), (":sub:`", "`", "Subscript"), (":emphasis:`", "`", "Emph"), (":strong:`", "`", "Strong")], code=[("``", "``"), (":code:`", "`"), (":literal:`", "`")], links=[(r"`([^`<]*?)\s*<([^`>]+)>`__?", lambda m: (m[2], m[1] or m[2])), _bare], under="=-~^\"'`#*+:._", bullet=r"\s*([*+-])\s+", number=r"\s*(\d+[.)]|#\.|\(\d+\))\s+", fences=[], rule=r"-{4,}\s*$", quote_line=r"(?!)", word_bound=True),
    "pod": Language(heading=_pod, bullet=r"=item\s+(\*)\s*", number=r"=item\s+(\d+)\.?\s*", indent_code=True, comment=r"=(?:over|back|cut|pod|encoding|begin|end|for)\b", rule=""),
}


def read(text: str, name: str) -> dict:
    return Reader(LANGUAGES[name]).document(_prepared(text, name))


def _prepared(text: str, name: str) -> str:
    if name == "pod":
        text = re.sub(r"([BICFLS])<<? ?(.*?) ?>?>", lambda m: {"B": f"\x01b{m[2]}\x01B", "I": f"\x01i{m[2]}\x01I", "F": f"\x01i{m[2]}\x01I", "C": f"\x01c{m[2]}\x01C"}.get(m[1], m[2]), text)
    if name == "typst":
        text = re.sub(r"^(=+ [^\n]*)\n?[ \t]*<[\w:.-]+>[ \t]*$", r"\1", text, flags=re.M)
        text = re.sub(r"#table\(\s*columns:\s*(\d+|\([^)]*\)),?(.*?)\n\)", _typst_rows, text, flags=re.S)
    return text


def _typst_rows(m: re.Match) -> str:
    """A table call as lines of cells, a rule below its head."""
    n = int(m[1]) if m[1].isdigit() else m[1].count(",") + 1
    head = re.search(r"table\.header\((.*?)\)\s*,", m[2], re.S)
    cells = lambda s: re.findall(r"\[((?:[^\[\]]|\[[^\]]*\])*)\]", s)
    line = lambda r: "| " + " | ".join(r) + " |"
    body = cells(m[2][head.end() :] if head else m[2])
    out = [line(cells(head[1])), "|---|"] if head else []
    return "\n".join(out + [line(body[i : i + n]) for i in range(0, len(body), n)])


LANGUAGES["pod"].pairs = [("\x01b", "\x01B", "Strong"), ("\x01i", "\x01I", "Emph")]
LANGUAGES["pod"].code = [("\x01c", "\x01C")]
for _name in ("creole", "jira", "pod", "typst", "dokuwiki"):
    LANGUAGES[_name].idents = "none"
LANGUAGES["asciidoc"].idents = "under"
LANGUAGES["djot"].pairs = [p for p in LANGUAGES["djot"].pairs if p[2] != "Span_mark"]


# --- languages with rules of their own --------------------------------------------------------------------------------


class Rst(Reader):
    """reStructuredText: directives, literal blocks, targets, footnotes, field lists, grid and simple tables."""

    def __init__(self) -> None:
        super().__init__(LANGUAGES["rst"])
        self.targets: dict[str, str] = {}
        self.subs: dict[str, list[dict]] = {}

    def inlines(self, text: str) -> list[dict]:
        def known(m):
            key = " ".join((m[1] or m[2]).split()).lower()
            return (self.targets[key], m[1] or m[2]) if key in self.targets else None

        own = self.lang.links
        self.lang.links = [*own, (r"(?:`([^`]+)`|([A-Za-z][\w-]*))__?(?!\w)", known)] if self.targets else own
        self.lang.notes = [r"\[(#?[\w*]+)\]_"] if self.footnotes else []
        try:
            return super().inlines(text)
        finally:
            self.lang.links, self.lang.notes = own, []

    def body(self, lines: list[str], i: int) -> tuple[list[str], int]:
        """The indented lines from i on."""
        out = []
        while i < len(lines) and (not lines[i].strip() or lines[i].startswith(" ")):
            out.append(lines[i])
            i += 1
        cut = min((len(x) - len(x.lstrip()) for x in out if x.strip()), default=0)
        while out and not out[-1].strip():
            out.pop()
        out = [x[cut:] for x in out]
        while out and not out[0].strip():
            out.pop(0)
        return out, i

    def fenced(self, lines: list[str], i: int):
        line = lines[i]
        if m := re.match(r"\.\. (?:\|([^|]+)\| )?([\w-]+)::\s*(.*)$", line):
            body, j = self.body(lines, i + 1)
            options, rest = [], body
            while rest and (o := re.match(r":([\w-]+):\s*(.*)$", rest[0])):
                options.append([o[1], o[2]])
                rest = rest[1:]
            while rest and not rest[0].strip():
                rest = rest[1:]
            return self.directive(m[2].lower(), m[3], options, rest), j
        if line.startswith(".. ") or line.strip() == "..":
            _, j = self.body(lines, i + 1)
            return [], j
        if line.rstrip().endswith("::"):
            body, j = self.body(lines, i + 1)
            if body:
                text = line.rstrip()[:-2]
                text = text + ":" if text and not text.endswith(" ") else text.rstrip()
                return ([node("Para", trimmed(self.inlines(text.strip())))] if text.strip() else []) + [node("CodeBlock", NO_ATTR, "\n".join(body))], j
        if re.match(r"\| ", line):
            j, out = i, []
            while j < len(lines) and lines[j].startswith("|"):
                out.append(self.inlines(lines[j][2:].strip()))
                j += 1
            return [node("LineBlock", out)], j
        if re.match(r"\+[-=+]+\+\s*$", line):
            from leafmill.sources.markdown import EXTENSIONS, _Reader

            r = _Reader(EXTENSIONS["markdown"])
            r.blocks = lambda ls: self.blocks([x.strip() for x in ls])
            table, j = r.grid_table(lines, i)
            return [table], j
        if re.match(r"=+( +=+)+\s*$", line):
            spans, rows, head, j = [m.span() for m in re.finditer(r"=+", line)], [], None, i + 1
            while j < len(lines) and lines[j].strip():
                if re.match(r"=+( +=+)+\s*$", lines[j]):
                    if head is None and rows and j + 1 < len(lines) and lines[j + 1].strip():
                        head, rows = rows[0], []
                    else:
                        j += 1
                        break
                else:
                    cut = [lines[j][a : (spans[k + 1][0] if k + 1 < len(spans) else None)].strip() for k, (a, _) in enumerate(spans)]
                    rows.append([[node("Plain", trimmed(self.inlines(c)))] if c else [] for c in cut])
                j += 1
            return [simple_table(head, rows)], j
        if re.match(r":[^:\s][^:]*:\s", line) and not line.startswith(":sup"):
            pairs, j = [], i
            while j < len(lines) and (m := re.match(r":([^:]+):\s+(.*)$", lines[j])):
                body, k = self.body(lines, j + 1)
                pairs.append([self.inlines(m[1]), [self.blocks([m[2], *body])]])
                j = k
            return [node("DefinitionList", pairs)], j
        if i + 1 < len(lines) and line[:1] not in (" ", "") and lines[i + 1].startswith("  ") and lines[i + 1].strip() and not self.item(line) and (i == 0 or not lines[i - 1].strip()):
            pairs, j = [], i
            while j + 1 < len(lines) and lines[j].strip() and lines[j][:1] != " " and lines[j + 1].startswith(" ") and lines[j + 1].strip():
                body, k = self.body(lines, j + 1)
                pairs.append([self.inlines(lines[j].strip()), [self.blocks(body)]])
                j = k
            return [node("DefinitionList", pairs)], j
        if line.startswith("  ") and not self.item(line):
            body, j = self.body(lines, i)
            return [node("BlockQuote", self.blocks(body))], j
        return None

    def directive(self, name: str, arg: str, options: list, body: list[str]) -> list[dict]:
        if name in ("code", "code-block", "sourcecode", "highlight"):
            return [node("CodeBlock", attr("", [arg.strip()] if arg.strip() else [], [o for o in options if o[0] in ("number-lines",)]), "\n".join(body))]
        if name in ("image", "figure"):
            o = dict(map(tuple, options))
            image = node("Image", attr("", [], [x for x in options if x[0] in ("width", "height")]), words(o.get("alt", "")), [arg.strip(), ""])
            if name == "image":
                return [node("Para", [image])]
            return [node("Figure", NO_ATTR, [None, self.blocks(body)], [node("Plain", [image])])]
        if name == "math":
            return [node("Para", [node("Math", {"t": "DisplayMath"}, "\n".join([x for x in [arg, *body] if x]))])]
        if name == "raw":
            return [node("RawBlock", arg.strip(), "\n".join(body))]
        if name in ("epigraph", "highlights", "pull-quote"):
            return [node("BlockQuote", self.blocks(body))]
        if name in ("note", "warning", "tip", "important", "caution", "attention", "danger", "error", "hint", "admonition"):
            return [node("Div", attr("", [name]), [node("Div", attr("", ["title"]), [node("Para", words(arg if name == "admonition" else name.capitalize()))]), *self.blocks(([arg] if arg and name != "admonition" else []) + body)])]
        if name in ("contents", "include", "default-role", "role", "sectnum", "header", "footer"):
            return []
        if name in ("csv-table",):
            from leafmill.sources.structured import parse_csv

            rows = [[[node("Plain", self.inlines(c))] for c in r] for r in parse_csv("\n".join(body))]
            header = dict(map(tuple, options)).get("header")
            return [simple_table([[node("Plain", self.inlines(c.strip().strip('"')))] for c in header.split(",")] if header else None, rows)]
        return [node("Div", attr("", [name]), self.blocks(([arg] if arg else []) + body))]

    def document(self, text: str) -> dict:
        lines, kept, i = text.replace("\r", "").expandtabs(8).split("\n"), [], 0
        notes: dict[str, list[str]] = {}
        while i < len(lines):
            if m := re.match(r"\.\. _(?:`([^`]+)`|([^:]+)):\s*(\S*)\s*$", lines[i]):
                key = " ".join((m[1] or m[2]).split()).lower()
                self.targets[key] = m[3] or "#" + key.replace(" ", "-")
                i += 1
            elif m := re.match(r"\.\. \[(#?[\w*]+)\]\s*(.*)$", lines[i]):
                body, i = self.body(lines, i + 1)
                notes[m[1]] = [m[2], *body]
            else:
                kept.append(lines[i])
                i += 1
        self.footnotes = {k: [node("Para", words(" ".join(v).strip()))] for k, v in notes.items()}
        self.footnotes = {k: self.blocks(v) for k, v in notes.items()}
        return super().document("\n".join(kept))


def read_rst(text: str) -> dict:
    return Rst().document(text)


def read_org(text: str) -> dict:
    """Org: export settings become metadata, footnote definitions notes, drawers go."""
    r = Reader(LANGUAGES["org"])
    meta, lines = {}, []
    for line in text.replace("\r", "").split("\n"):
        if m := re.match(r"#\+(title|author|date):\s*(.*)$", line, re.I):
            meta[m[1].lower()] = {"t": "MetaInlines", "c": words(m[2])}
        elif m := re.match(r"\[fn:([\w-]+)\]\s+(.*)$", line):
            r.footnotes[m[1]] = [node("Para", words(m[2]))]
        else:
            lines.append(line)
    doc = r.document("\n".join(lines))
    return {"meta": meta, "blocks": [b for b in doc["blocks"] if not (b["t"] == "RawBlock" and b["c"][0] == "drawer")]}


def read_mediawiki(text: str) -> dict:
    """MediaWiki: its tables become pipe rows before the rest is read; templates stay raw."""
    r = Reader(LANGUAGES["mediawiki"])
    out, i, lines = [], 0, text.replace("\r", "").split("\n")
    pending: list[str] = []

    def flush() -> None:
        out.extend(r.blocks(pending))
        pending.clear()

    while i < len(lines):
        if lines[i].startswith("{|"):
            flush()
            rows, head, caption, i = [], None, None, i + 1
            row: list[tuple[bool, str]] = []

            def end() -> None:
                nonlocal head
                if row:
                    cells = [[node("Plain", trimmed(r.inlines(c.strip())))] if c.strip() else [] for _, c in row]
                    if all(h for h, _ in row) and head is None and not rows:
                        head = cells
                    else:
                        rows.append(cells)
                    row.clear()

            while i < len(lines) and not lines[i].startswith("|}"):
                t = lines[i]
                if t.startswith("|-"):
                    end()
                elif t.startswith("|+"):
                    caption = r.inlines(t[2:].strip())
                elif t[:1] in ("|", "!"):
                    for c in re.split(r"\|\||!!" if t[0] == "!" else r"\|\|", t[1:]):
                        row.append((t[0] == "!", re.sub(r"^[^|\[\]]*=[^|\[\]]*\|(?!\|)", "", c)))
                elif row:
                    row[-1] = (row[-1][0], row[-1][1] + "\n" + t)
                i += 1
            end()
            out.append(simple_table(head, rows, caption=caption))
        elif lines[i].startswith("{{") and lines[i].rstrip().endswith("}}"):
            flush()
            out.append(node("RawBlock", "mediawiki", lines[i]))
        else:
            pending.append(lines[i])
        i += 1
    flush()
    return {"meta": {}, "blocks": unique_identifiers(out)}
