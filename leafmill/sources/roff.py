"""LaTeX, roff, RTF and the literal form to tree."""

from __future__ import annotations

import re

from leafmill.sources import units
from leafmill.tree import BREAK, NO_ATTR, attr, making_runs, node, run, simple_table, trimmed, unique_identifiers, words

# --- LaTeX ------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\\([a-zA-Z]+\*?|[^a-zA-Z])|(%[^\n]*\n?)|([{}\[\]$&~^_])|(\n[ \t]*\n\s*)|(``|''|---?|[ \t\n]+)|([^\\%{}\[\]$&~^_`'\-\n \t]+|.)", re.S)
#: Commands by what they make.
_STYLES = {"emph": "Emph", "textit": "Emph", "textsl": "Emph", "textbf": "Strong", "uline": "Underline", "underline": "Underline", "st": "Strikeout", "sout": "Strikeout", "textsuperscript": "Superscript", "textsubscript": "Subscript", "textsc": "SmallCaps"}
_SYMBOLS = {"ldots": "…", "dots": "…", "textbackslash": "\\", "textasciitilde": "~", "textless": "<", "textgreater": ">", "textbar": "|", "LaTeX": "LaTeX", "TeX": "TeX", "S": "§", "P": "¶", "copyright": "©", "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "textendash": "–", "textemdash": "—", "quad": "\u2003", "euro": "€", "pounds": "£"}
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a"}
_SECTIONS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}


_PERCENT = "\x06"
_NOTE_TEXT = re.compile(r"\\footnotetext(?:\[([^\]]*)\])?\{")
#: Languages by name, and forms of acronyms.
_LANGUAGES = {"ngerman": "de-DE", "german": "de", "french": "fr", "italian": "it", "spanish": "es", "english": "en", "american": "en-US", "british": "en-GB", "dutch": "nl", "portuguese": "pt", "russian": "ru", "latin": "la", "greek": "el", "polish": "pl", "swedish": "sv", "danish": "da", "finnish": "fi", "norsk": "no"}
_ACRONYM = re.compile(r"(?:[Gg]ls|GLS|[Aa]cr?)(desc|long|full|short|fl?|l|s)?(pl|p)?")


def _form(m: re.Match) -> str:
    kind = {"desc": "long", "long": "long", "l": "long", "full": "full", "f": "full", "fl": "full", "short": "abbrv", "s": "abbrv"}.get(m[1] or "", "short")
    return ("plural" if m[2] else "singular") + "+" + kind


def _share(width: str) -> str:
    """A part of the line as a percentage."""
    m = re.fullmatch(r"([\d.]*)\s*\\(?:textwidth|linewidth|columnwidth|hsize)", width)
    return f"{float(m[1] or 1) * 100:g}%" if m else width


def enumerate_notes(reader: Latex, text: str):
    """key, text of each note that stands apart: its own number, or that of its place."""
    for k, m in enumerate(_NOTE_TEXT.finditer(text), 1):
        if g := reader.group(text, m.end() - 1):
            yield m[1] or str(k), g[0]


class Latex:
    """Macros are expanded before the text is read; environments and commands that mean nothing here are passed over, their content kept."""

    def __init__(self) -> None:
        self.macros: dict[str, tuple[int, str, str | None]] = {}  # arguments, body, default of the first
        self.labels: dict[str, str] = {}
        self.meta: dict = {}
        self.chapters = False
        self.notes: dict[str, str] = {}  # texts of notes that stand apart from their marks
        self.marks = 0

    def group(self, s: str, i: int, a: str = "{", b: str = "}") -> tuple[str, int] | None:
        """A balanced group at i."""
        while i < len(s) and s[i] in " \t\n":
            i += 1
        if not s.startswith(a, i):
            return None
        depth, j = 1, i + 1
        while j < len(s) and depth:
            if s[j] == "\\":
                j += 1
            elif s[j] == a:
                depth += 1
            elif s[j] == b:
                depth -= 1
            j += 1
        return s[i + 1 : j - 1], j

    def expand(self, s: str) -> str:
        """Takes \\newcommand and \\def out and replaces what they define, up to a depth."""
        out, i = "", 0
        pattern = re.compile(r"\\(?:re)?newcommand\*?\s*\{?\\([a-zA-Z]+)\}?(?:\[(\d)\])?(?:\[([^\]]*)\])?|\\providecommand\*?\s*\{?\\([a-zA-Z]+)\}?(?:\[(\d)\])?(?:\[([^\]]*)\])?|\\def\s*\\([a-zA-Z]+)((?:#\d)*)")
        while m := pattern.search(s, i):
            body = self.group(s, m.end())
            if not body and (one := re.compile(r"\s*(\\[a-zA-Z]+|[^\s\\{}])").match(s, m.end())):
                body = one[1], one.end()
            if not body:
                out += s[i : m.end()]
                i = m.end()
                continue
            name = m[1] or m[4] or m[7]
            n = int(m[2] or m[5] or 0) if not m[7] else len(m[8]) // 2
            self.macros[name] = (n, body[0], m[3] if m[3] is not None else m[6])
            out += s[i : m.start()]
            i = body[1]
        s = out + s[i:]
        for _ in range(20):
            changed = False
            for name, (n, body, default) in self.macros.items():
                pat, res, k = re.compile(rf"\\{name}(?![a-zA-Z])"), "", 0
                while m := pat.search(s, k):
                    args, j = [], m.end()
                    if default is not None:
                        o = self.group(s, j, "[", "]") if s[j : j + 1] == "[" else None
                        args.append(o[0] if o else default)
                        j = o[1] if o else j
                    for _a in range(n - len(args)):
                        g = self.group(s, j)
                        if not g and (one := re.compile(r"\s*(\\[a-zA-Z]+|[^\s\\{}])").match(s, j)):
                            g = one[1], one.end()
                        if not g:
                            break
                        args.append(g[0])
                        j = g[1]
                    new = body
                    for q, a in enumerate(args):
                        new = new.replace(f"#{q + 1}", a)
                    res += s[k : m.start()] + new
                    k, changed = j, True
                s = res + s[k:]
            if not changed or len(s) > 5_000_000:
                break
        return s

    def read(self, text: str) -> dict:
        # Percent signs in addresses and verbatim text are none of a comment.
        text = re.sub(r"\\(?:url|nolinkurl|href|path)\s*\{[^{}]*\}|\\begin\{(verbatim|lstlisting|Verbatim|minted|alltt)\}.*?\\end\{\1\}|\\verb\*?([^a-zA-Z\s]).*?\2", lambda m: m[0].replace("%", _PERCENT), text, flags=re.S)
        text = re.sub(r"(?<!\\)%[^\n]*\n[ \t]*", "", text)
        text = re.sub(r"\\xspace(?![a-zA-Z])", "\\\\xspace{}", self.expand(text)).replace(_PERCENT, "%")
        text = re.sub(r"\\xspace\{\}(\{\})?(?=[\w\\])", " ", text).replace("\\xspace{}", "")
        self.notes = dict(enumerate_notes(self, text))
        text = _NOTE_TEXT.sub("", text) if not self.notes else self.without_notes(text)
        for name in ("title", "author", "date"):
            if (m := re.search(rf"\\{name}\s*\{{", text)) and (g := self.group(text, m.end() - 1)):
                self.meta[name] = {"t": "MetaInlines", "c": trimmed(self.inlines(g[0]))}
                text = text[: m.start()] + text[g[1] :]
        if m := re.search(r"\\begin\{document\}(.*?)\\end\{document\}", text, re.S):
            text = m[1]
        self.chapters = "\\chapter" in text
        blocks = unique_identifiers(self.blocks(text))
        return {"meta": self.meta, "blocks": blocks}

    def environment(self, s: str, i: int, name: str) -> tuple[str, int]:
        """What stands before the matching \\end."""
        depth, j = 1, i
        pat = re.compile(rf"\\(begin|end)\{{{re.escape(name)}\}}")
        while m := pat.search(s, j):
            depth += 1 if m[1] == "begin" else -1
            j = m.end()
            if not depth:
                return s[i : m.start()], j
        return s[i:], len(s)

    def blocks(self, s: str) -> list[dict]:
        out: list[dict] = []
        run, i = "", 0

        def flush() -> None:
            nonlocal run
            for para in re.split(r"\n[ \t]*\n\s*|\\par(?![a-zA-Z])", run):
                inl = trimmed(self.inlines(para))
                if inl:
                    out.append(node("Para", inl))
            run = ""

        pat = re.compile(r"\\begin\{(\w+\*?)\}|\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)(\*?)(?=[\s\[{])|\\\[|\$\$|\\(hrule|maketitle|tableofcontents|newpage|clearpage|centering|tightlist|noindent|bigskip|medskip|smallskip|appendix)(?![a-zA-Z])|\\rule\{[^}]*\}\{[^}]*\}")
        while m := pat.search(s, i):
            run += s[i : m.start()]
            i = m.end()
            if m[1]:
                name = m[1]
                body, i = self.environment(s, i, name)
                base = name.rstrip("*")
                if base in ("equation", "align", "gather", "displaymath", "eqnarray", "multline", "math", "alignat", "flalign"):
                    whole = body if base in ("displaymath", "math") else f"\\begin{{{name}}}{body}\\end{{{name}}}"
                    run += f"\x02{whole.strip()}\x03"
                    continue
                flush()
                out += self.env_blocks(base, body)
            elif m[2]:
                flush()
                level = _SECTIONS[m[2]] + (1 if self.chapters and m[2] not in ("part", "chapter") else 0)
                opt = self.group(s, i, "[", "]")
                i = opt[1] if opt else i
                title = self.group(s, i) or ("", i)
                i = title[1]
                ident = ""
                if lab := re.compile(r"\s*\\label\{([^}]*)\}").match(s, i):
                    ident, i = lab[1], lab.end()
                out.append(node("Header", level, attr(ident, ["unnumbered"] if m[3] else []), trimmed(self.inlines(title[0]))))
            elif m[0] in ("\\[", "$$"):
                end = s.find("\\]" if m[0] == "\\[" else "$$", i)
                end = end if end >= 0 else len(s)
                run += f"\x02{s[i:end].strip()}\x03"
                i = end + 2
            elif m[0].startswith("\\rule") or m[4] == "hrule":
                flush()
                out.append(node("HorizontalRule"))
            elif m[4] in ("tightlist", "centering", "noindent"):
                pass
            else:
                flush()
        run += s[i:]
        flush()
        return out

    def quotation(self, s: str, i: int, mark: str) -> tuple[dict, int] | None:
        """Quoted text up to the mark that ends it in this group."""
        close, depth, j = "''" if mark == "``" else "'", 0, i
        while j < len(s):
            if s[j] == "\\":
                j += 2
                continue
            if s[j] in "{}":
                depth += 1 if s[j] == "{" else -1
                if depth < 0:
                    return None
            if not depth and s.startswith(close, j) and not (mark == "`" and (s.startswith("''", j) or (s[j + 1 : j + 2].isalnum()))):
                return node("Quoted", {"t": "DoubleQuote" if mark == "``" else "SingleQuote"}, self.inlines(s[i:j])), j + len(close)
            if s.startswith("\n\n", j):
                return None
            j += 1
        return None

    def quantities(self, s: str, i: int, cmd: str) -> tuple[list[dict], int]:
        """Numbers and units of a siunitx command."""
        if o := self.group(s, i, "[", "]") if s[i : i + 1] == "[" else None:
            i = o[1]
        n = {"SI": 2, "qty": 2, "SIrange": 3, "qtyrange": 3, "numrange": 2}.get(cmd, 1)
        args, before = [], ""
        for k in range(n):
            if k == 1 and cmd == "SI" and s[i : i + 1] == "[" and (o := self.group(s, i, "[", "]")):
                before, i = o[0].replace("\\", ""), o[1]
            g = self.group(s, i)
            if not g:
                return [], i
            args.append(g[0])
            i = g[1]
        if cmd in ("si", "unit"):
            return units.unit(args[0]), i
        if cmd == "num":
            return [node("Str", units.number(args[0]))], i
        if cmd == "ang":
            return [node("Str", "".join(x + y for x, y in zip(args[0].split(";"), "°′″", strict=False) if x))], i
        of = units.unit(args[-1]) if cmd != "numrange" else []
        if n == 3 or cmd == "numrange":
            return [*units.quantity(args[0], of), node("Str", "–"), *units.quantity(args[1], of)], i
        return [*([node("Str", before + "\u00a0")] if before else []), *units.quantity(args[0], of)], i

    def without_notes(self, text: str) -> str:
        out, i = "", 0
        while m := _NOTE_TEXT.search(text, i):
            g = self.group(text, m.end() - 1)
            out += text[i : m.start()].rstrip("\n")
            i = g[1] if g else m.end()
        return out + text[i:]

    def env_blocks(self, name: str, body: str) -> list[dict]:
        if name in ("itemize", "enumerate", "description"):
            opt = self.group(body, 0, "[", "]")
            body = body[opt[1] :] if opt and body.lstrip().startswith("[") else body
            items, depth, at, pat = [], 0, None, re.compile(r"\\(begin|end)\{\w+\*?\}|\\item(?![a-zA-Z])")
            for m in pat.finditer(body):
                if m[1]:
                    depth += 1 if m[1] == "begin" else -1
                elif not depth:
                    if at is not None:
                        items.append(body[at : m.start()])
                    at = m.end()
            if at is not None:
                items.append(body[at:])
            if name == "description":
                pairs = []
                for it in items:
                    g = self.group(it, 0, "[", "]")
                    pairs.append([trimmed(self.inlines(g[0])) if g else [], [self.tight(self.blocks(it[g[1] :] if g else it))]])
                return [node("DefinitionList", pairs)]
            inner = [self.tight(self.blocks(x)) for x in items]
            start = re.search(r"\\setcounter\{enum\w+\}\{(\d+)\}", body)
            return [node("BulletList", inner) if name == "itemize" else node("OrderedList", [int(start[1]) + 1 if start else 1, {"t": "DefaultStyle"}, {"t": "DefaultDelim"}], inner)]
        if name in ("quote", "quotation", "verse"):
            return [node("BlockQuote", self.blocks(body))]
        if name in ("verbatim", "lstlisting", "Verbatim", "minted", "alltt"):
            lang = ""
            if name == "minted" and (g := self.group(body, 0)):
                lang, body = g[0], body[g[1] :]
            elif m := re.match(r"\s*\[([^\]]*)\]", body):
                lang, body = (re.search(r"language=(\w+)", m[1]) or [0, ""])[1], body[m.end() :]
            return [node("CodeBlock", attr("", [lang.lower()] if lang else []), body.strip("\n"))]
        if name in ("tabular", "longtable", "tabularx", "array"):
            return [self.tabular(body, name)]
        if name in ("figure", "wrapfigure"):
            place = re.match(r"\s*\[([^\]]*)\]", body)
            body = body[place.end() :] if place else body
            caption, m = [], re.search(r"\\caption\s*\{", body)
            if m and (g := self.group(body, m.end() - 1)):
                caption = trimmed(self.inlines(g[0]))
                body = body[: m.start()] + body[g[1] :]
            ident = (re.search(r"\\label\{([^}]*)\}", body) or [0, ""])[1]
            inner = [node("Plain", b["c"]) if b["t"] == "Para" else b for b in self.blocks(re.sub(r"\\label\{[^}]*\}", "", body))]
            return [node("Figure", attr(ident, [], [["latex-placement", place[1]]] if place else []), [None, [node("Plain", caption)] if caption else []], inner)]
        if name == "table":
            m = re.search(r"\\caption\s*\{", body)
            g = self.group(body, m.end() - 1) if m else None
            blocks = self.blocks(re.sub(r"^\s*\[[^\]]*\]|\\label\{[^}]*\}", "", body[: m.start()] + body[g[1] :] if g else body))
            for b in blocks:
                if b["t"] == "Table" and g:
                    b["c"][1] = [None, [node("Plain", trimmed(self.inlines(g[0])))]]
            return blocks
        if name in ("comment",):
            return []
        if name in ("center", "flushleft", "flushright", "frame", "minipage", "document"):
            return [node("Div", attr("", [name]), self.blocks(re.sub(r"^\s*(\[[^\]]*\])?(\{[^}]*\})?", "", body) if name in ("minipage", "frame") else body))]
        return [node("Div", attr("", [name]), self.blocks(re.sub(r"^\s*\[[^\]]*\]", "", body)))]

    def tight(self, blocks: list[dict]) -> list[dict]:
        return [node("Plain", b["c"]) if b["t"] == "Para" and sum(x["t"] == "Para" for x in blocks) == 1 else b for b in blocks]

    def tabular(self, body: str, name: str) -> dict:
        i = 0
        if opt := self.group(body, i, "[", "]"):
            i = opt[1] if body.lstrip().startswith("[") else i
        if name == "tabularx" and (g := self.group(body, i)):
            i = g[1]
        spec = self.group(body, i) or ("", i)
        cols = re.sub(r"@\{[^{}]*(\{[^{}]*\}[^{}]*)*\}|[|!>]\{[^}]*\}|\|", "", spec[0])
        cols = re.sub(r"[pmbX]\{[^{}]*(\{[^{}]*\})?[^{}]*\}", "l", cols)
        aligns = [{"l": "AlignLeft", "r": "AlignRight", "c": "AlignCenter", "X": "AlignLeft"}[c] for c in cols if c in "lrcX"]
        rest = re.sub(r"\\(toprule|midrule|bottomrule|hline|endhead|endfirsthead|endfoot|endlastfoot|tabularnewline)(\\noalign\{\})?|\\noalign\{\}|\\cline\{[^}]*\}|\\cmidrule(\([^)]*\))?\{[^}]*\}", lambda m: {"midrule": "\x04", "endhead": "\x04", "hline": "\x05"}.get(m[1], ""), body[spec[1] :])
        parts = re.split(r"\\\\(?:\[[^\]]*\])?", rest)
        rows, head = [], None
        for p in parts:
            marks = p.count("\x04"), p.count("\x05")
            if (marks[0] or marks[1]) and head is None and len(rows) == 1:
                head = rows.pop()
            p = p.replace("\x04", "").replace("\x05", "")
            if p.strip():
                rows.append([[node("Plain", inl)] if (inl := trimmed(self.inlines(c))) else [] for c in re.split(r"(?<!\\)&", p)])
        return simple_table(head, rows, aligns)

    def inlines(self, s: str) -> list[dict]:
        out: list[dict] = []
        buffer, i = "", 0

        def flush() -> None:
            nonlocal buffer
            if buffer:
                out.extend(words(buffer))
                buffer = ""

        def push(n: dict) -> None:
            flush()
            out.append(n)

        while i < len(s):
            if s[i] == "\x02":
                end = s.index("\x03", i)
                push(node("Math", {"t": "DisplayMath"}, s[i + 1 : end]))
                i = end + 1
                continue
            m = _TOKEN.match(s, i)
            i = m.end()
            cmd = m[1]
            if cmd:
                if cmd == "(":
                    end = s.find("\\)", i)
                    push(node("Math", {"t": "InlineMath"}, s[i:end].strip()))
                    i = end + 2 if end >= 0 else len(s)
                elif cmd == "[":
                    end = s.find("\\]", i)
                    push(node("Math", {"t": "DisplayMath"}, s[i : end if end >= 0 else len(s)].strip()))
                    i = end + 2 if end >= 0 else len(s)
                elif cmd == "\\" or cmd in ("newline", "linebreak"):
                    push(BREAK)
                    i = re.compile(r"(\[[^\]]*\])?\s*").match(s, i).end()
                elif cmd in _STYLES:
                    g = self.group(s, i)
                    if g:
                        push(node(_STYLES[cmd], self.inlines(g[0])))
                        i = g[1]
                elif cmd in ("texttt", "code", "lstinline", "verb") and cmd != "verb":
                    g = self.group(s, i)
                    if g:
                        push(node("Code", NO_ATTR, re.sub(r"\\textbackslash(\{\})?", r"\\", re.sub(r"\\([{}$&#%_])", r"\1", g[0]))))
                        i = g[1]
                elif cmd in ("mintinline", "nolinkurl", "path"):
                    o = self.group(s, i, "[", "]") if s[i : i + 1] == "[" else None
                    g = self.group(s, o[1] if o else i)
                    t = self.group(s, g[1]) if g and cmd == "mintinline" else g
                    if t:
                        push(node("Code", attr("", [g[0]]) if cmd == "mintinline" else NO_ATTR, t[0]))
                        i = t[1]
                elif cmd in ("SI", "si", "num", "SIrange", "qty", "unit", "qtyrange", "numrange", "ang"):
                    found, i = self.quantities(s, i, cmd)
                    for x in found:
                        if x["t"] == "Str":
                            buffer += x["c"]
                        else:
                            push(x)
                elif cmd == "hypertarget" and (g := self.group(s, i)) and (t := self.group(s, g[1])):
                    push(node("Span", attr(g[0]), self.inlines(t[0])))
                    i = t[1]
                elif cmd == "foreignlanguage" and (g := self.group(s, i)) and (t := self.group(s, g[1])):
                    push(node("Span", attr("", [], [["lang", _LANGUAGES.get(g[0], g[0])]]), self.inlines(t[0])))
                    i = t[1]
                elif cmd.rstrip("*") in ("enquote", "foreignquote", "hyphenquote"):
                    lang = self.group(s, i) if not cmd.startswith("enquote") else None
                    g = self.group(s, lang[1] if lang else i)
                    if g:
                        inner = self.inlines(g[0])
                        inner = [node("Span", attr("", [], [["lang", _LANGUAGES.get(lang[0], lang[0])[:2]]]), inner)] if lang else inner
                        push(node("Quoted", {"t": "SingleQuote" if cmd.endswith("*") else "DoubleQuote"}, inner))
                        i = g[1]
                elif (a := _ACRONYM.fullmatch(cmd)) and (g := self.group(s, i)):
                    push(node("Span", attr("", [], [["acronym-label", g[0]], ["acronym-form", _form(a)]]), [node("Str", g[0])]))
                    i = g[1]
                elif cmd == "footnotemark":
                    o = self.group(s, i, "[", "]") if s[i : i + 1] == "[" else None
                    self.marks += 1
                    key = o[0] if o else str(self.marks)
                    i = o[1] if o else i
                    i = i + 2 if s.startswith("{}", i) else i
                    if key in self.notes:
                        push(node("Note", self.blocks(self.notes[key])))
                elif cmd in ("verb", "verb*"):
                    end = s.find(s[i], i + 1)
                    push(node("Code", NO_ATTR, s[i + 1 : end]))
                    i = end + 1 if end > 0 else len(s)
                elif cmd == "href":
                    u = self.group(s, i)
                    t = self.group(s, u[1]) if u else None
                    if t:
                        push(node("Link", NO_ATTR, self.inlines(t[0]), [u[0].replace("\\", ""), ""]))
                        i = t[1]
                elif cmd == "url":
                    g = self.group(s, i)
                    if g:
                        push(node("Link", attr("", ["uri"]), [node("Str", g[0])], [g[0], ""]))
                        i = g[1]
                elif cmd == "hyperref":
                    o = self.group(s, i, "[", "]")
                    t = self.group(s, o[1]) if o else None
                    if t:
                        push(node("Link", NO_ATTR, self.inlines(t[0]), ["#" + o[0], ""]))
                        i = t[1]
                elif cmd == "includegraphics":
                    o = self.group(s, i, "[", "]") if s[i : i + 1] == "[" else None
                    g = self.group(s, o[1] if o else i)
                    if g:
                        kvs = [[x.strip().strip("{}") for x in y.split("=", 1)] for y in (re.findall(r"(?:[^,{}]|\{[^{}]*\})+", o[0]) if o else []) if "=" in y]
                        alt = dict(kvs).get("alt")
                        push(node("Image", attr("", [], [[k, _share(v)] for k, v in kvs if k in ("width", "height")]), self.inlines(alt) if alt else [node("Str", "image")], [g[0], ""]))
                        i = g[1]
                elif cmd in ("footnote", "thanks"):
                    g = self.group(s, i)
                    if g:
                        push(node("Note", self.blocks(g[0])))
                        i = g[1]
                elif cmd.rstrip("*") in ("cite", "citep", "citet", "parencite", "textcite", "autocite", "citeauthor", "citeyear", "footcite"):
                    opts = []
                    while s[i : i + 1] == "[" and (o := self.group(s, i, "[", "]")):
                        opts.append(o[0])
                        i = o[1]
                    g = self.group(s, i)
                    if g:
                        pre, post = (opts[0], opts[1]) if len(opts) == 2 else ("", opts[0] if opts else "")
                        keys = [k.strip() for k in g[0].split(",")]
                        mode = "AuthorInText" if cmd in ("citet", "textcite") else "NormalCitation"
                        cs = [{"citationId": k, "citationPrefix": self.inlines(pre) if q == 0 else [], "citationSuffix": self.inlines(post) if q == len(keys) - 1 else [], "citationMode": {"t": mode if q == 0 else "NormalCitation"}, "citationNoteNum": 0, "citationHash": 0} for q, k in enumerate(keys)]
                        push(node("Cite", cs, [node("RawInline", "latex", s[m.start() : g[1]])]))
                        i = g[1]
                elif cmd in ("ref", "autoref", "cref", "pageref", "eqref"):
                    g = self.group(s, i)
                    if g:
                        push(node("Link", attr("", [], [["reference-type", cmd], ["reference", g[0]]]), [node("Str", f"[{g[0]}]")], ["#" + g[0], ""]))
                        i = g[1]
                elif cmd == "label":
                    g = self.group(s, i)
                    if g:
                        push(node("Span", attr(g[0], [], [["label", g[0]]]), []))
                        i = g[1]
                elif cmd in _SYMBOLS:
                    buffer += _SYMBOLS[cmd]
                    i = re.compile(r"\{\}|[ \t]*").match(s, i).end()
                elif cmd in _ACCENTS and (a := re.compile(r"\s*(?:\{(\\?\w)\}|(\\?\w))").match(s, i)):
                    import unicodedata

                    buffer += unicodedata.normalize("NFC", (a[1] or a[2]).lstrip("\\") + _ACCENTS[cmd])
                    i = a.end()
                elif len(cmd) == 1 and not cmd.isalpha():
                    buffer += "\u00a0" if cmd == " " else "" if cmd in "-/!" else " " if cmd in ",;:" else cmd
                elif cmd == "begin":
                    g = self.group(s, i)
                    _, i = self.environment(s, g[1] if g else i, g[0] if g else "")
                else:  # an unknown command: its options go, its arguments are read
                    while s[i : i + 1] == "[" and (o := self.group(s, i, "[", "]")):
                        i = o[1]
            elif m[2]:
                pass
            elif m[3]:
                ch = m[3]
                if ch == "$":
                    end = s.find("$", i)
                    push(node("Math", {"t": "InlineMath"}, s[i:end]))
                    i = end + 1 if end >= 0 else len(s)
                elif ch == "~":
                    buffer += "\u00a0"
                elif ch in "[]":
                    buffer += ch
            elif m[0] in ("``", "`") and (found := self.quotation(s, i, m[0])):
                push(found[0])
                i = found[1]
            elif m[5]:
                buffer += {"``": "“", "''": "”", "---": "—", "--": "–"}.get(m[5], m[5] if m[5].strip() else " " if "\n" not in m[5] else "\n")
            else:
                buffer += {"`": "‘", "'": "’"}.get(m[0], m[0]) if m[0] not in "{}" else ""
        flush()
        return out


def read_latex(text: str) -> dict:
    return Latex().read(text)


# --- roff -------------------------------------------------------------------------------------------------------------

_ESCAPES = {"(aq": "'", "(lq": "“", "(rq": "”", "(oq": "‘", "(cq": "’", "(em": "—", "(en": "–", "(bu": "•", "[bu]": "•", "(co": "©", "(rg": "®", "&": "", "e": "\\", "-": "-", " ": " ", "~": "\u00a0", "|": "", "^": "", "0": " ", "c": "", "/": "", ",": ""}


def _roff_inlines(text: str) -> list[dict]:
    out, buffer, font, i = [], "", "R", 0

    def flush() -> None:
        nonlocal buffer
        if buffer:
            inner = words(buffer)
            out.extend(inner if font == "R" else [node({"B": "Strong", "I": "Emph"}[font], inner)] if font in "BI" else [node("Strong", [node("Emph", inner)])] if font == "BI" else [node("Code", NO_ATTR, buffer)])
            buffer = ""

    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            if m := re.compile(r"\\f(?:\[(\w*)\]|\((\w\w)|(\w))").match(text, i):
                flush()
                font = {"B": "B", "I": "I", "BI": "BI", "3": "B", "2": "I", "4": "BI", "CR": "C", "C": "C", "CW": "C"}.get(m[1] if m[1] is not None else m[2] or m[3], "R")
                i = m.end()
                continue
            if m := re.compile(r'\\".*').match(text, i):
                break
            if m := re.compile(r"\\(\(..|\[[^\]]*\]|.)", re.S).match(text, i):
                buffer += _ESCAPES.get(m[1], "" if len(m[1]) > 1 else m[1])
                i = m.end()
                continue
        buffer += text[i]
        i += 1
    flush()
    return out


def _args(rest: str) -> list[str]:
    return [a[1:-1].replace('""', '"') if a.startswith('"') else a for a in re.findall(r'"(?:[^"]|"")*"|\S+', rest)]


def read_man(text: str) -> dict:
    """man pages, and mdoc by its own macros."""
    lines, blocks, para, meta, i = text.replace("\r", "").split("\n"), [], [], {}, 0

    def flush() -> None:
        inl = trimmed([x for k, line in enumerate(para) for x in ([{"t": "SoftBreak"}] if k else []) + line])
        if inl:
            blocks.append(node("Para", inl))
        para.clear()

    def styled(args: list[str], kinds: str) -> list[dict]:
        out: list[dict] = []
        for k, a in enumerate(args):
            inner, kind = _roff_inlines(a), kinds[k % len(kinds)]
            out += inner if kind == "R" else [node("Strong" if kind == "B" else "Emph", inner)]
        return out

    #: Mdoc macros that style their arguments.
    mdoc = {"Nm": "Strong", "Fl": "Strong", "Cm": "Strong", "Ic": "Strong", "Ar": "Emph", "Em": "Emph", "Pa": "Code", "Va": "Code", "Ev": "Code", "Li": "Code", "Fn": "Code", "Dv": "Code", "Er": "Code", "Sy": "Strong"}
    while i < len(lines):
        line = lines[i]
        i += 1
        if line.startswith(("'\\\"", ".\\\"")) or not line.strip():
            if not line.strip():
                flush()
            continue
        if not line.startswith((".", "'")):
            para.append(_roff_inlines(line))
            continue
        macro, _, rest = line[1:].strip().partition(" ")
        args = _args(rest)
        if macro in ("TH", "Dt"):
            if args:
                meta["title"] = {"t": "MetaInlines", "c": words(args[0])}
                if len(args) > 1:
                    meta["section"] = {"t": "MetaInlines", "c": words(args[1])}
        elif macro in ("SH", "Sh", "SS", "Ss"):
            flush()
            title = " ".join(args) or (lines[i] if i < len(lines) else "")
            i += not args
            blocks.append(node("Header", 1 if macro in ("SH", "Sh") else 2, NO_ATTR, _roff_inlines(title)))
        elif macro in ("PP", "P", "LP", "Pp", "sp"):
            flush()
        elif macro in ("B", "I", "BI", "BR", "IB", "IR", "RB", "RI", "SM", "SB"):
            para.append(styled([" ".join(args)] if macro in ("B", "I", "SM", "SB") else args, {"SM": "R", "SB": "B"}.get(macro, macro)))
        elif macro in ("br",):
            if para:
                para[-1].append(BREAK)
        elif macro in ("nf", "EX", "Bd"):
            flush()
            body = []
            while i < len(lines) and not re.match(r"\.(fi|EE|Ed)\b", lines[i]):
                if not re.match(r"\.(nf|EX|PP|IP|ft)\b", lines[i]):
                    body.append(re.sub(r"\\f(\[\w*\]|\w)", "", lines[i]).replace("\\e", "\\").replace("\\&", "").replace("\\-", "-"))
                i += 1
            i += 1
            blocks.append(node("CodeBlock", NO_ATTR, "\n".join(body)))
        elif macro in ("RS",):
            flush()
            depth, body = 1, []
            while i < len(lines) and depth:
                depth += lines[i].startswith(".RS") - lines[i].startswith(".RE")
                body.append(lines[i])
                i += 1
            inner = read_man("\n".join(body[:-1] if not depth else body))["blocks"]
            if blocks and blocks[-1]["t"] in ("BulletList", "OrderedList", "DefinitionList") and inner:
                target = blocks[-1]["c"] if blocks[-1]["t"] == "BulletList" else blocks[-1]["c"][1] if blocks[-1]["t"] == "OrderedList" else blocks[-1]["c"][-1][1]
                target[-1].extend(inner)
            elif inner:
                blocks.append(node("BlockQuote", inner))
        elif macro in ("IP", "TP", "It"):
            flush()
            if macro == "TP":
                term_line = lines[i] if i < len(lines) else ""
                i += 1
                term = styled(_args(term_line[1:].partition(" ")[2]), {"SM": "R"}.get(term_line[1:].split()[0], term_line[1:].split()[0])) if re.match(r"\.(B|I|BI|BR|IB|IR|RB|RI) ", term_line) else _roff_inlines(term_line)
            else:
                term = _roff_inlines(args[0]) if args else []
                if macro == "It":
                    term = [x for a in args for x in ([node("Strong", words("-" + a))] if args[0] == "Fl" and a != "Fl" else [] if a == "Fl" or a in mdoc else words(a) + [{"t": "Space"}])]
            body = []
            while i < len(lines) and lines[i].strip() and not re.match(r"[.'](SH|SS|Sh|Ss|PP|P|LP|IP|TP|RS|It|El|nf|EX|TS)\b", lines[i]):
                body.append(lines[i])
                i += 1
            inner = [node("Plain", b["c"]) if b["t"] == "Para" else b for b in read_man("\n".join(body))["blocks"]]
            from leafmill.tree import plain

            mark = plain(term).strip()
            if macro == "IP" and not mark:
                blocks += [node("Para", b["c"]) if b["t"] == "Plain" else b for b in inner]
            elif macro == "IP" and mark in ("•", "*", "-", "o"):
                if blocks and blocks[-1]["t"] == "BulletList":
                    blocks[-1]["c"].append(inner)
                else:
                    blocks.append(node("BulletList", [inner]))
            elif macro == "IP" and (m := re.fullmatch(r"\(?(\d+)[.)]?", mark)):
                if blocks and blocks[-1]["t"] == "OrderedList":
                    blocks[-1]["c"][1].append(inner)
                else:
                    blocks.append(node("OrderedList", [int(m[1]), {"t": "Decimal"}, {"t": "Period"}], [inner]))
            elif blocks and blocks[-1]["t"] == "DefinitionList":
                blocks[-1]["c"].append([trimmed(term), [inner]])
            else:
                blocks.append(node("DefinitionList", [[trimmed(term), [inner]]]))
        elif macro == "TS":
            flush()
            body = []
            while i < len(lines) and not lines[i].startswith(".TE"):
                body.append(lines[i])
                i += 1
            i += 1
            text_ = "\n".join(body)
            sep = (re.search(r"tab ?\((.)\)", text_) or [0, "\t"])[1]
            _, _, data = text_.partition(".\n")
            data = re.sub(r"T\{\n(.*?)\n?T\}", lambda m: m[1].replace("\n", " "), data, flags=re.S)
            rows = [[[node("Plain", _roff_inlines(c))] if c else [] for c in r.split(sep)] for r in data.split("\n") if r.strip() and r.strip() not in ("_", "=")]
            blocks.append(simple_table(rows[0] if rows else None, rows[1:]))
        elif macro in ("UR", "MT"):
            body = []
            while i < len(lines) and not lines[i].startswith((".UE", ".ME")):
                body.append(lines[i])
                i += 1
            i += 1
            url = args[0] if args else ""
            para.append([node("Link", NO_ATTR, _roff_inlines(" ".join(body)) or words(url), [("mailto:" if macro == "MT" else "") + url, ""])])
        elif macro in mdoc:
            inner = words(("-" if macro == "Fl" else "") + " ".join(args))
            para.append([node("Code", NO_ATTR, " ".join(args))] if mdoc[macro] == "Code" else [node(mdoc[macro], inner)])
        elif macro in ("Nd",):
            para.append(words("— " + " ".join(args)))
        elif macro in ("Op",):
            para.append(words("[" + " ".join("-" + a if args[k - 1] == "Fl" else a for k, a in enumerate(args) if a not in ("Fl", "Ar")) + "]"))
        elif macro in ("Xr",):
            para.append(words(f"{args[0]}({args[1]})" if len(args) > 1 else rest))
    flush()
    return {"meta": meta, "blocks": unique_identifiers(blocks)}


# --- RTF --------------------------------------------------------------------------------------------------------------


def read_rtf(text: str | bytes) -> dict:
    """Rich text: paragraphs with character formats, tables, links, headings by outline level."""
    if isinstance(text, bytes):
        text = text.decode("latin-1")
    stack: list[dict] = []
    state: dict = {}
    blocks: list[dict] = []
    para: list[dict] = []
    row: list[list[dict]] = []
    table: list[list[list[dict]]] = []
    level = None
    skip = 0
    #: Control words that format characters, and destinations that hold no text.
    formats = {"b": "Strong", "i": "Emph", "ul": "Underline", "strike": "Strikeout", "super": "Superscript", "sub": "Subscript", "scaps": "SmallCaps"}
    hidden = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "listtable", "listoverridetable", "fldinst", "themedata", "xmlnstbl"}
    buffer = ""

    def flush() -> None:
        nonlocal buffer
        if buffer:
            inner = words(buffer)
            for word, kind in formats.items():
                if state.get(word):
                    inner = [node(kind, inner)]
            if state.get("link"):
                inner = [node("Link", NO_ATTR, inner, [state["link"], ""])]
            para.extend(inner)
            buffer = ""

    def end_table() -> None:
        if table:
            blocks.append(simple_table(None, list(table)))
            table.clear()

    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)|[\r\n]+", text):
        word, num, hexa, sign, brace, plain_ = m.groups()
        if brace == "{":
            flush()
            stack.append(dict(state))
            skip += bool(skip)
        elif brace == "}":
            flush()
            if skip:
                skip -= 1
            if stack:
                state = stack.pop()
        elif word:
            if word in hidden:
                if word == "fldinst":
                    end = text.find("}", m.end())
                    url = re.search(r'HYPERLINK\s+"?([^"}\s]+)', text[m.end() : end])
                    if url:
                        for s in stack[-2:]:
                            s["link"] = url[1]
                skip = skip or 1
            elif skip:
                pass
            elif word in formats:
                flush()
                state[word] = num != "0"
            elif word in ("ulnone",):
                flush()
                state["ul"] = False
            elif word == "nosupersub":
                flush()
                state["super"] = state["sub"] = False
            elif word == "plain":
                flush()
                for k in formats:
                    state[k] = False
            elif word == "par":
                flush()
                inl = trimmed(para)
                para.clear()
                if inl:
                    end_table()
                    blocks.append(node("Header", level + 1, NO_ATTR, inl) if level is not None and level < 6 else node("Para", inl))
                level = None
            elif word == "pard":
                level = None
            elif word == "outlinelevel":
                level = int(num or 0)
            elif word == "cell":
                flush()
                row.append([node("Plain", trimmed(para))] if trimmed(para) else [])
                para.clear()
            elif word == "row":
                table.append(list(row))
                row.clear()
            elif word == "line":
                flush()
                para.append(BREAK)
            elif word == "tab":
                buffer += " "
            elif word == "u":
                buffer += chr(int(num) % 65536)
                state["eat"] = 1
            elif word in ("emdash", "endash", "bullet", "lquote", "rquote", "ldblquote", "rdblquote"):
                buffer += {"emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}[word]
        elif skip:
            pass
        elif hexa:
            if state.pop("eat", 0):
                continue
            buffer += bytes([int(hexa, 16)]).decode("cp1252", "replace")
        elif sign:
            if sign == "*":
                skip = skip or 1 if not text.startswith("\\fldinst", m.end()) else skip
            elif sign in "\\{}":
                buffer += sign
            elif sign == "~":
                buffer += "\u00a0"
        elif plain_:
            buffer += plain_[1:] if state.pop("eat", 0) else plain_
    flush()
    if trimmed(para):
        blocks.append(node("Para", trimmed(para)))
    end_table()
    import json

    # Surrogate pairs written as two \\u words become one character.
    joined = json.loads(json.dumps(blocks).encode("utf-8", "surrogatepass").decode("utf-8"))
    return {"meta": {}, "blocks": unique_identifiers(joined)}


# --- the literal form -------------------------------------------------------------------------------------------------


#: Words with a space between each two, as one token.
_WORDS = r'Str "(?:[^"\\ ]|\\\d+)+"(?: , Space , Str "(?:[^"\\ ]|\\\d+)+")+|'


def read_native(text: str) -> dict:
    """The literal form of the tree: constructors applied to their arguments."""
    tokens = re.findall((_WORDS if making_runs() else "") + r'"(?:[^"\\]|\\.)*"|[\[\](){},=]|-?\d+(?:\.\d+)?|[A-Za-z_]\w*', text, re.S)
    def escape(m: re.Match) -> str:
        decimal, hexa, one = m[1], m[2], m[3]
        if decimal or hexa:
            return chr(int(decimal) if decimal else int(hexa, 16))
        return "" if one == "&" else {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}.get(one, one)

    def string(t: str) -> str:
        return re.sub(r"\\(?:(\d+)|x([0-9a-fA-F]+)|(.))", escape, t[1:-1], flags=re.S)  # \\& ends a number and is nothing itself

    def whole(t: str) -> str:
        return string(t[4:].replace('" , Space , Str "', " "))

    at = 0
    if making_runs():
        tokens = [y for x in tokens for y in ([x] if not x.startswith('Str "') or run(whole(x)) else re.findall(r'"[^"]*"|\w+|,', x))]

    def value():
        nonlocal at
        t = tokens[at]
        if t == "[":
            at += 1
            out = []
            while tokens[at] != "]":
                out.append(application())
                if tokens[at] == ",":
                    at += 1
            at += 1
            return out
        if t == "(":
            at += 1
            out = []
            while tokens[at] != ")":
                out.append(application())
                if tokens[at] == ",":
                    at += 1
            at += 1
            return out[0] if len(out) == 1 else out
        at += 1
        if t[0] == '"':
            return string(t)
        if t.startswith('Str "'):
            return ("Run", whole(t))
        if t[0].isdigit() or t[0] == "-":
            return float(t) if "." in t else int(t)
        if at < len(tokens) and tokens[at] == "{":
            at += 1
            record = {}
            while tokens[at] != "}":
                name = tokens[at]
                at += 2
                record[name] = application()
                if tokens[at] == ",":
                    at += 1
            at += 1
            return (t, record)
        return (t,)

    def application():
        nonlocal at
        head = value()
        if not (isinstance(head, tuple) and len(head) == 1):
            return head
        args = []
        while at < len(tokens) and tokens[at] not in ("]", ")", ",", "}"):
            args.append(value())
        return (head[0], *args)

    def attr_(a) -> list:
        return [a[0], list(a[1]), [list(x) for x in a[2]]]

    def name(v) -> dict:
        return {"t": v[0]} if len(v) == 1 else {"t": v[0], "c": v[1]}

    def many(v) -> list[dict]:
        return [conv(x) for x in v]

    def rows(v) -> list:
        return [[attr_(r[1]), [[attr_(c[1]), name(c[2]), c[3][1], c[4][1], many(c[5])] for c in r[2]]] for r in v]

    def conv(v) -> dict:
        t, a = v[0], v[1:]
        if not a:
            return {"t": t}
        if t in ("Str", "Run"):
            return node(t, a[0])
        if t in ("Code", "CodeBlock"):
            return node(t, attr_(a[0]), a[1])
        if t == "Math":
            return node(t, name(a[0]), a[1])
        if t in ("RawInline", "RawBlock"):
            return node(t, a[0][1], a[1])
        if t == "Header":
            return node(t, a[0], attr_(a[1]), many(a[2]))
        if t in ("Div", "Span"):
            return node(t, attr_(a[0]), many(a[1]))
        if t == "Quoted":
            return node(t, name(a[0]), many(a[1]))
        if t in ("Link", "Image"):
            return node(t, attr_(a[0]), many(a[1]), list(a[2]))
        if t == "OrderedList":
            return node(t, [a[0][0], name(a[0][1]), name(a[0][2])], [many(x) for x in a[1]])
        if t in ("BulletList", "LineBlock"):
            return node(t, [many(x) for x in a[0]])
        if t == "DefinitionList":
            return node(t, [[many(term), [many(d) for d in defs]] for term, defs in a[0]])
        if t == "Figure":
            return node(t, attr_(a[0]), [None, many(a[1][2])], many(a[2]))
        if t == "Cite":
            cites = [{**x[1], "citationPrefix": many(x[1]["citationPrefix"]), "citationSuffix": many(x[1]["citationSuffix"]), "citationMode": name(x[1]["citationMode"])} for x in a[0]]
            return node(t, cites, many(a[1]))
        if t == "Table":
            return node(t, attr_(a[0]), [None, many(a[1][2])], [[name(x), name(w)] for x, w in a[2]], [attr_(a[3][1]), rows(a[3][2])], [[attr_(b[1]), b[2][1], rows(b[3]), rows(b[4])] for b in a[4]], [attr_(a[5][1]), rows(a[5][2])])
        return node(t, many(a[0]))

    found = application() if tokens else []
    if isinstance(found, tuple) and found and isinstance(found[-1], list) and len(found) > 2 and not isinstance(found[1], list):
        found = found[-1]  # a whole document: its metadata is left aside
    return {"meta": {}, "blocks": many(found if isinstance(found, list) else [found])}
