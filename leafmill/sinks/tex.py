"""Trees to TeX and roff languages, RTF, notebooks, bibliographies and the literal form."""

from __future__ import annotations

import json
import re

from leafmill.sinks.markup import Format, Renderer, indented
from leafmill.tree import cells, meta_text, plain

#: Characters that LaTeX reserves.
_LATEX = {"\\": "\\textbackslash{}", "{": "\\{", "}": "\\}", "$": "\\$", "&": "\\&", "#": "\\#", "%": "\\%", "_": "\\_", "^": "\\^{}", "~": "\\textasciitilde{}", "<": "\\textless{}", ">": "\\textgreater{}", "|": "\\textbar{}", "\u00a0": "~", "…": "\\ldots{}", "“": "``", "”": "''", "‘": "`", "’": "'", "–": "--", "—": "---"}


def latex_escape(s: str) -> str:
    return "".join(_LATEX.get(ch, ch) for ch in s)


_LEVELS = ["section", "subsection", "subsubsection", "paragraph", "subparagraph", "subparagraph"]


def _latex_table(head, rows, aligns, caption) -> str:
    cols = "".join({"AlignRight": "r", "AlignCenter": "c"}.get(a, "l") for a in aligns)
    line = lambda r: " & ".join(x.replace("\n", " ") for x in r) + " \\\\"
    out = ["\\begin{longtable}[]{@{}" + cols + "@{}}"] + ([f"\\caption{{{caption}}}\\tabularnewline"] if caption else []) + ["\\toprule\\noalign{}"]
    if any(head):
        out += [line(head), "\\midrule\\noalign{}", "\\endhead"]
    return "\n".join([*out, *map(line, rows), "\\bottomrule\\noalign{}", "\\end{longtable}"])


class Latex(Renderer):
    def __init__(self, slides: bool = False) -> None:
        self.slides = slides
        super().__init__(
            Format(
                marks={"Emph": ("\\emph{", "}"), "Strong": ("\\textbf{", "}"), "Underline": ("\\uline{", "}"), "Strikeout": ("\\st{", "}"), "Superscript": ("\\textsuperscript{", "}"), "Subscript": ("\\textsubscript{", "}"), "SmallCaps": ("\\textsc{", "}")},
                escape=latex_escape, code=lambda s: "\\texttt{" + latex_escape(s) + "}", link=lambda t, u, x: f"\\hyperref[{u[1:]}]{{{t}}}" if u.startswith("#") else f"\\href{{{u.replace('%', chr(92) + '%').replace('#', chr(92) + '#')}}}{{{t}}}", image=lambda t, u, x: f"\\includegraphics{{{u}}}",
                header=lambda level, text, a: f"\\{_LEVELS[min(level, 6) - 1]}{'*' if 'unnumbered' in a[1] else ''}{{{text}}}" + (f"\\label{{{a[0]}}}" if a[0] else ""), code_block=lambda text, c: f"\\begin{{verbatim}}\n{text}\n\\end{{verbatim}}", quote=lambda b: f"\\begin{{quote}}\n{b}\n\\end{{quote}}", rule="\\begin{center}\\rule{0.5\\linewidth}{0.5pt}\\end{center}", line_break="\\\\\n", math=("\\(", "\\)"), display=("\\[", "\\]"), table=_latex_table, raw=("latex", "tex"), lines=lambda xs: "\\\\\n".join(xs),
            )
        )

    def inline(self, n: dict) -> str:
        if n["t"] == "Note":
            return "\\footnote{" + self.blocks(n["c"]) + "}"
        if n["t"] == "Quoted":
            a, b = ("``", "''") if n["c"][0]["t"] == "DoubleQuote" else ("`", "'")
            return a + self.inlines(n["c"][1]) + b
        if n["t"] == "Cite":
            return self.inlines(n["c"][1]) or "\\cite{" + ",".join(x["citationId"] for x in n["c"][0]) + "}"
        return super().inline(n)

    def block(self, n: dict) -> str | None:
        t, c = n["t"], n.get("c")
        if t in ("BulletList", "OrderedList"):
            name = "itemize" if t == "BulletList" else "enumerate"
            items = c if t == "BulletList" else c[1]
            tight = "\\tightlist\n" if all(not i or i[0]["t"] != "Para" for i in items) else ""
            start = f"\\setcounter{{enumi}}{{{c[0][0] - 1}}}\n" if t == "OrderedList" and c[0][0] != 1 else ""
            return f"\\begin{{{name}}}\n{start}{tight}" + "\n".join("\\item\n" + indented(self.blocks(i), "  ", "  ") for i in items) + f"\n\\end{{{name}}}"
        if t == "DefinitionList":
            return "\\begin{description}\n" + "\n".join(f"\\item[{self.inlines(term)}]\n" + "\n\n".join(map(self.blocks, defs)) for term, defs in c) + "\n\\end{description}"
        if t == "Figure":
            return "\\begin{figure}\n\\centering\n" + self.blocks(c[2]) + (f"\n\\caption{{{self.blocks(c[1][1])}}}" if c[1][1] else "") + "\n\\end{figure}"
        return super().block(n)

    def document(self, doc: dict) -> str:
        if not self.slides:
            return self.blocks(doc["blocks"]) + "\n"
        return "\n\n".join(f"\\begin{{frame}}{{{self.inlines(title)}}}\n{self.blocks(body)}\n\\end{{frame}}" for title, body in slides(doc["blocks"])) + "\n"


def slide_level(blocks: list[dict]) -> int:
    """The least level of a heading with content right below it; 6 without one."""
    out = 6
    for a, b in zip(blocks, blocks[1:], strict=False):
        if a["t"] == "Header" and b["t"] not in ("Header", "HorizontalRule"):
            out = min(out, a["c"][0])
    return out


def slides(blocks: list[dict]) -> list[tuple[list[dict], list[dict]]]:
    """Title and content of each slide: a new one at headings down to the slide level and at rules."""
    level, out = slide_level(blocks), []
    for b in blocks:
        if b["t"] == "Header" and b["c"][0] <= level:
            out.append((b["c"][2], []))
        elif b["t"] == "HorizontalRule":
            out.append(([], []))
        else:
            if not out:
                out.append(([], []))
            out[-1][1].append(b)
    return out


def _roff(s: str) -> str:
    s = s.replace("\\", "\\e").replace("-", "\\-").replace("'", "\\(aq").replace("“", "\\(lq").replace("”", "\\(rq").replace("’", "\\(cq").replace("‘", "\\(oq").replace("—", "\\(em").replace("–", "\\(en")
    return s


class Roff(Renderer):
    """man and ms."""

    def __init__(self, ms: bool = False) -> None:
        self.ms = ms
        super().__init__(Format(marks={"Emph": ("\\f[I]", "\\f[R]"), "Strong": ("\\f[B]", "\\f[R]"), "Superscript": ("^", "^"), "Subscript": ("~", "~"), "Strikeout": ("[STRIKEOUT:", "]")}, escape=_roff, code=lambda s: f"\\f[CR]{_roff(s)}\\f[R]", link=lambda t, u, x: f"{t} (\\c\n.UR {u}\n.UE \\c\n)" if t != u else f"\\c\n.UR {u}\n.UE \\c\n", image=lambda t, u, x: f"[IMAGE: {t}]", line_break="\n.PD 0\n.P\n.PD\n", raw=("man", "ms")))

    def block(self, n: dict) -> str | None:
        t, c = n["t"], n.get("c")
        p = ".PP"
        if t == "Plain":
            return self.inlines(c)
        if t == "Para":
            return f"{p}\n{self.inlines(c)}"
        if t == "Header":
            text = self.inlines(c[2])
            return f".NH {c[0]}\n{text}" if self.ms else (f".SH {text}" if c[0] == 1 else f".SS {text}")
        if t == "CodeBlock":
            body = "\n".join(("\\&" if x.startswith((".", "'")) else "") + x for x in c[1].replace("\\", "\\e").split("\n"))
            return f".IP\n.nf\n\\f[C]\n{body}\n\\f[R]\n.fi" if self.ms else f".IP\n.EX\n{body}\n.EE"
        if t == "BlockQuote":
            return f".QS\n{self.blocks(c)}\n.QE" if self.ms else f".RS\n{self.blocks(c)}\n.RE"
        if t == "HorizontalRule":
            return f"{p}\n   *   *   *   *   *"
        if t in ("BulletList", "OrderedList"):
            items = c if t == "BulletList" else c[1]
            marks = ["\\(bu" if t == "BulletList" else f'"{c[0][0] + k}."' for k in range(len(items))]
            return "\n".join(f".IP {m} {(3 if self.ms else 2) if t == 'BulletList' else 4}\n{self.blocks(i)}" for m, i in zip(marks, items, strict=True))
        if t == "DefinitionList":
            return "\n".join(f".TP\n{self.inlines(term)}\n" + "\n.RS\n.RE\n".join(map(self.blocks, defs)) for term, defs in c)
        if t == "Table":
            rows: dict[int, list[str]] = {}
            for _, row, cell in cells(n):
                rows.setdefault(row, []).append(f"T{{\n{self.blocks(cell[4])}\nT}}")
            marks = " ".join({"AlignRight": "r", "AlignCenter": "c"}.get(s[0]["t"], "l") for s in c[2])
            return ".TS\ntab(@);\n" + marks + ".\n" + "\n".join("@".join(r) for r in rows.values()) + "\n.TE"
        return super().block(n)

    def blocks(self, xs: list[dict], tight: bool = False) -> str:
        out = []
        for before, n in zip([None, *xs], xs, strict=False):
            body = self.block(n)
            if body is None:
                continue
            if before is not None and before["t"] == "Header" and n["t"] == "Para":  # the first paragraph below a heading
                body = body.removeprefix(".PP\n") if not self.ms else ".LP" + body.removeprefix(".PP")
            out.append(body)
        return "\n".join(out)


class Context(Latex):
    def __init__(self) -> None:
        super().__init__()
        f = self.f
        f.marks = {"Emph": ("{\\em ", "}"), "Strong": ("{\\bf ", "}"), "Underline": ("\\underbar{", "}"), "Strikeout": ("\\overstrikes{", "}"), "Superscript": ("\\high{", "}"), "Subscript": ("\\low{", "}"), "SmallCaps": ("{\\sc ", "}")}
        f.code = lambda s: "\\type{" + s + "}"
        f.link = lambda t, u, x: f"\\goto{{{t}}}[url({u})]"
        f.image = lambda t, u, x: f"\\externalfigure[{u}]"
        f.code_block = lambda text, c: f"\\starttyping\n{text}\n\\stoptyping"
        f.quote = lambda b: f"\\startblockquote\n{b}\n\\stopblockquote"
        f.rule = "\\thinrule"
        f.math, f.display = ("$", "$"), ("\\startformula ", "\\stopformula")
        f.table = lambda h, rows, a, cap: "\\startTABLE\n" + "\n".join("\\NC " + " \\NC ".join(r) + " \\NC\\NR" for r in ([h] if any(h) else []) + rows) + "\n\\stopTABLE"

    def block(self, n: dict) -> str | None:
        t, c = n["t"], n.get("c")
        if t in ("BulletList", "OrderedList"):
            items = c if t == "BulletList" else c[1]
            tight = all(not i or i[0]["t"] != "Para" for i in items)
            kind = ",".join([*(["n"] if t == "OrderedList" else []), *(["packed"] if tight else [])])
            return "\\startitemize" + (f"[{kind}]" if kind else "") + "\n" + "\n".join("\\item\n" + indented(self.blocks(i), "  ", "  ") for i in items) + "\n\\stopitemize"
        return super().block(n)

    def blocks(self, xs: list[dict], tight: bool = False) -> str:
        """A heading's section ends before the next heading of its level or above."""
        out, i = [], 0
        while i < len(xs):
            if xs[i]["t"] != "Header":
                out.append(self.block(xs[i]))
                i += 1
                continue
            (level, a, text), j = xs[i]["c"], i + 1
            while j < len(xs) and not (xs[j]["t"] == "Header" and xs[j]["c"][0] <= level):
                j += 1
            head = f"\\startsectionlevel[title={{{self.inlines(text)}}},reference={{{a[0]}}}]"
            out += [x for x in (head, self.blocks(xs[i + 1 : j]), "\\stopsectionlevel") if x]
            i = j
        return ("\n" if tight else "\n\n").join(x for x in out if x is not None)


class Texinfo(Renderer):
    def __init__(self) -> None:
        esc = lambda s: s.replace("@", "@@").replace("{", "@{").replace("}", "@}")
        super().__init__(Format(marks={"Emph": ("@emph{", "}"), "Strong": ("@strong{", "}"), "Superscript": ("@sup{", "}"), "Subscript": ("@sub{", "}"), "SmallCaps": ("@sc{", "}")}, escape=esc, code=lambda s: "@code{" + esc(s) + "}", link=lambda t, u, x: f"@uref{{{u},{t}}}", image=lambda t, u, x: f"@image{{{u}}}", header=lambda level, text, a: f"@node {text}\n@{['chapter', 'section', 'subsection', 'subsubsection'][min(level, 4) - 1]} {text}" + (f"\n@anchor{{#{a[0]}}}" if a[0] else ""), code_block=lambda text, c: f"@verbatim\n{text}\n@end verbatim", quote=lambda b: f"@quotation\n{b}\n@end quotation", line_break="@*\n", rule="@bigskip@hrule@bigskip", raw=("texinfo",)))

    def inline(self, n: dict) -> str:
        return "@footnote{" + self.blocks(n["c"]) + "}" if n["t"] == "Note" else super().inline(n)

    def block(self, n: dict) -> str | None:
        t, c = n["t"], n.get("c")
        if t in ("BulletList", "OrderedList"):
            name = "itemize @bullet" if t == "BulletList" else f"enumerate {c[0][0]}"
            return f"@{name}\n" + "\n".join("@item\n" + self.blocks(i) for i in (c if t == "BulletList" else c[1])) + f"\n@end {name.split()[0]}"
        if t == "DefinitionList":
            return "@table @asis\n" + "\n".join(f"@item {self.inlines(term)}\n" + "\n".join(map(self.blocks, defs)) for term, defs in c) + "\n@end table"
        if t == "Table":
            rows: dict[int, list[str]] = {}
            for _, row, cell in cells(n):
                rows.setdefault(row, []).append(self.blocks(cell[4]))
            return "@multitable " + " ".join("{xxxx}" for _ in c[2]) + "\n" + "\n".join("@item\n" + "\n@tab ".join(r) for r in rows.values()) + "\n@end multitable"
        return super().block(n)


def to_rtf(doc: dict) -> str:
    """Rich text: paragraphs with character formats."""

    def esc(s: str) -> str:
        out = ""
        for ch in s:
            if ch in "\\{}":
                out += "\\" + ch
            elif ord(ch) < 128:
                out += ch
            else:
                units = ch.encode("utf-16-le")
                out += "".join(f"\\u{int.from_bytes(units[i : i + 2], 'little', signed=True)}?" for i in range(0, len(units), 2))
        return out

    marks = {"Emph": "\\i ", "Strong": "\\b ", "Underline": "\\ul ", "Strikeout": "\\strike ", "Superscript": "\\super ", "Subscript": "\\sub ", "SmallCaps": "\\scaps "}

    def inl(xs: list[dict]) -> str:
        out = ""
        for n in xs:
            t, c = n["t"], n.get("c")
            if t == "Str":
                out += esc(c)
            elif t in ("Space", "SoftBreak"):
                out += " "
            elif t == "LineBreak":
                out += "\\line "
            elif t in marks:
                out += "{" + marks[t] + inl(c) + "}"
            elif t == "Code":
                out += "{\\f1 " + esc(c[1]) + "}"
            elif t == "Link":
                out += '{\\field{\\*\\fldinst{HYPERLINK "' + esc(c[2][0]) + '"}}{\\fldrslt{\\ul\n' + inl(c[1]) + "\n}}}\n"
            elif t == "Note":
                out += "{\\super\\chftn}{\\*\\footnote\\chftn\\~\\plain\\pard " + blk(c, 0) + "}"
            elif t in ("Quoted", "Span", "Cite"):
                out += esc(plain([n]))
            elif t == "Math":
                out += esc(c[1])
        return out

    def par(body: str, indent: int, first: int = 0, more: str = "") -> str:
        return f"{{\\pard \\ql \\f0 \\sa180 \\li{indent} \\fi{first} {more}{body}\\par}}\n"

    def blk(xs: list[dict], indent: int) -> str:
        out = ""
        for n in xs:
            t, c = n["t"], n.get("c")
            if t in ("Para", "Plain"):
                out += par(inl(c), indent)
            elif t == "Header":
                out += par(inl(c[2]), indent, more=f"\\outlinelevel{c[0] - 1} \\b \\fs{max(22, 40 - 4 * c[0])} ")
            elif t == "CodeBlock":
                out += par("\\f1 " + esc(c[1]).replace("\n", "\\line\n"), indent)
            elif t in ("BulletList", "OrderedList"):
                for k, i in enumerate(c if t == "BulletList" else c[1]):
                    mark = "\\bullet" if t == "BulletList" else f"{c[0][0] + k}."
                    body = blk(i, indent + 360)
                    out += body.replace("\\fi0 ", f"\\fi-360 {mark}\\tx360\\tab ", 1)
            elif t == "HorizontalRule":
                out += par("\\emdash\\emdash\\emdash\\emdash\\emdash", indent)
            elif t == "Table":
                rows: dict[int, list[str]] = {}
                for _, row, cell in cells(n):
                    rows.setdefault(row, []).append("\\intbl " + inl([x for b in cell[4] for x in (b["c"] if b["t"] in ("Plain", "Para") else [])]) + "\\cell")
                for r in rows.values():
                    out += "{\\trowd \\trgaph120 " + "".join(f"\\cellx{8640 * (k + 1) // len(r)}" for k in range(len(r))) + "\n" + "\n".join(r) + "\n\\row}\n"
            else:
                from leafmill.tree import parts

                out += "".join(blk([x for x in ys if x["t"] not in ("Str",)], indent + (720 if t == "BlockQuote" else 0)) if not ys or "c" not in ys[0] or ys[0]["t"] not in ("Str", "Space") else par(inl(ys), indent) for _, ys in parts(n))
        return out

    return "{\\rtf1\\ansi\\deff0{\\fonttbl{\\f0 \\fswiss Helvetica;}{\\f1 \\fmodern Courier;}}\n" + blk(doc["blocks"], 0) + "}\n"


_ESCAPED = re.compile(r'["\\]|[^ -~]')


def to_native(doc: dict) -> str:
    """The literal form of the tree: constructors applied to their arguments."""

    def escaped(m: re.Match) -> str:
        ch = m[0]
        if ch in '"\\':
            return "\\" + ch
        if ch in "\n\t":
            return "\\n" if ch == "\n" else "\\t"
        return f"\\{ord(ch)}" + ("\\&" if m.string[m.end() : m.end() + 1].isdigit() else "")

    def text(s: str) -> str:
        return f'"{_ESCAPED.sub(escaped, s)}"'

    def attr(a: list) -> str:
        return f"( {text(a[0])} , [ {' , '.join(map(text, a[1]))} ] , [ {' , '.join(f'( {text(k)} , {text(v)} )' for k, v in a[2])} ] )".replace("[  ]", "[]")

    def many(xs: list[dict]) -> str:
        return "[ " + " , ".join(map(one, xs)) + " ]" if xs else "[]"

    def lists(xs) -> str:
        return "[ " + " , ".join(map(many, xs)) + " ]" if xs else "[]"

    def row(r) -> str:
        return f"Row {attr(r[0])} [ " + " , ".join(f"Cell {attr(c[0])} {c[1]['t']} (RowSpan {c[2]}) (ColSpan {c[3]}) {many(c[4])}" for c in r[1]) + " ]"

    def rows(rs) -> str:
        return "[ " + " , ".join(map(row, rs)) + " ]" if rs else "[]"

    def one(n: dict) -> str:
        t, c = n["t"], n.get("c")
        if c is None:
            return t
        if t == "Str":
            return f"Str {text(c)}"
        if t == "Run":
            return "Str " + (f'"{c}"' if c.isascii() else text(c)).replace(" ", '" , Space , Str "')
        if t in ("Code", "CodeBlock"):
            return f"{t} {attr(c[0])} {text(c[1])}"
        if t == "Math":
            return f"Math {c[0]['t']} {text(c[1])}"
        if t in ("RawInline", "RawBlock"):
            return f"{t} (Format {text(c[0])}) {text(c[1])}"
        if t == "Header":
            return f"Header {c[0]} {attr(c[1])} {many(c[2])}"
        if t in ("Div", "Span"):
            return f"{t} {attr(c[0])} {many(c[1])}"
        if t == "Quoted":
            return f"Quoted {c[0]['t']} {many(c[1])}"
        if t in ("Link", "Image"):
            return f"{t} {attr(c[0])} {many(c[1])} ( {text(c[2][0])} , {text(c[2][1])} )"
        if t == "OrderedList":
            return f"OrderedList ( {c[0][0]} , {c[0][1]['t']} , {c[0][2]['t']} ) {lists(c[1])}"
        if t in ("BulletList", "LineBlock"):
            return f"{t} {lists(c)}"
        if t == "DefinitionList":
            return "DefinitionList [ " + " , ".join(f"( {many(term)} , {lists(defs)} )" for term, defs in c) + " ]"
        if t == "Figure":
            return f"Figure {attr(c[0])} (Caption Nothing {many(c[1][1])}) {many(c[2])}"
        if t == "Cite":
            cites = [f"Citation {{ citationId = {text(x['citationId'])} , citationPrefix = {many(x['citationPrefix'])} , citationSuffix = {many(x['citationSuffix'])} , citationMode = {x['citationMode']['t']} , citationNoteNum = {x['citationNoteNum']} , citationHash = {x['citationHash']} }}" for x in c[0]]
            return f"Cite [ {' , '.join(cites)} ] {many(c[1])}"
        if t == "Table":
            specs = " , ".join(f"( {a['t']} , {w['t'] if 'c' not in w else 'ColWidth ' + str(w['c'])} )" for a, w in c[2])
            bodies = " , ".join(f"TableBody {attr(b[0])} (RowHeadColumns {b[1]}) {rows(b[2])} {rows(b[3])}" for b in c[4])
            return f"Table {attr(c[0])} (Caption Nothing {many(c[1][1])}) [ {specs} ] (TableHead {attr(c[3][0])} {rows(c[3][1])}) [ {bodies} ] (TableFoot {attr(c[5][0])} {rows(c[5][1])})"
        return f"{t} {many(c)}"

    return many(doc["blocks"]) + "\n"


def to_ipynb(doc: dict) -> str:
    """A notebook: Divs of class cell as they are, what stands between as Markdown cells."""
    from leafmill.sinks.markup import render

    cells_, free = [], []

    def flush() -> None:
        if free:
            cells_.append({"cell_type": "markdown", "metadata": {}, "source": render({"meta": {}, "blocks": list(free)}, "commonmark_x").rstrip("\n").splitlines(True)})
            free.clear()

    for b in doc["blocks"]:
        if b["t"] == "Div" and "cell" in b["c"][0][1]:
            flush()
            (ident, classes, kvs), inner = b["c"]
            cell: dict = {"metadata": {}} | ({"id": ident} if ident else {})
            if "code" in classes:
                code = next((x["c"][1] for x in inner if x["t"] == "CodeBlock"), "")
                count = dict(map(tuple, kvs)).get("execution_count")
                outs = [{"output_type": "stream", "name": "stdout", "text": [x["c"][1] for x in d["c"][1] if x["t"] == "CodeBlock"]} for d in inner if d["t"] == "Div" and "output" in d["c"][0][1]]
                cell |= {"cell_type": "code", "execution_count": int(count) if count else None, "source": code.splitlines(True), "outputs": outs}
            elif "raw" in classes:
                cell |= {"cell_type": "raw", "source": "".join(x["c"][1] for x in inner if x["t"] == "RawBlock").splitlines(True)}
            else:
                cell |= {"cell_type": "markdown", "source": render({"meta": {}, "blocks": inner}, "commonmark_x").rstrip("\n").splitlines(True)}
            cells_.append(cell)
        elif b["t"] == "CodeBlock" and b["c"][0][1][:1] == ["code"]:
            flush()
            cells_.append({"cell_type": "code", "metadata": {}, "execution_count": None, "source": b["c"][1].splitlines(True), "outputs": []})
        else:
            free.append(b)
    flush()
    return json.dumps({"cells": cells_, "metadata": {}, "nbformat": 4, "nbformat_minor": 5}, ensure_ascii=False, indent=1) + "\n"


def _refs(doc: dict) -> list[dict]:
    from leafmill.sources.structured import unmeta

    found = doc["meta"].get("references")
    return unmeta(found) if found else []


def to_csljson(doc: dict) -> str:
    def typed(k, v):
        if k == "date-parts":
            return [[int(x) for x in d] for d in v]
        return {a: typed(a, b) for a, b in v.items()} if isinstance(v, dict) else [typed("", x) for x in v] if isinstance(v, list) else v

    return json.dumps([typed("", r) for r in _refs(doc)], ensure_ascii=False, indent=2) + "\n"


#: Entry types of the interchange form in bibliographies.
_TYPES = {"article-journal": "article", "article-magazine": "article", "article-newspaper": "article", "book": "book", "chapter": "incollection", "paper-conference": "inproceedings", "thesis": "phdthesis", "report": "techreport", "manuscript": "unpublished", "pamphlet": "booklet", "patent": "patent"}


def to_bibtex(doc: dict, biblatex: bool = False) -> str:
    out = []
    for r in _refs(doc):
        fields: list[tuple[str, str]] = []
        for who in ("author", "editor", "translator"):
            if r.get(who):
                fields.append((who, " and ".join(f"{{{p['literal']}}}" if p.get("literal") else f"{p.get('family', '')}, {p['given']}" if p.get("given") else p.get("family", "") for p in r[who])))
        date = (r.get("issued") or {}).get("date-parts") or [[]]
        if date[0] and biblatex:
            fields.append(("date", "-".join(f"{int(x):02d}" for x in date[0])))
        elif date[0]:
            fields.append(("year", str(date[0][0])))
        container = "journaltitle" if biblatex else "journal"
        names = [("title", "title"), ("container-title", container if r.get("type", "").startswith("article") else "booktitle"), ("publisher", "publisher"), ("publisher-place", "location" if biblatex else "address"), ("volume", "volume"), ("issue", "number"), ("page", "pages"), ("DOI", "doi"), ("URL", "url"), ("ISBN", "isbn"), ("ISSN", "issn"), ("edition", "edition"), ("note", "note")]
        fields += [(to, str(r[k]).replace("–", "--")) for k, to in names if r.get(k)]
        kind = "online" if biblatex and r.get("type") == "webpage" else _TYPES.get(r.get("type", ""), "misc")
        out.append(f"@{kind}{{{r.get('id', '')},\n" + ",\n".join(f"  {k} = {{{v}}}" for k, v in fields) + "\n}\n")
    return "\n".join(out)


def slide_html(doc: dict, kind: str) -> str:
    """HTML slides: one section or div per slide."""
    from leafmill.sinks.xml import Html, esc

    h = Html()
    name = {"revealjs": "section", "dzslides": "section"}.get(kind, 'div class="slide"')
    out = []
    for title, body in slides(doc["blocks"]):
        head = f"<h1>{h.inlines(title)}</h1>\n" if title else ""
        out.append(f"<{name}>\n{head}{h.blocks(body)}\n</{name.split()[0]}>")
    body = "\n".join(out)
    title = esc(meta_text(doc["meta"].get("title")))
    first = f"<{name}>\n<h1>{title}</h1>\n</{name.split()[0]}>\n" if title else ""
    return f'<div class="reveal"><div class="slides">\n{first}{body}\n</div></div>\n' if kind == "revealjs" else first + body + "\n"


def to_latex(doc: dict) -> str:
    return Latex().document(doc)


def to_beamer(doc: dict) -> str:
    return Latex(slides=True).document(doc)


def to_context(doc: dict) -> str:
    return Context().document(doc)


def to_texinfo(doc: dict) -> str:
    return Texinfo().document(doc)


def to_man(doc: dict) -> str:
    return Roff().document(doc)


def to_ms(doc: dict) -> str:
    return Roff(ms=True).document(doc)
