"""Markdown to tree: blocks a line at a time, then inlines, then references and notes by lookup.

EXTENSIONS names what each dialect understands; the readers take further names or leave some out.
"""

from __future__ import annotations

import html
import re

from leafmill.extensions import checked
from leafmill.tree import BREAK, LEAVES, NO_ATTR, attr, node, parts, plain, simple_table, trimmed, unique_identifiers
from leafmill.tree import each_word as words
from leafmill.tree import words as in_words

_COMMON = {"fenced_code", "autolink", "raw_html", "images", "start_numbers"}
EXTENSIONS = {
    "commonmark": _COMMON,
    "gfm": _COMMON | {"pipe_tables", "task_lists", "strikeout", "bare_uris", "footnotes", "emoji", "auto_ids", "alerts", "math"},
    "commonmark_x": _COMMON | {"pipe_tables", "task_lists", "strikeout", "footnotes", "emoji", "auto_ids", "smart", "math", "super_sub", "attributes", "definition_lists", "fenced_divs", "yaml"},
    "markdown_strict": {"raw_html", "images"},
    "markdown_github": _COMMON | {"pipe_tables", "task_lists", "strikeout", "bare_uris", "hard_breaks"},
    "markdown_phpextra": {"raw_html", "images", "pipe_tables", "footnotes", "definition_lists", "fenced_code", "attributes", "auto_ids"},
    "markdown_mmd": {"raw_html", "images", "pipe_tables", "footnotes", "definition_lists", "fenced_code", "auto_ids", "math", "super_sub", "implicit_headers"},
    "markdown": _COMMON | {"pipe_tables", "grid_tables", "simple_tables", "task_lists", "strikeout", "footnotes", "inline_notes", "auto_ids", "smart", "math", "super_sub", "attributes", "definition_lists", "fenced_divs", "yaml", "citations", "example_lists", "line_blocks", "implicit_figures", "implicit_headers", "fancy_lists", "title_block", "bracketed_spans", "table_captions", "raw_tex", "native_spans", "native_divs"},
}

#: The long names of extensions, and what they switch here.
NAMES = {
    "fenced_code_blocks": {"fenced_code"}, "backtick_code_blocks": {"fenced_code"}, "autolink_bare_uris": {"bare_uris"}, "hard_line_breaks": {"hard_breaks"}, "auto_identifiers": {"auto_ids"}, "gfm_auto_identifiers": {"auto_ids", "gfm_ids"}, "tex_math_dollars": {"math"}, "tex_math_gfm": {"math"}, "superscript": {"super_sub"}, "subscript": {"super_sub"},
    "header_attributes": {"attributes"}, "link_attributes": {"attributes"}, "inline_code_attributes": {"attributes"}, "fenced_code_attributes": {"attributes"}, "yaml_metadata_block": {"yaml"}, "implicit_header_references": {"implicit_headers"}, "startnum": {"start_numbers"}, "multiline_tables": {"simple_tables"}, "smart_quotes": {"smart"}, "raw_attribute": {"fenced_code"},
}
OTHERS = {"mark", "old_dashes", "wikilinks_title_after_pipe", "wikilinks_title_before_pipe", "tex_math_single_backslash", "tex_math_double_backslash", "ignore_line_breaks", "east_asian_line_breaks", "alerts", "spaced_reference_links", "short_subsuperscripts", "escaped_line_breaks", "intraword_underscores", "lists_without_preceding_blankline", "ascii_identifiers", "gfm_ids"}
KNOWN = set().union(*EXTENSIONS.values()) | set(NAMES) | OTHERS


def switches(names: frozenset) -> set[str]:
    """What extensions of these names switch; an unknown one is an error."""
    checked(names, KNOWN)
    return set().union(*[NAMES.get(n, {n}) for n in names])


#: Abbreviations after which a space doesn't break.
ABBREVIATIONS = set(
    """
    aet. aetat. al. Apr. Aug. bk. Bros. c. Capt. cf. ch. chap. chs. Co. col. Corp. cp. d. Dec. Dr. e.g. ed. eds. esp. f. fasc. Feb. ff. fig. fl.
    fol. fols. Fr. Gen. Gov. Hon. i.e. ill. Inc. incl. Jan. Jr. Jul. Jun. Ltd. M.A. M.D. Mar. Mr. Mrs. Ms. n. n.b. nn. No. Nov. Oct. p. Ph.D.
    pp. Pres. Prof. pt. q.v. Rep. Rev. s.v. s.vv. saec. sec. Sen. Sep. Sept. Sgt. Sr. St. univ. viz. vol. vs.
    """.split()
)
#: Commands that stand in running text even if they are alone on a line, and some that end a paragraph.
_TEX_INLINE = {"textbf", "emph", "textit", "texttt", "textsc", "underline", "cite", "citep", "citet", "ref", "eqref", "url", "href", "footnote", "ifstrequal", "LaTeX", "TeX", "ldots", "dots", "mbox", "verb"}
_TEX_BLOCK = {"newpage", "clearpage", "pagebreak", "include", "input", "hspace", "vspace", "listoffigures", "listoftables", "tableofcontents", "maketitle", "bigskip", "medskip", "smallskip", "noindent", "centering", "appendix"}
_TEX_NAME = re.compile(r"\\([a-zA-Z]+)\*?")
_CITE_KEY = re.compile(r"@(?:(\w(?:[\w]|[:.#$%&+?<>~/=-]+(?=\w))*)|\{([^{}\s]+)\})")
_SMALL = re.compile(r"font-variant:\s*small-caps")


def _tex_args(text: str, i: int) -> int:
    """Where the arguments of a command that begin at i end; -1 if a brace stays open."""
    while i < len(text) and text[i] in "[{":
        a, b = ("[", "]") if text[i] == "[" else ("{", "}")
        depth, j = 0, i
        while j < len(text):
            if text[j] == "\\":
                j += 1
            elif text[j] == a:
                depth += 1
            elif text[j] == b:
                depth -= 1
                if not depth:
                    break
            j += 1
        if j >= len(text):
            return i if a == "[" else -1
        i = j + 1
    return i


def _tex_block(lines: list[str], i: int, in_paragraph: bool) -> tuple[str, int] | None:
    """An environment or a command that fills its lines, and the line after it."""
    m = re.match(r" {0,3}\\begin\{(\w+\*?)\}", lines[i])
    if m and not in_paragraph:
        depth = 0
        for j in range(i, len(lines)):
            depth += lines[j].count(f"\\begin{{{m[1]}}}") - lines[j].count(f"\\end{{{m[1]}}}")
            if depth <= 0:
                rest = lines[j].rpartition(f"\\end{{{m[1]}}}")[2]
                return ("\n".join(lines[i : j + 1]).strip(), j + 1) if not rest.strip() else None
        return None
    m = _TEX_NAME.match(lines[i].lstrip())
    if not m or m[1] in _TEX_INLINE or m[1] in ("begin", "end") and not in_paragraph and m[1] == "begin" or (in_paragraph and m[1] not in _TEX_BLOCK):
        return None
    whole = "\n".join(lines[i : i + 200]).lstrip()
    end = _tex_args(whole, _TEX_NAME.match(whole).end())
    if end < 0 or (tail := whole[end:].split("\n", 1)[0]).strip() and not tail.lstrip().startswith("\\"):
        return None
    if tail.strip():
        return None
    return whole[:end], i + whole[:end].count("\n") + 1


def _joined_words(xs: list[dict], smart: bool) -> list[dict]:
    """Adjacent words as one, and no break after an abbreviation."""
    out: list[dict] = []
    last = before = None  # what stands last, and before it
    for x in xs:
        if last is not None and x["t"] == "Str":
            if last["t"] == "Str":
                out[-1] = last = node("Str", last["c"] + x["c"])
                continue
            if smart and before is not None and last["t"] == "Space" and before["t"] == "Str" and before["c"][-1:] == "." and x["c"][:1].isalnum() and before["c"].lstrip("(‘“") in ABBREVIATIONS:
                out.pop()
                out[-1] = last = node("Str", before["c"] + "\u00a0" + x["c"])
                before = out[-2] if len(out) > 1 else None
                continue
        out.append(x)
        before, last = last, x
    return out


def _html_attr(text: str) -> list:
    """Attributes of an opening tag."""
    found = {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in re.finditer(r"([\w:.-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", text)}
    return attr(found.pop("id", ""), found.pop("class", "").split(), [[k.removeprefix("data-"), v] for k, v in found.items()])


def _small(a: list) -> bool:
    return a[1] == ["smallcaps"] or any(k == "style" and _SMALL.search(v) for k, v in a[2])


def _span(a: list, xs: list[dict]) -> dict:
    return node("SmallCaps", xs) if _small(a) else node("Span", a, xs)


def _numbered(blocks: list[dict]) -> None:
    """Citations and notes counted in order; what is cited in a note has the note's number."""
    count = 0

    def visit(xs: list[dict], inside: int) -> None:
        nonlocal count
        for x in xs:
            own = inside
            if x["t"] in ("Cite", "Note") and not inside:
                count += 1
                own = count if x["t"] == "Note" else 0
            if x["t"] == "Cite":
                for c in x["c"][0]:
                    c["citationNoteNum"] = inside or count
            if x["t"] != "Str" and x["t"] not in LEAVES:
                for _, ys in parts(x):
                    visit(ys, own)

    visit(blocks, 0)


_ATTR = re.compile(r"\{([^{}]*)\}")
_HTML_BLOCK = re.compile(r"<(/?(address|article|aside|blockquote|center|details|dialog|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|p|param|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)\b|!--|\?|!\[CDATA\[)", re.I)
_BULLET = re.compile(r"( {0,3})([*+-])( {1,4}(?=\S)|\t| *$| +)")
_ORDERED = re.compile(r"( {0,3})(\(?(?:[0-9]{1,9}|[a-zA-Z]|[ivxlcdm]+|[IVXLCDM]+|#|@[\w-]*)[.)])( {1,4}(?=\S)|\t| *$| +)")
_SPECIAL = re.compile(r"[\\`*_~^!\[<&$@:=\"'.\n-]| {2,}\n|(?<![a-zA-Z0-9])(?:https?|ftp)://")
#: A line of words without a sign that means something at its begin or in it, and what makes the line before it a term.
_PROSE = re.compile(r"[^\W\d_][\w ,;]*\Z")
_SIGN = re.compile(r"[^\w ,;]")
_DEFINES = re.compile(r"[ \t]*[:~]")
#: A link whose address follows it.
_INLINE_LINK = re.compile(r"\[\w+\]\(\w[\w:/.]*\)")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def attributes(text: str) -> list:
    """What stands in braces: #id, .class, key=value."""
    identifier, classes, kvs = "", [], []
    for m in re.finditer(r"#([^\s#.{}=]+)|\.([^\s#{}=.]+)|([\w:-]+)=(\"[^\"]*\"|'[^']*'|[^\s{}]+)|(-)(?=\s|$)", text):
        if m[1]:
            identifier = m[1]
        elif m[2]:
            classes.append(m[2])
        elif m[3]:
            kvs.append([m[3], m[4].strip("\"'")])
        else:
            classes.append("unnumbered")
    return attr(identifier, classes, kvs)


def _key(label: str) -> str:
    return " ".join(label.split()).casefold()


class _Reader:
    def __init__(self, ext: set[str]) -> None:
        self.ext, self.links, self.notes, self.headers, self.examples, self.example, self.depth = ext, {}, {}, {}, {}, 0, 0

    # --- blocks -----------------------------------------------------------------------------------------------------

    def definitions(self, lines: list[str]) -> list[str]:
        """Takes link and note definitions out; the last of a key wins."""
        out, i, fence = [], 0, ""
        while i < len(lines):
            line = lines[i]
            if "[" not in line and "`" not in line and "~" not in line:  # neither a definition nor a fence
                out.append(line)
                i += 1
                continue
            if m := re.match(r" {0,3}(`{3,}|~{3,})", line):
                fence = "" if fence and m[1].startswith(fence) else fence or m[1]
            if not fence and (m := re.match(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)", line)) and "footnotes" in self.ext:
                body = [m[2]]
                i += 1
                while i < len(lines) and not re.match(r":{3,}\s*$", lines[i]) and (lines[i].startswith(("    ", "\t")) or (lines[i].strip() and body[-1].strip() and not re.match(r" {0,3}\[[^\]]+\]:", lines[i])) or (not lines[i].strip() and i + 1 < len(lines) and lines[i + 1].startswith(("    ", "\t")))):
                    body.append(re.sub(r"^( {1,4}|\t)", "", lines[i]))
                    i += 1
                self.notes[m[1]] = body
                continue
            if not fence and (m := re.match(r" {0,3}\[([^\]^][^\]]*)\]:[ \t]*<?([^\s>]+)>?[ \t]*(?:\"([^\"]*)\"|'([^']*)'|\(([^)]*)\))?[ \t]*(\{[^{}]*\})?[ \t]*$", line)):
                title = m[3] or m[4] or m[5] or ""
                if not title and i + 1 < len(lines) and (t := re.match(r"[ \t]+(?:\"([^\"]*)\"|'([^']*)'|\(([^)]*)\))[ \t]*$", lines[i + 1])):
                    title = t[1] or t[2] or t[3] or ""
                    i += 1
                self.links[_key(m[1])] = [m[2], title]
                i += 1
                continue
            out.append(line)
            i += 1
        return out

    def blocks(self, lines: list[str]) -> list[dict]:
        out: list[dict] = []
        i, para = 0, []

        def flush() -> None:
            if para:
                out.append(self.paragraph(para))
                para.clear()

        while i < len(lines):
            line = lines[i]
            if not line.strip():
                flush()
                i += 1
                continue
            if _PROSE.match(line) and (i + 1 == len(lines) or (not lines[i + 1].strip() and not _DEFINES.match("".join(lines[i + 2 : i + 3])))):  # nothing else can begin here
                para.append(line)
                i += 1
                continue
            if (m := re.match(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$", line)) and "fenced_code" in self.ext:
                flush()
                j, body, inset = i + 1, [], len(line) - len(line.lstrip(" "))
                while j < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[j]):
                    body.append(re.sub(rf"^ {{0,{inset}}}", "", lines[j]))
                    j += 1
                info = m[2].strip()
                raw = re.fullmatch(r"\{=(\w+)\}", info)
                if raw:
                    out.append(node("RawBlock", raw[1], "\n".join(body)))
                else:
                    a = attributes(info[1:-1]) if info.startswith("{") and "attributes" in self.ext else attr("", [info.split()[0]] if info else [])
                    out.append(node("CodeBlock", a, "\n".join(body)))
                i = j + 1
                continue
            if (m := re.match(r":{3,}[ \t]*(\{[^{}]*\}|[\w-]+)[ \t]*:*[ \t]*$", line)) and "fenced_divs" in self.ext:
                flush()
                j, depth, body = i + 1, 1, []
                while j < len(lines):
                    if re.match(r":{3,}[ \t]*(\{[^{}]*\}|[\w-]+)[ \t]*:*[ \t]*$", lines[j]):
                        depth += 1
                    elif re.match(r":{3,}[ \t]*$", lines[j]):
                        depth -= 1
                        if not depth:
                            break
                    body.append(lines[j])
                    j += 1
                out.append(node("Div", attributes(m[1][1:-1]) if m[1].startswith("{") else attr("", [m[1]]), self.blocks(body)))
                i = j + 1
                continue
            if line.lstrip().startswith("\\") and "raw_tex" in self.ext and (found := _tex_block(lines, i, bool(para))):
                flush()
                out.append(node("RawBlock", "tex", found[0]))
                i = found[1]
                continue
            if "native_divs" in self.ext and not para and (m := re.match(r" {0,3}<div\b([^>]*)>(.*)$", line, re.I)):
                j, depth, body = i + 1, 1 + m[2].lower().count("<div") - m[2].lower().count("</div>"), [m[2]]
                while j < len(lines) and depth > 0:
                    depth += len(re.findall(r"<div\b", lines[j], re.I)) - len(re.findall(r"</div>", lines[j], re.I))
                    body.append(lines[j])
                    j += 1
                if depth == 0 and body[-1].lower().rstrip().endswith("</div>"):
                    body[-1] = re.sub(r"</div>\s*$", "", body[-1], flags=re.I)
                    out.append(node("Div", _html_attr(m[1]), self.blocks(body)))
                    i = j
                    continue
            if (m := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line)) and (m[2] is not None or line.strip() == m[1]):
                flush()
                out.append(self.header(len(m[1]), m[2] or ""))
                i += 1
                continue
            if para and (m := re.match(r" {0,3}(=+|-+)[ \t]*$", line)):
                text = "\n".join(para)
                para.clear()
                out.append(self.header(1 if m[1][0] == "=" else 2, text))
                i += 1
                continue
            if re.match(r" {0,3}([*_-])([ \t]*\1){2,}[ \t]*$", line):
                flush()
                out.append(node("HorizontalRule"))
                i += 1
                continue
            if not para and line.startswith(("    ", "\t")):
                body = []
                while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                    body.append(re.sub(r"^( {1,4}|\t)", "", lines[i]))
                    i += 1
                out.append(node("CodeBlock", NO_ATTR, "\n".join(body).rstrip("\n").rstrip()))
                continue
            if re.match(r" {0,3}>", line):
                flush()
                body = []
                while i < len(lines) and lines[i].strip() and (re.match(r" {0,3}>", lines[i]) or (body and body[-1].strip())):
                    body.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                    i += 1
                if "alerts" in self.ext and body and (m := re.fullmatch(r"\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]\s*", body[0])):
                    title = node("Div", attr("", ["title"]), [node("Para", words(m[1].capitalize()))])
                    out.append(node("Div", attr("", [m[1].lower()]), [title, *self.blocks(body[1:])]))
                else:
                    out.append(node("BlockQuote", self.blocks(body)))
                continue
            if line.startswith("| ") and "line_blocks" in self.ext and not (i + 1 < len(lines) and re.match(r"\|?[ :|-]*-[ :|-]*$", lines[i + 1])):
                flush()
                body = []
                while i < len(lines) and (lines[i].startswith("|") or (body and lines[i].startswith(" "))):
                    if lines[i].startswith("|"):
                        text = lines[i][2:]
                        body.append("\u00a0" * (len(text) - len(text.lstrip(" "))) + text.strip())
                    else:
                        body[-1] += " " + lines[i].strip()
                    i += 1
                out.append(node("LineBlock", [self.inlines(x) for x in body]))
                continue
            if (not para or self.depth) and (m := self.marker(line)):
                flush()
                block, i = self.list_at(lines, i)
                out.append(block)
                continue
            found = self.table_at(lines, i) if not para else None
            if found:
                table, i = found
                out.append(table)
                continue
            if not para and _HTML_BLOCK.match(line) and "raw_html" in self.ext:
                body = []
                until = "-->" if line.startswith("<!--") else None
                while i < len(lines) and (until or lines[i].strip()):
                    body.append(lines[i])
                    i += 1
                    if until and until in body[-1]:
                        break
                out.append(node("RawBlock", "html", "\n".join(body)))
                continue
            if "definition_lists" in self.ext and not para and (found := self.definition_at(lines, i)):
                block, i = found
                out.append(block)
                continue
            if para and (m := re.match(r" {0,3}(?:[*+-]|1[.)]) +\S", line)) and "fancy_lists" not in self.ext and self.marker(line):
                flush()
                continue
            para.append(line.lstrip() if not para else line)
            i += 1
        flush()
        return out

    def paragraph(self, lines: list[str]) -> dict:
        inlines = trimmed(self.inlines("\n".join(x if i == len(lines) - 1 else x for i, x in enumerate(lines)).rstrip()))
        if "implicit_figures" in self.ext and len(inlines) == 1 and inlines[0]["t"] == "Image" and inlines[0]["c"][1]:
            a, text, target = inlines[0]["c"]
            return node("Figure", [a[0], [], []], [None, [node("Plain", text)]], [node("Plain", [node("Image", ["", a[1], a[2]], text, target)])])
        return node("Para", inlines)

    def header(self, level: int, text: str) -> dict:
        a = NO_ATTR
        if "attributes" in self.ext and (m := re.search(r"[ \t]*\{([^{}]*)\}[ \t]*$", text)):
            text, a = text[: m.start()], attributes(m[1])
        return node("Header", level, a, trimmed(self.inlines(text.strip())))

    def marker(self, line: str):
        if m := _BULLET.match(line):
            return m
        m = _ORDERED.match(line)
        if not m:
            return None
        own = m[2].strip("().")
        if own.isdigit():
            return m if "(" not in m[2] or "fancy_lists" in self.ext else None
        if own.startswith("@"):
            return m if "example_lists" in self.ext else None
        return m if "fancy_lists" in self.ext and not (len(own) == 1 and own.isupper() and m[2].endswith(".") and len(m[3]) < 2) else None

    def kind(self, mark: str) -> tuple:
        """What items of one list share: bullet character, or number style and delimiter."""
        if mark in "*+-":
            return ("bullet", mark) if "fancy_lists" not in self.ext else ("bullet",)
        own = mark.strip("().")
        delim = "TwoParens" if mark.startswith("(") else "OneParen" if mark.endswith(")") else "Period"
        if own.startswith("@"):
            return "Example", delim
        if own.isdigit():
            return "Decimal", delim
        if own == "#":
            return "DefaultStyle", "DefaultDelim"
        roman = set(own.lower()) <= set(_ROMAN) and (len(own) > 1 or own.lower() == "i")
        return ("Lower" if own.islower() else "Upper") + ("Roman" if roman else "Alpha"), delim

    def list_at(self, lines: list[str], i: int) -> tuple[dict, int]:
        m = self.marker(lines[i])
        kind, first = self.kind(m[2]), m[2].strip("().")
        items: list[list[str]] = []
        numbers: list[int] = []
        loose, blank = False, False
        while i < len(lines):
            m = self.marker(lines[i])
            if not m or not (self.kind(m[2]) == kind or (kind[0].endswith("Alpha") and self.kind(m[2])[0].endswith("Roman") and len(m[2].strip("().")) == 1)) or re.match(r" {0,3}([*_-])([ \t]*\1){2,}[ \t]*$", lines[i]):
                break
            loose = loose or (blank and bool(items))
            width = m.end() if m[3].strip(" ") == "" and len(m[3]) <= 4 and lines[i][m.end() :].strip() else m.end(2) + 1
            if kind[0] == "Example":
                self.example += 1
                numbers.append(self.example)
                if len(m[2].strip("().")) > 1:
                    self.examples[m[2].strip("().")[1:]] = self.example
            body, blank = [lines[i][m.end() :] if m[3] != "\t" else lines[i][m.end() :]], False
            i += 1
            while i < len(lines):
                line = lines[i].replace("\t", "    ", 1) if lines[i].startswith("\t") else lines[i]
                indent = len(line) - len(line.lstrip(" "))
                if not line.strip():
                    body.append("")
                    blank = True
                elif indent >= width or (indent >= 2 and not blank and indent >= min(width, 4)):
                    if blank and body[-1] == "" and any(body):
                        loose = loose or not self.marker(line[min(width, indent) :])
                    body.append(line[min(width, indent) :])
                    blank = False
                elif blank or self.marker(line) or re.match(r" {0,3}(#{1,6} |>|`{3}|~{3})", line):
                    break
                else:
                    body.append(line.lstrip())
                i += 1
            while body and not body[-1].strip():
                body.pop()
            items.append(body)
        self.depth += 1  # inside an item a list needs no blank line before it
        content = [self.blocks(self.definitions(b)) for b in items]
        self.depth -= 1
        if "task_lists" in self.ext:
            content = [_task(c) for c in content]
        if not loose:
            content = [[node("Plain", b["c"]) if b["t"] == "Para" else b for b in c] for c in content]
        if kind[0] == "bullet":
            return node("BulletList", content), i
        start = int(first) if first.isdigit() else numbers[0] if numbers else _number(first, kind[0])
        return node("OrderedList", [start, {"t": kind[0]}, {"t": kind[1]}], content), i

    def definition_at(self, lines: list[str], i: int):
        j = i + 1
        if j < len(lines) and not lines[j].strip():
            j += 1
        if j >= len(lines) or not re.match(r" {0,3}[:~][ \t]+\S", lines[j]):
            return None
        pairs = []
        while i < len(lines):
            j = i + 1
            gap = j < len(lines) and not lines[j].strip()
            j += gap
            if j >= len(lines) or not re.match(r" {0,3}[:~][ \t]+\S", lines[j]) or not lines[i].strip():
                break
            term, defs = self.inlines(lines[i].strip()), []
            i = j
            while i < len(lines) and (m := re.match(r" {0,3}[:~][ \t]+", lines[i])):
                body = [lines[i][m.end() :]]
                i += 1
                while i < len(lines) and (lines[i].startswith(("  ", "\t")) or (not lines[i].strip() and i + 1 < len(lines) and lines[i + 1].startswith(("    ", "\t"))) or (lines[i].strip() and body[-1].strip() and not re.match(r" {0,3}[:~][ \t]+", lines[i]) and not (i + 1 < len(lines) and re.match(r" {0,3}[:~][ \t]+", lines[i + 1])))):
                    body.append(re.sub(r"^( {1,4}|\t)", "", lines[i]))
                    i += 1
                while body and not body[-1].strip():
                    body.pop()
                inner = self.blocks(body)
                defs.append(inner if gap else [node("Plain", b["c"]) if b["t"] == "Para" else b for b in inner])
            pairs.append([term, defs])
            while i < len(lines) and not lines[i].strip():
                i += 1
        return (node("DefinitionList", pairs), i) if pairs else None

    # --- tables -----------------------------------------------------------------------------------------------------

    def table_at(self, lines: list[str], i: int):
        found = None
        if "pipe_tables" in self.ext and i + 1 < len(lines) and "|" in lines[i] and re.match(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$", lines[i + 1]) and ("|" in lines[i + 1]):
            found = self.pipe_table(lines, i)
        elif "grid_tables" in self.ext and re.match(r" {0,3}\+[-=:]+(\+[-=:]+)*\+[ \t]*$", lines[i]):
            found = self.grid_table(lines, i)
        elif "simple_tables" in self.ext and i + 2 < len(lines) and re.match(r" {0,3}-+([ \t]+-+)+[ \t]*$", lines[i + 1]):
            found = self.column_table(lines, i)
        if not found:
            return None
        table, i = found
        j = i
        while j < len(lines) and not lines[j].strip():
            j += 1
        if "table_captions" in self.ext and j < len(lines) and (m := re.match(r"(?:[Tt]able)?:[ \t]*(.*)", lines[j])):
            text = [m[1]]
            j += 1
            while j < len(lines) and lines[j].strip():
                text.append(lines[j])
                j += 1
            table["c"][1] = [None, [node("Plain", trimmed(self.inlines("\n".join(text))))]]
            i = j
        return table, i

    def cell(self, text: str) -> list[dict]:
        inlines = trimmed(self.inlines(text.strip()))
        return [node("Plain", inlines)] if inlines else []

    def pipe_table(self, lines: list[str], i: int):
        cut = lambda line: [c.replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"(?<!\\)\|[ \t]*$", "", re.sub(r"^[ \t]*\|", "", line)))]
        head, marks = cut(lines[i]), [c.strip() for c in cut(lines[i + 1])]
        if len(head) > len(marks):
            return None
        aligns = ["AlignCenter" if m[0] == m[-1] == ":" and len(m) > 1 else "AlignLeft" if m[0] == ":" else "AlignRight" if m[-1] == ":" else "AlignDefault" for m in marks]
        i, rows = i + 2, []
        while i < len(lines) and "|" in lines[i] and lines[i].strip():
            rows.append([self.cell(c) for c in cut(lines[i])][: len(marks)])
            i += 1
        header = [self.cell(c) for c in head]
        return simple_table(header + [[]] * (len(marks) - len(header)) if any(header) else None, rows, aligns), i

    def grid_table(self, lines: list[str], i: int):
        at = [m.start() for m in re.finditer(r"\+", lines[i])]
        rows, head, current, j = [], None, None, i + 1
        while j < len(lines) and lines[j][:1] in "+|":
            if lines[j].startswith("+"):
                if current is not None:
                    row = [self.blocks([x.rstrip()[1:] if x.startswith(" ") else x.rstrip() for x in c]) for c in current]
                    row = [[node("Plain", b["c"]) if b["t"] == "Para" and len(c) == 1 else b for b in c] for c in row]
                    if "=" in lines[j] and head is None and not rows:
                        head = row
                    else:
                        rows.append(row)
                current = None
            else:
                current = current or [[] for _ in at[1:]]
                for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    current[k].append(lines[j][a + 1 : b])
            j += 1
        return simple_table(head, rows), j

    def column_table(self, lines: list[str], i: int):
        spans = [m.span() for m in re.finditer(r"-+", lines[i + 1])]
        cut = lambda line: [line[a : (spans[k + 1][0] if k + 1 < len(spans) else None)].strip() for k, (a, _) in enumerate(spans)]
        aligns = []
        for k, (a, b) in enumerate(spans):
            text = lines[i][a : (spans[k + 1][0] if k + 1 < len(spans) else None)].rstrip()
            left, right = not text[:1].isspace() and bool(text), len(text) >= b - a
            aligns.append("AlignDefault" if left and right else "AlignLeft" if left else "AlignRight" if right else "AlignCenter")
        j, rows = i + 2, []
        while j < len(lines) and lines[j].strip() and not re.match(r" {0,3}-+([ \t]+-+)*[ \t]*$", lines[j]):
            rows.append([self.cell(c) for c in cut(lines[j])])
            j += 1
        if j < len(lines) and lines[j].strip():
            j += 1
        return simple_table([self.cell(c) for c in cut(lines[i])], rows, aligns), j

    # --- inlines ----------------------------------------------------------------------------------------------------

    def inlines(self, text: str) -> list[dict]:
        if not _SIGN.search(text) and "_" not in text:  # words, in which _SPECIAL finds nothing
            return in_words(text)
        out: list[dict] = []
        buffer = ""
        i = 0

        def flush() -> None:
            nonlocal buffer
            if buffer:
                new = words(buffer)
                if out and new[0]["t"] == "Str" and out[-1]["t"] == "Str":
                    out[-1] = node("Str", out[-1]["c"] + new[0]["c"])
                    new = new[1:]
                out.extend(new)
                buffer = ""

        while i < len(text):
            m = _SPECIAL.search(text, i)
            if not m or m.start() > i:
                end = m.start() if m else len(text)
                buffer += text[i:end]
                i = end
                continue
            ch = text[i]
            found = None
            if ch == "\\" and (m := re.compile(r"(\\{1,2})(?:\((.+?)\1\)|\[(.+?)\1\])", re.S).match(text, i)) and ("tex_math_single_backslash" if len(m[1]) == 1 else "tex_math_double_backslash") in self.ext:
                found = [node("Math", {"t": "InlineMath" if m[2] else "DisplayMath"}, (m[2] or m[3]).strip())], m.end()
            elif ch == "\\" and i + 1 < len(text):
                if text[i + 1] == "\n":
                    found = [BREAK], i + 2
                elif text[i + 1] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
                    flush_to = text[i + 1]
                    buffer += flush_to
                    i += 2
                    continue
                elif "raw_tex" in self.ext and (m := _TEX_NAME.match(text, i)):
                    found = self.tex(text, i, m)
                elif text[i + 1] == " " and "attributes" in self.ext:
                    buffer += "\u00a0"
                    i += 2
                    continue
            elif ch == " " and (m := re.compile(r" {2,}\n").match(text, i)):
                found = [BREAK], m.end()
            elif ch == "\n" and "hard_breaks" in self.ext:
                found = [BREAK], i + 1
            elif ch == "`":
                found = self.code(text, i)
            elif ch in "*_":
                found = self.emphasis(text, i)
            elif ch == "~" and text.startswith("~~", i) and "strikeout" in self.ext:
                found = self.delimited(text, i, "~~", "Strikeout")
            elif ch in "~^" and "super_sub" in self.ext and not text.startswith("^[", i) and (m := re.compile(r"([~^])((?:\\.|[^\s~^\\])+)\1").match(text, i)):
                found = [node("Subscript" if ch == "~" else "Superscript", self.inlines(m[2]))], m.end()
            elif ch == "^" and text.startswith("^[", i) and "inline_notes" in self.ext and (end := _closing(text, i + 1)) > 0:
                found = [node("Note", [node("Para", self.inlines(text[i + 2 : end]))])], end + 1
            elif ch == "=" and text.startswith("==", i) and "mark" in self.ext:
                end = text.find("==", i + 2)
                if end > i + 2 and not text[i + 2].isspace():
                    found = [node("Span", attr("", ["mark"]), self.inlines(text[i + 2 : end]))], end + 2
            elif ch == "!" and text.startswith("![", i):
                found = self.link(text, i + 1, image=True)
            elif ch == "[":
                found = self.wikilink(text, i) or self.note(text, i) or self.citation(text, i) or self.link(text, i)
            elif ch == "<":
                found = self.angle(text, i)
            elif ch == "&" and (m := re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|\w+);").match(text, i)) and html.unescape(m[0]) != m[0]:
                buffer += html.unescape(m[0])
                i = m.end()
                continue
            elif ch == "$" and "math" in self.ext:
                found = self.math(text, i)
            elif ch == "@" and "citations" in self.ext and (i == 0 or not text[i - 1].isalnum()) and (m := _CITE_KEY.match(text, i)):
                found = self.author_citation(text, m)
            elif ch == ":" and "emoji" in self.ext and (m := re.compile(r":([a-z0-9_+-]+):").match(text, i)) and m[1] in EMOJI:
                found = [node("Span", attr("", ["emoji"], [["data-emoji", m[1]]]), [node("Str", EMOJI[m[1]])])], m.end()
            elif ch in "\"'" and "smart" in self.ext:
                found = self.quoted(text, i)
                if not found and ch == "'":
                    buffer += "’"
                    i += 1
                    continue
            elif ch == "-" and "smart" in self.ext and "old_dashes" in self.ext and (m := re.compile(r"--|-(?=[0-9])").match(text, i)):
                buffer += "—" if len(m[0]) == 2 else "–"
                i = m.end()
                continue
            elif ch == "-" and "smart" in self.ext and "old_dashes" not in self.ext and (m := re.compile(r"---?").match(text, i)):
                buffer += "—" if len(m[0]) == 3 else "–"
                i = m.end()
                continue
            elif ch == "." and "smart" in self.ext and text.startswith("...", i):
                buffer += "…"
                i += 3
                continue
            elif ch in "hfm" and "bare_uris" in self.ext and (i == 0 or not text[i - 1].isalnum()) and (m := re.compile(r"(https?|ftp)://[^\s<>]*[^\s<>.,;:!?'\")\]]").match(text, i)):
                found = [node("Link", attr("", ["uri"]), [node("Str", m[0])], [m[0], ""])], m.end()
            if found:
                flush()
                out += found[0]
                i = found[1]
            else:
                buffer += ch
                i += 1
        flush()
        return _joined_words(out, "smart" in self.ext)

    def tex(self, text: str, i: int, m: re.Match):
        if m[1] == "begin" and (e := re.compile(r"\{(\w+\*?)\}").match(text, m.end())):
            close = f"\\end{{{e[1]}}}"
            end = text.find(close, e.end())
            return ([node("RawInline", "tex", text[i : end + len(close)])], end + len(close)) if end > 0 else None
        end = _tex_args(text, m.end())
        if end < 0:
            end = m.end()
        if end == m.end():
            end += len(text[end:]) - len(text[end:].lstrip(" "))
        return [node("RawInline", "tex", text[i:end])], end

    def code(self, text: str, i: int):
        run = re.compile("`+").match(text, i)[0]
        m = re.compile(rf"(?<!`){run}(?!`)").search(text, i + len(run))
        if not m:
            return [node("Str", run)], i + len(run)
        body, end = text[i + len(run) : m.start()].replace("\n", " "), m.end()
        body = body[1:-1] if body.startswith(" ") and body.endswith(" ") and body.strip() else body.strip() if "fancy_lists" in self.ext else body
        a = NO_ATTR
        if m2 := re.compile(r"\{=(\w+)\}").match(text, end):
            return [node("RawInline", m2[1], body)], m2.end()
        if "attributes" in self.ext and (m2 := _ATTR.match(text, end)):
            a, end = attributes(m2[1]), m2.end()
        return [node("Code", a, body)], end

    def emphasis(self, text: str, i: int):
        ch = text[i]
        run = re.compile(re.escape(ch) + "+").match(text, i)[0]
        n = min(len(run), 3)
        after = text[i + len(run) : i + len(run) + 1]
        if not after or after.isspace() or (ch == "_" and i and text[i - 1].isalnum()):
            return [node("Str", run)], i + len(run)
        for k in (n, *range(n - 1, 0, -1)):
            end = _matching(text, i + k, ch, k)
            if end > 0:
                inner = self.inlines(text[i + k : end])
                whole = node("Strong", inner) if k >= 2 else node("Emph", inner)
                return [node("Emph", [whole])] if k == 3 else [whole], end + k
        return [node("Str", run)], i + len(run)

    def delimited(self, text: str, i: int, mark: str, kind: str):
        end = text.find(mark, i + len(mark))
        if end < 0 or text[i + len(mark)].isspace() or text[end - 1].isspace():
            return None
        return [node(kind, self.inlines(text[i + len(mark) : end]))], end + len(mark)

    def quoted(self, text: str, i: int):
        mark = text[i]
        if i and (text[i - 1].isalnum() or text[i - 1] in ".,;:!?)"):
            return None
        if i + 1 >= len(text) or text[i + 1].isspace():
            return None
        m = re.compile(rf"(?<=[^\s\\]){mark}(?![a-zA-Z0-9])").search(text, i + 1)
        if not m:
            return None
        return [node("Quoted", {"t": "DoubleQuote" if mark == '"' else "SingleQuote"}, self.inlines(text[i + 1 : m.start()]))], m.end()

    def math(self, text: str, i: int):
        if text.startswith("$$", i):
            end = text.find("$$", i + 2)
            return ([node("Math", {"t": "DisplayMath"}, text[i + 2 : end])], end + 2) if end > 0 else None
        m = re.compile(r"\$(?=\S)((?:\\.|[^$\\])*?)(?<=\S)\$(?![0-9])").match(text, i)
        return ([node("Math", {"t": "InlineMath"}, m[1])], m.end()) if m and m[1] else None

    def angle(self, text: str, i: int):
        if m := re.compile(r"<([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*)>").match(text, i):
            return [node("Link", attr("", ["uri"]), [node("Str", m[1])], [m[1], ""])], m.end()
        if m := re.compile(r"<([\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)*)>").match(text, i):
            return [node("Link", attr("", ["email"]), [node("Str", m[1])], ["mailto:" + m[1], ""])], m.end()
        if "native_spans" in self.ext and (m := re.compile(r"<span\b((?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*)>", re.I).match(text, i)):
            depth, at = 1, m.end()
            for t in re.finditer(r"<(/?)span\b[^>]*>", text[m.end() :], re.I):
                depth += -1 if t[1] else 1
                if not depth:
                    at += t.start()
                    return [_span(_html_attr(m[1]), self.inlines(text[m.end() : at]))], at + t.end() - t.start()
        if "raw_html" in self.ext and (m := re.compile(r"<(?:/?[a-zA-Z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?|!--.*?--|\?.*?\?)>", re.S).match(text, i)):
            return [node("RawInline", "html", m[0])], m.end()
        return None

    def wikilink(self, text: str, i: int):
        after = "wikilinks_title_after_pipe" in self.ext
        if not (after or "wikilinks_title_before_pipe" in self.ext) or not (m := re.compile(r"\[\[([^\]|\n]+)(?:\|([^\]\n]+))?\]\]").match(text, i)):
            return None
        url, title = (m[1], m[2] or m[1]) if after else (m[2] or m[1], m[1])
        return [node("Link", attr("", ["wikilink"]), words(title), [url, ""])], m.end()

    def note(self, text: str, i: int):
        m = re.compile(r"\[\^([^\]\s]+)\]").match(text, i)
        if not m or "footnotes" not in self.ext or m[1] not in self.notes:
            return None
        inner = _Reader(self.ext)  # a note sees the links but no notes
        inner.links, inner.headers = self.links, self.headers
        return [node("Note", inner.blocks(self.notes[m[1]]))], m.end()

    def citation(self, text: str, i: int):
        if "citations" not in self.ext:
            return None
        end = _closing(text, i)
        if end < 0 or not re.search(r"(^|[\s;-])-?@[\w{]", text[i + 1 : end]):
            return None
        if text.startswith("(", end + 1) or _ATTR.match(text, end + 1):
            return None
        out = [self.cited(part) for part in text[i + 1 : end].split(";")]
        if not all(out):
            return None
        return [node("Cite", out, words(text[i : end + 1]))], end + 1

    def author_citation(self, text: str, m: re.Match):
        key = m[1] or m[2]
        if key in self.examples:
            return [node("Str", str(self.examples[key]))], m.end()
        end, suffix, more, shown = m.end(), [], [], m[0]
        if (close := _closing(text, m2.end() - 1) if (m2 := re.compile(r"[ \t]*\[").match(text, end)) else -1) > 0 and not text.startswith(("(", "{"), close + 1):
            first, *rest = text[m2.end() : close].split(";")
            others = [self.cited(x) for x in rest]
            if "@" not in first and all(others):
                suffix, more = self.inlines(first.strip()), others
                shown, end = text[m.start() : close + 1], close + 1
        c = {"citationId": key, "citationPrefix": [], "citationSuffix": suffix, "citationMode": {"t": "AuthorInText"}, "citationNoteNum": 0, "citationHash": 0}
        return [node("Cite", [c, *more], words(shown))], end

    def cited(self, part: str) -> dict | None:
        """One citation of a group: prefix, key and suffix."""
        m = re.search(rf"(-?){_CITE_KEY.pattern}", part)
        if not m:
            return None
        prefix, suffix = trimmed(self.inlines(part[: m.start()].strip())), self.inlines(part[m.end() :].rstrip())
        return {"citationId": m[2] or m[3], "citationPrefix": prefix, "citationSuffix": suffix, "citationMode": {"t": "SuppressAuthor" if m[1] else "NormalCitation"}, "citationNoteNum": 0, "citationHash": 0}

    def link(self, text: str, i: int, image: bool = False):
        end = _closing(text, i)
        if end < 0:
            return None
        inner, at = text[i + 1 : end], end + 1
        target = None
        m = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:\\.|[^\s()\\]|\((?:\\.|[^\s()\\])*\))*))(?:\s+(?:\"((?:\\.|[^\"\\])*)\"|'((?:\\.|[^'\\])*)'|\(([^()]*)\)))?\s*\)").match(text, at)
        if m:
            url = m[1] if m[1] is not None else m[2]
            target, at = [re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", html.unescape(url)), re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", m[3] or m[4] or m[5] or "")], m.end()
        else:
            m = re.compile(r"[ ]?\[([^\]]*)\]" if "spaced_reference_links" in self.ext else r"\[([^\]]*)\]").match(text, at)
            key = _key((m[1] or inner) if m else inner)
            if not key:
                return None
            target = self.links.get(key) or ([f"#{self.headers[key]}", ""] if key in self.headers and not image else None)
            if target:
                at = m.end() if m else at
            elif not image and "bracketed_spans" in self.ext and (m := _ATTR.match(text, at)):
                return [_span(attributes(m[1]), self.inlines(inner))], m.end()
            else:
                return None
        a = NO_ATTR
        if "attributes" in self.ext and (m := _ATTR.match(text, at)):
            a, at = attributes(m[1]), m.end()
        return [node("Image" if image else "Link", a, self.inlines(inner), list(target))], at


#: Aliases of emoji.
EMOJI = {"smile": "😄", "heart": "❤️", "thumbsup": "👍", "+1": "👍", "-1": "👎", "tada": "🎉", "warning": "⚠️", "rocket": "🚀", "bug": "🐛", "fire": "🔥", "star": "⭐", "white_check_mark": "✅", "x": "❌", "eyes": "👀", "sparkles": "✨"}


def _number(text: str, style: str) -> int:
    if style.endswith("Alpha"):
        return ord(text.lower()) - 96
    if style.endswith("Roman"):
        values = [_ROMAN[c] for c in text.lower()]
        return sum(-v if any(w > v for w in values[k + 1 : k + 2]) else v for k, v in enumerate(values))
    return 1


def _task(item: list[dict]) -> list[dict]:
    if item and item[0]["t"] in ("Plain", "Para") and (m := re.match(r"\[([ xX])\] ", plain(item[0]["c"][:4]) + " ")):
        rest = item[0]["c"]
        text = ""
        while rest and len(text) < 3:
            text += plain(rest[:1])
            rest = rest[1:]
        return [node(item[0]["t"], [node("Str", "☐" if m[1] == " " else "☒"), *rest]), *item[1:]]
    return item


def _closing(text: str, i: int) -> int:
    """The bracket that closes the one at i; -1 if none does."""
    depth = 0
    while i < len(text):
        if text[i] == "\\":
            i += 1
        elif text[i] == "`":
            run = re.compile("`+").match(text, i)[0]
            end = text.find(run, i + len(run))
            i = end + len(run) - 1 if end > 0 else i
        elif text[i] == "[":
            depth += 1
        elif text[i] == "]":
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def _matching(text: str, i: int, ch: str, k: int) -> int:
    """Where a closing run of k marks begins; -1 if there is none."""
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        if text[i] == "`":
            run = re.compile("`+").match(text, i)[0]
            end = text.find(run, i + len(run))
            i = end + len(run) if end > 0 else i + len(run)
            continue
        if text[i] == ch:
            run = len(re.compile(re.escape(ch) + "+").match(text, i)[0])
            closes = not text[i - 1].isspace() and not (ch == "_" and text[i + run : i + run + 1].isalnum())
            if closes and (run == k or (run > k and run >= 3)):
                return i
            if run != k and not closes and run < 3:
                # An inner run of another length opens: skip to what closes it.
                end = _matching(text, i + run, ch, run)
                if end > 0:
                    i = end + run
                    continue
            i += run
            continue
        i += 1
    return -1


def _yaml(lines: list[str]) -> tuple[dict, list[str]]:
    """A metadata block at the start: keys with scalars or lists of scalars."""
    if not lines or lines[0].rstrip() != "---":
        return {}, lines
    end = next((i for i in range(1, len(lines)) if lines[i].rstrip() in ("---", "...")), None)
    if end is None:
        return {}, lines
    try:
        import yaml

        found = yaml.safe_load("\n".join(lines[1:end])) or {}
    except Exception:
        return {}, lines
    return ({str(k): _meta(v) for k, v in found.items() if not str(k).endswith("_")} if isinstance(found, dict) else {}), lines[end + 1 :]


def _meta(v) -> dict:
    if isinstance(v, bool):
        return {"t": "MetaBool", "c": v}
    if isinstance(v, list):
        return {"t": "MetaList", "c": [_meta(x) for x in v]}
    if isinstance(v, dict):
        return {"t": "MetaMap", "c": {str(k): _meta(x) for k, x in v.items() if not str(k).endswith("_")}}
    return {"t": "MetaInlines", "c": read_markdown(str(v), "markdown")["blocks"][0]["c"] if v not in (None, "") else []} if isinstance(v, str) and v.strip() and "\n" not in v else {"t": "MetaString", "c": "" if v is None else str(v)}


def read_markdown(text: str, dialect: str = "markdown", plus: frozenset = frozenset(), minus: frozenset = frozenset()) -> dict:
    """A document of a dialect, with extensions added or left out."""
    ext = (EXTENSIONS[dialect] | switches(plus)) - switches(minus)
    lines, meta = text.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n") if "\t" in text else text.replace("\r", "").split("\n"), {}
    if "yaml" in ext:
        meta, lines = _yaml(lines)
    if "title_block" in ext:
        for name in ("title", "author", "date"):
            if lines and (m := re.match(r"%[ \t]?(.*)", lines[0])):
                if m[1].strip():
                    meta[name] = {"t": "MetaInlines", "c": words(m[1].strip())}
                lines = lines[1:]
            else:
                break
    r = _Reader(ext)
    lines = r.definitions(lines)
    if "implicit_headers" in ext and text.count("[") > len(_INLINE_LINK.findall(text)):  # else no link looks for a heading
        first = _Reader(ext)
        first.links, first.notes = r.links, r.notes
        for b in unique_identifiers(first.blocks(lines)):
            if b["t"] == "Header":
                r.headers.setdefault(_key(plain(b["c"][2])), b["c"][1][0])
    blocks = r.blocks(lines)
    if "citations" in ext:
        _numbered(blocks)
    if "ignore_line_breaks" in ext or "east_asian_line_breaks" in ext:
        blocks = _joined(blocks, "ignore_line_breaks" not in ext)
    return {"meta": meta, "blocks": unique_identifiers(blocks) if "auto_ids" in ext else blocks}


def _joined(blocks: list[dict], wide_only: bool) -> list[dict]:
    """Without soft breaks: all, or those between two wide characters."""
    from unicodedata import east_asian_width

    from leafmill.tree import mapped

    def fix(xs: list[dict]) -> list[dict]:
        out = []
        for i, x in enumerate(xs):
            if x["t"] == "SoftBreak":
                a, b = plain(xs[i - 1 : i])[-1:], plain(xs[i + 1 : i + 2])[:1]
                if not wide_only or (a and b and east_asian_width(a) in "WF" and east_asian_width(b) in "WF"):
                    continue
            out.append(mapped(x, fix))
        return out

    return fix(blocks)


