"""Tables, notebooks, outlines and serialised trees to tree."""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree

from leafmill.sources.markdown import read_markdown
from leafmill.tree import NO_ATTR, attr, making_runs, node, run, simple_table, words


def parse_csv(text: str, sep: str = ",", quote: str | None = '"') -> list[list[str]]:
    """Records: a quoted cell may hold line ends and doubled quotes; blanks after a separator are skipped."""
    rows, row, cell, i, text = [], [], "", 0, text.replace("\r\n", "\n")
    while i < len(text):
        ch = text[i]
        if quote and ch == quote and not cell.strip():
            j, cell = i + 1, ""
            while j < len(text):
                if text[j] == quote:
                    if text.startswith(quote, j + 1):
                        j += 1
                    else:
                        break
                cell += text[j]
                j += 1
            i = j + 1
            continue
        if ch == sep:
            row.append(cell)
            cell = ""
            while sep == "," and i + 1 < len(text) and text[i + 1] == " ":
                i += 1
        elif ch == "\n":
            row.append(cell)
            if len(row) > 1 or row[0]:
                rows.append(row)
            row, cell = [], ""
        else:
            cell += ch
        i += 1
    if cell or row:
        rows.append([*row, cell])
    return rows


def read_csv(text: str, sep: str = ",", quote: str | None = '"') -> dict:
    """One table; the first record is its head."""
    cell = lambda s: [node("Plain", words(s.strip()))] if s.strip() else []
    rows = [[cell(c) for c in r] for r in parse_csv(text, sep, quote)]
    return {"meta": {}, "blocks": [simple_table(rows[0], rows[1:])] if rows else []}


def read_tsv(text: str) -> dict:
    return read_csv(text, "\t", None)


#: Words with a space between each two; within a string the quotes would be escaped.
_WORDS = re.compile(r'\{"t": "Str", "c": "[^"\\ ]+"\}(?:, \{"t": "Space"\}, \{"t": "Str", "c": "[^"\\ ]+"\})+')


def _run(m: re.Match) -> str:
    text = m[0][len('{"t": "Str", "c": "') : -len('"}')].replace('"}, {"t": "Space"}, {"t": "Str", "c": "', " ")
    return f'{{"t": "Run", "c": "{text}"}}' if run(text) else m[0]


def read_json(text: str) -> dict:
    """The JSON form of the tree."""
    d = json.loads(_WORDS.sub(_run, text) if making_runs() and isinstance(text, str) else text)
    if not isinstance(d, dict) or "blocks" not in d:
        raise ValueError("not a document")
    return {"meta": d.get("meta", {}), "blocks": d["blocks"]}


#: MIME types of a notebook's outputs, best first.
_OUTPUTS = ["text/html", "text/markdown", "image/svg+xml", "image/png", "image/jpeg", "text/latex", "text/plain"]


def read_ipynb(text: str) -> dict:
    """A notebook (format 4, or 3 with its worksheets): each cell a Div with its kind as class."""
    d = json.loads(text)
    joined = lambda x: "".join(x) if isinstance(x, list) else x or ""
    cells = d.get("cells") or [c for w in d.get("worksheets", []) for c in w.get("cells", [])]
    lang = d.get("metadata", {}).get("kernelspec", {}).get("language") or d.get("metadata", {}).get("language_info", {}).get("name") or "python"
    blocks = []
    for c in cells:
        kind, source = c.get("cell_type", "raw"), joined(c.get("source", c.get("input")))
        kvs = [["execution_count", str(c["execution_count"])]] if c.get("execution_count") is not None else []
        a = attr(c.get("id", ""), ["cell", kind], kvs)
        if kind in ("markdown", "heading"):
            inner = read_markdown("#" * c.get("level", 1) + " " + source if kind == "heading" else source, "commonmark_x")["blocks"]
        elif kind == "code":
            inner = [node("CodeBlock", attr("", [lang]), source)]
            for o in c.get("outputs", []):
                inner.append(node("Div", attr("", ["output", o.get("output_type", "")]), _output(o, joined)))
        else:
            inner = [node("RawBlock", {"text/html": "html", "text/latex": "latex", "text/restructuredtext": "rst"}.get(c.get("metadata", {}).get("raw_mimetype", ""), "ipynb"), source)]
        blocks.append(node("Div", a, inner))
    meta = {"jupyter": {"t": "MetaString", "c": json.dumps({k: v for k, v in d.get("metadata", {}).items()}, sort_keys=True)}}
    return {"meta": meta, "blocks": blocks}


def _output(o: dict, joined) -> list[dict]:
    if o.get("output_type") == "stream":
        return [node("CodeBlock", NO_ATTR, joined(o.get("text")).removesuffix("\n"))]
    if o.get("output_type") in ("error", "pyerr"):
        return [node("CodeBlock", NO_ATTR, "\n".join(o.get("traceback", [])))]
    data, out = o.get("data", {}), []
    for mime in _OUTPUTS:
        if mime not in data:
            continue
        text = joined(data[mime])
        if mime.startswith("image/") and mime != "image/svg+xml":
            out.append(node("Para", [node("Image", NO_ATTR, [], [f"data:{mime};base64,{text.strip()}", ""])]))
        elif mime == "text/markdown":
            out += read_markdown(text, "commonmark_x")["blocks"]
        elif mime == "text/plain":
            out.append(node("CodeBlock", NO_ATTR, text))
        else:
            out.append(node("RawBlock", {"text/latex": "latex"}.get(mime, "html"), text))
    return out


def read_opml(text: str) -> dict:
    """An outline: a heading for each item, its _note as Markdown below it."""
    root = ElementTree.fromstring(text)
    blocks, meta = [], {}
    for key, tag in (("title", "title"), ("author", "ownerName"), ("date", "dateModified")):
        found = root.findtext(f"head/{tag}")
        if found:
            meta[key] = {"t": "MetaInlines", "c": words(found)}

    def outline(e, level: int) -> None:
        head = read_markdown(e.get("text", ""), "commonmark")["blocks"]
        text = head[0]["c"] if head and head[0]["t"] == "Para" else words(e.get("text", ""))
        if e.get("type") == "link":
            text = [node("Link", NO_ATTR, text, [e.get("url", ""), ""])]
        blocks.append(node("Header", level, NO_ATTR, text))
        if e.get("_note"):
            blocks.extend(read_markdown(e.get("_note"), "markdown")["blocks"])
        for x in e.findall("outline"):
            outline(x, level + 1)

    for e in root.findall("body/outline"):
        outline(e, 1)
    return {"meta": meta, "blocks": blocks}


# --- bibliographies --------------------------------------------------------------------------------------------------

#: Entry types, and fields by their name in the interchange form.
_BIB_TYPES = {"article": "article-journal", "book": "book", "inproceedings": "paper-conference", "conference": "paper-conference", "incollection": "chapter", "inbook": "chapter", "phdthesis": "thesis", "mastersthesis": "thesis", "thesis": "thesis", "techreport": "report", "report": "report", "misc": "document", "online": "webpage", "manual": "book", "proceedings": "book", "unpublished": "manuscript", "booklet": "pamphlet", "patent": "patent"}
_BIB_FIELDS = {"title": "title", "journal": "container-title", "journaltitle": "container-title", "booktitle": "container-title", "publisher": "publisher", "address": "publisher-place", "location": "publisher-place", "volume": "volume", "number": "issue", "pages": "page", "doi": "DOI", "url": "URL", "isbn": "ISBN", "issn": "ISSN", "edition": "edition", "series": "collection-title", "abstract": "abstract", "note": "note", "school": "publisher", "institution": "publisher"}
_RIS_TYPES = {"JOUR": "article-journal", "BOOK": "book", "CHAP": "chapter", "CONF": "paper-conference", "CPAPER": "paper-conference", "THES": "thesis", "RPRT": "report", "ELEC": "webpage", "NEWS": "article-newspaper", "MGZN": "article-magazine", "PAT": "patent", "GEN": "document"}
_RIS_FIELDS = {"TI": "title", "T1": "title", "JO": "container-title", "JF": "container-title", "T2": "container-title", "VL": "volume", "IS": "issue", "PB": "publisher", "CY": "publisher-place", "DO": "DOI", "UR": "URL", "SN": "ISSN", "AB": "abstract", "N1": "note", "ET": "edition"}
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _entries(text: str):
    """type, key and fields of each BibTeX entry, strings replaced."""
    strings: dict[str, str] = {}
    i = 0
    while (m := re.compile(r"@(\w+)\s*([{(])").search(text, i)):
        kind, i = m[1].lower(), m.end()
        depth, j = 1, i
        while j < len(text) and depth:
            depth += (text[j] == "{") - (text[j] == "}") if m[2] == "{" else (text[j] == "(") - (text[j] == ")")
            j += 1
        body, i = text[i : j - 1], j
        if kind in ("comment", "preamble"):
            continue
        key = ""
        if kind != "string":
            key, _, body = body.partition(",")
        fields: dict[str, str] = {}
        k = 0
        while (f := re.compile(r"\s*([\w-]+)\s*=\s*").match(body, k)):
            k, value = f.end(), []
            while k < len(body):
                if body[k] == "{":
                    d, s = 1, k + 1
                    k += 1
                    while k < len(body) and d:
                        d += (body[k] == "{") - (body[k] == "}")
                        k += 1
                    value.append(body[s : k - 1])
                elif body[k] == '"':
                    s = k + 1
                    d = 0
                    k += 1
                    while k < len(body) and (body[k] != '"' or d):
                        d += (body[k] == "{") - (body[k] == "}")
                        k += 1
                    value.append(body[s:k])
                    k += 1
                elif w := re.compile(r"[\w.-]+").match(body, k):
                    value.append(strings.get(w[0].lower(), w[0]))
                    k = w.end()
                k = re.compile(r"\s*").match(body, k).end()
                if k < len(body) and body[k] == "#":
                    k = re.compile(r"#\s*").match(body, k).end()
                    continue
                break
            fields[f[1].lower()] = "".join(value)
            k = re.compile(r"\s*,?\s*").match(body, k).end()
        if kind == "string":
            strings |= {k: v for k, v in fields.items()}
        else:
            yield kind, key.strip(), fields


def _clean(s: str) -> str:
    return " ".join(re.sub(r"[{}]", "", re.sub(r"\\([&%$#_{}])", r"\1", s).replace("~", " ").replace("---", "—").replace("--", "–")).split())


def _names(s: str) -> list[dict]:
    out = []
    for n in re.split(r"\s+and\s+", s.strip()):
        if n.strip().startswith("{") and n.strip().endswith("}"):
            out.append({"literal": _clean(n)})
            continue
        n = _clean(n)
        if n == "others":
            out.append({"literal": "others"})
        elif "," in n:
            family, _, given = n.partition(",")
            out.append({"family": family.strip(), "given": given.rpartition(",")[2].strip()})
        elif n:
            given, _, family = n.rpartition(" ")
            out.append({"family": family, "given": given} if given else {"family": family})
    return out


def bibtex_references(text: str) -> list[dict]:
    """Entries in the interchange form, with what a crossref or xdata parent gives to its children (nearer ones win)."""
    entries = {key: (kind, fields) for kind, key, fields in _entries(text)}

    def inherited(key: str, seen: frozenset = frozenset()) -> dict[str, str]:
        _, fields = entries[key]
        out = dict(fields)
        for parent in [p.strip() for k in ("crossref", "xdata") for p in fields.get(k, "").split(",") if p.strip()]:
            if parent in entries and parent not in seen:
                above = inherited(parent, seen | {key})
                if "title" in above and fields.get("crossref"):
                    above.setdefault("booktitle", above.pop("title"))
                out = above | out
        return out

    refs = []
    for key, (kind, _) in entries.items():
        if kind == "xdata":
            continue
        f = inherited(key)
        ref: dict = {"id": key, "type": _BIB_TYPES.get(kind, "document")}
        for name, to in _BIB_FIELDS.items():
            if name in f and to not in ref:
                ref[to] = _clean(f[name])
        for who in ("author", "editor", "translator"):
            if who in f:
                ref[who] = _names(f[who])
        date = [int(x) for x in re.findall(r"\d+", f.get("date", f.get("year", "")).split("/")[0])[:3]]
        if len(date) == 1 and (month := f.get("month", "").strip().lower()):
            date += [_MONTHS.index(month[:3]) + 1] if month[:3] in _MONTHS else [int(month)] if month.isdigit() else []
        if date:
            ref["issued"] = {"date-parts": [date]}
        refs.append(ref)
    return refs


def ris_references(text: str) -> list[dict]:
    refs, ref, n = [], None, 0
    for line in text.replace("\r", "").split("\n"):
        m = re.match(r"([A-Z][A-Z0-9])  - ?(.*)", line)
        if not m:
            continue
        tag, value = m[1], m[2].strip()
        if tag == "TY":
            n += 1
            ref = {"id": f"ref{n}", "type": _RIS_TYPES.get(value, "document")}
        elif ref is None:
            continue
        elif tag == "ER":
            refs.append(ref)
            ref = None
        elif tag in ("AU", "A1", "ED", "A2"):
            family, _, given = value.partition(",")
            ref.setdefault("author" if tag in ("AU", "A1") else "editor", []).append({"family": family.strip(), "given": given.strip()})
        elif tag in ("PY", "Y1", "DA"):
            date = [int(x) for x in value.split("/")[:3] if x.strip().isdigit()]
            if date:
                ref["issued"] = {"date-parts": [date]}
        elif tag == "SP":
            ref["page"] = value
        elif tag == "EP":
            ref["page"] = f"{ref['page']}-{value}" if ref.get("page") else value
        elif tag == "ID":
            ref["id"] = value
        elif tag in _RIS_FIELDS:
            ref.setdefault(_RIS_FIELDS[tag], value)
    return refs


def endnote_references(text: str) -> list[dict]:
    refs = []
    for i, r in enumerate(ElementTree.fromstring(text).iter("record")):
        find = lambda path: " ".join("".join(e.itertext()).strip() for e in r.findall(path))
        kind = r.find("ref-type")
        ref = {"id": find("rec-number") or f"ref{i + 1}", "type": {"Journal Article": "article-journal", "Book": "book", "Book Section": "chapter", "Thesis": "thesis", "Conference Proceedings": "paper-conference"}.get(kind.get("name") if kind is not None else "", "document")}
        for path, to in (("titles/title", "title"), ("titles/secondary-title", "container-title"), ("volume", "volume"), ("number", "issue"), ("pages", "page"), ("publisher", "publisher"), ("electronic-resource-num", "DOI"), ("urls/related-urls/url", "URL"), ("isbn", "ISBN"), ("abstract", "abstract")):
            if find(path):
                ref[to] = find(path)
        people = ["".join(a.itertext()).strip() for a in r.findall("contributors/authors/author")]
        if people:
            ref["author"] = [{"family": p.partition(",")[0].strip(), "given": p.partition(",")[2].strip()} for p in people]
        year = re.findall(r"\d{4}", find("dates/year"))
        if year:
            ref["issued"] = {"date-parts": [[int(year[0])]]}
        refs.append(ref)
    return refs


def _meta(v) -> dict:
    if isinstance(v, dict):
        return {"t": "MetaMap", "c": {k: _meta(x) for k, x in v.items()}}
    if isinstance(v, list):
        return {"t": "MetaList", "c": [_meta(x) for x in v]}
    return {"t": "MetaString", "c": str(v)}


def references(refs: list[dict]) -> dict:
    """A document without a body that cites all of refs."""
    cite = {"citationId": "*", "citationPrefix": [], "citationSuffix": [], "citationMode": {"t": "NormalCitation"}, "citationNoteNum": 0, "citationHash": 0}
    return {"meta": {"references": _meta(refs), "nocite": {"t": "MetaInlines", "c": [node("Cite", [cite], [node("Str", "[@*]")])]}}, "blocks": []}


def read_csljson(text: str) -> dict:
    found = json.loads(text)
    return references(found if isinstance(found, list) else found.get("items", [found]))


def read_bibtex(text: str) -> dict:
    return references(bibtex_references(text))


def read_ris(text: str) -> dict:
    return references(ris_references(text))


def read_endnote(text: str) -> dict:
    return references(endnote_references(text))


def unmeta(v: dict):
    """A metadata value as plain data."""
    if v["t"] == "MetaMap":
        return {k: unmeta(x) for k, x in v["c"].items()}
    if v["t"] == "MetaList":
        return [unmeta(x) for x in v["c"]]
    from leafmill.tree import meta_text

    return v["c"] if v["t"] in ("MetaString", "MetaBool") else meta_text(v)
