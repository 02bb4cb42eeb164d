"""Trees to packages: EPUB, chunked HTML, and office documents, each a ZIP file of XML parts."""

from __future__ import annotations

import io
import json
import zipfile

from leafmill.sinks.xml import Html, esc, q, render
from leafmill.tree import cells, meta_text, plain


def packed(parts: dict[str, str | bytes], first: str | None = None) -> bytes:
    """A ZIP file with fixed times, so equal documents give equal bytes; `first` is stored uncompressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == first else zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue()


def chapters(blocks: list[dict], level: int = 1) -> list[tuple[str, list[dict]]]:
    """Heading text and blocks of each chunk; what stands before the first heading is a chunk without one."""
    out: list[tuple[str, list[dict]]] = []
    for b in blocks:
        if b["t"] == "Header" and b["c"][0] <= level:
            out.append((plain(b["c"][2]), []))
        elif not out:
            out.append(("", []))
        out[-1][1].append(b)
    return out


def _page(title: str, body: str, xhtml: bool = True, nav: str = "") -> str:
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml">' if xhtml else "<!DOCTYPE html>\n<html>"
    return f'{head}<head><meta charset="utf-8" /><title>{esc(title)}</title></head><body>\n{nav}{body}</body></html>\n'


def to_epub(doc: dict, version: int = 3) -> bytes:
    title = meta_text(doc["meta"].get("title")) or "Untitled"
    lang = meta_text(doc["meta"].get("lang")) or "en"
    chunks = chapters(doc["blocks"])
    names = [f"ch{i + 1:03d}.xhtml" for i in range(len(chunks))]
    pages = {f"EPUB/text/{n}": _page(t or title, Html(version == 3).document({"meta": {}, "blocks": b})) for n, (t, b) in zip(names, chunks, strict=True)}
    items = "".join(f'<item id="{n[:-6]}" href="text/{n}" media-type="application/xhtml+xml"/>' for n in names)
    spine = "".join(f'<itemref idref="{n[:-6]}"/>' for n in names)
    toc = "".join(f'<li><a href="text/{n}">{esc(t or title)}</a></li>' for n, (t, _) in zip(names, chunks, strict=True))
    ncx = "".join(f'<navPoint id="n{i}" playOrder="{i + 1}"><navLabel><text>{esc(t or title)}</text></navLabel><content src="text/{n}"/></navPoint>' for i, (n, (t, _)) in enumerate(zip(names, chunks, strict=True)))
    nav_item = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' if version == 3 else ""
    opf = f'<?xml version="1.0" encoding="UTF-8"?>\n<package version="{version}.0" xmlns="http://www.idpf.org/2007/opf" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">leafmill</dc:identifier><dc:title>{esc(title)}</dc:title><dc:language>{esc(lang)}</dc:language></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{nav_item}{items}</manifest><spine toc="ncx">{spine}</spine></package>'
    parts: dict[str, str | bytes] = {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "EPUB/content.opf": opf,
        "EPUB/toc.ncx": f'<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>{esc(title)}</text></docTitle><navMap>{ncx}</navMap></ncx>',
    }
    if version == 3:
        parts["EPUB/nav.xhtml"] = _page(title, f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{toc}</ol></nav>')
    return packed(parts | pages, "mimetype")


def to_epub2(doc: dict) -> bytes:
    return to_epub(doc, 2)


def to_chunked_html(doc: dict) -> bytes:
    """Linked pages, one a chunk, and a site map."""
    chunks = chapters(doc["blocks"])
    title = meta_text(doc["meta"].get("title"))
    names = ["index.html" if i == 0 else f"{i}-{(b[0]['c'][1][0] if b and b[0]['t'] == 'Header' else 'chunk') or 'chunk'}.html" for i, (_, b) in enumerate(chunks)]
    where = {b["c"][1][0]: n for n, (_, bs) in zip(names, chunks, strict=True) for b in bs if b["t"] == "Header" and b["c"][1][0]}

    def linked(xs: list[dict]) -> list[dict]:
        from leafmill.tree import walk

        return walk(xs, lambda n: {"t": "Link", "c": [n["c"][0], n["c"][1], [where[n["c"][2][0][1:]] + n["c"][2][0], n["c"][2][1]]]} if n["t"] == "Link" and n["c"][2][0][:1] == "#" and n["c"][2][0][1:] in where else None)

    pages = {}
    for i, (t, b) in enumerate(chunks):
        nav = "".join(f'<a rel="{rel}" href="{q(names[j])}">{rel}</a> ' for rel, j in (("prev", i - 1), ("next", i + 1)) if 0 <= j < len(names))
        pages[names[i]] = _page(t or title, Html().document({"meta": {}, "blocks": linked(b)}), False, f"<nav>{nav}</nav>\n" if nav else "")
    site = {"section": {"title": title, "path": "index.html"}, "subsections": [{"section": {"title": t, "path": n, "number": str(i)}} for i, (n, (t, _)) in enumerate(zip(names, chunks, strict=True)) if i]}
    return packed(pages | {"sitemap.json": json.dumps(site, ensure_ascii=False, indent=1)})


def to_odt(doc: dict) -> bytes:
    body = render(doc, "opendocument")
    spaces = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0" xmlns:xlink="http://www.w3.org/1999/xlink"'
    mime = "application/vnd.oasis.opendocument.text"
    return packed({"mimetype": mime, "content.xml": f'<?xml version="1.0" encoding="UTF-8"?>\n<office:document-content {spaces} office:version="1.3"><office:body><office:text>{body}</office:text></office:body></office:document-content>', "META-INF/manifest.xml": f'<?xml version="1.0" encoding="UTF-8"?>\n<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{mime}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'}, "mimetype")


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def to_docx(doc: dict) -> bytes:
    links: list[str] = []
    notes: list[str] = []
    marks = {"Emph": "<w:i/>", "Strong": "<w:b/>", "Underline": '<w:u w:val="single"/>', "Strikeout": "<w:strike/>", "Superscript": '<w:vertAlign w:val="superscript"/>', "Subscript": '<w:vertAlign w:val="subscript"/>', "SmallCaps": "<w:smallCaps/>"}

    def run(text: str, props: str) -> str:
        return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{esc(text)}</w:t></w:r>'

    def inl(xs: list[dict], props: str = "") -> str:
        out = ""
        for n in xs:
            t, c = n["t"], n.get("c")
            if t == "Str":
                out += run(c, props)
            elif t == "Run":  # a run of the word processor for each word and each space
                a, b = run("|", props).rsplit("|", 1)
                out += a + c.replace(" ", f"{b}{a} {b}{a}") + b
            elif t in ("Space", "SoftBreak"):
                out += run(" ", props)
            elif t == "LineBreak":
                out += "<w:r><w:br/></w:r>"
            elif t in marks:
                out += inl(c, props + marks[t])
            elif t in ("Code", "Math"):
                out += run(c[1], props + '<w:rStyle w:val="VerbatimChar"/>')
            elif t == "Link":
                links.append(c[2][0])
                out += f'<w:hyperlink r:id="rId{100 + len(links)}">{inl(c[1], props)}</w:hyperlink>'
            elif t == "Note":
                notes.append("")
                k = len(notes)
                notes[k - 1] = blk(c)
                out += f'<w:r><w:footnoteReference w:id="{k + 1}"/></w:r>'
            elif t == "Quoted":
                from leafmill.tree import QUOTES

                a, b = QUOTES[c[0]["t"]]
                out += run(a, props) + inl(c[1], props) + run(b, props)
            elif t in ("Span", "Cite", "Image"):
                out += inl(c[1], props)
        return out

    def par(body: str, style: str = "", more: str = "") -> str:
        props = (f'<w:pStyle w:val="{style}"/>' if style else "") + more
        return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{body}</w:p>"

    def blk(xs: list[dict], depth: int = -1, number: int = 0, style: str = "") -> str:
        out = ""
        for n in xs:
            t, c = n["t"], n.get("c")
            more = f'<w:numPr><w:ilvl w:val="{depth}"/><w:numId w:val="{number}"/></w:numPr>' if depth >= 0 else ""
            if t in ("Para", "Plain"):
                out += par(inl(c), style or "BodyText", more)
            elif t == "Header":
                out += par(inl(c[2]), f"Heading{c[0]}")
            elif t == "CodeBlock":
                out += par("<w:r><w:br/></w:r>".join(run(x, "") for x in c[1].split("\n")), "SourceCode")
            elif t == "BlockQuote":
                out += blk(c, style="BlockText")
            elif t in ("BulletList", "OrderedList"):
                for i in c if t == "BulletList" else c[1]:
                    out += blk(i, depth + 1, 1 if t == "BulletList" else 2)
            elif t == "Table":
                rows: dict[int, list[str]] = {}
                for _, r, cell in cells(n):
                    span = f'<w:tcPr><w:gridSpan w:val="{cell[3]}"/></w:tcPr>' if cell[3] > 1 else ""
                    rows.setdefault(r, []).append(f"<w:tc>{span}{blk(cell[4]) or par('')}</w:tc>")
                out += "<w:tbl><w:tblPr/>" + "".join("<w:tr>" + "".join(r) + "</w:tr>" for r in rows.values()) + "</w:tbl>"
            elif t == "HorizontalRule":
                out += par("")
            elif t == "DefinitionList":
                for term, defs in c:
                    out += par(inl(term), "DefinitionTerm") + "".join(blk(d, style="Definition") for d in defs)
            elif t == "LineBlock":
                out += par("<w:r><w:br/></w:r>".join(map(inl, c)))
            elif t in ("Div", "Figure"):
                out += blk(c[1] if t == "Div" else c[2] + c[1][1])
        return out

    body = blk(doc["blocks"])
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{s}"><w:name w:val="{n}"/></w:style>' for s, n in [("BodyText", "Body Text"), ("SourceCode", "Source Code"), ("BlockText", "Block Text"), ("DefinitionTerm", "Definition Term"), ("Definition", "Definition"), *[(f"Heading{i}", f"heading {i}") for i in range(1, 7)]])
    levels = lambda fmt, text: "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{text.format(i + 1)}"/></w:lvl>' for i in range(9))
    rel = lambda i, kind, target, mode="": f'<Relationship Id="{i}" Type="{_RELS}/{kind}" Target="{q(target)}"{mode}/>'
    head = '<?xml version="1.0" encoding="UTF-8"?>\n'
    return packed({
        "[Content_Types].xml": head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/word/{p}.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{k}+xml"/>' for p, k in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering"), ("footnotes", "footnotes"))) + "</Types>",
        "_rels/.rels": head + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rel("rId1", "officeDocument", "word/document.xml")}</Relationships>',
        "word/_rels/document.xml.rels": head + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + rel("rId1", "styles", "styles.xml") + rel("rId2", "numbering", "numbering.xml") + rel("rId3", "footnotes", "footnotes.xml") + "".join(rel(f"rId{101 + i}", "hyperlink", u, ' TargetMode="External"') for i, u in enumerate(links)) + "</Relationships>",
        "word/document.xml": head + f"<w:document {_W}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": head + f"<w:styles {_W}>{styles}</w:styles>",
        "word/numbering.xml": head + f'<w:numbering {_W}><w:abstractNum w:abstractNumId="1">{levels("bullet", "•")}</w:abstractNum><w:abstractNum w:abstractNumId="2">{levels("decimal", "%{}.")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="2"/></w:num></w:numbering>',
        "word/footnotes.xml": head + f"<w:footnotes {_W}>" + "".join(f'<w:footnote w:id="{i + 2}">{b}</w:footnote>' for i, b in enumerate(notes)) + "</w:footnotes>",
    })


_P = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def to_pptx(doc: dict) -> bytes:
    """Slides with a title and paragraphs."""
    from leafmill.sinks.tex import slides

    def paragraphs(xs: list[dict], level: int = 0) -> str:
        out = ""
        for n in xs:
            t, c = n["t"], n.get("c")
            if t in ("BulletList", "OrderedList"):
                out += "".join(paragraphs(i, level + 1) for i in (c if t == "BulletList" else c[1]))
            else:
                text = c[1] if t == "CodeBlock" else plain([n])
                out += f'<a:p><a:pPr lvl="{max(level - 1, 0)}"/><a:r><a:t>{esc(text)}</a:t></a:r></a:p>' if text else ""
        return out or "<a:p/>"

    shape = lambda i, kind, body: f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="{kind}"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>{body}</p:txBody></p:sp>'
    head, pages = '<?xml version="1.0" encoding="UTF-8"?>\n', slides(doc["blocks"])
    parts: dict[str, str | bytes] = {
        "[Content_Types].xml": head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/></Types>',
        "ppt/presentation.xml": head + f"<p:presentation {_P}><p:sldIdLst>" + "".join(f'<p:sldId id="{256 + i}" r:id="rId{i + 1}"/>' for i in range(len(pages))) + "</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": head + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{_RELS}/slide" Target="slides/slide{i + 1}.xml"/>' for i in range(len(pages))) + "</Relationships>",
    }
    for i, (title, body) in enumerate(pages):
        top = shape(2, "title", f"<a:p><a:r><a:t>{esc(plain(title))}</a:t></a:r></a:p>")
        parts[f"ppt/slides/slide{i + 1}.xml"] = head + f"<p:sld {_P}><p:cSld><p:spTree>{top}{shape(3, 'body', paragraphs(body))}</p:spTree></p:cSld></p:sld>"
    return packed(parts)
