"""Readers by format name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from leafmill.sources import html, light, markdown, roff, structured, xml

READERS: dict[str, Callable[..., dict]] = {
    **{name: partial(markdown.read_markdown, dialect=name) for name in markdown.EXTENSIONS},
    "html": html.read_html,
    "csv": structured.read_csv,
    "tsv": structured.read_tsv,
    "json": structured.read_json,
    "ipynb": structured.read_ipynb,
    "opml": structured.read_opml,
    "csljson": structured.read_csljson,
    "bibtex": structured.read_bibtex,
    "biblatex": structured.read_bibtex,
    "ris": structured.read_ris,
    "endnotexml": structured.read_endnote,
    **{name: partial(light.read, name=name) for name in light.LANGUAGES},
    "rst": light.read_rst,
    "org": light.read_org,
    "mediawiki": light.read_mediawiki,
    "docbook": xml.read_docbook,
    "jats": xml.read_jats,
    "bits": xml.read_jats,
    "fb2": xml.read_fb2,
    "tei": xml.read_tei,
    "xml": xml.read_tree,
    "latex": roff.read_latex,
    "man": roff.read_man,
    "mdoc": roff.read_man,
    "rtf": roff.read_rtf,
    "native": roff.read_native,
    "docx": xml.read_docx,
    "odt": xml.read_odt,
    "pptx": xml.read_pptx,
    "xlsx": xml.read_xlsx,
    "epub": xml.read_epub,
}

#: File suffixes and the format that they stand for.
SUFFIXES = {"html": "html", "htm": "html", "xhtml": "html", "md": "markdown", "markdown": "markdown", "txt": "markdown", "csv": "csv", "tsv": "tsv", "json": "json", "ipynb": "ipynb", "opml": "opml", "bib": "biblatex", "ris": "ris", "rst": "rst", "org": "org", "wiki": "mediawiki", "tex": "latex", "latex": "latex", "docx": "docx", "odt": "odt", "xlsx": "xlsx", "pptx": "pptx", "epub": "epub", "xml": "xml", "fb2": "fb2", "textile": "textile", "dj": "djot", "native": "native", "typ": "typst", "adoc": "asciidoc", "1": "man", "muse": "muse", "rtf": "rtf", "pod": "pod", "t2t": "t2t"}


def format_of(path: str) -> str:
    """By the suffix of a path; markdown if it isn't known."""
    return SUFFIXES.get(path.rpartition(".")[2].lower(), "markdown")
