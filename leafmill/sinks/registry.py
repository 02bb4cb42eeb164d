"""Writers by format name."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import partial

from leafmill.sinks import markup, packages, tex, xml


#: A node Run; within a string its quotes would be escaped.
_RUN = re.compile(r'\{"t": "Run", "c": "([^"\\]*)"\}')


def to_json(doc: dict) -> str:
    """The JSON form of the tree."""
    return _RUN.sub(lambda m: '{"t": "Str", "c": "' + m[1].replace(" ", '"}, {"t": "Space"}, {"t": "Str", "c": "') + '"}', json.dumps({"meta": doc["meta"], "blocks": doc["blocks"]}, ensure_ascii=False))


WRITERS: dict[str, Callable[[dict], str | bytes]] = {name: partial(markup.render, name=name) for name in markup.FORMATS}
WRITERS |= {name: partial(xml.render, name=name) for name in xml.VOCABULARIES}
WRITERS |= {"json": to_json, "html": xml.to_html, "html5": xml.to_html, "html4": xml.to_html4, "xml": xml.to_xml, "opml": xml.to_opml}
WRITERS |= {
    "latex": tex.to_latex,
    "beamer": tex.to_beamer,
    "context": tex.to_context,
    "texinfo": tex.to_texinfo,
    "man": tex.to_man,
    "ms": tex.to_ms,
    "rtf": tex.to_rtf,
    "native": tex.to_native,
    "ipynb": tex.to_ipynb,
    "csljson": tex.to_csljson,
    "bibtex": tex.to_bibtex,
    "biblatex": partial(tex.to_bibtex, biblatex=True),
    **{kind: partial(tex.slide_html, kind=kind) for kind in ("revealjs", "dzslides", "s5", "slidy", "slideous")},
}
_PACKAGES = {"epub": packages.to_epub, "epub3": packages.to_epub, "epub2": packages.to_epub2, "chunkedhtml": packages.to_chunked_html, "odt": packages.to_odt, "docx": packages.to_docx, "pptx": packages.to_pptx}
WRITERS |= _PACKAGES
BINARY = set(_PACKAGES)
#: Writers that know nodes Run (tree.in_runs), and give for them what they give for the words.
RUNS = {"json", "native", "xml", "ipynb", "docx", "odt", "epub"}


def writer(name: str) -> Callable[[dict], str | bytes]:
    if name not in WRITERS:
        raise ValueError(f"{name} is no output format")
    return WRITERS[name]
