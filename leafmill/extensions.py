"""Format extensions: their names, and those that work alike on the tree of any reader."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import partial

from leafmill.tree import walk

#: Names of extensions.
NAMES = set(
    """
    abbreviations alerts all_symbols_escapable amuse angle_brackets_escapable ascii_identifiers attributes auto_identifiers autolink_bare_uris
    backtick_code_blocks blank_before_blockquote blank_before_header bracketed_spans citations definition_lists east_asian_line_breaks
    element_citations emoji empty_paragraphs epub_html_exts escaped_line_breaks example_lists fancy_lists fenced_code_attributes
    fenced_code_blocks fenced_divs footnotes four_space_rule gfm_auto_identifiers grid_tables gutenberg hard_line_breaks header_attributes
    table_attributes ignore_line_breaks implicit_figures implicit_header_references inline_code_attributes inline_notes intraword_underscores
    latex_macros line_blocks link_attributes lists_without_preceding_blankline literate_haskell mark markdown_attribute
    markdown_in_html_blocks mmd_header_identifiers mmd_link_attributes mmd_title_block multiline_tables native_divs native_spans
    native_numbering ntb old_dashes open_references pandoc_title_block pipe_tables raw_attribute raw_html raw_tex raw_markdown rebase_relative_paths
    short_subsuperscripts shortcut_reference_links simple_tables smart smart_quotes special_strings sourcepos space_in_atx_header
    spaced_reference_links startnum strikeout subscript superscript styles tagging task_lists table_captions tex_math_dollars tex_math_gfm
    tex_math_double_backslash tex_math_single_backslash wikilinks_title_after_pipe wikilinks_title_before_pipe xrefs_name xrefs_number
    yaml_metadata_block
    """.split()
)


def checked(names: frozenset, more: set[str] = frozenset()) -> None:
    """An unknown name is an error, before any document is read."""
    unknown = sorted(names - NAMES - more)
    if unknown:
        raise ValueError(f"unknown extension {', '.join(unknown)}")


def takes_names(f: Callable) -> bool:
    return "plus" in inspect.signature(f).parameters


def _unwrapped(kind: str, n: dict) -> list[dict] | None:
    return n["c"][1] if n["t"] == kind else None


def _anonymous(n: dict) -> dict | None:
    return {"t": "Header", "c": [n["c"][0], ["", *n["c"][1][1:]], n["c"][2]]} if n["t"] == "Header" else None


def applied(read: Callable[..., dict], plus: frozenset, minus: frozenset, text: str | bytes) -> dict:
    """A document of a reader without extensions of its own, with what a name switches off taken out of the tree."""
    doc = read(text)
    for name, kind in (("native_divs", "Div"), ("native_spans", "Span")):
        if name in minus:
            doc = doc | {"blocks": walk(doc["blocks"], partial(_unwrapped, kind))}
    if "auto_identifiers" in minus:
        doc = doc | {"blocks": walk(doc["blocks"], _anonymous)}
    return doc
