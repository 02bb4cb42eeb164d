"""Scalar functions on text columns, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\r\n"


def trim(c: Column) -> Column:
    """Without space, tab, CR and LF at both ends."""
    return F.btrim(c, F.lit(BLANK))


def triml(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n]+", "")


def trimr(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\r\n]+\z", "")


def trim_math(c: Column) -> Column:
    """Trimmed, but a backslash keeps one blank that follows it."""
    left = triml(c)
    return F.when(F.rlike(left, F.lit(r"\\[ \t\r\n]+\z")), F.regexp_replace(left, r"(\\[ \t\r\n])[ \t\r\n]*\z", "$1")).otherwise(trimr(left))


def strip_trailing_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n]+\z", "")


def strip_first_and_last(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lit("")).otherwise(F.substring(c, F.lit(2), F.length(c) - 2))


def in_quotes(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def camel_to_hyphen(c: Column) -> Column:
    """camelCase to camel-case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([^A-Z])([A-Z])", "$1-$2"), "([A-Z])([A-Z][a-z])", "$1-$2"))


#: Roman numerals.
_ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def roman(n: Column) -> Column:
    """1 to 3999; 0 is the empty string, what else is a question mark."""
    digits, rest = [], n
    for value, sign in _ROMAN:
        digits.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = F.pmod(rest, F.lit(value))
    return F.when((n < 0) | (n >= 4000), "?").otherwise(F.concat(*digits))


def expand_tabs(c: Column, stop: int = 4) -> Column:
    """Tabs to the next stop, a line at a time; every line ends with a newline. 0: tabs stay."""
    if stop <= 0:
        return F.concat(F.regexp_replace(c, r"\n\z", ""), F.lit("\n"))

    def line(text: Column) -> Column:
        parts = F.split(text, "\t")
        joined = F.aggregate(
            F.slice(parts, 1, F.size(parts) - 1),
            F.lit(""),
            lambda acc, p: F.concat(acc, p, F.repeat(F.lit(" "), (F.lit(stop) - F.pmod(F.length(p), F.lit(stop))).cast("int"))),
        )
        return F.concat(joined, F.element_at(parts, -1))

    return F.concat(F.array_join(F.transform(F.split(F.regexp_replace(c, r"\n\z", ""), "\n"), line), "\n"), F.lit("\n"))


def identifier(c: Column) -> Column:
    """The identifier of a heading: lower-cased letters, digits and _-., words joined by hyphens, from the first letter on; `section` if nothing is left."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\-. \t\r\n]", "")
    joined = F.regexp_replace(trim(kept), r"[ \t\r\n]+", "-")
    own = F.regexp_replace(joined, r"^[^\p{L}]+", "")
    return F.when(own == "", "section").otherwise(own)


def identifier_gfm(c: Column) -> Column:
    """The same in the other dialect: every space is a hyphen and leading digits stay."""
    return F.replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\- ]", ""), F.lit(" "), F.lit("-"))


def escape_xml(c: Column) -> Column:
    """Markup characters as entities; control characters that XML forbids are dropped."""
    out = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def escape_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("&#10;"))


def unsmart(c: Column) -> Column:
    """Curly typography to ASCII."""
    for sign, plain in (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "--"), ("—", "---"), ("…", "..."), (" ", " ")):
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return c


def dashes(c: Column, old: bool = False) -> Column:
    """-- to an en dash and --- to an em dash; the old rule: -- to an em dash, - before a digit to an en dash."""
    if old:
        return F.regexp_replace(F.replace(c, F.lit("--"), F.lit("—")), r"-([0-9])", "–$1")
    return F.replace(F.replace(c, F.lit("---"), F.lit("—")), F.lit("--"), F.lit("–"))


def ellipses(c: Column) -> Column:
    return F.replace(c, F.lit("..."), F.lit("…"))


def smart(c: Column) -> Column:
    """Straight quotes to curly ones by their neighbours, dashes and ellipses."""
    out = F.regexp_replace(dashes(ellipses(c)), r'(^|[\s(\[{])"', "$1“")
    out = F.replace(out, F.lit('"'), F.lit("”"))
    out = F.regexp_replace(out, r"(^|[\s(\[{“])'", "$1‘")
    return F.replace(out, F.lit("'"), F.lit("’"))


#: Superscript and subscript forms of digits and signs.
_PLAIN, _SUPER, _SUB = "0123456789+-=()", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"


def superscript(c: Column) -> Column:
    """Null if a character has no superscript form."""
    return F.when(F.rlike(c, F.lit(r"^[0-9+\-=()]*\z")), F.translate(c, _PLAIN, _SUPER))


def subscript(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit(r"^[0-9+\-=()]*\z")), F.translate(c, _PLAIN, _SUB))


def escape_uri(c: Column) -> Column:
    """White space and characters that a URI can't hold, percent-escaped."""
    for sign in ' \t\r\n<>|"{}[]^`':
        c = F.replace(c, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return c


def collapse_path(c: Column) -> Column:
    """Without `.`, and without `..` and what it takes back; a leading `..` stays."""
    parts = F.filter(F.split(c, "/"), lambda p: p != ".")

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        takes = (p == "..") & (F.size(acc) > 0) & F.when(F.size(acc) > 0, (last != "..") & (last != "")).otherwise(False)
        return F.when(takes, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def is_list_marker(c: Column) -> Column:
    """Whether text is an ordered list's marker: a number, a letter or a Roman numeral before . or )"""
    return F.rlike(c, F.lit(r"^(\(?([0-9]+|[a-zA-Z]|[ivxlcdmIVXLCDM]+|#|@[\w\-]*)\)|([0-9]+|[a-zA-Z]|[ivxlcdmIVXLCDM]+|#)\.)\z"))


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, r"\x1b\[[^m]*m", "")


def to_text(c: Column) -> Column:
    """Text without a leading byte order mark and without carriage returns."""
    return F.replace(F.regexp_replace(c, "^﻿", ""), F.lit("\r"), F.lit(""))


def excise_lines(c: Column, start: int | None = None, end: int | None = None) -> Column:
    """Lines start to end, from 1, both included; negative ones count from the end."""
    lines = F.split(c, "\n")
    n = F.size(lines)
    at = lambda x, default: default if x is None else (n + 1 + x if x < 0 else F.lit(x))
    first, last = F.greatest(at(start, F.lit(1)), F.lit(1)), F.least(at(end, n), n)
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


#: The date formats that are tried in this order.
DATE_FORMATS = ["M/d/yyyy", "MM/dd/yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "d. MMM yyyy", "MMM. d, yyyy", "yyyyMMdd", "yyyyMM", "yyyy"]


def normal_date(c: Column) -> Column:
    """The date of the first format that fits, as YYYY-MM-DD; null if none does or the year isn't in 1601 to 9999."""
    tried = F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in DATE_FORMATS])
    return F.when(F.year(tried).between(1601, 9999), F.date_format(tried, "yyyy-MM-dd"))


#: Units of length and their size in inches.
INCHES = {"in": 1.0, "inch": 1.0, "cm": 1 / 2.54, "mm": 1 / 25.4, "pt": 1 / 72, "pc": 1 / 6}


def dimension(c: Column) -> Column:
    """A length as (value, unit): px (also of a bare number, floored), %, cm, mm, in, pt, pc or em; else null."""
    value = F.regexp_extract(c, r"^([0-9]+(\.[0-9]+)?)", 1)
    unit = F.regexp_extract(c, r"^[0-9]+(?:\.[0-9]+)?(px|%|cm|mm|in|inch|pt|pc|em)?\z", 1)
    ok = F.rlike(c, F.lit(r"^[0-9]+(\.[0-9]+)?(px|%|cm|mm|inch|in|pt|pc|em)?\z"))
    number = F.expr("0.0D") + F.when(value != "", value).cast("double")
    pixels = (unit == "") | (unit == "px")
    return F.when(ok, F.struct(F.when(pixels, F.floor(number).cast("double")).otherwise(number).alias("value"), F.when(pixels, "px").when(unit == "inch", "in").otherwise(unit).alias("unit")))


def in_inches(dim: Column, dpi: int = 96) -> Column:
    out = F.when(dim["unit"] == "px", dim["value"] / dpi).when(dim["unit"] == "em", dim["value"] * 11 / 64)
    for unit, size in INCHES.items():
        out = out.when(dim["unit"] == unit, dim["value"] * size)
    return out


def in_pixels(dim: Column, dpi: int = 96) -> Column:
    return F.when(dim["unit"] == "px", dim["value"]).otherwise(F.floor(in_inches(dim, dpi) * dpi))


def truish(c: Column) -> Column:
    return F.lower(c).isin("true", "t", "yes")


def split_sentences(c: Column) -> Column:
    """Sentences: cut at blanks after . ! or ? with closing brackets or quotes, but not after a single capital."""
    return F.split(F.regexp_replace(c, r"(?<![\s.]\p{Lu}|^\p{Lu})([.!?][)\]\"'’”]*)\s+", "$1\n"), "\n")


#: File suffix and MIME type.
MIME = {
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript", "json": "application/json", "xml": "application/xml", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "avif": "image/avif", "tif": "image/tiff", "tiff": "image/tiff", "emf": "image/x-emf",
    "pdf": "application/pdf", "eps": "application/postscript", "epub": "application/epub+zip", "zip": "application/zip", "mp4": "video/mp4", "webm": "video/webm", "mp3": "audio/mpeg", "ogg": "audio/ogg", "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "odt": "application/vnd.oasis.opendocument.text",
}


def mime_type(path: Column) -> Column:
    """By the suffix of a path; null if it isn't known."""
    known = F.create_map(*[x for k, v in MIME.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./?#]+)([?#].*)?\z", 1)))


def image_type(content: Column) -> Column:
    """By the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    out = None
    for start, kind in (("89504E47", "png"), ("474946", "gif"), ("FFD8FF", "jpeg"), ("25504446", "pdf"), ("25215053", "eps"), ("01000000", "emf"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("3C737667", "svg"), ("3C3F786D6C", "svg")):
        out = (F if out is None else out).when(F.startswith(head, F.lit(start)), kind)
    return out.when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), "webp").when(F.substring(head, 9, 16) == "6674797061766966", "avif")


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def from_data_uri(c: Column) -> Column:
    """(mime, content) of a base64 data URI; else null."""
    ok = F.rlike(c, F.lit(r"^data:[^,;]*(;[^,;]+)*;base64,"))
    return F.when(ok, F.struct(F.regexp_extract(c, r"^data:([^,]*);base64,", 1).alias("mime"), F.unbase64(F.regexp_replace(c, r"^data:[^,]*,|\s", "")).alias("content")))
