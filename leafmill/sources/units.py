"""Quantities with units, as the package siunitx writes them: numbers and units to text."""

from __future__ import annotations

import re

from leafmill.tree import node

#: Signs of units and prefixes.
PREFIXES = {"yocto": "y", "zepto": "z", "atto": "a", "femto": "f", "pico": "p", "nano": "n", "micro": "μ", "milli": "m", "centi": "c", "deci": "d", "deca": "da", "hecto": "h", "kilo": "k", "mega": "M", "giga": "G", "tera": "T", "peta": "P", "exa": "E", "zetta": "Z", "yotta": "Y"}
UNITS = {"meter": "m", "metre": "m", "gram": "g", "second": "s", "ampere": "A", "kelvin": "K", "mole": "mol", "candela": "cd", "hertz": "Hz", "newton": "N", "pascal": "Pa", "joule": "J", "watt": "W", "coulomb": "C", "volt": "V", "farad": "F", "ohm": "Ω", "siemens": "S", "weber": "Wb", "tesla": "T", "henry": "H", "lumen": "lm", "lux": "lx", "becquerel": "Bq", "gray": "Gy", "sievert": "Sv", "katal": "kat", "celsius": "°C", "degreeCelsius": "°C", "degree": "°", "arcminute": "′", "arcsecond": "″", "minute": "min", "hour": "h", "day": "d", "litre": "l", "liter": "L", "tonne": "t", "electronvolt": "eV", "bar": "bar", "percent": "%", "decibel": "dB", "bel": "B", "neper": "Np", "radian": "rad", "steradian": "sr", "hectare": "ha", "angstrom": "Å", "euro": "€", "kilogram": "kg", "dalton": "Da", "astronomicalunit": "ua", "bit": "bit", "byte": "B"}
POWERS = {"square": "2", "squared": "2", "cubic": "3", "cubed": "3"}


def number(text: str) -> str:
    """1e3, 2 +- 1 and 1 x 2 with their signs."""
    out = re.sub(r"\s+", "", text).replace("\\pm", "±").replace("+-", "\u00a0±\u00a0")
    out = re.sub(r"\\times|(?<=\d)x(?=\d)", "\u00a0×\u00a0", out)
    return re.sub(r"^-", "−", re.sub(r"(?<=[eE])-", "−", out)) if out.startswith("-") else out


def unit(text: str) -> list[dict]:
    """A unit from its macros, or as it is written."""
    out: list[dict] = []
    pending, per = "", False
    tokens = re.findall(r"\\[a-zA-Z]+|\{[^{}]*\}|[.~]|[^\\{}.~\s]+", text)
    i = 0

    def add(sign: str, power: str = "") -> None:
        nonlocal per
        if out and out[-1]["t"] == "Str":
            out[-1] = node("Str", out[-1]["c"] + sign)
        else:
            out.append(node("Str", sign))
        if per:
            power, per = "−" + (power or "1"), False
        if power:
            out.append(node("Superscript", [node("Str", power)]))

    power, gap = "", False
    while i < len(tokens):
        t = tokens[i]
        name = t[1:] if t.startswith("\\") else ""
        i += 1
        if name == "per":
            per = True
        elif name in ("square", "cubic"):
            power = POWERS[name]
        elif name in ("raisetothe",) and i < len(tokens):
            power, i = tokens[i].strip("{}"), i + 1
        elif name in ("squared", "cubed") or name == "tothe":
            p = POWERS.get(name) or tokens[i].strip("{}")
            i += name == "tothe"
            out.append(node("Superscript", [node("Str", p)]))
        elif name in PREFIXES:
            pending += PREFIXES[name]
        elif t in ".~":
            add("\u00a0")
            gap = False
        else:
            sign = UNITS.get(name, name) if name else t
            add(("\u00a0" if gap else "") + pending + sign, power)
            pending, power, gap = "", "", True
    return out


def quantity(amount: str, of: list[dict]) -> list[dict]:
    """A number, a space that doesn't break, and its unit."""
    first = [node("Str", number(amount) + ("\u00a0" if of else ""))]
    if of and of[0]["t"] == "Str":
        return [node("Str", first[0]["c"] + of[0]["c"]), *of[1:]]
    return first + of
