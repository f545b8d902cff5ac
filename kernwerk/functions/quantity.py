"""Numbers and measured amounts in short texts: a scanner over words, with units read by the unit grammar."""

from __future__ import annotations

from dataclasses import dataclass

from kernwerk.functions.unitgrammar import FARFETCHED, Unit, dimension, parse_unit

LENGTH, SPEED = dimension("L"), dimension("L T-1")
# How conversions name a unit; other units keep the writing they came in.
SHOWN = ("mm", "cm", "m", "km", "in", "ft", "yd", "mi", "nmi", "mg", "g", "kg", "t", "oz", "lb", "st", "ml", "L", "US gal", "imp gal", "fl oz", "tbsp", "tsp", "m²", "km²", "ha", "acres", "sq mi", "sq ft", "km/h", "mph", "m/s", "kn", "°C", "°F", "K")
# Everyday names that the grammar knows under another one.
EVERYDAY = {"gallon": "US gallon", "gallons": "US gallon", "gal": "US gallon", "kilo": "kilogram", "kilos": "kilogram", "us cup": "cup", "us cups": "cup", "c": "°C", "f": "°F", "k": "kelvin", "degrees": "°C"}
_DASHES = "-–"


def read_number(text: str) -> float | None:
    """The value of a number as people write it, or None. Commas group thousands if each has three digits behind it; a single comma with one or
    two digits behind it starts the decimals."""
    sign, body = (-1.0, text[1:]) if text[:1] == "-" else (1.0, text)
    whole, point, decimals = body.partition(".")
    head, *groups = whole.split(",")
    parts = [head, *groups] + ([decimals] if point else [])
    if not all(p.isascii() and p.isdigit() for p in parts):
        return None
    if groups and not (all(len(g) == 3 for g in groups) and len(head) <= 3):
        return None if point or len(groups) > 1 or len(groups[0]) > 2 else sign * float(f"{head}.{groups[0]}")
    return sign * float("".join([head, *groups]) + (f".{decimals}" if point else ""))


@dataclass(frozen=True)
class Figure:
    """A number in a text, with what is written right behind it ("5km": "km"), and whether it is a part of a larger quantity."""

    value: float
    behind: str
    at: int
    partial: bool


def figure(words: list[str], i: int) -> Figure | None:
    """The number that word ``i`` begins with. It is partial behind another number ("5 ft 10") or in a range ("5-10")."""
    w = words[i].lstrip("(\"'")
    end = 1 if w[:1] == "-" else 0
    while end < len(w) and (w[end].isdigit() or (w[end] in ".," and w[end + 1 : end + 2].isdigit())):
        end += 1
    value = read_number(w[:end])
    if value is None:
        return None
    before = " ".join(words[:i])
    ranged = any(c in w[end:] and any(x.isdigit() for x in w[end:]) for c in _DASHES) or before.endswith(tuple(_DASHES))
    return Figure(value, w[end:], i, ranged or any(c.isdigit() for c in before))


def last_figure(words: list[str]) -> Figure | None:
    """The last number of some words; a range counts as a number that is partial."""
    for i in reversed(range(len(words))):
        if any(c.isdigit() for c in words[i]) and not words[i][0].isalpha():
            return figure(words, i)
    return None


def unit_named(name: str, dims: tuple | None = None) -> Unit | None:
    """The unit of a name in a question; far-fetched readings of ordinary words do not count."""
    n = " ".join(name.lower().split())
    n = n.removeprefix("degrees ")
    if not n or any(w.isdigit() for w in n.split()):
        return None
    known = EVERYDAY.get(n) or (name.strip() if parse_unit(name.strip(), dims, least=FARFETCHED) else n)
    unit = parse_unit(known, dims, least=FARFETCHED)
    return unit if unit is not None and any(unit.dims) else None


_SHOWN: dict[str, str] = {parse_unit(s).key: s for s in SHOWN} | {parse_unit("cup").key: "US cups"}


def shown_unit(unit: Unit, written: str) -> str:
    return _SHOWN.get(unit.key, " ".join(written.split()))


def to_unit(value: float, a: Unit, b: Unit) -> float | None:
    """``value`` of unit ``a`` in unit ``b``; None if they measure different things."""
    if a.dims != b.dims or not any(a.dims):
        return None
    return (value * a.scale * a.factor + a.offset - b.offset) / b.factor / b.scale


def pair_of_units(source: str, target: str) -> tuple[Unit, Unit] | None:
    """Two names of units of one dimension, each read with the other's dimension in mind."""
    for first, second, turned in ((source, target, False), (target, source, True)):
        a = unit_named(first)
        b = a and unit_named(second, a.dims)
        if a and b and a.dims == b.dims:
            return (b, a) if turned else (a, b)
    return None
