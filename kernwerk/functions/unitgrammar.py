"""Unit strings as compositions of scales, prefixes, roots and exponents.

A string is segmented by dynamic programming over its positions. Tries hold the scale words, prefixes, modifiers, roots and exponents;
each state of a position keeps, for each dimension, the best scored segmentation so far. Ambiguous strings ("min" is a minute or a
milli-inch, "C" is a degree or nothing of length) are decided at the end by the prior that the field's own dimension carries.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

# SI and international units. name -> (symbols, words, dimension, factor to SI, offset, takes prefixes). The dimension is written in
# the axes L length, M mass, T time, Θ temperature, I current, N amount, J luminous intensity, A angle, B information.
ROOTS = {
    "metre": (("m",), ("metre", "meter"), "L", 1.0, 0.0, True),
    "inch": (("in", '"'), ("inch", "inche"), "L", 0.0254, 0.0, False),
    "foot": (("ft", "ft."), ("foot", "feet"), "L", 0.3048, 0.0, False),
    "yard": (("yd", "yd."), ("yard",), "L", 0.9144, 0.0, False),
    "fathom": (("ftm",), ("fathom",), "L", 1.8288, 0.0, False),
    "mile": (("mi", "mi."), ("mile", "statute mile"), "L", 1609.344, 0.0, False),
    "nautical mile": (("nmi", "NM"), ("nautical mile", "sea mile"), "L", 1852.0, 0.0, False),
    "acre": (("ac", "ac."), ("acre",), "L2", 4046.8564224, 0.0, False),
    "hectare": (("ha",), ("hectare",), "L2", 10000.0, 0.0, False),
    "litre": (("L", "l"), ("litre", "liter"), "L3", 0.001, 0.0, True),
    "US gallon": (("US gal", "US gal.", "U.S. gal"), ("US gallon", "U.S. gallon"), "L3", 0.003785411784, 0.0, False),
    "imperial gallon": (("imp gal", "imp. gal", "UK gal"), ("imperial gallon", "UK gallon"), "L3", 0.00454609, 0.0, False),
    "cord": ((), ("cord",), "L3", 3.624556363776, 0.0, False),
    "gram": (("g",), ("gram", "gramme"), "M", 0.001, 0.0, True),
    "tonne": (("t",), ("tonne", "metric ton"), "M", 1000.0, 0.0, True),
    "pound": (("lb", "lb."), ("pound",), "M", 0.45359237, 0.0, False),
    "ounce": (("oz",), ("ounce",), "M", 0.028349523125, 0.0, False),
    "stone": (("st",), ("stone",), "M", 6.35029318, 0.0, False),
    "short ton": (("US t",), ("short ton", "US ton"), "M", 907.18474, 0.0, False),
    "long ton": ((), ("long ton", "imperial ton"), "M", 1016.0469088, 0.0, False),
    "second": (("s", "sec", "sec."), ("second",), "T", 1.0, 0.0, True),
    "minute": (("min", "min."), ("minute",), "T", 60.0, 0.0, False),
    "hour": (("h", "hr", "hrs", "hr."), ("hour",), "T", 3600.0, 0.0, False),
    "day": (("d",), ("day",), "T", 86400.0, 0.0, False),
    "week": (("wk",), ("week",), "T", 604800.0, 0.0, False),
    "kelvin": (("K",), ("kelvin", "degree kelvin"), "Θ", 1.0, 0.0, True),
    "degree Celsius": (("°C", "C", "deg C", "deg. C", "º C", "° C", "℃"), ("degree celsius", "degrees celsius", "celsius", "degree centigrade", "centigrade"), "Θ", 1.0, 273.15, False),
    "degree Fahrenheit": (("°F", "F", "deg F", "deg. F", "° F", "℉"), ("degree fahrenheit", "degrees fahrenheit", "fahrenheit"), "Θ", 5.0 / 9.0, 459.67 * 5.0 / 9.0, False),
    "watt": (("W",), ("watt",), "L2 M T-3", 1.0, 0.0, True),
    "horsepower": (("hp",), ("horsepower",), "L2 M T-3", 745.6998715822702, 0.0, False),
    "knot": (("kn", "kt", "kts"), ("knot",), "L T-1", 1852.0 / 3600.0, 0.0, False),
    "kilometre per hour": (("kph", "kmh", "kmph"), (), "L T-1", 1000.0 / 3600.0, 0.0, False),
    "mile per hour": (("mph",), (), "L T-1", 1609.344 / 3600.0, 0.0, False),
    "astronomical unit": (("AU", "au"), ("astronomical unit",), "L", 149597870700.0, 0.0, False),
    "light-year": (("ly",), ("light-year", "light year"), "L", 9460730472580800.0, 0.0, False),
    "parsec": (("pc",), ("parsec",), "L", 3.0856775814913673e16, 0.0, True),
    "ångström": (("Å",), ("angstrom", "ångström"), "L", 1e-10, 0.0, False),
    "US pint": (("pt", "US pt"), ("pint", "US pint"), "L3", 0.000473176473, 0.0, False),
    "US quart": (("qt", "US qt"), ("quart", "US quart"), "L3", 0.000946352946, 0.0, False),
    "cup": ((), ("cup",), "L3", 0.0002365882365, 0.0, False),
    "fluid ounce": (("fl oz", "fl. oz."), ("fluid ounce",), "L3", 2.95735295625e-05, 0.0, False),
    "tablespoon": (("tbsp",), ("tablespoon",), "L3", 1.478676478125e-05, 0.0, False),
    "teaspoon": (("tsp",), ("teaspoon",), "L3", 4.92892159375e-06, 0.0, False),
    "barrel of oil": (("bbl",), ("oil barrel", "barrel"), "L3", 0.158987294928, 0.0, False),
    "carat": (("ct",), ("carat",), "M", 0.0002, 0.0, False),
    "dalton": (("Da",), ("dalton",), "M", 1.66053906892e-27, 0.0, True),
    "hertz": (("Hz",), ("hertz",), "T-1", 1.0, 0.0, True),
    "revolution per minute": (("rpm",), ("revolution per minute", "revolutions per minute"), "T-1", 1.0 / 60.0, 0.0, False),
    "becquerel": (("Bq",), ("becquerel",), "T-1", 1.0, 0.0, True),
    "newton": (("N",), ("newton",), "L M T-2", 1.0, 0.0, True),
    "kilogram-force": (("kgf",), ("kilogram-force",), "L M T-2", 9.80665, 0.0, False),
    "pascal": (("Pa",), ("pascal",), "L-1 M T-2", 1.0, 0.0, True),
    "bar": (("bar",), ("bar",), "L-1 M T-2", 100000.0, 0.0, True),
    "atmosphere": (("atm",), ("atmosphere",), "L-1 M T-2", 101325.0, 0.0, False),
    "millimetre of mercury": (("mmHg", "mm Hg"), (), "L-1 M T-2", 133.322387415, 0.0, False),
    "pound per square inch": (("psi",), (), "L-1 M T-2", 6894.757293168361, 0.0, False),
    "joule": (("J",), ("joule",), "L2 M T-2", 1.0, 0.0, True),
    "calorie": (("cal",), ("calorie",), "L2 M T-2", 4.184, 0.0, True),
    "electronvolt": (("eV",), ("electronvolt", "electron volt"), "L2 M T-2", 1.602176634e-19, 0.0, True),
    "British thermal unit": (("BTU", "Btu"), ("British thermal unit",), "L2 M T-2", 1055.05585262, 0.0, False),
    "ampere": (("A",), ("ampere", "amp"), "I", 1.0, 0.0, True),
    "coulomb": ((), ("coulomb",), "T I", 1.0, 0.0, True),
    "volt": (("V",), ("volt",), "L2 M T-3 I-1", 1.0, 0.0, True),
    "ohm": (("Ω", "Ω"), ("ohm",), "L2 M T-3 I-2", 1.0, 0.0, True),
    "siemens": (("S",), ("siemens",), "L-2 M-1 T3 I2", 1.0, 0.0, True),
    "farad": ((), ("farad",), "L-2 M-1 T4 I2", 1.0, 0.0, True),
    "weber": (("Wb",), ("weber",), "L2 M T-2 I-1", 1.0, 0.0, True),
    "tesla": ((), ("tesla",), "M T-2 I-1", 1.0, 0.0, True),
    "henry": ((), ("henry",), "L2 M T-2 I-2", 1.0, 0.0, True),
    "mole": (("mol",), ("mole",), "N", 1.0, 0.0, True),
    "katal": (("kat",), ("katal",), "T-1 N", 1.0, 0.0, True),
    "candela": (("cd",), ("candela",), "J", 1.0, 0.0, True),
    "lumen": (("lm",), ("lumen",), "J", 1.0, 0.0, True),
    "lux": (("lx",), ("lux",), "L-2 J", 1.0, 0.0, True),
    "sievert": (("Sv",), ("sievert",), "L2 T-2", 1.0, 0.0, True),
    "gray": (("Gy",), ("gray",), "L2 T-2", 1.0, 0.0, True),
    "radian": (("rad",), ("radian",), "A", 1.0, 0.0, True),
    "degree": (("°", "deg"), ("degree",), "A", 0.017453292519943295, 0.0, False),
    "minute of arc": (("′", "arcmin"), ("arcminute", "minute of arc"), "A", 0.0002908882086657216, 0.0, False),
    "second of arc": (("″", "arcsec"), ("arcsecond", "second of arc"), "A", 4.84813681109536e-06, 0.0, True),
    "bit": (("bit", "b"), ("bit",), "B", 1.0, 0.0, True),
    "byte": (("B",), ("byte", "octet"), "B", 8.0, 0.0, True),
    "per cent": (("%",), ("percent", "per cent"), "", 0.01, 0.0, False),
    "per mille": (("‰",), ("per mille",), "", 0.001, 0.0, False),
    "part per million": (("ppm",), ("part per million", "parts per million"), "", 1e-06, 0.0, False),
}
AXES = ("L", "M", "T", "Θ", "I", "N", "J", "A", "B")


def dimension(text: str) -> tuple[int, ...]:
    """"L2 M T-3" as exponents of the axes."""
    powers = {part[0]: int(part[1:] or 1) for part in text.split()}
    return tuple(powers.get(a, 0) for a in AXES)


ROOTS = {name: (*root[:2], dimension(root[2]), *root[3:]) for name, root in ROOTS.items()}
# SI prefixes, symbol and word.
PREFIXES = {"Q": 1e30, "R": 1e27, "Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "µ": 1e-6, "μ": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24, "Ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40}
PREFIX_WORDS = {"quetta": 1e30, "ronna": 1e27, "yotta": 1e24, "zetta": 1e21, "exa": 1e18, "peta": 1e15, "tera": 1e12, "giga": 1e9, "mega": 1e6, "kilo": 1e3, "hecto": 1e2, "deca": 1e1, "deka": 1e1, "deci": 1e-1, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9, "pico": 1e-12, "femto": 1e-15, "atto": 1e-18, "zepto": 1e-21, "yocto": 1e-24, "kibi": 2.0**10, "mebi": 2.0**20, "gibi": 2.0**30, "tebi": 2.0**40}
SCALES = {"hundred": 1e2, "thousand": 1e3, "thousands": 1e3, "million": 1e6, "millions": 1e6, "mn": 1e6, "mln": 1e6, "billion": 1e9, "billions": 1e9, "bn": 1e9, "trillion": 1e12}
MODIFIERS = {"square": 2, "sq": 2, "sq.": 2, "cubic": 3, "cu": 3, "cu.": 3}
EXPONENTS = {"²": 2, "³": 3, "^2": 2, "^3": 3, "**2": 2, "**3": 3, "2": 2, "3": 3, " squared": 2, " cubed": 3, "^-1": -1, "⁻¹": -1, "^-2": -2, "^-3": -3}
DIVISIONS = ("/", " per ", "per ", " / ")
_END = object()
_AFTER = re.compile(r"[ ,;:()\[\]]+(?!per\b|by\b|a\b|an\b)(?=[^\W\d_])")
FARFETCHED = -6.0  #: a reading of another dimension that scores less is a chance reading of ordinary words


class Trie:
    """Longest and all matches of a fixed word list from a position."""

    def __init__(self, words: dict, fold: bool) -> None:
        self.top: dict = {}
        self.fold = fold
        for w, value in words.items():
            node = self.top
            for ch in w.lower() if fold else w:
                node = node.setdefault(ch, {})
            node.setdefault(_END, []).append(value)

    def at(self, s: str, i: int):
        """(end, value) for every word that starts at i."""
        node = self.top
        while i < len(s):
            node = node.get(s[i].lower() if self.fold else s[i])
            if node is None:
                return
            i += 1
            for value in node.get(_END, ()):
                yield i, value


def _symbols(pick) -> dict:
    return {s: n for n, r in ROOTS.items() for s in pick(r)}


_SYMBOL, _SYMBOL_ANY, _WORD = Trie(_symbols(lambda r: r[0]), False), Trie(_symbols(lambda r: r[0]), True), Trie(_symbols(lambda r: r[1]), True)
_PREFIX, _PREFIX_ANY, _PREFIX_WORD = Trie(PREFIXES, False), Trie({k: v for k, v in PREFIXES.items() if k in ("T", "G", "M", "k", "c")}, True), Trie(PREFIX_WORDS, True)
_SCALE, _MODIFIER, _EXPONENT = Trie(SCALES, True), Trie(MODIFIERS, True), Trie(EXPONENTS, True)


@dataclass(frozen=True)
class Unit:
    scale: float
    factor: float
    offset: float
    dims: tuple
    name: str

    @property
    def key(self) -> str:
        """Two spellings of one unit have one key; a scale word makes another."""
        return f"{self.scale:g}|{self.factor:.9e}|{self.offset:.6f}|{self.dims}"


def _roots(s: str, i: int):
    """(end, root, prefix factor, score) of a prefixed root at i."""
    starts = [(i, 1.0, 0.0, "any")]
    starts += [(j, f, -1.0, "symbol") for j, f in _PREFIX.at(s, i)] + [(j, f, -3.5, "symbol-any") for j, f in _PREFIX_ANY.at(s, i)] + [(j, f, -0.5, "word") for j, f in _PREFIX_WORD.at(s, i)]
    for j, prefix, score, kind in starts:
        found = []
        if kind in ("any", "symbol"):
            found += [(e, n, -1.0) for e, n in _SYMBOL.at(s, j)]
        if kind in ("any", "symbol", "symbol-any"):
            found += [(e, n, -3.0) for e, n in _SYMBOL_ANY.at(s, j)]
        if kind in ("any", "word"):
            found += [(e, n, -0.5) for e, n in _WORD.at(s, j)]
        for e, n, cost in found:
            if kind != "any" and not ROOTS[n][5]:
                cost -= 6.0  # a prefix on a root that takes none: only if nothing else fits
            yield e, n, prefix, score + cost
            if s[e : e + 1].lower() == "s":
                yield e + 1, n, prefix, score + cost - 0.1
    return


def _segment(s: str) -> dict[int, list[tuple[float, Unit]]]:
    """For every end that a unit in the string can have: every dimension it can have there, with its best segmentation. Text that no unit
    reaches costs a step for each character."""
    zero = (0,) * len(AXES)
    # (dims, divides, scale, has unit, factor, offset, name) by (dims, divides, has) keep the best
    states: list[dict] = [{} for _ in range(len(s) + 1)]
    states[0][(zero, 1, False)] = (0.0, 1.0, 1.0, 0.0, "")

    def put(pos: int, key: tuple, value: tuple) -> None:
        if key not in states[pos] or states[pos][key][0] < value[0]:
            states[pos][key] = value

    for i in range(len(s)):
        for (dims, sign, has), (score, scale, factor, offset, name) in list(states[i].items()):
            if s[i] in " ·*-." and i:
                put(i + 1, (dims, sign, has), (score - 0.01, scale, factor, offset, name))
            if not has:
                for e, v in _SCALE.at(s, i):
                    if e == len(s) or s[e] == " ":
                        put(e, (dims, sign, has), (score - 0.2, scale * v, factor, offset, name))
                if s[i : i + 3].lower() == "of ":
                    put(i + 3, (dims, sign, has), (score - 0.2, scale, factor, offset, name))
            if has and sign == 1:
                for d in DIVISIONS:
                    if s[i : i + len(d)].lower() == d:
                        put(i + len(d), (dims, -1, has), (score - 0.2, scale, factor, offset, name + "/"))
            for j, power in [(i, 1), *((e + (s[e : e + 1] == " "), p) for e, p in _MODIFIER.at(s, i))]:
                for e, n, prefix, cost in _roots(s, j):
                    ends = [(e, power)] + ([(x, p) for x, p in _EXPONENT.at(s, e)] if power == 1 else [])
                    for x, p in ends:
                        if x < len(s) and s[x].isalpha() and s[x - 1].isalpha():
                            cost_x = cost - 2.0  # runs on into other letters
                        else:
                            cost_x = cost
                        root = ROOTS[n]
                        q = p * sign
                        put(x, (tuple(a + b * q for a, b in zip(dims, root[2])), sign, True), (score + cost_x, scale, factor * (prefix * root[3]) ** q, root[4] if not has and q == 1 and prefix == 1.0 else 0.0, f"{name}{'' if prefix == 1.0 else f'{prefix:g} '}{n}{'' if p == 1 else p}"))
    out: dict[int, list[tuple[float, Unit]]] = {}
    for end, state in enumerate(states):
        best: dict = {}
        for (dims, _, has), (score, scale, factor, offset, name) in state.items():
            if (has or scale != 1.0) and (dims not in best or best[dims][0] < score):
                best[dims] = (score, Unit(scale, factor, offset, dims, name))
        if best:
            out[end] = list(best.values())
    return out


def clean_unit(text: str | None) -> str:
    s = " ".join((text or "").replace("\u00a0", " ").replace("\u202f", " ").split()).strip(" ,;()[]")
    return s


NONE = Unit(1.0, 1.0, 0.0, (0,) * len(AXES), "1")


@lru_cache(maxsize=65536)
def parse_unit(text: str, dims: tuple | None = None, prior: float = 12.0, least: float = float("-inf")) -> Unit | None:
    """The unit that ``text`` names, given the dimension of the field it stands in (the prior); None if there is no reading.

    Words may follow a unit of the field's own dimension ("kilometres according to the survey"), however many. With ``least``, the whole text
    must be a unit, and its reading must score as much.
    """
    s = clean_unit(text)
    if s in ("", "1", "one", "count", "units", "unit"):
        return NONE
    ends = _segment(s)
    weight = lambda x: x[0] + (prior if dims is not None and x[1].dims == dims else 0.0)
    whole = max(ends[len(s)], key=weight) if len(s) in ends else None
    if least > float("-inf"):
        return whole[1] if whole and whole[0] > least else None
    if whole and (dims is None or whole[1].dims == dims or whole[0] > FARFETCHED):
        return whole[1]
    # Words follow the unit: the longest unit of the field's dimension that ends before them, unless a number is what follows.
    for end in sorted(ends, reverse=True):
        if _AFTER.match(s, end):
            found = [x for x in ends[end] if x[1].dims == dims and any(dims)]
            if found:
                return max(found, key=weight)[1]
    return whole and whole[1]


def convert(value: float, unit: Unit, common: Unit) -> float:
    """``value`` of ``unit`` in ``common``. A scale word alone counts the common unit."""
    v = value * unit.scale
    if unit.dims == common.dims and unit.factor == common.factor and unit.offset == common.offset:
        return v / common.scale
    return ((v * unit.factor + unit.offset) - common.offset) / common.factor / common.scale
