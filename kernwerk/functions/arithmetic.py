"""Arithmetic, percentages and unit conversions that a question states."""

from __future__ import annotations

import math
import re
from decimal import Context, Decimal

from kernwerk.functions.quantity import LENGTH, SPEED, figure, last_figure, pair_of_units, read_number, shown_unit, to_unit, unit_named

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|(.))")


def evaluate(expression: str) -> float:
    """+ − * / with brackets and signs. ValueError on anything else, on division by zero and on results that are not finite."""
    tokens = [(float(n) if n else op) for n, op in _TOKEN.findall(expression) if n or op.strip()]
    values: list[float] = []
    ops: list[str] = []
    level = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3}

    def apply() -> None:
        op = ops.pop()
        if op == "neg":
            values.append(-values.pop())
            return
        b, a = values.pop(), values.pop()
        if op == "/" and b == 0:
            raise ValueError("division by zero")
        values.append(a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b)

    operand = False  # whether an operand has just ended
    try:
        for t in tokens:
            if isinstance(t, float):
                if operand:
                    raise ValueError("two numbers in a row")
                values.append(t)
                operand = True
            elif t == "(":
                if operand:
                    raise ValueError("unexpected (")
                ops.append(t)
            elif t == ")":
                if not operand:
                    raise ValueError("unexpected )")
                while ops[-1] != "(":
                    apply()
                ops.pop()
            elif t == "-" and not operand:
                ops.append("neg")
            elif t in "+-*/" and operand:
                while ops and ops[-1] != "(" and level[ops[-1]] >= level[t]:
                    apply()
                ops.append(t)
                operand = False
            else:
                raise ValueError(f"unexpected {t!r}")
        if not operand:
            raise ValueError("unexpected end")
        while ops:
            if ops[-1] == "(":
                raise ValueError("missing )")
            apply()
    except IndexError as e:
        raise ValueError("malformed expression") from e
    if not math.isfinite(values[0]):
        raise ValueError("not finite")
    return values[0]


def literals(expression: str) -> list[str]:
    return re.findall(r"[0-9.]+", expression)


def show(x: float) -> str:
    """Thousands separated; four decimals, or three significant digits of small values."""
    if x != 0 and abs(x) < 1e-12:
        return f"{x:.2e}"
    if x == int(x) and abs(x) < 1e15:
        return f"{int(x):,}"
    places = max(4, 2 - math.floor(math.log10(abs(x)))) if abs(x) < 0.001 else 4
    s = f"{x:,.{places}f}"
    return s.rstrip("0").rstrip(".")


def significant(x: float, n: int = 4) -> str:
    """``x`` to ``n`` significant digits, without an exponent and without zeros at the end of its decimals."""
    d = +Decimal(repr(x)) if x == int(x) and abs(x) >= 10**n else Context(prec=n).create_decimal(repr(x))
    text = f"{d.to_integral_value() if abs(d) >= 10**n else d:f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def parse_number(s: str) -> float | None:
    return read_number(s.strip())


# Words before a calculation in a question that asks for nothing else.
FILLER = frozenset("what what's whats is convert calculate compute how much please tell me".split())


def asks_only(words: list[str]) -> bool:
    """Whether the words before a calculation ask for nothing besides it."""
    return all(w.strip("?!.,:;").lower() in FILLER for w in words)


def _words(question: str) -> list[str]:
    return question.strip().rstrip("?.! ").split()


def percentage(question: str) -> tuple[str, bool] | None:
    """("15% of 240 = 36", whether that is all the question asks), for a question that ends in a percentage of a number."""
    words = _words(question)
    if len(words) < 3 or words[-2].lower() != "of":
        return None
    x, left = read_number(words[-1]), words[:-2]
    sign = next((t for t in (["per", "cent"], ["percent"], ["%"]) if [w.lower() for w in left[-len(t) :]] == t), None)
    part = left[: len(left) - len(sign)] if sign else left
    p = figure(part, len(part) - 1) if part else None
    if x is None or p is None or p.partial or p.behind.lower() != ("" if sign else "%"):
        return None
    return f"{show(p.value)}% of {show(x)} = {show(p.value * x / 100)}", asks_only(part[:-1])


def percent_line(question: str) -> str | None:
    """"15% of 240 = 36" for a question that asks for a percentage; None for others, and for ranges such as "5-10% of 40"."""
    got = percentage(question)
    return got and got[0]


def conversion(value: float, unit: str, target: str) -> float | None:
    """A value in another unit of the same dimension; None if either is unknown."""
    units = pair_of_units(unit, target)
    return units and to_unit(value, *units)


def metres(value: float, unit: str) -> float | None:
    """A length in metres; None if the unit is not one of length."""
    got = unit_named(unit, LENGTH)
    return value * got.scale * got.factor if got and got.dims == LENGTH else None


_INTO, _LINKS, _ONE = {"in", "to", "into", "as"}, {"are", "is", "in", "per", "make", "makes", "up", "there", "equal", "equals"}, {"a", "an", "one"}


def _stated(words: list[str]) -> tuple[float, str, str, list[str]] | None:
    """(value, its unit, wanted unit, words before) of "… 10 miles in km"."""
    for c in range(1, len(words) - 1):
        if words[c].lower() not in _INTO:
            continue
        f = last_figure(words[:c])
        if f is None or f.partial:
            continue
        source = " ".join([f.behind, *words[f.at + 1 : c]]).strip()
        target = " ".join(words[c + 1 :])
        if source and pair_of_units(source, target):
            return f.value, source, target, words[: f.at]
    return None


def _wanted(words: list[str]) -> tuple[float, str, str, list[str]] | None:
    """(value, its unit, wanted unit, words before) of "how many km are there in 10 miles"."""
    low = [w.lower() for w in words]
    many = next((i for i in range(len(words) - 1) if low[i : i + 2] == ["how", "many"]), None)
    if many is None:
        return None
    end = next((i for i in range(many + 3, len(words)) if low[i] in _LINKS), None)
    if end is None:
        return None
    begin = next((i for i in range(end, len(words)) if low[i] not in _LINKS), len(words))
    rest = words[begin:]
    f = figure(rest, 0) if rest else None
    if f is not None and not f.partial:
        value, source = f.value, " ".join([f.behind, *rest[1:]]).strip()
    elif len(rest) > 1 and rest[0].lower() in _ONE:
        value, source = 1.0, " ".join(rest[1:])
    else:
        return None
    return value, source, " ".join(words[many + 2 : end]), words[:many]


def conversion_asked(question: str) -> tuple[str, bool] | None:
    """("10 mi = 16.09 km", whether that is all the question asks), for a question that asks for a quantity in another unit."""
    words = _words(question)
    got = _wanted(words) or _stated(words)
    units = got and pair_of_units(got[1], got[2])
    out = units and to_unit(got[0], *units)
    if out is None:
        return None
    value, source, target, before = got
    return f"{significant(value)} {shown_unit(units[0], source)} = {significant(out)} {shown_unit(units[1], target)}", asks_only(before)


def conversion_line(question: str) -> str | None:
    """"10 mi = 16.09 km" for "10 miles in km" and "how many km are in 10 miles"; None for others and for parts of ranges or of sums."""
    got = conversion_asked(question)
    return got and got[0]


def speed(question: str) -> float | None:
    """The one speed that a question states, in metres per second: "60 mph", "5 km an hour", "20 metres per second"."""
    words = [w.rstrip("?.!,;:") for w in question.split()]
    for i in range(len(words)):
        f = figure(words, i) if words[i] else None
        if f is None or (i and words[i - 1].endswith(("-", "–"))):
            continue
        rest = [x for x in (f.behind, *words[i + 1 : i + 4]) if x]
        if any(c.isdigit() for c in f.behind) and f.partial:
            return None
        for text in ([rest[0]] if rest else []) + ([f"{rest[0]} per {rest[2]}"] if len(rest) > 2 and rest[1].lower() in ("per", "an", "a", "each") else []):
            unit = unit_named(text, SPEED)
            if unit and unit.dims == SPEED:
                return f.value * unit.scale * unit.factor
    return None
