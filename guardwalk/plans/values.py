"""Values of a running program: numbers, comparison, class tests, stores and text forms."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from guardwalk.functions.codecs import Picture

FILL = (" ", "\x00", "\xff")
#: Outcomes of an order (-1, 0, 1) that satisfy a relation.
RELATIONS = {"=": (0,), "!=": (-1, 1), "<": (-1,), "<=": (-1, 0), ">": (1,), ">=": (0, 1)}
CLASS_TESTS = {
    "NUMERIC": lambda t, n: re.fullmatch(r"\s*[+-]*\d+\s*", t) is not None,
    "ALPHABETIC": lambda t, n: "".join(t.split()).isalpha(),
    "ALPHABETIC-LOWER": lambda t, n: "".join(t.split()).isalpha() and t == t.lower(),
    "ALPHABETIC-UPPER": lambda t, n: "".join(t.split()).isalpha() and t == t.upper(),
    "POSITIVE": lambda t, n: n is not None and n > 0,
    "NEGATIVE": lambda t, n: n is not None and n < 0,
    "ZERO": lambda t, n: n == 0,
}


class Unsupported(Exception):
    pass


def number(x) -> Decimal | None:
    try:
        d = Decimal(str(x).strip())
    except InvalidOperation:
        return None
    return d if d.is_finite() else None


def keys(a, b) -> tuple:
    """Both sides in a form that Python orders: numbers if both are some, else texts of one length."""
    texts = isinstance(a, str), isinstance(b, str)
    if not all(texts):
        x, y = number(a), number(b)
        if x is not None and y is not None:
            return x, y
        return str(a).strip(), str(b).strip()
    width = max(len(a), len(b))
    grown = lambda t: t * width if t in FILL[1:] and width > 1 else t.ljust(width)
    return grown(a), grown(b)


def related(a, relation: str, b) -> bool:
    """The comparison and class rules of functions.cobol, on values."""
    if relation.startswith("IS"):
        return CLASS_TESTS[b](str(a), number(a)) == (relation == "IS")
    x, y = keys(a, b)
    return (x > y) - (x < y) in RELATIONS[relation]


def fitted(v, pic: Picture, rounded: bool = False) -> tuple[object, bool]:
    """(value as the picture holds it, whether it fits)."""
    if not pic.numeric:
        t = v * pic.printed if isinstance(v, str) and v in FILL else str(v)
        return t.ljust(pic.printed)[: pic.printed], len(t.rstrip()) <= pic.printed
    n = number(v)
    if n is None:
        return v, False
    unit = Decimal(1).scaleb(-pic.rest)
    units = abs(n).quantize(unit, rounding=ROUND_HALF_UP if rounded else "ROUND_DOWN") / unit
    kept = int(units) % 10 ** (pic.whole + pic.rest)
    out = kept * unit if pic.rest else kept
    return (-out if n < 0 and pic.signed else out), kept == int(units)


def shown(v, pic: Picture) -> str:
    """The characters of a value in a DISPLAY field; a minus is punched over the last digit."""
    if not pic.numeric:
        return fitted(v, pic)[0]
    n = number(v) or Decimal(0)
    digits = str(int(abs(n).scaleb(pic.rest))).rjust(pic.whole + pic.rest, "0")[-(pic.whole + pic.rest) :]
    return digits[:-1] + chr(0x70 + int(digits[-1])) if n < 0 and pic.signed else digits


def read_back(text: str, pic: Picture):
    """The value that the characters of a field stand for."""
    if not pic.numeric:
        return text
    minus = text[-1:] and 0x70 <= ord(text[-1]) <= 0x79
    digits = text[:-1] + (chr(ord(text[-1]) - 0x40) if minus else text[-1:])
    if not digits.isdigit():
        return text
    n = Decimal(int(digits)).scaleb(-pic.rest) if pic.rest else int(digits)
    return -n if minus else n
