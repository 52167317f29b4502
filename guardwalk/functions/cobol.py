"""Scalar semantics of decision programs as Column expressions: all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}
NUMERIC_TYPES = ("byte", "tinyint", "smallint", "int", "bigint", "long", "float", "double", "decimal")


def is_numeric(kind: str) -> bool:
    return kind.split("(")[0] in NUMERIC_TYPES


def widen(a: Column, b: Column) -> Column:
    """A lone LOW-VALUE or HIGH-VALUE byte takes the length of what it is compared with."""
    lone = a.isin("\x00", "\xff") & (F.length(b) > 1)
    return F.when(lone, F.repeat(a, F.length(b))).otherwise(a)


def compare(a: Column, op: str, b: Column, a_kind: str, b_kind: str) -> Column:
    """Two texts are padded right with blanks and compared by code point; a text and a
    number meet as numbers, or as trimmed texts if the text isn't one."""
    test = OPS[op]
    an, bn = is_numeric(a_kind), is_numeric(b_kind)
    if an and bn:
        return test(a, b)
    if not an and not bn:
        a, b = widen(a, b), widen(b, a)
        n = F.greatest(F.length(a), F.length(b))
        return test(F.rpad(a, n, F.lit(" ")), F.rpad(b, n, F.lit(" ")))
    text, number = (b, a) if an else (a, b)
    trimmed = strip(text)
    as_number = trimmed.try_cast("double")
    x, y = (number.cast("double"), as_number) if an else (as_number, number.cast("double"))
    s, t = (number.cast("string"), trimmed) if an else (trimmed, number.cast("string"))
    return F.when(as_number.isNotNull(), test(x, y)).otherwise(test(s, t))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def class_test(x: Column, name: str) -> Column:
    """IS NUMERIC, ALPHABETIC[-LOWER, -UPPER], POSITIVE, NEGATIVE, ZERO; blanks around or between are ignored, all-blank fails."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    patterns = {"NUMERIC": r"^\s*[+-]*\d+\s*$", "ALPHABETIC": r"^\s*\p{L}[\p{L}\s]*$", "ALPHABETIC-LOWER": r"^\s*\p{Ll}[\p{Ll}\s]*$", "ALPHABETIC-UPPER": r"^\s*\p{Lu}[\p{Lu}\s]*$"}
    if name in patterns:
        return text.rlike(patterns[name])
    n = strip(text).try_cast("double")
    test = {"POSITIVE": n > 0, "NEGATIVE": n < 0, "ZERO": n == 0}[name]
    return F.coalesce(test, F.lit(False))


def move_text(x: Column, width: int, justified: bool = False) -> Column:
    """MOVE to X(width): left aligned and cut at the right; JUSTIFIED RIGHT the other way round."""
    if justified:
        return F.lpad(F.when(F.length(x) > width, F.substring(x, -width, width)).otherwise(x), width, " ")
    return F.rpad(x, width, " ")


def store_number(x: Column, digits: int, scale: int, signed: bool = True) -> Column:
    """Store in 9(digits)V9(scale): low digits past the scale and high digits past the width are dropped."""
    v = x.cast("decimal(30,10)")
    units = F.floor(F.abs(v) * F.lit(10**scale)).cast("decimal(28,0)") % F.lit(10 ** (digits + scale)).cast("decimal(28,0)")
    out = (units / F.lit(10**scale)).cast(f"decimal({digits + scale},{scale})")
    return F.when(v < 0, -out).otherwise(out).cast(f"decimal({digits + scale},{scale})") if signed else out


def rounded(x: Column, scale: int, mode: str = "NEAREST-AWAY-FROM-ZERO") -> Column:
    """The seven ROUNDED modes on decimals."""
    p = F.lit(10**scale)
    v = x.cast("decimal(30,10)") * p
    body, sign = F.abs(v), F.when(v < 0, F.lit(-1)).otherwise(F.lit(1))
    half = F.lit("0.5").cast("decimal(2,1)")
    units = {
        "NEAREST-AWAY-FROM-ZERO": lambda: sign * F.floor(body + half),
        "TRUNCATION": lambda: sign * F.floor(body),
        "NEAREST-EVEN": lambda: F.bround(v, 0),
        "NEAREST-TOWARD-ZERO": lambda: sign * F.ceil(body - half),
        "TOWARD-GREATER": lambda: F.ceil(v),
        "TOWARD-LESSER": lambda: F.floor(v),
        "AWAY-FROM-ZERO": lambda: sign * F.ceil(body),
    }[mode]()
    return (units.cast("decimal(28,0)") / p).cast(f"decimal(28,{scale})")


def size_error(x: Column, digits: int) -> Column:
    """Too many integer digits for the receiver."""
    return F.abs(x) >= F.lit(10**digits)


def divide(a: Column, b: Column) -> Column:
    """x / 0 is 0 inside an expression."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def fn_mod(a: Column, b: Column) -> Column:
    d = F.when(b == 0, F.lit(1)).otherwise(b)
    return a - d * F.floor(a / d)


def fn_rem(a: Column, b: Column) -> Column:
    d = F.when(b == 0, F.lit(1)).otherwise(b)
    return a % d


def numval(x: Column) -> Column:
    """Digits and dots are the number; a leading or trailing minus, CR or DB negates; none is 0."""
    body = strip(F.coalesce(x, F.lit("")))
    kept = F.regexp_replace(body, r"[^\d.]", "").try_cast("double")
    minus = body.startswith("-") | body.endswith("-") | F.upper(body).endswith("CR") | F.upper(body).endswith("DB")
    return F.coalesce(F.when(minus, -kept).otherwise(kept), F.lit(0.0))


def test_numval(x: Column) -> Column:
    """0 for a whole number in notation, else the place of the first character that isn't; blank: length + 1."""
    body = F.coalesce(x, F.lit(""))
    good = F.length(F.regexp_extract(strip(body), r"^([+-]?[\d,$ ]*(?:\.[\d,$ ]*)?[+-]?)", 1))
    s = strip(body)
    lead = F.length(body) - F.length(F.regexp_replace(body, r"^\s+", ""))
    whole = (good == F.length(s)) & s.rlike(r"\d")
    return F.when(whole, F.lit(0)).when(good == F.length(s), F.length(body) + 1).otherwise(good + lead + 1)


def region(x: Column, before: str | None = None, after: str | None = None) -> tuple[Column, Column]:
    """(first, past the last) character of an INSPECT region, from 0; a missing AFTER is empty, a missing BEFORE is whole."""
    lo = F.lit(0)
    if after is not None:
        at = F.instr(x, after)
        lo = F.when(at > 0, at + len(after) - 1).otherwise(F.length(x))
    hi = F.length(x)
    if before is not None:
        at = F.call_function("locate", F.lit(before), x, lo + 1)
        hi = F.when(at > 0, at - 1).otherwise(F.length(x))
    return lo, hi


def within(x: Column, lo: Column, hi: Column, body) -> Column:
    """The text with `body` applied to characters [lo, hi)."""
    return F.concat(F.substring(x, F.lit(1), lo), body(F.substring(x, lo + 1, F.greatest(hi - lo, F.lit(0)))), F.substring(x, hi + 1, F.length(x)))


def quoted(text: str) -> str:
    """A literal inside a regular expression."""
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in text)


def tally(x: Column, kind: str, what: str | None = None, before: str | None = None, after: str | None = None) -> Column:
    lo, hi = region(x, before, after)
    part = F.substring(x, lo + 1, F.greatest(hi - lo, F.lit(0)))
    if kind == "CHARACTERS":
        return F.length(part)
    if kind == "LEADING":
        return (F.length(F.regexp_extract(part, f"^((?:{quoted(what)})*)", 1)) / len(what)).cast("int")
    return F.regexp_count(part, F.lit(quoted(what)))


def replacing(x: Column, kind: str, what: str | None, to: str, before: str | None = None, after: str | None = None) -> Column:
    lo, hi = region(x, before, after)
    if kind == "CHARACTERS":
        return within(x, lo, hi, lambda p: F.repeat(F.lit((to or " ")[0]), F.length(p)))
    same = to.ljust(len(what))[: len(what)]
    if kind == "ALL":
        return within(x, lo, hi, lambda p: F.replace(p, F.lit(what), F.lit(same)))
    if kind == "FIRST":
        return within(x, lo, hi, lambda p: F.when(F.instr(p, what) > 0, F.overlay(p, F.lit(same), F.instr(p, what))).otherwise(p))

    def leading(p: Column) -> Column:
        run = F.regexp_extract(p, f"^((?:{quoted(what)})*)", 1)
        return F.concat(F.repeat(F.lit(same), (F.length(run) / len(what)).cast("int")), F.substring(p, F.length(run) + 1, F.length(p)))

    return within(x, lo, hi, leading)


def converting(x: Column, source: str, target: str, before: str | None = None, after: str | None = None) -> Column:
    """Character translation; a short target repeats its last character, the first mention of a character counts."""
    seen: dict[str, str] = {}
    for i, c in enumerate(source):
        seen.setdefault(c, target[min(i, len(target) - 1)])
    lo, hi = region(x, before, after)
    return within(x, lo, hi, lambda p: F.translate(p, "".join(seen), "".join(seen.values())))


def string_into(parts: list[tuple[Column, str | None]], width: int) -> tuple[Column, Column]:
    """STRING: (receiver, overflow). A delimiter of None is BY SIZE, else each part stops at its first delimiter."""
    cut = [x if d is None else F.when(F.instr(x, d) > 0, F.substring(x, F.lit(1), F.instr(x, d) - 1)).otherwise(x) for x, d in parts]
    whole = F.concat(*cut)
    return F.rpad(whole, width, " "), F.length(whole) > width


def unstring(x: Column, delimiters: list[str], fields: int) -> tuple[list[Column], Column]:
    """UNSTRING: (fields, how many were filled); the text is cut at any of the delimiters."""
    parts = F.split(x, "|".join(map(quoted, delimiters)), -1)
    return [F.get(parts, i) for i in range(fields)], F.least(F.size(parts), F.lit(fields))


def refmod(x: Column, start: Column | int, length: int) -> Column:
    return F.substring(x, F.lit(start) if isinstance(start, int) else start, F.lit(length))


def refmod_set(x: Column, start: int, length: int, to: Column) -> Column:
    return F.overlay(x, F.rpad(to, length, " "), F.lit(start), F.lit(length))


def integer_of_date(yyyymmdd: Column) -> Column:
    """Days from 1600-12-31; an invalid date is 0."""
    d = F.call_function("try_to_timestamp", F.lpad(yyyymmdd.cast("string"), 8, "0"), F.lit("yyyyMMdd")).cast("date")
    return F.coalesce(F.datediff(d, F.lit("1600-12-31").cast("date")), F.lit(0))


def date_of_integer(days: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1600-12-31").cast("date"), days.cast("int")), "yyyyMMdd").cast("int")


def char_class(x: Column) -> Column:
    c = F.substring(x, 1, 1)
    return F.when(c.rlike(r"\d"), "digit").when(c.rlike(r"\p{Lu}"), "upper").when(c.rlike(r"\p{Ll}"), "lower").when(c == " ", "space")


#: The order of the character classes that differs between the two code pages.
EBCDIC_ORDER = " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
ASCII_ORDER = " 0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def ebcdic_key(x: Column) -> Column:
    """A text whose ASCII order is the text's EBCDIC order (for blanks, letters and digits)."""
    return F.translate(x, EBCDIC_ORDER, ASCII_ORDER)
