"""Condition text to a Column predicate or to disjunctive normal form.

The grammar: OR, AND, NOT, parentheses, relations in symbols or words (with IS and
NOT), abbreviated relations (`A = 1 OR 2`), class conditions and condition names.
Literals are kept whole, whatever words stand inside their quotes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardwalk.functions.cobol import class_test, compare

TOKEN = re.compile(r"""\s*('(?:[^']|'')*'|"(?:[^"]|"")*"|<=|>=|<>|[()=<>]|[^\s()=<>'"]+)""")
# The relation words.
WORDS = (
    (("GREATER", "THAN", "OR", "EQUAL", "TO"), ">="), (("GREATER", "THAN", "OR", "EQUAL"), ">="), (("LESS", "THAN", "OR", "EQUAL", "TO"), "<="),
    (("LESS", "THAN", "OR", "EQUAL"), "<="), (("GREATER", "THAN"), ">"), (("LESS", "THAN"), "<"), (("EQUAL", "TO"), "="), (("EQUALS",), "="),
    (("EQUAL",), "="), (("GREATER",), ">"), (("LESS",), "<"), (("=",), "="), (("<>",), "!="), ((">=",), ">="), (("<=",), "<="), ((">",), ">"), (("<",), "<"),
)
CLASSES = ("NUMERIC", "ALPHABETIC", "ALPHABETIC-LOWER", "ALPHABETIC-UPPER", "POSITIVE", "NEGATIVE", "ZERO")
FIGURATIVE = {"SPACE": " ", "SPACES": " ", "ZEROS": 0, "ZEROES": 0, "LOW-VALUE": "\x00", "LOW-VALUES": "\x00", "HIGH-VALUE": "\xff", "HIGH-VALUES": "\xff"}
FLIP = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">", "IS": "IS-NOT", "IS-NOT": "IS"}


@dataclass(frozen=True)
class Atom:
    left: object
    op: str
    right: object


@dataclass
class Node:
    kind: str  # and, or, not, atom, true
    parts: list = field(default_factory=list)
    atom: Atom | None = None


@dataclass(frozen=True)
class Name:
    text: str


class Parser:
    def __init__(self, text: str, names88: dict[str, tuple[str, list]] | None = None):
        self.t, self.i = [m[1] for m in TOKEN.finditer(text)], 0
        self.names88 = {k.upper(): v for k, v in (names88 or {}).items()}
        self.subject, self.op = None, None

    def word(self, k: int = 0) -> str:
        return self.t[self.i + k].upper() if self.i + k < len(self.t) else ""

    def parse(self) -> Node:
        if not self.t:
            return Node("true")
        n = self.either()
        if self.i < len(self.t):
            raise ValueError(f"unexpected {self.t[self.i]!r}")
        return n

    def either(self) -> Node:
        parts = [self.both()]
        while self.word() == "OR":
            self.i += 1
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", parts)

    def both(self) -> Node:
        parts = [self.one()]
        while self.word() == "AND":
            self.i += 1
            parts.append(self.one())
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def one(self) -> Node:
        if self.word() == "NOT" and not self.relation_ahead(1):
            self.i += 1
            return Node("not", [self.one()])
        if self.word() == "(":
            self.i += 1
            n = self.either()
            if self.word() != ")":
                raise ValueError("a parenthesis is open")
            self.i += 1
            return n
        return self.relation()

    def relation_ahead(self, k: int) -> bool:
        return any(self.word(k) == w[0] for w, _ in WORDS)

    def relation(self) -> Node:
        if self.relation_ahead(0) or (self.word() == "NOT" and self.relation_ahead(1)):  # the subject is the last one
            return self.compared(self.subject)
        left = self.operand()
        if self.word() in ("IS", "NOT") or self.relation_ahead(0) or self.word() in CLASSES:
            self.subject = left
            return self.compared(left)
        if isinstance(left, Name) and left.text in self.names88:
            parent, values = self.names88[left.text]
            alts = []
            for v in values:
                if isinstance(v, tuple):
                    alts.append(Node("and", [Node("atom", atom=Atom(Name(parent), ">=", v[0])), Node("atom", atom=Atom(Name(parent), "<=", v[1]))]))
                else:
                    alts.append(Node("atom", atom=Atom(Name(parent), "=", v)))
            return alts[0] if len(alts) == 1 else Node("or", alts)
        if self.op:  # abbreviated: subject and relation are the last ones
            return Node("atom", atom=Atom(self.subject, self.op, left))
        return Node("atom", atom=Atom(left, "=", True))

    def compared(self, left) -> Node:
        negate = False
        if self.word() in ("IS", "ARE"):
            self.i += 1
        if self.word() == "NOT":
            negate, self.i = True, self.i + 1
        if self.word() in CLASSES:
            name = self.t[self.i].upper()
            self.i += 1
            return Node("atom", atom=Atom(left, "IS-NOT" if negate else "IS", name))
        for words, op in WORDS:
            if all(self.word(k) == w for k, w in enumerate(words)):
                self.i += len(words)
                self.op = FLIP[op] if negate else op
                if self.word() == "(":  # a list of operands under one relation
                    return self.operands(left)
                return Node("atom", atom=Atom(left, self.op, self.operand()))
        raise ValueError(f"no relation at {self.word()!r}")

    def operands(self, left) -> Node:
        self.i += 1
        parts, kind = [Node("atom", atom=Atom(left, self.op, self.operand()))], "or"
        while self.word() in ("AND", "OR"):
            kind = self.word().lower()
            self.i += 1
            parts.append(Node("atom", atom=Atom(left, self.op, self.operand())))
        if self.word() != ")":
            raise ValueError("a parenthesis is open")
        self.i += 1
        return parts[0] if len(parts) == 1 else Node(kind, parts)

    def operand(self):
        t = self.t[self.i]
        self.i += 1
        if t[0] in "'\"":
            return t[1:-1].replace(t[0] * 2, t[0])
        if t.upper() in FIGURATIVE:
            return FIGURATIVE[t.upper()]
        if re.fullmatch(r"[+-]?\d+", t):
            return int(t)
        if re.fullmatch(r"[+-]?\d*\.\d+", t):
            return float(t)
        return Name(t.upper())


def parse(text: str, names88: dict | None = None) -> Node:
    text = re.sub(r"(?i)\s+(?:THEN|NEXT\s+SENTENCE)\s*$", "", text)
    return Parser(text, names88).parse()


def negated(n: Node) -> Node:
    """De Morgan; alternatives become conjunctions and the other way round."""
    if n.kind == "atom":
        return Node("atom", atom=Atom(n.atom.left, FLIP[n.atom.op], n.atom.right))
    if n.kind == "not":
        return n.parts[0]
    if n.kind == "true":
        return Node("not", [n])
    return Node("and" if n.kind == "or" else "or", [negated(p) for p in n.parts])


def dnf(n: Node) -> list[list[Atom]]:
    """Alternatives of conjunctions; all are kept."""
    if n.kind == "true":
        return [[]]
    if n.kind == "atom":
        return [[n.atom]]
    if n.kind == "not":
        return [] if n.parts[0].kind == "true" else dnf(negated(n.parts[0]))
    if n.kind == "or":
        return [c for p in n.parts for c in dnf(p)]
    out: list[list[Atom]] = [[]]
    for p in n.parts:
        out = [a + b for a in out for b in dnf(p)]
    return out


def column(n: Node, fields: dict[str, tuple[Column, str]]) -> Column:
    """The predicate over `fields`: name -> (Column, Spark type). Missing values make it false, so that NOT is its complement."""
    if n.kind == "true":
        return F.lit(True)
    if n.kind == "not":
        return ~column(n.parts[0], fields)
    if n.kind in ("and", "or"):
        out = column(n.parts[0], fields)
        for p in n.parts[1:]:
            out = out & column(p, fields) if n.kind == "and" else out | column(p, fields)
        return out

    def side(x) -> tuple[Column, str]:
        if isinstance(x, Name):
            return fields[x.text]
        kind = "string" if isinstance(x, str) else "boolean" if isinstance(x, bool) else "bigint" if isinstance(x, int) else "double"
        return F.lit(x), kind

    a = n.atom
    if a.op in ("IS", "IS-NOT"):
        t = class_test(side(a.left)[0], a.right)
        return t if a.op == "IS" else ~t
    (l, lk), (r, rk) = side(a.left), side(a.right)
    return F.coalesce(compare(l, a.op, r, lk, rk), F.lit(a.op == "!="))


def condition(text: str, fields: dict[str, tuple[Column, str]], names88: dict | None = None) -> Column:
    return column(parse(text, names88), {k.upper(): v for k, v in fields.items()})


def first_match(arms: list[tuple[str, object]], fields: dict, other: object = None, names88: dict | None = None) -> Column:
    """EVALUATE TRUE: the value of the first arm whose condition holds."""
    out = F
    for text, value in arms:
        out = out.when(condition(text, fields, names88), F.lit(value))
    return out.otherwise(F.lit(other))


#: The relation when both sides change places.
SWAP = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def swapped(a: Atom) -> Atom:
    """The same atom with its sides exchanged."""
    return Atom(a.right, SWAP[a.op], a.left)


def rendered(n: Node) -> str:
    """One spelling for every condition: symbols, upper case, parentheses where one connective stands below another."""

    def say(x) -> str:
        if isinstance(x, Name):
            return x.text
        return "TRUE" if x is True else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    if n.kind == "true":
        return ""
    if n.kind == "atom":
        a = n.atom
        if a.op.startswith("IS"):
            return f"{say(a.left)} {'IS NOT' if a.op == 'IS-NOT' else 'IS'} {a.right}"
        return f"{say(a.left)} {'NOT =' if a.op == '!=' else a.op} {say(a.right)}"
    inside = [f"( {rendered(p)} )" if p.kind in ("or", "and") and p.kind != n.kind else rendered(p) for p in n.parts]
    return f"NOT {inside[0]}" if n.kind == "not" else f" {n.kind.upper()} ".join(inside)


def normalised(text: str, names88: dict | None = None) -> str:
    """The condition in one spelling, for matching conditions from different sources."""
    return rendered(parse(text, names88))


def substituted(n: Node, known: dict[str, object]) -> Node:
    """Known fields replaced by their values."""
    if n.kind == "atom":
        put = lambda x: known.get(x.text, x) if isinstance(x, Name) else x
        return Node("atom", atom=Atom(put(n.atom.left), n.atom.op, put(n.atom.right)))
    return Node(n.kind, [substituted(p, known) for p in n.parts])


def contradicts(a: Atom, b: Atom, holds) -> bool:
    """Whether no value of their common field satisfies both atoms; `holds(value, relation, constant)` decides one.

    Numbers: the constants, what lies between and beside them are all the cases there
    are. Texts: only an equality excludes others.
    """
    a, b = (swapped(x) if isinstance(x.right, Name) and not isinstance(x.left, Name) and x.op in SWAP else x for x in (a, b))
    if not isinstance(a.left, Name) or a.left != b.left or isinstance(a.right, Name) or isinstance(b.right, Name):
        return False
    classes = a.op.startswith("IS"), b.op.startswith("IS")
    if any(classes):
        return all(classes) and a.right == b.right and a.op != b.op
    x, y = a.right, b.right
    numeric = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in (x, y))
    tried = [x, y, (x + y) / 2, min(x, y) - 1, max(x, y) + 1] if numeric else [v for v, op in ((x, a.op), (y, b.op)) if op == "="]
    return bool(tried) and not any(holds(v, a.op, x) and holds(v, b.op, y) for v in tried)
