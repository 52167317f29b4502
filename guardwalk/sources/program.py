"""Decision programs in fixed-format source: text to fields, paragraphs, statements and call sites, as DataFrames.

One file is one row; the parser runs in mapInPandas, so a code base of any size is
parsed file by file on the executors.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardwalk.functions.codecs import Item, Picture, layout
from guardwalk.session import Rounds

TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\.(?=\s|$)|(?:[^\s'\".]|\.(?!\s|$))+")
VERBS = set("ACCEPT ADD ALTER CALL CLOSE COMPUTE CONTINUE DELETE DISPLAY DIVIDE EVALUATE EXEC EXIT GO GOBACK IF INITIALIZE INSPECT MOVE MULTIPLY OPEN PERFORM READ RETURN REWRITE SEARCH SET SORT START STOP STRING SUBTRACT UNSTRING WRITE".split())
#: Verbs that may carry conditional phrases, and the phrases: name, words it may begin with.
PHRASED = set("ACCEPT ADD CALL COMPUTE DELETE DISPLAY DIVIDE MULTIPLY READ RETURN REWRITE SEARCH START STRING SUBTRACT UNSTRING WRITE".split())
PHRASES = (
    ("AT END", ("AT", "END")), ("SIZE ERROR", ("ON", "SIZE", "ERROR")), ("SIZE ERROR", ("SIZE", "ERROR")), ("OVERFLOW", ("ON", "OVERFLOW")), ("OVERFLOW", ("OVERFLOW",)),
    ("EXCEPTION", ("ON", "EXCEPTION")), ("EXCEPTION", ("EXCEPTION",)), ("INVALID KEY", ("INVALID", "KEY")), ("INVALID KEY", ("INVALID",)),
)
ENDS = {"END-IF", "END-EVALUATE", "END-PERFORM", "ELSE", "WHEN"} | {f"END-{v}" for v in PHRASED}


# The usage words.
USAGES = set("BINARY COMP COMP-1 COMP-2 COMP-3 COMP-4 COMP-5 DISPLAY INDEX PACKED-DECIMAL POINTER".split())


@dataclass
class Statement:
    kind: str
    text: str
    ordinal: int = 0
    body: list = field(default_factory=list)  # IF: then; PERFORM: inline body
    other: list = field(default_factory=list)  # IF: else
    arms: list = field(default_factory=list)  # EVALUATE: [([conditions], body)]
    words: list = field(default_factory=list)
    phrases: dict = field(default_factory=dict)  # AT END, NOT AT END, ...: bodies


@dataclass
class Program:
    name: str
    fields: dict  # name -> {pic, value, parent, occurs, usage, sign, redefines, indexes, file}
    names88: dict  # name -> (parent, values)
    paragraphs: list  # [(name, [Statement])]
    files: dict = field(default_factory=dict)  # name -> {assign, organization, status, record}


def source_lines(text: str) -> list[str]:
    """Columns 8 to 72 of lines that aren't blank or comments."""
    out = []
    for line in text.splitlines():
        body = line.rstrip("\n").ljust(72)
        if body[6] in "*/" or not body[7:72].strip():
            continue
        out.append(body[7:72])
    return out


def literal(t: str):
    if t[0] in "'\"":
        return t[1:-1].replace(t[0] * 2, t[0])
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t)
    if re.fullmatch(r"[+-]?\d*\.\d+", t):
        return float(t)
    return {"SPACE": " ", "SPACES": " ", "ZERO": 0, "ZEROS": 0, "ZEROES": 0, "LOW-VALUES": "\x00", "HIGH-VALUES": "\xff"}.get(t.upper(), t.upper())


def file_control(text: str) -> dict:
    """SELECT clauses: file -> its assignment, organization and status field."""
    out = {}
    for m in re.finditer(r"\bSELECT\s+(?:OPTIONAL\s+)?([\w-]+)(.*?)\.\s", text + " ", re.I | re.S):
        clause = lambda p, m=m: next(iter(re.findall(p + r"\s+([\w-]+)", m[2], re.I)), None)
        out[m[1].upper()] = {
            "assign": clause(r"ASSIGN(?:\s+TO)?"), "organization": (clause(r"ORGANIZATION(?:\s+IS)?") or "SEQUENTIAL").upper(),
            "status": (clause(r"STATUS(?:\s+IS)?") or "").upper() or None, "record": None,
        }
    return out


def data_division(text: str, files: dict | None = None) -> tuple[dict, dict]:
    """Fields and condition names; a file's first record is noted in `files`."""
    fields, names88, stack = {}, {}, []
    of_file = None
    for entry in re.split(r"\.\s", text + " "):
        t = TOKEN.findall(entry)
        if len(t) > 1 and t[-2].upper() in ("FD", "SD") or len(t) > 1 and t[0].upper() in ("FD", "SD"):
            of_file = t[[x.upper() in ("FD", "SD") for x in t].index(True) + 1].upper()
            continue
        if t and t[-1].upper() == "SECTION":
            of_file = None
        if len(t) < 2 or not t[0].isdigit():
            continue
        level, name = int(t[0]), t[1].upper()
        up = [x.upper() for x in t]
        if level == 88:
            vals, out = t[up.index("VALUE" if "VALUE" in up else "VALUES") + 1 :], []
            i = 0
            while i < len(vals):
                if vals[i].upper() in ("IS", "ARE", ","):
                    i += 1
                elif i + 2 < len(vals) and vals[i + 1].upper() in ("THRU", "THROUGH"):
                    out.append((literal(vals[i]), literal(vals[i + 2])))
                    i += 3
                else:
                    out.append(literal(vals[i]))
                    i += 1
            names88[name] = (stack[-1][1], out)
            continue
        while stack and stack[-1][0] >= level:
            stack.pop()
        at = lambda *ks: next((t[up.index(k) + 1 + (up[up.index(k) + 1 : up.index(k) + 2] == ["IS"])] for k in ks if k in up), None)
        v = at("VALUE")
        times, index = at("OCCURS"), up.index("INDEXED") if "INDEXED" in up else len(up)
        usage = at("USAGE") or next((x for x in up[2:] if x in USAGES), "DISPLAY")
        fields[name] = {
            "pic": (at("PIC", "PICTURE") or "").upper(), "value": literal(v) if v else None, "parent": stack[-1][1] if stack else None,
            "occurs": int(times) if times and times.isdigit() else 0, "usage": usage.upper(), "redefines": (at("REDEFINES") or "").upper(),
            "sign": ("LEADING " if "LEADING" in up else "TRAILING " if "TRAILING" in up else "") + ("SEPARATE" if "SEPARATE" in up else ""),
            "indexes": [x for x in up[index + 1 :] if x != "BY" and x not in USAGES], "file": of_file if level == 1 else None,
        }
        if level == 1 and of_file and files is not None and of_file in files and not files[of_file]["record"]:
            files[of_file]["record"] = name
        stack.append((level, name))
    return fields, names88


class Statements:
    """Recursive descent over the tokens of one paragraph."""

    def __init__(self, tokens: list[str]):
        self.t, self.i, self.n = tokens, 0, 0

    def up(self, k: int = 0) -> str:
        return self.t[self.i + k].upper() if self.i + k < len(self.t) else ""

    def until(self, stop) -> list[str]:
        out = []
        while self.i < len(self.t) and self.t[self.i] != "." and not stop(self.up()) and not self.phrase():
            out.append(self.t[self.i])
            self.i += 1
        return out

    def phrase(self) -> tuple[str, int] | None:
        """A conditional phrase that begins here: its name and its number of words."""
        no = self.up() == "NOT"
        for name, words in PHRASES:
            if all(self.up(no + k) == w for k, w in enumerate(words)):
                return ("NOT " if no else "") + name, no + len(words)
        return None

    def phrased(self, s: Statement) -> None:
        """The words up to the phrases, the phrases, and of SEARCH the WHEN arms."""
        while self.i < len(self.t) and self.t[self.i] != "." and self.up() not in VERBS and self.up() not in ENDS and not self.phrase():
            s.words.append(self.t[self.i])
            self.i += 1
        end = f"END-{s.kind}"
        while p := self.phrase():
            self.i += p[1]
            s.phrases[p[0]] = self.sentence_list({end, "WHEN"})
        while s.kind == "SEARCH" and self.up() == "WHEN":
            self.i += 1
            cond = " ".join(self.until(lambda w: w in VERBS or w in ENDS or w == "NEXT"))
            s.arms.append(([cond], self.n, self.sentence_list({"WHEN", end})))
            self.n += 1
        self.i += self.up() == end
        s.text = " ".join(s.words)

    def sentence_list(self, ends: set[str]) -> list[Statement]:
        out = []
        while self.i < len(self.t):
            w = self.up()
            if w == "." or w in ends or (ends and w in ENDS) or self.phrase():
                break
            out.append(self.statement())
        return out

    def paragraph(self) -> list[Statement]:
        out = []
        while self.i < len(self.t):
            if self.t[self.i] == "." or self.up() in ENDS:
                self.i += 1
                continue
            if p := self.phrase():  # without a statement before it
                self.i += p[1]
                continue
            out += self.sentence_list(set())
        return out

    def statement(self) -> Statement:
        verb = self.up()
        self.i += 1
        s = Statement(verb, "", self.n)
        self.n += 1
        starts = lambda w: w in VERBS or w in ENDS
        if verb == "IF":
            s.text = " ".join(self.until(lambda w: w in VERBS or w == "THEN" or w in ENDS))
            self.i += self.up() == "THEN"
            s.body = self.sentence_list({"ELSE", "END-IF"})
            if self.up() == "ELSE":
                self.i += 1
                s.other = self.sentence_list({"END-IF"})
            self.i += self.up() == "END-IF"
        elif verb == "EVALUATE":
            s.text = " ".join(self.until(lambda w: w == "WHEN"))
            while self.up() == "WHEN":
                conds = []
                while self.up() == "WHEN":
                    self.i += 1
                    conds.append(" ".join(self.until(starts)))
                s.arms.append((conds, self.n, self.sentence_list({"WHEN", "END-EVALUATE"})))
                self.n += 1
            self.i += self.up() == "END-EVALUATE"
        elif verb == "PERFORM":
            s.words = self.until(starts)
            first = s.words[0].upper() if s.words else ""
            if first in ("UNTIL", "VARYING", "WITH", "TEST", "") or (len(s.words) > 1 and s.words[1].upper() == "TIMES"):
                s.body = self.sentence_list({"END-PERFORM"})
                self.i += self.up() == "END-PERFORM"
                s.kind = "PERFORM-INLINE"
            s.text = " ".join(s.words)
        elif verb == "EXEC":
            s.words = self.until(lambda w: w == "END-EXEC")
            s.text = " ".join(s.words)
            self.i += self.up() == "END-EXEC"
        elif verb == "EXIT":
            while self.up() in ("PARAGRAPH", "PERFORM", "PROGRAM", "SECTION", "CYCLE"):
                s.words.append(self.up())
                self.i += 1
            s.text = " ".join(s.words)
        elif verb in PHRASED:
            self.phrased(s)
        else:
            s.words = self.until(starts)
            s.text = " ".join(s.words)
        return s


REFERENCE = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|([A-Za-z][\w-]*(?:\{[^}]*\})?)\s*\(([\w\s,:+-]*)\)""")


def bind_references(text: str, fields: dict) -> str:
    """`TAB (I, 2)` and `F(1:3)` of declared fields as one word each: TAB{I,2}, F{1:3}."""

    def one(m: re.Match) -> str:
        if not m[1] or m[1].partition("{")[0].upper() not in fields:
            return m[0]
        inside = re.sub(r"\s*([-+:])\s+", r"\1", m[2].strip())
        return f"{m[1]}{{{re.sub(r'[,\s]+', ',', inside)}}}"

    before = None
    while before != text:
        before, text = text, REFERENCE.sub(one, text)
    return text


def parse_program(text: str) -> Program:
    lines = source_lines(text)
    head, _, proc = "\n".join(lines).partition("PROCEDURE DIVISION")
    name = re.search(r"PROGRAM-ID\.?\s+([\w-]+)", head, re.I)
    before, _, data = head.partition("DATA DIVISION")
    files = file_control(before)
    fields, names88 = data_division(data, files)
    paragraphs: list[tuple[str, list[str]]] = []
    for line in bind_references(proc.partition(".")[2], fields).split("\n"):
        m = re.fullmatch(r"([\w-]+)(?:\s+SECTION)?\s*\.\s*", line)
        if m and not line.startswith("    ") and m[1].upper() not in VERBS | {"GOBACK", "EXIT", "CONTINUE"} | ENDS:
            paragraphs.append((m[1].upper(), []))
        elif line.strip():
            if not paragraphs:
                paragraphs.append(("_ENTRY_", []))
            paragraphs[-1][1].extend(TOKEN.findall(line))
    return Program(name[1].upper() if name else "", fields, names88, [(p, Statements(t).paragraph()) for p, t in paragraphs], files)


def records(p: Program) -> list[Item]:
    """The declared records as trees of items."""
    items = {n: Item(n, f["pic"], f["usage"], f["sign"], f["occurs"], f["redefines"]) for n, f in p.fields.items()}
    for n, f in p.fields.items():
        if f["parent"]:
            items[f["parent"]].children.append(items[n])
    return [items[n] for n, f in p.fields.items() if not f["parent"]]


COPY = re.compile(r"\bCOPY\s+['\"]?([\w-]+)['\"]?(?:\s+(?:OF|IN)\s+[\w-]+)?((?:\s+(?:REPLACING\s+)?(?:==.*?==|\S+)\s+BY\s+(?:==.*?==|[^\s.]+))*)\s*\.", re.I | re.S)
PAIR = re.compile(r"(?:REPLACING\s+)?(==.*?==|\S+)\s+BY\s+(==.*?==|[^\s.]+)", re.I | re.S)


def copy_books(text: str) -> list[str]:
    """Names of the books a source copies, in order, each once."""
    code = "\n".join(line for line in text.splitlines() if line.ljust(7)[6] not in "*/")
    return list(dict.fromkeys(m[1].upper() for m in COPY.finditer(code)))


def expand_copies(text: str, books: dict[str, str]) -> str:
    """COPY statements replaced by their books, whole words and phrases in them by REPLACING; unknown books stay as they are."""
    bare = lambda x: x[2:-2].strip() if x.startswith("==") else x

    def one(m: re.Match) -> str:
        book = books.get(m[1].upper())
        if book is None:
            return m[0]
        for old, new in PAIR.findall(m[2]):
            words = bare(old).split()
            before, behind = (r"(?<![\w-])" if words[0][0].isalnum() else ""), (r"(?![\w-])" if words[-1][-1].isalnum() else "")
            book = re.sub(before + r"\s+".join(map(re.escape, words)) + behind, lambda _, new=new: bare(new), book, flags=re.I)
        return "\n" + book.rstrip("\n") + "\n"

    lines = text.splitlines()
    kept = [line for line in lines if line.ljust(7)[6] not in "*/"]
    return COPY.sub(one, "\n".join(kept))


def walk(statements: list[Statement], guards: tuple[str, ...] = ()):
    """Every statement with the conditions above it; ELSE and later arms carry the negations."""
    for s in statements:
        yield s, guards
        if s.kind == "IF":
            yield from walk(s.body, (*guards, s.text))
            yield from walk(s.other, (*guards, f"NOT ( {s.text} )"))
        elif s.kind == "EVALUATE":
            before: list[str] = []
            for conds, _, body in s.arms:
                own = [] if conds == ["OTHER"] else [" OR ".join(f"( {arm_condition(s.text, c)} )" for c in conds)]
                yield from walk(body, (*guards, *own, *before))
                before += [f"NOT ( {c} )" for c in own]
        elif s.body:
            yield from walk(s.body, guards)
        for body in s.phrases.values():
            yield from walk(body, guards)
        if s.kind == "SEARCH":
            for _, _, body in s.arms:
                yield from walk(body, guards)


def arm_condition(subject: str, arm: str) -> str:
    """The condition of one WHEN: relations, ranges, ALSO, TRUE and FALSE."""
    parts = []
    for sub, a in zip(re.split(r"\s+ALSO\s+", subject), re.split(r"\s+ALSO\s+", arm), strict=False):
        negate = a.upper().startswith("NOT ")
        body = a[4:] if negate else a
        if a.upper() == "ANY":
            continue
        if sub.upper() in ("TRUE", "FALSE"):
            c = body
            negate ^= sub.upper() == "FALSE"
        elif m := re.fullmatch(r"(\S+)\s+(?:THRU|THROUGH)\s+(\S+)", body, re.I):
            c = f"{sub} >= {m[1]} AND {sub} <= {m[2]}"
        elif re.match(r"(?:[<>=]|GREATER|LESS|EQUAL)", body, re.I):
            c = f"{sub} {body}"
        else:
            c = f"{sub} = {body}"
        parts.append(f"NOT ( {c} )" if negate else f"( {c} )" if len(parts) else c)
    return " AND ".join(f"( {p} )" for p in parts) if len(parts) > 1 else parts[0] if parts else ""


def call_sites(p: Program) -> list[tuple]:
    """(caller, callee, seq, guards, kind) by PERFORM, GO TO, ALTER and falling through."""
    out = []
    names = [n for n, _ in p.paragraphs]
    for k, (name, body) in enumerate(p.paragraphs):
        leaves = False
        for s, guards in walk(body):
            w = [x.upper() for x in s.words]
            if s.kind == "PERFORM" and w:
                out.append((name, w[0], list(guards), "perform"))
            elif s.kind == "GO":
                labels = [x for x in w if x not in ("TO", "DEPENDING", "ON")]
                out += [(name, x, list(guards), "goto") for x in labels if x in names]
                leaves |= not guards and "DEPENDING" not in w
            elif s.kind == "ALTER":
                out.append((w[0], w[-1], list(guards), "alter"))
            elif s.kind in ("GOBACK", "STOP") and not guards:
                leaves = True
        if not leaves and k + 1 < len(names):
            out.append((name, names[k + 1], [], "fallthrough"))
    return [(a, b, i + 1, g, kind) for i, (a, b, g, kind) in enumerate(out)]


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(path, source) of all files under a path that Spark can read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("source"))


def _table(sources: DataFrame, rows_of, schema: str) -> DataFrame:
    columns = [f.name for f in sources.sparkSession.createDataFrame([], schema).schema]

    def run(frames):
        for pdf in frames:
            rows = [r for text in pdf["source"] for r in rows_of(parse_program(text))]
            yield pd.DataFrame(rows, columns=columns)

    return sources.select("source").mapInPandas(run, schema)


def paragraphs(sources: DataFrame) -> DataFrame:
    return _table(sources, lambda p: [(p.name, i, n, sum(1 for _ in walk(b))) for i, (n, b) in enumerate(p.paragraphs)], "program string, pos int, paragraph string, n_statements int")


def statements(sources: DataFrame) -> DataFrame:
    return _table(sources, lambda p: [(p.name, n, s.ordinal, s.kind, s.text, list(g)) for n, b in p.paragraphs for s, g in walk(b)], "program string, paragraph string, ordinal int, kind string, text string, guards array<string>")


def fields(sources: DataFrame) -> DataFrame:
    return _table(sources, lambda p: [(p.name, n, f["parent"], f["pic"], None if f["value"] is None else json.dumps(f["value"])) for n, f in p.fields.items()], "program string, field string, parent string, pic string, value string")


def pictures(sources: DataFrame) -> DataFrame:
    """(program, field, numeric, width) of every field that has a picture: a number's digits before the point, else printed characters."""

    def rows(p: Program):
        for n, f in p.fields.items():
            if f["pic"]:
                pic = Picture.of(f["pic"])
                yield p.name, n, pic.numeric, pic.whole if pic.numeric else pic.printed

    return _table(sources, lambda p: list(rows(p)), "program string, field string, numeric boolean, width int")


def edges(sources: DataFrame) -> DataFrame:
    return _table(sources, lambda p: [(p.name, *c) for c in call_sites(p)], "program string, caller string, callee string, seq long, guards array<string>, kind string")


def branches(sources: DataFrame) -> DataFrame:
    """Every decision: IF, each WHEN arm, and loops."""

    def rows(p: Program):
        for n, b in p.paragraphs:
            for s, _ in walk(b):
                if s.kind == "IF":
                    yield p.name, n, s.ordinal, "IF", s.text
                elif s.kind == "EVALUATE":
                    yield from ((p.name, n, o, "WHEN", " OR ".join(c)) for c, o, _ in s.arms)
                elif s.kind.startswith("PERFORM") and {"UNTIL", "VARYING", "TIMES"} & {w.upper() for w in s.words}:
                    yield p.name, n, s.ordinal, "LOOP", s.text

    return _table(sources, lambda p: list(rows(p)), "program string, paragraph string, ordinal int, kind string, text string")


def layouts(sources: DataFrame) -> DataFrame:
    """Every record's fields with their places in bytes."""

    def rows(p: Program):
        for item in records(p):
            yield from ((p.name, item.name, x.name, x.offset, x.length, x.occurs) for x in layout(item))

    return _table(sources, lambda p: list(rows(p)), "program string, record string, field string, offset int, length int, occurs int")


def files(sources: DataFrame) -> DataFrame:
    return _table(sources, lambda p: [(p.name, n, f["assign"], f["organization"], f["status"], f["record"]) for n, f in p.files.items()], "program string, file string, assign string, organization string, status string, record string")


#: Verbs that meet the world outside, with how an operation is named.
OUTSIDE = set("ACCEPT CALL CLOSE DELETE EXEC OPEN READ RETURN REWRITE START WRITE".split())


def operation(s: Statement) -> str:
    """VERB:object; OPEN and CLOSE name the file behind the mode, EXEC its first two words."""
    w = [x.upper().strip("'\"") for x in s.words if x.upper() not in ("INPUT", "OUTPUT", "I-O", "EXTEND")]
    return f"{s.kind}:{' '.join(w[:2]) if s.kind == 'EXEC' else w[0] if w else ''}"


def operations(sources: DataFrame) -> DataFrame:
    """(program, paragraph, ordinal, operation, phrases) of every statement that meets the world outside."""

    def rows(p: Program):
        for n, b in p.paragraphs:
            yield from ((p.name, n, s.ordinal, operation(s), list(s.phrases)) for s, _ in walk(b) if s.kind in OUTSIDE)

    return _table(sources, lambda p: list(rows(p)), "program string, paragraph string, ordinal int, operation string, phrases array<string>")


def execution_order(sources: DataFrame) -> DataFrame:
    """(program, paragraph, rank): paragraphs as a walk from the first one enters them, calls in source order; unreached ones behind, in source order."""

    def rows(p: Program):
        below: dict[str, list[str]] = {}
        for caller, callee, *_ in call_sites(p):
            below.setdefault(caller, []).append(callee)
        names = [n for n, _ in p.paragraphs]
        seen: dict[str, None] = {}
        stack = names[:1]
        while stack:
            at = stack.pop()
            if at in names and at not in seen:
                seen[at] = None
                stack += below.get(at, [])[::-1]
        return [(p.name, n, i) for i, n in enumerate([*seen, *(n for n in names if n not in seen)])]

    return _table(sources, rows, "program string, paragraph string, rank int")


def copies(sources: DataFrame) -> DataFrame:
    """(path, book) for every book that a source copies."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(path, b) for path, text in zip(pdf["path"], pdf["source"], strict=True) for b in copy_books(text)], columns=["path", "book"])

    return sources.select("path", "source").mapInPandas(run, "path string, book string")


def expanded(sources: DataFrame, books: DataFrame) -> DataFrame:
    """(path, source) with COPY statements expanded from `books` (book, text), books in books however deep; a book that copies itself is an error."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["path"], "source": [expand_copies(t, dict(b or {})) for t, b in zip(pdf["source"], pdf["books"], strict=True)]})

    cut = Rounds(sources.sparkSession).cut
    for _ in range(books.count() + 1):
        wanted = cut(copies(sources).join(books.select(F.upper("book").alias("book"), "text"), "book"))
        if wanted.isEmpty():
            return sources
        held = wanted.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("book", "text"))).alias("books"))
        sources = cut(sources.select("path", "source").join(held, "path", "left").mapInPandas(run, "path string, source string"))
    raise ValueError("a book copies itself: COPY statements are left after as many rounds as there are books")
