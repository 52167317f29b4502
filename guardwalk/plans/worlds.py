"""Outcome worlds: what the operations of a program answer, one row per world.

A world is a map from operations to their outcomes in order; where they are used up,
reads meet the end. All worlds of a program come from its own operations and records.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from guardwalk.functions.codecs import Picture
from guardwalk.plans.solver import literals
from guardwalk.sources.program import OUTSIDE, Program, operation, parse_program, walk

# The longest sequence, worlds of faults, and fault codes tried per operation.
SEQUENCE, FAULTS, CODES = 3, 60, 3
DEFAULT_CODES = {"READ": ("23", "46", "30"), "OPEN": ("35", "30", "41")}
OTHER_CODES = ("30", "22", "24")


def outside(p: Program) -> list[str]:
    """The program's operations in source order."""
    return list(dict.fromkeys(operation(s) for _, b in p.paragraphs for s, _ in walk(b) if s.kind in OUTSIDE))


def record_fields(p: Program, file: str) -> list[str]:
    """The elementary fields of a file's record."""
    record = (p.files.get(file) or {}).get("record")
    if record is None:
        return []
    below = {record}
    for n, f in p.fields.items():
        if f["parent"] in below:
            below.add(n)
    return [n for n in p.fields if n in below and p.fields[n]["pic"]]


def payload(p: Program, file: str, i: int, compared: dict[str, list]) -> dict:
    """Record i: the fields' compared values in turn; fields without any get one of their own."""
    out = {}
    for n in record_fields(p, file):
        values = compared.get(n)
        pic = Picture.of(p.fields[n]["pic"])
        out[n] = values[i % len(values)] if values else i + 1 if pic.numeric else chr(65 + i % 26) * max(1, pic.printed)
    return out


def reads(p: Program) -> list[str]:
    return [op for op in outside(p) if op.startswith(("READ:", "RETURN:"))]


def sequence(p: Program, n: int, compared: dict) -> dict[str, list[dict]]:
    """n records from every file, then the end."""
    return {op: [{**payload(p, op.partition(":")[2], i, compared), "status": "00"} for i in range(n)] + [{"status": "10"}] for op in reads(p)}


def fault_codes(p: Program, op: str, compared: dict) -> list[str]:
    """The codes that the program compares the file's status with first, then usual ones; not the successes."""
    verb, _, file = op.partition(":")
    status = (p.files.get(file) or {}).get("status")
    own = [str(v) for v in compared.get(status, []) if str(v).strip() not in ("00", "0", "")]
    return list(dict.fromkeys([*own, *DEFAULT_CODES.get(verb, OTHER_CODES)]))[:CODES]


def worlds_of(p: Program) -> Iterator[tuple[str, str, dict]]:
    """(kind, name, outcomes)."""
    compared = literals(p)
    yield "io", "bare", {}
    yield "io", "empty", sequence(p, 0, compared)
    yield "io", "populated", sequence(p, 1, compared)
    for n in range(1, SEQUENCE + 1):
        yield "sequence", f"sequence {n}", sequence(p, n, compared)
    faults = []
    for order, op in enumerate(outside(p)):
        for rank, code in enumerate(fault_codes(p, op, compared)):
            for call in (1, 2) if op.startswith("READ:") else (1,):
                faults.append((rank, call, op.partition(":")[2], op, order, code))
    for _, call, _, op, _, code in sorted(faults)[:FAULTS]:  # by rank and call first, so that the limit falls evenly
        world = sequence(p, SEQUENCE, compared)
        series = world.setdefault(op, [])
        while len(series) < call:
            series.append({"status": "00"})
        series[call - 1] = {"status": code}
        yield "fault", f"{op} {code} at {call}", world


def worlds(sources: DataFrame) -> DataFrame:
    """(program, kind, world, outcomes) for every source; outcomes as JSON, ready for the runner."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(p.name, kind, name, json.dumps(o)) for p in map(parse_program, pdf["source"]) for kind, name, o in worlds_of(p)]
            yield pd.DataFrame(rows, columns=["program", "kind", "world", "outcomes"])

    return sources.select("source").mapInPandas(run, "program string, kind string, world string, outcomes string")
