"""Plans: an entry state for every target, solved from the guards of its shortest chain and checked by running it.

Programs are solved in parallel, one group each; a program's targets share its
parsed source. A value of a field is the first of its domain (the values the
program compares it with, their neighbours, its declared value, then samples of
the right shape) that satisfies every atom on it; of a condition's alternatives
the first that can be met is taken. What can't be met stays open, for this chain.
"""

from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame

from guardwalk.functions.conditions import Atom, Name, dnf, parse
from guardwalk.plans.runner import Run
from guardwalk.plans.values import related
from guardwalk.sources.program import Program, call_sites, parse_program, walk

SAMPLES = ("A", "Z", " ", 0, 1, 9)
#: Choices of alternatives that are tried for one target.
TRIES = 512
TRIES_LIMIT = "tries_limit"


def chain_to(p: Program, target: str) -> list[tuple] | None:
    """Edges of the shortest chain from the first paragraph; of equal ones the first in source order."""
    start = p.paragraphs[0][0]
    came: dict[str, tuple | None] = {start: None}
    queue = deque([start])
    out: dict[str, list[tuple]] = {}
    for c in call_sites(p):
        out.setdefault(c[0], []).append(c)
    while queue:
        at = queue.popleft()
        if at == target:
            path = []
            while came[at]:
                path.append(came[at])
                at = came[at][0]
            return path[::-1]
        for c in out.get(at, []):
            if c[1] not in came:
                came[c[1]] = c
                queue.append(c[1])
    return None


def literals(p: Program) -> dict[str, list]:
    """Field -> the values it is compared with anywhere, in source order."""
    found: dict[str, list] = {}
    for _, body in p.paragraphs:
        for _, guards in walk(body):
            for g in guards:
                for alt in dnf(parse(g, p.names88)):
                    for a in alt:
                        if isinstance(a.left, Name) and not isinstance(a.right, Name):
                            found.setdefault(a.left.text, [])
                            if a.right not in found[a.left.text]:
                                found[a.left.text].append(a.right)
    return found


def domain(p: Program, field: str, compared: dict[str, list]) -> list:
    out = []
    for v in compared.get(field, []):
        out += [v, v + 1, v - 1] if isinstance(v, (int, float)) and not isinstance(v, bool) else [v]
    declared = p.fields.get(field, {}).get("value")
    out = ([declared] if declared is not None else []) + out + list(SAMPLES)
    return list(dict.fromkeys(out))


def solve(p: Program, guards: list[str], compared: dict[str, list]) -> tuple[dict, list[str]]:
    """(field -> value, open guards); more than TRIES choices end the search, with TRIES_LIMIT among the open guards."""
    choices, open_ = [], []
    for g in guards:
        alts = dnf(parse(g, p.names88))
        if alts:
            choices.append((g, alts))
        else:
            open_.append(g)
    tried = 0

    def values(atoms: list[Atom]) -> dict | None:
        by: dict[str, list[Atom]] = {}
        pairs = []
        for a in atoms:
            if isinstance(a.right, Name):
                pairs.append(a)
            elif isinstance(a.left, Name):
                by.setdefault(a.left.text, []).append(a)
            elif not related(a.left, a.op, a.right):
                return None
        state = {}
        for f, own in by.items():
            v = next((v for v in domain(p, f, compared) if all(related(v, a.op, a.right) for a in own)), None)
            if v is None:
                return None
            state[f] = v
        for a in pairs:  # the free side follows the bound one
            l, r = a.left.text, a.right.text
            fixed, free, left = (l, r, True) if l in state or r not in state else (r, l, False)
            base = state.get(fixed, next(iter(domain(p, fixed, compared))))
            options = [base, *([base + 1, base - 1] if isinstance(base, (int, float)) else []), *domain(p, free, compared)]
            fit = lambda v: related(base, a.op, v) if left else related(v, a.op, base)  # noqa: E731, B023
            v = state[free] if free in state and fit(state[free]) else next((v for v in options if free not in state and fit(v)), None)
            if v is None:
                return None
            state[fixed], state[free] = base, v
        return state

    def search(i: int, atoms: list[Atom]) -> dict | None:
        nonlocal tried
        got = values(atoms)
        if got is None or i == len(choices):
            return got
        for alt in choices[i][1]:
            tried += 1
            if tried > TRIES:
                return None
            if (out := search(i + 1, atoms + alt)) is not None:
                return out
        return None

    got = search(0, [])
    if got is not None:
        return got, open_
    if tried > TRIES:
        open_.append(TRIES_LIMIT)
    state: list[Atom] = []  # keep what can be kept, in order; the rest is open
    for g, alts in choices:
        alt = next((a for a in alts if values(state + a) is not None), None)
        if alt is None:
            open_.append(g)
        else:
            state += alt
    return values(state) or {}, open_


def plans(sources: DataFrame) -> DataFrame:
    """(program, target, chain, state, open, verdict) for every paragraph of every source."""

    def rows(text: str):
        p = parse_program(text)
        compared = literals(p)
        for target, _ in p.paragraphs:
            chain = chain_to(p, target)
            if chain is None:
                yield p.name, target, None, None, [], "unreachable"
                continue
            state, open_ = solve(p, [g for c in chain for g in c[3]], compared)
            entered = Run(p, state).go().entered
            verdict = "verified" if target in entered else TRIES_LIMIT if TRIES_LIMIT in open_ else "open" if open_ else "target_not_reached"
            yield p.name, target, [p.paragraphs[0][0], *(c[1] for c in chain)], json.dumps(state, sort_keys=True), open_, verdict

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([r for t in pdf["source"] for r in rows(t)], columns=["program", "target", "chain", "state", "open", "verdict"])

    return sources.select("source").mapInPandas(run, "program string, target string, chain array<string>, state string, open array<string>, verdict string")
