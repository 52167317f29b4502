"""Bounds and conflicts of many small plans at once, in numpy: what the rounds of `domains` find, for plans that leave nothing to choose.

Rows (plan, id, left, op, right, value) come plan by plan. All bounds of a batch rise together until none does: they are
the same whatever the order. A plan is left to the rounds (`left`) where its bounds haven't settled after as many turns as it has
fields and excluded values (a circle that gains never does), where a clash leans on bounds that only lean on each other or on one
of several ways that are equally good, where an id is null, or where a number is too large to be added to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from guardwalk.operators.together import begins, groups, one

#: Rows that are worked on together, whole plans of them.
ROWS = 200_000
#: Numbers beyond are left to the rounds.
LARGE = 1 << 61


def settle(constraints: DataFrame, least: int, most: int) -> DataFrame:
    """(plan, field, lo, hi, conflict, left): a row per field, one with a conflict, or one that leaves the plan to the rounds. Plans are `together.known`, rows taken ones."""
    plan = constraints.schema["plan"].dataType
    schema = T.StructType([T.StructField("plan", plan), *T.StructType.fromDDL("field string, lo long, hi long, conflict array<string>, left boolean").fields])
    made = [("field", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("conflict", pa.list_(pa.string())), ("left", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "plan", ROWS):
            yield from _solved(t, least, most, pa.schema([("plan", t.schema.field("plan").type), *made]))

    return constraints.select("plan", "id", "left", "op", "right", "value").repartition("plan").sortWithinPartitions("plan").mapInArrow(run, schema)


def _coded(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = a.dictionary_encode()
    return d.indices.fill_null(-1).to_numpy().astype(np.int64), d.dictionary


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, which ones differ from the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


class _Gone:
    """Excluded values of fields, and where a bound that meets one ends up."""

    def __init__(self, field: np.ndarray, value: np.ndarray, id_: np.ndarray):
        order = np.lexsort((id_, value, field))
        order = order[_firsts(field[order], value[order])]
        f, v, self.id = field[order], value[order], id_[order]
        self.values, rank = np.unique(v, return_inverse=True)
        self.key = f * len(self.values) + rank
        apart = np.flatnonzero((f[1:] != f[:-1]) | (v[1:] - 1 != v[:-1]))
        ends = np.append(apart, len(f) - 1) if len(f) else apart
        self.to = v[ends[np.searchsorted(ends, np.arange(len(f)))]] + 1 if len(f) else v

    def at(self, field: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether x is excluded, and its place."""
        if not len(self.key):
            return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
        rank = np.minimum(np.searchsorted(self.values, x), len(self.values) - 1)
        key = field * len(self.values) + rank
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.values[rank] == x) & (self.key[place] == key), place

    def passed(self, field: np.ndarray, x: np.ndarray) -> np.ndarray:
        hit, place = self.at(field, x)
        return np.where(hit, self.to[place], x) if len(self.key) else x


def _own(n: int, field: np.ndarray, bound: np.ndarray, id_: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The bound that each of n fields has by itself before excluded values, and whose it is (-1: the domain's)."""
    start, by = np.full(n, least, np.int64), np.full(n, -1, np.int64)
    order = np.lexsort((id_, -bound, field))
    order = order[_firsts(field[order])]
    order = order[bound[order] > least]
    start[field[order]], by[field[order]] = bound[order], id_[order]
    return start, by


def _risen(start: np.ndarray, u: np.ndarray, v: np.ndarray, by: np.ndarray, gone: _Gone, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least values of all fields, and which fields still rose when their `turns` were over."""
    every = np.arange(len(start))
    bound = gone.passed(every, start)
    moved, late = np.ones(len(start), bool), np.zeros(len(start), bool)
    turn = 0
    while True:
        e = np.flatnonzero(moved[u])
        told = bound[u[e]] + by[e]
        higher = told > bound[v[e]]
        e, told = e[higher], told[higher]
        over = turn >= turns[v[e]]
        late[v[e][over]] = True
        e, told = e[~over], told[~over]
        if not len(e):
            return bound, late
        new = bound.copy()
        np.maximum.at(new, v[e], told)
        met = np.unique(v[e])
        new[met] = gone.passed(met, new[met])
        moved = new > bound
        bound, turn = new, turn + 1


def _solved(t: pa.Table, least: int, most: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    at = begins(t.column("plan"))
    plans = one(t.column("plan")).take(pa.array(at))
    n_plans, n = len(at), t.num_rows
    p = np.repeat(np.arange(n_plans), np.diff(np.append(at, n)))
    op = pc.index_in(one(t.column("op")), pa.array(["=", "<", "<=", ">", ">=", "<>"])).to_numpy()
    eq, lt, le, gt, ge, ne = (op == i for i in range(6))
    value = one(t.column("value")).fill_null(0).to_numpy()
    code, names = _coded(pa.concat_arrays([one(t.column("left")), one(t.column("right"))]))
    two = code[n:] >= 0
    id_, ids = _coded(one(t.column("id")))
    left = np.zeros(n_plans, bool)
    left[p[(id_ < 0) | ~two & (abs(value) > LARGE)]] = True
    if max(abs(least), abs(most)) > LARGE:
        left[:] = True
    order = pc.sort_indices(ids).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    id_ = np.where(id_ < 0, -1, rank[id_]) if len(rank) else id_

    keys, at = np.unique(np.concatenate([p * len(names) + code[:n], (p * len(names) + code[n:])[two]]), return_inverse=True)
    plan, name, n_fields = keys // len(names), keys % len(names), len(keys)
    a, b = at[:n], np.zeros(n, np.int64)
    b[two] = at[n:]
    alone = ~two
    up, down = two & (lt | le | eq), two & (gt | ge | eq)
    gains = (lt | gt).astype(np.int64)
    u, v = np.concatenate([a[up], b[down]]), np.concatenate([b[up], a[down]])
    by, edge = np.concatenate([gains[up], gains[down]]), np.concatenate([id_[up], id_[down]])
    order = np.lexsort((edge, by, u, v))
    order = order[_firsts(v[order], u[order], by[order], edge[order])]
    order = order[~left[plan[v[order]]]]
    u, v, by, edge = u[order], v[order], by[order], edge[order]
    turns = (np.bincount(plan, minlength=n_plans) + np.bincount(p[ne & alone], minlength=n_plans) + 1)[plan]

    lows, caps, gone = alone & (eq | gt | ge), alone & (eq | lt | le), alone & ne
    cap_at, cap, cap_id = a[caps], value[caps] - lt[caps], id_[caps]
    out_low = _Gone(a[gone], value[gone], id_[gone])
    start, own = _own(n_fields, a[lows], value[lows] + gt[lows], id_[lows], least)
    low, late = _risen(start, u, v, by, out_low, turns)
    left[plan[late]] = True
    lowest = np.full(n_fields, most, np.int64)
    np.minimum.at(lowest, cap_at, cap)
    hurt = np.zeros(n_plans, bool)
    hurt[plan[low > lowest]] = True
    hurt &= ~left

    fine = ~left & ~hurt
    keep = fine[plan[v]]
    start_high, _ = _own(n_fields, cap_at, -cap, cap_id, -most)
    high, late = _risen(start_high, v[keep], u[keep], by[keep], _Gone(a[gone], -value[gone], id_[gone]), turns)
    left[plan[late]] = True
    fine &= ~left
    f = np.flatnonzero(fine[plan])
    yield _batch(out, plans.take(pa.array(plan[f])), names.take(pa.array(name[f])), pa.array(low[f]), pa.array(-high[f]), None, False)

    keep = hurt[plan[v]]
    clashes = _clashes(hurt, left, plan, low, start, own, (u[keep], v[keep], by[keep], edge[keep]), out_low, (cap_at, cap, cap_id), lowest, most)
    if clashes:
        sizes = np.cumsum([0] + [len(c) for c in clashes.values()])
        flat = np.array([i for c in clashes.values() for i in c], np.int64)
        inverse = pc.sort_indices(ids)
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), ids.take(inverse.take(pa.array(flat))))
        yield _batch(out, plans.take(pa.array(list(clashes), pa.int64())), None, None, None, lists, False)
    if left.any():
        yield _batch(out, plans.take(pa.array(np.flatnonzero(left))), None, None, None, None, True)


def _batch(out: pa.Schema, plan: pa.Array, *columns) -> pa.RecordBatch:
    n = len(plan)
    filled = [pa.nulls(n, f.type) if c is None else pa.array(np.full(n, c)) if isinstance(c, bool) else c for c, f in zip(columns, list(out)[1:], strict=True)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([plan, *filled], out, strict=True)], schema=out)


def _clashes(hurt, left, plan, low, start, own, edges, gone: _Gone, caps, lowest, most) -> dict[int, tuple[int, ...]]:
    """For every hurt plan the fewest, then least ids that can't hold together; sets `left` where the rounds must say.

    As in `domains`, ways start at fields whose bound is their own and lead over final bounds only; a way that isn't moved on by an
    excluded value comes first, then a short one.
    """
    u, v, by, edge = edges
    alone = gone.passed(np.arange(len(low)), start)
    told = start.copy()
    found = hurt[plan] & (low == alone)
    parent, via, size = np.full(len(low), -1, np.int64), np.full(len(low), -1, np.int64), 1 + alone - start
    new = found.copy()
    while new.any():
        e = np.flatnonzero(new[u] & ~found[v])
        tell = low[u[e]] + by[e]
        right = gone.passed(v[e], tell) == low[v[e]]
        e, tell = e[right], tell[right]
        moved, length = tell < low[v[e]], size[u[e]] + 1
        order = np.lexsort((length, moved, v[e]))
        e, tell, moved, length = e[order], tell[order], moved[order], length[order]
        best = _firsts(v[e])
        tie = ~_firsts(v[e], moved, length)
        tie[1:] &= best[:-1] | tie[:-1]
        left[plan[v[e][tie]]] = True
        e, tell, length = e[best], tell[best], length[best]
        new = np.zeros(len(low), bool)
        new[v[e]] = found[v[e]] = True
        parent[v[e]], via[v[e]], told[v[e]], size[v[e]] = u[e], edge[e], tell, length + low[v[e]] - tell
    broken = hurt[plan] & (low > lowest)
    left[plan[broken & ~found]] = True
    broken &= ~left[plan]

    _, place = gone.at(np.arange(len(low)), told)
    passes = low - told
    ends: dict[int, list[tuple[int, ...]]] = {}
    at, cap, id_ = caps
    hits = np.flatnonzero(broken[at])
    for f, i in zip(at[hits][cap[hits] < low[at[hits]]].tolist(), id_[hits][cap[hits] < low[at[hits]]].tolist(), strict=True):
        ends.setdefault(f, []).append((i,))
    for f in np.flatnonzero(broken & (low > most)).tolist():
        ends.setdefault(f, []).append(())
    best_of: dict[int, tuple[int, tuple[int, ...]]] = {}
    for f, last in ends.items():
        ids, x = set(), f
        while True:
            if passes[x]:
                ids.update(gone.id[place[x] : place[x] + passes[x]].tolist())
            if parent[x] < 0:
                if own[x] >= 0:
                    ids.add(int(own[x]))
                break
            ids.add(int(via[x]))
            x = parent[x]
        q = int(plan[f])
        for i in last:
            every = tuple(sorted(ids.union(i)))
            best_of[q] = min(best_of.get(q, (len(every), every)), (len(every), every))
    return {q: c for q, (_, c) in best_of.items()}
