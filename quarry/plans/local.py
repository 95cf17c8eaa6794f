"""Graphs small enough for one task: rows come sorted by group, and each batch of whole groups is worked on at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def by_group(rows: DataFrame, work: Callable[..., list], schema: str) -> DataFrame:
    """``work`` over the columns of whole groups; the first column is the group, by which the rows of a task are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.split() for f in schema.split(", ")]
        out = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if t == "int" else pa.int64()) for c, (_, t) in zip(work(*cols), fields)], [f for f, _ in fields])
        kept: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on in the next batch
            if cut:
                yield out([np.concatenate(c) for c in zip(*kept, [c[:cut] for c in cols])])
                kept = []
            elif kept and kept[0][0][0] != cols[0][0]:
                yield out([np.concatenate(c) for c in zip(*kept)])
                kept = []
            kept.append([c[cut:] for c in cols])
        if kept:
            yield out([np.concatenate(c) for c in zip(*kept)])

    return rows.mapInArrow(run, schema)


def _after(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """``b`` by ``a``: the starts of each one's slice, and the slices."""
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()


def _components(n: int, at: list[int], to: list[int]) -> list[list[int]]:
    """Strong components by Tarjan, without recursion; a component comes after all that it leads to."""
    index, low, on, nxt = [-1] * n, [0] * n, bytearray(n), at[:n]
    stack: list[int] = []
    out, k = [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        index[root] = low[root] = k
        k += 1
        path = [root]
        stack.append(root)
        on[root] = 1
        while path:
            v = path[-1]
            i = nxt[v]
            if i < at[v + 1]:
                nxt[v] = i + 1
                w = to[i]
                if index[w] < 0:
                    index[w] = low[w] = k
                    k += 1
                    path.append(w)
                    stack.append(w)
                    on[w] = 1
                elif on[w] and index[w] < low[v]:
                    low[v] = index[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == index[v]:
                own = []
                while True:
                    w = stack.pop()
                    on[w] = 0
                    own.append(w)
                    if w == v:
                        break
                out.append(own)
    return out


def strong(_: np.ndarray, src: np.ndarray, dest: np.ndarray) -> list:
    """``node, rep`` of the ends of the edges."""
    nodes, ids = np.unique(np.concatenate([src, dest]), return_inverse=True)
    a, b = ids[: len(src)], ids[len(src) :]
    reps = np.arange(len(nodes))
    for own in _components(len(nodes), *_after(a, b, len(nodes))):
        if len(own) > 1:
            reps[own] = min(own)
    return [nodes, nodes[reps]]


def weak(_: np.ndarray, src: np.ndarray, dest: np.ndarray) -> list:
    """``node, root``: the least node that each end is linked with by these edges."""
    nodes, ids = np.unique(np.concatenate([src, dest]), return_inverse=True)
    up = list(range(len(nodes)))
    for a, b in zip(ids[: len(src)].tolist(), ids[len(src) :].tolist()):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a < b:
            up[b] = a
        else:
            up[a] = b
    for v, u in enumerate(up):  # the way up leads to lesser nodes, which are done
        up[v] = up[u]
    return [nodes, nodes[up]]


def numbered(unions: bool) -> Callable[..., list]:
    """Value numbers, ``node, cls``: rows are edges, or (``own`` 1) nodes with a label of their own."""

    def run(comp: np.ndarray, src: np.ndarray, dest: np.ndarray, own: np.ndarray) -> list:
        nodes, ids = np.unique(np.concatenate([src, dest]), return_inverse=True)
        n, edge = len(nodes), own == 0
        a, b = ids[: len(src)], ids[len(src) :]
        fresh, place = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        fresh[a[~edge]] = True
        place[a], place[b] = comp, comp
        # Labels are counted within a component, so that a set is a number of few bits.
        by = np.argsort(place, kind="stable")
        bit = np.empty(n, dtype=np.int64)
        bit[by] = np.arange(n) - np.searchsorted(place[by], place[by])
        fresh, place, bit = fresh.tolist(), place.tolist(), bit.tolist()
        at, to = _after(b[edge], a[edge], n)  # predecessors
        keys, least, sets = [None] * n, {}, {}
        for own in _components(n, at, to):  # along predecessors, so they come first
            v = min(own)
            new = any(fresh[w] for w in own)
            came = {k for w in own for p in to[at[w] : at[w + 1]] if (k := keys[p]) is not None}
            if unions:
                key = 1 << bit[v] if new else 0
                for k in came:
                    key |= k
                key = key or None
            elif new:
                key = -1 - v
            else:  # a set of one inherited class is that class itself
                key = None if not came else came.pop() if len(came) == 1 else sets.setdefault(frozenset(came), len(sets))
            if key is not None:
                one = (place[v], key)
                least[one] = min(least.get(one, v), v)
                for w in own:
                    keys[w] = key
        cls = nodes[[0 if k is None else least[p, k] for p, k in zip(place, keys)]]
        return [nodes, np.where([k is None for k in keys], -1, cls)]

    return run
