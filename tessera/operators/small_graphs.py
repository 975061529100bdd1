"""Cycles of graphs that fit in a task: edges (key, project_id, src, dst) of some whole projects, as one Arrow table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Nodes of all projects as integers in order of project and value: sources, targets, for each node a row of its project, the values and each node's value."""
    project = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    ends = pa.concat_arrays([table.column(c).combine_chunks() for c in ("src", "dst")])
    values = ends.unique()
    values = values.take(pc.sort_indices(values))
    code = pc.index_in(ends, values).to_numpy().astype(np.int64) + np.tile(project, 2) * len(values)
    nodes, at, code = np.unique(code, return_index=True, return_inverse=True)
    return code[: len(project)], code[len(project) :], at % len(project), values, nodes % len(values)


def neighbours(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, list[int]]:
    """For each of n nodes where its neighbours begin, and all neighbours in order."""
    order = np.lexsort((b, a))
    return np.searchsorted(a[order], np.arange(n + 1)), b[order].tolist()


def strong(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each node the smallest node of its strongly connected component: one walk, depth first, without recursion."""
    begin, to = neighbours(a, b, n)
    begin = begin.tolist()
    seen, low, out = [0] * n, [0] * n, [-1] * n
    count, path = 0, []
    for start in range(n):
        if seen[start]:
            continue
        count += 1
        seen[start] = low[start] = count
        path.append(start)
        todo = [(start, begin[start])]
        while todo:
            node, k = todo[-1]
            if k < begin[node + 1]:
                todo[-1] = (node, k + 1)
                other = to[k]
                if not seen[other]:
                    count += 1
                    seen[other] = low[other] = count
                    path.append(other)
                    todo.append((other, begin[other]))
                elif out[other] < 0:
                    low[node] = min(low[node], seen[other])
                continue
            todo.pop()
            if todo:
                low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
            if low[node] == seen[node]:
                members = []
                while not members or members[-1] != node:
                    members.append(path.pop())
                least = min(members)
                for m in members:
                    out[m] = least
    return np.array(out, np.int64)


def components(table: pa.Table) -> pa.Table:
    """Components of two nodes or more: (project_id, node, component)."""
    a, b, row, values, value = numbered(table)
    label = strong(a, b, len(row))
    large = np.flatnonzero(np.bincount(label, minlength=len(row))[label] > 1) if len(row) else np.zeros(0, np.int64)
    columns = [table.column("project_id").take(row[large]), values.take(value[large]), values.take(value[label[large]])]
    return pa.table(columns, names=["project_id", "node", "component"])


def shortest_cycles(table: pa.Table) -> pa.Table:
    """For each component the shortest cycle through its smallest node, of several the first in order of its nodes: (project_id, component, nodes), the first one at both ends."""
    a, b, row, values, value = numbered(table)
    label = strong(a, b, len(row))
    inner = (label[a] == label[b]) & (a != b)
    a, b = a[inner], b[inner]
    ahead, to = neighbours(a, b, len(row))
    behind, of = neighbours(b, a, len(row))
    starts, paths = np.unique(label[a]).tolist(), []
    for start in starts:
        # how far each node is from the start, backwards, until a node behind the start is met
        away, front, step, first = {start: 0}, [start], 0, to[ahead[start] : ahead[start + 1]]
        while not (met := [x for x in first if x in away]):
            step += 1
            front = list({x for y in front for x in of[behind[y] : behind[y + 1]] if x not in away})
            away.update(dict.fromkeys(front, step))
        node, path = min(met), [start]
        while node != start:
            path.append(node)
            node = min(x for x in to[ahead[node] : ahead[node + 1]] if away.get(x, -1) == away[node] - 1)
        paths.append([*path, start])
    flat = np.array([x for p in paths for x in p], np.int64)
    nodes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, paths)]), pa.int32()), values.take(value[flat]))
    at = np.array(starts, np.int64)
    return pa.table([table.column("project_id").take(row[at]), values.take(value[at]), nodes], names=["project_id", "component", "nodes"])
