"""Hierarchical trees over a sparse similarity table.

Average linkage never joins a pair of similarity zero while a positive one is
left, so each connected component of the edges is a tree of its own and is built
in its own task. The components' merge lists, one row a merge, are then replayed
in global order, which gives node numbers as one builder over everything would.
Nodes carry the range [lo, hi] of leaf ranks below them, so that later steps
need no recursion.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.sources.shared import stored

NODES = "node_id long, parent_id long, left_id long, right_id long, is_leaf boolean, seq_id string, branch_length double, n_leaves long, merge_similarity double, depth int, lo long, hi long, post long, leaf_weight double"
MERGES = "component long, k long, a long, b long, s double"


def components(leaves: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, component): smallest leaf reachable over edges; each round takes labels two hops on."""
    sides = edges.where("s > 0").select(F.col("i").alias("a"), F.col("j").alias("b"))
    sides = stored(sides.unionAll(sides.select(F.col("b").alias("a"), F.col("a").alias("b"))), "sides")
    labels = leaves.select(F.col("seq_idx").alias("i"), F.col("seq_idx").alias("component"))
    while True:
        near = sides.join(labels, sides["b"] == labels["i"]).groupBy("a").agg(F.min("component").alias("m"))
        new = labels.join(near, labels["i"] == near["a"], "left").select("i", F.least("component", F.coalesce("m", "component")).alias("component"))
        up = new.select(F.col("i").alias("c"), F.col("component").alias("top"))
        new = new.join(up, new["component"] == up["c"], "left").select("i", F.least("component", "top").alias("component"))
        new = stored(new, "labels")
        changed = new.join(labels.withColumnRenamed("component", "old"), "i").where("component <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def average_linkage(pairs: dict[int, dict[int, float]]) -> list[tuple[int, int, float]]:
    """Merges (a, b, s) of one component; leaves by their numbers, merges numbered on from 2**40.

    Highest similarity first, ties by the smaller, then the larger node number.
    """
    near = {a: dict(v) for a, v in pairs.items()}
    size = dict.fromkeys(near, 1)
    heap = [(-s, a, b) for a, v in near.items() for b, s in v.items() if a < b]
    heapq.heapify(heap)
    out: list[tuple[int, int, float]] = []
    while heap:
        s, a, b = heapq.heappop(heap)
        if a not in near or b not in near:
            continue
        new = (1 << 40) + len(out)
        out.append((a, b, -s))
        left, right, n, m = near.pop(a), near.pop(b), size.pop(a), size.pop(b)
        own = {k: (n * left.get(k, 0.0) + m * right.get(k, 0.0)) / (n + m) for k in left.keys() | right.keys() if k not in (a, b)}
        for k, v in own.items():
            other = near[k]
            other.pop(a, None)
            other.pop(b, None)
            other[new] = v
            heapq.heappush(heap, (-v, k, new))
        near[new], size[new] = own, n + m
    return out


def _component_merges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    rows = edges.join(labels, edges["i"] == labels["i"]).select("component", edges["i"], "j", "s")

    def build(t: pa.Table) -> pa.Table:
        near: dict[int, dict[int, float]] = {}
        for i, j, s in zip(t.column("i").to_pylist(), t.column("j").to_pylist(), t.column("s").to_pylist(), strict=True):
            if s > 0:
                near.setdefault(i, {})[j] = float(s)
                near.setdefault(j, {})[i] = float(s)
        merges = average_linkage(near)
        c = t.column("component")[0].as_py()
        return pa.table({"component": [c] * len(merges), "k": list(range(len(merges))), "a": [m[0] for m in merges], "b": [m[1] for m in merges], "s": [float(m[2]) for m in merges]}, schema=pa.schema([("component", pa.int64()), ("k", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("s", pa.float64())]))

    return rows.groupBy("component").applyInArrow(build, MERGES)


def replay(n: int, merges: dict[int, list[tuple[int, int, float]]]) -> list[tuple[int, int, float]]:
    """Global merges over leaves 0..n-1: components' lists merged by (similarity down, node numbers up), then the roots in turn."""
    number: dict[tuple[int, int], int] = {}
    heap: list = []

    def push(c: int, k: int) -> None:
        if k < len(merges[c]):
            a, b, s = merges[c][k]
            a, b = (x if x < 1 << 40 else number[c, x - (1 << 40)] for x in (a, b))
            heapq.heappush(heap, (-s, min(a, b), max(a, b), c, k))

    for c in merges:
        push(c, 0)
    out: list[tuple[int, int, float]] = []
    roots = set(range(n))
    while heap:
        s, a, b, c, k = heapq.heappop(heap)
        new = n + len(out)
        number[c, k] = new
        out.append((a, b, -s))
        roots -= {a, b}
        roots.add(new)
        push(c, k + 1)
    rest = sorted(roots)
    at = 0
    while len(rest) - at > 1:
        out.append((rest[at], rest[at + 1], 0.0))
        rest.append(n + len(out) - 1)
        at += 2
    return out


#: Criteria closer than this are ties.
TIE = 1e-12


def neighbour_joining(s: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(a, b, similarity, branch of a, branch of b) of each join; of tied pairs the one of smallest node numbers.

    With u the mean distance of a node to the others, scaled by m - 2, the pair
    of least d - u - u' is joined. The matrix shrinks in place: the new node
    takes the row of one that it joins, the last row moves to the other's, and
    the rows' sums follow by what has changed. One leaf needs no join.
    """
    m = n = len(s)
    d = 1.0 - np.asarray(s, float)
    np.fill_diagonal(d, 0.0)
    node, total = np.arange(n), d.sum(axis=1)
    joins: list[tuple[int, int, float, float, float]] = []
    while m > 1:
        near, u = d[:m, :m], total[:m] / max(1, m - 2)
        if m > 2:
            score = near - (u[:, None] + u)
            score[np.diag_indices(m)] = np.inf
            x, y = np.nonzero(score <= score.min() + TIE)
            ids = np.sort(node[np.stack([x, y])], axis=0)
            best = np.lexsort((ids[1], ids[0]))[0]
            x, y = int(x[best]), int(y[best])
            lean = (u[x] - u[y]) / 2
        else:
            x, y, lean = 0, 1, 0.0
        if node[x] > node[y]:
            x, y, lean = y, x, -lean
        gap = float(d[x, y])
        arm = max(0.0, gap / 2 + lean)
        other = max(0.0, gap / 2) if m == 2 else max(0.0, gap - arm)
        joins.append((int(node[x]), int(node[y]), max(0.0, 1 - gap), arm, other))
        row = np.maximum(0.0, (d[x, :m] + d[y, :m] - gap) / 2)
        row[[x, y]] = 0.0
        total[:m] += row - d[x, :m] - d[y, :m]
        d[x, :m], d[:m, x], total[x], node[x] = row, row, row.sum(), n + len(joins) - 1
        m -= 1
        d[y, : m + 1], total[y], node[y] = d[m, : m + 1], total[m], node[m]
        d[: m + 1, y] = d[: m + 1, m]
        d[y, y] = 0.0
    return joins


def node_rows(names: list[str], merges: list[tuple[int, int, float, float, float]]) -> list[tuple]:
    """Rows of NODES from joins in order; leaf ranks go left first, leaf_weight is the weight of the path from the root."""
    n = len(names)
    total = n + len(merges)
    parent, left, right = [None] * total, [None] * total, [None] * total
    length, size, sim = [0.0] * total, [1] * total, [None] * total
    for k, (a, b, s, la, lb) in enumerate(merges):
        new = n + k
        parent[a] = parent[b] = new
        left[new], right[new], sim[new] = a, b, s
        length[a], length[b], size[new] = la, lb, size[a] + size[b]
    depth, lo, post, path = [0] * total, [0] * total, [0] * total, [0.0] * total
    for root in [x for x in range(total) if parent[x] is None]:
        stack, done = [root], 0
        while stack:
            x = stack.pop()
            up = parent[x]
            if up is not None:
                depth[x] = depth[up] + 1
                lo[x] = lo[up] if left[up] == x else lo[up] + size[left[up]]
                path[x] = path[up] + length[x] / size[up]
            if left[x] is not None:
                stack += [right[x], left[x]]
        stack2 = [(root, False)]
        while stack2:
            x, seen = stack2.pop()
            if seen or left[x] is None:
                post[x] = done
                done += 1
            else:
                stack2 += [(x, True), (right[x], False), (left[x], False)]
    return [(x, parent[x], left[x], right[x], x < n, names[x] if x < n else None, length[x], size[x], sim[x], depth[x], lo[x], lo[x] + size[x] - 1, post[x], path[x] if x < n else None) for x in range(total)]


def build_tree(sequences: DataFrame, edges: DataFrame, method: str = "upgma") -> DataFrame:
    """sequences (seq_idx 0..n-1, seq_id), edges (i, j, s) -> nodes. An unknown method means average linkage.

    Neighbour joining is one task over the dense matrix: its criterion needs all
    distances at every step. Average linkage needs a task a component, and one
    over the merges, a row each.
    """
    names = sequences.select("seq_idx", "seq_id")
    spark = sequences.sparkSession
    if method == "nj":
        kind = F.lit(0)
        rows = names.select(kind.alias("kind"), F.col("seq_idx").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("s"), "seq_id", F.lit(0).cast("long").alias("k"))
        rows = rows.unionAll(edges.select(F.lit(1), "i", "j", F.col("s").cast("double"), F.lit(None).cast("string"), F.lit(0).cast("long")))
    else:
        edges = stored(edges.select("i", "j", "s"), "edges")  # read by every round and by the merges
        merges = _component_merges(edges, components(names, edges))
        rows = names.select(F.lit(0).alias("kind"), F.col("seq_idx").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("s"), "seq_id", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
        rows = rows.unionAll(merges.select(F.lit(1), "a", "b", "s", F.lit(None).cast("string"), "k", F.col("component")))
    types = [pa.int64()] * 4 + [pa.bool_(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    columns = [x.split()[0] for x in NODES.split(", ")]

    def assemble(t: pa.Table) -> pa.Table:
        kind, a, b, s, k = (t.column(c).to_pylist() for c in ("kind", "a", "b", "s", "k"))
        ids = t.column("seq_id").to_pylist()
        leaf = sorted((a[x], ids[x]) for x in range(len(kind)) if kind[x] == 0)
        n = len(leaf)
        if method == "nj":
            m = np.zeros((n, n))
            np.fill_diagonal(m, 1.0)
            for x in range(len(kind)):
                if kind[x]:
                    m[a[x], b[x]] = m[b[x], a[x]] = s[x]
            joins = neighbour_joining(m)
        else:
            c = t.column("c").to_pylist()
            per: dict[int, list] = {}
            for x in sorted((x for x in range(len(kind)) if kind[x]), key=lambda x: (c[x], k[x])):
                per.setdefault(c[x], []).append((a[x], b[x], s[x]))
            joins = [(p, q, v, (1 - v) / 2, (1 - v) / 2) for p, q, v in replay(n, per)]
        rows_ = node_rows([name for _, name in leaf], joins)
        return pa.table([pa.array(col, ty) for col, ty in zip(zip(*rows_, strict=True), types, strict=True)], names=columns)

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(assemble, NODES)


def newick_pieces(nodes: DataFrame) -> DataFrame:
    """(at, piece): the pieces of the Newick text, in the order of `at`: what opens and what closes each node.

    A node's piece before it is the comma that parts it from its left neighbour
    and, of inner nodes, the bracket; the one after it the bracket or the name,
    and its length. No task holds the tree; line ends between pieces are blanks.
    """
    up = nodes.select(F.col("node_id").alias("pid"), F.col("right_id").alias("pright"))
    rows = nodes.join(up, nodes["parent_id"] == up["pid"], "left")
    comma = F.when(F.col("node_id") == F.col("pright"), ",").otherwise("")
    before = F.concat(comma, F.when(F.col("is_leaf"), "").otherwise("("))
    length = F.when(F.col("parent_id").isNull(), ";").otherwise(F.concat(F.lit(":"), F.format_string("%.6f", "branch_length")))
    after = F.concat(F.when(F.col("is_leaf"), F.col("seq_id")).otherwise(")"), length)
    turn = lambda rank, side, order, piece: F.struct(F.struct(F.col(rank).alias("rank"), F.lit(side).alias("side"), order.alias("turn")).alias("at"), piece.alias("piece"))
    both = F.array(turn("lo", 0, -F.col("post"), before), turn("hi", 1, F.col("post"), after))
    return rows.select(F.inline(both)).where("piece <> ''")


def newick(nodes: list[dict], support: dict[int, float] | None = None, end: str = ";") -> str:
    """Newick text of a node table's rows; branch lengths to six places, support as a rounded percentage."""
    by = {r["node_id"]: r for r in nodes}
    roots = [r for r in nodes if r["parent_id"] is None]
    out: dict[int, str] = {}
    for r in sorted(nodes, key=lambda r: r["post"]):
        tail = "" if r["parent_id"] is None else f":{r['branch_length']:.6f}"
        if r["is_leaf"]:
            out[r["node_id"]] = f"{r['seq_id']}{tail}"
        else:
            mark = f"{round(100 * support[r['node_id']])}" if support and r["node_id"] in support else ""
            out[r["node_id"]] = f"({out.pop(by[r['left_id']]['node_id'])},{out.pop(by[r['right_id']]['node_id'])}){mark}{tail}"
    return "".join(out[r["node_id"]] for r in roots) + end
