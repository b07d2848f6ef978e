"""From a tree to clusters: weights, co-similarity, thresholds, extraction, layouts.

Nodes have the columns node_id, parent_id, left_id, right_id, is_leaf,
branch_length, n_leaves, merge_similarity, the leaf range lo..hi and the place
post in post-order. Sums along paths and below nodes are running sums over one
walk around the tree, never recursion, and no node is copied to its leaves.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.sources.files import numbered
from kinweave.sources.shared import stored

CANDIDATES = 200


#: Leaf ranks of a block; sums run within blocks, and block totals are a row each.
BLOCK = 1 << 16


def _running(rows: DataFrame, order: list[str], values: list[str], last: int) -> DataFrame:
    """rows (rank up to last, ...) with each value replaced by its sum up to the row, in the order of rank and then `order`."""
    rows = rows.withColumn("block", F.floor(F.col("rank") / BLOCK))
    within = W.partitionBy("block").orderBy("rank", *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = [c for c in rows.columns if c not in values and c != "block"]
    if last < BLOCK:  # one block: nothing comes before it
        return rows.select(*kept, *[F.sum(v).over(within).alias(v) for v in values])
    sums = rows.groupBy("block").agg(*[F.sum(v).alias(f"all_{v}") for v in values])
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("block", *[F.coalesce(F.sum(f"all_{v}").over(before), F.lit(0)).alias(f"base_{v}") for v in values])
    rows = rows.join(F.broadcast(base), "block")  # a row for each BLOCK leaves
    return rows.select(*kept, *[(F.col(f"base_{v}") + F.sum(v).over(within)).alias(v) for v in values])


def _tour(nodes: DataFrame, path: dict[str, Column] | None = None, seen: dict[str, Column] | None = None) -> DataFrame:
    """(node_id, ...): sums along a walk around the tree that opens and closes each node once.

    `path` values are summed from the root down to the node itself; `seen` ones
    over all nodes opened up to it, and as <name>_end over those opened until
    it closes. No node is copied to what lies below it.
    """
    path, seen = path or {}, seen or {}
    names = [*path, *seen]
    opens = F.struct(F.col("lo").alias("rank"), F.lit(0).alias("side"), (-F.col("post")).alias("turn"), *[v.alias(c) for c, v in (path | seen).items()])
    zero = {c: -v for c, v in path.items()} | {c: v * 0 for c, v in seen.items()}
    closes = F.struct(F.col("hi").alias("rank"), F.lit(1).alias("side"), F.col("post").alias("turn"), *[v.alias(c) for c, v in zero.items()])
    rows = nodes.select("node_id", F.explode(F.array(opens, closes)).alias("e")).select("node_id", "e.*")
    rows = _running(rows, ["side", "turn"], names, nodes.agg(F.max("hi")).first()[0] or 0)
    at_open = [F.max(F.when(F.col("side") == 0, F.col(c))).alias(c) for c in names]
    at_end = [F.max(F.when(F.col("side") == 1, F.col(c))).alias(f"{c}_end") for c in seen]
    return rows.groupBy("node_id").agg(*at_open, *at_end)


def _large(rows: DataFrame) -> DataFrame:
    """Rows that grow with the tree: however small their files, they are joined by a merge and never go through the driver."""
    return rows.hint("merge")


def leaf_weights(nodes: DataFrame) -> DataFrame:
    """(node_id, weight) of leaves: branch lengths on the path from the root, each shared by the leaves below its parent."""
    parent = nodes.select(F.col("node_id").alias("pid"), F.col("n_leaves").alias("pn"))
    rows = nodes.join(_large(parent), nodes["parent_id"] == parent["pid"], "left")
    part = F.coalesce(F.col("branch_length") / F.col("pn"), F.lit(0.0))
    weights = _tour(rows, path={"weight": part})
    return nodes.where("is_leaf").select("node_id").join(_large(weights), "node_id")


def node_weights(nodes: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(node_id, weight) of all nodes: sum of the leaf weights below."""
    w = (leaf_weights(nodes) if weights is None else weights).select("node_id", F.col("weight").alias("own"))
    rows = nodes.join(_large(w), "node_id", "left").withColumn("own", F.when(F.col("is_leaf"), F.coalesce("own", F.lit(0.0))))
    sums = _tour(rows, path={"own": F.coalesce("own", F.lit(0.0))}, seen={"weight": F.coalesce("own", F.lit(0.0))})
    # from the opening on: what opens below; a leaf's own weight is on its path alone
    below = F.greatest(F.lit(0.0), F.col("weight_end") - F.col("weight") + F.col("own"))
    return sums.select("node_id", below.alias("weight"))


def depths(nodes: DataFrame) -> DataFrame:
    """(node_id, depth): the number of ancestors of each node."""
    return _tour(nodes, path={"depth": F.lit(1)}).select("node_id", (F.col("depth") - 1).cast("int").alias("depth"))


def cosimilarity(nodes: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(node_id, cosim) of inner nodes: harmonic-style product of the children's weights times their similarity."""
    w = node_weights(nodes) if weights is None else weights
    children = nodes.where("parent_id is not null").select("node_id", F.col("parent_id").alias("up")).join(_large(w), "node_id")
    pairs = children.groupBy("up").agg(F.sum("weight").alias("total"), (F.min("weight") * F.max("weight")).alias("product"))
    rows = nodes.where("not is_leaf and right_id is not null").join(_large(pairs), F.col("node_id") == F.col("up"))
    value = F.when((F.col("total") != 0) & F.col("merge_similarity").isNotNull(), F.col("product") / F.col("total") * F.col("merge_similarity"))
    return rows.select("node_id", F.coalesce(value, F.lit(0.0)).alias("cosim"))


def otsu(values: DataFrame, column: str = "cosim") -> float:
    """Of 200 even thresholds the least that separates two classes best.

    One pass sums the values between thresholds; only those 200 sums are looked at.
    """
    v = F.col(column)
    span = values.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n")).first()
    if not span["n"]:
        return 0.0
    lo, hi = span["lo"], span["hi"]
    if span["n"] < 2 or lo == hi:
        return float(lo)
    last = CANDIDATES - 1
    step = (hi - lo) / last
    limit = [lo + k * step for k in range(last)] + [hi]
    guess = F.greatest(F.lit(0), F.least(F.lit(last), F.ceil((v - lo) / step))).cast("int")
    edge = F.array(*[F.lit(float(x)) for x in limit])
    bin_ = F.when((guess > 0) & (v <= F.get(edge, guess - 1)), guess - 1).when(v > F.get(edge, guess), guess + 1).otherwise(guess)
    sums = {r["bin"]: (r["n"], r["s"]) for r in values.where(v.isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(v).alias("n"), F.sum(v).alias("s")).collect()}
    n, total = sum(x[0] for x in sums.values()), math.fsum(x[1] for x in sums.values())
    best, at, below, under = -1.0, float(lo), 0, 0.0
    for k in range(CANDIDATES):
        if k in sums:
            below, under = below + sums[k][0], under + sums[k][1]
            if 0 < below < n:
                var = below * (n - below) / n**2 * (under / below - (total - under) / (n - below)) ** 2
                if var > best * (1 + 1e-12):
                    best, at = var, limit[k]
    return float(at)


#: Curves closer than this are equally far above their diagonal.
TIE = 1e-12


#: Parts that a bin is cut into, a power of two.
PARTS = 64


def kneedle(values: DataFrame, column: str = "cosim") -> float:
    """The value where the sorted, scaled curve is farthest above its diagonal; under four values their median.

    Of equally far values the first counts. Exact, without an order of all
    values: counts by bins tell how far the least value of each bin is, and
    what no value of it can exceed. Only bins that can still hold the farthest
    value are cut again, each from its least to its largest value, until they
    hold one value each.
    """
    v = stored(values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), "values")
    span = v.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.median("v").alias("median")).first()
    n, lo, hi = span["n"], span["lo"], span["hi"]
    if n < 4:
        return float(span["median"] or 0.0)
    rise = lambda c: (F.col(c) - lo) / max(hi - lo, 1e-12)
    far = lambda c: rise(c) - F.col("before") / (n - 1)
    open_ = values.sparkSession.createDataFrame([(0, 0, lo, hi)], "bin long, before long, least double, most double")
    own, single, best = v.withColumn("bin", F.lit(0).cast("long")), None, -math.inf
    while True:
        width = F.col("most") - F.col("least")
        part = F.when(width > 0, F.floor((F.col("v") - F.col("least")) / width * (PARTS - 1))).otherwise(0).cast("long")
        # a bin's least and largest value fall in its first and last part, so every cut goes on
        own = own.join(open_, "bin").select("v", "before", (F.col("bin") * PARTS + F.greatest(F.lit(0), F.least(part, F.lit(PARTS - 1)))).alias("bin"))
        sums = own.groupBy("bin").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"), F.first("before").alias("base"))
        earlier = W.partitionBy(F.shiftright("bin", PARTS.bit_length() - 1)).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # PARTS rows at most
        bins = stored(sums.withColumn("before", F.col("base") + F.coalesce(F.sum("c").over(earlier), F.lit(0))), "bins")
        best = max(best, bins.agg(F.max(far("least"))).first()[0])
        done = bins.where((F.col("least") == F.col("most")) & (far("least") >= best - TIE)).select("least", "before")
        single = done if single is None else single.unionAll(done)
        rest = bins.where((F.col("least") < F.col("most")) & (far("most") >= best - TIE))
        if rest.isEmpty():
            break
        # bins are numbered anew, so that numbers stay small
        named = stored(rest.select(F.col("bin").alias("was"), F.monotonically_increasing_id().alias("bin"), "before", "least", "most"), "open")
        own = stored(own.select("v", F.col("bin").alias("was")).join(named.select("was", "bin"), "was").select("v", "bin"), "values")
        open_ = named.select("bin", "before", "least", "most")
    knee = single.where(far("least") >= best - TIE).agg(F.min_by("least", "before")).first()[0]
    return float(knee)


#: Narrow bins whose counts tell where quantiles lie, for the fits' starts alone.
BINS = 4096


def gmm(values: DataFrame, column: str = "cosim") -> float:
    """Where two fitted normal curves cross between their means; their midpoint if they do not, Otsu under six values.

    Expectation and maximisation over all values, an aggregate a step for all
    starts at once: the classes that Otsu's threshold makes and those below and
    above four quantiles. The likeliest fit counts.
    """
    known = stored(values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), "values")
    v = F.col("v")
    span = known.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    n, lo, hi = span["n"], span["lo"], span["hi"]
    at = otsu(known, "v")
    if n < 6 or lo == hi:
        return at
    place = F.floor((v - lo) / (hi - lo) * (BINS - 1))
    bins = known.groupBy(place.alias("b")).agg(F.count(v).alias("c"), F.max(v).alias("most")).orderBy("b").collect()  # a row a bin
    share = np.cumsum([r["c"] for r in bins]) / n
    edges = [at] + [bins[max(0, int(np.searchsorted(share, max(q, share[0]), "right")) - 1)]["most"] for q in (0.2, 0.4, 0.6, 0.8)]

    def sums(curves: dict) -> dict:
        """By start: masses, and first and second sums about the means so far, of both curves, and the mean log-likelihood."""
        out = []
        for s, (shares, means, total) in curves.items():
            for k in (0, 1):
                off = v - means[k]
                out += [F.sum(x).alias(f"{y}{k}_{s}") for x, y in ((shares[k], "m"), (shares[k] * off, "d"), (shares[k] * off * off, "q"))]
            out.append(F.avg(total).alias(f"l_{s}"))
        row = known.agg(*out).first()
        return {s: [[row[f"{y}{k}_{s}"] for y in "mdq"] for k in (0, 1)] + [row[f"l_{s}"]] for s in curves}

    def expected(curves: list) -> tuple:
        log = [F.lit(math.log(w) - math.log(d)) - 0.5 * ((v - m) / d) * ((v - m) / d) for m, d, w in curves]
        most = F.greatest(*log)
        total = most + F.log(F.exp(log[0] - most) + F.exp(log[1] - most))
        return [F.exp(x - total) for x in log], [m for m, _, _ in curves], total

    def fitted(own: list, means: list) -> list:
        mass = [own[k][0] + 1e-12 for k in (0, 1)]
        step = [own[k][1] / mass[k] for k in (0, 1)]
        # what the 1e-12 keeps back from the mean, as over values themselves
        mean = [means[k] * own[k][0] / mass[k] + step[k] for k in (0, 1)]
        var = [own[k][2] / mass[k] - 2 * (mean[k] - means[k]) * own[k][1] / mass[k] + (mean[k] - means[k]) ** 2 * own[k][0] / mass[k] for k in (0, 1)]
        return [(mean[k], math.sqrt(max(0.0, var[k]) + 1e-6), mass[k] / sum(mass)) for k in (0, 1)]

    middle = (lo + hi) / 2
    hard = {s: ([F.when(v <= e, 1.0).otherwise(0.0), F.when(v <= e, 0.0).otherwise(1.0)], [middle, middle], F.lit(0.0)) for s, e in enumerate(edges)}
    curves = {s: fitted(own, [middle, middle]) for s, own in sums(hard).items()}
    before, fits = dict.fromkeys(curves, -math.inf), {}
    for _ in range(200):
        for s, own in sums({s: expected(c) for s, c in curves.items()}).items():
            fits[s] = (own[2], sorted(curves[s]))
            if abs(own[2] - before[s]) < 1e-3:
                del curves[s]
            else:
                before[s], curves[s] = own[2], fitted(own, [m for m, _, _ in curves[s]])
        if not curves:
            break
    return crossing(*max((fits[s] for s in sorted(fits)), key=lambda fit: fit[0])[1])


def crossing(first: tuple[float, float, float], second: tuple[float, float, float]) -> float:
    """(mean, deviation, weight) of two normal curves -> their crossing between the means, else the midpoint."""
    (m1, s1, w1), (m2, s2, w2) = first, second
    a = 1 / s2**2 - 1 / s1**2
    b = 2 * (m1 / s1**2 - m2 / s2**2)
    c = m2**2 / s2**2 - m1**2 / s1**2 + 2 * math.log((w1 * s2) / (w2 * s1)) if w1 > 0 and w2 > 0 else math.nan
    roots = [-c / b] if abs(a) < 1e-12 and b else []
    if abs(a) >= 1e-12 and (d := b * b - 4 * a * c) >= 0:
        roots = [(-b + sign * math.sqrt(d)) / (2 * a) for sign in (1, -1)]
    return next((x for x in roots if m1 <= x <= m2), (m1 + m2) / 2)


METHODS = {"otsu": otsu, "gmm": gmm, "kneedle": kneedle}


def threshold(cosim: DataFrame, method: str = "otsu") -> float:
    """By a registered method; an unknown name means otsu."""
    return METHODS.get(method.lower(), otsu)(cosim)


def cut_nodes(cosim: DataFrame, at: float) -> DataFrame:
    return cosim.where(F.col("cosim") <= at).select("node_id")


def extract(nodes: DataFrame, cuts: DataFrame, min_size: int = 2, recover: bool = False) -> DataFrame:
    """(seq_id, cluster_idx, is_orphan, member): the clusters that cut nodes leave.

    A child of a cut node without a cut at or below it is a group; without any
    cut the whole tree is one. Groups under min_size are orphans. Leaves that no
    group holds are left out, as a clean child of an uncut node beside a cut one
    belongs to none; with recover=True such children are groups too.
    Clusters are numbered by their parents' post-order, left child first.
    """
    cut_ids = cuts.select(F.col("node_id").alias("c")).distinct()
    marked = nodes.join(_large(cut_ids), nodes["node_id"] == F.col("c"), "left").withColumn("is_cut", F.col("c").isNotNull())
    # cuts opened from the node on until it closes: those at or below it
    opened = F.col("is_cut").cast("long")
    cut_below = _tour(marked, seen={"cuts": opened}).select("node_id", "cuts", "cuts_end")
    marked = marked.join(_large(cut_below), "node_id").withColumn("dirty", F.col("cuts_end") - F.col("cuts") + opened > 0)
    clean = marked.where("not dirty")
    up = marked.select(
        F.col("node_id").alias("pid"),
        F.col("is_cut").alias("pcut"),
        F.col("post").alias("ppost"),
        F.col("left_id").alias("pleft"),
        F.col("dirty").alias("pdirty"),
    )
    under = clean.join(_large(up), clean["parent_id"] == up["pid"]).where(F.col("pcut") | (F.col("pdirty") & F.lit(recover)))
    shown = ["node_id", "lo", "hi", "n_leaves"]
    root = clean.where("parent_id is null").select(*shown, F.lit(0).cast("long").alias("ppost"), F.lit(0).alias("side"))
    side = (F.col("node_id") != F.col("pleft")).cast("int")
    groups = under.select(*shown, F.col("ppost").cast("long"), side.alias("side")).unionAll(root)
    good = groups.where(F.col("n_leaves") >= min_size).withColumn("turn", F.struct("ppost", "side"))
    good = numbered(good, "turn").withColumn("cluster_idx", F.col("seq_idx").cast("int"))
    groups = groups.join(good.select("node_id", "cluster_idx"), "node_id", "left")
    leaf = nodes.where("is_leaf").select("seq_id", F.col("lo").alias("rank"))
    member = F.row_number().over(W.partitionBy("node_id").orderBy(F.desc("rank"))) - 1
    # groups share no leaf, so this is a row a leaf
    rows = groups.withColumn("rank", F.explode(F.sequence("lo", "hi"))).join(leaf, "rank")
    return rows.select("seq_id", "cluster_idx", F.col("cluster_idx").isNull().alias("is_orphan"), member.alias("member"))


def unassigned(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    return nodes.where("is_leaf").select("seq_id").join(clusters.select("seq_id"), "seq_id", "left_anti")


def layout(nodes: DataFrame) -> DataFrame:
    """(node_id, x, rank): branch lengths summed from the root, the root's own included, and the leaf rank of leaves."""
    x = _tour(nodes, path={"x": F.coalesce("branch_length", F.lit(0.0))})
    return x.join(_large(nodes.select("node_id", F.when(F.col("is_leaf"), F.col("lo")).alias("rank"))), "node_id")


def heights(nodes: DataFrame) -> DataFrame:
    """(node_id, y): of leaves the leaf rank, of inner nodes the middle of their children, by tree contraction.

    The middle is affine in each child. Every round puts known children into
    their parents, and where one child is open and itself waits for one, that
    one takes its place: so a chain halves its way each round, and the rounds go
    with the logarithm of the nodes, whatever the tree's depth. A node of one
    child stands where that stands. Rounds are kept in the shared folder.
    """
    leaves = nodes.where("is_leaf").select("node_id", F.col("lo").cast("double").alias("y"))
    both = F.col("left_id").isNotNull() & F.col("right_id").isNotNull()
    none = F.lit(None).cast("long")
    # y = base + a * y(u) + b * y(w)
    waiting = nodes.where("not is_leaf").select(
        "node_id",
        F.lit(0.0).alias("base"),
        F.when(both, 0.5).otherwise(1.0).alias("a"),
        F.coalesce("left_id", "right_id").alias("u"),
        F.lit(0.5).alias("b"),
        F.when(both, F.col("right_id")).otherwise(none).alias("w"),
    )
    known = new = stored(leaves, "heights")
    waiting = stored(waiting, "waiting")
    while not waiting.isEmpty():
        for child, share in (("u", "a"), ("w", "b")):
            have = new.select(F.col("node_id").alias("had"), "y")
            waiting = waiting.join(_large(have), F.col(child) == F.col("had"), "left")
            base = F.col("base") + F.coalesce(F.col(share) * F.col("y"), F.lit(0.0))
            waiting = waiting.withColumn("base", base).withColumn(child, F.when(F.col("had").isNull(), F.col(child))).drop("had", "y")
        # one open child stands as u
        one = F.col("u").isNull() & F.col("w").isNotNull()
        waiting = waiting.select("node_id", "base", F.when(one, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(one, F.col("w")).otherwise(F.col("u")).alias("u"), "b", F.when(one, none).otherwise(F.col("w")).alias("w"))
        waiting = stored(waiting, "waiting")
        new = waiting.where("u is null").select("node_id", F.col("base").alias("y"))
        known = known.unionAll(new)
        waiting = waiting.where("u is not null")
        # where the one open child waits for one other, that one takes its place; what waits for known ones is filled next round
        hop = waiting.where("w is null").select(F.col("node_id").alias("mid"), F.col("base").alias("add"), F.col("a").alias("times"), F.col("u").alias("next"))
        waiting = waiting.join(_large(hop), (F.col("u") == F.col("mid")) & F.col("w").isNull(), "left")
        hopped = F.col("mid").isNotNull()
        waiting = waiting.select(
            "node_id",
            F.when(hopped, F.col("base") + F.col("a") * F.col("add")).otherwise(F.col("base")).alias("base"),
            F.when(hopped, F.col("a") * F.col("times")).otherwise(F.col("a")).alias("a"),
            F.when(hopped, F.col("next")).otherwise(F.col("u")).alias("u"),
            "b",
            "w",
        )
        waiting, new = stored(waiting, "waiting"), stored(known, "heights")
        known = new
    return known


def layout_points(nodes: DataFrame) -> DataFrame:
    """(node_id, x, y) of all nodes: summed branch lengths, and the height among the leaves."""
    return layout(nodes).select("node_id", "x").join(_large(heights(nodes)), "node_id")


def radial_layout(nodes: DataFrame) -> DataFrame:
    """(node_id, x, y) of all nodes on circles: angle by height among the leaves, radius by summed branch lengths."""
    n = nodes.where("is_leaf").count()
    angle = 2 * math.pi * F.col("y") / max(1, n)
    return layout_points(nodes).select("node_id", (F.col("x") * F.cos(angle)).alias("x"), (F.col("x") * F.sin(angle)).alias("y"))


def heatmap_order(clusters: DataFrame, sequences: DataFrame) -> DataFrame:
    """(seq_id, place): clusters by number, then orphans, then the rest in input order."""
    rows = sequences.join(clusters, "seq_id", "left")
    kind = F.when(F.col("cluster_idx").isNotNull(), 0).when(F.coalesce("is_orphan", F.lit(False)), 1).otherwise(2)
    rows = rows.select("seq_id", F.struct(kind.alias("kind"), "cluster_idx", "member", "seq_idx").alias("turn"))
    return numbered(rows, "turn").select("seq_id", F.col("seq_idx").cast("int").alias("place"))
