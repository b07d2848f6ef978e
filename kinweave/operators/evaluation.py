"""How good a clustering is: Q-measure, adjusted Rand, mutual information, silhouette, term enrichment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.sources.shared import stored


def q_measure(clusters: DataFrame, reference: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """clusters (seq_id, cluster_idx null for orphans), reference (seq_id, functional_group) -> one row (q).

    Majority weights over all clusters less the orphans, per cent of all rows, kept within 0..100.
    """
    n = clusters.agg(F.count("*").alias("n"), F.sum(F.col("cluster_idx").isNull().cast("long")).alias("u"))
    rows = clusters.where("cluster_idx is not null").join(reference, "seq_id")
    if weights is not None:
        rows = rows.join(weights, "seq_id", "left").withColumn("w", F.coalesce("weight", F.lit(1.0)))
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    best = rows.groupBy("cluster_idx", "functional_group").agg(F.sum("w").alias("w")).groupBy("cluster_idx").agg(F.max("w").alias("w"))
    total = best.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("p"))
    q = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("p") - F.coalesce("u", F.lit(0))) / F.col("n") * 100.0))
    return n.join(F.broadcast(total)).select(F.when(F.col("n") > 0, q).otherwise(0.0).alias("q"))  # one row each


def label_pairs(sequences: DataFrame, clusters: DataFrame, reference: DataFrame) -> DataFrame:
    """(seq_id, truth, predicted); "unknown" without reference, "orphan" without cluster."""
    rows = sequences.select("seq_id").join(reference, "seq_id", "left").join(clusters.select("seq_id", "cluster_idx"), "seq_id", "left")
    return rows.select("seq_id", F.coalesce("functional_group", F.lit("unknown")).alias("truth"), F.coalesce(F.col("cluster_idx").cast("string"), F.lit("orphan")).alias("predicted"))


def _contingency(labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = labels.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    return cells, cells.groupBy("truth").agg(F.sum("n").alias("a")), cells.groupBy("predicted").agg(F.sum("n").alias("b"))


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """One row (ari); 1 where both partitions are trivial in the same way."""
    cells, t, p = _contingency(labels)
    pairs = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0.0))
    one = cells.agg(pairs("n").alias("both"), F.sum("n").alias("n")).join(F.broadcast(t.agg(pairs("a").alias("t")))).join(F.broadcast(p.agg(pairs("b").alias("p"))))
    total = F.col("n") * (F.col("n") - 1) / 2
    expected = F.when(total > 0, F.col("t") * F.col("p") / total).otherwise(0.0)
    most = (F.col("t") + F.col("p")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def mutual_information(labels: DataFrame) -> DataFrame:
    """One row (nmi), normalised by the mean of both entropies; 1 where both have one class, 0 without information."""
    cells, t, p = _contingency(labels)
    n = cells.agg(F.sum("n").alias("total"))
    joint = cells.join(t, "truth").join(p, "predicted").join(F.broadcast(n))
    mi = joint.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))).alias("mi"))
    h = lambda df, c: df.join(F.broadcast(n)).agg(F.sum(-F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total"))).alias(f"h{c}"))
    one = mi.join(F.broadcast(h(t, "a"))).join(F.broadcast(h(p, "b")))
    mean = (F.col("ha") + F.col("hb")) / 2
    return one.select(F.when(mean == 0, 1.0).when(F.col("mi") <= 0, 0.0).otherwise(F.col("mi") / mean).alias("nmi"))


def silhouette(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (seq_idx, predicted), edges (i, j, s) -> one row (silhouette); null under two labels or four rows.

    Distances are 1 - s, absent pairs at 1, so a row's distance to a cluster is
    the cluster's size less its summed similarities: no dense matrix is needed.
    """
    sides = edges.select(F.col("i").alias("a"), F.col("j").alias("b"), "s").unionAll(edges.select(F.col("j"), F.col("i"), "s"))
    near = sides.join(labels.select(F.col("seq_idx").alias("b"), "predicted"), "b").select("a", "predicted", "s")
    return silhouette_of_sums(labels, near)


def silhouette_of_sums(labels: DataFrame, near: DataFrame) -> DataFrame:
    """As `silhouette`, by parts (a, predicted, s) of the summed similarity of row a to the other rows of a cluster."""
    size = labels.groupBy("predicted").agg(F.count("*").alias("size"))
    near = near.groupBy("a", "predicted").agg(F.sum(F.col("s").cast("double")).alias("s"))
    own = labels.join(size, "predicted").select(F.col("seq_idx").alias("a"), F.col("predicted").alias("mine"), F.col("size").alias("own_size"))
    # clusters that share no edge with a row stand at distance 1; only the touched ones need a row
    rows = own.join(near, "a", "left").join(size, "predicted", "left")
    inner = F.max(F.when(F.col("predicted") == F.col("mine"), F.col("s")))
    outer = F.min(F.when(F.col("predicted") != F.col("mine"), (F.col("size") - F.col("s")) / F.col("size")))
    touched = F.sum((F.coalesce(F.col("predicted") != F.col("mine"), F.lit(False))).cast("long"))
    per = rows.groupBy("a", "mine", "own_size").agg(F.coalesce(inner, F.lit(0.0)).alias("inner"), outer.alias("outer"), touched.alias("touched"))
    counts = size.agg(F.count("*").alias("k"), F.sum("size").alias("n"))
    per = per.join(F.broadcast(counts))
    a = F.try_divide(F.col("own_size") - 1 - F.col("inner"), F.col("own_size") - 1)
    b = F.when(F.col("touched") < F.col("k") - 1, F.least(F.coalesce("outer", F.lit(1.0)), F.lit(1.0))).otherwise(F.col("outer"))
    value = F.when(F.col("own_size") == 1, 0.0).when(F.greatest("x", "y") == 0, 0.0).otherwise((F.col("y") - F.col("x")) / F.greatest("x", "y"))
    per = per.withColumn("x", a).withColumn("y", b).withColumn("v", value)
    return per.agg(F.when((F.max("k") >= 2) & (F.max("n") >= 4) & (F.max("k") < F.max("n")), F.avg("v")).alias("silhouette"))


#: Below this the error of Stirling's formula is looked up, from here on it is a series.
SMALL = 16
_ERRORS = [0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, SMALL)]


def _stirling_error(n: Column) -> Column:
    """ln n! less sqrt(2 pi n) (n / e)^n in logarithms."""
    square = n * n
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) / square) / square) / square) / n
    return F.when(n < SMALL, F.get(F.array(*[F.lit(x) for x in _ERRORS]), n.cast("int"))).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, without cancellation of the large parts."""
    d = (x - mean) / mean
    return mean * ((1 + d) * F.log1p(d) - d)


def _log_binomial(x: Column, m: Column, p: Column) -> Column:
    """Logarithm of the binomial probability of x among m, 0 < p < 1."""
    inner = _stirling_error(m) - _stirling_error(x) - _stirling_error(m - x) - _deviance(x, m * p) - _deviance(m - x, m * (1 - p)) + 0.5 * F.log(m / (2 * math.pi * x * (m - x)))
    return F.when(x <= 0, m * F.log1p(-p)).when(x >= m, m * F.log(p)).otherwise(inner)


def fisher_greater(k: str, n: str, big_k: str, big_n: str) -> Column:
    """Probability of k or more of big_k marked ones among n of big_n, as a column of built-in functions.

    The first term is a quotient of binomial probabilities, whose logarithms keep
    their digits at any count; the others follow by their ratios, going up where
    k lies over the mean, and down from below k, for the rest to one, where it
    does not. Terms fall like a normal curve's or faster: those more than ten
    deviations and fifty steps on are under 1e-16 of the sum and not formed.
    """
    k_, n_, a, all_ = (F.col(c).cast("double") for c in (k, n, big_k, big_n))
    share, mean = n_ / all_, n_ * a / all_
    rises = k_ > mean
    first = F.when(rises, k_).otherwise(k_ - 1)
    log = _log_binomial(first, a, share) + _log_binomial(n_ - first, all_ - a, share) - _log_binomial(n_, all_, share)
    least = F.greatest(F.lit(0.0), n_ + a - all_)
    deviation = F.sqrt(mean * (1 - a / all_) * (1 - share))
    steps = F.least(F.when(rises, F.least(n_, a) - k_).otherwise(first - least), F.ceil(10 * deviation + 50))
    up = lambda x: (a - x) * (n_ - x) / ((x + 1) * (all_ - a - n_ + x + 1))
    ratio = lambda j: F.when(rises, up(first + j)).otherwise(1 / up(first - j - 1))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * ratio(j.cast("double"))
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    terms = F.when(steps >= 1, F.sequence(F.lit(0), steps.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    total = F.exp(log) * F.aggregate(terms, start, step)["sum"]
    p = F.when(rises, total).otherwise(1 - total)
    return F.when(k_ <= least, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def enrichment(clusters: DataFrame, terms: DataFrame, alpha: float = 0.05) -> DataFrame:
    """clusters (seq_id, cluster_idx), terms (seq_id, go_terms) -> tests (cluster_idx, term, k, n, big_k, big_n, p, enriched).

    A term counts once a sequence. Benjamini-Hochberg within each cluster.
    """
    own = terms.select("seq_id", F.array_distinct("go_terms").alias("t")).where(F.size("t") > 0)
    per_seq = own.select("seq_id", F.explode("t").alias("term"))
    background = per_seq.groupBy("term").agg(F.count("*").alias("big_k"))
    total = own.agg(F.count("*").alias("big_n"))
    member = clusters.where("cluster_idx is not null").select("seq_id", "cluster_idx")
    sizes = member.join(own, "seq_id").groupBy("cluster_idx").agg(F.count("*").alias("n"))
    rows = member.join(per_seq, "seq_id").groupBy("cluster_idx", "term").agg(F.count("*").alias("k")).join(sizes, "cluster_idx").join(background, "term").join(F.broadcast(total))
    rows = rows.withColumn("p", fisher_greater("k", "n", "big_k", "big_n"))
    return benjamini_hochberg(rows, alpha)


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """tests (cluster_idx, term, p, ...) plus `enriched`: all up to the last rank whose p is within its share of alpha."""
    order, whole = W.partitionBy("cluster_idx").orderBy("p", "term"), W.partitionBy("cluster_idx")
    ranked = tests.withColumn("rank", F.row_number().over(order)).withColumn("m", F.count("*").over(whole))
    last = F.max(F.when(F.col("p") <= F.col("rank") / F.col("m") * alpha, F.col("rank"))).over(whole)
    return ranked.withColumn("enriched", F.coalesce(F.col("rank") <= last, F.lit(False))).drop("rank", "m")


def ancestors(edges: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """is_a edges (child, parent) -> (term, ancestor), all levels, of all terms or of `terms` (term) alone.

    `hop` holds the pairs that a path of 1, 2, 4, ... edges joins. Once it holds
    those of h edges, all paths under h are known, and each of them and h edges
    more give those under 2 h: in a tree every pair is made once, in its own
    round. It ends where no path is that long or, with a cycle, where nothing is
    new; a cycle's terms are ancestors of themselves. Rounds are kept in the
    shared folder.
    """
    hop = stored(edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")).distinct(), "hop")
    asked = lambda pairs: pairs if terms is None else pairs.join(terms.select("term").distinct().hint("merge"), "term", "left_semi")
    reach = asked(hop)
    if terms is not None:
        reach = stored(reach, "ancestors")
    n = reach.count()
    while True:
        hop = stored(_steps(hop, hop).distinct(), "hop")
        if hop.isEmpty():
            return reach
        reach = stored(reach.unionAll(asked(hop)).unionAll(_steps(reach, hop)).distinct(), "ancestors")
        before, n = n, reach.count()
        if n == before:
            return reach


def _steps(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs (term, ancestor) of x, each gone on by a pair of y."""
    far = y.select(F.col("term").alias("at"), F.col("ancestor").alias("next")).hint("merge")  # as many as terms: never broadcast
    return x.join(far, F.col("ancestor") == F.col("at")).select("term", F.col("next").alias("ancestor"))


def reduce_terms(enriched: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_idx, term) without terms that, by is_a edges (child, parent), are an ancestor of another of the cluster."""
    up = enriched.join(ancestors(edges, enriched).hint("merge"), "term").where("term <> ancestor").select("cluster_idx", F.col("ancestor").alias("term")).distinct()
    return enriched.join(up.hint("merge"), ["cluster_idx", "term"], "left_anti")


def cosim_histogram(cosim: DataFrame, at: float) -> DataFrame:
    """(is_cut, bin, n): each class in bins over its own range, int(2 sqrt n) of them but 15 to 60."""
    rows = cosim.withColumn("is_cut", F.col("cosim") <= at)
    span = rows.groupBy("is_cut").agg(F.min("cosim").alias("lo"), F.max("cosim").alias("hi"), F.count("*").alias("c"))
    bins = F.least(F.lit(60), F.greatest(F.lit(15), F.floor(2 * F.sqrt("c")))).cast("int")
    rows = rows.join(F.broadcast(span), "is_cut").withColumn("bins", bins)
    place = F.when(F.col("hi") == F.col("lo"), F.floor(F.col("bins") / 2)).otherwise(F.least(F.col("bins") - 1, F.floor((F.col("cosim") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins"))))
    return rows.groupBy("is_cut", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
