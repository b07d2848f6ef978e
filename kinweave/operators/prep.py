"""Validation and masking of sequences, and sequence weights by organism."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.functions.residues import AA_ORDER, MASK, letters

MIN_LEN = 10
WINDOW, K1, K2 = 12, 1.8, 2.5


def _reason(seq: Column, min_len: int) -> Column:
    odd = F.array_sort(F.array_distinct(F.filter(letters(seq), lambda c: F.position(c, F.lit(AA_ORDER + MASK)) == 0)))
    n = F.length(seq)
    short = F.concat(F.lit("too short ("), n.cast("string"), F.lit(f" aa; min={min_len})"))
    strange = F.concat(F.lit("invalid characters: ["), F.array_join(F.transform(odd, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "), F.lit("]"))
    return F.when(n < min_len, short).when(seq.rlike(f"[^{AA_ORDER}{MASK}]"), strange)


def checked(sequences: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """sequences plus `reason`, null for valid ones: length first, then residues outside the 20 and the mask."""
    return sequences.withColumn("reason", _reason(F.coalesce("seq", F.lit("")), min_len))


def validate(sequences: DataFrame, min_len: int = MIN_LEN) -> tuple[DataFrame, DataFrame]:
    """(valid sequences, dropped (seq_id, reason)), as `checked` tells them apart."""
    rows = checked(sequences, min_len)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("seq_id", "reason")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of a string's letters; 0 for none."""
    n = F.length(text)
    p = F.transform(F.array_distinct(letters(text)), lambda c: (n - F.length(F.replace(text, c))) / n)
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log2(x))


def entropy_windows(sequences: DataFrame, window: int = WINDOW) -> DataFrame:
    """(seq_idx, pos, h): entropy of each full window by its 0-based start."""
    rows = sequences.select("seq_idx", letters(F.col("seq")).alias("s")).where(F.size("s") >= window)
    pieces = F.transform(F.sequence(F.lit(1), F.size("s") - window + 1), lambda i: F.array_join(F.slice("s", i, window), ""))
    rows = rows.select("seq_idx", F.posexplode(pieces).alias("pos", "w"))
    return rows.select("seq_idx", "pos", entropy(F.col("w")).alias("h"))


def trigger_runs(sequences: DataFrame, window: int = WINDOW, k1: float = K1) -> DataFrame:
    """(seq_idx, start, end): runs of positions within windows of entropy below k1, both ends included."""
    low = entropy_windows(sequences, window).where(F.col("h") < k1)
    order = W.partitionBy("seq_idx").orderBy("pos")
    new = F.coalesce((F.col("pos") > F.lag("pos").over(order) + window).cast("int"), F.lit(1))
    runs = low.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("seq_idx", "run").agg(F.min("pos").alias("start"), (F.max("pos") + window - 1).alias("end")).select("seq_idx", "start", "end")


def mask_string(seq: str, window: int = WINDOW, k1: float = K1, k2: float = K2, mask: str = MASK) -> str:
    """One sequence with low-complexity regions masked; window entropies come from running letter counts."""
    n = len(seq)
    if not n:
        return seq
    codes = np.unique(np.frombuffer(seq.encode("utf-32-le"), np.uint32), return_inverse=True)[1]
    grid = np.zeros((n + 1, codes.max() + 1), np.int32)
    grid[np.arange(1, n + 1), codes] = 1
    grid = np.cumsum(grid, axis=0)
    w = min(n, window)
    counts = grid[w:] - grid[:-w]
    logs = np.arange(w + 1) * np.log2(np.maximum(1, np.arange(w + 1)))
    h = np.log2(w) - logs[counts].sum(axis=1) / w
    if n < window:
        return mask * n if h[0] < k1 else seq
    low = np.flatnonzero(h < k1)
    if not len(low):
        return seq
    hit = np.zeros(n + 1, np.int32)
    np.add.at(hit, low, 1)
    np.add.at(hit, low + w, -1)
    hit = np.cumsum(hit[:n]) > 0
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    place = np.arange(n)
    may_left = np.zeros(n, bool)  # the full window before the place is low
    may_left[w:] = h[: n - w] < k2
    may_right = np.zeros(n, bool)
    may_right[: n - w] = h[1:] < k2
    stop_left = np.maximum.accumulate(np.where(~may_left, place, -1))
    stop_right = np.minimum.accumulate(np.where(~may_right, place, n)[::-1])[::-1]
    out = hit.copy()
    for start, end in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True):
        out[stop_left[start] : start] = True
        out[end + 1 : stop_right[end] + 1] = True
    chars = np.array(list(seq))
    chars[out] = mask
    return "".join(chars)


def mask_low_complexity(sequences: DataFrame, window: int = WINDOW, k1: float = K1, k2: float = K2) -> DataFrame:
    """`seq` with low-complexity regions masked."""

    @F.pandas_udf("string")
    def masked(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else mask_string(x, window, k1, k2))

    return sequences.withColumn("seq", masked("seq"))


def mask_stats(sequences: DataFrame) -> DataFrame:
    """One row: residues, masked residues and their percentage."""
    n, x = F.sum(F.length("seq")), F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(MASK))))
    return sequences.agg(n.alias("total"), x.alias("masked")).withColumn("percent", F.when(F.col("total") > 0, 100.0 * F.col("masked") / F.col("total")).otherwise(0.0))


def disorder_key(seq: Column, threshold: float) -> Column:
    return F.sha2(F.concat_ws("_", seq, F.lit(str(threshold))), 256)


def mask_disordered(sequences: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mask residues with a score over the threshold; scores (seq_hash, scores), no scores leave the sequence."""
    rows = sequences.withColumn("seq_hash", disorder_key(F.col("seq"), threshold)).join(scores, "seq_hash", "left")
    chars = F.transform(letters(F.col("seq")), lambda c, k: F.when(F.coalesce(F.get("scores", k) > threshold, F.lit(False)), MASK).otherwise(c))
    return rows.withColumn("seq", F.when(F.col("scores").isNull(), F.col("seq")).otherwise(F.array_join(chars, ""))).drop("seq_hash", "scores")


def organism_weights(organisms: DataFrame) -> DataFrame:
    """(organism) a row a sequence -> (organism, n_sequences, weight of each of them): inverse frequency, over all sequences their number."""
    per = organisms.groupBy("organism").agg(F.count("*").alias("n_sequences"))
    n = per.agg(F.sum("n_sequences").alias("n"), F.count("*").alias("k"))
    weight = F.col("n") / (F.col("n_sequences") * F.col("k"))
    return per.join(F.broadcast(n)).select("organism", "n_sequences", weight.alias("weight"))  # n is one row


def taxon_weights(organisms: DataFrame) -> DataFrame:
    """(seq_id, organism) -> (seq_id, weight): inverse organism frequency, summing to the number of sequences."""
    rows = organisms.withColumn("organism", F.coalesce("organism", F.lit("Unknown")))
    return rows.join(organism_weights(rows), "organism").select("seq_id", "weight")


def taxon_weights_phylogenetic(organisms: DataFrame, lineages: DataFrame) -> DataFrame:
    """Weights by mean lineage overlap with all other sequences: 1 / (1 + overlap), summing to their number.

    Two organisms overlap by the taxa they share over the longer lineage. No two
    organisms meet: sequences are counted by taxon and lineage length, and what
    a taxon adds for an organism is a running sum over the lengths up to its
    own, each counted by its own length, and one over the longer ones.
    """
    rows = organisms.withColumn("organism", F.coalesce("organism", F.lit("Unknown")))
    per = rows.groupBy("organism").agg(F.count("*").alias("c")).join(lineages, "organism", "left")
    per = per.withColumn("taxa", F.array_distinct(F.coalesce("lineage", F.array().cast("array<string>"))))
    taxa = per.select("organism", "c", F.size("taxa").alias("k"), F.explode("taxa").alias("taxon"))
    held = taxa.groupBy("taxon", "k").agg(F.sum("c").alias("held"))
    upto, over = W.partitionBy("taxon").orderBy("k"), W.partitionBy("taxon").orderBy("k").rowsBetween(1, W.unboundedFollowing)  # a row a length
    share = F.sum("held").over(upto) / F.col("k") + F.coalesce(F.sum(F.col("held") / F.col("k")).over(over), F.lit(0.0))
    shared = taxa.join(held.select("taxon", "k", share.alias("share")), ["taxon", "k"]).groupBy("organism").agg((F.sum("share") - 1).alias("s"))  # itself, once
    n = per.agg(F.sum("c").alias("n"))
    raw = per.join(shared, "organism", "left").join(F.broadcast(n)).withColumn("raw", 1 / (1 + F.coalesce(F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)), F.lit(0.0))))
    total = raw.agg(F.sum(F.col("raw") * F.col("c")).alias("t"))
    weights = raw.join(F.broadcast(total)).select("organism", (F.col("raw") * F.col("n") / F.col("t")).alias("weight"))
    return rows.join(weights, "organism").select("seq_id", "weight")
