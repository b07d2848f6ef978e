"""Batch job: from raw documents to a catalogue of sequences, ready for clustering.

    python -m jobs.sequence_catalogue --config jobs/sequence_catalogue.json --documents IN --output OUT

Each document is one sequence, the residue projection of its whole text, its
source the organism. Written under OUT, as Parquet:

* `sequences/status=kept|dropped/lang=...`: a row a document, with the reason for
  dropping or, of kept ones, the weight of the organism, the self-score by the
  matrix (what normalises similarities) and the number of distinct l-mers;
* `organisms`: kept sequences, residues and weight by organism.

A run replaces both, so that running again over the same documents gives the
same output, and over others theirs; a run that broke off is mended by the next.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.settings import command, settings
from kinweave.functions.residues import protein
from kinweave.operators import prep
from kinweave.operators import similarity as sim

log = logging.getLogger(__name__)
SEQUENCES = "seq_id string, organism string, n_residues long, reason string, weight double, self_score long, n_lmers long, status string, lang string"


@dataclass
class Settings:
    documents: str = ""
    output: str = ""
    min_len: int = prep.MIN_LEN
    l: int = sim.L
    matrix: str = "BLOSUM62"


def measured(docs: DataFrame, config: Settings) -> DataFrame:
    """documents (doc_id, text, lang, source) -> a row each, without weights; null or empty sources are Unknown, languages unknown, texts empty."""
    named = lambda c, none: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(none))
    rows = docs.select(
        F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias("seq_id"),
        named("source", "Unknown").alias("organism"),
        named("lang", "unknown").alias("lang"),
        protein(F.col("text")).alias("seq"),
    )
    rows = prep.checked(rows, config.min_len)
    kept = F.col("reason").isNull()
    rows = rows.withColumn("of", sim.measures(F.col("seq"), config.matrix, config.l))
    return rows.select(
        "seq_id",
        "organism",
        F.length("seq").cast("long").alias("n_residues"),
        "reason",
        F.when(kept, F.col("of.weight")).alias("self_score"),
        F.when(kept, F.col("of.n_lmers")).alias("n_lmers"),
        F.when(kept, "kept").otherwise("dropped").alias("status"),
        "lang",
    )


def weighed(rows: DataFrame) -> DataFrame:
    """The measured rows with the weight of the organism of kept ones."""
    weights = prep.organism_weights(rows.where("status = 'kept'").select("organism")).select("organism", "weight")
    rows = rows.join(weights, "organism", "left").withColumn("weight", F.when(F.col("status") == "kept", F.col("weight")))
    return rows.select(*[c.split()[0] for c in SEQUENCES.split(", ")])


def run(spark: SparkSession, config: Settings) -> DataFrame:
    """Write both tables and return the sequences, read back."""
    at = f"{config.output.rstrip('/')}/sequences"
    seen = Observation()
    # weights need all rows counted first: these are kept, without texts, so that each text is read and cleaned once
    held = measured(spark.read.parquet(config.documents), config).persist()
    rows = weighed(held).observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum("n_residues"), F.lit(0)).alias("residues"), F.count_if(F.col("status") == "kept").alias("kept"))
    try:
        held.count()  # all are held before several stages at once ask for them
        # partitions of any weight are cut into even files
        rows.hint("rebalance", "status", "lang").write.mode("overwrite").partitionBy("status", "lang").parquet(at)
    finally:
        held.unpersist()
    log.info("read %s: %d documents, %d residues", config.documents, seen.get["rows"], seen.get["residues"])
    log.info("wrote %s: %d sequences kept, %d dropped", at, seen.get["kept"], seen.get["rows"] - seen.get["kept"])
    out = spark.read.schema(SEQUENCES).parquet(at)
    organisms = out.where("status = 'kept'").groupBy("organism").agg(
        F.count("*").alias("n_sequences"), F.sum("n_residues").alias("n_residues"), F.max("weight").alias("weight")
    )
    organisms.write.mode("overwrite").parquet(f"{config.output.rstrip('/')}/organisms")
    log.info("wrote %s/organisms", config.output.rstrip("/"))
    return out


def main(argv: list[str] | None = None) -> None:
    command("sequence-catalogue", run, settings(Settings, argv, __doc__))


if __name__ == "__main__":
    main()
