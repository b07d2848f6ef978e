"""Incremental job: the l-mer index of a growing collection of sequences.

    python -m jobs.lmer_index --config jobs/lmer_index.json --documents IN --output OUT --checkpoint DIR

IN is a Parquet table or folder to which files are added. Each run takes the
files that no run took before (a file stream that ends when all are taken, its
checkpoint under DIR) and adds their l-mer counts to `OUT/batch=.../head=...`
(Parquet; head is the l-mer's first residue). A document that comes again, in
another file or the same, counts once: ids that were seen are the stream's
state. Whoever plans a motif search reads the sums, `index(spark, OUT)`: l-mers
that very many sequences have are those whose joins are heavy.

Each micro-batch writes folders of its own number and replaces just these, so a
batch that broke off, in writing or after it, is written again and counted once.
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
COUNTS = "kmer string, n long, n_seqs long, batch long, head string"
STATE_STORES = {"rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "memory": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"}


@dataclass
class Settings:
    documents: str = ""
    output: str = ""
    #: Empty: under the output.
    checkpoint: str = ""
    min_len: int = prep.MIN_LEN
    l: int = sim.L
    files_a_batch: int = 1000
    #: At most, in each batch.
    files_a_head: int = 8
    state: str = "rocksdb"


def counts(docs: DataFrame, config: Settings) -> DataFrame:
    """documents (text) -> (kmer, n, n_seqs) of the valid sequences among them."""
    rows = prep.checked(docs.select(protein(F.col("text")).alias("seq")), config.min_len)
    # dropped ones are null and have no l-mers: a filter would move below and clean each text again
    return sim.lmer_counts(rows.select(F.when(F.col("reason").isNull(), F.col("seq")).alias("seq")), config.l)


def add_batch(batch: DataFrame, number: int, config: Settings) -> None:
    """Write one micro-batch's counts; the folders of this number are replaced, all others stay."""
    seen, made = Observation(), Observation()
    batch = batch.observe(seen, F.count("*").alias("rows"))
    rows = counts(batch, config).observe(made, F.count("*").alias("rows"))
    rows = rows.select("kmer", "n", "n_seqs", F.lit(number).cast("long").alias("batch"), F.substr("kmer", F.lit(1), F.lit(1)).alias("head"))
    at = f"{config.output.rstrip('/')}/counts"
    # a head's l-mers go into a few files, not into one for each task
    rows = rows.repartition("head", F.pmod(F.xxhash64("kmer"), F.lit(config.files_a_head)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "head").parquet(at)
    log.info("batch %d: %d new documents read, %d l-mers written to %s", number, seen.get["rows"], made.get["rows"], at)


def index(spark: SparkSession, output: str) -> DataFrame:
    """(kmer, n, n_seqs) over all batches so far."""
    rows = spark.read.schema(COUNTS).parquet(f"{output.rstrip('/')}/counts")
    return rows.groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("n_seqs").alias("n_seqs"))


def _pattern(path: str) -> str:
    """The path as a pattern that matches nothing else: file streams take single files only so."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, config: Settings) -> DataFrame:
    """Take what is new and return the whole index as it stands after it."""
    at = config.checkpoint or f"{config.output.rstrip('/')}/checkpoint"
    # the folder of counts is there even before the first document
    spark.createDataFrame([], COUNTS).write.mode("append").partitionBy("batch", "head").parquet(f"{config.output.rstrip('/')}/counts")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORES[config.state])
    try:
        schema = spark.read.parquet(config.documents).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_a_batch).parquet(_pattern(config.documents))
        stream = stream.select("doc_id", "text").dropDuplicates(["doc_id"])
        started = stream.writeStream.foreachBatch(lambda df, k: add_batch(df, k, config)).option("checkpointLocation", at).trigger(availableNow=True).start()
        started.awaitTermination()
    finally:
        spark.conf.set(name, before)
    log.info("read what was new in %s; checkpoint %s", config.documents, at)
    return index(spark, config.output)


def main(argv: list[str] | None = None) -> None:
    command("lmer-index", run, settings(Settings, argv, __doc__))


if __name__ == "__main__":
    main()
