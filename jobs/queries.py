"""The jobs as queries: each runs its function twice into one new folder and returns the output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import lmer_index, sequence_catalogue
from kinweave.queries import PROTEIN_SQL, SQL
from kinweave.sources.shared import new_folder


def job1_sequence_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = sequence_catalogue.Settings(f"{sf_dir}/documents.parquet", new_folder(spark, "job1"))
    sequence_catalogue.run(spark, config)
    return sequence_catalogue.run(spark, config).withColumn("weight", F.round(F.col("weight") + 1e-9, 6))


def job2_lmer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = lmer_index.Settings(f"{sf_dir}/documents.parquet", new_folder(spark, "job2"))
    lmer_index.run(spark, config)
    return lmer_index.run(spark, config)


JOB1_SQL = f"""WITH d AS (SELECT 'd' || coalesce(doc_id::VARCHAR, '?') AS seq_id, coalesce(nullif(trim(source), ''), 'Unknown') AS organism, coalesce(nullif(trim(lang), ''), 'unknown') AS lang, {PROTEIN_SQL} AS seq FROM documents),
c AS (SELECT *, row_number() OVER () AS row, CASE WHEN length(seq) < 10 THEN 'too short (' || length(seq) || ' aa; min=10)' END AS reason FROM d),
k AS (SELECT organism, count(*) AS c FROM c WHERE reason IS NULL GROUP BY 1),
w AS (SELECT organism, (SELECT sum(c) FROM k) / (c * (SELECT count(*) FROM k)) AS weight FROM k),
x AS (SELECT row, seq, unnest(range(1, length(seq) - 2)) AS p FROM c WHERE reason IS NULL),
n AS (SELECT row, count(DISTINCT seq[p:p + 3]) AS n FROM x WHERE NOT contains(seq[p:p + 3], 'X') GROUP BY 1),
m(aa, w) AS (VALUES ('A', 4), ('C', 9), ('D', 6), ('E', 5), ('F', 6), ('G', 6), ('H', 8), ('I', 4), ('K', 5), ('L', 4), ('M', 5), ('N', 6), ('P', 7), ('Q', 5), ('R', 5), ('S', 4), ('T', 5), ('V', 4), ('W', 11), ('Y', 7)),
s AS (SELECT row, sum(CASE WHEN reason IS NULL THEN (length(seq) - length(replace(seq, aa, ''))) * w END) AS score FROM c, m GROUP BY 1)
SELECT seq_id, c.organism, length(seq)::BIGINT AS n_residues, reason, CASE WHEN reason IS NULL THEN round(weight + 1e-9, 6) END AS weight,
  score::BIGINT AS self_score, CASE WHEN reason IS NULL THEN coalesce(n, 0) END AS n_lmers, CASE WHEN reason IS NULL THEN 'kept' ELSE 'dropped' END AS status, lang
FROM c LEFT JOIN w USING (organism) LEFT JOIN n USING (row) LEFT JOIN s USING (row)"""

QUERIES = {"job1_sequence_catalogue": job1_sequence_catalogue, "job2_lmer_index": job2_lmer_index}

#: Every text of ten residues or more has its l-mers in the index: the same counts as over all texts, but for shorter ones.
JOB_SQL = {"job1_sequence_catalogue": JOB1_SQL, "job2_lmer_index": SQL["lmer_counts"].replace("length(seq) >= 4", "length(seq) >= 10")}
