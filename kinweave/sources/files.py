"""Readers: FASTA, label tables, annotation dumps, lineages, disorder scores, ontologies, Newick."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.sources.shared import stored

ANNOTATION = "accession string, protein_name string, gene_name string, organism string, taxon_id long, reviewed boolean, go_terms array<string>, domains array<struct<interpro_id:string,name:string,start:int,end:int>>"


def _pieces(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """(place, value): the texts between marks, by file, block and order in it.

    Spark's text reader takes the mark for the end of a line, so large files are
    cut into blocks anywhere and a piece that crosses a border is read whole by
    the task of the block it begins in.
    """
    rows = spark.read.option("lineSep", mark).text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return rows.select(place.alias("place"), "value")


def fasta_chunks(chunks: DataFrame) -> DataFrame:
    """chunks (place, value, opens) -> (seq_idx, seq_id, seq).

    A chunk is what stands after a header's mark up to the next mark at the
    start of a line, in the order of place, which has to be settled (places that
    are counted anew may differ); `opens` tells the first chunk of a file, which is a record only behind a mark of its own. A header's first word
    is the id, the lines after it, without blanks at their ends, are the
    sequence in upper case. A repeated id keeps its first place and its last
    sequence. Text before the first header and headers without an id are left out.
    """
    # a mark counts behind blanks too, which the reader does not see
    rows = chunks.select("place", "opens", F.posexplode(F.split("value", r"\n[ \t]*>")).alias("k", "piece"))
    first = F.col("opens") & (F.col("k") == 0)
    rows = rows.where(~first | F.col("piece").rlike(r"^\s*>"))
    rows = rows.withColumn("piece", F.when(first, F.regexp_replace("piece", r"^\s*>", "")).otherwise(F.col("piece")))
    head = F.substring_index("piece", "\n", 1)
    body = F.substr("piece", F.length(head) + 2)
    plain = ~F.contains("body", F.lit(" ")) & ~F.contains("body", F.lit("\r"))
    rows = rows.select("place", "k", head.alias("head"), body.alias("body"))
    rows = rows.select(
        F.struct("place", "k").alias("at"),
        F.regexp_extract("head", r"^\s*(\S+)", 1).alias("seq_id"),
        F.upper(F.when(plain, F.replace("body", F.lit("\n"), F.lit(""))).otherwise(F.trim(F.regexp_replace("body", r" *\r*\n *| *\r+$", "")))).alias("seq"),
    )
    # ids are numbered without their sequences, which then move once
    ids = rows.where("seq_id <> ''").groupBy("seq_id").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    ids = numbered(ids, "first").select("seq_idx", F.col("last").alias("at")).hint("merge")  # as many as sequences: never broadcast
    return rows.where("seq_id <> ''").join(ids, "at").select("seq_idx", "seq_id", "seq")


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """Adds seq_idx, the 0-based place in the order of `by`, without gathering rows in one task.

    Rows are range-partitioned, sorted and written to the shared folder, so that
    what is counted and what is numbered are the same ranges; the counts of
    earlier partitions are added to the places within each.
    """
    rows = rows.repartitionByRange(F.col(by)).sortWithinPartitions(by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored(rows.withColumn("__part", F.spark_partition_id()).withColumn("__place", place), "numbered")
    sizes = rows.groupBy("__part").count()
    before = sizes.withColumn("__before", F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")  # a row a partition
    return rows.join(F.broadcast(before), "__part").withColumn("seq_idx", (F.col("__before") + F.col("__place")).cast("long")).drop("__part", "__place", "__before")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of one or more FASTA files of any size, in the order of file names and of records in each."""
    # kept, as another scan may cut the files otherwise
    chunks = stored(_pieces(spark, path, "\n>"), "fasta")
    opens = chunks.groupBy("place.file").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("opens"))  # a row a file
    return fasta_chunks(chunks.join(opens, "place", "left").withColumn("opens", F.coalesce("opens", F.lit(False))))


def label_lines(lines: DataFrame) -> DataFrame:
    """lines (line_no, line) -> (seq_id, functional_group): tab-separated, '#' comments, the last of repeated ids counts."""
    parts = F.split(F.trim("line"), "\t")
    rows = lines.where((F.trim("line") != "") & ~F.trim("line").startswith("#")).withColumn("p", parts).where(F.size("p") >= 2)
    rows = rows.select("line_no", F.trim(F.col("p")[0]).alias("seq_id"), F.trim(F.col("p")[1]).alias("functional_group"))
    return rows.groupBy("seq_id").agg(F.max_by("functional_group", "line_no").alias("functional_group"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of tables of any size; of repeated ids the last by file, block and line counts."""
    lines = _pieces(spark, path, "\n")
    return label_lines(lines.select(F.col("place").alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("line")))


PROTEIN_JSON = """entryType string, primaryAccession string,
proteinDescription struct<recommendedName:struct<fullName:struct<value:string>>>,
organism struct<scientificName:string,taxonId:long>, genes array<struct<geneName:struct<value:string>>>,
uniProtKBCrossReferences array<struct<database:string,id:string>>"""
DOMAIN_JSON = """results array<struct<metadata:struct<accession:string,name:string>,
proteins:array<struct<entry_protein_locations:array<struct<fragments:array<struct<start:int,`end`:int>>>>>>>>"""


def annotations(seq_ids: DataFrame, proteins: DataFrame, domains: DataFrame) -> DataFrame:
    """seq_ids (seq_id), landed service answers (accession, json) -> one annotation a sequence.

    Ids without accession, missing or unreadable answers give the stub: organism
    "Unknown", empty lists, nulls elsewhere.
    """
    from kinweave.functions.residues import accession

    p = proteins.select("accession", F.from_json("json", PROTEIN_JSON).alias("r"))
    refs = F.coalesce(F.col("r.uniProtKBCrossReferences"), F.array())
    p = p.where(F.col("r.primaryAccession").isNotNull()).select(
        "accession",
        F.coalesce("r.proteinDescription.recommendedName.fullName.value", F.lit("")).alias("protein_name"),
        F.coalesce(F.try_element_at("r.genes", F.lit(1))["geneName"]["value"], F.lit("")).alias("gene_name"),
        F.coalesce("r.organism.scientificName", F.lit("Unknown")).alias("organism"),
        F.col("r.organism.taxonId").alias("taxon_id"),
        F.coalesce(F.lower("r.entryType").contains("reviewed") & ~F.lower("r.entryType").contains("unreviewed"), F.lit(False)).alias("reviewed"),
        F.transform(F.filter(refs, lambda x: (x["database"] == "GO") & x["id"].isNotNull()), lambda x: x["id"]).alias("go_terms"),
    )
    d = domains.select("accession", F.explode(F.from_json("json", DOMAIN_JSON)["results"]).alias("e"))
    d = d.select("accession", "e.metadata", F.explode("e.proteins").alias("p")).select("accession", "metadata", F.explode("p.entry_protein_locations").alias("l"))
    d = d.select("accession", "metadata", F.explode("l.fragments").alias("f")).where("f.start is not null and f.`end` is not null")
    d = d.groupBy("accession").agg(F.array_sort(F.collect_list(F.struct(F.col("metadata.accession").alias("interpro_id"), F.col("metadata.name").alias("name"), F.col("f.start").alias("start"), F.col("f.end").alias("end")))).alias("domains"))
    out = seq_ids.select("seq_id").withColumn("accession", accession(F.col("seq_id"))).join(p, "accession", "left").join(d, "accession", "left")
    none = F.col("organism").isNull()
    return out.select(
        "seq_id",
        F.when(~none, F.col("accession")).alias("accession"),
        F.coalesce("protein_name", F.lit("")).alias("protein_name"),
        F.coalesce("gene_name", F.lit("")).alias("gene_name"),
        F.coalesce("organism", F.lit("Unknown")).alias("organism"),
        "taxon_id",
        F.coalesce("reviewed", F.lit(False)).alias("reviewed"),
        F.coalesce("go_terms", F.array().cast("array<string>")).alias("go_terms"),
        F.coalesce("domains", F.array().cast("array<struct<interpro_id:string,name:string,start:int,end:int>>")).alias("domains"),
    )


def ontology_terms(stanzas: DataFrame) -> DataFrame:
    """stanzas (value: text from a bracket at the start of a line to the next) -> (term, name, parents).

    Stanzas without an id are left out; a tag counts where it stands first in a line.
    """
    lines = F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, r"\r$", ""))
    tagged = lambda tag: F.transform(F.filter("lines", lambda x: x.startswith(tag)), lambda x: F.trim(F.substr(x, F.lit(len(tag) + 1))))
    rows = stanzas.select(lines.alias("lines"))
    rows = rows.select(
        F.try_element_at(tagged("id: "), F.lit(1)).alias("term"),
        F.try_element_at(tagged("name: "), F.lit(1)).alias("name"),
        F.transform(tagged("is_a: "), lambda x: F.regexp_extract(x, r"^(\S+)", 1)).alias("parents"),
    )
    return rows.where("term is not null")


def ontology_edges(terms: DataFrame) -> DataFrame:
    """is_a edges (child, parent)."""
    return terms.select(F.col("term").alias("child"), F.explode("parents").alias("parent")).distinct()


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """Terms of OBO files of any size: (term, name, parents)."""
    return ontology_terms(_pieces(spark, path, "\n["))


def cached(keys: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, keys that still have to be fetched)."""
    return keys.join(cache, key), keys.join(cache, key, "left_anti")


#: An annotation in the cache, by accession; of one that was fetched again the row of the largest version counts.
CACHED = ANNOTATION + ", status string, version long"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The annotation cache, the latest row of each accession; empty where none is written yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], CACHED)
    rows = spark.read.schema(CACHED).parquet(path)
    others = [c for c in rows.columns if c != "accession"]
    return rows.groupBy("accession").agg(F.max_by(F.struct(*others), "version").alias("r")).select("accession", "r.*").select(*rows.columns)


def annotate(seq_ids: DataFrame, answers: str, cache: str) -> DataFrame:
    """seq_ids (seq_id) -> annotations as `annotations` gives them, through a cache that keeps what was read before.

    Accessions that the cache holds are taken from it. Only the others, those
    that failed before among them, are looked up in the landed service answers,
    the tables `proteins` and `domains` under `answers` (accession, json), and
    added to the cache with their status (found or failed) in a folder of its
    own version. A run that broke off while adding leaves earlier versions as
    they are; the next one replaces the folder of the version it did not finish
    or, if its rows are whole, takes them as known. Ids without accession and
    failures give the stub.
    """
    from kinweave.functions.residues import accession

    spark = seq_ids.sparkSession
    ids = seq_ids.select("seq_id", accession(F.col("seq_id")).alias("accession"))
    known = read_cache(spark, cache)
    last = known.agg(F.max("version")).first()[0]
    misses = cached(ids.where("accession is not null").select("accession").distinct(), known.where("status = 'found'"), "accession")[1]
    keys = stored(misses.select(F.concat(F.lit("sp|"), "accession", F.lit("|")).alias("seq_id"), "accession"), "misses")
    if not keys.isEmpty():
        proteins, domains = (spark.read.parquet(f"{answers}/{t}") for t in ("proteins", "domains"))
        got = annotations(keys.select("seq_id"), proteins, domains)
        status = F.when(F.col("accession").isNotNull(), "found").otherwise("failed")
        got = got.withColumn("status", status).drop("accession").join(keys, "seq_id").withColumn("version", F.lit((last or 0) + 1).cast("long"))
        got.select(*[x.split()[0] for x in CACHED.split(", ")]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(cache)
        known = read_cache(spark, cache)
    found = F.col("status") == "found"
    empty = {"protein_name": F.lit(""), "gene_name": F.lit(""), "organism": F.lit("Unknown"), "reviewed": F.lit(False), "go_terms": F.array().cast("array<string>")}
    rows = ids.join(known, "accession", "left")
    own = [F.when(found, F.col(c)).otherwise(empty.get(c, F.lit(None))).alias(c) for c in ("accession", "protein_name", "gene_name", "organism", "taxon_id", "reviewed", "go_terms")]
    return rows.select("seq_id", *own, F.coalesce("domains", F.array().cast("array<struct<interpro_id:string,name:string,start:int,end:int>>")).alias("domains"))


def parse_newick(text: str) -> list[dict]:
    """Newick text -> node rows, ids in breadth-first order, children left to right.

    merge_similarity is one less twice the children's mean branch length, 0 at least.
    """
    text = text.strip().rstrip(";")
    nodes: list[dict] = []
    root: dict = {"children": [], "name": "", "length": 0.0, "parent": None}
    at, node, fresh = 0, root, True
    while at < len(text):
        c = text[at]
        if c == "(":
            child = {"children": [], "name": "", "length": 0.0, "parent": node}
            node["children"].append(child)
            node = child
            at += 1
        elif c == ",":
            child = {"children": [], "name": "", "length": 0.0, "parent": node["parent"]}
            node["parent"]["children"].append(child)
            node = child
            at += 1
        elif c == ")":
            node = node["parent"]
            at += 1
        elif c == "'":
            to = text.index("'", at + 1)
            node["name"], at = text[at + 1 : to], to + 1
        else:
            to = at
            while to < len(text) and text[to] not in "(),":
                to += 1
            name, _, length = text[at:to].partition(":")
            node["name"] = node["name"] or name.strip()
            node["length"] = float(length) if length.strip() else 0.0
            at = to
    queue = [root]
    for node in queue:
        node["id"] = len(nodes)
        nodes.append(node)
        queue.extend(node["children"])
    for node in reversed(nodes):
        node["n"] = sum(c["n"] for c in node["children"]) or 1
    rows = []
    for node in nodes:
        up, kids = node["parent"], node["children"]
        node["depth"] = up["depth"] + 1 if up else 0
        sim = max(0.0, 1.0 - 2.0 * sum(c["length"] for c in kids) / len(kids)) if kids else None
        rows.append({"node_id": node["id"], "parent_id": up["id"] if up else None, "left_id": kids[0]["id"] if kids else None, "right_id": kids[1]["id"] if len(kids) > 1 else None, "is_leaf": not kids, "seq_id": node["name"] if not kids else None, "branch_length": node["length"], "n_leaves": node["n"], "merge_similarity": sim, "depth": node["depth"]})
    return rows
