"""The whole run: sequences in, clusters and reports out; every stage a table under a folder named by its settings."""

from __future__ import annotations

import argparse
import hashlib
import json
import logging
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.residues import BLEND, DIAGONALS, register_matrix
from kinweave.operators import clusters as cl
from kinweave.operators import evaluation as ev
from kinweave.operators import prep, sinks
from kinweave.operators import similarity as sim
from kinweave.operators import tree as tr
from kinweave.sources import files
from kinweave.sources.shared import stored

log = logging.getLogger(__name__)
VERSION = "0.2.0"
#: Settings that name files or tables.
FILES = ("fasta", "embeddings", "idr_scores", "annotations", "answers", "lineages", "ontology", "reference")


@dataclass
class Config:
    fasta: str = ""
    out_dir: str = "output"
    min_len: int = 10
    mode: str = "sms"
    matrices: list[str] = field(default_factory=lambda: list(BLEND))
    matrix_weights: list[float] = field(default_factory=lambda: list(BLEND.values()))
    l: int = 4
    property_pass: bool = True
    property_alphabet: str = "murphy8"
    property_weight: float = 0.3
    embeddings: str = ""
    sms_weight: float = 0.5
    lcr_mask: bool = True
    mask_idr: bool = False
    idr_scores: str = ""
    lcr_k1: float = 1.8
    lcr_k2: float = 2.5
    idr_threshold: float = 0.5
    tree_method: str = "upgma"
    boundary: str = "otsu"
    min_size: int = 2
    recover_unassigned: bool = False
    annotate: bool = False
    annotations: str = ""
    answers: str = ""
    cache: str = ""
    interpro: bool = True
    taxon_phylo: bool = False
    lineages: str = ""
    ontology: str = ""
    reference: str = ""
    split_fasta: bool = False
    fasta_out: bool = True
    matrix_table: str = ""
    plot: bool = False
    plot_style: str = "rect"
    interactive: bool = True
    report_rows: int = 100_000
    heatmap_rows: int = 400
    resume: bool = False
    log_level: str = "INFO"


class Pipeline:
    """Stages as DataFrames; with a folder each stage is written there and, on resume, read again if its settings are the same."""

    def __init__(self, spark: SparkSession, config: Config):
        if wrong := missing(config):
            raise ValueError(wrong)
        self.spark, self.config = spark, config

    def _key(self, *names: str) -> str:
        own = {k: v for k, v in asdict(self.config).items() if k in names}
        own |= {f"{k} as it is": self._state(own[k]) for k in FILES if own.get(k)}
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()[:16]

    def _state(self, path: str) -> list:
        """Names, sizes and times of the files under a path: a stage of other contents is not the same stage."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = []
        for top in fs.globStatus(p) or []:
            inner = fs.listStatus(top.getPath()) if top.isDirectory() else [top]
            found += [(x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in inner]
        return sorted(found)

    def _stage(self, name: str, settings: tuple[str, ...], build) -> DataFrame:
        path = f"{self.config.out_dir}/checkpoints/{name}-{self._key(*settings)}"
        if not (self.config.resume and self._whole(path)):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _whole(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def run(self) -> dict:
        c, spark = self.config, self.spark
        base = ("fasta", "min_len")
        masked_by = (*base, "lcr_mask", "lcr_k1", "lcr_k2", "mask_idr", "idr_threshold", "idr_scores")
        scored_by = (*masked_by, "mode", "matrices", "matrix_weights", "l", "property_pass", "property_alphabet", "property_weight", "embeddings", "sms_weight", "annotate", "annotations", "answers", "interpro")
        tree_by = (*scored_by, "tree_method")
        parsed = self._stage("parsed", ("fasta",), lambda: files.read_fasta(spark, c.fasta))
        valid, dropped = prep.validate(parsed, c.min_len)
        sequences = self._stage("sequences", base, lambda: files.numbered(valid.withColumnRenamed("seq_idx", "at"), "at").select("seq_idx", "seq_id", "seq"))
        if not dropped.isEmpty():
            sinks.write_tsv(dropped, f"{c.out_dir}/dropped.tsv")
            for line in sinks.dropped_head(dropped):
                log.warning("dropped %s", line)

        def masked() -> DataFrame:
            out = prep.mask_low_complexity(sequences, 12, c.lcr_k1, c.lcr_k2) if c.lcr_mask else sequences
            return prep.mask_disordered(out, spark.read.parquet(c.idr_scores), c.idr_threshold) if c.mask_idr and c.idr_scores else out

        seqs = self._stage("masked", masked_by, masked)
        notes = None
        if c.annotate:
            cache = c.cache or f"{c.out_dir}/cache"
            notes = spark.read.parquet(c.annotations) if c.annotations else stored(files.annotate(sequences.select("seq_id"), c.answers, cache), "annotations")
        domains = None
        if notes is not None and c.interpro:
            domains = notes.where(F.size("domains") > 0).join(seqs.select("seq_id", "seq_idx"), "seq_id").select("seq_idx", F.explode("domains").alias("d")).select("seq_idx", "d.start", "d.end")
            domains = None if domains.isEmpty() else domains

        def edges() -> DataFrame:
            motif = sim.motif_similarity(seqs, dict(zip(c.matrices, c.matrix_weights, strict=True)), c.l, c.property_pass, c.property_weight, c.property_alphabet, domains) if c.mode != "esm2" else None
            if c.mode == "sms":
                return motif
            vectors = spark.read.parquet(c.embeddings).join(seqs.select("seq_id", "seq_idx"), "seq_id").select("seq_idx", "embedding")
            return sim.cosine_similarity(vectors) if c.mode == "esm2" else sim.blended_similarity(motif, vectors, c.sms_weight)

        pairs = self._stage("edges", scored_by, edges)
        nodes = self._stage("nodes", tree_by, lambda: tr.build_tree(seqs, pairs, c.tree_method))
        cosim = self._stage("cosim", tree_by, lambda: cl.cosimilarity(nodes, cl.node_weights(nodes, nodes.where("is_leaf").select("node_id", F.col("leaf_weight").alias("weight")))))
        at = cl.threshold(cosim, c.boundary) if not cosim.isEmpty() else 0.0
        found = self._stage("clusters", (*tree_by, "boundary", "min_size", "recover_unassigned"), lambda: cl.extract(nodes, cl.cut_nodes(cosim, at), c.min_size, c.recover_unassigned))
        metrics: dict = {"threshold": at, "n_unassigned": cl.unassigned(nodes, found).count()}
        weights = None
        if notes is not None:
            organisms = notes.select("seq_id", "organism")
            most = organisms.groupBy("organism").count().orderBy(F.desc("count"), "organism").first()
            if most:
                log.info("%d organisms; most sequences are of %s (%d)", organisms.select("organism").distinct().count(), *most)
            weights = prep.taxon_weights_phylogenetic(organisms, spark.read.parquet(c.lineages)) if c.taxon_phylo and c.lineages else prep.taxon_weights(organisms)
        if c.reference:
            labels = files.read_labels(spark, c.reference)
            metrics["q"] = ev.q_measure(found, labels, weights).first()[0]
            both = ev.label_pairs(seqs, found, labels)
            metrics |= {"ari": ev.adjusted_rand(both).first()[0], "nmi": ev.mutual_information(both).first()[0]}
            metrics["silhouette"] = ev.silhouette(both.join(seqs.select("seq_id", "seq_idx"), "seq_id").select("seq_idx", "predicted"), pairs).first()[0]
        terms: list[dict] = []
        if notes is not None:
            tests_ = ev.enrichment(found, notes.select("seq_id", "go_terms")).where("enriched")
            ontology = files.read_ontology(spark, c.ontology) if c.ontology else None
            if ontology is not None:
                kept = ev.reduce_terms(tests_.select("cluster_idx", "term"), files.ontology_edges(ontology))
                tests_ = tests_.join(kept, ["cluster_idx", "term"])
            tests = self._stage("terms", (*tree_by, "boundary", "min_size", "recover_unassigned", "ontology"), lambda: tests_)
            sinks.write_tsv(sinks.term_table(found, notes.select("seq_id", "go_terms"), tests, ontology), f"{c.out_dir}/go_terms.tsv")
            terms = [r.asDict() for r in tests.orderBy("cluster_idx", "p").limit(c.report_rows).collect()]
            metrics["n_terms"] = tests.count()
        self._write(sequences, found, nodes, pairs, cosim, at, notes, metrics, terms)
        return metrics

    def _write(self, sequences: DataFrame, found: DataFrame, nodes: DataFrame, pairs: DataFrame, cosim: DataFrame, at: float, notes: DataFrame | None, metrics: dict, terms: list[dict]) -> None:
        c, spark, out = self.config, self.spark, self.config.out_dir
        sinks.write_tsv(sinks.cluster_table(found, notes), f"{out}/clusters.tsv")
        sinks.write_tsv(sinks.orphan_table(found, notes), f"{out}/orphans.tsv")
        if c.fasta_out:
            sinks.write_fasta(sinks.fasta_records(found, sequences), out, c.split_fasta)
        info = sinks.summary(found, asdict(c) | {"version": VERSION}, metrics, c.report_rows)
        by_size = sinks.sizes(found).orderBy(F.desc("size"), "cluster_idx")
        sinks.write_tsv(by_size.select((F.col("cluster_idx") + 1).alias("cluster_id"), "size"), f"{out}/cluster_sizes.tsv")
        sinks.write_text(spark, f"{out}/summary.json", sinks.to_json(info))
        sinks.write_text(spark, f"{out}/metrics.json", sinks.to_json(info["metrics"]))
        rows = [r.asDict() for r in nodes.collect()]  # a tree file is one text; its builder held the same rows
        sinks.write_text(spark, f"{out}/tree.nwk", tr.newick(rows))
        charts = [sinks.bars_svg([tuple(r) for r in by_size.limit(30).collect()])]
        clustered = found.where("cluster_idx is not null").orderBy("cluster_idx", "member").select("cluster_idx", "seq_id")
        members = [tuple(r) for r in clustered.limit(c.report_rows).collect()]
        orphans = [r[0] for r in found.where("is_orphan").select("seq_id").orderBy("seq_id").limit(c.report_rows).collect()]
        page = sinks.report_html(info, members, orphans, terms, charts, metrics.get("n_terms"))
        sinks.write_text(spark, f"{out}/report.html", page)
        if c.plot:
            self._plot(sequences, found, rows, pairs, cosim, at, charts[0])

    def _plot(self, sequences: DataFrame, found: DataFrame, rows: list[dict], pairs: DataFrame, cosim: DataFrame, at: float, bars: str) -> None:
        c, spark, out = self.config, self.spark, self.config.out_dir
        order = cl.heatmap_order(found, sequences).where(F.col("place") < c.heatmap_rows).join(sequences.select("seq_id", "seq_idx"), "seq_id")
        shown = order.orderBy("place").select("seq_id", "seq_idx", "place").collect()  # heatmap_rows at most
        place = spark.createDataFrame([(r["seq_idx"], r["place"]) for r in shown], "x long, place int")
        first, second = place.toDF("i", "a"), place.toDF("j", "b")
        cells = pairs.join(F.broadcast(first), "i").join(F.broadcast(second), "j").select("a", "b", "s")
        heatmap = sinks.heatmap_svg([tuple(r) for r in cells.collect()], [r["seq_id"] for r in shown])
        if len(shown) < sum(r["is_leaf"] for r in rows):
            log.warning("the heatmap shows the first %d sequences", len(shown))
        pictures = {"sms_heatmap": heatmap, "cluster_sizes": bars}
        pictures["cosimilarity"] = sinks.histogram_svg([tuple(r) for r in ev.cosim_histogram(cosim, at).collect()])
        own = {r["seq_id"]: r["cluster_idx"] for r in found.select("seq_id", "cluster_idx").collect()}  # a row a leaf, as the tree
        few = len(own) <= 200
        if c.plot_style in ("rect", "both"):
            pictures["tree_plot"] = sinks.tree_svg(rows, own)
        if few:
            pictures["tree_plot_radial"] = sinks.tree_svg(rows, own, radial=True)
        elif c.plot_style != "rect":
            log.warning("a radial tree is drawn up to 200 sequences only")
        for name, svg in pictures.items():
            sinks.write_text(spark, f"{out}/{name}.svg", svg)
            if c.interactive:
                sinks.write_text(spark, f"{out}/{name}.html", f"<!DOCTYPE html><meta charset='utf-8'>{svg}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinweave", description=__doc__)
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--fasta", required=True)
    for name, kind, value in (("min-len", int, 10), ("l", int, 4), ("property-weight", float, 0.3), ("sms-weight", float, 0.5), ("lcr-k1", float, 1.8), ("lcr-k2", float, 2.5), ("idr-threshold", float, 0.5), ("min-size", int, 2), ("report-rows", int, 100_000), ("heatmap-rows", int, 400)):
        p.add_argument(f"--{name}", type=kind, default=value)
    for name, options in (("mode", ("sms", "esm2", "hybrid")), ("property-alphabet", ("murphy8", "murphy10")), ("tree-method", ("upgma", "nj")), ("boundary", ("otsu", "gmm", "kneedle")), ("plot-style", ("rect", "radial", "both"))):
        p.add_argument(f"--{name}", choices=options, default=options[0])
    p.add_argument("--matrix-table", default="", help="JSON file of further matrices: name to diagonal, by residue order")
    for name in ("embeddings", "idr-scores", "annotations", "answers", "cache", "lineages", "ontology", "reference"):
        p.add_argument(f"--{name}", default="", help="path of a table or file")
    p.add_argument("--out-dir", default="output")
    p.add_argument("--log-level", default="INFO")
    p.add_argument("--matrices", nargs="+", default=list(BLEND))
    p.add_argument("--matrix-weights", nargs="+", type=float, default=list(BLEND.values()))
    for name in ("mask-idr", "annotate", "taxon-phylo", "split-fasta", "plot", "resume", "recover-unassigned"):
        p.add_argument(f"--{name}", action="store_true")
    for name, target in (("no-property-pass", "property_pass"), ("no-lcr-mask", "lcr_mask"), ("no-interpro", "interpro"), ("no-fasta-out", "fasta_out"), ("no-interactive", "interactive")):
        p.add_argument(f"--{name}", dest=target, action="store_false")
    # tasks and partitions are Spark's own; these are taken and have no effect
    for name in ("n-jobs", "chunk-size"):
        p.add_argument(f"--{name}", type=int, help=argparse.SUPPRESS)
    p.add_argument("--esm-model", help=argparse.SUPPRESS)
    return p


def missing(config: Config) -> str | None:
    """What the settings ask for without the table it takes; nothing is left out or replaced silently."""
    c = config
    needs = [
        (c.annotate, "annotate", c.annotations or c.answers, "annotations or --answers"),
        (c.mask_idr, "mask-idr", c.idr_scores, "idr-scores"),
        (c.taxon_phylo, "taxon-phylo", c.lineages, "lineages"),
        (c.taxon_phylo, "taxon-phylo", c.annotate, "annotate"),
        (c.mode != "sms", f"mode {c.mode}", c.embeddings, "embeddings"),
    ]
    wrong = [f"--{flag} needs --{table}" for asked, flag, given, table in needs if asked and not given]
    if len(c.matrices) != len(c.matrix_weights):
        wrong.append("--matrices and --matrix-weights differ in number")
    unknown = [m for m in c.matrices if m not in DIAGONALS]
    if unknown:
        wrong.append(f"unknown matrices {unknown}; name them in --matrix-table")
    return "; ".join(wrong) or None


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    if args["matrix_table"]:
        with open(args["matrix_table"]) as file:
            for name, diagonal in json.load(file).items():
                register_matrix(name, diagonal)
    config = Config(**{k: v for k, v in args.items() if k in Config.__dataclass_fields__})
    if wrong := missing(config):
        parser().error(wrong)
    logging.basicConfig(level=config.log_level)
    spark = SparkSession.builder.appName("kinweave").getOrCreate()
    log.info("%s", Pipeline(spark, config).run())


if __name__ == "__main__":
    main()
