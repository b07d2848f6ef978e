"""Writers of tables, FASTA, Newick, summaries, reports and charts.

Tables that grow with the input are written by Spark; only summaries of bounded
size reach the driver. Charts are SVG and HTML; PDF is not written.
"""

from __future__ import annotations

import html
import json
import math
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.sources.files import numbered

PALETTE = ["#e41a1c", "#377eb8", "#4daf4a", "#984ea3", "#ff7f00", "#a65628", "#f781bf", "#17becf", "#bcbd22", "#1f77b4"]
ORPHAN = "#aaaaaa"


def cluster_table(clusters: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """(cluster_id from 1, seq_id, cluster_size, function, organism)."""
    rows = clusters.where("cluster_idx is not null").withColumn("cluster_size", F.count("*").over(W.partitionBy("cluster_idx")))
    return _annotated(rows, annotations).select((F.col("cluster_idx") + 1).alias("cluster_id"), "seq_id", "cluster_size", "function", "organism")


def orphan_table(clusters: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    return _annotated(clusters.where("is_orphan"), annotations).select("seq_id", "function", "organism")


def _annotated(rows: DataFrame, annotations: DataFrame | None) -> DataFrame:
    if annotations is None:
        return rows.withColumn("function", F.lit("")).withColumn("organism", F.lit(""))
    own = annotations.select("seq_id", F.col("protein_name").alias("function"), "organism")
    return rows.join(own, "seq_id", "left").withColumn("function", F.coalesce("function", F.lit(""))).withColumn("organism", F.coalesce("organism", F.lit("")))


def fasta_records(clusters: DataFrame, sequences: DataFrame) -> DataFrame:
    """(cluster_id, seq_id, record): FASTA text of each clustered or orphan sequence, unmasked."""
    rows = clusters.join(sequences.select("seq_id", "seq"), "seq_id")
    mark = F.when(F.col("cluster_idx").isNull(), F.lit("orphan")).otherwise(F.concat(F.lit("cluster="), (F.col("cluster_idx") + 1).cast("string")))
    return rows.select((F.col("cluster_idx") + 1).alias("cluster_id"), "seq_id", F.concat(F.lit(">"), "seq_id", F.lit("  "), mark, F.lit("\n"), "seq").alias("record"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="\u0000", emptyValue="")


def write_fasta(records: DataFrame, path: str, split: bool = False) -> None:
    clustered = records.where("cluster_id is not null")
    clustered.orderBy("cluster_id", "seq_id").select("record").write.mode("overwrite").text(f"{path}/clusters.fasta")
    records.where("cluster_id is null").select("record").write.mode("overwrite").text(f"{path}/orphans.fasta")
    if split:
        clustered.select("cluster_id", "record").write.mode("overwrite").partitionBy("cluster_id").text(f"{path}/per_cluster")


def write_text(spark, path: str, text: str) -> None:
    """A driver-made text of bounded size as one file, on any file system Spark can write to."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_newick(nodes: DataFrame, path: str) -> None:
    """The tree as Newick in a folder of text files: joined in the order of their names, they are the text."""
    from kinweave.operators.tree import newick_pieces

    numbered(newick_pieces(nodes), "at").orderBy("seq_idx").select("piece").write.mode("overwrite").text(path)


def sizes(clusters: DataFrame) -> DataFrame:
    return clusters.where("cluster_idx is not null").groupBy("cluster_idx").agg(F.count("*").alias("size"))


def rounded(metrics: dict) -> dict:
    """Numbers to four places, as files show them; tables keep them whole."""
    return {k: round(v, 4) if isinstance(v, float) else v for k, v in metrics.items()}


def summary(clusters: DataFrame, parameters: dict, metrics: dict, most: int = 100_000) -> dict:
    """Counts and the sizes of the `most` largest clusters; `n_clusters` says how many there are."""
    n = clusters.agg(F.count("*").alias("n"), F.sum(F.col("is_orphan").cast("long")).alias("o")).first()
    own = [r["size"] for r in sizes(clusters).orderBy(F.desc("size"), "cluster_idx").limit(most).collect()]
    return {
        "created": datetime.now(timezone.utc).isoformat(),
        "parameters": parameters,
        "n_sequences": n["n"],
        "n_orphans": n["o"] or 0,
        "n_clusters": sizes(clusters).count(),
        "cluster_sizes": own,
        "metrics": rounded(metrics),
    }


def term_table(clusters: DataFrame, terms: DataFrame, tests: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(cluster_id, go_id, term, p_value, genes): enriched terms with the sequences of the cluster that have them.

    terms (seq_id, go_terms); tests as `enrichment` gives them; names (term,
    name). `term` is the name, or the id where no ontology names it.
    """
    own = terms.select("seq_id", F.explode(F.array_distinct("go_terms")).alias("term"))
    member = clusters.where("cluster_idx is not null").select("seq_id", "cluster_idx")
    genes = member.join(own, "seq_id").join(tests.select("cluster_idx", "term", "p"), ["cluster_idx", "term"])
    genes = genes.groupBy("cluster_idx", "term", "p").agg(F.array_join(F.array_sort(F.collect_list("seq_id")), ",").alias("genes"))
    genes = genes.withColumn("name", F.lit(None).cast("string")) if names is None else genes.join(names.groupBy("term").agg(F.min("name").alias("name")), "term", "left")
    return genes.select((F.col("cluster_idx") + 1).alias("cluster_id"), F.col("term").alias("go_id"), F.coalesce("name", "term").alias("term"), F.col("p").alias("p_value"), "genes")


def dropped_head(dropped: DataFrame, most: int = 15) -> list[str]:
    """The first dropped sequences with their reasons, for the log."""
    return [f"{r['seq_id']}: {r['reason']}" for r in dropped.orderBy("seq_id").limit(most).collect()]


def to_json(value: dict) -> str:
    return json.dumps(value, indent=2, sort_keys=True)


def _svg(width: float, height: float, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height:.0f}" font-family="sans-serif" font-size="11">' + "".join(parts) + "</svg>"


def colour(cluster: int | None) -> str:
    return ORPHAN if cluster is None else PALETTE[cluster % len(PALETTE)]


def bars_svg(rows: list[tuple[int, int]], top: int = 30) -> str:
    """The largest clusters as bars; rows (cluster_idx, size)."""
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))[:top]
    most = max((n for _, n in rows), default=1)
    parts = [f'<text x="4" y="{18 * k + 14}">{c + 1}</text><rect x="40" y="{18 * k + 3}" width="{320 * n / most:.1f}" height="13" fill="{colour(c)}"/><text x="{46 + 320 * n / most:.1f}" y="{18 * k + 14}">{n}</text>' for k, (c, n) in enumerate(rows)]
    return _svg(420, 18 * len(rows) + 8, parts)


def tree_svg(nodes: list[dict], cluster_of: dict[str, int | None], radial: bool = False) -> str:
    """A tree of few enough leaves to read; inner nodes stand midway between their children."""
    by = {r["node_id"]: r for r in nodes}
    x, y = {}, {}
    for r in sorted(nodes, key=lambda r: r["depth"]):
        x[r["node_id"]] = x.get(r["parent_id"], 0.0) + (r["branch_length"] or 0.0)
    for r in sorted(nodes, key=lambda r: r["post"]):
        y[r["node_id"]] = float(r["lo"]) if r["is_leaf"] else (y[r["left_id"]] + y[r["right_id"]]) / 2
    n, far = sum(r["is_leaf"] for r in nodes), max(x.values(), default=0) or 1.0
    if radial:
        at = lambda v: (300 + 250 * x[v] / far * math.cos(2 * math.pi * y[v] / n), 300 + 250 * x[v] / far * math.sin(2 * math.pi * y[v] / n))
    else:
        at = lambda v: (10 + 400 * x[v] / far, 10 + 16 * y[v])
    parts = []
    for r in nodes:
        (px, py) = at(r["node_id"])
        if r["parent_id"] is not None:
            qx, qy = at(by[r["parent_id"]]["node_id"])
            bend = f"L{px:.1f} {py:.1f}" if radial else f"V{py:.1f}H{px:.1f}"
            parts.append(f'<path d="M{qx:.1f} {qy:.1f}{bend}" fill="none" stroke="#555"/>')
        if r["is_leaf"]:
            parts.append(f'<text x="{px + 4:.1f}" y="{py + 4:.1f}" fill="{colour(cluster_of.get(r["seq_id"]))}">{html.escape(str(r["seq_id"]))}</text>')
    return _svg(600, 600 if radial else 16 * n + 20, parts)


def heatmap_svg(edges: list[tuple[int, int, float]], order: list[str]) -> str:
    """Similarities by place in the order; pairs absent are 0."""
    n = max(1, len(order))
    cell = max(2.0, min(14.0, 600 / n))
    shade = lambda s: f"rgb({255 - int(200 * s)},{255 - int(160 * s)},255)"
    parts = [f'<rect x="{cell * a:.1f}" y="{cell * b:.1f}" width="{cell:.1f}" height="{cell:.1f}" fill="{shade(s)}"/>' for i, j, s in [*edges, *((k, k, 1.0) for k in range(len(order)))] for a, b in {(i, j), (j, i)}]
    if n <= 50:
        parts += [f'<text x="{cell * n + 4:.1f}" y="{cell * (k + 0.8):.1f}">{html.escape(name)}</text>' for k, name in enumerate(order)]
    return _svg(cell * n + 160, cell * n, parts)


def histogram_svg(rows: list[tuple[bool, int, int]]) -> str:
    most = max((n for _, _, n in rows), default=1)
    parts = [f'<rect x="{10 + 8 * b + (0 if c else 500)}" y="{150 - 140 * n / most:.1f}" width="7" height="{140 * n / most:.1f}" fill="{"#e41a1c" if c else "#377eb8"}"/>' for c, b, n in rows]
    return _svg(1000, 160, parts)


def _shown(n: int, total: int, where: str) -> str:
    return "" if n >= total else f"<p>{n} of {total} shown; all are in {where}.</p>"


def report_html(
    info: dict, members: list[tuple[int, str]], orphans: list[str], terms: list[dict], charts: list[str], n_terms: int | None = None
) -> str:
    """A page that needs no other file; all names are escaped, and lists that were cut say so."""
    e = lambda v: html.escape(str(v))
    table = lambda d: "<table>" + "".join(f"<tr><th>{e(k)}</th><td>{e(v)}</td></tr>" for k, v in d.items()) + "</table>"
    per: dict[int, list[str]] = {}
    for c, s in members:
        per.setdefault(c, []).append(s)
    blocks = "".join(
        f"<details><summary>Cluster {c + 1} ({len(v)})</summary><ul>{''.join(f'<li>{e(s)}</li>' for s in v)}</ul></details>"
        for c, v in sorted(per.items())
    )
    rows = "".join(f"<tr><td>{t['cluster_idx'] + 1}</td><td>{e(t['term'])}</td><td>{t['p']:.3e}</td></tr>" for t in terms)
    clustered = info["n_sequences"] - info["n_orphans"]
    return "".join(
        [
            "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Clusters</title></head><body><h1>Clusters</h1>",
            *charts,
            f"<h2>Parameters</h2>{table(info['parameters'])}<h2>Metrics</h2>{table(info['metrics'])}",
            f"<h2>Members</h2>{_shown(len(members), clustered, 'clusters.tsv')}{blocks}",
            f"<h2>Terms</h2>{_shown(len(terms), len(terms) if n_terms is None else n_terms, 'go_terms.tsv')}<table>{rows}</table>",
            f"<h2>Orphans</h2>{_shown(len(orphans), info['n_orphans'], 'orphans.tsv')}",
            f"<ul>{''.join(f'<li>{e(s)}</li>' for s in orphans)}</ul></body></html>",
        ]
    )
