"""The run over a small family of three unlike groups, and each stage's own cases."""

import heapq
import itertools
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions.residues import AA_ORDER, BLEND, DIAGONALS, accession, classes, encode_classes, encode_residues
from kinweave.operators import clusters as cl
from kinweave.operators import evaluation as ev
from kinweave.operators import prep, sinks
from kinweave.operators import similarity as sim
from kinweave.operators import tree as tr
from kinweave.plans.pipeline import Config, Pipeline, parser
from kinweave.queries import QUERIES
from kinweave.sources import files

ALPHABETS = {"A": "AGILMV", "B": "HKNQRST", "C": "CDEFPWY"}
GROUPS = {"A": "first", "B": "second", "C": "third"}


def _family(size=4, core=10, flank=5):
    """Three groups over alphabets without a common residue; the sequences of a group share a core."""
    rng = random.Random(20)
    some = lambda g, n: "".join(rng.choice(ALPHABETS[g]) for _ in range(n))
    rows = []
    for g in ALPHABETS:
        shared = some(g, core)
        rows += [(f"{g}{k + 1}", some(g, flank) + shared + some(g, flank)) for k in range(size)]
    return rows


FAMILY = _family()


def sequences(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq_idx long, seq_id string, seq string")


def plain_score(x, y, diag, l):
    seen = {y[i : i + l] for i in range(len(y) - l + 1)}
    hit = set()
    for i in range(len(x) - l + 1):
        w = x[i : i + l]
        if "X" not in w and w in seen:
            hit |= set(range(i, i + l))
    return sum(diag[AA_ORDER.index(x[i])] for i in hit)


def plain_similarity(seqs, l=4, pw=0.3, alphabet="murphy8"):
    of = classes(alphabet)
    low = [("".join(AA_ORDER[of[c]] if c in of else "X" for c in s)) for s in seqs]
    longest = max(range(len(seqs)), key=lambda i: (len(seqs[i]), -i))
    out = {}
    for i, j in itertools.combinations(range(len(seqs)), 2):
        s = 0.0
        for m, w in BLEND.items():
            d = DIAGONALS[m]
            top = sum(d[AA_ORDER.index(c)] for c in seqs[longest] if c != "X")
            s += w * min(1.0, ((1 - pw) * plain_score(seqs[i], seqs[j], d, l) + pw * plain_score(low[i], low[j], d, l)) / top)
        if s > 0:
            out[i, j] = s
    return out


def test_similarity_equals_brute_force(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACDEX" if k % 2 else AA_ORDER) for _ in range(rng.randint(3, 60))) for k in range(40)] + ["", "ACD", "ACDEFGH" * 12]
    got = {(r["i"], r["j"]): r["s"] for r in sim.motif_similarity(sequences(spark, [(f"s{k}", s) for k, s in enumerate(seqs)])).collect()}
    want = plain_similarity(seqs)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_domains_one_sided_and_runs(spark):
    df = sequences(spark, [("a", "KKACDEFGHI"), ("b", "MMMACDEFLLACDE")])
    runs = {(r["px"], r["py"], r["len"]) for r in sim.runs(df).collect()}
    assert runs == {(2, 3, 5), (2, 10, 4)}
    kept = {(r["px"], r["py"], r["len"]) for r in sim.maximal_matches(spark.createDataFrame([(0, 1, 0, 0, 6), (0, 1, 1, 1, 4), (0, 1, 3, 3, 5)], "i long, j long, px int, py int, len int")).collect()}
    assert kept == {(0, 0, 6), (3, 3, 5)}
    w = {r["pos"]: r["w"] for r in sim.domain_positions(df, spark.createDataFrame([(0, 3, 7), (1, 1, 999)], "seq_idx long, start int, end int")).where("seq_idx = 0").collect()}
    assert [w[k] for k in range(10)] == [0.5, 0.5, 2, 2, 2, 2, 2, 0.5, 0.5, 0.5]
    same = sim.motif_similarity(df, {"BLOSUM62": 1.0}).first()["s"]
    empty = spark.createDataFrame([], "seq_idx long, start int, end int")
    assert abs(sim.motif_similarity(df, {"BLOSUM62": 1.0}, domains=empty).first()["s"] - same) < 1e-6
    more = sim.motif_similarity(df, {"BLOSUM62": 1.0}, domains=spark.createDataFrame([(0, 1, 10)], "seq_idx long, start int, end int")).first()["s"]
    assert abs(more - min(1, same * math.sqrt(2))) < 1e-6


def dense_linkage(n, s):
    near = {i: {j: s.get((min(i, j), max(i, j)), 0.0) for j in range(n) if j != i} for i in range(n)}
    heap = [(-near[i][j], i, j) for i in range(n) for j in range(i + 1, n)]
    heapq.heapify(heap)
    size, out = dict.fromkeys(range(n), 1), []
    while len(near) > 1:
        v, a, b = heapq.heappop(heap)
        if a not in near or b not in near:
            continue
        new = n + len(out)
        out.append((a, b, -v))
        own = {k: (size[a] * near[a][k] + size[b] * near[b][k]) / (size[a] + size[b]) for k in near if k not in (a, b)}
        del near[a], near[b]
        size[new] = size[a] + size[b]
        for k, x in own.items():
            near[k][new] = x
            heapq.heappush(heap, (-x, k, new))
        near[new] = own
    return out


def test_linkage_equals_dense():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 14)
        s = {(i, j): rng.choice([0.25, 0.5, 0.75, rng.random()]) for i in range(n) for j in range(i + 1, n) if rng.random() < rng.choice([0.1, 0.3, 0.9])}
        left, parts = set(range(n)), {}
        while left:
            todo, own = [min(left)], set()
            while todo:
                x = todo.pop()
                if x not in own:
                    own.add(x)
                    todo += [b if a == x else a for a, b in s if x in (a, b)]
            left -= own
            near = {x: {} for x in own}
            for (a, b), v in s.items():
                if a in own:
                    near[a][b] = near[b][a] = v
            if len(own) > 1:
                parts[min(own)] = tr.average_linkage(near)
        got = tr.replay(n, parts)
        want = dense_linkage(n, s)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(got, want, strict=True))


def test_family(spark, tmp_path):
    df = sequences(spark, FAMILY)
    edges = sim.motif_similarity(df, {"BLOSUM62": 1.0}, property_pass=False)
    assert all(FAMILY[r["i"]][0][0] == FAMILY[r["j"]][0][0] for r in edges.collect())
    nodes = tr.build_tree(df, edges).cache()
    assert nodes.count() == 23 and nodes.where("parent_id is null").first()["n_leaves"] == 12
    weights = {r["node_id"]: r["weight"] for r in cl.leaf_weights(nodes).collect()}
    assert all(abs(weights[r["node_id"]] - r["leaf_weight"]) < 1e-12 for r in nodes.where("is_leaf").collect())
    assert {(r["node_id"], r["depth"]) for r in cl.depths(nodes).collect()} == {(r["node_id"], r["depth"]) for r in nodes.collect()}
    cosim = cl.cosimilarity(nodes).cache()
    at = cl.otsu(cosim)
    low = cosim.agg({"cosim": "min"}).first()[0]
    assert low == 0.0 and at >= 0
    found = cl.extract(nodes, cl.cut_nodes(cosim, at)).cache()
    assert cl.unassigned(nodes, found).count() == 0
    per = {}
    for r in found.where("not is_orphan").collect():
        per.setdefault(r["cluster_idx"], set()).add(r["seq_id"][0])
    assert len(per) >= 2 and all(len(v) == 1 for v in per.values())
    assert found.where("is_orphan").count() <= 2
    truth = spark.createDataFrame([(s, GROUPS[s[0]]) for s, _ in FAMILY], "seq_id string, functional_group string")
    assert ev.q_measure(found, truth).first()["q"] >= 75


def test_pipeline_writes_everything(spark, tmp_path):
    path = tmp_path / "in.fasta"
    path.write_text("".join(f">{i} text\n{s[:9].lower()}\n{s[9:]}\n" for i, s in FAMILY) + ">short\nACD\n>odd\nACDE*FGHIKLMN\n")
    ref = tmp_path / "ref.tsv"
    ref.write_text("# labels\n" + "".join(f"{i}\t{GROUPS[i[0]]}\n" for i, _ in FAMILY))
    out = tmp_path / "out"
    c = Config(fasta=str(path), out_dir=str(out), reference=str(ref), matrices=["BLOSUM62"], matrix_weights=[1.0], property_pass=False, plot=True, split_fasta=True)
    got = Pipeline(spark, c).run()
    assert got["q"] >= 75 and -1 <= got["silhouette"] <= 1 and 0 < got["nmi"] <= 1
    again = Pipeline(spark, Config(**{**c.__dict__, "resume": True})).run()
    assert again == got
    info = json.loads((out / "summary.json").read_text())
    assert info["n_sequences"] == 12 and sum(info["cluster_sizes"]) + info["n_orphans"] == 12
    assert (out / "tree.nwk").read_text().endswith(";") and "<svg" in (out / "tree_plot.svg").read_text()
    rows = files.parse_newick((out / "tree.nwk").read_text())
    assert len(rows) == 23 and rows[0]["n_leaves"] == 12
    nodes = spark.read.parquet(next(str(p) for p in (out / "checkpoints").iterdir() if p.name.startswith("nodes-")))
    sinks.write_newick(nodes, str(tmp_path / "pieces"))
    pieces = "".join(p.read_text() for p in sorted((tmp_path / "pieces").glob("part-*"))).replace("\n", "")
    assert pieces == (out / "tree.nwk").read_text().strip()
    assert len(spark.read.csv(str(out / "dropped.tsv"), sep="\t", header=True).collect()) == 2
    for boundary, method in (("kneedle", "nj"), ("gmm", "upgma")):
        Pipeline(spark, Config(**{**c.__dict__, "boundary": boundary, "tree_method": method, "plot": False})).run()


def test_cli_flags():
    args = parser().parse_args(["--fasta", "x", "--no-property-pass", "--boundary", "gmm", "--n-jobs", "4"])
    assert args.property_pass is False and args.boundary == "gmm" and args.l == 4


def test_validate_and_encode(spark):
    df = sequences(spark, [("a", "ACXDE"), ("b", "ABCZ"), ("c", "ACDE*FGHI"), ("d", "")])
    good, bad = prep.validate(df, 5)
    assert [r["seq_id"] for r in good.collect()] == ["a"]
    assert {r["seq_id"]: r["reason"] for r in bad.collect()} == {"b": "too short (4 aa; min=5)", "c": "invalid characters: ['*']", "d": "too short (0 aa; min=5)"}
    codes = {r["seq_id"]: r["c"] for r in df.select("seq_id", encode_residues(df["seq"]).alias("c")).collect()}
    assert codes["a"] == [0, 1, -1, 2, 3] and codes["b"] == [0, -1, 1, -1] and codes["d"] == []
    for name, n in (("murphy8", 8), ("murphy10", 10)):
        (row,) = sequences(spark, [("s", AA_ORDER + "XB")]).select(encode_classes(df_col("seq"), name).alias("c")).collect()
        assert len(set(row["c"])) == n + 1 and row["c"][-2:] == [-1, -1] and row["c"].count(row["c"][1]) == 1
    ids = spark.createDataFrame([("sp|P12345|N",), ("tr|q8n123|X",), ("P12345.1",), ("AAA24053",), ("GenBank:BAD89079",)], "i string")
    assert [r[0] for r in ids.select(accession(ids["i"])).collect()] == ["P12345", "Q8N123", "P12345", None, None]


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def plain_mask(seq, window=12, k1=1.8, k2=2.5):
    n = len(seq)

    def h(w):
        return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)) if w else 0.0

    if n < window:
        return "X" * n if h(seq) < k1 else seq
    first = sorted({p for i in range(n - window + 1) if h(seq[i : i + window]) < k1 for p in range(i, i + window)})
    out = set(first)
    for p in first:
        if p - 1 not in first:
            x = p
            while x >= window and h(seq[x - window : x]) < k2:
                x -= 1
                out.add(x)
        if p + 1 not in first:
            x = p
            while x + 1 + window <= n and h(seq[x + 1 : x + 1 + window]) < k2:
                x += 1
                out.add(x)
    return "".join("X" if i in out else c for i, c in enumerate(seq))


def test_masking(spark):
    rng = random.Random(3)
    for _ in range(400):
        seq = "".join(rng.choice(rng.choice(["A", "AC", "ACDE", AA_ORDER])) * rng.randint(1, 4) for _ in range(rng.randint(0, 25)))
        assert prep.mask_string(seq) == plain_mask(seq), seq
    assert "X" in prep.mask_string("A" * 30) and prep.mask_string(AA_ORDER * 2) == AA_ORDER * 2
    assert set(prep.mask_string("ACDEFG" + "AAAAAA" + "ACDEFG", 6, 1, 3)[6:12]) == {"X"}
    df = sequences(spark, [("a", "ACDEF")])
    key = df.select(prep.disorder_key(df["seq"], 0.5)).first()[0]
    scores = spark.createDataFrame([(key, [0.8, 0.3, 0.9, 0.1, 0.7])], "seq_hash string, scores array<double>")
    assert prep.mask_disordered(df, scores).first()["seq"] == "XCXEX"


def test_thresholds(spark):
    rng = random.Random(4)
    for _ in range(6):
        v = [rng.choice([0.0, 1.0, rng.random()]) for _ in range(rng.randint(5, 60))]
        df = spark.createDataFrame([(x,) for x in v], "cosim double")
        arr, best, want = np.array(v), -1.0, min(v)
        for t in np.linspace(arr.min(), arr.max(), 200):
            low, high = arr[arr <= t], arr[arr > t]
            if len(low) and len(high):
                var = len(low) * len(high) / len(v) ** 2 * (low.mean() - high.mean()) ** 2
                if var > best * (1 + 1e-12):
                    best, want = var, t
        assert abs(cl.otsu(df) - want) < 1e-9
        s = np.sort(arr)
        knee = s[np.argmax((s - s.min()) / max(s.max() - s.min(), 1e-12) - np.linspace(0, 1, len(s)))]
        assert abs(cl.kneedle(df) - knee) < 1e-9
    two = spark.createDataFrame([(rng.gauss(0, 0.1),) for _ in range(60)] + [(rng.gauss(3, 0.1),) for _ in range(60)], "cosim double")
    assert 0.5 < cl.gmm(two) < 2.5
    assert abs(cl.crossing((0, 1, 0.5), (4, 1, 0.5)) - 2) < 1e-9


def test_metrics_and_terms(spark):
    seqs = spark.createDataFrame([(k, f"s{k}") for k in range(8)], "seq_idx long, seq_id string")
    found = spark.createDataFrame([(f"s{k}", k // 3 if k < 6 else None) for k in range(8)], "seq_id string, cluster_idx int")
    ref = spark.createDataFrame([(f"s{k}", "ab"[k % 5 == 4]) for k in range(7)], "seq_id string, functional_group string")
    labels = ev.label_pairs(seqs, found, ref)
    rows = [(r["truth"], r["predicted"]) for r in labels.collect()]
    n, both = len(rows), 0
    same_t = same_p = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        both += a == c and b == d
        same_t += a == c
        same_p += b == d
    pairs = n * (n - 1) / 2
    expected = same_t * same_p / pairs
    assert abs(ev.adjusted_rand(labels).first()[0] - (both - expected) / ((same_t + same_p) / 2 - expected)) < 1e-12
    assert 0 <= ev.mutual_information(labels).first()[0] <= 1
    edges = {(0, 1): 0.9, (1, 2): 0.5, (3, 4): 0.4, (0, 5): 0.2, (6, 7): 0.1}
    d = np.ones((8, 8)) - np.eye(8)
    for (i, j), s in edges.items():
        d[i, j] = d[j, i] = 1 - s
    own = [p for _, p in sorted((r["seq_id"], r["predicted"]) for r in labels.collect())]
    total = 0.0
    for i in range(8):
        mine = [j for j in range(8) if own[j] == own[i] and j != i]
        if mine:
            a = d[i, mine].mean()
            b = min(d[i, [j for j in range(8) if own[j] == c]].mean() for c in set(own) if c != own[i])
            total += (b - a) / max(a, b)
    pred = labels.join(seqs, "seq_id").select("seq_idx", "predicted")
    got = ev.silhouette(pred, spark.createDataFrame([(i, j, s) for (i, j), s in edges.items()], "i long, j long, s double")).first()[0]
    assert abs(got - total / 8) < 1e-12
    terms = spark.createDataFrame([(f"s{k}", ["t", "t"] if k < 3 else ["u"]) for k in range(8)], "seq_id string, go_terms array<string>")
    tests = {(r["cluster_idx"], r["term"]): r for r in ev.enrichment(found, terms).collect()}
    assert abs(tests[0, "t"]["p"] - 1 / math.comb(8, 3)) < 1e-12 and tests[0, "t"]["enriched"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "c")], "child string, parent string")
    assert ev.ancestors(edges).count() == 8
    left = ev.reduce_terms(spark.createDataFrame([(0, "a"), (0, "c"), (0, "z"), (1, "c")], "cluster_idx int, term string"), edges)
    assert {tuple(r) for r in left.collect()} == {(0, "a"), (0, "z"), (1, "c")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("junk\n>one x\nacd\n\nEF\r\n>two\nGG\n  >one\nKK\n>\nLL\n")
    got = [tuple(r) for r in files.read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("seq_idx").collect()]
    assert got == [(0, "one", "KK"), (1, "two", "GG")]
    answer = {"entryType": "UniProtKB reviewed (Swiss-Prot)", "primaryAccession": "P12345", "organism": {"scientificName": "Homo sapiens", "taxonId": 9606}, "genes": [{"geneName": {"value": "g"}}], "uniProtKBCrossReferences": [{"database": "GO", "id": "GO:0005488"}, {"database": "PDB", "id": "1"}]}
    shape = {"results": [{"metadata": {"accession": "IPR1", "name": "dom"}, "proteins": [{"entry_protein_locations": [{"fragments": [{"start": 2, "end": 9}, {"start": None, "end": 3}]}]}]}]}
    ids = spark.createDataFrame([("sp|P12345|X",), ("AAA24053",)], "seq_id string")
    out = {r["seq_id"]: r for r in files.annotations(ids, spark.createDataFrame([("P12345", json.dumps(answer))], "accession string, json string"), spark.createDataFrame([("P12345", json.dumps(shape))], "accession string, json string")).collect()}
    a, b = out["sp|P12345|X"], out["AAA24053"]
    assert a["organism"] == "Homo sapiens" and a["reviewed"] and a["go_terms"] == ["GO:0005488"] and [tuple(d) for d in a["domains"]] == [("IPR1", "dom", 2, 9)]
    assert b["organism"] == "Unknown" and b["accession"] is None and b["domains"] == []
    (tmp_path / "o.obo").write_text("[Term]\nid: GO:1\nname: one\nis_a: GO:2 ! two\n\n[Term]\nid: GO:2\nis_a: GO:3\n")
    terms = files.read_ontology(spark, str(tmp_path / "o.obo"))
    assert {tuple(r) for r in files.ontology_edges(terms).collect()} == {("GO:1", "GO:2"), ("GO:2", "GO:3")}
    assert {(r["term"], r["name"]) for r in terms.collect()} == {("GO:1", "one"), ("GO:2", None)}


def plain_fasta(texts):
    """{id: sequence} of texts read line by line."""
    out, own = {}, None
    for text in texts:
        own = None
        for line in text.split("\n"):
            line = line.rstrip("\r").strip(" ")
            if line.startswith(">"):
                own = (line[1:].split() or [None])[0]
                if own is not None:
                    out[own] = ""
            elif own is not None:
                out[own] += line.upper()
    return [(i, k, v) for i, (k, v) in enumerate(out.items())]


@pytest.mark.parametrize("block", [61, 1 << 20])
def test_files_are_read_in_blocks(spark, tmp_path, block):
    """FASTA, label and OBO files cut into blocks of any size: the same as line by line, in order."""
    rng = random.Random(block)
    ends = ["\n", "\r\n"]
    texts = []
    for k in range(3):
        text = rng.choice(["", "junk\nmore\n", "\n"])
        for i in range(12):
            end = rng.choice(ends)
            text += rng.choice(["", "", "  "]) + f">{rng.choice(['', ' '])}s{rng.randint(0, 60)} a>b" + end
            text += "".join("".join(rng.choice("acdefXY") for _ in range(rng.randint(0, 12))) + rng.choice(["", " "]) + end for _ in range(rng.randint(0, 3)))
        texts.append(text + rng.choice(["", ">", ">last"]))
        (tmp_path / f"f{k}.fasta").write_bytes(texts[-1].encode())
    (tmp_path / "l.tsv").write_text("#c\n" + "".join(f"s{i % 13}\tg{i}\r\n" for i in range(40)) + "odd\n")
    (tmp_path / "o.obo").write_text("format-version: 1\n" + "".join(f"\n[Term]\nid: t{i}\nname: n {i}\nis_a: t{i // 2} ! x\n" for i in range(1, 12)))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, block)
    try:
        got = [tuple(r) for r in files.read_fasta(spark, str(tmp_path / "*.fasta")).orderBy("seq_idx").collect()]
        assert got == plain_fasta(texts)
        labels = dict(map(tuple, files.read_labels(spark, str(tmp_path / "l.tsv")).collect()))
        assert labels == {f"s{i % 13}": f"g{i}" for i in range(40)}
        terms = {(r["term"], r["name"], *r["parents"]) for r in files.read_ontology(spark, str(tmp_path / "o.obo")).collect()}
        assert terms == {(f"t{i}", f"n {i}", f"t{i // 2}") for i in range(1, 12)}
        if block == 61:
            assert spark.read.text(str(tmp_path / "f0.fasta")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set(name, before)


def test_taxon_weights(spark):
    org = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "seq_id string, organism string")
    w = {r["seq_id"]: r["weight"] for r in prep.taxon_weights(org).collect()}
    assert abs(sum(w.values()) - 4) < 1e-12 and abs(w["a"] - 4 / 6) < 1e-12 and abs(w["c"] - 4 / 3) < 1e-12
    lin = {"x": ["r", "s", "x"], "y": ["r", "y"]}
    got = {r["seq_id"]: r["weight"] for r in prep.taxon_weights_phylogenetic(org, spark.createDataFrame(list(lin.items()), "organism string, lineage array<string>")).collect()}
    names = ["x", "x", "y", "Unknown"]
    over = lambda p, q: len(set(lin.get(p, [])) & set(lin.get(q, []))) / max(len(lin.get(p, [])), len(lin.get(q, []))) if lin.get(p) and lin.get(q) else 0.0
    raw = [1 / (1 + np.mean([over(names[i], names[j]) for j in range(4) if j != i])) for i in range(4)]
    for k, s in enumerate("abcd"):
        assert abs(got[s] - raw[k] * 4 / sum(raw)) < 1e-12


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_neighbour_joining(n):
    rng = np.random.default_rng(n)
    s = rng.random((n, n))
    s = (s + s.T) / 2
    np.fill_diagonal(s, 1)
    joins = tr.neighbour_joining(s)
    rows = tr.node_rows([f"s{k}" for k in range(n)], joins)
    assert len(rows) == 2 * n - 1 and sum(r[4] for r in rows) == n
    assert all(r[6] >= 0 for r in rows)
    same_joins(joins, plain_joining(s.tolist()))
    ties = rng.integers(0, 3, (n, n)) / 2.0
    ties = np.maximum(ties, ties.T)
    np.fill_diagonal(ties, 1)
    same_joins(tr.neighbour_joining(ties), plain_joining(ties.tolist()))


def same_joins(got, want):
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a - b) < 1e-9 for x, y in zip(got, want, strict=True) for a, b in zip(x[2:], y[2:], strict=True))


def plain_joining(s):
    """Neighbour joining by its definition over a dictionary of pairs."""
    far = {frozenset((i, j)): 1 - s[i][j] for i in range(len(s)) for j in range(i)}
    open_, out = list(range(len(s))), []
    while len(open_) > 1:
        m, new = len(open_), len(s) + len(out)
        total = {i: sum(far[frozenset((i, j))] for j in open_ if j != i) for i in open_}
        best = None
        for i, j in itertools.combinations(sorted(open_), 2):
            q = (m - 2) * far[frozenset((i, j))] - total[i] - total[j]
            if best is None or q < best[0] - 1e-9:
                best = (q, i, j)
        _, i, j = best
        d = far[frozenset((i, j))]
        arm = max(0.0, d / 2 + (total[i] - total[j]) / (2 * (m - 2))) if m > 2 else max(0.0, d / 2)
        out.append((i, j, max(0.0, 1 - d), arm, max(0.0, d - arm)))
        open_ = [k for k in open_ if k not in (i, j)]
        for k in open_:
            far[frozenset((k, new))] = max(0.0, (far[frozenset((i, k))] + far[frozenset((j, k))] - d) / 2)
        open_.append(new)
    return out


def residues(text):
    return "".join(c.upper() for c in text if c.isascii() and c.upper() in AA_ORDER + "X")


needs_data = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")


@needs_data
def test_tree_queries_over_their_whole_table(spark):
    """Both trees, their Newick text and what is read back, against plain builders over the same similarities."""
    data = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{data}/benchmark.parquet")
    items = sorted((r["item_id"], residues(r["text"])) for r in d.collect())
    n = len(items)
    assert [k for k, _ in items] == list(range(n))
    sparse = {k: float(np.float32(v)) for k, v in plain_similarity([s for _, s in items]).items()}
    full = [[1.0 if i == j else sparse.get((min(i, j), max(i, j)), 0.0) for j in range(n)] for i in range(n)]
    names = [f"b{k}" for k, _ in items]
    for query, joins in (
        ("upgma_tree", [(a, b, v, (1 - v) / 2, (1 - v) / 2) for a, b, v in dense_linkage(n, sparse)]),
        ("nj_tree", plain_joining(full)),
    ):
        got = {r["node_id"]: r for r in QUERIES[query](spark, data).collect()}
        assert len(got) == 2 * n - 1 and [got[k]["seq_id"] for k in range(n)] == names
        for k, (a, b, v, la, lb) in enumerate(joins):
            r = got[n + k]
            assert {r["left_id"], r["right_id"]} == {a, b} and abs(r["merge_similarity"] - v) < 1e-5
            assert abs(got[a]["branch_length"] - la) < 1e-5 and abs(got[b]["branch_length"] - lb) < 1e-5
    rows = {r["node_id"]: r for r in QUERIES["upgma_tree"](spark, data).collect()}

    def written(k):
        r = rows[k]
        inner = r["seq_id"] if r["is_leaf"] else f"({written(r['left_id'])},{written(r['right_id'])})"
        return inner if r["parent_id"] is None else f"{inner}:{r['branch_length']:.6f}"

    text = written(2 * n - 2) + ";"
    assert QUERIES["newick_text"](spark, data).first()[0] == text
    back = QUERIES["newick_nodes"](spark, data).collect()
    assert len(back) == 2 * n - 1 and sorted(r["seq_id"] for r in back if r["is_leaf"]) == sorted(names)
    up = {r["node_id"]: r for r in back}
    below = lambda table, k: frozenset([table[k]["seq_id"]]) if table[k]["is_leaf"] else below(table, table[k]["left_id"]) | below(table, table[k]["right_id"])
    assert {below(up, k) for k in up} == {below(rows, k) for k in rows}
    assert all(abs(up[k]["branch_length"] - r["branch_length"]) < 1e-6 for k in up for r in rows.values() if below(up, k) == below(rows, r["node_id"]))


@needs_data
def test_masking_query_over_its_whole_table(spark):
    data = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["seq_idx"]: r["seq"] for r in QUERIES["seg_mask_documents"](spark, data).collect()}
    assert got.keys() == text.keys()
    for k, t in text.items():
        seq = residues(t)
        if len(seq) < 1_500:
            assert got[k] == plain_mask(seq, k1=2.35, k2=2.75), k


def test_sums_around_a_tree_in_several_blocks(spark, monkeypatch):
    """Weights, depths, layout and extraction over random trees, blocks of three leaves, against plain recursion."""
    monkeypatch.setattr(cl, "BLOCK", 3)
    rng = random.Random(12)
    for n in (1, 2, 23):
        left, merges = list(range(n)), []
        while len(left) > 1:
            a, b = (left.pop(rng.randrange(len(left))) for _ in range(2))
            merges.append((a, b, rng.random(), rng.random(), rng.random()))
            left.append(n + len(merges) - 1)
        rows = tr.node_rows([f"s{k}" for k in range(n)], merges)
        nodes = spark.createDataFrame(rows, tr.NODES).cache()
        by = {r["node_id"]: r for r in nodes.collect()}

        def path(x):
            return [x, *path(by[x]["parent_id"])] if by[x]["parent_id"] is not None else [x]

        under = {x: [y for y in by if by[y]["is_leaf"] and x in path(y)] for x in by}
        weight = {y: sum(by[z]["branch_length"] / len(under[by[z]["parent_id"]]) for z in path(y)[:-1]) for y in under if by[y]["is_leaf"]}
        close = lambda got, want: got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert close({r["node_id"]: r["weight"] for r in cl.leaf_weights(nodes).collect()}, weight)
        assert close({r["node_id"]: r["weight"] for r in cl.node_weights(nodes).collect()}, {x: sum(weight[y] for y in under[x]) for x in by})
        assert {r["node_id"]: r["depth"] for r in cl.depths(nodes).collect()} == {x: len(path(x)) - 1 for x in by}
        assert close({r["node_id"]: r["x"] for r in cl.layout(nodes).collect()}, {x: sum(by[z]["branch_length"] for z in path(x)) for x in by})
        cuts = [x for x in by if not by[x]["is_leaf"] and rng.random() < 0.4]
        dirty = {z for x in cuts for z in path(x)}
        want = set()
        for x in by:
            up = by[x]["parent_id"]
            if x not in dirty and (up in cuts if up is not None else True):
                want.add(frozenset(by[y]["seq_id"] for y in under[x]))
        got = {}
        for r in cl.extract(nodes, spark.createDataFrame([(c,) for c in cuts], "node_id long"), 1).collect():
            got.setdefault(r["cluster_idx"], set()).add(r["seq_id"])
        assert {frozenset(v) for v in got.values()} == want


def _covered_plain(x, y, l):
    own = {y[k : k + l] for k in range(len(y) - l + 1) if "X" not in y[k : k + l]}
    hit = set()
    for k in range(len(x) - l + 1):
        if x[k : k + l] in own:
            hit |= set(range(k, k + l))
    return hit


@pytest.mark.parametrize(("l", "block"), [(4, 4096), (4, 3), (1, 2), (13, 2)])
def test_hot_lmers_are_dealt_as_blocks(spark, l, block):
    """Sequences that nearly all share l-mers, with more of them than a block takes: every pair once, by the plain form."""
    rng = random.Random(l)
    common = "".join(rng.choice(AA_ORDER) for _ in range(30))
    texts = [common[: rng.randint(13, 30)] + "".join(rng.choice(AA_ORDER + "X") for _ in range(rng.randint(0, 40))) + common[rng.randint(0, 12) :] for _ in range(25)] + ["", "AC", "A" * 50, "A" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_idx long, seq string")
    assert (sim.hot_lmers(df, l, block=block) is not None) == (block < 25)
    got = {}
    for r in sim.covered(df, l, block=block).collect():
        for k in range(sim.PLACES):
            if code := r["codes"] >> (sim.BITS * k) & 31:
                at = r["word"] * sim.PLACES + k
                assert AA_ORDER[code - 1] == texts[r["i"]][at]
                got.setdefault((r["i"], r["j"]), []).append(at)
    want = {(i, j): sorted(p) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (p := _covered_plain(texts[i], texts[j], l))}
    assert {k: sorted(v) for k, v in got.items()} == want
    windows = {tuple(r) for r in sim.shared_windows(df, l, block=block).select("i", "j", "p").collect()}
    assert len(windows) == sim.shared_windows(df, l, block=block).count()
    assert {(i, j) for i, j, _ in windows} == set(want)
    if l == 4:
        assert sorted(map(tuple, sim.runs(df, l, block=block).collect())) == sorted(map(tuple, sim.runs(df, l).collect()))


def test_maximal_matches_by_cells(spark):
    """Squares of all sizes against comparing each with each; then a pair with 100,000 of them."""
    rng = random.Random(3)
    rows = [(k % 3, 7, rng.randint(0, 60), rng.randint(0, 60), rng.choice([4, 5, 8, 9, 16, 31, 40])) for k in range(900)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "i long, j long, px int, py int, len int")
    own = set(rows)
    holds = lambda o, m: o[:2] == m[:2] and o != m and o[2] <= m[2] and o[3] <= m[3] and o[2] + o[4] >= m[2] + m[4] and o[3] + o[4] >= m[3] + m[4]
    assert {tuple(r) for r in sim.maximal_matches(df).collect()} == {m for m in own if not any(holds(o, m) for o in own)}
    many = spark.range(100_000).select(F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("j"), (F.col("id") * 3).cast("int").alias("px"), (F.col("id") * 7919 % 300_000).cast("int").alias("py"), (4 + F.col("id") % 13).cast("int").alias("len"))
    assert sim.maximal_matches(many).count() > 90_000


def test_ancestors_of_some_terms(spark):
    """A deep chain, a branch beside it, and a cycle; only what lies above the terms asked for is looked at."""
    chain = [(f"c{k}", f"c{k + 1}") for k in range(25)] + [("y", "c24"), ("p", "q"), ("q", "r"), ("r", "p"), ("r", "s")]
    edges = spark.createDataFrame(chain, "child string, parent string")
    asked = spark.createDataFrame([("c3",), ("q",), ("s",), ("c3",)], "term string")
    got = {tuple(r) for r in ev.ancestors(edges, asked).collect()}
    assert got == {("c3", f"c{k}") for k in range(4, 26)} | {("q", x) for x in "rpqs"}
    left = ev.reduce_terms(spark.createDataFrame([(0, "c3"), (0, "c25"), (0, "p"), (0, "q"), (1, "c25"), (1, "q")], "cluster_idx int, term string"), edges)
    assert {tuple(r) for r in left.collect()} == {(0, "c3"), (1, "c25"), (1, "q")}


def test_many_organisms_under_one_root(spark):
    """20,000 organisms that all share the root taxon, against sums by taxon over plain rows of a few."""
    few = [("a", ["root", "x", "a"]), ("b", ["root", "x"]), ("c", ["root"]), ("d", ["other"]), ("e", None)]
    seqs = [(f"s{k}", "aabcde"[k % 6]) for k in range(40)]
    got = {r["seq_id"]: r["weight"] for r in prep.taxon_weights_phylogenetic(spark.createDataFrame(seqs, "seq_id string, organism string"), spark.createDataFrame(few, "organism string, lineage array<string>")).collect()}
    line, raw = dict(few), {}
    for sid, o in seqs:
        part = [len(set(line[o] or []) & set(line[q] or [])) / max(1, len(line[o] or []), len(line[q] or [])) for t, q in seqs if t != sid]
        raw[sid] = 1 / (1 + sum(part) / len(part))
    assert all(abs(got[s] - raw[s] * len(seqs) / sum(raw.values())) < 1e-9 for s in raw)
    many = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("seq_id"), F.concat(F.lit("o"), "id").alias("organism"))
    lines = many.select("organism", F.array(F.lit("root"), F.concat(F.lit("g"), (F.crc32("organism") % 9).cast("string")), F.col("organism")).alias("lineage"))
    assert abs(prep.taxon_weights_phylogenetic(many, lines).agg(F.sum("weight")).first()[0] - 20_000) < 1e-6


@pytest.mark.parametrize("shape", ["even", "steps", "bend", "noise", "tiny", "far"])
def test_kneedle_opens_only_some_bins(spark, shape):
    """Curves whose knee lies in one bin, in ties, along a line, and among values closer than any first cut."""
    rng = np.random.default_rng(4)
    arr = {
        "even": np.arange(5000) / 7,
        "steps": np.repeat([0.0, 0.1, 0.7, 0.7, 1.0], 400),
        "bend": 1 - 1 / (1 + np.arange(4000)),
        "noise": rng.random(5000),
        "tiny": np.concatenate([0.5 + rng.random(3000) * 1e-13, [0, 1]]),
        "far": np.concatenate([rng.random(2000), [1e300, -1e300]]),
    }[shape]
    s = np.unique(arr)
    d = (s - s[0]) / max(s[-1] - s[0], 1e-12) - np.searchsorted(np.sort(arr), s) / (len(arr) - 1)
    want = s[np.flatnonzero(d >= d.max() - cl.TIE)[0]]
    df = spark.createDataFrame([(float(x),) for x in rng.permutation(arr)], "cosim double")
    assert cl.kneedle(df) == want


def test_flags_that_lack_their_table():
    from kinweave.plans.pipeline import main, missing

    assert missing(Config()) is None
    for wrong in (Config(annotate=True), Config(mask_idr=True), Config(taxon_phylo=True, annotate=True, annotations="a"), Config(mode="esm2"), Config(matrices=["ODD"], matrix_weights=[1.0])):
        assert missing(wrong)
        with pytest.raises(SystemExit):
            main(["--fasta", "f", *{"annotate": ["--annotate"], "mask": ["--mask-idr"], "phylo": ["--taxon-phylo"], "mode": ["--mode", "esm2"], "matrix": ["--matrices", "ODD", "--matrix-weights", "1"]}["annotate" if wrong.annotate and not wrong.taxon_phylo else "mask" if wrong.mask_idr else "phylo" if wrong.taxon_phylo else "mode" if wrong.mode != "sms" else "matrix"]])


@pytest.mark.parametrize("shape", ["chain", "random", "one", "only child"])
def test_heights_of_any_tree(spark, shape):
    """A chain of 20,000 nodes, a random tree, a leaf alone and nodes of one child, against a plain walk."""
    rng = random.Random(8)
    n = {"chain": 10_000, "random": 700, "one": 1, "only child": 3}[shape]
    left, right, roots = {}, {}, list(range(n))
    if shape == "chain":
        left, right = {n + k: (0 if k == 0 else n + k - 1) for k in range(n - 1)}, {n + k: k + 1 for k in range(n - 1)}
    else:
        while len(roots) > 1:
            k = rng.randrange(len(roots) - 1)
            new = n + len(left)
            left[new], right[new] = roots[k], roots[k + 1]
            roots[k : k + 2] = [new]
        if shape == "only child":
            left[50], left[51], right[50], right[51] = roots[0], 50, None, None
    want = {k: float(k) for k in range(n)}
    for v in sorted(left, key=lambda v: (v >= 50 and shape == "only child", v)):
        want[v] = want[left[v]] if right[v] is None else (want[left[v]] + want[right[v]]) / 2
    rows = [(k, None, None, True, k) for k in range(n)] + [(v, left[v], right[v], False, None) for v in left]
    df = spark.createDataFrame(rows, "node_id long, left_id long, right_id long, is_leaf boolean, lo long")
    got = dict(map(tuple, cl.heights(df).collect()))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_fisher_tail(spark):
    """Against whole sums of integers, for small counts all of them, and over ten million."""
    from fractions import Fraction

    rows = [(k, n, a, m) for m in (1, 2, 5, 9) for n in range(m + 1) for a in range(1, m + 1) for k in range(max(0, n + a - m), min(n, a) + 1)]
    rng = random.Random(7)
    for _ in range(150):
        m = rng.choice([30, 300, 3000])
        n, a = rng.randint(1, m), rng.randint(1, m)
        rows.append((rng.randint(max(0, n + a - m), min(n, a)), n, a, m))
    df = spark.createDataFrame(rows, "k long, n long, big_k long, big_n long")
    got = df.select("*", ev.fisher_greater("k", "n", "big_k", "big_n").alias("p")).collect()
    for r in got:
        k, n, a, m = r[:4]
        want = float(Fraction(sum(math.comb(a, x) * math.comb(m - a, n - x) for x in range(k, min(n, a) + 1)), math.comb(m, n)))
        assert abs(r["p"] - want) <= 1e-10 * want + 1e-14, (r, want)
    many = spark.createDataFrame([(5_100, 10_000, 20_000_000, 40_000_000), (4_900, 10_000, 20_000_000, 40_000_000), (30, 1_000, 100_000, 10_000_000_000)], "k long, n long, big_k long, big_n long")
    p = [r["p"] for r in many.select(ev.fisher_greater("k", "n", "big_k", "big_n").alias("p")).collect()]
    # the tails of so large a pool are a binomial's: by log factorials of the small sample alone
    tail = lambda k, n, q: math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(q) + (n - x) * math.log1p(-q)) for x in range(k, n + 1))
    for got_, want in zip(p, [tail(5_100, 10_000, 0.5), tail(4_900, 10_000, 0.5), tail(30, 1_000, 1e-5)], strict=True):
        assert abs(got_ - want) < 1e-2 * want  # the pool is finite


def _plain_mixture(x, first):
    """Mean log-likelihood and (mean, deviation, weight) of two normal curves, by expectation and maximisation over all values."""
    share, before, now = np.stack([first, 1 - first]), -math.inf, -math.inf
    for _ in range(200):
        mass = share.sum(axis=1) + 1e-12
        mean = share @ x / mass
        dev = np.sqrt(np.array([share[k] @ (x - mean[k]) ** 2 / mass[k] for k in (0, 1)]) + 1e-6)
        part = mass / mass.sum()
        log = np.log(part)[:, None] - np.log(dev)[:, None] - 0.5 * ((x - mean[:, None]) / dev[:, None]) ** 2
        total = np.logaddexp(log[0], log[1])
        share = np.exp(log - total)
        now = float(total.mean())
        if abs(now - before) < 1e-3:
            break
        before = now
    return now, sorted(zip(mean.tolist(), dev.tolist(), part.tolist(), strict=True))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixture_over_all_values(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 0.1 * seed, 3000), rng.normal(2, 0.4, 1000 * seed), [5.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "cosim double").repartition(5)
    at, lo, hi = cl.otsu(df), x.min(), x.max()
    edges = [at]
    bins = np.floor((x - lo) / (hi - lo) * (cl.BINS - 1))
    for q in (0.2, 0.4, 0.6, 0.8):
        own, count = np.unique(bins, return_counts=True)
        share = np.cumsum(count) / len(x)
        edges.append(x[bins <= own[max(0, np.searchsorted(share, max(q, share[0]), "right") - 1)]].max())
    fits = [_plain_mixture(x, (x <= e).astype(float)) for e in edges]
    want = cl.crossing(*max(fits, key=lambda fit: fit[0])[1])
    assert abs(cl.gmm(df) - want) < 1e-6
    assert cl.gmm(df.limit(0)) == 0.0 and cl.gmm(df.limit(1)) == df.limit(1).first()[0]


def test_annotations_through_the_cache(spark, tmp_path):
    """The second run reads misses and failures only; a row that comes again replaces the one before."""
    answer = lambda k, name: json.dumps({"entryType": "UniProtKB reviewed (Swiss-Prot)", "primaryAccession": f"P0000{k}", "organism": {"scientificName": name, "taxonId": k}})
    shape = json.dumps({"results": [{"metadata": {"accession": "IPR1", "name": "dom"}, "proteins": [{"entry_protein_locations": [{"fragments": [{"start": 2, "end": 9}]}]}]}]})
    ids = spark.createDataFrame([(f"sp|P0000{k}|X",) for k in range(6)] + [("own",), ("sp|P00001|Y",)], "seq_id string")
    schema, cache = "accession string, json string", str(tmp_path / "cache")

    def landed(name, proteins):
        spark.createDataFrame(proteins, schema).write.parquet(str(tmp_path / name / "proteins"))
        spark.createDataFrame([("P00001", shape)], schema).write.parquet(str(tmp_path / name / "domains"))
        return {r["seq_id"]: r for r in files.annotate(ids, str(tmp_path / name), cache).collect()}

    first = landed("a", [(f"P0000{k}", answer(k, f"o{k}")) for k in range(3)] + [("P00003", "{odd")])
    assert [first[f"sp|P0000{k}|X"]["organism"] for k in range(6)] == ["o0", "o1", "o2", "Unknown", "Unknown", "Unknown"]
    assert first["own"]["accession"] is None and len(first["sp|P00001|Y"]["domains"]) == 1
    # answers of known ones have changed: they are not read again
    second = landed("b", [(f"P0000{k}", answer(k, f"new{k}")) for k in range(5)])
    assert [second[f"sp|P0000{k}|X"]["organism"] for k in range(6)] == ["o0", "o1", "o2", "new3", "new4", "Unknown"]
    rows = spark.read.parquet(cache)
    assert {(r["version"], r["accession"], r["status"]) for r in rows.where("version = 2").collect()} == {(2, "P00003", "found"), (2, "P00004", "found"), (2, "P00005", "failed")}
    assert rows.where("version = 1").count() == 6
    # a version that was not finished is written again
    import shutil

    shutil.rmtree(f"{cache}/version=2")
    third = landed("c", [(f"P0000{k}", answer(k, f"new{k}")) for k in range(5)])
    assert {k: tuple(v) for k, v in third.items()} == {k: tuple(v) for k, v in second.items()}
