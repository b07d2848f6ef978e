"""Every operator as a query over whole tables, with the same in SQL where SQL can say it.

Sequences are the residue projection of whole texts: per-row operators run over
`documents`, operators on pairs, and those that give rows by window or residue,
over `benchmark`. Tree operators run over a
heap-shaped tree with a leaf for each `part` row: node k has the children 2k and
2k + 1, and a is an ancestor of b if b shifted right by some t is a.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.residues import AA_ORDER, ALPHABETS, BLEND, DIAGONALS, accession, classes, encode_classes, encode_residues, protein, reduced
from kinweave.operators import clusters as cl
from kinweave.operators import evaluation as ev
from kinweave.operators import prep, sinks
from kinweave.operators import similarity as sim
from kinweave.operators import tree as tr
from kinweave.sources import files
from kinweave.sources.shared import new_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("seq_idx"), F.concat(F.lit("d"), d["doc_id"].cast("string")).alias("seq_id"), protein(d["text"]).alias("seq"))


def _bench(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "benchmark")
    return d.select(F.col("item_id").cast("long").alias("seq_idx"), F.concat(F.lit("b"), d["item_id"].cast("string")).alias("seq_id"), protein(d["text"]).alias("seq"))


PROTEIN_SQL = "translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'BJOUZ', '')"
_DOCS = f"d AS (SELECT doc_id AS seq_idx, 'd' || doc_id AS seq_id, {PROTEIN_SQL} AS seq FROM documents)"
_BENCH = f"d AS (SELECT item_id::BIGINT AS seq_idx, 'b' || item_id AS seq_id, {PROTEIN_SQL} AS seq FROM benchmark)"


def _low(alphabet: str) -> str:
    of = classes(alphabet)
    return f"regexp_replace(translate(seq, '{AA_ORDER}', '{''.join(AA_ORDER[of[a]] for a in AA_ORDER)}'), '[^{AA_ORDER}]', 'X', 'g')"


_DIAG = "m(name, aa, w) AS (VALUES " + ", ".join(f"('{m}', '{a}', {w})" for m, d in DIAGONALS.items() for a, w in zip(AA_ORDER, d, strict=True)) + ")"


# --- sources and rows -------------------------------------------------------


@query(f"""
WITH {_DOCS}
SELECT row_number() OVER (ORDER BY seq_idx) - 1 AS seq_idx, seq_id, seq FROM d""")
def fasta_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as FASTA chunks (header, two body lines in lower case), parsed."""
    return files.fasta_chunks(_fasta_text(_docs(spark, sf)).select(F.col("seq_idx").alias("place"), F.substr("value", F.lit(2)).alias("value"), F.lit(False).alias("opens")))


def _fasta_text(d: DataFrame) -> DataFrame:
    half = F.floor(F.length("seq") / 2).cast("int")
    return d.select("seq_idx", F.concat(F.lit(">"), "seq_id", F.lit(" text\n"), F.lower(F.substr("seq", F.lit(1), half)), F.lit("\n"), F.lower(F.substr("seq", half + 1))).alias("value"))


@query(SQL["fasta_parse"])
def fasta_file(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as FASTA files that go by id, and read back in 64 blocks or more, of 64 KB at least, so that records cross the borders."""
    folder = new_folder(spark, "fasta")
    seen = Observation()
    # a scan gives the table's files by size, so the order of ids is made here
    rows = _fasta_text(_docs(spark, sf)).repartitionByRange("seq_idx").sortWithinPartitions("seq_idx").observe(seen, F.sum(F.length("value")).alias("size"))
    rows.select("value").write.option("maxRecordsPerFile", 100_000).text(folder)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, max(1 << 16, min(1 << 27, (seen.get["size"] or 0) // 64)))
    try:
        return files.read_fasta(spark, folder)
    finally:
        spark.conf.set(name, before)


@query(f"WITH {_DOCS} SELECT seq_idx, seq_id FROM d WHERE length(seq) >= 10")
def validate_pass(spark: SparkSession, sf: str) -> DataFrame:
    return prep.validate(_docs(spark, sf))[0].select("seq_idx", "seq_id")


@query("""
WITH d AS (SELECT 'd' || doc_id AS seq_id, translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS seq FROM documents)
SELECT seq_id, CASE WHEN length(seq) < 10 THEN 'too short (' || length(seq) || ' aa; min=10)'
  ELSE 'invalid characters: [' || array_to_string(list_transform(list_sort(list_distinct(list_filter(string_split(seq, ''), lambda c: NOT contains('ACDEFGHIKLMNPQRSTVWYX', c)))), lambda c: '''' || c || ''''), ', ') || ']' END AS reason
FROM d WHERE length(seq) < 10 OR regexp_matches(seq, '[^ACDEFGHIKLMNPQRSTVWYX]')""")
def validate_dropped(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    raw = d.select(F.concat(F.lit("d"), d["doc_id"].cast("string")).alias("seq_id"), F.translate(F.coalesce("text", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("seq"))
    return prep.validate(raw)[1]


def _codes_sql(seq: str) -> str:
    return f"WITH {_DOCS} SELECT seq_idx, array_to_string(list_transform(CASE WHEN seq = '' THEN [] ELSE string_split({seq}, '') END, lambda c: instr('{AA_ORDER}', c) - 1), ',') AS codes FROM d"


def _joined(codes) -> F.Column:
    return F.array_join(F.transform(codes, lambda x: x.cast("string")), ",").alias("codes")


@query(_codes_sql("seq"))
def encode_residue_codes(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return d.select("seq_idx", _joined(encode_residues(d["seq"])))


@query(_codes_sql(_low("murphy8")))
def encode_murphy8(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return d.select("seq_idx", _joined(encode_classes(d["seq"], "murphy8")))


@query(_codes_sql(_low("murphy10")))
def encode_murphy10(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return d.select("seq_idx", _joined(encode_classes(d["seq"], "murphy10")))


@query("""
WITH i AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'sp|P' || lpad((doc_id % 100000)::VARCHAR, 5, '0') || '|N' WHEN 1 THEN 'Q' || (doc_id % 10) || 'AB' || (doc_id % 7) || '1.2' WHEN 2 THEN 'AAA' || doc_id ELSE source END AS seq_id, doc_id FROM documents)
SELECT doc_id, nullif(upper(coalesce(nullif(regexp_extract(seq_id, '^(?:sp|tr)\\|([A-Z][A-Z0-9]{5})\\|', 1, 'i'), ''),
  regexp_extract(seq_id, '^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})(?:\\.\\d+)?$', 1, 'i'))), '') AS accession FROM i""")
def accession_extract(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    n = F.col("doc_id")
    made = F.when(n % 4 == 0, F.concat(F.lit("sp|P"), F.lpad((n % 100000).cast("string"), 5, "0"), F.lit("|N"))).when(n % 4 == 1, F.concat(F.lit("Q"), (n % 10).cast("string"), F.lit("AB"), (n % 7).cast("string"), F.lit("1.2"))).when(n % 4 == 2, F.concat(F.lit("AAA"), n.cast("string"))).otherwise(F.col("source"))
    return d.select("doc_id", accession(made).alias("accession"))


@query("""
WITH l AS (SELECT conv_id, turn, trim(role) AS seq_id, trim(split_part(text, ' ', 1)) AS g FROM conversations)
SELECT seq_id, arg_max(g, (conv_id, turn)) AS functional_group FROM l GROUP BY 1""")
def reference_labels(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "conversations")
    line = F.concat("role", F.lit("\t"), F.split("text", " ")[0])
    return files.label_lines(c.select(F.struct("conv_id", "turn").alias("line_no"), line.alias("line")))


# --- masking ----------------------------------------------------------------

_WINDOWS = f"""{_BENCH},
w AS (SELECT seq_idx, unnest(range(0, length(seq) - 11)) AS pos, seq FROM d WHERE length(seq) >= 12),
c AS (SELECT seq_idx, pos, seq[pos + k + 1] AS aa, count(*) AS n FROM w, range(12) r(k) GROUP BY ALL),
h AS (SELECT seq_idx, pos, -sum(n / 12.0 * log2(n / 12.0)) AS h FROM c GROUP BY ALL)"""
#: Thresholds at which the test texts have low windows; the defaults suit protein.
_K1, _K2 = 2.35, 2.75


@query(f"WITH {_WINDOWS} SELECT seq_idx, pos::INT AS pos, round(h, 6) AS h FROM h")
def entropy_windows(spark: SparkSession, sf: str) -> DataFrame:
    return prep.entropy_windows(_bench(spark, sf)).select("seq_idx", "pos", F.round("h", 6).alias("h"))


_RUNS = f"""{_WINDOWS},
t AS (SELECT seq_idx, pos, CASE WHEN pos > coalesce(lag(pos) OVER (PARTITION BY seq_idx ORDER BY pos), -99) + 12 THEN 1 ELSE 0 END AS fresh FROM h WHERE h < {_K1}),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY seq_idx ORDER BY pos) AS run FROM t),
r AS (SELECT seq_idx, run, min(pos) AS a, max(pos) + 11 AS b FROM g GROUP BY ALL)"""


@query(f'WITH {_RUNS} SELECT seq_idx, a::INT AS "start", b::INT AS "end" FROM r')
def seg_islands(spark: SparkSession, sf: str) -> DataFrame:
    return prep.trigger_runs(_bench(spark, sf), 12, _K1)


@query(f"""WITH {_RUNS},
x AS (SELECT seq_idx, seq, unnest(range(0, length(seq))) AS pos FROM d),
o AS (
  SELECT x.*, coalesce(l.h < {_K2}, false) AS may_left, coalesce(q.h < {_K2}, false) AS may_right FROM x
  LEFT JOIN h l ON l.seq_idx = x.seq_idx AND l.pos = x.pos - 12 LEFT JOIN h q ON q.seq_idx = x.seq_idx AND q.pos = x.pos + 1),
s AS (
  SELECT *, max(CASE WHEN NOT may_left THEN pos END) OVER (PARTITION BY seq_idx ORDER BY pos) AS stop_left,
    min(CASE WHEN NOT may_right THEN pos END) OVER (PARTITION BY seq_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop_right FROM o),
v AS (SELECT r.seq_idx, sl.stop_left AS a, sr.stop_right AS b FROM r JOIN s sl ON sl.seq_idx = r.seq_idx AND sl.pos = r.a JOIN s sr ON sr.seq_idx = r.seq_idx AND sr.pos = r.b),
k AS (SELECT x.seq_idx, x.pos, x.seq, bool_or(coalesce(v.a <= x.pos AND x.pos <= v.b, false)) AS hit FROM x LEFT JOIN v ON v.seq_idx = x.seq_idx GROUP BY ALL)
SELECT seq_idx, string_agg(CASE WHEN hit THEN 'X' ELSE seq[pos + 1] END, '' ORDER BY pos) AS seq FROM k GROUP BY 1""")
def seg_mask(spark: SparkSession, sf: str) -> DataFrame:
    return prep.mask_low_complexity(_bench(spark, sf), 12, _K1, _K2).select("seq_idx", "seq")


@query()
def seg_mask_documents(spark: SparkSession, sf: str) -> DataFrame:
    return prep.mask_low_complexity(_docs(spark, sf), 12, _K1, _K2).select("seq_idx", "seq")


@query("""SELECT sum(length(text))::BIGINT AS total, sum(length(text) - length(replace(text, 'X', '')))::BIGINT AS masked,
  100.0 * sum(length(text) - length(replace(text, 'X', ''))) / sum(length(text)) AS percent FROM documents""")
def mask_stats(spark: SparkSession, sf: str) -> DataFrame:
    return prep.mask_stats(_t(spark, sf, "documents").select(F.col("text").alias("seq")))


@query(f"""WITH {_BENCH}, s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS seq_idx, embedding FROM embeddings)
SELECT d.seq_idx, CASE WHEN s.embedding IS NULL OR seq = '' THEN seq ELSE array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN coalesce(s.embedding[i]::DOUBLE > 0.1, false) THEN 'X' ELSE seq[i] END), '') END AS seq
FROM d LEFT JOIN s ON s.seq_idx = d.seq_idx""")
def idr_mask(spark: SparkSession, sf: str) -> DataFrame:
    d = _bench(spark, sf)
    e = files.numbered(_t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("scores")), "vec_id").select("seq_idx", "scores")
    scores = d.join(e, "seq_idx").select(prep.disorder_key(d["seq"], 0.1).alias("seq_hash"), "scores")
    return prep.mask_disordered(d, scores, 0.1).select("seq_idx", "seq")


# --- similarity -------------------------------------------------------------

_LMERS = "x AS (SELECT seq_idx, unnest(range(1, greatest(length(seq) - 2, 1))) AS p, seq FROM d WHERE length(seq) >= 4), k AS (SELECT seq_idx, p, seq[p:p + 3] AS kmer FROM x WHERE NOT contains(seq[p:p + 3], 'X'))"


@query(f"WITH {_DOCS}, {_LMERS} SELECT kmer, count(*)::BIGINT AS n, count(DISTINCT seq_idx)::BIGINT AS n_seqs FROM k GROUP BY 1")
def lmer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sim.lmer_counts(_docs(spark, sf))


@query(f"WITH {_BENCH}, {_LMERS} SELECT DISTINCT a.seq_idx AS i, b.seq_idx AS j, a.p::INT - 1 AS p FROM k a JOIN k b ON a.kmer = b.kmer AND a.seq_idx < b.seq_idx")
def shared_windows(spark: SparkSession, sf: str) -> DataFrame:
    return sim.shared_windows(_bench(spark, sf)).select("i", "j", "p")


@query(f"""WITH {_DOCS}, {_DIAG}, l AS (SELECT seq FROM d ORDER BY length(seq) DESC, seq_idx LIMIT 1)
SELECT length(seq)::INT AS longest, {', '.join(f"(SELECT sum(w) FROM m, (SELECT unnest(string_split(l.seq, '')) AS c) u WHERE name = '{n}' AND aa = c)::DOUBLE AS s_max_{i}" for i, n in enumerate(BLEND))} FROM l""")
def longest_weight(spark: SparkSession, sf: str) -> DataFrame:
    return sim.longest_weight(_docs(spark, sf), list(BLEND))


def _score_sql(blend: dict[str, float], alphabet: str | None) -> str:
    def covered(seq: str, tag: str) -> str:
        return f"""
{tag}s AS (SELECT seq_idx, {seq} AS seq FROM d),
{tag}k AS (SELECT seq_idx, p, seq[p:p + 3] AS kmer FROM (SELECT seq_idx, unnest(range(1, greatest(length(seq) - 2, 1))) AS p, seq FROM {tag}s WHERE length(seq) >= 4) WHERE NOT contains(seq[p:p + 3], 'X')),
{tag}c AS (SELECT DISTINCT a.seq_idx AS i, b.seq_idx AS j, a.p + o AS pos FROM {tag}k a JOIN {tag}k b ON a.kmer = b.kmer AND a.seq_idx < b.seq_idx, range(4) r(o)),
{tag}r AS (SELECT i, j, name, sum(w) AS raw FROM {tag}c JOIN {tag}s ON i = seq_idx JOIN m ON aa = seq[pos] GROUP BY ALL)"""

    weights = ", ".join(f"('{n}', {w})" for n, w in blend.items())
    parts, raw = covered("seq", "e"), "(SELECT i, j, name, raw FROM er)"
    if alphabet:
        parts += "," + covered(_low(alphabet), "q")
        raw = "(SELECT i, j, name, sum(raw) AS raw FROM (SELECT i, j, name, 0.7 * raw AS raw FROM er UNION ALL SELECT i, j, name, 0.3 * raw FROM qr) GROUP BY ALL)"
    return f"""WITH {_BENCH}, {_DIAG}, {parts},
l AS (SELECT seq FROM d ORDER BY length(seq) DESC, seq_idx LIMIT 1),
t AS (SELECT name, sum(w) AS s_max FROM l, LATERAL (SELECT unnest(string_split(l.seq, '')) AS c) u JOIN m ON aa = c GROUP BY 1),
b(name, share) AS (VALUES {weights})
SELECT i, j, round(sum(share * least(1.0, raw / s_max))::FLOAT::DOUBLE, 4) AS s FROM {raw} JOIN t USING (name) JOIN b USING (name) GROUP BY ALL"""


def _rounded(edges: DataFrame) -> DataFrame:
    # as round(s, 4) gives it, without decimals: ten thousand times a float is exact in double precision
    s = F.col("s").cast("double")
    whole = F.floor(s * 10_000 + 0.5) / 10_000
    return edges.select("i", "j", F.when(F.isnan(s), s).otherwise(whole).alias("s"))


@query(_score_sql({"BLOSUM62": 1.0}, None))
def sms_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(sim.motif_similarity(_bench(spark, sf), {"BLOSUM62": 1.0}, property_pass=False))


@query(_score_sql({"BLOSUM62": 1.0}, "murphy8"))
def sms_property8(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(sim.motif_similarity(_bench(spark, sf), {"BLOSUM62": 1.0}))


@query(_score_sql({"BLOSUM62": 1.0}, "murphy10"))
def sms_property10(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(sim.motif_similarity(_bench(spark, sf), {"BLOSUM62": 1.0}, alphabet="murphy10"))


@query(_score_sql(BLEND, "murphy8"))
def sms_blend(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: three matrices, exact and property passes."""
    return _rounded(sim.motif_similarity(_bench(spark, sf)))


_RUN_SQL = f"""{_BENCH}, {_LMERS},
hh AS (SELECT a.seq_idx AS i, b.seq_idx AS j, a.p - 1 AS px, b.p - 1 AS py FROM k a JOIN k b ON a.kmer = b.kmer AND a.seq_idx < b.seq_idx),
ii AS (SELECT *, px - row_number() OVER (PARTITION BY i, j, px - py ORDER BY px) AS island FROM hh),
rr AS (SELECT i, j, min(px)::INT AS px, min(py)::INT AS py, (count(*) + 3)::INT AS len FROM ii GROUP BY i, j, px - py, island)"""


@query(f"WITH {_RUN_SQL} SELECT * FROM rr")
def seed_runs(spark: SparkSession, sf: str) -> DataFrame:
    return sim.runs(_bench(spark, sf))


@query(f"""WITH {_RUN_SQL} SELECT * FROM rr m WHERE NOT EXISTS (SELECT 1 FROM rr o WHERE o.i = m.i AND o.j = m.j AND o.px <= m.px AND o.py <= m.py
  AND o.px + o.len >= m.px + m.len AND o.py + o.len >= m.py + m.len AND (o.px <> m.px OR o.py <> m.py OR o.len <> m.len))""")
def maximal_matches(spark: SparkSession, sf: str) -> DataFrame:
    return sim.maximal_matches(sim.runs(_bench(spark, sf)))


def _domains(d: DataFrame) -> DataFrame:
    return d.where("seq_idx % 3 <> 0").select("seq_idx", (F.col("seq_idx") % 7 + 1).cast("int").alias("start"), (F.col("seq_idx") % 7 + 40).cast("int").alias("end"))


@query(f"""WITH {_BENCH}, x AS (SELECT seq_idx, unnest(range(0, length(seq))) AS pos FROM d WHERE seq_idx % 3 <> 0)
SELECT seq_idx, pos::INT AS pos, CASE WHEN pos + 1 BETWEEN seq_idx % 7 + 1 AND seq_idx % 7 + 40 THEN 2.0 ELSE 0.5 END::DOUBLE AS w FROM x""")
def domain_mask(spark: SparkSession, sf: str) -> DataFrame:
    d = _bench(spark, sf)
    return sim.domain_positions(d, _domains(d)).select("seq_idx", "pos", F.col("w").cast("double").alias("w"))


@query(f"""WITH {_RUN_SQL}, {_DIAG},
pp AS (SELECT *, px + o AS x, py + o AS y FROM rr, range(100000) g(o) WHERE o < len),
ff AS (SELECT * FROM pp QUALIFY row_number() OVER (PARTITION BY i, j, x ORDER BY len DESC, px, py) = 1),
ww AS (SELECT i, j, w * sqrt(
    CASE WHEN i % 3 = 0 THEN 1.0 WHEN x + 1 BETWEEN i % 7 + 1 AND i % 7 + 40 THEN 2.0 ELSE 0.5 END *
    CASE WHEN j % 3 = 0 THEN 1.0 WHEN y + 1 BETWEEN j % 7 + 1 AND j % 7 + 40 THEN 2.0 ELSE 0.5 END) AS g
  FROM ff JOIN d ON seq_idx = i JOIN m ON name = 'BLOSUM62' AND aa = seq[x + 1]),
l AS (SELECT seq FROM d ORDER BY length(seq) DESC, seq_idx LIMIT 1),
t AS (SELECT sum(w) AS s_max FROM l, LATERAL (SELECT unnest(string_split(l.seq, '')) AS c) u JOIN m ON aa = c AND name = 'BLOSUM62')
SELECT i, j, round(least(1.0, sum(g) / max(s_max))::FLOAT::DOUBLE, 4) AS s FROM ww, t GROUP BY ALL""")
def sms_domain(spark: SparkSession, sf: str) -> DataFrame:
    d = _bench(spark, sf)
    return _rounded(sim.motif_similarity(d, {"BLOSUM62": 1.0}, property_pass=False, domains=_domains(d)))


_COSINE = """e AS (SELECT vec_id AS seq_idx, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT seq_idx, v, sqrt(list_dot_product(v, v)) + 1e-8 AS norm FROM e),
q AS (SELECT a.seq_idx AS i, b.seq_idx AS j, greatest(0.0, least(1.0, list_dot_product(a.v, b.v) / (a.norm * b.norm))) AS s FROM n a JOIN n b ON a.seq_idx < b.seq_idx)"""


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("seq_idx"), "embedding")


@query(f"WITH {_COSINE} SELECT i, j, round(s::FLOAT::DOUBLE, 4) AS s FROM q")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(sim.cosine_similarity(_vectors(spark, sf)))


@query(f"""WITH {_COSINE}, z AS ({_score_sql({'BLOSUM62': 1.0}, None).replace('round(sum(share * least(1.0, raw / s_max))::FLOAT::DOUBLE, 4)', 'sum(share * least(1.0, raw / s_max))::FLOAT::DOUBLE')})
SELECT coalesce(z.i, q.i) AS i, coalesce(z.j, q.j) AS j, round((0.5 * coalesce(z.s, 0) + 0.5 * coalesce(q.s::FLOAT::DOUBLE, 0))::FLOAT::DOUBLE, 4) AS s FROM z FULL JOIN q ON z.i = q.i AND z.j = q.j""")
def hybrid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    motif = sim.motif_similarity(_bench(spark, sf), {"BLOSUM62": 1.0}, property_pass=False)
    return _rounded(sim.blended_similarity(motif, _vectors(spark, sf)))


# --- trees ------------------------------------------------------------------


@query()
def upgma_tree(spark: SparkSession, sf: str) -> DataFrame:
    d = _bench(spark, sf)
    return tr.build_tree(d, sim.motif_similarity(d))


@query()
def nj_tree(spark: SparkSession, sf: str) -> DataFrame:
    d = _bench(spark, sf)
    return tr.build_tree(d, sim.motif_similarity(d), "nj")


@query()
def newick_text(spark: SparkSession, sf: str) -> DataFrame:
    text = tr.newick([r.asDict() for r in upgma_tree(spark, sf).collect()])
    return spark.createDataFrame([(text,)], "newick string")


@query()
def newick_nodes(spark: SparkSession, sf: str) -> DataFrame:
    text = newick_text(spark, sf).first()[0]
    return spark.createDataFrame(files.parse_newick(text), "node_id long, parent_id long, left_id long, right_id long, is_leaf boolean, seq_id string, branch_length double, n_leaves long, merge_similarity double, depth int")


def _heap(spark: SparkSession, sf: str) -> DataFrame:
    part = _t(spark, sf, "part")
    n = part.count()
    top = 1 << (2 * n - 1).bit_length() - 1
    k = F.col("node_id")
    nodes = spark.range(1, 2 * n).select(F.col("id").alias("node_id"), ((F.col("id") - 1) % n).alias("key"))
    nodes = nodes.join(part.select(F.col("p_partkey").alias("key"), "p_size", "p_retailprice").hint("merge"), "key")
    levels = range(n.bit_length() + 1)
    left = F.coalesce(*[F.when(k * (1 << t) >= n, k * (1 << t)) for t in levels])
    right = F.coalesce(*[F.when((k + 1) * (1 << t) - 1 >= n, (k + 1) * (1 << t) - 1) for t in levels])
    rank = lambda c: F.when(c >= top, c - top).otherwise(2 * n - top + c - n)
    leaf = k >= n
    nodes = nodes.select(
        "node_id",
        F.when(k > 1, F.shiftright(k, 1)).alias("parent_id"),
        F.when(~leaf, 2 * k).alias("left_id"),
        F.when(~leaf, 2 * k + 1).alias("right_id"),
        leaf.alias("is_leaf"),
        F.when(leaf, F.concat(F.lit("n"), k.cast("string"))).alias("seq_id"),
        ((F.col("p_retailprice") % 100) / 100).alias("branch_length"),
        F.when(~leaf, F.least(F.lit(1.0), F.col("p_size") / 50.0)).alias("merge_similarity"),
        (F.floor(F.log2(k.cast("double") + 0.5))).cast("int").alias("depth"),
        rank(left).alias("lo"),
        rank(right).alias("hi"),
    )
    nodes = nodes.withColumn("n_leaves", F.col("hi") - F.col("lo") + 1)
    # of the leaves up to a node's last, each joins one earlier tree but those where the way down goes right
    return nodes.withColumn("post", 2 * (F.col("hi") + 1) - F.bit_count("node_id"))


_HEAP = """c AS (SELECT count(*)::BIGINT AS n FROM part),
v AS (SELECT k AS node_id, n, k >= n AS is_leaf, CASE WHEN k > 1 THEN k >> 1 END AS parent_id, (p_retailprice % 100) / 100 AS bl,
    CASE WHEN k < n THEN least(1.0, p_size / 50.0) END AS sim FROM c, LATERAL (SELECT unnest(range(1, 2 * n)) AS k) u JOIN part ON p_partkey = (k - 1) % n),
a AS (SELECT node_id AS id, node_id >> t AS up FROM v, range(0, 40) r(t) WHERE node_id >> t > 0),
nl AS (SELECT up AS node_id, count(*) AS n_leaves FROM a JOIN v ON v.node_id = id AND is_leaf GROUP BY 1),
lw AS (SELECT a.id AS node_id, sum(x.bl / p.n_leaves) AS weight FROM a JOIN v y ON y.node_id = a.id AND y.is_leaf JOIN v x ON x.node_id = a.up JOIN nl p ON p.node_id = x.parent_id GROUP BY 1),
nw AS (SELECT up AS node_id, sum(weight) AS weight FROM a JOIN lw ON lw.node_id = a.id GROUP BY 1),
cs AS (SELECT v.node_id, CASE WHEN l.weight + r.weight = 0 THEN 0.0 ELSE l.weight * r.weight / (l.weight + r.weight) * sim END AS cosim
  FROM v JOIN nw l ON l.node_id = 2 * v.node_id JOIN nw r ON r.node_id = 2 * v.node_id + 1 WHERE NOT is_leaf)"""


@query(f"""WITH {_HEAP}, o AS (SELECT node_id, row_number() OVER (ORDER BY node_id * (1 << (20 - floor(log2(node_id + 0.5))::INT))) - 1 AS rank FROM v WHERE is_leaf),
w AS (SELECT up AS node_id, min(rank) AS lo, max(rank) AS hi FROM a JOIN o ON o.node_id = a.id GROUP BY 1),
e AS (
  SELECT lo AS rank, 0 AS side, floor(log2(node_id + 0.5)) AS turn, CASE WHEN node_id > 1 AND node_id % 2 = 1 THEN ',' ELSE '' END || CASE WHEN is_leaf THEN '' ELSE '(' END AS piece FROM v JOIN w USING (node_id)
  UNION ALL SELECT hi, 1, -floor(log2(node_id + 0.5)), CASE WHEN is_leaf THEN 'n' || node_id ELSE ')' END || CASE WHEN node_id = 1 THEN ';' ELSE ':' || printf('%.6f', bl) END FROM v JOIN w USING (node_id))
SELECT row_number() OVER (ORDER BY rank, side, turn) - 1 AS at, piece FROM e WHERE piece <> ''""")
def newick_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The text of the heap-shaped tree, piece by piece."""
    return files.numbered(tr.newick_pieces(_heap(spark, sf)), "at").select(F.col("seq_idx").alias("at"), "piece")


@query(f"WITH {_HEAP} SELECT node_id, round(weight + 1e-9, 6) AS weight FROM lw")
def leaf_weights(spark: SparkSession, sf: str) -> DataFrame:
    return cl.leaf_weights(_heap(spark, sf)).select("node_id", F.round(F.col("weight") + 1e-9, 6).alias("weight"))


@query(f"WITH {_HEAP} SELECT node_id, round(weight + 1e-9, 6) AS weight FROM nw")
def node_weights(spark: SparkSession, sf: str) -> DataFrame:
    return cl.node_weights(_heap(spark, sf)).select("node_id", F.round(F.col("weight") + 1e-9, 6).alias("weight"))


@query(f"WITH {_HEAP} SELECT node_id, round(cosim + 1e-9, 6) AS cosim FROM cs")
def cosimilarity(spark: SparkSession, sf: str) -> DataFrame:
    return cl.cosimilarity(_heap(spark, sf)).select("node_id", F.round(F.col("cosim") + 1e-9, 6).alias("cosim"))


@query("WITH c AS (SELECT count(*)::BIGINT AS n FROM part), k AS (SELECT unnest(range(1, 2 * n)) AS node_id FROM c) SELECT k.node_id, count(*)::INT - 1 AS depth FROM k, range(0, 40) r(t) WHERE k.node_id >> t > 0 GROUP BY 1")
def depths(spark: SparkSession, sf: str) -> DataFrame:
    return cl.depths(_heap(spark, sf))


@query(f"""WITH {_HEAP}, s AS (SELECT a.id AS node_id, sum(x.bl) AS x FROM a JOIN v x ON x.node_id = a.up GROUP BY 1),
o AS (SELECT node_id, row_number() OVER (ORDER BY node_id * (1 << (20 - floor(log2(node_id + 0.5))::INT))) - 1 AS rank FROM v WHERE is_leaf)
SELECT node_id, round(x + 1e-9, 6) AS x, rank::BIGINT AS rank FROM s LEFT JOIN o USING (node_id)""")
def tree_layout(spark: SparkSession, sf: str) -> DataFrame:
    return cl.layout(_heap(spark, sf)).select("node_id", F.round(F.col("x") + 1e-9, 6).alias("x"), "rank")


@query(f"""WITH {_HEAP}, s AS (SELECT a.id AS node_id, sum(x.bl) AS r FROM a JOIN v x ON x.node_id = a.up GROUP BY 1),
o AS (SELECT node_id, n, row_number() OVER (ORDER BY node_id * (1 << (20 - floor(log2(node_id + 0.5))::INT))) - 1 AS rank FROM v WHERE is_leaf)
SELECT node_id, round(r * cos(2 * pi() * rank / n), 4) + 0.0 AS x, round(r * sin(2 * pi() * rank / n), 4) + 0.0 AS y FROM s JOIN o USING (node_id)""")
def radial_layout(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _heap(spark, sf)
    points = cl.radial_layout(nodes).join(nodes.where("is_leaf").select("node_id").hint("merge"), "node_id")
    return points.select("node_id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


#: A node stands where its leaves stand, each weighing half as much for each step down to it.
_MIDDLE = f"""{_HEAP}, s AS (SELECT a.id AS node_id, sum(x.bl) AS r FROM a JOIN v x ON x.node_id = a.up GROUP BY 1),
o AS (SELECT node_id, row_number() OVER (ORDER BY node_id * (1 << (20 - floor(log2(node_id + 0.5))::INT))) - 1 AS rank FROM v WHERE is_leaf),
y AS (SELECT up AS node_id, sum(rank / pow(2, floor(log2(a.id + 0.5)) - floor(log2(a.up + 0.5)))) AS y FROM a JOIN o ON o.node_id = a.id GROUP BY 1)"""


@query(f"WITH {_MIDDLE} SELECT node_id, round(r + 1e-9, 6) AS x, round(y + 1e-9, 6) AS y FROM s JOIN y USING (node_id)")
def layout_y(spark: SparkSession, sf: str) -> DataFrame:
    return cl.layout_points(_heap(spark, sf)).select("node_id", F.round(F.col("x") + 1e-9, 6).alias("x"), F.round(F.col("y") + 1e-9, 6).alias("y"))


@query(f"WITH {_MIDDLE} SELECT node_id, round(r * cos(2 * pi() * y / n), 4) + 0.0 AS x, round(r * sin(2 * pi() * y / n), 4) + 0.0 AS y FROM s JOIN y USING (node_id), c")
def radial_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return cl.radial_layout(_heap(spark, sf)).select("node_id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


_OTSU = f"""{_HEAP}, z AS (SELECT min(cosim) AS lo, max(cosim) AS hi, count(*) AS n FROM cs),
th AS (SELECT k, CASE WHEN k = 199 THEN hi ELSE lo + k * ((hi - lo) / 199) END AS t FROM z, range(200) r(k)),
va AS (SELECT k, t, count(*) FILTER (cosim <= t) AS nl, count(*) FILTER (cosim > t) AS nh, avg(cosim) FILTER (cosim <= t) AS ml, avg(cosim) FILTER (cosim > t) AS mh FROM th, cs GROUP BY ALL),
ot AS (SELECT t FROM (SELECT nl, min(k) AS k, min(t) AS t, max(nl * nh / ((nl + nh) * (nl + nh))::DOUBLE * (ml - mh) * (ml - mh)) AS var FROM va WHERE nl > 0 AND nh > 0 GROUP BY nl) ORDER BY var DESC, k LIMIT 1)"""


@query(f"WITH {_OTSU} SELECT round(t, 6) AS threshold FROM ot")
def otsu(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(round(cl.otsu(cl.cosimilarity(_heap(spark, sf))), 6),)], "threshold double")


@query(f"""WITH {_HEAP}, r AS (SELECT cosim, row_number() OVER (ORDER BY cosim) - 1 AS rn, count(*) OVER () AS n, min(cosim) OVER () AS lo, max(cosim) OVER () AS hi FROM cs),
d AS (SELECT cosim, rn, (cosim - lo) / greatest(hi - lo, 1e-12) - rn / (n - 1)::DOUBLE AS d FROM r)
SELECT round(min_by(cosim, rn), 6) AS threshold FROM d WHERE d >= (SELECT max(d) FROM d) - 1e-12""")
def kneedle(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(round(cl.kneedle(cl.cosimilarity(_heap(spark, sf))), 6),)], "threshold double")


@query()
def gmm(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(cl.gmm(cl.cosimilarity(_heap(spark, sf))),)], "threshold double")


@query(f"WITH {_OTSU} SELECT node_id FROM cs, ot WHERE cosim <= t")
def cut_nodes(spark: SparkSession, sf: str) -> DataFrame:
    cosim = cl.cosimilarity(_heap(spark, sf))
    return cl.cut_nodes(cosim, cl.otsu(cosim))


#: For extraction the cuts are nodes of low merge similarity, which leave clusters, orphans and leaves in no group.
_GROUPS = f"""{_HEAP}, cu AS (SELECT node_id FROM v WHERE NOT is_leaf AND sim <= 0.1),
dirty AS (SELECT DISTINCT up AS node_id FROM a JOIN cu ON cu.node_id = a.id),
ro AS (SELECT node_id, row_number() OVER (ORDER BY node_id * (1 << (20 - floor(log2(node_id + 0.5))::INT))) - 1 AS rank FROM v WHERE is_leaf),
po AS (SELECT up AS node_id, max(rank) AS hi FROM a JOIN ro ON ro.node_id = a.id GROUP BY 1),
gr AS (SELECT v.node_id, n_leaves, hi AS phi, -floor(log2(v.parent_id + 0.5)) AS pdepth, v.node_id % 2 AS side FROM v JOIN cu ON cu.node_id = v.parent_id JOIN nl ON nl.node_id = v.node_id JOIN po ON po.node_id = v.parent_id
  WHERE v.node_id NOT IN (SELECT node_id FROM dirty)),
gi AS (SELECT *, row_number() OVER (ORDER BY phi, pdepth, side) - 1 AS idx FROM gr WHERE n_leaves >= 2),
cf AS (SELECT 'n' || a.id AS seq_id, idx::INT AS cluster_idx, idx IS NULL AS is_orphan FROM gr LEFT JOIN gi ON gi.node_id = gr.node_id JOIN a ON a.up = gr.node_id JOIN v ON v.node_id = a.id AND v.is_leaf)"""


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _heap(spark, sf)
    return cl.extract(nodes, nodes.where("merge_similarity <= 0.1").select("node_id"))


@query(f"WITH {_GROUPS} SELECT * FROM cf")
def extract_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("seq_id", "cluster_idx", "is_orphan")


@query(f"WITH {_GROUPS} SELECT 'n' || node_id AS seq_id FROM v WHERE is_leaf AND 'n' || node_id NOT IN (SELECT seq_id FROM cf)")
def unassigned_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return cl.unassigned(_heap(spark, sf), _extracted(spark, sf))


@query(f"WITH {_GROUPS} SELECT cluster_idx + 1 AS cluster_id, seq_id, count(*) OVER (PARTITION BY cluster_idx)::BIGINT AS cluster_size FROM cf WHERE NOT is_orphan")
def cluster_table(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.cluster_table(_extracted(spark, sf)).select("cluster_id", "seq_id", "cluster_size")


@query(f"WITH {_GROUPS} SELECT seq_id FROM cf WHERE is_orphan")
def orphan_table(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.orphan_table(_extracted(spark, sf)).select("seq_id")


@query(f"WITH {_GROUPS} SELECT cluster_idx, count(*)::BIGINT AS size FROM cf WHERE NOT is_orphan GROUP BY 1")
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.sizes(_extracted(spark, sf))


@query(f"""WITH {_OTSU}, b AS (SELECT cosim, cosim <= t AS is_cut FROM cs, ot), s AS (SELECT is_cut, min(cosim) AS lo, max(cosim) AS hi, least(60, greatest(15, floor(2 * sqrt(count(*)))))::INT AS bins FROM b GROUP BY 1)
SELECT is_cut, CASE WHEN hi = lo THEN bins // 2 ELSE least(bins - 1, floor((cosim - lo) / (hi - lo) * bins)) END::INT AS bin, count(*)::BIGINT AS n FROM b JOIN s USING (is_cut) GROUP BY ALL""")
def cosim_histogram(spark: SparkSession, sf: str) -> DataFrame:
    cosim = cl.cosimilarity(_heap(spark, sf))
    return ev.cosim_histogram(cosim, cl.otsu(cosim))


@query(f"""WITH {_GROUPS}, k AS (SELECT 'n' || node_id AS seq_id, node_id AS seq_idx, rank FROM ro)
SELECT k.seq_id, row_number() OVER (ORDER BY CASE WHEN cluster_idx IS NOT NULL THEN 0 WHEN is_orphan THEN 1 ELSE 2 END, cluster_idx NULLS FIRST, CASE WHEN cluster_idx IS NOT NULL THEN -rank ELSE 0 END, seq_idx)::INT - 1 AS place FROM k LEFT JOIN cf ON cf.seq_id = k.seq_id""")
def heatmap_order(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _heap(spark, sf)
    return cl.heatmap_order(_extracted(spark, sf), nodes.where("is_leaf").select("seq_id", F.col("node_id").alias("seq_idx")))


# --- weights, evaluation, terms ---------------------------------------------


@query("""WITH o AS (SELECT 'c' || c_custkey AS seq_id, n_name AS organism FROM customer JOIN nation ON c_nationkey = n_nationkey), k AS (SELECT organism, count(*) AS c FROM o GROUP BY 1)
SELECT seq_id, round((SELECT sum(c) FROM k) / (c * (SELECT count(*) FROM k)), 6) AS weight FROM o JOIN k USING (organism)""")
def taxon_simple(spark: SparkSession, sf: str) -> DataFrame:
    return prep.taxon_weights(_organisms(spark, sf)).select("seq_id", F.round(F.col("weight") + 1e-9, 6).alias("weight"))


def _organisms(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("seq_id"), F.col("n_name").alias("organism"))


@query("""WITH o AS (SELECT 'c' || c_custkey AS seq_id, n_name AS organism, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT organism, r, count(*) AS c FROM o GROUP BY ALL), n AS (SELECT sum(c) AS n FROM k),
w AS (SELECT a.organism, a.c, 1 / (1 + sum(CASE WHEN a.organism = b.organism THEN 1.0 * (b.c - 1) WHEN a.r = b.r THEN 0.5 * b.c ELSE 0 END) / (max(n) - 1)) AS raw FROM k a, k b, n GROUP BY ALL)
SELECT seq_id, round(raw * (SELECT n FROM n) / (SELECT sum(raw * c) FROM w), 6) AS weight FROM o JOIN w USING (organism)""")
def taxon_phylogenetic(spark: SparkSession, sf: str) -> DataFrame:
    lineages = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("organism"), F.array("r_name", "n_name").alias("lineage"))
    return prep.taxon_weights_phylogenetic(_organisms(spark, sf), lineages).select("seq_id", F.round(F.col("weight") + 1e-9, 6).alias("weight"))


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Clusters by id range with some orphans, and the embedding labels as reference."""
    e = _t(spark, sf, "embeddings")
    sid = F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("seq_id")
    cluster = F.when(F.col("vec_id") % 11 != 0, ((F.col("label") * 3 + F.col("vec_id") % 4) % 7).cast("int")).alias("cluster_idx")
    return e.select(sid, F.col("vec_id").alias("seq_idx"), cluster), e.where("vec_id % 13 <> 0").select(sid, F.col("label").cast("string").alias("functional_group"))


_LABELLED = """f AS (SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN (label * 3 + vec_id % 4) % 7 END AS cluster_idx, CASE WHEN vec_id % 13 <> 0 THEN label::VARCHAR END AS g FROM embeddings),
y AS (SELECT vec_id, coalesce(g, 'unknown') AS truth, coalesce(cluster_idx::VARCHAR, 'orphan') AS predicted FROM f),
ce AS (SELECT truth, predicted, count(*) AS n FROM y GROUP BY ALL), ta AS (SELECT truth, sum(n) AS a FROM ce GROUP BY 1), pb AS (SELECT predicted, sum(n) AS b FROM ce GROUP BY 1), nn AS (SELECT sum(n) AS n FROM ce)"""


def _q_sql(w: str) -> str:
    return f"""WITH {_LABELLED}, s AS (SELECT cluster_idx, g, sum({w}) AS w FROM f WHERE cluster_idx IS NOT NULL AND g IS NOT NULL GROUP BY ALL), b AS (SELECT cluster_idx, max(w) AS w FROM s GROUP BY 1)
SELECT round(greatest(0.0, least(100.0, ((SELECT sum(w) FROM b) - count(*) FILTER (cluster_idx IS NULL)) / count(*) * 100.0)), 6) AS q FROM f"""


@query(_q_sql("1.0"))
def q_measure(spark: SparkSession, sf: str) -> DataFrame:
    found, ref = _labelled(spark, sf)
    return ev.q_measure(found, ref).select(F.round("q", 6).alias("q"))


@query(_q_sql("CASE WHEN vec_id % 2 = 0 THEN 0.5 ELSE 1.25 END"))
def q_measure_weighted(spark: SparkSession, sf: str) -> DataFrame:
    found, ref = _labelled(spark, sf)
    weights = found.select("seq_id", F.when(F.col("seq_idx") % 2 == 0, 0.5).otherwise(1.25).alias("weight"))
    return ev.q_measure(found, ref, weights).select(F.round("q", 6).alias("q"))


@query(f"""WITH {_LABELLED}, s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM ce) AS x, (SELECT sum(a * (a - 1) / 2.0) FROM ta) AS t, (SELECT sum(b * (b - 1) / 2.0) FROM pb) AS p, (SELECT n * (n - 1) / 2.0 FROM nn) AS m)
SELECT round((x - t * p / m) / ((t + p) / 2 - t * p / m), 6) AS ari FROM s""")
def adjusted_rand(spark: SparkSession, sf: str) -> DataFrame:
    found, ref = _labelled(spark, sf)
    return ev.adjusted_rand(ev.label_pairs(found, found, ref)).select(F.round("ari", 6).alias("ari"))


@query(f"""WITH {_LABELLED}, s AS (SELECT (SELECT sum(ce.n / nn.n * ln(ce.n * nn.n / (a * b))) FROM ce JOIN ta USING (truth) JOIN pb USING (predicted), nn) AS mi, (SELECT -sum(a / n * ln(a / n)) FROM ta, nn) AS ha, (SELECT -sum(b / n * ln(b / n)) FROM pb, nn) AS hb)
SELECT round(mi / ((ha + hb) / 2), 6) AS nmi FROM s""")
def mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    found, ref = _labelled(spark, sf)
    return ev.mutual_information(ev.label_pairs(found, found, ref)).select(F.round("nmi", 6).alias("nmi"))


@query(f"""WITH {_LABELLED}, {_COSINE}, dd AS (SELECT i AS a, j AS b, 1 - s AS d FROM q UNION ALL SELECT j, i, 1 - s FROM q),
me AS (SELECT dd.a, y.predicted AS c, x.predicted AS own, avg(d) AS m FROM dd JOIN y ON y.vec_id = dd.b JOIN y x ON x.vec_id = dd.a GROUP BY ALL),
si AS (SELECT a, max(m) FILTER (c = own) AS x, min(m) FILTER (c <> own) AS z FROM me GROUP BY 1)
SELECT round(avg(CASE WHEN x IS NULL OR greatest(x, z) = 0 THEN 0 ELSE (z - x) / greatest(x, z) END), 4) AS silhouette FROM si""")
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    found, ref = _labelled(spark, sf)
    labels = ev.label_pairs(found, found, ref).join(found.select("seq_id", "seq_idx"), "seq_id").select("seq_idx", "predicted")
    return ev.silhouette_of_sums(labels, sim.cosine_sums(_vectors(spark, sf).join(labels, "seq_idx"))).select(F.round("silhouette", 4).alias("silhouette"))


def _terms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as sequences, their language and source as terms, clusters by source number."""
    d = _t(spark, sf, "documents")
    sid = F.col("doc_id").cast("string").alias("seq_id")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    cluster = F.when(F.col("doc_id") % 9 != 0, ((number + F.length("lang") + F.ascii("lang") + F.col("doc_id") % 2) % 6).cast("int")).alias("cluster_idx")
    return d.select(sid, cluster), d.select(sid, F.array("lang", "source", "lang").alias("go_terms"))


_TERMS = """f AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN (regexp_extract(source, '(\\d+)$', 1)::INT + length(lang) + ascii(lang) + doc_id % 2) % 6 END AS cluster_idx, lang, source FROM documents),
te AS (SELECT doc_id, cluster_idx, lang AS term FROM f UNION SELECT doc_id, cluster_idx, source FROM f),
bg AS (SELECT term, count(*) AS big_k FROM te GROUP BY 1), nn AS (SELECT count(*) AS big_n FROM f), sz AS (SELECT cluster_idx, count(*) AS n FROM f WHERE cluster_idx IS NOT NULL GROUP BY 1),
kk AS (SELECT cluster_idx, term, count(*) AS k FROM te WHERE cluster_idx IS NOT NULL GROUP BY ALL),
al AS (SELECT cluster_idx, term, k, n, big_k, big_n FROM kk JOIN sz USING (cluster_idx) JOIN bg USING (term), nn),
fi AS (SELECT cluster_idx, term, k, n, big_k, big_n, least(1.0, sum(exp(lgamma(big_k + 1) - lgamma(x + 1) - lgamma(big_k - x + 1) + lgamma(big_n - big_k + 1) - lgamma(n - x + 1) - lgamma(big_n - big_k - n + x + 1)
  - lgamma(big_n + 1) + lgamma(n + 1) + lgamma(big_n - n + 1)))) AS p FROM al, LATERAL (SELECT unnest(range(k, least(n, big_k) + 1)) AS x) u WHERE big_n - big_k - n + x >= 0 GROUP BY ALL),
bh AS (SELECT *, row_number() OVER (PARTITION BY cluster_idx ORDER BY p, term) AS r, count(*) OVER (PARTITION BY cluster_idx) AS m FROM fi)"""


@query(f"WITH {_TERMS} SELECT term, big_k::BIGINT AS n FROM bg")
def term_background(spark: SparkSession, sf: str) -> DataFrame:
    _, terms = _terms(spark, sf)
    return terms.select(F.explode(F.array_distinct("go_terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"""WITH {_TERMS} SELECT cluster_idx::INT AS cluster_idx, term, k::BIGINT AS k, n::BIGINT AS n, big_k::BIGINT AS big_k, round(p, 6) AS p,
  coalesce(r <= max(CASE WHEN p <= r / m * 0.05 THEN r END) OVER (PARTITION BY cluster_idx), false) AS enriched FROM bh""")
def term_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    return ev.enrichment(*_terms(spark, sf)).select("cluster_idx", "term", "k", "n", "big_k", F.round("p", 6).alias("p"), "enriched")


def _ontology(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as terms: each part but the first is a child of the part of half its number."""
    return _t(spark, sf, "part").where("p_partkey >= 1").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("child"), F.concat(F.lit("t"), F.shiftright("p_partkey", 1).cast("string")).alias("parent"))


@query("SELECT 't' || p_partkey AS term, 't' || (p_partkey >> t) AS ancestor FROM part, range(1, 40) r(t) WHERE p_partkey >> (t - 1) > 0")
def term_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return ev.ancestors(_ontology(spark, sf))


@query("""WITH e AS (SELECT p_size % 5 AS cluster_idx, p_partkey AS k FROM part), up AS (SELECT DISTINCT cluster_idx, k >> t AS k FROM e, range(1, 40) r(t) WHERE k >> (t - 1) > 0)
SELECT cluster_idx::INT AS cluster_idx, 't' || k AS term FROM e WHERE (cluster_idx, k) NOT IN (SELECT cluster_idx, k FROM up)""")
def term_reduction(spark: SparkSession, sf: str) -> DataFrame:
    found = _t(spark, sf, "part").select((F.col("p_size") % 5).cast("int").alias("cluster_idx"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("term"))
    return ev.reduce_terms(found, _ontology(spark, sf))


# --- annotations, caches, sinks ---------------------------------------------


def _accession(number) -> F.Column:
    return F.concat(F.lit("P"), F.lpad(F.conv(number.cast("string"), 10, 36), 5, "0"))


def _answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as proteins: ids, and service answers for most of them as JSON, some unreadable."""
    d = _t(spark, sf, "documents")
    number, acc = F.col("doc_id"), _accession(F.col("doc_id"))
    ids = d.select(F.when(number % 5 == 0, F.concat(F.lit("own"), number)).otherwise(F.concat(F.lit("sp|"), acc, F.lit("|X"))).alias("seq_id"))
    value = lambda c: F.struct(F.struct(c.alias("value")).alias("fullName"))
    terms = F.array(
        F.struct(F.lit("GO").alias("database"), F.concat(F.lit("GO:"), (number % 50).cast("string")).alias("id")),
        F.struct(F.lit("PDB").alias("database"), F.lit("1ABC").alias("id")),
        F.struct(F.lit("GO").alias("database"), F.concat(F.lit("GO:"), (number % 7 + 50).cast("string")).alias("id")),
    )
    record = F.struct(
        F.when(number % 2 == 0, "UniProtKB reviewed (Swiss-Prot)").otherwise("UniProtKB unreviewed (TrEMBL)").alias("entryType"),
        F.when(number % 11 != 0, acc).alias("primaryAccession"),
        F.struct(F.when(number % 3 != 0, value(F.col("source"))).alias("recommendedName")).alias("proteinDescription"),
        F.struct(F.col("lang").alias("scientificName"), number.alias("taxonId")).alias("organism"),
        F.array(F.struct(F.struct(F.concat(F.lit("g"), (number % 10).cast("string")).alias("value")).alias("geneName"))).alias("genes"),
        F.when(number % 4 != 0, terms).alias("uniProtKBCrossReferences"),
    )
    proteins = d.where("doc_id % 7 <> 0").select(acc.alias("accession"), F.when(number % 13 == 0, "{odd").otherwise(F.to_json(record)).alias("json"))
    spot = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    inner = F.struct(F.array(F.struct(F.array(spot(number % 20 + 1, number % 20 + 9), spot(number % 20 + 30, number % 20 + 44)).alias("fragments"))).alias("entry_protein_locations"))
    entry = F.struct(F.struct(F.concat(F.lit("IPR"), (number % 30).cast("string")).alias("accession"), F.col("lang").alias("name")).alias("metadata"), F.array(inner).alias("proteins"))
    domains = d.where("doc_id % 3 = 1").select(acc.alias("accession"), F.to_json(F.struct(F.array(entry).alias("results"))).alias("json"))
    return ids, proteins, domains


_PROTEINS = """p AS (SELECT doc_id AS k, lang, source, 'P' || to_base(doc_id, 36, 5) AS acc, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 13 <> 0 AND doc_id % 11 <> 0 AS known FROM documents),
r AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'own' || k ELSE 'sp|' || acc || '|X' END AS seq_id, known, acc, lang, source FROM p)"""


@query(f"""WITH {_PROTEINS}
SELECT seq_id, CASE WHEN known THEN acc END AS accession, CASE WHEN known AND k % 3 <> 0 THEN source ELSE '' END AS protein_name,
  CASE WHEN known THEN 'g' || k % 10 ELSE '' END AS gene_name, CASE WHEN known THEN lang ELSE 'Unknown' END AS organism, CASE WHEN known THEN k END AS taxon_id,
  known AND k % 2 = 0 AS reviewed, CASE WHEN known AND k % 4 <> 0 THEN 'GO:' || k % 50 || ',GO:' || k % 7 + 50 ELSE '' END AS go_terms FROM r""")
def annotation_records(spark: SparkSession, sf: str) -> DataFrame:
    """Service answers read into annotations, stubs where there is none."""
    out = files.annotations(*_answers(spark, sf))
    return out.drop("domains").withColumn("go_terms", F.array_join("go_terms", ","))


@query(f"""WITH {_PROTEINS}
SELECT seq_id, 'IPR' || k % 30 AS interpro_id, lang AS name, (k % 20 + a)::INT AS "start", (k % 20 + b)::INT AS "end"
FROM r, (VALUES (1, 9), (30, 44)) f(a, b) WHERE k % 3 = 1 AND k % 5 <> 0""")
def domain_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Domain answers flattened to one row a fragment."""
    out = files.annotations(*_answers(spark, sf)).select("seq_id", F.explode("domains").alias("d"))
    return out.select("seq_id", "d.interpro_id", "d.name", "d.start", "d.end")


@query(SQL["annotation_records"])
def annotation_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations through a cache that a first run fills while half of the answers have not landed."""
    ids, proteins, domains = _answers(spark, sf)
    folder = new_folder(spark, "answers")
    for name, some in (("half", proteins.where(F.crc32("accession") % 2 == 0)), ("whole", proteins)):
        some.write.parquet(f"{folder}/{name}/proteins")
        domains.write.parquet(f"{folder}/{name}/domains")
        out = files.annotate(ids, f"{folder}/{name}", f"{folder}/cache")
    return out.drop("domains").withColumn("go_terms", F.array_join("go_terms", ","))


@query("SELECT d.doc_id, l.quality FROM documents d JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id)")
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as keys, labels as a cache."""
    return files.cached(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels").select("doc_id", "quality").distinct(), "doc_id")[0]


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    return files.cached(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels").select("doc_id"), "doc_id")[1]


@query("SELECT 't' || p_partkey AS child, 't' || (p_partkey >> 1) AS parent FROM part WHERE p_partkey > 1")
def ontology_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Parts written as an OBO file, a block each, and read back."""
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("t"), c.cast("string"))
    up = F.when(k > 1, F.concat(F.lit("is_a: "), name(F.shiftright(k, 1)), F.lit(" ! part"))).otherwise(F.lit("is_obsolete: true"))
    block = F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: "), name(k)), F.concat(F.lit("name: "), F.col("p_name")), up)
    folder = new_folder(spark, "ontology")
    _t(spark, sf, "part").select(block.alias("value")).write.text(folder)
    return files.ontology_edges(files.read_ontology(spark, folder))


@query(f"""WITH {_GROUPS} SELECT cluster_idx + 1 AS cluster_id, seq_id, '>' || seq_id || '  ' || CASE WHEN cluster_idx IS NULL THEN 'orphan' ELSE 'cluster=' || (cluster_idx + 1) END || chr(10) || 'SEQ' || seq_id AS record FROM cf""")
def fasta_records(spark: SparkSession, sf: str) -> DataFrame:
    leaves = _heap(spark, sf).where("is_leaf").select("seq_id", F.concat(F.lit("SEQ"), "seq_id").alias("seq"))
    return sinks.fasta_records(_extracted(spark, sf), leaves)


@query(f"""WITH {_TERMS}, en AS (SELECT cluster_idx, term, p, coalesce(r <= max(CASE WHEN p <= r / m * 0.05 THEN r END) OVER (PARTITION BY cluster_idx), false) AS enriched FROM bh)
SELECT (cluster_idx + 1)::INT AS cluster_id, term AS go_id, round(p, 6) AS p_value, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS genes
FROM en JOIN te USING (cluster_idx, term) WHERE enriched GROUP BY cluster_idx, term, p""")
def term_table(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched terms with the documents of the cluster that have them."""
    found, terms = _terms(spark, sf)
    tests = ev.enrichment(found, terms).where("enriched")
    return sinks.term_table(found, terms, tests).select("cluster_id", "go_id", F.round("p_value", 6).alias("p_value"), "genes")


@query(f"""WITH {_GROUPS}, z AS (SELECT cluster_idx, count(*) AS n FROM cf WHERE NOT is_orphan GROUP BY 1)
SELECT (SELECT count(*) FROM cf) AS n_sequences, (SELECT count(*) FROM cf WHERE is_orphan) AS n_orphans, count(*) AS n_clusters, string_agg(n::VARCHAR, ',' ORDER BY n DESC, cluster_idx) AS cluster_sizes FROM z""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    info = sinks.summary(_extracted(spark, sf), {}, {})
    row = (info["n_sequences"], info["n_orphans"], info["n_clusters"], ",".join(map(str, info["cluster_sizes"])))
    return spark.createDataFrame([row], "n_sequences long, n_orphans long, n_clusters long, cluster_sizes string")


@query("""WITH w AS (SELECT 'd' || doc_id AS seq_id, translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS seq FROM documents)
SELECT seq_id FROM w WHERE length(seq) < 10 OR regexp_matches(seq, '[^ACDEFGHIKLMNPQRSTVWYX]') ORDER BY seq_id LIMIT 15""")
def dropped_head(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifteen dropped sequences, as the run logs them."""
    rows = [(x.split(":")[0],) for x in sinks.dropped_head(validate_dropped(spark, sf))]
    return spark.createDataFrame(rows, "seq_id string")


@query("""WITH v AS (SELECT 1 - 1.0::DOUBLE / (1 + p_partkey) AS v FROM part), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rn, count(*) OVER () AS n, min(v) OVER () AS lo, max(v) OVER () AS hi FROM v),
d AS (SELECT v, rn, (v - lo) / greatest(hi - lo, 1e-12) - rn / (n - 1)::DOUBLE AS d FROM r)
SELECT round(min_by(v, rn), 6) AS threshold FROM d WHERE d >= (SELECT max(d) FROM d) - 1e-12""")
def kneedle_inner(spark: SparkSession, sf: str) -> DataFrame:
    """A curve with its knee inside."""
    values = _t(spark, sf, "part").select((1 - F.lit(1.0) / (1 + F.col("p_partkey"))).alias("v"))
    return spark.createDataFrame([(round(cl.kneedle(values, "v"), 6),)], "threshold double")


_ = ALPHABETS, reduced
