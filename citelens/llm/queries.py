"""The queries of the ten operators over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.llm import anisotropic_ann, language_id, license_scan, line_dedup, lsh_forest, merkle, mixing, mpeg_audio, order_minhash, packing, periodic_runs, sharding, toxicity
from citelens.llm.shared import WORD, ascii_lower, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.drop_boilerplate_lines(table(spark, sf_dir, "documents"), text="text", host="source")
    return clean.select("doc_id", "text", "n_lines", "n_dropped")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return documents.select(F.col("id").alias("doc_id"), "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", "shard_taken")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.OrdinalModel:
    return toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity_model(spark, sf_dir, docs))


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), width=4).drop("text_key", "first")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    size = (F.coalesce(F.octet_length(raw), F.lit(0)) + 16).cast("long")
    rows = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"))
    sharded = sharding.shuffle_to_shards(rows, ["doc_id", "size", "text_crc32"], shards=40)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "batch", "place")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    references = language_id.reference_texts(docs.filter(~held_out), "doc_id", "text", "lang", chars=120_000)
    predicted = language_id.predict_language(docs, references)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return license_scan.license_report(docs, ["doc_id", "text_key"]).drop("text_key")


def op9_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return anisotropic_ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    padding = F.greatest(F.ceil(n / 64) * 64, F.lit(64)).cast("int") - n
    docs = table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_bytes"), F.concat(raw, F.unhex(F.repeat(F.lit("00"), padding))).alias("payload"))
    stored = docs.select("doc_id", "n_bytes", mpeg_audio.encode_audio(F.col("payload")).alias("media"))
    read = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), mpeg_audio.decode_audio(F.col("media")).alias("a"))
    parts = {"frames": "n_frames", "samples": "samples", "rate": "rate", "min_kbits": "min_kbits", "max_kbits": "max_kbits", "checked": "checked", "sound": "sound", "skipped": "skipped", "vbr_frames": "vbr_frames"}
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(f"a.{v}").cast("string"), F.lit("none"))) for k, v in parts.items()), F.concat(F.lit("offsets="), F.crc32(F.array_join("a.offsets", ",").cast("binary")).cast("string")))
    payload = F.col("a.payload")
    return read.select("doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"), F.col("a.duration").alias("duration"))


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))
    own = F.col("signature")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", order_minhash.as_text(own).alias("fingerprint"), order_minhash.as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        order_minhash.likeness(own, F.col("edited_signature")).alias("near_edited"), order_minhash.likeness(own, F.col("next_signature")).alias("near_next"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf, tampered = merkle.digest(*others, F.col("text")), merkle.digest(*others, ascii_lower(F.col("text")))
    leaves = table(spark, sf_dir, "documents").select("doc_id", merkle.group_key(F.col("lang")).alias("group_key"), F.col("doc_id").alias("order"), leaf.alias("node"), F.when(tampers, tampered).alias("tampered"))
    rows = merkle.manifest(leaves).withColumn("folded_root", merkle.folded(F.coalesce("tampered", "node"), F.col("path")))
    return rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; where ten divides crc32(doc_id), the words from one on repeat with a period, both drawn from that hash."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("words")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"), g.alias("g"))
    rows = rows.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))
    return rows.select("doc_id", F.when(n > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    words = F.array_join(F.regexp_extract_all("collapsed", F.lit(WORD), F.lit(0)), " ")
    rows = rows.select("doc_id", "collapsed", "runs", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"))
    start, length, period = -F.col("longest.back"), F.col("longest.length"), -F.col("longest.less")
    return rows.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2(F.coalesce(words, F.lit("")), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_line_dedup, op2_source_mixing, op3_toxicity, op4_lsh_forest, op5_sharding, op6_packing, op7_language_id, op8_license_scan, op9_anisotropic_ann, op10_mpeg_audio, op11_order_minhash, op12_merkle_manifest, op13_periodic_runs)
    return {q.__name__: q for q in every}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
k AS (SELECT DISTINCT doc_id, source, l FROM (SELECT doc_id, source, trim(unnest(ls), chr(32)||chr(9)||chr(13)||chr(11)||chr(12)) AS l FROM d) WHERE l <> ''),
t AS (SELECT source, count(*) AS total FROM d GROUP BY source),
bad AS (SELECT k.source, k.l FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source GROUP BY k.source, k.l, t.total HAVING count(*) >= 2 AND count(*) > 0.05 * t.total),
n AS (SELECT doc_id, source, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
x AS (SELECT n.doc_id, n.pos, n.line, bad.l IS NOT NULL AS gone FROM n LEFT JOIN bad ON n.source IS NOT DISTINCT FROM bad.source AND trim(n.line, chr(32)||chr(9)||chr(13)||chr(11)||chr(12)) = bad.l),
g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM x GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(g.n_dropped, 0) = 0 THEN d.text ELSE coalesce(g.kept, '') END AS text,
  CAST(coalesce(g.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n_dropped, 0) AS BIGINT) AS n_dropped
FROM d LEFT JOIN g USING (doc_id)
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [1] ELSE range(1, len(w) - 2) END) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM j JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op4_lsh_forest": OP4_SQL}
