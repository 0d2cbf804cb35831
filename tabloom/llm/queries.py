"""The registered queries of this subpackage: each applies its operator to a whole table and derives digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm import contamination, divergence, language, licenses, minhash, oracles, packing, phrases, quality, repeats, scoring, secrets, similarity, twins, warc
from tabloom.session import scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_warc": oracles.WARC,
    "op3_ngram_jaccard_join": oracles.JACCARD,
    "op4_benchmark_decontamination": oracles.CONTAMINATION,
    "op7_secret_scans": oracles.secret_scans(secrets.RULES, len(secrets.BASE)),
    "op8_suffix_array_dedup": oracles.REPEATS,
    "op11_phrase_collocations": twins.COLLOCATIONS,
    "op12_source_divergence": twins.DIVERGENCE,
    "op13_minhash_near_dedup": twins.NEAR_DUPLICATES,
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-two-fit packing of all documents into sequences of 1024 tokens."""
    packed = packing.packed_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents, with counts and a digest of those of the base kinds."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("spans", lambda s: s.kind.isin(kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of benchmark items in all documents."""
    found = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC files in the shared folder, and reads them back."""
    pages, path = table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    warc.write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    return warc.read_warc(spark, path).select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weakly supervised quality of all documents, after two fixed rules."""
    judged = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(*counts, failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"))


@query
def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template spans of all documents."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    listed = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    base = F.col("places.label")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, F.col("spans.label"))).alias("labels"), "score",
    )


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, by a model of the labelled ones outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.fit(docs.where(~held))
    found = language.identify(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out seventh."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = scoring.train(docs.where(~held))
    found = scoring.score(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier, too, removed from all documents."""
    left = repeats.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of three-word shingles have a similarity of 0.9 or more."""
    found = similarity.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of two to five words of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of every language are from each other, and the terms that set them apart."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query
def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of four-word shingles have a similarity of 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
