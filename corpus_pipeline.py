"""A training corpus from raw documents: the stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.llm import contamination, language, packing, secrets, similarity
from tabloom.session import materialize, table

LEAST_ODDS = 1.01  # per byte, of the best language against the mean of the others; languages that fit alike have 1, however many


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter (NULL and empty texts, too), or that fit all languages alike, go.

    Long texts are read whole, repeated rows are judged alike, an empty table stays empty, and columns of any name are kept.
    """
    model = language.fit(docs)
    found = language.identify(docs, model, keep=docs.columns)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & told_apart(F.col("score"), len(model.languages))).select(*docs.columns)


def told_apart(score: Column, languages: int) -> Column:
    """Whether the share ``score`` of the best of so many languages is beyond what each has if they fit alike; a single language always is."""
    return score * (languages - 1) >= LEAST_ODDS * (1 - score)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, directly or by way of others, the one with the least id.

    Of repeated rows one stays.  Documents without words or without an id all stay, and so do different documents that share an id.  Long
    texts are compared whole, an empty table stays empty, and columns of any name are kept.
    """
    return similarity.deduplicate(docs, n=5, percent=80).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item; NULL and empty texts have none and stay.

    Long texts are searched whole, repeated rows are treated alike, an empty table stays empty, and columns of any name are kept.
    """
    found = contamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("items") == 0).select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, and ``n_chars`` brought up to date where there is such a column.

    NULL and empty texts stay as they are, long ones are scanned whole, repeated rows alike; an empty table stays empty.
    """
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 1024 tokens.

    NULL and empty texts are their end token; long texts become many pieces; repeated rows are packed each; an empty table gives no rows.
    """
    return packing.packed_documents(docs)


STAGES = [
    ("language_id", identified),
    ("ngram_jaccard_join", deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", redacted),
    ("best_fit_packing", packed),
]

#: Language models and tokenizers have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
