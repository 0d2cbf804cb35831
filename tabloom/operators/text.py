"""Text tables.  Documents are exploded to triples (doc, term, n) and counted map-side first."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.functions.text import ngrams, tokens
from tabloom.operators import factor
from tabloom.operators.order import null_safe_join, row_positions
from tabloom.session import BROADCAST_ROWS, materialize, small_side


def doc_term_counts(df: DataFrame, doc: str, terms: Column) -> DataFrame:
    return df.select(doc, F.explode(terms).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("n"))


def prune_vocab(triples: DataFrame, doc: str, min_count: int = 1, max_doc_share: float = 1.0, max_size: int | None = None) -> DataFrame:
    """Triples of terms in at least ``min_count`` and at most a share of the documents; top by total count.

    The triples are written once, since vocabulary and result both read them (so also below).
    """
    triples = materialize(triples)
    v = triples.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"))
    docs = triples.select(doc).distinct().agg(F.count(F.lit(1)).alias("_d"))
    v = v.crossJoin(F.broadcast(docs)).filter((F.col("df") >= min_count) & (F.col("df") <= max_doc_share * F.col("_d")))
    if max_size:
        v = row_positions(materialize(v), ["total", "term"], name="_p", descending=True).filter(F.col("_p") <= max_size)
    return triples.join(F.broadcast(v.select("term")) if max_size and max_size <= BROADCAST_ROWS else v.select("term"), "term", "left_semi")


def tfidf(triples: DataFrame, doc: str) -> DataFrame:
    """Smooth idf ln((1+n)/(1+df)) + 1 and unit length per document.

    The norm is a window over one document's terms, which are bounded by the text of one row.
    """
    triples = materialize(triples)
    docs = triples.select(doc).distinct().agg(F.count(F.lit(1)).alias("_d"))
    freq = triples.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).crossJoin(F.broadcast(docs))
    idf = freq.select("term", (F.ln((1 + F.col("_d")) / (1 + F.col("_df"))) + 1).alias("_idf"))
    w = triples.join(small_side(materialize(idf)), "term").withColumn("_w", F.col("n") * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return w.select(doc, "term", (F.col("_w") / norm).alias("weight"))


def binary_weights(triples: DataFrame, doc: str) -> DataFrame:
    """1 per present term, rows of unit length; one pass, as a document's terms fit a task."""
    n = F.count(F.lit(1)).over(Window.partitionBy(doc))
    return triples.select(doc, "term", (1 / F.sqrt(n)).alias("weight"))


def rank_terms(weights: DataFrame, top: int) -> DataFrame:
    g = weights.groupBy("term").agg(F.sum("weight").alias("weight"))
    return g.orderBy(F.desc(F.round("weight", 9)), "term").limit(top)


def doc_terms(weights: DataFrame, doc: str, ids: Sequence) -> DataFrame:
    return weights.filter(F.col(doc).isin(list(ids)))


def topic_weights(df: DataFrame, doc: str, terms: Column, vocab: int | None = None, min_df: float = 1, max_df: float = 1.0) -> DataFrame:
    """The tf-idf triples that topics are made of.  All terms count unless ``vocab``, ``min_df`` (documents, or a share below 1) or ``max_df`` says otherwise."""
    triples = materialize(doc_term_counts(df, doc, terms))
    if vocab or min_df > 1 or min_df < 1 or max_df < 1:
        least = math.ceil(min_df * triples.select(doc).distinct().count()) if min_df < 1 else int(min_df)
        triples = prune_vocab(triples, doc, least, max_df, vocab)
    return materialize(tfidf(triples, doc))


def topic_words(found: factor.Nmf, k: int, top_words: int) -> DataFrame:
    """``topic, pos, term, weight``: the heaviest terms of each topic."""
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("topic"), F.col(f).alias("weight")) for i, f in enumerate(factor.names(k))]))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 9)), "term")) - 1
    return found.columns.select("term", cells).withColumn("pos", place).where(F.col("pos") < top_words).select("topic", "pos", "term", "weight")


def topic_choice(weights: DataFrame, doc: str, vectors: DataFrame, ks: Sequence[int], top_words: int = 10, iterations: int = 20, seed: int = 1) -> DataFrame:
    """``k, coherence``: the mean coherence of the top words for each number of topics."""
    tables = []
    for k in ks:
        words = topic_words(factor.nmf(weights, doc, "term", "weight", k, iterations, seed), k, top_words)
        tables.append(coherence(words, vectors).agg(F.avg("coherence").alias("coherence")).select(F.lit(k).alias("k"), "coherence"))
    return reduce(DataFrame.unionByName, tables)


def topics(df: DataFrame, doc: str, terms: Column, k: int | None, vocab: int | None = None, min_df: float = 1, max_df: float = 1.0, top_words: int = 10, max_k: int = 15, iterations: int = 20, seed: int = 1):
    """Non-negative factors of tf-idf: (document shares with the top topic, top words per topic); with ``k`` None, the k in 3..max_k of the best coherence.

    Shares are a document's weights over their sum; a document without terms has NULL.
    """
    x = df.select(doc, terms.alias("_terms"))
    weights = topic_weights(x, doc, F.col("_terms"), vocab, min_df, max_df)
    if k is None:
        tried = topic_choice(weights, doc, train_embeddings(x, "_terms", 32, seed=seed), range(3, max_k + 1), top_words, iterations, seed).collect()
        k = max(tried, key=lambda r: (r.coherence or 0.0, -r.k)).k
    found = factor.nmf(weights, doc, "term", "weight", k, iterations, seed)
    total = sum([F.col(f) for f in factor.names(k)], F.lit(0.0))
    share = F.array(*[F.try_divide(F.col(f), total) for f in factor.names(k)])
    p = found.rows.select(doc, share.alias("share"))
    best = F.array_position("share", F.array_max("share")) - 1
    return null_safe_join(df.select(doc).distinct(), p, [doc], "left").select(doc, "share", best.alias("topic")), topic_words(found, k, top_words)


def train_embeddings(df: DataFrame, terms: str, size: int = 32, window: int = 5, min_count: int = 1, shift: float = 1.0, seed: int = 1) -> DataFrame:
    """Word vectors as a table ``term, vector`` (save and load it like any table): factors of the shifted positive mutual information of words that
    stand at most ``window`` apart, scaled by the square roots of the singular values.  Words without a positive value have no vector."""
    pairs = cooccurrence(df, terms, F.col(terms), window, min_count)
    found = factor.svd(factor.shifted_pmi(pairs, shift), "a", "b", "value", size, seed=seed)
    scaled = [(F.col(f) / max(v, 1e-12) ** 0.5).alias(f) for f, v in zip(factor.names(size), [*found.values, *[0.0] * size], strict=False)]
    return found.rows.select(F.col("a").alias("term"), *scaled).select("term", factor.vector(size).alias("vector"))


def unit(v) -> Column:
    """Vector of length 1; the norm stands outside the lambda, so it is worked out once per row."""
    c = F.col(v) if isinstance(v, str) else v
    d = c.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.zip_with(d, F.array_repeat(norm, F.size(d)), lambda x, n: F.try_divide(x, n))


def coherence(topic_terms: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean cosine over the term pairs of each topic.

    For unit vectors the sum over pairs is (|sum|^2 - k) / 2, so no pair is formed.
    """
    t = topic_terms.select("topic", "term").join(vectors, "term").select("topic", "term", F.posexplode(unit("vector")).alias("i", "x"))
    s = t.groupBy("topic", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("k"))
    k = F.max("k")
    return s.groupBy("topic").agg(F.try_divide(F.sum(F.col("s") ** 2) - k, k * (k - 1)).alias("coherence"))


def cooccurrence(df: DataFrame, doc: str, words: Column, window: int, min_count: int = 1) -> DataFrame:
    """Symmetric counts of word pairs at most ``window`` positions apart: ``a <= b, n``."""
    w, n = F.col("_words"), F.size("_words")

    def apart(d):
        left, right = (F.slice(w, i, F.greatest(n - d, F.lit(0))) for i in (1, d + 1))
        return F.zip_with(left, right, lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))

    df = df.select(words.alias("_words"))  # a column: a generator works out an expression again wherever it stands
    pairs = df.select(F.inline(F.concat(*[apart(d) for d in range(1, window + 1)])))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def nearest_vectors(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """``query, <key>, similarity, rank`` of the ``k`` most similar vectors, the query itself left out.

    Queries and vectors are dealt into blocks of about ``block`` rows.  Each pair of blocks is one matrix product in a task, which
    keeps its own best ``k`` (and what ties with them); a rank filter, pruned before the shuffle, merges the pairs.
    """
    kt = vectors.schema[key].dataType.simpleString()

    def dealt(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        n = df.count() // block + 1
        return df.select(key, unit(vector).alias("_u"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(name)), n

    q, nq = dealt(queries, "_qb")
    v, nv = dealt(vectors, "_vb")
    q = q.withColumn("_vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    v = v.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def best(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(ours) and len(theirs):
            sims = np.vstack(theirs["_u"].to_numpy()) @ np.vstack(ours["_u"].to_numpy()).T
            take = min(k + 1, len(theirs))
            edge = -np.partition(-sims, take - 1, axis=0)[take - 1]
            i, j = np.nonzero(sims >= edge)
            found.append(pd.DataFrame({"query": ours[key].to_numpy()[j], key: theirs[key].to_numpy()[i], "similarity": sims[i, j]}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], key: [], "similarity": []})

    out = q.groupBy("_qb", "_vb").cogroup(v.groupBy("_qb", "_vb")).applyInPandas(best, f"query {kt}, {key} {kt}, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), key)
    return out.filter(~F.col("query").eqNullSafe(F.col(key))).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def analogy(vectors: DataFrame, key: str, vector: str, a, b, c, k: int) -> DataFrame:
    """The ``k`` vectors nearest to a - b + c, the three themselves left out."""
    three = vectors.filter(F.col(key).isin(a, b, c)).select(F.lit(0).alias("_g"), F.col(key).alias("_k"), F.posexplode(unit(vector)).alias("i", "x"))
    sign = F.when(F.col("_k") == b, -1.0).otherwise(1.0)
    target = three.groupBy("i").agg(F.sum(sign * F.col("x")).alias("x"))
    q = target.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("_q"))
    d = vectors.filter(~F.col(key).isin(a, b, c)).crossJoin(F.broadcast(q.select(unit("_q").alias("_q"))))
    sim = F.aggregate(F.zip_with(unit(vector), "_q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return d.select(key, sim.alias("similarity")).orderBy(F.desc(F.round("similarity", 9)), key).limit(k)


def char_vectors(words: DataFrame, word: str, vector: str, digits: int = 6) -> DataFrame:
    """Mean of the word vectors of each character, per occurrence: ``ch, i, x``."""
    chars = words.select(F.explode(F.split(F.col(word), "")).alias("ch"), vector).filter("ch <> ''")
    return chars.select("ch", F.posexplode(vector).alias("i", "x")).groupBy("ch", "i").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("x"))


def highlight_matches(df: DataFrame, doc: str, text: str, coefs: DataFrame, n: int = 2) -> DataFrame:
    """Terms (1..n words) with a coefficient that occur in a text: ``doc, term, coef, words``, longest first by ``words``."""
    words = df.select(doc, tokens(F.col(text), stop=()).alias("_words"))  # a column: a generator works out an expression again wherever it stands
    t = words.select(doc, F.explode(F.array_distinct(ngrams(F.col("_words"), n))).alias("term"))
    return t.join(small_side(coefs.select("term", "coef")), "term").select(doc, "term", "coef", F.regexp_count("term", F.lit(r"\S+")).alias("words"))


def highlight_text(df: DataFrame, doc: str, text: str, coefs: DataFrame, n: int = 2, before: str = "<b>", after: str = "</b>") -> DataFrame:
    """``doc, text, highlighted``: the text with every term of ``coefs`` (term, coef) in it between two marks.

    Of terms that overlap the longest counts, and after it those further on.  Blanks inside a term stand for whatever isn't a letter or digit between its
    words.  Documents without a term come back as they are; NULL stays NULL.
    """
    found = highlight_matches(df, doc, text, coefs, n).groupBy(doc).agg(F.collect_set("term").alias("_terms"))
    quoted = F.transform("_terms", lambda t: F.struct(-F.length(t), F.regexp_replace(F.regexp_replace(t, r"([^\p{L}\p{N} ])", r"\\$1"), " ", r"[^\\p{L}\\p{N}]+").alias("q")))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])("), F.array_join(F.transform(F.array_sort(quoted), lambda x: x.q), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    wrapped = F.regexp_replace(F.col(text), pattern, F.lit(f"{before}$1{after}"))
    return null_safe_join(df.select(doc, text), found, [doc], "left").select(doc, text, F.when(F.col("_terms").isNull(), F.col(text)).otherwise(wrapped).alias("highlighted"))


def pair_equality(df: DataFrame, a: str, b: str, name: str = "same") -> DataFrame:
    return df.withColumn(name, F.coalesce(F.trim(F.lower(a)) == F.trim(F.lower(b)), F.lit(False)))


def pair_frequency(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often each text of the pair occurs in both columns together, and the larger and smaller count.

    Texts are joined by value; counts are pre-aggregated, so a text in a third of the pairs is one row.
    """
    both = df.select(F.col(a).alias("_t")).unionByName(df.select(F.col(b).alias("_t")))
    c = both.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    out = df
    for col in (a, b):
        out = null_safe_join(out, c.withColumnsRenamed({"_t": col, "_n": f"{col}_n"}), [col], "left")
    return out.withColumns({"max_n": F.greatest(f"{a}_n", f"{b}_n"), "min_n": F.least(f"{a}_n", f"{b}_n")})


def time_by_length(df: DataFrame, text: str, key: str, start: str = "2010-01-01") -> DataFrame:
    """Texts in order of length, one hour apart from ``start``."""
    p = row_positions(df.withColumn("_len", F.length(text)), ["_len", key], name="_pos").drop("_len")
    first = F.to_timestamp(F.lit(start))
    return p.withColumn("time", F.timestamp_seconds(F.unix_seconds(first) + (F.col("_pos") - 1) * 3600)).drop("_pos")
