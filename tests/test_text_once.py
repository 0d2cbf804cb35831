"""Texts are cut into words once, and small tables of terms are worked out once."""

from pyspark.sql import functions as F

from tabloom.functions.text import tokens
from tabloom.operators import text as X

TEXTS = [(0, "Alpha beta gamma alpha, the b cd xyz_1 1abc"), (1, "beta beta alpha"), (2, None), (3, ""), (4, "ab a abc alpha2 a1 gamma")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def docs(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


def test_tokens_are_longer_than_two_letters(spark):
    got = {r.id: r.w for r in docs(spark).select("id", tokens(F.col("text")).alias("w")).collect()}
    assert got == {0: ["alpha", "beta", "gamma", "alpha", "xyz_1"], 1: ["beta", "beta", "alpha"], 2: None, 3: [], 4: ["abc", "alpha2", "a1", "gamma"]}


def test_cooccurrence_cuts_texts_once(spark):
    out = X.cooccurrence(docs(spark), "id", tokens(F.col("text")), 3)
    words = [["alpha", "beta", "gamma", "alpha", "xyz_1"], ["beta", "beta", "alpha"], ["abc", "alpha2", "a1", "gamma"]]
    want: dict = {}
    for w in words:
        for i in range(len(w)):
            for d in range(1, 4):
                if i + d < len(w):
                    k = tuple(sorted((w[i], w[i + d])))
                    want[k] = want.get(k, 0) + 1
    assert {(r.a, r.b): r.n for r in out.collect()} == want
    assert plan(out).count("lower(text") == 1


def test_highlight_matches_cuts_texts_once(spark):
    coefs = spark.createDataFrame([("alpha beta", 2), ("gamma", 1)], "term string, coef long")
    out = X.highlight_matches(docs(spark), "id", "text", coefs)
    assert sorted((r.id, r.term, r.coef, r.words) for r in out.collect()) == [(0, "alpha beta", 2, 2), (0, "gamma", 1, 1), (4, "gamma", 1, 1)]
    assert plan(out).count("lower(text") == 1


def counts(spark):
    return X.doc_term_counts(docs(spark), "id", tokens(F.col("text")))


def test_a_pruned_vocabulary_is_ranked_from_one_table(spark):
    out = X.prune_vocab(counts(spark), "id", 1, 1.0, 2)
    assert sorted((r.id, r.term, r.n) for r in out.collect()) == [(0, "alpha", 2), (0, "beta", 1), (1, "alpha", 1), (1, "beta", 2)]
    assert "sum(n" not in plan(out) and "strategy=broadcast" in plan(out)


def test_few_weights_of_terms_are_broadcast(spark):
    out = X.tfidf(counts(spark), "id")
    assert "ln(" not in plan(out).lower() and "strategy=broadcast" in plan(out)
    norms = out.groupBy("id").agg(F.round(F.sum(F.col("weight") ** 2), 9).alias("s")).collect()
    assert sorted((r.id, r.s) for r in norms) == [(0, 1.0), (1, 1.0), (4, 1.0)]
