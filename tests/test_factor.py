"""Factors of triples against numpy, and what holds for them at any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import factor as FA, text as X


def triples(spark, m):
    return spark.createDataFrame([(f"r{i}", f"c{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "r string, c string, v double")


def dense(table, key, k, order):
    rows = {x[key]: [x[f] for f in FA.names(k)] for x in table.collect()}
    return np.array([rows[o] for o in order])


def test_svd_is_numpys(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 30)) + 0.01 * rng.normal(size=(60, 30)) * (rng.random((60, 30)) < 0.6)
    found = FA.svd(triples(spark, m), "r", "c", "v", 4)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    assert found.values == pytest.approx(s[:4], rel=1e-6)
    left, right = dense(found.rows, "r", 4, [f"r{i}" for i in range(60)]), dense(found.columns, "c", 4, [f"c{j}" for j in range(30)])
    assert np.allclose(left @ right.T, u[:, :4] * s[:4] @ vt[:4], atol=1e-5)
    assert np.allclose(right.T @ right, np.eye(4), atol=1e-8) and (right.sum(axis=0) > -1e-9).all()


def test_svd_of_low_rank_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", "x", 2.0), ("a", "x", 1.0), ("b", "x", 4.0), (None, "x", 9.0), ("b", None, 9.0), ("b", "y", None)], "r string, c string, v double")
    found = FA.svd(df, "r", "c", "v", 2)
    assert found.values == pytest.approx([5.0, 0.0]) and sorted(x.r for x in found.rows.collect()) == ["a", "b"]
    assert FA.svd(df.limit(0), "r", "c", "v", 2).rows.count() == 0


def test_svd_of_many_columns(spark):
    """200 000 columns: a block of ones, whose singular value is known, in sparse noise."""
    df = spark.range(200_000).select((F.col("id") % 1000).alias("r"), F.col("id").alias("c"), F.lit(1.0).alias("v"))
    found = FA.svd(df, "r", "c", "v", 1, powers=1)
    assert found.columns.count() == 200_000 and found.values[0] <= np.sqrt(200) + 1e-6
    planted = df.unionByName(spark.range(50).crossJoin(spark.range(40).withColumnRenamed("id", "x")).select(F.col("id").alias("r"), F.col("x").alias("c"), F.lit(30.0).alias("v")))
    assert FA.svd(planted, "r", "c", "v", 1).values[0] == pytest.approx(30 * np.sqrt(2000), rel=0.01)


def test_nmf_finds_blocks_and_never_rises(spark):
    rng = np.random.default_rng(1)
    w, h = np.zeros((30, 3)), np.zeros((3, 24))
    for i in range(3):
        w[10 * i : 10 * i + 10, i], h[i, 8 * i : 8 * i + 8] = rng.uniform(1, 2, 10), rng.uniform(1, 2, 8)
    m = w @ h
    found = FA.nmf(triples(spark, m), "r", "c", "v", 3, rounds=25)
    assert all(b <= a * (1 + 1e-9) + 1e-6 for a, b in zip(found.errors, found.errors[1:], strict=False)) and found.errors[-1] < 0.05 * (m**2).sum()
    left, right = dense(found.rows, "r", 3, [f"r{i}" for i in range(30)]), dense(found.columns, "c", 3, [f"c{j}" for j in range(24)])
    assert (left >= 0).all() and found.errors[-1] == pytest.approx(((m - left @ right.T) ** 2).sum(), rel=1e-6, abs=1e-6)
    assert len({tuple(left[10 * i : 10 * i + 10].argmax(axis=1)) for i in range(3)}) == 3


def test_topics_of_planted_words(spark):
    rng = np.random.default_rng(2)
    words = [[f"{t}{i}" for i in range(6)] for t in "abc"]
    docs = [(i, list(rng.choice(words[i % 3], 12))) for i in range(45)] + [(45, [])]
    df = spark.createDataFrame(docs, "doc long, w array<string>")
    shares, top = X.topics(df, "doc", F.col("w"), 3, top_words=6)
    assert {frozenset(x.term for x in top.collect() if x.topic == t) for t in range(3)} == {frozenset(x) for x in words}
    got = {r.doc: r for r in shares.collect()}
    assert len(got) == 46 and got[45].share is None
    assert all(got[i].topic == got[i % 3].topic and sum(got[i].share) == pytest.approx(1) for i in range(45))


def test_planted_synonyms_are_neighbours(spark):
    """Two words that never meet but keep the same company."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        t = i % 4
        rows.append((i, [f"p{t}", *rng.choice([f"w{t}{j}" for j in range(5)], 3).tolist(), ("s" if i % 8 < 4 else "t") + str(t), *rng.choice([f"w{t}{j}" for j in range(5)], 3).tolist()]))
    v = X.train_embeddings(spark.createDataFrame(rows, "d long, w array<string>"), "w", 6, window=3)
    vec = {r.term: np.array(r.vector) / np.linalg.norm(r.vector) for r in v.collect()}
    for t in range(4):
        others = {k: float(vec[f"s{t}"] @ x) for k, x in vec.items() if k[0] in "st" and k != f"s{t}"}
        assert max(others, key=others.get) == f"t{t}"


def test_cells_of_a_product_stay_where_they_are(spark):
    """Only the factor is sent to the blocks, whichever side it is on; many small blocks give the product of numpy."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(40, 25)) * (rng.random((40, 25)) < 0.4)
    x = FA.blocks(triples(spark, m).withColumnRenamed("v", "value"), "r", "c")
    ours = spark.createDataFrame([(f"r{i}", float(i), 1.0) for i in range(40)], "r string, f0 double, f1 double")
    theirs = spark.createDataFrame([(f"c{j}", float(j), 1.0) for j in range(25)], "c string, f0 double, f1 double")
    for factor, shared, out, want in ((theirs, "c", "r", m @ np.c_[range(25), np.ones(25)]), (ours, "r", "c", m.T @ np.c_[range(40), np.ones(40)])):
        got = FA.times(x, factor, shared, out, 2)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(_block") == 1 and "Bucketed: true" in plan, plan
        assert all(np.allclose([r.f0, r.f1], want[int(r[out][1:])]) for r in got.collect())


def test_completion_reads_its_triples_once(spark):
    from tabloom.operators import models as M

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = [(u, i, float(u % 3 + i % 2 + 1)) for u in range(12) for i in range(5)]
    top, _ = M.complete_matrix(spark.createDataFrame(rows, "u long, i long, v double").mapInPandas(seen, "u long, i long, v double"), "u", "i", "v", 2)
    assert top.count() == 12 and read.value == 60


def test_pmi_reads_its_pairs_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    pairs = [("u", "u", 3), ("u", "v", 4), ("v", "w", 5), ("w", "w", 2)]
    found = FA.shifted_pmi(spark.createDataFrame(pairs, "a string, b string, n long").mapInPandas(seen, "a string, b string, n long"))
    each, total = {"u": 7, "v": 9, "w": 7}, 23
    both = {(a, b): n for a, b, n in pairs} | {(b, a): n for a, b, n in pairs}
    want = {k: np.log(n * total / (each[k[0]] * each[k[1]])) for k, n in both.items()}
    got = {(r.a, r.b): r.value for r in found.collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0}) and read.value == 4
