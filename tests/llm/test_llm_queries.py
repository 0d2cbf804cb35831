"""The registered queries: names, columns, and equality with their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tabloom.session import materialize

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    2: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    3: ["doc_id", "n_shingles", "component_id"],
    4: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    5: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    6: ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    7: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    8: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    9: ["doc_id", "held_out", "lang_pred", "score"],
    10: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    11: ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    12: ["lang", "source", "part", "item", "value", "rank"],
    13: ["doc_id", "n_shingles", "component_id", "kept"],
}
NAMES = {int(q[2:].split("_")[0]): q for q in entry.queries() if q.startswith("op")}


@pytest.mark.parametrize("n", range(1, 14))
def test_columns_and_sql(spark, n):
    df = entry.queries()[NAMES[n]](spark, SF)
    assert df.columns == COLUMNS[n]
    rows = df.collect()
    assert len(rows) >= (30 if n in (1, 11) else 200)
    sql = entry.oracle_sql().get(NAMES[n])
    if sql:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        cur = con.execute(sql)
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(COLUMNS[n])
        assert sorted(str([r[c] for c in cols]) for r in rows) == sorted(str(list(r)) for r in cur.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert len(kept["language_id"]) >= 195
    words = lambda t: t.encode().lower().split()
    sets = {k: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4))} for k, t in kept["language_id"].items()}
    gone = set(kept["language_id"]) - set(kept["ngram_jaccard_join"])
    assert gone and all(any(5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j]) for j in sets if j != k) for k in gone)
    stay = sorted(kept["ngram_jaccard_join"])
    assert not any(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for i, a in enumerate(stay) for b in stay[:i])
    assert set(kept["benchmark_decontamination"]) <= set(stay) and set(kept["secret_scans"]) == set(kept["benchmark_decontamination"])
    changed = [k for k, t in kept["secret_scans"].items() if t != kept["benchmark_decontamination"][k]]
    assert all("[SECRET]" in kept["secret_scans"][k] for k in changed)
    assert {r.doc_id for r in P.STAGES[-1][1](spark, docs, SF).collect()} == set(kept["secret_scans"])


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_pipeline_keeps_every_document_with_words_of_its_label(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    short = [(-1, "A.\nAll rights reserved.", "en"), (-2, "Was orer.\nThis work is licensed under the GNU General Public License, version 3.", "en"), (-3, "12 --", "en")]
    turned = lambda k: {a + i: a + (i + k) % 26 for a in (65, 97) for i in range(26)}
    every = [(1000 * k + r.doc_id, r.text.translate(turned(k)), f"{r.lang}{k}") for r in docs.collect() for k in range(6)]
    many = spark.createDataFrame(every, "doc_id long, text string, lang string")  # 24 languages: four with their letters turned
    for some in (docs.union(spark.createDataFrame(short, docs.schema)), many, docs.where("lang = 'en'")):
        want = [r.doc_id for r in some.collect() if any(map(str.isalpha, r.text))]
        assert sorted(r.doc_id for r in P.identified(spark, some, SF).collect()) == sorted(want)
    ties = spark.createDataFrame([(0.25, 4), (1 / 30, 30), (0.26, 4), (0.036, 30), (1.0, 1)], "score double, n int")
    assert [r[0] for r in ties.select(P.told_apart(ties["score"], ties["n"])).collect()] == [False, False, True, True, True]
