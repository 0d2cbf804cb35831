"""Phrases, source divergence and near-duplicates: plain Python, odd rows, and columns with the names that operators use inside."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import divergence, minhash, packing, phrases, quality, repeats, scoring, sieve, similarity, warc

ODD = [(None, None, None), ("", "en", None), ("   ", "en", "s"), ("x" * 70_000, "en", "s"), ("a b c \U0001f600!", None, "t"), ("A.b", "de", "")]


def words(text, blank):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in blank}).split(" ") if w]


def brute_phrases(rows, least):
    total, f = Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): "\n" for c in ".,;:!?\n\x0b\x0c\r"})
        for piece in low.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            total[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = {}
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in some.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                continue
            score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), c[p[:k]], c[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out |= {(lang, i + 1): (phrase, a, l, r, total[lang], score) for i, (score, a, phrase, l, r) in enumerate(found)}
    return out


def test_collocations(spark):
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice(list("abcdef"), 12)) + rng.choice([". ", "\n", "\t", "! a"]) + "New  york\tCity hall", ["en", None, "und"][i % 3]) for i in range(60)]
    rows += [r[:2] for r in ODD] + [("q q q q q q", "one")] * 4
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, id long, prefix long")
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, least=8, top=None).collect()}
    assert got == brute_phrases(rows, 8) and any(p[0] == "new york city hall" for p in got.values())
    top = phrases.collocations(df, least=8, top=3).collect()
    assert {(r.lang, r["rank"]): r.phrase for r in top} == {k: v[0] for k, v in got.items() if k[1] <= 3}
    assert phrases.collocations(df.limit(0)).count() == 0


def test_a_full_sieve_changes_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(f"a b c d e{i % 7} f", "en") for i in range(40)], "text string, lang string")
    want = sorted(map(str, phrases.collocations(df, least=5).collect()))
    monkeypatch.setattr(sieve.build, "__defaults__", (8192,))
    assert sorted(map(str, phrases.collocations(df, least=5).collect())) == want
    s = sieve.build(spark.range(200_000).select(F.xxhash64("id").alias("id")), 8192)
    assert s.has(np.array([r[0] for r in spark.range(1000).select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)).all()


def test_scores_beyond_64_bits(spark):
    big = [(10**13, 5 * 10**13, 3 * 10**12, 7 * 10**12), (101, 10**14, 9 * 10**17, 10**17), (7, 3, 2, 2)]
    got = [r[0] for r in spark.createDataFrame(big, "a long, b long, c long, d long").select(phrases.exact_div(*map(F.col, "abcd"))).collect()]
    assert got == [1000 * a * b // (c * d) for a, b, c, d in big]


def brute_divergence(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = lambda t: words(t, [c for c in map(chr, range(128)) if not c.isalpha()])
    out = set()
    for lang in {r[1] for r in rows}:
        docs = [(terms(t), s) for t, x, s in rows if x == lang]
        kept = {w for w, n in Counter(w for d, _ in docs for w in set(d)).items() if n >= least}
        counts = {s: Counter(w for d, x in docs if x == s for w in d if w in kept) for s in {s for _, s in docs}}
        every = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        for s in counts:
            pair = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in counts if o != s]
            term = [(w, p[s][w] - q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, n) for n, (i, v) in enumerate(found[:most], 1)}
    return out


@pytest.mark.parametrize("chunk,tile", [(512, 64), (8, 2)])
def test_divergence(spark, monkeypatch, chunk, tile):
    monkeypatch.setattr(divergence, "CHUNK_TERMS", chunk)
    monkeypatch.setattr(divergence, "TILE_SOURCES", tile)
    rng = np.random.default_rng(6)
    rows = [(" ".join(rng.choice([f"w{chr(97 + j)}" for j in range(20)] + ["Üb", "x1y"], 15, p=None)) + "!", ["en", "de", None][i % 3], f"s{i % 7}" if i % 11 else None) for i in range(120)]
    rows += ODD + [rows[0]] * 3
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "text string, lang string, source string, term string, n long")
    got = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.divergence(df, least_docs=6, top=5).collect()}
    assert got == brute_divergence(rows, 6, 5)
    assert divergence.divergence(df.limit(0)).count() == 0
    alone = divergence.divergence(spark.createDataFrame([("a", "en", "s"), ("b", "en", "t")], "text string, lang string, source string")).collect()
    assert {(r.part, r.value) for r in alone} == {("pair", 0)} and len(alone) == 2


def sets_of(text, n):
    w = words(text, "\t\n\x0b\x0c\r")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, n, percent):
    sets = [sets_of(t, n) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    least = {}
    for (k, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, math.inf), math.inf if k is None else k)
    return sorted(((k is None, k or 0), len(s), least[r] if sets[i] and least[r] < math.inf else k) for i, ((k, _), s, r) in enumerate(zip(rows, sets, root, strict=True)))


def copies(seed, groups=12, n=60):
    """Chains of texts that drift apart word by word, copies, short texts, and texts that share a passage."""
    rng = np.random.default_rng(seed)
    rows, passage = [], " ".join(f"p{i}" for i in range(40))
    for g in range(groups):
        w = [f"g{g}w{i}" for i in rng.integers(0, 500, rng.integers(6, n))]
        for _ in range(8):
            rows.append(" ".join(w) + (" " + passage if g % 4 == 0 else ""))
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(0, len(w)))] = f"n{rng.integers(0, 10**6)}"
    rows += [rows[0]] * 5 + ["one two", "ONE two", "one", "", None, " \n", "a b c d", "a b c d e"]
    return [(int(i) + 1, t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 4)
    monkeypatch.setattr(minhash, "SALT", 2)
    rows = copies(seed) + [(None, "one two"), (7, "a b c d"), (7, "quite another text of that key")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, cid long, cls string")
    got = minhash.near_duplicates(df).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_bounds_keep_links():
    for n, m in minhash.least_agreements(80, 1e-9):
        assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m)) < 1e-8
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 1.2e-9


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_components_and_deduplicate(spark, n, percent, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 4)
    rows = copies(3) + [(None, "one two"), (7, "a b c d"), (7, "quite another text of that key"), (7, "quite another text of that key")]
    df = spark.createDataFrame([(*r, 1, "k", "rid") for r in rows], "doc_id long, text string, _k long, k string, _rid string")
    got = similarity.jaccard_components(df, n=n, percent=percent).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in got) == brute_components(rows, n, percent)
    left = similarity.deduplicate(df, n=n, percent=percent)
    assert left.columns == df.columns
    left = left.collect()
    # one row of every group; rows of key 7 that aren't linked both stay
    assert sum(r.doc_id == 7 and r.text.startswith("quite") for r in left) == 1
    groups = {x[2] for x in brute_components(rows, n, percent) if x[1] and not x[0][0]}
    assert groups <= {r.doc_id for r in left} and sum(not sets_of(r.text, n) for r in left) == sum(not sets_of(t, n) for _, t in rows)
    stay = [sets_of(r.text, n) for r in left if r.doc_id is not None and sets_of(r.text, n)]
    assert not any(100 * len(a & b) >= percent * len(a | b) for a, b in combinations(stay, 2))


def test_an_outline_bounds_what_is_shared():
    rng = np.random.default_rng(8)

    def bound(a, b):
        x, y = similarity.outline(a), similarity.outline(b)
        size = min(len(x), len(y))
        return similarity.most_common(similarity.folded([x], np.array([len(a)]), size), similarity.folded([y], np.array([len(b)]), size))[0]

    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2))
        a, b = (np.sort(rng.choice(pool, rng.integers(1, len(pool)), replace=False)) for _ in range(2))
        assert bound(a, b) >= len(np.intersect1d(a, b))
    a, b = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) for _ in range(2))
    assert bound(a, b) < 350  # unrelated sets can't link
    same = np.arange(600, dtype=np.uint64)  # all in one fragment
    assert bound(same, same) >= 600


def test_names_that_operators_use_inside(spark):
    names = ["k", "rid", "_k", "_rid", "_row", "_levels", "_w", "vote_length", "_spans", "found", "row", "levels", "base"]
    df = spark.createDataFrame([(i, f"some words of text {i} " * 12, *range(len(names))) for i in range(6)], ", ".join(["doc_id long", "text string", *[f"{n} long" for n in names]]))
    for out in (repeats.remove_repeats(df), scoring.score(df, scoring.train(df)), quality.judge(df), similarity.deduplicate(df)):
        assert set(df.columns) <= set(out.columns)
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}


def test_a_million_blanks_are_packed(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    text = "x" + " " * 2_000_000 + "b"
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    got = packing.token_pieces(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).where("doc_id = 1").orderBy("piece").collect()
    assert b"".join(r.ids for r in got) == np.array([*ids, 2], "<u4").tobytes()


def test_revisits_of_ids_that_repeat(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abcd"), (1, "u", "zz"), (2, "u", "zz")], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    got = {(r.id, r.record_type): (r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got[("2", "revisit")][0] == 2 and spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_splits_do_not_follow_the_cores(spark, tmp_path, monkeypatch):
    html = "x" + warc.MAGIC + "Content-Length: 3\r\n\r\nabc"
    pages = spark.createDataFrame([(i, "u", html + "y" * (i * 991 % 5000)) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        rows = warc.read_warc(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 300 and all(r.payload_digest for r in rows)
