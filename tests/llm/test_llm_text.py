"""Operators on texts against brute force, on small fixtures with NULLs, empty and long texts, ties and repeated rows."""

import binascii
import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm import contamination, language, licenses, packing, quality, repeats, scoring, secrets, similarity
from tabloom.llm.batches import as_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, n_words string, spans int, score string"


def frame(spark, rows, partitions=3):
    """Rows of (id, text), with a language and columns that clash with results."""
    return spark.createDataFrame([(k, t, "en", "x", 1, "y") for k, t in rows], SCHEMA).repartition(partitions)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = ["the", "of", "Émile", "İx", "zwei", "MIT", "license", "a1", "|", "###", "General", "public", "apache"]
    out = [(i, r.choice([" ", "\n", "\t ", ". "]).join(r.choice(words) for _ in range(r.choice([0, 1, 2, 5, 40, 200])))) for i in range(60)]
    out += [(100, None), (101, ""), (102, "\n \t"), (103, out[7][1]), (103, out[7][1]), (104, "x" * 5000), (None, "the mit license"), (105, " ".join(words) * 400)]
    return out


def test_packing_is_gapless_and_keeps_ids(spark, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = packing.packed_documents(frame(spark, rows)).collect()
    want = collections.Counter()
    for k, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        head = (len(ids) - 1) % 1024 + 1
        for p, (a, b) in enumerate([(0, head), *((i, i + 1024) for i in range(head, len(ids), 1024))]):
            want[(k, p, a, b - a, binascii.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.packed_documents(frame(spark, rows[:0])).count() == 0


def test_packing_knows_the_added_token(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {x.content: i for i, x in tok.get_added_tokens_decoder().items()} == packing.ADDED
    end = "<|endoftext|>"
    texts = [f"one {end} two", end, end * 3, f"a{end}b\n {end}\n", f"<|endoftext| {end.upper()} <|<|endoftext|>|>", f"é {end} " * 900]
    got = packing.token_pieces(frame(spark, list(enumerate(texts)))).collect()
    for k, t in enumerate(texts):
        ids = np.concatenate([np.frombuffer(bytes(x.ids), "<u4") for x in sorted(got, key=lambda x: x.piece) if x.doc_id == k])
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids + [2]
        assert (ids == packing.ADDED[end]).sum() == t.count(end)


def test_best_two_fit_replaces_the_smallest_piece():
    places = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)  # 6 + 3 leaves 1; 6 + 2 + 2 leaves none
    assert sorted((n, s) for n, _, _, _, s, _ in places) == [(2, 0), (3, 1), (6, 0)]
    r = random.Random(1)
    counts = collections.Counter(r.randint(1, 100) for _ in range(5000))
    places = packing.best_two_fit(dict(counts), 100)
    assert collections.Counter({n: sum(b - a + 1 for m, a, b, *_ in places if m == n) for n in counts}) == counts
    used = max(s + (b - a + 1) // m for _, a, b, m, s, _ in places)
    assert used <= sum(n * c for n, c in counts.items()) / 100 * 1.01 + 1


def test_pack_refuses_lengths_out_of_range(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 11)], "k long, length long"), ["k"], 10)


PYTHON_RULES = {
    "assign": re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def python_spans(text):
    out = []
    for i, (kind, rule) in enumerate(PYTHON_RULES.items()):
        for m in rule.finditer(text):
            if len(m.group(m.re.groups)) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), i, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secrets_equal_regexes(spark):
    r = random.Random(3)
    parts = ["password", "PassWd", "token", "secret", "api_key", "apikey", '"', "'", " ", ":", "=", "AKIA", "AKIAX", "0123456789abcdef", "deadbeef", "ABCDEFGHIJ0123", "é", "\n", ",", "x", "==", "zz_9"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(800)] + ["", None, "token=token: abcdefgh", "f" * 9000]
    got = secrets.scan_secrets(frame(spark, list(enumerate(texts))), rules=secrets.BASE, keep=["doc_id", "spans"]).collect()
    assert len(got) == len(texts)
    for x in got:
        assert [(s.kind, s.start, s.end) for s in x.spans] == python_spans(texts[x.doc_id] or "")
    clean = {x.doc_id: x.text for x in secrets.redact(frame(spark, [(0, "é password: hunter22, ok"), (1, None), (2, "plain"), (2, "plain")])).collect()}
    assert clean == {0: "é [SECRET], ok", 1: None, 2: "plain"}
    added = secrets.scan_secrets(frame(spark, [(0, "-----BEGIN RSA PRIVATE KEY-----"), (1, "Bearer " + "a1" * 12)])).collect()
    assert {s.kind for x in added for s in x.spans} >= {"pem", "bearer"}


def test_contamination_equals_window_sets(spark):
    r = random.Random(1)
    vocabulary = ["a", "b", "É", "Ab", "x9"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 9, 10, 11, 14])))) for i in range(40)] + [(50, None), (None, "a b"), (3, "a a a a a a a")]
    docs = [(i, r.choice([" ", "-", "\n "]).join(r.choice(vocabulary) for _ in range(r.randint(0, 500)))) for i in range(80)] + [(90, None), (91, "")]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else ():
            windows[tuple(w[k : k + n])].add(str(i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = dict(docs)
    small = contamination.BLOCK_BYTES
    for contamination.BLOCK_BYTES in (small, 300):  # one block, then several
        for x in contamination.contamination(frame(spark, docs), bench, keep=["doc_id", "lang"]).collect():
            w, hit, found = ALNUM.findall((texts[x.doc_id] or "").translate(LOWER)), set(), set()
            for n in {len(p) for p in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit.update(range(k, k + n))
                        found |= windows[tuple(w[k : k + n])]
            assert (x.n_words, x.items, {k for s in x.spans for k in range(s.start, s.end)}) == (len(w), sorted(found), hit)
    contamination.BLOCK_BYTES = small
    assert contamination.contamination(frame(spark, docs), bench.limit(0), keep=["doc_id"]).where("size(items) > 0").count() == 0
    assert contamination.contamination(frame(spark, docs[:0]), bench).count() == 0


def test_language_model(spark):
    voc = language.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    data, first = as_bytes(pa.array(["the", "a", "éxz", "theory"], pa.string()))
    lat = language.lattice(voc, data, first)
    log_p = np.log(np.random.default_rng(0).dirichlet(np.ones(voc.size), 2).T)
    ahead = language.forward(lat, first, log_p)
    edges = collections.defaultdict(list)
    for a, b, p in zip(lat.start, lat.end, lat.piece, strict=True):
        edges[a].append((b, p))

    def total(a, stop, lang):
        return 1.0 if a == stop else sum(math.exp(log_p[p, lang]) * total(b, stop, lang) for b, p in edges[a])

    for w in range(4):
        for lang in range(2):
            assert math.isclose(ahead[first[w + 1] + w, lang], math.log(total(first[w], first[w + 1], lang)), rel_tol=1e-9)
    weight = np.ones((4, 2))
    counts = language.expected(lat, first, log_p, weight)
    length = np.zeros(voc.size)
    length[lat.piece] = lat.end - lat.start
    assert np.allclose((counts * length[:, None]).sum(axis=0), len(data))  # expected pieces cover every byte once


def test_language_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.fit(docs.where(~held))
    got = language.identify(docs.where(held), model).collect()
    assert sum(x.lang == x.lang_pred for x in got) >= 0.95 * len(got)
    odd = {x.doc_id: x for x in language.identify(frame(spark, [(0, None), (1, ""), (2, "123 --"), (3, "the " * 9000), (3, "the " * 9000)]), model).collect()}
    assert [odd[i].lang_pred for i in range(3)] == ["und"] * 3 and odd[3].lang_pred == "en" and 0 < odd[3].score <= 1
    none = language.fit(frame(spark, []))
    assert language.identify(frame(spark, [(0, "word")]), none).first().lang_pred == "und"


def test_quality_features_equal_python(spark, rows):
    got = quality.judge(frame(spark, rows), keep=["doc_id", "lang"]).collect()
    want = collections.Counter()
    for k, t in rows:
        t = t or ""
        w, at = WORD.findall(t), collections.defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        twice = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(k, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice))] += 1
    assert collections.Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in got) == want
    assert all(0 <= x.quality <= 1 for x in got)
    assert quality.judge(frame(spark, [])).count() == 0


def test_quality_learns_which_documents_are_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    got = quality.judge(docs, keep=["doc_id"]).where("n_words >= 50 and 2 * n_repeat_words <= n_words").join(labels, "doc_id").collect()
    good, bad = ([x.quality >= 0.5 for x in got if x.label == v] for v in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_licenses_equal_python(spark, rows):
    extra = [(200, "Released under the MIT License. " * 3), (201, "x Licensed under the foo Apache License, Version 2.0 y"), (202, "MI\u212a License general PUBLIC license"), (203, "mit license")]
    every = rows + extra
    got = licenses.scan_licenses(frame(spark, every)).collect()
    want = collections.Counter()
    for k, t in every:
        w = ALNUM.findall((t or "").translate(LOWER))
        found = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        want[(k, len(w), tuple(found))] += 1
    assert collections.Counter((x.doc_id, x.n_words, tuple((p.start, p.label) for p in x.places)) for x in got) == want
    spans = {x.doc_id: x.spans for x in got}
    assert [(s.first_word, s.last_word, s.label, s.coverage) for s in spans[200]] == [(5 * i, 5 * i + 4, "mit", 1.0) for i in range(3)]
    assert [(s.first_word, s.label) for s in spans[201]] == [(1, "apache")]  # neighbouring diagonals are one span
    assert not spans[203] and all(0 <= x.score <= 1 for x in got)
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def python_repeats(docs, least):
    seen, out = set(), {}
    for k in sorted(docs):
        b, gone = docs[k], bytearray(len(docs[k]))
        for i in range(len(b) - least + 1):
            if b[i : i + least] in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(b[i : i + least])
        out[k] = gone
    return out


def test_repeats_equal_a_set_of_strings(spark):
    r = random.Random(2)
    docs = {i: "".join(r.choice(["a", "ab", "aab", "é", "xyz" * 3, "a" * 30]) for _ in range(r.randint(0, 40))) for i in range(40)}
    docs |= {70: "a" * 300, 71: "ab" * 200, 72: "ab" * 200, 73: "", 74: "zz" + "a" * 300, 75: None}
    raw = {k: (v or "").encode() for k, v in docs.items()}
    want = python_repeats(raw, 25)
    got = repeats.remove_repeats(frame(spark, [*docs.items(), (72, docs[72])]), least=25, gram=6, keep=["doc_id", "spans"]).collect()
    assert len(got) == len(docs) + 1
    for x in got:
        gone = want[x.doc_id]
        assert bytes(x.kept) == bytes(c for c, m in zip(raw[x.doc_id], gone) if not m)
        assert (x.n_bytes, x.n_removed, len(x.spans)) == (len(gone), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1])))
    assert repeats.remove_repeats(frame(spark, [])).count() == 0
    assert repeats.remove_repeats(frame(spark, [(1, "short")])).first().n_removed == 0


def test_repeats_by_hash_equal_those_of_the_transform():
    r = random.Random(7)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(8, 60))).encode() for _ in range(50)]
    n, rank = np.array([len(t) - 7 for t in texts]), np.random.default_rng(1).permutation(50)
    one, other = repeats.repeated_starts(texts, n, rank, 8), repeats.repeated_by_hash(texts, n, rank, 8)
    assert all((a == b).all() for a, b in zip(one, other, strict=True)) and any(a.any() for a in one)


def python_components(docs, n, percent):
    sets, parent, having = {}, {k: k for k in docs}, collections.defaultdict(list)
    for k, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in sorted(sets):
        common = collections.Counter(j for g in sets[k] for j in having[g])
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[k]) + len(sets[j]) - c):
                a, b = sorted((root(k), root(j)))
                parent[b] = a
        for g in sets[k]:
            having[g].append(k)
    return {k: (len(sets[k]), root(k)) for k in docs}


@pytest.fixture(scope="module")
def copies():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = {}
    for i in range(400):
        if i < 20 or r.random() < 0.1:
            docs[i] = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 3, 5, 8, 20, 60, 150, 300]))]
        else:
            d = list(docs[r.choice(list(docs))])
            for _ in range(r.choice([0, 1, 1, 2, 3, 6]) if d else 0):
                j = r.randrange(len(d))
                d[j : j + r.choice([0, 1])] = r.choice([[], [r.choice(vocabulary)]]) if len(d) > 1 else d[j : j + 1]
            docs[i] = d
    return {k: " ".join(v) for k, v in docs.items()} | {999: None}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_equal_all_pairs(spark, copies, n, percent):
    got = similarity.jaccard_components(frame(spark, copies.items()), n=n, percent=percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == python_components(copies, n, percent) and len(got) == len(copies)


def test_deduplicate_keeps_one_of_each_group(spark, copies):
    want = {k for k, (_, c) in python_components(copies, 5, 80).items() if k == c}
    twice = [*copies.items(), (0, copies[0]), (None, copies[1]), (None, copies[1])]
    got = [x.doc_id for x in similarity.deduplicate(frame(spark, twice)).collect()]
    assert sorted(k for k in got if k is not None) == sorted(want) and got.count(None) == 2
    assert similarity.deduplicate(frame(spark, [])).count() == 0


def test_scores(spark, rows, monkeypatch):
    docs = [(k, t) for k, t in rows if k is not None]
    train = [(k, t) for k, t in docs if k % 3]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    count = collections.Counter(w for _, t in train for w in tokens(t))
    total, types = sum(count.values()), len(count)
    want = collections.Counter((k, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), round(sum(math.log10((count[w] + 1) / (total + types + 1)) for w in tokens(t)), 4)) for k, t in docs)
    model = scoring.train(frame(spark, train))
    assert (model.total, model.types) == (total, types)
    scores = []
    for most, shard in ((10**6, 1 << 20), (5, 20)):  # all counts broadcast and one shard; few and several
        monkeypatch.setattr(scoring, "SHARD_BYTES", shard)
        got = scoring.score(frame(spark, docs), model, keep=["doc_id", "score"], most=most).collect()
        assert collections.Counter((x.doc_id, x.n_tokens, x.n_known, round(x.base_score, 4)) for x in got) == want
        scores.append(sorted((x.doc_id, round(x.score, 6)) for x in got))
    assert scores[0] == scores[1]
    empty = scoring.train(frame(spark, []))
    assert scoring.score(frame(spark, [(1, "a b")]), empty).first().n_known == 0
    assert scoring.score(frame(spark, []), model).count() == 0


def test_filter_levels_follow_counts():
    h = np.random.default_rng(3).integers(0, 1 << 63, 2000).astype(np.uint64)
    n = np.tile([1, 2, 3, 4, 9, 70], 334)[:2000]
    part = scoring.build_part(h, n)
    held = scoring.Filter(np.append(part, np.uint8(0)), np.array([[-1], [0]]), np.array([[0], [len(part)]]), 1)
    level = held.levels(1, h)
    exact = np.where(n < 2, 0, np.floor(np.log2(np.maximum(n, 2) / 2)) + 1)
    assert (level >= exact).all() and (level == exact).mean() > 0.95


def test_scores_know_ngrams_seen_once(spark):
    assert scoring.estimate(np.arange(5)).tolist() == [0.0, 1.0, 2.5, 5.5, 11.5]  # the middle of 1, 2-3, 4-7 and 8-15
    train = [(i, t) for i, t in enumerate(["red fish swim", "blue fish swim", "old boats sink", "a green hill", "fish"])]
    model = scoring.train(frame(spark, train))
    docs = [(0, "old boats sink"), (1, "boats old sink"), (2, "quick onyx goblins"), (3, "blue fish swim")]
    words = lambda t: [*t.encode().split(), None]
    one = collections.Counter(w for _, t in train for w in words(t))
    two = collections.Counter(p for _, t in train for p in zip([None, *words(t)], words(t)))
    middle = lambda n: 1.5 * 2 ** int(math.log2(n)) - 0.5 if n else 0.0

    def want(text):
        out = 0.0
        for a, b in zip([None, *words(text)], words(text)):
            h = middle(one[a])
            weight = h / (h + scoring.KAPPA)
            p = (middle(one[b]) + 1) / (model.total + model.types + 1)
            out += math.log10(weight * min(1.0, middle(two[a, b]) / max(h, 1.0)) + (1 - weight) * p)
        return out

    got = {x.doc_id: x.score for x in scoring.score(frame(spark, docs), model, keep=["doc_id"]).collect()}
    assert all(math.isclose(got[k], want(t), rel_tol=1e-9) for k, t in docs)
    assert got[0] > got[1] > got[2]  # bigrams seen once, unigrams seen once, neither
