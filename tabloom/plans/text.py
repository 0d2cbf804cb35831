"""Text queries over whole texts."""

from pyspark.sql import Window, functions as F

from tabloom.functions import text as FT
from tabloom.operators import text as X
from tabloom.plans.registry import query

STOP = ", ".join(f"'{w}'" for w in (w.replace("'", "''") for w in FT.STOP_WORDS))
WORDS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z]') and not regexp_matches(w, '^[a-z]{1,2}$'))"
TOK = f"tok as (select doc_id, list_filter({WORDS}, lambda w: w not in ({STOP})) as t from documents)"
DTM = f"{TOK}, dtm as (select doc_id, term, count(*) as n from (select doc_id, unnest(t) as term from tok) group by 1, 2)"


def N():
    return F.count(F.lit(1))


def toks(t):
    return FT.tokens(F.col("text"))


def triples(t):
    return X.doc_term_counts(t.documents, "doc_id", toks(t))


@query("X01_combine_text", r"select doc_id, trim(regexp_replace(coalesce(lang, '') || ' ' || coalesce(source, '') || ' ' || text, '\s+', ' ', 'g'), ' ') as combined from documents")
def x01(t):
    return t.documents.select("doc_id", FT.combine(["lang", "source", "text"]).alias("combined"))


@query("X02_tokens", f"with {TOK} select doc_id, array_to_string(t, ' ') as tokens, len(t) as n from tok")
def x02(t):
    return t.documents.select("doc_id", toks(t).alias("w")).select("doc_id", F.array_join("w", " ").alias("tokens"), F.size("w").cast("long").alias("n"))


@query(
    "X03_word_ngrams",
    f"""with {TOK}, p as (select doc_id, t, unnest(range(1, len(t) + 1)) as i from tok), g as (select t[i] as gram from p union all select t[i] || ' ' || t[i + 1] from p where i < len(t))
    select gram, count(*) as n from g group by 1""",
)
def x03(t):
    return t.documents.select(F.explode(FT.ngrams(toks(t), 2)).alias("gram")).groupBy("gram").agg(N().alias("n"))


@query(
    "X03_char_ngrams",
    """with p as (select text as s, length(text) as l, unnest(range(1, length(text) + 1)) as i from conversations), g as (select substr(s, i, k) as gram from p, (select unnest(range(1, 6)) as k) where i + k - 1 <= l)
    select gram, count(*) as n from g group by 1""",
)
def x03b(t):
    return t.conversations.select(F.explode(FT.char_ngrams(F.col("text"), 5)).alias("gram")).groupBy("gram").agg(N().alias("n"))


@query("X04_doc_term_counts", f"with {DTM} select * from dtm")
def x04(t):
    return triples(t)


@query(
    "X05_prune_vocab",
    f"""with {DTM}, v as (select term, count(*) as df, sum(n) as total from dtm group by 1), k as (select term from v where df >= 5 and df <= 0.3 * (select count(distinct doc_id) from dtm) order by total desc, term desc limit 500)
    select dtm.* from dtm join k using (term)""",
)
def x05(t):
    return X.prune_vocab(triples(t), "doc_id", 5, 0.3, 500)


TFIDF = f"""{DTM}, idf as (select term, ln((1 + (select count(distinct doc_id) from dtm)) / (1 + count(*))) + 1 as idf from dtm group by 1), w as (select doc_id, term, n * idf as w from dtm join idf using (term)),
    tf as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from w)"""


@query("X06_tfidf", f"with {TFIDF} select doc_id, term, round(weight, 6) as weight from tf")
def x06(t):
    return X.tfidf(triples(t), "doc_id")


@query("X07_binary_weights", f"with {DTM} select doc_id, term, round(1 / sqrt(count(*) over (partition by doc_id)), 6) as weight from dtm")
def x07(t):
    return X.binary_weights(triples(t), "doc_id")


@query("X08_rank_terms", f"with {TFIDF} select term, round(sum(weight), 6) as weight from tf group by 1 order by round(sum(weight), 9) desc, term limit 50")
def x08(t):
    return X.rank_terms(X.tfidf(triples(t), "doc_id"), 50)


@query("X09_topics")
def x09(t):
    docs, _ = X.topics(t.documents, "doc_id", toks(t), 5, iterations=10)
    return docs.groupBy("topic").agg(N().alias("n"), F.avg(F.array_max("share")).alias("mean_share"))


@query("X09_topic_choice")
def x09b(t):
    """Coherence of the top words for three to five topics."""
    docs = t.documents.select("doc_id", toks(t).alias("w"))
    return X.topic_choice(X.topic_weights(docs, "doc_id", F.col("w")), "doc_id", X.train_embeddings(docs, "w", 16), range(3, 6), iterations=5)


@query("X10_coherence")
def x10(t):
    _, words = X.topics(t.documents, "doc_id", toks(t), 5, iterations=5)
    vec = X.train_embeddings(t.documents.select(toks(t).alias("w")), "w", 16)
    return X.coherence(words, vec)


@query(
    "X11_cooccurrence",
    f"""with {TOK}, p as (select doc_id, t, unnest(range(1, len(t) + 1)) as i from tok), g as (select least(t[i], t[i + d]) as a, greatest(t[i], t[i + d]) as b from p, (select unnest(range(1, 4)) as d) where i + d <= len(t))
    select a, b, count(*) as n from g group by 1, 2 having count(*) >= 2""",
)
def x11(t):
    return X.cooccurrence(t.documents, "doc_id", toks(t), 3, 2)


@query(
    "X12_train_embeddings",
    f"""with {TOK}, p as (select doc_id, t, unnest(range(1, len(t) + 1)) as i from tok), g as (select least(t[i], t[i + d]) as a, greatest(t[i], t[i + d]) as b from p, (select unnest(range(1, 6)) as d) where i + d <= len(t)),
    c as (select a, b, count(*) as n from g group by 1, 2), s as (select a, b, n from c union all select b, a, n from c where a <> b), e as (select a, sum(n) as n from s group by 1)
    select distinct s.a as term, 16 as size from s join e x on x.a = s.a join e y on y.a = s.b where s.n * (select sum(n) from s) > x.n * y.n""",
)
def x12(t):
    v = X.train_embeddings(t.documents.select(toks(t).alias("w")), "w", 16)
    return v.select("term", F.size("vector").alias("size"))


VEC = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings), u as (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as e from v)"


@query(
    "X13_nearest_vectors",
    f"""with {VEC}, q as (select min(vec_id) as query from u group by label), s as (select query, u.vec_id, list_dot_product(a.e, u.e) as s from q join u a on a.vec_id = query, u where u.vec_id <> query)
    select query, vec_id, round(s, 6) as similarity, row_number() over (partition by query order by round(s, 9) desc, vec_id)::int as rank from s qualify rank <= 5""",
)
def x13(t):
    q = t.embeddings.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("r")).select("r.*")
    return X.nearest_vectors(q, t.embeddings, "vec_id", "embedding", 5)


@query(
    "X13_analogy",
    f"""with {VEC}, t as (select list_transform(list_zip((select e from u where vec_id = 1), (select e from u where vec_id = 2), (select e from u where vec_id = 3)), lambda z: z[1] - z[2] + z[3]) as e),
    q as (select list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as e from t)
    select vec_id, round(list_dot_product(u.e, q.e), 6) as similarity from u, q where vec_id not in (1, 2, 3) order by round(list_dot_product(u.e, q.e), 9) desc, vec_id limit 10""",
)
def x13b(t):
    return X.analogy(t.embeddings, "vec_id", "embedding", 1, 2, 3, 10)


@query(
    "X14_char_vectors",
    """with w as (select p_name, embedding as e from part join embeddings on vec_id = p_partkey % (select max(vec_id) + 1 from embeddings)), c as (select unnest(string_split(p_name, '')) as ch, e from w), i as (select ch, unnest(range(1, 65)) as i, e from c)
    select ch, (i - 1)::int as i, round(avg(e[i]::double), 6) + 0 as x from i where ch <> '' group by 1, 2""",
)
def x14(t):
    """Every part has the vector that its number falls on."""
    vectors = t.embeddings.agg((F.max("vec_id") + 1).alias("vectors"))
    parts = t.part.crossJoin(F.broadcast(vectors)).select("p_name", (F.col("p_partkey") % F.col("vectors")).alias("vec_id"))
    w = parts.join(t.embeddings, "vec_id").select("p_name", "embedding")
    return X.char_vectors(w, "p_name", "embedding")


@query("X15_strip_illegal", r"select doc_id, regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{P}\p{S}\p{Z}]+', '', 'g') as clean from documents")
def x15(t):
    return t.documents.select("doc_id", FT.strip_illegal(F.col("text")).alias("clean"))


GRAMS = "(select {k}, t[i] as term from {s} union all select {k}, t[i] || ' ' || t[i + 1] from {s} where i < len(t))"


@query(
    "X16_highlight_matches",
    f"""with d as (select doc_id, {WORDS} as t from documents), b as (select item_id, {WORDS} as t from benchmark), dp as (select doc_id, t, unnest(range(1, len(t) + 1)) as i from d), bp as (select item_id, t, unnest(range(1, len(t) + 1)) as i from b),
    c as (select term, count(*) as coef from {GRAMS.format(k='item_id', s='bp')} group by 1), g as (select distinct doc_id, term from {GRAMS.format(k='doc_id', s='dp')})
    select doc_id, term, coef, 1 + (term like '% %')::int as words from g join c using (term)""",
)
def x16(t):
    coefs = t.benchmark.select(F.explode(FT.ngrams(FT.tokens(F.col("text"), stop=()), 2)).alias("term")).groupBy("term").agg(N().alias("coef"))
    return X.highlight_matches(t.documents, "doc_id", "text", coefs)


@query("X16_highlight_text", f"""with d as (select doc_id, {WORDS} as t from documents), b as (select {WORDS} as t from benchmark), c as (select distinct unnest(t) as term from b), m as (select distinct doc_id, true as hit from (select doc_id, unnest(t) as term from d) join c using (term))
    select doc_id, coalesce(hit, false) as marked, true as same from documents left join m using (doc_id)""")
def x16b(t):
    """Documents with the words of benchmark items between marks; without the marks they are what they were."""
    coefs = t.benchmark.select(F.explode(FT.tokens(F.col("text"), stop=())).alias("term")).distinct().withColumn("coef", F.lit(1))
    out = X.highlight_text(t.documents, "doc_id", "text", coefs, 1, "\u2039", "\u203a")
    plain = F.translate("highlighted", "\u2039\u203a", "")
    return out.select("doc_id", F.coalesce(F.contains("highlighted", F.lit("\u2039")) & ~F.contains("text", F.lit("\u2039")), F.lit(False)).alias("marked"), F.coalesce(plain == F.translate("text", "\u2039\u203a", ""), F.lit(True)).alias("same"))


TURNS = "tp as (select conv_id, turn, text as a, lead(text) over (partition by conv_id order by turn) as b from conversations)"


def turns(t):
    """Every turn beside the next one of its conversation; the last has none."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.col("text").alias("a"), after.alias("b"))


@query("X17_pair_equality", f"with {TURNS} select conv_id, turn, coalesce(trim(lower(a)) = trim(lower(b)), false) as same from tp")
def x17(t):
    return X.pair_equality(turns(t), "a", "b").select("conv_id", "turn", "same")


@query(
    "X18_pair_frequency",
    f"""with {TURNS}, c as (select x, count(*) as n from (select a as x from tp union all select b from tp) group by 1)
    select conv_id, turn, ca.n as a_n, cb.n as b_n, greatest(ca.n, cb.n) as max_n, least(ca.n, cb.n) as min_n from tp left join c ca on a is not distinct from ca.x left join c cb on b is not distinct from cb.x""",
)
def x18(t):
    return X.pair_frequency(turns(t), "a", "b").drop("a", "b")


@query("X19_time_by_length", "select doc_id, timestamp '2010-01-01' + to_hours(row_number() over (order by length(text), doc_id) - 1) as time from documents")
def x19(t):
    return X.time_by_length(t.documents, "text", "doc_id").select("doc_id", "time")
