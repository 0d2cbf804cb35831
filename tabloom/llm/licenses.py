"""License scans by diagonal voting, in DataFrame operations only.

The hash of every k words of a document is joined to the places where it stands in the license templates.  Matches of one copy of
a template lie on one diagonal (place in the document less place in the template), or on neighbouring ones where words were put in or
left out; a run of neighbouring diagonals is a span, and it counts if it covers enough of the template's words.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.session import materialize, small_side

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
GAP = 3  # diagonals that far apart still belong together
SHARE = 0.6  # of a template's words that a span must cover
#: Phrases of the base labels, and what the templates say (public license notices).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
]


def words_of(text: Column) -> Column:
    """Words of ``text``, A-Z in lower case; NULL has none.

    ``lower`` also changes other letters, which no phrase or template holds; the two of them that it would turn into ASCII are replaced first.
    """
    safe = F.replace(F.replace(text, F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é"))
    return F.coalesce(F.regexp_extract_all(F.lower(safe), F.lit(WORD), 0), F.array().cast("array<string>"))


def gram_hashes(words: str, k: int = K) -> Column:
    """Hashes of every ``k`` consecutive words of the array column ``words``."""
    w = F.col(words)
    places = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(w[i + j] for j in range(k))))


def template_words(spark, templates=TEMPLATES) -> DataFrame:
    """``template, label, t``: a row for each template with its words."""
    rows = spark.createDataFrame([(n, label, text) for n, (label, text) in enumerate(templates)], "template int, label string, text string")
    return rows.select("template", "label", words_of(F.col("text")).alias("t"))


def covered(pairs: Column, k: int) -> Column:
    """How many of a template's words the votes ``pairs`` cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(pairs["place"], lambda p: F.sequence(p, p + k - 1)))))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, k: int = K, gap: int = GAP, share: float = SHARE) -> DataFrame:
    """``_key`` and ``runs``: the runs of neighbouring diagonals of its documents, each with its template and its votes (pairs of places).

    Runs that, even if all their votes are right, cover less than ``share`` of the template are left out.  A document with fewer than ``k`` words, NULL or without a match has no row.  Rows that share a key are pooled.
    """
    grams = docs.select(F.col(key).alias("_key"), words_of(F.col(text)).alias("w")).select("_key", F.posexplode(gram_hashes("w", k)).alias("at", "hash"))
    places = template_words(docs.sparkSession, templates).select("template", F.size("t").alias("size"), F.posexplode(gram_hashes("t", k)).alias("place", "hash"))
    votes = grams.join(F.broadcast(places), "hash").select("_key", "template", "size", "at", "place")  # as many places as the list of templates has words
    diagonals = votes.groupBy("_key", "template", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set(F.struct("at", "place")).alias("pairs"))
    order = Window.partitionBy("_key", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"), F.lit(1))
    runs = diagonals.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    runs = runs.groupBy("_key", "template", "size", "run").agg(F.flatten(F.collect_list("pairs")).alias("pairs")).where(covered(F.col("pairs"), k) >= share * F.col("size"))
    return runs.groupBy("_key").agg(F.collect_list(F.struct("template", "pairs")).alias("runs"))


def phrase_places(words: str, phrases: dict[str, str] = PHRASES) -> Column:
    """Array of (start, label) of the places in ``words`` at which a phrase's words stand consecutively, ascending."""
    w, none = F.col(words), F.array().cast("array<struct<start:bigint,label:string>>")

    def places(own: list[str], label: str) -> Column:
        last = F.size(w) - len(own)
        found = F.filter(F.sequence(F.lit(0), last), lambda i: reduce(and_, [w[i + j] == x for j, x in enumerate(own)]))
        rare = F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in own]))) == len(set(own))  # else no place is looked at
        return F.when((last >= 0) & rare, F.transform(found, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))).otherwise(none)

    arrays = [places(phrase.split(" "), label) for phrase, label in phrases.items()]
    return F.sort_array(F.concat(*arrays))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, k: int = K, gap: int = GAP, share: float = SHARE) -> DataFrame:
    """A row per row of ``docs``: ``key, n_words, places`` (of base phrases), ``spans`` (verified, of the templates) and ``score``, the best coverage.

    A span is verified on the row's own words: only votes whose words equal the template's count, and they must cover ``share`` of it.
    NULL and empty texts have no words; rows may share a key, NULL keys too.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    found = small_side(materialize(candidates(docs, key, text, templates, k, gap, share)))
    known = F.array(*[F.struct(F.lit(r.label).alias("label"), F.array(*[F.lit(x) for x in r.t]).alias("t")) for r in template_words(spark, templates).orderBy("template").collect()])
    own = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    rows = own.join(found, own["_id"].eqNullSafe(found["_key"]), "left").select(F.col("_id").alias(key), words_of(F.col("_text")).alias("w"), "runs")
    w = F.col("w")
    right = lambda t, p: F.slice(w, p.at + 1, k) == F.slice(t, p.place + 1, k)
    named = F.transform(F.coalesce("runs", F.array().cast(found.schema["runs"].dataType)), lambda r: F.struct(known[r.template].alias("of"), r.pairs.alias("pairs")))
    sure = F.transform(named, lambda r: F.struct(r.of.label.alias("label"), F.size(r.of.t).alias("size"), F.filter(r.pairs, lambda p: (p.at + k <= F.size(w)) & right(r.of.t, p)).alias("pairs")))
    spans = F.transform(sure, lambda r: F.struct(
        F.array_min(r.pairs["at"]).cast("long").alias("first_word"), (F.array_max(r.pairs["at"]) + k - 1).cast("long").alias("last_word"), r.label.alias("label"), (covered(r.pairs, k) / r.size).alias("coverage"),
    ))
    rows = rows.select(key, F.size("w").cast("long").alias("n_words"), phrase_places("w").alias("places"), F.sort_array(F.filter(spans, lambda s: s.coverage >= share)).alias("spans"))
    return rows.withColumn("score", F.coalesce(F.array_max(F.col("spans.coverage")), F.lit(0.0)))
