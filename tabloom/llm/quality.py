"""Quality rules as weak supervision, in DataFrame operations only.

Every rule votes for a document (1), against it (-1) or abstains (0).  Expectation-maximisation finds how often each rule is right about
good and about bad documents, from the documents alone: what the rules' agreement needs is how many documents there are of each combination of votes, a table
of at most 3 ** rules rows, so an iteration costs the same at any number of documents.  A document is kept by its posterior probability.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
ROUNDS = 20
TOLERANCE = 1e-3  # rounds end when no estimate moves by more
VOTES = (-1, 1)
#: Where the iteration starts: the share of good documents, and how often a rule that votes is against and for a bad and a good document.
PRIOR, START = 0.8, {"bad": (0.4, 0.6), "good": (0.02, 0.98)}
SMOOTHING = 1.0  # documents of each class for which the starting values count
LEAST = 1e-4

Accuracies = dict[str, dict[str, tuple[float, float]]]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_letters, n_bars, n_ends``; NULL has none of them.

    Windows of three words are compared by sorting (hash, place) pairs packed into integers, so a long text costs n log n; neighbours
    whose packed hashes agree are compared by the whole 64-bit hash.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.withColumns({"_t": t, "_w": F.regexp_extract_all(t, F.lit(WORD), 0)})
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    w = F.col("_w")
    windows = F.when(F.size("_w") >= 3, F.sequence(F.lit(0), F.size("_w") - 3)).otherwise(F.array().cast("array<int>"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    d = d.withColumns({"_h": F.transform(windows, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])), "_l": lines})
    bits = F.ceil(F.log2(F.size("_w") + 2)).cast("int")
    d = d.withColumns({"_k": F.sort_array(F.transform("_h", lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long")))), "_b": bits})
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_b")) - 1).cast("int")
    none = F.array().cast("array<int>")
    twice = F.zip_with(
        "_k", F.slice("_k", 2, F.greatest(F.size("_k"), F.lit(1))),
        lambda x, y: F.when((F.call_function("shiftrightunsigned", x.bitwiseXOR(y), F.col("_b")) == 0) & (F.col("_h")[place(x)] == F.col("_h")[place(y)]), F.array(place(x), place(y))).otherwise(none),
    )
    d = d.withColumn("_p", F.sort_array(F.array_distinct(F.flatten(twice))))
    d = d.withColumns({
        "n_repeat_words": F.aggregate(F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.least(F.lit(3), b - a)), F.lit(0).cast("long"), lambda n, x: n + x),
        "word_chars": F.aggregate("_w", F.lit(0).cast("long"), lambda n, x: n + F.length(x)),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_upper": F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long"),
        "n_letters": F.length(F.regexp_replace("_t", r"\P{L}+", "")).cast("long"),
        "n_bars": F.size(F.filter("_w", lambda x: x == "|")).cast("long"),
        "n_ends": F.size(F.filter("_l", lambda x: x.rlike(r"[.!?\"')\]»”][\x20\x09-\x0D]*$"))).cast("long"),
    })
    return d.drop("_t", "_w", "_h", "_l", "_k", "_b", "_p")


class Rule(NamedTuple):
    """Votes against where ``bad`` holds, for where ``good`` does, else abstains."""

    name: str
    bad: Callable[[], Column]
    good: Callable[[], Column]


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


RULES = (
    Rule("length", lambda: F.col("n_words") < 20, lambda: F.col("n_words") >= 60),
    Rule("word_length", lambda: ~_share("word_chars", "n_words").between(2.5, 12), lambda: _share("word_chars", "n_words").between(3, 9)),
    Rule("symbols", lambda: _share("n_symbols", "n_words") > 0.1, lambda: _share("n_symbols", "n_words") < 0.02),
    Rule("dup_lines", lambda: _share("n_dup_lines", "n_lines") > 0.3, lambda: _share("n_dup_lines", "n_lines") < 0.1),
    Rule("repeats", lambda: _share("n_repeat_words", "n_words") > 0.4, lambda: _share("n_repeat_words", "n_words") < 0.2),
    Rule("upper", lambda: _share("n_upper", "n_letters") > 0.2, lambda: _share("n_upper", "n_letters") < 0.1),
    Rule("letters", lambda: _share("n_letters", "word_chars") < 0.7, lambda: _share("n_letters", "word_chars") > 0.85),
    Rule("bars", lambda: _share("n_bars", "n_words") > 0.05, lambda: _share("n_bars", "n_words") < 0.02),
    Rule("ends", lambda: F.col("n_ends") == 0, lambda: _share("n_ends", "n_lines") > 0.5),
)


def votes(featured: DataFrame, rules=RULES) -> DataFrame:
    """``featured`` with a column ``vote_<rule>`` of -1, 0 or 1 for each rule."""
    return featured.withColumns({f"vote_{r.name}": F.when(r.bad(), -1).when(r.good(), 1).otherwise(0) for r in rules})


def log_odds(accuracies: Accuracies, prior: float) -> Column:
    """Log odds that a document is good, given its votes; an abstention adds nothing."""
    total = F.lit(math.log(prior / (1 - prior)))
    for name, a in accuracies.items():
        ratio = [math.log(g / b) for g, b in zip(a["good"], a["bad"], strict=True)]
        vote = F.col(f"vote_{name}")
        total = total + F.when(vote == -1, ratio[0]).when(vote == 1, ratio[1]).otherwise(0.0)
    return total


def estimate(voted: DataFrame, rules=RULES, rounds: int = ROUNDS) -> tuple[Accuracies, float]:
    """How often each rule, when it votes, is against and for, by class, and the share of good documents.  To abstain says nothing.

    Up to ``rounds`` rounds of expectation-maximisation; without documents the starting values stay.
    """
    table = materialize(voted.groupBy(*(f"vote_{r.name}" for r in rules)).count())
    accuracies, prior = {r.name: dict(START) for r in rules}, PRIOR
    for _ in range(rounds):
        known = [prior, *(x for a in accuracies.values() for x in (*a["good"], *a["bad"]))]
        good = F.col("count") / (1 + F.exp(-log_odds(accuracies, prior)))
        weighted = table.select("*", good.alias("good"), (F.col("count") - good).alias("bad"))
        sums = [F.sum(F.when(F.col(f"vote_{r.name}") == v, F.col(c))).alias(f"{r.name}{v}{c}") for r in rules for v in VOTES for c in START]
        row = weighted.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), *sums).first().asDict()
        if row["good"] is None:
            break
        prior = min(max(row["good"] / (row["good"] + row["bad"]), LEAST), 1 - LEAST)
        for r in rules:
            for c, start in START.items():
                parts = [(row[f"{r.name}{v}{c}"] or 0) + SMOOTHING * s for v, s in zip(VOTES, start, strict=True)]
                parts = [max(x / sum(parts), LEAST) for x in parts]
                accuracies[r.name] = accuracies[r.name] | {c: tuple(parts)}
        if max(abs(x - y) for x, y in zip(known, [prior, *(x for a in accuracies.values() for x in (*a["good"], *a["bad"]))], strict=True)) <= TOLERANCE:
            break
    return accuracies, prior


def judge(docs: DataFrame, text: str = "text", rules=RULES, rounds: int = ROUNDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``) with the features and ``quality``, the posterior probability that a document is good.

    Every row is judged, repeated ones alike, and long texts as a whole; NULL is a text without words; an empty table gives no rows.  Columns of
    ``docs`` with the names of features or ``quality`` give way to them, all others come back as they were.
    """
    kept = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None).cast("struct<none:int>")
    voted = materialize(votes(features(docs.select(F.col(f"`{text}`").alias("text"), row.alias("row")), "text"), rules).drop("text"))
    accuracies, prior = estimate(voted, rules, rounds)
    judged = voted.withColumn("quality", 1 / (1 + F.exp(-log_odds(accuracies, prior)))).drop(*(f"vote_{r.name}" for r in rules))
    new = [c for c in judged.columns if c != "row"]
    taken = {c.lower() for c in new}
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in kept if c.lower() not in taken], *new)
