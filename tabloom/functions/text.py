"""Text expressions; a token is a run of letters, marks, digits or underscores that starts with a-z."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

WORD = r"([\p{L}\p{M}\p{N}_]+)"

# Domain words that are never terms.
DOMAIN_STOP_WORDS = (
    "minutes", "hours", "time", "reasonable", "day", "monday", "tuesday", "wednesday", "thursday", "friday", "days", "week",
    "saturday", "sunday", "weekday", "weekend", "month", "year", "episode", "unspecified", "specified", "stated", "condition",
    "care", "not", "applicable", "effect", "classified", "personal", "involving", "unknown", "degree",
)

# English function words (the public list that ``StopWordsRemover`` has, too), without its two-letter words, which are never tokens.
ENGLISH_STOP_WORDS = (
    "myself", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "him", "his", "himself", "she", "her", "hers", "herself", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "are", "was", "were", "been", "being",
    "have", "has", "had", "having", "does", "did", "doing", "the", "and", "but", "because", "until", "while", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "from", "down", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "nor", "not", "only", "own", "same", "than", "too",
    "very", "can", "will", "just", "don", "should", "now", "could", "ought", "cannot", "would",
)
STOP_WORDS = tuple(dict.fromkeys(DOMAIN_STOP_WORDS + ENGLISH_STOP_WORDS))


def combine(cols: Sequence[str]) -> Column:
    """Columns split on blanks and joined with single blanks; a NULL is empty."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *cols), r"\s+", " "))


def tokens(c: Column, stop: Sequence[str] = STOP_WORDS, lower: bool = True) -> Column:
    """Tokens without stop words, single letters and two-letter words of a-z."""
    words = F.regexp_extract_all(F.lower(c) if lower else c, F.lit(WORD), F.lit(1))
    words = F.filter(words, lambda w: w.rlike("^[a-zA-Z](?![a-zA-Z]?$)"))
    return F.filter(words, lambda w: ~(w if lower else F.lower(w)).isin(list(stop))) if stop else words


def shifted(words: Column, k: int) -> Column:
    """Array of structs ``w0..w(k-1)`` of k neighbouring elements.

    Neighbours come from shifted copies zipped together: a lambda body that named ``words`` itself
    would tokenise the text again for every element.
    """
    n = F.size(words)
    copies = [F.slice(words, i + 1, F.greatest(n, F.lit(1))).alias(f"w{i}") for i in range(k)]
    return F.slice(F.arrays_zip(*copies), 1, F.greatest(n - (k - 1), F.lit(0)))


def ngrams(words: Column, n: int, sep: str = " ") -> Column:
    """All n-grams of lengths 1..n, in order of length and position."""

    def of_length(k):
        return F.transform(shifted(words, k), lambda z: F.concat_ws(sep, *[z[f"w{i}"] for i in range(k)]))

    return F.concat(words, *[of_length(k) for k in range(2, n + 1)])


def char_ngrams(c: Column, n: int) -> Column:
    """All character n-grams of lengths 1..n."""
    return ngrams(F.filter(F.split(c, ""), lambda x: x != ""), n, "")


def strip_illegal(c: Column) -> Column:
    """Only letters, marks, numbers, punctuation, symbols and separators stay."""
    return F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}\p{P}\p{S}\p{Z}]+", "")
