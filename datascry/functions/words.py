"""Text functions: tokens, counts and lexicon sentiment, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from datascry.functions.scalars import column

# The sentiment word lists and the characters stripped from words.
POSITIVE_WORDS = [
    "love", "loved", "loving", "likes", "like", "liked", "awesome", "amazing", "great", "excellent", "good", "wonderful", "fantastic",
    "beautiful", "perfect", "enjoy", "enjoyed", "happy", "pleasant", "glad", "satisfactory", "satisfied", "recommend", "best", "superb",
    "masterpiece", "outstanding", "brilliant", "witty", "smart", "touching", "heartwarming", "delight", "delightful", "incredible",
    "feast",
]
NEGATIVE_WORDS = [
    "hate", "hated", "hating", "dislike", "disliked", "bad", "terrible", "awful", "horrible", "worst", "poor", "boring", "bored",
    "disappoint", "disappointed", "disappointing", "waste", "wasteful", "annoy", "annoyed", "annoying", "painful", "lifeless", "useless",
    "broken", "fail", "failed", "disaster", "embarrassment", "flat", "stupid", "mess", "shame", "mediocre",
]
STRIPPED = ".,!?\"'()[]{}"
SENTIMENT_LIMIT = 0.1


def split_words(text) -> Column:
    """Runs of non-blank characters."""
    return F.array_remove(F.split(F.coalesce(column(text), F.lit("")), r"\s+"), "")


def bare_words(text) -> Column:
    """Lower-case words without surrounding punctuation."""
    return F.transform(split_words(F.lower(column(text))), lambda w: F.btrim(w, F.lit(STRIPPED)))


def text_metrics(text) -> dict[str, Column]:
    body = F.coalesce(column(text), F.lit(""))
    ends = F.length(body) - F.length(F.translate(body, ".!?", ""))
    return {
        "chars": F.length(body),
        "words": F.size(split_words(text)),
        "sentences": F.greatest(F.lit(1), ends),
    }


def sentiment_polarity(text, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS) -> Column:
    """(pos - neg) / (pos + neg) over word occurrences, 0 where neither list occurs."""
    # One walk over the words: positive hits count in the low digits of the sum, negative ones above them.
    place = 2**31
    hit = lambda total, w: total + F.when(w.isin(list(positive)), F.lit(1)).when(w.isin(list(negative)), F.lit(place)).otherwise(F.lit(0))

    def ratio(total):
        pos, neg = total % place, F.floor(total / place)
        return F.when(total == 0, F.lit(0.0)).otherwise((pos - neg) / (pos + neg))

    return F.aggregate(bare_words(text), F.lit(0).cast("long"), hit, ratio)


def sentiment_band(polarity) -> Column:
    p = column(polarity)
    return F.when(p > SENTIMENT_LIMIT, "Positive").when(p < -SENTIMENT_LIMIT, "Negative").otherwise("Neutral")


def lexical_diversity(text) -> Column:
    distinct = F.size(F.array_distinct(bare_words(text)))
    return F.coalesce(distinct / F.nullif(F.size(split_words(text)), F.lit(0)), F.lit(0.0))


def avg_word_length(text) -> Column:
    total = F.aggregate(split_words(text), F.lit(0), lambda acc, w: acc + F.length(F.btrim(w, F.lit(STRIPPED))))
    return F.coalesce(total / F.nullif(F.size(split_words(text)), F.lit(0)), F.lit(0.0))


def tokenize(text, stop: list[str] | None = None) -> Column:
    """Lower-case runs of two or more letters, digits or underscores, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(column(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    if not stop:
        return found
    return F.filter(found, lambda w: ~w.isin(list(stop)))
