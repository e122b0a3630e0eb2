"""Text functions as columns: similarity, phrase variations, speech matching, times, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT_WORDS = 3
MATCH_AT = 0.5


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")


def word_count(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0)))


def similarity(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """1 - edit distance / longer length; 0 if one text is empty, ``both_empty`` if both are."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(both_empty)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / n)


def clean_lines(lines: Column) -> Column:
    """Lines in lower case without outer white space."""
    return F.transform(lines, lambda t: strip(F.lower(t)))


def best_line_match(query: Column, lines: Column) -> Column:
    """How well a query is found in an array of lines: 1 if contained in one, else the best similarity; no lines 0.

    Case and outer white space don't count. For many texts that share lines ``scorers.line_scores`` does less.
    """
    q, clean = strip(F.lower(query)), clean_lines(lines)
    found = F.exists(clean, lambda t: F.contains(t, q))
    # a similarity is at most the shorter length over the longer, so most lines needn't be compared
    bound = lambda t: F.try_divide(F.least(F.length(q), F.length(t)), F.greatest(F.length(q), F.length(t)))
    best = F.aggregate(clean, F.lit(0.0), lambda most, t: F.when(bound(t) <= most, most).otherwise(F.greatest(most, similarity(q, t))))
    return F.when(F.size(lines) <= 0, F.lit(0.0)).when(found, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0)))


def variations(phrase: Column) -> Column:
    """A phrase's forms for a detector: itself, singular or plural, its last word, and that one's plural."""
    last = F.try_element_at(F.regexp_extract_all(phrase, F.lit(r"\S+"), F.lit(0)), F.lit(-1))
    n = F.length(phrase)
    other = F.when(F.endswith(phrase, F.lit("es")), F.substring(phrase, F.lit(1), n - 2)).when(F.endswith(phrase, F.lit("s")), F.substring(phrase, F.lit(1), n - 1)).otherwise(F.concat(phrase, F.lit("s")))
    many = word_count(phrase) > 1
    forms = F.array(phrase, other, F.when(many, last), F.when(many & ~F.endswith(last, F.lit("s")), F.concat(last, F.lit("s"))))
    return F.array_distinct(F.filter(forms, lambda v: v.isNotNull()))


def short_match(query: Column, text: Column) -> Column:
    """Of a query of one or two words with spoken text: contained 1; else words alike, word by word, if at least 0.5.

    The query is parted at white space, the text into runs of a-z, 0-9 and apostrophes.


    With two words the worst word's best match counts; where that fails, the whole query against single words.
    """
    q, t = strip(F.lower(query)), strip(F.lower(text))
    words = F.regexp_extract_all(t, F.lit("[a-z0-9']+"), F.lit(0))
    parts = F.regexp_extract_all(q, F.lit(r"\S+"), F.lit(0))
    best = lambda w: F.array_max(F.transform(words, lambda v: similarity(w, v, 0.0)))
    worst = F.array_min(F.transform(parts, best))
    whole = best(q)
    fuzzy = F.when((F.size(parts) > 1) & (worst >= MATCH_AT), worst).when(whole >= MATCH_AT, whole).otherwise(F.lit(0.0))
    return F.when((F.length(q) == 0) | (F.length(t) == 0), F.lit(0.0)).when(F.contains(t, q), F.lit(1.0)).otherwise(F.coalesce(fuzzy, F.lit(0.0)))


def long_match(query: Column, text: Column, cosine: Column) -> Column:
    """Of a longer query: contained 1, else the cosine of the sentence vectors, at least 0."""
    q, t = strip(F.lower(query)), strip(F.lower(text))
    return F.when((F.length(q) == 0) | (F.length(t) == 0), F.lit(0.0)).when(F.contains(t, q), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0))))


def is_short(query: Column) -> Column:
    return word_count(query) < SHORT_WORDS


def timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm"""
    whole = F.floor(seconds)
    rest = seconds - F.floor(whole / 60) * 60
    return F.format_string("%02d:%02d:%06.3f", F.floor(whole / 3600).cast("int"), F.floor(whole / 60 % 60).cast("int"), rest.cast("double"))


def clock(seconds: Column) -> Column:
    """[HH:MM:SS], cut to whole seconds."""
    whole = F.floor(seconds)
    return F.format_string("[%02d:%02d:%02d]", F.floor(whole / 3600).cast("int"), F.floor(whole / 60 % 60).cast("int"), (whole % 60).cast("int"))


def seconds_of(stamp: Column) -> Column:
    """Seconds of HH:MM:SS,mmm or HH:MM:SS.mmm."""
    part = F.split(F.regexp_replace(stamp, ",", "."), ":")
    return F.get(part, F.lit(0)).cast("double") * 3600 + F.get(part, F.lit(1)).cast("double") * 60 + F.get(part, F.lit(2)).cast("double")


def cache_key(path: Column, fps: Column) -> Column:
    """sha256 of path:fps, in hex; ``path`` is resolved already."""
    return F.sha2(F.concat(path, F.lit(":"), fps.cast("double").cast("string")), 256)
