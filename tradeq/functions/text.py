"""String similarity and label expressions. Every function returns a Column.

Scores are whole numbers 0..100 built on edit distance, rounded half to even:

* ``ratio``       100 * (longest - distance) / longest
* ``token_sort``  ratio of the word-sorted strings
* ``token_set``   best ratio among shared words / shared + rest of each side
* ``partial``     best ratio of the shorter string against every equally long
                  window of the longer one
* ``weighted``    max(ratio, 95 % of token_sort, 95 % of token_set)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\r\n\u00a0"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def norm(c: Column) -> Column:
    """Upper-cased and trimmed form used by every matcher."""
    return F.upper(strip(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(words(c)), " ")


def percent(part: Column, whole: Column) -> Column:
    return F.bround(F.lit(100.0) * part / whole).cast("int")


def ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(0)).otherwise(
        percent(longest - F.levenshtein(a, b), longest)
    )


def _ninety_five(score: Column) -> Column:
    return F.bround(F.lit(95) * score / F.lit(100.0)).cast("int")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def token_set_of(words_a: Column, words_b: Column) -> Column:
    """token_set over word arrays that are already distinct and sorted."""
    parts = F.struct(
        F.array_join(F.array_intersect(words_a, words_b), " ").alias("s"),
        F.array_join(F.array_except(words_a, words_b), " ").alias("a"),
        F.array_join(F.array_except(words_b, words_a), " ").alias("b"),
    )
    full = let(
        parts,
        lambda p: F.struct(
            p["s"].alias("s"),
            F.trim(F.concat_ws(" ", p["s"], p["a"])).alias("a"),
            F.trim(F.concat_ws(" ", p["s"], p["b"])).alias("b"),
        ),
    )
    return let(full, lambda p: F.greatest(ratio(p["s"], p["a"]), ratio(p["s"], p["b"]), ratio(p["a"], p["b"])))


def _near(a: Column, b: Column, floor: int) -> Column:
    """Lengths close enough for a ratio of ``floor`` or more."""
    la, lb = F.char_length(a), F.char_length(b)
    return F.least(la, lb) >= F.greatest(la, lb) * ((floor - 1) / 100.0)


def word_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(words(c)))


def weighted_of(
    a: Column, b: Column, sort_a: Column, sort_b: Column, set_a: Column, set_b: Column, floor: int = 70
) -> Column:
    """``weighted`` over forms computed once per string; exact from ``floor`` on.

    Parts that cannot reach it are not computed: strings of very different
    length, and word sets without a shared word and of very different length.
    """
    low = F.lit(0)
    may_share = F.arrays_overlap(set_a, set_b) | _near(F.array_join(set_a, " "), F.array_join(set_b, " "), floor)
    return F.greatest(
        F.when(_near(a, b, floor), ratio(a, b)).otherwise(low),
        F.when(_near(sort_a, sort_b, floor), _ninety_five(ratio(sort_a, sort_b))).otherwise(low),
        F.when(may_share, _ninety_five(token_set_of(set_a, set_b))).otherwise(low),
    )


def text_forms(c: Column) -> Column:
    return F.struct(c.alias("text"), sorted_words(c).alias("sorted"), word_set(c).alias("words"))


def weighted(a: Column, b: Column) -> Column:
    """``weighted`` of two strings; exact from 70 on, lower scores may come out lower."""
    both = F.struct(text_forms(a).alias("a"), text_forms(b).alias("b"))
    return let(
        both,
        lambda p: weighted_of(
            p["a"]["text"], p["b"]["text"], p["a"]["sorted"], p["b"]["sorted"], p["a"]["words"], p["b"]["words"]
        ),
    )


def partial_of(short: Column, long: Column, min_score: int = 0) -> Column:
    """Best ratio of ``short`` over the windows of ``long``; below ``min_score`` it may be 0."""
    size = F.char_length(short)
    windows = F.regexp_extract_all(long, F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))")), F.lit(1))
    edits = F.floor(size * ((100.5 - min_score) / 100.0)).cast("int")
    nearest = F.array_min(
        F.filter(
            F.transform(F.array_distinct(windows), lambda w: F.levenshtein(w, short)),
            lambda d: d <= edits,
        )
    )
    return F.when(size == 0, F.lit(0)).otherwise(F.coalesce(percent(size - nearest, size), F.lit(0)))


def partial(a: Column, b: Column) -> Column:
    swap = F.char_length(a) <= F.char_length(b)
    pair = F.struct(F.when(swap, a).otherwise(b).alias("short"), F.when(swap, b).otherwise(a).alias("long"))
    return let(pair, lambda p: partial_of(p["short"], p["long"]))


def _labels(labels: list[str]) -> Column:
    """Fixed labels with their sorted forms as one constant."""
    quote = lambda x: "'" + x.replace("'", "\\'") + "'"
    entry = "named_struct('text', {}, 'sorted', {}, 'words', array({}))"
    cells = [
        entry.format(quote(x), quote(" ".join(sorted(x.split()))), ", ".join(quote(w) for w in sorted(set(x.split()))))
        for x in labels
    ]
    return F.expr(f"array({', '.join(cells)})")


def looks_like_label(c: Column, labels: list[str], at_least: int) -> Column:
    """True if ``c`` scores at least ``at_least`` (70 or more) against any label."""
    return let(
        text_forms(c),
        lambda t: F.exists(
            _labels(labels),
            lambda x: weighted_of(t["text"], x["text"], t["sorted"], x["sorted"], t["words"], x["words"]) >= at_least,
        ),
    )


def letters(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"[^\p{L}]", ""))


def digits(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"[^\p{Nd}]", ""))
