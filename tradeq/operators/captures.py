"""What is settled on a capture after reading: its tab, its terminal, and whether to read again.

Captures carry ``needs_review``, an array of flags; every step takes away the flags it
answers and adds its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeq.functions.text import blank_to_null
from tradeq.operators.quality import ERROR
from tradeq.operators.similarity import search_terminals

SURE_SCORE = 90


def score_text(score: Column) -> Column:
    return F.concat(F.lit(" ("), F.bround(score).cast("int").cast("string"), F.lit(")"))


def _without(flags: Column, *starts: str) -> Column:
    return F.filter(flags, lambda f: ~F.reduce(F.array(*[F.lit(s) for s in starts]), F.lit(False), lambda hit, s: hit | F.startswith(f, s)))


def measured_tab(captures: DataFrame, measured: DataFrame) -> DataFrame:
    """The measured tab over the one told by text.

    ``measured`` (capture_id, tab) wins where it decides. Where it does not, or a capture was
    not measured, the tab becomes UNKNOWN: text alone assumes BUY too easily.
    """
    seen = measured.select("capture_id", F.col("tab").alias("seen"))
    decided = F.col("seen").isin("BUY", "SELL")
    flags = F.col("needs_review")
    left_open = _without(flags, "tab_assumed_", "tab_detected_")
    return captures.join(seen, "capture_id", "left").withColumns(
        {
            "tab": F.when(decided, F.col("seen")).otherwise("UNKNOWN"),
            "needs_review": F.when(
                decided,
                F.array_append(_without(flags, "tab_assumed_", "tab_unknown"), F.concat(F.lit("tab_detected_"), F.lower("seen"))),
            )
            .when(F.array_contains(left_open, "tab_unknown"), left_open)
            .otherwise(F.array_append(left_open, F.lit("tab_unknown"))),
        }
    ).drop("seen")


def preferred_terminal(banner: DataFrame, header: DataFrame) -> DataFrame:
    """One match per capture from (capture_id, matched_id, matched_field, window, score) of two places.

    The header is looked at only where the banner has no match or one below 90; it wins only
    with a higher score.
    """
    match = lambda df, name: df.select("capture_id", F.struct("matched_id", "matched_field", "window", "score").alias(name))
    both = match(banner, "b").join(match(header, "h"), "capture_id", "full")
    use_header = F.col("h").isNotNull() & (F.col("b").isNull() | ((F.col("b.score") < SURE_SCORE) & (F.col("h.score") > F.col("b.score"))))
    source = F.when(use_header, "left_header").otherwise("banner")
    return both.withColumns({"m": F.when(use_header, F.col("h")).otherwise(F.col("b")), "source": source}).select(
        "capture_id", "m.matched_id", F.concat("source", F.lit(":"), "m.matched_field").alias("matched_field"), "m.window", "m.score"
    )


def merge_terminal(captures: DataFrame, preferred: DataFrame) -> DataFrame:
    """The preferred match where a capture has no terminal or one with a lower score; its flags follow."""
    found = preferred.select("capture_id", F.struct("matched_id", "matched_field", "window", "score").alias("found"))
    better = F.col("found").isNotNull() & (F.col("id_terminal").isNull() | (F.col("found.score") > F.coalesce("terminal_match_score", F.lit(0.0))))
    cleared = _without(F.col("needs_review"), "terminal_not_detected", "terminal_match_low_confidence")
    unsure = F.concat(F.lit("terminal_match_low_confidence"), score_text(F.col("found.score")))
    flags = F.when(F.col("found.score") < SURE_SCORE, F.array_append(cleared, unsure)).otherwise(cleared)
    new = {
        "id_terminal": (F.col("found.matched_id"), F.col("id_terminal")),
        "terminal_match_score": (F.col("found.score"), F.col("terminal_match_score")),
        "terminal_matched_field": (F.col("found.matched_field"), _or_null(captures, "terminal_matched_field")),
        "terminal_matched_from": (F.col("found.window"), _or_null(captures, "terminal_matched_from")),
        "needs_review": (flags, F.col("needs_review")),
    }
    return captures.join(found, "capture_id", "left").withColumns(
        {c: F.when(better, fresh).otherwise(old) for c, (fresh, old) in new.items()}
    ).drop("found")


def _or_null(df: DataFrame, column: str, kind: str = "string") -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def retry_reasons(captures: DataFrame, rows: DataFrame) -> DataFrame:
    """(capture_id, reasons) of the captures worth a second reading: no terminal, or rows without status."""
    holes = rows.filter("status = 0").groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("id_terminal").isNull(), F.lit("terminal_not_detected")),
            F.when(F.col("n") > 0, F.concat(F.lit("status_unknown_x"), F.col("n").cast("string"))),
        )
    )
    return captures.join(holes, "capture_id", "left").select("capture_id", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def unresolved_terminals(captures: DataFrame, terminals: DataFrame) -> DataFrame:
    """Captures whose typed terminal (``terminal_text``) was not picked, with the number of terminals it may mean."""
    typed = captures.filter("id_terminal is null").select("capture_id", blank_to_null(F.col("terminal_text")).alias("typed")).filter("typed is not null")
    hits = search_terminals(typed.select(F.col("capture_id").alias("query_id"), F.col("typed").alias("query")), terminals, limit=1)
    counts = hits.select(F.col("query_id").alias("capture_id"), "n_candidates")
    return typed.join(counts, "capture_id", "left").select(
        "capture_id", "typed", F.lit("terminal_unresolved").alias("code"), F.lit(ERROR).alias("severity"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
    )
