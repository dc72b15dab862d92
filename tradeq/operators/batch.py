"""Batch planning: newest capture wins, with the lineage of every dropped row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeq.functions.text import blank_to_null
from tradeq.operators.ordered import running_count, with_winner

UNKNOWN_STATUS = 0
MAX_PAYLOAD_ROWS = 500  # stated limit of the remote service


def queue_position(items: DataFrame, batch: str, order: str) -> DataFrame:
    """Explicit position if positive, else the 1-based input position inside its batch."""
    counted = running_count(items, [batch], order, F.lit(True), "nth")
    chosen = F.when(F.col("queue_position") > 0, F.col("queue_position")).otherwise(F.col("nth"))
    return counted.withColumn("position", chosen).drop("nth")


def plan_batch(items: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with ``is_kept``, and the item that holds the kept one.

    Inside a (batch, terminal) the first claim of (commodity, tab) in newest-first
    order is kept. Rows without a commodity are always kept.
    """
    claims = rows.join(
        items.select("capture_id", "batch_id", "id_terminal", "tab", "added_at", "position"), "capture_id"
    ).withColumn("terminal_key", F.coalesce("id_terminal", F.lit(-1)))
    newest_first = {
        "age": -F.col("added_at"),
        "rank": -F.col("position"),
        "capture_id": F.col("capture_id"),
        "row_index": F.col("row_index"),
    }
    named = with_winner(
        claims.filter("id_commodity is not null"), ["batch_id", "terminal_key", "id_commodity", "tab"], newest_first
    ).withColumns(
        {
            "is_kept": (F.col("winner.capture_id") == F.col("capture_id"))
            & (F.col("winner.row_index") == F.col("row_index")),
            "winner_id": F.col("winner.capture_id"),
            "winner_position": -F.col("winner.rank"),
        }
    )
    nameless = claims.filter("id_commodity is null").withColumns(
        {"is_kept": F.lit(True), "winner_id": F.col("capture_id"), "winner_position": F.col("position")}
    )
    return named.drop("winner").unionByName(nameless).drop("terminal_key")


def kept_rows(plan: DataFrame) -> DataFrame:
    return plan.filter("is_kept")


def dropped_rows(plan: DataFrame) -> DataFrame:
    """Dropped rows; no winner is named when the same capture already held the claim."""
    other = F.col("winner_id") != F.col("capture_id")
    side = F.when(F.col("tab") == "UNKNOWN", "(unknown)").otherwise(F.col("tab"))
    return plan.filter("not is_kept").select(
        "batch_id",
        "capture_id",
        "row_index",
        "id_terminal",
        "id_commodity",
        "tab",
        "position",
        F.when(other, F.col("winner_id")).alias("assigned_to"),
        F.when(other, F.col("winner_position")).otherwise(F.lit(0)).alias("assigned_position"),
        F.when(
            other,
            F.concat(F.lit("claimed by #"), F.col("winner_position").cast("string"), F.lit(" on "), side),
        )
        .otherwise(F.concat(F.lit("claimed earlier on "), side))
        .alias("reason"),
    )


def preview(plan: DataFrame) -> DataFrame:
    """Kept rows with a commodity, then the dropped rows, in one shape."""
    tag = lambda c: F.concat(F.lit("#"), c.cast("string"))
    kept = kept_rows(plan).filter("id_commodity is not null").select(
        "batch_id", "capture_id", "row_index", "id_commodity", "tab",
        tag(F.col("position")).alias("found_on"), tag(F.col("position")).alias("sent_on"),
        F.lit("Kept").alias("reason"), F.lit(True).alias("is_kept"),
    )
    dropped = dropped_rows(plan).select(
        "batch_id", "capture_id", "row_index", "id_commodity", "tab",
        tag(F.col("position")).alias("found_on"),
        F.when(F.col("assigned_position") > 0, tag(F.col("assigned_position"))).otherwise("(skipped)").alias("sent_on"),
        "reason", F.lit(False).alias("is_kept"),
    )
    return kept.unionByName(dropped)


def planned_submissions(items: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per item, also those left without rows."""
    counts = plan.groupBy("capture_id").agg(
        F.count_if("is_kept").alias("n_rows"),
        F.count_if(F.col("is_kept") & F.col("id_commodity").isNotNull()).alias("n_sent"),
        F.count_if(~F.col("is_kept")).alias("n_dropped"),
    )
    return items.join(counts, "capture_id", "left").fillna(0, subset=["n_rows", "n_sent", "n_dropped"])


def batch_summary(submissions: DataFrame, default_production: bool, delay_ms: int) -> DataFrame:
    """Totals per batch from ``planned_submissions``."""
    off_default = F.col("draft_is_production") != default_production
    return submissions.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("submissions"),
        F.sum("n_sent").alias("rows_sent"),
        F.sum("n_dropped").alias("rows_dropped"),
        F.coalesce(F.bool_or(off_default), F.lit(False)).alias("mixed_mode"),
        (F.bool_or(F.col("branch") == "LIVE") & F.bool_or(F.col("branch") == "PTU")).alias("mixed_branch"),
        (F.greatest(F.count(F.lit(1)) - 1, F.lit(0)) * max(0, delay_ms)).alias("throttle_ms"),
    )


def resolve_version(captures: DataFrame, versions: DataFrame) -> DataFrame:
    """Own override, else the branch's version; LIVE falls back to the literal, PTU to null.

    ``versions`` holds (branch, version), one row per branch.
    """
    known = versions.select("branch", blank_to_null(F.col("version")).alias("branch_version"))
    fallback = F.when(F.col("branch") == "PTU", F.lit(None).cast("string")).otherwise(F.lit("LIVE"))
    return captures.join(known, "branch", "left").withColumn(
        "game_version", F.coalesce(blank_to_null(F.col("draft_version")), "branch_version", fallback)
    ).drop("branch_version")


def _value(c: str, side: Column) -> Column:
    return F.when(side, F.col(c))


def payload_lines(captures: DataFrame, rows: DataFrame, mode: str = "draft") -> DataFrame:
    """Row values routed to the buy or sell columns by tab. Status Unknown becomes null.

    ``draft`` treats an unknown tab as BUY; ``batch`` leaves those captures out.
    """
    heads = captures.select("capture_id", "tab")
    if mode == "batch":
        heads = heads.filter("tab <> 'UNKNOWN'")
    buy = F.col("tab").isin("BUY", "UNKNOWN")
    known = F.nullif(F.col("status"), F.lit(UNKNOWN_STATUS))
    return (
        rows.filter("id_commodity is not null")
        .withColumn("status", known)
        .join(heads, "capture_id")
        .select(
            "capture_id", "row_index", "id_commodity",
            _value("price", buy).alias("price_buy"), _value("scu", buy).alias("scu_buy"),
            _value("status", buy).alias("status_buy"),
            _value("price", ~buy).alias("price_sell"), _value("scu", ~buy).alias("scu_sell"),
            _value("status", ~buy).alias("status_sell"),
        )
    )


def build_payloads(captures: DataFrame, rows: DataFrame, mode: str = "draft", default_production: bool = False) -> DataFrame:
    """Payloads with their rows nested in input order.

    Version, details and what was read about the terminal come from columns of ``captures``
    where it has them (game_version, draft_details, terminal_name, terminal_matched_field,
    terminal_matched_from, needs_review). ``_meta`` is for review and never on the wire.
    A capture above the service's row limit is split into several payloads
    (``part`` 0, 1, ...), so no row is lost and no nested list grows without bound.
    """
    price = F.struct("row_index", "id_commodity", "price_buy", "scu_buy", "status_buy", "price_sell", "scu_sell", "status_sell", "match_score")
    lines = payload_lines(captures, rows, mode)
    told = rows.select("capture_id", "row_index", "match_score") if "match_score" in rows.columns else None
    lines = lines.withColumn("match_score", F.lit(None).cast("double")) if told is None else lines.join(told, ["capture_id", "row_index"])
    nested = lines.groupBy(
        "capture_id", F.floor(F.col("row_index") / MAX_PAYLOAD_ROWS).alias("part")
    ).agg(F.array_sort(F.collect_list(price)).alias("prices"))
    heads = captures.filter("tab <> 'UNKNOWN'") if mode == "batch" else captures
    prices = F.coalesce("prices", F.array().cast(nested.schema["prices"].dataType))
    production = (
        F.coalesce("draft_is_production", F.lit(default_production)).cast("int") if mode == "batch" else F.lit(0)
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("id_terminal").isNull(), F.lit("terminal_unreviewed")),
            F.when(F.col("tab") == "UNKNOWN", F.lit("tab_unknown")),
            F.when(F.size("prices") == 0, F.lit("no_price_rows")),
        )
    )
    has = lambda c, kind="string": F.col(c) if c in captures.columns else F.lit(None).cast(kind)
    flags = F.coalesce(has("needs_review", "array<string>"), F.array().cast("array<string>"))
    review = F.when((F.col("tab") == "UNKNOWN") & ~F.array_contains(flags, "tab_unknown"), F.array_append(flags, F.lit("tab_unknown"))).otherwise(flags)
    return (
        heads.join(nested, "capture_id", "left")
        .withColumn("prices", prices)
        .select(
            "capture_id",
            F.coalesce("part", F.lit(0)).alias("part"),
            F.coalesce("id_terminal", F.lit(0).cast("long")).alias("id_terminal"),
            F.lit("commodity").alias("type"),
            production.alias("is_production"),
            blank_to_null(F.col("container_sizes")).alias("container_sizes"),
            has("game_version").alias("game_version"),
            blank_to_null(has("draft_details")).alias("details"),
            F.transform("prices", lambda p: p.dropFields("match_score")).alias("prices"),
            F.struct(
                F.lit(mode == "draft").alias("draft"),
                F.col("source_image"),
                has("terminal_name").alias("terminal_display_name"),
                F.coalesce(has("terminal_match_score", "double"), F.lit(0.0)).alias("terminal_match_score"),
                has("terminal_matched_from").alias("terminal_matched_from"),
                has("terminal_matched_field").alias("terminal_matched_field"),
                F.lower("tab").alias("tab_detected"),
                F.transform("prices", lambda p: F.bround(p["match_score"]).cast("int")).alias("commodity_match_scores"),
                review.alias("needs_review"),
                warnings.alias("warnings"),
            ).alias("_meta"),
        )
    )


def rejected_captures(captures: DataFrame) -> DataFrame:
    """Captures a batch build refuses because their side is not known."""
    return captures.filter("tab = 'UNKNOWN'")


def to_wire_json(payloads: DataFrame) -> DataFrame:
    """(capture_id, part, body): compact JSON without ``_meta``; null fields are left out."""
    prices = F.transform("prices", lambda p: p.dropFields("row_index"))
    body = F.to_json(F.struct("id_terminal", "type", "is_production", "container_sizes", prices.alias("prices"), "game_version", "details"))
    return payloads.select("capture_id", "part", body.alias("body"))


def write_wire(payloads: DataFrame, path: str) -> None:
    to_wire_json(payloads).select("body").write.mode("errorifexists").text(path)
