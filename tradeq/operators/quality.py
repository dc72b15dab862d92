"""Rules over payloads and captures, drift and duplicate findings, gates.

Row rules are data: (code, severity, SQL condition). The engine turns any rule
list into one array expression per row, so all rules run in a single pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tradeq.functions.text import blank_to_null
from tradeq.operators.ordered import with_winner

OK, INFO, WARNING, ERROR = 0, 1, 2, 3
BLOCK = 3
DUPLICATE_SECONDS = 300

# Fixed thresholds of the checks.
MAX_PRICE = 50_000_000
MAX_SCU = 100_000
IDENTICAL = 0.01
DRIFT_WARNING = 0.05
DRIFT_BLOCK = 0.30


@dataclass(frozen=True)
class Rule:
    code: str
    severity: int
    condition: str


def issues_of(df: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """One row per broken rule. A null condition counts as not broken."""
    hits = [
        F.when(F.expr(r.condition), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity")))
        for r in rules
    ]
    return df.select(*keys, F.inline(F.array_compact(F.array(*hits))))


def _sides(template: str) -> str:
    return " or ".join(f"({template.format(s)})" for s in ("buy", "sell"))


PAYLOAD_RULES = [
    Rule("terminal_missing", ERROR, "id_terminal is null or id_terminal <= 0"),
    Rule("terminal_unknown", ERROR, "id_terminal > 0 and not terminal_known"),
    Rule("type_invalid", ERROR, "type is null or lower(type) <> 'commodity'"),
    Rule("is_production_invalid", ERROR, "is_production is null or is_production not in (0, 1)"),
    Rule("no_rows", ERROR, "n_rows = 0"),
]

_HAS = "(price_{0} is not null or scu_{0} is not null or status_{0} is not null)"


def _row_rules() -> list[Rule]:
    rules = [
        Rule("commodity_missing", ERROR, "missing"),
        Rule("commodity_unknown", ERROR, "not missing and not commodity_known"),
        Rule("duplicate_row", ERROR, "repeated"),
        Rule("buy_sell_exclusive", ERROR, f"not missing and {_HAS.format('buy')} and {_HAS.format('sell')}"),
        Rule(
            "row_empty",
            WARNING,
            f"not missing and not {_HAS.format('buy')} and not {_HAS.format('sell')} and not is_missing <=> 1",
        ),
    ]
    for s in ("buy", "sell"):
        rules += [
            Rule("status_out_of_range", ERROR, f"not missing and (status_{s} < 1 or status_{s} > 7)"),
            Rule("price_negative", ERROR, f"not missing and price_{s} < 0"),
            Rule("price_zero", WARNING, f"not missing and price_{s} = 0"),
            Rule("price_huge", WARNING, f"not missing and price_{s} > {MAX_PRICE}"),
            Rule("scu_negative", ERROR, f"not missing and scu_{s} < 0"),
            Rule("scu_huge", WARNING, f"not missing and scu_{s} > {MAX_SCU}"),
        ]
    # the empty-row test negates a null-safe comparison
    return [Rule(r.code, r.severity, r.condition.replace("not is_missing <=> 1", "not (is_missing <=> 1)")) for r in rules]


ROW_RULES = _row_rules()


def unknown_refs(df: DataFrame, key: str, catalog: DataFrame) -> DataFrame:
    """Rows whose positive ``key`` is not an id of the catalog."""
    ids = catalog.select(F.col("id").alias(key)).distinct()
    return df.filter(F.col(key) > 0).join(ids, key, "left_anti")


def _with_known(df: DataFrame, key: str, catalog: DataFrame, out: str) -> DataFrame:
    ids = catalog.select(F.col("id").alias(key)).distinct().withColumn(out, F.lit(True))
    return df.join(ids, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def validate_payloads(payloads: DataFrame, rows: DataFrame, terminals: DataFrame, commodities: DataFrame) -> DataFrame:
    """(payload_id, row_index, code, severity); row_index is null for payload-level issues."""
    counts = rows.groupBy("payload_id").agg(F.count(F.lit(1)).alias("n_rows"))
    heads = _with_known(payloads, "id_terminal", terminals, "terminal_known").join(counts, "payload_id", "left")
    heads = heads.withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).withColumn("row_index", F.lit(None).cast("int"))
    first = with_winner(rows.filter("id_commodity > 0"), ["payload_id", "id_commodity"], {"row_index": F.col("row_index")})
    named = first.withColumn("missing", F.lit(False)).withColumn("repeated", F.col("row_index") > F.col("winner.row_index"))
    nameless = rows.filter("id_commodity is null or id_commodity <= 0").withColumns(
        {"missing": F.lit(True), "repeated": F.lit(False)}
    )
    lines = _with_known(named.drop("winner").unionByName(nameless), "id_commodity", commodities, "commodity_known")
    keys = ["payload_id", "row_index"]
    return issues_of(heads, keys, PAYLOAD_RULES).unionByName(issues_of(lines, keys, ROW_RULES))


def rollup_issues(payloads: DataFrame, issues: DataFrame) -> DataFrame:
    """Per payload: blocking flag, worst severity, counts; clean payloads appear as OK."""
    per = issues.groupBy("payload_id").agg(
        F.max("severity").alias("worst"),
        F.count_if(F.col("severity") == ERROR).alias("n_errors"),
        F.count_if(F.col("severity") == WARNING).alias("n_warnings"),
        F.count_if(F.col("severity") == INFO).alias("n_infos"),
    )
    zero = ["worst", "n_errors", "n_warnings", "n_infos"]
    return (
        payloads.select("payload_id")
        .join(per, "payload_id", "left")
        .fillna(0, subset=zero)
        .withColumn("is_blocking", F.col("n_errors") > 0)
    )


def review_rules() -> list[Rule]:
    return [
        Rule("terminal_missing", ERROR, "id_terminal is null and terminal_text is null"),
        Rule("terminal_unresolved", ERROR, "id_terminal is null and terminal_text is not null"),
        Rule("terminal_ambiguous_unconfirmed", ERROR, "id_terminal is not null and is_ambiguous and not terminal_confirmed"),
        Rule("terminal_low_match", WARNING, "id_terminal is not null and terminal_match_score > 0 and terminal_match_score < 80"),
        Rule(
            "image_aspect_unusual",
            WARNING,
            "width > 0 and height > 0 and (width / height < 1.6 or width / height > 2.4)",
        ),
        Rule("no_rows", ERROR, "n_rows = 0"),
        Rule("tab_unknown", ERROR, "tab = 'UNKNOWN'"),
    ]


REVIEW_ROW_RULES = [
    Rule("row_no_commodity", ERROR, "id_commodity is null"),
    Rule("row_match_too_low", ERROR, "id_commodity is not null and match_score > 0 and match_score < 85"),
    Rule("row_match_imperfect", WARNING, "id_commodity is not null and match_score >= 85 and match_score < 100"),
    Rule("row_scu_missing", ERROR, "id_commodity is not null and (scu is null or (scu <= 0 and status <> 1))"),
    Rule("row_price_missing", ERROR, "id_commodity is not null and (price is null or price <= 0)"),
    Rule("row_status_unknown", ERROR, "id_commodity is not null and status = 0"),
]


def review_issues(captures: DataFrame, rows: DataFrame, terminals: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """First gate, before a payload exists. ``ambiguous`` holds upper-cased names.

    ``terminal_text``, where captures have it, is what was typed for a terminal not yet picked.
    """
    from tradeq.operators.catalog import name_key

    counts = rows.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n_rows"))
    unclear = (
        terminals.select(F.col("id").alias("id_terminal"), F.upper(name_key()).alias("name_key"))
        .join(ambiguous.select("name_key"), "name_key", "left_semi")
        .select("id_terminal", F.lit(True).alias("is_ambiguous"))
    )
    heads = (
        captures.join(counts, "capture_id", "left")
        .join(unclear, "id_terminal", "left")
        .withColumns(
            {
                "n_rows": F.coalesce("n_rows", F.lit(0)),
                "is_ambiguous": F.coalesce("is_ambiguous", F.lit(False)),
                "row_index": F.lit(None).cast("int"),
                "terminal_text": blank_to_null(F.col("terminal_text")) if "terminal_text" in captures.columns else F.lit(None).cast("string"),
            }
        )
    )
    keys = ["capture_id", "row_index"]
    return issues_of(heads, keys, review_rules()).unionByName(issues_of(rows, keys, REVIEW_ROW_RULES))


def review_flags(captures: DataFrame, rows: DataFrame) -> DataFrame:
    """(capture_id, row_index, flag), one row per flag; row_index is null for the capture itself.

    The tab always leaves a flag: either it is unknown or it was assumed.
    """
    score = lambda c: F.concat(F.lit(" ("), F.bround(c).cast("int").cast("string"), F.lit(")"))
    head = F.array_compact(
        F.array(
            F.when(F.col("id_terminal").isNull(), F.lit("terminal_not_detected")).when(
                F.col("terminal_match_score") < 90,
                F.concat(F.lit("terminal_match_low_confidence"), score(F.col("terminal_match_score"))),
            ),
            F.when(F.col("tab") == "UNKNOWN", F.lit("tab_unknown")).otherwise(
                F.concat(F.lit("tab_assumed_"), F.lower("tab"))
            ),
        )
    )
    row = F.array_compact(
        F.array(
            F.when(F.col("match_score") < 90, F.concat(F.lit("commodity_low_confidence"), score(F.col("match_score")))),
            F.when(F.col("scu").isNull(), F.lit("scu_missing")),
            F.when(F.col("price").isNull(), F.lit("price_missing")),
            F.when(F.col("status") == 0, F.lit("status_unknown")),
        )
    )
    of_capture = captures.select("capture_id", F.lit(None).cast("int").alias("row_index"), F.explode(head).alias("flag"))
    return of_capture.unionByName(rows.select("capture_id", "row_index", F.explode(row).alias("flag")))


def needs_review(captures: DataFrame, rows: DataFrame) -> DataFrame:
    """Flag count and status per capture. Ready means no flag and a known terminal."""
    counts = review_flags(captures, rows).groupBy("capture_id").agg(F.count(F.lit(1)).alias("n_flags"))
    ready = (F.col("n_flags") == 0) & F.col("id_terminal").isNotNull()
    return (
        captures.join(counts, "capture_id", "left")
        .withColumn("n_flags", F.coalesce("n_flags", F.lit(0)))
        .withColumn("review_status", F.when(ready, "READY").otherwise("REVIEW"))
    )


def dup_guard(rows: DataFrame, submissions: DataFrame, window: int = DUPLICATE_SECONDS) -> DataFrame:
    """Rows with an OK submission of the same (terminal, commodity) in the window before ``sent_at``.

    Time is cut into buckets of one window. A submission in the row's own bucket
    counts iff the bucket's first is not later than the row; one in the bucket
    before counts iff that bucket's last is at most one window old. So first and
    last per bucket decide exactly, and the interval join becomes two equi-joins
    whose hot keys are spread over time.
    """
    keys = ["id_terminal", "id_commodity"]
    bucket = F.floor(F.col("sent_at") / window)
    sent = (
        submissions.filter("ok")
        .select(
            "id_terminal",
            F.explode(F.from_json("submitted_commodity_ids", "array<bigint>")).alias("id_commodity"),
            "sent_at",
        )
        .groupBy(*keys, bucket.alias("bucket"))
        .agg(F.min("sent_at").alias("first_ok"), F.max("sent_at").alias("last_ok"))
    )
    same = sent.select(*keys, "bucket", "first_ok")
    before = sent.select(*keys, (F.col("bucket") + 1).alias("bucket"), "last_ok")
    hit = (F.col("first_ok") <= F.col("sent_at")) | (F.col("last_ok") >= F.col("sent_at") - window)
    return (
        rows.filter("id_terminal > 0")
        .withColumn("bucket", bucket)
        .join(same, [*keys, "bucket"], "left")
        .join(before, [*keys, "bucket"], "left")
        .filter(F.coalesce(hit, F.lit(False)))
        .select(*rows.columns)
    )


def asof_last_price(events: DataFrame, prices: DataFrame, keys: list[str], bucket_seconds: int = 7 * 86400) -> DataFrame:
    """Last price at or before each event. Both need ``ts`` in whole seconds; prices carry ``price``.

    Prices of one second become the highest of them, and events of one second are looked up
    once, both combined before the shuffle. So one (key, bucket) has two rows a second at
    most, however hot the key is: a bounded sort, in which a union and a running ``last``
    find the price. Times before the bucket's first price take the last one of an earlier
    bucket, from a table with one row per (key, bucket). The answers go back to the events by
    an equi-join. No range join.
    """
    bucket = F.floor(F.col("ts") / bucket_seconds).alias("bucket")
    seen = F.struct("ts", "price")
    p = prices.groupBy(*keys, "ts").agg(F.max("price").alias("price")).select(
        *keys, bucket, "ts", F.lit(0).alias("kind"), seen.alias("seen")
    )
    none = F.lit(None).cast(p.schema["seen"].dataType)
    e = events.select(*keys, "ts").distinct().select(*keys, bucket, "ts", F.lit(1).alias("kind"), none.alias("seen"))
    w = W.partitionBy(*keys, "bucket").orderBy("ts", "kind").rowsBetween(W.unboundedPreceding, 0)
    inside = p.unionByName(e).withColumn("inside", F.last("seen", ignorenulls=True).over(w)).filter("kind = 1")
    lasts = prices.groupBy(*keys, bucket).agg(F.max(seen).alias("seen"))
    asked = events.select(*keys, bucket, none.alias("seen")).distinct()
    back = W.partitionBy(*keys).orderBy("bucket").rangeBetween(W.unboundedPreceding, -1)
    carried = (
        lasts.unionByName(asked)
        .withColumn("carried", F.max("seen").over(back))
        .groupBy(*keys, "bucket")
        .agg(F.max("carried").alias("carried"))
    )
    found = F.coalesce("inside", "carried")
    answers = inside.join(carried, [*keys, "bucket"], "left").select(
        *keys, "ts", found["price"].alias("last_price"), found["ts"].alias("last_ts")
    )
    return events.join(answers, [*keys, "ts"], "left").select(*events.columns, "last_price", "last_ts")


def drift_findings(rows: DataFrame, live: DataFrame, now: int) -> DataFrame:
    """One finding per row and priced side against the last live price.

    A row with no live record gives one INFO. A negative live price gives none, and
    neither does a row without a terminal.
    """
    order = F.struct("live_id")
    first = live.groupBy("id_terminal", "id_commodity").agg(
        F.min_by(F.struct("price_buy", "price_sell", "date_modified"), order).alias("live")
    )
    joined = rows.filter("id_terminal > 0").join(first, ["id_terminal", "id_commodity"], "left")
    fresh = F.coalesce(F.lit(now) - F.col("live.date_modified") < DUPLICATE_SECONDS, F.lit(False))

    def appraise(side: str) -> Column:
        local, remote = F.col(f"price_{side}"), F.col(f"live.price_{side}")
        diff = F.abs(local - remote) / remote
        finding = lambda severity, reason, d=None: F.struct(
            F.lit(side).alias("side"),
            F.lit(severity).alias("severity"),
            F.lit(reason).alias("reason"),
            (diff if d is None else d).alias("diff"),
        )
        none = F.lit(None).cast("double")
        compared = (
            F.when((diff < IDENTICAL) & fresh, finding(BLOCK, "identical_recent"))
            .when(diff > DRIFT_BLOCK, finding(BLOCK, "drift_block"))
            .when(diff > DRIFT_WARNING, finding(WARNING, "drift_warning"))
            .when(diff < IDENTICAL, finding(INFO, "matches_live"))
            .otherwise(finding(INFO, "within_tolerance"))
        )
        return F.when(local.isNotNull() & (remote > 0), compared).when(
            local.isNotNull() & (remote.isNull() | (remote == 0)), finding(INFO, "first_known", none)
        )

    unknown = F.struct(
        F.lit(None).cast("string").alias("side"),
        F.lit(INFO).alias("severity"),
        F.lit("no_live_row").alias("reason"),
        F.lit(None).cast("double").alias("diff"),
    )
    found = F.when(F.col("live").isNull(), F.array(unknown)).otherwise(
        F.array_compact(F.array(appraise("buy"), appraise("sell")))
    )
    return joined.select("payload_id", "row_index", "id_terminal", "id_commodity", F.inline(found))


def gate(plan: DataFrame, issues: DataFrame, findings: DataFrame, skip_duplicates: bool = False) -> DataFrame:
    """Outcome per planned payload (``payload_id``, ``n_rows``), checks in fixed order."""
    invalid = issues.groupBy("payload_id").agg(F.max("severity").alias("worst_issue"))
    found = findings.groupBy("payload_id").agg(F.max("severity").alias("worst_finding"))
    duplicate = (F.col("worst_finding") == BLOCK) & F.lit(not skip_duplicates)
    return (
        plan.join(invalid, "payload_id", "left")
        .join(found, "payload_id", "left")
        .withColumn(
            "outcome",
            F.when(F.col("n_rows") == 0, "skipped")
            .when(F.col("worst_issue") == ERROR, "validation_blocked")
            .when(duplicate, "duplicated_report")
            .otherwise("eligible"),
        )
    )


def can_send() -> Column:
    """(no block or override) and (nothing to acknowledge or acknowledged)."""
    blocked = F.col("is_blocking") | (F.col("worst_finding") == BLOCK)
    warned = (F.col("n_warnings") > 0) | F.col("worst_finding").isin(INFO, WARNING)
    return (~blocked | F.col("override_block")) & (~warned | F.col("acknowledged"))


# Fixed table: API rejection status to hint, lower case.
REJECTION_HINTS = {
    "not_allowed": "credentials",
    "no_api_found": "credentials",
    "user_not_allowed": "credentials",
    "screenshot_required": "attach a screenshot",
    "missing_secret_key": "save the secret key",
    "invalid_secret_key": "check the secret key",
    "screenshot_length_exceeds_limit": "use a smaller image",
    "image_upload_error": "try another image",
    "image_storage_error": "try another image",
    "user_disabled": "account disabled",
    "duplicated_report": "wait five minutes or change a value",
    "ptu_reports_not_allowed": "test branch closed",
    "invalid_game_version": "fix the version",
    "max_rows_exceeded": "split into batches of 500 rows",
    "too_many_reports": "wait for the rate limit",
}


def explain_rejections(submissions: DataFrame) -> DataFrame:
    """Hint for each rejected status from the fixed table; null when there is none."""
    table = F.create_map(*[F.lit(x) for pair in REJECTION_HINTS.items() for x in pair])
    return submissions.withColumn("hint", F.try_element_at(table, F.lower(F.coalesce("api_status", F.lit("")))))
