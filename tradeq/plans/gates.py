"""Queries over validation, drift, duplicates, batches and the submission log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeq.operators import audit as A
from tradeq.operators import batch as B
from tradeq.operators import catalog as C
from tradeq.operators import quality as Q
from tradeq.plans.prices import _KEYED
from tradeq.plans.registry import query
from tradeq.plans.views import using
from tradeq.session import settle, shared_dir
from tradeq.sources.market import LOG_NOW, NOW, Market

# ---- static validation -------------------------------------------------------

_HAS_BUY = "(price_buy IS NOT NULL OR scu_buy IS NOT NULL OR status_buy IS NOT NULL)"
_HAS_SELL = "(price_sell IS NOT NULL OR scu_sell IS NOT NULL OR status_sell IS NOT NULL)"


def _side_checks() -> str:
    out = []
    for s in ("buy", "sell"):
        for code, severity, cond in (
            ("status_out_of_range", 3, f"(status_{s}<1 OR status_{s}>7)"),
            ("price_negative", 3, f"price_{s}<0"),
            ("price_zero", 2, f"price_{s}=0"),
            ("price_huge", 2, f"price_{s}>50000000"),
            ("scu_negative", 3, f"scu_{s}<0"),
            ("scu_huge", 2, f"scu_{s}>100000"),
        ):
            out.append(f"SELECT payload_id, row_index, '{code}', {severity} FROM checked WHERE id_commodity>0 AND {cond}")
    return " UNION ALL ".join(out)


ISSUE_VIEWS = {
    "heads": """SELECT p.*, (SELECT count(*) FROM payload_rows r WHERE r.payload_id=p.payload_id) AS n_rows,
        EXISTS (SELECT 1 FROM terminals t WHERE t.id=p.id_terminal) AS terminal_known FROM payloads p""",
    "checked": """SELECT r.*, EXISTS (SELECT 1 FROM commodities c WHERE c.id=r.id_commodity) AS commodity_known,
        row_number() OVER (PARTITION BY payload_id, id_commodity ORDER BY row_index) AS nth FROM payload_rows r""",
    "issues": f"""SELECT payload_id, NULL AS row_index, 'terminal_missing' AS code, 3 AS severity FROM heads WHERE id_terminal<=0
        UNION ALL SELECT payload_id, NULL, 'terminal_unknown', 3 FROM heads WHERE id_terminal>0 AND NOT terminal_known
        UNION ALL SELECT payload_id, NULL, 'type_invalid', 3 FROM heads WHERE lower(type)<>'commodity'
        UNION ALL SELECT payload_id, NULL, 'is_production_invalid', 3 FROM heads WHERE is_production NOT IN (0,1)
        UNION ALL SELECT payload_id, NULL, 'no_rows', 3 FROM heads WHERE n_rows=0
        UNION ALL SELECT payload_id, row_index, 'commodity_missing', 3 FROM checked WHERE id_commodity<=0
        UNION ALL SELECT payload_id, row_index, 'commodity_unknown', 3 FROM checked WHERE id_commodity>0 AND NOT commodity_known
        UNION ALL SELECT payload_id, row_index, 'duplicate_row', 3 FROM checked WHERE id_commodity>0 AND nth>1
        UNION ALL SELECT payload_id, row_index, 'buy_sell_exclusive', 3 FROM checked WHERE id_commodity>0 AND {_HAS_BUY} AND {_HAS_SELL}
        UNION ALL SELECT payload_id, row_index, 'row_empty', 2 FROM checked
            WHERE id_commodity>0 AND NOT {_HAS_BUY} AND NOT {_HAS_SELL} AND is_missing IS DISTINCT FROM 1
        UNION ALL {_side_checks()}""",
    "issue_totals": """SELECT payload_id, max(severity) AS worst, count(*) FILTER (WHERE severity=3) AS n_errors,
        count(*) FILTER (WHERE severity=2) AS n_warnings, count(*) FILTER (WHERE severity=1) AS n_infos
        FROM issues GROUP BY 1""",
    "rollup": """SELECT p.payload_id, coalesce(worst,0) AS worst, coalesce(n_errors,0) AS n_errors,
        coalesce(n_warnings,0) AS n_warnings, coalesce(n_infos,0) AS n_infos, coalesce(n_errors,0)>0 AS is_blocking
        FROM payloads p LEFT JOIN issue_totals USING (payload_id)""",
}
_ISSUES = "payloads payload_rows terminals commodities"


def issues_of(m: Market) -> DataFrame:
    return Q.validate_payloads(m.payloads(), m.payload_rows(), m.terminals(), m.commodities())


@query("payload_issues", using(_ISSUES, "SELECT * FROM issues", ISSUE_VIEWS))
def payload_issues(m: Market):
    return issues_of(m)


@query("unknown_references", using(_ISSUES, """
    SELECT 'terminal' AS kind, id_terminal AS id, count(*) AS n FROM payloads p
    WHERE id_terminal>0 AND NOT EXISTS (SELECT 1 FROM terminals t WHERE t.id=p.id_terminal) GROUP BY 2
    UNION ALL
    SELECT 'commodity', id_commodity, count(*) FROM payload_rows r
    WHERE id_commodity>0 AND NOT EXISTS (SELECT 1 FROM commodities c WHERE c.id=r.id_commodity) GROUP BY 2"""))
def unknown_references(m: Market):
    def count(df, key, kind):
        return df.groupBy(F.lit(kind).alias("kind"), F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))

    lost = Q.unknown_refs(m.payloads(), "id_terminal", m.terminals())
    missing = Q.unknown_refs(m.payload_rows(), "id_commodity", m.commodities())
    return count(lost, "id_terminal", "terminal").unionByName(count(missing, "id_commodity", "commodity"))


@query("issue_rollup", using(_ISSUES, "SELECT * FROM rollup", ISSUE_VIEWS))
def issue_rollup(m: Market):
    return Q.rollup_issues(m.payloads(), issues_of(m))


_REVIEW = {
    "rc": "SELECT c.*, (SELECT count(*) FROM capture_rows r WHERE r.capture_id=c.capture_id) AS n_rows, "
          "EXISTS (SELECT 1 FROM keyed k JOIN ambiguous USING (name_key) WHERE k.id=c.id_terminal) AS is_ambiguous FROM captures c",
}


@query("review_issues", using("captures capture_rows terminals", """
    SELECT capture_id, NULL AS row_index, 'terminal_missing' AS code, 3 AS severity FROM rc WHERE id_terminal IS NULL
    UNION ALL SELECT capture_id, NULL, 'terminal_ambiguous_unconfirmed', 3 FROM rc
      WHERE id_terminal IS NOT NULL AND is_ambiguous AND NOT terminal_confirmed
    UNION ALL SELECT capture_id, NULL, 'terminal_low_match', 2 FROM rc
      WHERE id_terminal IS NOT NULL AND terminal_match_score>0 AND terminal_match_score<80
    UNION ALL SELECT capture_id, NULL, 'image_aspect_unusual', 2 FROM rc
      WHERE width>0 AND height>0 AND (width/CAST(height AS DOUBLE)<1.6 OR width/CAST(height AS DOUBLE)>2.4)
    UNION ALL SELECT capture_id, NULL, 'no_rows', 3 FROM rc WHERE n_rows=0
    UNION ALL SELECT capture_id, NULL, 'tab_unknown', 3 FROM rc WHERE tab='UNKNOWN'
    UNION ALL SELECT capture_id, row_index, 'row_no_commodity', 3 FROM capture_rows WHERE id_commodity IS NULL
    UNION ALL SELECT capture_id, row_index, 'row_match_too_low', 3 FROM capture_rows
      WHERE id_commodity IS NOT NULL AND match_score>0 AND match_score<85
    UNION ALL SELECT capture_id, row_index, 'row_match_imperfect', 2 FROM capture_rows
      WHERE id_commodity IS NOT NULL AND match_score>=85 AND match_score<100
    UNION ALL SELECT capture_id, row_index, 'row_scu_missing', 3 FROM capture_rows
      WHERE id_commodity IS NOT NULL AND (scu IS NULL OR (scu<=0 AND status<>1))
    UNION ALL SELECT capture_id, row_index, 'row_price_missing', 3 FROM capture_rows
      WHERE id_commodity IS NOT NULL AND (price IS NULL OR price<=0)
    UNION ALL SELECT capture_id, row_index, 'row_status_unknown', 3 FROM capture_rows
      WHERE id_commodity IS NOT NULL AND status=0""", _KEYED | _REVIEW))
def review_issues(m: Market):
    terminals = m.terminals()
    return Q.review_issues(m.captures(), m.capture_rows(), terminals, C.ambiguous_names(terminals))


_FLAGS = {
    "flags": """SELECT capture_id, NULL AS row_index, CASE WHEN id_terminal IS NULL THEN 'terminal_not_detected'
          ELSE 'terminal_match_low_confidence ('||CAST(terminal_match_score AS INT)||')' END AS flag FROM captures
        WHERE id_terminal IS NULL OR terminal_match_score<90
        UNION ALL SELECT capture_id, NULL, CASE WHEN tab='UNKNOWN' THEN 'tab_unknown' ELSE 'tab_assumed_'||lower(tab) END FROM captures
        UNION ALL SELECT capture_id, row_index, 'commodity_low_confidence ('||CAST(match_score AS INT)||')' FROM capture_rows WHERE match_score<90
        UNION ALL SELECT capture_id, row_index, 'scu_missing' FROM capture_rows WHERE scu IS NULL
        UNION ALL SELECT capture_id, row_index, 'price_missing' FROM capture_rows WHERE price IS NULL
        UNION ALL SELECT capture_id, row_index, 'status_unknown' FROM capture_rows WHERE status=0""",
}


@query("review_flags", using("captures capture_rows", "SELECT * FROM flags", _FLAGS))
def review_flags(m: Market):
    return Q.review_flags(m.captures(), m.capture_rows())


@query("review_status", using("captures capture_rows", """
    SELECT capture_id, count(flag) AS n_flags,
      CASE WHEN count(flag)=0 AND any_value(id_terminal) IS NOT NULL THEN 'READY' ELSE 'REVIEW' END AS review_status
    FROM captures LEFT JOIN flags USING (capture_id) GROUP BY 1""", _FLAGS))
def review_status(m: Market):
    return Q.needs_review(m.captures(), m.capture_rows()).select("capture_id", "n_flags", "review_status")


# ---- duplicates and drift ----------------------------------------------------


def _log_rows(m: Market) -> DataFrame:
    """Every log entry asks again for its commodities two minutes after it was sent."""
    return m.submissions().select(
        F.col("id").alias("payload_id"),
        "id_terminal",
        F.explode(F.from_json("submitted_commodity_ids", "array<bigint>")).alias("id_commodity"),
        (F.col("sent_at") + 120 + F.col("id") % 300).alias("sent_at"),
    )


_DUP = """SELECT q.payload_id, q.id_terminal, q.id_commodity, q.sent_at
    FROM (SELECT id AS payload_id, id_terminal, id_commodity, sent_at+120+id%300 AS sent_at FROM submitted_ids) q
    WHERE q.id_terminal>0 AND EXISTS (SELECT 1 FROM submitted_ids s WHERE s.ok AND s.id_terminal=q.id_terminal
      AND s.id_commodity=q.id_commodity AND s.sent_at BETWEEN q.sent_at-300 AND q.sent_at)"""


@query("duplicate_guard", using("submitted_ids", _DUP))
def duplicate_guard(m: Market):
    return Q.dup_guard(_log_rows(m), m.submissions())


_DRIFT = {
    "mine": """SELECT payload_id, row_index, id_terminal, id_commodity,
        CASE WHEN row_index%2=0 THEN price_buy ELSE price_buy*1.003 END AS price_buy,
        CASE WHEN row_index%3=0 THEN price_sell*1.04 WHEN row_index%3=1 THEN price_sell*1.2 ELSE price_sell END AS price_sell
        FROM (SELECT id_terminal AS payload_id, id_commodity%3 + row_number() OVER (PARTITION BY id_terminal ORDER BY id_commodity) AS row_index,
              id_terminal, id_commodity + (CASE WHEN id_commodity%17=0 THEN 10000000 ELSE 0 END) AS id_commodity, price_buy, price_sell FROM prices_all)""",
    "live": f"""SELECT id_terminal, id_commodity, CASE id_commodity%7 WHEN 0 THEN -price_buy WHEN 1 THEN 0.0 WHEN 2 THEN price_buy*1.02 ELSE price_buy END AS price_buy,
        CASE WHEN id_commodity%5=0 THEN NULL ELSE price_sell END AS price_sell,
        CASE WHEN id_commodity%4=0 THEN {NOW}-60 ELSE date_modified END AS date_modified FROM prices_all""",
    "sides": f"""SELECT m.payload_id, m.row_index, m.id_terminal, m.id_commodity, side,
        CASE WHEN side='buy' THEN m.price_buy ELSE m.price_sell END AS l,
        CASE WHEN side='buy' THEN v.price_buy ELSE v.price_sell END AS r,
        v.id_terminal IS NOT NULL AS has_live, coalesce({NOW}-v.date_modified<300,false) AS fresh
        FROM (SELECT * FROM mine WHERE id_terminal>0) m LEFT JOIN live v USING (id_terminal, id_commodity), (SELECT unnest(['buy','sell']) AS side)""",
    "found": """SELECT DISTINCT payload_id, row_index, id_terminal, id_commodity, NULL AS side, 1 AS severity, 'no_live_row' AS reason, NULL::DOUBLE AS diff
        FROM sides WHERE NOT has_live
        UNION ALL
        SELECT payload_id, row_index, id_terminal, id_commodity, side,
          CASE WHEN abs(l-r)/r<0.01 AND fresh THEN 3 WHEN abs(l-r)/r>0.3 THEN 3 WHEN abs(l-r)/r>0.05 THEN 2 ELSE 1 END,
          CASE WHEN abs(l-r)/r<0.01 AND fresh THEN 'identical_recent' WHEN abs(l-r)/r>0.3 THEN 'drift_block'
               WHEN abs(l-r)/r>0.05 THEN 'drift_warning' WHEN abs(l-r)/r<0.01 THEN 'matches_live' ELSE 'within_tolerance' END,
          abs(l-r)/r FROM sides WHERE has_live AND l IS NOT NULL AND r>0
        UNION ALL
        SELECT payload_id, row_index, id_terminal, id_commodity, side, 1, 'first_known', NULL FROM sides
        WHERE has_live AND l IS NOT NULL AND (r IS NULL OR r=0)""",
}


def _drift_inputs(m: Market) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window as W

    c, i = F.col("id_commodity"), F.col("row_index")
    w = W.partitionBy("id_terminal").orderBy("id_commodity")
    mine = m.prices_all().withColumn("row_index", c % 3 + F.row_number().over(w)).select(
        F.col("id_terminal").alias("payload_id"),
        "row_index",
        "id_terminal",
        (c + F.when(c % 17 == 0, 10000000).otherwise(0)).alias("id_commodity"),
        F.when(i % 2 == 0, F.col("price_buy")).otherwise(F.col("price_buy") * 1.003).alias("price_buy"),
        F.when(i % 3 == 0, F.col("price_sell") * 1.04).when(i % 3 == 1, F.col("price_sell") * 1.2)
        .otherwise(F.col("price_sell")).alias("price_sell"),
    )
    live = m.prices_all().select(
        "id_terminal",
        "id_commodity",
        F.lit(1).alias("live_id"),
        F.when(c % 7 == 0, -F.col("price_buy")).when(c % 7 == 1, 0.0).when(c % 7 == 2, F.col("price_buy") * 1.02)
        .otherwise(F.col("price_buy")).alias("price_buy"),
        F.when(c % 5 != 0, F.col("price_sell")).alias("price_sell"),
        F.when(c % 4 == 0, F.lit(NOW - 60)).otherwise(F.col("date_modified")).alias("date_modified"),
    )
    return mine, live


@query("drift_findings", using("prices_all", """
    SELECT payload_id, row_index, id_terminal, id_commodity, side, severity, reason, round(diff,6) AS diff FROM found""", _DRIFT))
def drift_findings(m: Market):
    mine, live = _drift_inputs(m)
    return Q.drift_findings(mine, live, NOW).withColumn("diff", F.round("diff", 6))


@query("asof_prices", using("observations payloads payload_rows", """
    SELECT e.payload_id, e.row_index, e.ts, p.ts AS last_ts, round(p.price,2) AS last_price
    FROM (SELECT DISTINCT payload_id, row_index, id_commodity, sent_at AS ts FROM payload_rows JOIN payloads USING (payload_id)) e
    ASOF LEFT JOIN (SELECT id_commodity, ts, max(price) AS price FROM observations GROUP BY 1,2) p
    ON e.id_commodity=p.id_commodity AND e.ts>=p.ts"""))
def asof_prices(m: Market):
    """Price of the commodity as last seen when the payload was sent."""
    events = m.payload_rows().join(m.payloads(), "payload_id").select(
        "payload_id", "row_index", "id_commodity", F.col("sent_at").alias("ts")
    )
    prices = m.observations().select("id_commodity", "ts", "price")
    found = Q.asof_last_price(events, prices, ["id_commodity"])
    return found.select("payload_id", "row_index", "ts", "last_ts", F.round("last_price", 2).alias("last_price"))


_GATE = ISSUE_VIEWS | {
    "plan": "SELECT payload_id, n_rows FROM heads",
    "dup": """SELECT DISTINCT p.payload_id FROM payloads p JOIN payload_rows r USING (payload_id)
        WHERE EXISTS (SELECT 1 FROM payload_rows r2 JOIN payloads p2 USING (payload_id) WHERE r2.id_commodity=r.id_commodity
          AND p2.id_terminal=p.id_terminal AND p2.payload_id%2=0 AND p2.sent_at BETWEEN p.sent_at-86400*30-1 AND p.sent_at-1)""",
}


def _dup_findings(m: Market) -> DataFrame:
    """Payloads repeating what an accepted (even-numbered) payload sent within 30 days before."""
    rows = m.payload_rows().join(m.payloads().select("payload_id", "id_terminal", "sent_at"), "payload_id")
    log = rows.filter("payload_id % 2 = 0").select(
        "id_terminal",
        F.lit(True).alias("ok"),
        F.concat(F.lit("["), F.col("id_commodity").cast("string"), F.lit("]")).alias("submitted_commodity_ids"),
        "sent_at",
    )
    asked = rows.select("payload_id", "id_terminal", "id_commodity", (F.col("sent_at") - 1).alias("sent_at"))
    return Q.dup_guard(asked, log, 30 * 86400).select("payload_id", F.lit(Q.BLOCK).alias("severity"))


def _live_prices(m: Market) -> DataFrame:
    return m.prices_all().select("id_terminal", "id_commodity", "price_buy", "price_sell", "date_modified", F.lit(1).alias("live_id"))


def _findings(m: Market) -> DataFrame:
    """Duplicate and drift findings of the payloads, against what was sent and the live prices."""
    rows = m.payload_rows().join(m.payloads().select("payload_id", "id_terminal"), "payload_id")
    drift = Q.drift_findings(rows, _live_prices(m), NOW).select("payload_id", "severity")
    return _dup_findings(m).unionByName(drift)


_FULL_GATE = _GATE | {
    "pr": "SELECT r.*, p.id_terminal FROM payload_rows r JOIN payloads p USING (payload_id) WHERE p.id_terminal>0",
    "both_sides": f"""SELECT r.payload_id, unnest([r.price_buy, r.price_sell]) AS l, unnest([v.price_buy, v.price_sell]) AS remote,
        v.id_terminal IS NOT NULL AS has_live, coalesce({NOW}-v.date_modified<300,false) AS fresh
        FROM pr r LEFT JOIN prices_all v USING (id_terminal, id_commodity)""",
    "drift": """SELECT payload_id, 1 AS severity FROM both_sides WHERE NOT has_live
        UNION ALL SELECT payload_id, CASE WHEN abs(l-remote)/remote<0.01 AND fresh THEN 3 WHEN abs(l-remote)/remote>0.3 THEN 3
          WHEN abs(l-remote)/remote>0.05 THEN 2 ELSE 1 END FROM both_sides WHERE has_live AND l IS NOT NULL AND remote>0
        UNION ALL SELECT payload_id, 1 FROM both_sides WHERE has_live AND l IS NOT NULL AND (remote IS NULL OR remote=0)""",
    "worst_found": """SELECT payload_id, max(severity) AS wf FROM (SELECT * FROM drift UNION ALL SELECT payload_id, 3 FROM dup) GROUP BY 1""",
}


@query("gate_pipeline", using(_ISSUES + " prices_all", """
    SELECT payload_id, n_rows, outcome, (NOT (is_blocking OR wf=3) OR payload_id%3=0)
        AND (NOT (n_warnings>0 OR wf IN (1,2)) OR payload_id%2=0) AS can_send
    FROM (SELECT payload_id, n_rows, is_blocking, n_warnings, coalesce(wf,0) AS wf, CASE WHEN n_rows=0 THEN 'skipped' WHEN worst=3 THEN 'validation_blocked'
        WHEN wf=3 THEN 'duplicated_report' ELSE 'eligible' END AS outcome
      FROM plan JOIN rollup USING (payload_id) LEFT JOIN worst_found USING (payload_id))""", _FULL_GATE))
def gate_pipeline(m: Market):
    """Plan, validation, duplicates and drift, outcome and permission of every payload in one plan."""
    counts = m.payload_rows().groupBy("payload_id").agg(F.count(F.lit(1)).alias("n_rows"))
    plan = m.payloads().select("payload_id").join(counts, "payload_id", "left").fillna(0, subset=["n_rows"])
    issues, findings = issues_of(m), _findings(m)
    outcomes = Q.gate(plan, issues, findings).select("payload_id", "n_rows", "outcome")
    worst = findings.groupBy("payload_id").agg(F.max("severity").alias("worst_finding"))
    k = F.col("payload_id")
    reports = (
        Q.rollup_issues(m.payloads(), issues)
        .join(worst, "payload_id", "left")
        .fillna(0, subset=["worst_finding"])
        .withColumns({"override_block": k % 3 == 0, "acknowledged": k % 2 == 0})
    )
    return outcomes.join(reports.select("payload_id", Q.can_send().alias("can_send")), "payload_id")


@query("gate_outcomes", using(_ISSUES, """
    SELECT payload_id, n_rows, CASE WHEN n_rows=0 THEN 'skipped' WHEN worst=3 THEN 'validation_blocked'
      WHEN payload_id IN (SELECT payload_id FROM dup) THEN 'duplicated_report' ELSE 'eligible' END AS outcome
    FROM plan JOIN rollup USING (payload_id)""", _GATE))
def gate_outcomes(m: Market):
    counts = m.payload_rows().groupBy("payload_id").agg(F.count(F.lit(1)).alias("n_rows"))
    plan = m.payloads().select("payload_id").join(counts, "payload_id", "left").fillna(0, subset=["n_rows"])
    return Q.gate(plan, issues_of(m), _dup_findings(m)).select("payload_id", "n_rows", "outcome")


@query("send_permission", using(_ISSUES, """
    SELECT payload_id, (NOT (is_blocking OR wf=3) OR payload_id%3=0)
        AND (NOT (n_warnings>0 OR wf IN (1,2)) OR payload_id%2=0) AS can_send
    FROM (SELECT *, payload_id%4 AS wf FROM rollup)""", ISSUE_VIEWS))
def send_permission(m: Market):
    k = F.col("payload_id")
    reports = Q.rollup_issues(m.payloads(), issues_of(m)).withColumns(
        {"worst_finding": k % 4, "override_block": k % 3 == 0, "acknowledged": k % 2 == 0}
    )
    return reports.select("payload_id", Q.can_send().alias("can_send"))


# ---- batches -----------------------------------------------------------------

BATCH_VIEWS = {
    "items": """SELECT *, CASE WHEN queue_position>0 THEN queue_position
        ELSE row_number() OVER (PARTITION BY batch_id ORDER BY capture_id) END AS position FROM captures""",
    "claims": """SELECT r.*, i.batch_id, i.id_terminal, i.tab, i.added_at, i.position,
        row_number() OVER w AS claim, first_value(r.capture_id) OVER w AS winner_id, first_value(i.position) OVER w AS winner_position
        FROM capture_rows r JOIN items i USING (capture_id) WHERE id_commodity IS NOT NULL
        WINDOW w AS (PARTITION BY i.batch_id, coalesce(i.id_terminal,-1), r.id_commodity, i.tab
                     ORDER BY i.added_at DESC, i.position DESC, r.capture_id, r.row_index)""",
    "dropped": """SELECT *, winner_id<>capture_id AS other, CASE WHEN tab='UNKNOWN' THEN '(unknown)' ELSE tab END AS side
        FROM claims WHERE claim>1""",
    "planned": """SELECT i.*, count(r.capture_id) FILTER (WHERE r.id_commodity IS NULL OR c.claim=1) AS n_rows,
        count(c.claim) FILTER (WHERE c.claim=1) AS n_sent, count(c.claim) FILTER (WHERE c.claim>1) AS n_dropped
        FROM items i LEFT JOIN capture_rows r ON i.capture_id=r.capture_id
        LEFT JOIN claims c ON c.capture_id=r.capture_id AND c.row_index=r.row_index GROUP BY ALL""",
}
_BATCH = "captures capture_rows"


def batch_plan(m: Market) -> tuple[DataFrame, DataFrame]:
    items = B.queue_position(m.captures(), "batch_id", "capture_id")
    return items, B.plan_batch(items, m.capture_rows())


@query("queue_positions", using(_BATCH, "SELECT capture_id, batch_id, position FROM items", BATCH_VIEWS))
def queue_positions(m: Market):
    return B.queue_position(m.captures(), "batch_id", "capture_id").select("capture_id", "batch_id", "position")


@query("batch_plan", using(_BATCH, """
    SELECT capture_id, row_index, id_commodity, claim=1 AS is_kept FROM claims
    UNION ALL SELECT capture_id, row_index, NULL, true FROM capture_rows WHERE id_commodity IS NULL""", BATCH_VIEWS))
def batch_plan_rows(m: Market):
    return batch_plan(m)[1].select("capture_id", "row_index", "id_commodity", "is_kept")


@query("dropped_rows", using(_BATCH, """
    SELECT capture_id, row_index, id_commodity, tab, position, CASE WHEN other THEN winner_id END AS assigned_to,
      CASE WHEN other THEN winner_position ELSE 0 END AS assigned_position,
      CASE WHEN other THEN 'claimed by #'||winner_position||' on '||side ELSE 'claimed earlier on '||side END AS reason
    FROM dropped""", BATCH_VIEWS))
def dropped_rows(m: Market):
    return B.dropped_rows(batch_plan(m)[1]).drop("batch_id", "id_terminal")


@query("batch_preview", using(_BATCH, """
    SELECT batch_id, capture_id, row_index, id_commodity, tab, '#'||position AS found_on, '#'||position AS sent_on,
           'Kept' AS reason, true AS is_kept FROM claims WHERE claim=1
    UNION ALL
    SELECT batch_id, capture_id, row_index, id_commodity, tab, '#'||position,
      CASE WHEN other AND winner_position>0 THEN '#'||winner_position ELSE '(skipped)' END,
      CASE WHEN other THEN 'claimed by #'||winner_position||' on '||side ELSE 'claimed earlier on '||side END, false
    FROM dropped""", BATCH_VIEWS))
def batch_preview(m: Market):
    return B.preview(batch_plan(m)[1])


@query("planned_submissions", using(_BATCH, "SELECT capture_id, position, n_rows, n_sent, n_dropped FROM planned", BATCH_VIEWS))
def planned_submissions(m: Market):
    return B.planned_submissions(*batch_plan(m)).select("capture_id", "position", "n_rows", "n_sent", "n_dropped")


@query("batch_summary", using(_BATCH, """
    SELECT batch_id, count(*) AS submissions, sum(n_sent) AS rows_sent, sum(n_dropped) AS rows_dropped,
      coalesce(bool_or(draft_is_production<>true),false) AS mixed_mode,
      bool_or(branch='LIVE') AND bool_or(branch='PTU') AS mixed_branch, greatest(count(*)-1,0)*1500 AS throttle_ms
    FROM planned GROUP BY 1""", BATCH_VIEWS))
def batch_summary(m: Market):
    return B.batch_summary(B.planned_submissions(*batch_plan(m)), True, 1500)


@query("game_versions", using("captures", """
    SELECT capture_id, branch, coalesce(nullif(trim(draft_version),''), CASE branch WHEN 'LIVE' THEN '1998-08-02' END) AS game_version
    FROM captures""".replace("'1998-08-02'", "(SELECT strftime(max(o_orderdate),'%Y-%m-%d') FROM orders)")))
def game_versions(m: Market):
    """The live version is the latest order day; the test branch has only blanks."""
    return versioned_captures(m).select("capture_id", "branch", "game_version")


def versioned_captures(m: Market) -> DataFrame:
    newest = m.table("orders").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("v"))
    branches = F.explode(F.array(F.struct(F.lit("LIVE").alias("branch"), F.col("v").alias("version")),
                                 F.struct(F.lit("PTU").alias("branch"), F.lit(" ").alias("version"))))
    versions = newest.select(branches.alias("b")).select("b.*")
    return B.resolve_version(m.captures(), versions)


def _lines_sql(where: str) -> str:
    pick = lambda c, side: f"CASE WHEN tab {'<>' if side == 'buy' else '='} 'SELL' THEN {c} END AS {{}}_{side}"
    parts = []
    for side in ("buy", "sell"):
        parts += [pick("price", side).format("price"), pick("scu", side).format("scu"),
                  pick("nullif(status,0)", side).format("status")]
    return f"SELECT capture_id, row_index, id_commodity, {', '.join(parts)} FROM capture_rows JOIN captures USING (capture_id) WHERE id_commodity IS NOT NULL {where}"


@query("payload_lines_draft", using(_BATCH, _lines_sql("")))
def payload_lines_draft(m: Market):
    return B.payload_lines(m.captures(), m.capture_rows(), "draft")


@query("payload_lines_batch", using(_BATCH, _lines_sql("AND tab<>'UNKNOWN'")))
def payload_lines_batch(m: Market):
    return B.payload_lines(m.captures(), m.capture_rows(), "batch")


@query("built_payloads", using(_BATCH, """
    SELECT c.capture_id, 0 AS part, coalesce(any_value(c.id_terminal),0) AS id_terminal,
      coalesce(CAST(any_value(draft_is_production) AS INT),0) AS is_production, nullif(trim(any_value(container_sizes)),'') AS container_sizes,
      count(r.id_commodity) AS n_prices, CAST(any_value(c.id_terminal) IS NULL AS INT)+CAST(count(r.id_commodity)=0 AS INT) AS n_warnings
    FROM captures c LEFT JOIN capture_rows r ON c.capture_id=r.capture_id WHERE tab<>'UNKNOWN' GROUP BY 1"""))
def built_payloads(m: Market):
    built = B.build_payloads(m.captures(), m.capture_rows(), "batch")
    return built.select(
        "capture_id", "part", "id_terminal", "is_production", "container_sizes",
        F.size("prices").alias("n_prices"), F.size("_meta.warnings").alias("n_warnings"),
    )


@query("rejected_captures", using("captures", "SELECT capture_id, tab FROM captures WHERE tab='UNKNOWN'"))
def rejected_captures(m: Market):
    return B.rejected_captures(m.captures()).select("capture_id", "tab")


_WIRE_ROW = """'{"id_commodity":'||id_commodity
   ||CASE WHEN tab='BUY' THEN coalesce(',"price_buy":'||CAST(price AS DECIMAL(18,2)),'')||coalesce(',"scu_buy":'||scu,'')||coalesce(',"status_buy":'||nullif(status,0),'')
          ELSE coalesce(',"price_sell":'||CAST(price AS DECIMAL(18,2)),'')||coalesce(',"scu_sell":'||scu,'')||coalesce(',"status_sell":'||nullif(status,0),'') END||'}'"""


@query("wire_payloads", using(_BATCH, f"""
    SELECT c.capture_id, 0 AS part, '{{"id_terminal":'||coalesce(any_value(c.id_terminal),0)||',"type":"commodity","is_production":'
      ||coalesce(CAST(any_value(draft_is_production) AS INT),0)
      ||coalesce(',"container_sizes":"'||nullif(trim(any_value(container_sizes)),'')||'"','')
      ||',"prices":['||coalesce(string_agg({_WIRE_ROW}, ',' ORDER BY row_index) FILTER (WHERE id_commodity IS NOT NULL),'')||']'
      ||coalesce(',"game_version":"'||coalesce(nullif(trim(any_value(draft_version)),''), CASE any_value(branch) WHEN 'LIVE' THEN (SELECT strftime(max(o_orderdate),'%Y-%m-%d') FROM orders) END)||'"','')
      ||CASE WHEN c.capture_id%7=0 THEN ',"details":"seen twice"' ELSE '' END||'}}' AS body
    FROM captures c LEFT JOIN capture_rows r ON c.capture_id=r.capture_id WHERE tab<>'UNKNOWN' GROUP BY 1"""))
def wire_payloads(m: Market):
    """JSON bodies with version and details; prices are whole cents."""
    return B.to_wire_json(_full_payloads(m))


def _full_payloads(m: Market) -> DataFrame:
    rows = m.capture_rows().withColumn("price", F.col("price").cast("decimal(18,2)"))
    k = F.col("capture_id")
    details = F.when(k % 7 == 0, F.lit(" seen twice ")).when(k % 7 == 1, F.lit(" "))
    return B.build_payloads(versioned_captures(m).withColumn("draft_details", details), rows, "batch")


@query("wire_files", using(_BATCH, """
    SELECT coalesce(id_terminal,0) AS id_terminal, count(*) AS n_payloads, sum((SELECT count(*) FROM capture_rows r
        WHERE r.capture_id=c.capture_id AND id_commodity IS NOT NULL)) AS n_prices, count(*) FILTER (WHERE capture_id%7=0) AS n_details
    FROM captures c WHERE tab<>'UNKNOWN' GROUP BY 1"""))
def wire_files(m: Market):
    """Bodies written as text files and read back as the service would."""
    path = shared_dir(m.spark, "wire")
    B.write_wire(_full_payloads(m), path)
    sent = m.spark.read.schema("id_terminal bigint, prices array<struct<id_commodity: bigint>>, details string").json(path)
    return sent.groupBy("id_terminal").agg(
        F.count(F.lit(1)).alias("n_payloads"), F.sum(F.size("prices").cast("long")).alias("n_prices"), F.count("details").alias("n_details")
    )


@query("payload_meta", using(_BATCH, """
    SELECT c.capture_id, coalesce(any_value(terminal_match_score),0) AS terminal_match_score, lower(any_value(tab)) AS tab_detected,
      array_to_string(list(CAST(round_even(match_score,0) AS INT) ORDER BY row_index) FILTER (WHERE id_commodity IS NOT NULL), ',') AS scores,
      CASE WHEN any_value(tab)='UNKNOWN' THEN 'tab_unknown' ELSE '' END AS needs_review
    FROM captures c LEFT JOIN capture_rows r ON c.capture_id=r.capture_id GROUP BY 1"""))
def payload_meta(m: Market):
    """What drafts keep for review beside the wire fields."""
    built = B.build_payloads(m.captures(), m.capture_rows(), "draft")
    scores = F.col("_meta.commodity_match_scores")
    return built.select(
        "capture_id", "_meta.terminal_match_score", "_meta.tab_detected",
        F.when(F.size(scores) > 0, F.array_join(F.transform(scores, lambda x: x.cast("string")), ",")).alias("scores"),
        F.array_join("_meta.needs_review", ",").alias("needs_review"),
    )


# The planned rows as they would be sent: one side filled by the tab.
_PLANNED_GATE = BATCH_VIEWS | _KEYED | {
    "pay": "SELECT capture_id AS payload_id, coalesce(id_terminal,0) AS id_terminal, n_rows, tab, added_at AS sent_at FROM planned WHERE tab<>'UNKNOWN'",
    "lines": """SELECT c.capture_id AS payload_id, c.row_index, c.id_commodity, i.id_terminal, i.added_at AS sent_at,
        CASE WHEN i.tab='BUY' THEN price END AS price_buy, CASE WHEN i.tab='SELL' THEN price END AS price_sell,
        scu, nullif(status,0) AS st, price FROM claims c JOIN captures i USING (capture_id) WHERE claim=1 AND i.tab<>'UNKNOWN'""",
    "bad": """SELECT payload_id FROM pay WHERE id_terminal<=0 OR id_terminal NOT IN (SELECT id FROM terminals) OR payload_id NOT IN (SELECT payload_id FROM lines)
        UNION SELECT payload_id FROM lines WHERE id_commodity<=0 OR id_commodity NOT IN (SELECT id FROM commodities) OR price<0 OR scu<0""",
    "moved": """SELECT payload_id, max(CASE WHEN l IS NULL OR v.id_terminal IS NULL OR r IS NULL OR r<=0 THEN 0 WHEN abs(l-r)/r<0.01 AND fresh THEN 3
          WHEN abs(l-r)/r>0.3 THEN 3 ELSE 0 END) AS wf FROM (
        SELECT lines.*, unnest([lines.price_buy, lines.price_sell]) AS l, unnest([p.price_buy, p.price_sell]) AS r, p.id_terminal AS live_terminal,
          coalesce(NOW_-p.date_modified<300,false) AS fresh FROM lines LEFT JOIN prices_all p ON p.id_terminal=lines.id_terminal AND p.id_commodity=lines.id_commodity) v
        GROUP BY 1""".replace("NOW_", str(NOW)),
    "again": """SELECT DISTINCT l.payload_id FROM lines l JOIN submitted_ids s ON s.ok AND s.id_terminal=l.id_terminal AND s.id_commodity=l.id_commodity
        AND s.sent_at BETWEEN l.sent_at-300 AND l.sent_at WHERE l.id_terminal>0""",
}


@query("gated_batch", using("captures capture_rows terminals commodities prices_all submitted_ids", """
    SELECT payload_id, n_rows, CASE WHEN n_rows=0 THEN 'skipped' WHEN payload_id IN (SELECT payload_id FROM bad) THEN 'validation_blocked'
      WHEN payload_id IN (SELECT payload_id FROM again) OR coalesce(wf,0)=3 THEN 'duplicated_report' ELSE 'eligible' END AS outcome
    FROM pay LEFT JOIN moved USING (payload_id)""", _PLANNED_GATE))
def gated_batch(m: Market):
    """From plan to permission: kept rows become payloads, which the gate judges against rules, log and live prices.

    Captures of unknown side are refused before (``rejected_captures``).
    """
    # read by every check; once written, what was shuffled to plan and to judge is dropped step by step
    items = B.queue_position(m.captures(), "batch_id", "capture_id")
    items = settle(items.select("capture_id", "batch_id", "id_terminal", "tab", "added_at", "position"), "batch-items")
    plan = settle(B.plan_batch(items, m.capture_rows()).select(*m.capture_rows().columns, "is_kept"), "batch-plan")
    planned = B.planned_submissions(items, plan).filter("tab <> 'UNKNOWN'")
    kept = B.kept_rows(plan).select(*m.capture_rows().columns)
    lines = B.payload_lines(items, kept, "batch").withColumnRenamed("capture_id", "payload_id")
    lines = lines.withColumn("is_missing", F.lit(None).cast("int"))
    heads = planned.select(
        F.col("capture_id").alias("payload_id"), F.coalesce("id_terminal", F.lit(0)).alias("id_terminal"), F.lit("commodity").alias("type"),
        F.lit(0).alias("is_production"), F.col("added_at").alias("sent_at"), "n_rows",
    )
    heads = settle(heads, "batch-heads")
    asked = settle(lines.join(heads.select("payload_id", "id_terminal", "sent_at"), "payload_id"), "batch-lines")
    lines = asked.drop("id_terminal", "sent_at")
    worst = lambda found, step: settle(found.groupBy("payload_id").agg(F.max("severity").alias("severity")), step)
    issues = worst(Q.validate_payloads(heads.drop("n_rows"), lines, m.terminals(), m.commodities()), "batch-issues")
    again = worst(Q.dup_guard(asked, m.submissions()).select("payload_id", F.lit(Q.BLOCK).alias("severity")), "batch-again")
    drift = worst(Q.drift_findings(asked.filter("id_terminal > 0"), _live_prices(m), NOW).select("payload_id", "severity"), "batch-drift")
    return Q.gate(heads.select("payload_id", "n_rows"), issues, again.unionByName(drift)).select("payload_id", "n_rows", "outcome")


# ---- submission log ----------------------------------------------------------


@query("retryable_failures", using("submissions", """
    SELECT http_status, lower(trim(api_status)) AS api_status, count(*) AS n,
      count(*) FILTER (WHERE attempt<3 AND (lower(trim(api_status))='too_many_reports' OR http_status=429
        OR (http_status>=500 AND http_status<600))) AS n_retryable
    FROM submissions WHERE NOT ok GROUP BY 1,2"""))
def retryable_failures(m: Market):
    failed = m.submissions().filter("not ok")
    return failed.groupBy("http_status", F.lower(F.trim("api_status")).alias("api_status")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(A.is_retryable()).alias("n_retryable")
    )


@query("rejection_hints", using("submissions", f"""
    SELECT id, api_status, CASE lower(api_status) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.REJECTION_HINTS.items())}
      END AS hint FROM submissions WHERE NOT ok"""))
def rejection_hints(m: Market):
    return Q.explain_rejections(m.submissions().filter("not ok")).select("id", "api_status", "hint")


@query("recent_submissions", using("submissions", f"""
    SELECT id, id_terminal, sent_at FROM submissions WHERE sent_at>={LOG_NOW}-86400 ORDER BY sent_at DESC"""))
def recent_submissions(m: Market):
    return A.recent_submissions(m.submissions(), LOG_NOW, 86400).select("id", "id_terminal", "sent_at")


@query("latest_submissions", using("submissions", """
    SELECT id, id_terminal, sent_at, ok FROM submissions ORDER BY sent_at DESC, id DESC LIMIT 200"""))
def latest_submissions(m: Market):
    return A.latest_submissions(m.submissions()).select("id", "id_terminal", "sent_at", "ok")


SOURCE_VIEWS = {
    "source_names": """SELECT source_image AS source FROM submissions WHERE ok AND is_production
        UNION ALL SELECT unnest(CAST(source_images AS VARCHAR[])) FROM (
          SELECT from_json(CASE WHEN json_valid(source_images) THEN source_images END, '["VARCHAR"]') AS source_images
          FROM submissions WHERE ok AND is_production)""",
    "accepted": "SELECT upper(source) AS source_key, min(source) AS source FROM source_names WHERE trim(source)<>'' GROUP BY 1",
}


@query("submitted_sources", using("submissions", "SELECT * FROM accepted", SOURCE_VIEWS))
def submitted_sources(m: Market):
    return A.submitted_sources(m.submissions())


@query("inbox_funnel", """
    SELECT user_id, count(*) FILTER (WHERE event_type='purchase') AS validated,
      count(*) FILTER (WHERE event_type='error') AS failed,
      count(*) FILTER (WHERE event_type NOT IN ('purchase','error','view') AND value>100) AS pending,
      count(*) FILTER (WHERE event_type='purchase')>0
        AND count(*) FILTER (WHERE event_type NOT IN ('purchase','error','view') AND value>100)=0 AS ready_to_send
    FROM events GROUP BY 1""")
def inbox_funnel(m: Market):
    kind = F.col("event_type")
    items = m.table("events").select(
        "user_id",
        F.when(kind == "purchase", "VALIDATED").when(kind == "error", "FAILED")
        .when((kind == "view") | (F.col("value") <= 100), "SENT").otherwise("READY").alias("inbox_status"),
    )
    return A.funnel(items, ["user_id"])


@query("pending_files", using("submissions", """
    SELECT name, modified FROM (SELECT 'SHOT-'||(event_id%900)||CASE event_id%5 WHEN 0 THEN '.txt' WHEN 1 THEN '.JPG' ELSE '.png' END AS name,
        max(CAST(floor(epoch(ts)) AS BIGINT)) AS modified FROM events GROUP BY 1)
    WHERE lower(name) SIMILAR TO '.*\\.(png|jpg|jpeg|bmp)' AND modified>=1706000000
      AND upper(name) NOT IN (SELECT source_key FROM accepted)""", SOURCE_VIEWS))
def pending_files(m: Market):
    from tradeq.functions.economics import epoch_seconds
    from tradeq.sources.files import pending_files as pending

    i = F.col("event_id")
    suffix = F.when(i % 5 == 0, ".txt").when(i % 5 == 1, ".JPG").otherwise(".png")
    listing = m.table("events").groupBy(F.concat(F.lit("SHOT-"), (i % 900).cast("string"), suffix).alias("name")).agg(
        F.max(epoch_seconds(F.col("ts"))).alias("modified")
    )
    return pending(listing, A.submitted_sources(m.submissions()), since=1706000000).select("name", "modified")
