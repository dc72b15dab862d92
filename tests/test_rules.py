"""Edge rows of the rules, gates, plans and scores."""

import math

import pytest
from pyspark.sql import functions as F

from tradeq.operators import batch as B
from tradeq.operators import catalog as C
from tradeq.operators import metrics as M
from tradeq.operators import ordered as O
from tradeq.operators import quality as Q
from tradeq.operators import routes as R
from tradeq.operators import staleness as S

NOW = 1_700_000_000
PRICES = "id_terminal long, id_commodity long, price_buy double, price_sell double, scu_buy double, scu_sell_stock double, status_buy int, status_sell int, date_modified long"


def test_stale_targets(rows):
    prices = rows(
        PRICES,
        (1, 1, 5.0, 6.0, 9.0, -3.0, 0, 7, NOW - 10 * 86400),
        (1, 2, 5.0, None, 0.0, None, 3, None, 0),
        (1, 3, 5.0, 0.0, 0.0, 0.0, 7, 0, NOW + 3600),
    )
    got = {(r.id_commodity, r.side): r for r in S.stale_targets(prices, NOW).collect()}
    assert set(got) == {(1, "BUY"), (1, "SELL"), (3, "BUY")}
    assert got[1, "BUY"].days_stale == 10 and got[1, "BUY"].priority == pytest.approx(10 * 2 * 0.7)
    assert got[1, "SELL"].priority == pytest.approx(10 * 1.7)
    assert got[3, "BUY"].days_stale == -1 and got[3, "BUY"].priority == pytest.approx(1.7)


def test_reachability(rows):
    targets = rows("id_terminal long, x int", (1, 0), (2, 0), (3, 0))
    catalog = rows("id long, name string, star_system_name string, is_available_live int", (1, "a", "s", 1), (2, "b", "s", 0))
    known = {r.id_terminal: r.is_reachable for r in S.enrich_targets(targets, catalog).collect()}
    assert known == {1: True, 2: False, 3: False}
    empty = {r.is_reachable for r in S.enrich_targets(targets, catalog.filter("id < 0")).collect()}
    assert empty == {True}


def test_overlay_counts_tie_out(rows):
    t = "id_terminal long, id_commodity long, side string, is_reachable boolean, days_stale int, priority double"
    targets = rows(t, (1, 1, "BUY", True, 40, 1.0), (1, 1, "SELL", True, 40, 1.0), (1, 2, "BUY", True, 5, 1.0), (1, 3, "BUY", False, 99, 1.0))
    recent = rows("id_terminal long, id_commodity long", (1, 1))
    r = S.terminal_staleness(targets, recent).first()
    assert (r.max_days, r.stale_count, r.excluded_count, r.raw_count) == (5, 0, 2, 2)


def test_ambiguous_names(rows):
    t = rows(
        "id long, name string, displayname string, star_system_name string",
        (1, "x", "Gate", "A"), (2, "x", "GATE", "b"), (3, "Solo", " ", "A"), (4, "solo", None, "a"), (5, "", "", "A"),
    )
    assert [(r.name_key, r.n_systems) for r in C.ambiguous_names(t).collect()] == [("GATE", 2)]


@pytest.mark.parametrize(
    "local, remote, age, reason",
    [
        (100.5, 100.0, 10, "identical_recent"), (100.5, 100.0, 301, "matches_live"), (103.0, 100.0, 10, "within_tolerance"),
        (105.0, 100.0, 10, "within_tolerance"), (130.0, 100.0, 10, "drift_warning"), (131.0, 100.0, 10, "drift_block"),
        (5.0, 0.0, 10, "first_known"), (5.0, None, 10, "first_known"), (5.0, -1.0, 10, None),
    ],
)
def test_drift(rows, local, remote, age, reason):
    mine = rows("payload_id long, row_index int, id_terminal long, id_commodity long, price_buy double, price_sell double", (1, 0, 1, 1, local, None))
    live = rows("live_id int, id_terminal long, id_commodity long, price_buy double, price_sell double, date_modified long", (1, 1, 1, remote, None, NOW - age))
    got = [r.reason for r in Q.drift_findings(mine, live, NOW).collect()]
    assert got == ([reason] if reason else [])


def test_drift_without_live_row(rows):
    mine = rows("payload_id long, row_index int, id_terminal long, id_commodity long, price_buy double, price_sell double", (1, 0, 1, 1, 5.0, 6.0))
    live = rows("live_id int, id_terminal long, id_commodity long, price_buy double, price_sell double, date_modified long", (1, 9, 9, 1.0, 1.0, NOW))
    assert [(r.reason, r.severity) for r in Q.drift_findings(mine, live, NOW).collect()] == [("no_live_row", Q.INFO)]


def test_duplicate_window(rows):
    log = rows("id_terminal long, ok boolean, submitted_commodity_ids string, sent_at long", (1, True, "[7]", 1000), (2, False, "[7]", 1000))
    asked = rows("id_terminal long, id_commodity long, sent_at long", (1, 7, 1300), (1, 7, 1301), (1, 7, 1000), (1, 7, 999), (2, 7, 1001), (1, 8, 1001))
    assert sorted(r.sent_at for r in Q.dup_guard(asked, log).collect()) == [1000, 1300]


ROW = "payload_id long, row_index int, id_commodity long, price_buy double, price_sell double, scu_buy int, scu_sell int, status_buy int, status_sell int, is_missing int"


def test_row_rules(rows):
    payloads = rows("payload_id long, id_terminal long, type string, is_production int", (1, 5, "COMMODITY", 1), (2, 0, "x", 3), (3, 6, None, 0))
    lines = rows(
        ROW,
        (1, 0, 0, -1.0, None, None, None, None, None, None),
        (1, 1, 10, 5.0, None, 0, None, 8, None, None),
        (1, 2, 10, 50_000_001.0, None, 100_001, None, 7, None, None),
        (1, 3, 11, 0.0, None, -1, None, 0, None, None),
        (1, 4, 12, None, None, None, None, None, None, None),
        (1, 5, 13, None, None, None, None, None, None, 1),
        (1, 6, 14, 5e7, 1.0, 100_000, None, 1, None, None),
        (1, 7, 99, 1.0, None, 1, None, 1, None, None),
    )
    goods = rows("id long", *[(i,) for i in range(10, 15)])
    got = sorted((r.payload_id, -1 if r.row_index is None else r.row_index, r.code) for r in Q.validate_payloads(payloads, lines, rows("id long", (5,)), goods).collect())
    assert got == sorted([
        (1, 0, "commodity_missing"), (1, 1, "status_out_of_range"), (1, 2, "duplicate_row"), (1, 2, "price_huge"), (1, 2, "scu_huge"),
        (1, 3, "price_zero"), (1, 3, "scu_negative"), (1, 3, "status_out_of_range"), (1, 4, "row_empty"), (1, 6, "buy_sell_exclusive"),
        (1, 7, "commodity_unknown"), (2, -1, "terminal_missing"), (2, -1, "type_invalid"), (2, -1, "is_production_invalid"), (2, -1, "no_rows"),
        (3, -1, "terminal_unknown"), (3, -1, "type_invalid"), (3, -1, "no_rows"),
    ])


def test_batch_plan_lineage(rows):
    items = rows(
        "capture_id long, batch_id string, id_terminal long, tab string, added_at long, position long",
        (1, "b", 5, "BUY", 10, 1), (2, "b", 5, "BUY", 20, 2), (3, "b", 5, "SELL", 30, 3), (4, "b", None, "BUY", 20, 4), (5, "b", 5, "BUY", 20, 5),
    )
    lines = rows(
        "capture_id long, row_index int, id_commodity long",
        (1, 0, 7), (2, 0, 7), (3, 0, 7), (4, 0, 7), (5, 0, 7), (5, 1, 7), (5, 2, None), (1, 1, None),
    )
    plan = B.plan_batch(items, lines)
    kept = sorted((r.capture_id, r.row_index) for r in B.kept_rows(plan).collect())
    assert kept == [(1, 1), (3, 0), (4, 0), (5, 0), (5, 2)]
    dropped = {(r.capture_id, r.row_index): (r.assigned_to, r.assigned_position) for r in B.dropped_rows(plan).collect()}
    assert dropped == {(1, 0): (5, 5), (2, 0): (5, 5), (5, 1): (None, 0)}
    assert len(kept) + len(dropped) == lines.count()


def test_payload_parts_keep_all_rows(rows):
    captures = rows(
        "capture_id long, id_terminal long, tab string, source_image string, container_sizes string, draft_is_production boolean",
        (1, 5, "SELL", "a", " ", None), (2, None, "UNKNOWN", "b", "1,2", True),
    )
    lines = rows("capture_id long, row_index int, id_commodity long, price double, scu int, status int", *[(1, i, i, 1.0, 2, 0) for i in range(1201)])
    built = B.build_payloads(captures, lines, "draft").collect()
    assert sorted((r.capture_id, r.part, len(r.prices)) for r in built) == [(1, 0, 500), (1, 1, 500), (1, 2, 201), (2, 0, 0)]
    assert [r.capture_id for r in B.rejected_captures(captures).collect()] == [2]
    body = B.to_wire_json(B.build_payloads(captures, lines.limit(1), "batch")).first()["body"]
    assert body == '{"id_terminal":5,"type":"commodity","is_production":0,"prices":[{"id_commodity":0,"price_sell":1.0,"scu_sell":2}]}'


LATEST = "id_terminal long, id_commodity long, side string, price double, stock double, status int"


def test_hot_commodity_is_split_without_loss(rows):
    data = [(i, 1, "BUY", 1.0 + i, 5.0, 1) for i in range(40)] + [(100 + i, 1, "SELL", 30.0 + i, 5.0, 1) for i in range(15)] + [(3, 1, "SELL", 50.0, 5.0, 1)]
    latest = rows(LATEST, *data)
    plain = R.build_routes(latest)
    split = R.build_routes(latest, rows_per_salt=7)
    key = lambda df: sorted((r.id_origin, r.id_destination) for r in df.collect())
    assert key(plain) == key(split) and len(key(plain)) == 40 * 16 - 1
    best = {r.id_origin: r.id_destination for r in R.best_destinations(latest).collect()}
    assert best[0] == 3 and best[3] == 114


def test_caps(rows):
    r = rows("scu_origin double, price_origin double, price_destination double", (5.9, 10.0, 12.0), (0.5, 10.0, 12.0), (5.0, 0.0, 1.0), (5.0, 400.0, 1.0))
    got = [(x.scu, x.profit) for x in R.effective(r, F.lit(30), F.lit(2.5)).collect()]
    assert got == [(2, 4.0), (0, 0.0), (2, 2.0), (0, 0.0)]
    assert [x.scu for x in R.effective(r, F.lit(None).cast("int")).collect()] == [5, 0, 5, 5]


def test_asof_over_buckets(rows):
    prices = rows("k long, ts long, price double", (1, 10, 1.0), (1, 100, 2.0), (1, 100, 3.0), (2, 50, 9.0))
    events = rows("k long, ts long, id int", (1, 9, 0), (1, 10, 1), (1, 99, 2), (1, 100, 3), (1, 10_000, 4), (3, 5, 5), (2, 49, 6))
    got = {r.id: r.last_price for r in Q.asof_last_price(events, prices, ["k"], bucket_seconds=7).collect()}
    assert got == {0: None, 1: 1.0, 2: 1.0, 3: 3.0, 4: 3.0, 5: None, 6: None}


def test_running_count_over_stretches(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = O.running_count(df, ["k"], "id", F.col("id") % 2 == 0, "n", width=37)
    want = {}
    for r in sorted(got.collect(), key=lambda r: r.id):
        want[r.k] = want.get(r.k, 0) + (r.id % 2 == 0)
        assert r.n == want[r.k]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_error_rates(rows):
    pairs = rows(
        "reference string, hypothesis string",
        ("the quick\r\nfox ", "The quick fox jumps"), ("", ""), ("", "abc"), ("a b", "b a c a b a"), (None, "x"), ("ab", "abcdefgh"),
    )
    for r in M.error_rates(pairs).collect():
        if r.reference is None:
            assert math.isnan(r.cer) and math.isnan(r.wer)
            continue
        ref, hyp = (s.replace("\r\n", "\n").replace("\r", "\n").strip() for s in (r.reference, r.hypothesis))
        words = ref.upper().split(), hyp.upper().split()
        assert r.cer == pytest.approx(_edits(ref, hyp) / len(ref) if ref else float(bool(hyp)))
        assert r.wer == pytest.approx(_edits(*words) / len(words[0]) if words[0] else float(bool(words[1])))


def test_short_names_join_themselves(rows):
    names = ["IRON", "GOLD", "STIMS", "TIN", "GO", "X"]
    left, right = rows("token string", *[(n,) for n in names]), rows("value string", *[(n,) for n in names])
    from tradeq.operators.similarity import similarity_join

    got = {(r["token"], r["value"]) for r in similarity_join(left, right).collect()}
    assert {(n, n) for n in names} <= got and ("IRON", "TIN") not in got


def test_large_ids_stay_recent(rows):
    from tradeq.operators.staleness import recent_pairs

    log = rows("id_terminal long, ok boolean, sent_at long, submitted_commodity_ids string", (1, True, 100, "[3000000000,5]"))
    assert {r["id_commodity"] for r in recent_pairs(log, 110).collect()} == {3000000000, 5}


def test_no_findings_without_terminal(rows):
    from tradeq.operators.quality import drift_findings, dup_guard

    mine = rows(
        "payload_id long, row_index int, id_terminal long, id_commodity long, price_buy double, price_sell double, sent_at long",
        (1, 0, 0, 7, 1.0, None, 200), (2, 0, 3, 7, 1.0, None, 200),
    )
    live = rows("live_id int, id_terminal long, id_commodity long, price_buy double, price_sell double, date_modified long", (1, 9, 9, 1.0, 1.0, 1))
    log = rows("id_terminal long, ok boolean, sent_at long, submitted_commodity_ids string", (0, True, 150, "[7]"), (3, True, 150, "[7]"))
    assert [r["payload_id"] for r in drift_findings(mine, live, 300).collect()] == [2]
    assert [r["payload_id"] for r in dup_guard(mine, log).collect()] == [2]


def test_lower_score_limit_is_exact(rows):
    from tradeq.functions import text as T
    from tradeq.operators.similarity import similarity_join
    from pyspark.sql import functions as F

    words = ["NORTH HUB", "NORTH HAB", "SOUTH GATE", "GATE SOUTH", "NORTE", "NORT HUB STATION", "MIC L1", "MIC", "HUB"]
    left, right = rows("token string", *[(n,) for n in words]), rows("value string", *[(n,) for n in words])
    for limit in (65, 70, 90):
        pairs = left.crossJoin(right).withColumn(
            "score", T.let(F.struct(T.text_forms(F.col("token")).alias("a"), T.text_forms(F.col("value")).alias("b")), lambda p: T.weighted_of(
                p["a"]["text"], p["b"]["text"], p["a"]["sorted"], p["b"]["sorted"], p["a"]["words"], p["b"]["words"], 1))
        ).filter(F.col("score") >= limit)
        got = {tuple(r) for r in similarity_join(left, right, limit).collect()}
        assert got == {(r["token"], r["value"], r["score"]) for r in pairs.collect()}
