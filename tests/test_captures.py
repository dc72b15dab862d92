"""What is settled on captures after reading, and the payloads built from them."""

import json

from pyspark.sql import functions as F

from tradeq.operators import batch as B
from tradeq.operators import captures as K
from tradeq.operators import quality as Q
from tradeq.operators import similarity as S

CAPTURE = "capture_id int, id_terminal long, terminal_match_score double, tab string, needs_review array<string>"


def test_measured_tab_wins_or_leaves_the_side_open(rows):
    captures = rows(
        CAPTURE,
        (1, 5, 95.0, "BUY", ["tab_assumed_buy", "scu_missing"]),
        (2, 5, 95.0, "BUY", ["tab_assumed_buy"]),
        (3, 5, 95.0, "UNKNOWN", ["tab_unknown"]),
        (4, 5, 95.0, "SELL", ["tab_detected_sell", "x"]),
        (5, 5, 95.0, "UNKNOWN", ["tab_unknown", "price_missing"]),
    )
    measured = rows("capture_id int, tab string", (1, "SELL"), (2, "UNKNOWN"), (5, "BUY"))
    got = {r.capture_id: (r.tab, list(r.needs_review)) for r in K.measured_tab(captures, measured).collect()}
    assert got == {
        1: ("SELL", ["scu_missing", "tab_detected_sell"]),
        2: ("UNKNOWN", ["tab_unknown"]),
        3: ("UNKNOWN", ["tab_unknown"]),
        4: ("UNKNOWN", ["x", "tab_unknown"]),
        5: ("BUY", ["price_missing", "tab_detected_buy"]),
    }


MATCH = "capture_id int, matched_id long, matched_field string, window string, score int"


def test_banner_before_header(rows):
    banner = rows(MATCH, (1, 10, "name", "A", 80), (2, 20, "name", "B", 92), (3, 30, "name", "C", 80), (5, 50, "name", "E", 70))
    header = rows(MATCH, (1, 11, "code", "a", 85), (2, 21, "code", "b", 100), (3, 31, "code", "c", 80), (4, 41, "code", "d", 66))
    preferred = K.preferred_terminal(banner, header)
    got = {r.capture_id: (r.matched_id, r.matched_field, r.score) for r in preferred.collect()}
    # a sure banner is not compared with the header at all; equal scores keep the banner
    assert got == {
        1: (11, "left_header:code", 85), 2: (20, "banner:name", 92), 3: (30, "banner:name", 80),
        4: (41, "left_header:code", 66), 5: (50, "banner:name", 70),
    }
    captures = rows(
        CAPTURE,
        (1, None, None, "BUY", ["terminal_not_detected", "k"]),
        (2, 7, 91.0, "BUY", ["k"]),
        (3, 7, 80.0, "BUY", ["terminal_match_low_confidence (80)"]),
        (4, 7, 60.0, "BUY", ["terminal_match_low_confidence (60)"]),
        (6, None, None, "BUY", ["terminal_not_detected"]),
    )
    merged = {r.capture_id: (r.id_terminal, r.terminal_match_score, r.terminal_matched_field, list(r.needs_review)) for r in K.merge_terminal(captures, preferred).collect()}
    assert merged == {
        1: (11, 85.0, "left_header:code", ["k", "terminal_match_low_confidence (85)"]),
        2: (20, 92.0, "banner:name", ["k"]),
        3: (7, 80.0, None, ["terminal_match_low_confidence (80)"]),
        4: (41, 66.0, "left_header:code", ["terminal_match_low_confidence (66)"]),
        6: (None, None, None, ["terminal_not_detected"]),
    }


ROWS = "capture_id int, row_index int, id_commodity long, match_score double, price double, scu int, status int"


def test_second_reading_only_where_there_are_holes(rows):
    captures = rows(CAPTURE, (1, None, None, "BUY", []), (2, 5, 95.0, "BUY", []), (3, 5, 95.0, "BUY", []), (4, None, None, "BUY", []))
    lines = rows(ROWS, (2, 0, 1, 99.0, 1.0, 1, 0), (2, 1, 2, 99.0, 1.0, 1, 0), (3, 0, 1, 99.0, 1.0, 1, 4), (4, 0, 1, 99.0, 1.0, 1, 0))
    got = {r.capture_id: r.reasons for r in K.retry_reasons(captures, lines).collect()}
    assert got == {1: ["terminal_not_detected"], 2: ["status_unknown_x2"], 4: ["terminal_not_detected", "status_unknown_x1"]}


def test_payload_has_all_fields_and_meta_stays_home(rows, tmp_path):
    captures = rows(
        "capture_id int, source_image string, id_terminal long, terminal_match_score double, tab string, draft_is_production boolean, container_sizes string, "
        "game_version string, draft_details string, terminal_name string, terminal_matched_field string, terminal_matched_from string, needs_review array<string>",
        (1, "a.jpg", 7, 88.0, "SELL", True, " 1,2 ", "4.7", " seen ", "Hub", "banner:name", "HUB", ["x"]),
        (2, "b.jpg", None, None, "UNKNOWN", None, None, None, " ", None, None, None, None),
    )
    lines = rows(ROWS, (1, 0, 3, 90.5, 2.0, 4, 0), (1, 1, None, 50.0, 1.0, 1, 1), (1, 2, 5, 100.0, 9.0, 2, 7), (2, 0, 3, 80.0, 2.0, 4, 2))
    batch = B.build_payloads(captures, lines, "batch")
    B.write_wire(batch, str(tmp_path / "wire"))
    (line,) = [x for f in (tmp_path / "wire").glob("part-*") for x in f.read_text().splitlines()]
    assert json.loads(line) == {
        "id_terminal": 7, "type": "commodity", "is_production": 1, "container_sizes": "1,2", "game_version": "4.7", "details": "seen",
        "prices": [{"id_commodity": 3, "price_sell": 2.0, "scu_sell": 4}, {"id_commodity": 5, "price_sell": 9.0, "scu_sell": 2, "status_sell": 7}],
    }
    meta = {r.capture_id: r._meta for r in B.build_payloads(captures, lines, "draft").collect()}
    assert meta[1].draft and meta[1].commodity_match_scores == [90, 100] and meta[1].terminal_matched_field == "banner:name" and meta[1].needs_review == ["x"]
    assert meta[2].needs_review == ["tab_unknown"] and meta[2].warnings == ["terminal_unreviewed", "tab_unknown"] and meta[2].terminal_match_score == 0.0
    assert not batch.first()._meta.draft


def test_typed_but_not_picked(rows):
    fields = ", ".join(f"{c} string" for c in S.SEARCH_FIELDS)
    terminals = rows(f"id long, {fields}", *[(i, n, n, None, f"C{i}", None, None, None, "P", "SYS") for i, n in enumerate(["NORTH HUB", "SOUTH HUB"])])
    captures = rows(CAPTURE + ", width int, height int, terminal_confirmed boolean, terminal_text string",
                    *[(i, t, None, "BUY", [], 16, 9, True, text) for i, (t, text) in enumerate([(None, "hub"), (None, " "), (None, "west"), (1, "hub"), (None, None)])])
    got = {r.capture_id: (r.typed, r.n_candidates) for r in K.unresolved_terminals(captures, terminals).collect()}
    assert got == {0: ("hub", 2), 2: ("west", 0)}
    lines = rows(ROWS, *[(i, 0, 1, 100.0, 1.0, 1, 1) for i in range(5)])
    issues = Q.review_issues(captures, lines, terminals.withColumn("outpost", F.lit(None)), rows("name_key string", ("NONE",)))
    codes = {(r.capture_id, r.code) for r in issues.collect() if r.code.startswith("terminal")}
    assert codes == {(0, "terminal_unresolved"), (1, "terminal_missing"), (2, "terminal_unresolved"), (4, "terminal_missing")}
