"""Operators against plain Python on small random tables."""

import random

from pyspark.sql import functions as F

from tradeq.functions import text as T
from tradeq.operators import extract as X
from tradeq.operators import similarity as S


def _word(rng, n):
    return "".join(rng.choice("ABCDE") for _ in range(n))


def _name(rng):
    return " ".join(_word(rng, rng.randint(1, 6)) for _ in range(rng.randint(1, 3)))


def _noise(rng, s):
    s = list(s)
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(s) + 1)
        s[i : i + rng.randint(0, 1)] = [rng.choice("ABCDE ")] if rng.random() < 0.7 else []
    return "".join(s).strip()


def test_candidates_miss_nothing(rows):
    rng = random.Random(5)
    values = sorted({_name(rng) for _ in range(40)})
    tokens = sorted({t for v in values for t in (_noise(rng, v), _noise(rng, v + " " + _word(rng, 4)), _name(rng)) if len(t) >= 3})
    t = S.forms(rows("token string", *[(x,) for x in tokens]), "token", "t")
    v = S.forms(rows("value string", *[(x,) for x in values]), "value", "v")
    scored = t.crossJoin(v).select(
        "token", "value", T.weighted(F.col("token"), F.col("value")).alias("w"), T.partial(F.col("token"), F.col("value")).alias("p"),
        T.token_set_of(F.col("t_set"), F.col("v_set")).alias("s"),
    ).collect()
    for limit in (70, 75, 90):
        found = {(r.token, r.value) for r in S.candidate_pairs(t, v, limit).collect()}
        need = {(r.token, r.value) for r in scored if max(r.w, r.p, r.s) >= limit}
        assert need <= found
        assert len(need) > 20


def _ratio(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    n = max(len(a), len(b))
    return round(100.0 * (n - row[-1]) / n) if n else 0


def test_scores_match_python(rows):
    rng = random.Random(6)
    pairs = [(_name(rng), _name(rng)) for _ in range(150)] + [(n, _noise(rng, n) or "A") for n in (_name(rng) for _ in range(150))]
    got = rows("a string, b string", *pairs).select("a", "b", T.weighted(F.col("a"), F.col("b")).alias("w"), T.partial(F.col("a"), F.col("b")).alias("p"))
    for r in got.collect():
        a, b = r.a, r.b
        wa, wb = a.split(), b.split()
        sa, sb = sorted(set(wa)), sorted(set(wb))
        shared = [w for w in sa if w in sb]
        fa, fb = (" ".join(shared + [w for w in s if w not in shared]) for s in (sa, sb))
        set_score = max(_ratio(" ".join(shared), fa), _ratio(" ".join(shared), fb), _ratio(fa, fb))
        sort_score = _ratio(" ".join(sorted(wa)), " ".join(sorted(wb)))
        weighted = max(_ratio(a, b), round(95 * sort_score / 100.0), round(95 * set_score / 100.0))
        assert r.w == weighted if weighted >= 70 else r.w <= weighted
        short, long = sorted((a, b), key=len)
        assert r.p == max(_ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


def _walk_status(lines):
    """The screen order rules, one line at a time."""
    direct, late, pending, order, locked = {}, {}, None, [], False
    for kind, commodity, status, marker in lines:
        if marker:
            pending, locked = None, True
        elif kind == "COMMODITY":
            if commodity in order:
                continue
            order.append(commodity)
            locked = False
            if pending is not None:
                late[commodity], pending = pending, None
        else:
            pending = status if status is not None else pending
            if not locked and pending is not None and order and order[-1] not in direct:
                direct[order[-1]], pending = pending, None
    return {c: direct.get(c, late.get(c, 0)) for c in order}


def test_status_carry(rows):
    rng = random.Random(7)
    data, want = [], {}
    for capture in range(200):
        lines = []
        for no in range(rng.randint(1, 14)):
            what = rng.random()
            if what < 0.35:
                lines.append(("COMMODITY", rng.randint(1, 4), None, False))
            elif what < 0.75:
                lines.append(("OTHER", None, rng.randint(1, 7), False))
            elif what < 0.9:
                lines.append(("OTHER", None, None, True))
            else:
                lines.append(("SCU", None, None, False))
            kind, c, s, mark = lines[-1]
            data.append((capture, no, kind, X.BAND_MARKER + "1 ---" if mark else "x", c, s))
        want.update({(capture, c): s for c, s in _walk_status(lines).items()})
    table = rows("capture_id long, line_no long, kind string, line string, id_commodity long, status int", *data)
    got = {(r.capture_id, r.id_commodity): r.status for r in X.commodity_status(table).collect()}
    assert got == want


def _layout(items):
    items = sorted(items, key=lambda r: (r[1], r[2], r[3]))
    heights = sorted(r[5] for r in items)
    h = max(8, heights[len(heights) // 2])
    grouped, current = [], []
    for r in items:
        if current and abs(r[1] - sum(c[1] for c in current) / len(current)) > 0.6 * h:
            grouped.append(current)
            current = []
        current.append(r)
    lines = []
    for row in [*grouped, current]:
        pieces = []
        for r in sorted(row, key=lambda r: (r[2], r[3], r[1])):
            if pieces and r[3] - pieces[-1][1] <= 1.2 * h:
                pieces[-1] = (pieces[-1][0] + " " + r[0], r[4])
            else:
                pieces.append((r[0], r[4]))
        lines += [p[0] for p in pieces]
    return lines


def test_region_layout(rows):
    rng = random.Random(8)
    data, want = [], {}
    for capture in range(60):
        items = []
        for i in range(rng.randint(1, 25)):
            left = rng.randint(0, 400)
            items.append((f"t{i}", float(rng.randint(0, 120)), left + rng.random() * 40, left, left + rng.randint(10, 90), rng.randint(4, 22)))
        data += [(capture, *r) for r in items]
        want[capture] = _layout(items)
    table = rows("capture_id long, text string, center_y double, center_x double, left int, right int, height int", *data)
    got = {}
    for r in sorted(X.regions_to_lines(table).collect(), key=lambda r: (r.capture_id, r.line_no)):
        got.setdefault(r.capture_id, []).append(r.text)
    assert got == want


def test_terminal_over_lines(rows):
    terminals = rows(
        "id long, displayname string, name string, nickname string, space_station_name string, outpost_name string, city_name string",
        (1, "Everus Harbor", "Admin", "EVH", None, None, None), (2, "Baijini Point", "Shop", None, "Baijini Point (S)", None, None),
    )
    lines = rows(
        "capture_id long, line_no long, text string",
        (1, 0, "YOUR INVENTORIES"), (1, 1, "EVERUS"), (1, 2, "HARB0R"), (2, 0, "BAIJINI POINT"), (3, 0, "FPS."), (3, 1, "tE"),
    )
    got = {r.capture_id: (r.matched_id, r.window, r.score) for r in S.resolve_across_lines(lines, terminals).collect()}
    # the single line already scores 100 by partial, and the best score wins
    assert got == {1: (1, "EVERUS", 100), 2: (2, "BAIJINI POINT", 100)}


def test_edit_distance_of_sequences():
    from tradeq.operators.metrics import edit_distance

    rng = random.Random(9)
    for size in (0, 1, 3, 20, 130):
        for _ in range(40):
            a = [rng.choice("abc") for _ in range(rng.randint(0, size))]
            b = [rng.choice("abcd") for _ in range(rng.randint(0, size))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row, old = [i], row
                for j, y in enumerate(b, 1):
                    row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
            assert edit_distance(a, b) == row[-1]
    many = [str(i) for i in range(30_000)]
    assert edit_distance(many, ["x", *many[:10_000], *many[10_001:], "y"]) == 3


def test_price_as_of_with_one_hot_key(rows):
    from tradeq.operators import quality as Q

    rng = random.Random(10)
    prices = [(0 if rng.random() < 0.5 else rng.randint(1, 6), rng.randint(0, 400), round(rng.random(), 3)) for _ in range(600)]
    events = [(i, 0 if rng.random() < 0.5 else rng.randint(1, 8), rng.randint(0, 420)) for i in range(500)]
    events += [(1000 + i, 0, 77) for i in range(50)] + [(2000, None, 5), (2001, 3, None)]
    found = Q.asof_last_price(rows("id int, k int, ts long", *events), rows("k int, ts long, price double", *prices), ["k"], 60)
    got = {r.id: (r.last_ts, r.last_price) for r in found.collect()}
    for i, k, ts in events:
        before = [(t, p) for c, t, p in prices if c == k and ts is not None and t <= ts]
        assert got[i] == (max(before) if before else (None, None))
    assert len(got) == len(events)


def test_search_by_the_rarest_piece(rows):
    fields = ", ".join(f"{c} string" for c in S.SEARCH_FIELDS)
    names = [f"{_word(random.Random(i), 4)} DEPOT {i}" for i in range(80)] + ["LONE HUB", "A.B (C)"]
    terminals = rows(f"id int, {fields}, outpost string", *[(i, n, n, None, f"C{i}", None, None, None, "PLANET", "SYSTEM", None) for i, n in enumerate(names)])
    asked = ["depot 7", "lone", "Depot", "zz depot", "x", "", "hub/lone", "planet depot 12", "a.b", None]
    queries = rows("query_id int, query string", *enumerate(asked), (50, "depot 7"))
    got = {}
    for r in S.search_terminals(queries, terminals, 1000).collect():
        got.setdefault(r.query_id, set()).add(r.id)
        assert r.n_candidates >= 1
    for q, text in [*enumerate(asked), (50, "depot 7")]:
        if text is None:
            continue
        parts = [p for p in text.upper().replace("/", " ").split() if len(p) >= 2]
        want = {i for i, n in enumerate(names) if all(p in f"{n}\1{n}\1C{i}\1PLANET\1SYSTEM" for p in parts)}
        assert got.get(q, set()) == want, text
