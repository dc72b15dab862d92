"""Noisy screen text to price rows, as jobs over a table (capture_id, line_no, text).

Costly text tests run once per distinct line and are joined back. Ordered steps
use windows per capture: all lines of a capture come from one text value, so a
capture never outgrows a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tradeq.functions import text as T
from tradeq.operators.ordered import costly_filter, dealt, spread_distinct
from tradeq.operators.similarity import resolve_commodities
from tradeq.session import settle

# ---- fixed values: patterns, word lists and limits of the screen format -------

SCU_PATTERN = r"(\d[\d.,]*)\s*[5Ss3][Cc][UuOo0Yy]\b"
PRICE_PATTERN = r"(\d[\d.,]+)\s*([KMkm])?\s*[/\\1lI|]\s*[5Ss3][Cc][UuOo0]\b"
ZERO_SCU_PATTERN = r"(?i)^[O0o]\s*[5Ss][Cc][UuOo0]\s*$"
STOCK_PATTERN = r"(?i)ST[O0]C[KH]?"
INVENTORY_WORD = r"[I1]NV[E3]NT[O0]RY"
INVENTORY_SUFFIX = r"[I1]NV[E3]NT[O0]R?Y"
GAP = r"[.,;:\s]*"
BAND_MARKER = "--- ROW "

STATUS = {"OUT_OF_STOCK": 1, "VERY_LOW": 2, "LOW": 3, "MEDIUM": 4, "HIGH": 5, "VERY_HIGH": 6, "MAXIMUM": 7}

STATUS_PATTERNS = [
    (rf"(?i)\b(?:MAXIMUM|[MN]AX){GAP}{INVENTORY_WORD}\b|\bFULL\b", 7),
    (rf"(?i)\bVERY{GAP}HIGH{GAP}{INVENTORY_WORD}\b", 6),
    (rf"(?i)\bHIGH{GAP}{INVENTORY_WORD}\b", 5),
    (rf"(?i)\b(?:[MN]EDIUM|[MN]ED){GAP}{INVENTORY_WORD}\b", 4),
    (rf"(?i)\bVERY{GAP}LOW{GAP}{INVENTORY_WORD}\b", 2),
    (rf"(?i)\bLOW{GAP}{INVENTORY_WORD}\b", 3),
    (r"(?i)\bOUT\s*OF\s*ST[O0]CK\b|\bEMPTY\b", 1),
]

STATUS_WORDS = [
    ("VERY HIGH", 6), ("VERY LOW", 2), ("MAXIMUM", 7), ("MEDIUM", 4), ("HIGH", 5), ("LOW", 3), ("MAX", 7), ("MED", 4),
    ("FULL", 7),
]

STOP_WORDS = [
    "SHOP QUANTITY", "SHOP INVENTORY", "SHOP", "MAX INVENTORY", "MIN INVENTORY", "HIGH INVENTORY",
    "VERY HIGH INVENTORY", "MEDIUM INVENTORY", "LOW INVENTORY", "VERY LOW INVENTORY", "AVAILABLE CARGO SIZE",
    "CARGO CAPACITY", "CARGO SIZE", "CURRENT BALANCE", "LOCAL MARKET VALUE", "IN STOCK", "OUT OF STOCK", "IN DEMAND",
    "NO DEMAND", "CANNOT SELL", "YOUR INVENTORIES", "COMMODITIES", "BUY", "SELL", "SELECT SUB-CATEGORY", "QUALITY",
]

CONTAINER_SIZES = [1, 2, 4, 8, 16, 24, 32]
MISREAD, MEANT = "OolI|SBZ", "00111582"

LABEL_SCORE = 80
COMMODITY_SCORE = 75
LOOK_AHEAD = 4


# ---- expressions over one line ------------------------------------------------


def repair_numeric(line: Column) -> Column:
    """Turn letters misread for digits back, in tokens that look numeric only."""

    def fix(t: Column) -> Column:
        size, n_digits = F.char_length(t), T.digits(t)
        plain = F.translate(t, MISREAD, "")
        ambiguous = size - F.char_length(plain)
        numeric = (
            (size >= 2)
            & (n_digits >= 1)
            & (T.letters(plain) <= 1)
            & ((n_digits + ambiguous) / size >= 0.7)
        )
        return F.when(numeric, F.translate(t, MISREAD, MEANT)).otherwise(t)

    return F.array_join(F.transform(F.split(line, " "), fix), " ")


def mostly_number(line: Column) -> Column:
    n = T.digits(line)
    return (n >= 1) & (n >= F.char_length(line) * 0.3)


def parse_scu(line: Column) -> Column:
    return F.translate(F.regexp_extract(line, SCU_PATTERN, 1), ",.", "").try_cast("int")


def parse_price(line: Column) -> Column:
    """Without K or M both separators are dropped; with one the first mark is the decimal point."""
    number = F.regexp_extract(line, PRICE_PATTERN, 1)
    unit = F.upper(F.regexp_extract(line, PRICE_PATTERN, 2))
    dotted = F.translate(number, ",", ".")
    whole, rest = F.split_part(dotted, F.lit("."), F.lit(1)), F.regexp_replace(dotted, r"^[^.]*\.?", "")
    scaled = F.concat(whole, F.lit("."), F.translate(rest, ".", "")).try_cast("double")
    plain = F.translate(number, ",.", "").try_cast("double")
    return F.when(unit == "K", scaled * 1e3).when(unit == "M", scaled * 1e6).otherwise(plain)


def parse_numbers(lines: DataFrame) -> DataFrame:
    line = repair_numeric(F.col("text"))
    return lines.withColumns(
        {
            "scu": F.when(line.rlike(SCU_PATTERN), parse_scu(line)),
            "price": F.when(line.rlike(PRICE_PATTERN), parse_price(line)),
        }
    )


def name_candidate(line: Column) -> Column:
    """Upper case, Title Case per word, or a letter-heavy fragment with a capital."""
    n_letters, size = T.letters(line), F.char_length(line)
    n_upper = F.char_length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    first_letters = F.filter(
        F.transform(F.split(line, " "), lambda w: F.regexp_extract(w, r"(\p{L})", 1)), lambda c: c != ""
    )
    title = (F.size(first_letters) > 0) & F.forall(first_letters, lambda c: c.rlike(r"^\p{Lu}$"))
    solid = F.char_length(F.regexp_replace(line, r"\s", ""))
    fragment = (n_letters >= 5) & (n_upper >= 1) & (n_letters / solid >= 0.8)
    return (size >= 3) & (n_letters >= 3) & ((n_upper >= n_letters * 0.6) | title | fragment)


def ui_label(line: Column) -> Column:
    token = T.norm(line)
    return (token == "") | T.looks_like_label(token, STOP_WORDS, LABEL_SCORE)


def label_status(line: Column) -> Column:
    """Stock status code of a line, null when it has none: patterns, then two fuzzy fall-backs."""
    strict = F.coalesce(*[F.when(line.rlike(p), F.lit(code)) for p, code in STATUS_PATTERNS])
    token = T.norm(line)
    size = F.char_length(token)
    stock = F.when(
        size.between(10, 20) & token.rlike(STOCK_PATTERN),
        F.when(T.weighted(token, F.lit("OUT OF STOCK")) >= 70, F.lit(1)),
    )
    prefix = T.norm(F.regexp_extract(line, rf"(?is)^(.*?)\b{INVENTORY_SUFFIX}\b", 1))
    best = T.let(
        prefix,
        lambda p: F.array_max(
            F.array(
                *[
                    F.struct(T.partial(p, F.lit(word)).alias("score"), F.lit(-i).alias("first"), F.lit(code).alias("code"))
                    for i, (word, code) in enumerate(STATUS_WORDS)
                ]
            )
        ),
    )
    fuzzy = F.when(
        line.rlike(rf"(?i)\b{INVENTORY_SUFFIX}\b") & F.char_length(prefix).between(2, 24),
        T.let(best, lambda b: F.when(b["score"] >= 75, b["code"])),
    )
    return F.coalesce(strict, stock, fuzzy)


def size_label(line: Column) -> Column:
    up = F.upper(line)
    return (T.partial(up, F.lit("AVAILABLE CARGO SIZE")) >= 75) | (T.partial(up, F.lit("CARGO SIZE")) >= 90)


def digit_sizes(line: Column) -> Column:
    """Known sizes read off the digits in ascending order; null with fewer than two digits or sizes."""
    only = F.regexp_replace(line, r"[^\p{Nd}]", "")
    start = F.struct(only.alias("rest"), F.array().cast("array<int>").alias("found"))

    def take(state: Column, size: Column) -> Column:
        mark = size.cast("string")
        return F.when(
            F.startswith(state["rest"], mark),
            F.struct(
                F.substr(state["rest"], F.char_length(mark) + 1).alias("rest"),
                F.concat(state["found"], F.array(size)).alias("found"),
            ),
        ).otherwise(state)

    sizes = F.array(*[F.lit(s) for s in CONTAINER_SIZES])
    found = F.aggregate(sizes, start, take, lambda s: s["found"])
    return F.when(F.char_length(only) >= 2, F.when(F.size(found) >= 2, found))


# ---- line table -----------------------------------------------------------------


def line_features(lines: DataFrame) -> DataFrame:
    """One row per distinct text, numbered, with everything that depends on the text alone.

    Written, so that Spark knows its size when lines look their text up, and deals lines by
    text only where it is large; then it also splits texts that very many lines have.
    """
    texts = spread_distinct(lines, "text").drop("n").withColumn("line", repair_numeric(F.col("text")))
    line, raw = F.col("line"), F.col("text")
    kind = (
        F.when(line.rlike(SCU_PATTERN) & mostly_number(line), "SCU")
        .when(T.strip(line).rlike(ZERO_SCU_PATTERN), "ZERO")
        .when(line.rlike(PRICE_PATTERN), "PRICE")
        .when(name_candidate(line) & ~ui_label(line), "NAME")
        .otherwise("OTHER")
    )
    may_follow = ~raw.rlike(SCU_PATTERN) & ~raw.rlike(PRICE_PATTERN) & name_candidate(raw) & ~ui_label(raw)
    known = texts.withColumns({"kind": kind, "may_follow": may_follow, "status": label_status(line)}).withColumns(
        {
            "scu": F.when(F.col("kind") == "SCU", parse_scu(line)).when(F.col("kind") == "ZERO", F.lit(0)),
            "price": F.when(F.col("kind") == "PRICE", parse_price(line)),
        }
    )
    return settle(known.withColumn("no", F.monotonically_increasing_id()), "line-features")


def resolve_line_names(lines: DataFrame, features: DataFrame, commodities: DataFrame) -> DataFrame:
    """Commodity of each NAME line, alone or joined with the next name-like line.

    ``lines`` and their ``features`` are written tables. Lines are dealt by capture with the
    number of their text in place of the text, which is looked up again afterwards. Adds ``m``
    (id, score), ``used_partner`` and leaves other lines unmatched.
    """
    short = lines.join(features.select("text", "no", "kind", "may_follow"), "text").drop("text")
    order = W.partitionBy("capture_id").orderBy("line_no")
    follower = F.when(F.col("may_follow"), F.struct("line_no", "no"))
    following = F.coalesce(*[F.lead(follower, i).over(order) for i in range(1, LOOK_AHEAD + 1)])
    is_name = F.col("kind") == "NAME"
    ahead = dealt(short, "capture_id", lines.count()).withColumn("next", F.when(is_name, following)).drop("may_follow")
    joined = F.concat_ws(" ", "line", "next_text")
    own = features.filter(is_name).select("no", "line")
    after = features.filter("may_follow").select(F.col("no").alias("next_no"), F.col("text").alias("next_text"))
    pairs = ahead.filter("next is not null").select("no", F.col("next.no").alias("next_no")).distinct()
    pairs = spread_distinct(pairs.join(own, "no").join(after, "next_no").select(T.norm(joined).alias("token")), "token")
    usable = costly_filter(pairs, ~ui_label(F.col("token")))
    singles = own.select(T.norm(F.col("line")).alias("token"))
    # read twice below, and small: one row per matched name
    matches = settle(
        resolve_commodities(singles.unionByName(usable), commodities, COMMODITY_SCORE).select(
            "token", F.struct(F.col("matched_id").alias("id"), "score").alias("m")
        ),
        "matches",
    )
    one = matches.select(F.col("token").alias("single_token"), F.col("m").alias("one"))
    two = matches.select(F.col("token").alias("joined_token"), F.col("m").alias("two"))
    told = features.select("no", "text", "line", "status", "scu", "price")
    texts = ahead.withColumn("next_no", F.col("next.no")).join(told, "no").join(after, "next_no", "left").drop("no", "next_no")
    tokens = {
        "joined": F.when(F.col("next").isNotNull(), joined),
        "single_token": F.when(is_name, T.norm(F.col("line"))),
    }
    both = (
        texts.withColumns(tokens).withColumn("joined_token", T.norm(F.col("joined")))
        .join(one, "single_token", "left").join(two, "joined_token", "left")
    )
    better = F.col("two").isNotNull() & (
        F.col("one").isNull()
        | (F.col("two.score") >= F.col("one.score") + 5)
        | ((F.col("one.score") < 95) & (F.col("two.score") >= F.col("one.score")))
    )
    return both.withColumn("used_partner", F.coalesce(better, F.lit(False))).withColumn(
        "m", F.when(F.col("used_partner"), F.col("two")).otherwise(F.col("one"))
    )


def classify_lines(lines: DataFrame, commodities: DataFrame) -> DataFrame:
    """(capture_id, line_no, kind, line, id_commodity, match_score, scu, price, status).

    Kinds: COMMODITY, SCU, PRICE, SKIP, OTHER. A partner that classifies as nothing
    itself becomes SKIP with blank text.
    """
    lines = settle(lines, "lines")
    matched = resolve_line_names(lines, line_features(lines), commodities)
    order = W.partitionBy("capture_id").orderBy("line_no")
    # the partner sits at most LOOK_AHEAD lines ahead, so the lines before it tell
    taken = F.when(F.col("used_partner"), F.col("next.line_no"))
    is_taken = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.lag(taken, i).over(order) == F.col("line_no"), F.lit(False)) for i in range(1, LOOK_AHEAD + 1)],
    )
    marked = matched.withColumn("is_taken", is_taken)
    kind = (
        F.when(F.col("kind").isin("SCU", "ZERO"), "SCU")
        .when(F.col("kind") == "PRICE", "PRICE")
        .when(F.col("m").isNotNull(), "COMMODITY")
        .when(F.col("is_taken"), "SKIP")
        .otherwise("OTHER")
    )
    out = marked.withColumn("kind", kind)
    skipped = F.col("kind") == "SKIP"
    return out.select(
        "capture_id",
        "line_no",
        "kind",
        F.when(skipped, "").when(F.col("used_partner"), F.col("joined")).otherwise(F.col("line")).alias("line"),
        F.col("m.id").alias("id_commodity"),
        F.col("m.score").alias("match_score"),
        "scu",
        "price",
        F.when(~skipped & (F.col("kind") != "COMMODITY"), F.col("status")).alias("status"),
    )


def assemble_rows(classified: DataFrame) -> DataFrame:
    """One row per commodity line with the first quantity and price that follow it."""
    order = W.partitionBy("capture_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    is_row = F.col("kind") == "COMMODITY"
    cut = classified.withColumn("segment", F.sum(F.when(is_row, 1).otherwise(0)).over(order)).filter("segment > 0")

    def first(column: str, kind: str) -> Column:
        hit = (F.col("kind") == kind) & F.col(column).isNotNull()
        return F.min_by(column, F.when(hit, F.col("line_no")))

    return cut.groupBy("capture_id", "segment").agg(
        first("id_commodity", "COMMODITY").alias("id_commodity"),
        first("match_score", "COMMODITY").alias("match_score"),
        first("scu", "SCU").alias("scu"),
        first("price", "PRICE").alias("price"),
    ).withColumn("row_index", F.col("segment") - 1).drop("segment")


def dedupe_rows(rows: DataFrame) -> DataFrame:
    """Most complete row per (capture, commodity); ``row_index`` is the first occurrence."""
    complete = F.when(F.col("scu").isNotNull(), 2).otherwise(0) + F.when(F.col("price").isNotNull(), 2).otherwise(0)
    rank = F.struct((-complete).alias("c"), (-F.col("match_score")).alias("s"), "row_index")
    best = F.min_by(F.struct("match_score", "scu", "price"), rank).alias("b")
    return (
        rows.filter("id_commodity is not null")
        .groupBy("capture_id", "id_commodity")
        .agg(best, F.min("row_index").alias("row_index"))
        .select("capture_id", "id_commodity", "row_index", "b.*")
    )


def commodity_status(classified: DataFrame) -> DataFrame:
    """(capture_id, id_commodity, status) by the carry rules of the screen order.

    The lines between two new commodities form a stretch. Its first status goes
    to the stretch's commodity, unless a band marker came before. What is still
    pending at the end of the stretch (a second status, or one after the last
    marker) goes to the next new commodity if that finds none of its own.
    Repeated commodity lines count for nothing.
    """
    per = W.partitionBy("capture_id")
    order = per.orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    is_row = F.col("kind") == "COMMODITY"
    first_seen = F.min(F.when(is_row, F.col("line_no"))).over(W.partitionBy("capture_id", "id_commodity"))
    fresh = classified.withColumn("is_new", is_row & (F.col("line_no") == first_seen)).filter(~is_row | F.col("is_new"))
    cut = fresh.withColumn("stretch", F.sum(F.when(F.col("is_new"), 1).otherwise(0)).over(order))
    no = F.col("line_no")
    marker = F.startswith("line", F.lit(BAND_MARKER))
    told = F.col("status").isNotNull() & ~marker & ~is_row
    parts = cut.groupBy("capture_id", "stretch").agg(
        F.max("id_commodity").alias("id_commodity"),
        F.min(F.when(marker, no)).alias("first_marker"),
        F.max(F.when(marker, no)).alias("last_marker"),
        F.count_if(told).alias("n"),
        F.min(F.when(told, F.struct(no.alias("no"), "status"))).alias("head"),
        F.max(F.when(told, F.struct(no.alias("no"), "status"))).alias("tail"),
    )
    starts, marked = F.col("stretch") > 0, F.col("first_marker").isNotNull()
    direct = F.when(starts & (~marked | (F.col("head.no") < F.col("first_marker"))), F.col("head.status"))
    pending = (
        F.when(marked, F.when(F.col("tail.no") > F.col("last_marker"), F.col("tail.status")))
        .when(~starts | (F.col("n") >= 2), F.col("tail.status"))
    )
    known = parts.select("capture_id", "stretch", "id_commodity", direct.alias("direct"), pending.alias("pending"))
    carried = F.lag("pending").over(per.orderBy("stretch"))
    # a capture may start with a commodity, then there is no stretch 0 before it and nothing is carried
    return (
        known.withColumn("carried", carried)
        .filter("stretch > 0")
        .select("capture_id", "id_commodity", F.coalesce("direct", "carried", F.lit(0)).alias("status"))
    )


def with_status(rows: DataFrame, status: DataFrame) -> DataFrame:
    return rows.join(status, ["capture_id", "id_commodity"], "left").withColumn("status", F.coalesce("status", F.lit(0)))


def infer_out_of_stock(rows: DataFrame) -> DataFrame:
    """Out of stock without a quantity means 0; quantity 0 without a status means out of stock."""
    scu = F.when((F.col("status") == 1) & F.col("scu").isNull(), F.lit(0)).otherwise(F.col("scu"))
    status = F.when((F.col("scu") == 0) & (F.col("status") == 0), F.lit(1)).otherwise(F.col("status"))
    return rows.select(*[c for c in rows.columns if c not in ("scu", "status")], scu.alias("scu"), status.alias("status"))


def telling_lines(classified: DataFrame) -> DataFrame:
    """Lines that rows or their status come from, with no more of their text than a band marker has."""
    values = F.col("kind").isin("COMMODITY", "SCU", "PRICE") | F.col("status").isNotNull()
    cut = F.substring("line", 1, len(BAND_MARKER))
    return classified.filter(values | F.startswith("line", F.lit(BAND_MARKER))).withColumn("line", cut)


def extract_rows(lines: DataFrame, commodities: DataFrame) -> DataFrame:
    """The whole way from lines to reconciled price rows."""
    classified = settle(telling_lines(classify_lines(lines, commodities)), "classified")
    # lines are dealt once for the rows and once for their status: what one has shuffled goes before the other starts
    rows = settle(dedupe_rows(assemble_rows(dealt(classified, "capture_id"))), "rows")
    status = settle(commodity_status(dealt(classified, "capture_id")), "commodity-status")
    return infer_out_of_stock(with_status(rows, status))


def merge_retry(first: DataFrame, retry: DataFrame) -> DataFrame:
    """Fill holes only: status where unknown, and then the quantity where null, from the retry run."""
    known = retry.filter("status <> 0").groupBy("capture_id", "id_commodity").agg(
        F.min_by(F.struct("status", "scu"), "row_index").alias("again")
    )
    hole = (F.col("status") == 0) & F.col("id_commodity").isNotNull() & F.col("again").isNotNull()
    joined = first.join(known, ["capture_id", "id_commodity"], "left")
    kept = [c for c in first.columns if c not in ("scu", "status")]
    return joined.select(
        *kept,
        F.when(hole, F.coalesce("scu", "again.scu")).otherwise(F.col("scu")).alias("scu"),
        F.when(hole, F.col("again.status")).otherwise(F.col("status")).alias("status"),
    )


# ---- sizes and tab ---------------------------------------------------------------


def look_up(lines: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """Written ``lines`` with the columns of ``texts`` in place of the text, dealt by capture.

    ``texts`` holds only texts that tell something and is written, so Spark sees that it is
    small and no line is dealt by its text, which very many lines may share. Lines with
    another text stay, with nulls: windows count them.
    """
    known = settle(texts, "told-texts").withColumnRenamed(column, "told")
    told = lines.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("told"), "left").drop("told", column)
    return dealt(told, "capture_id", lines.count())


def extract_sizes(lines: DataFrame) -> DataFrame:
    """Lines of a written table with readable container sizes on a size label or up to three lines below it."""
    texts = spread_distinct(lines, "text").withColumns(
        {"is_label": size_label(F.col("text")), "sizes": digit_sizes(F.col("text"))}
    )
    told = look_up(lines, costly_filter(texts, F.col("is_label") | F.col("sizes").isNotNull()), "text")
    near = W.partitionBy("capture_id").orderBy("line_no").rowsBetween(-3, 0)
    return (
        told.withColumn("near_label", F.max("is_label").over(near))
        .filter(F.col("near_label") & F.col("sizes").isNotNull())
        .select("capture_id", "line_no", "sizes")
    )


def container_union(sizes: DataFrame, captures: DataFrame) -> DataFrame:
    """All sizes of a capture, ascending as CSV; null if there are none."""
    found = sizes.select("capture_id", F.explode("sizes").alias("size")).groupBy("capture_id").agg(
        F.array_sort(F.collect_set("size")).alias("all")
    )
    csv = F.array_join(F.transform("all", lambda s: s.cast("string")), ",")
    return captures.select("capture_id").distinct().join(found, "capture_id", "left").select(
        "capture_id", csv.alias("container_sizes")
    )


def detect_tab(lines: DataFrame) -> DataFrame:
    """First line of a capture that tells the side decides; BUY if none does. ``lines`` is a written table."""
    token = T.norm(F.col("text"))
    buy = T.weighted(token, F.lit("BUY"))
    texts = spread_distinct(lines, "text").withColumns(
        {
            "is_value": T.weighted(token, F.lit("LOCAL MARKET VALUE")) >= 80,
            "is_buy": buy >= 80,
            "is_sure_buy": (buy >= 90) & (F.char_length(token) <= 5),
        }
    )
    order = W.partitionBy("capture_id").orderBy("line_no")
    after_buy = F.coalesce(F.lag("is_buy").over(order), F.lit(False))
    said = (
        F.when(F.col("is_value"), F.when(F.col("after_buy"), "BUY").otherwise("SELL")).when(F.col("is_sure_buy"), "BUY")
    )
    saying = look_up(lines, costly_filter(texts, F.col("is_value") | F.col("is_buy")), "text")
    told = saying.withColumn("after_buy", after_buy).withColumn("said", said)
    return told.groupBy("capture_id").agg(
        F.coalesce(F.min_by("said", F.when(F.col("said").isNotNull(), F.col("line_no"))), F.lit("BUY")).alias("tab")
    )


# Fixed limits of the measured decision.
SATURATION_GAP, SATURATION_FLOOR = 12.0, 25.0
RATIO_GAP, RATIO_FLOOR = 0.15, 0.35
VALUE_GAP, VALUE_FLOOR = 20.0, 140.0


def palette() -> Column:
    """Colour family by the hue of the more saturated label."""
    hue = F.when(F.col("buy_saturation") >= F.col("sell_saturation"), F.col("buy_hue")).otherwise(F.col("sell_hue"))
    bins = [(25, "AMBER"), (40, "YELLOW"), (80, "GREEN"), (100, "TEAL"), (130, "BLUE")]
    named = F.when((hue <= 10) | (hue >= 170), "RED")
    for top, name in bins:
        named = named.when(hue <= top, name)
    return F.when(F.greatest("buy_saturation", "sell_saturation") < SATURATION_FLOOR, "UNKNOWN").otherwise(
        named.otherwise("PURPLE")
    )


def decide_tab(samples: DataFrame) -> DataFrame:
    """Tab from two measured labels: saturation, then bright ratio on red, else value."""

    def clear(name: str, gap: float, floor: float) -> Column:
        b, s = F.col(f"buy_{name}"), F.col(f"sell_{name}")
        return F.when(
            (F.greatest(b, s) >= floor) & (F.abs(b - s) >= gap), F.when(b > s, "BUY").otherwise("SELL")
        )

    second = F.when(F.col("palette") == "RED", clear("ratio", RATIO_GAP, RATIO_FLOOR)).otherwise(
        clear("value", VALUE_GAP, VALUE_FLOOR)
    )
    tab = F.coalesce(clear("saturation", SATURATION_GAP, SATURATION_FLOOR), second, F.lit("UNKNOWN"))
    grey = F.greatest("buy_saturation", "sell_saturation") < SATURATION_FLOOR
    return (
        samples.withColumn("palette", palette())
        .withColumn("tab", tab)
        .withColumn("reason", F.when(F.col("tab") == "UNKNOWN", F.when(grey, "both-grey").otherwise("low-margin")))
    )


# ---- layout and names --------------------------------------------------------------

ROW_TOLERANCE, MERGE_GAP, MIN_HEIGHT = 0.6, 1.2, 8


def median_heights(regions: DataFrame) -> DataFrame:
    """Upper median height per capture, at least 8, from height counts."""
    counts = regions.groupBy("capture_id", "height").agg(F.count(F.lit(1)).alias("n"))
    up = W.partitionBy("capture_id").orderBy("height").rowsBetween(W.unboundedPreceding, 0)
    reached = counts.withColumns({"upto": F.sum("n").over(up), "total": F.sum("n").over(W.partitionBy("capture_id"))})
    return (
        reached.filter(F.col("upto") > F.floor(F.col("total") / 2))
        .groupBy("capture_id")
        .agg(F.greatest(F.min("height"), F.lit(MIN_HEIGHT)).alias("median_height"))
    )


def regions_to_lines(regions: DataFrame) -> DataFrame:
    """Text regions to lines: rows by running mean of y, then merging along x.

    A y gap above the tolerance always starts a row (the running mean is never
    above the last y), so only regions between such gaps need the ordered fold.
    """
    clean = regions.withColumn("text", T.strip(F.col("text"))).filter("text <> ''")
    sized = clean.join(median_heights(clean), "capture_id").withColumn(
        "tolerance", F.col("median_height") * ROW_TOLERANCE
    )
    by_y = W.partitionBy("capture_id").orderBy("center_y", "center_x", "left")
    gap = F.col("center_y") - F.lag("center_y").over(by_y)
    banded = sized.withColumn("breaks", F.when(gap <= F.col("tolerance"), 0).otherwise(1)).withColumn(
        "band", F.sum("breaks").over(by_y.rowsBetween(W.unboundedPreceding, 0))
    )
    items = F.array_sort(F.collect_list(F.struct("center_y", "center_x", "left", "right", "text")))
    bands = banded.groupBy("capture_id", "band", "tolerance", "median_height").agg(items.alias("items"))
    start = F.struct(
        F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("rows")
    )

    def step(state: Column, item: Column) -> Column:
        same = (state["n"] == 0) | (
            F.abs(item["center_y"] - state["total"] / state["n"]) <= F.col("tolerance")
        )
        row = F.when(same, state["row"]).otherwise(state["row"] + 1)
        return F.struct(
            F.when(same, state["total"]).otherwise(F.lit(0.0)).__add__(item["center_y"]).alias("total"),
            (F.when(same, state["n"]).otherwise(F.lit(0)) + 1).alias("n"),
            row.alias("row"),
            F.concat(state["rows"], F.array(row)).alias("rows"),
        )

    rows = F.aggregate("items", start, step, lambda s: s["rows"])
    placed = bands.withColumn("rows", rows).select(
        "capture_id", "band", "median_height", F.inline(F.arrays_zip("items", "rows"))
    ).select("capture_id", "band", "median_height", F.col("rows").alias("row"), "items.*")
    by_x = W.partitionBy("capture_id", "band", "row").orderBy("center_x", "left", "center_y")
    apart = F.col("left") - F.lag("right").over(by_x) > F.col("median_height") * MERGE_GAP
    pieces = placed.withColumn("cut", F.when(apart, 1).otherwise(0)).withColumns(
        {
            "piece": F.sum("cut").over(by_x.rowsBetween(W.unboundedPreceding, 0)),
            "nth": F.row_number().over(by_x),
        }
    )
    texts = F.array_sort(F.collect_list(F.struct("nth", "text")))
    joined = pieces.groupBy("capture_id", "band", "row", "piece").agg(
        F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("text")
    )
    down = W.partitionBy("capture_id").orderBy("band", "row", "piece")
    return joined.withColumn("line_no", F.row_number().over(down) - 1).select("capture_id", "line_no", "text")


def capture_time(name: Column) -> Column:
    """Display time of a capture file name; other names come back without extension."""
    base = F.regexp_replace(F.element_at(F.split(name, r"[/\\]"), -1), r"\.[^.]*$", "")
    rest = F.substr(base, F.lit(12))
    tail = F.regexp_extract(rest, r"^.+-([^-]{3,4})$", 1)
    tagged = (tail != "") & tail.rlike(r"\p{L}")
    core = F.when(tagged, F.regexp_extract(rest, r"^(.+)-[^-]{3,4}$", 1)).otherwise(rest)
    day, clock = F.regexp_extract(core, r"^([^_]+)_(.+)$", 1), F.regexp_extract(core, r"^([^_]+)_(.+)$", 2)
    shown = F.when(day != "", F.concat(day, F.lit(" "), F.translate(clock, "-", ":"))).otherwise(core)
    return F.when(F.lower(F.substring(base, 1, 11)) == "screenshot-", shown).otherwise(base)
