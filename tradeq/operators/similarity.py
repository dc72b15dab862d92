"""Fuzzy resolution of noisy strings against catalogs, without comparing all pairs.

Candidates come from an equi-join on short character keys that cannot miss a
pair above the score limit. A pair with ``ratio`` >= s differs in at most
t = floor(L * (100.5 - s) / 100) edits, L being the longer length. Cut a string
into t+1 pieces: at least one piece survives in the other string. So one side
offers its pieces (cut to three characters), the other all its 1..3-character
substrings. ``partial`` is the same argument with the shorter length. The word
scores add shared words as keys and the sorted forms as further strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tradeq.functions import text as T
from tradeq.operators.catalog import rich_label
from tradeq.operators.ordered import costly_filter, spread_distinct

# Fixed list: screen labels that are never a place name, and the score from which text counts as one.
NOISE_LABELS = [
    "COMMODITIES", "YOUR INVENTORIES", "SHOP INVENTORY", "SELECT SUB CATEGORY", "SELECT SUB-CATEGORY",
    "IN DEMAND", "NO DEMAND", "CANNOT SELL", "LOCAL MARKET VALUE", "CURRENT BALANCE", "AVAILABLE CARGO SIZE",
    "CARGO SIZE", "OUT OF STOCK", "MAX INVENTORY", "MAXIMUM INVENTORY",
]
NOISE_SCORE = 75

TERMINAL_FIELDS = ["displayname", "name", "nickname", "space_station_name", "outpost_name", "city_name"]
COMMODITY_FIELDS = ["name", "code"]


def forms(df: DataFrame, column: str, tag: str) -> DataFrame:
    """Add the forms every scorer needs, once per distinct string."""
    c = F.col(column)
    return df.withColumns(
        {
            f"{tag}_len": F.char_length(c),
            f"{tag}_sorted": T.sorted_words(c),
            f"{tag}_set": T.word_set(c),
        }
    )


def _strings(column: str, tag: str) -> Column:
    return F.array_distinct(F.array(F.col(column), F.col(f"{tag}_sorted"), F.array_join(f"{tag}_set", " ")))


def _substrings(strings: Column) -> Column:
    """All distinct substrings of one to three characters; one regex pass per length."""
    def grams(s: Column, n: int) -> Column:
        return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))

    return F.array_distinct(
        F.flatten(F.transform(strings, lambda s: F.array_distinct(F.concat(grams(s, 1), grams(s, 2), grams(s, 3)))))
    )


def _pieces(strings: Column, min_score: int) -> Column:
    def cut(s: Column) -> Column:
        size = F.char_length(s)
        n = F.floor(size * (100.5 - min_score) / 100.0).cast("int") + 1
        edge = lambda i: F.floor(i * size / n).cast("int")
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.substring(s, edge(i) + 1, F.least(F.lit(3), edge(i + 1) - edge(i))),
        )

    return F.array_distinct(F.flatten(F.transform(strings, cut)))


def _keys(values: Column, prefix: str) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(prefix), v))


def candidate_pairs(tokens: DataFrame, values: DataFrame, min_score: int) -> DataFrame:
    """Pairs (token, value) that may score >= ``min_score``; never misses one.

    Inputs hold distinct strings prepared by ``forms`` as ``token``/``t_*`` and
    ``value``/``v_*``.
    """
    ts, vs = _strings("token", "t"), _strings("value", "v")
    longest = values.agg(F.max("v_len")).scalar()
    # pieces of a token can only matter for values long enough to reach the score
    matters = F.col("t_len") * ((min_score - 0.5) / 100.0) <= longest
    none = F.array().cast("array<string>")
    left = F.concat(
        _keys(_substrings(ts), "p"),
        F.when(matters, _keys(_pieces(ts, min_score), "g")).otherwise(none),
        _keys(F.col("t_set"), "w"),
    )
    right = F.concat(_keys(_pieces(vs, min_score), "p"), _keys(_substrings(vs), "g"), _keys(F.col("v_set"), "w"))
    return (
        tokens.select("token", F.explode(left).alias("key"))
        .join(values.select("value", F.explode(right).alias("key")), "key")
        .select("token", "value")
        .distinct()
    )


def _scored(pairs: DataFrame, values: DataFrame, min_score: int, with_partial: bool = False) -> DataFrame:
    """Scores of (token, value) pairs, exact from ``min_score`` on. Token forms are worked
    out again here, so the token table, which may be costly, is read only once."""
    both = forms(pairs, "token", "t").join(values, "value")
    weighted = T.weighted_of(
        F.col("token"), F.col("value"), F.col("t_sorted"), F.col("v_sorted"), F.col("t_set"), F.col("v_set"), min_score
    )
    if not with_partial:
        return both.withColumn("score", weighted)
    short = F.when(F.col("t_len") <= F.col("v_len"), F.col("token")).otherwise(F.col("value"))
    long = F.when(F.col("t_len") <= F.col("v_len"), F.col("value")).otherwise(F.col("token"))
    return (
        both.withColumns({"short": short, "long": long})
        .withColumn(
            "score",
            F.greatest(
                weighted,
                T.partial_of(F.col("short"), F.col("long"), min_score),
                T.token_set_of(F.col("t_set"), F.col("v_set")),
            ),
        )
        .drop("short", "long")
    )


def catalog_values(catalog: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct normalised field values with the first catalog entry and field that has them."""
    cells = F.array(
        *[F.struct(F.lit(i).alias("field_ord"), F.lit(f).alias("field"), F.col(f).alias("raw")) for i, f in enumerate(fields)]
    )
    flat = catalog.select(F.col("id").alias("ord"), F.inline(cells)).withColumn("value", T.norm(F.col("raw"))).filter("value <> ''")
    first = flat.groupBy("value").agg(F.min(F.struct("ord", "field_ord", "field")).alias("first"))
    return forms(first.select("value", "first.*"), "value", "v")


def _best(scored: DataFrame, need: Column) -> DataFrame:
    """Highest sufficient score per token; the earliest catalog entry and field win ties.

    The limit sits inside the aggregate: as a filter it would be pushed below the
    projection and every score computed twice.
    """
    entry = F.struct("score", (-F.col("ord")).alias("o"), (-F.col("field_ord")).alias("f"), "field", "value")
    best = F.max(F.when(F.col("score") >= need, entry))
    return scored.groupBy("token").agg(best.alias("b")).filter("b is not null").select(
        "token",
        (-F.col("b.o")).alias("matched_id"),
        F.col("b.field").alias("matched_field"),
        F.col("b.value").alias("matched_value"),
        F.col("b.score").alias("score"),
    )


def penalised(score: Column, len_a: Column, len_b: Column) -> Column:
    """Length penalty: below a length ratio of 3/4 the score shrinks with the ratio."""
    share = F.least(len_a, len_b) / F.greatest(len_a, len_b)
    return F.when(share >= 0.75, score).otherwise(F.bround(score * share).cast("int"))


def resolve_commodities(tokens: DataFrame, commodities: DataFrame, min_score: int = 70) -> DataFrame:
    """Best commodity per normalised token (column ``token``, any repeats).

    Tokens under three characters never match; up to four they need 95.
    """
    values = catalog_values(commodities, COMMODITY_FIELDS)
    longest = values.agg(F.max("v_len")).scalar()
    distinct = spread_distinct(tokens.filter(F.char_length("token") >= 3), "token").drop("n")
    # lossless: a smaller share of the length cannot reach the score even with equal words
    tokens_in_reach = forms(distinct, "token", "t").filter(
        F.bround(F.lit(100.0) * longest / F.col("t_len")) >= min(min_score, 75)
    )
    share = F.least("t_len", "v_len") / F.greatest("t_len", "v_len")
    near = (
        candidate_pairs(tokens_in_reach, values, min_score)
        .withColumns({"t_len": F.char_length("token"), "v_len": F.char_length("value")})
        .filter((share >= 0.75) | (F.bround(100.0 * share) >= min_score))
        .select("token", "value")
    )
    need = F.when(F.col("t_len") <= 4, F.lit(max(min_score, 95))).otherwise(F.lit(min_score))
    fuzzy = _scored(near, values, min_score).withColumn("score", penalised(F.col("score"), F.col("t_len"), F.col("v_len")))
    return _best(fuzzy, need)


def is_noise(token: Column) -> Column:
    return T.looks_like_label(token, NOISE_LABELS, NOISE_SCORE)


def resolve_terminals(tokens: DataFrame, terminals: DataFrame, min_score: int = 75) -> DataFrame:
    """Best terminal per normalised token over six name fields; screen labels never match."""
    values = catalog_values(terminals, TERMINAL_FIELDS)
    distinct = spread_distinct(tokens.filter(F.char_length("token") >= 3), "token")
    clean = forms(costly_filter(distinct, ~is_noise(F.col("token"))), "token", "t")
    scored = _scored(candidate_pairs(clean, values, min_score), values, min_score, with_partial=True)
    return _best(scored, F.lit(min_score))


def line_windows(lines: DataFrame) -> DataFrame:
    """Every run of one to three adjacent lines joined by a space, with enough letters."""
    w = W.partitionBy("capture_id").orderBy("line_no")  # one capture is one text value, so this is bounded
    second, third = F.lead("text", 1).over(w), F.lead("text", 2).over(w)
    runs = lines.withColumns({"second": second, "third": third}).select(
        "capture_id",
        "line_no",
        F.posexplode(
            F.array_compact(
                F.array(
                    F.col("text"),
                    F.when(F.col("second").isNotNull(), F.concat_ws(" ", "text", "second")),
                    F.when(F.col("third").isNotNull(), F.concat_ws(" ", "text", "second", "third")),
                )
            )
        ).alias("span", "window"),
    )
    return runs.filter((F.char_length("window") >= 4) & (T.letters(F.col("window")) >= 6)).withColumn(
        "token", T.norm(F.col("window"))
    )


def resolve_across_lines(lines: DataFrame, terminals: DataFrame, min_score: int = 75) -> DataFrame:
    """Best terminal per capture over all windows; the earliest window wins ties."""
    windows = line_windows(lines)
    matches = resolve_terminals(windows, terminals, min_score)
    best = F.max(
        F.struct(
            "score",
            (-F.col("line_no")).alias("line"),
            (-F.col("span")).alias("s"),
            "matched_id",
            "matched_field",
            "window",
        )
    )
    return windows.join(matches, "token").groupBy("capture_id").agg(best.alias("b")).select(
        "capture_id", "b.matched_id", "b.matched_field", "b.window", "b.score"
    )


def best_match(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Higher score per key; on equal scores the first source wins."""
    columns = [c for c in a.columns if c != key]
    both = a.withColumn("priority", F.lit(0)).unionByName(b.withColumn("priority", F.lit(-1)))
    best = F.max_by(F.struct(*columns), F.struct("score", "priority"))
    return both.groupBy(key).agg(best.alias("m")).select(key, "m.*")


def similarity_join(left: DataFrame, right: DataFrame, min_score: int = 70) -> DataFrame:
    """All pairs of two name tables with ``weighted`` >= ``min_score``; no length is too short."""
    tokens = forms(spread_distinct(left.filter("token <> ''"), "token").drop("n"), "token", "t")
    values = forms(right.select("value").distinct().filter("value <> ''"), "value", "v")
    scored = _scored(candidate_pairs(tokens, values, min_score), values, min_score)
    return scored.filter(F.col("score") >= min_score).select("token", "value", "score")


SEPARATORS = r"[ \t·/\\|\-–—,()\[\]]+"
SEARCH_FIELDS = [
    "displayname", "name", "nickname", "code", "space_station_name", "outpost_name", "city_name", "planet_name",
    "star_system_name",
]
FIELD_BREAK = "\u0001"
#: A single hit resolves a query only from this many characters on.
RESOLVING_LENGTH = 3


def _grams(c: Column, n: int) -> Column:
    """All substrings of ``n`` characters."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def search_terminals(queries: DataFrame, terminals: DataFrame, limit: int = 50) -> DataFrame:
    """Every query word must occur in some field; first ``limit`` hits by label.

    ``queries`` holds (query_id, query). Every pair or triple of characters of every word
    must occur in the fields, so a query is looked up by the one that the fewest terminals
    have: "depot hub 7" touches the terminals with a rare piece, not all depots. Then all
    words are tested. Terminals are counted by piece once; a query with a piece that no
    terminal has goes at once. A query without words lists all; that list is the same for
    each, so it is cut to ``limit`` before the join.
    """
    hay = F.upper(F.concat_ws(FIELD_BREAK, *[F.col(f) for f in SEARCH_FIELDS]))
    entries = terminals.select(F.col("id"), rich_label().alias("label"), hay.alias("hay"))
    keyed = entries.select("id", F.explode(F.array_distinct(F.concat(_grams(F.col("hay"), 2), _grams(F.col("hay"), 3)))).alias("key"))
    had = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_with"))
    parts = F.filter(F.split(F.upper(T.strip(F.col("query"))), SEPARATORS), lambda p: F.char_length(p) >= 2)
    long_enough = F.char_length(T.strip(F.col("query"))) >= RESOLVING_LENGTH
    asked = queries.select("query_id", parts.alias("parts"), F.coalesce(long_enough, F.lit(False)).alias("long_enough"))
    worded = asked.filter(F.size("parts") > 0)
    # queries with the same words are looked up once
    wanted = worded.select("parts").distinct()
    pieces = F.array_distinct(F.flatten(F.transform("parts", lambda p: F.when(F.char_length(p) == 2, F.array(p)).otherwise(_grams(p, 3)))))
    met = wanted.select("parts", F.explode(pieces).alias("key")).join(had, "key", "left")
    rarest = met.groupBy("parts").agg(
        F.min(F.struct(F.coalesce("n_with", F.lit(0)).alias("n_with"), "key")).alias("r")
    ).filter("r.n_with > 0").select("parts", "r.key")
    found_by = rarest.join(keyed, "key").join(entries, "id").filter(F.forall("parts", lambda p: F.contains(F.col("hay"), p)))
    counts = found_by.groupBy("parts").agg(F.count(F.lit(1)).alias("n_candidates"))
    w = W.partitionBy("parts").orderBy("label", "id")
    ranked = found_by.select("parts", "id", "label").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    found = worded.join(ranked.join(counts, "parts"), "parts")
    first = entries.orderBy("label", "id").limit(limit)
    total = terminals.agg(F.count(F.lit(1))).scalar()
    everything = first.select(
        "id", "label", F.lit(0).alias("key"),
        F.row_number().over(W.orderBy("label", "id")).alias("rank"), total.alias("n_candidates"),
    )
    wordless = asked.filter(F.size("parts") == 0).select("query_id", "long_enough", F.lit(0).alias("key")).join(everything, "key")
    columns = ["query_id", "rank", "id", "label", "n_candidates"]
    resolved = ((F.col("n_candidates") == 1) & F.col("long_enough")).alias("is_resolved")
    return found.select(*columns, resolved).unionByName(wordless.select(*columns, resolved))
