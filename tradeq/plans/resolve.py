"""Queries that resolve noisy names against the catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeq.functions import text as T
from tradeq.operators import similarity as S
from tradeq.plans import scorers as Q
from tradeq.plans.prices import LABEL_VIEWS
from tradeq.plans.registry import query
from tradeq.plans.views import using
from tradeq.sources.market import Market

VALUE_VIEWS = {
    "cvals": """SELECT value, arg_min(id, id*10+f) AS ord, min(id*10+f)%10 AS field_ord, length(value) AS vl FROM (
        SELECT id, 0 AS f, upper(trim(name)) AS value FROM commodities UNION ALL SELECT id, 1, upper(trim(code)) FROM commodities)
        WHERE value<>'' GROUP BY 1""",
}

PENALISED = (
    "CASE WHEN least(tl,vl)/CAST(greatest(tl,vl) AS DOUBLE)>=0.75 THEN raw "
    "ELSE CAST(round_even(raw*(least(tl,vl)/CAST(greatest(tl,vl) AS DOUBLE)),0) AS INT) END"
)


def commodity_match_views(tokens_sql: str, min_score: int) -> dict[str, str]:
    """Brute force: every distinct token against every distinct catalog value."""
    return VALUE_VIEWS | {
        "toks": f"SELECT DISTINCT token, length(token) AS tl FROM ({tokens_sql}) WHERE length(token)>=3",
        "pair_scores": f"SELECT *, {PENALISED} AS score FROM (SELECT *, {Q.weighted('token', 'value')} AS raw FROM toks, cvals)",
        "cmatch": f"""SELECT token, ord AS matched_id, CASE field_ord WHEN 0 THEN 'name' ELSE 'code' END AS matched_field,
            value AS matched_value, score FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, ord, field_ord) AS rn
              FROM pair_scores WHERE score >= CASE WHEN tl<=4 THEN {max(95, min_score)} ELSE {min_score} END) WHERE rn=1""",
    }


@query("commodity_resolution", using("screen_lines commodities", "SELECT * FROM cmatch",
       commodity_match_views("SELECT upper(text) AS token FROM screen_lines", 70)))
def commodity_resolution(m: Market):
    tokens = m.screen_lines().select(T.norm(F.col("text")).alias("token"))
    return S.resolve_commodities(tokens, m.commodities(), 70)


# ---- terminals ---------------------------------------------------------------


def spread_over(rows: DataFrame, key: str, terminals: DataFrame) -> DataFrame:
    """Give every row a terminal, all terminals in turn; the aggregate joined in is one row."""
    top = terminals.agg((F.max("id") + 1).alias("n_places"))
    return rows.crossJoin(top).withColumn("place", F.col(key) % F.col("n_places")).join(terminals, F.col("place") == F.col("id"))


def noisy_places(m: Market) -> DataFrame:
    """A misread place name per customer."""
    terminals = m.terminals().select("id", "name", "space_station_name", "outpost_name", "city_name")
    k = F.col("c_custkey")
    name = F.coalesce("space_station_name", "outpost_name", "city_name", "name")
    raw = (
        F.when(k % 37 == 0, F.lit("YOURSIOVEHTORTES"))
        .when(k % 5 == 0, F.col("name"))
        .when(k % 5 == 1, F.translate(name, "oO", "00"))
        .when(k % 5 == 2, F.substr(name, F.lit(2)))
        .when(k % 5 == 3, F.concat(F.substring_index(name, " ", -1), F.lit(" "), F.substring_index(name, " ", 2)))
        .otherwise(F.concat(F.col("name"), F.lit(" LEVEL 12")))
    )
    return spread_over(m.table("customer"), "c_custkey", terminals).select(
        k.alias("capture_id"), raw.alias("raw"), T.norm(raw).alias("token")
    )


PLACE_VIEWS = {
    "places": """SELECT capture_id, raw, upper(trim(raw)) AS token FROM (
        SELECT c_custkey AS capture_id, CASE WHEN c_custkey%37=0 THEN 'YOURSIOVEHTORTES' WHEN c_custkey%5=0 THEN name
          WHEN c_custkey%5=1 THEN translate(n,'oO','00') WHEN c_custkey%5=2 THEN substr(n,2)
          WHEN c_custkey%5=3 THEN split_part(n,' ',-1)||' '||array_to_string(string_split(n,' ')[1:2],' ')
          ELSE name||' LEVEL 12' END AS raw
        FROM customer JOIN (SELECT *, coalesce(space_station_name, outpost_name, city_name, name) AS n FROM terminals) t
          ON c_custkey%(SELECT max(id)+1 FROM terminals)=t.id)""",
    "tvals": """SELECT value, arg_min(id, id*10+f) AS ord, min(id*10+f)%10 AS field_ord FROM (""" + " UNION ALL ".join(
        f"SELECT id, {i} AS f, upper(trim({c})) AS value FROM terminals" for i, c in enumerate(S.TERMINAL_FIELDS)
    ) + ") WHERE value<>'' GROUP BY 1",
}


def terminal_match_views(tokens: str, min_score: int = 75) -> dict[str, str]:
    field = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(S.TERMINAL_FIELDS))
    noise = Q.weighted("token", "label")
    # 95 % of token_set never beats token_set, so weighted adds only ratio and token_sort
    score = f"greatest({Q.ratio('token', 'value')},{Q.ninety_five(Q.ratio('ts', 'vs'))},{Q.token_set('tw', 'vw')},{Q.partial('token', 'value')})"
    return {
        "ttoks": f"""SELECT token, {Q.sorted_words('token')} AS ts, {Q.word_set('token')} AS tw
            FROM (SELECT DISTINCT token FROM {tokens} WHERE length(token)>=3)""",
        "noisy": f"""SELECT DISTINCT token FROM ttoks, (SELECT unnest({Q.strings(S.NOISE_LABELS)}) AS label)
            WHERE {noise}>={S.NOISE_SCORE}""",
        "tforms": f"SELECT *, {Q.sorted_words('value')} AS vs, {Q.word_set('value')} AS vw FROM tvals",
        "tscores": f"SELECT *, {score} AS score FROM ttoks, tforms WHERE token NOT IN (SELECT token FROM noisy)",
        "tmatch": f"""SELECT token, ord AS matched_id, CASE field_ord {field} END AS matched_field, value AS matched_value, score
            FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, ord, field_ord) AS rn FROM tscores
                  WHERE score>={min_score}) WHERE rn=1""",
    }


@query("terminal_resolution", using("terminals", "SELECT * FROM tmatch", PLACE_VIEWS | terminal_match_views("places")))
def terminal_resolution(m: Market):
    return S.resolve_terminals(noisy_places(m), m.terminals(), 75)


@query("terminal_resolution_65", using("terminals", "SELECT * FROM tmatch", PLACE_VIEWS | terminal_match_views("places", 65)))
def terminal_resolution_65(m: Market):
    """The same at the lower score that captures are read with."""
    return S.resolve_terminals(noisy_places(m), m.terminals(), 65)


def place_lines(m: Market) -> DataFrame:
    """Header text of each capture: a label, a place name over one to three lines, more labels."""
    k = F.col("o_orderkey")
    terminals = m.terminals().select("id", F.upper("name").alias("n"))
    part = lambda i: F.split_part("n", F.lit(" "), F.lit(i))
    name = (
        F.when(k % 4 == 0, F.array(F.col("n")))
        .when(k % 4 == 1, F.array(part(1), F.concat_ws(" ", part(2), part(3))))
        .when(k % 4 == 2, F.array(part(1), F.translate(part(2), "IO", "10"), part(3)))
        .otherwise(F.array(F.lit("FPS."), F.lit("1 2 4 8")))
    )
    lines = F.concat(F.array(F.lit("YOUR INVENTORIES")), name, F.array(F.lit("CURRENT BALANCE"), F.lit("tE")))
    return (
        spread_over(m.table("orders"), "o_custkey", terminals)
        .select(k.alias("capture_id"), F.posexplode(lines).alias("line_no", "text"))
    )


_LINE_VIEWS = {
    "plines": """SELECT capture_id, text, line_no FROM (SELECT capture_id, unnest(l) AS text, generate_subscripts(l,1)-1 AS line_no FROM (
        SELECT o_orderkey AS capture_id, list_concat(['YOUR INVENTORIES'], CASE o_orderkey%4 WHEN 0 THEN [n]
          WHEN 1 THEN [split_part(n,' ',1), split_part(n,' ',2)||' '||split_part(n,' ',3)]
          WHEN 2 THEN [split_part(n,' ',1), translate(split_part(n,' ',2),'IO','10'), split_part(n,' ',3)]
          ELSE ['FPS.','1 2 4 8'] END, ['CURRENT BALANCE','tE']) AS l
        FROM orders JOIN (SELECT id, upper(name) AS n FROM terminals) t ON o_custkey%(SELECT max(id)+1 FROM terminals)=t.id))""",
    "runs": """SELECT capture_id, line_no, unnest([0,1,2]) AS span, unnest([text, text||' '||b, text||' '||b||' '||c]) AS win FROM (
        SELECT *, lead(text,1) OVER w AS b, lead(text,2) OVER w AS c FROM plines WINDOW w AS (PARTITION BY capture_id ORDER BY line_no))""",
    "wins": """SELECT *, upper(trim(win)) AS token FROM runs WHERE win IS NOT NULL AND length(win)>=4
        AND length(regexp_replace(win,'[^\\p{L}]','','g'))>=6""",
    "tvals": PLACE_VIEWS["tvals"],
}


@query("terminal_across_lines", using("terminals", """
    SELECT capture_id, matched_id, matched_field, win AS "window", score FROM (
      SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, line_no, span) AS rn
      FROM wins JOIN tmatch USING (token)) WHERE rn=1""", _LINE_VIEWS | terminal_match_views("wins")))
def terminal_across_lines(m: Market):
    return S.resolve_across_lines(place_lines(m), m.terminals(), 75)


@query("best_of_two_matches", using("captures", """
    SELECT capture_id, CASE WHEN s2>s1 OR s1 IS NULL THEN t2 ELSE t1 END AS id_terminal, CASE WHEN s2>s1 OR s1 IS NULL THEN s2 ELSE s1 END AS score
    FROM (SELECT capture_id, id_terminal AS t1, terminal_match_score AS s1 FROM captures WHERE id_terminal IS NOT NULL)
    FULL JOIN (SELECT capture_id, capture_id%100 AS t2, 70.0+(capture_id*3)%31 AS s2 FROM captures WHERE capture_id%4<>1) USING (capture_id)"""))
def best_of_two_matches(m: Market):
    k = F.col("capture_id")
    banner = m.captures().filter("id_terminal is not null").select(
        "capture_id", "id_terminal", F.col("terminal_match_score").alias("score")
    )
    header = m.captures().filter(k % 4 != 1).select(
        "capture_id", (k % 100).alias("id_terminal"), (70.0 + (k * 3) % 31).alias("score")
    )
    return S.best_match(banner, header, "capture_id")


_SIM = {
    "lt": """SELECT DISTINCT token FROM places WHERE token<>'' UNION SELECT DISTINCT split_part(upper(p_name),' ',1) FROM part""",
    "rv": """SELECT DISTINCT upper(p_name)||' DEPOT' AS value FROM part UNION SELECT DISTINCT split_part(upper(p_name),' ',1) FROM part""",
}


@query("similar_names", using("terminals", f"""
    SELECT token, value, score FROM (SELECT *, {Q.weighted('token', 'value')} AS score FROM lt, rv) WHERE score>=70""",
    {"places": PLACE_VIEWS["places"]} | _SIM))
def similar_names(m: Market):
    """Misread places and short names against depot names and short names."""
    full = m.table("part").select(F.upper("p_name").alias("n"))
    short = full.select(F.split_part("n", F.lit(" "), F.lit(1)).alias("value"))
    names = full.select(F.concat("n", F.lit(" DEPOT")).alias("value")).union(short)
    tokens = noisy_places(m).select("token").union(short.select(F.col("value").alias("token")))
    return S.similarity_join(tokens, names, min_score=70)


_SEARCH_CASE = {
    "asked": """SELECT c_custkey AS query_id, CASE c_custkey%6 WHEN 0 THEN lower(t.name) WHEN 1 THEN 'depot hub '||(c_custkey%20)
        WHEN 2 THEN 'x' WHEN 3 THEN t.planet_name||' - ('||coalesce(t.star_system_name,'')||')'
        WHEN 4 THEN split_part(t.name,' ',2)||'/'||split_part(t.name,' ',1) ELSE 'nowhere '||t.name END AS query
        FROM customer JOIN terminals t ON c_custkey%(SELECT max(id)+1 FROM terminals)=t.id""",
    "parts": """SELECT query_id, query, list_filter(regexp_split_to_array(upper(trim(query)), '[ \\t·/\\\\|\\-–—,()\\[\\]]+'), lambda p: length(p)>=2) AS parts FROM asked""",
    "hay": """SELECT id, rich_label AS label, upper(concat_ws(chr(1),displayname,name,nickname,code,space_station_name,outpost_name,
        city_name,planet_name,star_system_name)) AS hay FROM labelled""",
    "hits": """SELECT *, count(*) OVER (PARTITION BY query_id) AS n_candidates, row_number() OVER (PARTITION BY query_id ORDER BY label, id) AS rank
        FROM parts, hay WHERE len(list_filter(parts, lambda p: NOT contains(hay,p)))=0""",
}


@query("terminal_search", using("terminals", """
    SELECT query_id, rank, id, label, n_candidates, n_candidates=1 AND length(trim(query))>=3 AS is_resolved FROM hits WHERE rank<=50""", LABEL_VIEWS | _SEARCH_CASE))
def terminal_search(m: Market):
    k = F.col("c_custkey")
    t = m.terminals().select("id", "name", "planet_name", "star_system_name")
    word = lambda i: F.split_part("name", F.lit(" "), F.lit(i))
    text = (
        F.when(k % 6 == 0, F.lower("name"))
        .when(k % 6 == 1, F.concat(F.lit("depot hub "), (k % 20).cast("string")))
        .when(k % 6 == 2, F.lit("x"))
        .when(k % 6 == 3, F.concat("planet_name", F.lit(" - ("), F.coalesce("star_system_name", F.lit("")), F.lit(")")))
        .when(k % 6 == 4, F.concat(word(2), F.lit("/"), word(1)))
        .otherwise(F.concat(F.lit("nowhere "), F.col("name")))
    )
    asked = spread_over(m.table("customer"), "c_custkey", t).select(k.alias("query_id"), text.alias("query"))
    return S.search_terminals(asked, m.terminals())
