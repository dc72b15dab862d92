"""Queries that settle tab and terminal of captures after reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeq.operators import captures as K
from tradeq.operators import extract as X
from tradeq.operators import quality as Q
from tradeq.plans.prices import LABEL_VIEWS
from tradeq.plans.registry import query
from tradeq.plans.screens import MEASURED_VIEWS, tab_samples
from tradeq.plans.views import using
from tradeq.sources.market import Market

_HEAD_FLAG = """CASE WHEN {t} IS NULL THEN 'terminal_not_detected'
    WHEN {s}<90 THEN 'terminal_match_low_confidence ('||CAST({s} AS INT)||')' END"""


def flagged_captures(m: Market) -> DataFrame:
    """Captures with the flags that reading alone leaves."""
    own = Q.review_flags(m.captures(), m.capture_rows().limit(0)).groupBy("capture_id").agg(F.array_sort(F.collect_list("flag")).alias("needs_review"))
    return m.captures().join(own, "capture_id")


def _flags():
    return F.array_join(F.array_sort("needs_review"), "|").alias("flags")


@query("settled_tabs", using("captures", f"""
    SELECT c.capture_id, coalesce(t.tab,'UNKNOWN') AS tab, array_to_string(list_sort(list_filter([{_HEAD_FLAG.format(t='id_terminal', s='terminal_match_score')},
      CASE WHEN coalesce(t.tab,'UNKNOWN')='UNKNOWN' THEN 'tab_unknown' ELSE 'tab_detected_'||lower(t.tab) END], lambda x: x IS NOT NULL)), '|') AS flags
    FROM captures c LEFT JOIN (SELECT * FROM tabbed WHERE capture_id%5<>0) t ON c.capture_id=t.capture_id""", MEASURED_VIEWS))
def settled_tabs(m: Market):
    """Measured tabs over those told by text; a fifth of the captures was not measured."""
    measured = X.decide_tab(tab_samples(m)).filter("capture_id % 5 <> 0")
    return K.measured_tab(flagged_captures(m), measured).select("capture_id", "tab", _flags())


_MATCHES = {
    "banner": "SELECT capture_id, capture_id%90 AS mid, 'name' AS f, 60.0+capture_id%41 AS s FROM captures WHERE capture_id%4<>0",
    "header": "SELECT capture_id, capture_id%70 AS mid, 'nickname' AS f, 62.0+(capture_id*5)%39 AS s FROM captures WHERE capture_id%3<>0",
    "chosen": """SELECT coalesce(b.capture_id,h.capture_id) AS capture_id,
        CASE WHEN h.s IS NOT NULL AND (b.s IS NULL OR (b.s<90 AND h.s>b.s)) THEN h.mid ELSE b.mid END AS mid,
        CASE WHEN h.s IS NOT NULL AND (b.s IS NULL OR (b.s<90 AND h.s>b.s)) THEN 'left_header:nickname' ELSE 'banner:name' END AS f,
        CASE WHEN h.s IS NOT NULL AND (b.s IS NULL OR (b.s<90 AND h.s>b.s)) THEN h.s ELSE b.s END AS s
        FROM banner b FULL JOIN header h ON b.capture_id=h.capture_id""",
    "judged": """SELECT c.capture_id, c.id_terminal, c.terminal_match_score, c.tab, x.mid, x.f, x.s,
        x.s IS NOT NULL AND (c.id_terminal IS NULL OR x.s>coalesce(c.terminal_match_score,0)) AS better FROM captures c LEFT JOIN chosen x USING (capture_id)""",
}


@query("merged_terminals", using("captures", f"""
    SELECT capture_id, CASE WHEN better THEN mid ELSE id_terminal END AS id_terminal, CASE WHEN better THEN s ELSE terminal_match_score END AS terminal_match_score,
      CASE WHEN better THEN f END AS terminal_matched_field, array_to_string(list_sort(list_filter([CASE WHEN better THEN {_HEAD_FLAG.format(t='mid', s='s')}
        ELSE {_HEAD_FLAG.format(t='id_terminal', s='terminal_match_score')} END, CASE WHEN tab='UNKNOWN' THEN 'tab_unknown' ELSE 'tab_assumed_'||lower(tab) END],
        lambda x: x IS NOT NULL)), '|') AS flags FROM judged""", _MATCHES))
def merged_terminals(m: Market):
    """Banner, then header, over the terminal of the lines."""
    k = F.col("capture_id")

    def match(keep, terminal, field, score):
        return m.captures().filter(keep).select(
            "capture_id", terminal.alias("matched_id"), F.lit(field).alias("matched_field"), F.lit("READ").alias("window"), score.cast("double").alias("score")
        )

    banner = match(k % 4 != 0, k % 90, "name", 60 + k % 41)
    header = match(k % 3 != 0, k % 70, "nickname", 62 + k * 5 % 39)
    merged = K.merge_terminal(flagged_captures(m), K.preferred_terminal(banner, header))
    return merged.select("capture_id", "id_terminal", "terminal_match_score", "terminal_matched_field", _flags())


@query("retry_reasons", using("captures capture_rows", """
    SELECT capture_id, array_to_string(list_filter([CASE WHEN id_terminal IS NULL THEN 'terminal_not_detected' END,
      CASE WHEN n>0 THEN 'status_unknown_x'||n END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM captures LEFT JOIN (SELECT capture_id, count(*) AS n FROM capture_rows WHERE status=0 GROUP BY 1) USING (capture_id)
    WHERE id_terminal IS NULL OR n>0"""))
def retry_reasons(m: Market):
    return K.retry_reasons(m.captures(), m.capture_rows()).select("capture_id", F.array_join("reasons", ",").alias("reasons"))


_TYPED = LABEL_VIEWS | {
    "typed": "SELECT capture_id, CASE capture_id%4 WHEN 0 THEN ' ' WHEN 1 THEN 'depot '||(capture_id%30) WHEN 2 THEN 'planet depot' ELSE 'nowhere' END AS t FROM captures WHERE id_terminal IS NULL",
    "asked": "SELECT DISTINCT t, list_filter(string_split(upper(t),' '), lambda p: length(p)>=2) AS parts FROM typed WHERE trim(t)<>''",
    "hay": """SELECT upper(concat_ws(chr(1),displayname,name,nickname,code,space_station_name,outpost_name,city_name,planet_name,star_system_name)) AS hay FROM labelled""",
    "hits": "SELECT t, count(*) AS n FROM asked, hay WHERE len(list_filter(parts, lambda p: NOT contains(hay,p)))=0 GROUP BY 1",
}


@query("unresolved_terminals", using("captures terminals", """
    SELECT capture_id, 'terminal_unresolved' AS code, coalesce(n,0) AS n_candidates FROM typed LEFT JOIN hits USING (t) WHERE trim(t)<>''""", _TYPED))
def unresolved_terminals(m: Market):
    """Typed names that were not picked, with how many terminals they may mean."""
    k = F.col("capture_id")
    typed = (
        F.when(k % 4 == 0, " ").when(k % 4 == 1, F.concat(F.lit("depot "), (k % 30).cast("string"))).when(k % 4 == 2, "planet depot").otherwise("nowhere")
    )
    found = K.unresolved_terminals(m.captures().withColumn("terminal_text", typed), m.terminals())
    return found.select("capture_id", "code", "n_candidates")
