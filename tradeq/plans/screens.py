"""Queries that turn screen text into price rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeq.operators import extract as X
from tradeq.plans import scorers as Q
from tradeq.plans.registry import query
from tradeq.plans.resolve import commodity_match_views
from tradeq.plans.views import using
from tradeq.session import settle
from tradeq.sources.market import Market


def _count(c: str, keep: str) -> str:
    return f"length(regexp_replace({c},'[^{keep}]','','g'))"


def repair_sql(c: str) -> str:
    plain = f"translate(t,'{X.MISREAD}','')"
    numeric = (
        f"length(t)>=2 AND {_count('t', chr(92) + 'p{Nd}')}>=1 AND {_count(plain, chr(92) + 'p{L}')}<=1 "
        f"AND ({_count('t', chr(92) + 'p{Nd}')}+length(t)-length({plain}))/CAST(length(t) AS DOUBLE)>=0.7"
    )
    return (
        f"array_to_string(list_transform(string_split({c},' '), lambda t: CASE WHEN {numeric} "
        f"THEN translate(t,'{X.MISREAD}','{X.MEANT}') ELSE t END),' ')"
    )


def candidate_sql(c: str) -> str:
    letters, upper = _count(c, r"\p{L}"), _count(c, r"\p{Lu}")
    firsts = f"list_filter(list_transform(string_split({c},' '), lambda w: regexp_extract(w,'(\\p{{L}})',1)), lambda f: f<>'')"
    title = f"len({firsts})>0 AND len(list_filter({firsts}, lambda f: NOT regexp_matches(f,'^\\p{{Lu}}$')))=0"
    solid = f"length(regexp_replace({c},'\\s','','g'))"
    return (
        f"(length({c})>=3 AND {letters}>=3 AND ({upper}>={letters}*0.6 OR ({title}) OR ({letters}>=5 AND {upper}>=1 "
        f"AND {letters}/CAST({solid} AS DOUBLE)>=0.8)))"
    )


def scu_sql(c: str) -> str:
    return f"TRY_CAST(translate(regexp_extract({c},'{X.SCU_PATTERN}',1),',.','') AS INT)"


def price_sql(c: str) -> str:
    number = f"regexp_extract({c},'{X.PRICE_PATTERN}',1)"
    unit = f"upper(regexp_extract({c},'{X.PRICE_PATTERN}',2))"
    dotted = f"replace({number},',','.')"
    scaled = f"TRY_CAST(split_part({dotted},'.',1)||'.'||replace(regexp_replace({dotted},'^[^.]*\\.?',''),'.','') AS DOUBLE)"
    return (
        f"CASE {unit} WHEN 'K' THEN {scaled}*1e3 WHEN 'M' THEN {scaled}*1e6 "
        f"ELSE TRY_CAST(translate({number},',.','') AS DOUBLE) END"
    )


_STRICT = "CASE " + " ".join(f"WHEN regexp_matches(line,'{p}') THEN {code}" for p, code in X.STATUS_PATTERNS) + " END"
_SUFFIX = rf"\b{X.INVENTORY_SUFFIX}\b"

FEATURE_VIEWS = {
    "texts": f"SELECT text, {repair_sql('text')} AS line FROM (SELECT DISTINCT text FROM screen_lines)",
    "ui_labels": f"""SELECT DISTINCT token FROM (SELECT upper(trim(text)) AS token FROM texts UNION SELECT upper(trim(line)) FROM texts),
        (SELECT unnest({Q.strings(X.STOP_WORDS)}) AS label) WHERE token='' OR {Q.weighted('token', 'label')}>=80""",
    "mods": "SELECT * FROM (VALUES " + ",".join(f"({i},'{w}',{c})" for i, (w, c) in enumerate(X.STATUS_WORDS)) + ") AS t(ord,word,code)",
    "prefixes": f"""SELECT DISTINCT line, upper(trim(regexp_extract(line,'(?is)^(.*?){_SUFFIX}',1))) AS prefix FROM texts
        WHERE regexp_matches(line,'(?i){_SUFFIX}')""",
    "fuzzy_status": f"""SELECT line, code FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY score DESC, ord) AS rn FROM (
        SELECT *, {Q.partial('prefix', 'word')} AS score FROM prefixes, mods WHERE length(prefix) BETWEEN 2 AND 24)) WHERE rn=1 AND score>=75""",
    "statuses": f"""SELECT t.text, coalesce({_STRICT.replace('(line', '(t.line')},
        CASE WHEN length(upper(trim(t.line))) BETWEEN 10 AND 20 AND regexp_matches(upper(trim(t.line)),'{X.STOCK_PATTERN}')
             AND {Q.weighted('upper(trim(t.line))', "'OUT OF STOCK'")}>=70 THEN 1 END, f.code) AS status
        FROM texts t LEFT JOIN fuzzy_status f ON t.line=f.line""",
    "features": f"""SELECT *, CASE kind WHEN 'SCU' THEN {scu_sql('line')} WHEN 'ZERO' THEN 0 END AS scu,
        CASE kind WHEN 'PRICE' THEN {price_sql('line')} END AS price FROM (
        SELECT text, line, CASE WHEN regexp_matches(line,'{X.SCU_PATTERN}') AND {_count('line', chr(92) + 'p{Nd}')}>=1
              AND {_count('line', chr(92) + 'p{Nd}')}>=length(line)*0.3 THEN 'SCU'
            WHEN regexp_matches(trim(line),'{X.ZERO_SCU_PATTERN}') THEN 'ZERO'
            WHEN regexp_matches(line,'{X.PRICE_PATTERN}') THEN 'PRICE'
            WHEN {candidate_sql('line')} AND upper(trim(line)) NOT IN (SELECT token FROM ui_labels) THEN 'NAME' ELSE 'OTHER' END AS kind,
          NOT regexp_matches(text,'{X.SCU_PATTERN}') AND NOT regexp_matches(text,'{X.PRICE_PATTERN}') AND {candidate_sql('text')}
            AND upper(trim(text)) NOT IN (SELECT token FROM ui_labels) AS may_follow, status
        FROM texts JOIN statuses USING (text))""",
}

CLASS_VIEWS = FEATURE_VIEWS | {
    "named": """SELECT l.capture_id, l.line_no, f.*, CASE WHEN may_follow THEN {'no':l.line_no,'t':f.text} END AS fol
        FROM screen_lines l JOIN features f ON l.text=f.text""",
    "ahead": """SELECT *, coalesce(lead(fol,1) OVER w, lead(fol,2) OVER w, lead(fol,3) OVER w, lead(fol,4) OVER w) AS nxt
        FROM named WINDOW w AS (PARTITION BY capture_id ORDER BY line_no)""",
    "joins": """SELECT *, CASE WHEN kind='NAME' AND nxt IS NOT NULL THEN line||' '||nxt.t END AS joined FROM ahead""",
    "jtoks": f"""SELECT DISTINCT token FROM (SELECT DISTINCT upper(trim(joined)) AS token FROM joins WHERE joined IS NOT NULL) j
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest({Q.strings(X.STOP_WORDS)}) AS label) WHERE {Q.weighted('j.token', 'label')}>=80)""",
} | commodity_match_views("SELECT upper(trim(line)) AS token FROM joins WHERE kind='NAME' UNION ALL SELECT token FROM jtoks", 75) | {
    "picked": """SELECT j.*, o.matched_id AS o_id, o.score AS o_score, t.matched_id AS t_id, t.score AS t_score,
        coalesce(t.score IS NOT NULL AND (o.score IS NULL OR t.score>=o.score+5 OR (o.score<95 AND t.score>=o.score)),false) AS used
        FROM joins j LEFT JOIN cmatch o ON j.kind='NAME' AND upper(trim(j.line))=o.token
        LEFT JOIN (SELECT * FROM cmatch WHERE token IN (SELECT token FROM jtoks)) t ON upper(trim(j.joined))=t.token""",
    "classed": """SELECT capture_id, line_no, CASE WHEN kind IN ('SCU','ZERO') THEN 'SCU' WHEN kind='PRICE' THEN 'PRICE'
          WHEN used OR o_id IS NOT NULL THEN 'COMMODITY'
          WHEN (capture_id,line_no) IN (SELECT (capture_id,nxt.no) FROM picked WHERE used) THEN 'SKIP' ELSE 'OTHER' END AS kind,
        CASE WHEN used THEN joined ELSE line END AS raw_line, CASE WHEN used THEN t_id ELSE o_id END AS id_commodity,
        CASE WHEN used THEN t_score ELSE o_score END AS match_score, scu, price, status AS raw_status FROM picked""",
    "classified": """SELECT * EXCLUDE (raw_line, raw_status), CASE WHEN kind='SKIP' THEN '' ELSE raw_line END AS line,
        CASE WHEN kind NOT IN ('SKIP','COMMODITY') THEN raw_status END AS status FROM classed""",
}

ROW_VIEWS = CLASS_VIEWS | {
    "segs": """SELECT *, sum(CAST(kind='COMMODITY' AS INT)) OVER (PARTITION BY capture_id ORDER BY line_no) AS seg FROM classified""",
    "assembled": """SELECT capture_id, CAST(seg AS BIGINT)-1 AS row_index, arg_min(id_commodity,line_no) FILTER (WHERE kind='COMMODITY') AS id_commodity,
        arg_min(match_score,line_no) FILTER (WHERE kind='COMMODITY') AS match_score,
        arg_min(scu,line_no) FILTER (WHERE kind='SCU' AND scu IS NOT NULL) AS scu,
        arg_min(price,line_no) FILTER (WHERE kind='PRICE' AND price IS NOT NULL) AS price FROM segs WHERE seg>0 GROUP BY 1,2""",
    "deduped": """SELECT capture_id, id_commodity, first_index AS row_index, match_score, scu, price FROM (
        SELECT *, min(row_index) OVER (PARTITION BY capture_id,id_commodity) AS first_index,
          row_number() OVER (PARTITION BY capture_id,id_commodity ORDER BY CAST(scu IS NOT NULL AS INT)+CAST(price IS NOT NULL AS INT) DESC,
            match_score DESC, row_index) AS rn FROM assembled) WHERE rn=1""",
    "fresh": """SELECT * FROM (SELECT *, kind='COMMODITY' AND line_no=min(line_no) OVER (PARTITION BY capture_id,id_commodity,kind) AS is_new FROM classified)
        WHERE kind<>'COMMODITY' OR is_new""",
    "stretches": """SELECT *, sum(CAST(is_new AS INT)) OVER (PARTITION BY capture_id ORDER BY line_no) AS st, starts_with(line,'--- ROW ') AS mk,
        status IS NOT NULL AND NOT starts_with(line,'--- ROW ') AND kind<>'COMMODITY' AS told FROM fresh""",
    "sums": """SELECT capture_id, st, max(id_commodity) AS id_commodity, min(line_no) FILTER (WHERE mk) AS m0, max(line_no) FILTER (WHERE mk) AS m1,
        count(*) FILTER (WHERE told) AS n, min(line_no) FILTER (WHERE told) AS h, arg_min(status,line_no) FILTER (WHERE told) AS hs,
        max(line_no) FILTER (WHERE told) AS t, arg_max(status,line_no) FILTER (WHERE told) AS ts FROM stretches GROUP BY 1,2""",
    "final_status": """SELECT capture_id, id_commodity, coalesce(direct, carried, 0) AS status FROM (
        SELECT *, lag(pending) OVER (PARTITION BY capture_id ORDER BY st) AS carried FROM (
          SELECT *, CASE WHEN st>0 AND (m0 IS NULL OR h<m0) THEN hs END AS direct,
            CASE WHEN m0 IS NOT NULL THEN CASE WHEN t>m1 THEN ts END WHEN st=0 OR n>=2 THEN ts END AS pending FROM sums)) WHERE st>0""",
    "told_rows": "SELECT d.*, coalesce(f.status,0) AS status FROM deduped d LEFT JOIN final_status f USING (capture_id, id_commodity)",
}


@query("numeric_repair", using("document_lines screen_lines", f"""
    SELECT source, capture_id, line_no, line FROM (SELECT *, {repair_sql('text')} AS line FROM (
      SELECT 'document' AS source, capture_id, line_no, text FROM document_lines
      UNION ALL SELECT 'screen', capture_id, line_no, text FROM screen_lines)) WHERE line<>text"""))
def numeric_repair(m: Market):
    """Repaired lines of whole documents and screens."""
    columns = ["source", "capture_id", "line_no", "text"]
    both = m.document_lines().withColumn("source", F.lit("document")).select(*columns).union(
        m.screen_lines().withColumn("source", F.lit("screen")).select(*columns)
    )
    lines = both.withColumn("line", X.repair_numeric(F.col("text")))
    return lines.filter("line <> text").select("source", "capture_id", "line_no", "line")


@query("parsed_numbers", using("screen_lines", f"""
    SELECT text, CASE WHEN regexp_matches(line,'{X.SCU_PATTERN}') THEN {scu_sql('line')} END AS scu,
      CASE WHEN regexp_matches(line,'{X.PRICE_PATTERN}') THEN {price_sql('line')} END AS price
    FROM (SELECT DISTINCT text, {repair_sql('text')} AS line FROM screen_lines)"""))
def parsed_numbers(m: Market):
    return X.parse_numbers(m.screen_lines().select("text").distinct())


@query("status_labels", using("screen_lines", "SELECT text, status FROM statuses", FEATURE_VIEWS))
def status_labels(m: Market):
    return X.line_features(m.screen_lines()).select("text", "status")


@query("line_classes", using("screen_lines commodities", """
    SELECT capture_id, line_no, kind, line, id_commodity, match_score, scu, round(price,4) AS price, status FROM classified""", CLASS_VIEWS))
def line_classes(m: Market):
    return X.classify_lines(m.screen_lines(), m.commodities()).withColumn("price", F.round("price", 4))


@query("joined_names", using("screen_lines commodities", """
    SELECT capture_id, line_no, joined, t_id AS id_commodity, t_score AS match_score FROM picked WHERE used""", CLASS_VIEWS))
def joined_names(m: Market):
    lines = settle(m.screen_lines(), "lines")
    return X.resolve_line_names(lines, X.line_features(lines), m.commodities()).filter("used_partner").select(
        "capture_id", "line_no", "joined", F.col("m.id").alias("id_commodity"), F.col("m.score").alias("match_score")
    )


@query("assembled_rows", using("screen_lines commodities", """
    SELECT capture_id, row_index, id_commodity, match_score, scu, round(price,4) AS price FROM assembled""", ROW_VIEWS))
def assembled_rows(m: Market):
    rows = X.assemble_rows(X.classify_lines(m.screen_lines(), m.commodities()))
    return rows.withColumn("price", F.round("price", 4))


@query("deduped_rows", using("screen_lines commodities", """
    SELECT capture_id, row_index, id_commodity, match_score, scu, round(price,4) AS price FROM deduped""", ROW_VIEWS))
def deduped_rows(m: Market):
    rows = X.dedupe_rows(X.assemble_rows(X.classify_lines(m.screen_lines(), m.commodities())))
    return rows.withColumn("price", F.round("price", 4))


@query("carried_status", using("screen_lines commodities", "SELECT * FROM final_status", ROW_VIEWS))
def carried_status(m: Market):
    return X.commodity_status(X.classify_lines(m.screen_lines(), m.commodities()))


@query("extracted_rows", using("screen_lines commodities", """
    SELECT capture_id, row_index, id_commodity, match_score, round(price,4) AS price,
      CASE WHEN status=1 AND scu IS NULL THEN 0 ELSE scu END AS scu, CASE WHEN scu=0 AND status=0 THEN 1 ELSE status END AS status
    FROM told_rows""", ROW_VIEWS))
def extracted_rows(m: Market):
    """Screen text of every capture to reconciled price rows."""
    return X.extract_rows(m.screen_lines(), m.commodities()).withColumn("price", F.round("price", 4))


@query("stock_inference", using("capture_rows", """
    SELECT capture_id, row_index, CASE WHEN status=1 AND scu IS NULL THEN 0 ELSE scu END AS scu,
      CASE WHEN scu=0 AND status=0 THEN 1 ELSE status END AS status FROM capture_rows"""))
def stock_inference(m: Market):
    return X.infer_out_of_stock(m.capture_rows()).select("capture_id", "row_index", "scu", "status")


@query("retry_merge", using("capture_rows", """
    SELECT f.capture_id, f.row_index, f.id_commodity, CASE WHEN f.status=0 AND r.status IS NOT NULL THEN coalesce(f.scu,r.scu) ELSE f.scu END AS scu,
      CASE WHEN f.status=0 AND r.status IS NOT NULL THEN r.status ELSE f.status END AS status
    FROM capture_rows f LEFT JOIN (SELECT capture_id, id_commodity, arg_min(st,row_index) AS status, arg_min(sc,row_index) AS scu FROM (
        SELECT capture_id, id_commodity, row_index, 1+row_index%7 AS st, 5+row_index AS sc FROM capture_rows WHERE row_index%2=0 AND id_commodity IS NOT NULL)
      GROUP BY 1,2) r ON f.capture_id=r.capture_id AND f.id_commodity=r.id_commodity"""))
def retry_merge(m: Market):
    first = m.capture_rows()
    i = F.col("row_index")
    retry = first.filter(i % 2 == 0).select(
        "capture_id", "id_commodity", "row_index", (1 + i % 7).alias("status"), (5 + i).alias("scu")
    )
    return X.merge_retry(first, retry).select("capture_id", "row_index", "id_commodity", "scu", "status")


# ---- sizes, tabs, layout, names ------------------------------------------------


def _greedy() -> str:
    rest, found = "digs", []
    for s in X.CONTAINER_SIZES:
        found.append(f"CASE WHEN starts_with({rest},'{s}') THEN {s} END")
        rest = f"(CASE WHEN starts_with({rest},'{s}') THEN substr({rest},{len(str(s)) + 1}) ELSE {rest} END)"
    return "[" + ",".join(found) + "]"


SIZE_VIEWS = {
    "size_texts": f"""SELECT text, digs, ({Q.partial('upper(text)', "'AVAILABLE CARGO SIZE'")}>=75 OR {Q.partial('upper(text)', "'CARGO SIZE'")}>=90) AS is_label,
        list_filter({_greedy()}, lambda s: s IS NOT NULL) AS sizes
        FROM (SELECT DISTINCT text, regexp_replace(text,'[^\\p{{Nd}}]','','g') AS digs FROM screen_lines)""",
    "size_lines": """SELECT capture_id, line_no, sizes FROM (SELECT l.capture_id, l.line_no, digs, sizes,
        max(CAST(is_label AS INT)) OVER (PARTITION BY capture_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS near
        FROM screen_lines l JOIN size_texts s ON l.text=s.text) WHERE near=1 AND length(digs)>=2 AND len(sizes)>=2""",
}


@query("size_lines", using("screen_lines", "SELECT capture_id, line_no, array_to_string(sizes,',') AS sizes FROM size_lines", SIZE_VIEWS))
def size_lines(m: Market):
    return X.extract_sizes(settle(m.screen_lines(), "lines")).withColumn(
        "sizes", F.array_join(F.transform("sizes", lambda s: s.cast("string")), ",")
    )


@query("container_union", using("screen_lines", """
    SELECT capture_id, (SELECT array_to_string(list_sort(list_distinct(flatten(list(sizes)))),',') FROM size_lines s WHERE s.capture_id=c.capture_id)
      AS container_sizes FROM (SELECT DISTINCT capture_id FROM screen_lines) c""", SIZE_VIEWS))
def container_union(m: Market):
    lines = settle(m.screen_lines(), "lines")
    return X.container_union(X.extract_sizes(lines), lines)


_TABS = {
    "tab_texts": f"""SELECT text, {Q.weighted('token', "'LOCAL MARKET VALUE'")}>=80 AS is_value, {Q.weighted('token', "'BUY'")}>=80 AS is_buy,
        {Q.weighted('token', "'BUY'")}>=90 AND length(token)<=5 AS sure FROM (SELECT DISTINCT text, upper(trim(text)) AS token FROM screen_lines)""",
    "tab_lines": """SELECT capture_id, line_no, CASE WHEN is_value THEN CASE WHEN coalesce(lag(is_buy) OVER w,false) THEN 'BUY' ELSE 'SELL' END
        WHEN sure THEN 'BUY' END AS said FROM screen_lines l JOIN tab_texts t ON l.text=t.text WINDOW w AS (PARTITION BY capture_id ORDER BY line_no)""",
}


@query("detected_tabs", using("screen_lines", """
    SELECT capture_id, coalesce(arg_min(said,line_no) FILTER (WHERE said IS NOT NULL),'BUY') AS tab FROM tab_lines GROUP BY 1""", _TABS))
def detected_tabs(m: Market):
    return X.detect_tab(settle(m.screen_lines(), "lines"))


_SAMPLES = """SELECT o_orderkey AS capture_id, CAST(o_orderkey*7%60 AS DOUBLE) AS buy_saturation, CAST(o_custkey*11%60 AS DOUBLE) AS sell_saturation,
    CAST(o_orderkey*13%180 AS DOUBLE) AS buy_hue, CAST(o_custkey*17%180 AS DOUBLE) AS sell_hue, o_orderkey*3%100/128.0::DOUBLE AS buy_ratio,
    o_custkey*5%100/128.0::DOUBLE AS sell_ratio, CAST(o_orderkey*19%256 AS DOUBLE) AS buy_value, CAST(o_custkey*23%256 AS DOUBLE) AS sell_value FROM orders"""
MEASURED_VIEWS = {
    "samples": _SAMPLES,
    "coloured": """SELECT *, CASE WHEN greatest(buy_saturation,sell_saturation)<25 THEN 'UNKNOWN' WHEN h<=10 OR h>=170 THEN 'RED' WHEN h<=25 THEN 'AMBER'
        WHEN h<=40 THEN 'YELLOW' WHEN h<=80 THEN 'GREEN' WHEN h<=100 THEN 'TEAL' WHEN h<=130 THEN 'BLUE' ELSE 'PURPLE' END AS palette
        FROM (SELECT *, CASE WHEN buy_saturation>=sell_saturation THEN buy_hue ELSE sell_hue END AS h FROM samples)""",
    "tabbed": """SELECT *, CASE WHEN greatest(buy_saturation,sell_saturation)>=25 AND abs(buy_saturation-sell_saturation)>=12
          THEN CASE WHEN buy_saturation>sell_saturation THEN 'BUY' ELSE 'SELL' END
        WHEN palette='RED' AND greatest(buy_ratio,sell_ratio)>=0.35 AND abs(buy_ratio-sell_ratio)>=0.15
          THEN CASE WHEN buy_ratio>sell_ratio THEN 'BUY' ELSE 'SELL' END
        WHEN palette<>'RED' AND greatest(buy_value,sell_value)>=140 AND abs(buy_value-sell_value)>=20
          THEN CASE WHEN buy_value>sell_value THEN 'BUY' ELSE 'SELL' END ELSE 'UNKNOWN' END AS tab FROM coloured""",
}


@query("measured_tabs", using([], """
    SELECT capture_id, palette, tab, CASE WHEN tab='UNKNOWN' THEN CASE WHEN greatest(buy_saturation,sell_saturation)<25 THEN 'both-grey'
      ELSE 'low-margin' END END AS reason FROM tabbed""", MEASURED_VIEWS))
def measured_tabs(m: Market):
    return X.decide_tab(tab_samples(m)).select("capture_id", "palette", "tab", "reason")


def tab_samples(m: Market) -> DataFrame:
    """Two measured labels per capture, by rule."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return m.table("orders").select(
        k.alias("capture_id"),
        (k * 7 % 60).cast("double").alias("buy_saturation"),
        (c * 11 % 60).cast("double").alias("sell_saturation"),
        (k * 13 % 180).cast("double").alias("buy_hue"),
        (c * 17 % 180).cast("double").alias("sell_hue"),
        (k * 3 % 100 / 128.0).alias("buy_ratio"),
        (c * 5 % 100 / 128.0).alias("sell_ratio"),
        (k * 19 % 256).cast("double").alias("buy_value"),
        (c * 23 % 256).cast("double").alias("sell_value"),
    )


def screen_regions(m: Market) -> DataFrame:
    """Three text regions per lineitem on a slightly uneven grid."""
    k, i = F.col("l_orderkey"), F.col("row_index")
    wobble = lambda n: ((k * n + i * 5) % 9).cast("double")
    cell = lambda n, left, text: F.struct(
        text.alias("text"),
        (i * 24 + wobble(n)).alias("center_y"),
        (left + F.lit(40.0) + n).alias("center_x"),
        (F.lit(left) + (k * n) % 20).cast("int").alias("left"),
        (F.lit(left) + 80 + (k + i) % 15).cast("int").alias("right"),
        (14 + (k + i + n) % 8).cast("int").alias("height"),
    )
    cells = F.array(
        cell(1, 0, F.concat(F.lit("P"), F.col("l_partkey").cast("string"))),
        cell(2, 100, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" SCU"))),
        cell(3, 215, F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" "))),
    )
    return m.order_rows().select(k.alias("capture_id"), F.inline(cells))


_REGION = {
    "cells": " UNION ALL ".join(
        f"""SELECT l_orderkey AS capture_id, {text} AS text, row_index*24.0::DOUBLE + (l_orderkey*{n}+row_index*5)%9 AS cy, {left}+40.0::DOUBLE+{n} AS cx,
            {left}+(l_orderkey*{n})%20 AS lft, {left}+80+(l_orderkey+row_index)%15 AS rgt, 14+(l_orderkey+row_index+{n})%8 AS h FROM order_rows"""
        for n, left, text in ((1, 0, "'P'||l_partkey"), (2, 100, "CAST(l_quantity AS INT)||' SCU'"), (3, 215, "l_returnflag"))
    ),
    "heights": """SELECT capture_id, greatest(8, list_sort(list(h))[CAST(floor(count(*)/2) AS INT)+1]) AS mh FROM cells GROUP BY 1""",
    "ordered": """SELECT c.*, mh, row_number() OVER (PARTITION BY c.capture_id ORDER BY cy, cx, lft) AS k FROM cells c JOIN heights USING (capture_id)""",
    "walk": """SELECT capture_id, k, cy, cx, lft, rgt, text, mh, cy AS total, 1 AS n, 0 AS r FROM ordered WHERE k=1
        UNION ALL
        SELECT o.capture_id, o.k, o.cy, o.cx, o.lft, o.rgt, o.text, o.mh,
          CASE WHEN abs(o.cy-w.total/w.n)<=o.mh*0.6::DOUBLE THEN w.total+o.cy ELSE o.cy END,
          CASE WHEN abs(o.cy-w.total/w.n)<=o.mh*0.6::DOUBLE THEN w.n+1 ELSE 1 END,
          CASE WHEN abs(o.cy-w.total/w.n)<=o.mh*0.6::DOUBLE THEN w.r ELSE w.r+1 END
        FROM walk w JOIN ordered o ON o.capture_id=w.capture_id AND o.k=w.k+1""",
    "cuts": """SELECT *, CASE WHEN lft-lag(rgt) OVER w > mh*1.2::DOUBLE THEN 1 ELSE 0 END AS cut, row_number() OVER w AS nth FROM walk
        WINDOW w AS (PARTITION BY capture_id, r ORDER BY cx, lft, cy)""",
    "pieces": "SELECT *, sum(cut) OVER (PARTITION BY capture_id, r ORDER BY nth) AS piece FROM cuts",
    "joined": "SELECT capture_id, r, piece, string_agg(text,' ' ORDER BY nth) AS text FROM pieces GROUP BY 1,2,3",
}


@query("region_lines", using("order_rows", """
    SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY r, piece)-1 AS line_no, text FROM joined""", _REGION).replace("WITH ", "WITH RECURSIVE ", 1))
def region_lines(m: Market):
    return X.regions_to_lines(screen_regions(m))


@query("capture_times", """
    SELECT event_id, CASE WHEN event_id%6=5 THEN 'photo '||(event_id%10) ELSE strftime(ts,'%Y-%m-%d %H:%M:%S') END AS shown FROM events""")
def capture_times(m: Market):
    i = F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd_HH-mm-ss")
    name = (
        F.when(i % 6 == 5, F.concat(F.lit("photo "), (i % 10).cast("string"), F.lit(".bmp")))
        .when(i % 6 == 4, F.concat(F.lit("/in/screenshot-"), stamp, F.lit("-8AF.jpg")))
        .when(i % 6 == 3, F.concat(F.lit("ScreenShot-"), stamp, F.lit("-DB6C.jpg")))
        .otherwise(F.concat(F.lit("ScreenShot-"), stamp, F.lit(".png")))
    )
    return m.table("events").select("event_id", X.capture_time(name).alias("shown"))
