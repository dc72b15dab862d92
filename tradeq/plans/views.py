"""The domain tables of ``sources.market`` as SQL views for the checks.

``using(names, body)`` puts the needed views, in order, in front of a SELECT.
"""

from __future__ import annotations

from tradeq.sources.market import LOG_NOW, NOW, SAMPLE_API_STATUSES, SAMPLE_STATUS_LINES

EPOCH = "CAST(epoch({}) AS BIGINT)"


def _epoch(c: str) -> str:
    return f"CAST(floor(epoch({c})) AS BIGINT)"


_TITLE = (
    "upper(left(split_part(p_name,' ',1),1))||substr(split_part(p_name,' ',1),2)||' '||"
    "upper(left(split_part(p_name,' ',2),1))||substr(split_part(p_name,' ',2),2)"
)


def _list(values: list[str]) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


VIEWS: dict[str, tuple[list[str], str]] = {
    "observations": ([], f"""
        SELECT l_suppkey AS id_terminal, l_partkey AS id_commodity,
               CASE WHEN l_linestatus='O' THEN 'BUY' ELSE 'SELL' END AS side,
               floor(l_extendedprice*100/l_quantity)/100 AS price, l_quantity AS stock, l_linenumber AS status,
               {_epoch('l_shipdate')} AS ts
        FROM lineitem"""),
    "ranked_obs": (["observations"], """
        SELECT *, row_number() OVER (PARTITION BY id_terminal, id_commodity, side
                 ORDER BY ts DESC, price DESC, stock DESC, status DESC) AS rn
        FROM observations"""),
    "prices_all": (["ranked_obs"], """
        SELECT id_terminal, id_commodity,
               max(price) FILTER (WHERE rn=1 AND side='BUY') AS price_buy,
               max(price) FILTER (WHERE rn=1 AND side='SELL') AS price_sell,
               max(stock) FILTER (WHERE rn=1 AND side='BUY') AS scu_buy,
               max(stock) FILTER (WHERE rn=1 AND side='SELL') AS scu_sell_stock,
               max(status) FILTER (WHERE rn=1 AND side='BUY') AS status_buy,
               max(status) FILTER (WHERE rn=1 AND side='SELL') AS status_sell,
               max(ts) AS date_modified
        FROM ranked_obs GROUP BY 1,2"""),
    "terminals": ([], f"""
        SELECT s_suppkey AS id, ({_TITLE})||' Depot' AS name,
               CASE WHEN s_suppkey%4=0 THEN ' ' WHEN s_suppkey%4=1 THEN ({_TITLE})||' Depot'
                    ELSE 'Hub '||(s_suppkey%20) END AS displayname,
               'T'||s_suppkey AS nickname, upper(p_brand) AS code,
               CASE WHEN s_suppkey%10=9 THEN 'item' WHEN s_suppkey%2=0 THEN 'Commodity' ELSE 'commodity' END AS type,
               CASE WHEN s_suppkey%5=2 THEN 'City '||n_name END AS city_name,
               CASE WHEN s_suppkey%5=3 THEN ({_TITLE})||' Outpost' END AS outpost_name,
               CASE WHEN s_suppkey%5=4 THEN ({_TITLE})||' Gateway ('||r_name||')' END AS space_station_name,
               CASE WHEN s_suppkey%7=0 THEN r_name ELSE n_name END AS planet_name,
               CASE WHEN s_suppkey%11<>0 THEN r_name END AS star_system_name,
               CASE WHEN s_suppkey%3=0 THEN 0 ELSE n_nationkey END AS id_planet,
               s_suppkey%7 AS id_orbit,
               CASE WHEN s_acctbal>-500 THEN 1 ELSE 0 END AS is_visible,
               CASE WHEN s_acctbal>0 THEN 1 ELSE 0 END AS is_available_live,
               n_nationkey AS place,
               CASE WHEN s_suppkey%2=0 THEN 0 ELSE 1 END AS has_loading_dock,
               CASE WHEN (s_suppkey+1)%3=0 THEN 0 ELSE 1 END AS has_freight_elevator,
               CASE WHEN (s_suppkey+2)%4=0 THEN 0 ELSE 1 END AS is_monitored,
               CASE WHEN (s_suppkey+3)%5=0 THEN 0 ELSE 1 END AS is_space_station,
               CASE WHEN (s_suppkey+4)%6=0 THEN 0 ELSE 1 END AS is_on_ground,
               CASE WHEN (s_suppkey+5)%7=0 THEN 0 ELSE 1 END AS has_refuel
        FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
        LEFT JOIN part ON s_suppkey=p_partkey"""),
    "commodities": ([], """
        SELECT p_partkey AS id, p_name AS name, p_brand AS code, p_type AS kind,
               CASE WHEN p_size=13 THEN 0 ELSE 1 END AS is_visible,
               CASE WHEN p_type='PROMO' THEN 1 ELSE 0 END AS is_illegal,
               CASE p_size%4 WHEN 0 THEN '' WHEN 1 THEN '1,2,4' WHEN 2 THEN '8, 16,24,32' ELSE '4,x,8,,-2,4' END
                 AS container_sizes
        FROM part"""),
    "vehicles": ([], """
        SELECT id, name, CASE WHEN id%6=0 THEN 0.0 ELSE size + id/2.0 END AS scu,
               CASE WHEN id%5=0 THEN 0 ELSE 1 END AS is_cargo,
               CASE id%3 WHEN 0 THEN NULL WHEN 1 THEN '1,2' ELSE '16,32,bad' END AS container_sizes
        FROM (SELECT CAST(split_part(p_brand,'#',2) AS INT) AS id, p_brand AS name,
                     CAST(max(p_size) AS DOUBLE) AS size FROM part GROUP BY 1,2)"""),
    "order_rows": ([], """
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                 l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1
                 AS row_index
        FROM lineitem"""),
    "payloads": ([], f"""
        SELECT o_orderkey AS payload_id, CAST(floor(o_custkey/10) AS BIGINT) - 2 AS id_terminal,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Commodity' WHEN '5-LOW' THEN 'item'
                    ELSE 'commodity' END AS type,
               CASE WHEN o_orderkey%7=0 THEN 2 ELSE o_orderkey%2 END AS is_production,
               {_epoch('o_orderdate')} AS sent_at
        FROM orders"""),
    "payload_rows": (["order_rows"], """
        SELECT payload_id, row_index, id_commodity,
               CASE WHEN buys THEN told END AS price_buy, CASE WHEN sells THEN told END AS price_sell,
               CASE WHEN buys THEN scu END AS scu_buy, CASE WHEN sells THEN scu END AS scu_sell,
               CASE WHEN buys THEN status END AS status_buy, CASE WHEN sells THEN status END AS status_sell,
               is_missing
        FROM (SELECT l_orderkey AS payload_id, row_index,
                CASE WHEN l_linenumber=7 AND l_partkey%10=0 THEN l_partkey+10000000
                     WHEN l_linenumber=3 THEN l_partkey%5 ELSE l_partkey END AS id_commodity,
                CASE WHEN l_discount=0.10 THEN floor(l_extendedprice*100/l_quantity)/100*100000
                     WHEN l_discount=0.09 THEN 0.0
                     WHEN l_discount=0.08 THEN -(floor(l_extendedprice*100/l_quantity)/100)
                     ELSE floor(l_extendedprice*100/l_quantity)/100 END AS told,
                CASE WHEN l_tax=0.01 THEN CAST(l_quantity AS INT)*10000
                     WHEN l_tax=0.02 THEN -CAST(l_quantity AS INT) ELSE CAST(l_quantity AS INT) END AS scu,
                CASE WHEN l_linenumber=7 AND l_returnflag='R' THEN 8
                     WHEN l_linenumber=1 AND l_returnflag='R' THEN 0 ELSE l_linenumber END AS status,
                l_linestatus='O' AND l_tax<>0.07 AS buys,
                (l_linestatus='F' OR l_tax=0.08) AND l_tax<>0.07 AS sells,
                CASE WHEN l_discount<0.05 THEN 1 END AS is_missing
              FROM order_rows)"""),
    "submissions": ([], f"""
        SELECT event_id AS id, {_epoch('ts')} AS sent_at, CAST(ts AS DATE) AS dt, user_id AS id_terminal,
               event_type<>'view' AS is_production, value>20 AS ok,
               CASE WHEN value>20 THEN 200 WHEN event_type='error' THEN event_id%4+499
                    WHEN event_type='signup' THEN 429 ELSE 403 END AS http_status,
               CASE WHEN value>20 THEN 'ok'
                    ELSE {_list(SAMPLE_API_STATUSES)}[event_id%{len(SAMPLE_API_STATUSES)}+1] END AS api_status,
               event_id%5 AS attempt,
               CASE WHEN event_id%13=0 THEN ' ' ELSE 'Shot-'||(event_id%500)||'.png' END AS source_image,
               CASE event_id%3 WHEN 1 THEN '["SHOT-'||(event_id%700)||'.PNG","extra-'||(event_id%50)||'.jpg"," "]'
                    WHEN 2 THEN 'not json' END AS source_images,
               CAST(json_extract(props,'$.k') AS INT) AS k
        FROM events"""),
    "submitted_ids": (["submissions"], """
        SELECT id, sent_at, id_terminal, ok, unnest([k, k+1]) AS id_commodity FROM submissions"""),
    "captures": ([], f"""
        SELECT o_orderkey AS capture_id, 'ScreenShot-'||o_orderkey||'.jpg' AS source_image,
               CASE WHEN o_custkey%10<>0 THEN CAST(floor(o_custkey/15) AS BIGINT) END AS id_terminal,
               CASE WHEN o_custkey%10<>0 THEN CAST(70+o_orderkey%31 AS DOUBLE) END AS terminal_match_score,
               o_orderkey%4=0 AS terminal_confirmed,
               CASE WHEN o_orderkey%2=0 THEN 1920 ELSE 1280 END AS width,
               CASE o_orderkey%6 WHEN 0 THEN 800 WHEN 1 THEN 1024 WHEN 2 THEN 0 ELSE 720 END AS height,
               CASE o_orderstatus WHEN 'F' THEN 'BUY' WHEN 'O' THEN 'SELL' ELSE 'UNKNOWN' END AS tab,
               CASE WHEN o_orderkey%8=0 THEN 'PTU' ELSE 'LIVE' END AS branch,
               CASE o_orderkey%9 WHEN 0 THEN ' 4.7.2 ' WHEN 1 THEN ' ' END AS draft_version,
               CASE o_orderkey%10 WHEN 0 THEN true WHEN 1 THEN false END AS draft_is_production,
               {_epoch('o_orderdate')} AS added_at,
               CASE WHEN o_orderkey%5=0 THEN 0 ELSE o_orderkey END AS queue_position,
               'batch-'||(o_custkey%50) AS batch_id,
               CASE o_orderkey%3 WHEN 0 THEN '1,2,4' WHEN 1 THEN ' ' END AS container_sizes
        FROM orders"""),
    "capture_rows": (["order_rows"], """
        SELECT l_orderkey AS capture_id, row_index,
               CASE WHEN NOT (l_linenumber=7 AND l_partkey%3=0) THEN l_partkey%50 END AS id_commodity,
               CASE WHEN l_partkey%11=0 THEN 0.0 ELSE CAST(60+(l_partkey*7)%41 AS DOUBLE) END AS match_score,
               CASE WHEN l_discount=0.1 THEN NULL WHEN l_discount=0.09 THEN 0.0
                    ELSE floor(l_extendedprice*100/l_quantity)/100 END AS price,
               CASE WHEN l_tax=0.08 THEN NULL WHEN l_tax=0.07 THEN 0 ELSE CAST(l_quantity AS INT) END AS scu,
               CASE WHEN l_returnflag='N' THEN 0 ELSE l_linenumber END AS status
        FROM order_rows"""),
    "screen_lines": (["order_rows"], f"""
        SELECT capture_id, row_index*20 + pos AS line_no, text FROM (
          SELECT capture_id, row_index, unnest(lines) AS text, generate_subscripts(lines,1)-1 AS pos FROM (
            SELECT l_orderkey AS capture_id, row_index,
              list_concat(
                CASE WHEN row_index<>0 THEN [] WHEN l_orderkey%3=0 THEN ['SHOP INVENTORY','BUY']
                     WHEN l_orderkey%3=1 THEN ['LOCAL MARKET VALUE','IN STOCK'] ELSE ['BUY','LOCAL MARKET VALUE'] END,
                CASE WHEN l_orderkey%5=0 THEN ['--- ROW ---'] ELSE [] END,
                CASE WHEN l_orderkey%4=0 THEN [{_list(SAMPLE_STATUS_LINES)}[l_linenumber]] ELSE [] END,
                CASE l_partkey%6 WHEN 0 THEN [upper(p_name)] WHEN 1 THEN [{_TITLE}]
                     WHEN 2 THEN [translate(upper(p_name),'O','0')] WHEN 3 THEN [translate(upper(p_name),'I','1')]
                     WHEN 4 THEN [split_part(upper(p_name),' ',1), split_part(upper(p_name),' ',2)]
                     ELSE [upper(p_name)||'X'] END,
                CASE WHEN l_orderkey%4=0 THEN [] ELSE [{_list(SAMPLE_STATUS_LINES)}[l_linenumber]] END,
                ['SHOP QUANTITY',
                 CASE WHEN l_returnflag='A' THEN CAST(l_quantity AS INT)||' SCU'
                      WHEN l_returnflag='R' THEN CAST(l_quantity AS INT)||',300 SCU'
                      WHEN l_linenumber>=6 THEN 'OSCU' ELSE CAST(l_quantity AS INT)||'O SCU' END,
                 CASE WHEN l_linestatus='F' THEN CAST(l_quantity AS INT)||'.5K/SCU'
                      ELSE CAST(floor(floor(l_extendedprice*100/l_quantity)/100) AS BIGINT)||'/SCU' END],
                CASE WHEN l_orderkey%3=0 THEN ['AVAILABLE CARGO SIZE (SCU)',
                     CASE WHEN l_linenumber%2=0 THEN '1 2 4 8 16' ELSE '8 16 24 32' END] ELSE [] END
              ) AS lines
            FROM order_rows JOIN part ON l_partkey=p_partkey))"""),
    "document_lines": ([], """
        SELECT capture_id, line_no, trim(raw, ' '||chr(9)||chr(13)||chr(10)||chr(160)) AS text FROM (
          SELECT doc_id AS capture_id, unnest(parts) AS raw, generate_subscripts(parts,1)-1 AS line_no
          FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
        WHERE trim(raw, ' '||chr(9)||chr(13)||chr(10)||chr(160)) <> ''"""),
    "targets": (["prices_all"], f"""
        SELECT id_terminal, id_commodity, side, last_price, days_stale,
               greatest(1,days_stale) * (1.0+log10(1.0+greatest(0.0,stock)))
                 * CASE WHEN status<=0 THEN 0.7 ELSE 1.0+status/10.0 END AS priority
        FROM (SELECT id_terminal, id_commodity, 'BUY' AS side, price_buy AS last_price, scu_buy AS stock,
                     status_buy AS status, CAST(floor(({NOW}-date_modified)/86400.0) AS BIGINT) AS days_stale
              FROM prices_all WHERE date_modified>0 AND price_buy>0
              UNION ALL
              SELECT id_terminal, id_commodity, 'SELL', price_sell, scu_sell_stock, status_sell,
                     CAST(floor(({NOW}-date_modified)/86400.0) AS BIGINT)
              FROM prices_all WHERE date_modified>0 AND price_sell>0)"""),
    "enriched": (["targets", "terminals"], """
        SELECT t.*, m.star_system_name AS star_system, m.name AS terminal_name,
               coalesce(m.is_available_live<>0, NOT (SELECT count(*)>0 FROM terminals)) AS is_reachable
        FROM targets t LEFT JOIN terminals m ON t.id_terminal=m.id"""),
    "recent": (["submitted_ids"], f"""
        SELECT DISTINCT id_terminal, id_commodity FROM submitted_ids
        WHERE ok AND sent_at >= {LOG_NOW}-21600"""),
}


def using(names: list[str] | str, body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause for the named views (and what they need), then ``body``."""
    wanted = names.split() if isinstance(names, str) else names
    order: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in wanted:
        add(name)
    parts = [f"{n} AS ({VIEWS[n][1].strip()})" for n in order]
    parts += [f"{n} AS ({s.strip()})" for n, s in (extra or {}).items()]
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
