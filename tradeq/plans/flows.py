"""Extraction metrics, file round trips and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeq.functions.economics import epoch_seconds
from tradeq.operators import audit as A
from tradeq.operators import batch as B
from tradeq.operators import metrics as M
from tradeq.operators import staleness as S
from tradeq.operators.ordered import widen
from tradeq.plans.gates import SOURCE_VIEWS
from tradeq.plans.registry import query
from tradeq.plans.views import using
from tradeq.session import settle, shared_dir
from tradeq.sources.envelope import load_ground_truth, read_envelope
from tradeq.sources.files import list_files, pending_files, write_files
from tradeq.sources.market import LOG_NOW, NOW, Market
from tradeq.streaming import jobs as J

# ---- metrics -------------------------------------------------------------------


def read_aloud(text, k):
    """A misread copy of ``text``, by rule."""
    return (
        F.when(k % 4 == 0, text)
        .when(k % 4 == 1, F.translate(text, "eo", "c0"))
        .when(k % 4 == 2, F.concat(text, F.lit(" extra words here")))
        .otherwise(F.regexp_replace(text, "the ", ""))
    )


_READ = """CASE {k}%4 WHEN 0 THEN {t} WHEN 1 THEN translate({t},'eo','c0') WHEN 2 THEN {t}||' extra words here'
    ELSE replace({t},'the ','') END"""
_ASCII = "regexp_replace(text,'[^\\x00-\\x7F]','?','g')"


def _pairs(m: Market) -> DataFrame:
    """Every passage read by three engines; engine c has no reference for some."""
    b = m.table("benchmark").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    engines = b.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("e"))
    k = F.col("item_id")
    return engines.select(
        k.alias("item_id"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("e") + 1).alias("engine"),
        F.when((F.col("e") == 2) & (k % 7 == 0), F.lit(None)).otherwise(F.col("text")).alias("reference"),
        read_aloud(F.col("text"), k + F.col("e")).alias("hypothesis"),
        ((k * 7 + F.col("e")) % 50 / 64.0 + 0.2).alias("confidence"),
        (100 + k % 40 * (F.col("e") + 1)).cast("double").alias("elapsed_ms"),
    )


_W = "list_filter(regexp_split_to_array(upper({}),'[ \\t\\n]+'), lambda w: w<>'')"
_RATE_VIEWS = {
    "raw_pairs": f"""SELECT item_id, ['a','b','c'][e+1] AS engine, CASE WHEN e=2 AND item_id%7=0 THEN NULL ELSE t END AS reference,
        {_READ.format(k='(item_id+e)', t='t')} AS hypothesis, (item_id*7+e)%50/64.0::DOUBLE+0.2 AS confidence,
        100+item_id%40*(e+1) AS elapsed_ms FROM (SELECT item_id, {_ASCII} AS t FROM benchmark), (SELECT unnest([0,1,2]) AS e)""",
    "pair_words": f"""SELECT *, trim(reference,' '||chr(10)||chr(9)) AS r, trim(hypothesis,' '||chr(10)||chr(9)) AS h,
        {_W.format('reference')} AS rw, {_W.format('hypothesis')} AS hw FROM raw_pairs""",
    "coded": """SELECT *, list_distinct(list_concat(rw,hw)) AS v FROM pair_words""",
    "rated": """SELECT *, CASE WHEN reference IS NULL THEN 'nan'::DOUBLE ELSE levenshtein(r,h)/CAST(length(r) AS DOUBLE) END AS cer,
        CASE WHEN reference IS NULL THEN 'nan'::DOUBLE ELSE levenshtein(array_to_string(list_transform(rw, lambda w: chr(CAST(list_position(v,w) AS INT))),''),
          array_to_string(list_transform(hw, lambda w: chr(CAST(list_position(v,w) AS INT))),''))/CAST(len(rw) AS DOUBLE) END AS wer FROM coded""",
}


@query("error_rates", using([], """
    SELECT item_id, engine, round(cer,6) AS cer, round(wer,6) AS wer FROM rated""", _RATE_VIEWS))
def error_rates(m: Market):
    return M.error_rates(_pairs(m)).select("item_id", "engine", F.round("cer", 6).alias("cer"), F.round("wer", 6).alias("wer"))


@query("engine_report", using([], """
    SELECT engine, round(avg(cer),6) AS mean_cer, round(avg(wer),6) AS mean_wer, round(avg(confidence),6) AS mean_confidence,
      round(avg(elapsed_ms),6) AS mean_elapsed_ms FROM rated GROUP BY 1""", _RATE_VIEWS))
def engine_report(m: Market):
    report = M.engine_report(M.error_rates(_pairs(m)))
    return report.select("engine", *[F.round(c, 6).alias(c) for c in report.columns if c != "engine"])


TURNS_PER_TASK = 2_000


@query("turn_char_errors", f"""
    SELECT conv_id, turn, round(levenshtein(r,h)/CAST(length(r) AS DOUBLE),6) AS cer FROM (
      SELECT conv_id, turn, trim(t,' '||chr(10)||chr(9)) AS r, trim({_READ.format(k='turn', t='t')},' '||chr(10)||chr(9)) AS h
      FROM (SELECT conv_id, turn, {_ASCII} AS t FROM conversations))""")
def turn_char_errors(m: Market):
    # edit distance grows with the square of a text: some milliseconds a row
    t = widen(m.table("conversations"), TURNS_PER_TASK).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    cer = M.char_error(F.col("text"), read_aloud(F.col("text"), F.col("turn")))
    return t.select("conv_id", "turn", F.round(cer, 6).alias("cer"))


# Only equality counts: words of one side alone are one code each, the others are codes of one byte as far
# as these go; the rest is worked out cell by cell.
_LINE_ERRORS = f"""WITH RECURSIVE raw AS (
  SELECT doc_id AS capture_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents),
lines AS (SELECT capture_id, line_no, trim(raw, ' '||chr(9)||chr(13)||chr(160)) AS t FROM raw),
pairs AS (SELECT row_number() OVER () AS id, *, {_READ.format(k='line_no', t='t')} AS h FROM lines WHERE t <> ''),
worded AS (SELECT id, capture_id, line_no,
  list_filter(string_split_regex(upper(trim(t, ' '||chr(9)||chr(13)||chr(160))), '[ \\t\\n\\r]+'), lambda w: w <> '') AS rw,
  list_filter(string_split_regex(upper(trim(h, ' '||chr(9)||chr(13)||chr(160))), '[ \\t\\n\\r]+'), lambda w: w <> '') AS hw FROM pairs),
shared AS (SELECT *, list_intersect(list_distinct(rw), list_distinct(hw)) AS v FROM worded),
short AS (SELECT id, levenshtein(
    array_to_string(list_transform(rw, lambda w: chr(CAST(coalesce(list_position(v, w), 126) AS INT))), ''),
    array_to_string(list_transform(hw, lambda w: chr(CAST(coalesce(list_position(v, w), 127) AS INT))), '')) AS d
  FROM shared WHERE len(v) <= 120),
long AS (SELECT * FROM shared WHERE len(v) > 120),
cell_words AS (SELECT id, unnest(hw) AS w, generate_subscripts(hw, 1) AS j FROM long),
cells AS (
  SELECT id, 0 AS i, j, j::BIGINT AS x FROM (SELECT id, unnest(range(0, len(hw) + 1)) AS j FROM long)
  UNION ALL
  SELECT id, i, j, j + min(t - j) OVER (PARTITION BY id ORDER BY j) AS x FROM (
    SELECT c.id, c.i + 1 AS i, c.j, CASE WHEN c.j = 0 THEN c.i + 1 ELSE least(c.x + 1,
        lag(c.x) OVER (PARTITION BY c.id ORDER BY c.j) + CASE WHEN w.w = l.rw[c.i + 1] THEN 0 ELSE 1 END) END AS t
    FROM cells c JOIN long l ON l.id = c.id AND c.i < len(l.rw) LEFT JOIN cell_words w ON w.id = c.id AND w.j = c.j)),
found AS (SELECT id, d FROM short UNION ALL
  SELECT c.id, c.x FROM cells c JOIN long l ON l.id = c.id AND c.i = len(l.rw) AND c.j = len(l.hw))
SELECT capture_id, line_no, round(CASE WHEN len(rw) = 0 THEN CASE WHEN len(hw) = 0 THEN 0.0 ELSE 1.0 END
    ELSE d / CAST(len(rw) AS DOUBLE) END, 6) AS wer FROM worded JOIN found USING (id)"""


@query("document_word_errors", _LINE_ERRORS)
def document_word_errors(m: Market):
    """Word error rate per document line of whole documents."""
    lines = m.document_lines().withColumn("hypothesis", read_aloud(F.col("text"), F.col("line_no")))
    rated = M.word_error(lines, "text", "hypothesis", "wer")
    return rated.select("capture_id", "line_no", F.round("wer", 6).alias("wer"))


@query("capture_completeness", using("captures capture_rows", """
    SELECT c.capture_id, count(r.capture_id) AS rows_parsed, count(*) FILTER (WHERE id_commodity IS NOT NULL AND scu IS NOT NULL AND price IS NOT NULL)
      AS rows_complete, round(coalesce(avg(match_score),0),6) AS mean_score FROM captures c LEFT JOIN capture_rows r ON c.capture_id=r.capture_id GROUP BY 1"""))
def capture_completeness(m: Market):
    return M.completeness(m.captures(), m.capture_rows()).withColumn("mean_score", F.round("mean_score", 6))


@query("mean_confidence", using("captures", """
    SELECT capture_id, round(coalesce(avg((l_partkey%100)/100.0::DOUBLE),0),9) AS mean_confidence
    FROM captures LEFT JOIN lineitem ON capture_id=l_orderkey GROUP BY 1"""))
def mean_confidence(m: Market):
    regions = m.table("lineitem").select(
        F.col("l_orderkey").alias("capture_id"), (F.col("l_partkey") % 100 / 100.0).alias("confidence")
    )
    return M.mean_confidence(m.captures(), regions).withColumn("mean_confidence", F.round("mean_confidence", 9))


# ---- files ---------------------------------------------------------------------


@query("envelope_scan", using("captures capture_rows", """
    SELECT 'row' AS kind, r.capture_id, id_commodity, match_score, NULL AS status FROM capture_rows r
    WHERE r.capture_id%4 IN (0,1) OR (r.capture_id%4=2 AND row_index=0)
    UNION ALL SELECT 'reject', NULL, NULL, NULL, 'error' FROM (SELECT DISTINCT capture_id FROM capture_rows WHERE capture_id%4=3)"""))
def envelope_scan(m: Market):
    """Envelopes written from the capture rows, one per line, and scanned back."""
    k = F.col("capture_id")
    part = F.floor(F.col("row_index") / B.MAX_PAYLOAD_ROWS)
    item = F.struct("row_index", "capture_id", "id_commodity", "match_score")
    grouped = m.capture_rows().groupBy("capture_id", part.alias("part")).agg(F.array_sort(F.collect_list(item)).alias("data"))
    status = F.when(k % 4 == 0, "ok").when(k % 4 == 3, "error").otherwise("OK")
    listed = F.to_json(F.struct(status.alias("status"), F.lit(200).alias("http_code"), "data"))
    single = F.to_json(F.struct(status.alias("status"), F.lit(200).alias("http_code"), F.col("data")[0].alias("data")))
    path = shared_dir(m.spark, "envelopes")
    grouped.select(F.when(k % 4 == 2, single).otherwise(listed).alias("value")).write.text(path)
    rows, rejects = read_envelope(m.spark, path, "capture_id bigint, id_commodity bigint, match_score double", whole_file=False)
    none = lambda t: F.lit(None).cast(t)
    return rows.select(F.lit("row").alias("kind"), "*", none("string").alias("status")).unionByName(
        rejects.select(
            F.lit("reject").alias("kind"), none("bigint").alias("capture_id"), none("bigint").alias("id_commodity"),
            none("double").alias("match_score"), "status",
        )
    )


@query("ground_truth_scan", using("captures capture_rows", """
    SELECT image, terminal_type, unnest(list_transform(rs, lambda r: r.c)) AS commodity, unnest(list_transform(rs, lambda r: r.q)) AS quantity FROM (
      SELECT 'shot-'||capture_id||'.jpg' AS image, lower(any_value(tab)) AS terminal_type, list({'c':'C'||id_commodity,'q':scu||' SCU'} ORDER BY row_index) AS rs
      FROM captures JOIN capture_rows USING (capture_id) WHERE id_commodity IS NOT NULL AND scu IS NOT NULL GROUP BY capture_id)"""))
def ground_truth_scan(m: Market):
    """Expected rows written as nested JSON, read back and flattened."""
    known = m.capture_rows().filter("id_commodity is not null and scu is not null").join(
        m.captures().select("capture_id", "tab"), "capture_id"
    )
    row = F.struct(
        "row_index",
        F.concat(F.lit("C"), F.col("id_commodity").cast("string")).alias("commodity"),
        F.concat(F.col("scu").cast("string"), F.lit(" SCU")).alias("quantity"),
    )
    part = F.floor(F.col("row_index") / B.MAX_PAYLOAD_ROWS)
    path = shared_dir(m.spark, "truth")
    known.groupBy("capture_id", "tab", part.alias("part")).agg(F.array_sort(F.collect_list(row)).alias("rows")).select(
        F.concat(F.lit("shot-"), F.col("capture_id").cast("string"), F.lit(".jpg")).alias("image"),
        F.lower("tab").alias("terminalType"),
        F.transform("rows", lambda r: r.dropFields("row_index")).alias("rows"),
    ).write.json(path)
    truth = load_ground_truth(m.spark, path, multi_line=False)
    return truth.select("image", F.col("terminalType").alias("terminal_type"), F.inline("rows")).drop("price")


@query("audit_append", using("submissions", f"""
    SELECT id, id_terminal, sent_at, CASE id%3 WHEN 1 THEN '["a-'||id||'.png","b.png"]' END AS source_images, '['||k||','||(k+1)||']' AS submitted_commodity_ids
    FROM submissions WHERE sent_at>={LOG_NOW}-43200"""))
def audit_append(m: Market):
    """Append the log to day folders, then look up the last half day from it."""
    k = F.col("id")
    name = F.concat(F.lit("a-"), k.cast("string"), F.lit(".png"))
    fresh = m.submissions().withColumns(
        {
            "source_images": F.when(k % 3 == 1, F.array(name, F.lit("b.png"))).otherwise(F.array().cast("array<string>")),
            "submitted_commodity_ids": F.from_json("submitted_commodity_ids", "array<int>"),
        }
    ).drop("dt")
    path = shared_dir(m.spark, "audit")
    A.append_submissions(fresh, path)
    log = m.spark.read.parquet(path)
    return A.recent_submissions(log, LOG_NOW, 43200).select(
        "id", "id_terminal", "sent_at", "source_images", "submitted_commodity_ids"
    )


# ---- streams -------------------------------------------------------------------


def stream_of(m: Market, name: str) -> DataFrame:
    """The table as a file stream; its schema comes from the batch table."""
    return (
        m.spark.readStream.schema(m.table(name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(m.folder)
    )


def _stream_events(m: Market) -> DataFrame:
    e = stream_of(m, "events")
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("id_commodity"),
        F.timestamp_seconds(epoch_seconds(F.col("ts"))).alias("ts"),
        epoch_seconds(F.col("ts")).alias("sent_at"),
    )


_SPACED = {
    "ev": """SELECT event_id AS id, user_id%20 AS user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sent_at,
        row_number() OVER (PARTITION BY user_id%20 ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS k FROM events""",
    "acc": """SELECT user_id, id, sent_at, k, sent_at AS last, true AS taken FROM ev WHERE k=1
        UNION ALL SELECT e.user_id, e.id, e.sent_at, e.k, CASE WHEN e.sent_at-a.last>300 THEN e.sent_at ELSE a.last END, e.sent_at-a.last>300
        FROM acc a JOIN ev e ON e.user_id=a.user_id AND e.k=a.k+1""",
}
_SPACED_SQL = using([], "SELECT id, user_id, sent_at FROM acc WHERE taken", _SPACED).replace("WITH ", "WITH RECURSIVE ", 1)


@query("spaced_submissions", _SPACED_SQL)
def spaced_submissions(m: Market):
    """Five-minute guard per user, exact: only accepted events block later ones."""
    e = m.table("events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("user_id"), epoch_seconds(F.col("ts")).alias("sent_at")
    )
    return J.accept_spaced(e, ["user_id"])


@query("streamed_guard", _SPACED_SQL)
def streamed_guard(m: Market):
    """The same guard as a stateful stream."""
    e = _stream_events(m).withColumn("user_id", F.col("user_id") % 20)
    return J.run_appends(J.stream_accept(e, ["user_id"]), "guard").select("id", "user_id", "sent_at")


_FILES = {
    "shots": """SELECT CASE WHEN s_suppkey%3=0 THEN 'PTU' ELSE 'LIVE' END AS branch, 'Shot-'||(s_suppkey*17)||
        CASE s_suppkey%4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.txt' ELSE '.bmp' END AS name FROM supplier""",
    "pending": "SELECT * FROM shots WHERE name NOT LIKE '%.txt' AND upper(name) NOT IN (SELECT source_key FROM accepted)",
}


@query("captured_files", using("submissions", """
    SELECT 'stream' AS origin, branch, name FROM pending UNION ALL SELECT 'listing', branch, name FROM pending""", SOURCE_VIEWS | _FILES))
def captured_files(m: Market):
    """Capture files of two folders, minus accepted names: found by a file stream and by its batch twin."""
    k = F.col("s_suppkey")
    suffix = F.when(k % 4 == 0, ".png").when(k % 4 == 1, ".JPG").when(k % 4 == 2, ".txt").otherwise(".bmp")
    branch = F.when(k % 3 == 0, "PTU").otherwise("LIVE")
    folder = shared_dir(m.spark, "shots")
    name = F.concat(branch, F.lit("/Shot-"), (k * 17).cast("string"), suffix)
    write_files(m.table("supplier").select(name.alias("name"), F.lit("x").alias("content")), folder)
    accepted = settle(A.submitted_sources(m.submissions()), "accepted")
    folders = {b: f"{folder}/{b}" for b in ("LIVE", "PTU")}
    streamed = J.run_appends(J.stream_captures(m.spark, folders, accepted), "captures").select(F.lit("stream").alias("origin"), "branch", "name")
    for b, path in folders.items():
        found = pending_files(list_files(m.spark, path), accepted)
        streamed = streamed.unionByName(found.select(F.lit("listing").alias("origin"), F.lit(b).alias("branch"), "name"))
    return streamed


@query("streamed_first_seen", """
    SELECT user_id, k AS id_commodity FROM (SELECT DISTINCT user_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events)""")
def streamed_first_seen(m: Market):
    """Approximate guard: keys that got through the watermark de-duplication at least once."""
    kept = J.run_appends(J.stream_dedup(_stream_events(m), ["user_id", "id_commodity"]), "dedup")
    return kept.select("user_id", "id_commodity").distinct()


@query("streamed_quota", """
    SELECT user_id, sent_at, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY sent_at RANGE BETWEEN 1799 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_reports,
      n_reports > 3 AS over_limit
    FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sent_at, count(*) AS n FROM events GROUP BY 1,2)""")
def streamed_quota(m: Market):
    """Reports of each user in the half hour up to every report."""
    return J.run_updates(J.stream_quota(_stream_events(m), "user_id", limit=3), ["user_id", "sent_at"], "quota")


def _stream_observations(m: Market) -> DataFrame:
    return Market.observations(_Streamed(m))


class _Streamed(Market):
    """The market over a streamed lineitem table."""

    def __init__(self, m: Market):
        super().__init__(m.spark, m.folder)

    def table(self, name: str) -> DataFrame:
        return stream_of(Market(self.spark, self.folder), name) if name == "lineitem" else super().table(name)


@query("streamed_latest", using("ranked_obs", """
    SELECT id_terminal, id_commodity, side, ts, round(price,2) AS price, stock, status FROM ranked_obs WHERE rn=1"""))
def streamed_latest(m: Market):
    latest = J.run_updates(J.stream_latest(_stream_observations(m)), ["id_terminal", "id_commodity", "side"], "latest")
    return latest.withColumn("price", F.round("price", 2))


@query("streamed_overlay", using("targets", """
    SELECT id_terminal, max(days_stale) AS max_days, count(*) FILTER (WHERE days_stale>=30) AS stale_count FROM (
      SELECT id_terminal, id_commodity, side, days_stale FROM targets) GROUP BY 1"""))
def streamed_overlay(m: Market):
    """Terminal ages kept up to date while price reports stream in."""
    def overlay_of(observations: DataFrame) -> DataFrame:
        wide = Market.prices_from(observations)
        return S.stale_targets(wide, NOW).groupBy("id_terminal").agg(
            F.max("days_stale").alias("max_days"), F.count_if(F.col("days_stale") >= 30).alias("stale_count")
        )

    return J.stream_overlay(_stream_observations(m), overlay_of)
