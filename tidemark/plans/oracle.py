"""SQL twins of the named queries, over the same tables, in DuckDB's dialect."""

from __future__ import annotations

from tidemark.functions.columns import BUFFER_COEFFICIENT, MAX_BUFFER
from tidemark.plans.oracle_fit import fit, minimum

MS = "epoch_us(ts)//1000"
COEFFICIENT = "CAST(600.0000238418579 AS DOUBLE)"

ARRIVALS = f"a AS (SELECT event_id AS id, event_id % 4 AS shard, {MS} AS t_ms, value FROM events)"
TRACE = f"""tr AS (SELECT event_id, user_id % 4 AS worker, {MS} AS t_ms,
    ROW_NUMBER() OVER (PARTITION BY user_id % 4 ORDER BY {MS}, event_id) - 1 AS clock FROM events)"""
DELTAS = f"""d AS (SELECT user_id % 4 AS worker, event_id AS arrival, event_id % 10 AS class,
    user_id % 65 - 1 AS feature, value / 100 AS delta FROM events)"""
EXAMPLES = "e AS (SELECT vec_id AS row_id, vec_id % 4 AS shard, label, embedding FROM embeddings)"
LONG = """lv AS (SELECT row_id, shard, label, p - 1 AS feature, CAST(embedding[p] AS DOUBLE) AS x
    FROM (SELECT *, UNNEST(range(1, len(embedding) + 1)) AS p FROM e))"""
SPARSE = """sv AS (SELECT row_id, shard, label, feature, x FROM lv WHERE abs(x) >= 0.1)"""
VECTORS = """v AS (SELECT row_id, shard, label, feature, x FROM lv
    UNION ALL SELECT row_id, shard, label, -1, 1.0 FROM e)"""
KEYS = """k AS (SELECT c.class, f.feature
    FROM (SELECT UNNEST(range(0, (SELECT MAX(label) + 1 FROM embeddings))) AS class) c,
         (SELECT UNNEST(range(-1, (SELECT MAX(len(embedding)) FROM embeddings))) AS feature) f)"""
WEIGHTS = f"""{KEYS}, w AS (SELECT class, feature, ((class * 7 + (feature + 1) * 3) % 11 - 5) / 10.0 AS value FROM k)"""
ZERO = f"""{KEYS}, w AS (SELECT class, feature, CAST(0 AS DOUBLE) AS value FROM k)"""
DOCS = "docs AS (SELECT doc_id, text FROM documents)"
TOKENS = r"""tok AS (SELECT doc_id, UNNEST(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda t: t <> '')) AS token FROM docs)"""
COMBINED = f"""{KEYS}, {DELTAS}, w AS (SELECT class, feature, ROUND(COALESCE(total, 0) / 4, 6) AS value FROM k
    LEFT JOIN (SELECT class, feature, SUM(delta) AS total FROM d GROUP BY ALL) USING (class, feature))"""
FLAT = f"""{COMBINED}, s AS (SELECT MAX(label) + 1 AS c, MAX(len(embedding)) AS f FROM embeddings),
    fl AS (SELECT CASE WHEN feature = -1 THEN c * f + class ELSE feature * c + class END AS key, value, c * (f + 1) AS keys FROM w, s)"""
WORKER_LOG = f"""wl AS (SELECT event_type AS run, user_id % 4 AS partition, {MS} AS timestamp, value AS loss,
    value / 1000 AS "fMeasure", value / 500 AS accuracy, event_id AS "numTuplesSeen",
    ROW_NUMBER() OVER (PARTITION BY event_type, user_id % 4 ORDER BY {MS}, event_id) - 1 AS "vectorClock" FROM events)"""
SERVER_LOG = """sl AS (SELECT run, -1 AS partition, "vectorClock", timestamp, -1.0 AS loss FROM wl WHERE partition = 0)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BUFFER = (
    ARRIVALS,
    "g AS (SELECT *, ROW_NUMBER() OVER w AS n, t_ms - LAG(t_ms) OVER w AS gap FROM a WINDOW w AS (PARTITION BY shard ORDER BY t_ms, id))",
    """m AS (SELECT *, COALESCE(AVG(gap) OVER (PARTITION BY shard ORDER BY n ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 1000.0) AS mg FROM g)""",
    f"x AS (SELECT *, CAST(GREATEST(8, LEAST(64, FLOOR({COEFFICIENT} * 60000 / mg + 0.5))) AS BIGINT) AS target FROM m)",
    """o AS (SELECT *, CAST(n + LEAST(0, MIN(target - n) OVER (PARTITION BY shard ORDER BY n)) AS BIGINT) AS occupancy FROM x)""",
)

MARGINS = "z AS (SELECT row_id, shard, label, class, SUM(x * value) AS z FROM v JOIN w USING (feature) GROUP BY ALL)"
PROBABILITIES = """p AS (SELECT *, EXP(z - zm) / SUM(EXP(z - zm)) OVER (PARTITION BY row_id) AS p,
    zm + LN(SUM(EXP(z - zm)) OVER (PARTITION BY row_id)) - z AS nll
    FROM (SELECT *, MAX(z) OVER (PARTITION BY row_id) AS zm FROM z))"""
GRADIENT = """gr AS (SELECT p.shard, class, feature, SUM((p.p - CASE WHEN class = p.label THEN 1 ELSE 0 END) * x) AS gradient
    FROM p JOIN v USING (row_id) GROUP BY ALL)"""
PREDICTIONS = "pr AS (SELECT row_id, shard, label, CAST(arg_max(class, (z, -class)) AS INTEGER) AS prediction FROM z GROUP BY ALL)"
SCORE = _with(EXAMPLES, LONG, VECTORS, WEIGHTS, MARGINS, PREDICTIONS)


def _quality(by: str, predictions: str = "pr") -> str:
    """CTEs ending in ``q``: weighted F1 and accuracy per ``by``."""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""cc AS (SELECT {key}class, SUM(support) AS support, SUM(predicted) AS predicted, SUM(correct) AS correct FROM (
        SELECT {key}label AS class, 1 AS support, 0 AS predicted, CASE WHEN label = prediction THEN 1 ELSE 0 END AS correct FROM {predictions}
        UNION ALL SELECT {key}prediction, 0, 1, 0 FROM {predictions}) GROUP BY ALL),
    q AS (SELECT {key}ROUND(SUM(2.0 * correct / (support + predicted) * support) / SUM(support), 6) AS f1,
        ROUND(CAST(SUM(correct) AS DOUBLE) / SUM(support), 6) AS accuracy, CAST(SUM(support) AS BIGINT) AS rows FROM cc {group})"""


def _round(number: int, rate: float) -> str:
    """CTEs for one synchronous round: weights ``w{number}`` to ``w{number+1}``."""
    i = number
    return f"""z{i} AS (SELECT row_id, shard, label, class, SUM(x * value) AS z FROM v JOIN w{i} USING (feature) GROUP BY ALL),
    p{i} AS (SELECT *, EXP(z - zm) / SUM(EXP(z - zm)) OVER (PARTITION BY row_id) AS p
        FROM (SELECT *, MAX(z) OVER (PARTITION BY row_id) AS zm FROM z{i})),
    g{i} AS (SELECT p{i}.shard, class, feature, SUM((p - CASE WHEN class = p{i}.label THEN 1 ELSE 0 END) * x) AS gradient
        FROM p{i} JOIN v USING (row_id) GROUP BY ALL),
    s{i} AS (SELECT class, feature, SUM(-{rate} * gradient / n) AS delta FROM g{i}
        JOIN (SELECT shard, COUNT(*) AS n FROM e GROUP BY shard) USING (shard) GROUP BY ALL),
    w{i + 1} AS (SELECT class, feature, value + delta / 4 AS value FROM w{i} JOIN s{i} USING (class, feature))"""


ROUNDS_START = (EXAMPLES, LONG, VECTORS, ZERO, "w0 AS (SELECT * FROM w)")

DONE = "c AS (SELECT clock, MAX(t_ms) AS done FROM tr GROUP BY clock HAVING COUNT(DISTINCT worker) = 4)"


def _release(delay: int) -> str:
    if delay < 0:
        return "r AS (SELECT worker, clock + 1 AS clock, t_ms AS arrived_ms, t_ms AS released_ms FROM tr)"
    return f"""r AS (SELECT tr.worker, tr.clock + 1 AS clock, tr.t_ms AS arrived_ms,
        CASE WHEN tr.clock - {delay} < 0 THEN tr.t_ms WHEN c.done IS NULL THEN NULL ELSE GREATEST(tr.t_ms, c.done) END AS released_ms
        FROM tr LEFT JOIN c ON c.clock = tr.clock - {delay})"""


GAP = """sg AS (SELECT tr.worker, tr.clock, tr.t_ms, COALESCE(s.complete, 0) AS slowest FROM tr
    ASOF LEFT JOIN (SELECT done, clock + 1 AS complete FROM c) s ON tr.t_ms >= s.done)"""
# Several rounds may complete at one time; the lookup must see the last of them.
DONE_LAST = DONE + ",\nc2 AS (SELECT done, MAX(clock) AS clock FROM c GROUP BY done)"
GAP = GAP.replace("FROM c)", "FROM c2)")

HASH_ORDER = "md5(CAST(doc_id AS VARCHAR))"
OCCUPANCY_ROWS = "SELECT id, shard, n, target, occupancy FROM o"

SQL: dict[str, str] = {
    "shared_step_quality": _with(*ROUNDS_START, _round(0, 1.0),
        "z AS (SELECT row_id, shard, label, class, SUM(x * value) AS z FROM v JOIN w1 USING (feature) GROUP BY ALL)",
        PREDICTIONS, _quality("shard")) + "SELECT * FROM q",
    # sources and messages
    "encode_tagged_json": """SELECT event_id, '{"_t":"gMsg","vectorClock":' || event_id || ',"keyRange":{"_t":"keyRange","start":' || user_id
        || ',"end":' || (user_id + 1) || '},"values":{"' || user_id || '":' || value || '},"partitionKey":' || (user_id % 4) || '}' AS value FROM events""",
    "decode_tagged_json": """SELECT event_id, 'gMsg' AS tag, CAST(event_id AS INTEGER) AS clock, CAST(user_id AS INTEGER) AS range_start,
        CAST(user_id + 1 AS INTEGER) AS range_end, ROUND(value, 2) AS v, user_id % 4 AS worker FROM events""",
    "decode_json_field": "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events",
    "csv_examples_round_trip": _with(EXAMPLES, LONG, SPARSE) + """SELECT row_id, label, CAST(feature AS INTEGER) AS feature, ROUND(x, 6) AS x FROM sv""",
    "inferred_csv_scan": "SELECT event_id, user_id, event_type, ROUND(value, 6) AS value FROM events",
    "server_log_round_trip": _with(WORKER_LOG) + """SELECT timestamp, CAST(-1 AS INTEGER) AS partition,
        CAST("vectorClock" AS INTEGER) AS "vectorClock", CAST(-1 AS DOUBLE) AS loss, "fMeasure", accuracy FROM wl WHERE partition = 0""",
    "run_log_round_trip": _with(WORKER_LOG) + """SELECT timestamp, CAST(partition AS INTEGER) AS partition,
        CAST("vectorClock" AS INTEGER) AS "vectorClock", loss, "fMeasure", accuracy, "numTuplesSeen" FROM wl""",
    # preparation
    "sparse_encode": _with(EXAMPLES, LONG, SPARSE) + "SELECT row_id, CAST(feature AS INTEGER) AS feature, ROUND(x, 6) AS x FROM sv",
    "split_label": """SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS width,
        ROUND(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""",
    "validate_width": "SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN 0 ELSE 1 END AS fits FROM documents",
    "round_robin_shards": "SELECT event_id, event_id % 4 AS shard FROM events",
    "assemble_vector": """SELECT l_orderkey, l_linenumber, ROUND(l_quantity, 6) AS x0, ROUND(l_extendedprice, 6) AS x1,
        ROUND(l_discount, 6) AS x2 FROM lineitem""",
    "select_rename": "SELECT vec_id, label, ROUND(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings",
    "sorted_feature_entries": _with(EXAMPLES, LONG, SPARSE) + """SELECT e.row_id,
        COALESCE(string_agg(CAST(feature AS VARCHAR), ',' ORDER BY feature), '') AS indices FROM e LEFT JOIN sv USING (row_id) GROUP BY e.row_id""",
    "sparse_vector": _with(EXAMPLES, LONG, SPARSE) + """SELECT e.row_id, CAST(COUNT(feature) AS INTEGER) AS entries,
        ROUND(COALESCE(SUM(x), 0), 6) AS total FROM e LEFT JOIN sv USING (row_id) GROUP BY e.row_id""",
    "missing_key_lookup": _with(EXAMPLES, LONG, SPARSE) + "SELECT row_id, ROUND(x, 6) AS x FROM sv WHERE feature = 5",
    "key_range_half_open": _with(FLAT) + "SELECT CAST(key AS INTEGER) AS key, value FROM fl WHERE key >= keys // 4 AND key < keys // 2",
    "key_range_closed": _with(FLAT) + "SELECT CAST(key AS INTEGER) AS key, value FROM fl WHERE key BETWEEN keys // 4 AND keys // 2",
    "shard_slice": _with(ARRIVALS) + "SELECT id, shard FROM a WHERE shard = 2",
    "common_clock_rows": _with(WORKER_LOG) + """SELECT run, CAST(partition AS INTEGER) AS partition, "vectorClock", "numTuplesSeen" FROM wl
        JOIN (SELECT run, MIN(last) AS cc FROM (SELECT run, partition, MAX("vectorClock") AS last FROM wl GROUP BY ALL) GROUP BY run) USING (run)
        WHERE "vectorClock" <= cc""",
    "relabel": _with(WORKER_LOG, SERVER_LOG) + """SELECT run, CAST(CASE WHEN partition = -1 THEN 4 ELSE partition END AS INTEGER) AS partition,
        "vectorClock" FROM (SELECT run, partition, "vectorClock" FROM sl UNION ALL SELECT run, partition, "vectorClock" FROM wl)""",
    "tag_run": "SELECT event_id, 'night' AS run FROM events",
    "cast_label": "SELECT vec_id, CAST(label AS DOUBLE) AS as_double, CAST(label AS VARCHAR) AS as_text FROM embeddings",
    "same_message_check": "SELECT event_id, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS same FROM events",
    "hash_text": _with(DOCS, TOKENS) + """SELECT doc_id, CAST(CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 1024 AS INTEGER) AS feature,
        COUNT(*) AS x FROM tok GROUP BY ALL""",
    "hashed_maps": _with(DOCS, TOKENS) + """SELECT doc_id, feature, x FROM docs LEFT JOIN (SELECT doc_id,
        CAST(CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 1024 AS INTEGER) AS feature, COUNT(*) AS x FROM tok GROUP BY ALL) USING (doc_id)""",
    "hashed_vectors": _with(DOCS, TOKENS) + """SELECT docs.doc_id, COUNT(token) AS terms FROM docs LEFT JOIN tok USING (doc_id) GROUP BY docs.doc_id""",
    "cap_per_label": f"""SELECT * FROM labels QUALIFY ROW_NUMBER() OVER (PARTITION BY quality ORDER BY {HASH_ORDER}, doc_id) <= 50""",
    "preview": "SELECT event_id, event_type FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 5",
    "split_train_test": """SELECT vec_id, CASE WHEN CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 2000
        THEN 'test' ELSE 'train' END AS side FROM embeddings""",
    "label_histogram": "SELECT label, COUNT(*) AS n FROM embeddings GROUP BY label",
    # weights
    "initial_weights": _with(ZERO) + "SELECT CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature, value FROM w",
    "flat_weights": _with(FLAT) + "SELECT CAST(key AS INTEGER) AS key, value FROM fl",
    "flat_weights_round_trip": _with(COMBINED) + "SELECT CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature, value FROM w",
    "match_delta": _with(WEIGHTS, DELTAS) + """SELECT arrival, CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature,
        ROUND(delta, 6) AS delta, ROUND(value, 6) AS value FROM d JOIN w USING (class, feature)""",
    "weight_upsert": _with(WEIGHTS, DELTAS) + """, nv AS (SELECT class + 5 AS class, feature, MAX(delta) AS value FROM d GROUP BY ALL)
        SELECT CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature, ROUND(COALESCE(nv.value, w.value), 6) AS value
        FROM w FULL OUTER JOIN nv USING (class, feature)""",
    "closing_delta": _with(WEIGHTS, DELTAS) + """, nv AS (SELECT class + 5 AS class, feature, MAX(delta) AS value FROM d GROUP BY ALL)
        SELECT CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature, ROUND(COALESCE(nv.value, w.value) - w.value, 6) AS delta
        FROM w LEFT JOIN nv USING (class, feature)""",
    "combine_deltas": _with(WEIGHTS, DELTAS) + """SELECT CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature,
        ROUND(w.value + COALESCE(t.total, 0) / 4, 6) AS value
        FROM w LEFT JOIN (SELECT class, feature, SUM(delta) AS total FROM d GROUP BY ALL) t USING (class, feature)""",
    "weight_history": _with(WEIGHTS, DELTAS) + """SELECT arrival, CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature,
        ROUND(value + SUM(delta) OVER (PARTITION BY class, feature ORDER BY arrival) / 4, 6) AS value FROM d JOIN w USING (class, feature)""",
    "key_extent": _with(FLAT) + 'SELECT CAST(MIN(key) AS INTEGER) AS start, CAST(MAX(key) + 1 AS INTEGER) AS "end" FROM fl',
    "collect_weights": _with(COMBINED) + """SELECT CAST(class AS INTEGER) AS class, CAST(COUNT(*) AS INTEGER) AS entries,
        string_agg(feature || ':' || CAST(ROUND(value * 1000000) AS BIGINT), ',' ORDER BY feature) AS text FROM w GROUP BY class""",
    "missing_ids": """SELECT CAST(i AS BIGINT) AS doc_id FROM (SELECT UNNEST(range((SELECT MIN(doc_id) FROM documents), (SELECT MAX(doc_id) + 1 FROM documents))) AS i)
        WHERE i NOT IN (SELECT doc_id FROM labels)""",
    "key_difference": _with(WEIGHTS, DELTAS) + """SELECT CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature FROM
        ((SELECT class, feature FROM w UNION SELECT class + 5, feature FROM d) EXCEPT SELECT class, feature FROM d)""",
    # scoring and quality
    "margins": _with(EXAMPLES, LONG, VECTORS, WEIGHTS, MARGINS) + "SELECT row_id, label, CAST(class AS INTEGER) AS class, ROUND(z, 6) AS z FROM z",
    "softmax_gradient": _with(EXAMPLES, LONG, VECTORS, WEIGHTS, MARGINS, PROBABILITIES, GRADIENT) + """SELECT shard,
        CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature, ROUND(gradient, 6) AS gradient FROM gr""",
    "gradient_step": _with(EXAMPLES, LONG, VECTORS, WEIGHTS, MARGINS, PROBABILITIES, GRADIENT) + """,
        n AS (SELECT shard, COUNT(*) AS rows, AVG(nll) AS loss FROM p WHERE class = label GROUP BY shard)
        SELECT shard, CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature, ROUND(-0.5 * gradient / rows, 6) AS delta,
        ROUND(loss, 6) AS loss, rows FROM gr JOIN n USING (shard)""",
    "log_loss": _with(EXAMPLES, LONG, VECTORS, WEIGHTS, MARGINS, PROBABILITIES) + """SELECT shard, ROUND(AVG(nll), 6) AS loss FROM p
        WHERE class = label GROUP BY shard""",
    "predict": SCORE + "SELECT row_id, label, prediction FROM pr",
    "predict_from_margins": SCORE + "SELECT row_id, label, prediction FROM pr",
    "confusion": SCORE + "SELECT label, prediction, COUNT(*) AS n FROM pr GROUP BY ALL",
    "f1_accuracy": _with(EXAMPLES, LONG, VECTORS, WEIGHTS, MARGINS, PREDICTIONS, _quality("shard")) + "SELECT * FROM q",
    "evaluate_version": _with(EXAMPLES, LONG, VECTORS, WEIGHTS, MARGINS, PREDICTIONS, _quality("")) + "SELECT * FROM q",
    "class_report": _with(EXAMPLES, LONG, VECTORS, WEIGHTS, MARGINS, PREDICTIONS, _quality(""),
        """cr AS (SELECT class, COALESCE(correct / NULLIF(CAST(predicted AS DOUBLE), 0), 0) AS precision,
            COALESCE(correct / NULLIF(CAST(support AS DOUBLE), 0), 0) AS recall,
            COALESCE(2.0 * correct / NULLIF(support + predicted, 0), 0) AS f1, support, correct FROM cc)""") + """
        SELECT CAST(class AS VARCHAR) AS class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1,
            CAST(support AS BIGINT) AS support FROM cr
        UNION ALL SELECT 'micro', ROUND(CAST(SUM(correct) AS DOUBLE) / SUM(support), 6), ROUND(CAST(SUM(correct) AS DOUBLE) / SUM(support), 6),
            ROUND(CAST(SUM(correct) AS DOUBLE) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM cr
        UNION ALL SELECT 'macro', ROUND(AVG(precision), 6), ROUND(AVG(recall), 6), ROUND(AVG(f1), 6), CAST(SUM(support) AS BIGINT) FROM cr
        UNION ALL SELECT 'weighted', ROUND(SUM(precision * support) / SUM(support), 6), ROUND(SUM(recall * support) / SUM(support), 6),
            ROUND(SUM(f1 * support) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM cr""",
    # buffer
    "arrival_gaps": _with(*BUFFER) + "SELECT id, shard, gap FROM g",
    "mean_gap": _with(*BUFFER) + "SELECT id, shard, ROUND(mg, 6) AS mean_gap FROM m",
    "insertion_ids": _with(*BUFFER) + "SELECT id, shard, n FROM g",
    "target_size": _with(*BUFFER) + "SELECT id, shard, target FROM x",
    "buffer_occupancy": _with(*BUFFER) + OCCUPANCY_ROWS,
    "buffer_snapshot": _with(*BUFFER) + """SELECT o.id, o.shard, o.n AS insertion_id FROM o JOIN
        (SELECT shard, MAX(n) AS n, arg_max(occupancy, n) AS b FROM o GROUP BY shard) l USING (shard) WHERE o.n > l.n - l.b""",
    "buffer_snapshot_as_of": _with(ARRIVALS.replace("a AS (", "a0 AS ("),
        "a AS (SELECT * FROM a0 WHERE t_ms <= (SELECT (MIN(t_ms) + MAX(t_ms)) // 2 FROM a0))", *BUFFER[1:]) + """
        SELECT o.id, o.shard, o.n AS insertion_id FROM o JOIN
        (SELECT shard, MAX(n) AS n, arg_max(occupancy, n) AS b FROM o GROUP BY shard) l USING (shard) WHERE o.n > l.n - l.b""",
    "buffer_evictions": _with(*BUFFER) + """, ev AS (SELECT shard, n, t_ms, n - occupancy AS upto,
        COALESCE(LAG(n - occupancy) OVER (PARTITION BY shard ORDER BY n), 0) AS before FROM o)
        SELECT shard, UNNEST(range(before + 1, upto + 1)) AS insertion_id, n AS evicted_by, t_ms AS evicted_ms FROM ev WHERE upto > before""",
    "shard_stats": _with(*BUFFER) + """SELECT shard, MAX(n) AS rows_seen, arg_max(occupancy, n) AS rows_in_buffer,
        MAX(n) - arg_max(occupancy, n) + 1 AS min_id, MAX(n) AS max_id FROM o GROUP BY shard""",
    "buffer_at_training": _with(*BUFFER, "ti AS (SELECT user_id % 4 AS shard, " + MS + " AS t_ms, event_id AS time_id FROM events)",
        "ol AS (SELECT shard, t_ms, MAX(n) AS n, arg_max(occupancy, n) AS b FROM o GROUP BY shard, t_ms)",
        """st AS (SELECT ti.shard, ti.time_id, ol.n, ol.b FROM ti ASOF JOIN ol ON ti.shard = ol.shard AND ti.t_ms >= ol.t_ms)""") + """
        SELECT st.shard, time_id, COUNT(*) AS rows, MIN(o.n) AS first_id, MAX(o.n) AS last_id, ROUND(SUM(value), 4) AS total,
        ROUND(MIN(value), 6) AS least, ROUND(MAX(value), 6) AS greatest
        FROM st JOIN o ON o.shard = st.shard AND o.n > st.n - st.b AND o.n <= st.n GROUP BY st.shard, time_id""",
    "buffer_rows_at_training": _with(*BUFFER, "ti AS (SELECT user_id % 4 AS shard, " + MS + " AS t_ms, event_id AS time_id FROM events)",
        "ol AS (SELECT shard, t_ms, MAX(n) AS n, arg_max(occupancy, n) AS b FROM o GROUP BY shard, t_ms)",
        """st AS (SELECT ti.shard, ti.time_id, ol.n, ol.b FROM ti ASOF JOIN ol ON ti.shard = ol.shard AND ti.t_ms >= ol.t_ms)""") + """
        SELECT st.shard, time_id, COUNT(*) AS rows, MIN(o.n) AS first_id, MAX(o.n) AS last_id, ROUND(SUM(value), 4) AS total
        FROM st JOIN o ON o.shard = st.shard AND o.n > st.n - st.b AND o.n <= st.n GROUP BY st.shard, time_id""",
    "arrival_rate": _with(ARRIVALS) + "SELECT shard, t_ms // 3600000 * 3600000 AS window_ms, COUNT(*) AS rows FROM a GROUP BY ALL",
    # clocks
    "worker_clock": _with(TRACE) + "SELECT event_id, worker, clock FROM tr",
    "clock_faults": _with(TRACE) + """SELECT event_id, worker, CAST(clock // 2 + clock % 2 AS BIGINT) AS recorded_clock, clock FROM tr
        WHERE clock // 2 + clock % 2 <> clock""",
    "slowest_clock": _with(TRACE) + "SELECT MIN(m) AS slowest_clock FROM (SELECT worker, MAX(clock) + 1 AS m FROM tr GROUP BY worker)",
    "round_completion": _with(TRACE, DONE) + "SELECT clock, done AS completed_ms FROM c",
    "release_schedule_sequential": _with(TRACE, DONE, _release(0)) + "SELECT * FROM r",
    "release_schedule_eventual": _with(TRACE, _release(-1)) + "SELECT * FROM r",
    "release_schedule_bounded": _with(TRACE, DONE, _release(10)) + "SELECT * FROM r",
    "wait_times": _with(TRACE, DONE, _release(0)) + """SELECT worker, COUNT(released_ms) AS releases,
        CAST(COALESCE(SUM(released_ms - arrived_ms), 0) AS BIGINT) AS waited_ms, COALESCE(MAX(released_ms - arrived_ms), 0) AS longest_ms,
        ROUND(AVG(CASE WHEN released_ms = arrived_ms THEN 1.0 WHEN released_ms IS NOT NULL THEN 0.0 END), 6) AS straggler_share,
        COUNT(*) FILTER (released_ms IS NULL) AS held_back FROM r GROUP BY worker""",
    "clock_gap": _with(TRACE, DONE_LAST, GAP) + "SELECT worker, clock, t_ms, slowest AS slowest_clock, clock + 1 - slowest AS gap FROM sg",
    "delay_violations": _with(TRACE, DONE_LAST, GAP) + "SELECT worker, clock, clock + 1 - slowest AS gap FROM sg WHERE clock + 1 - slowest > 11",
    "iteration_overlap": _with(TRACE,
        "sp AS (SELECT worker, clock, event_id AS s, LEAD(event_id) OVER (PARTITION BY worker ORDER BY clock) AS e FROM tr)",
        "it AS (SELECT clock, MIN(s) AS s, MAX(e) AS e FROM sp WHERE e IS NOT NULL GROUP BY clock)") + """
        SELECT i.clock, i.s AS start, i.e AS "end", GREATEST(0, COALESCE(i.e - nx.s, 0)) AS shared_with_next,
            (SELECT COUNT(*) FROM it j WHERE j.clock > i.clock AND j.s < i.e) AS later_clocks
        FROM it i LEFT JOIN it nx ON nx.clock = i.clock + 1""",
    "weights_at_release": _with(TRACE, DONE_LAST, _release(10)) + """SELECT r.worker, r.clock, r.released_ms, s.version FROM r
        ASOF LEFT JOIN (SELECT done, clock + 1 AS version FROM c2) s ON r.released_ms >= s.done""",
    "distinct_workers": "SELECT DISTINCT user_id % 4 AS worker FROM events",
    # run logs
    "common_clock": _with(WORKER_LOG) + """SELECT run, MIN(last) AS common_clock FROM
        (SELECT run, partition, MAX("vectorClock") AS last FROM wl GROUP BY ALL) GROUP BY run""",
    "rows_seen": _with(WORKER_LOG) + 'SELECT run, "vectorClock", CAST(SUM("numTuplesSeen") AS BIGINT) AS total_seen FROM wl GROUP BY ALL',
    "attach_rows_seen": _with(WORKER_LOG, SERVER_LOG) + """SELECT sl.run, sl."vectorClock", sl.timestamp, t.total_seen FROM sl LEFT JOIN
        (SELECT run, "vectorClock", CAST(SUM("numTuplesSeen") AS BIGINT) AS total_seen FROM wl GROUP BY ALL) t USING (run, "vectorClock")""",
    "comparable_extent": _with(WORKER_LOG) + """SELECT MIN(m) AS extent FROM (SELECT run, MAX(s) AS m FROM
        (SELECT run, "vectorClock", CAST(SUM("numTuplesSeen") AS BIGINT) AS s FROM wl GROUP BY ALL) GROUP BY run)""",
    "metric_series": _with(WORKER_LOG) + 'SELECT run, "vectorClock", ' + ", ".join(
        f'ROUND(MAX({c}) FILTER (partition = {p}), 6) AS "{n}{p}"' for c, n in (("loss", "loss"), ('"fMeasure"', "fMeasure")) for p in range(4)
    ) + " FROM wl GROUP BY ALL",
    "union_logs": _with(WORKER_LOG, SERVER_LOG) + """SELECT run, CAST(partition AS INTEGER) AS partition, "vectorClock", loss, "numTuplesSeen" FROM wl
        UNION ALL SELECT run, CAST(partition AS INTEGER), "vectorClock", loss, NULL FROM sl""",
    "union_runs": """SELECT CASE WHEN event_id < 500 THEN 'early' ELSE 'late' END AS run, CAST(user_id % 4 AS INTEGER) AS partition,
        event_id AS "numTuplesSeen" FROM events""",
    "latest_per_worker": _with(WORKER_LOG) + """SELECT run, CAST(partition AS INTEGER) AS partition, "vectorClock", "numTuplesSeen" FROM wl
        QUALIFY ROW_NUMBER() OVER (PARTITION BY run, partition ORDER BY "vectorClock" DESC) = 1""",
    "log_by_clock": _with(WORKER_LOG) + """SELECT run, CAST(partition AS INTEGER) AS partition, "vectorClock" FROM wl ORDER BY "vectorClock", partition""",
    "oldest_rows": _with(*BUFFER) + "SELECT shard, id, n FROM g WHERE n <= 20",
    "arg_extremes": _with(ARRIVALS) + "SELECT shard, arg_min(id, (value, id)) AS arg_min, arg_max(id, (value, -id)) AS arg_max FROM a GROUP BY shard",
    # training
    "train_one_round": _with(*ROUNDS_START, _round(0, 2.0)) + """SELECT CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature,
        ROUND(value, 6) AS value FROM w1""",
    "train_two_rounds": _with(*ROUNDS_START, _round(0, 2.0), _round(1, 2.0)) + """SELECT CAST(class AS INTEGER) AS class,
        CAST(feature AS INTEGER) AS feature, ROUND(value, 6) AS value FROM w2""",
    "learning_curve": _with(*ROUNDS_START, _round(0, 2.0), _round(1, 2.0),
        "wv AS (SELECT 0 AS version, * FROM w0 UNION ALL SELECT 1, * FROM w1 UNION ALL SELECT 2, * FROM w2)",
        "z AS (SELECT version, row_id, label, class, SUM(x * value) AS z FROM v JOIN wv USING (feature) GROUP BY ALL)",
        "pr AS (SELECT CAST(version AS BIGINT) AS version, label, arg_max(class, (z, -class)) AS prediction FROM z GROUP BY version, row_id, label)",
        _quality("version")) + "SELECT * FROM q",
    # streams: the same answers as their batch twins
    "stream_adaptive_buffer": _with(*BUFFER) + OCCUPANCY_ROWS,
    "stream_buffer_contents": _with(*BUFFER) + """SELECT o.id, o.shard, o.n AS insertion_id, ROUND(o.value, 6) AS value FROM o JOIN
        (SELECT shard, MAX(n) AS n, arg_max(occupancy, n) AS b FROM o GROUP BY shard) l USING (shard) WHERE o.n > l.n - l.b""",
    "stream_arrival_rate": _with(ARRIVALS) + "SELECT shard, t_ms // 3600000 * 3600000 AS window_ms, COUNT(*) AS rows FROM a GROUP BY ALL",
    "stream_clock_faults": _with(TRACE) + """SELECT worker, event_id * 3 AS sent, clock, clock AS expected, NULL::VARCHAR AS fault, 'deltas' AS output FROM tr
        UNION ALL SELECT worker, event_id * 3 + 1, clock, clock + 1, 'repeat', 'faults' FROM tr WHERE event_id % 7 = 0
        UNION ALL SELECT worker, event_id * 3 + 2, clock + 5, clock + 1, 'gap', 'faults' FROM tr WHERE event_id % 11 = 0""",
    "stream_deduped_deltas": "SELECT user_id % 4 AS worker, event_id AS clock FROM events",
}
SQL["message_stream_round_trip"] = SQL["encode_tagged_json"].replace("SELECT event_id,", "SELECT event_id AS key,")


def _gated(delay: int, pieces: int = 8) -> str:
    """The release rule batch by batch, on who has new rows in which piece."""
    steps = [
        """r AS (SELECT vec_id % 4 AS shard, ROW_NUMBER() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS r,
            COUNT(*) OVER (PARTITION BY vec_id % 4) AS n FROM embeddings)""",
        f"""p AS (SELECT shard, CAST(FLOOR(r * (FLOOR({pieces - 1} / (shard + 1)) + 1) / n) * (shard + 1) AS BIGINT) AS piece,
            COUNT(*) AS c FROM r GROUP BY ALL)""",
        "b0 AS (SELECT w AS worker, CAST(0 AS BIGINT) AS clock, CAST(0 AS BIGINT) AS version, CAST(0 AS BIGINT) AS seen FROM (SELECT UNNEST(range(0, 4)) AS w))",
    ]
    free = "TRUE" if delay == -1 else f"clock - MIN(clock) OVER () <= {delay}"
    for b in range(pieces):
        steps.append(
            f"""s{b} AS (SELECT worker, clock + CASE WHEN version IS NOT NULL AND c > 0 THEN 1 ELSE 0 END AS clock,
            CASE WHEN version IS NOT NULL AND c > 0 THEN NULL ELSE version END AS version, seen + COALESCE(c, 0) AS seen
            FROM b{b} LEFT JOIN (SELECT shard AS worker, c FROM p WHERE piece = {b}) USING (worker))"""
        )
        steps.append(f"b{b + 1} AS (SELECT worker, clock, CASE WHEN version IS NULL AND ({free}) THEN {b + 1} ELSE version END AS version, seen FROM s{b})")
    every = " UNION ALL ".join(
        f"SELECT CAST({b} AS BIGINT) AS batch, worker, CAST(clock AS BIGINT) AS clock, CAST(version AS BIGINT) AS version, CAST(seen AS BIGINT) AS seen FROM b{b}"
        for b in range(pieces + 1)
    )
    return _with(*steps) + every


SQL |= {
    "stream_gate_sequential": _gated(0),
    "stream_gate_bounded": _gated(1),
    "stream_gate_eventual": _gated(-1),
    "gate": _with(TRACE) + """, c AS (SELECT worker, MAX(clock) + 1 AS clock FROM tr GROUP BY worker)
        SELECT worker, clock FROM c WHERE clock - (SELECT MIN(clock) FROM c) <= 10""",
}

_REPORT = ", ".join(
    f'ROUND(MAX({c}) FILTER (partition = {p}), 6) AS "{n}{4 if p < 0 else p}"'
    for c, n in (("loss", "loss"), ('"fMeasure"', "fMeasure"), ("accuracy", "accuracy"))
    for p in (0, 1, 2, 3, -1)
)
SQL["run_report"] = _with(
    WORKER_LOG,
    """u AS (SELECT run, partition, "vectorClock", loss, "fMeasure", accuracy, "numTuplesSeen" FROM wl
        UNION ALL SELECT run, -1, "vectorClock", -1.0, "fMeasure", accuracy, NULL FROM wl WHERE partition = 0)""",
    """cc AS (SELECT run, MIN(last) AS cc FROM (SELECT run, partition, MAX("vectorClock") AS last FROM u GROUP BY ALL) GROUP BY run)""",
    'k AS (SELECT u.* FROM u JOIN cc USING (run) WHERE "vectorClock" <= cc)',
    't AS (SELECT run, "vectorClock", CAST(SUM("numTuplesSeen") AS BIGINT) AS total_seen FROM k WHERE partition <> -1 GROUP BY ALL)',
    "x AS (SELECT MIN(m) AS extent FROM (SELECT run, MAX(total_seen) AS m FROM t GROUP BY run))",
) + f"""SELECT run, "vectorClock", total_seen, {_REPORT} FROM k JOIN t USING (run, "vectorClock"), x
    WHERE total_seen <= extent GROUP BY run, "vectorClock", total_seen"""


def _versions(count: int, table: str = "w") -> str:
    return " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS version, class, feature, value FROM {table}{i}" for i in range(count))


def _fit_rounds(rounds: int, *start: str) -> str:
    """Quality after rounds of local fits on ``v``, from the weights ``w0``."""
    parts = [*start, "sh AS (SELECT DISTINCT shard FROM v)"]
    for i in range(rounds):
        parts += [f"f{i}w AS MATERIALIZED (SELECT shard, class, feature, value FROM w{i}, sh)", *fit(f"f{i}", "v", f"f{i}w")]
        parts.append(f"""w{i + 1} AS MATERIALIZED (SELECT class, feature, w{i}.value + SUM(delta) / 4 AS value FROM w{i} JOIN f{i}fit USING (class, feature)
            GROUP BY class, feature, w{i}.value)""")
    scored = [
        f"wv AS ({_versions(rounds + 1)})",
        "z AS (SELECT version, row_id, label, class, SUM(x * value) AS z FROM v JOIN wv USING (feature) GROUP BY ALL)",
        "pr AS (SELECT version, label, arg_max(class, (z, -class)) AS prediction FROM z GROUP BY version, row_id, label)",
    ]
    return _with(*parts, *scored, _quality("version")) + "SELECT * FROM q"


_LABELLED = r"""docs AS (SELECT doc_id, text, quality FROM documents JOIN labels USING (doc_id))"""
SQL |= {
    "local_fit": _with(*ROUNDS_START, "fw AS (SELECT shard, class, feature, value FROM w0, (SELECT DISTINCT shard FROM e))", *fit("f", "v", "fw"))
    + """SELECT shard, CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature, ROUND(delta, 6) AS delta, ROUND(loss, 6) AS loss, rows FROM ffit""",
    "local_fit_rounds": _fit_rounds(3, *ROUNDS_START),
    "text_rounds": _fit_rounds(2, _LABELLED, TOKENS,
        """v AS MATERIALIZED (SELECT doc_id % 4 AS shard, doc_id AS row_id, quality AS label,
            CAST(CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 1024 AS INTEGER) AS feature, CAST(COUNT(*) AS DOUBLE) AS x
            FROM tok JOIN docs USING (doc_id) GROUP BY ALL
            UNION ALL SELECT doc_id % 4, doc_id, quality, -1, 1.0 FROM docs)""",
        "w0 AS MATERIALIZED (SELECT class, feature, CAST(0 AS DOUBLE) AS value FROM (SELECT UNNEST([0, 1]) AS class), (SELECT UNNEST(range(-1, 1024)) AS feature))"),
}


def _held(r: int) -> list[str]:
    """The rows in each worker's buffer after the pieces up to ``r``, and their vectors."""
    return [
        f"""h{r} AS MATERIALIZED (SELECT o.shard, o.id AS row_id, label, embedding FROM o JOIN
            (SELECT shard, MAX(n) AS n, arg_max(occupancy, n) AS b FROM o WHERE piece <= {r} GROUP BY shard) l USING (shard)
            WHERE o.n <= l.n AND o.n > l.n - l.b)""",
        f"""v{r} AS MATERIALIZED (SELECT shard, row_id, label, p - 1 AS feature, CAST(embedding[p] AS DOUBLE) AS x
            FROM (SELECT *, UNNEST(range(1, len(embedding) + 1)) AS p FROM h{r}) UNION ALL SELECT shard, row_id, label, -1, 1.0 FROM h{r})""",
    ]


def _streamed(pieces: int = 5) -> str:
    """Local fits piece by piece; in `embeddings` every worker has rows in every piece, so every rule lets all go on."""
    parts = [
        f"""a AS (SELECT vec_id AS id, vec_id % 4 AS shard, vec_id * 1000 AS t_ms, label, embedding,
            (vec_id - (SELECT MIN(vec_id) FROM embeddings)) // ((SELECT MAX(vec_id) - MIN(vec_id) FROM embeddings) // {pieces} + 1) AS piece FROM embeddings)""",
        BUFFER[1], BUFFER[2],
        f"x AS (SELECT *, CAST(GREATEST(16, LEAST({MAX_BUFFER}, FLOOR(CAST({BUFFER_COEFFICIENT!r} AS DOUBLE) * 60000 / mg + 0.5))) AS BIGINT) AS target FROM m)",
        BUFFER[4], EXAMPLES, LONG, VECTORS, f"{KEYS}, w0 AS MATERIALIZED (SELECT class, feature, CAST(0 AS DOUBLE) AS value FROM k)",
    ]
    scopes = []
    for r in range(pieces):
        parts += _held(r)
        # The fits' own vectors are named apart from those of the test rows.
        parts += [f"m{r} AS MATERIALIZED (SELECT shard, class, feature, value FROM w{r}, (SELECT DISTINCT shard FROM h{r}))", *fit(f"f{r}", f"v{r}", f"m{r}")]
        parts.append(f"""w{r + 1} AS MATERIALIZED (SELECT class, feature, w.value + SUM(delta) / 4 AS value FROM w{r} w JOIN f{r}fit USING (class, feature)
            GROUP BY class, feature, w.value)""")
        scopes += [f"SELECT {r} AS batch, shard AS part, class, feature, value + delta AS value FROM f{r}fit", f"SELECT {r}, -1, class, feature, value FROM w{r + 1}"]
    losses = " UNION ALL ".join(f"SELECT DISTINCT {r} AS batch, shard AS part, loss FROM f{r}fit" for r in range(pieces))
    parts += [
        f"wv AS MATERIALIZED ({' UNION ALL '.join(scopes)})",
        "zt AS (SELECT batch, part, row_id, label, class, SUM(x * value) AS z FROM v JOIN wv USING (feature) GROUP BY ALL)",
        "pr AS (SELECT batch * 100 + part AS version, label, arg_max(class, (z, -class)) AS prediction FROM zt GROUP BY batch, part, row_id, label)",
        _quality("version"),
        f"ls AS (SELECT batch * 100 + part AS version, loss FROM ({losses}))",
        "se AS (SELECT shard, piece, MAX(n) AS seen FROM o GROUP BY ALL)",
    ]
    return _with(*parts) + """SELECT CAST((version + 1) // 100 AS BIGINT) AS batch, CASE WHEN part = -1 THEN 'shared' ELSE 'local' END AS scope,
        CAST(part AS INTEGER) AS partition, CAST((version + 1) // 100 AS INTEGER) AS "vectorClock",
        CASE WHEN part = -1 THEN -1.0::DOUBLE ELSE ROUND(loss, 6) END AS loss, f1, accuracy, seen
        FROM (SELECT q.*, q.version - (q.version + 1) // 100 * 100 AS part, loss FROM q LEFT JOIN ls USING (version)) LEFT JOIN se ON se.shard = part AND piece = (version + 1) // 100"""


def _message_run(fits: bool, pieces: int = 4) -> str:
    """Buffers by windows, and from piece to piece what each worker makes of the weights it is sent."""
    parts = [
        """a AS (SELECT vec_id AS id, vec_id % 4 AS shard, vec_id * vec_id * 10 AS t_ms, label, embedding,
            (vec_id - (SELECT MIN(vec_id) FROM embeddings)) // ((SELECT MAX(vec_id) - MIN(vec_id) FROM embeddings) // 4 + 1) AS piece FROM embeddings)""",
        BUFFER[1], BUFFER[2], BUFFER[3].replace(COEFFICIENT, "CAST(5 AS DOUBLE)"), BUFFER[4],
        f"{KEYS}, w0 AS MATERIALIZED (SELECT class, feature, CAST(0 AS DOUBLE) AS value FROM k)",
    ]
    for r in range(pieces):
        parts += [
            *_held(r),
            f"""m{r} AS MATERIALIZED (SELECT shard, class, feature, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM w{r}, (SELECT DISTINCT shard FROM h{r}))""",
        ]
        if fits:
            parts += fit(f"f{r}", f"v{r}", f"m{r}")
        else:
            parts += [
                f"z{r} AS (SELECT v.shard, row_id, label, class, SUM(x * value) AS z FROM v{r} v JOIN m{r} USING (shard, feature) GROUP BY ALL)",
                PROBABILITIES.replace("p AS (", f"p{r} AS MATERIALIZED (", 1).replace("FROM z)", f"FROM z{r})"),
                f"n{r} AS (SELECT shard, COUNT(*) AS rows, AVG(nll) AS loss FROM p{r} WHERE class = label GROUP BY shard)",
                f"""f{r}fit AS MATERIALIZED (SELECT g.shard, class, feature, value, -0.5 * gradient / rows AS delta, loss, rows FROM
                    (SELECT p.shard, class, feature, SUM((p.p - CASE WHEN class = p.label THEN 1 ELSE 0 END) * x) AS gradient
                     FROM p{r} p JOIN v{r} USING (shard, row_id) GROUP BY ALL) g JOIN n{r} USING (shard) JOIN m{r} USING (shard, class, feature))""",
            ]
        parts += [
            f"d{r} AS MATERIALIZED (SELECT shard, class, feature, value, CAST(CAST(delta AS FLOAT) AS DOUBLE) AS delta, loss, rows FROM f{r}fit)",
            f"""w{r + 1} AS MATERIALIZED (SELECT w.class, w.feature, w.value + SUM(delta) / 4 AS value FROM w{r} w JOIN d{r} USING (class, feature)
                GROUP BY w.class, w.feature, w.value)""",
        ]
    return _with(*parts) + " UNION ALL ".join(
        f"""SELECT shard AS worker, CAST({r} AS BIGINT) AS clock, CAST({r} AS BIGINT) AS version, ROUND(loss, 6) AS loss, rows,
        CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature, ROUND(value + delta, 6) AS value FROM d{r}"""
        for r in range(pieces)
    )


SQL |= {"stream_worker_steps": _message_run(False), "stream_worker_fits": _message_run(True)}
SQL |= {f"stream_training_{rule}": _streamed() for rule in ("sequential", "bounded", "eventual")}
SQL["reference_certificate"] = _with(EXAMPLES, LONG, VECTORS, KEYS, *minimum(0.1)) + """SELECT rows, ROUND(objective, 4) AS objective,
    ROUND(lower_bound, 4) AS lower_bound, objective - lower_bound < 1e-5 AS optimal FROM best"""
SQL["stream_start_timer"] = "SELECT DISTINCT user_id % 4 AS worker, CAST(1 AS INTEGER) AS run, TRUE AS due, CAST(1 AS BIGINT) AS after_ms FROM events"
