"""Every registered query, each with its SQL twin where SQL can express it.

``@query(name, ids, sql)`` registers a function from the fixture tables to a
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from wearline import schema as S
from wearline.functions import columns as C
from wearline.operators import accuracy as acc
from wearline.operators import asof
from wearline.operators import entities as ent
from wearline.operators import features as feat
from wearline.operators import fleet
from wearline.operators import scoring
from wearline.operators import series
from wearline.operators import store
from wearline.operators import truth as tr
from wearline.operators import validate as val
from wearline.plans.fixtures import Tables
from wearline.sources import requests as req
from wearline.sources import text

KEYS = S.SERIES_KEYS


@dataclass
class Query:
    build: object
    ids: str
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = Query(fn, ids, sql)
        return fn

    return register


def rounded(df, places: int, *cols: str):
    """Round the named double columns; the rest stay as they are."""
    return df.select(*[F.round(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


# --- sources and sinks ------------------------------------------------------


@query("sensor_log_parse", "S1", r"""
SELECT event_id, CAST(p[1] AS BIGINT) AS unit, CAST(p[2] AS BIGINT) AS cycle, CAST(p[3] AS DOUBLE) AS setting_1,
       CAST(p[6] AS DOUBLE) AS s2, CAST(p[8] AS DOUBLE) AS s4
FROM (SELECT event_id, string_split_regex(trim(value), '\s+') AS p
      FROM (SELECT event_id, concat(unit, g, cycle, g, setting_1, g, setting_2, g, setting_3, g, s2, g, s3, g, s4, ' ') AS value
            FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '  ' END AS g FROM readings) r) l) q""")
def _(t: Tables):
    from pyspark.sql import types as T

    names = ["unit", "cycle", *S.SETTINGS, "s2", "s3", "s4"]
    schema = T.StructType(
        [T.StructField(n, T.LongType() if n in ("unit", "cycle") else T.DoubleType()) for n in names]
    )
    return text.parse_sensor_lines(t.log_lines, schema).select("event_id", "unit", "cycle", "setting_1", "s2", "s4")


@query("log_file_subsets", "S5", """
SELECT subset, count(*) AS n_rows, count(DISTINCT unit) AS units FROM readings GROUP BY subset""")
def _(t: Tables):
    name = F.concat(F.lit("train_"), C.dataset_label("subset"), F.lit(".txt"))
    tagged = t.readings.select("unit", text.subset_of_file(name).alias("subset"))
    return tagged.groupBy("subset").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("unit").alias("units"))


@query("batch_request_rows", "S6", """
SELECT unit AS sender, (cycle - 1) // 20 AS chunk, CAST((cycle - 1) % 20 AS INTEGER) AS item, subset, CAST(unit AS INTEGER) AS engine_id, CAST(cycle AS INTEGER) AS cycle, s2, s15, s21
FROM readings""")
def _(t: Tables):
    rows = req.parse_requests(t.batch_requests, "batch")
    return rows.select("sender", "chunk", "item", "subset", "engine_id", "cycle", "s2", "s15", "s21")


@query("sequence_request_rows", "S6", """
SELECT subset, CAST(unit AS INTEGER) AS engine_id, chunk, CAST(unnest(cycles) AS INTEGER) AS cycle, unnest(vals) AS s2 FROM sequences""")
def _(t: Tables):
    rows = req.explode_history(req.parse_requests(t.sequence_requests, "sequence"))
    return rows.select("subset", "engine_id", "chunk", "cycle", "s2")


@query("truth_request_rows", "S6", """
SELECT prediction_id, true_rul, count(*) AS n FROM truths GROUP BY prediction_id, true_rul""")
def _(t: Tables):
    bodies = t.truths.select(F.to_json(F.struct("prediction_id", "true_rul")).alias("value"))
    return req.parse_requests(bodies, "truth").groupBy("prediction_id", "true_rul").agg(F.count(F.lit(1)).alias("n"))


@query("tables_as_views", "S7", """
SELECT e.subset, count(*) AS n, max(p.cycle) AS last_cycle
FROM predictions p JOIN engines e ON e.engine_id = p.engine_id GROUP BY e.subset""")
def _(t: Tables):
    return t.spark.sql(
        "SELECT e.subset, count(*) AS n, max(p.cycle) AS last_cycle FROM {p} p JOIN {e} e "
        "ON e.engine_id = p.engine_id GROUP BY e.subset",
        p=t.predictions,
        e=t.engines,
    )


@query("engine_catalogue", "S8 S9", """
SELECT subset, unit, max(cycle) AS max_cycle, count(*) AS total_cycles FROM readings GROUP BY subset, unit""")
def _(t: Tables):
    return ent.entity_catalogue(t.readings, KEYS, "cycle")


@query("prediction_log_rows", "K1 J8 F11", """
SELECT CAST('0x' || substr(md5('run-1|' || s.unit || '|' || s.cycle || '|0'), 1, 15) AS BIGINT) AS prediction_id,
       s.subset, s.unit AS engine_id, m.model_id, s.cycle, s.cycle AS n_history_cycles, s.predicted_rul,
       CASE WHEN s.predicted_rul <= 10 THEN 'CRITICAL' WHEN s.predicted_rul <= 30 THEN 'WARNING' ELSE 'HEALTHY' END AS health_status,
       125 AS rul_cap, '/predict/batch' AS endpoint, 'run-1' AS request_id, 0.0::DOUBLE AS latency_ms, (SELECT ts FROM as_of) AS predicted_at
FROM scored_last s
JOIN (SELECT subset, arg_max(model_id, trained_at) AS model_id FROM registry WHERE is_active GROUP BY subset) m ON m.subset = s.subset""")
def _(t: Tables):
    scored = scoring.score_latest(t.readings.select(*KEYS, "cycle", "s2"), t.baseline, ["s2"])
    scored = scored.withColumn("engine_id", F.col("unit")).withColumn("n_history_cycles", F.col("cycle"))
    return store.prediction_rows(
        store.with_active_model(scored, t.registry)[0], "/predict/batch", "run-1", t.as_of, S.RUL_CAP
    )


@query("sensor_log_export", "K2", """
SELECT event_id, concat_ws(' ', unit, cycle, printf('%.4f', setting_1), printf('%.4f', setting_2), printf('%.4f', setting_3),
       printf('%.4f', s2), coalesce(printf('%.4f', s15), '')) AS value
FROM readings""")
def _(t: Tables):
    rows = t.readings.select("event_id", "unit", "cycle", *S.SETTINGS, "s2", "s15")
    return text.sensor_lines(rows, ["unit", "cycle", *S.SETTINGS, "s2", "s15"])


@query("engine_get_or_create", "K3 J6", """
SELECT engine_id, unit_number, subset, FALSE AS created FROM engines WHERE unit_number % 3 = 0
UNION ALL
SELECT (SELECT coalesce(max(engine_id), 0) FROM engines WHERE unit_number % 3 = 0) + row_number() OVER (ORDER BY unit_number, subset),
       unit_number, subset, TRUE
FROM engines WHERE unit_number % 3 <> 0""")
def _(t: Tables):
    known = t.engines.filter("unit_number % 3 = 0")
    rows = t.readings.select(F.col("unit").alias("unit_number"), "subset")
    created, _all = store.get_or_create(known, rows, ["unit_number", "subset"], "engine_id")
    return known.withColumn("created", F.lit(False)).unionByName(created.withColumn("created", F.lit(True)))


@query("reading_upsert", "K4", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem) q WHERE rn = 1""")
def _(t: Tables):
    version = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = t.source("lineitem").select("l_orderkey", "l_linenumber", *version, "l_linestatus")
    stored, incoming = (rows.filter(F.col("l_linestatus") == v).drop("l_linestatus") for v in ("F", "O"))
    return store.upsert_latest(stored, incoming, ["l_orderkey", "l_linenumber"], version)


@query("truth_first_wins", "K5", """
SELECT prediction_id, true_rul, submitted_at FROM first_truths
WHERE prediction_id NOT IN (SELECT prediction_id FROM predictions WHERE prediction_id % 7 = 0)""")
def _(t: Tables):
    target = t.predictions.filter("prediction_id % 7 = 0").select("prediction_id")
    return store.insert_first(target, t.truths, ["prediction_id"], ["submitted_at", "true_rul"])


@query("registry_update", "K6", """
SELECT r.model_id, r.subset, r.is_active, CASE WHEN r.is_active AND m.subset IS NOT NULL THEN 'v1-FD00' || r.subset ELSE r.model_version END AS model_version,
       CASE WHEN r.is_active AND m.subset IS NOT NULL THEN m.rmse ELSE r.train_rmse END AS train_rmse,
       CASE WHEN r.is_active AND m.subset IS NOT NULL THEN m.mae ELSE r.train_mae END AS train_mae,
       CASE WHEN r.is_active AND m.subset IS NOT NULL THEN NULL ELSE r.train_nasa_score END AS train_nasa_score
FROM registry r LEFT JOIN (SELECT subset, round(sqrt(avg(error * error)), 4) AS rmse, round(avg(abs_error), 4) AS mae
                           FROM errors_by_engine GROUP BY subset) m ON m.subset = r.subset""")
def _(t: Tables):
    report = rounded(acc.accuracy(t.errors_by_engine, ["subset"]), 4, "rmse", "mae")
    metrics = report.select(
        "subset",
        F.lit(None).cast("string").alias("algorithm"),
        F.col("rmse").alias("train_rmse"),
        F.col("mae").alias("train_mae"),
        F.lit(None).cast("double").alias("train_r2"),
        F.lit(None).cast("double").alias("train_nasa_score"),
    )
    new = store.update_registry(t.registry, metrics)
    return new.select("model_id", "subset", "is_active", "model_version", "train_rmse", "train_mae", "train_nasa_score")


# --- projections, filters, validation ----------------------------------------


@query("sensor_sets", "P1 P2 U3", """
SELECT subset, count(*) AS n_rows, 
       CASE WHEN subset = 1 THEN 's2,s3,s4,s7,s8,s9,s11,s12,s13,s14,s17,s20,s21'
            ELSE 's2,s3,s4,s7,s8,s9,s11,s12,s13,s14,s15,s17,s20,s21' END AS sensors,
       CASE WHEN subset = 1 THEN 40 ELSE 43 END AS n_features,
       CASE WHEN subset = 1 THEN 's15' ELSE '' END AS not_used
FROM readings GROUP BY subset""")
def _(t: Tables):
    needed = C.required_sensors("subset")
    everything = F.array(*[F.lit(s) for s in S.ALL_SENSORS])
    return t.readings.groupBy("subset").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "subset",
        "n_rows",
        F.array_join(needed, ",").alias("sensors"),
        (F.size(needed) * 3 + 1).alias("n_features"),
        F.array_join(val.missing_columns(everything, needed), ",").alias("not_used"),
    )


@query("selected_engines", "P3", """
SELECT subset, unit, cycle, s2 FROM readings WHERE unit IN (SELECT s_suppkey * 3 FROM supplier)""")
def _(t: Tables):
    wanted = t.source("supplier").select((F.col("s_suppkey") * 3).alias("unit"))
    return ent.select_entities(t.readings, wanted).select(*KEYS, "cycle", "s2")


@query("first_engines", "P4", """
SELECT subset, unit, max(cycle) AS last_cycle FROM readings
WHERE unit IN (SELECT DISTINCT unit FROM readings ORDER BY unit LIMIT 10) GROUP BY subset, unit""")
def _(t: Tables):
    return ent.first_entities(t.readings, [], "unit", 10).groupBy(*KEYS).agg(F.max("cycle").alias("last_cycle"))


@query("first_engines_per_dataset", "P5", """
SELECT subset, unit, cycle, s2 FROM (SELECT *, dense_rank() OVER (PARTITION BY subset ORDER BY unit) AS r FROM readings) q WHERE r <= 5""")
def _(t: Tables):
    return ent.first_entities(t.readings, ["subset"], "unit", 5).select(*KEYS, "cycle", "s2")


@query("predictions_of_active_datasets", "P6 P10 T9 F5", """
SELECT 'FD00' || e.subset AS dataset, count(*) AS predictions FROM predictions p JOIN engines e ON e.engine_id = p.engine_id
WHERE 'FD00' || e.subset IN (SELECT 'FD00' || subset FROM registry WHERE is_active) GROUP BY 1""")
def _(t: Tables):
    from wearline.plans.dashboards import active_datasets

    wanted = active_datasets(t.registry).select(C.dataset_subset("dataset").alias("subset")).distinct()
    engines = t.engines.join(series.checked_broadcast(wanted), "subset", "left_semi")
    per_engine = t.predictions.groupBy("engine_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = fleet.with_engines(per_engine, engines)
    return joined.groupBy(C.dataset_label("subset").alias("dataset")).agg(F.sum("_n").alias("predictions"))


@query("accuracy_in_range", "P8 A10 A11", """
SELECT CAST(date_trunc('hour', submitted_at) AS TIMESTAMP) AS time, subset,
       CAST(round(CAST(sqrt(avg(error * error)) AS DECIMAL(38,6)), 2) AS DOUBLE) AS rmse,
       CAST(round(CAST(sum(nasa_penalty) AS DECIMAL(38,6)), 1) AS DOUBLE) AS nasa_score
FROM errors_by_engine
WHERE submitted_at BETWEEN (SELECT ts FROM as_of) - INTERVAL 7 DAY AND (SELECT ts FROM as_of) GROUP BY 1, 2""")
def _(t: Tables):
    since = C.hours_before(t.as_of, F.lit(7 * 24))
    return acc.accuracy_over_time(t.errors_by_engine, since=since, until=t.as_of)


@query("dataset_names", "P11", """
SELECT 'FD00' || subset AS dataset, subset BETWEEN 1 AND 4 AS valid, CAST(CASE WHEN subset <= 4 THEN subset END AS DOUBLE) AS parsed, count(*) AS n
FROM bad_readings GROUP BY subset""")
def _(t: Tables):
    named = t.bad_readings.select(C.dataset_label("subset").alias("dataset"))
    good, bad = val.validate(named, val.dataset_rules())
    both = good.withColumn("valid", F.lit(True)).unionByName(bad.drop("reasons").withColumn("valid", F.lit(False)))
    return both.groupBy("dataset", "valid", C.dataset_subset("dataset").cast("double").alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


@query("rejected_readings", "V1 V2 V3 V5", """
SELECT event_id, reasons FROM (
  SELECT event_id, concat_ws(', ', CASE WHEN subset NOT BETWEEN 1 AND 4 THEN 'subset out of range' END,
         CASE WHEN unit < 1 THEN 'unit below 1' END, CASE WHEN cycle < 1 THEN 'cycle below 1' END,
         CASE WHEN isnan(s2) OR isinf(s2) THEN 's2 not finite' END, CASE WHEN isnan(s3) OR isinf(s3) THEN 's3 not finite' END,
         CASE WHEN s4 IS NULL AND subset BETWEEN 1 AND 4 THEN 's4 missing' END,
         CASE WHEN s15 IS NULL AND subset BETWEEN 2 AND 4 THEN 's15 missing' END) AS reasons
  FROM bad_readings) q WHERE reasons <> ''""")
def _(t: Tables):
    _good, bad = val.validate(t.bad_readings, val.reading_rules())
    return bad.select("event_id", F.array_join("reasons", ", ").alias("reasons"))


@query("accepted_readings", "V5", """
SELECT subset, unit, count(*) AS n, round(sum(s2), 4) AS s2_sum FROM bad_readings
WHERE subset BETWEEN 1 AND 4 AND cycle >= 1 AND NOT isnan(s2) AND NOT isinf(s3) AND s4 IS NOT NULL GROUP BY subset, unit""")
def _(t: Tables):
    good, _bad = val.validate(t.bad_readings, val.reading_rules())
    return rounded(good.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("s2").alias("s2_sum")), 4, "s2_sum")


@query("sequence_verdicts", "V4", """
SELECT subset, CAST(unit AS INTEGER) AS engine_id, chunk, len(cycles) AS n, coalesce(reason, 'ok') AS verdict FROM sequence_verdicts""")
def _(t: Tables):
    rows = req.parse_requests(t.sequence_requests, "sequence")
    reason = val.sequence_reason(F.transform("history", lambda r: r["cycle"]))
    return rows.select(
        "subset", "engine_id", "chunk", F.size("history").cast("long").alias("n"), F.coalesce(reason, F.lit("ok")).alias("verdict")
    )


@query("series_verdicts", "V4 W8", """
SELECT subset, unit, count(*) AS n_rows,
       CASE WHEN count(DISTINCT cycle) <> count(*) THEN 'duplicate cycles' WHEN min(step) < 0 THEN 'not ascending'
            WHEN max(step) > 1 THEN 'gaps' ELSE 'ok' END AS verdict
FROM (SELECT *, cycle - lag(cycle) OVER (PARTITION BY subset, unit ORDER BY recorded_at, event_id) AS step FROM bad_readings) q
GROUP BY subset, unit""")
def _(t: Tables):
    out = val.validate_sequence(
        t.bad_readings, KEYS, "cycle", ["recorded_at", "event_id"], at=C.seconds_of("recorded_at")
    )
    return out.select(*KEYS, "n_rows", F.coalesce("reason", F.lit("ok")).alias("verdict"))


@query("sequence_steps", "W8", """
SELECT subset, unit, cycle, CAST(cycle - lag(cycle) OVER (PARTITION BY subset, unit ORDER BY cycle) AS DOUBLE) AS step FROM bad_readings""")
def _(t: Tables):
    steps = val.sequence_steps(t.bad_readings.select(*KEYS, "cycle"), KEYS, "cycle")
    return steps.withColumn("step", F.col("step").cast("double"))


@query("engines_not_found", "V6", """
SELECT DISTINCT s_suppkey AS unit, 'no matching entity' AS reason FROM supplier WHERE s_suppkey NOT IN (SELECT unit_number FROM engines)""")
def _(t: Tables):
    requested = t.source("supplier").select(F.col("s_suppkey").alias("unit"))
    return ent.missing_entities(requested, t.readings, ["unit"])


@query("engines_found", "U4", """
SELECT s_suppkey AS unit FROM supplier INTERSECT SELECT unit_number FROM engines""")
def _(t: Tables):
    requested = t.source("supplier").select(F.col("s_suppkey").alias("unit"))
    return ent.known_entities(requested, t.readings, ["unit"])


# --- joins --------------------------------------------------------------------


@query("truth_by_position", "J1 S2", """
SELECT s.subset, s.unit, r.unit_rank, t.true_rul, s.predicted_rul FROM scored_last s
JOIN ranks r ON r.subset = s.subset AND r.unit = s.unit JOIN truth_by_rank t ON t.subset = r.subset AND t.unit_rank = r.unit_rank""")
def _(t: Tables):
    scored = scoring.score_latest(t.readings.select(*KEYS, "cycle", "s2"), t.baseline, ["s2"])
    out, _rejects = tr.attach_truth_by_rank(scored.select(*KEYS, "predicted_rul"), t.truth_by_rank, KEYS)
    return out.select(*KEYS, "unit_rank", "true_rul", "predicted_rul")


@query("truth_position_counts", "J1", """
SELECT e.subset, count(*) AS n_entities, count(*) AS n_truths, TRUE AS matches FROM engines e GROUP BY e.subset""")
def _(t: Tables):
    return tr.truth_counts(t.readings, t.truth_by_rank, "subset")


@query("predictions_with_engines", "J3", """
SELECT p.prediction_id, e.unit_number, e.subset, p.predicted_rul, p.health_status
FROM predictions p JOIN engines e ON e.engine_id = p.engine_id""")
def _(t: Tables):
    return fleet.with_engines(t.predictions, t.engines).select(
        "prediction_id", "unit_number", "subset", "predicted_rul", "health_status"
    )


@query("errors_with_engines", "J4", """
SELECT prediction_id, engine_id, subset, error, round(nasa_penalty, 6) AS nasa_penalty FROM errors_by_engine""")
def _(t: Tables):
    from wearline.plans.dashboards import errors_with_subset

    rows = errors_with_subset(t.errors, t.predictions, t.engines)
    return rounded(rows.select("prediction_id", "engine_id", "subset", "error", "nasa_penalty"), 6, "nasa_penalty")


@query("latest_with_engine", "J5 W4", """
SELECT e.subset, e.unit_number, p.prediction_id, p.predicted_rul, p.health_status, p.predicted_at
FROM engines e JOIN latest p ON p.engine_id = e.engine_id""")
def _(t: Tables):
    return fleet.with_engines(fleet.latest_state(t.predictions), t.engines).select(
        "subset", "unit_number", "prediction_id", "predicted_rul", "health_status", "predicted_at"
    )


@query("unknown_truths", "J7", """
SELECT t.prediction_id, t.true_rul, t.submitted_at, 'unknown prediction_id' AS reason FROM first_truths t
WHERE t.prediction_id NOT IN (SELECT prediction_id FROM predictions)""")
def _(t: Tables):
    return tr.score_truths(t.predictions, t.truths)[1]


@query("active_models", "J8 P10", """
SELECT subset, arg_max(model_id, trained_at) AS model_id FROM registry WHERE is_active GROUP BY subset""")
def _(t: Tables):
    return store.active_model(t.registry)


@query("rows_without_model", "J8", """
SELECT subset, count(*) AS n FROM bad_readings WHERE subset NOT IN (SELECT subset FROM registry WHERE is_active) GROUP BY subset""")
def _(t: Tables):
    _rows, rejects = store.with_active_model(t.bad_readings, t.registry)
    return rejects.groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


@query("rows_up_to_cut", "J9", """
SELECT r.subset, r.unit, r.cycle, r.s2, c.cut_cycle FROM readings r JOIN life_cuts c ON c.subset = r.subset AND c.unit = r.unit
WHERE r.cycle <= c.cut_cycle""")
def _(t: Tables):
    cuts = ent.life_stage_cuts(t.readings, KEYS, "cycle")
    return ent.rows_up_to_cut(t.readings, cuts, KEYS, "cycle").select(*KEYS, "cycle", "s2", "cut_cycle")


@query("readings_with_engines", "J10", """
SELECT r.event_id, e.unit_number, e.subset, r.s2, r.s3 FROM readings r JOIN engines e ON e.engine_id = r.engine_id""")
def _(t: Tables):
    return fleet.with_engines(t.readings.drop("subset"), t.engines).select("event_id", "unit_number", "subset", "s2", "s3")


@query("engines_with_predictions", "J11 U1 T10", """
SELECT DISTINCT 'FD00' || e.subset AS dataset, e.unit_number FROM engines e JOIN predictions p ON p.engine_id = e.engine_id""")
def _(t: Tables):
    from wearline.plans.dashboards import engines_of

    return engines_of(t.engines, t.predictions)


@query("truth_by_key", "J12", """
SELECT s.subset, s.unit, s.predicted_rul, t.n_rows % 50 AS true_rul FROM scored_last s
JOIN (SELECT subset, unit, max(n_rows) AS n_rows FROM readings GROUP BY subset, unit) t ON t.subset = s.subset AND t.unit = s.unit""")
def _(t: Tables):
    scored = scoring.score_latest(t.readings.select(*KEYS, "cycle", "s2"), t.baseline, ["s2"])
    known = t.readings.groupBy(*KEYS).agg((F.max("n_rows") % 50).alias("true_rul"))
    return tr.attach_truth(scored.select(*KEYS, "predicted_rul"), known, KEYS)[0]


# --- accuracy -----------------------------------------------------------------


@query("rmse_mae", "A1 A2", """
SELECT round(sqrt(avg(error * error)), 4) AS rmse, round(avg(abs_error), 4) AS mae FROM errors""")
def _(t: Tables):
    return t.errors.agg(F.round(acc.rmse(), 4).alias("rmse"), F.round(acc.mae(), 4).alias("mae"))


@query("r_squared", "A3", """
SELECT subset, round(1 - sum(error * error) / (sum(true_rul * true_rul) - sum(true_rul) * sum(true_rul) / count(*)), 4) AS r2
FROM errors_by_engine GROUP BY subset""")
def _(t: Tables):
    return t.errors_by_engine.groupBy("subset").agg(F.round(acc.r2(), 4).alias("r2"))


@query("penalty_per_prediction", "A4", "SELECT prediction_id, round(nasa_penalty, 6) AS nasa_penalty FROM errors")
def _(t: Tables):
    return rounded(t.errors.select("prediction_id", "nasa_penalty"), 6, "nasa_penalty")


@query("penalty_score", "A5", "SELECT CAST(round(CAST(sum(nasa_penalty) AS DECIMAL(38,6)), 1) AS DOUBLE) AS nasa_score FROM errors")
def _(t: Tables):
    return t.errors.agg(C.decimal_round(acc.penalty_sum(), 1).alias("nasa_score"))


@query("late_early_tallies", "A6", """
SELECT count(*) FILTER (error > 10) AS late, count(*) FILTER (error < -10) AS early, count(*) FILTER (abs(error) <= 10) AS on_time FROM errors""")
def _(t: Tables):
    return acc.accuracy(t.errors).select("late", "early", "on_time")


@query("late_early_per_dataset", "A7", """
SELECT 'FD00' || subset AS dataset, count(*) FILTER (error > 10) AS late, count(*) FILTER (abs(error) <= 10) AS on_time,
       count(*) FILTER (error < -10) AS early FROM errors_by_engine GROUP BY subset""")
def _(t: Tables):
    return acc.accuracy(t.errors_by_engine, ["subset"]).select(
        C.dataset_label("subset").alias("dataset"), "late", "on_time", "early"
    )


@query("on_time_percent", "A8", """
SELECT round(100.0 * sum(CASE WHEN abs(error) <= 10 THEN 1 ELSE 0 END) / nullif(count(*), 0), 1) AS on_time_percent FROM errors""")
def _(t: Tables):
    return t.errors.agg(F.round(acc.on_time_percent(), 1).alias("on_time_percent"))


@query("live_accuracy", "A9", """
SELECT 'FD00' || subset AS dataset, count(*) AS n_evaluated, CAST(round(CAST(sqrt(avg(abs_error * abs_error)) AS DECIMAL(38,6)), 2) AS DOUBLE) AS live_rmse,
       CAST(round(CAST(avg(abs_error) AS DECIMAL(38,6)), 2) AS DOUBLE) AS live_mae,
       CAST(round(CAST(sum(nasa_penalty) AS DECIMAL(38,6)), 1) AS DOUBLE) AS nasa_score FROM errors_by_engine GROUP BY subset""")
def _(t: Tables):
    return t.errors_by_engine.groupBy("subset").agg(
        F.count(F.lit(1)).alias("n_evaluated"),
        C.decimal_round(acc.rmse("abs_error"), 2).alias("live_rmse"),
        C.decimal_round(F.avg("abs_error"), 2).alias("live_mae"),
        C.decimal_round(F.sum("nasa_penalty"), 1).alias("nasa_score"),
    ).select(C.dataset_label("subset").alias("dataset"), "n_evaluated", "live_rmse", "live_mae", "nasa_score")


@query("rmse_trend", "A10 F6 F15", """
SELECT CAST(date_trunc('hour', submitted_at) AS TIMESTAMP) AS time,
       CAST(round(CAST(sqrt(avg(error * error) FILTER (subset = 1)) AS DECIMAL(38,6)), 2) AS DOUBLE) AS FD001,
       CAST(round(CAST(sqrt(avg(error * error) FILTER (subset = 2)) AS DECIMAL(38,6)), 2) AS DOUBLE) AS FD002,
       CAST(round(CAST(sqrt(avg(error * error) FILTER (subset = 3)) AS DECIMAL(38,6)), 2) AS DOUBLE) AS FD003,
       CAST(round(CAST(sqrt(avg(error * error) FILTER (subset = 4)) AS DECIMAL(38,6)), 2) AS DOUBLE) AS FD004
FROM errors_by_engine GROUP BY 1""")
def _(t: Tables):
    long = acc.accuracy_over_time(t.errors_by_engine).withColumn("metric", C.dataset_label("subset"))
    return acc.as_wide(long, "time", "metric", "rmse", ["FD001", "FD002", "FD003", "FD004"])


@query("penalty_trend", "A11", """
SELECT CAST(date_trunc('hour', submitted_at) AS TIMESTAMP) AS time, 'FD00' || subset AS metric,
       CAST(round(CAST(sum(nasa_penalty) AS DECIMAL(38,6)), 1) AS DOUBLE) AS value FROM errors_by_engine GROUP BY 1, subset""")
def _(t: Tables):
    return acc.accuracy_over_time(t.errors_by_engine).select(
        "time", C.dataset_label("subset").alias("metric"), F.col("nasa_score").alias("value")
    )


@query("error_histogram", "A23", "SELECT floor(error / 5) * 5.0::DOUBLE AS bucket, count(*) AS n FROM errors GROUP BY 1")
def _(t: Tables):
    return acc.error_histogram(t.errors, 5)


@query("error_histogram_auto", "A23", """
SELECT floor(error / w) * w AS bucket, count(*) AS n
FROM errors, (SELECT 2 * (quantile_disc(error, 0.75) - quantile_disc(error, 0.25)) / pow(count(*), 1.0::DOUBLE / 3) AS w FROM errors) width
GROUP BY 1""")
def _(t: Tables):
    return acc.error_histogram(t.errors, acc.histogram_width(t.errors))


@query("evaluation_report", "A29 M5", """
SELECT subset, count(*) AS n_evaluated, round(sqrt(avg(error * error)), 4) AS rmse, round(avg(abs(error)), 4) AS mae,
       round(1 - sum(error * error) / (sum(true_rul * true_rul) - sum(true_rul) * sum(true_rul) / count(*)), 4) AS r2,
       count(*) FILTER (error > 10) AS late, count(*) FILTER (error < -10) AS early
FROM replayed GROUP BY subset""")
def _(t: Tables):
    rows = t.readings.select(*KEYS, "cycle", "s2")
    _errors, report, _rejects = scoring.replay(rows, t.truth_by_rank, t.baseline, ["s2"])
    return rounded(report, 4, "rmse", "mae", "r2").select("subset", "n_evaluated", "rmse", "mae", "r2", "late", "early")


# --- fleet --------------------------------------------------------------------

_SUMMARY_SQL = """
SELECT e.subset, p.health_status, count(DISTINCT e.engine_id) AS engine_count,
       CAST(round(CAST(avg(p.predicted_rul) AS DECIMAL(38,6)), 1) AS DOUBLE) AS avg_predicted_rul,
       CAST(round(CAST(min(p.predicted_rul) AS DECIMAL(38,6)), 1) AS DOUBLE) AS min_predicted_rul
FROM engines e JOIN latest p ON p.engine_id = e.engine_id GROUP BY e.subset, p.health_status"""


@query("fleet_health_summary", "A12", _SUMMARY_SQL)
def _(t: Tables):
    return fleet.fleet_summary(t.predictions, t.engines)


@query("fleet_status_totals", "A13", """
SELECT count(*) FILTER (health_status = 'HEALTHY') AS healthy, count(*) FILTER (health_status = 'WARNING') AS warning,
       count(*) FILTER (health_status = 'CRITICAL') AS critical FROM latest""")
def _(t: Tables):
    return fleet.status_totals(fleet.fleet_summary(t.predictions, t.engines))


@query("status_distribution", "A14", """
SELECT count(*) FILTER (health_status = 'HEALTHY') AS healthy, count(*) FILTER (health_status = 'WARNING') AS warning,
       count(*) FILTER (health_status = 'CRITICAL') AS critical FROM latest""")
def _(t: Tables):
    return fleet.status_counts(fleet.latest_state(t.predictions))


for _status in ("HEALTHY", "WARNING", "CRITICAL"):

    @query(f"engines_{_status.lower()}", "A15 P9", f"SELECT count(*) AS engines FROM latest WHERE health_status = '{_status}'")
    def _(t: Tables, status=_status):
        return fleet.engines_in_status(fleet.latest_state(t.predictions), status)


@query("total_engines", "A16", "SELECT count(DISTINCT engine_id) AS total_engines FROM predictions")
def _(t: Tables):
    return fleet.distinct_engines(t.predictions)


@query("total_engines_estimate", "A16", "SELECT count(DISTINCT engine_id) AS total_engines, TRUE AS within_a_tenth FROM predictions")
def _(t: Tables):
    exact = fleet.distinct_engines(t.predictions)
    estimate = fleet.distinct_engines(t.predictions, approximate=True).withColumnRenamed("total_engines", "estimate")
    near = F.abs(F.col("estimate") - F.col("total_engines")) <= F.col("total_engines") * 0.1
    both = exact.unionByName(estimate, allowMissingColumns=True)  # a row each
    both = both.agg(F.max("total_engines").alias("total_engines"), F.max("estimate").alias("estimate"))
    return both.select("total_engines", near.alias("within_a_tenth"))


@query("total_predictions", "A17", "SELECT count(*) AS n FROM predictions")
def _(t: Tables):
    return fleet.row_count(t.predictions)


@query("total_evaluated", "A17", "SELECT count(*) AS n FROM errors")
def _(t: Tables):
    return fleet.row_count(t.errors)


@query("predictions_per_engine", "A17", "SELECT engine_id, count(*) AS n FROM predictions GROUP BY engine_id")
def _(t: Tables):
    return fleet.row_count(t.predictions, ["engine_id"])


@query("predictions_last_hour", "A18 P7", """
SELECT count(*) AS predictions FROM predictions WHERE predicted_at > (SELECT ts FROM as_of) - INTERVAL 1 HOUR""")
def _(t: Tables):
    return fleet.recent_count(t.predictions, t.as_of)


@query("mean_latest_rul", "A19", "SELECT CAST(round(CAST(avg(predicted_rul) AS DECIMAL(38,6)), 1) AS DOUBLE) AS avg_rul FROM latest")
def _(t: Tables):
    return fleet.mean_rul(fleet.latest_state(t.predictions))


@query("recent_activity", "A20 F6 P7", """
SELECT CAST(date_trunc('minute', predicted_at) AS TIMESTAMP) AS time, count(*) AS predictions FROM predictions
WHERE predicted_at >= (SELECT ts FROM as_of) - INTERVAL 3 HOUR GROUP BY 1""")
def _(t: Tables):
    return fleet.activity(t.predictions, "minute", t.as_of, 3)


@query("activity_per_minute", "A20", """
SELECT CAST(date_trunc('minute', predicted_at) AS TIMESTAMP) AS time, count(*) AS predictions FROM predictions GROUP BY 1""")
def _(t: Tables):
    return fleet.activity(t.predictions)


@query("recent_hourly_rul", "A21 F6 P7", """
SELECT CAST(date_trunc('hour', predicted_at) AS TIMESTAMP) AS time, CAST(round(CAST(avg(predicted_rul) AS DECIMAL(38,6)), 1) AS DOUBLE) AS avg_remaining_life
FROM predictions WHERE predicted_at >= (SELECT ts FROM as_of) - INTERVAL 24 HOUR GROUP BY 1""")
def _(t: Tables):
    return fleet.mean_over_time(t.predictions, as_of=t.as_of, hours=24)


@query("hourly_rul", "A21", """
SELECT CAST(date_trunc('hour', predicted_at) AS TIMESTAMP) AS time, CAST(round(CAST(avg(predicted_rul) AS DECIMAL(38,6)), 1) AS DOUBLE) AS avg_remaining_life
FROM predictions GROUP BY 1""")
def _(t: Tables):
    return fleet.mean_over_time(t.predictions)


@query("rul_brackets", "A22", """
SELECT CASE WHEN predicted_rul <= 5 THEN '0–5   (Critical)' WHEN predicted_rul <= 10 THEN '6–10  (Critical)'
            WHEN predicted_rul <= 20 THEN '11–20 (Warning)' WHEN predicted_rul <= 30 THEN '21–30 (Warning)'
            WHEN predicted_rul <= 36 THEN '31–36 (Healthy)' ELSE '37+   (Healthy)' END AS bracket,
       count(*) AS engines, min(predicted_rul) AS least_rul FROM latest GROUP BY 1""")
def _(t: Tables):
    return fleet.rul_brackets(fleet.latest_state(t.predictions))


@query("mean_latency", "A24", """
SELECT engine_id, CAST(round(CAST(avg(latency_ms) AS DECIMAL(38,6)), 2) AS DOUBLE) AS avg_latency FROM predictions GROUP BY engine_id""")
def _(t: Tables):
    return fleet.mean_latency(t.predictions)


@query("run_summary", "A25", """
SELECT engine_id, count(*) AS total_cycles, arg_max(predicted_rul, cycle) AS final_rul,
       CASE WHEN arg_max(predicted_rul, cycle) <= 10 THEN 'CRITICAL' WHEN arg_max(predicted_rul, cycle) <= 30 THEN 'WARNING' ELSE 'HEALTHY' END AS health_status
FROM predictions GROUP BY engine_id""")
def _(t: Tables):
    return fleet.run_summary(t.predictions, ["engine_id"], "cycle")


@query("run_totals", "A25", """
SELECT model_id, count(*) AS total_predictions, count(DISTINCT engine_id) AS engines_processed, max(cycle) AS time_span_hours
FROM predictions GROUP BY model_id""")
def _(t: Tables):
    return fleet.run_totals(t.predictions, "model_id", "engine_id", "cycle")


@query("statuses_per_dataset", "A26", """
SELECT 'FD00' || model_id AS dataset, count(*) AS engines, array_to_string(list_sort(list(DISTINCT health_status)), ',') AS statuses
FROM latest GROUP BY model_id""")
def _(t: Tables):
    out = fleet.statuses_by_dataset(fleet.latest_state(t.predictions), "model_id")
    return out.withColumn("statuses", F.array_join("statuses", ","))


@query("fleet_statistics", "A30", f"""
SELECT (SELECT count(*) FROM predictions) AS total_predictions,
       (SELECT count(*) FROM predictions WHERE predicted_at > (SELECT ts FROM as_of) - INTERVAL 1 HOUR) AS predictions_last_hour,
       string_agg(subset || ':' || health_status || ':' || engine_count || ':' || avg_predicted_rul || ':' || min_predicted_rul, ';'
                  ORDER BY subset, health_status) AS breakdown
FROM ({_SUMMARY_SQL}) s""")
def _(t: Tables):
    stats = fleet.fleet_statistics(t.predictions, t.engines, t.as_of)
    entry = F.transform(
        "health_breakdown",
        lambda b: F.concat_ws(
            ":", b["subset"], b["health_status"], b["engine_count"], b["avg_predicted_rul"], b["min_predicted_rul"]
        ),
    )
    return stats.select("total_predictions", "predictions_last_hour", F.array_join(entry, ";").alias("breakdown"))


# --- windows ------------------------------------------------------------------


@query("rolling_mean", "W1 T1", """
SELECT subset, unit, cycle, round(s2_rm, 6) AS s2_rm, round(s3_rm, 6) AS s3_rm, round(s15_rm, 6) AS s15_rm FROM features""")
def _(t: Tables):
    rows = t.readings.select(*KEYS, "cycle", "s2", "s3", "s15")
    out = feat.rolling_features(rows, KEYS, "cycle", ["s2", "s3", "s15"], position="cycle")
    return rounded(out, 6, "s2_rm", "s3_rm", "s15_rm").select(*KEYS, "cycle", "s2_rm", "s3_rm", "s15_rm")


@query("rolling_deviation", "W2", """
SELECT subset, unit, cycle, round(s2_rs, 6) AS s2_rs, round(s3_rs, 6) AS s3_rs, round(s15_rs, 6) AS s15_rs FROM features""")
def _(t: Tables):
    rows = t.readings.select(*KEYS, "cycle", "s2", "s3", "s15")
    out = feat.rolling_features(rows, KEYS, "cycle", ["s2", "s3", "s15"], position="cycle")
    return rounded(out, 6, "s2_rs", "s3_rs", "s15_rs").select(*KEYS, "cycle", "s2_rs", "s3_rs", "s15_rs")


_EVERY = S.ALL_SENSORS
_EVERY_SQL = ", ".join(
    f"round(avg({s}) OVER w, 6) AS {s}_rm, round(coalesce(stddev_samp({s}) OVER w, 0), 6) AS {s}_rs" for s in _EVERY
)


@query("rolling_all_sensors", "W1 W2 P2", f"""
SELECT subset, unit, cycle, {_EVERY_SQL} FROM readings
WINDOW w AS (PARTITION BY subset, unit ORDER BY cycle ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def _(t: Tables):
    names = [f"{s}_{k}" for s in _EVERY for k in ("rm", "rs")]
    out = feat.rolling_features(t.readings.select(*KEYS, "cycle", *_EVERY), KEYS, "cycle", _EVERY, position="cycle")
    return rounded(out, 6, *names).select(*KEYS, "cycle", *names)


@query("rolling_on_gapped_rows", "W1 W2", """
SELECT subset, unit, cycle, round(avg(s7) OVER w, 6) AS s7_rm, round(coalesce(stddev_samp(s7) OVER w, 0), 6) AS s7_rs
FROM (SELECT subset, unit, cycle * 3 + event_id % 3 AS cycle, s7 FROM readings) r
WINDOW w AS (PARTITION BY subset, unit ORDER BY cycle ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def _(t: Tables):
    # Cycles are stretched unevenly, so they are no positions and rows are numbered first.
    rows = t.readings.select(*KEYS, (F.col("cycle") * 3 + F.col("event_id") % 3).alias("cycle"), "s7")
    out = feat.rolling_features(rows, KEYS, "cycle", ["s7"])
    return rounded(out, 6, "s7_rm", "s7_rs").select(*KEYS, "cycle", "s7_rm", "s7_rs")


@query("last_values", "W3", """
SELECT subset, unit, max(cycle) AS cycle, arg_max(s2, cycle) FILTER (NOT isnan(s2)) AS s2, arg_max(s4, cycle) FILTER (s4 IS NOT NULL) AS s4
FROM (SELECT subset, unit, recorded_at, event_id, s2, s4, row_number() OVER (PARTITION BY subset, unit ORDER BY recorded_at, event_id) AS cycle
      FROM bad_readings) q GROUP BY subset, unit""")
def _(t: Tables):
    # Cycles repeat in the bad rows, so the rows are renumbered by arrival.
    rows = series.number_rows(
        t.bad_readings.drop("cycle"), KEYS, ["recorded_at", "event_id"], "cycle", at=C.seconds_of("recorded_at")
    )
    return ent.last_values(rows, KEYS, "cycle", ["s2", "s4"])


@query("latest_prediction", "W4", """
SELECT engine_id, prediction_id, cycle, predicted_rul, health_status, predicted_at FROM latest""")
def _(t: Tables):
    return fleet.latest_state(t.predictions).select(
        "engine_id", "prediction_id", "cycle", "predicted_rul", "health_status", "predicted_at"
    )


@query("last_reading", "W5", "SELECT subset, unit, cycle, s2, s3, s21 FROM readings WHERE cycle = n_rows")
def _(t: Tables):
    return ent.latest_row(t.readings, KEYS, ["cycle"]).select(*KEYS, "cycle", "s2", "s3", "s21")


@query("remaining_life", "W6 J2", """
SELECT subset, unit, cycle, least(n_rows - cycle, 125) AS rul, least(n_rows - cycle, 60) AS rul_60 FROM readings""")
def _(t: Tables):
    rows = feat.remaining_life(t.readings.select(*KEYS, "cycle"), KEYS, "cycle")
    return rows.withColumn("rul_60", F.least("rul", F.lit(60)))


@query("life_stages", "W7", "SELECT subset, unit, round(life_fraction, 4) AS life_fraction, max_cycle, cut_cycle FROM life_cuts")
def _(t: Tables):
    return rounded(ent.life_stage_cuts(t.readings, KEYS, "cycle"), 4, "life_fraction")


@query("latest_features", "W1 W2 W3 W5", """
SELECT subset, unit, cycle, s2, round(s2_rm, 6) AS s2_rm, round(s2_rs, 6) AS s2_rs, round(s15_rm, 6) AS s15_rm FROM last_features""")
def _(t: Tables):
    out = feat.latest_features(t.readings, KEYS, "cycle", ["s2", "s15"])
    return rounded(out, 6, "s2_rm", "s2_rs", "s15_rm").select(*KEYS, "cycle", "s2", "s2_rm", "s2_rs", "s15_rm")


# --- sorts and top-k ----------------------------------------------------------


@query("attention_list", "T2 P9 J3", """
SELECT e.unit_number, 'FD00' || e.subset AS dataset, p.cycle, p.predicted_rul, p.health_status, p.predicted_at
FROM latest p JOIN engines e ON e.engine_id = p.engine_id WHERE p.health_status IN ('CRITICAL', 'WARNING')
ORDER BY p.predicted_rul, p.predicted_at, dataset, e.unit_number LIMIT 50""")
def _(t: Tables):
    return fleet.attention_list(fleet.latest_state(t.predictions), t.engines)


@query("prediction_log", "T3", """
SELECT engine_id, prediction_id, predicted_at, cycle, predicted_rul, health_status, latency_ms, endpoint
FROM (SELECT *, row_number() OVER (PARTITION BY engine_id ORDER BY predicted_at DESC, prediction_id DESC) AS r FROM predictions) q WHERE r <= 100""")
def _(t: Tables):
    return fleet.entity_log(t.predictions)


@query("engine_state", "T4", """
SELECT e.unit_number, e.subset, p.predicted_rul, p.health_status, p.cycle, p.n_history_cycles FROM latest p JOIN engines e ON e.engine_id = p.engine_id""")
def _(t: Tables):
    return fleet.of_engine(fleet.latest_state(t.predictions), t.engines).select(
        "unit_number", "subset", "predicted_rul", "health_status", "cycle", "n_history_cycles"
    )


@query("report_head", "T5 F2", """
SELECT subset, unit, predicted_rul, true_rul, round(error, 1) AS error,
       CASE WHEN round(error, 1) > 10 THEN 'LATE' WHEN round(error, 1) < -10 THEN 'EARLY' ELSE 'OK' END AS band
FROM replayed ORDER BY subset, unit LIMIT 20""")
def _(t: Tables):
    rows = t.readings.select(*KEYS, "cycle", "s2")
    scored = scoring.score_latest(rows, t.baseline, ["s2"])
    errors = tr.error_columns(tr.attach_truth_by_rank(scored, t.truth_by_rank, KEYS)[0], round_first=True)
    head = scoring.report_head(errors, n=20)
    return rounded(head, 1, "error").select(*KEYS, "predicted_rul", "true_rul", "error", "band")


@query("random_engines", "T7", """
SELECT subset, unit FROM (SELECT DISTINCT subset, unit FROM readings) q ORDER BY md5(concat_ws('|', subset, unit, 7)), subset, unit LIMIT 10""")
def _(t: Tables):
    return ent.sample_entities(t.readings, KEYS, 10, seed=7)


@query("rul_history", "T8 F13", """
SELECT engine_id, predicted_at AS time, predicted_rul, 10.0::DOUBLE AS critical_threshold, 30.0::DOUBLE AS warning_threshold FROM predictions""")
def _(t: Tables):
    return fleet.entity_series(t.predictions, "predicted_at", ["predicted_rul"], limits=True)


@query("sensor_history", "T8 F16 J10", """
SELECT e.unit_number, e.subset, r.recorded_at AS time, r.s3, r.s4, r.s11, r.s17 FROM readings r JOIN engines e ON e.engine_id = r.engine_id""")
def _(t: Tables):
    rows = fleet.with_engines(t.readings.drop("subset"), t.engines)
    return fleet.entity_series(rows, "recorded_at", ["s3", "s4", "s11", "s17"], ["unit_number", "subset"])


@query("active_datasets", "T9 P10", "SELECT 'FD00' || subset AS dataset FROM registry WHERE is_active")
def _(t: Tables):
    from wearline.plans.dashboards import active_datasets

    return active_datasets(t.registry)


@query("combined_datasets", "U2", """
SELECT subset, count(*) AS n, max(cycle) AS last_cycle FROM readings GROUP BY subset""")
def _(t: Tables):
    one_pass = t.readings.groupBy("subset")
    return one_pass.agg(F.count(F.lit(1)).alias("n"), F.max("cycle").alias("last_cycle"))


# --- scalar functions -----------------------------------------------------------


@query("scalar_functions", "F1 F2 F3 F4 F5 F8 F9 F10 F14", """
SELECT p.prediction_id, p.health_status, CASE WHEN d > 10 THEN 'LATE' WHEN d < -10 THEN 'EARLY' ELSE 'OK' END AS band,
       round(d, 2) AS error, round(abs(d), 2) AS abs_error, least(greatest(d * 10, 0), 125) AS clipped,
       'FD00' || model_id AS dataset, CAST(prediction_id AS VARCHAR) AS id_text, CAST(nullif(cycle, 1) AS DOUBLE) AS not_first,
       CASE WHEN cycle < 30 THEN 'Single snapshot: trailing features are approximate' ELSE '' END AS note
FROM (SELECT *, predicted_rul - true_life AS d FROM predictions) p""")
def _(t: Tables):
    d = F.col("predicted_rul") - F.col("true_life")
    return t.predictions.select(
        "prediction_id",
        C.health_status("predicted_rul").alias("health_status"),
        C.error_band(d).alias("band"),
        F.round(d, 2).alias("error"),
        F.round(F.abs(d), 2).alias("abs_error"),
        C.clip_rul(d * 10).alias("clipped"),
        C.dataset_label("model_id").alias("dataset"),
        F.col("prediction_id").cast("string").alias("id_text"),
        F.nullif("cycle", F.lit(1)).cast("double").alias("not_first"),
        C.short_history_note("cycle").alias("note"),
    )


@query("backdated_times", "F7", """
SELECT subset, unit, cycle, (SELECT ts FROM as_of) - (max(cycle) OVER (PARTITION BY subset) - cycle) * INTERVAL 1 HOUR AS predicted_at FROM readings""")
def _(t: Tables):
    rows = t.readings.select(*KEYS, "cycle", "s2")
    return scoring.score_history(rows, t.baseline, t.as_of, ["s2"], position="cycle").select(*KEYS, "cycle", "predicted_at")


@query("sensor_values_long", "F16 F17", """
SELECT event_id, sensor, value, CASE sensor WHEN 's2' THEN 'Fan Inlet Temp (°R)' WHEN 's9' THEN 'Core Speed (rpm)'
       WHEN 's12' THEN 'Ratio Fan P / T (—)' WHEN 's20' THEN 'LP Turbine Cool Air Flow (lbm/s)' WHEN 's21' THEN 'Fan Speed Demand (rpm)' END AS label
FROM (UNPIVOT (SELECT event_id, s2, s9, s12, s20, s21 FROM readings) ON s2, s9, s12, s20, s21 INTO NAME sensor VALUE value) u""")
def _(t: Tables):
    return fleet.sensor_long(t.readings, ["s2", "s9", "s12", "s20", "s21"], ["event_id"])


# --- models ----------------------------------------------------------------------


@query("column_ranges", "A27 M1", """
SELECT subset, min(s2) AS s2_min, min(setting_3) AS setting_3_min, min(s15) AS s15_min, max(s2) AS s2_max,
       max(setting_3) AS setting_3_max, max(s15) AS s15_max FROM readings GROUP BY subset""")
def _(t: Tables):
    return feat.fit_minmax(t.readings, ["s2", "setting_3", "s15"], ["subset"])


@query("scaled_values", "F12 M1", """
SELECT r.event_id, round((r.s2 - m.lo) / CASE WHEN m.hi = m.lo THEN 1 ELSE m.hi - m.lo END, 6) AS s2,
       CASE WHEN m.lo IS NOT NULL THEN 0.0::DOUBLE END AS setting_3
FROM readings r LEFT JOIN (SELECT subset, min(s2) AS lo, max(s2) AS hi FROM readings WHERE event_id % 2 = 0 GROUP BY subset) m ON m.subset = r.subset""")
def _(t: Tables):
    # Ranges come from half of the rows, so some of the rest scale beyond [0, 1].
    train = t.readings.filter("event_id % 2 = 0")
    ranges = feat.fit_minmax(train, ["s2", "setting_3"], ["subset"])
    rows = t.readings.select("event_id", "subset", "s2", "setting_3")
    return rounded(feat.apply_minmax(rows, ranges, ["s2", "setting_3"], ["subset"]), 6, "s2").drop("subset")


@query("snapshot_scores", "M3 M6", """
SELECT CAST(r.unit AS INTEGER) AS engine_id, r.subset, CAST(r.cycle AS INTEGER) AS cycle, round(least(greatest(b.intercept + b.slope * (r.cycle + r.s2), 0), 125), 1) AS predicted_rul,
       CASE WHEN r.cycle < 30 THEN 'Single snapshot: trailing features are approximate' ELSE '' END AS note
FROM readings r JOIN baseline b ON b.subset = r.subset""")
def _(t: Tables):
    rows = req.parse_requests(t.batch_requests, "batch")
    return scoring.score_snapshots(rows, t.baseline).select("engine_id", "subset", "cycle", "predicted_rul", "note")


@query("sequence_scores", "M7 V4", """
SELECT CAST(v.unit AS INTEGER) AS engine_id, v.subset, v.chunk, CAST(v.cycles[-1] AS INTEGER) AS cycle, len(v.cycles) AS n_history_cycles,
       round(least(greatest(b.intercept + b.slope * (v.cycles[-1] + list_avg(v.vals[-30:])), 0), 125), 1) AS predicted_rul
FROM sequence_verdicts v JOIN baseline b ON b.subset = v.subset WHERE v.reason IS NULL""")
def _(t: Tables):
    scored, _rejects = scoring.score_sequences(req.parse_requests(t.sequence_requests, "sequence"), t.baseline)
    return scored.select(
        "engine_id", "subset", "chunk", "cycle", F.col("n_history_cycles").cast("long").alias("n_history_cycles"), "predicted_rul"
    )


@query("history_scores", "M8", """
SELECT f.subset, f.unit, f.cycle, round(least(greatest(b.intercept + b.slope * (f.cycle + f.s2_rm), 0), 125), 1) AS predicted_rul,
       f.cycle AS n_history_cycles,
       (SELECT ts FROM as_of) - (max(f.cycle) OVER (PARTITION BY f.subset) - f.cycle) * INTERVAL 1 HOUR AS predicted_at
FROM features f JOIN baseline b ON b.subset = f.subset""")
def _(t: Tables):
    rows = t.readings.select(*KEYS, "cycle", "s2")
    out = scoring.score_history(rows, t.baseline, t.as_of, ["s2"], position="cycle")
    return out.select(*KEYS, "cycle", "predicted_rul", "n_history_cycles", "predicted_at")


@query("life_stage_scores", "M9 W7 J9", """
SELECT c.subset, c.unit, CAST(round(c.life_fraction * 100) AS BIGINT) AS snapshot_pct, c.cut_cycle AS snapshot_cycle, c.max_cycle,
       round(least(greatest(b.intercept + b.slope * (f.cycle + f.s2_rm), 0), 125), 1) AS predicted_rul
FROM life_cuts c JOIN features f ON f.subset = c.subset AND f.unit = c.unit AND f.cycle = c.cut_cycle JOIN baseline b ON b.subset = c.subset""")
def _(t: Tables):
    return scoring.score_life_stages(t.readings, t.baseline, sensors=["s2"]).drop("health_status")


@query("replayed_errors", "M10 M5 J1", """
SELECT subset, unit, predicted_rul, true_rul, round(error, 4) AS error,
       round(CASE WHEN error < 0 THEN exp(-error / 13) - 1 ELSE exp(error / 10) - 1 END, 2) AS nasa_penalty,
       CASE WHEN error > 10 THEN 'LATE' WHEN error < -10 THEN 'EARLY' ELSE 'OK' END AS band FROM replayed""")
def _(t: Tables):
    rows = t.readings.select(*KEYS, "cycle", "s2")
    errors, _report, _rejects = scoring.replay(rows, t.truth_by_rank, t.baseline, ["s2"])
    out = errors.select(*KEYS, "predicted_rul", "true_rul", "error", "nasa_penalty", "band")
    return rounded(rounded(out, 4, "error"), 2, "nasa_penalty")


@query("training_benchmarks", "M12 M11", """
SELECT 'FD00' || subset AS dataset, model_id, model_version, algorithm, train_rmse, train_mae, train_r2, train_nasa_score, trained_at
FROM registry WHERE is_active""")
def _(t: Tables):
    from wearline.plans.dashboards import training_benchmarks

    return training_benchmarks(t.registry)


@query("ground_truth_scoring", "M13 J7 K5 F2 F4", """
SELECT prediction_id, predicted_rul, true_rul, round(error, 2) AS error, round(abs_error, 2) AS abs_error, round(nasa_penalty, 4) AS nasa_penalty,
       CASE WHEN error > 10 THEN 'LATE' WHEN error < -10 THEN 'EARLY' ELSE 'OK' END AS status FROM errors""")
def _(t: Tables):
    return tr.rounded_errors(t.errors)


def fit_trees(t: Tables):
    """The product model with all its trees, fitted on all rows under the product's limit."""
    return scoring.train(t.readings, position="cycle")


@query("tree_importances", "M2 M4 A28 T6", """
SELECT DISTINCT subset, 5 AS n_features, TRUE AS all_positive, TRUE AS at_most_one FROM readings""")
def _(t: Tables):
    from wearline.operators.model import importances

    top = importances(t.spark, fit_trees(t))
    return top.groupBy("subset").agg(
        F.countDistinct("feature").cast("int").alias("n_features"),
        F.min(F.col("importance") >= 0).alias("all_positive"),
        (F.sum("importance") <= 1 + 1e-9).alias("at_most_one"),
    )


@query("tree_scores", "M2 M3 M4 M5 K8", """
SELECT subset, unit, max(cycle) AS cycle, TRUE AS in_range, TRUE AS status_fits FROM readings GROUP BY subset, unit""")
def _(t: Tables):
    from wearline.operators.model import load_model, save_model
    from wearline.plans.streams import run_folder

    # What trees predict has no SQL twin; what must hold of it for every engine has.
    path = run_folder(t.spark)
    save_model(t.spark, fit_trees(t), path)
    # Every dataset's part reads the rows twice; they are numbered once.
    readings = store.written(t.readings.select(*KEYS, "cycle", *S.ALL_SENSORS))
    scored = scoring.score_latest(readings, load_model(t.spark, path))
    in_range = F.coalesce(F.col("predicted_rul").between(0, S.RUL_CAP), F.lit(False))
    fits = F.col("health_status") == C.health_status("predicted_rul")
    return scored.select(*KEYS, "cycle", in_range.alias("in_range"), fits.alias("status_fits"))


_CARDS = ", ".join(
    f"({k}, {len(S.SENSORS[k])}, {len(S.feature_columns(S.SENSORS[k]))})" for k in S.SUBSETS
)


@query("model_cards", "M11", f"""
SELECT 'FD00' || k AS dataset, CAST(n AS INTEGER) AS n_sensors, {S.RUL_CAP} AS rul_cap, {S.WINDOW} AS "window",
       CAST(f AS INTEGER) AS n_features, 4 AS n_metrics
FROM (VALUES {_CARDS}) v(k, n, f) WHERE k IN (SELECT subset FROM readings)""")
def _(t: Tables):
    from wearline.operators.model import model_card

    model = scoring.evaluate(fit_trees(t), t.readings, t.truth_by_rank)
    return model_card(t.spark, model).select(
        "dataset", F.size("sensors").alias("n_sensors"), "rul_cap", "window", "n_features",
        F.size("metrics").alias("n_metrics"),
    )


#: Bin edges of the one-split tree below.
CYCLE_EDGES, S2_EDGES = list(range(2, 60, 3)), [5.0 * i for i in range(1, 120)]


@query("one_split_trees", "M2 M3 A28", f"""
SELECT * FROM (WITH rows AS (SELECT event_id, subset, CAST(cycle AS DOUBLE) AS cycle, s2, CAST(least(n_rows - cycle, 125) AS DOUBLE) AS rul FROM readings),
base AS (SELECT subset, avg(rul) AS base, CAST(count(*) AS DOUBLE) AS n FROM rows GROUP BY subset),
cuts AS (SELECT 0 AS feature, CAST(unnest({CYCLE_EDGES}) AS DOUBLE) AS cut, generate_subscripts({CYCLE_EDGES}, 1) AS bin
         UNION ALL SELECT 1, unnest({S2_EDGES}), generate_subscripts({S2_EDGES}, 1)),
sides AS (SELECT c.feature, c.cut, c.bin, r.subset, sum(b.base - r.rul) AS g, CAST(count(*) AS DOUBLE) AS n,
                 coalesce(sum(b.base - r.rul) FILTER (CASE c.feature WHEN 0 THEN r.cycle ELSE r.s2 END <= c.cut), 0) AS gl,
                 CAST(count(*) FILTER (CASE c.feature WHEN 0 THEN r.cycle ELSE r.s2 END <= c.cut) AS DOUBLE) AS nl
          FROM rows r JOIN base b ON b.subset = r.subset CROSS JOIN cuts c GROUP BY c.feature, c.cut, c.bin, r.subset),
best AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY round(gl * gl / (nl + 1) + (g - gl) * (g - gl) / (n - nl + 1) - g * g / (n + 1), 6) DESC,
                                      feature, bin) AS rn FROM sides WHERE nl >= 1 AND n - nl >= 1)
SELECT r.event_id, r.subset, round(b.base - 0.5 * CASE WHEN CASE s.feature WHEN 0 THEN r.cycle ELSE r.s2 END <= s.cut
       THEN s.gl / (s.nl + 1) ELSE (s.g - s.gl) / (s.n - s.nl + 1) END, 6) AS prediction
FROM rows r JOIN base b ON b.subset = r.subset JOIN best s ON s.subset = r.subset AND s.rn = 1) q""")
def _(t: Tables):
    # Threshold and both leaf values of one split in each dataset, by what they predict for every row.
    import numpy as np

    from wearline.operators import boosting

    rows = t.readings.select(
        "event_id", "subset", F.col("cycle").cast("double").alias("cycle"), "s2", F.least(F.col("n_rows") - F.col("cycle"), F.lit(125)).alias("rul")
    )
    edges = {k: [np.array(CYCLE_EDGES, float), np.array(S2_EDGES)] for k in S.SUBSETS}
    params = {"trees": 1, "depth": 1, "rate": 0.5, "l2": 1.0, "columns": 1.0, "rows": 1.0}
    model = boosting.fit_boosted(rows, ["cycle", "s2"], "rul", "subset", params, edges=edges)
    return rounded(model.predict(rows), 6, "prediction").select("event_id", "subset", "prediction")


@query("boosted_scores", "M2 M3 M5 K8", """
SELECT subset, unit, max(cycle) AS cycle, TRUE AS in_range, TRUE AS status_fits, TRUE AS better_than_mean FROM readings GROUP BY subset, unit""")
def _(t: Tables):
    from wearline.operators import boosting
    from wearline.plans.streams import run_folder

    labelled = feat.remaining_life(t.readings, KEYS, "cycle", S.RUL_CAP)
    rows = store.materialised(feat.rolling_features(labelled, KEYS, "cycle", ["s2", "s4"], position="cycle"))
    names = ["s2", "s4", "s2_rm", "s4_rm", "s2_rs", "s4_rs", "cycle"]
    params = {"trees": 10, "depth": 3, "rate": 0.3}
    path = run_folder(t.spark)
    boosting.save_boosted(t.spark, boosting.fit_boosted(rows, names, "rul", "subset", params), path)
    model = boosting.load_boosted(t.spark, path)
    error, mean = (F.col("prediction") - F.col("rul")) ** 2, F.var_pop("rul")
    better = model.predict(rows).groupBy("subset").agg((F.avg(error) <= mean).alias("better_than_mean"))
    scored = scoring.score_latest(t.readings, model, ["s2", "s4"])
    in_range = F.coalesce(F.col("predicted_rul").between(0, S.RUL_CAP), F.lit(False))
    fits = F.col("health_status") == C.health_status("predicted_rul")
    return scored.join(better, "subset").select(*KEYS, "cycle", in_range.alias("in_range"), fits.alias("status_fits"), "better_than_mean")


@query("last_alert_before", "J9", """
SELECT r.event_id, coalesce(a.event_id, -1) AS alert_id, coalesce(a.health_status, '') AS alert
FROM (SELECT event_id, engine_id, recorded_at FROM readings) r
ASOF LEFT JOIN (SELECT event_id, p.engine_id, p.predicted_at, p.health_status FROM predictions p JOIN readings q ON q.event_id = p.prediction_id
                WHERE p.health_status <> 'HEALTHY') a
ON a.engine_id = r.engine_id AND r.recorded_at >= a.predicted_at""")
def _(t: Tables):
    alerts = t.predictions.filter("health_status <> 'HEALTHY'").select(
        "engine_id", F.col("prediction_id").alias("alert_id"), "predicted_at", F.col("health_status").alias("alert")
    )
    rows = t.readings.select("event_id", "engine_id", "recorded_at")
    joined = asof.asof_join(rows, alerts, ["engine_id"], "recorded_at", "predicted_at", ["alert_id"])
    return joined.select("event_id", F.coalesce("alert_id", F.lit(-1)).alias("alert_id"), F.coalesce("alert", F.lit("")).alias("alert"))


@query("distinct_engines_any_window", "A16 A20", """
SELECT 'hour' AS unit, CAST(date_trunc('hour', predicted_at) AS TIMESTAMP) AS time, count(DISTINCT engine_id) AS engines FROM predictions GROUP BY 2
UNION ALL
SELECT 'day', CAST(date_trunc('day', predicted_at) AS TIMESTAMP), count(DISTINCT engine_id) FROM predictions GROUP BY 2
UNION ALL
SELECT 'month', CAST(date_trunc('month', predicted_at) AS TIMESTAMP), count(DISTINCT engine_id) FROM predictions GROUP BY 2""")
def _(t: Tables):
    # One stored table of sketches by minute answers all three.
    from wearline.plans.streams import run_folder

    path = f"{run_folder(t.spark)}/sketches"
    fleet.engine_sketches(t.predictions, []).write.parquet(path)
    stored = t.spark.read.parquet(path)
    parts = [fleet.engines_from_sketches(stored, unit).select(F.lit(unit).alias("unit"), "time", "engines") for unit in ("hour", "day", "month")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
