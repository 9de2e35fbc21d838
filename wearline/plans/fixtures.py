"""Stored tables derived from the driver's tables (see FIXTURES.md), in Spark
and as SQL. Each pair defines the same rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline import schema as S
from wearline.functions import columns as C
from wearline.operators import features as feat
from wearline.operators import series
from wearline.operators import truth as tr

# Modulus of event_id behind each made-up sensor.
MODULI = {"s4": 97, "s7": 89, "s8": 83, "s9": 79, "s11": 73, "s12": 71, "s13": 67, "s14": 61, "s15": 59,
          "s17": 53, "s20": 47, "s21": 43}
ENDPOINTS = ["/predict", "/predict/batch", "/predict/sequence"]
BASELINE_CAP = 60
REQUEST_ROWS = 40
BATCH_ROWS = 20


class Baseline:
    """Linear stand-in for the trees, so that scoring can be checked in SQL:
    per subset, remaining life regressed on cycle + trailing mean of s2."""

    def __init__(self, coefficients: DataFrame):
        self.coefficients = coefficients

    @staticmethod
    def fit(rows: DataFrame) -> Baseline:
        x = F.col("cycle") + F.col("s2_rm")
        fitted = rows.groupBy("subset").agg(
            F.regr_slope("rul", x).alias("_slope"), F.regr_intercept("rul", x).alias("_intercept")
        )
        return Baseline(series.checked_broadcast(fitted))

    def predict(self, df: DataFrame) -> DataFrame:
        x = F.col("cycle") + F.col("s2_rm")
        joined = df.join(self.coefficients, "subset")
        return joined.withColumn("prediction", F.col("_intercept") + F.col("_slope") * x).drop("_slope", "_intercept")


class Tables:
    """The fixture tables of one scale folder, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._sources = {}

    def source(self, name: str) -> DataFrame:
        if name not in self._sources:
            self._sources[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._sources[name]

    @cached_property
    def as_of(self):
        """"Now": the newest event."""
        return self.source("events").agg(F.max("ts")).first()[0]

    @cached_property
    def readings(self) -> DataFrame:
        events = self.source("events").select("event_id", "ts", "user_id", "value", "props")
        numbered = series.number_rows(
            events, ["user_id"], ["ts", "event_id"], out="cycle", total="n_rows", at=C.seconds_of("ts")
        )
        eid = F.col("event_id")
        subset = (F.col("user_id") % 4 + 1).cast("int")
        sensors = {s: (eid % m).cast("double") for s, m in MODULI.items()}
        sensors["s15"] = F.when(subset != 1, sensors["s15"])
        return numbered.select(
            "event_id",
            (F.col("user_id") + 1).alias("unit"),
            subset.alias("subset"),
            (F.col("user_id") * 10 + subset).alias("engine_id"),
            "cycle",
            "n_rows",
            ((eid % 7).cast("double") / 10).alias("setting_1"),
            ((eid % 11).cast("double") / 100).alias("setting_2"),
            F.lit(100.0).alias("setting_3"),
            F.col("value").alias("s2"),
            F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("s3"),
            *[c.alias(s) for s, c in sensors.items()],
            F.col("ts").alias("recorded_at"),
        )

    @cached_property
    def engines(self) -> DataFrame:
        subset = (F.col("user_id") % 4 + 1).cast("int")
        return (
            self.source("events")
            .select("user_id")
            .distinct()
            .select(
                (F.col("user_id") * 10 + subset).alias("engine_id"),
                (F.col("user_id") + 1).alias("unit_number"),
                subset.alias("subset"),
            )
        )

    @cached_property
    def predictions(self) -> DataFrame:
        # Every reading is a prediction. The stage of life differs by unit, and the truth is the
        # prediction less a small error, so that penalties stay comparable at any length of life.
        r = self.readings
        error = F.col("event_id") % 41 - 20
        life = F.col("n_rows") - F.col("cycle") + (F.col("unit") - 1) % 5 * 25
        predicted = F.least(F.greatest(life + error, F.lit(0)), F.lit(S.RUL_CAP))
        true = F.greatest(predicted - error, F.lit(0))
        pick = (F.col("event_id") % 3).cast("int")
        return r.select(
            F.col("event_id").alias("prediction_id"),
            F.concat(F.lit("r"), (F.col("event_id") % 1000).cast("string")).alias("request_id"),
            "engine_id",
            F.col("subset").alias("model_id"),
            "cycle",
            F.col("cycle").alias("n_history_cycles"),
            true.alias("true_life"),
            predicted.cast("double").alias("predicted_rul"),
            F.lit(S.RUL_CAP).alias("rul_cap"),
            F.get(F.array(*[F.lit(e) for e in ENDPOINTS]), pick).alias("endpoint"),
            F.col("s2").alias("latency_ms"),
            F.col("recorded_at").alias("predicted_at"),
        ).withColumn("health_status", C.health_status("predicted_rul"))

    @cached_property
    def truths(self) -> DataFrame:
        """Submissions: first, repeated a day later with another value, unknown ids."""
        p = self.predictions.select("prediction_id", "true_life", "predicted_at")
        pid = F.col("prediction_id")
        copies = F.array_compact(
            F.array(
                F.when(pid % 3 != 0, F.struct(pid.alias("id"), F.lit(0).alias("late"))),
                F.when(pid % 5 == 0, F.struct(pid.alias("id"), F.lit(1).alias("late"))),
                F.when(pid % 100 == 0, F.struct((pid + 10**12).alias("id"), F.lit(0).alias("late"))),
            )
        )
        late = F.col("_t.late")
        return p.withColumn("_t", F.explode(copies)).select(
            F.col("_t.id").alias("prediction_id"),
            (F.col("true_life") + late).cast("double").alias("true_rul"),
            F.when(late == 1, F.timestamp_add("DAY", F.lit(1), F.col("predicted_at")))
            .otherwise(F.col("predicted_at"))
            .cast("timestamp_ntz")
            .alias("submitted_at"),
        )

    @cached_property
    def errors(self) -> DataFrame:
        return tr.score_truths(self.predictions, self.truths, ["engine_id"])[0]

    @cached_property
    def errors_by_engine(self) -> DataFrame:
        """Error rows with the subset of their engine."""
        return self.errors.join(self.engines.select("engine_id", "subset"), "engine_id")

    @cached_property
    def registry(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.source("nation").select(
            n.alias("model_id"),
            (n % 4 + 1).alias("subset"),
            F.concat(F.lit("model "), "n_name").alias("description"),
            (n % 3 != 0).alias("is_active"),
            F.timestamp_add("DAY", n, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).cast("timestamp_ntz").alias("trained_at"),
            F.concat(F.lit("v0-"), n.cast("string")).alias("model_version"),
            F.lit("XGBoost").alias("algorithm"),
            (n * 1.5).cast("double").alias("train_rmse"),
            (n * 1.0).cast("double").alias("train_mae"),
            (1 - n / 100).cast("double").alias("train_r2"),
            (n * 10.0).cast("double").alias("train_nasa_score"),
        )

    @cached_property
    def bad_readings(self) -> DataFrame:
        kind = F.col("event_id") % 50
        r = self.readings
        return r.withColumns(
            {
                "s2": F.when(kind == 1, float("nan")).otherwise(F.col("s2")),
                "s3": F.when(kind == 2, float("inf")).otherwise(F.col("s3")),
                "s4": F.when(kind != 3, F.col("s4")),
                "cycle": F.when(kind == 4, F.lit(0)).when(kind == 6, F.col("cycle") - 1).when(kind == 7, F.col("cycle") + 1)
                .otherwise(F.col("cycle")),
                "subset": F.when(kind == 5, F.lit(9)).otherwise(F.col("subset")),
            }
        )

    @cached_property
    def baseline(self) -> Baseline:
        rows = feat.remaining_life(
            self.readings.select("subset", "unit", "cycle", "s2"), S.SERIES_KEYS, "cycle", BASELINE_CAP
        )
        return Baseline.fit(feat.rolling_features(rows, S.SERIES_KEYS, "cycle", ["s2"], position="cycle"))

    @cached_property
    def truth_by_rank(self) -> DataFrame:
        """Positional truth of each dataset: row i is the i-th engine by unit."""
        ranked = series.number_rows(self.engines, ["subset"], ["unit_number"], out="unit_rank")
        return ranked.select("subset", "unit_rank", (F.col("unit_number") * 7 % 150).cast("double").alias("true_rul"))

    def _request_rows(self, size: int) -> DataFrame:
        row = F.struct("cycle", *S.SETTINGS, *S.ALL_SENSORS)
        return self.readings.groupBy(
            "subset", F.col("unit").alias("engine_id"), F.expr(f"(cycle - 1) DIV {size}").alias("chunk")
        ).agg(F.array_sort(F.collect_list(row)).alias("history"))

    @cached_property
    def sequence_requests(self) -> DataFrame:
        """JSON histories of up to 40 cycles; some reversed, repeating or gapped."""
        kind = (F.col("engine_id") + F.col("chunk")) % 7
        h = F.col("history")
        altered = (
            F.when(kind == 1, F.reverse(h))
            .when(kind == 2, F.concat(h, F.slice(h, 1, 1)))
            .when(kind == 3, F.concat(F.slice(h, 1, 1), F.slice(h, F.lit(3), F.greatest(F.size(h) - 2, F.lit(0)))))
            .otherwise(h)
        )
        rows = self._request_rows(REQUEST_ROWS).withColumn("history", altered)
        return rows.select("chunk", F.to_json(F.struct("subset", "engine_id", "history")).alias("value"))

    @cached_property
    def batch_requests(self) -> DataFrame:
        """JSON batches of up to 20 snapshots of one engine."""
        rows = self._request_rows(BATCH_ROWS)
        instances = F.transform(
            "history",
            lambda r: F.struct(
                F.col("subset"), F.col("engine_id"), *[r[c].alias(c) for c in ["cycle", *S.SETTINGS, *S.ALL_SENSORS]]
            ),
        )
        return rows.select("engine_id", "chunk", F.to_json(F.struct(instances.alias("instances"))).alias("value")).select(
            F.col("engine_id").alias("sender"), "chunk", "value"
        )

    @cached_property
    def log_lines(self) -> DataFrame:
        """Sensor rows as text with one or two blanks and a trailing blank."""
        gap = F.when(F.col("event_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("  "))
        cols = ["unit", "cycle", *S.SETTINGS, "s2", "s3", "s4"]
        first, *rest = [F.col(c).cast("string") for c in cols]
        pieces = [first] + [x for c in rest for x in (gap, c)]
        return self.readings.select("event_id", F.concat(*pieces, F.lit(" ")).alias("value"))


_SENSOR_SQL = ", ".join(
    f"CASE WHEN user_id % 4 <> 0 THEN CAST(event_id % {m} AS DOUBLE) END AS {s}"
    if s == "s15"
    else f"CAST(event_id % {m} AS DOUBLE) AS {s}"
    for s, m in MODULI.items()
)

# SQL twins, in dependency order.
CTES = {
    "readings": f"""
  SELECT event_id, user_id + 1 AS unit, CAST(user_id % 4 + 1 AS INTEGER) AS subset,
         user_id * 10 + user_id % 4 + 1 AS engine_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle,
         count(*) OVER (PARTITION BY user_id) AS n_rows,
         (event_id % 7)::DOUBLE / 10 AS setting_1, (event_id % 11)::DOUBLE / 100 AS setting_2,
         100.0::DOUBLE AS setting_3, value AS s2,
         CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS s3, {_SENSOR_SQL}, ts AS recorded_at
  FROM events""",
    "engines": """
  SELECT DISTINCT user_id * 10 + user_id % 4 + 1 AS engine_id, user_id + 1 AS unit_number,
         CAST(user_id % 4 + 1 AS INTEGER) AS subset
  FROM events""",
    "predictions": """
  SELECT *, CASE WHEN predicted_rul <= 10 THEN 'CRITICAL' WHEN predicted_rul <= 30 THEN 'WARNING' ELSE 'HEALTHY' END
         AS health_status
  FROM (SELECT event_id AS prediction_id, 'r' || (event_id % 1000) AS request_id, engine_id, subset AS model_id, cycle,
               cycle AS n_history_cycles, CAST(greatest(predicted - (event_id % 41 - 20), 0) AS BIGINT) AS true_life,
               CAST(predicted AS DOUBLE) AS predicted_rul,
               125 AS rul_cap,
               CASE event_id % 3 WHEN 0 THEN '/predict' WHEN 1 THEN '/predict/batch' ELSE '/predict/sequence' END AS endpoint,
               s2 AS latency_ms, recorded_at AS predicted_at
        FROM (SELECT *, least(greatest(n_rows - cycle + (unit - 1) % 5 * 25 + event_id % 41 - 20, 0), 125) AS predicted
              FROM readings) r) q""",
    "truths": """
  SELECT prediction_id, CAST(true_life AS DOUBLE) AS true_rul, predicted_at AS submitted_at FROM predictions WHERE prediction_id % 3 <> 0
  UNION ALL
  SELECT prediction_id, CAST(true_life + 1 AS DOUBLE), predicted_at + INTERVAL 1 DAY FROM predictions WHERE prediction_id % 5 = 0
  UNION ALL
  SELECT prediction_id + 1000000000000, CAST(true_life AS DOUBLE), predicted_at FROM predictions WHERE prediction_id % 100 = 0""",
    "first_truths": """
  SELECT prediction_id, true_rul, submitted_at
  FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY submitted_at, true_rul) AS rn FROM truths) q WHERE rn = 1""",
    "errors": """
  SELECT p.prediction_id, p.predicted_rul, t.true_rul, t.submitted_at, p.predicted_rul - t.true_rul AS error,
         abs(p.predicted_rul - t.true_rul) AS abs_error,
         CASE WHEN p.predicted_rul < t.true_rul THEN exp(-(p.predicted_rul - t.true_rul) / 13) - 1
              ELSE exp((p.predicted_rul - t.true_rul) / 10) - 1 END AS nasa_penalty, p.engine_id
  FROM predictions p JOIN first_truths t ON t.prediction_id = p.prediction_id""",
    "errors_by_engine": "SELECT x.*, e.subset FROM errors x JOIN engines e ON e.engine_id = x.engine_id",
    "registry": """
  SELECT n_nationkey AS model_id, n_nationkey % 4 + 1 AS subset, 'model ' || n_name AS description, n_nationkey % 3 <> 0 AS is_active,
         TIMESTAMP '2024-01-01 00:00:00' + n_nationkey * INTERVAL 1 DAY AS trained_at, 'v0-' || n_nationkey AS model_version,
         'XGBoost' AS algorithm, n_nationkey * 1.5::DOUBLE AS train_rmse, CAST(n_nationkey AS DOUBLE) AS train_mae,
         1 - n_nationkey / 100.0::DOUBLE AS train_r2, n_nationkey * 10.0::DOUBLE AS train_nasa_score
  FROM nation""",
    "as_of": "SELECT max(ts) AS ts FROM events",
    "latest": """
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY engine_id ORDER BY predicted_at DESC, prediction_id DESC) AS rn
  FROM predictions) q WHERE rn = 1""",
    "bad_readings": """
  SELECT event_id, unit, CASE WHEN event_id % 50 = 5 THEN 9 ELSE subset END AS subset,
         CASE event_id % 50 WHEN 4 THEN 0 WHEN 6 THEN cycle - 1 WHEN 7 THEN cycle + 1 ELSE cycle END AS cycle,
         setting_1, setting_2, setting_3,
         CASE WHEN event_id % 50 = 1 THEN 'nan'::DOUBLE ELSE s2 END AS s2,
         CASE WHEN event_id % 50 = 2 THEN 'inf'::DOUBLE ELSE s3 END AS s3,
         CASE WHEN event_id % 50 <> 3 THEN s4 END AS s4, s7, s15, recorded_at
  FROM readings""",
    "features": """
  SELECT subset, unit, engine_id, cycle, n_rows, event_id, s2, s3, s4, s15, recorded_at, least(n_rows - cycle, 60) AS rul,
         avg(s2) OVER w AS s2_rm, coalesce(stddev_samp(s2) OVER w, 0) AS s2_rs,
         avg(s3) OVER w AS s3_rm, coalesce(stddev_samp(s3) OVER w, 0) AS s3_rs,
         avg(s15) OVER w AS s15_rm, coalesce(stddev_samp(s15) OVER w, 0) AS s15_rs
  FROM readings WINDOW w AS (PARTITION BY subset, unit ORDER BY cycle ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "baseline": """
  SELECT subset, regr_slope(rul, cycle + s2_rm) AS slope, regr_intercept(rul, cycle + s2_rm) AS intercept FROM features GROUP BY subset""",
    "life_cuts": """
  SELECT subset, unit, life_fraction, max_cycle, greatest(1, CAST(round_even(life_fraction * max_cycle, 0) AS BIGINT)) AS cut_cycle
  FROM (SELECT subset, unit, max_cycle,
               CASE WHEN n = 5 THEN [0.20, 0.30, 0.42, 0.52, 0.80][r]::DOUBLE WHEN n = 1 THEN 0.40::DOUBLE
                    ELSE 0.20::DOUBLE + 0.60::DOUBLE / (n - 1) * (r - 1) END AS life_fraction
        FROM (SELECT subset, unit, max(cycle) AS max_cycle, row_number() OVER (PARTITION BY subset ORDER BY unit) AS r,
                     count(*) OVER (PARTITION BY subset) AS n
              FROM readings GROUP BY subset, unit) q) q2""",
    "truth_by_rank": """
  SELECT subset, row_number() OVER (PARTITION BY subset ORDER BY unit_number) AS unit_rank, CAST(unit_number * 7 % 150 AS DOUBLE) AS true_rul
  FROM engines""",
    "ranks": """
  SELECT subset, unit_number AS unit, row_number() OVER (PARTITION BY subset ORDER BY unit_number) AS unit_rank FROM engines""",
    "last_features": """
  SELECT f.* FROM features f WHERE f.cycle = f.n_rows""",
    "scored_last": """
  SELECT f.subset, f.unit, f.cycle, round(least(greatest(b.intercept + b.slope * (f.cycle + f.s2_rm), 0), 125), 1) AS predicted_rul
  FROM last_features f JOIN baseline b ON b.subset = f.subset""",
    "replayed": """
  SELECT s.subset, s.unit, s.cycle, s.predicted_rul, t.true_rul, t.unit_rank, s.predicted_rul - t.true_rul AS error
  FROM scored_last s JOIN ranks r ON r.subset = s.subset AND r.unit = s.unit
  JOIN truth_by_rank t ON t.subset = r.subset AND t.unit_rank = r.unit_rank""",
    "sequences": """
  SELECT subset, unit, chunk,
         CASE (unit + chunk) % 7 WHEN 1 THEN list_reverse(cycles) WHEN 2 THEN list_concat(cycles, cycles[1:1])
              WHEN 3 THEN list_concat(cycles[1:1], cycles[3:]) ELSE cycles END AS cycles,
         CASE (unit + chunk) % 7 WHEN 1 THEN list_reverse(vals) WHEN 2 THEN list_concat(vals, vals[1:1])
              WHEN 3 THEN list_concat(vals[1:1], vals[3:]) ELSE vals END AS vals
  FROM (SELECT subset, unit, (cycle - 1) // 40 AS chunk, list(cycle ORDER BY cycle) AS cycles, list(s2 ORDER BY cycle) AS vals
        FROM readings GROUP BY subset, unit, (cycle - 1) // 40) q""",
    "sequence_verdicts": """
  SELECT subset, unit, chunk, cycles, vals,
         CASE WHEN len(list_distinct(cycles)) <> len(cycles) THEN 'duplicate cycles'
              WHEN cycles <> list_sort(cycles) THEN 'not ascending'
              WHEN cycles[-1] - cycles[1] + 1 <> len(cycles) THEN 'gaps' END AS reason
  FROM sequences""",
}


def with_ctes(body: str) -> str:
    """The query body behind the fixture definitions it uses."""
    import re

    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
