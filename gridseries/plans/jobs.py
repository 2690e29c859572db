"""The library's workloads end to end; each reads a table and writes reports or forecasts.

`python -m gridseries.plans.jobs audit IN OUT KEYS...` and so on; `accuracy`, `forecast`, `exogenous` and `day_ahead`
likewise; `real_time IN OUT EXOGENOUS KEYS...` reads what `exogenous` wrote.  `--format=csv` and `--run_id=...` go with all.

Every part and report that a job writes has a partition of its own for each `run_id`, see `sources.runs`.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.functions import schema
from gridseries.operators import audit, clean, dayahead, drivers, forecast, index, keyed, lowrank, metrics, models, scale, windows
from gridseries.sources import runs, tables
from gridseries.sources.runs import Run

#: The penalty of the jobs' models, which have over a hundred features of many scales.
RIDGE = {"penalty": 0.05, "relative": True}
#: Days of a series that one task takes.
DAYS = 92


def prepared(df: DataFrame, keys: list[str], ts: str, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """(keys, slot, columns): numbers coerced, times in any spelling floored, the last row of each slot."""
    time = clean.time_column(df, ts, clean.infer_formats(df, ts))
    rows = df.select(*keys, time.alias("ts"), *[clean.number_column(df, c).alias(c) for c in columns], *[c for c in order or [] if c not in {*keys, ts, *columns}])
    return clean.regular_slots(rows, keys, "ts", order or []).select(*keys, "slot", *columns)


def _read(run: Run, source: str, format: str) -> DataFrame:
    """The job's input.  Text formats are parsed once, into the run; their malformed lines are counted in `malformed`."""
    if format not in ("csv", "json"):
        return tables.read_table(run.spark, source, format)
    marked = run.write(tables.read_marked(run.spark, source, format), "input")
    run.report(marked.agg(F.count("*").alias("n_rows"), F.count(tables.MALFORMED).alias("n_malformed"), F.min(tables.MALFORMED).alias("first"), F.max(tables.MALFORMED).alias("last")), "malformed", "json", single=True)
    return marked.drop(tables.MALFORMED)


def _series(run: Run, raw: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """The prepared rows, written; an error that names a rejected time if none is left of some."""
    df = run.write(prepared(raw, keys, ts, columns), "series")
    if not run.parts["series"]:
        bad = clean.rejected_times(raw.withColumn("_time", clean.time_column(raw, ts)), [], ts, "_time").first()
        raise ValueError(f"no row has a time: {bad['n_rejected']} texts of {ts} are none, as {bad['rejected_first']!r}, {bad['n_no_time']} are empty")
    return df


def audit_job(spark: SparkSession, source: str, out: str, keys: list[str] | None = None, min_len: int = 4, strict: bool = False, format: str = "parquet", days: int | None = DAYS, run_id: str = "run") -> None:
    """Reports of the time axis, with its rejected texts, of the columns, their blocks and their days.

    Long series go in parallel buckets of `days`; None takes a series as one.
    """
    run, keys = Run(spark, out, run_id), keys or []
    raw = _read(run, source, format)
    ts = schema.resolve_time_column(raw.columns)
    if ts is None:
        raise ValueError("no time column")
    columns = [c for c in raw.columns if c not in {ts, *keys}]
    df = _series(run, raw, keys, ts, columns)
    times = raw.select(*keys, F.col(f"`{ts}`").alias("_text"), clean.time_column(raw, ts, clean.infer_formats(raw, ts)).alias("ts"))
    axis = keyed.join(audit.time_axis_report(times.select(*keys, "ts"), keys, "ts", days=days), clean.rejected_times(times, keys, "_text", "ts"), keys)
    run.report(axis, "time_axis", "json")
    if strict:
        audit.require_complete(axis)
    kinds = F.create_map(*[F.lit(x) for c, t in raw.dtypes if c in columns for x in (c, t)])[F.col("col")]
    run.report(audit.column_summary(df, keys, "slot", columns, min_len, days).withColumn("dtype", kinds), "columns")
    run.report(audit.missing_blocks(df, keys, "slot", columns, min_len, days).orderBy(*keys, "col", "start_time"), "missing_blocks")
    daily = run.write(audit.daily_coverage(df, keys, "slot", columns), "daily_long")
    run.report(audit.daily_coverage_wide(daily, keys, columns), "daily")
    run.report(audit.daily_overall(daily, keys).orderBy(*keys, "date"), "daily_overall")
    run.finish(source=source, time_column=ts, columns=",".join(columns), types={c: t for c, t in raw.dtypes if c in columns}, min_len=min_len)


def accuracy_job(spark: SparkSession, source: str, out: str, format: str = "parquet", recent_days: int = 30, run_id: str = "run") -> None:
    """The errors of every pair of headers, and, where there is a time column, the pairs of each one's last days."""
    run = Run(spark, out, run_id)
    df = _read(run, source, format)
    pairs, ts = schema.pairs_of(df.columns), schema.resolve_time_column(df.columns)
    time = [clean.time_column(df, ts, clean.infer_formats(df, ts)).alias("ts")] if ts else []
    numbers = df.select(*time, *[clean.number_column(df, c).alias(c) for p in pairs.values() for c in p])
    headers = spark.createDataFrame([(v, a, f) for v, (a, f) in pairs.items()], "variable string, actual_col string, forecast_col string")
    report = metrics.pair_report(metrics.pairs_long(numbers, [], pairs), ["variable"]).join(F.broadcast(headers), "variable")  # a row a pair of headers
    run.report(report, "accuracy", single=True)
    if ts:
        run.write(metrics.recent_overlap(metrics.pairs_long(numbers, ["ts"], pairs), ["variable"], "ts", recent_days), "recent", ("variable",))
    run.finish(source=source, pairs={v: f"{a} / {f}" for v, (a, f) in pairs.items()})


def _fields(raw: DataFrame, workload: str, keys: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """`raw` as (keys, datetime, fields under their logical names), and the fields that it has."""
    found = schema.resolve_fields([c for c in raw.columns if c not in keys], workload)
    there = {k: h for k, h in found.items() if h is not None and k != "time"}
    return raw.select(*keys, F.col(f"`{found['time']}`").alias("datetime"), *[F.col(f"`{h}`").alias(k) for k, h in there.items()]), there


def _cutoffs(run: Run, df: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """(keys, cutoff, skipped), written, and each series' last valid time of each column, as a report."""
    there = [c for c in required if c in df.columns]
    run.report(index.last_valid_times(df, keys, "slot", there), "last_valid_times", "json")
    return run.write(index.require_cutoffs(index.cutoff(df, keys, "slot", required)), "cutoff")


def _index(run: Run, df: DataFrame, keys: list[str], cut: DataFrame, val_days: int, test_days: int, days: int | None) -> DataFrame:
    """The decision times before the cut-off with their split, written, and how many days and times each split has."""
    idx = index.before_cutoff(index.decision_index(df, keys, "slot", days=days), cut, keys)
    index.require_days(idx, keys, val_days + test_days + 1)
    idx = run.write(index.split_by_day(idx, keys, val_days, test_days), "index")
    run.report(idx.groupBy(*keys, "split").agg(F.countDistinct("date_tgt_max").alias("days"), F.count("*").alias("samples"), F.min("date_tgt_max").alias("first_day"), F.max("date_tgt_max").alias("last_day")), "split_ranges", "json")
    return idx


def _span(df: DataFrame) -> dict[str, str]:
    r = df.agg(F.min("slot").alias("min"), F.max("slot").alias("max")).first()
    return {"min": str(r["min"]), "max": str(r["max"])}


def forecast_job(spark: SparkSession, source: str, out: str, keys: list[str] | None = None, variables: tuple[str, ...] = ("load", "pv", "line"), val_days: int = 5, test_days: int = 6, run_id: str = "run", format: str = "parquet", days: int | None = DAYS, accuracy: int | None = None) -> None:
    """Lag-one-day forecasts with median residuals, in both shapes, and their errors beside the plain lag.

    `accuracy` asks for approximate medians, see `order.quantiles`.
    """
    run, keys = Run(spark, out, run_id), keys or []
    raw = _read(run, source, format)
    ts = schema.resolve_time_column([c for c in raw.columns if c not in keys]) or "slot"
    df = clean.require_continuous(_series(run, raw, keys, ts, list(variables)), keys, "slot", days=days)
    idx = _index(run, df, keys, _cutoffs(run, df, keys, list(variables)), val_days, test_days, days)
    rows = run.write(drivers.rows_of(idx, df, keys, "slot", list(variables)), "targets")
    long = run.write(forecast.lag_residual(rows, [*keys, "var", "h"], accuracy=accuracy), "rows")
    wide = run.write(forecast.to_wide(long, keys, list(variables)), "wide")
    run.write(forecast.to_long(wide, keys, list(variables), dict.fromkeys(variables, "lag1d_residual"), run_id), "long", ("var",))
    tags = [drivers.summary(long, "lag1d_residual"), drivers.summary(long.withColumn("y_hat", F.col("base")), "lag1d")]
    run.report(metrics.consolidate(tags).orderBy("tag", "split", "var"), "summary", single=True)
    run.finish(source=source, time_range=_span(df), variables=",".join(variables), val_days=val_days, test_days=test_days, look_back=index.LOOK_BACK, horizon=index.HORIZON, outputs=_outputs(run))


def _outputs(run: Run) -> dict[str, str]:
    return {name: f"{run.out}/{name}/run_id={run.run_id}" for name in sorted(run.parts)}


def exogenous_job(spark: SparkSession, source: str, out: str, keys: list[str] | None = None, methods: str = "load=lag1d_residual,pv=pv_day_residual,line=lag1d_residual", reserves: tuple[str, ...] = ("ru", "rd"), val_days: int = 5, test_days: int = 6, mode: str = "rt_chain", run_id: str = "run", gate: dict | None = None, format: str = "parquet", days: int | None = DAYS, by: list[str] | None = None) -> None:
    """Six hours of load, photovoltaics, tie line and reserves: stage one by method, reserves on prior and stage one.

    Writes the index, wide and long forecasts, the errors of both stages beside the plain lag and the
    source's own forecasts where it has them, and what the run was made with.  Models are of all series, or of each
    with `by` (some of the keys).
    """
    run, keys, chosen = Run(spark, out, run_id), keys or [], schema.parse_methods(methods)
    schema.check_methods(chosen, sorted(chosen))
    stage_one, both = sorted(chosen), sorted({*chosen, *reserves})
    raw, there = _fields(_read(run, source, format), "exogenous", keys)
    df = clean.require_continuous(_series(run, raw, keys, "datetime", list(there)), keys, "slot", days=days)
    required = index.required_columns(mode)
    cut = _cutoffs(run, df, keys, required)
    idx = _index(run, df, keys, cut, val_days, test_days, days)

    rows = run.write(drivers.rows_of(idx, df, keys, "slot", both), "targets")
    past = drivers.history_vectors(df, keys, "slot", ["rt", "da", *stage_one], days)
    first = run.write(drivers.with_features(rows.where(F.col("var").isin(*stage_one)), past, keys), "features_one")
    first = run.write(drivers.driver_forecasts(first, chosen, by, gate=gate, **RIDGE).drop("x"), "stage_one")
    past = drivers.history_vectors(df, keys, "slot", ["rt", "da", *both], days)
    second = drivers.with_prior(rows.where(F.col("var").isin(*reserves)), idx, df, keys, "slot", list(reserves), days)
    second = run.write(drivers.with_features(second, past, keys), "features_two")
    second = run.write(drivers.reserve_forecasts(second, first, keys, stage_one, by, **RIDGE).drop("x").withColumn("method", F.lit("prior_residual")), "stage_two")

    long = metrics.consolidate([first, second])
    wide = run.write(forecast.to_wide(long, keys, both).withColumn("model_version", F.lit(run_id)), "wide")
    run.write(forecast.to_long(wide, keys, both, chosen | dict.fromkeys(reserves, "prior_residual"), run_id), "long", ("var",))
    tags = [drivers.summary(long, "model"), drivers.summary(long.withColumn("y_hat", F.col("base")), "lag1d")]
    given = {v: f"{v}_fcst" for v in both if f"{v}_fcst" in there}
    if given:
        shown = long.select(*keys, "t_dec", "h", "tgt_time", "split", "y", F.col("var").alias("_v"))
        tags.append(drivers.summary(forecast.use_source_forecast(shown, df, keys, "slot", given).where("var = _v"), "source"))
    run.report(metrics.consolidate(tags).orderBy("tag", "split", "var"), "summary", single=True)
    first_days = {r["split"]: str(r["first"]) for r in idx.groupBy("split").agg(F.min("date_tgt_max").alias("first")).collect()}  # three rows
    ends = cut.agg(F.min("cutoff").alias("min"), F.max("cutoff").alias("max"), F.max(F.size("skipped")).alias("skipped")).first()
    run.finish(
        source=source, time_range=_span(df), mode=mode, methods=methods, reserves=",".join(reserves), required=",".join(required), val_days=val_days, test_days=test_days, first_days=first_days,
        cutoff={"min": str(ends["min"]), "max": str(ends["max"]), "skipped_columns": int(ends["skipped"]), "rule": "tgt_max_time <= cutoff"}, split_rule="full days of tgt_max_time", gate=drivers.GATE | (gate or {}),
        headers=there, compared_with=",".join(given.values()), look_back=index.LOOK_BACK, horizon=index.HORIZON, step_minutes=index.STEP_MINUTES, model="ridge", penalty=RIDGE["penalty"], outputs=_outputs(run),
    )


def real_time_job(spark: SparkSession, source: str, exogenous: str, out: str, keys: list[str] | None = None, variables: tuple[str, ...] = ("load", "pv", "line", "ru", "rd"), drop_invalid: bool = True, as_of: str | None = None, run_id: str = "run", exogenous_run: str | None = None, format: str = "parquet", days: int | None = DAYS, rank: int = 24, by: list[str] | None = None) -> None:
    """Real-time prices of six hours: a scaled model of the residual on the plain lag, on past and forecast features.

    `exogenous` is the folder that `exogenous_job` wrote; its index and forecasts are of one complete run,
    `exogenous_run` or the last.  The past is the summaries of both prices and the `rank` strongest
    directions of the whole look-back of all columns.  Scalers are of each series, models of all or, with `by`, of each.
    Writes the errors of the model and of the lag, the last decision's (or `as_of`'s) prices as CSV, and what
    the run was made with.
    """
    run, keys = Run(spark, out, run_id), keys or []
    raw, there = _fields(_read(run, source, format), "real_time", keys)
    df = clean.require_continuous(_series(run, raw, keys, "datetime", list(there)), keys, "slot", days=days)
    exogenous_run, parts = runs.read_parts(spark, exogenous, ["index", "wide"], exogenous_run)
    idx, wide = parts["index"], parts["wide"].drop("split", "model_version")
    columns = list(there)
    rows = run.write(drivers.rows_of(idx, df, keys, "slot", ["rt"]), "rows")
    baseline = forecast.to_wide(rows.withColumns({"var": F.lit("rtbase"), "y_hat": F.col("base")}), keys, ["rtbase"], keep=())
    ratios = windows.sample_ratios(idx, df, keys, "slot", columns, wide, list(variables), baseline, days=days)
    kept = run.write(windows.good_samples(ratios) if drop_invalid else ratios, "samples")

    # Scalers of the columns and of the residual, of each series, on its training rows.
    scalers = run.write(scale.fit_scalers(scale.training_rows(df, kept, keys, "slot"), keys, columns), "scalers")
    scaled = run.write(scale.scaled_columns(df, scalers, keys, columns), "scaled")
    usable = rows.join(kept.select(*keys, "t_dec"), [*keys, "t_dec"], "left_semi")
    delta = run.write(scale.fit_delta_scaler(usable, keys), "delta_scaler")

    def path(array: DataFrame, column: str, name: str) -> DataFrame:
        """(keys, t_dec, name): a price path filled and normalised; one without any value goes."""
        filled = array.select(*keys, F.col("slot").alias("t_dec"), windows.fill_window(column).alias(name)).where(~F.exists(name, lambda x: x.isNull()))
        return windows.normalise_paths(filled, name)

    halo = lambda frame, back, ahead, compute: windows.with_halo(frame, keys, "slot", back, index.STEP_MINUTES, compute, days, ahead)
    day = halo(scaled, index.SLOTS_A_DAY, 0, lambda d, k: windows.history_arrays(d, k, "slot", ["rt"], look_back=index.SLOTS_A_DAY)).withColumn("history", F.transform("history", lambda r: r[0]))
    ahead_da = halo(df, 0, index.HORIZON, lambda d, k: windows.future_arrays(d, k, "slot", "da"))
    projection = lowrank.fit(scaled, idx.join(kept.select(*keys, "t_dec"), [*keys, "t_dec"], "left_semi").where("split = 'train'"), keys, "slot", columns, rank, days=days or DAYS)
    run.write(projection.frame(spark), "projection")
    look_back = lowrank.project(scaled, projection, keys, "slot", columns, days=days or DAYS)
    past = drivers.history_vectors(scaled, keys, "slot", ["rt", "da"], days).join(look_back, [*keys, "t_dec"])
    past = past.join(path(day, "history", "rt_path"), [*keys, "t_dec"]).join(path(ahead_da, "future", "da_path"), [*keys, "t_dec"])
    ahead = forecast.to_long(wide.withColumn("split", F.lit("")), keys, list(variables), {}, run_id).groupBy(*keys, "t_dec", "h").pivot("var", list(variables)).agg(F.first("y_hat"))
    known = keyed.join(usable.join(past, [*keys, "t_dec"]).join(ahead, [*keys, "t_dec", "h"]), delta, keys)
    hourly = F.filter("rt_path", lambda x, i: i % 4 == 3)
    x = F.concat("past", "look_back", hourly, F.slice("da_path", F.col("h"), F.lit(1)), drivers.time_vector(F.col("tgt_time")), models.vector([F.col(v) for v in variables]))
    known = run.write(known.withColumn("x", x).drop("past", "look_back", "rt_path", "da_path", *variables), "features")
    target = scale.scaled(F.col("y") - F.col("base"), F.col("mu"), F.col("sd"))
    by = [*(by or []), "h"]
    got = models.predict_vectors(known, models.require_fitted(models.fit_vectors(known, by, target, F.lit(True), **RIDGE)), by).drop("x")
    got = run.write(got.withColumn("y_hat", F.col("base") + scale.unscaled(F.col("r_hat"), F.col("mu"), F.col("sd"))), "predictions")
    tags = [drivers.summary(got, "model"), drivers.summary(got.withColumn("y_hat", F.col("base")), "lag1d")]
    run.report(metrics.consolidate(tags).orderBy("tag", "split"), "summary", single=True)
    at = index.as_of(kept, as_of) if as_of else index.last_decision(kept, keys)
    residual = scale.unscaled(F.col("r_hat"), F.col("mu"), F.col("sd")).alias("r_hat")
    run.report(forecast.as_of_output(at.select(*keys, "t_dec"), got.select(*keys, "t_dec", "h", "base"), got.select(*keys, "t_dec", "h", residual), keys, 0.0, 1.0), "as_of")
    run.finish(
        source=source, exogenous={"folder": exogenous, "run_id": exogenous_run}, time_range=_span(df), columns=",".join(columns), future=",".join(variables), drop_invalid=drop_invalid,
        look_back=index.LOOK_BACK, horizon=index.HORIZON, step_minutes=index.STEP_MINUTES, rank=rank, explained=float(projection.explained), samples=run.parts["samples"], model="ridge", penalty=RIDGE["penalty"], outputs=_outputs(run),
    )


def day_ahead_job(spark: SparkSession, source: str, out: str, keys: list[str] | None = None, val_days: int = 30, test_days: int = 30, run_id: str = "run", format: str = "parquet", **gbt) -> None:
    """Feature table with exogenous features, row-count split, weights, one model for each third of the day; scores, the
    comparison with the source's own forecasts, and all of them beside the price."""
    run, keys = Run(spark, out, run_id), keys or []
    raw, there = _fields(_read(run, source, format), "day_ahead", keys)
    df = _series(run, raw, keys, "datetime", list(there))
    exogenous = {v: (f"{v}_fcst", v) for v in ("load", "pv", "line", "ru", "rd") if v in there or f"{v}_fcst" in there}
    table = dayahead.feature_table(df, keys, "slot", exogenous=exogenous)
    table = run.write(index.split_by_rows(table, keys, "slot", val_days, test_days), "split")
    index.require_rows(table, keys, val_days, test_days)
    run.report(index.split_ranges(table, keys, "slot"), "split_ranges", "json")
    table = run.write(index.high_price_weights(table, keys, "y", "segment"), "features")
    names = dayahead.feature_names(table, keys, "slot")
    predictions = models.predict_segments(table, models.fit_segments(table, names, **gbt), names)
    shown = run.write(predictions.select(*keys, "slot", "split", "segment", "y", "y_hat"), "predictions")
    run.report(metrics.split_scores(shown, ["split"]).orderBy("split"), "scores", single=True)
    given = [c for c in ("da_fcst", "da_price_fcst") if c in there]
    beside = shown.join(df.select(*keys, "slot", *given), [*keys, "slot"])
    if given:
        run.report(metrics.compare_models(beside, "y", {"model": "y_hat", **{c: c for c in given}}).orderBy("dataset", "model"), "comparison", single=True)
    run.write(metrics.overview(beside, keys, "slot", ["split", "y", "y_hat", *given]), "overview")
    run.finish(source=source, time_range=_span(df), headers=there, features=len(names), val_days=val_days, test_days=test_days, outputs=_outputs(run))


JOBS = {"audit": audit_job, "accuracy": accuracy_job, "forecast": forecast_job, "exogenous": exogenous_job, "day_ahead": day_ahead_job}

if __name__ == "__main__":
    name, source, out, *keys = [a for a in sys.argv[1:] if not a.startswith("--")]
    options = dict(a[2:].split("=", 1) for a in sys.argv[1:] if a.startswith("--"))  # --format=csv --run_id=...
    session = SparkSession.builder.appName(f"gridseries-{name}").getOrCreate()
    if name == "real_time":
        real_time_job(session, source, keys[0], out, keys[1:], **options)
    elif name == "accuracy":
        accuracy_job(session, source, out, **options)
    else:
        JOBS[name](session, source, out, keys, **options)
