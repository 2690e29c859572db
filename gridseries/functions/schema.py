"""Resolving logical columns from physical headers; all of it works on names, never on data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed header words of the input tables.
TIME_HEADERS = ("datetime", "时间", "日期时间")
TIME_WORDS = ("time", "日期", "时间")
ACTUAL, FORECAST = "实际值", "预测值"
ACTUAL_SHORT, FORECAST_SHORT = "实际", "预测"
_TIME_AND_PRICES = {
    "time": ("datetime", "时间", "日期时间"),
    "rt": ("实时出清电价", "实时电价", "RT", "实时价格"),
    "da": ("日前出清电价", "日前电价", "DA", "日前价格"),
}
_ACTUALS = {
    "load": ("系统负荷实际值",),
    "pv": ("光伏实际值",),
    "line": ("联络线实际值",),
    "ru": ("上旋备用实际值",),
    "rd": ("下旋备用实际值",),
}
_FORECASTS = {
    "load_fcst": ("系统负荷预测值",),
    "pv_fcst": ("光伏预测值",),
    "line_fcst": ("联络线预测值",),
    "ru_fcst": ("上旋备用预测值",),
    "rd_fcst": ("下旋备用预测值",),
}
#: For each workload the (required, optional) fields and the candidates of their headers, in order.
FIELDS: dict[str, tuple[dict, dict]] = {
    "exogenous": (_TIME_AND_PRICES | _ACTUALS, _FORECASTS),
    "real_time": (
        _TIME_AND_PRICES | _ACTUALS,
        {"wind": ("风电实际值",), "wg_total": ("风光总加实际值",), "space": ("竞价空间实际值",), "local_gen": ("地方电厂发电实际值",)},
    ),
    "day_ahead": (
        {
            "time": ("datetime", "时间", "日期时间"),
            "rt": ("实时出清电价", "实时电价", "RT", "实时价格", "实际实时价格"),
            "da": ("日前出清电价", "日前电价", "DA", "日前价格", "实际日前价格"),
        },
        {
            "da_fcst": ("日前电价预测值", "日前价格预测值", "日前电价预测", "日前价格预测", "DA预测", "日前预测电价"),
            "da_price_fcst": ("日前价格预测",),
            "load": ("系统负荷实际值", "系统负荷"),
            "pv": ("光伏实际值", "光伏"),
            "line": ("联络线实际值", "联络线"),
            "ru": ("上旋备用实际值", "上旋备用"),
            "rd": ("下旋备用实际值", "下旋备用"),
            "load_fcst": ("系统负荷预测值", "负荷预测值", "负荷预测"),
            "pv_fcst": ("光伏预测值", "光伏预测"),
            "line_fcst": ("联络线预测值", "联络线预测"),
            "ru_fcst": ("上旋备用预测值", "上旋备用预测"),
            "rd_fcst": ("下旋备用预测值", "下旋备用预测"),
        },
    ),
}
#: A field that is dropped where it is the same header as another.
NOT_BOTH = {"da_price_fcst": "da_fcst"}
#: Forecasting methods and the one variable that a method is limited to.
METHODS = ("direct", "lag1d", "lag1d_residual", "pv_day_residual")
ONLY_FOR = {"pv_day_residual": "pv"}


def resolve_column(columns: Iterable, candidates: Sequence[str]) -> str | None:
    """The first candidate that is a header; else the only header that holds a candidate as a part."""
    names = [str(c) for c in columns]
    exact = next((c for c in candidates if c in names), None)
    if exact is not None:
        return exact
    parts = ([n for n in names if c in n] for c in candidates)
    return next((hits[0] for hits in parts if len(hits) == 1), None)


def resolve_time_column(columns: Iterable) -> str | None:
    """An exact time header, else the first header that holds a time word."""
    names = [str(c) for c in columns]
    return next((h for h in TIME_HEADERS if h in names), None) or next((n for n in names if any(w in n.lower() for w in TIME_WORDS)), None)


def resolve_fields(columns: Iterable, workload: str = "exogenous") -> dict[str, str | None]:
    """Logical name to header, for one of the workloads of FIELDS; a missing required field raises, a missing optional one is None.

    Where the logical names themselves are headers they stand for the field.
    """
    names, (required, optional) = list(columns), FIELDS[workload]
    found = {k: k if k in names and k != "time" else resolve_column(names, v) for k, v in {**required, **optional}.items()}
    if lacking := [k for k in required if found[k] is None]:
        raise ValueError(f"no column for required fields {lacking} among {names}")
    for k, other in NOT_BOTH.items():
        if found.get(k) is not None and found[k] == found.get(other):
            found[k] = None
    return found


def select_fields(df: DataFrame, fields: Mapping[str, str | None]) -> DataFrame:
    return df.select(*[F.col(f"`{h}`").alias(k) for k, h in fields.items() if h is not None])


def base_name(name: Column) -> Column:
    """The variable of a header: the words for actual and forecast are taken away."""
    drop = lambda word: F.trim(F.replace(name, F.lit(word), F.lit("")))
    cut = lambda word: F.trim(F.regexp_replace(name, f"{word}$", ""))
    return F.when(name.contains(ACTUAL), drop(ACTUAL)).when(name.contains(FORECAST), drop(FORECAST)).when(name.endswith(ACTUAL_SHORT), cut(ACTUAL_SHORT)).when(name.endswith(FORECAST_SHORT), cut(FORECAST_SHORT)).otherwise(name)


def name_kind(name: Column) -> Column:
    """actual, forecast or null."""
    return F.when(name.contains(ACTUAL), "actual").when(name.contains(FORECAST), "forecast").when(name.endswith(ACTUAL_SHORT), "actual").when(name.endswith(FORECAST_SHORT), "forecast")


def column_pairs(names: DataFrame, name: str = "name", position: str = "position") -> DataFrame:
    """(base, actual_col, forecast_col) of the bases that have both; of several headers the last counts."""
    parsed = names.select(base_name(F.col(name)).alias("base"), name_kind(F.col(name)).alias("kind"), F.col(name).alias("header"), F.col(position).alias("at"))
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("header")), F.when(F.col("kind") == kind, F.col("at")))
    return parsed.where("kind is not null").groupBy("base").agg(last("actual").alias("actual_col"), last("forecast").alias("forecast_col")).where("actual_col is not null and forecast_col is not null")


def pairs_of(columns: Iterable) -> dict[str, tuple[str, str]]:
    """`column_pairs` of a header list, on the driver; raises when there is none."""
    by: dict[str, dict[str, str]] = {}
    for c in map(str, columns):
        for word, kind in ((ACTUAL, "actual"), (FORECAST, "forecast")):
            if word in c:
                by.setdefault(c.replace(word, "").strip(), {})[kind] = c
                break
        else:
            for word, kind in ((ACTUAL_SHORT, "actual"), (FORECAST_SHORT, "forecast")):
                if c.endswith(word):
                    by.setdefault(c.removesuffix(word).strip(), {})[kind] = c
                    break
    pairs = {b: (k["actual"], k["forecast"]) for b, k in sorted(by.items()) if len(k) == 2}
    if not pairs:
        raise ValueError("no pair of an actual and a forecast column")
    return pairs


def choose_exogenous(columns: Iterable[str], forecast: str | None, actual: str | None) -> str | None:
    """The forecast column if the table has it, else the actual one (which knows the future: a leak)."""
    have = set(columns)
    return forecast if forecast in have else actual if actual in have else None


def parse_methods(text: str) -> dict[str, str]:
    """`var=method,var=method` as a dict."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        var, eq, method = part.partition("=")
        if not eq:
            raise ValueError(f"not var=method: {part!r}")
        out[var.strip()] = method.strip()
    return out


def check_methods(methods: Mapping[str, str], variables: Sequence[str]) -> dict[str, str]:
    """`methods`, if each variable has an allowed one; else an error."""
    for v in variables:
        m = methods.get(v)
        if m not in METHODS:
            raise ValueError(f"method of {v} is {m!r}; allowed: {METHODS}")
        if ONLY_FOR.get(m, v) != v:
            raise ValueError(f"{m} is for {ONLY_FOR[m]} only")
    return dict(methods)
