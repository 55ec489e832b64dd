"""Profiles, scores, group statistics, comparisons, chart tables and the reports made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirworks.catalog.cleaning_queries import (
    _CLEAN,
    BASE,
    COLUMNS,
    CSV_SCHEMA,
    DELTA,
    ROW_MEAN,
    written_csv,
)
from weirworks.catalog.registry import bucket_sql, query, r, rounded, union_all
from weirworks.catalog.tables import (
    DIRTY_PERIODS,
    PERIODS,
    headed,
    sites,
    sites_dirty,
    sites_raw,
    table,
    with_views,
)
from weirworks.operators import charts, compare, groups, profile
from weirworks.plans import cleaning, reports

_DIRTY = with_views("sites_dirty")
_RAW = with_views("sites_raw")
_SITES = with_views("sites")
_MEASURED = f"{_SITES}, measured AS (SELECT *, {ROW_MEAN} AS row_mean, {DELTA} AS trend_delta FROM sites)"
TEXTS = ("site_name", "company", "region", "events_1998")
NUMBERS = tuple(c for c in COLUMNS if c not in TEXTS)
LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def measured(spark, sf_dir):
    return reports.with_measures(sites(spark, sf_dir), PERIODS)


# ---- missing values, duplicates, shape ----------------------------------------------------------


def missing_sql(source: str, columns=COLUMNS, extra: str = "", digits: int = 4) -> str:
    return union_all(
        [
            f"SELECT {extra}'{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, "
            f"{r(f'(count(*) - count({c})) * 100.0 / count(*)', 'missing_percent', digits)} FROM {source}"
            for c in columns
        ]
    )


@query("missing_profile", f"{_RAW} {missing_sql('sites_raw')}")
def _(spark, sf_dir):
    return rounded(profile.missing_profile(sites_raw(spark, sf_dir)))


@query(
    "missing_overall",
    f"{_RAW}, p AS ({missing_sql('sites_raw')}) SELECT CAST(sum(rows) AS BIGINT) AS cells, CAST(sum(missing) AS BIGINT) AS missing, "
    f"{r('sum(missing) * 100.0 / sum(rows)', 'missing_percent')} FROM p",
)
def _(spark, sf_dir):
    return rounded(profile.missing_overall(sites_raw(spark, sf_dir)))


@query(
    "missing_bar",
    f"{_RAW}, p AS ({missing_sql('sites_raw')}) SELECT * FROM p ORDER BY missing_percent DESC, \"column\" LIMIT 4",
)
def _(spark, sf_dir):
    return rounded(charts.missing_bar(sites_raw(spark, sf_dir), 4))


@query(
    "empty_columns",
    f"{_SITES} SELECT 'events_none' AS \"column\", count(*) AS rows FROM sites HAVING count(*) > 0",
)
def _(spark, sf_dir):
    # The year before the first order: no site has a value for it.
    return profile.empty_columns(
        sites(spark, sf_dir).withColumn("events_none", F.when(F.col("events_1995") < 0, F.col("events_1995")))
    )


@query(
    "duplicate_count",
    f"""{_DIRTY}, d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM sites_dirty) q)
    SELECT count(*) AS rows, max(n) AS distinct_rows, count(*) - max(n) AS duplicate_rows FROM sites_dirty, d""",
)
def _(spark, sf_dir):
    return profile.duplicate_count(sites_dirty(spark, sf_dir))


@query("shape_metadata", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def _(spark, sf_dir):
    return profile.shape_metadata(table(spark, sf_dir, "lineitem"))


def frame_sql(source: str, label: str = "", digits: int = 4) -> str:
    cells = " + ".join(f"({c} IS NULL)::INT" for c in COLUMNS)
    return f"""SELECT {label}count(*) AS rows, CAST({len(COLUMNS)} AS BIGINT) AS columns,
      {r(f"sum({cells}) * 100.0 / (count(*) * {len(COLUMNS)})", "missing_percent", digits)},
      CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source}) q) AS BIGINT) AS duplicate_rows
      FROM {source}"""


@query("frame_summary", f"{_RAW} {frame_sql('sites_raw')}")
def _(spark, sf_dir):
    return rounded(profile.frame_summary(sites_raw(spark, sf_dir)))


# ---- column profiles and scores -----------------------------------------------------------------


def numeric_sql(
    source: str, columns, quantiles=(("q25", 0.25), ("median", 0.5), ("q75", 0.75)), outliers="0", digits: int = 4
) -> str:
    """One SELECT per column; ``outliers`` is an expression over the CTE ``m_<column>``, or 0."""
    return union_all(
        [
            f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})', 'mean', digits)}, {r(f'stddev_samp({c})', 'std', digits)},
            {r(f'min({c})', 'min', digits)}, {r(f'max({c})', 'max', digits)}, count(*) - count({c}) AS missing_count,
            {r(f'(count(*) - count({c})) * 100.0 / count(*)', 'missing_percent', digits)},
            CAST({outliers.format(c=c)} AS BIGINT) AS outlier_count,
            {r(f'{outliers.format(c=c)} * 100.0 / count({c})', 'outlier_percent', digits)}
            {''.join(', ' + r(f'quantile_cont({c}, {p})', n, digits) for n, p in quantiles)} FROM {source}"""
            for c in columns
        ]
    )


@query("numeric_profile", numeric_sql("lineitem", LINE))
def _(spark, sf_dir):
    return rounded(profile.numeric_profile(table(spark, sf_dir, "lineitem", list(LINE))))


_OUT = (
    "(SELECT count(*) FROM events, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM events) z "
    "WHERE abs(({c} - m) / s) > 3)"
)


@query("numeric_profile_outliers", numeric_sql("events", ("value",), outliers=_OUT))
def _(spark, sf_dir):
    return rounded(profile.numeric_profile(table(spark, sf_dir, "events", ["value"]), outlier_z=3.0))


def categorical_sql(source: str, columns, digits: int = 4) -> str:
    parts = []
    for c in columns:
        top = f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        often = f"(SELECT count(*) FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1)"
        parts.append(
            f"""SELECT '{c}' AS "column", count({c}) AS count, count(DISTINCT {c}) AS unique_count,
            {r(f'count(DISTINCT {c}) * 100.0 / count({c})', 'unique_percent', digits)}, {top} AS top_value,
            {often} AS top_frequency, count(*) - count({c}) AS missing_count,
            {r(f'(count(*) - count({c})) * 100.0 / count(*)', 'missing_percent', digits)} FROM {source}"""
        )
    return union_all(parts)


@query("categorical_profile", f"{_RAW} {categorical_sql('sites_raw', TEXTS)}")
def _(spark, sf_dir):
    return rounded(profile.categorical_profile(sites_raw(spark, sf_dir)))


@query(
    "categorical_profile_documents",
    categorical_sql("documents", ("text", "lang", "source")),
)
def _(spark, sf_dir):
    return rounded(profile.categorical_profile(table(spark, sf_dir, "documents", ["text", "lang", "source"])))


_NUM_SCORE = (
    "least(100.0, greatest(0.0, 100.0 - missing_percent * 0.5 - outlier_percent * 0.3 - "
    "CASE WHEN mean IS NULL OR std IS NULL THEN 20.0 ELSE 0.0 END))"
)
_CAT_SCORE = (
    "least(100.0, greatest(0.0, 100.0 - missing_percent * 0.5 - CASE WHEN unique_percent > 90 THEN 20.0 ELSE 0.0 END "
    "- CASE WHEN top_value IS NULL THEN 10.0 ELSE 0.0 END))"
)


@query(
    "quality_score_numeric",
    f"{_RAW}, p AS ({numeric_sql('sites_raw', NUMBERS)}) SELECT \"column\", {r(_NUM_SCORE, 'quality_score', 3)} FROM p",
)
def _(spark, sf_dir):
    scored = profile.score_numeric(profile.numeric_profile(sites_raw(spark, sf_dir), probs={}))
    return rounded(scored.select("column", "quality_score"), 3)


@query(
    "quality_score_categorical",
    f"{_RAW}, p AS ({categorical_sql('sites_raw', TEXTS)}) "
    f"SELECT \"column\", {r(_CAT_SCORE, 'quality_score', 3)} FROM p",
)
def _(spark, sf_dir):
    scored = profile.score_categorical(profile.categorical_profile(sites_raw(spark, sf_dir)))
    return rounded(scored.select("column", "quality_score"), 3)


def _score_ctes(source: str, numbers=NUMBERS, texts=TEXTS) -> str:
    return f"""np AS ({numeric_sql(source, numbers, digits=12)}), cp AS ({categorical_sql(source, texts, 12)}),
    scores AS (SELECT count, missing_count, {_NUM_SCORE} AS s FROM np
               UNION ALL SELECT count, missing_count, {_CAT_SCORE} FROM cp)"""


_DATASET_SCORE = f"""SELECT count(s) AS scored_columns, {r('avg(s)', 'mean_score', 3)},
  {r('sum(missing_count) * 100.0 / sum(count + missing_count)', 'missing_percent', 3)},
  {r('avg(s) - sum(missing_count) * 100.0 / sum(count + missing_count) * 0.3', 'quality_score', 3)} FROM scores"""


@query("quality_score_dataset", f"{_RAW}, {_score_ctes('sites_raw')} {_DATASET_SCORE}")
def _(spark, sf_dir):
    return rounded(profile.score_dataset(sites_raw(spark, sf_dir)), 3)


_METRICS = ("count", "mean", "std", "min", "q25", "median", "q75", "max")


def _melt(source: str, item: str, metrics) -> str:
    return union_all(
        [f"SELECT {item} AS \"column\", '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {source}" for m in metrics]
    )


@query(
    "basic_describe",
    f"""{_RAW}, np AS ({numeric_sql('sites_raw', NUMBERS)}), cp AS ({categorical_sql('sites_raw', TEXTS)}),
    mp AS (SELECT * FROM ({missing_sql('sites_raw')}) q WHERE missing > 0)
    {_melt('np', '"column"', _METRICS)} UNION ALL
    {_melt('cp', '"column"', ('unique_count', 'unique_percent', 'top_frequency'))} UNION ALL
    {_melt('mp', '"column"', ('missing', 'missing_percent'))}""",
)
def _(spark, sf_dir):
    return rounded(profile.basic_describe(sites_raw(spark, sf_dir)))


_PCTS = (("p50", 0.5), ("p75", 0.75), ("p90", 0.9))


@query(
    "column_describe_pcts",
    f"{_SITES}, p AS ({numeric_sql('sites', PERIODS, _PCTS)}) SELECT * EXCLUDE (outlier_count, outlier_percent) FROM p",
)
def _(spark, sf_dir):
    return rounded(profile.describe_percentiles(sites(spark, sf_dir), PERIODS, (50, 75, 90)))


@query(
    "period_totals",
    f"{_SITES} " + union_all([f"SELECT '{c}' AS period, coalesce(sum({c}), 0) AS total_events FROM sites" for c in PERIODS]),
)
def _(spark, sf_dir):
    return profile.period_totals(sites(spark, sf_dir), PERIODS)


_HEALTH = ("site_name", "company", "region")
_TRIMMED = ", ".join(f"nullif(nullif(trim({c}), ''), 'nan') AS {c}" for c in _HEALTH)


@query(
    "text_health",
    f"{_DIRTY}, t AS (SELECT {_TRIMMED} FROM sites_dirty), p AS ({categorical_sql('t', _HEALTH)}) "
    'SELECT "column", missing_percent, unique_count, top_value, top_frequency FROM p',
)
def _(spark, sf_dir):
    return rounded(profile.text_health(sites_dirty(spark, sf_dir), _HEALTH))


@query(
    "value_counts_topk",
    "SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 10",
)
def _(spark, sf_dir):
    return profile.value_counts_topk(table(spark, sf_dir, "part"), "p_type", 10)


# ---- group statistics and trends ----------------------------------------------------------------


def group_sql(source: str, key: str, value: str, digits: int = 2) -> str:
    return f"""SELECT {key}, {r(f'avg({value})', 'mean', digits)}, {r(f'quantile_cont({value}, 0.5)', 'median', digits)},
      {r(f'coalesce(sum({value}), 0)', 'total', digits)}, count({value}) AS site_count,
      {r(f'stddev_samp({value})', 'std', digits)}, {r(f'min({value})', 'min', digits)}, {r(f'max({value})', 'max', digits)}
      FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}"""


@query("group_stats_company", f"{_MEASURED} {group_sql('measured', 'company', 'row_mean')}")
def _(spark, sf_dir):
    return groups.sort_desc(groups.group_stats(measured(spark, sf_dir), "company", "row_mean"), "mean", "company")


@query("group_stats_region", f"{_MEASURED} {group_sql('measured', 'region', 'row_mean')}")
def _(spark, sf_dir):
    return groups.sort_desc(groups.group_stats(measured(spark, sf_dir), "region", "row_mean"), "mean", "region")


@query("group_stats_part", "WITH l AS (SELECT l_partkey, sqrt(l_extendedprice) AS root FROM lineitem) " + group_sql("l", "l_partkey", "root", 4))
def _(spark, sf_dir):
    # Many groups: the median path with one bucket table per group.
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.sqrt("l_extendedprice").alias("root"))
    return groups.group_stats(rows, "l_partkey", "root", 4)


SUMMARY_SQL = union_all(
    [
        f"SELECT '{name}' AS metric, CAST({expression} AS DOUBLE) AS value FROM measured"
        for name, expression in (
            ("rows", "count(*)"),
            ("mean", "avg(row_mean)"),
            ("std", "stddev_samp(row_mean)"),
            ("min", "min(row_mean)"),
            ("max", "max(row_mean)"),
            ("total", "trunc(sum(row_mean))"),
            ("overall_trend", "avg(trend_delta)"),
            ("improving", "count(*) FILTER (trend_delta < 0)"),
            ("worsening", "count(*) FILTER (trend_delta > 0)"),
            ("stable", "count(*) FILTER (trend_delta = 0)"),
            ("distinct_company", "count(DISTINCT company)"),
            ("distinct_region", "count(DISTINCT region)"),
            *[(f"percentile_{p}", f"quantile_cont(row_mean, {p / 100})") for p in (25, 50, 75, 90, 95, 99)],
        )
    ]
)


@query("summary_metrics", f"{_MEASURED} SELECT metric, round(value, 4) AS value FROM ({SUMMARY_SQL}) q")
def _(spark, sf_dir):
    return rounded(groups.summary_metrics(measured(spark, sf_dir), "row_mean", "trend_delta", ["company", "region"]))


TREND_SQL = f"""SELECT {r('avg(trend_delta)', 'overall_trend')}, count(*) FILTER (trend_delta < 0) AS improving,
  count(*) FILTER (trend_delta > 0) AS worsening, count(*) FILTER (trend_delta = 0) AS stable,
  count(trend_delta) AS labelled FROM measured"""


@query("trend_counts", f"{_MEASURED} {TREND_SQL}")
def _(spark, sf_dir):
    return rounded(groups.trend_counts(measured(spark, sf_dir), "trend_delta"))


SHARES_SQL = union_all(
    [
        f"SELECT '{label}' AS label, count(*) FILTER (trend_delta {op} 0) AS n, "
        f"{r(f'count(*) FILTER (trend_delta {op} 0) * 100.0 / count(trend_delta)', 'share_percent')} FROM measured"
        for label, op in (("improving", "<"), ("worsening", ">"), ("stable", "="))
    ]
)


@query("trend_shares", f"{_MEASURED} {SHARES_SQL}")
def _(spark, sf_dir):
    return rounded(groups.trend_shares(measured(spark, sf_dir), "trend_delta"))


@query(
    "rename_round",
    f"""SELECT l_orderkey AS "Order", l_linenumber AS "Line", {r('sqrt(l_extendedprice)', 'Root of price', 2)},
    {r('l_quantity / 7', 'Weeks', 2)} FROM lineitem""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.sqrt("l_extendedprice").alias("root"), (F.col("l_quantity") / 7).alias("weeks")
    )
    titles = {"l_orderkey": "Order", "l_linenumber": "Line", "root": "Root of price", "weeks": "Weeks"}
    return groups.rename_round(rows, titles)


@query(
    "sort_desc",
    f"{_MEASURED} SELECT company, region, {r('avg(row_mean)', 'mean')} FROM measured GROUP BY company, region",
)
def _(spark, sf_dir):
    means = measured(spark, sf_dir).groupBy("company", "region").agg(F.avg("row_mean").alias("mean"))
    return groups.sort_desc(rounded(means), "mean", "company")


@query(
    "top_n_groups",
    f"{_MEASURED} SELECT * FROM ({group_sql('measured', 'company', 'row_mean')}) g ORDER BY mean DESC NULLS LAST, company LIMIT 3",
)
def _(spark, sf_dir):
    return groups.top_groups(groups.group_stats(measured(spark, sf_dir), "company", "row_mean"), "mean", "company", 3)


@query("head_sample", f"{_SITES} SELECT site_id, company, region, balance FROM sites ORDER BY site_id LIMIT 500")
def _(spark, sf_dir):
    return groups.head_rows(sites(spark, sf_dir).select("site_id", "company", "region", "balance"), "site_id", 500)


@query(
    "group_stat_features",
    f"""SELECT event_id, user_id, value, {r('avg(value) OVER w', 'value_group_mean')},
    {r('stddev_samp(value) OVER w', 'value_group_std')}, min(value) OVER w AS value_group_min,
    max(value) OVER w AS value_group_max FROM events WINDOW w AS (PARTITION BY user_id)""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events", ["event_id", "user_id", "value"])
    return rounded(groups.group_stat_features(rows, "user_id", ["value"]))


@query(
    "global_stat_features",
    f"""WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events)
    SELECT event_id, value, {r('m', 'value_mean')}, {r('d', 'value_std')} FROM events, s""",
)
def _(spark, sf_dir):
    return rounded(groups.global_stat_features(table(spark, sf_dir, "events", ["event_id", "value"]), ["value"]))


# ---- before and after ---------------------------------------------------------------------------


def counts_sql(source: str, column: str, k: int = 10) -> str:
    return (
        f"SELECT {column} AS value, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} "
        f"ORDER BY n DESC, value LIMIT {k}"
    )


def compare_sql(before: str, after: str, column: str, k: int = 10) -> str:
    """The values in the top k of either side, counted in both."""
    return f"""SELECT value, count(*) FILTER (WHERE side = 'raw') AS raw, count(*) FILTER (WHERE side = 'cleaned') AS cleaned
  FROM (SELECT {column} AS value, 'raw' AS side FROM {before} UNION ALL SELECT {column}, 'cleaned' FROM {after}) s
  WHERE value IN (SELECT value FROM ({counts_sql(before, column, k)}) a UNION SELECT value FROM ({counts_sql(after, column, k)}) b)
  GROUP BY value"""


COMPARE_SQL = compare_sql("sites_raw", "cleaned", "company")


@query("compare_counts", f"{_CLEAN} {COMPARE_SQL}")
def _(spark, sf_dir):
    raw = sites_raw(spark, sf_dir)
    return compare.compare_counts(raw, cleaning.clean(raw, BASE), "company")


_KEY_COLUMNS = ("balance", "company", "region", "site_name")
COMPARE_MISSING_SQL = "SELECT \"column\", dataset, missing_percent FROM (" + union_all(
    [
        missing_sql("sites_raw", _KEY_COLUMNS, "'raw' AS dataset, "),
        missing_sql("cleaned", _KEY_COLUMNS, "'cleaned' AS dataset, "),
    ]
) + ") q"


@query("compare_missing", f"{_CLEAN} {COMPARE_MISSING_SQL}")
def _(spark, sf_dir):
    raw = sites_raw(spark, sf_dir)
    return rounded(compare.compare_missing(raw, cleaning.clean(raw, BASE), _KEY_COLUMNS))


FRAMES_SQL = union_all(
    [frame_sql("sites_raw", "'raw' AS dataset, "), frame_sql("cleaned", "'cleaned' AS dataset, ")]
)


@query("compare_frames", f"{_CLEAN} {FRAMES_SQL}")
def _(spark, sf_dir):
    raw = sites_raw(spark, sf_dir)
    return rounded(compare.compare_frames(raw, cleaning.clean(raw, BASE)))


# ---- chart tables -------------------------------------------------------------------------------


def bins_sql(source: str, column: str, bins: int = 30) -> str:
    """(bin, bin_low, bin_high, n) over the non-missing values of a source."""
    return f"""SELECT i AS bin, lo + i * ((hi - lo) / {bins}) AS bin_low, lo + (i + 1) * ((hi - lo) / {bins}) AS bin_high,
      (SELECT count(*) FROM {source} WHERE {column} IS NOT NULL AND least(floor(({column} - lo) / (hi - lo) * {bins}), {bins - 1}) = i) AS n
      FROM (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}) e, range({bins}) g(i)"""


def _histogram_sql(source: str, column: str, cap: float) -> str:
    return f"""h AS (SELECT {column} FROM {source} WHERE {column} <= (SELECT quantile_cont({column}, {cap}) FROM {source}))
    SELECT bin, {r('bin_low', 'bin_low')}, {r('bin_high', 'bin_high')}, n,
      {r(f'(SELECT avg({column}) FROM {source})', 'mean')},
      {r(f'(SELECT quantile_cont({column}, 0.5) FROM {source})', 'median')} FROM ({bins_sql('h', column)}) b"""


@query("histogram", f"WITH {_histogram_sql('lineitem', 'l_extendedprice', 0.99)}")
def _(spark, sf_dir):
    return rounded(charts.histogram(table(spark, sf_dir, "lineitem", ["l_extendedprice"]), "l_extendedprice"))


def _density_sql(source: str, name: str) -> str:
    return f"""SELECT '{name}' AS dataset, bin, bin_low, bin_high,
      n / ((SELECT count(events_1995) FROM {source}) * (bin_high - bin_low)) AS density
      FROM ({bins_sql(source, 'events_1995')}) b"""


DENSITY_SQL = union_all([_density_sql("c0", "raw"), _density_sql("cleaned", "cleaned")])


@query(
    "density_shift",
    f"{_CLEAN} SELECT dataset, bin, {r('bin_low', 'bin_low')}, {r('bin_high', 'bin_high')}, {r('density', 'density')} "
    f"FROM ({DENSITY_SQL}) d",
)
def _(spark, sf_dir):
    raw = sites_raw(spark, sf_dir)
    return rounded(charts.density_shift(raw, cleaning.clean(raw, BASE), "events_1995"))


def _footprint_sql(source: str, name: str, cell: float) -> str:
    return f"""SELECT '{name}' AS dataset, CAST(floor(balance / {cell}) AS BIGINT) AS x_cell,
      CAST(floor(events_1995 / {cell}) AS BIGINT) AS y_cell, count(*) AS n FROM {source}
      WHERE balance IS NOT NULL AND events_1995 IS NOT NULL GROUP BY ALL"""


def footprint_sql(cell: float) -> str:
    return union_all([_footprint_sql("c0", "raw", cell), _footprint_sql("cleaned", "cleaned", cell)])


@query("geo_footprint", f"{_CLEAN} {footprint_sql(2.0)}")
def _(spark, sf_dir):
    raw = sites_raw(spark, sf_dir)
    return charts.geo_footprint(raw, cleaning.clean(raw, BASE), "balance", "events_1995", 2.0)


@query("compare_counts_part", compare_sql("part", "(SELECT * FROM part WHERE p_size > 25) q", "p_type", 3))
def _(spark, sf_dir):
    parts = table(spark, sf_dir, "part", ["p_type", "p_size"])
    return compare.compare_counts(parts, parts.filter("p_size > 25"), "p_type", 3)


@query(
    "geo_sample",
    f"""{_SITES} SELECT site_id, balance, events_1995 FROM sites
    WHERE balance IS NOT NULL AND events_1995 IS NOT NULL AND {bucket_sql('site_id', 1_000_000)} < 500000""",
)
def _(spark, sf_dir):
    return charts.geo_sample(sites(spark, sf_dir), "site_id", "balance", "events_1995", 0.5)


# ---- reports ------------------------------------------------------------------------------------


@query(
    "validation_report",
    f"""{_RAW}, p AS ({missing_sql('sites_raw')}),
    t AS (SELECT sum(missing) * 100.0 / sum(rows) AS pct FROM p),
    d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sites_raw) q) AS n FROM sites_raw)
    SELECT 'error' AS severity, 'missing_required' AS "check", 'Permit Number' AS item, CAST(0 AS DOUBLE) AS value
    UNION ALL SELECT 'warning', 'high_missing_percent', 'all', round(pct, 4) FROM t WHERE pct > 0.5
    UNION ALL SELECT 'warning', 'duplicate_rows', 'all', n FROM d WHERE n > 0
    UNION ALL SELECT 'warning', 'name_suggestion', 'Water Compnay', count(company) FROM sites_raw
    UNION ALL SELECT 'warning', 'name_suggestion', 'Latitute', count(balance) FROM sites_raw""",
)
def _(spark, sf_dir):
    return rounded(reports.validation_report(headed(sites_raw(spark, sf_dir)), ["Permit Number"]))


def _section(section: str, source: str, item: str, metrics) -> str:
    return union_all(
        [
            f"SELECT '{section}' AS section, CAST({item} AS VARCHAR) AS item, '{m}' AS metric, "
            f"CAST({m} AS DOUBLE) AS value FROM {source}"
            for m in metrics
        ]
    )


_LOADED = f"""{_DIRTY}, loaded AS (SELECT site_id, site_name, CASE WHEN company <> 'TBC' THEN company END AS company, region,
  balance, events_1995, events_1996, events_1997, TRY_CAST(events_1998 AS DOUBLE) AS events_1998 FROM sites_dirty),
  part_loaded AS (SELECT site_id, company, balance FROM loaded)"""


_LOADED_NUMBERS = ("site_id", "balance", *DIRTY_PERIODS)
_LOADED_TEXTS = ("site_name", "company", "region")
_EXPLORED = [
    _section("metadata", "fs", "'all'", ("rows", "columns", "missing_percent", "duplicate_rows")),
    _section("numeric", "ns", '"column"', (*_METRICS, "missing_percent", "quality_score")),
    _section(
        "categorical",
        "cs",
        '"column"',
        ("count", "unique_count", "unique_percent", "top_frequency", "missing_percent", "quality_score"),
    ),
    _section("score", "ds", "'all'", ("scored_columns", "mean_score", "quality_score")),
    "SELECT 'validation', 'all', 'high_missing_percent', missing_percent FROM fs WHERE missing_percent > 0.5",
    "SELECT 'validation', 'all', 'duplicate_rows', duplicate_rows FROM fs WHERE duplicate_rows > 0",
]


@query(
    "load_and_explore",
    f"""{_LOADED}, {_score_ctes('loaded', _LOADED_NUMBERS, _LOADED_TEXTS)}, fs AS ({frame_sql('loaded', digits=12)}),
    ns AS (SELECT *, {_NUM_SCORE} AS quality_score FROM np), cs AS (SELECT *, {_CAT_SCORE} AS quality_score FROM cp),
    ds AS ({_DATASET_SCORE})
    SELECT section, item, metric, round(value, 3) AS value FROM ({union_all(_EXPLORED)}) q""",
)
def _(spark, sf_dir):
    _, tables = reports.load_and_explore(spark, written_csv(spark, sf_dir), CSV_SCHEMA, required=["site_id", "balance"])
    return rounded(reports.exploration_table(tables), 3)


def _scenario(name: str, source: str, columns) -> str:
    cells = " + ".join(f"({c} IS NULL)::INT" for c in columns)
    return f"""SELECT '{name}' AS scenario, count(*) AS rows, CAST({len(columns)} AS BIGINT) AS columns,
      {r(f"sum({cells}) * 100.0 / (count(*) * {len(columns)})", "missing_percent")},
      CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source}) q) AS BIGINT) AS duplicate_rows,
      CAST(2 AS BIGINT) AS warnings FROM {source}"""


@query(
    "load_scenarios",
    f"{_LOADED} "
    + union_all(
        [
            _scenario("default", "loaded", COLUMNS),
            _scenario("selected_columns", "part_loaded", ("site_id", "company", "balance")),
            _scenario("wide_types", "loaded", COLUMNS),
        ]
    ),
)
def _(spark, sf_dir):
    selected = ["site_id", "company", "balance"]
    return rounded(reports.load_scenarios(spark, written_csv(spark, sf_dir), CSV_SCHEMA, selected, ["site_id"]))


_STATS = ("mean", "median", "total", "site_count", "std", "min", "max")
_EDA_PARTS = [
    _section("company", "gc", "company", _STATS),
    _section("region", "gr", "region", _STATS),
    _section("trend", "tc", "'all'", ("overall_trend", "improving", "worsening", "stable")),
    f"SELECT 'summary', 'all', metric, value FROM ({SUMMARY_SQL}) s",
    _section("trend_share", "ts", "label", ("n", "share_percent")),
    _section("distribution", "hb", "bin", ("n",)),
]


@query(
    "eda_report",
    f"""{_MEASURED}, gc AS ({group_sql('measured', 'company', 'row_mean')}), gr AS ({group_sql('measured', 'region', 'row_mean')}),
    tc AS ({TREND_SQL}), ts AS ({SHARES_SQL}),
    h AS (SELECT row_mean FROM measured WHERE row_mean <= (SELECT quantile_cont(row_mean, 0.99) FROM measured)),
    hb AS ({bins_sql('h', 'row_mean')})
    SELECT section, item, metric, round(value, 3) AS value FROM ({union_all(_EDA_PARTS)}) q""",
)
def _(spark, sf_dir):
    tables = reports.analyse(sites(spark, sf_dir), "company", "region", PERIODS)
    return rounded(reports.analysis_table(tables, "company", "region"), 3)


@query(
    "before_after",
    f"""{_CLEAN}, fr AS ({FRAMES_SQL}), mi AS ({COMPARE_MISSING_SQL}), co AS ({COMPARE_SQL}), de AS ({DENSITY_SQL}),
    fo AS ({footprint_sql(2.0)}) SELECT section, item, metric, round(value, 3) AS value FROM ("""
    + union_all(
        [
            *[
                f"SELECT 'frame' AS section, '{m}' AS item, dataset AS metric, CAST({m} AS DOUBLE) AS value FROM fr"
                for m in ("rows", "columns", "missing_percent", "duplicate_rows")
            ],
            "SELECT 'missing', \"column\", dataset, missing_percent FROM mi",
            "SELECT 'counts', value, 'raw', raw FROM co",
            "SELECT 'counts', value, 'cleaned', cleaned FROM co",
            "SELECT 'density', CAST(bin AS VARCHAR), dataset, density FROM de",
            "SELECT 'footprint', concat(x_cell, '/', y_cell), dataset, n FROM fo",
        ]
    )
    + ") q",
)
def _(spark, sf_dir):
    raw = sites_raw(spark, sf_dir)
    return rounded(reports.before_after(raw, BASE, _KEY_COLUMNS, "events_1995", "company", 2.0), 3)
