"""Sources, schema checks, row rules and the cleaning job."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.catalog.registry import as_is, query, r, rounded, union_all
from weirworks.catalog.tables import (
    DIRTY_PERIODS,
    HEADINGS,
    PERIODS,
    headed,
    sites,
    sites_dirty,
    sites_flagged,
    sites_raw,
    table,
    with_views,
)
from weirworks.functions.columns import both_ends_present, first_last_delta, row_mean
from weirworks.operators import rules, schema
from weirworks.operators.compare import removal_matrix, unpivot_columns
from weirworks.operators.groups import label_trends
from weirworks.plans import cleaning
from weirworks.session import scratch_path
from weirworks.sources import publishing, sinks, tables

COLUMNS = ("site_id", "site_name", "company", "region", "balance", *DIRTY_PERIODS)
TEXTS = ("site_name", "company", "region")
BASE = cleaning.CleaningRules(
    required=("site_id", "balance", "company", "region"),
    bounds={"balance": (0.0, 9000.0)},
    periods=DIRTY_PERIODS,
    texts=TEXTS,
)
SETTINGS = {"balance_min": 500.0, "balance_max": 8000.0, "outlier_threshold": 2.5, "missing_threshold": 0.2}
STRATEGIES = cleaning.strategy_rules(BASE)

_DIRTY = with_views("sites_dirty")
_RAW = with_views("sites_raw")
_SITES = with_views("sites")
_SENTINELS = ", ".join("'" + s + "'" for s in tables.MISSING_STRINGS)
CSV_SCHEMA = T.StructType(
    [
        T.StructField("site_id", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in TEXTS],
        *[T.StructField(c, T.DoubleType()) for c in ("balance", *DIRTY_PERIODS)],
    ]
)


# ---- sources and sinks ------------------------------------------------------------------------


def written_csv(spark, sf_dir):
    return sinks.write_table(sites_dirty(spark, sf_dir), scratch_path(spark, "sites_csv"), "csv")


def _blank(column: str) -> str:
    return f"CASE WHEN {column} NOT IN ({_SENTINELS}) THEN {column} END AS {column}"


_CSV_SQL = (
    f"{_DIRTY} SELECT site_id, {', '.join(_blank(c) for c in TEXTS)}, balance, events_1995, events_1996, "
    "events_1997, TRY_CAST(events_1998 AS DOUBLE) AS events_1998 FROM sites_dirty"
)


@query("scan_csv", _CSV_SQL)
def _(spark, sf_dir):
    return tables.scan_csv(spark, written_csv(spark, sf_dir), CSV_SCHEMA)


@query(
    "na_normalise",
    f"{_DIRTY} SELECT site_id, {', '.join(_blank(c) for c in (*TEXTS, 'events_1998'))} FROM sites_dirty",
)
def _(spark, sf_dir):
    return tables.blank_sentinels(sites_dirty(spark, sf_dir)).select("site_id", *TEXTS, "events_1998")


@query(
    "scan_pruned",
    f"{_DIRTY} SELECT site_id, {_blank('company')}, TRY_CAST(events_1998 AS DOUBLE) AS events_1998 FROM sites_dirty",
)
def _(spark, sf_dir):
    path = written_csv(spark, sf_dir)
    return tables.scan_csv(spark, path, CSV_SCHEMA, ["site_id", "company", "events_1998"], ["site_id"], broken="keep")


@query("scan_split", _CSV_SQL)
def _(spark, sf_dir):
    return tables.scan_split(spark, written_csv(spark, sf_dir), CSV_SCHEMA, block_bytes=64 * 1024)


_DESKS = [
    {"region": "AFRICA", "desk": "south"},
    {"region": "AMERICA", "desk": "west"},
    {"region": "ASIA", "desk": "east"},
    {"region": "EUROPE", "desk": "west"},
]


@query(
    "from_rows",
    f"{_SITES}, desks AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{d['region']}', '{d['desk']}')" for d in _DESKS)
    + f") v(region, desk)) SELECT desk, count(*) AS sites, {r('sum(balance)', 'balance', 2)} "
    "FROM sites JOIN desks USING (region) GROUP BY desk",
)
def _(spark, sf_dir):
    desks = tables.from_rows(spark, _DESKS, T.StructType([T.StructField(c, T.StringType()) for c in ("region", "desk")]))
    joined = sites(spark, sf_dir).join(F.broadcast(desks), "region")  # as many rows as the list above
    return rounded(joined.groupBy("desk").agg(F.count("*").alias("sites"), F.sum("balance").alias("balance")), 2)


@query("snapshot_backup", f"{_RAW} SELECT * FROM sites_raw")
def _(spark, sf_dir):
    return spark.read.parquet(sinks.write_snapshot(sites_raw(spark, sf_dir), scratch_path(spark, "backup")))


# ---- the cleaning job in SQL --------------------------------------------------------------------


def clean_ctes(
    lo=0.0, hi=9000.0, z=3.0, min_periods=3, max_missing=0.1, empty_text=True, short=True, fill=None, prefix=""
) -> str:
    """CTEs <prefix>tagged (rewritten rows with the first failed rule), survivors and cleaned."""
    p = prefix
    numbers = ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in DIRTY_PERIODS)
    stats = ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_samp({c}) > 0 THEN stddev_samp({c}) END AS s_{c}" for c in DIRTY_PERIODS
    )
    blanked = ", ".join(
        f"CASE WHEN coalesce(abs(({c} - m_{c}) / s_{c}) > {z}, false) THEN NULL ELSE {c} END AS {c}"
        for c in DIRTY_PERIODS
    )
    trimmed = ", ".join(f"nullif(trim({c}), '') AS {c}" for c in TEXTS)
    valid = " + ".join(f"({c} IS NOT NULL)::INT" for c in DIRTY_PERIODS)
    missing = " + ".join(f"({c} IS NULL)::INT" for c in COLUMNS)
    rules_sql = "WHEN balance IS NULL THEN 'missing_coordinates' "
    rules_sql += f"WHEN NOT balance BETWEEN {lo} AND {hi} THEN 'invalid_balance' "
    if short:
        rules_sql += f"WHEN {valid} < {min_periods} THEN 'short_series' "
    if empty_text:
        rules_sql += f"WHEN coalesce({', '.join(TEXTS)}) IS NULL THEN 'empty_text' "
    if fill is None:
        cleaned = f"SELECT * FROM {p}survivors WHERE ({missing}) / {len(COLUMNS)}.0 <= {max_missing}"
    else:
        filled = ", ".join(f"coalesce({c}, {fill}) AS {c}" for c in ("balance", *DIRTY_PERIODS))
        cleaned = f"SELECT coalesce(site_id, {fill}) AS site_id, {', '.join(TEXTS)}, {filled} FROM {p}survivors"
    return f"""
{p}c0 AS (SELECT site_id, site_name, company, region, balance, {numbers} FROM sites_raw),
{p}m AS (SELECT {stats} FROM {p}c0 WHERE balance BETWEEN {lo} AND {hi}),
{p}rw AS (SELECT site_id, {trimmed}, balance, {blanked} FROM {p}c0, {p}m),
{p}tagged AS (SELECT *, CASE {rules_sql} END AS rule FROM {p}rw),
{p}survivors AS (SELECT DISTINCT {', '.join(COLUMNS)} FROM {p}tagged WHERE rule IS NULL),
{p}cleaned AS ({cleaned})"""


_OVERRIDES = {
    "strict_default": {},
    "relaxed_text": {"empty_text": False, "max_missing": 0.4},
    "spill_imputation": {"fill": 0, "short": False},
    "aggressive_outliers": {"z": 2.0, "min_periods": 4},
}
_SETTINGS_SQL = {"lo": 500.0, "hi": 8000.0, "z": 2.5, "max_missing": 0.2}


def _missing_total(source: str) -> str:
    return f"(SELECT coalesce(sum({' + '.join(f'({c} IS NULL)::INT' for c in COLUMNS)}), 0) FROM {source})"


def metrics_sql(prefix: str = "") -> str:
    p, width = prefix, len(COLUMNS)
    rows_in, rows_out = "(SELECT count(*) FROM sites_raw)", f"(SELECT count(*) FROM {p}cleaned)"
    extra = "(SELECT count(*) FROM sites_raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sites_raw) q)"
    return f"""SELECT {rows_in} AS rows_in, {rows_out} AS rows_out, {rows_in} - {rows_out} AS rows_removed,
  {r(f"{rows_out} * 100.0 / {rows_in}", "rows_retained_percent")},
  {r(f"{_missing_total('sites_raw')} * 100.0 / ({rows_in} * {width})", "initial_missing_percent")},
  {r(f"CASE WHEN {rows_out} > 0 THEN {_missing_total(p + 'cleaned')} * 100.0 / ({rows_out} * {width}) ELSE 0 END",
     "final_missing_percent")},
  CAST({extra} AS BIGINT) AS duplicate_reduction"""


def removals_sql(prefix: str = "", short=True, empty_text=True, fill=None, **_) -> str:
    p = prefix
    names = ["missing_coordinates", "invalid_balance"]
    names += ["short_series"] if short else []
    names += ["empty_text"] if empty_text else []
    parts = [
        f"SELECT {i + 1} AS step, '{name}' AS rule, count(*) AS rows_removed FROM {p}tagged WHERE rule = '{name}'"
        for i, name in enumerate(names)
    ]
    parts.append(
        f"SELECT {len(names) + 1}, 'duplicates', (SELECT count(*) FROM {p}tagged WHERE rule IS NULL) - "
        f"(SELECT count(*) FROM {p}survivors)"
    )
    if fill is None:
        parts.append(
            f"SELECT {len(names) + 2}, 'sparse_row', (SELECT count(*) FROM {p}survivors) - "
            f"(SELECT count(*) FROM {p}cleaned)"
        )
    return f"SELECT step, rule, rows_removed FROM ({union_all(parts)}) b WHERE rows_removed > 0"


_CLEAN = f"{_RAW}, {clean_ctes()}"
_ALL = ",".join(clean_ctes(prefix=f"{name}_", **o) for name, o in _OVERRIDES.items())


@query("clean_pipeline", f"{_CLEAN} SELECT {as_is(COLUMNS)} FROM cleaned")
def _(spark, sf_dir):
    return cleaning.clean(sites_raw(spark, sf_dir), BASE)


@query("settings_clean", f"{_RAW}, {clean_ctes(**_SETTINGS_SQL)} SELECT {as_is(COLUMNS)} FROM cleaned")
def _(spark, sf_dir):
    return cleaning.clean(sites_raw(spark, sf_dir), cleaning.rules_from_settings(BASE, SETTINGS))


@query("removal_breakdown", f"{_CLEAN} {removals_sql()}")
def _(spark, sf_dir):
    return cleaning.removal_breakdown(sites_raw(spark, sf_dir), BASE)


@query("cleaning_metrics", f"{_CLEAN} {metrics_sql()}")
def _(spark, sf_dir):
    return rounded(cleaning.cleaning_metrics(sites_raw(spark, sf_dir), BASE))


@query("write_clean", f"{_CLEAN} SELECT {as_is(COLUMNS)} FROM cleaned")
def _(spark, sf_dir):
    cleaned = cleaning.clean(sites_raw(spark, sf_dir), BASE)
    return spark.read.parquet(sinks.write_table(cleaned, scratch_path(spark, "cleaned")))


@query("publish_clean", f"{_CLEAN} SELECT {as_is(COLUMNS)} FROM cleaned")
def _(spark, sf_dir):
    """The raw rows published first, the cleaned ones over them; read back through the manifest."""
    base, raw = scratch_path(spark, "published"), sites_raw(spark, sf_dir)
    publishing.publish_tables({"sites": raw}, base)
    publishing.publish_tables({"sites": cleaning.clean(raw, BASE)}, base)
    return publishing.read_published(spark, base, "sites")


@query("publish_earlier", f"{_RAW} SELECT * FROM sites_raw")
def _(spark, sf_dir):
    """The publication before the last one stays readable."""
    base, raw = scratch_path(spark, "published"), sites_raw(spark, sf_dir)
    publishing.publish_tables({"sites": raw}, base)
    publishing.publish_tables({"sites": cleaning.clean(raw, BASE)}, base)
    return publishing.read_published(spark, base, "sites", back=1)


@query("write_report", f"{_CLEAN} {removals_sql()}")
def _(spark, sf_dir):
    breakdown = cleaning.removal_breakdown(sites_raw(spark, sf_dir), BASE)
    paths = sinks.write_report({"removals": breakdown}, scratch_path(spark, "report"))
    return spark.read.schema(breakdown.schema).json(paths["removals"])


_JOB_FIGURES = ("rows_in", "rows_out", "rows_removed", "rows_retained_percent", "initial_missing_percent",
                "final_missing_percent", "duplicate_reduction")
_JOB_SQL = union_all(
    [
        "SELECT 'backup' AS result, 'rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM sites_raw",
        "SELECT 'cleaned', 'rows', CAST(count(*) AS DOUBLE) FROM cleaned",
        f"SELECT 'removals', concat(step, ' ', rule), CAST(rows_removed AS DOUBLE) FROM ({removals_sql()}) j",
        *[f"SELECT 'metrics', '{c}', CAST({c} AS DOUBLE) FROM ({metrics_sql()}) j" for c in _JOB_FIGURES],
    ]
)


@query("cleaning_job", f"{_CLEAN} {_JOB_SQL}")
def _(spark, sf_dir):
    """The whole job (snapshot, clean, write, score, report), and what its files hold, in long form."""
    paths = cleaning.cleaning_job(sites_raw(spark, sf_dir), BASE, scratch_path(spark, "job"))
    whole = [spark.read.parquet(paths[name]).agg(F.lit(name).alias("result"), F.lit("rows").alias("item"),
                                                 F.count("*").cast("double").alias("value")) for name in ("backup", "cleaned")]
    removals = spark.read.json(paths["removals"]).select(
        F.lit("removals"), F.concat_ws(" ", F.col("step").cast("string"), "rule"), F.col("rows_removed").cast("double"))
    metrics = rounded(spark.read.json(paths["metrics"]).select(*[F.col(c).cast("double") for c in _JOB_FIGURES]))
    figures = metrics.select(F.lit("metrics"), F.explode(F.create_map(*[x for c in _JOB_FIGURES for x in (F.lit(c), F.col(c))])))
    return whole[0].unionAll(whole[1]).unionAll(removals).unionAll(figures)


@query(
    "strategy_summary",
    f"{_RAW}, {_ALL} "
    + union_all([f"SELECT '{n}' AS strategy, * FROM ({metrics_sql(n + '_')}) s" for n in _OVERRIDES]),
)
def _(spark, sf_dir):
    return rounded(cleaning.strategy_summary(sites_raw(spark, sf_dir), STRATEGIES))


_GRID = union_all(
    [f"SELECT '{n}' AS strategy, * FROM ({removals_sql(n + '_', **o)}) s" for n, o in _OVERRIDES.items()]
)


@query("strategy_grid", f"{_RAW}, {_ALL} {_GRID}")
def _(spark, sf_dir):
    return cleaning.strategy_removals(sites_raw(spark, sf_dir), STRATEGIES)


@query(
    "removal_pivot",
    f"{_RAW}, {_ALL} SELECT rule, "
    + ", ".join(
        f"CAST(coalesce(sum(CASE WHEN strategy = '{n}' THEN rows_removed END), 0) AS BIGINT) AS {n}" for n in _OVERRIDES
    )
    + f" FROM ({_GRID}) g GROUP BY rule",
)
def _(spark, sf_dir):
    return removal_matrix(cleaning.strategy_removals(sites_raw(spark, sf_dir), STRATEGIES), list(STRATEGIES))


# ---- schema -----------------------------------------------------------------------------------

_HEADED = f"{_RAW}, h AS (" + union_all(
    [f"SELECT '{h}' AS \"column\", count({c}) AS filled_rows FROM sites_raw" for c, h in HEADINGS.items()]
) + ")"


@query(
    "schema_contract",
    _RAW
    + " "
    + union_all(
        [
            f"SELECT '{c}' AS \"column\", 'required' AS role, true AS present, count({c}) AS filled_rows FROM sites_raw"
            for c in ("balance", "company")
        ]
        + [
            "SELECT 'latitude', 'required', false, CAST(0 AS BIGINT)",
            "SELECT 'site_name', 'optional', true, count(site_name) FROM sites_raw",
            "SELECT 'permit', 'optional', false, CAST(0 AS BIGINT)",
        ]
    ),
)
def _(spark, sf_dir):
    return schema.schema_contract(sites_raw(spark, sf_dir), ["balance", "company", "latitude"], ["site_name", "permit"])


@query(
    "column_name_check",
    f"""{_HEADED} SELECT "column", filled_rows, CASE
      WHEN regexp_matches(lower("column"), '^spill events [0-9]{{4}}$') THEN 'spill_event'
      WHEN lower("column") = 'water company' THEN 'water_company'
      WHEN lower("column") = 'river basin district' THEN 'river_basin'
      WHEN lower("column") = 'site name' THEN 'site_name'
      WHEN lower("column") IN ('latitude', 'longitude') THEN 'coordinate' END AS matched_pattern FROM h""",
)
def _(spark, sf_dir):
    return schema.check_names(schema.header_table(headed(sites_raw(spark, sf_dir))))


@query(
    "typo_suggest",
    f"""{_HEADED} SELECT "column", filled_rows, typo, regexp_replace("column", typo, fix, 'gi') AS suggestion
    FROM h JOIN (VALUES ('receuving', 'Receiving'), ('enviroment', 'Environment'), ('permitt', 'Permit'),
      ('compnay', 'Company'), ('latitute', 'Latitude'), ('longitute', 'Longitude')) t(typo, fix)
      ON contains(lower("column"), typo)""",
)
def _(spark, sf_dir):
    return schema.suggest_names(schema.header_table(headed(sites_raw(spark, sf_dir))))


_PATTERNS = ("^Latitude$", "^Site Name$", "^Water Company$", r"^Spill Events \d{4}$")


@query(
    "required_patterns",
    f"{_HEADED} "
    + union_all(
        [
            f"SELECT '{p}' AS pattern WHERE NOT EXISTS (SELECT 1 FROM h WHERE regexp_matches(\"column\", '(?i){p}'))"
            for p in _PATTERNS
        ]
    ),
)
def _(spark, sf_dir):
    return schema.unmatched_patterns(schema.header_table(headed(sites_raw(spark, sf_dir))), _PATTERNS)


@query("to_numeric_coerce", f"{_DIRTY} SELECT site_id, TRY_CAST(events_1998 AS DOUBLE) AS events_1998 FROM sites_dirty")
def _(spark, sf_dir):
    return rules.coerce_numeric(sites_dirty(spark, sf_dir), ["events_1998"]).select("site_id", "events_1998")


_LINE_INTS = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int"}
_LINE_TEXT = ("l_returnflag", "l_linestatus")
_LINE_DOUBLES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "narrow_types",
    union_all(
        [
            f"""SELECT '{c}' AS "column", '{t}' AS current_type,
              CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint'
                   WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint'
                   WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE '{t}' END AS decision
              FROM lineitem"""
            for c, t in _LINE_INTS.items()
        ]
        + [
            f"""SELECT '{c}', 'string', CASE WHEN count(DISTINCT {c}) * 1.0 / count(*) < 0.5 THEN 'low_cardinality'
              ELSE 'string' END FROM lineitem"""
            for c in _LINE_TEXT
        ]
        + [f"SELECT '{c}', 'double', 'float'" for c in _LINE_DOUBLES]
    ),
)
def _(spark, sf_dir):
    return schema.narrow_decisions(table(spark, sf_dir, "lineitem").drop("l_shipdate"))


@query(
    "narrow_table",
    f"""SELECT {", ".join([*_LINE_INTS, *_LINE_TEXT])}, {", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in _LINE_DOUBLES)}
    FROM lineitem""",
)
def _(spark, sf_dir):
    # The table itself in the decided types.
    return schema.narrow_types(table(spark, sf_dir, "lineitem").drop("l_shipdate"))


_FLAGGED = with_views("sites_flagged")


@query(
    "flags_to_int",
    f"""{_FLAGGED} SELECT site_id, CASE bathing_flag WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS bathing_flag,
    CASE priority_flag WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS priority_flag FROM sites_flagged""",
)
def _(spark, sf_dir):
    return rules.flags_to_int(sites_flagged(spark, sf_dir), "flag").select("site_id", "bathing_flag", "priority_flag")


@query(
    "select_by_type",
    union_all(
        [
            f"SELECT '{c}' AS \"column\", '{'other' if c in (*_LINE_TEXT, 'l_shipdate') else 'numeric'}' AS kind, "
            f"count({c}) AS filled_rows FROM lineitem"
            for c in (*_LINE_INTS, *_LINE_DOUBLES, *_LINE_TEXT, "l_shipdate")
        ]
    ),
)
def _(spark, sf_dir):
    return schema.select_by_type(table(spark, sf_dir, "lineitem"))


# ---- row rules --------------------------------------------------------------------------------


@query("drop_missing", f"{_SITES} SELECT * FROM sites WHERE events_1995 IS NOT NULL AND events_1996 IS NOT NULL")
def _(spark, sf_dir):
    return rules.drop_missing(sites(spark, sf_dir), ["events_1995", "events_1996"])


@query("range_filter", f"{_SITES} SELECT * FROM sites WHERE balance BETWEEN 0 AND 9000 AND events_1995 BETWEEN 1 AND 3")
def _(spark, sf_dir):
    return rules.range_filter(sites(spark, sf_dir), {"balance": (0, 9000), "events_1995": (1, 3)})


@query(
    "range_violations",
    f"""{_SITES} SELECT 'balance' AS metric, count(*) FILTER (coalesce(NOT balance BETWEEN 0 AND 9000, true))
      AS invalid_rows, CAST(0 AS DOUBLE) AS low, CAST(9000 AS DOUBLE) AS high FROM sites UNION ALL
    SELECT 'events_1995', count(*) FILTER (coalesce(NOT events_1995 BETWEEN 1 AND 3, true)), 1, 3 FROM sites""",
)
def _(spark, sf_dir):
    return rules.range_violations(sites(spark, sf_dir), {"balance": (0, 9000), "events_1995": (1, 3)})


@query(
    "null_outliers",
    """WITH m AS (SELECT avg(value) AS mean, stddev_samp(value) AS dev FROM events)
    SELECT event_id, user_id, event_type, CASE WHEN dev > 0 AND abs((value - mean) / dev) > 3 THEN NULL ELSE value END
      AS value FROM events, m""",
)
def _(spark, sf_dir):
    return rules.null_outliers(
        table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value"]), ["value"]
    )


_VALID = " + ".join(f"({c} IS NOT NULL)::INT" for c in PERIODS)


@query("min_valid_columns", f"{_SITES} SELECT * FROM sites WHERE {_VALID} >= 5")
def _(spark, sf_dir):
    return rules.min_valid_columns(sites(spark, sf_dir), PERIODS, 5)


@query(
    "trim_text",
    f"{_DIRTY} SELECT site_id, " + ", ".join(f"nullif(trim({c}), '') AS {c}" for c in TEXTS) + " FROM sites_dirty",
)
def _(spark, sf_dir):
    return rules.trim_text(sites_dirty(spark, sf_dir), TEXTS).select("site_id", *TEXTS)


@query(
    "drop_all_empty_text",
    f"{_RAW} SELECT site_id, region, company FROM sites_raw WHERE coalesce(region, company) IS NOT NULL",
)
def _(spark, sf_dir):
    chosen = sites_raw(spark, sf_dir).select("site_id", "region", "company")
    return rules.drop_all_empty_text(chosen, ["region", "company"])


@query("drop_duplicates", f"{_DIRTY} SELECT DISTINCT * FROM sites_dirty")
def _(spark, sf_dir):
    return rules.drop_duplicates(sites_dirty(spark, sf_dir))


_MISSING = " + ".join(f"({c} IS NULL)::INT" for c in COLUMNS)


@query("drop_sparse_rows", f"{_RAW} SELECT * FROM sites_raw WHERE ({_MISSING}) / {len(COLUMNS)}.0 <= 0.2")
def _(spark, sf_dir):
    return rules.drop_sparse_rows(sites_raw(spark, sf_dir), 0.2)


_NAMES = ("site_id", "site_name", "company", "region", "balance")


@query(
    "fill_constant",
    f"{_SITES} SELECT {', '.join(_NAMES)}, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in PERIODS) + " FROM sites",
)
def _(spark, sf_dir):
    return rules.fill_constant(sites(spark, sf_dir), 0)


@query(
    "fill_median",
    f"{_SITES}, m AS (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in PERIODS)
    + " FROM sites) SELECT site_id, "
    + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in PERIODS)
    + " FROM sites, m",
)
def _(spark, sf_dir):
    return rules.fill_median(sites(spark, sf_dir), PERIODS).select("site_id", *PERIODS)


ROW_MEAN = f"({' + '.join(f'coalesce({c}, 0)' for c in PERIODS)}) / nullif({_VALID}, 0)"
DELTA = "coalesce(events_2001, 0) - coalesce(events_1995, 0)"


@query("row_mean", f"{_SITES} SELECT site_id, {r(ROW_MEAN, 'row_mean', 6)} FROM sites")
def _(spark, sf_dir):
    return rounded(sites(spark, sf_dir).select("site_id", row_mean(PERIODS).alias("row_mean")), 6)


@query(
    "first_last_delta",
    f"{_SITES} SELECT site_id, {DELTA} AS trend_delta, events_1995 IS NOT NULL AND events_2001 IS NOT NULL "
    "AS both_present FROM sites",
)
def _(spark, sf_dir):
    delta, both = first_last_delta(PERIODS), both_ends_present(PERIODS)
    return sites(spark, sf_dir).select("site_id", delta.alias("trend_delta"), both.alias("both_present"))


@query(
    "trend_label",
    f"""{_SITES}, d AS (SELECT site_id, {DELTA} AS trend_delta FROM sites) SELECT site_id, trend_delta,
    CASE WHEN trend_delta < 0 THEN 'improving' WHEN trend_delta > 0 THEN 'worsening' ELSE 'stable' END AS trend_label
    FROM d""",
)
def _(spark, sf_dir):
    measured = sites(spark, sf_dir).select("site_id", first_last_delta(PERIODS).alias("trend_delta"))
    return label_trends(measured, "trend_delta")


@query(
    "percentile_cap",
    """WITH c AS (SELECT quantile_cont(l_extendedprice, 0.99) AS cutoff FROM lineitem)
    SELECT round(max(cutoff), 4) AS cutoff, count(*) FILTER (l_extendedprice <= cutoff) AS kept_rows,
      count(*) FILTER (l_extendedprice > cutoff) AS excluded_rows FROM lineitem, c""",
)
def _(spark, sf_dir):
    return rounded(rules.cap_summary(table(spark, sf_dir, "lineitem", ["l_extendedprice"]), "l_extendedprice"))


@query(
    "percentile_cap_rows",
    f"""{_SITES}, c AS (SELECT quantile_cont(balance, 0.95) AS cutoff FROM sites)
    SELECT site_id, balance FROM sites, c WHERE balance <= cutoff""",
)
def _(spark, sf_dir):
    return rules.percentile_cap(sites(spark, sf_dir).select("site_id", "balance"), "balance", 95)


@query("project_features", f"{_SITES} SELECT site_id, events_1995, events_1996, events_1997, balance FROM sites")
def _(spark, sf_dir):
    # "latitude" is absent, so the stand-in rule applies: first number column as target, the next three as features.
    return rules.project_features(sites(spark, sf_dir), ["latitude"], "events_2000", keys=["site_id"], stand_ins=3)


_COMPLETE = "events_1995 IS NOT NULL AND events_1996 IS NOT NULL"


@query(
    "input_gate",
    f"""{_SITES} SELECT 'not_empty' AS "check", count(*) > 0 AS ok, count(*) AS detail FROM sites UNION ALL
    SELECT 'required_columns', true, 0 UNION ALL
    SELECT 'min_rows', count(*) FILTER ({_COMPLETE}) >= 500, count(*) FILTER ({_COMPLETE}) FROM sites UNION ALL
    SELECT 'complete_rows', true, count(*) - count(*) FILTER ({_COMPLETE}) FROM sites""",
)
def _(spark, sf_dir):
    return rules.input_gate(sites(spark, sf_dir), ["events_1995", "events_1996"], min_rows=500)


def _finding(rule, column, affected, threshold, severity):
    return f"""SELECT '{rule}' AS rule, '{column}' AS "column", {affected} AS affected_rows, count(*) AS total_rows,
      round({affected} * 100.0 / count(*), 4) AS affected_percent, CAST({threshold} AS DOUBLE) AS threshold,
      '{severity}' AS severity FROM sites_raw"""


@query(
    "rule_violations",
    f"{_RAW} SELECT * FROM ("
    + union_all(
        [
            _finding("column", "latitude", "count(*)", 0, "error"),
            _finding("range", "balance", "count(*) FILTER (NOT balance BETWEEN 0 AND 9000)", 0, "error"),
            *[
                _finding("quality", c, f"count(*) FILTER ({c} IS NULL)", 0.05, "warning")
                for c in ("company", "region", "balance")
            ],
        ]
    )
    + ") f WHERE affected_rows > 0 AND affected_percent > threshold * 100",
)
def _(spark, sf_dir):
    found = rules.rule_violations(
        sites_raw(spark, sf_dir), ["latitude", "company", "region"], {"balance": (0, 9000)}, missing_threshold=0.05
    )
    return rounded(found)


@query(
    "unpivot_columns",
    f"{_SITES} "
    + union_all([f"SELECT site_id, '{c}' AS period, {c} AS events FROM sites" for c in PERIODS]),
)
def _(spark, sf_dir):
    return unpivot_columns(sites(spark, sf_dir), ["site_id"], PERIODS, "period", "events")
