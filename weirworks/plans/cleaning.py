"""The cleaning job: rewritten and filtered rows, what each rule removed, and the figures around it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.functions.columns import (
    all_present,
    any_present,
    long_rows,
    missing_count,
    percent,
    present_count,
    quoted,
    row_hash,
)
from weirworks.operators.profile import column_scores, score_from_columns
from weirworks.operators.rules import (
    coerce_numeric,
    drop_duplicates,
    drop_sparse_rows,
    fill_constant,
    is_sparse,
    moments,
    null_outliers,
    trim_text,
)
from weirworks.operators.schema import require_columns
from weirworks.session import materialised
from weirworks.sources.publishing import commit_version, new_version
from weirworks.sources.sinks import write_report, write_snapshot, write_table


#: How the audit's own columns begin.
_OWN = "__audit_"


@dataclass(frozen=True)
class CleaningRules:
    """Which columns each rule looks at and how strict it is."""

    required: Sequence[str] = ()
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    periods: Sequence[str] = ()
    texts: Sequence[str] = ()
    strict: bool = True
    blank_outliers: bool = True
    outlier_z: float = 3.0
    drop_short_series: bool = True
    min_periods: int = 3
    drop_empty_text: bool = True
    deduplicate: bool = True
    max_missing_share: float = 0.1
    fill: bool = False
    fill_value: float | str | None = None

    def present_in(self, df: DataFrame) -> CleaningRules:
        """The same rules limited to the columns a table has."""
        have = set(df.columns)
        return replace(
            self,
            bounds={c: b for c, b in self.bounds.items() if c in have},
            periods=[c for c in self.periods if c in have],
            texts=[c for c in self.texts if c in have],
        )


def rules_from_settings(base: CleaningRules, settings: Mapping[str, float | bool]) -> CleaningRules:
    """Rules with the thresholds of a settings table laid over them.

    Knows ``missing_threshold``, ``outlier_threshold``, ``strict_validation`` and ``<column>_min`` / ``<column>_max``.
    """
    bounds = {
        c: (float(settings.get(f"{c}_min", lo)), float(settings.get(f"{c}_max", hi)))
        for c, (lo, hi) in base.bounds.items()
    }
    return replace(
        base,
        bounds=bounds,
        max_missing_share=float(settings.get("missing_threshold", base.max_missing_share)),
        outlier_z=float(settings.get("outlier_threshold", base.outlier_z)),
        strict=bool(settings.get("strict_validation", base.strict)),
    )


def _bound_rules(rules: CleaningRules) -> list[tuple[str, Column]]:
    """(name, condition to fail) of the coordinate-like rules in order."""
    if not rules.bounds:
        return []
    found = [("missing_coordinates", ~all_present(list(rules.bounds)))]
    found += [(f"invalid_{c}", ~quoted(c).between(lo, hi)) for c, (lo, hi) in rules.bounds.items()]
    return found


def _outlier_stats(source: DataFrame, rules: CleaningRules) -> dict[str, tuple[float | None, float | None]]:
    """Mean and deviation of each period over the rows that pass the coordinate rules; one pass that returns one row."""
    inside = coerce_numeric(source, rules.periods) if rules.periods else source
    for _, fails in _bound_rules(rules):
        inside = inside.filter(~fails)
    return moments(inside, rules.periods)


def _rewritten(df: DataFrame, rules: CleaningRules, stats: Mapping[str, tuple[float | None, float | None]] | None) -> DataFrame:
    """Columns after coercion, outlier blanking and trimming; no row is removed."""
    if rules.periods:
        df = coerce_numeric(df, rules.periods)
        if rules.blank_outliers:
            df = null_outliers(df, rules.periods, rules.outlier_z, stats)
    return trim_text(df, rules.texts) if rules.texts else df


def _row_rules(rules: CleaningRules) -> list[tuple[str, Column]]:
    """(name, condition to fail) of all rules that judge a single rewritten row, in order."""
    found = _bound_rules(rules)
    if rules.periods and rules.drop_short_series:
        found.append(("short_series", present_count(rules.periods) < rules.min_periods))
    if rules.texts and rules.drop_empty_text:
        found.append(("empty_text", ~any_present(rules.texts)))
    return found


def _gate(df: DataFrame, rules: CleaningRules) -> CleaningRules:
    if rules.strict:
        require_columns(df, rules.required)
    return rules.present_in(df)


def clean(df: DataFrame, rules: CleaningRules) -> DataFrame:
    """The cleaned table: coordinates, series, text, duplicates, then sparse rows or filling."""
    rules = _gate(df, rules)
    kept = _rewritten(df, rules, _outlier_stats(df, rules) if rules.blank_outliers else None)
    for _, fails in _row_rules(rules):
        kept = kept.filter(~fails)
    if rules.deduplicate:
        kept = drop_duplicates(kept)
    if not rules.fill:
        return drop_sparse_rows(kept, rules.max_missing_share)
    return kept if rules.fill_value is None else fill_constant(kept, rules.fill_value)


def _rewriting(rules: CleaningRules) -> tuple:
    """What the rewritten rows depend on; strategies that agree in it share them and their digests."""
    blanks = (rules.outlier_z, tuple(sorted(rules.bounds.items()))) if rules.periods and rules.blank_outliers else None
    return tuple(rules.periods), blanks, tuple(rules.texts)


def _outcome(rewritten: DataFrame, names: Sequence[str], rules: CleaningRules) -> Column:
    """A struct of what becomes of each rewritten row: rule, digest, open cells, sparse."""
    row_rules = _row_rules(rules)
    # The first failed rule. An array function is outside whole-stage code, which would grow too long with many strategies in one loop.
    marks = F.array(F.lit(None).cast("string"), *[F.when(fails, F.lit(name)) for name, fails in row_rules])
    failed = F.get(F.filter(marks, lambda mark: mark.isNotNull()), 0)
    missing = F.col(f"{_OWN}open")
    still_open = missing
    if rules.fill and rules.fill_value is not None:
        text = isinstance(rules.fill_value, str)
        still_open = missing_count([c for c in names if (rewritten.schema[c].dataType.simpleString() == "string") != text])
    sparse = missing / F.lit(len(names)) > rules.max_missing_share if not rules.fill else F.lit(False)
    return F.struct(
        failed.alias("rule"), F.col(f"{_OWN}row").alias("row"), still_open.cast("long").alias("open"), sparse.alias("sparse")
    )


def _audits(df: DataFrame, strategies: Mapping[str, CleaningRules]) -> tuple[DataFrame, dict[str, list[str]]]:
    """One row of counts for each strategy from one scan, and the names of each strategy's rules in order.

    Every raw row gets a vector with its outcome under each strategy. Only digests and those vectors move: equal raw rows
    meet first, and only then is a vector taken apart, so copies cost one row whatever the number of strategies.
    Strategies that rewrite rows alike share the rewritten row. Outlier statistics take one more pass for each different
    choice of periods and bounds.
    """
    strategies = {name: _gate(df, rules) for name, rules in strategies.items()}
    names = df.columns
    clash = [c for c in names if c.startswith(_OWN)]
    if clash:
        raise ValueError(f"columns cannot be audited under these names: {clash}")
    alike: dict[tuple, list[str]] = {}
    for name, rules in strategies.items():
        alike.setdefault(_rewriting(rules), []).append(name)
    known: dict[tuple, dict[str, tuple[float | None, float | None]]] = {}
    whole = F.struct(*[quoted(c).alias(c) for c in names])
    judged = df.select(row_hash(df, names).alias(f"{_OWN}raw"), missing_count(names).cast("long").alias(f"{_OWN}missing"), whole.alias(f"{_OWN}whole"))
    made: dict[str, str] = {}
    for members in alike.values():
        rules, stats = strategies[members[0]], None
        if rules.periods and rules.blank_outliers:
            source = tuple(rules.periods), tuple(rules.bounds.items())
            stats = known[source] = known[source] if source in known else _outlier_stats(df, rules)
        # Each group of strategies starts from the row as it came.
        own = [c for c in judged.columns if c.startswith(_OWN) and c not in (f"{_OWN}row", f"{_OWN}open")]
        fresh = judged.select(*own, *[F.col(f"{_OWN}whole").getField(c).alias(c) for c in names])
        rewritten = _rewritten(fresh, rules, stats)
        rewritten = rewritten.withColumns({f"{_OWN}row": row_hash(rewritten, names), f"{_OWN}open": missing_count(names)})
        outcomes = [_outcome(rewritten, names, strategies[name]).alias(f"{_OWN}outcome{len(made) + i}") for i, name in enumerate(members)]
        made |= {name: f"{_OWN}outcome{len(made) + i}" for i, name in enumerate(members)}
        judged = rewritten.select(*own, *outcomes)
    vector = F.array(*[made[name] for name in strategies])
    # Equal raw rows are judged alike: the vector follows from the digest, and as a key it needs no buffer of its own.
    keys = [F.col(f"{_OWN}raw").alias("raw"), F.col(f"{_OWN}missing").alias("missing"), vector.alias("vector")]
    raw = judged.select(*keys).groupBy("raw", "missing", "vector").agg(F.count("*").alias("copies"))
    each = raw.select("copies", "missing", F.posexplode("vector").alias("at", "was")).select("copies", "missing", "at", "was.*")
    grouped = each.groupBy("at", "row", "rule").agg(
        F.sum("copies").alias("n"),
        F.sum(F.col("copies") * F.col("missing")).alias("missing"),
        F.sum(F.col("copies") - 1).alias("extra"),
        F.max("open").alias("open"),
        F.max("sparse").alias("sparse"),
    )
    judges = list(strategies.values())
    removes = {name: [rule for rule, _ in _row_rules(rules)] for name, rules in strategies.items()}
    once = F.col("at").isin([i for i, rules in enumerate(judges) if rules.deduplicate])
    survives = F.col("rule").isNull()
    survivors = F.when(survives, F.when(once, F.lit(1)).otherwise(F.col("n"))).otherwise(F.lit(0))
    kept = F.when(F.col("sparse"), F.lit(0)).otherwise(survivors)
    total = {
        "rows_in": F.sum("n"),
        "rows_out": F.sum(kept),
        "missing_in": F.sum("missing"),
        "missing_out": F.sum(kept * F.col("open")),
        "duplicates_in": F.sum("extra"),
        "duplicates_out": F.sum(F.when(kept > 0, kept - 1).otherwise(F.lit(0))),
    }
    every_rule = dict.fromkeys(rule for rules in removes.values() for rule in rules)
    removed = {rule: F.sum(F.when(F.col("rule") == rule, F.col("n")).otherwise(F.lit(0))) for rule in every_rule}
    removed["duplicates"] = F.sum(F.when(survives & once, F.col("n") - 1).otherwise(F.lit(0)))
    removed["sparse_row"] = F.sum(survivors - kept)
    for name, rules in strategies.items():
        removes[name] += (["duplicates"] if rules.deduplicate else []) + ([] if rules.fill else ["sparse_row"])
    counts = grouped.groupBy("at").agg(*[v.cast("bigint").alias(k) for k, v in {**total, **removed}.items()])
    # A row for every strategy, also where the table is empty.
    listed = df.sparkSession.range(len(judges)).select(F.col("id").cast("int").alias("at")).join(F.broadcast(counts), "at", "left")
    label = F.element_at(F.array(*[F.lit(name) for name in strategies]), F.col("at") + 1)
    figures = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in (*total, *removed)]
    return listed.select(label.alias("strategy"), *figures, F.lit(len(names)).cast("bigint").alias("width")), removes


def _audit(df: DataFrame, rules: CleaningRules) -> tuple[DataFrame, list[str]]:
    """One row with all counts of a cleaning run, and its rules in order."""
    counts, removes = _audits(df, {"": rules})
    return counts, removes[""]


def _breakdown(counts: DataFrame, removed: Sequence[str]) -> DataFrame:
    rows = [
        {"step": F.lit(i + 1), "rule": F.lit(name), "rows_removed": F.col(name)} for i, name in enumerate(removed)
    ]
    return long_rows(counts, rows).filter(F.col("rows_removed") > 0)


def _figures(counts: DataFrame, *labels: str) -> DataFrame:
    c = F.col
    return counts.select(
        *labels,
        "rows_in",
        "rows_out",
        (c("rows_in") - c("rows_out")).alias("rows_removed"),
        percent(c("rows_out"), c("rows_in")).alias("rows_retained_percent"),
        percent(c("missing_in"), c("rows_in") * c("width")).alias("initial_missing_percent"),
        percent(c("missing_out"), c("rows_out") * c("width")).alias("final_missing_percent"),
        (c("duplicates_in") - c("duplicates_out")).alias("duplicate_reduction"),
    )


def removal_breakdown(df: DataFrame, rules: CleaningRules) -> DataFrame:
    """(step, rule, rows_removed) in pipeline order; a row counts for the first rule it fails."""
    return _breakdown(*_audit(df, rules))


def cleaning_metrics(df: DataFrame, rules: CleaningRules) -> DataFrame:
    """Rows, retained and missing percent before and after, and the drop in duplicates, in one row."""
    return _figures(_audit(df, rules)[0])


def cleaning_job(df: DataFrame, rules: CleaningRules, base: str, backup: bool = True) -> dict[str, str]:
    """Snapshot, clean, score and write everything as one published version; returns the written paths.

    The tables of an earlier run stay current until all of this one's are written.
    """
    spark, version = df.sparkSession, new_version(base)
    paths = {"backup": write_snapshot(df, f"{version}/backup")} if backup else {}
    paths["cleaned"] = write_table(clean(df, rules), f"{version}/cleaned")
    cleaned = spark.read.parquet(paths["cleaned"])
    counts, removed = _audit(df, rules)
    counts = materialised(counts, "audit")  # one row
    scores = materialised(column_scores(cleaned), "scores")  # one row per column
    tables = {
        "removals": _breakdown(counts, removed),
        "metrics": _figures(counts),
        "column_scores": scores,
        "score": score_from_columns(scores),
    }
    paths |= write_report(tables, f"{version}/report")
    commit_version(spark, base, version, paths)
    return paths


def strategy_rules(base: CleaningRules) -> dict[str, CleaningRules]:
    """The four strategies of the comparison grid (fixed names and overrides)."""
    return {
        "strict_default": base,
        "relaxed_text": replace(base, drop_empty_text=False, max_missing_share=0.4),
        "spill_imputation": replace(base, fill=True, fill_value=0, drop_short_series=False, min_periods=2),
        "aggressive_outliers": replace(base, outlier_z=2.0, min_periods=4),
    }


def strategy_summary(df: DataFrame, strategies: Mapping[str, CleaningRules]) -> DataFrame:
    """One row of figures per strategy, all from one scan and one grouping of the raw rows."""
    return _figures(_audits(df, strategies)[0], "strategy")


def strategy_removals(df: DataFrame, strategies: Mapping[str, CleaningRules]) -> DataFrame:
    """(strategy, step, rule, rows_removed) over all strategies, all from one scan and one grouping of the raw rows."""
    counts, removes = _audits(df, strategies)
    if not any(removes.values()):  # nothing that could remove a row
        return df.sparkSession.createDataFrame([], "strategy string, step int, rule string, rows_removed long")
    rows = [
        F.struct(F.lit(name).alias("strategy"), F.lit(i + 1).alias("step"), F.lit(rule).alias("rule"), F.col(rule).alias("rows_removed"))
        for name, rules in removes.items()
        for i, rule in enumerate(rules)
    ]
    own = F.filter(F.array(*rows), lambda x: (x["strategy"] == F.col("strategy")) & (x["rows_removed"] > 0))
    return counts.select(F.inline(own))
