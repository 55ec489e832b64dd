"""The input of the registered queries: site tables derived from the given tables, by the same SQL in both engines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

YEARS = tuple(range(1995, 2002))
PERIODS = tuple(f"events_{y}" for y in YEARS)
DIRTY_PERIODS = PERIODS[:4]

# Orders are reduced to one row per customer before the join, so the join never multiplies rows.
_COUNTS = ",\n         ".join(
    f"SUM(CASE WHEN order_year = {y} THEN 1.0E0 END) AS events_{y}" for y in YEARS
)
SITES = f"""
  SELECT c.c_custkey AS site_id, c.c_name AS site_name, c.c_mktsegment AS company, r.r_name AS region,
         c.c_acctbal AS balance, {", ".join("y." + p for p in PERIODS)}
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT o_custkey, {_COUNTS}
             FROM (SELECT o_custkey, year(o_orderdate) AS order_year FROM orders) o GROUP BY o_custkey) y ON y.o_custkey = c.c_custkey"""

_DIRTY_ROWS = """
  SELECT site_id,
    CASE WHEN site_id % 11 = 0 THEN '   '
         WHEN site_id % 7 = 0 THEN concat('  ', site_name, ' ') ELSE site_name END AS site_name,
    CASE WHEN site_id % 13 = 0 THEN 'TBC' ELSE company END AS company,
    CASE WHEN site_id % 19 = 0 THEN NULL ELSE region END AS region,
    balance, events_1995, events_1996, events_1997,
    CASE WHEN site_id % 17 = 0 THEN 'N/A' ELSE CAST(CAST(events_1998 AS INT) AS STRING) END AS events_1998
  FROM sites"""
SITES_DIRTY = f"""
  SELECT * FROM ({_DIRTY_ROWS}) d
  UNION ALL
  SELECT * FROM ({_DIRTY_ROWS}) d WHERE site_id % 50 = 0"""

# Sentinels gone: the input of the cleaning jobs.
SITES_RAW = """
  SELECT site_id, site_name, CASE WHEN company <> 'TBC' THEN company END AS company, region, balance,
         events_1995, events_1996, events_1997, CASE WHEN events_1998 <> 'N/A' THEN events_1998 END AS events_1998
  FROM sites_dirty"""

# Flags as text, and rows with gaps, for the clustering input.
SITES_FLAGGED = """
  SELECT site_id, balance, events_1995, events_2001,
         CASE WHEN site_id % 3 = 0 THEN 'Yes' WHEN site_id % 3 = 1 THEN 'No' WHEN site_id % 2 = 0 THEN 'maybe' END
           AS bathing_flag,
         CASE WHEN events_1996 > 1 THEN 'true' WHEN events_1996 <= 1 THEN 'false' END AS priority_flag
  FROM sites"""

VIEWS = {"sites": SITES, "sites_dirty": SITES_DIRTY, "sites_raw": SITES_RAW, "sites_flagged": SITES_FLAGGED}
_NEEDS = {"sites": (), "sites_dirty": ("sites",), "sites_raw": ("sites", "sites_dirty"), "sites_flagged": ("sites",)}

# Headings as a published site table spells them, two of them misspelt.
HEADINGS = {
    "site_id": "ID",
    "site_name": "Site name",
    "company": "Water Compnay",
    "region": "River Basin District",
    "balance": "Latitute",
    **{p: f"Spill Events {p[-4:]}" for p in DIRTY_PERIODS},
}


def with_views(*names: str) -> str:
    """WITH clause that defines the named site tables and what they are built from."""
    wanted = list(dict.fromkeys([need for name in names for need in (*_NEEDS[name], name)]))
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in wanted)


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if columns is None else df.select(*columns)


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    sources = {n: table(spark, sf_dir, n) for n in ("customer", "nation", "region", "orders")}
    return spark.sql(query.replace("FROM customer c", "FROM {customer} c")
                     .replace("JOIN nation n", "JOIN {nation} n")
                     .replace("JOIN region r", "JOIN {region} r")
                     .replace("FROM orders)", "FROM {orders})"), **sources)


def site_table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _sql(spark, sf_dir, f"{with_views(name)} SELECT * FROM {name}")

    return load


sites = site_table("sites")
sites_dirty = site_table("sites_dirty")
sites_raw = site_table("sites_raw")
sites_flagged = site_table("sites_flagged")


def headed(df: DataFrame) -> DataFrame:
    return df.select(*[df[c].alias(h) for c, h in HEADINGS.items() if c in df.columns])
