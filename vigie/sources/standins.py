"""The reference's feeds, derived by Spark from the driver's TPC-H-like tables.

The reference reads public epidemic feeds that are not available here. Each
function below rebuilds one feed with the same schema and the same kinds of
gaps (missing measures, absent areas, codes needing padding or recoding)
from the parquet tables in ``sf_dir``, so every pipeline's work grows with
the input tables. The same definitions are written in SQL in
``vigie.plans.oracle`` for the DuckDB cross-check.

Mapping: department = nation, region = region, date = month of an order
(indicators) or day of an event (visits, hospital), cumulative deaths =
running count of orders per nation over a year, workbook cells = monthly
blocks of lineitem quantities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classes import classify
from ..functions.numbers import round_even
from ..functions.text import pad_left
from ..plans.composed import CAPACITY_RECODE
from ..session import reuse
from .bounds import largest

# Overseas department codes used by the hospital, indicator and
# geography feeds.
OVERSEAS_CODES = {20: "971", 21: "972", 22: "973", 23: "974", 24: "976"}

# The codes that the capacity file uses for them.
OLD_OVERSEAS_CODES = {new: old for old, new in CAPACITY_RECODE.items()}

# Stand-in parameters (chosen for these tables, not taken from the reference).
N_AREAS = 25                # events are spread over 25 areas by user id
MIN_ORDERS = {"tx_incid": 3, "taux_occupation_sae": 4, "tx_pos": 5}
SUPPLIED_CUTS = {"tx_incid": (10.0, 50.0), "taux_occupation_sae": (40.0, 60.0)}
NATION_WITHOUT_CODE = 19   # its capacity rows carry no department code
DEATH_YEARS = (2001, 2000, 1999, 1998, 1997, 1996, 1995)  # newest first: every year of orders
AGE_BAND = 5                # lineitem quantity band width = one "age group"
AGE_BANDS = 10


# Declared schemas of the driver tables: nothing is inferred, so that building a plan starts no job.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def path_of(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.schema(TABLES[name]).parquet(path_of(sf_dir, name))


def _dep_code(nk: Column) -> Column:
    """Department code of a nation: two digits, overseas areas on three."""
    out = None
    for k, v in OVERSEAS_CODES.items():
        out = F.when(nk == k, F.lit(v)) if out is None else out.when(nk == k, F.lit(v))
    return out.otherwise(pad_left(nk, 2))


def _rate(count: str, n: str, min_n: int) -> Column:
    return F.when(F.col(n) >= min_n, F.lit(100.0) * F.col(count) / F.col(n))


COUNTS = ("n", "n_f", "n_o", "n_u")


def _orders_by_month(orders: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Orders with their month, and the counts taken of a group of them."""
    rows = orders.withColumn("extract_date", F.trunc(F.to_date("o_orderdate"), "month"))
    return rows, [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_f"),
        F.count_if(F.col("o_orderstatus") == "O").alias("n_o"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_u"),
    ]


def orders_month_nation(spark: SparkSession, sf_dir: str, since=None) -> DataFrame:
    """Orders counted per (month, customer nation): the indicator panel's cells.

    ``since`` (a timestamp) bounds the raw order date, so that the scan prunes.
    """
    orders = table(spark, sf_dir, "orders")
    if since is not None:
        orders = orders.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz"))
    rows, counts = _orders_by_month(orders)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = rows.join(customer, rows.o_custkey == customer.c_custkey)
    return joined.groupBy("extract_date", F.col("c_nationkey").alias("nk")).agg(*counts)


def last_order(spark: SparkSession, sf_dir: str):
    """The latest order date (one value), None for an empty table."""
    return largest(spark, path_of(sf_dir, "orders"), TABLES["orders"], "o_orderdate")


def last_event(spark: SparkSession, sf_dir: str):
    """The latest event time (one value), None for an empty table."""
    return largest(spark, path_of(sf_dir, "events"), TABLES["events"], "ts")


def _measures() -> list[Column]:
    return [
        _rate("n_u", "n", MIN_ORDERS["tx_incid"]).alias("tx_incid"),
        _rate("n_f", "n", MIN_ORDERS["tx_pos"]).alias("tx_pos"),
        _rate("n_o", "n", MIN_ORDERS["taux_occupation_sae"]).alias("taux_occupation_sae"),
    ]


def indicators_national(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    """extract_date, tx_incid, tx_pos, taux_occupation_sae (one row per month).

    Without ``cells`` the orders are counted by month directly: every order has
    a customer (``o_custkey`` is a foreign key) and every customer a nation, so
    no join is needed. With ``cells`` their counts are summed.
    """
    if cells is None:
        rows, counts = _orders_by_month(table(spark, sf_dir, "orders"))
        nat = rows.groupBy("extract_date").agg(*counts)
    else:
        nat = cells.groupBy("extract_date").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return nat.select("extract_date", *_measures())


def indicators_department(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    """One row per (month, department) with rates, supplied classes and regional R.

    ``cells`` are the counts of ``orders_month_nation``, when a query has them already.

    R = orders of the region this month / orders of the region the calendar
    month before, repeated on each department of the region.
    """
    cells = orders_month_nation(spark, sf_dir) if cells is None else cells
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nk"), "n_name", F.col("n_regionkey").alias("rk"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rk"), "r_name")
    with_geo = cells.join(nation, "nk").join(region, "rk")
    # Regional totals of this and the previous calendar month as range frames
    # over a month number: no self-join, and Catalyst drops the window when a
    # pipeline does not use R.
    by_month = Window.partitionBy("rk").orderBy(F.year("extract_date") * 12 + F.month("extract_date"))
    n_reg = F.sum("n").over(by_month.rangeBetween(0, 0))
    n_prev = F.sum("n").over(by_month.rangeBetween(-1, -1))
    m = with_geo.withColumn("R", n_reg / n_prev).withColumn("R", round_even("R", 2))
    out = m.select(
        "extract_date",
        _dep_code(F.col("nk")).alias("departement"),
        F.col("n_name").alias("libelle_dep"),
        pad_left(F.col("rk"), 2).alias("region"),
        F.col("r_name").alias("libelle_reg"),
        *_measures(),
        "R",
        F.col("n").alias("n_orders"),
    )
    return out.select(
        "extract_date", "departement", "libelle_dep", "region", "libelle_reg",
        "tx_incid", classify("tx_incid", SUPPLIED_CUTS["tx_incid"]).alias("tx_incid_couleur"),
        "tx_pos", "R", "taux_occupation_sae",
        classify("taux_occupation_sae", SUPPLIED_CUTS["taux_occupation_sae"]).alias("taux_occupation_sae_couleur"),
        "n_orders",
    )


def _events(spark: SparkSession, sf_dir: str, since=None) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    if since is not None:  # a range on the raw time reaches the scan
        ev = ev.where(F.col("ts") >= F.lit(since).cast(ev.schema["ts"].dataType))
    return ev.select(
        _dep_code(F.pmod(F.col("user_id"), F.lit(N_AREAS))).alias("dep"),
        F.to_date("ts").alias("day"),
        "event_type",
        "value",
    )


def er_visits(spark: SparkSession, sf_dir: str, since=None) -> DataFrame:
    """dep, date_de_passage, sursaud_cl_age_corona ('0' = all ages), counts; of events from ``since`` on.

    Age class from the event value; 'corona' visits are error events and a
    zero count is stored as missing, as in the real feed.
    """
    ev = _events(spark, sf_dir, since).select(
        "dep", F.col("day").alias("date_de_passage"),
        F.when(F.col("value") < 10, "1").when(F.col("value") < 50, "2").otherwise("3")
        .alias("sursaud_cl_age_corona"),
        "event_type",
    )
    fine = ev.groupBy("dep", "date_de_passage", "sursaud_cl_age_corona").agg(
        F.count_if(F.col("event_type") == "error").alias("nbre_pass_corona"),
        F.count(F.lit(1)).alias("nbre_pass_tot"),
        F.count_if(F.col("event_type") == "purchase").alias("nbre_hospit_corona"),
    )
    total = fine.groupBy("dep", "date_de_passage").agg(
        *[F.sum(c).alias(c) for c in ("nbre_pass_corona", "nbre_pass_tot", "nbre_hospit_corona")]
    ).withColumn("sursaud_cl_age_corona", F.lit("0"))
    both = fine.unionByName(total)
    return both.select(
        "dep", "date_de_passage", "sursaud_cl_age_corona",
        F.when(F.col("nbre_pass_corona") != 0, F.col("nbre_pass_corona")).alias("nbre_pass_corona"),
        "nbre_pass_tot", "nbre_hospit_corona",
    )


def hospital_daily(spark: SparkSession, sf_dir: str, since=None) -> DataFrame:
    """dep, sexe (event type; '0' = all), jour, hosp, rea, rad, dc; of events from ``since`` on."""
    ev = _events(spark, sf_dir, since)
    fine = ev.groupBy("dep", F.col("event_type").alias("sexe"), F.col("day").alias("jour")).agg(
        F.count(F.lit(1)).alias("hosp"),
        F.count_if(F.col("value") >= 50).alias("rea"),
        F.count_if(F.col("value") < 10).alias("rad"),
        F.count_if(F.col("value") >= 150).alias("dc"),
    )
    total = fine.groupBy("dep", "jour").agg(
        *[F.sum(c).alias(c) for c in ("hosp", "rea", "rad", "dc")]
    ).withColumn("sexe", F.lit("0"))
    return fine.unionByName(total).select("dep", "sexe", "jour", "hosp", "rea", "rad", "dc")


def icu_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reg, dep (unpadded, old overseas codes), lits; several rows per department.

    One supplier = one hospital; beds missing for negative balances; the rows
    of one department carry no department code, so that department finds no
    capacity (every supplier row is kept).
    """
    sup = table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = sup.join(nation, sup.s_nationkey == nation.n_nationkey)
    old = F.when(F.col("n_nationkey") == NATION_WITHOUT_CODE, F.lit(None).cast("string"))
    for k, v in OVERSEAS_CODES.items():
        old = old.when(F.col("n_nationkey") == k, F.lit(OLD_OVERSEAS_CODES[v]))
    return j.select(
        F.col("n_regionkey").cast("string").alias("reg"),
        old.otherwise(F.col("n_nationkey").cast("string")).alias("dep"),
        F.when(F.col("s_acctbal") >= 0, F.floor(F.col("s_acctbal") / 1000).cast("bigint")).alias("lits"),
    )


def _orders_by_day(spark: SparkSession, sf_dir: str, years) -> DataFrame:
    """Orders of the given years on a common day axis (the first year's calendar).

    29 February of another year lands on 1 March of the axis year; running
    totals are unaffected from that day on.
    """
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    first, last = min(years), max(years)
    # A range on the raw column reaches the Parquet scan (row-group skipping).
    in_span = (F.col("o_orderdate") >= F.lit(f"{first}-01-01").cast("timestamp_ntz")) & \
        (F.col("o_orderdate") < F.lit(f"{last + 1}-01-01").cast("timestamp_ntz"))
    orders = table(spark, sf_dir, "orders").where(in_span).select(
        "o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderstatus")
    j = orders.where(F.year("d").isin(*years)).join(customer, orders.o_custkey == customer.c_custkey)
    axis = F.date_add(F.make_date(F.lit(years[0]), F.month("d"), F.lit(1)), F.dayofmonth("d") - 1)
    return j.select(F.col("c_nationkey").alias("nk"), F.year("d").alias("y"), "d", axis.alias("date"),
                    (F.col("o_orderstatus") == "F").alias("is_f"))


def _year_days(year: int) -> Column:
    """Every date of ``year`` as an array (exploded into one row per day)."""
    return F.sequence(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31)))


def _cumulate(daily_src: DataFrame, axis: DataFrame, part: list[str], years) -> DataFrame:
    """Running totals per ``part`` on every day of ``axis`` (days without orders add 0)."""
    counts = [x for y in years for x in (f"m{y}", f"t{y}")]
    # per area and day, so small; read twice (rows and cut-off), derived once
    daily = reuse(daily_src.groupBy(*part, "date").agg(*[
        x for y in years for x in (
            F.count_if((F.col("y") == y) & F.col("is_f")).alias(f"m{y}"),
            F.count_if(F.col("y") == y).alias(f"t{y}"),
        )
    ]))
    full = axis.join(daily, [*part, "date"], "left").select(
        *part, "date", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts])
    w = (Window.partitionBy(*part) if part else Window).orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # on the axis of the first year its own days keep their dates
    last_new = daily.where(F.col(f"t{years[0]}") > 0).agg(F.max("date")).scalar()
    cols = []
    for i, y in enumerate(years):
        for name, src in ((f"dematerialise{y}", f"m{y}"), (f"total{y}", f"t{y}")):
            run = F.sum(src).over(w).cast("double")
            cols.append((F.when(F.col("date") <= last_new, run) if i == 0 else run).alias(name))
    return full.select(*part, "date", *cols)


def _nation_days(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.col("n_nationkey").alias("nk"), F.explode(_year_days(year)).alias("date"))


def deaths_cumulative(spark: SparkSession, sf_dir: str, years=DEATH_YEARS) -> DataFrame:
    """dep, date, dematerialise<y>, total<y> per year: running totals per department.

    Every department has every day of the first year. Days after the last
    order of the first (current) year have no value for that year, as future
    days in the real workbook.
    """
    src = _orders_by_day(spark, sf_dir, years)
    cum = _cumulate(src, _nation_days(spark, sf_dir, years[0]), ["nk"], years)
    return cum.select(_dep_code(F.col("nk")).alias("dep"), *[c for c in cum.columns if c != "nk"])


def department_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """insee_dep, insee_reg, nom_dep, nom_minuscules, geometry (+ a 'separation' line)."""
    nation = table(spark, sf_dir, "nation")
    areas = nation.select(
        _dep_code(F.col("n_nationkey")).alias("insee_dep"),
        pad_left(F.col("n_regionkey"), 2).alias("insee_reg"),
        F.col("n_name").alias("nom_dep"),
        F.lower("n_name").alias("nom_minuscules"),
        F.concat(F.lit('{"type":"Point","coordinates":['), F.col("n_nationkey").cast("string"),
                 F.lit(",0]}")).alias("geometry"),
    )
    separation = spark.range(1).select(
        F.lit(None).cast("string").alias("insee_dep"),
        F.lit(None).cast("string").alias("insee_reg"),
        F.lit("separation").alias("nom_dep"),
        F.lit("separation").alias("nom_minuscules"),
        F.lit('{"type":"LineString","coordinates":[[0,0],[1,1]]}').alias("geometry"),
    )
    return areas.unionByName(separation)


def region_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, nom, geometry."""
    region = table(spark, sf_dir, "region")
    return region.select(
        pad_left(F.col("r_regionkey"), 2).alias("code"),
        F.col("r_name").alias("nom"),
        F.concat(F.lit('{"type":"Point","coordinates":[0,'), F.col("r_regionkey").cast("string"),
                 F.lit("]}")).alias("geometry"),
    )


def _cell(workbook: str, sheet_index, sheet, row, col, value) -> list[Column]:
    def c(v):
        return v if isinstance(v, Column) else F.lit(v)
    return [c(workbook).alias("workbook"), c(sheet_index).cast("int").alias("sheet_index"),
            c(sheet).cast("string").alias("sheet"), c(row).cast("int").alias("row"),
            c(col).cast("int").alias("col"), c(value).cast("string").alias("value")]


def age_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbook 'age': one 7-column block per month of lineitem shipments.

    Sheet 2: header 'Age Group' at (7, 1), band labels at rows 8-17 col 1;
    block k (k = months before the latest) has its date at (6, 8 + 7k), the
    count per band at rows 8-17 col 8 + 7k and the share in percent at rows
    8-17 col 14 + 7k. Sheet 1 holds one note cell.

    Every cell comes out of one (month, band) aggregate through ``inline``;
    cells that occur once per month / band / workbook are emitted by one
    designated row (first band of the month, first month of the band, latest
    month), found with windows over one month (<= 10 rows) or one band
    (one row per month).
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.trunc(F.to_date("l_shipdate"), "month").alias("m"),
        F.least(F.greatest(F.ceil(F.col("l_quantity") / AGE_BAND), F.lit(1)), F.lit(AGE_BANDS))
        .cast("int").alias("b"),
    )
    mb = li.groupBy("m", "b").agg(F.count(F.lit(1)).alias("c"))
    latest_m = mb.agg(F.max("m")).scalar()
    total = mb.agg(F.sum("c")).scalar()
    in_month, in_band = Window.partitionBy("m"), Window.partitionBy("b")
    t = mb.select(
        "m", "b", "c",
        F.sum("c").over(in_month).alias("n"),
        (F.col("b") == F.min("b").over(in_month)).alias("first_band"),
        (F.col("m") == F.min("m").over(in_band)).alias("first_month"),
        F.months_between(latest_m, "m").cast("int").alias("k"),
    )
    row, block_col = F.col("b") + 7, F.col("k") * 7
    label = F.concat((F.col("b") * AGE_BAND - (AGE_BAND - 1)).cast("string"), F.lit("-"),
                     (F.col("b") * AGE_BAND).cast("string"))
    share = (F.lit(100.0) * F.col("c") / F.col("n")).cast("decimal(9,4)").cast("string")
    once = F.col("first_band") & (F.col("m") == latest_m)

    def cell(keep, sheet_index, row_, col_, value):
        return F.struct(F.lit(sheet_index).alias("sheet_index"), row_.cast("int").alias("row"),
                        col_.cast("int").alias("col"), F.when(keep, value.cast("string")).alias("value"))

    yes = F.lit(True)
    cells_ = F.array(
        cell(yes, 2, row, block_col + 8, F.col("c")),
        cell(yes, 2, row, block_col + 14, share),
        cell(F.col("first_band"), 2, F.lit(6), block_col + 8, F.col("m")),
        cell(F.col("first_month"), 2, row, F.lit(1), label),
        cell(once, 2, F.lit(7), F.lit(1), F.lit("Age Group")),
        cell(once, 1, F.lit(1), F.lit(1), F.concat(F.lit("lineitems: "), total.cast("string"))),
    )
    out = t.select(F.inline(cells_)).where(F.col("value").isNotNull())
    return out.select(
        F.lit("age").alias("workbook"), "sheet_index",
        F.when(F.col("sheet_index") == 1, F.lit("About")).otherwise(F.lit("Deaths-Age")).alias("sheet"),
        "row", "col", "value")


def deaths_cells(spark: SparkSession, sf_dir: str, years=DEATH_YEARS) -> DataFrame:
    """Workbook 'deaths': sheet 1 'France' (all departments), then one sheet per department.

    Data rows start at row 5 (1 January) and follow the days of the year:
    col 1 date, cols 2-7 dematerialise/total per year. The national sheet sums
    the departments' running totals per day (an aggregate, no window); row
    numbers come from the day of the year, every sheet having every day.
    """
    measures = [f"{k}{y}" for y in years for k in ("dematerialise", "total")]

    def sheet_cells(cum: DataFrame, sheet_index: Column, sheet: Column) -> DataFrame:
        rows = cum.select(sheet_index.alias("si"), sheet.alias("sh"), (F.dayofyear("date") + 4).alias("r"),
                          "date", *measures)
        long = rows.select("si", "sh", "r", F.inline(F.array(
            F.struct(F.lit(1).alias("c"), F.col("date").cast("string").alias("v")),
            *[F.struct(F.lit(i + 2).alias("c"), F.col(m).cast("bigint").cast("string").alias("v"))
              for i, m in enumerate(measures)],
        )))
        return long.where(F.col("v").isNotNull()).select(
            *_cell("deaths", F.col("si"), F.col("sh"), F.col("r"), F.col("c"), F.col("v")))

    src = _orders_by_day(spark, sf_dir, years)
    per_dep = _cumulate(src, _nation_days(spark, sf_dir, years[0]), ["nk"], years)
    # all departments share the day axis and the cut-off of the current year,
    # so a day's national running total is the sum of the departments' ones
    france = per_dep.groupBy("date").agg(*[F.sum(m).alias(m) for m in measures])
    return sheet_cells(france, F.lit(1), F.lit("France")).unionByName(
        sheet_cells(per_dep, F.col("nk") + 2, _dep_code(F.col("nk"))))


def older_deaths_cells(spark: SparkSession, sf_dir: str, years=DEATH_YEARS[:3]) -> DataFrame:
    """Workbook 'older': one sheet per department from sheet 2 on, eight columns from row 5:
    date, then per year the paperless and all deaths, the newest year also with its rate."""
    cum = deaths_cumulative(spark, sf_dir)
    sheet = cum.select("dep", "date", *[f"{k}{y}" for y in years for k in ("dematerialise", "total")])
    m, t = F.col(f"dematerialise{years[0]}"), F.col(f"total{years[0]}")
    values = [F.col("date")]
    for i, y in enumerate(years):
        values += [F.col(f"dematerialise{y}"), F.col(f"total{y}")]
        if i == 0:
            values.append(F.when(t > 0, m / t * 100.0))
    rows = sheet.select((F.coalesce(_sheet_of(F.col("dep")), F.lit(0)) + 2).alias("si"), "dep", (F.dayofyear("date") + 4).alias("r"), F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("c"), v.cast("string").alias("v")) for i, v in enumerate(values)])))
    return rows.where(F.col("v").isNotNull()).select(*_cell("older", F.col("si"), F.col("dep"), F.col("r"), F.col("c"), F.col("v")))


def _sheet_of(dep: Column) -> Column:
    """The nation number behind a department code."""
    code = dep.cast("int")
    for k, v in OVERSEAS_CODES.items():
        code = F.when(dep == v, F.lit(k)).otherwise(code)
    return code


WORKBOOKS = {"age": age_cells, "deaths": deaths_cells, "older": older_deaths_cells}


def cells(spark: SparkSession, sf_dir: str, workbooks=("age", "deaths")) -> DataFrame:
    """The workbooks as one long cells table (only the ones asked for are built)."""
    return _cells(spark, sf_dir, tuple(workbooks))


def _cells(spark: SparkSession, sf_dir: str, workbooks: tuple) -> DataFrame:
    parts = [WORKBOOKS[w](spark, sf_dir) for w in workbooks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
