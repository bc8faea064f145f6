"""Cross-checks between operators on the driver tables."""

from pyspark.sql import functions as F

from vigie.functions import classify
from vigie.plans import composed as P
from vigie.plans import queries as Q
from vigie.sources import standins as S

from .conftest import SF_ORACLE as D


def test_computed_class_equals_supplied_class(spark):
    dep = S.indicators_department(spark, D)
    cuts = S.SUPPLIED_CUTS["tx_incid"]
    diff = dep.where(~classify("tx_incid", cuts).eqNullSafe(F.col("tx_incid_couleur")))
    assert diff.count() == 0


def test_daily_differences_add_up_to_cumulative_change(spark):
    daily = Q.deaths_daily_region(spark, D)
    y = S.DEATH_YEARS[1]
    r = daily.agg(F.sum(f"deces_journaliers_{y}").alias("s"),
                  F.max_by(f"total{y}", "date").alias("last"), F.min_by(f"total{y}", "date").alias("first")).first()
    assert r.s == r.last - r.first


def test_appended_total_is_sum_of_members(spark):
    t = Q.hospital_with_total(spark, D)
    members = [Q.REGION_AREAS[c] for c in Q.REGION_TOTAL_OF]
    sums = t.where(F.col("dep").isin(members)).groupBy("jour").agg(F.sum("hospitalisations").alias("s"))
    total = t.where(F.col("dep") == Q.REGION_TOTAL_LABEL).select("jour", F.col("hospitalisations").alias("t"))
    assert sums.join(total, "jour").where(F.col("s") != F.col("t")).count() == 0
    assert total.count() == sums.count()


def test_sheets_round_trip_equals_source_table(spark):
    back = Q.sheets_union(spark, D).drop("workbook")
    src = S.deaths_cumulative(spark, D)
    assert back.exceptAll(src).count() == 0 and src.exceptAll(back).count() == 0


def test_history_wide_unpivots_back(spark):
    from vigie.operators import unpivot_long

    wide = P.history_wide(S.indicators_department(spark, D), Q.REGION_NAMES)
    long = unpivot_long(wide, ["extract_date"], names_to="libelle_reg", values_to="R").where("R IS NOT NULL")
    src = S.indicators_department(spark, D).select("extract_date", "libelle_reg", "R").where("R IS NOT NULL").distinct()
    assert long.exceptAll(src).count() == 0 and src.exceptAll(long).count() == 0


def test_geography_is_kept_whole(spark):
    geo_rows = S.department_geo(spark, D).count()
    for q in (Q.latest_class_geo, Q.latest_snapshot_geo, Q.deaths_variation):
        assert q(spark, D).count() == geo_rows
    drawn = S.department_geo(spark, D).where("nom_dep <> 'separation'").count()
    assert Q.er_rate_7d(spark, D).count() == drawn == Q.icu_saturation_region(spark, D).count()


def test_national_sheet_ends_at_the_year_count(spark):
    y = S.DEATH_YEARS[-1]
    cells = S.cells(spark, D, ["deaths"])
    last_row = 4 + 365                       # 31 December of the axis year
    col = 2 + 2 * (len(S.DEATH_YEARS) - 1) + 1  # total of the oldest year
    got = cells.where((F.col("sheet") == "France") & (F.col("row") == last_row) & (F.col("col") == col)) \
        .select("value").first()[0]
    orders = S.table(spark, D, "orders")
    assert int(got) == orders.where(F.year("o_orderdate") == y).count()
