"""The reference's scripts as jobs: feeds in, chart tables out.

A feed that several outputs use is materialized once as Parquet in the
shared folder named by ``spark.checkpoint.dir`` (never a machine-local
folder), partitioned by date. That cuts lineage, so each output reads the
landed feed instead of re-deriving it, and a lost executor only costs the
re-read of a file. Each output is written with the sink style the reference
uses for it.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, remove_folder
from ..sinks.writers import map_layer, sink_csv, sink_geojson
from . import composed as P


# One folder per run of this process, so runs that overlap on a shared
# checkpoint folder never overwrite each other's landed feeds.
RUN_ID = uuid.uuid4().hex[:12]


def materialize(spark: SparkSession, df: DataFrame, name: str, partition_by: Sequence[str] = (),
                run_id: str | None = None) -> DataFrame:
    """Write ``df`` under ``<spark.checkpoint.dir>/vigie-feeds/<run>/<name>`` and read it back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/vigie-feeds/{run_id or RUN_ID}/{name}"
    # clustered by the partition columns: one file per value, not one per task and value
    w = (df.repartition(*partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    # read with the input's schema (no partition-type inference: a code such as
    # "01" stays text) and in the input's column order (partition columns come back last)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def remove_run(spark: SparkSession, run_id: str | None = None) -> None:
    """Remove the landed feeds of a run, once its outputs are written."""
    remove_folder(spark, f"{checkpoint_dir(spark).rstrip('/')}/vigie-feeds/{run_id or RUN_ID}")


def indicator_job(
    spark: SparkSession,
    nat: DataFrame,
    dep: DataFrame,
    dep_geo: DataFrame,
    region_geo: DataFrame,
    out_dir: str,
    region: str,
    region_names: Sequence[str],
    positivity_cuts: Sequence[float] = P.POSITIVITY_CUTS,
    as_of=None,
) -> dict[str, str]:
    """National and departmental indicators: four series, three maps, R map and history, combined table."""
    nat = materialize(spark, nat, "indicators_national")
    dep = materialize(spark, dep, "indicators_department", ["extract_date"])
    out = f"{out_dir.rstrip('/')}"
    written = {}

    def put(name: str, df: DataFrame, **opts) -> None:
        sink_csv(df, f"{out}/{name}", single_file=True, **opts)  # chart tables: areas x days
        written[name] = f"{out}/{name}"

    # built unsorted and joined unsorted; each table is sorted once, at its sink
    incid = P.regional_with_national(dep, nat, region, "tx_incid", "tx_incid_departemental", "tx_incid_national",
                                     None, 1)
    pos = P.regional_with_national(dep, nat, region, "tx_pos", "tx_pos_departemental", "tx_pos_national", 2, 2)
    occ = P.regional_with_national(dep, nat, region, "taux_occupation_sae", "taux_occupation_regional",
                                   "taux_occupation_national")
    by_date = ("extract_date", "Departement")
    put("incidence_region", incid.orderBy(*by_date))                   # readr write_csv
    put("positivity_region", pos.orderBy(*by_date), quote="none")      # write.csv(quote = FALSE)
    put("occupancy_region", occ.orderBy(*by_date), bom=True)           # write_excel_csv
    put("indicators_region", P.combined([incid, pos, occ]).orderBy(*by_date))
    put("r_latest_map", P.latest_commentary(dep, region_geo, as_of=as_of))
    put("r_history", P.history_wide(dep, region_names, sort=True), quote="all")   # write.csv(quote = TRUE)
    layers = {
        "incidence_map": P.latest_on_geography(dep, dep_geo, "tx_incid", "tx_incid_couleur"),
        "positivity_map": P.latest_classified(dep, dep_geo, "tx_pos", positivity_cuts),
        "occupancy_map": P.latest_on_geography(dep, dep_geo, "taux_occupation_sae", "taux_occupation_sae_couleur"),
    }
    for name, layer in layers.items():
        put(name, map_layer(layer, "couleur", P.INDICATOR_COLOURS))
    return written


def deaths_job(
    spark: SparkSession,
    deaths: DataFrame,
    dep_geo: DataFrame,
    out_dir: str,
    years: Sequence[int],
    areas: Sequence[str],
    run_date: dt.date | None = None,
) -> dict[str, str]:
    """Year-on-year variation map (dated GeoJSON) and the regional daily table."""
    deaths = materialize(spark, deaths, "deaths_cumulative")
    day = (run_date or dt.date.today()).isoformat()
    variation = P.year_variation(deaths, dep_geo, f"total{years[0]}", f"total{years[1]}")
    geo_path = f"{out_dir.rstrip('/')}/deces_variation_{day}.geojson"
    sink_geojson(variation, geo_path, collection=True)
    daily_path = f"{out_dir.rstrip('/')}/deaths_daily_region"
    sink_csv(P.daily_from_cumulative(deaths, areas, years).orderBy("date"), daily_path, single_file=True)
    return {"variation": geo_path, "daily": daily_path}


def department_maps_job(
    spark: SparkSession,
    visits: DataFrame,
    hosp: DataFrame,
    capacity: DataFrame,
    dep_geo: DataFrame,
    out_dir: str,
    er_cuts: Sequence[float] = P.ER_CUTS,
    icu_cuts: Sequence[float] = P.ICU_CUTS,
) -> dict[str, str]:
    """Emergency-visit and ICU-saturation map layers per department."""
    hosp = materialize(spark, hosp, "hospital_daily", ["jour"])
    er = map_layer(P.er_rate(visits, dep_geo, cuts=er_cuts), "statut_passages", P.DEPARTMENT_MAP_COLOURS)
    icu = map_layer(P.icu_saturation(hosp, P.clean_capacity(capacity), dep_geo, cuts=icu_cuts), "statut_rea",
                    P.DEPARTMENT_MAP_COLOURS)
    paths = {}
    for name, df in (("er_visits_map", er), ("icu_saturation_map", icu)):
        paths[name] = f"{out_dir.rstrip('/')}/{name}"
        sink_csv(df, paths[name], single_file=True)
    return paths


def hospital_job(
    spark: SparkSession,
    hosp: DataFrame,
    labels: dict[str, str],
    total_of: Sequence[str],
    total_label: str,
    out_dir: str,
) -> dict[str, str]:
    """Daily hospital table of listed departments with the regional total (one CSV)."""
    path = f"{out_dir.rstrip('/')}/hospital_table"
    sink_csv(P.hospital_table(hosp, labels, total_of, total_label, sort=True), path, single_file=True)
    return {"hospital_table": path}


def age_job(spark: SparkSession, cells: DataFrame, groups: Sequence[str], out_dir: str,
            workbook: str = "age") -> dict[str, str]:
    """Age-group shares: one row per day, and the latest day alone (two CSVs)."""
    cells = materialize(spark, cells.where(F.col("workbook") == workbook), f"cells_{workbook}")
    paths = {name: f"{out_dir.rstrip('/')}/{name}" for name in ("age_share_by_day", "age_share_latest")}
    sink_csv(P.age_share_by_day(cells, groups, workbook=workbook, sort=True), paths["age_share_by_day"], single_file=True)
    sink_csv(P.age_share_latest(cells, workbook=workbook).orderBy("groupe_age"), paths["age_share_latest"], single_file=True)
    return paths
