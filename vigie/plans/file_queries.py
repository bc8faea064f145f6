"""Registered queries for files: a feed is derived from the driver tables, written
with a sink under the session's shared folder and read back with a scan. The
result is the feed again, so its SQL twin is the feed's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_day_month
from ..functions.text import encode_repair
from ..operators.cells import sheet_range
from ..operators.reshape import unnest
from ..session import checkpoint_dir, reuse
from ..sinks.writers import sink_csv, sink_geojson
from ..sources import schemas
from ..sources import standins as S
from ..sources.readers import list_files, scan_csv, scan_geojson
from . import queries as Q

NA_ONLY = ("NA",)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/vigie-files/{uuid.uuid4().hex[:12]}/{name}"


def _through_csv(spark, df: DataFrame, name: str, sep: str = ",", read_sep: str | None = "", encoding: str = "UTF-8",
                 read_encoding: str | None = None, **sink) -> DataFrame:
    path = _folder(spark, name)
    sink_csv(df, path, sep=sep, encoding=encoding, **sink)
    return scan_csv(spark, path, df.schema, sep=sep if read_sep == "" else read_sep, encoding=read_encoding or encoding, mode="FAILFAST", na=NA_ONLY)


def file_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Minimal quoting, missing text and numbers as NA."""
    return _through_csv(spark, S.icu_capacity(spark, d), "capacity")


def file_regional_unquoted(spark: SparkSession, d: str) -> DataFrame:
    """No quoting, semicolons, separator detected from the headers."""
    return _through_csv(spark, Q.regional_with_national(spark, d), "regional", sep=";", read_sep=None, quote="none")


def file_history_quoted(spark: SparkSession, d: str) -> DataFrame:
    """Every text and the header quoted, numbers bare."""
    return _through_csv(spark, Q.r_history_wide(spark, d), "history", quote="all")


def file_series_bom(spark: SparkSession, d: str) -> DataFrame:
    """Byte-order mark before the header."""
    return _through_csv(spark, Q.national_series(spark, d), "series", bom=True)


def file_commentary_latin1(spark: SparkSession, d: str) -> DataFrame:
    """A Latin-1 file with accents, quotes and commas."""
    return _through_csv(spark, Q.r_latest_commentary(spark, d), "commentary", encoding="ISO-8859-1")


def file_commentary_repaired(spark: SparkSession, d: str) -> DataFrame:
    """A UTF-8 file read as Latin-1, its texts repaired afterwards."""
    back = _through_csv(spark, Q.r_latest_commentary(spark, d), "wrong", read_encoding="ISO-8859-1")
    return back.select(*[encode_repair(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in back.schema.fields])


def file_texts_multiline(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with line breaks and quotes inside quoted fields, files read split by split."""
    texts = S.table(spark, d, "documents").select("doc_id", "lang", "text", "source")
    path = _folder(spark, "texts")
    sink_csv(texts, path)
    return scan_csv(spark, path, texts.schema, multi_line=True, mode="FAILFAST", na=NA_ONLY)


def file_hospital_single(spark: SparkSession, d: str) -> DataFrame:
    """The hospital table as one committed file in its order."""
    table = Q.hospital_table_numbered(spark, d)
    path = _folder(spark, "hospital.csv")
    sink_csv(table.orderBy("place"), path, single_file=True)
    return scan_csv(spark, path, table.schema, mode="FAILFAST", na=NA_ONLY)


def file_texts_repaired(spark: SparkSession, d: str) -> DataFrame:
    """UTF-8 files, half of them read as Latin-1, put together and repaired value by value."""
    texts = S.table(spark, d, "documents").select("doc_id", "text")
    parts = []
    for wrong, encoding in enumerate(("UTF-8", "ISO-8859-1")):
        path = _folder(spark, f"texts{wrong}")
        sink_csv(texts.where(F.pmod("doc_id", F.lit(2)) == wrong), path)
        parts.append(scan_csv(spark, path, texts.schema, multi_line=True, mode="FAILFAST", na=NA_ONLY, encoding=encoding))
    return parts[0].unionByName(parts[1]).select("doc_id", encode_repair("text").alias("text"))


def file_features(spark: SparkSession, d: str) -> DataFrame:
    """One FeatureCollection document."""
    return _through_geojson(spark, Q.deaths_variation(spark, d), True)


def file_features_split(spark: SparkSession, d: str) -> DataFrame:
    """One FeatureCollection document, read split by split."""
    return _through_geojson(spark, Q.deaths_variation(spark, d), True, split=True)


def file_feature_lines(spark: SparkSession, d: str) -> DataFrame:
    """One feature per line, split over files."""
    return _through_geojson(spark, Q.deaths_variation(spark, d), False)


def _through_geojson(spark, layer: DataFrame, collection: bool, split: bool = False) -> DataFrame:
    path = _folder(spark, "layer")
    sink_geojson(layer, path, collection=collection)
    properties = T.StructType([f for f in layer.schema.fields if f.name != "geometry"])
    return scan_geojson(spark, path, properties, line_delimited=not collection, split=split).select(layer.columns)


def _drops(spark, d) -> tuple[str, int]:
    """Daily hospital files, one drop per event class found, each with its columns in another order."""
    root = _folder(spark, "drops")
    feed = reuse(S.hospital_daily(spark, d))
    classes = sorted(r["sexe"] for r in feed.select("sexe").distinct().collect())  # the feed's classes: a handful of codes
    for i, sexe in enumerate(classes):
        k = i % len(feed.columns)
        sink_csv(feed.where(F.col("sexe") == sexe).select(*feed.columns[k:], *feed.columns[:k]), f"{root}/drop={i}", sep=";")
    return root, len(classes)


def file_drops_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Many files whose headers differ, matched by name, with their origin."""
    root, n = _drops(spark, d)
    every = scan_csv(spark, [f"{root}/drop={i}" for i in range(n)], schemas.HOSPITAL_DAILY, sep=";", mode="FAILFAST",
                     na=NA_ONLY, align=True, with_file="file", full_path=True)
    return every.withColumn("drop", F.regexp_extract("file", r"drop=(\d+)", 1).cast("int")).drop("file")


def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """The drops of a folder that hold data, from its listing."""
    files = list_files(spark, f"{_drops(spark, d)[0]}/drop=*", "*.csv").where("length > 0")
    return files.select(F.regexp_extract("path", r"drop=(\d+)", 1).cast("int").alias("drop")).distinct()


def unnested_days(spark: SparkSession, d: str) -> DataFrame:
    """Each area's days as a list of structs, back to rows."""
    feed = S.hospital_daily(spark, d).where(F.col("sexe") == "0").select("dep", "jour", "hosp", "rea")
    nested = feed.groupBy("dep").agg(F.collect_list(F.struct("jour", "hosp", "rea")).alias("days"))  # one area's days
    return unnest(nested, "days")


SHARE_YEAR = 2020


def shares_with_date(spark: SparkSession, d: str) -> DataFrame:
    """``dd/MM`` text of the age shares as a date of a given year."""
    latest = Q.age_share_latest(spark, d)
    return latest.select("groupe_age", parse_day_month("date", SHARE_YEAR).alias("date"), "part")


OLDER_RANGE = "A5:H35"


def _older(spark, d, sheet) -> DataFrame:
    names = [f.name for f in schemas.deaths_older_sheet(S.DEATH_YEARS[:3]).fields]
    # the newest year's rate stands right of its two counts
    out = sheet_range(S.cells(spark, d, ["older"]), sheet, OLDER_RANGE, names, ["date"] + ["numeric"] * 7)
    return out.select("sheet", *names)


def older_sheet_by_index(spark: SparkSession, d: str) -> DataFrame:
    """A sheet of the older eight-column workbook, by its number."""
    return _older(spark, d, 2)


def older_sheet_by_name(spark: SparkSession, d: str) -> DataFrame:
    """A sheet of the older eight-column workbook, by its name."""
    return _older(spark, d, Q.DEATH_SHEET)


FILE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        file_texts_multiline, file_texts_repaired, file_hospital_single, file_capacity, file_regional_unquoted, file_history_quoted, file_series_bom, file_commentary_latin1,
        file_commentary_repaired, file_features, file_features_split, file_feature_lines, file_drops_by_name, file_listing, unnested_days,
        shares_with_date, older_sheet_by_index, older_sheet_by_name)
}
