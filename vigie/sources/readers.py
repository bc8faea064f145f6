"""File scans: delimited text (S1-S4, S8, S9) and GeoJSON.

Every reader takes a declared schema; nothing is inferred.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import feature_texts
from .quoted import count_quotes, quoted_records

SEPARATORS = (",", ";", "\t", "|")


def headers(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> dict[str, str]:
    """The first line of every file, by file path; one line per file comes back."""
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.option("encoding", encoding).text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), "value").where("start = 0")
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("header")).collect()
    return {r["file"]: r["header"].removeprefix("\ufeff") for r in first}


def detect_separator(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> str:
    """The separator of delimited files, as ``fread`` guesses it (S3).

    Looks at the header line of every file, outside of quotes, and takes the
    candidate that splits it into the most fields. Files that disagree raise.
    """
    def of(header: str) -> str:
        bare = re.sub(r'"(?:[^"]|"")*"', "", header)
        return max(SEPARATORS, key=lambda c: (bare.count(c), c == ","))

    found = {of(h) for h in headers(spark, path, encoding).values()}
    if len(found) > 1:
        raise ValueError(f"the files use different separators: {sorted(found)}")
    return found.pop() if found else ","


def _typed(value: Column, field: T.StructField, date_format: str, strict: bool) -> Column:
    """Header-named text column -> the declared type (strict: a bad value raises)."""
    t = field.dataType
    if isinstance(t, T.StringType):
        return value
    if isinstance(t, T.DateType):
        parsed = F.to_date(value, date_format) if strict else F.try_to_date(value, date_format)
        return parsed
    return value.cast(t) if strict else value.try_cast(t)


def scan_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    sep: str | None = ",",
    encoding: str = "UTF-8",
    header: bool = True,
    date_format: str = "yyyy-MM-dd",
    mode: str = "PERMISSIVE",
    with_file: str | None = None,
    escape: str = '"',
    multi_line: bool = False,
    na: Sequence[str] = ("", "NA"),
    align: bool = False,
    full_path: bool = False,
) -> DataFrame:
    """Delimited text with a declared schema.

    With a header (the default), the declared columns are taken **by name**,
    as readr does: the file may hold more columns and in any order. Every
    field is read as text and converted to its declared type (no inference,
    so codes such as ``01`` stay text); ``mode="FAILFAST"`` makes a value that
    does not convert raise, otherwise it becomes NULL. Without a header the
    schema applies by position.
    ``na`` lists the texts that mean missing, as readr's and fread's defaults
    do; with ``na=("NA",)`` a quoted empty text stays the empty text.
    ``sep=None`` detects the separator from the headers (``fread``).
    ``path`` may be a file, a directory, a glob or a list of them (S8, S9);
    ``with_file`` adds the source file's name (its path with ``full_path``) as
    a column (``bind_rows(.id=)``). Files must share one header, else the scan
    raises; with ``align`` files with different headers are matched by name,
    and a column that a file lacks is NULL in its rows (``bind_rows``).
    ``encoding`` decodes at the scan (e.g. ``ISO-8859-1``, S2, Q21).
    Quotes inside a quoted field are doubled (RFC 4180, as readr, fread and
    ``sink_csv`` write them); Spark's own default escape is a backslash.
    ``multi_line=True`` reads quoted fields that contain line breaks (``\\n``, or
    ``\\r\\n``, which stays as it is within a field). Files are split over tasks
    all the same (``quoted_records``), which takes a pass more over them, so it
    is off by default; encodings have to keep ASCII bytes as they are.
    """
    if sep is None:
        sep = detect_separator(spark, path, encoding)
    paths = [path] if isinstance(path, str) else list(path)
    if multi_line and encoding.upper().startswith(("UTF-16", "UTF-32")):
        raise ValueError("multi_line needs an encoding that keeps ASCII bytes")
    if multi_line and escape != '"':
        raise ValueError("multi_line needs doubled quotes")
    reader = (
        spark.read
        .option("header", header)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("dateFormat", date_format)
        .option("quote", '"')
        .option("escape", escape)
        .option("mode", mode)
        .option("inferSchema", False)
        .option("nullValue", "\u0000")  # the texts of ``na`` are told from quoted ones below
    )

    def value(f: T.StructField, present: bool) -> Column:
        if not present:
            return F.lit(None).cast(f.dataType).alias(f.name)
        text = F.col(f"`{f.name}`")
        text = F.when(~text.isin(list(na)), text) if na else text
        return _typed(text, f, date_format, mode.upper() == "FAILFAST").alias(f.name)

    def scan(files: list[str], lenient: bool = False) -> DataFrame:
        if multi_line:
            raw = _multi_line(spark, files, None if header else schema.fieldNames(), sep, encoding, mode)
        elif not header:
            names = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
            raw = reader.schema(names).csv(files)
        else:
            # the header of every file is checked against the first one's
            raw = reader.option("enforceSchema", False).csv(files)
        held = set(raw.columns)
        if not lenient and not {f.name for f in schema.fields} <= held:
            raise ValueError(f"columns {sorted({f.name for f in schema.fields} - held)} are not in the header")
        out = [value(f, f.name in held) for f in schema.fields]
        if multi_line:
            origin = F.col(_FILE) if full_path else F.url_decode(F.element_at(F.split(F.col(_FILE), "/"), -1))
        else:
            origin = F.col("_metadata.file_path" if full_path else "_metadata.file_name")
        return raw.select(*out, *([origin.alias(with_file)] if with_file else []))

    if not (align and header):
        return scan(paths)
    groups: dict[str, list[str]] = {}
    for file, line in sorted(headers(spark, paths, encoding).items()):
        groups.setdefault(line, []).append(unquote(file))
    parts = [scan(files, lenient=True) for files in groups.values()]
    if not parts:
        return scan(paths)
    return reduce(DataFrame.unionByName, parts)


_FILE = "the file of a record"


def _multi_line(spark: SparkSession, files: list[str], names: list[str] | None, sep: str, encoding: str, mode: str) -> DataFrame:
    """Columns as text, by the header's names unless given, and the record's file."""
    splits = count_quotes(spark, files)
    headed = names is None
    if headed:
        # the head of one file; the others' headers are checked against it
        names = spark.read.option("header", True).option("multiLine", True).option("sep", sep).option("escape", '"') \
            .option("encoding", encoding).csv(unquote(splits.files[0])).columns if splits.files else []
    # a NULL in every field but the record's own: texts that mean missing are told later
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": mode, "nullValue": "\u0000"}
    fields = T.StructType([T.StructField(n, T.StringType()) for n in names])
    records = quoted_records(spark, files, splits)
    text = F.decode("record", encoding) if encoding.upper() not in ("UTF-8", "UTF8") else F.col("record").cast("string")
    text = F.when(F.col("first"), F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    parsed = records.select("file", "first", F.from_csv(text, fields.toDDL() if names else "none string", options).alias("row"))
    if headed:
        same = F.lit(True)
        for n in names:
            same = same & (F.col("row").getField(n).eqNullSafe(F.lit(n)))
        parsed = parsed.where(F.when(F.col("first") & ~same, F.raise_error(F.concat(F.lit("the header differs: "), "file")).cast("boolean"))
                              .otherwise(~F.col("first")))
    return parsed.select(F.col("file").alias(_FILE), *[F.col("row").getField(n).alias(n) for n in names])


def geojson_schema(properties: T.StructType) -> T.StructType:
    """FeatureCollection schema; ``geometry`` is kept as raw JSON text."""
    feature = T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("properties", properties),
        T.StructField("geometry", T.StringType()),
    ])
    return T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("features", T.ArrayType(feature)),
    ])


def scan_geojson(spark: SparkSession, path: str | Sequence[str], properties: T.StructType,
                 line_delimited: bool = False, split: bool = False) -> DataFrame:
    """One row per feature: typed properties as columns plus ``geometry`` text.

    ``line_delimited=False`` reads FeatureCollection documents, each in one
    task, or with ``split`` in as many as it has splits, which takes a pass more
    over the files and needs documents with line breaks;
    ``True`` reads one Feature per line, which splits across tasks.
    """
    if split and not line_delimited:
        feature = geojson_schema(properties)["features"].dataType.elementType
        texts = feature_texts(spark, [path] if isinstance(path, str) else list(path))
        parsed = texts.select(F.from_json("feature", feature).alias("f")).where("f.type = 'Feature'")
        return parsed.select("f.properties.*", "f.geometry")
    if line_delimited:
        feature = geojson_schema(properties)["features"].dataType.elementType
        df = spark.read.schema(feature).json(path)
        return df.select("properties.*", "geometry")
    df = spark.read.schema(geojson_schema(properties)).option("multiLine", True).json(path)
    return df.select(F.inline("features")).select("properties.*", "geometry")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Directory listing as data: path, size, modification time."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
        .select("path", "length", "modificationTime")
    )
