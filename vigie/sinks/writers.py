"""Writers for chart-ready tables.

Files are written by the executors, one part file per task. ``single_file`` and
``collection`` make one file of the parts, under the very name asked for, in
the frame's order (``single.commit_file``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import with_number_texts
from .single import commit_file

BOM = "﻿"


def _lines(df: DataFrame, sep: str, quote_text: bool, na: str, r_numbers: bool = True) -> DataFrame:
    """One text line per row, in a column named by the header line: text columns
    quoted (doubled inner quotes) when ``quote_text``, otherwise refused if they
    contain a separator, quote or newline."""
    texts, guards = [], []
    fields = df.schema.fields
    df = with_number_texts(df) if r_numbers else df
    for f in fields:
        v = F.col(f"`{f.name}`").cast("string")
        if r_numbers and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            pass
        elif isinstance(f.dataType, T.StringType) and quote_text:
            v = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
        elif not quote_text:
            guards.append(v.contains(sep) | v.contains('"') | v.contains("\n"))
        texts.append(F.coalesce(v, F.lit(na)))
    line = F.concat_ws(sep, *texts)
    if guards:
        bad = guards[0]
        for g in guards[1:]:
            bad = bad | g
        line = F.when(F.coalesce(bad, F.lit(False)),
                      F.raise_error(F.lit("sink_csv(quote='none'): value contains a separator or quote"))
                      ).otherwise(line)
    names = [f'"{c}"' if quote_text else c for c in df.columns]
    if quote_text and df.columns[0].startswith(BOM):
        # the byte-order mark opens the file, before the quoted first name
        names[0] = BOM + f'"{df.columns[0][len(BOM):]}"'
    return df.select(line.alias(sep.join(names)))


def sink_csv(
    df: DataFrame,
    path: str,
    quote: str = "minimal",
    bom: bool = False,
    sep: str = ",",
    na: str = "NA",
    single_file: bool = False,
    mode: str = "overwrite",
    r_numbers: bool = True,
    encoding: str = "UTF-8",
) -> None:
    """Write a headed CSV table; missing values are written as ``na``.

    ``quote``: ``"minimal"`` (quote a value only when needed, doubled quotes
    inside, X1), ``"all"`` (every text value and the header quoted, numbers
    bare, X3) or ``"none"`` (no quoting, X2; a row whose text contains the
    separator, a quote or a newline raises, since the file could not be read
    back). ``bom=True`` starts the file with a UTF-8 byte-order mark (X4).
    Blanks around text are kept; the empty text is written ``""``.
    ``r_numbers`` writes doubles as R does (``1234``, ``0.5``, ``1e+07``,
    ``NaN``) instead of Java's ``1234.0`` / ``1.0E7``.
    Every task writes a file with its own header into a folder at ``path``.
    ``single_file`` makes one file at ``path`` of them, with one header and the
    row order of ``df`` (e.g. a final sort).
    """
    if quote not in ("minimal", "all", "none"):
        raise ValueError("quote must be 'minimal', 'all' or 'none'")
    out = df
    if bom:
        out = out.withColumnRenamed(out.columns[0], BOM + out.columns[0])
    if quote != "minimal":
        out = _lines(out, sep, quote_text=(quote == "all"), na=na, r_numbers=r_numbers)
    elif r_numbers:
        out = with_number_texts(out)

    def writer(frame: DataFrame, header: bool) -> DataFrameWriter:
        w = (frame.write.option("header", header).option("encoding", encoding)
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
        if quote == "minimal":
            return w.option("sep", sep).option("escape", '"').option("nullValue", na).option("dateFormat", "yyyy-MM-dd")
        # whole lines as the only column: nothing may be quoted or escaped again
        return w.option("sep", "\u0001").option("quote", "").option("escape", "\u0002").option("emptyValue", "")

    if not single_file:
        writer(out, True).mode(mode).csv(path)
        return
    spark = df.sparkSession
    only_header = spark.createDataFrame([], out.schema)
    commit_file(spark, path, [writer(only_header, True).csv, writer(out, False).csv], mode=mode)


def geojson_feature(df: DataFrame, geometry: str = "geometry") -> Column:
    """One GeoJSON Feature per row as JSON text; every other column is a property."""
    props = [c for c in df.columns if c != geometry]
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*[F.col(f"`{c}`") for c in props]).alias("properties"),
        F.parse_json(F.col(geometry)).alias("geometry"),
    ))


def parse_geojson_feature(text: Column, properties: T.StructType) -> Column:
    """Feature JSON text -> struct(type, properties, geometry as raw text)."""
    schema = T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("properties", properties),
        T.StructField("geometry", T.StringType()),
    ])
    return F.from_json(text, schema)


def sink_geojson(df: DataFrame, path: str, geometry: str = "geometry", collection: bool = False) -> None:
    """GeoJSON of one feature per row, overwriting ``path``.

    One Feature per line, split across tasks (read back with
    ``scan_geojson(..., line_delimited=True)``). ``collection=True`` makes one
    FeatureCollection document at ``path`` (what GIS and chart tools open; read
    back with ``scan_geojson``) of what the tasks write, in the frame's row order.
    """
    features = df.select(geojson_feature(df, geometry).alias("value"))
    if not collection:
        features.write.mode("overwrite").text(path)
        return
    # every feature brings the comma before it; the first one's is left out
    lines = features.select(F.concat(F.lit(","), "value").alias("value"))
    commit_file(df.sparkSession, path, [lines.write.text], head=b'{"type":"FeatureCollection","features":[\n', tail=b"]}\n", skip=1)


def map_layer(
    layer: DataFrame,
    class_col: str,
    colours: Mapping[str, str],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """What a choropleth draws: key columns, class, fill colour, geometry."""
    cols = list(keep) if keep is not None else layer.columns
    fill = None
    for k, v in colours.items():
        cond = F.col(class_col) == k
        fill = F.when(cond, F.lit(v)) if fill is None else fill.when(cond, F.lit(v))
    return layer.select(*cols, fill.alias("fill"))
