"""Readers for delimited, nested and marked-up files, each with its contract."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, unique: Sequence[str] = ()) -> DataFrame:
    """A CSV file or folder with a header, by an explicit schema. With unique, repeated keys are an error."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    if unique and not df.groupBy(*unique).count().filter("count > 1").isEmpty():
        raise ValueError(f"{path}: rows repeat {', '.join(unique)}")
    return df


def cleaned_names(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Headers without byte-order marks and outer blanks, then renamed where the map has them."""
    names = [re.sub(r"^﻿", "", n).strip() for n in df.columns]
    return df.toDF(*((rename or {}).get(n, n) for n in names))


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def ways(payload: DataFrame) -> DataFrame:
    """(osm_id, tags, line): elements of a road payload that have two points or more."""
    e = payload.select(F.explode("elements").alias("e"))
    line = F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return e.filter(F.size("e.geometry") >= 2).select(F.col("e.id").alias("osm_id"), F.col("e.tags").alias("tags"), line.alias("line"))


GEOJSON = "crs struct<type:string,properties:struct<name:string>>, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"


def geojson_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(properties, crs, rings) of a polygon layer. A layer without a named CRS is an error; an empty one gives no rows, null geometries are left out."""
    return polygons(json_documents(spark, path, GEOJSON), path)


def polygons(doc: DataFrame, path: str = "layer") -> DataFrame:
    """The same for documents at hand, in the schema GEOJSON."""
    if not doc.filter("crs.properties.name is null").isEmpty():
        raise ValueError(f"{path}: the layer names no CRS")
    f = doc.select(F.col("crs.properties.name").alias("crs"), F.explode("features").alias("f")).filter("f.geometry is not null")
    ring = lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return f.select("f.properties", "crs", F.transform("f.geometry.coordinates", ring).alias("rings"))


def tag_text(xml: str, tag: str) -> Column:
    """The first non-empty text of a tag, whatever its namespace."""
    return F.nullif(F.trim(F.expr(f"""xpath_string({xml}, '(//*[local-name()="{tag}"][normalize-space()])[1]')""")), F.lit(""))


def numbers(text: Column) -> Column:
    """All decimal numbers of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))


def gain_lookup(xml: str) -> Column:
    """Positions (at) and gains of a look-up table: first offset, step and a list; a step of zero or an empty list gives nulls.

    The texts are read once and bound: written out where they are used, each use would parse the XML again.
    """
    read = F.struct(tag_text(xml, "offset").cast("double").alias("first"), tag_text(xml, "stepSize").cast("double").alias("step"), numbers(tag_text(xml, "gains")).alias("gains"))

    def table(t: Column) -> Column:
        n = F.size(t["gains"])
        ok = (n > 0) & (t["step"] != 0)
        return F.struct(F.when(ok, F.transform(F.sequence(F.lit(0), n - 1), lambda i: t["first"] + i * t["step"])).alias("at"), F.when(ok, t["gains"]).alias("gains"))

    return F.transform(F.array(read), table)[0]


def gain_table(xml: str) -> tuple[Column, Column]:
    """The two columns of gain_lookup."""
    table = gain_lookup(xml)
    return table["at"], table["gains"]


def noise_level(xml: str, missing: float = float("nan")) -> Column:
    """The greatest number after the marker of noise levels; `missing` where there is none."""
    found = numbers(F.substring_index(xml, "<noiseLevelValues", -1))
    return F.when(F.col(xml).contains("<noiseLevelValues") & (F.size(found) > 0), F.array_max(found)).otherwise(F.lit(missing))


def settings(xml: str, parent: str) -> Column:
    """Children of a tag as a map of names to texts."""
    inside = F.expr(f"xpath({xml}, '//{parent}/*/text()')")
    names = F.regexp_extract_all(F.regexp_extract(xml, rf"(?s)<{parent}>(.*?)</{parent}>", 1), F.lit(r"<([A-Za-z][A-Za-z0-9_]*)>"), F.lit(1))
    return F.map_from_arrays(names, inside)


def mask_codes(xml: str) -> Column:
    """Mask names by code of entries <mask code="..">name</mask>."""
    codes = F.transform(F.expr(f"xpath({xml}, '//mask/@code')"), lambda c: c.cast("int"))
    return F.map_from_arrays(codes, F.expr(f"xpath({xml}, '//mask/text()')"))


def band_order(header: str, wanted: str, fallback: int) -> Column:
    """The place, from one, of a band by its description among BAND lines; the declared fallback where none has it."""
    bands = F.regexp_extract_all(F.col(header), F.lit(r"BAND_NAME=([A-Za-z0-9_]+)"), F.lit(1))
    return F.coalesce(F.nullif(F.array_position(bands, wanted), F.lit(0)), F.lit(fallback)).cast("int")


def only_one(files: DataFrame, group: Sequence[str], path: str) -> DataFrame:
    """One file for each group; a group with several raises when the rows are made."""
    n = F.count("*")
    several = F.raise_error(F.concat(F.lit("more than one file for "), F.concat_ws(", ", *group)))
    return files.groupBy(*group).agg(n.alias("n"), F.min(path).alias(path)).select(*group, F.when(F.col("n") > 1, several).otherwise(F.col(path)).alias(path))


def checksums(lines: DataFrame) -> DataFrame:
    """(sha1, path) of manifest lines 'digest  [* ]path'; other lines are left out."""
    p = r"^([0-9a-fA-F]{40})\s+[* ]?(.+)$"
    return lines.filter(F.col("value").rlike(p)).select(F.lower(F.regexp_extract("value", p, 1)).alias("sha1"), F.trim(F.regexp_extract("value", p, 2)).alias("path"))


def products(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256, xml) of all metadata files below a folder, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("xml"))


def existing(spark: SparkSession, path: str) -> str:
    """The path, or a FileNotFoundError: a snapshot is restored, never fetched anew."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"{path}: restore the snapshot")
    return path
