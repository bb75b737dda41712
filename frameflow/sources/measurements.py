"""Measurement records (one JSON object per line) as tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EYE = "struct<open:double,sharp_norm:double>"
MEASUREMENT_SCHEMA = (
    "path string, error string, engine_version string, decode_mode string, "
    "frame struct<sharpness_tiles:array<array<double>>,sharpness_max:double,"
    "sharpness_mean:double,clipped_hi:double,clipped_lo:double,horizon_angle:double,"
    "exposure_bias:double>, saliency struct<attention_bbox:array<double>>, "
    "faces array<struct<idx:int,bbox:array<double>,roll:double,yaw:double,pitch:double,"
    f"capture_quality:double,eyes:struct<l:{EYE},r:{EYE}>,eye_source:string,faceprint:string>>, "
    "embedding string, embedding_dim int, _corrupt_record string")


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEASUREMENT_SCHEMA).json(path)


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(measured rows, error rows); unreadable lines are errors too."""
    bad = F.col("error").isNotNull() | F.col("_corrupt_record").isNotNull() | F.col("path").isNull()
    good = rows.where(~bad).drop("error", "_corrupt_record")
    failed = rows.where(bad).select("path", F.coalesce("error", F.lit("unreadable record")).alias("error"))
    return good, failed


def analysis_rows(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.coalesce("engine_version", F.lit("?")).alias("engine_version"),
                       F.coalesce("decode_mode", F.lit("?")).alias("decode_mode"),
                       "frame", "saliency")


def box_struct(values: Column) -> Column:
    """[x, y, w, h] to a struct; NULL unless it has four numbers."""
    return F.when(F.size(values) == 4, F.struct(
        values[0].alias("x"), values[1].alias("y"), values[2].alias("w"), values[3].alias("h")))


def face_rows(rows: DataFrame) -> DataFrame:
    face = F.col("f")
    return rows.select("path", F.explode("faces").alias("f")).select(
        "path", face["idx"].alias("idx"), box_struct(face["bbox"]).alias("bbox"),
        face["roll"].alias("roll"), face["yaw"].alias("yaw"), face["pitch"].alias("pitch"),
        face["capture_quality"].alias("capture_quality"),
        face["eyes"]["l"]["sharp_norm"].alias("sharp_l"),
        face["eyes"]["r"]["sharp_norm"].alias("sharp_r"),
        face["eyes"]["l"]["open"].alias("open_l"), face["eyes"]["r"]["open"].alias("open_r"),
        F.coalesce(face["eye_source"], F.lit("unknown")).alias("eye_source"),
        decode_vector(face["faceprint"]).alias("faceprint"))


def embedding_rows(rows: DataFrame) -> DataFrame:
    vec = decode_vector(F.col("embedding"))
    return rows.where("embedding IS NOT NULL").select(
        "path", F.lit("scene").alias("kind"), vec.alias("vec"), F.size(vec).alias("dim"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _unpack(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


def decode_vector(text: Column) -> Column:
    """Base64 of little-endian 32-bit floats to an array."""
    return _unpack(F.unbase64(text))


def latest_per_key(rows: DataFrame, keys, version) -> DataFrame:
    """Last write wins: the row with the highest `version` columns per key."""
    keys, version = list(keys), list(version)
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*version))
    return rows.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")
