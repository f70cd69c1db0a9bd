"""op4: every text stored as an MPEG audio stream, read back and described."""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orrery.llm import mpeg_audio as mp
from orrery.sources.tables import table
from orrery.storage import shared_dir

NAME = "op4_mpeg_audio"
_READ = T.StructType([T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("duration", T.DoubleType()), ("seek_offsets", T.ArrayType(T.LongType())))])


def describe(media: bytes) -> tuple:
    s = mp.parse(media)
    data = mp.unpack(media, s)
    seeks = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in s.offsets))
    feature = f"mpeg{s.version} layer{s.layer} {s.rate}Hz {s.vbr} frames={len(s.offsets)} table={s.vbr_frames} duration={s.duration:.6f} crc={s.crc_checked - s.crc_failed}/{s.crc_checked} last={s.offsets[-1]} seeks={seeks:08x}"
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.duration, s.offsets


@F.pandas_udf(_READ)
def read_back(media: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([describe(m) for m in media], columns=_READ.names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    path = shared_dir(spark, "media")
    docs.select("doc_id", n.alias("n_bytes"), mp.pack_text("text").alias("media")).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path)
    return stored.select("doc_id", "n_bytes", read_back("media").alias("r")).select("doc_id", "n_bytes", "r.*")
