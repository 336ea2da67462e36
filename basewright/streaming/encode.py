"""Encoding of a stream of records. Each record is encoded by itself, so there is no state and no late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import bases, wire


def encoded(records: DataFrame) -> DataFrame:
    """description, enc, n_bases, record bytes; batch or stream. Records with unknown symbols have null enc and bytes, and the symbol."""
    s = F.col("sequence")
    rows = records.select("description", "sequence", "nuc", bases.bad_symbol(s).alias("bad_symbol"), bases.encoding(s, strict=False).alias("enc"))
    data = F.when(F.col("enc").isNotNull(), wire.with_checksum(wire.record_body(F.col("description"), s, F.col("nuc"))))
    return rows.select("description", "enc", "bad_symbol", bases.n_bases(s).alias("n_bases"), data.alias("record"))


def encode_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the records that a streaming frame brings as Parquet, each exactly once, until nothing is left."""
    return encoded(records).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
