"""Logical algorithms of storage: chunks, manifests, garbage, bands, log floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def chunks(values: DataFrame, size: int) -> DataFrame:
    """key, ordinal, chunk (binary): full chunks of `size` bytes and the remainder; an empty value has none."""
    data = F.col("value").cast("binary")
    n = F.ceil(F.octet_length(data) / size).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cut = values.select("key", data.alias("data"), F.explode(places).alias("ordinal"))
    return cut.select("key", "ordinal", F.substring("data", F.col("ordinal") * size + 1, F.lit(size)).alias("chunk"))


def content_addressed(cut: DataFrame) -> DataFrame:
    """One row per distinct chunk: digest, length, references."""
    return cut.groupBy(F.sha2("chunk", 256).alias("digest")).agg(F.max(F.octet_length("chunk")).alias("bytes"), F.count(F.lit(1)).alias("refs"))


def manifests(cut: DataFrame) -> DataFrame:
    """Digest over the ordered chunk digests of each value, and its logical length."""
    digests = F.array_sort(F.collect_list(F.struct("ordinal", F.sha2("chunk", 256).alias("d"))))
    return cut.groupBy("key").agg(F.sum(F.octet_length("chunk").cast("long")).alias("logical_len"), F.sha2(F.array_join(F.transform(digests, lambda x: x["d"]), "").cast("binary"), 256).alias("manifest"))


def through_chunks(rows: DataFrame, size: int) -> DataFrame:
    """rows (key, seq, value and more) with each value replaced by what its manifest reassembles: distinct chunks are stored once under
    their digests, a manifest lists a value's chunks in order. A value without chunks is empty."""
    named = rows.withColumn("of", F.struct("key", "seq"))
    cut = chunks(named.select(F.col("of").alias("key"), "value"), size).withColumn("digest", F.sha2("chunk", 256))
    stored = cut.groupBy("digest").agg(F.first("chunk").alias("bytes"))
    found = cut.select("key", "ordinal", "digest").join(stored, "digest")
    whole = reassemble(found.select(F.col("key").alias("of"), "ordinal", F.col("bytes").alias("chunk")), "of")
    return named.drop("value").join(whole.select("of", "value"), "of", "left").withColumn("value", F.coalesce(F.col("value").cast("string"), F.lit("")))


def reassemble(cut: DataFrame, key: str = "key") -> DataFrame:
    """Each key's value (binary) out of its chunks in order, and its digest. A value is one row, so its chunks meet in one task."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.hex("chunk").alias("hex")))), lambda c: c["hex"])
    whole = cut.groupBy(key).agg(F.unhex(F.array_join(parts, "")).alias("value"))
    return whole.withColumn("digest", F.sha2("value", 256))


def garbage(packs: DataFrame, reachable: DataFrame) -> DataFrame:
    """Packs none of whose chunks is reachable."""
    live = packs.join(reachable.select("digest").distinct(), "digest", "left_semi").select("pack").distinct()
    return packs.select("pack").distinct().join(live, "pack", "left_anti")


def band(digest: Column) -> Column:
    """One of 256: the top eight bits of a route hash in hex."""
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("long")


def dirty_bands(writes: DataFrame, floor: int) -> DataFrame:
    """Bands with a write (seq, hash) above the floor: only those are written anew."""
    return writes.where(F.col("seq") > floor).groupBy(band(F.col("hash")).alias("band")).agg(F.count(F.lit(1)).alias("writes"), F.max("seq").alias("last_seq"))


def write_bands(state: DataFrame, path: str, bands: DataFrame | None = None) -> None:
    """Write state (with hash) as Parquet, one folder for each band; with bands, only theirs, the folders of others stay."""
    rows = state.withColumn("band", band(F.col("hash")))
    if bands is not None:
        rows = rows.join(bands.select("band"), "band", "left_semi")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("band").parquet(path)


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("band")


def reclaimable(segments: DataFrame, floors: DataFrame) -> DataFrame:
    """Log segments that lie wholly at or below the smallest floor."""
    least = floors.agg(F.min("floor").alias("least"))
    return segments.join(F.broadcast(least), F.col("last_seq") <= F.col("least")).select("segment")


def adopt_compression(sizes: DataFrame, savings_percent: int = 15) -> DataFrame:
    return sizes.select("key", (100 * (F.col("raw") - F.col("packed")) >= savings_percent * F.col("raw")).alias("adopted"))
