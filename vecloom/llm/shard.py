"""Sharding: proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seed within their source and ranked there; sorted by
fractional rank (rank + 0.5) / rows of the source, any stretch of that order
holds the sources in proportion; cut in equal stretches, every shard matches
the mixture and shards' counts differ by one at most.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import with_rank


def interleaved_shards(df: DataFrame, n_shards: int = 16, source: str = "source", id_col: str = "doc_id", text: str = "text", seed: str = "0", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's shard and its slot there: columns id_col, source, ``keep``, size, text_crc32, shard, slot.

    size: the text's UTF-8 bytes (null: none) plus 1. A null source is a
    source of its own. Rows that tie in the seeded order (equal ids) are
    ordered by text checksum and size; equal rows are interchangeable. Empty
    table: no rows. Both rankings deal rows over hash buckets, so a source
    with a third of all rows meets in no task; one count is taken first.
    """
    n = df.count()
    buckets = min(1 << 16, max(256, n // 4096))
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    base = df.select(
        F.col(id_col).alias("__id"), F.col(source).alias("__source"), *[F.col(c).alias(f"__keep_{c}") for c in keep],
        (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"),
    )
    base = base.withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col("__source").cast("string")), F.lit("n")))
    base = base.withColumn("__h", F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(F.col("__id").cast("string"), F.lit("null"))).cast("binary")))
    base = base.withColumn("__b", F.floor(F.conv(F.substring("__h", 1, 6), 16, 10).cast("bigint") * F.lit(buckets) / F.lit(1 << 24)).cast("bigint"))
    tie = ["__h", "text_crc32", "size"]
    inner = with_rank(base, ["__key"], "__b", tie, "__rank", "__total").drop("__b")
    inner = inner.withColumn("__frac", (F.col("__rank") + 0.5) / F.col("__total"))
    inner = inner.withColumn("__b", F.floor(F.col("__frac") * buckets))
    placed = with_rank(inner, [], "__b", ["__frac", "__key"], "__g")
    shard = F.expr(f"__g * {n_shards} div {max(n, 1)}")
    out = placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("__g") - F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}")).cast("bigint"))
    return out.select(F.col("__id").alias(id_col), F.col("__source").alias(source), *[F.col(f"__keep_{c}").alias(c) for c in keep], "size", "text_crc32", "shard", "slot")
