"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a target share of the mixture and so a mean rate at which its documents repeat. A document's count is
drawn by inverting the Poisson distribution, whatever its mean, at a uniform number hashed from seed and id; the
document is exploded by that count, and all copies are shuffled by a hash of seed, id and copy.

Cases: a null source is a source of its own; a null id draws as the text 'null' does; a null or empty text is a
document like any other, of length 0, so it counts as one unit; documents of a source without weight go; repeated rows
draw the same count; an empty table gives an empty one; all columns stay. Columns named like the operator's own
working columns do not clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from printloom.llm.common import written

#: Up to this mean the inversion starts at 0, beyond it SPREAD standard deviations below the mean; it ends as many above, and TAIL.
FROM_ZERO, SPREAD, TAIL = 400.0, 10, 30
#: Copies that one task makes of one row at most: where a mean exceeds it, documents are dealt out in chunks of so many.
CHUNK_COPIES = 1024
#: Sources up to which rates are broadcast; more are joined by a shuffle that may split hot sources.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts: the first 13 hexadecimal digits of the MD5 of their texts, joined by colons."""
    words = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *words)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_count(rate: Column, u: Column) -> Column:
    """The least n (a long) whose cumulative Poisson probability of mean ``rate`` exceeds u.

    What lies SPREAD standard deviations below the mean is less than the steps of u. The first probability is taken
    from its logarithm (Stirling's series), the others follow from it one by one.
    """
    deviation = F.sqrt(rate)
    low = F.when(rate > FROM_ZERO, F.floor(rate - SPREAD * deviation)).otherwise(F.lit(0)).cast("long")
    high = F.ceil(rate + SPREAD * deviation + TAIL).cast("long")
    n = F.greatest(low, F.lit(1)).cast("double")
    stirling = 1 / (12 * n) - 1 / (360 * n * n * n)
    logarithm = F.when(low > 0, n * F.log1p((rate - n) / n) - (rate - n) - F.log(2 * math.pi * n) / 2 - stirling).otherwise(-rate)
    chance = F.exp(logarithm)
    start = F.struct(chance.alias("p"), chance.alias("sum"), low.alias("n"))
    step = lambda s, k: F.when(u < s["sum"], s).otherwise(F.struct((s["p"] * rate / k).alias("p"), (s["sum"] + s["p"] * rate / k).alias("sum"), k.alias("n")))
    return F.aggregate(F.sequence(low + 1, high), start, step)["n"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, epochs: float, source: str, text: str) -> DataFrame:
    """mix_source, units (characters, one at least for a document), share and rate of each source.

    Without ``weights``, shares are units to the power ``temperature``; in all, ``epochs`` times the units there are.
    """
    units = docs.groupBy(F.col(source).alias("mix_source")).agg(F.sum(F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)).cast("long")).alias("units"))
    if weights is None:
        pull = F.pow(F.col("units").cast("double"), F.lit(temperature))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        pull = F.coalesce(F.element_at(given, F.col("mix_source").cast("string")).cast("double"), F.lit(0.0))
    drawn = written(units.withColumn("pull", pull))
    total = drawn.agg(F.sum("units").alias("units"), F.sum("pull").alias("pull")).first()
    share = F.col("pull") / F.lit(total["pull"] or 1.0)
    return drawn.select("mix_source", "units", share.alias("share"), (share * F.lit(float(total["units"] or 0)) * F.lit(epochs) / F.col("units")).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text", details: bool = False) -> DataFrame:
    """Each document as often as its count says, in an order shuffled globally: by hash over partitions, sorted within them.

    With ``details``, columns mix_rate, mix_copy (from 1) and mix_order (the shuffle's key) follow the documents' own.
    """
    rates = source_rates(docs, weights, temperature, epochs, source, text).select("mix_source", "rate")
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    # no column of theirs meets one of ours
    packed = docs.select(F.struct(*[docs[n] for n in docs.columns]).alias("doc"), docs[key].alias("key"), docs[source].alias("of"))
    joined = packed.join(F.broadcast(rates) if few else rates, F.col("of").eqNullSafe(F.col("mix_source")))
    counted = joined.withColumn("n", poisson_count(F.col("rate"), uniform(F.lit(seed), F.col("key")))).where("n > 0")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK_COPIES)))
    chunked = counted.withColumn("chunk", chunk)
    if (rates.agg(F.max("rate")).first()[0] or 0) > CHUNK_COPIES:  # else next to all documents have one chunk
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunked = chunked.repartition(tasks, F.xxhash64("key", "chunk"))
    copies = chunked.withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK_COPIES + 1, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK_COPIES))))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.col("copy").cast("string")))
    shuffled = copies.withColumn("order", order).repartition("order").sortWithinPartitions("order")
    more = [F.col("rate").alias("mix_rate"), F.col("copy").alias("mix_copy"), F.col("order").alias("mix_order")] if details else []
    return shuffled.select(*[F.col("doc")[n].alias(n) for n in docs.columns], *more)
