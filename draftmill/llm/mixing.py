"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

Each source's mean repetition rate is its target share over its present share. A document's count of copies
is the inverse of that Poisson distribution at a number hashed from its id and the seed, so that a lost task
draws the same again. Documents are exploded by their counts and dealt out in hashed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Highest mean of one inversion; a higher rate is drawn as a sum of several.
PIECE = 16.0


def hashed(*parts: Column | str, digits: int = 13) -> Column:
    """A whole number from the MD5 digest of the parts joined by ":" (13 hex digits: 52 bits)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("long")


def poisson_count(u: Column, mean: Column) -> Column:
    """The inverse at ``u`` in [0, 1) of a Poisson distribution of ``mean``, at most PIECE."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"), F.lit(0).alias("n"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * mean / k
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"), (state["n"] + (state["sum"] <= u).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["n"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, total: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(_source, _rate): mean copies of a document of each source, for ``total`` times the present bytes.

    ``weights`` (source, weight) names target shares; they are scaled to 1 over the sources present, and a
    source it doesn't name gets none. Weights of a source named several times add up, a null one counts as 0, a
    negative one or NaN is an error; if no source present has a weight over 0, all rates are 0. Without ``weights``,
    shares are bytes to the ``power``. Bytes of a text include one for its end, so that sources of empty texts
    have a size. A null source is a source of its own.
    """
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    sums = materialise(docs.groupBy(F.col(source_col).cast("string").alias("_source")).agg(F.sum(size).alias("_bytes")), "sources")
    if weights is None:
        shares = sums.withColumn("_share", F.pow(F.col("_bytes").cast("double"), F.lit(power)))
    else:
        weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
        weight = F.when((weight < 0) | F.isnan(weight), F.raise_error(F.lit("a weight must not be negative"))).otherwise(weight)
        named = weights.groupBy(F.col("source").cast("string").alias("_named")).agg(F.sum(weight).alias("_share"))
        shares = sums.join(named, F.col("_source").eqNullSafe(F.col("_named")), "left").na.fill(0.0, ["_share"]).drop("_named")
    every, whole = shares.agg(F.sum("_bytes"), F.sum("_share")).first()  # two numbers
    if not whole:
        return shares.select("_source", F.lit(0.0).alias("_rate"))
    return shares.select("_source", (F.lit(total) * F.lit(every) * F.col("_share") / F.lit(whole) / F.col("_bytes")).alias("_rate"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, total: float = 1.0, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, each as often as drawn, with _copies long, _copy long (from 1) and _order long.

    All columns of ``docs`` stay; its own of those names are replaced. Rows of one id draw one count, whatever
    the rest of them, a null id draws as the empty text; so the result doesn't depend on order or partitions.
    A rate of 0 drops a source, an empty table gives no rows. Rows are dealt to partitions by hash and sorted
    within by _order, which is a random order of the whole.
    """
    names = docs.drop("_copies", "_copy", "_order").columns
    rates = source_rates(docs, weights, power, total, source_col, text_col)
    columns = [F.col(f"`{c}`") for c in names]
    joined = docs.select(*columns).join(rates, F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("_source")))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("_rate") / PIECE)).cast("int")
    u = lambda k: hashed(F.lit(str(seed)), k.cast("string"), ident) / float(1 << 52)
    whole = F.aggregate(F.sequence(F.lit(1), F.col("_pieces")), F.lit(0), lambda n, k: n + poisson_count(u(k), F.col("_rate") / F.col("_pieces")))
    drawn = joined.withColumn("_pieces", pieces).withColumn("_copies", whole.cast("long")).filter("_copies > 0")
    copies = drawn.select(*columns, "_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    order = hashed(F.lit(f"{seed}s"), F.col("_copy").cast("string"), ident, digits=15)
    return copies.withColumn("_order", order).repartition(F.col("_order")).sortWithinPartitions("_order")
