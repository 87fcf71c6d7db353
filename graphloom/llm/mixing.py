"""Mixing of sources to target weights by systematic sampling, in DataFrame functions alone.

Each source gets a weight; the weights share the sum of all sizes. A source's target stops at
``most`` times its size, and what it can't take is shared again by weight among the others: with
the sources ordered by the share at which they stop, the common level is the greatest of the
levels that each prefix of stopped sources would leave, so one window over the sources finds it.

All documents of a source have the same number of expected copies, target / size. In a fixed
order within the source these are summed up, one random offset is added, and a document is
emitted once for each integer that its stretch of the sum crosses. The order runs through sizes
(powers of two), so that small and large documents are drawn in proportion.

The running sum needs each document's rank in its source. A source may hold a third of all rows,
so it is split into cells by size class and a salt, a hash of id and text, about ``CELL_ROWS`` rows
each, in the order of size, id and hash: a document's rank is its row number in the cell plus the
counts of the cells before. These are summed in two levels, ``RUN`` cells at a time, so that no
window grows with the rows of a source. Weights and levels need one row per source.

Null texts and sizes count as 0; the null source comes last; null ids, ids of any type and repeated
rows are drawn like others, texts of any length are counted whole; an empty table gives an empty
one; a source of size 0 has target 0 and no copies. Columns of any name pass through; those that
begin with ``prefix`` are replaced by ``copies``, and ``emit`` takes a prefix that none has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL_ROWS, RUN = 1_000, 1_024
#: Up to so many sources and size classes, their table is broadcast; beyond, it is joined by them and a salt.
MOST_BROADCAST = 100_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def spread_of(doc_id: Column, text: Column) -> Column:
    """32 bits of a hash of id and text, the same in other engines."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``source``, ``source_size``, ``target`` for each source of ``sizes`` (``source``, ``size``).

    The windows run over one row per source, not over documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("stop", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every).cast("double") - before) / rest
    share = F.max("level").over(every) * F.col("weight")
    return rows.withColumn("level", level).select("source", "source_size", F.least(F.col("stop"), share).alias("target"))


def cell_starts(cells: DataFrame) -> DataFrame:
    """``cells`` (``source``, ``class``, ``salt``, ``rows``) and ``before``: the rows of the class in the cells before."""
    run = F.floor(F.col("salt") / RUN).alias("run")
    inner = Window.partitionBy("source", "class", "run").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("source", "class").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = cells.groupBy("source", "class", run).agg(F.sum("rows").alias("of_run"))
    runs = runs.select(F.col("source").alias("source_"), F.col("class").alias("class_"), F.col("run").alias("run_"), F.coalesce(F.sum("of_run").over(outer), F.lit(0)).alias("runs_before"))
    within = cells.withColumn("run", run).withColumn("cells_before", F.coalesce(F.sum("rows").over(inner), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("source_")) & (F.col("class") == F.col("class_")) & (F.col("run") == F.col("run_"))
    return within.join(runs, same).select("source", "class", "salt", (F.col("runs_before") + F.col("cells_before")).alias("before"))


def copies(
    docs: DataFrame, size: Column, source: Column, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17, spread: Column | None = None, prefix: str = "_mix_"
) -> DataFrame:
    """All columns of ``docs`` and, with ``prefix``, ``size``, ``source_size``, ``target``, ``copies`` (0 to ``most``).

    ``spread``: a hash of the row below 2 ** 32, by default of ``doc_id`` and ``text``.
    """
    at = lambda name: f"{prefix}{name}"
    of = lambda name: F.col(at(name))
    spread = spread_of(F.col("doc_id"), F.col("text")) if spread is None else spread
    own = [F.col(f"`{c}`") for c in docs.columns if not c.lower().startswith(prefix)]
    # hash and size first, so that what follows reads no text
    rows = docs.select(*own, F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias(at("size")), source.alias(at("source")), spread.alias(at("spread")), F.col("doc_id").alias(at("id")))
    rows = rows.withColumn(at("class"), F.length(F.bin(of("size"))))
    # counted once, on the narrow columns: all later choices depend on it
    classes = rows.groupBy(of("source").alias("source"), of("class").alias("class")).agg(F.sum(of("size")).alias("size"), F.count("*").alias("rows")).checkpoint()
    earlier = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    info = classes.select("source", "class", F.ceil(F.col("rows") / CELL_ROWS).alias("salts"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("class_before"))
    targets = source_targets(classes, weights, most).withColumnRenamed("source", "source_")
    info = info.join(targets, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    info = info.select(*(F.col(c).alias(at(f"of_{c}")) for c in info.columns))
    same = of("source").eqNullSafe(of("of_source")) & (of("class") == of("of_class"))
    if classes.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(info), same)
    else:
        info = info.withColumn(at("of_part"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(info, same & (F.pmod(of("spread"), F.lit(SALTS)) == of("of_part"))).drop(at("of_part"))
    rows = rows.withColumn(at("salt"), F.pmod(of("spread"), of("of_salts")))
    cells = rows.groupBy(*(of(c).alias(c) for c in ("source", "class", "salt"))).agg(F.count("*").alias("rows"))
    starts = cell_starts(cells)
    starts = starts.select(*(F.col(c).alias(at(f"cell_{c}")) for c in starts.columns))
    joined = rows.join(starts, of("source").eqNullSafe(of("cell_source")) & (of("class") == of("cell_class")) & (of("salt") == of("cell_salt")))
    inside = Window.partitionBy(*(at(c) for c in ("source", "class", "salt"))).orderBy(at("size"), at("id"), at("spread"))
    rank = of("of_class_before") + of("cell_before") + F.row_number().over(inside)
    rate = F.when(of("of_source_size") > 0, of("of_target") / of("of_source_size")).otherwise(F.lit(0.0))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(of("source").cast("string"), F.lit(""))), 256), 1, 8)
    offset = F.conv(digits, 16, 10).cast("double") / 4294967296.0
    ranked = joined.withColumn(at("rank"), rank)
    crossed = F.floor(of("rank") * rate + offset) - F.floor((of("rank") - 1) * rate + offset)
    return ranked.select(*own, of("size"), of("of_source_size").alias(at("source_size")), of("of_target").alias(at("target")), crossed.cast("long").alias(at("copies")))


def emit(docs: DataFrame, size: Column, source: Column, **options) -> DataFrame:
    """The mix itself: each document as often as it was drawn, with its own columns."""
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    drawn = copies(docs, size, source, prefix=prefix, **options).where(F.col(f"{prefix}copies") > 0)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return drawn.select(*own, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{prefix}copies"))).alias(f"{prefix}copy")).select(*own)
