"""Field schemas of targets: composition, defaults and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compose(layers: DataFrame) -> DataFrame:
    """``kind``, ``field``, ``type``, ``required``, ``value`` of each kind; of a field's layers (``depth`` 0 is the base) the last wins."""
    rest = [c for c in layers.columns if c not in ("kind", "field", "depth")]
    return layers.groupBy("kind", "field").agg(F.max_by(F.struct(*rest), "depth").alias("x")).select("kind", "field", "x.*")


#: What a text must look like to be of a type.
TYPES = {"integer": r"^-?[0-9]+$", "boolean": r"^(true|false)$", "string": r"(?s)^.*$"}


def _fits(value, kind):
    out = F.lit(False)
    for name, pattern in TYPES.items():
        out = F.when(kind == name, F.regexp_like(value, F.lit(pattern))).otherwise(out)
    return out


def validate(attributes: DataFrame, targets: DataFrame, schema: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Filled attributes (``address``, ``field``, ``value``) and errors (``address``, ``field``, ``error``).

    ``attributes``: ``address``, ``field``, ``value``; ``targets``: ``address``, ``kind``; ``schema``: as ``compose`` gives it.
    A missing field takes its default; without one it is an error if required. Unknown fields and values of
    another type are errors.
    """
    wanted = targets.join(schema, "kind").select("address", "field", "type", "required", F.col("value").alias("default"))
    rows = wanted.join(attributes, ["address", "field"], "full")
    error = (
        F.when(F.col("type").isNull(), "not declared").when(F.col("value").isNotNull() & ~_fits(F.col("value"), F.col("type")), F.concat(F.lit("must be "), F.col("type")))
        .when(F.col("value").isNull() & F.col("default").isNull() & F.col("required"), "missing required")
    )
    judged = rows.select("address", "field", F.coalesce("value", "default").alias("value"), error.alias("error"))
    return judged.where("error is null and value is not null").drop("error"), judged.where("error is not null").drop("value")
