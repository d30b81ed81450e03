"""The schema of JSON texts: every path with its types, folded by aggregation, so that parts of a table give parts that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.shared import cut

#: Kinds of values.
KINDS = ["null", "boolean", "integer", "number", "string", "array", "object"]


def kind_of(value: Column) -> Column:
    """The kind of a variant."""
    name = F.schema_of_variant(value)
    return (
        F.when(F.is_variant_null(value) | (name == "VOID"), "null").when(name == "BOOLEAN", "boolean").when(name == "BIGINT", "integer").when(name == "STRING", "string")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("number")
    )


def walk(texts: DataFrame, column: str) -> DataFrame:
    """(path, kind, value, depth) of every value of every JSON text: `$` is the text's own, `.key` a field, `[]` an element.

    A level a round, as deep as the data go; each is cut. Null texts and texts that are no JSON have no values.
    """
    now = cut(texts.select(F.lit("$").alias("path"), F.try_parse_json(column).alias("v")).where("v is not null").withColumn("kind", kind_of(F.col("v"))))
    scalar = ~F.col("kind").isin("array", "object")
    value = F.when(scalar, F.col("v").cast("string"))
    seen, depth = None, 0
    spark = texts.sparkSession
    while True:
        level = now.select("path", "kind", value.alias("value"), F.lit(depth).alias("depth"))
        seen = level if seen is None else seen.unionByName(level)
        nested = now.where(~scalar)
        if nested.isEmpty():
            return seen
        inner = nested.select(F.col("path").alias("parent"), F.col("kind").alias("outer"), F.col("v").alias("whole")).lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
        step = F.when(F.col("outer") == "array", F.concat("parent", F.lit("[]"))).otherwise(F.concat("parent", F.lit("."), "key"))
        now = cut(inner.select(step.alias("path"), F.col("value").alias("v")).where("v is not null").withColumn("kind", kind_of(F.col("v"))))
        depth += 1


def counts(values: DataFrame) -> DataFrame:
    """(path, n, n_<kind>..., length, least, most): of walk()'s rows; parts counted apart are merged by merged()."""
    number = F.when(F.col("kind").isin("integer", "number"), F.col("value").cast("double"))
    return values.groupBy("path").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.coalesce(F.sum(F.when(F.col("kind") == "string", F.length("value"))), F.lit(0)).alias("length"), F.min(number).alias("least"), F.max(number).alias("most"),
    )


def merged(*parts: DataFrame) -> DataFrame:
    """counts() of several parts as those of all of them."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("path").agg(F.sum("n").alias("n"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in KINDS], F.sum("length").alias("length"), F.min("least").alias("least"), F.max("most").alias("most"))


def schema(counted: DataFrame) -> DataFrame:
    """(path, type, n, null_share, kinds, mean_length, least, most) of counts(): the least type that holds all values.

    Integers are numbers; any other two kinds have only `mixed` above them; nulls fit everywhere. kinds: how often each occurs.
    """
    has = {k: F.col(f"n_{k}") > 0 for k in KINDS}
    several = sum((has[k].cast("int") for k in KINDS if k not in ("null", "integer", "number")), F.lit(0)) + (has["integer"] | has["number"]).cast("int")
    one = F.when(has["number"], "number")
    for k in KINDS:
        if k not in ("null", "number"):
            one = one.when(has[k], k)
    kinds = F.array_join(F.array_compact(F.array(*[F.when(has[k], F.concat(F.lit(f"{k}:"), F.col(f"n_{k}").cast("string"))) for k in KINDS])), ",")
    return counted.select(
        "path", F.when(several > 1, "mixed").otherwise(one.otherwise("null")).alias("type"), "n", F.round(F.col("n_null") / F.col("n"), 6).alias("null_share"), kinds.alias("kinds"),
        F.round(F.when(has["string"], F.col("length") / F.col("n_string")), 6).alias("mean_length"), "least", "most",
    )
