"""Property tables: names, lookups, merging, multi-valued groups and wide rows.

A property table is long: the object's columns, ``code``, ``guid``, and a value column. Dimension
tables come from constants of this package (a few hundred rows), so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dims


Tags = Iterable[tuple[int, str, str]]


def dim_tags(spark: SparkSession, tags: Tags = ()) -> DataFrame:
    """The built-in tags and those given; codes have 16 bits, so there are 65,536 rows at most."""
    return spark.createDataFrame([(c, n, k) for c, (n, k) in dims.merged(tags).items()], "code int, name string, kind string")


def dim_named(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, g, n) for (c, g), n in dims.NAMED.items()], "code int, guid binary, name string")


def dim_sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, n) for n, g in dims.SETS.items()], "guid binary, label string")


def tag_codes(spark: SparkSession, tags: Tags = ()) -> DataFrame:
    """The lowest code of each name."""
    return dim_tags(spark, tags).groupBy("name").agg(F.min("code").alias("code"))


def with_names(props: DataFrame, tags: Tags = ()) -> DataFrame:
    """``props`` (code, guid, ...) with ``name``, ``set_label`` and ``key_text``; unknown codes keep a null name."""
    spark = props.sparkSession
    standard = F.col("guid").isNull() | (F.col("guid") == F.lit(dims.PS_MAPI))
    standard_tags = dim_tags(spark, tags).select(F.col("code").alias("t_code"), F.col("name").alias("t_name"))
    named = dim_named(spark).select(F.col("code").alias("n_code"), F.col("guid").alias("n_guid"), F.col("name").alias("n_name"))
    sets = dim_sets(spark).select(F.col("guid").alias("s_guid"), F.col("label"))
    out = (
        props.join(F.broadcast(standard_tags), (F.col("code") == F.col("t_code")) & standard, "left")
        .join(F.broadcast(named), (F.col("code") == F.col("n_code")) & (F.col("guid") == F.col("n_guid")), "left")
        .join(F.broadcast(sets), F.col("guid") == F.col("s_guid"), "left")
    )
    name = F.coalesce("t_name", "n_name")
    digits = F.lpad(F.lower(F.hex(F.col("code").cast("long"))), 4, "0")
    text = F.when(name.isNotNull(), name).when(standard, digits).otherwise(F.concat(digits, F.lit("@"), F.coalesce("label", F.lit("unknown"))))
    return out.select(*props.columns, name.alias("name"), F.when(standard, "ps_mapi").otherwise(F.coalesce("label", F.lit("unknown"))).alias("set_label"), text.alias("key_text"))


def resolve_pseudo(props: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """Codes from 0x8000 on replaced by what ``names`` (by, pseudo_code, code, guid) says; others get the standard set."""
    n = names.select(*by, F.col("pseudo_code").alias("__p"), F.col("code").alias("__c"), F.col("guid").alias("__g"))
    hit = props.join(n.withColumnRenamed("__p", "code"), [*by, "code"], "left")
    pseudo = (F.col("code") >= 0x8000) & F.col("__g").isNotNull()
    return hit.select(*[c for c in props.columns if c not in ("code", "guid")], F.when(pseudo, F.col("__c")).otherwise(F.col("code")).alias("code"), F.when(pseudo, F.col("__g")).otherwise(F.lit(dims.PS_MAPI)).alias("guid"))


def merge_last_wins(first: DataFrame, second: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Union of two tables in which the second's value of a key counts; one aggregation, no join."""
    both = first.select(*keys, F.col(value), F.lit(0).alias("__r")).unionByName(second.select(*keys, F.col(value), F.lit(1).alias("__r")))
    return both.groupBy(*keys).agg(F.max_by(value, "__r").alias(value))


def multi_values(rows: DataFrame, by: list[str], index: str = "index", value: str = "value") -> DataFrame:
    """Values of one property gathered in the order of their index."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(index), F.col(value))))
    return rows.groupBy(*by).agg(F.transform(pairs, lambda x: x[value]).alias("values"))


def truthy(value: Column, boolean: bool) -> Column:
    """Lookups by name or code skip false as they skip null."""
    return value.isNotNull() & value if boolean else value.isNotNull()


def get(props: DataFrame, by: list[str], name: str, value: str = "value", boolean: bool = False, tags: Tags = ()) -> DataFrame:
    """The first value of that name, lowest code first; objects without one are absent."""
    codes = [c for c, (n, _) in dims.merged(tags).items() if n == name]
    hit = props.filter(F.col("code").isin(codes) & truthy(F.col(value), boolean))
    return hit.groupBy(*by).agg(F.min_by(value, "code").alias(value))


def get_exact(props: DataFrame, code: int, guid: bytes, value: str = "value") -> DataFrame:
    """By code and property set; false is a value here."""
    return props.filter((F.col("code") == code) & (F.col("guid") == F.lit(guid)))


def wide(props: DataFrame, by: list[str], names: dict[str, str], tags: Tags = ()) -> DataFrame:
    """One row an object with a column for each of ``names`` (column -> property name), in a single aggregation."""
    cols, known = [], dims.merged(tags)
    for column, name in names.items():
        codes = [c for c, (n, _) in known.items() if n == name]
        cols.append(F.min_by(F.when(F.col("code").isin(codes), F.col("value")), F.when(F.col("code").isin(codes) & F.col("value").isNotNull(), F.col("code"))).alias(column))
    return props.groupBy(*by).agg(*cols)


def keep_lowest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def property_map(props: DataFrame, by: list[str], tags: Tags = ()) -> DataFrame:
    """``props`` map<key_text, value> of each object; of equal keys the highest code counts."""
    pairs = F.array_sort(F.collect_list(F.struct("code", "key_text", "value")))
    return with_names(props, tags).groupBy(*by).agg(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["key_text"], x["value"]))).alias("props"))
