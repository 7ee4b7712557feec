"""Group tables: which features are completed together, with which auxiliary ones, by which parameters."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacunar.sources.store import stored

GROUPS = "grp string, feature array<string>, aux array<string>, parameters string"
_registry: dict[str, DataFrame] = {}


def register(name: str, table: DataFrame) -> None:
    """Makes a named group table (such as a platform's annotation) known to resolve()."""
    _registry[name] = table


def resolve(group: DataFrame | str) -> DataFrame:
    """A group table, or a registered one by name; whole repeated rows are dropped."""
    if isinstance(group, str):
        if group not in _registry:
            raise ValueError(f"no group table {group!r} is registered")
        group = _registry[group]
    return group.dropDuplicates()


def nested(group: DataFrame) -> DataFrame:
    """The list form of a long (grp, feature) table; a list table gets empty aux and parameters where it has none."""
    kinds = dict(group.dtypes)
    if "feature" not in kinds:
        raise ValueError("a group table needs a feature column")
    if not kinds["feature"].startswith("array"):
        if "grp" not in kinds:
            raise ValueError("a long group table needs a grp column")
        if kinds["grp"] in ("double", "float") and not group.where("grp <> floor(grp)").isEmpty():
            warnings.warn("group labels are numbers that aren't whole", stacklevel=2)
        long = group.select("grp", F.col("feature").cast("string").alias("feature")).distinct()
        if not long.where("grp is null or feature is null").isEmpty():
            raise ValueError("grp and feature must not be missing")
        return long.groupBy(F.col("grp").cast("string").alias("grp")).agg(F.array_sort(F.collect_list("feature")).alias("feature")).select("grp", "feature", F.array().cast("array<string>").alias("aux"), F.lit("{}").alias("parameters"))
    label = F.col("grp").cast("string") if "grp" in kinds else F.concat(F.lit("group"), F.row_number().over(Window.orderBy(F.to_json("feature"))).cast("string"))
    aux = F.coalesce(F.col("aux").cast("array<string>"), F.array().cast("array<string>")) if "aux" in kinds and kinds["aux"].startswith("array") else F.array().cast("array<string>")
    parameters = F.lit("{}")
    if "parameters" in kinds:
        parameters = F.coalesce(F.col("parameters") if kinds["parameters"] == "string" else F.to_json("parameters"), F.lit("{}"))
    return group.select(label.alias("grp"), F.array_compact(F.col("feature").cast("array<string>")).alias("feature"), F.array_distinct(F.array_compact(aux)).alias("aux"), parameters.alias("parameters"))


def prepare(features: DataFrame, group: DataFrame | str, subset: list[str] | None = None, min_group_size: int = 0, allow_unmapped: bool = False, seed: int = 0) -> DataFrame:
    """The normalised table of groups of features (feature), as the group callers need it.

    Features in no group are an error unless allowed; a feature in two groups always is. Names that the matrix
    lacks are dropped, as are groups left without features. With a subset, other features become auxiliary.
    Groups that are too small get auxiliary features in a hash order that the seed sets.
    """
    known = features.select(F.col("feature").alias("f")).distinct()
    table = nested(resolve(group))
    own = table.select("grp", F.explode("feature").alias("f"))
    if not own.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a feature is in more than one group")
    mapped = own.select("f").union(table.select(F.explode("aux").alias("f")))
    if not allow_unmapped and not known.join(mapped, "f", "left_anti").isEmpty():
        raise ValueError("features are in no group")
    names = subset if subset is None else list(dict.fromkeys(subset))
    if names is not None:
        asked = known.sparkSession.createDataFrame([(s,) for s in names], "f string")
        if not asked.join(known, "f", "left_anti").isEmpty() or not asked.join(own, "f", "left_anti").isEmpty():
            raise ValueError("subset has features that the matrix or the groups lack")
    parts = own.withColumn("role", F.lit(0)).unionByName(table.select("grp", F.explode("aux").alias("f")).withColumn("role", F.lit(1)))
    parts = parts.join(known, "f", "left_semi")
    if names is not None:
        parts = parts.join(asked.withColumn("_in", F.lit(True)), "f", "left").withColumn("role", F.when((F.col("role") == 0) & F.col("_in").isNull(), 1).otherwise(F.col("role"))).drop("_in")
    parts = parts.groupBy("grp", "f").agg(F.min("role").alias("role"))
    kept = parts.where("role = 0").select("grp").distinct()
    parts = parts.join(kept, "grp", "left_semi")
    if min_group_size:
        size = parts.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") < min_group_size)
        parts = parts.unionByName(padding(known, parts, size, min_group_size, seed))
        if not parts.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") < min_group_size).isEmpty():
            raise ValueError("too few features to fill up a group")
    pick = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("f"))))
    out = parts.groupBy("grp").agg(pick(0).alias("feature"), pick(1).alias("aux")).join(table.select("grp", "parameters"), "grp")
    if out.isEmpty():
        raise ValueError("no group is left")
    return out


def padding(known: DataFrame, parts: DataFrame, small: DataFrame, least: int, seed: int) -> DataFrame:
    """(grp, f, role 1): features that fill the small groups (grp, n) up to `least`.

    All features are numbered once in a hash order that the seed sets; a group takes those that follow a place of
    its own, round the end, leaving out what it has. At most `least` following ones can be its own, so twice as
    many are looked up, by number, and no group meets the whole pool.
    """
    pool = stored(known.withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "f"), "f")) - 1), "pool")
    total = pool.count()
    own = F.pmod(F.xxhash64(F.lit(seed), "grp"), F.lit(total))
    steps = small.select("grp", "n", F.posexplode(F.sequence(own, own + min(2 * least, total) - 1)).alias("step", "at")).withColumn("place", F.col("at") % total)
    met = steps.join(pool, "place").join(parts.select("grp", "f"), ["grp", "f"], "left_anti")
    order = Window.partitionBy("grp").orderBy("step")
    return met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= least - F.col("n")).select("grp", "f", F.lit(1).alias("role"))


def table_of(spark: SparkSession, groups: dict[str, dict]) -> DataFrame:
    """A group table from {label: {"feature": [...], "aux": [...], "parameters": {...}}}."""
    rows = [(k, g["feature"], g.get("aux") or [], json.dumps(g.get("parameters") or {})) for k, g in groups.items()]
    return spark.createDataFrame(rows, GROUPS)
