"""Districts, promotion budget, ranks and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions import text
from .classify import is_worship, salience_of
from .nearest import nearest_k


def anchors(features: DataFrame) -> DataFrame:
    """pos, name, lon, lat of the places."""
    return features.where("kind = 'place'").select("pos", text.name_of("name", "category").alias("name"), F.col("pts")[0]["lon"].alias("lon"), F.col("pts")[0]["lat"].alias("lat"))


def with_district(pois: DataFrame, anchor_rows: DataFrame) -> DataFrame:
    """pois(id, lon, lat, ...) with the name of the nearest anchor; the first anchor wins a tie; null without anchors."""
    near = nearest_k(pois.select("id", "lon", "lat"), anchor_rows.select(F.col("pos").alias("ord"), "lon", "lat"))
    named = near.join(anchor_rows.select(F.col("pos").alias("ord"), F.col("name").alias("district")), "ord").select("id", "district")
    return pois.join(named, "id", "left")


def eligible(rows: DataFrame) -> DataFrame:
    """rows with salience (a missing one by category) and standing: core, budgeted or none."""
    salience = F.coalesce("salience", salience_of("category"))
    named = text.empty_to_null("name").isNotNull()
    standing = F.when(salience == "clustered", "none").when(~named & ~is_worship("category"), "none").when(salience == "core", "core").otherwise("budgeted")
    return rows.withColumn("standing", standing)


def promoted_flag(rows: DataFrame, budget: int) -> DataFrame:
    """rows(district, ...) with promoted: all core ones, and in each district the best of the budgeted ones."""
    ranked = eligible(rows)
    order = Window.partitionBy(F.coalesce("district", F.lit("")), "standing").orderBy(F.desc(F.coalesce("importance", F.lit(0))), "osm_id", "id")
    # a filter on the rank lets Spark cut each group down before the shuffle
    best = ranked.where("standing = 'budgeted'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(0, budget)).select("id", F.lit(True).alias("within"))
    return ranked.join(best, "id", "left").withColumn("promoted", (F.col("standing") == "core") | F.coalesce("within", F.lit(False))).drop("within")


def numbered(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """A dense 1-based rank in a global order without a single-task window: range partitions, then offsets by partition."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    dealt = tables.materialise(dealt, "ranked")
    part = F.shiftright("_row", 33).alias("_part")
    sizes = dealt.groupBy(part).count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row for each partition
    inside = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + inside + 1).cast("long")).drop("_part", "_before", "_row")


def promoted_table(rows: DataFrame) -> DataFrame:
    """The promoted rows with rank and token, as the model shows them."""
    kept = rows.where("promoted")
    ranked = numbered(kept, [F.desc(F.coalesce("importance", F.lit(0))), F.asc("osm_id"), F.asc("id")])
    count = ranked.count()  # of the table that numbering has written; kept would be computed again
    return ranked.select(
        "rank", text.token("rank", F.lit(count)).alias("token"), text.name_of("name", "category").alias("name"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("importance", F.lit(0)).alias("importance"),
        F.coalesce("tier", F.lit("")).alias("tier"), text.empty_to_null("street").alias("street"), F.coalesce("street_approx", F.lit(False)).alias("street_approx"), "district", "lon", "lat",
    )


def minor_table(rows: DataFrame) -> DataFrame:
    return rows.where("not promoted").select(F.col("id").alias("pos"), text.name_of("name", "category").alias("name"), F.coalesce("category", F.lit("")).alias("category"), text.empty_to_null("name").isNotNull().alias("named"), "district", "lon", "lat")
