"""Page conversion, hot products by area, ad clicks over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_conversion(actions: DataFrame, flow: list[int]) -> DataFrame:
    """Rates of single jumps along a flow of pages: of the first page's visits, then of the jump before."""
    own = Window.partitionBy("session_id").orderBy("action_time", "page_id")
    jumps = actions.select("page_id", F.lead("page_id").over(own).alias("next_page"))
    hit = lambda a, b: F.coalesce(F.sum(((F.col("page_id") == a) & (F.col("next_page") == b)).cast("long")), F.lit(0))
    counts = jumps.agg(
        F.coalesce(F.sum((F.col("page_id") == flow[0]).cast("long")), F.lit(0)).alias("n0"),
        *[hit(a, b).alias(f"n{k}") for k, (a, b) in enumerate(zip(flow, flow[1:]), 1)],
    )
    steps = [F.struct(F.lit(k).alias("step"), F.lit(f"{a}_{b}").alias("jump"), F.col(f"n{k}").alias("n"), F.try_divide(F.col(f"n{k}").cast("double"), F.col(f"n{k - 1}").cast("double")).alias("rate")) for k, (a, b) in enumerate(zip(flow, flow[1:]), 1)]
    return counts.select(F.explode(F.array(*steps)).alias("s")).select("s.*")


def area_top_products(actions: DataFrame, n: int = 3) -> DataFrame:
    """The most clicked products of each area; ties by product."""
    clicks = actions.where("click_product_id is not null").groupBy("city_id", F.col("click_product_id").alias("product_id")).agg(F.count(F.lit(1)).alias("clicks"))
    order = Window.partitionBy("city_id").orderBy(F.desc("clicks"), "product_id")
    return clicks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def clicks_windowed(events: DataFrame, length: str = "1 hour", late: str | None = None) -> DataFrame:
    """Clicks in windows of time; ``late`` sets a watermark for a stream."""
    clicks = events.where("event_type = 'click'").withColumn("ts", F.col("ts").cast("timestamp"))
    clicks = clicks.withWatermark("ts", late) if late else clicks
    out = clicks.groupBy(F.window("ts", length).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", "value")


