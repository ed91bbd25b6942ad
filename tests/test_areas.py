"""Areas are summed as the SQL sums them: what lies on a tie by rounding alone is rounded alike."""

from pyspark.sql import functions as F

from wayweft.functions import geo


def test_a_footprint_on_a_tie(spark):
    pts = [(-120.4813191, 45.504281), (-120.47232079999999, 45.5210774), (-120.4939703, 45.5162258), (-120.4936208, 45.5018395)]
    row = spark.createDataFrame([(pts,)], "pts array<struct<lon: double, lat: double>>")
    assert row.select(F.rint(geo.footprint_m2(F.col("pts")) / 1000).cast("long")).first()[0] == 2162
