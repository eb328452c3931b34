from pyspark.sql import functions as F

from graphlake.functions.ids import numeric_id


def test_numbers_in_text(spark):
    cases = {"12": 12, " 12": 12, "12\t": 12, "000012 ": 12, "": None, "n/a": None, None: None, "1 2": None, "-3": -3, "99999999999999999999": None, "1.5": None, "?": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(numeric_id(F.col("t"))).collect()] == list(cases.values())
