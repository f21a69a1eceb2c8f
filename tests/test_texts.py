from pyspark.sql import functions as F

from mvtrack.functions import texts
from mvtrack.sources import runs


def test_decimals_are_those_of_the_exact_value(spark, tmp_path):
    """0.48405 and 0.30065 are a little less in binary, 0.00015 too, 0.00005 and 0.00025 a little more; 0.03125 is a tie, to the even digit."""
    values = [0.48405, 0.30065, 0.00005, 0.00015, 0.00025, 0.03125, 0.09375, -0.48405, 12345678.00005, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    want = [None if v is None else f"{v:.4f}" for v in values]
    assert [r.t for r in rows.select("i", texts.fixed(F.col("v"), 4).alias("t")).orderBy("i").collect()] == want
    assert want[:2] == ["0.4840", "0.3006"] and want[5:7] == ["0.0312", "0.0938"]
    runs.write_comparison(rows.where("v IS NOT NULL"), str(tmp_path / "out"))
    assert sorted(r.v for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()) == sorted(t for t in want if t)
