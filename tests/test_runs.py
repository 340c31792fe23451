import re

from pyspark.sql import functions as F

from codonloom.functions import kernels as K


def test_letter_runs(spark):
    texts = ["", "111", "0111", "11011101111", "1" * 9, "000", "1101100", "0" * 3000 + "111" + "0" * 3000, "€1111x111\n111", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["r"] for r in df.select("t", K.letter_runs(F.col("t"), "1", 3).alias("r")).collect()}
    for t in texts:
        want = None if t is None else [(m.start(), m.end() - m.start()) for m in re.finditer("1{3,}", t)]
        assert got[t] == want if t is None else [tuple(x) for x in got[t]] == want
