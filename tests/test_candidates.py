from codonloom.operators import generate as N


def test_candidates_are_drawn_once(spark):
    """The checks of a candidate read the drawn sequence; they do not draw it again (F4)."""
    df = spark.createDataFrame([(1, "MKTAYIAKQR"), (2, "MGGW"), (3, None)], "id long, aa string")
    c = N.candidates(df, "id", "aa", "E_coli", 3, motifs=["GAATTC"])
    assert c._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    got = c.collect()
    assert {r["id"] for r in got} == {1, 2} and len({(r["id"], r["dna"]) for r in got}) == len(got)
