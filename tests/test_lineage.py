import pytest
from pyspark.sql import functions as F

from sondage.operators import lineage, seismic, stations


def test_round_trip_and_order(spark):
    df = lineage.with_step(spark.range(3).withColumn("v", F.lit(1.5)), "read", file="a.txt", line=F.col("id"))
    df = lineage.with_step(df, "scaled", by=2.5, why=None)
    back = lineage.from_json(lineage.to_json(df))
    assert back.dtypes == df.dtypes
    row = back.where("id = 2").first()["lineage"]
    assert [(s["step"], s["parameters"]) for s in row] == [("read", {"file": "a.txt", "line": "2"}), ("scaled", {"by": "2.5", "why": None})]
    assert {r["n"] for r in lineage.described(df).collect()} == {1}
    assert [len(r["lineage"]) for r in lineage.from_json(spark.createDataFrame([(None,), ("[]",)], "lineage string")).collect()] == [0, 0]
    with pytest.raises(Exception, match="not a lineage"):
        lineage.from_json(spark.createDataFrame([("so what",)], "lineage string")).collect()


def test_a_correction_is_refused_the_second_time(spark):
    rows = spark.createDataFrame([(float(t), 50_000.0 + t) for t in range(6)], "t double, v double")
    base = rows.where("t < 3")
    plain = stations.drift_corrected(rows, base, "t", "v", 10.0)
    assert "lineage" not in plain.columns
    first = stations.drift_corrected(lineage.with_step(rows, "read"), base, "t", "v", 10.0).drop("diurnal")
    assert [[s["step"] for s in r["lineage"]] for r in first.collect()] == [["read", "diurnal"]] * 6
    with pytest.raises(Exception, match="diurnal refused, the row has had: diurnal"):
        stations.drift_corrected(first.drop("corrected"), base, "t", "v", 10.0).collect()
    stored = lineage.from_json(lineage.to_json(first))  # the refusal outlives a file
    with pytest.raises(Exception, match="refused"):
        lineage.once(stored, "levelled", "diurnal").collect()


def test_guided_picks_follow_predictions_and_keep_edits(spark):
    trace = lambda *onsets: [1.0 if any(o <= i < o + 4 for o in onsets) else 0.01 for i in range(60)]
    df = spark.createDataFrame([(1, trace(15, 40), 41.0), (2, trace(15, 40), 16.0), (3, trace(15, 40), None), (4, trace(30), 5.0)], "k long, a array<double>, model double")
    free = {r["k"]: r for r in seismic.guided_pick(df, "k", "a", 4, F.col("model"), 4, least=3.0).collect()}
    assert (free[1]["pick"], free[2]["pick"], free[3]["pick"], free[4]["pick"]) == (39, 14, None, None)
    table = spark.createDataFrame([(1, 14.0), (9, 3.0)], "k long, expected double")
    edits = spark.createDataFrame([(2, 33), (8, 1)], "k long, pick int")
    got = {r["k"]: (r["expected"], r["pick"], r["edited"]) for r in seismic.guided_pick(df, "k", "a", 4, table, 4, edits).collect()}
    assert got == {1: (14.0, 14, False), 2: (None, 33, True), 3: (None, None, False), 4: (None, None, False)}
