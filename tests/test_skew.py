from factloom.operators.skew import degrees, heavy_keys

SCHEMA = "id string, from_id string, to_id string, rel_type string, field string, n long"


def test_heavy_keys_and_degrees(spark):
    rows = [(f"r{k}", "Hub " if k % 3 else f"v{k}", " HUB" if k % 2 else None, "T" if k % 4 else None, "f", 1) for k in range(100)]
    rows += [("r1", "hub", "hub", "T", "f", 1), (None, "hub", "", "T", "f", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in heavy_keys(df, ["from_id", "to_id"], 0.3).collect()} == {("from_id", "hub"), ("to_id", "hub")}
    got = {tuple(r)[:3]: tuple(r)[3:] for r in degrees(df).collect()}
    out = [r for r in rows[:100] if r[1] == "Hub " and r[3] == "T"]
    assert got[("hub", "out", "T")] == (len(out) + 1, 1)
    assert got[("v0", "out", None)] == (1, 0)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert heavy_keys(df, ["from_id"]).count() == 0 and degrees(df).count() == 0
