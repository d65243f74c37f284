from tidewheel.operators.transforms import map_columns, pivot, remove, unpack_histogram


def test_pivot_and_map(spark):
    df = spark.createDataFrame([(0, "a", 4), (0, "b", 2), (60, "a", 6)], "_window_ long, k string, `n.SUM` long")
    shaped = pivot(df, "k", "n.SUM")
    assert sorted(tuple(r) for r in shaped.select("_window_", "a", "b").collect()) == [(0, 4, 2), (60, 6, 0)]
    ratio = remove(map_columns(shaped, {"r": "a / nullif(b, 0)"}), "a", "b")
    assert sorted(map(tuple, ratio.collect())) == [(0, 2.0), (60, None)]


def test_histogram_rows(spark):
    df = spark.createDataFrame([("x", '{"b":[[null,0,1,-5],[0,2,3,4]]}')], "k string, h string")
    assert [tuple(r) for r in unpack_histogram(df, "h").collect()] == [("x", "[,0)", 1), ("x", "[0,2)", 3)]
