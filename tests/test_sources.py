"""Readers and writers on files the test makes."""

import json
import uuid

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.operators.reshape import name_months
from panelspark.plans.raster import read_raster_folder
from panelspark.session import scratch_path, shared_root, written
from panelspark.sources import boundaries, files
from panelspark.sources.surveys import attach_coordinates, choose_surveys, load_chosen


def test_csv_null_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v,t\n1,NA,x\n2,3.5,NA\n3,bad,y\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), "k int, v double, t string").orderBy("k")
    assert [tuple(r) for r in df.collect()] == [(1, None, "x"), (2, 3.5, None), (3, None, "y")]


def test_wide_matrix_rows_are_numbered_by_position(spark, tmp_path):
    lines = "".join(f"{k},{k + 0.5},NaN,9\n" for k in range(2000))
    (tmp_path / "m.csv").write_text(lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = files.read_wide_matrix(spark, str(tmp_path / "m.csv"), 3)
        assert df.rdd.getNumPartitions() > 1
        assert df.where("row_id - 1 != v0").count() == 0
        assert df.select("row_id").distinct().count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    named = name_months(df, "2000-01-01", "2000-03-01", ["row_id"])
    assert named.columns == ["row_id", "2000-01-01", "2000-02-01", "2000-03-01"]


def test_wide_matrix_leading_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,label,a,b\n7,x,1,2\n8,y,3,4\n")
    df = files.read_wide_matrix(spark, str(tmp_path / "m.csv"), 2, header=True, leading=2)
    assert sorted(map(tuple, df.collect())) == [(1, 1.0, 2.0), (2, 3.0, 4.0)]


def test_ordered_part_files_count_on(spark):
    path = scratch_path(spark, "parts")
    spark.range(0, 1000, 1, 7).orderBy("id").write.csv(path)
    df = files.with_row_position(spark.read.csv(path, schema="v long"))
    assert df.where("v + 1 != row_id").count() == 0


def test_ragged(spark, tmp_path):
    (tmp_path / "a.csv").write_text("NAME_0,NAME_1,x\nA,1,2.5\n")
    (tmp_path / "b.csv").write_text("iso,NAME,y\nB,2,NA\n")
    df = files.read_ragged(
        spark,
        [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")],
        {"NAME_0": "string", "NAME_1": "string"},
        {"iso": "NAME_0", "NAME": "NAME_1"},
    )
    rows = sorted(map(tuple, df.select("NAME_0", "NAME_1", "x", "y").collect()))
    assert rows == [("A", "1", 2.5, None), ("B", "2", None, None)]
    assert df.select("source_file").distinct().count() == 2


def test_ragged_files_are_scanned_by_header(spark, tmp_path):
    """A thousand files of three kinds, one of them empty: three scans."""
    kinds = ["NAME_0,x\nA,1\n", 'NAME_0,"y, quoted"\nB,2\n', "z,NAME_0\n3,C\n"]
    for k in range(999):
        (tmp_path / f"part {k}%.csv").write_text(kinds[k % 3])
    (tmp_path / "empty.csv").write_text("")
    df = files.read_ragged(spark, [str(tmp_path)], {"NAME_0": "string"})
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
    got = df.groupBy("NAME_0", "x", "`y, quoted`", "z").count().collect()
    assert sorted(map(tuple, got), key=str) == [("A", 1.0, None, None, 333), ("B", None, 2.0, None, 333), ("C", None, None, 3.0, 333)]
    assert df.select("source_file").distinct().count() == 999


def feature(name, *corners):
    return {"type": "Feature", "properties": {"NAME_1": name, "n": 7}, "geometry": {"type": "Polygon", "coordinates": [[list(c) for c in corners]]}}


def test_layers_by_country_and_level(spark, tmp_path):
    square, far = [(0, 0), (1, 0), (1, 1), (0, 0)], [(5, 5), (6, 5), (6, 6), (5, 5)]
    layers = {
        "adm_KEN_1.json": {"type": "FeatureCollection", "features": [feature("a", *square), feature("b", *far)]},
        "adm_KEN_2.json": {"type": "FeatureCollection", "features": [feature("a.1", *square)]},
        "adm_UGA_1.json": feature("c", *far),
        "adm_UGA_11.json": {"type": "FeatureCollection", "features": []},
        "adm_TZA_1.json": "broken",
    }
    for name, body in layers.items():
        (tmp_path / name).write_text(json.dumps(body, indent=1))
    columns = {"NAME_1": "NAME_1", "n": "n", "none": "absent"}

    def names(**chosen):
        return sorted(r["NAME_1"] for r in boundaries.read_layer(spark, str(tmp_path), columns, **chosen).collect())

    assert names(countries=["KEN", "UGA"], level=1) == ["a", "b", "c"]
    assert names(countries=["KEN"]) == ["a", "a.1", "b"] and names(countries=["UGA"], level=2) == []
    layer = boundaries.read_layer(spark, str(tmp_path), columns, ["KEN"], 1, types={"n": "int"})
    assert [(r["n"], r["none"]) for r in layer.collect()] == [(7, None)] * 2
    edges = boundaries.boundary_edges(layer, ["NAME_1"])
    assert edges.count() == 6
    whole = spark.createDataFrame([(json.dumps(layers["adm_KEN_1.json"]),)], "geometry string")
    assert boundaries.boundary_edges(whole, []).agg(F.max("part"), F.count("*")).first()[:] == (1, 6)
    # Files that are not chosen are not opened.
    scan = boundaries.read_layer(spark, str(tmp_path), columns, ["KEN"], 1)
    assert {f.rsplit("/", 1)[1] for f in scan.select(F.col("NAME_1"), F.input_file_name().alias("f")).toPandas()["f"]} == {"adm_KEN_1.json"}


def test_raster_folder_prunes_years(spark, tmp_path):
    for year in (1998, 1999):
        for month in ("April", "December"):
            (tmp_path / f"tmax.{month}.{year}.csv").write_text("cell_id,x,y,value\n1,0.5,0.5,2.5\n2,0.5,0.5,NA\n")
    (tmp_path / "tmax.readme.csv").write_text("no cells\n")
    schema = "cell_id long, x double, y double, value double"
    cells = read_raster_folder(spark, str(tmp_path), "tmax.", schema, [1999])
    assert sorted({(str(r["ymd"]), r["value"]) for r in cells.collect()}, key=str) == [("1999-04-01", 2.5), ("1999-04-01", None), ("1999-12-01", 2.5), ("1999-12-01", None)]
    cells.write.format("noop").mode("overwrite").save()
    read = cells._jdf.queryExecution().executedPlan().toString()
    assert "_metadata" in read or "file_path" in read
    assert read_raster_folder(spark, str(tmp_path), "tmax.", schema).select("ymd").distinct().count() == 4
    assert files_read(cells) == 2


def files_read(df):
    """Number of files that the scan of a plan has opened."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    plan = execution.executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().get("numFiles").get().value()


def test_product_keeps_its_layout_and_rewrites_one_wave(spark):
    tag, path = f"product_{uuid.uuid4().hex}", scratch_path(spark, "product")
    rows = [(f"c{k % 3}", f"u{k % 7}", w, float(k)) for k in range(42) for w in (1, 2, 3)]
    df = spark.createDataFrame(rows, "NAME_0 string, NAME_1 string, wave int, v double")
    keys = ["NAME_0", "NAME_1"]
    files.save_product(df, tag, path, keys, "wave", 4)
    files.save_product(df.where("wave = 2").withColumn("v", F.col("v") + 1000), tag, path, keys, "wave", 4)
    table = spark.table(tag)
    assert {r["wave"]: r["s"] for r in table.groupBy("wave").agg(F.sum("v").alias("s")).collect()} == {1: 861.0, 2: 861.0 + 42_000, 3: 861.0}
    ranked = table.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("v")))
    joined = ranked.join(table.groupBy(*keys).agg(F.max("v").alias("top")), keys)
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 126
    spark.sql(f"DROP TABLE {tag}")
    again = files.open_product(spark, tag, path, "NAME_0 string, NAME_1 string, v double, wave int", keys, "wave", 4)
    assert again.count() == 126 and "Exchange" not in again.groupBy(*keys).count()._jdf.queryExecution().executedPlan().toString()


def test_table_round_trip(spark):
    path = scratch_path(spark, "t")
    df = spark.createDataFrame([("A", 1), ("B", 2)], "NAME_0 string, v int")
    files.save_table(df, path, ["NAME_0"])
    files.save_table(df, path, ["NAME_0"])
    back = files.load_table(spark, path)
    assert sorted(map(tuple, back.select("NAME_0", "v").collect())) == [("A", 1), ("B", 2)]


def test_written_observes(spark):
    df, seen = written(spark.range(10), "w", n=F.count(F.lit(1)), top=F.max("id"))
    assert seen == {"n": 10, "top": 9} and df.count() == 10


def test_shared_root_follows_the_session(spark):
    class Context:
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder + "/made-by-spark"

    class Session:
        sparkContext = Context()
        conf = {"spark.checkpoint.dir": "hdfs://shared/scratch/"}

    # The folder the cluster names wins; only without one is a temporary folder made.
    assert shared_root(Session()) == "hdfs://shared/scratch"
    assert Session.sparkContext.folder == "hdfs://shared/scratch//made-by-spark"
    assert scratch_path(Session(), "x").startswith("hdfs://shared/scratch/x-")
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_root(spark) == (named or spark.sparkContext.getCheckpointDir()).rstrip("/")


def test_survey_selection(spark):
    catalog = spark.createDataFrame(
        [("K1", "K", "DHS", "PR", 2004), ("K2", "K", "DHS", "PR", 2016), ("N1", "N", "MIS", "PR", 2010)],
        "SurveyId string, country string, surveyType string, fileType string, surveyYear int",
    )
    data = spark.createDataFrame([("K1", 1, 2, 9), ("K2", 1, 1, 9)], "SurveyId string, CLUSTER int, hc27 int, other int")
    chosen = choose_surveys(catalog, ["K", "N"], "DHS", "PR", 2004, 2015)
    got = load_chosen(data, chosen, ["CLUSTER", "hc27", "absent"], {"hc27": {2: "female"}})
    assert [tuple(r) for r in got.collect()] == [("K1", 1, "female")]
    clusters = spark.createDataFrame([("K1", 1, 3.0, 4.0), ("K2", 1, 5.0, 6.0)], "SurveyId string, CLUSTER int, LONGNUM double, LATNUM double")
    assert attach_coordinates(got, clusters).first()["LONGNUM"] == 3.0


def test_missing_file_fails(spark, tmp_path):
    with pytest.raises(Exception):
        files.load_table(spark, str(tmp_path / "nothing")).count()
