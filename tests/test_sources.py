from pyspark.sql import types as T

from glintspan.sources import files, ingest


def test_manifest_and_versions(spark, tmp_path):
    for n in ("12_r1_TrialInfo.csv", "12_r1_TrialInfo_2.csv", "13_p2_AllGazeData.csv", "notes.csv"):
        (tmp_path / n).write_text("a,b\n1,2\n")
    m = files.manifest(spark, str(tmp_path))
    assert sorted((r.pid, r.phase, r.block, r.kind) for r in m.collect()) == [("12", "r", 1, "TrialInfo"), ("12", "r", 1, "TrialInfo"), ("13", "p", 2, "AllGazeData")]
    assert sorted(r.name for r in files.resolve_versions(m).collect()) == ["12_r1_TrialInfo", "13_p2_AllGazeData"]
    assert [r.name for r in files.resolve_versions(m, "skip_participant").collect()] == ["13_p2_AllGazeData"]


def test_positional_csv_ignores_header_names(spark, tmp_path):
    (tmp_path / "x.csv").write_text("foo,bar\n1,2.5\n3,\n")
    schema = T.StructType([T.StructField("t", T.LongType()), T.StructField("v", T.DoubleType())])
    assert [tuple(r) for r in files.positional_csv(spark, str(tmp_path / "x.csv"), schema).orderBy("t").collect()] == [(1, 2.5), (3, None)]


def test_event_log_and_scores(spark, tmp_path):
    (tmp_path / "log.csv").write_text("Unity time,frame,event,more\n1.5,10,start,x\n2.5,20,end,y\n")
    assert [tuple(r) for r in files.event_log(spark, str(tmp_path / "log.csv")).orderBy("frame").collect()] == [(1.5, 10, "start"), (2.5, 20, "end")]
    (tmp_path / "s.txt").write_text("h\n" * 14 + "1\t\tA\t3.2\tCORRECT\n2\t9.9\n3\tB\t1.0\tINCORRECT\n")
    got = [(r.item, r.selection, r.rt, r.score) for r in files.score_text(spark, str(tmp_path / "s.txt")).orderBy("item").collect()]
    assert got == [("1", "A", 3.2, "CORRECT"), ("2", "TIMED", 9.9, "INCORRECT"), ("3", "B", 1.0, "INCORRECT")]


def test_append_new_and_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert files.append_new(spark, a, path, "k").count() == 2
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    files.append_new(spark, b, path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "x"), (2, "y"), (3, "w")]
    assert sorted(map(tuple, files.upsert(a, b, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]


def test_retrieval_rows(spark):
    samples = spark.createDataFrame([("a", 5, 1)], "k string, frame long, ViewNo int")
    session = spark.createDataFrame([("a", f, 0) for f in range(10)], "k string, frame long, ViewNo int")
    events = spark.createDataFrame([("a", 4, "up"), ("a", 7, "answered"), ("a", 9, "up")], "k string, frame long, event string")
    out = ingest.retrieval_rows(samples, session.drop("ViewNo"), events, ["k"], "frame", "up", "answered", 2)
    assert sorted((r.frame, r.ViewNo) for r in out.collect()) == [(4, 3), (5, 1), (6, 3)]
