import json

import pytest
from pyspark.sql import functions as F

from voxtab.plans import pipeline as PL
from voxtab.plans.pipeline import analyse
from voxtab.sources import catalog as K
from voxtab.sources import csv as V
from voxtab.streaming import streams as ST


def write(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return [tuple(r)[1:] for r in df.orderBy("row_id").collect()]


BODY = "".join(f"{i},fine remark {i}\n" for i in range(12))


def test_csv_details(spark, tmp_path):
    path = write(tmp_path, 'id,text,text\n1,"He said ""no"", twice\nand left",x\n2,NA,n/a\n'
                           '3,too,many,cells\n4,short\n5,None,Never\n')
    df = V.read_feedback_csv(spark, path, min_rows=None)
    assert df.columns == ["row_id", "id", "text", "text.1"]
    assert rows(df) == [("1", 'He said "no", twice\nand left', "x"), ("2", None, None),
                        ("4", "short", None), ("5", None, "Never")]


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_delimiters(spark, tmp_path, sep):
    df = V.read_feedback_csv(spark, write(tmp_path, "id,text\n".replace(",", sep)
                                          + BODY.replace(",", sep)))
    assert df.columns == ["row_id", "id", "text"] and df.count() == 12
    assert rows(df)[3] == ("3", "fine remark 3")


def test_comma_first_and_single_column(spark, tmp_path):
    assert V.sniff_delimiter("a;b,c") == "," and V.sniff_delimiter("only") == ","
    assert V.column_names("a,,a,a", ",") == ["a", "Unnamed: 1", "a.1", "a.2"]
    text = "comment\n" + "".join(f'"one; two {i}"\n' for i in range(10))
    assert V.read_feedback_csv(spark, write(tmp_path, text)).columns == ["row_id", "comment"]


def test_gates(spark, tmp_path):
    path = write(tmp_path, "id,text\n1,a\n")
    with pytest.raises(ValueError, match="only 1 rows"):
        V.read_feedback_csv(spark, path)
    with pytest.raises(ValueError, match="Only CSV"):
        V.read_feedback_csv(spark, path.replace(".csv", ".CSV"))
    with pytest.raises(ValueError, match="no rows"):
        V.read_feedback_csv(spark, write(tmp_path, "\n", "e.csv"))
    with pytest.raises(ValueError, match="maximum: 20"):
        V.check_rows(spark.range(30), 10, 20)
    V.check_rows(spark.range(20), 10, 20)
    with pytest.raises(ValueError, match="Column 'x' not found"):
        V.check_column(spark.range(1), "x")


def test_only_csv_files_of_a_folder(spark, tmp_path):
    write(tmp_path, "id,text\n" + BODY, "a.csv")
    write(tmp_path, "id,text\n" + BODY, "b.csv")
    write(tmp_path, "junk\njunk\n", "c.txt")
    df = V.read_feedback_csv(spark, str(tmp_path), multi_line=False)
    assert df.count() == 24 and df.select("row_id").distinct().count() == 24


def test_a_folder_of_different_files(spark, tmp_path):
    write(tmp_path, "id,text\n1,a\n2,b,c\n3,\"x\ny\"\n", "a.csv")
    write(tmp_path, "\ufeffid;mood;text\n4;good;\"p;q\"\n5;N/A;r\n6;;s;t\n", "b c.csv")
    write(tmp_path, "\n\ntext\tid\nz\t7\n", "c.csv")
    write(tmp_path, "text\nlone\n", "d.csv")
    write(tmp_path, "\n", "e.csv")
    table, lines = V.read_csv_folder(spark, str(tmp_path))
    got = {(r.id, r.text, r.mood) for r in table.collect()}
    assert got == {("1", "a", None), ("3", "x\ny", None), ("4", "p;q", "good"), ("5", "r", None), ("7", "z", None),
                   (None, "lone", None)}
    assert {(r.file.rsplit("/", 1)[1], r.rows, r.skipped) for r in lines.collect()} == {
        ("a.csv", 2, 1), ("b%20c.csv", 2, 1), ("c.csv", 1, 0), ("d.csv", 1, 0)}
    assert table.select("row_id").distinct().count() == 6
    with pytest.raises(ValueError, match="no rows"):
        (tmp_path / "none").mkdir()
        write(tmp_path / "none", "\n", "a.csv")
        V.read_csv_folder(spark, str(tmp_path / "none"))


def test_a_repeated_save_replaces(spark, tmp_path):
    folder = str(tmp_path / "up")
    K.save_upload(spark.range(3).toDF("n"), folder, "a")
    K.save_upload(spark.range(5).toDF("n"), folder, "b")
    for _ in range(2):
        K.save_upload(spark.range(10, 14).toDF("n"), folder, "a")
    assert sorted(r.n for r in K.load_upload(spark, folder, "a").collect()) == [10, 11, 12, 13]
    assert K.load_upload(spark, folder, "b").count() == 5


def test_uploads_and_reports(spark, tmp_path):
    df = spark.range(5).withColumn("t", F.concat(F.lit("row\n "), "id"))
    for name in ("u1", "u2"):
        K.save_upload(df, str(tmp_path / "up"), name)
    back = K.load_upload(spark, str(tmp_path / "up"), "u2")
    assert back.count() == 5
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(upload_id" in plan
    K.write_reports(df, str(tmp_path / "rep"), "id", "t")
    assert {r.t for r in spark.read.parquet(str(tmp_path / "rep")).collect()} == {
        f"row\n {i}" for i in range(5)}
    K.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 5
    assert json.loads(K.json_records(df).first().json) == {"id": 0, "t": "row\n 0"}


def test_preview(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(
        [1.0, float("nan"), float("inf"), float("-inf"), None, 2.0])], "id long, v double")
    assert [r.v for r in K.preview(df, "id").collect()] == [1.0, None, None, None, None]


TEXTS = [f"{m} thing number {i % 30} <b>!</b>" for i in range(60) for m in ("great", "awful", "ok")]


def test_stream_equals_batch(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "id long, text string"
    df = spark.createDataFrame(list(enumerate(TEXTS + ["BUY NOW", "", None])), schema)
    df.repartition(3).write.parquet(src)
    stream = ST.clean_and_score(spark.readStream.schema(schema).parquet(src), "text")
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    cols = ["id", "text", "sentiment.label", "emotion.emotion", "topics.primary_topic"]
    got = spark.read.parquet(str(tmp_path / "out")).select(cols)
    want = ST.clean_and_score(df, "text").select(cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() == len(TEXTS)


def test_stream_dedup_and_windows(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "ts timestamp, text string, label string"
    df = spark.range(48).select(
        F.timestamp_seconds(F.col("id") * 3600).alias("ts"),
        F.concat(F.lit("t"), F.col("id") % 5).alias("text"), F.lit("joy").alias("label"))
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)

    def run(out, name, mode):
        q = (out.writeStream.format("memory").queryName(name).outputMode(mode)
             .trigger(availableNow=True).start())
        q.awaitTermination(120)
        return spark.table(name)

    assert run(ST.drop_repeats(stream, "text", "ts", "3 days"), "dedup", "append").count() == 5
    counts = run(ST.label_counts(stream, "ts", "label", "1 day", delay="1 day"), "wins", "complete")
    batch = ST.label_counts(df, "ts", "label", "1 day")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, batch.collect()))


def test_pipeline_with_groups_and_gazetteer(spark):
    rows = [(i, ["a", None][i % 2], f"{'great' if i % 3 else 'terrible'} camera from Acme Corp, unit {i}")
            for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g string, text string")
    names = spark.createDataFrame([("Acme Corp", "ORG")], "name string, type string")
    a = analyse(df, "text", "id", ["g"], "marketing", names)
    assert {(r.g, r.text, r.type, r.cnt) for r in a.entities.collect()} == {
        ("a", "Acme Corp", "ORG", 20), (None, "Acme Corp", "ORG", 20)}
    assert a.verdict.count() == 2 and a.checks.count() == 10
    briefs = {r.g: r.brief for r in a.brief.collect()}
    assert "- Acme Corp (ORG): 20 mentions (" in briefs["a"]
    assert "MARKETING REPORT:" in briefs[None] and "## Important Keyphrases\n" in briefs[None]
    assert all(r.num_keyphrases > 0 for r in a.metadata.collect())


def test_pipeline_writes_kept_texts_once(spark, monkeypatch):
    staged, write = [], PL.written
    monkeypatch.setattr(PL, "written", lambda d: staged.append(d.columns) or write(d))
    df = spark.createDataFrame([(i, "a", f"great camera number {i % 4}") for i in range(6)], "id long, g string, body string")
    a = analyse(df, "body", "id", ["g"])
    assert sum("body" in columns for columns in staged) == 1
    want = [(i, "a", f"great camera number {i}") for i in range(4)]
    assert a.comments.columns == ["id", "g", "body"] and sorted(map(tuple, a.comments.collect())) == want
    assert sorted(map(tuple, a.scored.select("id", "g", "body").collect())) == want


def test_late_rows_and_state_over_stops(spark, tmp_path):
    """The watermark of earlier batches drops a late row and closes windows; the state of jobs goes on."""
    rows = [[(0, "a"), (5, "b")], [(30, "a")], [(3, "a"), (26, "b")], [(90, "a"), (40, "b")]]
    frames = [spark.createDataFrame(r, "h long, label string").select(
        F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "label") for r in rows]
    out = ST.feed(frames, lambda s: ST.label_counts(s, "ts", "label", "1 day", delay="2 hours"), str(tmp_path / "w"))
    got = {(r.window_start.day, r.label, r.cnt) for r in out.collect()}
    assert got == {(1, "a", 1), (1, "b", 1), (2, "a", 1), (2, "b", 2)}
    last = ST.feed(frames, lambda s: s.groupBy("label").agg(F.max("ts").alias("ts"), F.count("*").alias("n")),
                   str(tmp_path / "c"), "complete")
    assert {(r.label, r.n) for r in last.collect()} == {("a", 4), ("b", 3)}
