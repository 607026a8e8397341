from kgloom.streaming.windows import change_counts, closed_windows
from tests.conftest import rows


def test_windows_close_across_batches(spark, tmp_path):
    kind = "pid long, rid long, ts long, ok boolean, triples array<struct<head:string,rel:string,tail:string>>"
    batches = [
        [(1, 1, 10, True, [("s", "p", "a"), ("s", "p", "b")]), (2, 5, 11, True, [("z", "p", "c")])],
        [(1, 3, 30, True, [("s", "p", "a")]), (1, 2, 20, False, None)],
        [(1, 4, 40, True, []), (2, 6, 50, True, [("z", "p", "c")]), (1, 9, 5, True, [("s", "p", "old")])],
    ]
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, kind).coalesce(1).write.mode("append").parquet(source)
        q = closed_windows(spark.readStream.schema(kind).parquet(source)).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(out)
        q.awaitTermination(120)
    assert rows(spark.read.parquet(out)) == [("s", "p", "a", "1", "4", 10, 40), ("s", "p", "b", "1", "3", 10, 30)]


def test_tumbling_counts(spark):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,id*20,0) as event_time, 'r' as rel from range(6)")
    assert [r.changes for r in change_counts(df).orderBy("start").collect()] == [3, 3]
