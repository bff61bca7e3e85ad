import json
from datetime import datetime

from pyspark.sql import functions as F

from reviewlake.plans import review as review_plan
from reviewlake.sources import sinks
from reviewlake.streaming.review_stream import read_requests, start_review_stream


def _drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_reviews_are_appended_batch_by_batch(spark, tmp_path):
    incoming, history = tmp_path / "in", str(tmp_path / "history")
    at = "2024-01-01T00:00:00.000Z"
    _drop(incoming, "1.json", [
        {"snippet_id": 1, "user_id": 7, "code": "x = 1 / 0\n", "created_at": at},
        {"snippet_id": 2, "user_id": 7, "code": "int f() {\n}\n", "filename": "a.c", "created_at": at}])

    def run():
        start_review_stream(read_requests(spark, str(incoming)), history,
                            str(tmp_path / "checkpoint")).awaitTermination()
        rows = sinks.read_reviews(spark, history).withColumn(
            "result", sinks.parse_result(F.col("result"))).orderBy("review_id").collect()
        return {r.review_id: r for r in rows}

    first = run()
    assert set(first) == {1, 2}
    assert first[1].filename == "untitled.py" and first[1].user_id == 7
    assert first[1].created_at == datetime(2024, 1, 1)
    assert [i.name for i in first[1].result.issues] == ["Division by zero", "Unused variable"]
    assert [i.name for i in first[2].result.issues] == [
        "Function may exit without returning a value"]
    _drop(incoming, "2.json", [{"snippet_id": 3, "user_id": 8, "code": "def f(:\n", "created_at": at}])
    second = run()
    assert set(second) == {1, 2, 3}
    assert second[3].result.syntax_error and second[3].result.error_line == 1
    assert set(run()) == {1, 2, 3}


def test_copies_of_earlier_batches_are_not_parsed_again(spark, tmp_path, monkeypatch):
    incoming, history, checkpoint = tmp_path / "in", str(tmp_path / "history"), str(tmp_path / "checkpoint")
    at = "2024-01-01T00:00:00.000Z"
    codes = ["x = 1 / 0\n", "def f(:\n", "int f() {\n}\n", None]
    _drop(incoming, "1.json", [{"snippet_id": i, "user_id": 1, "code": c, "filename": "a.c" if i == 2 else None, "created_at": at}
                               for i, c in enumerate(codes)])
    parsed = []
    tables = review_plan.ReviewTables

    def counted(snippets):
        parsed.append(snippets.count())
        return tables(snippets)

    monkeypatch.setattr(review_plan, "ReviewTables", counted)

    def run(**keep):
        start_review_stream(read_requests(spark, str(incoming)), history, checkpoint, **keep).awaitTermination()
        return {r.review_id: (r.code, r.result) for r in sinks.read_reviews(spark, history).collect()}

    first = run()
    assert parsed == [4] and len(first) == 4
    _drop(incoming, "2.json", [{"snippet_id": 10 + i, "user_id": 2, "code": c, "filename": "a.c" if i == 2 else None,
                                "created_at": at} for i, c in enumerate(codes)])
    second = run()
    assert parsed == [4, 0]
    assert {i: second[i + 10] for i in range(4)} == first and {i: second[i] for i in range(4)} == first
    # the same text in another language is another text, and what is too old is reviewed anew
    _drop(incoming, "3.json", [{"snippet_id": 20, "user_id": 2, "code": codes[2], "filename": "a.java", "created_at": at}])
    run()
    assert parsed == [4, 0, 1]
    _drop(incoming, "4.json", [{"snippet_id": 30, "user_id": 2, "code": codes[0], "created_at": at}])
    fourth = run(keep_days=0.0)
    assert parsed == [4, 0, 1, 1] and fourth[30] == first[0]


def test_the_newest_of_several_results_is_recalled(spark, tmp_path):
    folder = str(tmp_path / "memory")
    asked = spark.createDataFrame([("h", "python"), ("other", "python")], "code_hash string, review_language string")
    assert sinks.recall(asked, folder).collect() == []

    def result(confidence):
        return spark.sql(f"""select 'h' code_hash, 'python' review_language, {confidence}d confidence, false syntax_error,
            cast(null as int) error_line, '' error_msg, cast(array() as array<struct<name:string,line:int,fix:string>>) issues,
            1 complexity""")

    for batch, confidence in ((0, 10.5), (1, 20.25)):
        sinks.remember(result(confidence), folder, "run", batch)
    assert [r.confidence for r in sinks.recall(asked, folder).collect()] == [20.25]
    sinks.remember(result(30.0), folder, "run", 1)
    assert [r.confidence for r in sinks.recall(asked, folder).collect()] == [30.0]
