import csv
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reviewlake.plans import inputs
from reviewlake.sources import corpus as readers
from reviewlake.sources import sinks


def test_jsonl(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.jsonl").write_text('{"code": "é\\nb", "language": "py", "other": 1}\n')
    (tmp_path / "a.jsonl").write_text('{"repo": "r", "path": null}\n')
    (tmp_path / "a.json").write_text("not read")
    rows = readers.read_corpus(spark, str(tmp_path)).orderBy("code").collect()
    assert [r.asDict() for r in rows] == [
        {"code": "", "docstring": "", "repo": "r", "path": "", "language": ""},
        {"code": "é\nb", "docstring": "", "repo": "", "path": "", "language": "py"}]


def test_broken_jsonl_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"code": "x"}\n{"code": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(tmp_path)).collect()


def test_source_files(spark, tmp_path):
    (tmp_path / "a.cpp").write_bytes(b"int a;\r\n\xff\xfe// \xef\xbf\xbd \xc3\xa9\r")
    (tmp_path / "b.hxx").write_bytes(b"b")
    (tmp_path / "c.java").write_bytes(b"class C {}")
    rows = readers.read_source_files(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.code, r.path, r.language) for r in rows] == [
        ("int a;\n// � é\n", f"{tmp_path}/a.cpp", "cpp"), ("b", f"{tmp_path}/b.hxx", "cpp")]


def test_java_csv(spark, tmp_path):
    with open(tmp_path / "a.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["id", " SCode ", "content"])
        w.writerow([1, 'class A {\n  String s = "x, \\"y";\n}', "no"])
        w.writerow([2, "  ", "no"])
        w.writerow([3, "class B {}", ""])
    with open(tmp_path / "b.csv", "w", newline="") as f:
        csv.writer(f).writerows([["Content", "z"], ["class C {}", 1]])
    with open(tmp_path / "c.csv", "w", newline="") as f:
        csv.writer(f).writerows([["a", "b"], ["class D {}", 1]])
    rows = readers.read_java_csv(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.code, r.path) for r in rows] == [
        ('class A {\n  String s = "x, \\"y";\n}', f"{tmp_path}/a.csv#row1"),
        ("class B {}", f"{tmp_path}/a.csv#row3"), ("class C {}", f"{tmp_path}/b.csv#row1")]


def test_caps_follow_format_and_file_order(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.jsonl").write_text(
            "".join(json.dumps({"code": f"{name}{i}"}) + "\n" for i in range(3)))
        (tmp_path / f"{name}.cpp").write_text(f"{name}.cpp")

    def codes(**caps):
        return sorted(r.code for r in readers.read_corpus(spark, str(tmp_path), **caps).collect())

    assert codes(max_files=2) == ["a.cpp", "a0", "a1", "a2", "b.cpp", "b0", "b1", "b2"]
    assert codes(max_rows=5) == ["a0", "a1", "a2", "b0", "b1"]
    assert codes(max_rows=10) == sorted([f"{n}{i}" for n in "abc" for i in range(3)] + ["a.cpp"])
    assert codes(max_files=1, max_rows=4) == ["a.cpp", "a0", "a1", "a2"]
    assert len(codes()) == 12


def test_labeled_samples(spark, tmp_path):
    objs = [
        {"code": "a", "bug_risk": 1, "label": 0}, {"code": "", "func_code_string": "b", "label": "1"},
        {"code": "c", "bug_risk": None, "label": 1}, {"code": "d", "label": "x"},
        {"whole_func_string": "e", "label": 1.9}, {"code": "f", "label": "1.5"},
        {"code": "g", "label": False}, {"label": 1}, {"code": "h", "label": [1]},
        {"code": "i", "label": " -1_0 "},
    ]
    one, two = tmp_path / "one.jsonl", tmp_path / "two.jsonl"
    one.write_text("\n".join(map(json.dumps, objs)) + "\n\n{broken\n")
    two.write_text(json.dumps({"code": "z", "bug_risk": 0}) + "\n")
    rows = readers.read_labeled(spark, [str(two), str(one)]).orderBy("fmt", "seq").collect()
    assert [(r.code, r.label) for r in rows] == [
        ("z", 0), ("a", 1), ("b", 1), ("e", 1), ("g", 0), ("i", -10)]
    capped = readers.read_labeled(spark, [str(one), str(two)], max_samples=2).collect()
    assert sorted(r.code for r in capped) == ["a", "b"]


def test_unlabeled_samples(spark, tmp_path):
    (tmp_path / "x").write_text("\n".join(json.dumps({"code": "y" * n}) for n in (20, 21, 30)))
    rows = readers.read_unlabeled(spark, [str(tmp_path / "x")]).collect()
    assert sorted(len(r.code) for r in rows) == [21, 30]


def test_result_json_round_trip(spark):
    rows = spark.sql("""
        select 12.5d confidence, false syntax_error, cast(null as int) error_line, '' error_msg,
          array(named_struct('name', 'a "q"', 'line', 3, 'fix', 'x\\ny — é')) issues, 2 complexity
        union all select 95d, true, 4, 'bad', cast(array() as array<struct<name:string,line:int,
          fix:string>>), 1""")
    packed = rows.select(sinks.result_json(*[F.col(c) for c in rows.columns]).alias("j"), "*")
    first = packed.filter("complexity = 2").first()
    assert json.loads(first.j) == {
        "confidence": 12.5, "syntax_error": False, "error_line": None, "error_msg": "",
        "issues": [['a "q"', 3, "x\ny — é"]], "complexity": 2}
    for r in packed.select("*", sinks.parse_result(F.col("j")).alias("back")).collect():
        back = r.back.asDict(recursive=True)
        assert back == {c: r.asDict(recursive=True)[c] for c in rows.columns}
    assert spark.sql("select '' j").select(sinks.parse_result(F.col("j"))).first()[0] is None


def test_compiler_logs(spark):
    cpp = ("a.cpp:3:5: error: expected ';'\na.cpp:4:1: warning: unused variable 'x'\n"
           "a.cpp: In function 'f':\na.cpp:5:1: note: here\na.cpp:6:2: warning:  late  \r\n")
    java = "A.java:7: error: cannot find symbol\nA.java:8: warning: unused variable\n1 error\n"
    logs = spark.createDataFrame([(1, "cpp", cpp), (2, "java", java), (3, "python", cpp)],
                                 "snippet_id long, language string, log string")
    rows = readers.compiler_issues(logs).orderBy("snippet_id", "o1").collect()
    assert [(r.snippet_id, r.name, r.line, r.fix) for r in rows] == [
        (1, "Compiler Error", 3, "expected ';'"), (1, "Compiler Warning", 6, "late"),
        (2, "Compiler Error", 7, "cannot find symbol"), (2, "Compiler Warning", 8, "unused variable")]


# ---- history ------------------------------------------------------------------------

def _records(spark, ids, note):
    return spark.createDataFrame([(i, i % 5, note, "a.py", "", datetime(2024, 1, 1 + i % 20)) for i in ids],
                                 "review_id int, user_id long, code string, filename string, result string, created_at timestamp")


def _stored(spark, folder, **user):
    return sorted((r.review_id, r.code) for r in sinks.read_reviews(spark, folder, **user).collect())


def test_history_shows_whole_batches_only(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "history")
    assert _stored(spark, folder) == []
    sinks.write_records(_records(spark, range(6), "first"), folder, "run", 0)
    sinks.write_records(_records(spark, range(6, 9), "first"), folder, "run", 1)
    whole = [(i, "first") for i in range(9)]
    assert _stored(spark, folder) == whole
    # a writer that stops before its commit leaves nothing to see, and takes nothing away
    monkeypatch.setattr(sinks, "_commit", lambda *_: None)
    sinks.write_records(_records(spark, range(4), "again"), folder, "run", 0)
    sinks.write_records(_records(spark, range(90, 95), "lost"), folder, "run", 2)
    assert _stored(spark, folder) == whole
    monkeypatch.undo()
    # a reader that has begun keeps its rows
    begun = sinks.read_reviews(spark, folder)
    sinks.write_records(_records(spark, range(4), "again"), folder, "run", 0)
    assert sorted((r.review_id, r.code) for r in begun.collect()) == whole
    after = [(i, "again") for i in range(4)] + [(i, "first") for i in range(6, 9)]
    assert _stored(spark, folder) == after
    sinks.write_records(_records(spark, [50], "other"), folder, "other", 0)
    assert _stored(spark, folder) == [*after, (50, "other")]


def test_compaction_keeps_batches_replaceable(spark, tmp_path):
    folder = str(tmp_path / "history")
    assert sinks.compact(spark, folder) == 0
    for batch in range(4):
        sinks.write_records(_records(spark, range(10 * batch, 10 * batch + 10), "first"), folder, "run", batch)
    before = _stored(spark, folder)
    assert sinks.compact(spark, folder) == 4 and _stored(spark, folder) == before
    versions = {r.version for r in sinks.committed(spark, folder).collect()}
    assert len(versions) == 1
    sinks.write_records(_records(spark, [10, 11], "again"), folder, "run", 1)
    want = sorted([r for r in before if not 10 <= r[0] < 20] + [(10, "again"), (11, "again")])
    assert _stored(spark, folder) == want
    sinks.write_records(_records(spark, [], "none"), folder, "run", 2)
    assert sinks.compact(spark, folder) == 4
    assert _stored(spark, folder) == [r for r in want if not 20 <= r[0] < 30]


def test_compaction_does_not_undo_a_later_write(spark, tmp_path, monkeypatch):
    """A batch that is written again while a compaction runs wins, whichever commits first."""
    folder = str(tmp_path / "history")
    sinks.write_records(_records(spark, [1], "first"), folder, "run", 0)
    commit = sinks._commit

    def late(entries, where):
        monkeypatch.setattr(sinks, "_commit", commit)
        sinks.write_records(_records(spark, [1], "again"), folder, "run", 0)
        commit(entries, where)

    monkeypatch.setattr(sinks, "_commit", late)
    sinks.compact(spark, folder)
    assert _stored(spark, folder) == [(1, "again")]


def test_one_user_reads_one_bucket(spark, tmp_path):
    folder = str(tmp_path / "history")
    sinks.write_records(_records(spark, range(40), "x"), folder, "run", 0)
    rows = sinks.read_reviews(spark, folder, user_id=3)
    assert sorted(r.review_id for r in rows.collect()) == list(range(3, 40, 5))
    plan = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    bucket = spark.range(1).select(sinks.user_bucket(F.lit(3))).first()[0]
    assert f"(bucket#" in plan and f"= {bucket})" in plan.split("PartitionFilters:")[1].split("\n")[0]


def test_written_source_files_share_folders(spark, tmp_path):
    codes = {i: f"int f{i}();\r\n\n" + "x" * (i % 2) for i in range(300)}
    rows = spark.createDataFrame(list(codes.items()), "snippet_id long, code string").repartition(3)
    inputs.write_source_tree(rows, f"file://{tmp_path}/tree")
    assert {p.stem: p.read_bytes().decode() for p in (tmp_path / "tree").rglob("*.cpp")} == {
        f"snippet_id={i}": c for i, c in codes.items()}
    assert sum(p.is_dir() for p in (tmp_path / "tree").rglob("*")) <= inputs.SOURCE_FOLDERS
    got = readers.read_source_files(spark, f"{tmp_path}/tree").select(
        F.regexp_extract("path", r"snippet_id=(\d+)", 1).cast("long"), "code").collect()
    assert dict(map(tuple, got)) == {i: c.replace("\r\n", "\n") for i, c in codes.items()}


def test_source_files_in_a_store_that_arrow_does_not_know(spark, tmp_path):
    rows = spark.createDataFrame([(1, "int a;\n"), (2, "int b;\nint c;\n")], "snippet_id long, code string")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.trees.link./in", f"file://{tmp_path}")
    inputs.write_source_tree(rows, "viewfs://trees/in/tree")
    got = readers.read_source_files(spark, "viewfs://trees/in/tree").collect()
    assert sorted(r.code for r in got) == ["int a;\n", "int b;\nint c;\n"]


def test_no_reader_lists_the_source_tree_on_the_driver(spark, tmp_path):
    """Plans name the few files that a reader of Spark's gets, and none of the source files; what is read is what Spark would."""
    (tmp_path / "part=0" / "deep").mkdir(parents=True)
    (tmp_path / "_hidden").mkdir()
    for i in range(40):
        (tmp_path / "part=0" / f"f {i}.cpp").write_text(f"int v{i};\n")
    for name, text in (("part=0/deep/a.h", "int h;"), ("part=0/empty.c", ""), (".x.cpp", "int x;"), ("_hidden/y.cpp", "int y;"),
                       ("part=0/z.txt", "z"), ("p.jsonl", '{"code": "p"}\n'), ("part=0/q[1].jsonl", '{"code": "q"}\n')):
        (tmp_path / name).write_text(text)
    rows = readers.read_corpus(spark, str(tmp_path))
    assert "binaryFile" not in rows._jdf.queryExecution().toString()
    found = {r.path: r.code for r in rows.collect() if r.path}
    assert found == {f"{tmp_path}/part=0/{n}": t for n, t in [*[(f"f {i}.cpp", f"int v{i};\n") for i in range(40)], ("deep/a.h", "int h;")]}
    assert sorted(r.code for r in rows.filter("path = ''").collect()) == ["p", "q"]
    (tmp_path / "part=0" / "q[1].jsonl").rename(tmp_path / "part=0" / "q.jsonl")
    again = readers.read_jsonl(spark, str(tmp_path), listing=readers._listing(spark, str(tmp_path)))
    assert len(again.inputFiles()) == 2 and again.count() == 2


def test_many_small_source_files_share_tasks(spark, tmp_path):
    most = readers.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    texts = {f"f{i}.cpp": f"int v{i};\n" for i in range(most + 40)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        rows = readers.read_source_files(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() <= most
        assert {r.path.rsplit("/", 1)[1]: r.code for r in rows.collect()} == texts
        assert readers.read_source_files(spark, str(tmp_path), max_files=3).count() == 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
