from pathlib import PurePosixPath

from pyspark.sql import functions as F

from reviewlake.functions import fixed, lang


def _one(spark, rows, schema, expr):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r["o"] for r in frame.select("i", expr.alias("o")).orderBy("i").collect()]


def test_normalize(spark):
    got = _one(spark, [(" Py",), ("C++",), ("HXX\n",), ("",), (None,), ("  ",), ("Go",)], "v string",
               lang.normalize_language(F.col("v")))
    assert got == ["python", "cpp", "cpp", None, None, "", "go"]


def test_filename_needs_a_dot(spark):
    got = _one(spark, [("a.PY",), ("py",), ("a.tar.h",), (".c",), ("a.hxx",), (None,), ("a.",)],
               "v string", lang.language_from_filename(F.col("v")))
    assert got == ["python", None, "cpp", "cpp", None, None, None]


def test_path_suffix_follows_path_rules(spark):
    paths = ["a/b.py", ".py", "a/.java", "x.d/file", "a.hxx", "a.CPP", "a.", "..c", "a.b.cc", "", "a/",
             "b.java/", "x.py/.", "/", "a.c#row1"]
    want = [fixed.CLEAN_EXTENSIONS.get(PurePosixPath(p).suffix.lower()[1:]) for p in paths]
    assert _one(spark, [(p,) for p in paths], "v string", lang.language_from_path(F.col("v"))) == want


def test_resolvers_differ(spark):
    rows = [("java", "x.py", "import java.util"), ("java", None, ""), ("go", "x.hxx", "std::x"),
            (None, None, "PUBLIC  CLASS A"), (None, "x.md", "text"), ("hxx", ".c", "")]
    got = _one(spark, rows, "l string, f string, c string",
               lang.resolve_review_language(F.col("l"), F.col("f"), F.col("c")))
    assert got == ["python", "java", "cpp", "java", "python", "cpp"]
    got = _one(spark, [("go", "a.hxx"), ("cc", "a.py"), ("go", "a.txt"), ("", "a.java")],
               "l string, p string", lang.resolve_row_language(F.col("l"), F.col("p")))
    assert got == ["cpp", "cpp", None, "java"]


def test_upload_maps(spark):
    rows = [("a.hpp", "C++"), ("a.CC", "Java"), ("noext", "Java"), ("py", "Go"), ("x.ts", "Go")]
    frame = [("cpp", "python", "plaintext"), ("cpp", "cpp", "plaintext"),
             ("java", "python", "plaintext"), ("python", "python", "python"),
             ("python", "python", "typescript")]
    got = _one(spark, rows, "f string, c string", F.struct(
        lang.upload_language(F.col("f"), F.col("c")), lang.dashboard_review_language(F.col("f")),
        lang.dashboard_display_language(F.col("f"))))
    assert [tuple(r) for r in got] == frame
