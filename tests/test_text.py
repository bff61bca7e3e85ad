import random

from pyspark.sql import functions as F

from reviewlake.functions import text

BREAKS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]


def _texts(n, alphabet, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(size))) for _ in range(n)]


def _apply(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_lines_are_split_as_python_does(spark):
    values = ["", "\n", "a\n", "a\n\n", *_texts(300, [*BREAKS, "a", "é", " "], 12, 1)]
    assert _apply(spark, values, text.split_lines) == [v.splitlines() for v in values]
    assert _apply(spark, values, text.line_count) == [len(v.splitlines()) for v in values]


def test_strip_takes_all_white_space(spark):
    values = _texts(300, [*BREAKS, "\t", " ", "\xa0", "　", "\x1f", "x", "​"], 8, 2)
    assert _apply(spark, values, text.strip) == [v.strip() for v in values]


def test_block_comments_go_with_their_line_ends(spark):
    got = _apply(spark, ["a /* x\ny */ b\nc // d\ne", 'u = "http://x";\n', "/* open\n", "/**/a//"],
                 text.strip_c_comments)
    assert got == ["a  b\nc \ne", 'u = "http:\n', "/* open\n", "a"]


def _blank(line):
    out, quote, skip = [], None, False
    for ch in line:
        if skip:
            skip = False
        elif quote is None:
            out.append(ch)
            quote = ch if ch in "\"'" else None
        elif ch == "\\":
            skip = True
        elif ch == quote:
            out.append(ch)
            quote = None
    return "".join(out)


def test_quoted_text_is_blanked(spark):
    values = _texts(500, ['"', "'", "\\", "a", " "], 12, 3)
    assert _apply(spark, values, text.blank_strings) == [_blank(v) for v in values]


def test_word_classes_are_unicode(spark):
    got = _apply(spark, ["é(", "(", " ("], lambda c: text.has(c, r"\w\("))
    assert got == [True, False, False]
    assert _apply(spark, ["if (x"], lambda c: text.has(c, r"\bif\s*\(")) == [True]
    # Only \n ends a line for ^, $ and the dot.
    assert _apply(spark, ["a\rb"], lambda c: text.has(c, r"^a.b$")) == [True]


def test_long_literals_do_not_overflow_the_stack(spark):
    long = '"' + "a\\n" * 200000 + '"'
    assert _apply(spark, [long], text.blank_strings) == ['""']


def test_fix_text_is_filled(spark):
    got = _apply(spark, ["v"], lambda c: text.issue_fix("PY-26", c, F.lit("run")))
    assert got == ["'v' was assigned None but '.run' is accessed on it without a None check. "
                   "Add: if {node.value.id} is not None: ..."]
