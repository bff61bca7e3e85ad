import ast

from oracles import golden
from reviewlake.operators import features
from reviewlake.operators.nodes import node_rows, node_table, parse_status
from reviewlake.operators.rules_python import python_issues
from reviewlake.plans.corpus import TEMPLATES
from tests.conftest import code_frame


def _issues(spark, codes):
    out = [set() for _ in codes]
    for r in python_issues(node_table(code_frame(spark, codes, "python"))).collect():
        out[r.snippet_id].add((r.rule, r.line))
    return out


def test_every_snippet_has_its_expected_findings(spark):
    python = [t for t in range(len(TEMPLATES)) if t in golden.PYTHON_COUNTS]
    codes = [TEMPLATES[t][3].replace("@N", "77") for t in python]
    found = _issues(spark, codes)
    for t, got in zip(python, found):
        want = {(r, line) for tid, _, r, _, line, _ in golden.issue_rows()
                if tid == t and r.startswith("PY")}
        assert got == want, t


CASES = [
    # only the constant True makes an endless loop; break plays no part
    ("while 1:\n    pass\nwhile True:\n    break\n", {("PY-1", 3)}),
    # a false zero still divides; floor and remainder do not count
    ("a = 1 / False\nb = 1 / 0.0\nc = 1 // 0\nd = 1 % 0\ne = 1 / 0j\nprint(a, b, c, d, e)\n",
     {("PY-2", 1), ("PY-2", 2), ("PY-2", 5)}),
    # a while loop outside is no outer loop
    ("while a:\n    for x in y:\n        pass\nfor x in y:\n    while a:\n        pass\n",
     {("PY-5", 5)}),
    # the else part of a loop lies below it
    ("for x in y:\n    pass\nelse:\n    for z in y:\n        input()\n", {("PY-5", 4), ("PY-3", 5)}),
    # a return of an inner function counts for the outer one
    ("def f():\n    def g():\n        return 1\n    g()\n", set()),
    ("async def f():\n    pass\n", set()),
    # 0, 1 and their equals are taken for the singletons
    ("a is 0\na is 1.0\na is 2\na is not 'x'\na is None\na is ...\n",
     {("PY-13", 3), ("PY-13", 4), ("PY-13", 6)}),
    # the left-most operand is looked at for every operator
    ("1.5 == a == b\na == 2.5\na < 1.5\n", {("PY-14", 1), ("PY-14", 2)}),
    ("a == None != b\nNone == a\na == True\n", {("PY-12", 1), ("PY-21", 3)}),
    # keyword arguments count, star parameters end the check, the last definition wins
    ("def f(a):\n    return a\ndef f(a, b=1):\n    return a\nf()\nf(1, b=2)\nf(1, 2, c=3)\n"
     "def g(*a):\n    return a\ng()\ng(1, 2)\n", {("PY-9", 5), ("PY-9", 7)}),
    ("def f(a, *, b=[]):\n    return a\ndef g(a={}, b=()):\n    return a\ndef h(a=set()):\n"
     "    return a\n", {("PY-10", 1), ("PY-10", 3)}),
    ("def f():\n    return 1\n    return 2\ndef g():\n    if a:\n        return 1\n        x()\n"
     "    return 2\n", {("PY-16", 3)}),
    # only the first return of a finally part, breadth first
    ("try:\n    pass\nfinally:\n    if a:\n        return 1\n    return 2\n", {("PY-20", 6)}),
    ("try:\n    pass\nexcept* ValueError:\n    pass\n", set()),
    ("def f():\n    if a:\n        return 1\n    elif b:\n        x()\n    else:\n        y()\n",
     {("PY-17", 2)}),
    ("def f():\n    if a:\n        return\n    else:\n        x()\n", set()),
    ("def __init__(*, self):\n    return 1\ndef __eq__(self, o):\n    return 1\n", {("PY-22", 1)}),
    # a global statement counts at the top of the function only
    ("n = 0\ndef f():\n    if a:\n        global n\n        n = 1\n    return n\n", {("PY-23", 5)}),
    ("def f():\n    f = 1\n    return f\n", set()),
    # a reassignment clears None only if it is a plain name, breadth first
    ("a = None\na = b()\na.x\nc = None\nif q:\n    c = None\nc = d\nc.x\n",
     {("PY-26", 3), ("PY-26", 8)}),
    # arguments count as read, star arguments and lambda arguments do not
    ("def f(a, *b):\n    a = 1\n    b = 2\n    return 0\n", {("PY-25", 3)}),
    ("x: int\ny += 1\n(\n z) = 2\n_q = 1\na, b = 1, 2\n", {("PY-25", 1), ("PY-25", 2), ("PY-25", 3)}),
    # sums may start from any empty value
    ("s = ''\nf = False\nz = 0j\nn = None\nfor a, b in c:\n    s = a\n    f = b\n    z = z + a\n"
     "    n = a\n    a = b\nprint(s, f, z, n, a)\n", {("PY-8", 6), ("PY-8", 7)}),
    ("for q in qs:\n    qs.pop()\n    qs.sort()\n    other.pop()\nfor q in qs[:]:\n    qs.pop()\n",
     {("PY-18", 2), ("PY-4", 3)}),
    ("for i in a:\n    for i, j in b:\n        for j in c:\n            pass\n",
     {("PY-5", 2), ("PY-5", 3), ("PY-15", 2), ("PY-15", 3)}),
    ("while a:\n    if b:\n        continue\n        x()\n    break\n    y()\n", {("PY-24", 6)}),
]


def test_rules_case_by_case(spark):
    found = _issues(spark, [code for code, _ in CASES])
    for (code, want), got in zip(CASES, found):
        assert got == want, code


def test_nodes_follow_breadth_first_order():
    code = TEMPLATES[4][3].replace("@N", "1")
    marks = (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)
    walked = [n for n in ast.walk(ast.parse(code)) if not isinstance(n, marks)]
    for row in node_rows(0, code):
        node = walked[row["node"]]
        assert type(node).__name__ == row["type"]
        assert getattr(node, "lineno", None) == row["line"]


def test_unparsable_texts(spark):
    codes = ["x = (", "a\0b", "(" * 5000 + ")" * 5000, "x = 1", "-" * 200000 + "1", ""]
    rows = {r.snippet_id: r for r in
            parse_status(code_frame(spark, codes, "python")).collect()}
    assert [rows[i].parse_ok for i in range(len(codes))] == [False, False, False, True, False, True]
    table = node_table(code_frame(spark, codes, "python"))
    bad = {r.snippet_id: r.error_line for r in table.filter("not parse_ok").collect()}
    assert set(bad) == {0, 1, 2, 4} and bad[0] == 1


def test_features_of_unparsable_text(spark):
    rows = code_frame(spark, ["def f(:\n  sort.sort()\n"], "python")
    r = features.features_python(rows, node_table(rows)).first()
    assert (r.num_lines, r.num_funcs, r.sort_ops) == (2, 0, 1)
    r = features.rich_python(rows, node_table(rows)).first()
    assert (r.lines_of_code, r.cyclomatic_complexity) == (2, 0)


def test_long_and_huge_literals(spark):
    codes = [f"x = 0x{'f' * 5000}\nprint(x is 0x{'f' * 5000}, x is '{'s' * 100000}')\n"]
    assert _issues(spark, codes) == [{("PY-13", 2)}]
