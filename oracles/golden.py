"""Expected findings per corpus snippet, derived by hand from the rules.

Not taken from the engine's output. ``@N`` stands for the document's ``n_chars``
and ``@M`` for one less.
"""

from reviewlake.functions.issue_texts import ISSUE_TEXTS

CPP_KIND = "out-of-bounds error"
JAVA_KIND = "ArrayIndexOutOfBoundsException"


def _oob(name, size, idx, kind=CPP_KIND):
    top = "@M" if size == "@N" else int(size) - 1
    return (name, size, top, idx, kind)


# snippet -> (rule, line, values of the fix text), in the order a sequential
# review reports them
ISSUES = {
    0: [("PY-1", 1), ("PY-2", 2), ("PY-3", 3), ("PY-4", 4)],
    1: [("PY-5", 3), ("PY-6", 1), ("PY-15", 3, "i"), ("CJ-28", 0)],
    2: [("PY-7", 1), ("PY-9a", 7, "pair", 2, 1, 4), ("PY-9b", 8, "pair", 2, 3, 4),
        ("PY-9a", 9, "pair", 2, 1, 4), ("PY-10", 1, "walk")],
    3: [("PY-8", 6, "result"), ("PY-8", 8, "flag")],
    4: [("PY-11a", 1, "list"), ("PY-11b", 2, "max"), ("PY-11a", 14, "sum"),
        ("PY-11a", 15, "sum"), ("PY-12", 3), ("PY-13", 5, "5"), ("PY-13", 5, "'x'"),
        ("PY-14", 7), ("PY-21", 9, "if x:", "True"), ("PY-21", 9, "if not x:", "False"),
        ("PY-25", 14, "sum")],
    5: [("PY-16", 13, 12), ("PY-17", 2), ("PY-24", 11, "break", 10)],
    6: [("PY-18", 3, "remove", "queue"), ("PY-19", 7), ("PY-20", 10)],
    7: [("PY-6", 4), ("PY-22", 4, "__init__"), ("PY-22", 6, "__len__"),
        ("PY-23", 9, "counter", "bump"), ("PY-23", 10, "limit", "bump")],
    8: [("PY-25", 4, "size"), ("PY-26", 11, "other", "close"), ("PY-26", 12, "handle", "read")],
    14: [("PY-1", 8), ("PY-2", 10), ("PY-5", 6), ("PY-8", 4, "best"), ("PY-15", 6, "key"),
         ("PY-25", 1, "best"), ("PY-25", 10, "total"), ("CJ-28", 0)],
    15: [("CJ-1", 5), ("CJ-3", 6), ("CJ-10", 6), ("CJ-1", 9), ("CJ-2", 9), ("CJ-28", 0)],
    16: [("CJ-27", 4, *_oob("buf", 8, 8)), ("CJ-7", 5), ("CJ-12", 5), ("CJ-9", 6), ("CJ-6", 7),
         ("CJ-8", 9), ("CJ-12", 10)],
    17: [("CJ-11", 3), ("CJ-16", 4), ("CJ-20", 0), ("CJ-18", 0), ("CJ-21", 0), ("CJ-23", 0)],
    18: [("CJ-19", 3), ("CJ-19", 7), ("CJ-19", 12)],
    19: [("CJ-7", 1), ("CJ-25", 1), ("CJ-26", 1), ("CJ-25", 9), ("CJ-25", 17)],
    20: [("CJ-27", 3, *_oob("b", "@N", "@N")), ("CJ-27", 5, *_oob("c", 2, 2)),
         ("CJ-27", 6, *_oob("b", "@N", 999999999)), ("CJ-27", 8, *_oob("a", 5, 9)),
         ("CJ-27", 9, *_oob("a", 5, 5))],
    21: [("CJ-27", 4, *_oob("int", 4, 4)), ("CJ-27", 15, *_oob("p", 0, 0)), ("CJ-4", 6),
         ("CJ-4", 7), ("CJ-5", 8), ("CJ-5", 10), ("CJ-23", 0)],
    28: [("CJ-4", 6), ("CJ-14", 7), ("CJ-14", 8), ("CJ-5", 9)],
    29: [("CJ-27", 16, *_oob("xs", 2, 2, JAVA_KIND)), ("CJ-27", 16, *_oob("ys", 3, 3, JAVA_KIND)),
         ("CJ-13", 5), ("CJ-17", 6), ("CJ-17", 7), ("CJ-15", 11), ("CJ-21", 0), ("CJ-22", 0),
         ("CJ-24", 0), ("CJ-25", 3)],
    32: [("CJ-8", 3), ("CJ-2", 4)],
    33: [("CJ-19", 4), ("CJ-19", 6)],
    34: [("PY-25", 1, "x")],
    38: [("PY-6", 2)],
}

# snippet -> (line, message for C++ and Java)
SYNTAX_ERRORS = {
    10: (1, None), 11: (2, None), 40: (1, None),
    23: (3, "Unmatched ')' in code block"), 24: (2, "Unclosed string literal"),
    25: (1, "Unclosed '{' in code block"), 26: (2, "Unclosed character literal"),
    27: (5, "Unmatched '}' in code block"), 31: (1, "Unmatched '}' in code block"),
}

# Python snippets: functions, loops, ifs, tries (plain `def` and `for` only)
PYTHON_COUNTS = {
    0: (0, 1, 0, 0), 1: (1, 4, 0, 0), 2: (2, 0, 0, 0), 3: (1, 1, 0, 0), 4: (1, 0, 5, 0),
    5: (1, 1, 2, 0), 6: (1, 1, 0, 1), 7: (4, 0, 0, 0), 8: (1, 0, 0, 0), 9: (1, 0, 0, 0),
    10: (0, 0, 0, 0), 11: (0, 0, 0, 0), 12: (0, 0, 0, 1), 13: (1, 1, 1, 1), 14: (0, 3, 0, 0),
    34: (0, 0, 0, 0), 37: (0, 0, 0, 0), 38: (1, 1, 0, 0), 40: (0, 0, 0, 0),
}

# Python snippets: the nine richer features. Functions include async ones.
#   cyclomatic: 1 + branches + (operands of and/or - 1)
PYTHON_RICH = {
    0: (5, 0, 1, 2, 1, 0, 0.0, 0, 0),
    1: (7, 1, 2, 5, 4, 0, 7.0, 0, 0),
    2: (7, 2, 0, 1, 0, 0, 2.0, 1, 0),
    3: (9, 1, 1, 2, 1, 0, 9.0, 0, 0),
    # five ifs, and four `or`: lines 5, 7, 9 and 11
    4: (15, 1, 1, 10, 0, 5, 12.0, 0, 1),
    5: (13, 1, 2, 4, 1, 2, 13.0, 0, 0),
    6: (10, 1, 1, 3, 1, 0, 10.0, 0, 0),
    # functions of 2, 2, 5 and 4 lines
    7: (16, 4, 0, 1, 0, 0, 3.2, 0, 0),
    8: (12, 1, 0, 1, 0, 0, 11.0, 0, 1),
    9: (2, 1, 0, 1, 0, 0, 2.0, 0, 0),
    10: (2, 0, 0, 0, 0, 0, 0.0, 0, 0),
    11: (3, 0, 0, 0, 0, 0, 0.0, 0, 0),
    12: (7, 0, 1, 2, 0, 0, 0.0, 0, 0),
    # with, if, while, assert, handler; `and` twice, `or` once; 3 and 10 lines
    13: (13, 2, 3, 9, 1, 1, 6.5, 1, 0),
    14: (10, 0, 2, 4, 3, 0, 0.0, 0, 2),
    34: (1, 0, 0, 1, 0, 0, 0.0, 0, 1),
    37: (1, 0, 0, 1, 0, 0, 0.0, 0, 0),
    38: (5, 1, 1, 2, 1, 0, 4.0, 0, 0),
    40: (5, 0, 0, 0, 0, 0, 0.0, 0, 0),
}

# Python snippets that parse: Name nodes, Call nodes, last line
NODE_COUNTS = {
    # x, y input, data, print x y
    0: (7, 3, 5),
    # items i, range i, print i, items, items k, print k
    1: (11, 3, 7),
    # walk node | a b | pair pair pair
    2: (7, 4, 9),
    # result label flag v values | result v | label label v | flag v | result label flag
    3: (15, 0, 9),
    # list | a b | a b list | a b a | a b b | a b a | sum int sum
    4: (18, 0, 15),
    # flag, print flag, r rows, r, print r, print r, print rows
    5: (12, 4, 13),
    # q queue, queue q, queue q, queue
    6: (7, 3, 10),
    # counter limit | this limit | counter counter limit limit counter | counter counter
    7: (11, 0, 16),
    # handle size _skip name name path other other open path print name other handle
    8: (14, 5, 12),
    9: (2, 0, 2),
    # eval ValueError exec f open f
    12: (6, 4, 7),
    # session s, u u urls u s u | lock n n n n n n, deep n, ValueError KeyError
    13: (18, 2, 14),
    # best count key val pairs best val count count key range total
    14: (12, 2, 10),
    34: (1, 0, 1),
    37: (1, 1, 1),
    # total x range total print x
    38: (6, 2, 5),
}


def issue_rows():
    """``(snippet, seq, rule, name, line, fix)``."""
    for tid, found in ISSUES.items():
        for seq, (rule, line, *values) in enumerate(found):
            name, fix = ISSUE_TEXTS[rule]
            for i, value in enumerate(values):
                fix = fix.replace("{%d}" % i, str(value))
            yield tid, seq, rule.rstrip("ab"), name, line, fix
