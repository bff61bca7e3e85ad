"""Set-based checks against small sequential ones, on random programs."""

import random
import re
import sysconfig
from itertools import accumulate
from pathlib import Path

from pyspark.sql import functions as F

from reviewlake.functions import fixed
from reviewlake.operators import features, rules_clike
from reviewlake.operators.lines import clean_c_like, line_facts
from reviewlake.operators.tokens import c_like_syntax
from tests.conftest import code_frame

PIECES = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|(["\'])(?:\\.|(?!\1)[^\\])*(?:\1|\\?\Z)|[()\[\]{}]|\n',
                    re.S)
PAIR = {")": "(", "]": "[", "}": "{"}


def _syntax(code):
    """Bracket check with a stack."""
    stack, line, open_quote = [], 1, None
    for piece in PIECES.finditer(code):
        text = piece.group()
        if text in ("(", "[", "{"):
            stack.append((text, line))
        elif text in PAIR:
            if not stack or stack.pop()[0] != PAIR[text]:
                return line, f"Unmatched '{text}' in code block"
        elif text[0] in "\"'" and not re.fullmatch(
                r"""(["'])(?:\\.|(?!\1)[^\\])*\1""", text, re.S):
            open_quote = (line, text[0])
        line += text.count("\n")
    if open_quote:
        kind = "string" if open_quote[1] == '"' else "character"
        return open_quote[0], f"Unclosed {kind} literal"
    if stack:
        return stack[-1][1], f"Unclosed '{stack[-1][0]}' in code block"
    return None


def test_bracket_check(spark):
    rng = random.Random(5)
    parts = list("(){}[]\n\n") + ['"', "'", "\\", "/", "*", "//", "/*", "*/", "a", "()", "{}", "[]"]
    codes = ["", "(", "'", '"a\\', "/* ( ", "({[]})"]
    codes += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    got = {r.snippet_id: (r.error_line, r.error_msg)
           for r in c_like_syntax(code_frame(spark, codes)).collect()}
    for i, code in enumerate(codes):
        assert got.get(i) == _syntax(code), code


def _facts(spark, codes, language="cpp"):
    return line_facts(clean_c_like(code_frame(spark, codes, language)))


def _programs(parts, n, size, seed):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, size))) for _ in range(n)]


def _fall_through(code):
    """Cases whose next event is no break: another case, or the end of the switch."""
    events, depth, base = [], 0, 0
    for n, line in enumerate(code.split("\n"), 1):
        depth += line.count("{") - line.count("}")
        base = depth if re.search(fixed.SWITCH_OPEN, line) else base
        if base and depth < base:
            events.append((n, "end"))
            base = 0
        elif base:
            events += [(n, "case")] if re.search(fixed.SWITCH_CASE, line) else []
            events += [(n, "stop")] if re.search(fixed.SWITCH_BREAK, line) else []
    return [n for (n, kind), (_, then) in zip(events, events[1:])
            if kind == "case" and then != "stop"]


def test_missing_break(spark):
    parts = ["switch (x) {", "case 1:", "case 2: y();", "case 3: break;", "default:", "break;", "}",
             "{", "} }", "switch (y)", "}} switch (z) {{", "return 1;", "", "a();"]
    codes = _programs(parts, 3000, 16, 7)
    rows = rules_clike.switch_issues(_facts(spark, codes)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.snippet_id, []).append(r.line)
    for i, code in enumerate(codes):
        assert sorted(got.get(i, [])) == _fall_through(code), code


def _function_findings(code):
    """Each function on its own: where it opens, where it ends, what lies between."""
    lines = [(n, x.strip()) for n, x in enumerate(code.split("\n"), 1) if x.strip()]
    after = list(accumulate(x.count("{") - x.count("}") for _, x in lines))
    at_start = [max(0, b - (len(x) - len(x.lstrip("}"))))
                for b, (_, x) in zip([0, *after], lines)]
    signatures = {k: m for k, (_, x) in enumerate(lines)
                  if (m := re.match(fixed.SIGNATURE, x)) and m.group(1) != "void"}
    found = set()
    for k, sig in signatures.items():
        opening = k
        if not sig.group(3):
            opening = next((j for j in range(k + 1, len(lines)) if "{" in lines[j][1]), None)
            if opening is None or any(
                    j in signatures and not signatures[j].group(3) for j in range(k + 1, opening)):
                continue
        body = at_start[opening] + 1
        inside = []
        if after[opening] >= body:
            for j in range(opening + 1, len(lines)):
                if at_start[j] < body:
                    break
                inside.append(lines[j][1])
                if after[j] < body:
                    break
        text = "\n".join(inside)
        if not re.search(fixed.RETURN_WORD, text):
            found.add(("CJ-25", lines[k][0]))
        calls = any(re.search(rf"\b{sig.group(2)}\s*\(", x) for x in inside)
        if calls and not re.search(fixed.GUARD_WORD, text):
            found.add(("CJ-26", lines[k][0]))
    return found


def test_function_ends(spark):
    parts = ["int f(int a) {", "int g()", "{", "}", "} }", "{ {", "return f(1);", "f(2); g ();",
             "if (a) {", "else if (b) {", "void h() {", "int k(int x)", "g();", "", "}}", "x = 1;",
             "static long f(long y) {", "switch (q)"]
    codes = _programs(parts, 4000, 18, 11)
    got = {}
    for r in rules_clike.function_issues(_facts(spark, codes)).collect():
        got.setdefault(r.snippet_id, set()).add((r.rule, r.line))
    for i, code in enumerate(codes):
        assert got.get(i, set()) == _function_findings(code), code


def _length(lines):
    """Lines up to where the braces of a function opened here are closed."""
    sums = accumulate(x.count("{") - x.count("}") for x in lines)
    first = next((k for k, x in enumerate(lines) if "{" in x), None)
    return next((k + 1 for k, total in enumerate(sums)
                 if first is not None and k >= first and total <= 0), None)


def _lengths(code):
    lines, out = code.splitlines(), []
    while lines:
        n = _length(lines) if re.match(fixed.DECLARATION, lines[0], re.M) else None
        out += [n] if n else []
        lines = lines[n or 1:]
    return out


def _depth(code):
    heights = list(accumulate([0] + [1 if c == "{" else -1 for c in code if c in "{}"]))
    return max(h - low for h, low in zip(heights, accumulate(heights, min)))


def test_function_lengths_and_depth(spark):
    parts = ["int f(int a) {", "int g()", "{", "}", "} }", "{ {", "return f(1);", "else if (b) {",
             "void h() {", "", "}}", "} {", "x = 1;", "int q() { }"]
    parts = [p for p in parts if p != "int q() { }"]
    codes = _programs(parts, 4000, 16, 13)
    rows = code_frame(spark, codes).withColumn("clean", F.col("code"))
    got = {r.snippet_id: (r.n_lengths, r.sum_lengths)
           for r in features.c_like_function_lengths(rows).collect()}
    for i, code in enumerate(codes):
        want = _lengths(code)
        assert got.get(i, (0, 0)) == (len(want), sum(want)), code
    deep = features.rich_c_like(code_frame(spark, codes)).select("snippet_id", "nesting_depth")
    for r in deep.collect():
        assert r.nesting_depth == _depth(codes[r.snippet_id])


def _lines(issues, rule):
    return sorted((r.snippet_id, r.line) for r in issues.collect() if r.rule == rule)


def test_recent_loop_window(spark):
    gap = ["for (;x;) {"] + ["a;"] * 5 + ["while (y) {"]
    far = ["for (;x;) {"] + ["a;"] * 6 + ["while (y) {"]
    blank = ["for (;x;) {"] + [""] * 5 + ["cin >> x; while (y) {"]
    codes = ["\n".join(p) for p in (gap, far, blank)]
    issues = rules_clike.line_issues(_facts(spark, codes))
    assert _lines(issues, "CJ-1") == [(0, 7), (2, 7)]
    assert _lines(issues, "CJ-4") == [(2, 7)]


def test_declaration_counts_as_access(spark):
    codes = ["int a[5];", "int a[] = {1, ,2};\na[2] = a[1];", "int a[5];\nreturn a[9];",
             "int é[2];", "int a[3]; int b[9];\nb[9] = 0;"]
    got = sorted((r.snippet_id, r.line, r.fix.split("(s)")[0])
                 for r in rules_clike.array_issues(_facts(spark, codes)).collect())
    assert got == [
        (0, 1, "'a' has 5 element"), (1, 2, "'a' has 2 element"), (2, 2, "'a' has 9 element"),
        (3, 1, "'é' has 2 element"), (4, 1, "'a' has 3 element")]


def test_signature_counts_only_for_a_whole_text(spark):
    codes = ["int f(int a) {", "int f(int a) {\n return 1;\n}", "  int f(int a)\n", "x;\nint f() {"]
    got = {r.snippet_id: r.num_funcs
           for r in features.features_c_like(code_frame(spark, codes)).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 0}


def test_line_numbers_move_up_after_a_block_comment(spark):
    codes = ["/* a\n b */ x;\ny = 1 / 0;"]
    assert _lines(rules_clike.line_issues(_facts(spark, codes)), "CJ-3") == [(0, 2)]


def test_missing_semicolons_exempt_control_and_labels(spark):
    codes = ["if (x)\nelse if (y)\nfoo(x)\npublic : f()\nwhile (x)\ndo (x)\nreturn f(x)\nputs(\"a)"]
    issues = rules_clike.line_issues(_facts(spark, codes))
    assert _lines(issues, "CJ-7") == [(0, 3), (0, 7), (0, 8)]
    assert _lines(issues, "CJ-6") == [(0, 7)]
    assert _lines(issues, "CJ-8") == [(0, 8)]


def test_real_texts(spark):
    """The same checks on whole files of the standard library, read as C++."""
    folder = Path(sysconfig.get_paths()["stdlib"])
    raw = [p.read_text(encoding="utf-8") for p in sorted((folder / "email").glob("*.py"))]
    raw += [p.read_text(encoding="utf-8") for p in sorted(folder.glob("t*.py"))]
    got = {r.snippet_id: (r.error_line, r.error_msg)
           for r in c_like_syntax(code_frame(spark, raw)).collect()}
    assert [got.get(i) for i in range(len(raw))] == [_syntax(c) for c in raw]
    no_comments = [re.sub("//.*", "", re.sub(r"/\*.*?\*/", "", c, flags=re.S)) for c in raw]
    lines = ["\n".join(c.splitlines()) for c in no_comments]
    facts = _facts(spark, raw)
    functions, cases = {}, {}
    for r in rules_clike.function_issues(facts).collect():
        functions.setdefault(r.snippet_id, set()).add((r.rule, r.line))
    for r in rules_clike.switch_issues(facts).collect():
        cases.setdefault(r.snippet_id, []).append(r.line)
    for i, code in enumerate(lines):
        assert functions.get(i, set()) == _function_findings(code)
        assert sorted(cases.get(i, [])) == _fall_through(code)
