"""DuckDB SQL per registered query, over the same parquet tables."""

from __future__ import annotations

from oracles import base, golden
from oracles.base import cnt, lit, m, recursive, sql, values
from reviewlake.functions import fixed
from reviewlake.functions.explanations import DEFAULT_TEMPLATE, TEMPLATES
from reviewlake.functions.issue_texts import ISSUE_TEXTS
from reviewlake.operators.metrics import CUTS
from reviewlake.operators.rules_python import PYTHON_RULES
from reviewlake.plans.catalog import CJ_NAMES, OVER_TEXTS
from reviewlake.plans.inputs import HISTORY_ISSUES, ISSUE_NAMES, NOW

SQL: dict[str, str] = {}
SNIP, CLEAN, LINES = base.SNIPPETS, base.CLEAN, base.LINES
FEATURE_LIST = ", ".join(fixed.FEATURES)

# ---- sources ---------------------------------------------------------------------
SQL["io_1_src_jsonl"] = sql(base.CORPUS, """
SELECT code, '' AS docstring, repo, coalesce(path, '') AS path, coalesce(language, '') AS language
FROM corpus""")
SQL["io_2_src_source_files"] = sql(SNIP, """
SELECT snippet_id, code, '' AS docstring, '' AS repo, 'cpp' AS language
FROM snip WHERE review_language = 'cpp'""")
SQL["io_3_src_java_csv"] = sql(SNIP, """
SELECT code, '' AS docstring, '' AS repo, 'java' AS language
FROM snip WHERE review_language = 'java'""")
SQL["io_4_corpus_union"] = sql(SNIP, """
SELECT 'whole' AS part, review_language AS language, count(*) AS n FROM snip GROUP BY 2
UNION ALL
SELECT 'capped', review_language,
  CASE WHEN review_language = 'cpp' THEN least(20, count(*)) ELSE count(*) END
FROM snip WHERE review_language IN ('python', 'cpp') GROUP BY 2""")
SQL["io_5_labeled_samples"] = sql(base.CORPUS, """
SELECT code, CASE snippet_id % 9 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 1 END AS label
FROM corpus WHERE snippet_id % 9 IN (0, 1, 4, 6)""")
SQL["io_6_unlabeled_samples"] = sql(base.CORPUS, """
SELECT code FROM corpus WHERE snippet_id % 9 IN (0, 1, 2, 3, 4, 6) AND length(code) > 20""")

RISK = f"""(CASE WHEN contains(code, 'TODO') OR contains(code, 'FIXME') THEN 1 ELSE 0 END
  + CASE WHEN contains(replace(code, ' ', ''), 'while(true)')
           OR contains(replace(code, ' ', ''), 'for(;;)') THEN 2 ELSE 0 END
  + CASE WHEN {m('code', fixed.DIV_ZERO)} THEN 2 ELSE 0 END
  + CASE review_language
    WHEN 'python' THEN
      CASE WHEN contains(code, 'try:') AND contains(code, 'except') THEN 0 ELSE 1 END
      + CASE WHEN {m('code', r'==\s*None')} THEN 1 ELSE 0 END
      + CASE WHEN contains(code, 'eval(') OR contains(code, 'exec(') THEN 2 ELSE 0 END
    WHEN 'cpp' THEN
      CASE WHEN {m('code', r'\b(malloc|calloc|realloc)\s*\(')} AND NOT contains(code, 'free(')
           THEN 2 ELSE 0 END
      + CASE WHEN contains(code, 'new ') AND NOT contains(code, 'delete ') THEN 2 ELSE 0 END
      + CASE WHEN {m('code', r'\b(gets|strcpy)\s*\(')} THEN 2 ELSE 0 END
    WHEN 'java' THEN
      CASE WHEN {m('code', r'\bnew\s+(Scanner|BufferedReader)\b')} AND NOT contains(code, '.close(')
           THEN 2 ELSE 0 END
      + CASE WHEN {m('code', r'\bcatch\s*\(\s*Exception')} THEN 1 ELSE 0 END
    ELSE 0 END)"""
BUG_RISK = f"CASE WHEN {RISK} >= 2 THEN 1 ELSE 0 END"

SQL["io_7_feature_sink"] = sql(base.FEATURES, f"""
SELECT f.*, {BUG_RISK.replace('review_language', 's.review_language')} AS bug_risk
FROM fa f JOIN (SELECT snippet_id, code, review_language FROM snip) s USING (snippet_id)""")

EVENTS = "ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"
NAMES = "[" + ", ".join(map(lit, HISTORY_ISSUES)) + "]"
REVIEWS = EVENTS + f""",
rv AS (
  SELECT event_id AS review_id, user_id, ts AS created_at,
    event_type || '_' || (k % 7) || '.Py' AS filename, least(value, 100.0) AS confidence,
    event_type = 'error' AS syntax_error, CASE WHEN event_type = 'error' THEN k END AS error_line,
    CASE WHEN event_type = 'error' THEN 'bad syntax' ELSE '' END AS error_msg,
    1 + k % 3 AS complexity, k % 6 % 6 AS asked, least(k % 6, {len(HISTORY_ISSUES)}) AS n_issues, k,
    CASE WHEN event_type = 'error' THEN 10
         ELSE greatest(0, floor(100 - least(value, 100.0) + 0.5)) END AS score,
    epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) AS us
  FROM ev)"""
HISTORY = f"""review_id, user_id, filename, confidence, syntax_error, error_line, error_msg,
  complexity, n_issues, CASE WHEN n_issues > 0 THEN {lit(HISTORY_ISSUES[0])} END AS first_name,
  CASE WHEN n_issues > 0 THEN k END AS first_line,
  CASE WHEN n_issues > 0 THEN 'Look at "' || {lit(HISTORY_ISSUES[0])} || '"' END AS first_fix"""
SQL["io_8_review_sink"] = sql(REVIEWS, f"SELECT {HISTORY} FROM rv")
SQL["io_10_compiler_log_parse"] = """
SELECT doc_id AS snippet_id, 'Compiler Error' AS name, n_chars::INT AS line,
  CASE WHEN doc_id % 2 = 0 THEN 'expected '';'' before ''}''' ELSE 'cannot find symbol' END AS fix
FROM documents
UNION ALL
SELECT doc_id, 'Compiler Warning', CASE WHEN doc_id % 2 = 0 THEN 9 ELSE 3 END,
  CASE WHEN doc_id % 2 = 0 THEN 'no return' ELSE 'unused variable y' END
FROM documents"""

# ---- languages, cleaning, labels -----------------------------------------------------
for key, expr in {
    "cl_1_normalize_language": base.DECLARED,
    "cl_2_language_from_filename": base.FROM_NAME,
    "cl_3_language_from_path": base.FROM_PATH,
    "cl_4_language_from_code": base.FROM_CODE,
    "cl_5_resolve_review_language": base.REVIEW_LANGUAGE,
    "cl_6_resolve_row_language":
        f"CASE WHEN {base.DECLARED} IN {base.SUPPORTED} THEN {base.DECLARED} "
        f"ELSE {base.FROM_PATH} END",
}.items():
    SQL[key] = sql(base.CORPUS, f"SELECT snippet_id, {expr} AS lang FROM corpus")

BROKEN = [t for t, (_, msg) in golden.SYNTAX_ERRORS.items() if msg is None]
# A C++ text under a Python label would have to parse too; the corpus has none.
CLEANED = base.CORPUS + f""",
cd AS (
  SELECT * FROM (
    SELECT *, CASE WHEN {base.DECLARED} IN {base.SUPPORTED} THEN {base.DECLARED}
                   ELSE {base.FROM_PATH} END AS review_language FROM corpus)
  WHERE review_language IN {base.SUPPORTED} AND length(trim(code, chr(10) || ' ')) >= 8
    AND NOT (review_language = 'python' AND tid IN ({', '.join(map(str, BROKEN))})))"""
SQL["cl_7_clean_dataset"] = sql(CLEANED, "SELECT snippet_id, code, review_language FROM cd")
SQL["cl_8_language_distribution"] = sql(CLEANED, f"""
SELECT review_language, 'all' AS bug_risk, count(*) AS n FROM cd GROUP BY 1
UNION ALL
SELECT review_language, CAST({BUG_RISK} AS VARCHAR), count(*) FROM cd GROUP BY 1, 2""")
SQL["cl_9_bug_risk_label"] = sql(SNIP, f"SELECT snippet_id, {BUG_RISK} AS bug_risk FROM snip")
SQL["cl_10_strip_c_comments"] = sql(CLEAN, "SELECT snippet_id, review_language, clean FROM cl")
SQL["cl_11_blank_strings_in_line"] = sql(
    LINES, f"SELECT snippet_id, n::INT AS n, {base.BLANKED} AS line FROM ln")
SQL["cl_12_explode_lines"] = sql(LINES, "SELECT snippet_id, n::INT AS n, line FROM ln")
SQL["cl_12b_explode_lines_of_pages"] = """
WITH p AS (
  SELECT page_id AS snippet_id, unnest(string_split(html, chr(10))) AS raw,
    unnest(range(1, len(string_split(html, chr(10))) + 1)) AS n FROM pages),
t AS (SELECT snippet_id, n, trim(raw, chr(9) || chr(160) || ' ') AS line FROM p)
SELECT snippet_id, count(*) AS lines, max(n)::INT AS last_line, sum(length(line))::BIGINT AS chars
FROM t WHERE line <> '' GROUP BY 1"""
EXT = base.EXT
TAIL = "lower(list_extract(string_split(filename, '.'), -1))"
SQL["cl_13_language_from_upload"] = sql(base.CORPUS, f"""
SELECT snippet_id,
  coalesce({base.case(EXT, fixed.APP_UPLOAD_EXTENSIONS)},
    CASE snippet_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' WHEN 2 THEN 'java' END, 'python')
    AS upload,
  coalesce({base.case(TAIL, fixed.DASHBOARD_REVIEW_EXTENSIONS)}, 'python') AS review,
  coalesce({base.case(TAIL, fixed.DASHBOARD_DISPLAY_EXTENSIONS)}, 'plaintext') AS display
FROM corpus""")

# ---- syntax ----------------------------------------------------------------------------
TOKENS = (r'//[^\n]*|/\*[\s\S]*?\*/|/\*[\s\S]*|"(?:[^"\\]|\\[\s\S])*"|"(?:[^"\\]|\\[\s\S])*\\?'
          r"|'(?:[^'\\]|\\[\s\S])*'|'(?:[^'\\]|\\[\s\S])*\\?|[()\[\]{}]|\n")


def _syntax(source: str) -> str:
    """Bracket check with a stack kept as text, one token at a time."""
    return f"""{source},
codes AS (SELECT min(snippet_id) AS rep, code FROM src GROUP BY code),
toks AS (
  SELECT rep, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS i
  FROM (SELECT rep, regexp_extract_all(code, {lit(TOKENS)}) AS t FROM codes)),
tk AS (
  SELECT rep, i, tok, left(tok, 1) AS f,
    1 + coalesce(sum(len(tok) - len(replace(tok, chr(10), ''))) OVER (
      PARTITION BY rep ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
  FROM toks),
br AS (
  SELECT rep, f, line, row_number() OVER (PARTITION BY rep ORDER BY i) AS k
  FROM tk WHERE f IN ('(', '[', '{{', ')', ']', '}}')),
run(rep, k, stack, lines, bad, bad_line) AS (
  SELECT DISTINCT rep, 0::BIGINT, '', []::BIGINT[], NULL::VARCHAR, NULL::BIGINT FROM br
  UNION ALL
  SELECT r.rep, b.k,
    CASE WHEN b.f IN ('(', '[', '{{') THEN r.stack || b.f ELSE left(r.stack, len(r.stack) - 1) END,
    CASE WHEN b.f IN ('(', '[', '{{') THEN list_append(r.lines, b.line)
         ELSE list_slice(r.lines, 1, len(r.lines) - 1) END,
    CASE WHEN b.f NOT IN ('(', '[', '{{') AND right(r.stack, 1) || b.f NOT IN ('()', '[]', '{{}}')
         THEN b.f END,
    CASE WHEN b.f NOT IN ('(', '[', '{{') AND right(r.stack, 1) || b.f NOT IN ('()', '[]', '{{}}')
         THEN b.line END
  FROM run r JOIN br b ON b.rep = r.rep AND b.k = r.k + 1 WHERE r.bad IS NULL),
last AS (
  SELECT rep, max(bad) AS bad, max(bad_line) AS bad_line, arg_max(stack, k) AS stack,
    arg_max(lines, k) AS lines FROM run GROUP BY rep),
quote AS (
  SELECT rep, f, line FROM tk WHERE f IN ('"', '''')
    AND NOT regexp_matches(tok, '^("([^"\\\\]|\\\\[\\s\\S])*"|''([^''\\\\]|\\\\[\\s\\S])*'')$')),
err AS (
  SELECT c.code, coalesce(l.bad_line, q.line, list_extract(l.lines, -1))::INT AS error_line,
    CASE WHEN l.bad IS NOT NULL THEN 'Unmatched ''' || l.bad || ''' in code block'
         WHEN q.f = '"' THEN 'Unclosed string literal'
         WHEN q.f IS NOT NULL THEN 'Unclosed character literal'
         ELSE 'Unclosed ''' || right(l.stack, 1) || ''' in code block' END AS error_msg
  FROM codes c LEFT JOIN last l ON l.rep = c.rep LEFT JOIN quote q ON q.rep = c.rep)"""


ERRORS = "SELECT snippet_id, error_line, error_msg FROM src JOIN err USING (code) " \
         "WHERE error_line IS NOT NULL"
SQL["sx_1_c_like_syntax"] = recursive(_syntax(
    SNIP + ",\nsrc AS (SELECT * FROM snip WHERE review_language IN ('cpp', 'java'))"), ERRORS)
SQL["sx_1b_c_like_syntax_of_pages"] = recursive(_syntax("""
src AS (
  SELECT page_id AS snippet_id, CASE page_id % 4 WHEN 0 THEN html
    WHEN 1 THEN replace(html, 'track(', 'track[') WHEN 2 THEN html || '''tail'
    ELSE '{' || html END AS code FROM pages)"""), ERRORS)
SE = ",\nse(tid, error_line, error_msg) AS " + values(
    [(t, *e) for t, e in golden.SYNTAX_ERRORS.items()])
SQL["sx_2_python_syntax"] = sql(SNIP + SE, """
SELECT snippet_id, se.tid IS NULL AS parse_ok, error_line
FROM snip LEFT JOIN se USING (tid) WHERE review_language = 'python'""")
SQL["sx_3_find_syntax_error"] = sql(SNIP + SE, """
SELECT snippet_id, CASE WHEN se.tid IS NOT NULL THEN 'SyntaxError' END AS type,
  error_line AS line, error_msg AS message
FROM snip LEFT JOIN se USING (tid)""")
SQL["sx_4_find_logical_issues"] = sql(
    base.RANKED, "SELECT snippet_id, position::INT AS position, name, line FROM rk")

# ---- features ------------------------------------------------------------------------------
SQL["fe_1_features_c_like"] = sql(base.C_FEATURES, "SELECT * FROM fc")
SQL["fe_2_features_python"] = sql(base.FEATURES, "SELECT * FROM fp")
SQL["fe_3_features_legacy"] = sql(
    base.FEATURES,
    f"SELECT snippet_id, review_language, {', '.join(fixed.FEATURES[:5])} FROM fa")
SQL["fe_7_distinct_features"] = sql(base.FEATURES, "SELECT * FROM fa")

DECL_LINE = "^" + base.plain(fixed.DECLARATION)[1:]
# Function lengths line by line: start and brace sum of the function being read.
# A function that never closes sends the reader back to the line after its start.
SQL["fe_4_rich_c_like"] = recursive(CLEAN + f""",
fl AS (
  SELECT snippet_id, unnest(string_split(clean, chr(10))) AS raw,
    unnest(range(1, len(string_split(clean, chr(10))) + 1)) AS n FROM cl),
fx AS (
  SELECT snippet_id, n, len(raw) - len(replace(raw, '{{', '')) AS o,
    len(raw) - len(replace(raw, '}}', '')) AS c, {m('raw', DECL_LINE)} AS decl,
    max(n) OVER (PARTITION BY snippet_id) AS last_n
  FROM fl),
rd(snippet_id, n, start, depth, seen, total, num) AS (
  SELECT DISTINCT snippet_id, 1::BIGINT, NULL::BIGINT, 0::BIGINT, false, 0::BIGINT, 0::BIGINT
  FROM fx
  UNION ALL
  SELECT r.snippet_id,
    CASE WHEN beg IS NULL OR fin OR x.n < x.last_n THEN x.n + 1 ELSE beg + 1 END,
    CASE WHEN beg IS NULL OR fin OR x.n = x.last_n THEN NULL ELSE beg END,
    CASE WHEN beg IS NULL OR fin OR x.n = x.last_n THEN 0 ELSE bal END,
    CASE WHEN beg IS NULL OR fin OR x.n = x.last_n THEN false ELSE opened END,
    CASE WHEN fin THEN r.total + x.n - beg + 1 ELSE r.total END,
    CASE WHEN fin THEN r.num + 1 ELSE r.num END
  FROM rd r JOIN fx x ON x.snippet_id = r.snippet_id AND x.n = r.n,
  LATERAL (SELECT CASE WHEN r.start IS NOT NULL THEN r.start WHEN x.decl THEN x.n END AS beg,
                  r.depth + x.o - x.c AS bal, r.seen OR x.o > 0 AS opened) a,
  LATERAL (SELECT beg IS NOT NULL AND opened AND bal <= 0 AS fin) b),
len AS (
  SELECT snippet_id, max(num) AS num, max(total) AS total FROM rd GROUP BY snippet_id),
bt AS (
  SELECT snippet_id, unnest(t) AS b, unnest(range(1, len(t) + 1)) AS i
  FROM (SELECT snippet_id, regexp_extract_all(clean, '[{{}}]') AS t FROM cl)),
bs AS (
  SELECT snippet_id, i, sum(CASE b WHEN '{{' THEN 1 ELSE -1 END) OVER w AS s
  FROM bt WINDOW w AS (PARTITION BY snippet_id ORDER BY i)),
bd AS (
  SELECT snippet_id, max(s - lo) AS depth FROM (
    SELECT *, least(0, min(s) OVER (PARTITION BY snippet_id ORDER BY i)) AS lo FROM bs)
  GROUP BY snippet_id),
dn AS (
  SELECT snippet_id, unnest(list_distinct(regexp_extract_all(clean,
    {lit('(?m)' + base.plain(fixed.DECLARATION))}, 1))) AS fname FROM cl),
rec AS (
  SELECT DISTINCT snippet_id FROM dn JOIN cl USING (snippet_id)
  WHERE len(regexp_extract_all(clean, '\\b' || fname || '\\s*\\(')) > 1)""", f"""
SELECT c.snippet_id, c.review_language,
  greatest(1, len(list_filter(string_split(code, chr(10)), lambda x: trim(x) <> ''))) AS lines_of_code,
  {cnt('clean', '(?m)' + base.plain(fixed.DECLARATION))} AS num_functions,
  coalesce(bd.depth, 0)::INT AS nesting_depth,
  {cnt('clean', fixed.BRANCH)} + 1 AS cyclomatic_complexity,
  {cnt('clean', fixed.LOOP)} AS num_loops, {cnt('clean', fixed.IF)} AS num_conditions,
  CASE WHEN num > 0 THEN round(total / num, 1) ELSE 0.0 END AS function_length_avg,
  (rec.snippet_id IS NOT NULL)::INT AS recursion_detected, 0 AS unused_variables_count
FROM cl c LEFT JOIN len USING (snippet_id) LEFT JOIN bd USING (snippet_id)
LEFT JOIN rec ON rec.snippet_id = c.snippet_id""")
SQL["fe_5_rich_python"] = sql(
    SNIP + f",\npr(tid, {', '.join(fixed.RICH_FEATURES)}) AS "
    + values([(t, *v) for t, v in golden.PYTHON_RICH.items()]),
    f"SELECT snippet_id, review_language, "
    + ", ".join(f"{c}::DOUBLE AS {c}" if c == "function_length_avg" else c
                for c in fixed.RICH_FEATURES)
    + " FROM snip JOIN pr USING (tid) WHERE review_language = 'python'")
SQL["fe_6_panel_stats"] = sql(base.RESULTS, f"""
SELECT r.snippet_id, len(string_split(rtrim(s.code, chr(10)), chr(10)))::INT AS lines,
  CASE WHEN r.review_language = 'python' THEN pc.nf
       ELSE {cnt('s.code', '(?m)' + base.plain(fixed.PANEL_FUNCTION))} END::INT AS functions,
  r.complexity::INT AS loops, round_even(r.confidence, 0)::INT AS risk
FROM rs r JOIN snip s USING (snippet_id) LEFT JOIN pc ON pc.tid = r.tid""")

# ---- C++ / Java rules -------------------------------------------------------------------------
for rule, short in CJ_NAMES.items():
    key = f"cj_{rule[3:]}_{short}"
    name, fix = ISSUE_TEXTS[rule]
    head = f"{lit(name)} AS name"
    if rule in base.LINE_TESTS:
        SQL[key] = sql(base.FLAGS, f"SELECT snippet_id, {head}, n::INT AS line, {lit(fix)} AS fix "
                                   f"FROM lf WHERE {base.LINE_TESTS[rule]}")
    elif rule in base.FILE_TESTS:
        SQL[key] = sql(CLEAN, f"SELECT snippet_id, {head}, 0 AS line, {lit(fix)} AS fix "
                              f"FROM cl WHERE {base.FILE_TESTS[rule]}")
    elif rule == "CJ-19":
        SQL[key] = recursive(base.SWITCH, f"SELECT snippet_id, {head}, reported::INT AS line, "
                                          f"{lit(fix)} AS fix FROM st WHERE reported IS NOT NULL")
    elif rule in ("CJ-25", "CJ-26"):
        test = "NOT has_return" if rule == "CJ-25" else "calls_self AND NOT has_guard"
        SQL[key] = sql(base.FUNCTIONS, f"SELECT snippet_id, {head}, start::INT AS line, "
                                       f"{lit(fix)} AS fix FROM fun WHERE {test}")
    elif rule == "CJ-27":
        SQL[key] = sql(base.ARRAYS, f"""
SELECT DISTINCT snippet_id, {head}, n::INT AS line, '''' || name || ''' has ' || size
  || ' element(s) (valid indices 0–' || (size - 1) || '), but index ' || idx
  || ' is accessed. This will throw an ' || CASE review_language
     WHEN 'java' THEN {lit(golden.JAVA_KIND)} ELSE {lit(golden.CPP_KIND)} END
  || ' at runtime. Check the array size before accessing.' AS fix
FROM acc JOIN size USING (snippet_id, name) WHERE idx >= size""")
    else:
        SQL[key] = sql(base.FEATURES, f"SELECT snippet_id, {head}, 0 AS line, {lit(fix)} AS fix "
                                      "FROM fa WHERE num_loops >= 3")

# ---- Python rules ----------------------------------------------------------------------------
for rule, fn in PYTHON_RULES.items():
    SQL[f"py_{rule[3:]}_{fn.__name__}"] = sql(
        base.CORPUS + base.GOLDEN,
        f"SELECT snippet_id, name, line, fix FROM gi WHERE rule = {lit(rule)}")

# ---- scoring -----------------------------------------------------------------------------------
SQL["s_1_distinct_issues"] = sql(
    base.CORPUS + base.GOLDEN,
    "SELECT name, line, fix, count(DISTINCT snippet_id) AS snippets FROM gi GROUP BY 1, 2, 3")
SQL["s_2_complexity"] = sql(
    base.FEATURES, "SELECT snippet_id, greatest(1, num_loops)::INT AS complexity FROM fa")
SQL["s_3_risk_score"] = sql(EVENTS + """,
q AS (
  SELECT event_id, k % 4 AS i, k % 5 AS l, k % 7 AS c, event_id % 1000 / 1000.0 AS p,
    least(greatest(event_id % 11 / 10.0, 0.05), 0.95) AS t FROM ev),
z AS (
  SELECT *, least(95.0, i * 18 + l * 10 + c * 4) AS many, l * 8 + c * 3 AS simple,
    least(95.0, i * 16 + l * 10 + c * 4) AS plain,
    least(100.0, CASE WHEN p >= t THEN 50.0 + 50.0 * (p - t) / (1.0 - t) ELSE 50.0 * (p / t) END
      + i * 15.0) AS scaled FROM q)""", """
SELECT event_id,
  CASE WHEN i >= 2 THEN many WHEN i = 0 AND l <= 1 AND c <= 2 THEN simple ELSE plain END::DOUBLE
    AS risk,
  CASE WHEN i >= 2 THEN many WHEN i = 0 AND l <= 1 AND c <= 2 THEN simple
       ELSE round_even(scaled, 2) END::DOUBLE AS model_risk
FROM z""")
SQL["s_4_rank_issues"] = sql(
    base.RANKED,
    "SELECT snippet_id, name, line, fix, rank, position::INT AS position FROM rk")

NAME_LIST = "[" + ", ".join(map(lit, ISSUE_NAMES)) + "]"
NAMED = f"""nm AS (
  SELECT event_id, list_extract({NAME_LIST}, event_id % {len(ISSUE_NAMES)} + 1) AS name,
    least(value, 100.0) AS confidence FROM events)"""


def _contains(words) -> str:
    return "(" + " OR ".join(f"contains(lower(name), {lit(w)})" for w in words) + ")"


SQL["s_5_severity_3_app"] = sql(NAMED, f"""
SELECT event_id, CASE WHEN {_contains(fixed.APP_CRITICAL)} THEN 'critical'
  WHEN {_contains(fixed.APP_WARNING)} THEN 'warning' ELSE 'tip' END AS severity FROM nm""")
SQL["s_6_severity_3_panel"] = sql(NAMED, f"""
SELECT event_id, CASE WHEN {_contains(fixed.PANEL_CRITICAL)} THEN 'critical'
  WHEN {_contains(fixed.PANEL_WARNING)} THEN 'warning' ELSE 'tip' END AS severity FROM nm""")
TEMPLATE_CTE = "tp(ord, template, hint, explanation, tfix) AS " + values(
    [(i, *t) for i, t in enumerate(TEMPLATES)])
SQL["s_7_template_lookup"] = sql(NAMED + ",\n" + TEMPLATE_CTE + """,
pick AS (
  SELECT n.name, arg_min(t.ord, CASE WHEN t.template = n.name THEN -1 ELSE t.ord END) AS ord
  FROM (SELECT DISTINCT name FROM nm) n JOIN tp t
    ON t.template = n.name OR starts_with(lower(n.name), left(lower(t.template), 20))
  GROUP BY n.name)""", f"""
SELECT event_id, name, coalesce(hint, {lit(DEFAULT_TEMPLATE[0])}) AS severity_hint,
  coalesce(explanation, {lit(DEFAULT_TEMPLATE[1])}) AS explanation,
  coalesce(tfix, {lit(DEFAULT_TEMPLATE[2])}) AS template_fix
FROM nm LEFT JOIN pick USING (name) LEFT JOIN tp USING (ord)""")
SEVERITY = """CASE WHEN contains(name, 'Compiler Error') THEN 'CRITICAL'
  WHEN confidence >= 80 AND coalesce(hint, 'MEDIUM') = 'MEDIUM' THEN 'HIGH'
  WHEN confidence >= 80 AND hint = 'LOW' THEN 'MEDIUM' ELSE coalesce(hint, 'MEDIUM') END"""
SQL["s_8_issue_severity"] = sql(NAMED + ",\n" + TEMPLATE_CTE, f"""
SELECT event_id, {SEVERITY} AS severity FROM nm LEFT JOIN tp ON template = name""")
WORST = base.RESULTS + ",\n" + TEMPLATE_CTE + f""",
sv AS (
  SELECT r.snippet_id, max(CASE {SEVERITY} WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2
    WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS w
  FROM rs r JOIN gi USING (snippet_id) LEFT JOIN tp ON template = name GROUP BY 1),
wo AS (
  SELECT rs.snippet_id, list_extract(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], coalesce(w, 0) + 1)
    AS severity FROM rs LEFT JOIN sv USING (snippet_id))"""
SQL["s_9_worst_severity"] = sql(WORST, "SELECT snippet_id, severity FROM wo")
SCORED_EVENTS = REVIEWS + """,
sc AS (
  SELECT *, n_issues + syntax_error::INT AS n, score::INT AS panel_score,
    CASE WHEN syntax_error THEN 20 ELSE greatest(10, least(99, greatest(0,
      100 - trunc(confidence)::INT - (n_issues + syntax_error::INT) * 8))) END::INT AS app_score
  FROM rv)"""
SQL["s_10_scores"] = sql(SCORED_EVENTS, "SELECT review_id, app_score, panel_score FROM sc")
SQL["s_11_health_label"] = sql(SCORED_EVENTS, """
SELECT review_id, CASE WHEN confidence > 70 OR n >= 3 THEN 'critical'
  WHEN confidence > 35 OR n >= 1 THEN 'risky' ELSE 'healthy' END AS health FROM sc""")
SQL["s_12_score_band"] = sql(SCORED_EVENTS, """
SELECT review_id, CASE WHEN app_score >= 75 THEN 'green' WHEN app_score >= 50 THEN 'orange'
    ELSE 'red' END AS app_band,
  CASE WHEN panel_score >= 80 THEN 'green' WHEN panel_score >= 50 THEN 'orange'
    ELSE 'red' END AS panel_band FROM sc""")
PANEL = f"""CASE WHEN {_contains(fixed.PANEL_CRITICAL)} THEN 'critical'
  WHEN {_contains(fixed.PANEL_WARNING)} THEN 'warning' ELSE 'tip' END"""
SQL["s_13_panel_issues"] = sql(base.RESULTS, f"""
SELECT snippet_id, position::INT AS position, name, line, {PANEL} AS severity FROM rk
UNION ALL
SELECT snippet_id, 1, 'Syntax Error', error_line, 'critical' FROM rs WHERE syntax_error""")
SQL["s_14_review_result"] = sql(base.RESULTS, """
SELECT snippet_id, review_language, confidence, syntax_error, error_line,
  CASE WHEN review_language <> 'python' THEN coalesce(error_msg, '') END AS error_msg,
  issues, complexity::INT AS complexity FROM rs""")
SQL["s_15_primary_issue"] = sql(base.RESULTS, "SELECT snippet_id, first_name AS issue FROM rs")

# ---- models and evaluation -----------------------------------------------------------------------
SCORED = """sd AS (
  SELECT l.doc_id AS snippet_id,
    list_extract(['python', 'cpp', 'java'], l.doc_id % 3 + 1) AS review_language,
    l.quality AS label,
    ((d.n_chars * 37 + l.doc_id * 11) % 700 + l.quality * 300) / 1000.0 AS probability
  FROM labels l JOIN documents d USING (doc_id))"""
SQL["ml_1_stratified_split"] = sql(SCORED, """
SELECT snippet_id, label,
  row_number() OVER (PARTITION BY label ORDER BY md5('42:' || snippet_id), snippet_id)
    <= floor(count(*) OVER (PARTITION BY label) * 0.2 + 0.5) AS is_test
FROM sd""")
SQL["ml_2_class_guard"] = sql(SCORED + """,
c AS (
  SELECT CASE WHEN snippet_id % 50 = 0 THEN 'ruby' WHEN snippet_id % 50 = 1 THEN 'cpp'
    WHEN label = 1 THEN 'java' ELSE 'python' END AS review_language, label, count(*) AS n
  FROM sd GROUP BY 1, 2),
p AS (
  SELECT review_language, sum(n)::BIGINT AS n_samples, count(*) AS n_classes,
    min(n - floor(n * 0.2 + 0.5)) AS min_train FROM c GROUP BY 1)""", f"""
SELECT review_language, n_samples, n_classes,
  CASE WHEN review_language NOT IN {base.SUPPORTED} THEN 'unsupported_language'
       WHEN n_classes < 2 THEN review_language || ': requires at least 2 classes.'
       WHEN min_train < 2 THEN review_language || ': not enough samples per class after split.'
  END AS reason FROM p""")
SQL["ml_3_class_weights"] = sql(SCORED + """,
k AS (SELECT review_language, count(DISTINCT label) AS classes FROM sd GROUP BY 1)""", """
SELECT snippet_id, round(count(*) OVER (PARTITION BY review_language)
  / (classes * count(*) OVER (PARTITION BY review_language, label)), 6) AS weight
FROM sd JOIN k USING (review_language)""")
CUT_ROWS = values([(c,) for c in CUTS])
SQL["ml_6_threshold_sweep"] = sql(SCORED + f""",
ct(cut) AS {CUT_ROWS},
ec AS (
  SELECT review_language, cut::DOUBLE AS cut, sum((probability >= cut)::INT) AS pred,
    sum((probability >= cut AND label = 1)::INT) AS tp, sum(label) AS pos
  FROM sd, ct GROUP BY 1, 2),
mt AS (
  SELECT *, tp / pred AS precision, tp / pos AS recall, 2.0 * tp / (pred + pos) AS f1,
    CASE review_language WHEN 'java' THEN 4.0 ELSE 1.0 END AS b2 FROM ec WHERE pred > 0),
fb AS (
  SELECT *, (1.0 + b2) * precision * recall / greatest(b2 * precision + recall, 1e-12) AS fbeta
  FROM mt),
bestrow AS (
  SELECT *, row_number() OVER (PARTITION BY review_language ORDER BY
    CASE WHEN review_language = 'java' AND recall >= 0.7 THEN 0 ELSE 1 END,
    CASE WHEN review_language = 'java' AND recall >= 0.7 THEN f1 ELSE fbeta END DESC,
    CASE WHEN review_language = 'java' AND recall >= 0.7 THEN precision ELSE recall END DESC,
    cut) AS r FROM fb)""", """
SELECT review_language, round(cut, 6) AS threshold, round(f1, 6) AS f1, round(fbeta, 6) AS fbeta,
  round(precision, 6) AS precision, round(recall, 6) AS recall FROM bestrow WHERE r = 1""")
# The steps by their other definition: the largest, over all beginnings, of the least mean up to a later end.
SQL["ml_13b_isotonic_curve"] = sql(SCORED + """,
pt AS (SELECT review_language, probability AS score, sum(2 * label + 1) AS w, sum((2 * label + 1) * label) AS t FROM sd GROUP BY 1, 2),
cm AS (
  SELECT *, row_number() OVER o AS r, sum(w) OVER o AS cw, sum(t) OVER o AS ct FROM pt
  WINDOW o AS (PARTITION BY review_language ORDER BY score)),
sg AS (
  SELECT b.review_language, b.r AS first, e.r AS last, (e.ct - b.ct + b.t) / (e.cw - b.cw + b.w)::DOUBLE AS mean
  FROM cm b JOIN cm e ON e.review_language = b.review_language AND e.r >= b.r),
least AS (
  SELECT review_language, first, last AS r, min(mean) OVER (PARTITION BY review_language, first ORDER BY last DESC) AS low FROM sg)""", """
SELECT review_language, score, round(max(low), 6) AS value FROM least JOIN cm USING (review_language, r) GROUP BY 1, 2""")
SQL["ml_9_binary_metrics"] = sql(SCORED + """,
b AS (
  SELECT review_language, count(*) AS n_samples,
    count(*) FILTER (probability >= 0.425 AND label = 1) AS tp,
    count(*) FILTER (probability >= 0.425 AND label = 0) AS fp,
    count(*) FILTER (probability < 0.425 AND label = 1) AS fn,
    count(*) FILTER (probability >= 0.5 AND label = 1) AS tp5,
    count(*) FILTER (probability >= 0.5 AND label = 0) AS fp5,
    count(*) FILTER (probability < 0.5 AND label = 1) AS fn5
  FROM sd GROUP BY 1),
auc AS (
  SELECT p.review_language, avg(CASE WHEN p.probability > n.probability THEN 1.0
    WHEN p.probability = n.probability THEN 0.5 ELSE 0.0 END) AS roc_auc
  FROM sd p JOIN sd n ON n.review_language = p.review_language AND n.label = 0
  WHERE p.label = 1 GROUP BY 1)""", """
SELECT review_language, n_samples, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round(2 * tp5 / (2 * tp5 + fp5 + fn5), 6) AS f1_default_threshold, round(roc_auc, 6) AS roc_auc
FROM b JOIN auc USING (review_language)""")
SQL["ml_9b_class_report"] = sql(SCORED + """,
pd AS (SELECT *, (probability >= 0.425)::INT AS predicted FROM sd),
cls AS (SELECT DISTINCT review_language, label AS class FROM pd
        UNION SELECT DISTINCT review_language, predicted FROM pd)""", """
SELECT c.review_language, class, count(*) FILTER (label = class)::BIGINT AS support,
  round(coalesce(count(*) FILTER (label = class AND predicted = class)
    / nullif(count(*) FILTER (predicted = class), 0), 0), 6) AS precision,
  round(coalesce(count(*) FILTER (label = class AND predicted = class)
    / nullif(count(*) FILTER (label = class), 0), 0), 6) AS recall,
  round(2 * count(*) FILTER (label = class AND predicted = class)
    / (count(*) FILTER (label = class) + count(*) FILTER (predicted = class)), 6) AS f1
FROM cls c JOIN pd USING (review_language) GROUP BY 1, 2""")
SQL["ml_9c_report_summary"] = SQL["ml_9b_class_report"].replace(
    "SELECT c.review_language, class,", ",\nrp AS (SELECT c.review_language, class,").replace(
    ", 6) AS", ", 20) AS") + """),
mw AS (
  SELECT review_language, sum(support)::BIGINT AS support,
    avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
    sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
    sum(f1 * support) / sum(support) AS wf FROM rp GROUP BY 1)
SELECT review_language, 'accuracy' AS class, round(wr, 6) AS precision, round(wr, 6) AS recall,
  round(wr, 6) AS f1, support FROM mw
UNION ALL SELECT review_language, 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), support FROM mw
UNION ALL SELECT review_language, 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), support
FROM mw"""
SQL["ml_10_issue_dataset"] = sql(base.RESULTS + """,
kc AS (SELECT first_name, row_number() OVER (ORDER BY first_name) - 1 AS label
       FROM rs GROUP BY first_name HAVING count(*) >= 2)""", """
SELECT snippet_id, first_name AS issue, label::INT AS label, num_lines, num_loops
FROM rs JOIN kc USING (first_name) JOIN fa USING (snippet_id)""")
SQL["ml_12_severity_dataset"] = sql(WORST, """
SELECT snippet_id, severity, (dense_rank() OVER (ORDER BY severity) - 1)::INT AS label, num_lines,
  num_loops FROM wo JOIN fa USING (snippet_id)""")
SQL["ev_1_predict_flag"] = sql(base.RESULTS, """
SELECT snippet_id, CASE WHEN n > 0 OR confidence > 40 THEN 1 ELSE 0 END AS predicted FROM rs""")


def _metrics(column: str) -> str:
    tp = f"count(*) FILTER ({column} = 1 AND label = 1)"
    fp = f"count(*) FILTER ({column} = 1 AND label = 0)"
    fn = f"count(*) FILTER ({column} = 0 AND label = 1)"
    return f"""round(coalesce({tp} / nullif({tp} + {fp}, 0), 0), 6) AS precision,
  round(coalesce({tp} / nullif({tp} + {fn}, 0), 0), 6) AS recall,
  round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 6) AS f1,
  round({fp} / greatest(1, count(*) FILTER (label = 0)), 6) AS false_positive_rate,
  round(avg(latency_ms), 6) AS avg_latency_ms,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms, count(*)::DOUBLE AS n_samples"""


EVAL = SCORED + """,
el AS (SELECT *, (snippet_id * 31 % 97) / 10.0 AS latency_ms,
         CASE WHEN probability * 100 > 40 THEN 1 ELSE 0 END AS flag,
         (snippet_id % 3 = 0)::INT AS by_rules, (probability >= 0.5)::INT AS by_model FROM sd)"""
SQL["ev_2_eval_metrics"] = sql(
    EVAL, f"SELECT review_language, {_metrics('flag')} FROM el GROUP BY 1")
SQL["ev_3_eval_compare"] = sql(EVAL + f""",
r AS (UNPIVOT (SELECT {_metrics('by_rules')} FROM el) ON COLUMNS(*) INTO NAME metric VALUE rules),
o AS (UNPIVOT (SELECT {_metrics('by_model')} FROM el) ON COLUMNS(*) INTO NAME metric VALUE model)
""", "SELECT metric, rules, model FROM r JOIN o USING (metric)")
SQL["ev_4_synthetic_labels"] = sql(base.RESULTS, """
SELECT snippet_id, CASE WHEN n > 0 THEN 1 ELSE 0 END AS label FROM rs""")

# The same feature SQL over the cleaned corpus with its own language rule.
SQL["main_build_dataset"] = sql(
    base.FEATURES.replace(base.SNIPPETS, CLEANED + ",\nsnip AS (SELECT * FROM cd)"), f"""
SELECT f.*, {BUG_RISK.replace('review_language', 's.review_language')} AS bug_risk
FROM fa f JOIN (SELECT snippet_id, code, review_language FROM snip) s USING (snippet_id)""")
# Reviewed as Python, every C++ and Java snippet of the corpus is a syntax error.
SQL["main_evaluate_rules"] = sql(base.RESULTS + """,
el AS (
  SELECT l.quality AS label, 0.0 AS latency_ms, CASE WHEN r.review_language <> 'python'
    OR r.n > 0 OR r.confidence > 40 THEN 1 ELSE 0 END AS p
  FROM rs r JOIN labels l ON l.doc_id = r.snippet_id)""", f"""
SELECT metric, rules FROM (UNPIVOT (SELECT {_metrics('p')} FROM el)
  ON COLUMNS(*) INTO NAME metric VALUE rules) WHERE NOT contains(metric, 'latency')""")

UNLABELED = base.RESULTS + """,
ul AS (
  SELECT r.*, r.review_language <> 'python' OR r.confidence = 95 AS failed
  FROM rs r JOIN corpus c USING (snippet_id) WHERE length(c.code) > 20)"""
SQL["main_evaluate_unlabeled"] = sql(UNLABELED + """,
el AS (
  SELECT CASE WHEN review_language = 'python' AND n > 0 THEN 1 ELSE 0 END AS label, 0.0 AS latency_ms,
    CASE WHEN review_language <> 'python' OR n > 0 OR confidence > 40 THEN 1 ELSE 0 END AS p FROM ul)""", f"""
SELECT metric, rules FROM (UNPIVOT (SELECT {_metrics('p')} FROM el)
  ON COLUMNS(*) INTO NAME metric VALUE rules) WHERE NOT contains(metric, 'latency')""")

SQL["main_classifier_rows"] = sql(WORST + """,
uc AS (
  SELECT CASE WHEN r.review_language = 'python' THEN r.first_name ELSE 'clean' END AS issue,
    CASE WHEN r.review_language = 'python' THEN wo.severity ELSE 'LOW' END AS severity
  FROM rs r JOIN corpus c USING (snippet_id) JOIN wo USING (snippet_id) WHERE length(c.code) > 20)""", """
SELECT 'issue' AS classifier, issue AS class, count(*) AS n FROM uc GROUP BY issue HAVING count(*) >= 2
UNION ALL SELECT 'severity', severity, count(*) FROM uc GROUP BY severity""")

# ---- review history ---------------------------------------------------------------------------------
LATEST = REVIEWS + """,
lt AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC,
         review_id DESC) AS place FROM rv)"""
SQL["rh_1_latest_reviews"] = sql(LATEST, f"SELECT {HISTORY} FROM lt WHERE place <= 50")
SQL["rh_1b_latest_reviews_of_user"] = sql(
    LATEST, f"SELECT {HISTORY} FROM lt WHERE place <= 50 AND user_id = 7")
SQL["rh_2_reviews_with_user"] = sql(REVIEWS, """
SELECT review_id, user_id, c_name AS username, filename FROM rv JOIN customer ON c_custkey = user_id""")
STATS = REVIEWS + """,
ws AS (
  SELECT user_id, count(*) AS total_reviews,
    sum(n_issues + syntax_error::INT)::BIGINT AS total_issues,
    floor(sum(score) / count(*) + 0.5)::INT AS avg_score, count(DISTINCT filename) AS unique_files,
    count(*) FILTER (us < 30 * 86400000000) AS recent_reviews
  FROM rv GROUP BY 1)"""
SQL["rh_3_workspace_stats"] = sql(STATS, "SELECT * FROM ws")
SQL["rh_3b_maintained_stats"] = SQL["rh_3_workspace_stats"]
SQL["rh_4_score_series"] = sql(LATEST, """
SELECT user_id, review_id,
  row_number() OVER (PARTITION BY user_id ORDER BY place DESC)::INT AS position,
  score::INT AS score FROM lt WHERE place <= 14""")
COUNTED = "n_issues || ' issue' || CASE WHEN n_issues > 1 THEN 's' ELSE '' END"
SQL["rh_5_status_tag"] = sql(REVIEWS, f"""
SELECT review_id, CASE WHEN syntax_error THEN 'Syntax Error' WHEN n_issues = 0 THEN 'Clean'
    ELSE {COUNTED} END AS tag,
  CASE WHEN syntax_error THEN 'Syntax error' WHEN n_issues = 0 THEN 'Fixed'
    ELSE {COUNTED} END AS label FROM rv""")
SQL["rh_6_date_buckets"] = sql(REVIEWS, f"""
SELECT CASE date_diff('day', created_at::DATE, DATE '{NOW[:10]}') WHEN 0 THEN 'Today'
    WHEN 1 THEN 'Yesterday' ELSE 'Earlier' END AS panel_bucket,
  CASE floor(us / 86400000000.0) WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday'
    ELSE 'Earlier' END AS app_bucket, count(*) AS n FROM rv GROUP BY 1, 2""")
SQL["rh_7_time_ago"] = sql(REVIEWS + """,
tm AS (SELECT review_id, us // 1000000 AS s,
         (epoch_ms(TIMESTAMP '%s') - epoch_ms(created_at)) // 60000 AS mi FROM rv)""" % NOW, """
SELECT review_id,
  CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago'
    WHEN s < 86400 THEN (s // 3600) || ' hr ago' ELSE (s // 86400) || ' day ago' END AS app,
  CASE WHEN mi < 60 THEN greatest(mi, 1) || ' min ago'
    WHEN mi < 1440 THEN (mi // 60) || ' hour' || CASE WHEN mi >= 120 THEN 's' ELSE '' END || ' ago'
    ELSE (mi // 1440) || ' day' || CASE WHEN mi >= 2880 THEN 's' ELSE '' END || ' ago'
  END AS sidebar,
  CASE WHEN mi < 60 THEN greatest(mi, 1) || 'm ago' WHEN mi < 1440 THEN (mi // 60) || 'h ago'
    ELSE (mi // 1440) || 'd ago' END AS workspace FROM tm""")
SQL["rh_8_filename_search"] = sql(REVIEWS, """
SELECT review_id, filename FROM rv WHERE contains(lower(filename), 'e_3.py')""")
SQL["rh_9_user_profile_stats"] = sql(STATS, """
SELECT c_custkey AS user_id, c_name AS username, coalesce(total_reviews, 0) AS total_reviews,
  coalesce(total_issues, 0) AS total_issues, coalesce(avg_score, 0) AS avg_score,
  coalesce(unique_files, 0) AS unique_files, coalesce(recent_reviews, 0) AS recent_reviews
FROM customer LEFT JOIN ws ON user_id = c_custkey""")

# ---- streaming and the node table --------------------------------------------------------------------
# A request without a file name is filed as untitled.py, so the C++ text that has
# none is reviewed as Python, which its second line is not.
SQL["st_1_review_stream"] = sql(base.RESULTS, """
SELECT snippet_id, snippet_id % 10 AS user_id,
  CASE WHEN c.filename IS NULL THEN 95.0 ELSE confidence END AS confidence,
  syntax_error OR c.filename IS NULL AS syntax_error, n::INT AS n_issues
FROM rs JOIN corpus c USING (snippet_id)""")
SQL["uf_1_node_table"] = sql(
    SNIP + ",\nnc(tid, names, calls, last_line) AS "
    + values([(t, *v) for t, v in golden.NODE_COUNTS.items()]),
    "SELECT snippet_id, names::BIGINT AS names, calls::BIGINT AS calls, last_line "
    "FROM snip JOIN nc USING (tid)")

# ---- over whole texts ------------------------------------------------------------
for _name in OVER_TEXTS:
    assert SNIP in SQL[_name]
    SQL[f"text_{_name}"] = SQL[_name].replace(SNIP, base.TEXT_SNIPPETS)
