"""Building blocks of the DuckDB checks: the corpus and tables derived from it."""

from __future__ import annotations

from oracles import golden
from reviewlake.functions import fixed
from reviewlake.plans.corpus import TEMPLATES


def lit(value) -> str:
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def case(column: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def m(column: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({column}, {lit(pattern)}" + (f", '{flags}')" if flags else ")")


def plain(pattern: str) -> str:
    """The pattern without possessive repeats and the look-ahead that they need, which DuckDB does not know."""
    return pattern.replace("*+", "*").replace("++", "+").replace(r"(?!\()", "")


def cnt(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {lit(pattern)}))"


def per_lang(table: dict, column: str, fn) -> str:
    return ("CASE review_language " + " ".join(
        f"WHEN '{k}' THEN {fn(column, table[k])}" for k in ("cpp", "java")) + " END")


EXT = ("CASE WHEN contains(filename, '.') THEN lower(list_extract(string_split(filename, '.'), -1))"
       " END")
DECLARED = ("CASE WHEN language = '' THEN NULL ELSE coalesce("
            + case("lower(trim(language))", fixed.ALIASES) + ", lower(trim(language))) END")
FROM_NAME = case(EXT, fixed.REVIEW_EXTENSIONS)
FROM_CODE = (f"CASE WHEN {m('code', fixed.CPP_HINT, 'i')} THEN 'cpp' "
             f"WHEN {m('code', fixed.JAVA_HINT, 'i')} THEN 'java' END")
SUPPORTED = "('python', 'cpp', 'java')"
REVIEW_LANGUAGE = (f"coalesce({FROM_NAME}, CASE WHEN {DECLARED} IN {SUPPORTED} THEN {DECLARED} END,"
                   f" {FROM_CODE}, 'python')")
BASE_NAME = "list_extract(string_split(path, '/'), -1)"
SUFFIX = f"lower(nullif(regexp_extract({BASE_NAME}, '^.+\\.([^.]+)$', 1), ''))"
FROM_PATH = case(SUFFIX, fixed.CLEAN_EXTENSIONS)

CORPUS = ("tmpl(tid, language, filename, path, body) AS "
          + values([(i, *t) for i, t in enumerate(TEMPLATES)])
          + f""",
corpus AS (
  SELECT d.doc_id AS snippet_id, replace(t.body, '@N', CAST(d.n_chars AS VARCHAR)) AS code,
         d.source AS repo, t.path, t.language, t.filename, t.tid, d.n_chars
  FROM documents d JOIN tmpl t ON d.doc_id % {len(TEMPLATES)} = t.tid)""")

SNIPPETS = CORPUS + f""",
snip AS (SELECT *, {REVIEW_LANGUAGE} AS review_language FROM corpus)"""

# The same columns from whole texts in front of the templates.
TEXT_SNIPPETS = "tmpl(tid, body) AS " + values([(i, t[3]) for i, t in enumerate(TEMPLATES)]) + f""",
texts AS (
  SELECT doc_id AS snippet_id, doc_id % {len(TEMPLATES)} AS tid, text FROM documents
  UNION ALL
  SELECT 1000000000 + conv_id * 1000 + turn, conv_id % {len(TEMPLATES)}, text FROM conversations),
snip AS (
  SELECT snippet_id, tid, replace(text, '. ', ';' || chr(10)) || chr(10) || replace(body, '@N', '7') AS code,
         CASE WHEN snippet_id % 2 = 0 THEN 'cpp' ELSE 'java' END AS review_language
  FROM texts JOIN tmpl USING (tid))"""

CLEAN = SNIPPETS + """,
cl AS (
  SELECT snippet_id, tid, review_language, code,
         regexp_replace(regexp_replace(code, '/\\*.*?\\*/', '', 'gs'), '//[^\\n]*', '', 'g') AS clean
  FROM snip WHERE review_language IN ('cpp', 'java'))"""

LINES = CLEAN + """,
raw_lines AS (
  SELECT snippet_id, review_language, clean, unnest(string_split(clean, chr(10))) AS raw,
         unnest(range(1, len(string_split(clean, chr(10))) + 1)) AS n
  FROM cl),
ln AS (
  SELECT snippet_id, review_language, clean, n, trim(raw) AS line FROM raw_lines
  WHERE trim(raw) <> '')"""

BLANKED = ("regexp_replace(line, '(\")(?:[^\"\\\\]|\\\\.)*\\\\?(\"?)|('')(?:[^''\\\\]|\\\\.)*\\\\?(''?)',"
           " '\\1\\2\\3\\4', 'g')")

CONTROL = r"^\s*(?:if|else\s+if|for|while|do|switch|catch)\s*\("
ACCESS = r"^\s*(?:public|private|protected)\s*:"

FLAGS = LINES + f""",
lb AS (SELECT *, {BLANKED} AS blanked,
              {m('line', fixed.LOOP)} AS has_loop FROM ln),
lf AS (
  SELECT *,
    coalesce(max(has_loop::INT) OVER (PARTITION BY snippet_id ORDER BY n
             RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) = 1 AS loop_before,
    max(has_loop::INT) OVER (PARTITION BY snippet_id ORDER BY n
             RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) = 1 AS loop_upto
  FROM lb)"""

LINE_TESTS = {
    "CJ-1": "has_loop AND loop_before",
    "CJ-2": m("line", fixed.INFINITE_LOOP),
    "CJ-3": m("line", fixed.DIV_ZERO),
    "CJ-4": "loop_upto AND " + per_lang(fixed.INPUT, "line", m),
    "CJ-5": "loop_upto AND " + per_lang(fixed.SORT, "line", m),
    "CJ-6": m("line", fixed.RETURN_NO_SEMICOLON),
    # The two negative look-aheads, written as separate tests.
    "CJ-7": f"{m('line', r'^.*\)\s*$')} AND NOT {m('line', CONTROL)} AND NOT {m('line', ACCESS)}",
    "CJ-8": f"{m('blanked', fixed.LITERAL_NO_SEMICOLON)} AND NOT starts_with(blanked, '#')",
    "CJ-9": m("line", fixed.ASSIGN_IN_CONDITION),
    "CJ-10": "review_language = 'cpp' AND loop_upto AND " + m("line", fixed.ENDL),
    "CJ-11": "review_language = 'cpp' AND " + m("line", fixed.POW_TO_INT),
    "CJ-12": "review_language = 'cpp' AND " + m("line", fixed.RISKY["cpp"]),
    "CJ-13": "review_language = 'java' AND " + m("blanked", fixed.JAVA_STRING_EQ),
    "CJ-14": ("review_language = 'java' AND loop_upto AND " + m("clean", fixed.JAVA_STRING_WORD)
              + f" AND ({m('line', fixed.JAVA_CONCAT_ADD)} OR {m('line', fixed.JAVA_CONCAT_SET)})"),
    "CJ-15": "review_language = 'java' AND " + m("line", fixed.RISKY["java"]),
    "CJ-16": "review_language = 'cpp' AND " + m("line", fixed.CPP_OVERFLOW),
    "CJ-17": "review_language = 'java' AND " + m("line", fixed.JAVA_OVERFLOW),
}

FILE_TESTS = {
    "CJ-18": "review_language = 'cpp' AND " + m("clean", fixed.CPP_FILE_OVERFLOW),
    "CJ-20": (f"review_language = 'cpp' AND {m('clean', fixed.PRINTF)} AND {m('clean', fixed.COUT)}"
              f" AND NOT {m('clean', fixed.SYNC_OFF)}"),
    "CJ-21": m("clean", fixed.EMPTY_CATCH),
    "CJ-22": (f"review_language = 'java' AND {m('clean', fixed.JAVA_DEREF)} AND NOT "
              f"{m('clean', fixed.JAVA_NULL_TEST)} AND {m('clean', fixed.JAVA_NULL_WORD)}"),
    "CJ-23": (f"review_language = 'cpp' AND {m('clean', fixed.ALLOC['cpp'])} AND NOT "
              f"{m('clean', fixed.RELEASE['cpp'])}"),
    "CJ-24": (f"review_language = 'java' AND {m('clean', fixed.ALLOC['java'])} AND NOT "
              f"{m('clean', fixed.RELEASE['java'])}"),
}

# Switch blocks line by line: depth, depth of the open switch (0: none), last
# case, and whether it has been left.
SWITCH = LINES + f""",
sl AS (
  SELECT snippet_id, row_number() OVER (PARTITION BY snippet_id ORDER BY n) AS i, n,
         len(line) - len(replace(line, '{{', '')) - len(line) + len(replace(line, '}}', '')) AS d,
         {m('line', fixed.SWITCH_OPEN)} AS sw, {m('line', fixed.SWITCH_CASE)} AS cs,
         {m('line', fixed.SWITCH_BREAK)} AS br
  FROM ln),
st(snippet_id, i, depth, base, last_case, done, reported) AS (
  SELECT DISTINCT snippet_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, true, NULL::BIGINT
  FROM sl
  UNION ALL
  SELECT snippet_id, i, depth, CASE WHEN closing THEN 0 ELSE opened END,
    CASE WHEN closing THEN NULL WHEN a_case THEN n ELSE last_case END,
    CASE WHEN closing THEN true WHEN a_break THEN true WHEN a_case THEN false ELSE done END,
    CASE WHEN (closing OR a_case) AND NOT done THEN last_case END
  FROM (
    SELECT *, opened <> 0 AND depth < opened AS closing,
           opened <> 0 AND depth >= opened AND cs AS a_case,
           opened <> 0 AND depth >= opened AND br AS a_break
    FROM (
      SELECT s.snippet_id, l.i, l.n, l.cs, l.br, s.depth + l.d AS depth, s.last_case, s.done,
             CASE WHEN l.sw THEN s.depth + l.d ELSE s.base END AS opened
      FROM st s JOIN sl l ON l.snippet_id = s.snippet_id AND l.i = s.i + 1)))"""

# Function extents by comparing each function with every later line.
FUNCTIONS = LINES + f""",
sig AS (
  SELECT snippet_id, n, line,
    len(line) - len(replace(line, '{{', '')) AS o, len(line) - len(replace(line, '}}', '')) AS c,
    len(line) - len(ltrim(line, '}}')) AS lead,
    {m('line', fixed.SIGNATURE)} AND regexp_extract(line, {lit(fixed.SIGNATURE)}, 1) <> 'void'
      AS is_func,
    regexp_extract(line, {lit(fixed.SIGNATURE)}, 2) AS fname,
    regexp_extract(line, {lit(fixed.SIGNATURE)}, 3) AS brace
  FROM ln),
dep AS (
  SELECT *, after - o + c AS before, greatest(0, after - o + c - lead) AS cur
  FROM (SELECT *, sum(o - c) OVER (PARTITION BY snippet_id ORDER BY n) AS after FROM sig)),
fn AS (
  SELECT f.snippet_id, f.fname, f.n AS start, w.n AS opening, w.cur + 1 AS body, w.after
  FROM dep f JOIN dep w ON w.snippet_id = f.snippet_id AND w.n = (
    CASE WHEN f.brace = '{{' THEN f.n ELSE (
      SELECT min(x.n) FROM dep x WHERE x.snippet_id = f.snippet_id AND x.n > f.n AND x.o > 0) END)
  WHERE f.is_func AND (f.brace = '{{' OR NOT EXISTS (
    SELECT 1 FROM dep y WHERE y.snippet_id = f.snippet_id AND y.n > f.n AND y.n < w.n
      AND y.is_func AND y.brace <> '{{'))),
ext AS (
  SELECT fn.*, CASE WHEN after < body THEN opening ELSE coalesce((
      SELECT min(CASE WHEN d.cur < body THEN d.n - 1 ELSE d.n END) FROM dep d
      WHERE d.snippet_id = fn.snippet_id AND d.n > opening
        AND (d.cur < body OR d.after < body)), 1000000) END AS stop
  FROM fn),
fun AS (
  SELECT e.snippet_id, e.start,
    coalesce(bool_or({m('d.line', fixed.RETURN_WORD)}), false) AS has_return,
    coalesce(bool_or({m('d.line', fixed.GUARD_WORD)}), false) AS has_guard,
    coalesce(bool_or(regexp_matches(d.line, '\\b' || e.fname || '\\s*\\(')), false) AS calls_self
  FROM ext e LEFT JOIN dep d ON d.snippet_id = e.snippet_id AND d.n > e.opening AND d.n <= e.stop
  GROUP BY e.snippet_id, e.start, e.fname)"""

# Array sizes and accesses.
ARRAYS = LINES + f""",
decl AS (
  SELECT snippet_id, n, 0 AS k,
    {per_lang(fixed.ARRAY_INIT, 'line', lambda c, p: f"regexp_extract({c}, {lit(p)}, 1)")} AS name,
    len(list_filter(string_split({per_lang(fixed.ARRAY_INIT, 'line',
        lambda c, p: f"regexp_extract({c}, {lit(p)}, 2)")}, ','), lambda x: trim(x) <> '')) AS size
  FROM ln
  UNION ALL
  SELECT snippet_id, n, 1,
    {per_lang(fixed.ARRAY_SIZE, 'line', lambda c, p: f"regexp_extract({c}, {lit(p)}, 1)")},
    try_cast({per_lang(fixed.ARRAY_SIZE, 'line',
        lambda c, p: f"regexp_extract({c}, {lit(p)}, 2)")} AS BIGINT)
  FROM ln),
size AS (
  SELECT snippet_id, name, arg_max(size, n * 2 + k) AS size FROM decl WHERE name <> ''
  GROUP BY snippet_id, name),
acc AS (
  SELECT snippet_id, review_language, n,
    unnest(regexp_extract_all(line, {lit(fixed.ARRAY_ACCESS)}, 1)) AS name,
    CAST(unnest(regexp_extract_all(line, {lit(fixed.ARRAY_ACCESS)}, 2)) AS BIGINT) AS idx
  FROM ln)"""

C_FEATURES = CLEAN + f""",
fc AS (
  SELECT snippet_id, review_language,
    greatest(1, len(string_split(rtrim(code, chr(10)), chr(10)))) AS num_lines,
    {m('clean', fixed.SIGNATURE)}::INT AS num_funcs,
    {cnt('clean', fixed.LOOP)} AS num_loops, {cnt('clean', fixed.IF)} AS num_ifs,
    {cnt('clean', fixed.TRY)} AS num_try, {cnt('clean', fixed.DIV_ZERO)} AS div_zero_hits,
    {cnt('clean', fixed.INFINITE_LOOP)} AS infinite_loop_hits,
    {per_lang(fixed.INPUT, 'clean', cnt)} AS input_ops,
    {per_lang(fixed.SORT, 'clean', cnt)} AS sort_ops,
    {per_lang(fixed.ALLOC, 'clean', cnt)} AS alloc_ops,
    {per_lang(fixed.RELEASE, 'clean', cnt)} AS release_ops,
    {per_lang(fixed.RISKY, 'clean', cnt)} AS risky_api_ops
  FROM cl)"""

FEATURES = C_FEATURES + ",\npc(tid, nf, nl, ni, nt) AS " + values(
    [(t, *c) for t, c in golden.PYTHON_COUNTS.items()]) + f""",
fp AS (
  SELECT snippet_id, review_language,
    len(string_split(rtrim(code, chr(10)), chr(10))) AS num_lines,
    nf AS num_funcs, nl AS num_loops, ni AS num_ifs, nt AS num_try,
    {cnt('code', fixed.DIV_ZERO)} AS div_zero_hits,
    {cnt('code', fixed.INFINITE_LOOP)} AS infinite_loop_hits,
    {cnt('code', fixed.INPUT['python'])} AS input_ops,
    {cnt('code', fixed.SORT['python'])} AS sort_ops,
    {cnt('code', fixed.ALLOC['python'])} AS alloc_ops,
    {cnt('code', fixed.RELEASE['python'])} AS release_ops,
    {cnt('code', fixed.RISKY['python'])} AS risky_api_ops
  FROM snip JOIN pc USING (tid) WHERE review_language = 'python'),
fa AS (SELECT * FROM fc UNION ALL SELECT * FROM fp)"""

GOLDEN = (",\ng(tid, seq, rule, name, line, fix) AS " + values(golden.issue_rows()) + """,
gi AS (
  SELECT c.snippet_id, g.seq, g.rule, g.name, g.line,
    replace(replace(g.fix, '@N', CAST(c.n_chars AS VARCHAR)), '@M',
            CAST(c.n_chars - 1 AS VARCHAR)) AS fix
  FROM corpus c JOIN g USING (tid)),
se(tid, error_line, error_msg) AS """ + values(
    [(t, *e) for t, e in golden.SYNTAX_ERRORS.items()]))

RANK = (f"CASE WHEN name IN ({', '.join(map(lit, fixed.RANK_0))}) THEN 0 "
        f"WHEN name IN ({', '.join(map(lit, fixed.RANK_1))}) THEN 1 ELSE 2 END")

RANKED = FEATURES + GOLDEN + f""",
rk AS (
  SELECT *, {RANK} AS rank,
    row_number() OVER (PARTITION BY snippet_id ORDER BY {RANK}, line, seq) AS position
  FROM gi)"""

RESULTS = RANKED + """,
agg AS (
  SELECT snippet_id, count(*) AS n,
    string_agg(name || '@' || line || ':' || fix, '|' ORDER BY position) AS issues,
    arg_min(name, position) AS first_name
  FROM rk GROUP BY snippet_id),
rs AS (
  SELECT s.snippet_id, s.review_language, s.tid, coalesce(a.n, 0) AS n, coalesce(a.issues, '') AS issues,
    coalesce(a.first_name, 'clean') AS first_name, se.error_line, se.error_msg,
    se.tid IS NOT NULL AS syntax_error,
    CASE WHEN se.tid IS NOT NULL AND s.review_language = 'python' THEN 95.0
         WHEN se.tid IS NOT NULL THEN 92.0
         WHEN coalesce(a.n, 0) >= 2 THEN least(95, a.n * 18 + f.num_loops * 10 + f.num_ifs * 4)
         WHEN coalesce(a.n, 0) = 0 AND f.num_loops <= 1 AND f.num_ifs <= 2
           THEN f.num_loops * 8 + f.num_ifs * 3
         ELSE least(95, coalesce(a.n, 0) * 16 + f.num_loops * 10 + f.num_ifs * 4)
    END::DOUBLE AS confidence,
    CASE WHEN se.tid IS NOT NULL THEN 1 ELSE greatest(1, f.num_loops) END AS complexity
  FROM snip s JOIN fa f USING (snippet_id) LEFT JOIN agg a USING (snippet_id)
  LEFT JOIN se ON se.tid = s.tid)"""


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def recursive(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"
