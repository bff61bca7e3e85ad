"""Word lists, lookup tables, patterns and texts.

Everything here must have exactly these values for results to be right, so it
is stated plainly. Patterns are in Python regex notation; ``functions.text.rx``
turns one into the dialect of Spark's regex functions.
"""

# ---- languages -----------------------------------------------------------
SUPPORTED = ["python", "cpp", "java"]
ALIASES = {"py": "python", "c++": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp"}
REVIEW_EXTENSIONS = {
    "py": "python", "c": "cpp", "h": "cpp", "cpp": "cpp", "cxx": "cpp", "cc": "cpp",
    "hpp": "cpp", "java": "java",
}
CLEAN_EXTENSIONS = {
    "py": "python", "c": "cpp", "h": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "hpp": "cpp", "hxx": "cpp", "java": "java",
}
SOURCE_EXTENSIONS = ["c", "h", "cpp", "cc", "cxx", "hpp", "hxx"]
APP_UPLOAD_EXTENSIONS = {"cpp": "cpp", "cc": "cpp", "cxx": "cpp", "java": "java", "py": "python"}
DASHBOARD_REVIEW_EXTENSIONS = {
    "py": "python", "c": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "java": "java",
}
DASHBOARD_DISPLAY_EXTENSIONS = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript",
    "jsx": "javascript", "java": "java", "sql": "sql", "cpp": "cpp", "c": "cpp", "cs": "csharp",
}
CPP_HINT = r"#include\s*<|std::|using\s+namespace\s+std\b|\b(?:cout|cin)\s*<<|\bint\s+main\s*\("
JAVA_HINT = r"\bpublic\s+class\b|\bimport\s+java\.|\bSystem\.out\.println\s*\(|\bnew\s+Scanner\s*\("

# ---- sources -------------------------------------------------------------
SNIPPET_FIELDS = ["code", "docstring", "repo", "path", "language"]
JAVA_CSV_COLUMNS = ["snippet", "scode", "code", "source", "content"]
CODE_FIELDS = ["code", "func_code_string", "whole_func_string"]
COMPILER_LINE = {
    "cpp": r":(\d+):\d+:\s*(error|warning):\s*(.+)",
    "java": r":(\d+):\s*(error|warning):\s*(.+)",
}
COMPILER_NOISE = ["note:", "In function", "At global scope", "[-Wmain]", "unused variable"]

# ---- shared patterns ------------------------------------------------------
MODIFIERS = (r"(?:(?:public|private|protected|static|final|virtual|inline|constexpr|friend|"
             r"synchronized|native|abstract)\s+)*")
SIGNATURE = (r"^\s*" + MODIFIERS + r"([\w:<>\[\],*&]+)\s+([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(\{)?\s*$")
DECLARATION = (r"^\s*+(?:(?:public|private|protected|static|final|virtual|inline|"
               r"constexpr|synchronized|native|abstract)\s+)*"
               r"(?:[\w:<>\[\],*&]+)\s+([A-Za-z_]\w*)\s*\([^;{}]*\)\s*\{?\s*$")
# Possessive repeats that stop before the name: Java's matcher would recurse once for each word otherwise.
PANEL_FUNCTION = (r"^\s*+(?:[\w:<>\[\],*&]++\s++(?!\())++[A-Za-z_]\w*+\s*+"
                  r"\([^;{}]*\)\s*(?:\{|$)")
BRANCH = r"\b(?:if|else\s+if|for|while|case|catch)\b|&&|\|\|"
CALL = r"\b([A-Za-z_]\w*)\s*\("
LOOP = r"\b(?:for|while)\s*\("
IF = r"\bif\s*\("
TRY = r"\btry\s*\{"
DIV_ZERO = r"/\s*0(?:[^\d.]|$)"
INFINITE_LOOP = r"\bwhile\s*\(\s*true\s*\)|\bfor\s*\(\s*;\s*;\s*\)"
INPUT = {
    "python": r"\binput\s*\(",
    "cpp": r"\bcin\s*>>|\bgetline\s*\(",
    "java": r"\.next(?:Int|Line|Double|Long|Float|Boolean|Short|Byte)\s*\(|\breadLine\s*\(",
}
SORT = {
    "python": r"\.sort\s*\(",
    "cpp": r"\bsort\s*\(",
    "java": r"\b(?:Arrays|Collections)\.sort\s*\(",
}
ALLOC = {
    "python": r"\bopen\s*\(",
    "cpp": r"\b(?:malloc|calloc|realloc)\s*\(|\bnew\b",
    "java": r"\bnew\s+(?:Scanner|BufferedReader|FileInputStream|FileReader|InputStreamReader)\b",
}
RELEASE = {
    "python": r"\.close\s*\(",
    "cpp": r"\bfree\s*\(|\bdelete\b",
    "java": r"\.close\s*\(",
}
RISKY = {
    "python": r"\b(?:eval|exec)\s*\(",
    "cpp": r"\b(?:gets|strcpy)\s*\(",
    "java": r"\bcatch\s*\(\s*Exception\b",
}

# ---- C++ / Java line and file patterns -------------------------------------
RETURN_NO_SEMICOLON = r"^\s*return\b[^;{}]*$"
STATEMENT_NO_SEMICOLON = (r"^(?!\s*(?:if|else\s+if|for|while|do|switch|catch)\s*\()"
                          r"(?!\s*(?:public|private|protected)\s*:).*\)\s*$")
LITERAL_NO_SEMICOLON = r"""["']\s*$"""
ASSIGN_IN_CONDITION = r"\bif\s*\(\s*[A-Za-z_]\w*\s*=[^=<>!&|]"
ENDL = r"<<\s*(?:std::)?endl\b"
POW_TO_INT = r"\b(?:int|long)\b[^;()\n]*=\s*[^;()\n]*\bpow\s*\("
CPP_OVERFLOW = (r"\bint\b[^;\n]*=\s*[^;\n]*\b"
                r"(?:[2-9]\d{9,}|1\d{10,}|\d+\s*\*\s*\d+[eE]\d+)\b")
JAVA_OVERFLOW = (r"\bint\b[^;\n]*=\s*[^;\n]*\*[^;\n]*\b"
                 r"(?:\d{5,}|[a-zA-Z]\w*\s*\*\s*[a-zA-Z]\w*)\b")
CPP_FILE_OVERFLOW = r"\bint\b[^;\n]*=\s*[^;\n]*\b(?:1000000000|1e9|2e9|1e10)\b"
JAVA_STRING_EQ = r'(?:==|!=)\s*"[^"]*"'
JAVA_STRING_WORD = r"\bString\b"
JAVA_CONCAT_ADD = r'\b\w+\s*\+=\s*(?:"[^"]*"|\w)'
JAVA_CONCAT_SET = r'\b\w+\s*=\s*\w+\s*\+\s*(?:"|\w)'
PRINTF = r"\b(?:printf|scanf|puts|fputs|fprintf)\s*\("
COUT = r"\b(?:cout|cin)\s*(?:<<|>>)"
SYNC_OFF = r"sync_with_stdio\s*\(\s*false\s*\)"
EMPTY_CATCH = r"\bcatch\s*\([^)]*\)\s*\{\s*\}"
JAVA_DEREF = r"\.length\(\)|\.size\(\)|\.get\("
JAVA_NULL_TEST = r"(?:==|!=)\s*null|null\s*(?:==|!=)"
JAVA_NULL_WORD = r"\bnull\b"
SWITCH_OPEN = r"\bswitch\s*\("
SWITCH_CASE = r"^\s*(?:case\b.+|default\s*):\s*$|^\s*(?:case\b.+|default\s*):\s*\S"
SWITCH_BREAK = r"\b(?:break|return|throw|continue|goto)\b"
RETURN_WORD = r"\breturn\b"
GUARD_WORD = r"\b(?:if|switch)\b"
ARRAY_INIT = {
    "cpp": r"\b\w+\s+(\w+)\s*\[\s*\]\s*=\s*\{([^}]*)\}",
    "java": r"\b\w+\s*\[\s*\]\s+(\w+)\s*=\s*\{([^}]*)\}",
}
ARRAY_SIZE = {
    "cpp": r"\b\w+\s+(\w+)\s*\[\s*(\d+)\s*\]",
    "java": r"\b\w+\s*\[\s*\]\s+(\w+)\s*=\s*new\s+\w+\s*\[\s*(\d+)\s*\]",
}
ARRAY_ACCESS = r"\b(\w+)\s*\[\s*(\d+)\s*\]"
RECENT_LINES = 6

# ---- Python rule word lists -------------------------------------------------
SHADOWED_BUILTINS = [
    "list", "dict", "set", "tuple", "str", "int", "float", "bool",
    "len", "range", "sum", "min", "max", "sorted", "reversed",
    "print", "input", "type", "map", "filter", "zip", "enumerate",
    "abs", "round", "any", "all", "next", "iter", "hash",
]
MUTATING_METHODS = ["append", "remove", "pop", "insert", "extend", "clear", "discard"]
SELF_METHODS = ["__init__", "__new__", "__str__", "__repr__", "__len__", "__eq__", "__lt__",
                "__hash__"]

# ---- feature names ---------------------------------------------------------
FEATURES = [
    "num_lines", "num_funcs", "num_loops", "num_ifs", "num_try", "div_zero_hits",
    "infinite_loop_hits", "input_ops", "sort_ops", "alloc_ops", "release_ops", "risky_api_ops",
]
RICH_FEATURES = [
    "lines_of_code", "num_functions", "nesting_depth", "cyclomatic_complexity", "num_loops",
    "num_conditions", "function_length_avg", "recursion_detected", "unused_variables_count",
]

# ---- ranking and severities --------------------------------------------------
RANK_0 = ["Possible Infinite Loop", "Division by zero", "Recursion without base case",
          "Compiler Error", "Unsafe C function", "Possible missing semicolon",
          "Array index out of bounds"]
RANK_1 = ["Wrong argument count", "Nested loop (possible O(n^2))",
          "High Time Complexity (TLE risk)", "Modifying collection while iterating",
          "Return inside finally", "Assignment in condition", "String compared with ==",
          "Integer overflow risk", "Missing break in switch case",
          "Possible NullPointerException", "Possible memory leak", "Possible None dereference"]
APP_CRITICAL = ["infinite loop", "syntax", "division by zero", "recursion"]
APP_WARNING = ["tle", "nested", "complexity", "sorting", "input inside"]
PANEL_CRITICAL = ["infinite", "division by zero", "syntax", "recursion", "missing semicolon",
                  "compiler error", "compiler warning"]
PANEL_WARNING = ["complexity", "nested", "tle", "sorting", "input inside", "memory leak",
                 "resource", "without returning"]
SEVERITY_ORDER = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

# ---- model settings ----------------------------------------------------------
THRESHOLD_BETA = {"python": 1.0, "cpp": 1.0, "java": 2.0}
SEARCH_BETA = {"python": 1.0, "cpp": 1.0, "java": 2.0}
MIN_RECALL = {"java": 0.70}
FOREST_GRID = {
    "num_trees": [200, 300, 500, 700],
    "max_depth": [None, 8, 12, 20, 30],
    "min_split": [2, 4, 8, 12],
    "min_leaf": [1, 2, 4, 6],
    "features": ["sqrt", "log2", "all"],
}
