"""Issue names and fix texts, by rule.

Fixed values: texts that must be equal for equal results. ``{0}``, ``{1}`` ...
stand for values found in the snippet.
"""

ISSUE_TEXTS = {
    # C++ / Java
    "CJ-1": ("Nested loop (possible O(n^2))",
             "Consider flattening the loops or using a faster lookup structure."),
    "CJ-2": ("Possible Infinite Loop",
             "Add a termination condition or break path inside the loop."),
    "CJ-3": ("Division by zero", "Guard the denominator before dividing."),
    "CJ-4": ("Input inside loop",
             "Read input before the loop or buffer it to reduce repeated I/O."),
    "CJ-5": ("Sorting inside loop",
             "Move sorting outside the loop or keep the data structure ordered."),
    "CJ-6": ("Possible missing semicolon", "Terminate the return statement with a semicolon."),
    "CJ-7": ("Possible missing semicolon", "Add a semicolon at the end of the statement."),
    "CJ-8": ("Possible missing semicolon", "Add a semicolon at the end of the statement."),
    "CJ-9": ("Assignment in condition",
             "Found '=' inside an if condition — did you mean '==' for comparison?"),
    "CJ-10": ("endl inside loop (slow flush)",
              "std::endl flushes the output buffer on every call. "
              "Use '\"\\n\"' inside loops to avoid TLE."),
    "CJ-11": ("pow() result stored in integer",
              "pow() returns a double. Storing it in int/long can cause wrong answers due to "
              "floating-point truncation. Use a custom integer power function instead."),
    "CJ-12": ("Unsafe C function",
              "gets() and strcpy() are unsafe — they do not check buffer bounds. "
              "Use fgets() and strncpy() / std::string instead."),
    "CJ-13": ("String compared with ==",
              "In Java, == checks object identity, not string content. "
              "Use .equals() or .equalsIgnoreCase() to compare strings."),
    "CJ-14": ("String concatenation in loop",
              "String concatenation with '+=' inside a loop creates a new object each iteration "
              "(O(n²)). Use StringBuilder.append() and call .toString() at the end."),
    "CJ-15": ("Catching broad Exception",
              "Catching Exception is too broad and may hide bugs. "
              "Catch specific exceptions like IOException, ArithmeticException, etc."),
    "CJ-16": ("Integer overflow risk",
              "This value may overflow a 32-bit int. "
              "Use 'long long' for values that can exceed ~2.1 billion."),
    "CJ-17": ("Integer overflow risk",
              "Multiplying two ints may overflow before being stored. "
              "Cast to long first: (long) a * b."),
    "CJ-18": ("Integer overflow risk",
              "Assigning 1e9 or larger to 'int' may overflow (max ~2.1B). "
              "Use 'long long' for large values."),
    "CJ-19": ("Missing break in switch case",
              "This case falls through to the next case. "
              "Add 'break;' to prevent unintended fall-through."),
    "CJ-20": ("Mixed printf and cout",
              "Mixing printf/scanf with cout/cin without 'ios::sync_with_stdio(false)' can cause "
              "garbled output. Use one I/O style consistently."),
    "CJ-21": ("Empty catch block",
              "Swallowing exceptions silently makes debugging impossible. "
              "Log the error or re-throw."),
    "CJ-22": ("Possible NullPointerException",
              "Objects are used without a null check. "
              "Verify that references are non-null before calling methods on them."),
    "CJ-23": ("Possible memory leak",
              "Release allocated memory with the matching cleanup call on every path."),
    "CJ-24": ("Resource may not be closed",
              "Close scanners/readers in a finally block or use try-with-resources."),
    "CJ-25": ("Function may exit without returning a value",
              "Return a value on every control path for non-void functions."),
    "CJ-26": ("Recursion without base case", "Add a guard condition before the recursive call."),
    "CJ-27": ("Array index out of bounds",
              "'{0}' has {1} element(s) (valid indices 0–{2}), but index {3} is accessed. "
              "This will throw an {4} at runtime. Check the array size before accessing."),
    "CJ-28": ("High Time Complexity (TLE risk)",
              "Reduce loop nesting or use a more efficient algorithm/data structure."),
    # Python
    "PY-1": ("Possible Infinite Loop", "Add a break condition or update the loop predicate."),
    "PY-2": ("Division by zero", "Check the denominator before dividing."),
    "PY-3": ("Input inside loop", "Move input collection outside the loop when possible."),
    "PY-4": ("Sorting inside loop",
             "Sort once before the loop or use a better data structure."),
    "PY-5": ("Nested loop (possible O(n^2))",
             "Reduce nested iteration or add indexing/cache-based lookups."),
    "PY-6": ("Function has no return",
             "Return a value explicitly or make the function's side effects clear."),
    "PY-7": ("Recursion without base case",
             "Add a terminating condition before making the recursive call."),
    "PY-8": ("Loop variable overwrite",
             "'{0}' is overwritten each iteration instead of accumulated. "
             "Did you mean '{0} += ...' or include '{0}' on the right-hand side?"),
    "PY-9a": ("Wrong argument count",
              "'{0}' expects {1} argument(s) but {2} were given. "
              "See function definition at line {3}."),
    "PY-9b": ("Wrong argument count",
              "'{0}' expects at most {1} argument(s) but {2} were given. "
              "See function definition at line {3}."),
    "PY-10": ("Mutable default argument",
              "'{0}' uses a mutable default (list/dict/set). The same object is shared "
              "across all calls — use None as default and initialize inside the function."),
    "PY-11a": ("Shadowing built-in name",
               "'{0}' shadows a Python built-in. Rename this variable to avoid subtle bugs."),
    "PY-11b": ("Shadowing built-in name",
               "Function '{0}' shadows a Python built-in. Use a different name."),
    "PY-12": ("None comparison with ==",
              "Use 'is None' / 'is not None' instead of '== None' / '!= None'."),
    "PY-13": ("Identity check on literal",
              "'is {0}' tests object identity, not value equality. Use '== {0}'."),
    "PY-14": ("Float equality comparison",
              "Comparing floats with == is unreliable due to floating-point precision. "
              "Use abs(a - b) < epsilon instead."),
    "PY-15": ("Nested loop variable shadowing",
              "Inner loop reuses loop variable '{0}' from the outer loop — "
              "this shadows the outer variable and will cause incorrect behavior."),
    "PY-16": ("Unreachable code after return",
              "Statements after 'return' on line {0} will never execute."),
    "PY-17": ("Missing return in branch",
              "One branch of this if/else returns a value but the other doesn't — "
              "the function may silently return None."),
    "PY-18": ("Modifying collection while iterating",
              "Calling '.{0}()' on '{1}' while iterating over it can skip elements "
              "or cause errors. Iterate over a copy: 'for x in {1}[:]:'."),
    "PY-19": ("Bare except clause",
              "A bare 'except:' catches all exceptions including SystemExit and "
              "KeyboardInterrupt. Catch specific exceptions or use 'except Exception:'."),
    "PY-20": ("Return inside finally",
              "'return' inside a 'finally' block suppresses any exception being propagated. "
              "Move the return outside the try/finally."),
    "PY-21": ("Boolean compared with == True/False",
              "Use '{0}' directly instead of '== {1}' — "
              "it is cleaner and avoids subtle type-coercion bugs."),
    "PY-22": ("Missing self in method",
              "'{0}' should have 'self' as its first parameter. "
              "Without it, calling the method will raise TypeError."),
    "PY-23": ("Missing global declaration",
              "'{0}' is a module-level variable. "
              "Add 'global {0}' at the top of '{1}' to modify it; "
              "otherwise a new local variable is created instead."),
    "PY-24": ("Unreachable code after break/continue",
              "Statements after '{0}' on line {1} will never execute. "
              "Remove the dead code or restructure the loop."),
    "PY-25": ("Unused variable",
              "'{0}' is assigned but never used. Remove it or use it. "
              "Prefix with '_' if intentionally unused."),
    # The {node.value.id} part is literal text, not a value.
    "PY-26": ("Possible None dereference",
              "'{0}' was assigned None but '.{1}' is accessed on it "
              "without a None check. Add: if {node.value.id} is not None: ..."),
}

OUT_OF_BOUNDS_KIND = {"cpp": "out-of-bounds error", "java": "ArrayIndexOutOfBoundsException"}
