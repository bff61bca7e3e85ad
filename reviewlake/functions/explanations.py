"""Explanation table: one row per issue name."""

# Texts that must be equal for equal results.
# (issue name, severity, explanation, fix), in lookup order.
TEMPLATES = [
    ("Possible Infinite Loop", "CRITICAL",
     "A loop with no termination condition will run forever, hanging the program.",
     "Add a break condition inside the loop body, or make the loop predicate eventually False."),
    ("Division by zero", "CRITICAL",
     "Dividing by zero causes ZeroDivisionError (Python) or undefined behavior (C++) at runtime.",
     "Guard the denominator: if divisor != 0: ... or use a conditional expression."),
    ("Recursion without base case", "CRITICAL",
     "A recursive function without a base case will recurse infinitely until the stack overflows.",
     "Add a terminating condition at the start of the function before the recursive call."),
    ("Compiler Error", "CRITICAL",
     "The code contains a syntax or semantic error that prevents compilation.",
     "Fix the reported compiler error before running the program."),
    ("Unsafe C function", "CRITICAL",
     "gets() and strcpy() do not check buffer bounds, making them vulnerable to buffer overflow.",
     "Replace gets() with fgets() and strcpy() with strncpy() or std::string."),
    ("Possible missing semicolon", "CRITICAL",
     "A statement appears to be missing its terminating semicolon, causing a compile error.",
     "Add a semicolon at the end of the statement."),
    ("Array index out of bounds", "CRITICAL",
     "An array is accessed at a literal index that exceeds its declared size, causing a runtime crash (ArrayIndexOutOfBoundsException in Java, undefined behaviour in C++).",
     "Use a valid index within the array bounds (0 to length-1), or check the index before accessing."),
    ("Wrong argument count", "HIGH",
     "Calling a function with the wrong number of arguments causes a TypeError at runtime.",
     "Match the argument count to the function definition, or add default parameters."),
    ("Nested loop (possible O(n^2))", "HIGH",
     "Nested loops over the same data are often O(n²), causing TLE on large inputs.",
     "Use a hash map for O(1) lookups, sorting + two pointers, or prefix sums to remove nesting."),
    ("High Time Complexity (TLE risk)", "HIGH",
     "Three or more nested loops create O(n³) or worse complexity — will TLE on large inputs.",
     "Reduce loop nesting using efficient data structures (segment trees, Fenwick trees) or math."),
    ("Modifying collection while iterating", "HIGH",
     "Mutating a list or dict while iterating can skip elements, raise RuntimeError, or give wrong results.",
     "Iterate over a copy: 'for x in lst[:]:', or collect changes and apply after the loop."),
    ("Return inside finally", "HIGH",
     "A return in a finally block silently discards any propagating exception, masking real errors.",
     "Move the return outside the try/finally block and use finally only for cleanup."),
    ("Assignment in condition", "HIGH",
     "Using '=' instead of '==' in a condition assigns a value rather than comparing — likely wrong.",
     "Replace '=' with '==' for comparison. Wrap in extra parentheses if the assignment is intentional."),
    ("String compared with ==", "HIGH",
     "In Java, '==' checks object identity (memory address), not string content equality.",
     "Use .equals() for value comparison: if (s1.equals(s2)). Use .equalsIgnoreCase() for case-insensitive."),
    ("Integer overflow risk", "HIGH",
     "A 32-bit int overflows at ~2.1 billion. Arithmetic on large values silently wraps to a wrong result.",
     "Use 'long long' in C++ or cast to long in Java before multiplication: (long) a * b."),
    ("Missing break in switch case", "HIGH",
     "Without a break, a switch case falls through to the next case, executing unintended code.",
     "Add 'break;' at the end of each case block, or use 'return'/'throw' to exit."),
    ("Possible NullPointerException", "HIGH",
     "Calling a method on a null reference throws NullPointerException at runtime.",
     "Add a null check before accessing the object: if (obj != null) { ... }"),
    ("Possible memory leak", "HIGH",
     "Memory allocated with new/malloc is not freed, causing the process to grow in memory over time.",
     "Free every allocation on all code paths, or use smart pointers (unique_ptr, shared_ptr)."),
    ("Possible None dereference", "HIGH",
     "A variable known to be None is used without a None check, raising AttributeError at runtime.",
     "Check before calling methods: if var is not None: var.method()"),
    ("Input inside loop", "MEDIUM",
     "Reading user input inside a loop blocks every iteration, increasing latency and risking TLE.",
     "Read all input before the loop or use buffered input (sys.stdin.read()) for competitive programming."),
    ("Sorting inside loop", "MEDIUM",
     "Sorting is O(n log n) per call. Inside a loop it becomes O(n² log n) overall.",
     "Sort once before the loop, or maintain a sorted data structure (heapq, SortedList)."),
    ("Loop variable overwrite", "MEDIUM",
     "The accumulator is overwritten every iteration instead of accumulated, keeping only the last value.",
     "Use '+=' for numbers/strings or '.append()' for lists instead of plain '=' assignment."),
    ("Mutable default argument", "MEDIUM",
     "Python creates the default value once. A mutable default (list/dict/set) is shared across all calls.",
     "Use None as default and initialize inside: def f(x=None): if x is None: x = []"),
    ("Float equality comparison", "MEDIUM",
     "Floating-point numbers have limited precision. Direct '==' comparison is almost always unreliable.",
     "Use abs(a - b) < 1e-9 for equality, or math.isclose(a, b)."),
    ("Nested loop variable shadowing", "MEDIUM",
     "The inner loop reuses the outer loop's variable name, overwriting it and corrupting outer iteration.",
     "Use distinct variable names for each loop level (i, j, k or descriptive names)."),
    ("Missing return in branch", "MEDIUM",
     "One branch of an if/else returns a value while the other does not, silently returning None.",
     "Ensure every branch either returns a value or explicitly returns None."),
    ("Bare except clause", "MEDIUM",
     "A bare 'except:' catches all exceptions including SystemExit and KeyboardInterrupt, masking errors.",
     "Catch specific exceptions or use 'except Exception:'. Log the exception for debugging."),
    ("Compiler Warning", "MEDIUM",
     "The compiler detected a potential issue that may cause unexpected behavior at runtime.",
     "Address the compiler warning — warnings often point to real bugs."),
    ("endl inside loop (slow flush)", "MEDIUM",
     "std::endl flushes the output buffer on every call, which is significantly slower than '\\n'.",
     "Replace std::endl with '\"\\n\"' inside loops. Flush only when necessary."),
    ("pow() result stored in integer", "MEDIUM",
     "pow() returns a double. Storing in int/long truncates the value and causes wrong answers for large exponents.",
     "Use a custom integer power function: long long ipow(long long base, int exp) { ... }"),
    ("String concatenation in loop", "MEDIUM",
     "String '+=' in Java creates a new String object each iteration — O(n²) in memory allocation.",
     "Use StringBuilder.append() in the loop and call .toString() once at the end."),
    ("Catching broad Exception", "MEDIUM",
     "Catching the generic Exception class hides bugs and makes error handling imprecise.",
     "Catch specific exception types like IOException, ArithmeticException, or NumberFormatException."),
    ("Mixed printf and cout", "MEDIUM",
     "Mixing printf/scanf with cout/cin without disabling sync can produce garbled output.",
     "Use one I/O style consistently, or add 'ios::sync_with_stdio(false)' at the start of main()."),
    ("Empty catch block", "MEDIUM",
     "Silently swallowing exceptions makes debugging impossible — errors fail with no visible cause.",
     "Log the exception at minimum. Re-throw if the calling code should handle it."),
    ("Resource may not be closed", "MEDIUM",
     "Unclosed file handles and streams leak OS resources and can prevent other processes from accessing the file.",
     "Close resources in a finally block or use try-with-resources: try (Scanner sc = ...) { }"),
    ("Function may exit without returning a value", "MEDIUM",
     "A non-void function that exits without a return causes undefined behavior in C++ or returns garbage.",
     "Add an explicit return statement covering all code paths."),
    ("Shadowing built-in name", "LOW",
     "Reusing Python built-in names (list, dict, len) breaks those built-ins in the current scope.",
     "Rename the variable to something descriptive that doesn't conflict with Python built-ins."),
    ("None comparison with ==", "LOW",
     "Using '== None' works but can fail with custom __eq__ and is considered bad Python style.",
     "Use 'is None' or 'is not None' for identity comparison with None."),
    ("Identity check on literal", "LOW",
     "'is' checks object identity (memory address), not value — 'is 42' is unreliable.",
     "Use '==' for value equality. Reserve 'is' for None, True, and False."),
    ("Unreachable code after return", "LOW",
     "Code placed after a return statement inside a function will never execute.",
     "Remove the dead code or restructure the logic so the return is at the end."),
    ("Unreachable code after break/continue", "LOW",
     "Statements after break or continue inside a loop body will never execute.",
     "Remove the unreachable statements or restructure the loop logic."),
    ("Function has no return", "LOW",
     "A function with no return implicitly returns None. If a value is expected, this is a bug.",
     "Add an explicit return statement, or verify the function is intentionally side-effect-only."),
    ("Unused variable", "LOW",
     "A variable is assigned but never read — wastes memory and may indicate a logic error or typo.",
     "Remove the assignment or use the variable where intended. Prefix with '_' if intentionally unused."),
    ("Boolean compared with == True/False", "LOW",
     "Comparing a boolean with '== True' or '== False' is redundant and can produce unexpected results with truthy/falsy values.",
     "Use 'if x:' instead of 'if x == True:' and 'if not x:' instead of 'if x == False:'."),
    ("Missing self in method", "HIGH",
     "Instance methods must have 'self' as their first parameter. Without it, Python passes the instance as the first argument causing a TypeError.",
     "Add 'self' as the first parameter: def __init__(self, ...):"),
    ("Missing global declaration", "MEDIUM",
     "Assigning to a module-level variable inside a function without 'global' creates a new local variable instead of modifying the global one.",
     "Add 'global variable_name' at the top of the function before the assignment."),
]

# Used when no name matches.
DEFAULT_TEMPLATE = (
    "MEDIUM",
    "A potential issue was detected in the code.",
    "Review the flagged line and apply the suggested correction.",
)
