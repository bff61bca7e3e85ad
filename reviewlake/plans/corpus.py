"""Code corpus over the given tables.

The tables hold no source code, so each document row takes one of the snippets
below (``doc_id`` modulo their number) with its own ``n_chars`` put in for
``@N``. Only the registered queries use this view; the operators take any
DataFrame with the snippet columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# (declared language, file name, path, code)
TEMPLATES = [
    ("python", "loop.py", "src/loop.py",  # 0
     "while True:\n    x = @N / 0\n    y = input()\n    data.sort()\n    print(x, y)\n"),
    ("py", "scan.py", "src/scan.py",  # 1
     "def scan(items):\n    for i in items:\n        for i in range(@N):\n            print(i)\n"
     "    while items:\n        for k in items:\n            print(k)\n"),
    (" Python ", "", "src/walk.py",  # 2
     "def walk(node, seen=[]):\n    return walk(node.next)\n\ndef pair(a, b):\n    return a + b\n\n"
     "pair(1)\npair(1, 2, @N)\npair(*[1, 2])\n"),
    ("python", "total.py", "src/total.py",  # 3
     "def total(values):\n    result = 0\n    label = \"\"\n    flag = False\n    for v in values:\n"
     "        result = v * @N\n        label = label + v\n        flag = v\n"
     "    return result, label, flag\n"),
    ("python", "cmp.py", "src/cmp.py",  # 4
     "list = [1, 2]\ndef max(a, b):\n    if a == None:\n        return b\n"
     "    if a is 5 or b is 'x':\n        return list\n    if a == 0.5 or 1.5 == b:\n"
     "        return a\n    if a == True or b != False:\n        return b\n"
     "    if a is 1 or b is None:\n        return a\n    return @N\nsum: int = 3\nsum += 1\n"),
    ("python", "pick.py", "src/pick.py",  # 5
     "def pick(flag, rows):\n    if flag:\n        return 1\n    else:\n        print(flag)\n"
     "    for r in rows:\n        if r:\n            continue\n            print(r)\n"
     "        break\n        print(r)\n    return @N\n    print(rows)\n"),
    ("python", "drain.PY", "src/drain.PY",  # 6
     "def drain(queue):\n    for q in queue:\n        queue.remove(q)\n        queue.index(q)\n"
     "    try:\n        return queue.pop()\n    except:\n        pass\n    finally:\n"
     "        return @N\n"),
    ("python", "box.py", "src/box.py",  # 7
     "counter = 0\nlimit = @N\nclass Box:\n    def __init__(this):\n        this.v = limit\n"
     "    def __len__():\n        return 0\ndef bump():\n    counter = counter + 1\n    limit = 5\n"
     "    limit = 6\n    return counter\ndef keep():\n    global counter\n    counter = 2\n"
     "    return counter\n"),
    ("python", "load.py", "src/load.py",  # 8
     "import os\ndef load(path):\n    handle = None\n    size = @N\n    _skip = 1\n    name = None\n"
     "    name = path\n    other = None\n    other = open(path)\n    print(name.upper())\n"
     "    other.close()\n    return handle.read()\n"),
    ("python", "add.py", "src/add.py",  # 9
     "def add(a, b):\n    return a + b + @N\n"),
    ("python", "broken.py", "src/broken.py",  # 10
     "def broken(:\n    return @N\n"),
    ("python", "colon.py", "src/colon.py",  # 11
     "x = 1\nif x\n    print(@N)\n"),
    ("python", "risky.py", "src/risky.py",  # 12
     "# TODO tidy\ntry:\n    eval(\"@N\")\nexcept ValueError:\n    exec(\"pass\")\n"
     "f = open(\"a.txt\")\nf.close()\n"),
    ("python", "deep.py", "src/deep.py",  # 13
     "async def fetch(urls):\n    async with session() as s:\n"
     "        return [u for u in urls if u and s or u]\n\ndef deep(n):\n    with lock:\n"
     "        if n > 0 and n < @N:\n            while n:\n                n -= 1\n"
     "        assert n is not None\n    try:\n        return deep(n - 1)\n"
     "    except (ValueError, KeyError):\n        return None\n"),
    ("python", "best.py", "src/best.py",  # 14
     "best = {}\ncount = 0\nfor key, val in pairs():\n    best = val\n    count = count + 1\n"
     "    for key in range(3):\n        pass\nwhile True:\n    break\n"
     "total = 10 / 0.0 + 7 // 0 + @N % 0 + 1 / False\n"),
    ("cpp", "nested.cpp", "src/nested.cpp",  # 15
     "#include <iostream>\nusing namespace std;\nint main() {\n  for (int i = 0; i < @N; i++) {\n"
     "    for (int j = 0; j < i; j++) {\n      cout << i / 0 << endl;\n    }\n  }\n"
     "  while(true) { }\n  return 0;\n}\n"),
    ("C++", "copy.c", "src/copy.c",  # 16
     "#include <cstring>\n#include \"util.h\"\nint copy(char* dst, char* src) {\n  char buf[8];\n"
     "  strcpy(dst, src)\n  if (dst = src) {\n    return @N\n  }\n  const char* s = \"done\"\n"
     "  gets(buf);\n  return 1;\n}\n"),
    ("cpp", "big.cc", "src/big.cc",  # 17
     "#include <cstdio>\nint big() {\n  int p = pow(2, @N);\n  int v = 3000000000;\n"
     "  int w = 1e9;\n  printf(\"%d\", p);\n  cout << v;\n  int* q = (int*) malloc(4);\n"
     "  try { q[0] = 1; } catch (...) { }\n  return w;\n}\n"),
    ("cpp", "grade.hpp", "src/grade.hpp",  # 18
     "int grade(int s) {\n  switch (s) {\n    case 1:\n      s = @N;\n    case 2:\n      break;\n"
     "    case 3: s++;\n    default:\n      return 0;\n  }\n  switch (s) {\n    case 9:\n"
     "      s = 2;\n  }\n  return s;\n}\n"),
    ("cpp", "fact.cpp", "src/fact.cpp",  # 19
     "int fact(int n)\n{\n  n = fact(n - 1);\n}\nstatic int loop(int n) {\n  if (n > @N) {\n"
     "    n--;\n  }\n  else if (n < 0) {\n    n++;\n  }\n  return loop(n);\n}\n"
     "void log(int n) {\n  log(n);\n}\nFoo make() {\n}\n"),
    ("cpp", "array.cxx", "src/array.cxx",  # 20
     "int main() {\n  int a[] = {1, 2, 3};\n  int b[@N];\n  a[0] = a[3];\n  int c[2] = {0, 0};\n"
     "  c[1] = b[999999999];\n  // a[7] = 1;\n  /* a[8]\n  = 1; */ a[9] = 0;\n  return a[5];\n}\n"),
    ("cpp", "run.h", "src/run.h",  # 21
     "#include <vector>\nint run() {\n  int n = 0;\n  int* p = new int[4];\n  while (n < @N) {\n"
     "    cin >> n;\n    getline(cin, line);\n    sort(v.begin(), v.end());\n  }\n"
     "  sort(v.begin(), v.end());\n  x = 1;\n  y = 2;\n  z = 3;\n  sort(v.begin(), v.end());\n"
     "  return p[0];\n}\n"),
    ("cpp", "square.cpp", "src/square.cpp",  # 22
     "#include <iostream>\nint square(int x) {\n  return x * @N;\n}\n"),
    ("cpp", "closer.cpp", "src/closer.cpp",  # 23
     "int main() {\n  int a[2];\n  f(a[0);\n  return @N;\n}\n"),
    ("cpp", "quote.cpp", "src/quote.cpp",  # 24
     "int main() {\n  const char* s = \"abc;\n  return @N;\n}\n"),
    ("cpp", "brace.cpp", "src/brace.cpp",  # 25
     "int main() {\n  // a comment with ) and \"\n  if (x) {\n    return @N;\n}\n"),
    ("java", "A.java", "src/A.java",  # 26
     "class A {\n  char c = 'x;\n  int n = @N;\n}\n"),
    ("java", "Extra.java", "src/Extra.java",  # 27
     "class A {\n  /* open { brace */\n  int n = @N;\n}\n}\n"),
    ("java", "Main.java", "src/Main.java",  # 28
     "import java.util.Scanner;\npublic class Main {\n  public static int read(Scanner sc) {\n"
     "    String out = \"\";\n    for (int i = 0; i < @N; i++) {\n      int v = sc.nextInt();\n"
     "      out += \"x\" + v;\n      out = out + v;\n      Collections.sort(list);\n    }\n"
     "    return out.length();\n  }\n}\n"),
    ("java", "App.java", "src/App.java",  # 29
     "import java.io.*;\npublic class App {\n  public int check(String s) {\n"
     "    BufferedReader r = new BufferedReader(new FileReader(\"f@N\"));\n"
     "    if (s == \"yes\") {\n      int prod = a * b * c;\n      int q = n * 100000;\n    }\n"
     "    try {\n      r.readLine();\n    } catch (Exception e) {\n    }\n    Object o = null;\n"
     "    int[] xs = {1, 2};\n    int[] ys = new int[3];\n    xs[2] = ys[3];\n    s.length();\n"
     "  }\n}\n"),
    ("JAVA", "Ok.java", "src/Ok.java",  # 30
     "public class Ok {\n  static long twice(long v) {\n    return v * @N;\n  }\n}\n"),
    ("cpp", "lead.cpp", "src/lead.cpp",  # 31
     "}\nint f(int a) {\n  if (a) { g(a); }\n"
     "  else if (a && b || c) { while (a) { a--; } }\n}\nint g(int b)\n{\n  return g(b) + @N;\n}\n"),
    ("cpp", "port.cpp", "src/port.cpp",  # 32
     "/* header\n   spans\n   lines */\nint port() {\n  string u = \"http://host/@N\";\n"
     "  for (;;) { }\n  return 8080;\n}\n"),
    ("java", "S.java", "src/S.java",  # 33
     "class S {\n  int pick(int k) {\n    switch (k) {\n      case 1:\n        switch (@N) {\n"
     "          case 5:\n            k = 2;\n        }\n      case 2: return 3;\n    }\n"
     "    return k;\n  }\n}\n"),
    ("ruby", "short.rb", "src/short.rb", "x=@N"),  # 34
    (None, None, None,  # 35
     "#include <iostream>\nstd::cout << @N << std::endl;\n"),
    ("", "README", "README",  # 36
     "import java.util.List;\npublic class K { int v = @N; }\n"),
    ("ruby", "script.rb", "lib.py/script.rb", "print(\"value\", @N)\n"),  # 37
    (" PY ", "x.tar.gz", "src/a.hxx",  # 38
     "class P:\n    def run(self):\n        total = @N\n        for x in range(total):\n"
     "            print(x)\n"),
    ("HXX", ".gitignore", "src/.java",  # 39
     "template <class T> T id(T v) {\n  return v + @N;\n}\n"),
    ("go", "x.hxx", "src/x.hxx",  # 40
     "int tick(int n) {\n  // TODO: /0\n  while(true) { n = n / 0; }\n  return n + @N;\n}\n"),
]


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``snippet_id, code, docstring, repo, path, language, filename`` per document."""
    rows = [(tid, *t) for tid, t in enumerate(TEMPLATES)]
    templates = spark.createDataFrame(
        rows, "tid long, language string, filename string, path string, body string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    # Three narrow columns are spread before they are widened to code and parsed.
    docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    # The template list has a fixed number of rows, so it is safe to broadcast.
    return (
        docs.withColumn("tid", F.col("doc_id") % len(TEMPLATES))
        .join(F.broadcast(templates), "tid")
        .select(
            F.col("doc_id").alias("snippet_id"),
            F.replace("body", F.lit("@N"), F.col("n_chars").cast("string")).alias("code"),
            F.lit("").alias("docstring"),
            F.col("source").alias("repo"),
            "path", "language", "filename",
        )
    )
