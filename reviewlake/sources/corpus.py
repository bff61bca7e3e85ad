"""Readers: snippet corpora, labelled samples and compiler logs."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.functions import fixed
from reviewlake.functions.lang import language_from_path
from reviewlake.functions.text import lookup, rx, strip
from reviewlake.sources.stage import shared_folder, staged

CORPUS_COLUMNS = ["code", "docstring", "repo", "path", "language"]
# Where a row stands in the input: format, file, split of the file, row.
POSITION = ["fmt", "file", "block", "seq"]
SNIPPET_SCHEMA = ", ".join(f"{f} string" for f in fixed.SNIPPET_FIELDS)
TASKS_A_CORE = 16
"""Tasks that read whole files, for each core. Spark alone counts 4 MB for opening a file, so a task would get a few small ones."""


def _plain_path(col: Column) -> Column:
    return F.regexp_replace(col, r"^file:(//)?(?=/)", "")


def _position(fmt: int) -> list[Column]:
    meta = F.col("_metadata")
    return [F.lit(fmt).alias("fmt"), meta["file_path"].alias("file"),
            meta["file_block_start"].alias("block"),
            F.monotonically_increasing_id().alias("seq")]


def _is_hidden(name: str) -> bool:
    """What Spark's file sources pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name


def _place(folder: str) -> tuple[str, str] | None:
    """What stands before all paths of the folder as Spark writes them, and the rest for Arrow; None where Arrow cannot list it."""
    plain = re.sub(r"^file:(//)?(?=/)", "", folder).rstrip("/")
    if re.search(r"[*?\[\]{}\\%]", plain):
        return None
    try:
        store, top = FileSystem.from_uri(plain)
        if not plain.endswith(top) or store.get_file_info(top).type != FileType.Directory:
            return None
    except (OSError, ValueError):
        return None
    return ("file:" if plain == top else plain[:-len(top)]), top


def _opened(before: str, top: str) -> FileSystem:
    return FileSystem.from_uri(top if before == "file:" else before + top)[0]


def _listing(spark: SparkSession, folder: str) -> DataFrame | None:
    """``path, name`` of all files with content below the folder, listed by tasks, level by level; None where only Spark can.

    Spark's own listing brings the paths of all files to the driver, for each reader and whatever names it looks for.
    """
    place = _place(folder)
    try:
        shared_folder(spark)
    except ValueError:
        place = None
    if place is None:
        return None
    before, top = place

    def listed(frames):
        store = _opened(before, top)
        for frame in frames:
            for parent in frame["path"]:
                found = [(before + i.path, i.base_name, i.type == FileType.Directory, i.size or 0)
                         for i in store.get_file_info(FileSelector(parent.removeprefix(before))) if not _is_hidden(i.base_name)]
                yield pd.DataFrame(found, columns=["path", "name", "folder", "size"])

    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    level, levels = spark.range(1).select(F.lit(before + top).alias("path")), []
    while True:
        found = staged(level.mapInPandas(listed, "path string, name string, folder boolean, size long"), "listing")
        levels.append(found.filter("not folder and size > 0").select("path", "name"))
        folders = found.filter("folder").select("path")
        many = folders.count()
        if not many:
            return reduce(DataFrame.unionByName, levels)
        level = folders.repartition(min(tasks, many), "path")


def _named(listing: DataFrame, endings: list[str]) -> DataFrame:
    return listing.filter(reduce(Column.__or__, [F.col("name").endswith(f".{e}") for e in endings]))


MOST_PATHS = 10_000
"""Files that are named to a reader one by one; of more it gets the folder."""


def _files(spark: SparkSession, folder: str, ending: str, max_files: int | None, listing: DataFrame | None) -> list[str]:
    """The files of the folder (or the folder itself, where there are too many), or with a cap the first of them by path."""
    if listing is not None:
        most = MOST_PATHS + 1 if max_files is None else max_files
        found = [r["path"] for r in _named(listing, [ending]).select("path").orderBy("path").limit(most).collect()]
        # A reader takes some characters of a path for a pattern.
        by_name = max_files is not None or len(found) <= MOST_PATHS and not any(re.search(r"[*?\[\]{}\\]", p) for p in found)
        return found if by_name else [folder]
    if max_files is None:
        return [folder]
    names = _whole_files(spark, f"*.{ending}", folder).select("path")
    return [r["path"] for r in names.orderBy("path").limit(max_files).collect()]


def _reader(spark: SparkSession, fmt: str, glob: str):
    return (spark.read.format(fmt).option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob))


def _whole_files(spark: SparkSession, glob: str, paths: str | list[str]) -> DataFrame:
    """A row for each file. How many tasks read them follows the cores, not the number of files."""
    return _reader(spark, "binaryFile", glob).load(paths).coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism)


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SNIPPET_SCHEMA + ", fmt int, file string, block long, seq long")


def read_jsonl(spark: SparkSession, folder: str, max_files: int | None = None, listing: DataFrame | None = None) -> DataFrame:
    """``**/*.jsonl``, five text fields, missing ones empty; a bad line fails the job."""
    files = _files(spark, folder, "jsonl", max_files, listing)
    if not files:
        return _empty(spark)
    rows = (_reader(spark, "json", "*.jsonl").schema(SNIPPET_SCHEMA).option("mode", "FAILFAST")
            .load(files))
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in CORPUS_COLUMNS], *_position(0))


def decode_ignoring_errors(content: Column) -> Column:
    """UTF-8 text with the bad bytes dropped.

    Bad bytes become U+FFFD and are taken out; a U+FFFD of the file itself waits
    behind two noncharacters meanwhile.
    """
    bad, held = F.lit("�"), F.lit("\U0010ffff\U0010fffe")
    text = F.replace(content.cast("string"), bad, held)
    text = F.replace(F.make_valid_utf8(text), bad, F.lit(""))
    return F.replace(text, held, bad)


def _contents(spark: SparkSession, files: DataFrame, place: tuple[str, str]) -> DataFrame:
    """``path, content`` of listed files. A file is opened only where its content is asked for, and some hundred are held at a time."""
    opened: list[FileSystem] = []

    def content(path):
        if not opened:
            opened.append(_opened(*place))
        with opened[0].open_input_stream(path.removeprefix(place[0])) as file:
            return file.read()

    dealt = files.select("path").repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, "path")
    return dealt.withColumn("content", F.udf(content, "binary", useArrow=False)("path"))


def read_source_files(spark: SparkSession, folder: str, max_files: int | None = None, listing: DataFrame | None = None) -> DataFrame:
    """C and C++ files, one row each.

    Spark's file sources pass over empty files; cleaning would drop their rows.
    """
    listing = _listing(spark, folder) if listing is None else listing
    if listing is not None:
        files = _named(listing, fixed.SOURCE_EXTENSIONS)
        rows = _contents(spark, files if max_files is None else files.orderBy("path").limit(max_files), _place(folder))
    else:
        glob = "{" + ",".join(fixed.SOURCE_EXTENSIONS) + "}"
        files = _files(spark, folder, glob, max_files, None)
        if not files:
            return _empty(spark)
        rows = _whole_files(spark, f"*.{glob}", files)
    code = F.regexp_replace(decode_ignoring_errors(F.col("content")), "\r\n?", "\n")
    return rows.select(
        code.alias("code"), F.lit("").alias("docstring"), F.lit("").alias("repo"),
        _plain_path(F.col("path")).alias("path"),
        language_from_path(F.col("path")).alias("language"),
        F.lit(1).alias("fmt"), F.col("path").alias("file"), F.lit(0).cast("long").alias("block"),
        F.lit(0).cast("long").alias("seq"))


def _most_columns(spark: SparkSession, files: list[str]) -> int | None:
    """The largest number of columns that a header of the files can have; None without files."""
    header = (_reader(spark, "text", "*.csv").load(files).select("value", *_position(2))
              .groupBy("file").agg(F.min_by("value", "seq").alias("header")))
    commas = F.length("header") - F.length(F.replace("header", F.lit(","), F.lit("")))
    return header.agg(F.max(commas + 1)).first()[0]


def _java_code_place(header: Column) -> Column:
    """Place, from 1, of the first known code column of a header, by trimmed lower-case name; null without one."""
    names = F.transform(header, lambda h: F.lower(strip(F.coalesce(h, F.lit("")))))
    return F.coalesce(*[F.nullif(F.array_position(names, c), F.lit(0).cast("long")) for c in fixed.JAVA_CSV_COLUMNS])


def read_java_csv(spark: SparkSession, folder: str, max_files: int | None = None, listing: DataFrame | None = None) -> DataFrame:
    """Java sources in CSV cells; ``path`` is ``file#rowN``, blank cells are skipped.

    All files are read alike, without headers: a file's first row says which of its cells holds the code.
    """
    files = _files(spark, folder, "csv", max_files, listing)
    width = _most_columns(spark, files) if files else None
    if width is None:
        return _empty(spark)
    names = [f"c{i}" for i in range(width)]
    rows = (_reader(spark, "csv", "*.csv").schema(", ".join(f"{n} string" for n in names))
            .option("multiLine", True).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).load(files))
    # A multi-line file is read by one task, so ids rise by one per record.
    numbered = rows.select(F.array(*names).alias("cells"), *_position(2))
    start = numbered.groupBy(F.col("file").alias("of_file")).agg(F.min("seq").alias("start"))
    header = (numbered.join(start, (F.col("file") == F.col("of_file")) & (F.col("seq") == F.col("start")))
              .select("of_file", "start", _java_code_place(F.col("cells")).cast("int").alias("place"))
              .filter("place is not null"))
    code = F.coalesce(F.try_element_at("cells", F.col("place")), F.lit(""))
    number = (F.col("seq") - F.col("start")).cast("string")
    return (numbered.join(header, F.col("file") == F.col("of_file")).filter("seq > start")
            .withColumn("code", code).filter(strip(F.col("code")) != "")
            .select("code", F.lit("").alias("docstring"), F.lit("").alias("repo"),
                    F.concat(_plain_path(F.col("file")), F.lit("#row"), number).alias("path"),
                    F.lit("java").alias("language"), *POSITION))


def take_first(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in input order, without bringing rows together.

    Row counts per file split say in which split the last row lies. The splits before it are taken whole, and only
    that one split is ranked. The counts themselves are sorted by ranges, and only the range that holds
    the last row passes through a window.
    """
    split = POSITION[:3]
    counts = staged(rows.groupBy(*split).agg(F.count("*").alias("size")).orderBy(*split)
                    .withColumn("part", F.spark_partition_id()), "splits")
    before, found = 0, None
    for part, size in sorted(tuple(r) for r in counts.groupBy("part").agg(F.sum("size")).collect()):
        if before < n <= before + size:
            found = part
            break
        before += size
    if found is None:       # no more than n rows in all, or n is 0
        return rows if n > 0 else rows.filter(F.lit(False))
    so_far = Window.partitionBy("part").orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    last = (counts.filter(F.col("part") == found)
            .withColumn("before", F.coalesce(F.sum("size").over(so_far), F.lit(0)) + before)
            .filter((F.col("before") < n) & (F.col("before") + F.col("size") >= n)).first())
    here = F.struct(*split)
    edge = F.struct(*[F.lit(last[c]).cast(rows.schema[c].dataType).alias(c) for c in split])
    order = Window.partitionBy(*split).orderBy("seq")
    part = (rows.filter(here == edge).withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= n - last["before"]).drop("place"))
    return rows.filter(here < edge).unionByName(part)


def read_corpus(spark: SparkSession, folder: str, max_files: int | None = None,
                max_rows: int | None = None) -> DataFrame:
    """All three formats: JSONL, then sources, then CSV; the row cap counts in that order."""
    listing = _listing(spark, folder)
    rows = reduce(DataFrame.unionByName, [
        read(spark, folder, max_files, listing) for read in (read_jsonl, read_source_files, read_java_csv)])
    if max_rows is not None:
        rows = take_first(rows, max_rows)
    return rows.select(*CORPUS_COLUMNS)


def _json_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of the files in the order given, as variants; broken lines are dropped."""
    parts = [spark.read.text(p).select("value", *_position(i)) for i, p in enumerate(paths)]
    lines = reduce(DataFrame.unionByName, parts)
    parsed = lines.withColumn("obj", F.try_parse_json(strip(F.col("value"))))
    return parsed.filter("obj is not null").drop("value")


def _code_field() -> Column:
    """First non-empty of the code fields."""
    fields = [F.try_variant_get("obj", f"$.{f}", "string") for f in fixed.CODE_FIELDS]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in fields])


def read_labeled(spark: SparkSession, paths: list[str],
                 max_samples: int | None = None) -> DataFrame:
    """``code, label`` of rows that have both; a null ``bug_risk`` hides ``label``."""
    def field(name):
        return F.try_variant_get("obj", f"$.{name}", "variant")

    risk_type = F.schema_of_variant(field("bug_risk"))
    raw = F.when(risk_type.isNotNull(), field("bug_risk")).otherwise(field("label"))
    rows = _json_lines(spark, paths).select(_code_field().alias("code"), raw.alias("raw"),
                                            *POSITION)
    kind = F.schema_of_variant("raw")
    text = strip(F.try_variant_get("raw", "$", "string"))
    whole = F.when(text.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(text, F.lit("_"), F.lit("")))
    label = (F.when(kind == "STRING", whole.try_cast("int"))
             .when(kind == "BOOLEAN", F.try_variant_get("raw", "$", "boolean").cast("int"))
             .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"),
                   F.try_variant_get("raw", "$", "double").try_cast("int")))
    found = rows.withColumn("label", label).filter("code is not null and label is not null")
    found = found.drop("raw")
    if max_samples is not None:
        found = take_first(found, max_samples)
    return found.select("code", "label", *POSITION)


def read_unlabeled(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``code`` of rows with more than 20 characters of it."""
    return (_json_lines(spark, paths).select(_code_field().alias("code"), *POSITION)
            .filter(F.length("code") > 20))


def compiler_issues(logs: DataFrame) -> DataFrame:
    """Issues in compiler logs: ``snippet_id, language, log`` to ``name, line, fix``."""
    log, language = F.col("log"), F.col("language")

    def found(lang):
        pattern = F.lit(rx(fixed.COMPILER_LINE[lang]))
        return F.arrays_zip(*[F.regexp_extract_all(log, pattern, F.lit(i)).alias(n)
                              for i, n in enumerate(("line", "kind", "msg"), 1)])

    rows = logs.select("snippet_id", "language", F.posexplode(
        F.when(language == "cpp", found("cpp")).when(language == "java", found("java"))))
    message = strip(F.col("col.msg"))
    noise = reduce(Column.__or__, [message.contains(w) for w in fixed.COMPILER_NOISE])
    return (
        rows.filter(~((language == "cpp") & noise))
        .select("snippet_id", lookup(F.col("col.kind"), {
            "error": "Compiler Error", "warning": "Compiler Warning"}).alias("name"),
            F.col("col.line").try_cast("int").alias("line"), message.alias("fix"),
            F.col("pos").alias("o1"))
    )
