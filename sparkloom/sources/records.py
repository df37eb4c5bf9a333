"""Readers: captured diffs, file versions, events, responses and the stored mapping, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import trim_space
from sparkloom.operators.changes import SECTION


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """diff_id (the file's path) and text, a row for each captured diff."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("diff_id"), F.col("value").alias("text"))


def read_diff_sections(spark: SparkSession, path: str) -> DataFrame:
    """diff_id (the file's path) and text, a row for each file's section of each captured diff, without the mark that begins it.

    Records end where the next section begins, so Spark splits a large diff between tasks as
    it does with lines. `changed_lines` gives the same rows for these as for whole diffs. What
    stands before the first section is a row of its own."""
    found = spark.read.option("lineSep", "\n" + SECTION).text(path)
    return found.select(F.col("_metadata.file_path").alias("diff_id"), F.regexp_replace("value", rf"\A\Q{SECTION}\E", "").alias("text"))


def read_changed_paths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.translate(trim_space(F.col("value")), "\\", "/").alias("file_path")).where("file_path <> ''")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file_path and content of whole text files, recursively."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("content"))


def with_contents(paths: DataFrame, files: DataFrame) -> DataFrame:
    """`paths` (file_path, ...) with their contents; '' where there is no such file."""
    return paths.join(files.select("file_path", "content"), "file_path", "left").withColumn("content", F.coalesce("content", F.lit("")))


def is_there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def with_previous(files: DataFrame, versions: DataFrame, ref: str) -> DataFrame:
    """`files` with previous_source at a version; null where the file was not there."""
    old = versions.where(F.col("ref") == ref).select("file_path", F.col("content").alias("previous_source"))
    return files.join(old, "file_path", "left")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """payload: the JSON of each event file; an empty object where the path is not there."""
    if not path or not is_there(spark, path):
        return spark.createDataFrame([("{}",)], "payload string")
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"))


def first_number(*columns: Column) -> Column:
    """The first that is a number above 0; zeros, blanks and nulls do not count."""
    return F.coalesce(*[F.nullif(F.expr("int(null)") if c is None else c.try_cast("int"), F.lit(0)) for c in columns])


def event_context(events: DataFrame, override: Column | None = None) -> DataFrame:
    """Number, branches, title and body of an event's JSON (column `payload`); a missing number or branch is an error, and so is a payload that is no JSON.

    A payload is parsed once, into a variant; fields of any shape are taken from that."""
    parsed = events.withColumn("__v", F.parse_json(F.coalesce("payload", F.lit("{}"))))
    at = lambda p: F.try_variant_get("__v", p, "string")
    number = first_number(override if override is not None else F.lit(None).cast("string"), at("$.pull_request.number"), at("$.number"))
    need = lambda c, name: F.when(F.coalesce(c.cast("string"), F.lit("")) == "", F.raise_error(F.lit(f"missing {name}"))).otherwise(c)
    return parsed.select(
        at("$.repository.full_name").alias("repository"), need(number, "number").alias("pull_request_number"), need(at("$.pull_request.base.ref"), "base branch").alias("base_branch"),
        need(at("$.pull_request.head.ref"), "head branch").alias("head_branch"), at("$.pull_request.title").alias("title"), at("$.pull_request.body").alias("body"),
    )


def with_response_content(rows: DataFrame, body: str = "body") -> DataFrame:
    """Adds `content`, the text of a model's response whichever of its shapes it has, and `bad_json`, whether the body is none.

    No choices: output_text. A message whose content is a string, or a list of parts whose
    texts are joined. Else the choice's own text. The body is parsed once, into a variant."""
    v = rows.withColumn("__v", F.try_parse_json(body))
    at = lambda p, kind="string": F.try_variant_get("__v", p, kind)
    content = at("$.choices[0].message.content", "variant")
    parts = F.array_join(F.transform(at("$.choices[0].message.content", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))), "")
    said = F.when(F.schema_of_variant(content).startswith("ARRAY"), parts).otherwise(at("$.choices[0].message.content"))
    none = content.isNull() | F.is_variant_null(content)
    text = F.when(at("$.choices[0]", "variant").isNull(), at("$.output_text")).when(none, at("$.choices[0].text")).otherwise(said)
    return v.withColumn("content", text).withColumn("bad_json", F.col(body).isNotNull() & F.col("__v").isNull()).drop("__v")


RESPONSES = "target_id long, attempt int, http_status int, body string"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Captured answers of a model (JSON lines as RESPONSES) to target_id, attempt, status, content, message.

    An HTTP status of 400 or more, a body that is no JSON and a blank text are errors, whose message says so."""
    rows = with_response_content(spark.read.schema(RESPONSES).json(path))
    text = F.coalesce("content", F.lit(""))
    message = F.when(F.col("http_status") >= 400, F.concat_ws(" ", F.col("http_status").cast("string"), "body")).when(F.col("bad_json"), F.lit("no JSON")).when(trim_space(text) == "", F.lit("empty response"))
    return rows.select("target_id", "attempt", F.when(message.isNotNull(), "error").otherwise("answer").alias("status"), F.when(message.isNull(), text).alias("content"), message.alias("message"))


RUNS = "run_id long, ordinal int, language string, stdout string, stderr string, returncode int"


def read_runs(spark: SparkSession, path: str, languages: list[str]) -> DataFrame:
    """Captured results of test runs (JSON lines as RUNS), of the asked languages alone."""
    return spark.read.schema(RUNS).json(path).where(F.col("language").isin(languages))


#: What runs the tests of a language, and the file without which it does not.
RUNNERS = {"python": ("python", None), "javascript": ("npm", "package.json")}


def expected_runs(touched: DataFrame, files: DataFrame, tools: list[str]) -> DataFrame:
    """(request_id, language) of the runs that a request calls for, one for Python and one for both script languages.

    `touched` (request_id, language): what a request changed; `files` (request_id, file_path):
    its repository's files, as scripts are run where its root has a package.json alone; `tools`
    are the runners at hand. A run that `read_runs` gives and that is not expected is none of the request's."""
    runner = F.when(F.col("language").isin("javascript", "typescript"), "javascript").when(F.col("language") == "python", "python")
    asked = touched.select("request_id", runner.alias("language")).where("language IS NOT NULL").distinct()
    out = None
    for language, (tool, needs) in RUNNERS.items():
        rows = asked.where((F.col("language") == language) & F.lit(tool in tools))
        if needs:
            rows = rows.join(files.where(F.col("file_path") == needs).select("request_id").distinct(), "request_id", "left_semi")
        out = rows if out is None else out.unionByName(rows)
    return out


MAPPING_FIELDS = "source_file string, language string, function_name string, test_id string, target_file string, test_names array<string>"


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """key and the entry's fields of one indented mapping document, in one file or in part files; read entry by entry, so a large one is split between tasks."""
    entry = spark.read.option("lineSep", "\n  },\n").text(path).select(F.regexp_replace(F.regexp_replace("value", r"\A\{\n", ""), r"(\n  \})?\n?\}?\n?\z", "").alias("e")).where(F.trim("e") != "")
    kind = f"map<string, struct<{MAPPING_FIELDS}>>"
    return entry.select(F.explode(F.from_json(F.concat(F.lit("{"), "e", F.lit("\n}}")), kind)).alias("key", "v")).select("key", "v.*")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """key and the entry's fields of a stored mapping; no rows where the path is not there."""
    if not is_there(spark, path):
        return spark.createDataFrame([], f"key string, {MAPPING_FIELDS}")
    entry = f"map<string, struct<{MAPPING_FIELDS}>>"
    texts = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=\{)")).alias("value"))  # one for each source file, or one in all
    return texts.select(F.explode(F.from_json("value", entry)).alias("key", "e")).select("key", "e.*")
