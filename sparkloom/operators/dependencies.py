"""Calls to the functions they mean: lookups, scores, keyed arg-max, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import paths
from sparkloom.functions.text import called_functions, trim_space
from sparkloom.session import merged

MOST_DEPENDENCIES = 20
LEAST_SCORE = -4


def python_imports(files: DataFrame, request: str | None = None) -> DataFrame:
    """file_path, ordinal, local_name, imported_name (null for modules), module; `request` names a column that goes with them."""
    key = [request, "file_path"] if request else ["file_path"]
    pairs = lambda pattern, a, b: F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(a)).alias("x"), F.regexp_extract_all("content", F.lit(pattern), F.lit(b)).alias("y"))
    froms = files.select(*key, F.posexplode(pairs(r"(?m)^\s*from\s+([.\w]+)\s+import\s+([^\n]+)", 1, 2)).alias("at", "m"))
    names = froms.select(*key, "at", F.col("m.x").alias("module"), F.posexplode(F.split(F.regexp_replace("m.y", r"[()]|#.*", ""), ",")).alias("sub", "t"))
    names = names.select(*key, (F.col("at") * 1000 + F.col("sub")).alias("ordinal"), "module", F.split(trim_space(F.col("t")), r"\s+as\s+").alias("p")).where(F.col("p")[0] != "")
    names = names.select(*key, "ordinal", F.element_at("p", -1).alias("local_name"), F.col("p")[0].alias("imported_name"), "module")
    mods = files.select(*key, F.posexplode(pairs(r"(?m)^\s*import\s+([.\w]+)(?:[ \t]+as[ \t]+(\w+))?", 1, 2)).alias("at", "m"))
    mods = mods.select(*key, (F.col("at") + 1_000_000_000).alias("ordinal"), F.coalesce(F.nullif("m.y", F.lit("")), F.element_at(F.split("m.x", r"\."), -1)).alias("local_name"), F.lit(None).cast("string").alias("imported_name"), F.col("m.x").alias("module"))
    return names.unionByName(mods)


def script_imports(files: DataFrame, request: str | None = None) -> DataFrame:
    """As python_imports, for ESM imports and require(); names in braces, namespaces and defaults."""
    key = [request, "file_path"] if request else ["file_path"]
    esm = r"import\s+([^;'\"]+?)\s+from\s+['\"]([^'\"]+)['\"]"
    req = r"(?:const|let|var)\s+([^=;]+?)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)"
    out = None
    for k, pattern in enumerate((esm, req)):
        zipped = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("names"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("module"))
        rows = files.select(*key, F.posexplode(zipped).alias("at", "m")).select(*key, "at", F.trim("m.names").alias("names"), F.col("m.module").alias("module"))
        braces = rows.where("names like '{%}'").select(*key, "at", "module", F.posexplode(F.split(F.regexp_replace("names", r"^\{|\}$", ""), ",")).alias("sub", "t"))
        braces = braces.select(*key, "at", "sub", "module", F.split(F.trim("t"), r"\s+as\s+|\s*:\s*").alias("p")).where(F.col("p")[0] != "")
        braces = braces.select(*key, "at", "sub", F.element_at("p", -1).alias("local_name"), F.col("p")[0].alias("imported_name"), "module")
        whole = rows.where("names not like '{%}'")
        star = F.col("names").rlike(r"^\*\s+as\s+")
        name = F.when(star, F.regexp_extract("names", r"as\s+(.+)$", 1)).otherwise(F.trim(F.split("names", ",")[0]))
        whole = whole.select(*key, "at", F.lit(0).alias("sub"), name.alias("local_name"), F.when(~star, name).alias("imported_name"), "module")
        part = braces.unionByName(whole).select(*key, (F.lit(k * 1_000_000_000) + F.col("at") * 1000 + F.col("sub")).alias("ordinal"), "local_name", "imported_name", "module")
        out = part if out is None else out.unionByName(part)
    return out


def _normal(path: Column) -> Column:
    """Without `.` segments and with `..` resolved."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def module_candidates(refs: DataFrame, language: str) -> DataFrame:
    """Adds `candidates`: where the module may lie, in order of precedence."""
    folder = F.regexp_replace("file_path", r"[^/]*$", "")
    if language == "python":
        level = F.length(F.regexp_extract("module", r"^(\.*)", 1))
        tail = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
        base = F.when(level > 0, F.concat(folder, F.repeat(F.lit("../"), F.greatest(level - 1, F.lit(0))), tail)).otherwise(tail)
        base = _normal(base)
        return refs.withColumn("candidates", F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py"))))
    base = _normal(F.concat(folder, F.col("module")))
    bare = F.regexp_replace(base, r"(?<=[^/])\.[^./]+$", "")
    tails = [F.concat(bare, F.lit(s)) for s in (".js", ".jsx", ".ts", ".tsx")] + [F.concat(base, F.lit(s)) for s in ("/index.js", "/index.ts", "/index.tsx")]
    return refs.where("module like '.%'").withColumn("candidates", F.array(base, *tails))


def resolve_modules(refs: DataFrame, files: DataFrame, language: str, request: str | None = None) -> DataFrame:
    """References with module_path, the first candidate that is a file (of the same request); others fall away."""
    own = [request] if request else []
    named = module_candidates(refs, language).select(*refs.columns, F.posexplode("candidates").alias("__at", "module_path"))
    known = named.join(merged(files.select(*own, F.col("file_path").alias("module_path")).distinct()), [*own, "module_path"], "left_semi")
    first = F.min(F.struct("__at", "module_path")).alias("f")
    return known.groupBy(*refs.columns).agg(first).select(*refs.columns, "f.module_path")


def resolve_calls(changes: DataFrame, functions: DataFrame, references: DataFrame, request: str | None = None) -> DataFrame:
    """`changes` (change_id, file_path, function_name, enclosing_class_name, source_code, called_functions) to resolved calls.

    Where no calls were extracted, names before brackets in the source stand for them.
    A call means the first function of its file with its name or last part; else the import
    that its first part or last part names, and the function of that name in the module. Where
    `request` names a column of all three, only rows of one request meet."""
    own = [request] if request else []
    where = lambda df, b: F.lit(True) if not own else df[request] == F.col(f"__{b}")
    also = lambda b: [F.col(request).alias(f"__{b}")] if own else []
    calls = changes.select(*own, "change_id", "file_path", "enclosing_class_name", F.col("source_code").alias("caller"), F.element_at(F.split("function_name", r"\."), -1).alias("self"), F.posexplode(F.when(F.size("called_functions") > 0, F.col("called_functions")).otherwise(called_functions(F.col("source_code")))).alias("call_at", "call"))
    calls = calls.withColumn("bare", F.element_at(F.split("call", r"\."), -1)).where("bare <> self").dropDuplicates(["change_id", "call"])
    funcs = functions.select(*also("f"), F.col("file_path").alias("fp"), F.col("function_name").alias("fn"), F.col("source_code").alias("code"), F.col("ordinal").alias("ord"), F.element_at(F.split("function_name", r"\."), -1).alias("fbare"))
    same = calls.join(merged(funcs), where(calls, "f") & (F.col("file_path") == F.col("fp")) & (F.col("bare") == F.col("fbare")))
    same = same.groupBy("change_id", "call").agg(F.min_by(F.struct(F.col("fp").alias("source_file"), F.col("fn").alias("function_name"), F.col("code").alias("source_code")), "ord").alias("s"))
    refs = references.select(*also("r"), F.col("file_path").alias("rp"), "ordinal", "local_name", "imported_name", "module_path")
    keys = calls.select(*own, "change_id", "file_path", "call", "bare", F.explode(F.array_distinct(F.array(F.split("call", r"\.")[0], F.col("bare")))).alias("key"))
    via = keys.join(merged(refs), where(keys, "r") & (F.col("file_path") == F.col("rp")) & (F.col("key") == F.col("local_name")))
    wanted = F.when(F.col("call").contains(".") & (F.col("key") == F.split("call", r"\.")[0]), F.col("bare")).otherwise(F.coalesce("imported_name", "bare"))
    via = via.groupBy(*own, "change_id", "call").agg(F.min_by(F.struct("module_path", wanted.alias("wanted")), "ordinal").alias("r")).select(*own, "change_id", "call", "r.*")
    far = via.join(merged(funcs), where(via, "f") & (F.col("module_path") == F.col("fp")) & (F.col("wanted") == F.col("fbare")))
    far = far.groupBy("change_id", "call").agg(F.min_by(F.struct(F.col("fp").alias("source_file"), F.col("fn").alias("function_name"), F.col("code").alias("source_code")), "ord").alias("f"))
    out = calls.join(merged(same), ["change_id", "call"], "left").join(merged(far), ["change_id", "call"], "left")
    return out.withColumn("d", F.coalesce("s", "f")).where("d is not null").select("change_id", "call_at", "call", "caller", "d.*")


def is_simple_wrapper(source: Column) -> Column:
    lines = F.filter(F.transform(F.split(source, "\n"), trim_space), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("//") & ~x.startswith("@"))
    text = F.lower(F.array_join(lines, " "))
    return (F.size(lines) <= 4) & (text.startswith("def ") | text.startswith("function ") | text.startswith("async"))


def dependency_score(call: Column, caller: Column, source: Column) -> Column:
    """+3 in a branch's line, +3 in a return's line, +2 for checks, -5 for logs (as parts of a name), -3 for wrappers."""
    quoted = F.concat(F.lit(r"\Q"), call, F.lit(r"\E"))
    uses = lambda head: F.regexp_like(caller, F.concat(F.lit(rf"(?m)\b({head})\b[^\n]*"), quoted, F.lit(r"\s*\(")))
    points = lambda test, n: F.when(test, n).otherwise(0)
    low = F.lower(call)
    return points(uses("if|while"), 3) + points(uses("return"), 3) + points(low.rlike("validate|check|parse"), 2) + points(low.rlike("log|print|debug|trace"), -5) + points(is_simple_wrapper(source), -3)


def keyed_arg_max(df: DataFrame, keys: Sequence[str], score: str, order: str) -> DataFrame:
    """The row of each key with the highest score; the first by `order` wins ties. One combining aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(order))).alias("__b"))
    return best.select(*[F.col(k) if k in keys else F.col(f"__b.{k}") for k in df.columns])


def top_k(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; tasks drop what cannot be among them before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def select_dependencies(resolved: DataFrame, files: DataFrame, language: str) -> DataFrame:
    """Scores, keeps the best call of each function, the top of each change, and renders what the change gets to see."""
    scored = resolved.withColumn("score", dependency_score(F.col("call"), F.col("caller"), F.col("source_code")))
    best = keyed_arg_max(scored, ["change_id", "function_name"], "score", "call_at")
    top = top_k(best, "change_id", [F.desc("score"), F.asc("function_name")], MOST_DEPENDENCIES).where(F.col("score") > LEAST_SCORE)
    known = files.select(F.col("file_path").alias("source_file"), F.lit(True).alias("local")).distinct()
    local = F.coalesce("local", F.lit(False)) & ~F.coalesce(F.col("source_file").contains("site-packages"), F.lit(False))
    content = F.when(local, F.coalesce("source_code", F.lit(""))).otherwise(paths.import_line(F.col("function_name"), F.col("source_file"), F.lit(language)))
    return top.join(merged(known), "source_file", "left").select("change_id", "rank", "function_name", "source_file", "score", F.when(local, "code").otherwise("import_only").alias("mode"), content.alias("content"), content.alias("summary"))
