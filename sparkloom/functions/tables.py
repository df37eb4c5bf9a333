"""Table functions for SQL: a source's functions as rows, used through LATERAL. Rows go to and from Python as Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sparkloom.functions import source_code as sc

SHORT_DDL = "function_name string, start_line int, end_line int, source_code string, change_type string"


def _rows(found: list[dict], ddl: str) -> list[tuple]:
    names = [x.split(" ", 1)[0] for x in ddl.split(", ")]
    return [tuple(r[n] for n in names) for r in found]


class PythonFunctions:
    """python_functions(content)"""

    def eval(self, content: str):
        yield from _rows(sc.python_functions(content), sc.FUNCTION_DDL)


class ScriptFunctions:
    """script_functions(content, language)"""

    def eval(self, content: str, language: str):
        yield from _rows(sc.script_functions(content, language), sc.FUNCTION_DDL)


class FunctionsWithoutDiff:
    """functions_without_diff(content, language)"""

    def eval(self, content: str, language: str):
        find = sc.python_functions_without_diff if language == "python" else sc.script_functions_without_diff
        yield from _rows(find(content), SHORT_DDL)


class ClassSource:
    """class_source(content, language, name); no row where there is no such class"""

    def eval(self, content: str, language: str, name: str):
        found = (sc.python_class_source if language == "python" else sc.script_class_source)(content or "", name)
        if found:
            yield (found,)


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL in this session."""
    for name, table, ddl in (("python_functions", PythonFunctions, sc.FUNCTION_DDL), ("script_functions", ScriptFunctions, sc.FUNCTION_DDL), ("functions_without_diff", FunctionsWithoutDiff, SHORT_DDL), ("class_source", ClassSource, "class_source string")):
        spark.udtf.register(name, udtf(table, returnType=ddl, useArrow=True))
