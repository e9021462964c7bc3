"""Read-only SQL: a statement is checked before and after analysis, then capped."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelake.fixed_values import MAX_ROWS, NO_ROWS, REFUSED, SQL_ERROR, TRUNCATED

# Plan nodes and expressions a read-only query must not contain.
_WRITES = ("Command", "Insert", "Delete", "Update", "Merge", "Overwrite", "Append", "CreateTable",
           "DropTable", "ReplaceTable", "ScriptTransformation")
_CODE_CALLS = ("CallMethodViaReflection", "TryReflect")


class StatementRejected(ValueError):
    """The text is not a read-only query."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _names(jvm_class) -> set[str]:
    """Simple names of a node's class, its parents and their interfaces."""
    names: set[str] = set()
    while jvm_class is not None:
        names.add(jvm_class.getName().rsplit(".", 1)[-1].rstrip("$"))
        names.update(i.getName().rsplit(".", 1)[-1] for i in jvm_class.getInterfaces())
        jvm_class = jvm_class.getSuperclass()
    return names


def _check(plan) -> None:
    """Walk a logical plan, its CTEs, expressions and subqueries."""
    stack = [plan]
    while stack:
        node = stack.pop()
        names = _names(node.getClass())
        own = node.getClass().getName().rsplit(".", 1)[-1]
        if "LogicalPlan" in names:
            if "Command" in names or any(own.startswith(w) or own.endswith(w) for w in _WRITES):
                raise StatementRejected("only SELECT or WITH queries are allowed")
            stack.extend(_items(node.expressions()))
            stack.extend(_items(node.innerChildren()))
        elif names & set(_CODE_CALLS):
            raise StatementRejected("calls into JVM methods are not allowed")
        elif "PlanExpression" in names:
            stack.append(node.plan())
        if "LogicalPlan" in names or "Expression" in names:
            stack.extend(_items(node.children()))


def read_only(spark: SparkSession, text: str) -> DataFrame:
    """The query as a DataFrame, or `StatementRejected`.

    Spark runs commands while building a DataFrame, so the parsed plan is
    checked first. Reading files by path is off where the statement is analysed.
    """
    if not text.strip().lower().startswith(("select", "with")):
        raise StatementRejected("only SELECT or WITH queries are allowed")
    _check(spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
    # A copy of the session, views and settings included, analyses the statement first: no setting of the shared one changes.
    copy = spark._jsparkSession.cloneSession()
    copy.conf().set("spark.sql.runSQLOnFiles", "false")
    _check(copy.sql(text).queryExecution().analyzed())
    return spark.sql(text)


def last_of_repeated_names(df: DataFrame) -> DataFrame:
    """Of output columns with one name, the last is kept."""
    last = {name: i for i, name in enumerate(df.columns)}
    if len(last) == len(df.columns):
        return df
    renamed = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"_{i}").alias(name) for name, i in last.items()])


def run_sql(spark: SparkSession, text: str, cap: int | None = MAX_ROWS) -> DataFrame:
    """A read-only query's rows: at most `cap + 1` of them, or all for `cap=None`.

    The limit is part of the plan, so a capped query stops early; the row
    beyond the cap is there to tell that the result was cut (`render`).
    """
    df = last_of_repeated_names(read_only(spark, text))
    return df if cap is None else df.limit(cap + 1)


def render(spark: SparkSession, text: str, cap: int = MAX_ROWS) -> str:
    """What a reader is shown: rows, or a message. Never holds more than `cap + 1` rows."""
    try:
        rows = [row.asDict(recursive=True) for row in run_sql(spark, text, cap).collect()]
    except StatementRejected:
        return REFUSED
    except Exception as problem:  # the reader gets the engine's own message
        return SQL_ERROR.format(problem=problem)
    if not rows:
        return NO_ROWS
    return str(rows[:cap]) + (TRUNCATED.format(cap=cap) if len(rows) > cap else "")
