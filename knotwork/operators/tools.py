"""Tool calls as data: a registry of column functions, calls grouped by tool, outcomes and trajectories."""

from __future__ import annotations

import ast
import inspect
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.session import ship


@dataclass
class Tool:
    """A function from a column of arguments to a column of results; ``required`` arguments are keys of a JSON object."""

    name: str
    apply: Callable[[Column], Column]
    description: str = ""
    required: tuple[str, ...] = ()
    reward: Callable[[Column, Column], Column] = field(default=lambda arguments, result: F.when(result.isNotNull(), 0.0).otherwise(-0.1))

    def valid(self, arguments: Column) -> Column:
        """Whether the arguments are a JSON object with all that is required."""
        ok = F.get_json_object(arguments, "$").isNotNull()
        for key in self.required:
            ok = ok & F.get_json_object(arguments, f"$.{key}").isNotNull()
        return F.coalesce(ok, F.lit(False))


def tool(name: str | None = None, description: str = "") -> Callable[[Callable], Tool]:
    """Make a tool of a function of columns; its parameters' names are the required arguments."""
    def made(f: Callable[..., Column]) -> Tool:
        keys = tuple(inspect.signature(f).parameters)
        return Tool(name or f.__name__, lambda a: f(*(F.get_json_object(a, f"$.{k}") for k in keys)), description or (f.__doc__ or ""), keys)

    return made


def run_calls(calls: DataFrame, tools: list[Tool]) -> DataFrame:
    """Results of calls (``call_id, tool, arguments``): adds ``outcome`` and ``result``. Each tool runs over its own calls.

    Outcomes: 'ok'; 'no_call' (the tool is NULL); 'unknown_tool'; 'invalid' (arguments that the tool can't take); 'failed'
    (a NULL result).
    """
    names = [t.name for t in tools]
    kind = F.when(F.col("tool").isNull(), "no_call").when(~F.col("tool").isin(names), "unknown_tool")
    for t in tools:
        kind = kind.when((F.col("tool") == t.name) & ~t.valid(F.col("arguments")), "invalid")
    marked = calls.withColumn("outcome", kind.otherwise("ok"))
    parts = [marked.filter(F.col("outcome") != "ok").withColumn("result", F.lit(None).cast("string"))]
    for t in tools:
        done = marked.filter((F.col("outcome") == "ok") & (F.col("tool") == t.name)).withColumn("result", t.apply(F.col("arguments")).cast("string"))
        parts.append(done.withColumn("outcome", F.when(F.col("result").isNull(), "failed").otherwise("ok")))
    return reduce(DataFrame.unionByName, parts)


def trajectories(actions: DataFrame) -> DataFrame:
    """``trajectory_id, steps, valid, effective, reward, history`` of actions (``trajectory_id, step, tool, outcome, result,
    reward``). The history lists the calls by number; a trajectory's length bounds it."""
    line = F.concat(F.lit("Tool call "), F.col("step").cast("string"), F.lit(": "), F.coalesce("tool", F.lit("none")), F.lit(" -> "), F.coalesce("result", F.col("outcome")))
    return actions.groupBy("trajectory_id").agg(
        F.count("*").alias("steps"),
        F.count_if(F.col("outcome").isin("ok", "failed")).alias("valid"),
        F.count_if(F.col("outcome") == "ok").alias("effective"),
        F.sum("reward").alias("reward"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"),
    )


def turns_with_calls(turns: DataFrame, most: int) -> DataFrame:
    """``trajectory_id, turns``: turns with a call, up to the first without one or ``most``."""
    w = Window.partitionBy("trajectory_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alive = turns.withColumn("alive", F.min(F.col("has_call").cast("int")).over(w))
    return alive.groupBy("trajectory_id").agg(F.least(F.sum("alive"), F.lit(most)).alias("turns"))


_OPERATIONS = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv,
    ast.Mod: operator.mod, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos,
}


def evaluate(expression: str | None) -> float | None:
    """Value of an arithmetic expression; None if it is anything else, too large, or divides by 0. Nothing is executed."""
    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATIONS:
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and (abs(b) > 64 or abs(a) > 1e6):
                raise ValueError
            return _OPERATIONS[type(node.op)](a, b)
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATIONS:
            return _OPERATIONS[type(node.op)](value(node.operand))
        raise ValueError

    if not expression or len(expression) > 1000:
        return None
    try:
        out = float(value(ast.parse(expression.strip(), mode="eval")))
    except (SyntaxError, ValueError, TypeError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None
    return out if math.isfinite(out) else None


def _evaluated(expressions: pd.Series) -> pd.Series:
    return expressions.map(evaluate, na_action=None).astype("float64")


def calculate(df: DataFrame, expression: str, out: str = "value") -> DataFrame:
    """``out``: the value of each arithmetic expression, NULL where there is none."""
    ship(df.sparkSession)
    found = F.pandas_udf(_evaluated, T.DoubleType())(F.col(expression))
    return df.withColumn(out, F.when(F.isnan(found), F.lit(None)).otherwise(found))
