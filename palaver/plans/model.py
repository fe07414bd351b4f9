"""Calling an external model from tasks: retries, pace, budget, and the cross product of an evaluation run."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXIT_CODES = {"ok": 0, "failed": 1, "usage": 2, "not_found": 3, "denied": 4, "network": 5, "timeout": 6}


def exit_code(error: BaseException) -> int:
    """A process exit code for an error: by what its text says, then by its type."""
    text = str(error).lower()
    for word, code in (("timed out", "timeout"), ("timeout", "timeout"), ("permission", "denied"), ("not found", "not_found"), ("no such file", "not_found"), ("connection", "network")):
        if word in text:
            return EXIT_CODES[code]
    for kind, code in ((FileNotFoundError, "not_found"), (PermissionError, "denied"), (TimeoutError, "timeout"), (ConnectionError, "network"), (ValueError, "usage")):
        if isinstance(error, kind):
            return EXIT_CODES[code]
    return EXIT_CODES["failed"]


def is_transient(error: BaseException) -> bool:
    """Whether another try may help: lost connections, time-outs, and replies 429 or 5xx."""
    status = getattr(error, "status_code", None)
    return isinstance(error, (ConnectionError, TimeoutError)) or (isinstance(status, int) and (status == 429 or status >= 500))


def with_retries(complete: Callable[[str], str | None], tries: int = 3, per_minute: float | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """``complete`` with up to ``tries`` tries (2 ** n seconds between) and at most ``per_minute`` calls from this task.

    Give each task its share: the provider's limit divided by the tasks that run at once.
    """
    last = [0.0]

    def call(prompt: str) -> str | None:
        for n in range(tries):
            if per_minute:
                sleep(max(0.0, last[0] + 60 / per_minute - time.monotonic()))
                last[0] = time.monotonic()
            try:
                return complete(prompt)
            except Exception as e:
                if n + 1 == tries or not is_transient(e):
                    return None
                sleep(2.0**n)
        return None

    return call


def render(template: str, **values: str | Column) -> Column:
    """A prompt: the template with {name} replaced by columns or constants."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value if isinstance(value, Column) else F.lit(value))
    return out


def ask(rows: DataFrame, prompt: Column, complete: Callable[[str], str | None] | None, column: str = "reply", admitted: Column | None = None) -> DataFrame:
    """``rows`` with the model's replies; null where there is no model, no prompt, or no answer.  Batches go by Arrow.

    ``admitted``: which rows the budget allows (see ``usage.admit``); for the others, and where it is null, the model is not called.
    """
    if admitted is not None:
        prompt = F.when(admitted, prompt)
    if complete is None:
        return rows.withColumn(column, F.lit(None).cast("string"))

    def one(p):
        try:
            return None if p is None else complete(p)
        except Exception:
            return None

    def ask_all(prompts):
        return prompts.map(one)

    ask_all.__annotations__ = {"prompts": pd.Series, "return": pd.Series}
    return rows.withColumn(column, F.pandas_udf(ask_all, "string")(prompt))


def run_benchmark(models: DataFrame, tasks: DataFrame, fixtures: DataFrame, complete: Callable[[str], str | None] | None = None) -> DataFrame:
    """Every model (model) on every task (task, template) and fixture (fixture, transcript): the cross product of three
    small tables by design; more than 10,000 models, 100 tasks or 1,000 fixtures are refused."""
    for df, most, what in ((models, 10_000, "models"), (tasks, 100, "tasks"), (fixtures, 1_000, "fixtures")):
        if df.count() > most:
            raise ValueError(f"more than {most} {what}")
    grid = models.join(F.broadcast(tasks), how="cross").join(F.broadcast(fixtures), how="cross")
    prompt = F.replace(F.col("template"), F.lit("{transcript}"), F.coalesce("transcript", F.lit("")))
    return ask(grid.repartition("model"), F.concat(F.col("model"), F.lit("\n"), prompt), complete, "response")
