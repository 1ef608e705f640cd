"""Step graphs over DataFrames with saved results, and scatter-gather."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Step:
    """A function of its parents' results.  ``retries`` more attempts follow a failure; ``loop`` repeats the step on its own result
    until it returns False, at most ``most`` times.  Only errors of ``retry_on`` are tried again."""

    name: str
    run: Callable[..., DataFrame]
    after: list[str] = field(default_factory=list)
    retries: int = 0
    wait: float = 0.0
    loop: Callable[[DataFrame, int], bool] | None = None
    most: int = 100
    retry_on: tuple[type[Exception], ...] = (Exception,)


@dataclass
class Stop:
    """What a step returns to end its branch: the result, if any, is saved, and no step that needs it is run.  With ``everything`` no
    further step is begun at all."""

    result: DataFrame | None = None
    everything: bool = False


class Graph:
    """Runs steps in the order of their dependencies, independent ones side by side, and saves each result as a table.

    A saved result is read instead of computed, so a run that broke off resumes where it ended; a result only counts when it was
    written to the end.  ``fresh`` names steps to compute again, with all that follow them.
    """

    def __init__(self, spark: SparkSession, steps: list[Step], folder: str, workers: int = 4):
        self.spark, self.folder, self.workers = spark, folder.rstrip("/"), workers
        self.steps = {s.name: s for s in steps}
        if len(self.steps) != len(steps):
            raise ValueError("two steps have one name")
        self.order = self._sorted()

    def _sorted(self) -> list[str]:
        out: list[str] = []
        state: dict[str, int] = {}
        for root in self.steps:
            todo = [(root, False)]
            while todo:
                name, done = todo.pop()
                if done:
                    state[name] = 2
                    out.append(name)
                    continue
                if state.get(name) == 2:
                    continue
                if state.get(name) == 1:
                    raise ValueError(f"step {name} depends on itself")
                state[name] = 1
                todo.append((name, True))
                for parent in self.steps[name].after:
                    if state.get(parent) == 1:
                        raise ValueError(f"step {parent} depends on itself")
                    todo.append((parent, False))
        return out

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def saved(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name) + "/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _one(self, name: str, parents: list[DataFrame]) -> DataFrame | Stop:
        step = self.steps[name]
        for attempt in range(step.retries + 1):
            try:
                result = step.run(*parents)
                if isinstance(result, Stop):
                    if result.result is not None:
                        result.result.write.mode("overwrite").parquet(self.path(name))
                    return result
                for i in range(step.most):
                    if step.loop is None or not step.loop(result, i):
                        break
                    result = step.run(result)
                result.write.mode("overwrite").parquet(self.path(name))
                return self.spark.read.schema(result.schema).parquet(self.path(name))
            except Exception as e:
                if attempt == step.retries or not isinstance(e, step.retry_on):
                    raise
                time.sleep(step.wait)
        raise AssertionError

    def run(self, fresh: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        stale = set(fresh)
        for name in self.order:
            if stale & set(self.steps[name].after):
                stale.add(name)
        done: dict[str, DataFrame] = {}
        dropped: set[str] = set()
        running: dict = {}
        with ThreadPoolExecutor(self.workers) as pool:
            pending = list(self.order)
            while pending or running:
                for n in list(pending):
                    after = self.steps[n].after
                    if dropped & set(after):
                        dropped.add(n)
                        pending.remove(n)
                    elif all(p in done for p in after):
                        pending.remove(n)
                        if n not in stale and self.saved(n):
                            done[n] = self.spark.read.parquet(self.path(n))
                        else:
                            running[pool.submit(self._one, n, [done[p] for p in after])] = n
                if not running:
                    continue
                for f in wait(running, return_when=FIRST_COMPLETED).done:  # a step begins as soon as its own parents have ended
                    n, result = running.pop(f), f.result()
                    if isinstance(result, Stop):
                        dropped.add(n)
                        if result.result is not None:
                            done[n] = self.spark.read.schema(result.result.schema).parquet(self.path(n))
                        if result.everything:
                            pending = []
                    else:
                        done[n] = result
        return done


def line(spark: SparkSession, folder: str, *steps: tuple[str, Callable[..., DataFrame]]) -> Graph:
    """Steps one after the other."""
    names = [n for n, _ in steps]
    return Graph(spark, [Step(n, f, names[i - 1 : i] if i else []) for i, (n, f) in enumerate(steps)], folder)


def scatter(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, parts: int | None = None) -> DataFrame:
    """A function of pandas frames over the batches of even partitions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield f(frame)

    return (df.repartition(parts) if parts else df).mapInPandas(run, schema)


def retried(f: Callable, attempts: int = 3, wait: float = 0.0, valid: Callable[[object], bool] | None = None, default: object = ...):
    """Call until the result is valid; after the last attempt the default, or the error."""
    error: Exception | None = None
    for i in range(attempts):
        try:
            out = f()
            if valid is None or valid(out):
                return out
            error = ValueError("the result is not valid")
        except Exception as e:  # noqa: BLE001
            error = e
        if i + 1 < attempts:
            time.sleep(wait)
    if default is not ...:
        return default
    raise error


def side_by_side(calls: list[Callable[[], object]], limit: int = 4) -> list[object]:
    """Independent driver calls, at most ``limit`` at a time."""
    with ThreadPoolExecutor(limit) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]
