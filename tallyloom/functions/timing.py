"""Wall-clock time and counted rows by stage name."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class StageTimer:
    """Adds up seconds by name; a name may run many times. Spark is lazy: time what holds an action."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    @property
    def total(self) -> float:
        return sum(self.seconds.values())

    def report(self) -> str:
        return "\n".join([*(f"{name}: {s:.3f} s" for name, s in self.seconds.items()), f"total: {self.total:.3f} s"])


class StageCounters:
    """Numbers that the executors count while a query runs, by stage and group: no pass of its own, no clock of the driver."""

    def __init__(self):
        self._seen: list[tuple[str, str, Observation]] = []

    def counted(self, df: DataFrame, stage: str, group: str = "", **numbers: Column) -> DataFrame:
        """df, whose rows, and aggregates by name, are counted in the next action that runs it to its end."""
        self._seen.append((stage, group, seen := Observation()))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in numbers.items()])

    def numbers(self) -> dict[tuple[str, str], dict]:
        """(stage, group): its numbers, summed up if it was counted several times. Waits for what hasn't run yet."""
        out: dict[tuple[str, str], dict] = {}
        for stage, group, seen in self._seen:
            own = out.setdefault((stage, group), {})
            for name, n in seen.get.items():
                own[name] = own.get(name, 0) + (n or 0)
        return out
