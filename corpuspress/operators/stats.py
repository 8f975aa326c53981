"""Phases of a computation: nested timings with values, as a relation or as JSON."""

from __future__ import annotations

import json
import time
import tracemalloc
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Phases:
    """``with phases("name"):`` nests; ``log`` adds a value to the open phase."""

    def __init__(self, title: str = "root", memory: bool = False):
        self.memory = memory
        if memory and not tracemalloc.is_tracing():
            tracemalloc.start()
        self.root = self._new(title)
        self.open = [self.root]

    def _new(self, title: str) -> dict:
        return {"title": title, "timeStart": time.time() * 1000, "timeEnd": None, "memOff": self._now(), "memPeak": 0, "memFinal": 0, "stats": {}, "sub": []}

    def _now(self) -> int:
        return tracemalloc.get_traced_memory()[0] if self.memory else 0

    @contextmanager
    def __call__(self, title: str):
        phase = self._new(title)
        self.open[-1]["sub"].append(phase)
        self.open.append(phase)
        try:
            yield self
        finally:
            self._close(self.open.pop())

    def _close(self, phase: dict) -> None:
        phase["timeEnd"] = time.time() * 1000
        phase["memFinal"] = self._now()
        phase["memPeak"] = max([phase["memFinal"], phase["memOff"], *(s["memPeak"] for s in phase["sub"])])

    def log(self, key: str, value: object) -> None:
        self.open[-1]["stats"][key] = str(value)

    def split(self, title: str) -> None:
        """End the open phase and begin a sibling."""
        self._close(self.open.pop())
        phase = self._new(title)
        self.open[-1]["sub"].append(phase)
        self.open.append(phase)

    def to_json(self) -> str:
        if self.root["timeEnd"] is None:
            self._close(self.root)
        return json.dumps(self.root)


SCHEMA = "path string, title string, depth int, time_start double, time_end double, mem_off bigint, mem_peak bigint, mem_final bigint, stats map<string,string>"


def rows_of(phase: dict, path: str = "") -> list[tuple]:
    here = f"{path}/{phase['title']}"
    own = (here, phase["title"], here.count("/") - 1, phase["timeStart"], phase["timeEnd"], phase["memOff"], phase["memPeak"], phase["memFinal"], phase["stats"])
    return [own, *(r for s in phase["sub"] for r in rows_of(s, here))]


def phase_rows(spark: SparkSession, text: str) -> DataFrame:
    """A row for each phase of a JSON tree."""
    return spark.createDataFrame(rows_of(json.loads(text)), SCHEMA)
