"""Named metrics, and reports of them."""

from __future__ import annotations

import json
import logging
import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("graphloom")


@dataclass
class Entry:
    kind: str
    value: float = 0.0
    count: int = 0
    least: float = float("inf")
    most: float = float("-inf")
    vector: list[float] = field(default_factory=list)
    text: str | None = None


class Metrics:
    """Counters, values, times and vectors by name, kept on the driver."""

    def __init__(self, name: str = "") -> None:
        self.name, self.entries = name, {}

    def _entry(self, key: str, kind: str) -> Entry:
        return self.entries.setdefault(key, Entry(kind))

    def add(self, key: str, value: float, kind: str = "real") -> None:
        e = self._entry(key, kind)
        e.value, e.count, e.least, e.most = e.value + value, e.count + 1, min(e.least, value), max(e.most, value)

    def set(self, key: str, value: float) -> None:
        e = self._entry(key, "real")
        e.value, e.count, e.least, e.most = value, 1, value, value

    def text(self, key: str, value: str) -> None:
        self._entry(key, "string").text = value

    def add_to_vector(self, key: str, value: float) -> None:
        self.add(key, value, "vector")
        self.entries[key].vector.append(value)

    @contextmanager
    def timed(self, key: str):
        started = time.monotonic()
        try:
            yield
        finally:
            self.add(key, time.monotonic() - started, "time")

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, kind, value, count, min, max, avg)"""
        rows = [(k, e.kind, float(e.value), e.count, float(e.least) if e.count else None, float(e.most) if e.count else None, e.value / e.count if e.count else None) for k, e in self.entries.items()]
        return spark.createDataFrame(rows, "name string, kind string, value double, count long, min double, max double, avg double")

    def report(self, to: str = "log", path: str | None = None) -> str:
        """A report as log lines, 'text', 'json' or 'html', written to a local path of the driver if given; 'null' is empty."""
        rows = {k: e.text if e.text is not None else {"kind": e.kind, "value": e.value, "count": e.count, "avg": e.value / e.count if e.count else None} for k, e in self.entries.items()}
        lines = [f"{self.name}.{k}: {v}" for k, v in rows.items()]
        if to == "log":
            for line in lines:
                log.info(line)
        out = {"log": "\n".join(lines), "text": "\n".join(lines), "json": json.dumps(rows), "null": "", "html": "<table>" + "".join(f"<tr><td>{escape(k)}</td><td>{escape(str(v))}</td></tr>" for k, v in rows.items()) + "</table>"}[to]
        if path:
            with open(path, "w") as f:
                f.write(out)
        return out


class TimeSeries:
    """Named series over time, such as edges, buffered edges, updates, ingested rows and changes of a running loop or stream."""

    def __init__(self) -> None:
        self.started, self.rows = time.monotonic(), []

    def record(self, **values: float) -> None:
        at = time.monotonic() - self.started
        self.rows.extend((at, k, float(v)) for k, v in values.items())

    def table(self, spark: SparkSession) -> DataFrame:
        """(seconds, name, value)"""
        return spark.createDataFrame(self.rows, "seconds double, name string, value double")

    def svg(self, name: str, width: int = 600, height: int = 200) -> str:
        """One series as a line in an SVG picture."""
        points = [(t, v) for t, k, v in self.rows if k == name]
        last, top = max((t for t, _ in points), default=0) or 1, max((v for _, v in points), default=0) or 1
        line = " ".join(f"{t / last * width:.1f},{height - v / top * height:.1f}" for t, v in points)
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><title>{escape(name)}</title><polyline fill="none" stroke="black" points="{line}"/></svg>'


def set_logging(level: str = "info", path: str | None = None) -> None:
    """Send the package's log of a level ('debug' to 'error', 'off') and above to the standard error stream or a local file."""
    handler = logging.FileHandler(path) if path else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(levelname)s: %(name)s(%(funcName)s:%(lineno)d): %(message)s"))
    log.handlers[:] = [handler]
    log.setLevel(logging.CRITICAL + 1 if level == "off" else level.upper())


def summary(values: DataFrame, value: str) -> DataFrame:
    """(count, min, max, avg, sum) of a column: the same aggregates for data that is a table."""
    return values.agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), F.sum(value).alias("sum"))
