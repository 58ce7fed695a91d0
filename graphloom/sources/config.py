"""Settings: `key = value` files with # and % comments, and command lines with --key=value or `key value`. The command line wins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Defaults of the engine's settings.
DEFAULTS = {"memory": "2000", "alpha": "0.75", "filetype": "edgelist", "membudget_mb": "1024", "outputfile": "", "include_isolated": "0"}


@dataclass
class Config:
    values: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Config:
        out = {}
        for line in text.splitlines():
            line = line.strip()
            if line and line[0] not in "#%":
                key, found, value = line.partition("=")
                if not found:
                    raise ValueError(f"not a setting: {line}")
                out[key.strip()] = value.strip()
        return cls(out)

    @classmethod
    def arguments(cls, argv: list[str]) -> Config:
        out, i = {}, 0
        while i < len(argv):
            if argv[i].startswith("--"):
                key, _, value = argv[i][2:].partition("=")
                out[key] = value or "1"
                i += 1
            else:
                out[argv[i]] = argv[i + 1] if i + 1 < len(argv) else ""
                i += 2
        return cls(out)

    @classmethod
    def load(cls, spark: SparkSession, path: str | None, argv: list[str]) -> Config:
        told = cls.parse(spark.read.text(path, wholetext=True).first()[0]).values if path else {}
        return cls(DEFAULTS | told | cls.arguments(argv).values)

    def string(self, key: str, default: str | None = None) -> str:
        found = self.values.get(key, default)
        if found is None:
            raise KeyError(key)
        return found

    def integer(self, key: str, default: int | None = None) -> int:
        return int(self.string(key, None if default is None else str(default)))

    def number(self, key: str, default: float | None = None) -> float:
        return float(self.string(key, None if default is None else str(default)))

    def flag(self, key: str, default: bool = False) -> bool:
        return self.string(key, "1" if default else "0").lower() in ("1", "true", "yes")


def hosts(spark: SparkSession, path: str | None = None) -> int:
    """Lines of a host file, or the cluster's parallelism."""
    if path is None:
        return spark.sparkContext.defaultParallelism
    return spark.read.text(path).where("trim(value) <> ''").count()
