"""Steps of a job, one after another, each with its own errors (N09, N10, M07); connectors and settings."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession


def retried(f: Callable, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """What f() gives, tried again after an error; waits double. The last error is raised."""
    for k in range(attempts):
        try:
            return f()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(wait * 2**k)


def run_steps(steps: dict[str, Callable], only: list[str] | None = None, attempts: int = 1, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """Step to `ok`, `skipped` or `ERROR:<kind>`; one that fails doesn't stop the others. A name that is no step raises."""
    if unknown := set(only or ()) - set(steps):
        raise ValueError(f"no such steps: {sorted(unknown)}")
    out = {}
    for name, f in steps.items():
        if only is not None and name not in only:
            out[name] = "skipped"
            continue
        try:
            retried(f, attempts, wait, sleep)
            out[name] = "ok"
        except Exception as e:
            out[name] = f"ERROR:{type(e).__name__}"
    return out


def throttled(items: Iterable, wait: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator:
    """The items, of which no two start within `wait` seconds."""
    last = None
    for x in items:
        if last is not None and (left := last + wait - clock()) > 0:
            sleep(left)
        last = clock()
        yield x


def connectors(spark: SparkSession, names: Iterable[str]) -> dict[str, str]:
    """Registers data sources that are named `module:Class`; each name to `ok` or `missing`, the others stay usable."""
    out = {}
    for name in names:
        module, _, source = name.partition(":")
        try:
            spark.dataSource.register(getattr(importlib.import_module(module), source))
            out[name] = "ok"
        except (ModuleNotFoundError, AttributeError):
            out[name] = "missing"
    return out


def settings(spark: SparkSession, defaults: dict[str, str], prefix: str = "spark.steleworks.") -> dict[str, str]:
    """Defaults, overridden by what the session's configuration holds under the prefix."""
    return {k: spark.conf.get(prefix + k, v) for k, v in defaults.items()}
