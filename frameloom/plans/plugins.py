"""Analyses that others add: a plugin turns frames into alerts, DataFrame in and DataFrame out, so batches and streams run the same one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What every plugin returns, beside which it may return nothing.
ALERT = ("camera", "frame_no", "kind", "severity")


@dataclass(frozen=True)
class Plugin:
    """name and version tell whose alerts they are; analyze maps frames (camera, frame_no, ts, classes) to ALERT's columns; ready may say why it can't run."""

    name: str
    version: str
    analyze: Callable[[DataFrame], DataFrame]
    ready: Callable[[], str | None] = lambda: None


PLUGINS: dict[str, Plugin] = {}


def register(plugin: Plugin) -> Plugin:
    if plugin.name in PLUGINS:
        raise ValueError(f"{plugin.name} is taken")
    PLUGINS[plugin.name] = plugin
    return plugin


def analyze(frames: DataFrame, plugins: list[Plugin]) -> DataFrame:
    """The alerts of all plugins that are ready: plugin, version and ALERT's columns; one that breaks its contract is an error."""
    found = []
    for p in plugins:
        if p.ready() is None:
            alerts = p.analyze(frames)
            if tuple(alerts.columns) != ALERT:
                raise ValueError(f"{p.name} returns {alerts.columns}, not {ALERT}")
            found.append(alerts.select(F.lit(p.name).alias("plugin"), F.lit(p.version).alias("version"), *ALERT))
    if not found:
        raise ValueError("no plugin is ready")
    return reduce(DataFrame.unionByName, found)
