"""Extension points: named transforms with hooks before and after, and functions run over selected rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transform = Callable[..., DataFrame]


class Registry:
    """Transforms by name; hooks are called with the name, the input and the settings, and (after) the output."""

    def __init__(self):
        self.transforms: dict[str, Transform] = {}
        self.before: dict[str, list[Callable]] = {}
        self.after: dict[str, list[Callable]] = {}

    def register(self, name: str) -> Callable[[Transform], Transform]:
        def add(f: Transform) -> Transform:
            self.transforms[name] = f
            return f

        return add

    def on(self, name: str, hook: Callable, after: bool = False) -> None:
        """Adds a hook to a transform, or to all under the name ``*``."""
        (self.after if after else self.before).setdefault(name, []).append(hook)

    def run(self, name: str, df: DataFrame, **settings) -> DataFrame:
        if name not in self.transforms:
            raise ValueError(f"no transform {name}")
        for hook in [*self.before.get("*", []), *self.before.get(name, [])]:
            df = hook(name, df, settings) or df
        out = self.transforms[name](df, **settings)
        for hook in [*self.after.get("*", []), *self.after.get(name, [])]:
            out = hook(name, out, settings) or out
        return out


def foreach(df: DataFrame, key: str, f: Callable[[dict], object]) -> DataFrame:
    """key, result, error: a function of one row's values run over all rows in Arrow batches; an error stays with its row."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                try:
                    value = f(row)
                    rows.append((row[key], None if value is None else str(value), None))
                except Exception as e:  # noqa: BLE001 - whatever the function raises belongs to the row
                    rows.append((row[key], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "result", "error"])

    return df.mapInPandas(run, f"`{key}` {kind}, result string, error string")


def presets(select: Callable[[str], DataFrame], values: Callable[[str, str], DataFrame], preset: dict[str, tuple[str, str, dict[str, str]]]) -> dict[str, DataFrame]:
    """Tables of a facility preset: category -> (class, selection, {header: path}); one column for each path."""
    out = {}
    for category, (cls, text, columns) in preset.items():
        t = select(text).where(F.col("class") == cls).select("id", "name")
        for header, path in columns.items():
            t = t.join(values(cls, path).withColumnRenamed("value", header), "id", "left")
        out[category] = t
    return out
