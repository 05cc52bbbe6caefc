"""Models as plug-ins over batches of rows: an encoder or scorer is any function from a list of inputs to a list of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def infer(rows: DataFrame, key: str, column: str, load: Callable[[], Callable[[list], list]], result: str, batch: int = 32) -> DataFrame:
    """(key, result, error): what a model makes of `column`, and why it failed where it did.

    load: makes the model, once a task. A batch that fails is tried row by row, so one bad input costs its own row
    only; null inputs fail as 'no input'. result: the SQL type of a result.
    """
    types = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(value: object) -> tuple[object, str | None]:
            try:
                return ("", "no input") if value is None else (model([value])[0], None)
            except Exception as e:  # noqa: BLE001 the error of one input is data
                return None, f"{type(e).__name__}: {e}"

        for pdf in batches:
            out: list[tuple] = []
            values = pdf[column].tolist()
            for at in range(0, len(values), batch):
                part = values[at : at + batch]
                try:
                    if any(v is None for v in part):
                        raise ValueError
                    done = [(r, None) for r in model(part)]
                except Exception:  # noqa: BLE001
                    done = [(None, e) if e else (r, e) for r, e in map(one, part)]
                out += done
            yield pd.DataFrame({key: pdf[key], "result": pd.Series([r for r, _ in out], dtype=object), "error": pd.Series([e for _, e in out], dtype=object)})

    return rows.select(key, column).mapInPandas(run, f"{key} {types[key]}, result {result}, error STRING")
