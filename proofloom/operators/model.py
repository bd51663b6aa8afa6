"""One hook for outside models: a batched call with retries, and result reuse."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def call_model(rows: DataFrame, inputs: list[str], fn: Callable[[list[tuple]], Sequence], out: str,
               out_type: T.DataType | str = "string", batch: int = 10, tries: int = 3,
               wait: float = 1.0, parallel: int | None = None) -> DataFrame:
    """Add ``out`` and ``<out>_error`` by calling ``fn`` on batches of rows.

    ``fn`` gets up to ``batch`` tuples of the input columns and returns as many
    results in order. A batch that fails ``tries`` times (doubling waits) gives
    NULL and an error text; no row is lost and nothing is raised. ``parallel``
    limits concurrent callers by limiting partitions.
    """
    if isinstance(out_type, str):
        out_type = T._parse_datatype_string(out_type)
    error = f"{out}_error"
    schema = T.StructType([*rows.schema.fields, T.StructField(out, out_type),
                           T.StructField(error, T.StringType())])

    def attempt(items: list[tuple]):
        for n in range(tries):
            try:
                results = list(fn(items))
                if len(results) != len(items):
                    raise ValueError(f"{len(results)} results for {len(items)} rows")
                return results, None
            except Exception as problem:  # noqa: BLE001 - any model failure is data here
                message = f"{type(problem).__name__}: {problem}"
                if n + 1 < tries:
                    time.sleep(wait * 2 ** n)
        return [None] * len(items), message

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results, errors = [], []
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                values, message = attempt(list(part[inputs].itertuples(index=False, name=None)))
                results.extend(values)
                errors.extend([message] * len(part))
            yield frame.assign(**{out: pd.Series(results, index=frame.index, dtype=object),
                                  error: pd.Series(errors, index=frame.index, dtype=object)})

    placed = rows if parallel is None else rows.repartition(parallel)
    return placed.mapInPandas(scan, schema)


def reuse_results(rows: DataFrame, cache: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose content hash has a stored result, and one row per new hash."""
    hits = rows.join(cache.select(key, value), key, "inner")
    misses = rows.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    return hits, misses


def apply_results(rows: DataFrame, cache: DataFrame, fresh: DataFrame, key: str, value: str) -> DataFrame:
    """Every row with its stored or fresh result (NULL where the call failed)."""
    known = cache.select(key, value).unionByName(
        fresh.filter(F.col(value).isNotNull()).select(key, value))
    one = known.groupBy(key).agg(F.min(value).alias(value))
    return rows.join(one, key, "left")
