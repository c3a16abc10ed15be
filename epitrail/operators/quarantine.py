"""Batches that fail: halved until what is at fault stands alone, so that the rest goes on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

ERRORS = "item string, group string, batch string, reason string"


def bisected(items: list, attempt: Callable[[list], object], patience: int | None = None) -> Iterator[tuple[list, object, str | None]]:
    """(items, result, None) of the parts of a batch that succeed, in order, and ([item], None, reason) of each item that fails alone.

    k items at fault among n cost some 2 k log2(n) attempts, and no more than 2 n. An ``OSError``, as of a program that is not there, is no item's fault and is raised; so is
    the last error after ``patience`` failures without any success, if a patience is given: for programs and services that may be down, where whole batches of bad items do not occur.
    """
    waiting, failures, succeeded = [items], 0, False
    while waiting:
        part = waiting.pop()
        try:
            result = attempt(part)
        except OSError:
            raise
        except Exception as e:
            failures += 1
            if patience is not None and not succeeded and failures >= patience:
                raise
            if len(part) == 1:
                yield part, None, f"{type(e).__name__}: {e}"
            else:
                middle = len(part) // 2
                waiting += [part[middle:], part[:middle]]
        else:
            succeeded = True
            yield part, result, None


def batches_by(rows: Iterator[tuple], size: int) -> Iterator[tuple[tuple, list]]:
    """(key, items) of rows (item, *key) that come ordered by key, at most ``size`` items each."""
    key, items = None, []
    for item, *now in rows:
        if items and (now != key or len(items) >= size):
            yield tuple(key), items
            items = []
        key = now
        items.append(item)
    if items:
        yield tuple(key), items


def quarantined(df: DataFrame, attempt: Callable[[list, tuple], str], size: int, strict: bool, profile=None, patience: int | None = None) -> DataFrame:
    """``text, item, group, batch, reason``: the result of each batch, or of its parts, in ``text``; and a row with a ``reason`` for each item that fails alone.

    ``df``: the item, then its key, ordered by key within partitions; ``attempt(items, key)`` gives a text. ``strict``: the first failure is raised. ``batch`` names partition and
    number, so that a failure can be found in the logs. ``profile``: a resource profile of the stage. ``patience``: see :func:`bisected`.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        columns = ["text", "item", "group", "batch", "reason"]
        rows = (row for pdf in frames for row in pdf.itertuples(index=False, name=None))
        for number, (key, items) in enumerate(batches_by(rows, size)):
            if strict:
                yield pd.DataFrame([(attempt(items, key), None, None, None, None)], columns=columns)
                continue
            for some, text, reason in bisected(items, lambda x, key=key: attempt(x, key), patience):
                told = (text, None, None, None, None) if reason is None else (None, some[0], "/".join(map(str, key)), f"{part}-{number}", reason)
                yield pd.DataFrame([told], columns=columns)

    return df.mapInPandas(run, f"text string, {ERRORS}", profile=profile)
