"""Sequential folds: rows of a key in order, state carried from one row to the next.

Used only where a decision depends on earlier decisions. Spark partitions and sorts the rows;
a task streams over them in Arrow batches with one key's state in memory, so no group is ever
collected. The same step functions drive the streaming operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[dict, tuple | None], tuple[dict, tuple]]


def fold_frame(pdf: pd.DataFrame, keys: list[str], step: Step, current, state):
    """Run `step(row, state) -> (output, state)` over sorted rows, starting anew at each key."""
    columns = list(pdf.columns)
    places = [columns.index(k) for k in keys]
    out = []
    for values in pdf.itertuples(index=False, name=None):
        key = tuple(values[p] for p in places)
        if key != current:
            current, state = key, None
        produced, state = step(dict(zip(columns, values)), state)
        out.append(produced)
    return out, current, state


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """Fold the rows of each key in `order`; one output row per input row."""
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out, current, state = fold_frame(pdf, keys, step, current, state)
            yield pd.DataFrame(out, columns=names)

    return sorted_rows.mapInPandas(run, schema)
