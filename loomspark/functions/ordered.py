"""One pass over each key's rows in order, with a small state, in Arrow batches: no task holds a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame


def in_order(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """df with each key's rows in one partition, one after the other by `order`. Spark's sort spills to disk."""
    return df.repartition(key).sortWithinPartitions(key, *order)


def other(a, b) -> bool:
    """Whether two keys differ. Null is a key, NaN too."""
    return a is not b and a != b and (a == a or b == b)


def walk(state: Callable, names: Sequence[str], kinds: Sequence[pa.DataType]):
    """For mapInArrow over in_order(): the first column is the key, the others go to state().step row by row.

    step(*values) and end() give rows for the columns after the key; a state lives from a key's first row to its last.
    """

    def run(batches):
        key, now, kind = None, None, None

        def batch_of(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind, *kinds], strict=True)], names=list(names))

        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for k, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or other(k, key):
                    if now is not None:
                        out += [(key, *r) for r in now.end()]
                    key, now = k, state()
                out += [(key, *r) for r in now.step(*values)]
            if out:
                yield batch_of(out)
        if now is not None and (out := [(key, *r) for r in now.end()]):
            yield batch_of(out)

    return run
