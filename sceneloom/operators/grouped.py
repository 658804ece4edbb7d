"""Sequential rules on small groups: rows of a group become one array, and a helper maps arrays to rows.

Groups are clips, frames or objects of a clip: tens of compact rows. Arrays travel in Arrow batches, so
there is no per-group overhead of a grouped map. Spark bounds a batch by bytes; only the group at hand becomes Python objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Rows = list[dict]

#: Rows that leave a task at once.
CHUNK = 1_000


def _reader(numbers: bool = False) -> Callable[[Iterable[pa.RecordBatch]], Iterator[tuple[tuple, Rows | np.ndarray]]]:
    """What gives groups one after another, from columns of the key and of the array of rows."""
    def matrix(rows: pa.StructArray) -> np.ndarray:
        return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in rows.flatten()])

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Rows | np.ndarray]]:
        for batch in batches:
            *keys, arrays = batch.columns
            for i in range(batch.num_rows):
                yield tuple(k[i].as_py() for k in keys), matrix(arrays[i].values) if numbers else arrays[i].as_py()

    return groups


def map_groups(df: DataFrame, keys: list[str], fields: list[str], rule: Callable[[tuple, Rows], Iterable[tuple]], schema: str, numbers: bool = False) -> DataFrame:
    """Apply ``rule(key, rows)`` to every group; rows come sorted by ``fields``, in that order.

    ``schema`` describes the output without the keys, which are put first. With ``numbers`` a group is a matrix with a column for each field.
    """
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__rows"))
    out = StructType(grouped.select(*keys).schema.fields + StructType.fromDDL(schema).fields)
    arrow, groups = to_arrow_schema(out), _reader(numbers)

    def packed(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(arrow.types)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for key, rows in groups(batches):
            for row in rule(key, rows):
                made.append((*key, *row))
                if len(made) == CHUNK:
                    yield packed(made)
                    made = []
        if made:
            yield packed(made)

    return grouped.mapInArrow(run, out)
