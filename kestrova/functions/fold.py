"""Ordered folds: state machines over series, one pass, constant memory."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kestrova.series import CODE, SEQ


def fold(df: DataFrame, inputs: Sequence[str], outputs: str, start: Callable[[], object], step: Callable, keep: Sequence[str] | None = None, code: str = CODE, seq: str = SEQ) -> DataFrame:
    """``df`` with the columns ``outputs`` (a DDL string) of a fold over each code's rows by seq.

    ``step(state, *inputs)`` gives the next state and the row's outputs (a tuple). Rows
    are dealt by code and stream through sorted, so a code never has to fit in
    memory; codes run in parallel, one code's rows can't."""
    keep = list(df.columns if keep is None else keep)
    extra = T._parse_datatype_string(outputs)
    needed = list(dict.fromkeys([code, seq, *keep, *inputs]))
    rows = df.select(*needed).repartition(code).sortWithinPartitions(code, seq)
    schema = T.StructType([*(rows.schema[c] for c in keep), *extra.fields])
    arrow = [{"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in extra]

    def run(batches):
        now, state = object(), None
        for batch in batches:
            codes, columns, made = batch.column(code).to_pylist(), [batch.column(c).to_pylist() for c in inputs], []
            for key, *values in zip(codes, *columns):
                if key != now:
                    now, state = key, start()
                state, out = step(state, *values)
                made.append(out)
            new = [pa.array([m[k] for m in made], type=t) for k, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=schema.names)

    return rows.mapInArrow(run, schema)
