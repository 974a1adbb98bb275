"""Vector distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this dimension the distance is one generated expression.
UNROLLED = 96


def l2_distance(vector: Column, query: Sequence[float]) -> Column:
    """Euclidean distance in double precision to a fixed vector; null if the lengths differ.

    Spark evaluates ``zip_with`` and ``aggregate`` outside generated code, so small
    dimensions are written out term by term, and large ones go to NumPy by Arrow.
    """
    q = [float(np.float32(x)) for x in query]
    if len(q) <= UNROLLED:
        total = F.lit(0.0)
        for i, x in enumerate(q):
            gap = F.get(vector, F.lit(i)).cast("double") - F.lit(x)
            total = total + gap * gap
        return F.when(F.size(vector) == len(q), F.sqrt(total))
    target = np.asarray(q)

    @F.arrow_udf("double")
    def far(vectors: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), len(target)), False)
        held = vectors.filter(fits).flatten()  # one flat array of numbers; null ones become NaN
        points = held.to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(target))
        out = np.full(len(vectors), np.nan)
        out[fits.to_numpy(zero_copy_only=False)] = np.sqrt(((points - target) ** 2).sum(axis=1))
        return pa.array(out, mask=np.isnan(out))

    return far(vector)


def l2_between(a: Column, b: Column) -> Column:
    """The same between two columns."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))
