"""Table functions for SQL: an image in, many rows out. Rows go through Arrow; Spark joins no functions of whole Arrow tables laterally.

After `register(spark)`: `SELECT p.path, o.* FROM planes p, LATERAL plane_objects(p.h, p.w, p.data) o`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .tiles import label_array

OBJECTS = "label int, value double, size long, y0 int, x0 int, y1 int, x1 int, centre_y double, centre_x double"


@udtf(returnType=OBJECTS, useArrow=True)
class PlaneObjects:
    """Connected regions of equal nonzero values of a plane: number in scan order, value, size, box (ends excluded) and centre. Null planes have none."""

    def eval(self, h: int | None, w: int | None, data: Sequence[float] | None) -> Iterator[tuple]:
        if h is None or w is None or data is None or not h * w:
            return
        plane = np.asarray(data, np.float64).reshape(int(h), int(w))
        labels = label_array(plane)
        y, x = np.nonzero(labels)
        at = labels[y, x]
        n = int(at.max(initial=0))
        size = np.bincount(at, minlength=n + 1)[1:]
        low, high = np.full((2, n + 1), max(plane.shape)), np.zeros((2, n + 1), np.int64)
        for axis, c in enumerate((y, x)):
            np.minimum.at(low[axis], at, c)
            np.maximum.at(high[axis], at, c + 1)
        centre = [np.bincount(at, c, n + 1)[1:] / size for c in (y, x)]
        value = np.zeros(n + 1)
        value[at] = plane[y, x]
        columns = [np.arange(1, n + 1), value[1:], size, low[0, 1:], low[1, 1:], high[0, 1:], high[1, 1:], *centre]
        yield from zip(*[c.tolist() for c in columns], strict=True)


def register(spark: SparkSession) -> None:
    """Makes the table functions known to a session's SQL."""
    spark.udtf.register("plane_objects", PlaneObjects)
