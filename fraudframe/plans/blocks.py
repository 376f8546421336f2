"""Blocks of rows as arrays that stay with their executors over many passes."""

from __future__ import annotations

import numpy as np
from pyspark import RDD

#: Bytes of sums that the tasks of a pass may send to the driver as they are.
DIRECT = 4 << 20


def added_up(sums: RDD, size: int):
    """The sum of the tasks' arrays of ``size`` numbers; many or long ones go through a round of tasks first."""
    depth = 1 if sums.getNumPartitions() * size * 8 <= DIRECT else 2
    return sums.treeAggregate(0.0, np.add, np.add, depth)
