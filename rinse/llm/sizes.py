"""Which side of a join may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 8 << 20


def is_small(table: DataFrame, most: int = MOST) -> bool:
    """Whether the files of a stored table have at most ``most`` bytes."""
    context = table.sparkSession.sparkContext
    configuration = context._jsc.hadoopConfiguration()
    total = 0
    for name in table.inputFiles():
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(configuration).getFileStatus(path).getLen()
        if total > most:
            return False
    return True


def broadcast_if_small(table: DataFrame, most: int = MOST) -> DataFrame:
    """A stored table, with a broadcast hint if it is small.

    Larger ones come back as they are: the join then shuffles, and AQE splits hot keys.
    """
    return F.broadcast(table) if is_small(table, most) else table
