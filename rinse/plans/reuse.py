"""Answering requests from specifications that are already known.

Requests and known answers carry the same ``fingerprint`` (see ``functions.text``). Known
answers have one row per fingerprint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse.operators.lookup import BROADCAST_BYTES, lookup

KEY = "fingerprint"


def well_formed(read: DataFrame) -> DataFrame:
    """Stored suggestions after a reader of ``plans.suggestions``, without the malformed ones.

    A stored entry that cannot be read is no answer; its request counts as unknown again.
    """
    return read.where(F.col("status") != "malformed")


def answer_known(
    requests: DataFrame, known: DataFrame, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """All requests with the known answer's columns and ``cached``, whether there was one."""
    return lookup(requests, known.withColumn("__hit", F.lit(True)), KEY, limit).withColumn(
        "cached", F.coalesce(F.col("__hit"), F.lit(False))
    ).drop("__hit")


def still_unknown(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Fingerprints to find an answer for, once each, with the number of requests waiting.

    Requests are counted per fingerprint before they meet the known answers, so one that many
    share is a single row by then.
    """
    asked = requests.groupBy(KEY).agg(F.count(F.lit(1)).alias("requests"))
    return asked.join(known.select(KEY), KEY, "left_anti")
