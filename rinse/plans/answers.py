"""A store of answers: batches are appended under a version, and requests read the latest good ones.

The store is a table in buckets of the fingerprint. Requests are reduced to their distinct
fingerprints and dealt by the same buckets, so a lookup never shuffles the store, however many
versions it holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinse.errors import INVALID_SPEC, RinseError
from rinse.operators.lookup import BROADCAST_BYTES, lookup
from rinse.plans.reuse import KEY
from rinse.session import stored
from rinse.sources.tables import string_schema

VERSION = "version"
BUCKETS = 64


class AnswerStore:
    """Answers in a folder: ``fingerprint``, ``version`` and columns of strings.

    Entries are never changed. Of a fingerprint the entry with the highest version that is fit for
    use holds; of several with one version the greatest. Opening a folder a second time, also
    in another session, gives the same store; the number of buckets must stay the same.
    """

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str], buckets: int = BUCKETS) -> None:
        if {KEY, VERSION} & set(columns):
            raise RinseError(INVALID_SPEC, f"{KEY} and {VERSION} are columns of every store", list(columns))
        self._spark, self._columns, self._buckets = spark, list(columns), buckets
        self._name = f"rinse_answers_{hashlib.md5(path.encode()).hexdigest()}"
        where = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name} (`{KEY}` string, `{VERSION}` bigint, {string_schema(self._columns)}) "
            f"USING parquet CLUSTERED BY (`{KEY}`) SORTED BY (`{KEY}`) INTO {buckets} BUCKETS LOCATION '{where}'"
        )

    def entries(self) -> DataFrame:
        """All entries of all versions."""
        self._spark.catalog.refreshTable(self._name)
        return self._spark.table(self._name)

    def append(self, answers: DataFrame, version: int) -> None:
        """Add a batch of answers (fingerprint and the store's columns); those without fingerprint are left out.

        A batch that is added twice, because a run was repeated, changes no answer.
        """
        rows = answers.where(F.col(KEY).isNotNull()).select(
            KEY, F.lit(version).cast("long").alias(VERSION), *(F.col(f"`{name}`").cast("string").alias(name) for name in self._columns)
        )
        # rows lie with their bucket before they are written, so a batch makes a file for each bucket at most
        rows = rows.repartition(self._buckets, KEY)
        rows.write.insertInto(self._name)

    def latest(self, oldest: int | None = None, fit: Column | None = None) -> DataFrame:
        """The answer of each fingerprint, with its version: the latest that is not older than
        ``oldest`` and for which ``fit`` (a condition on the columns) is true."""
        found = self.entries()
        if oldest is not None:
            found = found.where(F.col(VERSION) >= oldest)
        if fit is not None:
            found = found.where(F.coalesce(fit, F.lit(False)))
        entry = F.struct(VERSION, *(F.col(f"`{name}`") for name in self._columns))
        return found.groupBy(KEY).agg(F.max(entry).alias("entry")).select(KEY, "entry.*")

    def answer(
        self, requests: DataFrame, oldest: int | None = None, fit: Column | None = None, limit: int = BROADCAST_BYTES
    ) -> DataFrame:
        """All requests with the columns of ``latest``, and ``cached``: whether there was an answer.

        The fingerprints asked for meet the store once each; what is found is then handed to the
        requests, dealt out where a fingerprint has very many.
        """
        asked = requests.where(F.col(KEY).isNotNull()).select(KEY).distinct()
        # the side that moves is the distinct fingerprints, into the store's buckets
        found = asked.repartition(self._buckets, KEY).join(self.latest(oldest, fit).hint("merge"), KEY)
        found = stored(found.withColumn("__hit", F.lit(True)), "answers")
        answered = lookup(requests, found, KEY, limit)
        return answered.withColumn("cached", F.coalesce("__hit", F.lit(False))).drop("__hit")

    def unknown(self, requests: DataFrame, oldest: int | None = None, fit: Column | None = None) -> DataFrame:
        """Fingerprints without an answer, once each, with the number of requests that wait for it."""
        asked = requests.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("requests"))
        return asked.repartition(self._buckets, KEY).join(self.latest(oldest, fit).select(KEY).hint("merge"), KEY, "left_anti")
