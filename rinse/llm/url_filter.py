"""URL rules looked up in sorted arrays of 64-bit digests that are mapped into memory.

A rule is a host and a beginning of a path. Its key, host followed by path, is hashed; digests are
sorted and stored in files next to the keys themselves. For a URL, every host suffix and every
beginning of its path as long as a rule's path is a possible key. Their digests are looked up by
vectorised binary search, and the stored key must equal the probed one, so two keys with one
digest do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinse.llm.memory import giving_back
from rinse.llm.shared_files import local_path, written

ALLOW, BLOCK = "allow", "block"
RULES_PER_FILE = 4_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """The host, A-Z in lower case; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """The path without query and fragment; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


def write_rules(rules: DataFrame, folder: str) -> DataFrame:
    """Store rules (host, path, verdict) as sorted digest arrays in ``folder``; lists the files.

    Rules without host, path or verdict are left out. Equal rules count once; of ``block`` and
    ``allow`` for one host and path, ``block`` holds. Each file has the rules of one range of
    digests: digests, places of the keys, verdicts, then the keys.
    """
    host = F.translate("host", _UPPER, _LOWER)
    whole = rules.select(host.alias("host"), "path", "verdict").dropna()
    blocks = F.max((F.col("verdict") == BLOCK).cast("int")).alias("blocks")
    whole = whole.groupBy("host", "path").agg(blocks)

    @giving_back
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, verdicts = (column.to_pylist() for column in batch.columns)
            keys = [host + path for host, path in zip(hosts, paths, strict=True)]
            # signed, so that Spark orders them; the files keep this order
            digests = np.array([digest(key) for key in keys], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests), pa.array(keys, pa.string()), pa.array(map(len, paths), pa.int32()),
                 pa.array(map(len, hosts), pa.int32()), pa.array(verdicts, pa.int32())],
                names=["digest", "key", "length", "host", "blocks"],
            )

    @giving_back
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=_RULES)
        if not table.num_rows:
            return
        name = f"rules-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.digests"
        keys = [key.encode("utf-8", "surrogatepass") for key in table["key"].to_pylist()]
        ends = np.cumsum([0, *map(len, keys)]).astype("<i8")
        with written(f"{folder}/{name}") as out:
            out.write(table["digest"].to_numpy().astype("<i8").tobytes())
            out.write(ends.tobytes())
            out.write(table["blocks"].to_numpy().astype(np.uint8).tobytes())
            out.write(b"".join(keys))
        lengths, hosts = (sorted(set(table[column].to_pylist())) for column in ("length", "host"))
        yield pa.RecordBatch.from_pylist(
            [{"name": name, "rules": table.num_rows, "lengths": lengths, "hosts": hosts}], schema=_FILES
        )

    listed = whole.mapInArrow(hashed, "digest long, key string, length int, host int, blocks int")
    files = -(-rules.count() // RULES_PER_FILE) or 1
    listed = listed.repartitionByRange(files, "digest").sortWithinPartitions("digest", "key")
    listed.mapInArrow(write, "name string, rules long, lengths array<int>, hosts array<int>").write.parquet(f"{folder}/manifest")
    return rules.sparkSession.read.parquet(f"{folder}/manifest")


_RULES = pa.schema(
    [("digest", pa.int64()), ("key", pa.string()), ("length", pa.int32()), ("host", pa.int32())]
    + [("blocks", pa.int32())]
)
_FILES = pa.schema([("name", pa.string()), ("rules", pa.int64())] + [(name, pa.list_(pa.int32())) for name in ("lengths", "hosts")])


class DigestArray:
    """One file of rules, mapped into memory."""

    def __init__(self, path: str, rules: int) -> None:
        raw = np.memmap(path, np.uint8, "r")
        self._digests = raw[: 8 * rules].view("<i8")
        self._ends = raw[8 * rules : 16 * rules + 8].view("<i8")
        self._blocks = raw[16 * rules + 8 : 17 * rules + 8]
        self._keys = raw[17 * rules + 8 :]

    def probe(self, keys: list[str], digests: np.ndarray) -> Iterator[tuple[int, bool]]:
        """Place in ``keys`` of each stored one, and whether it blocks."""
        found = np.searchsorted(self._digests, digests)
        inside = np.flatnonzero(found < len(self._digests))
        for at in inside[self._digests[found[inside]] == digests[inside]]:
            key = keys[at].encode("utf-8", "surrogatepass")
            place = int(found[at])
            while place < len(self._digests) and self._digests[place] == digests[at]:
                if self._keys[self._ends[place] : self._ends[place + 1]].tobytes() == key:
                    yield int(at), bool(self._blocks[place])
                    break
                place += 1


def suffixes(host: str, lengths: list[int]) -> Iterator[str]:
    """The host itself and the domains above it, as far as some rule's host has their length."""
    for length in lengths:
        if length == len(host) or length < len(host) and host[len(host) - length - 1] == ".":
            yield host[len(host) - length :]


def judge(urls: DataFrame, folder: str, url: str = "url", default: str = ALLOW) -> DataFrame:
    """Every row with host, path, rule and verdict; columns with these names are replaced.

    ``rule`` is the longest rule (host and path) that fits: its host is the URL's or a domain
    above, and the URL's path starts with its path. Without one it is null and ``verdict`` is
    ``default``, also for null URLs and URLs without ``://``. Files of rules are mapped from the
    shared folder where executors see it as a path, and copied to them by Spark otherwise.
    """
    spark = urls.sparkSession
    # one row for each file of millions of rules
    files = spark.read.parquet(f"{folder}/manifest").collect()
    lengths, above = (sorted({length for file in files for length in file[kind]}) for kind in ("lengths", "hosts"))
    shared = local_path(folder)
    if shared is None:
        for file in files:
            spark.sparkContext.addFile(f"{folder}/{file['name']}")
    named = [(f"{shared}/{file['name']}" if shared else file["name"], file["rules"]) for file in files]
    kept = [name for name in urls.columns if name not in ("host", "path", "rule", "verdict")]
    parts = urls.select(*(F.col(f"`{name}`") for name in kept), host_of(F.col(url)).alias("host"),
                        path_of(F.col(url)).alias("path"))

    @giving_back
    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = [(path if shared else SparkFiles.get(path), rules) for path, rules in named]
        arrays = [DigestArray(path, rules) for path, rules in paths]
        for batch in batches:
            keys: dict[str, list[int]] = {}
            hosts, ways = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            for row, (host, way) in enumerate(zip(hosts, ways, strict=True)):
                if not host:
                    continue
                beginnings = [way[:length] for length in lengths if length <= len(way)]
                for suffix in suffixes(host, above):
                    for beginning in beginnings:
                        keys.setdefault(suffix + beginning, []).append(row)
            probed = list(keys)
            digests = np.fromiter(map(digest, probed), np.uint64, len(probed)).view(np.int64)
            rule: list[str | None] = [None] * batch.num_rows
            verdict = [default] * batch.num_rows
            for array in arrays:
                for at, blocks in array.probe(probed, digests):
                    for row in keys[probed[at]]:
                        if rule[row] is None or len(probed[at]) > len(rule[row]):
                            rule[row], verdict[row] = probed[at], BLOCK if blocks else ALLOW
            columns = [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "rule", "verdict"])

    schema = parts.select("*", F.lit("").alias("rule"), F.lit("").alias("verdict")).schema
    for field in schema:
        field.nullable = True
    return parts.mapInArrow(verdicts, schema)
