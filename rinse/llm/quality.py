"""A factorisation machine that scores the quality of documents.

Features are hashed words, a few figures on the structure of the text, and metadata. Their pairwise
interactions are products of short vectors, and by the identity
``sum of pairs = (square of sum - sum of squares) / 2`` a text is scored in one pass over them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinse.llm.memory import giving_back
from rinse.llm.names import free_names
from rinse.llm.tokens import pieces_of

BUCKETS = 1 << 14
FIGURES = 10
FACTORS = 8
SAMPLE = 4000
EPOCHS, STEPS = 12, 400  # at least so many of each
THRESHOLD = 0.3
_SLICE = 1 << 19  # bytes of text turned into features at once
_KINDS = ("upper", "digit", "exclaim", "line", "beyond", "sign")


def _kinds() -> np.ndarray:
    """For each byte a bit for each kind it is of."""
    table = np.zeros(256, np.uint8)
    members = {
        "upper": range(65, 91), "digit": range(48, 58), "exclaim": [33], "line": [10], "beyond": range(128, 256),
        "sign": [b for b in range(33, 127) if not chr(b).isalnum() and b != 33],
    }
    for bit, kind in enumerate(_KINDS):
        table[list(members[kind])] |= 1 << bit
    return table


class Features:
    """Features of a batch of texts; words are hashed once while they are remembered."""

    def __init__(self, memory: int = 300_000) -> None:
        self._memory, self._known, self._kinds = memory, {}, _kinds()

    def _buckets(self, words: list[str]) -> np.ndarray:
        if len(self._known) > self._memory:
            self._known.clear()
        known = self._known
        for word in words:
            if word not in known:
                known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return np.fromiter((known[word] for word in words), np.int64, len(words))

    def __call__(self, texts: pa.Array, metadata: Sequence[tuple[str, pa.Array]] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, bucket and value of each hashed word, and a matrix of figures on the structure.

        The values of a text have length 1. Null counts as empty: no words, figures of nothing.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        words = pc.ascii_split_whitespace(texts)
        flat = words.flatten().dictionary_encode()
        buckets = self._buckets(flat.dictionary.to_pylist())
        codes = flat.indices.to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = np.repeat(np.arange(n), sizes) * BUCKETS + buckets[codes]
        pairs, counts = np.unique(pairs, return_counts=True)
        rows, columns = pairs // BUCKETS, pairs % BUCKETS
        values = np.log1p(counts)
        norms = np.sqrt(np.bincount(rows, values * values, n))
        values /= norms[rows]

        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        kinds = self._kinds[data[cuts[0] : cuts[-1]]]
        cuts = cuts - cuts[0]
        length = np.maximum(np.diff(cuts), 1)
        shares = []
        for bit in range(len(_KINDS)):
            sums = np.concatenate([[0], np.cumsum(kinds >> bit & 1, dtype=np.int32)])
            shares.append((sums[cuts[1:]] - sums[cuts[:-1]]) / length)
        lines = pc.split_pattern(texts, "\n")
        of_line = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        many = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = np.unique(np.repeat(np.arange(n), many) * (len(of_line) + 1) + of_line) // (len(of_line) + 1)
        figures = np.column_stack([
            *shares,
            np.log1p(np.diff(cuts)),
            np.diff(cuts) / np.maximum(sizes, 1) / 10,
            np.bincount(rows, minlength=n) / np.maximum(sizes, 1),
            np.bincount(distinct, minlength=n) / np.maximum(many, 1),
        ])
        for name, column in metadata:
            if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
                numbers = np.nan_to_num(pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False))
                figures = np.column_stack([figures, np.sign(numbers) * np.log1p(np.abs(numbers))])
            else:
                known = column.cast(pa.string()).dictionary_encode("encode")
                buckets = self._buckets([f"{name}={value}" for value in known.dictionary.to_pylist()])
                rows, columns = np.concatenate([rows, np.arange(n)]), np.concatenate([columns, buckets[known.indices.to_numpy(zero_copy_only=False)]])
                values = np.concatenate([values, np.ones(n)])
        return rows, columns, values, figures


@dataclass
class Model:
    """Weights of a machine whose last features are the figures, centred and scaled."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def design(self, rows, columns, values, figures):
        """All features as (row, column, value), by row."""
        n = len(figures)
        scaled = np.clip((figures - self.centre) / self.scale, -4, 4) / 4
        many = figures.shape[1]
        rows = np.concatenate([rows, np.repeat(np.arange(n), many)])
        columns = np.concatenate([columns, BUCKETS + np.tile(np.arange(many), n)])
        values = np.concatenate([values, scaled.ravel()])
        return rows, columns, values

    def sums(self, rows, columns, values, n):
        """Of each text the sum of its vectors, and its score before the logistic function."""
        linear = np.bincount(rows, self.weights[columns] * values, n)
        total = np.empty((n, FACTORS))
        squares = np.zeros(n)
        for factor in range(FACTORS):
            part = self.factors[columns, factor] * values
            total[:, factor] = np.bincount(rows, part, n)
            squares += np.bincount(rows, part * part, n)
        return total, self.bias + linear + ((total * total).sum(axis=1) - squares) / 2

    def score(self, features) -> np.ndarray:
        rows, columns, values = self.design(*features)
        _, raw = self.sums(rows, columns, values, len(features[3]))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(features, labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, batch: int = 128) -> Model:
    """Fit a machine to labels of 0 and 1 by adaptive gradient steps on the weighted log loss."""
    rows, columns, values, figures = features
    n, many = len(labels), figures.shape[1]
    size = BUCKETS + many
    random = np.random.default_rng(7)
    model = Model(0.0, np.zeros(size), random.normal(0, 0.05, (size, FACTORS)),
                  figures.mean(axis=0) if n else np.zeros(many),
                  (figures.std(axis=0) if n else np.zeros(many)) + 1e-6)
    rows, columns, values = model.design(rows, columns, values, figures)
    order = np.argsort(rows, kind="stable")
    columns, values = columns[order], values[order]
    stops = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    past = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3)
    past_bias, rate, decay = 1e-3, 0.1, 1e-4
    for _ in range(max(epochs, -(-STEPS * batch // n)) if n else 0):
        shuffled = random.permutation(n)
        for start in range(0, n, batch):
            chosen = shuffled[start : start + batch]
            counts = stops[chosen + 1] - stops[chosen]
            at = np.repeat(stops[chosen] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            row, column, value = np.repeat(np.arange(len(chosen)), counts), columns[at], values[at]
            total, raw = model.sums(row, column, value, len(chosen))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) * weights[chosen] / len(chosen)
            used, place = np.unique(column, return_inverse=True)
            step = np.bincount(place, error[row] * value, len(used)) + decay * model.weights[used]
            past[0][used] += step * step
            model.weights[used] -= rate * step / np.sqrt(past[0][used])
            for factor in range(FACTORS):
                own = model.factors[column, factor]
                slope = error[row] * value * (total[row, factor] - own * value)
                step = np.bincount(place, slope, len(used)) + decay * model.factors[used, factor]
                past[1][used, factor] += step * step
                model.factors[used, factor] -= rate * step / np.sqrt(past[1][used, factor])
            past_bias += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(past_bias)
    return model


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by the checksum of their ids; rows without id are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _inputs(metadata: Sequence[str]) -> Column:
    """What the machine sees of a row."""
    columns = [F.col(f"`{name}`").alias(f"m{at}") for at, name in enumerate(metadata)]
    return F.struct(F.col("text").cast("string").alias("text"), *columns)


def _parts(rows: pa.StructArray, features: Features, metadata: Sequence[str]) -> Iterator:
    """Features of the rows, in slices that bound memory."""
    batch = pa.RecordBatch.from_struct_array(rows)
    for part in pieces_of(batch, _SLICE):
        yield features(part.column("text"), [(name, part.column(f"m{at}")) for at, name in enumerate(metadata)])


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, metadata: Sequence[str] = ()
) -> Model:
    """Fit a machine on at most ``sample`` labelled documents that are not held out.

    Half of the sample, by the hash of doc_id, is taken from each class, and losses are weighted
    so that the classes count as in all labels. Of several labels for a document the smallest
    holds. Rows without doc_id or label do not train; without labels all scores are 0.5. The
    features of the sample come to the driver. ``metadata`` names columns of ``docs`` that the
    machine sees besides the text: numbers as figures (null as 0), others by their value.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    counts = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    parts = [
        known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        for value in (0, 1)
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # ``sample`` rows at most
    texts = docs.select("doc_id", _inputs(metadata).alias("inputs")).join(chosen, "doc_id")

    @giving_back
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            at = 0
            for rows, columns, values, figures in _parts(batch.column("inputs"), features, metadata):
                part, at = batch.slice(at, len(figures)), at + len(figures)
                order = np.argsort(rows, kind="stable")
                columns, values = columns[order], values[order]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(figures)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.string()), part.column("label"),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(columns.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(values.astype(np.float32))),
                     pa.array(list(figures), pa.list_(pa.float64()))],
                    names=["doc_id", "label", "columns", "values", "figures"],
                )

    schema = "doc_id string, label int, columns array<int>, values array<float>, figures array<double>"
    found = texts.mapInArrow(gather, schema).toArrow().sort_by("doc_id").combine_chunks()
    sizes = pc.list_value_length(found["columns"]).to_numpy()
    figures = np.array(found["figures"].to_pylist()) if len(found) else np.zeros((0, FIGURES))
    truth = found["label"].to_numpy().astype(np.float64)
    flat = [pc.list_flatten(found[name]).to_numpy().astype(kind)
            for name, kind in (("columns", np.int64), ("values", np.float64))]
    features = np.repeat(np.arange(len(sizes)), sizes), *flat, figures
    taken = np.bincount(truth.astype(int), minlength=2)
    shares = np.array([counts.get(value, 0) / max(taken[value], 1) for value in (0, 1)])
    weights = shares[truth.astype(int)]
    return fit(features, truth, weights / weights.mean() if len(weights) else weights)


def score(docs: DataFrame, model: Model, column: str = "score", metadata: Sequence[str] = ()) -> DataFrame:
    """``docs`` (with text) and a column with the score of each whole row, 0 to 1.

    ``metadata`` as in ``train``. Null and empty texts are scored by what is left. A column with
    that name is replaced. Only what the machine sees goes to Python, and only scores come back.
    """

    @F.arrow_udf("double")
    @giving_back
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features()
        for rows in batches:
            found = [pa.array(model.score(part), pa.float64()) for part in _parts(rows, features, metadata)]
            yield pa.concat_arrays(found) if found else pa.array([], pa.float64())

    return docs.withColumn(column, scored(_inputs(metadata)))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, metadata: Sequence[str] = ()) -> DataFrame:
    """``docs`` with all their columns, without the rows that score below ``threshold``."""
    (name,) = free_names(docs, "score")
    return score(docs, model, name, metadata).where(F.col(name) >= threshold).drop(name)
