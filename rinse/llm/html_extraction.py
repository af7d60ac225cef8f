"""The main text of web pages by a tree-structured graphical model.

Every node of a page's tree is content, other, or both (``mixed``, an element around content and
other parts). A potential of each node says what its tag, names and text speak for, a potential
of each pair of parent and child which labels go together. Messages pass from the leaves to the
page and back (sum-product), which gives the exact probability of every label of every node; runs
of text that are content with more than one half are the main text. Weights are fitted by the
likelihood of labelled pages, whose gradient needs the same probabilities.

All trees of a batch are one forest, and messages of all nodes of one depth are passed at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinse.llm.dom import Tree, parse
from rinse.llm.labelled_pages import labelled_pages
from rinse.llm.memory import giving_back

OTHER, MIXED, CONTENT = range(3)
TEXT, PLAIN, APART = range(3)  # kinds of pairs: with a text, an element that only arranges, another one
SECTIONS = frozenset("article aside dialog fieldset footer form header main nav section".split())
LABELS = {"other": OTHER, "mixed": MIXED, "content": CONTENT}
PAGES, STEPS, RATE, DECAY = 400, 100, 0.1, 3e-5  # labelled pages, steps of the fit
LEAST = 5  # labelled pages that have a feature, or it is not learned
WORDS = 12  # runs of more words are not judged by single words
_SLICE = 2 << 20  # bytes of pages turned into trees at once
_WORD = re.compile(r"[^\W\d_]+|©")


def _band(number: int) -> int:
    """0, 1, 2-3, 4-7 and so on up to 31 share a band each, all larger numbers one more."""
    return min(number, 32).bit_length()


def element_features(tag: str, names: tuple[str, ...], above: str) -> list[str]:
    found = {"any", f"tag {tag}", f"tag {tag} in {above}"}
    for name in names:
        found |= {f"name {name}", f"start {name[:4]}"}
    if names:
        found.add(f"named {tag}")
    return sorted(found)


def text_features(text: str, linked: int, above: str) -> list[str]:
    words = text.count(" ") + 1
    found = ["any", "text", f"text in {above}", f"words {_band(words)}", f"linked {round(4 * linked / len(text))}"]
    if words <= WORDS:
        found += sorted(f"word {word}" for word in set(_WORD.findall(text.lower())))
    return found


@dataclass
class Forest:
    """Trees one after another: parents (-1 for tops), features, order by depth."""

    parents: np.ndarray
    kinds: np.ndarray  # of the pair with the parent
    features: np.ndarray
    starts: np.ndarray  # of each node's features
    levels: list[np.ndarray]  # nodes of each depth


def forest(trees: list[Tree], known: dict[str, int]) -> Forest:
    """The trees as arrays; features that are not ``known`` are left out, "any" is the first and always there."""
    elements: dict[tuple, list[int]] = {}
    parents, kinds, features, counts = [], [], [], []
    base = 0
    for tree in trees:
        tags = tree.tags
        for at, (parent, tag) in enumerate(zip(tree.parents, tags, strict=True)):
            above = tags[parent] if parent >= 0 else ""
            if tag:
                key = (tag, tree.names[at], above)
                if key not in elements:
                    elements[key] = [known[one] for one in element_features(*key) if one in known]
                found = elements[key]
            else:
                found = [known[one] for one in text_features(tree.texts[at], tree.linked[at], above) if one in known]
            parents.append(parent + base if parent >= 0 else -1)
            kinds.append(TEXT if not tag else APART if tree.names[at] or tag in SECTIONS else PLAIN)
            features.extend(found)
            counts.append(len(found))
        base += len(tags)
    above = np.array(parents, np.int64)
    depth = np.zeros(base, np.int64)
    jump, far = above.copy(), (above >= 0).astype(np.int64)  # doubling: where a node's ancestor is, how far
    while (jump >= 0).any():
        up = np.maximum(jump, 0)
        far = far + np.where(jump >= 0, far[up], 0)
        jump = np.where(jump >= 0, jump[up], -1)
    depth = far
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if base else []
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
    return Forest(above, np.array(kinds, np.int64), np.array(features, np.int64), starts, levels)


@dataclass
class Model:
    """Weights of known features for each label, and of pairs of labels: kind x parent's x child's."""

    known: dict[str, int]
    nodes: np.ndarray
    pairs: np.ndarray


def _sum_exp(values: np.ndarray, axis: int) -> np.ndarray:
    most = values.max(axis=axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(values - most).sum(axis=axis))


def potentials(trees: Forest, model: Model) -> np.ndarray:
    """What each node's features speak for (node x label)."""
    return np.add.reduceat(model.nodes[trees.features], trees.starts, axis=0).astype(np.float64)


def beliefs(trees: Forest, own: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logarithms of sums over all labellings of a tree with a node's label (node x label) or with
    a parent's and child's labels (node x parent's x own), up to the sum of all, which comes third."""
    pair = model.pairs[trees.kinds].astype(np.float64)
    up = np.zeros_like(own)  # from a node to its parent
    below = own.copy()  # a node with all that lies below it
    for nodes in reversed(trees.levels[1:]):
        up[nodes] = _sum_exp(below[nodes][:, None, :] + pair[nodes], 2)
        np.add.at(below, trees.parents[nodes], up[nodes])
    whole = below.copy()
    joint = np.zeros((len(own), 3, 3))
    for nodes in trees.levels[1:]:
        rest = whole[trees.parents[nodes]] - up[nodes]  # the parent without this child
        joint[nodes] = rest[:, :, None] + pair[nodes] + below[nodes][:, None, :]
        whole[nodes] = below[nodes] + _sum_exp(rest[:, :, None] + pair[nodes], 1)
    return whole, joint, _sum_exp(whole, 1)


def marginals(trees: Forest, model: Model) -> np.ndarray:
    """The probability of each label of each node."""
    whole, _, total = beliefs(trees, potentials(trees, model), model)
    return np.exp(whole - total[:, None])


def label_of(tree: Tree) -> np.ndarray:
    """Labels of a labelled tree: an element's own or its parent's, and of a text its parent's; what lies
    under mixed elements without a label of its own is other."""
    labels = np.full(len(tree.tags), MIXED)
    for at in range(1, len(tree.tags)):
        own = tree.labels[at]
        above = labels[tree.parents[at]]
        labels[at] = LABELS[own] if own else OTHER if above == MIXED else above
    return labels


def gradient(trees: Forest, labels: np.ndarray, model: Model) -> tuple[float, Model]:
    """The logarithm of the probability of the labels, and its derivatives."""
    own = potentials(trees, model)
    whole, joint, total = beliefs(trees, own, model)
    inner = np.flatnonzero(trees.parents >= 0)
    kind = trees.kinds[inner]
    above = labels[trees.parents[inner]]
    score = own[np.arange(len(labels)), labels].sum() + model.pairs[kind, above, labels[inner]].sum()
    value = score - total[trees.parents < 0].sum()
    given = np.eye(3)[labels] - np.exp(whole - total[:, None])
    counts = np.diff(np.append(trees.starts, len(trees.features)))
    each = np.repeat(np.arange(len(labels)), counts)
    nodes = np.stack([np.bincount(trees.features, given[each, label], len(model.known)) for label in range(3)], axis=1)
    pairs = np.zeros_like(model.pairs)
    np.add.at(pairs, (kind, above, labels[inner]), 1.0)
    expected = np.exp(joint[inner] - total[inner][:, None, None])
    np.subtract.at(pairs, kind, expected)
    return float(value), Model(model.known, nodes, pairs)


def known_features(trees: list[Tree], least: int) -> dict[str, int]:
    """Numbers for the features that at least so many of the pages have."""
    pages: Counter[str] = Counter()
    for tree in trees:
        found = set()
        for at, tag in enumerate(tree.tags):
            above = tree.tags[tree.parents[at]] if at else ""
            found.update(element_features(tag, tree.names[at], above) if tag else text_features(tree.texts[at], tree.linked[at], above))
        pages.update(found - {"any"})
    return {"any": 0} | {name: at for at, name in enumerate(sorted(n for n, k in pages.items() if k >= least), 1)}


def train(pages: list[str], steps: int = STEPS, least: int = LEAST) -> Model:
    """Fit a model to labelled pages by gradient steps of adapted length (Adam) with a quadratic penalty."""
    parsed = [parse(page) for page in pages]
    known = known_features(parsed, least)
    trees, labels = forest(parsed, known), np.concatenate([label_of(tree) for tree in parsed])
    size = 3 * len(known)
    weights = np.zeros(size + 27)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)

    def model() -> Model:
        return Model(known, weights[:size].reshape(-1, 3), weights[size:].reshape(3, 3, 3))

    for step in range(1, steps + 1):
        _, found = gradient(trees, labels, model())
        slope = np.concatenate([found.nodes.ravel(), found.pairs.ravel()]) / len(labels) - DECAY * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights = weights + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return model()


@lru_cache(maxsize=1)
def default_model() -> Model:
    """The model of ``labelled_pages``, the same wherever and whenever it is fitted."""
    return train(labelled_pages(PAGES))


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page; '' if no run of its text is content."""
    trees = [parse(page or "") for page in pages]
    shares = marginals(forest(trees, model.known), model)[:, CONTENT] if trees else []
    texts, base = [], 0
    for tree in trees:
        kept = np.flatnonzero(shares[base : base + len(tree.tags)] > 0.5)
        texts.append(" ".join(tree.texts[at] for at in kept if tree.texts[at]))
        base += len(tree.tags)
    return texts


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """The main text of every page: page_id, url, text and n_chars, its code points.

    ``pages`` has page_id, url and html (null counts as empty); other columns are not read. Character references
    are decoded, white space inside a block becomes one space, blocks are joined by one space in
    page order. Pages without main text give ''; every row gives one row, also if they repeat.
    Without a model the one of ``labelled_pages`` is fitted, which takes the driver a few seconds.
    """
    fitted = model or default_model()

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("html")), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _SLICE)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                piece = batch.slice(start, stop - start)
                texts = main_texts(piece.column("html").to_pylist(), fitted)
                lengths = pa.array([len(text) for text in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), lengths],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
