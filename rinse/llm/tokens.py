"""Token ids of a column of texts by a tokenizer file of the ``tokenizers`` library."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_OF_SEQUENCE = 1
END_OF_DOCUMENT = 2

# The rules of the tokenizer file that make words independent of each other
_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "behavior": "Removed", "invert": True,
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"  # all marks of ASCII but the apostrophe
_TOGETHER = 128  # words in one text
_AT_ONCE = 64  # texts in one call


def word_tokenizer() -> str:
    """The tokenizer file used where the caller names none."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes whole texts, each distinct word once.

    The pieces that a tokenizer of the known rules (``_RULES``) splits a text into never contain
    white space, and its normalization leaves white space where it is. The ids of a text are
    therefore those of its words in turn. A punctuation mark behind a letter starts a piece, so it
    starts a word here as well. Texts of tokenizers with other rules are encoded as a whole. Beyond
    ``memory`` remembered bytes of words and ids the memory starts anew.
    """

    def __init__(self, path: str, memory: int = 8 << 20) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._memory = memory
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self._apart = all(rules.get(name) == rule for name, rule in _RULES.items())
        self._special = [token["content"] for token in rules.get("added_tokens") or []]
        suffix = rules["model"].get("end_of_word_suffix")
        names = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(names.values(), default=-1) + 1, bool)
        if suffix:
            self._ends[[number for name, number in names.items() if name.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._ids = np.empty(0, np.uint32)
        self._starts = np.zeros(1, np.int64)
        self._size = 0

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each of the words, one after another, and how many each has."""
        found: list[list[int]] = []
        for at in range(0, len(words), _AT_ONCE):  # a token takes over a hundred bytes before it is an id
            part = self._tokenizer.encode_batch_fast(words[at : at + _AT_ONCE], add_special_tokens=False)
            found.extend(one.ids for one in part)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _learn(self, words: list[str]) -> None:
        """Words of letters are one piece each, and the last token of a piece says so: many go into one call."""
        plain = [word for word in words if _LETTERS.fullmatch(word)] if self._apart else []
        joined = [" ".join(plain[at : at + _TOGETHER]) for at in range(0, len(plain), _TOGETHER)]
        ids, _ = self._encoded(joined)
        stops = np.flatnonzero(self._ends[ids]) + 1
        if len(stops) == len(plain):
            lengths = np.diff(stops, prepend=0)
            other = [word for word in words if not _LETTERS.fullmatch(word)] if plain else words
        else:
            plain, ids, lengths, other = [], ids[:0], stops[:0], words
        more, counts = self._encoded(other)
        self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(np.concatenate([lengths, counts]))])
        self._ids = np.concatenate([self._ids, ids, more])
        learned = [*plain, *other]
        self._known.update(zip(learned, range(len(self._known), len(self._known) + len(learned)), strict=True))
        self._size += 4 * (len(ids) + len(more)) + sum(map(len, learned))

    def _places(self, words: list[str]) -> np.ndarray:
        """Where in ``_starts`` each of the words is; new ones are encoded."""
        if self._size > self._memory:
            self._forget()
        known = self._known
        if new := [word for word in words if word not in known]:
            self._learn(new)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _words(self, texts: pa.Array) -> pa.Array:
        """The words of each text."""
        if not self._apart:
            return pa.LargeListArray.from_arrays(np.arange(len(texts) + 1), texts)
        parted = pc.replace_substring_regex(texts, _MARK, r"\1 \2")
        for special in self._special:  # whose marks are no pieces
            parted = pc.if_else(pc.match_substring(texts, special), texts, parted)
        return pc.ascii_split_whitespace(parted)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids start (one more entry: the end).

        Nulls count as empty texts; ``end`` is put after each text.
        """
        words = self._words(pc.fill_null(texts.cast(pa.large_string()), ""))
        flat = words.flatten().dictionary_encode()
        places = self._places(flat.dictionary.to_pylist())
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = flat.indices.to_numpy(zero_copy_only=False)
        first, count = self._starts[places], self._starts[places + 1] - self._starts[places]
        known = self._ids
        if end is not None:  # one more word, behind the words of each text
            codes = np.insert(codes, np.cumsum(sizes), len(places))
            first, count = np.append(first, len(known)), np.append(count, 1)
            known = np.append(known, np.uint32(end))
            sizes = sizes + 1
        each = count[codes]
        before = np.concatenate([[0], np.cumsum(each)])
        place = np.int32 if max(before[-1], len(known)) < 1 << 31 else np.int64
        at = np.repeat((first[codes] - before[:-1]).astype(place), each)
        at += np.arange(before[-1], dtype=place)
        ids = known[at]
        return ids, before[np.concatenate([[0], np.cumsum(sizes)])]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which remembers words from one task to the next."""
    return Encoder(path)


def pieces_of(batch: pa.RecordBatch, most: int = 1 << 21):
    """The batch in slices of about ``most`` bytes of text, so that long texts bound memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if stop > start:
            yield batch.slice(start, stop - start)
