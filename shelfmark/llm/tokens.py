"""Token counts with a whole-token shortcut.

For a byte-level BPE tokenizer, a text is split into pre-tokens, and the merges of each one do not
depend on its neighbours.  Offline, once per worker, the vocabulary strings are tried one by one:
those that the library encodes as one token when they stand alone are proven, and a pre-token equal
to one of them counts 1 without merging.  Only the rest is merged, by the library itself, and its
counts are remembered up to a bound.

The pre-tokens are found with the pattern of the tokenizer.  Two engines may know different Unicode
versions, so every character above U+024F is first compared on a probe; a text with a character on
which they differ is split by the library.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 20  # characters of a text that are split at a time
REMEMBERED = 1 << 19  # merged pre-tokens in each of the two generations that a worker keeps

_split = regex.compile(PATTERN)
_unproven = regex.compile(r"[^\x00-\u024F]")
# Between a character and a single space before another: no pre-token crosses such a place.
_cut = regex.compile(r"(?<=\S)(?= \S)")


class Counted:
    """Counts tokens as the library does, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this worker one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.whole = self._proven()
        self.merged: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.same: dict[str, bool] = {}

    def _proven(self) -> frozenset[str]:
        """The vocabulary strings that are one pre-token and one token where they stand alone."""
        ids = range(self.tokenizer.get_vocab_size())
        strings = self.tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
        found = []
        for at in range(0, len(strings), 10_000):
            some = strings[at : at + 10_000]
            coded = self.tokenizer.encode_batch(some, add_special_tokens=False)
            found += [
                s
                for i, (s, c) in enumerate(zip(some, coded, strict=True), at)
                if c.ids == [i] and _split.findall(s) == [s]
            ]
        return frozenset(found)

    def _agreed(self, char: str) -> bool:
        probe = f"a{char}1{char}!{char} {char}"
        found = [m.span() for m in _split.finditer(probe)]
        return found == [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]

    def _trusted(self, text: str) -> bool:
        if text.isascii():
            return True
        for char in set(_unproven.findall(text)):
            if char not in self.same:
                self.same[char] = self._agreed(char)
            if not self.same[char]:
                return False
        return True

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE:
            place = _cut.search(text, at + PIECE)
            if not place:
                break
            yield text[at : place.start()]
            at = place.start()
        yield text[at:]

    def _pre_tokens(self, text: str) -> Iterator[list[str]]:
        parts = self.special.split(text) if self.special else [text]
        for part in parts:
            for piece in self._pieces(part):
                if self._trusted(piece):
                    yield _split.findall(piece)
                else:
                    spans = self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)
                    yield [piece[a:b] for _, (a, b) in spans]

    def count(self, text: str | None) -> int:
        """Tokens of ``text``; special strings in it are one token each; null has none."""
        if not text:
            return 0
        total = len(self.special.findall(text)) if self.special else 0
        for found in self._pre_tokens(text):
            rest = [t for t in found if t not in self.whole]
            total += len(found) - len(rest)
            if rest:
                total += self._merge(Counter(rest))
        return total

    def _merge(self, rest: Counter) -> int:
        if len(self.merged) > REMEMBERED:
            self.older, self.merged = self.merged, {}
        new = []
        for t in rest:
            if t not in self.merged:
                if t in self.older:
                    self.merged[t] = self.older[t]
                else:
                    new.append(t)
        if new:
            coded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self.merged.update((t, len(c)) for t, c in zip(new, coded, strict=True))
        return sum(self.merged[t] * n for t, n in rest.items())


@lru_cache(maxsize=2)
def counted(path: str) -> Counted:
    """One per worker and file, kept while the worker lives."""
    return Counted(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs`` and its whole ``text``.

    ``path`` names a tokenizer file that every executor has.  Null and empty texts: no bytes, no
    tokens.  Null ids stay null, repeated rows are counted each, other columns are not read, an empty
    table gives no rows.  Very long texts are split piece by piece.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counted(path)
        for batch in batches:
            numbers = [counter.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(numbers, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return (
        docs.select("doc_id", bytes_, "text")
        .mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
