"""Problem 8: token ids of a public byte-level BPE vocabulary.

Backtracking encoder. An Aho-Corasick pass over the bytes of a pre-token gives the longest token that starts at each
byte. The encoder takes these tokens from left to right; a token may follow the last one only if the pair is compatible,
i.e. if merging both strings together would not have merged across their border earlier. If not, it tries the next
shorter token that is a prefix, and steps back where there is none. Each byte is given up at most once, so the work is
linear, and the result is that of the merges in order of rank.

Defined results: null and empty text give an empty list; text is taken as it is (no normalisation, no special tokens).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that parts text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Encoded pre-tokens kept by a worker; it only bounds memory.
KEEP = 400_000


class Codec:
    """Encoder and decoder of one rank file, in which ids are ranks."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.lengths = {i: len(t) for t, i in ranks.items()}
        self.findall = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}
        trie = ahocorasick.Automaton()
        for token, i in ranks.items():
            trie.add_word(token.decode("latin-1"), (len(token), i))
        trie.make_automaton()
        self.trie = trie
        self.split: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.shorter[i] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
            self.split[i] = (i, i)
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k], i), ranks.get(token[k:], i)
                if a < i and b < i and self.compatible(a, b):
                    self.split[i] = (a, b)
                    self.pairs[a, b] = i
                    break
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, i in ranks.items():
            by_id[i] = token
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in by_id]))).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge over the border comes before those inside: looks at the parts that touch it, latest merge first."""
        pairs, split, below = self.pairs, self.split, 1 << 62
        while True:
            if pairs.get((left, right), below) < below:
                return False
            # undo the later of the two merges; of equal tokens the right one was made later
            inner_left, inner_right = split[left][1], split[right][0]
            undo_left = inner_left != left and (left > right or inner_right == right)
            if undo_left:
                below, left = left, inner_left
            elif inner_right != right:
                below, right = right + 1, inner_right
            else:
                return True

    def word(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        longest, width = [-1] * n, [0] * n
        for end, (k, i) in self.trie.iter(raw.decode("latin-1")):
            if k > width[end - k + 1]:
                width[end - k + 1], longest[end - k + 1] = k, i
        lengths, shorter, compatible = self.lengths, self.shorter, self.compatible
        open_, out, at, token = [True] * (n + 1), [], 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0 and not (open_[at + lengths[token]] and (last < 0 or compatible(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lengths[token]
                if at == n:
                    return out
                token = longest[at]
            else:
                open_[at] = False
                token = out.pop()
                at -= lengths[token]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        kept, out = self.kept, []
        for piece in self.findall(text):
            ids = kept.get(piece)
            if ids is None:
                if len(kept) >= KEEP:
                    kept.clear()
                kept[piece] = ids = self.word(piece)
            out += ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered in one step by the offset table."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        start, n = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(start - (ends - n), n) + np.arange(ends[-1])].tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def vocabulary(name: str = VOCABULARY, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)


def with_ids(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>) of each row; other columns aren't read. Repeated keys stay repeated rows."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            values, ends = [], [0]
            for t in b.column(1).to_pylist():
                values += c.encode(t)
                ends.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(values, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def with_counts(df: DataFrame, text: str = "text", name: str = "n_tokens", path: str | None = None) -> DataFrame:
    """df with the number of tokens of its text; the text itself is dropped before the rows go back to the JVM."""
    path = path or vocabulary()
    rest = [c for c in df.columns if c not in (text, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n = pa.array([len(c.encode(t)) for t in b.column(len(rest)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], n], [*rest, name])

    df = df.select(*[F.col(f"`{c}`") for c in rest], text)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.mapInArrow(run, f"{schema}, `{name}` bigint")


def decoded(df: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text) of token ids; bytes that aren't UTF-8 come out as the replacement character."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            text = [None if x is None else c.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], [key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
