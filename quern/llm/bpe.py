"""BPE encoding and decoding in batched numpy merge rounds.

Text is cut into chunks at single spaces that the pre-tokenizer would cut at as well. Chunks not yet
in the worker's cache are split by the pre-tokenizer's pattern, and all their words are merged
together: the symbols of all words lie in one flat array, each round looks every adjacent pair up by
binary search over the sorted pair keys, and merges the lowest-ranked pair of each word.

Defined results: null text counts as empty and gives 0 ids; repeated rows each give their row; extra
columns are left out unless asked for by name; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of byte-level BPE: its pre-tokenizer pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed values of byte-level BPE: the byte ranges that stand for themselves; the rest are shifted past 255 in order.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

NONE = np.iinfo(np.int32).max
#: Chunks longer than this are not cached.
LONGEST_CACHED = 48
#: Texts are encoded and given out in runs of about so many characters, so that a worker's memory doesn't follow the size of its batches.
SLICE_CHARS = 250_000


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file → byte."""
    rest = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One byte-level BPE vocabulary file.

    ``cache_chunks`` bounds the memory of the two cache generations; it changes no result.
    """

    def __init__(self, path: str, cache_chunks: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.text = [b"%d," % i for i in range(self.size)]
        self.by_text = {b"%d" % i: t for i, t in enumerate(self.tokens)}
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.split = regex.compile(PATTERN)
        self.inner_space = regex.compile(r" (?=\s|$)")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache_chunks, self.young, self.old = cache_chunks, {}, {}

    def forget(self) -> None:
        """Empty the caches, so that a worker that waits for other work holds little."""
        self.young, self.old = {}, {}
        pa.default_memory_pool().release_unused()

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has; words are not empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_word = [], []
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.full(len(symbols), NONE, np.int32)
            rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            per_symbol = np.repeat(lowest, np.diff(np.r_[starts, len(symbols)]))
            over = per_symbol == NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_word.append(word[over])
            chosen = np.flatnonzero((rank == per_symbol) & ~over)
            if not len(chosen):
                break
            # a run of overlapping equal pairs merges from its left
            index = np.arange(len(chosen))
            run_start = np.r_[True, np.diff(chosen) != 1]
            chosen = chosen[(index - np.maximum.accumulate(np.where(run_start, index, 0))) % 2 == 0]
            symbols[chosen] = self.made[at[chosen]]
            keep = ~over
            keep[chosen + 1] = False
            symbols, word = symbols[keep], word[keep]
        flat, owner = np.concatenate(done_symbols), np.concatenate(done_word)
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def chunks(self, text: str) -> list:
        """Cut at each space that a non-space follows; pre-tokenizing the pieces one by one gives the same words.

        A piece stands for itself after its space; the first has no space before it and is a 1-tuple.
        """
        first, *rest = text.split(" ")
        if not self.inner_space.search(text):
            return [(first,), *rest]
        out, lead = [], first
        for x in rest:
            if not x or x[0].isspace():
                lead += " " + x
            else:
                out.append(lead)
                lead = x
        out.append(lead)
        return [(out[0],), *out[1:]]

    def _learn(self, chunks: list, into: dict) -> None:
        """Encode chunks together; a chunk's value is its ids in decimal, each followed by a comma."""
        words, upto = [], [0]
        for c in chunks:
            words += self.split.findall(c[0] if isinstance(c, tuple) else " " + c)
            upto.append(len(words))
        if not words:
            into.update(dict.fromkeys(chunks, b""))
            return
        distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
        flat, counts = self.merge([w.encode() for w in distinct])
        text, ends = list(map(self.text.__getitem__, flat.tolist())), np.cumsum(counts).tolist()
        spans = [b"".join(text[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        each = [spans[distinct[w]] for w in words]
        for c, a, b in zip(chunks, upto, upto[1:], strict=False):
            into[c] = b"".join(each[a:b])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids in decimal, each followed by a comma."""
        parts = []
        for t in texts:
            if self.specials and self.specials.search(t):
                row, at = [], 0
                for m in self.specials.finditer(t):
                    row += [*self.chunks(t[at : m.start()]), self.special[m[0]]]
                    at = m.end()
                parts.append([*row, *self.chunks(t[at:])])
            else:
                parts.append(self.chunks(t))
        if len(self.young) > self.cache_chunks:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        need, long = [], []
        for c in set(filterfalse(young.__contains__, chain.from_iterable(parts))):
            if isinstance(c, int):
                young[c] = self.text[c]
            elif c in old:
                young[c] = old[c]
            else:
                (long if len(c[0] if isinstance(c, tuple) else c) > LONGEST_CACHED else need).append(c)
        if need:
            self._learn(need, young)
        if long:
            once: dict = {}
            self._learn(long, once)
            return [b"".join([once[c] if c in once else young[c] for c in p]) for p in parts]
        return [b"".join(map(young.__getitem__, p)) for p in parts]

    def ids(self, encoded: bytes) -> list[int]:
        return list(map(int, encoded[:-1].split(b","))) if encoded else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")

    def decode_text(self, encoded: bytes) -> str:
        """The same, from ids in decimal."""
        return b"".join(map(self.by_text.__getitem__, encoded[:-1].split(b","))).decode("utf-8", "replace") if encoded else ""


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _slices(batch: pa.RecordBatch, column: int, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows of about so many characters in a column, and its texts."""
    start, run, n = 0, [], 0
    for x in batch.column(column):
        t = x.as_py() or ""
        run.append(t)
        n += len(t)
        if n >= chars:
            yield batch.slice(start, len(run)), run
            start, run, n = start + len(run), [], 0
    if run:
        yield batch.slice(start), run


def encode(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` array<int> and ``decoded`` string of every row."""
    fields = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b, texts in chain.from_iterable(_slices(b, len(keep)) for b in batches):
            ids = list(map(c.ids, c.encode_batch(texts)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(ids, pa.list_(pa.int32())), pa.array(map(c.decode, ids), pa.string())], names=[*keep, "ids", "decoded"])
        c.forget()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ids array<int>", "decoded string"])
    return df.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def encode_digests(df: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text decoded from them, of every row; ``ids`` as well if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b, texts in chain.from_iterable(_slices(b, 1) for b in batches):
            n, ids_sha, text_sha, ids = [], [], [], []
            for e in c.encode_batch(texts):
                n.append(e.count(b","))
                ids_sha.append(hashlib.sha256(e[:-1]).hexdigest())
                text_sha.append(hashlib.sha256(c.decode_text(e).encode()).hexdigest())
                if with_ids:
                    ids.append(np.fromstring(e[:-1], np.int32, sep=","))
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                names, columns = [*names, "ids"], [*columns, pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        c.forget()

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return df.select("doc_id", "text").mapInArrow(run, schema)
