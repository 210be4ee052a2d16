"""Byte-level BPE over Arrow batches: encoding with offsets, and decoding that puts split characters together.

The vocabulary is a file of ranks (token bytes, rank). It becomes a model of the ``tokenizers`` library: bytes are written as printable characters,
every split of a token into two tokens is a merge with that token's rank, and a word that is a token is that token. Words are the matches of a
pattern, with the character classes of ``tiktoken``'s engine, since Unicode tables differ between libraries. A worker has each word that it does not
know yet encoded by the library, in batches, and keeps the ids of a bounded number of words.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenization import _bytes_of

#: Words whose ids a worker keeps, of at most so many characters each.
KNOWN, SHORT = 500_000, 48
#: Rows, and characters, of a slice that is encoded at once and passed on before the next.
ROWS, CHARS = 256, 1 << 20

ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _ranges(chars: str) -> str:
    """Characters, ascending, as the inside of a character class."""
    points = np.array([ord(c) for c in chars])
    first = np.r_[0, np.flatnonzero(np.diff(points) > 1) + 1]
    last = np.r_[first[1:] - 1, len(points) - 1]
    return "".join(f"\\U{points[a]:08x}-\\U{points[b]:08x}" for a, b in zip(first, last, strict=True))


@functools.lru_cache(maxsize=4)
def classes(end: int = 0x110000) -> dict[str, str]:
    r"""Of the characters below ``end``: what \p{L}, \p{N} and \s are to ``tiktoken``: it drops what a pattern does not match, so a pattern of one class gives its members."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, end)]))
    plain = {bytes([b]): b for b in range(256)}
    found = {c: bytes(tiktoken.Encoding("class", pat_str=c + "+", mergeable_ranks=plain, special_tokens={}).encode_ordinary(every)).decode() for c in (r"\p{L}", r"\p{N}", r"\s")}
    return {c: _ranges(chars) for c, chars in found.items()}


def own_classes(pattern: str, end: int = 0x110000) -> str:
    r"""The pattern with its classes written out; \S is what is not in \s."""
    out, inside, at = [], False, 0
    for m in re.finditer(r"\\p\{[LN]\}|\\[sS]|[\[\]]", pattern):
        out.append(pattern[at : m.start()])
        at, token = m.end(), m.group()
        if token in "[]":
            inside = token == "["
            out.append(token)
        elif token == r"\S":
            out.append(f"[^{classes(end)[chr(92) + 's']}]")
        else:
            out.append(classes(end)[token] if inside else f"[{classes(end)[token]}]")
    return "".join([*out, pattern[at:]])


class ByteLevel:
    """Ids, offsets and bytes of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        shown = {byte: char for char, byte in _bytes_of().items()}
        write = lambda token: "".join(shown[b] for b in token)
        vocab = {write(token): rank for token, rank in ranks.items()}
        merges = [(write(t[:k]), write(t[k:])) for t in sorted(ranks, key=ranks.get) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)
        # Most texts have no character beyond the first plane; classes of that plane alone are several times as fast.
        self.narrow, self.wide, self.beyond = re.compile(own_classes(pattern, 0x10000)), re.compile(own_classes(pattern)), re.compile("[\U00010000-\U0010ffff]")
        self.known: dict[str, tuple[int, ...]] = {}
        byte = _bytes_of()
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in vocab.items():
            tokens[rank] = bytes(byte[c] for c in token)
        self.tokens = tokens
        #: Characters that begin in a token; whether it begins inside one, and whether one goes on after it.
        self.begun = np.array([sum(b & 0xC0 != 0x80 for b in t) for t in tokens], np.int32)
        self.inner = np.array([bool(t) and t[0] & 0xC0 == 0x80 for t in tokens], np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [(self.wide if self.beyond.search(t) else self.narrow).findall(t) for t in texts]
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        unknown = list({w for words in split for w in words if w not in known})
        ids = dict(zip(unknown, (tuple(e.ids) for e in self.model.encode_batch_fast(unknown, add_special_tokens=False)), strict=True))
        known.update(ids)
        out = [np.fromiter(itertools.chain.from_iterable(map(known.__getitem__, words)), np.int32) for words in split]
        for w in unknown:
            if len(w) > SHORT:
                del known[w]
        return out

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token. Tokens that share a character all span it."""
        ends = np.cumsum(self.begun[ids], dtype=np.int32)
        return ends - self.begun[ids] - self.inner[ids], ends

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])

    def pieces(self, ids: np.ndarray) -> list[str]:
        """The text that each token completes: what a stream of tokens can show after it. A character whose bytes are split comes with its last token; a broken one as U+FFFD."""
        import codecs

        stream, out = codecs.getincrementaldecoder("utf-8")(errors="replace"), []
        for i in ids.tolist():
            out.append(stream.decode(self.tokens[i]))
        if out:
            out[-1] += stream.decode(b"", final=True)
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> ByteLevel:
    """Built once in a Python worker."""
    return ByteLevel(path, pattern)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.array([0, *(len(p) for p in parts)], np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))


def _slices(texts: list[str]) -> Iterator[slice]:
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and (k - at >= ROWS or size + len(t) > CHARS):
            yield slice(at, k)
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = True, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, starts, ends: the tokens of each whole text, and the characters of the text that each spans (null unless ``spans``).

    A null text is empty, an empty one has no tokens. Repeated rows are encoded each; a null id stays null; an empty
    table gives an empty result; further columns are not read. The file of ranks has to be on every executor.
    """
    path, pattern = _defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _slices(texts):
                ids = bpe.encode(texts[part])
                at = [_lists(list(side)) for side in zip(*map(bpe.spans, ids), strict=True)] if spans else [pa.nulls(len(ids), pa.list_(pa.int32()))] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], _lists(ids), *at], ["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), text: bool = True, pieces: bool = False, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns ``keep`` and decoded_bytes, decoded_text (a broken character as U+FFFD), pieces: the text that each token completes. Text and pieces are null unless asked for.

    Null ids are none; a null within them, or an id that the vocabulary does not have, is an error. Other columns are not read.
    """
    path, pattern = _defaults(path, pattern)
    rows = encoded.select(*keep, F.col(ids_col).cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [np.zeros(0, np.int32) if row is None else np.asarray(row, np.int32) for row in part.column(len(keep)).to_numpy(zero_copy_only=False)]
                raw = [bpe.decode(i) for i in ids]
                told = pa.array([r.decode("utf-8", "replace") if text else None for r in raw], pa.string()), pa.array([bpe.pieces(i) if pieces else None for i in ids], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(raw, pa.binary()), *told], [*keep, "decoded_bytes", "decoded_text", "pieces"])

    added = "decoded_bytes binary, decoded_text string, pieces array<string>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), added])
    return rows.mapInArrow(run, schema)


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or ranks_path(), pattern or public_tokenizers.PATTERN
