"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. Every token has a span of characters; spans are joined as intervals
with the sections of the document, and a token that crosses a boundary goes to one of them by ``rule``:

* ``first``: the section of its first character,
* ``last``: the section of its last character,
* ``most``: the section that has most of its characters, the earlier of equals.

So the counts of a document's sections sum up to its tokens, which counts of sections encoded alone do not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenization import default_path, tokenizer

RULES = ("first", "last", "most")
COUNTS = "doc_id long, section int, start long, length long, n_tokens long"


def line_starts(text: str) -> np.ndarray:
    """Sections are lines, each with the line feed that ends it. An empty text has one empty section."""
    at = [0]
    while (k := text.find("\n", at[-1])) >= 0 and k + 1 < len(text):
        at.append(k + 1)
    return np.array(at, np.int64)


def token_spans(ids: np.ndarray, chars: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token; a token that starts inside a character starts at that character."""
    ends = np.cumsum(chars[ids])
    return ends - chars[ids] - inner[ids], ends


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str = "first") -> np.ndarray:
    """Section (its place in ``sections``, the ascending starts) of each token span."""
    first = np.searchsorted(sections, starts, side="right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(sections, np.maximum(ends - 1, starts), side="right") - 1
    if rule == "last":
        return last
    out = first.copy()
    bounds = np.append(sections, np.iinfo(np.int64).max)
    for i in np.flatnonzero(last > first):
        k = np.arange(first[i], last[i] + 1)
        out[i] = k[np.argmax(np.minimum(bounds[k + 1], ends[i]) - np.maximum(bounds[k], starts[i]))]
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", sections: Callable[[str], np.ndarray] = line_starts, path: str | None = None) -> DataFrame:
    """One row per section: doc_id, section (from 0), start, length (characters), n_tokens.

    A null text is empty; an empty text has one section without tokens. A null id stays null, repeated rows are
    counted each; an empty table gives an empty result; further columns are not read.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _counted(whole, rule, path, lambda row: sections(row[1]))


def field_token_counts(docs: DataFrame, fields: list[str], id_col: str = "doc_id", rule: str = "first", separator: str = "\n", path: str | None = None) -> DataFrame:
    """One row per field: doc_id, section (the field's place in ``fields``), start, length, n_tokens.

    A document is its fields in order with the separator between them, encoded once as a whole; a separator belongs to the field before it. A null field is
    an empty one; what ``token_counts`` says of odd rows holds.
    """
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    starts, at = [], F.lit(0)
    for k, t in enumerate(texts):
        starts.append(at)
        at = at + F.length(t) + (len(separator) if k + 1 < len(texts) else 0)
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.concat_ws(separator, *texts).alias("text"), F.array(*starts).alias("starts"))
    return _counted(whole, rule, path, lambda row: np.asarray(row[2], np.int64))


def _counted(docs: DataFrame, rule: str, path: str | None, sections: Callable[[tuple], np.ndarray]) -> DataFrame:
    """Counts of rows (doc_id, text, ...) by the ascending starts that ``sections`` gives of a row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    path = path or default_path()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for pdf in batches:
            parts, size = [], 0
            for row in pdf.itertuples(index=False, name=None):
                doc_id, text = row[:2]
                at, ids = sections(row), bpe.encode(text)
                of = attribute(*token_spans(ids, bpe.chars, bpe.inner), at, rule)
                parts.append((doc_id, at, np.diff(np.append(at, len(text))), np.bincount(of, minlength=len(at))))
                size += len(at)
                if size >= 50_000:
                    yield _rows(parts)
                    parts, size = [], 0
            if parts:
                yield _rows(parts)

    return docs.mapInPandas(count, COUNTS)


def _rows(parts: list[tuple]) -> pd.DataFrame:
    n = [len(p[1]) for p in parts]
    return pd.DataFrame(
        {
            "doc_id": pd.array([p[0] if p[0] == p[0] else None for p in parts], dtype="Int64").repeat(n),
            "section": np.concatenate([np.arange(k) for k in n]),
            "start": np.concatenate([p[1] for p in parts]),
            "length": np.concatenate([p[2] for p in parts]),
            "n_tokens": np.concatenate([p[3] for p in parts]),
        }
    )
