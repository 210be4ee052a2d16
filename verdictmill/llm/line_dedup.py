"""Substring deduplication by hashing lines, paragraphs or sentences of lines.

Each text is cut into units; a unit's normal form (lower case, white space runs as one space, trimmed) is
hashed to 128 bits. Digests are grouped over the whole corpus; the occurrence in the document of the smallest
id, there the first one, stays, and all others are taken out, with their offsets in the original text kept.

Passages that documents share need not stand on lines of their own. Cut into sentences, such a passage is a run of
neighbouring repeated units, whatever stands around it; a run is taken out when it is long enough, so that a sentence or a licence
line that recurs by itself is left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WHITE, Scratch, slices

#: Of lines and paragraphs that are compared by themselves.
MIN_WORDS = 6
#: Repeated neighbours go from RUN_WORDS words together on: a line of that length by itself, a passage of short lines or sentences as a whole, but not a
#: heading or a licence line. Sentences of fewer than SENTENCE_WORDS words would not count towards them.
RUN_WORDS, SENTENCE_WORDS = 20, 1
UNITS = "id long, hash long, digest binary, i int, words int, start long, length long, gap long, again boolean"
COLUMNS = [x.split()[0] for x in UNITS.split(", ")]
#: What separates units; the separator belongs to no unit.
SEPARATORS = {"line": r"\n", "paragraph": r"\n[\x20\x09-\x0D]*\n"}
#: A sentence with the white space that follows: up to a mark before white space, a mark of scripts without spaces, or a line's end.
SENTENCE = r"(?s).+?(?:[.!?…]+[\x20\x09-\x0D]+|[。！？]+[\x20\x09-\x0D]*|\n|\z)"
#: In scripts without spaces each character is a word.
UNSPACED = "฀-໿぀-ヿ㐀-鿿豈-﫿"
WORDS = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"
_WHITE, _WORDS, _BLANK = re.compile(WHITE), re.compile(WORDS), " \t\n\v\f\r"


def unit_spans(text: str, separator: re.Pattern) -> Iterator[tuple[int, int, int]]:
    """(start, end, end of the separator that follows) of the units of a text, in order."""
    at = 0
    for m in separator.finditer(text):
        yield at, m.start(), m.end()
        at = m.end()
    yield at, len(text), len(text)


def sentence_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """The same of sentences; what follows one is the white space up to the next."""
    for m in re.finditer(SENTENCE.replace(r"\z", r"\Z"), text):
        yield m.start(), m.start() + len(m.group().rstrip(_BLANK)), m.end()


def normal(unit: str) -> str:
    return _WHITE.sub(" ", unit.lower()).strip(" ")


def unit_digests(docs: DataFrame, unit: str, min_words: int) -> DataFrame:
    """(id, hash, digest, i, words, start, length, gap, again) of the units of documents (id, hash of the text, text) that have ``min_words`` words:
    ``i`` numbers those that have any, ``gap`` is the length of the separator that follows, ``again`` says that the same document had the unit before."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        separator = re.compile(SEPARATORS[unit]) if unit in SEPARATORS else None
        for pdf in batches:
            rows: list[tuple] = []
            for doc_id, hash_, text in zip(pdf["id"], pdf["hash"], pdf["text"], strict=True):
                seen: set[bytes] = set()
                i = 0
                for a, b, c in unit_spans(text, separator) if separator else sentence_spans(text):
                    key = normal(text[a:b])
                    if not key:
                        continue
                    i += 1
                    words = len(_WORDS.findall(key))
                    if words >= min_words:
                        d = hashlib.blake2b(key.encode(), digest_size=16).digest()
                        rows.append((doc_id, hash_, d, i, words, a, b - a, c - b, d in seen))
                        seen.add(d)
                if len(rows) >= 50_000:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows = []
            yield pd.DataFrame(rows, columns=COLUMNS)

    return docs.mapInPandas(cut, UNITS)


def without_spans(text: str, spans: list[tuple[int, int, int]], unit: str) -> str:
    """The text without the units at ``spans`` (start, length, gap) and their separators. Between two sentences that stay, a line
    break stays if one stood before or after what was between them; before a removed end, the separator goes too."""
    parts: list[str] = []
    at, broke = 0, False

    def keep(part: str) -> None:
        if part:
            if parts and broke and unit == "sentence":
                body = parts[-1].rstrip(_BLANK)
                if "\n" not in parts[-1][len(body) :]:
                    parts[-1] = body + "\n"
            parts.append(part)

    for start, length, gap in spans:
        keep(text[at:start])
        at = start + length + gap
        broke = "\n" in text[start + length : at]
    if at == len(text) and unit == "sentence":
        return "".join(parts).rstrip(_BLANK)
    keep(text[at:])
    left = "".join(parts)
    start, length, _ = spans[-1]
    return re.sub(SEPARATORS[unit] + r"\Z", "", left) if unit in SEPARATORS and start + length == len(text) else left


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = MIN_WORDS, run_words: int = 0) -> DataFrame:
    """One row per document: id, text without its repeated units, n_removed, removed (start, length, keep_id).

    ``unit`` is line, paragraph or sentence. Without ``run_words``, each repeated unit of ``min_words`` words goes; headings and single words
    recur without being copies. With it, all units are compared, and those that are repeated go in runs of neighbours whose units of
    ``min_words`` words have ``run_words`` words together.

    ``removed`` has the offsets in the original text, in order; ``keep_id`` is the document that keeps the unit.
    With a unit goes the separator that follows it. A null text stays null; rows without an id pass unchanged; rows that repeat an id
    and a text are one document, those that repeat an id with different texts are several, of which one keeps the unit; an empty table gives an empty result; further columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    units = scratch.keep(unit_digests(base.filter("id is not null and text is not null"), unit, 1 if run_words else max(1, min_words)))
    first = scratch.keep(units.groupBy("digest").agg(F.min(F.struct("id", "hash")).alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    again = (F.col("id") != F.col("keep.id")) | (F.col("hash") != F.col("keep.hash")) | F.col("again")
    gone = scratch.keep(units.join(first, "digest").filter(again).select("id", "hash", "i", "words", "start", "length", "gap", F.col("keep.id").alias("keep_id")))
    # Rows of one document meet once; what follows keeps their place.
    gone = gone.repartition("id", "hash").dropDuplicates(["id", "hash", "i"])
    if run_words:
        of = W.partitionBy("id", "hash")
        counted = F.sum(F.when(F.col("words") >= min_words, F.col("words"))).over(of.partitionBy("id", "hash", "_run"))
        gone = gone.withColumn("_run", F.col("i") - F.row_number().over(of.orderBy("i"))).withColumn("_words", counted).filter(F.col("_words") >= run_words)
    spans = scratch.keep(gone.groupBy("id", "hash").agg(F.array_sort(F.collect_list(F.struct("start", "length", "keep_id", "gap"))).alias("spans")))
    scratch.drop(units, first)

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            removed = [[] if s is None else list(s) for s in pdf["spans"]]
            texts = [without_spans(t, [(x["start"], x["length"], x["gap"]) for x in s], unit) if s else t for t, s in zip(pdf["text"], removed, strict=True)]
            told = [[{k: x[k] for k in ("start", "length", "keep_id")} for x in s] for s in removed]
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "text": texts, "n_removed": [len(s) for s in removed], "removed": told})

    both = base.join(spans, ["id", "hash"], "left").select("id", "text", "spans")
    out = both.mapInPandas(rebuild, "id long, text string, n_removed long, removed array<struct<start: bigint, length: bigint, keep_id: bigint>>")
    return out.withColumnRenamed("id", id_col)
