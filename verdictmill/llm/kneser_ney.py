"""Quality classification by perplexity under an interpolated modified Kneser-Ney model of characters.

Training counts the top-order n-grams of all trusted text, per language. Continuation counts of the lower orders,
context totals and discounts follow by grouping; probabilities by joining each order's counts with its contexts and with the
order below, all hash-partitioned by n-gram.

With backoff weight g(c) of a context c and f(x) = ln p(x) - ln g(context of x) - ln p(suffix of x), the log
probability of a text is a plain sum over the n-grams that occur in it: f(x) for each n-gram of the model, and ln g(c) for each
context that something follows. So the model can be cut into shards of bounded size: each shard is joined with all
documents by itself, given up before the next is read, and the partial sums are added up. No n-gram of a document is ever shuffled.
N-grams are joined by 64-bit keys without a look at the n-gram: of a model of 100 million, one lookup in 10^11 of an absent n-gram finds another.

Thresholds are a quantile of the perplexity of held-out trusted documents, per language; languages with few of them share
a model and a threshold of all trusted documents. A low perplexity rejects nothing, as documents of the training text have the
lowest; repetition is measured by itself, as the share to which a text can be compressed, against a low quantile of trusted text.
"""

from __future__ import annotations

import math
import re
import statistics
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, row_hash, slices, without_rows

U = np.uint64
ORDER = 5
#: Entries of a model shard; a shard's table takes up to 52 bytes an entry in a Python worker.
SHARD_ENTRIES = 2_500_000
#: The quantile of the perplexity of held-out trusted documents that is the threshold. Fewer than 1 / (1 - HIGH) documents cannot hold it: their
#: greatest value lies below it as a rule, and it is estimated by the normal distribution of their log perplexities, at their greatest value at least.
HIGH = 0.999
#: A language with fewer held-out trusted documents shares the common model and threshold.
ENOUGH = 20
#: The quantile of the compressed share of trusted documents below which a text is too repetitive; it is measured in pieces of PIECE characters.
LOW, PIECE = 0.001, 1000
#: The key of the common model; no language has it.
COMMON = "\x00common"
#: One in so many trusted documents is held out from training.
HELD_OUT = 5
NO_LANG = ""
_START = "\x02"
_WHITE = re.compile(r"\s\s+|[^\S ]")
_BLOCK = 1 << 18


def clean(text: str) -> str:
    """White space runs as one space; the two control characters that the model uses are spaces too."""
    return _WHITE.sub(" ", text.replace("\x00", " ").replace(_START, " ")).strip()


def points(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after order - 1 start marks, and which of them are text."""
    pad = _START * (order - 1)
    codes = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le"), np.uint32)
    n = np.array([len(t) for t in texts], np.int64)
    real = np.ones(len(codes), bool)
    starts = np.cumsum(n + order - 1) - n - (order - 1)
    for k in range(order - 1):
        real[starts + k] = False
    return codes, real


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for b, t in enumerate(texts):
        if size and size + len(t) > _BLOCK:
            yield a, b
            a, size = b, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def count_grams(trusted: DataFrame, order: int) -> DataFrame:
    """(lang, gram, c): occurrences of each top-order n-gram. Tasks count their documents before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, 4096):
            for lang, part in pdf.groupby("lang"):
                texts = [clean(t) for t in part["text"]]
                sums: list[tuple[np.ndarray, np.ndarray]] = []
                for a, b in _blocks(texts):
                    codes, real = points(texts[a:b], order)
                    letters, dense = np.unique(codes, return_inverse=True)
                    if len(letters) ** order >= 2**63:  # cannot be packed: as rows of code points
                        windows = np.lib.stride_tricks.sliding_window_view(codes, order)[real[order - 1 :]]
                        grams, n = np.unique(windows, axis=0, return_counts=True)
                    else:
                        packed = np.zeros(max(0, len(codes) - order + 1), np.int64)
                        for k in range(order):
                            packed = packed * len(letters) + dense[k : k + len(packed)]
                        packed, n = np.unique(packed[real[order - 1 :]], return_counts=True)
                        grams = np.empty((len(packed), order), np.uint32)
                        for k in range(order - 1, -1, -1):
                            packed, digit = np.divmod(packed, len(letters))
                            grams[:, k] = letters[digit]
                    sums.append((np.ascontiguousarray(grams, np.uint32).view(f"<U{order}").ravel(), n))
                if sums:
                    grams, n = (np.concatenate(x) for x in zip(*sums, strict=True))
                    grams, of = np.unique(grams, return_inverse=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams.astype(object), "c": np.bincount(of, n).astype(np.int64)})

    return trusted.select("lang", "text").mapInPandas(count, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _discount(counts: Column, d1: Column, d2: Column, d3: Column) -> Column:
    return F.when(counts == 1, d1).when(counts == 2, d2).otherwise(d3)


def train(trusted: DataFrame, order: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The model (lang, gram, f, g) and the languages (lang, base): ``base`` is ln p of a character without any evidence."""
    levels = [scratch.keep(count_grams(trusted, order))]
    for n in range(order - 1, 0, -1):
        levels.insert(0, scratch.keep(levels[0].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c"))))
    letters = levels[0].groupBy("lang").agg((F.count("*") + 1).alias("letters"))
    pieces, lower, langs = [], None, None
    for n, level in enumerate(levels, 1):
        of = [F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        told = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
        fit = lambda k: k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        # Where the counts of counts do not tell, or tell a discount outside (0, k), half the count is used.
        d = [F.when(told & (fit(k) > 0) & (fit(k) < k), fit(k)).otherwise(F.lit(k / 2)).alias(f"d{k}") for k in (1, 2, 3)]
        discounts = level.groupBy("lang").agg(*of).select("lang", *d)
        contexts = level.groupBy("lang", F.substring("gram", 1, n - 1).alias("context")).agg(F.sum("c").alias("s"), *[F.count_if(F.col("c") == k).alias(f"a{k}") for k in (1, 2)], F.count_if(F.col("c") >= 3).alias("a3"))
        contexts = contexts.join(discounts, "lang").withColumn("g", (F.col("d1") * F.col("a1") + F.col("d2") * F.col("a2") + F.col("d3") * F.col("a3")) / F.col("s"))
        counted = level.withColumn("context", F.substring("gram", 1, n - 1)).join(contexts, ["lang", "context"])
        own = (F.col("c") - _discount(F.col("c"), F.col("d1"), F.col("d2"), F.col("d3"))) / F.col("s")
        if lower is None:
            langs = scratch.keep(contexts.join(letters, "lang").select("lang", (F.ln("g") - F.ln("letters")).alias("base")))
            below = counted.join(letters, "lang").withColumn("below", 1.0 / F.col("letters"))
        else:
            below = counted.withColumn("suffix", F.substring("gram", 2, n - 1)).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        p = own + F.col("g") * F.col("below")
        lower = scratch.keep(below.select("lang", "gram", p.alias("p"), (F.ln(p) - F.ln("g") - F.ln("below")).alias("f")))
        pieces.append(lower.select("lang", "gram", "f", F.lit(0.0).alias("g")))
        if n > 1:
            pieces.append(contexts.select("lang", F.col("context").alias("gram"), F.lit(0.0).alias("f"), F.ln("g").alias("g")))
    model = pieces[0]
    for piece in pieces[1:]:
        model = model.unionByName(piece)
    return scratch.keep(model.groupBy("lang", "gram").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))), langs


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_CODES = _mix(np.arange(0x110000, dtype=U) + U(0x9E3779B97F4A7C15))
_STEPS = [U(pow(0xD6E8FEB86659FD93, k, 2**64)) for k in range(64)]


def gram_keys(codes: np.ndarray, order: int, salt: int) -> Iterator[np.ndarray]:
    """For n = 1 .. order the keys of the n-grams that end at each place (of no use at the first n - 1 places)."""
    letters = _CODES[codes]
    key = np.full(len(codes), U(salt))
    for n in range(1, order + 1):
        key[n - 1 :] += letters[: len(codes) - n + 1] * _STEPS[n]
        yield key


def lang_salt(lang: str) -> int:
    return int(_mix(np.array([sum(ord(c) * 257**k for k, c in enumerate(lang)) % 2**64], U))[0])


class Table:
    """An open hash table of a shard. A row has a key and, in the bits of one word, its f and g; 0 is no key."""

    def __init__(self, keys: np.ndarray, f: np.ndarray, g: np.ndarray):
        self.bits = max(4, math.ceil(math.log2(1.6 * len(keys) + 1)))
        size = 1 << self.bits
        self.rows = np.zeros((size, 2), U)
        values = np.stack([f, g], axis=1).astype(np.float32).view(U).ravel()
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.rows[at, 0] == 0
            spots, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.rows[spots, 0], self.rows[spots, 1] = keys[left[won]], values[left[won]]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, at = left[lost], (at[lost] + 1) & (size - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """f and g of each key, zeros where it is absent."""
        at = self._place(keys)
        there = np.take(self.rows, at, axis=0, mode="wrap")
        hit = there[:, 0] == keys
        out = there[:, 1] * hit  # zero bits are two zeros
        open_ = np.flatnonzero(~hit & (there[:, 0] != 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.rows) - 1)
            there = self.rows[at]
            hit = there[:, 0] == keys[open_]
            out[open_[hit]] = there[hit, 1]
            on = ~hit & (there[:, 0] != 0)
            open_, at = open_[on], at[on]
        return out.view(np.float32).reshape(-1, 2)


def score_texts(texts: list[str], lang: str, table: Table, order: int) -> np.ndarray:
    """Sum over each cleaned text of what the table's n-grams add to its log probability."""
    out = np.zeros(len(texts))
    salt = lang_salt(lang)
    for a, b in _blocks(texts):
        codes, real = points(texts[a:b], order)
        followed = np.append(real[1:], False)
        own, ahead = np.zeros(len(codes), np.float32), np.zeros(len(codes), np.float32)
        for n, keys in enumerate(gram_keys(codes, order, salt), 1):
            found = table.find(keys)
            own += found[:, 0]
            if n < order:
                ahead += found[:, 1]
        total = (own * real).astype(np.float64) + ahead * followed
        n = np.array([len(t) for t in texts[a:b]], np.int64) + order - 1
        starts = np.cumsum(n) - n
        out[a:b] = np.add.reduceat(total, starts) if len(n) else 0
    return out


def _key_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys = np.zeros(len(pdf), U)
        for (lang, length), rows in pdf.groupby(["lang", pdf["gram"].str.len()]).indices.items():
            codes = np.frombuffer("".join(pdf["gram"].iloc[rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), length)
            key = np.full(len(rows), U(lang_salt(lang)))
            for j in range(length):
                key += _CODES[codes[:, length - 1 - j]] * _STEPS[j + 1]
            keys[rows] = key
        yield pd.DataFrame({"key": keys.view(np.int64), "f": pdf["f"].astype(np.float32), "g": pdf["g"].astype(np.float32)})


def score(docs: DataFrame, model: DataFrame, order: int, shard_entries: int, carry: list[str], scratch: Scratch) -> DataFrame:
    """``docs`` (lang, the model's key; text and the columns to ``carry``) with n_chars_scored, log_sum (the base left out) and share."""
    spark = docs.sparkSession
    shards = max(1, math.ceil(model.count() / shard_entries))
    keyed = scratch.keep(model.mapInPandas(_key_grams, "key long, f float, g float").withColumn("shard", F.pmod("key", F.lit(shards))))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    summed = None
    for k in range(shards):
        # One shard at a time: about shard_entries n-grams of 16 bytes pass, and are given up before the next is read.
        part = keyed.filter(F.col("shard") == k).drop("shard").toArrow()
        shard = spark.sparkContext.broadcast(tuple(part[c].to_numpy().tobytes() for c in ("key", "f", "g")))
        del part
        one = docs.mapInPandas(_scorer(shard, order, carry, k == 0), f"{fields}, n_chars_scored long, log_sum double, share double")
        one = scratch.keep(one)
        shard.destroy()
        summed = one if summed is None else summed.unionByName(one)
    scratch.drop(keyed)
    if shards == 1:
        return summed
    # A row that occurs several times comes several times from each round.
    summed = summed.groupBy(*carry, "n_chars_scored").agg(*[(F.sum(c) / F.count("*") * shards).alias(c) for c in ("log_sum", "share")], (F.count("*") / shards).cast("int").alias("_rows"))
    return summed.withColumn("_row", F.explode(F.sequence(F.lit(1), "_rows"))).drop("_row", "_rows")


def compressed_share(text: str) -> float:
    """Bytes of the pieces of a cleaned text when compressed, of all its bytes: low for repeated words and phrases. A short piece has a higher share."""
    pieces = [text[k : k + PIECE].encode() for k in range(0, len(text), PIECE)]
    return sum(len(zlib.compress(x, 1)) for x in pieces) / max(1, sum(map(len, pieces)))


def _scorer(shard, order: int, carry: list[str], first: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = None
        for pdf in slices(batches):
            if table is None:
                keys, f, g = shard.value
                table = Table(np.frombuffer(keys, U), np.frombuffer(f, np.float32), np.frombuffer(g, np.float32))
            texts = [clean(t) if t is not None else "" for t in pdf["text"]]
            sums = np.zeros(len(pdf))
            langs = pdf["lang"].fillna(NO_LANG).to_numpy()
            for lang in np.unique(langs.astype(str)):
                rows = np.flatnonzero(langs == lang)
                sums[rows] = score_texts([texts[i] for i in rows], lang, table, order)
            yield pdf[carry].assign(n_chars_scored=[len(t) for t in texts], log_sum=sums, share=[compressed_share(t) if first else 0.0 for t in texts])

    return run


def perplexity(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Documents (id and language) with n_chars_scored, perplexity, share, _held: null if not trusted, true if held out, and _model: the key of
    their model. Held-out documents come once more (_extra) where a common model is needed."""
    # Only these three columns are read, under names of their own.
    docs = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("_of"), F.col(text_col).alias("text"))
    lang = F.coalesce(F.col("_of"), F.lit(NO_LANG))
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(F.col("doc_id").cast("long").alias("_id")).filter("_id is not null").distinct()
    good = scratch.keep(good.withColumn("_held", F.pmod(F.xxhash64("_id"), F.lit(HELD_OUT)) == 0))
    small = good.count() <= BROADCAST_IDS
    ids = F.broadcast(good) if small else good
    ready = docs.withColumn("_key", F.col("id").cast("long")).join(ids.withColumnRenamed("_id", "_key"), "_key", "left").drop("_key")
    told = F.coalesce(F.col("_held") & F.col("text").rlike(r"\S"), F.lit(False))
    taught = F.coalesce(~F.col("_held") & F.col("text").rlike(r"\S"), F.lit(False))
    own = ready.groupBy(lang.alias("_lang")).agg(F.count_if(told).alias("told"), F.count_if(taught).alias("taught"))
    own = scratch.keep(own.select("_lang", ((F.col("told") >= ENOUGH) & (F.col("taught") > 0)).alias("own")))  # a row per language
    common = own.filter("not own").limit(1).count() > 0
    model_of = F.when(F.col("own"), F.col("_lang")).otherwise(F.lit(COMMON))
    few = F.broadcast(own) if own.count() <= 10_000 else own
    slim = ready.select("id", "_of", lang.alias("_lang"), "_held", row_hash("text", "_of").alias("hash"), "text")
    slim = slim.join(few, "_lang").select("id", "_of", model_of.alias("lang"), "_held", "hash", F.lit(False).alias("_extra"), "text")
    trusted = slim.filter("_held = false and text is not null").select("lang", "text")
    if common:
        more = lambda df: df.filter(F.col("lang") != COMMON).withColumn("lang", F.lit(COMMON))
        trusted = trusted.unionByName(more(trusted))
        slim = slim.unionByName(more(slim.filter("_held")).withColumn("_extra", F.lit(True)))
    model, langs = train(trusted, order, scratch)
    carry = ["id", "_of", "lang", "_held", "hash", "_extra"]
    scored = scratch.keep(score(slim, model, order, shard_entries, carry, scratch))
    scored = scored.withColumnRenamed("lang", "_model").join(langs.withColumnRenamed("lang", "_model"), "_model", "left").withColumnsRenamed({"id": id_col, "_of": lang_col})
    value = F.exp(-(F.col("log_sum") / F.col("n_chars_scored") + F.col("base")))
    return scored.withColumn("perplexity", F.when((F.col("n_chars_scored") > 0) & F.col("base").isNotNull(), value))


def _judged(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str, text_col: str, lang_col: str, order: int, high: float, shard_entries: int) -> DataFrame:
    scored = perplexity(docs, labels, scratch, id_col, text_col, lang_col, order, shard_entries)
    held = F.when(F.col("_held"), F.col("perplexity"))
    told = scored.filter("_held is not null and perplexity is not null").groupBy("_model")
    limits = told.agg(F.percentile_approx(held, high, 100_000).alias("_at"), F.count_if("_held").alias("_n"), F.avg(F.ln(held)).alias("_mean"), F.coalesce(F.stddev_samp(F.ln(held)), F.lit(0.0)).alias("_sd"), F.percentile_approx("share", LOW, 100_000).alias("_least"))
    fitted = F.exp(F.col("_mean") + statistics.NormalDist().inv_cdf(high) * F.col("_sd"))
    threshold = F.when(F.col("_n") * (1 - high) >= 1 - 1e-9, F.col("_at")).otherwise(F.greatest("_at", fitted))
    limits = scratch.keep(limits.filter("_n > 0").select("_model", threshold.alias("threshold"), "_least"))
    judged = scored.filter("not _extra").join(limits, "_model", "left")
    likely, varied = F.col("perplexity") <= F.col("threshold"), F.col("share") >= F.col("_least")
    kept = (F.col("n_chars_scored") > 0) & F.coalesce(likely & varied, F.lit(True))
    return judged.select(id_col, lang_col, "hash", "n_chars_scored", "perplexity", "threshold", kept.alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, high: float = HIGH, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Per document: id, language, n_chars_scored, perplexity, threshold, kept.

    ``labels`` (doc_id, quality, toxic) names the trusted documents, quality 1 and not toxic; all of them are used.
    A document is kept if its perplexity is at most the threshold of its language and its compressed share at least that of
    its language. A language with fewer than ENOUGH held-out trusted documents, or none, has the common model and thresholds of
    all trusted documents; only where none at all is held out, or all are, everything that has a character is kept. A text without
    a character (null, empty, white space) has no perplexity and is rejected. A null language is a language of its own.
    Repeated rows are judged each; an empty table gives an empty result.
    """
    return _judged(docs, labels, Scratch(docs.sparkSession, "kneser-ney"), id_col, text_col, lang_col, order, high, shard_entries).drop("hash")


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, high: float = HIGH, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """The documents that are kept, with all their columns: each row as it is judged, whatever other rows of its id or without one are."""
    scratch = Scratch(docs.sparkSession, "kneser-ney")
    gone = _judged(docs, labels, scratch, id_col, text_col, lang_col, order, high, shard_entries).filter("not kept").select(F.col(id_col).cast("long"), "hash")
    return without_rows(docs, gone, id_col, row_hash(text_col, lang_col), scratch)
