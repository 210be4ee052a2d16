"""Byte-level BPE, hard negatives and whitening against the tiktoken library, brute force and dense algebra."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from verdictmill.llm import byte_bpe, hard_negatives, whitening
from verdictmill.llm.common import Scratch
from verdictmill.llm.queries import QUERIES
from verdictmill.llm.vectors import finite

# --- byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.vocabulary(byte_bpe.ranks_path(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.ranks_path()), special_tokens={})


def test_op11_is_what_tiktoken_gives(spark, small, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op11_byte_bpe"](spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_ids_of_random_texts(bpe, library):
    rng = random.Random(7)
    alphabets = [list("aab \n"), list("=-_ "), list("'stmdre vl"), [chr(c) for c in range(0x3040, 0x30FF)], [" ", "\t", "\r\n", "\x0b", "\x85", " ", "᠎", "​", "　", "a", "1", "²", "Ⅷ", "\U0001f600"], list("0123456789 ")]
    for i in range(3000):
        if i % 7 == 6:
            text = "".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(50)) if not 0xD800 <= c < 0xE000)
        else:
            text = "".join(rng.choices(alphabets[i % 7], k=rng.randrange(1, 150)))
        ids = bpe.encode([text])[0]
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_spans_cover_the_text_and_split_characters_come_whole(bpe):
    text = "héllo 中文 \U0001f600 ≠ x க்" + "\U00012345" * 3
    ids = bpe.encode([text])[0]
    starts, ends = bpe.spans(ids)
    assert any((bpe.tokens[i][0] & 0xC0) == 0x80 for i in ids)  # some token begins inside a character
    at = 0
    for i, a, b in zip(ids, starts, ends, strict=True):
        piece = bpe.tokens[i]
        first, last = at, at + len(piece) - 1
        offsets = np.cumsum([0, *(len(c.encode()) for c in text)])
        assert a == np.searchsorted(offsets, first, side="right") - 1
        assert b == np.searchsorted(offsets, last, side="right")
        at += len(piece)
    assert "".join(bpe.pieces(ids)) == text
    assert bpe.pieces(ids[:1].repeat(0)) == []
    broken = bpe.encode(["\U00012345"])[0][:-1]
    assert "�" in "".join(bpe.pieces(broken))


def test_encode_odd_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (3, "word" * 40_000 + " end", "x"), (4, "same", "x"), (4, "same", "x"), (5, "\x00 nul \U0001f600", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.decode(byte_bpe.encode(docs), keep=("doc_id", "ids", "starts", "ends"), pieces=True).collect()
    assert sorted((str(r.doc_id), r.decoded_text) for r in out) == sorted((str(a), b or "") for a, b, _ in rows)
    for r in out:
        assert r.ids == library.encode_ordinary(r.decoded_text)
        assert "".join(r.pieces) == r.decoded_text == r.decoded_bytes.decode()
        assert all(r.decoded_text[a:b] for a, b in zip(r.starts, r.ends, strict=True))
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0))).count() == 0
    assert byte_bpe.encode(docs, spans=False).filter("starts is not null").count() == 0
    told = byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()
    assert [bytes(r.decoded_bytes) for r in told] == [b""]


# --- hard negatives


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hard_negatives.hilbert_keys(grid, bits)
        assert len(set(keys)) == len(grid)
        walk = grid[sorted(range(len(grid)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_are_met():
    rng = np.random.default_rng(3)
    a, low = rng.integers(-9, 9, (40, 6)), rng.integers(-9, 0, (7, 6))
    high = low + rng.integers(0, 9, (7, 6))
    least, most = hard_negatives.score_bounds(a, low, high)
    for g in range(7):
        corners = np.stack(np.meshgrid(*[[low[g, d], high[g, d]] for d in range(6)], indexing="ij"), -1).reshape(-1, 6)
        assert (least[:, g] == (a @ corners.T).min(1)).all()
        assert (most[:, g] == (a @ corners.T).max(1)).all()


def brute_negatives(rows, every=100, positives=5, negatives=5):
    v = {}
    for i, c, label in rows:
        if i is None or label is None or c is None or any(x is None or not np.isfinite(x) for x in c):
            continue
        v[i] = ((label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.array(c, np.float32).astype(float)).astype(int))
    out = []
    for a, (la, xa) in v.items():
        if a % every:
            continue
        scored = sorted(((-int(xa @ x), i, label == la) for i, (label, x) in v.items() if i != a))
        for p, pid in [(-s, i) for s, i, same in scored if same][:positives]:
            fits = [(i, -s) for s, i, same in scored if not same and 80 * p <= -100 * s <= 100 * p][:negatives]
            out += [(a, pid, k + 1, i, p, s) for k, (i, s) in enumerate(fits)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, id string, key string, x string"


@pytest.mark.parametrize("seed,block", [(1, 16), (2, 64), (3, 1024)])
def test_negatives_brute_force(spark, monkeypatch, seed, block):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (6, 12))
    rows = [(int(i), (centres[i % 6] + rng.normal(0, 0.08, 12)).astype(np.float32).tolist(), int(rng.integers(0, 3)), "a", "b", "c") for i in range(1200)]
    same = rows[0][1]
    rows = [(i, same if i % 3 == 0 and seed == 2 else c, *rest) for i, c, *rest in rows]  # one vector holds a third of all rows
    rows += [(2000, None, 1, "a", "b", "c"), (2100, [None] * 12, 1, "a", "b", "c"), (2200, [float("nan")] * 12, 1, "a", "b", "c"), (2300, same, None, "a", "b", "c"), (None, same, 1, "a", "b", "c"), (2400, [0.0] * 12, 1, "a", "b", "c"), (2500, [1.0], 1, "a", "b", "c")]
    df = spark.createDataFrame(rows + rows[:5], VECTORS)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "candidate_blocks", (lambda f: lambda r, s: f(r, s, block, 40))(hard_negatives.candidate_blocks))
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, label="if(vec_id % 7 = 0, (label + 1) % 10, label)").collect())
    assert got == brute_negatives([r[:3] for r in rows if r[0] != 2500])
    assert got


def test_blocks_are_skipped_by_their_zone_maps(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (8, 16))
    rows = [(int(i), (centres[i % 8] + rng.normal(0, 0.02, 16)).tolist(), i % 2) for i in range(4000)]
    good = finite(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "embedding", 2.0**20, id="vec_id", label="cast(label as long)").selectExpr("id", "label", "cast(x as array<int>) x")
    scratch = Scratch(spark, "test")
    blocks = hard_negatives.Blocks(hard_negatives.candidate_blocks(scratch.keep(good), scratch, 100, 64), 16)
    x = np.floor(256 * centres[0])[None]
    least, most = hard_negatives.score_bounds(x, blocks.low, blocks.high)
    best = float((x @ x.T)[0, 0])
    assert (most[0] >= 0.95 * best).mean() < 0.5  # the curve keeps clusters together, so most groups need no reading


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(none).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0], 1, "", "", "")], VECTORS)
    assert hard_negatives.hard_negatives(one).count() == 0
    below = spark.createDataFrame([(100, [1.0], 1, "", "", ""), (101, [-1.0], 1, "", "", ""), (102, [-1.0], 2, "", "", "")], VECTORS)
    assert hard_negatives.hard_negatives(below).count() == 0  # a positive below 0 has an empty window
    huge = spark.createDataFrame([(100, [1e30], 1, "", "", ""), (101, [1.0], 1, "", "", "")], VECTORS)
    assert hard_negatives.hard_negatives(huge).count() == 0


def test_long_products_are_exact():
    a = np.array([[2**28 - 1] * 100, [-(2**28) + 1] * 100], np.int32)
    assert hard_negatives.products(a, a)[0, 0] == 100 * (2**28 - 1) ** 2
    assert hard_negatives.products(a, a)[0, 1] == -100 * (2**28 - 1) ** 2


# --- whitening


def dense(x):
    fit = np.unique(x, axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))
    values, axes = values[::-1], axes[:, ::-1]
    return fit, values, (x - fit.mean(0)) @ axes / np.sqrt(np.maximum(values, 1e-300))


def table_of(out, column):
    df = out.toPandas()
    return df.pivot(index="vec_id", columns="component", values=column).to_numpy()


@pytest.mark.parametrize("seed,n,dim,spread", [(1, 400, 40, "flat"), (2, 300, 60, "steep"), (3, 500, 30, "close"), (4, 60, 3, "flat")])
def test_whitening_is_that_of_the_dense_covariance(spark, seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    scale = {"flat": np.ones(dim), "steep": 0.7 ** np.arange(dim), "close": np.r_[[1.0, 1.001, 1.002, 1.003, 1.004, 1.005], np.full(dim - 6, 0.99)] if dim > 6 else np.ones(dim)}[spread]
    c = (rng.normal(0, 0.2, (n, dim)) * scale).astype(np.float32)
    rows = [(int(i), c[i].tolist(), "n") for i in range(n)] + [(int(n + i), c[0].tolist(), "n") for i in range(n // 2)]  # a hot vector counts once
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string"))
    x = np.floor(256 * np.array([r[1] for r in rows]))
    fit, values, want = dense(x)
    k = min(4, dim)
    got = table_of(out, "whitened")
    assert got.shape == (len(rows), k)
    assert np.abs(np.abs(got) - np.abs(want[:, :k])).max() < 1e-8
    df = out.toPandas()
    assert df["identity_error"].nunique() == 1 and df["identity_error"].max() < 1e-9
    assert np.allclose(df.groupby("component")["explained"].first(), values[:k] / values.sum(), rtol=1e-10)
    sums = [int(s) for s in fit.sum(0)]
    told = dict(zip(df["vec_id"], df["deviation"], strict=True))
    assert all(told[i] == sum((len(fit) * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for i, row in enumerate(x))
    assert (df["n"] == len(fit)).all()


def test_certificates_bound_the_angles(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(-50, 50, (300, 50)) * np.linspace(1.5, 1, 50)
    v = np.cov(x.T, bias=True)

    class Local(whitening.Centred):
        passes = 0

        def times(self, q):
            self.passes += 1
            return v @ q

    fit = Local(None, len(x), x.mean(0))
    values, axes, bounds = whitening.principal(fit, 4)
    exact = np.linalg.eigh(v)[1][:, ::-1][:, :4]
    sines = [np.linalg.norm(e - a * np.sign(e @ a)) for e, a in zip(exact.T, axes.T, strict=True)]
    assert max(sines) < 1e-8 and bounds.max() < 1e-9 and fit.passes < 80
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:4], rtol=1e-12)


def test_whitening_odd_rows(spark):
    shape = "vec_id long, embedding array<double>, component string, x string"
    assert whitening.whiten(spark.createDataFrame([], shape)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")], shape)).count() == 0  # no variance
    rows = [(None, [0.5, 0.1], "", ""), (1, None, "", ""), (2, [None, 0.1], "", ""), (3, [float("inf"), 0.1], "", ""), (4, [], "", ""), (5, [-0.0, 0.3], "", ""), (5, [-0.0, 0.3], "", ""), (6, [0.0, 0.3], "", ""), (7, [0.25, 0.7], "", ""), (8, [1e200, 0.0], "", "")]
    out = whitening.whiten(spark.createDataFrame(rows, shape)).toPandas()
    assert collections.Counter(out["vec_id"].fillna(-1)) == {-1: 2, 5: 4, 6: 2, 7: 2}
    assert (out["n"] == 3).all()
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i], "", "") for i in range(9)], shape)).toPandas()
    assert set(flat["component"]) == {1}  # two of three directions hold no variance
    large = whitening.whiten(spark.createDataFrame([(i, [i * 2.0**35, 1.0 + i % 2], "", "") for i in range(9)], shape)).toPandas()
    assert large["deviation"].isna().any() and large["identity_error"].max() < 1e-4
