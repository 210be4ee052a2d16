"""The training-data operators against brute force, round trips and hand-made cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictmill.llm import ann, exact_dedup, html_text, kneser_ney, line_dedup, mixing, near_dedup, packing, pii, token_counts
from verdictmill.llm.shingles import shingle_sets
from verdictmill.llm.tokenization import ByteBpe, default_path

DOCS = "doc_id long, text string, lang string, source string, keep_id string"  # a further column of a clashing name
ODD = [
    (1, "One two three four five six seven.\nA second line, with a few more words in it.", "en", "b", "x"),
    (2, None, None, None, None),
    (3, "", "en", "a", None),
    (4, " \t\n ", "en", "a", None),
    (5, "One  two three four five\tsix seven.\nA second line, with a few more words in it. ", "en", "b", "x"),
    (5, "One  two three four five\tsix seven.\nA second line, with a few more words in it. ", "en", "b", "x"),
    (6, "word " * 30_000, "de", "b", None),
    (7, "héllo wörld — “quoted” ≠ 中文 \U0001f600 <|endoftext|>", "xx", "c", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def rows(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- exact deduplication


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    levels = exact_dedup.build_levels(words)
    assert sorted(exact_dedup.slot_of(words, levels)) == list(range(5000))
    others = exact_dedup.slot_of(rng.integers(0, 2**63, (5000, 4), dtype=np.uint64), levels)
    assert others.max() < 5000 and others.min() >= -1


@pytest.mark.parametrize("shard_keys", [3, 1024])
def test_exact_dedup_brute_force(documents, texts, shard_keys):
    digest = {i: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).hexdigest() for i, t in texts.items()}
    groups = collections.defaultdict(list)
    for i, d in digest.items():
        groups[d].append(i)
    want = {(i, min(groups[d]), len(groups[d]), i == min(groups[d]), d) for i, d in digest.items()}
    got = exact_dedup.exact_dedup(documents, shard_keys=shard_keys).drop("known")
    assert {tuple(r) for r in got.collect()} == want


def test_exact_dedup_odd_rows(odd, empty):
    got = collections.defaultdict(list)
    for r in exact_dedup.exact_dedup(odd).collect():
        got[r.doc_id].append((r.keep_id, r.group_size, r.kept))
    assert got[2] == [(2, 2, True)] and got[3] == [(2, 2, False)]
    assert got[5] == [(5, 2, True)] * 2 and got[1] == [(1, 1, True)] and got[4] == [(4, 1, True)]
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_repeats(odd).columns == odd.columns


def test_winners_and_counts_come_from_the_slots(spark, monkeypatch):
    texts = ["a", "b", "a", "c", "a", "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: sorted((r.doc_id, r.keep_id, r.group_size, r.known) for r in exact_dedup.exact_dedup(df).collect())
    assert found() == [(0, 0, 3, True), (1, 1, 2, True), (2, 0, 3, True), (3, 3, 1, False), (4, 0, 3, True), (5, 1, 2, True)]
    monkeypatch.setattr(exact_dedup, "members", lambda words, shard: (np.full(len(words), -1), np.zeros(len(words), bool)))
    assert found() != [(0, 0, 3, True), (1, 1, 2, True), (2, 0, 3, True), (3, 3, 1, False), (4, 0, 3, True), (5, 1, 2, True)]


#: Null and repeated ids: equal texts, different ones, and the same text and id twice.
TWICE = [(None, "only without an id", "a"), (None, "only without an id", "a"), (3, "A  text", "a"), (5, "A text", "b"), (5, "a text of its own", "b"), (5, "a text of its own", "b"), (None, "A text", "c"), (None, "", "c"), (7, None, "c")]


def test_exact_stage_loses_no_text(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in TWICE], "doc_id long, text string, source string, keep_id string, n long")
    out = exact_dedup.drop_repeats(df)
    assert out.columns == df.columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert got == collections.Counter([(None, "only without an id"), (3, "A  text"), (5, "a text of its own"), (7, None)])
    assert exact_dedup.drop_repeats(df.limit(0)).count() == 0


# --- mixing


def test_apportionment_is_by_highest_quotients(spark):
    votes = {"a": 1000.0, "b": 333.0, "c": 90.0, "d": 0.0, "e": 333.0}
    for seats in (0, 1, 2, 7, 40, 1001):
        df = spark.createDataFrame([(0, k, v, seats) for k, v in votes.items()], "g int, k string, v double, s long")
        got = {r.k: r.quota for r in mixing.apportion(df, ["g"], "k", "v", "s").collect()}
        want = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = max((k for k in votes if votes[k] > 0), key=lambda k: (votes[k] / (2 * want[k] + 1), -ord(k)))
            want[best] += 1
        assert got == want, seats


def test_mix_totals(documents, texts):
    got = mixing.mix(documents, shard_rows=16).collect()
    assert len(got) == len(texts)
    by = collections.defaultdict(list)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])) and 0 <= r.taken <= 2 * r["size"]
        by[r.source].append(r)
    total = sum(r["size"] for r in got)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(32, 0.02 * v[0].target)
        assert v[0].target <= 2 * v[0].source_size + 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(documents.repartition(3), shard_rows=16).collect()))


def test_targets_refill_until_none_is_above(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), (None, 5000), ("c", 100)], "source string, source_size long")
    got = {r.source: (r.weight, r.target) for r in mixing.source_targets(df).collect()}
    weights = {"a": 3, "b": 1, "c": 2, None: 3}
    sizes, open_, rest, want = {"a": 10, "b": 1000, "c": 100, None: 5000}, {"a", "b", "c", None}, 1.5 * 6110, {}
    while over := {k for k in open_ if rest * weights[k] / sum(weights[x] for x in open_) > 2 * sizes[k]}:
        want |= {k: 2.0 * sizes[k] for k in over}
        rest -= sum(want[k] for k in over)
        open_ -= over
    want |= {k: rest * weights[k] / sum(weights[x] for x in open_) for k in open_}
    assert {k: (weights[k], pytest.approx(want[k])) for k in weights} == got


def test_mix_odd_rows(odd, empty):
    assert {(r.doc_id, r["size"]) for r in mixing.mix(odd).collect()} >= {(2, 0), (3, 0), (4, 0), (6, 30_000)}
    assert mixing.mix(empty).count() == 0
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns
    words = lambda rows: sum((collections.Counter({i: n}) for i, n in rows), collections.Counter())
    assert words((r.doc_id, len(r.text.split())) for r in out.collect()) == words((r.doc_id, r.taken) for r in mixing.mix(odd).filter("taken > 0").collect())


def test_apply_mix_gives_each_taken_row_once(spark):
    text = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    data = [(None, text(k, 20), "a") for k in range(6)] + [(None, text(0, 20), "a")] * 3 + [(7, text(7, 30), "b")] * 5 + [(7, text(8, 11), "b"), (7, text(7, 30), None), (9, text(9, 40), "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    for volume in (0.6, 1.0, 1.5):
        plan = mixing.mix(df, volume=volume).filter("taken > 0").collect()
        got = mixing.apply_mix(df, volume=volume).collect()
        words = lambda rows: sum((collections.Counter({str(k): n}) for *k, n in rows), collections.Counter())
        assert words((r.doc_id, r.source, len(r.text.split())) for r in got) == words((r.doc_id, r.source, r.taken) for r in plan)
        # A copy a row: as many whole texts as passes, and less than a text beyond.
        assert len(got) >= sum(r.passes for r in plan) and len(got) <= sum(r.passes + (r.rest > 0) for r in plan)
        texts = collections.defaultdict(set)
        for i, t, s in data:
            texts[i, s].add(t)
        assert all(any(t.startswith(" ".join(r.text.split())) for t in texts[r.doc_id, r.source]) for r in got)


@pytest.mark.parametrize("mark", ['class="reader-comments"', 'id="user-comments"', 'class="post-comments"', 'id="blog-reviews"', 'class="inline-ad"', 'class="cookie-message"', 'class="sponsored-story"'])
def test_names_that_end_in_the_thing_exclude(mark):
    article = "".join(f"<p>{'A sentence of the article that runs on, with commas, and ends here. ' * 4}</p>" for _ in range(4))
    block = f"<div {mark}><p>{'Somebody wrote this, and it is long enough, to look like text. ' * 3}</p></div>"
    for page in (f"<html><body><article><h1>Title</h1>{article}{block}</article></body></html>", f"<html><body><div class=\"story\"><h1>Title</h1>{article}</div>{block}</body></html>"):
        text = html_text.main_text(page)
        assert text.count("A sentence of the article") == 16 and text.startswith("Title") and "Somebody" not in text
    whole = html_text.main_text(f'<html><body><div class="comments-on-the-news"><h1>Title</h1>{article}</div></body></html>')
    assert whole.count("A sentence of the article") == 16  # what holds the page's text is no aside


# --- near-deduplication


def brute_components(texts, similar=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(n, seed, words=60):
    """A base text and copies with a few words replaced: links at every distance around the threshold."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 500, words)]
    out = {}
    for i in range(n):
        w = list(base)
        for k in rng.integers(0, words, rng.integers(0, 4)):
            w[k] = f"x{rng.integers(0, 10**6)}"
        out[i] = " ".join(w)
    return out


def test_near_dedup_brute_force(spark, documents, texts):
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(documents).collect()}
    assert got == want


def test_near_dedup_finds_every_link_of_a_group_around_the_threshold(spark):
    copies = {k + 1000 * s: t for s in range(3) for k, t in edited(40, s).items()}
    df = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(df).collect()}
    assert got == brute_components(copies)


def test_near_dedup_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(odd).collect()}
    assert {(2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 13, 1, False), (1, 13, 1, True), (6, 1, 6, True)} <= got
    assert near_dedup.near_dedup(empty).count() == 0
    kept = near_dedup.drop_near_copies(odd)
    assert kept.columns == odd.columns and 5 not in [r.doc_id for r in kept.collect()]


def test_near_stage_tells_texts_of_one_id_apart(spark):
    copies = edited(6, 3, words=80)
    near, own = copies[0], " ".join(f"own{k}" for k in range(40))
    data = [(3, near), (5, near + " x"), (5, own), (9, own + " y"), (None, near), (None, own), (11, "of five words or so"), (11, "of five words or so"), (11, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, component_id string, kept int")
    got = collections.Counter((r.doc_id, r.text) for r in near_dedup.drop_near_copies(df).collect())
    assert got[(3, near)] == 1 and got[(5, near + " x")] == 0 and got[(None, near)] == 1 and got[(None, own)] == 1
    assert got[(5, own)] + got[(9, own + " y")] == 1 and got[(11, "of five words or so")] == 2 and got[(11, None)] == 1
    judged = near_dedup.near_dedup(df)
    assert judged.count() == len(data) and {r.component_id for r in judged.collect()} <= {None, 3, 5, 9, 11}


def test_min_max_signature_estimates_jaccard():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    scheme = near_dedup.MinMax(44, 8, 7)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    same = (scheme.signature(a) == scheme.signature(b)).mean()
    assert abs(same - 1500 / 2500) < 0.08


def test_shingles_ignore_white_space_and_ascii_case():
    a, b, c = shingle_sets(["A b\tC d\n e F", "a B c  D e f", "a b c d e f É"])
    assert np.array_equal(a, b) and len(c) == 3 and set(a) < set(c)


# --- packing and token counts


def test_packing_round_trip(documents, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    got = packing.best_fit_packing(documents).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) <= 2048
    volume = -(-sum(r.length for r in got) // 2048)
    assert len(bins) <= 1.02 * volume + 1


def test_lower_bounds_never_exceed_the_optimum():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = rng.integers(1, 101, rng.integers(1, 9))
        bins, left = packing.best_fit(x, 100)
        assert all(x[bins == k].sum() == 100 - left[k] for k in range(len(left))) and (left >= 0).all()
        best = exact_bins(sorted(x, reverse=True), 100)
        assert packing.lower_bound(x, 100) <= best <= len(left)
    assert packing.lower_bound(np.array([60, 60, 60, 41]), 100) == 4


def exact_bins(x, most):
    best = len(x)

    def go(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(x):
            best = len(room)
            return
        for i in range(len(room)):
            if room[i] >= x[k]:
                room[i] -= x[k]
                go(k + 1, room)
                room[i] += x[k]
        room.append(most - x[k])
        go(k + 1, room)
        room.pop()

    go(0, [])
    return best


def test_packing_repacks_partitions_with_gaps(spark):
    df = spark.createDataFrame([(k, "word " * (700 + 13 * (k % 60))) for k in range(300)], "doc_id long, text string")
    once = packing.best_fit_packing(df, group_rows=20, rounds=0).select("sequence_id").distinct().count()
    more = packing.best_fit_packing(df, group_rows=20, rounds=3)
    assert more.select("sequence_id").distinct().count() <= once and more.count() == 300


def test_packing_is_near_the_bound_of_the_whole_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.best_fit_packing(documents, group_rows=512).select("length", "sequence_id").collect()
    bound = packing.lower_bound(np.array([r.length for r in got]), packing.SEQUENCE)
    assert bound <= len({r.sequence_id for r in got}) <= 1.01 * bound + 1


def test_packing_spreads_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, f"word {k} " * 300) for k in range(60)], "doc_id long, text string")
    pieces = packing.tokenized_pieces(df, "doc_id", "text", packing.SEQUENCE, None)
    dealt = packing.pack_groups(pieces, 4, 0, packing.SEQUENCE)
    assert dealt.select((F.col("bin") / 2**24).cast("long").alias("g")).distinct().count() == 4 and dealt.count() == 60


def test_packing_odd_rows(odd, empty):
    got = collections.Counter((r.doc_id, r.length) for r in packing.best_fit_packing(odd).collect())
    assert got[(2, 1)] == 1 and got[(3, 1)] == 1 and sum(n for (i, _), n in got.items() if i == 5) == 2
    assert packing.best_fit_packing(empty).count() == 0


def test_fast_ids_are_the_tokenizers_ids(texts):
    bpe = ByteBpe(default_path())
    for t in [*texts.values(), *(t for _, t, *_ in ODD if t), "a\x85b c   d'S 1½ ²x", "\x1c\x1d\x00\x7f"]:
        assert bpe.encode(t).tolist() == bpe.slow.encode(t, add_special_tokens=False).ids


def test_ids_are_those_of_the_file_as_loaded(texts):
    from tokenizers import Tokenizer

    fresh, bpe = Tokenizer.from_file(default_path()), ByteBpe(default_path())
    assert bpe.encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    for t in [*texts.values(), *(t for _, t, *_ in ODD if t), "<|endoftext|>", "é<|endoftext|>\n<|endoftext|", "<|endoftext|><|endoftext|>中"]:
        whole = fresh.encode(t, add_special_tokens=False)
        ids = bpe.encode(t)
        assert ids.tolist() == whole.ids
        starts, ends = token_counts.token_spans(ids, bpe.chars, bpe.inner)
        assert ends[-1] == len(t) and starts.tolist() == [a for a, _ in whole.offsets]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_brute_force(documents, texts, rule):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    got = collections.defaultdict(dict)
    for r in token_counts.token_counts(documents, rule=rule).collect():
        got[r.doc_id][r.section] = (r.start, r.length, r.n_tokens)
    for i, t in texts.items():
        at = [0, *(k + 1 for k, c in enumerate(t) if c == "\n" and k + 1 < len(t))]
        ends = [*at[1:], len(t)]
        want = [0] * len(at)
        for a, b in tokenizer.encode(t, add_special_tokens=False).offsets:
            inside = [max(0, min(b, e) - max(a, s)) for s, e in zip(at, ends, strict=True)]
            first = max(k for k, s in enumerate(at) if s <= a)
            want[{"first": first, "last": max(k for k, s in enumerate(at) if s <= max(a, b - 1)), "most": inside.index(max(inside)) if max(inside) else first}[rule]] += 1
        assert got[i] == {k: (s, e - s, n) for k, (s, e, n) in enumerate(zip(at, ends, want, strict=True))}


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_of_fields(spark, documents, texts, rule):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    rows = documents.orderBy("doc_id").limit(40).select("doc_id", "lang", F.when(F.col("doc_id") % 5 > 0, F.substring("text", 1, 300)).alias("text"), "source", F.lit(1).alias("n_tokens"))
    got = collections.defaultdict(dict)
    for r in token_counts.field_token_counts(rows, ["lang", "text", "source"], rule=rule, separator=" ").collect():
        got[r.doc_id][r.section] = (r.start, r.length, r.n_tokens)
    for r in rows.collect():
        parts = [x or "" for x in (r.lang, r.text, r.source)]
        whole = " ".join(parts)
        at = [0, len(parts[0]) + 1, len(parts[0]) + len(parts[1]) + 2]
        ends, want = [*at[1:], len(whole)], [0, 0, 0]
        for a, b in tokenizer.encode(whole, add_special_tokens=False).offsets:
            inside = [max(0, min(b, e) - max(a, s)) for s, e in zip(at, ends, strict=True)]
            first = max(k for k, s in enumerate(at) if s <= a)
            want[{"first": first, "last": max(k for k, s in enumerate(at) if s <= max(a, b - 1)), "most": inside.index(max(inside)) if max(inside) else first}[rule]] += 1
        assert got[r.doc_id] == {k: (s, e - s, n) for k, (s, e, n) in enumerate(zip(at, ends, want, strict=True))}


def test_token_counts_odd_rows(odd, empty):
    got = token_counts.token_counts(odd).collect()
    assert {(2, 0, 0), (3, 0, 0)} <= {(r.doc_id, r.length, r.n_tokens) for r in got} and sum(r.doc_id == 5 for r in got) == 4
    assert token_counts.token_counts(empty).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(empty, rule="middle")


# --- line deduplication


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_line_dedup_brute_force(documents, texts, unit):
    seen, want = {}, {}
    pattern = re.compile(line_dedup.SEPARATORS[unit])
    for i in sorted(texts):
        t, left, gone, cut_end = texts[i], [], [], False
        for a, b, c in line_dedup.unit_spans(t, pattern):
            key = " ".join(t[a:b].lower().split())
            if len(key.split()) >= 6 and key in seen:
                gone.append((a, b - a, seen[key]))
                cut_end = b == len(t)
            else:
                left.append(t[a:c])
                if len(key.split()) >= 6:
                    seen[key] = i
        out = "".join(left)
        want[i] = (re.sub(pattern.pattern + r"\Z", "", out) if cut_end else out, gone)
    got = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in line_dedup.line_dedup(documents, unit=unit).collect()}
    assert got == want


def test_line_dedup_odd_rows(odd, empty):
    got = {(r.doc_id, r.text, r.n_removed) for r in line_dedup.line_dedup(odd).collect()}
    assert {(2, None, 0), (3, "", 0), (5, "", 2)} <= got
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_of_texts_that_share_an_id(spark):
    line = "a line of six words here"
    data = [(1, f"{line}\nfirst"), (2, f"the second one begins\n{line}\nand ends"), (2, f"{line}\nother"), (2, f"{line}\nother"), (3, f"three\n{line} too, and more"), (3, f"{line} too, and more\nlast")]
    got = collections.Counter(r.text for r in line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got["the second one begins\nand ends"] == 1 and got["other"] == 2 and got[f"{line}\nfirst"] == 1
    assert sum(f"{line} too" in t for t in got.elements()) == 1


def test_shapes_of_repeated_passages(spark):
    """A line of 22 words in many documents, short sentences, and short lines: each repeat goes but the first. Within a longer line, words without a sentence's mark are no unit."""
    word = lambda tag, n: [f"{tag}{k}" for k in range(n)]
    line = " ".join(word("l", 22)) + "."
    sentences = " ".join(" ".join(word(f"s{k}x", 3)) + "." for k in range(30))
    lines = "\n".join(" ".join(word(f"v{k}x", 3)) for k in range(30))
    shapes = {"line": line, "sentences": sentences, "lines": lines}
    data = [(100 * j + i, f"Own words of {name} {i} come first.\n{passage}\nAnd {i} closes {name}.") for j, (name, passage) in enumerate(shapes.items()) for i in range(50)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string"), unit="sentence", min_words=line_dedup.SENTENCE_WORDS, run_words=line_dedup.RUN_WORDS).collect()}
    for doc_id, text in data:
        name = list(shapes)[doc_id // 100]
        i = doc_id % 100
        assert got[doc_id].text == (text if i == 0 else f"Own words of {name} {i} come first.\nAnd {i} closes {name}."), name
        assert all(x["keep_id"] == doc_id - i for x in got[doc_id].removed)
    alone = [(1, "A heading\nfirst body"), (2, "A heading\nsecond body")]
    assert all(r.n_removed == 0 for r in line_dedup.line_dedup(spark.createDataFrame(alone, "doc_id long, text string"), unit="sentence", min_words=1, run_words=20).collect())


def brute_sentences(texts, min_words, run_words):
    """{id: (text, removed)} by two plain passes over all sentences in the order of ids."""
    first, out = {}, {}
    for i in sorted(texts):
        units = [(m.start(), m.group()) for m in re.finditer(r"(?s).+?(?:[.!?…]+[\x20\x09-\x0D]+|[。！？]+[\x20\x09-\x0D]*|\n|\Z)", texts[i])]
        marked = []
        for a, u in units:
            body = u.rstrip(" \t\n\v\f\r")
            key = " ".join(x for x in re.split(r"[\x20\x09-\x0D]+", u.lower()) if x)
            words = len(re.findall(r"[฀-໿぀-ヿ㐀-鿿豈-﫿]|[^\x20\x09-\x0D฀-໿぀-ヿ㐀-鿿豈-﫿]+", key))
            marked.append((a, body, u[len(body) :], first[key] if key in first else None, words, bool(key)))
            if key:
                first.setdefault(key, i)
        gone, run = set(), []
        for k, (_, _, _, keep, _, has) in enumerate([*marked, (0, "", "", None, 0, True)]):
            if has and keep is None:
                if sum(marked[x][4] for x in run if marked[x][4] >= min_words) >= run_words:
                    gone |= set(run)
                run = []
            elif has:
                run.append(k)
        kept, text = [k for k in range(len(marked)) if k not in gone], ""
        for n, k in enumerate(kept):
            gap, next_ = marked[k][2], kept[n + 1] if n + 1 < len(kept) else None
            if next_ is None:
                gap = gap if k == len(marked) - 1 else ""
            elif next_ > k + 1 and "\n" not in gap and "\n" in marked[next_ - 1][2]:
                gap = "\n"
            text += marked[k][1] + gap
        out[i] = (text, [(marked[k][0], len(marked[k][1]), marked[k][3]) for k in sorted(gone)])
    return out


@pytest.mark.parametrize("run_words", [5, 30])
def test_sentence_runs_brute_force(spark, documents, texts, run_words):
    want = brute_sentences(texts, 4, run_words)
    got = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in line_dedup.line_dedup(documents, unit="sentence", min_words=4, run_words=run_words).collect()}
    assert got == want and any(x for _, x in want.values())


def test_sentence_runs_of_odd_shapes(spark):
    rng = np.random.default_rng(9)
    pool = ["One sentence of six words here.", "Another of them, is it not?", "Short!", "No mark at the end", "中文一句话在这里说。", "第二句话也在这里！", "And… more words, of it, here.", "  led by blanks, it is. "]
    texts = {}
    for i in range(120):
        parts = [pool[k] if k < len(pool) else f"own {i} words {k} here." for k in rng.integers(0, len(pool) + 6, rng.integers(0, 9))]
        texts[i] = "".join(p + ("", " ", "\n", "\n\n", " \t\n ")[rng.integers(0, 5)] for p in parts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for run_words in (1, 12):
        got = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in line_dedup.line_dedup(df, unit="sentence", min_words=4, run_words=run_words).collect()}
        assert got == brute_sentences(texts, 4, run_words)


def test_sentence_runs_find_a_passage_within_lines(spark):
    passage = " ".join(f"Sentence {k} of the passage has these nine words." for k in range(8))
    data = [(1, f"The first begins\nand {passage} Then it ends."), (2, f"Here, amid a line, {passage} The rest of it.\nNew line."), (2, f"{passage}\nanother text"), (None, passage), (4, f"A document with one shared sentence only. {passage[:47]} And it stays."), (5, None), (6, "")]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in data], "doc_id long, text string, keep_id string, n_removed int")
    sentence = dict(unit="sentence", min_words=line_dedup.SENTENCE_WORDS, run_words=line_dedup.RUN_WORDS)
    got = {(r.doc_id, r.text) for r in line_dedup.line_dedup(df, **sentence).collect()}
    assert len(got) == len(data) and {data[0], data[3], data[4], data[5], data[6]} <= got
    cut = {t for i, t in got if i == 2}
    first = passage[: passage.index(".") + 1]
    assert cut == {f"Here, amid a line, {first} The rest of it.\nNew line.", f"{first}\nanother text"}
    assert line_dedup.line_dedup(df.limit(0), **sentence).count() == 0


# --- personal data


def test_surrogates_keep_format_gender_and_coreference():
    key = b"k"
    put = lambda t: "".join(_pieces(t, key))
    out = put("Mail Jo.Ann@Mail.com or JO.ANN@MAIL.COM, +1 (435) 555-2665 or +1 435-555-2665, card 4111 1111 1111 1111, at 93.144.223.50.")
    mails = re.findall(r"\S+@[\w.]+\w", out)
    assert mails[0] == mails[1].lower() and re.fullmatch(r"[a-z]{2}\.[a-z]{3}@[a-z]{8}\.example\.com", mails[0])
    one, two = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1 \d{3}-\d{3}-\d{4}", out)
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) and "555-2665" not in out
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", out)[1].replace(" ", "")
    assert card[0] == "4" and pii.luhn(card) and card != "4" + "1" * 15
    names = put("Mrs. Anna Smith met Mr. Smith, г-жа Анна Петрова and Herr Schmidt.")
    words = names.replace(".", "").replace(",", "").split()
    assert words[2] == words[5] != "Smith" and any(words[1].endswith(e) for e in pii.ENDINGS["LATIN"]["f"])
    assert pii.script(words[7]) == "CYRILLIC" and words[7] != "Анна"
    assert put("A clean text of 12 words, version 3.14 on 2024-01-02.") == "A clean text of 12 words, version 3.14 on 2024-01-02."


def test_the_quick_search_loses_no_name():
    for t in ["“Mr. Smith said", "„Herr Müller", "[Dr. Meyer", "—Mrs. Jones", "Prof./Dr. Meyer", "«Г-Н Иванов", "mRſ Jones", "Κύριος Νίκος"]:
        want = [(m.start, m.end, m.kind) for m in pii._in_line(t, 0)]
        assert want and [(m.start, m.end, m.kind) for m in pii.mentions(t)] == want
        assert [m.start for m in pii.mentions(t + " 1")] == [m.start for m in pii.mentions(t)]
    assert pii.mentions("Medr. Smith, a dr smith and the mr.") == []


def test_names_are_replaced_without_a_form_of_address_too():
    text = "Anna came.\nMrs. Anna Smith met “Mr. Smith”. Smith said: SMITH's blacksmith, smith, Smithson, a.Smith@mail.com."
    out = "".join(_pieces(text, b"k"))
    new = re.search(r"Mrs\. (\w+) (\w+) met", out)
    assert new[1] != "Anna" and out.startswith(f"{new[1]} came.") and f"“Mr. {new[2]}”. {new[2]} said: {new[2].upper()}'s blacksmith, smith, Smithson, " in out
    assert "Smith@" not in out


def test_short_addresses_of_eight_groups():
    found = lambda t: [(m.text, m.canonical) for m in pii.mentions(t) if m.kind == "ip6"]
    full = "2001:0db8:0000:0000:0000:0000:0000:0001"
    assert found("at 2001:db8::1, 2001:DB8:0:0:0:0:0:1: or host:2001:db8::1/64.") == [("2001:db8::1", full), ("2001:DB8:0:0:0:0:0:1", full), ("2001:db8::1", full)]
    assert found("::ffff:93.144.223.50 and fe80::") == [("::ffff:93.144.223.50", "0000:0000:0000:0000:0000:ffff:5d90:df32"), ("fe80::", "fe80" + ":0000" * 7)]
    assert found("std::vector1 face::add 12:30:45 1::2::3 ::") == []
    assert "93.144" not in "".join(_pieces("::ffff:93.144.223.50", b"k")) and "db8" not in "".join(_pieces("2001:db8::1", b"k"))


def _pieces(text, key):
    at = 0
    for m in pii.mentions(text):
        yield text[at : m.start]
        yield pii.written_as(pii.surrogate(key, m.kind, m.canonical), m.kind, m.text)
        at = m.end
    yield text[at:]


def test_surrogates_stay_distinct(spark, monkeypatch):
    texts = [f"call +1 (201) 555-{k:04d} or write u{k}@mail.com, host 10.0.{k // 250}.{1 + k % 250}" for k in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in pii.pseudonymise(df, b"k").orderBy("doc_id").collect()]
    for pattern in (r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\S+@[\w.]+\w", r"\d+\.\d+\.\d+\.\d+"):
        before, after = ([re.search(pattern, t)[0] for t in x] for x in (texts, out))
        assert len(set(after)) == len(set(before)) and not set(after) & set(before)


def test_surrogates_of_random_texts(spark):
    """Texts made of known entities: none stays, each has one surrogate wherever and however it is written, different ones differ, the rest is as it was."""
    rng = np.random.default_rng(11)
    number = lambda k: (f"212{k:03d}4567", lambda d: [f"+1 {d[:3]}-{d[3:6]}-{d[6:]}", f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"])
    kinds = {
        "mail": [[f"user{k}.x@mail{k % 3}.com", f"User{k}.X@mail{k % 3}.com"] for k in range(9)] + [["a" * 90 + "@mail.org"]],
        "phone": [make(d) for d, make in map(number, range(200, 209))],
        "card": [[f"4{k}11 1111 1111 1111", f"4{k}11-1111-1111-1111", f"4{k}11111111111111"] for k in range(5)],
        "key": [[f"{k:x}" * 40 + "0f1e" * 40] for k in range(3)],
        "name": [[f"Mr. {n}", f"Herr {n}"] for n in ("Smith", "Brown", "Novak", "Weber")],
    }
    plain = "and then of the all some words here".split()
    data, used = {}, {}
    for i in range(80):
        parts = []
        for _ in range(rng.integers(0, 12)):
            kind = list(kinds)[rng.integers(0, len(kinds))]
            e = int(rng.integers(0, len(kinds[kind])))
            forms = kinds[kind][e]
            parts += [str(rng.choice(plain)), (kind, e, str(rng.choice(forms)))]
        data[i], used[i] = "".join((p if isinstance(p, str) else p[2]) + " | " for p in parts), parts
    out = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(list(data.items()), "doc_id long, text string"), b"k").collect()}
    of = collections.defaultdict(set)
    for i, parts in used.items():
        got = out[i].split(" | ")[:-1] if parts else []
        assert len(got) == len(parts)
        for p, g in zip(parts, got, strict=True):
            if isinstance(p, str):
                assert p == g
            else:
                kind, e, form = p
                said = form.split()[-1] if kind == "name" else form
                same = g.split()[-1] if kind == "name" else g.lower() if kind == "mail" else re.sub(r"\W", "", g)[-10 if kind == "phone" else 0 :]
                assert said not in g and (kind == "mail" or [c.isalnum() for c in g] == [c.isalnum() for c in form] or kind == "name")
                of[kind, e].add(same)
    assert all(len(x) == 1 for x in of.values()) and len(set.union(*of.values())) == len(of)


def test_settling_resolves_collisions(spark):
    entities = spark.createDataFrame([("ssn", f"{k:03d}") for k in range(0, 900, 2)], "kind string, canonical string")
    from verdictmill.llm.common import Scratch

    again = {(r.kind, r.canonical): r.attempt for r in pii.settle(entities, b"k", Scratch(spark, "t")).collect()} or {}
    made = [pii.surrogate(b"k", "ssn", f"{k:03d}", again.get(("ssn", f"{k:03d}"), 0)) for k in range(0, 900, 2)]
    assert len(set(made)) == len(made) and not set(made) & {f"{k:03d}" for k in range(0, 900, 2)} and again


def test_pii_odd_rows(odd, empty):
    got = {(r.doc_id, r.text, r.n_entities) for r in pii.pseudonymise(odd, b"k").collect()}
    assert {(2, None, 0), (3, "", 0), (7, ODD[-1][1], 0)} <= got
    assert pii.pseudonymise(empty, b"k").count() == 0


# --- main text


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<div id="menu"><ul><li><a>One</a><li><a>Two</a></ul></div><article><h1>Title &amp; more</h1><p>First,  with <b>bold</b> text.<p>Second<br>para.
<div class="advert">Buy, now.</div><ul><li>item one<li>item two</ul><section class="comments"><p>A reader says, hello there, friends.</p></section></article>
<aside>Side, notes.</aside><div class="cookie-notice">We use cookies.</div><form><p>Name</p></form><script>var a = "<p>no</p>";</script><footer>&copy; all</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "Title & more\nFirst, with bold text.\nSecond para.\nitem one\nitem two"
    assert html_text.main_text("") == "" and html_text.main_text("plain, text") == "plain, text"
    assert html_text.main_text("<div><p>Only &#8364;5 &lt;b&gt; &nbsp; here, and there.</div>") == "Only €5 <b> here, and there."
    assert html_text.main_text("<p>a<!-- <p>no --> b <p title='x > y'>c") == "a b\nc"


def test_main_text_without_an_article_element():
    page = "<body><div class=x><div class=nav><a>Home</a> <a>About</a></div><div class=c><p>A long first paragraph, with commas, and stops. More of it.</p><p>Another long paragraph, again, with much to say. Indeed.</p><p>Short.</p></div><div class=footer>Foot</div></div></body>"
    assert html_text.main_text(page).split("\n") == ["A long first paragraph, with commas, and stops. More of it.", "Another long paragraph, again, with much to say. Indeed.", "Short."]


def test_main_text_keeps_what_stands_beside_most_of_it():
    long = "A long paragraph, with commas, and stops. More of it, and more. "
    body = "".join(f"<p>{long}{k}</p>" for k in range(12))
    want = [" ".join(f"{long}{k}".split()) for k in range(12)]
    lines = lambda page: html_text.main_text(page).split("\n")
    beside = lines(f"<body><nav><a>Home</a></nav><div><h1>The headline, of it all</h1><p>A lead, which is short.</p><div class=body>{body}</div><p>The end, at last.</p></div></body>")
    assert beside == ["The headline, of it all", "A lead, which is short.", *want, "The end, at last."]
    items = "".join(f"<li>Item {k}, with some words, and a stop.</li>" for k in range(60))
    listed = lines(f"<body><div><p>Before the list, a word.</p><ul>{items}</ul><p>After the list, a word.</p></div><footer>Foot</footer></body>")
    assert len(listed) == 62 and listed[0] == "Before the list, a word." and listed[-1] == "After the list, a word."
    two = lines(f"<body><main><article>{body}</article><article><p>Another, shorter, text. It counts too.</p></article></main></body>")
    assert two == [*want, "Another, shorter, text. It counts too."]
    for open_ in ("<body class=has-sidebar><article>", "<body><article class='post no-header'>", "<html class='menu no-ads'><body><main id=related><article>", "<body><div class='page with-sidebar'><article>"):
        assert lines(f"{open_}{body}</article><div class=sidebar>Side, notes.</div>") == want
    assert lines(f"<article><p>Short, but it is all.</p></article><div class=comments>{body}</div>") == ["Short, but it is all."]
    assert "x = 1" in html_text.main_text(f"<article>{body}<p>so <math><mi>x</mi> = <mn>1</mn></math>, as said.</p></article>")
    assert html_text.main_text(f"<body hidden>{body}") == ""


def test_main_text_of_the_pages(spark, small):
    import html

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.extract_main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|h2|div|ul|li)\b[^>]*>", body))
        text = "\n".join(filter(None, blocks))
        assert got[r.page_id] == (r.url, text, len(text))


def test_main_text_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 5), (None, "u", "<p>x", 6), (1, None, None, 5)], "page_id long, url string, html string, n_chars long")
    assert rows(html_text.extract_main_text(df)) == [(1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1)]
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_ratios_choose_the_nodes_where_no_element_tells(monkeypatch):
    links = "".join(f"<a href=/{k}>Topic {k}</a> " for k in range(9))
    body = "".join(f"<p>Paragraph {k} of the text, with commas, and stops. More of it, and more, and so on, to its end.</p>" for k in range(6))
    page = f"<body><div>{links}</div><div><h1>Headline</h1><div>{body}<ul><li>short</ul></div></div><div>{links}</div></body>"
    want = ["Headline", *(f"Paragraph {k} of the text, with commas, and stops. More of it, and more, and so on, to its end." for k in range(6)), "short"]
    assert html_text.main_text(page).split("\n") == want
    monkeypatch.setattr(html_text, "path_scores", lambda paths, texts, width=1.0: np.ones(len(paths)))
    assert len(html_text.main_text(page).split("\n")) == len(want) + 2


def test_ratios_cut_links_off_pages_without_semantic_elements(spark, small):
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        if len(html_text.main_text(r.html)) < 500:  # a few words do not differ from links
            continue
        plain = re.sub(r"</?(article|nav|footer)\b[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", r.html).replace('<div class="ad">', "<div>")
        lines, links = html_text.main_text(plain).split("\n"), re.findall(r"<li><a[^>]*>(.*?)</a></li>", r.html)
        assert set(html_text.main_text(r.html).split("\n")) <= set(lines) and len(set(lines) & set(links)) <= 1


def test_names_of_elements_exclude_only_what_they_say():
    body = "".join(f"<p>Paragraph {k}, with commas, and stops. More of it.</p>" for k in range(4))
    lines = lambda page: html_text.main_text(page).split("\n")
    assert "Of its history, a word." in lines(f"<article>{body}<div class=social-history><p>Of its history, a word.</p></div></article>")
    assert "Title" in lines(f"<body><header><h1>The site</h1></header><article><header><h1>Title</h1></header>{body}</article>")
    for name in ("side-bar sidebar", "cookieNotice", "site-nav", "page-footer-2", "commentList"):
        assert "Not this, please. No." not in lines(f"<article>{body}<div class='{name}'><p>Not this, please. No.</p></div></article>"), name


@pytest.mark.parametrize("page", ["<a x " * 200_000, '<a x="' * 150_000, "<div>" * 100_000 + "</b>" * 100_000, "<p><table><td>" * 30_000 + "<div>" * 50_000, "x" + "<br>" * 200_000, "<script>" + "</script x" * 100_000, "&#" + "9" * 100_000 + ";", "<!--" * 200_000])
def test_broken_pages_take_linear_time(page):
    import time

    began = time.perf_counter()
    assert len(html_text.main_text(page)) <= 1
    assert time.perf_counter() - began < 20


def test_no_depth_is_too_deep():
    page = "<article><p>Before, it, was. So it was.</p>" + "<div>" * 600 + "<nav>Menu, of, all</nav>" + "</div>" * 600 + "<p>After, it, is. So it is.</p></article>"
    assert html_text.main_text(page) == "Before, it, was. So it was.\nAfter, it, is. So it is."


# --- nearest neighbours


def test_neighbours_recall_and_order(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids = np.array(sorted(data))
    x = np.stack([data[i] for i in ids])
    got = collections.defaultdict(list)
    for r in ann.neighbours(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    assert sorted(got) == [i for i in ids if i % 100 == 0]
    for q, found in got.items():
        d = np.sqrt(((x - data[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        true = ids[np.lexsort((ids, d))[:10]]
        hits += len(set(true) & {v for _, v, _ in found})
        assert [k for k, _, _ in found] == list(range(1, 11)) and all(d[ids == v][0] == s for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
    assert hits >= 0.9 * 10 * len(got)


def test_neighbours_with_clashing_columns(spark):
    df = spark.createDataFrame([(k, [float(k), 1.0], 7, "x", 0.5) for k in (0, 1, 2, 100)], "vec_id long, embedding array<double>, rank int, query_id string, score double")
    assert rows(ann.neighbours(df)) == rows(ann.neighbours(df.select("vec_id", "embedding"))) and ann.neighbours(df).count() == 6


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0]), (3, [0.0, 3.0])]
    bad = [(200, None), (300, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (8, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    got = rows(ann.neighbours(df))
    far = 10**0.5
    assert got == sorted([(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 2, far), (0, 4, 3, far), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, far), (100, 4, 3, far)], key=str)
    assert ann.neighbours(df.limit(0)).count() == 0


def test_walk_is_by_ascending_distance():
    rng = np.random.default_rng(2)
    books = ann.Codebooks(rng.normal(size=(7, 3)), rng.normal(size=(5, 2)))
    q = rng.normal(size=5)
    cost = lambda c: ((books.left[c // 5] - q[:3]) ** 2).sum() + ((books.right[c % 5] - q[3:]) ** 2).sum()
    walk = list(books.walk(q))
    assert sorted(walk) == list(range(35)) and [cost(c) for c in walk] == sorted(cost(c) for c in walk)


# --- quality


def direct_kneser_ney(texts, order):
    """The model by its definition, as a function from (context, character) to probability."""
    pad = "\x02" * (order - 1)
    top = collections.Counter()
    for t in texts:
        s = pad + kneser_ney.clean(t)
        for i in range(order - 1, len(s)):
            top[s[i - order + 1 : i + 1]] += 1
    levels = {order: top}
    for n in range(order - 1, 0, -1):
        levels[n] = collections.Counter(g[1:] for g in levels[n + 1])
    discounts, sums, follow = {}, {}, {}
    for n, level in levels.items():
        c = [sum(v == k for v in level.values()) for k in range(5)]
        d = []
        for k in (1, 2, 3):
            value = k - (k + 1) * c[1] / (c[1] + 2 * c[2]) * c[k + 1] / c[k] if all(c[1:]) else -1
            d.append(value if 0 < value < k else k / 2)
        discounts[n] = d
        sums[n], follow[n] = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
        for g, v in level.items():
            sums[n][g[:-1]] += v
            follow[n][g[:-1]][min(v, 3) - 1] += 1
    size = len(levels[1]) + 1

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / size
        lower = p(g[1:])
        if g[:-1] not in sums[n]:
            return lower
        c, d = levels[n].get(g, 0), discounts[n]
        own = max(c - d[min(c, 3) - 1], 0) if c else 0
        return (own + sum(x * y for x, y in zip(d, follow[n][g[:-1]], strict=True)) * lower) / sums[n][g[:-1]]

    return p


@pytest.mark.parametrize("shard_entries", [10**6, 400])
def test_perplexity_is_that_of_the_definition(spark, texts, shard_entries):
    order = 4
    docs = [(i, t[:400], "en") for i, t in list(texts.items())[:40]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in docs[:30]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.n_chars_scored, r.perplexity) for r in kneser_ney.classify(df, labels, order=order, shard_entries=shard_entries).collect()}
    held = {r.id for r in spark.range(40).filter(F.pmod(F.xxhash64("id"), F.lit(kneser_ney.HELD_OUT)) == 0).collect()}
    p = direct_kneser_ney([t for i, t, _ in docs[:30] if i not in held], order)
    for i, t, _ in docs:
        s = "\x02" * (order - 1) + kneser_ney.clean(t)
        logs = [np.log(p(s[k - order + 1 : k + 1])) for k in range(order - 1, len(s))]
        assert got[i][0] == len(logs) and got[i][1] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-4)


def test_probabilities_sum_to_one(texts):
    sample = list(texts.values())[:20]
    p = direct_kneser_ney([t[:300] for t in sample], 3)
    letters = {c for t in sample for c in kneser_ney.clean(t[:300])}
    assert sum(p("e " + c) for c in letters) + p("e \x00") == pytest.approx(1)


def test_classifier_keeps_good_and_rejects_junk(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = kneser_ney.classify(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in got.collect()}
    assert kept[1] > 0.98 and kept[0] < 0.2


def test_classifier_judges_small_languages_and_repetition(spark, texts):
    rng = np.random.default_rng(4)
    pool = [t for t in texts.values() if 300 < len(t) < 4000 and len(set(t.split())) > 0.5 * len(t.split())][:60]
    data = [(i, pool[i % len(pool)][:1500] + f" {i}", "en") for i in range(200)]
    noise = ["".join(chr(k) for k in rng.integers(33, 1000, 600)) for _ in range(4)]
    word = pool[0].split()[0]
    data += [(1000 + k, t, lang) for k, (t, lang) in enumerate(zip(noise, ("en", "rare", None, "rare"), strict=True))]
    data += [(2000 + k, t, lang) for k, (t, lang) in enumerate([(" ".join([word] * 300), "en"), (" ".join([word, "and"] * 300), "rare"), (pool[1][:1500], "rare"), (pool[2][:1500], None)])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in kneser_ney.classify(spark.createDataFrame(data, "doc_id long, text string, lang string"), labels, order=3).collect()}
    assert len(got) == len(data) and not any(got[1000 + k] for k in range(4))
    assert [got[2000 + k] for k in range(4)] == [False, False, True, True]


def test_classifier_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, None), (None, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.kept) for r in kneser_ney.classify(odd, labels).collect()}
    assert {(2, False), (3, False), (4, False), (7, True)} <= got
    assert kneser_ney.classify(odd, labels).count() == len(ODD)
    assert kneser_ney.classify(empty, labels).count() == 0 and kneser_ney.classify(odd, labels.limit(0)).filter("kept").count() == len(ODD) - 3
    assert kneser_ney.drop_rejected(odd, labels).columns == odd.columns


def test_quality_stage_judges_rows_of_one_id_by_themselves(spark, texts):
    pool = [t for t in texts.values() if 300 < len(t) < 4000 and len(set(t.split())) > 0.5 * len(t.split())][:40]
    junk = "".join(chr(k) for k in np.random.default_rng(4).integers(33, 1000, 600))
    data = [(i, pool[i % len(pool)][:1500] + f" {i}", "en") for i in range(200)] + [(250, junk, "en"), (250, pool[1][:1500], "en"), (None, junk, "en"), (None, pool[0][:1500], "en"), (300, junk, None), (None, None, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(*r, 0.5) for r in data], "doc_id long, text string, lang string, perplexity double")
    out = kneser_ney.drop_rejected(df, labels, order=3)
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == df.columns and got[(250, pool[1][:1500])] == 1 and got[(None, pool[0][:1500])] == 1
    assert not any(got[x] for x in [(250, junk), (None, junk), (300, junk), (None, None)])
    assert kneser_ney.drop_rejected(df.limit(0), labels).count() == 0
