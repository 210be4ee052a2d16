"""Loaders, provenance, registers, blocks, routing, weaving and large bootstraps against hand-worked cases."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from verdictmill.functions import rates as forms
from verdictmill.operators import calibration, casefiles, conversations, documents, generate, guards, inference, provenance, resample, routing
from verdictmill.sources import keys


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_keys_with_includes_and_rejects(spark, tmp_path):
    (tmp_path / "big").mkdir()
    (tmp_path / "one.yaml").write_text("version: 2\nshould_fire:\n- {id: a, turn: go}\n")
    (tmp_path / "big" / "index.yaml").write_text("version: 3\ninclude: [part.yaml]\nshould_fire:\n- {id: a, turn: go}\n")
    (tmp_path / "big" / "part.yaml").write_text("should_not_fire:\n- {id: b, turn: stop}\n- {id: b, turn: stop}\n")
    (tmp_path / "bad.yaml").write_text("- a list\n")
    (tmp_path / "lost").mkdir()
    (tmp_path / "lost" / "index.yaml").write_text("include: [gone.yaml]\n")
    cases, issues, rejects = keys.load_keys(spark, str(tmp_path))
    assert {(r.key, r.id, r.set_version) for r in cases.collect()} == {("one.yaml", "a", 2), ("big/index.yaml", "a", 3), ("big/index.yaml", "b", 3)}
    assert {tuple(r) for r in issues.collect()} == {("big/index.yaml", "b", "duplicate id")}
    assert {r.key: r.message for r in rejects.collect()} == {"bad.yaml": "no mapping", "lost/index.yaml": "includes gone.yaml, which is not there"}
    (tmp_path / "p.toml").write_text('[tool.x.versions]\n"a.jsonl" = 2\n')
    assert [tuple(r) for r in keys.load_declared_versions(spark, str(tmp_path / "p.toml"), "tool.x.versions").collect()] == [("a.jsonl", 2)]
    assert keys.load_declared_versions(spark, str(tmp_path / "p.toml"), "tool.y.versions").count() == 0


def test_templates_casefiles_documents_and_lock(spark, tmp_path):
    for name in ("t", "c", "e"):
        (tmp_path / name).mkdir()
    good = "template_id: {0}\nquestion: Q\noptions: [x, 'no']\nsolution: \"'x'\"\nvariables: {{n: 3}}\nrelevant_facts:\n- {{id: f, text: T}}\n"
    (tmp_path / "t" / "b.yaml").write_text(good.format("b"))
    (tmp_path / "t" / "a.yaml").write_text(good.format("a"))
    got = keys.load_templates(spark, str(tmp_path / "t")).collect()
    assert [r.template_id for r in got] == ["a", "b"] and got[0].facts[0].text == "T" and got[0].options == ["x", "no"]
    (tmp_path / "t" / "z.yaml").write_text(good.format("y"))
    with pytest.raises(ValueError, match="not the file's name"):
        keys.load_templates(spark, str(tmp_path / "t"))
    (tmp_path / "c" / "k.yaml").write_text("case_id: k\ntrap_order: 2\ndocuments:\n- {id: D1, body: text}\nconditions:\n- {id: C1, source: D1, governs: true}\nactions:\n- {id: A1, status: required}\n- {id: A2, status: prohibited, failure_kind: trap}\n- {id: A3, status: prohibited, failure_kind: unjustified}\nexposure: {band: high}\n")
    (tmp_path / "c" / "n.md").write_text("# Note\n")
    cases = keys.load_casefiles(spark, str(tmp_path / "c"))
    assert cases.count() == 1 and casefiles.validate(cases).count() == 0
    assert {tuple(r) for r in keys.read_documents(spark, str(tmp_path / "c")).collect()} == {("n", "# Note\n"), ("k:D1", "text")}
    (tmp_path / "lock.json").write_text('{"repo": "r", "commit": "c",\n "member": "m", "size_bytes": 3, "sha256": "00", "code_license": "x", "data_license": "y", "retrieved": "2026"}')
    assert keys.load_lock(spark, str(tmp_path / "lock.json")).first().size_bytes == 3
    (tmp_path / "less.json").write_text('{"repo": "r"}')
    with pytest.raises(guards.Refused):
        keys.load_lock(spark, str(tmp_path / "less.json"))


def test_runs_are_found_by_place(spark, tmp_path):
    for p in ("skill/2026-01-02-abcdef1-x", "skill/odd", "other/2026-01-03-abcdef2"):
        (tmp_path / p).mkdir(parents=True)
    (tmp_path / "skill" / "file").write_text("")
    assert [r.name for r in provenance.discover_runs(spark, str(tmp_path)).collect()] == ["2026-01-03-abcdef2", "2026-01-02-abcdef1-x", "odd"]
    assert provenance.discover_runs(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "claims.json").write_text('{"claims": [{"id": "a", "value": "1", "source": "s", "quote": "q", "why": "w", "latest": "2"}, {"id": "b"}], "retractions": [{"phrase": "p", "source": "s", "quote": "q", "why": "w"}]}')
    claims, gone = documents.load_claims(spark, str(tmp_path / "claims.json"))
    assert [(r.id, r.latest, r.rounded) for r in claims.collect()] == [("a", "2", None)] and gone.count() == 1


BLOCKS = {
    "one\ntwo\n\nthree": [1, 4],
    "# head\ntext\n***\nmore": [1, 2, 3, 4],
    "- a\n  b\n- c\ntail": [1, 3],
    "1. a\n2. b\ntext\n7. not an item": [1],
    "text\n1. item": [1, 2],
    "7. item after nothing\n\n8. and after a blank": [1, 3],
    "Lead\nHead | x\n--|--\na | b\n| c | d |\n\nend": [1, 2, 3, 4, 5, 7],
    "a | b\n\nc | d\nno table": [1, 3],
    "| a |\n- b | c\n# d | e\nf": [1, 2, 3, 4],
    "```\na\n\n- b\n```\nafter": [1, 6],
    "```\na\n\nb": [1, 4],
    "~~~~\nx\n```\n~~~\ny\n~~~~": [1],
    "text\n```\n# no\n```\n```\nz\n```": [1, 2, 5],
    "> quoted\n> more\n>\n> last": [1, 4],
    "> - a\n> - b": [1, 2],
    "text\n[ref]: http://x\nnext": [1, 2],
    "a\r\nb\r\n\r\nc\r\n": [1, 4],
    "": [],
}


def test_blocks_of_markdown(spark):
    texts = list(BLOCKS)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (99, None)]  # a repeated row is a document of its own
    got = documents.markdown_blocks(spark.createDataFrame(rows, "path int, text string"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    found = collections.defaultdict(list)
    for r in got.collect():
        found[int(r.path)].append((r.line, r.block))
    assert sorted(found.pop(0)) == [(1, "one\ntwo"), (1, "one\ntwo"), (4, "three"), (4, "three")] and 99 not in found
    for i, t in enumerate(texts[1:], 1):
        assert [line for line, _ in sorted(found[i])] == BLOCKS[t], t
    assert sorted(found[texts.index("> quoted\n> more\n>\n> last")]) == [(1, "> quoted\n> more"), (4, "> last")]
    assert sorted(found[texts.index("```\na\n\n- b\n```\nafter")])[0] == (1, "```\na\n\n- b\n```")


def test_blocks_of_a_long_text(spark):
    text = "\n".join(f"- item {k}\n  goes on\n" for k in range(20_000))
    got = documents.markdown_blocks(spark.createDataFrame([("a", text)], "path string, text string"))
    assert got.count() == 20_000 and got.orderBy(F.desc("line")).first().block == "- item 19999\n  goes on"


def test_percents_and_quote_fields(spark):
    bib = spark.createDataFrame([("b", "@misc{a,\n note = {1\\% and 2%\n {3%}},\n quote_text = {x}\n}\n")], "path string, text string")
    assert [(r.name, r.line, r.arxiv) for r in documents.bare_percents(bib).collect()] == [("note", 2, "-"), ("note", 3, "-")]
    assert [(r.name, r.line) for r in documents.unknown_quote_fields(bib).collect()] == [("quote_text", 4)]


def test_weaving_aims_at_the_middle_of_each_slice(spark):
    def plain(core, padding, low=0.3, high=0.6):
        """From the running sizes: so much padding stands before a core document as fits below its target beside the core before it."""
        sizes = lambda docs: [0, *itertools.accumulate(len(d) + 1 for d in docs)]
        cores, pads = sizes(core), sizes(padding)
        total, out, before = cores[-1] + pads[-1], [], 0
        for i, d in enumerate(core):
            target = total * (low + (high - low) * (2 * i + 1) / (2 * len(core)))
            n = max(before, sum(cores[i] + p <= target for p in pads[1:]))
            out += [*padding[before:n], d]
            before = n
        return out + padding[before:]

    for core, padding in ((["core"], ["p" * n for n in (3, 9, 4, 20, 5)]), (["a" * 40, "b"], ["q" * n for n in (7, 7, 7, 7)]), (["x", "y", "z"], [])):
        got = value(spark, generate.weave(F.array(*map(F.lit, core)), F.array(*map(F.lit, padding)) if padding else F.array().cast("array<string>")))
        assert got == plain(core, padding)
    assert value(spark, generate.ablate(F.array(F.lit("p")), F.lit("Q?"), "==")) == "p\n\n\n==\n\nQ?\n"


def test_variants_and_groups_of_entries(spark):
    with pytest.raises(Exception, match="unknown variant"):
        value(spark, routing.description_variant(F.lit("a. b"), F.lit("x"), ".", "b", {}))
    assert value(spark, routing.description_variant(F.lit("a b"), F.lit("no-opener"), ".", "Do not", {})) is None
    entries = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "name string, product string")
    groups = lambda *g: spark.createDataFrame(list(enumerate(g)), "group int, names array<string>")
    assert {tuple(r) for r in routing.grouped_entries(groups(["b", "a"], ["c"]), entries).collect()} == {(0, "b-a", "y; x"), (1, "c", "z")}
    for g in ((["a", "b"], []), (["a", "b", "c"], ["a"]), (["a", "b"],), (["a", "b", "c", "d"],)):
        with pytest.raises(guards.Refused):
            routing.grouped_entries(groups(*g), entries).count()


def test_refusals_of_conversations(spark):
    task = lambda t, p: spark.createDataFrame([("1", t, p)], "task_id string, task string, payload string")
    assert conversations.full_instruction(task("actions", '{"fully_specified_question": [[{"content": " go "}]]}')).first().instruction == "go"
    for t, p in (("code", "{}"), ("math", '{"question": " "}'), ("actions", '{"fully_specified_question": [{"content": "a"}, {"content": "b"}]}')):
        with pytest.raises(guards.Refused):
            conversations.full_instruction(task(t, p))
    with pytest.raises(guards.Refused):
        conversations.task_context(task("database", "{}"))
    nodes = spark.createDataFrame([("t", "n", 1, "x")], "conversation_id string, node_name string, at int, response string")
    with pytest.raises(guards.Refused):
        conversations.final_responses(nodes)
    pins = spark.createDataFrame([("t", "b", None)], "conversation_id string, node_name string, report string")
    with pytest.raises(guards.Refused):
        conversations.pinned_dispatches(spark.createDataFrame([("t", "a"), ("t", "b")], "conversation_id string, node_name string"), pins, "a")


def test_many_clusters_are_weighted_in_one_pass(spark, monkeypatch):
    rows = spark.range(20_000).select((F.col("id") % 5000).alias("c"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("v"))
    ends = lambda scheme: resample.interval(resample.replicate_means(rows, "v", "c", 300, 5, scheme)).first()
    a, b = ends("poisson"), ends("draws")
    assert abs(a.low - b.low) < 0.003 and abs(a.high - b.high) < 0.003 and 0.8 < a.se / b.se < 1.25
    monkeypatch.setattr(resample, "BROADCAST_CLUSTERS", 10)
    assert ends("draws") == pytest.approx(b)  # joined by shuffle, the same draws
    with pytest.raises(ValueError):
        ends("other")
    u = [0.0, 0.36, 0.37, 0.73, 0.74, 0.919, 0.92, 0.99]
    assert [value(spark, resample.poisson_weight(F.lit(x))) for x in u] == [0, 0, 1, 1, 2, 2, 3, 4]
    plan = resample.replicate_means(rows, "v", "c", 300, 5, "poisson")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_false_discovery_over_many_parts(spark):
    import random

    rng = random.Random(3)
    p = [round(rng.random() ** 3, 3) for _ in range(700)]
    got = {r.key: (r.rank, r.q_value, r.rejected) for r in inference.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "key long, p double")).collect()}
    order = sorted(range(700), key=lambda k: (p[k], k))
    least = 1.0
    for rank in range(700, 0, -1):
        k = order[rank - 1]
        least = min(least, p[k] * 700 / rank)
        assert got[k][0] == rank and got[k][1] == pytest.approx(least) and got[k][2] == (least <= 0.1)


def test_smooth_calibration_is_that_of_all_pairs(spark):
    import numpy as np

    for n, bandwidth in ((40, None), (3000, None), (3000, 0.004), (500, 0.25)):
        rows = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 10**9).alias("f"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))).cast("double").alias("o")).unionByName(spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "f double, o double"))
        f, o = np.array([tuple(r) for r in rows.collect()]).T
        f = f.round(12)
        h = bandwidth or max(0.01, min(0.25, len(f) ** (-1 / 3)))
        k = np.exp(-0.5 * ((f[:, None] - f[None]) / h) ** 2)
        assert calibration.smooth_calibration_error(rows, bandwidth).first().smooth_ce == pytest.approx(np.abs(k @ o / k.sum(1) - f).mean(), abs=1e-11)


def test_power_grid_and_bounds(spark):
    grid = {(r.pairs, round(r.discordant, 2)): r.effect for r in forms.power_grid(spark).collect()}
    assert len(grid) == 30 and grid[(1600, 0.1)] < grid[(100, 0.1)] and grid[(50, 0.05)] is None
    assert value(spark, forms.within(F.lit(0.5), 0.4, 0.6)) and value(spark, forms.clustering_is_inert(F.lit(40), F.lit(40)))


def test_calibration_needs_ten_forecasts(spark):
    few = spark.createDataFrame([(0.5, True, True)] * 9, "p_fire double, fired boolean, should_fire boolean")
    assert calibration.calibration_report(few).first().brier is None and calibration.calibration_report(few.union(few)).first().brier == 0.25


def test_corpus_check_puts_everything_together(spark):
    from verdictmill.operators import corpus

    rows = []
    for k in range(12):
        body = f"A body of case {k} that all members of it begin with, word for word.\n"
        rows += [(f"{k}p", str(k), "m", True, body + "Should I go there now? " * 10), (f"{k}a", str(k), "m", False, body + "They went there then. " * 10), (f"{k}b", str(k), "m", False, body + "They came back again. " * (11 if k else 40))]
    df = spark.createDataFrame(rows, "id string, triple string, band string, should_fire boolean, turn string")
    got = {r.key for r in corpus.check_corpus(df).collect()}
    assert "leak:turn:question_marks" in got and "matched:turn:question_marks" in got and "stump" in got and "0b" in got and "0" in got
    assert any(k.startswith("inert:") for k in got) and "m" not in got


def test_complete_ratings(spark):
    from verdictmill.operators import agreement

    make = lambda rows: spark.createDataFrame(rows, "unit int, rater int, label string")
    good = [(u, k, "a") for u in range(3) for k in range(2)]
    assert agreement.complete(make(good)).count() == 6
    for bad in (good + [(0, 2, "a")], good[:-1] + [(2, 1, None)], [(0, 0, "a"), (1, 0, "a")]):
        with pytest.raises(guards.Refused):
            agreement.complete(make(bad))


def test_fingerprint_is_a_tree_over_places(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(i // 2, f"text {i}") for i in range(20_000)]  # every place twice
    df = spark.createDataFrame(rows, "k long, text string")
    nodes = [d for _, d in sorted((k, sha(f"{k}\x1f{t}")) for k, t in rows)]
    for _ in range(3):
        nodes = [sha("".join(nodes[a : a + 2])) for a in range(0, len(nodes), 2)]
    want = sha("".join(nodes))
    first = provenance.corpus_fingerprint(df, "k", "k", "text", fanout=2).first()
    assert (first.fingerprint, first.n) == (want, 20_000)  # 10,000 nodes in the lowest level
    assert provenance.corpus_fingerprint(df.repartition(7), "k", "k", "text", fanout=2).first() == first
    assert provenance.corpus_fingerprint(df.withColumn("text", F.when(F.col("k") == 77, "x").otherwise(F.col("text"))), "k", "k", "text", fanout=2).first().fingerprint != want
    assert tuple(provenance.corpus_fingerprint(df.limit(0), "k", "text").first()) == (sha(""), 0)


# --- gates, candidates, sinks and state


def test_balanced_objects_mind_strings_and_escapes(spark):
    from verdictmill.functions import parsing

    cases = {
        '{"a": {"b": 1}} x {"c": 2}': ['{"a": {"b": 1}}', '{"b": 1}', '{"c": 2}'],
        'say " and {"a": "} \\" }"} end': ['{"a": "} \\" }"}'],  # outside of objects a quote is prose
        "} {": [],
        "": [],
        '{"open": {"x": 1}': ['{"x": 1}'],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("o", parsing.balanced_objects(F.col("t")))
    for row in df.collect():
        assert [row.t[o.first : o.last + 1] for o in row.o] == cases[row.t], row.t
    depths = spark.createDataFrame([('{"a": {"b": {}}}',)], "t string").select(parsing.balanced_objects(F.col("t")).alias("o")).first().o
    assert [o.depth for o in depths] == [1, 2, 3]


def test_the_first_candidate_with_a_decision_wins(spark):
    from verdictmill.functions import parsing

    cases = [
        ('{"decision": true}', True, True),
        ('Well: {"decision": false, "why": "x"} so', False, False),
        ('{"decision": "yes"} or {"decision": true}', True, True),
        ('{"decision": true, "of": {"x": 1}} since {the phrasing}', None, True),
        ('{"decision": 1}', None, None),
        ("[1, 2]", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(t,) for t, *_ in cases], "t string")
    got = df.select(parsing.boolean_decision(F.col("t")).alias("a"), parsing.boolean_decision(F.col("t"), nested=True).alias("b")).collect()
    assert [tuple(r) for r in got] == [tuple(c[1:]) for c in cases]
    told = spark.createDataFrame([('{"verdict": "real", "confidence": 1.2}',), ('{"verdict": "real", "confidence": "0.5"}',), ('{"verdict": "odd"} {"verdict": "real", "confidence": 0.5}',)], "t string").select(parsing.judged(F.col("t"), ["real", "made"]).alias("j")).collect()
    assert [tuple(r.j) for r in told] == [("real", None), ("real", None), ("real", 0.5)]


def test_case_is_folded(spark):
    from verdictmill.functions import calls, parsing

    answer = spark.createDataFrame([("ANSWER: STRASSE",), ("ANSWER: straße",), ("ANSWER: ﬁsh",)], "t string").select(parsing.parse_answer(F.col("t"), F.array(F.lit("Straße"), F.lit("FISH"))).alias("a")).collect()
    assert [r.a.value for r in answer] == ["Straße", "Straße", "FISH"]
    reply, key = '[{"name": "go", "arguments": {"to": "STRASSE"}}]', '[{"go": {"to": ["Straße"]}}]'
    assert spark.range(1).select(calls.match_calls(F.lit(reply), F.lit(key)).alias("m")).first().m == "matched"
    dotless = spark.range(1).select(parsing.normalise(F.lit("ı")).alias("a"), parsing.normalise(F.lit("I")).alias("b")).first()
    assert dotless.a == "ı" and dotless.b == "i"


def test_numbers_of_claims(spark):
    from verdictmill.operators import gates

    rows = [
        ("fine", "~4.5%", "rate **~4.5%** of all", "rate ~4.5% of all", r"rate (~[\d.]+%)", "~4%"),
        ("half up", "5.5", "is 5.5", "is 5.5", None, "6"),
        ("half down", "4.5", "is 4.5", "is 4.5", None, "5"),
        ("places", "2.346", "is 2.346", "is 2.346", None, "2.35"),
        ("wrong places", "2.346", "is 2.346", "is 2.346", None, "2.34"),
        ("thousands", "4,240", "is 4,240", "is 4,240", None, "4240"),
        ("negative", "-1.26", "is -1.26", "is -1.26", None, "-1.3"),
        ("no number", "many", "is many", "is many", None, "3"),
        ("not quoted", "7", "is 8", "is 8", None, None),
        ("superseded", "7", "is 7", "is 7; then is 8", r"is (\d)", None),
        ("no match", "7", "is 7", "is 7", r"was (\d)", None),
        ("bare pattern", "7", "is 7", "is 7 then 9", r"\d", None),
        ("twice", "7", "is 7", "is 7, is 7", None, None),
    ]
    df = spark.createDataFrame(rows, "claim_id string, value string, quote string, source_text string, latest string, rounded string")
    got = {r.claim_id: r.message for r in gates.claim_findings(df).collect()}
    assert got == {"half down": "wrongly rounded", "wrong places": "wrongly rounded", "no number": "rounded is no number", "not quoted": "value not in quote", "superseded": "superseded by 8", "no match": "no match of the pattern for later figures", "bare pattern": "superseded by 9", "twice": "quote found more than once"}


def test_closure_of_many_levels(spark):
    from verdictmill.operators import gates, integrity

    n = 60
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("src"), F.lit(5).cast("long").alias("dst")))
    got = integrity.reachable(edges, spark.range(1))
    assert {(r.id, r.depth) for r in got.collect()} == {(k, k) for k in range(n + 1)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1  # one scan, whatever the depth
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    told = gates.wiring_findings(ids(1, 2, 99, 98), edges.filter("src < 4"), ids(0), ids(98, 3, 97))
    assert {tuple(r) for r in told.collect()} == {("99", "has a floor and no caller"), ("3", "declared unwired and reached")}


def test_runs_that_may_not_start(spark):
    import hashlib

    from verdictmill.operators import gates

    sha = hashlib.sha256(b"x").hexdigest()
    rows = [("a", True, "x", sha, "x", sha, 0.2, 0.2, 0.9, 5.0, 5.0), ("b", None, "y", sha, "x", None, None, 0.2, 0.9, 5.0, 5.1)]
    df = spark.createDataFrame(rows, "run string, committed boolean, skill string, skill_sha256 string, analysis string, analysis_sha256 string, baseline double, low double, high double, budget double, cost double")
    assert [r.key for r in gates.run_findings(df).collect()] == ["b"] * 5
    assert gates.assert_runnable(df.filter("run = 'a'")).count() == 1
    with pytest.raises(guards.Refused):
        gates.assert_runnable(df)


def test_phase_result_needs_a_passed_battery(spark):
    from verdictmill.operators import movement

    events = spark.createDataFrame([(f"t{k}", 1.0, 2.0, 1.0 + 0.6 * (k % 4 == 0)) for k in range(40)], "triplet_id string, q_base double, q_governing double, q_matched double")
    half, passed = spark.createDataFrame([(0.5,)], "threshold double"), spark.createDataFrame([(True,)], "passed boolean")
    got = movement.phase_result(events, half, passed, 100, 1).first()
    assert got.j == pytest.approx(0.75) and got.kill and "both arms" in got.disposition
    for bad in (passed.select(F.lit(False).alias("passed")), passed.limit(0), passed.select(F.lit(None).cast("boolean").alias("passed"))):
        with pytest.raises(guards.Refused):
            movement.phase_result(events, half, bad, 100, 1)


def test_a_killed_batch_is_appended_once(spark, tmp_path, monkeypatch):
    from verdictmill.streaming import sinks

    path, schema = str(tmp_path / "log"), "k long, v string"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema)
    commit = sinks._commit
    monkeypatch.setattr(sinks, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        sinks.append_once(rows, path, ["k"], "0")
    assert sinks.read_appended(spark, path, schema).count() == 0  # what the attempt left is not read
    monkeypatch.setattr(sinks, "_commit", commit)
    assert sinks.append_once(rows, path, ["k"], "0") and not sinks.append_once(rows, path, ["k"], "0")
    assert sinks.append_once(spark.createDataFrame([(2, "again"), (3, "c")], schema), path, ["k"], "1")
    assert sorted(map(tuple, sinks.read_appended(spark, path, schema).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_stream_is_appended_once(spark, tmp_path):
    from verdictmill.streaming import sinks

    schema, source = "k long, v string", str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.json(source)
    run = lambda: sinks.append_stream(spark.readStream.schema(schema).json(source), str(tmp_path / "out"), ["k"], str(tmp_path / "state"))
    run()
    spark.createDataFrame([(2, "b"), (3, "c")], schema).write.mode("append").json(source)
    run()
    run()
    assert sorted(r.k for r in sinks.read_appended(spark, str(tmp_path / "out"), schema).collect()) == [1, 2, 3]


def test_a_run_keeps_its_stamp(spark, tmp_path):
    from verdictmill.streaming import sinks

    schema, source, state = "run string, at long, version long, fingerprint string", str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([("same", 1, 1, "f"), ("same", 2, 1, "f"), ("moved", 1, 1, "f"), ("again", 2, 1, "g"), ("again", 1, 1, "f")], schema).write.parquet(source)
    resume = lambda: {r.run: r for r in sinks.resume(spark.readStream.schema(schema).parquet(source), "run", "at", ["version", "fingerprint"], state).collect()}
    first = resume()
    assert {k: r.refused for k, r in first.items()} == {"same": False, "moved": False, "again": True}  # two stamps at once
    spark.createDataFrame([("same", 3, 1, "f"), ("moved", 2, 1, "other"), ("new", 1, 2, None)], schema).write.mode("append").parquet(source)
    second = resume()  # the state of the first half is still known
    assert {k: r.refused for k, r in second.items()} == {"same": False, "moved": True, "again": True, "new": False}
    assert second["moved"].begun == first["moved"].begun and second["same"].rows == 3
    some = spark.createDataFrame([(True,)], "refused boolean")
    with pytest.raises(guards.Refused):
        sinks.require_resumable(some)


def test_corpus_check_is_the_union_of_its_parts(spark):
    from verdictmill.operators import corpus

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefg", k=5))
    rows = [(3 * k + j, f"t{k}", "s", j == 0, " ".join(word() for _ in range(8)) + (" please!" if j == 0 else ".")) for k in range(30) for j in range(3)]
    turns = spark.createDataFrame(rows, "id long, triple string, band string, should_fire boolean, turn string")
    found = {r.key for r in corpus.check_corpus(turns).collect()}
    assert "stump" in found and any(k.startswith("leak:") for k in found)
    assert not any(r.key == "stump" for r in corpus.stump_findings(corpus.featured(turns.select("id", "should_fire", "turn"), "turn", corpus.FEATURES), list(corpus.FEATURES), "should_fire", "id", max_lift=0.5).collect())
    assert corpus.MAX_LIFT == 0.10


def test_trigger_sets_with_a_baseline(spark):
    from verdictmill.operators import gates

    rows = lambda shape, *x: spark.createDataFrame(list(x), shape)
    skills, sets = rows("skill string", ("a",), ("b",), ("c",)), rows("name string, skill string, error string", ("a", "a", None), ("b", None, None), ("z", "z", None))
    cases = rows("name string, should_fire boolean", ("a", True), ("a", False), ("b", True), ("b", None))
    found = rows("key string, message string", ("known", "k"), ("new", "n"))
    none = rows("key string, message string", ("x", "x")).limit(0)
    got = gates.check_trigger_sets(skills, sets, cases, rows("key string, message string", ("b", "length")), none, found, rows("key string", ("known",), ("gone",)))
    assert sorted(map(tuple, got.collect())) == sorted([("c", "no trigger set"), ("z", "a set of no skill"), ("b", "declares no skill"), ("b", "no negative cases"), ("b", "length"), ("new", "n"), ("gone", "in the baseline and no longer found")])
