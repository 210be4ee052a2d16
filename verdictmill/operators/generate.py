"""Table-valued generation: seeds, strata, arrangements, partitions, draws, stratified samples, padding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import compile_expression
from ..functions.text import let
from .guards import require
from .ranks import running
from .resample import draw


def derive_seed(template: Column, seed: Column, variant: Column) -> Column:
    """The first eight bytes of SHA-256 of ``template:seed:variant`` as a number (up to 20 digits, as text)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", template, seed.cast("string"), variant.cast("string")), 256), 1, 16), 16, 10)


def strata(spark: SparkSession, counts: Sequence[int], positions: Sequence[str]) -> DataFrame:
    """(n_distractors, position): the product, with one row for no distractors, which have no position."""
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, counts))).alias("n_distractors")).withColumn("position", F.explode(F.array(*map(F.lit, positions))))
    return grid.withColumn("position", F.when(F.col("n_distractors") == 0, F.lit(positions[0])).otherwise(F.col("position"))).distinct()


def arrange(relevant: Column, distractors: Column, position: Column) -> Column:
    """The distractors before (early), after (late) or in the middle of the relevant facts; another position is refused."""
    half = F.floor(F.size(relevant) / 2).cast("int")
    rest = F.slice(relevant, half + 1, F.greatest(F.lit(0), F.size(relevant) - half))
    middle = F.concat(F.slice(relevant, F.lit(1), half), distractors, rest)
    refused = F.raise_error(F.concat(F.lit("unknown position "), F.coalesce(position, F.lit("null")))).cast("array<string>")
    placed = F.when(position == "early", F.concat(distractors, relevant)).when(position == "late", F.concat(relevant, distractors)).when(position == "middle", middle)
    return F.when(F.size(distractors) == 0, relevant).otherwise(F.coalesce(placed, refused))


def answer_target(options: Column, variant: Column) -> Column:
    return F.element_at(options, (variant % F.size(options) + 1).cast("int"))


def draw_variable(spec: Sequence, *parts: Column | str | int) -> Column:
    """One of a list of choices, or for ``("range", low, high)`` a whole number of the range, by keyed hash."""
    if spec[0] == "range":
        return F.lit(spec[1]) + draw(*parts) % (spec[2] - spec[1] + 1)
    return F.element_at(F.array(*map(F.lit, spec)), (draw(*parts) % len(spec) + 1).cast("int"))


def sample_for_target(items: DataFrame, key: str, target: str, variables: Mapping[str, Sequence], constraints: Sequence[str], solution: str, attempts: int = 500, seed: int = 0) -> DataFrame:
    """Per item the first attempt whose variables meet all constraints and solve to the item's target: (key, attempt, variables).

    An item that no attempt serves is left out; compare the counts to find such templates.
    """
    tried = items.select(key, target).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    drawn = tried.withColumns({name: draw_variable(spec, seed, F.col(key), F.col("attempt"), name) for name, spec in variables.items()})
    columns = {name: F.col(name) for name in variables}
    served = drawn.filter(compile_expression(solution, columns) == F.col(target))
    for rule in constraints:
        served = served.filter(compile_expression(rule, columns))
    first = served.groupBy(key).agg(F.min(F.struct("attempt", *variables)).alias("_first"))
    return first.select(key, "_first.*")


def swap_changes_answer(solution: str, columns: Mapping[str, Column], swaps: Mapping[str, Column]) -> Column:
    """Whether putting any one of the colliding values in changes the answer each time."""
    answer = compile_expression(solution, columns)
    changed = [compile_expression(solution, {**columns, name: value}) != answer for name, value in swaps.items()]
    return F.forall(F.array(*changed), lambda c: c) if changed else F.lit(True)


def stable_nearby(solution: str, columns: Mapping[str, Column], integers: Sequence[str]) -> Column:
    """Whether the answer stays when any one whole number moves by one."""
    answer = compile_expression(solution, columns)
    near = [compile_expression(solution, {**columns, name: columns[name] + step}) == answer for name in integers for step in (-1, 1)]
    return F.forall(F.array(*near), lambda c: c) if near else F.lit(True)


def render(template: Column, values: Column) -> Column:
    """Fills ``{name}`` placeholders from a map; unknown ones stay."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def partition_entries(rows: DataFrame, order: str, name: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """n contiguous groups in order (unique), the first ones longer by one: (group, names).

    Of all rows, the places come from counts in parts of the order (a number), so no task sorts them all.
    """
    if by:
        placed = rows.withColumn("group", F.ntile(n).over(W.partitionBy(*by).orderBy(order)))
    else:
        slim = rows.select(order, name).withColumn("_one", F.lit(1))
        at = running(slim, (), order, "_one")
        size = slim.agg(F.count("*").alias("_size"))
        short, longer = F.floor(F.col("_size") / n), F.col("_size") % n
        edge = longer * (short + 1)
        k = F.when(F.col("_one_below") < edge, F.floor(F.col("_one_below") / (short + 1))).otherwise(longer + F.floor((F.col("_one_below") - edge) / F.greatest(short, F.lit(1))))
        placed = at.join(F.broadcast(size)).withColumn("group", (k + 1).cast("int"))  # one row
    return placed.groupBy(*by, "group").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda s: s[name]).alias("names"))


def budget_draw(library: DataFrame, doc_id: str, size: str, budget: int, seed: int, by: Sequence[str] = (), max_share: float | None = None) -> DataFrame:
    """Documents in seeded order until their sizes reach the budget (the one that reaches it is taken).

    With ``max_share``, a library that cannot fill the budget, or of which the draw takes a greater share, is refused; without it, it is drawn as far as it goes.
    """
    if max_share is not None:
        drawn = budget_draw(library, doc_id, size, budget, seed, by).groupBy(*by).agg(F.count("*").alias("_taken"), F.sum(size).alias("_filled"))
        have = library.groupBy(*by).agg(F.count("*").alias("_all"))
        both = have.join(drawn, list(by), "left") if by else have.join(drawn)
        require(both, library_too_small=F.coalesce(F.col("_filled"), F.lit(0)) < budget, share_too_large=F.col("_taken") > max_share * F.col("_all"))
    key = draw(seed, F.col(doc_id))
    below = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    keyed = library.withColumns({"_key": key, "_part": F.shiftright(key, 26)})  # draws are even over 32 bits, so 64 parts of the order are too
    ahead = keyed.groupBy(*by, "_part").agg(F.sum(size).alias("_size")).withColumn("_ahead", below(W.partitionBy(*by or [F.lit(0)]).orderBy("_part"), "_size")).filter(F.col("_ahead") < budget)
    at = [*by, "_part"]
    drawn = keyed.join(ahead.select(*at, "_ahead"), at).withColumn("before", below(W.partitionBy(*at).orderBy("_key", doc_id), size) + F.col("_ahead"))
    return drawn.filter(F.col("before") < budget).select(*library.columns, "before")


def sample_per_group(rows: DataFrame, group: str, row_id: str, k: int, seed: int) -> DataFrame:
    """min(k, n) rows of each group in seeded order; tasks drop what cannot be among them before the shuffle."""
    w = W.partitionBy(group).orderBy("_key", row_id)
    return rows.withColumn("_key", draw(seed, F.col(row_id))).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_key", "_r")


def alternating_sample(rows: DataFrame, domain: str, triple: str, label: str, case: str) -> DataFrame:
    """One item per triple: the triples of a domain take their label in turn, and domains start in turn."""
    triples = rows.select(domain, triple).distinct()
    turn = F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy(domain)) + F.row_number().over(W.partitionBy(domain).orderBy(triple))
    wanted = triples.withColumn("_want", F.pmod(turn, F.lit(2)) == 0)
    hits = rows.join(wanted, [domain, triple]).filter(F.col(label) == F.col("_want"))
    return hits.groupBy(domain, triple).agg(F.min(case).alias(case), F.bool_or(label).alias(label))


def depths(prompt: Column, marks: Column) -> Column:
    """Where each marker begins, as a share of the prompt; markers that are absent are left out."""
    found = F.filter(marks, lambda m: F.contains(prompt, m))
    return F.transform(found, lambda m: (F.position(m, prompt) - 1) / F.length(prompt))


def within_band(prompt: Column, marks: Column, low: float = 0.30, high: float = 0.60) -> Column:
    return F.forall(depths(prompt, marks), lambda d: (d >= low) & (d <= high))


def assemble(core: Column, padding: Column, question: Column) -> Column:
    return F.concat_ws("\n\n", core, F.array_join(padding, "\n\n"), question)


def ablate(padding: Column, question: Column, rule: str = "=" * 60) -> Column:
    """The prompt without its core: padding and question alone."""
    return F.concat(F.array_join(F.transform(padding, lambda p: F.concat(p, F.lit("\n"))), ""), F.lit(f"\n\n{rule}\n\n"), question, F.lit("\n"))


def weave(core: Column, padding: Column, low: float = 0.30, high: float = 0.60) -> Column:
    """Core documents laid into the depth band, padding before, between and after: each core document is aimed at the middle of its slice of the band, and padding goes
    before it while it fits below that. Arrays of rendered documents in, one array in order out; a document takes its length and a line feed.

    The padding is read once for the total and once for the cuts, whatever the number of core documents: sizes, targets and cuts are each bound before they are used."""
    size = lambda d: F.length(d) + 1
    sizes = F.transform(core, size)
    total = F.aggregate(F.concat(core, padding), F.lit(0), lambda n, d: n + size(d)).cast("double")
    target = lambda total, i: low * total + (high - low) * total * (i + 0.5) / F.size(core)
    targets = let(total, lambda t: F.transform(F.sequence(F.lit(0), F.size(core) - 1), lambda i: target(t, i)))

    def cuts(facts: Column) -> Column:
        """How many padding documents stand before each core document."""
        n, goal, own = F.size(core), facts["targets"], facts["sizes"]

        # A padding document goes before the first core document, from the one at hand on, below whose target it still fits; those it does not fit below are placed.
        def place(state: Column, d: Column) -> Column:
            open_ = F.struct(state["used"].alias("used"), state["at"].alias("at"))
            passed = F.aggregate(F.sequence(state["at"] + 1, n), open_, lambda s, _: F.when((s["at"] < n) & (s["used"] + size(d) > F.get(goal, s["at"])), F.struct((s["used"] + F.get(own, s["at"])).alias("used"), (s["at"] + 1).alias("at"))).otherwise(s))
            moved = lambda p: F.struct((p["used"] + size(d)).alias("used"), p["at"].alias("at"), (state["seen"] + 1).alias("seen"), F.when(p["at"] > state["at"], F.concat(state["cuts"], F.array_repeat(state["seen"], p["at"] - state["at"]))).otherwise(state["cuts"]).alias("cuts"))
            return F.when(state["at"] < n, let(passed, moved)).otherwise(state)

        start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("at"), F.lit(0).alias("seen"), F.array().cast("array<int>").alias("cuts"))
        return F.aggregate(padding, start, place, lambda s: F.concat(s["cuts"], F.array_repeat(s["seen"], n - s["at"])))

    def laid(at: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.size(core)), lambda k: F.concat(*[between(at, k), F.slice(core, k + 1, F.when(k < F.size(core), 1).otherwise(0))]))
        return F.flatten(pieces)

    def between(at: Column, k: Column) -> Column:
        first = F.when(k == 0, F.lit(0)).otherwise(F.get(at, k - 1))
        return F.slice(padding, first + 1, F.coalesce(F.get(at, k), F.size(padding)) - first)

    woven = let(let(F.struct(targets.alias("targets"), sizes.alias("sizes")), cuts), laid)
    return F.when(F.size(core) > 0, woven).otherwise(padding)


def audited(distractors: DataFrame) -> DataFrame:
    """Adds ``inert`` and ``accepted`` to rows (distractor_id, shared array, votes array of booleans or nulls): shared variables refuse it whatever the votes; else two votes at least, all in favour."""
    free = F.size("shared") == 0
    return distractors.withColumns({"inert": free, "accepted": free & (F.size("votes") >= 2) & F.forall("votes", lambda v: F.coalesce(v, F.lit(False)))})


def audit_summary(audited_: DataFrame) -> DataFrame:
    """(considered, accepted, refused, rate) of audited distractors; the rate is 0 where none was considered."""
    return audited_.agg(F.count("*").alias("considered"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"), F.coalesce(F.avg(F.col("accepted").cast("int")), F.lit(0.0)).alias("rate"))


def draw_pool(facts: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """(key, pool): at most k distractors (key, fact_id, text, collides) of each template, those that collide with what decides first, in seeded order within both kinds."""
    own = F.struct((~F.col("collides")).alias("inert"), draw(seed, F.col(key), F.col("fact_id")).alias("at"), "fact_id", "text")
    return facts.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(own)), 1, k).alias("_p")).select(key, F.transform("_p", lambda x: F.struct(x["fact_id"].alias("fact_id"), x["text"].alias("text"))).alias("pool"))


def items(templates: DataFrame, pools: DataFrame, grid: DataFrame, key: str, variants: int) -> DataFrame:
    """One row per template (key, facts array), variant and stratum (n_distractors, position): item_id, facts in order, distractor_ids. The strata are few and travel with the plan."""
    made = templates.join(pools, key, "left").withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1)))).join(F.broadcast(grid))
    chosen = F.slice(F.coalesce("pool", F.array().cast("array<struct<fact_id:string,text:string>>")), F.lit(1), F.col("n_distractors"))
    name = F.format_string("%s#v%d-d%d-%s", F.col(key).cast("string"), "variant", "n_distractors", "position")
    return made.select(key, "variant", "n_distractors", "position", name.alias("item_id"), arrange(F.col("facts"), F.transform(chosen, lambda x: x["text"]), F.col("position")).alias("facts"), F.transform(chosen, lambda x: x["fact_id"]).alias("distractor_ids"))


def select_per_family(rows: DataFrame, family: str, row_id: str, k: int, seed: int, families: Sequence[str] | None = None) -> DataFrame:
    """min(k, n) rows of each family; families are picked after the draw, so that it does not depend on them."""
    drawn = sample_per_group(rows, family, row_id, k, seed)
    return drawn.filter(F.col(family).isin(*families)) if families is not None else drawn
