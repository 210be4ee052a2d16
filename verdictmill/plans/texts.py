"""Text features and the shortcut battery; parsing of replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, text
from ..operators import ranks
from .proxies import DOCS_SQL, doc_verdicts
from .registry import Tables, query, r

#: The features in SQL; look-behind is not known there, so sentences are cut at a mark that is put in.
def _share(part: str, whole: str) -> str:
    return f"coalesce(({part})::DOUBLE / nullif({whole}, 0), 0.0)"


def _count(pattern: str, t: str = "t") -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))::DOUBLE"


WORDS = "regexp_extract_all(lower(t), '[A-Za-z'']+')"
QUOTED = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
Q = lambda p: p.replace("'", "''")
SENTENCES = "list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"
FEATURES_SQL = {
    "word_count": _count(r"\S+"),
    "char_count": "length(t)::DOUBLE",
    "says_should_i": f"regexp_matches(t, '{text.SHOULD_I}')::INT::DOUBLE",
    "question_marks": _count(r"\?"),
    "first_person_rate": _share(f"len(list_filter({WORDS}, lambda w: w IN ({QUOTED(text.FIRST_PERSON)})))", f"len({WORDS})"),
    "paste_cues": _count(Q(text.PASTE_CUES)),
    "imperative_opener": f"coalesce((({WORDS})[1] IN ({QUOTED(text.IMPERATIVES)}))::INT::DOUBLE, 0.0)",
    "type_token_ratio": _share(f"len(list_distinct({WORDS}))", f"len({WORDS})"),
    "terminal_question": r"regexp_matches(t, '\?\s*$')::INT::DOUBLE",
    "declines_advice": f"regexp_matches(t, '{Q(text.DECLINES)}')::INT::DOUBLE",
    "sentence_count": f"greatest(1, len({SENTENCES}))::DOUBLE",
}


@query("WITH x AS (SELECT doc_id, text AS t FROM documents) SELECT doc_id, " + ", ".join(f"{r(sql)} AS {name}" for name, sql in FEATURES_SQL.items()) + " FROM x")
def text_features(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *text.features(F.col("text")))


DELTA_SQL = {
    "delta_char_count": "length(t)::DOUBLE", "delta_word_count": _count("[A-Za-z'']+"), "numeral_count": _count(r"\d[\d,]*(?:\.\d+)?"),
    "has_date": r"regexp_matches(t, '\b\d{4}-\d{2}-\d{2}\b')::INT::DOUBLE", "penalty_lexicon_gap": f"{_count(Q(text.PENALTY))} - {_count(Q(text.PROCEDURAL))}",
}


@query("WITH x AS (SELECT conv_id, turn, text AS t FROM conversations) SELECT conv_id, turn, " + ", ".join(f"{r(sql)} AS {name}" for name, sql in DELTA_SQL.items()) + " FROM x")
def delta_features(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", *text.features(F.col("text"), text.DELTA_FEATURES))


FEATS_SQL = f"{DOCS_SQL}, x AS (SELECT doc_id, should_fire, lang, text AS t FROM docv), ft AS (SELECT doc_id, should_fire, lang, " + ", ".join(f"{sql} AS {name}" for name, sql in FEATURES_SQL.items()) + " FROM x)"
LONG_SQL = "lf AS (UNPIVOT ft ON " + ", ".join(FEATURES_SQL) + " INTO NAME feature VALUE value)"


def _features(t: Tables, *keep: str) -> DataFrame:
    return text.featured(doc_verdicts(t).select("doc_id", "should_fire", *keep, "text"), "text").drop("text")


@query(
    f"""WITH {FEATS_SQL}, {LONG_SQL}, vals AS (SELECT feature, value AS v, count(*) FILTER (WHERE should_fire) AS p, count(*) FILTER (WHERE NOT should_fire) AS q FROM lf GROUP BY 1, 2),
 b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM vals),
 a AS (SELECT feature, sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg, sum(p * (below + q * 0.5::DOUBLE)) / (sum(p) * sum(q)) AS auc FROM b GROUP BY 1)
 SELECT feature, n_pos, n_neg, {r("auc")} AS auc, {r("greatest(auc, 1 - auc)")} AS folded, auc < 0.4 OR auc > 0.6 AS leaks FROM a"""
)
def shortcut_battery(t: Tables) -> DataFrame:
    long = ranks.long_form(_features(t), list(text.FEATURES), "should_fire")
    out = ranks.auc(long, "value", "should_fire", ["feature"])
    return out.withColumns({"folded": ranks.folded(F.col("auc")), "leaks": ~F.col("auc").between(0.4, 0.6)})


CUT_SQL = """w AS (SELECT {g} feature, value, sum(p) OVER u AS lp, sum(q) OVER u AS lq, sum(p) OVER v AS np, sum(q) OVER v AS nq FROM (SELECT {g} feature, value, count(*) FILTER (WHERE should_fire) AS p, count(*) FILTER (WHERE NOT should_fire) AS q FROM {source} GROUP BY ALL)
 WINDOW u AS (PARTITION BY {g} feature ORDER BY value ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY {g} feature))"""
RIGHT = "greatest(lp, lq) + greatest(np - lp, nq - lq)"


@query(
    f"""WITH {FEATS_SQL}, {LONG_SQL}, {CUT_SQL.format(g="", source="lf")}, one AS (SELECT max({RIGHT}) AS one FROM w), base AS (SELECT count(*) AS n, greatest(count(*) FILTER (WHERE should_fire), count(*) FILTER (WHERE NOT should_fire)) AS major FROM ft),
 pl AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value, doc_id) AS pos, lead(value) OVER (PARTITION BY feature ORDER BY value, doc_id) AS nxt FROM lf),
 cuts AS (SELECT feature AS of, value AS edge FROM pl, base WHERE pos % greatest(1, n // 16) = 0 AND pos < n AND value <> nxt),
 sides AS (SELECT c.of, c.edge, o.value <= c.edge AS lft, l.feature, l.value, l.should_fire FROM cuts c JOIN lf o ON o.feature = c.of JOIN lf l ON l.doc_id = o.doc_id),
 w2 AS (SELECT of, edge, lft, {RIGHT} AS rgt FROM (SELECT of, edge, lft, feature, value, sum(p) OVER u AS lp, sum(q) OVER u AS lq, sum(p) OVER v AS np, sum(q) OVER v AS nq
   FROM (SELECT of, edge, lft, feature, value, count(*) FILTER (WHERE should_fire) AS p, count(*) FILTER (WHERE NOT should_fire) AS q FROM sides GROUP BY ALL) WINDOW u AS (PARTITION BY of, edge, lft, feature ORDER BY value ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY of, edge, lft, feature))),
 two AS (SELECT max(s) AS two FROM (SELECT of, edge, sum(m) AS s FROM (SELECT of, edge, lft, max(rgt) AS m FROM w2 GROUP BY 1, 2, 3) GROUP BY 1, 2))
 SELECT n, {r("major / n")} AS majority, {r("one / n")} AS depth1, {r("greatest(one, coalesce(two, 0)) / n")} AS depth2 FROM base, one, two"""
)
def decision_stump(t: Tables) -> DataFrame:
    return ranks.stump(_features(t), list(text.FEATURES), "should_fire", "doc_id")


#: Replies made of the events: JSON in prose, some broken, some with an answer line.
REPLY = "'I think {\"fire\": ' || CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '\"yes\"' ELSE 'true,' END || ', \"procedure\": \"' || event_type || '\", \"p_fire\": ' || (event_id % 13) / 10.0::DOUBLE || '} so' || chr(10) || '**ANSWER**: ' || event_type || '. ' || chr(10) || 'Total $' || (value * 100)::BIGINT"


def _replies(t: Tables) -> DataFrame:
    e = F.col("event_id")
    flag = F.when(e % 4 == 0, "true").when(e % 4 == 1, "false").when(e % 4 == 2, '"yes"').otherwise("true,")
    parts = [F.lit('I think {"fire": '), flag, F.lit(', "procedure": "'), F.col("event_type"), F.lit('", "p_fire": '), ((e % 13) / F.lit(10.0)).cast("string"), F.lit("} so\n**ANSWER**:"), F.when(e % 5 == 0, "\n ").otherwise(" "), F.col("event_type"), F.lit(". \nTotal $"), F.round(F.col("value") * 100).cast("long").cast("string")]
    return t.events.select("event_id", "event_type", F.concat(*parts).alias("reply"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS fired, CASE WHEN event_id % 4 < 2 AND event_type IN ('click', 'view', 'error') THEN event_type END AS procedure, CASE WHEN event_id % 4 < 2 AND event_id % 13 <= 10 THEN " + r("(event_id % 13) / 10.0") + " END AS p_fire FROM events")
def parse_verdicts(t: Tables) -> DataFrame:
    return _replies(t).select("event_id", parsing.decision(F.col("reply"), ("click", "view", "error")).alias("d")).select("event_id", "d.*")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'parsed' ELSE 'unlisted_option' END AS status, CASE WHEN event_type IN ('click', 'view', 'error') THEN event_type END AS value, event_type || '.' AS raw FROM events")
def parse_answers(t: Tables) -> DataFrame:
    options = F.array(F.lit("click"), F.lit("view"), F.lit("error"))
    return _replies(t).select("event_id", parsing.parse_answer(F.col("reply"), options).alias("a")).select("event_id", "a.*")


@query("SELECT event_id, " + r("round(value * 100)") + " AS number FROM events")
def last_numbers(t: Tables) -> DataFrame:
    return _replies(t).select("event_id", parsing.last_number(F.col("reply")).alias("number"))


@query("SELECT p_partkey, 'select ''name'' from ''x'' where n = ' || p_size || ' and b = ' || chr(39) || lower(p_brand) || chr(39) AS flat FROM part")
def normalised_queries(t: Tables) -> DataFrame:
    sql = F.concat(F.lit("Try SELECT  \"Name\"\n FROM `x`  WHERE n = "), F.col("p_size").cast("string"), F.lit(" AND b = '"), F.col("p_brand"), F.lit("'; or not"))
    return t.part.select("p_partkey", parsing.normalise_sql(parsing.first_select(sql)).alias("flat"))


@query("SELECT source, " + r("avg((regexp_matches(text, '[A-Z]{4}'))::INT)") + " AS capitals, " + r("avg((contains(text, '|'))::INT)") + " AS bars, count(*) AS n FROM documents GROUP BY 1")
def typography(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.avg(F.col("text").rlike("[A-Z]{4}").cast("int")).alias("capitals"), F.avg(F.contains("text", F.lit("|")).cast("int")).alias("bars"), F.count("*").alias("n"))
