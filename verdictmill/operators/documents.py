"""Documents that cite, claim and record: sections, entries, links, quotes. Rows of whole texts in, rows of findings out."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .integrity import occurrences


def register_entries(docs: DataFrame, text: str = "text") -> DataFrame:
    """(date, title, commits) of the ``## date — title`` sections of a register."""
    parts = docs.select(F.explode(F.split(text, r"(?m)^## ")).alias("s"))
    head = F.substring_index("s", "\n", 1)
    hashes = F.regexp_extract_all(F.regexp_extract("s", r"\*\*Commits:\*\*([^\n]*)", 1), F.lit(r"\b[0-9a-f]{7,40}\b"), F.lit(0))
    return parts.filter(head.rlike(r"^\d{4}-\d{2}-\d{2}\b")).select(F.substring(head, 1, 10).alias("date"), F.trim(F.regexp_replace(head, r"^\d{4}-\d{2}-\d{2}\s*[—–-]*\s*", "")).alias("title"), hashes.alias("commits"))


def bib_entries(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, arxiv, has_quote): one row per arXiv id, that of the first entry."""
    bare = F.regexp_replace(text, r"(?m)^[ \t]*%[^\n]*$", "")  # comments
    entry = docs.select(F.posexplode(F.split(bare, r"(?m)^@")).alias("at", "e")).filter(F.col("e").rlike(r"^\w+\{"))
    told = entry.select("at", F.regexp_extract("e", r"^\w+\{([^,\s]+)", 1).alias("key"), F.regexp_extract("e", r"\b(\d{4}\.\d{4,5})\b", 1).alias("arxiv"), F.col("e").rlike(r"(?mi)^\s*quote(?:_body)?\s*=").alias("has_quote"))
    return told.filter("arxiv <> ''").groupBy("arxiv").agg(F.min_by("key", "at").alias("key"), F.min_by("has_quote", "at").alias("has_quote"))


#: What a claim number looks like (a percentage, percentage points, kappa, AUC), and what is no claim (links, paper ids).
CLAIM_NUMBER = r"(?i)[+-]?\d+(?:\.\d+)?\s*(?:pp(?![\p{L}\p{N}_.])|%)|(?<![\p{L}\p{N}_])(?:kappa|κ)\s*[=:]\s*\d?\.\d+|(?<![\p{L}\p{N}_])AUC\s*[=:]?\s*\d?\.\d+"
NO_CLAIM = r"(?i)https?://\S+|arxiv[:/]\S+|\b\d{4}\.\d{4,5}\b"


def asserts_a_number(line: Column) -> Column:
    """A claim number stands in the line, links and paper ids aside; not any digit."""
    return F.regexp_replace(line, NO_CLAIM, " ").rlike(CLAIM_NUMBER)


#: Fixed values of Markdown: what a line is, in the order in which the first that fits decides; white space of any script.
FENCE = r"^(?U)\s{0,3}(`{3,}|~{3,})"
BLANK = r"^(?U)\s*$"
TABLE_DELIMITER = r"^(?U)\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$"
TABLE_ROW = r"^(?U)\s*\|"
HEADING = r"^(?U)\s{0,3}#{1,6}\s"
RULE = r"^(?U)\s{0,3}(?:-{3,}|\*{3,}|_{3,}|={3,})\s*$"
BULLET = r"^(?U)\s*[-*+]\s+"
DEFINITION = r"^(?U)\s{0,3}\[[^\]]{1,200}\]:\s"
FIRST_ORDERED = r"^(?U)\s*1[.)]\s+"
ORDERED = r"^(?U)\s*\d{1,9}[.)]\s+"
BLOCKQUOTE = r"^(?U)(?:\s{0,3}>\s?)+"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85" + chr(0x2028) + chr(0x2029) + "]"

#: A letter per line, by which a document is a word over eleven letters and its blocks are found by rewriting that word.
#: f and g: the first and the other lines of a fenced part; b blank, d delimiter, r row, h heading or rule, s start of an item, o and n: ordered item by
#: 1 or another number, t text; the last five in capitals where the line holds a pipe, as rows after a table's row may.
REWRITES = (
    (r"(?:(?<=[dr])|\G(?<!^))[HSONT]", "r"),  # a line with a pipe goes on with the table above it
    (r"[HSONT]", None),  # elsewhere a pipe means nothing
    (r"[sont](?=d)", "s"),  # the line above a delimiter is the table's head
    (r"(?<![sont])n|o", "s"),  # a number other than 1 does not break into a paragraph
    ("n", "t"),
    (r"(?<![st])t", "s"),  # text begins a block where none is open
)


def _fenced(lines: Column) -> Column:
    """(first, last) places, from 0, of the fenced parts: a fence closes at one of its own character, as long at least, with nothing behind. None where the last stays open."""
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.regexp_extract(x, FENCE, 1).alias("mark"), F.regexp_replace(x, FENCE, "").rlike(BLANK).alias("bare"))), lambda m: m["mark"] != "")
    none = F.lit(None).cast("int")
    start = F.struct(none.alias("at"), F.lit("").alias("mark"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))

    def step(state: Column, m: Column) -> Column:
        ends = m["bare"] & (F.substring(m["mark"], 1, 1) == F.substring(state["mark"], 1, 1)) & (F.length(m["mark"]) >= F.length(state["mark"]))
        opened = F.struct(m["at"].alias("at"), m["mark"].alias("mark"), state["done"].alias("done"))
        closed = F.struct(none.alias("at"), F.lit("").alias("mark"), F.concat(state["done"], F.array(F.struct(state["at"].alias("first"), m["at"].alias("last")))).alias("done"))
        return F.when(state["at"].isNull(), opened).when(ends, closed).otherwise(state)

    end = F.aggregate(marks, start, step)
    return F.when(end["at"].isNull(), end["done"]).otherwise(start["done"])


def _letter(line: Column, place: Column, fenced: Column) -> Column:
    bare = F.regexp_replace(line, BLOCKQUOTE, "")
    is_ = lambda *patterns: functools.reduce(lambda a, b: a | b, [bare.rlike(p) for p in patterns])
    plain = F.when(is_(HEADING, RULE), "h").when(is_(BULLET, DEFINITION), "s").when(is_(FIRST_ORDERED), "o").when(is_(ORDERED), "n").otherwise("t")
    inside = F.filter(fenced, lambda f: (f["first"] <= place) & (place <= f["last"]))
    in_fence = F.when(F.get(inside, F.lit(0))["first"] == place, "f").otherwise("g")
    return F.when(F.size(inside) > 0, in_fence).when(is_(BLANK), "b").when(is_(TABLE_DELIMITER), "d").when(is_(TABLE_ROW), "r").otherwise(F.when(bare.contains("|"), F.upper(plain)).otherwise(plain))


def markdown_blocks(docs: DataFrame, text: str = "text", doc_id: str = "path") -> DataFrame:
    """(path, line, block): the blocks of Markdown texts with the number (from 1) of their first line.

    Blocks are paragraphs, list items, definitions, fenced parts, and headings, rules and rows of tables by themselves. A document stays in its row until its
    blocks are known, so rows that repeat a path are documents of their own; a null or empty text has none.
    """
    lines = F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END, -1)
    return docs.filter(F.col(text) != "").select(F.col(doc_id).cast("string").alias(doc_id), F.inline(let(lines, _blocks_of)))


def _blocks_of(lines: Column) -> Column:
    letters = let(_fenced(lines), lambda fenced: F.transform(lines, lambda x, i: _letter(x, i, fenced)))
    word = F.array_join(letters, "")
    for pattern, into in REWRITES:
        word = F.lower(word) if into is None else F.regexp_replace(word, pattern, into)

    def cut(word: Column) -> Column:
        begins = F.filter(F.transform(word, lambda w, i: F.when(w.isin("f", "d", "r", "h", "s"), i + 1)), lambda i: i.isNotNull())
        return let(begins, lambda firsts: F.transform(firsts, lambda first, k: block(word, first, F.coalesce(F.get(firsts, k + 1), F.size(lines) + 1) - 1)))

    def block(word: Column, first: Column, last: Column) -> Column:
        """A block runs to the line before the next one's first, without blank lines."""
        own = F.filter(F.slice(lines, first, last - first + 1), lambda x, i: F.get(word, first + i - 1) != "b")
        return F.struct(first.alias("line"), F.array_join(own, "\n").alias("block"))

    return let(F.split(word, ""), cut)


#: A field of an entry with a body of braces, nested three deep at most.
FIELD = r"(?m)^[ \t]*([A-Za-z][A-Za-z0-9_-]*)\s*=\s*\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"


def _fields(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(path, arxiv, name, body, line) of the fields of bibliography entries; ``line`` is that of the field in the file."""
    entries = docs.select(doc_id, F.posexplode(F.split(text, r"(?m)^@")).alias("at", "e"), F.split(text, r"(?m)^@").alias("all")).filter("at > 0")
    before = F.length(F.regexp_replace(F.array_join(F.slice("all", 1, F.col("at")), "@"), r"[^\n]", ""))
    found = entries.select(doc_id, before.alias("before"), "e", F.nullif(F.regexp_extract("e", r"\b(\d{4}\.\d{4,5})\b", 1), F.lit("")).alias("arxiv"), F.explode(F.regexp_extract_all("e", F.lit(FIELD), F.lit(0))).alias("f"))
    ahead = F.length(F.regexp_replace(F.substr(F.col("e"), F.lit(1), F.position(F.col("f"), F.col("e")) - 1), r"[^\n]", ""))
    return found.select(doc_id, F.coalesce("arxiv", F.lit("-")).alias("arxiv"), F.regexp_extract("f", FIELD, 1).alias("name"), F.regexp_extract("f", FIELD, 2).alias("body"), (F.col("before") + ahead + 1).alias("line"))


def bare_percents(docs: DataFrame, text: str = "text", doc_id: str = "path") -> DataFrame:
    """(path, arxiv, name, line): percent signs of fields that are not escaped, one row each."""
    parts = F.split("body", r"(?<!\\)%", -1)
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.length(F.regexp_replace(F.array_join(F.slice(parts, 1, k), "%"), r"[^\n]", "")))
    fields = _fields(docs, text, doc_id).filter(F.size(parts) > 1)
    return fields.select(doc_id, "arxiv", "name", "line", F.explode(cuts).alias("_ahead")).select(doc_id, "arxiv", "name", (F.col("line") + F.col("_ahead")).alias("line"))


def unknown_quote_fields(docs: DataFrame, text: str = "text", doc_id: str = "path") -> DataFrame:
    """(path, arxiv, name, line): fields that begin with quote and are neither quote nor quote_body, so that they prove nothing."""
    low = F.lower("name")
    return _fields(docs, text, doc_id).filter(low.startswith("quote") & ~low.isin("quote", "quote_body")).drop("body")


def published_ids(docs: DataFrame, pattern: str = r"\b(?:claim|shown)\(\s*['\"]([a-z0-9-]+)['\"]\s*\)", text: str = "text", doc_id: str = "path") -> DataFrame:
    """(claim_id, documents): where each claim is published."""
    ids = docs.select(doc_id, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("claim_id"))
    return ids.groupBy("claim_id").agg(F.array_sort(F.collect_set(doc_id)).alias("documents"))


def load_claims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(claims, retractions) of a JSON document; entries that lack a field are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "claims array<map<string,string>>, retractions array<map<string,string>>").alias("v"))

    def section(name: str, needed: tuple[str, ...], more: tuple[str, ...] = ()) -> DataFrame:
        rows = whole.select(F.explode(f"v.{name}").alias("e"))
        return rows.filter(F.forall(F.array(*map(F.lit, needed)), lambda k: F.try_element_at(F.col("e"), k).isNotNull())).select(*[F.try_element_at(F.col("e"), F.lit(k)).alias(k) for k in (*needed, *more)])

    return section("claims", ("id", "value", "source", "quote", "why"), ("rounded", "latest")), section("retractions", ("phrase", "source", "quote", "why"))


def dependencies(docs: DataFrame, files: DataFrame, pattern: str, text: str = "text", doc_id: str = "path", not_mechanisms: tuple[str, ...] = (".md",)) -> DataFrame:
    """(path, depends_on): files (path) that a document names, itself and other documents left out."""
    named = docs.select(doc_id, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("depends_on"))
    own = named.filter(F.col("depends_on") != F.col(doc_id).cast("string"))
    for suffix in not_mechanisms:
        own = own.filter(~F.col("depends_on").endswith(suffix))
    return own.join(files.select(F.col("path").alias("depends_on")).distinct(), "depends_on", "left_semi").select(doc_id, "depends_on")


def worklist(movements: DataFrame) -> DataFrame:
    """Documents (document, commits) with something to read again, the furthest behind first."""
    return movements.filter(F.coalesce("commits", F.lit(-1)) != 0).orderBy(F.desc_nulls_last("commits"), "document")


def uncited_numbers(docs: DataFrame, bib: DataFrame, text: str = "text", doc_id: str = "path") -> DataFrame:
    """(path, arxiv, message): paragraphs that cite an unknown paper, or state a number of one without a quote."""
    blocks = markdown_blocks(docs, text, doc_id).select(doc_id, F.col("block").alias("b"))
    cited = blocks.select(doc_id, asserts_a_number(F.col("b")).alias("number"), F.explode(F.array_distinct(F.regexp_extract_all("b", F.lit(r"\b(\d{4}\.\d{4,5})\b"), F.lit(1)))).alias("arxiv"))
    joined = cited.join(bib.select("arxiv", "has_quote"), "arxiv", "left")
    why = F.when(F.col("has_quote").isNull(), "unknown paper").when(F.col("number") & ~F.col("has_quote"), "number without a quote")
    return joined.withColumn("message", why).filter("message is not null").select(doc_id, "arxiv", "message").distinct()


def normalise_markup(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "*_`", ""), r"\s+", " "))


def anchor_findings(claims: DataFrame) -> DataFrame:
    """(claim_id, message) of claims (claim_id, quote, source_text, value) whose quote is not in the source exactly once, or lacks the value."""
    n = occurrences(normalise_markup(F.col("source_text")), normalise_markup(F.col("quote")))
    why = F.when(n == 0, "quote not found").when(n > 1, "quote found more than once").when(~F.contains("quote", F.col("value")), "value not in quote")
    return claims.withColumn("message", why).filter("message is not null").select("claim_id", "message")


def link_index(docs: DataFrame, pattern: str, text: str = "text", doc_id: str = "path") -> DataFrame:
    """(link, documents): which documents name a link."""
    links = docs.select(doc_id, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("link"))
    return links.groupBy("link").agg(F.array_sort(F.collect_set(doc_id)).alias("documents"))


def router_rows(text: Column) -> Column:
    """Array of structs of the three-column rows of a Markdown table, without its head."""
    rows = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\|[^|]+\|[^|]+\|[^|]+\|\s*$") & ~x.rlike(r"^[\s|:\-]+$"))
    cell = lambda x, k: F.trim(F.element_at(F.split(F.trim(x), r"\|"), k + 1))
    body = F.slice(rows, F.lit(2), F.greatest(F.lit(0), F.size(rows) - 1))
    return F.transform(body, lambda x: F.struct(F.regexp_replace(cell(x, 1), "`", "").alias("name"), cell(x, 2).alias("condition"), cell(x, 3).alias("product")))


def covering(entries: Column, procedure: Column) -> Column:
    """The first entry whose hyphenated name contains the procedure; null without one."""
    return F.try_element_at(F.filter(entries, lambda n: F.array_contains(F.split(n, "-"), procedure)), F.lit(1))
