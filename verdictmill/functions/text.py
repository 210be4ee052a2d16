"""Surface features of texts as column expressions, and the registries of features and views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the feature battery, and the names of its features (FEATURES, DELTA_FEATURES).
FIRST_PERSON = ("i", "i'm", "i've", "i'd", "i'll", "me", "my", "mine", "we", "our")
IMPERATIVES = (
    "add brainstorm check convert draft explain fix generate give implement list make rank reformat refactor rename review rewrite summarise summarize tell validate write"
).split()
SHOULD_I = r"(?i)\bshould (?:i|we)\b"
PASTE_CUES = r"(?i)\b(?:here'?s|below|attached|pasted|paste|forwarding|copying|thread|transcript)\b"
DECLINES = r"(?i)\b(?:rather than|instead of|not a recommendation|not asking|just the rules|don'?t need|no advice)\b"
PENALTY = r"(?i)\b(?:forfeit\w*|default\w*|breach\w*|exclud\w*|void\w*|terminat\w*|revok\w*|rescind\w*|penal(?:t?y|ise\w*|ize\w*)|den(?:y|ies|ied)|ineligible\w*|lapse\w*|los(?:e|es|t)|forgo\w*|cease\w*)\b"
PROCEDURAL = r"(?i)\b(?:requir\w*|restrict\w*|must|shall|submit\w*|obtain\w*|authoris\w*|authoriz\w*|approv\w*|appl(?:y|ies|ied|ication\w*)|process\w*|notif\w*|complet\w*|follow\w*|provide\w*|document\w*)\b"


def casefold(text: Column) -> Column:
    """The text with its case folded: upper case first, where letters without a capital of their own (ß) become those they stand for, then lower case.
    The dotless i, whose capital is that of the dotted one, stays apart; without a step between them, the optimizer would drop the upper case."""
    dotless, mark = chr(0x131), chr(0xE131)
    return F.lower(F.translate(F.upper(F.translate(text, dotless, mark)), mark, dotless))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it: a column would be put in at each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z']+"), F.lit(0))


#: An end of a run of ASCII word characters. Spark's ``\\b`` takes accented letters for word characters, its ``\\w`` does not.
WORD_END = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: The only letters outside ASCII whose case folds to one inside; where case is ignored, they are among what a letter, or a word character, stands for.
LONG_S, KELVIN = chr(0x17F), chr(0x212A)


def ascii_words(pattern: str) -> str:
    """The pattern with word characters of ASCII alone on both sides of ``\\b``, and case folded as SQL engines fold it. Letters of the pattern stand outside classes."""
    swaps = {r"\b": WORD_END}
    if "(?i)" in pattern:
        swaps |= {"s": f"[s{LONG_S}]", "k": f"[k{KELVIN}]", r"\w": rf"[\w{LONG_S}{KELVIN}]"}
    return re.sub(r"\\.|[sk]", lambda m: swaps.get(m[0], m[0]), pattern)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(ascii_words(pattern))).cast("double")


def has(text: Column, pattern: str) -> Column:
    return text.rlike(ascii_words(pattern)).cast("double")


def share(part: Column, whole: Column) -> Column:
    """0.0 where the whole is empty."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def word_count(text: Column) -> Column:
    return count(text, r"\S+")


def first_person_rate(text: Column) -> Column:
    return WORD_FEATURES["first_person_rate"](words(text))


def type_token_ratio(text: Column) -> Column:
    return WORD_FEATURES["type_token_ratio"](words(text))


def imperative_opener(text: Column) -> Column:
    return WORD_FEATURES["imperative_opener"](words(text))


def sentences(text: Column) -> Column:
    """Parts that end with ``.``, ``!`` or ``?`` before white space, blank ones left out; never empty."""
    return let(_parts(text), lambda parts: F.when(F.size(parts) > 0, parts).otherwise(F.array(text)))


def _parts(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def sentence_count(text: Column) -> Column:
    return F.greatest(F.lit(1.0), F.size(_parts(text)).cast("double"))


def penalty_gap(text: Column) -> Column:
    return count(text, PENALTY) - count(text, PROCEDURAL)


FEATURES: dict[str, Callable[[Column], Column]] = {
    "word_count": word_count,
    "char_count": lambda t: F.length(t).cast("double"),
    "says_should_i": lambda t: has(t, SHOULD_I),
    "question_marks": lambda t: count(t, r"\?"),
    "first_person_rate": first_person_rate,
    "paste_cues": lambda t: count(t, PASTE_CUES),
    "imperative_opener": imperative_opener,
    "type_token_ratio": type_token_ratio,
    "terminal_question": lambda t: has(t, r"\?\s*$"),
    "declines_advice": lambda t: has(t, DECLINES),
    "sentence_count": sentence_count,
}

DELTA_FEATURES: dict[str, Callable[[Column], Column]] = {
    "delta_char_count": lambda t: F.length(t).cast("double"),
    "delta_word_count": lambda t: count(t, "[A-Za-z']+"),
    "numeral_count": lambda t: count(t, r"\d[\d,]*(?:\.\d+)?"),
    "has_date": lambda t: has(t, r"\b\d{4}-\d{2}-\d{2}\b"),
    "penalty_lexicon_gap": penalty_gap,
}

VIEWS: dict[str, Callable[[Column], Column]] = {
    "turn": lambda t: t,
    "close": lambda t: F.element_at(sentences(t), -1),
    "open": lambda t: F.element_at(sentences(t), 1),
}


#: Features of the words of a text, which are found once for all of them.
WORD_FEATURES: dict[str, Callable[[Column], Column]] = {
    "first_person_rate": lambda w: share(F.size(F.filter(w, lambda x: x.isin(*FIRST_PERSON))), F.size(w)),
    "imperative_opener": lambda w: F.coalesce(F.try_element_at(w, F.lit(1)).isin(*IMPERATIVES).cast("double"), F.lit(0.0)),
    "type_token_ratio": lambda w: share(F.size(F.array_distinct(w)), F.size(w)),
}


def features(text: Column, registry: dict[str, Callable[[Column], Column]] = FEATURES) -> list[Column]:
    """The features of a text; those of its words are made together, from words that are found once."""
    shared = [n for n, make in registry.items() if n in WORD_FEATURES and make is FEATURES.get(n)]
    of_words = let(words(text), lambda w: F.struct(*[WORD_FEATURES[n](w).alias(n) for n in shared])) if shared else None
    return [(of_words[n] if n in shared else make(text)).alias(n) for n, make in registry.items()]


def featured(rows: DataFrame, text: str, registry: dict[str, Callable[[Column], Column]] = FEATURES) -> DataFrame:
    """Adds the features of a column of texts."""
    return rows.select("*", *features(F.col(text), registry))


def standardised_ttr(tokens: Column, window: int = 100) -> Column:
    """Mean type-token ratio over the full windows; over the first, partial one if none is full."""
    ratio = lambda part: share(F.size(F.array_distinct(part)), F.size(part))
    full = F.floor(F.size(tokens) / window).cast("int")
    rates = F.transform(F.sequence(F.lit(0), full - 1), lambda k: ratio(F.slice(tokens, k * window + 1, window)))
    mean = F.aggregate(rates, F.lit(0.0), lambda a, b: a + b) / F.size(rates)
    return F.when(full > 0, mean).otherwise(ratio(F.slice(tokens, 1, window)))


def per_hundred_words(text: Column, pattern: str) -> Column:
    return share(count(text, pattern) * 100.0, word_count(text))


def template_variables(text: Column) -> Column:
    """Names of the placeholders of a format string."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), F.lit(1)))


def load_bearing_tokens(text: Column) -> Column:
    """Section references, ISO dates, dates in prose, company names, and numerals of three or more digits."""
    find = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    numerals = F.filter(find(r"\d[\d,]*(?:\.\d+)?"), lambda n: F.length(F.regexp_replace(F.substring_index(n, ".", 1), ",", "")) >= 3)
    parts = [find(r"(?:§|\bsection |\bclause )\s*\d+(?:\.\d+)*"), find(r"\b\d{4}-\d{2}-\d{2}\b"), find(rf"\b\d{{1,2}} (?:{months})(?: \d{{4}})?\b"), find(r"\b[A-Z]\w+ (?:Ltd|Limited|Inc|LLC|plc|GmbH)\b"), numerals]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def natural_key(name: Column) -> Column:
    """Sorts s2 before s10, and s before s0: the prefix, the number (none before all, then by length and digits, whatever its size), the rest."""
    digits = F.regexp_extract(name, r"^\D*(\d*)", 1)
    number = F.regexp_replace(digits, "^0+", "")
    return F.struct(
        F.regexp_extract(name, r"^(\D*)", 1).alias("prefix"),
        F.when(digits == "", -1).otherwise(F.length(number)).alias("size"),
        number.alias("number"),
        F.regexp_extract(name, r"(?s)^\D*\d*(.*)$", 1).alias("rest"),
    )


def placebo_match(skill: Column, placebo: Column, tolerance: float = 0.15) -> Column:
    """Words within the tolerance, as many headings, as many pairs of fences."""
    lines = lambda t, p: F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(p)))
    near = F.abs(word_count(placebo) - word_count(skill)) <= tolerance * word_count(skill)
    return near & (lines(skill, "^#") == lines(placebo, "^#")) & (F.floor(lines(skill, "^```") / 2) == F.floor(lines(placebo, "^```") / 2))
