"""Surrogates for personal data: keyed, of the same type, gender, script and format, distinct where the originals are.

An entity has a kind and a canonical form (an e-mail address in lower case, the digits of a number), so that all its
mentions get one surrogate, each in the format of the mention. A surrogate is drawn from a keyed hash of kind, canonical form and
attempt; without the key it tells nothing about the original. Over all distinct entities of the corpus, a surrogate
that another entity of its kind has already, or that is itself an original, is drawn again with the next attempt. Only the entities that needed
a further attempt travel back to their documents.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, slices

# Forms of address and the gender they tell.
ADDRESS = {
    "mr": "m", "mister": "m", "herr": "m", "herrn": "m", "señor": "m", "sr": "m", "don": "m", "monsieur": "m", "г-н": "m", "господин": "m", "κύριος": "m",
    "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "señora": "f", "señorita": "f", "sra": "f", "srta": "f", "doña": "f", "madame": "f", "mme": "f", "mlle": "f", "г-жа": "f", "госпожа": "f", "κυρία": "f",
    "dr": "u", "prof": "u",
}
#: Syllables of made-up names by script, and the endings that tell the gender of a given name.
SYLLABLES = {
    "LATIN": "ba be bo da de di do fa fe ga go ha he ja jo ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te to va ve vi wa ze".split(),
    "CYRILLIC": "ба бе бо ва ве во га го да де до жа за зо ка ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ха".split(),
    "GREEK": "βα βε γα γε δα δε δο ζα θα θε κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το φα χα".split(),
}
ENDINGS = {
    "LATIN": {"f": "na lia rina sia tta ra".split(), "m": "n rik rd s bert no".split(), "u": "l ry mi n ri sh".split(), "family": "mann ton ler son rez dier ning witz".split()},
    "CYRILLIC": {"f": "на лия рина ся тта ра".split(), "m": "н рик рд с берт й".split(), "u": "ль ри ми ня".split(), "family": "нко чук дзе тян лис вич".split()},
    "GREEK": {"f": "να λια ρινα σια ττα ρα".split(), "m": "νος ρης ρδος σος κος νης".split(), "u": "λη ρη μι νη".split(), "family": "ιδης πουλος ακης ογλου ατος ελης".split()},
}

#: Every kind but names has a digit or an @.
_HINT = re.compile(r"[\d@]")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DOTTED, _HEX = rf"(?:{_OCTET}\.){{3}}{_OCTET}", r"[0-9A-Fa-f]{1,4}"
_NAME = r"[^\W\d_][^\W\d_'’\-]{1,30}(?:[\-'’][^\W\d_]{2,30})?"
#: In order; of overlapping matches the first kind counts.
PATTERNS = {
    "email": r"(?<![\w.%+\-])[\w.%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "secret": r"(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])|(?<=[\"'])(?=[\w+/\-]*\d)[\w+/\-]{20,}={0,2}(?=[\"'])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    "ip6": rf"(?<!\w)(?<![0-9A-Fa-f:]:)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{6}}{_DOTTED}|(?=[A-Fa-f:]*\d)(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:(?:{_HEX}:){{0,6}}(?:{_DOTTED}|{_HEX}))?)(?!\w|:[\w:]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w\-])[3-6]\d{3}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,7}(?![\w\-])|(?<![\w\-])3\d{3}[ \-]?\d{6}[ \-]?\d{5}(?![\w\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w+(.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{4}|\d{3}[ .\-]\d{3}[ .\-]\d{4})(?![\w\-])|(?<![\w+])\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,6}(?!\w)",
    "name": r"(?<!\w)(?i:(" + "|".join(re.escape(x) for x in sorted(ADDRESS, key=len, reverse=True)) + rf"))\.?[  ]{{1,3}}({_NAME})(?:[  ]{{1,3}}({_NAME}))?",
}
_ALL = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items()))
_GROUP = {kind: _ALL.groupindex[kind] for kind in PATTERNS}


def _addressed() -> re.Pattern:
    """What the pattern of names begins with, for a quick search: a set of first characters, then the rest of each form of address.

    The cases of a letter are those that the pattern's own flag takes for equal.
    """
    letters = sorted(set("".join(ADDRESS)))
    near = re.findall("(?i:[" + re.escape("".join(letters)) + "])", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)])))
    cases = {c: "[" + re.escape("".join(x for x in near if re.fullmatch(re.escape(c), x, re.I))) + "]" for c in letters}
    firsts = sorted({x[0] for x in ADDRESS})
    rests = ["(?<=" + cases[c] + ")(?:" + "|".join("".join(cases[k] for k in x[1:]) for x in ADDRESS if x[0] == c) + ")" for c in firsts]
    return re.compile("[" + "".join(cases[c][1:-1] for c in firsts) + r"](?<!\w.)(?:" + "|".join(rests) + r")\.?[  ]{1,3}[^\W\d_]")


_ADDRESSED = _addressed()

#: Digits of a telephone number that tell it; those before are a country code, which a surrogate keeps.
NATIONAL = 10
#: Documents with an entity that needed a further attempt are few; up to this number (some 100 bytes each) they are broadcast.
BROADCAST_ROWS = 100_000


class Mention:
    """A stretch of a text: its entity (kind and canonical form) and how it is written."""

    __slots__ = ("start", "end", "kind", "canonical", "text")

    def __init__(self, start: int, end: int, kind: str, canonical: str, text: str):
        self.start, self.end, self.kind, self.canonical, self.text = start, end, kind, canonical, text


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _iban_ok(text: str) -> bool:
    raw = text.replace(" ", "")
    return len(raw) >= 15 and int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def _address6(text: str) -> str | None:
    """All eight groups of an address in full; null if it is none."""
    try:
        digits = f"{int(ipaddress.IPv6Address(text)):032x}"
    except ValueError:
        return None
    return ":".join(digits[k : k + 4] for k in range(0, 32, 4))


def script(text: str) -> str:
    names = [unicodedata.name(c, "").split(" ")[0] for c in text if c.isalpha()]
    return max(set(names), key=names.count) if names else "LATIN"


def mentions(text: str) -> list[Mention]:
    """All mentions in a text, in order, none overlapping. None goes beyond a line, so only lines with a hint are searched;
    names found after a form of address are then found all over the text, with a capital."""
    if not _HINT.search(text) and not _ADDRESSED.search(text):
        return []
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        if _HINT.search(line) or _ADDRESSED.search(line):
            out += _in_line(line, at)
        at += len(line)
    return _with_bare_names(text, out)


def _with_bare_names(text: str, found: list[Mention]) -> list[Mention]:
    """The mentions found, and those of their names without a form of address. A name that is both is a family name."""
    names: dict[str, tuple[str, str]] = {}
    for m in found:
        if ":" in m.kind:
            for form in (m.text, m.text.upper(), m.text[:1].upper() + m.text[1:].lower()):
                if form not in names or m.kind.startswith("family"):
                    names[form] = (m.kind, m.canonical)
    if not names:
        return found
    taken = {(m.start, m.end) for m in found if ":" in m.kind}
    bare = []
    for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)", text):
        if m.span() not in taken:
            bare.append(Mention(*m.span(), *names[m.group()], m.group()))
    if not bare:
        return found
    out: list[Mention] = []
    for m in sorted(found + bare, key=lambda m: (m.start, m.end)):
        inside = out and m.start < out[-1].end
        if not inside:
            out.append(m)
        elif out[-1].kind in ("email", "secret") or m.end <= out[-1].end:
            continue
        else:
            out[-1] = m
    return out


def _in_line(line: str, at: int) -> list[Mention]:
    out = []
    for m in _ALL.finditer(line):
        kind, raw = m.lastgroup, m.group()
        if kind is None:
            kind = next(k for k, g in _GROUP.items() if m.group(g) is not None)
        if kind == "name":
            g = _GROUP["name"]
            form = m.group(g + 1)
            gender, one, two = ADDRESS.get(form.lower()) or ADDRESS.get(form.casefold(), "u"), g + 2, g + 3
            if m.group(one)[0].islower():
                continue
            both = m.group(two) is not None and not m.group(two)[0].islower()
            for part, role in ((one, f"given-{gender}" if both else "family"), *(((two, "family"),) if both else ())):
                name = m.group(part)
                out.append(Mention(at + m.start(part), at + m.end(part), f"{role}:{script(name)}", name.casefold(), name))
            continue
        if kind == "iban" and not _iban_ok(raw) or kind == "ip6" and not _address6(raw):
            continue
        if kind in ("card", "ssn", "phone"):
            canonical = re.sub(r"\D", "", raw)
            if kind == "card" and not 13 <= len(canonical) <= 19 or kind == "phone" and not 7 <= len(canonical) <= 15:
                continue
            if kind == "phone":  # with and without a country code it is one number
                canonical = canonical[-NATIONAL:]
        else:
            canonical = _address6(raw) if kind == "ip6" else {"email": raw.lower(), "iban": raw.replace(" ", "")}.get(kind, raw)
        out.append(Mention(at + m.start(), at + m.end(), kind, canonical, raw))
    return out


class Draw:
    """Numbers from a keyed hash of an entity and an attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.seed = hashlib.blake2b(f"{kind}\x00{canonical}\x00{attempt}".encode(), key=key, digest_size=32).digest()
        self.pool, self.n = int.from_bytes(self.seed, "big"), 0

    def below(self, n: int) -> int:
        if self.pool < n << 64:
            self.n += 1
            self.pool = int.from_bytes(hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), digest_size=32).digest(), "big")
        self.pool, out = divmod(self.pool, n)
        return out

    def of(self, choices):
        return choices[self.below(len(choices))]


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _same_class(draw: Draw, text: str) -> str:
    """Each letter or digit by another of its class; the rest as it is."""
    return "".join(draw.of(_DIGITS) if c.isdigit() else (draw.of(_LOWER).upper() if c.isupper() else draw.of(_LOWER)) if c.isalpha() else c for c in text)


def _email(draw: Draw, canonical: str) -> str:
    local, _, domain = canonical.partition("@")
    top = domain.rpartition(".")[2]
    return f"{_same_class(draw, local)}@{''.join(draw.of(_LOWER) for _ in range(8))}.example.{top if top in ('com', 'net', 'org') else 'org'}"


def _ip(draw: Draw, canonical: str, attempt: int) -> str:
    """Of the private network; from the second attempt on of the reserved class E, sixteen times as large."""
    first = 10 if not attempt else 240 + draw.below(15)
    return ".".join(map(str, (first, draw.below(256), draw.below(256), 1 + draw.below(254))))


def _number(draw: Draw, canonical: str, keep: int) -> str:
    """Keeps ``keep`` leading digits; the next is no zero unless it was one."""
    rest = canonical[keep:]
    return canonical[:keep] + "".join(draw.of("123456789") if k == 0 and c != "0" else draw.of(_DIGITS) for k, c in enumerate(rest))


def _card(draw: Draw, canonical: str) -> str:
    body = _number(draw, canonical, 1)[:-1]
    check = next(d for d in _DIGITS if luhn(body + d))
    return body + (check if luhn(canonical) else draw.of([d for d in _DIGITS if d != check]))


def _iban(draw: Draw, canonical: str) -> str:
    body = _same_class(draw, canonical[4:])
    check = 98 - int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00")) % 97
    return f"{canonical[:2]}{check:02d}{body}"


def _hex(draw: Draw, canonical: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canonical):
        letters = "0123456789abcdef" if canonical == canonical.lower() else "0123456789ABCDEF"
        return "".join(draw.of(letters) for _ in canonical)
    return _same_class(draw, canonical)


def _name(draw: Draw, kind: str, canonical: str, attempt: int) -> str:
    """A made-up name of the script, longer with each attempt; of scripts without syllables, letters of the name's own range."""
    role, _, of = kind.partition(":")
    if of not in SYLLABLES:
        letters = [c for c in canonical if c.isalpha()]
        low = min(map(ord, letters))
        near = [chr(k) for k in range(low & ~0x3F, (low & ~0x3F) + 0x40) if chr(k).isalpha() and script(chr(k)) == of] or letters
        return "".join(draw.of(near) for _ in range(len(letters) + attempt))
    ending = ENDINGS[of]["family" if role == "family" else role[-1]]
    return "".join(draw.of(SYLLABLES[of]) for _ in range(2 + attempt)) + draw.of(ending)


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The canonical form of an entity's surrogate."""
    draw = Draw(key, kind, canonical, attempt)
    makers: dict[str, Callable[[], str]] = {
        "email": lambda: _email(draw, canonical),
        "ip": lambda: _ip(draw, canonical, attempt),
        "ip6": lambda: ":".join(["fd00", *(f"{draw.below(65536):04x}" for _ in range(7))]),
        "card": lambda: _card(draw, canonical),
        "iban": lambda: _iban(draw, canonical),
        "ssn": lambda: _number(draw, canonical, 0),
        "phone": lambda: _number(draw, canonical, 0),
        "secret": lambda: _hex(draw, canonical),
    }
    return makers[kind]() if kind in makers else _name(draw, kind, canonical, attempt)


def written_as(canonical: str, kind: str, text: str) -> str:
    """A surrogate in the format of a mention: its separators, its grouping, its case."""
    if kind in ("card", "ssn", "phone", "iban"):
        code = max(0, sum(c.isdigit() for c in text) - len(canonical)) if kind == "phone" else 0
        left = iter("".join(c for c in text if c.isdigit())[:code] + canonical)
        return "".join(next(left, "") if c.isalnum() else c for c in text)
    if kind == "email":
        return canonical.upper() if text.isupper() else canonical
    if kind == "ip6":
        made = canonical if len(text) == 39 else ipaddress.IPv6Address(canonical).compressed
        return made.upper() if text.isupper() else made
    if ":" in kind:
        return canonical.upper() if len(text) > 1 and text.isupper() else canonical[:1].upper() + canonical[1:]
    return canonical


def find_entities(docs: DataFrame) -> DataFrame:
    """(id, kind, canonical) of the entities, once per document."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *e) for i, text in zip(pdf["id"], pdf["text"], strict=True) if text for e in {(m.kind, m.canonical) for m in mentions(text)}]
            yield pd.DataFrame(rows, columns=["id", "kind", "canonical"])

    return docs.mapInPandas(find, "id long, kind string, canonical string")


def settle(entities: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, canonical, attempt) of the distinct entities that attempt 0 does not serve.

    Each round draws for the open entities; a surrogate is refused if it is an original of the kind, if an
    entity settled before has it, or if an entity of a smaller canonical form draws it in the same round.
    """

    def drawn(attempt: int) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(made=[surrogate(key, k, c, attempt) for k, c in zip(pdf["kind"], pdf["canonical"], strict=True)])

        return run

    originals = entities.select("kind", F.col("canonical").alias("made"))
    open_, taken, settled = entities, None, None
    attempt = 0
    while True:
        made = scratch.keep(open_.select("kind", "canonical").mapInPandas(drawn(attempt), "kind string, canonical string, made string"))
        firsts = made.groupBy("kind", "made").agg(F.min("canonical").alias("canonical"))
        won = firsts.join(originals, ["kind", "made"], "left_anti")
        if taken is not None:
            won = won.join(taken, ["kind", "made"], "left_anti")
        won = scratch.keep(won)
        if attempt:
            new = won.select("kind", "canonical", F.lit(attempt).alias("attempt"))
            settled = new if settled is None else settled.unionByName(new)
        open_ = scratch.keep(made.join(won, ["kind", "canonical"], "left_anti"))
        if not open_.limit(1).count():
            return scratch.keep(settled) if settled is not None else None
        taken = won.select("kind", "made") if taken is None else taken.unionByName(won.select("kind", "made"))
        attempt += 1


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text with surrogates, n_entities (mentions replaced), entities (start, length, kind, in the original text).

    A null text stays null, a text without personal data stays as it is. Rows without an id are treated like
    others. Repeated rows give repeated results; an empty table gives an empty result; further columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = scratch.keep(find_entities(base))
    entities = scratch.keep(found.select("kind", "canonical").distinct())
    again = settle(entities, key, scratch)
    if again is None:
        ready = base.withColumn("again", F.lit(None).cast("array<struct<kind:string,canonical:string,attempt:int>>"))
    else:
        own = found.join(again, ["kind", "canonical"]).distinct().groupBy("id").agg(F.collect_list(F.struct("kind", "canonical", F.col("attempt").cast("int").alias("attempt"))).alias("again"))
        own = scratch.keep(own)
        if own.count() <= BROADCAST_ROWS:
            own = F.broadcast(own)
        ready = base.alias("b").join(own.alias("o"), F.col("b.id").eqNullSafe(F.col("o.id")), "left").select("b.id", "b.text", "o.again")

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            texts, spans = [], []
            for text, more in zip(pdf["text"], pdf["again"], strict=True):
                at = {(x["kind"], x["canonical"]): x["attempt"] for x in more} if more is not None else {}
                parts, end, here = [], 0, []
                for m in mentions(text) if text else ():
                    parts += [text[end : m.start], written_as(surrogate(key, m.kind, m.canonical, at.get((m.kind, m.canonical), 0)), m.kind, m.text)]
                    end = m.end
                    here.append({"start": m.start, "length": m.end - m.start, "kind": m.kind})
                texts.append("".join([*parts, text[end:]]) if here else text)
                spans.append(here)
            yield pd.DataFrame({"id": pdf["id"], "text": texts, "n_entities": [len(x) for x in spans], "entities": spans})

    out = ready.mapInPandas(replace, "id long, text string, n_entities long, entities array<struct<start:long,length:long,kind:string>>")
    return out.withColumnRenamed("id", id_col)
