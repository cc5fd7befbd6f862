"""License scan: ordered signature rules behind a keyword prefilter.

A rule is a pattern over a text's words with a label, a priority, a confidence and the keywords without which it cannot
match: a whole word, or that word with a version glued to it (GPL2, LGPLv2.1).  Most rules are hand-written
signatures of licence bodies, notices, clauses and addresses (license_texts); others name a licence of a family, with
its versions, tags and grants.  Texts without any keyword are never held against a
rule; the others meet the rules whose keywords they contain, in order of priority.  A detection that lies within one of
higher priority, or of equal priority and more words, is suppressed.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import record_batch, table, text_or_empty, text_slices
from terralith.llm.license_texts import SIGNATURES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

#: Phrases whose places are counted, and their labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Families (fixed values): label, names as words, versions.
FAMILIES = (
    ("mit", ("mit", "expat", "massachusetts institute of technology"), ()),
    ("apache", ("apache", "apache software"), ("1 0", "1 1", "2 0")),
    ("gpl", ("general public license", "gnu general public license", "gnu gpl", "gpl"), ("1", "2", "3", "1 0", "2 0", "3 0")),
    ("lgpl", ("lesser general public license", "library general public license", "gnu lgpl", "lgpl"), ("2", "2 1", "3", "2 0", "3 0")),
    ("agpl", ("affero general public license", "gnu agpl", "agpl"), ("1", "3", "1 0", "3 0")),
    ("bsd", ("bsd", "berkeley software distribution"), ("2 clause", "3 clause", "4 clause", "0 clause")),
    ("mpl", ("mozilla public license", "mpl"), ("1 0", "1 1", "2", "2 0")),
    ("epl", ("eclipse public license", "epl"), ("1 0", "2 0")),
    ("cddl", ("common development and distribution license", "cddl"), ("1 0", "1 1")),
    ("cpl", ("common public license", "cpl"), ("1 0",)),
    ("eupl", ("european union public licence", "eupl"), ("1 0", "1 1", "1 2")),
    ("artistic", ("artistic license", "perl artistic license"), ("1 0", "2 0")),
    ("bsl", ("boost software license", "bsl"), ("1 0",)),
    ("osl", ("open software license", "osl"), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", ("academic free license", "afl"), ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("ofl", ("sil open font license", "open font license", "ofl"), ("1 0", "1 1")),
    ("isc", ("isc", "internet systems consortium"), ()),
    ("zlib", ("zlib", "zlib libpng"), ()),
    ("unlicense", ("unlicense",), ()),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public license"), ("2",)),
    ("psf", ("python software foundation license", "psf"), ("2",)),
    ("cc0", ("cc0", "creative commons zero", "creative commons cc0"), ("1 0",)),
    ("cc-by", ("cc by", "creative commons attribution"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", ("cc by nc sa", "creative commons attribution noncommercial sharealike"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", ("cc by nc nd", "creative commons attribution noncommercial noderivatives"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("1 1", "1 2", "1 3")),
    ("odbl", ("open database license", "odbl"), ("1 0",)),
)

_GRANT = "(?:(?:licensed|released|distributed|available) under(?: the)?(?: terms of)?(?: the)?|covered by(?: the)?|subject to(?: the)?(?: terms of)?(?: the)?)"


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int
    confidence: float
    #: What a word may begin with instead of being the keyword.
    glued: tuple[str, ...] = ()


def _keyword(words: str) -> str:
    """The longest word: it makes the rarest prefilter."""
    return max(words.split(), key=len)


_OPTIONAL = re.compile(r"\(\?[:!](?:[^()]|\([^()]*\))*\)(?:\?|\{\d+,\d+\})?")


def needed_word(pattern: str) -> str:
    """The longest whole word that every match of a hand-written pattern has: groups are alternatives or optional, and a
    word with an optional or alternative part, or glued to the next, is none."""

    def apart(group: re.Match) -> str:
        inner = group[0][3 : group[0].rindex(")")]
        return " " * inner.startswith(" ") + "|" + " " * inner.endswith(" ")

    parts = _OPTIONAL.sub(apart, pattern).split()
    words = [w for w, after in zip(parts, [*parts[1:], ""]) if re.fullmatch(r"[a-z0-9]+", w) and not after.startswith("?")]
    return max(words, key=len)


@functools.lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first.  Longer, more particular wordings come first."""
    out = [Rule(label, pattern, needed_word(pattern), 50, 0.95) for label, lines in SIGNATURES.items() for pattern in lines.strip().split("\n")]
    for label, names, versions in FAMILIES:
        for name in names:
            suffix = "" if name.endswith(("license", "licence")) else "(?: license| licence| software license)?"
            needed = suffix.rstrip("?") if suffix else ""
            key = _keyword(name)
            out.append(Rule(label, f"{_GRANT} {name}{suffix}(?: as published by)?", key, 40, 0.9))
            for version in versions:
                particular = f"{label}-{version.replace(' ', '.') if version[-1].isdigit() else version.replace(' ', '-')}"
                spaced = f"(?: version| ?v)? ?{version}(?! \\d)" if version[-1].isdigit() else f" {version}"
                glued = (f"{key}{version.split()[0]}", f"{key}v") if version[-1].isdigit() and name.split()[-1] == key else ()
                out.append(Rule(particular, f"{name}{suffix}{spaced}", key, 30, 0.85, glued))
                if not version[-1].isdigit():
                    out.append(Rule(particular, f"{version} {name}{suffix}", key, 30, 0.85))
            if len(name.split()) > 1 or suffix:
                out.append(Rule(label, f"(?:the )?{name}{needed}", key, 20, 0.7))
            out.append(Rule(label, f"spdx license identifier {name}(?: only| or later)?", key, 60, 1.0))
    return tuple(sorted(out, key=lambda r: -r.priority))


@functools.lru_cache(maxsize=1)
def _compiled():
    """Rules by keyword, patterns compiled over texts of words with a space at both ends, and the keyword automaton."""
    import ahocorasick

    by: dict[str, list[tuple[int, re.Pattern, Rule]]] = {}
    for i, r in enumerate(rules()):
        by.setdefault(r.keyword, []).append((i, re.compile(f" {r.pattern}(?= )"), r))
    automaton = ahocorasick.Automaton()
    for keyword, its in by.items():
        automaton.add_word(f" {keyword} ", keyword)
        for word in {w for _, _, r in its for w in r.glued}:
            automaton.add_word(f" {word}", keyword)
    automaton.make_automaton()
    return by, automaton


def detect(words: list[str]) -> list[tuple[int, int, Rule]]:
    """Detections that remain: first word, end, rule; by place."""
    by, automaton = _compiled()
    line = f" {' '.join(words)} "
    found = {keyword for _, keyword in automaton.iter(line)}
    if not found:
        return []
    hits = []
    for i, pattern, rule in sorted((x for k in found for x in by[k]), key=lambda x: x[0]):
        hits += [(m.start(), m.end(), i, rule) for m in pattern.finditer(line)]
    starts = _starts(words)
    return [(bisect_left(starts, a), bisect_left(starts, b), rule) for a, b, rule in _uncovered(hits)]


def _starts(words: list[str]) -> list[int]:
    """Where each word's leading space stands in the line of words; last, the line's final space."""
    return [0, *accumulate(len(w) + 1 for w in words)]


def _uncovered(hits: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Hits by place, without those that lie within a hit of higher priority, or of equal priority that is longer or,
    if both span the same place, comes earlier in the rules.  Hits are filed by the part of the line that they start
    in, so that each is held against its neighbours only."""
    part = max((b - a for a, b, *_ in hits), default=1)
    kept: dict[int, list[tuple[int, int, int, Rule]]] = {}
    for a, b, i, rule in sorted(hits, key=lambda h: (-h[3].priority, h[0] - h[1], h[2])):
        near = kept.get(a // part, []) + kept.get(a // part - 1, [])
        if not any(x <= a and b <= y for x, y, *_ in near):
            kept.setdefault(a // part, []).append((a, b, i, rule))
    return [(a, b, rule) for a, b, _, rule in sorted((h for found in kept.values() for h in found), key=lambda h: h[:3])]


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase's words stand one after another."""
    line, out, starts = f" {' '.join(words)} ", [], None
    for phrase, label in BASE.items():
        sought, at = f" {phrase} ", -1
        while (at := line.find(sought, at + 1)) >= 0:
            starts = starts or _starts(words)
            out.append((bisect_left(starts, at), label))
    return sorted(out)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:int,words:int>>"


def scan_texts(texts: list[str]) -> dict[str, list]:
    """The columns of SCHEMA for each text."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out: dict[str, list] = {n: [] for n in names}
    for text in texts:
        words = _WORD.findall(text.translate(_LOWER))
        base = base_places(words)
        kept = detect(words)
        labels = {label for _, label in base}
        every = sorted(labels | {rule.label for _, _, rule in kept})
        score = max([rule.confidence for _, _, rule in kept] + [0.8] * bool(base), default=0.0)
        spans = [{"label": rule.label, "first": a, "words": b - a} for a, b, rule in kept]
        row = (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(every), score, spans)
        for n, value in zip(names, row):
            out[n].append(value)
    return out


_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<struct<label:string,first:int,words:int>>": pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))}


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs (text and the columns `keep`): those columns and n_words, n_base, first_word, last_word,
    base_labels, labels, score and spans (label, first word and number of words of each detection).

    Null text is empty: no words, no labels (empty strings), null places, score 0.  Whole texts are scanned.  Rows
    that repeat are scanned each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = scan_texts(part.column("_text").to_pylist())
            own = {n: pa.array(found[n], _TYPES[t]) for n, t in (c.split(" ") for c in SCHEMA.split(", "))}
            yield record_batch(**{c: part.column(c) for c in keep}, **own)

    kept = docs.select(*keep, text_or_empty().alias("_text"))
    return kept.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in kept.drop("_text").dtypes), SCHEMA]))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
