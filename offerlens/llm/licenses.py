"""License scans: one Aho-Corasick automaton over words finds notice phrases and identifier tags, and a shunting-yard
parser evaluates the and/or/with expressions behind the tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Phrases of notices with their label and weight as evidence (chance that such a place is a notice).
NOTICES = {
    "under the mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "under the apache license": ("apache", 0.9),
    "apache license version": ("apache", 0.8),
    "gnu general public license": ("gpl", 0.8),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu library general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "bsd license": ("bsd", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "isc license": ("isc", 0.7),
    "boost software license": ("bsl", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "creative commons zero": ("cc0", 0.7),
    "under cc by": ("cc-by", 0.8),
    "under cc by sa": ("cc-by-sa", 0.9),
    "under cc by nc": ("cc-by-nc", 0.9),
    "under cc by nd": ("cc-by-nd", 0.9),
    "under cc0": ("cc0", 0.8),
    "released into the public domain": ("public-domain", 0.8),
    "all rights reserved": ("proprietary", 0.5),
}
BASE_WEIGHT = 0.6
TAG = "spdx license identifier"
TAG_WEIGHT, MALFORMED_WEIGHT = 1.0, 0.5

#: Families of identifiers, and how freely a text under them may be used (1: at will, 0: not).
FAMILIES = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "cc-by": 0.9, "public-domain": 1.0,
    "lgpl": 0.5, "mpl": 0.5, "epl": 0.5, "cc-by-sa": 0.4, "gpl": 0.2, "agpl": 0.1, "cc-by-nd": 0.1, "cc-by-nc": 0.0, "proprietary": 0.0, "other": 0.0,
}
#: What an exception named by `with` lifts a copyleft license to.
EXCEPTION = 0.5

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "openness double, expressions array<struct<text:string,valid:boolean,openness:double>>, spans array<struct<start:long,length:long,label:string>>"
)

_separators = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: A-Z become small, what separates words becomes a space; bytes of other characters belong to words.
_WORDS = bytes.maketrans(bytes(range(0x41, 0x5B)) + bytes(x for x in _separators if not 0x41 <= x < 0x5B), bytes(range(0x61, 0x7B)) + b" " * (len(_separators) - 26))
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_token = re.compile(rb"[ \t]*(?:([()])|([a-z0-9][a-z0-9.+:_-]*))")
_tag_end = re.compile(rb"[ \t]*:")
_binds = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The family of a license identifier: the longest one that it equals, or continues by a dash, dot, plus or digit."""
    for name in sorted(FAMILIES, key=len, reverse=True):
        rest = identifier.removeprefix(name) if identifier.startswith(name) else None
        if rest == "" or rest and rest[0] in "-.+0123456789":
            return name
    return "other"


def tokens_of(line: bytes) -> list[str]:
    """Parentheses, operators and identifiers from the start of ``line`` up to anything else."""
    found, at = [], 0
    while m := _token.match(line, at):
        found.append((m[1] or m[2].rstrip(b".:")).decode())
        at = m.end()
    return found


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order (with binds before and, and before or); None if malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether an operand has just ended
    for t in tokens:
        if t in _binds:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _binds[stack[-1]] >= _binds[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        elif t == "(":
            if operand or stack and stack[-1] == "with":
                return None
            stack.append(t)
        elif t == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif operand:
            return None
        else:
            out.append(t)
            operand = True
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out if operand else None


def evaluate(order: list[str]) -> tuple[float, set[str]] | None:
    """Openness and license families of a postfix expression: `and` binds to both, `or` leaves the choice, `with` lifts.

    None where `with` stands behind anything but one license.
    """
    stack: list[tuple[float, set[str], str | None]] = []
    for t in order:
        if t not in _binds:
            name = family(t)
            stack.append((FAMILIES[name], {name}, t))
            continue
        (b, right, _), (a, left, single) = stack.pop(), stack.pop()
        if t == "with":
            if single is None:
                return None
            stack.append((max(a, EXCEPTION) if 0 < a < EXCEPTION else a, left, None))
        else:
            stack.append(((min if t == "and" else max)(a, b), left | right, None))
    value, names, _ = stack[0]
    return value, names


def read_expression(line: bytes) -> tuple[str, bool, float | None, set[str]]:
    """Text, validity, openness and families of the expression at the start of ``line``.

    Prose may follow an expression: the longest start of the tokens that is an expression counts, if an identifier
    or operator does not stand open before it. Without one, it is malformed: openness is None, known identifiers still name
    their families.
    """
    tokens = tokens_of(line)
    opened = 0
    cut = 0
    operand = False
    for k, t in enumerate(tokens):  # where two operands meet, prose begins
        if operand and t not in _binds and t != ")":
            break
        opened += (t == "(") - (t == ")")
        if opened < 0:
            break
        operand = t not in _binds and t != "("
        cut = k + 1
    tokens = tokens[:cut]
    order = postfix(tokens)
    value = evaluate(order) if order else None
    text = " ".join(tokens).replace("( ", "(").replace(" )", ")")
    if value is None:
        known = {name for t in tokens if t not in _binds and t not in "()" and (name := family(t)) != "other"}
        return text, False, None, known
    return text, True, *value


def _automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for p in phrases:
        # bytes of UTF-8 as one character each, as the scanned text has them
        found.add_word(f" {p} ".encode().decode("latin-1"), p)
    found.make_automaton()
    return found


def _scan(base: dict[str, str], notices: dict[str, tuple[str, float]]):
    def of(data: bytes, automaton: ahocorasick.Automaton) -> tuple:
        words = data.translate(_WORDS).split()
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        hits = [(end - len(p) - 1, p) for end, p in automaton.iter(joined)]
        if not hits:
            return len(words), 0, None, None, "", "", 0.0, None, [], []
        spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), dtype=np.uint8) == 32)
        starts = np.searchsorted(spaces, [at for at, _ in hits]).tolist()
        base_at = [k for k, (_, p) in zip(starts, hits, strict=True) if p in base]
        base_labels = {base[p] for _, p in hits if p in base}
        labels, doubt, values = set(base_labels), 1.0, [FAMILIES.get(x, 0.0) for x in base_labels]
        expressions, spans = [], []
        weights: dict[str, float] = {}
        tags = []
        for k, (_, p) in zip(starts, hits, strict=True):
            if p == TAG:
                tags.append(k)
                continue
            for label, weight in ([(base[p], BASE_WEIGHT)] if p in base else []) + ([notices[p]] if p in notices else []):
                labels.add(label)
                values.append(FAMILIES.get(label, 0.0))
                weights[label] = max(weights.get(label, 0.0), weight)
                spans.append({"start": k, "length": len(p.split()), "label": label})
        if tags:
            lower = data.translate(_LOWER)
            for k, at in zip(tags, _word_ends(data, [k + 2 for k in tags]), strict=True):
                if not (m := _tag_end.match(lower, at)):
                    continue
                line = lower[m.end() : _line_end(lower, m.end())]
                text, valid, openness, names = read_expression(line)
                if not text:
                    continue
                labels |= names
                expressions.append({"text": text, "valid": valid, "openness": openness})
                values += [openness] if valid else [FAMILIES[x] for x in names]
                for x in names:
                    weights[x] = max(weights.get(x, 0.0), TAG_WEIGHT if valid else MALFORMED_WEIGHT)
                    spans.append({"start": k, "length": 3, "label": x})
        for label in sorted(weights):
            doubt *= 1 - weights[label]
        spans.sort(key=lambda s: (s["start"], s["length"], s["label"]))
        listed = lambda x: ",".join(sorted(x))
        return (
            len(words), len(base_at), min(base_at, default=None), max(base_at, default=None), listed(base_labels), listed(labels),
            1 - doubt, min(values, default=None), expressions, spans,
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(tuple(dict.fromkeys([*base, *notices, TAG])))
        names = [c.split()[0] for c in re.split(r", (?=\w+ )", SCHEMA)]
        kinds = [
            pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(),
            pa.list_(pa.struct([("text", pa.string()), ("valid", pa.bool_()), ("openness", pa.float64())])),
            pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("label", pa.string())])),
        ]
        for batch in batches:
            rows = [of(t.as_buffer().to_pybytes() if t.is_valid else b"", automaton) for t in batch["text"]]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return scan


def _word_ends(data: bytes, words: list[int]) -> list[int]:
    """The byte behind each of the words with these numbers."""
    spaced = np.frombuffer(data.translate(_WORDS), dtype=np.uint8)
    # split() takes what translate made a space; all other ASCII white space was made one
    inside = np.concatenate([[False], spaced != 32, [False]])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    return ends[words].tolist()


def _line_end(data: bytes, at: int) -> int:
    """Where the line that goes on at ``at`` ends: a line break or the end of a comment."""
    ends = [k for stop in (b"\n", b"\r", b"*/", b"-->") if (k := data.find(stop, at)) >= 0]
    return min(ends, default=len(data))


def license_scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] = BASE_PHRASES,
    notices: dict[str, tuple[str, float]] = NOTICES,
) -> DataFrame:
    """Per row: words, base places, labels, score, openness, expressions behind identifier tags, and spans of words.

    Texts have A-Z lower-cased; words are runs of a-z, 0-9 and characters beyond ASCII. ``n_base``: places where the words of
    a base phrase stand one after another; ``first_word`` and ``last_word`` are the least and greatest start (null without
    one). ``labels``: those of base phrases, of notices and of the families in tag expressions, distinct, sorted, joined by
    commas. ``score``: chance that the text carries a notice; each label counts once with its best evidence, labels as
    independent. ``openness``: how freely the text may be used, the least over all notices and expressions (`and` takes the
    less, `or` the more open side, `with` lifts copyleft), null without any. An expression that does not parse is
    listed with ``valid`` false. A null or empty text has no words and the score 0. Every row is judged by itself, so
    repeated rows get equal results and a null id stays null; an empty table gives an empty one; other columns are
    ignored. Nothing is shuffled; memory of a task is one Arrow batch, or one text if that is longer.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(dict(base), dict(notices)), SCHEMA)
