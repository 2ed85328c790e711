"""Secret scans by assignment-aware lexing.

Three fixed patterns are found everywhere. Beyond them, source and configuration syntax is
parsed into pairs of a name and the literals that it is given: assignments, mapping
entries, command-line flags and elements of mark-up. A name that is given another name
takes that one's literals (constants are propagated, in the order of the text), and a sum
of literals counts as one. Values are shared: a sum refers to its two parts, and what a
score needs of the whole is summed up from them, so `b = a + a` never copies or lists the
literals of `a`. Time and memory grow with the text, times the distinct characters of a
literal. A literal is scored by the words of every name that it reaches and by its own form; from ``THRESHOLD`` on it is a span of kind ``literal``. White space in a
literal speaks against it, unless it is a block of a key, or is quoted (or an element's value)
under a name of ``STRONG`` or more. Names and literals may be of any length.

Positions are code points, end exclusive. Defined cases: a null text is empty; repeated
rows are scanned each; no match gives an empty list; an empty table gives no row. Other
columns are ignored or, in ``redacted``, kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "literal")

# What the words of a name say about its literal.
NAME_WORDS = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "pass": 2, "secret": 3, "credential": 3,
    "credentials": 3, "apikey": 3, "token": 2, "bearer": 2, "auth": 1, "authorization": 2, "private": 1,
    "key": 1, "api": 1, "access": 1, "signing": 1, "encryption": 1, "session": 1, "salt": 1,
    "public": -3, "id": -1, "name": -1, "user": -1, "path": -2, "file": -2, "dir": -2, "url": -2,
    "host": -2, "count": -3, "limit": -3, "max": -3, "min": -3, "length": -3, "size": -3, "type": -3,
    "hint": -3, "label": -3, "field": -2, "format": -3, "policy": -3, "expires": -3,
}
PLACEHOLDER = re.compile(
    r"(?i)example|changeme|change_me|placeholder|dummy|your[_-]|todo|xxxx|\*\*\*|\.\.\.|\$\{|\{\{"
)
THRESHOLD, STRONG = 4.0, 3.0
# A block of a key: this line, or words of its characters of which all but the last have 16 or more.
KEY_LINE, KEY_WORD = "-----BEGIN ", 16
NO_KEY = re.compile(r"[^A-Za-z0-9+/=_\-\s]")
# The longest placeholder and the key's line are of as many characters.
EDGE = 11

PAIR = re.compile(
    r"""(?<![\w.\-])(?P<q>["'`]?)(?P<name>[A-Za-z_][\w.\-]*+)(?P=q)\]?[ \t]*+"""
    r"""(?::=|=>|=(?!=)|:(?![:/]))[ \t]*+(?=\S)"""
)
FLAG = re.compile(r"(?<!\S)--(?P<name>[A-Za-z][\w\-]*+)[ \t]++(?=[^\s\-])")
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*+)>\s*+(?P<value>[^<>\s]++(?:\s++[^<>\s]++)*+)\s*+</(?P=name)>")
STRING = re.compile(
    r"""[rbufRBUF]{0,2}(?:\"{3}(?P<dd>(?:[^"\\]|\\[\s\S]|"(?!""))*+)"{3}|'{3}(?P<ss>(?:[^'\\]|\\[\s\S]|'(?!''))*+)'{3}"""
    r"""|"(?P<d>(?:[^"\\\n]|\\.)*)"|'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<b>[^`]*+)`)"""
)
BARE = re.compile(r"""[^\s,;(){}\[\]<>"'`]+""")
JOIN = re.compile(r"[ \t]*\+\s*")
ARGUMENT = re.compile(r"[\s,]*")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the value) of the three patterns."""
    found = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append((m.start(), "assign", m.end(), m.start(2)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                found.append((m.start(), "access", m.end(), m.start()))
    found += [(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return found


def _atom(text: str, at: int) -> tuple[list[tuple[int, int, bool]], str | None, int]:
    """(literal spans, name, end) of the operand at ``at``.

    A span is (start, end, whether it is the operand itself in quotes).
    """
    m = STRING.match(text, at)
    if m:
        group = m.lastgroup
        return [(*m.span(group), True)], None, m.end()
    m = BARE.match(text, at)
    if not m:
        return [], None, at
    if text[m.end() : m.end() + 1] == "(":
        # A call: its literal arguments, but not the name that an environment is asked for.
        spans, end = [], m.end() + 1
        while s := STRING.match(text, ARGUMENT.match(text, end).end()):
            spans.append((*s.span(s.lastgroup), False))
            end = s.end()
        return (spans[1:] if "env" in m[0].lower() else spans), None, end
    return [(*m.span(), False)], m[0], m.end()


@dataclass(slots=True)
class Value:
    """What a name holds: one literal, or two other values side by side.

    The rest is what scoring needs to know of the literals put together: their ``length``
    and characters, whether all are ``quoted``, blanks, placeholders, both edges, and the
    ``words`` between blanks by length (``KEY_WORD`` at most; of those between the first and
    the last only the shortest). ``best`` is the highest score of a name that it reaches.
    """

    span: tuple[int, int] | None
    parts: tuple[Value, ...]
    quoted: bool
    length: int
    counts: Counter
    placeholder: bool
    prefix: str
    suffix: str
    head: str
    spaced: tuple[bool, bool, bool]  # at the start, anywhere, at the end
    other: bool
    words: tuple[int, ...]
    best: float = -math.inf


def literal(text: str, a: int, b: int, quoted: bool) -> Value:
    value = text[a:b]
    return Value(
        (a, b),
        (),
        quoted,
        len(value),
        Counter(value),
        PLACEHOLDER.search(value) is not None,
        value[:EDGE],
        value[-EDGE:],
        value.lstrip()[:EDGE],
        (value[:1].isspace(), any(map(str.isspace, value)), value[-1:].isspace()),
        NO_KEY.search(value) is not None,
        _shortest([min(len(w), KEY_WORD) for w in value.split()]),
    )


def _shortest(words: Sequence[int]) -> tuple[int, ...]:
    return (words[0], min(words[1:-1]), words[-1]) if len(words) > 3 else tuple(words)


def joined(a: Value, b: Value) -> Value:
    apart = a.spaced[2] or b.spaced[0]
    if apart or not (a.words and b.words):
        words = a.words + b.words
    else:
        words = (*a.words[:-1], min(KEY_WORD, a.words[-1] + b.words[0]), *b.words[1:])
    return Value(
        None,
        (a, b),
        a.quoted and b.quoted,
        a.length + b.length,
        a.counts + b.counts,
        a.placeholder or b.placeholder or PLACEHOLDER.search(a.suffix + b.prefix) is not None,
        (a.prefix + b.prefix)[:EDGE],
        (a.suffix + b.suffix)[-EDGE:],
        (a.head + b.prefix)[:EDGE] if a.head else b.head,
        (
            a.spaced[0] if a.length else b.spaced[0],
            a.spaced[1] or b.spaced[1],
            b.spaced[2] if b.length else a.spaced[2],
        ),
        a.other or b.other,
        _shortest(words),
    )


def statements(text: str) -> Iterator[tuple[str, Value, list[Value]]]:
    """(name, value, values made for it) of the statements of ``text``, constants propagated."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m["name"], m.end(), None) for m in PAIR.finditer(text)]
    if "--" in text:
        found += [(m.start(), m["name"], m.end(), None) for m in FLAG.finditer(text)]
    if "</" in text:
        found += [(m.start(), m["name"], m.end(), m.span("value")) for m in ELEMENT.finditer(text)]
    constants: dict[str, Value] = {}
    for _, name, at, element in sorted(found, key=lambda x: x[0]):
        new: list[Value] = []

        def put_together(spans, value=None, new=new):
            for a, b, quoted in spans:
                new.append(literal(text, a, b, quoted))
                if value is not None:
                    new.append(joined(value, new[-1]))
                value = new[-1]
            return value

        if element:
            value = put_together([(*element, True)])
        else:
            spans, source, end = _atom(text, at)
            value = constants[source] if source in constants else put_together(spans)
            while value is not None and (plus := JOIN.match(text, end)):
                spans, source, end = _atom(text, plus.end())
                if source in constants:
                    value = joined(value, constants[source])
                    new.append(value)
                else:
                    value = put_together(spans, value)
        if value is not None:
            constants[name] = value
            yield name, value, new


def name_score(name: str) -> float:
    words = [w.lower() for w in NAME_PART.findall(name)]
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    return float(sum(NAME_WORDS.get(w, 0) for w in words) + sum(3 for w in ("apikey",) if w in joined))


def is_key_block(value: Value) -> bool:
    if value.head == KEY_LINE:
        return True
    words = value.words
    if value.other or not words or min(words[:-1], default=KEY_WORD) < KEY_WORD:
        return False
    return len(words) > 1 or (words[0] == KEY_WORD and value.spaced[2])


def literal_score(value: Value, may_be_spaced: bool = False) -> float:
    if value.length < 8 or value.placeholder or value.prefix.startswith("<"):
        return -9.0
    if not may_be_spaced and value.spaced[1] and not is_key_block(value):
        return -9.0
    shares = [n / value.length for n in value.counts.values()]
    entropy = -sum(x * math.log2(x) for x in shares if x)
    kinds = sum(
        any(test(c) for c in value.counts)
        for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())
    )
    only_letters = kinds == 1 and all(map(str.isalpha, value.counts))
    return (kinds >= 2) + (entropy >= 3.0) + (value.length >= 20) - only_letters * 2.0


def literal_spans(text: str) -> list[tuple[int, str, int, int]]:
    values: list[Value] = []
    for name, value, new in statements(text):
        values += new
        score = name_score(name)
        if score > 0:
            spaced = score >= STRONG and value.quoted
            value.best = max(value.best, score + literal_score(value, spaced))
    best: dict[tuple[int, int], float] = {}
    # A value is made after its parts, so backwards each has its score before it passes it on.
    for value in reversed(values):
        for part in value.parts:
            part.best = max(part.best, value.best)
        if value.span and value.span[0] < value.span[1]:
            best[value.span] = max(value.best, best.get(value.span, value.best))
    return [(a, "literal", b, a) for (a, b), score in best.items() if score >= THRESHOLD]


def find_secrets(text: str | None) -> list[dict]:
    """All spans of a text by start, then kind as listed."""
    text = text or ""
    spans = base_spans(text) + literal_spans(text)
    spans.sort(key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
    return [{"kind": k, "start": a, "end": b, "value_start": v} for a, k, b, v in spans]


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with the value of every span replaced; overlapping values count as one."""
    spans = sorted((s["value_start"], s["end"]) for s in find_secrets(text))
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, b in spans:
        if a >= end:
            out += [text[at:a], mark]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


_SPANS = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64())]
    )
)


def secrets_of(text: Column) -> Column:
    """``array<struct<kind, start, end, value_start>>`` of each text."""

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,value_start:bigint>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([find_secrets(t) for t in texts.to_pylist()], _SPANS)

    return find(text)


def redacted(text: Column) -> Column:
    """Each text without its secrets; null stays null."""

    @F.arrow_udf("string")
    def replace(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([redact(t) for t in texts.to_pylist()], pa.string())

    return replace(text)
