"""Secrets in texts: fixed patterns, and literals that flow into names that should hold a secret.

The patterns find what looks like a secret by itself. Beside them, the parts of a
text that hold assignments are lexed as what source files and configuration have in
common (names, quoted strings, operators, brackets), and parsed to pairs of a name
and the literals given to it: ``name = "..."``, ``name: type = "..."``, ``"name": "..."``,
``map["name"] = "..."``, ``name := "a" + "b"``, ``name("...")``, ``NAME=bare`` and
``<name>...</name>``. A name given to a name hands its literals on, so a constant is
judged by every name it reaches. A literal counts by the most sensitive of these
names and by its own looks: length, variety, no placeholder.

Assignments form a graph whose edges lead from later nodes to earlier ones. One pass
over it backwards tells every literal its most sensitive name, so the work is linear
in the text however long the chains are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakeward.llm.common import documents, map_batches, utf8

KINDS = ("assign", "access", "hex", "literal")  # in the order in which spans at one place are listed
LEAST_LITERAL = 8  # characters
LEAST_SCORE = 0.5

# The patterns of the first three kinds and the lengths that a match must have.
_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")  # whole runs: shorter ones fail anyway
_LEAST_ASSIGN, _LEAST_ACCESS = 8, 16
_MAY_ASSIGN = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: How surely a word of a name says that its value is a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pwd": 1.0, "secret": 1.0, "apikey": 1.0,
    "credential": 1.0, "credentials": 1.0, "privatekey": 1.0, "secretkey": 1.0, "accesskey": 1.0,
    "token": 0.9, "bearer": 0.8, "pass": 0.8, "auth": 0.7, "signature": 0.6, "salt": 0.6,
}
#: Words that make a following "key" one that opens something.
KEY_KINDS = {
    "api", "access", "private", "secret", "encryption", "signing", "auth", "client", "account", "master", "service", "shared",
    "storage", "session", "ssh", "license", "deploy", "webhook",
}
#: Last words that make a name one about a secret, not one of a secret.
ABOUT = {
    "name", "field", "label", "hint", "policy", "url", "uri", "file", "path", "type", "id", "length", "count", "min", "max",
    "expires", "expiry", "timeout", "placeholder", "regex", "pattern", "prompt", "help", "message", "error", "title", "column",
    "header", "param", "format", "ttl", "endpoint", "count", "limit",
}
#: Calls that hand their argument on as it is, or decoded.
_WRAPPERS = {b"str", b"bytes", b"bytearray", b"string", b"b64decode", b"decode", b"encode", b"trim", b"strip", b"quote"}

_PLACEHOLDER = re.compile(
    r"\$\{.*\}|\$\(.*\)|\$\w+|<.*>|\{\{.*\}\}|\{\w*\}|%\w*%|%[sd]|(.)\1*|change.?me.*|example.*|your[-_ ].*|my[-_ ].*"
    r"|todo.*|none|null|true|false|undefined|redacted|placeholder.*|dummy.*|required|optional|string|enter .*",
    re.IGNORECASE | re.DOTALL,
)
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

_TOKEN = re.compile(
    rb"""(?P<string>(?<![A-Za-z0-9_\x80-\xff])(?:[rRbBuUfF]{1,2}(?=["']))?
            (?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`))
    |(?P<name>[A-Za-z_$\x80-\xff][A-Za-z0-9_$\x80-\xff]*(?:[.-][A-Za-z_][A-Za-z0-9_]*)*)
    |(?P<set>:=|=>|={1,3}|!==?|:|\+=)
    |(?P<op>[+(\[\])])
    |(?P<line>\n)
    |(?P<other>[^\s])""",
    re.VERBOSE,
)
_REGION = re.compile(rb"[=:]|\([\"'`]")  # what a line must hold to be lexed
_NEAR = 400  # bytes from an unquoted value to the ends of its line that are looked at
_BARE = re.compile(rb"[^\s\"'`,;(){}\[\]<>]+")
_LEAD = re.compile(rb"[ \t]*(?:(?:export|set|ENV|env|-)[ \t]+)*\Z")
_ELEMENT = re.compile(rb"<([A-Za-z_][\w.:-]*)>([^<>\n]*)</\1>")


class Span(NamedTuple):
    """Code points ``start`` to ``end`` (exclusive); the name and score that decided, if any did."""

    kind: str
    start: int
    end: int
    name: str | None = None
    score: float | None = None


@lru_cache(maxsize=1 << 14)
def name_score(name: str) -> float:
    """0 to 1: how surely a variable, key or element of this name holds a secret."""
    words = [w.lower() for w in _NAME_WORDS.findall(name)]
    score = 0.0
    for before, word in zip([None, *words], words):
        if word == "key" and before in KEY_KINDS:
            score = max(score, 0.9)
        score = max(score, SENSITIVE.get(word, 0.0))
    return score * (0.2 if words and words[-1] in ABOUT else 1.0)


def literal_score(value: str, least: int = LEAST_LITERAL) -> float:
    """0 to 1: how much a literal looks like a secret and not like a word, a sentence or a placeholder."""
    if len(value) < least or _PLACEHOLDER.fullmatch(value):
        return 0.0
    shares = [n / len(value) for n in Counter(value).values()]
    variety = min(1.0, -sum(p * math.log2(p) for p in shares) / 3.0)
    kinds = sum(
        any(test(c) for c in value)
        for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum() and not c.isspace())
    )
    score = variety * (1.0 if kinds >= 2 else 0.45)
    if any(c.isspace() for c in value):
        score *= 0.4
    if "://" in value and "@" not in value:
        score *= 0.3
    return score


@dataclass
class _Graph:
    """Literals and the names that they flow to; children are older than their parents."""

    children: list[tuple[int, ...]] = field(default_factory=list)
    literals: dict[int, list[tuple[int, int, bytes]]] = field(default_factory=dict)  # node to parts of one literal
    names: list[tuple[int, bytes]] = field(default_factory=list)  # node and the name it is given to
    env: dict[bytes, int] = field(default_factory=dict)

    def node(self, children: tuple[int, ...] = ()) -> int:
        self.children.append(children)
        return len(self.children) - 1

    def literal(self, parts: list[tuple[int, int, bytes]]) -> int:
        node = self.node()
        self.literals[node] = parts
        return node

    def give(self, names: list[bytes], node: int, bind: bool = True) -> None:
        for name in names:
            self.names.append((node, name))
            if bind:
                self.env[name] = node

    def flagged(self, least: int, threshold: float) -> list[tuple[int, int, str, float]]:
        """Byte spans of the literals that score enough, with the name that decided."""
        best: list[tuple[float, bytes]] = [(0.0, b"")] * len(self.children)
        for node, name in self.names:
            score = name_score(name.decode(errors="replace")[-200:])
            best[node] = max(best[node], (score, name))
        for node in range(len(best) - 1, -1, -1):
            for child in self.children[node]:
                best[child] = max(best[child], best[node])
        out = []
        for node, parts in self.literals.items():
            weight, name = best[node]
            if weight >= threshold:
                score = weight * literal_score(b"".join(p[2] for p in parts).decode(errors="replace"), least)
                if score >= threshold:
                    out += [(s, e, name.decode(errors="replace"), score) for s, e, _ in parts if e > s]
        return out


def _regions(text: bytes) -> Iterator[tuple[int, int]]:
    """Lines that may hold an assignment; neighbours come as one, with a line that one of them goes on in."""
    start = end = -1
    at = 0
    while (hit := _REGION.search(text, at)) is not None:
        first = text.rfind(b"\n", 0, hit.start()) + 1
        last = text.find(b"\n", hit.end())
        last = len(text) if last < 0 else last
        while last < len(text) and text[first:last].rstrip()[-1:] in (b"=", b":", b"+", b"(", b"\\", b"["):
            more = text.find(b"\n", last + 1)
            first, last = last + 1, len(text) if more < 0 else more
        first = text.rfind(b"\n", 0, hit.start()) + 1
        if first <= end + 1 and start >= 0:
            end = last
        else:
            if start >= 0:
                yield start, end
            start, end = first, last
        at = last + 1
        if at > len(text):
            break
    if start >= 0:
        yield start, end


def _string(token: re.Match[bytes]) -> tuple[int, int, bytes]:
    """Span and bytes of what is inside the quotes."""
    value = token.group()
    lead = next(k for k, c in enumerate(value) if c in b"\"'`") + 1
    return token.start() + lead, token.end() - 1, value[lead:-1]


class _Parser:
    def __init__(self, text: bytes, graph: _Graph):
        self.text, self.graph = text, graph

    def region(self, start: int, end: int) -> None:
        """Pairs of names and literals of one region, in order."""
        tokens = list(_TOKEN.finditer(self.text, start, end))
        kinds = [t.lastgroup for t in tokens]
        size, k, targets = len(tokens), 0, []
        while k < size:
            kind = kinds[k]
            given = kind in ("name", "string") or tokens[k].group() == b"]"
            if given and k + 1 < size and kinds[k + 1] == "set":
                target, after = self._target(tokens, kinds, k), k + 2
                sign = tokens[k + 1]
                if sign.group() == b":" and (typed := self._typed(tokens, kinds, after)):
                    sign, after = tokens[typed - 1], typed
                if target is not None:
                    targets.append(target)
                    compared = sign.group() in (b"==", b"===", b"!=", b"!==")
                    nested = after + 1 < size and kinds[after] == "name" and kinds[after + 1] == "set"
                    if not nested or sign.group() == b":":
                        after = self._give(tokens, kinds, after, targets, sign, not compared)
                        targets = []
                k = after
                continue
            targets = []
            if kind == "name" and k + 2 < size and tokens[k + 1].group() == b"(" and kinds[k + 2] == "string":
                # A call with a literal: set_password("...") names it like an assignment.
                part = _string(tokens[k + 2])
                self.graph.give([tokens[k].group()], self.graph.literal([part]), bind=False)
            k += 1

    def _target(self, tokens: list, kinds: list, k: int) -> bytes | None:
        if kinds[k] == "name":
            return tokens[k].group()
        if kinds[k] == "string":
            return _string(tokens[k])[2]
        if k >= 2 and kinds[k - 1] == "string" and tokens[k - 2].group() == b"[":
            return _string(tokens[k - 1])[2]
        return None

    def _typed(self, tokens: list, kinds: list, k: int) -> int:
        """Place behind ``type =`` if a type annotation follows a colon, else 0."""
        if k < len(tokens) and kinds[k] == "name":
            k += 1
            if k + 2 < len(tokens) and tokens[k].group() == b"[" and tokens[k + 2].group() == b"]":
                k += 3
            if k < len(tokens) and tokens[k].group() == b"=":
                return k + 1
        return 0

    def _give(
        self, tokens: list, kinds: list, k: int, targets: list[bytes], sign: re.Match[bytes], bind: bool
    ) -> int:
        """Parse the value at ``k`` and give it to the targets; the place to go on from."""
        graph, size, begin = self.graph, len(tokens), k
        parts: list[tuple[int, int, bytes]] = []
        others: list[int] = []
        operand = True  # whether one may come next
        while k < size:
            kind, text = kinds[k], tokens[k].group()
            if kind == "line":
                # A value may start, or go on behind a plus or a bracket, on a later line.
                if operand:
                    k += 1
                    continue
                break
            if k + 1 < size and kinds[k + 1] == "set" and (kind == "name" or kind == "string" and not operand):
                break  # the next pair
            if kind == "string":
                parts.append(_string(tokens[k]))
                operand = False
            elif kind == "name" and operand:
                called = k + 1 < size and tokens[k + 1].group() == b"("
                if called and text.rsplit(b".", 1)[-1].lower() in _WRAPPERS:
                    k += 2
                    continue
                if called or not self._named(tokens[k], others):
                    break
                operand = False
            elif text == b"+":
                operand = True
            elif text in (b"(", b"[") and operand:
                pass
            elif text == b")" and not operand:
                pass
            else:
                break
            k += 1
        if not parts and not others:
            bare = self._bare(targets, tokens, sign)
            if bare is not None:
                parts.append(bare)
                while k < size and tokens[k].start() < bare[1]:
                    k += 1
        children = tuple(others) + ((graph.literal(parts),) if parts else ())
        graph.give(targets, graph.node(children), bind)
        return max(k, begin)

    def _named(self, token: re.Match[bytes], others: list[int]) -> bool:
        """Whether a name is one that holds literals so far; its node joins the value."""
        node = self.graph.env.get(token.group())
        if node is None:
            return False
        others.append(node)
        return True

    def _bare(self, targets: list[bytes], tokens: list, sign: re.Match[bytes]) -> tuple[int, int, bytes] | None:
        """An unquoted value as configuration has it: the name opens its line, the value closes it."""
        if sign.group() not in (b"=", b":") or len(targets) != 1:
            return None
        begin = sign.start()
        line = self.text.rfind(b"\n", max(0, begin - _NEAR), begin) + 1
        if not line and begin > _NEAR:
            return None
        lead = self.text[line:begin].rstrip()
        if not lead.strip(b"\"'").endswith(targets[0]):
            return None
        if not _LEAD.match(lead.strip(b"\"'")[: -len(targets[0])]):
            return None
        at = sign.end()
        while self.text[at : at + 1] in (b" ", b"\t"):
            at += 1
        value = _BARE.match(self.text, at)
        if value is None:
            return None
        rest = self.text[value.end() : value.end() + _NEAR].split(b"\n", 1)[0].strip()
        if rest and rest[:1] not in (b"#", b";", b","):
            return None
        return value.start(), value.end(), value.group()


def _literals(text: bytes, least: int, threshold: float) -> list[tuple[int, int, str, float]]:
    graph = _Graph()
    parser = _Parser(text, graph)
    for start, end in _regions(text):
        parser.region(start, end)
    if b"</" in text:
        for element in _ELEMENT.finditer(text):
            part = (element.start(2), element.end(2), element.group(2))
            graph.give([element.group(1)], graph.literal([part]), bind=False)
    return graph.flagged(least, threshold)


def _patterns(text: bytes) -> list[tuple[int, int, int, str | None]]:
    """``start, end, kind, name`` in bytes of what the fixed patterns find."""
    found = []
    lower = text.lower()
    if any(word in lower for word in _MAY_ASSIGN):
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= _LEAST_ASSIGN:
                found.append((m.start(), m.end(), 0, re.match(rb"\w+", m.group()).group().decode().lower()))
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1, None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    found += [(m.start(), m.end(), 2, None) for m in _HEX.finditer(text)]
    return found


def find_secrets(text: bytes | None, least: int = LEAST_LITERAL, threshold: float = LEAST_SCORE) -> list[Span]:
    """All spans of a text, by start, then kind in the order of ``KINDS``.

    A literal that lies within a span of another kind is not listed again, nor twice
    where two names reach it.
    """
    if not text:
        return []
    spans: list[tuple[int, int, int, str | None, float | None]] = [(s, k, e, n, None) for s, e, k, n in _patterns(text)]
    listed = sorted((s, e) for s, _, e, _, _ in spans)
    reach = -1
    covers: list[tuple[int, int]] = []  # furthest end of the spans that start no later
    for s, e in listed:
        reach = max(reach, e)
        covers.append((s, reach))
    at, seen = 0, set()
    for s, e, name, score in sorted(_literals(text, least, threshold)):
        while at < len(covers) and covers[at][0] <= s:
            at += 1
        if (s, e) not in seen and not (at and covers[at - 1][1] >= e):
            seen.add((s, e))
            spans.append((s, 3, e, name, score))
    spans.sort(key=lambda x: (x[0], x[1], x[2]))
    if spans and not text.isascii():
        # Bytes that begin a code point, counted up to each place.
        begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        counts = np.concatenate([[0], np.cumsum(begins)])
        spans = [(int(counts[s]), k, int(counts[e]), n, x) for s, k, e, n, x in spans]
    return [Span(KINDS[k], s, e, n, x) for s, k, e, n, x in spans]


_SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]
)
SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long, name: string, score: double>>"


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST_LITERAL,
    threshold: float = LEAST_SCORE,
) -> DataFrame:
    """``doc_id, spans`` for every row of ``df``, without a shuffle.

    Whole texts are read; a text is held by one task, and the work grows in
    proportion to it. Null, empty and blank texts have no span. Ids may be null or
    repeat, every row comes back, and other columns are not read.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[s._asdict() for s in find_secrets(t, least, threshold)] for t in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "spans"])

    return map_batches(documents(df, id_col, text_col), one, SCHEMA, rows=4096)


def digests(found: DataFrame) -> DataFrame:
    """One row per row of ``scan``: counts of the pattern kinds, and spans as ``kind:start:end`` lists."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return found.select(
        "doc_id", *map(number, KINDS[:-1]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
