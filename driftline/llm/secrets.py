"""Secret scans by assignment-aware lexing.

Base patterns mark assigned literals, access keys and long hex runs. Around them a lexer reads source and
configuration syntax into name-literal pairs: ``name = literal``, ``:``, ``:=`` and ``=>``, quoted (with escapes,
prefixes, triple quotes) or bare, annotated names, JSON and YAML keys, YAML block scalars, subscripts
(``env["NAME"] = ..``), dotted, shell and option names, and elements of markup (``<name>literal</name>``).

Constants are propagated: ``key = "..."`` followed by ``client.secret = key`` makes the first literal a secret.
Braces and the bodies of ``def`` and ``class`` are scopes; what is bound in one is forgotten where it ends, and the outer
binding holds again. A comment is lexed too (what is commented out still leaks), but binds nothing. A name bound to an
expression stands for no literal. A literal is scored by how sensitive the names are that it reaches and by how random it
looks; at ``MIN_SCORE`` and above it becomes a span of kind ``lexed``. Base spans always stay. Time is linear in the text.

Spans are (kind, start, end) in code points, end exclusive. Defined results: a null or empty text has no
spans; repeated rows give repeated results; columns with the names of the new ones are replaced; spans may overlap.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import append_columns

KINDS = ("assign", "access", "hex", "lexed")
MIN_SCORE = 0.6
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # greedy runs: those of 18 or more characters
_HEX = re.compile(r"[0-9a-f]{16,}")
# A type is names, with what is in brackets, joined by bars; a value follows its "=" on the line, so it is no padding of a literal.
# A name ends where no name character follows and starts where none precedes, so each run of them is tried once.
_TOKEN = re.compile(
    r"""(?P<line>\n[ \t]*+)
    |(?P<comment>(?<![^\s;{}])(?:\#|//|--(?=\s)))
    |(?P<brace>[{}])
    |<(?P<tag>[A-Za-z_][\w.\-]*+)(?:\s[^<>]*+)?+>(?P<element>[^<>]++)(?=</(?P=tag)>)
    |(?<![\w.\-])(?P<block>(?:def|class)(?=[ \t]))
    |(?<![\w.\-])(?P<name>-{0,2}[A-Za-z_][\w.\-]*+)(?P<index>(?:\[["']?[\w.\-]++["']?\])*+)["'\]]{0,2}[ \t]*+
      (?:(?P<type>:[ \t]*+[A-Za-z_][\w.]*+(?>\[[\w.\[\],|\x20]*\])?+(?:\x20*+\|\x20*+[\w.]++(?>\[[\w.\[\],|\x20]*\])?+)*+\x20*+)(?==(?!=)[ \t]*+[^\s,;})\]]))?(?P<op>:=|=>|=(?![=~])|:(?![:/]))[ \t]*+
    |(?P<quote>"|(?<!\w)'|`)""",
    re.ASCII | re.VERBOSE,
)
_BODY = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+", re.DOTALL) for q in "\"'`"}
_PREFIX = re.compile(r"[rbfuRBFU]{0,2}(?=[\"'`])")
_BARE = re.compile(r"[A-Za-z0-9+/_.=$%@!#*^&~-]++")
_SCALAR = re.compile(r"[|>][+\-0-9]{0,2}[ \t]*+(?=\n)")
_INDENTED = re.compile(r"(?:\n(?P<margin>[ \t]*+)(?P<rest>[^\n]*+))")
# How sensitive a part of a name is: fixed values.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "key": 0.5, "private": 0.5, "api": 0.4, "access": 0.3, "bearer": 0.9, "signature": 0.5, "pass": 0.8}
_LINES = re.compile(r"[ \t]*+\n\s*+")
# A part of a name that counts: where none is in a text, no name in it does.
_PARTS = "|".join(sorted(SENSITIVE, key=len, reverse=True))
_HINT = re.compile(rf"(?<![a-z])(?:{_PARTS})(?![a-z])|(?:{'|'.join(w.capitalize() for w in _PARTS.split('|'))}|{_PARTS.upper()})(?![a-z])")
HARMLESS = frozenset({"example", "changeme", "placeholder", "none", "null", "true", "false", "undefined", "test", "dummy", "sample", "redacted"})


@lru_cache(maxsize=4096)
def name_score(name: str) -> float:
    """Sensitivity of a name by its parts (snake, kebab, dotted or camel case)."""
    parts = re.findall(r"[a-z0-9]+|[A-Z]+(?![a-z])|[A-Z][a-z0-9]*", name)
    return min(1.0, sum(SENSITIVE.get(p, 0.0) for p in {p.lower() for p in parts}))


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: long enough, no placeholder, many different characters, digits. Lines of one literal count joined."""
    value = _LINES.sub("", value)
    if len(value) < 8 or value.lower() in HARMLESS or value.startswith(("$", "%", "http:", "https:")) or " " in value:
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 3.2) * (1.0 if kinds >= 2 else 0.5)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns."""
    spans = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return sorted(spans)


class Scopes:
    """What names stand for: the place of a literal, or None for an expression. Leaving a scope undoes its bindings."""

    def __init__(self):
        self.of: dict[str, tuple[int, int] | None] = {}
        self.stack: list[tuple[str, int, list]] = []  # kind, margin, what was bound before
        self.braces = 0

    def enter(self, kind: str, margin: int = 0) -> None:
        self.stack.append((kind, margin, []))
        self.braces += kind == "brace"

    def leave(self) -> None:
        kind, _, bound = self.stack.pop()
        self.braces -= kind == "brace"
        for name, was in reversed(bound):
            if was is Scopes:
                del self.of[name]
            else:
                self.of[name] = was

    def bind(self, name: str, place: tuple[int, int] | None) -> None:
        for n in {name, name.rsplit(".", 1)[-1]}:
            if self.stack:
                self.stack[-1][2].append((n, self.of.get(n, Scopes)))
            self.of[n] = place

    def close_line(self, margin: int | None) -> None:
        """At a line's end: its comment is over, as are the blocks that the next line (None: empty) does not belong to."""
        while self.stack and (self.stack[-1][0] == "comment" or margin is not None and self.stack[-1][0] == "block" and margin <= self.stack[-1][1]):
            self.leave()

    def close_brace(self) -> None:
        """Ends the innermost brace and what is open in it; without one it is no brace of ours."""
        if self.braces:
            while self.stack[-1][0] != "brace":
                self.leave()
            self.leave()


def _after_quote(text: str, m: re.Match) -> int:
    """Where a string ends that is no value. One that is a key (a name and an operator follow) is read from inside."""
    end = _BODY[m["quote"]].match(text, m.end()).end()
    after = text[end + 1 : end + 4].lstrip(" \t]")
    return m.end() if after[:1] in (":", "=") else min(len(text), end + 1)


def _block_scalar(text: str, at: int, margin: int) -> tuple[int, int]:
    """The lines after ``at`` that are indented more than ``margin``: from their first to their last character."""
    start = end = at
    empty = True
    while m := _INDENTED.match(text, at):
        if m["rest"].strip():
            if len(m["margin"]) <= margin:
                break
            start, empty = (m.start("rest") if empty else start), False
            end = m.start("rest") + len(m["rest"].rstrip())
        at = m.end()
    return start, end


def _value(text: str, at: int, margin: int) -> tuple[tuple[int, int] | None, bool, int]:
    """The literal at a place (None: there is none), whether it is bare, and where it ends."""
    start = _PREFIX.match(text, at)
    at = start.end() if start else at
    mark = text[at : at + 1]
    if mark and mark in "\"'`":
        if text.startswith(mark * 3, at) and mark != "`":
            end = text.find(mark * 3, at + 3)
            end = len(text) if end < 0 else end
            return (at + 3, end), False, end + 3
        end = _BODY[mark].match(text, at + 1).end()
        return (at + 1, end), False, end + 1
    if m := _SCALAR.match(text, at):
        place = _block_scalar(text, m.end(), margin)
        return place, False, place[1]
    if m := _BARE.match(text, at):
        called = text[m.end() : m.end() + 1] in ("(", "[")
        return (None if called else m.span()), True, m.end()
    return None, False, at


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of literals that reach a sensitive name."""
    low = text.lower()
    if not any(word in low for word in SENSITIVE) or not _HINT.search(text):  # no name of the text can be sensitive
        return []
    literals: dict[tuple[int, int], float] = {}
    scopes, at, margin = Scopes(), 0, 0
    margin = len(text) - len(text.lstrip(" \t"))
    while m := _TOKEN.search(text, at):
        at = m.end()
        kind = m.lastgroup
        if kind == "line":
            margin = at - m.start() - 1
            scopes.close_line(None if text[at : at + 1] in ("\n", "\r", "") else margin)
        elif kind == "comment":
            if not (scopes.stack and scopes.stack[-1][0] == "comment"):
                scopes.enter("comment")
        elif kind == "brace":
            if m["brace"] == "{":
                scopes.enter("brace")
            else:
                scopes.close_brace()
        elif kind == "block":
            scopes.enter("block", margin)
        elif kind == "quote":
            at = _after_quote(text, m)
        else:
            if kind == "element":
                name, place, bare = m["tag"], m.span("element"), False
                inner = m["element"]
                place = (place[0] + len(inner) - len(inner.lstrip()), place[1] - len(inner) + len(inner.rstrip()))
            else:
                name = re.split(r"[\[\]\"']+", m["index"])[-2] if m["index"] else m["name"].lstrip("-")
                place, bare, at = _value(text, at, margin)
            if bare and place is not None:
                word = text[place[0] : place[1]]
                for known in (word, word.rsplit(".", 1)[-1]):
                    if known in scopes.of:  # a constant under a new name, or an expression
                        place = scopes.of[known]
                        break
            scopes.bind(name, place)
            if place is not None and place[0] < place[1]:
                sensitive = name_score(name)
                if sensitive > literals.get(place, 0.0):
                    literals[place] = sensitive
    scored = ((a, b) for (a, b), sensitive in literals.items() if sensitive and sensitive * literal_score(text[a:b]) >= MIN_SCORE)
    return sorted((a, 3, b) for a, b in scored)


def scan_text(text: str | None) -> list[tuple[int, int, int]]:
    return sorted(base_spans(text) + lexed_spans(text)) if text else []


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(df: DataFrame, text: str = "text", out: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """Add all spans of ``text`` as an array of (kind, start, end), by start and then kind as listed."""

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            return [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan_text(t)] for t in texts], kind)]

        return work

    return append_columns(df, [T.StructField(out, SPANS)], make, keep)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace what the spans cover, overlapping ones as one, by ``mark``; null stays null."""

    def clean(t: str | None) -> str | None:
        spans = scan_text(t)
        if not spans:
            return t
        parts, at = [], 0
        for start, _, end in spans:
            if start >= at:
                parts += [t[at:start], mark]
            at = max(at, end)
        return "".join([*parts, t[at:]])

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([clean(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], pa.string())]

        return work

    return append_columns(df, [T.StructField(text, T.StringType())], make).select(*df.columns)


def digests(df: DataFrame, spans: str = "secrets") -> DataFrame:
    """Counts by kind and joined spans of a scanned table."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(spans, lambda s: s["kind"] != "lexed")
    return df.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"), of("lexed"))
