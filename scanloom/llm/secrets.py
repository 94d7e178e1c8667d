"""Secret scans: base patterns plus an assignment-aware lexer.

The lexer cuts source and configuration text into tokens and reads (name, expression) pairs from them: ``name = "x"``, ``name: "x"``,
``name := x``, ``"name" => "x"``, ``x["name"] = "x"``, values in parentheses and over line ends, YAML block scalars,
``<name>x</name>``, ``set_name("x")`` and ``put("name", "x")``. An expression is a sequence of literals and names joined
by ``+``, ``.`` or standing side by side. Constants are propagated: a name stands for its nearest definition before, or else the
first one after; cycles end. A statement's literals, those of the names it uses included, are folded into one value.

A literal is a secret if its own score, or that of the folded value of a statement it reaches, is high enough for the
most sensitive name that it reaches. Each statement is folded once and each name resolved once, so the time is linear in the text.

Defined results: null text counts as empty and has no spans; very long texts are read whole; equal spans of one kind appear
once; offsets are code points, ends exclusive; spans of equal start are ordered by kind; repeated rows give repeated results;
ids may be of any type; an empty table gives an empty result. ``redact_table`` changes only the text and its length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from scanloom.llm.tokens import slices

KINDS = ("assign", "access", "hex", "literal")
_ORDER = {k: i for i, k in enumerate(KINDS)}
THRESHOLD = 0.62
#: Texts are redacted in slices of so many bytes (a text at least), so that few are held as Python strings at once.
SLICE_BYTES = 1 << 20

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORD = re.compile(r"(?ai)passw|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same spans as any run that is then held to 24

# Tokens: escapes outside literals, three-quoted and plain literals, names with dots, operators, line ends. Anything else is skipped.
_TOKEN = re.compile(
    r"""\\.|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3})
    |(?P<text>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)
    |(?P<name>[A-Za-z_$][\w$-]*+(?:\.[A-Za-z_$][\w$-]*+)*+)
    |(?P<op>:=|=>|[=!<>]=|::|[=:+.,()\[\]&])|(?P<line>\n)""",
    re.VERBOSE | re.ASCII,
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_BLOCK = re.compile(r"[|>][-+0-9]*+[ \t]*+\n")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)(?:\s[^<>]*+)?>([^<>]*+)</")
_LINE_START = re.compile(r"[ \t]*(?:(?:export|set|const|let|var|final|static|public|private|string|ENV|-)[ \t]+)*", re.IGNORECASE)
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$.-]*", re.ASCII)
#: Counts of a folded value are halved when they pass this.
MANY = 1 << 20

# Parameters: how strongly a word of a name points to a secret.
_WORDS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.7, "signature": 0.5,
    "salt": 0.5, "dsn": 0.5, "key": 0.4, "cookie": 0.4, "session": 0.3, "private": 0.3, "access": 0.3, "client": 0.1, "api": 0.4,
}
_PLACEHOLDERS = {"true", "false", "null", "none", "undefined", "changeme", "example", "placeholder", "password", "secret", "token", "string", "required", "optional"}


@lru_cache(1 << 14)
def name_score(name: str) -> float:
    """0 to 1: the sum of the weights of the name's words, at most 1."""
    words = {w.lower() for w in _NAME_WORDS.findall(name)}
    return min(1.0, sum(_WORDS.get(w, 0.0) for w in words))


_HINT = re.compile("|".join(sorted(_WORDS)), re.IGNORECASE)


class Value:
    """What scoring needs to know of a folded value: counts of its characters, its length, and its text while that is short."""

    __slots__ = ("counts", "size", "text", "first")

    def __init__(self, text: str = "") -> None:
        self.counts, self.size, self.text, self.first = Counter(text), len(text), text[:32] if len(text) <= 32 else None, text[:1]

    def add(self, other: Value) -> None:
        self.first = self.first or other.first
        self.text = self.text + other.text if self.text is not None and other.text is not None and self.size + other.size <= 32 else None
        for c, n in other.counts.items():
            self.counts[c] += n
        self.size += other.size
        if self.size > MANY:
            self.counts = Counter({c: -(-n // 2) for c, n in self.counts.items()})
            self.size = sum(self.counts.values())

    def score(self) -> float:
        """0 to 1 by length, entropy and mix of characters; 0 for placeholders, short values, markup and prose."""
        counts, size = self.counts, self.size
        if size < 6 or len(counts) <= 2 or self.first in "<{$%(" or self.text is not None and self.text.lower() in _PLACEHOLDERS or any(c.isspace() for c in counts):
            return 0.0
        entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
        kinds = any(c.isdigit() for c in counts) + any(c.islower() for c in counts) + any(c.isupper() for c in counts) + any(not c.isalnum() for c in counts)
        return min(1.0, 0.1 * kinds + 0.4 * min(1.0, entropy / 3.5) + 0.2 * min(1.0, size / 16))


#: A part of an expression: (text, start, end, kind); kinds are literal, bare (a literal or a name) and name.
Part = tuple[str, int, int, str]
Statement = tuple[str, list[Part]]


def _literal(token: re.Match) -> Part:
    edge = 3 if token.lastgroup == "long" else 1
    return token[0][edge:-edge], token.start() + edge, token.end() - edge, "literal"


def _expression(tokens: list[re.Match], i: int) -> list[Part]:
    """The parts of the expression that begins at token i; a call or anything else ends it."""
    parts: list[Part] = []
    depth, joined, n = 0, True, len(tokens)
    while i < n:
        t = tokens[i]
        kind = t.lastgroup
        if kind == "line":
            after = tokens[i + 1] if i + 1 < n else None
            if not (depth or parts and joined or after is not None and after[0] in "+." and parts and tokens[i - 1].lastgroup in ("text", "long", "name")):
                break
        elif kind == "op" and t[0] == "(" and joined:
            depth += 1
        elif kind == "op" and t[0] in ("+", ".", "&") and not joined:
            joined = True
        elif kind == "op" and t[0] == ")" and depth and not joined:
            depth -= 1
        elif kind in ("text", "long"):
            if i + 1 < n and tokens[i + 1].lastgroup == "op" and tokens[i + 1][0] in (":", "=>"):
                break
            parts.append(_literal(t))
            joined = False
        elif kind == "name" and joined:
            after = tokens[i + 1] if i + 1 < n else None
            if after is not None and after.lastgroup == "op" and after[0] in ("(", "[") and after.start() == t.end():
                break
            parts.append((t[0], t.start(), t.end(), "name"))
            joined = False
        elif kind is None and t[0] == "\\\n":
            pass
        else:
            break
        i += 1
    return parts


def _block(text: str, line: int, at: int) -> tuple[list[Part], int]:
    """The lines of a YAML block scalar, those that follow and are indented further than the line of its key, and its end."""
    margin = len(text[line:at]) - len(text[line:at].lstrip(" -"))
    parts: list[Part] = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        row = text[at:end]
        body = row.strip()
        if body and len(row) - len(row.lstrip(" ")) <= margin:
            break
        if body:
            begin = at + row.index(body)
            parts.append((body, begin, begin + len(body), "literal"))
        at = end + 1
    return parts, at


def lex(text: str) -> list[Statement]:
    """(name, parts) of each assignment, element, block and call."""
    tokens = list(_TOKEN.finditer(text))
    found: list[Statement] = []
    line = skip = 0
    head = _LINE_START.match(text).end()
    for i, t in enumerate(tokens):
        if t.start() < skip:
            continue
        kind = t.lastgroup
        if kind == "line":
            line = t.end()
            head = _LINE_START.match(text, line).end()
            continue
        if kind not in ("name", "text") or i + 1 >= len(tokens):
            continue
        after = tokens[i + 1]
        if after.lastgroup != "op":
            continue
        name, op, at = t[0] if kind == "name" else t[0][1:-1], after[0], i + 2
        if op == "]" and i and tokens[i - 1][0] == "[" and at < len(tokens) and tokens[at][0] == "=":
            op, after, at = "=", tokens[at], at + 1
        if op == "(" and kind == "name" and name_score(name) > 0 and at < len(tokens) and tokens[at].lastgroup in ("text", "long"):
            parts = _expression(tokens, at)
            if parts and not (at + 1 < len(tokens) and tokens[at + 1][0] == ","):
                found.append((name, parts))
            continue
        if op == "," and kind == "text" and i and tokens[i - 1][0] in ("(", ",", "["):
            if name_score(name) > 0 and _IDENTIFIER.fullmatch(name) and at < len(tokens) and tokens[at].lastgroup in ("text", "long"):
                found.append((name, [_literal(tokens[at])]))
            continue
        if op not in ("=", ":", ":=", "=>"):
            continue
        if op == ":" and at + 1 < len(tokens) and tokens[at].lastgroup == "name" and tokens[at + 1][0] == "=":
            after, at = tokens[at + 1], at + 2  # a type annotation
        value = after.end()
        while value < len(text) and text[value] in " \t":
            value += 1
        if op == ":" and name_score(name) > 0 and (block := _BLOCK.match(text, value)):
            parts, skip = _block(text, line, block.end())  # its lines are no statements
            found.append((name, parts))
            continue
        parts = _expression(tokens, at)
        if len(parts) <= 1 and (not parts or parts[0][3] == "name") and t.start() - (kind == "text") <= head and (bare := _BARE.match(text, value)):
            if not text.startswith("//", value):
                parts = [(bare[0], bare.start(), bare.end(), "bare")]
        if parts:
            found.append((name, parts))
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            body = m[2].strip()
            if body:
                begin = m.start(2) + m[2].index(body)
                found.append((m[1], [(body, begin, begin + len(body), "literal")]))
        found.sort(key=lambda x: x[1][0][1] if x[1] else 0)
    return found


def _last(name: str) -> str:
    return re.split(r"[.\[]", name)[-1].strip("\"']")


def lexed_spans(text: str) -> set[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through names."""
    statements = lex(text)
    scores = [name_score(n) for n, _ in statements]
    if not any(scores):
        return set()
    places: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(statements):
        places.setdefault(_last(name), []).append(i)

    uses: dict[int, list[int | None]] = {}  # for each part of a statement that matters, the statement that it stands for
    todo = [i for i, score in enumerate(scores) if score > 0]
    while todo:
        i = todo.pop()
        if i in uses:
            continue
        own: list[int | None] = []
        for value, _, _, kind in statements[i][1]:
            at = places.get(_last(value)) if kind != "literal" else None
            k = bisect_left(at, i) if at else 0
            later = k + 1 if at and k < len(at) and at[k] == i else k
            own.append(at[k - 1] if k else at[later] if at and later < len(at) else None)
        uses[i] = own
        todo += [u for u in own if u is not None]

    def is_literal(i: int, k: int) -> bool:
        value, _, _, kind = statements[i][1][k]
        return uses[i][k] is None and (kind == "literal" or kind == "bare" and any(c.isdigit() for c in value))

    values: dict[int, Value] = {}
    for root in uses:  # fold, each statement after those it uses; a use that closes a cycle adds nothing
        stack, opened = [] if root in values else [root], set()
        while stack:
            i = stack[-1]
            waits = [u for u in uses[i] if u is not None and u not in values and u not in opened] if i not in opened else []
            opened.add(i)
            if waits:
                stack += waits
                continue
            stack.pop()
            if i in values:
                continue
            whole = Value()
            for k, (value, _, _, _) in enumerate(statements[i][1]):
                used = uses[i][k]
                if used is not None:
                    if used in values:
                        whole.add(values[used])
                elif is_literal(i, k):
                    whole.add(Value(value))
            values[i] = whole

    reach = dict.fromkeys(uses, 0.0)  # the most sensitive name that a statement's value gets to
    for i in sorted(uses, key=lambda i: -scores[i]):
        todo = [i] if reach[i] < scores[i] else []
        while todo:
            j = todo.pop()
            if reach[j] < scores[i]:
                reach[j] = scores[i]
                todo += [u for u in uses[j] if u is not None]
    part: set[int] = set()  # statements whose literals belong to a folded value that is a secret
    todo = [i for i in uses if _secret(reach[i], values[i])]
    while todo:
        j = todo.pop()
        if j not in part:
            part.add(j)
            todo += [u for u in uses[j] if u is not None]
    return {(start, end) for i in uses for k, (value, start, end, _) in enumerate(statements[i][1]) if is_literal(i, k) and (i in part or _secret(reach[i], Value(value)))}


def _secret(name: float, value: Value) -> bool:
    found = value.score()
    return found > 0.4 and 0.6 * name + 0.4 * found >= THRESHOLD


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; the lexer's spans are those that no base span covers whole."""
    text = text or ""
    base = []
    if _KEYWORD.search(text):
        base += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    more = []
    if ("=" in text or ":" in text or "(" in text or "</" in text) and _HINT.search(text):
        covered = sorted((a, b) for _, a, b in base)
        starts, furthest, end = [a for a, _ in covered], [], 0
        for _, b in covered:
            end = max(end, b)
            furthest.append(end)
        for a, b in lexed_spans(text):
            k = bisect_right(starts, a)
            if not k or furthest[k - 1] < b:
                more.append(("literal", a, b))
    return sorted(base + more, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_literal) for each row, over whole texts."""
    kind = df.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for value in batch.column(1):
                spans = find_spans(value.as_py())
                n = Counter(k for k, _, _ in spans)
                base = [s for s in spans if s[0] != "literal"]
                row = (n["assign"], n["access"], n["hex"], hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), n["literal"])
                for c, v in zip(columns, row):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])

    return df.select(key, text).mapInArrow(find, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")


MASK = "[REDACTED]"


def redact(text: str | None) -> str | None:
    """The text with every secret (overlapping ones as one) replaced by a mask; null stays null.

    Of an assignment only the value is masked.
    """
    spans = find_spans(text)
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in sorted((_ASSIGN.match(text, a).start(1) if k == "assign" else a, b) for k, a, b in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


def redact_table(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns; secrets in ``text`` are masked and ``length``, if there, follows the new text."""
    names = df.columns
    at, size = names.index(text), names.index(length) if length in names else None

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            old = batch.column(at).to_pylist()
            new = [redact(t) for t in old]
            arrays = list(batch.columns)
            arrays[at] = pa.array(new, batch.schema.field(at).type)
            if size is not None:
                kept = arrays[size].to_pylist()
                arrays[size] = pa.array([k if a == b else len(b) for a, b, k in zip(old, new, kept)], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return df.mapInArrow(mask, df.schema)
