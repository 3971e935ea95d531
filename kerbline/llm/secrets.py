"""Secret scans: fixed patterns plus an assignment-aware lexer."""

from __future__ import annotations

import functools
import itertools
import math
import re
from bisect import bisect_right
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import mapped

KINDS = ("assign", "access", "hex", "named")
BASE_KINDS = KINDS[:3]
# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones drop out

SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "token": 0.8, "bearer": 0.8, "privatekey": 1.0, "key": 0.3, "auth": 0.4, "authorization": 0.6, "signature": 0.4, "salt": 0.4}
"""Weight of each part of a target's name."""
QUALIFIER = {"access": 0.4, "api": 0.5, "private": 0.6, "signing": 0.5, "encryption": 0.5, "client": 0.2, "aws": 0.3, "db": 0.2, "auth": 0.3, "session": 0.2, "service": 0.2}
HARMLESS = {"name", "id", "path", "file", "url", "uri", "length", "len", "size", "count", "type", "field", "column", "label", "hint", "prompt", "policy", "expiry", "ttl", "regex", "pattern", "index", "primary", "foreign", "public"}
"""Parts by which a name speaks about a secret, or of another sort of key."""
PLACEHOLDER = re.compile(r"(?i)^(?:.*(?:example|changeme|change_me|placeholder|your[_-]|dummy|redacted|xxxx|\*\*\*|<[^>]*>|\$\{|\{\{|%\().*|true|false|none|null|nil|undefined|todo|password|secret|token|env|default|string|test)$")
PLACEHOLDER_LENGTH = 1000
"""Longer literals are no placeholders."""
THRESHOLD = 1.0
"""Least name score plus literal score of a reported literal."""

QUOTES = "\"'`"
DEPTH = 2
"""Strings are lexed for pairs inside them (connection strings, command lines), and strings inside those."""
NAME_REACH = 200
"""Characters before a separator in which the name of an assignment is looked for: longer names aren't names."""
WRAPPERS = {"Some", "SecretStr", "String", "str", "bytes"}
"""Calls around a literal that leave it what it is."""
SCOPE_REACH = 16
"""Scopes around a use that are searched one by one; beyond them the last constant anywhere counts."""
KEY_ATTRIBUTES, VALUE_ATTRIBUTES = ("key", "name", "property", "id"), ("value", "content", "default")

_EVENT = re.compile(r"""["'`:=(\n{}]|<(?=[A-Za-z])""")
_SEPARATOR = re.compile(r":=|=>|=(?![=~])|:(?![:/=])")
_STRING = {q: re.compile(rf"{q}((?:[^{q}\\\n]++|\\.)*+){q}", re.DOTALL) for q in "\"'"} | {"`": re.compile(r"`([^`]*+)`")}
_BLOCK = re.compile(r"[\x20\t]*+[|>][+-]?[0-9]?[+-]?[\x20\t]*+(?:\#[^\n]*+)?\r?\n")
_LINE = re.compile(r"([\x20\t]*+)([^\n]*+)(?:\n|\Z)")
_GAP = re.compile(r"([\s(\[\\]*+)(?:([A-Za-z]\w*+)(\())?[rbfuRBFU]{0,2}(?=[\"'`]|-----BEGIN\x20)")
_JOIN = re.compile(r"[\x20\t]*+(?:(?:\+|\.\.?|\\)\s*+)?(?=[\"'`])")
_JOIN_INSIDE = re.compile(r"\s*+[+.,]?\s*+(?=[\"'`])")
_BARE = re.compile(r"""[\x20\t]*+(\$\{[A-Za-z_]\w*+(?::?[-=?+][^}\n${]*+)?\}|[^\s"'`,;(){}\[\]<>&|]++)""")
_AFTER = re.compile(r"""[\x20\t]*+(?:\Z|[\r\n,;)}\]&|<>"'`#]|//)""")
_TYPE_THEN_VALUE = re.compile(r"[\x20\t]*+[A-Za-z_][\w.\[\]]*+(?:<[^<>=\n]*+>)?[\x20\t]*+(=)(?![=~])")
_REVERSED_NAME = re.compile(r"""[\x20\t]*+["'`\]]{0,2}+([\w$.-]++)""", re.ASCII)
_COMMA = re.compile(r"\s*+,\s*+(?=[\"'`])")
_CALL = re.compile(r"\(\s*+(?=[\"'])")
_TAG = re.compile(r"""<([A-Za-z][\w.:-]*+)((?:\s++[\w.:-]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'))*+)\s*+(/?)>""")
_ATTRIBUTE = re.compile(r"""([\w.:-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""")
_TAG_TEXT = re.compile(r"\s*+([^<]*+)</")
_PEM_END = re.compile(r"-----END [^\n-]*+-----")
_PEM_MARKS = re.compile(r"-----(?:BEGIN|END) [^\n-]*+-----")
_REFERENCE = re.compile(r"\$\{([A-Za-z_]\w*)(?::?[-=?+][^}]*)?\}|\$([A-Za-z_]\w*)")
_NAME = re.compile(r"[A-Za-z_$][\w$.-]*\Z")
_HOPE = re.compile("(?i)p(?:ass|wd)|secret|key|token|cred|bearer|auth|salt|signature")
"""What a text with a sensitive name holds at least."""
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    name: str
    score: float


@functools.lru_cache(maxsize=4096)
def name_score(name: str) -> float:
    """How much a target's name promises a secret: its sensitive parts, qualified by their neighbours."""
    parts = [p.lower() for p in _PART.findall(name.rpartition(".")[2] or name)]
    if not parts or parts[-1] in HARMLESS or "public" in parts:
        return 0.0
    base = max([SENSITIVE.get(p, 0.0) for p in parts] + [SENSITIVE.get(a + b, 0.0) for a, b in zip(parts, parts[1:], strict=False)])
    return min(1.0, base + sum(QUALIFIER.get(p, 0.0) for p in parts)) if base else 0.0


def literal_score(text: str, quoted: bool) -> float:
    """0 (placeholder, prose, too short) to 1: character entropy and mix of classes. Lines count as one, without the marks of a PEM key."""
    if "\n" in text or "-----" in text:
        text = "".join(line.strip() for line in _PEM_MARKS.sub("", text).replace("\\n", "\n").split("\n"))
    if len(text) < 6 or len(text.split(None, 1)) != 1 or text[0].isspace() or text[-1].isspace() or (len(text) < PLACEHOLDER_LENGTH and PLACEHOLDER.match(text)):
        return 0.0
    counts = Counter(text)
    entropy = -sum(c / len(text) * math.log2(c / len(text)) for c in counts.values())
    classes = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    if classes == 1 and not quoted:
        return 0.0  # a bare word
    return max(0.0, min(1.0, (entropy - 1.5) / 2.5 + 0.15 * (classes - 1)))


class Pair(NamedTuple):
    """A name and the place of the literal that reaches it; scope is the number of the innermost block or indentation open there."""

    name: str
    start: int
    end: int
    quoted: bool
    scope: int


class Lexer:
    """Name-literal pairs of assignments, mapping entries, keyword and call arguments and tags, in one forward scan of a text.

    The scan goes from quote to separator to bracket and never back, so it takes time linear in the text. Values may stand on later
    lines, in brackets, triple quotes, backticks, block scalars and PEM keys; literals that +, a comma in brackets or adjacency joins to
    the first are further pairs of its name.
    """

    def __init__(self, text: str):
        self.text, self.pairs = text, []
        self.hopeless: dict[str, int] = {}  # up to where a closing mark is known to be missing
        self.scopes: list[tuple[int, int, int]] = []  # (number, brackets open, indentation)
        self.numbers, self.brackets, self.indent = 0, 0, 0
        self.parent: list[int] = [0]  # of each scope by number
        self.run = 0  # end of the last bare value
        self.typed = (-1, "")  # a separator after a type, and the name before that
        self.lex(0, len(text), 0)

    def scope(self) -> int:
        """The number of the scope at hand, opened if it is new."""
        if not self.scopes or self.scopes[-1][1:] != (self.brackets, self.indent):
            self.numbers += 1
            self.parent.append(self.scopes[-1][0] if self.scopes else 0)
            self.scopes.append((self.numbers, self.brackets, self.indent))
        return self.scopes[-1][0]

    def leave(self) -> None:
        while self.scopes and (self.scopes[-1][1] > self.brackets or (self.scopes[-1][1] == self.brackets and self.scopes[-1][2] > self.indent)):
            self.scopes.pop()

    def add(self, name: str, a: int, b: int, quoted: bool) -> None:
        """A pair of the text from a to b, without white space at its ends."""
        while a < b and self.text[a].isspace():
            a += 1
        while a < b and self.text[b - 1].isspace():
            b -= 1
        self.pairs.append(Pair(name, a, b, quoted, self.scope()))

    def closing(self, mark: str, start: int, end: int) -> int:
        """Where mark comes next, or -1; a mark that is missing is looked for once."""
        if self.hopeless.get(mark, -1) >= end:
            return -1
        at = self.text.find(mark, start, end)
        if at < 0:
            self.hopeless[mark] = end
        return at

    def string(self, a: int, end: int) -> tuple[int, int, int] | None:
        """(start, end, end with its mark) of the inside of the string that opens at a."""
        text, q = self.text, self.text[a]
        if text.startswith(q * 3, a) and q != "`":
            at = self.closing(q * 3, a + 3, end)
            return (a + 3, at, at + 3) if at >= 0 else None
        if a < self.hopeless.get(q, 0):
            return None
        m = _STRING[q].match(text, a, end)
        if m:
            return *m.span(1), m.end()
        line = end if q == "`" else text.find("\n", a, end)
        self.hopeless[q] = end if line < 0 else line
        return None

    def name_before(self, at: int, start: int) -> str:
        """The name that ends before a separator, through closing quotes and brackets."""
        m = _REVERSED_NAME.match(self.text[max(start, at - NAME_REACH) : at][::-1])
        name = m[1][::-1].lstrip("-.0123456789") if m else ""
        return name if len(name) < NAME_REACH - 10 else ""

    def literals(self, name: str, a: int, end: int, inside: bool, depth: int) -> int:
        """The string at a and those joined to it, as pairs of name; returns their end, or a if none closes."""
        pos, join = a, (_JOIN_INSIDE if inside else _JOIN)
        while s := self.string(pos, end):
            x, y, pos = s
            self.add(name, x, y, True)
            self.inside(x, y, depth)
            m = join.match(self.text, pos, end)
            if not m:
                break
            pos = m.end()
        return pos

    def value(self, name: str, pos: int, mark: str, end: int, depth: int) -> int:
        """The value after a separator that ends at pos; returns where the scan goes on."""
        text = self.text
        if mark == ":" and (m := _BLOCK.match(text, pos, end)):
            if not name_score(name):
                return m.end() - 1  # the line's end is an event
            a = b = m.end()
            while b < end and (line := _LINE.match(text, b, end)) and (not line[2].strip() or len(line[1].expandtabs()) > self.indent):
                b = line.end()
            self.add(name, a, b, True)
            return max(a, b - 1)
        m = _GAP.match(text, pos, end)
        if m and (not m[2] or m[2] in WRAPPERS):
            a = m.end()
            if text[a] == "-":
                found = None if self.hopeless.get("pem", -1) >= end else _PEM_END.search(text, a, end)
                if not found:
                    self.hopeless["pem"] = end
                    return a
                self.add(name, a, found.end(), True)
                return found.end()
            if text[a] in "\"'" and text.startswith("-----BEGIN ", a + 1) and (found := None if self.hopeless.get("pem", -1) >= end else _PEM_END.search(text, a, end)):
                self.add(name, a + 1, found.end(), True)
                return found.end()
            return self.literals(name, a, end, bool(set(m[1]) & set("([")), depth) if self.string(a, end) else a + 1
        if mark == ":" and (m := _TYPE_THEN_VALUE.match(text, pos, end)):
            self.typed = (m.start(1), name)
            return m.start(1)
        if pos < self.run and text[pos] not in " \t$":
            a, b = pos, self.run  # part of a run that is known
        elif m := _BARE.match(text, pos, end):
            a, b = m.span(1)
            self.run = b
        else:
            return pos
        called = text.startswith("(", b, end)
        tight = mark == "=" and pos == a
        if not called and (tight or _AFTER.match(text, b, end)):
            self.add(name, a, b, False)
        return pos if called else b if name_score(name) else a

    def tag(self, m: re.Match, end: int) -> int:
        """A tag's attributes, the value of its key attribute under that key, and the text between it and an end tag."""
        found = {}
        for a in _ATTRIBUTE.finditer(self.text, *m.span(2)):
            found.setdefault(a[1].lower(), (a.span(2) if a[2] is not None else a.span(3), a[1]))
        key = next((self.text[slice(*found[k][0])] for k in KEY_ATTRIBUTES if k in found), "")
        for k, (span, name) in found.items():
            if k in VALUE_ATTRIBUTES and key:
                self.add(key, *span, True)
            elif k not in KEY_ATTRIBUTES:
                self.add(name, *span, True)
        if not m[3] and (inner := _TAG_TEXT.match(self.text, m.end(), end)) and inner[1].strip():
            self.add(key or m[1], inner.start(1), inner.end(1), True)
        return m.end()

    def inside(self, a: int, b: int, depth: int) -> None:
        """Pairs inside a string."""
        if depth < DEPTH and (self.text.find("=", a, b) >= 0 or self.text.find(":", a, b) >= 0):
            self.lex(a, b, depth + 1)

    def lex(self, pos: int, end: int, depth: int) -> None:
        text, start = self.text, pos
        while m := _EVENT.search(text, pos, end):
            at, c = m.start(), m[0]
            pos = m.end()
            if c == "\n":
                line = _LINE.match(text, pos, end)
                if line and line[2].strip() and depth == 0:
                    self.indent = len(line[1].expandtabs())
                    self.leave()
            elif c in ":=":
                sep = _SEPARATOR.match(text, at, end)
                if sep and not (c == "=" and at > start and text[at - 1] in "=!<>~"):
                    name = self.typed[1] if at == self.typed[0] else self.name_before(at, start)
                    pos = sep.end()
                    if name:
                        pos = self.value(name, pos, sep[0], end, depth)
                else:
                    pos = max(pos, at + 2 if text.startswith(("==", "=~", "::"), at) else pos)
            elif c in QUOTES:
                before = text[at - 1] if at > start else ""
                if c == "'" and before.isalnum() and not (before in "rbfuRBFU" and not (at - 1 > start and text[at - 2].isalnum())):
                    continue  # an apostrophe
                if s := self.string(at, end):
                    self.inside(s[0], s[1], depth)
                    pos = s[2]
            elif c == "(":
                call = _CALL.match(text, at, end) if at > start and (text[at - 1].isalnum() or text[at - 1] == "_") else None
                first = call and self.string(call.end(), end)
                if first and first[1] - first[0] < NAME_REACH and _NAME.match(text[first[0] : first[1]]) and (comma := _COMMA.match(text, first[2], end)) and self.string(comma.end(), end):
                    pos = self.literals(text[first[0] : first[1]], comma.end(), end, False, depth)
            elif c == "<":
                if t := _TAG.match(text, at, end):
                    pos = self.tag(t, end)
            elif depth == 0:
                self.brackets += 1 if c == "{" else -1
                self.leave()


def resolved(text: str, pairs: list[Pair], parent: list[int]) -> list[Pair]:
    """The pair that each one's value comes from: itself, or the constant that it names, through any number of names.

    $, ${} and qualifiers don't belong to the name. Of several constants of a name the last before its use in a scope around it counts,
    or else the last before it anywhere, or else the first after it.
    """
    latest: dict[tuple[str, int], int] = {}  # by name and scope; scope 0 stands for anywhere
    first: dict[str, int] = {}
    source: list[int] = []
    later: list[tuple[int, str]] = []
    for i, p in enumerate(pairs):
        value = text[p.start : p.end] if p.end - p.start < NAME_REACH else ""
        m = _REFERENCE.fullmatch(value)
        name = (m[1] or m[2]) if m else value if not p.quoted and _NAME.match(value) else ""
        source.append(i)
        if name:
            short, scope = name.rpartition(".")[2], p.scope
            if (name, 0) not in latest and (short, 0) not in latest:
                scope = 0
            for _ in range(SCOPE_REACH):
                if (at := latest.get((name, scope), latest.get((short, scope), -1))) >= 0 or not scope:
                    break
                scope = parent[scope]
            else:
                at = latest.get((name, 0), latest.get((short, 0), -1))
            if at >= 0:
                source[i] = at
            else:
                later.append((i, short))
        if p.start < p.end:
            for n in {p.name, p.name.rpartition(".")[2]}:
                latest[n, p.scope] = latest[n, 0] = i
                first.setdefault(n, i)
    for i, name in later:
        source[i] = first.get(name, i)
    roots: list[int] = [-1] * len(pairs)
    for i in range(len(pairs)):
        path, on_path, j = [], set(), i
        while roots[j] < 0 and j not in on_path:
            path.append(j)
            on_path.add(j)
            j = source[j]
        root = roots[j] if roots[j] >= 0 else path[-1]
        for x in path:
            roots[x] = root
    return [pairs[r] for r in roots]


def scan(text: str) -> list[Span]:
    """All spans of a text, by start and then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [Span("assign", *m.span(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [Span("access", *m.span(), "", 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [Span("hex", *m.span(), "", 1.0) for m in HEX.finditer(text)]
    if _HOPE.search(text):
        lexer = Lexer(text)
        pairs = sorted(lexer.pairs, key=lambda p: p.start) if any(name_score(p.name) for p in lexer.pairs) else []
        named: dict[tuple[int, int], Span] = {}
        worth: dict[tuple[int, int], float] = {}
        for p, r in zip(pairs, resolved(text, pairs, lexer.parent), strict=True):
            n = name_score(p.name)
            if n and (r.start, r.end) not in worth:
                worth[r.start, r.end] = literal_score(text[r.start : r.end], r.quoted)
            if n and (v := worth[r.start, r.end]) and n + v >= THRESHOLD and n + v > getattr(named.get((r.start, r.end)), "score", 0.0):
                named[r.start, r.end] = Span("named", r.start, r.end, p.name, n + v)
        base = sorted((s.start, s.end) for s in out)
        ends = list(itertools.accumulate((e for _, e in base), max))
        for x in named.values():
            k = bisect_right(base, (x.start, 1 << 62))
            if not k or ends[k - 1] < x.end:
                out.append(x)
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """docs with out_col: the spans of each whole text, in code points, end exclusive.

    Kinds assign, access and hex are fixed patterns; named are literals that reach a target with a sensitive name by
    assignment, mapping entry, keyword or call argument, tag or a constant of another name. A span of kind named inside one
    of the others isn't reported. Null and empty texts have no spans. Each text is scanned whole, in time linear in its length;
    repeated rows give equal spans, an empty table gives none. One map over the rows, nothing moves.
    A column of docs that is named out_col is replaced; other columns stay.
    """

    return mapped(docs, text_col, f"`{out_col}` {SPANS}", lambda slab: [pa.array([[s._asdict() for s in scan(t)] if t else [] for t in slab.column(text_col).to_pylist()], _TYPE)], limit=4 << 20)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def masked(text: str, mask: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mask."""
    out, done = [], 0
    for s in scan(text):
        if s.end <= done:
            continue
        if s.start >= done:
            out += [text[done : s.start], mask]
        done = s.end
    return "".join(out) + text[done:] if out else text


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs (with text and n_chars) with secrets masked and n_chars counted anew; null texts stay as they are."""
    out = mapped(docs, "text", "text string", lambda slab: [pa.array([t and masked(t, mask) for t in slab.column("text").to_pylist()], pa.string())], limit=4 << 20)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))
    return out.select(*docs.columns)
