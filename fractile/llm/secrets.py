"""Secret scan by assignment-aware lexing.

Around every assignment sign in source code or configuration (=, :=, =>, : and
element tags) the lexer reads the name before and the expression after: quoted
literals and names joined by + or adjacency, a bare word, or a private key. Names
bound to literals are constants, the latest binding before a use being the one
that holds; a name in an expression, written plainly or as $NAME or ${NAME},
stands for what it is bound to, through any number of steps. Each (name, literal)
pair is scored by how sensitive the words of its name are and by how much the
whole literal looks like a credential, and the pieces of literals above the
threshold are reported where they stand, under the kind "literal".

Names, blanks and values are read to their end, however long, in linear time. A
private key in PEM armour counts as a literal over several lines too, and despite
its spaces.

Defined cases: a null or empty text has no finding; a repeated row is scanned
again, null ids stay null; a bare word of letters alone is a name and not a
literal; other literals with white space aren't credentials; other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from fractile.llm.spans import Span, scan_documents

BASE_KINDS = ("assign", "access", "hex")
OWN_KINDS = ("literal",)
THRESHOLD = 0.5

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: How sensitive a word of a name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.8, "pass": 0.7, "secret": 1.0, "secrets": 0.9,
    "token": 0.9, "bearer": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0,
    "secretkey": 1.0, "auth": 0.6, "authorization": 0.8, "key": 0.5, "signature": 0.6, "salt": 0.5, "cookie": 0.5, "session": 0.4,
}
#: Words that make a key or an id a sensitive one, and words that make a name a harmless one.
QUALIFIERS = {"api", "access", "private", "client", "encryption", "signing", "master", "account", "storage", "service", "shared", "webhook"}
HARMLESS = {"public", "url", "uri", "path", "file", "name", "field", "type", "length", "count", "limit", "max", "min", "expires", "expiry", "ttl", "hint", "policy", "header", "prefix", "label", "column", "index", "foreign", "primary", "sort"}
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|none|null|true|false|undefined|todo|test|example.*|sample.*|your[_-].*|change_?me.*|placeholder.*|dummy.*|redacted|\$\{.*\}|\{\{.*\}\}|<.*>|%.*%|\$[A-Za-z_]\w*)$")

_SIGN = re.compile(r"=>|:=|[:=]|>")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.$-")
_NAME_START = re.compile(r"[A-Za-z_]")
_QUOTED = re.compile(r"""[ \t]*+(?:[rbuf]{0,2})("(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`[^`\n]*+`)""")
_PEM = re.compile(r"""[ \t]*+(?:[|>][+-]?[ \t]*+\n[ \t]*+)?(?:[rbuf]{0,2})(?:"{1,3}|'{1,3}|`)?(-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY[A-Z0-9 ]{0,40}-----(?:[^-"'`]++|-(?!----))*+-----END [A-Z0-9 ]{1,80}-----)""")
_PRIVATE = re.compile(r"\s*(?:\\[nr])*-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY[A-Z0-9 ]{0,40}-----")
#: What stands between two terms of an expression, before a quote and before a name.
_JOIN = re.compile(r"[ \t]*+[+.]?[ \t]*+(?=[rbuf]{0,2}[\"'])")
_PLUS = re.compile(r"[ \t]*+[+.][ \t]*+(?=[A-Za-z_$])")
_BARE = re.compile(r"""[ \t]*+([A-Za-z0-9+/_.=~!@$%^&*-]++)""")
_REFERENCE = re.compile(r"\$?\{?([A-Za-z_][A-Za-z0-9_.$-]*+)\}?")
_OPEN_REFERENCE = re.compile(r"[ \t]*+\$\{([A-Za-z_][A-Za-z0-9_]*+)\}")
_BLANKS = re.compile(r"[ \t]*+")
_LETTERS = re.compile(r"[A-Za-z]*+")
#: Placeholders in a bare value, without a look at what follows an open beginning.
_BARE_PLACEHOLDER = re.compile(r"(?i)(?:(?:x++|\*++|\.++|-++|none|null|true|false|undefined|todo|test|redacted|\$[a-z_][a-z0-9_]*+)\Z|example|sample|your[_-]|change_?me|placeholder|dummy)")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[Span]:
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return found


def name_weight(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    whole = set(parts) | {a + b for a, b in zip(parts, parts[1:])}
    weight = max((SENSITIVE.get(p, 0.0) for p in whole), default=0.0)
    if weight and whole & QUALIFIERS:
        weight = min(1.0, weight + 0.4)
    if whole & HARMLESS:
        weight -= 0.6
    return max(weight, 0.0)


def literal_strength(value: str) -> float:
    """From 0 to 1 by length, variety and how unlike a word or placeholder the literal is; 1 for a private key."""
    if _PRIVATE.match(value):
        return 1.0
    if len(value) < 8 or PLACEHOLDERS.match(value):
        return 0.0
    return _strength(Counter(value), len(value))


def _strength(counts: Counter[str], n: int) -> float:
    """By how often each character occurs in a literal of n characters."""
    if any(c.isspace() for c in counts):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c)
    kinds = len({0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in counts})
    if kinds == 1 and n < 20 and not all(c.isdigit() for c in counts):
        return 0.3
    return min(1.0, 0.25 * min(n, 16) / 16 + 0.45 * min(entropy, 4.0) / 4.0 + 0.15 * kinds)


def _bare_strengths(text: str, spans: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """literal_strength of bare values, in linear time though one that holds "=" ends with another."""
    out: dict[tuple[int, int], float] = {}
    counts: Counter[str] = Counter()
    at = end = -1
    for a, b in sorted(spans, key=lambda s: (s[1], -s[0])):
        if b != end:
            counts, at, end = Counter(), b, b
        counts.update(text[a:at])
        at = a
        unlike = b - a >= 8 and not _BARE_PLACEHOLDER.match(text, a, b) and not (text[a] == "%" == text[b - 1])
        out[a, b] = _strength(counts, b - a) if unlike else 0.0
    return out


class Value:
    """What an expression stands for: a literal at a place of the text, or terms that are joined. Terms are shared, so that constants built from constants take no more room than their text."""

    __slots__ = ("start", "end", "bare", "terms", "counts", "size", "score")

    def __init__(self, start: int = 0, end: int = 0, bare: bool = False, terms: list[Value] | None = None) -> None:
        self.start, self.end, self.bare, self.terms = start, end, bare, terms
        self.counts, self.size, self.score = None, end - start, 0.0

    def counted(self, text: str) -> Counter[str]:
        """How often each character occurs in the whole literal."""
        if self.counts is None:
            self.counts = Counter(text[self.start : self.end])
            for t in self.terms or ():
                self.counts.update(t.counted(text))
        return self.counts

    def strength(self, text: str, bare: dict[tuple[int, int], float]) -> float:
        if self.terms is not None:
            return _strength(self.counted(text), self.size) if self.size >= 8 else 0.0
        return bare[self.start, self.end] if self.bare else literal_strength(text[self.start : self.end])


def _joined_value(terms: list[Value]) -> Value:
    if len(terms) == 1:
        return terms[0]
    out = Value(terms=terms)
    out.size = sum(t.size for t in terms)
    return out


def _name_before(text: str, at: int) -> tuple[int, str] | None:
    """Where the name that ends before at, blanks, quotes and brackets begins, and the name."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    quote = ""
    for _ in range(3):
        if end and text[end - 1] in "\"'`]":
            quote = text[end - 1] if text[end - 1] != "]" else quote
            end -= 1
    start = end
    if quote:  # any characters of a line
        while start and text[start - 1] not in (quote, "\n"):
            start -= 1
        if not start or text[start - 1] != quote:
            start = end
    if start == end:
        while start and text[start - 1] in _NAME_CHARS:
            start -= 1
    first = _NAME_START.search(text, start, end)
    return (first.start(), text[first.start() : end]) if first else None


def _more_terms(text: str, at: int, terms: list[Value], bound: dict[str, Value]) -> list[Value]:
    """terms and the quoted literals and bound names that follow at at, joined to them."""
    terms = list(terms)
    while True:
        if (j := _JOIN.match(text, at)) and (m := _QUOTED.match(text, j.end())):
            terms.append(Value(m.start(1) + 1, m.end(1) - 1))
        elif (j := _PLUS.match(text, at)) and (m := _REFERENCE.match(text, j.end())) and (known := bound.get(m[1])):
            terms.append(known)
        else:
            return terms
        at = m.end()


def _quoted(text: str, at: int, bound: dict[str, Value]) -> Value | None:
    """The expression that begins with a quoted literal, or the private key, at or soon after at."""
    if m := _PEM.match(text, at):
        return Value(*m.span(1))
    if m := _QUOTED.match(text, at):
        whole = _REFERENCE.fullmatch(m[1][1:-1]) if m[1][1:2] == "$" else None
        first = (bound.get(whole[1]) if whole else None) or Value(m.start(1) + 1, m.end(1) - 1)
        return _joined_value(_more_terms(text, m.end(), [first], bound))
    return None


def name_literal_pairs(text: str) -> list[tuple[str, Value]]:
    """The name and value of every assignment, constants put in for the names that stand for them."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    bound: dict[str, Value] = {}
    pairs = []
    run_end = -1  # of the last run of bare characters: a value that begins in it ends with it
    for m in _SIGN.finditer(text):
        at = m.start()
        if m[0] in "=:" and (text[at + 1 : at + 2] == "=" or (m[0] == ":" and text.startswith("//", at + 1)) or text[at - 1 : at] in ("=", "!", "<", ">", ":")):
            continue
        if m[0] == ">" and text[at - 1 : at] in ("=", "-", "/"):
            continue
        before = _name_before(text, at)
        if not before or (m[0] == ">" and text[before[0] - 1 : before[0]] != "<"):
            continue
        name = before[1]
        if not (value := _quoted(text, m.end(), bound)):
            if ref := _OPEN_REFERENCE.match(text, m.end()):
                value = bound.get(ref[1])
            else:
                start = _BLANKS.match(text, m.end()).end()
                if start >= run_end:
                    bare = _BARE.match(text, m.end())
                    if not bare:
                        continue
                    run_end = bare.end()
                ref = _REFERENCE.match(text, start, run_end)
                named = bool(ref) and ref.end() == run_end
                if text[run_end : run_end + 1] == "(":
                    value = None
                elif named and ref[1] in bound:
                    value = _joined_value(_more_terms(text, run_end, [bound[ref[1]]], bound))
                elif _LETTERS.match(text, start).end() >= run_end or (named and text[start] == "$"):
                    terms = _more_terms(text, run_end, [], bound)  # an unknown name joined to literals
                    value = _joined_value(terms) if terms else None
                else:
                    value = Value(start, run_end, bare=True)
        if value is None:
            bound.pop(name, None)
        else:
            bound[name] = value
            pairs.append((name, value))
    return pairs


def scored_literals(text: str) -> dict[tuple[int, int], float]:
    """The score of each literal: its name's weight times its strength, or the best that it has as a term of another."""
    pairs = name_literal_pairs(text)
    weighted = [(w, v) for name, v in pairs if (w := name_weight(name))]
    if not weighted:
        return {}
    joined = list({id(v): v for _, v in pairs if v.terms is not None}.values())  # each after its terms
    for v in joined:
        v.counted(text)
    bare = _bare_strengths(text, list({(v.start, v.end) for _, v in weighted if v.bare}))
    for w, v in weighted:
        v.score = max(v.score, w * v.strength(text, bare))
    literals = [v for _, v in pairs if v.terms is None]
    for v in reversed(joined):
        for t in v.terms:
            t.score = max(t.score, v.score)
        literals += [t for t in v.terms if t.terms is None]
    scores: dict[tuple[int, int], float] = {}
    for v in literals:
        scores[v.start, v.end] = max(v.score, scores.get((v.start, v.end), 0.0))
    return scores


def own_spans(text: str) -> list[Span]:
    return [(a, b, "literal") for (a, b), score in sorted(scored_literals(text).items()) if score >= THRESHOLD and b > a]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal, n_spans."""
    return scan_documents(docs, base_spans, lambda texts: [own_spans(t) for t in texts], BASE_KINDS, OWN_KINDS)


def query(spark, sf_dir: str) -> DataFrame:
    from fractile.llm.common import table

    return scan_secrets(table(spark, sf_dir, "documents"))
