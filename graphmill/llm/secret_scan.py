"""Secret scans by assignment-aware lexing.

Three base patterns find assigned secrets, access key ids and long hexadecimal
runs. Beside them, the text is lexed as source or configuration into names,
strings, separators (= : := =>), marks and bare runs, and parsed into pairs of a
name and a value: in quotes (single, double, back or triple), joined by + or by
standing side by side, in brackets, as an argument of a call (of a lookup: its
default), after a type annotation, as a property or an index of an object, as one of
several targets of as many values, as an argument of a setter, as a macro, as an
option or as an element of a markup file. Strings are lexed inside as well, however
deep they are nested. Names that were given a literal stand for it, from there on or,
where they are used before, by their first definition, so a literal reaches the
sensitive name it is assigned to through any chain of constants; a name that
stands for nothing known is no literal. A literal's score is the weight of the
most sensitive target name it reaches, times its strength (bits of character
entropy, up to FULL_BITS). Literals that score THRESHOLD or more are reported as
kind "literal", also where a base span holds them: its own span is the value's.

All work is per document and whole text, inside Arrow batches; no shuffle. Time
is linear in the text, without bounds on names, arguments or joined parts: a run is
measured once, brackets are matched once and jumped over, and what a value or a
target looks at ends at the next separator.

Defined results: null text is empty and has no spans; spans are in order of
start, then kind as in KINDS; positions are code points, ends exclusive;
repeated rows get equal spans. Only the named column is read; a column named as
the output is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.shared import small_batches, text_of

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12

TOKEN = re.compile(
    r"""(?P<triple>\"{3}|'{3})|(?P<string>"[^"\\\n]*(?:\\.[^"\\\n]*)*"|(?<!\w)'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\\\n]*(?:\\.[^`\\\n]*)*`)"""
    r"""|(?P<other>[=!<>]=)|(?P<sep>:=|=>|[:=])|(?P<name>[A-Za-z_$][\w$]*(?:[.-][\w$]+)*)|(?P<mark>[\n,;(){}\[\]+|?])|(?P<bare>[^\s"'`=:,;(){}\[\]+|?]+)""",
    re.ASCII,
)
RUN = re.compile(r"""[^\s"'`,;(){}\[\]<>&?]*""")
NAME = re.compile(r"[A-Za-z_$][\w$]*(?:[.-][\w$]+)*", re.ASCII)
ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)>([^<>\n]+)</\1>", re.ASCII)
OPTION = re.compile(r"(?<!\S)--?([A-Za-z][\w-]*+)[ \t]+([^\s\"'-][^\s\"']*)", re.ASCII)
MACRO = re.compile(r"""\#[ \t]*+define[ \t]++([A-Za-z_]\w*+)[ \t]++(?:"([^"\n]*+)"|'([^'\n]*+)'|([^\s"']++))""", re.ASCII)
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# How sensitive a name is by the words in it, pairs first.
PAIR_WEIGHTS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("signing", "key"): 1.0, ("encryption", "key"): 1.0, ("secret", "key"): 1.0, ("client", "secret"): 1.0, ("pass", "phrase"): 1.0, ("pass", "word"): 1.0, ("connection", "string"): 0.8}
WORD_WEIGHTS = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "secrets": 1.0, "token": 1.0, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "auth": 0.7, "authorization": 0.8, "webhook": 0.6, "salt": 0.6, "key": 0.4}
PLACEHOLDERS = {"changeme", "change_me", "example", "placeholder", "password", "secret", "redacted", "undefined", "null", "none", "true", "false", "your_password", "your_api_key"}
#: Calls whose first argument names what is looked up, marks of a literal's kind, and schemes before a credential.
LOOKUPS = {"getenv", "get", "env", "getproperty", "lookup", "fetch", "environ", "config", "pop", "getattr", "setdefault"}
#: Calls that give a name to what follows: in the call's own name, or as its first argument.
SETTER = re.compile(r"(?:set|with|use)(?=[_A-Z])_?")
SETTERS = {"set", "put", "setenv", "putenv", "setproperty", "setattr", "setdefault"}
PREFIXES = {"b", "f", "r", "u", "br", "rb", "fr", "rf"}
SCHEMES = {"bearer", "basic"}
THRESHOLD = 0.6
FULL_BITS = 45.0
LEAST = 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by the three patterns, each on its own."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_weight(name: str) -> float:
    return short_name_weight(name) if len(name) <= 128 else any_name_weight(name)  # only short ones are kept


def any_name_weight(name: str) -> float:
    words = [w.lower() for w in NAME_WORD.findall(name)]
    pairs = max((PAIR_WEIGHTS.get(p, 0.0) for p in zip(words, words[1:], strict=False)), default=0.0)
    return max(pairs, max((WORD_WEIGHTS.get(w, 0.0) for w in words), default=0.0))


short_name_weight = lru_cache(1 << 14)(any_name_weight)


def strength(literal: str) -> float:
    """0 for placeholders, prose and short strings, up to 1 for random ones."""
    plain = literal.strip()
    if len(plain) < LEAST or plain.lower() in PLACEHOLDERS or re.search(r"\s|\$\{|\{\{|^<.*>$|^[*xX.]+$", plain):
        return 0.0
    n = len(plain)
    bits = -sum(c * math.log2(c / n) for c in Counter(plain).values())
    varied = sum(bool(re.search(p, plain)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, bits / FULL_BITS) * (1.0 if varied > 1 else 0.5)


Token = tuple[str, int, int]
Span = tuple[int, int]


def tokens_of(text: str, lo: int, hi: int) -> list[Token]:
    """(kind, start, end); of strings, start and end of what is inside."""
    out: list[Token] = []
    unclosed: set[str] = set()
    at = lo
    while found := TOKEN.search(text, at, hi):
        kind, start, end = found.lastgroup or "", found.start(), found.end()
        at = end
        if kind == "triple":
            mark = found[0]
            close = -1 if mark in unclosed else text.find(mark, end, hi)
            if close < 0:
                unclosed.add(mark)
                continue
            out.append(("string", end, close))
            at = close + 3
        elif kind == "string":
            out.append((kind, start + 1, end - 1))
        else:
            out.append((kind, start, end))
    return out


def random_looking(word: str) -> bool:
    """Whether what could be a name changes between letters and digits too often for one."""
    kinds = ["d" if c.isdigit() else "l" for c in word if c.isalnum()]
    return "." not in word and sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) >= 3


class Parser:
    """The assignments in a stretch of text: (name, parts of a literal or another name)."""

    def __init__(self, text: str, lo: int, hi: int):
        self.text, self.tokens, self.run_end = text, tokens_of(text, lo, hi), -1
        #: The closing bracket of each opening one that has any.
        self.closing: dict[int, int] = {}
        open_ = []
        for i, (kind, start, _) in enumerate(self.tokens):
            if kind == "mark" and text[start] in "([{":
                open_.append(i)
            elif kind == "mark" and text[start] in ")]}" and open_:
                self.closing[open_.pop()] = i

    def word(self, i: int) -> str:
        return self.text[self.tokens[i][1] : self.tokens[i][2]]

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def is_mark(self, i: int, marks: str) -> bool:
        return self.kind(i) == "mark" and self.word(i) in marks

    def targets(self, i: int) -> list[str]:
        """The names that the separator at i may assign to: the one before it, and
        in `name: type = value` the one before the type."""
        j = i - 1
        if self.is_mark(j, "]") and self.kind(j - 1) == "string":
            j -= 1
        places = [j]
        if self.word(i) == "=":
            for k in range(i - 1, 0, -1):  # as far as the separator before
                if self.kind(k) == "sep" and self.word(k) == ":":
                    places.append(k - 1)
                if self.kind(k) not in ("name", "bare") and not self.is_mark(k, "[]|?,"):
                    break
        names = [self.word(k) for k in places if self.kind(k) in ("name", "string")]
        return [n for n in names if NAME.fullmatch(n)]

    def several(self, i: int) -> list[str]:
        """The names of `a, b = ...` before the separator at i, where there are two or more."""
        names, k = [], i - 1
        while self.kind(k) == "name":
            names.append(self.word(k))
            if not self.is_mark(k - 1, ","):
                whole = k == 0 or self.is_mark(k - 1, "\n;{") or self.kind(k - 1) == "name"
                return names[::-1] if whole and len(names) > 1 else []
            k -= 2
        return []

    def run(self, start: int) -> int:
        """The end of the run of value characters that start is in."""
        if start >= self.run_end:
            self.run_end = RUN.match(self.text, start).end()
        return self.run_end

    def arguments(self, i: int) -> tuple[list[list[Span]], int]:
        """The strings in each argument of a call (its bracket at i), brackets inside left
        out, and the token after it."""
        end = self.closing.get(i, len(self.tokens))
        found, k = [[]], i + 1
        while k < end:
            if self.is_mark(k, "([{"):
                k = self.closing.get(k, end)
            elif self.is_mark(k, ","):
                found.append([])
            elif self.kind(k) == "string":
                found[-1].append(self.tokens[k][1:])
            k += 1
        return found, min(end + 1, len(self.tokens))

    def call(self, i: int) -> tuple[list[Span], int]:
        """The string that a call (its name at i) stands for, and the token after it."""
        arguments, k = self.arguments(i + 1)
        lookup = self.word(i).rpartition(".")[2].lower() in LOOKUPS
        return next((a for a in arguments[lookup:] if a), []), k

    def setter(self, i: int) -> tuple[str, tuple[Span, ...]] | None:
        """What the call at i, if it is a setter of a sensitive name, gives to it."""
        word = self.word(i).rpartition(".")[2]
        if word.lower() in SETTERS:
            arguments, _ = self.arguments(i + 1)
            named = next((k for k in (0, 1) if k < len(arguments) and arguments[k]), None)
            if named is None or named + 1 >= len(arguments):
                return None
            name, parts = self.text[slice(*arguments[named][0])], arguments[named + 1]
            return (name, tuple(parts)) if parts and NAME.fullmatch(name) else None
        if SETTER.match(word) and name_weight(word) >= THRESHOLD:
            arguments, _ = self.arguments(i + 1)
            return (word, tuple(arguments[0])) if arguments[0] else None
        return None

    def value(self, i: int) -> tuple[tuple[Span, ...], str | None, int]:
        """Parts of the literal from token i on, or another name, and the token after it."""
        parts: list[Span] = []
        other, depth, k = None, 0, i
        while k < len(self.tokens):
            kind = self.kind(k)
            if self.is_mark(k, "(") or (depth and self.is_mark(k, "\n")) or (parts and self.is_mark(k, "+")) or (other and self.is_mark(k, "|?")):
                depth += self.is_mark(k, "(")
                k += 1
            elif kind == "string":
                parts.append(self.tokens[k][1:])
                k += 1
                if not (self.kind(k) == "string" or self.is_mark(k, "+") or depth and self.is_mark(k, "\n")):
                    break
            elif kind in ("name", "bare") and not parts:
                start, stop = self.tokens[k][1:]
                word = self.text[start:stop]
                if kind == "name" and self.is_mark(k + 1, "("):
                    found, k = self.call(k)
                    parts += found
                    break
                if word in PREFIXES and self.kind(k + 1) == "string" or word.lower() in SCHEMES or (other and word == "or"):
                    k += 1
                    continue
                if other:
                    break
                stop = self.run(start)
                if NAME.fullmatch(self.text, start, stop) and not random_looking(self.text[start:stop]):
                    other = self.text[start:stop]
                    k = bisect_left(self.tokens, stop, k, key=lambda t: t[1])
                    continue
                parts.append((start, stop))
                k = bisect_left(self.tokens, stop, k, key=lambda t: t[1])
                break
            else:
                break
        return tuple(parts), None if parts else other, k

    def pairs(self) -> Iterator[tuple[int, str, tuple[Span, ...], str | None]]:
        taken = -1  # the end of the run that a sensitive name has taken: no other name takes a piece of it
        for i, (kind, start, _) in enumerate(self.tokens):
            if kind == "name" and self.is_mark(i + 1, "(") and (found := self.setter(i)):
                yield start, *found, None
            if kind == "sep" and start >= taken and (names := self.several(i)):
                given, k = [self.value(i + 1)], 0
                while len(given) < len(names) and self.is_mark(k := given[-1][2], ","):
                    given.append(self.value(k + 1))
                if len(given) == len(names):
                    for name, (parts, other, _) in zip(names, given, strict=True):
                        if parts or other:
                            yield start, name, parts, other
                    continue
            if kind == "sep" and start >= taken and (names := self.targets(i)):
                parts, other, _ = self.value(i + 1)
                for name in names if parts or other else ():
                    yield start, name, parts, other
                    if parts and parts[-1][1] == self.run_end and name_weight(name) >= THRESHOLD:
                        taken = self.run_end


def assignments(text: str) -> Iterator[tuple[int, str, tuple[Span, ...], str | None]]:
    """Those of a text and of the strings in it. A string ends within what holds it, by
    another quote or an escaped one, so few levels hold a place."""
    left = [(0, len(text))]
    while left:
        parser = Parser(text, *left.pop())
        yield from parser.pairs()
        for kind, start, end in parser.tokens:
            if kind == "string" and end - start > LEAST and (text.find("=", start, end) >= 0 or text.find(":", start, end) >= 0 or text.find("(", start, end) >= 0):
                left.append((start, end))


def literal_spans(text: str) -> list[Span]:
    """Literals whose most sensitive target makes them a secret."""
    found = list(assignments(text))
    if "</" in text:
        found += [(m.start(), m[1], (m.span(2),), None) for m in ELEMENT.finditer(text)]
    if "-" in text:
        found += [(m.start(), m[1], (m.span(2),), None) for m in OPTION.finditer(text)]
    if "#" in text:
        found += [(m.start(), m[1], (m.span(m.lastindex),), None) for m in MACRO.finditer(text)]
    literals: dict[Span, tuple[Span, ...]] = {}  # by the span of the whole
    constants: dict[str, Span] = {}
    firsts: dict[str, Span] = {}
    waiting: dict[str, list[str]] = {}  # names given by names that aren't defined before
    weights: dict[Span, float] = {}

    def give(name: str, literal: Span) -> None:
        constants[name] = literal
        firsts.setdefault(name, literal)
        weights[literal] = max(weights.get(literal, 0.0), name_weight(name))

    for _, name, parts, other in sorted(found, key=lambda x: x[0]):
        if parts:
            literal = parts[0][0], parts[-1][1]
            literals.setdefault(literal, parts)
            give(name, literal)
        elif other in constants:
            give(name, constants[other])
        else:
            waiting.setdefault(other or "", []).append(name)
    left = [name for name in waiting if name in firsts]
    while left:
        known = left.pop()
        for name in waiting.pop(known, ()):
            if name not in firsts:
                left.append(name)
            give(name, firsts[known])
    secret = (span for span, w in weights.items() if w >= THRESHOLD and w * strength("".join(text[a:b] for a, b in literals[span])) >= THRESHOLD)
    return sorted(secret)


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """All spans (start, kind number, end) of one text, in order."""
    found = base_spans(text)
    if any(mark in text for mark in ("=", ":", "</", "-", "#", "(")):
        found += [(a, 3, b) for a, b in literal_spans(text)]
    return sorted(found)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def with_spans(docs: DataFrame, *, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """docs with the spans of secrets in each text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t)] for t in texts.to_pylist()], kind)

    small_batches(docs.sparkSession)
    return docs.withColumn(out_col, F.arrow_udf(scan, SPANS)(text_of(text_col)))


def redacted_text(text: str) -> str:
    """text with every run of overlapping spans replaced by its first kind."""
    out, done, until = [], 0, 0
    for start, kind, end in spans_of(text):
        if start >= until:
            out += [text[done:start], f"[{KINDS[kind]}]"]
        until = done = max(until, end)
    return "".join(out) + text[done:] if out else text


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with secrets cut from the text; null texts stay null, and
    length_col, where docs have it, follows the new text."""

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else redacted_text(t) for t in texts.to_pylist()], pa.string())

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes).get(length_col)
    out = docs.withColumn(text_col, F.arrow_udf(cut, "string")(F.col(text_col)))
    return out if kind is None else out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.char_length(text_col).cast(kind)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
