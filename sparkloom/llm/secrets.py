"""Secret scans by assignment-aware lexing.

Three base kinds are exact: `assign` (a sensitive word, an operator and a value), `access` (access key ids) and `hex`
(long lower-case hexadecimal runs). The lexer adds kind `named`: it parses assignments of source and configuration syntax
(`name = "literal"`, `"name": "literal"`, `name: literal`, `name := literal`, `name => literal`, `name: type = literal`)
into name-literal pairs, propagates constants (a sensitive name that is set to another name takes the literal of that
name's last assignment before, or of its last one at all where there is none before), and scores each literal by the
sensitivity of its target names and by its own shape.

Offsets are code points, ends exclusive. Null text is empty; an empty text has no spans; rows that repeat are scanned
each on its own; an empty table gives an empty table; other columns of the input are ignored. Names, blanks and literals
have no longest length. Time is linear in the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, whole_text

KINDS = ("assign", "access", "hex", "named")
THRESHOLD = 0.5
#: fixed values: the base patterns' parts
_KEYWORD = re.compile(r"(?:password|passwd|secret|token|api_?key)\Z", re.I | re.A)
_VALUE = re.compile(r"\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]" + _VALUE.pattern, re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MIN_ASSIGN, _LONGEST_KEYWORD = 6, 8

#: Sensitivity of the words of a name.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "private": 0.5, "signing": 0.5, "key": 0.5, "access": 0.3, "client": 0.2, "bearer": 0.7, "session": 0.3, "api": 0.4}
_OPERATOR = re.compile("[:=]")
#: A name read backwards from its operator, and what follows an operator: a quoted literal, or the first character of another.
_NAME = re.compile(r"[ \t]*+[\"'\]]{0,2}+([\w.\-]*[A-Za-z_])", re.A)
_LITERAL = re.compile(r"[>=]?[ \t]*+(?:\"((?:[^\"\\\n]|\\.)++)\"|'((?:[^'\\\n]|\\.)++)'|([A-Za-z0-9+/_.=@%~$-]))")
_RUN = re.compile(r"[A-Za-z0-9+/_.=@%~$-]+")
#: What stands between `:` and `=` of a typed declaration, without what is in brackets; types that are never constants.
_TYPE = re.compile(r"[ \t]*+(?:&(?:'\w++[ \t]++)?+(?:mut[ \t]++)?+)?+[A-Za-z_][\w.]*+\??+(?:[ \t]*+[|&][ \t]*+[A-Za-z_][\w.]*+)*+[ \t]*+")
TYPES = {"str", "string", "String", "bytes", "char", "text", "object", "any", "Any", "None", "null", "undefined"}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _operators(text: str) -> list[int]:
    return [m.start() for m in _OPERATOR.finditer(text)] if ":" in text or "=" in text else []


def base_spans(text: str, operators: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted.

    An assignment has its keyword right before its operator, so only operators are looked at; a match (kept or not)
    hides what it covers.
    """
    spans, over = [], 0
    for p in _operators(text) if operators is None else operators:
        if p < over:
            continue
        q = p
        while q > over and text[q - 1] == " ":
            q -= 1
        word = None
        for end in (q, q - 1) if q > over and text[q - 1] in "\"'" else (q,):
            word = word or _KEYWORD.search(text, max(over, end - _LONGEST_KEYWORD), end)
        if word and (m := _VALUE.match(text, p + 1)):
            over = m.end()
            if len(m[1]) >= _MIN_ASSIGN:
                spans.append((word.start(), 0, over))
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    joined = [a + b for a, b in zip(words, words[1:])]
    return min(1.0, sum(SENSITIVE.get(w, 0.0) for w in {*words, *joined}))


def literal_score(literal: str) -> float:
    """0 to 1: long, mixed and far from a plain word."""
    return _shape_score(Counter(literal), len(literal))


def _shape_score(counts: Counter, length: int) -> float:
    if length < 6:
        return 0.0
    entropy = -sum(n / length * math.log2(n / length) for n in counts.values())
    kinds = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "" for c in counts})
    return min(1.0, 0.25 * (length >= 8) + 0.15 * (kinds - 1) + min(entropy, 4.0) / 8)


def _is_type(between: str) -> bool:
    flat, depth = [], 0
    for c in between:
        depth += (c in "[<") - (c in "]>")
        if depth < 0 or c == "\n":
            return False
        if not depth and c not in "]>":
            flat.append(c)
    return not depth and _TYPE.fullmatch("".join(flat)) is not None


def assignments(text: str, operators: list[int] | None = None) -> list[tuple[str, int, int, bool]]:
    """(name, start of its literal, end, quoted) of each assignment, in order.

    Names and blanks end at the operator before and quoted literals at the next such quote. Literals without quotes may
    hold operators: all that end together share one scan. A typed declaration is a pair of its name and, but for types of
    TYPES, one of what stands where a type would (`config: password = "literal"`).
    """
    out, before, run = [], -1, 0
    above, pair = None, False  # the name at the operator before, and whether it made a pair
    for p in _operators(text) if operators is None else operators:
        between = text[before + 1 : p]
        name = _NAME.match(between[::-1])
        literal = (name or above) and _LITERAL.match(text, p + 1)
        typed = literal and above and text[p] == "=" and text[before] == ":" and _is_type(between)
        made = False
        if literal and (name or typed):
            k = literal.lastindex
            start, end = literal.span(k)
            if k == 3:
                if start >= run:
                    run = _RUN.match(text, start).end()
                end = run
            typed = typed and (k < 3 or between[-1] in " \t")  # else padding of base64
            if typed:
                if pair and not any(map(str.isdigit, between)):
                    out.pop()
                out.append((above, start, end, k < 3))
            if name and not (typed and name[1][::-1] in TYPES):
                out.append((name[1][::-1], start, end, k < 3))
                made = True
        before, above, pair = p, name and name[1][::-1], made
    return out


def _scores(text: str, pairs: list[tuple[str, int, int, bool]], wanted: set[int]) -> dict[int, float]:
    """literal_score of the pairs wanted: literals that end together are counted from the last on, each character once."""
    out, counts, at, last = {}, Counter(), 0, -1
    for k in sorted(wanted, reverse=True):
        _, s, e, quoted = pairs[k]
        if quoted:
            out[k] = literal_score(text[s:e])
            continue
        if e != last:
            counts, at, last = Counter(), e, e
        counts.update(text[s:at])
        at = s
        out[k] = _shape_score(counts, e - s)
    return out


def _sources(text: str, pairs: list[tuple[str, int, int, bool]]) -> list[int]:
    """For each pair, the pair whose literal it takes: its own, or that of the name it is set to."""
    final = {name: k for k, (name, *_) in enumerate(pairs)}
    last, follows = {}, []
    for k, (name, s, e, quoted) in enumerate(pairs):
        to = k
        if not quoted and text.find("=", s, e) < 0 and (other := text[s:e]) in final:
            to = last.get(other, final[other])
        follows.append(to)
        last[name] = k
    source = [-1] * len(pairs)
    for k in range(len(pairs)):
        path, on = [], set()
        while source[k] < 0 and follows[k] != k and k not in on:
            path.append(k)
            on.add(k)
            k = follows[k]
        end = k if source[k] < 0 else source[k]
        for x in (*path, k):
            source[x] = end
    return source


def named_spans(text: str, operators: list[int] | None = None, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    pairs = assignments(text, operators)
    targets = [(score, k) for k, (name, *_) in enumerate(pairs) if (score := name_score(name))]
    if not targets:
        return []
    source = _sources(text, pairs)
    targets = [(score, source[k]) for score, k in targets]
    scores = _scores(text, pairs, {k for _, k in targets})
    return sorted({(pairs[k][1], 3, pairs[k][2]) for score, k in targets if score * scores[k] >= threshold})


def scan(text: str) -> list[tuple[int, int, int]]:
    operators = _operators(text)
    return sorted(base_spans(text, operators) + (named_spans(text, operators) if operators else []))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with each secret (of an assignment, its value) replaced by mark; overlapping spans become one."""
    out, at, spans = [], 0, []
    for s, k, e in scan(text):
        if k == 0:
            s = _ASSIGN.match(text, s).start(1)
        spans.append((s, e))
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan_batches(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans = scan(text)
            base = [x for x in spans if x[1] < 3]
            n = Counter(k for _, k, _ in base)
            rows.append((doc_id, n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2)], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, the digest of the base spans, and all spans."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), _scan_batches, _SCHEMA)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs (every column) with the secrets of text replaced, and n_chars, where there is one, counted anew."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            text = [None if t is None else redact(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(text, pa.string())
            if "n_chars" in batch.schema.names:
                k = batch.schema.names.index("n_chars")
                old = columns[k].to_pylist()
                columns[k] = pa.array([o if t is None else len(t) for o, t in zip(old, text)], pa.int64()).cast(columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(docs, run, docs.schema)
