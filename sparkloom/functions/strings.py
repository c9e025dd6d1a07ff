"""The string namespace. Patterns are Java regular expressions; plain text is meant literally where the method says so."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgumentError
from ..types import Decimal, clean_number, coerce
from ..types import Int32 as _INT32
from .expr import CamelNames, Expr, let, to_expr
from .temporal import java_format

_META = r"\.*+?^${}()|[]/-"


def quote(text: str) -> str:
    return "".join("\\" + ch if ch in _META else ch for ch in text)


def java(pattern: str | re.Pattern, literal: bool = False) -> str:
    """A pattern as Java sees it: flags inline, named groups in Java's form."""
    if isinstance(pattern, re.Pattern):
        flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & bit)
        text = re.sub(r"\(\?P<", "(?<", pattern.pattern)
        return (f"(?{flags})" if flags else "") + text
    return quote(pattern) if literal else pattern


def _names(pattern: str) -> list[str]:
    return re.findall(r"\(\?P?<([A-Za-z]\w*)>", pattern)


def _groups(pattern: str) -> int:
    return re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern)).groups


def words_of(text: str) -> list[str]:
    """Words for case changes: runs of letters split at case changes, and digits."""
    return re.findall(r"[A-ZÀ-ÖØ-Þ]+(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])|[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+|\d+|[^\W\d_a-zA-ZÀ-ÿ]+", text)


def _python(function, returns: str):
    """An Arrow-batched function of one string column."""

    @F.pandas_udf(returns)
    def call(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else function(v))

    return call


class StrNamespace(CamelNames):
    def __init__(self, expr: Expr):
        self.expr = expr

    def _map(self, f) -> Expr:
        return self.expr._map(lambda c, ctx: f(c.cast("string")))

    def _with(self, pattern, f) -> Expr:
        """f(text, pattern column); a null pattern gives null."""
        return self.expr._binary(pattern, lambda c, p, _: f(c.cast("string"), p), names=isinstance(pattern, Expr))

    def concat(self, other, *more) -> Expr:
        out = self.expr
        for o in (other, *more):
            out = out._binary(o, lambda a, b, _: F.concat(a.cast("string"), b.cast("string")))
        return out

    def contains(self, pattern, literal: bool | None = None) -> Expr:
        if isinstance(pattern, re.Pattern):
            return self._map(lambda c: c.rlike(java(pattern)))
        return self._with(pattern, lambda c, p: F.contains(c, p))

    def contains_any(self, patterns) -> Expr:
        def f(c):
            out = F.lit(False)
            for p in patterns:
                out = out | (c.rlike(java(p)) if isinstance(p, re.Pattern) else F.contains(c, F.lit(p)))
            return F.when(c.isNotNull(), out)

        return self._map(f)

    def count_matches(self, pattern, literal: bool = False) -> Expr:
        return self._map(lambda c: F.regexp_count(c, F.lit(java(pattern, literal))))

    def escape_regex(self) -> Expr:
        return self._map(lambda c: F.regexp_replace(c, r"([\\.*+?^${}()|\[\]/])", r"\\$1"))

    def decode(self, encoding: str, strict: bool = False) -> Expr:
        if encoding not in ("hex", "base64"):
            raise InvalidArgumentError(f"unknown encoding {encoding}")
        call = F.to_binary if strict else F.try_to_binary
        return self._map(lambda c: F.decode(call(c, F.lit(encoding)), "utf-8"))

    def encode(self, encoding: str) -> Expr:
        if encoding not in ("hex", "base64"):
            raise InvalidArgumentError(f"unknown encoding {encoding}")
        return self._map(lambda c: F.lower(F.hex(F.encode(c, "utf-8"))) if encoding == "hex" else F.base64(F.encode(c, "utf-8")))

    def decode_uri_component(self) -> Expr:
        return self._map(lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c))

    def encode_uri_component(self) -> Expr:
        def f(c):
            out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
            for code, ch in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):  # fixed values: marks that stay
                out = F.replace(out, F.lit(code), F.lit(ch))
            return out

        return self._map(f)

    def starts_with(self, prefix) -> Expr:
        return self._with(prefix, lambda c, p: F.startswith(c, p))

    def ends_with(self, suffix) -> Expr:
        return self._with(suffix, lambda c, p: F.endswith(c, p))

    def explode(self) -> Expr:
        return self._map(lambda c: F.filter(F.split(c, ""), lambda x: x != ""))

    def extract(self, pattern, group: int | str | None = None) -> Expr:
        p = java(pattern)
        names = _names(p)
        if isinstance(group, str):
            if group not in names:
                raise InvalidArgumentError(f"no group {group}")
            order = [m for m in re.finditer(r"\((?!\?)|\(\?P?<(?![=!])([A-Za-z]\w*)>", p)]
            group = next(k + 1 for k, m in enumerate(order) if m[1] == group)
        n = _groups(p)
        g = (1 if n else 0) if group is None else group + n + 1 if group < 0 else group
        if not 0 <= g <= n:
            raise InvalidArgumentError(f"no group {group}")
        return self._map(lambda c: F.get(F.regexp_extract_all(c, F.lit(p), F.lit(g)), 0))

    def extract_all(self, pattern, group: int = 0) -> Expr:
        return self._map(lambda c: F.regexp_extract_all(c, F.lit(java(pattern)), F.lit(group)))

    def extract_groups(self, pattern) -> Expr:
        p = java(pattern)
        order = [m[1] for m in re.finditer(r"(?<!\\)\((?!\?)|\(\?P?<(?![=!])([A-Za-z]\w*)>", p)]

        def f(c):
            got = [F.get(F.regexp_extract_all(c, F.lit(p), F.lit(k)), 0).alias(str(k)) for k in range(len(order) + 1)]
            got += [F.get(F.regexp_extract_all(c, F.lit(p), F.lit(k + 1)), 0).alias(name) for k, name in enumerate(order) if name]
            return F.when(c.rlike(p), F.struct(*got))

        return self._map(f)

    def _many(self, patterns, overlapping: bool, leftmost: bool, made, returns: str) -> Expr:
        """For each pattern its first match; without overlaps, later patterns lose what earlier (or more leftward) ones cover."""
        compiled = [p if isinstance(p, re.Pattern) else re.compile(p) for p in patterns]

        def one(text: str):
            found = [(m.start(), k, m) for k, p in enumerate(compiled) if (m := p.search(text))]
            if not overlapping:
                kept, free = [], []
                for s, k, m in sorted(found, key=lambda x: (x[0], x[1]) if leftmost else (x[1],)):
                    if all(m.end() <= a or b <= s for a, b in free):
                        kept.append((s, k, m))
                        free.append((s, m.end()))
                found = kept
            by = {k: m for _, k, m in found}
            return [made(text, by[k]) if k in by else None for k in range(len(compiled))]

        call = _python(one, returns)
        return self._map(lambda c: call(c))

    def extract_many(self, patterns, overlapping: bool = False, leftmost: bool = True) -> Expr:
        return self._many(patterns, overlapping, leftmost, lambda _, m: m[0], "array<string>")

    def find(self, value, literal: bool = False) -> Expr:
        """Byte offset of the first match."""
        p = java(value, literal)

        def f(c):
            at = F.regexp_instr(c, F.lit(p))
            return F.when(at > 0, F.octet_length(F.substring(c, F.lit(1), at - 1)))

        return self._map(f)

    def find_many(self, patterns, overlapping: bool = False, leftmost: bool = True) -> Expr:
        return self._many(patterns, overlapping, leftmost, lambda t, m: len(t[: m.start()].encode()), "array<int>")

    def replace(self, pattern, value, literal: bool = False) -> Expr:
        """The first match replaced; value may be a function of the match's text."""
        return self._replaced(pattern, value, literal, 1)

    def replace_all(self, pattern, value, literal: bool = False) -> Expr:
        return self._replaced(pattern, value, literal, 0)

    def _replaced(self, pattern, value, literal, count) -> Expr:
        if callable(value) and not isinstance(value, Expr):
            p = re.compile(re.escape(pattern)) if literal and isinstance(pattern, str) else re.compile(pattern)
            call = _python(lambda t: p.sub(lambda m: value(m[0]), t, count=count), "string")
            return self._map(lambda c: call(c))
        p = java(pattern, literal)
        with_ = re.sub(r"\$<(\w+)>", r"${\1}", value).replace("$&", "$0")
        if count == 0:
            return self._map(lambda c: F.regexp_replace(c, p, with_))

        def f(c):
            at, first = F.regexp_instr(c, F.lit(p)), F.regexp_substr(c, F.lit(p))
            size = F.length(first)
            return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.regexp_replace(first, p, with_), F.substring(c, at + size, F.length(c)))).otherwise(c)

        return self._map(f)

    def replace_many(self, patterns, values, literal: bool = True) -> Expr:
        """All patterns at once, leftmost first; never inside a replacement."""
        values = [values] * len(patterns) if isinstance(values, str) else list(values)
        if len(values) != len(patterns):
            raise InvalidArgumentError("as many values as patterns are needed")
        parts = [p.pattern if isinstance(p, re.Pattern) else re.escape(p) if literal else p for p in patterns]
        joined = re.compile("|".join(f"(?P<p{k}_>{p})" for k, p in enumerate(parts)))
        call = _python(lambda t: joined.sub(lambda m: values[next(k for k in range(len(parts)) if m[f"p{k}_"] is not None)], t), "string")
        return self._map(lambda c: call(c))

    def head(self, n: int = 1) -> Expr:
        return self._map(lambda c: F.substring(c, 1, n) if n >= 0 else F.substring(c, F.lit(1), F.length(c) + n))

    def tail(self, n: int = 1) -> Expr:
        return self._map(lambda c: F.right(c, F.lit(n)) if n >= 0 else F.substring(c, 1 - n, 1 << 30))

    def slice(self, offset: int, length: int | None = None) -> Expr:
        def f(c):
            start = F.lit(offset) if offset >= 0 else F.greatest(F.length(c) + offset, F.lit(0))
            return F.substring(c, start + 1, F.lit(1 << 30 if length is None else max(0, length)))

        return self._map(f)

    def join(self, delimiter: str = "", ignore_nulls: bool = False) -> Expr:
        return self.expr._map(lambda c, _: F.array_join(c, delimiter) if ignore_nulls else F.array_join(c, delimiter, ""))

    def json_decode(self, schema: str | None = None) -> Expr:
        return self._map(lambda c: F.from_json(c, schema) if schema else F.try_parse_json(c))

    def json_path_match(self, path: str) -> Expr:
        """The first match of a JSONPath as text."""
        if re.fullmatch(r"\$(\.[A-Za-z_]\w*|\['[^']+'\]|\[\d+\])*", path):
            return self._map(lambda c: F.get_json_object(c, path))
        from .jsonpath import first_match

        call = _python(lambda t: first_match(t, path), "string")
        return self._map(lambda c: call(c))

    def len_chars(self) -> Expr:
        """Code points."""
        return self._map(lambda c: F.length(c))

    len = len_chars

    def len_bytes(self) -> Expr:
        return self._map(lambda c: F.octet_length(c))

    def lower(self) -> Expr:
        return self._map(lambda c: F.lower(c))

    to_lower_case = lower

    def upper(self) -> Expr:
        return self._map(lambda c: F.upper(c))

    to_upper_case = upper

    def lpad(self, width: int, fill: str = " ") -> Expr:
        return self._map(lambda c: F.when(F.length(c) < width, F.lpad(c, width, fill)).otherwise(c) if fill else c)

    pad_start = lpad

    def rpad(self, width: int, fill: str = " ") -> Expr:
        return self._map(lambda c: F.when(F.length(c) < width, F.rpad(c, width, fill)).otherwise(c) if fill else c)

    pad_end = rpad

    def zfill(self, width: int) -> Expr:
        return self.lpad(width, "0")

    def normalize(self, form: str = "NFC") -> Expr:
        if form not in ("NFC", "NFD", "NFKC", "NFKD"):
            raise InvalidArgumentError(f"unknown form {form}")
        import unicodedata

        call = _python(lambda t: unicodedata.normalize(form, t), "string")
        return self._map(lambda c: F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(call(c)))

    def reverse(self) -> Expr:
        return self._map(lambda c: F.reverse(c))

    def split(self, delimiter: str, inclusive: bool = False, limit: int | None = None, exact: bool = False, strict: bool = False) -> Expr:
        """Parts between a literal delimiter; limit counts splits, exact pads with nulls to limit + 1 parts."""
        p = quote(delimiter) if not inclusive else f"(?<={quote(delimiter)})"

        def f(c):
            out = F.split(c, p, -1 if limit is None else limit + 1) if delimiter else F.filter(F.split(c, ""), lambda x: x != "")
            if inclusive:
                out = F.filter(out, lambda x: x != "")
            if exact and limit is not None:
                out = let(out, lambda o: F.concat(o, F.array_repeat(F.lit(None).cast("string"), F.greatest(limit + 1 - F.size(o), F.lit(0)))))
            if strict and limit is not None:
                out = F.when(F.size(out) < limit + 1, F.raise_error(F.lit("too few parts")).cast("array<string>")).otherwise(out)
            return out

        return self._map(f)

    def _strip(self, characters, start: bool, end: bool) -> Expr:
        p = java(characters) if isinstance(characters, re.Pattern) else f"[{quote(characters)}]" if characters is not None else r"[\s ﻿]"
        whole = "|".join(([f"^(?:{p})+"] if start else []) + ([f"(?:{p})+$"] if end else []))
        return self._map(lambda c: F.nullif(F.regexp_replace(c, whole, ""), F.lit("")))

    def strip_chars(self, characters=None) -> Expr:
        return self._strip(characters, True, True)

    def strip_chars_start(self, characters=None) -> Expr:
        return self._strip(characters, True, False)

    def strip_chars_end(self, characters=None) -> Expr:
        return self._strip(characters, False, True)

    def trim(self) -> Expr:
        return self._strip(None, True, True)

    def trim_start(self) -> Expr:
        return self._strip(None, True, False)

    def trim_end(self) -> Expr:
        return self._strip(None, False, True)

    def strip_prefix(self, prefix: str) -> Expr:
        return self._map(lambda c: F.when(F.startswith(c, F.lit(prefix)), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c))

    def strip_suffix(self, suffix: str) -> Expr:
        return self._map(lambda c: F.when(F.endswith(c, F.lit(suffix)), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c))

    def strptime(self, format: str, strict: bool = True) -> Expr:
        return self._map(lambda c: F.try_to_timestamp(c, F.lit(java_format(format))))

    def to_date(self) -> Expr:
        return self._map(lambda c: F.coalesce(c.try_cast("date"), *[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in DATE_FORMATS]))

    def to_datetime(self) -> Expr:
        return self._map(lambda c: F.coalesce(c.try_cast("timestamp"), *[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]))

    def to_time(self) -> Expr:
        def f(c):
            clock = F.when(c.rlike(r"^\d{1,2}:\d{2}"), F.concat(F.lit("1970-01-01 "), c)).otherwise(c)
            return F.date_format(clock.try_cast("timestamp"), "HH:mm:ss.SSS")

        return self._map(f)

    def to_decimal(self, precision: int = 38, scale: int = 18) -> Expr:
        dtype = Decimal(precision, scale)
        return self.expr._map(lambda c, ctx: coerce(c, ctx.dtype(c), dtype))

    def to_integer(self) -> Expr:
        def f(c):
            n = clean_number(c)
            n = F.when(~F.isnan(n), F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)))
            return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(_INT32.low)), F.lit(_INT32.high))).cast("int")

        return self._map(f)

    def _cased(self, join: str, first, rest) -> Expr:
        call = _python(lambda t: join.join((first if k == 0 else rest)(w) for k, w in enumerate(words_of(t))), "string")
        return self._map(lambda c: call(c))

    def to_camel_case(self) -> Expr:
        return self._cased("", lambda w: w.lower(), lambda w: w.capitalize())

    def to_pascal_case(self) -> Expr:
        return self._cased("", lambda w: w.capitalize(), lambda w: w.capitalize())

    def to_snake_case(self) -> Expr:
        return self._cased("_", lambda w: w.lower(), lambda w: w.lower())

    def to_kebab_case(self) -> Expr:
        return self._cased("-", lambda w: w.lower(), lambda w: w.lower())

    def to_title_case(self) -> Expr:
        return self._cased(" ", lambda w: w.capitalize(), lambda w: w.capitalize())


#: Formats beyond ISO that dates are read in.
DATE_FORMATS = ["MMM d yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "M/d/yyyy", "yyyy/M/d"]
