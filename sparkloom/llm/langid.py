"""Language ID by Bayesian evidence fusion.

For each row, log evidence for every known language is summed: the text's likelihood under byte-trigram models (tempered,
as neighbouring trigrams are no independent evidence), the language that the markup declares, the language that the
address names (path segment or country suffix), and a prior of the row's host. Host priors come from a grouped
aggregation of the other evidence's posteriors and are smoothed hierarchically, host towards domain towards all rows; a
row's own share is taken out of its prior. Trigram models are fitted to at most `SAMPLE_ROWS` rows of known language, dealt
evenly over all languages that any row has (one row each where there are more), and of a longer text to `SAMPLE_CHARS`
characters from a place that the row's hash chooses. What is identified is read whole.

Rows come with any of the columns text, html, url, source: html gives text and markup where there is no text, the host
is the url's or else source. Edge cases: null or empty text, or one without letters, has no text evidence; a missing
host is a host of its own; unknown declared languages are no evidence; rows that repeat are judged each; without any
sample every row is undetermined (language null, confidence 0); an empty table gives an empty table; other columns are
kept or ignored, whatever their names. Html is read in linear time, however broken: a comment or a dropped element that
never ends, and a tag that never closes, stand as text.
"""

from __future__ import annotations

import html as html_lib
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, spread_join, stored, unused

SAMPLE_ROWS, SAMPLE_CHARS = 3000, 4000
#: First bits of a hash that rows are counted by.
HASH_BITS = 10
BITS = 16
#: Trigrams that count as independent evidence at most, and the weight of each.
TEXT_GRAMS, TEXT_WEIGHT = 200, 0.5
#: How often declared and address languages are right.
MARKUP_RIGHT, ADDRESS_RIGHT = 0.9, 0.8
#: Rows that a smoothing level counts as.
SMOOTHING = 20.0
MIN_CONFIDENCE = 0.5
#: Bytes of host priors that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: A host is hot from one part in so many of all rows on.
HOT_KEYS = 1000
_MULTIPLIER = np.uint32(0x9E3779B1)  # fixed value: a prime next to 2^32 over the golden ratio
_DROPPED = re.compile(r"(?i)<!--|<(script|style|nav|template)\b")
_CLOSED = re.compile(r"(?i)</(script|style|nav|template)\s*>")
_NAMED_TAG = re.compile(r"(?i)<(html|meta)\b[^<>]*")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})\b")
_CONTENT = re.compile(r"(?i)content\s*=\s*[\"']?([a-z]{2,3})\b")
_SEGMENT = re.compile(r"/([a-z]{2})(?:[-_][A-Za-z]{2})?(?=/|$)")
#: Languages of country suffixes that are not named like them.
SUFFIX = {"at": "de", "mx": "es", "ar": "es", "uk": "en", "us": "en"}


def _without_dropped(html: str) -> str:
    """html without comments and elements that show no text."""
    ends: dict[str, list[int]] = {}
    for m in _CLOSED.finditer(html):
        ends.setdefault(m[1].lower(), []).append(m.start())
    for places in ends.values():
        places.reverse()  # the next one is taken from the end
    out, at, look, comments = [], 0, 0, True
    while m := _DROPPED.search(html, look):
        look, end = m.end(), -1
        if m[1] is None:
            end = html.find("-->", look) + 3 if comments else 2
            comments = end > 2
            end = end if comments else -1
        else:
            places = ends.get(m[1].lower(), [])
            while places and places[-1] < look:
                places.pop()
            if places:
                end = html.index(">", places[-1]) + 1
        if end >= 0:
            out += [html[at : m.start()], " "]
            at = look = end
    return "".join(out) + html[at:]


def page_text(html: str) -> str:
    text, out, at = _without_dropped(html), [], 0
    while (start := text.find("<", at)) >= 0 and (end := text.find(">", start)) >= 0:
        out += [text[at:start], " "]
        at = end + 1
    return html_lib.unescape("".join(out) + text[at:])


def declared_language(html: str) -> str | None:
    for tag in _NAMED_TAG.finditer(html):
        if tag[1].lower() == "html":
            m = _LANG.search(tag[0])
        else:
            at = tag[0].lower().find("content-language")
            m = _CONTENT.search(tag[0], at + len("content-language")) if at >= 0 else None
        if m:
            return m[1].lower()
    return None


def address(url: str | None) -> tuple[str | None, str | None]:
    """(host, language that the address names)."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname
    except ValueError:
        return None, None
    m = _SEGMENT.search(parts.path)
    last = (host or "").rpartition(".")[2]
    return host, m[1] if m else SUFFIX.get(last, last) or None


def domain_of(host: str) -> str:
    return ".".join(host.split(".")[-2:])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' byte trigrams in a row, and where each text's begin."""
    raw = [t.lower().encode("utf-8", "surrogatepass") + b"\0\0" for t in texts]
    size = np.array([len(x) - 2 for x in raw], dtype=np.int64)
    data = b"".join(raw) + b"\0\0"
    start = np.cumsum(size + 2) - size - 2
    first = np.cumsum(size) - size
    at = np.repeat(start - first, size) + np.arange(size.sum())
    values = np.ndarray((max(0, len(data) - 4),), dtype="<u4", buffer=data, strides=(1,))[at] & np.uint32(0xFFFFFF)
    return (values * _MULTIPLIER) >> np.uint32(32 - BITS), first


class Languages:
    """Trigram models: log probability by bucket and language."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.names = sorted(set(langs))
        counts = np.zeros((len(self.names), 1 << BITS))
        for k, name in enumerate(self.names):
            for t, lang in zip(texts, langs):
                if lang == name:
                    counts[k] += np.bincount(trigrams([t])[0], minlength=1 << BITS)
        self.table = np.ascontiguousarray(np.log((counts + 0.1) / (counts + 0.1).sum(axis=1, keepdims=True)).T.astype(np.float32))

    def text_evidence(self, texts: list[str]) -> np.ndarray:
        out, group, at, size = np.zeros((len(texts), len(self.names))), [], 0, 0
        for k, t in enumerate(texts):
            group.append(t)
            size += len(t)
            if size > 1 << 20 or k == len(texts) - 1:
                grams, first = trigrams(group)
                count = np.diff(np.append(first, len(grams)))
                full = np.flatnonzero(count)
                if len(full):
                    total = np.add.reduceat(self.table[grams], first[full], axis=0, dtype=np.float64)
                    out[at + full] = total * (TEXT_WEIGHT * np.minimum(1, TEXT_GRAMS / count[full]))[:, None]
                at, group, size = k + 1, [], 0
        for k, t in enumerate(texts):
            if not any(map(str.isalpha, t[:200])) and not any(map(str.isalpha, t)):
                out[k] = 0
        return out

    def named(self, langs: list[str | None], right: float) -> np.ndarray:
        """Log evidence of language names that are right so often."""
        wrong = (1 - right) / max(1, len(self.names) - 1)
        place = {n: k for k, n in enumerate(self.names)}
        out = np.zeros((len(langs), len(self.names)))
        for i, lang in enumerate(langs):
            if lang in place:
                out[i] = np.log(wrong)
                out[i, place[lang]] = np.log(right)
        return out

    def evidence(self, rows: dict[str, list]) -> tuple[np.ndarray, list[str], list[str | None], list[str | None]]:
        """Log evidence without priors, hosts, declared and address languages."""
        n = len(next(iter(rows.values()), []))
        pages, texts, urls, sources = ([x if x is None else str(x) for x in rows.get(k) or [None] * n] for k in ("html", "text", "url", "source"))
        declared = [h and declared_language(h) for h in pages]
        found = [address(u) for u in urls]
        hosts = [h or s or "" for (h, _), s in zip(found, sources)]
        near = [lang for _, lang in found]
        texts = [t if t is not None else page_text(h) if h else "" for t, h in zip(texts, pages)]
        return self.text_evidence(texts) + self.named(declared, MARKUP_RIGHT) + self.named(near, ADDRESS_RIGHT), hosts, declared, near


def posterior(log_evidence: np.ndarray) -> np.ndarray:
    p = np.exp(log_evidence - log_evidence.max(axis=1, keepdims=True, initial=-1e300))
    return p / p.sum(axis=1, keepdims=True)


def quota(sizes: list[int], rows: int) -> int:
    """Rows of each language at most, so that rows in all are not exceeded; at least 1."""
    left = rows
    for k, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - k)
        if n > share:
            return max(1, share)
        left -= n
    return max(sizes, default=0)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS):
    """Broadcast models from docs (text, lang): of each language, those rows that have the lowest hashes.

    All rows are counted by language and by their hashes' first bits, so every language has a share of the rows, and only
    rows near the lowest hashes are ranked. There are at most `rows` rows, or one of each language where there are more.
    """
    others = [c for c in docs.columns if c not in ("text", "html")]
    hashed = others if set(others) - {"lang"} else ["text"]  # texts are hashed only where nothing else tells rows apart
    h = F.xxhash64(*hashed)
    start = (F.pmod(h, F.greatest(F.lit(1), F.length("text") - chars + 1)) + 1).cast("int")
    known = docs.filter("text is not null and lang is not null").select(h.alias("h"), F.substring("text", start, F.lit(chars)).alias("text"), "lang").withColumn("bits", F.shiftrightunsigned("h", 64 - HASH_BITS).cast("int"))
    counted: dict[str, list] = {}
    for r in known.groupBy("lang", "bits").count().toArrow().to_pylist():
        counted.setdefault(r["lang"], []).append((r["bits"], r["count"]))
    most = quota([sum(n for _, n in c) for c in counted.values()], rows)
    last = []
    for lang, c in counted.items():
        n = 0
        for bits, more in sorted(c):
            n += more
            if n >= most:
                break
        last.append((lang, bits))
    got = []
    if last:
        near = known.join(F.broadcast(docs.sparkSession.createDataFrame(last, "lang string, last int")), "lang").filter("bits <= last")
        got = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("bits", "h", "text"))).filter(F.col("rank") <= most).select("text", "lang").collect()
    return docs.sparkSession.sparkContext.broadcast(Languages([r["text"] for r in got], [r["lang"] for r in got]))


def _evidence_columns(df: DataFrame) -> list[str]:
    return [c for c in ("text", "html", "url", "source") if c in df.columns]


def host_priors(df: DataFrame, models) -> DataFrame:
    """host, share, n_host, domain_share: summed posteriors of the host's rows, their number, and the smoothed prior of its domain."""
    used = _evidence_columns(df)

    def run(batches):
        for batch in batches:
            log, hosts, _, _ = models.value.evidence({c: batch.column(k).to_pylist() for k, c in enumerate(used)})
            sums: dict[str, list] = {}
            for host, p in zip(hosts, posterior(log)):
                x = sums.setdefault(host, [0, np.zeros(len(p))])
                x[0] += 1
                x[1] = x[1] + p
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([domain_of(h) for h in sums], pa.string()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["host", "domain", "n", "p"])

    width = len(models.value.names)
    parts = map_arrow(df.select(*used), run, "host string, domain string, n long, p array<double>")
    total = [F.sum(F.get("p", k)).alias(f"p{k}") for k in range(width)]
    hosts = stored(parts.groupBy("host", "domain").agg(F.sum("n").alias("n_host"), *total), "hosts")  # texts are read once for it
    domains = hosts.groupBy("domain").agg(F.sum("n_host").alias("n_domain"), *[F.sum(f"p{k}").alias(f"d{k}") for k in range(width)])
    every = domains.agg(F.sum("n_domain").alias("n_all"), *[F.sum(f"d{k}").alias(f"a{k}") for k in range(width)]).first()
    overall = [((every[f"a{k}"] or 0) + 1) / ((every["n_all"] or 0) + width) for k in range(width)]
    smooth = [((F.col(f"d{k}") + SMOOTHING * overall[k]) / (F.col("n_domain") + SMOOTHING)) for k in range(width)]
    up = domains.select("domain", F.array(*smooth).alias("domain_share"))
    return hosts.join(up, "domain").select("host", "n_host", F.array(*[F.col(f"p{k}") for k in range(width)]).alias("share"), "domain_share")


def _host_column(df: DataFrame):
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in df.columns else F.lit("")
    if "url" not in df.columns:
        return source

    @F.arrow_udf("string")
    def host(url: pa.Array) -> pa.Array:
        return pa.array([address(u)[0] for u in url.to_pylist()], pa.string())

    return F.coalesce(F.nullif(host(F.col("url").cast("string")), F.lit("")), source)


def with_priors(df: DataFrame, models) -> tuple[DataFrame, list[str]]:
    """df with its hosts' priors (null for hosts that gave none), and the names of their columns: rows, summed and domain's share."""
    priors = host_priors(df, models)
    host, *names = unused(df, "host", "n_host", "share", "domain_share")
    right = priors.select(F.col("host").alias(host), *[F.col(c).alias(n) for c, n in zip(("n_host", "share", "domain_share"), names)])
    left = df.withColumn(host, _host_column(df))
    hosts, rows = priors.agg(F.count(F.lit(1)), F.sum("n_host")).first()
    if hosts * (16 * len(models.value.names) + 100) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), host, "left").drop(host), names
    return spread_join(left, right, host, right.filter(F.col(names[0]) > rows / HOT_KEYS)).drop(host), names


def _fuse(models, batch, names: list[str]):
    """Posterior of each row, and its text's declared and address languages; names: of the priors' columns."""
    rows = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "html", "url", "source") if c in batch.schema.names}
    log, _, declared, near = models.value.evidence(rows)
    own, prior = posterior(log), np.zeros(log.shape)
    columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)
    for k, (n, share, domain) in enumerate(zip(*columns)):
        if n is not None:
            rest = np.maximum(np.array(share) - own[k], 0)  # without the row itself
            prior[k] = np.log((rest + SMOOTHING * np.array(domain)) / (n - 1 + SMOOTHING))
    return posterior(log + prior), declared, near


def identify(df: DataFrame, models, key: str, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """key, language, confidence, declared, address and kept of each row."""
    used = _evidence_columns(df)
    schema = f"{key} long, language string, confidence double, declared string, address string, kept boolean"
    if not models.value.names:
        return df.select(F.col(key).cast("long").alias(key), *[F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("address"), F.lit(False).alias("kept")])

    rows, priors = with_priors(df.select(F.col(key).cast("long").alias(key), *[c for c in used if c != key]), models)

    def run(batches):
        for batch in batches:
            p, declared, near = _fuse(models, batch, priors)
            best = p.max(axis=1, initial=0)
            names = [models.value.names[k] for k in p.argmax(axis=1)] if len(p) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(declared, pa.string()), pa.array(near, pa.string()), pa.array(best >= min_confidence, pa.bool_())], names=[x.split()[0] for x in schema.split(", ")])

    return map_arrow(rows, run, schema)


def keep_identified(df: DataFrame, models, languages: list[str] | None = None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The rows of df (every column) whose language is determined and, where languages are given, one of them."""
    if not models.value.names:
        return df.limit(0)
    names = df.columns
    rows, priors = with_priors(df, models)

    def run(batches):
        for batch in batches:
            p, _, _ = _fuse(models, batch, priors)
            keep = p.max(axis=1, initial=0) >= min_confidence
            if languages is not None and len(p):
                keep &= np.isin(np.array(models.value.names)[p.argmax(axis=1)], languages)
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    return map_arrow(rows.select(*names, *priors), run, df.schema)
