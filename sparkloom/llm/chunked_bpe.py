"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last `HASH_BYTES` bytes cuts every text into chunks at places that depend on the content alone,
so passages that documents share fall into the same chunks. A worker encodes each distinct chunk once and keeps it (the
caches are bounded, with two generations). A chunk that begins or ends inside a word has wrong ids there: at each joint
the word across it is encoded anew, together with the words before and after it. Where these keep their ids at both ends
of the new ones, the joint agrees. Where they don't, the two chunks become one, which is encoded anew as a whole and has
joints at its ends alone, until all joints agree (at worst the text is one chunk). The result equals the library's ids.

Chunks are shared among the documents that a worker reads. Sending every chunk and its ids through shuffles, to encode
it once for all workers, would move about twice the input.

The vocabulary must have a word tokenizer that never looks across spaces, such as word_bpe_49k.json.

Edge cases: null text is empty and has no ids; rows that repeat are encoded each; an empty table gives an empty table;
other columns of the input are ignored. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_stand_ins, load_tokenizer
from .common import map_arrow, whole_text

HASH_BYTES, CUT_BITS = 8, 9
#: Entries of each of the two generations of a worker's caches.
WORDS, CHUNKS = 150_000, 8_000
#: Characters of a word, and of a chunk, that is kept.
WORD_CHARS, CHUNK_CHARS = 48, 8_192
SEGMENT = 1 << 20
#: Latin letters (of one class and composition in every Unicode version), then marks: a word of one or two pre-tokens.
_PLAIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ľŁ-ňŊ-ž]+)([.,;:!?]*)")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # fixed value: the odd number next to 2^64 over the golden ratio


class Kept(dict):
    """key -> make(key). When the young generation is full it becomes the old one, and that is dropped."""

    def __init__(self, make, entries: int, chars: int):
        super().__init__()
        self.make, self.entries, self.chars, self.old = make, entries, chars, {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= self.chars:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


def cuts(text: str) -> list[int]:
    """Code-point offsets of chunk ends: where the rolling hash of the bytes before meets the mask."""
    data = text.encode("utf-8", "surrogatepass")
    padded, found = bytes(HASH_BYTES) + data, []
    for s in range(0, len(data), SEGMENT):
        n = min(SEGMENT, len(data) - s)
        words = np.ndarray((n,), dtype="<u8", buffer=padded, offset=s + 1, strides=(1,))
        found.append(np.flatnonzero((words * _MULTIPLIER) >> np.uint64(64 - CUT_BITS) == 0) + s + 1)
    at = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    if len(data) == len(text):
        return at.tolist()
    raw = np.frombuffer(data, dtype=np.uint8)
    begins = np.append((raw & 0xC0) != 0x80, True)
    at = at[begins[at]]  # not inside a character
    return np.cumsum(begins)[at - 1].tolist() if len(at) else []


class ChunkEncoder:
    def __init__(self, path: str):
        self.library = load_tokenizer(path)
        self.tokens = {i: t.encode() for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.fast = self._fast()
        self.words = Kept(self._word, WORDS, WORD_CHARS)
        self.chunks = Kept(self._chunk, CHUNKS, CHUNK_CHARS)
        self.joints = Kept(self._ids, CHUNKS, CHUNK_CHARS)
        #: Chunks that were met and made, and joints that were widened.
        self.met = self.made = self.widened = 0

    def _fast(self):
        """The same vocabulary in a faster encoder, which sees the end of a word as one more byte; None for other kinds."""
        import tiktoken

        spec = json.loads(self.library.to_str())
        vocabulary, suffix, added = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"], {x["content"] for x in spec["added_tokens"]}
        if suffix != "</w>" or [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            return None
        # merges take the order of their results' ids, and single bytes come before all merges
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            return None
        byte_of = byte_stand_ins()
        ranks = {b"\xff": len(vocabulary) + 1}
        for token, i in vocabulary.items():
            if token not in added:
                bare, end = (token.removesuffix(suffix), b"\xff") if token.endswith(suffix) else (token, b"")
                ranks[bytes(byte_of[c] for c in bare) + end] = i
        return tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _word(self, word: str) -> bytes:
        if self.fast is not None and len(word) < 256 and (m := _PLAIN_WORD.fullmatch(word)):
            letters, marks = m.groups()
            ids = self.fast(letters.lower().encode() + b"\xff")
            if marks:
                ids += self.fast(marks.encode() + b"\xff")
            return array("I", ids).tobytes()
        return self._ids(word)

    def _ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def _chunk(self, chunk: str) -> tuple[str, str | None, bytes, str | None, str | None]:
        """First word, second, ids of the inner words, last but one, last. A chunk of one word has the first alone, of two no inner ones."""
        self.made += 1
        first, *inner = chunk.split(" ")
        if not inner:
            return first, None, b"", None, None
        last = inner.pop()
        return first, inner[0] if inner else None, b"".join(map(self.words.__getitem__, inner)), inner[-1] if inner else None, last

    def _wide(self, chunk: str) -> tuple[str, str | None, bytes, str | None, str | None]:
        """As _chunk, of chunks whose joint did not agree: the inner words are encoded together."""
        first, *inner = chunk.split(" ")
        if not inner:
            return first, None, b"", None, None
        last = inner.pop()
        return first, inner[0] if inner else None, self._ids(" ".join(inner)), inner[-1] if inner else None, last

    def _joint(self, before: str | None, word: str, after: str | None) -> bytes | None:
        """The ids of the word across a joint, or None where its neighbours' ids do not agree."""
        new = self.joints[" ".join(w for w in (before, word, after) if w is not None)]
        head, tail = (self.words[w] if w is not None else b"" for w in (before, after))
        if new.startswith(head) and new.endswith(tail) and len(new) >= len(head) + len(tail):
            return new[len(head) : len(new) - len(tail)]
        return None

    def encode(self, text: str) -> bytes:
        """The library's ids of text, with add_special_tokens=False, as little-endian uint32 bytes."""
        bounds = [0, *(x for x in cuts(text) if 0 < x < len(text)), len(text)]
        spans, wide = list(zip(bounds, bounds[1:])), set()
        while True:
            out, bad = self._join(text, spans, wide)
            if not bad:
                return b"".join(out)
            self.widened += len(bad)
            if len(spans) == 1:
                return self._ids(text)
            merged: list[tuple[int, int]] = []
            for k, (a, b) in enumerate(spans):
                if any(x < k <= y for x, y in bad):
                    wide.discard(merged[-1])
                    merged[-1] = (merged[-1][0], b)
                    wide.add(merged[-1])
                else:
                    merged.append((a, b))
            spans = merged

    def _join(self, text: str, spans: list[tuple[int, int]], wide: set) -> tuple[list[bytes], list[tuple[int, int]]]:
        """The ids of chunks and joints, and for each joint that does not agree the chunks from whose inner words to whose it reaches."""
        out, bad = [], []
        before, word, since = None, "", 0  # the word before the open one, and the open one: it may go on in the next chunk
        for k, (a, b) in enumerate(spans):
            self.met += 1
            first, after, inner, held, last = self._wide(text[a:b]) if (a, b) in wide else self.chunks[text[a:b]]
            word += first
            if last is None:  # no space in this chunk
                continue
            joint = self._joint(before, word, after)
            if joint is None:
                bad.append((since, k) if since < k else (k, k + 1) if k + 1 < len(spans) else (k - 1, k))
            out += [joint or b"", inner]
            before, word, since = word if held is None else held, last, k
        joint = self._joint(before, word, None)
        if joint is None:
            k = len(spans) - 1
            bad.append((since, k) if since < k else (k - 1, k))
        return [*out, joint or b""], bad

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the library's decode(ids, skip_special_tokens=False) for a vocabulary without decoder: tokens joined by spaces."""
        if self.library.decoder is not None:
            return self.library.decode(np.frombuffer(ids, dtype="<u4").tolist(), skip_special_tokens=False).encode()
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """One to a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, outputs: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document and, if outputs, ids (binary) and decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if outputs else "")

    def run(batches):
        coder = chunk_encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = coder.encode(text)
                decoded = coder.decode(ids)
                rows.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), *((ids, decoded.decode()) if outputs else ())))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()][: 6 if outputs else 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), run, schema)
