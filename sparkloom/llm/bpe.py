"""Byte-pair encoding as the tokenizers library does it.

`byte_encoder` gives one `ByteLevelEncoder` to a Python worker. Texts of characters whose class is the same in every
Unicode version take a faster encoder that is built from the same vocabulary file; all others go to the library itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A run of this many characters without (or of) white space goes to the library, whose merge queue stays fast there.
LONG_RUN = 2000


def vocabulary_path(name: str) -> str:
    """Path of a public vocabulary file; only this function names the package that holds them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def ids_bytes(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()


def byte_stand_ins() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable ones stand for themselves, the others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


class ByteLevelEncoder:
    """ids of a text as the library gives them with add_special_tokens=False, as little-endian uint32 bytes."""

    #: ASCII, Latin, Cyrillic, common punctuation and Chinese characters: of one class in every Unicode version.
    _plain = re.compile("[\t\n\r -~¡-ɏА-яЁё‐-‧€一-龥]*")
    _blank_run = re.compile(r"\s{%d}" % LONG_RUN)

    def __init__(self, path: str):
        self.library = load_tokenizer(path)
        self.fast = self._fast()

    def _fast(self):
        import tiktoken

        spec = json.loads(self.library.to_str())
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return None
        byte_of = byte_stand_ins()
        special = {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        # fixed value: the split pattern of this pre-tokenizer
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("fast", pat_str=split, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _long_run(self, text: str) -> bool:
        return len(text) >= LONG_RUN and (max(map(len, text.split()), default=0) >= LONG_RUN or self._blank_run.search(text) is not None)

    def encode(self, text: str) -> bytes:
        if self.fast is not None and "<|" not in text and self._plain.fullmatch(text) and not self._long_run(text):
            return ids_bytes(self.fast.encode_ordinary(text))
        return ids_bytes(self.library.encode(text, add_special_tokens=False).ids)


_ENCODERS: dict[str, ByteLevelEncoder] = {}


def byte_encoder(path: str) -> ByteLevelEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelEncoder(path)
    return _ENCODERS[path]
