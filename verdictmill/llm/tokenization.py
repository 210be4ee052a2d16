"""Token ids of the public byte-level BPE inside tasks.

The ids are those of the ``tokenizers`` file as the library loads it: the text of a special token is that token.
The same vocabulary as ranks goes through ``tiktoken``, several times as fast; a text with a character outside the
ranges where both libraries cut words alike, or with the text of a special token, goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable

import numpy as np

#: Characters that both libraries are known to class alike: printable ASCII, Latin letters, common punctuation.
_SAME = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ʯ‐-‧‰-⁞€]*\Z")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Encodes texts; ``chars[id]``: how many characters begin in the token, ``inner[id]``: 1 if it begins inside one."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _bytes_of()
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        raw = {bytes(byte[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in added}
        self.slow = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=raw, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        n = max(*spec["model"]["vocab"].values(), *added.values()) + 2
        self.chars, self.inner = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for token, k in raw.items():
            self.chars[k] = sum(b & 0xC0 != 0x80 for b in token)
            self.inner[k] = token[0] & 0xC0 == 0x80
        for token, k in added.items():
            self.chars[k] = len(token)

    def encode(self, text: str) -> np.ndarray:
        if _SAME.match(text) and not (self.special and self.special.search(text)):
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode_all(self, texts: Iterable[str]) -> Iterable[np.ndarray]:
        return map(self.encode, texts)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """Loaded once in a Python worker."""
    return ByteBpe(path)
