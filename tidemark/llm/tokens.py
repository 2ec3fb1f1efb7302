"""Token ids of a byte-level BPE tokenizer file, encoded through its rank table.

The file is a ``tokenizers`` JSON.  Its merges are in id order for byte-level BPE of this family, so the vocabulary is
also a rank table and the rank encoder gives the same ids several times faster.  Files that are not of that kind, and
the rare text that the rank encoder refuses, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

#: The pre-tokenizer pattern of the byte-level BPE family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class Encoder:
    def __init__(self, path: str):
        self.path, self._plain = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [a["content"] for a in spec.get("added_tokens", [])]
        self.ranked = self._ranked(spec)

    @property
    def plain(self):
        """The tokenizer library's own encoder, loaded when first needed: it is the larger of the two."""
        if self._plain is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._plain = Tokenizer.from_file(self.path)
        return self._plain

    def _ranked(self, spec: dict):
        model, pre, letters = spec["model"], spec.get("pre_tokenizer") or {}, byte_letters()
        added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        words = {w: i for w, i in model.get("vocab", {}).items() if w not in added}
        usual = (
            model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None
            and not model.get("byte_fallback") and not model.get("ignore_merges")
            and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in spec.get("added_tokens", []))
            and all(c in letters for w in words for c in w)
        )
        if not usual:
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if [words.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in w): i for w, i in words.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str) -> np.ndarray:
        if self.ranked is not None:
            try:
                if any(s in text for s in self.special):
                    return np.asarray(self.ranked.encode(text, allowed_special="all"), np.uint32)
                return np.asarray(self.ranked.encode_ordinary(text), np.uint32)
            except BaseException as e:  # noqa: BLE001  a regex limit surfaces as a panic, which is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return np.asarray(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
