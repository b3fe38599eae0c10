"""Token ids of a public vocabulary file, by the library that the file is for.

A byte-level BPE file whose ids follow its merges is encoded by tiktoken, which gives the same ids
as the tokenizers library at several times the speed; any other .json goes to tokenizers.
"""

from __future__ import annotations

import functools
import hashlib
import json
from typing import Callable

import numpy as np

#: Fixed value: the pre-token pattern that byte-level BPE vocabularies of this kind are defined with.
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, "Encoder"] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the others are moved, in order, to the code points from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Encoder:
    """ids(text) -> uint32 array; pieces(text) -> int. Special strings inside texts are handled as
    the library does by default; nothing is added, cut or padded."""

    def __init__(self, name: str, data: bytes):
        self.splits_at_space = False
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.ids: Callable[[str], np.ndarray] = lambda t: np.array(model.encode(t, num_threads=1), dtype=np.uint32)
        elif name.endswith(".json"):
            self.ids = self._from_json(data)
        else:
            raise ValueError(f"{name}: a .json or .model file is needed")

    def pieces(self, text: str) -> int:
        return len(self.ids(text))

    def _from_json(self, data: bytes) -> Callable[[str], np.ndarray]:
        spec = json.loads(data)
        fast = self._byte_level(spec)
        library = functools.cache(lambda: self._library(data))
        if fast is None:
            return library()
        self.splits_at_space = True

        def ids(t: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(t, allowed_special="all")
            except ValueError:  # its pattern gives up on runs of about a million blanks
                return library()(t)

        return ids

    @staticmethod
    def _library(data: bytes) -> Callable[[str], np.ndarray]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(data.decode())
        return lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, dtype=np.uint32)

    @staticmethod
    def _byte_level(spec: dict):
        """A tiktoken encoding, where the file is plain byte-level BPE with ids in the order of its merges."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (
            model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
            and not any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"])
        )
        if not plain:
            return None
        own = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get(a + b) for a, b in merges]
        if made != sorted(set(made)) or None in made or len(made) + 256 != len({k for k in model["vocab"] if k not in own}):
            return None
        import tiktoken

        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in k): v for k, v in model["vocab"].items() if k not in own}
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=own)


def load(name: str, data: bytes) -> Encoder:
    """One encoder a worker process and file."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        _loaded[key] = Encoder(name, data)
    return _loaded[key]


def file_bytes(path: str) -> bytes:
    """Read on the driver; vocabularies are a few MB and are broadcast, so executors need no such path."""
    with open(path, "rb") as f:
        return f.read()
