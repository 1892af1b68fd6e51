"""Public tokenizers inside tasks: ids of whole texts, and the bytes of every token.

The driver reads a tokenizer's file and sends its bytes; a worker builds the tokenizer once. A byte-level vocabulary
file of the `tokenizers` library whose merges are in the order of their ids is run by `tiktoken`, which gives the same
ids several times faster (tests hold the two equal, on every class of characters too); any other by `tokenizers`
itself.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np


def _byte_characters() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself if it is visible, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level merge vocabulary. plain: the strings of special tokens are ordinary text."""

    def __init__(self, data: bytes, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.plain = plain
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = plain
        spec = json.loads(data)
        added = {t["id"]: t for t in spec.get("added_tokens") or []}
        byte_of = _byte_characters()
        size = self.tokenizer.get_vocab_size()
        self.token_bytes = [added[i]["content"].encode() if i in added else bytes(byte_of[c] for c in self.tokenizer.id_to_token(i) or "") for i in range(size)]
        self.fast = self._fast(spec, added)

    def _fast(self, spec: dict, added: dict):
        """The same merges in tiktoken, if the file's settings are those that it has."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        plain_settings = (
            model.get("type", "BPE") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec.get("normalizer")
            and all(model["vocab"].get("".join(m)) == 256 + i for i, m in enumerate(merges))
            and not any(t.get(k) for t in added.values() for k in ("lstrip", "rstrip", "single_word", "normalized"))
        )
        if not plain_settings:
            return None
        import public_tokenizers
        import tiktoken

        ranks = {self.token_bytes[i]: i for i in model["vocab"].values() if i not in added}
        special = {t["content"]: i for i, t in added.items()}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        ids = self.fast.encode_ordinary(text) if self.plain else self.fast.encode(text, allowed_special="all")
        return np.asarray(ids, np.uint32)


class Pieces:
    """A vocabulary of the `sentencepiece` library, which puts a space before the text."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.token_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.processor.encode(text, num_threads=1), np.uint32)


_BUILT: dict[tuple, ByteLevel | Pieces] = {}


def coder(kind: str, data: bytes) -> ByteLevel | Pieces:
    """The worker's tokenizer: 'byte' (special strings are special), 'byte-plain' (they are text) or 'piece'."""
    key = (kind, hashlib.sha256(data).digest())
    if key not in _BUILT:
        _BUILT[key] = Pieces(data) if kind == "piece" else ByteLevel(data, kind == "byte-plain")
    return _BUILT[key]


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def public(name: str) -> str:
    """Path of a file of the installed vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_of(value) -> str | None:
    """A string of an Arrow column; bytes that aren't UTF-8 become replacement characters."""
    if not value.is_valid:
        return None
    return value.as_buffer().to_pybytes().decode("utf-8", "replace")
