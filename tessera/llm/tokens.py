"""Token ids by a byte-level BPE vocabulary in tiktoken's rank format; its path is a parameter."""

from __future__ import annotations

import base64

import numpy as np
import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words with the space before them, digits, signs and white space; no token crosses these.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MOST_CACHED = 100_000
_loaded: dict[str, Codec] = {}


class _Words(dict):
    """Token bytes of a word with a space before it, made when first asked for."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        found = self.codec.whole(" " + word)
        if "\n" not in word and len(word) < 40:
            if len(self) >= _MOST_CACHED:
                self.clear()
            self[word] = found
        return found


class Codec:
    """Texts to little-endian 16-bit token ids and back. The id after the last rank ends a document."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = max(ranks.values()) + 1
        if self.end > 0xFFFF:
            raise ValueError(f"{path}: ids don't fit 16 bits")
        self.encoding = tiktoken.Encoding("tessera", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (self.end + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.words = _Words(self)

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u2").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as tiktoken gives them: single spaces begin words, so words are encoded once each."""
        if not text:
            return b""
        if "  " in text:
            return self.whole(text)
        first, _, rest = text.partition(" ")
        head = self.whole(first)
        return head + b"".join(map(self.words.__getitem__, rest.split(" "))) if _ else head

    def decode(self, ids: bytes, after: bytes = b"") -> str:
        """The text of ids cut from a document's, given up to three ids that follow.

        A character that a cut splits belongs to the earlier part, so that parts of a document that
        are decoded one by one join to its text.
        """
        get = self.bytes.__getitem__
        own = b"".join(map(get, np.frombuffer(ids, "<u2").tolist()))
        own = own[next((i for i, b in enumerate(own) if b & 0xC0 != 0x80), len(own)) :]
        more = b"".join(map(get, np.frombuffer(after, "<u2").tolist()))
        if own:
            own += more[: next((i for i, b in enumerate(more) if b & 0xC0 != 0x80), len(more))]
        return own.decode("utf-8", "replace")


def release() -> None:
    """Lets go of what was read: a worker that goes on to other tasks needn't hold it."""
    _loaded.clear()


def codec(path: str = VOCABULARY) -> Codec:
    """The codec of a vocabulary file, read once in a process."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]
