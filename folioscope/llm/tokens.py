"""Encoding of texts with a public tokenizer file.

A tokenizer whose words end in a mark (``end_of_word_suffix``) drops white space and never joins characters across it, so
each run of other characters is encoded once per worker and looked up after that. Others encode whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np

STRUNG = 100  # words


def dtype_for(path: str) -> str:
    """The smallest unsigned type that holds every id of the tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or [])])
    return "<u2" if most < 1 << 16 else "<u4"


class Encoder:
    """Texts (UTF-8 bytes) to ids; at most ``most`` words are remembered, in two generations."""

    def __init__(self, path: str, most: int = 1_600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = bool(json.load(f)["model"].get("end_of_word_suffix"))
        self.dtype = dtype_for(path)
        self.most, self.known, self.old = most, {}, {}

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """As ``_encode``, for words: a line of STRUNG words is one call's work, and where its ids begin tells whose they are."""
        out, size = [], np.dtype(self.dtype).itemsize
        plain = [w.decode("utf-8", "replace") for w in words]
        parts = [plain[i : i + STRUNG] for i in range(0, len(plain), STRUNG)]
        for part, found in zip(parts, self.tokenizer.encode_batch([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(found.ids, dtype=self.dtype).tobytes()
            begin = np.fromiter((a for a, _ in found.offsets), dtype=np.int64, count=len(found))
            following = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1)
            start = 0
            for end in (np.searchsorted(begin, following) * size).tolist():
                out.append(ids[start:end])
                start = end
        return out

    def _by_word(self, texts: list[list[bytes]]) -> list[bytes]:
        if len(self.known) > self.most // 2:
            self.old, self.known = self.known, {}
        found = [list(map(self.known.get, ws)) for ws in texts]
        gaps = [[i for i, x in enumerate(f) if x is None] if None in f else [] for f in found]
        new = {ws[i] for ws, g in zip(texts, gaps) for i in g}
        self.known.update((w, self.old[w]) for w in new if w in self.old)
        new = [w for w in new if w not in self.old]
        self.known.update(zip(new, self._encode_words(new)))
        for ws, f, g in zip(texts, found, gaps):
            for i in g:
                f[i] = self.known[ws[i]]
        return [b"".join(f) for f in found]

    def ids(self, texts: list[bytes | None], end_id: int):
        """For each text its ids and then ``end_id``; null is empty."""
        end = np.array([end_id], dtype=self.dtype).tobytes()
        step = 256 if self.by_word else 16
        for i in range(0, len(texts), step):
            part = [t or b"" for t in texts[i : i + step]]
            if self.by_word:
                part = self._by_word([t.split() for t in part])
            else:
                part = self._encode(part)
            for p in part:
                yield np.frombuffer(p + end, dtype=self.dtype)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Give back the words that this worker remembers, and freed memory to the system; tasks of other operators call it when
    they begin, as a worker outlives its tasks."""
    import ctypes
    import gc

    for known in _ENCODERS.values():
        known.known, known.old = {}, {}
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU C library only
    if trim is not None:
        trim(0)
