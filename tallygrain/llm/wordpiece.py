"""Token ids of whole texts by the public word tokenizer, with a bounded cache of chunks.

The tokenizer splits at white space and between letters and other signs before
it merges anything, so the ids of a text are those of its chunks one after the
other.  Texts for which that is not certain go to the library
whole.  What the library returns for a chunk is kept until the cache is full.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

GENERATION = 250_000  # chunks in one generation of a worker's cache
LONG = 64  # longer chunks are not remembered
# letters that lower case and composition leave alone, signs that never join a letter, plain white space
_SAFE = re.compile(r"[\t\n\r\x20-\x7eß-öø-ÿ\u2010-\u2027]*")
_CHUNK = re.compile(r"[a-zß-öø-ÿ]+|[^\sa-zß-öø-ÿ]+")
_tokenizer = None


class _Cache(dict):
    """Ids by chunk in two generations; what is asked for in vain is noted.

    A full generation becomes the old one, and a chunk that is met again moves
    to the young one, so frequent chunks stay while rare ones pass through.
    """

    def __init__(self) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.missing: list[str] = []

    def __missing__(self, chunk: str) -> bytes | None:
        ids = self.old.get(chunk)
        if ids is None:
            self.missing.append(chunk)
        else:
            self[chunk] = ids
        return ids

    def learn(self, found: dict[str, bytes]) -> None:
        if len(self) + len(found) > GENERATION:
            self.old = dict(self)
            self.clear()
        self.update(found)

    def forget(self) -> None:
        """A worker lives longer than a task: the young generation, which is bounded, stays for the next one."""
        self.old = {}


_cache = _Cache()


def _library():
    """The tokenizer, and which of its ids end a word."""
    global _tokenizer
    if _tokenizer is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        ends = np.zeros(t.get_vocab_size(), bool)
        ends[[i for piece, i in t.get_vocab().items() if piece.endswith("</w>")]] = True
        _tokenizer = t, ends
    return _tokenizer


def _encode(text: str) -> np.ndarray:
    # fast: without the places of the ids in the text, which nobody asks for here
    return np.array(_library()[0].encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)


def _learn(chunks: list[str]) -> dict[str, bytes]:
    """Ids of chunks; words are encoded together and told apart by the ids that end a word."""
    found = {c: _encode(c).tobytes() for c in chunks if not c[0].isalpha()}
    words = [c for c in chunks if c[0].isalpha()]
    ids = _encode(" ".join(words))
    ends = np.flatnonzero(_library()[1][ids]) + 1
    if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
        return found | {c: _encode(c).tobytes() for c in words}
    data, at = ids.tobytes(), 0
    for c, e in zip(words, (2 * ends).tolist()):
        found[c] = data[at:e]
        at = e
    return found


def encoded_ids(text: str) -> np.ndarray:
    """Ids as the library gives them for the whole text, without added special tokens."""
    low = text.lower()
    # within these letters lower case and composition work letter by letter
    if "<|" in text or "'" in text or not _SAFE.fullmatch(low) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
        return _encode(text)
    chunks = _CHUNK.findall(low)
    parts = list(map(_cache.__getitem__, chunks))
    if _cache.missing:
        missing = list(dict.fromkeys(_cache.missing))
        _cache.missing.clear()
        found = _learn(missing)
        parts = [found[c] if p is None else p for p, c in zip(parts, chunks)]
        _cache.learn({c: found[c] for c in missing if len(c) <= LONG})
    return np.frombuffer(b"".join(parts), np.uint16)


def forget() -> None:
    _cache.forget()
