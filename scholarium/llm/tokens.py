"""Token ids of whole texts by the public tokenizer word_bpe_49k, with every distinct word encoded once per worker.

The tokenizer lower-cases a text, cuts it into words, digits and runs of signs, and encodes each of these by itself. Texts of
Latin letters are cut here by the same rule, and the library encodes the words that are new; all other texts go to the
library whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

#: Words whose ids a worker remembers; then it starts afresh, so memory stays bounded.
CACHE_WORDS = 500_000
#: New words that are encoded in one call.
CALL_WORDS = 1000

# The cutting rule of the tokenizer file, for characters up to U+024F.
_LETTER = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTER}{_NUMBER}]+")
#: Characters that the rule here does not cover, and the beginning of special tokens.
OTHER = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9fİɐ-\U0010ffff]|<\\|")


#: UTF-8 of most texts: plain ASCII and the letters from U+00C0 to U+00FF, where only special tokens need a look.
COMMON = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), 0xC3])


def covered(text: str) -> bool:
    """Whether the rule here cuts ``text`` as the tokenizer does."""
    if not text.encode("utf-8", "surrogatepass").translate(None, COMMON):
        return "<|" not in text
    return not OTHER.search(text)


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def _ends(path: str) -> np.ndarray:
    """Which ids end a word."""
    tok = _tokenizer(path)
    out = np.zeros(tok.get_vocab_size(), bool)
    out[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True
    return out


def id_type(path: str) -> type:
    return np.uint16 if _tokenizer(path).get_vocab_size() <= 1 << 16 else np.uint32


@functools.lru_cache(maxsize=4)
def _memory(path: str) -> dict[str, bytes]:
    return {}


def forget(path: str) -> None:
    """Free the remembered words. Idle workers stay for a while, more of them than tasks run at once, and each would keep its own."""
    _memory(path).clear()


def _learn(path: str, new: list[str], known: dict[str, bytes]) -> None:
    """Encode new words, many to a call; the ids of each end with the first one that ends a word."""
    tok, ends, dtype = _tokenizer(path), _ends(path), id_type(path)
    size = np.dtype(dtype).itemsize
    for i in range(0, len(new), CALL_WORDS):
        line = new[i : i + CALL_WORDS]
        ids = np.array(tok.encode_batch_fast([" ".join(line)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = ((np.flatnonzero(ends[ids]) + 1) * size).tolist()
        if len(cuts) != len(line):
            raise ValueError("the tokenizer cuts words in another way")
        raw, a = ids.astype(dtype).tobytes(), 0
        for w, b in zip(line, cuts, strict=True):
            known[w] = raw[a:b]
            a = b


def encode(path: str, texts: list[str | None], end_id: int | None) -> list[np.ndarray]:
    """Ids of each whole text and then ``end_id``; null texts count as empty."""
    known, dtype = _memory(path), id_type(path)
    tail = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    if len(known) > CACHE_WORDS:
        known.clear()
    words = [PIECES.findall(t.lower()) if covered(t) else None for t in (x or "" for x in texts)]
    new = list(set().union(*[ws for ws in words if ws]).difference(known))
    if new:
        _learn(path, new, known)
    out = []
    for t, ws in zip(texts, words, strict=True):
        if ws is None:
            ids = np.array(_tokenizer(path).encode(t, add_special_tokens=False).ids, dtype).tobytes()
        else:
            ids = b"".join(map(known.__getitem__, ws))
        out.append(np.frombuffer(ids + tail, dtype))
    return out
