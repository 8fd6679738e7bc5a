"""Token ids of a byte-level BPE vocabulary file, whose path is a parameter.

Texts of Latin letters go through a faster library, loaded with the same vocabulary as ranks and giving the same
ids (a test compares them); all others, and texts holding the string of a special token, through `tokenizers`."""

from __future__ import annotations

import json
import re

import numpy as np

from sedgewire.llm.common import ASCII_SPACE

_ready: dict[str, tuple] = {}
_OTHER = re.compile("[^\x00-ɏ]")
#: The split pattern of this family of vocabularies, in its possessive form.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The same where no two white spaces meet; without look-ahead it is a plain automaton.
SINGLE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            out[chr(free)], free = b, free + 1
    return out


def _load(path: str) -> tuple:
    if path not in _ready:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        special = [x["content"] for x in made.get("added_tokens", [])]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): k for token, k in made["model"]["vocab"].items() if token not in special}
        fast = [tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (PATTERN, SINGLE)]
        _ready[path] = *fast, Tokenizer.from_file(path), special
    return _ready[path]


def token_list(text: str, path: str) -> list[int]:
    """The ids of a whole text."""
    fast, fastest, exact, special = _load(path)
    if not text.isascii() and _OTHER.search(text) or any(x in text for x in special):
        return exact.encode(text, add_special_tokens=False).ids
    space = ASCII_SPACE[np.frombuffer(text.encode(), np.uint8)]
    return (fast if (space[1:] & space[:-1]).any() or "\x85" in text or "\xa0" in text else fastest)(text)


def token_ids(text: str, path: str) -> np.ndarray:
    """The same, unsigned 32 bits."""
    return np.array(token_list(text, path), np.uint32)
