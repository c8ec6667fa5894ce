"""Ids of the byte-level BPE, as the tokenizers library gives them, at the speed of the rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .common import tokenizer, tokenizer_file

END_ID = 2
#: Characters on which the two libraries' letter, digit and white-space classes agree: Latin with its accents and the usual punctuation.
#: Any other text goes to the tokenizers library as it is. tests/llm/test_tokens.py compares both on each of these characters.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ‐-‧‰-›€]*")
#: Characters in a row without white space from which the merges of the rank file could get slow.
_LONG_RUN = re.compile(r"\S{2000}")
_SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL: 50256})


def is_plain(text: str) -> bool:
    """Whether the rank file gives a text's ids."""
    return _PLAIN.fullmatch(text) is not None and not _LONG_RUN.search(text)


@lru_cache(maxsize=2)
def _sizes(path: str) -> np.ndarray:
    return np.array([len(_ranks(path).decode_single_token_bytes(i)) for i in range(_ranks(path).n_vocab - 1)], dtype=np.int64)


def plain_ids(text: str, ranks: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a plain text, in which strings of special tokens are text, and how many bytes each takes."""
    ids = np.array(_ranks(ranks).encode_ordinary(text), dtype=np.int32)
    return ids, _sizes(ranks)[ids]


def encode(texts: list[str], path: str, ranks: str | None) -> Iterator[np.ndarray]:
    """Each text's ids, as tokenizers gives them with add_special_tokens=False.

    ranks is the same vocabulary as a rank file (None: use the tokenizers library alone)."""
    fast = _ranks(ranks) if ranks else None
    for text in texts:
        if fast is not None and is_plain(text):
            ids = fast.encode(text, allowed_special="all") if _SPECIAL in text else fast.encode_ordinary(text)
        else:
            ids = tokenizer(path).encode(text, add_special_tokens=False).ids
        yield np.array(ids, dtype=np.uint32)


def default_files() -> tuple[str, str]:
    return tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")
