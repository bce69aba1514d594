"""Token ids of whole texts inside tasks; one encoder per worker process and vocabulary."""

from __future__ import annotations

import base64
import functools
import json
import os

import numpy as np


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@functools.cache
def rank_encoder(path: str, pattern: str):
    """A tiktoken encoder from a rank file; no special tokens."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@functools.cache
def _json_encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _added(path: str) -> tuple[str, ...]:
    """Strings of the added tokens, read without the tokenizer, which would stay in every worker's memory."""
    with open(path, encoding="utf-8") as file:
        return tuple(t["content"] for t in json.load(file)["added_tokens"])


def encode(text: str, json_path: str, rank_path: str, pattern: str) -> np.ndarray:
    """Ids of the tokenizer in ``json_path``, without special tokens added.

    ``rank_path`` holds the same vocabulary as ranks, which give the same ids several times faster;
    a text in which an added token's own string occurs goes through the tokenizer itself.
    """
    if any(s in text for s in _added(json_path)):
        return np.array(_json_encoder(json_path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(rank_encoder(rank_path, pattern).encode_ordinary(text), np.uint32)
