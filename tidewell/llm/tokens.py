"""Byte-level BPE ids of whole texts, those of the `tokenizers` file without special tokens added.

The rank file holds the same vocabulary as the `tokenizers` file beside it and
gives the same ids, which the tests hold against each other, in a third of the
time. That file's added tokens, <|endoftext|> among them, are matched in texts
as that library does, which splits texts at them first.
"""

from __future__ import annotations

import base64
import functools
import json
from pathlib import Path

import numpy as np


def default_path() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.tiktoken")


@functools.cache
def encoder(path: str):
    """One encoder a worker, from a rank file and the added tokens of the .json beside it."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added = json.loads(Path(path).with_suffix(".json").read_text("utf-8"))["added_tokens"]
    if odd := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"added tokens that aren't matched as they stand: {odd}")
    special = {t["content"]: t["id"] for t in added}
    ranks = {a: b for a, b in ranks.items() if b not in special.values()}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.cache
def whole_encoder(path: str):
    """The `tokenizers` file beside the rank file, for texts that the faster encoder can't take."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(Path(path).with_suffix(".json")))


def token_ids(path: str, text: str | None) -> np.ndarray:
    """Ids of one text as unsigned 32-bit little-endian; none for a null or empty text.

    Runs of some 700,000 blanks and more overflow the faster encoder's stack, which
    it says; such texts go through the `tokenizers` library.
    """
    try:
        ids = encoder(path).encode(text or "", allowed_special="all")
    except ValueError:
        ids = whole_encoder(path).encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4")
