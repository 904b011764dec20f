"""Public byte-level BPE vocabularies in tasks. Paths are parameters; each Python worker loads a vocabulary once."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """A tokenizers.Tokenizer with neither truncation nor padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@functools.lru_cache(maxsize=4)
def ranked(path: str):
    """The same kind of vocabulary as ranks, by tiktoken: the ids of the JSON file's, several times as fast."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_bpe_ids(text: str | None, json_path: str, ranks_path: str | None) -> np.ndarray:
    """Ids as the JSON file's tokenizer gives them. Texts with a special token's string go through that library itself."""
    text = text or ""
    if ranks_path is None or "<|" in text:
        return np.array(tokenizer(json_path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return np.array(ranked(ranks_path).encode_ordinary(text), dtype=np.uint32)
