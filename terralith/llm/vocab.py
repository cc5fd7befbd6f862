"""Public vocabulary files, loaded once in each Python worker."""

from __future__ import annotations

import base64
import functools


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str):
    """The byte-level BPE of a ranks file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str):
    """The tokenizers library's tokenizer of a JSON file, without truncation and padding."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(maxsize=1)
def word_parts(path: str):
    """From one reading of a JSON file: the same vocabulary and merges for single words that are normalised already (no
    splitting, no special tokens), the piece of each id, and the ids of the special tokens' strings."""
    import json
    import os

    import numpy as np

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    specials = {a["content"]: a["id"] for a in parts["added_tokens"]}
    known = parts["model"]["vocab"] | specials
    pieces = np.full(max(known.values()) + 1, "", object)
    for piece, i in known.items():
        pieces[i] = piece
    parts.update(normalizer=None, pre_tokenizer=None, added_tokens=[], truncation=None, padding=None)
    text = json.dumps(parts)
    del parts, known
    model = Tokenizer.from_str(text)
    model.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
    return model, pieces, specials
