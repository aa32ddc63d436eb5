"""Public tokenizers, loaded once in each Python worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

# Fixed value: the split pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def tokenizer(path: str = DEFAULT):
    """A tokenizer from a file of ranks (.tiktoken), a JSON file of the tokenizers library, or a sentencepiece model, by its ending."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: len(t.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(processor.encode(text))


def lengths(texts, path: str = DEFAULT) -> np.ndarray:
    """Tokens of each text; NULL has none."""
    count = tokenizer(path)
    return np.fromiter((count(t) if t else 0 for t in texts), np.int64, len(texts))
