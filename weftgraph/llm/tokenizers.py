"""Public tokenizers by name; their files stay where they are (``WEFT_TOKENIZERS`` or a parameter)."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

#: Fixed value: the pre-tokenization pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def folder(path: str | None = None) -> str:
    return path or os.environ.get("WEFT_TOKENIZERS", "/opt/tokenizers")


@lru_cache(maxsize=4)
def byte_bpe(name: str, path: str):
    """The byte-level BPE ``name`` as a tiktoken encoding without special tokens."""
    import tiktoken

    with open(f"{path}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def whole_text_encoder(name: str, path: str) -> Callable[[list[str]], list[list[int]]]:
    """A function that encodes whole texts by any tokenizer of the folder, without special tokens."""
    if os.path.exists(f"{path}/{name}.tiktoken"):
        enc = byte_bpe(name, path)
        return lambda texts: [enc.encode_ordinary(t) for t in texts]
    if os.path.exists(f"{path}/{name}.json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(f"{path}/{name}.json")
        tok.encode_special_tokens = True
        return lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{path}/{name}.model")
    return lambda texts: sp.encode(texts, num_threads=1)
