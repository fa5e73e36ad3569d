"""Public byte-level BPE ids inside tasks."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: the one added token of byte_bpe_50k.json.
ADDED = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def coder(path: str, added: bool = False) -> tuple[Callable[[str], list[int]], Callable[[list[int]], bytes]]:
    """Functions from text to ids and from ids to bytes; nothing is put around a text.

    added: the strings of the vocabulary's added tokens become their ids, as tokenizers does unless
    told otherwise; else they are ordinary text. The vocabulary of byte_bpe_50k.json also lies there
    as ranks; on those, tiktoken gives the same ids several times faster (tests hold the two against
    each other). Any other file is read by tokenizers. Few are kept for each Python worker.
    """
    if path.endswith("byte_bpe_50k.json"):
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = {k: v for k, v in ranks.items() if v not in ADDED.values()}
        t = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED if added else {})
        return (lambda text: t.encode(text, allowed_special="all")) if added else t.encode_ordinary, t.decode_bytes
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not added
    return lambda text: t.encode(text, add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False).encode()
