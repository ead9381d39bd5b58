"""The byte-level BPE of the public vocabulary: fast from its rank file, safe from its tokenizer file.

Both files hold one vocabulary and give the same ids.  The rank file's encoder is some
five times faster, but its splitting pattern walks back over white space and overflows
its stack on a run of about a million characters; texts with a run of ``RUN`` or more
take the tokenizer file, which has no such limit (tested at 2,000,000 characters).
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

SPECIAL = "<|endoftext|>"
#: White-space runs from this length on take the tokenizer file.  Only the way, not the ids, depends on it.
RUN = 10_000
_RUN = re.compile(rf"\s{{{RUN}}}")


@lru_cache(maxsize=2)
def _ranks(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def tokenizer(path: str, plain_specials: bool = False):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = plain_specials
    return out


def byte_bpe_ids(text: str, tokenizer_path: str, ranks_path: str, pattern: str, plain_specials: bool = False) -> list[int]:
    """Ids of a text without added tokens; the special token's string is one id, or plain text."""
    spelled = SPECIAL in text and not plain_specials
    if spelled or (len(text) >= RUN and _RUN.search(text)):
        return tokenizer(tokenizer_path, plain_specials).encode(text, add_special_tokens=False).ids
    return _ranks(ranks_path, pattern).encode_ordinary(text)


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a byte as one printable character: itself where it is
    printable Latin-1, else the next of the characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
