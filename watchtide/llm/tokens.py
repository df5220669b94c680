"""Token ids of a byte-level BPE vocabulary, loaded once per Python worker."""

from __future__ import annotations

import base64
import os
from functools import cache


@cache
def _load(path: str):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return slow, None, ()
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return slow, fast, tuple(t.content for t in slow.get_added_tokens_decoder().values())


class Encoder:
    """Ids as the `tokenizers` file gives them, add_special_tokens=False.

    Where the same vocabulary lies beside it as ranks, texts without special strings are encoded
    from the ranks, which gives the same ids faster.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow, self.fast, self.special = _load(path)

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)
