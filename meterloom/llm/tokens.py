"""Token ids of whole texts from a byte-level vocabulary file, with the bytes of each token."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k"

# Where every character is one of these, both libraries split a text alike and the faster
# one encodes it; any other text goes through the tokenizers library.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xc0-\xff]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


class Encoder:
    """Ids as the tokenizers library gives them with ``add_special_tokens=False``.

    ``path`` is the vocabulary's json file; beside it lies the same vocabulary as ranks.
    No special token is added, but one that a text spells out gets its own id.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self._whole.get_added_tokens_decoder().items()}
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.sizes = np.zeros(max([*ranks.values(), *added.values()]) + 1, np.int64)
        for token, rank in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.sizes[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        if not _OTHER.search(text) and not (self._added and self._added.search(text)):
            try:
                return np.asarray(self._fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except Exception:  # noqa: BLE001  the fast splitter gives up on some very long runs
                pass
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """End of every token in bytes of the text; each starts where the one before ends."""
        return np.cumsum(self.sizes[ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)
