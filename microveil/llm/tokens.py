"""Byte-level BPE token ids with a public vocabulary.

The rank file and the ``tokenizers`` file hold one vocabulary; the ranked coder
gives the same ids about four times as fast (tests compare the two), and a text
that it cannot take (it refuses some runs of a million like characters) goes to
``tokenizers``.
"""

from __future__ import annotations

import base64
import os

import numpy as np

SPECIAL = {"<|endoftext|>": 50256}
_coders: dict[tuple[str, str], object] = {}


class Coder:
    def __init__(self, ranks_path: str, json_path: str):
        import tiktoken

        import public_tokenizers

        ranks = {}
        with open(ranks_path, "rb") as f:
            for line in f:
                piece, rank = line.split()
                ranks[base64.b64decode(piece)] = int(rank)
        self.fast = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.json_path = json_path
        self.slow = None

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # noqa: BLE001  the coder's panics aren't Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
        if self.slow is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def coder(ranks_path: str | None = None, json_path: str | None = None) -> Coder:
    """The worker's coder for these files; by default the public 50k byte-level vocabulary."""
    import public_tokenizers as P

    key = (ranks_path or P.path("byte_bpe_50k.tiktoken"), json_path or P.path("byte_bpe_50k.json"))
    if key not in _coders:
        _coders[key] = Coder(*key)
    return _coders[key]
