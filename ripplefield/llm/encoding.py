"""Token ids of whole texts by a public byte-level vocabulary.

Ids are those of the ``tokenizers`` library for the JSON file named.  The ``tiktoken`` library gives the
same ids several times faster from the same vocabulary as ranks, so it encodes ordinary texts; texts that
hold a special token's string, or a very long run without a break, go to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

from ripplefield.llm.common import LONG

#: Special strings that the JSON vocabulary knows.
SPECIAL = "<|endoftext|>"
#: Runs from this length on are left to the slower library, whose time doesn't grow with a run's square.
LONG_RUN = re.compile(r"[^\s]{4000}|[^\S ]{4000}| {4000}")

#: A blank between two letters: words on both sides are encoded apart.
BETWEEN = re.compile(r"(?<=[a-z]) (?=[a-z])")


def default_paths() -> tuple[str, str]:
    """The JSON vocabulary and its ranks among the installed public tokenizers."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Encodes texts; one per Python worker (see ``encoder``)."""

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.exact = Tokenizer.from_file(vocabulary)
        self.fast = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=table, special_tokens={})
        size = max([*table.values(), *(i for i in self.exact.get_vocab().values())]) + 1
        self.widths = np.ones(size, np.int64)  # bytes of each token
        for piece, i in table.items():
            self.widths[i] = len(piece)
        if (i := self.exact.token_to_id(SPECIAL)) is not None:
            self.widths[i] = len(SPECIAL)

    def array(self, text: str | None, size: int | None = None) -> np.ndarray:
        """Token ids as an array.  Long texts are encoded in slices that begin with a blank between two letters,
        where every encoding of the whole has a boundary too."""
        size, start, out = size or LONG, 0, []
        while text and start < len(text):
            gap = BETWEEN.search(text, start + size)
            end = gap.start() if gap else len(text)
            out.append(np.array(self.ids(text[start:end]), "<u4"))
            start = end
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, "<u4")

    def ids(self, text: str | None) -> list[int]:
        """Token ids of a text, without added special tokens; null: none."""
        if not text:
            return []
        if SPECIAL in text or (len(text) >= 4000 and LONG_RUN.search(text)):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str, ranks: str) -> Encoder:
    """The encoder of this process."""
    return Encoder(vocabulary, ranks)
