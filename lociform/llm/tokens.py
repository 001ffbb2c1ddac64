"""Token counts under a public tokenizer, without keeping the tokens."""

from __future__ import annotations

import base64
import re
from itertools import accumulate

#: The split of the byte-level vocabularies into words, fixed by their publishers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Words kept with their counts by each Python worker; longer words aren't kept.
MEMO_WORDS, MEMO_CHARS = 500_000, 64


class TokenCounter:
    """Counts tokens word by word; a byte-level vocabulary never merges across its words."""

    def __init__(self, vocabulary: str) -> None:
        import regex
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._any = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}"))
        self._ascii = re.compile(_ASCII, re.ASCII)
        self._memo = _Memo(self._encode)

    def words(self, text: str) -> list[str]:
        return (self._ascii if text.isascii() else self._any).findall(text)

    def count(self, text: str) -> int:
        return sum(map(self._memo.__getitem__, self.words(text)))

    def ends(self, text: str) -> list[int]:
        """Running token count after each word."""
        return list(accumulate(map(self._memo.__getitem__, self.words(text))))


class _Memo(dict):
    def __init__(self, encode) -> None:
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> int:
        n = len(self._encode(word.encode("utf-8", "replace")))
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = n
        return n
