"""Split texts at the blanks where byte-level pre-tokens always part, and remember each part's ids."""

from __future__ import annotations

from collections.abc import Callable

END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256


class _Ragged(Exception):
    """The text has a blank beside other white space, so its parts depend on each other."""


class _Parts(dict):
    """Part of a text -> its ids as little-endian 32-bit bytes; emptied when it is full."""

    def __init__(self, encode: Callable[[str], bytes], lead: str, most: int):
        super().__init__()
        self.encode, self.lead, self.most = encode, lead, most

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Ragged
        if len(self) >= self.most:
            self.clear()
        ids = self.encode(self.lead + part)
        if len(part) <= 64:
            self[part] = ids
        return ids


class ChunkEncoder:
    """Ids of whole texts from a function that encodes text without special tokens.

    A single blank between two other characters that are no white space begins a new
    pre-token whatever stands around it, so the parts between such blanks are encoded on
    their own and repeated ones are looked up. A text with any other blank goes to the
    function whole. `most` bounds the remembered parts.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = 600_000):
        self.encode = encode
        self.first = _Parts(encode, "", most // 8)
        self.later = _Parts(encode, " ", most)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        head, *rest = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.later.__getitem__, rest))
        except _Ragged:
            return self.encode(text)

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; none for a null or empty text."""
        if not text:
            return b""
        if END_OF_TEXT not in text:
            return self._plain(text)
        special = END_OF_TEXT_ID.to_bytes(4, "little")
        return special.join(self._plain(segment) for segment in text.split(END_OF_TEXT))
