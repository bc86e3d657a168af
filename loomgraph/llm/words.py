"""Words of whole texts, a block at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(data: bytes, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 data, in order, in lists that cover about ``block`` bytes each (a
    single word may be longer): memory doesn't follow the length of a text."""
    at = 0
    while at < len(data):
        end = at + block
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end
