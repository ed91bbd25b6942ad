"""A bounded memory of what a text chunk encodes to."""

from __future__ import annotations

from collections.abc import Callable

#: Chunks remembered before the memory starts afresh; longer chunks than LONG are not remembered.
CHUNKS, LONG = 800_000, 200


class ChunkCache(dict):
    """chunk -> encoded bytes. A worker process keeps it from task to task."""

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]], limit: int = CHUNKS):
        super().__init__()
        self.encode_all, self.limit = encode_all, limit

    def encode(self, split: list[list[str]]) -> list[bytes]:
        """The joined encodings of each text's chunks; those not yet known are encoded together."""
        distinct = set().union(*split)
        fresh = [c for c in distinct if c not in self]
        if len(self) + len(fresh) > self.limit:
            self.clear()
            fresh = list(distinct)
        known = dict(zip(fresh, self.encode_all(fresh)))
        long = {c: v for c, v in known.items() if len(c) > LONG}
        self.update((c, v) for c, v in known.items() if len(c) <= LONG)
        if not long:
            return [b"".join(map(self.__getitem__, chunks)) for chunks in split]
        return [b"".join([long[c] if c in long else self[c] for c in chunks]) for chunks in split]
