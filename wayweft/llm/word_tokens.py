"""Token ids of whole texts by a word-BPE vocabulary file of the tokenizers library.

The vocabulary drops white space and never lets a token span it, nor a change between letters, digits and signs, so a
text's ids are those of its chunks: white-space separated runs, parted where ASCII letters, single digits and signs
meet if the run holds nothing else and no apostrophe. A batch's chunks are looked up together, in numpy: up to 16 bytes
are a key of two numbers, exactly; longer chunks are keys of a dictionary. What is not yet known is encoded by the
library and remembered: parted chunks by its model alone, others with a special token of the vocabulary between them.
Texts whose chunks could depend on more than themselves (a special token's own text, control characters, combining
marks) are encoded whole.
"""

from __future__ import annotations

import re

import numpy as np

#: Chunks remembered before the memory starts afresh; longer chunks than LONG bytes are not remembered.
CHUNKS, LONG = 1_500_000, 200

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Letters 1, digits 2, other printable ASCII 0.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_WHOLE = np.zeros(256, dtype=bool)
_WHOLE[[ord("'"), *range(0x7F, 256)]] = True
_CONTROL = np.zeros(256, dtype=bool)
_CONTROL[[*range(0x09), *range(0x0E, 0x20), 0xCC, 0xCD]] = True  # and the first bytes of combining marks
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)
#: White space beyond ASCII, and what keeps a text in one piece.
_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
_SIGNS = "[!-&(-/:-@[-`{-~]+"
_PLAIN = re.compile(f"[a-z]+|[0-9]|{_SIGNS}")
#: Latin letters that compose with nothing and whose lower case is one letter, and signs after them.
_LATIN = re.compile(f"([a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0132-\u0148\u014a-\u017e]+)({_SIGNS})?")
_ODD = "[\x00-\x08\x0e-\x1f̀-ͯ]"


class ChunkTable:
    """Open addressing from a chunk of up to 16 bytes, as two numbers, to its number."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.low, self.high = np.zeros(1 << bits, _U), np.zeros(1 << bits, _U)
        self.number = np.full(1 << bits, -1, dtype=np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (low >> _U(31))) * _U(0x7FB5D329728EA185) + (high ^ (high >> _U(27))) * _U(0x81DADEF4BC2DD44D)
        x = (x ^ (x >> _U(33))) * _U(0xD6E8FEB86659FD93)
        return (x >> _U(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The numbers; -1 where the chunk is not known."""
        at = self._slot(low, high)
        out = self.number[at]
        open_ = np.flatnonzero((out >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.number[at]
            out[open_] = found
            on = (found >= 0) & ((self.low[at] != low[open_]) | (self.high[at] != high[open_]))
            open_, at = open_[on], at[on]
        return out

    def put(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """New chunks, each once."""
        waiting, at = np.arange(len(low)), self._slot(low, high)
        while len(waiting):
            free = waiting[self.number[at[waiting]] < 0]
            _, first = np.unique(at[free], return_index=True)  # one of those that want the same free slot
            won = free[first]
            self.low[at[won]], self.high[at[won]], self.number[at[won]] = low[won], high[won], number[won]
            waiting = np.setdiff1d(waiting, won, assume_unique=True)
            at[waiting] = (at[waiting] + 1) & ((1 << self.bits) - 1)


class WordTokens:
    def __init__(self, path: str, limit: int = CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_text = max(special.items())
        self.marks = [x.encode() for x in special.values()]
        self.odd = re.compile("|".join([_ODD, *map(re.escape, special.values())]))
        self.model = self.tokenizer.model
        self.byte_names = {}
        self.lookups = self.misses = 0
        self._forget()

    def _forget(self) -> None:
        self.table, self.long = ChunkTable(max(8, 2 * self.limit - 1).bit_length()), {}
        self.n, self.used = 0, 0
        self.begin, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, "<u4")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """Numbers for chunks that have none."""
        numbers, tokenize = np.empty(len(chunks), np.int64), self.model.tokenize
        flat, sizes, done, rest = [], [], [], []
        for i, c in enumerate(chunks):
            if _PLAIN.fullmatch(c):
                ids = [x.id for x in tokenize(c)]
            elif m := _LATIN.fullmatch(c):
                ids = [x.id for x in tokenize(self._byte_text(m[1].lower()))]
                if m[2]:
                    ids += [x.id for x in tokenize(m[2])]
            else:
                rest.append(i)
                continue
            done.append(i)
            flat += ids
            sizes.append(len(ids))
        numbers[done] = self._keep(np.array(flat, "<u4"), np.array(sizes, np.int64))
        for at in range(0, len(rest), 5000):
            some = rest[at : at + 5000]
            ids = self._ids(self.mark_text.join([chunks[i] for i in some]))
            cuts = np.flatnonzero(ids == self.mark)
            sizes = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
            numbers[some] = self._keep(np.delete(ids, cuts), sizes)
        return numbers

    def _byte_text(self, letters: str) -> str:
        """The letters' bytes by the names that the vocabulary gives to bytes."""
        from tokenizers.pre_tokenizers import ByteLevel

        for c in set(letters):
            if ord(c) not in self.byte_names:
                self.byte_names[ord(c)] = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0]
        return letters.translate(self.byte_names)

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of chunks with these ids, one after the other, and sizes."""
        numbers = np.arange(self.n, self.n + len(sizes))
        while self.n + len(sizes) > len(self.begin):
            self.begin, self.length = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.length[numbers] = sizes
        self.begin[numbers] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = self.n + len(sizes), self.used + len(ids)
        return numbers

    def _numbers(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each chunk of buffer, which has 16 bytes to spare at its end."""
        size = ends - starts
        words = np.ndarray(len(buffer) - 8, dtype="<u8", buffer=buffer, strides=(1,))
        low = words[starts] & _MASK[np.minimum(size, 8)]
        high = words[np.minimum(starts + 8, len(words) - 1)] & _MASK[np.clip(size - 8, 0, 8)]
        text = lambda i: buffer[starts[i] : ends[i]].tobytes().decode()
        out = self.table.find(low, high)
        large = np.flatnonzero(size > 16)
        out[large] = [self.long.get(text(i), -1) for i in large.tolist()]
        fresh = np.flatnonzero(out < 0)
        self.lookups, self.misses = self.lookups + len(out), self.misses + len(fresh)
        if not len(fresh):
            return out
        small = fresh[size[fresh] <= 16]
        order = np.lexsort((high[small], low[small]))
        small = small[order]
        new = np.ones(len(small), dtype=bool)
        new[1:] = (low[small][1:] != low[small][:-1]) | (high[small][1:] != high[small][:-1])
        large = fresh[size[fresh] > 16].tolist()
        names = dict.fromkeys(map(text, large))
        first = small[new]
        if self.n + len(first) + len(names) > self.limit and self.n:
            self._forget()
            return self._numbers(buffer, starts, ends)
        numbers = self._learn([text(i) for i in first.tolist()] + list(names))
        self.table.put(low[first], high[first], numbers[: len(first)])
        out[small] = numbers[: len(first)][np.cumsum(new) - 1]
        given = dict(zip(names, numbers[len(first) :].tolist()))
        out[large] = [given[text(i)] for i in large]
        self.long.update((k, v) for k, v in given.items() if len(k) <= LONG)
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8), one after the other, and where each text's begin and end."""
        whole, texts = {}, list(texts)
        joined = b"\n".join(texts)
        odd = bool(_CONTROL[np.frombuffer(joined, np.uint8)].any()) or any(m in joined for m in self.marks)
        for i, data in enumerate(texts):
            if not odd and data.isascii():
                continue
            text = data.decode()
            if odd and self.odd.search(text):
                whole[i], texts[i] = self._ids(text), b""
            elif _WIDE_SPACE.search(text):
                texts[i] = _WIDE_SPACE.sub(" ", text).encode()
        raw = np.frombuffer(b"\n".join([b"", *texts, bytes(16)]), np.uint8)
        buffer = _LOWER[raw]
        buffer[-16:] = 0
        solid = ~_SPACE[raw]
        solid[-16:] = False
        starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
        ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
        kind = _KIND[raw]
        parted = np.flatnonzero(solid[1:] & solid[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))) + 1
        if len(parted):
            bad = np.concatenate([[0], np.cumsum(_WHOLE[raw], dtype=np.int32)])
            parted = parted[(bad[starts] == bad[ends])[np.searchsorted(starts, parted, "right") - 1]]
            starts, ends = np.sort(np.concatenate([starts, parted])), np.sort(np.concatenate([ends, parted]))
        numbers = self._numbers(buffer, starts, ends)
        counts, begin = self.length[numbers], self.begin[numbers]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.repeat(begin - upto[:-1], counts) + np.arange(upto[-1])]
        edges = np.cumsum([1] + [len(t) + 1 for t in texts])
        bounds = upto[np.searchsorted(starts, edges)]
        if whole:
            parts = [whole.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()))]
            ids, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, bounds

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, bounds = self.encode([t.encode() for t in texts])
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
