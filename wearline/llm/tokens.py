"""Token ids of whole texts by a public tokenizer file, encoded chunk by chunk with a cache.

A byte-level BPE never merges across its pre-token boundaries, and a boundary always lies
between a character that is not white space and one that is, and between a letter or digit and a
closing mark. So a text is cut there, each distinct chunk is encoded once per Python worker by the
tokenizers library, and the ids of the chunks are put together. The result equals encoding the
whole text; texts that hold an added token or a white-space character beyond ASCII, or one of the
few control characters that count as white space for some, are encoded whole.

Cutting, looking up and putting together work on whole arrays of bytes: a chunk is known by its
length and 128 bits of polynomial hashes, read off running sums over the bytes of many texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

import numpy as np

#: Characters that only one of the two definitions of white space holds, and white space beyond ASCII.
UNSURE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
UNSURE += "\u200b\u200c\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
#: A letter or digit of ASCII before these ends a pre-token.
CLOSING = b",.;:!?"
#: Distinct chunks that a worker keeps; further ones are encoded each time.
CACHE_CHUNKS = 1_500_000
#: Chunks of more bytes are not kept.
CACHE_BYTES = 64
#: Characters cut into chunks at a time; bounds the memory of a worker at any text length.
AT_ONCE = 1 << 20
SAFE_CUT = re.compile(r"\S(?=\s)")

_ENCODERS: dict[str, "Encoder"] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CLOSES, ALNUM = np.zeros(256, bool), np.zeros(256, bool)
CLOSES[list(CLOSING)] = True
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class Hashes:
    """Two polynomial hashes modulo 2^64 of any part of an array of bytes, from running sums."""

    def __init__(self, size: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.size = size
        self.byte = rng.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
        base = [int(x) | 5 for x in rng.integers(1 << 40, 1 << 62, 2)]
        self.power = np.stack([self._powers(b, size) for b in base])
        self.inverse = np.stack([self._powers(pow(b | 1, -1, 1 << 64), size) for b in base])

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.ones(size, np.uint64)
        out[1:] = base & ((1 << 64) - 1)
        return np.multiply.accumulate(out)

    def parts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for byte, power, inverse in zip(self.byte, self.power, self.inverse, strict=True):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(byte[data] * power[: len(data)], out=sums[1:])
            out.append((sums[ends] - sums[starts]) * inverse[starts])
        return out[0], out[1]


class Known:
    """Chunks by hash: sorted keys, second hash, and where their ids lie in a pool."""

    def __init__(self, dtype: np.dtype):
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, dtype), 0

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[place] == keys) & (self.checks[place] == checks), place, -1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is taken, also by a chunk with another second hash."""
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: list[bytes]) -> None:
        """Adds chunks with new keys."""
        flat = np.frombuffer(b"".join(ids), self.pool.dtype)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(flat), self.pool.dtype)])
        self.pool[self.used : self.used + len(flat)] = flat
        sizes = np.array([len(x) // self.pool.dtype.itemsize for x in ids], np.int64)
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        for name, new in (("keys", keys), ("checks", checks), ("at", at), ("sizes", sizes)):
            setattr(self, name, np.insert(getattr(self, name), place, new[order]))


class Encoder:
    """Encodes texts with one tokenizer file. `dtype` is the narrowest type for its ids."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [*UNSURE, *[t.content for t in self.tokenizer.get_added_tokens_decoder().values()]]
        self.known, self.recent = Known(self.dtype), Known(self.dtype)
        self.hashes = Hashes(1 << 16)
        self.sizes = self._byte_sizes()

    def _byte_sizes(self) -> np.ndarray | None:
        """Bytes of text that each id stands for; None if ids do not stand for bytes of the text as it is."""
        plan = json.loads(self.tokenizer.to_str())
        cut = plan["pre_tokenizer"] or {}
        if plan["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space"):
            return None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, number in vocabulary.items():
            sizes[number] = len(token)  # one character for each byte
        return sizes

    def whole(self, text: str) -> bool:
        """Whether a text must be encoded in one piece."""
        return any(x in text for x in self.special)

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=self.dtype).tobytes()

    def _together(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that all begin with white space, encoded as one text. Where ids stand for bytes
        the cuts follow from their sizes, which spares the library the offsets."""
        if self.sizes is not None:
            (found,) = self.tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)
            ids = np.array(found.ids, dtype=self.dtype)
            ends = np.cumsum([len(c.encode()) for c in chunks])
            cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="left") + 1
            raw, width, out, last = ids.tobytes(), self.dtype.itemsize, {}, 0
            for chunk, cut in zip(chunks, (cuts * width).tolist(), strict=True):
                out[chunk] = raw[last:cut]
                last = cut
            return out
        found = self.tokenizer.encode("".join(chunks), add_special_tokens=False)
        ids = np.array(found.ids, dtype=self.dtype)
        starts = np.fromiter((s for s, _ in found.offsets), dtype=np.int64, count=len(ids))
        ends = np.cumsum([len(c) for c in chunks])
        cuts = np.searchsorted(starts, ends, side="left").tolist()
        out, last = {}, 0
        for chunk, cut in zip(chunks, cuts, strict=True):
            out[chunk] = ids[last:cut].tobytes()
            last = cut
        return out

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes; null counts as empty."""
        out: list[bytes] = []
        group: list[str | None] = []
        size = 0
        for text in texts:
            n = len(text or "")
            if n > AT_ONCE and not self.whole(text):
                out += self._encode_group(group)
                out.append(b"".join(self._encode_group([part])[0] for part in self._parts(text)))
                group, size = [], 0
                continue
            group.append(text)
            size += n
            if size > AT_ONCE:
                out += self._encode_group(group)
                group, size = [], 0
        return out + self._encode_group(group)

    @staticmethod
    def _parts(text: str):
        """A long text in parts, cut in front of white space that follows another character."""
        at = 0
        while at < len(text):
            found = SAFE_CUT.search(text, at + AT_ONCE)
            end = found.end() if found else len(text)
            yield text[at:end]
            at = end

    def _encode_group(self, texts: Sequence[str | None]) -> list[bytes]:
        whole = [t is not None and self.whole(t) for t in texts]
        raw = [b"" if t is None or w else t.encode() for t, w in zip(texts, whole, strict=True)]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        out, cuts = self._encode_bytes(data, ends) if len(data) else (b"", np.zeros(len(raw), np.int64))
        width, last, found = self.dtype.itemsize, 0, []
        for text, w, cut in zip(texts, whole, (cuts * width).tolist(), strict=True):
            found.append(self._encode(text) if w else out[last:cut])
            last = cut
        return found

    def _encode_bytes(self, data: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids of texts that lie one behind the other and end at `ends`, and where each text's ids end."""
        space = SPACE[data]
        first = np.zeros(len(data), bool)
        first[1:] = (space[1:] & ~space[:-1]) | (CLOSES[data[1:]] & ALNUM[data[:-1]])
        first[np.concatenate([[0], ends[ends < len(data)]])] = True
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], len(data))
        if len(data) >= self.hashes.size:
            self.hashes = Hashes(2 * len(data))
        keys, checks = self.hashes.parts(data, starts, stops)
        keys ^= (stops - starts).astype(np.uint64) << np.uint64(32)
        one, index, back = np.unique(keys, return_index=True, return_inverse=True)
        check = checks[index]
        if (check[back] != checks).any():  # two chunks of this group share 64 bits
            mixed = np.unique(checks, return_inverse=True)[1]
            one, index, back = np.unique(np.stack([keys, mixed.astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
            one, check, back = keys[index], checks[index], back.ravel()
        place, late = self.known.find(one, check), self.recent.find(one, check)
        new = np.flatnonzero((place < 0) & (late < 0))
        made: list[bytes] = []
        if len(new):
            spans = zip(starts[index[new]].tolist(), stops[index[new]].tolist(), strict=True)
            chunks = [data[a:b].tobytes().decode() for a, b in spans]
            # A chunk of white space alone ends a text; in the middle of one it would lend
            # its last character to the next word. First chunks may start without any.
            spaced = [c for c in chunks if c[0].isspace() and not c[-1].isspace()]
            extra = self._together(spaced) if spaced else {}
            made = [extra[c] if c in extra else self._encode(c) for c in chunks]
        # Ids of the distinct chunks, from the two stores and from those just made.
        own = np.frombuffer(b"".join(made), self.dtype)
        pool = np.concatenate([self.known.pool[: self.known.used], self.recent.pool[: self.recent.used], own]) if len(own) else None
        sizes, at = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        for store, where, ahead in ((self.known, place, 0), (self.recent, late, self.known.used)):
            hit = np.flatnonzero(where >= 0)
            sizes[hit], at[hit] = store.sizes[where[hit]], ahead + store.at[where[hit]]
        sizes[new] = [len(m) // self.dtype.itemsize for m in made]
        at[new] = self.known.used + self.recent.used + np.cumsum(sizes[new]) - sizes[new]
        if pool is None:
            pool = np.concatenate([self.known.pool[: self.known.used], self.recent.pool[: self.recent.used]])
        each = sizes[back]
        upto = np.cumsum(each)
        out = pool[np.repeat(at[back] - upto + each, each) + np.arange(upto[-1])]
        self._keep(one[new], check[new], made, (stops - starts)[index[new]])
        return out.tobytes(), np.concatenate([[0], upto])[np.searchsorted(starts, ends)]

    def _keep(self, keys: np.ndarray, checks: np.ndarray, ids: list[bytes], lengths: np.ndarray) -> None:
        """Keeps new chunks in the small store, and moves that to the large one when it has grown."""
        room = CACHE_CHUNKS - len(self.known) - len(self.recent)
        short = np.flatnonzero(lengths <= CACHE_BYTES)[: max(0, room)]
        short = short[~self.known.holds(keys[short]) & ~self.recent.holds(keys[short])]
        if len(short):
            _, apart = np.unique(keys[short], return_index=True)
            short = short[apart]
            self.recent.add(keys[short], checks[short], [ids[i] for i in short.tolist()])
        if len(self.recent) > 50_000 + len(self.known) // 8:
            r, width = self.recent, self.dtype.itemsize
            flat = r.pool[: r.used].tobytes()
            parts = [flat[a * width : (a + n) * width] for a, n in zip(r.at.tolist(), r.sizes.tolist(), strict=True)]
            self.known.add(r.keys, r.checks, parts)
            self.recent = Known(self.dtype)


def encoder(file: str) -> Encoder:
    """The worker's encoder of a file; loaded once."""
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def default_tokenizer() -> str:
    """The tokenizer file of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
