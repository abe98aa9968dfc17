"""Ids of a byte-level BPE vocabulary, fast for texts whose words come back.

Texts of ASCII and Latin-1 letters are cut into pre-tokens by array operations and each distinct
pre-token is encoded once per worker. Every other text, and one that spells a special token, goes
to the tokenizer whole, which is also what the tests hold the fast way against.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

from tallyline.llm.hashing import byte_sums, run_hashes, spans

_LETTER, _NUMBER, _SPACE, _OTHER, _END = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xFF)]] = _LETTER
_CLASS[0x30:0x3A] = _NUMBER
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0xFF] = _END
# Bytes of other characters than ASCII and U+00C0 to U+00FF; 0x1C to 0x1F are spaces to some rules.
_FOREIGN = bytes([*range(0x1C, 0x20), *range(0xC0, 0xC3), *range(0xC4, 0x100)])
_SLOTS_LOG = 20
_PROBES = 4
_CACHED = 500_000
_CACHED_BYTES = 64


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str, ranks_path: str) -> Encoder:
    return Encoder(tokenizer_path, ranks_path)


class Encoder:
    """``tokenizer_path``: the tokenizer; ``ranks_path``: the same vocabulary as ranks of bytes."""

    def __init__(self, tokenizer_path: str, ranks_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.specials = [
            token.content.encode() for token in self.whole.get_added_tokens_decoder().values()
        ]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << _SLOTS_LOG, np.uint64)
        self.at = np.zeros(1 << _SLOTS_LOG, np.int64)
        self.size = np.zeros(1 << _SLOTS_LOG, np.int64)
        self.arena = np.zeros(1 << 20, np.uint16)
        self.used = self.known = 0

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids begin."""
        plain = np.array([self.is_plain(text) for text in texts], bool)
        ids, bounds = self._fast([text if ok else b"" for text, ok in zip(texts, plain)])
        if plain.all():
            return ids, bounds
        parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i in np.flatnonzero(~plain):
            text = texts[i].decode("utf-8", "replace")
            parts[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def is_plain(self, text: bytes) -> bool:
        """No characters outside the fast rule, no multiplication or division sign (the two
        among the Latin-1 letters that are none), no special token."""
        return (
            len(text.translate(None, _FOREIGN)) == len(text)
            and b"\xc3\x97" not in text
            and b"\xc3\xb7" not in text
            and not any(special in text for special in self.specials)
        )

    def _fast(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"\xff".join(texts) + b"\xff"
        data = np.frombuffer(joined, np.uint8)
        starts = pretokens(data)
        ends = np.append(starts[1:], len(data))
        real = data[starts] != 0xFF
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        starts, ends = starts[real], ends[real]
        bounds = np.searchsorted(starts, offsets)
        at, size = self._find(joined, starts, ends, run_hashes(byte_sums(data), starts, ends))
        ids = self.arena[spans(at, size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[bounds]

    def _find(self, data: bytes, starts, ends, hashes) -> tuple[np.ndarray, np.ndarray]:
        """Place in the arena and number of ids of every pre-token."""
        if self.known > _CACHED or self.used > 1 << 23:
            self.clear()
        at, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        missing = self._look(hashes, np.arange(len(starts)), at, size)
        if len(missing):
            _, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            new_at, new_size = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            for k, i in enumerate(missing[first].tolist()):
                a, b = int(starts[i]), int(ends[i])
                ids = self.pieces._encode_single_piece(data[a:b])
                new_at[k], new_size[k] = self._keep(int(hashes[i]), ids, b - a <= _CACHED_BYTES)
            at[missing], size[missing] = new_at[back], new_size[back]
        return at, size

    def _look(self, hashes, wanted, at, size) -> np.ndarray:
        slot = (hashes >> np.uint64(64 - _SLOTS_LOG)).astype(np.int64)
        for _ in range(_PROBES):
            hit = self.keys[slot] == hashes[wanted]
            found = wanted[hit]
            at[found], size[found] = self.at[slot[hit]], self.size[slot[hit]]
            wanted, slot = wanted[~hit], (slot[~hit] + 1) & ((1 << _SLOTS_LOG) - 1)
        return wanted

    def _keep(self, key: int, ids: list[int], cache: bool) -> tuple[int, int]:
        place, size = self.used, len(ids)
        while place + size > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        self.arena[place : place + size] = ids
        self.used += size
        slot = key >> (64 - _SLOTS_LOG)
        for _ in range(_PROBES if cache else 0):
            if not self.keys[slot]:
                self.keys[slot], self.at[slot], self.size[slot] = key, place, size
                self.known += 1
                break
            slot = (slot + 1) & ((1 << _SLOTS_LOG) - 1)
        return place, size


def pretokens(data: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts that each end in byte 0xFF (a pre-token of its own).

    Runs of letters, of digits and of other signs take one space before them along; of other
    white space before them the last character stands alone; ``'s 't 're 've 'm 'll 'd`` are cut
    off where the apostrophe does not belong to a longer run.
    """
    kind = _CLASS[data]
    run = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
    kinds, ends = kind[run], np.append(run[1:], len(data))
    follows = np.append(kinds[1:], _END)
    mark = np.zeros(len(data) + 1, bool)
    before = np.concatenate([[0], data[run[1:] - 1]])
    solid = (kinds != _SPACE) & (kinds != _END)
    mark[run[solid] - (before[solid] == 0x20)] = True
    mark[run[kinds == _END]] = True
    ends_at = np.flatnonzero(data == 0xFF)
    mark[ends_at] = True
    space = kinds == _SPACE
    long_or_last = space & ((follows == _END) | (ends - run >= 2))
    mark[run[long_or_last]] = True
    other_last = space & (follows != _END) & (data[ends - 1] != 0x20)
    mark[ends[other_last] - 1] = True
    mark[ends_at[:-1] + 1] = True
    quote = run[(kinds == _OTHER) & (ends - run == 1) & (data[run] == 0x27) & (before != 0x20)]
    if len(quote):
        one, two = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        mark[quote[short | long] + 1] = False
        mark[quote[short] + 2] = True
        mark[quote[long] + 3] = True
    return np.flatnonzero(mark[:-1])
