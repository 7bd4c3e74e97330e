"""Token ids of whole texts by a public byte-level vocabulary.

The vocabulary's own splitting rule never joins a word with white space behind it, so a text is the sequence of
its units (white space with the word behind it) and ids of equal units are looked up, not computed again. Texts
with white space outside ASCII are encoded whole. The ids equal those of encoding each text at once.
"""

from __future__ import annotations

import base64

import numpy as np

from rackpulse.llm import textbytes

VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
#: Units a worker remembers; beyond it, it starts anew.
REMEMBERED = 300_000
#: First bytes of white space outside ASCII (UTF-8): U+0085, U+00A0, U+1680, U+2000-205F, U+3000.
_WIDE_SPACE = ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A,)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)))


def encoding(path: str | None = None):
    """The vocabulary at a path, by default the public one installed on every machine."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


class Encoder:
    """Encodes runs of texts; one for each worker."""

    def __init__(self, path: str | None = None, closing: int = 0):
        self._encode, self._closing = encoding(path).encode, closing
        self._forget()

    def _forget(self) -> None:
        self._keys = np.zeros(0, np.uint64)  # sorted hashes of units
        self._entry = np.zeros(0, np.int64)  # and the entry of each
        self._ids = np.array([self._closing], np.uint32)  # entry 0 is the end of a text
        self._place = np.array([0, 1], np.int64)

    def _add(self, raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """New entries for byte ranges."""
        ids = [self._encode(raw[a:b].decode("utf-8", "replace"), allowed_special="all") for a, b in zip(begin.tolist(), end.tolist())]
        first, sizes = len(self._place) - 1, np.array([len(x) for x in ids], np.int64)
        self._ids = np.concatenate([self._ids, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))])
        self._place = np.concatenate([self._place, self._place[-1] + np.cumsum(sizes)])
        return np.arange(first, first + len(ids))

    def _entries(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        keys, first, inverse = np.unique(textbytes.hashes(data, begin, end), return_index=True, return_inverse=True)
        if len(self._keys) + len(keys) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self._keys, keys)
        known = at < len(self._keys)
        known[known] = self._keys[at[known]] == keys[known]
        entry = np.zeros(len(keys), np.int64)
        entry[known] = self._entry[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            entry[new] = self._add(data.tobytes(), begin[first[new]], end[first[new]])
            all_keys = np.concatenate([self._keys, keys[new]])
            order = np.argsort(all_keys, kind="stable")
            self._keys, self._entry = all_keys[order], np.concatenate([self._entry, entry[new]])[order]
        return entry[inverse]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, each row closed by the closing id, and where each row begins (one more at the end)."""
        begin, end, before = textbytes.units(data, at)
        entry = self._entries(data, begin, end) if len(begin) else np.zeros(0, np.int64)
        whole = self._whole_rows(data, at)
        if len(whole):
            row = np.repeat(np.arange(len(at) - 1), np.diff(before))
            keep = ~np.isin(row, whole)
            made = self._add(data.tobytes(), at[whole], at[whole + 1])
            entry, row = np.concatenate([entry[keep], made]), np.concatenate([row[keep], whole])
            order = np.argsort(row, kind="stable")
            entry, before = entry[order], np.searchsorted(row[order], np.arange(len(at)))
        entry = np.insert(entry, before[1:], 0)
        after = before + np.arange(len(before))
        sizes = np.diff(self._place)[entry]
        ends = np.cumsum(sizes)
        ids = self._ids[np.repeat(self._place[entry] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[after]

    @staticmethod
    def _whole_rows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = [np.flatnonzero(data[:-1] == lead) for lead, _ in _WIDE_SPACE] if len(data) > 1 else []
        hits = [x[np.isin(data[x + 1], seconds)] for x, (_, seconds) in zip(found, _WIDE_SPACE)]
        places = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        return np.unique(np.searchsorted(at, places, "right") - 1)
