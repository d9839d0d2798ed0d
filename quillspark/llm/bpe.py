"""BPE encoding and decoding: merge ranks in a priority queue over a doubly linked symbol list.

Rows and edge cases
-------------------
* null text: the empty text (no ids, both digests those of zero bytes); null ``doc_id``: kept as null
* very long texts: the text streams through in space-delimited pieces; a piece of n bytes takes O(n log n)
* repeated rows: one output row each; ties of merge ranks: leftmost pair first
* empty table: empty result; other input columns are ignored
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Callable, Iterable
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from quillspark.llm.common import id_and_text, map_rows

# White space and word classes of the vocabulary's published pre-tokenisation pattern.
_WHITE = "\t-\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"

#: Pieces kept with their ids in each Python worker; a full cache starts anew.
CACHE_PIECES = 1_000_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Rerun(Exception):
    """A piece whose ids depend on its neighbours."""


class _Pieces(dict):
    """Ids, as little-endian bytes, by piece; a missing piece is encoded and kept."""

    def __init__(self, codec: ByteBpe, lead: str):
        super().__init__()
        self.codec, self.lead = codec, lead

    def __missing__(self, piece: str) -> bytes:
        if self.lead and (not piece or self.codec.is_white(piece[0])):
            raise _Rerun
        ids = self.codec.ids_by_pattern(self.lead + piece)
        if len(self) >= CACHE_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class ByteBpe:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        self.shift = max(vocab.values()).bit_length()
        #: left id and right id, packed, to rank and merged id, packed
        self.merge: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault(vocab[left] << self.shift | vocab[right], rank << self.shift | vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        #: the bytes of each id
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.split = regex.compile(_PATTERN).findall
        self.is_white = regex.compile(f"[{_WHITE}]").match
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")").split if by_length else None
        self.first, self.later = _Pieces(self, ""), _Pieces(self, " ")

    def merged(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        symbol: list[int] = [self.byte_id[b] for b in word]
        n = len(symbol)
        if n < 2:
            return symbol
        merge, shift, low = self.merge, self.shift, (1 << self.shift) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry holds rank, place and the pair it was made for; the pair tells whether it is stale.
        pairs = [a << shift | b for a, b in zip(symbol, symbol[1:])]
        queue = [(found, i, pair) for i, pair in enumerate(pairs) if (found := merge.get(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            found, i, pair = heapq.heappop(queue)
            j = after[i]
            if j >= n or symbol[i] < 0 or symbol[i] << shift | symbol[j] != pair:
                continue
            symbol[i], symbol[j] = found & low, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = symbol[i] << shift | symbol[k]
                if (found := merge.get(pair)) is not None:
                    heapq.heappush(queue, (found, i, pair))
            h = before[i]
            if h >= 0:
                pair = symbol[h] << shift | symbol[i]
                if (found := merge.get(pair)) is not None:
                    heapq.heappush(queue, (found, h, pair))
        return [s for s in symbol if s >= 0]

    def ids_by_pattern(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, by the pre-tokenisation pattern over the whole text."""
        ids = [i for w in self.split(text) for i in self.merged(w.encode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        The text is cut at spaces. A piece's ids don't depend on its neighbours unless it is empty or
        starts with white space; then the pattern runs over the whole text.
        """
        parts = self.special_split(text) if self.special_split else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                first, *later = part.split(" ")
                try:
                    out += [self.first[first], *map(self.later.__getitem__, later)]
                except _Rerun:
                    out.append(self.ids_by_pattern(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that aren't UTF-8 become U+FFFD."""
        raw = b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


def _per_task(path: str) -> Callable[[], Callable[[tuple], Iterable[tuple]]]:
    def make() -> Callable[[tuple], Iterable[tuple]]:
        codec = load(path)

        def row(values: tuple) -> Iterable[tuple]:
            doc_id, text = values
            ids = codec.encode(text)
            yield doc_id, len(ids) // 4, sha256(ids).hexdigest(), sha256(codec.decode(ids)).hexdigest()

        return row

    return make


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The vocabulary at ``path``, once a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: ``n_tokens``, and the digests of its ids and of what they decode to."""
    return map_rows(id_and_text(docs), _per_task(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """Per document: the ids themselves."""

    def make() -> Callable[[tuple], Iterable[tuple]]:
        codec = load(path)
        return lambda v: [(v[0], np.frombuffer(codec.encode(v[1]), "<u4").tolist())]

    return map_rows(id_and_text(docs), make, "doc_id long, ids array<int>")
