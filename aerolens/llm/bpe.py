"""Operator 7: byte-level BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged
across, so every such pair in a text is a certain cut. Words (as the
vocabulary's own splitting pattern gives them) are cut there, the fragments are
encoded independently, and the ids are put together again. Fragments repeat
often, so each task keeps the ids of those it has met, up to a bound.

The vocabulary is a file in the format of the ``tokenizers`` library (byte-level
BPE); its path is a parameter, it is read on the driver and never trained.

Defined results: a null or empty text has no ids and decodes to the empty text;
special tokens in a text become their single id, as in the library; bytes that
are not UTF-8 are read as U+FFFD; repeated rows are encoded one by one.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass
from itertools import chain, islice

from pyspark.sql import DataFrame

from .common import map_texts

#: Fixed value: the splitting pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a task remembers before it starts afresh.
MEMO = 400_000
#: Texts above this many characters are encoded word by word rather than as one list.
LONG = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    token_bytes: list[bytes]
    #: (left id, right id) -> rank, and the id that each rank's merge gives
    merges: dict[tuple[int, int], int]
    results: list[int]
    byte_ids: list[int]
    special: dict[str, int]

    def inner_pairs(self) -> bytes:
        """For each byte pair (a * 256 + b): 1 if some token holds it inside."""
        inside = bytearray(1 << 16)
        for token in self.token_bytes:
            for a, b in zip(token, token[1:]):
                inside[a << 8 | b] = 1
        return bytes(inside)


def byte_letters() -> dict[str, int]:
    """Letter -> byte in vocabulary files: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, ids = byte_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    token_bytes = [b""] * (1 + max([*ids.values(), *special.values()]))
    for token, i in ids.items():
        if token not in special:
            token_bytes[i] = bytes(letters[c] for c in token)
    for token, i in special.items():
        token_bytes[i] = token.encode()
    merges, results = {}, []
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.setdefault((ids[a], ids[b]), rank)
        results.append(ids[a + b])
    by_byte = {b: ids[c] for c, b in letters.items()}
    return Vocabulary(token_bytes, merges, results, [by_byte[b] for b in range(256)], special)


def merge_short(ids: list[int], merges: dict, results: list[int]) -> list[int]:
    """Apply the merges, lowest rank first and leftmost first, on a list: fine for a word."""
    none, get = len(results), merges.get
    ranks = [get(p, none) for p in zip(ids, ids[1:])]
    while ranks:
        rank = min(ranks)
        if rank == none:
            break
        i = ranks.index(rank)
        ids[i:i + 2] = [results[rank]]
        del ranks[i]
        if i < len(ranks):
            ranks[i] = get((ids[i], ids[i + 1]), none)
        if i:
            ranks[i - 1] = get((ids[i - 1], ids[i]), none)
    return ids


def merge_long(ids: list[int], merges: dict, results: list[int]) -> list[int]:
    """The same with a heap over a linked list: n log n for very long fragments."""
    n = len(ids)
    after, before, ids = list(range(1, n + 1)), list(range(-1, n - 1)), list(ids)
    heap = [(merges[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
            continue
        ids[i], ids[j] = results[merges[pair]], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (p := (ids[i], ids[k])) in merges:
                heapq.heappush(heap, (merges[p], i, p))
        if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in merges:
            heapq.heappush(heap, (merges[p], h, p))
    return [x for x in ids if x >= 0]


def fragments(word: bytes, inner: bytes) -> list[bytes]:
    """``word`` cut between all byte pairs that no token holds inside."""
    cuts = [i + 1 for i, (a, b) in enumerate(zip(word, word[1:])) if not inner[a << 8 | b]]
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]


class Encoder(dict):
    """word -> its ids, filled as words are met and emptied at ``MEMO`` entries."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        super().__init__()
        self.v, self.inner, self.known = vocabulary, vocabulary.inner_pairs(), {}
        self.words = regex.compile(PATTERN)
        marks = "|".join(regex.escape(t) for t in sorted(vocabulary.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None

    def fragment(self, raw: bytes) -> list[int]:
        ids = self.known.get(raw)
        if ids is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            ids = self.known[raw] = self.merged(raw)
        return ids

    def merged(self, raw: bytes) -> list[int]:
        start = [self.v.byte_ids[b] for b in raw]
        return (merge_short if len(raw) <= 64 else merge_long)(start, self.v.merges, self.v.results)

    def __missing__(self, word: str) -> list[int]:
        parts = fragments(word.encode("utf-8"), self.inner)
        ids = self.merged(parts[0]) if len(parts) == 1 else [i for raw in parts for i in self.fragment(raw)]
        if len(self) >= MEMO:
            self.clear()
        self[word] = ids
        return ids

    def plain(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return list(chain.from_iterable(map(self.__getitem__, self.words.findall(text))))
        found, ids = self.words.finditer(text), []
        while some := [m.group() for m in islice(found, 1 << 16)]:
            ids.extend(chain.from_iterable(map(self.__getitem__, some)))
        return ids

    def encode(self, text: str) -> list[int]:
        if self.marks is None or not self.marks.search(text):
            return self.plain(text)
        ids = []
        for i, part in enumerate(self.marks.split(text)):
            ids.extend([self.v.special[part]] if i % 2 else self.plain(part))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.v.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "ids",
                 decoded_col: str | None = "decoded") -> DataFrame:
    """``docs`` with the ids of each text and, unless ``decoded_col`` is None, what they decode to."""
    vocabulary = load_vocabulary(vocabulary_path)

    def factory():
        e = Encoder(vocabulary)

        def fn(texts):
            ids = [e.encode(t) for t in texts]
            return [ids] if decoded_col is None else [ids, [e.decode(i) for i in ids]]
        return fn

    fields = f"`{ids_col}` array<int>" + ("" if decoded_col is None else f", `{decoded_col}` string")
    return map_texts(docs, text_col, fields, factory)
