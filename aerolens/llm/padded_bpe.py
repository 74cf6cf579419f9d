"""Operator 11: byte-level BPE encoding and decoding on length-bucketed, padded matrices.

The pieces that the splitting pattern gives are independent of each other. Those
of a block that the task does not know yet are put into buckets of like length,
each a padded numpy matrix of token ids with one piece a row. In each round every
row merges its leftmost pair of minimum rank: the ranks of neighbouring pairs
stand in a second matrix, of which only the two pairs beside a merge are looked up
anew, in a hash table of all pairs that join to a token. Each merge takes one cell
out of its row, so the matrix is packed to one column less; rows without a pair
left are done and leave it. A piece that is itself a token is that token, whatever
its merges would give.

Pieces of over ``WIDE`` bytes are rows by themselves. There a round merges all
occurrences of the minimum pair that do not overlap, from the left, if no pair that
any of these merges makes on the way ranks lower (otherwise only the leftmost one),
which is what as many single rounds would do.

The vocabulary is a file of base64 tokens and ranks; its path is a parameter, it is
read on the driver and never trained. Ids are ranks.

Defined results: a null or empty text has no ids and decodes to no bytes; there are
no special tokens, their strings are ordinary text; bytes that are not UTF-8 are
read as U+FFFD; repeated rows are encoded one by one, whatever their ids; other
columns stay, but for those with the names of the new ones, which are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import sys
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: Bytes above which a piece is a row by itself.
WIDE = 512
#: Cells of one matrix.
CELLS = 1 << 19
#: Bytes of pieces that a task remembers before it starts afresh; longer pieces than ``KEEP`` are not remembered.
MEMO_BYTES, KEEP = 16 << 20, 64
#: Pieces of a text that are handled at once.
PIECES = 1 << 18

#: No pair, and no token (what rows are padded with).
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Ranks:
    """Tokens by id, and a hash table (open addressing) from pairs of ids to the id of the joined token."""
    tokens: list[bytes]
    byte_ids: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    shift: int
    longest_probe: int

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair the id of the joined token, which is its rank, or ``NONE``."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = _slots(key, self.shift)
        found, open_ = np.full(len(key), NONE, np.int32), np.arange(len(key))
        for _ in range(self.longest_probe + 1):
            there = self.keys[at]
            hit = there == key[open_]
            found[open_[hit]] = self.values[at[hit]]
            go = ~hit & (there >= 0)
            if not go.any():
                break
            open_, at = open_[go], (at[go] + 1) & (len(self.keys) - 1)
        return found


def _slots(key: np.ndarray, shift: int) -> np.ndarray:
    return (key.astype(np.uint64) * _MIX >> np.uint64(shift)).astype(np.int64)


def load_ranks(path: str) -> Ranks:
    with open(path, "rb") as f:
        ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    tokens = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        tokens[i] = token
    pairs = [(a, b, i) for token, i in ids.items() for s in range(1, len(token))
             if (a := ids.get(token[:s])) is not None and (b := ids.get(token[s:])) is not None]
    left, right, value = np.array(pairs, np.int64).reshape(-1, 3).T
    bits = max(int(4 * len(pairs)).bit_length(), 4)
    table = np.full(1 << bits, -1, np.int64)
    values = np.zeros(1 << bits, np.int32)
    key, rest, probe = left << 32 | right, np.arange(len(pairs)), 0
    at = _slots(key, 64 - bits)
    while True:  # each free slot goes to one of those that want it; the others look at the next slot
        free = table[at] < 0
        taker, first = np.unique(at[free], return_index=True)
        won = rest[free][first]
        table[taker], values[taker] = key[won], value[won]
        left_over = table[at] != key[rest]
        if not left_over.any():
            break
        rest, at, probe = rest[left_over], (at[left_over] + 1) & (len(table) - 1), probe + 1
    return Ranks(tokens, np.array([ids[bytes([b])] for b in range(256)], np.int32), table, values, 64 - bits, probe)


def merge_rows(ids: np.ndarray, ranks: Ranks) -> list[bytes]:
    """The merged ids (bytes of an int32 array) of each row of a matrix that is padded with ``NONE`` on the right."""
    n, width = ids.shape
    out: list = [None] * n
    row = np.arange(n)
    pair = np.full((n, max(width - 1, 0)), NONE, np.int32)
    real = ids[:, 1:] != NONE
    pair[real] = ranks.joined(ids[:, :-1][real], ids[:, 1:][real])
    while len(row):
        at = pair.argmin(1) if pair.shape[1] else np.zeros(len(row), np.int64)
        best = pair[np.arange(len(row)), at] if pair.shape[1] else np.full(len(row), NONE, np.int32)
        done = best == NONE
        if done.any():
            left = ids[done] != NONE
            raw, ends = ids[done][left].tobytes(), (4 * left.sum(1)).cumsum().tolist()
            for i, a, b in zip(row[done].tolist(), [0, *ends], ends):
                out[i] = raw[a:b]
            go = ~done
            row, ids, pair, at, best = row[go], ids[go], pair[go], at[go], best[go]
            if not len(row):
                break
        each, width = np.arange(len(row)), ids.shape[1]
        ids[each, at] = best
        keep = np.ones(ids.shape, bool)
        keep[each, at + 1] = False
        ids = ids[keep].reshape(len(row), width - 1)
        keep = np.ones(pair.shape, bool)
        keep[each, at] = False
        pair = pair[keep].reshape(len(row), width - 2)
        for k in (at - 1, at):  # the pairs that end and begin with the new token
            ok = (k >= 0) & (k < width - 2)
            r, c = each[ok], k[ok]
            b = ids[r, c + 1]
            new = ranks.joined(ids[r, c], b)
            new[b == NONE] = NONE
            pair[r, c] = new
    return out


def merge_wide(ids: np.ndarray, ranks: Ranks) -> bytes:
    """The same for one long row."""
    pair = ranks.joined(ids[:-1], ids[1:])
    while len(pair):
        best = pair.min()
        if best == NONE:
            break
        at = np.flatnonzero(pair == best)
        start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - start) % 2 == 0]  # of a run of overlapping pairs every second one
        chosen = np.zeros(len(ids), bool)
        chosen[at] = True
        back = np.where((at > 1) & chosen[at - 2], best, ids[at - 1])  # what stands before, after the merges to the left
        before, after = at > 0, at + 2 < len(ids)
        made = np.concatenate([ranks.joined(back[before], np.full(before.sum(), best)),
                               ranks.joined(np.full(after.sum(), best), ids[at[after] + 2])])
        if len(at) > 1 and (made < best).any():
            at = at[:1]
        ids[at] = best
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids = ids[keep]
        pair = np.append(pair, NONE)[keep][:-1]
        here = at - np.arange(len(at))  # where the new tokens stand now
        for k in (here - 1, here):
            k = k[(k >= 0) & (k < len(pair))]
            pair[k] = ranks.joined(ids[k], ids[k + 1])
    return ids.tobytes()


def encode_pieces(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of each piece (bytes of an int32 array), by merges alone."""
    out: list = [None] * len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    order = np.argsort(sizes, kind="stable")
    wide = order[sizes[order] > WIDE]
    for i in wide:
        out[i] = merge_wide(ranks.byte_ids[np.frombuffer(pieces[i], np.uint8)], ranks)
    order = order[:len(order) - len(wide)]
    # Buckets: lengths up to 16 by themselves, then within a power of two of each other.
    bucket = np.where(sizes[order] <= 16, sizes[order], 16 + np.ceil(np.log2(np.maximum(sizes[order], 1))))
    for some in np.split(order, np.flatnonzero(np.diff(bucket)) + 1) if len(order) else []:
        width = int(sizes[some[-1]])
        step = max(1, CELLS // max(width, 1))
        for part in (some[i:i + step] for i in range(0, len(some), step)):
            raw = np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)
            ids = np.full((len(part), width), NONE, np.int32)
            ids[np.arange(width) < sizes[part][:, None]] = ranks.byte_ids[raw]
            for i, found in zip(part.tolist(), merge_rows(ids, ranks)):
                out[i] = found
    return out


class Encoder:
    """Encodes texts by what it knows of their pieces: for each the ids, as the bytes of an int32 array."""

    def __init__(self, ranks: Ranks, pattern: str):
        import regex

        self.ranks, self.pieces = ranks, regex.compile(pattern)
        self.whole = {token: i for i, token in enumerate(ranks.tokens) if token}
        self.sizes = np.array([len(t) for t in ranks.tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(ranks.tokens), np.uint8)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def ids_of(self, lists: list[list[str]]) -> list[bytes]:
        known = self.known
        new = [p for p in set().union(*lists) if p not in known]
        if new:
            raw = [p.encode("utf-8") for p in new]
            token = [self.whole.get(r) for r in raw]
            rest = [i for i, t in enumerate(token) if t is None]
            found = dict(zip(rest, encode_pieces([raw[i] for i in rest], self.ranks)))
            known.update((p, found[i] if t is None else t.to_bytes(4, sys.byteorder)) for i, (p, t) in enumerate(zip(new, token)))
            self.held += sum(map(len, raw))
        ids = [b"".join(map(known.__getitem__, some)) for some in lists]
        if self.held > MEMO_BYTES:
            known.clear()
            self.held = 0
        else:
            for p in new:
                if len(p) > KEEP:
                    self.held -= len(p.encode("utf-8"))
                    del known[p]
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids begin (and the last ones end).
        A text of more than ``PIECES`` characters is taken in parts of as many pieces."""
        out: list = [None] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= PIECES]
        for i, ids in zip(short, self.ids_of([self.pieces.findall(texts[i]) for i in short])):
            out[i] = ids
        for i in set(range(len(texts))) - set(short):
            found, parts = self.pieces.finditer(texts[i]), []
            while some := [m.group() for m in islice(found, PIECES)]:
                parts += self.ids_of([some])
            out[i] = b"".join(parts)
        return np.frombuffer(b"".join(out), np.int32), np.cumsum([0, *(len(b) // 4 for b in out)])

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens in one array, and where each text's bytes begin (and the last ones end)."""
        size = self.sizes[ids]
        ends = np.cumsum(size, dtype=np.int64)
        kind = np.int32 if len(ids) and ends[-1] < 2**31 else np.int64
        at = np.repeat((self.starts[ids] - (ends - size)).astype(kind), size)
        at += np.arange(len(at), dtype=kind)
        return self.flat[at], np.concatenate([[0], ends])[starts]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
                 decoded_col: str | None = "decoded") -> DataFrame:
    """``docs`` with the ids of each text and, unless ``decoded_col`` is None, the bytes that they decode to."""
    import pyarrow as pa

    ranks = load_ranks(ranks_path)

    def factory():
        e = Encoder(ranks, pattern)

        def fn(texts):
            ids, starts = e.encode(texts)
            out = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))]
            if decoded_col is not None:
                raw, ends = e.decode(ids, starts)
                out.append(pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)]))
            return out
        return fn

    fields = f"`{ids_col}` array<int>" + ("" if decoded_col is None else f", `{decoded_col}` binary")
    return map_texts(docs, text_col, fields, factory)
