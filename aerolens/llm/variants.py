"""Operator 13: spelling variants, found by edits that Bloom filters let through.

Words are counted over all texts (``count_words``). Two words are near if one
becomes the other by inserting, deleting or replacing exactly one code point
(``near_pairs``): every word's edits are generated and looked up in blocked Bloom
filters of the vocabulary, one filter for each word length; only the edits that a
filter lets through are shuffled, to a join with the vocabulary that removes the
false ones. A word's form is its most frequent near word, if that is frequent
enough; its root is where the forms lead (``group_variants``).

What is generated: an insertion is the deletion seen from the longer word, and a
replacement is found from the word with the smaller letter, so each near pair comes
up exactly once: deletions (the last of a run of equal letters only) and replacements
by larger letters that some word has.

Broadcast: the blocks of the filters, at most ``PASS_BLOCKS`` of 64 bytes at a time.
A larger vocabulary is probed in several passes, each with the next blocks; nothing
is left out. Counting adds up per block of texts before the shuffle, so a word in
every text is no hot key; a word has at most some thousand near words, whatever
the corpus.

Defined results: null texts have no words; a null id counts as an empty one;
repeated rows count each; a run of any length is one word; columns other than id and
text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from aerolens.session import materialise

from .common import BLOCK_BYTES, bound_batches

#: A word is a maximal run of these; only A-Z are lower-cased.
LETTERS = r"a-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form has at least so many times the occurrences of its word.
FACTOR = 5

#: Bits of a filter for each word, lanes (64 bits each, one bit set by each word) of a block.
BITS, LANES = 16, 8
#: Blocks that are broadcast at once (32 MB).
PASS_BLOCKS = 1 << 19
#: Words of this length and above share one filter.
LONG = 64
#: Edits probed at once.
PROBES = 1 << 20

_P, _A, _B = (np.uint64(c) for c in (0x100000001B3, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misspell: int = 0,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): how often each word of at least ``min_length`` code points occurs, if ``min_count`` times or more.

    With ``misspell`` above 0, a run whose ``crc32("<id>:<run>")`` it divides first loses the code point at that number
    modulo the run's length.
    """
    bound_batches(docs.sparkSession)
    block = BLOCK_BYTES

    def work(batches):
        import re
        from collections import Counter
        from zlib import crc32

        import pyarrow as pa

        words = re.compile(f"[{LETTERS}]{{{min_length},}}")

        def table(total):
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        total, held = Counter(), 0
        for batch in batches:
            for key, raw in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                if (raw := raw.as_py()) is None:
                    continue
                text = raw.lower().decode("utf-8", "replace")  # of bytes only A-Z change
                found = Counter(words.findall(text) if len(text) <= block else (m.group() for m in words.finditer(text)))
                if misspell:
                    seed = crc32(f"{key.as_py() or ''}:".encode())
                    for w in [w for w in found if crc32(w.encode(), seed) % misspell == 0]:
                        at, n = crc32(w.encode(), seed) % len(w), found.pop(w)
                        if len(w) > min_length:
                            total[w[:at] + w[at + 1:]] += n
                total.update(found)
                held += len(raw)
                if held > block:
                    yield table(total)
                    total, held = Counter(), 0
        if total:
            yield table(total)

    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text")).mapInArrow(work, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- filters


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _A
    x = (x ^ x >> np.uint64(27)) * _B
    return x ^ x >> np.uint64(31)


def _powers(length: int) -> np.ndarray:
    """P^(length-1), ..., P, 1."""
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(length - 1, _P)]), dtype=np.uint64)[::-1]


def hashes(letters: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each row of a matrix of code points (words of one length)."""
    return ((letters.astype(np.uint64) + np.uint64(1)) * _powers(letters.shape[1])).sum(1, dtype=np.uint64)


def places(poly: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and the hash whose parts of six bits say which bit of each lane."""
    x = _mixed(poly)
    return (x >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32), _mixed(x + _P)


def edits(letters: np.ndarray, alphabet: np.ndarray, delete: bool, replace: bool):
    """All edits of words of one length, in parts: (row, position, new letter or -1 if it is deleted, hash)."""
    n, length = letters.shape
    power = _powers(length)
    value = letters.astype(np.uint64) + np.uint64(1)
    if delete and length > 1:
        head = np.cumsum(value[:, :-1] * power[1:], 1, dtype=np.uint64)
        head = np.concatenate([np.zeros((n, 1), np.uint64), head], 1)  # the letters before, each a place nearer to the end
        tail = np.cumsum((value * power)[:, ::-1], 1, dtype=np.uint64)[:, ::-1]
        tail = np.concatenate([tail[:, 1:], np.zeros((n, 1), np.uint64)], 1)
        last = np.ones((n, length), bool)
        last[:, :-1] = letters[:, 1:] != letters[:, :-1]
        row, at = np.nonzero(last)
        yield row, at, np.full(len(row), -1), (head + tail)[row, at]
    if replace and len(alphabet):
        whole = hashes(letters)
        step = max(1, PROBES // len(alphabet))
        for i in range(0, n * length, step):
            site = np.arange(i, min(i + step, n * length))
            row, at = site // length, site % length
            old = letters[row, at]
            which, letter = np.nonzero(alphabet[None, :] > old[:, None])
            new = alphabet[letter].astype(np.uint64)
            row, at, old = row[which], at[which], old[which].astype(np.uint64)
            yield row, at, alphabet[letter].astype(np.int64), whole[row] + (new - old) * power[at]


def _by_length(words: list[bytes]):
    """(indices, matrix of code points) for each length among the words."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(words) else []:
        yield some, np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(len(some), -1)


def filter_rows(words: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """(length, block, lane0, lane1, ...): the blocks of the filters of all words, those of one block put together."""
    lanes = [f"lane{i}" for i in range(LANES)]

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            raw = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for _, letters in _by_length(raw):
                kind = min(letters.shape[1], LONG)
                block, bits = places(hashes(letters), blocks[kind])
                lane = [(np.uint64(1) << (bits >> np.uint64(6 * i) & np.uint64(63))).view(np.int64) for i in range(LANES)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), kind, np.int32)), pa.array(block.astype(np.int64)), *map(pa.array, lane)],
                                                 names=["length", "block", *lanes])

    rows = words.select("word").mapInArrow(work, "length int, block bigint, " + ", ".join(f"{c} bigint" for c in lanes))
    return rows.groupBy("length", "block").agg(*[F.bit_or(c).alias(c) for c in lanes])


def passes(blocks: dict[int, int], most: int) -> list[list[tuple[int, int, int]]]:
    """All blocks of all filters as ranges (length, first, end), dealt to passes of at most ``most`` blocks."""
    out, room = [], 0
    for length, n in sorted(blocks.items()):
        start = 0
        while start < n:
            if not room:
                out.append([])
                room = most
            end = min(n, start + room)
            out[-1].append((length, start, end))
            room -= end - start
            start = end
    return out


def near_pairs(words: DataFrame, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """(a, b, n_a, n_b): every pair of near words of the table (word, n), once. ``words`` is read several
    times and should be a written table; its words are of code points below 256, each once."""
    spark = words.sparkSession
    kind = F.least(F.length("word"), F.lit(LONG))
    # At most LONG rows, and at most 90 letters.
    sizes = {r.length: r.n for r in words.groupBy(kind.alias("length")).agg(F.count("*").alias("n")).collect()}
    letters = sorted(ord(r[0]) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())
    blocks = {length: max(1, math.ceil(n * BITS / (64 * LANES))) for length, n in sizes.items()}
    alphabet = np.array(letters, np.uint8)
    rounds = passes(blocks, pass_blocks)
    table = filter_rows(words, blocks)
    if len(rounds) > 1:
        table = materialise(table, "filters")
    found = []
    for some in rounds:
        wanted = F.lit(False)
        for length, first, end in some:
            wanted |= (F.col("length") == length) & F.col("block").between(first, end - 1)
        held = {length: (first, np.zeros((end - first, LANES), np.uint64)) for length, first, end in some}
        got = table.where(wanted).toArrow()
        lengths, numbers = got["length"].to_numpy(), got["block"].to_numpy()
        lanes = np.stack([got[f"lane{i}"].to_numpy().view(np.uint64) for i in range(LANES)], 1)
        for length, (first, into) in held.items():
            own = lengths == length
            into[numbers[own] - first] = lanes[own]
        sent = spark.sparkContext.broadcast(held)
        out = materialise(words.where(kind.isin([*held, *(length + 1 for length in held)])).mapInArrow(
            _prober(sent, blocks, alphabet), "a string, n_a bigint, b string"), "probed")
        sent.unpersist()
        found.append(out)
    if not found:
        found = [words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word").alias("b"))]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").select("a", "b", "n_a", "n_b")


def _prober(sent, blocks: dict[int, int], alphabet: np.ndarray):
    """The task that generates the edits of its words and keeps those that the filters in ``sent`` let through."""
    def work(batches):
        import pyarrow as pa

        filters = sent.value
        for batch in batches:
            raw = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            n = batch.column(1).to_numpy()
            for index, letters in _by_length(raw):
                length = letters.shape[1]
                step = max(1, PROBES // length)
                for i in range(0, len(index), step):
                    part = letters[i:i + step]
                    for to, delete in ((length - 1, True), (length, False)):
                        target = min(to, LONG)
                        if target not in filters:
                            continue
                        first, bits = filters[target]
                        for row, at, new, poly in edits(part, alphabet, delete, not delete):
                            block, which = places(poly, blocks[target])
                            block = block.astype(np.int64) - first
                            ok = np.flatnonzero((block >= 0) & (block < len(bits)))
                            for lane in range(LANES):
                                ok = ok[bits[block[ok], lane] >> (which[ok] >> np.uint64(6 * lane) & np.uint64(63)) & np.uint64(1) == 1]
                            if len(ok):
                                own = index[i:i + step][row[ok]]
                                edited = [(w := raw[k])[:p] + (b"" if c < 0 else bytes([c])) + w[p + 1:]
                                          for k, p, c in zip(own.tolist(), at[ok].tolist(), new[ok].tolist())]
                                yield pa.RecordBatch.from_arrays([
                                    pa.array([raw[k].decode("latin-1") for k in own.tolist()], pa.string()), pa.array(n[own], pa.int64()),
                                    pa.array([w.decode("latin-1") for w in edited], pa.string())], names=["a", "n_a", "b"])
    return work


# ---------------------------------------------------------------- forms and roots


def follow(links: DataFrame, longest: int) -> DataFrame:
    """(word, root) for links (word, form) without cycles, of at most ``longest`` links to the end: each round doubles the way."""
    at = materialise(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = materialise(at.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return at


def group_variants(words: DataFrame, factor: int = FACTOR, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table (word, n): the number of near words, the most frequent of them
    (ties: the first in code-point order) if it has ``factor`` times the occurrences or more, and where the forms lead."""
    words = materialise(words.select("word", "n"), "words")
    pairs = near_pairs(words, pass_blocks)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("own_n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("n_b").alias("own_n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    near = pairs.select(F.explode(ways).alias("p")).groupBy("p.word").agg(
        F.count("*").alias("n_near"), F.any_value("p.own_n").alias("own_n"), F.min(F.struct(-F.col("p.near_n"), F.col("p.near"))).alias("best"))
    best_n, enough = -F.col("best.col1"), -F.col("best.col1") >= factor * F.col("own_n")
    near = materialise(near.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, best_n).alias("form_n")), "near")
    low, high = words.agg(F.min("n"), F.max("n")).first()
    longest = int(math.log(high / max(low, 1), factor)) + 1 if high else 0  # each link has ``factor`` times the occurrences of the one before
    roots = follow(near.where("form IS NOT NULL"), longest)
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
