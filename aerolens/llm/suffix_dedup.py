"""Operator 8: exact removal of repeated passages with suffix arrays.

Texts are UTF-8 bytes. A byte is removed if it lies in a ``LENGTH``-byte string
that also starts earlier: in a smaller document, or earlier in the same one.
Overlapping occurrences count, and all strings are judged on the input.

1. Anchors. Every window of ``LENGTH`` bytes is represented by the least hash
   among its ``GRAM``-byte grams (leftmost of equals), so equal windows have
   equal anchors at equal places. Neighbouring windows with one anchor form a
   run; the bytes of a run's windows are its context.
2. Only anchors that occur at least twice in the corpus go on; a bitmap of fixed size
   keeps most other runs from being hashed and shuffled. Of runs with the
   same context, all but the first are repeated throughout; that is settled
   in the block where they meet, or by (anchor, context) hash.
3. The distinct contexts of an anchor may still share windows. They are dealt by
   anchor to shards of about ``SHARD_BYTES``. Windows whose place around the
   anchor differs by less than ``CLASS`` have most bytes in common; those whose
   common bytes no other context has are left out. The shard's suffix array is
   built by induced sorting (SA-IS): suffixes are classified, leftmost-smaller
   substrings are sorted recursively, and the order of all suffixes is induced
   linearly. Permuted common prefixes (computed where they are irreducible)
   then give the groups of equal windows.
4. An anchor with more than ``HOT`` contexts would overload a shard. Its windows
   are grouped one by one by a 128-bit hash instead, an aggregation that Spark
   combines before the shuffle; this covers the same windows exactly.

Defined results: a null or empty text has no bytes; one shorter than ``LENGTH``
loses nothing. Rows with equal ids and equal texts are one document (none
starts earlier than another); of rows with equal ids and other texts, the
smaller text (by its hash) counts as earlier; a null id comes first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from aerolens.session import scratch_path

from .common import bound_batches

LENGTH, GRAM = 100, 48
SHARD_BYTES = 1 << 20
HOT = 1000
CLASS = 14
#: Bytes that are scanned for anchors at once; a longer text is scanned in pieces.
BLOCK = 1 << 20
#: Bits of an anchor that the bitmap of repeated anchors tells apart (2^28 bits, 32 MB, whatever the corpus): where more anchors
#: than that are repeated, more runs pass it, to be left out by the join with the anchors themselves.
BITMAP = 28
#: Ids sent to all tasks to pick their texts (8 bytes each); above, they are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
_U = np.uint64

# ------------------------------------------------------------------ suffix arrays


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type); the last one (the sentinel) is."""
    n = len(s)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _lms(small: np.ndarray) -> np.ndarray:
    """Starts of the leftmost-smaller substrings: S-type after L-type."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by key, and each ordered element's place among its equals."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return order, np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k))))


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The order of all suffixes induced from that of ``lms``, one bucket of first letters at a
    time; what a bucket adds to itself is worked off in waves."""
    end = np.cumsum(size)
    start = end - size
    sa = np.full(len(s), -1, np.int64)
    order, rank = _ranks(s[lms])
    letters = s[lms][order]
    per = np.bincount(letters, minlength=len(size))
    sa[end[letters] - per[letters] + rank] = lms[order]
    used = [c for c in np.flatnonzero(size)]

    head = start.copy()
    for c in used:
        at = start[c]
        fixed = sa[end[c] - per[c]:end[c]].copy()
        while True:
            wave, at = sa[at:head[c]], head[c]
            if not len(wave):
                break
            j = wave - 1
            j = j[(j >= 0) & ~small[j]]
            if len(j):
                o, r = _ranks(s[j])
                j = j[o]
                sa[head[s[j]] + r] = j
                head += np.bincount(s[j], minlength=len(size))
        j = fixed - 1
        j = j[(j >= 0) & ~small[j]]
        if len(j):
            o, r = _ranks(s[j])
            j = j[o]
            sa[head[s[j]] + r] = j
            head += np.bincount(s[j], minlength=len(size))

    tail = end.copy()
    for c in reversed(used):
        at = end[c]
        while True:
            wave, at = sa[tail[c]:at][::-1], tail[c]
            if not len(wave):
                break
            j = wave - 1
            j = j[(j >= 0) & small[j]]
            if len(j):
                o, r = _ranks(s[j])
                j = j[o]
                sa[tail[s[j]] - 1 - r] = j
                tail -= np.bincount(s[j], minlength=len(size))
        j = sa[start[c]:head[c]][::-1] - 1
        j = j[(j >= 0) & small[j]]
        if len(j):
            o, r = _ranks(s[j])
            j = j[o]
            sa[tail[s[j]] - 1 - r] = j
            tail -= np.bincount(s[j], minlength=len(size))
    sa[0] = len(s) - 1  # the sentinel, which nothing induces
    return sa


def _induce_plain(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same, suffix by suffix: for large alphabets, whose buckets hold few suffixes each."""
    end = np.cumsum(size).tolist()
    head, tail = (np.cumsum(size) - size).tolist(), list(end)
    text, is_small, n = s.tolist(), small.tolist(), len(s)
    sa = [-1] * n
    for i in reversed(lms.tolist()):
        c = text[i]
        tail[c] -= 1
        sa[tail[c]] = i
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not is_small[j]:
            c = text[j]
            sa[head[c]] = j
            head[c] += 1
    tail = end
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and is_small[j]:
            c = text[j]
            tail[c] -= 1
            sa[tail[c]] = j
    sa[0] = n - 1
    return np.array(sa, np.int64)


def _same_lms(s: np.ndarray, small: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """For each ordered leftmost-smaller substring: does it equal the one before?"""
    length = np.zeros(len(s), np.int64)
    length[lms[:-1]] = np.diff(lms) + 1  # each reaches to the start of the next
    length[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    equal = length[a] == length[b]
    live, step = np.flatnonzero(equal), 0
    while len(live):
        x, y = a[live] + step, b[live] + step
        ok = (s[x] == s[y]) & (small[x] == small[y])
        equal[live[~ok]] = False
        step += 1
        live = live[ok]
        live = live[length[a[live]] > step]
    return np.concatenate([[False], equal])


def suffix_array(s: np.ndarray, letters: int) -> np.ndarray:
    """Suffix array of ``s``, whose last element is 0 and the only 0; values are below ``letters``."""
    if len(s) < 2:
        return np.zeros(len(s), np.int64)
    small, size = _types(s), np.bincount(s, minlength=letters)
    induce = _induce if len(s) > 64 * letters else _induce_plain
    lms = _lms(small)
    if not len(lms):
        lms = np.array([len(s) - 1])
    rough = induce(s, small, lms, size)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    names = np.empty(len(s), np.int64)
    names[ordered] = np.cumsum(~_same_lms(s, small, lms, ordered)) - 1
    reduced = names[lms]
    count = int(reduced.max()) + 1
    if count < len(lms):
        ordered = lms[suffix_array(reduced, count)]
    return induce(s, small, ordered, size)


def _words8(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number (zeros after the end)."""
    n = len(b)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = b
    out = np.empty(n, _U)
    for o in range(8):
        v = np.frombuffer(padded, "<u8", (n + 16 - o) // 8, o)
        out[o::8] = v[:len(out[o::8])]
    return out


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """PLCP: for each place, the common prefix with the suffix ranked just before it.

    Where the letters before the two are equal, the value is one less than that of the place before;
    only the other places (irreducible ones) are compared, eight letters at a time."""
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    i = np.arange(n)
    cut = (before <= 0) | (i == 0)
    cut[~cut] = s[i[~cut] - 1] != s[before[~cut] - 1]
    a = np.flatnonzero(cut & (before >= 0))
    b, value = before[a], np.zeros(len(a), np.int64)
    w = _words8(s.astype(np.uint8)) if s.max() < 256 else None
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + value[live], b[live] + value[live]
        inside = np.maximum(x, y) < n
        live, x, y = live[inside], x[inside], y[inside]
        diff = w[x] ^ w[y]
        low = diff & (~diff + _U(1))
        same = np.where(diff == 0, 8, np.floor(np.log2(np.maximum(low, _U(1)).astype(np.float64))).astype(np.int64) // 8)
        value[live] += np.minimum(same, n - np.maximum(x, y))
        live = live[diff == 0]
    out = np.zeros(n, np.int64)
    out[a] = value + a
    last = np.maximum.accumulate(np.where(cut, i, 0))
    return np.maximum(np.where(before >= 0, out[last] - i, 0), 0)


def equal_windows(contexts: list[bytes], length: int) -> np.ndarray:
    """For contexts laid end to end, a group number for every place that starts a window of ``length``
    bytes inside its context (equal windows, equal numbers), and -1 elsewhere."""
    sizes = np.array([len(c) + 1 for c in contexts])
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    # 0 ends the whole, 1 ends a context; bytes are moved up to make room (0xF5-0xFF never occur in UTF-8).
    s = raw.astype(np.int64) + 2
    ends = np.cumsum(sizes) - 1
    s[ends] = 1
    s = np.append(s, 0)
    sa = suffix_array(s, 258)
    plcp = common_prefixes(s, sa)
    number = np.empty(len(s), np.int64)
    number[sa] = np.cumsum(plcp[sa] < length)
    left = np.repeat(ends, sizes) - np.arange(len(s) - 1)
    return np.where(left >= length, number[:-1], -1)


# ------------------------------------------------------------------ anchors


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def anchor_runs(buf: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, gram: int):
    """(anchor, first, last, hash) of each run of windows inside the texts buf[start:end]."""
    n, none = len(buf), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(_U)
    w = _words8(buf)
    h = w[:n - gram + 1].copy()
    for j in range(8, gram, 8):
        h *= _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        h += w[j:n - gram + 1 + j]
    h = _mix(h)
    # The least of the upper 40 bits, leftmost first, by doubling; the place is in the lower 24.
    key = (h >> _U(24) << _U(24)) | np.arange(len(h), dtype=_U)
    wide, low, span = length - gram + 1, key, 1
    while 2 * span <= wide:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    low = np.minimum(low[:len(key) - wide + 1], low[wide - span:len(key) - span + 1])
    anchor = (low & _U(0xFFFFFF)).astype(np.int64)
    edge = np.zeros(len(anchor) + 1, np.int32)
    fits = end - start >= length
    edge[start[fits]] += 1
    np.add.at(edge, end[fits] - length + 1, -1)
    p = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    if not len(p):
        return none, none, none, none.astype(_U)
    a = anchor[p]
    text = np.searchsorted(start, p, side="right")
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return a[first], p[first], p[last], h[a[first]]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, in order; spans that touch become one."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, reach = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def _blocks(batches):
    """Pieces (key, offset, bytes) of texts, in blocks of about ``BLOCK`` bytes."""
    block, held = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_py() or b""
            for at in range(0, max(1, len(raw) - LENGTH + 1), BLOCK):
                piece = raw[at:at + BLOCK + LENGTH - 1]
                if len(piece) < LENGTH:
                    continue
                block.append((key, at, piece))
                held += len(piece)
                if held >= BLOCK:
                    yield block
                    block, held = [], 0
    if block:
        yield block


def _scan(block):
    """Runs of a block: keys, offsets of first and last window in their text, anchor place, hash, place in the block's bytes."""
    buf = np.frombuffer(b"".join(p for _, _, p in block), np.uint8)
    size = np.array([len(p) for _, _, p in block])
    end = np.cumsum(size)
    start = end - size
    a, first, last, h = anchor_runs(buf, start, end, LENGTH, GRAM)
    which = np.searchsorted(start, first, side="right") - 1
    keys, base = np.array([k for k, _, _ in block], np.int64)[which], np.array([o for _, o, _ in block], np.int64)[which]
    return buf, keys, base + first - start[which], last - first, a - first, h.view(np.int64), first


#: A row of the scan is four numbers. For a run: anchor hash, context hash, document, and its first window's
#: offset, number of windows and anchor place in one. For a settled span: any number, its end, document, -1 - start.
_FIELDS = "h bigint, c bigint, doc bigint, meta bigint"


def _pack(first, run, place):
    return first << 14 | run << 7 | place


def anchor_counts(docs: DataFrame) -> DataFrame:
    """(h): the anchors that occur at least twice."""
    import pyarrow as pa

    def work(batches):
        for block in _blocks(batches):
            h, n = np.unique(_scan(block)[5], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])
    return docs.mapInArrow(work, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def anchor_bits(anchors: DataFrame) -> np.ndarray:
    """One bit for each value of the upper ``BITMAP`` bits of an anchor, set where an anchor of the table has it."""
    place = F.shiftrightunsigned("h", 64 - BITMAP)
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    found = anchors.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), _U)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(_U)
    return out


def anchor_rows(docs: DataFrame, often: DataFrame) -> DataFrame:
    """Rows of ``_FIELDS``: the first run of each (anchor, context) in a block, and the spans of the others; of runs whose
    anchor is in ``often`` (h), and some others that share its bit in a bitmap of fixed size."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(anchor_bits(often))

    def work(batches):
        import xxhash

        digest, bits = xxhash.xxh3_64_intdigest, sent.value
        for block in _blocks(batches):
            buf, *runs = _scan(block)
            spot = runs[4].view(_U) >> _U(64 - BITMAP)
            some = np.flatnonzero(bits[(spot >> _U(6)).astype(np.int64)] >> (spot & _U(63)) & _U(1))
            if not len(some):
                continue
            doc, first, run, place, h, at = (x[some] for x in runs)
            raw = buf.tobytes()
            c = np.fromiter((digest(raw[x:x + r + LENGTH]) for x, r in zip(at.tolist(), run.tolist())), _U, len(h)).view(np.int64)
            o = np.lexsort((first, doc, c, h))
            doc, first, run, place, h, c = (x[o] for x in (doc, first, run, place, h, c))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            lead = np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(h))))
            later = (doc != doc[lead]) | (first != first[lead])
            spans = [np.zeros(0, np.int64)] * 4
            if later.any():
                d, s, e = doc[later], first[later], first[later] + run[later] + LENGTH
                o = np.lexsort((s, d))
                d, s, e = d[o], s[o], e[o]
                # Merge per document: documents are moved apart so that one pass does all.
                number = np.cumsum(np.concatenate([[0], (d[1:] != d[:-1]).astype(np.int64)]))
                far = int(e.max()) + 1
                a, b = merged(s + number * far, e + number * far)
                which = a // far
                ids = d[np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))][which]
                a, b = a - which * far, b - which * far
                spans = [_mix(a.view(_U)).view(np.int64), b, ids, -1 - a]
            rows = [np.concatenate([x[new], y]) for x, y in zip((h, c, doc, _pack(first, run, place)), spans)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["h", "c", "doc", "meta"])
    return docs.mapInArrow(work, _FIELDS)


# ------------------------------------------------------------------ the operator


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, id): ``doc`` orders documents. It is the id where ids are unique; else documents are numbered."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    if rows.select("id").groupBy("id").count().where("id IS NULL OR count > 1").isEmpty():
        return rows.select(F.col("id").cast("bigint").alias("doc"), "text", "id")
    name = F.sha2("text", 256)
    order = rows.select("id", name.alias("name")).distinct().orderBy(F.col("id").asc_nulls_first(), "name")
    order = _written(order.withColumn("doc", F.monotonically_increasing_id()), "suffix-order")
    both = rows.withColumn("name", name).alias("r").join(order.alias("o"), F.expr("r.id <=> o.id AND r.name = o.name"))
    return _written(both.select("o.doc", "r.text", "r.id"), "suffix-docs")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, doc, first, run, place, hot, context) for ``wanted``, which has all but the context."""
    import pyarrow as pa

    by_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("first", "run", "place", "h", "hot")).alias("runs"))
    ids = wanted.select("doc").distinct()
    side = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    texts = docs.join(side, "doc", "left_semi").select("doc", "text")

    def work(batches):
        for batch in batches:
            cols = [[] for _ in range(7)]
            for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for r in runs:
                    row = (r["h"], doc, r["first"], r["run"], r["place"], r["hot"], text[r["first"]:r["first"] + r["run"] + LENGTH])
                    for x, v in zip(cols, row):
                        x.append(v)
            types = [*[pa.int64()] * 5, pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)],
                                             names=["h", "doc", "first", "run", "place", "hot", "context"])
    return texts.join(by_doc, "doc").select("doc", "text", "runs").mapInArrow(
        work, "h bigint, doc bigint, first bigint, run bigint, place bigint, hot boolean, context binary")


def shared_parts(contexts: list[bytes], anchors: np.ndarray, places: np.ndarray, runs: np.ndarray) -> list[tuple[int, int, int]]:
    """(context, first window, last window) of the parts whose windows may occur in another context.

    All windows that start ``CLASS`` * c to ``CLASS`` * c + ``CLASS`` - 1 bytes before their anchor hold
    the same ``LENGTH`` - ``CLASS`` + 1 bytes around it. If no other context of the anchor has those,
    none of these windows occurs in another one."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    which, number, lo, hi, key = [], [], [], [], []
    for i, (raw, place, run) in enumerate(zip(contexts, places.tolist(), runs.tolist())):
        for c in range((place - run) // CLASS, place // CLASS + 1):
            at = place - c * CLASS
            which.append(i), number.append(c), lo.append(max(0, at - CLASS + 1)), hi.append(min(run, at))
            key.append(digest(raw[at:at + LENGTH - CLASS + 1], c & 0xFF))
    key = np.array(key, _U) ^ _mix(anchors.view(_U))[which]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    parts: list[tuple[int, int, int]] = []
    for k in np.flatnonzero(count[inverse] > 1)[::-1].tolist():  # a context's classes, from its first window on
        if parts and parts[-1][0] == which[k] and parts[-1][2] + 1 == lo[k]:
            parts[-1] = (which[k], parts[-1][1], hi[k])
        else:
            parts.append((which[k], lo[k], hi[k]))
    return parts


def _shard_spans(contexts: DataFrame) -> DataFrame:
    """(doc, start, end): windows of a shard's contexts that start earlier in another one."""
    import pyarrow as pa

    total = contexts.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def work(table: pa.Table) -> pa.Table:
        h, doc, first, run, place = (table.column(c).to_numpy() for c in ("h", "doc", "first", "run", "place"))
        raw = table.column("context").to_pylist()
        parts = shared_parts(raw, h, place, run)
        if not parts:
            return pa.table({c: np.zeros(0, np.int64) for c in ("doc", "start", "end")})
        raw = [raw[i][a:b + LENGTH] for i, a, b in parts]
        doc, first = doc[[i for i, _, _ in parts]], first[[i for i, _, _ in parts]] + np.array([a for _, a, _ in parts])
        group = equal_windows(raw, LENGTH)
        size = np.array([len(c) + 1 for c in raw])
        which = np.repeat(np.arange(len(raw)), size)
        at = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        ok = np.flatnonzero(group >= 0)
        g, d, p = group[ok], doc[which[ok]], first[which[ok]] + at[ok]
        o = np.lexsort((p, d, g))
        g, d, p = g[o], d[o], p[o]
        later = np.concatenate([[False], g[1:] == g[:-1]])
        # Not later than the first at the same place: that is the same window.
        lead = np.maximum.accumulate(np.where(later, 0, np.arange(len(g))))
        later &= (d != d[lead]) | (p != p[lead])
        d, p = d[later], p[later]
        o = np.lexsort((p, d))
        d, p = d[o], p[o]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + LENGTH)]) if len(d) else np.zeros(0, bool)
        f = np.flatnonzero(new)
        return pa.table({"doc": d[f], "start": p[f], "end": p[np.append(f[1:], len(d)) - 1] + LENGTH if len(f) else p[f]})

    dealt = contexts.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(work, "doc bigint, start bigint, end bigint")


def _hot_spans(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: windows grouped by their own hash."""
    import pyarrow as pa

    def work(batches):
        import xxhash

        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096).to_pydict()
                rows = [(xxhash.xxh3_64_intdigest(w) - (1 << 63), xxhash.xxh64_intdigest(w) - (1 << 63), d, p + j)
                        for d, p, c in zip(part["doc"], part["first"], part["context"])
                        for j in range(len(c) - LENGTH + 1) for w in (c[j:j + LENGTH],)]
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["w1", "w2", "doc", "p"])
    windows = _written(contexts.select("doc", "first", "context").mapInArrow(work, "w1 bigint, w2 bigint, doc bigint, p bigint"), "suffix-hot")
    lead = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "p")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(lead, ["w1", "w2"]).where(F.struct("doc", "p") > F.col("lead"))
    return later.select("doc", F.col("p").alias("start"), (F.col("p") + LENGTH).alias("end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept) for every row: the removed spans (start, end) and the bytes that stay."""
    import pyarrow as pa

    spark = docs.sparkSession
    bound_batches(spark)
    rows = _keyed(docs, id_col, text_col)
    scan = rows.select("doc", "text")
    often = _written(anchor_counts(scan), "suffix-anchors")
    found = anchor_rows(scan, often).join(often.withColumn("often", F.lit(True)), "h", "left").where("often OR meta < 0").drop("often")
    found = _written(found, "suffix-runs")
    settled = found.where("meta < 0").select("doc", (-1 - F.col("meta")).alias("start"), F.col("c").alias("end"))
    runs = found.where("meta >= 0").select("h", "c", "doc", F.shiftright("meta", 14).alias("first"),
                                           F.shiftright("meta", 7).bitwiseAND(F.lit(127)).alias("run"),
                                           F.col("meta").bitwiseAND(F.lit(127)).alias("place"))
    leads = _written(runs.groupBy("h", "c").agg(F.min(F.struct("doc", "first", "run", "place")).alias("lead"), F.count("*").alias("n")), "suffix-leads")
    copies = (runs.join(leads.where("n > 1").select("h", "c", "lead"), ["h", "c"])
              .where(F.struct("doc", "first") > F.struct("lead.doc", "lead.first"))
              .select("doc", F.col("first").alias("start"), (F.col("first") + F.col("run") + LENGTH).alias("end")))
    per = leads.groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1")
    wanted = leads.join(per, "h").select("h", "lead.doc", "lead.first", "lead.run", "lead.place", (F.col("contexts") > HOT).alias("hot"))
    contexts = _written(_contexts(scan, _written(wanted, "suffix-wanted")), "suffix-contexts")
    spans = settled.unionByName(copies).unionByName(_shard_spans(contexts.where("NOT hot"))).unionByName(_hot_spans(contexts.where("hot")))
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def work(batches):
        for batch in batches:
            out, kept = [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                a = np.array([(s["start"], s["end"]) for s in found or []], np.int64).reshape(-1, 2)
                start, end = (x.tolist() for x in merged(a[:, 0], a[:, 1]))
                out.append([{"start": s, "end": e} for s, e in zip(start, end)])
                kept.append(b"".join(text[s:e] for s, e in zip([0, *end], [*start, len(text)])))
            n = [len(t) for t in batch.column("text").to_pylist()]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(out, span), pa.array(kept, pa.binary())],
                                             names=["id", "n_bytes", "spans", "kept"])

    both = rows.join(spans, "doc", "left").select("id", "text", "spans")
    return both.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
