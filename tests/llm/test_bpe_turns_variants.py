"""BPE on padded matrices against the library; conversation repair and spelling variants against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from aerolens.llm import conversations as cv, padded_bpe as pb, variants as va
from aerolens.llm.queries import QUERIES
from tests.llm.conftest import TURNS, make_turns

# ---------------------------------------------------------------- 11: BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(32, 127), 0xE9, 0x1C, 0x1F, 0x85, 0xA0, 0x200B, 0x3000, 0x4E2D, 0x6587, 0x1F600, 0x430, 0x431, 9, 10, 13]]
    texts = ["".join(rng.choices(pool, k=rng.randrange(0, 60))) for _ in range(800)]
    texts += ["a" * n for n in (1, 2, 3, 511, 512, 513, 2000)] + ["ab" * 900, "aab" * 700, " " * 1500 + "x", "\n" * 900, "é" * 900, "<|endoftext|>"]
    texts += ["".join(rng.choices(letters, k=n)) for letters in ("abcdeinorst", "中文字日本語国人的一是") for n in (100, 513, 4000)]
    return texts


def test_padded_bpe_equals_the_library(library):
    path, pattern, enc = library
    encoder, texts = pb.Encoder(pb.load_ranks(path), pattern), odd_texts()
    ids, starts = encoder.encode(texts)
    assert [ids[a:z].tolist() for a, z in zip(starts, starts[1:])] == [enc.encode_ordinary(t) for t in texts]
    raw, ends = encoder.decode(ids, starts)
    assert [raw[a:z].tobytes() for a, z in zip(ends, ends[1:])] == [t.encode() for t in texts]


def test_padded_bpe_forgets_and_cuts_long_texts(library, monkeypatch):
    path, pattern, enc = library
    monkeypatch.setattr(pb, "MEMO_BYTES", 50)
    monkeypatch.setattr(pb, "PIECES", 40)
    monkeypatch.setattr(pb, "CELLS", 64)
    encoder, texts = pb.Encoder(pb.load_ranks(path), pattern), odd_texts()[::5]
    ids, starts = encoder.encode(texts)
    assert [ids[a:z].tolist() for a, z in zip(starts, starts[1:])] == [enc.encode_ordinary(t) for t in texts]


def test_a_merge_that_makes_a_lower_rank_goes_first():
    """Ranks in which merging one pair makes a pair of lower rank: all at once must give what one by one gives."""
    tokens = [bytes([b]) for b in range(256)] + [b"abx", b"xab", b"ab", b"ba", b"abab", b"xabx", b"bx"]
    lookup = {t: i for i, t in enumerate(tokens)}
    pairs = [(lookup[t[:s]], lookup[t[s:]], i) for t, i in lookup.items() for s in range(1, len(t)) if t[:s] in lookup and t[s:] in lookup]
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".tiktoken") as f:
        f.write("".join(f"{base64.b64encode(t).decode()} {i}\n" for t, i in lookup.items()))
        f.flush()
        ranks = pb.load_ranks(f.name)
    ranked = {(a, b): i for a, b, i in pairs}
    rng = random.Random(1)
    for _ in range(300):
        raw = "".join(rng.choices("abx", k=rng.randint(2, 40))).encode()
        ids = list(raw)
        while True:
            best = min(((ranked[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in ranked), default=None)
            if best is None:
                break
            ids[best[1]:best[1] + 2] = [best[0]]
        start = np.frombuffer(raw, np.uint8).astype(np.int32)
        assert np.frombuffer(pb.merge_wide(start.copy(), ranks), np.int32).tolist() == ids
        assert np.frombuffer(pb.merge_rows(start[None, :].copy(), ranks)[0], np.int32).tolist() == ids


def test_op11_on_odd_rows_and_empty(spark, odd_dir, odd_rows, empty_dir, library):
    enc = library[2]
    got = QUERIES["op11_padded_bpe"](spark, odd_dir).collect()

    def want(i, t):
        ids = enc.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(map(str, map(tuple, got))) == sorted(str(want(r[0], r[1])) for r in odd_rows)
    assert QUERIES["op11_padded_bpe"](spark, empty_dir).count() == 0


# ---------------------------------------------------------------- 12: conversations


def py_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def py_repair(rows):
    """The contract by dynamic programming over (cost, audit, lines), forward, one row after the other."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
    seen, faults, kinds = set(), [], [r[2][:1] for r in rows]
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    stats = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
             sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:])))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(states):
        best = dict(states)
        for st, (c, a, x) in states.items():
            for _ in range(2):
                st = after[st]
                c, a, x = c + 5, a + "I", x + (f"{names[st]}:",)
                best[st] = min(best.get(st, (1 << 60,)), (c, a, x))
        return best
    states = {"": (0, "", ())}
    for (_, _, role, text), fault, kind in zip(rows, faults, kinds):
        new = {}

        def offer(st, way):
            new[st] = min(new.get(st, (1 << 60,)), way)
        for st, (c, a, x) in inserted(states).items():
            offer(st, (c + 2, a + "D", x))
            if fault in ("blank", "duplicate"):
                continue
            c += 5 * (fault == "truncated")
            if kind == after[st] or kind == "s" and st == "":
                offer(kind, (c, a + "K", x + (f"{role}:{text}",)))
            offer(after[st], (c + 1, a + "R", x + (f"{names[after[st]]}:{text}",)))
        states = new
    cost, audit, lines = min(v for st, v in inserted(states).items() if st in ("", "a"))
    return (*stats, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_conv(rows, ids):
    out = {i: [] for i in ids}
    for r in rows:
        out[r[0]].append(r)
    return {i: py_repair(r) for i, r in out.items()}


def test_auction_equals_dynamic_programming():
    rng = random.Random(2)
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for n in range(400):
        kinds = "".join(rng.choices("DsuaxSUAXuauaua", k=rng.randint(0, 14)))
        rows = [(0, i, role.get(k.lower(), "user"), "" if k == "D" else f"{i}" if k.isupper() else f"{i}.") for i, k in enumerate(kinds)]
        assert cv.whole(kinds) == py_repair(rows)[5:7], kinds


def test_segments_give_what_one_lattice_gives(monkeypatch):
    rng = random.Random(4)
    cases = ["".join(rng.choices("DsuaxSUAXuauaua", k=rng.randint(0, 40))) for _ in range(150)]
    want = [cv.whole(k) for k in cases]
    for size in (1, 2, 5):
        monkeypatch.setattr(cv, "SEGMENT", size)
        assert [cv.whole(k) for k in cases] == want


@pytest.mark.parametrize("limits", [None, (3, 4), (2, 7)])
def test_op12_on_odd_rows(spark, odd_dir, monkeypatch, limits):
    """With small limits nearly every conversation is cut into segments and put together again."""
    if limits:
        monkeypatch.setattr(cv, "SEGMENT", limits[0])
        monkeypatch.setattr(cv, "HOLD_ROWS", limits[1])
    rows = make_turns()
    got = QUERIES["op12_conversations"](spark, odd_dir).collect()
    want = by_conv(py_damage(rows), {r[0] for r in rows})
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_repair_returns_the_turns_and_reads_any_column_names(spark):
    rows = [(i % 7, t, r, x) for i, (_, t, r, x) in enumerate(make_turns())]
    rows = [(c, t, r or " ", " " if x is None else x) for c, t, r, x in rows]
    d = spark.createDataFrame(rows, TURNS).toDF("key", "first", "pid", "seen").repartition(5)
    want = by_conv(rows, range(7))
    for r in cv.repair(d, "key", "first", "pid", "seen", texts=True).collect():
        assert tuple(r)[1:9] == want[r.key]
        lines = "\n".join(f"{x.role}:{x.text}" for x in r.repaired)
        assert hashlib.sha256(lines.encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[:1] for x in r.repaired))


def test_op12_empty(spark, empty_dir):
    assert QUERIES["op12_conversations"](spark, empty_dir).count() == 0


# ---------------------------------------------------------------- 13: variants


def py_variants(rows, misspell, factor=5):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            at = h % len(w)
            count[w[:at] + w[at + 1:] if misspell and h % misspell == 0 else w] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    out, form = {}, {}
    for w in n:
        ns = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form[w] = ns[0] if ns and n[ns[0]] >= factor * n[w] else None
        out[w] = (len(ns), form[w])
    result = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        result.append((w, form[w], root, n[w], out[w][0], n.get(form[w])))
    return sorted(result)


def variant_rows():
    rng = random.Random(6)
    roots = ["garden", "gardens", "Straße", "naïveté", "aaaaaa", "window", "x" * 70, "élèves"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(40):
            w = rng.choices(roots, weights=[60, 8, 5, 5, 9, 30, 6, 6])[0]
            if rng.random() < 0.25:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("aeÿÀ") + w[k:], w[:k] + rng.choice("aeÿÀ") + w[k + 1:]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((None if i % 50 == 0 else i // 2, rng.choice([" ", "-", ", "]).join(words)))
    return rows + [(1, None), (2, ""), (None, "   ")]


@pytest.mark.parametrize("blocks", [va.PASS_BLOCKS, 2])
def test_variants_equal_brute_force(spark, blocks):
    """With two blocks at once the filters are probed in many passes."""
    rows = variant_rows()
    docs = spark.createDataFrame(rows, "n bigint, word string").repartition(4)
    got = va.group_variants(va.count_words(docs, "n", "word", misspell=19), pass_blocks=blocks).collect()
    want = py_variants(rows, 19)
    assert len(want) > 100 and sum(r[1] is not None and r[2] != r[1] for r in want) > 0
    assert sorted(map(tuple, got)) == want


def test_op13_on_odd_rows_and_empty(spark, odd_dir, odd_rows, empty_dir):
    got = QUERIES["op13_variants"](spark, odd_dir).collect()
    assert sorted(map(tuple, got)) == py_variants([(r[0], r[1]) for r in odd_rows], 199)
    assert QUERIES["op13_variants"](spark, empty_dir).count() == 0


def test_every_edit_comes_up_once():
    letters = np.frombuffer("aabbéz".encode("latin-1"), np.uint8).reshape(1, -1)
    alphabet = np.frombuffer("abz\xe9".encode("latin-1"), np.uint8)
    made = []
    for delete in (True, False):
        for row, at, new, poly in va.edits(letters, np.sort(alphabet), delete, not delete):
            for k, c, h in zip(at.tolist(), new.tolist(), poly.tolist()):
                w = letters[0].tobytes()[:k] + (b"" if c < 0 else bytes([c])) + letters[0].tobytes()[k + 1:]
                assert int(va.hashes(np.frombuffer(w, np.uint8).reshape(1, -1))[0]) == h
                made.append(w)
    assert len(made) == len(set(made)) and len([w for w in made if len(w) == 5]) == 4
