"""Fingerprints, personal data and mixing: the operators that are Column expressions or small plans."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from aerolens.llm import fingerprint as fp, mixing, pii
from aerolens.llm.queries import QUERIES


def py_sketch(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    sh = {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in sh})[:fp.K]


def test_fingerprints_of_odd_rows(spark, odd_dir, odd_rows):
    got = QUERIES["op1_fingerprints"](spark, odd_dir).collect()
    assert len(got) == len(odd_rows)
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = []
    for r, nxt in zip(order, [*order[1:], order[0]]):
        t, n = r[1] or "", nxt[1] or ""
        ed = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        want.append((r[0], len(t), hashlib.sha256(ed.encode()).hexdigest(), ",".join(py_sketch(t)), ",".join(py_sketch(ed))))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted([tuple(g)[:5] for g in got], key=key) == sorted(want, key=key)
    assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)


def test_sketches_merge_and_estimate(spark):
    a, b = " ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(450, 1350))
    df = spark.createDataFrame([("g", a), ("g", b), ("h", ""), ("h", None)], "g string, t string").withColumn("s", fp.sketch(F.col("t")))
    merged = {r.g: r.s for r in fp.merge_by(df, ["g"], "s").collect()}
    both = {" ".join(w[i:i + 5]) for w in (a.split(), b.split()) for i in range(len(w) - 4)}
    assert merged["g"] == sorted(hashlib.md5(s.encode()).hexdigest()[:16] for s in both)[:fp.K]
    assert merged["h"] == []
    one = (df.where("g = 'g'").agg(F.min("t").alias("x"), F.max("t").alias("y"))
           .select(fp.sketch(F.col("x")).alias("x"), fp.sketch(F.col("y")).alias("y"))
           .select(fp.resemblance(F.col("x"), F.col("y")).alias("j"), fp.containment(F.col("x"), F.col("y")).alias("c"),
                   fp.distinct_shingles(F.col("x")).alias("n")).first())
    assert abs(one.j - 446 / 1346) < 0.12 and abs(one.c - 446 / 896) < 0.15 and abs(one.n - 896) < 200


def test_pii_checks(spark):
    rows = [("x 4111 1111 1111 1111 y",), ("x 4111 1111 1111 1112 y",), ("ip 1.2.3.255 and 1.2.3.256",), ("DE89 3704 0044 0532 0130 00 ok",),
            ("DE89 3704 0044 0532 0130 01 ok",), ("a@b.com_x@y.org z@q",), ("call 555-123-4567",), ("see 555-123-4567",), ("",), (None,)]
    df = pii.find_spans(spark.createDataFrame(rows, "text string")).withColumn("masked", pii.mask(F.col("text")))
    got = [([(s.kind, s.start, s.end) for s in r.spans], r.masked) for r in df.collect()]
    assert got[0] == ([("card", 2, 21)], "x <CARD> y")
    assert got[1] == ([], rows[1][0])
    assert got[2] == ([("ip", 3, 12)], "ip <IP> and 1.2.3.256")
    assert got[3] == ([("iban", 0, 27)], "<IBAN> ok")
    assert got[4] == ([], rows[4][0])
    assert got[5] == ([("email", 0, 7), ("email", 7, 15)], "<EMAIL><EMAIL> z@q")
    assert got[6][0] == [("phone_local", 5, 17)] and got[7][0] == []
    assert got[8] == ([], "") and got[9] == ([], None)


def test_pii_many_spans_and_long_runs(spark):
    text = " ".join(f"u{i}@h{i}.org" for i in range(3000))
    rows = [(1, text), (2, "a" * 300_000), (3, "1" * 300_000), (4, "a@" + "b." * 100_000)]
    got = {r.i: r.spans for r in pii.find_spans(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert [(s.start, s.end) for s in got[1]] == [m.span() for m in re.finditer(r"\S+", text)]
    assert got[2] == [] and got[3] == []


def py_masked(text, spans):
    """The text with the (kind, start, end) of ``spans`` replaced, overlapping ones as one."""
    out, at = "", 0
    spans = sorted(spans, key=lambda s: s[1])
    while spans:
        group, stop = [spans.pop(0)], 0
        stop = group[0][2]
        while spans and spans[0][1] < stop:
            group.append(spans.pop(0))
            stop = max(stop, group[-1][2])
        names = [k.name for k in pii.KINDS]
        name = min(group, key=lambda s: (s[1] - s[2], names.index(s[0])))[0]
        out, at = out + text[at:group[0][1]] + f"<{name.upper()}>", stop
    return out + text[at:]


def test_pii_masks_overlapping_spans_as_one(spark):
    rows = [("Tel +33.1.23.45.67.89",), ("+33 1.23.45.67.89 é",), ("1.2.3.44 111111111111111",), ("😀 +33.1.23.45.67.89 and a@b.com_x@y.org, 1.2.3.4",),
            (" ".join(f"é{i}@h{i}.org +33.1.23.{i % 256}.67.89" for i in range(400)),)]
    base = tuple(k for k in pii.KINDS if k.base or k.check == "mod97")
    df = spark.createDataFrame(rows, "text string").select("text", pii.spans(F.col("text"), base).alias("spans"), pii.mask(F.col("text"), base).alias("masked"))
    got = df.collect()
    assert [r.masked for r in got[:2]] == ["Tel <PHONE>", "<PHONE> é"]
    assert got[3].masked == "😀 <PHONE> and <EMAIL><EMAIL>, <IP>"
    assert all(r.masked == py_masked(r.text, [(s.kind, s.start, s.end) for s in r.spans]) for r in got)


def test_pii_masks_every_span_that_is_found(spark, odd_rows):
    rows = [("call 555-123-4567",), ("see 555-123-4567",), ("Visa card 378282246310005",), ("number 378282246310005",),
            ("tel +1 (499) 555-6503, DE89 3704 0044 0532 0130 00",), *[(r[1],) for r in odd_rows]]
    df = pii.find_spans(spark.createDataFrame(rows, "text string")).withColumn("masked", pii.mask(F.col("text")))
    got = df.collect()
    assert [r.masked for r in got[:5]] == ["call <PHONE_LOCAL>", rows[1][0], "Visa card <CARD_SHORT>", rows[3][0], "tel <PHONE>, <IBAN>"]
    assert all(r.masked == (r.text and py_masked(r.text, [(s.kind, s.start, s.end) for s in r.spans])) for r in got)


def test_personal_data_stage_masks_what_op9_reports(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    told = {}
    for r in QUERIES["op9_pii"](spark, sf).collect():
        told.setdefault(r.doc_id, []).append([(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)])
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert all(len(told[i]) == 1 for i in texts) and any(s[0][0] for s in told.values() if s[0])
    for r in cp.personal_data(spark, docs, sf).collect():
        text = texts[r.doc_id][0]
        assert r.text == (text and py_masked(text, told[r.doc_id][0]))


def test_pii_of_odd_rows(spark, odd_dir, odd_rows):
    got = QUERIES["op9_pii"](spark, odd_dir).collect()
    assert len(got) == len(odd_rows)
    row = next(r for r in got if r.doc_id == 120)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 0, 1, 1)


def test_water_fill():
    assert mixing.water_fill([10, 10], [1, 1], 100) == [10.0, 10.0]
    assert mixing.water_fill([100, 100], [3, 1], 40) == [30.0, 10.0]
    assert mixing.water_fill([10, 100], [3, 1], 40) == [10.0, 30.0]


def test_flow_prefers_first_repetitions_and_shares_overlaps():
    offers = {"a": 10, "ab": 10, "b": 10}
    members = {"a": ["A"], "ab": ["A", "B"], "b": ["B"]}
    flow = mixing.min_cost_flow(offers, members, {"A": 20, "B": 10}, 2)
    assert sum(flow.values()) == 30
    assert all(r == 0 for _, _, r in flow)  # 30 words at cost 0 are enough
    flow = mixing.min_cost_flow(offers, members, {"A": 60, "B": 0}, 2)
    assert sum(flow.values()) == 40 and flow["a", "A", 1] == 10 and flow["ab", "A", 1] == 10


def test_mix_of_odd_rows(spark, odd_dir, odd_rows):
    got = QUERIES["op4_mixing"](spark, odd_dir).collect()
    again = QUERIES["op4_mixing"](spark, odd_dir).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(odd_rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), t in by.items():
        assert abs(sum(t) - target) <= 2 and target <= 2 * size


def test_mix_with_overlapping_sources(spark):
    rows = [(i, "w " * (i % 9 + 1), ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"]) for i in range(300)]
    df = spark.createDataFrame(rows, "i bigint, t string, s array<string>")
    prep = mixing.prepare(df, F.col("i"), F.col("t"), F.col("s"))
    mix = mixing.plan_mix(prep)
    got = mixing.taken(prep, mix).groupBy("_mix.pattern").agg(F.sum("taken").alias("n")).collect()
    routed = {}
    for (p, _), n in mix.routed.items():
        routed[p] = routed.get(p, 0) + n
    assert {r.pattern: r.n for r in got} == routed


@pytest.mark.parametrize("name", ["op1_fingerprints", "op4_mixing", "op9_pii"])
def test_empty_table(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_native_plans_hold_no_python(spark, odd_dir):
    for name in ("op1_fingerprints", "op9_pii"):
        plan = QUERIES[name](spark, odd_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_one_context_word_serves_a_list_of_numbers(spark):
    """Windows are of the whole text: other proposals in between do not cut them off."""
    texts = ["call 555-123-4567 or 555-765-4321", "Visa valid 10/27, number 4222222222222", "555-123-4567, 555-765-4321 by phone",
             "12 34 call 1 2 3 4 5 6 7 555-123-4567", "555-123-4567 " + "x" * 60 + " call", "call " + "7 " * 30 + ". 555-123-4567"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    from tests.llm.test_pipeline import py_spans

    for r in pii.find_spans(d).collect():
        got = sorted((s.start, s.end, [k.name for k in pii.KINDS].index(s.kind)) for s in r.spans)
        assert got == py_spans(r.text), r.text
    assert [len(r.spans) for r in pii.find_spans(d).orderBy("doc_id").collect()][:3] == [2, 1, 2]
