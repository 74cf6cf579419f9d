"""A small corpus with what operators must not stumble over: nulls in every column, empty and
very long texts, ties, repeated rows and extra columns whose names operators use themselves."""

import random

import pytest

SYLLABLES = {"en": "the on er in at of ing and".split(), "fr": "eau oi é ment la que ré un".split(),
             "de": "ich sch der en ung keit ü ein".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def make_rows():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, sentence(rng, lang, rng.randint(5, 60)), lang, f"src{i % 4}"))
    base = rows[3][1] + " " + sentence(rng, "en", 80)
    words = base.split()
    rows += [(100, base, "en", "src0"), (101, base, "en", "src1"), (102, " ".join(words[:40] + ["changed"] + words[41:]), "en", "src1"),
             (103, base.upper(), "en", None), (110, "x " * 30_000, None, "src2"), (111, "a" * 50_000, "en", "src2"), (112, "", "en", "src3"),
             (113, None, None, None), (114, "123 456 !!", "fr", "src3"), (115, "one", "en", "src3"), (116, "two words", None, "src0"),
             (120, "mail a.b@c.example.com and +1 (499) 555-6503 card 4111 1111 1111 1111", "en", "src1"),
             (121, "日本語のテキスト 😀 مرحبا", None, "src1"), (None, "a row without an id", "en", "src2"),
             (130, "repeated row with words in it", "en", "src0"), (130, "repeated row with words in it", "en", "src0"),
             (131, "one id, a first text of some words here", "en", "src0"), (131, "one id, a second text of some words here", "en", "src0")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def make_turns():
    """Sound and broken conversations, a long one, a null one, and rows with nulls, ties and repeats."""
    rng = random.Random(3)
    rows = []
    for c in range(80):
        n = 150 if c == 7 else rng.randint(1, 9)
        for t in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            role = "system" if t == 0 and rng.random() < 0.4 or rng.random() < 0.05 else role
            text = rng.choice(["Yes.", "No?", "so it goes", "", " \t\n", "Done! ", "A.", "B.", "C.", "é. \x0b", f"t{t}.", f"u{rng.random()}!"])
            rows.append((c, t + (t > 4) * rng.randint(0, 1), role, text))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, "system", "First."), (90, None, None, None), (90, 3, "user", None),
             (91, None, "tool", "Out."), (91, 1, "", "Empty role."), (92, 5, "user", "Same."), (92, 5, "user", "Same."), (92, 5, "assistant", "Other."),
             (93, 9, "usurper", "Odd."), (93, 2**40, "admin", "Far.")]
    return rows


TURNS = "conv_id bigint, turn bigint, role string, text string"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_rows():
    return make_rows()


@pytest.fixture(scope="session")
def odd_dir(spark, odd_rows, tmp_path_factory):
    """The corpus as a table folder, with further columns that clash with names used inside."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("odd"))
    extra = {c: F.lit("x") for c in ("id", "key", "n", "spans", "ids", "start", "end", "sketch", "rep", "component", "kept", "taken", "size",
                                     "h", "doc", "meta", "label", "bucket", "pattern", "score", "words", "token_ids")}
    spark.createDataFrame(odd_rows, SCHEMA).repartition(3).withColumns(extra).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], None if i % 7 == 0 else i % 2, None if i % 5 == 0 else int(i % 3 == 0)) for i, r in enumerate(odd_rows)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash")).write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [float((i * j) % 7 - 3) / 4 for j in range(6)], 0) for i in range(0, 300, 5)]
    vectors += [(1000, None, 0), (1001, [0.5, None, 0.1, 0.1, 0.1, 0.1], 0), (1002, [float("nan")] * 6, 0), (1003, [float("inf")] * 6, 0),
                (None, [0.1] * 6, 0), (1100, [0.25] * 6, 0), (1100, [0.25] * 6, 0), (1200, [0.1] * 3, 0), (1201, [], 0), (1202, [0.2, 0.3, -0.4], 0), (1301, [0.5, 0.5, 0.5], 0)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").withColumn("id", F.lit(1)).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame(make_turns(), TURNS).withColumns({c: F.lit("x") for c in ("conv", "key", "first", "copies", "present", "fault", "copy", "seen")}) \
        .repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], TURNS).write.parquet(f"{path}/conversations.parquet")
    return path
