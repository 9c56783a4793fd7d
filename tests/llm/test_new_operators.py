"""Token counts, hard negatives and conversation repair against plain versions."""

import itertools
import random
import unicodedata

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paceframe.llm import conversations, hard_negatives, token_counts
from paceframe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(model):
    tokenizer = Tokenizer.from_str(model)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter(model):
    return token_counts.Counter(model, token_counts.character_classes())


def test_counts_of_the_registered_query(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op11_token_counts"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    expected = dict(zip(docs, library(docs.values())))
    for r in rows:
        n = expected[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((docs[r["doc_id"]] or "").encode()), n, n > 1024)


def test_counts_of_odd_rows(spark, odd_docs, repeated_docs, no_docs, model, library, texts):
    rows = token_counts.count_tokens(odd_docs, model).collect()
    expected = library(texts)
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == dict(enumerate(expected))
    assert set(odd_docs.columns) <= set(rows[0].asDict()) and all(r["row"] == f"row{r['doc_id']}" for r in rows)
    kept = repeated_docs.withColumns({"n_tokens": F.lit("old"), "over_limit": F.lit("old")})
    found = token_counts.count_tokens(kept, model, limit=11).collect()
    texts = [r["text"] for r in repeated_docs.collect()]
    assert sorted(r["n_tokens"] for r in found) == sorted(library(texts))
    assert all(r["over_limit"] == (r["n_tokens"] > 11) for r in found) and len(found) == 6
    assert token_counts.count_tokens(no_docs, model).count() == 0


def test_counts_of_made_texts(counter, library):
    rng = random.Random(3)
    letters = "ab'stremdvl  \n\t!-12é漢字\u0085\xa0　x😀Ᲊ\U000105c0٣²_" + "퟿͸"
    parts = ["<|endoftext|>", "'ll", "'re", "  ", "\r\n", "'", " '", "aaaa", "<|endof"]
    made = ["".join(rng.choice(letters) if rng.random() < 0.9 else rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    assert counter.count(made).tolist() == library(made)


def test_counts_of_long_texts(counter, library, monkeypatch):
    rng = random.Random(4)
    words = "".join(rng.choice("abcdefg") + rng.choice([" ", "", "", ", ", "\n", ".", "'s "]) for _ in range(40_000))
    made = [words, "x" * 30_000, "ab" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "漢字" * 5_000, " " * 9_999, words + "<|endoftext|>" * 3]
    whole = counter.count(made).tolist()
    monkeypatch.setattr(token_counts, "CHARS", 1000)
    monkeypatch.setattr(token_counts, "SYMBOLS", 300)
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    assert counter.count(made).tolist() == whole == library(made)


def test_classes_agree_with_the_library(counter, model):
    """Of a sample of every block of characters, assigned or not."""
    cut = Tokenizer.from_str(model).pre_tokenizer.pre_tokenize_str
    codes = [c for c in range(0, 0x110000, 7) if not 0xD800 <= c <= 0xDFFF and (c < 0x20000 or c % 997 == 0)]
    for c in codes:
        text = "a" + chr(c) + "1" + chr(c) + chr(c) + "!b"
        found = np.array([ord(x) for x in text], dtype="<u4")
        first = np.zeros(len(text), dtype=bool)
        first[0] = True
        assert np.flatnonzero(counter._starts(found, first)).tolist() == [a for _, (a, _) in cut(text)], (hex(c), unicodedata.category(chr(c)))


def test_other_tokenizers_are_refused(spark, no_docs):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file, pytest.raises(ValueError, match="byte-level"):
        token_counts.count_tokens(no_docs, file.read())


VECTORS = "vec_id long, embedding array<double>, label int, q string, anchor string"


def negatives(spark, rows, **sizes):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = spark.createDataFrame([(i, v, k, "x", "y") for i, k, v in rows], VECTORS).withColumn("label", label)
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **sizes).collect()))


def test_negatives_of_the_registered_query(spark, sf_dir):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, sf_dir).collect()))
    assert found and found == brute.hard_negatives(rows)


def clustered(count, width, seed):
    """Vectors of several lengths around a few directions: those of a direction share a label mostly."""
    rng = np.random.default_rng(seed)
    centres = np.eye(width)[rng.integers(0, width, count) % 4] + rng.normal(0, 0.12, (count, width))
    vectors = centres * rng.choice([0.2, 1.0, 3.0], count)[:, None]
    return [(i, int(np.argmax(centres[i])) if rng.random() < 0.6 else int(rng.integers(0, 10)), vectors[i].tolist()) for i in range(count)]


def test_negatives_where_coordinates_prune(spark, monkeypatch):
    rows = clustered(1500, 8, 5)
    expected = brute.hard_negatives(rows)
    monkeypatch.setattr(hard_negatives, "BUCKET", 100)
    assert expected and negatives(spark, rows) == expected
    assert negatives(spark, rows, run_rows=400, group_rows=7) == expected


def test_slices_leave_rows_out():
    """Buckets are verified by slices there, and what slices leave out scores too low."""
    rows = [r for r in clustered(600, 8, 6)]
    q = np.floor(256 * np.array([v for _, _, v in rows]))
    lengths = np.linalg.norm(q, axis=1)
    ids, labels = np.arange(600), np.array([k for _, k, _ in rows])
    bucket = hard_negatives.Bucket(ids, labels, lengths, q, q)
    ends = np.zeros((600, 1))
    anchors = hard_negatives.Anchors(ids, labels, lengths, q, q, ends, ends)
    need = 0.9 * lengths * bucket.longest
    pairs = {(a, r) for x, y, _ in hard_negatives.candidates(anchors, bucket, need) for a, r in zip(x.tolist(), y.tolist())}
    assert pairs == {(a, r) for a, r in zip(*np.nonzero(q @ q.T >= need[:, None]))}
    assert "lists" in vars(bucket)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, i % 3, [float(i % 5), 1.0, -float(i % 2)]) for i in range(120)]
    rows += [(i, i % 3, [1.0, 1.0]) for i in range(150, 170)] + [(200, 1, []), (201, 2, []), (250, 1, [0.0]), (300, 2, [1.0] * 40)]
    rows += [(None, 1, [1.0]), (350, None, [1.0]), (351, 1, None), (400, 1, [nan]), (401, 1, [inf]), (402, 1, [None, 1.0]), (403, 1, [-inf, 1.0])]
    rows += [(50, 2, [2.0, 1.0, 0.0])] * 2 + [(53, 2, [2.0, 1.0, 0.0])] * 3 + [(450, 0, [1.5, 2.25]), (450, 4, [1.5, 2.25])]
    expected = brute.hard_negatives(rows)
    assert expected and negatives(spark, rows) == expected
    assert negatives(spark, rows, run_rows=40, group_rows=2) == expected
    assert negatives(spark, []) == [] and negatives(spark, [(50, 1, [1.0])]) == []


@pytest.mark.parametrize("size", [5e3, 1e6])
def test_negatives_of_large_numbers(spark, size):
    """Scores that 32 or 64 bits of floating point can't hold are exact as well."""
    rng = random.Random(8)
    rows = [(i, i % 4, [size * rng.uniform(-1, 1) for _ in range(3)]) for i in range(0, 400, 5)]
    expected = brute.hard_negatives(rows)
    assert expected and negatives(spark, rows) == expected


TURNS = "conv_id long, turn long, role string, text string, audit string, digest string"


def audited(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(5)
    found = conversations.audits(df).cache()
    digests = {r[0]: r[1] for r in conversations.repaired_digests(df, found).collect()}
    turns = {}
    for r in conversations.repaired(df, found).orderBy("conv_id", "place").collect():
        turns.setdefault(r["conv_id"], []).append(r)
    return {r[0]: (*r[1:], digests[r[0]]) for r in found.collect()}, turns


def in_order(rows):
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], brute.hashlib.sha256(r[3].encode()).digest())
    return {c: [r[1:] for r in sorted(plain, key=order) if r[0] == c] for c in {r[0] for r in plain}}


def test_repair_of_the_registered_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    expected = {(c, *brute.repair(held)) for c, held in brute.damaged_conversations(rows).items()}
    assert set(map(tuple, QUERIES["op13_conversation_repair"](spark, sf_dir).collect())) == expected


def test_damage_of_odd_rows(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, 0, 1, 7, 8, 9, 2**62) for r in ("user", None, "tool") for x in ("A. b! c?", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = sorted(map(repr, map(tuple, conversations.damaged(df).collect())))
    expected = [(c, *r) for c, held in brute.damaged_conversations(rows).items() for r in held]
    assert found == sorted(map(repr, expected))


def test_repair_of_every_short_conversation():
    """All sequences of up to five rows of every kind."""
    kinds = {"u": ("user", "x."), "a": ("assistant", "x."), "s": ("system", "x."), "t": ("tool", "x."), "o": ("user", "x"), "b": ("user", " ")}
    codes = {"u": 0, "a": 1, "s": 2, "t": 3, "o": conversations.TRUNCATED_BIT, "b": conversations.FORCED}
    for n in range(6):
        for found in itertools.product(kinds, repeat=n):
            # Other texts, so that none is a duplicate.
            rows = [(i, kinds[c][0], f"{i}{kinds[c][1]}" if c != "b" else " ") for i, c in enumerate(found)]
            cost, audit = conversations.align(bytes(codes[c] for c in found))
            assert (cost, audit) == brute.repair(rows)[5:7], found


def test_repair_of_long_conversations(monkeypatch):
    rng = random.Random(9)
    for cells in (conversations.CELLS, 200):
        monkeypatch.setattr(conversations, "CELLS", cells)
        for n in (40, 150, 400):
            codes = bytes(rng.choice([k % 2] * 12 + [0, 1, 2, 3, 4, 5, 6, 255]) for k in range(n))
            roles = {0: "user", 1: "assistant", 2: "system", 3: "tool"}
            rows = [(k, roles[c & 3], " " if c == 255 else f"{k}" + "." * (c < 4)) for k, c in enumerate(codes)]
            assert conversations.align(codes) == brute.repair(rows)[5:7]


def test_repair_of_odd_rows(spark):
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, 0, "user", "a."), (1, 1, "assistant", "b"), (1, 2, None, None)]
    rows += [(2, None, "user", "x."), (2, None, "assistant", "y."), (2, 5, "tool", "z!"), (2, 9, "", "w?"), (2, 9, "User", "w?")]
    rows += [(None, 3, "user", "é." + "long " * 100_000 + "."), (None, 4, "assistant", "ok."), (None, 4, "assistant", "also.")]
    rows += [(3, 1, "user", ""), (3, 2, "user", "\t\n\x0b\f\r ")] + [(4, 0, "system", "s.")] + [(5, 0, "user", "q "), (5, -(2**62), "user", "p."), (5, 2**62, "ufo", ".")]
    rows += [(6, k, "user", "same.") for k in range(50)]
    found, turns = audited(spark, rows)
    for conv, held in in_order(rows).items():
        assert found[conv] == brute.repair(held), conv
        # The repaired turns are those of the digest.
        body = "\n".join(f"{t['role']}:{t['text']}" for t in turns.get(conv, []))
        assert found[conv][-1] == brute.hashlib.sha256(body.encode()).hexdigest()
        assert [t["place"] for t in turns.get(conv, [])] == list(range(len(turns.get(conv, []))))
        assert "".join(t["edit"] for t in turns.get(conv, [])) == found[conv][-2].replace("D", "")
    assert audited(spark, []) == ({}, {})
