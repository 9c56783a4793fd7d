"""Each operator against a plain version, on odd rows and on no rows."""

import itertools
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paceframe.llm import (
    exact_dedup,
    graph,
    jaccard_join,
    language_id,
    licenses,
    line_dedup,
    mixing,
    pieces,
    quality_rules,
    shingles,
    suffix_dedup,
    token_files,
)
from paceframe.session import scratch_path


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# Line dedup


def test_the_band_decides_like_the_whole_matrix():
    rng = random.Random(3)
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            place = rng.randint(0, len(b))
            b[place : place + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
        x, y = "".join(a), "".join(b)
        for edits in (1, 2, 3):
            assert line_dedup.within_edits(x, y, edits) == (brute.edit_distance(x, y) <= edits), (x, y)


def test_lines_within_two_edits_share_a_segment():
    rng = random.Random(4)
    for _ in range(2000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(20, 40)))
        b = a
        for _ in range(2):
            place = rng.randrange(len(b))
            b = b[:place] + rng.choice(["", "x", "xy"]) + b[place + rng.randint(0, 1) :]
        if a == b or min(len(a), len(b)) < 20 or brute.edit_distance(a, b) > 2:
            continue
        if len(a) < len(b):
            a, b = b, a
        (keys_a, _, bits_a), (keys_b, probe, bits_b) = (line_dedup.signatures([x]) for x in (a, b))
        assert set(keys_b[0][~probe].tolist()) & set(keys_a[0].tolist()), (a, b)
        assert np.bitwise_count((bits_a ^ bits_b).view(np.uint32))[0] <= 4


def test_line_dedup(odd_docs, texts):
    found = by_id(line_dedup.dedup_lines(odd_docs, report="report"))
    expected = brute.removed_lines(list(enumerate(texts)))
    assert sum(map(len, expected.values())) > 10
    for i, text in enumerate(texts):
        assert [tuple(r) for r in found[i]["report"]] == expected[i], i
        gone = {r[0] for r in expected[i]}
        rest = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
        assert found[i]["text"] == rest
        assert found[i]["removed_lines"] == f"removed_lines{i}"


def test_line_dedup_with_edits_of_every_parity_class(spark):
    """In Spark, where the parities are compared as signed integers."""
    classes = {}
    for c in map(chr, [*range(33, 127), *range(0xC0, 0x180), *range(0x391, 0x450)]):
        classes.setdefault(int(line_dedup.character_bits(np.array([[ord(c)]])).view(np.uint32)[0]), c)
    assert sorted(classes) == [1 << i for i in range(32)]
    rng, rows = random.Random(12), []
    for c in classes.values():
        line = "".join(rng.choice("0123456789 ") for _ in range(30))
        first = f"a{line}b"
        rows += [(len(rows) + i, t) for i, t in enumerate([first, f"a{line[:15]}{c}{line[15:]}b", f"a{line}{c}"])]
    found = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    expected = brute.removed_lines(rows)
    assert sum(map(len, expected.values())) == 64
    assert {i: [tuple(r) for r in found[i]["removed_lines"]] for i, _ in rows} == {i: expected[i] for i, _ in rows}


def test_line_dedup_of_short_lines(spark):
    texts = ["Les.\n a line that is long enough to be near\n\nOf", "a line that is long enough to be nearer\n Les. \nof\n\n", "Les\nOf\nLes.\nOf", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = by_id(line_dedup.dedup_lines(docs))
    removed = [[tuple(r) for r in found[i]["removed_lines"]] for i in range(4)]
    near = [(0, 0, 1, False)]
    assert removed == [[], [*near, (1, 0, 0, True)], [(1, 0, 3, True), (2, 0, 0, True), (3, 0, 3, True)], []]
    assert [found[i]["text"] for i in range(4)] == [texts[0], "of\n\n", "Les", None]
    assert [tuple(r) for r in by_id(line_dedup.dedup_lines(docs, exact_chars=20))[1]["removed_lines"]] == near


def test_signatures_of_several_lines_are_those_of_each():
    rng = random.Random(6)
    lines = ["".join(rng.choice("abé漢😀") for _ in range(31)) for _ in range(9)]
    keys, probe, bits = line_dedup.signatures(lines)
    for line, row, parity in zip(lines, keys, bits):
        alone = line_dedup.signatures([line])
        assert (alone[0][0] == row).all() and alone[2][0] == parity and (alone[1] == probe).all()
    # Equal substrings in their places have equal keys, whatever stands around them.
    other = line_dedup.signatures([lines[0][:15] + "x" * 16])[0][0]
    plan = line_dedup._plan(31)
    assert ((keys[0] == other) == (plan.ends <= 15)).all()


def unlike_words():
    """Two words of 1,024 characters that differ in every place and agree in many polynomial hashes."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_unlike_words_are_not_linked(spark):
    rows = [(i, f"{w} {'tail ' * n}") for n in (0, 2, 6) for i, w in enumerate(unlike_words(), 10 * n)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_copies"]) for r in found} == {i: (i, 1) for i, _ in rows}


def test_words_have_hashes_of_their_own():
    rng = random.Random(2)
    words = {"".join(rng.choice("abé_") for _ in range(rng.choice([1, 7, 8, 9, 16, 63, 64, 65, 200]))) for _ in range(3000)}
    words = [*words, *unlike_words()]
    buffer = np.frombuffer((" ".join(words) + " ").encode(), dtype=np.uint8)
    _, hashes = shingles._word_hashes(buffer)
    assert len(set(hashes.tolist())) == len(words)
    _, upper = shingles._word_hashes(np.frombuffer((" \t".join(words) + "\n").encode().upper(), dtype=np.uint8))
    assert (upper == hashes).all()


def test_line_dedup_of_repeated_rows(repeated_docs):
    rows = line_dedup.dedup_lines(repeated_docs).collect()
    assert sorted((r["doc_id"] or 9, r["text"]) for r in rows if r["text"] is not None) == sorted(
        [(1, "some words that are long enough for a line of text")] * 2 + [(2, ""), (9, "")]
    )


# Mixing


def test_exponent_meets_the_entropy(spark):
    shares = np.array([0.01, 0.04, 0.15, 0.8])
    row = spark.range(1).select(F.array(*[F.lit(float(x)) for x in shares]).alias("p"))
    alpha = row.select(mixing.exponent(F.col("p"), 0.9, 1000.0, 1.0)).first()[0]
    weights = shares**alpha / (shares**alpha).sum()
    assert -(weights * np.log(weights)).sum() == pytest.approx(0.9 * np.log(4), abs=1e-9)
    limited = row.select(mixing.exponent(F.col("p"), 0.9, 3.0, 1.0)).first()[0]
    weights = shares**limited / (shares**limited).sum()
    assert (weights / shares).max() == pytest.approx(3.0, abs=1e-9)


def test_mixing_uses_whole_epochs_and_fits_the_budget(spark):
    rows = [(i, f"s{0 if i < 300 else i % 4}", "w " * (1 + i % 7)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    uses = mixing.mix(docs, entropy_share=0.99, budget_share=1.5).select("doc_id", "source", "mix.*").collect()
    tokens, total = Counter(), Counter()
    for i, source, text in rows:
        tokens[source] += 1 + i % 7
    shares = np.array([tokens[s] for s in sorted(tokens)]) / sum(tokens.values())
    for use in uses:
        total[use["source"]] += use["n_tokens"]
    weights = np.array([total[s] for s in sorted(tokens)]) / sum(total.values())
    assert -(weights * np.log(weights)).sum() > -(shares * np.log(shares)).sum()
    assert sum(total.values()) <= 1.5 * sum(tokens.values())
    assert sum(total.values()) >= 1.5 * sum(tokens.values()) - 7 * len(tokens) - len(tokens)
    counts = Counter((u["doc_id"], u["epoch"]) for u in uses)
    assert set(counts.values()) == {1}
    for source in tokens:
        epochs = total[source] // tokens[source]
        for epoch in range(epochs):
            assert sum(u["source"] == source and u["epoch"] == epoch for u in uses) == sum(r[1] == source for r in rows)


def test_mixing_of_odd_rows(odd_docs, repeated_docs, texts):
    found = mixing.mix(odd_docs, report="use").collect()
    assert {r["doc_id"] for r in found} <= set(range(len(texts)))
    assert all(r["mix"] == f"mix{r['doc_id']}" and r["text"] == texts[r["doc_id"]] for r in found)
    assert mixing.mix(repeated_docs).count() >= 3
    with pytest.raises(ValueError):
        mixing.mix(odd_docs, budget_share=5.0)


# Exact dedup


def test_directory_doubles_until_no_bucket_overflows():
    counts = {0: 50, 1: 1, 9: 30, 15: 2}
    owner = exact_dedup.split_directory(counts, 40, max_depth=4)
    assert len(owner) == 16  # the prefix 0 alone is too full
    assert owner[0] == 0 and owner[9] == owner[8] == owner[15] == 8
    assert exact_dedup.split_directory({}, 40) == [0]


@pytest.mark.parametrize("piece_rows", [2, 4096])
def test_exact_dedup(odd_docs, texts, piece_rows):
    found = exact_dedup.exact_dedup(odd_docs, bucket_keys=3, piece_rows=piece_rows)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(brute.exact_groups(list(enumerate(texts))))


def test_exact_dedup_of_repeated_rows(repeated_docs):
    found = Counter(map(tuple, exact_dedup.exact_dedup(repeated_docs).collect()))
    expected = brute.exact_groups([(r["doc_id"], r["text"]) for r in repeated_docs.collect()])
    assert {k[:3] for k in found} == {e[:3] for e in expected} and sum(found.values()) == 6


def test_texts_that_collide_are_chained():
    import pandas as pd

    rows = [(0, 5, 0, 0, False, i, "s", body, 1, 3, i) for i, body in enumerate("abab")]
    batch = pd.DataFrame(rows, columns=[c.split()[0] for c in exact_dedup.CHAINED.split(", ")])
    out = pd.concat(exact_dedup.chain_entries(iter([batch])))
    assert sorted(zip(out["doc_id"], out["chain"])) == [(0, 0), (1, 1), (2, 0), (3, 1)]
    assert out[out["head"]].sort_values("chain")[["members", "best_id"]].values.tolist() == [[2, 0], [2, 1]]


# Token files


@pytest.fixture(scope="module")
def byte_bpe():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def test_numbers_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        numbers = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (token_files.unpack(*token_files.pack(numbers), n) == numbers).all()


def test_words_have_the_ids_of_the_library(byte_bpe):
    from tokenizers import Tokenizer

    library, encoder, rng = Tokenizer.from_str(byte_bpe), token_files.WordEncoder(byte_bpe), random.Random(5)
    parts = ["a", "bc", " ", "  ", "\n", "\t", "'s", "'", "!", ",", ".", "7", "é", " ", "\x1c", "\x85", "<|endoftext|>", "\0", "日本", "It's."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(5000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, dtype=encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, odd_docs, texts, byte_bpe):
    from tokenizers import Tokenizer

    path = scratch_path(spark, "tokens")
    token_files.write_token_files(odd_docs, path, byte_bpe)
    found = by_id(token_files.read_token_files(spark, path))
    library, start = Tokenizer.from_str(byte_bpe), 0
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (found[i]["start"], found[i]["n_tokens"], zlib.crc32(found[i]["ids"])) == (start, len(ids), zlib.crc32(ids.tobytes())), i
        start += len(ids)


def test_token_files_of_repeated_rows_and_none(spark, repeated_docs, no_docs, byte_bpe):
    for docs, n in ((repeated_docs, 6), (no_docs, 0)):
        path = scratch_path(spark, "tokens")
        token_files.write_token_files(docs, path, byte_bpe)
        rows = token_files.read_token_files(spark, path).orderBy("start").collect()
        assert len(rows) == n
        ends = list(itertools.accumulate(r["n_tokens"] for r in rows))
        assert [r["start"] for r in rows] == [0, *ends][:n]


# Pieces


@pytest.fixture(scope="module")
def piece_model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def cheapest(vocabulary, text):
    """The search over the whole text at once."""
    best, back = [0], [(0, ())]
    for end in range(1, len(text) + 1):
        options = [(best[s] + vocabulary.costs[text[s:end]][0], s, (vocabulary.costs[text[s:end]][1],)) for s in range(end) if text[s:end] in vocabulary.costs]
        if text[end - 1] not in vocabulary.costs:
            data = text[end - 1].encode()
            options.append((best[end - 1] + len(data) * vocabulary.byte_cost, end - 1, tuple(vocabulary.byte_ids[b] for b in data)))
        cost, start, ids = min(options)
        best.append(cost)
        back.append((start, ids))
    out, place = [], len(text)
    while place:
        place, ids = back[place]
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]


def test_the_stream_finds_the_cheapest_pieces(piece_model):
    vocabulary, rng = pieces.Pieces(piece_model), random.Random(6)
    encoder = pieces.Encoder(vocabulary)
    parts = ["a", "the", "ing", " ", "  ", "\n", ",", "...", "é", "日", "\0", "'s", "123", "ß", "!!", "€", "abababab"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        marked = encoder.marked(text)
        expected = cheapest(vocabulary, marked)
        stream, ids = pieces.Stream(vocabulary), []
        for at in range(0, len(marked), 5):
            ids += stream.feed(marked[at : at + 5])
            assert len(stream.text) <= 5 + 4 * vocabulary.longest
        assert ids + stream.finish() == expected == np.frombuffer(encoder.encode(text), dtype=np.int32).tolist(), text
        assert encoder.decode(expected) == text


def test_pieces(odd_docs, texts, piece_model):
    encoded = pieces.encode_pieces(odd_docs, piece_model)
    assert "text" not in encoded.columns and encoded.where("ids is null").count() == sum(t is None for t in texts)
    decoded = by_id(pieces.decode_pieces(encoded, piece_model))
    assert [decoded[i]["text"] for i in range(len(texts))] == texts
    assert all(decoded[i]["row"] == f"row{i}" for i in range(len(texts)))


# Licenses


def test_licenses(spark):
    whole = dict(enumerate(t for _, t in licenses.TEMPLATES))
    rows = [(i, f"some words before\n{t.upper()} and behind") for i, t in whole.items()]
    rows += [(100, None), (101, ""), (102, "no license in this text at all"), (103, "This work is licensed under the GNU General Public Licence, version 3.")]
    rows.append((104, "filler " * 50_000 + whole[0]))
    found = {(r["doc_id"], r["template"]): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((i, i) in found for i in whole) and (104, 0) in found
    assert not [k for k in found if 100 <= k[0] <= 103]
    assert found[0, 0]["n_shared"] == found[0, 0]["n_shingles"] == 1


def test_short_notices(spark):
    texts = ["All rights reserved.", "x y\nALL RIGHTS\nreserved", "all rights are reserved", "rights reserved all", "all rights", None, "", "SPDX-License-Identifier: MIT", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [("A", "All rights reserved."), ("B", "..."), ("C", "one"), ("D", "MIT"), ("E", "identifier mit"), ("F", "SPDX license identifier: MIT")]
    found = sorted((r["doc_id"], r["license"], r["n_shared"], r["n_shingles"]) for r in licenses.scan(docs, own).collect())
    assert found == [(0, "A", 1, 1), (1, "A", 1, 1), (7, "D", 1, 1), (7, "E", 1, 1), (7, "F", 1, 1), (8, "C", 1, 1)]
    whole = {(i, t) for i, (_, t) in enumerate([*licenses.TEMPLATES, *licenses.NOTICES])}
    found = {(r["doc_id"], r["template"]) for r in licenses.scan(spark.createDataFrame(whole, "doc_id long, text string")).collect()}
    assert {(i, i) for i, _ in whole} <= found


# Quality rules


def test_quality_counts(odd_docs, no_labels, texts):
    found = by_id(quality_rules.quality_rules(odd_docs, no_labels))
    for i, text in enumerate(texts):
        counts = brute.quality_counts(text)
        assert tuple(found[i][c] for c in quality_rules.COUNTS) == counts, i
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert found[i]["base_failed"] == failed and found[i]["kept"] == (not failed)


def test_allowed_rejections_are_exact(spark):
    from math import comb

    for n, rate, level in ((50, 0.1, 0.05), (400, 0.02, 0.01), (10, 0.1, 0.01)):
        row = spark.range(1).select(quality_rules._allowed(F.lit(n).cast("long"), rate, F.lit(level)).alias("k"))
        total, k = 0.0, -1
        for i in range(n + 1):
            total += comb(n, i) * rate**i * (1 - rate) ** (n - i)
            if total > level:
                break
            k = i
        assert row.first()["k"] == k


def test_cutoffs_reject_what_labels_call_bad(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(i, clean + f" number{i}", "en") for i in range(3000)] + [(3000 + i, clean + f" {'#$' * (60 + i)}", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(3200)] + [(None, 0), (1, None)], "doc_id long, quality int")
    found = by_id(quality_rules.quality_rules(docs, labels))
    assert all(found[i]["kept"] for i in range(3000)) and not any(found[i]["kept"] for i in range(3000, 3200))
    kept = quality_rules.keep_good(docs.withColumn("counts", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "lang", "counts"] and kept.count() == 3000


# Suffix dedup


def test_suffixes_are_sorted():
    rng = random.Random(8)
    for _ in range(100):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60)))
        buffer, limit = np.frombuffer(data, dtype=np.uint8), np.full(len(data) + 1, len(data))
        starts = rng.sample(range(len(data)), rng.randint(1, len(data)))
        order = suffix_dedup.sort_suffixes(buffer, suffix_dedup.Prefixes(buffer, 0x9E3779B97F4A7C15), limit, np.array(starts))
        assert order.tolist() == sorted(starts, key=lambda i: data[i:])


def test_hashes_that_meet_by_chance_change_nothing(monkeypatch):
    monkeypatch.setattr(suffix_dedup.Prefixes, "of", lambda self, start, end: (end - start).astype(np.uint64))
    a, b = b"x" * 10 + bytes(range(250)), b"y" * 10 + bytes(range(250))
    known = np.array([False, False])
    found = suffix_dedup.repeated_windows([a, b], known)
    covered = [{k for first, n in runs for k in range(first, first + n)} for runs in found]
    assert covered == [set(range(10, 61))] * 2


@pytest.mark.parametrize("stretches", [5000, 1])
def test_suffix_dedup(odd_docs, texts, stretches, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCHES", stretches)
    found = by_id(suffix_dedup.remove_repeats(odd_docs))
    for i, expected in enumerate(brute.without_repeats(texts)):
        assert tuple(found[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == expected, i


# Language


def test_language(spark):
    rng = random.Random(9)
    kinds = {"aa": ["ab", "cad", "bra"], "bb": ["xyz", "zzy", "yx"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(30)), k) for i in range(200) for k in [("aa", "bb")[i % 2]]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !", "aa"), (1003, "xyz yx", None), (None, "xyz yx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = by_id(language_id.identify(docs))
    assert all(found[i]["lang_pred"] == k for i, _, k in rows[:200])
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "bb", "bb"]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())


def test_language_of_texts_beyond_the_bound(spark):
    """The only texts of aa are longer than the bound, of which dd's have null ids."""
    rows = [(i, "ab cad bra " * 100, "aa") for i in (1, 2)] + [(i, "xyz zzy yx", "bb") for i in range(10, 40)]
    rows += [(None, "mno pqr " * 200 + str(i), "dd") for i in range(3)]
    rows += [(i, text, None) for i, text in ((101, "bra ab cad"), (102, "yx xyz"), (103, "pqr mno"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = by_id(language_id.identify(docs, train_bytes=300))
    assert [found[i]["lang_pred"] for i in (1, 2, 101, 102, 103)] == ["aa", "aa", "aa", "bb", "dd"]


def test_every_language_is_learned(spark, monkeypatch):
    letters = [chr(0x4E00 + 40 * k) + chr(0x4E01 + 40 * k) for k in range(70)]
    rows = [(i, letters[i % 70] * (9 if i < 350 else 2), f"l{i % 70:02}") for i in range(420)] + [(999, None, "l69"), (None, letters[69], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = by_id(language_id.identify(docs))
    assert [found[i]["lang_pred"] for i in range(420)] == [r[2] for r in rows[:420]]
    assert (found[999]["lang_pred"], found[999]["score"], found[None]["lang_pred"]) == ("und", 0, "l69")
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 100)
    whole = by_id(language_id.identify(docs))
    assert all(whole[i]["lang_pred"] == r["lang_pred"] and whole[i]["score"] == pytest.approx(r["score"], rel=1e-4) for i, r in found.items())


def test_code_lengths_of_the_tree():
    def counts(text):
        out = []
        for order in range(language_id.ORDER + 1):
            found, n = np.unique(language_id.strings([text], order), return_counts=True)
            out.append((found, n.astype(float)))
        return out

    trees = language_id.Trees([counts(b"abababac"), counts(b"cccc")], ["x", "y"])
    # "b" after "aba" was seen twice of three times, with two kinds of symbols.
    assert trees.costs(np.array([0x61626162], dtype=np.uint32))[0, 0] == pytest.approx(np.log2(5 / 2))
    # "z" is known nowhere: escapes down to the uniform byte.
    steps = [np.log2(5 / 2), np.log2(5 / 2), np.log2(6 / 2), np.log2(11 / 3), 8]
    assert trees.costs(np.array([0x6162617A], dtype=np.uint32))[0, 0] == pytest.approx(sum(steps))


def plain_code_length(seen, text):
    """Bits of a text by prediction by partial matching, byte by byte with dicts."""
    def counted(order):
        counts = {}
        for t in seen:
            padded = b"\0" * language_id.ORDER + t
            for end in range(language_id.ORDER, len(padded)):
                followers = counts.setdefault(padded[end - order : end], {})
                followers[padded[end]] = followers.get(padded[end], 0) + 1
        return counts

    trees = [counted(order) for order in range(language_id.ORDER + 1)]
    bits, padded = 0.0, b"\0" * language_id.ORDER + text
    for end in range(language_id.ORDER, len(padded)):
        for order in range(language_id.ORDER, -1, -1):
            followers = trees[order].get(padded[end - order : end], {})
            whole = sum(followers.values()) + len(followers)
            if padded[end] in followers:
                bits += np.log2(whole / followers[padded[end]])
                break
            if followers:
                bits += np.log2(whole / len(followers))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("cells", [1, 2, 7, 40, 1 << 22])
def test_code_lengths_equal_plain_ones_however_texts_are_cut(monkeypatch, cells):
    rng = random.Random(11)

    def text(letters, size):
        return "".join(rng.choices(letters, k=size)).encode()

    learned = [[text("abc d", 60) for _ in range(3)], [text("cdé\n", 50), b"", b"z"]]
    counts = []
    for seen in learned:
        found = [np.unique(language_id.strings(seen, order), return_counts=True) for order in range(language_id.ORDER + 1)]
        counts.append([(k, n.astype(float)) for k, n in found])
    trees = language_id.Trees(counts, ["x", "y"])
    texts = [b"", b"a", text("abcdé q", 200), b"", text("cd", 3), text("xyz", 41), b"\0\0a", b""]
    monkeypatch.setattr(language_id, "CHUNK_CELLS", cells)
    wanted = [[plain_code_length(seen, t) for seen in learned] for t in texts]
    np.testing.assert_allclose(trees.lengths(texts), wanted, rtol=1e-5)
    np.testing.assert_array_equal(trees.lengths(texts), np.vstack([trees.lengths([t]) for t in texts]))


def test_language_of_no_rows_and_without_labels(no_docs, odd_docs, texts):
    assert language_id.identify(no_docs).count() == 0
    rows = language_id.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(rows) == len(texts) and {r["lang_pred"] for r in rows} == {"und"}


# Jaccard join


def test_components(spark):
    rng = random.Random(10)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 400)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    parent = {n: n for pair in links for n in pair}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert found == {n: root(n) for n in linked}


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(11)
    for n, m in ((3, 5), (50, 60), (0, 4), (1000, 900)):
        pool = rng.integers(0, 2**63, 2000).astype(np.uint64)
        x, y = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, m))
        bound = jaccard_join.least_difference(jaccard_join.parity_bits(x), jaccard_join.parity_bits(y))
        assert bound <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("rounds", [0, 4])
def test_jaccard_join(odd_docs, texts, rounds, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    found = by_id(jaccard_join.jaccard_components(odd_docs))
    expected = brute.similar_components(list(enumerate(texts)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == expected


def test_jaccard_product_of_a_group_that_is_not_alike_enough(spark, monkeypatch):
    """Documents made from one text that all differ too much: few of their pairs leave the product."""
    rng = random.Random(4)
    base = [f"word{i}" for i in range(150)]
    texts = []
    for i in range(60):
        changed = list(base)
        for k in rng.sample(range(150), 3):
            changed[k] = f"other{i}x{k}"
        texts.append(" ".join(changed))
    counts = []
    product = jaccard_join._cross_pairs
    monkeypatch.setattr(jaccard_join, "_cross_pairs", lambda rows: counts.append(product(rows).count()) or product(rows))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = by_id(jaccard_join.jaccard_components(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute.similar_components(list(enumerate(texts)))
    assert counts[0] <= 60  # of 1,770


def test_postings_met_in_any_batches():
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"gram": np.sort(rng.integers(0, 12, 60)), "doc_id": rng.integers(0, 25, 60), "n": rng.integers(8, 11, 60), "place": 1})
    rows["c"] = rows["doc_id"] // 8
    mixed = rows[rows.groupby("gram")["c"].transform("nunique") > 1]

    def run(size):
        found = pd.concat(jaccard_join.met(iter([rows[at : at + size] for at in range(0, 60, size)])))
        pairs = found[found["partner"].notna()]
        return found[found["partner"].isna()][["gram", "doc_id", "n"]], Counter(zip(pairs["doc_id"], pairs["partner"]))

    whole = run(60)
    for size in (1, 7, 59):
        kept, pairs = run(size)
        assert pairs == whole[1] and not Counter(map(tuple, mixed[["gram", "doc_id", "n"]].to_numpy())) - Counter(map(tuple, kept.to_numpy()))


def test_jaccard_join_of_repeated_rows(repeated_docs):
    found = Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(repeated_docs).collect())
    assert found[(1, 1)] == 2 and found[(None, None)] == 2 and found[(3, 3)] == 1


def test_operators_on_no_rows(no_docs, no_labels):
    assert line_dedup.dedup_lines(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert quality_rules.quality_rules(no_docs, no_labels).count() == 0
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert jaccard_join.jaccard_components(no_docs).count() == 0
    assert licenses.scan(no_docs).count() == 0


@pytest.mark.parametrize("run", [licenses.scan, suffix_dedup.remove_repeats, language_id.identify, mixing.mix])
def test_operators_on_repeated_rows(repeated_docs, run):
    assert run(repeated_docs).count() >= 0
