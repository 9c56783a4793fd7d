"""The registered queries of the text operators, against SQL or a plain version."""

import os
import zlib

import __spark_entry__ as entry
import brute
import corpus_pipeline
import duckdb
import pytest

from paceframe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_one_query_an_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in QUERIES if n in entry.oracle_sql()])
def test_against_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf_dir, table)}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    result = connection.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, result.fetchall()))


@pytest.mark.parametrize("name", ["op2_temperature_mixing", "op6_license_scan", "op7_quality_rules"])
def test_native_queries_run_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin") if word in plan]


def test_line_dedup(spark, sf_dir, docs):
    expected = brute.removed_lines([(d, r["text"]) for d, r in docs.items()])
    for row in QUERIES["op1_line_dedup"](spark, sf_dir).collect():
        assert [tuple(r) for r in row["removed_lines"]] == expected[row["doc_id"]]
        assert row["n_removed"] == len(expected[row["doc_id"]])


def test_sentencepiece(spark, sf_dir, docs):
    rows = QUERIES["op5_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(docs) and all(r["exact"] and r["n_ids"] == len(r["ids"] or ()) for r in rows)


def test_suffix_dedup(spark, sf_dir, docs):
    expected = dict(zip(docs, brute.without_repeats([r["text"] for r in docs.values()])))
    for r in QUERIES["op8_suffix_dedup"](spark, sf_dir).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]]


def test_language(spark, sf_dir, docs):
    rows = QUERIES["op9_language_id"](spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)


def test_jaccard_join(spark, sf_dir, docs):
    expected = brute.similar_components([(d, r["text"]) for d, r in docs.items()])
    rows = QUERIES["op10_jaccard_join"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected


def test_pipeline_stage_by_stage(spark, sf_dir, docs):
    """Every stage against a plain version on its own input."""
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, table, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert result.columns == columns, name
        rows = [tuple(r) for r in result.collect()]
        outputs.append(rows)
        if result.columns == columns:
            table = spark.createDataFrame(rows, result.schema)
    quality, lines, near, mixed, ids = outputs
    verdicts = {r["doc_id"]: r["kept"] for r in QUERIES["op7_quality_rules"](spark, sf_dir).collect()}
    assert {r[0] for r in quality} == {d for d, kept in verdicts.items() if kept}
    text = columns.index("text")
    gone = brute.removed_lines([(r[0], r[text]) for r in quality])
    for before, after in zip(sorted(quality), sorted(lines)):
        drop = {g[0] for g in gone[before[0]]}
        rest = "\n".join(x for n, x in enumerate(before[text].split("\n")) if n not in drop)
        assert (after[0], after[text]) == (before[0], rest)
    groups = brute.similar_components([(r[0], r[text]) for r in lines])
    assert {r[0] for r in near} == {d for d, (_, component) in groups.items() if d == component}
    assert set(mixed) <= set(near) and len(ids) == len(mixed)
    assert sorted(r[0] for r in ids) == sorted(r[0] for r in mixed)


def test_pipeline_stages_on_odd_rows(spark, sf_dir, odd_docs, repeated_docs, no_docs):
    for docs in (odd_docs, repeated_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, sf_dir)
            rows = result.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert result.columns == docs.columns, name
            else:
                assert rows == docs.count()


def test_run_gives_ids(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r["n_ids"] == len(r["ids"]) for r in rows)


def test_last_stage_decodes(spark, sf_dir, odd_docs, texts, monkeypatch):
    stage = dict(corpus_pipeline.STAGES)["SentencePiece encoding and decoding"]
    assert [r["exact"] for r in stage(spark, odd_docs, sf_dir).collect()] == [True] * len(texts)
    decode = corpus_pipeline.pieces.decode_pieces
    spoiled = lambda df, model: decode(df, model).withColumn("text", corpus_pipeline.F.concat("text", corpus_pipeline.F.lit("x")))
    monkeypatch.setattr(corpus_pipeline.pieces, "decode_pieces", spoiled)
    found = {r["doc_id"]: r["exact"] for r in stage(spark, odd_docs, sf_dir).collect()}
    assert [found[i] for i in range(len(texts))] == [t is None for t in texts]


def test_last_stage_has_one_python_worker_a_task(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a", "some text"), (2, None, None)], "doc_id long, source string, text string")
    found = dict(corpus_pipeline.STAGES)["SentencePiece encoding and decoding"](spark, docs, sf_dir)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r["doc_id"]: (r["n_ids"] > 0, r["exact"]) for r in found.collect()} == {1: (True, True), 2: (False, True)}
