"""The registered queries and the pipeline over the smallest tables."""

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline


def test_names():
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("table, name", [("documents", n) for n in ("op1_license_scan", "op2_dedup_byte_spans", "op7_quality_classifier", "op8_mix_sources", "op10_exact_dedup")] + [("pages", "op9_html_extract"), ("embeddings", "op3_embedding_dedup")])
def test_a_row_for_each_row(spark, sf_dir, table, name):
    assert entry.queries()[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_pipeline(spark, sf_dir):
    """Each stage against what it is to do, on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns
        seen[name] = docs.toPandas()
    quality = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    kept = set(seen["quality_classifier"]["doc_id"])
    good = set(quality[quality == 1].index)
    assert len(good - kept) <= 0.02 * len(good)
    exact = seen["exact_dedup"]
    want = seen["quality_classifier"].groupby("text")["doc_id"].max()
    assert sorted(exact["doc_id"]) == sorted(want)
    near = seen["ngram_jaccard_join"]
    from test_links import brute

    components = brute(list(zip(exact["doc_id"], exact["text"], strict=True)))[1]
    assert sorted(near["doc_id"]) == sorted(set(components.values()))
    mixed = Counter(seen["mix_sources"]["doc_id"])
    assert set(mixed) <= set(near["doc_id"]) and max(mixed.values()) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert Counter(packed[packed["piece"] == 0]["doc_id"]) == mixed
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096


@pytest.mark.parametrize("name", ["op2_dedup_byte_spans", "op3_embedding_dedup", "op4_jaccard_join", "op6_dedup_word_spans", "op10_exact_dedup"])
def test_equals_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    rel = con.sql(entry.oracle_sql()[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in rel.fetchall())


def test_packed_table(spark, sf_dir):
    """Every document's pieces are there, whole, and no sequence is over its capacity."""
    got = entry.queries()["op5_pack_sequences"](spark, sf_dir).toPandas()
    assert set(got["doc_id"]) == {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert got.groupby("sequence_id")["length"].sum().max() <= 4096
    for _, own in got.groupby("doc_id"):
        own = own.sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own))) and own["start"].tolist() == [4096 * k for k in range(len(own))] and (own["length"][:-1] == 4096).all()
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist()
    assert got["sequence_id"].nunique() <= got["length"].sum() / 4096 + 6
