"""The pipeline stage by stage, and the registered queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rategrid.llm import pieces
from rategrid.llm.queries import QUERIES, SQL
from rategrid.sources.io import stage
from tools.check_oracle import canon

from .data import SF, documents, frame
from .test_pii import brute as personal_spans
from .test_simhash import brute_components, brute_fingerprint


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "known_language", "near_dedup", "personal_data", "source_mix", "segmentation"]


def test_stages_on_odd_documents(spark):
    docs = frame(spark, extra=True)
    columns, n = docs.columns, []
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        docs = f(spark, docs, SF)
        if i < 4:
            assert docs.columns == columns
            docs = stage(docs, name)
        n.append(docs.count())
    assert n[0] >= 60 and n[1] <= n[0] and n[2] == n[1]
    assert docs.where("NOT round_trip").count() == 0


def test_stages_on_an_empty_table(spark):
    docs = frame(spark, [])
    for _, f in corpus_pipeline.STAGES:
        docs = stage(f(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_run_against_brute_force(spark):
    """Whole run on the smallest table: documents of known languages, one per
    component, redacted, mixed to the targets, and segmented."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.orderBy("doc_id").collect()]
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components([r[0] for r in rows], fps)
    left = [r for r, c in zip(rows, comp) if r[0] == c]
    clean = []
    for i, t, *rest in left:
        out, at = "", 0
        for kind, a, b in sorted(personal_spans(t), key=lambda x: (x[1], x[2])):
            if a >= at:
                out += t[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        clean.append((i, out + t[at:], *rest))
    from .test_mixing import brute as mixed

    taken = {d: t for d, _, _, _, t in mixed(clean)}
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["doc_id"] for r in got} == {d for d, t in taken.items() if t}
    size = {r[0]: len(r[1].split()) for r in clean}
    for r in got:
        assert r["n"] == -(-taken[r["doc_id"]] // size[r["doc_id"]])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    res = con.execute(SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()], 12) == canon(cols, res.fetchall(), 12)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_whole_table(spark, name):
    df = QUERIES[name](spark, SF)
    n_vectors = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    n = {"op1_topk": 50, "op5_warc": 50, "op11_whitening": 4 * n_vectors, "op13_codes": n_vectors}.get(name, 200)
    # a document may give several pieces
    assert (df.select("doc_id").distinct().count() if name == "op12_packing" else df.count()) == n


def test_documents_fixture_has_a_null_in_every_column():
    assert all(any(r[i] is None for r in documents()) for i in range(5))


def test_default_model_file_is_a_parameter(spark):
    path = pieces.default_model()
    assert pieces.segment(frame(spark, documents()[:3]), model=path).count() == 3
