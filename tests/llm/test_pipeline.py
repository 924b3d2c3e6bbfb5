"""The pipeline and the registered queries."""

import inspect
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pairwright.llm import quality, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = sorted(r for r in rows if brute.quality(r[1])["fail_bits"] == 0)
    texts, gone = brute.line_dedup([r[:2] for r in rows])
    rows = [(r[0], t, *r[2:4], len(t) if n else r[4]) for r, t, n in zip(rows, texts, gone) if not n or n < len(r[1].split("\n"))]
    root, _ = brute.jaccard([r[:2] for r in rows])
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    rows = [r for r in rows if not brute.contamination(r[1], items)[1]]
    _, _, taken = brute.mix([(r[0], r[3], r[1]) for r in rows])
    want = Counter((*r, n) for r, n in zip(rows, taken) if n)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "repeats"]
    assert Counter(map(tuple, got.collect())) == want and len(want) > 50


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def test_clean_documents_pass_the_quality_policy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.apply_policy(quality.measured(docs.join(labels, "doc_id"))).select("quality", "base_failed", "kept").collect()
    good = [r.kept for r in got if r.quality == 1 and not r.base_failed]
    assert all(good) and not any(r.kept for r in got if r.quality == 0)


def test_jaccard_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    root, links = brute.jaccard(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.QUERIES["op2_jaccard_join"](spark, SF).collect()}
    assert got == {d: (rows[root[i]][0], links[i]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(want.select(*[f'"{n}"' for n in names]).fetchall())


def test_registered(spark):
    found = entry.queries()
    assert {"pipeline", *(n for n in found if n.startswith("op"))} == set(queries.QUERIES)
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 14))
