"""The pipeline and its stages."""

from collections import Counter

import pytest

import corpus_pipeline as p
from plantwatch.llm import mixing, ngram_join, queries, secrets
from .test_operators import brute_links, check_sequences, whole_ids


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows after each stage."""
    docs, out = queries.table(spark, sf, "documents"), []
    for name, stage in p.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns(spark, sf, stages):
    columns = queries.table(spark, sf, "documents").columns
    assert [x.columns for x in stages[:-1]] == [columns] * 4


def test_stages_decide(spark, sf, stages):
    raw = queries.table(spark, sf, "documents").toPandas()
    good, single, clean, mixed, packed = (s.toPandas() for s in stages)
    score = queries.op2_quality(spark, sf).toPandas().set_index("doc_id").score
    assert set(good.doc_id) == set(score[score >= 0.3].index) and len(good) < len(raw)
    classes, _ = brute_links(list(zip(good.doc_id, good.text)))
    assert sorted(single.doc_id) == sorted(set(classes.values()))
    keywords = secrets.automaton()
    both = single.merge(clean, on="doc_id", suffixes=("", "_after"))
    assert len(both) == len(single)
    for r in both.itertuples():
        spans = secrets.scan(r.text, keywords)
        assert r.text_after == secrets.redact(r.text, spans) and r.n_chars_after == (len(r.text_after) if spans else r.n_chars)
    rates = mixing.mix(stages[2]).toPandas().set_index("doc_id").copies
    assert Counter(mixed.doc_id) == Counter({d: n for d, n in rates.items() if n})
    assert packed["length"].sum() == sum(map(len, whole_ids(mixed.text)))
    check_sequences(packed)


def test_stages_on_odd_rows(spark, sf, odd, nothing):
    base = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (base, base.limit(0), odd):
        for name, stage in p.STAGES:
            out = stage(spark, rows, sf)
            assert name == "packing" or out.columns == rows.columns
            out.collect()
