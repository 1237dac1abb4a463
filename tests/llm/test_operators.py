"""Operators against brute force, SQL and exact round trips."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import difference, duck
from plantwatch.llm import (components, language_id, line_rules, mixing, ngram_join, packing, quality, queries, secrets,
                            token_counts, topk, warc, words)

ASCII = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return queries.table(spark, sf, "documents").toPandas()


@pytest.mark.parametrize("name", list(queries.CHECKS))
def test_query_equals_sql(name, spark, sf):
    assert difference(queries.QUERIES[name](spark, sf).toPandas(), duck(sf).execute(queries.CHECKS[name]).df()) is None


# 1 -----------------------------------------------------------------------------------------

def whole_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.TOKENIZER)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def check_sequences(rows, capacity=2048):
    padding = 0
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.concatenate([[0], s["length"].cumsum()[:-1]])).all()
        fill = int(s["length"].sum())
        assert fill <= capacity
        padding += 0 if fill & (fill - 1) == 0 else capacity - fill
    return padding


def test_packing_keeps_every_token_once(spark, sf, docs):
    rows = queries.op1_packing(spark, sf).toPandas()
    for doc_id, ids in zip(docs.doc_id, whole_ids(docs.text)):
        mine = rows[rows.doc_id == doc_id].sort_values("start")
        assert mine["length"].sum() == len(ids) and (mine["doc_tokens"] == len(ids)).all()
        for r in mine.itertuples():
            assert zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert check_sequences(rows) == 0


def test_packing_odd_rows(odd, nothing):
    rows = packing.pack_documents(odd, queries.TOKENIZER).toPandas()
    texts = [r["text"] for r in odd.select("text").collect()]
    assert rows["length"].sum() == sum(map(len, whole_ids(texts)))
    assert Counter(rows[rows.start == 0].doc_tokens) == Counter(map(len, whole_ids(texts)))
    check_sequences(rows)
    assert packing.pack_documents(nothing, queries.TOKENIZER).count() == 0


def test_packer_holds_all_limits():
    rng = np.random.default_rng(1)
    cap = packing.Capacity(64, 5, 30)
    packer, made, total = packing.Packer(cap, pool=16), [], 0
    for key in range(300):
        n = int(rng.integers(1, 200))
        before = np.concatenate([[0], np.cumsum(rng.random(n) < .5)])
        total += n
        made += packer.add(packing.Piece(key, np.arange(n), before, 0, n))
    made += packer.finish()
    seen = {}
    for s in made:
        assert sum(p.tokens for p in s) <= 64 and len(s) <= 5 and sum(p.loss() for p in s) <= 30
        for p in s:
            seen.setdefault(p.key, []).append((p.start, p.end))
    assert sum(e - s for x in seen.values() for s, e in x) == total
    assert all(a[1] == b[0] for x in seen.values() for a, b in itertools.pairwise(sorted(x)))


def test_packer_without_cutting_takes_the_best_match():
    packer = packing.Packer(packing.Capacity(10, 3, 10), pool=8, cut=False)
    for n in (6, 4, 7, 3, 5, 5):
        assert not list(packer.add(packing.Piece(n, np.arange(n), None, 0, n)))
    assert sorted(sorted(p.tokens for p in s) for s in packer.finish()) == [[3, 7], [4, 6], [5, 5]]
    with pytest.raises(ValueError):
        list(packer.add(packing.Piece(0, np.arange(11), None, 0, 11)))


# 2 -----------------------------------------------------------------------------------------

def test_quality_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_quality(spark, sf).toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    m = rows[rows.held_out].merge(queries.table(spark, sf, "labels").toPandas(), on="doc_id")
    assert (m.predicted == m.quality).mean() > 0.93
    assert m[m.quality == 1].predicted.mean() > 0.97


def test_quality_never_reads_held_out_labels(spark, sf, docs):
    labels = queries.table(spark, sf, "labels")
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    d = queries.table(spark, sf, "documents")
    assert quality.training_rows(d, labels, "quality") == quality.training_rows(d, turned, "quality")
    clash = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality")))
    assert quality.training_rows(d, clash, "quality") == []
    assert len(quality.training_rows(d, labels, "quality", most_rows=10)) <= 10


def test_score_is_the_softmax_of_the_mean_vector():
    shape = quality.Shape(buckets=512, width=4)
    model = quality.fit(["good calm words", "bad bad bad ###", "good calm lines", "### ###"], [1, 0, 1, 0], shape)
    score = quality.scorer(model)
    for text in ("good words", "bad bad ###\nbad bad ###", "", "ünï cödé"):
        ids, share = quality.bag(text, shape)
        z = model.bias + float((model.margin[ids] * share).sum())
        assert score([text]) == pytest.approx([1 / (1 + math.exp(-z))], abs=1e-6)
    good, bad = score(["good calm words", "bad bad ###"])
    assert good > 0.5 > bad


def test_quality_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    rows = quality.score_documents(odd, model, keep=["doc_id"]).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(odd, model, 0.0).columns == odd.columns and quality.keep_good(odd, model, 0.0).count() == odd.count()
    assert quality.score_documents(nothing, model).count() == 0
    blank = quality.train(odd, labels.limit(0))
    assert {r.score for r in quality.score_documents(odd, blank, keep=["doc_id"]).collect()} == {0.5}


# 3 -----------------------------------------------------------------------------------------

BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base_spans(text):
    out = [(m.start(), k, m.end()) for k, (rx, ok) in BASE.items() for m in rx.finditer(text or "") if ok(m)]
    return [f"{k}:{s}:{e}" for s, k, e in sorted(out, key=lambda x: (x[0], list(BASE).index(x[1])))]


def test_secrets_equal_plain_matching(spark, docs):
    sf = "/root/testdata/sf0.01"
    texts = queries.table(spark, sf, "documents").toPandas().set_index("doc_id").text
    found = 0
    for r in queries.op3_secrets(spark, sf).toPandas().itertuples():
        want = base_spans(texts[r.doc_id])
        found += len(want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        got = [s for s in r.spans.split(",") if s]
        assert [s for s in got if s.split(":")[0] in BASE] == want
        assert Counter(s.split(":")[0] for s in got) == Counter({k: n for k in secrets.KINDS if (n := getattr(r, f"n_{k}"))})
    assert found > 20


def test_secrets_in_hard_texts():
    words_ = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "AKIA", "akia", "=", ":", " ", "\n", '"', "'", "abcdef012345", "İ", "é",
              "ABCDEFGH12345678", "0123456789abcdef01234567", "short", "ghp_", "_", "😀"]
    rng, keywords = random.Random(4), secrets.automaton()
    for _ in range(3000):
        text = "".join(rng.choice(words_) for _ in range(rng.randint(1, 14)))
        got = [f"{k}:{s}:{e}" for s, e, k in secrets.scan(text, keywords) if k in BASE]
        assert got == base_spans(text), text


def test_checksum_decides():
    body = "abcdefghijklmnopqrstuvwxyz0123"
    good = f"ghp_{body}{secrets.checksum62(body)}"
    keywords = secrets.automaton()
    assert secrets.scan(f"x {good} y npm_{body}{secrets.checksum62(body)}.", keywords) == [(2, 42, "github"), (45, 85, "npm")]
    assert secrets.scan(f"x ghp_{body}000000 y", keywords) == []
    text = f"a token = {good} and é password: hunter22"
    spans = secrets.scan(text, keywords)
    assert [s[2] for s in spans] == ["assign", "github", "assign"]
    assert secrets.redact(text, spans) == "a [assign removed] and é [assign removed]"


def test_secrets_odd_rows(odd, nothing):
    rows = secrets.find_secrets(odd).toPandas()
    assert len(rows) == odd.count() and rows.secrets.map(len).sum() == 1
    cleaned = secrets.remove_secrets(odd)
    assert cleaned.columns == odd.columns
    texts = [r.text for r in cleaned.select("text").collect()]
    assert "no id at all, but a [assign removed]" in texts and None in texts and "" in texts
    assert secrets.find_secrets(nothing).count() == 0 == secrets.remove_secrets(nothing).count()


# 4 -----------------------------------------------------------------------------------------

def water_fill(sizes, weights, total):
    """Targets by repeated resharing."""
    full, target = set(), {}
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_equal_repeated_resharing(spark):
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 100, 5000]) + rng.randint(0, 3) for i in range(n)}
        weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
        rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = water_fill(sizes, weights, 1.5 * sum(sizes.values()))
        assert {r._source: r.target for r in rows} == pytest.approx(want)


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 90), ["a", "b", None][i % 3] if i % 9 else "d") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, keep=["doc_id", "source"]).toPandas()
    assert (out.copies <= 2).all() and out.copies.equals(mixing.mix(df, keep=["doc_id", "source"]).toPandas().copies)
    out["taken"] = out["size"] * out.copies
    for _, g in out.groupby("source", dropna=False):
        assert g.taken.sum() == pytest.approx(g.target.iloc[0], rel=0.05)
        assert g.source_size.iloc[0] == g["size"].sum()
    assert mixing.repeat_rows(df).count() == out.copies.sum()


def test_mix_odd_rows(odd, nothing):
    out = mixing.mix(odd, keep=["doc_id"]).toPandas()
    assert len(out) == odd.count() and out.target.notna().all()
    sizes = sorted(len(ASCII.findall(r.text or "")) for r in odd.select("text").collect())
    assert sorted(out["size"]) == sizes
    again = mixing.repeat_rows(odd)
    assert again.columns == odd.columns and again.count() == out.copies.sum()
    assert mixing.repeat_rows(nothing).count() == 0


# 5 -----------------------------------------------------------------------------------------

def test_magic_inside_payloads(spark, tmp_path):
    record = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    payloads = ["<p>plain</p>" * 30, "", None, record * 40, "WARC/1.1\r\n" * 3000, "x" * 300 + "WARC/1.1\r\nWARC-Type: no\r\nContent-Length: 999999\r\n\r\n",
                "é😀 \r\n\r\nWARC/1.1\r\n", "tail WARC/1.1\r\n"]
    rows = [(i, f"http://h/{i}\r\nX: y", payloads[i % len(payloads)]) for i in range(96)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for size in ("128m", "3000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            path = warc.write_warc(pages, str(tmp_path / size))
            got = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(got) == 96
        for i, _, html in rows:
            raw, r = (html or "").encode(), got[f"<urn:page:{i}>"]
            assert r.declared_length == len(raw) and r.declared_digest == "sha256:" + hashlib.sha256(raw).hexdigest()
            if i >= len(payloads) and len(raw) >= 100:
                assert r.record_type == "revisit" and r.refers_to == f"<urn:page:{i % len(payloads)}>" and bytes(r.payload) == b""
            else:
                assert r.record_type == "response" and bytes(r.payload) == raw and r.refers_to is None


def test_broken_chain_keeps_what_came_before(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    body = record % (3, b"abc") + record % (4, b"defg") + b"garbage WARC/1.1\r\n" + record % (2, b"hi")
    (tmp_path / "a.warc").write_bytes(body)
    assert sorted(bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path)).collect()) == [b"abc", b"defg"]


def test_splits_do_not_follow_the_cores(spark, tmp_path):
    pages = spark.range(400).selectExpr("id as page_id", "concat('u', id) as url", "concat(id, repeat('x', 3000)) as html").coalesce(1)
    path = warc.write_warc(pages, str(tmp_path / "w"))
    keys = {"spark.sql.files.openCostInBytes": "1k", "spark.sql.files.maxPartitionBytes": "500k"}
    cores = "spark.sql.files.minPartitionNum"  # what Spark takes the cores for
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        spark.conf.set(cores, "3")
        got = warc.read_warc(spark, path)
        splits = {r.split for r in warc.split_entries(spark, path).collect()}
        assert len(splits) > 1 and spark.conf.get(cores) == "3"
        spark.conf.set(cores, "7")
        assert {r.split for r in warc.split_entries(spark, path).collect()} == splits
        assert sorted(r.record_id for r in got.collect()) == sorted(f"<urn:page:{i}>" for i in range(400))
    finally:
        for k in [*keys, cores]:
            spark.conf.unset(k)


def test_an_unknown_split_is_an_error():
    batch = pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([9]), pa.array([b"x"])], names=["file", "split", "value"])
    with pytest.raises(RuntimeError, match="split 9"):
        list(warc._follow({("f", 0): (0, 0, 5)})([batch]))


def test_headers_of_any_length(spark, tmp_path):
    rows = [(i, "u" * size, f"page {i}") for i, size in enumerate([3, 100_000, 5, 1_000_000, 7])]
    path = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    got = {r.record_id: (r.target_uri, bytes(r.payload)) for r in warc.read_warc(spark, path).collect()}
    assert got == {f"<urn:page:{i}>": (url, html.encode()) for i, url, html in rows}


def test_warc_odd_rows(spark, tmp_path):
    rows = [(1, None, "a" * 200), (1, None, "a" * 200), (None, "u", "a" * 200), (2, "u", "a" * 200), (None, None, None), (3, "u", "short"), (4, "u", "short")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = Counter((r.record_id, r.record_type, r.refers_to) for r in warc.read_warc(spark, warc.write_warc(pages, str(tmp_path / "w"))).collect())
    one = "<urn:page:1>"
    assert got == Counter({(one, "response", None): 2, (None, "revisit", one): 1, ("<urn:page:2>", "revisit", one): 1, (None, "response", None): 1,
                           ("<urn:page:3>", "response", None): 1, ("<urn:page:4>", "response", None): 1})
    assert warc.round_trip(pages.limit(0)).count() == 0


# 6 -----------------------------------------------------------------------------------------

def shingle_set(text):
    w = [x.lower() for x in ASCII.findall(text or "")]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(rows):
    """(doc_id -> class, doc_id -> links) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * len(sets[i] | sets[j]) - 1e-12:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[top(i)] = min(smallest.get(top(i), d), d)
    return {d: smallest[top(i)] for i, (d, _) in enumerate(rows)}, {d: links[i] for i, (d, _) in enumerate(rows)}


def family(rng, n, words_=120, most_edits=6, tag="w"):
    base = [f"{tag}{rng.randint(0, 5000)}" for _ in range(words_)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most_edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("one_block", [160, 12])
def test_links_equal_all_pairs(spark, docs, monkeypatch, one_block):
    monkeypatch.setattr(ngram_join, "ONE_BLOCK", one_block)
    if one_block < 160:  # small blocks, so that families are cut
        monkeypatch.setattr(ngram_join, "_blocks", lambda n, s: F.when(n <= one_block, 1).otherwise(F.ceil(n / one_block)).cast("int"))
    rng = random.Random(one_block)
    texts = [*docs.text, *family(rng, 60), *family(rng, 40, 60, 12), *family(rng, 3), "four words only here", "Four words ONLY here", "", " "]
    texts += [texts[-9] + " and some words more than before " * 3]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    classes, links = brute_links(rows)
    assert dict(zip(got.doc_id, got.n_links)) == links
    assert dict(zip(got.doc_id, got.class_id)) == classes
    assert sum(v > 0 for v in links.values()) > 50


def test_exact_ties_are_links():
    one = {"ab": 0, "ax": 0, "bb": 0, "bx": 0, "side": 0, "copies": 1, "bands": None}
    for n in range(1, 401):
        whole = np.arange(5 * n, dtype=np.uint64)
        for a, b, tie in ((whole, whole[n:], True), (whole, whole[n + 1:], False),
                          (whole[:4 * n + n // 2], whole[n // 2:], n % 2 == 0)):
            group = pd.DataFrame([{**one, "node": b"a", "shingles": a.tobytes()}, {**one, "node": b"b", "shingles": b.tobytes()}])
            both = len(np.intersect1d(a, b))
            want = 5 * both >= 4 * (len(a) + len(b) - both)
            assert (len(ngram_join.verify(group)) == 2) == want, (n, len(a), len(b))
            assert want or not tie


def test_a_tie_is_one_class(spark):
    text = [f"w{i}" for i in range(34)]  # 30 shingles against the first 24 of them
    got = ngram_join.join_documents(spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:28]))], "doc_id long, text string"))
    assert {(r.doc_id, r.class_id, r.n_links) for r in got.collect()} == {(1, 1, 1), (2, 1, 1)}


def test_rows_without_an_id_are_joined(spark):
    words_ = [f"w{i}" for i in range(80)]
    near = [" ".join([*words_, *extra]) for extra in ([], ["more"], ["more", "still"])]
    schema = "doc_id long, text string"
    for ids in ((1, None, None), (None, None, None), (7, 3, None), (None, 5, 5)):
        df = spark.createDataFrame([*zip(ids, near), (None, near[2]), (None, None), (None, "")], schema)
        got = ngram_join.join_documents(df).collect()
        least = min((i for i in ids if i is not None), default=None)
        inside = [r for r in got if r.n_links]
        assert len(inside) == 4 and {r.class_id for r in inside} == {least} and {r.n_links for r in inside} == {3}
        kept = [r for r in ngram_join.keep_one(df).collect() if r.text]
        assert len(kept) == 1 and kept[0].doc_id == least
        assert ngram_join.keep_one(df).count() == 3


def chain(n, words_=260, step=20):
    """Texts of which only neighbours are alike: each drops the first words of the one before."""
    stream = [f"c{i}" for i in range(words_ + n * step)]
    return [" ".join(stream[i * step:i * step + words_]) for i in range(n)]


def around_a_passage(n, passage=150, rest=110):
    block = [f"p{i}" for i in range(passage)]
    return [" ".join([*block, *[f"q{k}x{i}" for i in range(rest)]]) for k in range(n)]


@pytest.mark.parametrize("texts", [chain(400), around_a_passage(400)])
def test_big_families_verify_pairs_that_share_a_band(texts):
    hasher = ngram_join.BandHasher(*ngram_join.choose_bands())
    sets = [words.shingles(t) for t in texts]
    bands = np.stack([hasher(s) for s in sets])
    a, b = ngram_join.sharing(bands)
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (bands[i] == bands[j]).any()}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want) < len(sets) ** 2 / 4
    group = pd.DataFrame([{"ab": 0, "ax": 0, "bb": 0, "bx": 0, "side": 0, "copies": 1, "node": b"%d" % i, "shingles": s.tobytes(), "bands": k}
                          for i, (s, k) in enumerate(zip(sets, bands))])
    links = ngram_join.verify(group)
    linked = {(i, j) for i, j in want if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert links["links"].sum() == 2 * len(linked)


def test_planted_pairs_at_the_threshold_are_found():
    rng = np.random.default_rng(11)
    hasher = ngram_join.BandHasher(*ngram_join.choose_bands())
    found = 0
    for _ in range(2000):
        n = int(rng.integers(60, 600))
        both = int(np.ceil(n * rng.uniform(0.80, 0.82)))
        pool = rng.integers(0, 2**63, n, dtype=np.uint64)
        cut = int(rng.integers(0, n - both + 1))
        a, b = pool[:both + cut], np.concatenate([pool[:both], pool[both + cut:]])
        found += bool((hasher(a) == hasher(b)).any())
    assert found >= 1997


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.8, 0.95), (0.5, 0.99)):
        b, r = ngram_join.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**r) ** b >= recall and b * r <= ngram_join.MOST_HASHES
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.01, 0.9999)
    hasher, rng = ngram_join.BandHasher(400, 1), np.random.default_rng(2)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    assert (hasher(a) == hasher(b)).mean() == pytest.approx(0.8, abs=0.06)


def test_join_odd_rows(odd, nothing):
    rows = ngram_join.join_documents(odd).toPandas()
    assert len(rows) == odd.count()
    six = rows[rows.doc_id.isin([6, 8])]
    assert (six.class_id == 6).all() and (six.n_links == 2).all() and (six.n_linked_texts == 0).all()
    assert (rows[rows.doc_id.isin([2, 3, 4])].n_links == 0).all()
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({None: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 9: 1})
    assert ngram_join.join_documents(nothing).count() == 0 == ngram_join.keep_one(nothing).count()


def test_keep_one_keeps_one_of_each_class(spark, sf):
    d = queries.table(spark, sf, "documents")
    classes = ngram_join.join_documents(d).toPandas()
    assert sorted(r.doc_id for r in ngram_join.keep_one(d).select("doc_id").collect()) == sorted(classes.class_id.unique())


def test_components_on_chains_and_stars(spark):
    names = [hashlib.md5(str(i).encode()).digest() for i in range(400)]
    edges = [(i, i + 1) for i in range(149)] + [(200, i) for i in range(201, 300)] + [(300, 301), (301, 300), (302, 302)]
    got = components.components(spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a binary, b binary")).collect()
    groups = {}
    for r in got:
        groups.setdefault(bytes(r.component), set()).add(names.index(bytes(r.node)))
    assert sorted(map(sorted, groups.values())) == [list(range(150)), list(range(200, 300)), [300, 301]]
    assert all(bytes(c) in {names[i] for i in g} for c, g in groups.items())


def test_words_by_arrays():
    for text in ("", " ", "a", " a  b\tc\n", "é ü x \x1c y", "w " * 5000 + "z" * 3_000_000 + " q"):
        data = np.frombuffer(text.encode(), np.uint8)
        s, e = words.spans(data)
        assert [data[a:b].tobytes().decode() for a, b in zip(s, e)] == ASCII.findall(text)
    h = words.word_hashes("one two one three two")
    assert h[0] == h[2] and h[1] == h[4] and len(set(h)) == 3


# 7 -----------------------------------------------------------------------------------------

def plain_count(word, v):
    word = token_counts.MARK + word
    best = [(0.0, 0)] + [None] * len(word)
    for j in range(1, len(word) + 1):
        n = len(word[j - 1].encode())
        options = [(best[j - 1][0] + n * v.byte, best[j - 1][1] - n)]
        for i in range(j):
            if word[i:j] in v.pieces:
                options.append((best[i][0] + v.pieces[word[i:j]], best[i][1] - 1))
        best[j] = max(options)
    return -best[-1][1]


def test_token_counts_equal_plain_dynamic_programming(spark, sf, docs):
    v = token_counts.load_vocabulary(queries.PIECES)
    got = queries.op7_token_counts(spark, sf).toPandas().set_index("doc_id")
    known = {}
    for d, t in zip(docs.doc_id, docs.text):
        found = ASCII.findall(t)
        assert got.n_words[d] == len(found)
        for w in set(found) - known.keys():
            known[w] = plain_count(w, v)
        assert got.n_tokens[d] == sum(map(known.__getitem__, found))


def test_trie_scores_each_prefix_once():
    v = token_counts.rank_vocabulary(["▁", "a", "b", "ab", "▁a", "abc"])
    trie = token_counts.Trie(v)
    for _ in range(3):
        for w in ("abab", "abac", "aba", "zab", "€"):
            assert trie.tokens(w) == plain_count(w, v)
    prefixes = {("▁" + w)[:i] for w in ("abab", "abac", "aba", "zab", "€") for i in range(1, len(w) + 2)}
    assert trie.scored == len(prefixes)
    small = token_counts.Trie(v, most_nodes=3)
    assert [small.tokens(w) for w in ("abab", "abac", "zab")] == [plain_count(w, v) for w in ("abab", "abac", "zab")]


def test_token_counts_odd_rows(odd, nothing):
    rows = token_counts.count_tokens(odd, queries.PIECES).toPandas()
    assert len(rows) == odd.count() and sorted(rows.n_words)[:4] == [0, 0, 0, 0] and (rows.n_tokens >= rows.n_words).all()
    assert token_counts.count_tokens(nothing, queries.PIECES).count() == 0


# 8 -----------------------------------------------------------------------------------------

def test_language_of_pages(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_language_id(spark, sf).toPandas()
    pages = queries.table(spark, sf, "pages").toPandas()
    m = rows.merge(pages, on="page_id")
    truth = m.url.str.extract(r"://[^/]+/(\w\w)/")[0]
    assert len(rows) == len(pages) and (m.lang == truth)[truth.notna()].mean() > 0.97
    assert rows.confidence.between(0, 1.0000001).all()


def test_posterior_equals_direct_computation(spark):
    model = language_id.fit([("the of and with that", "en"), ("le la des et que", "fr")])
    pages = [(1, "http://a.x.com/1", '<html lang="en">the of and'), (2, "http://a.x.com/2", "<html lang=fr>the with"), (3, "http://b.x.com/", "le la que"),
             (4, "http://b.x.com/q", None), (5, None, "<html lang=xx>des et"), (6, "http://c.y.fr/", "<p>1 2 3</p>")]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    score = language_id.text_scorer(model)
    facts = []
    for i, url, html in pages:
        s = score(language_id.visible(html or ""))
        host = re.match(r"http://([^/]*)", url or "http://")[1]
        declared = re.search(r"<html lang=\"?(en|fr)\b", html or "")
        facts.append((i, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], declared and declared[1],
                      np.zeros(2) if s is None else s, -1 if s is None else int(s.argmax())))
    overall = np.array([sum(f[6] == k for f in facts) for k in range(2)], float)
    for i, host, domain, suffix, declared, s, g in facts:
        logs = []
        for k, lang in enumerate(model.languages):
            def counts(at, value):
                return [sum(f[6] == j for f in facts if f[at] == value) for j in range(2)]
            own, some = float(g == k), float(g >= 0)
            base = (overall[k] + 1) / (overall.sum() + 2)
            for at, value in ((2, domain), (1, host)):
                c = counts(at, value)
                base = (c[k] - own + 5 * base) / (sum(c) - some + 5)
            c = counts(3, suffix)
            share = (sum(c) - some + 1) / (overall.sum() + 1)
            tail = (c[k] - own + 2 * share) / (overall[k] - own + 2)
            n = sum(f[6] == k for f in facts if f[4] == declared)
            says = math.log((n + 1) / (overall[k] + 2)) if declared else 0.0
            logs.append(s[k] + says + math.log(base) + math.log(tail))
        p = np.exp(np.array(logs) - max(logs))
        assert got[i].lang == model.languages[int(np.argmax(logs))]
        assert got[i].confidence == pytest.approx(1 / p.sum())
        assert got[i].text_lang == (model.languages[g] if g >= 0 else None) and got[i].declared == declared


def test_language_odd_rows(spark, odd, nothing):
    pages = spark.createDataFrame([(1, None, None, "a"), (1, None, None, "a"), (None, "not an address", "<html lang='DE'>", "b"),
                                   (2, "ftp://u:p@H.Example:21/x", "<b>" * 9000, "c")], "page_id long, url string, html string, host string")
    model = language_id.train(odd)
    rows = language_id.identify(pages, model).collect()
    assert len(rows) == 4 and {r.host for r in rows} == {"", "h.example"} and "de" not in model.languages
    assert {r.lang for r in rows} <= set(model.languages) and {r.declared for r in rows} == {None}
    assert language_id.identify(pages.limit(0), model).count() == 0
    assert {r.lang for r in language_id.identify(pages, language_id.train(nothing)).collect()} == {None}


# 9 -----------------------------------------------------------------------------------------

def test_top_k_prunes_and_stays_exact(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 4, (40, 16))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(0, .05, (4000, 16))
    ints = np.floor(64 * x).astype(np.int64)
    ids = np.arange(4000)
    search = topk.Search(ids[::20], ints[::20], 20)
    for i in range(0, 4000, 1500):
        search.add(ids[i:i + 1500], ints[i:i + 1500])
    scores = ints[::20] @ ints.T
    for q in range(200):
        scores[q, q * 20] = topk.LOW + 1
        want = sorted(zip(-scores[q], ids))[:20]
        assert list(zip(-search.best[q], search.best_ids[q])) == want
    assert search.scored < 0.8 * 200 * 4000


def test_cover_tree_covers():
    x = np.random.default_rng(3).normal(size=(3000, 8)) * 100
    stack, leaves = [topk.cover_tree(x)], 0
    while stack:
        n = stack.pop()
        assert np.linalg.norm(x[n.points] - n.centre, axis=1).max() <= n.radius + 1e-9
        if n.children:
            assert sorted(np.concatenate([c.points for c in n.children])) == sorted(n.points)
            stack += n.children
        else:
            leaves += len(n.points)
    assert leaves == 3000


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, None]), (40, [float("nan"), 1.0]), (60, None), (80, []), (100, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]),
            (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [float("inf"), 0.0]), (4, [-1.0, -0.001]), (120, [1e30, 1e30])]
    df = spark.createDataFrame([(*r, "s") for r in rows], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(df, df.filter("vec_id % 20 = 0"), k=4).toPandas().sort_values(["query_id", "rank"])
    zero = got[got.query_id == 0]
    assert zero.vec_id.tolist() == [120, 1, 2, 2] and zero["rank"].tolist() == [1, 2, 3, 4] and zero.score.tolist()[1:] == [20480] * 3
    assert set(got.query_id) == {0, 120} and got[got.query_id == 120].vec_id.tolist() == [0, 1, 2, 2]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    many = spark.range(0, 900).selectExpr("id as vec_id", "array(cast(id % 7 as double), cast(id % 11 as double)) as embedding")
    ask = many.filter("vec_id % 20 = 0")
    a, b = topk.top_k(many, ask).toPandas(), topk.top_k(many, ask, queries_per_job=10).toPandas()
    assert difference(a, b) is None and len(a) == 45 * 20


# 10 ----------------------------------------------------------------------------------------

def base_rules(text):
    text = text or ""
    w = ASCII.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if ASCII.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_line_rules_equal_plain_counts(spark, sf, docs):
    rows = queries.op10_line_rules(spark, sf).toPandas().set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text):
        r = rows.loc[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(t)
        assert not (r.kept and r.base_failed)


def test_line_rules_follow_quality(spark):
    sf = "/root/testdata/sf0.01"
    m = queries.op10_line_rules(spark, sf).toPandas().merge(queries.table(spark, sf, "labels").toPandas(), on="doc_id")
    m = m[~m.base_failed]
    assert m[m.quality == 1].kept.mean() > 0.97 and m[m.quality == 0].kept.mean() < 0.2


def test_viterbi_equals_trying_all():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        field = line_rules.Field(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
        f = rng.normal(size=(n, 3))

        def value(labels):
            return sum((f[t] @ field.line)[y] for t, y in enumerate(labels)) + sum(field.step[a, b] for a, b in itertools.pairwise(labels))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(line_rules.viterbi(field, f).astype(int)) == best


def test_gradient_equals_differences():
    rng = np.random.default_rng(6)
    f, y = rng.normal(size=(5, 3)), np.array([0, 1, 1, 0, 1])

    def likelihood(line, step):
        def value(labels):
            return sum((f[t] @ line)[k] for t, k in enumerate(labels)) + sum(step[a, b] for a, b in itertools.pairwise(labels))
        return value(y) - math.log(sum(math.exp(value(p)) for p in itertools.product((0, 1), repeat=5)))
    line, step = rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
    got = line_rules.gradient(line_rules.Field(line, step), f, y)
    for k, x in enumerate((line, step)):
        for i in np.ndindex(x.shape):
            up = [line.copy(), step.copy()]
            up[k][i] += 1e-6
            assert (likelihood(*up) - likelihood(line, step)) / 1e-6 == pytest.approx(got[k][i], abs=1e-4)


def test_line_rules_odd_rows(odd, nothing):
    rows = line_rules.apply_rules(odd, line_rules.fit([])).toPandas()
    assert len(rows) == odd.count()
    want = Counter(base_rules(r.text) for r in odd.select("text").collect())
    assert Counter(zip(rows.n_words, rows.word_chars, rows.n_symbols, rows.n_dup_lines, rows.n_repeat_words, rows.base_failed)) == want
    assert rows.content_share.isin([0, 1]).all() and rows[rows.doc_id == 5].kept.all()
    assert line_rules.apply_rules(nothing, line_rules.fit([])).count() == 0


def test_word_encoder_equals_the_tokenizer_on_odd_words_and_small_caches():
    from tokenizers import Tokenizer

    with open(queries.TOKENIZER, encoding="utf-8") as f:
        vocabulary = f.read()
    bodies = ["ΑΣ Σ. İstanbul ǅ Straße Ünï ª µ º x's don't Foo'S 'S s' ×÷ ÿŸ ÀÖØÞß!~`^_", "a<|endoftext|> <|ENDOFTEXT|> a b c\x85d a_b_ 1a2 ...!?",
              "é É. \x1c", "", " \n", "A" * 5000 + "!!!", "Foo, foo FOO foo. bar; bar"] * 2
    tokenizer = Tokenizer.from_str(vocabulary)
    wanted = [np.array(tokenizer.encode(b, add_special_tokens=False).ids, "<u4").tobytes() for b in bodies]
    for size in (1, 5, 1_000):
        encode = packing.word_encoder(vocabulary, size)
        assert encode(bodies) == wanted
        assert [encode([b])[0] for b in bodies] == wanted


# Long input ----------------------------------------------------------------------------------

def peak_mb(code):
    """Memory that a fresh Python process needs beyond its imports and its input."""
    import subprocess
    import sys
    probe = ("import resource, sys; sys.path.insert(0, %r)\nuse = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024\n" % sys.path[0]) + code
    return float(subprocess.run([sys.executable, "-c", probe], capture_output=True, text=True, check=True, timeout=300,
                                env={**__import__("os").environ, "PYTHONPATH": ":".join(sys.path)}).stdout)


def test_a_long_word_is_scored_in_a_window(monkeypatch, spark):
    v = token_counts.rank_vocabulary(["▁a", "b", "ab", "abc", "▁", "c", "é", "bb"])
    rng = random.Random(5)
    for n in (1, 2, 3, 10, 200, 900):
        w = "".join(rng.choice("abcéx") for _ in range(n))
        assert token_counts.windowed_tokens(v, w) == token_counts.Trie(v).tokens(w)
    docs = spark.createDataFrame([(1, "abc " * 5 + "x" * 6000 + " " + "x" * 6000), (2, "abcx")], "doc_id long, text string")
    long_ = token_counts.count_tokens(docs, queries.PIECES).collect()
    monkeypatch.setattr(token_counts, "LONGEST_IN_TRIE", 10**9)
    assert long_ == token_counts.count_tokens(docs, queries.PIECES).collect()


def test_a_long_word_needs_no_memory():
    assert peak_mb("""
from plantwatch.llm import token_counts as t
v = t.rank_vocabulary(["ab", "b", "a"])
w = "ab" * 1_000_000
before = use()
assert t.windowed_tokens(v, w) > 0
print(use() - before)""") < 60


@pytest.mark.parametrize("piece", ["<", "<!--", "<script", "<style ", "<script><!--", "&a", "<html "])
def test_unclosed_markup_takes_linear_time(piece):
    import time
    page = piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    language_id.visible(page)
    assert time.perf_counter() - start < 2


def test_visible_text_of_broken_pages():
    hidden = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
    tag = re.compile(r"<[^>]*>")
    rng = random.Random(4)
    parts = ["<script>", "</script >", "</SCRIPT>", "<style x>", "</style>", "<!--", "-->", "<p>", "<", ">", " text ", "<scripty>", "&amp;", "\n", "<!-->"]
    for _ in range(4000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = language_id.ENTITY.sub(" ", tag.sub(" ", hidden.sub(" ", page)))
        assert language_id.visible(page) == want, page


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(6)
    for k in range(60):
        text = "".join(rng.choice(["word ", "Ab ", "#| ", "\n", "\n\n", "é", "same line\n", " ", "x" * 50]) for _ in range(rng.choice([0, 3, 40, 300])))
        whole = line_rules.sheet(text)
        field = line_rules.Field(np.random.default_rng(k).normal(size=(17, 2)), np.random.default_rng(k).normal(size=(2, 2)))
        labels = line_rules.viterbi(field, whole.features)
        with monkeypatch.context() as m:
            m.setattr(line_rules, "PIECE", 16)
            m.setattr(line_rules, "LINES_AT_ONCE", 2)
            small = line_rules.sheet(text)
            assert (line_rules.viterbi(field, small.features) == labels).all()
        assert (small.features == whole.features).all() and (small.words == whole.words).all()
        assert (small.n_words, small.word_chars, small.n_symbols, small.n_dup_lines, small.n_repeat_words) == (
            whole.n_words, whole.word_chars, whole.n_symbols, whole.n_dup_lines, whole.n_repeat_words)


def test_a_long_text_needs_some_times_its_size():
    mb = peak_mb("""
import numpy as np
from plantwatch.llm import line_rules as r
text = "".join(f"word{i} stands in line {i % 977}, and so on.\\n" for i in range(500_000))
field = r.Field(np.zeros((17, 2)), np.zeros((2, 2)))
before = use()
r.content_share(field, r.sheet(text))
print((use() - before) / (len(text) / 1e6))""")
    assert mb < 16  # was over 60
