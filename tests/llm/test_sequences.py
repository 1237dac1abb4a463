"""Operators 11 to 13 against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from compare import difference, duck
from plantwatch.llm import components, periodic_runs as P, prefix_trie as T, queries, simhash as S


# 11 ----------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [words[i:i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    """Smallest position of each position's component."""
    m = np.array(marks, np.uint64)
    near = np.bitwise_count(m[:, None] ^ m[None, :]) <= 3
    root = np.arange(len(m))
    while True:
        low = np.where(near, root[None, :], len(m)).min(1)
        if (low == root).all():
            return root
        root = low


def check_near(docs, rows):
    """rows: (id, text) of docs; ids may be missing."""
    got = S.near_copies(docs).toPandas()
    marks = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(marks)
    least = defaultdict(list)
    for (i, _), r in zip(rows, root):
        least[r] += [i] if i is not None else []
    want = sorted((i is None, i or 0, f"{m:016x}", min(least[r], default=-1)) for (i, _), m, r in zip(rows, marks, root))
    have = sorted((x != x or x is None, 0 if x != x or x is None else int(x), f, -1 if c != c or c is None else int(c))
                  for x, f, c in zip(got.doc_id, got.fingerprint, got.component_id))
    assert have == want


def test_near_copies_of_all_documents(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    check_near(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_near_copies_odd_rows(odd, nothing):
    check_near(odd, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert S.near_copies(nothing).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    from plantwatch.llm import words
    raw = ("Ab c\x0bdéf  G " * 3000).encode()
    whole = np.concatenate(list(S.shingle_hashes(raw)))
    monkeypatch.setattr(S, "byte_pieces", lambda x: words.byte_pieces(x, 50))
    assert (np.concatenate(list(S.shingle_hashes(raw))) == whole).all() and len(whole) == 12_000 - 2
    counts = np.array([0, len(whole), 0, 3])
    marks = S.majorities(np.concatenate([whole, whole[:3]]), counts)
    assert marks[0] == marks[2] == 0 and marks[1] == plain_fingerprint(raw.decode()) and marks[3] == plain_fingerprint("Ab c déf G Ab")


@pytest.mark.parametrize("most", [2048, 12, 3])
def test_long_lists_lose_no_link(spark, most):
    """Dense clusters whose lists are divided twice."""
    rng = random.Random(3)
    marks = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(4):
        base = rng.getrandbits(64)
        marks |= {base ^ sum(1 << b for b in rng.sample(range(0, 64, rng.choice([1, 5, 9])), rng.randint(0, 5))) for _ in range(90)}
        low = base & ~0xFFFFFF
        marks |= {low | rng.getrandbits(8) for _ in range(40)}
    marks = sorted(marks)
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    names = S.mix(np.array(marks, np.uint64)).view(np.int64).tolist()
    nodes = spark.createDataFrame(list(zip(names, signed)), "node long, fingerprint long").repartition(5)
    place = {r.node: r.component for r in components.components(S.links(nodes, most)).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for k, (name, root) in enumerate(zip(names, plain_components(marks))):
        groups[place.get(name, name)].add(k)
        want[root].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_three_bits_leave_a_list_in_common():
    for bits in ((0, 8, 16), (0, 33, 63), (5, 6, 7), (24, 32, 40), (1, 9, 60)):
        touched = {b // 8 for b in bits}
        assert any(not touched & set(c) for c in S.LISTS)
    a, b = np.array([0x1122334455667788], np.uint64), np.array([0x1122334455667799 ^ (1 << 60)], np.uint64)
    assert S.shared_bytes(a, b) == 6


# 12 ----------------------------------------------------------------------------------------

def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key[:30], role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in full.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = []
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[k] for k in children[node])
    for node, mine in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(mine), len(node), min(members[node[:-1]]) if node else None, len(mine), len(children[node]), leaves[node], saved[node], sha))
    return sorted(out, key=lambda r: r[:2])


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(rows, width):
    nodes = T.describe(*T.build_trie(*T.rebuild(T.turn_ids(rows)), width=width))
    return sorted((tuple(r[c] for c in COLUMNS) for r in nodes.collect()), key=lambda r: r[:2])


def talk(seed, n=60):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-20, 90), n):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14, 30])):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if rng.random() < .2 else "user", rng.choice(["a", "bé", "", None]) if rng.random() < .3 else f"turn {t}"))
    rows += [(3, None, "system", "first"), (3, None, "system", "first"), (None, 1, "user", "lost"), (None, None, None, None), (10, 2, "user", "tie"), (10, 2, "user", "tie too")]
    return rows


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("width", [1, 3, 8])
def test_trie_equals_brute_force(spark, width):
    rows = talk(width)
    assert trie(spark.createDataFrame(rows, CONV).repartition(3), width) == plain_trie(rows)


def test_trie_of_long_conversations_in_slots(spark, tiny_tasks):
    rows = talk(7, 25) + [(85, t if t else None, "user", f"turn {t % 3}") for t in range(300)] + [(86, t, "user", f"turn {t % 3}") for t in range(120)]
    assert trie(spark.createDataFrame(rows, CONV).repartition(3), 8) == plain_trie(rows)


def test_trie_odd_tables(spark):
    rows = [(1, 0, "user", "x" * 100_000), (2, 0, "user", "x" * 100_000), (2, 0, "user", "x" * 100_000)]
    extra = spark.createDataFrame([(*r, 1, "k", "v") for r in rows], CONV + ", pos long, key string, block string")
    assert trie(extra, 8) == plain_trie(rows)
    assert trie(extra.limit(0), 8) == []
    assert trie(extra.filter("conv_id is null"), 8) == []


# 13 ----------------------------------------------------------------------------------------

def plain_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q - s), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_row(doc_id, text, loop=queries.planted_loop):
    words = (text or "").encode().split()
    edit = loop(doc_id, len(words)) if loop else None
    if edit:
        a, p = edit
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    runs = plain_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, b" ".join(w for i, w in enumerate(words) if i not in drop).decode()


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 5, 6, 20, 60, 300]), rng.choice([1, 2, 3, 10])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < .6:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3 + 1))
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            texts.append(w)
        text, start, length, period = P.runs_of([np.array(w, np.int32) for w in texts])
        for k, w in enumerate(texts):
            assert [(int(a), int(b), int(c)) for x, a, b, c in zip(text, start, length, period) if x == k] == plain_runs(w)


def test_extensions_equal_direct_comparison():
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (14, 2), (200, 2), (400, 1), (300, 50)):
        ids = np.concatenate([rng.integers(0, k, n), [k]]).astype(np.int32)
        table = P.Extensions(ids)
        i = rng.integers(0, n, 300)
        j = rng.integers(0, n + 2, 300)
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j = i[i < j], j[i < j]
        for a, b, got in zip(i, j, table(i, j)):
            want = 0
            while b + want < len(ids) and ids[a + want] == ids[b + want]:
                want += 1
            assert got == want


def test_cover_has_every_distance():
    assert {(a - b) % P.CYCLE for a in P.COVER for b in P.COVER} == set(range(P.CYCLE))


def test_runs_of_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op13_periodic_runs(spark, sf).toPandas().set_index("doc_id")
    docs = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        runs, collapsed = plain_row(r.doc_id, r.text)
        row = got.loc[r.doc_id]
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed.encode()).hexdigest()
        if runs:
            s, n, q = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (row.start, row["length"], row.period, row.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert row[["start", "length", "period", "exponent_milli"]].isna().all()


@pytest.mark.parametrize("loop", [None, lambda d, n: (n // 3, 1 + n // 20) if n else None])
def test_runs_odd_rows(odd, nothing, loop):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in P.find_runs(odd, edit=loop).collect()]
    small = [(d, t) for d, t in rows if len(t or "") < 10_000 or len(t.split()) < 10]
    want = [(d, *plain_row(d, t, loop)) for d, t in small]
    assert all(w in got for w in want) and len(got) == len(rows)
    assert P.find_runs(nothing).count() == 0


def test_a_long_loop_takes_no_square():
    words = np.tile(np.arange(50, dtype=np.int32), 20_000)
    assert [x.tolist() for x in P.runs_of([words])] == [[0], [0], [1_000_000], [50]]


def test_pieces_keep_words_whole(monkeypatch):
    from plantwatch.llm import words
    raw = (b"a b a b a b a b a b \xc3\xa9 " * 40)
    keep = np.arange(11 * 40) % 3 > 0
    want = b" ".join(w for w, k in zip(raw.split(), keep) if k).decode()
    monkeypatch.setattr(P, "byte_pieces", lambda x: words.byte_pieces(x, 7))
    assert P.keep_words(raw, keep) == want and len(P.number_words(raw, {})) == 440
    loop = [*raw.split()[:5], *(raw.split()[5:12] * 80)][:440]
    assert P.keep_words(raw, keep, (5, 7)) == b" ".join(w for w, k in zip(loop, keep) if k).decode()


def test_trie_query_equals_sql_on_more_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op12_prefix_trie(spark, sf).toPandas()
    assert difference(got, duck(sf).execute(queries.OP12_SQL).df()) is None
    assert len(got) == queries.op12_prefix_trie(spark, sf).select("conv_id", "depth").distinct().agg(F.count("*")).first()[0]
