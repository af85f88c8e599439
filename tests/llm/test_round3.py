"""Lattice hashing, periodic runs and alignment of tokenizers against brute force, and the cases that their docstrings state."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from orrery.llm import alignment, lattice, linededup, queries, runs

DOCS = "doc_id long, text string, n_a string, slot int, batch int, node long, x string"


def docs_of(spark, rows):
    """Extra columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "p", 1, 2, 3, "y") for i, t in rows], DOCS)


# --- embedding near-dedup ---------------------------------------------------------------------------------------------------------


def link_brute(rows, least=0.93):
    ok = [v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    vec = [np.array(v, float) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    n, links = len(rows), [0] * len(rows)
    root = list(range(n))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] / np.linalg.norm(vec[i]) / np.linalg.norm(vec[j]) >= least:
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        ids[find(i)] += [] if d is None else [d]
    best = [min(ids[find(i)], default=None) for i in range(n)]
    return Counter((d, links[i], best[i], d is not None and d == best[i]) for i, (d, _, _) in enumerate(rows))


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "c", 2) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, node int, cell string, copies int")


def messy_vectors(width=16, seed=3):
    rng, rows = np.random.default_rng(seed), []
    for i in range(160):
        base = rng.standard_normal(width) if i % 4 == 0 else base
        rows.append((i, [float(np.float32(x)) for x in base + rng.standard_normal(width) * rng.choice([0, 0.05, 0.1, 0.6])], int(rng.integers(3))))
    far = [2.0 * x for x in rows[5][1]]
    rows += [(900, None, 1), (901, [0.0] * width, 1), (902, [None, *[1.0] * (width - 1)], 1), (903, [float("nan")] * width, 1), (904, [float("inf")] * width, 0)]
    rows += [(905, rows[5][1], None), (906, rows[5][1][:9], rows[5][2]), (907, far, rows[5][2]), (None, rows[5][1], rows[5][2]), (None, None, None), (908, [], 1)]
    return [*rows, rows[7], rows[7], (909, [1e-30] * width, 2), (910, [1e30] * width, 2)]


def test_lattice_steps_and_decoding():
    assert len({tuple(s) for s in lattice.STEPS}) == 240 and np.allclose((lattice.STEPS**2).sum(1), 2)
    x = np.random.default_rng(1).standard_normal((300, 8)) * 2
    got = lattice.decode(x)
    assert not ((2 * got) % 1).any() and not (got.sum(1) % 2).any() and (((got * 2) % 2).sum(1) % 8 == 0).all()
    for step in lattice.STEPS:  # no neighbouring point is nearer
        assert (((x - got) ** 2).sum(1) <= ((x - got - step) ** 2).sum(1) + 1e-9).all()


def test_embedding_links_match_brute_force(spark):
    rows = messy_vectors()
    df = vectors_of(spark, rows)
    # With all neighbouring cells visited at a wide scale, nothing is missed on such a table.
    for leaf in (4096, 20):
        got = lattice.near_embeddings(df, tables=3, probes=60, scale=4.0, leaf=leaf)
        assert Counter(tuple(r) for r in got.collect()) == link_brute(rows)
    assert lattice.near_embeddings(vectors_of(spark, [])).count() == 0
    two = lattice.near_embeddings(df, tables=4, probes=60, scale=5.0, blocks=2)
    assert Counter(tuple(r) for r in two.collect()) == link_brute(rows)


def test_embedding_recall_at_the_threshold(spark):
    """Pairs at a cosine just above and just below 0.93, with the production parameters."""
    rng, rows = np.random.default_rng(8), []
    for i in range(400):
        u, w = rng.standard_normal((2, 64))
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        c = 0.9305 if i % 2 else 0.9295
        rows += [(2 * i, u.tolist(), i % 3), (2 * i + 1, (3 * (c * u + np.sqrt(1 - c * c) * w)).tolist(), i % 3)]
    got = {r["vec_id"]: r for r in lattice.near_embeddings(vectors_of(spark, rows)).collect()}
    assert all(got[4 * i]["n_links"] == 0 for i in range(200))
    found = [got[4 * i + 2]["n_links"] == 1 and got[4 * i + 3]["component_id"] == 4 * i + 2 for i in range(200)]
    assert np.mean(found) >= 0.94


def test_embedding_dedup_query(spark):
    got = queries.op11_embedding_dedup(spark, "/root/testdata/sf0.001").collect()
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in got) == link_brute(rows)


# --- periodic runs ----------------------------------------------------------------------------------------------------------------


def run_brute(w, least=24, times=3):
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size = j + p - i
            if size >= max(least, times * p) and not any(all(w[k] == w[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = max(i, j) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest_brute(doc_id, text):
    w = (text or "").split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n, own = h // 10, len(w), w[:]
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    found = run_brute(w)
    gone = {i for s, z, p in found for i in range(s + p, s + z)}
    top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    tops = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(found), *tops, sha("".join(f"{s},{z},{p}\n" for s, z, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(700):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(90))]
        if w and rng.random() < 0.7:
            a, p = rng.randrange(len(w)), rng.randrange(1, 9)
            for i in range(a, min(len(w), a + rng.randrange(10, 70))):
                w[i] = w[a + (i - a) % p]
        w = runs.numbers([b"%d" % x for x in w])
        for least, times in ((24, 3), (2, 2), (6, 3), (1, 4)):
            assert runs.find_runs(w, least, times) == run_brute(w, least, times)


def test_runs_of_lying_hashes(monkeypatch):
    """Results stand when every hash comparison says yes, and when every one says no."""
    fib = ([0], [0, 1])
    while len(fib[1]) < 300:
        fib = (fib[1], fib[1] + fib[0])
    for lie in (True, False):
        monkeypatch.setattr(runs.Words, "same", lambda self, i, j, size, lie=lie: lie)
        for w in (fib[1], [0, 1, 2] * 60 + [5] + [0, 1, 2] * 20, [0] * 200):
            assert runs.find_runs(w) == run_brute(w)


def test_runs_of_long_texts():
    n = 200_000
    for w, want in (([0] * n, (0, n, 1)), ([i % 1000 for i in range(n)], (0, n, 1000))):
        assert runs.find_runs(w) == [want]


def test_periodic_runs(spark):
    rng = random.Random(6)
    rows = [(None, "x " * 60), (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "ü " * 30), (-7, "a b " * 40), (8, "a\x0bb\x0ca\rb " * 20 + "end")]
    for i in range(10, 90):
        w = [rng.choice("abcdefgh") for _ in range(rng.randrange(200))]
        rows.append((i, " ".join(w + w[-5:] * rng.randrange(9) + w[:3])))
    rows += [rows[20], rows[20]]
    got = runs.periodic_runs(docs_of(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == Counter(digest_brute(*r) for r in rows)
    assert runs.periodic_runs(docs_of(spark, [])).count() == 0
    kept = runs.without_repeats(docs_of(spark, [(1, "go  " + "la di " * 20 + "stop"), (2, "as  it was"), (3, None)]))
    assert [(r["doc_id"], r["text"]) for r in kept.collect()] == [(1, "go la di stop"), (2, "as  it was"), (3, None)]


def test_periodic_runs_query(spark):
    got = queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = {d["doc_id"] for d in docs if len((d["text"] or "").split()) < 1500}  # brute force is slow on the longest texts
    assert Counter(tuple(r) for r in got if r["doc_id"] in short) == Counter(digest_brute(*d) for d in docs if d["doc_id"] in short)
    assert len(got) == len(docs)


# --- cross-tokenizer alignment ----------------------------------------------------------------------------------------------------

ODD = ["a", "\n", " ", "  ", "x  y", "a\n\nb", " a", "a ", "a\tb c", "é ß", "a▁b", "▁", "a\n▁b", "\n▁", "<s> <|endoftext|> x", "\x00", "a\r\nb c 　d", "日本語 テスト", "'s 're it's", "1 5 6\x1c 7", "a\x85b c", "🙂🙂 🙂\n🙂", "ſ İ", "﻿a b", "<0x0A> y", "q\n w", "q \nw", "\nq", "q\n", " \n x", "x" * 300 + " y", "foo bar\nbar foo foo."]


def align_brute(rows):
    """Whole texts encoded at once, tokens' bytes compared place by place."""
    v, told = alignment.vocabularies(None, None), []
    for _, t in rows:
        a, b = (v.a.encode(f" {t}", add_special_tokens=False).ids, v.b.encode(t)) if t else ([], [])
        by_a, by_b = [v.bytes_a[i] for i in a], [v.bytes_b[i] for i in b]
        if not t or b"".join(by_a) != f" {t}".encode() or b"".join(by_b) != f" {t}".encode():
            told.append(None)
            continue
        end_a, end_b = ({int(e): k for k, e in enumerate(np.cumsum([len(x) for x in by]))} for by in (by_a, by_b))
        both = sorted(set(end_a) & set(end_b))
        groups = [(a[(end_a[p] + 1 if p else 0) : end_a[e] + 1], b[(end_b[p] + 1 if p else 0) : end_b[e] + 1]) for p, e in zip([0, *both], both, strict=False)]
        told.append((len(a), len(b), groups, [(a[end_a[e]], b[end_b[e]]) for e in both]))
    count = Counter(p for x in told if x for p in x[3])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(n, top.get(b, 0))
    out = Counter()
    for (d, _), x in zip(rows, told, strict=True):
        if x is None:
            out[(d, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in x[2])
        out[(d, x[0], x[1], len(x[2]), len(x[3]), sum(count[p] == top[p[1]] for p in x[3]), sum(count[p] for p in x[3]), hashlib.sha256(said.encode()).hexdigest())] += 1
    return out


def test_alignment_matches_brute_force(spark, monkeypatch):
    rows = [(None, "the one"), (1, None), (2, ""), *((10 + i, t) for i, t in enumerate(ODD)), (11, "a"), (11, "a")]
    rows += [(100 + i, "the " * (i % 9) + f"of word{i % 5}, and\nThe rest.") for i in range(60)]
    got = alignment.align(docs_of(spark, rows).repartition(3))
    assert Counter(tuple(r) for r in got.collect()) == align_brute(rows)
    assert alignment.align(docs_of(spark, [])).count() == 0


def test_units_forgotten_give_the_same(monkeypatch):
    v, texts = alignment.vocabularies(None, None), [f"some {i} words\nof {i % 7} kinds" for i in range(40)]
    want = list(v.aligned(texts))
    monkeypatch.setattr(alignment, "KNOWN", 3)
    v.known.clear()
    assert list(v.aligned(texts)) == want


def test_alignment_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op13_alignment(spark, "/root/testdata/sf0.001").collect()) == align_brute(rows)


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op12_periodic_runs", "op13_alignment"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()


# --- line dedup, bytes against hashes ---------------------------------------------------------------------------------------------


def test_lines_of_one_hash_are_told_by_their_bytes(spark, monkeypatch):
    """All chunks on one hash: what stands once, or other bytes, must stay."""
    shared = "\n".join(f"shared line number {i} of a passage" for i in range(8))
    rows = [(1, shared), (2, f"own start\n{shared}"), (3, "nothing of this\nstands elsewhere"), (4, "\n".join(f"line {i} here alone" for i in range(6)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {tuple(r) for r in linededup.line_dedup(df).select("doc_id", "text", "n_removed").collect()}
    told = linededup.chunks
    monkeypatch.setattr(linededup, "chunks", lambda *a: told(*a).withColumn("hash", F.unhex(F.md5(F.lit("one")))))
    got = {tuple(r) for r in linededup.line_dedup(df).select("doc_id", "text", "n_removed").collect()}
    assert got == want and {(3, rows[2][1], 0), (4, rows[3][1], 0)} <= got and any(n for _, _, n in got)
