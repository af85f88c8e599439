"""The ten operators against brute force on small tables, and the cases that their docstrings state."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orrery.llm import induced, linededup, mixing, neardup, queries, simhash, suffixdedup, toxicity, urls, vectors, warc
from orrery.llm.bpe import Encoder, bpe_decode, bpe_digest, bpe_encode, default_path
from orrery.llm.stages import drop_lines, drop_near, drop_toxic, mix_sources, tokenize

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, path string"


def docs_of(spark, rows):
    """rows: (doc_id, text, source). Extra columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], SCHEMA)


def messy(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5)))
    passage = "\n".join(" ".join(word() for _ in range(12)) for _ in range(9))
    rows = [(None, None, None), (1, None, "a"), (2, "", "a"), (3, "  \n", "b"), (4, "x", None), (5, "one two", "b"), (None, passage, "c")]
    for i in range(6, 60):
        own = "\n".join(" ".join(word() for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 12)))
        rows.append((i, [own, own + "\n" + passage, passage + "\n" + own + "\n" + passage, passage][rng.randrange(4)], rng.choice(["a", "b", "ü", None])))
    rows += [(61, "a" * 5000, "a"), (62, "ab" * 3000, "a"), rows[-1], rows[10], rows[10]]
    rows.append((63, "\n".join(" ".join(word() for _ in range(8)) for _ in range(3000)), "a"))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return messy(spark)


def test_simhash(spark, rows):
    def print_of(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    got = Counter(tuple(r) for r in simhash.simhash_components(docs_of(spark, rows)).collect())
    prints = [print_of(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        least[find(i)] += [] if d is None else [d]
    assert got == Counter((d, f"{prints[i]:016x}", min(least[find(i)], default=None)) for i, (d, _, _) in enumerate(rows))
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0


def test_trie_links_across_cells(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    x = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(6))]))
    prints = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "node long")
    for leaf in (8, 40, 8192):
        root = {int(v): int(v) for v in x.view(np.int64)}
        find = lambda i: i if root[i] == i else find(root[i])  # noqa: E731, B023
        for a, b in simhash.links(prints, 2, leaf).collect():
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 128
            root[find(a)] = find(b)
        groups = len({find(i) for i in root})
        own = list(range(len(x)))
        top = lambda i: i if own[i] == i else top(own[i])  # noqa: E731, B023
        for i in range(len(x)):
            for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 2):
                own[top(i)] = top(int(j))
        assert groups == len({top(i) for i in range(len(x))})


def test_trie_links_in_hot_prefixes(spark):
    """Fingerprints that agree in two of three bits: prefixes pass a cell's rows, are dealt deeper and in blocks. No link may be lost."""
    rng = np.random.default_rng(5)
    base = np.concatenate([rng.integers(0, 2**20, 150, dtype=np.uint64), rng.integers(0, 2**64, 150, dtype=np.uint64)])
    flip = lambda v: v ^ (np.uint64(1) << rng.integers(0, 64, len(v), dtype=np.uint64))
    x = np.unique(np.concatenate([base, flip(base), flip(flip(base))]))
    root = {int(v): int(v) for v in x.view(np.int64)}
    find = lambda i: i if root[i] == i else find(root[i])
    for r in simhash.links(spark.createDataFrame([(v,) for v in root], "node long"), 2, 10).collect():
        root[find(r["a"])] = find(r["b"])
    own = list(range(len(x)))
    top = lambda i: i if own[i] == i else top(own[i])
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 2):
            own[top(i)] = top(int(j))
    keys = x.view(np.int64).tolist()
    assert len({(find(k), top(i)) for i, k in enumerate(keys)}) == len({find(k) for k in keys}) == len({top(i) for i in range(len(x))})


def line_chunks(t):
    """(first line, stop) of each chunk by the stated rule."""
    m60 = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    turn = lambda v, k: ((v << k) | (v >> (60 - k))) & (2**60 - 1)
    lines = t.split("\n")
    h = [m60(x) for x in lines]
    ends = [i for i in range(len(lines)) if i == len(lines) - 1 or (h[i] ^ (turn(h[i - 1], 1) if i else 0)) % 4]
    return [(i, min(min(e for e in ends if e > i), i + 15) + 1) for i in range(len(lines) - 1)]


def line_brute(rows):
    key = lambda d, t, i: ((-1 if d is None else d), hashlib.md5(t.encode()).hexdigest(), i)
    first = {}
    for d, t in rows:
        for a, e in line_chunks(t) if t is not None else []:
            c = tuple(t.split("\n")[a:e])
            first[c] = min(first.get(c, key(d, t, a)), key(d, t, a))
    want = []
    for d, t in rows:
        if t is None:
            want.append((d, None, 0, 0))
            continue
        lines, gone = t.split("\n"), set()
        for a, e in line_chunks(t):
            own = first[tuple(lines[a:e])]
            if "".join(lines[a:e]).strip(" \t\r\f\v") and not (own[:2] == key(d, t, a)[:2] and a < own[2] + e - a):
                gone.update(range(a, e))
        want.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return want


def test_line_dedup(spark, rows):
    more = [(200, "a\n" * 40 + "b", "a"), (201, "\n\n\n\n \n", "a"), (202, "\n\n\n\n \n\n", "b"), (203, "a\na\na\nb\nb", "b")]
    given = [*((d, t) for d, t, _ in rows), *((d, t) for d, t, _ in more)]
    got = linededup.line_dedup(docs_of(spark, [*rows, *more])).collect()
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got) == Counter(line_brute(given))
    # No line vanishes altogether.
    assert {x for r in got for x in (r["text"] or "").split("\n")} | {""} == {x for _, t in given for x in (t or "").split("\n")} | {""}
    assert linededup.line_dedup(docs_of(spark, [])).count() == 0


def test_line_dedup_finds_passages_between_other_neighbours(spark):
    """Passages of two to six lines, each in three texts between lines of their own: nearly all are found, with nearly all of their lines."""
    rng = random.Random(9)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(14, 30)))
    given, copies = [], {}
    for n in range(2, 7):
        for _ in range(60):
            passage = [line() for _ in range(n)]
            for k in range(3):
                given.append((len(given), "\n".join([line(), *passage, line(), line()])))
                if k:
                    copies[len(given) - 1] = n
    got = {r["doc_id"]: r["n_removed"] for r in linededup.line_dedup(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in got if i not in copies)
    assert sum(got[i] > 0 for i in copies) >= 0.9 * len(copies)
    assert sum(got[i] for i in copies) >= 0.85 * sum(copies.values())


def test_suffix_order():
    rng = np.random.default_rng(0)
    for t in range(200):
        x = rng.integers(0, int(rng.choice([1, 2, 3, 26])), int(rng.integers(1, 90))).astype(np.uint8)
        x = np.tile(x, 3) if t % 3 == 0 else x
        disk = induced.Disk(64 if t % 2 else 1 << 20)
        order = induced.suffix_order(x, 10**6, disk, base=int(rng.choice([2, 1000])))
        disk.close()
        assert order.tolist() == sorted(range(len(x)), key=lambda i, b=x.tobytes(): b[i:])


def suffix_brute(rows, width):
    count = Counter(b[i : i + width] for _, t, _ in rows for b in [(t or "").encode()] for i in range(len(b) - width + 1))
    want = Counter()
    for d, t, _ in rows:
        b, end, gone = (t or "").encode(), 0, bytearray(len((t or "").encode()))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[max(i, end) : i + width] = b"\1" * (i + width - max(i, end))
                end = i + width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want[d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept] += 1
    return want


def suffix_found(docs, **kw):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffixdedup.suffix_dedup(docs, keep=True, **kw).collect())


@pytest.mark.parametrize("width,gram", [(200, 32), (40, 8)])
def test_suffix_dedup(spark, rows, width, gram):
    assert suffix_found(docs_of(spark, rows), width=width, gram=gram, shard_bytes=20_000) == suffix_brute(rows, width)
    assert suffixdedup.suffix_dedup(docs_of(spark, [])).count() == 0


def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch):
    """A passage between different neighbours, some of which repeat in part, runs of one letter and of a short period; every row far over a shard's bytes."""
    rng, made, most = np.random.default_rng(3), [], []
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage, sides = word(150), [word(60) for _ in range(40)]
    for i in range(160):
        made.append((i, sides[rng.integers(40)][rng.integers(30) :] + passage + sides[rng.integers(40)][: rng.integers(60)] + word(int(rng.integers(50))), "a"))
    made += [(200 + i, word(20) + "-" * (60 + i) + word(20) + "ab" * (30 + i), "b") for i in range(40)]
    whole = suffixdedup.bounded

    def spy(cut, *args):
        out = whole(cut, *args)
        most.append((len(out[0]), [c.groupBy("anchor").agg(F.sum(F.octet_length("piece")).alias("n")).agg(F.max("n")).first()[0] for c in out[1]]))
        return out

    monkeypatch.setattr(suffixdedup, "bounded", spy)
    want = suffix_brute(made, 40)
    assert suffix_found(docs_of(spark, made), width=40, gram=8, shard_bytes=1000) == want
    assert most[0][0] == 3 and all((n or 0) <= 1000 for n in most[0][1])
    assert suffix_found(docs_of(spark, made), width=40, gram=8) == want
    assert most[1][0] == 1


def test_bpe(spark, rows):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(default_path()), Encoder(default_path())
    rng = random.Random(3)
    parts = ["the", "’", " ", "\n", "é", "É", "ß", "1", "'s", "'", "<|", "|>", "<|startoftext|>", "<|endoftext|>", "İ", "數", "😀", "á", "\x85", "\x1c", "ſ", "Σ"]
    texts = [None, "", " ", "xyz" * 5000, *(t for _, t, _ in rows), *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500))]
    for t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert own.encode(t) == ids and own.decode(ids) == decoded
        assert own.digest(t) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    df = docs_of(spark, rows)
    both = df.select("text", bpe_encode(df["text"], default_path()).alias("ids"), bpe_digest(df["text"], default_path(), spark).alias("x")).withColumn("back", bpe_decode(F.col("ids"), default_path())).collect()
    assert all(r["ids"] == own.encode(r["text"]) and r["x"]["n_tokens"] == len(r["ids"]) and r["back"] == own.decode(r["ids"]) for r in both)


def test_mixing(spark, rows, tmp_path):
    units = mixing.mix(docs_of(spark, rows), block_rows=4, shards=5)
    got = units.collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs_of(spark, rows).repartition(3), block_rows=4, shards=5).collect()))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    size = Counter()
    for _, t, s in rows:
        size[s] += words(t)
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, capped = {}, set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        goal = {s: 2.0 * size[s] if s in capped else level * weight[s] for s in names}
        over = {s for s in names if goal[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        assert sum(d["words"] for d in r["draws"]) == r["taken"] and all(0 <= d["shard"] < 5 for d in r["draws"])
        taken[r["source"]] += r["taken"] * r["copies"]
    assert all(goal[s] - 4 < taken[s] <= goal[s] for s in names)
    assert sum(r["copies"] for r in got) == len(rows)
    assert mixing.mix(docs_of(spark, [])).count() == 0
    mixed = mixing.mixed_documents(docs_of(spark, rows), block_rows=4, shards=5, places=True)
    assert mixed.drop("shard", "place").columns == docs_of(spark, []).columns == mixing.mixed_documents(docs_of(spark, rows)).columns
    assert sum(words(r["text"]) for r in mixed.collect()) == sum(taken.values())
    # Each task's rows lie in the order of shards and places; a shard holds what its draws say, also as a folder.
    held = Counter()
    for part in mixed.rdd.glom().collect():
        assert [(r["shard"], r["place"]) for r in part] == sorted((r["shard"], r["place"]) for r in part)
        for r in part:
            held[r["shard"]] += words(r["text"])
    want = Counter()
    for r in got:
        for d in r["draws"]:
            want[d["shard"]] += d["words"] * r["copies"]
    assert held == +want
    mixing.write_shards(docs_of(spark, rows), f"file://{tmp_path}/mix", block_rows=4, shards=5)
    assert {int(p.name.split("=")[1]) for p in (tmp_path / "mix").glob("shard=*")} == set(held)
    written = Counter((r["shard"], r["doc_id"], r["text"]) for r in spark.read.parquet(f"file://{tmp_path}/mix").collect())
    assert written == Counter((r["shard"], r["doc_id"], r["text"]) for r in mixed.collect())


def test_mixing_follows_the_tree(spark, rows):
    """The tree decides the shards: with another tree, the draws differ while the words taken stay."""
    docs = docs_of(spark, rows)
    one = {(r["doc_id"], r["fold"]): r for r in mixing.mix(docs, block_rows=4, shards=5).collect()}
    two = {(r["doc_id"], r["fold"]): r for r in mixing.mix(docs, block_rows=4, shards=5, seed=8).collect()}
    assert {k: r["size"] for k, r in one.items()} == {k: r["size"] for k, r in two.items()}
    assert any([d["shard"] for d in one[k]["draws"]] != [d["shard"] for d in two[k]["draws"]] for k in one)
    # Quotas are exact: a shard holds its share of all block copies, to within one.
    blocks = Counter()
    for r in mixing.mix(docs, block_rows=4, shards=5).select("source", "block", F.explode("draws").alias("d"), F.col("d.turn").alias("turn")).select("source", "block", "turn", "d.shard").distinct().collect():
        blocks[r["shard"]] += 1
    assert len(blocks) == 5 and max(blocks.values()) - min(blocks.values()) <= 2


def test_split_tree():
    rng = np.random.default_rng(1)
    quotas, sizes = np.array([40, 7, 0, 23]), [10, 20, 30, 10]
    tree = mixing.split_tree(quotas, sizes, rng)
    assert (tree.sum(0) == quotas).all() and (tree.sum(1) == sizes).all() and (tree >= 0).all()


def vector_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400 + i, x[7].tolist()) for i in range(30)]
    rows += [(None, x[1].tolist()), (500, None), (501, [0.0] * 8), (502, [None] + [1.0] * 7), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (7, x[7].tolist())]
    return rows, spark.createDataFrame([(i, v, "q") for i, v in rows], "vec_id long, embedding array<float>, query_id string")


def test_exact_topk(spark):
    rows, df = vector_rows(spark)
    ok = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for q, v in {i: v for i, v in ok if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    for cell in (16, 8192):
        assert sorted(map(tuple, vectors.exact_topk(df, cell_rows=cell, cell_queries=3).collect())) == sorted(want)
    assert vectors.exact_topk(df.limit(0)).count() == 0


def test_nearest(spark):
    rows, df = vector_rows(spark)
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    got = defaultdict(list)
    for r in vectors.nearest_neighbours(df, cell_rows=64, first_rows=50).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    found = 0
    queries_ = {i: v for i, v in ok if i % 100 == 0}
    assert set(got) == set(queries_)
    for q, v in queries_.items():
        want = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in ok if i != q)[:10]
        assert got[q] == sorted(got[q]) and len(got[q]) == 10
        found += len({i for _, i in want} & {i for _, i in got[q]})
    assert found >= 0.9 * 10 * len(queries_)
    assert vectors.nearest_neighbours(df.limit(0)).count() == 0


def brute_nearest(ids, v, q, k=10):
    d = np.sqrt(((v - v[q]) ** 2).sum(1))
    d[ids == ids[q]] = np.inf
    return [int(ids[j]) for j in np.lexsort((ids, d))[:k]]


@pytest.mark.parametrize("first_rows", [16, 100, 2000])
def test_nearest_recall(spark, first_rows):
    """first_rows 16: nearly all that is found comes from lists chosen by their expected hits."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = df.orderBy("vec_id").toPandas()
    ids, v = x["vec_id"].to_numpy(), np.array(x["embedding"].tolist(), np.float64)
    got = vectors.nearest_neighbours(df, first_rows=first_rows).toPandas().groupby("query_id")["vec_id"].apply(set)
    recall = [len(got[ids[i]] & set(brute_nearest(ids, v, i))) / 10 for i in np.flatnonzero(ids % 100 == 0)]
    assert np.mean(recall) >= 0.9
    seen = vectors.nearest_neighbours(df, first_rows=first_rows, count=True).groupBy().sum().first()
    assert seen[0] > 10_000 and seen[1] > 0.3 * seen[0]  # candidates are tested, and abandoned


def test_nearest_in_clusters_scans_few_lists(spark):
    """Where rows have neighbours, the share of rows that is scanned is small, and recall whole."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16)) * 10
    v = np.repeat(base, 100, 0) + rng.standard_normal((6000, 16)) * 0.1
    ids = rng.permutation(6000)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    got = vectors.nearest_neighbours(df, first_rows=300).toPandas().groupby("query_id")["vec_id"].apply(set)
    recall = [len(got[ids[i]] & set(brute_nearest(ids, v, i))) / 10 for i in np.flatnonzero(ids % 100 == 0)]
    assert np.mean(recall) >= 0.98
    seen = vectors.nearest_neighbours(df, first_rows=300, count=True).groupBy().sum().first()
    assert seen[0] < 0.15 * 60 * 6000


def test_nearest_exact_setting_and_unequal_lengths(spark):
    rng = np.random.default_rng(6)
    full = [rng.standard_normal(int(n)).round(3).tolist() for n in rng.integers(5, 12, 500)]
    v = np.array([x + [0.0] * (12 - len(x)) for x in full])
    df = spark.createDataFrame(list(enumerate(full)), "vec_id long, embedding array<double>")
    got = vectors.nearest_neighbours(df, first_rows=20, miss=0.0, sigma=float("inf")).orderBy("query_id", "rank").collect()
    ids = np.arange(500)
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(q, i) for q in range(0, 500, 100) for i in brute_nearest(ids, v, q)]


def test_url_filter(spark):
    pages = [(1, "HTTP://WWW.Example.COM/en/7?x"), (2, "http://example.com/en/81"), (3, "http://a.example.net/de/8#f"), (4, "http://example.net/de/9"), (5, "x://org/es/1"), (6, "nothing"), (7, None), (8, "http://notcom/en/1"), (None, "http://h.com?/en/")]
    pages += [(100 + i, f"http://bad.io/spam/{i}") for i in range(40)] + [(200 + i, f"http://bad.io/fine/{i}") for i in range(40)]
    labels = [(100 + i, 0, None) for i in range(40)] + [(200 + i, 1, 0) for i in range(40)] + [(None, 1, 1), (5, None, None)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.url_filter(spark.createDataFrame([(i, u, "h", "t") for i, u in pages], "page_id long, url string, host string, template string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(pages)
    assert got[1] == ("www.example.com", "/en/7", "example.com/en/7", "allow") and got[2] == ("example.com", "/en/81", "com/en/", "block")
    assert got[3] == ("a.example.net", "/de/8", "example.net/de/8", "block") and got[4][2:] == ("net/de/", "allow") and got[5][2:] == ("org/es/", "block")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][2] is None and got[None][:2] == ("h.com", "")
    assert all(got[100 + i][3] == "block" and got[200 + i][3] == "allow" for i in range(40))
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.url_filter(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_url_filter_parts_at_the_fifth_segment(spark):
    pages = [(i, f"http://deep.io/a/b/c/d/{('spam', 'fine')[i % 2]}/{i}") for i in range(80)] + [(100, "http://flat.io/a"), (101, "http://deep.io/a/b/c/d/spam/x/y/z")]
    labels = [(i, i % 2, 0) for i in range(80)]
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in urls.url_filter(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 82 and got[100] == ("allow", "/+")
    assert all(got[i] == (("block", "allow")[i % 2], f"/+/+/+/+/{('spam', 'fine')[i % 2]}/+") for i in range(80))


@pytest.mark.parametrize("split", [64, 1000, 1 << 22])
def test_warc(spark, split):
    pages = [(i, f"http://h/{i}", "<p>" + random.Random(i % 37).randbytes(300).hex() + "\r\n\r\nWARC/1.1</p>") for i in range(120)] + [(500, None, None), (501, "u", ""), (None, "u", "alone"), (None, "u", "alone"), (3, "u", "same"), (3, "u", "same")]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, digest string")
    got = Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.round_trip(spark, df, split).collect())
    last = {}
    for i, _, h in pages:
        last[h or ""] = i if last.get(h or "") is None else max(last[h or ""], i if i is not None else -1)
    want = Counter()
    for i, _, h in pages:
        b, own = (h or "").encode(), last[h or ""]
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == own else "revisit", None if i == own else own] += 1
    assert got == want
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_long_record_and_false_starts(spark):
    """A record of 12 MB that hardly compresses; magic bytes inside a payload start nothing."""
    long_ = random.Random(1).randbytes(6 << 20).hex()
    magic = b"\x1f\x8b\x08\x00".decode("latin-1") * 50
    df = spark.createDataFrame([(1, "u", long_), (2, "u", magic), (3, "u", "x")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.round_trip(spark, df, 1 << 20).collect()}
    assert got == {i: (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, h in ((1, long_), (2, magic), (3, "x"))}


def test_warc_text(spark):
    df = spark.createDataFrame([(1, "http://a/1", "ä<p>")], "page_id long, url string, html string")
    from orrery.llm.common import scratch

    row = warc.read(warc.write(warc.classify(df), scratch(spark, "w"))).first()
    assert bytes(row["payload"]).decode() == "ä<p>" and row["url"] == "http://a/1"


def test_toxicity(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        text = [word() for _ in range(rng.randrange(5, 60))]
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", f"zorg{word()}"]))
        rows.append((i, " ".join(text), "s"))
        labels.append((i, 1, int(bad)))
    rows += [(None, None, None), (1000, "", "s"), (1001, "x" * 100_000, "s")]
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: (r["h"], r["s"]) for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h"), toxicity.toxicity(docs["text"], model, spark).alias("s")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, (h, _) in got.items() if i is not None)
    held = [(s >= 0.5) == (i % 6 == 0) for i, (h, s) in got.items() if i is not None and i < 900 and h]
    assert sum(held) / len(held) >= 0.95
    assert got[1000][1] == got[None][1] < 0.5
    # Scores, recomputed from the weights by the stated features.
    for t in ("you idiot", "zorgabc zorgfed", rows[0][1], "", None):
        words = set(re.findall(r"[^\W\d_]+", (t or "").lower()))
        runs = Counter(f for w in words for f in {f"={w}", *(f"^{w}"[i : i + n] for n in (4, 5, 6) for i in range(len(w) + 2 - n))})
        have = set(runs) | {f"{k}{f}" for f, n in runs.items() if f[0] == "^" for k in (2, 3, 4, 6) if n >= max(k, 2)}
        z = model.bias + sum(model.weights.get(zlib.crc32(f.encode()), 0.0) for f in have)
        assert abs(model.score(t) - 1 / (1 + np.exp(-z))) < 1e-9
    # Held-out labels change no score.
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    turned = toxicity.fit(docs, spark.createDataFrame([(i, 1, 1 - y if out(i) else y) for i, _, y in labels], "doc_id long, quality int, toxic int"))
    assert turned.weights == model.weights and turned.bias == model.bias
    # Repeated rows and extra columns change nothing; an empty table leaves the fixed lists.
    twice = toxicity.fit(docs.union(docs), spark.createDataFrame(labels + labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("idiot")))
    assert twice.weights == model.weights
    none = toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.score("you idiot") > 0.5 > none.score(None)
    # Without labels, the fixed voters' posterior labels teach the classifier.
    alone = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert alone.score("you idiot") > 0.5 > alone.score("hello")


def test_label_model_tells_voters_apart():
    """Two copies of a bad voter don't outvote a good one; rows without a label get posteriors; wrong labels are overruled."""
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    flip = lambda p: np.where(rng.random(4000) < p, ~y, y).astype(float)
    good, bad = flip(0.03), flip(0.35)
    votes = np.stack([good, flip(0.05), bad, np.where(rng.random(4000) < 0.02, 1 - bad, bad)], 1)
    gold = np.where(rng.random(4000) < 0.3, np.where(rng.random(4000) < 0.02, ~y, y).astype(int), -1)
    post = toxicity.label_model(votes, gold)
    assert ((post > 0.5) == y)[gold < 0].mean() > 0.95 and ((post > 0.5) == y)[gold >= 0].mean() > 0.97
    crowd = (votes.mean(1) > 0.5) == y
    assert ((post > 0.5) == y)[gold < 0].mean() > crowd[gold < 0].mean()


def test_mined_lists_never_see_the_label_of_the_row(spark):
    """A word that stands in one text alone can't make that text's own vote."""
    base = [(i, f"plain words of row {'idiot' if i % 5 == 0 else 'x'} only{i}", "s") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: (r["gold"], r["half"]) for r in toxicity.learned_rows(docs_of(spark, base), labels.filter("doc_id < 150"), "doc_id", "text", "toxic", 6000, 20).collect()}
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows)
    assert sum(g is None for g, _ in rows.values()) == 20 and {h for _, h in rows.values()} == {0, 1}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in at) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def shingle_sets(texts, n=5):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    return [frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset() for w in words]


def near_components(rows, least=0.8):
    """Smallest id that pairs of Jaccard similarity ``least`` reach, for each (id, text)."""
    sets = shingle_sets([t for _, t in rows])
    distinct = list(dict.fromkeys(sets))
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if len(x & y) >= least * len(x | y) > 0:
                root[find(x)] = find(y)
    best = {}
    for (i, _), s in zip(rows, sets, strict=True):
        best[find(s)] = min(x for x in (best.get(find(s)), i) if x is not None) if i is not None else best.get(find(s))
    return [best[find(s)] for s in sets]


def test_near_stage_keeps_one_of_each_group(spark, rows):
    docs = docs_of(spark, [*rows, rows[8], (None, rows[8][1], "z")])
    kept = drop_near(spark, docs, SF).collect()
    reps = near_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in kept) == sorted(set(reps))
    alone = docs_of(spark, [(None, "one two three four", "a"), (None, "one two three four", "b")])
    assert drop_near(spark, alone, SF).count() == 1


def test_near_stage_keeps_unlike_texts_of_one_id(spark):
    docs = docs_of(spark, [(7, "one two three four five", "a"), (7, "six seven eight nine ten", "a"), (7, "one two three four FIVE", "b"), (9, "six seven eight nine ten", "a")])
    assert sorted(r["text"].lower() for r in drop_near(spark, docs, SF).collect()) == ["one two three four five", "six seven eight nine ten"]


@pytest.mark.parametrize("leaf", [16, 4096])
def test_near_groups_against_all_pairs(spark, leaf):
    """Copies with edits, clean texts and one group of a third of all rows; leaf 16 makes many tries, cells and blocks."""
    rng = random.Random(leaf)
    text = lambda: [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 200))]

    def edited(words):
        return [f"e{rng.random()}" if rng.random() < 0.01 else w for w in words]

    hot = text()
    data = [edited(hot) for _ in range(100)] + [w for _ in range(40) for base in [text()] for w in (base, edited(base))] + [text() for _ in range(120)]
    rng.shuffle(data)
    given = [(i, " ".join(w)) for i, w in enumerate(data)]
    rows, best = neardup.near_groups(spark.createDataFrame(given, "doc_id long, text string"), leaf=leaf)
    got = {r["doc_id"]: r["_best"] for r in rows.join(best, "_node").collect()}
    want = near_components(given)
    assert len(got) == len(given)
    differ = sum(got[i] != w for (i, _), w in zip(given, want, strict=True))
    assert differ <= 3 and all(want[got[i]] == w for (i, _), w in zip(given, want, strict=True))  # a link may be missed, none is made up


def test_near_hot_group_below_the_least_similarity(spark):
    """Texts alike at about 0.72 by their template, with pairs above 0.8 among them: failing candidates hide none of these."""
    rng = random.Random(3)
    shared = [f"w{rng.randrange(10**6)}" for _ in range(336)]
    own = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    data = [shared + own(60) for _ in range(800)]
    data += [w[:-40] + own(40) for w in data[:80]]
    given = [(i, " ".join(w)) for i, w in enumerate(data)]
    want = [*range(800), *range(80)]
    rows, best = neardup.near_groups(spark.createDataFrame(given, "doc_id long, text string"))
    got = {r["doc_id"]: r["_best"] for r in rows.join(best, "_node").collect()}
    assert sum(got[i] != w for (i, _), w in zip(given, want, strict=True)) <= 2


def test_near_short_texts(spark):
    """Short texts with one word more (Jaccard 0.8) are linked, those at 0.75 aren't."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    data = [w for _ in range(60) for base in [words(8)] for w in (base, [*base, *words(1)])]
    data += [w for _ in range(60) for base in [words(10)] for w in (base, [*base, *words(2)])]
    data += [w for n in (67, 75) for _ in range(20) for base in [words(n)] for w in (base, [*words(7), *base])]
    given = [(i, " ".join(w)) for i, w in enumerate(data)]
    want = near_components(given)
    assert len(set(want)) == 60 + 120 + 40
    for leaf in (16, 4096):
        rows, best = neardup.near_groups(spark.createDataFrame(given, "doc_id long, text string"), leaf=leaf)
        got = {r["doc_id"]: r["_best"] for r in rows.join(best, "_node").collect()}
        assert [got[i] for i, _ in given][:240] == want[:240]
        assert sum(got[i] != w for (i, _), w in zip(given, want, strict=True)) <= 1


def test_sketch_estimates_similarity():
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    other = [f"x{i}" if i % 40 == 0 else w for i, w in enumerate(base)]
    x, y = shingle_sets([" ".join(base), " ".join(other)])
    bits = [np.frombuffer(neardup.sketch(" ".join(w).encode()), np.uint64) for w in (base, other)]
    assert abs(np.bitwise_count(bits[0] ^ bits[1]).sum() / 1024 - neardup.apart(len(x & y) / len(x | y))) < 0.04
    assert neardup.sketch(None) == neardup.sketch(b" \n") == bytes(128)
    assert neardup.sketch(b"A b") == neardup.sketch(b"a\tB") != neardup.sketch(b"a c")


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = drop_toxic(spark, docs, SF)
    lines = drop_lines(spark, clean, SF)
    near = drop_near(spark, lines, SF)
    mixed = mix_sources(spark, near, SF)
    assert clean.columns == lines.columns == near.columns == mixed.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in linededup.line_dedup(clean).collect()}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == kept
    reps = set(near_components([(r["doc_id"], r["text"]) for r in lines.collect()]))
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(reps)
    own = Encoder(default_path())
    want = Counter((r["doc_id"], *own.digest(r["text"])) for r in mixed.collect())
    assert Counter(map(tuple, tokenize(spark, mixed, SF).collect())) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want
    for stage in (drop_toxic, drop_lines, drop_near, mix_sources, tokenize):
        assert stage(spark, docs.limit(0), SF).count() == 0
