"""Ranked search, source divergence and token files against brute force."""

import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest

from arealis.llm import divergence, queries, ranking, wavelet
from arealis.llm import words as W

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, long terms and texts, with extra columns of clashing names."""
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["École", "ÄÖü", "日本語", "it's", "A1b2", "x" * 8, "y" * 9, "z" * 16, "q" * 17, "long" * 30, "long" * 29 + "lonh", "ﬁ"]
    langs, sources = ["en", "de", None, ""], ["s1", "s2", "s3", None]
    rows = [(None, "wa wb École", "en", "s1"), (1, None, "en", "lonely"), (2, "", "fr", "s1"), (3, " \t\n", None, None), (4, "one", "en", "s1"), (4, "one", "en", "s1"), (5, "x" * 70_000 + " y", "de", "s2"), (6, " ".join(rng.choices(words, k=9000)), "de", "s1")]
    for i in range(7, 160):
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words[: rng.choice([5, 40, 312])], k=rng.choice([1, 3, 30, 200]))), rng.choice(langs), rng.choice(sources)))
    rows += [(300, rows[30][1], "en", "s1"), (9, rows[31][1], "de", "s2"), (None, None, None, None)]
    columns = "doc_id long, text string, lang string, source string, term string, n long, item_id long, part int, value long"
    return rows, spark.createDataFrame([(*r, "t", 1, 2, 3, 4) for r in rows], columns).repartition(3)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expect_ranks(docs, items, k=10):
    split = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs)]
    n_docs, total, df = sum(n > 0 for _, _, n in split), sum(n for _, _, n in split), Counter(t for _, c, _ in split for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in split:
            if n:
                m = 100 - 75 + (75 * n * n_docs) // total
                s = sum(int(math.floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1)))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text))
                if s > 0:
                    scored.append((-s, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_search(spark, odd, monkeypatch):
    rows, df = odd
    items = [(1, "waa wba wca École"), (2, rows[7][1]), (3, None), (4, ""), (5, "nothing here x9x9"), (6, "one one ONE one"), (7, rows[40][1]), (7, rows[41][1]), (None, rows[42][1]), (8, "x" * 70_000)]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    want = order(expect_ranks([r[:2] for r in rows], items))
    shards = ranking.index(df)
    assert order(tuple(r) for r in ranking.search(shards, bench).collect()) == want
    assert order(tuple(r) for r in ranking.search(shards, bench, block_bytes=600).collect()) == want  # several blocks
    assert order(tuple(r) for r in ranking.search(ranking.index(df, size=3000), bench, k=3).collect()) == order(x for x in want if x[1] <= 3)
    assert ranking.search(shards, bench.limit(0)).count() == 0
    assert ranking.search(ranking.index(df.limit(0)), bench).count() == 0
    monkeypatch.setattr(ranking, "CELLS", 64)  # few documents at a time
    assert order(expect_ranks([r[:2] for r in rows[:30]], items)) == order(tuple(r) for r in _local(rows[:30], items))


def _local(docs, items, k=10):
    """The search of one task, without Spark."""
    import pyarrow as pa

    text = pa.array([r[1] for r in docs], pa.string())
    buf, ends = W.buffers(text)
    w = W.Words(W.LOWER[buf], ends, W.NOT_ALNUM)
    ids = np.array([ranking.NO_ID if r[0] is None else r[0] for r in docs])
    shard = ranking.Shard({"ids": ids.tobytes(), "counts": w.counts().tobytes(), "ends": ends.tobytes(), "text": buf.tobytes(), "classes": ranking.signatures(w)})
    held = ranking.Items(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}))
    n = int((w.counts() > 0).sum())
    held.weigh(n, np.bincount(shard.frequencies(np.arange(len(ids)), held.terms)[1], minlength=len(held.terms)))
    found = ranking.Search(held, n, int(w.counts().sum()), k)
    found.see(shard)
    return [(items[i][0], r + 1, None if d == ranking.NO_ID else d, -s) for i, best in enumerate(found.best) for r, (s, d) in enumerate(best)]


def test_bounds_hold(odd):
    """No score exceeds its bound, for every item and document."""
    import pyarrow as pa

    rows, _ = odd
    docs = [r for r in rows if r[1]]
    buf, ends = W.buffers(pa.array([r[1] for r in docs], pa.string()))
    w = W.Words(W.LOWER[buf], ends, W.NOT_ALNUM)
    held = ranking.Items(pa.table({"item_id": pa.array([1, 2], pa.int64()), "text": pa.array([rows[7][1], rows[50][1]], pa.string())}))
    held.weigh(len(docs), np.arange(len(held.terms)) % 7)
    search, total = ranking.Search(held, len(docs), len(w), 3), 0
    shard = ranking.Shard({"ids": b"", "counts": w.counts().tobytes(), "ends": ends.tobytes(), "text": buf.tobytes(), "classes": ranking.signatures(w)})
    for c in shard.classes:
        members = np.frombuffer(c["members"], np.int32).astype(np.int64)
        slices = [(np.frombuffer(s["bits"], np.uint8).reshape(s["rows"], -1), ranking.probes(search.heads, s["rows"])) for s in c["slices"]]
        bound = search.bounds(slices, 0, shard.counts[members])
        doc, term, tf = shard.frequencies(members, held.terms)
        parts = np.zeros((len(members), len(held.terms)), np.int64)
        parts[doc, term] = ranking.impact(tf, ranking.lengths(shard.counts[members], len(docs), len(w))[doc])
        for i in range(2):
            of, weight = held.of(i)
            exact = parts[:, of] @ weight
            assert (bound[i] >= exact).all()
            total += int((bound[i] == 0).sum())
    assert total > 0  # and some documents are excluded


def test_shards_alone(spark, odd):
    """A task writes, reads and searches one shard after another, however many it has."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows, df = odd
    shards = ranking.index(df.coalesce(1), size=3000)
    files = [pq.read_metadata(f.removeprefix("file://")) for f in shards.inputFiles()]
    assert len(files) == 1 and files[0].num_rows > 20
    assert [files[0].row_group(i).num_rows for i in range(files[0].num_row_groups)] == [1] * files[0].num_rows
    # a writer holds the statistics of all groups of its file, and with them the shards' texts
    columns = [files[0].row_group(i).column(j) for i in range(files[0].num_row_groups) for j in range(files[0].num_columns)]
    assert not any(c.is_stats_set and c.statistics.has_min_max for c in columns)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key)
    with ranking.arrow_bytes(spark, 1):
        most = [r.n for r in shards.select("ids", "counts", "ends", "text", "classes").mapInArrow(count, "n long").collect()]
    assert sum(most) == files[0].num_rows and max(most) == 1 and spark.conf.get(key) == had
    items = [(1, "waa wba wca École"), (2, rows[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert order(tuple(r) for r in ranking.search(shards, bench).collect()) == order(expect_ranks([r[:2] for r in rows], items))


def expect_audit(docs, least=10, top=10):
    count, langs, have = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        ws = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang, source].update(ws)
        langs[lang].update(ws)
        have[lang].update(set(ws))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in have[lang].items() if n >= least]

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q, p = share(langs[lang]), {s: share(count[lang, s]) for g, s in groups if g == lang}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in p:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in p if o != s)
            over = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, r + 1) for part, found in (("pair", pairs), ("term", over)) for r, (v, i) in enumerate(found)]
    return out


def test_audit(spark, odd, monkeypatch):
    rows, df = odd
    want = order(expect_audit([r[1:4] for r in rows]))
    assert order(tuple(r) for r in divergence.audit(df).collect()) == want
    assert {x[2] for x in want} == {"pair", "term"}
    assert divergence.audit(df.limit(0)).count() == 0
    # nothing kept: all pairs are 0 apart
    assert order(tuple(r) for r in divergence.audit(df, least=10_000).collect()) == order(expect_audit([r[1:4] for r in rows], least=10_000))
    monkeypatch.setattr(divergence, "BUCKET_ROWS", 100)
    assert order(tuple(r) for r in divergence.audit(df, least=2).collect()) == order(expect_audit([r[1:4] for r in rows], least=2))


def test_blocks_of_sources():
    """Sources of a language in several blocks give the sums of one block."""
    import pyarrow as pa

    rng, size = np.random.default_rng(2), 2 * divergence.BLOCK + 3
    p = np.where(rng.random((size, 40)) < 0.3, rng.integers(10, 10**9, (size, 40)), 5)
    x, t = np.nonzero(p != 5)
    table = pa.table({"lang": ["l"] * (len(x) + size), "a": [0] * (len(x) + size), "b": [0] * (len(x) + size), "place": np.concatenate([x, np.arange(size)]), "term": [f"t{k}" for k in t] + [None] * size, "p": np.concatenate([p[x, t], np.full(size, 5)])})
    got = {}
    for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)):
        keep = np.isin(table.column("place").to_numpy() // divergence.BLOCK, [a, b])
        some = table.filter(pa.array(keep)).set_column(1, "a", pa.array([a] * int(keep.sum()))).set_column(2, "b", pa.array([b] * int(keep.sum())))
        for r in divergence.compared(some).to_pylist():
            assert (r["x"], r["y"]) not in got
            got[r["x"], r["y"]] = r["value"]
    assert len(got) == size * (size - 1) // 2
    for x, y in [(0, 1), (3, divergence.BLOCK), (divergence.BLOCK, size - 1), (5, size - 2)]:
        assert got[x, y] == sum(int((a - b) ** 2 // (a + b)) for a, b in zip(p[x].tolist(), p[y].tolist()))


def test_radix_order():
    rng = np.random.default_rng(1)
    for high in (3, 1 << 20, 1 << 63):
        a, b = (rng.integers(0, high, 500).astype(np.uint64) for _ in range(2))
        assert np.array_equal(divergence.radix_order([a, b]), np.lexsort((b, a)))
    assert len(divergence.radix_order([np.zeros(0, np.uint64)])) == 0


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_source_divergence"])
def test_queries_equal_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    cur = con.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert order(tuple(r) for r in df.select(*names).collect()) == order(cur.fetchall())


def test_token_matrix(spark, odd):
    from tokenizers import Tokenizer

    rows, df = odd
    t = Tokenizer.from_file(queries.tokenizer())
    encoded = [(math.inf if i is None else i, [*t.encode(text or "", add_special_tokens=False).ids, 2]) for i, text, *_ in rows]
    crc = lambda ids, kind: zlib.crc32(np.array(ids, kind).tobytes())
    encoded.sort(key=lambda x: (x[0], len(x[1]), crc(x[1], "<u2")))
    want, stream, where = [], [], []
    for i, ids in encoded:
        want.append((None if i == math.inf else i, len(stream), len(ids), crc(ids, "<u4")))
        where += [(None if i == math.inf else i, k) for k in range(len(ids))]
        stream += ids
    for size in (1 << 22, 500):
        index, path = wavelet.archive(df, queries.tokenizer(), shard_tokens=size)
        got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in wavelet.read(index, path).collect()]
        assert sorted(got, key=lambda x: x[1]) == want
        some = sorted(set(stream))[:3] + [2, 49_000]
        assert {r.token: r.n for r in wavelet.counts(index, path, some).collect()} == {s: stream.count(s) for s in some}
        assert sorted((r.token, r.at, r.doc_id, r.place) for r in wavelet.occurrences(index, path, [2, stream[5]]).collect()) == sorted((s, k, *where[k]) for s in {2, stream[5]} for k, x in enumerate(stream) if x == s)
        places = [0, 1, len(stream) // 2, len(stream) - 1]
        asked = spark.createDataFrame([(p,) for p in [*places, -1, len(stream), 0]], "at long")
        assert {r["at"]: r.token for r in wavelet.tokens_at(index, path, asked, width=700).collect()} == {p: stream[p] for p in places}
    index, path = wavelet.archive(df.limit(0), queries.tokenizer())
    assert wavelet.read(index, path).count() == 0


def test_wavelet_matrix(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 16)
    rng = np.random.default_rng(4)
    for n, high, kind in ((0, 5, np.uint16), (1, 1, np.uint16), (7, 2, np.uint16), (1000, 7, np.uint16), (3000, 49_000, np.uint16), (900, 1 << 20, np.uint32)):
        ids = rng.integers(0, high, n).astype(kind)
        blob = wavelet.encode(ids, np.array([n // 3, n - n // 3]), np.array([4, 9]))
        shard = wavelet.Shard(io.BytesIO(blob), len(blob))
        assert np.array_equal(shard.all(), ids) and shard.sizes.tolist() == [n // 3, n - n // 3] and shard.doc_ids.tolist() == [4, 9]
        places = rng.integers(0, n, 40) if n else np.zeros(0, int)
        assert np.array_equal(shard.access(places), ids[places])
        for token in {*ids[:10].tolist(), high, high + 3, 1 << 40}:
            at = np.flatnonzero(ids == token)
            assert shard.count(token) == len(at) and np.array_equal(shard.occurrences(token), at)
            lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
            assert shard.count(token, lo, hi) == int((ids[lo:hi] == token).sum())
        with pytest.raises(IndexError):
            shard.access(np.array([n]))
        with pytest.raises(IndexError):
            shard.select(0, np.array([shard.count(0)]))


def test_benchmark_blocks_hold_their_limit(spark, monkeypatch):
    """Two thousand items with one text lie in blocks of bounded bytes, and all of them are found."""
    from arealis.llm import batches, suffixes

    text = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(i, text) for i in range(2000)] + [(5000, "other words " * 8)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {text} then"), (2, "nothing here"), (3, None), (4, "other words " * 5)], "doc_id long, text string")
    seen, made = [], suffixes.Tests

    def counted(table, window):
        seen.append(table.num_rows)
        return made(table, window)

    held, blocks = batches.blocked(bench, batches.F.octet_length("text") + 20, 20_000, "tests")
    sizes = [r.b for r in held.groupBy("block").agg(batches.F.sum(batches.F.octet_length("text") + 20).alias("b")).collect()]
    assert blocks > 4 and max(sizes) <= 20_000 + len(text) + 20
    monkeypatch.setattr(suffixes, "Tests", counted)
    got = {r.doc_id: r for r in suffixes.decontaminate(docs, bench, block_bytes=20_000).collect()}
    assert [len(got[i]["items"]) for i in (1, 2, 3, 4)] == [2000, 0, 0, 1]
    whole = {r.doc_id: r for r in suffixes.decontaminate(docs, bench).collect()}
    for i in (1, 2, 3, 4):
        assert got[i].hit == whole[i].hit and got[i]["items"] == whole[i]["items"] and got[i].n_words == whole[i].n_words
        assert {tuple(m)[:2] for m in got[i].matches} == {tuple(m)[:2] for m in whole[i].matches}


def test_very_long_names(spark):
    """A name of ten thousand letters, with dictionary words of all lengths that it doesn't have, takes seconds."""
    import time

    from arealis.llm import urls

    rng = random.Random(1)
    name = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10_000))
    words = [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), 3) for n in range(2, 2000, 3)] + [(name[100:140], 50), (name[5000:5009], 7), ("cheap", 9), ("pills", 9), (name[9000:9008] + "zzz", 5)]
    counts = spark.createDataFrame(words, "word string, n long")
    names = spark.createDataFrame([(name,), ("cheappills",)], "name string")
    began = time.time()
    got = {r.name: r.words for r in urls.segmented(names, counts).collect()}
    assert time.time() - began < 60
    assert "".join(got[name]) == name and name[100:140] in got[name] and got["cheappills"] == ["cheap", "pills"]
    short = name[60:200]
    total = sum(n for _, n in words)
    found = [(i, len(w), n) for w, n in words for i in range(len(short)) if short.startswith(w, i)]
    assert {r.name: r.words for r in urls.segmented(spark.createDataFrame([(short,)], "name string"), counts).collect()}[short] == urls.viterbi(short, found, total)


def test_hot_text_over_many_batches(spark, monkeypatch):
    """One long text copied into very many batches: all copies are one component."""
    from arealis.llm import batches, jaccard

    monkeypatch.setattr(batches, "BATCH_BYTES", 30_000)
    text = " ".join(f"v{i}" for i in range(3000))
    rows = [(i, text) for i in range(40)] + [(100 + i, text + f" tail{i}") for i in range(10)] + [(500, "quite another text of some words")]
    got = {r.doc_id: r.component_id for r in jaccard.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert {got[i] for i in [*range(40), *range(100, 110)]} == {0} and got[500] == 500


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rare_near_copies_are_found(seed):
    """Twenty near copies of a graph's nodes, just above the threshold, among 8192 other vectors of another shard."""
    from arealis.llm import ann

    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    nodes = unit(rng.normal(size=(6000, 64)))
    graph = ann.Graph(nodes, np.arange(6000))
    wide = graph.needed_beam(0.95, 4, 0.99, ann.PROBES)
    assert wide > 4  # the given beam loses links, and random vectors alone would not show it
    q, of = unit(rng.normal(size=(8192, 64))), rng.choice(6000, 20, replace=False)
    away = rng.normal(size=(20, 64))
    away = unit(away - np.einsum("ij,ij->i", away, nodes[of])[:, None] * nodes[of])
    c = rng.uniform(0.951, 0.96, (20, 1))
    q[:20] = c * nodes[of] + np.sqrt(1 - c * c) * away
    found = {r: f.tolist() for r, f in graph.within(q[:512], 0.95, wide)}
    assert sum(of[i] in found.get(i, []) for i in range(20)) >= 19
