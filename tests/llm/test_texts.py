"""Operators over documents against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import pytest

from arealis.llm import jaccard, languages, packing, queries, scoring, substrings, suffixes

WORD = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, junk, long texts and near copies, with extra columns of clashing names."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["École", "ÄÖ", "x\u00a0y", "日本語", "it's", "A1", "<|endoftext|>", "ﬁ"]
    base = [rng.choices(words, k=rng.choice([1, 3, 4, 5, 12, 13, 14, 40, 90])) for _ in range(12)]
    rows = [(None, "a b c d e f g h i j k l m n o"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "x" * 70_000 + " y"), (6, "\n".join(rng.choices(words, k=9000)))]
    for i in range(7, 150):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(t)))
    rows += [(200, rows[30][1]), (7, rows[8][1]), (None, None)]
    df = spark.createDataFrame([(i, t, 9, "s", i, t) for i, t in rows], "doc_id long, text string, n long, source string, node long, kept_text string")
    return rows, df.repartition(3)


def expect_repeats(rows, length=13):
    first, out = {}, []
    split = [(i, re.findall(WORD, t or "")) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - length + 1):
            k, key = tuple(w[p : p + length]), float("inf") if i is None else i
            first[k] = min(first.get(k, key), key)
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < (float("inf") if i is None else i):
                gone[p : p + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


def test_repeats(spark, odd):
    rows, df = odd
    got = [(r.doc_id, r.n_words, sum(x.length for x in r.repeats), r.kept_text) for r in substrings.repeats(df).collect()]
    assert sorted(got, key=key) == sorted(expect_repeats(rows), key=key)
    assert substrings.repeats(df.limit(0)).count() == 0


def test_repeats_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = {(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in expect_repeats([(r.doc_id, r.text) for r in docs])}
    assert {tuple(r) for r in queries.op2_substring_dedup(spark, "/root/testdata/sf0.01").collect()} == want


def expect_links(rows):
    sets = []
    for i, t in rows:
        w = re.findall(WORD, (t or "").translate(ASCII_LOWER))
        sets.append((i, {tuple(w[p : p + 5]) for p in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                r, s = sorted((find(a), find(b)))
                up[s] = r
    return [(i, len(x), None if i is None else find(i)) for i, x in sets]


def test_links(spark, odd):
    rows, df = odd
    got = [tuple(r) for r in jaccard.links(df).collect()]
    assert sorted(got, key=key) == sorted(expect_links(rows), key=key)
    assert jaccard.links(df.limit(0)).count() == 0


def test_links_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert {tuple(r) for r in queries.op4_jaccard_join(spark, "/root/testdata/sf0.01").collect()} == set(expect_links([(r.doc_id, r.text) for r in docs]))


def test_links_at_the_threshold(spark):
    """Pairs just at and just below 0.75, for many sizes: PartEnum must miss none."""
    rng, rows = random.Random(1), []
    for k in range(120):
        n = rng.choice([5, 6, 8, 11, 20, 33, 64, 150, 400])
        w = [f"{k}v{j}" for j in range(n)]
        rows.append((2 * k, " ".join(w)))
        shingles, cut = n - 4, 0
        while True:  # cut words at the end until the pair would no longer link
            left = shingles - cut - 1
            if left < 1 or 100 * left < 75 * shingles:
                break
            cut += 1
        cut += k % 2 if n - cut > 6 else 0
        rows.append((2 * k + 1, " ".join(w[: n - cut])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in jaccard.links(df).collect()) == sorted(expect_links(rows))


def test_links_with_frequent_passages(spark):
    """Documents that share a passage but don't link, and a chain whose ends don't link with its head."""
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([f"{i}a{j}" for j in range(rng.randrange(30, 60))] + passage + [f"{i}b{j}" for j in range(20)])) for i in range(60)]
    w = [f"c{j}" for j in range(120)]
    for i in range(12):
        rows.append((100 + i, " ".join(w[i * 8 : i * 8 + 100 - 8 * (i % 2)])))
        w += [f"d{i}_{j}" for j in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard.links(df).collect()) == sorted(expect_links(rows))


def expect_hits(rows, items, n=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for p in range(max(len(w) - n, 0) + 1 if w else 0):
            windows[tuple(w[p : p + n])].add(i)
    out = []
    for i, t in rows:
        w, found = words(t), set()
        hit = [False] * len(w)
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if (k := tuple(w[p : p + size])) in windows:
                    hit[p : p + size] = [True] * size
                    found |= windows[k] - {None}
        ids = sorted(map(str, found))
        out.append((i, len(w), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), sum(hit) > 0))
    return out


def test_decontaminate(spark, odd):
    rows, df = odd
    items = [(1, rows[20][1]), (2, "w1"), (10, None), (None, rows[25][1]), (11, "..."), (3, rows[21][1]), (3, rows[21][1]), (4, rows[26][1])]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    hit = suffixes.n_hit()
    from pyspark.sql import functions as F

    for block in (32 << 20, 200):
        out = suffixes.decontaminate(df, bench, block_bytes=block).select("doc_id", "n_words", hit, F.size("items"), F.sha2(F.array_join("items", ","), 256), hit > 0)
        assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(expect_hits(rows, items), key=key)
    texts = {str(i): re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER)) for i, t in items}
    for r in suffixes.decontaminate(df, bench).where("doc_id is not null and size(matches) > 0").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.translate(ASCII_LOWER))
        for m in r.matches:
            there = texts[str(m.item_id)]
            assert w[m.start : m.start + m.length] == there[m.item_start : m.item_start + m.length]
            after = [(a, b) for i, a in enumerate(texts.values()) for b in range(len(a)) if a[b : b + m.length + 1] == w[m.start : m.start + m.length + 1] and len(w) > m.start + m.length]
            assert not after  # no item has a longer one
    assert suffixes.decontaminate(df, bench.limit(0)).where(hit > 0).count() == 0


def test_decontaminate_on_table(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = expect_hits([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert sorted(tuple(r)[:6] for r in queries.op6_decontaminate(spark, small).collect()) == sorted(want)
    assert any(x[5] for x in want)


def expect_pieces_ok(rows, got, length=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    import numpy as np

    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length, r))
    n, docs = len(sequences), Counter()
    stream = []
    for s in range(n):
        at = 0
        for offset, size, r in sorted(sequences[s], key=lambda x: x[0]):
            assert offset == at and size > 0
            at += size
            stream.append(r)
        assert at == length or s == n - 1
    held = b""
    for r in stream:
        assert r.start * 4 == len(held)
        held += bytes(r.ids)
        if len(held) == 4 * r.doc_tokens:
            docs[(r.doc_id, r.doc_tokens, zlib.crc32(held))] += 1
            held = b""
    assert not held and docs == want


def test_packing(spark, odd, small):
    rows, df = odd
    expect_pieces_ok(rows, packing.pack(df, queries.tokenizer()).collect())
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(3)
    expect_pieces_ok([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs, queries.tokenizer(), length=512).collect(), 512)
    assert packing.pack(df.limit(0), queries.tokenizer()).count() == 0
    assert [packing.padded_length(x) for x in (1, 3, 1024, 2047)] == [1, 2048, 1024, 2048]


def held_out(i, parts, which):
    return i is None or zlib.crc32(str(i).encode()) % parts == which


def test_scores(spark, odd, monkeypatch):
    rows, df = odd
    tokens = [(i, [*re.findall(WORD, (t or "").translate(ASCII_LOWER)), None]) for i, t in rows]
    train = [w for i, w in tokens if not held_out(i, 7, 2)]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    twos = Counter(p for w in train for p in zip(["<s>", *w], w))
    threes = Counter(p for w in train for p in zip(["<s>", *w], w, w[1:]))
    c["<s>"] = len(train)

    def p(u, h, x, k=(5.0, 3.0), g=(0.7, 0.5)):
        out = (c[x] + 1) / (n + v + 1)
        if c[h]:
            m = k[0] * c[h] ** g[0]
            out = (twos[h, x] + m * out) / (c[h] + m)
        if u is not None and twos[u, h]:
            m = k[1] * twos[u, h] ** g[1]
            out = (threes[u, h, x] + m * out) / (twos[u, h] + m)
        return out

    def model(w):
        return sum(log10(p(None if j == 0 else ["<s>", *w][j - 1], ["<s>", *w][j], x)) for j, x in enumerate(w))

    want = [(i, held_out(i, 7, 2), len(w), sum(c[x] > 0 for x in w), n, sum(log10((c[x] + 1) / (n + v + 1)) for x in w), model(w)) for i, w in tokens]
    for segment, size in ((256, 8 << 20), (3, 3000)):
        monkeypatch.setattr(scoring, "SEGMENT", segment)
        batches = scoring.B.stored_batches
        monkeypatch.setattr(scoring.B, "stored_batches", lambda d, i, t, size=size, batches=batches: batches(d, i, t, size))
        got = scoring.score(df).collect()
        monkeypatch.setattr(scoring.B, "stored_batches", batches)
        assert len(got) == len(want)
        for g, x in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key)):
            assert g[:5] == x[:5] and g[5] == pytest.approx(x[5]) and g[6] == pytest.approx(x[6])
    # the model is a distribution: tokens and one unseen kind sum to 1 after every history
    kinds = [x for x in c if x != "<s>"] + ["unseen"]
    for u, h in [(None, "<s>"), *[x for x in twos if x[1] is not None][:20]]:
        assert sum(p(u, h, x) for x in kinds) == pytest.approx(1)
    assert scoring.score(df.limit(0)).count() == 0


def test_scores_beat_the_base(spark):
    got = [r for r in queries.op9_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    bigram = [r for r in scoring.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), strength=(5.0, 1e12)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.score for r in bigram)


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in queries.op10_language_id(spark, "/root/testdata/sf0.01").collect()]
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(got) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_odd(spark, odd):
    rows, df = odd
    from pyspark.sql import functions as F

    taught = languages.learn(df.withColumn("lang", F.when(F.col("doc_id") < 50, "aa").when(F.col("doc_id") < 100, "bb")))
    out = languages.identify(df, taught).collect()
    assert len(out) == len(rows) and set(taught) == {"aa", "bb"}
    for r in out:
        assert (r.lang_pred == "und") == (not any(x.isalpha() for x in r.text or "")) == r.rejected or r.lang_pred != "und"
    assert {r.lang_pred for r in languages.identify(df, {}).collect()} == {"und"}
    assert languages.identify(df.limit(0), taught).count() == 0


def test_languages_of_long_texts(spark):
    """The lead doesn't shrink with the length; a short tie is seen by its score."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taught = languages.learn(docs.where(languages.trains()))
    said = {k: "" for k in taught}
    for r in docs.where(~languages.trains()).where("lang is not null and text is not null").orderBy("doc_id").collect():
        if r.lang in said and len(said[r.lang]) < 200_000:
            said[r.lang] += " " + r.text
    rows = [(k, n, (t * (n // len(t) + 1))[:n]) for k, t in said.items() for n in (20_000, 10_000_000)]
    got = languages.identify(spark.createDataFrame(rows, "lang string, n long, text string").repartition(4), taught, keep=["lang", "n"]).collect()
    score = {(r.lang, r.n): r.score for r in got}
    assert all(r.lang_pred == r.lang and not r.rejected for r in got)
    assert all(score[k, 10_000_000] > score[k, 20_000] / 3 for k in said)
    tie = languages.identify(spark.createDataFrame([("some short words",)], "text string"), {"a": b"other words here", "b": b"other words here"}).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in tie] == [("a", 0.0, False)]


def test_encoder_equals_the_tokenizer_on_odd_words(monkeypatch):
    import pyarrow as pa

    from arealis.llm import queries

    texts = ["plain words, and Points.", "a \x01 b", "x\x01y \x01\x01 \x01", "", None, "<|endoftext|> and <|ENDOFTEXT|>", "don't  stop here　now", "été İstanbul ΣΣ 123 45.67,89", "...,,, a.b,c"]
    encoder = packing.Encoder(queries.tokenizer())
    monkeypatch.setattr(packing, "CACHE", 12)  # words are forgotten again and again
    for some in (texts, texts[::-1], texts[:3]):
        ids, stops = encoder.encode(pa.array(some, pa.string()), 1)
        begin = 0
        for text, stop in zip(some, stops.tolist(), strict=True):
            assert ids[begin:stop].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], text
            begin = stop


def thue_morse(n):
    """Two different words of 2**n letters that a polynomial modulo 2**64 can't tell apart once n reaches 10."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [10, 12])
def test_words_that_collide_in_polynomials(spark, n):
    a, b = thue_morse(n)
    rest = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, " ".join([a, *rest[:4]])), (4, " ".join([b, *rest[:4]])), (5, f"{a} x"), (6, f"{b} x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = [(r.doc_id, r.n_words, sum(x.length for x in r.repeats), r.kept_text) for r in substrings.repeats(df).collect()]
    assert sorted(got) == sorted(expect_repeats(rows))
    assert sorted(tuple(r) for r in jaccard.links(df).collect()) == sorted(expect_links(rows))
    items = [(1, " ".join([a, *rest[:9]])), (2, b)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    from pyspark.sql import functions as F

    hit = suffixes.n_hit()
    out = suffixes.decontaminate(df, bench).select("doc_id", "n_words", hit, F.size("items"), F.sha2(F.array_join("items", ","), 256), hit > 0)
    assert sorted(tuple(r) for r in out.collect()) == sorted(expect_hits(rows, items))
    expect_pieces_ok(rows, packing.pack(df, queries.tokenizer()).collect())
    known = {r.doc_id: r.n_known for r in scoring.score(spark.createDataFrame([(0, a), (next(i for i in range(99) if held_out(i, 7, 2)), b)], "doc_id long, text string")).collect()}
    assert sorted(known.values()) == [1, 2]  # only the end of the held-out text is known


def test_encoder_when_hashes_collide(monkeypatch):
    import numpy as np
    import pyarrow as pa

    encoder = packing.Encoder(queries.tokenizer())
    monkeypatch.setattr(packing.W.Words, "hashes", lambda self: (self.end - self.start).astype(np.uint64))
    texts = ["the cat sat", "one two six  ten", None, "", "The CAT, sat."]
    for some in (texts[:1], texts):
        ids, stops = encoder.encode(pa.array(some, pa.string()), 1)
        assert ids.tolist() == [i for t in some for i in [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]] and len(stops) == len(some)


def test_very_many_short_texts(spark):
    """More null rows in a partition than a batch may have, and a pair of near copies."""
    from pyspark.sql import functions as F

    w = [f"w{i}" for i in range(60)]
    few = spark.createDataFrame([(2_000_000, " ".join(w)), (2_000_001, " ".join(w[:-1]))], "doc_id long, text string")
    df = spark.range(1_100_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")).unionByName(few).coalesce(1)
    assert [tuple(r) for r in jaccard.links(df).where("doc_id >= 2000000").orderBy("doc_id").collect()] == [(2_000_000, 56, 2_000_000), (2_000_001, 55, 2_000_000)]
    assert [r.n_words for r in substrings.repeats(df).where("doc_id >= 2000000").orderBy("doc_id").collect()] == [60, 59]
    assert scoring.score(df).where("doc_id >= 2000000 and n_tokens > 59").count() == 2


def test_one_word_of_megabytes_and_repeated(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a " * 2_000_000), (2, "x" * 4_000_000), (3, "b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(7, "a " * 400), (8, "x" * 4_000_000)], "item_id long, text string")
    out = suffixes.decontaminate(df, bench).select("doc_id", "n_words", suffixes.n_hit(), F.array_join("items", ","), F.array_max(F.transform("matches", lambda m: m["length"]))).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, 2_000_000, 2_000_000, "7", 400), (2, 1, 1, "8", 1), (3, 2, 0, "", None)]
    assert [(r.doc_id, r.n_words) for r in substrings.repeats(df).orderBy("doc_id").collect()] == [(1, 2_000_000), (2, 1), (3, 2)]
    assert [(r.doc_id, r.n_shingles) for r in jaccard.links(df).orderBy("doc_id").collect()] == [(1, 1), (2, 1), (3, 1)]
    assert [(r.doc_id, r.n_tokens) for r in scoring.score(df).orderBy("doc_id").collect()] == [(1, 2_000_001), (2, 2), (3, 3)]


def test_languages_against_plain_compression(spark, small):
    """Dictionaries, languages and scores of all documents against a plain loop."""
    import regex
    import zstandard as zstd
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).alias("draw")).collect()
    plain = lambda t: regex.sub(r"[^\p{L}]+", " ", (t or "").lower()).strip(" ")
    content = {}
    for r in sorted((r for r in rows if not held_out(r.doc_id, 4, 2) and r.lang is not None and r.text is not None), key=lambda r: (r.lang, r.draw)):
        t = plain(r.text)
        begin = max(0, (len(t) - 500) // 2 - 1) if len(t) > 500 else 0
        t, own = t[begin : begin + 500], content.setdefault(r.lang, [])
        if t and t not in own[-3:]:
            own.append(t)
    learnt = languages.learn(docs.where(languages.trains()))
    assert learnt == {k: " ".join(v).encode() for k, v in sorted(content.items())}
    packers = {}
    for lang, data in learnt.items():
        d = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        packers[lang] = zstd.ZstdCompressor(level=3, dict_data=d, write_content_size=False)
    want = {}
    for r in rows:
        data = plain(r.text).encode()
        sizes = sorted((sum(len(p.compress(data[i : i + 16384])) for i in range(0, len(data), 16384)), lang) for lang, p in packers.items())
        want[r.doc_id] = (sizes[0][1], round(1 - sizes[0][0] / sizes[1][0], 9)) if data else ("und", 0.0)
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in queries.op10_language_id(spark, small).collect()} == want
