"""Operators over pages and vectors against brute force."""

import base64
import hashlib
import html
import re

import numpy as np
import pytest

from arealis.llm import ann, html_text, queries, urls, warc


def digest(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(3, "http://a.b/x", "<p>hi</p>"), (1, "http://a.b/y", "<p>hi</p>"), (1, "http://a.b/y", "<p>hi</p>"), (2, None, None), (5, "u\r\nX: 1\\n", ""), (None, "http://a.b/z", "<p>hi</p>"), (None, "q", "solo"), (8, "http://a.b/é", "é" * 400_000), (9, "http://a.b", "\r\n\r\nWARC/1.1")]
    return rows, spark.createDataFrame([(*r, r[0], "x") for r in rows], "page_id long, url string, html string, first long, digest string").repartition(2)


def expect_records(rows):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = min(best.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = best.get(h or "")
        again = first is not None and first != i
        out.append((i, len(p), digest(p), "revisit" if again else "response", first if again else None))
    return out


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


def test_warc(spark, pages):
    rows, df = pages
    index, path = warc.archive(df)
    got = warc.read_bundles(index, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(expect_records(rows), key=key)
    assert {(r.page_id, r.url) for r in got} == {(i, u) for i, u, _ in rows}
    for r in got:
        assert bytes(r.payload) == (next((h or "").encode() for i, u, h in rows if (i, u) == (r.page_id, r.url)) if r.record_type == "response" else b"")
    one = warc.fetch(index, spark.createDataFrame([(8,), (9,)], "page_id long"), path).collect()
    assert {r.page_id: bytes(r.payload) for r in one} == {8: ("é" * 400_000).encode(), 9: b"\r\n\r\nWARC/1.1"}
    index, path = warc.archive(df.limit(0))
    assert warc.read_bundles(index, path).count() == 0


def test_bundles_are_seekable(spark, pages, tmp_path):
    import zstandard as zstd

    _, df = pages
    index = warc.write_bundles(warc.roles(df), f"file://{tmp_path}/w", frame_bytes=64)
    for name in {r.bundle for r in index.collect()}:
        data = (tmp_path / "w" / name).read_bytes()
        import io

        table = warc.seek_table(io.BytesIO(data), len(data))
        alone = b"".join(zstd.ZstdDecompressor().decompress(data[a : a + n]) for a, n in table)
        assert alone == zstd.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()


def test_warc_on_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in queries.op1_warc_bundles(spark, small).collect()), key=key) == sorted(expect_records(rows), key=key)


def test_main_text_of_articles(spark, small):
    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op8_html_text(spark, small).collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html or "", re.S)
        want = []
        for block in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner[1] if inner else ""):
            if t := " ".join(html.unescape(re.sub(r"<[^>]+>", "", block)).split()):
                want.append(t)
        assert got[r.page_id].text == " ".join(want) and got[r.page_id].n_chars == len(got[r.page_id].text)


PAGE = """<html><head><title>T</title><script>if (a<b) x("</p><p>no</p>")</script></head><body class="page home">
<header>Site name</header><div id='main-menu'><a href=/>Home</a></div>{before}
<article class="post"><header><h1>Head &amp; line</h1></header><p>One <b>bo</b>ld &lt;tag&gt;&nbsp;here<p>Two
lines<aside>see also</aside><div class="ad">buy</div><form><p>mail<input></form><ul><li>a<li>b</ul><!-- no > --></article>
<section id="comments"><p>first!</p></section><footer><p>&copy; me</footer></body>"""


def test_blocks():
    text = " ".join(t for z, t in html_text.blocks(PAGE.format(before="<div class='cookie-notice'>ok</div>")) if z == html_text.MAIN)
    assert text == "Head & line One bold <tag> here Two lines a b"
    assert html_text.blocks("") == [] and html_text.blocks("plain") == [(html_text.OPEN, "plain")]
    assert html_text.blocks("a < b <3 <p") and html_text.blocks("<script>never ends") == []


def test_names_inside_articles():
    page = "<div class=sidebar>out</div><article><p class='social-science'>one</p><div class=search-results>two</div><p class='related menu'>three</p><div id=comments>four</div></article>"
    assert html_text.blocks(page) == [(html_text.OUT, "out"), (html_text.MAIN, "one"), (html_text.MAIN, "two"), (html_text.MAIN, "three"), (html_text.OUT, "four")]


@pytest.mark.parametrize("piece", ["<a ", '<a "', "</b>", "<i></b>", "<", "<!", "<!-- ", "&amp", "<p class='", '<p class="x" id=', "<textarea>", "<x y='\"", "<p>", "<div class=a "])
def test_malformed_pages_take_linear_time(piece):
    import time

    html_text.blocks(piece * 1000)
    began = time.time()
    html_text.blocks("<article>" + piece * (1_000_000 // len(piece)) + " end")
    assert time.time() - began < 6  # a second or two; quadratic scanners take minutes


def test_quotes_that_never_close():
    assert html_text.blocks("<p title='a>b'>one</p><p title=\"x>two</p><p>it's three</p>") == [(html_text.OPEN, "one"), (html_text.OPEN, "two"), (html_text.OPEN, "it's three")]


def expect_open_text(rows, length=8, least=3):
    """Brute force for pages without article: words under windows that stand on `least` different pages of the host go."""
    where = {}
    for _, host, w in rows:
        for p in range(len(w) - length + 1):
            where.setdefault((host, tuple(w[p : p + length])), set()).add(tuple(w))
    out = {}
    for i, host, w in rows:
        gone = set()
        for p in range(len(w) - length + 1):
            if len(where[host, tuple(w[p : p + length])]) >= least:
                gone |= set(range(p, p + length))
        out[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    return out


def test_open_pages_against_brute_force(spark):
    """Pages without article on hosts of many sizes: the same texts whatever the size of the groups."""
    import random

    rng = random.Random(8)
    passages = [[f"p{k}x{j}" for j in range(rng.choice([7, 8, 9, 15, 40]))] for k in range(12)] + [[("a" * 1024, "b" * 1024)[j % 2] for j in range(9)]]
    rows = []
    for i in range(160):
        w = [x for k in range(rng.choice([0, 1, 3])) for x in [*rng.choice(passages), *[f"w{i}x{k}{j}" for j in range(rng.choice([1, 5, 30]))]]]
        rows.append((i, rng.choice(["a.example", "a.example", "a.example", "b.example", "c.example"]), w))
    rows += [(200 + i, host, w) for i, (_, host, w) in enumerate(rows[:30])]
    df = spark.createDataFrame([(i, f"http://{host}/{i}", "".join(f"<div>{' '.join(w[k : k + 6])}</div>" for k in range(0, len(w), 6))) for i, host, w in rows], "page_id long, url string, html string")
    want = expect_open_text(rows)
    for chunk in (1, 3, 400):
        assert {r.page_id: r.text for r in html_text.main_text(df, chunk=chunk).collect()} == want


def test_host_boilerplate(spark):
    """Without an article element, passages repeated over the host's pages go; copies of a page don't erase it."""
    shared = "all of these words stand on every page of this host you know"
    own = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(5)]
    rows = [(i, f"http://h.example/{i}", f"<div>{shared}</div><div>{t}</div>", "k") for i, t in enumerate(own)]
    rows += [(10 + i, "http://copy.example/", f"<div>{own[0]}</div>", "k") for i in range(6)] + [(None, None, None, "k"), (20, "http://h.example/", "", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for chunk in (400, 1):
        got = {r.page_id: r.text for r in html_text.main_text(df, chunk=chunk, least=3).collect()}
        assert len(got) == len(rows) and got[None] == "" and got[20] == ""
        assert all(got[i] == t for i, t in enumerate(own))
        assert all(got[10 + i] == own[0] for i in range(6))
    assert html_text.main_text(df.limit(0)).count() == 0


def test_boilerplate_inside_articles(spark):
    """A notice that a host's articles share goes; a short shared sentence, copies and edited copies of an article stay."""
    notice = " ".join(f"n{j}" for j in range(20))
    short = " ".join(f"s{j}" for j in range(9))
    own = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(4)]
    edited = [" ".join(f"e{j}" if j % 20 != 10 + i else f"edit{i}x{j}" for j in range(60)) for i in range(4)]
    rows = [(i, f"http://h.example/{i}", f"<article><p>{short}</p><p>{t}</p><p>{notice}</p></article>") for i, t in enumerate(own)]
    rows += [(10 + i, f"http://h.example/{10 + i}", f"<article><p>{t}</p></article>") for i, t in enumerate(edited)]
    rows += [(20 + i, f"http://h.example/{20 + i}", f"<article>{notice} copy</article>") for i in range(3)]
    got = {r.page_id: (r.text, r.n_boilerplate) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [(f"{short} {t}", 20) for t in own]
    assert [got[10 + i] for i in range(4)] == [(t, 0) for t in edited]
    assert [got[20 + i] for i in range(3)] == [(f"{notice} copy", 0)] * 3


def test_host_of_many_groups(spark):
    """A host dealt over many groups gives the texts it gives as one group."""
    rare, common = (" ".join(f"{c}{j}" for j in range(12)) for c in "rc")
    rows = []
    for i in range(60):
        own = " ".join(f"w{i}x{j}" for j in range(30))
        said = f"<div>{own}</div>" + (f"<div>{rare}</div>" if i % 20 == 7 else "") + (f"<div>{common}</div>" if i % 2 else "")
        rows.append((i, f"http://h.example/{i}", said))
    twice = " ".join(f"t{j}" for j in range(20))  # copies of one page over the groups are one page
    rows += [(100 + i, f"http://h.example/{100 + i}", f"<div>{twice}</div>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, many = ({r.page_id: (r.text, r.n_boilerplate) for r in html_text.main_text(df, chunk=c).collect()} for c in (400, 5))
    assert one == many and len(one) == len(rows)
    assert all(rare not in one[i][0] and one[i][1] == 24 for i in (7, 27, 47)) and one[100] == (twice, 0)


def test_repeated_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        tokens = rng.integers(0, 3, 80).astype(np.uint64)
        page = np.sort(rng.integers(0, 6, 80))
        got = html_text.repeated(tokens, page, 5, 3)
        where = {}
        for i in range(76):
            if page[i] == page[i + 4]:
                where.setdefault(tuple(tokens[i : i + 5]), set()).add(page[i])
        want = np.zeros(80, bool)
        for i in range(76):
            if page[i] == page[i + 4] and len(where[tuple(tokens[i : i + 5])]) >= 3:
                want[i : i + 5] = True
        assert (got == want).all()


def split_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :])[0]


def expect_rule(host, path):
    fits = [r for r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=len, default=None)


def test_urls(spark, small):
    odd = [(None, None), (1, "no scheme"), (2, "HTTP://WWW.Example.NET/EN/"), (3, "http://x.net"), (4, "http://x.net?q=/a"), (5, "a://b.example.com/de/1#x"), (5, "http://badnet/"), (6, "http://example.net/en/"), (7, "://net/"), (8, "http://ünï.org/fr/é?"), (9, "http://u://x/")]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in odd], "page_id long, url string, host string, rule string")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for rows, got in ((odd, urls.judge(df, docs, queries.URL_RULES).collect()), ([tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()], queries.op5_url_filter(spark, small).collect())):
        want = [(i, *split_url(u), expect_rule(*split_url(u))) for i, u in rows]
        assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=key) == sorted(want, key=key)
        assert all(r.verdict == queries.URL_RULES.get(r.rule, r.verdict) and r.verdict in ("allow", "block") for r in got)
    assert urls.judge(df.limit(0), docs, queries.URL_RULES).count() == 0
    assert urls.judge(df, docs.limit(0), queries.URL_RULES).count() == len(odd)


def test_verdicts_against_a_plain_model(spark, small):
    """Every page's verdict against Viterbi and Bayes written plainly, with a host of 300 letters among the pages."""
    import math
    from collections import Counter

    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter(w for t in docs for w in re.findall(r"[^\x00-\x60\x7B-\x7F]+", (t or "").translate(low)))
    some = [w for w, _ in count.most_common(40) if w.isascii()]
    rows += [(90_000, f"http://{(''.join(some) * 9)[:300]}.com/x"), (90_001, f"http://{(''.join(some) * 9)[:300]}.net/x"), (90_002, f"http://{'q' * 70}.com/q/1/2?x"), (90_003, None)]
    total = sum(count.values())

    def split(name):
        best = [(0.0, [])]
        for i in range(1, len(name) + 1):
            options = []
            for k in range(i):
                part = name[k:i]
                options.append((best[k][0] + (math.log(count[part] / total) if part in count else -math.log(total) - len(part) * math.log(26.0)), k))
            top, k = max(options, key=lambda o: (o[0], -o[1]))
            best.append((top, [*best[k][1], name[k:i]]))
        return best[-1][1]

    parsed = [(i, *split_url(u), expect_rule(*split_url(u))) for i, u in rows]
    tokens = {}
    for _, host, path, _ in parsed:
        words = [w for name in re.findall(r"[^\W\d_A-Z]+", host) for w in split(name)]
        tokens[host, path] = words + ["/" + re.sub(r"\d+", "#", x) for x in re.findall(r"[^\W_]+", path.lower())]
    seen, n = {"block": Counter(), "allow": Counter()}, Counter()
    for _, host, path, rule in parsed:
        if rule:
            seen[queries.URL_RULES[rule]].update(tokens[host, path])
            n[queries.URL_RULES[rule]] += 1
    kinds = len({x for t in tokens.values() for x in t}) + 1  # and one that is unseen
    sums = {k: sum(c.values()) for k, c in seen.items()}
    want = {}
    for i, host, path, rule in parsed:
        odds = math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(math.log((seen["block"][x] + 1) / (sums["block"] + kinds)) - math.log((seen["allow"][x] + 1) / (sums["allow"] + kinds)) for x in tokens[host, path])
        want[i] = (queries.URL_RULES[rule] if rule else "block" if odds > 0 else "allow", None if rule else round(odds, 6))
    texts = spark.createDataFrame([(t,) for t in docs], "text string")
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), texts, queries.URL_RULES).collect()
    assert {r.page_id: (r.verdict, None if r.log_odds is None else round(r.log_odds, 6)) for r in got} == want


def test_segmentation(spark):
    texts = spark.createDataFrame([("cheap pills and a spam farm; cheap Pills pills the farm",), (None,), ("",)], "text string")
    names = spark.createDataFrame([("cheappills",), ("spamfarm",), ("qqq",)], "name string")
    got = {r.name: r.words for r in urls.segmented(names, urls.word_counts(texts)).collect()}
    assert got == {"cheappills": ["cheap", "pills"], "spamfarm": ["spam", "farm"], "qqq": ["qqq"]}


def test_bayes_learns_from_words(spark):
    """Unruled hosts follow the words of ruled ones."""
    texts = spark.createDataFrame([("cheap pills good news spam daily",)], "text string")
    rows = [(i, f"http://cheappills{'abcdefgh'[i]}.net/x") for i in range(8)] + [(10 + i, f"http://goodnews{'abcdefgh'[i]}.example.net/en/x") for i in range(8)]
    rows += [(50, "http://pillsspam.com/x"), (51, "http://newsdaily.com/x")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), texts, queries.URL_RULES).collect()}
    assert got[50] == "block" and got[51] == "allow"


def expect_vectors(ids, x, least=0.95):
    n = len(ids)
    ok = [v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v) and ids[i] is not None for i, v in enumerate(x)]
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    count = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(x[i]) == len(x[j]):
                a, b = np.array(x[i], float), np.array(x[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    count[i] += 1
                    count[j] += 1
                    up[find(i)] = find(j)
    root = {}
    for i in range(n):
        if ids[i] is not None:
            root[find(i)] = min(root.get(find(i), ids[i]), ids[i])
    return [(ids[i], count[i], None if ids[i] is None else root[find(i)], ids[i] is not None and ids[i] == root[find(i)]) for i in range(n)]


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = [rng.normal(size=8).tolist() for _ in range(150)]
    x += [(np.array(x[i % 20]) + rng.normal(size=8) * 0.1).tolist() for i in range(120)]
    x += [x[3]] * 30 + [None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0], x[5], (2 * np.array(x[7])).tolist()]
    ids = [int(v) for v in rng.permutation(len(x))]
    ids[40] = None
    df = spark.createDataFrame([(i, v, "c") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, node string").repartition(3)
    want = expect_vectors(ids, x)
    assert sorted((tuple(r) for r in ann.near_duplicates(df, shards=3, block=64).collect()), key=key) == sorted(want, key=key)
    assert ann.near_duplicates(df.limit(0)).count() == 0


def test_vectors_on_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    want = expect_vectors([r.vec_id for r in rows], [r.embedding for r in rows])
    assert sorted(tuple(r) for r in queries.op7_vector_dedup(spark, "/root/testdata/sf0.01").collect()) == sorted(want)


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    x[700:] = x[:800] + rng.normal(size=(800, 16)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = ann.Graph(x, np.arange(1500))
    true = (x @ x.T >= 0.95).sum()
    assert sum(len(f) for _, f in g.within(x, 0.95, 24)) >= 0.97 * true


def test_audit_counts_no_match_with_itself():
    """A search that finds only the node itself must fail the audit, also where links are few."""

    class Lossy(ann.Graph):
        def within(self, q, least, beam):
            for r, found in super().within(q, least, beam):
                yield r, found if beam >= 96 else found[self.x[found] @ q[r] > 1 - 1e-9]

    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[1499] = x[0] + rng.normal(size=16) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert ann.Graph(x, np.arange(1500)).audited(0.95, 24, 0.99, 256) < 1500
    assert Lossy(x, np.arange(1500)).audited(0.95, 24, 0.99, 256) >= 96
    assert ann.Graph(x[:400], np.arange(400)).audited(0.95, 24, 0.99, 256) == 24


def test_shards_grow_with_the_table(spark, monkeypatch):
    """More vectors make more graphs, not larger ones; the links are the same."""
    rng = np.random.default_rng(4)
    x = [rng.normal(size=8).tolist() for _ in range(200)]
    x += [(np.array(v) + rng.normal(size=8) * 0.01).tolist() for v in x[:50]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    graphs = []
    monkeypatch.setattr(ann, "stored", lambda d, name, keep=ann.stored: (out := keep(d, name), graphs.append(out) if name == "graphs" else None)[0])
    got = ann.near_duplicates(df, shards=1, shard_size=50).collect()
    assert graphs[0].count() == 5
    assert sorted(tuple(r) for r in got) == sorted(expect_vectors(list(range(250)), x))


def test_links_count_for_both_ends(spark):
    """Dense groups, whose searches end as comparisons with the whole shard, beside sparse ones; several shards and blocks."""
    rng = np.random.default_rng(6)
    x = [rng.normal(size=8) for _ in range(60)]
    x += [x[0] + rng.normal(size=8) * 0.02 for _ in range(230)] + [x[1] + rng.normal(size=8) * 0.35 for _ in range(100)] + [v + rng.normal(size=8) * 0.1 for v in x[2:60]]
    x = [v.tolist() for v in x]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    want = sorted(expect_vectors(list(range(len(x))), x))
    for shards, block in ((1, 8192), (3, 40)):
        assert sorted(tuple(r) for r in ann.near_duplicates(df, shards=shards, block=block, beam=8).collect()) == want


def test_audits_across_shards(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 16))
    x[450:] = x[:450] + rng.normal(size=(450, 16)) * 0.05
    df = spark.createDataFrame([(16, i, 1, v.tolist()) for i, v in enumerate(x)], "dim int, rep long, n long, v array<double>")
    links = ann.search_all(df, 0.95, 4, 1000, 24, 0.99, 64, 100)
    true, found = ann.recall_of(links)
    assert true > 300 and found >= 0.99 * true
    assert ann.recall_of(links.where(F.col("mine") != F.col("theirs")))[0] > 200


def test_urls_survive_the_archive():
    for url in ("a\\b", "a\0\\n", "\\r\r\n\\\\n", "http://x/\\0\0"):
        assert next(warc.parse(warc.record(1, url, b"p", None)))[1] == url
