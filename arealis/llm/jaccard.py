"""N-gram Jaccard join with PartEnum signatures, and the components of its links.

A text's set holds its distinct word shingles. Two sets link when their Jaccard similarity is at least a threshold t.
Sets fall into size bands; sets that link and whose smaller one lies in a band differ in at most k elements, k from the
band. PartEnum partitions the element domain into n1 parts, so that in one of them linked sets differ in at most k2
elements, and each of those into n2 parts, of which n2 - k2 then agree: every subset of that many parts gives a
signature, a hash of the set's elements in them. Linked sets share a signature. Here (k2, n2) is (1, 3) for small bands
and (0, 1) for large ones.

A shared signature must not be that of an empty part, which very many sets have. A set with more non-empty parts than
k differences can spoil surely shares a non-empty one; a set with fewer is *weak*. Signatures are first taken over rare
elements alone, as shingles of passages that very many documents have would join them all. Sets weak there add
signatures over all elements, and sets weak there too add every single element. Any two linked sets share one of these,
whichever elements count as frequent: that choice moves cost, not results.

Steps: (1) documents with equal sets in a batch are one; (2) a sixteenth of the signatures pairs each document with the
smallest that shares one; pairs are verified exactly and linked ones joined to components; (3) all signatures meet,
one row for each signature and component of a batch. Components that share one are put in the group of the smallest
of them, their hub. Within a group, texts of different components are compared by parity sketches, whose differing bits
never exceed the differing elements; only pairs that these don't rule out leave the task, and they are verified exactly.
Pairs inside a component need no test, so groups of copies cost no pairs; large groups are cut into squares.

Nulls and ties: a text without words, or null, has an empty set and links with nothing. A null id gets its n_shingles,
no component and no links. Rows with the same id are one document with several texts. Other columns aren't read. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm import batches as B
from arealis.llm import words as W
from arealis.llm.graph import components

U = np.uint64
ROW_BITS = 20
#: Elements counted as frequent: those seen in most sets, at most so many (16 MB in each task), seen in SEEN sets at least.
FREQUENT, SEEN = 2_000_000, 8
SKETCH = "root long, doc long, uid long, n long, sketch binary"
SKETCH_NAMES = [x.split()[0] for x in SKETCH.split(", ")]
#: Texts on each side of a square of comparisons.
SIDE = 2048
TESTED = ["a", "b", "b_uid", "linked", "distance"]
ROWS_SCHEMA = "kind int, uid long, doc_id long, n long, rep long, element long, sets long"


def edges_of_bands(limit: int = 1 << 40) -> np.ndarray:
    """Sizes at which bands begin, each 4/3 of the one before."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, -(-out[-1] * 4 // 3)))
    return np.array(out)


BANDS = edges_of_bands()


class Sets:
    """The element sets of some texts: elements, sorted within each set, and where each set begins."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, shingle: int):
        w = W.Words(W.LOWER[text], ends, W.SPACES)
        h, n = w.hashes(), w.counts()
        starts = np.flatnonzero(W.window_starts(w, shingle))
        values, owners = [W.grams(h, shingle)[starts] if len(starts) else np.zeros(0, U)], [w.text[starts]]
        for k in range(1, shingle):  # shorter texts are one shingle
            short = np.flatnonzero(n == k)
            if len(short):
                values.append(W.grams(h, k)[w.first[short]])
                owners.append(short)
        value, owner = np.concatenate(values), np.concatenate(owners).astype(np.uint16 if len(ends) <= 1 << 16 else np.int32)
        order = np.argsort(value)
        order = order[np.argsort(owner[order], kind="stable")]
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        self.value, self.owner = value[new], owner[new].astype(np.int64)
        self.size = np.bincount(self.owner, minlength=len(ends))
        self.begin = np.cumsum(self.size) - self.size

    def of(self, i: int) -> np.ndarray:
        return self.value[self.begin[i] : self.begin[i] + self.size[i]]

    def prints(self) -> np.ndarray:
        """A hash of each whole set."""
        sums = np.concatenate([np.zeros(1, U), np.cumsum(W.mix(self.value))])
        return W.mix(sums[self.begin + self.size] - sums[self.begin] + self.size.astype(U))


def _some(b: B.Batch, rows: np.ndarray, shingle: int) -> Sets:
    """The sets of some texts of a batch."""
    begin = np.concatenate([[0], b.ends[:-1]])[rows]
    parts = [b.text[s:e] for s, e in zip(begin.tolist(), b.ends[rows].tolist(), strict=True)]
    return Sets(np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.cumsum(b.ends[rows] - begin), shingle)


def _parts(value: np.ndarray, owner: np.ndarray, docs: int, k: int, tag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the set each is of, and whether each set is strong."""
    k2 = 1 if 1 <= k <= 64 else 0
    n2 = 2 * k2 + 1
    n1 = -(-(k + 1) * 23 // 40) + 1 if k2 else max(1, -(-(k + 1) * 6 // 5)) if k else 1
    h = W.mix(value ^ U(tag))
    part = (h >> U(33)) % U(n1)
    slot = (owner * n1 + part.astype(np.int64)) * n2 + (h % U(n2)).astype(np.int64)
    order = np.argsort(slot)
    s = slot[order]
    sums, full = np.zeros(docs * n1 * n2, U), np.zeros(docs * n1 * n2, bool)
    if len(s):
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        sums[s[begin]] = np.add.reduceat(W.mix(h)[order], begin)
        full[s[begin]] = True
    sums, full = sums.reshape(-1, n2), full.reshape(-1, n2)
    of = np.repeat(np.arange(docs), n1)
    name = (np.tile(np.arange(n1), docs) * 4).astype(U) + U(tag)
    if not k2:
        return W.mix(sums[:, 0] + W.mix(name))[full[:, 0]], of[full[:, 0]], np.bincount(of[full[:, 0]], minlength=docs) > k
    keys, owners = [], []
    for i, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):  # all subsets of two of three parts
        some = full[:, x] | full[:, y]
        keys.append(W.mix(sums[:, x] + sums[:, y] + W.mix(name + U(i + 1)))[some])
        owners.append(of[some])
    return np.concatenate(keys), np.concatenate(owners), np.bincount(of[full.sum(axis=1) >= 2], minlength=docs) > k // 2


def signatures(sets: Sets, chosen: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the number of the set of each, for the chosen sets."""
    keys, owners, size = [np.zeros(0, U)], [np.zeros(0, np.int64)], sets.size
    band_of = np.searchsorted(BANDS, size[chosen], side="right") - 1
    for j in np.unique(band_of).tolist():
        docs = chosen[band_of == j]
        n = size[docs]
        owner = np.repeat(np.arange(len(docs)), n)
        value = sets.value[np.repeat(sets.begin[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        rare = np.ones(len(value), bool)
        if len(frequent):
            rare = frequent[np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)] != value
        for band in range(j, -1, -1):  # the band of the smaller set of a pair
            high = int(BANDS[band + 1]) - 1
            here = n <= high * 100 // percent
            if not here.any():
                break
            k = high * (100 - percent) // percent
            for scheme in range(2):
                number = np.cumsum(here) - 1
                use = here[owner] & rare if scheme == 0 else here[owner]
                of = np.flatnonzero(here)
                got, o, strong = _parts(value[use], number[owner[use]], len(of), k, (band * 4 + scheme) << 32)
                keys.append(got)
                owners.append(docs[of[o]])
                here = here.copy()
                here[of[strong]] = False
                if not here.any():
                    break
            use = here[owner]
            keys.append(W.mix(value[use] + U((band * 4 + 2) << 32)))
            owners.append(docs[owner[use]])
    return np.concatenate(keys), np.concatenate(owners)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the elements by the low bits of their hash; from two to four bits for each element, a power of two."""
    bits = max(64, 1 << int(2 * len(elements) - 1).bit_length())
    n = np.bincount((elements & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(n.astype(np.uint8), bitorder="little")


def near_sketches(table: pa.Table, percent: int) -> np.ndarray:
    """(doc, uid, doc, uid) of pairs, one of them upper, of different roots that may link.

    The parities of two sets differ in at most as many bits as the sets differ in elements, so too many differing bits
    rule a pair out. The larger sketch is folded to the size of the smaller."""
    up = np.array(table.column("upper").to_pylist(), bool)
    root, doc, uid, n = (table.column(c).to_numpy() for c in ("root", "doc", "uid", "n"))
    blobs = table.column("sketch").to_pylist()
    size = np.array([len(x) for x in blobs])
    found = [np.zeros((0, 4), np.int64)]
    for small in np.unique(size).tolist():
        here = np.flatnonzero(size == small)
        there = np.flatnonzero(size == 2 * small)
        x = np.frombuffer(b"".join(blobs[i] for i in here), np.uint64).reshape(len(here), small // 8)
        y = np.frombuffer(b"".join(blobs[i] for i in there), np.uint64).reshape(len(there), small // 4)
        both = np.concatenate([x, y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]]) if len(there) else x
        index = np.concatenate([here, there])
        for k, i in enumerate(index):
            if not up[i]:
                continue
            ok = ~up[index] & (root[index] != root[i]) & (100 * np.minimum(n[index], n[i]) >= percent * np.maximum(n[index], n[i]))
            ok &= np.arange(len(index)) < len(here) if k >= len(here) else True  # two folded sketches meet in their own size
            at = np.flatnonzero(ok)
            if len(at):
                bits = np.bitwise_count(both[at] ^ both[k]).sum(axis=1, dtype=np.int64)
                at = index[at[bits * (100 + percent) <= (n[index[at]] + n[i]) * (100 - percent)]]
                pairs = np.stack([np.full(len(at), doc[i]), np.full(len(at), uid[i]), doc[at], uid[at]], axis=1)
                turn = pairs[:, 1] > pairs[:, 3]
                pairs[turn] = pairs[turn][:, [2, 3, 0, 1]]
                found.append(pairs)
    return np.unique(np.concatenate(found), axis=0)


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    spark = df.sparkSession
    batches = B.stored_batches(df, id_col, text_col, B.BATCH_BYTES // 2)  # a text's signatures take more room than its words
    buckets = max(8, batches.count() // 4)

    def classes(b: B.Batch, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
        """The rows that stand for themselves, and for each row the one that stands for it: that with the smallest id of equal sets."""
        prints = sets.prints()
        order = np.lexsort((b.ids, prints))
        new = np.concatenate([[True], prints[order][1:] != prints[order][:-1]])
        stands = np.empty(len(order), np.int64)
        stands[order] = order[new][np.cumsum(new) - 1]
        own = (stands == np.arange(len(stands))) & (sets.size > 0) & (b.ids != B.NO_ID)
        return np.flatnonzero(own), stands

    def survey(rows):
        for b in B.each_batch(rows):
            sets = Sets(b.text, b.ends, shingle)
            own, stands = classes(b, sets)
            n, uid = len(b.ids), (b.batch << ROW_BITS) + np.arange(len(b.ids))
            mine = np.zeros(n, bool)
            mine[own] = True
            element, count = np.unique(sets.value[mine[sets.owner]], return_counts=True)
            many = count >= 2
            zeros = lambda k: np.zeros(k, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n), pa.int32()), pa.array(uid), b.id_list(), pa.array(sets.size), pa.array(b.ids[stands], pa.int64(), mask=b.ids[stands] == B.NO_ID), pa.array(zeros(n)), pa.array(zeros(n))], ["kind", "uid", "doc_id", "n", "rep", "element", "sets"])
            k = int(many.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k), pa.int32()), *[pa.array(zeros(k))] * 4, pa.array(element[many].view(np.int64)), pa.array(count[many])], ["kind", "uid", "doc_id", "n", "rep", "element", "sets"])

    seen = B.stored(batches.mapInArrow(survey, ROWS_SCHEMA), "survey")
    docs = seen.where("kind = 0").select("uid", "doc_id", "n", "rep")
    often = B.stored(seen.where("kind = 1").groupBy("element").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= SEEN), "often")
    total = 0
    steps = F.floor(F.log2("sets") * 4)  # counts in steps of a quarter power of two
    for step, n in sorted(((r.step, r.n) for r in often.groupBy(steps.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True):
        if (total := total + n) > FREQUENT:
            often = often.where(steps > step)
            break
    frequent = spark.sparkContext.broadcast(np.sort(often.select("element").toArrow().column(0).to_numpy().view(np.uint64)))

    def signed(b: B.Batch) -> tuple[Sets, np.ndarray, np.ndarray]:
        sets = Sets(b.text, b.ends, shingle)
        own, _ = classes(b, sets)
        return (sets, *signatures(sets, own, frequent.value, percent))

    pair = "a long, a_uid long, b long, b_uid long"

    def ask_few(rows):
        for b in B.each_batch(rows):
            sets, keys, owner = signed(b)
            few = (keys & U(15)) == 0
            own = np.unique(owner)
            keys, owner = np.concatenate([keys[few], sets.prints()[own]]), np.concatenate([owner[few], own])
            order = np.lexsort((b.ids[owner], keys))
            keys, owner = keys[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            head = np.repeat(owner[first], np.diff(np.concatenate([first, [len(keys)]]))) if len(keys) else owner
            near = np.unique(np.stack([head, owner], axis=1)[head != owner], axis=0)
            uid = (b.batch << ROW_BITS) + np.arange(len(b.ids))
            more = np.stack([b.ids[owner[first]], uid[owner[first]]], axis=1)
            out = B.request(b.batch, keys[first], more, buckets)
            local = np.stack([b.ids[near[:, 0]], uid[near[:, 0]], b.ids[near[:, 1]], uid[near[:, 1]]], axis=1).astype(np.int64)
            yield out
            # pairs within the batch, some in a row, dealt by batch
            yield pa.RecordBatch.from_arrays([pa.array([-1 - (b.batch % buckets)], pa.int32()), pa.array([b.batch], pa.int64()), pa.array([b""], pa.binary()), pa.array([local.tobytes()], pa.binary())], ["bucket", "batch", "keys", "more"])

    def pairs_of(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            rows = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("more").to_pylist()]).reshape(-1, 4)
        else:
            asked = B.Asked(table, "int64")
            more = asked.more.reshape(-1, 2)
            order = np.lexsort((more[:, 0], asked.keys))
            keys, more = asked.keys[order], more[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            head = np.repeat(first, np.diff(np.concatenate([first, [len(keys)]])))
            rows = np.concatenate([more[head], more], axis=1)[head != np.arange(len(head))]
            rows = np.unique(rows, axis=0)
        return pa.table([pa.array(rows[:, i]) for i in range(4)], ["a", "a_uid", "b", "b_uid"])

    batch_of = lambda c: F.shiftright(F.col(c), ROW_BITS)

    def fetch(b: B.Batch, needs: pa.Table) -> pa.Table:
        """The sets that other batches need."""
        uid, to = needs.column("a_uid").to_numpy(), needs.column("to").to_numpy()
        rows, inverse = np.unique(uid & ((1 << ROW_BITS) - 1), return_inverse=True)
        sets = _some(b, rows, shingle)
        blobs = [sets.of(i).tobytes() for i in range(len(rows))]
        return pa.table([pa.array(to), pa.array(uid), pa.array([blobs[i] for i in inverse], pa.binary())], ["batch", "a_uid", "elements"])

    def test(b: B.Batch, rows: pa.Table) -> pa.Table:
        given = rows.filter(rows.column("elements").is_valid())
        other = {u: np.frombuffer(x, np.uint64) for u, x in zip(given.column("a_uid").to_pylist(), given.column("elements").to_pylist(), strict=True)}
        asked = rows.filter(rows.column("b_uid").is_valid())
        index, inverse = np.unique(asked.column("b_uid").to_numpy() & ((1 << ROW_BITS) - 1), return_inverse=True)
        sets = _some(b, index, shingle)
        ok, far = [], []
        for u, i in zip(asked.column("a_uid").to_pylist(), inverse.tolist(), strict=True):
            x, y = other[u], sets.of(i)
            small, large = (x, y) if len(x) < len(y) else (y, x)
            common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
            union = len(x) + len(y) - common
            ok.append(100 * common >= percent * union)
            far.append(1 - common / union)
        return pa.table([asked.column("a"), asked.column("b"), asked.column("b_uid"), pa.array(ok, pa.bool_()), pa.array(far, pa.float64())], TESTED)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """linked and distance of each pair: the first one's set is sent to the second one's batch."""
        pairs = B.stored(pairs.distinct(), f"{name}-pairs")
        needs = pairs.select(batch_of("a_uid").alias("batch"), "a_uid", batch_of("b_uid").alias("to")).distinct()
        sent = B.settle(batches, needs, lambda b, t: fetch(b, t) if len(t) else pa.table({"batch": pa.array([], pa.int64()), "a_uid": pa.array([], pa.int64()), "elements": pa.array([], pa.binary())}), "batch long, a_uid long, elements binary")
        tests = sent.unionByName(pairs.withColumn("batch", batch_of("b_uid")), allowMissingColumns=True)
        none = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64())], TESTED)
        return B.stored(B.settle(batches, tests, lambda b, t: test(b, t) if len(t) else none, "a long, b long, b_uid long, linked boolean, distance double"), f"{name}-links")

    def linked(tested: DataFrame) -> DataFrame:
        return tested.where("linked").select("a", "b")

    few = batches.mapInArrow(ask_few, B.REQUEST).groupBy("bucket").applyInArrow(pairs_of, pair)
    equal = docs.where("n > 0 and rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    sure = linked(verified(few, "few")).unionByName(equal)
    roots = components(sure)

    labels = docs.join(roots, docs["doc_id"] == roots["node"]).select(batch_of("uid").alias("batch"), "uid", "root")

    def ask_all(b: B.Batch, rows: pa.Table) -> pa.Table:
        root = b.ids.copy()
        root[rows.column("uid").to_numpy() & ((1 << ROW_BITS) - 1)] = rows.column("root").to_numpy()
        _, keys, owner = signed(b)
        keys, root = keys & ~U((1 << 24) - 1), root[owner]  # 40 bits; a chance meeting costs a test
        order = np.lexsort((root, keys))
        keys, root = keys[order], root[order]
        new = np.ones(len(keys), bool)  # each (signature, root) once
        new[1:] = (keys[1:] != keys[:-1]) | (root[1:] != root[:-1])
        keys, root = keys[new], root[new]
        at = B.cut(keys, buckets)
        full = np.flatnonzero(np.diff(at))
        small = (keys >> U(24)).astype(np.uint64)
        ks = [B.planes(np.diff(small[at[i] : at[i + 1]], prepend=U(0))) for i in full]
        ms = [B.planes(root[at[i] : at[i + 1]]) for i in full]
        return pa.table([pa.array(full, pa.int32()), pa.array(np.full(len(full), b.batch)), pa.array(ks, pa.binary()), pa.array(ms, pa.binary())], ["bucket", "batch", "keys", "more"])

    def mixed(table: pa.Table) -> pa.Table:
        """The roots that share a signature, each with the smallest of them, its hub."""
        parts = [np.cumsum(B.numbers(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        keys, roots = np.concatenate(parts), np.concatenate([B.numbers(x, np.int64) for x in table.column("more").to_pylist()])
        order = np.lexsort((roots, keys))
        keys, roots = keys[order], roots[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        hubs = np.repeat(roots[first], np.diff(np.concatenate([first, [len(keys)]])))
        found = np.unique(np.stack([hubs, roots], axis=1)[hubs != roots], axis=0)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], ["hub", "root"])

    def draw(b: B.Batch, rows: pa.Table) -> pa.Table:
        """Sketches of the named texts: bit i is the parity of the elements whose hash falls on it."""
        if not len(rows):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())], SKETCH_NAMES)
        uid, index = np.unique(rows.column("uid").to_numpy(), return_index=True)
        sets = _some(b, uid & ((1 << ROW_BITS) - 1), shingle)
        blobs = [sketch(sets.of(i)).tobytes() for i in range(len(uid))]
        return pa.table([rows.column("root").take(pa.array(index)), rows.column("doc").take(pa.array(index)), pa.array(uid), pa.array(sets.size), pa.array(blobs, pa.binary())], SKETCH_NAMES)

    def compare(table: pa.Table) -> pa.Table:
        """Pairs of texts of different components that the sketches don't rule out."""
        out = near_sketches(table, percent)
        return pa.table([pa.array(out[:, i]) for i in range(4)], ["a", "a_uid", "b", "b_uid"])

    labels = B.stored(labels, "labels")
    met = B.stored(B.settle(batches, labels, ask_all, B.REQUEST).groupBy("bucket").applyInArrow(mixed, "hub long, root long").distinct(), "met")
    # all members of those components, with their sketches
    used = B.stored(met.select(F.explode(F.array("hub", "root")).alias("root")).distinct(), "used")
    node = docs.where("n > 0 and rep = doc_id").select("doc_id", "uid").join(roots, F.col("doc_id") == F.col("node"), "left")
    node = node.select(F.coalesce("root", "doc_id").alias("root"), F.col("doc_id").alias("doc"), "uid").join(used, "root", "left_semi")
    member = B.stored(B.settle(batches, node.withColumn("batch", batch_of("uid")), draw, SKETCH), "sketches")
    # a hub's group: its own members against those of the roots that met it, and these against each other, in squares of bounded size
    group = met.unionByName(met.select("hub", F.col("hub").alias("root")).distinct())
    count = member.groupBy("root").agg(F.count("*").alias("c"))
    sizes = group.join(count, "root").groupBy("hub").agg(F.sum("c").alias("all"), F.sum(F.when(F.col("root") != F.col("hub"), F.col("c"))).alias("others"))
    sizes = B.stored(sizes.select("hub", F.ceil(F.col("all") / SIDE).alias("columns"), F.ceil(F.col("others") / SIDE).alias("rows")), "sizes")
    rows = group.join(sizes, "hub").join(member, "root")
    salt = lambda n: F.pmod(F.xxhash64("uid"), F.col(n))
    upper = rows.where("root <> hub").select("hub", salt("rows").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("j"), F.lit(True).alias("upper"), *SKETCH_NAMES)
    lower = rows.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("i"), salt("columns").alias("j"), F.lit(False).alias("upper"), *SKETCH_NAMES)
    near = upper.unionByName(lower).groupBy("hub", "i", "j").applyInArrow(compare, pair)
    more = B.stored(linked(verified(near, "rest")), "more")
    if not more.isEmpty():
        roots = components(sure.unionByName(more))
    return docs.join(roots, docs["doc_id"] == roots["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
