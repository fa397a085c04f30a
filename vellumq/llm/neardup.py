"""Near-duplicate texts by a prefix-tree join over sets of word 5-grams.

All sets are ordered by one global order, rare n-grams first, and only the prefix that any partner with
enough similarity must touch is kept. N-grams are dealt over partitions by hash; in a partition each
document is the ordered sequence of its prefix n-grams there, and these sequences are put into a trie, each once, with
links from an n-gram to its nodes. A document walks down the trie from the nodes of each of its n-grams, documents with the same
sequence share the path, and a subtree is left when its lengths and positions can no longer reach the overlap that is
needed. The overlaps of all partitions are added up, pairs that can't reach the threshold are dropped by the rest
of the lengths, and what is left (nearly only true pairs) is verified exactly on the full sets.

N-grams of very many documents are not put into one trie: their documents are dealt by bands of length, of which only neighbours can hold
partners, and by pairs of blocks; there, a bitmap of the whole set bounds the difference of two sets from below.

Equal sets are joined into one class before, so that copies are never compared with each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumq.functions.words import words
from vellumq.session import bound_arrow, cut, spread

GRAM = 5
#: Slots of the frequency sketch that gives the global order, and the slots of one of its rows.
SLOTS, BLOCK = 1 << 22, 1 << 12
#: The frequency class of a slot that was counted once.
ONCE = 1
#: Documents from which on an n-gram is dealt by bands and blocks, and the n-grams of a partition.
HOT, PART = 256, 600_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """64-bit hashes of the word 5-grams of texts; hashes of words are kept while they are few."""

    def __init__(self, most: int = 1_000_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, text: str | None, least_words: int) -> np.ndarray | None:
        w = words(text)
        if len(w) < max(least_words, GRAM):
            return None
        seen, digest = self.seen, xxhash.xxh3_64_intdigest
        for x in set(w).difference(seen):
            seen[x] = digest(x)
        h = np.fromiter(map(seen.__getitem__, w), np.uint64, len(w))
        if len(seen) > self.most:
            seen.clear()
        s = h[: len(h) - GRAM + 1].copy()
        for k in range(1, GRAM):
            s = (s ^ (s >> np.uint64(31))) * _MIX + h[k : len(h) - GRAM + 1 + k]
        return np.unique(s ^ (s >> np.uint64(29)))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def _sets(least_words: int):
    """Of each text its id, the hash and the size of its set; at the end of a partition the counts of the sketch, by blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, count, mask = Grams(), np.zeros(SLOTS, np.uint32), np.uint64(SLOTS - 1)
        names = ["id", "sig", "n", "counts", "block"]
        types = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32())
        for batch in batches:
            rows = []
            for i, text in _texts(batch):
                s = grams(text, least_words)
                if s is not None:
                    rows.append((i, xxhash.xxh3_128_digest(s.tobytes()), len(s), s))
            if rows:
                np.add(count, np.bincount((np.concatenate([r[3] for r in rows]) & mask).astype(np.int32), minlength=SLOTS).astype(np.uint32), out=count)
                cols = [*list(zip(*rows))[:3], [None] * len(rows), [None] * len(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        blocks = count.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        for at in range(0, len(used), 64):
            some = used[at : at + 64]
            none = [None] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((none, none, none, [zlib.compress(blocks[i].tobytes(), 1) for i in some], some), types)], names)

    return run


def _add_blocks(noise: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in _texts(batch):
                c = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
                total[block] = total[block] + c if block in total else c
        if total:
            scaled = [np.where(c == 1, ONCE, np.clip(np.round(8 * np.log2(np.maximum(c - noise, 0) + 1.0)), ONCE + 1, 255)).astype(np.uint8).tobytes() for c in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(scaled, pa.binary())], ["block", "counts"])

    return run


def frequency_classes(sets: DataFrame, noise: float) -> np.ndarray:
    """A frequency class (0..255) for each of ``SLOTS`` hash slots, counted over all documents, less the mean of a slot.

    4 MB whatever the input: it only fixes the global order and which n-grams are dealt by blocks, so collisions cost time, never pairs.
    """
    counts = sets.where("block is not null").select("block", "counts")
    out = np.zeros(SLOTS, np.uint8)
    for row in counts.repartition("block").mapInArrow(_add_blocks(noise), "block int, counts binary").collect():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.uint8)
    return out


def prefix_size(n: int, threshold: float) -> int:
    """N-grams of the ordered set that any set with the similarity must touch."""
    return n - ceil(threshold * n - 1e-9) + 1


def band_of(n: int, threshold: float) -> int:
    """Band of a size; sets that are near enough are in the same or in neighbouring bands."""
    return int(log(n) / -log(threshold) + 1e-9)


def bitmap(s: np.ndarray, band: int, threshold: float) -> bytes:
    """Parities of the n-grams of a set in about four times as many bits as its band has n-grams.

    The difference of two sets has at least as many n-grams as their bitmaps have bits that differ.
    """
    bits = 64 * ceil(4 * threshold ** -(band + 1) / 64)
    return np.packbits(np.bincount(((s >> np.uint64(8)) % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _mixed(*values: int) -> int:
    return xxhash.xxh3_64_intdigest(np.array(values, np.uint64).tobytes())


#: A document's n-gram as it is dealt: n-gram (or group of a hot one), set, size, place in the order, and for hot ones the role.
RECORD = np.dtype([("gram", "<u8"), ("sig", "V16"), ("n", "<i4"), ("place", "<i4"), ("role", "u1")])
GUEST, SECOND = 1, 2


def _deal(least_words: int, parts: int, threshold: float, hot: int, classes):
    """The prefixes of the sets of texts, dealt over parts: ``part, band, records, bits``; band is -1 for what goes into the trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, table, mask = Grams(), classes.value, np.uint64(SLOTS - 1)
        hot_class = 8 * log2(hot + 1)
        for batch in batches:
            made = (grams(t, least_words) for _, t in _texts(batch))
            sets = {xxhash.xxh3_128_digest(s.tobytes()): s for s in made if s is not None}  # of equal sets in a batch one goes on
            plain: list[np.ndarray] = []
            groups: dict[tuple[int, int], list[tuple]] = {}
            for sig, s in sets.items():
                n = len(s)
                c = table[(s & mask).astype(np.int64)]
                order = np.lexsort((s, c))[: prefix_size(n, threshold)]
                c = c[order]
                at = np.flatnonzero((c != ONCE) & (c <= hot_class))  # an n-gram that occurs once in the corpus has no partner
                r = np.empty(len(at), RECORD)
                r["gram"], r["sig"], r["n"], r["place"], r["role"] = s[order[at]], np.void(sig), n, at, 0
                plain.append(r)
                band = band_of(n, threshold)
                maps: dict[int, bytes] = {}
                for k in np.flatnonzero(c > hot_class).tolist():
                    g = int(s[order[k]])
                    many = ceil(2 ** ((float(c[k]) + 1) / 8) / hot)  # blocks of the n-gram's documents
                    mine = _mixed(g, int.from_bytes(sig[:8], "little")) % many
                    for b, guest in ((band, 0), (band + 1, GUEST)):
                        if b not in maps:
                            maps[b] = bitmap(s, b, threshold)
                        for other in range(many):
                            i, j = min(mine, other), max(mine, other)
                            key = _mixed(g, b, i, j)
                            groups.setdefault((key % parts, b), []).append((key, sig, n, k, guest | (SECOND if i != j and mine == j else 0), maps[b]))
            rows: list[tuple] = []
            every = np.concatenate(plain) if plain else np.empty(0, RECORD)
            to = ((every["gram"] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                if len(at):
                    rows.append((int(to[at[0]]), -1, every[at].tobytes(), b""))
            for (part, band), some in groups.items():
                r = np.empty(len(some), RECORD)
                for field, values in zip(("gram", "n", "place", "role"), ([x[k] for x in some] for k in (0, 2, 3, 4))):
                    r[field] = values
                r["sig"] = np.frombuffer(b"".join(x[1] for x in some), "V16")
                rows.append((part, band, r.tobytes(), b"".join(x[5] for x in some)))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "band", "records", "bits"])

    return run


def trie_join(doc: np.ndarray, gram: np.ndarray, place: np.ndarray, n: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
    """``(a, b, overlap here)`` of documents with enough n-grams in common to be near, as far as can be told here.

    Records are sorted by document and place; documents are numbered by growing size ``n``. Each sequence is inserted once; ``links`` has the nodes of an
    n-gram, so a walk starts at each node of an n-gram in common and goes down. A walk of b skips subtrees whose
    longest set is below ``threshold * n_b``, and documents whose positions leave too little for the overlap needed.
    """
    ratio = threshold / (1 + threshold)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    stops = np.r_[starts[1:], len(doc)].tolist()
    ids, starts = doc[starts].tolist(), starts.tolist()
    begin = dict(zip(ids, starts))
    gram, place, sizes = gram.tolist(), place.tolist(), n.tolist()
    label: list[int] = [0]
    depth: list[int] = [0]
    n_high: list[int] = [0]
    ends: list[list[int]] = [[]]
    children: list[dict[int, int]] = [{}]
    links: dict[int, list[int]] = {}
    for b, lo, hi in zip(ids, starts, stops):
        n_b = sizes[b]
        least = threshold * n_b - 1e-9
        g = gram[lo:hi]
        mine = set(g)
        found: dict[int, int] = {}
        seen: set[int] = set()  # a node below one that was walked through leads to the same documents
        for k, first in enumerate(g):
            j = place[lo + k]
            for top in links.get(first, ()):
                if n_high[top] < least or top in seen:
                    continue
                at = depth[top] - 1
                walk = [(top, 1)]
                while walk:
                    node, overlap = walk.pop()
                    for a in ends[node]:
                        n_a = sizes[a]
                        if n_a >= least:
                            i = place[begin[a] + at]
                            if min(i, j) + min(n_a - i, n_b - j) >= ratio * (n_a + n_b) - 1e-9:
                                found[a] = overlap
                    for child in children[node].values():
                        if n_high[child] >= least:
                            seen.add(child)
                            walk.append((child, overlap + (label[child] in mine)))
        for a, overlap in found.items():
            yield a, b, overlap
        node = 0
        for x in g:
            child = children[node].get(x)
            if child is None:
                child = children[node][x] = len(label)
                label.append(x)
                depth.append(depth[node] + 1)
                n_high.append(n_b)
                ends.append([])
                children.append({})
                links.setdefault(x, []).append(child)
            node = child
            n_high[node] = n_b  # documents come by growing size
        ends[node].append(b)


def hot_pairs(r: np.ndarray, bits: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``(a, b)`` of one group of a hot n-gram that lengths, positions and bitmaps allow to be near."""
    order = np.argsort(r["n"], kind="stable")
    n, place, role = (r[k][order].astype(np.int64) for k in ("n", "place", "role"))
    bits = bits[order]
    cross = bool((role & SECOND).any())
    ratio = threshold / (1 + threshold)
    out_a, out_b = [], []
    low = np.searchsorted(n, threshold * n - 1e-9)
    for b in range(1, len(n)):
        a = np.arange(low[b], b)
        a = a[((role[a] & GUEST) == 0) | ((role[b] & GUEST) == 0)]
        if cross:
            a = a[(role[a] & SECOND) != (role[b] & SECOND)]
        if len(a):
            need = ratio * (n[a] + n[b]) - 1e-9
            a = a[np.minimum(place[a], place[b]) + np.minimum(n[a] - place[a], n[b] - place[b]) >= need]
        if len(a):
            apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1)
            a = a[n[a] + n[b] - apart >= 2 * (ratio * (n[a] + n[b]) - 1e-9)]
        if len(a):
            out_a.append(order[a])
            out_b.append(np.full(len(a), order[b]))
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _pairs(sa: list, sb: list, n_a: list, n_b: list, c: list) -> pa.RecordBatch:
    types = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((sa, sb, n_a, n_b, c), types)], ["sa", "sb", "n_a", "n_b", "c"])


def _join(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: list[bytes] = []
        hot: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for band, records, bits in zip(*(batch.column(k).to_pylist() for k in ("band", "records", "bits"))):
                if band < 0:
                    raw.append(records)
                else:
                    r = np.frombuffer(records, RECORD)
                    hot.setdefault(band, []).append((r, np.frombuffer(bits, np.uint64).reshape(len(r), -1)))
        for some in hot.values():
            r, bits = np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some])
            # equal sets from several batches count once in a group
            keyed = np.empty(len(r), np.dtype([("gram", "<u8"), ("a", "<u8"), ("b", "<u8")]))
            keyed["gram"], (keyed["a"], keyed["b"]) = r["gram"], np.ascontiguousarray(r["sig"]).view("<u8").reshape(-1, 2).T
            _, at = np.unique(keyed, return_index=True)
            r, bits = r[at], bits[at]
            for group in np.split(np.arange(len(r)), np.flatnonzero(np.diff(r["gram"])) + 1):
                a, b = hot_pairs(r[group], bits[group], threshold)
                a, b = group[a], group[b]
                for lo in range(0, len(a), 50_000):
                    x, y = r[a[lo : lo + 50_000]], r[b[lo : lo + 50_000]]
                    yield _pairs([v.tobytes() for v in x["sig"]], [v.tobytes() for v in y["sig"]], x["n"], y["n"], np.ones(len(x), np.int32))
        r = np.frombuffer(b"".join(raw), RECORD)
        raw.clear()
        _, gram, count = np.unique(r["gram"], return_inverse=True, return_counts=True)
        keep = count[gram] > 1
        r, gram = r[keep], gram[keep]
        if not len(r):
            return
        sig = np.ascontiguousarray(r["sig"]).view("<u8").reshape(-1, 2)
        # documents numbered by growing size; equal sets are one
        key = np.empty(len(r), np.dtype([("n", "<i4"), ("a", "<u8"), ("b", "<u8")]))
        key["n"], key["a"], key["b"] = r["n"], sig[:, 0], sig[:, 1]
        every, doc = np.unique(key, return_inverse=True)
        code = doc.astype(np.int64) << 32 | gram
        _, at = np.unique(code, return_index=True)
        doc, gram, place = doc[at], gram[at], r["place"][at]
        count = np.bincount(gram)
        keep = count[gram] > 1  # what one document alone has here leads to nobody
        doc, gram, place = doc[keep], gram[keep], place[keep]
        if not len(doc):
            return
        order = np.lexsort((place, doc))
        names = np.stack([every["a"], every["b"]], axis=1).tobytes()
        rows: list[tuple[int, int, int]] = []

        def batch_of(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            a, b, c = zip(*rows)
            name = lambda x: [names[16 * k : 16 * k + 16] for k in x]
            return _pairs(name(a), name(b), every["n"][list(a)], every["n"][list(b)], list(c))

        for row in trie_join(doc[order], gram[order], place[order], every["n"], threshold):
            rows.append(row)
            if len(rows) >= 50_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return run


#: Bits of the row keys in the bitmap of those that are verified.
WANTED_BITS = 28


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = np.unique(np.concatenate([np.empty(0, np.int64), *(b.column(0).to_numpy() & ((1 << WANTED_BITS) - 1) for b in batches)]))
    for part in np.split(slots, np.flatnonzero(np.diff(slots >> 16)) + 1):
        if len(part):
            bits = np.zeros(1 << 16, bool)
            bits[part & 0xFFFF] = True
            yield pa.RecordBatch.from_arrays([pa.array([int(part[0] >> 16)], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["block", "bits"])


def _full_sets(least_words: int, bits):
    """The sets of the texts whose row key is in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, there = Grams(), bits.value
        for batch in batches:
            at = batch.column("key").to_numpy() & ((1 << WANTED_BITS) - 1)
            some = batch.filter(pa.array((there[at >> 3] & (128 >> (at & 7)).astype(np.uint8)) != 0))
            made = (grams(t, least_words) for t in some.column("text").to_pylist())
            sets = {xxhash.xxh3_128_digest(raw): raw for s in made if s is not None for raw in (s.tobytes(),)}
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.array(list(sets.values()), pa.binary())], ["sig", "grams"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).size for x, y in zip(batch.column("g_a").to_pylist(), batch.column("g_b").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("sa"), batch.column("sb"), batch.column("n_a"), batch.column("n_b"), pa.array(both, pa.int32())], ["sa", "sb", "n_a", "n_b", "shared"])


def near_duplicates(df: DataFrame, threshold: float = 0.8, id_col: str = "id", text_col: str = "extracted_text", least_words: int = 10, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: members ``id, rep, n`` and links ``a, b, jaccard`` between representatives.

    Documents with the same set of 5-grams have the same ``rep``, the smallest id among them. ``links`` has each
    pair of representatives a < b whose sets have ``shared >= threshold * union``; none is lost. Documents
    of fewer than ``least_words`` words, null and empty texts are in neither. Ids that come twice count once
    (rows of an id have the same text). Other columns are ignored whatever their names. ``hot`` is the number of documents from which on an
    n-gram is dealt by bands and blocks; it changes the work, not the result.
    """
    spark = df.sparkSession
    bound_arrow(spark)
    docs = spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null"))
    every = cut(docs.mapInArrow(_sets(least_words), "id bigint, sig binary, n int, counts binary, block int"))
    sets = every.where("id is not null")
    total = sets.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("grams")).first()
    noise = total["grams"] / SLOTS
    hot = int(max(hot, 12 * noise**0.5))  # counts of the sketch vary by chance, the more the fuller it is
    classes = spark.sparkContext.broadcast(frequency_classes(every, noise if noise > 1 else 0.0))
    reps = sets.groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    members = sets.select("id", "sig").distinct().join(reps, "sig").select("id", "rep", "n")
    # a part holds its n-grams in one worker, so there are more of them for more n-grams
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, int((total["grams"] * (1 - threshold) + total["docs"]) / PART))
    dealt = docs.mapInArrow(_deal(least_words, parts, threshold, hot, classes), "part int, band int, records binary, bits binary")
    met = dealt.repartition(parts, "part").mapInArrow(_join(threshold), "sa binary, sb binary, n_a int, n_b int, c int")
    rest = lambda n: F.ceil(threshold * F.col(n) - 1e-9) - 1  # noqa: E731  n-grams behind the prefix
    could = (
        met.groupBy("sa", "sb").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("c").alias("c"))
        .where(F.col("c") + F.greatest(rest("n_a"), rest("n_b")) >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    )
    could = cut(could.select("sa", "sb", "n_a", "n_b"))
    # the texts whose sets are verified are found by a bitmap of fixed size (32 MB)
    wanted = could.select(F.explode(F.array("sa", "sb")).alias("sig")).distinct().join(reps, "sig").select(F.xxhash64("rep").alias("key"))
    bits = np.zeros(1 << (WANTED_BITS - 3), np.uint8)
    for r in wanted.mapInArrow(_slots, "block int, bits binary").toLocalIterator():
        at = r["block"] << 13
        bits[at : at + 8192] |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(bits)
    full = docs.select(F.xxhash64("id").alias("key"), "text").mapInArrow(_full_sets(least_words, shared), "sig binary, grams binary").groupBy("sig").agg(F.first("grams").alias("grams"))
    both = could.join(full.select(F.col("sig").alias("sa"), F.col("grams").alias("g_a")), "sa").join(full.select(F.col("sig").alias("sb"), F.col("grams").alias("g_b")), "sb")
    checked = both.mapInArrow(_verify, "sa binary, sb binary, n_a int, n_b int, shared int")
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    near = checked.where(F.col("shared") >= threshold * union - 1e-9).select("sa", "sb", (F.col("shared") / union).alias("jaccard"))
    name = reps.select("sig", "rep")
    links = near.join(name.select(F.col("sig").alias("sa"), F.col("rep").alias("x")), "sa").join(name.select(F.col("sig").alias("sb"), F.col("rep").alias("y")), "sb")
    return members, links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id1 < id2`` of all near-duplicate documents: links between classes, and pairs inside a class."""
    m1 = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    m2 = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.select("a", "b").join(m1, "a").join(m2, "b").select(F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2"))
    inside = m1.join(m2, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("id1"), F.col("y").alias("id2"))
    return across.unionByName(inside)


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per document: ``id, class_id, copies, n_links``, links counted between different texts.

    ``class_id`` is the representative of the equal texts, ``copies`` how many documents it stands for,
    ``n_links`` the number of other classes that are near-duplicates.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    classes = members.groupBy("rep").agg(F.count("*").alias("copies")).join(ends, "rep", "left")
    return members.join(classes, "rep").select("id", F.col("rep").alias("class_id"), "copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
