"""Near-duplicate groups by MinHash: one-permutation hashing, optimal densification, banded buckets, star edges.

1. One pass over the texts gives each document its set size, a key of its full set, a one-permutation signature
   (the set's hashes fall into bins by their top bits; a bin keeps its least hash; an empty bin borrows from a bin
   that a fixed random sequence of its own finds first) and the hashes of its bands.            [scratch table]
2. Documents with the same full set are one class, named by its smallest id; only classes go on.
3. Each bucket links its members to its smallest member: a star, so edges grow with members, never with pairs.
4. Edges whose sizes or signatures rule out the threshold go; the others are confirmed on full sets.
5. Connected components by alternating large and small stars.
6. What a star can miss (two members like each other but unlike the centre) is made good exactly.  In each bucket that
   still holds more than one component, the documents outside its largest component are held against all others by
   sizes and signatures; the pairs that could link give a forest, whose trees are clusters.  Only in those are full
   sets compared, leaving out pairs that links found before already connect.  Buckets and clusters return forests only,
   never their pairs.  Components are found again with them.

A bucket or class that holds a third of all rows is combined before the shuffle (minimum, count) and its joins
are sort-merge joins, whose hot partitions Spark splits; step 6 deals large buckets out in cells of ``cell`` signatures
a side, and large clusters in cells of ``cell_shingles`` shingles a side (2 MB).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import batches, lean, materialise, ship

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _K2
    h = (h ^ (h >> np.uint64(27))) * _K3
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int, limit: int = 150_000):
        import xxhash

        self.words, self.limit, self.memo, self.hash = words, limit, {}, xxhash.xxh3_64_intdigest

    def of(self, text: bytes) -> np.ndarray:
        tokens = text.lower().split()
        if not tokens:
            return np.zeros(0, "u8")
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        found = [memo.get(t) for t in tokens]
        if None in found:
            for k, h in enumerate(found):
                if h is None:
                    t = tokens[k]
                    found[k] = memo[t] = self.hash(t)
        h = np.array(found, dtype="u8")
        n = len(h) - self.words + 1
        size = self.words if n > 0 else len(h)
        out = np.full(max(n, 1), size, dtype="u8")
        for j in range(size):
            out = _mix(out * _K1 + h[j : j + len(out)])
        return np.unique(out)


class Signer:
    """One-permutation MinHash with optimal densification, and band hashes."""

    def __init__(self, bands: int = 32, rows: int = 4, seed: int = 11):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.borrow = np.random.default_rng(seed).integers(0, self.bins, size=(1024, self.bins))
        self.names = _mix(np.arange(1, bands + 1, dtype="u8") * _K1)

    def own_bins(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least hash of each bin that has one, and which have; ``shingles`` is not empty."""
        spread = np.sort(_mix(shingles ^ _K1))
        high, low = (spread >> np.uint64(32)), spread & np.uint64(0xFFFFFFFF)
        bins = ((high * np.uint64(self.bins)) >> np.uint64(32)).astype("i8")
        at, first = np.unique(bins, return_index=True)
        sig, full = np.zeros(self.bins, "u8"), np.zeros(self.bins, bool)
        sig[at], full[at] = _mix(low[first] + (high[first] << np.uint64(32))), True
        return sig, full

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The least hash of each bin, borrowed where a bin has none."""
        return self.densified(*self.own_bins(shingles))

    def densified(self, sig: np.ndarray, own: np.ndarray) -> np.ndarray:
        sig, at, empty = sig.copy(), np.flatnonzero(own), np.flatnonzero(~own)
        for probe in self.borrow:
            if not len(empty):
                break
            lender = probe[empty]
            hit = own[lender]
            sig[empty[hit]] = sig[lender[hit]]
            empty = empty[~hit]
        for e in empty:  # the random sequence ran out: the next full bin
            sig[e] = sig[at[np.searchsorted(at, e) % len(at)]]
        return sig

    def band_hashes(self, sig: np.ndarray) -> np.ndarray:
        h = self.names.copy()
        for column in sig.reshape(self.bands, self.rows).T:
            h = _mix(h * _K1 + column)
        return h.view("i8")


def sketch(sig: np.ndarray, own: np.ndarray) -> bytes:
    """16 bits of each bin; 0 where the bin has no hash of its own."""
    return np.where(own, sig.astype("u2") | np.uint16(1), 0).astype("u2").tobytes()


def may_link(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, threshold: float) -> np.ndarray:
    """Estimated similarity where the threshold is in reach, -1 elsewhere.

    The estimate is the share of equal bins among those that either set fills.  Bins are a sample of the union without
    replacement, so its error shrinks to nothing as sets get smaller than the bins; five standard deviations are left.
    """
    filled = ((x > 0) | (y > 0)).sum(axis=-1)
    share = ((x == y) & (x > 0)).sum(axis=-1) / np.maximum(filled, 1)
    union = (n_x + n_y) / (1 + threshold)
    deviation = np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1) * np.clip(1 - filled / np.maximum(union, 1), 0.02, 1))
    return np.where(share >= threshold - 5 * deviation - 1.5 / np.maximum(filled, 1), share, -1.0)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two full sets (sorted distinct hashes) reach the threshold."""
    common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
    return 100 * common >= percent * (len(x) + len(y) - common)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp`` (smallest node reachable) of every node of ``edges`` (a, b), by alternating stars."""
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near_dedup")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = materialise(small.where("a <> b").distinct(), "near_dedup")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
        before = state


def _groups(names):
    """``find`` and ``join`` of disjoint groups of ``names``."""
    above = {x: x for x in names}

    def find(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    def join(x, y):
        above[find(x)] = find(y)

    return find, join


class NearDedup:
    """The steps over one table of documents; ``result`` is the whole operator."""

    def __init__(self, docs: DataFrame, shingle_words: int, percent: int, bands: int, rows: int, id_col: str, text_col: str, cell: int, cell_shingles: int):
        ship(docs.sparkSession)
        self.cell_shingles = cell_shingles
        self.spark, self.words, self.percent, self.bands, self.rows, self.cell = docs.sparkSession, shingle_words, percent, bands, rows, cell
        self.texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def signatures(self) -> DataFrame:
        words, bands, rows = self.words, self.bands, self.rows

        def run(source):
            shingler, signer = Shingler(words), Signer(bands, rows)
            for batch in batches(source, "text", 1 << 20):
                out = []
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    s = shingler.of(text)
                    if len(s):
                        sig, own = signer.own_bins(s)
                        out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch(sig, own), signer.band_hashes(signer.densified(sig, own))))
                    else:
                        out.append((0, None, None, None))
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["id", "n", "key", "sig", "bands"])

        return materialise(self.texts.mapInArrow(lean(run), "id long, n long, key binary, sig binary, bands array<long>"), "near_dedup")

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """Full sets of the documents with these ids: ``node``, ``shingles``."""
        words = self.words

        def run(source):
            shingler = Shingler(words)
            for batch in batches(source, "text", 1 << 20):
                sets = [shingler.of(t).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["node", "shingles"])

        # a merge join at every size: the ids grow with the corpus, so a plan that broadcasts them can't last
        wanted = self.texts.join(ids.select(F.col("node").alias("id")).distinct().hint("merge"), "id", "left_semi")
        return materialise(wanted.mapInArrow(lean(run), "node long, shingles binary"), "near_dedup")

    def screened(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """Edges (a, b) that sizes and signatures do not rule out."""
        bins, percent = self.bands * self.rows, self.percent
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
        both = edges.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

        def run(source):
            for batch in source:
                if batch.num_rows:
                    x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u2").reshape(-1, bins) for c in ("sig_a", "sig_b"))
                    near = may_link(x, y, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent / 100) >= 0
                    yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

        return both.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(lean(run), "a long, b long")

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the threshold."""
        percent = self.percent
        side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b")

        def run(source):
            for batch in source:
                keep = [linked(np.frombuffer(x, "u8"), np.frombuffer(y, "u8"), percent) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return materialise(both.mapInArrow(lean(run), "a long, b long"), "near_dedup")

    def cells(self, inside: DataFrame, weight: str, limit: int, extra: tuple[str, ...] = ()) -> DataFrame:
        """Rows (cluster, node, comp, n, sig) dealt to cells (cluster, x, y) in which every pair of a document outside
        its cluster's largest component and any other document meets.

        A cell holds a chunk of strays and one more chunk, of strays or of the largest component; a chunk has about
        ``limit`` of ``weight``.
        """
        by_comp = inside.groupBy("cluster", "comp").agg(F.sum(weight).alias("size"))
        largest = by_comp.groupBy("cluster").agg(F.max_by("comp", "size").alias("main"), F.max("size").alias("main_size"), F.sum("size").alias("all_size"))
        side = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(limit))).cast("long")
        sized = largest.select("cluster", "main", side(F.col("all_size") - F.col("main_size")).alias("strays"), side(F.col("main_size")).alias("mains"))
        up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        rows = inside.join(sized, "cluster").withColumn("stray", F.col("comp") != F.col("main"))
        rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("mains"))))
        with_strays = F.transform(up_to(F.col("strays")), lambda j: F.struct(F.least("mine", j).alias("x"), F.greatest("mine", j).alias("y")))
        with_mains = F.transform(up_to(F.col("mains")), lambda j: F.struct(F.col("mine").alias("x"), (-1 - j).alias("y")))
        as_main = F.transform(up_to(F.col("strays")), lambda i: F.struct(i.alias("x"), (-1 - F.col("mine")).alias("y")))
        rows = rows.withColumn("at", F.explode(F.when(F.col("stray"), F.concat(with_strays, with_mains)).otherwise(as_main)))
        dealt = rows.select("cluster", "at.x", "at.y", "stray", "node", "comp", "n", "sig", *extra)
        return dealt.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "node")

    def in_cells(self, dealt: DataFrame, links) -> DataFrame:
        """Pairs (a, b), a > b, that ``links`` gives for each cell: ``links(rows, pairs)`` gets the cell's columns from
        ``node`` on, and ``pairs``: for each stray its row and those rows of other components, the likeliest first,
        that sizes and signatures let link with it."""
        bins, percent = self.bands * self.rows, self.percent
        names = dealt.columns

        def leave(held):
            stray, node, comp, n, sig, *extra = zip(*held, strict=True)
            stray, node, comp, n = (np.array(c) for c in (stray, node, comp, n))
            sig = np.frombuffer(b"".join(sig), "u2").reshape(-1, bins)

            def pairs():
                for i in np.flatnonzero(stray):
                    later = np.arange(len(n)) > i
                    j = np.flatnonzero((later | ~stray) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (comp != comp[i]))
                    if len(j):
                        share = may_link(sig[j], sig[i], n[j], n[i], percent / 100)
                        yield int(i), j[np.argsort(-share, kind="stable")[: int((share >= 0).sum())]].tolist()

            found = [(max(int(node[i]), int(node[k])), min(int(node[i]), int(node[k]))) for i, k in links((node, comp, *extra), pairs())]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], ["a", "b"])

        def run(source):
            held, key = [], None
            for batch in source:
                for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    if r[:3] != key:
                        if len(held) > 1:
                            yield leave(held)
                        held, key = [], r[:3]
                    held.append(r[3:])
            if len(held) > 1:
                yield leave(held)

        return materialise(dealt.mapInArrow(lean(run), "a long, b long"), "near_dedup")

    def missed(self, nodes: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between components that share a bucket (a, b): those that connect, not all of them."""
        percent = self.percent
        labelled = materialise(nodes.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "n", "sig", "bands"), "near_dedup")
        members = labelled.select("node", "comp", F.explode("bands").alias("bucket"))
        mixed = members.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket")
        inside = members.join(mixed, "bucket").select(F.col("bucket").alias("cluster"), "node", "comp").join(labelled.select("node", "n", "sig"), "node")

        def likely(rows, pairs):
            """A forest of the pairs that sizes and signatures let link."""
            node, comp = rows
            find, join = _groups(range(len(node)))
            for i, others in pairs:
                for k in others:
                    if find(k) != find(i):
                        join(k, i)
                        yield i, k

        near = self.in_cells(self.cells(inside.withColumn("one", F.lit(1)), "one", self.cell), likely)
        if near.isEmpty():
            return near
        inside = components(near).select("node", F.col("comp").alias("cluster")).join(labelled.select("node", "comp", "n", "sig"), "node")

        def confirmed(rows, pairs):
            """A forest, over components, of the pairs whose full sets reach the threshold."""
            _, comp, shingles = rows
            comp, held = comp.tolist(), [np.frombuffer(x, "u8") for x in shingles]
            find, join = _groups(comp)
            for i, others in pairs:
                for k in others:
                    if find(comp[k]) != find(comp[i]) and linked(held[i], held[k], percent):
                        join(comp[k], comp[i])
                        yield i, k

        return self.in_cells(self.cells(inside.join(sets.select("node", "shingles"), "node"), "n", self.cell_shingles, ("shingles",)), confirmed)

    def result(self) -> DataFrame:
        table = self.signatures()
        classes = materialise(table.where("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("node")), "near_dedup")
        nodes = materialise(table.join(classes, "key").where("id = node").select("node", "n", "sig", "bands"), "near_dedup")
        members = nodes.select("node", F.explode("bands").alias("bucket"))
        stars = members.groupBy("bucket").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", "b")
        edges = materialise(members.join(stars, "bucket").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "near_dedup")
        sets = self.sets_of(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))))
        found = self.confirm(self.screened(edges, nodes), sets)
        comps = components(found)
        more = self.missed(nodes, comps, sets)
        if not more.isEmpty():
            comps = components(found.unionByName(more))
        named = table.select("id", "n", "key").join(classes.withColumnRenamed("node", "own"), "key", "left").join(comps.select(F.col("node").alias("own"), "comp"), "own", "left")
        return named.select("id", F.col("n").alias("n_shingles"), F.coalesce("comp", "own", "id").alias("component_id"))


def near_dedup(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, id_col: str = "doc_id", text_col: str = "text", cell: int = 2048, cell_shingles: int = 1 << 18) -> DataFrame:
    """One row per input row: id, ``n_shingles`` (set size), ``component_id``, ``kept`` (the id is the component's).

    Sets are distinct shingles of ``shingle_words`` words (A-Z lower-cased, cut at ASCII white space); fewer words are
    one shingle; null, empty and white texts have an empty set and link with nothing.  Documents link from ``percent``
    on: 100 x intersection >= percent x union.  Rows that repeat an id count as one document of the graph.  Rows with
    a null id link with nothing, have a null component and are kept.  An empty table gives an empty result; other
    columns are not read.
    """
    out = NearDedup(docs, shingle_words, percent, bands, rows, id_col, text_col, cell, cell_shingles).result()
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
