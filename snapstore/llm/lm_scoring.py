"""Language-model scores from a subword lattice.

The pieces are those of an existing subword vocabulary, weighted by its own scores.  A word is a path through the
lattice of its pieces, and its probability is the sum over *all* paths, found by a forward recursion in log space.  The
vocabulary file at hand carries merge ranks as scores, not log probabilities; a piece of rank r weighs 1 / (r + 10)
(Zipf), over the sum of all.  With ``iterations``, that many rounds of expectation maximisation over the distinct words
of the training documents refit the weights to the corpus; each word weighs the same in them, as each gives up the
same discount (below).

A whole word that training has seen is one more arc of its lattice: its discounted relative frequency, with the
discounted mass left to the paths of pieces.  A text is its words and an end; its score is the sum of their log10
probabilities.

Flow, with nothing collected but (with iterations) one weight a piece:

    documents -> blocks of about 32 MB (no shuffle): distinct words with counts, documents as word places  [table]
    words -> counts over all blocks -> one row a distinct word                                              [table]
    (with iterations: distinct words -> expected piece counts -> piece probabilities)
    distinct words -> lattice log probability of each word
    (block, place) <- word                          one shuffle by word, one by block
    block: documents' sums
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import batches, lean, materialise, ship

_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The usable pieces of a vocabulary: their hashes by length, and the prior by rank.

    Pieces with upper-case A-Z can't occur in normalised text, and pieces with the word mark inside can't occur in a
    word; both are left out.  Places: 0 the byte piece (for characters without a piece), then the pieces.
    """

    MARK = "▁"

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        found, rank = [], []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
                continue
            if self.MARK in piece[1:] or any("A" <= c <= "Z" for c in piece) or any(c in " \t\n\r\x0b\x0c" for c in piece):
                continue
            found.append(piece)
            rank.append(-float(model.get_score(i)))
        self.strings = ["<byte>", *found]
        prior = np.array([1e-6, *(1.0 / (max(0.0, r) + 10) for r in rank)])
        self.prior = np.log(prior / prior.sum())
        by: dict[int, list[int]] = {}
        for k, s in enumerate(found):
            by.setdefault(len(s), []).append(k + 1)
        self.tables = {}
        for n, ids in sorted(by.items()):
            codes = np.array([[ord(c) for c in self.strings[k]] for k in ids], dtype="u8")
            h = np.zeros(len(ids), "u8")
            for j in range(n):
                h = h * _BASE + codes[:, j]
            order = np.argsort(h)
            bits = np.zeros(1 << 20, bool)
            bits[_mix(h) >> np.uint64(44)] = True
            self.tables[n] = (h[order], np.array(ids, dtype="i4")[order], bits)


def _mix(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def lattice(pieces: Pieces, log_p: np.ndarray, words: list[str], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of each word's marginal probability over all paths; with ``counts``, expected piece counts too."""
    out = np.zeros(len(words))
    expected = np.zeros(len(log_p)) if counts is not None else None
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        end, chars = at, 0
        longest = 0
        while end < len(order):
            n = len(words[order[end]]) + 1
            if end > at and (n > longest + 2 and end - at > 200 or (end - at + 1) * n > 150_000):
                break
            longest, end = max(longest, n), end + 1
            chars += n
        part = order[at:end]
        out[part] = _lattice_batch(pieces, log_p, [words[k] for k in part], longest, None if counts is None else counts[part], expected)
        at = end
    return out, expected


def _lattice_batch(pieces: Pieces, log_p: np.ndarray, words: list[str], width: int, counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
    n = len(words)
    sizes = np.array([len(w) + 1 for w in words])
    codes = np.zeros((n, width), dtype="u8")
    flat = np.frombuffer("".join(pieces.MARK + w for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes[np.arange(width) < sizes[:, None]] = flat
    single = np.full((n, width), -1, dtype="i4")
    edges: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(width + 1)]
    h = np.zeros((n, width), "u8")
    for length in range(1, min(width, max(pieces.tables)) + 1):
        h = h[:, : width - length + 1] * _BASE + codes[:, length - 1 :]
        table = pieces.tables.get(length)
        if table is None:
            continue
        hashes, ids, bits = table
        rows, cols = np.nonzero(bits[_mix(h) >> np.uint64(44)] & (np.arange(width - length + 1) + length <= sizes[:, None]))
        look = h[rows, cols]
        k = np.minimum(np.searchsorted(hashes, look), len(hashes) - 1)
        real = hashes[k] == look
        rows, cols, found = rows[real], cols[real], ids[k[real]]
        if length == 1:
            single[rows, cols] = found
        by_end = np.argsort(cols, kind="stable")
        rows, cols, found = rows[by_end], cols[by_end], found[by_end]
        cut = np.searchsorted(cols, np.arange(width - length + 2))
        for start in range(width - length + 1):
            a, b = cut[start], cut[start + 1]
            if b > a:
                edges[start + length].append((start, rows[a:b], found[a:b], log_p[found[a:b]]))
    rows, cols = np.nonzero((single < 0) & (np.arange(width) < sizes[:, None]))
    if len(rows):  # a character without a piece: its UTF-8 bytes, each 1 / 256 of the byte piece
        c = codes[rows, cols]
        size = 1 + (c >= 0x80).astype(int) + (c >= 0x800) + (c >= 0x10000)
        cost = size * (log_p[0] - math.log(256))
        by_end = np.argsort(cols, kind="stable")
        rows, cols, size, cost = rows[by_end], cols[by_end], size[by_end], cost[by_end]
        cut = np.searchsorted(cols, np.arange(width + 1))
        for start in range(width):
            a, b = cut[start], cut[start + 1]
            if b > a:
                edges[start + 1].append((start, rows[a:b], -size[a:b], cost[a:b]))
    forward = np.full((width + 1, n), -np.inf)
    forward[0] = 0
    for end in range(1, width + 1):
        row = forward[end]
        for start, r, _, lp in edges[end]:
            row[r] = np.logaddexp(row[r], forward[start][r] + lp)
    total = forward[sizes, np.arange(n)]
    if expected is not None:
        backward = np.full((width + 1, n), -np.inf)
        backward[sizes, np.arange(n)] = 0
        for end in range(width, 0, -1):
            row = backward[end]
            for start, r, found, lp in edges[end]:
                through = row[r] + lp
                share = np.exp(np.minimum(0, forward[start][r] + through - total[r])) * counts[r]
                byte = found < 0
                if byte.any():
                    expected[0] += float((share * -found * byte).sum())
                    expected += np.bincount(found[~byte], share[~byte], len(expected)) if (~byte).any() else 0
                else:
                    expected += np.bincount(found, share, len(expected)) if len(found) > 4000 else _sparse(found, share, expected)
                backward[start][r] = np.logaddexp(backward[start][r], through)
    return total


def _sparse(found: np.ndarray, share: np.ndarray, expected: np.ndarray) -> float:
    np.add.at(expected, found, share)
    return 0.0


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def score_documents(docs: DataFrame, vocabulary: str, train, iterations: int = 0, discount: float = 0.6, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``train`` is a boolean column of ``docs``: the rows to learn from (null: learn).  A-Z are lower-cased; tokens are
    the words between ASCII white space and one end.  ``base_score`` is the smoothed unigram word model's log10
    probability, ``score`` the lattice's (``iterations``: rounds that refit the pieces' weights; none by default).  Null and empty texts are the end alone; a null id is an id like others;
    repeated rows count and are scored each; without training rows all counts are 0 and the score comes from the
    prior; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"), F.spark_partition_id().alias("task"))
    names = ["block", "idx", "word", "c", "id", "train", "n_tokens", "places", "times"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
    ddl = "block long, idx int, word string, c long, id long, train boolean, n_tokens long, places binary, times binary"

    def blocks(source):
        place: dict[bytes, int] = {}
        counts, held, seq, task = np.zeros(1 << 12, "i8"), 0, 0, 0

        def words_of():
            block, n = (task << 24) + seq, len(place)
            words = pa.array(list(place), pa.binary()).cast(pa.string())
            for k in range(0, n, 50_000):
                m = min(50_000, n - k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block), pa.int64()), pa.array(np.arange(k, k + m, dtype="i4")), words.slice(k, m), pa.array(counts[k : k + m]), *(pa.nulls(m, t) for t in kinds[4:])], names)

        for batch in batches(source, "text", 1 << 20):
            task = batch.column("task")[0].as_py()
            rows = []
            for ident, text, learn in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("train").to_pylist(), strict=True):
                tokens = text.lower().split()
                at, times = np.unique(np.array([place.setdefault(w, len(place)) for w in tokens], dtype="i4"), return_counts=True)
                if len(place) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(place), "i8")])
                if learn:
                    counts[at] += times
                held += len(text) + 64
                rows.append(((task << 24) + seq, None, None, None, ident, learn, len(tokens) + 1, np.diff(at, prepend=0).astype("<i4").tobytes(), times.astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            if held >= block_bytes:
                yield from words_of()
                place, counts, held, seq = {}, np.zeros(1 << 12, "i8"), 0, seq + 1
        if place:
            yield from words_of()

    table = materialise(slim.mapInArrow(lean(blocks), ddl), "lm_scoring")
    words = materialise(table.where("word IS NOT NULL").groupBy("word").agg(F.sum("c").alias("c")), "lm_scoring")
    texts = table.where("word IS NULL")
    seen, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    ends = texts.where("train").count()
    n, v = seen + ends, types + (ends > 0)

    log_p = pieces_of(vocabulary).prior
    for _ in range(iterations if seen else 0):
        shared = spark.sparkContext.broadcast(log_p)  # one weight a piece of the vocabulary

        def expect(source, shared=shared):
            total = np.zeros(len(shared.value))
            for batch in source:
                total += lattice(pieces_of(vocabulary), shared.value, batch.column("word").to_pylist(), np.ones(batch.num_rows))[1]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["piece", "weight"])

        weight = np.full(len(log_p), 1e-3)
        for r in words.where("c > 0").select("word").mapInArrow(lean(expect), "piece long, weight double").groupBy("piece").agg(F.sum("weight").alias("weight")).collect():
            weight[r["piece"]] += r["weight"]
        log_p = np.log(weight / weight.sum())

    spelled = spark.sparkContext.broadcast(log_p)
    left = discount * v / n if n else 1.0

    def probability(source):
        for batch in source:
            by_pieces = lattice(pieces_of(vocabulary), spelled.value, batch.column("word").to_pylist())[0]
            c = batch.column("c").to_numpy(zero_copy_only=False)
            whole = np.log(np.maximum(np.maximum(c - discount, 0) / max(n, 1), 1e-300))
            lp = np.where(c > 0, np.logaddexp(whole, by_pieces + math.log(left)), by_pieces + math.log(left)) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(lp)], ["word", "c", "lp"])

    priced = words.mapInArrow(lean(probability), "word string, c long, lp double")
    looked = table.where("word IS NOT NULL").select(F.col("block").alias("home"), "idx", "word").join(priced, "word").select("home", "idx", "c", "lp")
    end_lp = math.log10(max(ends - discount, 0.5) / n) if n and ends else math.log10(0.5)
    floor = math.log10(n + 0.5 * (v + 1))

    def in_block(own: pa.Table, found: pa.Table) -> pa.Table:
        idx = found.column("idx").to_numpy()
        c, lp = np.zeros(len(idx), "i8"), np.zeros(len(idx))
        c[idx], lp[idx] = found.column("c").to_numpy(), found.column("lp").to_numpy()
        base, known = np.log10(c + 0.5), c > 0
        rows = []
        for ident, learn, n_tokens, places, times in zip(*(own.column(x).to_pylist() for x in ("id", "train", "n_tokens", "places", "times")), strict=True):
            at, k = np.cumsum(np.frombuffer(places, "<i4")), np.frombuffer(times, "<i4")
            rows.append((ident, not learn, n_tokens, int(k[known[at]].sum()) + (ends > 0), n, float((k * base[at]).sum()) + math.log10(ends + 0.5) - n_tokens * floor, float((k * lp[at]).sum()) + end_lp))
        out_kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, out_kinds, strict=True)], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    own = texts.select("block", "id", "train", "n_tokens", "places", "times")
    scored = own.groupBy("block").cogroup(looked.groupBy("home")).applyInArrow(in_block, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
