"""Benchmark decontamination by template canonicalisation.

A text becomes a *template*: numbers, units after numbers, and names (capitalised words inside a sentence) are
replaced with typed placeholders; other words are lower-cased and stripped of marks at their ends.  A capitalised word
that begins a sentence may be a name or not: windows over it are taken in both readings.  A window without any
literal word says nothing as a template, so it is keyed by its values (a table of numbers meets an item in its own
numbers only).

*Hash join*: of each benchmark item only so many windows are needed as keys that no copy can avoid them: the windows
left out, the most frequent of the benchmark first, cover less of the item than a copy must.  The keys are a hash
table; the windows of every document are looked up in it.

*Verification*: around a hit, all windows of the item are looked up.  Hits of one offset (document place - item
place) are a line.  The longest line comes first; others add places of the item that are still free and stand in the
same order in both texts.  Each placeholder place gives a pair (benchmark value, document value); a re-parameterised
question maps each value to one value and back, and a line whose pairs contradict that is no copy.  A document is
contaminated by an item when the places found cover enough of the item's template.

The benchmark is the stated query set: it is taken in blocks of at most ``block_windows`` windows, and each block
is held against all documents in one pass without a shuffle, so no key of the documents can be hot.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import batches, lean, materialise, ship, with_decisions

#: Units that are placeholders when they follow a number.
UNITS = frozenset(
    "% $ € £ ¥ ° mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl dl l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards mile miles gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres "
    "dollar dollars cent cents euro euros percent degree degrees kb mb gb tb hz khz mhz ghz w kw kwh v kv mph kmh km/h m/s j kj cal kcal pa kpa".split()
)
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
_NUMBER_UNIT = re.compile(r"([+-]?\d[\d.,:/]*)([^\W\d_]{1,4}|[%°€$£¥])")
_MONEY = re.compile(r"([$€£¥])(\d[\d.,]*)")
_UNIT_MARKS = frozenset("%$€£¥°")
_BEFORE_NUMBERS = frozenset("+-%$€£¥°")
WORD, NUM, UNIT, NAME = 0, 1, 2, 3
_BASE = 0x9E3779B97F4A7C15


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


class Words:
    """Template words of several texts, one after another: hash, kind, hash of the value, whether the word may be a name
    too (it begins a sentence), and the text it belongs to; ``first`` has each text's first word, and the end."""

    __slots__ = ("either", "first", "hash", "kind", "text", "value")

    def __init__(self, hash_, kind, value, either, text, texts: int):
        self.hash, self.kind, self.value, self.either, self.text = hash_, kind, value, either, text
        self.first = np.searchsorted(text, np.arange(texts + 1))

    def part(self, low: int, high: int) -> Words:
        """The words from ``low`` up to ``high`` as those of one text."""
        cut = slice(low, high)
        return Words(self.hash[cut], self.kind[cut], self.value[cut], self.either[cut], np.zeros(len(self.hash[cut]), "i4"), 1)


#: Marks that end a sentence.
_ENDS = frozenset(".!?:;…")


class Templates:
    """Template words of whole texts, with a bounded memo of white-space tokens.

    With a ``vocabulary`` (the literal words of the items) every lower-case word outside it is one and the same unknown
    word: no window over it can be an item's.
    """

    def __init__(self, vocabulary: frozenset[str] | None = None, limit: int = 150_000):
        self.vocabulary, self.limit, self.full = vocabulary, limit, 0
        self.placeholders = np.array([0, *(_hash(f"\x00{k}") for k in ("<num>", "<unit>", "<name>"))], dtype="u8")
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.at, self.count = np.zeros(1 << 12, "i8"), np.zeros(1 << 12, "i8")
        self.words = np.zeros(1 << 12, [("hash", "u8"), ("value", "u8"), ("kind", "i1"), ("ends", "i1")])
        unknown = _hash("\x00<unknown>")
        self.sizes: list[int] = []
        self.new: list[tuple[int, int, int, int]] = []
        self.n_tokens, self.n_words = 0, 0
        for ends in (0, 1):  # tokens 0 and 1: an unknown word, and one that ends a sentence
            self._add(((unknown, unknown, WORD, ends),))
        self._flush()

    def _add(self, found: tuple[tuple[int, int, int, int], ...]) -> int:
        self.sizes.append(len(found))
        self.new += found
        return self.n_tokens + len(self.sizes) - 1

    def _flush(self) -> None:
        n, m, sizes = self.n_tokens, self.n_words, np.array(self.sizes, "i8")
        while n + len(sizes) > len(self.at):
            self.at, self.count = (np.concatenate([x, np.zeros(len(x), "i8")]) for x in (self.at, self.count))
        while m + len(self.new) > len(self.words):
            self.words = np.concatenate([self.words, np.zeros(len(self.words), self.words.dtype)])
        self.count[n : n + len(sizes)], self.at[n : n + len(sizes)] = sizes, m + np.cumsum(sizes) - sizes
        if self.new:
            own = self.words[m : m + len(self.new)]
            h, v, k, e = zip(*self.new, strict=True)
            own["hash"], own["value"], own["kind"], own["ends"] = np.array(h, "u8"), np.array(v, "u8"), k, e
        self.n_tokens, self.n_words = n + len(sizes), m + len(self.new)
        self.sizes, self.new = [], []

    def _learn(self, token: str) -> int:
        """The place of a new token in the tables."""
        if token.isalpha():
            core, ends = token, 0
        else:
            core, ends = token[:-1], int(token[-1] in _ENDS)
            if not core.isalpha() or token[-1].isalnum() or token[-1] in "\"')]}»”’":
                return self._add(self._token(token))
        if self.vocabulary is not None and core.islower() and core not in self.vocabulary and core not in UNITS:
            return ends
        return self._add((self._word(core, ends),))

    @staticmethod
    def _word(word: str, ends: int) -> tuple[int, int, int, int]:
        low = word.lower()
        h = _hash(low)
        return h, h, UNIT if low in UNITS else NAME if word[0].isupper() and (len(word) == 1 or word[1:].islower()) else WORD, ends

    def _token(self, token: str) -> tuple[tuple[int, int, int, int], ...]:
        """For each template word of a token: hash, hash of its value, kind (UNIT: only after a number; NAME: only inside a
        sentence; -1: marks alone that end a sentence), whether it ends a sentence."""
        ends = int(token.rstrip("\"')]}»”’")[-1:] in _ENDS)
        bare = token.strip("\"'()[]{}«»“”‘’.,;:!?…")
        if bare[:1].isdigit() or bare[:1] in _BEFORE_NUMBERS:
            if m := _MONEY.fullmatch(bare):
                return (_hash(m[1]), _hash(m[1]), UNIT + 8, 0), (0, _hash(m[2].rstrip(".,")), NUM, ends)
            if m := _NUMBER_UNIT.fullmatch(bare):
                unit = _hash(m[2].lower())
                return (0, _hash(m[1].rstrip(".,")), NUM, 0), (unit, unit, UNIT, ends)
            if _NUMBER.fullmatch(bare):
                return ((0, _hash(bare.rstrip(".,")), NUM, ends),)
            if bare in _UNIT_MARKS:
                return ((_hash(bare), _hash(bare), UNIT, ends),)
        a, b = 0, len(token)
        while a < b and not token[a].isalnum():
            a += 1
        while b > a and not token[b - 1].isalnum():
            b -= 1
        if a == b:
            return ((0, 0, -1, 1),) if ends else ()
        return (self._word(token[a:b], ends),)

    def of(self, texts: list[str | None]) -> Words:
        """Template words of whole texts; null counts as empty."""
        tokens, sizes, memo = [], [], self.memo
        for t in texts:
            own = t.split() if t else []
            tokens += own
            sizes.append(len(own))
        ids = list(map(memo.get, tokens))
        before, own_tokens, own_words = len(memo), self.n_tokens, self.n_words
        if None in ids:
            for j, known in enumerate(ids):
                if known is None:
                    token = tokens[j]
                    known = memo.get(token)
                    ids[j] = known if known is not None else memo.setdefault(token, self._learn(token))
            self._flush()
        ids = np.array(ids, dtype="i8")
        text = np.repeat(np.arange(len(texts), dtype="i4"), sizes)
        count, at = self.count[ids], self.at[ids]
        if len(ids) and (count != 1).any():
            ends = np.cumsum(count)
            at = np.repeat(at - ends + count, count) + np.arange(ends[-1])
            text = np.repeat(text, count)
        found = self.words[at]
        if len(memo) > self.limit:  # what came when the memo was full is forgotten again
            while len(memo) > before:
                memo.popitem()
            self.n_tokens, self.n_words, self.full = own_tokens, own_words, self.full + 1
            if self.full % 500 == 0:  # in case the texts have changed
                self._clear()
        return self._typed(found, text, len(texts))

    def _typed(self, found: np.ndarray, text: np.ndarray, texts: int) -> Words:
        h, v, k, end = found["hash"], found["value"], found["kind"], found["ends"].astype(bool)
        alone = k < 0
        if alone.any():  # marks that stand alone end a sentence and are no words
            before = np.flatnonzero(alone) - 1
            end[before[before >= 0]] = True
            h, v, k, end, text = (x[~alone] for x in (h, v, k, end, text))
        k = k.copy()
        n = len(k)
        new = np.ones(n, bool)
        new[1:] = text[1:] != text[:-1]
        after = np.zeros(n, bool)
        after[1:] = (k[:-1] == NUM) & ~new[1:]
        money = k == UNIT + 8
        k[(k == UNIT) & ~after] = WORD
        k[money] = UNIT
        start = new.copy()
        start[1:] |= end[:-1]
        either = (k == NAME) & start
        k[either] = WORD
        return Words(np.where(k == WORD, h, self.placeholders[k]), k, v, either, text, texts)


def _mixed(sums: np.ndarray) -> np.ndarray:
    return (sums ^ sums >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def windows(words: Words, w: int, name: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and first words of all windows of ``w`` words inside one text, in each reading of the words that may be names,
    and whether a window reads any as a name."""
    n = len(words.hash) - w + 1
    if n <= 0:
        return np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, bool)
    sums, literal = np.zeros(n, "u8"), np.zeros(n, "i1")
    is_word = (words.kind == WORD).astype("i1")
    for j in range(w):
        sums = sums * np.uint64(_BASE) + words.hash[j : j + n]
        literal += is_word[j : j + n]
    place = np.flatnonzero(words.text[:n] == words.text[w - 1 :])
    if len(place) < n:
        sums, literal = sums[place], literal[place]
    bare = np.flatnonzero(literal == 0)
    if len(bare):
        own = np.full(len(bare), 7, "u8")
        for j in range(w):
            own = own * np.uint64(_BASE) + words.value[place[bare] + j]
        sums[bare] = own
    plain = len(place)
    if words.either.any():
        change = name - words.hash
        for j in range(w):
            at = np.flatnonzero(words.either[place + j])
            if len(at):
                first = place[at]
                sums = np.concatenate([sums, sums[at] + change[first + j] * np.uint64(pow(_BASE, w - 1 - j, 1 << 64))])
                place, literal = np.concatenate([place, first]), np.concatenate([literal, literal[at] - 1])
        stay = literal > 0
        stay[:plain] = True
        sums, place = sums[stay], place[stay]
    return _mixed(sums), place, np.arange(len(place)) >= plain


def _literal_words(text: str):
    """Lower-case words as ``Templates`` may read them in this text."""
    for token in text.split():
        a, b = 0, len(token)
        while a < b and not token[a].isalnum():
            a += 1
        while b > a and not token[b - 1].isalnum():
            b -= 1
        yield token[a:b].lower()


class TemplateIndex:
    """The hash table of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], window: int = 5, coverage: float = 0.6, min_words: int = 10, passage_words: int = 50, all_keys: bool = False):
        templates = Templates()
        self.vocabulary = frozenset(word for _, text in items for word in _literal_words(text))
        self.window, self.coverage, self.min_words, self.passage_words = window, coverage, min_words, passage_words
        self.name = templates.placeholders[NAME]
        self.items: list[tuple[int, int, Words, tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        for item_id, text in items:
            words = templates.of([text])
            if len(words.hash):
                w = min(window, len(words.hash))
                own = windows(words, w, self.name)
                order = np.argsort(own[0], kind="stable")
                self.items.append((item_id, w, words, tuple(x[order] for x in own)))
        self.tables = []
        for w in sorted({x[1] for x in self.items}):
            of = [i for i, x in enumerate(self.items) if x[1] == w]
            keys = np.concatenate([self.items[i][3][0] for i in of])
            item = np.repeat(np.array(of, "i4"), [len(self.items[i][3][0]) for i in of])
            place = np.concatenate([self.items[i][3][1] for i in of])
            _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
            keep = np.ones(len(keys), bool) if all_keys else self._needed(times[at], item, place, w)
            keys, item, place = keys[keep], item[keep], place[keep]
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[keys >> np.uint64(42)] = True
            self.tables.append((w, keys[order], item[order], place[order].astype("i4"), bits))

    def need(self, n: int) -> float:
        """How many of an item's ``n`` words a copy covers at least."""
        return min(max(min(n, self.min_words), self.coverage * n), self.passage_words)

    def _needed(self, times: np.ndarray, item: np.ndarray, place: np.ndarray, w: int) -> np.ndarray:
        """Keys without those, the most frequent first, that together cover less than a copy must."""
        keep = np.ones(len(item), bool)
        starts = np.flatnonzero(np.diff(item, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(item)], strict=True):
            need, covered = self.need(len(self.items[item[a]][2].hash)), set()
            for k in a + np.lexsort((place[a:b], -times[a:b])):
                more = covered.union(range(place[k], place[k] + w))
                if len(more) >= need:
                    break
                covered, keep[k] = more, False
        return keep

    def match(self, words: Words) -> list[list[tuple]]:
        """For each text: (item id, coverage, first word, last word, slots) of each item that the text contains."""
        out: list[list[tuple]] = [[] for _ in range(len(words.first) - 1)]
        texts, items, offsets = [], [], []
        for w, keys, item, place, bits in self.tables:
            own, at, _ = windows(words, w, self.name)
            maybe = np.flatnonzero(bits[own >> np.uint64(42)])
            own, at = own[maybe], at[maybe]
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            n = high - low
            k = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = np.repeat(at, n)
            texts.append(words.text[at])
            items.append(item[k])
            offsets.append(at - place[k])
        if not texts or not sum(map(len, texts)):
            return out
        text, item, offset = (np.concatenate(x) for x in (texts, items, offsets))
        order = np.lexsort((offset, item, text))
        text, item, offset = text[order], item[order], offset[order]
        size = np.array([len(x[2].hash) for x in self.items])[item]
        around = size // 2 + self.window
        # hits of one text and item whose surroundings overlap are one part of the text
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (offset[1:] - offset[:-1] > size[1:] + 2 * around[1:])
        best: dict[tuple[int, int], tuple] = {}
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:] - 1, len(text) - 1], strict=True):
            t, i = int(text[a]), int(item[a])
            first, last = words.first[t], words.first[t + 1]
            low, high = max(first, offset[a] - around[a]), min(last, offset[b] + size[b] + around[b])
            found = self._verify(i, words.part(int(low), int(high)), int(low - first))
            if found and ((t, i) not in best or found[1] > best[t, i][1]):
                best[t, i] = found
        for (t, _), found in sorted(best.items()):
            out[t].append(found)
        return out

    def _verify(self, i: int, part: Words, shift: int) -> tuple | None:
        item_id, w, words, (keys, places, named) = self.items[i]
        size = len(words.hash)
        own, at, other = windows(part, w, self.name)
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        n = high - low
        k = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        at, other, p = np.repeat(at, n), np.repeat(other, n) | named[k], places[k]
        offset = at - p
        order = np.lexsort((other, p, offset))
        offset, p, other = offset[order], p[order], other[order]
        lines = np.flatnonzero(np.diff(offset, prepend=offset[:1] - 1))
        if not len(lines):
            return None
        step = np.minimum(np.diff(p, append=0), w)
        ends = np.append(lines[1:], len(p))
        step[ends - 1] = w
        covered = np.add.reduceat(step, lines)
        o = offset[lines]
        total = np.concatenate([[0], np.cumsum(covered)])
        reach = size // 2 + self.window
        near = total[np.searchsorted(o, o + reach, "right")] - total[np.searchsorted(o, o - reach, "left")]
        need = self.need(size)
        ranked = np.lexsort((-o, -covered))
        for use_named in (True, False) if other.any() else (False,):
            for f in ranked:
                if near[f] < need:
                    continue
                chain = Chain(words, part, use_named)
                if not chain.add(int(o[f]), p[lines[f] : ends[f]], other[lines[f] : ends[f]], w):
                    continue
                for g in ranked:
                    if len(chain.held) == size:
                        break
                    if g != f and abs(o[g] - o[f]) <= reach:
                        chain.add(int(o[g]), p[lines[g] : ends[g]], other[lines[g] : ends[g]], w)
                if len(chain.held) >= need:
                    ends_at = chain.held.values()
                    return item_id, len(chain.held) / size, int(min(ends_at)) + shift, int(max(ends_at)) + 1 + shift, chain.slots()
        return None


class Chain:
    """Places of an item and of a part of a document that go together, in the same order in both, with values that map
    to each other one to one."""

    def __init__(self, item: Words, part: Words, use_named: bool):
        self.item, self.part, self.use_named = item, part, use_named
        self.held: dict[int, int] = {}
        self.sorted: list[int] = []
        self.forth: dict[tuple[int, int], int] = {}
        self.back: dict[tuple[int, int], int] = {}

    def add(self, offset: int, first: np.ndarray, other: np.ndarray, w: int) -> bool:
        """Add the windows of one line; nothing is added and False is returned where values contradict.

        A line whose own pairs contradict each other is no part of a copy, even where its free places do not.  A window
        that reads the beginning of a sentence as a name is left out where only that name contradicts.
        """
        plain = sorted({q for p in first[~other].tolist() for q in range(p, p + w)})
        if self._pairs(plain, offset, {}, {})[0] or self._take(plain, offset):
            return False
        if self.use_named:
            for p in first[other].tolist():
                if self._take(range(p, p + w), offset) == 2:
                    return False
        return True

    def _pairs(self, places, offset: int, forth: dict, back: dict) -> tuple[int, dict, dict]:
        """0 and the new pairs; 1: the name at the beginning of a sentence contradicts; 2: another value does."""
        new_forth, new_back = {}, {}
        for p in places:
            kind, a, b = int(self.item.kind[p]), int(self.item.value[p]), int(self.part.value[p + offset])
            if kind or a != b:
                a, b = (kind or NAME, a), (kind or NAME, b)
                if forth.get(a, b) != b or back.get(b, a) != a or new_forth.setdefault(a, b) != b or new_back.setdefault(b, a) != a:
                    return 2 if kind and self.part.kind[p + offset] else 1, {}, {}
        return 0, new_forth, new_back

    def _free(self, place: int, there: int) -> bool:
        k = bisect_left(self.sorted, place)
        return (k == 0 or self.held[self.sorted[k - 1]] < there) and (k == len(self.sorted) or self.held[self.sorted[k]] > there)

    def _take(self, places, offset: int) -> int:
        """Hold the places that are free and in order; what ``_pairs`` says."""
        free = [p for p in places if p not in self.held and self._free(p, p + offset)]
        wrong, forth, back = self._pairs(free, offset, self.forth, self.back)
        if not wrong:
            self.forth.update(forth)
            self.back.update(back)
            self.held.update((p, p + offset) for p in free)
            self.sorted = sorted(self.held)
        return wrong

    def slots(self) -> int:
        return int(sum(bool(self.item.kind[p]) or self.item.value[p] != self.part.value[q] for p, q in self.held.items()))


_MATCHES = "array<struct<item_id long, coverage double, first_word long, last_word long, slots long>>"
FIELDS = f"contaminated boolean, n_items long, item_ids array<long>, coverage double, slots long, matches {_MATCHES}"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 5, coverage: float = 0.6, min_words: int = 10, passage_words: int = 50, block_windows: int = 2_000_000) -> DataFrame:
    """Columns ``row`` (the document's own) and ``FIELDS``, one row per input row.

    A text is contaminated by an item when windows in the same order, offset by half the item's length at most, cover
    ``coverage`` of its template words and ``min_words`` of them (all, if it has fewer), or ``passage_words`` words of
    a long item, with consistent slots.  Items shorter than ``window`` words are one window.  Null or empty texts and
    items match nothing; items with a null id are held against the documents too and reported as null; repeated rows
    are judged each, alike; empty tables give empty results; a document's columns are in ``row``, whatever their names.

    The benchmark reaches the driver block by block, never as a whole, and a block is what is broadcast.  One block is
    one pass over the documents.  Of several, each pass reads texts only and writes what it found under the text's
    hash (128 bits); the documents are joined with that at the end.
    """
    spark = docs.sparkSession
    ship(spark)
    templates, held, block, passes = Templates(), 0, [], []
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).orderBy("item_id", "text")

    def index_of(block):
        return spark.sparkContext.broadcast(TemplateIndex(block, window, coverage, min_words, passage_words))

    for item in items.toLocalIterator():
        n = len(templates.of([item["text"]]).hash)
        if held and held + n > block_windows:
            passes.append(_found(docs, index_of(block)))
            block, held = [], 0
        block.append((item["item_id"], item["text"]))
        held += n
    shared = index_of(block)

    def make():
        index = shared.value
        own = Templates(index.vocabulary)
        return lambda _, texts: zip(*(_fields(m) for m in index.match(own.of(texts))), strict=True)

    if not passes:
        return with_decisions(docs, "doc_id", "text", make, FIELDS)
    passes.append(_found(docs, shared))
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    found = materialise(found.groupBy("key").agg(F.flatten(F.collect_list("matches")).alias("matches")), "decontaminate")
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), _key(docs["text"]).alias("key"))
    joined = keyed.join(found.hint("merge"), "key", "left").select("row", F.coalesce(F.array_sort("matches"), F.array().cast(_MATCHES)).alias("matches"))
    return joined.select(
        "row", (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_items"), F.col("matches.item_id").alias("item_ids"),
        F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("coverage"), F.aggregate("matches", F.lit(0).cast("long"), lambda a, m: a + m["slots"]).alias("slots"), "matches",
    )


def _fields(found: list[tuple]) -> tuple:
    return bool(found), len(found), [m[0] for m in found], max((m[1] for m in found), default=0.0), sum(m[4] for m in found), _structs(found)


def _structs(found: list[tuple]) -> list[dict]:
    return [dict(zip(("item_id", "coverage", "first_word", "last_word", "slots"), m, strict=True)) for m in found]


def _key(text):
    return F.md5(F.coalesce(text, F.lit("")))


def _found(docs: DataFrame, shared) -> DataFrame:
    """Matches of one block by the text's hash, for contaminated texts only."""

    def run(source):
        index = shared.value
        own = Templates(index.vocabulary)
        for batch in batches(source, "text"):
            texts = batch.column("text").to_pylist()
            hits = [(hashlib.md5(t.encode()).hexdigest(), _structs(m)) for t, m in zip(texts, index.match(own.of(texts)), strict=True) if m]
            if hits:
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("slots", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), (pa.string(), kind), strict=True)], ["key", "matches"])

    texts = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"))
    return materialise(texts.mapInArrow(lean(run), f"key string, matches {_MATCHES}").dropDuplicates(["key"]), "decontaminate")
