import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapstore.llm import chat, decontaminate, lm_scoring, toxicity

from .helpers import AWKWARD, frame

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BITS = st.lists(st.sampled_from(["\\", "### Assistant:", "### @a%20b:", "</turn>", "\n", " ", "x", "### ", "User: ", "é", "\n</turn>\n", "</tur", "n>"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "User", ""]), BITS), st.one_of(BITS, st.text(max_size=20))), max_size=4))
def test_grammar_round_trip(turns):
    text = "".join(chat.render_turn(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(text)] == turns


def test_plain_text_is_not_touched():
    assert chat.render_turn("user", "## Title\nx") == ("### User: ## Title\nx\n</turn>\n", 0)
    with pytest.raises(chat.GrammarError):
        list(chat.parse("### User: no end"))


def test_chat_format(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "x"), (2, 0, "assistant", "</turn>\n### User: \\"), (None, 0, "user", "n"), (None, 0, "user", "n"), (3, 0, "assistant", "y" * 50000), (3, 1, "assistant", "z")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, part string")
    formatted = chat.format_conversations(turns.unionByName(chat.probe_conversation(spark).withColumn("part", F.lit("e"))), part_chars=1000)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    says = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", says), (-7, 1, "assistant", says)]
    assert set(got) == {1, 2, 3, None, -7}
    for conv, r in got.items():
        own = [(role or "", text or "") for c, _, role, text in rows if c == conv]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(turns.limit(0))).collect() == []


def test_long_conversation_is_written_by_several_tasks(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"</turn> {c} {t} é") for c, n in ((1, 3), (5, 900), (9, 2), (None, 5)) for t in range(n)]
    rows += [(5, None, "user", "a turn without a number"), (5, 7, "assistant", "a second turn 7")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        formatted = chat.format_conversations(turns, part_chars=500)
        parts = formatted.collect()
        assert len({r["part"] >> 32 for r in parts if r["conv_id"] == 5}) > 1
        assert all(not r["whole"] for r in parts if r["conv_id"] == 5)
        got = [chat.read_back(f).orderBy("conv_id").collect() for f in (formatted, spark.createDataFrame(parts[::-1], formatted.schema).repartition(5))]
    finally:
        spark.conf.set(name, before)
    assert got[0] == got[1] and [r["conv_id"] for r in got[0]] == [None, 1, 5, 9]
    for r in got[0]:
        own = sorted((t is not None, t or 0, role, text) for c, t, role, text in rows if c == r["conv_id"])
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for *_, role, text in own).encode()).hexdigest()
        loss = "".join(text for *_, role, text in own if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["escaped_turns"]) == (len(own), len(loss), sum("</turn>" in text for *_, text in own))
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(p["formatted"]) for p in parts if p["conv_id"] == r["conv_id"])


def test_lattice_equals_enumeration():
    pieces = lm_scoring.pieces_of(PIECES)
    log_p = {s: p for s, p in zip(pieces.strings, pieces.prior, strict=True)}

    def total(s):
        if not s:
            return 1.0
        out = sum(math.exp(log_p[s[:n]]) * total(s[n:]) for n in range(1, len(s) + 1) if s[:n] in log_p)
        if s[0] not in log_p:
            out += math.exp(len(s[0].encode()) * (log_p["<byte>"] - math.log(256))) * total(s[1:])
        return out

    words = ["the", "then", "theand", "x", "é", "ça", "a\U0001f600b", "ⴰ", "naïve"]
    got, expected = lm_scoring.lattice(pieces, pieces.prior, words, np.ones(len(words)))
    assert np.allclose(got, [math.log(total("▁" + w)) for w in words])
    assert expected.min() >= 0 and expected.sum() >= len(words)
    one = lm_scoring.lattice(pieces, pieces.prior, ["the"], np.ones(1))[1]
    assert math.isclose(sum(len(pieces.strings[k]) * x for k, x in enumerate(one) if k), len("▁the"), rel_tol=1e-9)


def test_long_words_score(spark):
    pieces = lm_scoring.pieces_of(PIECES)
    assert np.isfinite(lm_scoring.lattice(pieces, pieces.prior, ["ab" * 20000, "the"])[0]).all()


def test_lm_scores(spark):
    rng = random.Random(9)
    rows = AWKWARD + [(100 + k, " ".join(rng.choice(["the", "of", "Then", "oren", "nd", f"th{k}"]) for _ in range(40))) for k in range(60)]
    docs = frame(spark, rows).repartition(3)
    got = lm_scoring.score_documents(docs, PIECES, train=F.crc32(docs["doc_id"].cast("string")) % 5 != 1, block_bytes=5000).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = collections.Counter()
    for i, t in rows:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        expected[i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 4)] += 1
    assert collections.Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 4)) for r in got) == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    refit = lm_scoring.score_documents(docs, PIECES, train=F.crc32(docs["doc_id"].cast("string")) % 5 != 1, iterations=2, block_bytes=5000).collect()
    of_words = lambda rows: sum(r["score"] for r in rows if r["doc_id"] and r["doc_id"] >= 100)
    assert of_words(refit) > of_words(got)
    assert lm_scoring.score_documents(frame(spark, []), PIECES, train=F.lit(True)).collect() == []


def test_document_scores_equal_brute_force(spark):
    """The marginal of whole documents: a sum over all paths of each word, and the arcs of words seen in training."""
    pieces = lm_scoring.pieces_of(PIECES)
    log_p = dict(zip(pieces.strings, pieces.prior, strict=True))

    def spelled(s):
        if not s:
            return 1.0
        out = sum(math.exp(log_p[s[:n]]) * spelled(s[n:]) for n in range(1, len(s) + 1) if s[:n] in log_p)
        return out if s[0] in log_p else out + math.exp(len(s[0].encode()) * (log_p["<byte>"] - math.log(256))) * spelled(s[1:])

    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["the", "Then", "oren", "né", "x\U0001f600", f"t{k}"]) for _ in range(rng.randint(0, 9)))) for k in range(40)] + [(None, None), (7, "the then")]
    learn = lambda i: i is None or i % 3 > 0
    tokens = lambda t: (t or "").lower().split()
    counts = collections.Counter(w for i, t in rows if learn(i) for w in tokens(t))
    ends = sum(learn(i) for i, _ in rows)
    n, v, d = sum(counts.values()) + ends, len(counts) + 1, 0.6
    word = {w: max(counts[w] - d, 0) / n + d * v / n * spelled("▁" + w) for _, t in rows for w in tokens(t)}
    docs = frame(spark, rows).repartition(3)
    got = lm_scoring.score_documents(docs, PIECES, train=docs["doc_id"] % 3 > 0).select("doc_id", "n_tokens", "score").collect()
    expected = [(i, len(tokens(t)) + 1, sum(math.log10(word[w]) for w in tokens(t)) + math.log10((ends - d) / n)) for i, t in rows]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(expected, key=order), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9)


def test_lm_is_a_distribution():
    """The probability of all words of up to three letters is at most one."""
    pieces = lm_scoring.pieces_of(PIECES)
    letters = "abcdefghij"
    words = [a + b + c for a in letters for b in ["", *letters] for c in (["", *letters] if b else [""])]
    assert np.exp(lm_scoring.lattice(pieces, pieces.prior, words)[0]).sum() < 1


def plain_nearest(query, vectors, k, without=-1):
    found = sorted((-round(sum(w * v.get(t, 0) for t, w in query.items()), 12), e) for e, v in enumerate(vectors) if e != without)
    return [(-s, e) for s, e in found if s < 0][:k]


def close(a, b):
    return [e for _, e in a] == [e for _, e in b] and np.allclose([s for s, _ in a], [s for s, _ in b], atol=1e-11)


def test_block_max_index_is_exact():
    rng = random.Random(3)
    arrays = lambda v: (np.array(sorted(v), dtype="i8"), np.array([v[t] for t in sorted(v)]))
    for n in (0, 1, 5, 300):
        vectors = []
        for _ in range(n):
            v = {t: rng.random() for t in rng.sample(range(40), rng.randint(0, 6))}
            norm = math.sqrt(sum(w * w for w in v.values())) or 1
            vectors.append({t: w / norm for t, w in v.items()})
        index = toxicity.BlockMaxIndex([arrays(v) for v in vectors], 40, block=16)
        for e, q in enumerate(vectors[:100]):
            for k in (1, 7, 400):
                if q:
                    assert close(index.nearest(*arrays(q), k), plain_nearest(q, vectors, k))
                    assert close(index.nearest(*arrays(q), k, without=e), plain_nearest(q, vectors, k, e))


def plain_terms(text):
    words = [w for w in (t.lower().strip("".join(c for c in t if not c.isalnum())) for t in (text or "").split()) if w]
    return collections.Counter([*words, *(w[k : k + n] for w in words if len(w) > 24 for n in range(4, 10) for k in range(len(w) - n + 1))])


def plain_cosines(texts, labels):
    """Unit vectors of whole texts by term, and a function that gives any other text's."""
    counts = [plain_terms(t) for t in texts]
    n, m = len(texts), sum(labels)
    have, have_with = collections.Counter(), collections.Counter()
    for c, y in zip(counts, labels, strict=True):
        have.update(c.keys())
        have_with.update(c.keys() if y else ())

    def weight(t):
        a, b = have_with[t], have[t] - have_with[t]
        return (math.log((n + 1) / (have[t] + 1)) + 1) * abs(math.log((a + 0.5) / (m - a + 0.5) / ((b + 0.5) / (n - m - b + 0.5))))

    def vector(c):
        v = {t: (1 + math.log(k)) * weight(t) for t, k in c.items() if t in have}
        norm = math.sqrt(sum(w * w for w in v.values())) or 1
        return {t: w / norm for t, w in v.items()}

    return [vector(c) for c in counts], lambda text: vector(plain_terms(text))


def examples_of(texts, labels):
    counter = toxicity.TermCounter()
    return [(k, y, *counter.of(t)) for k, (t, y) in enumerate(zip(texts, labels, strict=True))]


def test_cosines_equal_brute_force():
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)] + ["Nasty,", "scum!", "#", "x" * 30 + "scum" + "y" * 20, "é.", "中文"]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))
    texts, labels = [make() for _ in range(200)], [rng.randrange(2) for _ in range(200)]
    known = frozenset(w for t in texts for w in map(toxicity.word_of, t.split()) if 0 < len(w) <= 24)
    vectors, vector_of = plain_cosines(texts, labels)
    for words_known in (None, known):
        model = toxicity.ToxicityModel(examples_of(texts, labels), 0.4, 7, block=16, words=words_known)
        for text in [*texts[:20], *(make() for _ in range(30)), "", None, "unknown words. Only"]:
            got = [(s, model.ids[e]) for s, e in model.nearest(text)]
            plain = plain_nearest(vector_of(text), vectors, 7)
            assert np.allclose([s for s, _ in got], [s for s, _ in plain], atol=1e-9)
            assert {e for s, e in got if s > plain[-1][0] + 1e-9} == {e for s, e in plain if s > plain[-1][0] + 1e-9}
        left = model.nearest(texts[3], without=3)
        assert 3 not in [model.ids[e] for _, e in left]


def toxic_rows(n=600):
    rng = random.Random(8)
    common = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(n):
        bad = k % 7 == 0
        words = [rng.choice(common) for _ in range(60)]
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["nastyone", "nastytwo", "Nastythree,"])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    docs = frame(spark, rows + [(None, None), (9001, None), (9002, ""), (9003, "nastyone " * 20000), (0, rows[0][1])])
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, marks.where(toxicity.may_learn(F.col("doc_id"))), sample_rows=300)
    assert len(model.labels) <= 300
    got = toxicity.score_toxicity(docs, model).select("row.doc_id", "score", "predicted", "evidence").collect()
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    for k, _, bad in labels:
        if zlib.crc32(str(k).encode()) % 3 == 1:
            assert by[k]["predicted"] == bad
    assert by[9003]["predicted"] == 1 and by[9002]["predicted"] == 0 and by[9001]["score"] == by[9002]["score"]
    assert by[7]["evidence"] and all(zlib.crc32(str(e["doc_id"]).encode()) % 3 != 1 for r in got for e in r["evidence"])


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(frame(spark, []), none)
    got = toxicity.score_toxicity(frame(spark, AWKWARD), model).collect()
    assert len(got) == len(AWKWARD) and all(r["predicted"] == 0 for r in got)


QUESTIONS = [
    (1, "Maria has 12 apples and gives 5 apples to her friend near the old stone bridge in the valley."),
    (2, "A train leaves the station at 60 km/h and travels 240 km before it stops at the next quiet village."),
    (3, "tiny item"), (4, None), (None, "an item without an id that still has enough words to be found in some text here"),
]


def contaminated(spark, texts, **options):
    docs = frame(spark, list(enumerate(texts)))
    found = decontaminate.decontaminate(docs, spark.createDataFrame(QUESTIONS, "item_id long, text string"), **options)
    return {r["doc_id"]: r for r in found.select("row.doc_id", "contaminated", "n_items", "item_ids", "slots", "matches").collect()}


@pytest.mark.parametrize("block", [1_000_000, 10])
def test_decontamination(spark, block):
    one, two = QUESTIONS[0][1], QUESTIONS[1][1]
    texts = [
        f"Intro words. {one} More words.", one.replace("12", "31").replace("5", "9"), two.replace("60", "75").replace("240", "300").upper().replace("KM/H", "km/h").replace("KM", "km"),
        two.replace("60", "75").replace("240", "75"), "clean text about apples and a train near the village", None, "", two[:30], "tiny item", one.replace("old stone", "ancient"), QUESTIONS[4][1], "pad " * 20000 + two,
    ]
    got = contaminated(spark, texts, block_windows=block)
    assert [got[k]["item_ids"] for k in range(len(texts))] == [[1], [1], [2], [], [], [], [], [], [3], [1], [None], [2]]
    assert got[1]["slots"] >= 2 and got[11]["matches"][0]["first_word"] in (20000, 20001)


def test_decontamination_against_nothing(spark):
    docs = frame(spark, AWKWARD)
    found = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert found.where("contaminated").count() == 0 and found.count() == len(AWKWARD)
    assert decontaminate.decontaminate(docs.limit(0), spark.createDataFrame(QUESTIONS, "item_id long, text string")).collect() == []


def test_template_words():
    words = decontaminate.Templates().of([None, "Then 5 km to Paris. The cost was $30 or 3kg, said Bob! 10% of it - x", ""])
    assert words.first.tolist() == [0, 0, 20, 20]
    assert words.kind.tolist() == [0, 1, 2, 0, 3, 0, 0, 0, 2, 1, 0, 1, 2, 0, 3, 1, 2, 0, 0, 0]
    assert [words.value[k] == decontaminate._hash(v) for k, v in ((1, "5"), (4, "paris"), (9, "30"))] == [True] * 3
    assert np.flatnonzero(words.either).tolist() == [0, 5]


def test_forgotten_tokens_read_the_same():
    rng = random.Random(2)
    bounded, free = decontaminate.Templates(limit=30), decontaminate.Templates()
    for _ in range(40):
        texts = [" ".join(rng.choice(["Tom", "x.", "5kg", "$3", "-", "?!", "w%d" % rng.randrange(50), "Ann's", "A. B"]) for _ in range(rng.randint(0, 20))) for _ in range(4)]
        a, b = bounded.of(texts), free.of(texts)
        assert all(getattr(a, k).tolist() == getattr(b, k).tolist() for k in a.__slots__)
    assert len(bounded.memo) <= 30


REPEATS = "A shop sells 3 boxes of pens for 4 dollars and 5 boxes of pens for 6 dollars each day. How much does it earn?"


def found_in(item, text, **options):
    index = decontaminate.TemplateIndex([(1, item)], **options)
    return index.match(decontaminate.Templates(index.vocabulary).of([text]))[0]


@pytest.mark.parametrize("before", ["gives 12 apples to her dog. ", "and gives 12 apples to her. ", "He has 5 apples and gives pears. ", "12 apples and gives 5 apples "])
def test_a_stray_window_does_not_hide_a_copy(before):
    [m] = found_in(QUESTIONS[0][1], before + QUESTIONS[0][1])
    assert m[1] == 1


def test_shuffled_blocks_are_no_copy():
    w = QUESTIONS[0][1].split()
    assert not found_in(QUESTIONS[0][1], " ".join([*w[12:18], "one", "two", *w[6:12], "three", *w[:6]]))
    [m] = found_in(QUESTIONS[0][1], " ".join([*w[:6], "one", "two", *w[6:12], "three", *w[12:18]]))
    assert m[1] == 18 / 19


def test_an_excerpt_of_a_long_item():
    item = " ".join(f"word{k}" for k in range(400))
    assert found_in(item, "x " + " ".join(f"word{k}" for k in range(100, 160)))
    assert not found_in(item, " ".join(f"word{k}" for k in range(100, 140)))


def test_tables_of_numbers_meet_no_template():
    items = [(k, f"item {k} adds 1 2 3 4 5 6 7 8 9 10 and asks who of you {k} knows the sum") for k in range(200)]
    index = decontaminate.TemplateIndex(items)
    templates = decontaminate.Templates(index.vocabulary)
    assert index.match(templates.of([" ".join(str(k) for k in range(20, 5000))])) == [[]]
    assert [m[0] for m in index.match(templates.of([items[7][1]]))[0]] == [7]


def plain_keys(words, w, name):
    """Every (key, place) of a text, each reading spelled out."""
    out = set()
    for at in range(len(words.hash) - w + 1):
        for mask in itertools.product(*[(False, True) if words.either[at + j] else (False,) for j in range(w)]):
            if any(words.kind[at + j] == 0 and not mask[j] for j in range(w)):
                out.add((tuple(int(name) if mask[j] else int(words.hash[at + j]) for j in range(w)), at))
            elif not any(mask):
                out.add((("values", *(int(words.value[at + j]) for j in range(w))), at))
    return out


def plain_hits(index, i, words):
    _, w, item, _ = index.items[i]
    mine = plain_keys(item, w, index.name)
    return {(d, p) for key, d in plain_keys(words, w, index.name) for other, p in mine if key == other}


def test_hits_equal_brute_force():
    rng = random.Random(6)
    alphabet = ["Tom", "Ann", "5", "7", "$3", "2kg", "apples", "and", "gives.", "has", "the", "Who"]
    for _ in range(150):
        items = [(k, " ".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))) for k in range(4)]
        index = decontaminate.TemplateIndex(items, all_keys=True)
        words = decontaminate.Templates(index.vocabulary).of([" ".join(rng.choice(alphabet) for _ in range(40))])
        for i, (_, w, item, (keys, places, _)) in enumerate(index.items):
            own, at, _ = decontaminate.windows(words, w, index.name)
            got = {(int(at[a]), int(places[b])) for a, b in zip(*np.nonzero(own[:, None] == keys[None, :]), strict=True)}
            assert got == plain_hits(index, i, words)


def test_matches_equal_brute_force():
    """Keys that no copy can avoid find what all keys find, batched or alone; planted copies are found, others are not."""
    rng = random.Random(7)
    names, things = ["Tom", "Ann", "Bob", "Eve"], [f"thing{k}" for k in range(30)]
    items = []
    for k in range(40):
        words = [rng.choice([*things, "has", "gives", "to", str(rng.randint(1, 9)), rng.choice(names)]) for _ in range(rng.randint(3, 40))]
        items.append((k, "How many " * (k % 2) + " ".join(words) + " does she have now?"))
    fewer, every = decontaminate.TemplateIndex(items), decontaminate.TemplateIndex(items, all_keys=True)
    assert sum(len(t[1]) for t in fewer.tables) < sum(len(t[1]) for t in every.tables)
    texts, planted = [], []
    for _ in range(120):
        k, item = rng.choice(items)
        values = {v: f"{int(v) + 20}" for v in map(str, range(1, 10))} | dict(zip(names, ["Uma", "Ida", "Leo", "Max"], strict=True))
        kind = rng.choice(["copy", "other values", "cut", "none"])
        body = {"copy": item, "other values": " ".join(values.get(x, x) for x in item.split()), "cut": " ".join(item.split()[: len(item.split()) // 3]), "none": ""}[kind]
        around = [" ".join(rng.choice([*things, "and", "5", "Tom"]) for _ in range(rng.randint(0, 30))) for _ in range(2)]
        texts.append(f"{around[0]}. {body} {around[1]}")
        planted.append(k if kind in ("copy", "other values") else None)
    templates = decontaminate.Templates(every.vocabulary)
    batched = fewer.match(templates.of(texts))
    assert batched == every.match(templates.of(texts)) == [fewer.match(templates.of([t]))[0] for t in texts]
    for k, text, found in zip(planted, texts, batched, strict=True):
        assert k is None or k in [m[0] for m in found]
        for item_id, share, *_ in found:  # no more is covered than hits cover at all
            i = [x[0] for x in fewer.items].index(item_id)
            w = fewer.items[i][1]
            hit = {p + j for _, p in plain_hits(fewer, i, templates.of([text])) for j in range(w)}
            assert round(share * len(fewer.items[i][2].hash)) <= len(hit)


def test_repeats_inside_an_item_do_not_veto_a_copy():
    [m] = found_in(REPEATS, REPEATS)
    assert m[1] == 1 and (m[2], m[3]) == (0, 25)
    other = REPEATS.replace("3", "13").replace("4", "14").replace("5", "15").replace("6", "16")
    assert found_in(REPEATS, f"some words {other} and {REPEATS[:60]}")[0][1] > 0.9
    assert not found_in(REPEATS, REPEATS.replace("5", "3").replace("6", "4"))


PEARS = "Tom has 5 apples. Ann has 7 pears. Tom gives Ann 2 apples. Ann eats 3 pears. How many apples does Tom have now?"


def test_names_that_begin_sentences():
    def changed(**to):
        return " ".join(to.get(x, x) for x in PEARS.split())

    [m] = found_in(PEARS, changed(Tom="Bob", Ann="Eve", **{"5": "15", "7": "17", "2": "12", "3": "13"}))
    assert m[1] == 1 and (m[2], m[3]) == (0, 24)
    assert found_in(PEARS, PEARS)[0][1] == 1
    assert found_in(PEARS, f"we know that {PEARS}")[0][1] == 1
    assert not found_in(PEARS, changed(Tom="Bob", Ann="Bob", **{"5": "1", "7": "1", "2": "1", "3": "1"}))
    reworded = REPEATS.replace("A shop", "One shop").replace("How much", "One asks how much")  # beginnings that contradict cost their windows only
    assert found_in(REPEATS, reworded)


def test_toxicity_learns_from_few_rows_with_the_label(spark):
    rng = random.Random(4)
    rows = [(k, " ".join([f"word{rng.randrange(200)}" for _ in range(40)] + ["scum"] * (k < 6))) for k in range(52)]
    marks = spark.createDataFrame([(k, 1, int(k < 6)) for k, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(frame(spark, rows), marks)
    assert model.score("you scum of word1")[0] > model.score("you word1")[0]
    assert len(model.terms) > 190  # no term is left out


def test_toxicity_samples_a_rare_label_first(spark):
    rows, _ = toxic_rows(400)
    rows = [(k, t if k % 7 else t.replace("nasty", "plain")) for k, t in rows] + [(1000 + k, f"scum word{k} word{k + 1}") for k in range(6)]
    marks = spark.createDataFrame([(k, 1, int(k >= 1000)) for k, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(frame(spark, rows), marks, sample_rows=60)
    assert len(model.labels) == 60 and sum(model.labels) == 6
    assert sum(model.weights[y] for y in model.labels) == pytest.approx(60)
    assert model.weights[0] / model.weights[1] == pytest.approx(400 / 54)


def test_long_runs_are_scored_whole():
    texts = ["nasty words", "plain words", "nasty thing", "plain thing"] * 5
    model = toxicity.ToxicityModel(examples_of(texts, [1, 0] * 10), 0.5, 5)
    run = "x" * 1000 + "nasty" + "y" * 1000
    assert {model.labels[e] for _, e in model.nearest(run)} == {1} and run not in model.counter.memo
    assert not model.nearest("x" * 1000)


def test_evidence_gives_the_score_again():
    model = toxicity.ToxicityModel(examples_of([f"nasty w{e}" for e in range(12)], [int(e % 3 > 0) for e in range(12)]), 0.5, 9)
    model.calibrate(np.linspace(0, 1, 12), model.labels)
    score, evidence = model.score("nasty")
    assert len(evidence) == 9
    vote = model.vote([(s, model.place[d]) for s, d in evidence])
    assert score == pytest.approx(float(np.interp(vote, *model.knots)))


def test_scores_equal_brute_force(spark):
    """The whole operator: sample, leave-one-out votes, isotonic regression, scores."""
    rows, labels = toxic_rows(120)
    y = [b for _, _, b in labels]
    got = toxicity.score_toxicity(frame(spark, rows), toxicity.fit_toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    got = {r["doc_id"]: r["score"] for r in got.select("row.doc_id", "score").collect()}
    vectors, vector_of = plain_cosines([t for _, t in rows], y)
    prior = (sum(y) + 0.5) / (len(y) + 1)
    vote = lambda found: (sum(s * y[e] for s, e in found) + 0.5 * prior) / (sum(s for s, _ in found) + 0.5)
    held = np.array([vote(plain_nearest(v, vectors, 25, e)) for e, v in enumerate(vectors)])
    knots = toxicity.isotonic(held, np.array(y, dtype=float), prior)
    for k, t in rows:
        assert got[k] == pytest.approx(float(np.interp(vote(plain_nearest(vector_of(t), vectors, 25)), *knots)), abs=1e-6)
