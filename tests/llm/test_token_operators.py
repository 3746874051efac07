import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from snapstore.llm import bpe, exact_dedup, packing, token_counts, token_shards

from .helpers import AWKWARD, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(text):
    return bpe.load_tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def weird_texts(n=3000):
    random.seed(3)
    alphabet = list(" \n\t\r 　\x1c\x85​ab1'sé中,.!½²́😀_-:;?") + ["<|endoftext|>", "the", " of"]
    return ["".join(random.choice(alphabet) for _ in range(random.randint(0, 30))) for _ in range(n)]


def test_units_and_counts_equal_the_library():
    memo, counter = bpe.UnitMemo(PATH, limit=50), token_counts.TokenCounter(PATH, limit=50)
    texts = weird_texts()
    expected = [e.ids for e in memo.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for k in range(0, len(texts), 500):  # the memo overflows and is used again
        part = texts[k : k + 500]
        assert [np.frombuffer(b, "<u4").tolist() for b in memo.encode_all(part)] == expected[k : k + 500]
        assert counter.count_all(part) == [len(x) for x in expected[k : k + 500]]
    assert len(memo.memo) <= 2000


def test_proven_strings_are_one_token():
    tokenizer = bpe.load_tokenizer(PATH)
    proven = token_counts.prove_whole_tokens(tokenizer)
    assert " the" in proven and "<|endoftext|>" not in proven
    for s in random.Random(1).sample(sorted(proven), 300):
        assert len(tokenizer.encode(s, add_special_tokens=False).ids) == 1


def test_token_counts(spark):
    rows = token_counts.token_counts(frame(spark, AWKWARD), PATH, limit=1024).collect()
    assert sorted((r[0] or 0, r[1], r[2], r[3]) for r in rows) == sorted((i or 0, len((t or "").encode()), len(library_ids(t)), len(library_ids(t)) > 1024) for i, t in AWKWARD)
    assert token_counts.token_counts(frame(spark, []), PATH).collect() == []


def test_shards_round_trip(spark):
    target = token_shards.write_token_shards(frame(spark, AWKWARD), PATH, shard_bytes=20_000)
    rows = token_shards.shard_digests(spark, target).collect()
    got = sorted(rows, key=lambda r: r["start"])
    at = 0
    order = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    for r, (_, text) in zip(got, order, strict=True):
        ids = np.array([*library_ids(text), 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    readers = [token_shards.ShardReader(target, r["file"]) for r in spark.read.parquet(target + "/manifest").orderBy("start").collect()]
    assert next(readers[0].scan())[0] is None
    assert [r.get(8).tolist()[-1] for r in readers if 8 in r.index["doc_id"]] == [0]
    with pytest.raises(KeyError):
        readers[-1].get(99999)


def test_shards_of_nothing(spark):
    target = token_shards.write_token_shards(frame(spark, []), PATH)
    assert token_shards.read_token_shards(spark, target).collect() == []


def test_shard_refuses_another_dictionary(spark):
    target = token_shards.write_token_shards(frame(spark, AWKWARD[:3]), PATH)
    store, path = token_shards.open_store(target)
    with store.open_output_stream(f"{path}/dictionary") as f:
        f.write(b"other")
    with pytest.raises(Exception, match="dictionary"):
        token_shards.read_token_shards(spark, target).collect()


def test_first_fit_decreasing_equals_a_plain_search():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        free, plain = [], []
        for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            b = next((b for b, f in enumerate(free) if f >= lengths[k]), len(free))
            if b == len(free):
                free.append(100)
                plain.append([])
            free[b] -= lengths[k]
            plain[b].append(k)
        assert packing.first_fit_decreasing(lengths, 100) == plain


@pytest.mark.parametrize("fill", [True, False])
def test_pack_group_covers_each_id_once(fill):
    rng = random.Random(6)
    for _ in range(100):
        lengths = [rng.randint(1, 400) for _ in range(rng.randint(1, 50))]
        bins = packing.pack_group(lengths, 128, fill)
        assert all(0 < sum(p[2] for p in b) <= 128 for b in bins)
        for d, n in enumerate(lengths):
            pieces = sorted((s, m) for b in bins for x, s, m in b if x == d)
            assert sum(m for _, m in pieces) == n and [s for s, _ in pieces] == [sum(m for _, m in pieces[:k]) for k in range(len(pieces))]
        if fill:
            assert len(bins) == -(-sum(lengths) // 128)


def test_packing(spark):
    rows = packing.pack_documents(frame(spark, AWKWARD), PATH, group_docs=3).collect()
    assert packing.pack_documents(frame(spark, []), PATH).collect() == []
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], len(r["ids"]) // 4))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], packing.ids_of(bytes(r["ids"])), r["doc_tokens"]))
    for pieces in by_sequence.values():
        assert sum(n for _, n in pieces) <= 1024
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
    for doc_id in (1, 7, 8, 9):
        pieces = sorted(by_doc[doc_id])
        assert [i for _, ids, _ in pieces for i in ids] == [*library_ids(dict((i, t) for i, t in AWKWARD if i == doc_id)[doc_id]), 0]


def brute_groups(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), []).append(i)
    out = []
    for ids in groups.values():
        real = [i for i in ids if i is not None]
        owner = (max if keep == "largest" else min)(real) if real else None
        out += [(i, owner, len(ids), i == owner) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("memory", [1, 48 << 20])
@pytest.mark.parametrize("weak", [True, False])
def test_exact_dedup(spark, keep, memory, weak):
    from pyspark.sql import functions as F

    rows = AWKWARD + [(20 + k, f"shared prefix {'x' * (k % 4)}{k % 3}") for k in range(40)] + [(100 + k, "hot") for k in range(60)]
    docs = frame(spark, rows).repartition(3)
    got = exact_dedup.exact_dedup(docs, keep, memory=memory, content_hash=F.lit(0) if weak else None).collect()
    assert sorted([(r[0], r[1], r[2], r[3]) for r in got], key=str) == brute_groups(rows, keep)
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []


def test_trie_holds_every_string_once():
    rng, tries, seen = random.Random(2), exact_dedup.Tries(), {}
    for k in range(3000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
        node = tries.terminal(0, key)
        if node.rows is None:
            tries.wait(node, k)
        assert node.rows[0] == seen.setdefault(key, k)
    assert {text: node.rows[0] for _, text, node in tries.drain()} == seen
    assert not tries.roots and not tries.held


def test_trie_stores_shared_beginnings_once():
    tries = exact_dedup.Tries()
    for k in range(1000):
        tries.wait(tries.terminal(0, b"p" * 2000 + b"%d" % k), k)
    assert tries.held < 2000 + 1200 * (exact_dedup.NODE_BYTES + exact_dedup.KEY_BYTES + 3)
    assert list(tries.roots[0].children) == [ord("p")] and len(tries.roots[0].children[ord("p")].label) == 2000


def test_heaviest_subtree_leaves_and_others_stay():
    tries = exact_dedup.Tries()
    texts = [b"a" + b"%03d" % k * 40 for k in range(200)] + [b"b%d" % k for k in range(5)]
    for k, text in enumerate(texts):
        tries.wait(tries.terminal(0, text), k)
    before = tries.held
    gone = {text for _, text, _ in tries.spill(before // 2)}
    assert gone and all(text[:1] == b"a" for text in gone) and tries.held <= before // 2
    left = {text for _, text, _ in tries.drain()}
    assert gone | left == set(texts) and not gone & left


def test_spill_keeps_the_path_of_the_last_text():
    tries, texts = exact_dedup.Tries(), sorted(b"%05d" % (k * 7919 % 100000) * 3 for k in range(2000))
    owners = {}
    for k, text in enumerate(texts):
        tries.wait(tries.terminal(3, text), k)
        if tries.held > 50_000:
            out = [t for _, t, _ in tries.spill(25_000, (3, text))]
            assert text not in out
            owners |= dict.fromkeys(out, k)
    owners |= dict.fromkeys((t for _, t, _ in tries.drain()), -1)
    assert sorted(owners) == texts
