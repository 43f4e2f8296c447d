import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from postloom.llm.chat import collapse_snapshots
from postloom.llm.mixing import mix
from postloom.llm.packing import Packer, digests, pack
from postloom.llm.quality_model import score_quality, train
from postloom.llm.quality_rules import quality_rules
from postloom.llm.sharding import Tree, even_tree, shard, with_shard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_packing(df, tokenizer, window):
    out, docs = pack(df, window=window).collect(), pairs(df)
    want = Counter((i, bytes(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))) for i, t in docs)
    assert sum(r.length for r in out) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    if len({i for i, _ in docs}) == len(docs):
        own = defaultdict(list)
        for r in out:
            own[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        for (i, ids), _ in want.items():
            pieces = sorted(own[i])
            assert b"".join(p for _, p, _ in pieces) == ids and {n for *_, n in pieces} == {len(ids) // 4}
            assert [s for s, *_ in pieces] == [sum(len(p) // 4 for _, p, _ in pieces[:k]) for k in range(len(pieces))]
    filled = defaultdict(list)
    for r in out:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= window
    short = sum(sum(n for _, n in p) < window for p in filled.values())
    assert short <= df.rdd.getNumPartitions()
    crc = Counter((r.doc_id, r.start, r.ids_crc32) for r in digests(pack(df, window=window)).collect())
    assert crc == Counter((r.doc_id, r.start, zlib.crc32(bytes(r.ids))) for r in out)


def test_packing(edge, corpus, empty, tokenizer):
    check_packing(corpus, tokenizer, 4096)
    check_packing(corpus, tokenizer, 100)
    check_packing(edge, tokenizer, 64)
    assert pack(empty).count() == 0


def test_special_tokens_in_text(make, tokenizer):
    check_packing(make([(1, "a <|endoftext|>b <|startoftext|> <|x| c"), (2, "<|startoftext|>"), (3, "it's WE'LL <|"), (4, "é ́x  y　z")]), tokenizer, 16)


def test_level_leaves_the_smallest_sum_of_squares():
    rng = np.random.default_rng(3)
    for window, levels in ((20, 20), (4096, 8), (1000, 30), (7, 50)):
        packer, full = Packer(window, levels), []
        for k in range(400):
            size = int(rng.integers(1, window))
            steps, counts, costs = packer.steps(size), packer.counts.copy(), {}
            for h in range(packer.levels - steps + 1):
                if h == 0 or counts[h]:
                    c = counts.copy()
                    c[h] -= h > 0
                    if h + steps < packer.levels:
                        c[h + steps] += 1
                    costs[h] = int((c[1 : packer.levels] ** 2).sum())
            assert costs[packer.level(steps)] == min(costs.values())
            full += packer.add(k, 0, size)
            assert [len(x) for x in packer.open] == packer.counts[: packer.levels].tolist() and len(packer.closing) <= 1
            assert all(packer.steps(fill) == h and fill == sum(n for *_, n in pieces) for h, held in enumerate(packer.open) for fill, pieces in held)
        assert all(sum(n for *_, n in pieces) == window for pieces in full)


def test_most_sequences_come_from_levels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet").repartitionByRange(32, "doc_id")
    kinds = Counter(r.made_by for r in pack(docs).select("sequence_id", "made_by").distinct().collect())
    assert kinds["levels"] >= 9 * kinds["rest"] and kinds["document"] > 0


def test_encoder_memories_are_bounded_and_dropped(tokenizer):
    import public_tokenizers
    import pyarrow as pa

    from postloom.llm.packing import Encoder, Memory

    memory, asked = Memory(words=100, ids=10_000), []

    def learn(new):
        asked.extend(new)
        return np.repeat(keys[new], (keys[new] % np.uint64(4)).astype(np.int64)).astype(np.uint32), (keys[new] % np.uint64(4)).astype(np.int64)

    for k in range(300):
        keys = np.unique(np.array([1, 2, 7, *range(k, k + 9)], np.uint64))
        at, n = memory.look_up(keys, learn)
        for key, a, m in zip(keys.tolist(), at.tolist(), n.tolist(), strict=True):
            assert m == key % 4 and memory.young.ids[a : a + m].tolist() == [key] * m
        assert len(memory.young) < 130 and len(memory.old) < 130
    assert len(asked) < 330  # what is used again is kept
    own = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["some words, then SOME more. Some!", None, "", " \t\n", "ünïcode Ünïcode. 漢字 İI ſs K", "it's a<|b <|endoftext|>. x.. . ,, ... a. A.", "don't DON'T-STOP 3.14 w\x00z \x85 \xa0nbsp"]
    texts += [" ".join(f"w{i}x{'abcdefgh'[i % 8]}" + ".,;:!? "[i % 7] + "\n " * (i % 3) for i in range(k, 3 * k)) for k in (1, 500, 5000)]
    for memory in (own.memory, Memory(words=50, ids=100)):
        own.memory = memory
        for _ in range(2):
            whole = list(own.encode(pa.array(texts, pa.string())))
            assert whole == [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    own.forget()
    assert not len(own.memory.young) and not len(own.memory.old)


# sharding


def check_sharding(df, n=24):
    docs, out = pairs(df), shard(df, n).collect()
    assert Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs) == Counter((r.doc_id, r.size, r.text_crc32) for r in out)
    slots, by_id = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        by_id[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and 0 <= r.shard < n and r.grown_shard in (r.shard, n)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_id.values())
    return out


def test_sharding(edge, corpus, empty):
    check_sharding(corpus)
    check_sharding(edge)
    check_sharding(corpus, 25)
    assert shard(empty).count() == 0


def test_shards_are_even_and_follow_weights(spark):
    df = spark.range(24_000).selectExpr("id AS doc_id", "'' AS text")
    sizes = Counter(r.shard for r in shard(df).select("shard").collect())
    assert len(sizes) == 24 and all(abs(n - 1000) < 160 for n in sizes.values())
    tree = Tree((((1.0, 3.0), (2.0,)), ((6.0,),)))
    sizes = Counter(r.shard for r in shard(df, tree=tree).select("shard").collect())
    assert all(abs(sizes[k] - 2000 * w) < 300 for k, w in enumerate((1, 3, 2, 6)))


def test_weight_change_stays_in_its_subtree(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "'' AS text")
    a, b = Tree((((1.0, 1.0), (1.0, 1.0)), ((4.0,),))), Tree((((1.0, 2.0), (1.0, 1.0)), ((4.0,),)))
    before, after = ({r.doc_id: r.shard for r in shard(df, tree=t).select("doc_id", "shard").collect()} for t in (a, b))
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved and all(y in (0, 1, 2, 3) for _, y in moved)  # into the region whose weight rose
    assert all(y == 1 for x, y in moved if x in (0, 1))  # and in the rack, only into the shard itself


def winner(key, path, weights):
    """The draws again, one document at a time."""
    draw = lambda k: -math.log((int(hashlib.md5(f"{key}|{path}{k}".encode()).hexdigest()[:13], 16) + 1) / (2.0**52 + 1)) / weights[k]
    return min(range(len(weights)), key=draw)


def expected_shard(key, n):
    regions = [[[1.0] * 2] * 4] * 3 + [[[1.0]]] * max(0, n - 24)
    for k in range(6):
        again = f"{key}#{k}" if k else key
        r = winner(again, "r", [sum(map(sum, x)) for x in regions])
        rack = winner(again, f"{r}.", [sum(x) for x in regions[r]])
        leaf = sum(len(x) for region in regions[:r] for x in region) + sum(map(len, regions[r][:rack])) + winner(again, f"{r}.{rack}.", regions[r][rack])
        if leaf < n:
            return leaf
    return winner(key, "shard", [1.0] * n)


def test_shards_match_brute_force(corpus):
    for n in (1, 7, 23, 24, 25, 31):
        out = shard(corpus, n).collect()
        assert all((r.shard, r.grown_shard) == (expected_shard(str(r.doc_id), n), expected_shard(str(r.doc_id), n + 1)) for r in out)


def test_every_count_grows_into_the_new_shard_only(spark):
    rows = spark.range(3000).selectExpr("CAST(id AS string) AS key").repartition(4)
    by_count = {n: dict(map(tuple, with_shard(rows, "key", even_tree(n), n, "s").select("key", "s").collect())) for n in range(1, 42)}
    for n in range(1, 41):
        assert all(by_count[n + 1][k] in (s, n) for k, s in by_count[n].items())
        found = Counter(by_count[n].values())
        assert len(found) == n and max(found.values()) < 3000 / n + 6 * (3000 / n) ** 0.5


def test_trees():
    assert even_tree(24).n_shards == 24 and even_tree(27).n_shards == 27 and even_tree(5).n_shards == 24
    with pytest.raises(ValueError):
        Tree((((0.0,),),))


# mixing


def check_mixing(df, weights=(5, 2, 1), epochs=3):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        target = {s: epochs * sizes[s] if s in full else left * w[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > epochs * sizes[s]}
        if not over:
            break
        full |= over
    out = mix(df, weights=weights, max_epochs=epochs).collect()
    assert Counter((i, len(WORD.findall(t or "")), s) for i, t, s in docs) == Counter((r.doc_id, r.size, r.source) for r in out)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6)
        assert r.taken == r.size * r.copies and 0 <= r.copies <= epochs
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    return out


def test_mixing(edge, corpus, empty):
    one = check_mixing(corpus)
    assert sorted(one) == sorted(check_mixing(corpus))
    check_mixing(corpus, weights=(1, 50), epochs=2)
    check_mixing(edge)
    assert mix(empty).count() == 0


def test_rows_without_identifiers_come_near_the_target(make):
    """Null identifiers with different texts, and copies that nothing tells apart, in partitions of their own."""
    texts = [(None, " ".join(["w"] * (50 + k))) for k in range(150)] + [(None, "the same words " * 30)] * 60 + [(7, "seven " * 40)] * 61
    df = make(texts, source=lambda i: "a").unionByName(make([(k, "other " * 400) for k in range(100, 140)], source=lambda i: "b"))
    check_mixing(df.repartition(6))
    check_mixing(make([(7, "seven " * 40)] * 61 + [(8, "b " * 9000)], source=lambda i: "ab"[i - 7]).repartition(5), weights=(1, 4))


def test_larger_budgets_keep_what_smaller_ones_take(corpus):
    small, large = ({r.doc_id: r.copies for r in mix(corpus, budget=b).collect()} for b in (0.3, 0.4))
    assert all(large[i] >= small[i] for i in small)


def test_mixing_without_words(make):
    assert {(r.taken, r.target) for r in mix(make([(1, None), (2, " ")], source=lambda i: None)).collect()} == {(0, 0.0)}


# quality


def base(text):
    words, seen, dup, at = WORD.findall(text), set(), 0, defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    repeated = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, r = len(words), len(repeated)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 50 or 100 * r > 50 * n


def test_quality_rules(edge, corpus, empty, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    for df, trusted in ((edge, edge), (corpus, labels), (corpus, labels.limit(0))):
        for more in ({}, {"broadcast_ids": 0}):
            out = quality_rules(df, trusted, **more).collect()
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
            assert Counter((r.doc_id, *(r[n] for n in names)) for r in out) == Counter((i, *base(t or "")) for i, t in pairs(df))
            assert all(r.kept == (not r.base_failed and r.llr >= -0.13) for r in out)
    assert quality_rules(empty, labels).count() == 0


def test_ratio_matches_direct_counts(make):
    """With few words no bucket is shared, so the ratio follows from plain counts."""
    from postloom.llm.quality_rules import BUCKETS, SMOOTHING

    docs = make([(1, "a b c"), (2, "a b d"), (3, "e e")])
    grams = {i: [*w, *zip(w, w[1:], strict=False)] for i, w in ((1, "abc"), (2, "abd"), (3, "ee"))}
    raw, target = Counter(g for v in grams.values() for g in v), Counter(grams[1])
    log = lambda c, g: math.log((c[g] + SMOOTHING * sum(c.values()) / BUCKETS) / (sum(c.values()) * (1 + SMOOTHING)))
    for r in quality_rules(docs, docs.where("doc_id = 1")).collect():
        want = sum(log(target, g) - log(raw, g) for g in grams[r.doc_id]) / len(grams[r.doc_id])
        assert math.isclose(r.llr, want, rel_tol=1e-4)


def test_ratio_matches_counts_over_the_corpus(corpus, spark, sf_dir):
    """Every document's mean, from counts of the buckets of one document at a time."""
    import pyarrow as pa

    from postloom.llm.quality_rules import BUCKETS, SMOOTHING, buckets
    from postloom.llm.textscan import scans

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    trusted, own = {r.doc_id for r in labels.collect()}, {}
    raw, target = Counter(), Counter()
    for i, t in pairs(corpus):
        own[i] = [b for _, _, scan in scans(pa.array([t], pa.string()), lower=True) for b in buckets(scan)[0].tolist()]
        raw.update(own[i])
        target.update(own[i] if i in trusted else ())
    log = lambda c, b: math.log((c[b] + SMOOTHING * sum(c.values()) / BUCKETS) / (sum(c.values()) * (1 + SMOOTHING)))
    ratio = {b: log(target, b) - log(raw, b) for b in raw}
    for r in quality_rules(corpus, labels).collect():
        want = sum(ratio[b] for b in own[r.doc_id]) / max(1, len(own[r.doc_id]))
        assert math.isclose(r.llr, want, rel_tol=1e-3, abs_tol=1e-5)


def test_quality_model(spark, sf_dir):
    """Held-out accuracy, reruns, the fold, and scores that do not depend on what is scored beside a text."""
    path = sf_dir.replace("0.001", "0.01")  # enough labels outside and inside the fold
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = train(docs, labels)
    out = {r.doc_id: r for r in score_quality(docs, model).collect()}
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in out.items())
    held = [(out[r.doc_id].predicted, r.quality) for r in labels.collect() if out[r.doc_id].held_out]
    assert len(held) > 40 and sum(p == q for p, q in held) / len(held) > 0.95
    for parts in (1, 7, 40):
        assert {r.doc_id: r.score for r in score_quality(docs.repartition(parts), model).collect()} == {i: r.score for i, r in out.items()}
    again = train(docs, labels)
    assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)


def test_quality_model_edge(edge, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (5, 0), (None, 1), (7, 1), (8, None)], "doc_id long, quality int")
    for model in (train(edge, labels), train(edge, labels.where("quality = 1")), train(empty, labels)):
        out = score_quality(edge, model).collect()
        assert len(out) == edge.count() and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id in (4, 5, 6)}) == 1
    assert score_quality(empty, None).count() == 0


# chat


def expected_chats(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    bare = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    out = []
    for c, v in bare.items():
        longer = any(len(u) > len(v) and u[: len(v)] == v for u in bare.values())
        equal = [d for d, u in bare.items() if u == v]
        first = None if None in equal else min(equal)
        if not longer and c == first:
            out.append((c, len(v), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v)))
    return sorted(out, key=str)


def test_chat(spark, sf_dir):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (4, 0, "user", "h"), (4, 1, "i", "x")]
    rows += [(5, 0, None, None), (5, None, "user", "x"), (6, 0, "user", ""), (None, 0, "user", "lost"), (7, 0, "user", "lost"), (8, 0, "us", "er:hi"), (9, 1, "user", "twice"), (9, 1, "user", "twice")]
    rows += [(10, k, "user", f"turn {k}") for k in range(300)] + [(11, k, "user", f"turn {k}") for k in range(299)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, hash string, n_turns string")
    assert sorted(((r.conv_id, r.n_turns, r.chat) for r in collapse_snapshots(df).collect()), key=str) == expected_chats(rows)
    assert collapse_snapshots(df.limit(0)).count() == 0
    long = [(1, 0, "user", "x" * 3_000_000), (2, 0, "user", "x" * 3_000_000), (2, 1, "assistant", "y"), (3, 0, "user", "x" * 2_999_999)]
    df = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    assert sorted(((r.conv_id, r.n_turns, r.chat) for r in collapse_snapshots(df).collect()), key=str) == expected_chats(long)
    logged = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in logged.collect()]
    assert sorted(((r.conv_id, r.n_turns, r.chat) for r in collapse_snapshots(logged).collect()), key=str) == expected_chats(rows)
