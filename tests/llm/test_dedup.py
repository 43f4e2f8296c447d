import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from postloom.llm.exact_dedup import exact_dedup
from postloom.llm.jaccard_join import bitmap, differing, jaccard_classes
from postloom.llm.line_dedup import line_dedup
from postloom.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def exact_expected(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {hashlib.sha256(k.encode()).hexdigest(): (min(v)[3], len(v)) for k, v in groups.items()}


def check_exact(df, **more):
    docs, out = pairs(df), exact_dedup(df, **more).collect()
    want = exact_expected(docs)
    assert len(out) == len(docs)
    assert Counter((r.doc_id, r.text_sha256) for r in out) == Counter((i, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()) for i, t in docs)
    for r in out:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept) == set(want) and set(kept.values()) <= {1}
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_exact_edge(edge, empty):
    check_exact(edge)
    assert exact_dedup(empty).count() == 0


def test_exact_levels_and_a_filter_that_is_too_small(corpus):
    from postloom.llm import exact_dedup as own

    check_exact(corpus.repartition(9), fanout=2)
    bits, own.CHUNK_BITS = own.CHUNK_BITS, 8  # one chunk of eight bits, which lets nearly everything pass
    try:
        check_exact(corpus, most_bits=8)
    finally:
        own.CHUNK_BITS = bits


def test_exact_runs_are_sorted_and_merged_by_level(corpus):
    from postloom.llm.exact_dedup import compact, flush_runs, normalised

    rows = corpus.repartition(9).select(F.col("doc_id").alias("_id"), F.length("text").alias("_len"), F.xxhash64(normalised(F.coalesce("text", F.lit("")))).alias("_digest"), F.lit(b"x").alias("_sha"))
    runs = flush_runs(rows)
    by_file = defaultdict(list)
    for f, run, d in runs.select(F.input_file_name(), "_run", "_digest").collect():
        by_file[f].append((run, d))
    assert len(by_file) == 9 and all(x == sorted(x) and len({r for r, _ in x}) == 1 for x in by_file.values())
    count = Counter(d for x in by_file.values() for _, d in x)
    for fanout in (2, 3, 100):
        assert {r._digest: r._n for r in compact(runs, fanout).collect()} == count


def test_exact_filter_keeps_single_rows_from_moving(corpus):
    from postloom.llm.exact_dedup import CHUNK_BITS, filter_of, probe

    rows = corpus.select(F.xxhash64("doc_id").alias("_digest"))
    hits = rows.where("_digest % 7 = 0")
    probed = probe(rows, filter_of(hits, CHUNK_BITS), CHUNK_BITS)
    assert probed.where("_maybe").join(hits, "_digest").count() == hits.count()
    assert probed.where("_maybe").count() < hits.count() + 20
    plan = exact_dedup(corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("getbit") >= 2 and "strategy=broadcast" in plan


def test_exact_digests_that_clash(edge, corpus):
    few = lambda c: F.pmod(F.xxhash64(c), F.lit(7)).cast("bigint")
    check_exact(edge, digest=few)
    check_exact(corpus, digest=few)


def shingles(t, n=5):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def check_jaccard(df, **more):
    docs = pairs(df)
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            c = len(a & sets[j])
            if c and 100 * c >= 80 * (len(a) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        least.setdefault(root(k), []).append(i)
    named = lambda ids: min((i for i in ids if i is not None), default=None)
    want = Counter((i, len(sets[k]), named(least[root(k)])) for k, (i, _) in enumerate(docs))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(df, **more).collect())
    assert got == want


def family(make):
    """A chain in which neighbours link and the ends do not, variants at all distances, and texts that share one passage."""
    words = [f"t{i}" for i in range(100)]
    texts = [" ".join(["x"] * 0 + words[k : k + 60]) for k in range(0, 12, 2)]
    texts += [" ".join(w if i not in range(k, 60, 17) else f"edit{k}" for i, w in enumerate(words[:60])) for k in range(20)]
    texts += [" ".join(words[:30]) + f" tail{k} more{k} and{k}" for k in range(12)]
    return make(list(enumerate(texts)))


def test_jaccard_edge(edge, empty):
    check_jaccard(edge)
    assert jaccard_classes(empty).count() == 0


def test_jaccard_corpus(corpus):
    check_jaccard(corpus)


def test_jaccard_family_in_blocks_and_by_shuffle(make):
    check_jaccard(family(make))
    check_jaccard(family(make), block=3, sample=1, few=2, split=2, broadcast_classes=0)
    check_jaccard(family(make), few=1)


def test_jaccard_bound_opens_only_groups_within_reach(spark):
    """A query of 100 shingles needs 9 of a group of that size, fewer of one whose sizes differ."""
    from postloom.llm.jaccard_join import opened_lists, token_groups, within_reach

    reach = lambda count, size, least, most: spark.range(1).select(within_reach(*map(F.lit, (count, size, least, most)), 80)).first()[0]
    assert not reach(8, 100, 100, 100) and reach(9, 100, 100, 100)
    assert reach(1, 100, 80, 100) and reach(1, 100, 100, 125) and not reach(90, 100, 126, 200) and not reach(90, 100, 10, 79)
    lists = [(x, node, 100, grp) for node, grp, shingles in ((1, 1, range(20)), (2, 2, range(8)), (3, 2, range(5)), (4, 4, range(9)), (5, 4, range(7, 9))) for x in shingles]
    labelled = spark.createDataFrame(lists, "shingle long, node long, size int, grp long")
    opened = {tuple(r) for r in opened_lists(labelled, token_groups(labelled), 80, 64).collect()}
    # 1 shares 9 shingles with group 4 and 8 with group 2; of group 2's members none shares 9 with another group
    assert opened == {(x, node) for x, node, *_ in lists if x < 9 and node in (1, 4, 5)}
    everything = {tuple(r) for r in opened_lists(labelled, token_groups(labelled), 80, 1).collect()}
    assert everything == {(x, node) for x, node, *_ in lists if x < 9}


def test_jaccard_bound_is_never_below_an_overlap():
    """For random sets: similar enough implies the bound with the shared shingles of the prefixes."""
    import random

    from postloom.llm.jaccard_join import least_overlap_of_one

    rng, similar = random.Random(5), 0
    for _ in range(3000):
        pool = list(range(40))
        a = set(rng.sample(pool, rng.randint(1, 30)))
        b = set(rng.sample(sorted(a), rng.randint(max(1, len(a) - 5), len(a)))) | set(rng.sample(pool, rng.randint(0, 4)))
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        similar += 1
        m, n = len(a), len(b)
        shared = len(set(sorted(a)[: m - least_overlap_of_one(m, 80) + 1]) & set(sorted(b)[: n - least_overlap_of_one(n, 80) + 1]))
        assert shared > 0 and shared * 18000 >= (m + n) * 8000 - max(m, n) * 80 * 180
    assert similar > 300


def test_bitmaps_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m in ((10, 10), (500, 480), (130, 120), (1000, 1030)):
        base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        x, y = np.unique(base[:n]), np.unique(base[n // 3 : n // 3 + m])
        assert differing(bitmap(x), bitmap(y)) <= len(np.setxor1d(x, y))


def key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def check_lines(df, least, **more):
    docs = pairs(df)
    count = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} - {""})
    want = Counter()
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < least]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup(df, min_docs=least, **more).collect())
    assert got == want


def test_lines(edge, empty, corpus):
    check_lines(edge, 2)
    check_lines(edge, 2, broadcast_hashes=0)
    check_lines(corpus, 3)
    check_lines(corpus, 3, broadcast_hashes=0)
    assert line_dedup(empty).count() == 0


def check_substrings(df, window=13, **more):
    docs = pairs(df)
    rank = lambda i: (i is None, i or 0)
    first = {}
    words = [WORD.findall(t or "") for _, t in docs]
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, rank(i)), rank(i))
    want = Counter()
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < rank(i):
                gone |= set(range(k, k + window))
        want[i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)] += 1
    got = Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in substring_dedup(df, window=window, **more).collect())
    assert got == want


def test_substrings(edge, empty, corpus):
    check_substrings(edge)
    check_substrings(corpus)
    assert substring_dedup(empty).count() == 0


def test_substrings_hot_and_by_shuffle(edge, corpus):
    check_substrings(edge, hot=1, shard=5, broadcast_anchors=0, broadcast_spans=0)
    check_substrings(corpus, hot=2, shard=20, broadcast_anchors=0, broadcast_spans=0)
