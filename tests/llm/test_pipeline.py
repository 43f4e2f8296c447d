"""Every stage of the pipeline against brute force, on the small tables and on rows of every awkward kind."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_dedup import shingles
from test_select_and_pack import check_packing

import corpus_pipeline as pipeline
from postloom.llm.common import materialize
from postloom.llm.quality_model import passages, train
from postloom.llm.textscan import scans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = "row __row id copies copy n _id doc_id_ text_a"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def awkward(spark, edge, tmp_path_factory):
    """Rows with nulls, repeats and a very long text, under every name that a stage gives to columns of its own."""
    path = str(tmp_path_factory.mktemp("awkward"))
    edge.selectExpr("doc_id", "text", "lang", "source", "n_chars", *(f"'clash' AS {c}" for c in NAMES.split())).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (3, 0), (5, 0), (7, 0), (8, 1), (9, 1), (None, 1), (11, None)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def rows(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def expected_quality(spark, docs, sf_dir):
    """Each document scored alone."""
    import pyarrow as pa

    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = Counter()
    for row, n in rows(docs).items():
        ((_, _, scan),) = scans(pa.array([row[1]], pa.string()))
        if (model.score(*passages(scan))[0] if model else 0.5) >= 0.3:
            kept[row] += n
    return kept


def check_exact(before, after):
    key = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
    groups = defaultdict(list)
    for r in before:
        groups[key(r)].append(r)
    assert set(after.values()) <= {1} and Counter(map(key, after)) == Counter(groups.keys())
    rank = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
    longest = {k: max(len(r[1] or "") for r in v) for k, v in groups.items()}
    assert all(r in before and len(r[1] or "") == longest[key(r)] for r in after)
    if all(r[0] is not None for r in before) and max(before.values(), default=0) == 1:
        assert all(r == min(groups[key(r)], key=rank) for r in after)


def check_near(before, after):
    docs = list(before.elements())
    sets = [shingles(r[1]) for r in docs]
    own = list(range(len(docs)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            c = len(a & sets[j])
            if c and 100 * c >= 80 * (len(a) + len(sets[j]) - c):
                own[root(i)] = root(j)
    groups = Counter(root(k) for k in range(len(docs)))
    kept = Counter(root(docs.index(r)) for r in after.elements() if sets[docs.index(r)])
    assert all(kept[g] == 1 for g in groups if sets[g]) and sum(after.values()) == len(groups)
    if all(r[0] is not None for r in docs) and len({r[0] for r in docs}) == len(docs):
        least = {}
        for k, r in enumerate(docs):
            least[root(k)] = min(least.get(root(k), r), r, key=lambda x: x[0])
        assert set(after) == set(least.values())


def check_mixture(before, after):
    size = lambda r: len(WORD.findall(r[1] or ""))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r, n in before.items():
        sizes[r[3]] += n * size(r)
        largest[r[3]] = max(largest[r[3]], size(r))
    for r, n in after.items():
        assert n <= 3 * before[r]
        taken[r[3]] += n * size(r)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in order)


def check_stages(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        assert out.columns == columns
        before, after = rows(docs), rows(out)
        if name == "quality":
            assert after == expected_quality(spark, docs, sf_dir)
        else:
            {"exact_dedup": check_exact, "near_dedup": check_near, "mixing": check_mixture}[name](before, after)
        docs = out
        counts.append(docs.count())
    check_packing(docs, tokenizer, 4096)
    pieces = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    own = defaultdict(list)
    for r in pieces:
        own[r.row_id].append((r.start, r.length, r.doc_tokens))
    assert len(own) == counts[-1]  # copies are told apart, and each is whole
    assert all(sum(n for _, n, _ in v) == v[0][2] and [s for s, *_ in sorted(v)] == list(np.cumsum([0, *(n for _, n, _ in sorted(v)[:-1])])) for v in own.values())
    return counts, pieces


def test_stages_on_the_small_tables(spark, sf_dir, tokenizer):
    counts, pieces = check_stages(spark, sf_dir, tokenizer)
    assert counts[0] > counts[1] > counts[2] > counts[3] and [name for name, _ in pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    whole = pipeline.run(spark, sf_dir).collect()
    tokens = lambda found: Counter((r.doc_id, r.doc_tokens) for r in found if r.start == 0)
    assert tokens(whole) == tokens(pieces)


def test_stages_on_awkward_rows(spark, awkward, tokenizer):
    check_stages(spark, awkward, tokenizer)


def test_stages_without_rows(spark, awkward, sf_dir):
    none = spark.read.parquet(f"{awkward}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
