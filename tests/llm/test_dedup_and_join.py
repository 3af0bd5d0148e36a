import random
from collections import Counter

import numpy as np
import pytest
from catalogflow.llm import exact_dedup, ngram_join, substring_dedup

from .cases import hard_docs, hard_texts, no_docs, prose, sha, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalised(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_matches_the_definition(spark):
    texts = hard_texts()
    got = sorted(map(tuple, exact_dedup.exact_dedup(hard_docs(spark)).collect()))
    groups = {}
    for i, t in texts:
        groups.setdefault(normalised(t), []).append(i)
    seen, want = set(), []
    for i, t in sorted(texts, key=lambda r: r[0]):
        ids = groups[normalised(t)]
        first = i == min(ids) and (i, normalised(t)) not in seen
        seen.add((i, normalised(t)))
        want.append((i, min(ids), len(ids), first, sha(normalised(t))))
    assert got == sorted(want)


def test_exact_dedup_of_null_ids_and_of_nothing(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "a  b"), (None, "c")], "doc_id long, text string")
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {(None, sha("a b")): (5, False), (5, sha("a b")): (5, True), (None, sha("c")): (None, True)}
    assert exact_dedup.exact_dedup(no_docs(spark)).count() == 0


def test_keep_first_keeps_columns_and_one_row_a_text(spark):
    docs = hard_docs(spark)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 8, 9, 11, 12, 14, 15, 16, 17, 18, 19, 20]


def classes(texts, k=5, percent=80):
    """Brute force: component by doc_id."""
    sets = {}
    for i, t in texts:
        w = words((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    up, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
                links[a] += 1
                links[b] += 1
    return {i: (len(sets[i]), root(i), links[i]) for i in ids}


def found(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in frame.collect()}


def test_join_on_hard_cases(spark):
    got = ngram_join.jaccard_classes(hard_docs(spark))
    assert got.count() == len(hard_texts())
    want = {i: (n, c, k + (i == 18)) for i, (n, c, k) in classes(hard_texts()).items()}  # id 18 stands there twice
    assert found(got) == want
    assert ngram_join.jaccard_classes(no_docs(spark)).count() == 0


def families(seed):
    """Hot families round a base, with copies that link only with one another, chains, and lines that
    many share."""
    draw, out = random.Random(seed), []
    line = prose(99, 14)
    for f in range(4):
        base = prose(seed * 10 + f, 110, 3000).split()
        for _ in range(60 if f == 0 else 12):
            w = list(base)
            for _ in range(draw.choice([0, 1, 2, 3, 4, 5])):
                w[draw.randrange(len(w))] = f"v{draw.randrange(10**6)}"
            if draw.random() < 0.3:
                w += line.split()
            out.append(" ".join(w))
    chain = prose(seed + 777, 100, 5000).split()
    for step in range(8):  # each is near the next alone
        out.append(" ".join(chain[step * 8 :] + [f"n{j}" for j in range(step * 8)]))
    out += [prose(seed + 1000 + j, 40, 5000) + " " + line for j in range(60)]
    order = list(range(len(out)))
    draw.shuffle(order)
    return [(3 * i + 1, out[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("block", [400_000, 1_500])
def test_join_finds_every_component_of_hot_families(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    texts = families(5)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got, want = found(ngram_join.jaccard_classes(docs)), classes(texts)
    assert got == want
    kept = {r.doc_id for r in ngram_join.keep_one(docs).collect()}
    assert kept == {c for _, c, _ in want.values()}


def test_null_ids_do_not_carry_links(spark):
    docs = spark.createDataFrame([(None, prose(1, 50)), (4, prose(1, 50) + " x"), (9, prose(1, 50)), (None, "alone here")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.n_links) for r in ngram_join.jaccard_classes(docs).collect())
    assert got == [(-1, -1, 0), (-1, 4, 2), (4, 4, 1), (9, 4, 1)]
    assert sorted(r.doc_id or -1 for r in ngram_join.keep_one(docs).collect()) == [-1, -1, 4]


def test_long_regular_words_are_told_apart(spark):
    def thue_morse(n, a, b):
        return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))

    texts = [(k, thue_morse(n, a, b)) for k, (n, a, b) in enumerate((n, *ab) for n in (16, 512, 1024, 4096) for ab in ("ab", "ba"))]
    texts += [(20 + k, " ".join([thue_morse(256, a, b)] * 3 + ["tail"] * 4)) for k, (a, b) in enumerate(("ab", "ba"))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert found(ngram_join.jaccard_classes(docs)) == classes(texts)


def test_sets_that_share_a_key_stay_apart(spark, monkeypatch):
    whole = ngram_join.set_key
    monkeypatch.setattr(ngram_join, "set_key", lambda s: (whole(s)[0] % 3, whole(s)[1]))
    texts = [(3 * i + 1, t) for i, (_, t) in enumerate(families(6)[:40])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found_ = sorted((r.class_id, r.n_shingles) for r in ngram_join.jaccard_classes(docs).collect())
    assert len(found_) == len({c for c, _ in found_})


@pytest.mark.parametrize(("rounds", "most", "pool", "longest"), [(60, 30, 40, 40), (3, 600, 60, 50), (2, 500, 900, 120)])
def test_search_equals_counting(rounds, most, pool, longest):
    """In large blocks lists of a sixteenth and more of the sets are columns, others are merged or probed."""
    draw = np.random.default_rng(3)
    for _ in range(rounds):
        sets = [np.unique(draw.integers(0, pool, draw.integers(1, longest))).astype(np.uint64) for _ in range(draw.integers(most // 2, most))]
        sets += [np.unique(np.append(s[: max(1, len(s) - 2)], draw.integers(0, pool, 1).astype(np.uint64))) for s in sets[: most // 3]]
        index = ngram_join.Gathered(sets)
        for q in sets:
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))]
            assert sorted(index.search(q).tolist()) == want


def removed(texts, window):
    first = {}
    for i, t in sorted(((i, t) for i, t in texts if i is not None), key=lambda r: r[0]):
        w = words(t)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = []
    for i, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), sha(" ".join(left))))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


def test_substring_dedup_on_hard_cases(spark):
    texts = hard_texts() + [(None, prose(1, 120))]
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(hard_docs(spark, texts)).collect()), key=key)
    assert got == sorted(removed(texts, 50), key=key)
    assert substring_dedup.remove_repeats(no_docs(spark)).count() == 0


@pytest.mark.parametrize("shard", [1_500_000, 300])
def test_substring_dedup_of_shared_passages(spark, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    draw = random.Random(8)
    passages = [prose(s, draw.randrange(40, 130)) for s in range(12)]
    texts = []
    for i in range(120):
        parts = [draw.choice(passages) if draw.random() < 0.5 else prose(500 + i * 10 + j, draw.randrange(1, 80), 5000) for j in range(4)]
        texts.append((i * 2, " ".join(parts)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect())) == sorted(removed(texts, 50))
    loop = [(1, " ".join(["go"] * 300)), (2, " ".join(["go"] * 80 + ["stop"] + ["go"] * 60))]
    assert sorted(map(tuple, substring_dedup.remove_repeats(spark.createDataFrame(loop, "doc_id long, text string")).collect())) == removed(loop, 50)


def test_substring_dedup_of_rows_that_repeat_an_id(spark):
    a, b, c = prose(31, 60), prose(32, 60), prose(33, 70)
    texts = [(1, a), (2, a), (2, b), (2, b), (3, f"{c} {b}"), (3, c), (4, f"x {c}"), (4, None), (4, a)]
    got = sorted(map(tuple, substring_dedup.remove_repeats(hard_docs(spark, texts)).collect()))
    assert got == sorted(removed(texts, 50))
    assert [r[2] for r in got if r[0] == 2] == [0, 0, 60]


@pytest.mark.parametrize("levels", [1, 8])
def test_a_wide_anchor_is_split_by_the_next(spark, monkeypatch, levels):
    """One run of words in ever other surroundings, for an index that holds but a few of them."""
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 600)
    monkeypatch.setattr(substring_dedup, "LEVELS", levels)
    run, texts = prose(41, 25, 9_000), []
    for i in range(60):
        texts.append((i, f"{prose(100 + i % 40, 70, 9_000)} {run} {prose(200 + i % 50, 70, 9_000)}"))
    texts += [(70, "a " * 400), (71, "a b " * 300), (72, "a " * 90)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect())) == sorted(removed(texts, 50))


def test_smallest_documents_of_intervals():
    draw = np.random.default_rng(2)
    passages, documents = [draw.integers(1, 40, draw.integers(5, 90)) for _ in range(60)], draw.integers(0, 30, 60)
    index = substring_dedup.PassageIndex(passages, documents)
    text = np.concatenate([x for p in passages for x in (p, [0])])
    own = documents[np.repeat(np.arange(60), [len(p) + 1 for p in passages])[index._suffixes(text)]]
    low = draw.integers(0, index.size, 3000)
    high = np.minimum(index.size, low + draw.integers(0, index.size, 3000) // draw.integers(1, 200, 3000))
    want = [own[a:b].min() if a < b else np.iinfo(np.int64).max for a, b in zip(low, high, strict=True)]
    assert index.smallest(low, high).tolist() == want


def test_wavelet_counts_and_backward_search():
    draw = np.random.default_rng(1)
    symbols = draw.integers(0, 11, 700)
    tree = substring_dedup.WaveletMatrix(symbols, 4)
    for c in range(11):
        at = np.arange(701)
        start = tree.count(np.array([c]), np.array([0]))
        assert (tree.count(np.full(701, c), at) - start == np.append(0, np.cumsum(symbols == c))).all()
    passages = [draw.integers(1, 4, 30), draw.integers(1, 4, 20)]
    index = substring_dedup.PassageIndex(passages, np.array([3, 8]))
    for pattern in ([1, 2], [3, 3, 1], [2, 1, 1, 2]):
        low, high = np.array([0]), np.array([index.size])
        for c in reversed(pattern):
            low, high = index.extended(low, high, np.array([c]))
        hits = Counter(d for p, d in zip(passages, (3, 8), strict=True) for s in range(len(p)) if p[s : s + len(pattern)].tolist() == pattern)
        assert high[0] - low[0] == sum(hits.values())
        assert index.smallest(low, high)[0] == min(hits, default=np.iinfo(np.int64).max)
