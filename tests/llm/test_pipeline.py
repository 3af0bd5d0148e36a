import hashlib
import math
from collections import defaultdict

import corpus_pipeline
import numpy as np
from catalogflow.llm import bpe, language

from ..conftest import SF
from .cases import hard_docs, no_docs, sha, words
from .test_dedup_and_join import classes, normalised
from .test_text_operators import filled


def expected(docs, accepted):
    """The stages over plain rows (doc_id, text, source)."""
    rows = [r for r in docs if r[0] in accepted]
    first = {}
    for i, t, _ in rows:
        first[normalised(t)] = min(i, first.get(normalised(t), i))
    rows = [r for r in rows if first[normalised(r[1])] == r[0]]
    of = classes([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if of[r[0]][1] == r[0]]
    sizes, steps = defaultdict(int), defaultdict(int)
    drawn = lambda i: int(hashlib.sha256(f"mix-1:{i}".encode()).hexdigest()[:3], 16)
    for i, t, s in rows:
        sizes[s] += len(words(t))
        steps[s, drawn(i)] += len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, filled([sizes[n] for n in names], [(1, 2, 3)[k % 3] for k in range(len(names))]), strict=True))
    whole, cutoff = {}, {}
    for s in names:
        rate = min(3.0, round(target[s], 6) / sizes[s]) if sizes[s] else 0.0
        whole[s], taken = math.floor(rate), 0
        need = round(target[s], 6) - whole[s] * sizes[s]
        best = (abs(need), 0)
        for step in sorted(d for n, d in steps if n == s):
            taken += steps[s, step]
            best = min(best, (abs(taken - need), step + 1))
        cutoff[s] = best[1] if whole[s] < 3 else 0
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    out = []
    for i, t, s in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(t or ""))] * (whole[s] + (drawn(i) < cutoff[s]))
    return sorted(out)


def test_pipeline_equals_its_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    accepted = {r.doc_id for r in language.identify(docs).collect() if r.lang_pred != "und" and r.score >= 0.05}
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == expected([(r.doc_id, r.text, r.source) for r in docs.collect()], accepted)


def test_stages_keep_columns_and_bear_hard_cases(spark):
    for docs in (hard_docs(spark), no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == docs.columns
            assert after.count() <= 3 * docs.count()
            assert name != "near_dedup" or after.count() <= docs.count()
            docs = docs if name == corpus_pipeline.STAGES[-1][0] else after
