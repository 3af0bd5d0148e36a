import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from catalogflow.llm import bpe, exact_dedup, language, mixing, ngram_join, secrets, topk, toxicity, urls

from pyspark.sql import functions as F

from .cases import hard_docs, hard_texts, no_docs, prose, sha, words


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_equals_the_library(spark, library):
    texts = hard_texts() + [(30, "a <|endoftext|> b<|endoftext|>"), (31, "it's  I'LL\n\n x \u3000 y\u00a0 z"), (32, "😀" * 40)]
    got = sorted(map(tuple, bpe.encode_documents(hard_docs(spark, texts)).collect()))
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), __import__("hashlib").sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.encode_documents(no_docs(spark)).count() == 0


def test_bpe_round_trips_anything(library):
    coder, draw = bpe._loaded(bpe.default_vocabulary()), random.Random(2)
    parts = [" ", "  ", "\n", "\t", "'s", "the", " the", "é", "日", "\u3000", "<|endoftext|>", "12", "#$%", "\r\n", "\x1c", "\x85", "x" * 70, "😀", "ſ", "\xa0"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        found = coder.encode(text)
        assert np.frombuffer(found, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(found) == text


def test_long_pieces_merge_as_short_ones(monkeypatch):
    coder, draw = bpe._loaded(bpe.default_vocabulary()), random.Random(4)
    for letters in ("ab", "thein", "=-"):
        piece = "".join(draw.choice(letters) for _ in range(300)).encode()
        by_heap = coder._long_piece([coder.byte_id[b] for b in piece])
        monkeypatch.setattr(bpe, "LONG", 10**6)
        assert by_heap == coder._piece(piece)
        monkeypatch.undo()


def test_cuts_are_where_no_token_joins():
    coder = bpe._loaded(bpe.default_vocabulary())
    assert b"".join(coder.cuts(b"abc\xff\xfe<|x")) == b"abc\xff\xfe<|x"
    assert all(not any(pair in t for t in list(coder.ids)[:2000]) for pair in [b"e ", b"\xff\xfe"])


def filled(sizes, weights):
    """The contract's loop: stop at the cap, share the excess again by weight."""
    caps, closed, total = [3 * s for s in sizes], set(), sum(sizes)
    while True:
        left = total - sum(caps[i] for i in closed)
        open_weight = sum(w for i, w in enumerate(weights) if i not in closed)
        target = [caps[i] if i in closed else left * weights[i] / open_weight for i in range(len(sizes))]
        new = {i for i in range(len(sizes)) if i not in closed and target[i] > caps[i]}
        if not new:
            return target
        closed |= new


@pytest.mark.parametrize("sizes", [[5], [0, 0], [10, 10, 10], [1, 1000, 1], [100, 1, 1, 1], [7, 0, 3, 900, 2, 2, 2]])
def test_targets_are_filled_like_water(spark, sizes):
    names = [chr(97 + i) for i in range(len(sizes))]
    names[-1] = None if len(sizes) > 2 else names[-1]
    frame = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    assert [got[n] for n in names] == pytest.approx(filled(sizes, [(1, 2, 3)[i % 3] for i in range(len(sizes))]), abs=1e-4)


def mixed(frame):
    return [(r.doc_id, *r.mix) for r in mixing.mix(frame).collect()]


def test_mix_takes_what_it_says(spark):
    docs = hard_docs(spark)
    rows = mixed(docs)
    assert sorted(r[1] for r in rows) == sorted(len(words(t)) for _, t in hard_texts())
    assert all(0 <= r[4] <= 3 for r in rows)
    assert sorted(rows) == sorted(mixed(docs.repartition(2)))
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r[4] for r in rows)
    assert mixing.mix(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, out="SHARD")


def test_mix_draws_null_ids_by_their_texts(spark):
    docs = spark.createDataFrame([(None, prose(i, 30), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    assert len({r[4] for r in mixed(docs)}) > 1


@pytest.mark.parametrize("longest", [60, 5_000])
def test_mix_comes_near_its_targets(spark, longest):
    draw = random.Random(longest)
    size = [draw.randrange(20, 60 if i % 50 else longest + 1) for i in range(4000)]
    source = [f"s{0 if i % 3 else draw.randrange(20)}" for i in range(4000)]  # two thirds in one, some 65 in others
    docs = spark.createDataFrame([(i, prose(i, size[i]), source[i]) for i in range(4000)], "doc_id long, text string, source string")
    taken, target, top = {}, {}, {}
    for doc, n, _, wanted, copies in mixed(docs):
        s = source[doc]
        taken[s], target[s], top[s] = taken.get(s, 0) + n * copies, wanted, max(n, top.get(s, 0))
    assert all(abs(taken[s] - target[s]) <= top[s] / 2 + 1 for s in target)


def test_mix_joins_many_sources_with_salt(spark, monkeypatch):
    docs = hard_docs(spark)
    want = sorted(mixed(docs))
    monkeypatch.setattr(mixing, "small", lambda table: table)
    assert sorted(mixed(docs)) == want


def clashing(docs, *names):
    """``docs`` with columns of the names that helpers have or had."""
    return docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})


def test_columns_of_any_name_keep_their_values(spark):
    names = "row size draw mix copy copy_ of there whole cutoff target copies at order language gone __gone __size __copies __copy __source __target __digest __language".split()
    docs = clashing(hard_docs(spark).drop("key"), *names, "key")
    for name, f in (("mix", mixing.emit), ("dedup", exact_dedup.keep_first), ("join", ngram_join.keep_one), ("language", language.accept)):
        after = f(docs)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in [*names, "key"]), name
    assert [f for f in mixing.mix(docs.drop("mix")).columns if f not in docs.columns] == []


def test_language_on_hard_cases_and_held_out(spark):
    got = {(r.doc_id): r for r in language.identify(hard_docs(spark)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (6, 7, 8, 17, 19))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[16].lang_pred in ("en", "fr") and got[9].held_out == (zlib.crc32(b"9") % 5 == 0)
    assert language.identify(no_docs(spark)).count() == 0
    kept = language.accept(hard_docs(spark))
    assert kept.columns == hard_docs(spark).columns and not {6, 7, 8, 17, 19} & {r.doc_id for r in kept.collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_profiles_equal_binding_bundling_and_cosine_by_hand(spark):
    size = 1024
    texts = [(1, "Ab, c d", "x"), (2, "zu viel ist zu viel", "y"), (4, "ab ab ab", "x"), (6, "wenig", "y"), (9, "ab zu", None), (11, "", "x")]

    def letter(c):
        return language._letter_vector(ord(c) if c != " " else 0, size).tolist()

    def bundle(texts):
        total = [0] * size
        for text in texts:
            own = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
            own = re.sub(" +", " ", own)
            for a, b, c in zip(own, own[1:], own[2:], strict=False):
                x, y, z = letter(a), letter(b), letter(c)
                for k in range(size):  # the first letter's vector rotated twice, the second's once
                    total[k] += x[k - 2] * y[k - 1] * z[k]
        return total

    def cosine(u, v):
        return sum(a * b for a, b in zip(u, v, strict=True)) / math.sqrt(sum(a * a for a in u) * sum(b * b for b in v))

    learnt = [(i, t, lang) for i, t, lang in texts if lang and zlib.crc32(str(i).encode()) % 5]
    profiles = {lang: bundle([t for _, t, own in learnt if own == lang]) for lang in sorted({lang for _, _, lang in learnt})}
    assert len(profiles) == 2
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)).collect()}
    for i, t, _ in texts:
        if not any(c.isalpha() for c in t):
            assert got[i] == ("und", 0.0)
            continue
        scores = {lang: cosine(bundle([t]), p) for lang, p in profiles.items()}
        best = max(scores, key=lambda lang: (scores[lang], lang == min(scores)))
        assert got[i][0] == best and got[i][1] == pytest.approx(max(0.0, scores[best]), abs=1e-6)


def test_trigrams_keep_order():
    a, b = language.Vectors(512).bundle([language.trigrams("abc"), language.trigrams("cba")])
    assert abs(a @ b) / np.linalg.norm(a) / np.linalg.norm(b) < 0.6
    assert (language.trigrams("Ab, c") == language.trigrams("ab c")).all() and len(language.trigrams("12 .")) == 0


def test_secrets_equal_the_plain_patterns(spark):
    texts = [
        (1, 'Password: "abcdef" x token=12345 secret = abc123.d/e API_KEY:zzzzzz9 apikey=\'q1w2e3\''), (2, "AKIA" + "A1" * 10 + " AKIAXX"), (3, "deadbeef" * 4 + " cafe " + "0f" * 12 + "g"), (4, None), (5, ""),
        (6, "key qZ7xK9vB2mN4pL8wR3tY6uJ1 and the-plain-identifier-with-words 550e8400-e29b-41d4-a716-446655440000"), (7, "K" * 30), (8, "paſſword: abcdefgh"),
    ]
    got = {r.doc_id: r for r in secrets.scan(hard_docs(spark, texts)).collect()}
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for i, t in texts:
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] if i != 8 else []
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(base))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert got[i].base_sha256 == sha(said) and all(x in got[i].spans.split(",") for x in said.split(",") if x)
    assert got[6].spans == "random:4:28" and got[7].spans == ""
    assert secrets.scan(no_docs(spark)).count() == 0


def test_hosts_without_outcomes_are_judged_by_their_domain(spark):
    bad = [(f"h{i}.bad.com", 1) for i in range(6) for _ in range(30)]
    good = [(f"h{i}.good{i % 3}.com", 0) for i in range(9) for _ in range(30)]
    outcomes = spark.createDataFrame(bad + good, "host string, bad long")
    hosts = ["new.bad.com", "h0.bad.com", "new.good1.com", "new.unseen.com", "new.nowhere.xyz"]
    pages = spark.createDataFrame([(i, f"http://{h}/a") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r.host: r.verdict for r in urls.judge(pages, outcomes).collect()}
    assert got == dict(zip(hosts, ["block", "block", "allow", "allow", "allow"], strict=True))
    new = {r.host: r for r in urls.reputation(outcomes, pages.select(urls.host_of(F.col("url")).alias("host"))).collect()}
    assert len(new) == 15 + 4 and new["new.bad.com"].n == 0 and new["new.nowhere.xyz"].mean == pytest.approx(180 / 450)


def test_verdicts_follow_the_labels(spark):
    """On the driver's pages: with outcomes turned to bad for the hosts of one domain, its pages without a
    rule are blocked, those of hosts without outcomes too."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    outcomes = pages.join(labels, pages.page_id == labels.doc_id).select(urls.host_of(F.col("url")).alias("host"), (F.col("quality") == 0).cast("long").alias("bad"))
    extra = spark.createDataFrame([(900_000, "http://never.seen.example.com/x")], "page_id long, url string")
    every = pages.select("page_id", "url").union(extra)
    said = {r.page_id: r for r in urls.judge(every, outcomes).collect()}
    turned = outcomes.withColumn("bad", F.when(F.col("host").endswith("example.com"), 1).otherwise(F.col("bad")))
    again = {r.page_id: r for r in urls.judge(every, turned).collect()}
    free = [i for i, r in said.items() if r.rule is None]
    assert {said[i].verdict for i in free} == {"allow"}
    assert all(again[i].verdict == ("block" if again[i].host.endswith("example.com") else "allow") for i in free if again[i].host)
    assert again[900_000].verdict == "block"


def test_beta_shares():
    draw = np.random.default_rng(1)
    for a, b, x in ((2.0, 3.0, 0.5), (0.1, 5.0, 0.5), (30.0, 2.0, 0.9), (900.0, 950.0, 0.5), (1e6, 1e6 + 900, 0.5)):
        assert urls.beta_share(x, np.array([a]), np.array([b]))[0] == pytest.approx((draw.beta(a, b, 200_000) <= x).mean(), abs=0.005)
    assert urls.beta_share(0.5, np.array([0.0, 3.0]), np.array([3.0, 0.0])).tolist() == [1.0, 0.0]


def test_random_keys_are_found_with_few_digits_and_in_paths():
    encoding = secrets._encoding(secrets.default_vocabulary())
    draw = random.Random(4)
    find = lambda text: [(lo, hi) for lo, _, hi in secrets.random_spans(text, encoding, [])]
    letters, base62, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz"
    path = "/download/files/session/attachments/"
    for n in (16, 20, 24, 32, 64):
        for signs, least in ((letters, 0.98), (base62, 0.99), (lower, {16: 0.75, 20: 0.85, 24: 0.9}.get(n, 0.95))):
            keys = ["".join(draw.choices(signs, k=n)) for _ in range(300)]
            assert sum(find(f"x {k} y") == [(2, 2 + n)] for k in keys) >= 300 * least, (n, signs)
            assert sum(any(lo <= len(path) and hi == len(path) + n for lo, hi in find(path + k)) for k in keys) >= 300 * (least - 0.02)
    plain = ["internationalization", "well-known-identifier_of_words", "/usr/share/documentation/packages/", "2024-01-02/2024-02-03", "0123456789abcdef0123456789abcdef", "123e4567-e89b-12d3-a456-426614174000", "dieeinkeitgekeit", "eaumenteuxaiauxch"]
    assert [find(t) for t in plain] == [[]] * len(plain)
    known = "aZ3-bY7_cX9-dW4_eV2-fU8"
    assert find(known) == [(0, len(known))]


def test_clean_prose_has_no_random_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert secrets.scan(docs).filter("n_random > 0").count() <= 10  # of 10,000
    hard = {r.doc_id: r for r in secrets.scan(hard_docs(spark)).collect()}
    assert len(hard) == len({i for i, _ in hard_texts()}) and all(r.spans == "" and r.base_sha256 == sha("") for r in hard.values())
    twice = secrets.scan(hard_docs(spark, [(1, "key qZ7xK9vB2mN4pL8wR3tY6uJ1 " * 3000), (1, "key qZ7xK9vB2mN4pL8wR3tY6uJ1 " * 3000), (None, "token: abcdefg")])).collect()
    assert sorted((r.doc_id or 0, r.n_random, r.n_assign) for r in twice) == [(0, 0, 1), (1, 3000, 0), (1, 3000, 0)]


def test_urls(spark):
    pages = [
        (1, "http://A.Example.NET/en/1?q"), (2, "https://x.net/en/"), (3, "https://net"), (4, "ftp://b.example.com/de/x#y"), (5, "http://example.com/en/"), (6, "https://w.org/fr/"), (7, "nothing"), (8, None),
        (9, "http://bad.example.com/a"), (9, "http://bad.example.com/a"), (10, "http://xnet/de/"), (11, "x://h?a/b://c/de"), (12, "http://good.example.com#://"),
    ]
    frame = spark.createDataFrame([(i, u, "x", 1) for i, u in pages], "page_id long, url string, host string, salt int")
    outcomes = spark.createDataFrame([("bad.example.com", 1)] * 40 + [("good.example.com", 0)] * 60 + [("once.example.com", 1), ("other.org", 0), (None, 1), ("bad.example.com", None)], "host string, bad int")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame, outcomes).collect())
    assert got == [
        (1, "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "x.net", "/en/", "net/", "block"), (3, "net", "", None, "allow"), (4, "b.example.com", "/de/x", "example.com/de/", "block"), (5, "example.com", "/en/", None, "allow"),
        (6, "w.org", "/fr/", "org/fr/", "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "bad.example.com", "/a", None, "block"), (9, "bad.example.com", "/a", None, "block"), (10, "xnet", "/de/", None, "allow"), (11, "h", "", None, "allow"),
        (12, "good.example.com", "", None, "allow"),
    ]
    long = frame.limit(1).withColumn("url", F.lit("http://a.net/" + "x" * 200_000))
    assert [(r.host, len(r.path), r.verdict) for r in urls.judge(long, outcomes).collect()] == [("a.net", 200_001, "block")]
    means = {r.host: r for r in urls.reputation(outcomes).collect()}
    assert 0 < means["good.example.com"].mean < 0.2 < means["once.example.com"].mean < means["bad.example.com"].mean < 1
    assert urls.judge(frame.limit(0), outcomes.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(frame, outcomes.limit(0)).filter("rule IS NULL").collect()} == {"allow"}


def test_topk_equals_brute_force(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [float("nan")] * 8), (303, [None] * 8), (304, [float("inf")] + [0.0] * 7), (305, rows[0][1]), (306, [0.5]), (50, rows[7][1]), (None, rows[1][1]), (400, [1e17, 1.0]), (401, [-65536.0]), (450, [65535.5, -65535.5])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, shard string").repartition(3)
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    code = {}
    sound = [(i, np.pad(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int), (0, 8 - len(v)))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 2**55]
    for i, v in sound:
        code[i] = min(code.get(i, tuple(v)), tuple(v))
    want = []
    for q in sorted(i for i in code if i % 50 == 0):
        best = sorted((-int(np.dot(code[q], v)), i) for i, v in sound if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    few = frame.filter("vec_id IN (0, 1, 2)")
    assert topk.top_k(few, F.col("vec_id") % 50 == 0).count() == 2 and topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_of_vectors_of_any_size(spark):
    draw = random.Random(6)
    rows = [(50, [70000.0, 1.0]), (100, [3e16, -2e16, 1.0]), (150, [1.0, 1.0]), (200, [0.0]), (51, [3e16, -2e16, 1.5]), (52, [1e300, 0.0]), (53, [-3e16, 2e16]), (54, [0.0, 0.0])]
    rows += [(i, [draw.choice((-1, 1)) * 10.0 ** draw.randrange(17) for _ in range(3)]) for i in range(300, 420)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    code = {i: [math.floor(256 * x) for x in v] + [0] * (3 - len(v)) for i, v in rows if i != 52}
    want = []
    for q in sorted(i for i in code if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(code[q], v, strict=True)), i) for i, v in code.items() if i != q)[:5]
        want += [(q, k + 1, i, -s if -(2**63) < s <= 2**63 else None) for k, (s, i) in enumerate(best)]
    assert got == want and any(s is None for *_, s in got) and got[0][0] == 50


def test_secrets_of_a_long_text_take_time_in_proportion():
    text = " ".join(f"token={'ab' * 4}{k} key{k:06d}Zq7xK2mPw9RtLv{k}" for k in range(20_000))
    base = secrets.base_spans(text)
    began = time.process_time()
    found = secrets.random_spans(text, secrets._encoding(secrets.default_vocabulary()), base)
    assert len(base) == 20_000 and len(found) > 10_000 and time.process_time() - began < 8
    few = "token=abcdefgh1 Zq7xK2mPw9RtLv3NbY5c " * 3
    spans = secrets.random_spans(few, secrets._encoding(secrets.default_vocabulary()), secrets.base_spans(few))
    assert [few[s:e] for s, _, e in spans] == ["Zq7xK2mPw9RtLv3NbY5c"] * 3


def test_a_long_training_text_keeps_no_other_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_BYTES", 200_000)
    seen = []
    monkeypatch.setattr(toxicity, "trained", lambda texts, toxic, part: seen.append((texts, toxic.tolist())))
    rows = [(i, "bad words " * (15_000 if i % 7 == 0 else 10), i % 2) for i in range(60)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    toxicity.learn(docs, labels)
    texts, toxic = seen[0]
    assert toxic.count(0) > 15 and toxic.count(1) > 15 and max(map(len, texts)) == 200_000 // 32 and sum(map(len, texts)) <= 200_000


def test_toxicity_gradient():
    net, draw = toxicity.Network(1), np.random.default_rng(0)
    rows, numbers, label = draw.standard_normal((20, toxicity.INPUTS)), draw.integers(0, 20, (4, 6)), np.array([1, 0, 1, 0.0])
    grad, by_rows = net.gradient(rows, numbers, label)

    def loss():
        logit = net.pooled(net.states(net.projected(rows), numbers).astype(float))[0]
        return np.log1p(np.exp(-(2 * label - 1) * logit)).mean()

    for name in net.p:
        at = tuple(draw.integers(0, s) for s in net.p[name].shape)
        was = net.p[name][at]
        net.p[name][at] = was + 1e-2
        up = loss()
        net.p[name][at] = was - 1e-2
        down = loss()
        net.p[name][at] = was
        assert (up - down) / 2e-2 == pytest.approx(float(grad[name][at]), abs=2e-4)
    for at in [(int(numbers[0, 0]), 0), (int(numbers[2, 3]), toxicity.INPUTS - 1)]:
        rows[at] += 1e-2
        up = loss()
        rows[at] -= 2e-2
        down = loss()
        rows[at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(float(by_rows[at]), abs=2e-4)


def plain_logit(p, rows):
    """The network over one window, number by number: two recurrent layers, attention, one logit."""
    h = toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    states = [[0.0] * (2 * h) for _ in rows]
    for side, d in enumerate("fb"):
        state = [0.0] * h
        for t in range(len(rows)) if d == "f" else range(len(rows) - 1, -1, -1):
            g = [sum(rows[t][i] * p[f"x{d}"][i][j] for i in range(len(rows[t]))) + p[f"c{d}"][j] for j in range(3 * h)]
            s = [sum(state[i] * p[f"u{d}"][i][j] for i in range(h)) for j in range(3 * h)]
            z = [sigmoid(g[j] + s[j]) for j in range(h)]
            r = [sigmoid(g[h + j] + s[h + j]) for j in range(h)]
            new = [math.tanh(g[2 * h + j] + r[j] * s[2 * h + j]) for j in range(h)]
            state = [(1 - z[j]) * state[j] + z[j] * new[j] for j in range(h)]
            states[t][side * h : (side + 1) * h] = state
    seen = [[math.tanh(sum(x[i] * p["att"][i][a] for i in range(2 * h))) for a in range(toxicity.ATTENTION)] for x in states]
    weights = [math.exp(sum(v * p["ask"][a] for a, v in enumerate(row))) for row in seen]
    pool = [sum(w * x[i] for w, x in zip(weights, states, strict=True)) / sum(weights) for i in range(2 * h)]
    return sum(v * p["out"][i] for i, v in enumerate(pool)) + p["shift"][0]


def test_scores_equal_the_network_by_hand():
    draw = random.Random(3)
    texts = [prose(i, draw.randrange(3, 60), 80) + (" vile rotten" if i % 3 == 0 else "") for i in range(240)]
    label = np.array([int(i % 3 == 0) for i in range(240)])
    model = toxicity.trained(texts, label, np.arange(240) % 2 == 0)
    p = {k: v.tolist() for k, v in model.network.p.items()}
    assert np.abs(model.vectors.word).max() > 0 and np.abs(model.vectors.gram).max() > 0
    for text in ["", "vile", prose(500, 31), prose(501, 32, 80), prose(502, 75, 80) + " rotten " + prose(503, 40, 80)]:
        own = text.split()
        rows = []
        for w in own:
            codes = toxicity.hashed([w])
            grams = codes[3].tolist()
            letters = [sum(float(model.vectors.gram[b][k]) for b in grams) / len(grams) for k in range(toxicity.LETTERS)]
            rows.append([*map(float, model.evidence.inputs([w])[0]), *map(float, model.vectors.word[codes[0][0]]), *letters] if codes[1][0] else [0.0] * toxicity.INPUTS)
        rows = [[0.0] * toxicity.INPUTS] * (toxicity.WINDOW - len(rows)) + rows
        starts = [*range(0, len(rows) - toxicity.WINDOW, toxicity.WINDOW // 2), len(rows) - toxicity.WINDOW]
        logit = max(plain_logit(p, rows[s : s + toxicity.WINDOW]) for s in starts)
        assert model.scores([text])[0] == pytest.approx(1 / (1 + math.exp(model.shift - logit)), abs=1e-4)


def test_a_word_scores_the_same_whenever_it_is_met(monkeypatch):
    texts = [prose(i, 40, 60) + (" vile" if i % 2 else "") for i in range(120)]
    model = toxicity.trained(texts, np.arange(120) % 2, np.arange(120) % 3 == 0)
    want = model.scores(texts)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 10)
    words_ = toxicity.Words(model.evidence, model.vectors, model.network)
    again = np.concatenate([model.scores([t], words_) for t in texts])
    assert again == pytest.approx(want, abs=1e-5)


def test_the_training_sample_is_bounded_and_the_same_again(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "trained", lambda texts, toxic, part: seen.append((texts, toxic.tolist())))
    monkeypatch.setattr(toxicity, "MOST_BYTES", 4000)
    docs = spark.createDataFrame([(i, prose(i, 20)) for i in range(300)] + [(7, "b"), (7, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    for frame in (docs, docs.repartition(7)):
        toxicity.learn(frame, labels)
    assert seen[0] == seen[1] and 0 < sum(map(len, seen[0][0])) <= 4000 and set(seen[0][1]) == {0, 1}


def test_toxicity_learns_and_bears_hard_cases(spark):
    draw = random.Random(9)
    rows, labels = [], []
    for i in range(700):
        own = prose(i, draw.randrange(5, 150), 3000).split()
        if bad := i % 4 == 0:
            for _ in range(3):
                own[draw.randrange(len(own))] = draw.choice(["vile", "rotten"]) + draw.choice(["", "ly", "er", "ish"])
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    frame = spark.createDataFrame(labels + [(0, None), (5, 1), (99_999, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, toxic int")
    model = toxicity.learn(docs, frame)
    held = [(r.predicted, r.doc_id % 4 == 0) for r in toxicity.score(docs, model).filter("held_out").collect()]
    assert np.mean([p == y for p, y in held]) > 0.9
    hard = toxicity.score(hard_docs(spark), model).collect()
    assert len(hard) == len(hard_texts()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in hard)
    assert toxicity.score(no_docs(spark), model).count() == 0
    nothing = toxicity.score(hard_docs(spark), toxicity.learn(docs, frame.limit(0)))
    assert {r.predicted for r in nothing.collect()} == {0}


def test_windows_cover_whole_texts():
    words_ = toxicity.Words(toxicity.Evidence.counted(["a b"], np.array([1])), toxicity.Vectors())
    for n in (0, 1, 31, 32, 33, 48, 100):
        text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
        (got,) = words_.windows([text])
        assert set(got.ravel()) - {0} == {words_[w] for w in text.split()} and got.shape[1] == toxicity.WINDOW
