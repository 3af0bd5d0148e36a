"""Secret scans (operator 4): patterns, and a token-efficiency test for what has no pattern.

A random string falls apart into short tokens under a vocabulary learned from prose and code, so few
characters a token expose it. All runs of token characters of some length, and their parts between
/ + - _ =, are measured with a tiktoken vocabulary, but for known digests (hexadecimal of the usual
lengths), UUIDs, dates, plain numbers, one short piece repeated and identifiers whose parts are words that tokenise well.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the contract: kinds in their order, patterns, least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a greedy run of 24 and more starts where its whole run starts
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
HINTS = ("password", "passwd", "secret", "token", "api")

#: Fixed values of the method.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
KNOWN = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/=_-]+|(.{1,4}?)\1{3,}.{0,3}")  # the last: one short piece again and again
PART = re.compile(r"[A-Za-z0-9]+")
WORDLIKE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Characters a token, at most, of what counts as random. Under the vocabulary of PATTERN_FILE, random strings
#: of 16 characters and more have 1.3 (letters and digits) to 1.7 (letters of one case), 95 % of them at
#: most 2.0; invented words of other languages begin at 2.0, so what looks like a word must be below that.
LEAST, SHORT, MOST_PER_TOKEN, MOST_PER_TOKEN_WORD = 16, 3, 2.2, 1.9

PATTERN_FILE = "byte_bpe_50k.tiktoken"


@lru_cache(2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(PATTERN_FILE)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the three patterns, each leftmost and non-overlapping."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, encoding, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs, or neighbouring parts of a run, of few characters a token, but for known forms and what a
    base span already covers. Every run is measured whole; if that says nothing, what remains of it
    between the parts that are words, numbers or digests."""
    few = lambda piece: len(piece) <= (MOST_PER_TOKEN_WORD if WORDLIKE.fullmatch(piece) else MOST_PER_TOKEN) * len(encoding.encode_ordinary(piece))
    starts, ends = [], []  # what is taken, as disjoint stretches in order
    for s, _, e in taken:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def free(lo: int, hi: int) -> bool:
        at = bisect_left(starts, hi) - 1
        return at < 0 or ends[at] <= lo

    found = []
    for m in RUN.finditer(text):
        run, at = m[0], m.start()
        if DIGEST.fullmatch(run) or KNOWN.fullmatch(run):
            continue
        whole = few(run)
        if not whole and len(run) <= LEAST:
            continue
        parts = [(p.start(), p.end(), p[0]) for p in PART.finditer(run)]
        if whole and not all(len(p) <= 8 if p.isdigit() else p.isalpha() and (len(p) <= SHORT or not few(p)) for _, _, p in parts):
            if free(at, m.end()):
                found.append((at, 3, m.end()))
                continue
        odd: list[tuple[int, int]] = []
        for lo, hi, p in [*parts, (len(run), len(run), "")]:
            if p and len(p) <= SHORT:
                continue  # says nothing: inside of what is odd on both sides it belongs to that
            if p and not p.isdigit() and not DIGEST.fullmatch(p) and few(p):
                odd.append((lo, hi))
                continue
            if odd:
                lo, hi = odd[0][0], odd[-1][1]
                if hi - lo >= LEAST and not KNOWN.fullmatch(run[lo:hi]) and few(run[lo:hi]) and free(at + lo, at + hi):
                    found.append((at + lo, 3, at + hi))
            odd = []
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Secrets in each row of ``docs`` (doc_id, text; others are ignored): doc_id, n_assign,
    n_access, n_hex, base_sha256, spans (base and random ones as kind:start:end in code points, end
    exclusive, by start and then kind) and n_random.

    A null text is the empty one: no spans. Repeated rows give repeated rows, an empty table none; a null
    doc_id is returned as it is. Texts of any length are scanned whole, one at a time.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = []
                for text in batch.column(1).to_pylist():
                    base = base_spans(text or "")
                    more = random_spans(text or "", encoding, base)
                    kinds = [k for _, k, _ in base]
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)), len(more)))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
