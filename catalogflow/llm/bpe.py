"""BPE encoding and decoding (operator 8) by forced boundaries.

Every merge makes a vocabulary token, so two neighbouring bytes that stand side by side inside no
token can never be merged over: between them is a certain cut. The pieces between certain cuts are
encoded on their own and their ids put one after another, which gives the ids of the whole.

Two kinds of cut are used. Between a byte that ends a character other than white space and a blank,
no token of the vocabulary reaches over (this is checked when the vocabulary is read), nor does the
pre-tokenizer: every match of its pattern that holds a blank begins with white space. So texts fall
into fragments at such blanks, and a fragment's ids are kept for the next time it comes. A new
fragment is pre-tokenized and cut at every other forced byte pair; the pieces then go through the
merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed values of the public vocabulary: its pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fragments whose ids are kept, in each of two generations; keys and pieces over LONG count as long.
KEPT, LONG = 300_000, 64


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for
    themselves, the others for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ForcedBoundaryBPE:
    """A byte-level BPE read from a tokenizers JSON file."""

    def __init__(self, spec: dict) -> None:
        model, letters = spec["model"], byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        merges = [(raw(a), raw(b)) for a, b in merges]
        self.rank = {self.ids[a] << 32 | self.ids[b]: k for k, (a, b) in enumerate(merges)}
        self.made, self.no_rank = [self.ids[a + b] for a, b in merges], len(merges)
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.joined = {pair for t in self.ids for pair in zip(t, t[1:])}  # noqa: B905
        self.blank_is_cut = all((b, 32) not in self.joined for b in range(256) if not (b in b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.near_blank = regex.compile(r"\s ")
        self.fragments = _Store(self._fragment)

    def cuts(self, word: bytes) -> list[bytes]:
        """``word`` cut at every byte pair that occurs inside no token."""
        if self.joined.issuperset(zip(word, word[1:])):  # noqa: B905
            return [word]
        at = [i for i in range(1, len(word)) if (word[i - 1], word[i]) not in self.joined]
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)], strict=True)]

    def _piece(self, piece: bytes) -> list[int]:
        """The merges over one piece: always the first-ranked pair, leftmost first."""
        parts = [self.byte_id[b] for b in piece]
        if len(parts) > LONG:
            return self._long_piece(parts)
        rank, none = self.rank, self.no_rank
        ranks = [rank.get(a << 32 | b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] << 32 | parts[i], none)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] << 32 | parts[i + 1], none)
        return parts

    def _long_piece(self, parts: list[int]) -> list[int]:
        """The same by a heap of pairs over a linked list: near-linear for very long pieces."""
        end, rank = len(parts), self.rank
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(end - 1) if (r := rank.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= end or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.made[r], -1, after[j]
            if after[i] < end:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < end and (q := rank.get(parts[x] << 32 | parts[y])) is not None:
                    heapq.heappush(heap, (q, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def _fragment(self, fragment: str) -> bytes:
        return array("I", [i for word in self.pattern.findall(fragment) for p in self.cuts(word.encode("utf-8")) for i in self._piece(p)]).tobytes()

    def _plain(self, text: str) -> bytes:
        store = self.fragments
        if not self.blank_is_cut:
            return store.value(text)
        first, *rest = text.split(" ")
        if not self.near_blank.search(text) and not text.startswith(" "):  # each blank follows a visible character
            return b"".join([store[first], *[store[" " + x] for x in rest]])
        out, held = [], first
        for x in rest:
            if held and not held[-1].isspace():
                out.append(store[held])
                held = " " + x
            else:
                held += " " + x
        return b"".join([*out, store[held]])

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self._plain(x) for x in self.split_special.split(text))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


class _Store(dict):
    """Computes what it lacks and keeps the results of two generations; long keys are not kept."""

    def __init__(self, make) -> None:
        self.value, self.old = make, {}

    def __missing__(self, key):
        made = self.old.get(key)
        if made is None:
            made = self.value(key)
        if len(key) <= LONG:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[key] = made
        return made


@lru_cache(2)
def _loaded(path: str) -> ForcedBoundaryBPE:
    with open(path, encoding="utf-8") as f:
        return ForcedBoundaryBPE(json.load(f))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, vocabulary: str | None = None, *, ids: bool = False) -> DataFrame:
    """Encode and decode the text of each row of ``docs`` (doc_id, text; others are ignored).

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the ids and the decoded
    text. A null text is the empty one: 0 tokens. Repeated rows give repeated rows, an empty table none; a
    null doc_id is returned as it is; texts of any length are encoded whole. The vocabulary is a file that
    each executor can read at the same path.
    """
    path = vocabulary or default_vocabulary()
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.binary()), ("decoded", pa.string())] if ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for text in batch.column(1).to_pylist():
                    found = bpe.encode(text or "")
                    back = bpe.decode(found)
                    row = (len(found) // 4, hashlib.sha256(found).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest())
                    rows.append((*row, found, back) if ids else row)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields))], ["doc_id", *(n for n, _ in fields)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
