"""Substring dedup (operator 10): a compressed FM-index per shard, searched by streamed passages.

A window is ``window`` consecutive words of one document. A word is covered if a window over it has
the same word sequence as one that starts in a document of a smaller id.

1. Each window is known by its least anchor: of the hashes of its runs of ``anchor`` words, the
   smallest, frequent runs last. Equal windows have equal anchors. Consecutive windows of one anchor
   form a passage, known by 128 bits of its words' BLAKE2b. Anchors that one document alone has are
   dropped: their windows repeat nowhere else.
2. Of equal passages the one of the smallest document is cut out of its text. Anchors are packed into
   shards by the words of their passages, so a shard holds SHARD_WORDS and one more anchor at most.
3. A shard builds an FM-index of its passages: suffixes sorted by prefix doubling, their
   Burrows-Wheeler transform in a wavelet matrix of packed bits with counts by word, and for each
   suffix the smallest document that has the passage. The passages are streamed through it:
   backward search gives matching statistics towards smaller documents (how far left a match that
   ends here reaches while its interval still holds a smaller document), for all passages of the
   shard in step; matches of a window and more are reported as intervals.
4. An anchor whose passages alone overfill a shard (a run that very many texts hold in ever other
   surroundings) is split: its passages are cut into those of one second anchor, the next smallest hash of
   their windows, then by a third, until each fits. What these report is put together for the passage.
5. Intervals go back to the rows by the passage's digest; in a document that is not the first with
   this passage, all of it is covered. A row is known by its doc_id and a hash of its text, so rows that
   repeat an id with another text keep apart.

Word sequences are compared as words, in index and search; hashes only route, and passages are equal if
their 128 bits are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, gram_hashes, mixed, release, words_of
from .heavy import BlockCounter, Known, frequent

WINDOW, ANCHOR = 50, 20
#: Words of passages that a shard should hold, about.
SHARD_WORDS = 1_500_000
#: Suffixes of a block in the table of smallest documents.
RUN = 16
#: Windows that a passage has at most (a run that repeats itself can keep one anchor for long).
MOST_WINDOWS = 64
#: Shards' worth of words of a bucket, within which anchors are packed; anchors in turn that split a wide one.
BUCKET_SHARDS, LEVELS = 16, 8
_TOP = np.uint64(1 << 63)


#: The level of the largest power of two within a width of up to 2 * RUN, RUN at most.
_LEVEL = np.minimum(np.frexp(np.maximum(np.arange(2 * RUN + 1), 1).astype(float))[1] - 1, RUN.bit_length() - 1).astype(np.int64)
#: For each place in a packed word the bits before it.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Counts of a symbol before a position, over packed bits: log2(symbols) + some 50 % bits each."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.size, self.levels = bits, len(symbols), []
        now = symbols
        for b in range(bits - 1, -1, -1):
            one = (now >> b) & 1
            packed = np.packbits(np.append(one, np.zeros(-len(one) % 64 + 64, one.dtype)).astype(np.uint8), bitorder="little").view(np.uint64)
            before = np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))[:-1].astype(np.int32)
            self.levels.append((packed, before, int(len(one) - one.sum())))
            now = np.concatenate([now[one == 0], now[one == 1]])

    def count(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Where ``position`` falls on the last level, on the path of ``symbol``."""
        at = position
        for level, (packed, before, zeros) in enumerate(self.levels):
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & _BELOW[at & 63])
            at = np.where(symbol & (1 << (self.bits - 1 - level)), zeros + ones, at - ones)
        return at


class PassageIndex:
    """An FM-index of passages (arrays of symbols from 1 on), each with the smallest document that
    has it; 0 ends a passage."""

    def __init__(self, passages: list[np.ndarray], documents: np.ndarray) -> None:
        lengths = np.array([len(p) for p in passages], np.int64)
        text = np.concatenate([x for p in passages for x in (p, [0])]) if passages else np.zeros(1, np.int64)
        owner = np.repeat(np.arange(len(passages)), lengths + 1)
        order = self._suffixes(text)
        self.symbols = int(text.max()) + 1
        self.wavelet = WaveletMatrix(text[order - 1], max(1, int(self.symbols - 1).bit_length()))
        starts = np.append(0, np.cumsum(np.bincount(text, minlength=self.symbols)))[: self.symbols]
        # a symbol's rows less where its path starts on the wavelet's last level
        self.shift = starts - self.wavelet.count(np.arange(self.symbols), np.zeros(self.symbols, np.int64))
        # the smallest document, by rank among documents: of runs of 1, 2, ... RUN suffixes, and of runs
        # of 1, 2, 4, ... whole blocks of RUN
        self.documents, ranks = np.unique(documents, return_inverse=True) if passages else (np.zeros(1, np.int64), np.zeros(1, np.int64))
        own = ranks.astype(np.int32)[owner[order]] if passages else np.zeros(1, np.int32)
        self.size, self.within = len(text), self._minima(own, RUN.bit_length())
        blocks = np.minimum.reduceat(own, np.arange(0, self.size, RUN))
        self.count, self.over = len(blocks), self._minima(blocks, len(blocks).bit_length())

    @staticmethod
    def _minima(values: np.ndarray, levels: int) -> np.ndarray:
        """The minima of the runs of 2**level values that start at each, level by level."""
        out = [values]
        for level in range(1, levels):
            half, last = 1 << (level - 1), out[-1].copy()
            np.minimum(last[:-half], last[half:], out=last[:-half])
            out.append(last)
        return np.concatenate(out)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order of the text read round, by prefix doubling."""
        n, k = len(text), 1
        _, rank = np.unique(text, return_inverse=True)
        rank = rank.astype(np.int64)
        while True:
            both = rank * (int(rank.max()) + 1) + np.roll(rank, -k)
            order = np.argsort(both)
            ordered = both[order]
            steps = np.append(0, np.cumsum(ordered[1:] != ordered[:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = steps
            k *= 2
            if steps[-1] == n - 1 or k >= n:
                return order

    def extended(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of matches made longer by a symbol on the left."""
        both = np.concatenate([symbol, symbol])
        found = self.shift[both] + self.wavelet.count(both, np.concatenate([low, high]))
        return found[: len(low)], found[len(low) :]

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest document in each interval; the largest number where it is empty.

        Two overlapping runs cover an interval of up to 2 * RUN; a longer one is its first and last RUN
        and the whole blocks between.
        """
        width = high - low
        level = _LEVEL[np.clip(width, 0, 2 * RUN)]
        row = level * self.size
        least = np.minimum(self.within[row + np.minimum(low, self.size - 1)], self.within[row + np.maximum(high - (1 << level), 0)])
        wide = np.flatnonzero(width > 2 * RUN)
        if len(wide):
            first, last = -(-low[wide] // RUN), high[wide] // RUN
            level = np.frexp((last - first).astype(np.float64))[1].astype(np.int64) - 1
            row = level * self.count
            least[wide] = np.minimum(least[wide], np.minimum(self.over[row + first], self.over[row + last - (1 << level)]))
        return np.where(width > 0, self.documents[least], np.iinfo(np.int64).max)


def repeated_in_smaller(passages: list[np.ndarray], documents: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each passage the intervals (first word, last word + 1) covered by windows that also occur
    in a passage of a smaller document than its own (``documents`` holds the smallest of each).

    All passages run in step, one backward step of each a turn. A passage first tries a match from
    its last word to its first. If that fails, it looks for the next window with a match: a window's
    search that breaks off at word p rules out all windows up to p. From a window with a match, a
    binary search over its possible ends finds how far the match goes on (ends are monotone).
    """
    index = PassageIndex(passages, documents)
    lengths = np.array([len(p) for p in passages], np.int64)
    offset = np.append(0, np.cumsum(lengths))[:-1]
    text = np.concatenate(passages) if passages else np.empty(0, np.int64)
    found: list[list[tuple[int, int]]] = [[] for _ in passages]
    whole, seek, reach = 0, 1, 2
    n = len(passages)
    mode, first = np.zeros(n, np.int64), np.zeros(n, np.int64)
    end = lengths - 1  # last word of the match tried
    good, bad = np.zeros(n, np.int64), np.zeros(n, np.int64)  # ends known to match, known not to
    at = end.copy()
    low, high = np.zeros(n, np.int64), np.full(n, index.size)
    live = np.flatnonzero(lengths >= window)
    while len(live):
        symbol = text[offset[live] + at[live]]
        a, b = index.extended(low[live], high[live], symbol)
        low[live], high[live] = a, b
        still = index.smallest(a, b) < documents[live]
        over = live[~still | (at[live] == first[live])]
        matched = still[~still | (at[live] == first[live])]
        at[live] -= 1
        for i, ok in zip(over.tolist(), matched.tolist(), strict=True):
            stop = int(at[i]) + 1  # the word where it broke off, if it did
            size = int(lengths[i])
            if mode[i] == whole:
                if ok:
                    found[i].append((0, size))
                    first[i] = size
                else:
                    mode[i] = seek
                    if size == window:
                        first[i] = stop + 1
            elif mode[i] == seek:
                if not ok:
                    first[i] = stop + 1
                else:
                    mode[i], good[i], bad[i] = reach, end[i], size
            elif ok:
                good[i] = end[i]
            else:
                bad[i] = end[i]
            if mode[i] == reach and bad[i] - good[i] <= 1:
                found[i].append((int(first[i]), int(good[i]) + 1))
                # the windows from first on that end by good are settled; the next ends at good + 1
                first[i], mode[i] = good[i] + 2 - window, seek
            if mode[i] == reach:
                end[i] = (good[i] + bad[i]) // 2
            else:
                end[i] = first[i] + window - 1
            at[i], low[i], high[i] = end[i], 0, index.size
        if len(over):
            live = live[(end[live] < lengths[live]) & (first[live] + window <= lengths[live])]
    return found


def least_anchors(hashes: np.ndarray, often: Known, span: int) -> np.ndarray:
    """For each window of ``span`` runs the least hash, frequent runs after all others."""
    keyed = (hashes >> np.uint64(1)) | np.where(often.among(hashes), _TOP, np.uint64(0))
    width, now = 1, keyed
    while width * 2 <= span:
        now = np.minimum(now[:-width], now[width:])
        width *= 2
    rest = span - width
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def passages_of(words: list[bytes], often: Known, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, first words and windows of a document's passages."""
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = least_anchors(gram_hashes(words, anchor), often, window - anchor + 1)
    starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    counts = np.diff(np.append(starts, len(least)))
    if counts.max() > MOST_WINDOWS:
        pieces = -(-counts // MOST_WINDOWS)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, left = np.repeat(starts, pieces) + within * MOST_WINDOWS, np.repeat(counts, pieces) - within * MOST_WINDOWS
        counts = np.minimum(left, MOST_WINDOWS)
    return least[starts], starts, counts


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def _frequent_runs(docs: DataFrame, anchor: int, window: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = BlockCounter()

        def told(found):
            if found is not None and len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int64))], ["run", "n"])

        for batch in _slices(batches):
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                if len(words) >= window:
                    yield from told(counter.add(gram_hashes(words, anchor)))
        yield from told(counter.flush())

    return frequent(docs.select("text").mapInArrow(run, "run long, n long"))


def _anchored(docs: DataFrame, often: np.ndarray, window: int, anchor: int) -> DataFrame:
    """(anchor, digest, doc_id, twin, start, words) of every passage of ``docs`` (doc_id, twin, text)."""
    kinds = (("anchor", pa.int64()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("twin", pa.int64()), ("start", pa.int32()), ("words", pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(often)
        for batch in _slices(batches):
            parts, digests = [], []
            for doc, twin, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                a, s, c = passages_of(words, known, window, anchor)
                sizes = c + window - 1
                parts.append((a, np.full(len(a), doc, np.int64), np.full(len(a), twin, np.int64), s, sizes))
                digests += [_digest(b" ".join(words[lo : lo + n])) for lo, n in zip(s.tolist(), sizes.tolist(), strict=True)]
            a, d, t, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            columns = (a.view(np.int64), digests, d, t, s.astype(np.int32), n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(columns, kinds, strict=True)], [name for name, _ in kinds])

    return docs.select("doc_id", "twin", "text").mapInArrow(run, "anchor long, digest binary, doc_id long, twin long, start int, words int")


def _digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def _packed(passages: DataFrame, last: bool) -> DataFrame:
    """(anchor, bucket, shard, wide) of ``passages`` (anchor, words): anchors in turn fill the shards of a
    bucket; an anchor of more than SHARD_WORDS is wide, unless this is the ``last`` level."""
    sizes = cut(passages.groupBy("anchor").agg(F.sum("words").alias("size")), "sizes")
    total = sizes.agg(F.sum("size").alias("w")).first().w or 0
    each = max(1, min(SHARD_WORDS, total // int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(max(1, total // (BUCKET_SHARDS * each)))).cast("int")
    wide = F.lit(False) if last else F.col("size") > SHARD_WORDS
    before = F.sum(F.when(F.col("wide"), 0).otherwise(F.col("size"))).over(Window.partitionBy("bucket").orderBy("anchor").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("wide", wide).withColumn("bucket", bucket).select("anchor", "bucket", F.floor(F.coalesce(before, F.lit(0)) / each).cast("int").alias("shard"), "wide")


def _cut_out(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``passages`` (doc_id, twin, start and what else is to stay) with their words as ``body``."""
    kept = [c for c in passages.columns if c not in ("doc_id", "twin")]
    goes = passages.groupBy("doc_id", "twin").agg(F.collect_list(F.struct(*kept)).alias("parts"))
    wanted = docs.join(goes, ["doc_id", "twin"]).select("doc_id", "text", "parts")
    schema = ", ".join(["first long", *(f"{c} {passages.schema[c].dataType.simpleString()}" for c in kept), "body binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 32):
            parts, bodies = batch.column(2), []
            for text, own in zip(batch.column(1).to_pylist(), parts.to_pylist(), strict=True):
                words = words_of(text)
                bodies += [b" ".join(words[p["start"] : p["start"] + p["words"]]) for p in own]
            flat = parts.flatten()
            of = np.repeat(np.arange(batch.num_rows), parts.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(flat.field(c) for c in kept), pa.array(bodies, pa.binary())], ["first", *kept, "body"])

    return wanted.mapInArrow(run, schema)


def _reported(bodies: DataFrame, window: int) -> DataFrame:
    """(digest, first, spans) of (bucket, shard, digest, first, body): what is covered in the first document."""

    def search(group: dict[bytes, tuple[int, bytes]]) -> pa.RecordBatch:
        symbols: dict[bytes, int] = {}
        passages = [np.array([symbols.setdefault(w, len(symbols) + 1) for w in body.split(b" ")], np.int64) for _, body in group.values()]
        firsts = np.array([first for first, _ in group.values()], np.int64)
        spans = repeated_in_smaller(passages, firsts, window)
        flat = pa.array([[x for s in own for x in s] for own in spans], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(list(group), pa.binary()), pa.array(firsts), flat], ["digest", "first", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, {}
        for batch in _slices(batches, 2048):
            for bucket, shard, digest, first, body in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (bucket, shard) != at:
                    if group:
                        yield search(group)
                    at, group = (bucket, shard), {}
                group[digest] = first, body  # rows that are there twice give a passage twice
        if group:
            yield search(group)

    dealt = bodies.select("bucket", "shard", "digest", "first", "body").repartition("bucket", "shard").sortWithinPartitions("bucket", "shard")
    return dealt.mapInArrow(run, "digest binary, first long, spans array<int>")


def split_by_next(words: list[bytes], often: Known, window: int, anchor: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next anchors, first words and windows of the parts of a passage: of each window's distinct hashes
    the one after ``level`` smaller ones (the largest, if there are no more)."""
    hashes = gram_hashes(words, anchor)
    keyed = (hashes >> np.uint64(1)) | np.where(often.among(hashes), _TOP, np.uint64(0))
    ordered = np.sort(np.lib.stride_tricks.sliding_window_view(keyed, window - anchor + 1), axis=1)
    rank = np.cumsum(np.append(np.zeros((len(ordered), 1), bool), ordered[:, 1:] != ordered[:, :-1], axis=1), axis=1)
    at = np.argmax(rank >= np.minimum(level, rank[:, -1:]), axis=1)
    following = ordered[np.arange(len(ordered)), at]
    starts = np.flatnonzero(np.append(True, following[1:] != following[:-1]))
    return following[starts], starts, np.diff(np.append(starts, len(following)))


def _split(bodies: DataFrame, often: np.ndarray, window: int, anchor: int, level: int) -> DataFrame:
    """The parts (anchor, digest, words, body) of passages, with the passage (of, of_first) and their place."""
    names = ["of", "of_first", "offset", "anchor", "digest", "words", "body"]
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(often)
        for batch in _slices(batches, 256):
            rows = []
            for of, first, before, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = body.split(b" ")
                following, starts, counts = split_by_next(words, known, window, anchor, level)
                keys = mixed(following * np.uint64(0x9E3779B97F4A7C15) + np.uint64(before % 2**64)).view(np.int64)
                for key, lo, count in zip(keys.tolist(), starts.tolist(), counts.tolist(), strict=True):
                    part = b" ".join(words[lo : lo + count + window - 1])
                    rows.append((of, first, lo, key, _digest(part), count + window - 1, part))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    parts = bodies.select("digest", "first", "anchor", "body")
    return parts.mapInArrow(run, "of binary, of_first long, offset int, anchor long, digest binary, words int, body binary")


def _told(bodies: DataFrame, often: np.ndarray, window: int, anchor: int, level: int = 1) -> DataFrame:
    """(digest, first, spans) of the written passages ``bodies``, which go at the end."""
    found = [cut(_reported(bodies.filter("NOT wide"), window), "told")]
    wide = bodies.filter("wide")
    if not wide.isEmpty():
        parts = cut(_split(wide, often, window, anchor, level), "parts")
        distinct = parts.groupBy("anchor", "digest", "words").agg(F.min("of_first").alias("first"), F.first("body").alias("body"))
        below = _told(cut(distinct.join(_packed(distinct, level == LEVELS), "anchor"), "bodies"), often, window, anchor, level + 1)
        spans = F.when(F.col("of_first") > F.col("first"), F.array(F.lit(0), F.col("words"))).otherwise(F.col("spans"))
        moved = parts.join(below, "digest").select("of", "of_first", F.transform(spans, lambda x: x + F.col("offset")).alias("spans"))
        whole = moved.groupBy("of", "of_first").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        found.append(cut(whole.select(F.col("of").alias("digest"), F.col("of_first").alias("first"), "spans"), "told"))
        release(parts)
    release(bodies)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _by_text(docs: DataFrame) -> DataFrame:
    """(doc_id, twin, text): twin is a hash of the text, so rows that repeat an id are told apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin"), "text")


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, twin (:func:`_by_text`) and spans (array of first and last + 1 word numbers, in turn) of rows
    with covered words, as a written table. Rows with a null doc_id take no part."""
    own = _by_text(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    often = _frequent_runs(own, anchor, window)
    found = _anchored(own, often, window, anchor)
    # the top bit marks an anchor that is frequent: it surely repeats
    light = Window.partitionBy("anchor")
    shared = found.filter("anchor >= 0").withColumn("a", F.min("doc_id").over(light)).withColumn("b", F.max("doc_id").over(light)).filter("a < b").drop("a", "b")
    kept = cut(shared.union(found.filter("anchor < 0")), "passages")
    distinct = kept.groupBy("anchor", "digest", "words").agg(F.min(F.struct("doc_id", "twin", "start")).alias("at"))
    distinct = cut(distinct.select("anchor", "digest", "words", "at.*"), "distinct")
    bodies = cut(_cut_out(own, distinct.join(_packed(distinct, False), "anchor")), "bodies")
    release(distinct)
    told = _told(bodies, often, window, anchor)
    back = kept.select("doc_id", "twin", "start", "words", "digest").join(told, "digest")
    spans = F.when(F.col("doc_id") > F.col("first"), F.array(F.lit(0), F.col("words"))).otherwise(F.col("spans"))
    moved = back.withColumn("spans", spans).filter(F.size("spans") > 0).select("doc_id", "twin", F.transform("spans", lambda x: x + F.col("start")).alias("spans"))
    out = cut(moved.groupBy("doc_id", "twin").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    release(kept)
    return out


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of ``docs`` (doc_id, text; others are
    ignored), and the kept words joined by one blank with ``text``.

    Null and wordless texts have 0 words. Texts shorter than a window keep all. A row with a null
    doc_id keeps all and covers nothing; rows that repeat a doc_id do not cover one another, as
    only a smaller id covers, and each has its own text's spans. An empty table gives no rows.
    """
    spans = repeated_spans(docs, window=window, anchor=anchor)
    joined = _by_text(docs).join(spans, ["doc_id", "twin"], "left").select("doc_id", "text", "spans")
    kinds = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + ([("kept", pa.string())] if text else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for whole, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(whole)
                if spans:
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, spans[::2], 1)
                    np.add.at(step, spans[1::2], -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(step)[:-1] == 0)]
                else:
                    left = words
                body = b" ".join(left)
                row = (len(words), len(words) - len(left), hashlib.sha256(body).hexdigest())
                rows.append((*row, body.decode()) if text else row)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds))], ["doc_id", *(n for n, _ in kinds)])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if text else ""))
