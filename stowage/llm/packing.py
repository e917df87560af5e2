"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids, end with id 1, and are cut into pieces of at most 4096 tokens. The histogram
of piece lengths has at most 4096 bars whatever the corpus holds, so the program is solved on the driver:
its variables are configurations (multisets of lengths that fit into one sequence), its constraints the
bars. Multiplicative weights keep prices that fall as the pieces are covered, bar by bar (a bar is a run of
lengths that holds one of BARS equal parts of the tokens); a knapsack by dynamic programming over exact
lengths finds configurations of the highest price, and the solution takes a step along each. Steps are
whole numbers of sequences, so the solution is rounded as it grows. When all but REST of the pieces are
covered, the rest is packed best-fit, the longest first, into what the configurations leave and into new
sequences. Prices, divided by what the best filling is worth, solve the dual program: ``plan`` returns the
best such lower bound on the number of sequences, and the share of the pieces that configurations place.

Placing the pieces is distributed: a piece's rank in its length (hash buckets plus offsets, no task per
length) falls into one interval of the plan, which names its sequence; offsets are running sums inside
sequences of 4096 tokens at most.

Defined cases: null and empty texts are one piece, of the end token alone. Longer texts are tokenized
word by word through a cache, whole texts never at once. Repeated rows are packed each. Ties (same id,
piece and tokens) are placed in any order, as they are the same. Other columns are not touched. An empty
table gives an empty table.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm import textvec
from stowage.llm.common import Scratch, bucket_count, column, ranked, table
from stowage.llm.textvec import FOLD, buffers, slices, word_hashes

for _module in (textvec, sys.modules[__name__]):  # workers then need no copy of the package
    cloudpickle.register_pickle_by_value(_module)

CAPACITY = 4096
END = 1
#: Parts of the tokens that share a price; a step covers at most so much of a length; how fast prices fall; prices are whole numbers of 1 / PRICE_UNIT.
BARS, STEP, SHARPNESS, PRICE_UNIT = 32, 0.5, 4.0, 1 << 16
#: The lower bound also tries prices of 1 / k for every 1 / (k + 1) of a sequence, for k up to so many.
STEPPED = 6
#: Lengths that are priced at a time, fillings that are taken of them, and the share of the pieces that is left to best fit.
SUBSET, FIRSTS, NEAR, REST = 96, 32, 0.002, 0.05
#: Words whose ids a worker remembers; beyond, it starts anew.
CACHE_WORDS, CACHE_IDS = 1 << 19, 1 << 24
#: Words that are looked up at a time.
STEP_WORDS = 1 << 20


class WordTokens:
    """Token ids of texts, put together from those of words, which are remembered.

    This vocabulary's rules lower the case first, and never join across white space, nor letters or digits
    with marks; so a text is cut there, and ``The,`` is the remembered ``the`` and ``,``. Marks behind an
    apostrophe, and whatever touches non-ASCII bytes, stay in one piece.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """This process's instance: a worker keeps its words from task to task."""
        import tokenizers

        held = tokenizers.__dict__.setdefault("_stowage_words", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def clear(self):
        self.place: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def learn(self, hashes: list[int], texts: list[str]) -> None:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        n, k = len(self.place), len(got)
        flat = np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum()))
        while n + k > len(self.start):
            self.start, self.count = np.append(self.start, np.zeros_like(self.start)), np.append(self.count, np.zeros_like(self.count))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.count[n : n + k] = sizes
        self.used += len(flat)
        self.place.update(zip(hashes, range(n, n + k)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the ids per row (without end tokens)."""
        raw = data.tobytes()
        # the names of special tokens are told by case, so a text that may hold one keeps its case
        h, counts, first, last = word_hashes(data, offsets, fold=None if b"<|" in raw else FOLD, units=b"<|" not in raw)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(h), STEP_WORDS):
            part = self._ids_of(h[i : i + STEP_WORDS], raw, first[i : i + STEP_WORDS], last[i : i + STEP_WORDS])
            ids.append(part[0])
            sizes.append(part[1])
        done = np.cumsum(np.concatenate(sizes))
        row_end = np.append(0, done)[np.cumsum(counts)]
        return np.concatenate(ids), np.diff(np.append(0, row_end))

    def _ids_of(self, h: np.ndarray, raw: bytes, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has."""
        seen, at, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.place) + len(seen) > CACHE_WORDS or self.used > CACHE_IDS:
            self.clear()
        keys = seen.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.place]
        if new:
            self.learn([keys[i] for i in new], [raw[first[j] : last[j]].decode("utf-8", "replace") for j in at[new]])
        where = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))[back]
        size = self.count[where]
        done = np.cumsum(size)
        return self.ids[np.repeat(self.start[where] - (done - size), size) + np.arange(int(done[-1]) if len(done) else 0)], size


def _pieces(path: str, capacity: int):
    def run(batches):
        words = WordTokens.of(path)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            row, piece, start, length, crc = [], [], [], [], []
            for a, b in slices(offsets):
                ids, sizes = words.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.cumsum(sizes)
                whole = np.insert(ids, ends, END).astype("<u4")  # an end token behind every row
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                raw = memoryview(whole.tobytes())
                for i, (e, n) in enumerate(zip(ends.tolist(), sizes.tolist())):
                    for p, s in enumerate(range(0, n, capacity)):
                        k = min(capacity, n - s)
                        row.append(a + i)
                        piece.append(p)
                        start.append(s)
                        length.append(k)
                        crc.append(zlib.crc32(raw[4 * (e - n + s) : 4 * (e - n + s + k)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces; ``tokenizer`` is a path every worker can open."""
    named = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(_pieces(tokenizer, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _rows(sizes: np.ndarray, prices: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[int, int, int]]:
    """(place, copies, 0 or 1: any number) of the rows of a knapsack in which no size is taken oftener than it is there."""
    rows = []
    for i, (s, n) in enumerate(zip(sizes.tolist(), counts.tolist())):
        fits = room // s
        if n >= fits:
            rows.append((i, 1, int(fits > 1)))
            continue
        k = 1
        while n > 0:
            rows.append((i, min(k, n), 0))
            n, k = n - k, 2 * k
    return rows


class Knapsack:
    """Dynamic programming over exact room: what fits best at prices (whole numbers), for every room up to ``room``."""

    def __init__(self, sizes: np.ndarray, prices: np.ndarray, counts: np.ndarray, room: int):
        self.sizes, self.rows = sizes, _rows(sizes, prices, counts, room)
        self.best = np.zeros((len(self.rows) + 1, room + 1), np.int64)
        for r, (i, copies, many) in enumerate(self.rows):
            s, v, old, new = int(sizes[i]) * copies, int(prices[i]) * copies, self.best[r], self.best[r + 1]
            if many:  # the best number of copies, for all rooms of the same rest at once
                turns = -(-(room + 1) // s)
                wide = np.full(turns * s, -(1 << 62), np.int64)
                wide[: room + 1] = old
                gain = v * np.arange(turns)[:, None]
                wide = np.maximum.accumulate(wide.reshape(turns, s) - gain, axis=0) + gain
                new[:] = wide.reshape(-1)[: room + 1]
            else:
                new[:] = old
                if s <= room:
                    np.maximum(old[s:], old[: room + 1 - s] + v, out=new[s:])

    def take(self, room: int) -> dict[int, int]:
        """Place to copies of the best filling of ``room``."""
        out: dict[int, int] = {}
        r = len(self.rows)
        while r:
            column = self.best[: r + 1, room]
            r = int((column == column[-1]).argmax())
            if r:
                i, copies, many = self.rows[r - 1]
                out[i] = out.get(i, 0) + copies
                room -= int(self.sizes[i]) * copies
                r -= 1 - many
        return out


def dual_bound(sizes: np.ndarray, counts: np.ndarray, prices: np.ndarray, room: int) -> float:
    """The worth of all pieces in best fillings of ``room``: fewer sequences can't hold them, whatever the prices are."""
    price = np.zeros(room, np.int64)
    price[sizes - 1] = prices
    best = np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        best[c] = max(best[c - 1], (price[:c] + best[c - 1 :: -1]).max())
    return float((prices * counts).sum()) / float(best[room]) if best[room] else 0.0


def configurations(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray, float]:
    """Configurations (size to copies) with the whole number of sequences that use each, what they leave of ``counts``, and a lower bound.

    Multiplicative weights for the covering program: the price of a length is its size times a weight that falls
    exponentially with the share of its bar that is covered, so no bar runs ahead of the others for long. A step along a configuration
    covers at most the share STEP of any length and is a whole number of sequences, so nothing is lost to rounding. Pricing
    is partial: the program looks at SUBSET lengths, half of them those that are covered least and half taking
    turns, and takes fillings, around FIRSTS different lengths, whose worth is within NEAR of the best. At some rounds all lengths are priced: prices divided by the best filling's are
    a solution of the dual program, so their sum over all pieces is a lower bound.
    """
    left, found, done, turn = counts.copy(), [], 0, 0
    whole, next_bound = int(counts.sum()), 0.0
    bound = max(dual_bound(sizes, counts, (k + 1) * sizes // (room + 1), room) for k in range(1, STEPPED + 1))
    tokens = np.cumsum(counts * sizes)
    bar = np.unique((tokens - 1) * BARS // tokens[-1], return_inverse=True)[1]
    mixed = np.argsort((sizes * 0x9E3779B1) % (1 << 32))  # neighbours apart, where weights tie
    place = np.empty(len(sizes), np.int64)
    place[mixed] = np.arange(len(sizes))
    while left.sum() > REST * whole:
        share = 1 - left / counts
        open_ = np.flatnonzero(left)
        covered = 1 - np.bincount(bar, left * sizes) / np.bincount(bar, counts * sizes)
        weight = np.exp(-SHARPNESS * (covered - covered.min()))[bar]
        price = np.maximum(1, (weight * sizes * PRICE_UNIT).astype(np.int64))
        if covered.min() >= next_bound:
            bound, next_bound = max(bound, dual_bound(sizes, counts, price, room)), next_bound + 0.2
        order = open_[np.lexsort((place[open_], np.floor(share[open_] / (STEP / 2))))]
        late, others = order[: SUBSET // 2], order[SUBSET // 2 :]
        others = others[np.argsort(place[others])]
        some = np.concatenate([late, np.roll(others, -turn * (SUBSET // 2))[: SUBSET // 2]])
        some = np.sort(some)[::-1]
        pricing = Knapsack(sizes[some], price[some], left[some], room)
        before, best = done, int(pricing.best[-1, room])
        value = pricing.best[-1, room - sizes[some]] + price[some]
        firsts = np.flatnonzero(value >= (1 - NEAR) * best)
        for first in firsts[:: -(-len(firsts) // FIRSTS)].tolist():
            take = pricing.take(room - int(sizes[some[first]]))
            take[first] = take.get(first, 0) + 1
            at, copies = some[list(take)], np.array(list(take.values()))
            x = min(int((left[at] // copies).min()), max(1, int(STEP * (counts[at] / copies).min())))
            if x:
                left[at] -= copies * x
                found.append((dict(zip(sizes[at].tolist(), copies.tolist())), x))
                done += x
        turn += 1
        if done == before:
            break
    return found, left, bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[pd.DataFrame, int, float, float]:
    """Intervals (length, lo, hi, sequence0, slot): rank r in [lo, hi) of a length goes to sequence0 + r - lo.

    Also the number of sequences, a lower bound of it from the dual program, and the share of the pieces that
    configurations place. A pure function of the histogram.
    """
    left = {k: n for k, n in sorted(histogram.items()) if n > 0}
    used, sequences, out = dict.fromkeys(left, 0), 0, []

    def give(length: int, n: int, seq0: int) -> None:
        out.append((length, used[length], used[length] + n, seq0))
        used[length] += n
        left[length] -= n

    total, bound = sum(left.values()), 0.0
    if full := left.get(capacity, 0):
        give(capacity, full, 0)
        sequences = full
    sizes = np.array([k for k in left if k < capacity], np.int64)
    if len(sizes):
        found, _, bound = configurations(sizes, np.array([left[k] for k in sizes.tolist()], np.int64), capacity)
        for take, x in found:
            for k, copies in take.items():
                for _ in range(copies):
                    give(k, x, sequences)
            sequences += x
    by_program = 1 - sum(left.values()) / total if total else 1.0
    # room left: as much as all sequences of a run of equal fillings have
    cuts = sorted({s for _, lo, hi, s in out} | {s + hi - lo for _, lo, hi, s in out})
    change = np.zeros(len(cuts) + 1, np.int64)
    where = {c: i for i, c in enumerate(cuts)}
    for k, lo, hi, s in out:
        change[where[s]] += k
        change[where[s + hi - lo]] -= k
    filled = np.cumsum(change)
    spans = [(capacity - int(filled[i]), cuts[i], cuts[i + 1]) for i in range(len(cuts) - 1) if filled[i] < capacity]
    rest = {k: n for k, n in left.items() if n > 0}
    out, sequences = _fill(rest, spans, sequences, out, used, capacity)
    frame = pd.DataFrame(out, columns=["length", "lo", "hi", "sequence0"])
    frame["slot"] = np.arange(len(frame))
    return frame, sequences, full + bound, by_program


def _fill(rest, spans, sequences, out, used, capacity):
    """Best fit of what is left into spans of equal sequences (room, from, to), then into new sequences.

    A step places one length into as many sequences of one span as there are pieces, so it costs by spans
    and lengths, not by pieces.
    """
    import bisect

    spans = sorted(spans)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            i = bisect.bisect_left(spans, (length, -1, -1))
            if i == len(spans):
                per = capacity // length
                bins = max(1, n // per)
                bisect.insort(spans, (capacity, sequences, sequences + bins))
                sequences += bins
                continue
            room, a, b = spans.pop(i)
            k = min(n, b - a)
            out.append((length, used[length], used[length] + k, a))
            used[length] += k
            n -= k
            if room - length:
                bisect.insort(spans, (room - length, a, a + k))
            if a + k < b:
                bisect.insort(spans, (room, a + k, b))
    return out, sequences


def pack(cut: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """Add sequence_id and offset to pieces (``pieces``' columns). The result reads ``scratch``."""
    spark = cut.sparkSession
    s = scratch or Scratch(spark, "packing")
    cut = s.keep(cut, "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    frame, _, _, _ = plan(histogram, capacity)
    ranks = ranked(cut, ["length"], [F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], bucket_count(sum(histogram.values())), s)
    frame = frame.sort_values(["length", "lo"])
    length0, lo, seq0, slot = (frame[c].to_numpy(np.int64) for c in ("length", "lo", "sequence0", "slot"))
    # an interval is found by (length, rank) in one sorted list; ranks of a length stay below 2**48
    held = spark.sparkContext.broadcast((length0 * (1 << 48) + lo, lo, seq0, slot))

    names = list(cut.columns)

    def place(batches):
        keys, lo, seq0, slot = held.value
        for batch in batches:
            rank, length = (batch.column(c).to_numpy() for c in ("rank", "length"))
            i = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            more = [pa.array(seq0[i] + rank - lo[i]), pa.array(slot[i])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *more], names=[*names, "sequence_id", "slot"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    placed = ranks.select(*names, "rank").mapInArrow(place, f"{schema}, sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("slot")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: one row per piece of ``documents``."""
    return pack(pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()))
