"""Near duplicates by improved consistent weighted sampling of TF-IDF shingles.

A document is a weighted set of its five-word shingles (a shorter one is a single shingle). The weight of
a shingle is its count in the document times its inverse document frequency. Almost every five-word
shingle is in one document only, so its frequency is taken from its words: the mean over its five words
of ``1 + ln((1 + N) / (1 + df)) / ln(1 + N)``, with df counted over all documents in 2**18 hashed buckets
(a table of 1 MB, whatever the corpus, so it may be broadcast).

Sampling is improved consistent weighted sampling, bin-wise: four independent samplings, each of which
deals the shingles over 16 bins by hash and keeps the least element of every bin; an empty bin takes that
of the next full one. Bin b of all four samplings is band b, so documents of similarity s meet in a band
with probability about s**4, and in one of 16 bands with 1 - (1 - s**4)**16 (0.9998 at 0.8).

Equal texts (up to white space) are one node. In each bucket of a band all nodes are compared with one
hub of the bucket, the node that shares most bucket rows in all its bands (the original of many copies does);
links are confirmed by the exact weighted Jaccard similarity of both whole texts, and connected. Where a bucket
then holds several components, small buckets compare all pairs that lie in different ones, and large ones take
a second hub among those that the first one left. So a bucket of m near copies costs about m comparisons, and
no pair is listed twice.

What large buckets still hold in different components is settled by exact prefix filtering. The shingles of
a text are put in one order, rare ones first. Let r(x) be the weight of a text from its shingle x on, and W its
whole weight. Of two texts of similarity t, the rarest common shingle x has r(x) >= t W in both, r(x) >= 2t / (1 + t) W
in the lighter one, and r(x) >= t / (1 + t) (W + W') in both. So pairs that meet in no such shingle are below t, and
all others are compared.

Defined cases: a text without words (null, empty, blank) is alone in its class. Repeated rows and equal
texts are in one class. Classes are named by their smallest doc_id (null last), which is the one that
stays. Other columns are not touched. An empty table gives an empty table.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm import textvec
from stowage.llm.common import SPACES, Scratch, broadcast_if_small, column, fresh, rows_of, sum_of, table
from stowage.llm.textvec import U, buffers, mix, runs, slices, windows, word_hashes

for _module in (textvec, sys.modules[__name__]):  # workers then need no copy of the package
    cloudpickle.register_pickle_by_value(_module)

SHINGLE = 5
THRESHOLD = 0.8
SAMPLINGS, BANDS = 4, 16
DF_BITS = 18
#: Buckets of up to so many nodes compare all pairs of different components in the second round.
SMALL_BUCKET = 16
#: Counters of shingles that put them in order of rarity, and slack for sums of floats in another order.
ORDER_BITS, SLACK = 18, 1 - 1e-6


def _frequencies(batches):
    """Documents per hashed word, added up over a task; row -1 holds the number of documents."""
    df, n = np.zeros(1 << DF_BITS, np.int64), 0
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in slices(offsets):
            h, counts, _, _ = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            key = np.unique((runs(counts).astype(np.int64) << DF_BITS) | (h >> U(64 - DF_BITS)).astype(np.int64))
            df += np.bincount(key & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
        n += len(batch)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "n"])


def idf_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The inverse document frequency of each of the 2**18 hashed words, from all documents."""
    got = docs.select(column(text).alias("text")).mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 2**18 + 1 rows at most
    bucket, count = (got.column(c).to_numpy() for c in ("bucket", "n"))
    df = np.zeros(1 << DF_BITS)
    df[bucket[bucket >= 0]] = count[bucket >= 0]
    n = int(count[bucket < 0].sum())
    return (1 + np.log((1 + n) / (1 + df)) / np.log(max(2, 1 + n))).astype(np.float32)


def weighted_shingles(data, offsets, idf):
    """Rows, 48-bit fingerprints and weights of all distinct shingles, sorted by row and fingerprint."""
    h, counts, _, _ = word_hashes(data, offsets)
    s, made, at = windows(h, counts, SHINGLE)
    total = np.zeros(len(h) + 1)
    np.cumsum(idf[(h >> U(64 - DF_BITS)).astype(np.int64)], out=total[1:])
    end = np.minimum(at + SHINGLE, np.repeat(np.cumsum(counts), made))
    mean = (total[end] - total[at]) / np.maximum(1, end - at)
    key = (runs(made).astype(U) << U(48)) | (s >> U(16))
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    tf = np.diff(np.append(new, len(key)))
    # the mean is the same for equal shingles, up to the rounding of the prefix sums
    weight = (tf * np.round(mean[order][new], 4)).astype(np.float32)
    key = key[new]
    return (key >> U(48)).astype(np.int64), key & U((1 << 48) - 1), weight


def _uniform(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2**-32)


def signatures(rows: np.ndarray, fp: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Band keys (n x BANDS); rows without shingles get those of nothing, to be left out."""
    low, most = U(0xFFFFFFFF), U(0xFFFFFFFFFFFFFFFF)
    lnw, out = np.log(weight), np.zeros((n, BANDS), U)
    for e in range(SAMPLINGS):
        h1 = mix(fp + U((3 * e + 1) * 0x632BE59BD9B4E019 % 2**64))
        h2 = mix(h1 + BASE_STEP)
        h3 = mix(h2 + BASE_STEP)
        r = -np.log(_uniform(h1 >> U(32)) * _uniform(h1 & low))
        lnc = np.log(-np.log(_uniform(h2 >> U(32)) * _uniform(h2 & low)))
        beta = _uniform(h3 >> U(32))
        t = np.floor(lnw / r + beta)
        lna = (lnc - r * (t - beta) - r).astype(np.float32)
        bits = lna.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(U)  # keeps the order of floats
        who = mix(fp ^ (t.astype(np.int64).astype(U) << U(50)) ^ t.astype(np.int64).astype(U)) & low
        least = np.full(n * BANDS, most, U)
        np.minimum.at(least, rows * BANDS + (h3 & U(BANDS - 1)).astype(np.int64), (bits << U(32)) | who)
        least = least.reshape(n, BANDS)
        full, sample = least != most, least & low
        filled = sample.copy()
        for step in range(1, BANDS):  # an empty bin takes the sample of the next full one
            empty = ~full
            if not empty.any():
                break
            give = np.roll(least != most, -step, axis=1) & empty
            filled[give] = (np.roll(sample, -step, axis=1) + U(step * 0x9E3779B1))[give]
            full = full | give
        out = mix(out * U(0xD6E8FEB86659FD93) + filled)
    return mix(out + np.arange(BANDS, dtype=U))


BASE_STEP = U(0xA0761D6478BD642F)


def _sketch(idf):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            keys, some = np.zeros((len(batch), BANDS), U), np.zeros(len(batch), bool)
            for a, b in slices(offsets):
                rows, fp, weight = weighted_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], idf.value)
                keys[a:b] = signatures(rows, fp, weight, b - a)
                some[a:b][rows] = True
            flat = pa.array(keys.view(np.int64).reshape(-1))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * BANDS), flat)
            bands = pa.array([None if not s else k for s, k in zip(some, bands.to_pylist())], pa.list_(pa.int64())) if not some.all() else bands
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), bands], names=["doc_id", "digest", "bands"])

    return run


def _similar(idf, threshold):
    """Pairs of texts to those whose weighted Jaccard similarity reaches the threshold."""

    def weights(column):
        data, offsets = buffers(column)
        out = []
        for a, b in slices(offsets):
            rows, fp, weight = weighted_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], idf.value)
            cut = np.searchsorted(rows, np.arange(b - a + 1))
            out += [(fp[i:j], weight[i:j]) for i, j in zip(cut[:-1], cut[1:])]
        return out

    def run(batches):
        for batch in batches:
            size = pc.add(pc.binary_length(batch.column("left_text")), pc.binary_length(batch.column("right_text")))
            ends = np.cumsum(np.append(0, size.to_numpy(zero_copy_only=False).astype(np.int64)))
            for c, d in slices(ends):  # some megabytes of text, or one pair
                part = batch.slice(c, d - c)
                left = part.column("left_text").dictionary_encode()
                lefts, at = weights(left.dictionary), left.indices.to_numpy(zero_copy_only=False)
                ok = np.zeros(len(part), bool)
                for i, (fb, wb) in enumerate(weights(part.column("right_text"))):
                    fa, wa = lefts[at[i]]
                    if not len(fa) or not len(fb):
                        continue
                    j = np.minimum(np.searchsorted(fa, fb), len(fa) - 1)
                    both = fa[j] == fb
                    shared = float(np.minimum(wa[j][both], wb[both]).sum(dtype=np.float64))
                    ok[i] = shared >= threshold * (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - shared) - 1e-9
                out = part.filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["a", "b"])

    return run


def _occurrences(idf):
    """Texts per hashed shingle, added up over a task."""

    def run(batches):
        seen = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                _, fp, _ = weighted_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], idf.value)
                seen += np.bincount((fp & U((1 << ORDER_BITS) - 1)).astype(np.int64), minlength=1 << ORDER_BITS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    return run


def _prefixes(idf, seen, threshold):
    """The shingles by which a text may meet a similar one: rest is the weight from there on, light whether it may meet a heavier text."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                rows, fp, w = weighted_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], idf.value)
                order = np.lexsort((fp, seen.value[(fp & U((1 << ORDER_BITS) - 1)).astype(np.int64)], rows))
                fp, w = fp[order], w[order].astype(np.float64)  # rows are in order already
                behind = np.append(0.0, np.cumsum(w))
                cut = np.searchsorted(rows, np.arange(b - a + 1))
                total = (behind[cut[1:]] - behind[cut[:-1]])[rows]
                rest = behind[cut[1:]][rows] - behind[:-1]
                keep = rest >= threshold * total * SLACK
                light = rest >= 2 * threshold / (1 + threshold) * total * SLACK
                node = batch.column("node").to_numpy()[a:b][rows]
                for c in range(0, len(at := np.flatnonzero(keep)), 50_000):
                    x = at[c : c + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(v[x]) for v in (node, fp.astype(np.int64), rest, total, light)], names=["node", "fp", "rest", "total", "light"])

    return run


def unsettled_pairs(s: Scratch, texts: DataFrame, label: DataFrame, idf, threshold: float) -> DataFrame:
    """All pairs a, b of ``texts`` (node, text) of different ``label`` that prefix filtering does not prove to be below the threshold."""
    spark = texts.sparkSession
    seen = np.zeros(1 << ORDER_BITS, np.int32)
    got = texts.select("text").mapInArrow(_occurrences(idf), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 2**18 rows at most
    seen[got.column("bucket").to_numpy()] = np.minimum(got.column("n").to_numpy(), 2**31 - 1)
    prefix = texts.mapInArrow(_prefixes(idf, spark.sparkContext.broadcast(seen), threshold), "node long, fp long, rest double, total double, light boolean")
    of = broadcast_if_small(label.select(F.col("node").alias("of"), "label"), rows_of(label), 64)
    prefix = s.keep(prefix.join(of, F.col("node") == F.col("of")).drop("of"), "prefixes")
    # pairs inside the most frequent component of a shingle are never listed
    met = prefix.groupBy("fp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("light").alias("any"), F.mode("label", True).alias("most")).filter("lo < hi AND any")
    met = s.keep(met.select("fp", "most"), "met")
    rows = s.keep(prefix.join(broadcast_if_small(met, rows_of(met), 64), "fp").withColumn("of_most", F.expr("label = most")).drop("most"), "met_rows")
    s.drop(prefix, met)
    a = rows.filter("light").select("fp", *[F.col(c).alias(f"{c}_a") for c in ("node", "rest", "total", "label", "of_most")])
    b = rows.select("fp", *[F.col(c).alias(f"{c}_b") for c in ("node", "rest", "total", "label", "of_most")])
    may = f"label_a <> label_b AND NOT (of_most_a AND of_most_b) AND total_a <= total_b AND total_a >= {threshold * SLACK} * total_b AND least(rest_a, rest_b) >= {threshold / (1 + threshold) * SLACK} * (total_a + total_b)"
    pairs = a.hint("merge").join(b, "fp").filter(may)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def components(s: Scratch, links: DataFrame) -> DataFrame:
    """node, label (its component's smallest node) of all nodes with links, by label passing and pointer jumps."""
    both = s.keep(links.select("a", "b").union(links.select("b", "a")).distinct(), "both")
    label = s.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "label")
    n = rows_of(label)
    while n:
        of = broadcast_if_small(label.select(F.col("node").alias("of"), F.col("label").alias("far")), n, 64)
        near = both.join(of, F.col("b") == F.col("of")).groupBy(F.col("a").alias("near")).agg(F.min("far").alias("low"))
        low = label.join(near, F.col("node") == F.col("near")).select("node", "label", F.least("label", "low").alias("low"))
        jump = low.join(of, F.col("low") == F.col("of")).select("node", F.least("low", "far").alias("new"), "label")
        jump = s.keep(jump.select("node", F.col("new").alias("label"), (F.col("new") < F.col("label")).cast("int").alias("moved")), "label", moved=F.col("moved"))
        s.drop(label)
        label = jump
        if not sum_of(jump, "moved"):
            break
    s.drop(both)
    return label


def merged(s: Scratch, label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, label) after links a, b between its nodes: the components of components."""
    n = rows_of(label)
    of = lambda x: broadcast_if_small(label.select(F.col("node").alias(f"node_{x}"), F.col("label").alias(f"label_{x}")), n, 64)
    ends = links.join(of("a"), F.col("a") == F.col("node_a")).join(of("b"), F.col("b") == F.col("node_b"))
    top = components(s, ends.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).filter("a <> b"))
    top_of = broadcast_if_small(top.select(F.col("node").alias("old"), F.col("label").alias("new")), rows_of(top), 64)
    out = s.keep(label.join(top_of, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")), "label")
    s.drop(label, top)
    return out


def _classes(s: Scratch, docs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    named = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    # equal up to white space: one node
    plain = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    named = named.withColumn("digest", F.unhex(F.md5(plain)))
    idf = spark.sparkContext.broadcast(idf_table(named))
    id_type = named.schema["doc_id"].dataType.simpleString()
    sketch = named.mapInArrow(_sketch(idf), f"doc_id {id_type}, digest binary, bands array<long>")
    rows = s.keep(sketch.withColumn("uid", F.monotonically_increasing_id()), "rows")
    # a node's name, its row of the smallest doc_id (null last, then the first of repeated rows), its copies and bands
    first = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("uid").alias("u"))
    bands = [F.col("bands")[i] for i in range(BANDS)]
    nodes = rows.filter("bands IS NOT NULL").groupBy("digest").agg(F.min("uid").alias("node"), F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), *[F.min(b).alias(f"b{i}") for i, b in enumerate(bands)])
    nodes = s.keep(nodes, "nodes")
    bucket = nodes.select("node", F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("key"))
    shared = s.keep(bucket.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    # a node's degree: the rows of all its buckets; the original of many copies has the highest
    buckets = bucket.join(broadcast_if_small(shared, rows_of(shared), 64), "key")
    buckets = s.keep(buckets.withColumn("degree", F.sum("n").over(Window.partitionBy("node"))), "buckets")
    s.drop(shared)
    wanted = s.keep(buckets.select("node").distinct(), "wanted")
    n = rows_of(wanted)
    label = None
    if n:
        near = nodes.join(broadcast_if_small(wanted, n, 48), "node").select("node", F.col("digest").alias("of_digest"), F.col("first.d").alias("first_id"))
        texts = named.join(broadcast_if_small(near, n, 128), (F.col("digest") == F.col("of_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
        texts = s.keep(texts.select("node", "text"), "texts")
        if rows_of(texts) > n:  # repeated rows
            texts = s.keep(texts.dropDuplicates(["node"]), "texts")
        label = _linked(s, buckets, wanted, texts, idf, threshold)
        s.drop(texts)
    s.drop(buckets, wanted)
    # classes of several rows, named by their first row, which stays
    of = nodes.select("digest", "first", "copies", F.col("node").alias("label")) if label is None else nodes.join(broadcast_if_small(label.select(F.col("node").alias("of"), "label"), n, 64), F.col("node") == F.col("of"), "left").select("digest", "first", "copies", F.coalesce("label", "node").alias("label"))
    of = s.keep(of, "of")
    name = s.keep(of.groupBy("label").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size")).filter("class_size > 1"), "names")
    told = of.select(F.col("digest").alias("of_digest"), "label").join(broadcast_if_small(name, rows_of(name), 128), "label")
    told = s.keep(told.select("of_digest", F.col("first.d").alias("class_id"), F.col("first.u").alias("keeper"), "class_size"), "told")
    out = rows.select("uid", "doc_id", "digest").join(broadcast_if_small(told, rows_of(told), 160), F.col("digest") == F.col("of_digest"), "left")
    s.drop_but(rows, told)
    alone = F.col("class_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | (F.col("keeper") == F.col("uid"))).alias("kept"),
    )


def _linked(s: Scratch, buckets: DataFrame, wanted: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """node, label of all nodes in shared buckets: the smallest node that it is linked to, however far."""

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("left_text"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("right_text"))
        both = pairs.select("a", "b").join(right.hint("merge"), "b").join(left.hint("merge"), "a")
        return s.keep(both.mapInArrow(_similar(idf, threshold), "a long, b long").distinct(), "links")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # first, all nodes of a bucket with its node of the highest degree
    central = F.max(F.struct("degree", (-F.col("node")).alias("node")))
    hubs = s.keep(buckets.groupBy("key").agg(central.alias("top")).select("key", (-F.col("top.node")).alias("hub")), "hubs")
    tested = s.keep(ordered(buckets.join(broadcast_if_small(hubs, rows_of(hubs), 64), "key").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))), "pairs")
    label = components(s, confirmed(tested))
    label = s.keep(wanted.join(broadcast_if_small(label.select(F.col("node").alias("of"), "label"), rows_of(label), 64), F.col("node") == F.col("of"), "left").select("node", F.coalesce("label", "node").alias("label")), "label")
    of_node = lambda: broadcast_if_small(label.select(F.col("node").alias("of"), "label"), rows_of(label), 64)
    # then, in buckets of several components: small ones all pairs, others with the hub of those that the first hub left
    many = buckets.filter("n > 2").join(of_node(), F.col("node") == F.col("of")).drop("of")
    mixed = many.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max_by("label", F.struct("degree", -F.col("node"))).alias("hub_label")).filter("lo < hi")
    mixed = s.keep(mixed.select("key", "hub_label"), "mixed")
    if rows_of(mixed):
        open_ = s.keep(many.join(broadcast_if_small(mixed, rows_of(mixed), 64), "key"), "open")
        small = open_.filter(f"n <= {SMALL_BUCKET}")
        other = small.select("key", F.col("node").alias("b"), F.col("label").alias("label_b"))
        more = small.select("key", F.col("node").alias("a"), "label").join(other, "key").filter("a < b AND label <> label_b").select("a", "b")
        hubs = open_.filter(f"n > {SMALL_BUCKET} AND label <> hub_label").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("node"), "label")).alias("top"))
        hubs = s.keep(hubs.select("key", (-F.col("top.node")).alias("hub"), F.col("top.label").alias("of_hub")), "hubs")
        more = more.union(open_.join(broadcast_if_small(hubs, rows_of(hubs), 80), "key").filter("label <> of_hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))
        more = s.keep(ordered(more).join(tested, ["a", "b"], "left_anti"), "pairs")
        found = confirmed(more)
        if rows_of(found):
            label = merged(s, label, found)
        # what large buckets still hold apart is settled by prefix filtering
        crowded = open_.filter(f"n > {SMALL_BUCKET}").select("key", "node").join(of_node(), F.col("node") == F.col("of")).drop("of")
        mixed = s.keep(crowded.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key"), "mixed")
        if rows_of(mixed):
            left = s.keep(crowded.join(broadcast_if_small(mixed, rows_of(mixed), 48), "key").select("node").distinct(), "unsettled")
            apart = s.keep(texts.join(broadcast_if_small(left, rows_of(left), 48), "node"), "unsettled_texts")
            last = unsettled_pairs(s, apart, label, idf, threshold).join(tested.unionByName(more), ["a", "b"], "left_anti")
            found = confirmed(s.keep(last, "pairs"))
            if rows_of(found):
                label = merged(s, label, found)
    return label


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, class_size, kept."""
    return _classes(Scratch(docs.sparkSession, "minhash"), docs, doc_id, text, threshold)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: of each class that with the smallest doc_id (null last). The result reads ``scratch``."""
    s, uid = scratch or Scratch(docs.sparkSession, "near"), fresh(docs, "uid")
    docs = s.keep(docs.withColumn(uid, F.monotonically_increasing_id()), "docs")
    named = docs.select(F.struct(column(doc_id).isNull().alias("z"), column(doc_id).alias("d"), F.col(uid).alias("u")).alias("id"), column(text).alias("text"))
    inner = Scratch(docs.sparkSession, "minhash")
    gone = s.keep(_classes(inner, named, "id", "text", threshold).filter("NOT kept").select(F.col("doc_id.u").alias(uid)), "gone")
    inner.close()
    return docs.join(broadcast_if_small(gone, rows_of(gone), 48), uid, "left_anti").drop(uid)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: one row per row of ``documents`` with its class."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
