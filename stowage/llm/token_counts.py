"""Token counts as rollups that are maintained by deltas.

A rollup lives in a folder. Changes arrive in batches: inserts, deletes and revised counts of documents,
each under a tokenizer version. A batch becomes signed ledger rows (an insert adds; a delete takes away
all that the ledger holds of the document and version; a revision takes that away and adds the new count)
and their sum by (source, lang, version). Totals are additive: they are the sum of the deltas of all
committed batches, and never need the documents again.

An attempt writes into a folder of its own and commits by one file: the next number in ``commits/``, made in one
step (``create`` without overwriting), which names the batch and the folder. If another batch has taken the number
meanwhile, what the attempt took away may be counted otherwise by now, so it starts again from the newer state: of
racing batches one is first, and none is lost or counted twice. What a lost attempt has written is never named.
A batch that is named already is left as it is, so a batch counts once however often it is sent.

Tokenizer versions are named functions of the text; ``words-1`` and ``words-2`` are expressions, and
``bpe_version`` makes one of a public BPE vocabulary, run over Arrow batches. A batch adds up only the ledger rows
of the documents that it changes; ``compact`` sums the ledger into one folder, whose commit replaces all before it.

Defined cases: a null or empty text has no tokens, and its document counts as one. Null sources and
languages are groups of their own; a null doc_id can be inserted, and no change can name it again. Rows
that repeat in an insert count each. A delete or a revision of a document that the ledger doesn't hold
does nothing, or adds it. Rows that repeat in a delete or a revision act once: of several revisions in a
batch the largest count holds. Other columns are not read. An empty batch commits and changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.common import Scratch, _path, remove, table, word_count
from stowage.llm.packing import WordTokens, tokenizer_path
from stowage.llm.textvec import buffers, slices

KEYS = ("source", "lang", "version")
LEDGER = "doc_id bigint, source string, lang string, version string, docs bigint, tokens bigint"
#: Seconds after which an empty commit file counts as left behind.
LEASE = 30
DELTA = "source string, lang string, version string, docs bigint, tokens bigint"


def pieces_count(text: str | Column) -> Column:
    """Runs of letters and digits, and every other visible character by itself."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]")).cast("long")


#: The version that the query counts by a tokenizer.
BPE = "word_bpe_49k"
VERSIONS: dict[str, Callable[[Column], Column]] = {"words-1": word_count, "words-2": pieces_count}


def bpe_version(path: str) -> Callable[[Column], Column]:
    """A version that counts the ids of a public BPE vocabulary (``tokenizers`` file at ``path``)."""
    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        data, offsets = buffers(text)
        parts = [WordTokens.of(path).encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[1] for a, b in slices(offsets)]
        return pa.array([int(n) for part in parts for n in part], pa.int64())

    return lambda text: count(F.coalesce(text, F.lit("")))


class Rollup:
    """A folder with ``ledger/``, ``deltas/`` and ``commits/``, on the file system that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _commits(self) -> list[dict]:
        """What is committed, in order: the batch (none: a compaction) and its folder.

        A commit file that stays empty for LEASE seconds is that of an attempt that was lost while it committed; it goes.
        """
        fs, p = _path(self.spark, f"{self.folder}/commits")
        out = []
        for f in sorted((f.getPath() for f in fs.listStatus(p)), key=lambda f: f.getName()) if fs.exists(p) else []:
            for wait in range(10 * LEASE):
                stream = fs.open(f)
                said = bytes(stream.readAllBytes())
                stream.close()
                if said:
                    out.append(json.loads(said.decode()))
                    break
                time.sleep(0.1)
            else:
                fs.delete(f, False)
        return out

    def batches(self) -> list[str]:
        return [c["batch"] for c in self._commits() if c["batch"] is not None]

    def _read(self, kind: str, schema: str, commits: list[dict]) -> DataFrame:
        # a compaction stands for all before it
        last = max((i for i, c in enumerate(commits) if c["batch"] is None), default=0)
        folders = [f"{self.folder}/{kind}/{c['folder']}" for c in commits[last:]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def ledger(self, of: DataFrame | None = None, commits: list[dict] | None = None) -> DataFrame:
        """What is counted now: doc_id, source, lang, version, docs, tokens; of some (doc_id, version), whose rows alone are added up."""
        held = self._read("ledger", LEDGER, self._commits() if commits is None else commits)
        if of is not None:
            held = held.join(of, ["doc_id", "version"], "left_semi").select("doc_id", *KEYS, "docs", "tokens")
        held = held.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return held.filter("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens over all committed batches."""
        held = self._read("deltas", DELTA, self._commits()).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return held.filter("n_docs <> 0 OR n_tokens <> 0")

    def signed(self, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None, commits: list[dict] | None = None) -> DataFrame:
        """The ledger rows of a batch. Inserts and revisions: doc_id, source, lang, version, tokens; deletes: doc_id, version."""
        rows = self.spark.createDataFrame([], LEDGER)
        added = lambda df: df.select("doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))
        gone = None
        if inserts is not None:
            rows = rows.unionByName(added(inserts))
        if deletes is not None:
            gone = deletes.select("doc_id", "version")
        if revisions is not None:
            newest = revisions.groupBy("doc_id", "version").agg(F.max(F.struct("tokens", "source", "lang")).alias("r"))
            newest = newest.select("doc_id", "r.source", "r.lang", "version", "r.tokens")
            rows = rows.unionByName(added(newest))
            told = revisions.select("doc_id", "version")
            gone = told if gone is None else gone.unionByName(told)
        if gone is not None:
            old = self.ledger(gone.distinct(), commits)
            rows = rows.unionByName(old.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        return rows

    def _write(self, rows: DataFrame, batch: str | None, number: int) -> bool:
        """Write an attempt's folder and name it under a number; False if that is taken."""
        folder = f"{batch or 'compacted'}-{uuid.uuid4().hex[:12]}"
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/ledger/{folder}")
        delta = self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger/{folder}").groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.write.parquet(f"{self.folder}/deltas/{folder}")
        fs, named = _path(self.spark, f"{self.folder}/commits/{number:010d}")
        try:
            stream = fs.create(named, False)  # only one attempt can
        except Py4JJavaError:
            for kind in ("ledger", "deltas"):
                remove(self.spark, f"{self.folder}/{kind}/{folder}")
            return False
        stream.write(bytearray(json.dumps({"batch": batch, "folder": folder}).encode()))
        stream.close()
        return True

    def commit(self, batch: str, **changes: DataFrame) -> bool:
        """Apply ``inserts``, ``deletes``, ``revisions`` once under the name ``batch``; False if that is done already."""
        while True:
            commits = self._commits()
            if any(c["batch"] == batch for c in commits):
                return False
            if self._write(self.signed(**changes, commits=commits), batch, len(commits)):
                return True

    def compact(self) -> bool:
        """Sum the ledger into one folder; False if a batch came between."""
        commits = self._commits()
        return self._write(self.ledger(commits=commits).select("doc_id", *KEYS, "docs", "tokens"), None, len(commits))


def counted(docs: DataFrame, versions: dict[str, Callable[[Column], Column]] = VERSIONS, text: str = "text") -> DataFrame:
    """One row per document and version: doc_id, source, lang, version, tokens, in one scan of the texts."""
    wide = docs.select("doc_id", "source", "lang", *[f(F.col(text)).alias(f"n{i}") for i, f in enumerate(versions.values())])
    pairs = F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"n{i}").alias("tokens")) for i, v in enumerate(versions)])
    return wide.select("doc_id", "source", "lang", F.inline(pairs))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: totals after four batches over all ``documents``.

    All documents under words-1; those labelled toxic withdrawn; those labelled of low quality counted
    again without their symbols; all that are left under a public BPE vocabulary. Each batch is sent twice.
    """
    s = Scratch(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    plain = F.translate("text", "#*$%&|<>", " " * 8)
    counts = s.keep(counted(docs, {"words-1": word_count, BPE: bpe_version(tokenizer_path()), "revised": lambda text: word_count(plain)}), "counts")
    labels = table(spark, sf_dir, "labels")
    of = lambda version: counts.filter(F.col("version") == version)
    toxic, low = (labels.filter(c).select("doc_id").distinct() for c in ("toxic = 1", "quality = 0"))
    rollup = Rollup(spark, f"{s.dir}/rollup")
    for _ in range(2):
        rollup.commit("1-load", inserts=of("words-1"))
        rollup.commit("2-withdraw", deletes=toxic.withColumn("version", F.lit("words-1")))
        revised = of("revised").withColumn("version", F.lit("words-1")).join(low, "doc_id", "left_semi").join(toxic, "doc_id", "left_anti")
        rollup.commit("3-revise", revisions=revised)
        rollup.commit("4-bpe", inserts=of(BPE).join(toxic, "doc_id", "left_anti"))
    return rollup.totals()
