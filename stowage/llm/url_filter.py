"""URL filtering by rules, then by gradient-boosted trees on lexical features.

Features are expressions over the url alone: lengths of url, host and path, depth, share of digits and of
other marks, entropy of the characters, counts of parameters, labels and hyphens, a fragment; and, for the
host's last label and last two labels, how often the suffix is blocked among the labelled urls (smoothed)
and how common it is there. No feature looks at words. Trees are Spark ML's, trained from labelled urls: those that
a rule decides (or a table of labels that the caller has), at most MAX_TRAINING different ones, those first in an
order by hash. The model is bounded by that number, the suffix tables are not: they count all labelled urls.

Cross-fitting: urls are dealt into FOLDS by hash. A url is judged by trees that were trained without its fold, with
suffix statistics that leave its fold out, so no url is judged by what its own label taught, in training or after.

Where the caller has no labels, this is learning from positive and unlabelled urls: those that a rule blocks, or
whose host holds a word of SEED_WORDS, are blocked; those that a rule allows are allowed, and the undecided ones
in the sample count as allowed at half weight. The words only label; the trees block hosts that look alike.

Everything on the way is DataFrame expressions and JVM code: no Python runs on the executors.

Defined cases: a null url, or one without ``://``, has an empty host and path; it is judged by its
features like any other. Urls of any length are read whole, in ``n log n`` time. Equal urls are judged alike. If the labelled
urls are all of one kind, that is the verdict; if there are none, it is ``allow``. Other columns are not
touched. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import Scratch, broadcast_if_small, column, rows_of, sum_of, table

#: Host and path of the rules.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Parts of host names that blocklists are full of.
SEED_WORDS = ("casino", "cheap", "pills", "spam", "viagra", "poker", "porn", "xxx", "payday", "replica", "warez", "lottery")
MAX_TRAINING = 5_000
UNLABELLED_WEIGHT = 0.5
FOLDS = 3
TREES, DEPTH, SMOOTH = 20, 4, 4.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits the url, or null: the host or a domain above it, and a start of the path."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def lexical(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add the features of url, host and path (all double)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.length(url).cast("double")
    # characters in order: a run of equal ones ends where another begins
    runs = F.aggregate(
        F.concat(F.array_sort(F.split(url, "")), F.array(F.lit(None).cast("string"))),
        F.struct(F.lit("").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("s")),
        lambda a, x: F.when(x.eqNullSafe(a["c"]), F.struct(a["c"].alias("c"), (a["k"] + 1).alias("k"), a["s"].alias("s"))).otherwise(F.struct(F.coalesce(x, F.lit("")).alias("c"), F.lit(1.0).alias("k"), (a["s"] + F.when((a["c"] != "") & (a["k"] > 0), a["k"] * F.log2(a["k"])).otherwise(0.0)).alias("s"))),
        lambda a: a["s"],
    )
    entropy = F.log2(n) - runs / n
    made = {
        "f_length": n,
        "f_host_length": F.length("host").cast("double"),
        "f_path_length": F.length("path").cast("double"),
        "f_depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
        "f_digits": _share(F.regexp_count(url, F.lit("[0-9]")).cast("double"), n),
        "f_marks": _share(F.regexp_count(url, F.lit("[^A-Za-z0-9/.:]")).cast("double"), n),
        "f_entropy": F.when(n > 0, entropy).otherwise(0.0),
        "f_params": F.when(F.length(query) > 0, F.regexp_count(query, F.lit("&")) + 1).otherwise(0).cast("double"),
        "f_labels": F.regexp_count("host", F.lit("[^.]+")).cast("double"),
        "f_hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
        "f_host_digits": F.regexp_count("host", F.lit("[0-9]")).cast("double"),
        "f_fragment": url.contains("#").cast("double"),
        "f_slash_end": F.col("path").endswith("/").cast("double"),
    }
    return suffixes(df.select("*", *[c.alias(k) for k, c in made.items()])), list(made)


def suffixes(df: DataFrame) -> DataFrame:
    """Add the host's last label and last two labels, and the url's fold."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)).cast("int")
    return df.select("*", F.substring_index("host", ".", -1).alias("s1"), F.substring_index("host", ".", -2).alias("s2"), fold.alias("fold"))


def suffix_statistics(labelled: DataFrame, level: str) -> DataFrame:
    """Blocked urls and all of a suffix outside each fold, among the labelled: of, fold_of, b, n."""
    parts = labelled.groupBy(level).agg(*[F.sum(F.when(F.col("fold") != k, F.col("label")).otherwise(0.0)).alias(f"b{k}") for k in range(FOLDS)], *[F.sum((F.col("fold") != k).cast("long")).alias(f"n{k}") for k in range(FOLDS)])
    return parts.select(F.col(level).alias("of"), F.inline(F.array(*[F.struct(F.lit(k).alias("fold_of"), F.col(f"b{k}").alias("b"), F.col(f"n{k}").alias("n")) for k in range(FOLDS)])))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: dict[str, str] = RULES, key: str = "page_id", url: str = "url", most: int = MAX_TRAINING, seeds: tuple[str, ...] = SEED_WORDS) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict, probability (of block; null where a rule decides).

    ``labels``: url, label (1: block), besides the urls that rules decide; without, see above.
    """
    s = Scratch(pages.sparkSession, "urls")
    named = pages.select(column(key).alias("key"), column(url).alias("url"))
    host, path = split_url(F.col("url"))
    named = named.withColumn("host", host).withColumn("path", path)
    decide = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]) if rules else None
    named = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("told", decide[F.col("rule")] if rules else F.lit(None).cast("string"))
    columns = ("url", "host", "path", "label", "weight")
    decided = named.filter("told IS NOT NULL").withColumn("label", (F.col("told") == "block").cast("double")).withColumn("weight", F.lit(1.0))
    if labels is not None:
        more_host, more_path = split_url(F.col("url"))
        other = labels.select(F.col("url"), F.col("label").cast("double")).withColumn("host", more_host).withColumn("path", more_path).withColumn("weight", F.lit(1.0))
    else:
        seeded = F.col("host").rlike("(^|[.-])(" + "|".join(seeds) + ")([.-]|$)")
        other = named.filter("told IS NULL").withColumn("label", seeded.cast("double")).withColumn("weight", F.when(seeded, 1.0).otherwise(UNLABELLED_WEIGHT))
    teach = decided.select(*columns).unionByName(other.select(*columns))
    everything = suffixes(teach.select("url", "host", "label"))
    # different urls, first in an order by hash: the hashes are found first, so a common url counts once
    turn = F.xxhash64("url", F.lit("turn"))
    first = teach.select(turn.alias("turn")).groupBy("turn").agg(F.count(F.lit(1)).alias("n")).orderBy("turn").limit(most).select(F.col("turn").alias("of"))
    chosen = teach.withColumn("turn", turn).join(F.broadcast(first), F.col("turn") == F.col("of"))  # ``most`` rows at most
    chosen = chosen.groupBy("url", "host", "path").agg(F.max("label").alias("label"), F.max("weight").alias("weight"))
    teach = s.keep(chosen, "teach", blocked=F.col("label"))
    rows, features = lexical(named)
    shown = lambda df, verdict, p: df.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), p.alias("probability"))
    blocked, n = sum_of(teach, "blocked"), rows_of(teach)
    if blocked in (0, n):
        return shown(named, F.coalesce("told", F.lit("block" if blocked else "allow")), F.lit(None).cast("double"))
    taught, _ = lexical(teach)
    tables = {level: s.keep(suffix_statistics(everything, level), level, b=F.col("b"), n=F.col("n")) for level in ("s1", "s2")}
    base = sum_of(tables["s1"], "b") / max(1, sum_of(tables["s1"], "n"))

    def with_suffixes(df: DataFrame) -> DataFrame:
        for level, t in tables.items():
            held = t.select(F.col("of").alias(f"of_{level}"), F.col("fold_of").alias(f"fold_{level}"), F.col("b").alias(f"b_{level}"), F.col("n").alias(f"n_{level}"))
            df = df.join(broadcast_if_small(held, rows_of(t), 160), (F.col(level) == F.col(f"of_{level}")) & (F.col("fold") == F.col(f"fold_{level}")), "left")
            b, n = F.coalesce(f"b_{level}", F.lit(0.0)), F.coalesce(f"n_{level}", F.lit(0))
            df = df.withColumn(f"f_{level}_rate", (b + SMOOTH * base) / (n + SMOOTH)).withColumn(f"f_{level}_count", F.log1p(n.cast("double")))
        return df

    features = [*features, *[f"f_{level}_{k}" for level in tables for k in ("rate", "count")]]
    vector = VectorAssembler(inputCols=features, outputCol="features")
    training = s.keep(with_suffixes(taught).select("label", "weight", "fold", *features), "training", **{f"b{k}": F.when(F.col("fold") != k, F.col("label")).otherwise(0.0) for k in range(FOLDS)}, **{f"n{k}": (F.col("fold") != k).cast("int") for k in range(FOLDS)})
    training = (training, vector.transform(training.coalesce(1)))  # ``most`` rows at most
    judged, p = vector.transform(with_suffixes(rows)), F.lit(None).cast("double")
    for k in range(FOLDS):
        blocked, n = sum_of(training[0], f"b{k}"), sum_of(training[0], f"n{k}")
        if blocked in (0, n):
            of_fold = F.lit(float(bool(blocked)))
        else:
            learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, featuresCol="features", labelCol="label", weightCol="weight")
            model = learner.fit(training[1].filter(F.col("fold") != k))
            model.setProbabilityCol(f"probability{k}").setRawPredictionCol(f"raw{k}").setPredictionCol(f"prediction{k}")
            judged = model.transform(judged)
            of_fold = vector_to_array(f"probability{k}")[1]
        p = F.when(F.col("fold") == k, of_fold).otherwise(p)
    return shown(judged.withColumn("p", p), F.coalesce("told", F.when(F.col("p") >= 0.5, "block").otherwise("allow")), F.when(F.col("told").isNull(), F.col("p")))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: one row per row of ``pages``."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
