"""URL filter by gradient-boosted trees on lexical features (operator 7).

Rules decide what they fit: a rule fits its host and all subdomains if the path
starts with the rule's, and the longest rule wins.  All other URLs are judged by
boosted trees over lexical features: lengths, depth, digit ratio, character
entropy, parameter counts, and statistics of the host's suffix and of the path's
ending among the labelled URLs.

The trees are trained here, from labelled URLs; the query labels URLs by the
rules.  Fitting the trees takes at most ``TRAIN_ROWS`` different labelled URLs,
of each class those of smallest hash, so reruns take the same.  Everything else,
the suffix statistics too, runs over all URLs, in DataFrame operations and Spark's
own tree learner, without Python on the executors.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import lower_ascii, staged, table

#: (verdict, rule) of the query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 12, 3, 11
#: Rows that count for the overall rate in each suffix's rate.
PRIOR_ROWS = 20.0

FEATURES = ("url_length", "host_length", "host_labels", "path_length", "path_depth", "query_length", "n_parameters", "digit_ratio",
            "path_digits", "entropy", "n_hyphens", "n_encoded", "has_fragment", "host_suffix_rate", "host_suffix_rows",
            "path_suffix_rate", "path_suffix_rows")


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with host and path (both empty for a null or without ``://``)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    return df.withColumn("host", lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))) \
             .withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def with_rule(df: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """``df`` (host, path) with the longest rule that fits and its verdict, both
    null where none does.  Of equally long rules the first in order wins."""
    fits: Column | None = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fit = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        pair = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(fit, pair) if fits is None else fits.when(fit, pair)
    if fits is None:
        fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    return df.withColumn("_fit", fits).withColumns({"rule": F.col("_fit.rule"), "rule_verdict": F.col("_fit.verdict")}).drop("_fit")


def _entropy(text: Column) -> Column:
    """Bits per character of a string."""
    n = F.length(text)
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    share = F.transform(chars, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.coalesce(F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p)), F.lit(0.0))


def with_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` (host, path) with the features that need no statistics, and the
    keys host_suffix (last label) and path_suffix (extension or slash)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, r"[^0-9]", ""))
    return df.withColumns({
        "url_length": F.length(url), "host_length": F.length("host"),
        "host_labels": F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\."))),
        "path_length": F.length("path"), "path_depth": F.length(F.regexp_replace("path", r"[^/]", "")),
        "query_length": F.length(query),
        "n_parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
        "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
        "path_digits": F.length(F.regexp_replace("path", r"[^0-9]", "")), "entropy": _entropy(url),
        "n_hyphens": F.length(F.regexp_replace("host", r"[^-]", "")), "n_encoded": F.regexp_count(url, F.lit("%[0-9A-Fa-f]{2}")),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "host_suffix": F.regexp_extract("host", r"([^.]*)$", 1),
        "path_suffix": F.regexp_extract("path", r"(\.[A-Za-z0-9]{1,8}|/)$", 1),
    })


class UrlModel:
    """A trained filter: trees and suffix statistics, or a constant verdict where
    the labels held one class only (``allow`` without any)."""

    def __init__(self, trees: PipelineModel | None, suffixes: dict[str, DataFrame], rate: float, constant: str):
        self.trees, self.suffixes, self.rate, self.constant = trees, suffixes, rate, constant

    def _rated(self, df: DataFrame) -> DataFrame:
        for kind, known in self.suffixes.items():
            # Staged, so the planner knows its size: broadcast only under the session's threshold.
            df = df.join(known, kind, "left").fillna({f"{kind}_rate": self.rate, f"{kind}_rows": 0})
        return df

    def judged(self, df: DataFrame) -> DataFrame:
        """``df`` (of ``with_features``) with ``block_score`` and ``model_verdict``."""
        if self.trees is None:
            score = 1.0 if self.constant == "block" else 0.0
            return df.withColumns({"block_score": F.lit(score), "model_verdict": F.lit(self.constant)})
        scored = self.trees.transform(self._rated(df).withColumns({f: F.col(f).cast("double") for f in FEATURES}))
        return scored.withColumn("block_score", vector_to_array("probability")[1]) \
                     .withColumn("model_verdict", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", rows: int = TRAIN_ROWS,
          trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> UrlModel:
    """A filter from ``labelled`` URLs; label 1 is block, 0 allow, rows with a
    null label don't count.  Suffix statistics are those of all labelled rows; the
    trees are fitted on at most ``rows`` different URLs, of smallest hash, with the
    classes in their proportion but a hundredth of each at least."""
    known = with_parts(labelled.where(F.col(label_col).isNotNull()).select(
        F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.col(label_col).cast("double").alias("label")))
    keyed = with_features(known).select("host_suffix", "path_suffix", "label")
    n, blocked = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < blocked < n:
        return UrlModel(None, {}, 0.0, "block" if n and blocked else "allow")
    rate, suffixes = blocked / n, {}
    for kind in ("host_suffix", "path_suffix"):
        stats = keyed.groupBy(kind).agg(F.count(F.lit(1)).alias(f"{kind}_rows"), F.sum("label").alias("_b"))
        suffixes[kind] = staged(stats.select(
            kind, f"{kind}_rows", ((F.col("_b") + PRIOR_ROWS * rate) / (F.col(f"{kind}_rows") + PRIOR_ROWS)).alias(f"{kind}_rate")),
            kind.replace("_", "-"))
    # A URL that is repeated takes one place.
    single = staged(known.select("url", "label").distinct().withColumn("h", F.xxhash64("url")), "url-labels")
    each = {r["label"]: r["count"] for r in single.groupBy("label").count().collect()}
    least = {label: min(each[label], max(1, rows // 100)) for label in (0.0, 1.0)}
    block = min(max(int(rows * each[1.0] / (each[0.0] + each[1.0])), least[1.0]), rows - least[0.0])
    taken = [single.where(F.col("label") == label).orderBy("h", "url").limit(k) for label, k in ((0.0, rows - block), (1.0, block))]
    sample = staged(with_features(with_parts(taken[0].unionByName(taken[1]))), "url-sample")
    model = UrlModel(None, suffixes, rate, "allow")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    fit = assembler.transform(model._rated(sample).withColumns({f: F.col(f).cast("double") for f in FEATURES}))
    learner = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.3)
    fit = staged(fit.select("features", "label", "h", "url").orderBy("h", "url", "label").coalesce(1), "url-features").coalesce(4)
    model.trees = PipelineModel([assembler, learner.fit(fit.select("features", "label"))])
    return model


def filter_urls(df: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, **options) -> DataFrame:
    """``df`` with host, path, rule, verdict and ``block_score`` (the model's,
    null where a rule decides), the model being trained on the URLs that a rule
    decides.

    Defined results: a null URL, or one without ``://``, has an empty host and
    path and is judged by the model like any other.  Without rules that fit, or
    with one verdict only, the model is constant.  Repeated rows are judged
    alike; an empty table stays empty.  Columns of ``df`` with the names of new
    ones are replaced, all others pass through.
    """
    new = {"host", "path", "rule", "verdict", "block_score"}
    keep = [c for c in df.columns if c.lower() not in new]
    own = df.select(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)]).alias("_row"), F.col(url_col).alias("url"))
    ruled = with_rule(with_parts(own), rules)
    labels = ruled.where("rule IS NOT NULL").select("url", (F.col("rule_verdict") == "block").cast("int").alias("label"))
    model = train(labels, **options)
    judged = model.judged(with_features(ruled))
    return judged.select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(keep)], "host", "path", "rule",
                         F.coalesce("rule_verdict", "model_verdict").alias("verdict"),
                         F.when(F.col("rule").isNull(), F.col("block_score")).alias("block_score"))


def op7_boosted_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every URL of ``pages``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")
