"""URL filters: host and path rules, and gradient-boosted trees on lexical features, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Holds for ``host`` and its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Training:
    """rows: most labelled URLs that the trees are fitted on, chosen by a hash; trees, depth, rate: of the boosting;
    folds: parts of the labelled URLs, each of which gets its suffixes' statistics from the others."""

    rows: int = 20_000
    trees: int = 10
    depth: int = 4
    rate: float = 0.2
    folds: int = 5
    seed: int = 17


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that holds, null if none does; of equally long ones the first in order."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last that holds is kept
        holds = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(holds, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _share(text: Column, kept: str) -> Column:
    """Share of the characters that a pattern keeps."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, kept, "")), F.length(text)), F.lit(0.0))


def _entropy(text: Column) -> Column:
    """Entropy in bits of the characters of a text."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(letters).cast("double")
    part = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return F.coalesce(-F.aggregate(part, F.lit(0.0), lambda s, p: s + p * F.log2(p)), F.lit(0.0))


FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "signs", "entropy", "host_entropy", "params", "param_length", "fragment", "secure", "longest", "suffix_log", "suffix_block")


def lexical(urls: DataFrame) -> DataFrame:
    """(url, host, path) with the lexical features of each."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return urls.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": F.size(parts).cast("double"), "labels": F.size(F.split(host, "\\.")).cast("double"),
        "digits": _share(url, "[^0-9]"), "host_digits": _share(host, "[^0-9]"), "signs": _share(host, "[^-_]"),
        "entropy": _entropy(url), "host_entropy": _entropy(host),
        "params": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"), "param_length": F.length(query).cast("double"),
        "fragment": url.contains("#").cast("double"), "secure": url.startswith("https").cast("double"),
        "longest": F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)).cast("double"),
    })


def suffix_statistics(urls: DataFrame, folds: int) -> tuple[DataFrame, DataFrame]:
    """suffix, n, bad of (suffix, fold, label) rows: URLs of a suffix and how many of them are known to be blocked; and the same by fold."""
    per = materialize(urls.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("bad")), "url-suffixes")
    return per.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), per


def with_suffixes(urls: DataFrame, stats: DataFrame, by_fold: DataFrame | None = None, folds: int = 0) -> DataFrame:
    """Rows with ``suffix_log`` and ``suffix_block``: the log of a suffix's URLs and the smoothed share of known blocked ones among them.

    With ``by_fold``, of so many folds, the URLs of a row's own fold do not count, so that no row's label is in its features. Both are
    in coarse steps: fine ones would tell the fold, and with it the labels that were left out. A suffix
    that a third of all URLs have meets its statistics without a shuffle.
    """
    rows = join_counted(urls, stats, "suffix", "n", how="left")
    n, bad, scale = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0.0)), 1.0
    if by_fold is not None:
        # a row a suffix and fold; the fold parts a frequent suffix
        own = by_fold.select(F.col("suffix").alias("o_suffix"), F.col("fold").alias("o_fold"), F.col("n").alias("own_n"), F.col("bad").alias("own_bad"))
        rows = rows.join(own, (rows["suffix"] == own["o_suffix"]) & (rows["fold"] == own["o_fold"]), "left").drop("o_suffix", "o_fold")
        n, bad, scale = n - F.coalesce("own_n", F.lit(0)), bad - F.coalesce("own_bad", F.lit(0.0)), folds / (folds - 1)
    return rows.withColumns({"suffix_log": F.round(F.log2(1 + n * scale)).cast("double"), "suffix_block": F.round((bad + 1.0) / (n + 4.0) * 16).cast("double") / 16})


def train(labelled: DataFrame, t: Training = Training()) -> tuple[GBTClassificationModel | None, float]:
    """Trees fitted on rows of FEATURES and ``label``, and the share of label 1; no trees where one label is missing."""
    n = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = n.get(1.0, 0) / sum(n.values()) if n else 0.0
    if len(n) < 2:
        return None, share
    rate = min(1.0, 1.2 * t.rows / sum(n.values()))
    place = F.xxhash64("url", "page_id")
    picked = labelled.where(F.pmod(place, F.lit(1 << 30)) <= rate * (1 << 30)).orderBy(place, *FEATURES, "label").limit(t.rows)
    sample = materialize(picked.select(*FEATURES, "label").coalesce(1), "url-sample")  # a bounded sample: one small part
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=t.trees, maxDepth=t.depth, stepSize=t.rate, seed=t.seed, cacheNodeIds=False)
    return trees.fit(vectors.select("features", "label")), share


def _parsed(df: DataFrame, folds: int) -> DataFrame:
    """Rows of (page_id, url) with host, path, suffix and fold."""
    rows = df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return rows.withColumns({"suffix": suffix_of(F.col("host")), "fold": F.pmod(F.xxhash64("url", "page_id", F.lit("fold")), F.lit(folds)).cast("int")})


def _ruled(pages: DataFrame, rules: list[Rule], t: Training, id_col: str, url_col: str) -> DataFrame:
    rows = _parsed(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")), t.folds)
    rows = rows.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "url", "host", "path", "suffix", "fold", F.col("rule.rule").alias("rule"), F.col("rule.verdict").alias("verdict"))
    return materialize(rows, "url-rows")


def _seen(rows: DataFrame, labelled: DataFrame | None, t: Training) -> DataFrame:
    if labelled is None:
        return rows.withColumn("label", F.when(F.col("verdict") == "block", 1.0).when(F.col("verdict") == "allow", 0.0))
    return _parsed(labelled.select(F.lit(None).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("label").cast("double").alias("label")), t.folds)


def score(rows: DataFrame, model: GBTClassificationModel) -> DataFrame:
    """Rows of FEATURES with ``score``, the trees' probability of label 1."""
    model.setFeaturesCol("features").setPredictionCol("gbt_label").setRawPredictionCol("gbt_raw").setProbabilityCol("gbt_share")
    made = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    return made.withColumn("score", F.element_at(vector_to_array(F.col("gbt_share")), 2))


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, t: Training = Training(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row.

    The verdict is that of the longest rule that holds. Elsewhere the trees decide: block if their
    probability of ``block`` is over a half. They learn from ``labelled`` (url, label 1 to block) and,
    without it, from the URLs that the rules label, with suffix statistics of the other folds. Without URLs of both labels a URL that no rule
    holds for is allowed, or blocked if all labelled ones are. Null URLs and URLs without ``://``
    have an empty host and path and are judged by the trees too. Ids may repeat or be null; an empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = _ruled(pages, rules, t, id_col, url_col)
    seen = _seen(rows, labelled, t)
    stats, by_fold = suffix_statistics(seen.select("suffix", "fold", "label"), t.folds)
    model, share = train(with_suffixes(lexical(seen.where("label is not null")), stats, by_fold, t.folds), t)
    scored = rows.withColumn("score", F.lit(1.0 if share > 0.5 else 0.0)) if model is None else score(with_suffixes(lexical(rows), stats), model)
    method = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "score")


def held_out_loss(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, t: Training = Training(), id_col: str = "page_id", url_col: str = "url") -> tuple[float, float, float]:
    """Log-loss and accuracy of the trees on the labelled URLs of the first fold, and the log-loss of their mean label; nothing of that fold is learnt from."""
    seen = _seen(_ruled(pages, rules, t, id_col, url_col), labelled, t)
    rest = seen.where("fold <> 0")
    stats, by_fold = suffix_statistics(rest.select("suffix", "fold", "label"), t.folds)
    model, share = train(with_suffixes(lexical(rest.where("label is not null")), stats, by_fold, t.folds - 1), t)
    if model is None:
        raise ValueError("labels of one kind")
    p = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = lambda p: -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))
    right = ((F.col("score") > 0.5) == (F.col("label") == 1)).cast("double")
    got = score(with_suffixes(lexical(seen.where("fold = 0 and label is not null")), stats), model).agg(F.avg(loss(p)), F.avg(right), F.avg(loss(F.lit(share)))).first()
    return got[0], got[1], got[2]
