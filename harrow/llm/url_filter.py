"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

The classifier is fitted on a small labelled URL table of at most ``max_labelled`` rows (default 20,000: the documented
bound), chosen by hash where more are given. All work is DataFrame functions and Spark's own ML stages; scoring is one
narrow pass without a shuffle, whatever the number of URLs, and skew of hosts does not matter to it.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule and is scored on no n-grams; an
empty table gives an empty result; with no labelled rows the verdict is ``allow``, with one class it is that class.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.shared import ascii_lower, read, staged

#: (host/path, verdict): fixed values of the contract.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none. A list of rules, not a table: keep it small."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        at = rule.find("/") if "/" in rule else len(rule)
        domain, prefix = rule[:at].lower(), rule[at:]
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def ngrams(text: Column, tag: str, sizes: tuple[int, ...]) -> Column:
    """Tagged character n-grams of ``^text$``."""
    t = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(f"{tag}{n}:"), F.substring(t, i, F.lit(n))))

    return F.concat(*(of(n) for n in sizes))


def featured(urls: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), buckets: int = 1 << 15) -> DataFrame:
    grams = F.concat(ngrams(F.col("host"), "h", sizes), ngrams(F.col("path"), "p", sizes))
    tf = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=buckets, binary=True)
    return tf.transform(urls.withColumn("__grams", grams)).drop("__grams")


def fit(labelled: DataFrame, max_labelled: int = 20_000):
    """A model from (host, path, verdict); or the one verdict there is, or ``allow``.

    Rows are thinned by a hash of host and path before equal ones are merged: a first pass estimates how many distinct
    ones there are, and what the hash leaves is about twice ``max_labelled``, so that no shuffle sees the whole table.
    """
    rows = labelled.select("host", "path", "verdict", F.xxhash64("host", "path").alias("h"))
    number = rows.agg(F.approx_count_distinct("h")).first()[0]
    if number > 2 * max_labelled:
        rows = rows.filter(F.pmod("h", F.lit(1 << 40)) < (1 << 41) * max_labelled // number)
    sample = staged(rows.distinct().orderBy(F.pmod("h", F.lit(1 << 40)), "h", "host", "path", "verdict").limit(max_labelled).drop("h"), "urls-labelled")
    seen = sorted(r[0] for r in sample.select("verdict").distinct().collect())  # two values at most
    if len(seen) < 2:
        return seen[0] if seen else "allow"
    train = featured(sample).withColumn("label", (F.col("verdict") == "allow").cast("double"))
    return LogisticRegression(featuresCol="__features", labelCol="label", regParam=1e-3, maxIter=40, standardization=False).fit(train)


def filter_urls(urls: DataFrame, labelled: DataFrame | None = None, rules=RULES, max_labelled: int = 20_000) -> DataFrame:
    """The columns of ``urls`` (``url`` among them) as a struct ``row`` plus host, path, rule, verdict, p_allow: no input column can clash.

    ``labelled``: (url, verdict); without it, the URLs that rules decide are the labelled ones.
    """
    parts = urls.select(F.struct(*urls.columns).alias("row"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    ruled = parts.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = ruled.filter(F.col("ruled").isNotNull()).select("host", "path", F.col("ruled.verdict").alias("verdict"))
    else:
        known = labelled.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "verdict")
    model = fit(known, max_labelled)
    if isinstance(model, str):
        scored = ruled.withColumn("p_allow", F.lit(1.0 if model == "allow" else 0.0))
    else:
        scored = model.setProbabilityCol("__p").setRawPredictionCol("").setPredictionCol("").transform(featured(ruled))
        scored = scored.withColumn("p_allow", vector_to_array("__p")[1])
    learned = F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block")
    return scored.select("row", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", learned).alias("verdict"), "p_allow")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("row.page_id", "host", "path", "rule", "verdict", "p_allow")
