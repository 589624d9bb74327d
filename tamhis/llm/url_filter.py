"""URL verdicts: rules by host and path first, gradient-boosted trees on lexical features for the rest."""

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamhis.llm.common import col, join_classes
from tamhis.workspace import written

#: Rules are compiled into one expression; more than this is an error.
MAX_RULES = 1000
#: Weight of the overall rate in the rate of a host's suffix (its last one or last two labels).
SUFFIX_PRIOR = 20.0
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters",
            "fragment", "longest_label", "suffix1", "suffix2")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    """``example.com/en/`` -> its host and the path it asks for."""
    name, slash, rest = rule.partition("/")
    return name.lower(), slash + rest


def matching_rule(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, text) that fits, else null; the first given wins a tie.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("string")
    for _, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        name, start = split_rule(rule)
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def _suffix(host_col: Column, n: int) -> Column:
    return F.substring_index(host_col, ".", -n)


def _letters(c: Column) -> Column:
    """Entropy of the characters in bits."""
    size = F.length(c)

    def part(letter):
        p = (size - F.length(F.replace(c, letter, F.lit("")))) / size
        return -p * F.log2(p)

    return F.when(size > 0, F.aggregate(F.transform(F.array_distinct(F.split(c, "")), lambda x: F.when(x != "", part(x)).otherwise(0.0)),
                                        F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def lexical(url: Column, host_col: Column, path_col: Column) -> dict[str, Column]:
    """Features of a url by name; those of a null url are those of an empty one."""
    u = F.coalesce(url, F.lit(""))
    size = F.greatest(F.length(u), F.lit(1))
    query = F.regexp_extract(_rest(u), r"\?([^#]*)", 1)
    columns = {
        "length": F.length(u),
        "host_length": F.length(host_col),
        "path_length": F.length(path_col),
        "depth": F.regexp_count(path_col, F.lit("/[^/]")),
        "labels": F.when(host_col == "", 0).otherwise(F.size(F.split(host_col, r"\."))),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / size,
        "hyphens": F.regexp_count(host_col, F.lit("-")),
        "entropy": _letters(u),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "fragment": F.contains(u, F.lit("#")).cast("int"),
        "longest_label": F.array_max(F.transform(F.split(host_col, r"\."), F.length)),
    }
    return {n: c.cast("double") for n, c in columns.items()}


def _with_suffix_rates(df: DataFrame, host_col: str, stats: DataFrame, overall: float) -> DataFrame:
    """Add suffix1 and suffix2: the block rate of the host's suffixes, the overall rate for those without statistics.

    ``df`` is a stored table. Rates are looked up once per different suffix of its rows; those that many rows share are
    broadcast, the others joined, so neither the number of suffixes nor a frequent one is a burden.
    """
    def rated(found, n):
        own = stats.filter(F.col("n") == n).select(F.col("suffix").alias(f"_suffix{n}"), F.col("rate").alias(f"suffix{n}"))
        return found.join(own, f"_suffix{n}", "left").withColumn(f"suffix{n}", F.coalesce(f"suffix{n}", F.lit(overall)))

    keyed = df.withColumn("_suffix2", _suffix(F.col(host_col), 2))
    pairs = written(rated(keyed.groupBy("_suffix2").agg(F.count("*").alias("_rows")), 2)
                    .withColumn("_suffix1", _suffix(F.col("_suffix2"), 1)), "url-suffixes")
    last = written(rated(pairs.groupBy("_suffix1").agg(F.count("*").alias("_pairs")), 1), "url-suffixes")
    both = written(join_classes(pairs, last, ["_suffix1"], "_pairs").drop("_suffix1", "_pairs"), "url-suffixes")
    return join_classes(keyed, both, ["_suffix2"], "_rows").drop("_suffix2", "_rows")


class UrlModel:
    """Trees and suffix statistics learnt from urls with a label (1: block). Built-in functions throughout."""

    def __init__(self, labelled: DataFrame, seed: int = 0):
        """``labelled``: (url, label). Null urls and labels are ignored; copies of a url count once.

        Suffix statistics and trees cover all of them. With one class only, everything gets that class; with none, nothing
        is blocked.
        """
        urls = written(labelled.dropna().groupBy("url").agg(F.max("label").cast("double").alias("label"))
                       .withColumn("host", host(F.col("url"))), "labelled-urls")
        n, blocked = urls.select(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        self.rate = blocked / n if n else 0.0
        each = urls.select("label", F.explode(F.array(*[
            F.struct(F.lit(k).alias("n"), _suffix(F.col("host"), k).alias("suffix")) for k in (1, 2)])).alias("s"))
        rates = each.groupBy("s.n", "s.suffix").agg(F.count("*").alias("size"), F.sum("label").alias("blocked")).withColumn(
            "rate", (F.col("blocked") + SUFFIX_PRIOR * self.rate) / (F.col("size") + SUFFIX_PRIOR))
        self.suffixes = written(rates.select("n", "suffix", "rate"), "suffix-rates")
        self.trees = None
        if 0 < self.rate < 1:
            rows = _with_suffix_rates(urls, "host", self.suffixes, self.rate).withColumns({"path": path(F.col("url"))})
            rows = self._vectors(rows.withColumns(lexical(F.col("url"), F.col("host"), F.col("path"))))
            # in a fixed order, as sums of the trees' statistics, which decide between equal splits, depend on it
            rows = rows.orderBy("label", F.xxhash64("url", F.lit(seed)), "url")
            table = written(rows.select("label", "features"), "url-features")
            self.trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, maxBins=32, seed=seed).fit(table)

    @staticmethod
    def _vectors(df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)

    def scores(self, df: DataFrame) -> DataFrame:
        """Add ``score`` (probability of block) to rows with url, host and path, a stored table."""
        if self.trees is None:
            return df.withColumn("score", F.lit(float(self.rate)))
        names = df.columns
        wide = _with_suffix_rates(df, "host", self.suffixes, self.rate)
        wide = self._vectors(wide.withColumns(lexical(F.col("url"), F.col("host"), F.col("path"))))
        scored = self.trees.transform(wide)
        return scored.select(*[col(c) for c in names], vector_to_array("probability")[1].alias("score"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row; ``rules`` are (``allow`` or ``block``, host and path).

    The longest fitting rule decides; other urls get the verdict of trees learnt from the urls that rules decide:
    block from a score of 0.5. A null url, or one without ``://``, has an empty host and path and is
    judged by the trees. Rows are independent, repeated rows get equal verdicts; an empty table gives no rows.
    """
    rows = pages.select(col(key).alias("key"), col(url).cast("string").alias("url"))
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rows = written(rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)), "urls")
    given = verdict_of(F.col("rule"), rules)
    labelled = rows.filter("rule is not null").select("url", (given == "block").cast("int").alias("label"))
    scored = UrlModel(labelled).scores(rows)
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce(given, by_model).alias("verdict"), "score")
