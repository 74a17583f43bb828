"""URL filters: host suffixes and path prefixes of each URL meet the rules by short hash prefixes.

A URL is expanded into expressions, a suffix of its host and a prefix of its path each. An
expression meets the rules on the first 32 bits of its digest, the whole digest confirms
it, and of the rules that fit the longest one holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import skew_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hex digits of a digest that rules and expressions are joined on.
SHORT = 8

#: Rules are broadcast up to so many and so many characters; more of them meet the expressions by a shuffle.
BROADCAST_RULES, BROADCAST_CHARS = 50_000, 8_000_000

ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty without a `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def clean_rules(rules: DataFrame) -> DataFrame:
    """host, path, blocks of rules(host, path, verdict), a row a host and path; of equal ones with different verdicts block holds.

    Rules without a host or a known verdict and those whose path begins without a slash fit
    nothing and are left out. An empty path fits every path, the empty one included.
    """
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    sound = (F.col("host") != "") & ((F.col("path") == "") | F.col("path").startswith("/")) & F.col("verdict").isin(ALLOW, BLOCK)
    return rules.select(host.alias("host"), path.alias("path"), "verdict").where(sound).groupBy("host", "path").agg(F.bool_or(F.col("verdict") == BLOCK).alias("blocks"))


def _digest(host: Column, path: Column) -> Column:
    """No host holds a slash and each path begins with one, so equal texts are equal expressions."""
    return F.sha2(F.concat(host, path), 256)


def _expressions(host: Column, path: Column, labels: int, folders: int, lengths: list[int]) -> Column:
    """Structs of host and path lengths and the digest: the suffixes of up to so many labels times the
    prefixes that end at one of the first slashes or have one of the lengths. Rules have no others."""
    n_labels = F.least(F.size(F.split(host, r"\.")), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), n_labels), lambda k: F.call_function("substring_index", host, F.lit("."), -k))
    n_slashes = F.least(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))), F.lit(folders))
    at_slash = F.when(n_slashes > 0, F.transform(F.sequence(F.lit(1), F.greatest(n_slashes, F.lit(1))), lambda k: F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    prefixes = at_slash
    if lengths:
        fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
        prefixes = F.array_distinct(F.concat(at_slash, F.transform(fitting, lambda n: F.left(path, n))))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(F.length(h).alias("h"), F.length(p).alias("p"), _digest(h, p).alias("digest")))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """id, host, path, rule, verdict of every URL under rules(host, path, verdict).

    A rule fits its host and all hosts below it if the URL's path starts with the rule's. Of
    those that fit, the one whose host and path are longest together holds, of equally long
    ones that with the longer host. Where none fits, rule is null and the verdict the default.
    A null URL and one without `://` have an empty host and path, which no rule fits. Rows
    that repeat an id and URL, and rows without an id, stay; extra columns are not read.

    Rules of a bounded number and size are broadcast. More of them are joined by a shuffle,
    in which expressions that very many URLs have meet a bounded broadcast, so that none
    lands in one task; each URL comes out of its expressions by a grouping that is added up
    before it is shuffled.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    ruled = clean_rules(rules)
    open_end = ~F.col("path").endswith("/")
    # what rules can look like: a row of three numbers and the lengths of paths, no longer than the longest one
    shape = ruled.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.when(~open_end, F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))))).alias("folders"),
        F.collect_set(F.when(open_end, F.length("path"))).alias("lengths"), F.count("*").alias("n"), F.sum(F.length("host") + F.length("path")).alias("chars"),
    ).first()
    plain = rows.select("id", "host", "path", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("best"))
    if shape["n"]:
        made = _expressions(F.col("host"), F.col("path"), shape["labels"], shape["folders"] or 0, sorted(shape["lengths"]))
        asked = rows.where("host != ''").select("id", "host", "path", F.explode(made).alias("e")).select("id", "host", "path", "e.*").withColumn("short", F.left("digest", F.lit(SHORT)))
        known = ruled.select(_digest(F.col("host"), F.col("path")).alias("whole"), "blocks").withColumn("short", F.left("whole", F.lit(SHORT)))
        if shape["n"] <= BROADCAST_RULES and shape["chars"] <= BROADCAST_CHARS:
            met = asked.join(F.broadcast(known), "short")
        else:
            held = asked.groupBy("short").agg(F.count("*").alias("held"))
            met = skew_join(asked, known.join(held, "short"), ["short"], asked.count())
        # lengths of host and path name the rule, since both are parts of the URL's own
        best = F.shiftleft((F.col("h") + F.col("p")).cast("long"), 32) + F.col("h") * 2 + F.col("blocks").cast("long")
        hits = met.where("digest = whole").select("id", "host", "path", F.lit(0).cast("long").alias("n"), best.alias("best"))
        plain = plain.unionByName(hits)
    judged = plain.groupBy("id", "host", "path").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    of_host = F.shiftright(F.col("best").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int")
    of_path = F.shiftright("best", 32).cast("int") - of_host
    rule = F.concat(F.right("host", of_host), F.left("path", of_path))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best").bitwiseAND(F.lit(1)) == 1, BLOCK).otherwise(ALLOW)
    out = judged.select(F.col("id").alias(id_col), "host", "path", F.when(F.col("best").isNotNull(), rule).alias("rule"), verdict.alias("verdict"), "n")
    return out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n", "again")


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules(host, path, verdict) out of a list."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")
