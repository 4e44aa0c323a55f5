"""Allow and block rules on urls by a sort-merge range join (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodia.llm.splitters import range_of, sampled_splitters
from episodia.session import written

LOWEST = -(1 << 63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query, given by its contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Each rule with the stack of rules open once it has opened, innermost first.

    The canonical key is the reversed host, ``/`` and the path; a rule is the
    interval of keys that start with its key, so intervals nest or are apart.
    Of rules with the same host and path, ``allow`` is taken.
    """
    keyed = (
        rules.filter(F.col("host").isNotNull() & (F.col("host") != "")).select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .select(F.concat(F.concat_ws(".", _labels(F.col("host"))), F.lit("/"), "path").alias("key"), F.concat("host", "path").alias("rule"),
                F.size(_labels(F.col("host"))).alias("depth"), F.length("path").alias("_p"), "verdict")
    )
    opened = keyed.select("key", F.struct(F.length("key").alias("len"), "key", "rule", "depth", "verdict").alias("own"))
    prefixes = keyed.select(F.col("key").alias("of"), F.explode(F.transform(F.sequence(F.lit(0), F.col("_p")), lambda n: F.col("key").substr(F.lit(1), F.length("key") - n))).alias("key"))
    # a stack holds at most one rule for each character of the path
    return prefixes.join(opened, "key").groupBy(F.col("of").alias("key")).agg(F.sort_array(F.collect_list("own"), asc=False).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The longest rule that fits each url, and its verdict.

    A url probes one canonical key for each suffix of its host that is no
    deeper than the deepest rule.  Probes and rule openings are sorted together,
    range by range (boundaries from a sample, with the page in the key, so a hot
    url is split); a running column carries the stack of the last rule opened,
    rules that do not enclose the probe are closed, and the innermost that is
    left fits.  A range starts with the stack open at its lower end.  Over the
    suffixes of one url the longest rule text wins, then the deeper host.

    Returns ``id_col``, ``host``, ``path``, ``rule`` (null if none fits) and
    ``verdict`` (``default`` if none fits).  Null urls and urls without ``://``
    have empty host and path.  Repeated rows are judged one by one; other
    columns are ignored; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = written(pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_u")), "hosts")
    stacks = written(rule_stacks(rules), "stacks")
    depth = stacks.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\.")))).first()[0] or 0
    labels = _labels(F.col("host"))
    probes = (
        rows.filter("host <> ''").withColumn("_l", F.slice(labels, 1, max(depth, 1)))
        .select("_u", F.explode(F.transform(F.sequence(F.lit(1), F.size("_l")), lambda n: F.concat(F.concat_ws(".", F.slice("_l", F.lit(1), n)), F.lit("/"), F.col("path")))).alias("_key"))
        .select("_key", F.xxhash64("_u").alias("_t"), "_u")
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    n = rows.count() * max(depth, 1)
    cuts = sampled_splitters(probes.withColumn("_one", F.lit(1)), ["_key", "_t", "_u"], "_one", n, ranges)
    types = ["string", "long", "long"]
    at = range_of([F.col("_key"), F.col("_t"), F.col("_u")], cuts, types)
    opens = stacks.select(F.col("key").alias("_key"), F.lit(LOWEST).alias("_t"), F.lit(LOWEST).alias("_u"), "stack")
    opens = opens.withColumn("_r", at)
    events = probes.withColumn("stack", F.lit(None).cast(stacks.schema["stack"].dataType)).withColumn("_r", at).unionByName(opens)
    # the stack open at the lower end of each range; one row for each range
    last = opens.groupBy("_r").agg(F.max_by("stack", "_key").alias("_s"))
    numbers = spark.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_r")).join(last, "_r", "left")
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carried = numbers.select("_r", F.last("_s", ignorenulls=True).over(before).alias("_carried"))
    sweep = Window.partitionBy("_r").orderBy("_key", "_t", "_u").rowsBetween(Window.unboundedPreceding, 0)
    met = (
        events.withColumn("_open", F.last("stack", ignorenulls=True).over(sweep)).filter("stack is null")
        .join(carried, "_r", "left")
        .withColumn("_fit", F.get(F.filter(F.coalesce("_open", "_carried"), lambda s: F.col("_key").startswith(s["key"])), F.lit(0)))
        .filter("_fit is not null")
        .groupBy("_u").agg(F.max(F.struct(F.length("_fit.rule").alias("n"), F.col("_fit.depth").alias("depth"), F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("verdict"))).alias("_best"))
    )
    return rows.join(met, "_u", "left").select(id_col, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def op8_sorted_sweep(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


OP8_SQL = r"""
with u as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (
  select *, (host = 'net' or host like '%.net') and starts_with(path, '/') as a,
         (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') as b,
         (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') as c,
         (host = 'org' or host like '%.org') and starts_with(path, '/fr/') as d from p)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path,
       case when b then 'example.net/en/' when c then 'example.com/de/' when d then 'org/fr/' when a then 'net/' end as rule,
       case when b then 'allow' when c then 'block' when d then 'allow' when a then 'block' else 'allow' end as verdict
from m"""
