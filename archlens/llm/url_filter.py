"""URL filtering by listed rules: a blocked Bloom filter in front of an exact hash join.

A rule is a host and a path; it fits a URL whose host is the rule's or a subdomain of it and whose path starts with
the rule's. The filter holds the hosts of the list and its whole rules; each key sets ``PROBES`` bits of one 512-bit block. First the
suffixes of a URL's host are tested; those that pass are joined with the listed hosts and the lengths of the paths listed
there. Only prefixes of these lengths are tested as whole rules; the few that pass are joined with the list, which
removes false positives, and the longest rule decides. So a URL costs one test for each label of its host, however long the list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.bloom import BlockedBloom, build_filter
from archlens.llm.common import Scratch, sliced

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: What holds for a URL that no rule fits.
OTHERWISE = "allow"


def parts(url: str = "url"):
    """Columns host and path of a URL, as the module says; both empty without ``://``."""
    has = F.coalesce(F.instr(F.col(url), "://") > 0, F.lit(False))
    after = F.substr(F.col(url), F.instr(F.col(url), "://") + F.lit(3))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, host).otherwise(F.lit("")), F.when(has, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = OTHERWISE) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages(page_id, url, ...); rules: (host, path, verdict).

    rule is host + path of the longest rule that fits (of equally long ones that with the longer host, then the first by
    text), else null with verdict ``otherwise``. A null URL and one without ``://`` have an empty host and path.
    Rules that repeat count once, a block before an allow. Rows that repeat a page_id are judged each. Empty
    tables are fine; further columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    listed = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host is not null and r_path is not null").groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    hashed = scratch.put(listed.withColumn("key", F.xxhash64("r_host", "r_path")), "rules")
    # At most as many lengths for a host as its longest path has characters.
    hosts = scratch.put(hashed.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths")).withColumn("key", F.xxhash64("r_host")), "hosts")
    bloom = build_filter(hashed.select("key").unionByName(hosts.select("key")))
    sent = spark.sparkContext.broadcast(bloom)

    def passing(batches):
        import pyarrow as pa

        for batch in sliced(batches, 8192):
            yield batch.filter(pa.array(sent.value.test(batch.column("key").to_numpy())))

    def tested(keys: DataFrame) -> DataFrame:
        return keys.mapInArrow(passing, keys.schema)

    host, path = parts()
    rows = scratch.put(pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")), "urls")
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    near = tested(rows.select("row", "path", F.explode(suffixes).alias("k_host")).withColumn("key", F.xxhash64("k_host")))
    known = near.drop("key").join(hosts.select("r_host", "lengths"), F.col("k_host") == F.col("r_host")).select("row", "path", "k_host", F.explode("lengths").alias("n"))
    keys = known.where(F.length("path") >= F.col("n")).select("row", "k_host", F.substring("path", F.lit(1), F.col("n")).alias("k_path"))
    hits = tested(keys.withColumn("key", F.xxhash64("k_host", "k_path")))
    same = (F.col("key") == F.col("r_key")) & (F.col("k_host") == F.col("r_host")) & (F.col("k_path") == F.col("r_path"))
    fits = hits.join(hashed.withColumnRenamed("key", "r_key"), same)
    text = F.concat("r_host", "r_path")
    best = fits.groupBy("row").agg(F.min(F.struct((-F.length(text)).alias("n"), (-F.length("r_host")).alias("m"), text.alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    told = rows.join(best, "row", "left")
    return told.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


#: The same for DuckDB.
ORACLE = r"""
with rules(r_host, r_path, r_verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
u as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
f as (select *, row_number() over (partition by page_id order by length(r_host || r_path) desc nulls last, length(r_host) desc, r_host || r_path) as n
  from u left join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
select page_id, host, path, r_host || r_path as rule, coalesce(r_verdict, 'allow') as verdict from f where n = 1
"""
