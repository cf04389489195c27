"""Line dedup across sites.

A line that stands on many sites is boilerplate. Each line hash gets a HyperLogLog sketch of its
sites; the sketches merge by aggregation. Lines whose estimate is near the threshold get an exact
distinct count. Boilerplate lines leave every document that has a line of its own. A document of
nothing but such lines is a copy as a whole and stays as it is: its lines tell nothing apart, and
which of the copies stays is for a dedup of documents to say.

Defined cases: null text stays null and has no lines; blank lines are never boilerplate and stay;
a null site counts as none; rows that repeat a document are treated alike; an empty table gives
an empty result; further columns, of any name, pass through ``clean`` untouched, but for n_lines and
n_removed, which the counts replace.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_SITES = 5
LG_K = 12
#: Relative standard errors around the threshold within which the estimate doesn't decide.
BAND = 4


def _line_key(line: Column) -> list[Column]:
    """96 bits."""
    return [F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")]


def _lines(docs: DataFrame, *keep: Column | str) -> DataFrame:
    d = docs.select(*keep, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return d.where(F.btrim("line", F.lit(C.SPACE)) != "").select(*[c for c in d.columns if c != "line"], *_line_key(F.col("line")))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of the lines that stand on ``min_sites`` distinct sites (column ``source``) or more."""
    near = BAND * 1.04 / math.sqrt(2**LG_K) * min_sites
    on_sites = _lines(docs, F.col("source").alias("site")).where("site IS NOT NULL")
    spread = on_sites.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    spread = C.materialize(spread.where(F.col("sites") >= min_sites - near - 1), "line-spread")
    unsure = F.col("sites").between(min_sites - near - 1, min_sites + near + 1)
    asked = C.join_side(C.materialize(spread.where(unsure).select(F.col("h1").alias("n1"), F.col("h2").alias("n2")), "line-near"))
    exact = on_sites.join(asked, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites"))
    sure = spread.where(~unsure & (F.col("sites") >= min_sites))
    return C.materialize(sure.select("h1", "h2").unionByName(exact.where(F.col("sites") >= min_sites).select("h1", "h2")), "boilerplate")


@C.scoped
def clean(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text``, plus n_lines and n_removed (long)."""
    bad = C.join_side(boilerplate(docs, min_sites)).withColumnsRenamed({"h1": "b1", "h2": "b2"})
    of_id, of_text, gone = C.fresh(docs, "of_id", "of_text", "gone")
    key = F.xxhash64("text")
    found = _lines(docs, F.col("doc_id").alias("id"), key.alias("key")).join(bad, (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2")), "left_semi")
    found = found.groupBy(F.col("id").alias(of_id), F.col("key").alias(of_text)).agg(F.sort_array(F.collect_set("at")).alias(gone))
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col(of_id)) & (key == F.col(of_text)), "left")

    def removed(x: Column) -> Column:
        """Stretches between the removed places."""
        starts = F.concat(F.array(F.lit(0)), F.transform(x.gone, lambda p: p + 1))
        ends = F.concat(x.gone, F.array(F.size(x.lines)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(x.lines, a + 1, b - a))), "\n")

    lines = F.split("text", "\n")
    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(C.SPACE)) != "")), F.lit(0))
    n_found = F.coalesce(F.size(gone), F.lit(0))
    take = F.col("text").isNotNull() & (n_found > 0) & (n_found < n_lines)
    text = F.when(take, C.let(F.struct(lines.alias("lines"), F.col(gone).alias("gone")), removed)).otherwise(F.col("text"))
    kept = [text.alias(c) if c.lower() == "text" else C.col(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return both.select(*kept, F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.when(take, n_found).otherwise(0).cast("long").alias("n_removed"))
