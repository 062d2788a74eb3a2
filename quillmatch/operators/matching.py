"""Pairs of source and target units: by provenance header, by name, and one to one by best score first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..checkpoint import cut
from ..partitions import by_key


def header_scores(src: DataFrame, tgt: DataFrame, strict: bool = False) -> DataFrame:
    """src, tgt and score of the units (key, path) whose headers (key, origin) name them: 1.0 for the same path, 0.99 for
    a shared normal key, 0.85 for the same file name. Three equi-joins, never all pairs. ``strict`` keeps 1.0 only."""
    s = src.select(F.col("key").alias("src"), N.annotation_path(F.col("path")).alias("path"))
    t = tgt.filter("origin IS NOT NULL AND origin <> ''").select(F.col("key").alias("tgt"), N.annotation_path(N.origin_path(F.col("origin"))).alias("origin"))
    exact = s.join(t, F.col("path") == F.col("origin")).select("src", "tgt", F.lit(1.0).alias("score"))
    if strict:
        return exact.distinct()
    key = s.select("src", F.explode(N.match_keys(F.col("path"))).alias("k")).join(t.select("tgt", F.explode(N.match_keys(F.col("origin"))).alias("k")), "k").select("src", "tgt", F.lit(0.99).alias("score"))
    base = s.select("src", N.base_key(F.col("path")).alias("k")).filter("k <> ''").join(t.select("tgt", N.base_key(F.col("origin")).alias("k")), "k").select("src", "tgt", F.lit(0.85).alias("score"))
    return exact.unionByName(key).unionByName(base).groupBy("src", "tgt").agg(F.max("score").alias("score"))


def within(long: DataFrame, short: DataFrame) -> DataFrame:
    """lid and sid of long (lid, long) and short (sid, short) where the one text contains the other: an equi-join of
    the long texts' parts, of such lengths as the short ones have, instead of a comparison of all with all."""
    lengths = sorted(r[0] for r in short.filter("short IS NOT NULL").select(F.length("short")).distinct().collect())  # few numbers
    n = F.length("long")
    fitting = F.filter(F.array(*(F.lit(k) for k in lengths)).cast("array<int>"), lambda k: k <= n)
    parts = F.flatten(F.transform(fitting, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(F.col("long"), i, k))))
    return long.filter("long IS NOT NULL").select("lid", F.explode(F.array_distinct(parts)).alias("short")).join(short, "short").select("lid", "sid").distinct()


def loose_header_scores(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """As above for headers that only contain a path (1.0), end in a file name (0.9 in the same directory, else 0.5) or
    in a stem with a known extension (0.3). Three equi-joins: on parts of headers, on file names and on stems."""
    s = src.select(F.col("key").alias("src"), F.col("path"), N.file_name(F.col("path")).alias("file"), N.stem(F.col("path")).alias("stem"), N.canonical(N.parent_of(F.col("qualified"))).alias("sdir"))
    t = tgt.filter("origin IS NOT NULL AND origin <> ''").select(F.col("key").alias("tgt"), N.origin_path(F.col("origin")).alias("origin"), N.canonical(N.parent_of(F.col("qualified"))).alias("tdir"))
    last = F.regexp_extract("origin", r"([^/]*)$", 1)
    held = within(t.select(F.col("tgt").alias("lid"), F.col("origin").alias("long")), s.select(F.col("src").alias("sid"), F.col("path").alias("short"))).select(F.col("sid").alias("src"), F.col("lid").alias("tgt"), F.lit(1.0).alias("score"))
    named = s.join(t.withColumn("file", last), "file").select("src", "tgt", F.when(F.col("sdir") == F.col("tdir"), 0.9).otherwise(0.5).alias("score"))
    stems = t.filter(F.contains("origin", F.lit("/"))).withColumn("stem", F.regexp_extract(last, r"^(.*)\.(?:kt|rs|py|cpp|cc|hpp|h)$", 1)).filter(last.rlike(r"\.(?:kt|rs|py|cpp|cc|hpp|h)$"))
    by_stem = s.join(stems, "stem").select("src", "tgt", F.lit(0.3).alias("score"))
    return held.unionByName(named).unionByName(by_stem).groupBy("src", "tgt").agg(F.max("score").alias("score"))


def name_score(src: dict[str, Column], tgt: dict[str, Column]) -> Column:
    """Score of two units by name; each side has stem, qualified, package (list of parts) and header (target only)."""
    s, t = N.canonical(src["stem"]), N.canonical(tgt["stem"])
    sp, tp = N.parent_of(src["qualified"]), N.parent_of(tgt["qualified"])
    same_dir = (N.canonical(sp) == N.canonical(tp)) & (sp != "")
    last = lambda p: N.package_normal(F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit("")))
    sim = N.package_similarity(src["package"], tgt["package"])
    ls, lt = last(src["package"]), last(tgt["package"])
    boost = F.when(tgt["header"], 0.02).otherwise(0.0)
    score = (
        F.when(N.canonical(src["qualified"]) == N.canonical(tgt["qualified"]), 1.0).when((s == t) & same_dir & (tp != ""), 0.95).when(s == t, 0.7)
        .when(F.contains(t, s), 0.5 + 0.2 * F.length(s) / F.greatest(F.length(t), F.lit(1))).when(F.contains(s, t), 0.5 + 0.2 * F.length(t) / F.greatest(F.length(s), F.lit(1)))
        .when((F.size(src["package"]) > 0) & (F.size(tgt["package"]) > 0) & (sim > 0.5), sim * 0.6)
        .when((F.size(src["package"]) > 0) & F.contains(t, ls), 0.5).when((F.size(tgt["package"]) > 0) & F.contains(s, lt), 0.5).when(same_dir, 0.4)
    )
    return F.coalesce(score + boost, F.lit(0.0))


def name_scores(src: DataFrame, tgt: DataFrame, least: float = 0.4) -> DataFrame:
    """src, tgt and score above ``least`` (0.4 or more). Every rule that gives such a score says that names or last parts
    of packages are equal or contain each other, or that directories are equal, so candidates come from equi-joins."""
    side = lambda d, *more: d.select("key", "stem", "qualified", "package", *more).withColumns({"n": N.canonical(F.col("stem")), "q": N.canonical(F.col("qualified")), "dir": N.canonical(N.parent_of(F.col("qualified"))), "last": N.package_normal(F.try_element_at("package", F.lit(-1)))})
    s, t = side(src), side(tgt, "header")
    of = lambda d, c, a, b: d.select(F.col("key").alias(a), F.col(c).alias(b))
    found = s.select(F.col("key").alias("src"), "q").join(t.select(F.col("key").alias("tgt"), "q"), "q").select("src", "tgt")
    found = found.unionByName(s.filter("dir <> ''").select(F.col("key").alias("src"), "dir").join(t.select(F.col("key").alias("tgt"), "dir"), "dir").select("src", "tgt"))
    for a, b in (("n", "n"), ("last", "last"), ("last", "n")):
        found = found.unionByName(within(of(t, b, "lid", "long"), of(s, a, "sid", "short")).select(F.col("sid").alias("src"), F.col("lid").alias("tgt")))
        found = found.unionByName(within(of(s, b, "lid", "long"), of(t, a, "sid", "short")).select(F.col("lid").alias("src"), F.col("sid").alias("tgt")))
    ends = lambda d, k, p: d.select(F.col("key").alias(k), *(F.col(c).alias(f"{p}_{c}") for c in d.columns if c != "key"))
    both = found.distinct().join(ends(src.select("key", "stem", "qualified", "package"), "src", "s"), "src").join(ends(tgt.select("key", "stem", "qualified", "package", "header"), "tgt", "t"), "tgt")
    score = name_score({c: F.col(f"s_{c}") for c in ("stem", "qualified", "package")}, {c: F.col(f"t_{c}") for c in ("stem", "qualified", "package", "header")})
    return both.select("src", "tgt", score.alias("score")).filter(F.col("score") > least)


def exact_name_scores(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """The pairs that score 0.7 or more by name - the same stem or qualified name - by an equi-join."""
    s = src.select(F.col("key").alias("src"), N.canonical(F.col("stem")).alias("k"), N.canonical(F.col("qualified")).alias("sq"), N.canonical(N.parent_of(F.col("qualified"))).alias("sp"))
    t = tgt.select(F.col("key").alias("tgt"), N.canonical(F.col("stem")).alias("k"), N.canonical(F.col("qualified")).alias("tq"), N.canonical(N.parent_of(F.col("qualified"))).alias("tp"), "header")
    score = F.when(F.col("sq") == F.col("tq"), 1.0).when((F.col("sp") == F.col("tp")) & (F.col("sp") != ""), 0.95).otherwise(0.7) + F.when(F.col("header"), 0.02).otherwise(0.0)
    return s.join(t, "k").select("src", "tgt", score.alias("score"))


def greedy(edges: DataFrame, *order: Column) -> DataFrame:
    """One-to-one pairs, best first: what taking the edges (src, tgt, score) in order, each if both ends are free, gives.

    In a total order this equals taking, round after round, every edge that is the best left at both its ends. Each
    round is two aggregations and two anti-joins on the edges left, with a checkpoint. Ties go by ``order``, then by
    shorter target, target and source."""
    rank = F.struct((-F.col("score")).alias("s"), *(c.alias(f"o{i}") for i, c in enumerate(order)), F.length("tgt").alias("l"), "tgt", "src")
    left, taken = cut(edges.select("src", "tgt", "score", rank.alias("rank"))), None
    while not left.isEmpty():
        best_s, best_t = left.groupBy("src").agg(F.min("rank").alias("rank")), left.groupBy("tgt").agg(F.min("rank").alias("rank"))
        now = cut(left.join(best_s, ["src", "rank"]).join(best_t, ["tgt", "rank"]).select("src", "tgt", "score"))
        taken = now if taken is None else taken.unionByName(now)
        left = cut(left.join(now.select("src"), "src", "left_anti").join(now.select("tgt"), "tgt", "left_anti"))
    return taken if taken is not None else edges.select("src", "tgt", "score").limit(0)


def pooled(edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Targets that no match took, each with the matched source for which it scores best."""
    more = edges.join(matches.select("tgt"), "tgt", "left_anti").join(matches.select("src").distinct(), "src", "left_semi")
    return more.groupBy("tgt").agg(F.min(F.struct((-F.col("score")).alias("s"), "src")).alias("b")).select("tgt", F.col("b.src").alias("src"), (-F.col("b.s")).alias("score"))


def unmatched(units: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    return units.join(matches.select(F.col(side).alias("key")).distinct(), "key", "left_anti")


def ratio_stub(src_code: Column, tgt_code: Column) -> Column:
    return (src_code > 20) & (tgt_code.cast("double") / F.greatest(src_code, F.lit(1)) < 0.3)


def function_score(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """pair and score: candidates (pair, name, src_fn, tgt_fn, sim, src_stub, tgt_stub) one to one, best first, within
    each name; a target stub for a source that is none scores 0. The sum over the pair's number of source functions."""

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        left, taken = rows.sort_values(["sim", "src_fn", "tgt_fn"], ascending=[False, True, True]), []
        while len(left):  # all that are the best left at both ends at once
            best = left[~left["src_fn"].duplicated() & ~left["tgt_fn"].duplicated()]
            taken.append(best)
            left = left[~left["src_fn"].isin(best["src_fn"]) & ~left["tgt_fn"].isin(best["tgt_fn"])]
        return pd.concat(taken)[["pair", "src_fn", "tgt_fn", "sim"]]

    guarded = candidates.withColumn("sim", F.when(F.col("tgt_stub") & ~F.col("src_stub"), 0.0).otherwise(F.col("sim")))
    matched = guarded.groupBy("pair", "name").applyInPandas(take, "pair long, src_fn int, tgt_fn int, sim double")
    sums = matched.groupBy("pair").agg(F.sum("sim").alias("total"), F.count("*").alias("matched"))
    n = sources.groupBy("pair").agg(F.count("*").alias("functions"))
    return n.join(sums, "pair", "left").select("pair", F.coalesce("matched", F.lit(0)).alias("matched"), (F.coalesce("total", F.lit(0.0)) / F.col("functions")).alias("score"))


def _both_sides(src: DataFrame, tgt: DataFrame, *more: str) -> DataFrame:
    """src and tgt (pair, name, and ``more`` that both have) in one table, with the canonical name and whether it is of src.
    A pair's rows are in one partition, of a bounded size, so that whatever is counted of its names needs no other shuffle,
    and no table of names where the rows come from."""
    side = lambda d, own: d.select("pair", N.canonical(F.col("name")).alias("name"), F.lit(own).alias("own"), *(F.expr(c) for c in more))
    return by_key(side(src, True).unionByName(side(tgt, False)), "pair", rows=src.count() + tgt.count())


def _counts() -> tuple[Column, Column]:
    return F.count_if("own").alias("s"), F.count_if(~F.col("own")).alias("t")


def _met() -> Column:
    """Whether a name of a pair is one of the target's; nulls equal nothing."""
    return (F.col("t") > 0) & F.col("pair").isNotNull() & F.col("name").isNotNull()


def name_coverage(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """pair, total and matched of functions (pair, name, is_test, pos): distinct source names that the target has; a test
    needs a target test. Whether a name is a test is told by its first occurrence."""
    mine = lambda c: F.when(F.col("own"), c)
    pos, is_ = F.col("pos"), F.col("is_test")
    # numbers only, which a hash table can hold; where both are first at one place, it is no test
    first = F.min(mine(F.when(is_, pos))).alias("test"), F.min(mine(F.when(~is_, pos))).alias("plain"), F.min(mine(is_)).alias("least")
    names = _both_sides(src, tgt, "is_test", "pos").groupBy("pair", "name").agg(*_counts(), *first, F.max(F.when(~F.col("own"), is_)).alias("tests"))
    test, plain = F.col("test"), F.col("plain")
    is_test = F.when(test.isNull() & plain.isNull(), F.col("least")).when(plain.isNull(), True).when(test.isNull(), False).otherwise(test < plain)
    ok = _met() & (~is_test | F.coalesce("tests", F.lit(False)))
    return names.filter("s > 0").groupBy("pair").agg(F.count("*").alias("total"), F.count_if(ok).alias("matched"))


def bag_coverage(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """pair, total and matched where names count as often as they occur on both sides."""
    names = _both_sides(src, tgt).groupBy("pair", "name").agg(*_counts())
    return names.filter("s > 0").groupBy("pair").agg(F.sum("s").alias("total"), F.sum(F.when(_met(), F.least("s", "t")).otherwise(0)).alias("matched"))


def type_coverage(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """pair, total, matched and the missing names of distinct types."""
    names = _both_sides(src, tgt, "name AS given").groupBy("pair", "name").agg(*_counts(), F.min(F.when(F.col("own"), F.col("given"))).alias("first")).filter("s > 0")
    return names.groupBy("pair").agg(F.count("*").alias("total"), F.count_if(_met()).alias("matched"), F.array_join(F.array_sort(F.collect_list(F.when(~_met(), F.col("first")))), ",").alias("missing"))


def stub_mismatch(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """pair and name of the target's stubs beyond those that the source has, as often as they are too many."""
    names = _both_sides(src.filter("has_stub"), tgt.filter("has_stub")).groupBy("pair", "name").agg(*_counts())
    return names.filter("t > s").select("pair", "name", F.explode(F.sequence(F.col("s") + 1, F.col("t")))).select("pair", "name")


def missing_by_dependents(degrees: DataFrame, matches: DataFrame) -> DataFrame:
    return unmatched(degrees.select("key", "dependents"), matches, "src").orderBy(F.desc("dependents"), "key")


def ranked(df: DataFrame, by: list[Column], name: str = "rank", partition: list[str] | None = None) -> DataFrame:
    """df with each row's place, within its partition or among all rows; of all, ranges are numbered where they are, and
    begin where those before them end."""
    if partition:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*by)))
    spread = cut(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = spread.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return spread.withColumn(name, place).join(F.broadcast(starts), "_range").withColumn(name, (F.col(name) + F.col("_start")).cast("int")).select(*df.columns, name)


def proposals(src: DataFrame, tgt: DataFrame, scores: DataFrame) -> DataFrame:
    """src, tgt, the header that the target has and the one it should have, of pairs that met by less than the same path;
    each once."""
    s = src.select(F.col("key").alias("src"), N.provenance_header(F.col("path")).alias("expected"))
    t = tgt.select(F.col("key").alias("tgt"), F.col("origin").alias("found"))
    return scores.filter("score < 1").join(s, "src").join(t, "tgt").select("src", "tgt", "found", "expected").dropDuplicates()


def suspicious(pairs: DataFrame) -> DataFrame:
    """src, tgt and what of pairs (src, tgt, src_text, tgt_text) of Rust and Kotlin: suppressions, and type aliases that
    the source doesn't have."""
    t = F.col("tgt_text")
    hidden = pairs.filter(F.contains(t, F.lit("@Suppress")) | F.contains(t, F.lit("@file:Suppress")) | F.contains(t, F.lit("SuppressWarnings"))).select("src", "tgt", F.lit("suppression").alias("what"))
    names = lambda c, word: F.regexp_extract_all(c, F.lit(rf"\b{word}\s+(\w+)"), 1)
    own = pairs.select("src", "tgt", F.explode(names("tgt_text", "typealias")).alias("name")).withColumn("k", N.canonical(F.col("name")))
    known = pairs.select("src", "tgt", F.explode(names("src_text", "type")).alias("name")).select("src", "tgt", N.canonical(F.col("name")).alias("k"))
    return hidden.unionByName(own.join(known, ["src", "tgt", "k"], "left_anti").select("src", "tgt", F.concat(F.lit("typealias "), "name").alias("what")))
