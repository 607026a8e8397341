"""Statistics over temporal facts and over revision metadata.

Times are formatted in UTC whatever the session's zone. Open windows have no
end to format: their end bucket is ``open``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.literals import instant
from kgloom.operators.temporal import TRIPLE, resources
from kgloom.plans.durable import by_key, cut
from kgloom.vocab import DBP, OPEN_END, PAGE_ID, RDF_TYPE_IRI

SECOND, DAY, MONTH, YEAR = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM", "yyyy"


def stamp(t: Column, pattern: str) -> Column:
    return F.when(t == OPEN_END, F.lit("open")).otherwise(F.date_format(instant(t), pattern))


def quantiles(counts: DataFrame, by: list[str], x: str, points: dict[str, float]) -> DataFrame:
    """(by, points): exact quantiles of a long, values that occur, from (by, x, n) with each value once and its count.

    Ranks are looked up first among ranges of 2^16 values, then within the
    ranges they fall into, so no task holds all values of a group.
    """
    counts = counts.where(F.col(x).isNotNull()).withColumn("_range", F.shiftright(x, 16))
    own = Window.partitionBy(*by)
    sums = counts.groupBy(*by, "_range").agg(F.sum("n").alias("m"))
    sums = sums.withColumns({"end": F.sum("m").over(own.orderBy("_range")), "total": F.sum("m").over(own)})
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.col("total") * p)).cast("long")
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (rank(p) - F.col("end") + F.col("m")).alias("rank")) for k, p in points.items()]))
    asked = sums.withColumn("q", asked).where((F.col("q.rank") > 0) & (F.col("q.rank") <= F.col("m")))
    asked = asked.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_r"), "q.name", "q.rank")
    same = F.col("_range") == F.col("_r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    near = counts.join(asked, same).withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "name").orderBy(x)))
    found = near.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col(x))).alias(k) for k in points])


def _matched(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Rows of equal ``by``, missing ones included; one row each."""
    if not by:
        return a.crossJoin(b)
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(b.withColumnsRenamed({c: f"_{c}" for c in by}), same, "left").drop(*[f"_{c}" for c in by])


_QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def spread(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, mean, median, std, min, max, q25, q75) of a long; quantiles are exact and values that occur.

    Each value is counted once, and the counts are kept: all else is worked out from them.
    """
    counts = cut(rows.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n")))
    v = F.col(x).cast("double")
    means = counts.groupBy(*by).agg((F.sum(v * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("total"), F.min(x).alias("min"), F.max(x).alias("max"))
    off = _matched(counts, means.select(*by, "mean"), by).groupBy(*by).agg(F.sum(F.col("n") * (v - F.col("mean")) * (v - F.col("mean"))).alias("off"))
    out = _matched(_matched(means, off, by), quantiles(counts, by, x, _QUARTILES), by)
    std = F.when(F.col("total") > 1, F.sqrt(F.col("off") / (F.col("total") - 1)))
    return out.select(*by, "mean", "median", std.alias("std"), "min", "max", "q25", "q75")


def unique_windows(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count_distinct("tStart", "tEnd").alias("count"))


def triples_per_subject(facts: DataFrame) -> DataFrame:
    return facts.groupBy("head").agg(F.count_distinct("rel", "tail").alias("count"))


def revisions_per_page(facts: DataFrame) -> DataFrame:
    """(head, count): facts of the heads that have a page id."""
    pages = facts.where(F.col("rel") == PAGE_ID).select("head").distinct()
    return facts.join(pages, "head", "left_semi").groupBy("head").agg(F.count("*").alias("count"))


def changes_per_predicate(facts: DataFrame) -> DataFrame:
    value = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    none = F.lit(None).cast("string")
    values = F.array(F.when(F.col("tail").isNotNull(), value("tail", F.col("tail"), none)), F.when(F.col("rStart").isNotNull() & F.col("rEnd").isNotNull(), value("window", F.col("rStart"), F.col("rEnd"))))
    seen = by_key(facts, "head", "rel").select("head", "rel", F.explode(values).alias("v")).distinct()
    return seen.groupBy("head", "rel").agg(F.count_if(F.col("v.kind") == "tail").alias("unique_changes"), F.count_if(F.col("v.kind") == "window").alias("all_changes"))


def revisions_over_time(facts: DataFrame, end: bool = False) -> DataFrame:
    """(time, count): distinct revisions that open (or close) windows, by the second."""
    t, r = (F.col("tEnd"), "rEnd") if end else (F.col("tStart"), "rStart")
    return facts.groupBy(stamp(t, SECOND).alias("time")).agg(F.count_distinct(r).alias("count"))


def triples_over_time(facts: DataFrame, end: bool = False) -> DataFrame:
    """(year, count): distinct (second, triple) by the year in which windows open (or close)."""
    t = F.col("tEnd") if end else F.col("tStart")
    return by_key(facts.select(t.alias("t"), *TRIPLE), *TRIPLE).distinct().groupBy(stamp(F.col("t"), YEAR).alias("year")).agg(F.count("*").alias("count"))


def changes_over_time(facts: DataFrame) -> DataFrame:
    """(time, count): openings and closings together, by the second."""
    return facts.select(F.explode(F.array("tStart", "tEnd")).alias("t")).groupBy(stamp(F.col("t"), SECOND).alias("time")).agg(F.count("*").alias("count"))


def _degrees(facts: DataFrame, incoming: bool, known: bool) -> DataFrame:
    rows = resources(facts, known) if incoming else facts
    node, other = ("tail", "head") if incoming else ("head", "tail")
    return rows.groupBy(F.year(instant(F.col("tStart"))).alias("year"), node).agg(F.count(other).alias("degree"))


def degree_frequency(facts: DataFrame, incoming: bool, known: bool = False) -> DataFrame:
    """(year, degree, count) of in-degrees over resources, or of out-degrees over all facts."""
    return _degrees(facts, incoming, known).groupBy("year", "degree").agg(F.count("*").alias("count"))


def degree_distribution(facts: DataFrame, incoming: bool, known: bool = False) -> DataFrame:
    return spread(_degrees(facts, incoming, known), ["year"], "degree")


def _spans(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("tStart") <= F.col("tEnd")).withColumn("duration", F.try_subtract(F.col("tEnd"), F.col("tStart")))


def activity_span(facts: DataFrame, by_year: bool = False) -> DataFrame:
    """Spread of window lengths in seconds, over all or by the year of opening; open windows count as they are."""
    return spread(_spans(facts).withColumn("year", F.year(instant(F.col("tStart")))), ["year"] if by_year else [], "duration")


def parts_over_time(facts: DataFrame, part: str, monthly: bool = False) -> DataFrame:
    """(time, new, ended, valid, changes): distinct subjects, predicates or objects by month or year.

    ``valid`` counts the parts of facts that are valid at some moment of the
    bucket; open windows are valid up to the last bucket in which any fact
    opens or closes. changes = new + ended.
    """
    x = {"subject": "head", "predicate": "rel", "object": "tail"}.get(part, part)
    pattern = MONTH if monthly else YEAR
    number = lambda t: F.year(t) * 12 + F.month(t) - 1 if monthly else F.year(t)
    last = facts.agg(F.max(F.greatest(F.col("tStart"), F.when(F.col("tEnd") < OPEN_END, F.col("tEnd"))))).first()[0]
    rows = facts.select(F.col(x).alias("x"), instant(F.col("tStart")).alias("a"), instant(F.when(F.col("tEnd") < OPEN_END, F.col("tEnd"))).alias("z"), instant(F.least(F.col("tEnd"), F.lit(last))).alias("v"))
    rows = rows.select("x", number(F.col("a")).alias("a"), number(F.col("z")).alias("z"), number(F.col("v")).alias("v"))
    spans = F.when(F.col("a") <= F.col("v"), F.sequence("a", "v"))
    mark = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("t"))
    events = F.concat(F.array(mark("new", F.col("a")), mark("ended", F.col("z"))), F.coalesce(F.transform(spans, lambda t: mark("valid", t)), F.array().cast("array<struct<kind:string,t:int>>")))
    seen = rows.select("x", F.explode(events).alias("e")).select("x", "e.kind", "e.t").where("t is not null").distinct()
    n = lambda k: F.count_if((F.col("kind") == k) & F.col("x").isNotNull())
    out = seen.groupBy("t").agg(n("new").alias("new"), n("ended").alias("ended"), n("valid").alias("valid"))
    time = F.concat_ws("-", F.lpad(F.floor(F.col("t") / 12).cast("string"), 4, "0"), F.lpad((F.col("t") % 12 + 1).cast("string"), 2, "0")) if monthly else F.col("t").cast("string")
    return out.select(time.alias("time"), "new", "ended", "valid", (F.col("new") + F.col("ended")).alias("changes"))


_BUCKETS = {"yearly": YEAR, "monthly": MONTH, "daily": DAY, "hourly": "yyyy-MM-dd HH", "instant": SECOND}


def snapshot_statistics(facts: DataFrame, granularities: list[str]) -> DataFrame:
    """One row per granularity: distinct versions, and growth between the second opening after 1970 and the last one."""
    # the two smallest openings after 1970: a top-2, not a sort of the table
    firsts = facts.where(F.col("tStart") >= 31536000).select("tStart").orderBy("tStart").limit(2).collect()
    first = firsts[1][0] if len(firsts) > 1 else None
    last = facts.agg(F.max("tStart")).first()[0]
    at = lambda t: F.count_if((F.col("tStart") <= t) & (F.col("tEnd") > t))
    one, end = F.lit(first).cast("bigint"), F.lit(last).cast("bigint")
    core = (F.col("tStart") == one) & (F.col("tEnd") == end)
    row = facts.agg(
        F.count("*").alias("total"), at(one).alias("triples_first"), at(end).alias("triples_last"), F.count_if(F.col("tStart") > one).alias("n_add"),
        F.count_if(F.col("tEnd") < end).alias("n_del"), F.count_if(core).alias("static_core"), F.count_if(~core).alias("version_oblivious"),
        *[F.count_distinct(stamp(F.col("tStart"), _BUCKETS[g]) if g in _BUCKETS else F.when(F.col("tStart").isNotNull(), F.lit("unknown"))).alias(f"v_{i}") for i, g in enumerate(granularities)],
    )
    share = lambda a, b: F.try_divide(F.col(a) * 100.0, F.col(b))
    each = F.array(*[F.struct(F.lit(g).alias("granularity"), F.col(f"v_{i}").alias("versions")) for i, g in enumerate(granularities)])
    return row.withColumn("g", F.explode(each)).select(
        "g.granularity", "g.versions", "triples_first", "triples_last", share("triples_last", "triples_first").alias("growth"),
        share("n_add", "total").alias("adds"), share("n_del", "total").alias("deletes"), "static_core", "version_oblivious",
    )


def summary(facts: DataFrame) -> DataFrame:
    """Rows, distinct triples, heads, types, relations and moments.

    Each distinct count is an aggregate of its own over (kind, hash of the
    value), so one shuffle of distinct hashes serves all of them.
    """
    key = lambda kind, *c: F.struct(F.lit(kind).alias("kind"), F.xxhash64(*c).alias("h1"), F.hash(*c).alias("h2"))
    keys = F.array(key("triple", *TRIPLE), key("head", "head"), F.when(F.col("rel") == RDF_TYPE_IRI, key("type", "tail")), key("rel", "rel"), key("time", "tStart"), key("time", "tEnd"))
    seen = facts.select(F.explode(keys).alias("k")).select("k.*").where("kind is not null").distinct()
    n = lambda k: F.count_if(F.col("kind") == k)
    distinct = seen.agg(n("triple").alias("distTriples"), n("head").alias("distEntities"), n("type").alias("distTypes"), n("rel").alias("distRelations"), n("time").alias("distVersions"))
    return facts.agg(F.count("*").alias("triples")).crossJoin(distinct)


def window_days(facts: DataFrame) -> DataFrame:
    return facts.groupBy(stamp(F.col("tStart"), DAY).alias("startDay"), stamp(F.col("tEnd"), DAY).alias("endDay")).agg(F.count("*").alias("count"))


def window_hours(facts: DataFrame) -> DataFrame:
    """(hours, count): lengths of closed windows in whole hours."""
    hours = F.floor((F.col("tEnd") - F.col("tStart")) / 3600)
    return facts.where((F.col("tEnd") < OPEN_END) & (F.col("tEnd") >= F.col("tStart"))).groupBy(hours.alias("hours")).agg(F.count("*").alias("count"))


def property_changes(facts: DataFrame) -> DataFrame:
    """Per relation, how often its subjects' values changed: distinct windows less one."""
    rows = by_key(facts.where(~F.col("rel").startswith(DBP)).select("head", "rel", "tStart", "tEnd"), "head", "rel")
    each = rows.groupBy("head", "rel").agg((F.count_distinct("tStart", "tEnd") - 1).alias("n"))
    counts = cut(each.select("rel", F.col("n").alias("x")).groupBy("rel", "x").agg(F.count("*").alias("n")))
    total = F.sum(F.col("x") * F.col("n"))
    out = counts.groupBy("rel").agg((total.cast("double") / F.sum("n")).alias("avg"), F.min("x").alias("min"), F.max("x").alias("max"), total.alias("total_changes"))
    return _matched(out, quantiles(counts, ["rel"], "x", _QUARTILES), ["rel"]).select("rel", "avg", "min", "max", "q25", "median", "q75", "total_changes")


def top_properties(facts: DataFrame, n: int = 20) -> DataFrame:
    """The n relations whose values change most often by median, ties by name; a report."""
    return property_changes(facts).orderBy(F.desc("median"), "rel").limit(n)


# revision metadata: (id, pageid, timestamp as ISO-8601 text, namespace)


def namespace_counts(revisions: DataFrame, what: str) -> DataFrame:
    """(namespace, count) of distinct revisions (``id``) or pages (``pageid``)."""
    return revisions.select(what, "namespace").distinct().groupBy("namespace").agg(F.count("*").alias("count"))


def _year(revisions: DataFrame) -> Column:
    return F.substring("timestamp", 1, 4)


def revisions_per_year(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy(_year(revisions).alias("year"), "namespace").agg(F.count("*").alias("count"))


def pages_per_year(revisions: DataFrame) -> DataFrame:
    """(year, namespace, count): pages by the year of their first revision in the namespace."""
    first = revisions.groupBy("pageid", "namespace").agg(F.min(_year(revisions)).alias("year"))
    return first.groupBy("year", "namespace").agg(F.count("*").alias("count"))


HOUR_BINS = [(0, 1, "<1h"), (1, 24, "1h-1d"), (24, 168, "1d-1w"), (168, 720, "1w-30d"), (720, 8760, "30d-1y"), (8760, 43800, "1y-5y"), (43800, None, ">=5y")]


def hour_bins(facts: DataFrame) -> DataFrame:
    """(bin, count) of window lengths; a bin holds its lower end."""
    label = None
    for low, high, name in HOUR_BINS:
        test = (F.col("hours") >= low) & (F.col("hours") < high) if high else F.col("hours") >= low
        label = F.when(test, name) if label is None else label.when(test, name)
    return window_hours(facts).groupBy(label.alias("bin")).agg(F.sum("count").alias("count"))


def below_fence(rows: DataFrame, column: str) -> DataFrame:
    """Rows up to the upper fence q75 + 1.5 (q75 - q25) of a column."""
    q = quantiles(rows.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n")), [], "x", {"q25": 0.25, "q75": 0.75})
    fence = q.select((F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))).alias("_fence"))
    return rows.crossJoin(F.broadcast(fence)).where(F.col(column) <= F.col("_fence")).drop("_fence")


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
