"""Validity windows of triples, snapshots of them and their differences.

Facts are (head, rel, tail, rStart, rEnd, tStart, tEnd), times in epoch seconds;
an open window ends at the largest long, which is never calculated with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.literals import epoch, instant
from kgloom.vocab import DBO, OPEN_END, PAGE_LINK, RDF_TYPE_IRI, SKOS

TRIPLE = ["head", "rel", "tail"]


def windows(versions: DataFrame, triples: DataFrame) -> DataFrame:
    """Facts from page versions (pid, rid, ts, ok) and their triples (pid, rid, head, rel, tail).

    Versions of a page go by (ts, rid); failed ones (not ok) are skipped, while
    one that succeeded without triples closes all. A window lasts from the
    first version that has the triple to the first that hasn't; one that comes
    back opens another. The number of a version less the triple's own count of
    versions is the same within a window and grows from one to the next.
    """
    page = Window.partitionBy("pid").orderBy("ts", "rid")
    turn = versions.where("ok").select(
        "pid", "rid", "ts", F.row_number().over(page).alias("ord"), F.lead("ts").over(page).alias("ts2"), F.lead("rid").over(page).alias("rid2")
    )
    rows = triples.select("pid", "rid", *TRIPLE).distinct().join(turn, ["pid", "rid"])
    own = Window.partitionBy("pid", *TRIPLE).orderBy("ord")
    rows = rows.withColumn("island", F.col("ord") - F.row_number().over(own))
    found = rows.groupBy("pid", *TRIPLE, "island").agg(
        F.min_by(F.struct("ts", "rid"), "ord").alias("a"), F.max_by(F.struct("ts2", "rid2"), "ord").alias("z")
    )
    return found.select(
        *TRIPLE,
        F.col("a.rid").cast("string").alias("rStart"),
        F.coalesce(F.col("z.rid2").cast("string"), F.lit(str(OPEN_END))).alias("rEnd"),
        F.col("a.ts").alias("tStart"),
        F.coalesce("z.ts2", F.lit(OPEN_END)).alias("tEnd"),
    )


def snapshot(facts: DataFrame, ts: int, closed: bool = False) -> DataFrame:
    """Facts valid at ts; ``closed`` counts the end as inside."""
    end = F.col("tEnd") >= ts if closed else F.col("tEnd") > ts
    return facts.where((F.col("tStart") <= ts) & end)


def resources(facts: DataFrame, known: bool = False) -> DataFrame:
    """Facts with an http:// tail; ``known``: which is also some fact's head."""
    found = facts.where(F.col("tail").startswith("http://"))
    if known:
        heads = facts.select(F.col("head").alias("_h")).distinct()
        found = found.join(heads, F.col("tail") == F.col("_h"), "left_semi")
    return found


def page_links(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("rel") == PAGE_LINK)


def ontology(facts: DataFrame, links: bool = True) -> DataFrame:
    """Ontology types and properties, with or without page links."""
    own = F.col("rel").startswith(DBO) if links else F.col("rel").startswith(DBO) & (F.col("rel") != PAGE_LINK)
    return facts.where(((F.col("rel") == RDF_TYPE_IRI) & F.col("tail").startswith(DBO)) | own)


def categories(facts: DataFrame) -> DataFrame:
    """SKOS concepts and their relations; a stray closing bracket of older files is taken too."""
    return facts.where(F.col("tail").isin(SKOS + "Concept", SKOS + "Concept>") | F.col("rel").isin(SKOS + "broader", SKOS + "subject", SKOS + "prefLabel"))


def in_namespaces(versions: DataFrame, ns: str = "ns", kept: tuple[int, ...] = (0, 14)) -> DataFrame:
    return versions.where(F.col(ns).isin(*kept))


def year_points(years: range, month_day: str = "06-01") -> Column:
    """array<struct<year,ts>>: the start of a day in each of the years, UTC."""
    return F.array(*[F.struct(F.lit(y).alias("year"), epoch(F.lit(f"{y}-{month_day} 00:00:00")).alias("ts")) for y in years])


def yearly_snapshots(facts: DataFrame, years: range, month_day: str = "06-01") -> DataFrame:
    """Facts with each ``year`` at whose day they are valid (ends count as inside); one pass for all years."""
    inside = F.filter(year_points(years, month_day), lambda y: (y["ts"] >= F.col("tStart")) & (y["ts"] <= F.col("tEnd")))
    return facts.withColumn("_y", F.explode(inside)).withColumn("year", F.col("_y.year")).drop("_y")


def active_years(facts: DataFrame, last: int = 1767351600) -> DataFrame:
    """(head, rel, tail, date): each year on whose first midnight, after the start and no later than the end, the fact is valid."""
    end = F.least(F.col("tEnd"), F.lit(last))
    first = F.year(instant(F.col("tStart"))) + 1
    stop = F.year(instant(end))
    years = F.when(first <= stop, F.sequence(first, stop)).otherwise(F.array().cast("array<int>"))
    return facts.where("tStart is not null and tEnd is not null").select(*TRIPLE, F.explode(F.transform(years, lambda y: y.cast("string"))).alias("date"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(head, rel, tail, diff): distinct triples gained (1) and lost (-1); a null term equals none."""
    known = F.col("head").isNotNull() & F.col("rel").isNotNull() & F.col("tail").isNotNull()

    def lone(a: DataFrame, b: DataFrame, mark: int) -> DataFrame:
        rest = a.select(*TRIPLE).distinct()
        return rest.where(known).join(b.where(known).select(*TRIPLE).distinct(), TRIPLE, "left_anti").union(rest.where(~known)).withColumn("diff", F.lit(mark))

    return lone(after, before, 1).union(lone(before, after, -1))


def yearly_diff(facts: DataFrame, years: range, month_day: str = "06-01") -> DataFrame:
    """(prevYear, currYear, prevSize, currSize, addCount, delCount) of each two successive years.

    Sizes count rows, additions and deletions distinct triples. Each triple's
    set of years is built once; no year is compared by a job of its own.
    """
    rows = yearly_snapshots(facts, years, month_day).groupBy(*TRIPLE, "year").agg(F.count("*").alias("n"))
    held = rows.groupBy(*TRIPLE).agg(F.collect_set("year").alias("held"), F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("n"))
    pairs = F.array(*[F.lit(y) for y in list(years)[1:]])
    has = lambda y: F.array_contains("held", y)
    size = lambda y: F.coalesce(F.try_element_at("n", y), F.lit(0))
    y = F.col("currYear")
    each = held.withColumn("currYear", F.explode(pairs)).where(has(y) | has(y - 1))
    null = F.col("head").isNull() | F.col("rel").isNull() | F.col("tail").isNull()
    out = each.groupBy((y - 1).alias("prevYear"), "currYear").agg(
        F.sum(size(y - 1)).alias("prevSize"),
        F.sum(size(y)).alias("currSize"),
        F.count_if(has(y) & (~has(y - 1) | null)).alias("addCount"),
        F.count_if(has(y - 1) & (~has(y) | null)).alias("delCount"),
    )
    every = facts.sparkSession.createDataFrame([(a, a + 1) for a in list(years)[:-1]], "prevYear int, currYear int")
    return F.broadcast(every).join(out, ["prevYear", "currYear"], "left").na.fill(0)


def out_degrees(facts: DataFrame, *by: str, objects_only: bool = False) -> DataFrame:
    """(by, degree, heads): how many heads have each number of facts."""
    if objects_only:
        facts = facts.where(~F.col("tail").startswith('"'))
    return facts.groupBy(*by, "head").agg(F.count("tail").alias("degree")).groupBy(*by, "degree").agg(F.count("*").alias("heads"))
