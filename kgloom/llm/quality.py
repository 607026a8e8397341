"""Cross-document line frequency: boilerplate lines go, depleted documents too.

Lines are normalised and hashed with their host. A line's frequency is the
number of distinct documents of the host that have it; documents with the same
text are one, so that copies don't turn each other's lines into boilerplate.

Only hashes leave the scan: one row for each distinct line of a document. Lines
are taken out where the text is, by their places, in one pass over each text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import names
from kgloom.llm.counting import trim
from kgloom.llm.words import buffers, doc_groups
from kgloom.plans.durable import cut

BROADCAST_LINES = 4_000_000
_BLANK = re.compile(r"[ \t\r\f]+")
_RESULT = "struct<keep:boolean,text:string,length:int>"
_ARROW = pa.struct([("keep", pa.bool_()), ("text", pa.string()), ("length", pa.int32())])


def normal_lines(low: str) -> list[str]:
    """The lines of a lower-cased text with blanks squeezed and trimmed."""
    if "  " in low or "\t" in low or "\r" in low or "\f" in low:
        low = _BLANK.sub(" ", low)
    return [x.strip(" ") for x in low.split("\n")]


def host_seed(host: str | None) -> int:
    """What tells a host's lines from another's; a null host is a host."""
    return xxhash.xxh3_64_intdigest(b"" if host is None else b"h" + host.encode("utf-8", "surrogatepass"))


def line_keys(lines: list[str], seed: int) -> np.ndarray:
    """The hash of each line with its host as a signed 64-bit number; 0 for a blank line."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(x.encode(), seed) or 1 if x else 0 for x in lines], np.uint64).view(np.int64)


def solid(text: str) -> int:
    """The number of characters other than blanks and line ends."""
    return len(text) - sum(map(text.count, " \t\r\f\n"))


def _slices(hosts: pa.Array, texts: pa.Array):
    """Parts of both of about a megabyte of text, so that little is held as Python strings at a time."""
    for i, j in doc_groups(buffers(texts)[1]):
        yield hosts.slice(i, j - i), texts.slice(i, j - i)


def _counted(batches):
    """(host, doc, key) of each distinct line of each text, and once with key 0 of each text."""
    for b in batches:
        host, doc, keys = [], [], []
        for hosts, texts in _slices(b.column(0), b.column(1)):
            for h, t, low in zip(hosts.to_pylist(), texts, pc.utf8_lower(texts).to_pylist()):
                seed = host_seed(h)
                mine = np.unique(np.r_[np.int64(0), line_keys(normal_lines(low), seed)])
                keys.append(mine)
                host.append(np.full(len(mine), seed, np.uint64))
                doc.append(np.full(len(mine), xxhash.xxh3_64_intdigest(t.as_buffer()), np.uint64))
        if keys:
            columns = [np.concatenate(host).view(np.int64), np.concatenate(doc).view(np.int64), np.concatenate(keys)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["host", "doc", "key"])
    trim()


def frequent_lines(docs: DataFrame, share: float, min_docs: int, text: str = "text", host: str = "source") -> DataFrame:
    """(key): host-line hashes in more than max(min_docs, share x documents of the host)."""
    rows = docs.select(names.col(docs, host).cast("string").alias("host"), names.col(docs, text).alias("text")).where("text is not null")
    counts = rows.mapInArrow(_counted, "host long, doc long, key long").groupBy("host", "key").agg(F.count_distinct("doc").alias("n"))
    # key 0 counts the host's documents in the same pass; what is left after the limit is few
    counts = cut(counts.where((F.col("key") == 0) | (F.col("n") > min_docs)))
    sizes = counts.where("key = 0").select(F.col("host").alias("of"), F.col("n").alias("docs"))
    lines = counts.where("key <> 0")
    return lines.join(sizes, F.col("host") == F.col("of")).where(F.col("n") > share * F.col("docs")).select("key").distinct()


def _rest(hosts: pa.Array, texts: pa.Array, keep_share: float, hits) -> pa.Array:
    """For each text whether it stays, and its new text and length where a line goes; ``hits(i, keys)`` tells which lines go."""
    parts, n = [pa.array([], _ARROW)], 0
    for host, text in _slices(hosts, texts):
        keep, new, length = np.zeros(len(text), bool), [None] * len(text), [None] * len(text)
        for i, (h, t, low) in enumerate(zip(host.to_pylist(), text.to_pylist(), pc.utf8_lower(text).to_pylist())):
            if t is None or not (before := solid(t)):
                continue
            gone = hits(n + i, line_keys(normal_lines(low), host_seed(h)))
            if gone.any():
                rest = "\n".join([x for x, g in zip(t.split("\n"), gone.tolist()) if not g])
                left = solid(rest)
                keep[i] = left > 0 and left >= keep_share * before
                if keep[i]:
                    new[i], length[i] = rest, len(rest)
            else:
                keep[i] = True
        n += len(text)
        parts.append(pa.StructArray.from_arrays([pa.array(keep), pa.array(new, pa.string()), pa.array(length, pa.int32())], fields=list(_ARROW)))
    trim()
    return pa.concat_arrays(parts)


def remove_frequent_lines(
    docs: DataFrame,
    share: float = 0.05,
    min_docs: int = 10,
    keep_share: float = 0.5,
    text: str = "text",
    host: str = "source",
    length: str = "n_chars",
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """The documents without their frequent lines, and without depleted documents.

    A document is depleted when no non-blank character is left, or less than
    ``keep_share`` of those it had. All columns stay; the text is rewritten
    where a line was removed, and so is the column ``length``, if there is one
    and its row's text changed.

    Null, empty and blank texts have nothing to keep and are rejected. A null
    host is a host of its own. Blank lines are neither counted nor removed.
    Repeated rows stay, each with the same result. Texts of any number of lines
    take time in proportion. An empty table gives no rows.

    Up to ``broadcast_lines`` hashes of frequent lines (8 bytes each) are sent
    to the scan; beyond, the lines are joined by a shuffle, to the same result.
    """
    cols = docs.columns
    find = {c.lower(): c for c in cols}
    t, h = names.col(docs, text), names.col(docs, host).cast("string")
    frequent = cut(frequent_lines(docs, share, min_docs, text, host))
    # the text goes beside the other columns, so that a row holds it once
    others = F.struct(*[docs[f"`{c}`"] for c in cols if c != find[text.lower()]]) if len(cols) > 1 else F.lit(None)
    rows = docs.select(others.alias("_row"), t.alias("t"), h.alias("h")).where("t is not null")
    if frequent.count() <= broadcast_lines:
        held = docs.sparkSession.sparkContext.broadcast(np.sort(frequent.toArrow().column(0).to_numpy()))

        @F.arrow_udf(_RESULT)
        def rest(hosts: pa.Array, texts: pa.Array) -> pa.Array:
            known = held.value

            def hits(i: int, keys: np.ndarray) -> np.ndarray:
                if not len(known):
                    return np.zeros(len(keys), bool)
                at = np.searchsorted(known, keys)
                at[at == len(known)] = 0
                return known[at] == keys

            return _rest(hosts, texts, keep_share, hits)

        # said not to be deterministic, it isn't worked out once more for the filter
        rows = rows.withColumn("r", rest.asNondeterministic()("h", "t"))
    else:
        rows = rows.withColumn("d", F.xxhash64("t", "h"))

        def keyed(batches):
            for b in batches:
                lows = pc.utf8_lower(b.column(2)).to_pylist()
                keys = [np.unique(line_keys(normal_lines(low), host_seed(x))) for low, x in zip(lows, b.column(1).to_pylist())]
                size = np.array([len(k) for k in keys], np.int64)
                if len(size):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(np.concatenate(keys))], ["d", "key"])

        hits_ = rows.select("d", "h", "t").mapInArrow(keyed, "d long, key long").distinct().join(frequent, "key").groupBy("d").agg(F.collect_list("key").alias("bad"))

        @F.arrow_udf(_RESULT)
        def rest(hosts: pa.Array, texts: pa.Array, bad: pa.Array) -> pa.Array:
            return _rest(hosts, texts, keep_share, lambda i, keys: np.isin(keys, np.array(bad[i].as_py() or [], np.int64)))

        rows = rows.join(hits_, "d", "left").withColumn("r", rest.asNondeterministic()("h", "t", "bad"))
    rows = rows.where("r.keep")
    out = []
    for c in cols:
        if c == find[text.lower()]:
            out.append(F.coalesce("r.text", "t").alias(c))
        elif c == find.get(length.lower()):
            out.append(F.coalesce(F.col("r.length").cast(docs.schema[c].dataType), F.col("_row")[c]).alias(c))
        else:
            out.append(F.col("_row")[c].alias(c))
    return rows.select(*out)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, source, text, i, line, trim(regexp_replace(lower(line), '[ \t\r\f]+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents WHERE text IS NOT NULL)),
sizes AS (SELECT source, count(DISTINCT text) AS docs FROM documents WHERE text IS NOT NULL GROUP BY source),
frequent AS (
  SELECT l.source, l.norm FROM (SELECT source, norm, count(DISTINCT text) AS n FROM lines WHERE norm <> '' GROUP BY ALL) l
  JOIN sizes s ON l.source IS NOT DISTINCT FROM s.source WHERE n > 10 AND n > 0.05 * docs),
marked AS (
  SELECT l.doc_id, l.i, l.line, f.norm IS NOT NULL AS gone FROM lines l
  LEFT JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm),
rest AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t, bool_or(gone) AS cut FROM marked GROUP BY doc_id)
SELECT d.doc_id, r.t AS text, d.lang, d.source, CASE WHEN r.cut THEN length(r.t) ELSE d.n_chars END AS n_chars
FROM rest r JOIN documents d USING (doc_id)
WHERE length(regexp_replace(r.t, '[ \t\r\f\n]+', '', 'g')) > 0
  AND (NOT r.cut OR length(regexp_replace(r.t, '[ \t\r\f\n]+', '', 'g')) >= 0.5 * length(regexp_replace(d.text, '[ \t\r\f\n]+', '', 'g')))
"""
