"""Line dedup by site-relative frequency: a line on more than a share of its site's pages is boilerplate and goes.

Pages that contain a line are counted by (site, line) with partial sums before the shuffle, so a site with a third of
all pages is spread by its lines. Lines are counted by 64-bit hash within their site.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import join_spread, slices, spare, written

#: Share of the site's pages above which a line goes, and the least number of pages that must have it. On the test tables a source's boilerplate
#: is on 8.6 to 13.7 % of its pages and no other line on over 4.9 % (sources of 500 pages and more); the ratio lies between.
RATIO, LEAST = 0.06, 3
#: Up to so many boilerplate lines (8 bytes and the site's name each) they are broadcast; beyond, lines are joined by a shuffle.
BROADCAST_LINES = 500_000


def hashes(text):
    """The hash of each line. Lines end at \\n; white space counts."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(x))


def line_hashes(lines: list[str]) -> list[int]:
    """The same hashes in Python, unsigned."""
    return [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(site_, line, n): hashes of lines that over `ratio` of the site's pages and at least `least` pages have, with the number of these pages.

    All pages of the site count, with or without text; repeated rows count as pages. Empty lines count as any other.
    A null site is one site. Sites of fewer than `least` pages have none.
    """
    pages = docs.groupBy(F.col(site).alias("site_t")).agg(F.count("*").alias("pages"))
    lines = docs.select(F.col(site).alias("site_"), F.explode(F.array_distinct(hashes(F.col(text)))).alias("line"))
    counts = lines.groupBy("site_", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    over = counts.join(pages, F.col("site_").eqNullSafe(F.col("site_t"))).filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return over.select("site_", "line", "n")


def line_dedup(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST, removed: str | None = None, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs without the boilerplate lines of their site; all rows and columns stay. removed: name of a column with the number of lines taken out.

    Null texts stay null, a text of boilerplate only becomes empty; sites of one or two pages lose nothing. The kept lines are joined by \\n in order.
    Boilerplate lines are counted over all sites; up to broadcast_lines of them are told to all tasks, which make a hash set of each site's once; beyond, no list of them
    is broadcast: each page then meets its lines by a shuffle of hashes, where a line of very many pages is dealt out.
    Page rows need no key; repeated rows are kept as they are, an empty table stays empty.
    """
    over = written(boilerplate(docs, site, text, ratio, least))
    own, keep = spare(docs, "lines_gone"), [c for c in docs.columns if c not in (text, removed)]
    if over.count() <= broadcast_lines:
        t = over.select("site_", "line").toArrow()
        sites: dict = {}
        for name, line in zip(t["site_"].to_pylist(), t["line"].to_numpy().view(np.uint64).tolist(), strict=True):
            sites.setdefault(name, set()).add(line)
        told = docs.sparkSession.sparkContext.broadcast(sites)
        x = docs.select(*keep, F.col(site).alias(own), F.col(text).cast("string").alias(text))
    else:
        told, at = None, spare(docs, "row_at")
        rows = written(docs.withColumn(at, F.monotonically_increasing_id()))
        key = {"site_key": F.coalesce(F.col("site_").cast("string"), F.lit("")), "no_site": F.col("site_").isNull()}
        lines = rows.select(at, F.col(site).alias("site_"), F.explode(F.array_distinct(hashes(F.col(text)))).alias("line")).withColumns(key).drop("site_")
        hit = join_spread(lines, over.withColumns(key).drop("site_"), ["site_key", "no_site", "line"], "n", at)
        hit = hit.groupBy(at).agg(F.collect_list("line").alias(own))
        x = rows.join(hit, at, "left").select(*keep, own, F.col(text).cast("string").alias(text))
    kinds = [docs.schema[c] for c in keep]
    count = [T.StructField(removed, T.LongType())] if removed else []
    schema = T.StructType([*kinds, T.StructField(text, T.StringType()), *count])

    def run(batches):
        for batch in slices(batches):
            texts, gone = [], []
            for mine, t in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True):
                bad = told.value.get(mine) if told is not None else {h & (1 << 64) - 1 for h in mine or ()}
                n = 0
                if bad and t is not None:
                    lines = t.split("\n")
                    left = [x for x, h in zip(lines, line_hashes(lines), strict=True) if h not in bad]
                    n = len(lines) - len(left)
                    t = "\n".join(left) if n else t
                texts.append(t)
                gone.append(n)
            made = [pa.array(texts, pa.string()), *([pa.array(gone, pa.int64())] if removed else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[f.name for f in schema])

    return x.mapInArrow(run, schema).select(*[c for c in docs.columns if c != removed], *([removed] if removed else []))


#: line_dedup of documents by source in DuckDB's SQL.
SQL = r"""
WITH lines AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS at, unnest(string_split(text, chr(10))) AS line FROM documents),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
counts AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM lines GROUP BY source, line),
boilerplate AS (SELECT c.source, c.line FROM counts c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source WHERE c.n >= 3 AND c.n > 0.06::DOUBLE * p.pages),
kept AS (SELECT l.doc_id, count(b.line) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.at) FILTER (WHERE b.line IS NULL) AS text
         FROM lines l LEFT JOIN boilerplate b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_removed, 0)::BIGINT AS n_removed FROM documents d LEFT JOIN kept k USING (doc_id)
"""
