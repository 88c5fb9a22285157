"""From raw documents to a training mix, in five stages; each reads what the one before has written.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps with all their columns; the last one returns
the kept documents' share in the mix. All take empty tables (and return such), nulls in any column, repeated rows, very long
texts and further columns of any name, which stay; what each makes of them is said there.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.llm.common import drop_written, job, table, written
from tallyloom.llm.decontaminate import decontaminate
from tallyloom.llm.language_id import keep_known
from tallyloom.llm.line_dedup import line_dedup
from tallyloom.llm.mixing import mix
from tallyloom.llm.near_dedup import near_dedup


def language(spark, docs, sf_dir):
    """Documents in a known language; learned from those of docs that aren't held out.

    Null and empty texts and texts without a letter go, as do texts unlike all learned from; without labelled rows all go.
    """
    return keep_known(docs)


def lines(spark, docs, sf_dir):
    """Documents without the boilerplate lines of their source; n_chars is the new text's.

    Null texts stay null; a null source is one source; repeated rows count as pages; sources of one or two pages lose nothing.
    """
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near(spark, docs, sf_dir):
    """One document, the least id, of each component of near-duplicates (five words, 0.8).

    Of repeated rows one stays; rows without an id come after those with one. Texts without words are linked with nothing.
    """
    return near_dedup(docs)


def clean(spark, docs, sf_dir):
    """Documents that hold no benchmark item (five words, 0.8), judged row by row by the text; null texts stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark, docs, sf_dir):
    """doc_id, source, size, source_size, target and the words taken of each document: repeated rows each have a row, null and empty texts take 0."""
    return mix(docs)


STAGES = [("language", job(language)), ("lines", job(lines)), ("near", job(near)), ("clean", job(clean)), ("mixture", job(mixture))]

#: The language network and the sketches aren't SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
