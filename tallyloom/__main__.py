"""python -m tallyloom mine INPUT MIN_SUPPORT [OUTPUT] | compare A B | count INPUT SIZE OUTPUT | rerank INPUT OUTPUT | encode CSV OUTPUT DICTIONARY |
validate FOLDER BASELINE

INPUT has a transaction of whole numbers a line. Without OUTPUT, mine prints an itemset and its support a line.
validate compares the results DATASET_ENGINE.txt of a folder with those of the engine BASELINE and scores each engine.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.shared import materialize
from tallyloom.operators import encode, items, itemsets, mine, validation
from tallyloom.sources import baskets, sinks

USAGE = {"mine": (2, 3), "compare": (2, 2), "count": (3, 3), "rerank": (2, 2), "encode": (3, 3), "validate": (2, 2)}


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if not args or args[0] not in USAGE or not USAGE[args[0]][0] <= len(args) - 1 <= USAGE[args[0]][1]:
        print(__doc__, file=sys.stderr)
        return 1
    what, rest, began = args[0], args[1:], time.time()
    spark = spark or SparkSession.builder.appName("tallyloom").getOrCreate()
    if what == "mine":
        found = mine.mine(baskets.read_transactions(spark, rest[0]), int(rest[1]))
        if len(rest) == 3:
            sinks.write_itemsets(found, rest[2])
        else:
            for row in found.select(itemsets.item_string(F.col("itemset")).alias("s"), "support").toLocalIterator():
                print(row.s, row.support)
    elif what == "compare":
        a, b = (itemsets.parse_itemsets(spark.read.text(p)) for p in rest)
        for name, x, y in (("first", a, b), ("second", b, a)):
            only = itemsets.only_in(x, y)
            print(f"only in the {name}: {only.count()}", *[r[0] for r in itemsets.sample_of(only).select(itemsets.formatted(F.col("itemset"))).collect()])
        print(f"in both: {itemsets.common(a, b).count()}")
    elif what == "count":
        long = baskets.read_transactions(spark, rest[0]).select("tid", F.explode("items").alias("item"))
        sinks.write_counts(items.dense_histogram(long, int(rest[1])), rest[2])
    elif what == "rerank":
        sinks.write_transactions(encode.rerank_transactions(baskets.read_transactions(spark, rest[0])), rest[1])
    elif what == "validate":
        results = materialize(validation.compared(validation.read_results(spark, rest[0]), validation.listed(spark, rest[0]), rest[1]))
        for r in results.orderBy("dataset", "engine").toLocalIterator():
            print(f"{r.dataset} {r.engine}: {'same' if r.same else 'different'}, common {r.common}, only in {rest[1]} {r.only_baseline}, only in {r.engine} {r.only_engine}")
        for r in validation.scores(results).orderBy("engine").toLocalIterator():
            print(f"{r.engine}: {r.matched} of {r.total} ({r.percent:.1f} %)")
    else:
        cells = baskets.read_csv_baskets(spark, rest[0])
        names = encode.first_seen(cells, ["row", "col"])
        sinks.write_transactions(encode.encode(cells, names), rest[1])
        sinks.write_dictionary(names, rest[2])
    print(f"{what}: {time.time() - began:.1f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
