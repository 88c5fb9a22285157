"""URL filters: host and path rules first, then gradient-boosted trees on lexical features.

Everything runs in the JVM: features, rules and the trees' scoring are SQL expressions. The trees are trained from a
bounded table of labelled URLs, so training costs the same at every size, and scoring is one pass without a shuffle.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import lower_ascii

#: (rule, verdict): host, then a path that begins with /. A rule fits its host and all subdomains.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Labelled URLs used for training at most (the first by hash), trees and their depth.
TRAIN_ROWS, TREES, DEPTH = 20_000, 12, 3
#: Weight of the overall share of blocked URLs in a suffix's own, and in that of a host's four characters.
PRIOR, GRAM_PRIOR = 5.0, 6.0
#: Slots that four characters are hashed to; folds of hosts, each with the statistics of the others, in training.
SLOTS, FOLDS = 1 << 14, 4


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without :// or url."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host, ".", -1)


def entropy(s: Column) -> Column:
    """Bits a character of the string's own character frequencies; 0 when empty."""
    n = F.length(s).cast("double")
    bits = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    each = F.transform(F.array_distinct(F.split(s, "")), lambda c: F.when(c != "", -bits(c) * F.log2(bits(c))).otherwise(0.0))
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def gram_slots(host: Column) -> Column:
    """The slots of the strings of four characters in a host's labels, without its hyphens."""
    grams = F.regexp_extract_all(F.replace(host, F.lit("-"), F.lit("")), F.lit("(?=([^.]{4}))"), F.lit(1))
    return F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(SLOTS)).cast("int"))


FEATURES = ("f_url_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digit_ratio", "f_host_digit_ratio", "f_hyphens", "f_host_entropy", "f_longest_label", "f_params", "f_query_length", "f_suffix_blocked", "f_suffix_known", "f_gram_odds")


def statistics(labelled: DataFrame, share: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, kind, suffix, blocked, known), apart for each value of the columns `by`, of TRAIN_ROWS labelled rows (host, label) at most, share of them to block: the share by suffix, and by
    slot of four characters (kind gram, the slot as text) their log odds against the overall ones. One task counts them, without a shuffle."""
    grams = F.transform(F.array_distinct(gram_slots(F.col("host"))), lambda i: F.struct(F.lit("gram").alias("kind"), i.cast("string").alias("suffix")))
    both = F.concat(F.array(F.struct(F.lit("suffix").alias("kind"), suffix_of(F.col("host")).alias("suffix"))), grams)
    x = labelled.coalesce(1).select(*by, F.explode(both).alias("of"), "label")
    x = x.groupBy(*by, "of.kind", "of.suffix").agg(F.sum("label").alias("n"), F.count("*").alias("known"))
    part = lambda w: (F.col("n") + w * F.lit(share)) / (F.col("known") + w)
    odds = F.log(part(GRAM_PRIOR) / (1 - part(GRAM_PRIOR))) - F.log(F.lit(share) / (1 - F.lit(share))) if 0 < share < 1 else F.lit(0.0)
    return x.select(*by, "kind", "suffix", F.when(F.col("kind") == "gram", odds).otherwise(part(PRIOR)).alias("blocked"), "known")


def with_features(urls: DataFrame, url: str, host: str, path: str, suffixes: DataFrame, fold: str | None = None) -> DataFrame:
    """Adds FEATURES; suffixes: the statistics() of the labelled URLs, by the column `fold` (from 0, below FOLDS) if there is one: a row takes its fold's."""
    odds = {int(r.suffix) + (r[fold] * SLOTS if fold else 0): r.blocked for r in suffixes.filter("kind = 'gram'").collect()}
    suffixes = suffixes.filter("kind = 'suffix'").drop("kind")
    slots = SLOTS * FOLDS if fold else SLOTS
    table = F.split(F.lit(" ".join(f"{odds[i]:.6g}" if i in odds else "0" for i in range(slots))), " ").cast("array<double>")  # a constant
    first = F.col(fold) * SLOTS if fold else F.lit(0)
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    digits = lambda s: F.length(F.regexp_replace(s, "[^0-9]", "")) / F.greatest(F.length(s), F.lit(1))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    made = {
        "f_url_length": F.length(u), "f_host_length": F.length(h), "f_path_length": F.length(p),
        "f_depth": F.size(F.filter(F.split(p, "/"), lambda x: x != "")), "f_labels": F.size(F.split(h, r"\.")),
        "f_digit_ratio": digits(u), "f_host_digit_ratio": digits(h), "f_hyphens": F.length(h) - F.length(F.replace(h, F.lit("-"), F.lit(""))),
        "f_host_entropy": entropy(h), "f_longest_label": F.array_max(F.transform(F.split(h, r"\."), lambda x: F.length(x))),
        "f_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")), "f_query_length": F.length(query),
        "f_gram_odds": F.aggregate(F.array_distinct(gram_slots(h)), F.lit(0.0), lambda a, i: a + F.get(table, i + first)),
    }
    own = suffix_of(h) == F.col("suffix")
    if fold:
        suffixes, own = suffixes.withColumnRenamed(fold, "fold_of"), own & (F.col(fold) == F.col("fold_of"))
    x = urls.join(F.broadcast(suffixes), own, "left").drop("suffix", "fold_of")
    made |= {"f_suffix_blocked": F.coalesce(F.col("blocked"), F.lit(0.5)), "f_suffix_known": F.coalesce(F.col("known"), F.lit(0))}
    return x.withColumns({k: v.cast("double") for k, v in made.items()}).drop("blocked", "known")


#: Words of the made-up hosts; none is a word of a test table's hosts.
PLAIN = "library museum garden journal weather university school kitchen history science cycling theatre bakery village council research archive gallery orchestra hospital parish nature physics teacher".split()
BAIT = "poker bonus loan jackpot viagra xxx escort lottery slots roulette replica warez cracked hookup forex payday keygen torrent rolex diet clickbait popunder cashback milf".split()


#: Suffixes of the made-up hosts, the usual ones first, and how often a wanted and an unwanted host has one of the others.
USUAL, OTHER = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "example.com", "example.net", "example.org"), ("biz", "info", "xyz", "top", "click", "online")
RARE = (0.04, 0.35)


def seed_urls(spark: SparkSession, seed: int = 5, each: int = 900) -> DataFrame:
    """Labelled URLs (url, label), `each` of both labels, made by a rule for want of a labelled table.

    Both kinds have hosts with and without hyphens and digits, and the same schemes, subdomains, suffixes, depths and parameters; unwanted
    ones have more of each, and the rarer suffixes. What tells a URL is one of six things in turn: a hyphen between syllables that say nothing; one word of PLAIN or BAIT
    beside such syllables; two words (twice); many digits; or a rare suffix, which the wanted ones of its kind haven't. The others are as in the other class, but for some noise.
    Many parameters are as frequent in both classes, so that a search form's URL isn't blocked for them. Pairs of words whose crc32 leaves 0 when divided by 4 are left
    out, to test with.
    """
    rng = random.Random(seed)
    syllable = lambda: "".join(rng.choice(x) for x in ("bcdfghjklmnprstvwz", "aeiou", "lmnrst"))
    said = lambda n: "".join(syllable() for _ in range(n))
    rows = []
    for label, words, hyphen, digit in ((0, PLAIN, 0.3, 0.15), (1, BAIT, 0.7, 0.35)):
        pairs = [(a, b) for a in words for b in words if a != b and zlib.crc32(f"{a}{b}".encode()) % 4]
        for i in range(each):
            kind, (a, b) = i % 6, rng.choice(pairs)
            if kind in (0, 4, 5):
                a, b = said(rng.randrange(1, 4)), said(rng.randrange(1, 3))
            elif kind == 1:
                a, b = rng.sample([a, said(rng.randrange(1, 3))], 2)
            dash = rng.random() < (0.94 * label + 0.03 if kind == 0 else 0.04 if kind > 3 else hyphen)
            digits = str(rng.randrange(10**3, 10**7)) if kind == 4 and rng.random() < 0.98 * label + 0.01 else str(rng.randrange(2, 100)) if rng.random() < digit else ""
            name = (digits if rng.random() < 0.2 else "") + a + "-" * dash + b + digits
            sub, top = rng.choice(["", "", "www.", "m.", "blog."]), rng.choice(OTHER if rng.random() < (0.98 * label + 0.01 if kind == 5 else RARE[label]) else USUAL)
            path = "".join(f"/{x}" for x in rng.sample(["en", "de", "fr", "es", "news", str(rng.randrange(1000)), "item"], rng.randrange(4)))
            n = rng.choice([0, 0, 0, 1, 1, 2, 2, rng.randrange(3, 9), rng.randrange(3, 9)])
            tail = "?" + "&".join(f"{rng.choice(['page', 'ref', 'id', 'a', 'b', 'q'])}={rng.randrange(100)}" for _ in range(n)) if n else rng.choice(["", ".html", "/", "#top"]) if path else ""
            rows.append((f"http{rng.choice(['', 's'])}://{sub}{name}.{top}{path}{tail}", label))
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {label})" for u, label in rows) + " AS t(url, label)")


def trees(model) -> list[tuple[float, str]]:
    """Each tree's weight and its text."""
    return list(zip(model.treeWeights, (t.toDebugString for t in model.trees), strict=True))


def as_sql(text: str, names=FEATURES) -> Column:
    """A regression tree's text as a nested CASE."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def node(at: int) -> tuple[Column, int]:
        if m := re.match(r"Predict: (\S+)", lines[at]):
            return F.lit(float(m[1])), at + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at])
        left, at = node(at + 1)
        right, at = node(at + 1)  # past the Else
        return F.when(F.col(names[int(m[1])]) <= float(m[2]), left).otherwise(right), at

    return node(0)[0]


def train(labelled: DataFrame, url: str = "url", label: str = "label", rows: int = TRAIN_ROWS, n_trees: int = TREES, depth: int = DEPTH):
    """(score, suffixes): the blocking score as a column over FEATURES, over 0 to block, and the suffix statistics.

    Null urls and labels are left out. Without any row, or of one label only, the score is that label's.
    """
    x = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")).dropna()
    # of a large table only urls of low hash are sorted, some four times as many as are needed
    share = min(1.0, 4 * rows / max(x.count(), 1))
    x = x.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else x
    x = x.orderBy(F.xxhash64("url"), "url", "label").limit(rows)
    host, path = split_url(F.col("url"))
    x = x.withColumns({"host": host, "path": path})
    n, share = x.agg(F.count("*"), F.avg("label")).first()
    suffixes = statistics(x, share or 0.0).cache()
    if not n or share in (0.0, 1.0):
        return F.lit(2.0 * (share or 0.0) - 1), suffixes
    # a row's own label has no part in its statistics, as with URLs that aren't labelled
    x = x.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")).coalesce(1).cache()
    others = x.withColumn("of_fold", F.explode(F.array(*map(F.lit, range(FOLDS))))).filter("of_fold <> fold").drop("fold").withColumnRenamed("of_fold", "fold")
    made = with_features(x, "url", "host", "path", statistics(others, share, ("fold",)), "fold").coalesce(1)
    seen = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made).select("features", "label").cache()
    model = GBTClassifier(maxIter=n_trees, maxDepth=depth, stepSize=0.5, seed=11, minInstancesPerNode=5).fit(seen)
    seen.unpersist()
    x.unpersist()
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * as_sql(t) for w, t in trees(model)]), suffixes


def url_filter(urls: DataFrame, labelled: DataFrame, url: str = "url", rules=RULES, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (None: all) with host, path, rule, verdict (allow or block: the rule's, else the trees') and score (over 0: block).

    A null url or one without :// has an empty host and path, fits no rule and is judged by the trees like any other; a score of exactly 0
    allows. A url of any length is read whole. Repeated rows each have a row, with the same verdict. Of rules of
    one length that both fit, the later one by text wins. Columns of `keep` with the new names are replaced. One row out for each row in; an
    empty table stays empty.
    """
    score, suffixes = train(labelled)
    new = ["host", "path", "rule", "verdict", "score"]
    keep = [c for c in (urls.columns if keep is None else keep) if c not in new]
    names = {c: f"keep_{i}" for i, c in enumerate(keep)}  # their names don't meet those of the features
    raw = "url_"
    x = urls.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(url).alias(raw))
    host, path = split_url(F.col(raw))
    x = with_features(x.withColumns({"host": host, "path": path}), raw, "host", "path", suffixes).withColumn("score", score)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    x = x.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow"))})
    return x.select(*[F.col(n).alias(c) for c, n in names.items()], *new)
