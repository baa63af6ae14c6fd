"""What each of five text filters takes alone, together with the others, and in any order.

Every document gets five flags (it fails the filter or not). Over a part's documents, the joint failures of a set S of
filters are the sum of the product of S's flags; there are 32 such sums, the empty set's being the number of documents.
All else follows from them without reading a document again: by Moebius inversion over the subsets of P, the documents
that fail none of P; over the supersets of one filter, those that fail it alone; and with the Harsanyi dividends
(-1)^(|S|+1) J(S) of the game "how many documents do the filters of S remove", the Shapley value of a filter, the sum
of J's dividends over the sets that hold it, each shared by |S|. An order of filters is only a chain of sets P.

Filters: A under MIN_WORDS words; B distinct words under 80 % of the words; C over 10 % capitals (A-Z) of the code
points; D any of SYMBOLS; E a text identical to that of a smaller id, anywhere in the table.

Texts are read once: a thin table (key, part, digest of the text, flags) is stored in the shared folder. Whether a row
is its text's first is an aggregation by digest, combined before the shuffle, and a join on (digest, key), whose keys
are as many as documents; so neither a group of copies nor a part gathers in one task. The digest is SHA-256.

Defined results: a null text counts as empty; a null part is the empty one; of repeated rows (same key, same text)
none is the copy of another; a row without a key has no label and is neither a copy nor an original; a key is good or
toxic if any of its label rows says so, and null labels say nothing; an empty table has no parts, so no rows. Columns
other than those named aren't read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import documents_of, stored

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: What the filters ask for.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ("all", "good", "toxic")


def flags(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """_key, _part, _digest, _mask: filters A to D as bits, in the order of FILTERS."""
    body = F.coalesce(F.col("_t"), F.lit(""))
    read = documents_of(docs, key, text, part).toDF("_key", "_t", "_part").select("_key", F.coalesce(F.col("_part").cast("string"), F.lit("")).alias("_part"), body.alias("_t"))
    words = F.array_remove(F.split("_t", SPACES), "")
    # Columns of their own, so that a text is split once
    split = read.select("*", words.alias("_words")).select("_key", "_part", "_t", F.size("_words").alias("_n"), F.size(F.array_distinct("_words")).alias("_distinct"))
    failed = (
        F.col("_n") < MIN_WORDS,
        100 * F.col("_distinct").cast("long") < MIN_DISTINCT * F.col("_n").cast("long"),
        100 * F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long") > MAX_CAPITALS * F.length("_t").cast("long"),
        F.col("_t").rlike(SYMBOLS),
    )
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))
    return split.select("_key", "_part", F.unhex(F.sha2(F.col("_t").cast("binary"), 256)).alias("_digest"), mask.alias("_mask"))


def with_copies(thin: DataFrame) -> DataFrame:
    """_key, _part, _mask, _n of flags(): the bit of filter E added, and equal rows counted together."""
    keyed = thin.filter(F.col("_key").isNotNull())
    first = keyed.groupBy("_digest").agg(F.min("_key").alias("_key")).select("_digest", "_key", F.lit(True).alias("_first"))
    marked = keyed.join(first, ["_digest", "_key"], "left").select("_key", "_part", (F.col("_mask") + F.when(F.col("_first"), 0).otherwise(1 << FILTERS.index("E"))).alias("_mask"))
    return marked.unionByName(thin.filter(F.col("_key").isNull()).select("_key", "_part", "_mask")).groupBy("_key", "_part", "_mask").agg(F.count("*").alias("_n"))


def joint_failures(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """_part and, for each of COUNTS, an array over all sets of filters: how many of the part's documents fail every filter of the set."""
    told = documents_of(labels, key, "quality", "toxic").toDF("_key", "_quality", "_toxic").filter("_key is not null")
    told = told.groupBy("_key").agg(F.max((F.col("_quality") == 1).cast("int")).alias("_good"), F.max((F.col("_toxic") == 1).cast("int")).alias("_bad"))
    keyed = rows.filter("_key is not null").join(told, "_key", "left").unionByName(rows.filter("_key is null"), allowMissingColumns=True)
    cells = keyed.groupBy("_part", "_mask", F.coalesce("_good", F.lit(0)).alias("_good"), F.coalesce("_bad", F.lit(0)).alias("_bad")).agg(F.sum("_n").alias("_n"))
    # The product of a set's flags: one if the mask holds the set, else nothing
    product = (F.col("_mask").bitwiseAND(F.col("_set")) == F.col("_set")).cast("long")
    opened = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(SETS - 1))).alias("_set")).withColumn("_n", F.col("_n") * product)
    sums = opened.groupBy("_part", "_set").agg(F.sum("_n").alias("all"), F.sum(F.col("_n") * F.col("_good")).alias("good"), F.sum(F.col("_n") * F.col("_bad")).alias("toxic"))
    lists = sums.groupBy("_part").agg(F.array_sort(F.collect_list(F.struct("_set", *COUNTS))).alias("_j"))
    return lists.select("_part", *(F.col(f"_j.{c}").alias(c) for c in COUNTS))


def _sign(set_: Column) -> Column:
    return F.when(F.bit_count(set_) % 2 == 0, F.lit(1)).otherwise(F.lit(-1)).cast("long")


def _added(over: Column, term) -> Column:
    """The sum over all sets that the condition holds for, of a term of the set."""
    return F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda s: over(s)), F.lit(0).cast("long"), lambda x, s: x + term(s))


def survivors(joint: Column) -> Column:
    """Of joint failures by set, how many fail none of a set, by set: the Moebius sum over its subsets."""
    return F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda p: _added(lambda s: s.bitwiseAND(p) == s, lambda s: _sign(s) * F.get(joint, s)))


def alone(joint: Column, filter_: Column) -> Column:
    """How many fail this filter (a bit) and no other: the Moebius sum over the sets that hold it."""
    return _added(lambda s: s.bitwiseAND(filter_) == filter_, lambda s: -_sign(s) * F.get(joint, s))


def shapley(joint: Column, filter_: Column) -> Column:
    """The filter's Shapley value times the number of orders: its share of the dividends of all sets that hold it."""
    return _added(lambda s: s.bitwiseAND(filter_) == filter_, lambda s: -_sign(s) * F.get(joint, s) * (F.lit(len(ORDERS)) / F.bit_count(s)).cast("long"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for every part, order and step."""
    thin = stored(flags(docs, key, text, part), "filter-flags")
    joint = joint_failures(with_copies(thin), labels, key)
    each = F.array(*[F.lit(1 << k) for k in range(len(FILTERS))])
    of_filter = lambda f: F.transform(each, lambda b: f(F.col("all"), b))
    known = joint.select("_part", F.col("all").alias("_joint"), *(survivors(F.col(c)).alias(f"_{c}") for c in COUNTS), of_filter(alone).alias("_alone"), of_filter(shapley).alias("_shapley"))
    orders = known.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda k: f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {k}, 1)) - 1)"
    before = F.expr(f"aggregate(slice(sequence(1, {len(FILTERS)}), 1, step - 1), 0, (held, k) -> held + {bit('k')})")
    at = orders.select("*", before.alias("_before"), F.expr(bit("step")).alias("_bit")).withColumn("_after", F.col("_before") + F.col("_bit")).withColumn("_place", F.bit_count(F.col("_bit") - 1))
    lost = lambda c: F.get(f"_{c}", "_before") - F.get(f"_{c}", "_after")
    return at.select(
        F.col("_part").alias("part"), "filter_order", "step", F.get("_all", "_after").alias("kept"), lost("all").alias("removed"), (F.get("_joint", "_bit") - lost("all")).alias("redundant"),
        F.get("_alone", "_place").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("_shapley", "_place").alias("shapley"),
    )
