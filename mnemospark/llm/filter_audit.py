"""Filter interaction audit: what each filter removes at each place of every order.

Each document fails some of five filters, which gives it a mask of five bits.
Documents are counted into mask cells (part, mask), at most 32 a part, and only
these cells enter the enumeration: a recursive CTE extends a prefix of letters by
each letter it lacks, joins the part's cells and carries the bits applied so far;
each level emits the metrics of the step it adds. An order of k letters shares its
first steps with all orders that begin alike, so a part has 325 prefixes for its
120 orders. Shapley sums weigh a prefix by the number of orders that begin with it.

The copy filter E fails documents whose text a smaller doc_id has anywhere in the
table. Texts are known by their SHA-256; rows are counted by (text, part, flags)
before they meet the smallest id of their text, so a text of very many copies
brings few rows to any task.

Edge cases: a null text is empty; a null part is the empty string; a null doc_id
has no smaller id, is no smaller id of any other, and has no label; labels of
repeated rows count if any row sets them, null labels don't; rows that repeat a
doc_id are counted each, and those of equal id and text are no copies of each
other; an empty table gives no row, as it has no part; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.session import materialize

from .textops import code_points, map_batches, utf8

LETTERS = "ABCDE"
COPY = LETTERS.index("E")
CAPITALS = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    few = len(words) < LEAST_WORDS
    dull = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * code_points(text)
    odd = len(text.translate(None, SYMBOLS)) < len(text)
    return few | dull << 1 | loud << 2 | odd << 3


def _facts(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = utf8(batch.column("text"))
    masks = pa.array([text_mask(t) for t in texts], pa.int32())
    keys = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), masks, keys], ["doc_id", "part", "mask", "text_key"])


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    facts = materialize(map_batches(rows, ["doc_id", "text", "part"], _facts, "doc_id bigint, part string, mask int, text_key binary"), "audit-facts")
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c) for c in ("quality", "toxic")])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    named = facts.where("doc_id IS NOT NULL").join(flags, "doc_id", "left").select("doc_id", "part", "mask", "text_key", zero("quality"), zero("toxic"))
    kind = ["text_key", "part", "mask", "quality", "toxic"]
    once = named.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    kinds = materialize(once.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least")), "audit-kinds")
    first = kinds.groupBy("text_key").agg(F.min("least.doc_id").alias("first_id"))
    met = kinds.join(first, "text_key")
    originals = F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.n")).otherwise(F.lit(0).cast("long"))
    split = F.array(F.struct(F.col("mask").alias("mask"), originals.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << COPY)).alias("mask"), (F.col("n") - originals).alias("n")))
    told = met.select("part", "quality", "toxic", F.explode(split).alias("s")).select("part", "quality", "toxic", "s.mask", "s.n")
    unnamed = facts.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", F.lit(0).alias("quality"), F.lit(0).alias("toxic"), "mask", "n")
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    return told.unionByName(unnamed).groupBy("part", "mask").agg(*sums)


WALK = """
WITH RECURSIVE walk AS (
  SELECT part, '' AS prefix, 0 AS applied, 0 AS step, '' AS letter,
    0L AS kept, 0L AS removed, 0L AS redundant, 0L AS unique_fails, 0L AS good_lost, 0L AS toxic_lost
  FROM {cells}
  UNION ALL
  SELECT c.part, concat(w.prefix, l.letter), w.applied | l.bit, w.step + 1, l.letter,
    aggregate(c.cells, 0L, (s, x) -> s + IF(x.mask & (w.applied | l.bit) = 0, x.n, 0L)),
    aggregate(c.cells, 0L, (s, x) -> s + IF(x.mask & w.applied = 0 AND x.mask & l.bit > 0, x.n, 0L)),
    aggregate(c.cells, 0L, (s, x) -> s + IF(x.mask & w.applied > 0 AND x.mask & l.bit > 0, x.n, 0L)),
    aggregate(c.cells, 0L, (s, x) -> s + IF(x.mask = l.bit, x.n, 0L)),
    aggregate(c.cells, 0L, (s, x) -> s + IF(x.mask & w.applied = 0 AND x.mask & l.bit > 0, x.good, 0L)),
    aggregate(c.cells, 0L, (s, x) -> s + IF(x.mask & w.applied = 0 AND x.mask & l.bit > 0, x.toxic, 0L))
  FROM walk w JOIN {cells} c ON c.part = w.part JOIN (VALUES {letters}) AS l(letter, bit) ON w.applied & l.bit = 0
)
SELECT * FROM walk WHERE step > 0
"""


def prefix_metrics(cells: DataFrame) -> DataFrame:
    """A row for each part and prefix of letters: the metrics of its last step.

    The recursion's row limit is lifted while it runs, as rows follow the parts;
    its levels are as many as the letters.
    """
    spark, key = cells.sparkSession, "spark.sql.cteRecursionRowLimit"
    by_part = materialize(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "audit-cells")
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(LETTERS))
    limit = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        return materialize(spark.sql(WALK.replace("{letters}", letters), cells=by_part), "audit-walk")
    finally:
        spark.conf.set(key, limit)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order."""
    spark, k = docs.sparkSession, len(LETTERS)
    walk = prefix_metrics(mask_cells(docs, labels, part))
    orders_below = F.element_at(F.array(*[F.lit(factorial(k - s)) for s in range(1, k + 1)]), F.col("step"))
    shapley = walk.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_below).alias("shapley"))
    orders = spark.createDataFrame([("".join(p), s, "".join(p)[:s]) for p in permutations(LETTERS) for s in range(1, k + 1)], "filter_order string, step int, prefix string")
    steps = walk.drop("step", "applied").join(F.broadcast(orders), "prefix")
    return steps.join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
