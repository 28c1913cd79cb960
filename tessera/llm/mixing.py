"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within a source the documents are put in
the order of that key and a running sum of their sizes says where the budget of
the source ends. The running sum is distributed: the key's range is cut into
cells of about ``CELL_ROWS`` documents, cells are summed, sums of cells are
summed again by groups of cells, and only the documents of one cell are ever
sorted together, so a source that holds a third of all rows is spread over as
many cells as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, word_count

#: Weights by the rank of the source (code-point order, null last), repeating.
WEIGHTS = (5, 2, 1)
#: The mix takes this share of all words: 3 / 2.
SHARE = (3, 2)
#: No source is read more often than this.
MAX_EPOCHS = 2
#: Aimed number of documents in a cell, and of cells in a group of cells.
CELL_ROWS, GROUP_CELLS = 256, 1024
#: The key has 48 bits.
KEY_BITS = 48
_S = "__mix_"


def random_key(identifier: Column, seed: int, *more: Column) -> Column:
    """A key of 48 bits from MD5, the same in every run and engine. ``more`` tells rows of one identifier apart."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in (identifier, *more)])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, docs -> also no (rank of the source) and target: the water level of the weights under the caps.

    Targets in proportion to the weights are cut at ``max_epochs * source_size`` and the excess is dealt again by weight until
    none is above. The result is ``min(cap, weight * level)``; sources by rising ``size / weight`` are capped up to the first
    whose share of what is left stays below its cap. One row for each source passes here; nothing else does.
    """
    num, den = share
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("no", F.row_number().over(order)).withColumn("weight", w).withColumns({
        "ratio": F.col("source_size") / F.col("weight"),
        "all_size": F.sum("source_size").over(everything),
        "all_weight": F.sum("weight").over(everything),
    })
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(max_epochs)
    ranked = ranked.withColumns({
        "cap_before": F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "weight_left": F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # num * all / den - capped: what the sources from here on share, times den to stay whole
    left = F.lit(num) * F.col("all_size") - F.lit(den) * F.col("cap_before")
    ranked = ranked.withColumn("capped", F.col("weight") * left >= F.lit(den) * cap * F.col("weight_left")).withColumn("left", left)
    level = Window.partitionBy(F.lit(0))
    ranked = ranked.withColumns({
        "level_num": F.min(F.when(~F.col("capped"), F.struct("ratio", F.col("source").isNull().alias("n"), "source", "left", "weight_left"))).over(level),
    })
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(
        (F.col("weight") * F.col("level_num.left")).cast("double") / (F.lit(den) * F.col("level_num.weight_left")).cast("double")
    )
    return ranked.select("source", "no", "source_size", "docs", target.alias("target"))


def _prefix(rows: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(value).over(window), F.lit(0)))


def mix(docs: DataFrame, size: Column, identifier: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = 7, keep: Sequence[str] = (), apart: Sequence[Column] = ()) -> DataFrame:
    """identifier, size, source_size, target, taken and the columns in ``keep``, a row for each row of ``docs``.

    ``taken`` is the number of words the mix takes from the document, repeats counted: whole epochs of its source, then the
    words before the point at which the source's budget ends; one document of a source can be cut there. Nulls: a null size
    is 0, a null source is a source of its own, last in order, a null identifier is a key like any other. Documents without
    words, and all documents where no text has any, take 0. Repeated rows are documents each; so that rows of one identifier do
    not all lie in one cell, their sizes, and the columns in ``apart``, are part of the key. Sizes of any magnitude fit; an empty
    table gives an empty table. A column in ``keep`` may not be named like one of the first five.
    """
    n = lambda x: f"{_S}{x}"
    if clash := {c.lower() for c in keep} & {identifier.lower(), "size", "source_size", "target", "taken"}:
        raise ValueError(f"columns {sorted(clash)} cannot be kept under their names")
    rows = docs.select(
        F.col(identifier).alias(n("id")), F.col(source).alias(n("src")), F.coalesce(size, F.lit(0)).cast("long").alias(n("size")), random_key(F.col(identifier), seed, F.coalesce(size, F.lit(0)).cast("long"), *apart).alias(n("key")), *[F.col(c).alias(f"{_S}keep_{c}") for c in keep]
    )
    sizes = rows.groupBy(n("src")).agg(F.sum(n("size")).alias("source_size"), F.count(F.lit(1)).alias("docs")).withColumnRenamed(n("src"), "source")
    plan = source_targets(sizes, weights, share, max_epochs).select(
        F.col("source").alias(n("s")), F.col("no").alias(n("no")), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(CELL_ROWS))).cast("long").alias(n("cells"))
    )
    # floor(key * cells / 2^48) in whole numbers: 30 bits of the key are as good, and the product fits in a long
    cell = F.shiftright(F.shiftright(F.col(n("key")), KEY_BITS - 30) * F.col(n("cells")), 30)

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(plan, F.col(n("src")).eqNullSafe(F.col(n("s")))).drop(n("s")).withColumn(n("cell"), cell)

    slim = placed(rows.select(n("src"), n("size"), n("key")))
    cells = slim.groupBy(n("no"), n("cell")).agg(F.sum(n("size")).alias(n("sum"))).withColumn(n("group"), F.floor(F.col(n("cell")) / GROUP_CELLS))
    groups = _prefix(cells.groupBy(n("no"), n("group")).agg(F.sum(n("sum")).alias(n("gsum"))), [n("no")], [F.col(n("group"))], n("gsum"), n("before_group"))
    cells = _prefix(cells, [n("no"), n("group")], [F.col(n("cell"))], n("sum"), n("before_cell")).join(groups, [n("no"), n("group")])
    cells = cells.select(n("no"), n("cell"), (F.col(n("before_group")) + F.col(n("before_cell"))).alias(n("before")))
    # the join and the window share one exchange of the documents, by source and cell
    ranked = _prefix(placed(rows).join(cells, [n("no"), n("cell")]), [n("no"), n("cell")], [F.col(n("key")), F.col(n("id")), F.col(n("size"))], n("size"), n("in_cell"))
    budget = F.round("target").cast("long")
    epochs = F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))
    left = budget - epochs * F.col("source_size") - (F.col(n("before")) + F.col(n("in_cell")))
    taken = epochs * F.col(n("size")) + F.greatest(F.lit(0), F.least(left, F.col(n("size"))))
    return ranked.select(
        F.col(n("id")).alias(identifier), F.col(n("size")).alias("size"), F.col("source_size"), F.col("target"), taken.cast("long").alias("taken"), *[F.col(f"{_S}keep_{c}").alias(c) for c in keep]
    )


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` (doc_id, text, source and others of any names) that it takes, repeated by epoch, with all
    their columns.

    The one document of a source in which the budget ends gives its first words up to that point in its last epoch; ``n_chars``
    follows where there is such a column. Texts are otherwise unchanged. Null texts and texts without words are in no mix, a null
    source is a source of its own, repeated rows are documents each, and an empty table gives an empty table.
    """
    names = {c: f"{_S}own_{n}" for n, c in enumerate(docs.columns)}
    own = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    text, number = names["text"], names["doc_id"]
    keep = [n for n in names.values() if n != number]
    rows = mix(own, word_count(F.col(text)), number, names["source"], keep=keep, apart=[_content(text)], **options).filter("taken > 0")
    size, taken = F.col("size"), F.col("taken")
    part = taken % size
    repeats = F.sequence(F.lit(1), (F.floor(taken / size) + F.when(part > 0, 1).otherwise(0)).cast("int"))
    rows = rows.withColumn("__mix_n", F.explode(repeats))
    cut = (part > 0) & (F.col("__mix_n") > F.floor(taken / size))
    # the first `part` words: split keeps the words in order; only the cut document of each source is split
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != F.lit(""))
    rows = rows.withColumn(text, F.when(cut, F.array_join(F.slice(words, F.lit(1), part.cast("int")), " ")).otherwise(F.col(text)))
    if "n_chars" in names:
        rows = rows.withColumn(names["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def _content(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, word_count(F.col("text")), apart=[_content("text")])


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM s),
r AS (SELECT *, CAST(3 * sum(source_size) OVER () AS BIGINT)
         - 2 * CAST(coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lft,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS wl
      FROM w),
l AS (SELECT CAST(lft AS DOUBLE) / CAST(2 * wl AS DOUBLE) AS level, lft, wl FROM r WHERE weight * lft < 4 * source_size * wl
      ORDER BY source_size / weight, source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size,
        CASE WHEN weight * lft >= 4 * source_size * wl THEN CAST(2 * source_size AS DOUBLE)
             ELSE CAST(weight * (SELECT lft FROM l) AS DOUBLE) / CAST(2 * (SELECT wl FROM l) AS DOUBLE) END AS target FROM r),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST((budget // greatest(source_size, 1)) * size
    + greatest(0, least(budget - (budget // greatest(source_size, 1)) * source_size - before, size)) AS BIGINT) AS taken
FROM p
"""
