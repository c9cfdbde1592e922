"""Merkle manifests of tables: a subtree for each group of rows, a tree over the subtrees, a path for every row.

A level pairs neighbours with lag and lead columns. All levels of one round work on the same rows in the
same order: a node stands in the row of its first leaf, so at level l the next node is ``arity ** l`` rows
on, and which offsets count follows from the node's slot in its run and the run's length. First-child rows
hash the run into the parent. A round climbs ``LEVELS`` levels inside aligned blocks of rows, so a window
never holds more than a block, however many rows a group has; the blocks' nodes are the next round's rows.
Paths come down the same way: each block's rows take their own siblings from the same lag and lead columns
and then those of their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parleylake.llm._shared import materialize, table
from parleylake.operators.ranges import numbered

ARITY, LEVELS = 2, 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def hashed(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts one after another; digests go in as hex text."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(values: list[Column]) -> Column:
    """A row's leaf: each value as its number of bytes, a colon and the value, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return hashed(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def group_key(group: Column) -> Column:
    """A text that sorts as the group does, null first, and is never null."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def _climbed(rows: DataFrame, arity: int, levels: int) -> tuple[DataFrame, str, list[Column]]:
    """``rows`` (group, pos, n, node, ...) with the nodes of each level and the siblings on its way, as columns of first-leaf rows.

    Returns the rows, the column of the block's node, and for each level whether it exists, and its left and right siblings.
    """
    width, node, path = arity**levels, "node", []
    rows = rows.withColumn("_block", F.floor(F.col("pos") / width))
    inner = Window.partitionBy("group", "_block").orderBy("pos")
    for level in range(levels):
        step = arity**level
        index, count = F.floor(F.col("pos") / step), F.ceil(F.col("n") / step)
        slot = index % arity
        first, more = F.col("pos") % step == 0, count > 1  # the row holds a node of this level; it isn't the only one
        run = F.least(F.lit(arity), count - (index - slot))
        near = {j: (F.lag if j < 0 else F.lead)(node, abs(j) * step).over(inner) for j in range(1 - arity, arity) if j}
        rows = rows.select("*", *[column.alias(f"_{level}_{'l' if j < 0 else 'r'}{abs(j)}") for j, column in near.items()])
        left = F.concat(F.lit(""), *[F.when(slot >= j, F.col(f"_{level}_l{j}")).otherwise("") for j in range(arity - 1, 0, -1)])
        right = F.concat(F.lit(""), *[F.when(run - slot > j, F.col(f"_{level}_r{j}")).otherwise("") for j in range(1, arity)])
        parent = F.when(more, hashed(F.col(node), F.col(f"_right{level}"))).otherwise(F.col(node))
        rows = rows.withColumn(f"_left{level}", F.when(first & more, left)).withColumn(f"_right{level}", F.when(first & more, right))
        rows = rows.withColumn(f"_node{level + 1}", F.when(first & (slot == 0), parent)).drop(*[f"_{level}_{'l' if j < 0 else 'r'}{abs(j)}" for j in near])
        node = f"_node{level + 1}"
        path.append((more, f"_left{level}", f"_right{level}"))
    return rows, node, path


def _parents(rows: DataFrame, arity: int, levels: int) -> DataFrame:
    """(group, pos, n, node) of the blocks of ``rows``: the next round's rows."""
    climbed, node, _ = _climbed(rows.select("group", "pos", "n", "node"), arity, levels)
    width = arity**levels
    return climbed.where(F.col("pos") % width == 0).select("group", F.col("_block").alias("pos"), F.ceil(F.col("n") / width).alias("n"), F.col(node).alias("node"))


def _with_paths(rows: DataFrame, above: DataFrame, arity: int, levels: int) -> DataFrame:
    """``rows`` with their block's columns of ``above`` (group, pos, path, ...) and ``path``: (left, right) from the row's own level to the top."""
    blocks = above.select(F.col("group").alias("_group"), F.col("pos").alias("_pos"), *[F.col(c).alias(f"_above_{c}") for c in above.columns if c not in ("group", "pos")])
    met = rows.join(blocks, (F.col("group") == F.col("_group")) & (F.floor(F.col("pos") / arity**levels) == F.col("_pos"))).drop("_group", "_pos")
    climbed, _, path = _climbed(met, arity, levels)
    held = Window.partitionBy("group", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    names = [c for _, left, right in path for c in (left, right)]
    filled = climbed.select(*met.columns, *[F.last(c, ignorenulls=True).over(held).alias(c) for c in names])  # a node's first row gives its siblings to the others
    own = F.array_compact(F.array(*[F.when(more, F.struct(F.col(left).alias("left"), F.col(right).alias("right"))) for more, left, right in path]))
    kept = [F.col(f"_above_{c}").alias(c) for c in above.columns if c not in ("group", "pos", "path")]
    return filled.select(*rows.columns, *kept, F.concat(own, "_above_path").alias("path"))


def climb(rows: DataFrame, top=None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``rows`` (group, pos from 0, n, node, ...) with ``subroot``, what ``top`` adds, and ``path``, each row's siblings up to the top.

    ``group`` isn't null; positions have no gaps, ``n`` counts them. ``top`` maps the groups' (group, subroot) to
    a table with ``path`` and other columns of theirs; without it paths end at the subroot.
    """
    rounds, size = [(rows, 0)], rows.agg(F.max("n")).first()[0] or 0
    while size > 1:
        taken = next(k for k in range(1, levels + 1) if k == levels or arity**k >= size)  # no levels that no group has
        rounds[-1] = (rounds[-1][0], taken)
        rounds.append((materialize(_parents(rounds[-1][0], arity, taken)), 0))
        size = -(-size // arity**taken)
    groups = rounds.pop()[0].select("group", F.col("node").alias("subroot"))
    above = top(groups) if top else groups.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    above = above.withColumn("pos", F.lit(0).cast("long"))
    if not rounds:
        return rows.join(above.drop("pos"), "group")
    for held, taken in reversed(rounds[1:]):
        above = materialize(_with_paths(held.select("group", "pos", "n", "node"), above, arity, taken).drop("n", "node"))
    return _with_paths(rows, above, arity, rounds[0][1])


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to along ``path``."""
    return F.aggregate(path, start, lambda node, x: hashed(x["left"], node, x["right"]))


def proof(path: Column) -> Column:
    """The siblings of a path one after another, from the bottom."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (group, node, ...) with ``pos`` and ``n`` within the group by ``order``. A group may hold any share of the rows."""
    return numbered(leaves, order, "pos", within=["group"], total="n").withColumn("pos", F.col("pos") - 1)


def manifest(rows: DataFrame, fields: list[str], group: str, order: str, arity: int = ARITY, levels: int = LEVELS, changed: dict[str, Column] | None = None) -> DataFrame:
    """Every row's ``leaf``, ``subroot`` (of its group), ``root``, ``path`` and, with ``changed`` (other values of fields), ``start``, the leaf that these give.

    Groups are in the order of their texts, nulls first; within them rows are by ``order``, then by leaf.
    Null values have a mark of their own; texts are hashed whole, however long; repeated rows are leaves of
    their own; columns besides ``fields`` don't count; an empty table gives no rows.
    """
    values = lambda other: leaf_of([other.get(c, F.col(c)) for c in fields])
    leaves = rows.select(
        F.col(order).alias("key"), group_key(F.col(group)).alias("group"), values({}).alias("node"), (values(changed) if changed else F.lit(None).cast("string")).alias("start"), F.monotonically_increasing_id().alias("row")
    )
    leaves = materialize(leaves.withColumn("start", F.when(F.col("start") != F.col("node"), F.col("start"))))  # no text goes further
    leaves = materialize(placed(leaves, ["key", "node", "row"]).select("group", "pos", "n", "node", "key", "start"))

    def top(groups: DataFrame) -> DataFrame:
        """The tree over the groups' subroots: they are its leaves."""
        listed = numbered(groups.withColumn("of", F.lit("")), ["group"], "pos", within=["of"], total="n")
        nodes = materialize(listed.select(F.col("of").alias("group"), F.col("pos") - 1, "n", F.col("subroot").alias("node"), F.col("group").alias("own")).toDF("group", "pos", "n", "node", "own"))
        return materialize(climb(nodes, None, arity, levels).select(F.col("own").alias("group"), F.col("node").alias("subroot"), F.col("subroot").alias("root"), "path"))

    found = climb(leaves, top, arity, levels)
    return found.select("key", F.col("node").alias("leaf"), F.coalesce("start", "node").alias("start"), "subroot", "root", "path")


def verified(found: DataFrame) -> DataFrame:
    """``found`` of ``manifest`` with ``folded_root``, that ``start`` leads to, and ``verified``, whether it is the root."""
    rows = found.withColumn("folded_root", folded(F.col("start"), F.col("path")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a subtree a language; of those whose id's CRC-32 is divisible by 7, ``n_chars`` is tampered with."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = verified(manifest(table(spark, sf_dir, "documents"), FIELDS, "lang", "doc_id", changed={"n_chars": tampered}))
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


#: DuckDB has no CRC-32, so a bitwise one over the decimal digits stands in the macro's place: eight steps a byte.
_CRC = """(SELECT xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(flatten(list_transform(range(1, length({0}) + 1), lambda i: [i, 0, 0, 0, 0, 0, 0, 0, 0])), lambda i: CASE WHEN i > 0 THEN 4294967296::UBIGINT + ascii(substr({0}, i, 1)) ELSE 8589934592::UBIGINT END)),
  lambda c, x: CASE WHEN x < 8589934592 THEN xor(c, x - 4294967296) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END), 4294967295::UBIGINT))"""


def _leaf_sql(n_chars: str) -> str:
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {_leaf_sql("n_chars")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC.format("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS start FROM documents),
  l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
  t(g, lv, i, n, h) AS (SELECT g, 0, i, n, leaf FROM l
    UNION ALL SELECT g, lv + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, lv, i // 2),
  s AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
  u(lv, i, n, h) AS (SELECT 0, i, n, h FROM s UNION ALL SELECT lv + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lv, i // 2),
  root AS (SELECT h AS root FROM u WHERE n = 1),
  low AS (SELECT l.g, l.i AS leaf_i, list(CASE WHEN b.h IS NULL THEN 'N' WHEN b.i % 2 = 0 THEN 'L' || b.h ELSE 'R' || b.h END ORDER BY a.lv) AS steps
          FROM l JOIN t a ON a.g = l.g AND a.n > 1 AND a.i = l.i >> a.lv LEFT JOIN t b ON b.g = a.g AND b.lv = a.lv AND b.i = xor(a.i, 1) GROUP BY ALL),
  high AS (SELECT s.g, list(CASE WHEN b.h IS NULL THEN 'N' WHEN b.i % 2 = 0 THEN 'L' || b.h ELSE 'R' || b.h END ORDER BY a.lv) AS steps
           FROM s JOIN u a ON a.n > 1 AND a.i = s.i >> a.lv LEFT JOIN u b ON b.lv = a.lv AND b.i = xor(a.i, 1) GROUP BY ALL),
  w AS (SELECT doc_id, leaf, start, s.h AS subroot, root, coalesce(low.steps, []) || coalesce(high.steps, []) AS steps
        FROM l JOIN s USING (g) CROSS JOIN root LEFT JOIN low ON low.g = l.g AND low.leaf_i = l.i LEFT JOIN high ON high.g = l.g),
  f AS (SELECT *, list_reduce(list_prepend(start, steps), lambda a, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || a) WHEN 'R' THEN sha256(a || x[2:]) ELSE sha256(a) END) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
