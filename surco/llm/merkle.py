"""Merkle manifest of a dataset: a hash tree per language over its documents, and one tree over the languages.

Every eight consecutive nodes of a level are one run and become the hash of their digests. A level is a table of
``(tree, at, digest)``; lag and lead columns of one to seven places, masked by the slot in the run and the run's length,
give a node its siblings, and the row at slot 0 of a run hashes the run. A run never crosses a block of 8 ** 4 nodes, so
windows are partitioned by block and no language is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surco.session import written_once

ARITY = 8
BLOCK_NODES = ARITY ** 4
#: Leaves of one sort, about.
PART_ROWS = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGEST = 64  # hex digits


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """Hash of the fields of a row, each ``-`` if null and else its length in bytes, a colon and the value."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def _placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Add ``at``, the gapless place from 0 within ``tree`` in the given order, and ``n``, the size of the tree.

    The rows are dealt by range of (tree, order), so a tree of any size lies in many partitions; only the number of rows of each
    tree in each partition meets in a window.
    """
    parts = max(1, rows.count() // PART_ROWS)
    number = written_once(
        rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order).withColumn("_row", F.monotonically_increasing_id()))
    number = number.withColumn("_part", F.shiftrightunsigned("_row", 33))
    sizes = number.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        tree, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(tree)).alias("n"))
    return (
        number.join(sizes, [tree, "_part"])
        .withColumn("at", F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_part", "_first", "_before")
    )


def _with_siblings(level: DataFrame) -> DataFrame:
    """``tree, at, digest, n`` with ``siblings`` (the digests of the run's others, left to right) and ``parent`` (at slot 0 only)."""
    slot = F.col("at") % ARITY
    run = F.least(F.lit(ARITY), F.col("n") - F.col("at") + slot)
    window = Window.partitionBy("tree", F.floor(F.col("at") / BLOCK_NODES)).orderBy("at")
    near = {f"_b{k}": F.when(slot >= k, F.lag("digest", k).over(window)) for k in range(1, ARITY)}
    near |= {f"_a{k}": F.when(slot + k < run, F.lead("digest", k).over(window)) for k in range(1, ARITY)}
    after = [F.col(f"_a{k}") for k in range(1, ARITY)]
    return level.withColumns(near).select(
        *level.columns,
        F.concat_ws("", *[F.col(f"_b{k}") for k in range(ARITY - 1, 0, -1)], *after).alias("siblings"),
        F.when(slot == 0, F.sha2(F.concat_ws("", "digest", *after), 256)).alias("parent"))


def _levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From ``tree, at, digest, n``: the levels with more than one node per tree, lowest first, and ``tree, digest`` of every root."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, level, roots = [], nodes, nodes.filter("n = 1").select("tree", "digest")
    while most > 1:
        level = written_once(_with_siblings(level.filter("n > 1").select("tree", "at", "digest", "n")))
        levels.append(level)
        level = level.filter("parent IS NOT NULL").select(
            "tree", F.floor(F.col("at") / ARITY).alias("at"), F.col("parent").alias("digest"), F.ceil(F.col("n") / ARITY).alias("n"))
        roots = roots.unionByName(level.filter("n = 1").select("tree", "digest"))
        most = -(-most // ARITY)
    return levels, written_once(roots)


def _paths(levels: list[DataFrame], top: DataFrame) -> DataFrame | None:
    """``tree, at, path`` of the nodes of the lowest level: the siblings of each level, then the path ``top`` of the tree.

    ``top(tree, path)`` ends every path. A node takes its parent's path; each level joins the one above it, an eighth as long.
    """
    above = None
    for level in reversed(levels):
        own = level.select("tree", "at", "siblings", "n", F.floor(F.col("at") / ARITY).alias("up"))
        # the root of a tree is no node of a level: there its own path begins
        ends = own.filter(F.col("n") <= ARITY).join(top, "tree").select("tree", "at", F.concat(F.array("siblings"), "path").alias("path"))
        if above is None:
            above = ends
        else:
            inner = own.filter(F.col("n") > ARITY).join(above.select("tree", F.col("at").alias("up"), "path"), ["tree", "up"])
            above = ends.unionByName(inner.select("tree", "at", F.concat(F.array("siblings"), "path").alias("path")))
    return above


def _folded(digest: Column, at: Column, n: Column, path: Column) -> Column:
    """The root from a leaf's digest and its path: in each level the node goes between the siblings before and after it.

    Steps of the tree of ``n`` leaves come first and go by ``at``; the path's later steps go by the place ``top_at`` in the upper tree.
    """
    start = F.struct(digest.alias("digest"), at.alias("at"), n.alias("n"), F.lit(False).alias("top"))

    def step(state: Column, siblings: Column) -> Column:
        switch = (state["n"] == 1) & ~state["top"]
        place = F.when(switch, F.col("top_at")).otherwise(state["at"])
        size = F.when(switch, F.col("top_n")).otherwise(state["n"])
        cut = (place % ARITY * _DIGEST).cast("int")
        node = F.concat(F.substring(siblings, F.lit(1), cut), state["digest"], F.substring(siblings, cut + 1, F.length(siblings)))
        return F.struct(
            F.sha2(node, 256).alias("digest"), F.floor(place / ARITY).alias("at"), F.ceil(size / ARITY).alias("n"), (state["top"] | switch).alias("top"))

    return F.aggregate(path, start, step)["digest"]


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, path`` (siblings by level, leaf to root), ``folded_root``, ``verified``.

    ``tampered`` is a digest per row of ``docs`` that is checked in place of the row's own (null: the row's own): it is folded with
    the original siblings, and ``verified`` says whether it leads to the root. Leaves ascend by ``doc_id`` within a language, null ids
    first, rows of one id by digest, so repeated rows are leaves of their own. Null fields count as such, empty texts as length 0; a
    null language is a language and comes first. An empty table gives no row. Only the columns of ``FIELDS`` are read, whatever else the table has.
    """
    lang = F.col("lang").cast("string")
    # a key that is never null and sorts as the language does, a null one first
    leaves = written_once(docs.select(
        "doc_id", F.when(lang.isNull(), "0").otherwise(F.concat(F.lit("1"), lang)).alias("tree"), leaf_digest().alias("digest"),
        (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered")))
    leaves = written_once(_placed(leaves, "tree", ["doc_id", "digest", "tampered"]))
    levels, subroots = _levels(leaves.select("tree", "at", "digest", "n"))
    upper = written_once(_placed(subroots.select(F.lit("").alias("all"), F.col("tree").alias("below"), "digest"), "all", ["below"]).withColumnRenamed("all", "tree"))
    upper_levels, root = _levels(upper.select("tree", "at", "digest", "n"))
    none = F.array().cast("array<string>")
    top = _paths(upper_levels, root.select("tree", none.alias("path")))
    if top is None:  # a single language, or none
        top = upper.select("tree", "at", none.alias("path"))
    tops = written_once(
        upper.join(top, ["tree", "at"]).join(root.select("tree", F.col("digest").alias("root")), "tree").select(
            F.col("below").alias("tree"), F.col("digest").alias("subroot"), "root", "path", F.col("at").alias("top_at"), F.col("n").alias("top_n")))
    paths = _paths(levels, tops.select("tree", "path"))
    named = leaves.join(tops.withColumnRenamed("path", "top_path"), "tree")
    if paths is not None:
        named = named.join(paths, ["tree", "at"], "left").withColumn("path", F.coalesce("path", "top_path"))
    else:
        named = named.withColumn("path", F.col("top_path"))
    folded = _folded(F.coalesce("tampered", "digest"), F.col("at"), F.col("n"), F.col("path"))
    return named.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def lower_cased(docs: DataFrame) -> Column:
    """The digest of a row with the letters A-Z of its text in lower case, where 3 divides the crc32 of its id (else null)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, leaf_digest(text=F.translate("text", _UPPER, _LOWER)))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest checked against texts that were lower-cased in about a third of the rows, with the proof as one digest."""
    return manifest(docs, lower_cased(docs)).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "path"), 256).alias("proof_sha256"), "folded_root", "verified")


def oracle() -> str:
    """The same rows by a recursive query: levels by grouping, proofs and folds step by step along the leaf's ancestors."""
    field = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    fields = [field.format(c) for c in FIELDS]
    crc = (
        "xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), "
        "lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))")
    up = f"""
        SELECT tree, pos // {ARITY} AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest, level + 1 AS level, (any_value(n) + {ARITY - 1}) // {ARITY} AS n
        FROM {{0}} WHERE n > 1 GROUP BY tree, pos // {ARITY}, level"""
    left, right = (f"coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos {side} w.pos), '')" for side in "<>")
    step = f"""
        SELECT w.id, w.pos // {ARITY} AS pos, w.level + 1 AS level, w.proof || {left} || {right} AS proof, sha256({left} || w.folded || {right}) AS folded, w.tree
        FROM {{0}} w JOIN {{1}} t ON t.tree = w.tree AND t.level = w.level AND t.pos // {ARITY} = w.pos // {ARITY} AND t.n > 1
        GROUP BY w.id, w.pos, w.level, w.proof, w.folded, w.tree"""
    return f"""
WITH RECURSIVE leaf AS (
    SELECT row_number() OVER () AS id, doc_id, lang, sha256({" || ".join(fields)}) AS digest,
        CASE WHEN {crc} % 3 = 0 THEN sha256({" || ".join(fields[:-1] + [field.format(lower)])}) END AS tampered
    FROM documents),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM leaf)),
placed AS (
    SELECT id, doc_id, tree, digest, tampered, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
    FROM leaf JOIN langs ON leaf.lang IS NOT DISTINCT FROM langs.lang),
low AS (SELECT tree, pos, digest, 0 AS level, n FROM placed UNION ALL ({up.format("low")})),
sub AS (SELECT tree, digest FROM low WHERE n = 1),
high AS (SELECT 0 AS tree, tree AS pos, digest, 0 AS level, (SELECT count(*) FROM sub) AS n FROM sub UNION ALL ({up.format("high")})),
walk AS (
    SELECT id, pos, 0 AS level, '' AS proof, coalesce(tampered, digest) AS folded, tree FROM placed UNION ALL ({step.format("walk", "low")})),
done AS (SELECT id, tree, proof, folded FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1),
climb AS (
    SELECT id, tree AS pos, 0 AS level, proof, folded, 0 AS tree FROM done UNION ALL ({step.format("climb", "high")})),
ended AS (SELECT id, proof, folded FROM climb QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1)
SELECT p.doc_id, p.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = r.digest AS verified
FROM placed p JOIN ended e USING (id) JOIN sub s USING (tree) CROSS JOIN (SELECT digest FROM high WHERE n = 1) r"""
