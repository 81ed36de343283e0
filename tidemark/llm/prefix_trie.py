"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. Its key is the XOR of two 64-bit
hashes of (place, turn) over the sequence, so a prefix's key is a running XOR,
cut into blocks: no conversation, however long, is walked in one task.

The smallest member of a node owns it. A conversation owns a suffix of its path,
so the size of a subtree is a sum of one figure a member, without any recursion.
Sizes lead the decomposition. In a component of size S the nodes v with
2 * size(v) > S are the path from its top down to its centroid, which is the
smallest of them: a filter finds all centroids at once. The centroid goes, its
subtree's total is added along its path to the top, and the children's subtrees
and what is left above become components of their own, of half the size at most.
Components of bounded size are finished inside tasks, many to a task, by the same
steps on arrays; larger ones by DataFrame rounds, whose number is the logarithm
of the number of nodes over that bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.skew import join_groups
from tidemark.session import scratch

FAMILY, HEADS = 20, 4
BLOCK = 1024  # turns whose keys are summed in one window group
SLOT = 4096  # nodes of a chain that share one row of a lookup
COMPONENT, MOST_LARGE = 4096, 100_000
TASK_NODES = 1 << 16
KEY, PARENT, COMP = ["k1", "k2"], ["p1", "p2"], ["c1", "c2"]
WORD = r"[^\x20\x09-\x0D]+"
ENDS = "k1 long, k2 long, ends_sha256 string"
TOTALS = "k1 long, k2 long, leaves long, saved long"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: lineage ends here."""
    path = scratch(df.sparkSession, f"trie-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def positions(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos from 1, digest, words) of each turn, and (conv_id, n) of each conversation.

    Turns are range-partitioned by conversation and turn, which cuts long conversations and repeated rows over many
    tasks, and numbered by partition and place; a position is the distance from the conversation's first number.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    known = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    known = saved(known, "turns")  # hashed and counted once, not again for the sample that fixes the ranges
    by = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "row"]
    sorted_ = known.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = saved(sorted_.select("conv_id", "digest", "words", F.monotonically_increasing_id().alias("at")), "placed")
    part, local = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # one row for each partition of that write
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    numbered = placed.withColumn("part", part).join(F.broadcast(parts), "part").withColumn("place", F.col("ahead") + local)
    facts = saved(numbered.groupBy("conv_id").agg(F.min("place").alias("start"), F.count("*").alias("n")), "conversations")
    total = facts.agg(F.sum("n")).first()[0] or 0
    rows = join_groups(numbered.select("conv_id", "place", "digest", "words"), facts, ["conv_id"], "n", total)
    pos = (F.col("place") - F.col("start") + 1).alias("pos")
    return saved(rows.select("conv_id", pos, "digest", "words"), "positions"), facts.select("conv_id", "n")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, length, depth, digest, words) of each turn of the rebuilt conversations, and (conv, length) of each of them."""
    rows, sizes = positions(turns)
    own = sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("m"))
    own = own.join(first, "base", "left").withColumn("head", F.least("h", F.coalesce("m", F.lit(0))))
    own = saved(own.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")
    total = own.agg(F.sum("n")).first()[0] or 0
    tail = join_groups(rows, own.select("conv_id", "n", "h", "head", "length"), ["conv_id"], "n", total).where("pos > h")
    tail = tail.select(F.col("conv_id").alias("conv"), "length", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), "digest", "words")
    starts = rows.where((F.col("pos") < HEADS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    heads = starts.join(own.select("base", F.col("conv_id").alias("conv"), "head", "length"), "base").where("pos <= head")
    heads = heads.select("conv", "length", F.col("pos").alias("depth"), "digest", "words")
    return tail.unionByName(heads), own.select(F.col("conv_id").alias("conv"), "length")


def keyed(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, length, depth, k1, k2, p1, p2, words) of each prefix, that of no turns included: key of the prefix and of its parent."""
    hashed = rows.withColumn("g1", F.xxhash64(F.lit(1), "depth", "digest")).withColumn("g2", F.xxhash64("digest", "depth", F.lit(2)))
    hashed = hashed.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = hashed.groupBy("conv", "block").agg(F.bit_xor("g1").alias("b1"), F.bit_xor("g2").alias("b2"))
    zero = F.lit(0).cast("long")
    carry = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(b).over(ahead), zero).alias(b) for b in ("b1", "b2")]).where("block > 0")
    local = hashed.withColumn("x1", F.bit_xor("g1").over(inside)).withColumn("x2", F.bit_xor("g2").over(inside))
    both = local.join(carry, ["conv", "block"], "left")
    k = [F.col(f"x{i}").bitwiseXOR(F.coalesce(f"b{i}", zero)) for i in (1, 2)]
    below = both.select("conv", "length", "depth", k[0].alias("k1"), k[1].alias("k2"), k[0].bitwiseXOR(F.col("g1")).alias("p1"), k[1].bitwiseXOR(F.col("g2")).alias("p2"), "words")
    none = F.lit(None).cast("long")
    top = convs.select("conv", "length", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("words"))
    return below.unionByName(top)


def ends(rows: DataFrame) -> DataFrame:
    """ENDS of each node where a conversation ends.

    Ids are joined to strings in parallel, by ranges of 4096 ids; only the hash itself, which cannot be cut, runs over
    the strings of one node in order, as a stream of constant memory.
    """
    last = rows.where("depth = length")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = last.groupBy(*KEY, F.shiftright("conv", 12).alias("range")).agg(listed.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (a, b) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(ids.encode())
            if done:
                yield batch_of(done)
                done = []
        if key:
            yield batch_of([(*key, state.hexdigest())])

    def batch_of(done):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["k1", "k2", "ends_sha256"])

    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "range").select(*KEY, "ids").mapInArrow(run, ENDS)


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes: key, parent's key, depth, owner, n_convs, words, n_children, parent_conv_id, and size, the number of nodes of the subtree."""
    nodes = rows.groupBy(*KEY).agg(
        F.min("conv").alias("owner"),
        F.min_by("length", "conv").alias("length"),
        F.max("depth").alias("depth"),
        F.count("*").alias("n_convs"),
        F.max("words").alias("words"),
        *[F.max(p).alias(p) for p in PARENT],
    )
    nodes = saved(nodes, "nodes")
    # what a conversation owns counts in full at every node it passes above that, and at its own nodes from there to its end
    chains = nodes.groupBy("owner").agg(F.count("*").alias("owned"), F.min("depth").alias("top")).withColumnRenamed("owner", "conv")
    facts = saved(convs.join(chains, "conv", "left").withColumn("n", F.col("length") + 1), "chains")
    total = facts.agg(F.sum("n")).first()[0] or 0
    passed = join_groups(rows.select("conv", "depth", *KEY), facts, ["conv"], "n", total).where("owned IS NOT NULL AND depth < top")
    more = passed.groupBy(*KEY).agg(F.sum("owned").alias("more"))
    children = nodes.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    sized = nodes.join(more, KEY, "left").join(children, KEY, "left")
    sized = sized.withColumn("size", F.col("length") - F.col("depth") + 1 + F.coalesce("more", zero)).withColumn("n_children", F.coalesce("n_children", zero))
    sized = saved(sized.drop("length", "more"), "sized")
    parents = sized.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    return saved(join_groups(sized, parents, PARENT, "siblings", sized.count()).drop("siblings"), "trie")


# rollup


def split_components(parent: np.ndarray, comp: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of `values` (nodes x figures) over the subtree of each node in its component, without the node itself.

    parent: index of the parent, -1 at a component's top; comp: component of each node; size: nodes of the subtree.
    """
    n = len(parent)
    # preorder by pointer doubling: one more than the parent's, and past the earlier siblings
    by = np.argsort(parent, kind="stable")
    run = np.cumsum(size[by]) - size[by]
    head = np.flatnonzero(np.concatenate([[True], parent[by][1:] != parent[by][:-1]]))
    run -= np.repeat(run[head], np.diff(np.append(head, n)))
    pre = np.empty(n, np.int64)
    pre[by] = run + 1
    top = parent < 0
    pre[top] = 0
    up = np.where(top, np.arange(n), parent)
    while (up[up] != up).any():
        pre, up = pre + pre[up], up[up]
    whole, size = size, size.copy()
    out = np.zeros_like(values)
    at = np.lexsort((pre, comp))  # open nodes, in order of component and preorder
    label = comp[at]
    while len(at):
        start = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        each = np.diff(np.append(start, len(at)))
        k = np.repeat(np.arange(len(start)), each)
        on = 2 * size[at] > each[k]
        centre = np.maximum.reduceat(np.where(on, np.arange(len(at)), -1), start)
        mid = at[centre][k]
        below = (pre[at] > pre[mid]) & (pre[at] < pre[mid] + whole[mid])
        total = np.add.reduceat(np.where(below[:, None], values[at], 0), start, 0)
        above = on.copy()
        above[centre] = False
        out[at[centre]] += total
        out[at[above]] += (total[k] + values[mid])[above]
        size[at[above]] -= size[mid[above]]
        child = np.where(below & (parent[at] == mid), np.arange(len(at)), -1)
        label = np.where(below, len(at) + np.maximum.accumulate(child), k)
        keep = np.ones(len(at), bool)
        keep[centre] = False
        at, label = at[keep], label[keep]
        order = np.argsort(label, kind="stable")
        at, label = at[order], label[order]
    return out


def finished(key, group):
    """TOTALS of the nodes of whole components."""
    col = {c: group.column(c).fill_null(0).to_numpy() for c in [*KEY, *PARENT, *COMP, "size", "leaf", "weight", "leaves", "saved"]}
    index = dict(zip(zip(col["k1"].tolist(), col["k2"].tolist(), strict=True), range(group.num_rows), strict=True))
    at_top = (col["k1"] == col["c1"]) & (col["k2"] == col["c2"])
    up = [-1 if t else index[p] for t, p in zip(at_top.tolist(), zip(col["p1"].tolist(), col["p2"].tolist(), strict=True), strict=True)]
    comp = np.array([index[c] for c in zip(col["c1"].tolist(), col["c2"].tolist(), strict=True)], np.int64)
    got = split_components(np.array(up, np.int64), comp, col["size"], np.stack([col["leaf"], col["weight"]], 1))
    return pa.table({"k1": col["k1"], "k2": col["k2"], "leaves": col["leaves"] + got[:, 0], "saved": col["saved"] + got[:, 1]})


def split_round(now: DataFrame, rows: DataFrame) -> DataFrame:
    """Splits every component of `now` at its centroid. The centroids have `alive` false and are done.

    There are at most MOST_LARGE components, so that tables of one row a component may be broadcast.
    """
    whole = now.groupBy(*COMP).agg(F.max("size").alias("whole"))
    path = now.join(F.broadcast(whole), COMP).where("2 * size > whole")
    centre = path.groupBy(*COMP).agg(F.min_by(F.struct("k1", "k2", "depth", "size", "leaf", "weight"), "size").alias("mid"))
    known = now.join(F.broadcast(whole), COMP).join(F.broadcast(centre), COMP)
    # the ancestor right below the centroid's depth, asked once for each owner's chain: is it a child of the centroid?
    slot = F.floor(F.col("depth") / SLOT)
    deeper = known.where("depth > mid.depth").groupBy("owner", *COMP).agg(
        F.first("mid").alias("mid"), F.min(slot).alias("low"), F.max(slot).alias("high")
    )
    asked = deeper.select(F.col("owner").alias("conv"), (F.col("mid.depth") + 1).alias("depth"), *COMP, "mid", "low", "high")
    told = rows.join(asked, ["conv", "depth"]).where("p1 = mid.k1 AND p2 = mid.k2")
    told = told.select(F.col("conv").alias("owner"), *COMP, F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.explode(F.sequence("low", "high")).alias("slot"))
    # nodes above the centroid's depth are spread, as none of them is moved
    far = F.when(F.col("depth") > F.col("mid.depth"), slot).otherwise(-1 - F.col("depth"))
    moved = saved(known.withColumn("slot", far).join(told, ["owner", *COMP, "slot"], "left").drop("slot"), "moved")
    below = moved.where("n1 IS NOT NULL").groupBy(*COMP).agg(F.sum("leaf").alias("t1"), F.sum("weight").alias("t2"))
    both = moved.join(F.broadcast(below), COMP, "left")
    is_mid = (F.col("k1") == F.col("mid.k1")) & (F.col("k2") == F.col("mid.k2"))
    above = (2 * F.col("size") > F.col("whole")) & ~is_mid
    zero = F.lit(0).cast("long")
    gain = lambda t, v: F.when(is_mid | above, F.coalesce(t, zero) + F.when(above, F.col(v)).otherwise(zero)).otherwise(zero)
    split = both.select(
        *KEY,
        *PARENT,
        "owner",
        "depth",
        "leaf",
        "weight",
        F.when(above, F.col("size") - F.col("mid.size")).otherwise(F.col("size")).alias("size"),
        (F.col("leaves") + gain("t1", "mid.leaf")).alias("leaves"),
        (F.col("saved") + gain("t2", "mid.weight")).alias("saved"),
        *[F.coalesce(n, c).alias(c) for n, c in (("n1", "c1"), ("n2", "c2"))],
        (~is_mid).alias("alive"),
    )
    return saved(split, "split")


def rollup(nodes: DataFrame, rows: DataFrame, limit: int | None = None) -> DataFrame:
    """TOTALS of each node over its subtree: childless nodes, and the weights of all nodes.

    nodes: keys, parents' keys, owner, depth, size (of the subtree), leaf and weight; one tree, whose root has the
    key (0, 0). Components of at most `limit` nodes are finished inside tasks; there are never more than MOST_LARGE
    larger ones.
    """
    limit = limit or max(COMPONENT, nodes.count() // MOST_LARGE)
    root = [F.col(k).bitwiseAND(0).alias(c) for k, c in zip(KEY, COMP, strict=True)]  # the root's key as columns: joins on a literal are no hash joins
    now = nodes.select(*KEY, *PARENT, "owner", "depth", "leaf", "weight", "size", F.col("leaf").alias("leaves"), F.col("weight").alias("saved"), *root, F.lit(True).alias("alive"))
    done, small = [], []
    while True:
        alive = now.where("alive")
        large = alive.groupBy(*COMP).agg(F.max("size").alias("whole")).where(F.col("whole") > limit).select(*COMP)
        large = saved(large, "large")
        small.append(alive.join(F.broadcast(large), COMP, "left_anti"))
        if large.isEmpty():
            break
        now = split_round(alive.join(F.broadcast(large), COMP, "left_semi"), rows)
        done.append(now.where("NOT alive").select(*KEY, "leaves", "saved"))
    rest = small[0]
    for part in small[1:]:
        rest = rest.unionByName(part)
    sizes = rest.groupBy(*COMP).agg(F.max("size").alias("whole"))
    rest = saved(rest.join(sizes, COMP), "rest")
    out = rest.where("whole = 1").select(*KEY, "leaves", "saved")
    several = rest.where("whole > 1")
    tasks = max(1, several.count() // TASK_NODES)
    group = F.pmod(F.xxhash64(*COMP), F.lit(tasks * 4)).alias("task")
    out = out.unionByName(several.groupBy(group).applyInArrow(finished, TOTALS))
    for part in done:
        out = out.unionByName(part)
    return out


def prefix_trie(turns: DataFrame, limit: int | None = None) -> DataFrame:
    """The trie of rebuilt conversations, one row a node.

    turns: conv_id long, turn long, role string, text string; other columns are not read. Turns are ordered by turn,
    null first; turns of equal number by the SHA-256 of role and text; repeated rows are turns of their own. Null role
    or text is empty. Rows without conv_id are left out. A negative conv_id belongs to the family of the next larger
    multiple of 20, as its remainder is negative. An empty table gives no rows, as a root needs a member.
    """
    built, convs = rebuilt(turns)
    rows = saved(keyed(built, convs), "rows")
    nodes = trie(rows, convs)
    weights = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("weight", (F.col("n_convs") - 1) * F.col("words"))
    totals = rollup(weights, rows, limit)
    whole = nodes.join(totals, KEY).join(ends(rows), KEY, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return whole.select(
        F.col("owner").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
         xor(4294967295, list_reduce(CAST([4294967295] AS BIGINT[]) || flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
           lambda i: [CAST(ord(CAST(conv_id AS VARCHAR)[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) % 4 AS h
  FROM t GROUP BY conv_id
), b AS (SELECT c.*, least(c.h, coalesce(f.n, 0)) AS head FROM c LEFT JOIN c f ON f.conv_id = c.base),
turns AS (
  SELECT b.conv_id AS conv, t.pos AS depth, role, text FROM b JOIN t ON t.conv_id = b.base AND t.pos <= b.head
  UNION ALL
  SELECT b.conv_id, b.head + t.pos - b.h, role, text FROM b JOIN t ON t.conv_id = b.conv_id AND t.pos > b.h
), coded AS (SELECT conv, depth, sha256(length(role) || ':' || role || text) AS code, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns),
r AS (
  SELECT conv, depth, words, sha256(string_agg(code, ',') OVER (PARTITION BY conv ORDER BY depth)) AS k FROM coded
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), lengths AS (SELECT conv, max(depth) AS length FROM r GROUP BY conv),
p AS (SELECT r.*, lag(k) OVER (PARTITION BY conv ORDER BY depth) AS parent FROM r),
nodes AS (SELECT k, min(conv) AS conv_id, max(depth) AS depth, max(parent) AS parent, count(*) AS n_convs, max(words) AS words FROM p GROUP BY k),
kids AS (SELECT parent AS k, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
valued AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, CAST(coalesce(kids.n, 0) = 0 AS BIGINT) AS leaf, (n_convs - 1) * words AS weight FROM nodes LEFT JOIN kids USING (k)),
under AS (SELECT DISTINCT a.k AS k, z.k AS d FROM r a JOIN r z ON z.conv = a.conv AND z.depth >= a.depth),
sums AS (SELECT under.k, sum(leaf) AS n_leaves, sum(weight) AS saved FROM under JOIN valued ON valued.k = under.d GROUP BY under.k),
stops AS (SELECT r.k, string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) AS ids FROM r JOIN lengths USING (conv) WHERE r.depth = lengths.length GROUP BY r.k)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM valued v JOIN sums USING (k) LEFT JOIN valued q ON q.k = v.parent LEFT JOIN stops ON stops.k = v.k
"""
