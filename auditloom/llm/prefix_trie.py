"""The trie of conversation prefixes, built level by level.

Turns are numbered within their conversation by one range sort, and equal conversations become one
class (its least conv_id, its size). A level groups the live classes by (node, next turn): each
group is a node, named by its least conv_id. A node that one class alone reaches begins a chain:
the rest of that class's turns are nodes of the same members, which need no more levels; so there
are as many levels as turns that two different conversations share. Levels are then joined back,
from the deepest up, to sum leaves and savings.

The text of a turn leaves the scan as 128 bits of its digest and its number of bytes. Nodes with
more than 1/256 of a level's classes, and conversations with more than 1/256 of all turns, are
given by broadcast, so no node and no conversation weighs on one task. Conv_ids of a class are
hashed from pieces that are joined in parallel; one task only feeds the pieces of a class, in
order, to its digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm._common import join_counted, small_batches, stored

#: Bytes of decimal conv_ids in a piece of a class's list.
PIECE_BYTES = 1 << 16
#: Turns of a chain that are summed together.
CHAIN_BLOCK = 1 << 12
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes) of each row with a conv_id; null role and text are empty."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.where("`conv_id` is not null")
    return rows.select(F.col("`conv_id`").cast("bigint").alias("conv_id"), F.col("`turn`").cast("bigint").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"))


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with place (1 for the first turn by number, null first, then by digest).

    The rows are range-sorted, so that a conversation of any length is spread over tasks; only the
    conversations at the ends of a partition go on in another, and their counts are broadcast.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            new = np.r_[ids[0] != last, ids[1:] != ids[:-1]]
            at = np.arange(len(ids))
            begin = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(begin < 0, count + at + 1, at - begin + 1)
            last, count = ids[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (0, 2, 3, 4)] + [pa.array(place, type=pa.int64())], names=["conv_id", "digest", "bytes", "part", "local"])

    local = stored(ranged.mapInArrow(number, "conv_id long, digest binary, bytes long, part int, local long"), "turns")
    sizes = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")).where("before > 0")
    # at most one conversation for each partition begins in an earlier one
    found = local.join(F.broadcast(before), ["conv_id", "part"], "left")
    return found.select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "bytes")


def rebuilt(conversations: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """((conv_id) of all conversations, (conv_id, depth, digest, bytes) of the rebuilt ones).

    Conversation c gets the first ``head(c)`` turns (at most ``most``) of conversation ``base(c)``,
    then its own after as many.
    """
    turns = stored(numbered(turns_of(conversations)), "numbered")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = lengths.select("conv_id", "n", base(F.col("conv_id")).alias("base"), head(F.col("conv_id")).cast("long").alias("head"))
    heads = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base")), "base", "left")
    heads = stored(heads.select("conv_id", "n", "base", "head", F.least("head", F.coalesce("of_base", F.lit(0))).alias("given")), "heads")
    own = join_counted(turns, heads, ["conv_id"], "n", ["head", "given"]).where("place > head")
    own = own.select("conv_id", (F.col("place") - F.col("head") + F.col("given")).alias("depth"), "digest", "bytes")
    first = turns.where(F.col("place") <= most).withColumnRenamed("conv_id", "base").join(heads.where("given > 0").select("base", "conv_id", "given"), "base").where("place <= given")
    return heads.select("conv_id"), own.unionByName(first.select("conv_id", F.col("place").alias("depth"), "digest", "bytes"))


def _classes(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, turns, kind): the number of turns and 128 bits over the whole sequence of each conversation."""
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("depth"), F.col("digest")))
    sums = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), mark(1).alias("xa"), mark(2).alias("xb"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return ids.join(sums, "conv_id", "left").select("conv_id", zero("turns"), zero("xa"), zero("xb"))


def ends_hashes(members: DataFrame) -> DataFrame:
    """(class, ends_sha256) from (class, conv_id): SHA-256 of the ascending decimal conv_ids, comma-joined."""
    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = members.select("class", "conv_id").repartitionByRange(parts, "class", "conv_id").sortWithinPartitions("class", "conv_id")

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, first, texts, size = None, None, [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([of]), pa.array([first]), pa.array([",".join(texts)])], names=["class", "first", "piece"])
        for batch in batches:
            classes, ids = batch.column(0).to_numpy(), batch.column(1)
            decimal, ids = pc.cast(ids, pa.string()), ids.to_numpy()
            cuts = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]]) if len(ids) else []
            for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                for s in range(a, b, 4096):
                    if texts and (of != classes[a] or size >= PIECE_BYTES):
                        yield done()
                        texts, size = [], 0
                    if not texts:
                        of, first = int(classes[a]), int(ids[s])
                    some = decimal.slice(s, min(b, s + 4096) - s).to_pylist()
                    texts += some
                    size += sum(map(len, some))
        if texts:
            yield done()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([of]), pa.array([state.hexdigest()])], names=["class", "ends_sha256"])
        for batch in batches:
            for key, piece in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if key != of:
                    if state is not None:
                        yield done()
                    of, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.as_buffer())
        if state is not None:
            yield done()

    # what is left of a class are pieces: a row for 64 KB of decimals
    joined = pieces.mapInArrow(join, "class long, first long, piece string")
    return joined.repartition("class").sortWithinPartitions("class", "first").mapInArrow(digest, "class long, ends_sha256 string")


def _levels(classes: DataFrame, turns: DataFrame, root: int) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """The shared nodes of each depth from 1, the chains, and where classes end at shared nodes.

    A shared node (node, depth, parent, n_convs, bytes) is reached by several classes. A chain
    (class, n, turns, depth, parent) begins at the first node that its class alone reaches. A class
    ends (class, node, depth) where others go on or it has no turns.
    """
    spark = classes.sparkSession
    live = classes.where("turns > 0").select("class", "n", "turns", F.lit(root).cast("long").alias("node"))
    shared, depth = [], 0
    chains = spark.createDataFrame([], "class long, n long, turns long, depth int, parent long")
    ends = classes.where("turns = 0").select("class", F.lit(root).cast("long").alias("node"), F.lit(0).alias("depth"))
    while True:
        depth += 1
        following = live.join(turns.where(F.col("depth") == depth).select(F.col("conv_id").alias("class"), "digest", "bytes"), "class")
        groups = following.groupBy("node", "digest").agg(F.min("class").alias("child"), F.sum("n").alias("n_convs"), F.count("*").alias("classes"), F.first("bytes").alias("bytes"))
        groups = stored(groups, "level")
        total = groups.agg(F.sum("classes")).first()[0]
        if not total:
            return shared, chains, ends
        several = groups.where("classes > 1")
        shared.append(several.select(F.col("child").alias("node"), F.lit(depth).alias("depth"), F.col("node").alias("parent"), "n_convs", "bytes"))
        told = stored(join_counted(following, groups, ["node", "digest"], "classes", ["child", "classes"], total=total), "told")
        chains = chains.unionByName(told.where("classes = 1").select("class", "n", "turns", F.lit(depth).alias("depth"), F.col("node").alias("parent")))
        ends = ends.unionByName(told.where((F.col("classes") > 1) & (F.col("turns") == depth)).select("class", F.col("child").alias("node"), F.lit(depth).alias("depth")))
        live = told.where((F.col("classes") > 1) & (F.col("turns") > depth)).select("class", "n", "turns", F.col("child").alias("node"))


def _chain_nodes(chains: DataFrame, turns: DataFrame) -> DataFrame:
    """(node, depth, parent, n_convs, n_children, n_leaves, saved_tokens, top) of all nodes of chains.

    Bytes are summed from the end of a chain in blocks of turns, so no window holds a whole long chain.
    """
    facts = chains.select(F.col("class").alias("conv_id"), "n", "turns", F.col("depth").alias("top"), "parent")
    rows = join_counted(turns, facts, ["conv_id"], "turns", ["n", "turns", "top", "parent"]).where("depth >= top")
    rows = rows.withColumn("block", F.expr(f"depth div {CHAIN_BLOCK}"))
    many = rows.where("n > 1")  # a chain of one conversation saves nothing
    blocks = many.groupBy("conv_id", "block").agg(F.sum("bytes").alias("bytes"))
    after = blocks.select("conv_id", "block", F.coalesce(F.sum("bytes").over(Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("after"))
    within = F.sum("bytes").over(Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")))
    summed = many.withColumn("within", within).join(after, ["conv_id", "block"]).withColumn("saved", (F.col("n") - 1) * (F.col("within") + F.col("after")))
    both = rows.where("n = 1").withColumn("saved", F.lit(0).cast("long")).unionByName(summed.drop("within", "after"))
    return both.select(
        F.col("conv_id").alias("node"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent"), F.col("n").alias("n_convs"),
        F.when(F.col("depth") < F.col("turns"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        (F.col("depth") == F.col("top")).alias("is_top"),
    )


def shared_base(conv_id: Column) -> Column:
    """The conversation whose first turns a conversation of the production query takes over."""
    return conv_id - conv_id % 5


def shared_head(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % 9


def prefix_trie(conversations: DataFrame, base: Callable[[Column], Column] = shared_base, head: Callable[[Column], Column] = shared_head, most: int = 8) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    Turns with one number come in the order of their digests, a null number first; repeated rows
    are turns of their own. Rows with a null conv_id belong to no conversation and are left out; a null
    role or text is empty; conversations without turns after rebuilding end at the root. An empty
    table has no nodes. Other columns are ignored.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    ids, turns = rebuilt(conversations, base, head, most)
    turns = stored(turns, "rebuilt")
    sequences = stored(_classes(ids, turns), "sequences")
    kinds = stored(sequences.groupBy("turns", "xa", "xb").agg(F.min("conv_id").alias("class"), F.count("*").alias("n")), "kinds")
    members = join_counted(sequences, kinds, ["turns", "xa", "xb"], "n", ["class"])
    hashes = stored(ends_hashes(members), "ends")
    whole = kinds.agg(F.min("class").alias("root"), F.sum("n").alias("n")).first()
    nodes = "node long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    if whole.root is None:
        found, ends = spark.createDataFrame([], nodes), kinds.select("class", F.col("class").alias("node"), F.col("turns").alias("depth"))
    else:
        with_turns = kinds.where("turns > 0").select(F.col("class").alias("conv_id"), "turns")
        turns = stored(join_counted(turns, with_turns, ["conv_id"], "turns", []), "class_turns")  # one conversation of each class
        shared, chains, ends = _levels(kinds, turns, whole.root)
        chains = stored(chains, "chains")
        ends = ends.unionByName(chains.select("class", F.col("class").alias("node"), F.col("turns").alias("depth")))
        chain_nodes = stored(_chain_nodes(chains, turns), "chain_nodes")
        found = chain_nodes.drop("is_top")
        tops = chain_nodes.where("is_top")
        root = spark.createDataFrame([(whole.root, 0, None, whole.n, 0)], "node long, depth int, parent long, n_convs long, bytes long")
        below = None
        for level in reversed([root, *shared]):
            here = level.select("node", F.col("depth").cast("long").alias("depth"), "parent", "n_convs", "bytes")
            depth = len(shared) if below is None else depth - 1
            children = tops.where(F.col("depth") == depth + 1).select("parent", "n_leaves", "saved_tokens")
            if below is not None:
                children = children.unionByName(below.select("parent", "n_leaves", "saved_tokens"))
            sums = children.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            below = here.join(sums, "node", "left").select(
                "node", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
                (F.coalesce("saved", F.lit(0).cast("long")) + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
            )
            below = stored(below, "rolled")
            found = found.unionByName(below)
    ends = ends.join(hashes, "class").select("node", "depth", "ends_sha256")
    return found.join(ends, ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256"),
    )


ORACLE_SQL = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
steps AS (
  SELECT DISTINCT conv_id, list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: list_concat([CAST(ascii(d) AS BIGINT)], list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))) AS todo
  FROM own),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(todo, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 9 AS h
  FROM steps),
first AS (SELECT c.conv_id, place AS depth, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND place <= h),
given AS (SELECT conv_id, h, (SELECT count(*) FROM first f WHERE f.conv_id = c.conv_id) AS given FROM convs c),
rebuilt AS (SELECT * FROM first UNION ALL SELECT conv_id, place - h + given, role, text FROM own JOIN given USING (conv_id) WHERE place > h),
prefixes AS (
  SELECT conv_id, depth, strlen(text) AS bytes, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
members AS (SELECT conv_id, depth, bytes, min(conv_id) OVER (PARTITION BY depth, key) AS node, max(depth) OVER (PARTITION BY conv_id) AS turns FROM prefixes),
nodes AS (
  SELECT node, depth, count(*) AS n_convs, min(bytes) AS bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256
  FROM members GROUP BY node, depth),
parents AS (SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN members m ON m.conv_id = n.node AND m.depth = n.depth - 1),
children AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE parent IS NOT NULL GROUP BY ALL),
counted AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN children USING (node, depth)),
sums AS (
  SELECT m.node, m.depth, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.bytes) AS saved_tokens
  FROM counted c JOIN members m ON m.conv_id = c.node AND m.depth <= c.depth GROUP BY m.node, m.depth)
SELECT CAST(node AS BIGINT) AS conv_id, CAST(depth AS BIGINT) AS depth, CAST(parent AS BIGINT) AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM counted JOIN sums USING (node, depth)
"""
