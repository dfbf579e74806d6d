"""A trie of conversation prefixes by ROLLUP over positional columns of turn ids.

A conversation is laid out in blocks of ``WIDTH`` turns: one row per block, one column per turn. One
``GROUP BY block, node, ROLLUP(t1, ..., t8)`` then forms the nodes of all depths at once, and
``grouping_id`` tells the depth of each. Long conversations go on in further blocks; these are keyed
by the node where the block before ends, so that equal columns below different prefixes stay apart.
A second ROLLUP over the same columns sums the nodes' own figures over their subtrees; totals of
further blocks are first added up along the blocks, in rounds that double the distance.

A turn's id is 128 bits of the SHA-256 of role and text. A node's id is the sum (two numbers modulo
2**53) of hashes of position and turn id along its path, so it is known for any prefix from running
totals. Neither a path nor the members of a node are ever gathered in one row: rows are combined
before they are shuffled, positions in a very long conversation are numbered in chunks, and the ids
that end at a node travel as texts of neighbouring ids, which one task hashes one after another
without holding them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voteframe.llm.common import map_arrow
from voteframe.operators.ordering import HOT_ROWS, null_safe_join, oversized, running_totals
from voteframe.session import cut_lineage

#: Turns a block has columns for.
WIDTH = 8
#: Conversations are rebuilt within families of ``FAMILY`` ids, with fewer than ``HEADS`` common turns.
FAMILY, HEADS = 20, 4
#: Ids that travel as one text lie in a range of this width.
RANGE = 4096
MASK = 2**53 - 1
BLANKS = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    return F.length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x"), BLANKS, ""))


def path_hashes(at: Column, turn: Column) -> tuple[Column, Column]:
    """What the turn at a position adds to the two numbers of a node's id."""
    return F.xxhash64(at, turn).bitwiseAND(F.lit(MASK)), F.xxhash64(turn, at, F.lit(1)).bitwiseAND(F.lit(MASK))


def ordered_turns(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``conv_id, at, turn, n_words``: the turns of each conversation numbered from 1 by the turn
    column, null first, and equal ones by role and id. A conversation of more than ``hot_rows``
    turns is numbered in chunks."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, role_col))
    known = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    slim = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("place"), role.alias("role"),
        F.unhex(F.substring(F.sha2(known.cast("binary"), 256), 1, 32)).alias("turn"),
        word_count(text).cast("long").alias("n_words"),
    )
    ties = [F.col("role"), F.col("turn")]
    if oversized(slim, ["conv_id"], hot_rows) is None:
        inside = Window.partitionBy("conv_id").orderBy(F.col("place").asc_nulls_first(), *ties)
        return slim.select("conv_id", F.row_number().over(inside).cast("long").alias("at"), "turn", "n_words")
    places = slim.groupBy("conv_id", "place").agg(F.count(F.lit(1)).alias("rows"))
    before = running_totals(places, ["conv_id"], "place", {"before": F.col("rows")}, hot_rows=hot_rows)
    equal = slim.withColumn("among", F.row_number().over(Window.partitionBy("conv_id", "place").orderBy(*ties)))
    numbered = null_safe_join(equal, before.drop("rows"), ["conv_id", "place"])
    return numbered.select("conv_id", (F.col("before") + F.col("among")).cast("long").alias("at"), "turn", "n_words")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """``conv_id, len`` of the rebuilt conversations, and their turns, ``conv_id, len, at, turn, n_words``.

    Conversation c takes the first h turns of conversation ``c - c % family``, with h the
    crc32 of its number modulo ``heads``, and then its own turns after its first h.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("at").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("at") < heads))
    # At most ``heads - 1`` turns in a list.
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "turn", "n_words"))).alias("head"))
    convs = sizes.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(first, "base", "left")
    taken = F.filter("head", lambda t: t["at"] <= F.col("h"))
    convs = convs.withColumn("head", F.when(F.col("head").isNull(), F.array().cast("array<struct<at:long,turn:binary,n_words:long>>")).otherwise(taken))
    n_head, rest = F.size("head").cast("long"), F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = convs.select("conv_id", "h", "head", n_head.alias("n_head"), (n_head + rest).alias("len"))
    common = convs.select("conv_id", "len", F.inline("head"))
    own = turns.join(convs.select("conv_id", "h", "n_head", "len"), "conv_id").where("at > h")
    own = own.select("conv_id", "len", (F.col("at") - F.col("h") + F.col("n_head")).alias("at"), "turn", "n_words")
    return convs.select("conv_id", "len"), common.unionByName(own)


def blocks(convs: DataFrame, turns: DataFrame, width: int, hot_rows: int) -> DataFrame:
    """``block, a, b, t1, ..., conv_id, len, end_a, end_b``: each conversation's turns in blocks, the
    id (a, b) of the node where the block begins and of the one where it ends. Every conversation has
    a first block, also one without turns."""
    a, b = path_hashes(F.col("at"), F.col("turn"))
    none = convs.select("conv_id", "len", *[F.lit(None).cast(k).alias(n) for n, k in (("at", "long"), ("turn", "binary"), ("n_words", "long"))])
    rows = turns.unionByName(none).withColumns({
        "block": F.coalesce(F.floor((F.col("at") - 1) / width), F.lit(0)).cast("long"), "a": F.when(F.col("at") > 0, a).otherwise(0),
        "b": F.when(F.col("at") > 0, b).otherwise(0),
    })
    slots = [
        F.max(F.when(F.col("at") == F.col("block") * width + i, F.struct("turn", "n_words"))).alias(f"t{i}")
        for i in range(1, width + 1)
    ]
    laid = rows.groupBy("conv_id", "block").agg(F.max("len").alias("len"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"), *slots)
    laid = cut_lineage(laid, "blocks")
    wide = {f"to_{x}": F.col(f"sum_{x}").cast("decimal(18,0)") for x in "ab"}
    placed = running_totals(laid, ["conv_id"], "block", wide, hot_rows=hot_rows)
    begin = {x: (F.col(f"to_{x}") % F.lit(MASK + 1)).cast("long") for x in "ab"}
    end = {f"end_{x}": (F.col(x) + F.col(f"sum_{x}")).bitwiseAND(F.lit(MASK)) for x in "ab"}
    return placed.withColumns(begin).withColumns(end).drop("to_a", "to_b", "sum_a", "sum_b")


def rolled_up(rows: DataFrame, width: int, figures: str) -> DataFrame:
    """The groups of all prefixes of the columns, without those that a shorter conversation leaves:
    ``level``, ``block, a, b, t1, ...`` and the figures."""
    columns = ", ".join(f"t{i}" for i in range(1, width + 1))
    groups = rows.sparkSession.sql(
        f"select block, a, b, {columns}, {width} - bit_count(grouping_id()) as level, {figures}"
        f" from {{rows}} group by block, a, b, rollup({columns})",
        rows=rows,
    )
    last = F.element_at(F.array(*[f"t{i}" for i in range(1, width + 1)]), F.greatest("level", F.lit(1)))
    return groups.withColumn("last", last).where("(level = 0 and block = 0) or (level > 0 and last is not null)")


def node_ids(groups: DataFrame, width: int) -> DataFrame:
    """Add ``depth`` and the ids of node and parent."""
    added: dict[str, Column] = {"depth": F.col("block") * width + F.col("level")}
    for lane, x in enumerate("ab"):
        steps = []
        for i in range(1, width + 1):
            at = F.col("block") * width + i
            steps.append((i, path_hashes(at, F.col(f"t{i}")["turn"])[lane]))
        total = lambda less: sum((F.when(F.col("level") - less >= i, step).otherwise(0) for i, step in steps), F.col(x))
        added[f"node_{x}"] = total(0).bitwiseAND(F.lit(MASK))
        added[f"up_{x}"] = F.when(F.col("level") > 0, total(1).bitwiseAND(F.lit(MASK)))
    return groups.withColumns(added)


def block_totals(nodes: DataFrame, width: int) -> DataFrame | None:
    """``node_a, node_b, more_saved, more_leaves``: for nodes at which a further block begins, the
    sums over all nodes below them; None if no conversation has a second block."""
    deepest = nodes.agg(F.max("block")).first()[0] or 0
    if not deepest:
        return None
    own = nodes.where("block > 0").groupBy("block", F.col("a").alias("node_a"), F.col("b").alias("node_b"))
    own = own.agg(F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaves"))
    over = nodes.where((F.col("level") == width) & (F.col("block") > 0)).select("node_a", "node_b", F.col("a").alias("far_a"), F.col("b").alias("far_b"))
    held = cut_lineage(own.drop("block").join(over, ["node_a", "node_b"], "left"), "totals")
    for _ in range((deepest - 1).bit_length()):
        below = held.where("far_a is not null").groupBy(F.col("far_a").alias("node_a"), F.col("far_b").alias("node_b"))
        below = below.agg(F.sum("more_saved").alias("s"), F.sum("more_leaves").alias("l"))
        farther = held.select(F.col("node_a").alias("far_a"), F.col("node_b").alias("far_b"), F.col("far_a").alias("x"), F.col("far_b").alias("y"))
        held = held.join(below, ["node_a", "node_b"], "left").join(farther, ["far_a", "far_b"], "left").select(
            "node_a", "node_b", (F.col("more_saved") + F.coalesce("s", F.lit(0))).alias("more_saved"),
            (F.col("more_leaves") + F.coalesce("l", F.lit(0))).alias("more_leaves"), F.col("x").alias("far_a"), F.col("y").alias("far_b"),
        )
        held = cut_lineage(held, "totals")
    return held.drop("far_a", "far_b")


def ends(laid: DataFrame, width: int) -> DataFrame:
    """``node_a, node_b, ends_sha256``: the hash of the ids, ascending, of the conversations that end
    at a node. Ids of a range are joined to one text; the texts of a node are hashed in turn."""
    final = laid.where(F.col("block") == F.floor(F.greatest(F.col("len") - 1, F.lit(0)) / width))
    chunks = final.groupBy("end_a", "end_b", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids")
    )
    ordered = chunks.repartition("end_a", "end_b").sortWithinPartitions("end_a", "end_b", "range")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for a, b, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) == now:
                    digest.update(b",")
                else:
                    done += [(*now, digest.hexdigest())] if now else []
                    now, digest = (a, b), hashlib.sha256()
                digest.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["node_a", "node_b", "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], ["node_a", "node_b", "ends_sha256"])

    return map_arrow(ordered, rows, "node_a long, node_b long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", width: int = WIDTH, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, from the root without turns:
    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    Null roles and texts count as empty. Rows with a null id belong to no conversation. Turns at the
    same place are ordered by role and id, repeated rows are turns of their own. A conversation that
    is left without turns ends at the root. An empty table has no nodes. Other columns are not read.
    """
    turns = cut_lineage(ordered_turns(conversations, id_col, turn_col, role_col, text_col, hot_rows), "turns")
    laid = cut_lineage(blocks(*rebuilt(turns), width, hot_rows), "laid")
    groups = rolled_up(laid, width, "count(*) as n_convs, min(conv_id) as conv_id, max(len) as deepest")
    nodes = node_ids(groups, width)
    n_words = F.when(F.col("level") > 0, F.col("last")["n_words"]).otherwise(F.lit(0))
    nodes = nodes.withColumns({
        "saved": (F.col("n_convs") - 1) * n_words, "leaf": (F.col("deepest") == F.col("depth")).cast("long"),
    }).drop("last", "deepest")
    nodes = cut_lineage(nodes, "nodes")
    node, up = ["node_a", "node_b"], ["up_a", "up_b"]
    further = block_totals(nodes, width)
    if further is None:
        measured = nodes
    else:
        borders = nodes.where(F.col("level") == width).join(further, node, "left")
        plus = {n: F.col(n) + F.coalesce(m, F.lit(0)) for n, m in (("saved", "more_saved"), ("leaf", "more_leaves"))}
        measured = borders.withColumns(plus).drop("more_saved", "more_leaves").unionByName(nodes.where(F.col("level") < width))
    sums = node_ids(rolled_up(measured, width, "sum(saved) as saved_tokens, sum(leaf) as n_leaves"), width)
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("node_a"), F.col("up_b").alias("node_b"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    found = nodes.select(*node, *up, "conv_id", "depth", "n_convs")
    found = found.join(sums.select(*node, "saved_tokens", "n_leaves"), node).join(children, node, "left").join(ends(laid, width), node, "left")
    parents = nodes.select(F.col("node_a").alias("up_a"), F.col("node_b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    found = found.join(parents, up, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


#: The nodes as lists of turn digests; crc32 is written out over the digits of the id.
TRIE_SQL = r"""
with steps as (select list(v order by i) as crc from (select i,
    list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
  from (select unnest(range(256)) as i))),
t as (select conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as turn_id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_words,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
sizes as (select conv_id, max(pos) as n from t group by conv_id),
convs as (select s.conv_id, s.n, s.conv_id - s.conv_id % 20 as base, xor(list_reduce(list_prepend(4294967295,
      list_transform(string_split(s.conv_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 4 as h
  from sizes s, steps),
placed as (select c.conv_id, t.pos, t.turn_id, t.n_words from convs c join t on t.conv_id = c.base where t.pos <= c.h
  union all select c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), t.turn_id, t.n_words
  from convs c join t on t.conv_id = c.conv_id and t.pos > c.h left join sizes b on b.conv_id = c.base),
paths as (select c.conv_id, coalesce(list(turn_id order by pos) filter (where pos is not null), []) as path,
    coalesce(list(n_words order by pos) filter (where pos is not null), []) as counts
  from convs c left join placed p on p.conv_id = c.conv_id group by c.conv_id),
members as (select conv_id, d, path[1:d] as prefix, len(path) as size, case when d > 0 then counts[d] else 0 end as n_words
  from (select *, unnest(range(0, len(path) + 1)) as d from paths)),
nodes as (select prefix, d, min(conv_id) as conv_id, count(*) as n_convs, max(n_words) as n_words, max(size) = d as leaf,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = d), '') as ended
  from members group by prefix, d),
below as (select prefix[1:k] as prefix, sum(leaf::int)::bigint as n_leaves, sum((n_convs - 1) * n_words)::bigint as saved_tokens
  from (select *, unnest(range(0, d + 1)) as k from nodes) group by 1),
children as (select prefix[1:d - 1] as prefix, count(*) as n_children from nodes where d > 0 group by 1)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children,
  b.n_leaves, b.saved_tokens, sha256(n.ended) as ends_sha256
from nodes n join below b on b.prefix = n.prefix left join children c on c.prefix = n.prefix
  left join nodes p on n.d > 0 and p.prefix = n.prefix[1:n.d - 1]
"""
