"""Prefix trie of rebuilt conversations by a splitter skeleton.

A conversation is a path of 16-byte turn digests.  Paths are range-partitioned into
shards of sorted rows; the first path of each shard is a splitter.  A trie node whose
members lie in two shards is a prefix of the splitter between them, so the tasks get the
splitter paths (the skeleton) and each shard finishes all other nodes by itself, in one
run over its sorted rows.  Skeleton nodes leave partial aggregates, which are reduced by
node; what a skeleton node adds to the subtrees above it follows from the reduced values.

Nothing is gathered whole.  Equal paths are told apart by conv_id, so a group of copies
spreads over many shards.  Turns are ranked by running sums over range partitions, and a
path is cut into segments of ``segment`` turns, each a row below the digest of the
segments before it.  Segments form tries of their own: a first run finds the sums of each,
its smallest member carries them, and running sums along that member's segments hand them
to the nodes above.  The splitters are at most ``max_shards`` rows of one segment.
The ids that end at a skeleton node pass through its hash shard by shard, as a stream.

Defined results: rows with a null conv_id take no part; a null turn comes first, a null
role or text is empty; turns of equal number come in the order of their digests; equal
rows are turns of their own; conversations left without turns end at the root; without
any conversation there is no root and no row; texts of any length count by their digest
and bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import only, running, spread_copies, staged

_TOKEN = 16
#: Turns that a conversation can take from another.
_HEADS = 9


def _turns(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, token, bytes, n, pid): distinct turn rows with their number, range-
    partitioned in conversation order; no texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = only(convs, conv_id="long", turn="long", role="string", text="string").where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.substring(F.unhex(digest), 1, _TOKEN).alias("token"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.groupBy("conv_id", "turn", "token", "bytes").agg(F.count("*").alias("n"))
    return staged(rows.repartitionByRange("conv_id", "turn", "token").withColumn("pid", F.spark_partition_id().cast("long")), "turns")


def rebuilt_turns(convs: DataFrame) -> DataFrame:
    """(conv_id, pos, token, bytes, total): every rebuilt conversation's turns, and for each
    conversation one row without a token."""
    turns = _turns(convs)
    sizes = staged(turns.groupBy("conv_id").agg(F.sum("n").alias("own")), "conversations")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % _HEADS
    base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    info = sizes.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(base, "base", "left")
    info = info.withColumn("n_base", F.least("h", F.coalesce("base_turns", F.lit(0)))).select(
        "conv_id", "h", "n_base", (F.col("n_base") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("total"))
    info = staged(info, "rebuilding")
    at = running(turns, ["conv_id"], F.col("pid"), [F.col("turn").asc_nulls_first(), F.col("token")], "start", F.col("n"), info)
    own = spread_copies(at, "n", "copy").withColumn("pos", F.col("start") + F.col("copy"))
    own = staged(own.select("conv_id", "pos", "token", "bytes", "h", "n_base", "total"), "places")
    near = F.transform(F.array(*[F.lit(i).cast("long") for i in range(-4, 5)]), lambda i: F.try_add(F.col("conv_id"), i))
    lent = own.where(f"pos < {_HEADS - 1} AND conv_id % 5 = 0").select(F.col("conv_id").alias("base"), "pos", "token", "bytes", F.explode(near).alias("conv_id"))
    heads = lent.where("conv_id - conv_id % 5 = base").join(info, "conv_id").where("pos < h").select("conv_id", "pos", "token", "bytes", "total")
    tails = own.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n_base")).alias("pos"), "token", "bytes", "total")
    none = info.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("token"), F.lit(0).cast("long").alias("bytes"), "total")
    return heads.unionByName(tails).unionByName(none)


def _running_segments(df: DataFrame, values: list[str], descending: bool = False) -> DataFrame:
    """``df`` with before_<value>: sums over the conversation's segments before (or after)."""
    df = df.withColumn("_b", F.floor(F.col("seg") / 1024))
    sums = df.groupBy("conv_id", "_b").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])

    def order(c):
        return F.col(c).desc() if descending else F.col(c)

    blocks = W.partitionBy("conv_id").orderBy(order("_b")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv_id", "_b", *[F.coalesce(F.sum(f"_s_{v}").over(blocks), F.lit(0)).alias(f"_p_{v}") for v in values])
    here = W.partitionBy("conv_id", "_b").orderBy(order("seg")).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns({f"_w_{v}": F.coalesce(F.sum(v).over(here), F.lit(0)) for v in values}).join(sums, ["conv_id", "_b"])
    return df.withColumns({f"before_{v}": F.col(f"_p_{v}") + F.col(f"_w_{v}") for v in values}).drop(
        "_b", *[f"{p}{v}" for v in values for p in ("_w_", "_p_")])


def segments(rebuilt: DataFrame, segment: int) -> DataFrame:
    """(conv_id, seg, key, next_key, path, lens, ends, carry_leaves, carry_saved): key names
    all segments before, by a sum of 240-bit hashes of their places and digests."""
    turn = F.when(F.col("token").isNotNull(), F.struct("pos", "token", "bytes"))
    rows = rebuilt.groupBy("conv_id", F.floor(F.col("pos") / segment).alias("seg")).agg(  # at most a segment of turns
        F.sort_array(F.collect_list(turn)).alias("t"), F.max("total").alias("total"))
    path = F.array_join(F.transform("t", lambda x: F.hex(x["token"])), "")
    rows = rows.select("conv_id", "seg", F.unhex(path).alias("path"), F.col("t.bytes").alias("lens"),
                       ((F.col("seg") + 1) * segment >= F.col("total")).alias("ends"), (F.col("total") > segment).alias("long"))
    rows = staged(rows, "segments")
    lanes = [f"k{i}" for i in range(4)]
    digest = F.sha2(F.concat(F.concat(F.col("seg").cast("string"), F.lit(":")).cast("binary"), F.col("path")), 256)
    long = rows.where("long").withColumn("d", digest).withColumns(
        {k: F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i, k in enumerate(lanes)})
    long = _running_segments(long, lanes)
    name = F.concat_ws("-", *[F.col(f"before_{k}").cast("string") for k in lanes])
    following = F.concat_ws("-", *[(F.col(f"before_{k}") + F.col(k)).cast("string") for k in lanes])
    out = ["conv_id", "seg", "path", "lens", "ends"]
    long = long.select(*out, F.when(F.col("seg") == 0, "").otherwise(name).alias("key"), following.alias("next_key"))
    short = rows.where("NOT long").select(*out, F.lit("").alias("key"), F.lit("").alias("next_key"))
    zero = F.lit(0).cast("long")
    return staged(short.unionByName(long).withColumns({"carry_leaves": zero, "carry_saved": zero}), "paths")


def _node(seg: int, key: str, prefix: bytes) -> bytes:
    return hashlib.blake2b(f"{seg}|{key}|".encode() + prefix, digest_size=16).digest()


class _Open:
    """A node of a shard's run whose members are still coming."""
    __slots__ = ("n", "least", "children", "leaves", "saved", "goes_on", "ending", "kids", "bytes", "next_key")

    def __init__(self, size: int):
        self.n = self.children = self.leaves = self.saved = self.goes_on = 0
        self.least = None
        self.ending: list[int] = []
        self.kids: list[dict] = []
        self.bytes = size
        self.next_key = ""


def _shared(a: bytes, b: bytes) -> int:
    """How many turns two paths share from their start."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // _TOKEN
    return next(d for d in range(most // _TOKEN) if a[d * _TOKEN:(d + 1) * _TOKEN] != b[d * _TOKEN:(d + 1) * _TOKEN])


_OUT = {"seg": pa.int64(), "rel": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "parent": pa.binary(), "n_convs": pa.int64(),
        "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends": pa.string(), "next_key": pa.string(),
        "node": pa.binary(), "above": pa.list_(pa.binary()), "goes_on": pa.int64(), "bytes": pa.int64(), "key": pa.string(), "shard": pa.int64()}
_SCHEMA = ("seg long, rel long, conv_id long, parent_conv_id long, parent binary, n_convs long, n_children long, n_leaves long, saved_tokens long, "
           "ends string, next_key string, node binary, above array<binary>, goes_on long, bytes long, key string, shard long")


def _run_shard(rows: list[tuple], splitters: list[tuple], shard: int) -> list[dict]:
    """Finished nodes (node null) and partial skeleton nodes of one shard's ``rows`` of
    (seg, key, path, conv_id, lens, ends, next_key, carry_leaves, carry_saved)."""
    rows.sort(key=lambda r: r[:4])
    out: list[dict] = []
    stack: list[_Open] = []
    trie = path = None

    def is_skeleton(rel):
        return rel == 0 or any(s[0] == trie[0] and s[1] == trie[1] and s[2][:rel * _TOKEN] == path[:rel * _TOKEN] and len(s[2]) >= rel * _TOKEN for s in splitters)

    def close():
        x, rel = stack.pop(), len(stack)
        row = {"seg": trie[0], "key": trie[1], "rel": rel, "conv_id": x.least, "n_convs": x.n, "next_key": x.next_key, "shard": shard}
        if is_skeleton(rel):
            ids = [_node(*trie, path[:d * _TOKEN]) for d in range(rel + 1)]
            row |= {"node": ids[-1], "above": ids[:-1], "n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved, "goes_on": x.goes_on,
                    "bytes": x.bytes, "ends": ",".join(map(str, x.ending)) if x.ending else None, "parent": ids[-2] if rel else None}
            for k in x.kids:
                k["parent"] = ids[-1]
        else:
            x.leaves += x.children == 0 and x.goes_on == 0
            x.saved += (x.n - 1) * x.bytes
            row |= {"n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved, "goes_on": x.goes_on,
                    "ends": hashlib.sha256(",".join(map(str, x.ending)).encode()).hexdigest()}
            for k in x.kids:
                k["parent_conv_id"] = x.least
            stack[-1].children += 1
            stack[-1].kids.append(row)
        out.append(row)
        if stack:
            up = stack[-1]
            up.n, up.leaves, up.saved = up.n + x.n, up.leaves + x.leaves, up.saved + x.saved
            up.least = x.least if up.least is None else min(up.least, x.least)

    for seg, key, p, conv, lens, ends, next_key, leaves, saved in rows:
        same = _shared(path, p) if trie == (seg, key) else -1
        while len(stack) > same + 1:
            close()
        trie, path = (seg, key), p
        while len(stack) <= len(p) // _TOKEN:
            stack.append(_Open(lens[len(stack) - 1] if stack else 0))
        x = stack[-1]
        x.n, x.leaves, x.saved = x.n + 1, x.leaves + leaves, x.saved + saved
        x.least = conv if x.least is None else min(x.least, conv)
        if ends:
            x.ending.append(conv)
        else:
            x.goes_on, x.next_key = x.goes_on + 1, next_key
    while stack:
        close()
    return out


def _stream_hashes(chunks: DataFrame) -> DataFrame:
    """(node, ends): the hash of each node's ids, comma between, chunk after chunk."""
    def run(batches):
        node, state = None, None
        for b in batches:
            done = []
            for n, ids in zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if n == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            yield pa.record_batch([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends"])
        if node is not None:
            yield pa.record_batch([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends"])

    return chunks.repartition("node").sortWithinPartitions("node", "shard").mapInArrow(run, "node binary, ends string")


def _nodes(paths: DataFrame, per_shard: int, max_shards: int) -> DataFrame:
    """(seg, rel, key, next_key, conv_id, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, goes_on) of every node of every segment trie."""
    shards = max(1, min(max_shards, -(-paths.count() // per_shard)))
    dealt = paths.repartitionByRange(shards, "seg", "key", "path", "conv_id").withColumn("shard", F.spark_partition_id().cast("long"))
    dealt = staged(dealt, "shards")
    # one row of one segment for each shard: at most max_shards
    firsts = dealt.groupBy("shard").agg(F.min(F.struct("seg", "key", "path", "conv_id")).alias("f")).orderBy("shard").select("shard", "f.*").collect()
    splitters = {r.shard: (r.seg, r.key, bytes(r.path)) for r in firsts}
    follow = {a.shard: b.shard for a, b in zip(firsts, firsts[1:])}
    sent = paths.sparkSession.sparkContext.broadcast((splitters, follow))
    names = ("seg", "key", "path", "conv_id", "lens", "ends", "next_key", "carry_leaves", "carry_saved")

    def run(table):
        splits, following = sent.value
        shard = table.column("shard")[0].as_py()
        near = [splits[s] for s in (shard, following.get(shard)) if s is not None]
        rows = _run_shard(list(zip(*(table.column(n).to_pylist() for n in names), strict=True)), near, shard)
        return pa.table({n: pa.array([r.get(n) for r in rows], t) for n, t in _OUT.items()})

    found = staged(dealt.groupBy("shard").applyInArrow(run, _SCHEMA), "nodes")
    parts = found.where("node IS NOT NULL")
    reduced = parts.groupBy("node").agg(
        F.first("seg").alias("seg"), F.first("rel").alias("rel"), F.first("key").alias("key"), F.max("next_key").alias("next_key"), F.first("parent").alias("parent"),
        F.first("above").alias("above"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.sum("goes_on").alias("goes_on"), F.max("bytes").alias("bytes"))
    below = reduced.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    skeleton = reduced.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    skeleton = staged(skeleton, "skeleton")  # at most the turns of the splitters, and a root a trie
    mine = skeleton.select(F.explode(F.concat("above", F.array("node"))).alias("node"),
                           ((F.col("n_children") == 0) & (F.col("goes_on") == 0)).cast("long").alias("leaf"),
                           ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    sums = mine.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    hashes = _stream_hashes(parts.where("ends IS NOT NULL").select("node", "shard", "ends"))
    parents = skeleton.select(F.col("node").alias("parent"), F.col("conv_id").alias("above_id"))
    top = skeleton.join(sums, "node").join(hashes, "node", "left").join(parents, "parent", "left").select(
        "seg", "rel", "key", "next_key", "conv_id", F.col("above_id").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256"), "goes_on")
    local = found.where("node IS NULL")
    columns = ["seg", "rel", "key", "next_key", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"), "goes_on"]
    inner = local.where("parent IS NULL").select(*columns)
    outer = local.where("parent IS NOT NULL").join(staged(parents, "parents"), "parent").withColumn("parent_conv_id", F.col("above_id")).select(*columns)
    return inner.unionByName(outer).unionByName(top)


def prefix_trie(convs: DataFrame, segment: int = 32, per_shard: int = 1024, max_shards: int = 20_000) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) for every node."""
    paths = segments(rebuilt_turns(convs), segment)
    deep = paths.where("seg > 0")
    if not deep.limit(1).count():
        nodes = _nodes(paths, per_shard, max_shards)
        return nodes.select("conv_id", F.col("rel").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    # each later trie's sums go to its smallest member, and along that to the segments above
    owned = _nodes(deep, per_shard, max_shards).where("rel = 0").select("conv_id", "seg", "n_leaves", "saved_tokens")
    chain = paths.join(paths.where("seg = 1").select("conv_id"), "conv_id", "left_semi").select("conv_id", "seg")
    chain = chain.join(staged(owned, "owned"), ["conv_id", "seg"], "left").fillna(0, ["n_leaves", "saved_tokens"])
    chain = staged(_running_segments(chain, ["n_leaves", "saved_tokens"], descending=True).select("conv_id", "seg", "before_n_leaves", "before_saved_tokens"), "carries")
    carried = paths.join(chain, ["conv_id", "seg"], "left").withColumns(
        {"carry_leaves": F.coalesce("before_n_leaves", F.lit(0)), "carry_saved": F.coalesce("before_saved_tokens", F.lit(0))}).drop("before_n_leaves", "before_saved_tokens")
    nodes = staged(_nodes(staged(carried, "paths-carried"), per_shard, max_shards), "segment-nodes")
    roots = nodes.where("rel = 0 AND seg > 0").select((F.col("seg") - 1).alias("seg"), F.col("key").alias("next_key"), F.col("n_children").alias("more"))
    # a later trie's root is the node that the segment before ends at, with more members
    tops = nodes.where("goes_on > 0").select((F.col("seg") + 1).alias("seg"), F.col("next_key").alias("key"), F.col("conv_id").alias("above_id"))
    first = nodes.where("rel = 1 AND seg > 0").join(staged(tops, "tops"), ["seg", "key"]).withColumn("parent_conv_id", F.col("above_id")).drop("above_id")
    ends = nodes.where("rel > 1 OR seg = 0").unionByName(first)
    last = ends.where("goes_on > 0").join(staged(roots, "roots"), ["seg", "next_key"], "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    return ends.where("goes_on = 0").unionByName(last).select(
        "conv_id", (F.col("seg") * segment + F.col("rel")).alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_query(convs: DataFrame) -> DataFrame:
    return prefix_trie(convs)


_CRC = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b: "
        "list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), "
        "4294967295::BIGINT)")
#: The same for DuckDB, with whole paths.
SQL = rf"""
WITH t AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), i AS (
  SELECT *, ({_CRC} % 9)::BIGINT AS h, conv_id - conv_id % 5 AS base FROM t
), r AS (
  SELECT i.conv_id, list_concat(coalesce(b.l, [])[1:h], i.l[h + 1:]) AS p FROM i LEFT JOIN t b ON b.conv_id = i.base
), m AS (
  SELECT conv_id, p[1:d] AS p, d, d = n AS ends FROM (SELECT conv_id, p, len(p) AS n, unnest(generate_series(0, len(p))) AS d FROM r)
), n AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY p, d
), c AS (
  SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(p[d].text) ELSE 0 END AS own FROM n LEFT JOIN c USING (p)
), s AS (
  SELECT p[1:a] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved
  FROM (SELECT p, n_children, own, unnest(generate_series(0, d)) AS a FROM v) GROUP BY ALL
)
SELECT v.conv_id, v.d::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN s ON s.p = v.p LEFT JOIN v u ON v.d > 0 AND u.p = v.p[1:v.d - 1]
"""
