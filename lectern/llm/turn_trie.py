"""Conversation prefix trie: burst tries over packed turn ids.

A turn's id is 20 bytes: 16 of the SHA-256 of its role and text, and 4 with the number of its words, big-endian.  A
conversation is the concatenation of its ids, so that the byte order of conversations is the order of a trie's sweep, and
a prefix of d turns is a prefix of 20 d bytes.  Equal conversations become one suffix with a count first.

A container holds the suffixes under one prefix.  Containers with more than ``limit`` suffixes are burst: their suffixes
go to new containers by their next turn id, one round of grouping for all of them, and turns that all suffixes of a
container share are passed in the same round.  Burst prefixes are the trie's heads.  What is left is dealt to shards by
container, sorted, and swept into nodes; the containers' totals are then added up to their heads.

A third of all conversations may share their first turns: their container is burst by what comes next.  A third may be
equal: they are one suffix, and the list of their ids is hashed in pieces of a fixed range of ids.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, give_back, stored

#: Bytes of a turn id.
WIDTH = 20
#: Suffixes that a container holds, and turns of several suffixes.
LIMIT, TURNS = 256, 1 << 19
#: Ids of one range, 2 to this power, are one piece of a digest.
PIECE_BITS = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _prefix(seq: F.Column, depth: F.Column) -> F.Column:
    return F.substring(seq, F.lit(1), (depth * WIDTH).cast("int"))


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id as hex): null roles and texts are empty; turns without a conv_id take no part."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * (WIDTH - 4))
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")), 8, "0")
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.upper(F.concat(named, words)).alias("id"))


def rebuilt(conversations: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """(conv_id, seq): the first h turns of conversation c - c % group, then c's own after its first h; h = crc32(c) % shared."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "id"))), lambda t: t["id"])
    own = stored(turn_ids(conversations).groupBy("conv_id").agg(F.unhex(F.array_join(ordered, "")).alias("own")), "turn-rows")
    first = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.substring("own", 1, WIDTH * (shared - 1)).alias("first"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    keyed = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left")
    rest = F.substring("own", (h * WIDTH + 1).cast("int"), F.octet_length("own"))
    return keyed.select("conv_id", F.concat(_prefix(F.coalesce("first", F.lit(b"")), h), rest).alias("seq"))


def suffixes(conversations: DataFrame) -> DataFrame:
    """(seq, n, least, ends) of each distinct conversation: how many have it, the smallest id, the digest of all ids.

    Ids are listed in pieces of at most 2**PIECE_BITS; a shard reads the pieces of a conversation in order and adds
    each to the digest, so that no list is held whole.
    """
    ids = F.sort_array(F.collect_list("conv_id"))
    pieces = conversations.groupBy("seq", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(ids.alias("ids"))
    pieces = pieces.select("seq", "piece", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("least"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("listed"))

    def digest(batches):
        seq, n, least, sha = None, 0, 0, None
        out: list[tuple] = []
        for pdf in batches:
            for s, count, low, listed in zip(pdf["seq"], pdf["n"], pdf["least"], pdf["listed"], strict=True):
                if s != seq:
                    if sha is not None:
                        out.append((seq, n, least, sha.hexdigest()))
                    seq, n, least, sha = s, 0, low, hashlib.sha256()
                sha.update(f"{',' if n else ''}{listed}".encode())
                n += count
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["seq", "n", "least", "ends"])
                out = []
        if sha is not None:
            out.append((seq, n, least, sha.hexdigest()))
            yield pd.DataFrame(out, columns=["seq", "n", "least", "ends"])

    shards = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(shards, "seq").sortWithinPartitions("seq", "piece").select("seq", "n", "least", "listed")
    with batch_rows(conversations.sparkSession, 5_000):
        return stored(dealt.mapInPandas(digest, "seq binary, n long, least long, ends string"), "suffixes")


def _shared_turns(a: F.Column, b: F.Column) -> F.Column:
    """How many whole turns two packed conversations begin with alike."""
    most = (F.least(F.octet_length(a), F.octet_length(b)) / WIDTH).cast("int")
    at = lambda x, i: F.substring(x, (i - 1) * WIDTH + 1, F.lit(WIDTH))
    step = lambda n, i: F.when((n == i - 1) & (at(a, i) == at(b, i)), i).otherwise(n)
    return F.when(most > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0), step)).otherwise(0)


def burst(rows: DataFrame, limit: int = LIMIT, turns: int = TURNS) -> tuple[DataFrame, int]:
    """(rows with the depth of each suffix's container, null where it ends at a head; the number of rounds).

    A container of ``depth`` turns is burst if it has more than ``limit`` suffixes, or several with more than ``turns``
    turns together.  Its suffixes agree on ``shared`` turns, so its prefixes of ``depth`` to ``shared`` turns are heads.
    Rounds go on until no container is over a limit; only whether there is one reaches the driver.
    """
    held, rounds = rows.withColumn("depth", F.lit(0)), 0
    moved = held
    while True:
        sizes = moved.where(F.col("depth").isNotNull()).groupBy(_prefix(F.col("seq"), F.col("depth")).alias("key"), "depth").agg(F.count("*").alias("size"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.sum(F.octet_length("seq").cast("long")).alias("bytes"))
        full = (F.col("size") > limit) | ((F.col("size") > 1) & (F.col("bytes") > turns * WIDTH))
        over = stored(sizes.where(full).select("key", "depth", _shared_turns(F.col("low"), F.col("high")).alias("shared")), "bursts")
        if over.isEmpty():
            return held, rounds
        rounds += 1
        there = over.select(F.col("key").alias("_key"), F.col("depth").alias("_depth"), "shared")
        at = (_prefix(F.col("seq"), F.col("depth")) == F.col("_key")) & (F.col("depth") == F.col("_depth"))
        deeper = F.when(F.octet_length("seq") > F.col("shared") * WIDTH, F.col("shared") + 1)
        held = held.join(there, at, "left").select(*rows.columns, F.when(F.col("shared").isNull(), F.col("depth")).otherwise(deeper).alias("depth"), F.col("shared").isNotNull().alias("moved"))
        moved, held = held.where("moved"), held.drop("moved")


def _forest(rows: list[tuple]) -> list[tuple]:
    """Nodes of whole containers from their sorted suffixes (seq, depth of the container, n, least, ends)."""
    up, depth, words, n, least, leaves, saved, children, ends = ([] for _ in range(9))
    path: list[int] = []
    roots: dict[int, bytes] = {}
    last, base = b"", 0

    def grow(parent: int, at: int, word_count: int) -> None:
        path.append(len(up))
        for column, value in zip((up, depth, words, n, least, leaves, saved, children, ends), (parent, at, word_count, 0, None, 0, 0, 0, NO_ENDS), strict=True):
            column.append(value)

    for seq, d, count, low, sha in rows:
        head = d * WIDTH
        if not path or base != d or last[:head] != seq[:head]:
            base, alike = d, d
            path.clear()
            roots[len(up)] = seq[:head]
            grow(-1, d, int.from_bytes(seq[head - 4 : head], "big") if d else 0)
        else:
            alike = d
            while (at := alike * WIDTH) < len(last) and last[at : at + WIDTH] == seq[at : at + WIDTH]:
                alike += 1
            del path[alike - d + 1 :]
        for at in range(alike * WIDTH, len(seq), WIDTH):
            grow(path[-1], at // WIDTH + 1, int.from_bytes(seq[at + WIDTH - 4 : at + WIDTH], "big"))
        n[path[-1]], least[path[-1]], ends[path[-1]] = count, low, sha
        last = seq
    for i in range(len(up) - 1, -1, -1):  # a node's descendants come after it
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * words[i]
        if (p := up[i]) >= 0:
            n[p] += n[i]
            least[p] = least[i] if least[p] is None else min(least[p], least[i])
            leaves[p] += leaves[i]
            saved[p] += saved[i]
            children[p] += 1
    return [(roots.get(i), least[i], depth[i], None if up[i] < 0 else least[up[i]], n[i], children[i], leaves[i], saved[i], ends[i]) for i in range(len(up))]


def sweep(settled: DataFrame) -> DataFrame:
    """The nodes of all containers; ``root`` is the prefix of a container's own node and null elsewhere."""

    def swept(batches):
        kept: list[tuple] = []
        for pdf in batches:
            rows = list(zip(pdf["seq"], pdf["depth"].tolist(), pdf["n"].tolist(), pdf["least"].tolist(), pdf["ends"], strict=True))
            for i in range(len(rows) - 1, -1, -1):  # the last container of a batch may go on in the next one
                if i == 0 or rows[i - 1][1] != rows[i][1] or rows[i - 1][0][: rows[i][1] * WIDTH] != rows[i][0][: rows[i][1] * WIDTH]:
                    break
            else:
                continue
            first = rows[0]
            goes_on = kept and i == 0 and kept[-1][1] == first[1] and kept[-1][0][: first[1] * WIDTH] == first[0][: first[1] * WIDTH]
            done, kept = ([], kept + rows) if goes_on else (kept + rows[:i], rows[i:])
            if done:
                yield frame(_forest(done))
        if kept:
            yield frame(_forest(kept))
        give_back()

    def frame(nodes: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(nodes, columns=["root", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])
        return out.astype({"parent_conv_id": "Int64"})

    shards = int(settled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled.repartition(shards, _prefix(F.col("seq"), F.col("depth"))).sortWithinPartitions("seq").select("seq", "depth", "n", "least", "ends")
    with batch_rows(settled.sparkSession, 5_000):
        return stored(dealt.mapInPandas(swept, f"root binary, {NODE}"), "swept")


def _heads(nodes: DataFrame, ended: DataFrame) -> DataFrame:
    """(key, and the columns of a node) of all heads, from the containers' own nodes and the suffixes that end at heads.

    Every strict prefix of a container's key is a head, so totals go to all heads above in one grouping.
    """
    above = lambda length, least: F.explode(F.sequence(F.lit(0), length + least))
    tops = nodes.where("root is not null")
    sums = ["n_convs", "n_leaves", "saved_tokens"]
    below = tops.select("root", (F.octet_length("root") / WIDTH).cast("int").alias("d"), "conv_id", *sums)
    below = below.select(above(F.col("d"), F.lit(-1)).alias("at"), "root", "d", "conv_id", *sums, F.lit(None).cast("string").alias("ends_sha256"))
    own = ended.select(above((F.octet_length("seq") / WIDTH).cast("int"), F.lit(0)).alias("at"), F.col("seq").alias("root"), (F.octet_length("seq") / WIDTH).cast("int").alias("d"), F.col("least").alias("conv_id"), F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    own = own.withColumn("ends_sha256", F.when(F.col("at") == F.col("d"), F.col("ends_sha256")))
    all_below = below.unionByName(own)
    totals = all_below.groupBy(_prefix(F.col("root"), F.col("at")).alias("key"), "at").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], F.coalesce(F.max("ends_sha256"), F.lit(NO_ENDS)).alias("ends_sha256")
    )
    totals = stored(totals, "head-totals")
    words = F.when(F.col("at") > 0, F.conv(F.hex(F.substring("key", -4, 4)), 16, 10).cast("long")).otherwise(0)
    spent = totals.select(above(F.col("at"), F.lit(0)).alias("to"), "key", ((F.col("n_convs") - 1) * words).alias("spent"))
    spent = spent.groupBy(_prefix(F.col("key"), F.col("to")).alias("key"), F.col("to").alias("at")).agg(F.sum("spent").alias("spent"))
    parents = tops.select(F.col("root").alias("key")).unionByName(totals.select("key")).where(F.octet_length("key") > 0)
    children = parents.groupBy(F.substring("key", F.lit(1), F.octet_length("key") - WIDTH).alias("key")).agg(F.count("*").alias("n_children"))
    joined = totals.join(spent, ["key", "at"]).join(children, "key", "left")
    out = joined.select("key", F.col("at").alias("depth"), "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", (F.col("saved_tokens") + F.col("spent")).alias("saved_tokens"), "ends_sha256")
    return stored(out, "heads")


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row for each node of the prefix trie of the rebuilt conversations, root included.

    Turns are ordered by ``turn``, nulls first; turns of one number by their ids.  Null roles and texts are empty; rows
    without a conv_id take no part.  Repeated rows are turns each.  A conversation without turns ends at the root; an
    empty table has no nodes, as its root would have no member.  One conversation's ids (20 bytes a turn) are one row.
    """
    rows = suffixes(rebuilt(conversations))
    held, rounds = burst(rows, limit)
    nodes = sweep(held.where(F.col("depth").isNotNull()))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    kinds = [F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) for c in columns]
    if not rounds:
        return nodes.select(*kinds)
    heads = _heads(nodes, held.where(F.col("depth").isNull()))
    up = lambda key: F.when(F.octet_length(key) > 0, F.substring(key, F.lit(1), F.octet_length(key) - WIDTH))
    parent = heads.select(F.col("key").alias("_key"), F.col("conv_id").alias("_parent"))
    tops = nodes.where("root is not null").withColumn("up", up(F.col("root"))).drop("root").unionByName(heads.withColumn("up", up(F.col("key"))).withColumn("parent_conv_id", F.lit(None).cast("long")).drop("key"))
    tops = tops.join(parent, F.col("up") == F.col("_key"), "left").withColumn("parent_conv_id", F.col("_parent"))
    return nodes.where("root is null").select(*kinds).unionByName(tops.select(*kinds))
