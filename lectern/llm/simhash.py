"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints are compared in tiles: one ``uint64`` tile against another by exclusive-or and bit counts, skipping
tile pairs whose population counts differ by more than the radius.  Which fingerprints share tiles is decided by
the pigeonhole rule: with r + k bands, fingerprints within radius r agree on at least k whole bands, so equal
values of k chosen bands bring every linked pair together and no link is lost.  k follows the number of distinct
fingerprints, so that tiles stay small at any corpus size; a value that very many fingerprints share is split
into tiles by population count and hash, and the tile pairs go to different tasks.

Each tile pair returns a spanning forest of the links found in it, never all pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.components import components

from .common import binary_column, checkpointed, give_back, mix, ragged, small_batches, stored

BITS = 64
#: Fingerprints in the largest tile that one task compares within itself.
TILE = 16_384
#: Rows of the small tiles that numpy compares at a time.
STRIP = 1_024


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``size`` words, repeats included; of all words if there are fewer."""
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    line = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    starts = (ends - lens + 1)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, from the highest."""
    counts = np.zeros(BITS, np.int64)
    values = hashes.astype(">u8")
    for at in range(0, len(values), 65_536):
        counts += np.unpackbits(values[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return counts


def simhash(words: list[bytes], size: int) -> int:
    """Bit i is 1 if it is set in over half the XXH64 (seed 42) values of the ``size``-word shingles."""
    if not words:
        return 0
    hashes = shingle_hashes(words, size)
    return int.from_bytes(np.packbits(2 * bit_counts(hashes) > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, fp long) of every row: ASCII-lower-cased words, all ``size``-word shingles of the whole text."""

    def run(batches):
        for batch in batches:
            marks = [simhash((t or b"").lower().split(), size) for t in binary_column(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(marks, np.uint64).view(np.int64))], names=["doc_id", "fp"])
        give_back()

    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def band_scheme(n: int, radius: int, tile: int = TILE) -> tuple[int, int]:
    """(bands, agreeing bands): the fewest rows for which a band value holds well under a tile on average."""
    for k in range(1, BITS // (radius + 1)):
        if n / 2.0 ** (BITS * k // (radius + k)) <= tile / 16 or math.comb(radius + k + 1, k + 1) > 500:
            return radius + k, k
    return radius + 1, 1


def forest(fps: np.ndarray, radius: int, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (i, j) among fingerprints; with ``split``, only between the first ``split`` and the rest."""
    count = np.bitwise_count(fps).astype(np.int16)
    sides = [np.arange(len(fps))] if split is None else [np.arange(split), np.arange(split, len(fps))]
    sides = [s[np.argsort(count[s], kind="stable")] for s in sides]
    root = np.arange(len(fps))
    found: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    left, right = sides[0], sides[-1]
    for a in range(0, len(left), STRIP):
        la = left[a : a + STRIP]
        for b in range(a if split is None else 0, len(right), STRIP):
            lb = right[b : b + STRIP]
            if count[lb[0]] - count[la[-1]] > radius or count[la[0]] - count[lb[-1]] > radius:
                continue
            near = np.bitwise_count(fps[la][:, None] ^ fps[lb][None, :]) <= radius
            i, j = np.nonzero(near)
            i, j = la[i], lb[j]
            apart = root[i] != root[j]
            if not apart.any():
                continue
            i, j = i[apart], j[apart]
            _, one = np.unique(np.minimum(root[i], root[j]) * len(fps) + np.maximum(root[i], root[j]), return_index=True)
            for x, y in zip(i[one].tolist(), j[one].tolist(), strict=True):
                rx, ry = find(x), find(y)
                if rx != ry:
                    root[max(rx, ry)] = min(rx, ry)
                    found.append((x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up
    links = np.array(found, np.int64).reshape(-1, 2)
    return links[:, 0], links[:, 1]


def _by_tile(tiles: DataFrame, work, schema: str) -> DataFrame:
    """``work(run, split)`` on each run of equal (k1, k2): one tile, or with ``cross`` a tile pair that is split after side 0.

    Partitions are sorted by key and a run may go on over several batches.
    """
    keys = ["k1", "k2"]

    def compare(run: pd.DataFrame):
        if len(run) < 2:
            return None
        split = None
        if run["cross"].iloc[0]:
            run = run.sort_values("side", kind="stable")
            split = int((run["side"] == 0).sum())
            if not 0 < split < len(run):
                return None
        out = work(run, split)
        return out if len(out) else None

    def stream(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
            edges = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            starts = [0, *edges.tolist(), len(pdf)]
            if held and (held[-1][keys].iloc[-1] != pdf[keys].iloc[0]).any():
                if (out := compare(pd.concat(held))) is not None:
                    yield out
                held = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                run = pdf.iloc[s:e] if e - s > 1 or s == 0 or e == len(pdf) else None
                if e < len(pdf):
                    if held:
                        run, held = pd.concat([*held, run if run is not None else pdf.iloc[s:e]]), []
                    if run is not None and (out := compare(run)) is not None:
                        yield out
                else:
                    held.append(run)
        if held and (out := compare(pd.concat(held))) is not None:
            yield out
        give_back()

    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(stream, schema)


def link_forest(nodes: DataFrame, n: int, radius: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints (node, fp) which a chain of near ones joins."""
    bands, agree = band_scheme(n, radius, tile)
    edges = [BITS * i // bands for i in range(bands + 1)]
    masks = []
    for chosen in itertools.combinations(range(bands), agree):
        mask = 0
        for b in chosen:
            mask |= ((1 << (edges[b + 1] - edges[b])) - 1) << edges[b]
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    routed = nodes.select(
        "node", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])).alias("r")
    ).select("node", "fp", F.xxhash64("r.band", "r.value").alias("k1"))
    return tile_forest(routed, radius, tile)


def tile_forest(routed: DataFrame, radius: int, tile: int) -> DataFrame:
    """Links (a, b) among rows (node, fp, k1) of equal k1, tile by tile."""
    crowds = routed.groupBy("k1").agg(F.count("*").alias("crowd")).where(F.col("crowd") > tile)
    placed = routed.join(crowds, "k1", "left")
    small = placed.where("crowd is null").select("k1", F.lit(0).cast("long").alias("k2"), F.lit(0).alias("side"), F.lit(0).alias("cross"), "node", "fp")
    # A crowd's tile is (population count, salt); its row goes to every tile pair that it takes part in.
    salts = F.ceil(F.col("crowd") / tile).cast("int")
    own = placed.where("crowd is not null").withColumns({"pc": F.bit_count("fp"), "salts": salts, "salt": F.pmod(F.xxhash64("fp", F.lit(3)), salts).cast("int")})
    partner = own.withColumn("p", F.explode(F.expr(f"flatten(transform(sequence(greatest(0, pc - {radius}), least({BITS}, pc + {radius})), c -> transform(sequence(0, salts - 1), s -> struct(c as pc, s as salt))))")))
    here, there = F.col("pc") * 1_000_000 + F.col("salt"), F.col("p.pc") * 1_000_000 + F.col("p.salt")
    large = partner.select(
        "k1",
        F.xxhash64(F.least(here, there), F.greatest(here, there)).alias("k2"),
        F.when(here <= there, 0).otherwise(1).alias("side"),
        F.when(here == there, 0).otherwise(1).alias("cross"),
        "node",
        "fp",
    )

    def links(run: pd.DataFrame, split: int | None) -> pd.DataFrame:
        i, j = forest(run["fp"].to_numpy().view(np.uint64), radius, split)
        node = run["node"].to_numpy()
        return pd.DataFrame({"a": node[i], "b": node[j]})

    return _by_tile(small.unionByName(large), links, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id that links reach.

    Fingerprints link at ``radius`` or fewer differing bits.  Null, empty and wordless texts have fingerprint
    zero, linked like any other.  Rows that repeat a doc_id each give a row; rows without a doc_id form no
    component (null) and link to nothing.
    """
    marks = checkpointed(fingerprints(docs, size))
    nodes = marks.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = checkpointed(nodes)
    # A doc_id that several rows share can stand for several fingerprints; those are one vertex already.
    found = components(link_forest(nodes, nodes.count(), radius, tile))
    named = nodes.join(found, nodes["node"] == found["vertex"], "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marks.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# -- near copies by a share of common shingles ----------------------------------

#: Routes (hashes of a few minimum hashes) that bring texts into one tile, and hashes in a route: a pair at 0.8 meets
#: in one of them with probability 0.99999.
ROUTES, ROUTE_HASHES = 16, 3
#: Differing bits up to which a pair in a tile is compared whole: at 0.8 about 10 bits differ, with a deviation of 3.
WIDE_RADIUS = 20
#: Shingles in the largest tile, on average: 16 MB of hashes.
TILE_GRAMS = 2_000_000
MULTIPLIERS = (mix(np.arange(1, ROUTES * ROUTE_HASHES + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)).reshape(1, -1)


def gram_set(words: list[bytes], size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; none without words."""
    return np.unique(shingle_hashes(words, size)) if words else np.empty(0, np.uint64)


def shape_of(grams: np.ndarray) -> int:
    """A hash of a whole set of shingles."""
    return xxhash.xxh64_intdigest(grams.tobytes(), 42)


def mark_of(grams: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles."""
    return int.from_bytes(np.packbits(2 * bit_counts(grams) > len(grams)).tobytes(), "big") if len(grams) else 0


def routes_of(grams: np.ndarray) -> list[int]:
    if not len(grams):
        return [0] * ROUTES
    mixed = mix(grams)
    least = np.full((1, ROUTES * ROUTE_HASHES), np.iinfo(np.uint64).max)
    for at in range(0, len(mixed), 8_192):
        least = np.minimum(least, (mixed[at : at + 8_192, None] * MULTIPLIERS).min(0, keepdims=True))
    rows = least.reshape(ROUTES, ROUTE_HASHES)
    return mix(rows[:, 0] + mix(rows[:, 1] + mix(rows[:, 2] + np.arange(ROUTES, dtype=np.uint64)))).view(np.int64).tolist()


def with_partner(fps: np.ndarray, sizes: np.ndarray, radius: int, least: float, split: int | None) -> np.ndarray:
    """Which members have another one within ``radius`` bits whose size allows a share of ``least``."""
    count = np.bitwise_count(fps).astype(np.int16)
    sides = [np.arange(len(fps))] if split is None else [np.arange(split), np.arange(split, len(fps))]
    sides = [s[np.argsort(count[s], kind="stable")] for s in sides]
    left, right = sides[0], sides[-1]
    has = np.zeros(len(fps), bool)
    for a in range(0, len(left), STRIP):
        la = left[a : a + STRIP]
        for b in range(a if split is None else 0, len(right), STRIP):
            lb = right[b : b + STRIP]
            if count[lb[0]] - count[la[-1]] > radius or count[la[0]] - count[lb[-1]] > radius:
                continue
            near = np.bitwise_count(fps[la][:, None] ^ fps[lb][None, :]) <= radius
            near &= np.minimum(sizes[la][:, None], sizes[lb][None, :]) >= least * np.maximum(sizes[la][:, None], sizes[lb][None, :])
            if split is None and a == b:
                np.fill_diagonal(near, False)
            has[la] |= near.any(1)
            has[lb] |= near.any(0)
    return has


def exact_forest(fps: np.ndarray, grams: list[np.ndarray], component: np.ndarray, radius: int, least: float, split: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (i, j) between different components: pairs within ``radius`` bits whose whole sets of shingles share ``least``."""
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    _, flat = np.unique(np.concatenate(grams), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, first, of = np.unique(component, return_index=True, return_inverse=True)
    root = first[of]
    held = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    found: list[tuple[int, int]] = []
    n = len(grams)
    for i in range(n if split is None else split):
        low = i + 1 if split is None else split
        near = (root[low:] != root[i]) & (np.bitwise_count(fps[low:] ^ fps[i]) <= radius)
        near &= np.minimum(sizes[low:], sizes[i]) >= least * np.maximum(sizes[low:], sizes[i])
        some = np.flatnonzero(near) + low
        if not len(some):
            continue
        own = flat[starts[i] : ends[i]]
        held[own] = True
        hits = held[flat[ragged(starts[some], sizes[some])]]
        common = np.add.reduceat(hits, np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
        held[own] = False
        like = some[common / (sizes[some] + sizes[i] - common) >= least]
        roots, one = np.unique(root[like], return_index=True)
        if len(one):
            found += [(i, j) for j in like[one].tolist()]
            root[np.isin(root, roots)] = root[i]
    links = np.array(found, np.int64).reshape(-1, 2)
    return links[:, 0], links[:, 1]


def tiles_of(routed: DataFrame, tile: int) -> DataFrame:
    """Rows (k1, k2, side, cross, node, ...) of every tile and tile pair, from rows (node, k1, n, ...) that share k1.

    A crowd is cut by a hash of the node; a row goes to every tile pair that its tile takes part in.  Values of k1 with
    one row are left out.
    """
    crowds = routed.groupBy("k1").agg(F.count("*").alias("crowd"), F.sum("n").alias("weight")).where("crowd > 1")
    salts = F.ceil(F.greatest(F.col("crowd") / tile, F.col("weight") / TILE_GRAMS)).cast("int")
    placed = routed.join(crowds, "k1").withColumns({"salts": salts, "salt": F.pmod(F.xxhash64("node", F.lit(3)), salts).cast("int")})
    rest = [c for c in routed.columns if c != "k1"]
    return placed.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(
        "k1",
        F.xxhash64(F.least("salt", "p"), F.greatest("salt", "p")).alias("k2"),
        F.when(F.col("salt") <= F.col("p"), 0).otherwise(1).alias("side"),
        F.when(F.col("salt") == F.col("p"), 0).otherwise(1).alias("cross"),
        *rest,
    )


def _compared(members: DataFrame, grams: DataFrame, radius: int, least: float) -> DataFrame:
    """Links (a, b) confirmed by whole sets of shingles, a spanning forest a tile; ``members`` has (k1, k2, side, cross, node, component)."""
    full = members.join(grams, "node")

    def links(run: pd.DataFrame, split: int | None) -> pd.DataFrame:
        fps = run["fp"].to_numpy().view(np.uint64)
        sets = [np.frombuffer(g, np.uint64) for g in run["grams"]]
        i, j = exact_forest(fps, sets, run["component"].to_numpy(), radius, least, split)
        node = run["node"].to_numpy()
        return pd.DataFrame({"a": node[i], "b": node[j]})

    return _by_tile(full, links, "a long, b long")


def near_copies(docs: DataFrame, size: int = 5, least: float = 0.8, radius: int = WIDE_RADIUS, tile: int = TILE // 4) -> DataFrame:
    """(doc_id, text_key, component_id) of every row: groups of texts linked by a share of ``least`` common shingles.

    Minimum hashes choose the tiles; inside a tile, SimHash fingerprints of the sets of shingles are compared by
    exclusive-or and bit counts, and every pair within ``radius`` bits is decided by the whole sets of both texts.
    Tiles return members or spanning forests, never pairs: a first pass says which members have a partner at all, a
    second compares each of those in one of its tiles, which joins large groups of copies, and a third compares the
    tiles that still hold more than one group.

    Texts of equal sets of shingles are one vertex, whatever rows they stand in, so rows that repeat a doc_id with
    different texts are judged each by its own; ``text_key`` (xxhash64 of the text) tells them apart.  ``component_id``
    is the smallest doc_id of the group.  Null, empty and wordless texts are one group; a text of fewer than ``size``
    words is one shingle; rows without a doc_id form no component (null).
    """

    def run(batches):
        for batch in batches:
            sets = [gram_set((t or b"").lower().split(), size) for t in binary_column(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.array([shape_of(g) for g in sets], np.uint64).view(np.int64)),
                    pa.array(np.array([mark_of(g) for g in sets], np.uint64).view(np.int64)),
                    pa.array([len(g) for g in sets], pa.int64()),
                    pa.array([routes_of(g) for g in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "shape", "fp", "n", "routes"],
            )
        give_back()

    def hashed(batches):
        for batch in batches:
            sets = [gram_set((t or b"").lower().split(), size) for t in binary_column(batch.column(0))]
            shapes = np.array([shape_of(g) for g in sets], np.uint64).view(np.int64)
            marks = np.array([mark_of(g) for g in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shapes), pa.array(marks), pa.array([g.tobytes() for g in sets], pa.binary())], names=["node", "fp", "grams"])
        give_back()

    def partnered(run: pd.DataFrame, split: int | None) -> pd.DataFrame:
        has = with_partner(run["fp"].to_numpy().view(np.uint64), run["n"].to_numpy(), radius, least, split)
        return run.loc[has, ["k1", "k2", "side", "cross", "node"]]

    small_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    marks = stored(keyed.mapInArrow(run, "doc_id long, text_key long, shape long, fp long, n long, routes array<long>"), "routes")
    nodes = marks.where("doc_id is not null").groupBy("shape").agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.min_by(F.struct("fp", "n", "routes"), "doc_id").alias("of"))
    nodes = stored(nodes.select(F.col("shape").alias("node"), "at.doc_id", "at.text_key", "of.fp", "of.n", "of.routes"), "shapes")
    tiles = tiles_of(nodes.select(F.explode("routes").alias("k1"), "node", "fp", "n"), tile)
    members = checkpointed(_by_tile(tiles, partnered, "k1 long, k2 long, side int, cross int, node long"))
    used = stored(members.select("node").distinct().join(nodes.select("node", "doc_id", "text_key"), "node").select("doc_id", "text_key"), "partnered")
    texts = keyed.join(used, ["doc_id", "text_key"], "left_semi").select("text")
    grams = stored(texts.mapInArrow(hashed, "node long, fp long, grams binary").dropDuplicates(["node"]), "shingles")
    place = F.struct("cross", "k1", "k2", "side")  # the member's own tiles first
    once = members.groupBy("node").agg(F.min(place).alias("at")).select("at.*", "node", F.col("node").alias("component"))
    likely = checkpointed(_compared(once, grams, radius, least))
    found = checkpointed(components(likely))
    named = members.join(found, F.col("node") == F.col("vertex"), "left").select(*members.columns, F.coalesce("component", "node").alias("component"))
    mixed = named.groupBy("k1", "k2").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("k1", "k2")
    others = _compared(named.join(mixed, ["k1", "k2"], "left_semi"), grams, radius, least)
    joined = components(likely.unionByName(others)).withColumnRenamed("vertex", "node")
    linked = checkpointed(joined.join(nodes.select("node", "doc_id"), "node"))
    least_id = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    shapes = nodes.select("node", F.col("doc_id").alias("first_id")).join(linked.join(least_id, "component").select("node", "component_id"), "node", "left")
    rows = marks.select("doc_id", "text_key", F.col("shape").alias("node")).join(shapes, "node", "left")
    return rows.select("doc_id", "text_key", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "first_id")).alias("component_id"))


def without_copies(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """Rows of ``docs`` whose doc_id is the smallest of the group of their text, see ``near_copies``.

    All columns are kept as they are; rows without a doc_id stay.  The rows that go are written first, so the planner
    knows their size when it joins them.
    """
    gone = stored(near_copies(docs.select("doc_id", "text"), size, least).where("doc_id <> component_id").select("doc_id", "text_key").distinct(), "copies")
    same = (F.col("d.doc_id") == F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_key"))
    return docs.alias("d").join(gone.alias("g"), same, "left_anti")
