"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch: a document's shingle hashes are thrown into ``COORDS`` bins in rounds.  In round i < COORDS every element lands
in a hashed bin with the value i + fraction; in round COORDS + j every element goes to bin j.  A bin keeps its least
value, so every coordinate of a non-empty set fills, and the share of equal coordinates of two sets concentrates round
their Jaccard similarity.  16 bits of each coordinate are kept.

Links: documents with equal sets form one class, and classes are what is compared.  Classes that share a band of ``ROWS``
coordinates are candidates.
1. Stars: in each bucket every member is paired with the one whose buckets are largest.  Pairs are made distinct over all
   buckets, compared by sketch, and those that agree verified on the full sets; the links found give components.
2. Buckets that still hold several components: members are compared by sketch in blocks of ``BLOCK``, only across
   components.  A block gives a spanning forest of its agreeing pairs, and the forests' components are clusters: every
   agreeing pair of any bucket lies within one cluster.
3. In each cluster the pairs across components are verified in blocks on the full sets, each pair in one block and not
   once for each bucket it shares.  A block gives the links that join its components, as more would join nothing.
At 85 % similarity the chance that no band of a pair agrees is (1 - 0.85^5)^25 < 1e-6, at 80 % (1 - 0.8^5)^25 < 5e-5.
Pairs below 80 % are banded too thinly for lower limits.

Defined cases: a document without words or text has an empty set and links with nothing; fewer words than a shingle make
one shingle; texts of any length are read whole; rows with the same id are one document: the classes of its texts are
linked, and all its rows get one component; a null id has a null component and stays; an empty table gives an empty
result; other columns are not read.

Plan: no bucket, class, cluster or component is gathered in one task: minima and counts are pre-aggregated, joins are
plain equi-joins that adaptive execution splits, blocks are bounded.  Full sets are written once for the classes that
need them (a filter of their ids is tested in the scan, so no other text moves) and move by pair in step 1 and by block of a cluster in step 3.  The work of step 3 on a cluster is its members
outside the largest component times all its members.  Steps' tables are written below ``spark.checkpoint.dir`` and
deleted once read, but for those that the result itself reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.lineage import Scratch
from pagewright.llm.common import IdFilter, mix64, shingles_of, texts

COORDS = 128
ROWS = 5
BANDS = COORDS // ROWS
SIGMAS = 4.6  # deviations that the sketch test lies below the mean of a pair right at the limit
BLOCK = 256
SALTS = 64  # parts that the members of one star are dealt to
_ROUND_SALTS = mix64(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(elements: np.ndarray) -> np.ndarray:
    """``COORDS`` 16-bit coordinates of a set of 64-bit hashes (not empty)."""
    best = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 4096 // len(elements))
    first = 0
    while first < COORDS and (best == np.iinfo(np.uint64).max).any():
        last = min(COORDS, first + step)
        thrown = mix64(elements[None, :] ^ _ROUND_SALTS[first:last, None])
        bins = (thrown & np.uint64(COORDS - 1)).astype(np.int64)
        values = (np.arange(first, last, dtype=np.uint64)[:, None] << np.uint64(56)) | (thrown >> np.uint64(8))
        np.minimum.at(best, bins.ravel(), values.ravel())
        first = last
    for j in np.flatnonzero(best == np.iinfo(np.uint64).max):
        best[j] = (mix64(elements ^ _ROUND_SALTS[COORDS + j]).min() >> np.uint64(8)) | np.uint64(COORDS << 56)
    return mix64(best).astype(np.uint16)


def agreeing(percent: int) -> int:
    """Equal coordinates that the sketch test asks for: ``SIGMAS`` below the mean at the limit, so that a pair there is
    lost with a chance below 1e-5 (normal approximation)."""
    j = percent / 100
    return max(0, int(COORDS * j - SIGMAS * (COORDS * j * (1 - j)) ** 0.5))


def _bands(coordinates: np.ndarray) -> np.ndarray:
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(coordinates), 0)
    parts = coordinates[:, : BANDS * ROWS].reshape(len(coordinates), BANDS, ROWS).astype(np.uint64)
    for j in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n_shingles, set_key, coords`` of every row; key and coordinates are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            sizes, keys, coords = [], [], []
            for text in texts(batch.column(1)):
                found = np.unique(shingles_of(text))
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                coords.append(sketch(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(coords, pa.binary())], names=["id", "n_shingles", "set_key", "coords"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, n_shingles long, set_key binary, coords binary")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, component`` of the ids in ``edges (a, b)``: each round maps an id to its least neighbour and contracts.  Least is
    meant by a hash of the id and the round, so that a chain in the order of its ids doesn't take a round for each."""
    rounds = []
    edges = scratch.keep(edges.where("a <> b").distinct())
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(F.col(c), F.lit(len(rounds)))  # noqa: B023, E731
        first = F.least(F.struct(rank("a").alias("r"), F.col("a").alias("x")), F.struct(rank("p").alias("r"), F.col("p").alias("x")))["x"]
        parent = scratch.keep(both.groupBy("a").agg(F.min_by("b", rank("b")).alias("p")).select(F.col("a").alias("id"), first.alias("parent")))
        rounds.append(parent)
        left = parent.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
        right = parent.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        contracted = edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        before, edges = edges, scratch.keep(contracted)
        scratch.drop(before)
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = rounds[0].select("id", F.col("parent").alias("component"))
    for parent in rounds[1:]:
        up = parent.select(F.col("id").alias("component"), F.col("parent").alias("up"))
        labels = labels.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
    found = scratch.keep(labels)
    scratch.drop(edges, *rounds)
    return found


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have ``percent`` hundredths of their union in common."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    common = _common(x, y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def _agreeing(pairs: DataFrame, coords: DataFrame, least: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose sketches agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(texts(batch.column(k))), np.uint16).reshape(-1, COORDS) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= least))

    side = lambda c: coords.select(F.col("cls").alias(c), F.col("coords").alias(f"c{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ca", "cb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar.  ``a`` may stand in very many pairs, so its set is sent to each
    part of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(texts(batch.column(2)), texts(batch.column(3)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    centres = pairs.select("a", "salt").distinct().join(sets.select(F.col("cls").alias("a"), F.col("found").alias("fa")), "a")
    joined = pairs.join(sets.select(F.col("cls").alias("b"), F.col("found").alias("fb")), "b").join(centres, ["a", "salt"])
    return joined.select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame) -> DataFrame:
    """``members (key, cls, component)`` dealt to blocks (key, i, j) of bounded size, so that each member outside its
    key's largest component (``minor``) meets every other member of the key in one block."""
    per = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = per.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("n"))
    rows = members.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # a target sits in its own block column, a minor in its own block row
    target = rows.select("key", F.explode(every).alias("i"), F.col("own").alias("j"), "cls", "component", F.lit(False).alias("minor"))
    minors = rows.where("component <> major")
    minor = minors.select("key", F.col("own").alias("i"), F.explode(every).alias("j"), "cls", "component", F.lit(True).alias("minor"))
    return target.join(minors.select("key", F.col("own").alias("i")).distinct(), ["key", "i"], "left_semi").unionByName(minor)


def _in_blocks(blocks: DataFrame, compare: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list], tuple]) -> DataFrame:
    """``a, b`` as ``compare`` gives them for each block (key, i, j) from its minor, cls, component, coords and found."""
    names = ["key", "i", "j", "minor", "cls", "component", "coords", *[c for c in ("found",) if c in blocks.columns]]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Runs of whole blocks; a block's rows follow one another but may lie in several batches."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            at = np.stack([batch.column(k).to_numpy() for k in range(3)])
            new = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
            if last is not None and (at[:, 0] != last).any():
                new = np.r_[0, new]
            last = at[:, -1]
            if len(new):
                yield pa.Table.from_batches([*held, batch.slice(0, new[-1])])
                held = [batch.slice(new[-1])]
            else:
                held.append(batch)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            if not len(table):
                continue
            at = np.stack([table.column(k).to_numpy() for k in range(3)])
            borders = np.r_[0, np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1, len(table)]
            minor, ids, comps = np.array(table.column(3).to_pylist(), bool), table.column(4).to_numpy(), table.column(5).to_numpy()
            sketched = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint16).reshape(-1, COORDS)
            found = [np.frombuffer(x, np.uint64) for x in table.column(7).to_pylist()] if len(names) > 7 else []
            done = [compare(minor[x:y], ids[x:y], comps[x:y], sketched[x:y], found[x:y]) for x, y in zip(borders[:-1], borders[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[k] for d in done]).astype(np.int64)) for k in (0, 1)], names=["a", "b"])

    return blocks.select(names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _forest(members: DataFrame, coords: DataFrame, least: int) -> DataFrame:
    """``a, b`` of a spanning forest of the pairs across components whose sketches agree, from each block."""

    def compare(minor, ids, comps, sketched, _) -> tuple[np.ndarray, np.ndarray]:
        targets = np.flatnonzero(~minor)
        hits = [(k, targets[(comps[targets] != comps[k]) & ((sketched[targets] == sketched[k]).sum(1) >= least)]) for k in np.flatnonzero(minor)]
        hits = [(k, t) for k, t in hits if len(t)]
        if not hits:
            return ids[:0], ids[:0]
        kinds, at = np.unique(ids, return_inverse=True)
        label = np.arange(len(kinds))
        changed = True
        while changed:
            changed = False
            for k, t in hits:
                k, t = at[k], at[t]
                low = min(label[k], label[t].min())
                if label[k] != low or (label[t] != low).any():
                    label[k] = label[t] = low
                    changed = True
        in_tree = np.flatnonzero(label != np.arange(len(kinds)))
        return kinds[label[in_tree]], kinds[in_tree]

    return _in_blocks(_blocks(members).join(coords, "cls"), compare)


def _block_links(members: DataFrame, data: DataFrame, percent: int) -> DataFrame:
    """Verified links ``(a, b)`` that join the components in each cluster of ``members (key, cls, component)``; ``data``
    has the classes' coords and found."""
    least = agreeing(percent)

    def compare(minor, ids, comps, sketched, found) -> tuple[np.ndarray, np.ndarray]:
        up = {c: c for c in comps.tolist()}

        def top(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        out, targets = [], np.flatnonzero(~minor)
        for k in np.flatnonzero(minor):
            agree = (sketched[targets] == sketched[k]).sum(1)
            for at in np.argsort(-agree, kind="stable")[: int((agree >= least).sum())]:
                t = targets[at]
                one, other = top(int(comps[k])), top(int(comps[t]))
                if one != other and _similar(found[k], found[t], percent):
                    up[one] = other
                    out.append((ids[k], ids[t]))
        return tuple(np.array(out, np.int64).reshape(-1, 2).T)

    return _in_blocks(_blocks(members).join(data, "cls"), compare)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bands = _bands(np.frombuffer(b"".join(texts(batch.column(1))), np.uint16).reshape(-1, COORDS))
        yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS))], names=["key", "cls"])


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``cls, found`` of the classes ``needed (cls, id, set_key)``, a written table, from the texts of ``docs (id, text)``.  A
    filter of the ids is tested in the scan, so sets are made and moved of the rows that it lets through alone."""
    sent = docs.sparkSession.sparkContext.broadcast(IdFilter.of(needed.select("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(sent.value.may_hold(batch.column(0))))
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                found = [np.unique(shingles_of(text)).tobytes() for text in texts(part.column(1))]
                keys = pa.array(map(xxhash.xxh3_128_digest, found), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), keys, pa.array(found, pa.binary())], names=["id", "set_key", "found"])

    rows = docs.mapInArrow(run, "id long, set_key binary, found binary")
    return rows.join(needed.hint("shuffle_hash"), ["id", "set_key"]).select("cls", "found").groupBy("cls").agg(F.first("found").alias("found"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept`` (the row stands for its component)."""
    scratch, least = Scratch(docs.sparkSession), agreeing(percent)
    keep, drop = scratch.keep, scratch.drop
    texts_of = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = keep(sketches(docs, id_col, text_col))
    full = base.where("set_key is not null and id is not null")
    grouped = full.groupBy("set_key").agg(F.first("coords").alias("coords"), F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = keep(grouped.withColumn("cls", F.monotonically_increasing_id()))

    banded = classes.select("cls", "coords").mapInArrow(_keys, "key long, cls long")
    buckets = keep(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = keep(banded.join(buckets, "key"))
    # a document whose copies differ from it in other places than from each other sits in their largest buckets
    weight = keep(members.groupBy("cls").agg(F.sum("n").alias("weight")))
    coords = keep(classes.select("cls", "coords", "id", "set_key").join(weight.select("cls"), "cls", "left_semi"))
    leaders = keep(members.join(weight, "cls").groupBy("key").agg(F.max(F.struct("weight", "cls")).alias("first")).select("key", F.col("first.cls").alias("a")))
    star = members.join(leaders, "key").where("cls <> a").select("a", F.col("cls").alias("b")).distinct()
    star = keep(_agreeing(star, coords, least))
    drop(buckets, weight, leaders)

    # texts of one id belong together
    twins = keep(full.groupBy("id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").select("id"))
    same = keep(full.join(twins, "id", "left_semi").select("id", "set_key").join(classes.select("set_key", "cls"), "set_key").select("id", "cls").distinct())
    same_id = same.join(same.groupBy("id").agg(F.min("cls").alias("a")), "id").where("a <> cls").select("a", F.col("cls").alias("b"))

    def sets_of(ids: DataFrame) -> DataFrame:
        needed = keep(coords.select("cls", "id", "set_key").join(ids, "cls", "left_semi"))
        return keep(_sets(texts_of, needed))

    paired = keep(star.select(F.col("a").alias("cls")).union(star.select("b")).distinct())
    sets = sets_of(paired)
    links = keep(_verified(star, sets, percent).union(same_id))
    found = components(links, scratch)
    component = F.coalesce("component", "cls").alias("component")
    seen = members.select("key", "cls").join(found.withColumnRenamed("id", "cls"), "cls", "left").select("key", "cls", component)
    seen = keep(seen)
    drop(members, star, twins, same)
    still_open = seen.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rest = keep(seen.join(still_open, "key", "left_semi"))
    drop(seen)
    forest = keep(_forest(rest, coords.select("cls", "coords"), least))
    drop(rest)
    if not forest.isEmpty():
        clusters = components(forest, scratch).select(F.col("component").alias("key"), F.col("id").alias("cls"))
        left = keep(clusters.join(found.withColumnRenamed("id", "cls"), "cls", "left").select("key", "cls", component))
        more_sets = sets_of(left.select("cls").join(paired, "cls", "left_anti"))
        data = coords.select("cls", "coords").join(sets.union(more_sets), "cls")
        more = keep(_block_links(left, data, percent))
        drop(left, more_sets, clusters)
        if not more.isEmpty():
            found, before = components(links.union(more), scratch), found
            drop(before)
        drop(more)
    drop(paired, sets, links, forest, coords)

    labelled = classes.select("cls", "set_key", "id", "copies").join(found.withColumnRenamed("id", "cls"), "cls", "left")
    lowest = labelled.where("component is not null").groupBy("component").agg(F.min("id").alias("low"))
    named = labelled.join(lowest, "component", "left").select("set_key", "copies", "id", F.coalesce("low", "id").alias("component_id"))
    named = keep(named.where("copies > 1 or component_id <> id").select("set_key", "component_id"))
    changed = keep(full.select("id", "set_key").join(named, "set_key").where("id <> component_id").select("id", "component_id").distinct())
    drop(named, found, classes)
    out = base.select("id", "n_shingles").join(changed, "id", "left")
    final = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", final.alias("component_id"), F.coalesce(F.col("id") == final, F.lit(True)).alias("kept"))
