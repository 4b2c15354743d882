"""Problem 3: near-duplicate texts, from bottom-k sketches of their word shingles.

One hash function turns a text's distinct shingles into numbers; the k least are its sketch. Inverted lists hold runs of
neighbouring retained values: texts that share most of their shingles share most of their neighbours in hash order,
while phrases that are common to many texts rarely have the same neighbours twice. Texts from WHOLE_RUNS shingles on are
listed under runs of three values, shorter ones under runs of two, those below PAIR_RUNS under single values; a text is
also listed in the way of the shortest text it may resemble.

Lists give overlap counts. `least_shared` says how many keys two texts at the threshold share at the least; each text
therefore leaves out all but SHARED of that number of its most common keys (any two such texts still meet SHARED times),
and a pair counts as a candidate only if it meets that often. Candidates are weighed by the union of their two sketches,
and what may reach the threshold is verified on all shingles exactly.

Guarantees, for a pair at the threshold 0.6 exactly (more similar pairs share more): single values and runs of two are
counted on whole texts, where the bound always holds; runs of three fall short of it with a probability of at most
2.4e-4 (k = 96, by simulation: mean 20, bound 4). The union estimate has a standard deviation of sqrt(s(1-s)/k) = 0.05;
the margin is five of them. Thresholds below 0.6 are refused, since these bounds don't hold there.

List entries are shuffled once, packed as sorted keys of 48 bits; keys that only one text has go no further. Equal keys of
different runs of values (9e-5 of the keys among 6e9) only make candidates, which are verified.

Long lists are cut into parts of SALT texts that meet the whole list in tasks of their own. Joins on growing sides never
broadcast. Shingles are only kept for texts that have a candidate; all others are known by their sketches.

Texts that agree in all words are one class first, and only class representatives are compared; classes and links come
out together, copies need not be expanded.

Defined results: null texts and texts with fewer words than a shingle has no similarity to any other text, equal texts
apart, which are in one class (null and empty texts are classes of one row each). Ties are broken by the least row id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.canonical import canonical
from siltstone.session import cut_lineage

SHINGLE, THRESHOLD, SKETCH, MARGIN = 5, 0.8, 96, 0.25
PAIR_RUNS, WHOLE_RUNS, SHARED, SALT = 24, 48, 2, 1024
#: Bits of a list key; texts that are packed together; entries a task meets at once; bits of a set of ids at most, of a map
#: of them, and for each id.
KEY_BITS, MOST_PLACES, BUCKET_ENTRIES, ID_BITS, MAP_BITS, SPARSE = 48, 65536, 2**20, 2**26, 2**15, 64


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle_hashes(tokens: Column, width: int) -> Column:
    """Sorted distinct hashes of all sequences of `width` consecutive words."""
    at = lambda i: [F.get(tokens, i + j) for j in range(width)]
    count = F.size(tokens) - width + 1
    return F.when(count > 0, F.sort_array(F.array_distinct(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*at(i)))))).otherwise(F.array().cast("array<bigint>"))


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two growing sides: sizes are hard to estimate after checkpoints, so it never becomes a broadcast."""
    return left.join(right.hint("merge"), on, how)


def _tokens(df: DataFrame, id_column: str) -> DataFrame:
    texts = df.where(F.col("text").isNotNull()).select(F.col(id_column).alias("id"), canonical(F.col("text")).alias("text"))
    return texts.select("id", words(F.col("text")).alias("tokens"))


def sketches(df: DataFrame, id_column: str, shingle: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) for every row with a shingle, (id, n, sketch) for the same rows; n is the number of shingles."""
    tokens = _tokens(df, id_column)
    # Equal word sequences are one class. 128 bits of hash keep unequal ones apart.
    hashed = tokens.select("id", F.xxhash64("tokens").alias("same_a"), F.xxhash64(F.lit(1), "tokens").alias("same_b"), shingle_hashes(F.col("tokens"), shingle).alias("shingles"))
    hashed = cut_lineage(hashed.select("id", "same_a", "same_b", F.size("shingles").alias("n"), F.slice("shingles", 1, k).alias("sketch"))).where("n > 0")  # a filter before this point would repeat the expressions above
    classes = hashed.groupBy("same_a", "same_b").agg(F.min("id").alias("class_id"))
    members = _met(hashed.select("id", "same_a", "same_b"), classes, ["same_a", "same_b"]).select("id", "class_id")
    return cut_lineage(members), hashed.select("id", "n", "sketch")


def least_shared(run: int, n: Column, threshold: float, k: int) -> Column:
    """Keys (runs of 1, 2 or 3 sketch values) that a text of n shingles shares with any text at the threshold.

    1: the intersection is at least threshold * n. 2: m shared ones among u in a row leave at least 2m - u - 1 neighbours
    together, and u >= n. 3: the mean is k * threshold ** 3; the divisor puts the bound where the docstring says.
    """
    if run == 1:
        bound = F.ceil(F.lit(threshold) * n)
    elif run == 2:
        bound = F.ceil(F.lit(2 * threshold - 1) * n) - 1
    else:
        bound = F.floor(F.least(n, F.lit(k)) * F.lit(threshold**3 / 4.6))
    return F.greatest(bound.cast("int"), F.lit(1))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Well-mixed 64 bits (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _keys_of(values: np.ndarray, sizes: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """doc (place in the batch) and key of all list entries of texts with n shingles, whose sketches follow each other in values.

    A key has KEY_BITS bits, the last two of them its run, so that an entry is two numbers.
    """
    shortest = np.ceil(n * threshold)  # of the texts it may resemble
    runs = {1: shortest < PAIR_RUNS, 2: (n >= PAIR_RUNS) & (shortest < WHOLE_RUNS), 3: n >= WHOLE_RUNS}
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(values))  # values from here to the end of the sketch
    docs, keys = [], []
    for run, holds in runs.items():
        at = np.flatnonzero(holds[doc] & (left >= run))
        h = np.full(len(at), run, dtype=np.uint64)
        for i in range(run):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + values[at + i])
        docs.append(doc[at])
        keys.append((h >> np.uint64(64 - KEY_BITS)) & np.uint64(2**KEY_BITS - 4) | np.uint64(run))
    return np.concatenate(docs), np.concatenate(keys)


def _squeezed(rows: np.ndarray) -> bytes:
    """Bytes column by column, entropy-coded, which the codec of shuffles may not do."""
    return pa.compress(rows.T.tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(body: bytes, count: int, width: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, decompressed_size=count * width, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, count).T


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """Numbers as differences, byte by byte: the upper bytes of neighbours are alike and cost little once compressed."""
    steps = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0))
    return _squeezed(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _from_planes(body: bytes, count: int, width: int) -> np.ndarray:
    steps = np.zeros((count, 8), dtype=np.uint8)
    steps[:, :width] = _unsqueezed(body, count, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def packed_entries(rows: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """bucket, entries, texts, keys, places, ids: the list entries of each task's texts, by range of their keys.

    Keys are sorted; each comes with its text's place among the ids.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([x[0] for x in held])
            shift = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
            doc, key = np.concatenate([x[1] + s for x, s in zip(held, shift)]), np.concatenate([x[2] for x in held])
            by_id = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), dtype=np.int64)
            place[by_id] = np.arange(len(ids))
            ids, doc = ids[by_id], place[doc]
            order = np.argsort(key)
            doc, key = doc[order], key[order]
            at = np.searchsorted(key, [np.uint64((b * 2**KEY_BITS + buckets - 1) // buckets) for b in range(buckets)] + [np.uint64(2**KEY_BITS)])
            for b in np.flatnonzero(np.diff(at)):
                own, known = doc[at[b] : at[b + 1]], key[at[b] : at[b + 1]]
                used, where = np.unique(own, return_inverse=True)
                bodies = [_planes(known, 8), _squeezed(where.astype("<u2").view(np.uint8).reshape(-1, 2)), _planes(ids[used].view(np.uint64), 8)]
                yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip([b, len(known), len(used), *bodies], [pa.int32()] * 3 + [pa.binary()] * 3)], names=["bucket", "entries", "texts", "keys", "places", "ids"])

        for b in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            if held and sum(len(x[0]) for x in held) + b.num_rows > MOST_PLACES:
                yield from made()
                held = []
            lists = b.column("sketch")
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            held.append((b.column("id").to_numpy(), *_keys_of(values, np.diff(np.asarray(lists.offsets)), b.column("n").to_numpy(), threshold)))
        if held:
            yield from made()

    return rows.select(F.col("id").cast("long").alias("id"), "n", "sketch").mapInArrow(pack, "bucket int, entries int, texts int, keys binary, places binary, ids binary")


def shared_keys(rows: DataFrame, threshold: float) -> DataFrame:
    """id, key, texts of the list entries whose key several texts have. Only packed entries are shuffled, once."""
    spark = rows.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() * SKETCH // BUCKET_ENTRIES)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for r in (r for b in batches for r in b.to_pylist()):
            places = _unsqueezed(r["places"], r["entries"], 2).copy().view("<u2").ravel()
            by_bucket.setdefault(r["bucket"], []).append((_from_planes(r["keys"], r["entries"], 8), _from_planes(r["ids"], r["texts"], 8).view(np.int64)[places]))
        for parts in by_bucket.values():
            key, ids = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key)
            key, ids = key[order], ids[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            texts = np.repeat(np.diff(np.r_[first, len(key)]), np.diff(np.r_[first, len(key)]))
            held = texts > 1
            yield pa.RecordBatch.from_arrays([pa.array(ids[held]), pa.array(key[held].astype(np.int64)), pa.array(texts[held].astype(np.int64))], names=["id", "key", "texts"])

    packed = packed_entries(rows, threshold, buckets)
    return packed.repartitionById(buckets, F.col("bucket")).mapInArrow(meet, "id bigint, key bigint, texts bigint")


def _list_keys(rows: DataFrame, members: DataFrame, threshold: float, k: int) -> DataFrame:
    """class_id, n, enough, key, texts: the list entries of every class that it may need to meet a similar one."""
    kept = shared_keys(rows, threshold).withColumn("run", F.col("key").bitwiseAND(F.lit(3)))
    own = _met(rows.select("id", "n"), members.where("id = class_id").select("id"), ["id"])
    n = F.col("n")
    # By id, as they are joined: another name would be shuffled again.
    per_class = _met(kept, own, ["id"]).groupBy("id", "run", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "key"))).alias("keys"))  # at most k
    enough = reduce(lambda out, r: F.when(F.col("run") == r, least_shared(r, n, threshold, k)).otherwise(out), (1, 2, 3), F.lit(1))
    spare = F.greatest(enough - SHARED, F.lit(0))
    listed = per_class.withColumn("keys", F.slice("keys", 1, F.greatest(F.size("keys") - spare, F.lit(0))))
    return listed.select(F.col("id").alias("class_id"), "n", F.least(enough, F.lit(SHARED)).alias("enough"), F.explode("keys").alias("k")).select("class_id", "n", "enough", "k.key", "k.texts")


def candidate_pairs(rows: DataFrame, members: DataFrame, threshold: float, k: int) -> DataFrame:
    """class_a < class_b of the pairs that share enough keys."""
    keys = cut_lineage(_list_keys(rows, members, threshold, k))
    # Both sides of the short lists are one shuffle; only long lists are salted.
    short, long = keys.where(F.col("texts") <= SALT).select("key", "class_id", "enough", "n"), keys.where(F.col("texts") > SALT)
    parts = F.ceil(F.col("texts") / SALT).cast("int")
    side = lambda df, s: df.withColumnsRenamed({c: f"{c}_{s}" for c in ("enough", "n")} | {"class_id": f"class_{s}"})
    one = long.select("key", F.pmod(F.xxhash64("class_id"), parts).cast("int").alias("salt"), "class_id", "enough", "n")
    all_ = long.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), "class_id", "enough", "n")
    met = _met(side(short, "a"), side(short, "b"), ["key"]).unionByName(_met(side(one, "a"), side(all_, "b"), ["key", "salt"]).drop("salt"))
    pairs = met.where("class_a < class_b").where((F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b")))
    counted = pairs.groupBy("class_a", "class_b").agg(F.count("*").alias("common"), F.least(F.min("enough_a"), F.min("enough_b")).alias("enough"))
    return counted.where("common >= enough").select("class_a", "class_b")


def map_bits(most_ids: int) -> int:
    """Bits of a map of so many ids: SPARSE for each, in whole parts of the map, ID_BITS at most."""
    return min(ID_BITS, max(MAP_BITS, 1 << (most_ids * SPARSE - 1).bit_length())) if most_ids else MAP_BITS


def _likely_ids(df: DataFrame, ids: DataFrame, most_ids: int) -> DataFrame:
    """Rows whose id has its bit in a bitmap of the at most so many `ids`: all of them and some others, so that a
    join needs to shuffle few rows in vain. Every executor keeps a copy of the map on its disk, so it is as small as that needs."""
    bit = F.pmod(F.xxhash64("id"), F.lit(map_bits(most_ids)))
    maps = ids.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / MAP_BITS).alias("b")).agg(F.bitmap_construct_agg(F.col("bit") % MAP_BITS).alias("m"))
    shared = df.sparkSession.sparkContext.broadcast({r.b: np.frombuffer(bytes(r.m), dtype=np.uint8) for r in maps.toLocalIterator()})

    @F.pandas_udf("boolean")
    def known(bits: pd.Series) -> pd.Series:
        bits, out = bits.to_numpy(), np.zeros(len(bits), dtype=bool)
        for b in np.unique(bits // MAP_BITS):
            own = np.flatnonzero(bits // MAP_BITS == b)
            if b in shared.value:
                place = bits[own] % MAP_BITS
                out[own] = shared.value[b][place // 8] >> (place % 8) & 1
        return pd.Series(out)

    return df.where(known(bit))


def similar_classes(df: DataFrame, id_column: str, rows: DataFrame, members: DataFrame, threshold: float, shingle: int, k: int, margin: float = MARGIN) -> DataFrame:
    """class_a < class_b, similarity for all pairs of classes that reach the threshold."""
    if threshold < 0.6:
        raise ValueError("the bounds of the inverted lists hold from a similarity of 0.6 on")
    pairs = cut_lineage(candidate_pairs(rows, members, threshold, k))
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("id")).distinct()
    texts = _met(_likely_ids(df.select(F.col(id_column).alias("id"), "text"), ends, 2 * pairs.count()), ends, ["id"], "left_semi")
    whole = cut_lineage(_tokens(texts, "id").select("id", shingle_hashes(F.col("tokens"), shingle).alias("shingles")))
    side = lambda s, n=None: whole.select(F.col("id").alias(f"class_{s}"), (F.slice("shingles", 1, n) if n else F.col("shingles")).alias(f"values_{s}"))
    both = _met(_met(pairs, side("a", k), ["class_a"]), side("b", k), ["class_b"])
    least = F.least(F.size("values_a"), F.size("values_b"))
    union = F.slice(F.sort_array(F.array_union("values_a", "values_b")), 1, F.greatest(least, F.lit(1)))
    estimate = F.size(F.array_intersect(F.array_intersect(union, F.col("values_a")), F.col("values_b"))) / F.size(union)
    likely = both.where(estimate >= threshold - margin).select("class_a", "class_b")
    exact = _met(_met(likely, side("a"), ["class_a"]), side("b"), ["class_b"]).withColumn("common", F.size(F.array_intersect("values_a", "values_b")))
    similarity = F.col("common") / (F.size("values_a") + F.size("values_b") - F.col("common"))
    return exact.withColumn("similarity", similarity).where(F.col("similarity") >= threshold).select("class_a", "class_b", "similarity")


def similar_rows(df: DataFrame, id_column: str, threshold: float = THRESHOLD, shingle: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """id_a < id_b for all pairs of rows that reach the threshold, copies expanded. Its size is that of the answer."""
    members, rows = sketches(df, id_column, shingle, k)
    links = similar_classes(df, id_column, rows, members, threshold, shingle, k)
    a, b = members.select(F.col("id").alias("id_a"), F.col("class_id").alias("class_a")), members.select(F.col("id").alias("id_b"), F.col("class_id").alias("class_b"))
    between = _met(_met(links, a, ["class_a"]), b, ["class_b"]).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    within = _met(a.withColumnRenamed("class_a", "class_id"), b.withColumnRenamed("class_b", "class_id"), ["class_id"]).where("id_a < id_b").select("id_a", "id_b")
    return between.unionByName(within)


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the least node) for links (a, b), by alternating large-star and small-star steps.

    Every step is checkpointed, so a lost executor doesn't restart the iteration. A hub with many neighbours is only
    ever aggregated to its least neighbour.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut_lineage(small)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.unionByName(roots)


def duplicate_groups(df: DataFrame, id_column: str, threshold: float = THRESHOLD, shingle: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """id, class_id (least row with the same words), group_id (least row of the connected texts), n_links (of the class).

    Rows without a shingle are groups of their own.
    """
    members, rows = sketches(df, id_column, shingle, k)
    links = cut_lineage(similar_classes(df, id_column, rows, members, threshold, shingle, k))
    groups = connected_components(links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))).withColumnRenamed("node", "class_id")
    ends = reduce(DataFrame.unionByName, [links.select(F.col(c).alias("class_id")) for c in ("class_a", "class_b")])
    counts = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    grouped = _met(_met(members, groups, ["class_id"], "left"), counts, ["class_id"], "left")
    known = grouped.select("id", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    alone = _met(df.select(F.col(id_column).alias("id")), members.select("id"), ["id"], "left_anti").select("id", F.col("id").alias("class_id"), F.col("id").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(alone)
