"""SimHash near-duplicates with bit-sliced comparison (operator 9).

A text's fingerprint has a bit set where over half of its word shingles' hashes have it. Equal fingerprints
are one class first, so copies cost nothing further. Classes within `radius` bits agree on whole blocks of
the 64 bits (pigeonhole), so they meet in at least one bucket of equal blocks; the number of blocks follows
the number of classes, and finds the same links at any size.

Buckets are compared bit-sliced: the fingerprints of many buckets stand as 64 vertical bit planes, buckets of
more members first. Shifting all planes by k lanes puts every member against its k-th successor; the
differing bits are added up lane by lane in carry-save counters, three planes at a time, and words whose
lanes are all past the radius (or past their bucket) are dropped from the rest of the planes. A task emits a
spanning forest of its links. A bucket above `bucket_rows` is dealt into blocks whose pairs are separate
groups, so no task holds more than two blocks.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; rows with the same
id count as rows; null ids belong to a component whose smallest id ignores them (null if all are null); an
empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumatab.llm import shared
from lumatab.llm.components import connected_components

SEED = 42
RADIUS = 4


def fingerprint(text: str | None, width: int = 4, seed: int = SEED) -> int:
    """The 64 bits, as a signed number."""
    words = (text or "").encode().lower().split()  # of bytes: lowers A-Z, splits at the six ASCII spaces
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= width:
        hashes = np.array([digest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = [0, *(ends[: n - width] + 1).tolist()]
        hashes = np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, n - width + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[i : i + (1 << 15)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, columns of extra, fp) per row."""
    extra = extra or {}
    source = docs.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in extra.items()), F.col(text_col).cast("string").alias("t"))
    k = 1 + len(extra)
    names = [*source.columns[:k], "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), pa.array([fingerprint(t.as_py(), width) for t in b.column(k)], pa.int64())], names)

    return source.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:k]) + ", fp bigint")


def _planes(values: np.ndarray, words: int) -> np.ndarray:
    """64 rows of packed lanes, with a spare word at the end."""
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[: len(values)] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    return np.concatenate([packed, np.zeros((64, 1), np.uint64)], axis=1)


def near_lanes(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lanes i (packed words) of `valid` that differ from lane i + shift in at most `radius` (up to 4) bits."""
    word, bit = divmod(shift, 64)
    at = np.flatnonzero(valid)  # words with a lane to compare
    alive = valid[at]
    c1, c2, c4, over = (np.zeros(len(at), np.uint64) for _ in range(4))
    up, down = np.uint64(bit), np.uint64(64 - bit)
    last = planes.shape[1] - 1

    def differ(p: int) -> np.ndarray:
        row = planes[p]
        moved = row[np.minimum(at + word, last)]
        if bit:
            moved = moved >> up | row[np.minimum(at + word + 1, last)] << down
        return row[at] ^ moved

    for p in range(0, 64, 3):
        a = differ(p)
        if p < 63:
            b, c = differ(p + 1), differ(p + 2)
            ab = a ^ b
            ones, twos = ab ^ c, (a & b) | (ab & c)
        else:
            ones, twos = a, None
        carry = c1 & ones
        c1 ^= ones
        if twos is not None:
            carry, fours = carry ^ twos, carry & twos
        else:
            fours = np.zeros_like(carry)
        fours = fours | (c2 & carry)
        c2 ^= carry
        over |= c4 & fours
        c4 ^= fours
        # counts stand at 7 at most here: past 4, or past a smaller radius
        past = {4: c4 & (c1 | c2), 3: c4, 2: c4 | (c1 & c2), 1: c4 | c2, 0: c4 | c2 | c1}[radius]
        over |= past
        alive = alive & ~over
        left = np.flatnonzero(alive)
        if not len(left):
            break
        if 2 * len(left) < len(at):
            at, alive, c1, c2, c4, over = at[left], alive[left], c1[left], c2[left], c4[left], over[left]
    out = np.zeros_like(valid)
    out[at] = alive
    return out


def forest(groups: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (value, value) of the links inside runs of equal group."""
    edge = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(edge, len(groups)))
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    if not len(order):
        return values[:0], values[:0]
    sizes, edge = sizes[order], edge[order]
    ends = np.cumsum(sizes)
    lanes = np.repeat(edge - ends + sizes, sizes) + np.arange(int(ends[-1]))
    values = values[lanes]
    left = np.repeat(ends, sizes) - np.arange(int(ends[-1]))  # members from here to the bucket's end
    planes = _planes(values, -(-len(values) // 64))
    parent = np.arange(len(values))
    for shift in range(1, int(sizes[0])):
        n = int(ends[np.count_nonzero(sizes > shift) - 1])  # larger buckets stand first
        ok = np.zeros(-(-n // 64) * 64, bool)
        ok[:n] = left[:n] > shift
        valid = np.packbits(ok, bitorder="little").view("<u8")
        near = near_lanes(planes, shift, valid, radius)
        i = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        apart = parent[i] != parent[i + shift]
        for x in i[apart].tolist():
            a, b = x, x + shift
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
        if apart.any():
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    child = np.flatnonzero(parent != np.arange(len(values)))
    return values[child], values[parent[child]]


def blocks_for(classes: int, radius: int = RADIUS, bucket: int = 64) -> int:
    """Blocks to cut the 64 bits in: the fewest for which a bucket of agreeing blocks has about `bucket` members of evenly spread fingerprints."""
    for n in range(radius + 1, radius + 5):
        if classes <= bucket << 64 * (n - radius) // n:
            return n
    return radius + 4


def near_edges(classes: DataFrame, count: int, tables: shared.Steps, radius: int = RADIUS, bucket_rows: int = 2048, held: int = 1 << 17) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect all within `radius` bits."""
    n = blocks_for(count, radius)
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(n)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    agreeing = [signed(sum(masks[i] for i in c)) for c in combinations(range(n), n - radius)]
    keys = F.explode(F.array(*(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m).cast("bigint"))) for t, m in enumerate(agreeing))))
    rows = classes.select("fp", keys.alias("g"))
    # two buckets whose hashes collide are only compared as one
    large = tables.write(rows.groupBy("g").count().where(F.col("count") > bucket_rows).select(F.col("g").alias("big"), F.ceil(F.col("count") * 2 / bucket_rows).cast("int").alias("parts")), "large-buckets")
    if large.isEmpty():
        dealt = rows
    else:
        part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
        pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("g", F.least(j, part), F.greatest(j, part))))
        joined = rows.join(large, F.col("g") == F.col("big"), "left")
        dealt = joined.where("big IS NULL").select("fp", "g").unionByName(joined.where("big IS NOT NULL").select("fp", pairs.alias("g")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_g, kept_v = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(g, v):
            a, b = forest(g, v, radius)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            kept_g = np.concatenate([kept_g, b.column(0).to_numpy()])
            kept_v = np.concatenate([kept_v, b.column(1).to_numpy()])
            if len(kept_g) >= held:
                whole = int(np.searchsorted(kept_g, kept_g[-1]))  # the last group may go on
                if whole:
                    yield out(kept_g[:whole], kept_v[:whole])
                    kept_g, kept_v = kept_g[whole:], kept_v[whole:]
        if len(kept_g):
            yield out(kept_g, kept_v)

    ordered = dealt.select("g", "fp").repartition("g").sortWithinPartitions("g")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def linked(prints: DataFrame, key: Column, tables: shared.Steps, radius: int = RADIUS) -> DataFrame:
    """(fp, first) of every distinct fingerprint; first is the smallest key in its component. prints is a written table with fp."""
    classes = tables.write(prints.groupBy("fp").agg(F.min(key).alias("own")), "classes")
    nodes = connected_components(near_edges(classes, classes.count(), tables, radius), tables)
    members = tables.write(nodes.join(classes, F.col("node") == F.col("fp")).select("fp", "component", "own"), "members")
    firsts = members.groupBy("component").agg(F.min("own").alias("first"))
    found = members.select("fp", "component").join(firsts, "component").select(F.col("fp").alias("f"), "first", F.lit(True).alias("hit"))
    return classes.join(found, F.col("fp") == F.col("f"), "left").select("fp", F.when(F.col("hit"), F.col("first")).otherwise(F.col("own")).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) per row."""
    with shared.steps(docs.sparkSession) as tables:
        prints = tables.write(fingerprints(docs, id_col, text_col, width), "fingerprints")
        reps = tables.write(linked(prints, F.col("id"), tables, radius), "representatives")
        shown = F.lower(F.lpad(F.hex("p.fp"), 16, "0"))
        out = prints.alias("p").join(reps.alias("r"), F.col("p.fp") == F.col("r.fp")).select(F.col("id").alias(id_col), shown.alias("fingerprint"), F.col("first").alias("component_id"))
        return shared.written(out, "simhash-result")[0]


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay: of each group the one with the smallest (id, hash of the row), null ids first; of fully equal rows one."""
    row = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    with shared.steps(docs.sparkSession) as tables:
        prints = tables.write(fingerprints(docs, id_col, text_col, width, {"row": row}), "fingerprints")
        reps = linked(prints, F.struct("id", "row"), tables, radius).select(F.col("first").alias("_key_"))
        equal = prints.groupBy(F.struct("id", "row").alias("_own_")).agg(F.count("*").alias("n")).where("n > 1")
        stay, _ = shared.written(reps.join(equal, F.col("_key_") == F.col("_own_"), "left").select("_key_", F.col("n").isNotNull().alias("_equal_")), "simhash-stay")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.withColumn("_key_", F.struct(F.col(id_col).alias("id"), row.alias("row"))).join(stay, "_key_")
    out = found.where("NOT _equal_").select(*columns)
    if not stay.where("_equal_").isEmpty():
        out = out.unionByName(found.where("_equal_").select(*columns).distinct())  # combined before the shuffle
    return out
