"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection of sorted arrays.

A document's shingles are hashed and ordered from rare to frequent. Two sets that are alike enough share one of the first shingles of either (as many as may be missing, and one),
so documents that name one such shingle form a group. Inside a group, rows sorted by size are cut into tiles; only tiles whose sizes allow the similarity meet, and a pair's bitmaps
bound its overlap from above by bit counts. What passes is intersected exactly.

Equal sets are one class from the start. Bitmaps are compared first for neighbours by size in each group; what passes joins families, and a group is compared in full only across the
families that are left in it. A family's rows, each once, are then cut into size-banded tiles for exact intersection, where a pair that is joined already needs no check. So pairs are
never written out: a stage gives at most one pair a row, and a group of any number of near copies stays linear in what is shuffled, but no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, binary, chunks, dropped, mixed, ship, stored, utf8, window_hashes, words_of
from .components import components

#: Cells of the sketch that tells frequent shingles; slices in which it is summed, each first within BUCKETS groups of tasks.
CELLS, SLICES, BUCKETS = 1 << 18, 32, 1024
#: Rows of a tile of bitmaps; shingles of a tile of arrays.
TILE, TILE_SHINGLES = 1024, 1_000_000
ROW_SCHEMA = "doc_id long, n long, k1 long, k2 long, bitmap binary, prefix array<bigint>"


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of distinct shingles of texts laid end to end, sorted within each text, and the offsets of each text's."""
    texts = len(offsets) - 1
    words, bounds, _ = words_of(LOWER[data], offsets)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    raw, ends = utf8(words)
    base = 0x9E3779B97F4A7C15
    power = np.cumprod(np.full(len(raw) + 1, np.uint64(base)))
    inverse = np.cumprod(np.full(len(raw) + 1, np.uint64(pow(base, -1, 1 << 64))))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(np.arange(256), 3)[raw] * power[:-1])])
    word = mixed((sums[ends[1:]] - sums[ends[:-1]]) * inverse[ends[:-1]]) ^ mixed(np.diff(ends), 4)
    doc = np.repeat(np.arange(texts), np.diff(bounds))
    windows = window_hashes(mixed(word, 5), size)
    inside = doc[: len(windows)] == doc[size - 1 :][: len(windows)] if len(windows) else np.zeros(0, bool)
    values, owners = [windows[inside]], [doc[: len(windows)][inside]]
    counts = np.diff(bounds)
    for m in range(1, size):  # fewer words than a shingle: the sequence as one
        own = np.flatnonzero(counts == m)
        if len(own):
            values.append(mixed(window_hashes(mixed(word, 5), m)[bounds[own]], 100 + m))
            owners.append(own)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(texts + 1))


def _sketch(size: int):
    """How often each cell of shingle hashes is hit, in slices."""

    def count(batches):
        from pyspark import TaskContext

        total, bucket = np.zeros(CELLS, np.int64), TaskContext.get().partitionId() % BUCKETS
        for batch in chunks(batches, 2 << 20):
            values, _ = shingles(*utf8(batch.column("text")), size)
            total += np.bincount((values >> np.uint64(40)).astype(np.int64) & (CELLS - 1), minlength=CELLS)
        parts = total.reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES), pa.int32()), pa.array(np.full(SLICES, bucket), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "bucket", "counts"])

    return count


def frequency_classes(documents: DataFrame, size: int) -> np.ndarray:
    """A class from 0 (not frequent) to 7 for each cell, by counts over all documents. The sketch has CELLS numbers at any input size.

    Each task sends 64 KB a slice. They are summed in two steps, so that a group holds about the square root of what all tasks send: 30 MB at 500,000 tasks.
    """
    schema = "slice int, bucket int, counts binary"
    sketches = documents.select("text").mapInArrow(_sketch(size), schema)
    rows = sketches.groupBy("slice", "bucket").applyInArrow(_sum_slices, schema).groupBy("slice").applyInArrow(_sum_slices, schema).collect()
    counts = np.zeros(CELLS, np.int64)
    for r in rows:
        counts.reshape(SLICES, -1)[r.slice] = np.frombuffer(bytes(r.counts), np.int64)
    usual = 4 * counts.mean() + 64
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / usual)) + 1, 0, 7).astype(np.uint8)


def _sum_slices(table: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // SLICES, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_py(), np.int64)
    return pa.table({"slice": table.column("slice")[:1], "bucket": table.column("bucket")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _bits(n: np.ndarray) -> np.ndarray:
    """Width of a bitmap: the power of two at or above twice the set's size, 64 at least."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))


def _keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(values, k))]) for k in (31, 32)]
    return tuple((mixed(s[bounds[1:]] - s[bounds[:-1]], 33) ^ mixed(np.diff(bounds), 34)).astype(np.int64) for s in sums)


def _describe(size: int, percent: int, classes):
    """Rows of ROW_SCHEMA: set size, set key, bitmap and the rarest shingles."""

    def describe(batches):
        frequent = classes.value
        for batch in chunks(batches, 2 << 20):
            values, bounds = shingles(*utf8(batch.column("text")), size)
            n = np.diff(bounds)
            k1, k2 = _keys(values, bounds)
            owner = np.repeat(np.arange(len(n)), n)
            width = _bits(n)
            start = np.concatenate([[0], np.cumsum(np.where(n > 0, width, 0))])
            bits = np.zeros(int(start[-1]), np.uint8)
            bits[start[owner] + (values & (width[owner] - 1).astype(np.uint64)).astype(np.int64)] = 1
            ranked = frequent[(values >> np.uint64(40)).astype(np.int64) & (CELLS - 1)].astype(np.uint64) << np.uint64(61) | mixed(values, 6) >> np.uint64(3)
            order = np.lexsort((ranked, owner))
            most = n - -(-n * percent // 100) + 1
            first = (np.arange(len(values)) - bounds[owner]) < most[owner]
            prefix = ranked[order][first].astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n), pa.array(k1), pa.array(k2), binary(np.packbits(bits), start // 8),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, most, 0))]), pa.int32()), pa.array(prefix)),
            ], names=[c.split()[0] for c in ROW_SCHEMA.split(", ")])

    return describe


def _fits(o, na, nb, percent: int):
    """Whether an overlap of o makes two sets of sizes na and nb alike enough."""
    return 100 * o >= percent * (na + nb - o)


def _bitmap(raw: np.ndarray, width: int) -> np.ndarray:
    """A bitmap's 64-bit words, folded to `width` bits."""
    words = raw.view(np.uint64)
    while len(words) * 64 > width:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def _bound(percent: int):
    """Keeps pairs (a, b) whose bitmaps allow the similarity."""

    def bound(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            rows = [(utf8(batch.column(c))) for c in ("bitmap_a", "bitmap_b")]
            keep = np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb)
            widths = [np.diff(o) * 8 for _, o in rows]
            narrow = np.minimum(*widths)
            for w in np.unique(narrow[keep]):
                own = np.flatnonzero(keep & (narrow == w))
                maps = []
                for (data, offsets), width in zip(rows, widths, strict=True):
                    stack = np.zeros((len(own), w // 64), np.uint64)
                    for f in np.unique(width[own] // w):  # both are powers of two; the wider is folded
                        at = np.flatnonzero(width[own] == w * f)
                        got = data[offsets[own[at]][:, None] + np.arange(w * f // 8)].reshape(-1).view(np.uint64).reshape(len(at), f, w // 64)
                        stack[at] = np.bitwise_or.reduce(got, axis=1)
                    maps.append(stack)
                missing_b = np.bitwise_count(maps[0] & ~maps[1]).sum(1, dtype=np.int64)
                missing_a = np.bitwise_count(maps[1] & ~maps[0]).sum(1, dtype=np.int64)
                keep[own] = _fits(np.minimum(na[own] - missing_b, nb[own] - missing_a), na[own], nb[own], percent)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return bound


class _Joined:
    """Which labels have been joined so far."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def _passing(rows: list[dict], bitmaps: list[np.ndarray], percent: int, joined: _Joined, check=None):
    """Pairs of rows (sid, comp, n, side) whose labels are not joined and whose bitmaps, and check(x, y) if given, allow the similarity; each joins its labels. Rows are sorted by size."""
    n, side = np.array([r["n"] for r in rows]), np.array([r["side"] for r in rows])
    one = rows[0]["i"] == rows[0]["j"]
    stacks: dict[int, np.ndarray] = {}
    for x in range(len(rows) - 1):
        to = int(np.searchsorted(n * percent, 100 * n[x], "right"))
        y = np.arange(x + 1, to)
        if not one:
            y = y[side[y] != side[x]]
        mine = joined.top(rows[x]["comp"])
        y = np.array([k for k in y if joined.top(rows[k]["comp"]) != mine], np.int64)
        if not len(y):
            continue
        width = len(bitmaps[x]) * 8
        if width not in stacks:
            stacks[width] = np.stack([_bitmap(r, width) if len(r) * 8 >= width else np.zeros(width // 64, np.uint64) for r in bitmaps])
        own, other = stacks[width][x], stacks[width][y]
        o = np.minimum(n[x] - np.bitwise_count(own & ~other).sum(1, dtype=np.int64), n[y] - np.bitwise_count(other & ~own).sum(1, dtype=np.int64))
        for k in y[_fits(o, n[x], n[y], percent)]:
            if joined.top(rows[k]["comp"]) != joined.top(rows[x]["comp"]) and (check is None or check(x, k)):
                joined.join(rows[k]["comp"], rows[x]["comp"])
                yield min(rows[x]["sid"], rows[k]["sid"]), max(rows[x]["sid"], rows[k]["sid"])


def _groups(batches, *names: str):
    """Lists of rows with equal values of `names`, from batches ordered by them; sorted by size."""
    held, key = [], None
    for batch in batches:
        for r in batch.to_pylist():
            k = tuple(r[c] for c in names)
            if k != key and held:
                yield sorted(held, key=lambda r: (r["n"], r["sid"]))
                held = []
            held.append(r)
            key = k
    if held:
        yield sorted(held, key=lambda r: (r["n"], r["sid"]))


def _batches(pairs):
    """Pairs as record batches."""
    held = []
    for p in pairs:
        held.append(p)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=["a", "b"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=["a", "b"])


def _tiles(percent: int):
    """Bitmap tiles (token, i, j, side, sid, comp, n, bitmap): pairs that join families, one at most for each row."""

    def compare(batches):
        yield from _batches(p for rows in _groups(batches, "token", "i", "j") for p in _passing(rows, [np.frombuffer(r["bitmap"], np.uint8) for r in rows], percent, _Joined()))

    return compare


def _exact(percent: int):
    """Tiles of arrays (comp is the component so far): pairs that link, one at most for each row."""

    def links(rows: list[dict]):
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        bitmaps = []
        for x, w in zip(sets, _bits(np.array([len(x) for x in sets])), strict=True):
            bits = np.zeros(int(w), np.uint8)
            bits[(x & np.uint64(w - 1)).astype(np.int64)] = 1
            bitmaps.append(np.packbits(bits))

        def check(i, j):
            x, y = sets[i], sets[j]
            o = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            return _fits(o, len(x), len(y), percent)

        return _passing(rows, bitmaps, percent, _Joined(), check)

    def compare(batches):
        yield from _batches(p for rows in _groups(batches, "family", "i", "j") for p in links(rows))

    return compare


def _arrays(size: int):
    """Sorted shingle arrays of wanted texts; a row of the same doc_id but another set is passed over."""

    def arrays(batches):
        for batch in chunks(batches, 2 << 20):
            values, bounds = shingles(*utf8(batch.column("text")), size)
            k1, k2 = _keys(values, bounds)
            own = pa.array(np.flatnonzero((k1 == batch.column("k1").to_numpy()) & (k2 == batch.column("k2").to_numpy())))
            column = binary(values.view(np.uint8), bounds * 8)
            yield pa.RecordBatch.from_arrays([batch.column("sid").take(own), batch.column("family").take(own), batch.column("n").take(own), column.take(own)], names=["sid", "family", "n", "shingles"])

    return arrays


def _meetings(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """For rows (key, tile, n, ...): each row once for every pair of tiles (i, j) of its key whose sizes allow the similarity, side the row's own."""
    spans = rows.groupBy(key, "tile").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    meets = spans.select(key, F.col("tile").alias("i"), "most").join(spans.select(key, F.col("tile").alias("j"), "least"), key).where((F.col("i") <= F.col("j")) & (F.col("least") * percent <= F.col("most") * 100))
    sides = meets.select(key, "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("tile"))
    return rows.join(sides, [key, "tile"]).withColumnRenamed("tile", "side")


def _pair(df: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Joins columns of both ends to pairs (a, b)."""
    for end in "ab":
        df = df.join(sets.select(F.col("sid").alias(f"sid_{end}"), *[F.col(c).alias(f"{short}{end}") for c, short in columns]), F.col(end) == F.col(f"sid_{end}")).drop(f"sid_{end}")
    return df


def jaccard_classes(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Links documents whose sets of `size`-word shingles have a Jaccard similarity of `percent` hundredths or more.

    Words are runs of other than ASCII blanks, A-Z lower-cased. A text of fewer words is one shingle; null, empty or blank text has none and links with nothing.
    Returns doc_id, n_shingles and component_id (the smallest doc_id that links reach) for every row. Repeated rows and equal ids: each a row, linked as copies are.
    Null doc_id: kept, never a component's name unless all its ids are null. Empty table: no rows. Other columns are not read. Texts are whole.
    """
    spark = ship(documents.sparkSession)
    docs = documents.select("doc_id", "text")
    classes = spark.sparkContext.broadcast(frequency_classes(docs, size))
    described = stored(docs.mapInArrow(_describe(size, percent, classes), ROW_SCHEMA), "jaccard-rows")
    full = described.where("n > 0")
    sets = stored(full.dropDuplicates(["k1", "k2"]).withColumn("sid", F.monotonically_increasing_id()), "jaccard-sets")
    keys = stored(described.select("doc_id", "n", "k1", "k2"), "jaccard-keys")
    dropped(described)

    by_size = Window.partitionBy("token").orderBy("n", "sid")
    alike = lambda other: F.least("n", other) * 100 >= F.greatest("n", other) * percent
    named = sets.select(F.explode("prefix").alias("token"), "sid", "n")
    named = named.select("*", *[f(c).over(by_size).alias(f"{c}_{end}") for c in ("sid", "n") for f, end in ((F.lag, "before"), (F.lead, "after"))])
    # A row whose size fits neither neighbour's fits none in its group.
    named = named.withColumn("beside", F.when(alike("n_before"), F.col("sid_before"))).where("beside IS NOT NULL OR " + "least(n, n_after) * 100 >= greatest(n, n_after) * %d" % percent)
    groups = stored(named.select("token", "sid", "n", "beside"), "jaccard-groups")

    beside = groups.where("beside IS NOT NULL").select(F.least("beside", "sid").alias("a"), F.greatest("beside", "sid").alias("b")).distinct()
    beside = _pair(beside, sets, ("n", "n"), ("bitmap", "bitmap_")).select("a", "b", "na", "nb", "bitmap_a", "bitmap_b")
    beside = stored(beside.mapInArrow(_bound(percent), "a long, b long"), "jaccard-beside")

    # Groups in which several families are left; in a group of two the only pair has been compared.
    families = components(beside)
    known = groups.select("token", "sid", "n").join(families.withColumnRenamed("id", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")
    several = known.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high AND rows > 2").select("token")
    known = stored(known.join(several, "token", "left_semi").withColumn("tile", F.floor((F.row_number().over(by_size) - 1) / TILE).cast("int")), "jaccard-several")
    dropped(groups, families)
    laid = _meetings(known, "token", percent).join(sets.select("sid", "bitmap"), "sid").select("token", "i", "j", "side", "sid", "comp", "n", "bitmap")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = stored(laid.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_tiles(percent), "a long, b long").distinct(), "jaccard-across")

    # Exact intersection: each tile in itself, then tiles of one family with each other where several components are left.
    families = components(beside.union(across))
    dropped(known, beside, across)
    need = sets.select("sid", "k1", "k2", "n", F.col("doc_id").alias("d")).join(families.select(F.col("id").alias("sid"), F.col("root").alias("family")), "sid")
    texts = docs.join(need, F.col("doc_id").eqNullSafe(F.col("d"))).select("sid", "family", "n", "k1", "k2", "text")
    arrays = stored(texts.mapInArrow(_arrays(size), "sid long, family long, n long, shingles binary").dropDuplicates(["sid"]), "jaccard-arrays")
    dropped(families)
    cut = F.floor(F.sum("n").over(Window.partitionBy("family").orderBy("n", "sid")) / TILE_SHINGLES).cast("int")
    tiled = stored(arrays.select("sid", "family", "n").withColumn("tile", cut), "jaccard-tiled")
    schema, columns = "a long, b long", ["family", "i", "j", "side", "sid", "comp", "n", "shingles"]

    def intersected(rows: DataFrame, name: str) -> DataFrame:
        full = rows.join(arrays.select("sid", "shingles"), "sid").select(*columns)
        return stored(full.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(_exact(percent), schema), name)

    links = intersected(tiled.select("*", F.col("tile").alias("i"), F.col("tile").alias("j"), F.col("tile").alias("side"), F.col("sid").alias("comp")), "jaccard-inside")
    wide = tiled.groupBy("family").agg(F.max("tile").alias("tiles"), F.min("tile").alias("from")).where("tiles > from").select("family")
    if not wide.isEmpty():
        parts_so_far = components(links)
        left = tiled.join(wide, "family", "left_semi").join(parts_so_far.withColumnRenamed("id", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")
        open_families = left.groupBy("family").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("family")
        left = stored(left.join(open_families, "family", "left_semi"), "jaccard-open")
        between = intersected(_meetings(left, "family", percent).where("i < j"), "jaccard-between")
        roots = components(links.union(between))
        dropped(parts_so_far, left, between)
    else:
        roots = components(links)
    dropped(arrays, tiled, links)
    members = keys.join(sets.select("k1", "k2", "sid"), ["k1", "k2"], "left").join(roots.withColumnRenamed("id", "sid"), "sid", "left")
    members = stored(members.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "sid")).alias("root")), "jaccard-members")
    dropped(keys, sets, roots)
    # Stored, so that the join below deals members anew and a large component's rows can be split over tasks.
    named = stored(members.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id")), "jaccard-named")
    return members.join(named, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, percent=85)
