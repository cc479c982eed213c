"""Near copies: MinHash bands propose pairs, odd sketches screen them, full shingle sets confirm them.

A document's set holds its distinct five-word shingles. Documents with the same words are one class and
are compared once. Bands of four of 128 MinHash samples put classes into buckets; classes of similarity
0.75 share no bucket with probability below 1e-5. One-permutation MinHash samples in 1,024 bins are folded
into an odd sketch of 2,048 parity bits: the population count of the XOR of two sketches estimates how many
samples differ, with a standard deviation of the similarity of 0.015 to 0.02. Only pairs whose sizes allow
a link and whose estimate reaches 0.60 have their sets compared; sets of few shingles are always compared.

No bucket is expanded into all pairs. Every member is first compared with the bucket's smallest id, best
pairs first; the links found give components. Members outside a bucket's main component then meet those of
other components there in tiles of bounded size, each pair of tiles a task: sketches tell which members may
have a link, and the shingle sets of those are compared, all pairs of two tiles as one matrix product. A task
returns members, then a forest of links, so the rows between stages grow with the members of a bucket and its
tiles, also where templates fill a bucket without being links. Joins are on keys that adaptive execution splits.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; fewer than five
words are one shingle; rows of one id count as one document; rows without an id are linked with nothing and
have no component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import in_batches, probably, stored
from .vector_dup import forest
from .words import Words, mix, pieces, windows

#: Words of a shingle, MinHash samples and samples of a band, bins and bits of a sketch, similarity in hundredths,
#: estimate that is checked, and shingles of a pair below which no estimate is asked.
SHINGLE, SAMPLES, BAND, BINS, SKETCH_BITS, SIMILAR, CHECK_FROM, FEW = 5, 128, 4, 1024, 2048, 75, 0.60, 192
_LONGS = SKETCH_BITS // 64
#: Sketches of a tile; shingles of a tile, and least that a document counts for there; shingles multiplied at once.
TILE, TILE_SHINGLES, LEAST_SHINGLES, AT_ONCE = 2048, 1 << 19, 256, 1024
_random = np.random.default_rng(424242)
_MULTIPLY = _random.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH = [f"s{i}" for i in range(_LONGS)]
_PRINT = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, filled long, " + ", ".join(f"{s} long" for s in SKETCH)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of every text."""
    for lo, hi, data, offsets in pieces(texts):
        words = Words(data, offsets, lower=True)
        hashes = words.hashes()
        runs = windows(hashes, SHINGLE)
        for i in range(hi - lo):
            first, end = words.first[i], words.first[i + 1]
            if end - first >= SHINGLE:
                yield lo + i, np.unique(runs[first:end - SHINGLE + 1])
            elif end > first:
                yield lo + i, windows(hashes[first:end], int(end - first))
            else:
                yield lo + i, np.zeros(0, np.uint64)


def samples(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 256):
        values = shingles[at:at + 256, None] * _MULTIPLY
        np.minimum(least, (values ^ (values >> np.uint64(31))).min(0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(-1, BAND)
    key = np.arange(len(rows), dtype=np.uint64) + np.uint64(1)
    for j in range(BAND):
        key = mix(key * np.uint64(0xA0761D6478BD642F) + rows[:, j])
    return key.view(np.int64)


def odd_sketch(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of bins with a sample, and parity of the number of samples that fall on each bit.

    The sample of a bin is its smallest value under one permutation of all shingles.
    """
    values = np.sort(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    bins = values >> np.uint64(64 - BINS.bit_length() + 1)
    first = np.ones(len(values), bool)
    first[1:] = bins[1:] != bins[:-1]
    seats = (mix(values[first]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bits = np.bincount(seats, minlength=SKETCH_BITS) & 1
    return int(first.sum()), np.packbits(bits.astype(np.uint8)).view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Set size, key of the word sequence, band keys and sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, keys, bands, filled, sketches = [], [], [], [], []
            texts = batch.column(1)
            for row, found in shingle_sets(texts):
                size.append(len(found))
                words = (texts[row].as_py() or "").encode("utf-8", "replace").lower().split()
                keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                least = samples(found)
                bands.append(band_keys(least) if len(found) else np.zeros(0, np.int64))
                bins, sketch = odd_sketch(found)
                filled.append(bins)
                sketches.append(sketch)
            key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            sketch = np.array(sketches).reshape(-1, _LONGS)
            at = np.zeros(len(bands) + 1, np.int32)
            np.cumsum([len(b) for b in bands], out=at[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *bands]))),
                 pa.array(filled, pa.int64()), *[pa.array(sketch[:, i].copy()) for i in range(_LONGS)]],
                names=["doc_id", "n_shingles", "k1", "k2", "bands", "filled", *SKETCH])

    return in_batches(docs, run, _PRINT)


def _sketched(classes: DataFrame, name: str, letter: str) -> DataFrame:
    """Sketch columns under the given id name and letter."""
    return classes.select(F.col("id").alias(name), F.col("n_shingles").alias(f"{letter}_n"), F.col("filled").alias(f"{letter}_filled"),
                          *[F.col(s).alias(f"{letter}_{s}") for s in SKETCH])


def estimate() -> Column:
    """Similarity estimated from the sketch columns s_ and t_, for pairs near ``SIMILAR``.

    Samples shared = half of the samples of both less those that differ; the number of bins that the union
    fills follows from its size at that similarity.
    """
    bits = sum((F.bit_count(F.col(f"s_{s}").bitwiseXOR(F.col(f"t_{s}"))) for s in SKETCH), F.lit(0))
    differ = F.log(F.greatest(1 - 2 * bits / F.lit(float(SKETCH_BITS)), F.lit(1e-6))) * F.lit(-SKETCH_BITS / 2)
    shared = (F.col("s_filled") + F.col("t_filled") - differ) / 2
    union = F.lit(float(BINS)) * (1 - F.exp((F.col("s_n") + F.col("t_n")) * F.lit(-1 / ((1 + SIMILAR / 100) * BINS))))
    return shared / union


def may_link() -> Column:
    """Whether the sizes of s_ and t_ allow a link (no link is lost there) and their sketches do."""
    sizes = 100 * F.least("s_n", "t_n") >= SIMILAR * F.greatest("s_n", "t_n")
    return sizes & ((F.col("s_n") + F.col("t_n") < FEW) | (estimate() >= CHECK_FROM))


def screened(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches allow the similarity, with the estimate."""
    both = pairs.join(_sketched(classes, "b", "t"), "b").join(_sketched(classes, "a", "s"), "a")
    return both.where(may_link()).select("a", "b", estimate().alias("estimate"))


def bodies_of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Texts of the ids in pairs (a, b)."""
    return texts_of(texts, stored(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()))


def texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of stored ids (id)."""
    found, mark = probably(texts, "doc_id", wanted)
    return stored(found.where(F.col(mark)).join(wanted, found["doc_id"] == wanted["id"]).select("id", "text"))


def confirmed(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint64))
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            ids = batch.column(0).to_pylist()
            for row, one in shingle_sets(batch.column(3)):
                if last[0] != ids[row]:
                    last = ids[row], next(shingle_sets(batch.column(2).slice(row, 1)))[1]
                both = len(np.intersect1d(one, last[1], assume_unique=True))
                keep[row] = 100 * both >= SIMILAR * (len(one) + len(last[1]) - both)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    with_b = pairs.select("a", "b").join(bodies.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(bodies.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return in_batches(with_both.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = stored(fingerprints(texts))
    classes = stored(prints.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("bands", "n_shingles", "filled", *SKETCH)]))
    placed = classes.select("id", F.explode("bands").alias("band"))
    buckets = placed.groupBy("band").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot != last").drop("last")
    members = stored(placed.join(buckets, "band"))
    star = members.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    candidates = stored(screened(star, classes))
    bodies = bodies_of(texts, candidates)

    best = Window.partitionBy("b").orderBy(F.desc("estimate"), "a")
    ranked = candidates.withColumn("rank", F.row_number().over(best))
    links = stored(confirmed(ranked.where("rank = 1"), bodies))
    found = components(links)
    others = ranked.where("rank > 1").select("a", "b")
    others = others.join(found.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(
        found.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    others = others.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = stored(confirmed(others, bodies))
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links)

    rest = rest_links(members, found, classes, texts)
    if not rest.isEmpty():
        found = components(links.unionByName(rest))

    of_class = classes.select("k1", "k2", "id").join(found, "id", "left").select(
        "k1", "k2", F.coalesce("component", "id").alias("component"))
    out = prints.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def tile_screen(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
    """Which rows of x and y are of different components and may link: ``may_link`` over all pairs of two tiles."""
    out = np.zeros((len(x["n"]), len(y["n"])), bool)
    for lo in range(0, len(out), 256):
        at = slice(lo, lo + 256)
        bits = np.zeros((len(x["n"][at]), len(y["n"])), np.int32)
        for i in range(_LONGS):
            bits += np.bitwise_count((x["sketch"][at, i, None] ^ y["sketch"][None, :, i]).view(np.uint64))
        both = x["n"][at, None] + y["n"][None]
        differ = np.log(np.maximum(1 - 2 * bits / SKETCH_BITS, 1e-6)) * (-SKETCH_BITS / 2)
        union = BINS * (1 - np.exp(both * (-1 / ((1 + SIMILAR / 100) * BINS))))
        alike = (x["filled"][at, None] + y["filled"][None] - differ) / 2 >= CHECK_FROM * union
        sizes = 100 * np.minimum(x["n"][at, None], y["n"][None]) >= SIMILAR * np.maximum(x["n"][at, None], y["n"][None])
        out[at] = sizes & ((both < FEW) | alike) & (x["component"][at, None] != y["component"][None])
    return out


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y.

    Shingles that many sets of both sides hold are columns of a matrix product, others are counted pair by pair.
    """
    out = np.zeros((len(x), len(y)))
    common = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
    if not len(common):
        return out

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[at] == values
        order = np.argsort(at[hit], kind="stable")
        return rows[hit][order], at[hit][order]

    (rx, cx), (ry, cy) = places(x), places(y)
    nx, ny = np.bincount(cx, minlength=len(common)), np.bincount(cy, minlength=len(common))
    dense = nx * ny * 100 > out.size
    seat = np.cumsum(dense) - 1
    (dx, sx), (dy, sy) = ((r[dense[c]], seat[c[dense[c]]]) for r, c in ((rx, cx), (ry, cy)))
    for lo in range(0, int(dense.sum()), AT_ONCE):
        ends = lo, lo + AT_ONCE
        sides = []
        for rows, seats, sets in ((dx, sx, x), (dy, sy, y)):
            one, end = np.searchsorted(seats, ends)
            side = np.zeros((len(sets), AT_ONCE), np.float32)
            side[rows[one:end], seats[one:end] - lo] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    rows, columns = rx[~dense[cx]], cx[~dense[cx]]
    first, sums = np.cumsum(ny) - ny, np.cumsum(ny[columns])
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + (1 << 20), "right")))
        each = ny[columns[lo:hi]]
        step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        np.add.at(out, (np.repeat(rows[lo:hi], each), ry[step + np.repeat(first[columns[lo:hi]], each)]), 1)
        lo = hi
    return out


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Rows of the first and of the second tile, which may be one and the same."""
    table = table.combine_chunks()
    second = table.filter(pa.array(table.column("side").to_numpy() == 1))
    if table.num_rows and table.column("ti")[0] == table.column("tj")[0]:
        return table, table
    return table.filter(pa.array(table.column("side").to_numpy() == 0)), second


def _possible(table: pa.Table) -> pa.Table:
    """Members of two tiles with a possible link between them."""

    def arrays(rows: pa.Table) -> dict[str, np.ndarray]:
        sketch = np.stack([rows.column(s).to_numpy() for s in SKETCH], 1)
        return {"sketch": sketch, "n": rows.column("n_shingles").to_numpy()} | {
            c: rows.column(c).to_numpy() for c in ("filled", "component")}

    x, y = _sides(table)
    maybe = tile_screen(arrays(x), arrays(y))
    ids = np.unique(np.concatenate([x.column("id").to_numpy()[maybe.any(1)], y.column("id").to_numpy()[maybe.any(0)]]))
    return pa.table({"band": pa.array(np.full(len(ids), table.column("band")[0].as_py(), np.int64)), "id": pa.array(ids)})


def _linked(table: pa.Table) -> pa.Table:
    """A forest of the links between the components of two tiles, by full sets."""
    x, y = _sides(table)
    if not x.num_rows or not y.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b")})
    sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in side.column("shingles")] for side in (x, y)]
    both = overlaps(*sets)
    sizes = [np.array([len(s) for s in side]) for side in sets]
    of = [side.column("component").to_numpy() for side in (x, y)]
    linked = (100 * both >= SIMILAR * (sizes[0][:, None] + sizes[1][None] - both)) & (of[0][:, None] != of[1][None])
    links = np.array(forest(linked, x.column("id").to_numpy(), y.column("id").to_numpy()), np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(links[:, 0].copy()), "b": pa.array(links[:, 1].copy())})


def dealt(rows: DataFrame, weight: Column, tile: int) -> DataFrame:
    """Rows (band, id, outside, ...) once for each pair of tiles (ti, tj) of their bucket that they meet in.

    A tile holds rows of about ``tile`` in weight. Tiles outside the main component come first and meet every
    tile; those of the main component do not meet one another.
    """
    total = lambda is_in: F.coalesce(F.ceil(F.sum(F.when(is_in, weight)) / tile), F.lit(0)).cast("long")
    counts = rows.groupBy("band").agg(total(F.col("outside")).alias("nx"), total(~F.col("outside")).alias("nm"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("outside"), F.col("nx")).otherwise(F.col("nm")))
    placed = rows.join(counts, "band").withColumn("tile", F.when(F.col("outside"), own).otherwise(own + F.col("nx")))
    last = F.when(F.col("outside"), F.col("nx") + F.col("nm") - 1).otherwise(F.col("nx") - 1)
    placed = placed.where("nx > 0").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    placed = placed.withColumns({"ti": F.least("tile", "other"), "tj": F.greatest("tile", "other"),
                                 "side": (F.col("tile") > F.col("other")).cast("int")}).drop("tile", "other", "nx", "nm")
    # by number: otherwise all tiles of a bucket stay where the join on its band put them, and few bytes make few tasks
    return placed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "band", "ti", "tj")


def rest_links(members: DataFrame, found: DataFrame, classes: DataFrame, texts: DataFrame,
               tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Links (a, b), enough to join what is similar, between members of one bucket but different components.

    The bucket's smallest id was compared with all others before and takes no part.
    """
    labelled = _labelled(members.where("id != pivot").select("band", "id"), found)
    split = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("band")
    open_ = stored(labelled.join(split, "band"))
    mains = open_.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"))
    open_ = open_.join(mains, "band").withColumn("outside", F.col("component") != F.col("main")).drop("main")
    open_ = stored(open_.join(classes.select("id", "n_shingles", "filled", *SKETCH), "id"))
    possible = stored(dealt(open_, F.lit(1), tile).groupBy("band", "ti", "tj").applyInArrow(_possible, "band long, id long").distinct())
    wanted = stored(possible.select("id").distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for _, s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "shingles"])

    bodies = stored(in_batches(texts_of(texts, wanted), sets, "id long, shingles binary").distinct())
    met = possible.join(open_.select("band", "id", "component", "outside").distinct(), ["band", "id"])
    size = F.greatest(F.length("shingles") / 8, F.lit(LEAST_SHINGLES))
    met = dealt(met.join(bodies, "id"), size, tile_shingles)
    return stored(met.groupBy("band", "ti", "tj").applyInArrow(_linked, "a long, b long").distinct())


def representatives(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near copies: the one with the smallest id, once."""
    found = stored(near_duplicates(docs))
    removed = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct())
    split, mark = probably(docs, "doc_id", removed)
    doubtful = split.where(F.col(mark)).drop(mark)
    kept = split.where(~F.col(mark)).drop(mark).unionByName(
        doubtful.join(removed, doubtful["doc_id"] == removed["id"], "left_anti"))
    repeated = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(
        kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


#: The same result for DuckDB, from all shared shingles.
SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM t),
x AS (SELECT doc_id, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN s sa ON sa.doc_id = p.a JOIN s sb ON sb.doc_id = p.b
  WHERE 100 * p.n >= 75 * (len(sa.s) + len(sb.s) - p.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.a = s.doc_id
"""
