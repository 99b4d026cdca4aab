"""Media columns: local descriptors find cropped or edited copies of images.

Images are a binary column in the netpbm form P5 (8-bit grey).  Corners are
found at all scales of a pyramid, wherever a corner is the strongest around it,
so that their number follows the image's area; each gets an angle from the
intensity centroid around it and 256 binary tests on a smoothed patch turned by
that angle.  A descriptor is cut into bands; descriptors that share a band meet
in a table of that band (Hamming tables), those within the Hamming limit are
matches, and enough matches that agree on one rotation, scale and shift link two
images.

Equal images become one class first.  A table streams its keys' features in
order and matches each with its key's first one, so that a group of copies costs
as many rows as it has features; what these matches link is connected first.
After that only pairs of images that are still apart count.  Keys of up to
`window` features are compared in full.  In larger keys, features of images that
are apart from the first one's meet in blocks against blocks (none is left out;
the comparisons grow with the square of what is still apart under one key), but a
pair of images comes out only if it can reach enough votes: large keys have an
order, an image's features carry its large keys from their own on, and the keys
that two images share must allow enough matches, together with the matches that
smaller keys gave.  Such pairs are compared feature by feature at once, so that
no match of a pair without enough of them is written.  Keys that hold more than a
share of all features are dealt over several tasks, each with the key's first
feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .minhash import few
from .shared import components, small_batches, staged, table

#: Step of the pyramid, distance within which a corner is the strongest, patch radius, bits that may differ, matches for a link.
STEP, APART, RADIUS, HAMMING, VOTES = 0.8, 6, 15, 36, 4
BANDS = 8

#: Features of a key that are compared with each other at once; rows of a block where the rest is compared.
WINDOW, BLOCK = 64, 2048

#: Elements that a task compares or looks up at once.
AT_ONCE = 1 << 21

#: A key with more features than this, and more than this share of all, is dealt over several tasks.
HOT_ROWS, HOT_SHARE = 4096, 1 / 2000

_rng = np.random.default_rng(7)
#: Where the binary tests compare: 256 pairs of points, normal around the corner.
TESTS = np.clip(_rng.normal(0, 0.4 * RADIUS, (256, 4)), -RADIUS, RADIUS)
_grid = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_disc = (_grid[0] ** 2 + _grid[1] ** 2) <= RADIUS**2


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, dtype=np.uint8).tobytes()


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """The image, or None for anything that is no 8-bit P5 file."""
    if not data or data[:2] != b"P5":
        return None
    at, fields = 2, []
    while len(fields) < 3 and at < len(data):
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
        elif data[at : at + 1].isspace():
            at += 1
        else:
            to = at
            while to < len(data) and data[to : to + 1].isdigit():
                to += 1
            if to == at:
                return None
            fields.append(int(data[at:to]))
            at = to
    if len(fields) < 3 or fields[2] != 255 or len(data) - at - 1 < fields[0] * fields[1]:
        return None
    return np.frombuffer(data, dtype=np.uint8, count=fields[0] * fields[1], offset=at + 1).reshape(fields[1], fields[0])


def _resized(image: np.ndarray, scale: float) -> np.ndarray:
    h, w = max(1, round(image.shape[0] * scale)), max(1, round(image.shape[1] * scale))
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, image.shape[0] - 1), np.clip(np.floor(x).astype(int), 0, image.shape[1] - 1)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    return top * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy


def _smooth(image: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2 r + 1."""
    p = np.pad(image, r + 1, mode="edge")
    s = p.cumsum(axis=0).cumsum(axis=1)
    n = 2 * r + 1
    return (s[n:-1, n:-1] - s[:-n - 1, n:-1] - s[n:-1, :-n - 1] + s[:-n - 1, :-n - 1]) / n**2


def _around(a: np.ndarray, r: int) -> np.ndarray:
    """Maximum over squares of side 2 r + 1, by doubling."""
    for _ in (0, 1):
        have, size = np.pad(a, ((r, r), (0, 0)), constant_values=-np.inf), 1
        while size * 2 <= 2 * r + 1:
            have = np.maximum(have[:-size], have[size:])
            size *= 2
        a = np.maximum(have[: a.shape[0]], have[2 * r + 1 - size :][: a.shape[0]]).T
    return a


def describe(image: np.ndarray) -> list[tuple[float, float, float, float, bytes]]:
    """(x, y, scale, angle, 32-byte descriptor) of an image's corners, strongest first; x and y in its own pixels."""
    found: list[tuple[float, float, float, float, float, bytes]] = []
    scale = 1.0
    while True:
        grey = _resized(image.astype(np.float64), scale) if scale < 1 else image.astype(np.float64)
        if min(grey.shape) < 2 * RADIUS + 3:
            break
        gy, gx = np.gradient(_smooth(grey, 1))
        a, b, c = _smooth(gx * gx, 2), _smooth(gy * gy, 2), _smooth(gx * gy, 2)
        strength = a * b - c * c - 0.05 * (a + b) ** 2
        ys, xs = np.nonzero((strength >= _around(strength, APART)) & (strength > 1.0))
        inside = (ys >= RADIUS) & (xs >= RADIUS) & (ys < grey.shape[0] - RADIUS) & (xs < grey.shape[1] - RADIUS)
        ys, xs = ys[inside], xs[inside]
        if len(ys):
            soft = _smooth(grey, 2)
            patch = grey[ys[:, None, None] + _grid[0], xs[:, None, None] + _grid[1]] * _disc
            angle = np.arctan2((patch * _grid[0]).sum(axis=(1, 2)), (patch * _grid[1]).sum(axis=(1, 2)))
            cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]

            def at(x: np.ndarray, y: np.ndarray, cos=cos, sin=sin, ys=ys, xs=xs, soft=soft) -> np.ndarray:
                u = np.clip(np.rint(xs[:, None] + cos * x - sin * y).astype(int), 0, soft.shape[1] - 1)
                v = np.clip(np.rint(ys[:, None] + sin * x + cos * y).astype(int), 0, soft.shape[0] - 1)
                return soft[v, u]

            bits = np.packbits(at(TESTS[:, 0], TESTS[:, 1]) < at(TESTS[:, 2], TESTS[:, 3]), axis=1)
            found += [(float(strength[y, x]), (x + 0.5) / scale - 0.5, (y + 0.5) / scale - 0.5, scale, float(t), d.tobytes()) for y, x, t, d in zip(ys, xs, angle, bits, strict=True)]
        scale *= STEP
    found.sort(key=lambda f: (-f[0], f[1], f[2], f[3]))
    return [f[1:] for f in found]


DESCRIPTOR = ["d0", "d1", "d2", "d3"]
CORNER = "x: float, y: float, scale: float, angle: float, d0: long, d1: long, d2: long, d3: long"


def _described(rows: DataFrame, image: str, others: list[str]) -> DataFrame:
    """The columns `others` and corners, an array of an image's features (empty where there is no image)."""
    of = pa.struct([(n, pa.float32()) for n in ("x", "y", "scale", "angle")] + [(n, pa.int64()) for n in DESCRIPTOR])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, bits, counts = [], [], []
            for data in batch.column(image):
                drawn = read_pgm(data.as_py())
                found = describe(drawn) if drawn is not None and drawn.size else []
                places += [f[:4] for f in found]
                bits += [f[4] for f in found]
                counts.append(len(found))
            xs = np.array(places, dtype=np.float32).reshape(-1, 4)
            ds = np.frombuffer(b"".join(bits), dtype=np.int64).reshape(-1, 4)
            flat = pa.StructArray.from_arrays([pa.array(xs[:, k]) for k in range(4)] + [pa.array(ds[:, k]) for k in range(4)], fields=list(of))
            corners = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), corners], names=[*others, "corners"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*[F.col(f"`{c}`") for c in others], image).mapInArrow(run, f"{schema}, corners array<struct<{CORNER}>>")


def _keyed(features: DataFrame) -> DataFrame:
    """(key, v, f, d0..d3): each feature under each of its bands; a key is the band's number and 32 bits."""
    band = lambda i: F.shiftrightunsigned(F.col(f"d{i // 2}"), 32 * (i % 2)).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(i << 32)
    flat = features.select("v", F.posexplode("corners").alias("f", "c")).select("v", "f", "c.*")
    return flat.select(F.explode(F.array(*[band(i) for i in range(BANDS)])).alias("key"), "v", "f", *DESCRIPTOR)


def _dealt(spark: SparkSession, keyed: DataFrame, hot_rows: int, hot_share: float) -> DataFrame:
    """Adds salt and follows: hot keys are dealt over several salts, each of which gets the key's first feature before its own (which follow).

    A first, coarse count over 65,536 groups of keys leaves few keys to be counted
    one by one: at most 1 / hot_share keys of a band can be hot."""
    group = F.pmod(F.xxhash64("key"), F.lit(1 << 16)).cast("int")
    coarse = keyed.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()
    least = max(hot_rows, hot_share * sum(r["n"] for r in coarse))
    full = [r["g"] for r in coarse if r["n"] > least]
    plain = keyed.withColumns({"salt": F.lit(0), "follows": F.lit(True)})
    if not full:
        return plain
    counts = keyed.where(group.isin(full)).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("v", "f", *DESCRIPTOR)).alias("first")).where(F.col("n") > least)
    hot = staged(spark, counts.withColumn("salts", F.ceil(F.col("n") / F.lit(least)).cast("int")))
    salted = keyed.join(F.broadcast(hot.select("key", "salts")), "key", "left").withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).cast("int"))
    firsts = hot.select("key", "first.*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("follows"))
    return salted.drop("salts").withColumn("follows", F.lit(True)).unionByName(firsts)


MATCHES = "a long, af int, b long, bf int"


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("v", "f"))
    return v, f, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in DESCRIPTOR], axis=1)


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits that differ, row by row."""
    return np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int32)


def _matched(v: np.ndarray, f: np.ndarray, w: np.ndarray, g: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """Matches with the smaller image first."""
    turn = v > w
    sides = [np.where(turn, w, v), np.where(turn, g, f), np.where(turn, v, w), np.where(turn, f, g), kind]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(sides, (np.int64, np.int32, np.int64, np.int32, np.int8), strict=True)], names=["a", "af", "b", "bf", "kind"])


#: Kinds of rows that the stream gives: large keys, their matches with the first feature, those of smaller keys, and all others of these.
LARGE, STAR, SMALL_STAR, SMALL = range(4)


def _streamed(dealt: DataFrame, hamming: int, window: int) -> DataFrame:
    """Matches among the features of keys up to `window`, and of larger keys with their first; these as rows with a the key, b the first image."""

    def matched(v: np.ndarray, f: np.ndarray, d: np.ndarray, start: np.ndarray, small: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of whole runs that are `small` with all before them, other rows with their run's first one (at `start`)."""
        place = np.arange(len(v)) - start
        near = np.flatnonzero(small)
        for lag in range(1, window):
            near = near[place[near] >= lag]
            if not len(near):
                break
            i = near[v[near] != v[near - lag]]
            i = i[_apart(d[i], d[i - lag]) <= hamming]
            if len(i):
                yield _matched(v[i], f[i], v[i - lag], f[i - lag], np.where(place[i] == lag, SMALL_STAR, SMALL))
        far = np.flatnonzero(~small & (v != v[start]))
        far = far[_apart(d[far], d[start[far]]) <= hamming]
        if len(far):
            yield _matched(v[far], f[far], v[start[far]], f[start[far]], np.full(len(far), STAR))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the run that is open: all while it is small, then the first one
        large = False  # whether the open run has more rows than the window
        for batch in batches:
            if not batch.num_rows:
                continue
            v, f, d = _arrays(batch)
            run_of = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "salt", "follows")], axis=1)
            if held is not None:
                v, f, d, run_of = (np.concatenate(x) for x in zip(held, (v, f, d, run_of), strict=True))
            start = np.flatnonzero(np.append(True, (run_of[1:, :2] != run_of[:-1, :2]).any(axis=1)))
            size = np.diff(np.append(start, len(v)))
            # a key that is dealt over several salts is large, however few of its rows a salt has
            over = (size > window) | (run_of[start, 2] == 0)
            over[0] |= large
            told = large
            # the last run stays open, but for rows of a large one
            open_ = start[-1]
            done = len(v) if over[-1] else open_
            if done:
                whole = np.repeat(start, size)[:done]
                yield from matched(v[:done], f[:done], d[:done], whole, ~np.repeat(over, size)[:done])
            at = start[over][1:] if told else start[over]
            if len(at):
                none = pa.array(np.full(len(at), -1, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(run_of[at, 0]), none, pa.array(v[at]), none, pa.array(np.full(len(at), LARGE, dtype=np.int8))], names=["a", "af", "b", "bf", "kind"])
            large = bool(over[-1])
            keep = slice(open_, open_ + 1 if large else None)
            held = (v[keep], f[keep], d[keep], run_of[keep])
        if held is not None and not large:
            yield from matched(*held[:3], np.zeros(len(held[0]), dtype=np.int64), np.ones(len(held[0]), dtype=bool))

    # every feature of a key and salt in one task, the key's first feature first
    return dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "follows", "v", "f").mapInArrow(run, f"{MATCHES}, kind byte")


#: An image's large key as a number: how many features the key has (so rare ones are smaller), the key, and in the last two bits the most features that one image has there, less one.
def _token(n: str, key: str, most: str) -> F.Column:
    return F.shiftleft(F.least(F.col(n), F.lit((1 << 26) - 1)), 37) + F.shiftleft(F.col(key), 2) + F.least(F.col(most), F.lit(4)) - 1


def _reach(tokens: F.Column, votes: int) -> F.Column:
    """The most votes that these large keys can give two images that share them."""
    return F.aggregate(tokens, F.lit(0), lambda n, x: n + F.when(x.bitwiseAND(F.lit(3)) == 3, max(4, votes)).otherwise(x.bitwiseAND(F.lit(3)).cast("int") + 1))


def _crowded(spark: SparkSession, keyed: DataFrame, large: DataFrame, votes: int) -> tuple[DataFrame, DataFrame]:
    """(key, v, f, d0..d3, first, tail) of large keys, and (v, tokens): an image's large keys, rarest first; first is the key's first image, tail are the image's keys from the row's own on, with features.

    The rarest large key that two images share has all others in both tails, so
    rows whose tail cannot give enough votes are not needed."""
    rows = staged(spark, keyed.join(large.select("key", F.col("v").alias("first")), "key"))
    counted = rows.groupBy("key", "v").agg(F.count(F.lit(1)).alias("c"), F.first("first").alias("first"), F.collect_list("f").alias("fs"))
    # the rows of a key, one an image, meet its size again without the descriptors
    sized = counted.groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("most")).select("key", _token("n", "key", "most").alias("token"))
    held = counted.join(sized, "key").groupBy("v").agg(F.array_sort(F.flatten(F.collect_list(F.transform("fs", lambda f: F.struct(F.col("token"), f.alias("f")))))).alias("all"))
    held = staged(spark, held)
    tokens = held.select("v", F.array_distinct("all.token").alias("tokens"), "all")
    able = tokens.where(_reach(F.col("tokens"), votes) >= votes).select("v", "all")
    # a row finds its own token in its image's list: bits 2 to 36 are the key
    own = F.filter("all", lambda x: F.shiftrightunsigned(x["token"], 2).bitwiseAND(F.lit((1 << 35) - 1)) == F.col("key"))[0]["token"]
    tailed = rows.join(able, "v").withColumn("token", own).select("key", "v", "f", *DESCRIPTOR, "first", F.filter("all", lambda x: x["token"] >= F.col("token")).alias("tail"))
    return tailed.where(_reach(F.array_distinct("tail.token"), votes) >= votes), tokens.drop("all")


def _shared(tokens: np.ndarray, features: np.ndarray, starts: np.ndarray, i: np.ndarray, j: np.ndarray, votes: int) -> np.ndarray:
    """Whether row i's list holds at least `votes` features under keys that row j's holds, too (row k's is at starts[k] : starts[k + 1])."""

    def flat(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = starts[rows + 1] - starts[rows]
        pair = np.repeat(np.arange(len(rows)), size)
        return pair, np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[rows], size)

    (pair, mine), (other, theirs) = flat(i), flat(j)
    named = lambda p, at: K.mix64(tokens[at].view(np.uint64) ^ K.mix64(p.astype(np.uint64)))
    both = np.isin(named(pair, mine), named(other, theirs))
    once = np.unique(pair[both] << 32 | features[mine[both]])
    return np.bincount(once >> 32, minlength=len(i)) >= votes


def _blocks(members: DataFrame, hamming: int, votes: int, block: int) -> DataFrame:
    """Pairs (a, b) of images with a match between a key's rest (images in another component than the first one's) and its features in other components, and enough large keys from this one on in common.

    Rest and members are cut into blocks by hash; each pair of blocks is a task's work."""
    totals = members.groupBy("key").agg(F.count(F.lit(1)).alias("cm"), F.sum(F.col("rest").cast("long")).alias("cx")).where("cx > 0")
    parts = lambda c: F.greatest(F.ceil(F.col(c) / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("v", "f"), F.lit(1 << 20)).cast("int")
    cut = members.join(totals.select("key", parts("cm").alias("pm"), parts("cx").alias("px")), "key")
    plain = cut.withColumns({"side": F.lit(0), "mi": F.pmod(own, F.col("pm")), "xi": F.explode(F.sequence(F.lit(0), F.col("px") - 1))})
    asked = cut.where("rest").withColumns({"side": F.lit(1), "xi": F.pmod(own, F.col("px")), "mi": F.explode(F.sequence(F.lit(0), F.col("pm") - 1))})
    names = ["key", "mi", "xi", "side", "v", "f", "comp", *DESCRIPTOR, "tail"]
    both = plain.select(*names).unionByName(asked.select(*names)).repartition("key", "mi", "xi").sortWithinPartitions("key", "mi", "xi", "side")

    def compared(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        v, f, d = _arrays(group)
        side, comp = (group.column(c).to_numpy(zero_copy_only=False) for c in ("side", "comp"))
        tail = group.column("tail")
        tokens, features = (tail.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("token", "f"))
        starts = np.append(0, np.cumsum(pa.compute.list_value_length(tail).to_numpy(zero_copy_only=False)))
        there = np.flatnonzero(side == 0)
        found = np.empty((0, 2), dtype=np.int64)
        for x in np.array_split(np.flatnonzero(side == 1), max(1, len(there) // 256)):
            if not len(x) or not len(there):
                continue
            i, j = np.nonzero((comp[x][:, None] != comp[there][None]) & (_apart(d[x][:, None], d[there][None]) <= hamming))
            # votes are counted by the features of the smaller image
            turn = v[x[i]] > v[there[j]]
            i, j = np.where(turn, there[j], x[i]), np.where(turn, x[i], there[j])
            for part in np.array_split(np.arange(len(i)), 1 + (starts[i + 1] - starts[i] + starts[j + 1] - starts[j]).sum() // AT_ONCE):
                good = part[_shared(tokens, features, starts, i[part], j[part], votes)]
                if len(good):
                    found = np.unique(np.concatenate([found, np.stack([v[i[good]], v[j[good]]], axis=1)]), axis=0)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "mi", "xi")], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and tuple(place[lo]) != at:
                    yield from compared(held)
                    held = []
                at = tuple(place[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from compared(held)

    return both.mapInArrow(run, "a long, b long").distinct()


def _agree(row: np.ndarray, p: list[np.ndarray], q: list[np.ndarray], rows: int, votes: int) -> np.ndarray:
    """Which of `rows` pairs have enough matches, at different spots, on one similarity; p and q are x, y, scale and angle of each match's ends, row its pair."""
    (px, py, ps, pt), (qx, qy, qs, qt) = p, q
    # the similarity that maps a onto b: turn, log2 of the scale, shift
    turn, zoom = qt - pt, ps / qs
    dx = qx - zoom * (np.cos(turn) * px - np.sin(turn) * py)
    dy = qy - zoom * (np.sin(turn) * px + np.cos(turn) * py)
    part = np.mod(turn, 2 * np.pi) / (np.pi / 6)
    spot = K.mix64(px.view(np.uint64) + K.mix64(py.view(np.uint64)))
    good = np.zeros(rows, dtype=bool)
    # two overlapping grids, so that a group of votes is whole in one of them
    for half in (0.0, 0.5):
        cell = K.mix64(row.astype(np.uint64))
        for c in (np.floor(part + half) % 12, np.floor(np.log2(zoom) * 2 + 0.5), np.floor(dx / 16 + half), np.floor(dy / 16 + half)):
            cell = K.mix64(cell + c.astype(np.int64).view(np.uint64))
        _, one = np.unique(K.mix64(cell) ^ spot, return_index=True)
        _, at_cell, count = np.unique(cell[one], return_index=True, return_counts=True)
        good[row[one[at_cell[count >= votes]]]] = True
    return good


PLACE = ("x", "y", "scale", "angle")


def _agreeing(matches: DataFrame, places: DataFrame, votes: int) -> DataFrame:
    """Links (a, b) of images: enough matches, at different spots, that agree on one similarity."""
    likely = matches.groupBy("a", "b").agg(F.collect_set(F.struct("af", "bf")).alias("m")).where(F.size("m") >= votes)
    sided = likely.join(places.select(F.col("v").alias("a"), F.col("at").alias("_a")), "a").join(places.select(F.col("v").alias("b"), F.col("at").alias("_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column("m")
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(m).to_numpy(zero_copy_only=False))
            sides = []
            for at, number in (("_a", "af"), ("_b", "bf")):
                lists = batch.column(at)
                starts = np.append(0, np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)))
                which = starts[row] + m.flatten().field(number).to_numpy(zero_copy_only=False)
                sides.append([lists.flatten().field(c).to_numpy(zero_copy_only=False)[which].astype(np.float64) for c in PLACE])
            keep = pa.array(_agree(row, *sides, batch.num_rows, votes))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return sided.mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, features: DataFrame, hamming: int, votes: int) -> DataFrame:
    """The pairs (a, b) of images that are linked, by all their features: matches share a band."""
    sided = pairs.join(features.select(F.col("v").alias("a"), F.col("corners").alias("_a")), "a").join(features.select(F.col("v").alias("b"), F.col("corners").alias("_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends, starts, bits = [], [], []
            for side in ("_a", "_b"):
                flat = batch.column(side).flatten()
                ends.append([flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in PLACE])
                bits.append(np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in DESCRIPTOR], axis=1))
                starts.append(np.append(0, np.cumsum(pa.compute.list_value_length(batch.column(side)).to_numpy(zero_copy_only=False))))
            good = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                mine, theirs = (slice(s[k], s[k + 1]) for s in starts)
                other = bits[1][theirs]
                i, j = [], []
                for at in range(mine.start, mine.stop, step := max(1, AT_ONCE // (8 * len(other) + 1))):
                    own = bits[0][at : min(at + step, mine.stop)]
                    differ = own[:, None] ^ other[None]
                    near = np.bitwise_count(differ).sum(axis=-1, dtype=np.int32) <= hamming
                    x, y = np.nonzero(near & (differ.view(np.uint32) == 0).any(axis=-1))
                    i.append(x + at)
                    j.append(y + theirs.start)
                x, y = np.concatenate(i), np.concatenate(j)
                if len(x) >= votes:
                    good[k] = _agree(np.zeros(len(x), dtype=np.int64), [c[x] for c in ends[0]], [c[y] for c in ends[1]], 1, votes)[0]
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return sided.mapInArrow(run, "a long, b long")


def copies(images: DataFrame, id_col: str = "id", image_col: str = "image", hamming: int = HAMMING, votes: int = VOTES, window: int = WINDOW, block: int = BLOCK, hot_rows: int = HOT_ROWS, hot_share: float = HOT_SHARE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, class_id, n_links, n_corners) and the columns `keep` for each row of `images`.

    class_id is the smallest id of the images that links, or equal bytes, reach;
    n_links counts the links found to other classes of equal images (of a group of
    copies those that were needed to connect it).  Null, empty or
    unreadable images, images without corners, and rows with a null id have no
    links (a null id keeps a null class).  Repeated rows share a class, and rows
    with the same id and different images have all their images' links.  An image
    of any size is read whole.  An empty table gives an empty result; other
    columns are not looked at.
    """
    spark = images.sparkSession
    small_batches(spark)
    held = [f"keep {i}" for i in range(len(keep))]
    rows = images.select(F.col(id_col).cast("long").alias("id"), F.sha2(F.col(image_col), 256).alias("same"), *[F.col(c).alias(h) for c, h in zip(keep, held, strict=True)], F.col(image_col).alias("image"))
    # an image is named by the number of one of its rows; images themselves are read once and never shuffled
    described = staged(spark, _described(rows, "image", ["id", "same", *held]).withColumn("row", F.monotonically_increasing_id()))
    classes = staged(spark, described.where("id is not null and size(corners) > 0").groupBy("same").agg(F.min("row").alias("v")))
    features = described.join(few(classes)(classes.select(F.col("v").alias("row"))), "row", "left_semi").withColumnRenamed("row", "v")
    places = features.select("v", F.transform("corners", lambda c: F.struct(*[c[k].alias(k) for k in PLACE])).alias("at"))
    keyed = _keyed(features)
    found = staged(spark, _streamed(_dealt(spark, keyed, hot_rows, hot_share), hamming, window))
    links = staged(spark, _agreeing(found.where(F.col("kind").isin(STAR, SMALL_STAR)), places, votes))
    labels = components(spark, links)
    # from here on only images that are still apart count
    ends = labels.select(F.col("v").alias("a"), F.col("comp").alias("_a")), labels.select(F.col("v").alias("b"), F.col("comp").alias("_b"))
    before = found.where(F.col("kind").isin(SMALL_STAR, SMALL)).join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b"))
    known = staged(spark, before.groupBy("a", "b").agg(F.size(F.collect_set("af")).alias("m")))
    asked = known.where(F.col("m") >= votes).select("a", "b")
    large = staged(spark, found.where(F.col("kind") == LARGE).groupBy(F.col("a").alias("key")).agg(F.min("b").alias("v")))
    if not large.isEmpty():
        placed = lambda df: df.join(labels, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
        crowded, tokens = _crowded(spark, keyed, large, votes)
        mains = labels.select(F.col("v").alias("first"), F.col("comp").alias("main"))
        members = staged(spark, placed(crowded).join(mains, "first", "left").withColumn("rest", F.col("comp") != F.coalesce("main", "first")).drop("main", "first"))
        # matches of smaller keys that need those of large ones
        of = lambda v: tokens.select(F.col("v").alias(v), F.col("tokens").alias(f"_{v}"))
        mixed = known.where(F.col("m") < votes).join(of("a"), "a").where(_reach(F.col("_a"), votes) + F.col("m") >= votes).join(of("b"), "b")
        mixed = mixed.where(_reach(F.array_intersect("_a", "_b"), votes) + F.col("m") >= votes).select("a", "b")
        asked = asked.union(mixed).union(_blocks(members, hamming, votes, block)).distinct()
    more = staged(spark, _compared(asked, features, hamming, votes))
    if not more.isEmpty():
        links = staged(spark, links.unionByName(more).distinct())
        labels = components(spark, links)
    counts = links.select(F.col("a").alias("v")).union(links.select("b")).groupBy("v").agg(F.count(F.lit(1)).alias("n_links"))
    classed = classes.join(labels, "v", "left").join(counts, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    of_row = described.select("id", "same", *held, F.size("corners").alias("n_corners")).join(classed.select("same", "comp", "n_links"), "same", "left")
    # rows of one id belong together whatever their images
    twice = of_row.where("id is not null and comp is not null").select("id", "comp").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("a")).where("n > 1")
    pairs = staged(spark, of_row.join(twice.select("id", "a"), "id").where("comp <> a").select("a", F.col("comp").alias("b")).distinct())
    if not pairs.isEmpty():
        joined = components(spark, pairs).select(F.col("v").alias("comp"), F.col("comp").alias("to"))
        of_row = of_row.join(joined, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to")
    smallest = of_row.where("id is not null and comp is not null").groupBy("comp").agg(F.min("id").alias("class_id"))
    out = of_row.join(smallest, "comp", "left")
    return out.select(*[F.col(f"`{h}`").alias(c) for c, h in zip(keep, held, strict=True)], "id", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"), zero("n_links").alias("n_links"), zero("n_corners").alias("n_corners"))


#: Edits that `pictures` makes of some images.
EDITS = ("crop", "turn", "light", "patch", "noise", "smaller")


def edited(image: np.ndarray, kind: str, seed: int) -> np.ndarray:
    """A copy that is cropped, turned by 90 degrees, lighter, partly covered, noisy or smaller."""
    rng = np.random.default_rng(seed)
    h, w = image.shape
    if kind == "crop":
        top, left = rng.integers(0, h // 4, 1)[0], rng.integers(0, w // 4, 1)[0]
        return image[top : top + h - h // 4, left : left + w - w // 4]
    if kind == "turn":
        return np.rot90(image, 1 + int(rng.integers(3)))
    if kind == "light":
        return image * 0.75 + 40
    if kind == "patch":
        top, left = rng.integers(0, h - h // 4, 1)[0], rng.integers(0, w - w // 4, 1)[0]
        out = image.copy()
        out[top : top + h // 4, left : left + w // 4] = 128
        return out
    if kind == "noise":
        return np.clip(image + rng.normal(0, 4, image.shape), 0, 255)
    return _resized(image, 0.8)


def pictures(vectors: DataFrame, id_col: str, vector_col: str, side: int = 96, every: int = 20) -> DataFrame:
    """(id, vec_id, edit, image): each vector drawn as a texture, a sum of waves of fixed directions and lengths whose heights are its components.

    Of each vector whose id is divisible by `every` there is an edited copy, too.
    id is twice the vec_id, plus one for a copy; edit is '' for the originals.
    Vectors without finite components have a null image and no copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[:side, :side].reshape(2, -1)
        waves: dict[int, np.ndarray] = {}
        for batch in batches:
            out: list[tuple] = []
            for i, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.array([c for c in vector or [] if c is not None and np.isfinite(c)])
                if not len(v):
                    out.append((None if i is None else 2 * i, i, "", None))
                    continue
                if len(v) not in waves:
                    rng = np.random.default_rng(11)
                    turn, length, phase = rng.uniform(0, np.pi, len(v)), rng.uniform(7, 28, len(v)), rng.uniform(0, 2 * np.pi, len(v))
                    waves[len(v)] = np.cos(2 * np.pi / length[:, None] * (np.cos(turn)[:, None] * x + np.sin(turn)[:, None] * y) + phase[:, None])
                field = (v @ waves[len(v)]).reshape(side, side)
                image = np.rint((field - field.min()) / ((field.max() - field.min()) or 1.0) * 255)
                out.append((None if i is None else 2 * i, i, "", write_pgm(image)))
                if i is not None and i % every == 0:
                    kind = EDITS[i // every % len(EDITS)]
                    out.append((2 * i + 1, i, kind, write_pgm(np.clip(np.rint(edited(image, kind, i)), 0, 255))))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["id", "vec_id", "edit", "image"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col)).mapInArrow(run, "id long, vec_id long, edit string, image binary")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's tables hold no images: the vectors of `embeddings` are drawn as 96 x 96 textures, every twentieth with an edited copy.

    (vec_id, edit, image_id, class_id, n_links, n_corners); an edited copy is
    found where class_id is that of its original."""
    small_batches(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # a vector is small, but its picture takes long to describe: tasks of few vectors
    dealt = vectors.repartition(ceil(vectors.count() / 500) + 7)
    images = pictures(dealt, "vec_id", "embedding")
    return copies(images, keep=("vec_id", "edit")).withColumnRenamed("id", "image_id")
