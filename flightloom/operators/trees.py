"""Boosted regression trees, grown for many groups and targets at once by aggregations.

Values become numbers of quantile bins once; that table is written.  A level of a
tree is then one pass: tasks follow the trees that there are, add up residuals by
(group, target, node, feature, bin) in numpy, Spark sums these cells and picks each
node's split, and only the splits come to the driver, as many as the model has
nodes.  Groups (aircraft types) and targets share every pass.

Missing values have a bin of their own, and each split says which side they go to.
A feature can be constrained to act in one direction: splits against it are
refused, and the middle of two children bounds all values below them.  With
validation rows each model stops on its own when its error has not fallen for some
trees, and keeps the trees up to its best one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Groups times targets that one call may train: their nodes are kept on the driver.
MOST_MODELS = 20_000
#: Cells that a task adds up before it sends them.
HELD_CELLS = 2_000_000
#: Trees after which the predictions so far are written, so that a pass follows few trees.
STAGE_TREES = 4
#: Rows that one record of the written table holds, and rows that numpy works on at once.
BLOCK_ROWS, PIECE_ROWS = 2_000, 16_384


@dataclass
class Level:
    """Arrays over (model, node): nodes are numbered as in a heap, a node without split keeps its rows."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, models: int, depth: int) -> Level:
        shape = (models, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, dtype=np.int32), np.zeros(shape, dtype=np.int32), np.zeros(shape, dtype=bool), np.zeros(shape))

    def nodes(self, model: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
        at, root, rows = np.zeros(len(model), dtype=np.int64), model * self.feature.shape[1], np.arange(len(model)) * bins.shape[1]
        flat, features, cuts, missing = bins.ravel(), self.feature.ravel(), self.cut.ravel(), self.missing_left.ravel()
        for _ in range(depth):
            node = root + at
            feature = features[node]
            b = flat[rows + np.maximum(feature, 0)]
            left = np.where(b == 0, missing[node], b <= cuts[node])
            at = np.where(feature < 0, at, 2 * at + 2 - left)
        return at


@dataclass
class Model:
    """What `boost` learns; `predict` applies it, `save` and `load` keep it."""

    features: list[str]
    targets: list[str]
    group: str | None
    groups: list[str]
    edges: np.ndarray
    base: np.ndarray
    depth: int
    trees: list[Level] = field(default_factory=list)
    best: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    gains: dict[tuple[str, str, str], float] = field(default_factory=dict)
    errors: list[tuple[str, str, int, int, float, float]] = field(default_factory=list)

    def importances(self, spark: SparkSession) -> DataFrame:
        """(group, target, feature, gain): gain 0 for features that no split uses."""
        rows = [(g, t, f, float(self.gains.get((g, t, f), 0.0))) for g in self.groups for t in self.targets for f in self.features]
        return spark.createDataFrame(rows, "group string, target string, feature string, gain double")

    def history(self, spark: SparkSession) -> DataFrame:
        """(group, target, trees, n, mae, rmse) on the validation rows, after each tree; 0 trees is the mean."""
        return spark.createDataFrame(self.errors, "group string, target string, trees int, n long, mae double, rmse double")

    def save(self, spark: SparkSession, path: str) -> None:
        plain = {k: getattr(self, k) for k in ("features", "targets", "group", "groups", "depth", "errors")}
        plain |= {"edges": self.edges.tolist(), "base": self.base.tolist(), "best": self.best.tolist(), "gains": [[*k, v] for k, v in self.gains.items()]}
        plain["trees"] = [{k: getattr(t, k).tolist() for k in ("feature", "cut", "missing_left", "value")} for t in self.trees]
        spark.createDataFrame([(json.dumps(plain),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        plain = json.loads(spark.read.text(path).first()[0])
        kinds = {"feature": np.int32, "cut": np.int32, "missing_left": bool, "value": float}
        trees = [Level(**{k: np.array(t[k], dtype=kind) for k, kind in kinds.items()}) for t in plain["trees"]]
        return cls(
            plain["features"], plain["targets"], plain["group"], plain["groups"], np.array(plain["edges"]), np.array(plain["base"]), plain["depth"], trees,
            np.array(plain["best"], dtype=np.int64), {tuple(g[:3]): g[3] for g in plain["gains"]}, [tuple(e) for e in plain["errors"]],
        )


def _group(group: str | None) -> Column:
    return F.col(group).cast("string") if group else F.lit("")


def _doubles(columns: list[str]) -> list[Column]:
    """NaN and infinite values are missing, too."""
    out = []
    for c in columns:
        x = F.col(c).cast("double")
        out.append(F.when(F.abs(x) < float("inf"), x))
    return out


def _binned(values: np.ndarray, code: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin numbers from 1, 0 for missing ones; edges by (group, feature)."""
    out = np.zeros(values.shape, dtype=np.uint8)
    for g in np.unique(code):
        rows = code == g
        for f in range(values.shape[1]):
            x = values[rows, f]
            out[rows, f] = np.where(np.isnan(x), 0, np.searchsorted(edges[g, f], x, side="left") + 1)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of lists of `width` doubles, NULLs as NaN."""
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), width)


def _codes(column: pa.Array, number: dict[str, int]) -> np.ndarray:
    """Numbers of the groups of an Arrow column of strings, -1 for others."""
    named = column.dictionary_encode()
    numbers = np.array([*(number.get(g, -1) for g in named.dictionary.to_pylist()), -1], dtype=np.int64)
    return numbers[named.indices.fill_null(len(numbers) - 1).to_numpy(zero_copy_only=False)]


def _blocks(code: np.ndarray, bins: np.ndarray, y: np.ndarray, margins: np.ndarray, use: np.ndarray) -> pa.RecordBatch:
    """Rows as records of BLOCK_ROWS each, so that Spark reads few records and numpy takes their bytes as they are."""
    columns = {"code": code.astype(np.int32), "bins": bins, "y": y, "margins": margins, "use": use.astype(np.uint8)}
    starts = range(0, len(code), BLOCK_ROWS)
    return pa.record_batch([pa.array([v[k : k + BLOCK_ROWS].tobytes() for k in starts], pa.binary()) for v in columns.values()], names=list(columns))


def _pieces(batch: pa.RecordBatch, n_features: int, n_targets: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(code, bins, y, margins, use) of at most PIECE_ROWS rows each."""

    def flat(name: str, kind: type, width: int | None = None) -> np.ndarray:
        column = batch.column(name).cast(pa.binary())
        at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        count = int(at[-1] - at[0]) // np.dtype(kind).itemsize
        out = np.frombuffer(column.buffers()[2], dtype=kind, count=count, offset=int(at[0])) if count else np.zeros(0, dtype=kind)
        return out.reshape(-1, width) if width else out

    code, x, y, margins, use = flat("code", np.int32), flat("bins", np.uint8, n_features), flat("y", float, n_targets), flat("margins", float, n_targets), flat("use", np.uint8)
    for k in range(0, len(code), PIECE_ROWS):
        rows = slice(k, k + PIECE_ROWS)
        yield code[rows].astype(np.int64), x[rows], y[rows], margins[rows].copy(), use[rows]


def _margins(trees: list[Level], best: np.ndarray, first: int, code: np.ndarray, bins: np.ndarray, margins: np.ndarray, depth: int) -> np.ndarray:
    """Adds the trees from number `first` on; a model ends at its best tree."""
    n_targets = margins.shape[1]
    for k, tree in enumerate(trees):
        for t in range(n_targets):
            model = code * n_targets + t
            add = tree.value[model, tree.nodes(model, bins, depth)]
            margins[:, t] += np.where(first + k < best[model], add, 0.0)
    return margins


def boost(
    df: DataFrame, features: list[str], targets: list[str], group: str | None = None, train: Column | None = None, validation: Column | None = None,
    trees: int = 100, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 20, penalty: float = 1.0, monotone: dict[str, int] | None = None,
    patience: int = 50, columns: float = 1.0, rows: float = 1.0, seed: int = 42,
) -> Model:
    """Trains a model of every target, for each value of `group` (or one for the table), on the rows of `train` (all by default).

    Squared error.  Rows whose target is NULL do not count for it.  With
    `validation` a model stops when its mean absolute error there has not fallen
    for `patience` trees.  monotone: feature to 1 or -1.  columns and rows are the
    shares of features and rows that each tree sees (rows by a hash of their bins).
    Groups with no training row have no model, a constant feature is never used."""
    if not 2 <= bins <= 254:
        raise ValueError("bins from 2 to 254")
    use = F.coalesce(train, F.lit(False)) if train is not None else F.lit(True)
    check = F.coalesce(validation, F.lit(False)) if validation is not None else F.lit(False)
    picked = df.select(_group(group).alias("g"), F.array(*_doubles(features)).alias("x"), F.array(*_doubles(targets)).alias("y"), F.when(check, 2).when(use, 1).otherwise(0).alias("use")).where("use > 0 and g is not null")
    cuts = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    stats = picked.where("use = 1").groupBy("g").agg(
        F.array(*[F.percentile_approx(F.col("x")[f], cuts, 20 * bins) for f in range(len(features))]).alias("edges"), F.array(*[F.avg(F.col("y")[t]) for t in range(len(targets))]).alias("base")
    )
    found = sorted(stats.limit(MOST_MODELS // len(targets) + 1).collect(), key=lambda r: r.g)
    if len(found) * len(targets) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models: train them in several calls")
    n_features, n_targets, names = len(features), len(targets), [r.g for r in found]
    edges = np.full((len(names), n_features, bins - 1), np.inf)
    base = np.zeros((len(names), n_targets))
    for k, r in enumerate(found):
        for f, e in enumerate(r.edges):
            own = sorted(set(e or []))
            edges[k, f, : len(own)] = own
        base[k] = [0.0 if b is None else b for b in r.base]
    model = Model(features, targets, group, names, edges, base, depth)
    n_models = len(names) * n_targets
    model.best = np.full(n_models, trees, dtype=np.int64)
    if not names:
        model.best[:] = 0
        return model

    number = {g: k for k, g in enumerate(names)}

    def to_bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = _codes(b.column("g"), number)
            kept = code >= 0
            if not kept.any():
                continue
            b, code = b.filter(pa.array(kept)), code[kept]
            x = _binned(_matrix(b.column("x"), n_features), code, edges)
            yield _blocks(code, x, _matrix(b.column("y"), n_targets), base[code], b.column("use").to_numpy(zero_copy_only=False))

    table = staged(picked.mapInArrow(to_bins, "code binary, bins binary, y binary, margins binary, use binary"))
    rng = np.random.default_rng(seed)
    direction = np.array([(monotone or {}).get(f, 0) for f in features], dtype=np.int64)
    low, high = np.full((n_models, 2 ** (depth + 1) - 1), -np.inf), np.full((n_models, 2 ** (depth + 1) - 1), np.inf)
    best_error, since, running = np.full(n_models, np.inf), np.zeros(n_models, dtype=np.int64), np.ones(n_models, dtype=bool)
    stop_at = np.full(n_models, trees, dtype=np.int64)
    written = 0

    def cells(done: list[Level], first: int, tree: Level | None, level: int, open_: np.ndarray, seen: np.ndarray, salt: int):
        """Sums of residuals of the nodes of a level; at the root also the errors on validation rows, as feature -1."""
        forever = np.full(n_models, trees + 1)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            width, start = bins + 1, 2**level - 1
            n_slots = n_models * 2**level
            dense = n_slots * len(seen) * width <= HELD_CELLS
            held = np.zeros((2, n_slots * len(seen) * width)) if dense else None
            errors = np.zeros((3, n_models))

            def sent(slots: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
                """sums: (2, slots, features, bins), flat."""
                hit = np.flatnonzero(sums[0])
                slot, rest = np.divmod(hit, len(seen) * width)
                feature, b = np.divmod(rest, width)
                return pa.record_batch(
                    [pa.array((slots[slot] // 2**level).astype(np.int32)), pa.array((slots[slot] % 2**level + start).astype(np.int32)), pa.array(seen[feature].astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums[0][hit]), pa.array(sums[1][hit]), pa.array(np.zeros(len(hit)))],
                    names=["model", "node", "feature", "bin", "n", "g", "e"],
                )

            for code, x, y, margins, kind in (piece for batch in batches for piece in _pieces(batch, n_features, n_targets)):
                margins = _margins(done, forever, first, code, x, margins, depth)
                if rows < 1:
                    mix = (x.astype(np.uint64) + 1) @ (np.arange(1, n_features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(salt))
                    drawn = (mix * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(float) / 2.0**24 < rows
                else:
                    drawn = np.ones(len(code), dtype=bool)
                for t in range(n_targets):
                    model_of = code * n_targets + t
                    off = y[:, t] - margins[:, t]
                    known = ~np.isnan(off)
                    if level == 0:
                        v = known & (kind == 2)
                        for k, w in enumerate((np.ones(len(off)), np.abs(off), off * off)):
                            errors[k] += np.bincount(model_of[v], weights=w[v], minlength=n_models)
                    at = tree.nodes(model_of, x, level) if tree is not None else np.zeros(len(code), dtype=np.int64)
                    in_ = known & (kind == 1) & drawn & (at >= start) & open_[model_of]
                    if not in_.any():
                        continue
                    slot = model_of[in_] * 2**level + at[in_] - start
                    if dense:
                        slots, inverse = np.arange(n_slots), slot
                    else:
                        slots, inverse = np.unique(slot, return_inverse=True)
                    sums = np.zeros((2, len(slots), len(seen), width)) if not dense else held.reshape(2, n_slots, len(seen), width)
                    r = off[in_]
                    for k, f in enumerate(seen):
                        cell = inverse * width + x[in_, f]
                        sums[0, :, k] += np.bincount(cell, minlength=len(slots) * width).reshape(len(slots), width)
                        sums[1, :, k] += np.bincount(cell, weights=r, minlength=len(slots) * width).reshape(len(slots), width)
                    if not dense:
                        yield sent(slots, sums.reshape(2, -1))
            if dense:
                yield sent(np.arange(n_slots), held)
            if level == 0 and errors[0].any():
                n = np.flatnonzero(errors[0])
                fill = pa.array(np.zeros(len(n), dtype=np.int32))
                yield pa.record_batch([pa.array(n.astype(np.int32)), fill, pa.array(np.full(len(n), -1, dtype=np.int32)), fill, pa.array(errors[0][n]), pa.array(errors[1][n]), pa.array(errors[2][n])], names=["model", "node", "feature", "bin", "n", "g", "e"])

        return run

    shape = "model int, node int, feature int, bin int, n double, g double, e double"
    for k in range(trees + 1):
        tree = Level.empty(n_models, depth)
        low[:], high[:] = -np.inf, np.inf
        seen = np.sort(rng.choice(n_features, max(1, round(columns * n_features)), replace=False)) if columns < 1 else np.arange(n_features)
        salt = int(rng.integers(1, 2**31))
        for level in range(depth if k < trees else 1):
            made = table.mapInArrow(cells(model.trees[written:], written, tree if level else None, level, running & (k < trees), seen, salt), shape)
            # dealt out once for the sums and for the windows over them; tasks have added up their cells already
            sums = made.repartition("model", "node", "feature").groupBy("model", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("e").alias("e"))
            splits = _splits(sums, least, penalty, direction, low, high)
            splits = splits.where("feature < 0") if k == trees else splits
            for r in sorted(splits.collect(), key=lambda r: r.feature >= 0):
                if not running[r.model]:
                    continue
                if r.feature < 0:
                    mae = r.gl / r.nl
                    model.errors.append((names[r.model // n_targets], targets[r.model % n_targets], k, int(r.nl), mae, float(np.sqrt(r.gr / r.nl))))
                    since[r.model] = 0 if mae < best_error[r.model] else since[r.model] + 1
                    if mae < best_error[r.model]:
                        best_error[r.model], stop_at[r.model] = mae, k
                    running[r.model] = since[r.model] < patience
                    continue
                m, node = r.model, r.node
                tree.feature[m, node], tree.cut[m, node], tree.missing_left[m, node] = r.feature, r.bin, r.left
                vl, vr = (float(np.clip(g / (n + penalty), low[m, node], high[m, node])) for g, n in ((r.gl, r.nl), (r.gr, r.nr)))
                for child, v in ((2 * node + 1, vl), (2 * node + 2, vr)):
                    tree.value[m, child] = rate * v
                    low[m, child], high[m, child] = low[m, node], high[m, node]
                if direction[r.feature]:
                    middle = (vl + vr) / 2
                    up = direction[r.feature] > 0
                    (high if up else low)[m, 2 * node + 1] = middle
                    (low if up else high)[m, 2 * node + 2] = middle
                name = (names[m // n_targets], targets[m % n_targets], features[r.feature])
                model.gains[name] = model.gains.get(name, 0.0) + r.gain
            if (tree.feature[:, 2**level - 1 : 2 ** (level + 1) - 1] < 0).all():
                break
        if k == trees or not running.any() or (tree.feature[:, 0] < 0).all():
            break
        model.trees.append(tree)
        if len(model.trees) - written >= STAGE_TREES:
            since_then, first, forever = model.trees[written:], written, np.full(n_models, trees + 1)

            def further(batches: Iterable[pa.RecordBatch], done: list[Level] = since_then, first: int = first, forever: np.ndarray = forever) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for code, x, y, margins, use in _pieces(b, n_features, n_targets):
                        yield _blocks(code, x, y, _margins(done, forever, first, code, x, margins, depth), use)

            table = staged(table.mapInArrow(further, table.schema))
            written = len(model.trees)
    # a model with validation rows ends at its best tree, one without at the last
    model.best = np.where(np.isfinite(best_error), stop_at, len(model.trees))
    return model


def _splits(sums: DataFrame, least: int, penalty: float, direction: np.ndarray, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """The best split of each node: model, node, feature, bin (the last one on the left), left (missing values go left), sums of both sides and the gain.

    Rows of validation errors (feature -1) pass: nl, gl, gr are the number, the
    absolute and the squared errors."""
    spark = sums.sparkSession
    whole = Window.partitionBy("model", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    some, error = F.col("bin") > 0, F.col("feature") < 0
    # errors go through the same steps: a filter of their own would run the whole pass a second time
    cells = sums.select(
        "model", "node", "feature", "bin", "e", F.sum(F.when(some, F.col("n")).otherwise(0.0)).over(upto).alias("cn"), F.sum(F.when(some, F.col("g")).otherwise(0.0)).over(upto).alias("cg"),
        F.sum("n").over(whole).alias("tn"), F.sum("g").over(whole).alias("tg"), F.sum(F.when(~some, F.col("n")).otherwise(0.0)).over(whole).alias("mn"), F.sum(F.when(~some, F.col("g")).otherwise(0.0)).over(whole).alias("mg"),
    ).where(some | error)
    side = F.explode(F.when(error, F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("left")
    cut = cells.select("*", side).withColumns({"nl": F.col("cn") + F.when(F.col("left"), F.col("mn")).otherwise(0.0), "gl": F.col("cg") + F.when(F.col("left"), F.col("mg")).otherwise(0.0)})
    cut = cut.withColumns({"nr": F.col("tn") - F.col("nl"), "gr": F.when(error, F.col("e")).otherwise(F.col("tg") - F.col("gl"))}).where(error | (F.col("nl") >= least) & (F.col("nr") >= least))
    score = lambda g, n: g * g / (n + penalty)
    if direction.any():
        names = [int(f) for f in np.flatnonzero(direction)]
        sign = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for f in names for x in (f, int(direction[f]))]), F.col("feature")), F.lit(0))
        bounded = [(int(m), int(n), float(low[m, n]), float(high[m, n])) for m, n in zip(*np.nonzero(np.isfinite(low) | np.isfinite(high)), strict=True)]
        held = spark.createDataFrame(bounded, "model int, node int, low double, high double")
        cut = cut.join(F.broadcast(held), ["model", "node"], "left").fillna({"low": float("-inf"), "high": float("inf")})
        value = lambda g, n: F.greatest(F.col("low"), F.least(F.col("high"), g / (n + penalty)))
        # what a side is worth at a value that need not be its best one
        score = lambda g, n: 2 * g * value(g, n) - (n + penalty) * value(g, n) * value(g, n)
        cut = cut.where(error | (sign * (value(F.col("gr"), F.col("nr")) - value(F.col("gl"), F.col("nl"))) >= 0))
    gain = F.when(error, 0.0).otherwise(score(F.col("gl"), F.col("nl")) + score(F.col("gr"), F.col("nr")) - score(F.col("tg"), F.col("tn")))
    best = F.max(F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("left")).alias("right"), "nl", "gl", "nr", "gr")).alias("x")
    found = cut.groupBy("model", "node", error.alias("_error")).agg(best).where("_error or x.gain > 1e-9")
    return found.select("model", "node", (-F.col("x.f")).alias("feature"), (-F.col("x.b")).alias("bin"), (~F.col("x.right")).alias("left"), "x.nl", "x.gl", "x.nr", "x.gr", "x.gain")


def predict(df: DataFrame, model: Model, names: list[str] | None = None, needed: Column | None = None) -> DataFrame:
    """df with a column for each target (by default prediction_<target>); NULL for groups without a model, and where `needed` does not hold."""
    number = {g: k for k, g in enumerate(model.groups)}

    def guess(code: pa.Array, values: np.ndarray) -> np.ndarray:
        return _guesses(model, _codes(code, number), values)

    return _predicted(df, model, names, guess, needed=needed)


def predict_mean(df: DataFrame, model: Model, names: list[str] | None = None) -> DataFrame:
    """df with the mean of what the models of all groups say of each row, whatever its own group."""

    def guess(code: pa.Array, values: np.ndarray) -> np.ndarray:
        total = np.zeros((len(values), len(model.targets)))
        for k in range(len(model.groups)):
            total += _guesses(model, np.full(len(values), k, dtype=np.int64), values)
        return total / len(model.groups) if model.groups else np.full_like(total, np.nan)

    return _predicted(df, model, names, guess, own=False)


def partial_dependence(df: DataFrame, model: Model, feature: str, values: list[float], name: str = "step") -> DataFrame:
    """(name, prediction_<target>): the mean prediction of all rows, were `feature` each of the values (rows of groups without a model do not count).

    A prediction depends on bins alone, so rows are counted by the bins of their
    other features, and each kind of row is predicted once a value."""
    number, n_features, n_targets, at = {g: k for k, g in enumerate(model.groups)}, len(model.features), len(model.targets), model.features.index(feature)

    def to_kinds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = _codes(b.column("g"), number)
            kept = code >= 0
            if not kept.any():
                continue
            x = _binned(_matrix(b.filter(pa.array(kept)).column("x"), n_features), code[kept], model.edges)
            x[:, at] = 0
            kinds, n = np.unique(np.column_stack([code[kept], x]), axis=0, return_counts=True)
            yield pa.record_batch([pa.array(kinds[:, 0].astype(np.int32)), pa.array([k.astype(np.uint8).tobytes() for k in kinds[:, 1:]], pa.binary()), pa.array(n.astype(np.int64))], names=["code", "bins", "n"])

    def to_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, n = b.column("code").to_numpy(zero_copy_only=False).astype(np.int64), b.column("n").to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(b.column("bins").to_pylist()), dtype=np.uint8).reshape(len(code), n_features).copy()
            sums = np.zeros((len(values), n_targets))
            for k, v in enumerate(values):
                x[:, [at]] = _binned(np.full((len(code), 1), float(v)), code, model.edges[:, [at]])
                sums[k] = n @ _margins(model.trees, model.best, 0, code, x, model.base[code].copy(), model.depth)
            column = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), n_targets).cast(pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(np.full(len(values), n.sum(), dtype=np.int64)), column], names=["k", "n", "sums"])

    rows = df.select(_group(model.group).alias("g"), F.array(*_doubles(model.features)).alias("x"))
    kinds = rows.mapInArrow(to_kinds, "code int, bins binary, n long").groupBy("code", "bins").agg(F.sum("n").alias("n"))
    sums = kinds.mapInArrow(to_sums, "k int, n long, sums array<double>").groupBy("k").agg(*[(F.sum(F.col("sums")[t]) / F.sum("n")).alias(f"prediction_{c}") for t, c in enumerate(model.targets)])
    return sums.withColumn(name, F.array(*[F.lit(v) for v in values])[F.col("k")]).select(name, *[f"prediction_{c}" for c in model.targets])


def _guesses(model: Model, code: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Predictions of rows by the models of their groups, NaN for number -1."""
    out = np.full((len(code), len(model.targets)), np.nan)
    known = code >= 0
    if known.any():
        bins = _binned(values[known], code[known], model.edges)
        out[known] = _margins(model.trees, model.best, 0, code[known], bins, model.base[code[known]], model.depth)
    return out


def _predicted(df: DataFrame, model: Model, names: list[str] | None, guess: Callable[[pa.Array, np.ndarray], np.ndarray], own: bool = True, needed: Column | None = None) -> DataFrame:
    names = names or [f"prediction_{t}" for t in model.targets]
    n_features, n_targets, every = len(model.features), len(model.targets), needed is None

    @F.arrow_udf("array<double>")
    def guessed(group: pa.Array, x: pa.Array) -> pa.Array:
        if every:
            found = guess(group, _matrix(x, n_features))
        else:
            found = np.full((len(x), n_targets), np.nan)
            asked = pc.greater(pc.list_value_length(x), 0)
            found[asked.to_numpy(zero_copy_only=False)] = guess(group.filter(asked), _matrix(x.filter(asked), n_features))
        return pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), n_targets).cast(pa.list_(pa.float64()))

    values = F.array(*_doubles(model.features))
    if needed is not None:
        # not NULL: Spark writes long runs of NULL arrays for Python in quadratic time
        values = F.when(needed, values).otherwise(F.array().cast("array<double>"))
    made = df.withColumn("_guess", guessed(_group(model.group if own else None), values))
    return made.withColumns({n: F.nullif(F.col("_guess")[k], F.lit(float("nan"))) for k, n in enumerate(names)}).drop("_guess")
