"""Model plans: regression and forests by pyspark.ml, validated on spatial blocks."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators import agreement, graph


def vif(df: DataFrame, features: Sequence[str]) -> list[tuple[str, float]]:
    """Variance inflation of each feature from regressions on the others; the driver sees coefficients only."""
    out = []
    for name in features:
        rest = [x for x in features if x != name]
        rows = VectorAssembler(inputCols=rest, outputCol="x").transform(df.na.drop(subset=list(features)))
        r2 = LinearRegression(featuresCol="x", labelCol=name, solver="normal").fit(rows).summary.r2
        out.append((name, float("inf") if r2 >= 1 else 1 / (1 - r2)))
    return out


def forest(df: DataFrame, features: Sequence[str], target: str, trees: int, seed: int):
    """A fitted forest and its assembler; rows with a missing value are no part of the fit."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="keep")
    rows = assembler.transform(df.na.drop(subset=[*features, target]))
    return RandomForestRegressor(featuresCol="x", labelCol=target, numTrees=trees, maxDepth=5, seed=seed).fit(rows), assembler


def predicted(model, assembler, df: DataFrame, features: Sequence[str], name: str = "prediction") -> DataFrame:
    """``df`` with the forest's prediction, null where a feature is missing."""
    kept = df.withColumns({f"_{c}": F.col(c) for c in features})
    out = model.transform(assembler.transform(kept.na.fill(0.0, list(features))))
    known = F.lit(True)
    for c in features:
        known = known & F.col(f"_{c}").isNotNull()
    return out.select(*[F.col(f"_{c}").alias(c) if c in features else F.col(c) for c in df.columns], F.when(known, F.col("prediction")).alias(name))


#: Rows of a part that forests are fitted on, so that every core has its share.
FIT_ROWS = 100_000
#: Bins of a feature, levels of a tree and the share of features that a node tries, as in pyspark.ml's forests of :func:`forest`.
BINS, DEPTH, TRIED = 32, 5, 3
#: Values of a feature that are counted one by one; cells of a grid of bins, and sums (fits x trees x cells) of a task, up to which forests are fitted on sums.
VALUES, CELLS, SUMS = 10_000, 65_536, 8_000_000
#: Tasks that sum rows at most; each hands on all its sums, so that their shuffle is bounded.
SUM_TASKS = 256
#: Blocks that are broadcast at most; more are joined by a shuffle.
BLOCKS = 200_000


def _dealt(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` in equal parts and in a fixed order, with their number in ``_row``, so that every core has its share of a fit and reruns draw alike."""
    parts = rows.repartition(max(1, -(-rows.count() // FIT_ROWS)), *order)
    return parts.sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())


def _of_blocks(rows: DataFrame, blocks: DataFrame, block: str) -> DataFrame:
    """``rows`` with what ``blocks`` says of their block."""
    return rows.join(F.broadcast(blocks) if blocks.count() <= BLOCKS else blocks, block)


def _ends(rows: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Upper ends of each feature's bins but the last: midpoints between values, if they are many those nearest to equal shares of the rows."""
    known, out = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in features]).first(), []
    for c in features:
        if known[c] > VALUES:
            found = rows.agg(F.percentile_approx(c, [i / BINS for i in range(1, BINS)], VALUES)).first()[0]
        else:
            counts = rows.groupBy(F.col(c).cast("double").alias("v")).agg(F.count("*").alias("n")).orderBy("v").collect()
            middle = [a["v"] / 2 + b["v"] / 2 for a, b in zip(counts, counts[1:])]
            shares = np.cumsum([r["n"] for r in counts]) / max(1, sum(r["n"] for r in counts)) * BINS
            found = middle if len(counts) <= BINS else [middle[int(np.abs(shares[:-1] - i).argmin())] for i in range(1, BINS)]
        out.append(sorted({float(x) for x in found or [] if math.isfinite(x)}))
    return out


def _fits_on_sums(shape: Sequence[int], fits: int, trees: int) -> bool:
    return math.prod(shape) <= CELLS and math.prod(shape) * (fits + 1) * trees <= SUMS


def _cell(features: Sequence[str], ends: Sequence[Sequence[float]]) -> Column:
    """The number of a row's combination of bins, those of the last feature running fastest."""
    out = F.lit(0)
    for c, upper in zip(features, ends):
        out = out * (len(upper) + 1) + sum(((F.col(c) > x).cast("int") for x in upper), F.lit(0))
    return out


#: Poisson draws of mean 1 by the first 16 bits of a number; 255 where more bits decide.
_POISSON = np.cumsum([1 / math.e / math.factorial(k) for k in range(20)])
_LEAST = np.searchsorted(_POISSON, np.arange(65_536) / 65_536, side="right")
_DRAWN = np.where(_LEAST == np.searchsorted(_POISSON, np.arange(1, 65_537) / 65_536), _LEAST, 255).astype(np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each number's hash by the last steps of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bootstrap(row: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(tree, row): how often each tree's sample holds a row, Poisson of mean 1 by the row's number, whichever task reads it."""
    words = np.arange(1, -(-trees // 4) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    begun = _mixed(row.astype(np.uint64) + _mixed(np.array([seed & (2**64 - 1)], np.uint64)))
    short = _mixed(begun + words[:, None]).view(np.uint16)
    drawn = _DRAWN[short]
    word, at = np.nonzero(drawn == 255)
    more = _mixed(begun[at // 4] + ~words[word] + at.astype(np.uint64) % np.uint64(4)) / 2.0**64
    drawn[word, at] = np.searchsorted(_POISSON, (short[word, at] + more) / 65_536, side="right")
    return drawn.reshape(len(words), -1, 4).transpose(0, 2, 1).reshape(4 * len(words), -1)[:trees]


def _sums(held: Sequence[str], trees: int, cells: int, seed: int, target: str, centre: float) -> Callable:
    """Sums of the samples' weights and of weighted targets by fit, tree and cell, of a task's rows that a fit does not hold out: those of all rows less those held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first = np.zeros((len(held) + 1, trees, 2, cells)), None
        for b in batches:
            row, cell, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_row", "_cell", target))
            first = int(row[0]) if first is None and len(row) else first
            drawn, y = _bootstrap(row, trees, seed).astype(float), y - centre
            for fit, own in enumerate([*[b.column(c).to_numpy(zero_copy_only=False) for c in held], slice(None)]):
                w, c, v = drawn[:, own], cell[own], y[own]
                for tree in range(trees):
                    out[fit, tree, 0] += np.bincount(c, w[tree], cells)
                    out[fit, tree, 1] += np.bincount(c, w[tree] * v, cells)
        if first is None:
            return
        for fit in range(max(1, len(held))):
            n, s = np.moveaxis(out[-1] - out[fit] if held else out[-1], 1, 0)
            columns = [[fit] * trees, list(range(trees)), [first] * trees, [x.tobytes() for x in n], [x.tobytes() for x in s]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["fit", "tree", "first", "n", "s"])

    return run


def _tree(n: np.ndarray, s: np.ndarray, shape: Sequence[int], draw: np.random.Generator, tried: int) -> np.ndarray:
    """A regression tree's guess in every cell, from the cells' weights and weighted sums.

    A split's loss of variance needs no more than these sums, so this is the tree
    that the sample's rows themselves would give on the same bins.
    """
    bins, out, todo = np.indices(shape).reshape(len(shape), -1), np.zeros(len(n)), [(np.arange(len(n)), 0)]
    while todo:
        at, level = todo.pop()
        count, total = n[at].sum(), s[at].sum()
        out[at] = total / count if count else 0.0
        best, cut = 0.0, None
        for f in draw.choice(len(shape), tried, replace=False) if level < DEPTH else ():
            low, part = (np.bincount(bins[f, at], x[at], shape[f]).cumsum()[:-1] for x in (n, s))
            some = np.flatnonzero((low > 0) & (low < count))
            gain = part[some] ** 2 / low[some] + (total - part[some]) ** 2 / (count - low[some]) - total**2 / count if len(some) else np.zeros(1)
            if gain.max() > best:
                best, cut = gain.max(), (f, some[gain.argmax()])
        if cut:
            left = bins[cut[0], at] <= cut[1]
            todo += [(at[left], level + 1), (at[~left], level + 1)]
    return out


def _guesses(rows: DataFrame, shape: Sequence[int], held: Sequence[str], target: str, trees: int, seed: int) -> DataFrame:
    """(fit, cell, guess) of a forest for each column of ``held``, fitted on the rows it does not mark, or of one on all rows.

    Rows are read once for all fits and trees: their bootstrap weights are summed by
    cell, and each tree grows from its sums in a task of its own.
    """
    cells, centre = math.prod(shape), rows.agg(F.avg(target)).first()[0] or 0.0
    sums = rows.select("_row", "_cell", target, *held).coalesce(SUM_TASKS).mapInArrow(_sums(held, trees, cells, seed, target, centre), "fit int, tree int, first long, n binary, s binary")

    def grow(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("first")
        n, s = (sum(np.frombuffer(x) for x in t[c]) for c in ("n", "s"))
        guess = centre + _tree(n, s, shape, np.random.default_rng([seed, int(t["tree"].iloc[0])]), -(-len(shape) // TRIED) if trees > 1 else len(shape))
        return pd.DataFrame({"fit": t["fit"].iloc[0], "cell": np.arange(cells), "guess": guess})

    return sums.groupBy("fit", "tree").applyInPandas(grow, "fit int, cell int, guess double").groupBy("fit", "cell").agg(F.avg("guess").alias("guess"))


def _held_out_scores(rows: DataFrame, shape: Sequence[int] | None, features: Sequence[str], target: str, held: Sequence[str], trees: int, seed: int) -> DataFrame:
    """(fit, rmse, r2, n) of the rows that each column of ``held`` marks, by a forest fitted on the others; without ``shape`` by pyspark.ml on the rows."""
    if shape is None:
        out = None
        for fit, mark in enumerate(held):
            model, assembler = forest(rows.where(~F.col(mark)), features, target, trees, seed)
            one = agreement.fit_measures(predicted(model, assembler, rows.where(mark), features), target, "prediction").select(F.lit(fit).alias("fit"), "rmse", "r2", "n")
            out = one if out is None else out.unionByName(one)
        return out
    y = F.col(target).cast("double")
    cells = rows.groupBy(*held, F.col("_cell").alias("cell")).agg(F.count("*").alias("m"), F.avg(y).alias("mean"), F.var_pop(y).alias("spread"), F.min(y).alias("low"), F.max(y).alias("high"))
    cells = cells.withColumn("fit", F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(i)) for i, c in enumerate(held)]))))
    whole = Window.partitionBy("fit")
    cells = cells.join(_guesses(rows, shape, held, target, trees, seed), ["fit", "cell"])
    cells = cells.withColumn("middle", F.sum(F.col("m") * F.col("mean")).over(whole) / F.sum("m").over(whole))
    loss, total = (F.sum(F.col("m") * (F.col("spread") + (F.col("mean") - F.col(c)) * (F.col("mean") - F.col(c)))) for c in ("guess", "middle"))
    r2 = F.when(F.max("high") > F.min("low"), 1 - loss / total)
    return cells.groupBy("fit").agg(F.sqrt(loss / F.sum("m")).alias("rmse"), r2.alias("r2"), F.sum("m").alias("n"))


def _marked(rows: DataFrame, ends: Sequence[Sequence[float]], features: Sequence[str], target: str, held: Sequence[str], trees: int) -> tuple[DataFrame, list[int] | None]:
    """What fits read of ``rows``, stored, and the grid's shape: a row's cell where sums by cell fit a task, else its features."""
    shape = [len(x) + 1 for x in ends]
    if not _fits_on_sums(shape, max(1, len(held)), trees):
        return graph.written(rows.select(*features, target, *held)), None
    return graph.written(rows.select("_row", _cell(features, ends).alias("_cell"), F.col(target).cast("double").alias(target), *held)), shape


def split_strategies(df: DataFrame, features: Sequence[str], target: str, block: str, keys: Sequence[str], share: float, repeats: int, trees: int, seed: int) -> DataFrame:
    """(method, n_repeats, r2_mean, r2_least, r2_most, rmse_mean): held-out scores of splits by whole blocks and by rows, ``repeats`` of each."""
    rows = df.select(*dict.fromkeys([block, *keys, *features, target])).na.drop(subset=[*features, target])
    ends, blocks, held = _ends(rows, features), rows.groupBy(block).agg(F.count("*").alias("n")), []
    for turn in range(repeats):
        held.append(f"_held_{turn}")
        blocks = agreement.held_blocks(blocks, block, share, seed + turn).withColumnRenamed("held_out", held[-1])
    rows = _of_blocks(rows, blocks.drop("n"), block)
    for turn in range(repeats):
        held.append(f"_held_{repeats + turn}")
        code = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed + turn))))
        rows = rows.withColumn(held[-1], F.conv(F.substring(code, 1, 8), 16, 10).cast("double") < share * 2.0**32)
    stored, shape = _marked(_dealt(rows, [*keys, *features, target, block]), ends, features, target, held, trees)
    out = _held_out_scores(stored, shape, features, target, held, trees, seed).withColumn("method", F.when(F.col("fit") < repeats, "block").otherwise("row"))
    return out.groupBy("method").agg(F.count("*").alias("n_repeats"), F.avg("r2").alias("r2_mean"), F.min("r2").alias("r2_least"), F.max("r2").alias("r2_most"), F.avg("rmse").alias("rmse_mean"))


def _anew(mixes: Sequence[Sequence[np.ndarray]], seed: int, turn: int, i: int, bucket: int) -> np.ndarray:
    """The bins of feature ``i`` that a turn deals to the places of a bucket: a shuffle of those that fell into it."""
    n = mixes[turn][i][:, bucket]
    return np.random.default_rng([seed, turn, i, bucket]).permutation(np.repeat(np.arange(len(n), dtype=np.uint8), n))


def _losses(shape: Sequence[int], model: np.ndarray, mixes: Sequence[Sequence[np.ndarray]], first: np.ndarray, seed: int, target: str) -> Callable:
    """Squared errors of a task's rows by turn and feature dealt anew, and with turn -1 those of the rows as they are.

    A row's place is its part's first place and its number in the part.  Each bin has
    been dealt at random among buckets of places, and is shuffled in its bucket, which
    makes all orders of all rows' bins equally likely.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, steps = len(shape), [math.prod(shape[i + 1 :]) for i in range(len(shape))]
        begins = [[np.concatenate([[0], x.sum(axis=0).cumsum()]) for x in turn] for turn in mixes]
        shuffled = functools.lru_cache(2 * len(mixes) * features)(functools.partial(_anew, mixes, seed))
        sums, base = np.zeros((len(mixes), features)), 0.0
        for b in batches:
            row, cell, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_row", "_cell", target))
            place = first[row >> 33] + (row & (2**33 - 1))
            base += float(((y - model[cell]) ** 2).sum())
            for i in range(features):
                rest = cell - cell // steps[i] % shape[i] * steps[i]
                for turn in range(len(mixes)):
                    bucket, new = np.searchsorted(begins[turn][i], place, side="right") - 1, np.empty(len(place), np.int64)
                    for k in np.unique(bucket):
                        here = bucket == k
                        new[here] = shuffled(turn, i, int(k))[place[here] - begins[turn][i][k]]
                    sums[turn, i] += float(((y - model[rest + new * steps[i]]) ** 2).sum())
        turns, which = np.indices(sums.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *turns], pa.int32()), pa.array([0, *which], pa.int32()), pa.array([base, *sums.ravel()], pa.float64())], ["turn", "feature", "loss"])

    return run


def _dealt_losses(rows: DataFrame, shape: Sequence[int], target: str, trees: int, repeats: int, seed: int) -> list[list[float]]:
    """Losses of R2 by feature and turn, for a forest fitted on cells; rows are read in place and not shuffled."""
    model = np.zeros(math.prod(shape))
    for r in _guesses(rows, shape, [], target, trees, seed).select("cell", "guess").collect():
        model[r["cell"]] = r["guess"]
    cells, parts = np.zeros(len(model), np.int64), {r["part"]: r["m"] for r in rows.groupBy(F.shiftright("_row", 33).alias("part")).agg(F.count("*").alias("m")).collect()}
    for r in rows.groupBy("_cell").agg(F.count("*").alias("m")).collect():
        cells[r["_cell"]] = r["m"]
    sizes = np.array([parts.get(i, 0) for i in range(max(parts, default=-1) + 1)], np.int64)
    buckets, grid, mixes = max(1, -(-int(sizes.sum()) // FIT_ROWS)), cells.reshape(shape), []
    for turn in range(repeats):
        bins = [grid.sum(axis=tuple(j for j in range(len(shape)) if j != i)) for i in range(len(shape))]
        mixes.append([np.random.default_rng([seed, turn, i]).multinomial(n, [1 / buckets] * buckets) for i, n in enumerate(bins)])
    run = _losses(shape, model, mixes, sizes.cumsum() - sizes, seed, target)
    found = rows.select("_row", "_cell", target).mapInArrow(run, "turn int, feature int, loss double").groupBy("turn", "feature").agg(F.sum("loss").alias("loss"))
    loss, total = {(r["turn"], r["feature"]): r["loss"] for r in found.collect()}, rows.agg(F.var_pop(target) * F.count(target)).first()[0]
    return [[(loss[turn, i] - loss[-1, 0]) / total for turn in range(repeats)] for i in range(len(shape))]


def _joined_losses(rows: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], trees: int, repeats: int, seed: int) -> list[list[float]]:
    """Losses of R2 by feature and turn, for a forest fitted on rows.

    Dealing anew joins the rows in the order of one hash with a feature's values in the
    order of another by their row numbers, made in parts that are offset by their counts.
    A turn numbers its rows once for all features and scores them in one pass; only
    hashes and what is dealt are shuffled, the keys are not.
    """
    model, assembler = forest(rows, features, target, trees, seed)
    base = agreement.fit_measures(predicted(model, assembler, rows, features), target, "prediction").first()["r2"]
    losses: dict[str, list[float]] = {name: [] for name in features}

    def numbered(columns: Sequence[str], salt: str) -> DataFrame:
        code = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(salt)))
        t = rows.select(*columns, F.unhex(code).alias("_code")).withColumn("_part", F.substring("_code", 1, 1))
        ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = t.groupBy("_part").agg(F.count("*").alias("_m")).select("_part", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_first"))
        place = F.row_number().over(Window.partitionBy("_part").orderBy("_code"))
        return t.withColumn("_place", place).join(F.broadcast(parts), "_part").select((F.col("_first") + F.col("_place")).alias("_n"), *columns)

    for turn in range(repeats):
        t = numbered([*features, target], f"{seed}:{turn}:rows")
        for i, name in enumerate(features):
            t = t.join(numbered([name], f"{seed}:{turn}:values of {name}").withColumnRenamed(name, f"_new{i}"), "_n")
        for i, name in enumerate(features):
            anew = t.withColumns({f"_old{i}": F.col(name), name: F.col(f"_new{i}")})
            t = predicted(model, assembler, anew, features, f"_guess{i}").withColumn(name, F.col(f"_old{i}"))
        scores = t.agg(*[agreement.r_squared(F.col(target), F.col(f"_guess{i}")).alias(f"r{i}") for i in range(len(features))]).first()
        for i, name in enumerate(features):
            losses[name].append(base - scores[i])
    return [losses[name] for name in features]


def permutation_importance(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], trees: int, repeats: int, seed: int) -> DataFrame:
    """(predictor, importance, sd, rank): mean loss of R2 over ``repeats`` when a feature's values are dealt anew among the rows.

    A forest sees a value's bin only, so where it is fitted on cells the bins are dealt.
    """
    rows = df.select(*keys, *features, target).na.drop(subset=[*features, target])
    ends = _ends(rows, features)
    shape, rows = [len(x) + 1 for x in ends], _dealt(rows, [*keys, *features, target])
    if _fits_on_sums(shape, 1, trees):
        losses = _dealt_losses(_marked(rows, ends, features, target, [], trees)[0], shape, target, trees, repeats, seed)
    else:
        losses = _joined_losses(graph.written(rows.drop("_row")), features, target, keys, trees, repeats, seed)
    out = []
    for name, x in zip(features, losses):
        mean = sum(x) / repeats
        out.append((name, mean, (sum((v - mean) ** 2 for v in x) / repeats) ** 0.5))
    out.sort(key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame([(*x, i) for i, x in enumerate(out, 1)], "predictor string, importance double, sd double, rank int")


def forest_cv(df: DataFrame, features: Sequence[str], target: str, block: str, folds: int, trees: int, seed: int) -> DataFrame:
    """(fold, rmse, r2, n) of a random forest, each fold of whole blocks held out in turn."""
    rows = df.select(*dict.fromkeys([block, *features, target])).na.drop(subset=[*features, target])
    ends, blocks = _ends(rows, features), agreement.blocked_folds(rows.select(block).distinct(), block, folds, seed)
    held = [f"_held_{i}" for i in range(folds)]
    rows = _dealt(_of_blocks(rows, blocks, block).withColumns({c: F.col("fold") == i for i, c in enumerate(held, 1)}), [block, *features, target])
    stored, shape = _marked(rows, ends, features, target, held, trees)
    out = _held_out_scores(stored, shape, features, target, held, trees, seed).select((F.col("fit") + 1).alias("fold"), "rmse", "r2", "n")
    return df.sparkSession.createDataFrame(out.orderBy("fold").collect(), out.schema)
