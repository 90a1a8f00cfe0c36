"""Components of cell-by-feature values in long form: scores, imputation, weights of open features.

Rows stay spread over the cluster, for components as blocks of whole rows with about PACK
values each, for imputation as lists of (feature index, value). What every task is
given, and what comes back to the driver, is a matrix of features by a few components. Of a
table with more than WIDE features and fewer rows, the features stay spread instead,
and the matrix is one of rows by components; so the smaller
side decides. ``most_features`` can bound the features; more are an error then. No action is
lazy here: all functions but ``tf_idf`` run jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolith.operators.ordered import running
from cytolith.session import kept

#: Features above which the rows are made the columns, if they are fewer.
WIDE = 20_000
#: Values that a task multiplies at a time.
CHUNK = 1 << 18
#: Values of a block, and places of the smaller side whose sums move as one row.
PACK, SLICE = 1 << 19, 1 << 12


def tf_idf(values: DataFrame, row: str = "cell_no", column: str = "gene_no", scale: float = 1e5) -> DataFrame:
    """(row, column, value): log1p of the scaled share of its row, times log(1 + rows / rows with the feature).

    Every (row, column) of ``values`` is one open feature, whatever is counted there; repeats are one.
    """
    there = values.select(row, column).distinct()
    per_row = there.groupBy(row).agg(F.count(F.lit(1)).alias("__in_row"))
    per_column = there.groupBy(column).agg(F.count(F.lit(1)).alias("__in_column"))
    total = per_row.agg(F.count(F.lit(1)).alias("__rows"))
    weight = F.log1p(F.lit(scale) / F.col("__in_row")) * F.log1p(F.col("__rows") / F.col("__in_column"))
    # first by column, by which tables of counts are dealt already, then by row, by which the next step may average
    return there.join(per_column, column).join(per_row, row).join(F.broadcast(total)).select(row, column, weight.alias("value"))


def _averaged(values: DataFrame, row: str, column: str) -> DataFrame:
    """Nulls are left out, repeats averaged."""
    return values.where(F.col("value").isNotNull() & F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.avg("value").alias("value"))


def _totals(there: DataFrame, key: str, most: int | None = None) -> tuple[DataFrame, int]:
    """(key, n_rows, total) of every key, and how many there are."""
    found = kept(there.groupBy(key).agg(F.count("value").alias("n_rows"), F.sum("value").alias("total")))
    n = found.count()
    if most is not None and n > most:
        raise ValueError(f"{n} features, more than most_features = {most}")
    return found, n


def _numbered(totals: DataFrame, key: str) -> DataFrame:
    """``totals`` with idx, the place of a key in the order of keys, from 0."""
    return kept(running(totals.withColumn("__one", F.lit(1)), key, ["__one"]).select(*totals.columns, (F.col("sum___one") - 1).cast("int").alias("idx")))


def _lists(there: DataFrame, numbered: DataFrame, row: str, column: str) -> DataFrame:
    """Rows as (row, idx, val)."""
    joined = there.join(numbered.select(column, "idx"), column)
    return joined.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("at")).select(row, F.col("at.idx").alias("idx"), F.col("at.value").alias("val"))


def _chunks(frame) -> Iterator:
    """(first, last, idx, val, starts): stretches of rows with at most CHUNK values, or one row."""
    sizes = np.array([len(x) for x in frame["idx"]], np.int64)
    first = 0
    while first < len(sizes):
        last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), CHUNK, "right")))
        ends = np.cumsum(sizes[first:last])
        yield first, last, np.concatenate(frame["idx"].iloc[first:last].to_list()).astype(np.int64), np.concatenate(frame["val"].iloc[first:last].to_list()).astype(float), ends
        first = last


def _row_sums(products: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.vstack([np.zeros(products.shape[1]), np.cumsum(products, axis=0)])
    return sums[ends] - sums[np.concatenate([[0], ends[:-1]])]


def _project(idx, val, ends, left, right, basis) -> np.ndarray:
    """Rows of (sparse + left right') times the basis."""
    return _row_sums(val[:, None] * basis[idx], ends) + left @ (right.T @ basis)


def _left(frame, first: int, last: int) -> np.ndarray:
    return np.stack(frame["f"].iloc[first:last].to_list()).astype(float)


def _residuals(idx, val, ends, left, right) -> np.ndarray:
    """Values less what the low-rank part gives at their place."""
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    return val - (left[owner] * right[idx]).sum(axis=1)


def _multiply(rows: DataFrame, basis: np.ndarray, right: np.ndarray, residual: bool) -> np.ndarray:
    """A'A times the basis: each task adds up its rows, Spark adds up the tasks per feature.

    A task returns the features that its rows have, and the low-rank part as one row per rank (-1, -2, ...).
    """
    n, width = basis.shape
    rank = right.shape[1]

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        total, low = np.zeros((n, width)), np.zeros((rank, width))
        for frame in frames:
            for first, last, idx, val, ends in _chunks(frame):
                left = _left(frame, first, last)
                at = _residuals(idx, val, ends, left, right) if residual else val
                y = _project(idx, at, ends, left, right, basis)
                each = np.repeat(y, np.diff(np.concatenate([[0], ends])), axis=0) * at[:, None]
                total += np.stack([np.bincount(idx, each[:, j], n) for j in range(width)], axis=1)
                low += left.T @ y
        there = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"i": np.concatenate([there, -1 - np.arange(rank)]), "z": [*total[there], *low]})

    # every task returns a matrix, so there are no more tasks than cores
    parts = rows.select("idx", "val", "f").coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)).mapInPandas(work, "i int, z array<double>")
    sums = parts.groupBy("i").agg(F.array(*[F.sum(F.get("z", F.lit(j))) for j in range(width)]).alias("z")).toPandas()
    out = np.zeros((n + rank, width))  # the negative numbers count from the end
    if len(sums):
        out[sums["i"].to_numpy()] = np.stack(sums["z"].to_list())
    return out[:n] + right @ out[n:][::-1]


def _subspace(product: Callable[[np.ndarray], np.ndarray], start: np.ndarray, k: int, sweeps: int, close: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading right singular vectors by subspace iteration with A'A times a basis: (loadings, singular values, basis for a next start)."""
    basis, before = np.linalg.qr(start)[0], None
    for _ in range(sweeps):
        z = product(basis)
        gram = basis.T @ z
        found, turn = np.linalg.eigh((gram + gram.T) / 2)
        found, turn = np.maximum(found[::-1], 0), turn[:, ::-1]
        held = basis @ turn
        if before is not None and np.abs(found[:k] - before[:k]).max() <= close * max(found[0], 1e-300):
            break
        before, basis = found, np.linalg.qr(z @ turn)[0]
    loadings = held[:, :k]
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    return loadings * np.where(signs == 0, 1, signs), np.sqrt(found[:k]), held


def _start(n: int, k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, min(n, k + 8)))


def _packed(there: DataFrame, key: str, other: str) -> DataFrame:
    """(row, column, value) as blocks of whole keys, one row each, with about PACK values or one key: ``keys``, ``others``
    in ascending order, how many values each of them has (``times``), and by ``others`` the place of each value's key and the value.
    """
    kinds = [there.schema[c].dataType.simpleString() for c in (key, other)]

    def block(k: np.ndarray, o: np.ndarray, v: np.ndarray) -> dict:
        keys, place = np.unique(k, return_inverse=True)
        others, which = np.unique(o, return_inverse=True)
        order = np.argsort(which, kind="stable")
        return {"keys": [keys], "others": [others], "times": [np.bincount(which)], "place": [place[order]], "val": [v[order]]}

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        held, size = [], 0
        for frame in frames:
            held.append([frame[c].to_numpy() for c in (key, other, "value")])
            size += len(frame)
            if size >= PACK:
                k, o, v = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = np.flatnonzero(k[1:] != k[:-1])
                if len(cut):  # the last key may go on
                    at = cut[-1] + 1
                    yield pd.DataFrame(block(k[:at], o[:at], v[:at]))
                    held, size = [[k[at:], o[at:], v[at:]]], len(k) - at
        if size:
            yield pd.DataFrame(block(*(np.concatenate(x) for x in zip(*held, strict=True))))

    dealt = there.select(key, other, "value").repartition(key).sortWithinPartitions(key)
    return kept(dealt.mapInPandas(work, f"keys array<{kinds[0]}>, others array<{kinds[1]}>, times array<int>, place array<int>, val array<double>"))


def _unpacked(blocks: DataFrame, key: str, other: str) -> DataFrame:
    kinds = [blocks.schema[c].dataType.elementType.simpleString() for c in ("keys", "others")]

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for keys, others, times, place, val in frame[["keys", "others", "times", "place", "val"]].itertuples(index=False, name=None):
                yield pd.DataFrame({key: keys[place], other: np.repeat(others, times), "value": val})

    return blocks.mapInPandas(work, f"`{key}` {kinds[0]}, `{other}` {kinds[1]}, value double")


def _totals_of(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(others of the blocks in ascending order, their totals)."""
    import pyarrow.compute as pc

    kind = blocks.schema["others"].dataType.elementType.simpleString()

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for others, times, val in zip(frame["others"], frame["times"], frame["val"], strict=True):
                yield pd.DataFrame({"other": others, "total": np.add.reduceat(val, np.cumsum(times) - times)})

    found = blocks.mapInPandas(work, f"other {kind}, total double").groupBy("other").agg(F.sum("total").alias("total")).toArrow()
    found = found.take(pc.sort_indices(found["other"]))
    return found["other"].to_numpy(), found["total"].to_numpy()


def _block_rows(val: np.ndarray, at: np.ndarray, place: np.ndarray, left: np.ndarray, basis: np.ndarray, low: np.ndarray) -> Iterator[np.ndarray]:
    """Per component: the rows of a block (its values plus left times ``low``) times the basis, whose components are rows."""
    for one, less in zip(basis, low, strict=True):
        yield np.bincount(place, val * one[at], len(left)) + left * less


def _lefts(val: np.ndarray, place: np.ndarray, n: int, left: tuple[float, float]) -> np.ndarray:
    """The low-rank side of a block's keys: a number, and one times the total of the key."""
    return left[0] + left[1] * np.bincount(place, val, n)


def _block_products(blocks: DataFrame, ids: np.ndarray, basis: np.ndarray, right: np.ndarray, left: tuple[float, float]) -> np.ndarray:
    """A'A times the basis for A = values + left right': each task adds up its blocks, Spark adds up the tasks per slice."""
    n, width = basis.shape
    shared = blocks.sparkSession.sparkContext.broadcast((ids, np.ascontiguousarray(basis.T), right @ basis))

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        ids, basis, low = shared.value
        total, back = np.zeros((width, n)), np.zeros(width)
        for frame in frames:
            for keys, others, times, place, val in frame[["keys", "others", "times", "place", "val"]].itertuples(index=False, name=None):
                idx, first = np.searchsorted(ids, others), np.cumsum(times) - times
                at, f = np.repeat(idx, times), _lefts(val, place, len(keys), left)
                for j, y in enumerate(_block_rows(val, at, place, f, basis, low)):
                    total[j, idx] += np.add.reduceat(val * y[place], first)
                    back[j] += f @ y
        yield pd.DataFrame({"at": [-1], "z": [back]})
        for a in range(0, n, SLICE):
            if total[:, a : a + SLICE].any():
                yield pd.DataFrame({"at": [a], "z": [total[:, a : a + SLICE].ravel()]})

    def added(frame):
        import pandas as pd

        return pd.DataFrame({"at": frame["at"].iloc[:1], "z": [frame["z"].sum()]})

    # every task returns a matrix, so there are no more tasks than cores
    parts = blocks.coalesce(max(1, blocks.sparkSession.sparkContext.defaultParallelism)).mapInPandas(work, "at int, z array<double>")
    sums = parts.groupBy("at").applyInPandas(added, "at int, z array<double>").toArrow()
    shared.destroy()
    out, back = np.zeros((width, n)), np.zeros(width)
    for at, z in zip(sums["at"].to_pylist(), sums["z"], strict=True):
        z = z.values.to_numpy()
        if at < 0:
            back = z
        else:
            out[:, at : at + SLICE] = z.reshape(width, -1)
    return (out + back[:, None] * right).T


def _block_scores(blocks: DataFrame, ids: np.ndarray, loadings: np.ndarray, right: np.ndarray, left: tuple[float, float], key: str, name: str) -> DataFrame:
    """(key, scores) of the keys of all blocks."""
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    shared = blocks.sparkSession.sparkContext.broadcast((ids, np.ascontiguousarray(loadings.T), right @ loadings))

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        ids, basis, low = shared.value
        for frame in frames:
            for keys, others, times, place, val in frame[["keys", "others", "times", "place", "val"]].itertuples(index=False, name=None):
                at = np.repeat(np.searchsorted(ids, others), times)
                y = np.stack([*_block_rows(val, at, place, _lefts(val, place, len(keys), left), basis, low)], axis=1)
                for a in range(0, len(keys), SLICE):
                    yield pd.DataFrame({key: keys[a : a + SLICE], name: list(y[a : a + SLICE])})

    return blocks.mapInPandas(work, f"`{key}` {kind}, `{name}` array<double>")


def _local(blocks: DataFrame, ids: np.ndarray, table: np.ndarray, key: str, name: str) -> DataFrame:
    """(key, array) of the smaller side, which the driver holds."""
    import pyarrow as pa

    n, width = table.shape
    arrays = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(np.ascontiguousarray(table, float).ravel()))
    found = blocks.sparkSession.createDataFrame(pa.table({"key": pa.array(ids), "of": arrays}))
    return found.select(F.col("key").cast(blocks.schema["others"].dataType.elementType).alias(key), F.col("of").alias(name))


def _by_feature(features: DataFrame, column: str, loadings: np.ndarray) -> DataFrame:
    import pandas as pd

    local = pd.DataFrame({"idx": np.arange(len(loadings)), "loadings": [list(map(float, x)) for x in loadings]})
    return features.join(features.sparkSession.createDataFrame(local, "idx int, loadings array<double>"), "idx").select(column, "loadings")


def _signs(found: DataFrame, k: int) -> np.ndarray:
    """The signs that make the largest of each component positive, of (key, array)."""
    each = [F.get(F.col(found.columns[1]), F.lit(j)) for j in range(k)]
    largest = found.agg(*[F.max_by(x, F.abs(x)) for x in each]).first()
    return np.array([-1.0 if x is not None and x < 0 else 1.0 for x in largest])


def _turned(found: DataFrame, singular: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Loadings from (key, scores) of the turned table, and the signs that make the largest of each component positive."""
    k = len(singular)
    each, signs = [F.get("scores", F.lit(j)) for j in range(k)], _signs(found, k)
    factor = [float(a / s) if s > 0 else 0.0 for a, s in zip(signs, singular, strict=True)]
    return found.withColumn("loadings", F.array(*[x * y for x, y in zip(each, factor, strict=True)])).drop("scores"), signs


def components(
    values: DataFrame, k: int, row: str = "cell_no", column: str = "gene_no", center: bool = True, sweeps: int = 60, close: float = 1e-10, seed: int = 0, most_features: int | None = None
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Principal components of (row, column, value): (row, scores), (column, loadings), singular values.

    An absent or null value is 0, repeats are averaged; rows without any value are not seen. With ``center`` the mean of each
    feature over all rows is taken off, without making the zeros into rows. Signs: the
    largest loading is positive. Fewer features or rows than ``k`` give fewer components; an empty table gives none.
    """
    blocks = _packed(_averaged(values, row, column), column, row)
    n = blocks.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    if most_features is not None and n > most_features:
        raise ValueError(f"{n} features, more than most_features = {most_features}")
    ids, sums = _totals_of(blocks)
    total = len(ids)
    k = min(k, n, total)
    if not k:
        none = F.array().cast("array<double>")
        return _local(blocks, ids, np.zeros((total, 0)), row, "scores"), blocks.select(F.explode("keys").alias(column), none.alias("loadings")), []
    turned = n > WIDE and total < n
    if turned:
        right, left = np.ones(total), (0.0, -1.0 / total if center else 0.0)
    else:
        blocks = _packed(_unpacked(blocks, column, row), row, column)
        ids, sums = _totals_of(blocks)
        right, left = -(sums / total), (1.0 if center else 0.0, 0.0)
    found, singular, _ = _subspace(lambda basis: _block_products(blocks, ids, basis, right, left), _start(len(ids), k, seed), k, sweeps, close)
    values_of = [float(x) for x in singular]
    if not turned:
        return _block_scores(blocks, ids, found, right, left, row, "scores"), _local(blocks, ids, found, column, "loadings"), values_of
    found = found * np.divide(1.0, singular, out=np.zeros(k), where=singular > 0)
    signs = _signs(_block_scores(blocks, ids, found, right, left, column, "loadings"), k)
    loadings = _block_scores(blocks, ids, found * signs, right, left, column, "loadings")
    return _local(blocks, ids, found * signs * singular**2, row, "scores"), loadings, values_of


def impute_components(
    values: DataFrame, k: int, row: str = "cell_no", column: str = "feature", most: int = 50, least_gain: float = 0.001, sweeps: int = 3, seed: int = 0, most_features: int | None = None
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Components of values with gaps that are filled by them: (row, scores), (column, mean, loadings), errors of the rounds.

    Features are centred by the mean of what was observed, and gaps begin at that mean.
    Each round fills the gaps with scores times loadings, until the mean square by which
    the gaps move is under ``least_gain`` of the largest so far, or after ``most`` rounds.
    The filled table is never made: it is the residuals of observed values plus the
    low-rank part, so a round costs what is observed. Each round starts from the last
    one's directions and takes ``sweeps`` steps (thirty in the first).
    """
    there = _averaged(values, row, column)
    features, n = _totals(there, column, most_features)
    cells, total = _totals(there, row)
    means = features.withColumn("mean", F.col("total") / F.col("n_rows"))
    seen = features.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    k, gaps = min(k, n, total), total * n - seen
    if not k:
        none = F.array().cast("array<double>")
        return cells.select(row, none.alias("scores")), means.select(column, "mean", none.alias("loadings")), []
    turn = n > WIDE and total < n
    if turn:
        cells = _numbered(cells, row)
        lists, key, width = _lists(there, cells, column, row), column, total
        rows = lists.join(means.select(column, "mean"), column).withColumn("val", F.transform("val", lambda x: x - F.col("mean"))).drop("mean")
    else:
        means = _numbered(means, column)
        mean = means.orderBy("idx").select("mean").toPandas()["mean"].to_numpy(dtype=float)
        lists, key, width = _lists(there, means, row, column), row, n

        def centred(frames: Iterator) -> Iterator:
            for frame in frames:
                frame["val"] = [np.asarray(v, float) - mean[np.asarray(i, np.int64)] for i, v in zip(frame["idx"], frame["val"], strict=True)]
                yield frame

        rows = lists.mapInPandas(centred, lists.schema)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, idx array<int>, val array<double>, f array<double>, moved double"

    def filled(old: np.ndarray, new: np.ndarray):
        def work(frames: Iterator) -> Iterator:
            import pandas as pd

            for frame in frames:
                for first, last, idx, val, ends in _chunks(frame):
                    left = _left(frame, first, last)
                    y = _project(idx, _residuals(idx, val, ends, left, old), ends, left, old, new)
                    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
                    at = ((left[owner] * old[idx]).sum(axis=1) - (y[owner] * new[idx]).sum(axis=1)) ** 2
                    whole = (left**2 @ (old**2).sum(axis=0)) if k == 1 else np.einsum("ij,jk,ik->i", left, old.T @ old, left)
                    whole = whole + (y**2).sum(axis=1) - 2 * np.einsum("ij,jk,ik->i", left, old.T @ new, y)
                    part = frame.iloc[first:last]
                    moved = whole - _row_sums(at[:, None], ends)[:, 0]
                    yield pd.DataFrame({key: part[key].to_numpy(), "idx": list(part["idx"]), "val": list(part["val"]), "f": list(y), "moved": np.maximum(moved, 0)})

        return work

    rows = kept(rows.select(key, "idx", "val", F.array_repeat(F.lit(0.0), k).alias("f"), F.lit(0.0).alias("moved")))
    right, start, errors = np.zeros((width, k)), _start(width, k, seed), []
    for nth in range(most if gaps else 1):
        loadings, _, start = _subspace(lambda basis: _multiply(rows, basis, right, True), start, k, sweeps if nth else 30, 1e-12)
        rows = kept(rows.mapInPandas(filled(right, loadings), schema))
        right = loadings
        if gaps:
            errors.append(rows.agg(F.sum("moved")).first()[0] / gaps)
            if errors[-1] <= least_gain * max(errors):
                break
    found = rows.select(key, F.col("f").alias("scores"))
    if not turn:
        return found, _by_feature(means, column, right).join(means.select(column, "mean"), column), errors
    size = np.sqrt(np.array(found.agg(*[F.sum(F.get("scores", F.lit(j)) ** 2) for j in range(k)]).first(), float))
    loadings, signs = _turned(found, size)
    return _by_feature(cells, row, right * size * signs).withColumnRenamed("loadings", "scores"), loadings.join(means.select(column, "mean"), column), errors
