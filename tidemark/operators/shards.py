"""Games as compact shards: draws' features and outcome codes in arrays, the distributions of labels under weights, and their scores.

A shard is one row a game. Its draws are bounded by the simulation that made them, so a row has a bounded size however
many games there are; everything about a game happens in the task that holds its row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scoring import CLIP, clipped
from tidemark.operators.distributions import interpolated
from tidemark.operators.evaluation import full_benchmark, uniformity
from tidemark.operators.gates import evidence_reasons, superiority_reasons
from tidemark.operators.quality import require_empty
from tidemark.sources.tables import content_hash

#: Fixed value: what the hash behind a randomised PIT begins with.
PIT_SALT = "pit-u/v1"
#: Levels of the quantiles of a row.
QUANTILES = {"p05": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}
#: Fixed value: kinds of props that are read as 0 or 1 and scored by log loss.
BINARY_PROPS = ("anytime_td", "anytime_td_1q", "anytime_td_1h", "anytime_td_2h")
LABEL = "struct<player:string,prop:string,observed:double,values:array<bigint>,codes:array<int>>"


def compact(draws: DataFrame, outcomes: DataFrame, labels: DataFrame, game: str, draw: str, features: list[str]) -> DataFrame:
    """game, n_draws, features (of each draw, in order of draws), labels and content_hash.

    draws: game, draw and features; outcomes: game, draw, player, prop, value; labels: game, player, prop, observed. A label holds
    its distinct values in order and each draw's place among them. A label without a value for every draw is an error, and so
    is one that is there twice; outcomes without a label are left out, games without labels too.
    """
    of = F.struct(F.col(draw), F.array(*[F.col(f).cast("double") for f in features]).alias("f"))
    games = draws.groupBy(game).agg(F.sort_array(F.collect_list(of)).alias("d")).select(game, F.size("d").alias("n_draws"), F.col("d.f").alias("features"))
    known = labels.groupBy(game, F.col("player").cast("string").alias("player"), "prop", F.col("observed").cast("double").alias("observed")).agg(F.count("*").alias("_n"))
    named = outcomes.withColumn("player", F.col("player").cast("string"))
    # draws of a label are gathered before they meet it: one row a label is joined, not one a draw
    one = named.groupBy(game, "player", "prop").agg(F.sort_array(F.collect_list(F.struct(F.col(draw).alias("d"), F.col("value").cast("long").alias("v")))).alias("o"))
    one = one.select(game, "player", "prop", F.col("o.v").alias("drawn")).join(known, [game, "player", "prop"])
    one = one.withColumn("drawn", F.when(F.col("_n") == 1, F.col("drawn")).otherwise(F.raise_error(F.lit("a label is there twice")))).withColumn("values", F.sort_array(F.array_distinct("drawn")))
    one = one.select(game, F.struct("player", "prop", "observed", "values", _codes("drawn", "values").alias("codes")).alias("label"))
    return _whole(games.join(one.groupBy(game).agg(F.sort_array(F.collect_list("label")).alias("labels")), game), game)


def _codes(drawn: str, values: str) -> Column:
    return F.transform(drawn, lambda v: (F.array_position(values, v) - 1).cast("int"))


def _whole(shards: DataFrame, game: str) -> DataFrame:
    """shards with content_hash; a label without a value for every draw is an error."""
    complete = F.forall("labels", lambda x: (F.size(x["codes"]) == F.col("n_draws")) & ~F.array_contains(x["codes"], -1))  # null if a code is
    shards = shards.withColumn("labels", F.when(complete, F.col("labels")).otherwise(F.raise_error(F.lit("a label lacks values of some draws"))))
    return shards.withColumn("content_hash", content_hash([game, "n_draws", "features", "labels"]))


def compact_wide(draws: DataFrame, game: str, draw: str, features: list[str], player: Column, outcomes: dict[str, str], observed: Column) -> DataFrame:
    """What `compact` makes, of draws that hold their outcomes as columns: a game's draws are gathered once, and nothing is joined.

    outcomes: the column of each prop; observed: an aggregate that has what happened, a struct of the same columns; player: that
    of all props of a game, an expression over `game`. Rows without a game are left out.
    """
    of = F.struct(F.col(draw), F.array(*[F.col(f).cast("double") for f in features]).alias("f"), *[F.col(c).cast("long").alias(f"v{i}") for i, c in enumerate(outcomes.values())])
    games = draws.where(F.col(game).isNotNull()).groupBy(game).agg(F.sort_array(F.collect_list(of)).alias("d"), observed.alias("y"))
    seen = {f"y{i}": F.col("y")[c].cast("double") for i, c in enumerate(outcomes.values())}
    games = games.select(game, F.size("d").alias("n_draws"), F.col("d.f").alias("features"), *[F.col(f"d.v{i}").alias(f"v{i}") for i in range(len(outcomes))], *[y.alias(k) for k, y in seen.items()])
    games = games.withColumns({f"s{i}": F.sort_array(F.array_distinct(f"v{i}")) for i in range(len(outcomes))})
    labels = [F.struct(player.cast("string").alias("player"), F.lit(p).alias("prop"), F.col(f"y{i}").alias("observed"), F.col(f"s{i}").alias("values"), _codes(f"v{i}", f"s{i}").alias("codes")) for i, p in enumerate(outcomes)]
    return _whole(games.select(game, "n_draws", "features", F.sort_array(F.array(*labels)).alias("labels")), game)


def checked(shards: DataFrame, game: str) -> DataFrame:
    """shards whose content is what it was when they were written; anything else is an error."""
    same = F.col("content_hash") == content_hash([game, "n_draws", "features", "labels"])
    return shards.withColumn("labels", F.when(same, F.col("labels")).otherwise(F.raise_error(F.lit("a shard has changed"))))


#: Draws that one vectorised step works on at a time; bounds the memory of a Python worker.
SLICE_DRAWS = 200_000


class Block:
    """Some shards of a batch as flat arrays: a row of x for each draw, an entry of `code` for each label and draw, one of `values` for each label and value."""

    def __init__(self, batch: pa.RecordBatch):
        draws, labels, flat, self.observed, size, self.values, codes = self._parts(batch)
        self.game = np.repeat(np.arange(len(draws)), labels)
        self.x = flat.reshape(int(draws.sum()), -1) if len(flat) else np.zeros((int(draws.sum()), 0))
        self.draws, self.first = draws, np.cumsum(draws) - draws
        #: where the values of each label begin and end, and which label each value is of
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.label = np.repeat(np.arange(len(size)), size)
        # each label's draws are those of its game
        self.many = draws[self.game]
        self.draw = np.repeat(self.first[self.game] - np.cumsum(self.many) + self.many, self.many)
        self.draw += np.arange(len(self.draw))
        self.code = np.repeat(self.start, self.many)
        self.code += codes

    def _parts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Draws and labels of each game, all features, what happened and the number of values of each label, all values and all codes."""
        features, n, labels = (batch.column(batch.schema.get_field_index(c)) for c in ("flat", "n_draws", "labels"))
        of = labels.flatten()
        numbers = lambda a: a.to_numpy(zero_copy_only=False)
        self.player, self.prop, self.actual = of.field("player"), of.field("prop"), of.field("observed")
        size = numbers(of.field("values").value_lengths()).astype(np.int64)
        return numbers(n).astype(np.int64), numbers(labels.value_lengths()), numbers(features.flatten()).astype(float), numbers(self.actual), size, numbers(of.field("values").flatten()), numbers(of.field("codes").flatten())

    @cached_property
    def of(self) -> np.ndarray:
        """The game of each draw."""
        return np.repeat(np.arange(len(self.draws)), self.draws)

    @cached_property
    def props(self) -> tuple[list[str], np.ndarray]:
        """Names of the props, and which of them each label has."""
        known = pc.fill_null(self.prop, "None").dictionary_encode()
        return known.dictionary.to_pylist(), known.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @cached_property
    def fixed(self) -> tuple[np.ndarray, ...]:
        """What no weight changes: whether a label's prop is binary, whether a value is a hit, how far what happened lies outside all values, and how much of the gap after a value is below and above it."""
        names, prop = self.props
        binary, values, y = np.isin(names, BINARY_PROPS)[prop], self.values.astype(float), self.observed
        # the last value of a label has no gap after it
        gap = np.append(np.diff(values), 0.0)
        gap[self.end - 1] = 0.0
        below = np.clip(y[self.label], values, values + gap) - values
        return binary, values >= 1, np.maximum(values[self.start] - y, 0.0) + np.maximum(y - values[self.end - 1], 0.0), below, gap - below

    @cached_property
    def x_of_draw(self) -> np.ndarray:
        """The features of each label's draws."""
        return self.x[self.draw]

    def weights(self, theta: np.ndarray) -> np.ndarray:
        """Weights of draws that add up to 1 in each game, in proportion to exp(features . theta)."""
        z = self.x @ theta
        e = np.exp(z - np.maximum.reduceat(z, self.first)[self.of])
        return e / np.add.reduceat(e, self.first)[self.of]

    def masses(self, w: np.ndarray) -> np.ndarray:
        """Sums of w over the draws of each value of each label."""
        return np.bincount(self.code, w[self.draw], len(self.values))


class PackedBlock(Block):
    """A block of shards as `packed` makes them: the same arrays, read from bytes as they are."""

    def _parts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        of = lambda c: batch.column(batch.schema.get_field_index(c))
        self.prop = of("props").flatten()
        n, labels = (a.to_numpy(zero_copy_only=False).astype(np.int64) for a in (of("n_draws"), of("props").value_lengths()))
        return n, labels, *(_numbers(of(c), kind) for c, kind in PACKED.items())


#: Binary columns of a packed shard, and the type of their numbers.
PACKED = {"x": np.float64, "observed": np.float64, "sizes": np.int64, "values": np.int64, "codes": np.int32}


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers of all rows of a binary column."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if at[-1] > at[0] else np.zeros(0, kind)


def _bytes(values: np.ndarray, counts: np.ndarray, kind: type) -> pa.Array:
    """A binary column whose rows have so many of the values each."""
    values = np.ascontiguousarray(values, kind)
    ends = np.append(0, np.cumsum(counts)) * values.itemsize
    whole = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values)])
    return whole.cast(pa.binary())


def packed(shards: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, n_draws, props and the arrays of a shard as bytes, for work that reads shards again and again."""
    kinds = dict(shards.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_draws int, props array<string>", *(f"{c} binary" for c in PACKED)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in blocks(batch):
                own = batch.slice(i, len(block.draws))
                labels = np.bincount(block.game, minlength=len(own))
                sums = lambda a: np.bincount(block.game, a, len(own)).astype(np.int64)
                size = block.end - block.start
                arrays = [own.column(own.schema.get_field_index(c)) for c in keep]
                arrays += [pa.array(block.draws, pa.int32()), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(labels)), pa.int32()), block.prop)]
                data = (block.x.ravel(), block.observed, size, block.values, block.code - np.repeat(block.start, block.many))
                counts = (block.draws * block.x.shape[1], labels, labels, sums(size), sums(block.many))
                arrays += [_bytes(v, n, kind) for v, n, kind in zip(data, counts, PACKED.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_draws", "props", *PACKED])

    return flat(shards, *keep).mapInArrow(each, schema)


def blocks(batch: pa.RecordBatch, kind: type[Block] = Block, most: int | None = None) -> Iterator[tuple[int, Block]]:
    """The shards of a batch in blocks of about `most` draws (SLICE_DRAWS by default), each with the row it begins at. A shard without draws is an error."""
    n = np.asarray(batch.column(batch.schema.get_field_index("n_draws")))
    if len(n) and n.min() < 1:
        raise ValueError("a shard without draws")
    ends, i = np.cumsum(n), 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (most or SLICE_DRAWS), "right")))
        yield i, kind(batch.slice(i, j - i))
        i = j
    pa.default_memory_pool().release_unused()


def flat(shards: DataFrame, *keep: str) -> DataFrame:
    """shards as `read` takes them, with the columns `keep`."""
    return shards.select(*keep, "n_draws", F.flatten("features").alias("flat"), F.col("labels").cast(f"array<{LABEL}>").alias("labels"))


def _labels(shards: DataFrame, game: str, thetas: dict[str, list[float]], keep: tuple[str, ...], more: str, made) -> DataFrame:
    """variant, game, keep, player, prop, observed and the columns `more`, which made(block, p) gives of each label's values and their p."""
    kinds = dict(shards.dtypes)
    columns = [game, *keep]
    schema = ", ".join(["variant string", *(f"`{c}` {kinds[c]}" for c in columns), "player string, prop string, observed double", more])
    names = {k: np.array(v, float) for k, v in thetas.items()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in blocks(batch):
                if not len(block.game):
                    continue
                kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(block.game + i)) for c in columns]
                for variant, theta in names.items():
                    own = made(block, block.masses(block.weights(theta)))
                    columns_ = [pa.array([variant] * len(block.game), pa.string()), *kept, block.player, block.prop, block.actual, *own.values()]
                    yield pa.RecordBatch.from_arrays(columns_, names=["variant", *columns, "player", "prop", "observed", *own])

    return flat(shards, *columns).mapInArrow(each, schema)


def distributions(shards: DataFrame, game: str, thetas: dict[str, list[float]], keep: tuple[str, ...] = ()) -> DataFrame:
    """variant, game, player, prop, observed and pmf (an array of outcome and p, in order) of each label under each named theta."""

    def made(block: Block, p: np.ndarray) -> dict[str, pa.Array]:
        bounds = pa.array(np.append(block.start[:1], block.end), pa.int32())
        return {"outcomes": pa.ListArray.from_arrays(bounds, pa.array(block.values, pa.int64())), "p": pa.ListArray.from_arrays(bounds, pa.array(p))}

    rows = _labels(shards, game, thetas, keep, "outcomes array<bigint>, p array<double>", made)
    return rows.withColumn("pmf", F.arrays_zip(F.col("outcomes").alias("outcome"), F.col("p").alias("p"))).drop("outcomes", "p")


def scored_distributions(shards: DataFrame, game: str, thetas: dict[str, list[float]], keep: tuple[str, ...] = ()) -> DataFrame:
    """What `scored` gives of `distributions`, without the distributions themselves, which do not leave the task."""
    made = lambda block, p: _figures(block.end - block.start, block.values, p, block.actual)
    return _derived(_labels(shards, game, thetas, keep, ", ".join(f"{c} {kind}" for c, kind in FIGURES.items()), made), game)


def total(pmf: Column, of) -> Column:
    """Sum of a function of an array's elements."""
    return F.aggregate(pmf, F.lit(0.0), lambda a, x: a + of(x).cast("double"))


#: What tasks find out about a label from its distribution and its actual value.
FIGURES = {**dict.fromkeys(("model_mean", "model_variance", "p_zero", "_below", "_at", "_hit", "_crps"), "double"), **dict.fromkeys(("support_min", "support_max", *QUANTILES), "bigint")}
#: Most places of a padded block of distributions.
PADDED = 1_000_000


def _running(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums of p up to and with each entry of its row. Rows of like size are added up side by side, each from its own beginning, so that no sum has another's rounding."""
    out, start, order, i = np.empty(len(p)), np.cumsum(size) - size, np.argsort(-size, kind="stable"), 0
    while i < len(order) and (width := int(size[order[i]])):
        rows = order[i : i + max(1, PADDED // width)]
        place = np.arange(width)
        inside = place < size[rows][:, None]
        at = (start[rows][:, None] + place)[inside]
        block = np.zeros(inside.shape)
        block[inside] = p[at]
        out[at] = np.cumsum(block, axis=1)[inside]
        i += len(rows)
    return out


def _figures(size: np.ndarray, outcome: np.ndarray, p: np.ndarray, observed: pa.Array) -> dict[str, pa.Array]:
    """FIGURES of distributions one after another: `size` outcomes in order, with their p, for each entry of observed.

    CRPS is the squared distance of the distribution function from a step at the actual value. Without an actual value no
    outcome is below or at it; one that is no number is above all.
    """
    n, row = len(size), np.repeat(np.arange(len(size)), size)
    end = np.cumsum(size)
    begin, unknown = end - size, np.asarray(observed.is_null())
    actual = observed.to_numpy(zero_copy_only=False).astype(float)
    y = np.where(np.isnan(actual) & ~unknown, np.inf, actual)
    x, of = outcome.astype(float), y[row]
    add = lambda w: np.bincount(row, w, n)
    mean = add(p * x)
    cdf = _running(size, p)
    # the step before each outcome; the first of a row has none
    first = np.zeros(len(x), bool)
    first[begin[size > 0]] = True
    last, before = np.where(first, x, np.roll(x, 1)), np.where(first, 0.0, np.roll(cdf, 1))
    below = np.minimum(np.where(unknown[row], last, np.maximum(of, last)), x) - last
    parts = np.column_stack([before * before * below, (1 - before) * (1 - before) * (x - last - below)]).ravel()
    crps = np.bincount(np.repeat(row, 2), parts, n)
    full = size > 0
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low[full], high[full] = outcome[begin[full]], outcome[end[full] - 1]
    known = full & ~unknown
    crps[known] = crps[known] + np.maximum(low[known] - actual[known], 0) + np.maximum(actual[known] - high[known], 0)
    whole = lambda v, there: pa.array(v, pa.int64(), mask=~there)
    out = {c: pa.array(v) for c, v in {"model_mean": mean, "model_variance": add(p * (x - mean[row]) ** 2), "p_zero": add(np.where(outcome == 0, p, 0.0)), "_below": add(np.where(x < of, p, 0.0)), "_at": add(np.where(x == of, p, 0.0)), "_hit": add(np.where(outcome >= 1, p, 0.0)), "_crps": crps}.items()}
    out |= {"support_min": whole(low, full), "support_max": whole(high, full)}
    for name, level in QUANTILES.items():
        # sums never fall, so those below the level come first
        short = np.bincount(row, cdf < level - 1e-12, n).astype(np.int64)
        there, value = short < size, np.zeros(n, np.int64)
        value[there] = outcome[(begin + short)[there]]
        out[name] = whole(value, there)
    return out


def pit_uniform(*parts: Column) -> Column:
    """A number between 0 and 1 that game, player and prop decide: the first 64 bits of a hash."""
    digest = F.sha2(F.concat_ws("|", F.lit(PIT_SALT), *[p.cast("string") for p in parts]), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") + 0.5) / 2.0**64


def scored(rows: DataFrame, game: str) -> DataFrame:
    """rows of `distributions` with moments, randomised PIT, quantiles and scores: log loss and Brier of props read as 0 or 1, CRPS of others."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pmf, observed = (batch.column(batch.schema.get_field_index(c)) for c in ("pmf", "observed"))
            of = pmf.flatten()
            numbers = [of.field(c).to_numpy(zero_copy_only=False) for c in ("outcome", "p")]
            own = _figures(pmf.value_lengths().fill_null(0).to_numpy().astype(np.int64), *numbers, observed)
            yield pa.RecordBatch.from_arrays([*batch.columns, *own.values()], names=[*batch.schema.names, *own])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in [*rows.dtypes, *FIGURES.items()])
    return _derived(rows.mapInArrow(each, kinds), game)


def _derived(rows: DataFrame, game: str) -> DataFrame:
    """rows with what FIGURES decide; helpers among these go."""
    binary, y, p = F.col("prop").isin(*BINARY_PROPS), F.when(F.col("observed") >= 1, 1.0).otherwise(0.0), F.col("_hit")
    q = clipped(p, CLIP)
    pit = F.col("_below") + pit_uniform(F.col(game), F.col("player"), F.col("prop")) * F.col("_at")
    rows = rows.withColumns({
        "p_le_actual": F.col("_below") + F.col("_at"), "p_ge_actual": F.lit(1.0) - F.col("_below"), "pit": F.least(F.greatest(pit, F.lit(0.0)), F.lit(1.0)),
        "outcome": F.when(binary, y), "p_final": F.when(binary, p), "log_loss": F.when(binary, -(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))), "brier": F.when(binary, (q - y) * (q - y)), "crps": F.when(~binary, F.col("_crps")),
    })
    return rows.drop("_below", "_at", "_hit", "_crps")


#: Levels of the intervals that interval scores are taken of, by the quantiles at their ends.
INTERVALS = {0.1: ("p05", "p95"), 0.2: ("p10", "p90"), 0.5: ("p25", "p75")}


def interval_score(actual: Column) -> Column:
    """Weighted interval score over the median and three central intervals."""
    parts = F.abs(actual - F.col("p50")) * 0.5
    for alpha, (low, high) in INTERVALS.items():
        a, b = F.col(low), F.col(high)
        width = (b - a) + 2.0 / alpha * (F.greatest(a - actual, F.lit(0.0)) + F.greatest(actual - b, F.lit(0.0)))
        parts = parts + width * (alpha / 2.0)
    return parts / (len(INTERVALS) + 0.5)


def summary(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Scores of `scored` rows by each set of columns, all from one pass: binary, continuous, zero mass and tails.

    Columns: variant, those of all sets (null where a set lacks one), segment (which columns it has), and the figures.
    Calibration errors, and the distance of PITs from uniform, are added up over bins first.
    """
    names = list(dict.fromkeys(c for s in sets for c in s))
    y = F.col("observed")
    one = lambda c, when: F.avg(F.when(when, c))
    continuous, binary = F.col("crps").isNotNull(), F.col("p_final").isNotNull()
    tenth = F.least(F.floor(F.col("p_final") * 10 + 1e-9), F.lit(9))  # a sum a hair below an end of a bin counts as on it
    segments = F.array(*[F.struct(F.lit(",".join(s)).alias("segment"), *[(F.col(c) if c in s else F.lit(None)).cast("string").alias(c) for c in names]) for s in sets])
    spread = rows.select("*", F.explode(segments).alias("_s")).drop(*names).select("*", "_s.*").drop("_s")
    keys = ["variant", "segment", *names]
    main = spread.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if(binary).alias("n_binary"), F.avg("brier").alias("brier"), F.avg("log_loss").alias("log_loss"), F.avg("p_final").alias("mean_probability"), F.avg("outcome").alias("observed_rate"),
        F.count_if(continuous).alias("n_continuous"), F.avg("crps").alias("mean_crps"), one(interval_score(y), continuous).alias("mean_wis"), one(F.abs(y - F.col("model_mean")), continuous).alias("mae"),
        one((y.between(F.col("p25"), F.col("p75"))).cast("double"), continuous).alias("coverage_50"),
        one((y.between(F.col("p10"), F.col("p90"))).cast("double"), continuous).alias("coverage_80"), one((y.between(F.col("p05"), F.col("p95"))).cast("double"), continuous).alias("coverage_90"),
        one(F.col("p_zero"), continuous).alias("zero_mass_predicted"), one((y == 0).cast("double"), continuous).alias("zero_rate_observed"), one((y < F.col("p05")).cast("double"), continuous).alias("below_p05_rate"),
        one((y > F.col("p95")).cast("double"), continuous).alias("above_p95_rate"), one((F.col("p_le_actual") <= 0.05 + 1e-12).cast("double"), continuous).alias("p_le_actual_le_005_rate"), one((F.col("p_ge_actual") <= 0.05 + 1e-12).cast("double"), continuous).alias("p_ge_actual_le_005_rate"),
    )
    bins = spread.where(binary).groupBy(*keys, tenth.alias("_bin")).agg(F.count("*").alias("n"), F.avg("p_final").alias("a"), F.avg("outcome").alias("b"))
    ece = bins.groupBy(*keys).agg((F.sum(F.abs(F.col("a") - F.col("b")) * F.col("n")) / F.sum("n")).alias("ece"))
    ks = uniformity(spread.where(continuous), keys, "pit").withColumnRenamed("ks", "pit_ks")
    median = interpolated(spread.where(continuous).withColumn("_error", F.abs(y - F.col("model_mean"))), keys, "_error", [0.5]).select(*keys, F.col("p50").alias("median_ae"))
    out = main
    for i, more in enumerate((ece, ks, median)):
        right = more.toDF(*[f"_{i}{k}" for k in keys], more.columns[-1])
        on = F.lit(True)
        for k in keys:
            on &= out[k].eqNullSafe(right[f"_{i}{k}"])
        out = out.join(right, on, "left").drop(*[f"_{i}{k}" for k in keys])
    return out


#: What a promotion needs besides a better benchmark, in order; each must be true, and what is missing fails.
REQUIREMENTS = ("crps_not_worse", "wis_not_worse", "pit_not_worse", "stable_across_seasons", "stable_weeks_1_4", "stable_weeks_14_plus", "zero_leakage_failures", "simulation_invariants_pass", "reproducibility_pass")


def gates(rows: DataFrame, proofs: DataFrame, baseline: str = "raw", least_rows: int = 500, tolerance: float = 0.01) -> DataFrame:
    """variant, promote, reasons and the nine requirements: each variant of `scored` rows (with season and week) against the baseline.

    Variants must have the baseline's rows, each once. proofs: one row of the last three requirements. A requirement
    that cannot be judged is null and fails. Slices are seasons, weeks 1 to 4, and weeks from 14 on.
    """
    key = ["game", "player", "prop"]
    others = rows.where(F.col("variant") != baseline)
    names = others.select("variant").distinct()
    raw = rows.where(F.col("variant") == baseline).select(*key, F.col("p_final").alias("q"), F.lit(True).alias("_in")).crossJoin(F.broadcast(names))
    paired = others.select("variant", *key, "season", "week", F.col("outcome").alias("y"), F.col("p_final").alias("p"), F.lit(True).alias("_own")).join(raw, ["variant", *key], "full")
    each = paired.groupBy("variant", *key).agg(F.count("*").alias("_n"), F.bool_and(F.col("_in").isNotNull() & F.col("_own").isNotNull()).alias("_both"))
    require_empty(each.where("_n > 1 OR NOT _both"), "variants whose rows are not one to one with the baseline's")
    segments = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("season "), F.col("season").cast("string")), F.when(F.col("week").between(1, 4), "early"), F.when(F.col("week") >= 14, "late")))
    spread = paired.where("p IS NOT NULL").select("variant", F.explode(segments).alias("segment"), "y", "p", "q").withColumn("key", F.to_json(F.struct("variant", "segment")))
    judged = full_benchmark(spread, ["key"]).where("slice = 0").withColumn("bad", superiority_reasons(least_rows, tolerance))
    judged = judged.withColumns({"variant": F.get_json_object("key", "$.variant"), "segment": F.get_json_object("key", "$.segment"), "ok": F.size("bad") == 0})
    one = lambda name: F.max(F.when(F.col("segment") == name, F.col("ok")))
    seasons = F.bool_and(F.when(F.col("segment").startswith("season "), F.col("ok")))
    base = judged.groupBy("variant").agg(F.first(F.when(F.col("segment") == "all", F.col("bad")), ignorenulls=True).alias("base"), seasons.alias("stable_across_seasons"), one("early").alias("stable_weeks_1_4"), one("late").alias("stable_weeks_14_plus"))
    figures = summary(rows, [[]]).select("variant", "mean_crps", "mean_wis", "pit_ks")
    theirs = figures.where(F.col("variant") == baseline).select(*[F.col(c).alias(f"_{c}") for c in figures.columns[1:]])
    figures = figures.where(F.col("variant") != baseline).join(F.broadcast(theirs), F.lit(True), "left")
    figures = figures.select("variant", *[(F.col(c) <= F.col(f"_{c}")).alias(name) for c, name in (("mean_crps", "crps_not_worse"), ("mean_wis", "wis_not_worse"), ("pit_ks", "pit_not_worse"))])
    out = names.join(base, "variant", "left").join(figures, "variant", "left").crossJoin(F.broadcast(proofs))
    reasons = F.concat(F.coalesce("base", F.array(F.lit("no binary evidence"))), evidence_reasons(list(REQUIREMENTS)))
    return out.select("variant", (F.size(reasons) == 0).alias("promote"), reasons.alias("reasons"), *REQUIREMENTS)
