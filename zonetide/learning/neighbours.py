"""Exact nearest neighbours in any number of dimensions, by ball partitions.

Every row belongs to the ball of its nearest centre, and inside the ball to a shell between two distances from the centre.
By the triangle inequality no member of a shell is nearer to a row than what the row's distance from the centre leaves to
the shell. A row first learns a bound for its k-th neighbour from the rows of its shell; then it is sent once to each block of
shells of which one at least reaches inside the bound, and is compared there with the shells that still do. Centres and
shells only decide what is skipped.

Centres and shells are bounded in number and broadcast. Members and visitors meet in blocks of bounded size, however many
there are of either, so a dense cluster is spread over many tasks and an outlier widens one shell only. In many dimensions
nearly every shell is within reach of nearly every row: then a row is sent to all blocks, of which there are few, and not
to each of the shells. The distances inside a block are worked out by NumPy on Arrow batches.

Members of a ball are nearer to its centre than to any other. So a row whose bound does not lead over the plane midway between
its own centre and another one has no neighbour in the other's ball: with small bounds that leaves out most balls also where the
triangle inequality leaves out none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonetide.session import written

#: Centres at most, and shells of a ball; what is broadcast is a row of numbers for each.
CENTRES = 2048
SHELLS = 32
#: Rows of a shell that are compared by one call for a first bound.
BLOCK = 4096
#: Rows of a block of members, and of a turn of its visitors, that are compared by one call: a share of all, up to a limit that
#: memory sets (64 dimensions: 70 MB of each side).
SPREAD = 8
WIDEST = 131_072
#: Rounding that a distance from sums of products may have, relative to the squares it comes from.
_SLACK = 1e-9


def vector(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _rough2(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and how far off they may be."""
    scale = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    return np.maximum(scale - 2 * (a @ b.T), 0), _SLACK * scale


def _chunks(rows: int, width: int, cells: int = 4_000_000) -> Iterator[slice]:
    step = max(1, cells // max(1, width))
    return (slice(i, i + step) for i in range(0, rows, step))


class Balls:
    """Centres, and the shells: unit, ball, least and greatest distance from its centre, members, members of the units before.

    Members are dealt out over blocks of ``width`` rows in the order of their units; of a unit of more than ``block`` rows, parts may
    lie in several. ``unit_of`` and ``starts`` tell which units each of ``blocks`` has members of.
    """

    def __init__(self, centres: np.ndarray, shells: list[tuple[int, int, float, float, int, int]] = (), block: int = BLOCK, width: int = BLOCK):
        self.centres = centres
        self.unit = np.array([s[0] for s in shells], np.int64)
        self.ball = np.array([s[1] for s in shells], np.int64)
        self.low, self.high = (np.array([s[i] for s in shells], float) for i in (2, 3))
        self.members = np.array([s[4] for s in shells], np.int64)
        pieces = [(i, (s[5] + part * s[4] // parts) // width) for i, s in enumerate(shells) for parts in (-(-s[4] // block),) for part in range(parts)]
        self.unit_of = np.array([p[0] for p in pieces], np.int64)
        self.blocks, self.starts = np.unique(np.array([p[1] for p in pieces], np.int64), return_index=True)

    def distances(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(_rough2(rows, self.centres)[0])

    def away(self, rows: np.ndarray, shells: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance that each row may have from the centre of each shell."""
        balls, at = np.unique(self.ball[shells], return_inverse=True)
        d, off = _rough2(rows, self.centres[balls])
        return np.sqrt(np.maximum(d - off, 0))[:, at], np.sqrt(d + off)[:, at]

    def reaches(self, rows: np.ndarray, bound: np.ndarray, shells: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Whether each shell may have a member within the bound of each row."""
        near, far = self.away(rows, shells)
        gap = np.maximum(near - self.high[shells], self.low[shells] - far)
        return gap <= bound[:, None] + _SLACK * (far + self.high[shells] + bound[:, None])

    def crosses(self, rows: np.ndarray, home: np.ndarray, bound: np.ndarray, shells: np.ndarray) -> np.ndarray:
        """Whether each row, of ball ``home``, may have a member of each shell's ball within its bound: behind the plane between the centres."""
        balls, at = np.unique(self.ball[shells], return_inverse=True)
        own, theirs = self.centres[home], self.centres[balls]
        gap = rows - own
        d, off = _rough2(rows, theirs)
        apart, wrong = _rough2(own, theirs)
        ahead = d - (gap * gap).sum(1)[:, None] - 2 * np.sqrt(apart + wrong) * np.minimum(bound, 1e150)[:, None] - 4 * (off + wrong)
        # The balls were told apart by rounded distances too.
        size = np.sqrt((theirs * theirs).sum(1))[at] + self.high[shells]
        return ahead[:, at] <= 4 * _SLACK * (size * size)[None, :]

    def reached(self, rows: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, rows, bounds) for every block that may hold one of a row's k nearest."""
        for part in _chunks(len(rows), max(len(self.unit_of), len(self.centres))):
            best = bound[part].copy()
            short = np.flatnonzero(np.isinf(best))  # too few rows in its block: the nearest shells that hold enough
            if len(short):
                far = self.away(rows[part][short])[1] + self.high
                for i, row in zip(short, far):
                    order = np.argsort(row)
                    enough = np.searchsorted(np.cumsum(self.members[order]), k + 1)
                    best[i] = row[order[min(enough, len(order) - 1)]] * (1 + _SLACK)
            hit = np.logical_or.reduceat(self.reaches(rows[part], best)[:, self.unit_of], self.starts, axis=1)
            for i, block in enumerate(self.blocks):
                row = np.flatnonzero(hit[:, i])
                if len(row):
                    yield int(block), row + part.start, best[row]


def _fields(df: DataFrame, key: str, rest: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}, {rest}"


def _all_fields(df: DataFrame, rest: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), rest])


def _assigned(rows: DataFrame, balls) -> DataFrame:
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"))
            ball, gap = np.zeros(len(v), np.int32), np.zeros(len(v))
            for part in _chunks(len(v), len(balls.value.centres)):
                ball[part] = balls.value.distances(v[part]).argmin(1)
            for part in _chunks(len(v), v.shape[1]):
                off = v[part] - balls.value.centres[ball[part]]
                gap[part] = np.sqrt((off * off).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball), pa.array(gap)], names=[*batch.schema.names, "ball", "gap"])

    return rows.mapInArrow(nearest, _all_fields(rows, "ball int, gap double"))


def _bounds(table: pa.Table, k: int) -> pa.Table:
    """An upper bound of the k-th neighbour's distance from the rows of one block; infinite with too few of them."""
    v = np.concatenate([_matrix(c) for c in table.column("v").chunks])
    bound = np.full(len(v), np.inf)
    if len(v) > k:
        for part in _chunks(len(v), len(v)):
            d, slack = _rough2(v[part], v)
            bound[part] = np.sqrt(np.partition(d + slack, k, axis=1)[:, k])
    return table.append_column("bound", pa.array(bound))


def _bunches(unit: np.ndarray, least: int = 512) -> Iterator[np.ndarray]:
    """Places of the members of one or more whole units, ``least`` at a time at least."""
    order = np.argsort(unit, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(unit[order])) + 1, len(order))
    start = 0
    for end in ends:
        if end - start >= least or end == len(order):
            yield from (order[i:min(i + BLOCK, end)] for i in range(start, end, BLOCK))
            start = end


def _compare(visitors: pa.Table, members: pa.Table, key: str, k: int, balls: Balls) -> pa.Table:
    """The nearest members of each visitor, itself left out, within its bound, which falls as nearer ones are found.

    Where members have bounds, a pair must be within both. ``unit`` is where a visitor is a member.
    """
    schema = pa.schema([(key, visitors.schema.field(key).type), ("neighbour", members.schema.field(key).type), ("distance2", pa.float64())])
    # The reach of a shell with a row without a spot is not known: it is not visited, whatever block it is in.
    reach = balls.high[np.searchsorted(balls.unit, members.column("unit").to_numpy())]
    members = members.filter(pa.array(~np.isnan(reach))).sort_by(key).combine_chunks()  # equal distances go by key
    visitors = visitors.combine_chunks()
    if not len(visitors) or not len(members):
        return schema.empty_table()
    a, b = (_matrix(t.column("v").chunk(0)) for t in (visitors, members))
    mine, theirs = visitors.column(key).to_numpy(zero_copy_only=False), members.column(key).to_numpy(zero_copy_only=False)
    limit = visitors.column("bound").to_numpy() ** 2 * (1 + _SLACK)
    theirs_limit = members.column("bound").to_numpy() ** 2 * (1 + _SLACK) if "bound" in members.column_names else None
    home = visitors.column("unit").to_numpy() // SHELLS
    # From the middle of the members, one is near enough if a.b - (1 - slack) b.b / 2 >= ((1 - slack) a.a - limit) / 2: one product
    # and one comparison, with the slack that single precision needs.
    largest = max(np.abs(a).max(), np.abs(b).max())
    kind, slack, least = (np.float32, max(1e-5, 1e-6 * a.shape[1]), 1e-35) if largest < 1e15 else (np.float64, _SLACK, 0.0)
    half = (1 - slack) / 2
    unit = np.searchsorted(balls.unit, members.column("unit").to_numpy())
    bunches = []
    for cols in _bunches(unit):
        finite = np.isfinite(b[cols]).all(1)
        middle = b[cols][finite].mean(0) if finite.any() else np.zeros(b.shape[1])
        off = b[cols] - middle
        bunches.append((cols, np.unique(unit[cols]), middle, np.ascontiguousarray(np.column_stack([off, half * (off * off).sum(1)]).T.astype(kind))))
    near, who = np.full((len(a), k), np.inf), np.full((len(a), k), len(b), np.int64)
    for part in (slice(i, i + 1024) for i in range(0, len(a), 1024)):
        for cols, units, middle, against in bunches:
            within = np.sqrt(limit[part])
            some = np.flatnonzero((balls.reaches(a[part], within, units) & balls.crosses(a[part], home[part], within, units)).any(1)) + part.start
            if not len(some):
                continue
            off = a[some] - middle
            lifted = np.column_stack([off, np.full(len(off), -1.0)]).astype(kind)
            enough = half * (off * off).sum(1) - limit[some] / 2 - least
            row, col = np.divmod(np.flatnonzero(lifted @ against >= enough.astype(kind)[:, None]), len(cols))
            row, col = some[row], cols[col]
            other = mine[row] != theirs[col]
            row, col = row[other], col[other]
            if not len(row):
                continue
            exact = np.empty(len(row))
            for few in _chunks(len(row), a.shape[1]):
                gap = a[row[few]] - b[col[few]]
                exact[few] = (gap * gap).sum(1)
            if theirs_limit is not None:
                both = exact <= theirs_limit[col]
                row, col, exact = row[both], col[both], exact[both]
            seen = np.unique(row)
            row, col, exact = np.concatenate([row, np.repeat(seen, k)]), np.concatenate([col, who[seen].ravel()]), np.concatenate([exact, near[seen].ravel()])
            order = np.lexsort((col, exact, row))
            first = np.searchsorted(row[order], seen)[:, None] + np.arange(k)  # each has k entries at least
            near[seen], who[seen] = exact[order][first], col[order][first]
            limit[seen] = np.minimum(limit[seen], near[seen, -1] * (1 + _SLACK))
    row, place = np.nonzero(np.isfinite(near))
    return pa.Table.from_arrays([visitors.column(key).combine_chunks().take(pa.array(row)), members.column(key).combine_chunks().take(pa.array(who[row, place])),
                                 pa.array(near[row, place])], schema=schema)


def _opposite(visitors: pa.Table, members: pa.Table, key: str, balls: Balls) -> pa.Table:
    """The nearest member of another side of each visitor, within the bounds of both."""
    found = [_compare(visitors.slice(0, 0), members.slice(0, 0), key, 1, balls)]
    for side in pc.unique(visitors.column("side")):
        found.append(_compare(visitors.filter(pc.equal(visitors.column("side"), side)), members.filter(pc.not_equal(members.column("side"), side)), key, 1, balls))
    return pa.concat_tables(found)


class _Laid:
    """Stored rows dealt out over units and blocks: what a search needs to know of its members.

    ``members`` are the rows with unit, part, block and whether the reach of their unit is known (``seen``).
    """

    def __init__(self, rows: DataFrame, key: str, centres: int, block: int):
        spark = rows.sparkSession
        self.rows, self.key, n = rows, key, rows.count()
        # Centres are rows, drawn by a hash of the key: dense places get many, so their balls are no fuller than others.
        drawn = rows.orderBy(F.xxhash64(key), key).limit(min(centres, max(1, round(n ** 0.5)))).select("v").collect()
        balls = spark.sparkContext.broadcast(Balls(np.array([r["v"] for r in drawn], float) if drawn else np.zeros((0, 1))))
        placed = written(_assigned(rows, balls), "balls")
        wide = placed.groupBy("ball").agg(F.count(F.lit(1)).alias("_n"), F.max("gap").alias("_r"))
        shells = F.least(F.lit(SHELLS), F.ceil(F.col("_n") / F.lit(float(block))))
        shell = F.when(F.col("_r") > 0, F.least(F.floor(F.col("gap") / F.col("_r") * shells), shells - 1)).otherwise(0)
        shelled = placed.join(F.broadcast(wide), "ball").select(*rows.columns, "ball", "gap", (F.col("ball") * SHELLS + shell).cast("long").alias("unit"))
        sizes = shelled.groupBy("unit").agg(F.first("ball").alias("ball"), F.min("gap").alias("low"), F.max("gap").alias("high"), F.count(F.lit(1)).alias("n"))
        before = W.partitionBy(F.lit(0)).orderBy("unit").rowsBetween(W.unboundedPreceding, -1)  # one row a shell, CENTRES * SHELLS at most
        sizes = written(sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "shells")
        # Each block of members meets each turn of its visitors: a row is sent out about as often as there are blocks and turns.
        self.width = min(WIDEST, max(block, -(-n // SPREAD)))
        self.turns = max(1, -(-n // self.width))
        known = Balls(balls.value.centres, [tuple(r) for r in sizes.orderBy("unit").select("unit", "ball", "low", "high", "n", "start").collect()], block, self.width)
        self.units = spark.sparkContext.broadcast(known)
        self.members = (shelled.join(F.broadcast(sizes.select("unit", "n", "start", (~F.isnan("high")).alias("seen"))), "unit")
                        .withColumn("_parts", F.ceil(F.col("n") / F.lit(float(block))).cast("long")).withColumn("part", self._dealt(0, F.col("_parts")))
                        .select(*rows.columns, "unit", "seen", "part", F.expr(f"(start + (part * n) div _parts) div {self.width}").alias("block")))

    def _dealt(self, salt: int, into: Column) -> Column:
        return F.pmod(F.xxhash64(self.key, F.lit(salt)), into)

    def bounded(self, k: int) -> DataFrame:
        """The members with a bound for the distance of their k-th neighbour."""
        return self.members.groupBy("unit", "part").applyInArrow(lambda t: _bounds(t, k), _all_fields(self.members, "bound double"))

    def met(self, visitors: DataFrame, members: DataFrame, k: int, compare, turns: int) -> DataFrame:
        """(key, neighbour, distance2) as ``compare`` finds them where visitors, with bounds, meet the members of the blocks they reach."""
        key, units = self.key, self.units
        sent = [c for c in visitors.columns if c in (key, "v", "side", "unit")]

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v, bound = _matrix(batch.column("v")), batch.column("bound").to_numpy()
                for at, row, best in units.value.reached(v, bound, k):
                    some = batch.select(sent).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(best), pa.array(np.full(len(row), at))], names=[*sent, "bound", "block"])

        guests = visitors.mapInArrow(visits, _all_fields(visitors.select(sent), "bound double, block long")).withColumn("turn", self._dealt(1, F.lit(turns)))
        hosts = members.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))))
        kind = self.rows.schema[key].dataType.simpleString()
        return guests.groupBy("block", "turn").cogroup(hosts.groupBy("block", "turn")).applyInArrow(
            lambda a, b: compare(a, b, key, units.value), _fields(self.rows, key, f"neighbour {kind}, distance2 double"))


def _nearest(pairs: DataFrame, key: str, k: int, other: str = "neighbour") -> DataFrame:
    place = F.row_number().over(W.partitionBy(key).orderBy("distance2", other))
    return pairs.withColumn("place", place).filter(F.col("place") <= k)


def neighbours_of_spots(spots: DataFrame, key: str, k: int = 5, centres: int = CENTRES, block: int = BLOCK) -> DataFrame:
    """(key, neighbour, distance2, place) for rows (key, v). Few rows should share one vector; see :func:`nearest_neighbours`."""
    return _search(written(spots.select(key, "v"), "spots"), key, k, centres, block)


def _search(rows: DataFrame, key: str, k: int, centres: int, block: int) -> DataFrame:
    """The search itself, over stored rows."""
    laid = _Laid(rows, key, centres, block)
    pairs = laid.met(laid.bounded(k), laid.members.select(key, "v", "unit", "block"), k, lambda a, b, key, units: _compare(a, b, key, k, units), laid.turns)
    return _nearest(pairs, key, k)


def opposite_neighbours(spots: DataFrame, key: str, centres: int = CENTRES, block: int = BLOCK) -> DataFrame:
    """(key, neighbour) of all rows that may be the nearest row of a row of another side while that is theirs.

    ``spots`` has key, v, side and kin. Rows without a side are in no such pair, but may be nearer than the other side. Rows of one kin
    are likely to be near: the first of them gives the others a bound. Two rows that are each other's nearest are within the bounds of
    both, and each is the other's nearest of another side. So first rows meet those of other sides alone, within both bounds; only
    what is left of them, a pair a row at most, is then compared with all rows.
    """
    laid = _Laid(written(spots.select(key, "v", "side", "kin"), "spots"), key, centres, block)
    sided = F.when(F.col("seen") & F.col(key).isNotNull(), F.col("side"))
    rows = written(laid.bounded(1).withColumn("side", sided).drop("part", "seen"), "bounds")
    first = rows.filter(F.col("kin").isNotNull() & F.col("side").isNotNull()).groupBy("kin").agg(F.min_by(F.struct(key, "v"), key).alias("_first"))
    far = F.sqrt(F.aggregate(F.zip_with("v", "_first.v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    lower = F.when(F.col("side").isNotNull() & (F.col(key) != F.col(f"_first.{key}")) & (far < F.col("bound")), far).otherwise(F.col("bound"))
    kin = rows.filter(F.col("kin").isNotNull()).join(first, "kin", "left").withColumn("bound", lower)
    known = written(rows.filter(F.col("kin").isNull()).unionByName(kin.select(rows.columns)).drop("kin"), "known")
    # The rows of the side with the widest bounds stay where they are; the others visit them.
    sides = known.filter(F.col("side").isNotNull()).groupBy("side").agg(F.sum("bound").alias("_reach"))
    widest, n = sides.agg(F.max_by("side", F.struct("_reach", "side")), F.count(F.lit(1))).first()
    hosts = known.filter(F.col("side") == F.lit(widest) if n < 3 else F.col("side").isNotNull())
    pairs = laid.met(known.filter(F.col("side") != F.lit(widest)), hosts, 1, _opposite, laid.turns)
    left = written(_nearest(_nearest(pairs, key, 1), "neighbour", 1, key).select(key, "neighbour", "distance2"), "opposite")
    ends = left.select(key, "distance2").unionByName(left.select(F.col("neighbour").alias(key), "distance2")).groupBy(key).agg(F.min("distance2").alias("_d"))
    asked = known.join(ends, key).withColumn("bound", F.least("bound", F.sqrt("_d") * F.lit(1 + _SLACK))).drop("_d")
    n = 2 * left.count()
    turns = max(1, min(4, -(-n // BLOCK)), -(-n // laid.width))
    pairs = laid.met(asked, known.select(key, "v", "unit", "block"), 1, lambda a, b, key, units: _compare(a, b, key, 1, units), turns)
    return written(_nearest(pairs, key, 1).select(key, "neighbour"), "near")


def nearest_neighbours(df: DataFrame, key: str, columns: list[str], k: int = 5, centres: int = CENTRES, block: int = BLOCK) -> DataFrame:
    """The k nearest other rows of each row: (key, neighbour, distance2, place), ties to the lower key.

    Rows with a missing or non-finite coordinate have no neighbours and are none. Rows at one spot are searched for together: of each
    spot only the k + 1 lowest keys can be anybody's neighbour.
    """
    rows = df.select(key, vector(columns).alias("v")).filter(F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))
    lowest = rows.withColumn("_i", F.row_number().over(W.partitionBy("v").orderBy(key))).filter(F.col("_i") <= k + 1)
    spots = written(lowest.groupBy("v").agg(F.array_sort(F.collect_list(key)).alias("ids")).withColumn("spot", F.get("ids", F.lit(0))), "merged")
    near = _search(spots.select(F.col("spot").alias(key), "v"), key, k, centres, block)
    other = near.select(F.col(key).alias("spot"), F.col("neighbour").alias("_to"), "distance2").join(
        spots.select(F.col("spot").alias("_to"), "ids"), "_to").select("spot", F.explode("ids").alias("neighbour"), "distance2")
    own = spots.select("spot", F.explode("ids").alias("neighbour"), F.lit(0.0).alias("distance2"))
    # At most (k + 1) ** 2 entries a spot.
    options = own.unionByName(other).groupBy("spot").agg(F.array_sort(F.collect_list(F.struct("distance2", "neighbour"))).alias("_near"))
    full = rows.join(spots.select("v", "spot"), "v").join(options, "spot")
    others = F.slice(F.filter("_near", lambda e: e["neighbour"] != F.col(key)), 1, k)
    listed = full.select(key, F.posexplode(others).alias("_i", "_e"))
    return listed.select(key, F.col("_e.neighbour").alias("neighbour"), F.col("_e.distance2").alias("distance2"), (F.col("_i") + 1).alias("place"))
