"""Joins on intervals: overlap, containment, nearest feature, lift-over.

Intervals are half-open [start, end) unless ``closed`` is set. Candidates meet by an equality on
(keys, role, level, bin). An interval lives on the finest level on which it fits into two bins or so;
a pair meets on the coarser of its two levels, in the one bin that holds the greater of the two
starts. In role 0 the left interval stands on its own level and the right one, if it is shorter, on
that level too; in role 1 it is the other way round. So two short intervals never meet on a coarse
level, an interval costs a few rows however long it is, and no pair comes out twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bin widths of the levels, finest first.
LEVELS = (1 << 17, 1 << 22, 1 << 27)


@dataclass(frozen=True)
class Span:
    """Names of the interval columns of a table."""

    start: str = "start"
    end: str = "end"
    closed: bool = False

    def bounds(self) -> tuple[Column, Column]:
        """Half-open bounds with reversed coordinates swapped; null if either is."""
        a, b = F.col(f"`{self.start}`").cast("bigint"), F.col(f"`{self.end}`").cast("bigint")
        known = a.isNotNull() & b.isNotNull()
        return F.when(known, F.least(a, b)), F.when(known, F.greatest(a, b) + (1 if self.closed else 0))


def normalise(df: DataFrame, start: str, end: str) -> DataFrame:
    """Swap reversed coordinates; a null in either leaves both as they are."""
    s, e = F.col(start), F.col(end)
    known = s.isNotNull() & e.isNotNull()
    return df.withColumns({start: F.when(known, F.least(s, e)).otherwise(s), end: F.when(known, F.greatest(s, e)).otherwise(e)})


def expand(df: DataFrame, start: str, end: str, flank: int, size: Column | int | None = None) -> DataFrame:
    """Widen by ``flank`` on both sides, clipped to [0, size]; intervals that end up empty are left out."""
    hi = F.col(end) + flank
    if size is not None:
        hi = F.least(hi, size if isinstance(size, Column) else F.lit(size))
    out = df.withColumns({start: F.greatest(F.col(start) - flank, F.lit(0)), end: hi})
    return out.where(F.col(start) < F.col(end))


def flip_to_plus(df: DataFrame, start: str, end: str, strand: str, length: str) -> DataFrame:
    """Coordinates of '-' rows counted from the other end (half-open)."""
    minus = F.col(strand) == "-"
    return df.withColumns({start: F.when(minus, F.col(length) - F.col(end)).otherwise(F.col(start)), end: F.when(minus, F.col(length) - F.col(start)).otherwise(F.col(end))})


def _binned(df: DataFrame, lo: Column, hi: Column, tag: str, left: bool) -> DataFrame:
    df = df.withColumns({f"__{tag}s": lo, f"__{tag}e": hi}).where(F.col(f"__{tag}s").isNotNull() & F.col(f"__{tag}e").isNotNull())
    s, last = F.col(f"__{tag}s"), F.greatest(F.col(f"__{tag}e") - 1, F.col(f"__{tag}s"))
    own = F.lit(len(LEVELS) - 1)
    for i in reversed(range(len(LEVELS) - 1)):
        own = F.when(last - s < LEVELS[i], F.lit(i)).otherwise(own)

    def at_level(i: int, w: int, role: int, here: Column) -> Column:
        bins = F.transform(F.sequence(F.floor(s / w), F.floor(last / w)), lambda b: F.struct(F.lit(role).alias("role"), F.lit(i).alias("lv"), b.alias("bin")))
        return F.when(here, bins).otherwise(F.array().cast("array<struct<role:int,lv:int,bin:bigint>>"))

    o = F.col(f"__{tag}o")
    cells = [at_level(i, w, 0, o == i if left else o <= i) for i, w in enumerate(LEVELS)]
    cells += [at_level(i, w, 1, o < i if left else o == i) for i, w in enumerate(LEVELS)]
    df = df.withColumn(f"__{tag}o", own).withColumn("__c", F.explode(F.flatten(F.array(*cells))))
    return df.select("*", *(F.col(f"__c.{c}").alias(f"__{tag}{c}") for c in ("role", "lv", "bin"))).drop("__c", f"__{tag}o")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], lspan: Span, rspan: Span, slack: int = 0, touching: bool = False) -> DataFrame:
    """Every overlapping pair once, with ``overlap`` (bp) and both sides' columns.

    Column names of the two sides must differ; ``keys`` are (left, right) names that must be equal.
    ``slack`` also pairs intervals that are up to so many positions apart, with an overlap of 0;
    ``touching`` those without a position between them. Rows with a null key or bound pair with none.
    """
    near = slack + (1 if touching else 0)
    ls, le = lspan.bounds()
    rs, re_ = rspan.bounds()
    a = _binned(left, ls - near, le + near, "l", True)
    b = _binned(right, rs, re_, "r", False)
    lo = F.greatest(F.col("__ls"), F.col("__rs"))
    width = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in LEVELS)), F.col("__llv") + 1)
    on = [a[x] == b[y] for x, y in keys] + [
        a["__lrole"] == b["__rrole"],
        a["__llv"] == b["__rlv"],
        a["__lbin"] == b["__rbin"],
        F.col("__ls") < F.col("__re"),
        F.col("__rs") < F.col("__le"),
        F.floor(lo / width) == a["__lbin"],
    ]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    real_lo = F.greatest(F.col("__ls") + near, F.col("__rs"))
    real_hi = F.least(F.col("__le") - near, F.col("__re"))
    return a.join(b, cond).withColumn("overlap", F.greatest(real_hi - real_lo, F.lit(0).cast("bigint"))).select(*(F.col(f"`{c}`") for c in [*left.columns, *right.columns]), "overlap")


def overlap_semi(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], lspan: Span, rspan: Span, row_id: str, anti: bool = False, slack: int = 0) -> DataFrame:
    """Left rows that overlap any right row, or none with ``anti``; ``row_id`` identifies a left row.

    Right intervals that overlap are made one first, so that a left row meets each covered stretch
    once, however deep it is covered.
    """
    from loomspan.operators.islands import merge_islands

    rs, re_ = rspan.bounds()
    own = [f"__q{i}" for i in range(len(keys))]
    cover = merge_islands(right.select(*(F.col(f"`{q}`").alias(o) for (_, q), o in zip(keys, own)), rs.alias("__qs"), re_.alias("__qe")), own, "__qs", "__qe", -1)
    hits = overlap_join(left.select(row_id, *dict.fromkeys([*(k for k, _ in keys), lspan.start, lspan.end])), cover.drop("n"), [(k, o) for (k, _), o in zip(keys, own)], lspan, Span("__qs", "__qe"), slack)
    return left.join(hits.select(row_id).distinct(), row_id, "left_anti" if anti else "left_semi")


def largest_overlap(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], lspan: Span, rspan: Span, row_id: str, ties: list[Column]) -> DataFrame:
    """For every left row that overlaps anything, its pair with the greatest overlap; ties by ``ties``."""
    w = Window.partitionBy(row_id).orderBy(F.desc("overlap"), *ties)
    pairs = overlap_join(left, right, keys, lspan, rspan)
    return pairs.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def lift_over(points: DataFrame, blocks: DataFrame, row_id: str, keys: list[tuple[str, str]], pspan: Span, first: list[Column] | None = None) -> DataFrame:
    """Map intervals that lie inside one alignment block to the block's target.

    ``blocks`` has q_start, q_end, t_name, t_start, t_end, block_strand (half-open). Result per point:
    the id, ``status`` ('lifted', 'ambiguous' if several blocks contain it, 'no_block') and t_name,
    lifted_start, lifted_end (null unless lifted). With ``first`` the first block in that order wins.
    """
    s, e = pspan.bounds()
    inside = overlap_join(points, blocks, keys, pspan, Span("q_start", "q_end")).where((F.col("q_start") <= s) & (e <= F.col("q_end")))
    plus = F.col("block_strand") == "+"
    inside = inside.withColumns({"lifted_start": F.when(plus, F.col("t_start") + s - F.col("q_start")).otherwise(F.col("t_end") - (e - F.col("q_start"))), "lifted_end": F.when(plus, F.col("t_start") + e - F.col("q_start")).otherwise(F.col("t_end") - (s - F.col("q_start")))})
    if first:
        w = Window.partitionBy(row_id).orderBy(*first)
        hit = inside.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").withColumn("n_blocks", F.lit(1).cast("bigint")).select(row_id, "n_blocks", "t_name", "lifted_start", "lifted_end")
    else:
        hit = inside.groupBy(row_id).agg(F.count(F.lit(1)).alias("n_blocks"), F.first("t_name").alias("t_name"), F.first("lifted_start").alias("lifted_start"), F.first("lifted_end").alias("lifted_end"))
    out = points.select(row_id).join(hit, row_id, "left")
    one = F.col("n_blocks") == 1
    return out.select(row_id, F.when(one, "lifted").when(F.col("n_blocks") > 1, "ambiguous").otherwise("no_block").alias("status"), *(F.when(one, F.col(c)).alias(c) for c in ("t_name", "lifted_start", "lifted_end")))


def nearest(points: DataFrame, features: DataFrame, keys: list[str], point: str, row_id: str, fspan: Span, fid: str, fstrand: str | None = None, shard: int = LEVELS[1], point_end: str | None = None) -> DataFrame:
    """The nearest feature of every point, as a two-sided as-of join; no range join.

    Features that contain the point have distance 0. Otherwise the nearest end at or before and the
    nearest start after it compete; ties go to the left, then to the least feature id. ``signed`` is
    negative upstream: to the left of a '+' feature, to the right of a '-' one. Points of a key without
    features get nulls. With ``point_end`` the points are half-open intervals [point, point_end): features
    that overlap them have distance 0, the left distance counts from the start and the right from the end.

    Points and feature ends lie on one axis that is cut into shards. Windows run within a (key, shard);
    what the shards before and after hold is carried in as one row per shard, so a hot key is spread.
    """
    s, e = fspan.bounds()
    strand = F.col(fstrand) if fstrand else F.lit("+")
    f = features.where(s.isNotNull() & e.isNotNull()).select(*keys, F.struct(s.alias("s"), e.alias("e"), F.col(fid).alias("fid"), strand.alias("st")).alias("f"))
    kind = f.schema["f"].dataType
    nothing, nobody = F.lit(None).cast(kind), F.lit(None).cast(dict(points.dtypes)[row_id])
    opens = f.select(*keys, F.col("f.s").alias("at"), F.lit(1).alias("ord"), nobody.alias(row_id), F.lit(None).cast("bigint").alias("__last"), F.col("f").alias("opened"), nothing.alias("ended"))
    ends = f.select(*keys, (F.col("f.e") - 1).alias("at"), F.lit(0).alias("ord"), nobody.alias(row_id), F.lit(None).cast("bigint").alias("__last"), nothing.alias("opened"), F.col("f").alias("ended"))
    p = points.where(F.col(point).isNotNull()).select(*keys, F.col(point).cast("bigint").alias("at"), F.lit(2).alias("ord"), F.col(row_id), ((F.greatest(F.coalesce(F.col(point_end), F.col(point) + 1), F.col(point) + 1) if point_end else F.col(point) + 1) - 1).cast("bigint").alias("__last"), nothing.alias("opened"), nothing.alias("ended"))
    reach_of = F.struct(F.col("opened.e"), F.col("opened.s"), F.col("opened.fid"), F.col("opened.st"))
    axis = opens.unionByName(ends).unionByName(p).withColumn("__shard", F.floor(F.col("at") / shard))

    # what each shard hands on: its furthest reach, its last end, its first start
    had, has = F.col("ended").isNotNull(), F.col("opened").isNotNull()
    facts = axis.groupBy(*keys, "__shard").agg(
        F.max(F.when(has, reach_of)).alias("r"),
        F.min(F.when(had, F.struct((-F.col("at")).alias("o"), F.col("ended.fid").alias("t"), F.col("ended").alias("f")))).getField("f").alias("l"),
        F.min(F.when(has, F.struct(F.col("at").alias("o"), F.col("opened.fid").alias("t"), F.col("opened").alias("f")))).getField("f").alias("n"),
    )
    order = Window.partitionBy(*keys).orderBy("__shard")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy(F.desc("__shard")).rowsBetween(Window.unboundedPreceding, -1)
    carried = facts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__shard").alias("__ks"), F.max("r").over(before).alias("__r"), F.last("l", True).over(before).alias("__l"), F.last("n", True).over(after).alias("__n"))

    tie = F.coalesce(F.col("opened.fid"), F.col("ended.fid"))
    back = Window.partitionBy(*keys, "__shard").orderBy("at", "ord", F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, "__shard").orderBy(F.desc("at"), F.desc("ord"), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    axis = axis.withColumns({"reach": F.max(F.when(has, reach_of)).over(back), "left": F.last("ended", ignorenulls=True).over(back), "right": F.last("opened", ignorenulls=True).over(ahead)}).where("ord = 2")
    on = F.col("__shard") == F.col("__ks")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    axis = axis.join(carried, on, "left")
    axis = axis.withColumns({"reach": F.greatest("reach", "__r"), "left": F.coalesce("left", "__l"), "right": F.coalesce("right", "__n")})
    dl, dr = F.col("at") - F.col("left.e") + 1, F.col("right.s") - F.col("__last")
    # the feature that reaches furthest right among those opened so far tells whether the point is inside one
    over = F.coalesce(F.col("reach.e") > F.col("at"), F.lit(False))
    begins = F.coalesce(F.col("right.s") <= F.col("__last"), F.lit(False)) & F.lit(point_end is not None)
    inside = over | begins
    take_left = dl.isNotNull() & (dr.isNull() | (dl <= dr))
    out = axis.withColumns(
        {
            "fid": F.when(over, F.col("reach.fid")).when(inside, F.col("right.fid")).when(take_left, F.col("left.fid")).otherwise(F.col("right.fid")),
            "distance": F.when(inside, F.lit(0)).when(take_left, dl).otherwise(dr).cast("bigint"),
            "side": F.when(inside, "inside").when(take_left, "left").when(dr.isNotNull(), "right"),
            "fst": F.when(over, F.col("reach.st")).when(inside, F.col("right.st")).when(take_left, F.col("left.st")).otherwise(F.col("right.st")),
        }
    )
    # a feature on the left lies before the point, so the point is downstream of it on '+'
    sign = F.when(F.col("side") == "inside", 0).when((F.col("side") == "left") == (F.col("fst") == "+"), 1).otherwise(-1)
    return out.select(row_id, F.col("fid").alias(f"nearest_{fid}"), "distance", "side", (sign * F.col("distance")).cast("bigint").alias("signed"))


def _ordinals(rows: DataFrame, keys: list[str], at: str, ties: list, shard: int) -> DataFrame:
    """Adds ``__n``: how many rows with ``__f`` = 1 stand at or before a row in the order of ``at``, ``ties``
    within the keys. Rows are counted within shards of the axis; what the shards in front hold is added,
    so that a hot key is spread."""
    rows = rows.withColumn("__sh", F.floor(F.col(at) / shard))
    sums = rows.groupBy(*keys, "__sh").agg(F.sum("__f").alias("__c"))
    before = Window.partitionBy(*keys).orderBy("__sh").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__sh").alias("__ks"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__b"))
    on = F.col("__sh") == F.col("__ks")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    here = Window.partitionBy(*keys, "__sh").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__n", F.sum("__f").over(here)).join(sums, on).withColumn("__n", F.col("__n") + F.col("__b")).drop("__sh", "__ks", "__b", *(f"__k{i}" for i in range(len(keys))))


def flank_neighbours(points: DataFrame, features: DataFrame, keys: list[str], span: Span, row_id: str, fspan: Span, fid: str, flank: int, n: int, shard: int = LEVELS[1]) -> DataFrame:
    """The ``n`` closest features per side less than ``flank`` away: row_id, side, rank, fid, distance.

    Ties go to the least feature id; features that overlap a point's interval don't count. Features are
    numbered along the axis on either side, and a point asks for the n numbers next to its own: however
    dense the features are, it meets 2 n of them.
    """
    s, e = span.bounds()
    fs, fe = fspan.bounds()
    f = features.where(fs.isNotNull() & fe.isNotNull()).select(*keys, fs.alias("__fs"), fe.alias("__fe"), F.col(fid).alias("__id"))
    p = points.where(s.isNotNull() & e.isNotNull()).select(*keys, F.col(row_id).alias("__row"), s.alias("__ps"), e.alias("__pe"))
    nobody, noid = F.lit(None).cast(dict(p.dtypes)["__row"]), F.lit(None).cast(dict(f.dtypes)["__id"])
    out = None
    for side in ("left", "right"):
        left = side == "left"
        # on the left a feature stands at its end and counts for the points at or behind it; on the right it
        # stands at its start, and counts as passed by the points whose end lies behind it
        marks = f.select(*keys, F.col("__fe" if left else "__fs").alias("__at"), F.lit(0 if left else 1).alias("__o"), F.lit(1).alias("__f"), nobody.alias("__row"), "__id")
        asks = p.select(*keys, F.col("__ps" if left else "__pe").alias("__at"), F.lit(1 if left else 0).alias("__o"), F.lit(0).alias("__f"), "__row", noid.alias("__id"))
        axis = _ordinals(marks.unionByName(asks), keys, "__at", ["__o", F.desc("__id") if left else F.asc("__id")], shard)
        numbered = axis.where("__f = 1").select(*(F.col(k).alias(f"__m{i}") for i, k in enumerate(keys)), F.col("__n").alias("__mn"), F.col("__at").alias("__mat"), F.col("__id").alias("__mid"))
        steps = F.sequence(F.lit(0), F.lit(n - 1))
        wanted = axis.where("__f = 0").select(*keys, "__row", "__at", "__n", F.explode(steps).alias("__i")).withColumn("__want", F.col("__n") - F.col("__i") if left else F.col("__n") + 1 + F.col("__i"))
        on = F.col("__want") == F.col("__mn")
        for i, k in enumerate(keys):
            on = on & (F.col(k) == F.col(f"__m{i}"))
        distance = F.col("__at") - F.col("__mat") if left else F.col("__mat") - F.col("__at")
        got = wanted.join(numbered, on).withColumn("distance", distance).where(F.col("distance") < flank)
        got = got.select(F.col("__row").alias(row_id), F.lit(side).alias("side"), (F.col("__i") + 1).alias("rank"), F.col("__mid").alias(fid), "distance")
        out = got if out is None else out.unionByName(got)
    return out


def strand_flanks(df: DataFrame, span: Span, strand: str, distance: int) -> DataFrame:
    """Adds up_start, up_end, down_start, down_end (half-open, not below 0), sides swapped on '-'."""
    s, e = span.bounds()
    left = F.greatest(s - distance, F.lit(0)), s
    right = e, e + distance
    minus = F.col(strand) == "-"
    pick = lambda a, b: F.when(minus, a).otherwise(b)
    return df.withColumns({"up_start": pick(right[0], left[0]), "up_end": pick(right[1], left[1]), "down_start": pick(left[0], right[0]), "down_end": pick(left[1], right[1])})


def nearest_ordinal(left: DataFrame, right: DataFrame, keys: list[str], x: str, row_id: str, order: str, rid: str) -> DataFrame:
    """For every left row the right row of the same keys with the nearest ordinal; ties to the lower one,
    then to the least id. A null ordinal, and keys that the right side lacks, give nulls.

    Both sides lie on one axis that is cut into ranges; windows run within a (range, key), and what the
    ranges before and after hold is carried in as one row per range and key, so a hot key is spread.
    """
    from loomspan.runtime import Stored

    p = left.select(*keys, F.col(x).alias("at"), F.lit(1).alias("o"), F.col(row_id), F.lit(None).cast(right.schema[order].dataType).alias("v"), F.lit(None).cast(right.schema[rid].dataType).alias("r"))
    q = right.where(F.col(order).isNotNull()).select(*keys, F.col(order).alias("at"), F.lit(0).alias("o"), F.lit(None).cast(left.schema[row_id].dataType).alias(row_id), F.col(order).alias("v"), F.col(rid).alias("r"))
    both = Stored(p.unionByName(q).repartitionByRange(*keys, "at").withColumn("__p", F.spark_partition_id()), "ordinals").df
    back = Window.partitionBy("__p", *keys).orderBy("at", "o", F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("__p", *keys).orderBy(F.desc("at"), F.desc("o"), F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    has = F.col("o") == 0
    facts = both.groupBy("__p", *keys).agg(F.min(F.when(has, F.struct((-F.col("v")).alias("v"), "r"))).alias("__h"), F.min(F.when(has, F.struct("v", "r"))).alias("__n"))
    facts = facts.withColumn("__l", F.when(F.col("__h").isNotNull(), F.struct((-F.col("__h.v")).cast(right.schema[order].dataType).alias("v"), F.col("__h.r").alias("r"))))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, -1)
    carried = facts.select(F.col("__p").alias("__q"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.last("__l", True).over(before).alias("__cb"), F.last("__n", True).over(after).alias("__ca"))
    on = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    item = F.when(has, F.struct("v", "r"))
    both = both.withColumns({"b": F.last(item, True).over(back), "a": F.last(item, True).over(ahead)}).where("o = 1").join(carried, on, "left")
    both = both.withColumns({"b": F.coalesce("b", "__cb"), "a": F.coalesce("a", "__ca")})
    db, da = F.col("at") - F.col("b.v"), F.col("a.v") - F.col("at")
    left_wins = db.isNotNull() & (da.isNull() | (db <= da))
    return both.select(row_id, F.when(left_wins, F.col("b.r")).when(F.col("at").isNotNull(), F.col("a.r")).alias(rid), F.when(left_wins, db).otherwise(da).alias("distance"))
