"""Scans over range-sorted rows, and the relational joins that are sweeps: as-of, one-to-one by nearness, claims of intervals.

Rows are range-partitioned by their order and stored, so a key with a third of all rows lies in many slices. A scan is a
window inside each slice; what it would have carried over comes from one row a slice (as many as there are partitions), which are scanned and
joined back by broadcast. No pairs are made, nothing is collected, and all of it is SQL functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.sources import scratch


@dataclass(frozen=True)
class Step:
    """What a scan adds to each row: the total or highest value up to it, or the last (next) value that is not null.

    strict leaves the row itself out.
    """

    kind: str
    value: Column
    strict: bool = False


def total(value: Column, strict: bool = False) -> Step:
    return Step("total", value, strict)


def highest(value: Column, strict: bool = False) -> Step:
    return Step("highest", value, strict)


def last(value: Column, strict: bool = False) -> Step:
    return Step("last", value, strict)


def following(value: Column, strict: bool = False) -> Step:
    return Step("following", value, strict)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    own = scratch.path(df.sparkSession, name)
    df.write.parquet(own)
    return df.sparkSession.read.schema(df.schema).parquet(own)


def lined_up(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df range-partitioned by its columns order (ascending, nulls first) and stored; column slice_ tells the partition."""
    return stored(df.repartitionByRange(*order).withColumn("slice_", F.spark_partition_id()), "lined")


def scan(lined: DataFrame, order: Sequence[str], **steps: Step) -> DataFrame:
    """Adds a column for each step to rows from `lined_up`. Rows that tie in order have any order among themselves."""
    rows = lined.withColumns({f"in_{n}": s.value for n, s in steps.items()})
    within, place = Window.partitionBy("slice_").orderBy(*order), F.struct(*order)
    up_to = {strict: within.rowsBetween(Window.unboundedPreceding, -1 if strict else 0) for strict in (True, False)}
    # What follows is what came before in the other order: a frame from a row to the end would be read again for each row.
    backward = Window.partitionBy("slice_").orderBy(*[F.desc_nulls_last(c) for c in order])
    from_on = {strict: backward.rowsBetween(Window.unboundedPreceding, -1 if strict else 0) for strict in (True, False)}
    before = Window.orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy("slice_").rowsBetween(1, Window.unboundedFollowing)
    here, ends, brought, out = {}, [], [], {}
    for n, s in steps.items():
        x, own, edge, carry = F.col(f"in_{n}"), F.col(f"own_{n}"), F.col(f"edge_{n}"), F.col(f"carry_{n}")
        known = F.when(x.isNotNull(), place)
        if s.kind == "total":
            here[n], end, over = F.sum(x).over(up_to[s.strict]), F.sum(x), F.sum(edge).over(before)
            out[n] = F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif s.kind == "highest":
            here[n], end, over = F.max(x).over(up_to[s.strict]), F.max(x), F.max(edge).over(before)
            out[n] = F.greatest(own, carry)
        elif s.kind == "last":
            here[n], end, over = F.last(x, True).over(up_to[s.strict]), F.max_by(x, known), F.last(edge, True).over(before)
            out[n] = F.coalesce(own, carry)
        else:
            here[n], end, over = F.last(x, True).over(from_on[s.strict]), F.min_by(x, known), F.first(edge, True).over(behind)
            out[n] = F.coalesce(own, carry)
        ends.append(end.alias(f"edge_{n}"))
        brought.append(over.alias(f"carry_{n}"))
    edges = rows.groupBy("slice_").agg(*ends).select("slice_", *brought)  # one row a partition
    done = rows.withColumns({f"own_{n}": w for n, w in here.items()}).join(F.broadcast(edges), "slice_")
    return done.withColumns(out).drop(*[f"{p}_{n}" for p in ("in", "own", "carry") for n in steps])


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, direction: str = "backward", ties: Sequence[str] = (), reach: Column | None = None) -> DataFrame:
    """Every row of left with the row of right of the same keys that is nearest to it by the column at: column match, a struct.

    direction is backward (at or before), forward (at or after) or nearest; equally near, the earlier one. Of right rows with equal keys and
    at, the one with the smallest columns ties counts, then the smallest of the other columns. reach: a condition on left's columns
    and match, beyond which match is null. Null keys or times match nothing; left rows stay, repeats included.
    """
    mine = [c for c in right.columns if c not in (*by, at, *ties)]
    theirs = right.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.min(F.struct(*ties, *mine)).alias("chosen"))  # min: partial before the shuffle
    whole = F.struct(*[F.col(c) for c in (*by, at)], *[F.col(f"chosen.{c}").alias(c) for c in (*ties, *mine)])
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate((*by, at))]
    # At equal times a right row stands before the left one, so going back finds it; going forward alone it must stand behind.
    side = 2 if direction == "forward" else 0
    theirs = theirs.select(*keys, F.lit(side).alias("side"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("row"), whole.alias("found"))
    both = left.select(*keys, F.lit(1).alias("side"), F.struct("*").alias("row"), F.lit(None).cast(theirs.schema["found"].dataType).alias("found")).unionByName(theirs)
    order = [f"k{i}" for i in range(len(by) + 1)] + ["side"]
    steps = {"earlier": last(F.col("found"))} if direction != "forward" else {}
    steps |= {"later": following(F.col("found"))} if direction != "backward" else {}
    met = scan(lined_up(both, order), order, **steps).where("side = 1")
    time = F.col(f"k{len(by)}")

    def same_key(name: str) -> Column:
        ok = time.isNotNull()
        for i, c in enumerate(by):
            ok = ok & (F.col(name)[c] == F.col(f"k{i}"))
        return F.when(ok, F.col(name))

    if direction == "nearest":
        early, late = same_key("earlier"), same_key("later")
        kind = dict(right.dtypes)[at]
        micros = lambda c: F.unix_micros(c.cast("timestamp"))
        number = {"timestamp": micros, "timestamp_ntz": micros, "date": F.unix_date}.get(kind, lambda c: c)
        nearer = number(time) - number(early[at]) <= number(late[at]) - number(time)
        match = F.when(late.isNull() | nearer, early).otherwise(late)
    else:
        match = same_key("earlier" if direction == "backward" else "later")
    out = met.select("row.*", match.alias("match"))
    return out if reach is None else out.withColumn("match", F.when(reach, F.col("match")))


#: Rows of a cluster up to which it is settled as one row, in the order of priority; larger ones go in rounds.
FEW = 512


def _clusters(rows: DataFrame, by: Sequence[str], start: str, end: str, last_: str) -> DataFrame:
    """Adds cluster: a number for each chain of intervals of the same keys that overlap. A key's first interval opens one."""
    order = [*by, start, end, last_]
    lined = lined_up(rows, order)
    # Rows are sorted by key, so the highest (key, end) so far is of this key unless this is its first row.
    seen = scan(lined, order, reached=highest(F.struct(*by, end), strict=True))
    same = F.lit(True)
    for c in by:
        same = same & F.col("reached")[c].eqNullSafe(F.col(c))
    opens = F.col("reached").isNull() | ~same | (F.col(start) >= F.col("reached")[end])
    return scan(seen.withColumn("opens_", opens.cast("int")).drop("reached"), order, cluster=total(F.col("opens_"))).drop("opens_", "slice_")


def claim_intervals(df: DataFrame, by: Sequence[str], start: str, end: str, priority: Sequence[str], few: int = FEW) -> DataFrame:
    """The rows whose interval [start, end) is free when all rows claim theirs one by one, in the order of the columns priority.

    Intervals of different keys by never meet; null keys are one key. Intervals that overlap in a chain form a cluster, and clusters never meet: one of at most
    `few` rows is settled as one row. Larger ones go in rounds: each one's first row by priority has its claim, which no earlier row can touch, and the rows that
    overlap it go; what is left falls apart into smaller clusters. An empty interval collides only inside another. Rows with a null
    start or end claim nothing and go; rows that repeat share their priority, and one of them stays (an empty one with all its repeats).
    """
    short = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*[F.col(c).alias(s) for c, s in short.items()], F.monotonically_increasing_id().alias("id_"))
    keys, s, e = [short[c] for c in by], short[start], short[end]
    first = [*dict.fromkeys([*[short[c] for c in priority], s, e]), "id_"]
    columns = [*first, *[c for c in rows.columns if c not in first]]
    few = 0 if "map<" in rows.schema.simpleString() else few  # maps have no order, and a cluster is sorted by whole rows
    meets = lambda x, y: ~((x[e] <= y[s]) | (x[s] >= y[e]))
    left, done = rows, []
    while True:
        held = stored(_clusters(left, keys, s, e, "id_"), "clusters")
        many = stored(held.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select("cluster"), "many")
        last_round = many.isEmpty()
        if few:
            small = held if last_round else held.join(many, "cluster", "left_anti")
            asked = small.repartition("cluster").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("asked"))
            took = F.aggregate("asked", F.slice("asked", 1, 0), lambda out, x: F.when(F.exists(out, lambda y: meets(x, y)), out).otherwise(F.concat(out, F.array(x))))
            done.append(asked.select(F.explode(F.when(F.size("asked") == 1, F.col("asked")).otherwise(took)).alias("x")).select("x.*").select(*rows.columns))
        if last_round:
            break
        big = held.join(many, "cluster")
        best = big.groupBy("cluster").agg(F.min(F.struct(*first)).alias("best"))
        met = big.join(best, "cluster")
        won = F.struct(*first) == F.col("best")
        done.append(met.where(won).select(*rows.columns))
        left = stored(met.where(~won & ~meets({s: F.col(s), e: F.col(e)}, F.col("best"))).select(*rows.columns), "claims")
    out = rows.limit(0)
    for part in done:
        out = out.unionByName(part)
    return out.select(*[F.col(k).alias(c) for c, k in short.items()])


def _ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds rank_ (0, 1, ...) inside each group, by a scan: a group may be any share of the rows."""
    whole = [*group, *order]
    counted = stored(scan(lined_up(rows, whole), whole, place_=total(F.lit(1), strict=True)).drop("slice_"), "counted")
    first = counted.groupBy(*group).agg(F.min("place_").alias("first_"))
    return counted.join(first, list(group)).withColumn("rank_", F.col("place_") - F.col("first_")).drop("place_", "first_")


def match_one_to_one(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, id_col: str, reach: int, behind: int = 0) -> DataFrame:
    """(keys, a_id, b_id, gap): what taking the pairs of a left and a right row of the same keys in order of gap would match, no row twice.

    gap is the way ahead from left to right, or the way back and `behind` more (at: whole numbers, e.g. seconds); pairs beyond reach are none. Equal gaps go by
    left's place, right's place, left's id, right's id. Rows with a null key, place or id match nothing; ids are unique on each side.

    Rows at one place form a node with a count. In each round a scan shows every node the nearest nodes of the other side; nodes that are
    nearest to each other match, member by member in the order of ids, as many as the smaller one has. No earlier pair can
    touch them, so rounds end with what one pair after the other would give; their number is the longest chain of nodes that
    wait for each other.
    """
    keys = [f"by{i}" for i in range(len(by))]
    renamed = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    members = left.select(*renamed, F.col(at).cast("long").alias("at"), F.lit(0).alias("side"), F.col(id_col).alias("id"))
    members = members.unionByName(right.select(*renamed, F.col(at).cast("long").alias("at"), F.lit(1).alias("side"), F.col(id_col).alias("id"))).na.drop()
    node = [*keys, "at", "side"]
    members = stored(_ranked(members, node, ["id"]), "members")
    nodes = stored(members.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("used")), "nodes")
    events = []
    while True:
        seen = lined_up(nodes, node)
        own = F.struct(*keys, "at", "side", "n", "used")
        steps = {}
        for side in (0, 1):
            of_side = F.when(F.col("side") == side, own)
            steps |= {f"prev{side}": last(of_side, strict=True), f"next{side}": following(of_side, strict=True)}
        seen = scan(seen, node, **steps)
        same = lambda x: F.when(F.concat_ws("\x00", *[x[k].cast("string") for k in keys]) == F.concat_ws("\x00", *[F.col(k).cast("string") for k in keys]), x)
        mine = F.col("side") == 0
        back, ahead = (same(F.when(mine, F.col(f"{w}1")).otherwise(F.col(f"{w}0"))) for w in ("prev", "next"))
        # Of a left node, what comes next lies ahead; of a right node, the left one before it has it ahead.
        gap_back = F.col("at") - back["at"] + F.when(mine & (back["at"] < F.col("at")), behind).otherwise(0)
        gap_ahead = ahead["at"] - F.col("at") + F.when(~mine & (ahead["at"] > F.col("at")), behind).otherwise(0)
        seen = seen.withColumns({"back": F.when(gap_back <= reach, F.struct(gap_back.alias("gap"), back.alias("to"))), "ahead": F.when(gap_ahead <= reach, F.struct(gap_ahead.alias("gap"), ahead.alias("to")))})
        # Equally near, the earlier place counts: it is the smaller one of right places, and of left places too.
        best = F.when(F.col("ahead").isNull() | (F.col("back.gap") <= F.col("ahead.gap")), F.col("back")).otherwise(F.col("ahead"))
        wish = seen.select(*node, "n", "used", best.alias("best")).where("best is not null")
        wish = wish.select(*keys, F.col("side"), F.col("best.gap").alias("gap"), F.when(F.col("side") == 0, F.col("at")).otherwise(F.col("best.to.at")).alias("a_at"), F.when(F.col("side") == 1, F.col("at")).otherwise(F.col("best.to.at")).alias("b_at"), F.struct("n", "used").alias("have"))
        both = wish.groupBy(*keys, "a_at", "b_at").agg(F.first("gap").alias("gap"), F.max(F.when(F.col("side") == 0, F.col("have"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("have"))).alias("b"))
        met = stored(both.where("a is not null and b is not null").select(*keys, "a_at", "b_at", "gap", F.col("a.used").alias("a_used"), F.col("b.used").alias("b_used"), F.least("a.n", "b.n").alias("m")), "met")
        if met.isEmpty():
            break
        events.append(met)
        taken = met.select(*keys, F.col("a_at").alias("at"), F.lit(0).alias("side"), "m").unionByName(met.select(*keys, F.col("b_at").alias("at"), F.lit(1).alias("side"), "m"))
        after = nodes.join(taken, node, "left").na.fill(0, ["m"])
        nodes = stored(after.select(*node, (F.col("n") - F.col("m")).alias("n"), (F.col("used") + F.col("m")).alias("used")).where("n > 0"), "nodes")
    names = [F.col(k).alias(c) for c, k in zip(by, keys, strict=True)]
    out = None
    for met in events:
        out = met if out is None else out.unionByName(met)
    if out is None:
        out = met
    each = out.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    a = members.where("side = 0").select(*keys, F.col("at").alias("a_at"), F.col("rank_").alias("a_rank"), F.col("id").alias("a_id"))
    b = members.where("side = 1").select(*keys, F.col("at").alias("b_at"), F.col("rank_").alias("b_rank"), F.col("id").alias("b_id"))
    each = each.withColumns({"a_rank": F.col("a_used") + F.col("i"), "b_rank": F.col("b_used") + F.col("i")})
    return each.join(a, [*keys, "a_at", "a_rank"]).join(b, [*keys, "b_at", "b_rank"]).select(*names, "a_id", "b_id", "gap")
