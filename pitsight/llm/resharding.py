"""Resharding by minimum-cost flow: the transfers between shards that move the fewest bytes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Hash ranges that a shard is summed up in. The tables that reach the driver have one row for each shard and range.
RANGES = 4096
#: A row over this part of the mean capacity goes before all others of its shard, so that cuts fall between small rows.
LARGE = 16
ROW_BYTES = 8
#: Bytes of text that a task writes, about; the folder of a rewrite that isn't complete.
TASK_BYTES, STAGED = 128 << 20, "_staged"


@dataclass(frozen=True)
class Transfer:
    """Bytes that go from an old shard to a new one; source and target are equal for what stays."""

    source: int
    target: int
    size: int


def solve_transfers(sizes: dict[int, int], capacities: dict[int, int], cost=lambda source, target: int(source != target)) -> list[Transfer]:
    """Minimum-cost flow from old shards (their sizes) to new ones (their capacities), cost(source, target) a byte.

    Successive cheapest augmenting paths over at most len(sizes) * len(capacities) arcs; by default staying is free
    and every move costs the same, so the flow moves the fewest bytes. Capacities must hold all sizes.
    """
    if sum(sizes.values()) > sum(capacities.values()):
        raise ValueError("the capacities are smaller than the sizes")
    start, end = ("start", 0), ("end", 0)
    olds, news = {k: ("old", k) for k in sorted(sizes)}, {k: ("new", k) for k in sorted(capacities)}
    room: dict = {}
    price: dict = {}

    def arc(a, b, r, c):
        room[a, b], price[a, b] = r, c
        room.setdefault((b, a), 0)
        price.setdefault((b, a), -c)

    for k, node in olds.items():
        arc(start, node, sizes[k], 0)
    for k, node in news.items():
        arc(node, end, capacities[k], 0)
    for i, a in olds.items():
        for j, b in news.items():
            arc(a, b, sizes[i], cost(i, j))
    nodes = [start, *olds.values(), *news.values(), end]
    while True:
        far, via = {start: 0}, {}
        for _ in nodes:
            changed = False
            for (a, b), r in room.items():
                if r > 0 and a in far and far[a] + price[a, b] < far.get(b, float("inf")):
                    far[b], via[b], changed = far[a] + price[a, b], a, True
            if not changed:
                break
        if end not in far:
            break
        path, node = [], end
        while node != start:
            path.append((via[node], node))
            node = via[node]
        most = min(room[step] for step in path)
        for a, b in path:
            room[a, b] -= most
            room[b, a] += most
    moved = [Transfer(i, j, room[b, a]) for i, a in olds.items() for j, b in news.items() if room[b, a] > 0]
    return sorted(moved, key=lambda t: (t.source, t.source != t.target, t.target))


def even_capacities(total: int, shards: int) -> dict[int, int]:
    """Capacities of all bytes, a byte apart at most."""
    return {k: total // shards + (k < total % shards) for k in range(shards)}


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def row_key(id_column: Column, text: Column) -> Column:
    """Place of a row among those of its shard: a hash of id and text, the same on every machine and run."""
    return F.xxhash64(id_column, F.crc32(text.cast("binary")), F.lit(17))


def _range_of(key: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 20), F.lit(RANGES)).cast("int")


def lot() -> Column:
    """A number in [0, 1) from a row's place in its table: it tells equal rows apart."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) / F.lit(float(1 << 30))


@dataclass(frozen=True)
class Plan:
    """For each old shard the new shards in the order of its rows, and the places (part, range, key, lot) between them."""

    transfers: tuple[Transfer, ...]
    cuts: dict[int, list[tuple[tuple[int, int, int, float], int]]]
    large: int

    def target(self, shard: Column, size: Column, key: Column, drawn: Column) -> Column:
        """The new shard of a row: comparisons with the old shard's cuts, no join and no shuffle. Where many equal rows
        lie at a cut, drawn (see lot()) decides, so that they part in the proportion that the cut asks for."""
        part = F.when(size > self.large, F.lit(0)).otherwise(F.lit(1))
        at = F.struct(part.alias("p"), _range_of(key).alias("r"), key.alias("k"), drawn.alias("u"))
        out = F.lit(None).cast("int")
        for old, steps in self.cuts.items():
            inner = F.lit(steps[-1][1])
            for (p, r, k, u), new in reversed(steps[:-1]):
                place = F.struct(F.lit(p).alias("p"), F.lit(r).alias("r"), F.lit(k).cast("long").alias("k"), F.lit(float(u)).alias("u"))
                inner = F.when(at < place, F.lit(new)).otherwise(inner)
            out = F.when(shard == old, inner).otherwise(out)
        return out


def plan(rows: DataFrame, shards: int, capacities: dict[int, int] | None = None) -> Plan:
    """Plans the move of rows (shard, size, key) into new shards 0 to shards - 1.

    Old sizes are summed by shard and hash range; the flow says how many bytes go where; each old shard's rows are
    then cut, in the order of part, range and key, at the places that give these sums. Only ranges with a cut are
    looked at row by row, each in its own window. The driver holds two numbers for each shard and range.
    """
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    capacities = capacities or even_capacities(total or 0, shards)
    large = max(1, sum(capacities.values()) // max(1, len(capacities)) // LARGE)
    placed = rows.select("shard", "size", "key", F.when(F.col("size") > large, 0).otherwise(1).alias("part"), _range_of(F.col("key")).alias("range"))
    summed = placed.groupBy("shard", "part", "range").agg(F.sum("size").alias("size")).orderBy("shard", "part", "range").collect()
    sizes: dict[int, int] = {}
    for r in summed:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    transfers = solve_transfers(sizes, capacities)
    wanted: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for old in sizes:
        ends, at = [], 0
        for t in (t for t in transfers if t.source == old):
            at += t.size
            ends.append(at)
        before, i = 0, 0
        for r in (r for r in summed if r["shard"] == old):
            while i < len(ends) - 1 and ends[i] < before + r["size"]:
                wanted.setdefault((old, r["part"], r["range"]), []).append((i, ends[i] - before))
                i += 1
            before += r["size"]
    found = _cut_keys(placed, wanted)
    cuts = {}
    for old in sizes:
        targets = [t.target for t in transfers if t.source == old]
        cuts[old] = [(found.get((old, i), (0, 0, 0, 0.0)), new) for i, new in enumerate(targets)]
    return Plan(tuple(transfers), cuts, large)


def _cut_keys(placed: DataFrame, wanted: dict) -> dict[tuple[int, int], tuple[int, int, int, float]]:
    """For each wanted cut its place: the key that it falls on, and the part of that key's rows that lie before it. A
    single row goes to the side where more of it lies. Equal rows are summed before they are ordered."""
    if not wanted:
        return {}
    spark = placed.sparkSession
    flat = [(old, part, rng, i, offset) for (old, part, rng), steps in wanted.items() for i, offset in steps]
    # One row for each cut: fewer than old and new shards together.
    cuts = F.broadcast(spark.createDataFrame(flat, "shard int, part int, range int, i int, offset long"))
    before = Window.partitionBy("shard", "part", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = cuts.select("shard", "part", "range").distinct()
    near = placed.join(F.broadcast(keys), ["shard", "part", "range"]).groupBy("shard", "part", "range", "key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    summed = near.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    behind = summed.join(cuts, ["shard", "part", "range"]).where(F.col("before") + F.col("size") >= F.col("offset"))
    share = (F.col("offset") - F.col("before")) / F.col("size")
    share = F.when(F.col("n") > 1, share).otherwise(F.when(share > 0.5, F.lit(1e0)).otherwise(F.lit(0e0)))
    first = behind.groupBy("shard", "i").agg(F.min(F.struct("key", share.alias("share"))).alias("at")).collect()
    found = {(r["shard"], r["i"]): r["at"] for r in first}
    return {(old, i): (part, rng, *found[old, i]) if (old, i) in found else (part, rng + 1, -(1 << 63), 0.0) for old, part, rng, i, _ in flat}


def old_shard(id_column: Column, shards: int) -> Column:
    """The layout that documents have before: by a hash of the id."""
    return F.pmod(F.xxhash64(id_column, F.lit(3)), F.lit(shards)).cast("int")


def reshard(docs: DataFrame, old_shards: int, shards: int, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> DataFrame:
    """docs with a column shard_col, 0 to shards - 1, of near equal bytes; a column of that name is replaced.

    The rows come from old_shards shards by hash of the id. Null ids and texts have a place like any other; very many
    equal rows are parted by their places in the table; an empty table gives no rows. Texts aren't shuffled.
    """
    rows = _rows(docs, old_shards, id_col, text_col)
    made = plan(cut(rows.select("shard", "size", "key")), shards)
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return _targeted(docs, made, old_shard(id_, old_shards), row_size(text), row_key(id_, text), shard_col)


def _targeted(docs: DataFrame, made: Plan, shard: Column, size: Column, key: Column, shard_col: str) -> DataFrame:
    """docs with the new shard. Lots are drawn in a projection of their own: one for each row, not one for each use."""
    drawn = docs.withColumn("__lot", lot())
    return drawn.withColumn(shard_col, made.target(shard, size, key, F.col("__lot"))).drop("__lot")


def _rows(docs: DataFrame, old_shards: int, id_col: str, text_col: str) -> DataFrame:
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(id_.alias("id"), old_shard(id_, old_shards).alias("shard"), row_size(text).alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("crc"), row_key(id_, text).alias("key"))


def assignment(docs: DataFrame, old_shards: int, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, old_shard, shard, slot) for every row; slot counts the rows of a shard from 0.

    Slots come from row counts of each shard and hash range plus the place within the range, so no task sees a whole
    shard. Null texts have size 8 and crc32 0.
    """
    rows = cut(_rows(docs, old_shards, id_col, text_col).withColumn("lot", lot()))
    made = plan(rows, shards)
    target = made.target(F.col("shard"), F.col("size"), F.col("key"), F.col("lot"))
    moved = rows.select("id", "size", "crc", "key", F.col("shard").alias("old_shard"), target.alias("shard"), _range_of(F.col("key")).alias("range"))
    counts = moved.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "range").orderBy("key", "id", "crc", "size")
    slots = moved.join(offsets, ["shard", "range"]).withColumn("slot", F.col("offset") + F.row_number().over(within) - 1)
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "old_shard", "shard", "slot")


def write_sharded(docs: DataFrame, path: str, shard_col: str = "shard", text_col: str = "text", task_bytes: int = TASK_BYTES) -> None:
    """Writes a folder for each shard. Several tasks write a shard, each about task_bytes of text."""
    _salted(docs, shard_col, text_col, task_bytes).write.mode("overwrite").partitionBy(shard_col).parquet(path)


def _salted(docs: DataFrame, shard_col: str, text_col: str, task_bytes: int) -> DataFrame:
    size, largest = docs.groupBy(shard_col).agg(F.sum(row_size(F.col(f"`{text_col}`"))).alias("size")).agg(F.sum("size"), F.max("size")).first()
    pieces = max(1, -(-(largest or 0) // task_bytes))
    tasks = max(1, -(-(size or 0) // task_bytes))
    return docs.withColumn("__piece", (lot() * pieces).cast("int")).repartition(tasks, shard_col, "__piece").drop("__piece")


def rewrite_affected(spark: SparkSession, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard", task_bytes: int = TASK_BYTES) -> Plan:
    """Moves the rows of a sharded table (folders shard_col=k below path) into shards of near equal bytes, in place.

    Only folders that give or receive rows are written again; the others keep their files. The new contents and the list
    of folders that they replace are complete in a folder beside them, which readers pass over, before the first folder
    is replaced; if that is broken off, the next call completes it first.
    """
    finish_rewrite(spark, path, shard_col)
    docs = spark.read.parquet(path)
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    made = plan(docs.select(F.col(shard_col).alias("shard"), row_size(text).alias("size"), row_key(id_, text).alias("key")), shards)
    touched = sorted({k for t in made.transfers if t.source != t.target for k in (t.source, t.target)})
    if touched:
        affected = docs.where(F.col(shard_col).isin(touched))
        moved = _targeted(affected, made, F.col(shard_col), row_size(text), row_key(id_, text), shard_col)
        write_sharded(cut(moved), f"{path}/{STAGED}/new", shard_col, text_col, task_bytes)
        Path = spark._jvm.org.apache.hadoop.fs.Path
        files = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        filled = [(k, files.exists(Path(f"{path}/{STAGED}/new/{shard_col}={k}"))) for k in touched]
        spark.createDataFrame(filled, "shard int, filled boolean").coalesce(1).write.mode("overwrite").json(f"{path}/{STAGED}/touched")
        finish_rewrite(spark, path, shard_col)
    return made


def finish_rewrite(spark: SparkSession, path: str, shard_col: str = "shard") -> None:
    """Puts staged folders in the place of those that they replace. Every step can be repeated; what was staged
    incompletely is thrown away."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    staged = Path(f"{path}/{STAGED}")
    files = staged.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(staged):
        return
    if files.exists(Path(f"{path}/{STAGED}/touched/_SUCCESS")):
        for r in spark.read.json(f"{path}/{STAGED}/touched").collect():
            new, old = (Path(f"{path}/{name}{shard_col}={r['shard']}") for name in (f"{STAGED}/new/", ""))
            # A filled folder that is staged no more is in its place already.
            if files.exists(new) or not r["filled"]:
                files.delete(old, True)
            if files.exists(new):
                files.rename(new, old)
    files.delete(staged, True)
