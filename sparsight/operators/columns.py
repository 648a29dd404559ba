"""Bit-array joins: overlaps of inputs with connected columns, activity of segments, inhibition, votes, traces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shuffles_removed, written


def overlap_join(bits: DataFrame, connected: DataFrame, stimulus: int = 0) -> DataFrame:
    """rec, col, overlap: how many on-bits of a record (rec, bit) each column (col, bit) is connected to; below stimulus: 0.

    Where columns are whole numbers, records meet packed arrays of them, as in top_columns, which are counted where they
    are: what is shuffled is the gap to the next column (a byte or two) for each connection of an on-bit, not a row.
    """
    whole = isinstance(connected.schema["col"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    known = bits.where(F.col("rec").isNull()).select("rec").isEmpty() and connected.where(F.col("col").isNull()).select("col").isEmpty()
    if whole and known:
        counted = _met_counts(bits, connected, None, 1)[0].withColumn("col", F.col("col").cast(connected.schema["col"].dataType))
    else:
        counted = bits.join(connected, "bit").groupBy("rec", "col").agg(F.count(F.lit(1)).alias("overlap"))
    return counted.withColumn("overlap", F.when(F.col("overlap") < stimulus, 0).otherwise(F.col("overlap")))


def inhibit(overlaps: DataFrame, winners: int, stimulus: int = 0) -> DataFrame:
    """The winners of each record by overlap, ties to the higher column, without those below the stimulus."""
    w = Window.partitionBy("rec").orderBy(F.col("overlap").desc(), F.col("col").desc())
    return overlaps.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= winners) & (F.col("overlap") >= stimulus))


def active_winners(columns: int, density: float = -1.0, active_per_area: float = 10.0, radius: int = 0, dims: int = 1) -> int:
    """How many columns win: by density, or by the active ones per neighbourhood, at most half."""
    share = density if density > 0 else min(0.5, active_per_area / min(columns, (2 * radius + 1) ** dims))
    return int(columns * share)


def segment_activity(active: DataFrame, synapses: DataFrame, connected: float, activation: int, matching: int) -> DataFrame:
    """seg, potential, connected counts and whether a segment is active or matching, of active cells (cell) and synapses (seg, cell, perm)."""
    joined = synapses.join(active, "cell")
    counted = joined.groupBy("seg").agg(F.count(F.lit(1)).alias("potential"), F.sum((F.col("perm") > connected - 1e-5).cast("int")).alias("connected"))
    return counted.withColumn("is_active", (F.col("connected") >= activation).cast("int")).withColumn("is_matching", (F.col("potential") >= matching).cast("int"))


def bucket_votes(bits: DataFrame, learned: DataFrame) -> DataFrame:
    """rec, bucket, p: each on-bit votes with its normalised bucket histogram (bit, bucket, weight), votes are summed and normalised."""
    share = learned.withColumn("v", F.col("weight") / F.sum("weight").over(Window.partitionBy("bit")))
    summed = bits.join(share, "bit").groupBy("rec", "bucket").agg(F.sum("v").alias("v"))
    return summed.withColumn("p", F.col("v") / F.sum("v").over(Window.partitionBy("rec"))).drop("v")


def decayed_histogram(history: DataFrame, alpha: float) -> DataFrame:
    """bit, bucket, weight: of records that had a bit (bit, bucket, age), each weighing (1 - alpha)^age."""
    return history.groupBy("bit", "bucket").agg(F.sum(F.pow(F.lit(1 - alpha), F.col("age"))).alias("weight"))


def softmax_rows(scores: DataFrame, by: list[str], score: str) -> DataFrame:
    w = Window.partitionBy(*by)
    e = scores.withColumn("__e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def drop_unlikely(likelihoods: DataFrame, by: list[str], value: str, p: str, least: float, most: int) -> DataFrame:
    """Predictions of at least a probability, the best one always, and of these the most probable few."""
    w = Window.partitionBy(*by).orderBy(F.col(p).desc(), F.col(value))
    ranked = likelihoods.withColumn("rank", F.row_number().over(w))
    return ranked.where(((F.col(p) >= least) | (F.col("rank") == 1)) & (F.col("rank") <= most))


def trace_sets(active: Column, predicted: Column) -> dict[str, Column]:
    """Sizes of what was predicted and came, predicted in vain, and not predicted."""
    return {
        "predicted_active": F.size(F.array_intersect(predicted, active)),
        "predicted_inactive": F.size(F.array_except(predicted, active)),
        "unpredicted_active": F.size(F.array_except(active, predicted)),
    }


def inhibit_locally(overlaps: Column, radius: int, density: float) -> Column:
    """Positions of the columns (an array of their overlaps, on a line) that win in their neighbourhoods.

    A column wins where fewer neighbours than density times their number, rounded, have a larger overlap than it has;
    overlaps of 0 never win. Ties win together.
    """
    def near(i: Column) -> Column:
        return F.slice(overlaps, F.greatest(i - radius, F.lit(0)) + 1, F.least(i + radius, F.size(overlaps) - 1) - F.greatest(i - radius, F.lit(0)) + 1)

    wins = lambda x, i: (x > 0) & (F.size(F.filter(near(i), lambda y: y > x)) < F.floor(0.5 + density * F.size(near(i))))
    return F.filter(F.transform(overlaps, lambda x, i: F.when(wins(x, i), i)), lambda i: i.isNotNull())


def inhibition_radius(connected: DataFrame, columns: int, inputs: int) -> DataFrame:
    """radius: how far columns inhibit each other, from the mean span of what each is connected to (col, bit) on a line."""
    span = connected.groupBy("col").agg((F.max("bit") - F.min("bit") + 1).alias("span"))
    diameter = F.avg("span") * (columns / inputs)
    return span.agg(F.greatest(F.lit(1), F.floor((diameter - 1) / 2 + 0.5)).cast("bigint").alias("radius"))


def least_duty(duty: DataFrame, share: float, radius: int | None = None) -> DataFrame:
    """duty(col, duty) plus least: a share of the largest duty of all columns, or of those within a radius on a line."""
    if radius is None:
        return duty.join(F.broadcast(duty.agg((F.max("duty") * share).alias("least"))))
    spread = duty.select(F.explode(F.sequence(F.col("col") - radius, F.col("col") + radius)).alias("col"), F.col("duty").alias("near"))
    return duty.join(spread.groupBy("col").agg((F.max("near") * share).alias("least")), "col")


#: Columns that one group of a record counts at most (16 bytes each); columns of a bit in one row of its postings, about.
GROUP_COLUMNS, POSTING_COLUMNS = 4_194_304, 4096


def top_columns(bits: DataFrame, connected: DataFrame, winners: int, stimulus: int = 0) -> DataFrame:
    """rec, col, overlap, rank: the winners of each record by overlap with the columns (col, bit), ties to the higher column.

    The same rows as inhibit over overlap_join, without a row for each record and column. A bit's columns are packed into
    arrays, those of hot bits cut at about POSTING_COLUMNS and, where there are very many columns, dealt to groups by hash,
    so that a hot bit is many rows of bounded size and any other bit is one. Records meet these arrays; a record's arrays are then counted and ranked where they are, and
    only winners leave. What winners of several groups there are is ranked again. Columns are whole numbers. Rows with a
    null take no part; rows that repeat count as often as they occur.
    """
    best, groups = _met_counts(bits, connected, winners, max(1, stimulus))
    if groups > 1:
        return inhibit(best, winners, stimulus)
    order = Window.partitionBy("rec").orderBy(F.col("overlap").desc(), F.col("col").desc())
    return best.withColumn("rank", F.row_number().over(order))


def _postings(connected: DataFrame) -> tuple[DataFrame, int]:
    """bit, group, cut, cols: packed columns of each bit, and the number of groups."""
    held = connected.where(F.col("col").isNotNull() & F.col("bit").isNotNull())
    with shuffles_removed(connected.sparkSession):
        groups = max(1, -(-held.agg(F.approx_count_distinct("col")).first()[0] // GROUP_COLUMNS))
    placed = held.select("bit", F.col("col").cast("bigint").alias("col"), F.pmod(F.xxhash64("col"), F.lit(groups)).alias("group"))
    # a hash of the column cuts the arrays of hot bits, by their number of columns; there is one such bit in POSTING_COLUMNS pairs at most
    hot = placed.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > groups * POSTING_COLUMNS)
    hot = hot.select(F.col("bit"), F.ceil(F.col("n") / (groups * POSTING_COLUMNS)).alias("cuts"))
    cut = F.pmod(F.xxhash64(F.lit(1), "col"), F.coalesce("cuts", F.lit(1))).alias("cut")
    lists = placed.join(F.broadcast(hot), "bit", "left").select("bit", "group", "col", cut).groupBy("bit", "group", "cut").agg(F.collect_list("col").alias("cols"))
    kind = connected.schema["bit"].dataType.simpleString()
    return lists.mapInArrow(_packed_lists, f"bit {kind}, group bigint, cut bigint, cols binary"), groups


def _packed_lists(batches):
    """Rows with their list of columns packed, which is most of what is shuffled."""
    import pyarrow as pa

    for batch in batches:
        lists = batch.column("cols")
        packed, ends = pack_lists(lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()))
        binary = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(packed)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bit", "group", "cut")), binary], names=["bit", "group", "cut", "cols"])


def pack_lists(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of whole numbers that lie one after the other, as bytes, and where each list's begin (one more for the end).

    A list is sorted; its first number and the gaps to the next ones are written in groups of 7 bits, the lowest first; all
    but the last byte of a number have the top bit set. First numbers below 0 are folded between those above.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    values = values[np.lexsort((values, owner))]
    gaps = np.empty(len(values), np.uint64)
    gaps[1:] = values[1:].view(np.uint64) - values[:-1].view(np.uint64)  # differences of longs fit as unsigned
    first = (np.cumsum(counts) - counts)[counts > 0]
    gaps[first] = ((values[first] << 1) ^ (values[first] >> 63)).view(np.uint64)
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 10):
        size += gaps >> np.uint64(7 * k) > 0
    at = np.cumsum(size) - size
    packed = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        packed[at[has] + k] = (gaps[has] >> np.uint64(7 * k) & np.uint64(127)) | ((size[has] > k + 1).astype(np.uint64) << np.uint64(7))
    return packed, np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]


def unpack_lists(packed: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed lists, one list after the other, and each list's count. ends: as pack_lists gives them."""
    last = packed < 128
    stop = np.flatnonzero(last)
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else np.zeros(0, np.int64)
    size = stop - start + 1
    gaps = (packed[start] & 127).astype(np.uint64)
    for k in range(1, int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        gaps[has] |= (packed[start[has] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    upto = np.concatenate([[0], np.cumsum(last)])[ends - ends[0]]
    counts = np.diff(upto)
    first = upto[:-1][counts > 0]
    folded = gaps[first]
    gaps[first] = folded >> np.uint64(1) ^ (np.uint64(0) - (folded & np.uint64(1)))
    # running sums within each list: those of all, less what came before the list
    sums = np.cumsum(gaps, dtype=np.uint64)
    sums -= np.repeat(sums[first] - gaps[first], counts[counts > 0])
    return sums.view(np.int64), counts


def _met_counts(bits: DataFrame, connected: DataFrame, winners: int | None, stimulus: int) -> tuple[DataFrame, int]:
    """rec, col, overlap of the winners (None: all columns met) of each record and group of columns, and the number of groups."""
    postings, groups = _postings(connected)
    postings = written(postings, "postings")  # the pairs that it came from need no disk while records meet it
    met = bits.where(F.col("rec").isNotNull()).select("rec", "bit").join(postings, "bit").select("rec", "group", "cols")
    counted = _counted(np.inf if winners is None else winners, stimulus)
    best = met.repartition("rec", "group").sortWithinPartitions("group", "rec").mapInArrow(counted, f"rec {bits.schema['rec'].dataType.simpleString()}, col bigint, overlap bigint")
    return best, groups


def _counted(winners: int, stimulus: int):
    """Sorted rows (rec, group, cols) as the best columns of each record and group with their counts; a record may span batches."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def emit(rec: pa.Array, run: np.ndarray, col: np.ndarray, count: np.ndarray):
        """run: each count's place in rec."""
        run, count, col = ordered(run, count, col, descending=True)
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
        rank = np.arange(len(run)) - np.repeat(starts, np.diff(np.append(starts, len(run))))
        kept = (rank < winners) & (count >= stimulus)
        return pa.RecordBatch.from_arrays([rec.take(pa.array(run[kept])), pa.array(col[kept]), pa.array(count[kept])], names=["rec", "col", "overlap"])

    def ordered(run, count, col, descending=False):
        """Sorted by run, then count and column; as one number each where their ranges fit."""
        if not len(run):
            return run, count, col
        low, tall, wide, long = int(col.min()), int(count.max()) + 1, int(col.max()) - int(col.min()) + 1, int(run.max()) + 1
        if long * tall * wide >= 2**63:
            order = np.lexsort((-col, -count, run) if descending else (col, count, run))
            return run[order], count[order], col[order]
        if descending:
            key = (run * tall + (tall - 1 - count)) * wide + (wide - 1 - (col - low))
        else:
            key = (run * tall + count) * wide + (col - low)
        key.sort()
        upper, col = np.divmod(key, wide)
        run, count = np.divmod(upper, tall)
        return (run, tall - 1 - count, wide - 1 - col + low) if descending else (run, count, col + low)

    def add(run, col, count, same):
        if same:  # all count 1
            run, count, col = ordered(run, count, col)
            fresh = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (col[1:] != col[:-1])])) if len(run) else np.zeros(0, np.int64)
            return run[fresh], col[fresh], np.diff(np.append(fresh, len(run)))
        order = np.lexsort((col, run))
        run, col, count = run[order], col[order], count[order]
        fresh = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (col[1:] != col[:-1])])) if len(run) else np.zeros(0, np.int64)
        return run[fresh], col[fresh], np.add.reduceat(count, fresh) if len(fresh) else count

    def rank_all(batches):
        known, last = None, None  # the counts so far of the record and group that a batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            rec, group, lists = batch.column("rec"), batch.column("group").to_numpy(), batch.column("cols")
            n = batch.num_rows
            fresh = np.ones(n, bool)
            fresh[1:] = pc.fill_null(pc.not_equal(rec.slice(1), rec.slice(0, n - 1)), True).to_numpy(zero_copy_only=False) | (group[1:] != group[:-1])
            starts = np.flatnonzero(fresh)
            ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + n + 1].astype(np.int64)
            col, met = unpack_lists(np.frombuffer(lists.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends)
            run = np.repeat(np.cumsum(fresh) - 1, met)
            count = np.ones(len(col), np.int64)
            names, same = rec.take(pa.array(starts)), True
            if known is not None:
                if (rec[0].as_py(), int(group[0])) == last:
                    same = False
                    run, col, count = (np.concatenate(x) for x in ((np.zeros(len(known[0]), np.int64), run), (known[0], col), (known[1], count)))
                else:
                    yield emit(pa.array([last[0]], rec.type), np.zeros(len(known[0]), np.int64), *known)
            run, col, count = add(run, col, count, same)
            open_ = run == len(starts) - 1
            known, last = (col[open_], count[open_]), (rec[n - 1].as_py(), int(group[n - 1]))
            yield emit(names, run[~open_], col[~open_], count[~open_])
        if known is not None:
            yield emit(pa.array([last[0]], rec.type), np.zeros(len(known[0]), np.int64), *known)

    return rank_all


def cells_of_sequences(rows: DataFrame) -> DataFrame:
    """sequence, n_cells: how many different cells were active in a sequence, of rows(sequence, cell)."""
    return rows.where(F.col("cell").isNotNull()).groupBy("sequence").agg(F.count_distinct("cell").alias("n_cells"))


def sequences_of_cells(rows: DataFrame) -> DataFrame:
    """cell, n_sequences: in how many different sequences a cell was active, of rows(sequence, cell)."""
    return rows.where(F.col("cell").isNotNull()).groupBy("cell").agg(F.count_distinct("sequence").alias("n_sequences"))


def shared_cells(rows: DataFrame) -> DataFrame:
    """a, b, shared: how many cells two sequences have in common (a < b, one at least), of rows(sequence, cell).

    Cells are whole numbers. A sequence's cells are packed into words of 64 bits before they meet, so that a cell that is
    active in many sequences meets as a bit of a word; what a pair shares in a word is counted in the bits of both.
    """
    place = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("cell", F.lit(64)).cast("int"))
    words = rows.where(F.col("cell").isNotNull()).groupBy("sequence", F.floor(F.col("cell") / 64).alias("word")).agg(F.bit_or(place).alias("bits"))
    other = words.select(F.col("sequence").alias("b"), "word", F.col("bits").alias("other_bits"))
    met = words.withColumnRenamed("sequence", "a").join(other, "word").where("a < b")
    both = F.bit_count(F.col("bits").bitwiseAND(F.col("other_bits")))
    return met.groupBy("a", "b").agg(F.sum(both).alias("shared")).where("shared > 0")
