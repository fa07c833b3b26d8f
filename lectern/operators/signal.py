"""Analytics over tables of audio samples: silences, envelopes, levels. Long form is (clip, i, v); array form one row a clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.shared import settled
from .lexicon import small
from .ranks import numbered

#: Level of silence, seconds kept at an edge, and the shortest pause in seconds.
THRESHOLD, MARGIN_S, SHORTEST_S = 0.01, 0.14, 0.09
#: Levels in dB that a finished book must have.
RMS_LOW, RMS_HIGH, PEAK_HIGH = -23.0, -18.0, -3.0
#: Values that one row of a sum in order takes.
ADDENDS = 4096


def samples_long(clips: DataFrame, key: str, samples: str) -> DataFrame:
    return clips.select(key, F.posexplode(samples).alias("i", "v"))


def decibels(x: Column) -> Column:
    return F.when(x > 0, 20 * F.log10(x))


def clip_levels(long: DataFrame, key: str, part: int) -> DataFrame:
    """RMS, peak and noise floor (least RMS over parts of `part` samples) in dB; null where not measurable."""
    v = F.col("v").cast("double")
    parts = long.groupBy(key, F.floor(F.col("i") / part).alias("part")).agg(F.sum(v * v).alias("e"), F.count("*").alias("n"), F.max(F.abs(v)).alias("peak"))
    return parts.groupBy(key).agg(decibels(F.sqrt(F.sum("e") / F.sum("n"))).alias("rms_db"), decibels(F.max("peak")).alias("peak_db"), decibels(F.sqrt(F.min(F.col("e") / F.col("n")))).alias("noise_floor_db"))


def meets_spec(rms: Column, peak: Column) -> Column:
    return F.coalesce(rms.between(RMS_LOW, RMS_HIGH) & (peak <= PEAK_HIGH), F.lit(False))


def waveform_peaks(samples: Column, buckets: int) -> Column:
    """Largest magnitude of each of `buckets` equal stretches (no more than there are samples, one at least), relative to the
    largest of all, to four decimals."""
    n = F.size(samples)
    many = F.greatest(F.lit(1), F.least(F.lit(buckets), n))
    edge = lambda i: F.floor(i * n / many).cast("int")
    size = F.transform(samples, lambda v: F.abs(v.cast("double")))
    peaks = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.coalesce(F.array_max(F.slice(size, edge(i) + 1, edge(i + 1) - edge(i))), F.lit(0.0)))
    top = F.array_max(size)
    return F.when(top > 0, F.transform(peaks, lambda p: F.round(p / top, 4))).otherwise(peaks)


def silence_runs(long: DataFrame, key: str, threshold: float = THRESHOLD, least: int = 1) -> DataFrame:
    """(key, start, length) of interior runs of quiet samples of at least `least`: gaps and islands."""
    w = Window.partitionBy(key).orderBy("i")
    quiet = long.withColumn("quiet", F.abs("v") <= threshold)
    flagged = quiet.withColumn("new", (F.col("quiet") != F.coalesce(F.lag("quiet").over(w), ~F.col("quiet"))).cast("int"))
    island = flagged.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = island.where("quiet").groupBy(key, "island").agg(F.min("i").alias("start"), F.count("*").alias("length"))
    ends = long.groupBy(key).agg(F.max("i").alias("last"))
    return runs.join(ends, key).where((F.col("start") > 0) & (F.col("start") + F.col("length") - 1 < F.col("last")) & (F.col("length") >= least)).select(key, "start", "length")


# Recordings in blocks: rows (key, block, samples), every block but a recording's last with the same number of samples.


def in_blocks(long: DataFrame, key: str, size: int) -> DataFrame:
    """Blocks of `size` samples of a long table (key, i, v) whose places have no gaps."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])
    return long.groupBy(key, F.floor(F.col("i") / size).alias("block")).agg(ordered.alias("samples"))


_RUN = "array<struct<start:bigint,length:bigint>>"


def _quiet_runs(quiet: Column) -> Column:
    """(start, length) of all runs of true values of an array."""
    at = F.sequence(F.lit(0), F.size(quiet) - 1)
    edges = lambda step: F.filter(at, lambda i: F.get(quiet, i) & ~F.coalesce(F.get(quiet, i + step), F.lit(False)))
    return F.zip_with(edges(-1), edges(1), lambda a, b: F.struct(a.cast("long").alias("start"), (b - a + 1).cast("long").alias("length")))


def block_runs(blocks: DataFrame, key: str, size: int, threshold: float = THRESHOLD) -> DataFrame:
    """(key, block, at, n, head, tail, found): what a block says of its runs of quiet samples.

    `at` is the place of its first sample and n its samples; head and tail are the lengths of the runs at its ends (n if all is quiet) and `found`
    the runs between. Such summaries of neighbours combine into one of the same form.
    """
    quiet = F.transform("samples", lambda v: F.abs(v) <= threshold)
    rows = blocks.where(F.size("samples") > 0).select(key, "block", (F.col("block") * size).cast("long").alias("at"), F.size("samples").cast("long").alias("n"), let(quiet, _quiet_runs).alias("runs"))
    head = F.coalesce(F.get(F.filter("runs", lambda r: r["start"] == 0), F.lit(0))["length"], F.lit(0).cast("long"))
    tail = F.coalesce(F.get(F.filter("runs", lambda r: r["start"] + r["length"] == F.col("n")), F.lit(0))["length"], F.lit(0).cast("long"))
    between = F.filter("runs", lambda r: (r["start"] > 0) & (r["start"] + r["length"] < F.col("n")))
    found = F.transform(between, lambda r: F.struct((r["start"] + F.col("at")).alias("start"), r["length"].alias("length")))
    return rows.select(key, "block", "at", "n", head.alias("head"), tail.alias("tail"), found.alias("found"))


def _combined(parts: Column) -> Column:
    """One summary of the ordered summaries of neighbours; `found` are the runs that cross their borders and end inside."""
    first = F.get(parts, F.lit(0))
    start = F.struct(*[first[c].alias(c) for c in ("at", "n", "head", "tail")], F.array().cast(_RUN).alias("found"))

    def join(a: Column, b: Column) -> Column:
        quiet_a, quiet_b = a["head"] == a["n"], b["head"] == b["n"]
        run = F.struct((a["at"] + a["n"] - a["tail"]).alias("start"), (a["tail"] + b["head"]).alias("length"))
        closed = ~quiet_a & ~quiet_b & (run["length"] > 0)
        return F.struct(
            a["at"].alias("at"), (a["n"] + b["n"]).alias("n"), F.when(quiet_a, a["n"] + b["head"]).otherwise(a["head"]).alias("head"),
            F.when(quiet_b, a["tail"] + b["n"]).otherwise(b["tail"]).alias("tail"), F.when(closed, F.array_append(a["found"], run)).otherwise(a["found"]).alias("found"),
        )

    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), start, join)


def silence_runs_in_blocks(blocks: DataFrame, key: str, size: int, threshold: float = THRESHOLD, least: int = 1, fan: int = 256) -> DataFrame:
    """The rows of `silence_runs` for recordings in blocks: no task holds more of one than a block, or `fan` summaries.

    Blocks say in their rows which runs they hold whole; of each `fan` neighbours a summary is made, and of these again, until a
    recording has one. Runs that cross borders come out where they end.
    """
    level = settled(block_runs(blocks, key, size, threshold), "runs")
    out = level.select(key, F.inline("found"))
    top = level.agg(F.max("block")).first()[0] or 0
    while top > 0:
        ordered = F.sort_array(F.collect_list(F.struct("block", "at", "n", "head", "tail")))
        above = level.groupBy(key, F.floor(F.col("block") / fan).alias("block")).agg(let(ordered, _combined).alias("x"))
        level = settled(above.select(key, "block", "x.*"), "runs")
        out = out.unionByName(level.select(key, F.inline("found")))
        top //= fan
    return out.where(F.col("length") >= least)


def levels_in_blocks(blocks: DataFrame, key: str, size: int, part: int) -> DataFrame:
    """The rows of `clip_levels` for recordings in blocks of a multiple of `part` samples: parts are summed inside a block's row."""
    if size % part:
        raise ValueError("a block has to hold whole parts")
    many = F.ceil(F.size("samples") / part).cast("int")
    square = lambda vs: F.aggregate(vs, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    parts = F.transform(F.sequence(F.lit(0), many - 1), lambda k: let(F.slice("samples", k * part + 1, part), lambda vs: F.struct(square(vs).alias("e"), F.size(vs).alias("n"))))
    rows = blocks.where(F.size("samples") > 0).select(key, parts.alias("parts"), F.array_max(F.transform("samples", lambda v: F.abs(v.cast("double")))).alias("peak"))
    energy = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["e"])
    count = F.aggregate("parts", F.lit(0), lambda a, p: a + p["n"])
    rows = rows.select(key, "peak", energy.alias("e"), count.alias("n"), F.array_min(F.transform("parts", lambda p: p["e"] / p["n"])).alias("floor"))
    return rows.groupBy(key).agg(decibels(F.sqrt(F.sum("e") / F.sum("n"))).alias("rms_db"), decibels(F.max("peak")).alias("peak_db"), decibels(F.sqrt(F.min("floor"))).alias("noise_floor_db"))


def envelopes_in_blocks(blocks: DataFrame, key: str, size: int, buckets: list[int]) -> DataFrame:
    """(key, buckets, bucket, peak): `waveform_peaks` of recordings in blocks, for several numbers of buckets in one pass.

    A block gives the largest magnitude of its share of each bucket that it meets; shares are combined by a maximum.
    """
    rows = blocks.where(F.size("samples") > 0)
    whole = rows.groupBy(key).agg(F.sum(F.size("samples")).cast("long").alias("total"))
    at, many = (F.col("block") * size).cast("long"), lambda b: F.least(F.lit(b).cast("long"), F.col("total"))
    edge = lambda k, b: F.floor(k * F.col("total") / many(b)).cast("long")
    number = lambda i, b: F.floor(((i + 1) * many(b) - 1) / F.col("total")).cast("long")  # noqa: E731  the bucket of a sample

    def shares(b: int) -> Column:
        first, last = number(at, b), number(at + F.size("samples") - 1, b)
        share = lambda k: F.slice("magnitude", F.greatest(edge(k, b) - at, F.lit(0)).cast("int") + 1, (F.least(edge(k + 1, b), at + F.size("samples")) - F.greatest(edge(k, b), at)).cast("int"))
        return F.transform(F.sequence(first, last), lambda k: F.struct(F.lit(b).alias("buckets"), k.alias("bucket"), F.array_max(share(k)).alias("peak")))

    sized_ = rows.join(small(whole), key).withColumn("magnitude", F.transform("samples", lambda v: F.abs(v.cast("double"))))
    peaks = sized_.select(key, F.inline(F.concat(*[shares(b) for b in buckets]))).groupBy(key, "buckets", "bucket").agg(F.max("peak").alias("peak"))
    top = rows.groupBy(key).agg(F.max(F.array_max(F.transform("samples", lambda v: F.abs(v.cast("double"))))).alias("top"))
    relative = F.when(F.col("top") > 0, F.round(F.col("peak") / F.col("top"), 4)).otherwise(F.col("peak"))
    return peaks.join(small(top), key).select(key, "buckets", "bucket", relative.alias("peak"))


def longest_silences(runs: DataFrame, key: str, n: int | Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("length"), "start"))
    return runs.withColumn("rank", rank).where(F.col("rank") <= n)


def stretched(long: DataFrame, chosen: DataFrame, key: str, target: int) -> DataFrame:
    """Samples with the position that they have once each chosen silence is at least `target` long."""
    pads = chosen.select(key, (F.col("start") + F.col("length")).alias("i"), F.greatest(F.lit(0), F.lit(target) - F.col("length")).alias("pad"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return long.join(pads, [key, "i"], "left").withColumn("at", F.col("i") + F.coalesce(F.sum("pad").over(w), F.lit(0))).drop("pad")


def trim_edges(samples: Column, margin: int, threshold: float = THRESHOLD) -> Column:
    """From the first to the last loud sample, with a margin; all quiet gives nothing."""
    loud = F.filter(F.transform(samples, lambda v, i: F.when(F.abs(v) > threshold, i)), lambda x: x.isNotNull())
    start = F.greatest(F.lit(0), F.array_min(loud) - margin)
    end = F.least(F.size(samples), F.array_max(loud) + margin)
    return F.when(F.size(loud) > 0, F.slice(samples, start + 1, F.greatest(F.lit(0), end - start))).otherwise(F.slice(samples, 1, 0))


def settled_sum(rows: DataFrame, key: str, value: str, *more: Column) -> DataFrame:
    """(key, value, ..) with the sum of values of 0 or more in each group, the same whatever order the rows come in.

    Values of one power of two are summed as whole numbers, exactly; the sums, of which a group has about 2,000 at most, are then added
    from the smallest on. Values that are not finite give the plain sum. `more` are aggregates of columns whose sums are exact.
    """
    power = F.floor(F.log2(value)).cast("int")
    whole = F.col(value) * F.pow(F.lit(2.0), 52 - F.col("_power"))
    parts = rows.withColumn("_power", F.when((F.col(value) > 1e-290) & (F.col(value) < 1e290), power)).groupBy(key, "_power")
    parts = parts.agg(F.sum(whole.cast("decimal(17,0)")).alias("_whole"), F.sum(value).alias("_plain"), *more)
    back = F.transform(F.sort_array(F.collect_list(F.when(F.col("_power").isNotNull(), F.struct("_power", "_whole")))), lambda p: p["_whole"].cast("double") * F.pow(F.lit(2.0), p["_power"] - 52))
    rest = F.coalesce(F.sum(F.when(F.col("_power").isNull(), F.col("_plain"))), F.lit(0.0))
    names = [c for c in parts.columns if c not in (key, "_power", "_whole", "_plain")]
    return parts.groupBy(key).agg((F.aggregate(back, F.lit(0.0), lambda a, x: a + x) + rest).alias(value), *[F.sum(c).alias(c) for c in names])


def sum_in_order(rows: DataFrame, key: str, order: str, value: str, *more: Column, size: int = ADDENDS) -> DataFrame:
    """(key, value, ..) with the sum of values of 0 or more in each group, to the bit as if added one by one in the order of a column,
    though by many tasks. Values of the same order are added from the smallest on; nulls add nothing.

    While a sum stays between two powers of two, a block of `size` values adds one amount to every sum whose last bit is 0, and one to
    every sum whose last bit is 1. Only where it may reach the next power does a block keep its values. So a group's blocks are added
    in turn from one narrow row each. `more` are aggregates of columns whose sums are exact.
    """
    placed = numbered(rows.withColumn(value, F.coalesce(value, F.lit(0.0))), key, [order, value], "_place")
    placed = placed.withColumn("_block", F.floor(F.col("_place") / size))
    sums = placed.groupBy(key, "_block").agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"), *more)
    names = [c for c in sums.columns if c not in (key, "_block", "_sum", "_n")]
    so_far = Window.partitionBy(key).orderBy("_block")
    sums = sums.withColumns({"_high": F.sum("_sum").over(so_far), "_low": F.coalesce(F.sum("_sum").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    # Sums of n values in two orders differ by less than n times 2^-52 of them; the rest is for the logarithm.
    off = (F.sum("_n").over(so_far) + 4096) * 2.0**-52
    power = F.floor(F.log2(F.col("_low") * (1 - off)))
    within = (F.col("_low") > 1e-250) & (F.col("_high") < 1e290) & (power == F.floor(F.log2(F.col("_high") * (1 + off))))
    sums = sums.withColumn("_power", F.when(within, power)).withColumn("_plain", (F.col("_sum") == 0) | ~(F.col("_low") < 1e290))
    sums = small(sums.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), "_sum", "_power", "_plain", *names))

    held = placed.groupBy(key, "_block").agg(F.sort_array(F.collect_list(F.struct("_place", value))).alias("_values"))
    held = held.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")))
    add = lambda values, start: F.aggregate(values, start, lambda a, x: a + x[value])
    added = lambda start: add(F.col("_values"), start) - start
    first, unit = F.pow(F.lit(2.0), F.col("_power")), F.pow(F.lit(2.0), F.col("_power") - 52)
    even = F.when(F.col("_plain"), F.col("_sum")).when(F.col("_power").isNotNull(), added(first))
    odd = F.when(~F.col("_plain") & F.col("_power").isNotNull(), added(first + unit))
    block = F.struct("_block", even.alias("even"), odd.alias("odd"), F.when(odd.isNotNull(), unit).alias("unit"), F.when(even.isNull(), F.col("_values")).alias("values"))

    def step(a: Column, b: Column) -> Column:
        last_bit = F.when(b["unit"].isNotNull(), (a / b["unit"]).cast("long") % 2)
        return F.when(b["even"].isNull(), add(b["values"], a)).otherwise(a + F.when(last_bit == 1, b["odd"]).otherwise(b["even"]))

    blocks = held.select(key, block.alias("_row"), *names).groupBy(key).agg(F.sort_array(F.collect_list("_row")).alias("_rows"), *[F.sum(c).alias(c) for c in names])
    return blocks.select(key, F.aggregate("_rows", F.lit(0.0), step).alias(value), *names)


def normalized(clips: DataFrame, book: str, samples: str, target_rms: float, ceiling: float, default_gain: float = 1.0, order: str | None = None) -> DataFrame:
    """Two passes: a book's RMS gives its gain; samples are scaled and capped. Without a measurement the default gain holds.

    With a column `order` a book's energy is added clip by clip in that order, else exactly; neither depends on the order of rows.
    """
    square = F.aggregate(samples, F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double") * v.cast("double"), F.lit(0.0)))
    measured, n = clips.select(book, *([order] if order else []), square.alias("e"), F.size(samples).alias("n")), F.sum("n").alias("n")
    sums = sum_in_order(measured, book, order, "e", n) if order else settled_sum(measured, book, "e", n)
    rms = sums.select(book, F.sqrt(F.try_divide("e", "n")).alias("rms"))
    gain = F.coalesce(F.when(F.col("rms") > 0, target_rms / F.col("rms")), F.lit(default_gain))
    scaled = F.transform(samples, lambda v: F.greatest(F.lit(-ceiling), F.least(F.lit(ceiling), v.cast("double") * F.col("gain"))))
    return clips.join(small(rms), book, "left").withColumn("gain", gain).withColumn(samples, scaled)


def clip_windows(total: Column, start: Column, duration: Column, least: float = 6.0, most: float = 30.0) -> tuple[Column, Column]:
    """(start, reason): the start asked for, centred if it overruns; a reason where the clip is refused."""
    reason = F.when((duration < least) | (duration > most), "length").when(total < duration, "too short")
    return F.when(start + duration > total, F.greatest(F.lit(0.0), (total - duration) / 2)).otherwise(start), reason


def cut_segment(samples: Column, rate: int, start: Column, duration: Column) -> Column:
    begin, size = F.greatest(start, F.lit(0.0)), F.greatest(duration, F.lit(0.1))
    return F.slice(samples, F.floor(begin * rate).cast("int") + 1, F.floor(size * rate).cast("int"))
