"""Quality rules: base rules, and robust multivariate outliers by minimum covariance determinant, in DataFrame functions only.

Each document gets counts of words, symbols, repeated lines and repeated five-word windows. Transformed, they form a vector.
For each language and source, concentration steps (the three quarters of the documents that lie nearest give the next
estimate) run from several starts: medians with median deviations, and subsets drawn by hashes of the rows. The starts with
the least determinants go on until no step lowers one further; the least is reweighted once. Means and products are then
drawn towards those of the language, and these towards those of all, by a weight that falls with the number of documents, so
that groups of any size have an estimate. Documents whose Mahalanobis distance exceeds the cut-off are rejected. All this
passes over the narrow table of statistics only, with partial aggregation: a source with a third of all rows is no hot spot.

Null texts have no words. Null languages and sources are groups of their own. Repeated rows are judged each, and count each.
Texts of any length are taken whole; an empty table gives an empty result. Windows are compared by 64-bit hashes within one
text. Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD_GAP, hot_keys, saved, spread_join

WINDOW = 5
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
AXES = ["x0", "x1", "x2", "x3", "x4"]
#: Least standard deviation on each axis: most statistics are zero in most documents, which leaves the scatter singular.
FLOORS = [0.3, 0.15, 0.12, 0.12, 0.12]
KEPT_SHARE = 0.75
#: Random starts beside that of the medians, rows of each, steps before the selection, how many go on, and the least fall of
#: the log-determinant that counts as one.
STARTS, START_ROWS, FIRST_STEPS, GO_ON, LEAST_FALL = 6, 30, 2, 2, 1e-3
#: Documents that the wider group counts for in the estimate of a narrower one.
PULL = 50
#: Median and 97.5 % quantile of chi-squared with five degrees of freedom.
CHI_MEDIAN, CHI_975 = 4.3515, 12.8325
#: Largest squared distance of a document that is kept; tails are heavier than normal, so it lies far out.
CUT = 60.0


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, lang, source and the counts of every row; `text` is read once and dropped."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select("doc_id", "lang", "source", t.alias("t"))
    df = df.withColumn("ws", F.split(F.expr(r"regexp_replace(t, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+\\z', '')"), WORD_GAP))
    df = df.withColumn("ws", F.when(F.get("ws", F.lit(0)) == "", F.array().cast("array<string>")).otherwise(F.col("ws")))
    df = df.withColumn("lines", F.expr(r"filter(split(t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    df = df.select(
        "doc_id", "lang", "source",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.expr("length(regexp_replace(t, '[^#*$%&|<>]+', ''))").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(ws, x -> xxhash64(x))").alias("h"),
    )
    following = ", ".join(f"h[i + {k}]" for k in range(1, WINDOW))
    df = df.withColumn("win", F.expr(f"if(n_words >= {WINDOW}, transform(slice(h, 1, cast(n_words as int) - {WINDOW - 1}), (x, i) -> xxhash64(x, {following})), array())")).drop("h")
    # Only texts with a repeated window are sorted.
    df = df.withColumn("s", F.expr("if(size(array_distinct(win)) < size(win), sort_array(transform(win, (x, i) -> struct(x as h, i as p))), null)")).drop("win")
    df = df.withColumn("p", F.expr("sort_array(transform(filter(s, (x, i) -> x.h = get(s, i - 1).h or x.h = get(s, i + 1).h), x -> x.p))")).drop("s")
    covered = F.expr(f"aggregate(transform(p, (x, i) -> least({WINDOW}, coalesce(get(p, i + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x)")
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def vector() -> list[Column]:
    """The transformed statistics: size, mean word length, and roots of the shares of symbols, repeated lines and windows."""
    n = F.col("n_words").cast("double")
    return [F.log(n + 10), (F.col("word_chars") + 165) / (n + 30), F.sqrt(F.col("n_symbols") / (n + 10)), F.sqrt(F.col("n_dup_lines") / (n / 20 + 1)), F.sqrt(F.col("n_repeat_words") / (n + 10))]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _distance(df: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance `d` from columns m0.. and the lower factor l00, l10, l11.. of the scatter."""
    for i in range(5):
        known = sum((F.col(f"l{i}{j}") * F.col(f"y{j}") for j in range(i)), F.lit(0.0))
        df = df.withColumn(f"y{i}", (F.col(AXES[i]) - F.col(f"m{i}") - known) / F.col(f"l{i}{i}"))
    return df.withColumn("d", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, 5)), F.col("y0") * F.col("y0")))


MEANS = [f"m{i}" for i in range(5)]
PRODUCTS = [f"p{i}{j}" for i in range(5) for j in range(i, 5)]
FACTOR = [f"l{i}{j}" for i in range(5) for j in range(i + 1)]
LOG_DET = "2 * (" + " + ".join(f"ln(l{i}{i})" for i in range(5)) + ")"


def _factor(moments: DataFrame, *keys: str) -> DataFrame:
    """Location, lower factor of the regularised scatter, and its log-determinant `det`, from means and mean products."""
    df = moments
    for i in range(5):
        for j in range(i + 1):
            s = F.col(f"p{j}{i}") - F.col(f"m{i}") * F.col(f"m{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            s = s - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(FLOORS[i] ** 2 / 4))) if i == j else s / F.col(f"l{j}{j}"))
    return df.select(*keys, *MEANS, *FACTOR, F.expr(LOG_DET).alias("det"))


def _moments(df: DataFrame, *keys: str) -> DataFrame:
    means = [F.avg(x).alias(m) for x, m in zip(AXES, MEANS, strict=True)]
    products = [F.avg(F.col(AXES[i]) * F.col(AXES[j])).alias(f"p{i}{j}") for i in range(5) for j in range(i, 5)]
    return df.groupBy(*keys).agg(*means, *products, F.count("*").alias("n"))


def _beside(points: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Points with what is known of their strata: broadcast if counted to be few, else only for strata of very many points."""
    if known.count() <= BROADCAST_ROWS:
        return points.join(F.broadcast(known), keys)
    return spread_join(points, known, keys, "inner", hot_keys(points, keys, "mcd"), "mcd")


def _starts(points: DataFrame) -> DataFrame:
    """(stratum, start, location, factor, det): start 0 from medians, the others from about START_ROWS rows each."""
    middle = saved(points.groupBy("stratum").agg(F.count("*").alias("rows"), *[F.percentile_approx(x, 0.5, 2000).alias(m) for x, m in zip(AXES, MEANS, strict=True)]), "mcd-medians")
    here = _beside(points, middle, ["stratum"])
    off = here.groupBy("stratum").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(m)), 0.5, 2000).alias(f"a{i}") for i, (x, m) in enumerate(zip(AXES, MEANS, strict=True))])
    spread = lambda i, j: F.greatest(1.4826 * F.col(f"a{i}"), F.lit(FLOORS[i])) if i == j else F.lit(0.0)
    first = middle.join(off, "stratum").select("stratum", F.lit(0).alias("start"), *MEANS, *[spread(i, j).alias(f"l{i}{j}") for i in range(5) for j in range(i + 1)])
    drawn = here.select("stratum", *AXES, "rows", "draw", F.explode(F.sequence(F.lit(1), F.lit(STARTS))).alias("start"))
    drawn = drawn.where(F.pmod(F.xxhash64("draw", "start"), F.greatest(F.lit(1), F.floor(F.col("rows") / START_ROWS))) == 0)
    return first.withColumn("det", F.expr(LOG_DET)).unionByName(_factor(_moments(drawn, "stratum", "start"), "stratum", "start"))


def _step(points: DataFrame, now: DataFrame) -> DataFrame:
    """A concentration step for each estimate of `now`, a saved table."""
    at = _distance(_beside(points, now.drop("det"), ["stratum"])).select("stratum", "start", *AXES, "d")
    edge = saved(at.groupBy("stratum", "start").agg(F.percentile_approx("d", KEPT_SHARE, 2000).alias("edge")), "mcd-edge")
    # Edges go along with the estimates, so that points meet both at once.
    near = _distance(_beside(points, now.drop("det").join(edge, ["stratum", "start"]), ["stratum"])).where("d <= edge")
    return saved(_factor(_moments(near, "stratum", "start"), "stratum", "start"), "mcd-step")


def least_determinants(points: DataFrame) -> DataFrame:
    """(stratum, location, factor, det) of the least determinant found; points: stratum, the axes and a hash `draw` of the row."""
    now = saved(_starts(points), "mcd-starts")
    for _ in range(FIRST_STEPS):
        now = _step(points, now)
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("det", "start"))
    moving, settled = saved(now.withColumn("place", place).where(F.col("place") <= GO_ON).drop("place"), "mcd-best"), []
    # Each round lowers every estimate that stays by LEAST_FALL or more; the floors bound determinants from below.
    while not moving.isEmpty():
        new = _step(points.join(F.broadcast(moving.select("stratum").distinct()), "stratum", "left_semi") if moving.count() <= BROADCAST_ROWS else points, moving)
        both = moving.join(new.select("stratum", "start", F.col("det").alias("next")), ["stratum", "start"])
        settled.append(saved(both.where(F.col("next") > F.col("det") - LEAST_FALL).drop("next"), "mcd-settled"))
        moving = saved(new.join(both.where(F.col("next") <= F.col("det") - LEAST_FALL).select("stratum", "start"), ["stratum", "start"], "left_semi"), "mcd-moving")
    if not settled:
        return now.drop("start")
    found = reduce(DataFrame.unionByName, settled)
    best = F.min_by(F.struct(*MEANS, *FACTOR, "det"), F.struct("det", "start"))
    return saved(found.groupBy("stratum").agg(best.alias("x")).select("stratum", "x.*"), "mcd-least")


def _drawn_to(narrow: DataFrame, wide: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """`values` of narrower groups, each with the number `n` of its documents, drawn towards those of wider ones."""
    named = wide.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    both = narrow.join(named, keys) if keys else narrow.crossJoin(F.broadcast(named))  # one row
    return both.withColumns({v: (F.col("n") * F.col(v) + PULL * F.col(f"_{v}")) / (F.col("n") + PULL) for v in values}).drop(*[f"_{v}" for v in values])


def _wider(moments: DataFrame, *keys: str) -> DataFrame:
    sums = [(F.sum(F.col("n") * F.col(v)) / F.sum("n")).alias(v) for v in MEANS + PRODUCTS]
    return moments.groupBy(*keys).agg(*sums, F.sum("n").alias("n"))


def _scales(at: DataFrame, *keys: str) -> DataFrame:
    middle = F.greatest(F.percentile_approx("d", 0.5, 2000), F.lit(CHI_MEDIAN / 2))
    return at.groupBy(*keys).agg((middle / CHI_MEDIAN).alias("scale"), F.count("*").alias("n"))


def estimates(points: DataFrame) -> DataFrame:
    """Location, factor and `scale` (of squared distances) of each stratum; points: stratum, coarse, the axes and `draw`."""
    least = least_determinants(points)
    at = _distance(_beside(points, least.drop("det"), ["stratum"])).select("stratum", "coarse", *AXES, "d")
    scale = saved(_scales(at, "stratum").drop("n"), "mcd-scale")
    near = _beside(at, scale, ["stratum"]).where(F.col("d") <= CHI_975 * F.col("scale"))
    own = saved(_moments(near, "stratum", "coarse"), "mcd-own")
    values = MEANS + PRODUCTS
    by_language = saved(_drawn_to(_wider(own, "coarse"), _wider(own), [], values), "mcd-language")
    now = saved(_factor(_drawn_to(own, by_language, ["coarse"], values), "stratum"), "mcd-last")
    at = saved(_distance(_beside(points, now.drop("det"), ["stratum"])).select("stratum", "d"), "mcd-at")
    scale = _drawn_to(_scales(at, "stratum"), _scales(at), [], ["scale"]).drop("n")
    return saved(now.join(scale, "stratum"), "mcd")


def judged(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null in a group where all fail) and kept of every row."""
    rows = statistics(docs)
    group = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    rows = rows.select("doc_id", *STATISTICS, base_failed().alias("base_failed"), *[v.alias(a) for v, a in zip(vector(), AXES, strict=True)], group.alias("stratum"), F.to_json(F.struct("lang"), {"ignoreNullFields": "false"}).alias("coarse"))
    rows = saved(rows, "rules")
    points = rows.where("not base_failed").select("stratum", "coarse", *AXES, F.xxhash64("doc_id", *AXES).alias("draw"))
    found = estimates(points).drop("det")
    placed = rows.join(F.broadcast(found), "stratum", "left") if found.count() <= BROADCAST_ROWS else spread_join(rows, found, ["stratum"], "left", hot_keys(rows, ["stratum"], "rules"), "rules")
    out = _distance(placed).withColumn("distance", F.col("d") / F.col("scale"))
    verdict = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)
    return out.select("doc_id", *STATISTICS, "base_failed", verdict.alias("kept"), "distance")


def query(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
