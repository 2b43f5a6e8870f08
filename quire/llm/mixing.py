"""Operator 4, mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common

#: No document is taken more often.
CAP = 2
#: Sizes up to FINE are cells of their own; above, a cell spans sizes to a factor of STEP. So a source has under 1,000 cells.
FINE, STEP = 64, 1.02
#: Bits of a hash by which rows of a cell are counted in buckets, to find where its last extra copy goes, and how often.
BITS, LEVELS = 8, 2


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shares(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = CAP) -> dict[str | None, float]:
    """A target for each source: `share` of all sizes by weight, at most cap x its size, the excess reshared by weight.

    Weights repeat over the sources in order of code points, null last.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, targets = share * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = [s for s in names if s in open_ and weight[s] * per > cap * sizes[s]]
        if not full:
            return targets | {s: weight[s] * per for s in open_}
        for s in full:
            targets[s] = float(cap * sizes[s])
            left -= targets[s]
            open_.remove(s)
    return targets


def _keys() -> dict[str, Column]:
    """size, source_key, cell and h (a hash of the row) of a row with doc_id, source and text."""
    size = words(F.col("text"))
    return {
        "size": size,
        "source_key": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")),
        "cell": F.when(size <= FINE, size).otherwise(FINE + F.ceil(F.log(size / FINE) / math.log(STEP))).cast("int"),
        "h": F.xxhash64("doc_id", "source", "text"),
    }


def keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, text) as doc_id, source, size, source_key, cell and h."""
    return docs.select("doc_id", "source", *[c.alias(name) for name, c in _keys().items()])


def _newton(cells: DataFrame, totals: dict[str, tuple[int, int, float]], tolerance: float = 1e-7, rounds: int = 80) -> dict[str, float]:
    """The dual of each source: the tilt l such that rates min(CAP, exp(l size / mean)) take its target of tokens.

    Each round sums the gradient and Hessian over the cells, which stay distributed; the driver holds a tilt and its bracket for
    each source, the dimension of the dual. The gradient grows with l, so a Newton step that leaves the bracket is halved instead.
    A dual that isn't solved in so many rounds is an error.
    """
    spark = cells.sparkSession
    dual = {k: math.inf if t > 0 else -math.inf for k, (_, s, t) in totals.items()}
    at = {k: math.log(t / s) for k, (_, s, t) in totals.items() if s and 0 < t < CAP * s * (1 - 1e-9)}
    bracket = dict.fromkeys(at, (-math.inf, math.inf))
    for _ in range(rounds):
        if not at:
            return dual
        now = spark.createDataFrame([(k, l, totals[k][1] / totals[k][0]) for k, l in at.items()], "source_key string, tilt double, mean double")
        z = F.col("s") / F.col("n") / F.col("mean")
        raw = F.exp(F.least(F.col("tilt") * z, F.lit(700.0)))
        taken = F.col("n") * z * F.least(raw, F.lit(float(CAP)))
        slope = F.when(raw < CAP, F.col("n") * z * z * raw).otherwise(0.0)
        for r in cells.join(common.bounded(now), "source_key").groupBy("source_key").agg(F.sum(taken).alias("g"), F.sum(slope).alias("h")).collect():
            n, size, target = totals[r.source_key]
            l, (low, high), off = at[r.source_key], bracket[r.source_key], n * target / size - r.g  # in mean sizes
            if abs(off) <= tolerance * n * target / size:
                dual[r.source_key] = at.pop(r.source_key)
                continue
            low, high = (l, high) if off > 0 else (low, l)
            step = l + off / r.h if r.h else math.nan
            if not low < step < high:
                step = (low + high) / 2 if math.isfinite(low) and math.isfinite(high) else 2 * l + 1 if off > 0 else 2 * l - 1
            at[r.source_key], bracket[r.source_key] = step, (low, high)
    if at:
        raise ArithmeticError(f"the dual of {len(at)} sources, such as {min(at)!r}, isn't solved after {rounds} rounds")
    return dual


def _round(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies of each cell of a source, from large sizes to small; what rounding leaves over is carried on, so that in the end the
    source is off its expected tokens by half of its smallest size. A source has under 1,000 cells."""
    cells = cells.sort_values("cell", ascending=False, kind="stable")
    carry, out = 0.0, []
    for s, n, rate in zip(cells["s"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
        carry += rate * s
        k = min(CAP * n, max(0, round(carry * n / s if s else n * rate)))
        carry -= k * s / n
        out.append(k)
    return cells.assign(copies=out)[["source_key", "cell", "n", "rate", "copies"]]


def rates(rows: DataFrame, targets: dict[str | None, float]) -> DataFrame:
    """source_key, cell, n, rate and copies: what each cell of keyed() rows takes such that each source meets its target of tokens.

    Rates minimise the relative entropy to the corpus (a rate of 1) under the token constraint of each source and the cap: they are
    exponentially tilted by size, so a source that must shrink gives up long documents first. The convex dual is solved by Newton
    steps over the cells (source and size, to within STEP), which have counts and sums; then whole copies are dealt to cells.
    """
    cells = common.save(rows.groupBy("source_key", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("s")), "mix-cells")
    totals = {r.source_key: (r.n, r.s) for r in cells.groupBy("source_key").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    goal = {"null" if s is None else f"s{s}": t for s, t in targets.items()}
    dual = _newton(cells, {k: (n, s, goal.get(k, 0.0)) for k, (n, s) in totals.items()})
    table = rows.sparkSession.createDataFrame([(k, max(-1e300, min(1e300, l)), max(totals[k][1] / totals[k][0], 1e-9)) for k, l in dual.items()], "source_key string, tilt double, mean double")
    rate = F.least(F.lit(float(CAP)), F.exp(F.least(F.col("tilt") * F.col("s") / F.col("n") / F.col("mean"), F.lit(700.0))))
    rated = cells.join(common.bounded(table), "source_key").select("source_key", "cell", "n", "s", rate.alias("rate"))
    return common.save(rated.groupBy("source_key").applyInPandas(_round, "source_key string, cell int, n long, rate double, copies long"), "mix-copies")


def cuts(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """source_key, cell, n, `all` and `cut`: a row of the cell is taken `all` times, and once more if its hash is at most `cut` (null: no row is).

    A cell's rows are counted in 2 ** BITS buckets of their hashes, by partial sums, and so are those of the bucket in which the last
    extra copy falls, LEVELS times; only what is left in the last bucket is ranked. So a window has 2 ** BITS rows of a cell, and in
    the end 2 ** -(BITS * LEVELS) of them, even if the cell has most of all rows.
    """
    cell = ["source_key", "cell"]
    dealt = dealt.select(*cell, "n", F.floor(F.col("copies") / F.col("n")).alias("all"), (F.col("copies") % F.col("n")).alias("rest"))
    rows, last = rows.select(*cell, "h"), dealt.where("rest > 0").select(*cell, "rest", F.lit(None).cast("long").alias("bucket"))
    for level in range(LEVELS + 1):
        here = F.shiftright("h", 64 - BITS * level) == F.col("bucket") if level else F.lit(True)
        found = rows.join(common.bounded(last), cell).where(here)
        order = Window.partitionBy(*cell)
        if level == LEVELS:
            ranked = found.withColumn("rank", F.row_number().over(order.orderBy("h"))).where("rank = rest")
            return common.save(dealt.join(ranked.select(*cell, F.col("h").alias("cut")), cell, "left").select(*cell, "n", "all", "cut"), "mix-cuts")
        counts = found.groupBy(*cell, "rest", F.shiftright("h", 64 - BITS * (level + 1)).alias("bucket")).agg(F.count("*").alias("m"))
        counts = counts.withColumn("upto", F.sum("m").over(order.orderBy("bucket"))).where("upto >= rest AND upto - m < rest")
        last = common.save(counts.select(*cell, (F.col("rest") - F.col("upto") + F.col("m")).alias("rest"), "bucket"), "mix-last")


def applied(rows: DataFrame, cut: DataFrame, to: str = "copies") -> DataFrame:
    """rows with the copies of each, a long; a narrow pass where the cells may be sent, as is their case below about a thousand sources."""
    copies = F.col("all") + (F.col("h") <= F.coalesce("cut", F.lit(-(1 << 63)))).cast("long")
    return common.looked_up(rows, cut, ["source_key", "cell"], "n").withColumn(to, F.when(F.col("cut").isNull(), F.col("all")).otherwise(copies)).drop("all", "cut", "n")


def mix(rows: DataFrame, targets: dict[str | None, float]) -> DataFrame:
    """Whole copies (0, 1 or 2) of each row of keyed() rows such that each source comes near its target of tokens: rows with `copies`.

    Within a cell, the rows lowest by a hash of doc_id, source and text take one more; rows that are equal in all three tie, and are
    taken equally often. Null sources are one source; documents of size 0 take nothing.
    """
    return applied(rows, cuts(rows, rates(rows, targets)))


def balanced(docs: DataFrame) -> tuple[DataFrame, dict[str | None, int], dict[str | None, float]]:
    """keyed() rows with copies, the sources' sizes and their targets for docs(doc_id, source, text)."""
    rows = common.save(keyed(docs), "mix")
    sizes = {r.source: r.size for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    return mix(rows, shares(sizes) if sizes else {}), sizes, shares(sizes) if sizes else {}


def mixture(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns, whatever their names.

    Each row is decided by itself, so rows that share a doc_id, or have none, are no special case; only rows that are equal in doc_id,
    source and text tie, and are taken equally often. Texts are read where they lie: no shuffle carries them. Null texts and those
    without words count nothing, and are taken at their source's rate for size 0. An empty table gives no rows.
    """
    rows = common.save(keyed(docs), "mix")
    sizes = {r.source: r.size for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    cut = cuts(rows, rates(rows, shares(sizes) if sizes else {}))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in _keys().items()])
    taken = applied(whole, cut)
    return taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op4_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken: words of the whole copies taken. An empty table gives no rows; a null source comes last; null texts have size 0."""
    copies, sizes, targets = balanced(common.documents(spark, sf_dir))
    table = spark.createDataFrame([(s, int(sizes[s]), float(targets[s])) for s in sizes], "name string, source_size long, target double")
    return copies.join(common.bounded(table), F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
