"""Mixing sources by temperature into token budgets, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moundlake.llm.common import cut_lineage
from moundlake.runtime import bounded_broadcast

# The exponent is found on a grid of 2**EXPONENT_BITS steps, a few bits in one pass over the sources.
EXPONENT_BITS, BITS_A_PASS = 20, 5
# Powers of shares are summed as whole numbers of this part, so sums don't depend on their order.
UNIT = 10**12
# A token is a run of other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def digest(*parts: Column | str | int) -> Column:
    """60 bits of a hash of the parts as text."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Blend:
    """The exponent found and what the quotas follow from: each is about ``budget * power / total``."""

    exponent: float
    budget: int
    total: int
    tokens: int
    limits_met: bool = True


def power(share: Column, exponent: float) -> Column:
    return F.round(F.pow(share, F.lit(exponent)) * UNIT).cast("long")


def raised(exponent: float, tokens: int) -> Column:
    """The source's share to the power ``exponent`` in whole numbers; at 1 its tokens themselves, so that nothing is rounded away."""
    return F.col("tokens") if exponent == 1.0 else power(F.col("tokens") / F.lit(float(max(tokens, 1))), exponent)


def sums(exponents: list[float], tokens: int) -> list[Column]:
    share = F.col("tokens") / F.lit(float(tokens))
    whole = lambda c: F.sum(c.cast("decimal(38,0)"))
    return [F.struct(
        whole(power(share, a)).alias("total"),
        whole(F.round(F.pow(share, F.lit(a)) * -F.log(share) * UNIT).cast("long")).alias("surprise"),
        F.max(F.pow(share, F.lit(a - 1))).alias("most"), F.min(F.pow(share, F.lit(a - 1))).alias("least"),
    ).alias(f"s{i}") for i, a in enumerate(exponents)]


def find_blend(
    sources: DataFrame, budget_ratio: float | None, max_repeats: float | None, entropy_share: float | None, entropy_rise: float | None = None
) -> Blend:
    """The smallest exponent in [0, 1], so the flattest mix, that keeps the limits.

    Repetitions grow and entropy grows as the exponent falls, so the limits hold from some
    grid point on, which is found by bisection, several halvings in one aggregation over the
    (source, tokens) rows. Only the sums come to the driver.
    """
    size = sources.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    tokens, n = int(size["tokens"] or 0), size["n"]
    if not tokens:
        return Blend(1.0, 0, 1, 0)

    def entropy(a: float, s) -> float:
        return log(float(s["total"]) / UNIT) + a * float(s["surprise"]) / float(s["total"])

    natural = entropy(1.0, sources.agg(*sums([1.0], tokens)).first()["s0"])
    limit = min(
        log(n) if entropy_share is None else entropy_share * log(n), log(n) if entropy_rise is None else natural + entropy_rise * (log(n) - natural)
    )

    def allowed(a: float, s) -> bool:
        total, most = float(s["total"]) / UNIT, float(s["most"])
        ratio = most / s["least"] if budget_ratio is None else budget_ratio * most / total
        return (max_repeats is None or ratio <= max_repeats + 1e-9) and entropy(a, s) <= limit + 1e-9

    # in grid steps; the exponent 1, no change, is taken where nothing less is allowed
    low, high = -1, 1 << EXPONENT_BITS
    while high - low > 1:
        width = high - low
        points = sorted({low + width * i // (1 << BITS_A_PASS) for i in range(1, 1 << BITS_A_PASS)} - {low, high}) or [low + 1]
        row = sources.agg(*sums([p / (1 << EXPONENT_BITS) for p in points], tokens)).first()
        for i, p in enumerate(points):
            if allowed(p / (1 << EXPONENT_BITS), row[f"s{i}"]):
                high = p
                break
            low = p
    exponent = high / (1 << EXPONENT_BITS)
    own = raised(exponent, tokens)
    largest = F.max_by(F.struct("tokens", own.alias("power")), F.col("tokens") / own).alias("largest")
    last = sources.agg(F.sum(own.cast("decimal(38,0)")).alias("total"), *sums([exponent], tokens), largest).first()
    total = int(last["total"])
    if budget_ratio is None:  # the least budget that takes every source whole
        budget = -(-int(last["largest"]["tokens"]) * total // int(last["largest"]["power"]))
    else:
        budget = int(tokens * budget_ratio)
        if exponent == 1.0 and max_repeats is not None:
            budget = min(budget, int(tokens * max_repeats))
    return Blend(exponent, budget, total, tokens, entropy(exponent, last["s0"]) <= limit + 1e-9)


def allot(sources: DataFrame, blend: Blend, block_tokens: int) -> DataFrame:
    """``(source, all_tokens, blocks, quota)``: the budget dealt by largest remainder, equal remainders by name.

    The remainders are put in order range by range, so that no task orders all sources.
    """
    product, total = F.col("power").cast("decimal(19,0)") * F.lit(blend.budget).cast("decimal(19,0)"), f"CAST('{blend.total}' AS decimal(38,0))"
    floors = cut_lineage(sources.select(
        "source", F.col("tokens").alias("all_tokens"), F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).cast("long").alias("blocks"),
        raised(blend.exponent, blend.tokens).alias("power"),
    ).withColumn("product", product).selectExpr(
        "source", "all_tokens", "blocks", f"product div {total} AS quota", f"product % {total} AS rest"
    ).withColumn("range", F.expr(f"255 - CAST(floor(255 * (CAST(rest AS double) / {float(blend.total)}D)) AS int)")))
    sizes = floors.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("quota").alias("quota"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # at most 256 rows
    spare = blend.budget - int(sizes.agg(F.sum("quota")).first()[0] or 0)
    place = F.col("before") + F.row_number().over(W.partitionBy("range").orderBy(F.desc("rest"), "source"))
    placed = floors.join(F.broadcast(starts), "range").withColumn("place", place)
    return placed.select("source", "all_tokens", "blocks", (F.col("quota") + (F.col("place") <= spare).cast("long")).alias("quota"))


def running(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before, by the 60-bit number ``order``.

    In two levels, so that no task orders all rows of a key: sums of 256 ranges of ``order``
    first, then the rows of one range.
    """
    ranged = rows.withColumn("range", F.shiftright(order, 52))
    sums_ = ranged.groupBy(*keys, "range").agg(F.sum(value).alias("in_range"))
    before = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums_.select(*keys, "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("range_start"))
    inside = W.partitionBy(*keys, "range").orderBy(order, "block").rowsBetween(W.unboundedPreceding, -1)
    own = ranged.withColumn("own_start", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(starts, [*keys, "range"]).withColumn(out, F.col("range_start") + F.col("own_start")).drop("range", "range_start", "own_start")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_ratio: float | None = 1.0,
    max_repeats: float | None = 4.0, entropy_share: float | None = None, block_tokens: int = 100_000, seed: int = 42, carry: list[str] | None = None,
    entropy_rise: float | None = 0.5,
) -> DataFrame:
    """``(row, epoch, block, tokens, start, quota, limits_met)``: the documents of the mix, a row for each time one is used.

    A source's weight is its share of tokens to a power in [0, 1], normalised. The power is the
    smallest that keeps every source within ``max_repeats`` passes and the entropy of the weights
    within ``entropy_share`` of the largest possible, and lets it rise by ``entropy_rise`` of the way
    from that of the shares as they are (0, which changes nothing) to the largest (1). The latter can
    always be met; an ``entropy_share`` below what the shares have can't, since powers in [0, 1] only
    raise it: then the power is 1 and ``limits_met`` false. The budget is ``budget_ratio`` times all tokens,
    or, if None, the least that uses every source whole; it is dealt in whole tokens by largest remainder,
    so that a power and ratio of 1 use every document once. A source's quota of the budget is filled
    in epochs: its documents lie in blocks of about ``block_tokens`` by a hash, each epoch takes
    the blocks in an order of its own and the documents of a block likewise, and ``start`` counts the
    source's tokens before; documents that end within the quota are used. The union of all
    rows ordered by ``start / quota`` is one interleaved stream.

    A third of all rows in one source makes no large task: quotas need (source, tokens) sums
    only, blocks are small and running sums go in two levels. Repeated documents count as they
    stand. ``row`` holds the input columns (or those in ``carry``), so names can't clash.

    Defined cases: a null source is the empty name; a null or empty text, like one word, has one
    token; null ids are ordered by their text; an empty table gives no rows.
    """
    carried = docs.columns if carry is None else carry
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"),
        F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1)).cast("long").alias("tokens"), digest(seed, F.col(f"`{id_col}`"), F.md5(text)).alias("key"),
    )
    sources = cut_lineage(base.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    blend = find_blend(sources, budget_ratio, max_repeats, entropy_share, entropy_rise)
    quotas = cut_lineage(allot(sources, blend, block_tokens))
    placed = base.join(bounded_broadcast(quotas.select("source", "blocks")), "source").withColumn("block", F.pmod("key", "blocks")).drop("blocks")
    sizes = placed.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    turns = quotas.where("quota > 0").select(
        "source", "all_tokens", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("all_tokens")))).alias("epoch")
    )
    ordered = sizes.join(turns, "source").withColumn("place", digest(seed, F.col("source"), F.col("epoch"), F.col("block")))
    begun = running(ordered, ["source", "epoch"], "place", "block_tokens", "before")
    used = begun.withColumn("block_start", F.col("epoch") * F.col("all_tokens") + F.col("before")).where("block_start < quota")
    in_block = W.partitionBy("source", "block", "epoch").orderBy(digest(seed, F.col("epoch"), F.col("key")), "key").rowsBetween(W.unboundedPreceding, -1)
    filled = placed.join(used.select("source", "block", "epoch", "block_start", "quota"), ["source", "block"]).withColumn(
        "start", F.col("block_start") + F.coalesce(F.sum("tokens").over(in_block), F.lit(0))
    )
    return filled.where("start + tokens <= quota").select("row", "epoch", "block", "tokens", "start", "quota", F.lit(blend.limits_met).alias("limits_met"))


def sql(
    budget_ratio: float = 1.0, max_repeats: float = 4.0, entropy_rise: float = 0.5, block_tokens: int = 100_000, seed: int = 42, source: str = "documents",
) -> str:
    """The mix of ``source`` as DuckDB text: ids instead of rows, the exponent by a recursive bisection."""
    word = "[^\\x20\\x09-\\x0D]+"
    hashed = lambda *parts: f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 15))::BIGINT"
    steps = 1 << EXPONENT_BITS
    raised = f"round(pow(t / tokens, a) * {UNIT})::BIGINT"
    entropy = f"""ln(sum({raised}) / {UNIT}.0) + any_value(a) * sum(round(pow(t / tokens, a) * -ln(t / tokens) * {UNIT})::BIGINT)::DOUBLE / sum({raised})::DOUBLE"""
    return f"""
    WITH RECURSIVE base AS (
        SELECT doc_id, coalesce(source, '') AS source, greatest(len(regexp_extract_all(coalesce(text, ''), '{word}')), 1)::BIGINT AS tokens,
               {hashed("coalesce(doc_id::VARCHAR, '')", "md5(coalesce(text, ''))")} AS key
        FROM {source}
    ),
    sources AS (SELECT source, sum(tokens)::BIGINT AS t FROM base GROUP BY ALL),
    whole AS (SELECT sum(t)::BIGINT AS tokens, count(*) AS n FROM sources),
    as_is AS (SELECT {entropy} AS own_entropy FROM (SELECT t, tokens, 1.0::DOUBLE AS a FROM sources, whole)),
    search(low, high) AS (
        SELECT -1, {steps}
        UNION ALL
        SELECT CASE WHEN good THEN low ELSE mid END, CASE WHEN good THEN mid ELSE high END
        FROM (
            SELECT low, high, mid, (
                SELECT {budget_ratio} * max(pow(t / tokens, a - 1)) / (sum({raised}) / {UNIT}.0) <= {max_repeats} + 1e-9
                   AND {entropy} <= any_value(own_entropy) + {entropy_rise} * (ln(any_value(n)) - any_value(own_entropy)) + 1e-9
                FROM (SELECT t, tokens, n, own_entropy, mid / {steps}.0::DOUBLE AS a FROM sources, whole, as_is)
            ) AS good
            FROM (SELECT low, high, (low + high) // 2 AS mid FROM search WHERE high - low > 1)
        )
    ),
    powers AS (SELECT source, t, tokens, CASE WHEN a = 1 THEN t ELSE {raised} END AS power, a FROM sources, whole, (SELECT min(high) / {steps}.0::DOUBLE AS a FROM search)),
    budget AS (
        SELECT sum(power) AS total,
               CASE WHEN any_value(a) = 1 THEN least(any_value(tokens) * {budget_ratio}, any_value(tokens) * {max_repeats})
                    ELSE any_value(tokens) * {budget_ratio} END::BIGINT AS budget
        FROM powers
    ),
    floors AS (
        SELECT source, t, budget, (power::HUGEINT * budget) // total AS least, (power::HUGEINT * budget) % total AS rest FROM powers, budget
    ),
    quotas AS (
        SELECT source, t, greatest(ceil(t / {block_tokens}), 1)::BIGINT AS blocks,
               (least + (row_number() OVER (ORDER BY rest DESC, source) <= budget - sum(least) OVER ())::INT)::BIGINT AS quota
        FROM floors
    ),
    placed AS (SELECT base.*, key % blocks AS block FROM base JOIN quotas USING (source)),
    sizes AS (SELECT source, block, sum(tokens)::BIGINT AS size FROM placed GROUP BY ALL),
    turns AS (SELECT source, t, quota, unnest(range((quota - 1) // t + 1)) AS epoch FROM quotas WHERE quota > 0),
    begun AS (
        SELECT source, block, epoch, quota, epoch * t + coalesce(sum(size) OVER (
            PARTITION BY source, epoch ORDER BY {hashed("source", "epoch::VARCHAR", "block::VARCHAR")}, block
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block_start
        FROM sizes JOIN turns USING (source)
    ),
    filled AS (
        SELECT doc_id, source, epoch, block, tokens, (block_start + coalesce(sum(tokens) OVER (
            PARTITION BY source, epoch, block ORDER BY {hashed("epoch::VARCHAR", "key::VARCHAR")}, key
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, quota
        FROM placed JOIN begun USING (source, block) WHERE block_start < quota
    )
    SELECT doc_id, source, epoch, block, tokens, start, quota FROM filled WHERE start + tokens <= quota
    """
