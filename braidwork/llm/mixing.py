"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic). Token sums per cell are raked: each pass scales the cells
so that the sums of one dimension meet its target shares, in turn, until all three hold. A document's weight is
its cell's factor; sampling keeps it with a probability in proportion to that weight, drawn by a hash of its id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm import common

DIMENSIONS = ("source", "lang", "topic")
#: Cells up to this number are raked on the driver; more are raked as a table, with the same steps.
DRIVER_CELLS = 200_000
#: Targets, where none are given: token shares to these powers. Under 1 they lift what is rare.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """A topic by the form of the text alone, where the caller has no better column."""
    size = F.greatest(F.length(text), F.lit(1))
    signs = F.length(F.regexp_replace(text, "[^|*&%#$!]++", ""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]++", ""))
    return (
        F.when(text.isNull() | (F.length(text) == 0), "empty")
        .when(text.contains(" | "), "table")
        .when(capitals * 2 > size, "shout")
        .when(signs * 20 > size, "signs")
        .when(F.length(text) < 400, "note")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Words between blanks, at least 1: a document without words still has a weight."""
    initials = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\S)\S*+\s*+|\s++", "$1")
    return F.greatest(F.length(initials), F.lit(1)).cast("bigint")


def with_cells(docs: DataFrame, topic: Column | None = None, seed: int = 17) -> DataFrame:
    """doc_id, the cell columns _source, _lang, _topic (nulls are a value of their own), _tokens, _draw (0 to 1, by a hash of id and text), and all columns of docs packed."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(-1)), F.coalesce("text", F.lit(""))), F.lit(1 << 40)) / float(1 << 40)
    return docs.select(
        "doc_id",
        F.coalesce(F.col("source"), F.lit(NONE)).alias("_source"),
        F.coalesce(F.col("lang"), F.lit(NONE)).alias("_lang"),
        F.coalesce(topic if topic is not None else topic_of(F.col("text")), F.lit(NONE)).alias("_topic"),
        tokens_of(F.col("text")).alias("_tokens"),
        draw.alias("_draw"),
        F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias(common.REST),
    )


def shares(sums: dict[str, float], target: dict[str, float] | None, power: float) -> dict[str, float]:
    """Target shares of the values that occur; values without a target share what the others leave in proportion to their tokens."""
    if target is None:
        raised = {k: v**power for k, v in sums.items()}
    else:
        given = {k: target[k] for k in sums if k in target}
        rest = {k: v for k, v in sums.items() if k not in target}
        left = max(0.0, 1.0 - sum(given.values())) if rest else 0.0
        total = sum(rest.values())
        raised = given | {k: left * v / total for k, v in rest.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()} if total else {k: 0.0 for k in raised}


def rake(cells: list[tuple[str, str, str, int]], targets: list[dict[str, float]], passes: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """A factor per (source, language, topic, tokens) cell. Where no exact fit exists (empty cells), the passes end without one."""
    tokens = np.array([c[3] for c in cells], float)
    factor = np.ones(len(cells))
    codes, wanted = [], []
    for d in range(3):
        values = sorted({c[d] for c in cells})
        at = {v: i for i, v in enumerate(values)}
        codes.append(np.array([at[c[d]] for c in cells], int))
        wanted.append(np.array([targets[d][v] for v in values]) * tokens.sum())
    for _ in range(passes):
        worst = 0.0
        for code, want in zip(codes, wanted):
            have = np.bincount(code, tokens * factor, len(want))
            scale = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            worst = max(worst, float(np.abs(scale - 1)[have > 0].max(initial=0)))
            factor *= scale[code]
        if worst < tolerance:
            break
    return factor


def shares_table(sums: DataFrame, target: dict[str, float] | None, power: float) -> DataFrame:
    """shares() as a table: (value, share) for sums of (value, n)."""
    if target is None:
        raised = sums.select("value", F.pow(F.col("n").cast("double"), F.lit(power)).alias("raised"))
    else:
        given = common.local_table(sums.sparkSession, [(k, float(v)) for k, v in target.items()], "value string, given double")
        joined = sums.join(given, "value", "left")
        known, rest = joined.agg(F.sum("given"), F.sum(F.when(F.col("given").isNull(), F.col("n")))).first()
        left = max(0.0, 1.0 - (known or 0.0)) if rest else 0.0
        raised = joined.select("value", F.coalesce("given", F.lit(left) * F.col("n") / F.lit(float(rest or 1))).alias("raised"))
    total = raised.agg(F.sum("raised")).first()[0] or 0.0
    return raised.select("value", (F.col("raised") / F.lit(total) if total else F.lit(0.0)).alias("share"))


def rake_table(cells: DataFrame, targets: list[dict[str, float] | DataFrame], passes: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """rake() for more cells than the driver should hold: (_source, _lang, _topic, n, factor), with the same steps and the same end.

    A cell's factor is the product of one scale a dimension: cells stay as they are, and a step writes the scales of
    one dimension anew (as logarithms: where no exact fit exists they grow without bound while their product doesn't).
    Targets are dicts or tables of (value, share).
    """
    spark = cells.sparkSession
    columns = [f"_{d}" for d in DIMENSIONS]
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    tables, paths = [], []

    def write(df: DataFrame) -> tuple[DataFrame, str]:
        # a written table: a checkpoint would hand on size estimates that square with every step
        path = common.scratch_path(spark, "rake")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def factored() -> DataFrame:
        out = cells
        for d, table in zip(columns, tables):
            out = out.join(table.select(d, f"log{d}"), d)
        return out.select(*columns, "n", F.exp(sum((F.col(f"log{d}") for d in columns[1:]), F.col(f"log{columns[0]}"))).alias("factor"))

    for d, target in zip(columns, targets):
        share = target if isinstance(target, DataFrame) else common.local_table(spark, [(k, float(v)) for k, v in target.items()], "value string, share double")
        share = share.select(F.col("value").alias(d), (F.col("share") * total).alias("want"), F.lit(0.0).alias(f"log{d}"), F.lit(0.0).alias("off"))
        table, path = write(share)
        tables.append(table)
        paths.append(path)
    for _ in range(passes):
        worst = 0.0
        for i, d in enumerate(columns):
            have = factored().groupBy(d).agg(F.sum(F.col("n") * F.col("factor")).alias("have"))
            scale = F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0)
            log = F.when(scale > 0, F.log(scale)).otherwise(F.lit(float("-inf")))
            off = F.when(F.col("have") > 0, F.abs(scale - 1)).otherwise(0.0)
            table, path = write(tables[i].join(have, d).select(d, "want", (F.col(f"log{d}") + log).alias(f"log{d}"), off.alias("off")))
            common.discard(spark, paths[i])
            tables[i], paths[i] = table, path
            worst = max(worst, table.agg(F.max("off")).first()[0] or 0.0)
        if worst < tolerance:
            break
    return factored()


def calibrated(cells: list[tuple[str, str, str, int]], factor: np.ndarray, share: float) -> np.ndarray:
    """Probabilities min(1, c * factor) with c such that the expected tokens are that share of all; cells at 1 pass what they lack on to the others."""
    tokens = np.array([c[3] for c in cells], float)
    want = share * tokens.sum()
    p = np.zeros(len(cells))
    free = factor > 0
    while free.any():
        left = want - tokens[(factor > 0) & ~free].sum()
        c = left / (tokens * factor)[free].sum()
        over = free & (c * factor >= 1)
        if not over.any():
            p[free] = np.maximum(c * factor[free], 0)
            break
        free &= ~over
        p[over] = 1.0
    return p


def calibrated_table(raked: DataFrame, share: float) -> DataFrame:
    """calibrated() as a table: raked with _probability. Cells at probability 1 are those with limit * factor >= 1; c only grows, so one number tells them."""
    factor = F.col("factor")
    want = share * (raked.agg(F.sum("n")).first()[0] or 0)
    limit = c = 0.0
    while True:
        full = factor * F.lit(limit) >= 1
        capped, free, most = raked.agg(F.sum(F.when(full, F.col("n"))), F.sum(F.when(~full, F.col("n") * factor)), F.max(F.when(~full, factor))).first()
        if not free:
            break
        c = (want - (capped or 0)) / free
        if c * most < 1:
            break
        limit = c
    return raked.withColumn("_probability", F.when(factor * F.lit(limit) >= 1, 1.0).otherwise(F.greatest(F.lit(0.0), factor * F.lit(c))))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = 0.5, topic: Column | None = None, seed: int = 17, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """doc_id, _source, _lang, _topic, _tokens, _weight, _probability, _kept, and all columns of docs as one struct (common.REST), for every row of docs (doc_id, text, lang, source, …).

    Sums are over all documents. Rows that repeat an id and text are kept or dropped together; a null id is a value
    like any other, and a null text an empty one, of one token. An empty table gives no rows. Columns of docs may
    have any name and type. No text is shuffled: documents meet the cells' weights by a broadcast join while there
    are at most driver_cells cells, by a shuffle join beyond, with the same weights and probabilities.
    """
    spark = docs.sparkSession
    table = with_cells(docs, topic, seed)
    cells = table.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("n"))
    head = cells.limit(driver_cells + 1).collect()
    small = len(head) <= driver_cells
    if small:
        rows = sorted((r[0], r[1], r[2], r[3]) for r in head)
        sums = [{} for _ in DIMENSIONS]
        for r in rows:
            for d in range(3):
                sums[d][r[d]] = sums[d].get(r[d], 0) + r[3]
    else:
        cells = common.stored(cells, "cells")
        sums = [cells.groupBy(F.col(f"_{d}").alias("value")).agg(F.sum("n").alias("n")) for d in DIMENSIONS]
    wanted = [(shares if small else shares_table)(s, (targets or {}).get(d), POWERS[d]) for d, s in zip(DIMENSIONS, sums)]
    if small:
        factor = rake(rows, wanted)
        p = calibrated(rows, factor, share)
        weights = F.broadcast(common.local_table(spark, [(*r[:3], float(f), float(q)) for r, f, q in zip(rows, factor, p)], "_source string, _lang string, _topic string, _weight double, _probability double"))
    else:
        raked = common.stored(rake_table(cells, wanted), "raked")
        weights = calibrated_table(raked, share).select("_source", "_lang", "_topic", F.col("factor").alias("_weight"), "_probability")
    return table.join(weights, ["_source", "_lang", "_topic"], "left").withColumn("_kept", F.coalesce(F.col("_draw") < F.col("_probability"), F.lit(False))).drop("_draw")


def sample(docs: DataFrame, share: float = 0.5, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The documents that mix keeps, columns as in docs."""
    return mix(docs, targets, share).filter("_kept").select(f"{common.REST}.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Each document's cell, tokens, raked weight, probability and draw."""
    docs = common.load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", *(F.col(f"_{c}").alias(c) for c in (*DIMENSIONS, "tokens", "weight", "probability", "kept")))
