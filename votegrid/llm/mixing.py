"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic).  Raking scales the cells of one
source, language or topic after another until all three marginals meet their
targets; then again with no cell above 1, which gives the probabilities with which
documents are drawn.  Built-in functions only.  The driver rakes the sums of up to
``CELLS`` cells; more stay a table, which is raked by aggregates and joins to the
same result, so that every category has its own weight however many there are.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votegrid.llm.common import keyed, unused
from votegrid.storage import Scratch, within

AXES = ("source", "lang", "topic")
#: Cells whose sums the driver rakes by itself.
CELLS = 100_000
#: Targets are shares of tokens to this power: 1 keeps the mix, 0 evens it out.
TEMPER = 0.8
#: Share of the tokens to draw.
DRAW = 0.9
#: Raking ends when no marginal is off by more than the tolerance; on the driver and
#: as a table after so many sweeps, which is logged.
SWEEPS, TABLE_SWEEPS, TOLERANCE = 1_000, 60, 1e-6
#: What :func:`mix` adds to the documents.
RESULTS = ("vg_source", "vg_lang", "vg_topic", "vg_tokens", "vg_weight", "vg_p", "vg_selected")
_log = logging.getLogger(__name__)


def n_tokens(text: Column) -> Column:
    """Words of the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """Where the corpus has no topics: a coarse kind of text by length and digits."""
    digits = F.coalesce(F.regexp_count(text, F.lit("[0-9]+")), F.lit(0))
    return (
        F.when(digits * 50 > tokens, "figures").when(tokens < 100, "notes").when(tokens < 1000, "articles").otherwise("books")
    )


def feasible(wanted: np.ndarray, own: np.ndarray, amount: float) -> np.ndarray:
    """Tokens per category, ``amount`` in all, in the proportions ``wanted``; where
    a category has fewer, all that it has, and the others keep their proportions."""
    full = np.zeros(len(own), bool)
    while True:
        open_share = wanted[~full].sum()
        rest = max(0.0, amount - own[full].sum())
        got = np.where(full, own, wanted * (rest / open_share if open_share else 0.0))
        more = ~full & (got > own)
        if not more.any():
            return got
        full |= more


def _unsettled(off: float) -> None:
    if off >= TOLERANCE:
        _log.warning("raking ended with a marginal off its target by the share %.3g", off)


def rake(codes: list[np.ndarray], tokens: np.ndarray, goals: list[np.ndarray], start: np.ndarray, bound: bool) -> np.ndarray:
    """A factor per cell, scaled from ``start`` by category only, with which the tokens
    of each category of each axis come to its goal; with ``bound`` factors above 1
    count as 1."""
    factor, off = start.astype(float), 0.0
    for _ in range(SWEEPS):
        off = 0.0
        for code, goal in zip(codes, goals, strict=True):
            found = np.bincount(code, tokens * (np.minimum(factor, 1.0) if bound else factor), len(goal))
            step = np.divide(goal, found, out=np.ones_like(found), where=found > 0)
            off = max(off, float(np.abs(step - 1).max(initial=0.0)))
            factor = np.clip(factor * step[code], 0.0, 1e200)
        if off < TOLERANCE:
            break
    _unsettled(off)
    return factor


def _short(axis: str, rows: list[tuple[str, float, float]]) -> None:
    """Logs targets beyond what their categories have: name, share wanted, share there is."""
    if rows:
        _log.warning("targets of %s not feasible at this draw: %s", axis, ", ".join(f"{k} {w:.4f} (at most {o:.4f})" for k, w, o in rows[:20]))


def _on_driver(cells: DataFrame, targets: dict[str, dict[str, float]], temper: float, draw: float) -> DataFrame:
    """``source, lang, topic, weight, p`` of at most ``CELLS`` cells."""
    rows = cells.collect()
    tokens = np.array([r.tokens for r in rows], float)
    codes, wanted, names = [], [], []
    for a in AXES:
        found = {k: i for i, k in enumerate(sorted({r[a] for r in rows}))}
        code = np.array([found[r[a]] for r in rows], np.int64)
        own = np.bincount(code, tokens, len(found))
        share = np.array([targets[a].get(k, 0.0) for k in found]) if targets.get(a) else own**temper * (own > 0)
        codes.append(code)
        names.append(list(found))
        wanted.append(share / (share.sum() or 1.0))
    alive = (tokens > 0) & np.all([w[c] > 0 for w, c in zip(wanted, codes, strict=True)], axis=0)
    weight, chance = np.zeros(len(rows)), np.zeros(len(rows))
    if alive.any():
        held, codes = tokens[alive], [c[alive] for c in codes]
        weight[alive] = rake(codes, held, wanted, np.ones(len(held)), False)
        amount, goals = min(draw * tokens.sum(), held.sum()), []
        for a, name, code, share in zip(AXES, names, codes, wanted, strict=True):
            own = np.bincount(code, held, len(share))
            goals.append(feasible(share, own, amount))
            _short(a, [(k, w, o / amount) for k, w, o in zip(name, share, own, strict=True) if w * amount > o * (1 + 1e-9)])
        chance[alive] = np.minimum(1.0, rake(codes, held, goals, weight[alive] * amount, True))
    out = [(*[r[a] for a in AXES], float(w), float(p)) for r, w, p in zip(rows, weight, chance, strict=True)]
    return cells.sparkSession.createDataFrame(out, "source string, lang string, topic string, weight double, p double")


def _raked(cells: DataFrame, goals: dict[str, DataFrame], bound: bool, scratch: Scratch, name: str) -> DataFrame:
    """:func:`rake` of a staged table with ``factor``, a job for each sweep; goals are
    staged tables ``k, goal``."""
    now, off = cells, 0.0
    for turn in range(TABLE_SWEEPS):
        table, steps = now, []
        for n, a in enumerate(AXES):
            counted = F.least("factor", F.lit(1.0)) if bound else F.col("factor")
            found = table.groupBy(F.col(a).alias("f")).agg(F.sum(F.col("tokens") * counted).alias("found"))
            step = found.join(goals[a], F.col("f") == F.col("k")).select("f", F.when(F.col("found") > 0, F.col("goal") / F.col("found")).otherwise(1.0).alias("step"))
            table = table.join(step, F.col(a) == F.col("f")).withColumn("factor", F.least(F.col("factor") * F.col("step"), F.lit(1e200)))
            table = table.withColumn(f"off{n}", F.abs(F.col("step") - 1)).drop("f", "step")
            steps.append(f"off{n}")
        table = scratch.stage(table, f"{name}{turn}")
        off = table.agg(F.max(F.greatest(*steps))).first()[0] or 0.0
        now = table.drop(*steps)
        if turn:
            scratch.drop(f"{name}{turn - 1}")
        if off < TOLERANCE:
            break
    _unsettled(off)
    return now


def _as_tables(cells: DataFrame, targets: dict[str, dict[str, float]], temper: float, draw: float, scratch: Scratch) -> DataFrame:
    """The same for any number of cells; nothing is gathered."""
    spark = cells.sparkSession
    wanted = {}
    for a in AXES:
        own = cells.groupBy(F.col(a).alias("k")).agg(F.sum("tokens").cast("double").alias("own")).where("own > 0")
        if targets.get(a):
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[a].items() if v > 0], "g string, share double")
            own = own.join(given, F.col("k") == F.col("g")).select("k", "share")
        else:
            own = own.select("k", F.pow("own", F.lit(temper)).alias("share"))
        own = scratch.stage(own, f"own_{a}")
        whole = own.agg(F.sum("share")).first()[0] or 1.0
        wanted[a] = scratch.stage(own.select("k", (F.col("share") / whole).alias("goal")), f"wanted_{a}")
    alive = cells.where("tokens > 0")
    for a in AXES:
        alive = alive.join(wanted[a].select("k"), F.col(a) == F.col("k"), "left_semi")
    alive = scratch.stage(alive.withColumn("factor", F.lit(1.0)), "alive")
    total, held = cells.agg(F.sum("tokens")).first()[0] or 0, alive.agg(F.sum("tokens")).first()[0] or 0
    amount = min(draw * total, float(held))
    weights = _raked(alive, wanted, False, scratch, "raked").withColumnRenamed("factor", "weight")
    goals = {}
    for a in AXES:
        own = alive.groupBy(F.col(a).alias("o")).agg(F.sum("tokens").cast("double").alias("own"))
        both = scratch.stage(wanted[a].join(own, F.col("k") == F.col("o")).select("k", "own", F.col("goal").alias("share")), f"both_{a}")
        scale, before = amount, None
        while scale != before:  # a category beyond its own tokens is taken whole, the others share the rest
            full = F.col("own") < F.col("share") * scale
            sums = both.agg(F.sum(F.when(full, F.col("own")).otherwise(0.0)).alias("own"), F.sum(F.when(full, 0.0).otherwise(F.col("share"))).alias("open")).first()
            before, scale = scale, max(0.0, amount - (sums.own or 0.0)) / sums.open if sums.open else scale
        _short(a, [(r.k, r.share, r.own / amount) for r in both.where(F.col("share") * amount > F.col("own") * (1 + 1e-9)).limit(20).collect()])
        goals[a] = scratch.stage(both.select("k", F.least(F.col("own"), F.col("share") * scale).alias("goal")), f"goal_{a}")
    drawn = _raked(weights.withColumn("factor", F.col("weight") * amount), goals, True, scratch, "drawn")
    drawn = drawn.select(*[F.col(a).alias(f"d_{a}") for a in AXES], "weight", F.least("factor", F.lit(1.0)).alias("p"))
    at = reduce(lambda x, y: x & y, [F.col(a) == F.col(f"d_{a}") for a in AXES])
    return cells.join(drawn, at, "left").select(*AXES, F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("p", F.lit(0.0)).alias("p"))


def marginals(mixed: DataFrame) -> DataFrame:
    """``axis, category, own, drawn``: shares of all tokens, and of those that the
    probabilities of :func:`mix` draw on average."""
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"vg_{a}").alias("category")) for a in AXES])).alias("at")
    sums = mixed.select(axes, F.col("vg_tokens").alias("n"), (F.col("vg_tokens") * F.col("vg_p")).alias("x")).groupBy("at").agg(
        F.sum("n").alias("n"), F.sum("x").alias("x")
    )
    whole = sums.groupBy(F.col("at.axis").alias("of")).agg(F.sum("n").alias("all_n"), F.sum("x").alias("all_x"))
    return sums.join(whole, F.col("at.axis") == F.col("of")).select(
        "at.axis", "at.category", (F.col("n") / F.col("all_n")).alias("own"), (F.col("x") / F.col("all_x")).alias("drawn")
    )


def mix(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    topic: Column | None = None,
    temper: float = TEMPER,
    draw: float = DRAW,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    driver_cells: int = CELLS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``docs`` with ``vg_source, vg_lang, vg_topic, vg_tokens,
    vg_weight, vg_p, vg_selected`` added; no row is dropped here.

    ``targets`` gives shares per axis (``source``, ``lang``, ``topic``); an axis
    left out gets its own shares of tokens to the power ``temper``.  ``draw`` of
    the tokens are drawn, with these shares where a category has enough tokens
    (:func:`feasible`); a category that has fewer is drawn whole and logged, and
    :func:`marginals` gives the shares that were reached.

    * Null source or language is the category ''; a null text has no tokens.
    * Cells without tokens, and categories without a target, have probability 0,
      except that documents without tokens cost nothing and are always taken.
    * Drawing depends on the id alone: repeated rows share their fate; a null id
      counts as ''.  Empty table: empty result.
    * A column added here whose name the documents have already gets underscores
      before its name.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    names = dict(zip(RESULTS, unused(docs, *RESULTS), strict=True))
    tokens = n_tokens(F.col(text_col))
    topic = form_topic(F.col(text_col), tokens) if topic is None else topic
    named = docs.withColumns({
        names["vg_source"]: F.coalesce(F.col("source").cast("string"), F.lit("")),
        names["vg_lang"]: F.coalesce(F.col("lang").cast("string"), F.lit("")),
        names["vg_topic"]: F.coalesce(topic.cast("string"), F.lit("")),
        names["vg_tokens"]: tokens,
    })
    cells = scratch.stage(
        named.groupBy(*[F.col(names[f"vg_{a}"]).alias(a) for a in AXES]).agg(F.sum(names["vg_tokens"]).alias("tokens")), "cells"
    )
    if within(cells, driver_cells):
        table = _on_driver(cells, targets or {}, temper, draw)
    else:
        table = _as_tables(cells, targets or {}, temper, draw, scratch)
    keys = unused(named, *[f"cell_{a}" for a in (*AXES, "weight", "p")])
    table = scratch.stage(table.toDF(*keys), "table")
    scratch.keep("table")
    at = reduce(lambda x, y: x & y, [F.col(names[f"vg_{a}"]) == F.col(k) for a, k in zip(AXES, keys, strict=False)])
    spot = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10)
    out = named.join(keyed(table), at, "left").withColumns({
        names["vg_weight"]: F.coalesce(keys[-2], F.lit(0.0)),
        names["vg_p"]: F.when(F.col(names["vg_tokens"]) == 0, 1.0).otherwise(F.coalesce(keys[-1], F.lit(0.0))),
    })
    return out.withColumn(names["vg_selected"], spot.cast("double") / float(1 << 48) < F.col(names["vg_p"])).drop(*keys)


def drawn(docs: DataFrame, **how) -> DataFrame:
    """The documents that :func:`mix` selects, with their own columns."""
    selected = unused(docs, "vg_selected")[0]
    return mix(docs, **how).where(F.col(selected)).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its cell, probability and whether it is drawn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    mixed = mix(docs)
    return mixed.select(
        "doc_id", *[F.col(f"vg_{a}").alias(a) for a in AXES], F.col("vg_tokens").alias("n_tokens"),
        F.col("vg_weight").alias("weight"), F.col("vg_p").alias("probability"), F.col("vg_selected").alias("selected"),
    )
