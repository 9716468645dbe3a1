"""Lattice of panel subsets: one node per subset, rows routed by what they have.

A node is a bitmask over panels. Parents and ancestors are made by bit
arithmetic on the mask, so no pair of nodes is ever compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.functions.scalar import c, observed_mask
from gapweave.operators import gaptrees, patterns
from gapweave.operators.hotjoin import lookup
from gapweave.session import cut
from gapweave.operators.clean import Panel

MAX_PANELS = 20


def lattice_build(spark: SparkSession, panels: list[Panel], base: list[str], patterns: DataFrame | None = None) -> DataFrame:
    """(node_mask, level, panels, features): the power set of the panels, or the closed nodes of ``patterns`` (mask).

    More than ``MAX_PANELS`` panels need patterns: the power set would not be of use.
    """
    if patterns is not None:
        nodes = closed_patterns(patterns)
    elif len(panels) > MAX_PANELS:
        raise ValueError(f"more than {MAX_PANELS} panels need the patterns that occur")
    else:
        nodes = spark.range(1 << len(panels)).withColumnRenamed("id", "node_mask")
    inside = [F.col("node_mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(panels))]
    names = F.array_compact(F.array(*[F.when(h, F.lit(p.name)) for h, p in zip(inside, panels)])) if panels else F.array()
    feats = F.array(*[F.lit(b) for b in base]).cast("array<string>")
    for h, p in zip(inside, panels):
        own = F.array(*[F.lit(f) for f in p.features])
        feats = F.concat(feats, F.when(h, own).otherwise(F.array().cast("array<string>")))
    return nodes.select("node_mask", F.bit_count("node_mask").alias("level"), names.alias("panels"), feats.alias("features"))


def _bits(masks: DataFrame, mask: str, out: str) -> DataFrame:
    """(out, bit): one row for each panel of a mask; 62 panels at most."""
    bits = F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(62)]), lambda b: F.col(mask).bitwiseAND(b) != 0)
    return masks.select(mask).withColumn("bit", F.explode(bits)).withColumnRenamed(mask, out)


def closed_patterns(patterns: DataFrame, mask: str = "mask") -> DataFrame:
    """(node_mask): the occurring patterns and all their intersections, the empty one included.

    Any subset of panels has the same rows as the smallest of these that contains it, so no other node can differ from
    all of them. Built by a fixpoint: what was new is intersected with the patterns, which meet it by a join on
    a shared panel; without a shared panel the intersection is empty. Their number follows the patterns, not 2 to the
    power of the panels.
    """
    spark = patterns.sparkSession
    given = cut(patterns.select(F.col(mask).cast("long").alias("p")).distinct())
    sides = cut(_bits(given, "p", "p"))
    every = cut(given.select(F.col("p").alias("node_mask")).union(spark.range(1).select(F.lit(0).cast("long"))).distinct())
    new = every
    while not new.isEmpty():
        met = _bits(new, "node_mask", "n").join(sides, "bit").select(F.col("n").bitwiseAND(F.col("p")).alias("node_mask")).distinct()
        new = cut(met.join(every, "node_mask", "left_anti"))
        every = cut(every.union(new))
    return every


def closed_counts(nodes: DataFrame, counts: DataFrame, value: str = "n_samples", mask: str = "mask") -> DataFrame:
    """(node_mask, level, value): sums of ``value`` over the masks that contain a node, met by a join on shared panels."""
    shared = _bits(nodes, "node_mask", "node_mask").join(_bits(counts, mask, "_m"), "bit").groupBy("node_mask", "_m").agg(F.count(F.lit(1)).alias("_n"))
    inside = shared.filter(F.col("_n") == F.bit_count("node_mask")).join(counts.select(F.col(mask).alias("_m"), value), "_m")
    total = counts.agg(F.sum(value)).first()[0] or 0
    sums = inside.groupBy("node_mask").agg(F.sum(value).alias(value))
    found = nodes.join(sums, "node_mask", "left")
    return found.select("node_mask", F.bit_count("node_mask").alias("level"), F.when(F.col("node_mask") == 0, F.lit(total)).otherwise(F.coalesce(value, F.lit(0))).alias(value))


def lattice_edges(nodes: DataFrame, n_panels: int) -> DataFrame:
    """(parent, child): the parent lacks exactly one panel of the child."""
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(n_panels)])
    own = F.filter(bits, lambda b: F.col("node_mask").bitwiseAND(b) != 0)
    lower = nodes.select("node_mask", F.explode(own).alias("b"))
    return lower.select((F.col("node_mask") - F.col("b")).alias("parent"), F.col("node_mask").alias("child"))


def ancestors(patterns: DataFrame, n_panels: int, mask: str = "node_mask", proper: bool = False) -> DataFrame:
    """(mask, ancestor): every subset of each distinct mask, built bit by bit."""
    subsets: Column = F.array(F.lit(0).cast("long"))
    for i in range(n_panels):
        b = F.lit(1 << i).cast("long")
        subsets = _grow(subsets, F.col(mask), b)
    out = patterns.select(mask).distinct().select(mask, F.explode(subsets).alias("ancestor"))
    return out.filter(F.col("ancestor") != F.col(mask)) if proper else out


def _grow(subsets: Column, mask: Column, b: Column) -> Column:
    return F.flatten(
        F.transform(subsets, lambda m: F.when(mask.bitwiseAND(b) != 0, F.array(m, m + b)).otherwise(F.array(m)))
    )


def panel_mask(panels: list[Panel]) -> Column:
    """Bitmask of panels whose features are all present in the row."""
    out = F.lit(0).cast("long")
    for i, p in enumerate(panels):
        whole = F.lit(True)
        for f in p.features:
            whole = whole & F.col(f).isNotNull()
        out = out + F.when(whole, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return out


def panels_missing(feature_to_panel: dict[str, str]) -> Column:
    """Number of distinct panels among a row's null features."""
    names = F.array(*[F.when(F.col(f).isNull(), F.lit(p)) for f, p in feature_to_panel.items()])
    return F.size(F.array_distinct(F.array_compact(names)))


def row_pattern(features: list[str]) -> Column:
    return observed_mask(features)


def row_level(feature_to_panel: dict[str, str], n_panels: int) -> Column:
    return F.lit(n_panels) - panels_missing(feature_to_panel)


def route(rows: DataFrame, nodes: DataFrame, n_panels: int, mask: str = "mask") -> DataFrame:
    """Own node of each row; a pattern without a node goes to its largest subset node.

    Only distinct patterns are matched with nodes; rows then look their pattern up, frequent ones without a shuffle.
    """
    known = nodes.select(F.col("node_mask").alias("ancestor"))
    best = (
        ancestors(rows, n_panels, mask)
        .join(known, "ancestor")
        .groupBy(mask)
        .agg(F.max(F.struct(F.bit_count("ancestor").alias("n"), F.col("ancestor").alias("node"))).alias("b"))
        .select(mask, F.col("b.node").alias("node_mask"))
    )
    return lookup(rows, best, mask, mask)


def lattice_average(rows: DataFrame, node_preds: DataFrame, row: str = "row_id", mask: str = "mask") -> DataFrame:
    """Mean of the predictions of a row's own node and all its ancestors.

    ``node_preds``: row, node_mask, p. A node is an ancestor iff it has no
    panel that the row lacks.
    """
    usable = node_preds.join(rows.select(row, mask), row).filter(
        F.col("node_mask").bitwiseAND(F.col(mask)) == F.col("node_mask")
    )
    return usable.groupBy(row).agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n_nodes"))


def lattice_average_wide(masks: dict[int, str], mask: str | Column) -> Column:
    """The same as an expression when each node's prediction is a column of the row: no shuffle."""
    total, n = F.lit(0.0), F.lit(0)
    for node, name in masks.items():
        on = c(mask).bitwiseAND(F.lit(node)) == F.lit(node)
        total = total + F.when(on, F.col(name)).otherwise(0.0)
        n = n + F.when(on, 1).otherwise(0)
    return total / n


def lattice_route_only(rows: DataFrame, node_preds: DataFrame, row: str = "row_id", mask: str = "mask") -> DataFrame:
    own = rows.select(row, F.col(mask).alias("node_mask"))
    return node_preds.join(own, [row, "node_mask"]).select(row, "node_mask", "p")


def superset_sums(counts: DataFrame, n_panels: int, values: list[str], mask: str = "mask") -> DataFrame:
    """(node_mask, *values): for every subset of an occurring mask, the sums over all masks that contain it.

    One step per panel: what holds the panel also counts for the same mask without it. Each step is a partial
    aggregate over masks, never over rows.
    """
    now = counts.groupBy(F.col(mask).alias("node_mask")).agg(*[F.sum(v).alias(v) for v in values])
    for i in range(n_panels):
        without = F.col("node_mask").bitwiseAND(F.lit(~(1 << i)))
        both = F.when(without != F.col("node_mask"), F.array("node_mask", without)).otherwise(F.array("node_mask"))
        now = now.select(F.explode(both).alias("node_mask"), *values).groupBy("node_mask").agg(*[F.sum(v).alias(v) for v in values])
    return now


def node_sums(df: DataFrame, features: list[str], centres: dict[str, float], nodes: dict[int, list[str]]) -> dict[int, np.ndarray]:
    """Sums of products of (1, a node's features, the last of ``features``) over the rows that have them all.

    Patterns are added up in Spark; one matrix per node comes back. Nodes without a row are left out.
    """
    d = len(features)
    place = {n: [0, *(features.index(x) + 1 for x in f), d] for n, f in nodes.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            part = patterns.unpack(batch, d)
            for node, at in place.items():
                has = ~part.gaps[:, [k - 1 for k in at[1:]]].any(axis=1)
                if has.any():
                    gram = part.first[has].sum(axis=0)[np.ix_(at, at)]
                    total[node] = total[node] + gram if node in total else gram
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([g.ravel() for g in total.values()], pa.list_(pa.float64()))], ["node", "gram"])

    found = patterns.sums_by_pattern(df, features, centres).mapInArrow(add, "node long, gram array<double>")
    cells = found.select("node", F.posexplode("gram").alias("i", "v")).groupBy("node", "i").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in cells.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("g")).collect():  # one matrix per node
        size = len(place[r["node"]])
        out[r["node"]] = np.array([x["v"] for x in r["g"]]).reshape(size, size)
    return out


@dataclass
class Lattice:
    """Node models fitted by a driver loop over bounded nodes."""

    panels: list[Panel]
    base: list[str]
    target: str
    id_col: str = "row_id"
    models: dict[int, object] = field(default_factory=dict)
    counts: dict[int, int] = field(default_factory=dict)
    thresholds: dict[int, float] = field(default_factory=dict)
    nodes: list[int] = field(default_factory=list)
    masked: gaptrees.GapTrees | None = None
    linear: dict[int, tuple[dict[str, float], float]] = field(default_factory=dict)

    def features(self, node: int) -> list[str]:
        out = list(self.base)
        for i, p in enumerate(self.panels):
            if node >> i & 1:
                out += p.features
        return out

    def nodes_seen(self, df: DataFrame) -> list[int]:
        """Patterns that occur, with all their subsets."""
        seen = [r["m"] for r in df.select(panel_mask(self.panels).alias("m")).distinct().collect()]
        out: set[int] = set()
        for m in seen:
            sub = m
            while True:
                out.add(sub)
                if sub == 0:
                    break
                sub = (sub - 1) & m
        return sorted(out)

    def fit(self, df: DataFrame, make, nodes: list[int] | None = None, weight_min: int = 1) -> Lattice:
        """One model per node on the rows complete for it; no features means a constant 0.5."""
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import VectorAssembler

        for node in nodes if nodes is not None else self.nodes_seen(df):
            feats = self.features(node)
            rows = df.na.drop("any", subset=feats) if feats else df
            self.counts[node] = rows.count()
            if not feats or self.counts[node] < weight_min:
                self.models[node] = None
                continue
            est = make()
            est.setFeaturesCol("_vec").setLabelCol(self.target)
            stages = [VectorAssembler(inputCols=feats, outputCol="_vec"), est]
            self.models[node] = Pipeline(stages=stages).fit(rows.select(self.target, *feats))
        return self

    def fit_masked(self, df: DataFrame, settings: gaptrees.Settings | None = None) -> Lattice:
        """One sequence of trees per node, each on all rows: what is not of the node is a gap to it.

        All nodes grow together (:mod:`gapweave.operators.gaptrees`), so the rows are not read once per node.
        """
        self.nodes = self.nodes_seen(df)
        every = list(dict.fromkeys([*self.base, *(f for p in self.panels for f in p.features)]))
        self.masked = gaptrees.fit(df, every, self.target, [self.features(n) for n in self.nodes], settings)
        self.counts = {n: self.masked.rows for n in self.nodes}
        return self

    def fit_linear(self, df: DataFrame, strength: float = 1.0) -> Lattice:
        """A ridge regression of the target per node, on the rows complete for it; no features means a constant 0.5.

        The rows are read once: sums of products are added up by pattern of gaps, and a node's sums are those of all
        patterns that have its features. Predictions are clipped to 0..1 and are expressions, so that one scan
        without a shuffle gives those of all nodes.
        """
        every = list(dict.fromkeys([*self.base, *(f for p in self.panels for f in p.features)]))
        self.nodes = self.nodes_seen(df)
        known_rows = df.filter(F.col(self.target).isNotNull())
        row = known_rows.agg(*[F.avg(patterns.known(x)).alias(x) for x in [*every, self.target]]).first()
        centres = {x: row[x] or 0.0 for x in [*every, self.target]}
        sums = node_sums(known_rows, [*every, self.target], centres, {n: self.features(n) for n in self.nodes})
        self.counts, self.linear = {n: 0 for n in self.nodes}, {}
        for node in self.nodes:
            feats = self.features(node)
            self.linear[node] = ({}, 0.5) if not feats else ({}, centres[self.target])
            if node in sums:
                gram = sums[node]
                n, d = gram[0, 0], len(feats)
                self.counts[node] = int(n)
                if feats:
                    mean = gram[0, 1:] / n
                    about = gram[1:, 1:] - n * np.outer(mean, mean)
                    w = np.linalg.solve(about[:d, :d] + strength * np.eye(d), about[:d, d])
                    centre = np.array([centres[x] for x in feats])
                    intercept = centres[self.target] + mean[d] - w @ (centre + mean[:d])
                    self.linear[node] = (dict(zip(feats, w.tolist(), strict=True)), float(intercept))
        return self

    def _each(self, df: DataFrame) -> DataFrame:
        """Rows with their mask and an array of (node_mask, p): own node and ancestors, by masked trees or ridge."""
        mask = panel_mask(self.panels).alias("mask")
        if self.masked:
            p = self.masked.predict()
            each = F.arrays_zip(F.array(*[F.lit(n).cast("long") for n in self.nodes]).alias("node_mask"), p.alias("p"))
            rows = df.select(self.id_col, mask, each.alias("each"))
            return rows.withColumn("each", F.filter("each", lambda x: x["node_mask"].bitwiseAND(F.col("mask")) == x["node_mask"]))
        made = []
        for node, (weights, intercept) in self.linear.items():
            whole, p = F.lit(True), F.lit(intercept)
            for x in self.features(node):
                whole, p = whole & F.col(x).isNotNull(), p + F.col(x) * F.lit(weights.get(x, 0.0))
            p = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)), 9)  # cut-offs must not depend on the order of sums
            made.append(F.when(whole, F.struct(F.lit(node).cast("long").alias("node_mask"), p.alias("p"))))
        return df.select(self.id_col, mask, F.filter(F.array(*made), lambda x: x.isNotNull()).alias("each"))

    def predict_nodes(self, df: DataFrame) -> DataFrame:
        """(id, node_mask, p): every fitted node on the rows complete for it; masked nodes on rows that have their panels."""
        from functools import reduce

        from pyspark.ml.functions import vector_to_array

        if self.masked or self.linear:
            return self._each(df).select(self.id_col, F.inline("each"))
        parts = []
        for node, model in self.models.items():
            feats = self.features(node)
            rows = df.na.drop("any", subset=feats) if feats else df
            if model is None:
                p = rows.select(self.id_col, F.lit(0.5).alias("p"))
            else:
                scored = model.transform(rows.select(self.id_col, *feats))
                value = (
                    vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
                )
                p = scored.select(self.id_col, value.alias("p"))
            parts.append(p.withColumn("node_mask", F.lit(node).cast("long")))
        return reduce(DataFrame.unionByName, parts)

    def average(self, df: DataFrame) -> DataFrame:
        """(id, p, n_nodes): mean over own node and ancestors."""
        if self.masked or self.linear:  # within the row: no shuffle
            total = F.aggregate("each", F.lit(0.0), lambda t, x: t + x["p"])
            n = F.size("each").cast("long")
            return self._each(df).filter(F.size("each") > 0).select(self.id_col, (total / n).alias("p"), n.alias("n_nodes"))
        rows = df.select(self.id_col, panel_mask(self.panels).alias("mask"))
        return lattice_average(rows, self.predict_nodes(df), self.id_col)

    def average_imputed(self, df: DataFrame, imputer) -> DataFrame:
        """Gaps filled first, so that every row takes the full node."""
        return self.average(imputer.transform(df))

    def route_only(self, df: DataFrame) -> DataFrame:
        """(id, node_mask, p): own node; where that was not fitted, masked trees and ridge take the largest one within it."""
        if self.masked or self.linear:
            own = F.array_max(F.transform("each", lambda x: F.struct(F.bit_count(x["node_mask"]).alias("n"), x["node_mask"].alias("node_mask"), x["p"].alias("p"))))
            return self._each(df).filter(F.size("each") > 0).select(self.id_col, own["node_mask"].alias("node_mask"), own["p"].alias("p"))
        rows = df.select(self.id_col, panel_mask(self.panels).alias("mask"))
        return lattice_route_only(rows, self.predict_nodes(df), self.id_col)

    def fit_thresholds(self, val: DataFrame, step: float = 1.0) -> DataFrame:
        """(node_mask, threshold) tuned on validation rows."""
        from gapweave.operators.threshold import best_threshold, threshold_sweep

        preds = self.predict_nodes(val).join(val.select(self.id_col, F.col(self.target).alias("y")), self.id_col)
        best = best_threshold(threshold_sweep(preds, ["node_mask"], step=step), ["node_mask"], step)
        self.thresholds = {r["node_mask"]: r["threshold"] for r in best.collect()}
        return best

    def stack(self, train: DataFrame, test: DataFrame, make_meta) -> DataFrame:
        """Meta model per node over the outputs of the node and its ancestors."""
        from functools import reduce

        from pyspark.ml import Pipeline
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        def wide(df: DataFrame) -> DataFrame:
            names = known
            p = self.predict_nodes(df).groupBy(self.id_col).pivot("node_mask", names).agg(F.first("p"))
            return p.select(self.id_col, *[F.col(str(n)).alias(f"p_{n}") for n in names])

        known = self.nodes or sorted(self.models)
        both = wide(train).join(train.select(self.id_col, self.target), self.id_col)
        goal = wide(test).join(test.select(self.id_col, panel_mask(self.panels).alias("mask")), self.id_col)
        parts = []
        for node in known:
            inputs = [f"p_{a}" for a in known if a & node == a]
            meta = make_meta()
            meta.setFeaturesCol("_vec").setLabelCol(self.target)
            stages = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="_vec"), meta])
            model = stages.fit(both.na.drop("any", subset=inputs).select(self.target, *inputs))
            scored = model.transform(goal.filter(F.col("mask") == node).select(self.id_col, *inputs))
            value = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
            parts.append(scored.select(self.id_col, F.lit(node).cast("long").alias("node_mask"), value.alias("p")))
        return reduce(DataFrame.unionByName, parts)

    def node_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (n, bin(n).count("1"), [p.name for i, p in enumerate(self.panels) if n >> i & 1], self.features(n),
             self.thresholds.get(n), self.counts.get(n))
            for n in self.nodes or sorted(self.models)
        ]
        schema = "node_mask long, level int, panels array<string>, features array<string>, threshold double, n_samples long"
        return spark.createDataFrame(rows, schema)
