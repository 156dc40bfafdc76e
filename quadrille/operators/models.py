"""Arithmetic models, look-ups and corpus samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Heads, width, feed-forward width, layers and key-value heads of dense models by billions of parameters (fixed values).
DENSE = {13: (40, 5120, 13824, 40, 40), 70: (64, 8192, 28672, 80, 8), 172: (96, 12288, 38464, 96, 16)}
VOCABULARY, EXPERTS = 99487, 8
#: Shape of the mixture-of-experts model (fixed values).
MIXTURE = {"vocabulary": 128000, "width": 7168, "heads": 128, "head": 64, "query": 1536, "latent": 512, "layers": 61, "sparse": 58, "experts": 256, "active": 8, "shared": 1, "expert_width": 2048, "prediction": 11.5e9}


def mse_gradient(rows: DataFrame, w: float) -> DataFrame:
    """One row: mean squared error of w x against y, and its derivative by w."""
    r = F.lit(w) * F.col("x") - F.col("y")
    return rows.agg(F.avg(r * r).alias("loss"), F.avg(2 * r * F.col("x")).alias("dw"))


def bandwidth(trips: DataFrame) -> DataFrame:
    """(size, worst, mean, best): MB/s there and back of (size, pair, seconds), by pair and then over pairs."""
    rate = 2 * F.col("size") / F.col("seconds") / 1e6
    by_pair = trips.groupBy("size", "pair").agg(F.min(rate).alias("lo"), F.avg(rate).alias("mid"), F.max(rate).alias("hi"))
    return by_pair.groupBy("size").agg(F.avg("lo").alias("worst"), F.avg("mid").alias("mean"), F.avg("hi").alias("best"))


def named(spark, values: dict[str, Column], key: str, value: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias(key), v.cast("double").alias(value)) for k, v in values.items()])).alias("r")).select("r.*")


def dense_parameters(heads: int, width: int, inner: int, layers: int, kv_heads: int) -> Column:
    h = F.lit(float(width))
    return h * VOCABULARY + 2 * F.lit(float(layers)) * h * h * (1 + F.lit(kv_heads / heads) + EXPERTS * 1.5 * inner / h + 1 / h)


def mixture_parameters() -> dict[str, Column]:
    c = {k: F.lit(float(v)) for k, v in MIXTURE.items()}
    inner = c["heads"] * c["head"]
    layer = c["width"] * c["query"] + c["query"] * inner + c["width"] * c["latent"] + 2 * c["latent"] * inner + inner * c["width"]
    expert = 3 * c["width"] * c["expert_width"]
    dense = (c["layers"] - c["sparse"]) * 3 * c["width"] * 4 * c["width"]
    out = {
        "embedding": c["vocabulary"] * c["width"], "output": c["vocabulary"] * c["width"], "attention": layer * c["layers"], "dense": dense, "gating": c["width"] * c["experts"] * c["sparse"],
        "experts": (c["experts"] + c["shared"]) * expert * c["sparse"], "experts active": (c["active"] + c["shared"]) * expert * c["sparse"], "norm": c["layers"] * c["width"], "prediction": c["prediction"],
    }
    always = sum((out[k] for k in ("output", "attention", "dense", "gating", "norm")), out["embedding"])
    return out | {"total": always + out["experts"] + out["prediction"], "active": always + out["experts active"]}


def parameter_counts(spark) -> DataFrame:
    """(model, billions) of the dense models and of the parts of the mixture."""
    dense = named(spark, {f"dense-{k}": dense_parameters(*v) for k, v in DENSE.items()}, "model", "n").select("model", F.round(F.col("n") / 1e9, 5).alias("billions"))
    mixture = named(spark, mixture_parameters(), "model", "n").select("model", F.round(F.col("n") / 1e9, 4).alias("billions"))
    return dense.unionByName(mixture)


def operation_counts(spark, n: int, leaf: int, order: int) -> DataFrame:
    """(step, flops) of the tree method for n points, ``leaf`` of them in a cell, and expansions of an order."""
    n_, cells, p = F.lit(float(n)), F.lit(n / leaf), F.lit(float(order))
    near, far = 27, 6**3 - 27
    steps = {"tree": F.round(200 * n_ * F.log(n_)), "P2M": 10 * n_ * p * p, "M2M": 30 * cells * p**4, "M2L": far * 150 * cells * p**3, "L2L": 30 * cells * p**4, "L2P": 10 * n_ * p * p, "P2P": 20 * near * n_ * leaf}
    return named(spark, steps | {"total": sum(list(steps.values())[1:], steps["tree"])}, "step", "flops")


def round_up(df: DataFrame, text: str, unit: int = 110000, share: int = 275) -> DataFrame:
    """df with amount (digits of any script in text; null where there is none), total (up to units), units and carry."""
    digits = F.translate(F.regexp_replace(F.col(text), r"(?U)[^\d]", ""), "０１２３４５６７８９", "0123456789")
    out = df.withColumn("amount", digits.try_cast("bigint"))
    out = out.withColumn("total", F.expr(f"(amount + {unit - 1}) div {unit} * {unit}"))
    return out.withColumn("units", F.col("total") / F.lit(float(share))).withColumn("carry", F.col("total") - F.col("amount"))


def download_list(pages: DataFrame, after: int, tag: str) -> DataFrame:
    """(page_id, leaf, url) of rows past a position with another tag: the last of each name that the url ends in."""
    leaf = F.element_at(F.split("url", "/"), -1)
    named_ = pages.where((F.col("page_id") > after) & ~F.col("tag").eqNullSafe(tag)).withColumn("leaf", leaf).where("leaf <> ''")
    return named_.groupBy("leaf").agg(F.max("page_id").alias("page_id"), F.max_by("url", "page_id").alias("url"))


def split_sample(docs: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(split, doc_id, text): the first stripped, non-empty texts of each split, by id."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    rows = docs.withColumn("text", text).where("length(text) > 0")
    firsts = [rows.where(F.col("split") == s).orderBy("doc_id").limit(n) for s, n in sizes.items()]
    out = firsts[0]
    for f in firsts[1:]:
        out = out.unionByName(f)
    return out.select("split", "doc_id", "text")


def ring(ranks: DataFrame) -> DataFrame:
    """(rank, sender, received): the value of the neighbour below in a ring of ranks 0 .. n-1."""
    n = ranks.count()
    sent = ranks.select(F.pmod(F.col("rank") + 1, F.lit(max(n, 1))).alias("rank"), F.col("rank").alias("sender"), F.col("value").alias("received"))
    return ranks.select("rank").join(sent, "rank")
