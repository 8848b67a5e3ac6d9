"""Quality measures of predictions against gold spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checks as K
from ..functions.constants import AUTO, BENCHMARK, REVIEW, TYPES

KEY = ["pii_type", "document_part", "block_id", "start_offset", "end_offset"]


def gold(spark: SparkSession) -> DataFrame:
    rows = [(b[1], "benchmark", f"benchmark#p{k}", b[2], b[3]) for k, b in enumerate(BENCHMARK, 1) if b[1]]
    return spark.createDataFrame(rows, "pii_type string, document_part string, block_id string, start_offset int, end_offset int")


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text spans, spans of images): an image span has a media_name and comes from an image or its text, or has a box."""
    if "media_name" not in df.columns:
        return df, df.limit(0)
    image = F.col("media_name").isNotNull()
    marks = [F.col("source_kind").isin("image", "ocr_text")] if "source_kind" in df.columns else []
    marks += [F.col("bounding_box").isNotNull()] if "bounding_box" in df.columns else []
    for m in marks[1:]:
        marks[0] = F.coalesce(marks[0], F.lit(False)) | m
    image = image & (F.coalesce(marks[0], F.lit(False)) if marks else F.lit(False))
    return df.where(~image), df.where(image)


def strict(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """KEY with n_pred, n_gold and tp: one-to-one matches of equal keys."""
    p = predictions.groupBy(*KEY).agg(F.count("*").alias("n_pred"))
    g = truth.groupBy(*KEY).agg(F.count("*").alias("n_gold"))
    both = p.join(g, KEY, "full").fillna(0, ["n_pred", "n_gold"])
    return both.withColumn("tp", F.least("n_pred", "n_gold"))


def marked(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """predictions with `matched`: whether a strict match takes it; of equal ones, the least record ids."""
    g = truth.groupBy(*KEY).agg(F.count("*").alias("_n_gold"))
    by = Window.partitionBy(*KEY).orderBy("record_id")
    return predictions.withColumn("_n", F.row_number().over(by)).join(g, KEY, "left").withColumn("matched", F.coalesce(F.col("_n") <= F.col("_n_gold"), F.lit(False))).drop("_n", "_n_gold")


def _greedy(rows: DataFrame, share: Callable[[Column, Column], Column], least: float) -> DataFrame:
    """rows (arrays p and g) with `m`, one (i, j, q) a row: each of p in turn takes the free one of g with the best share."""
    pair = "array<struct<i:int,j:int,q:double>>"

    def step(a: Column, i: Column) -> Column:
        x = F.get("p", i)
        free = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda j: ~F.exists(a, lambda z: z["j"] == j) & (share(x, F.get("g", j)) >= least))
        best = F.array_sort(F.transform(free, lambda j: F.struct((-share(x, F.get("g", j))).alias("q"), j.alias("j"))))
        return F.when(F.size(best) > 0, F.concat(a, F.array(F.struct(i.alias("i"), F.get(best, F.lit(0))["j"].alias("j"), (-F.get(best, F.lit(0))["q"]).alias("q")))).cast(pair)).otherwise(a)

    return rows.withColumn("m", F.explode(F.aggregate(F.sequence(F.lit(0), F.size("p") - 1), F.array().cast(pair), step)))


def relaxed(predictions: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(prediction, gold) rows: greedy one-to-one in prediction order, best overlap over the shorter span, at least `least`.

    Predictions and gold of one (type, part, block) meet in one row; both are bounded by the block.
    """
    key = KEY[:3]
    arrays = lambda df, c: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("start_offset").alias("s"), F.col("end_offset").alias("e")))).alias(c))

    def share(x: Column, y: Column) -> Column:
        inter = F.greatest(F.lit(0), F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"]))
        return inter / F.greatest(F.lit(1), F.least(x["e"] - x["s"], y["e"] - y["s"]))

    out = _greedy(arrays(predictions, "p").join(arrays(truth, "g"), key), share, least)
    return out.select(*key, *[F.get(c, F.col(f"m.{k}"))[o].alias(f"{n}_{o}") for c, k, n in (("p", "i", "pred"), ("g", "j", "gold")) for o in ("s", "e")], F.col("m.q").alias("share"))


def images(predictions: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(type, media_name, pred_box, gold_box, iou): boxes of one image and type, greedy one-to-one by intersection over union.

    bounding_box is [x1, y1, x2, y2]; a null box meets none. 0.5 is the strict threshold, 0.3 the relaxed one.
    """
    key = ["pii_type", "media_name"]
    box = F.col("bounding_box")
    arrays = lambda df, c: df.where(box.isNotNull()).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*[box[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]))).alias(c))
    out = _greedy(arrays(predictions, "p").join(arrays(truth, "g"), key), K.iou, least)
    return out.select(*key, *[F.array(*[F.get(c, F.col(f"m.{k}"))[o] for o in ("x1", "y1", "x2", "y2")]).alias(f"{n}_box") for c, k, n in (("p", "i", "pred"), ("g", "j", "gold"))], F.col("m.q").alias("iou"))


def overall(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: relaxed tp, fp, fn, precision, recall and f1, automatic_precision (strict matches among automatic ones),
    review_workload (share that waits for a person) and image_coverage (images predicted over images in gold)."""
    (text, image), (gold_text, gold_image) = _sides(predictions), _sides(truth)
    tp = relaxed(text, gold_text).agg(F.count("*").alias("tp"))
    if "bounding_box" in image.columns and "bounding_box" in gold_image.columns:
        tp = tp.unionByName(images(image, gold_image, 0.3).agg(F.count("*").alias("tp"))).agg(F.sum("tp").alias("tp"))
    auto = F.col("review_status") == "AUTO_APPROVED"
    waits = F.col("review_status").isin("NEEDS_REVIEW", "LOW_CONFIDENCE")
    p = marked(predictions, truth).agg(F.count("*").alias("_p"), F.count_if(auto).alias("_auto"), F.count_if(auto & F.col("matched")).alias("_right"), F.count_if(waits).alias("_waits"))
    media = lambda df, name: df.agg(F.countDistinct("media_name").alias(name)) if "media_name" in df.columns else df.agg(F.lit(0).cast("long").alias(name))
    row = tp.crossJoin(p).crossJoin(truth.agg(F.count("*").alias("_g"))).crossJoin(media(image, "_seen")).crossJoin(media(gold_image, "_there"))  # one row each
    row = _scores(row.withColumn("fp", F.col("_p") - F.col("tp")).withColumn("fn", F.col("_g") - F.col("tp")))
    return row.select("tp", "fp", "fn", "precision", "recall", "f1", K.ratio(F.col("_right"), F.col("_auto")).alias("automatic_precision"), K.ratio(F.col("_waits"), F.col("_p")).alias("review_workload"), K.ratio(F.col("_seen"), F.col("_there")).alias("image_coverage"))


def bands(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """band, predictions, tp and precision of the three bands of confidence; all three are listed."""
    c = F.col("final_confidence")
    band = F.when(c >= AUTO, "high").when(c >= REVIEW, "medium").otherwise("low")
    n = marked(predictions, truth).groupBy(band.alias("band")).agg(F.count("*").alias("predictions"), F.count_if("matched").alias("tp"))
    three = predictions.sparkSession.createDataFrame([("high",), ("medium",), ("low",)], "band string")
    return three.join(n, "band", "left").fillna(0).withColumn("precision", K.ratio(F.col("tp"), F.col("predictions")))


def human_actions(predictions: DataFrame) -> DataFrame:
    """action and n: decisions of people in the evidence."""
    rows = predictions.select(F.explode("evidence.name").alias("name")).where(F.col("name").startswith("human_"))
    return rows.groupBy(F.upper(F.substring("name", 7, 100)).alias("action")).agg(F.count("*").alias("n"))


def per_type(matches: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of every type, zeros for those not seen."""
    spark = matches.sparkSession
    dim = spark.createDataFrame([(t,) for t in TYPES], "pii_type string")
    n = matches.groupBy("pii_type").agg(F.sum("tp").alias("tp"), F.sum(F.col("n_pred") - F.col("tp")).alias("fp"), F.sum(F.col("n_gold") - F.col("tp")).alias("fn"))
    return _scores(dim.join(n, "pii_type", "left").fillna(0))


def micro(matches: DataFrame) -> DataFrame:
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return _scores(matches.agg(total("tp", "tp"), total(F.col("n_pred") - F.col("tp"), "fp"), total(F.col("n_gold") - F.col("tp"), "fn")))


def _scores(df: DataFrame) -> DataFrame:
    rows = df.withColumn("precision", K.ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", K.ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return rows.withColumn("f1", K.f1(F.col("precision"), F.col("recall")))


def by_block(blocks: DataFrame, predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, tn, fp, fn over blocks that hold anything or nothing, and accuracy."""
    mark = lambda df, c: df.select("block_id").distinct().withColumn(c, F.lit(True))
    rows = blocks.select("block_id").join(mark(predictions, "p"), "block_id", "left").join(mark(truth, "g"), "block_id", "left").fillna(False, ["p", "g"])
    n = rows.agg(F.count_if(F.col("p") & F.col("g")).alias("tp"), F.count_if(~F.col("p") & ~F.col("g")).alias("tn"), F.count_if(F.col("p") & ~F.col("g")).alias("fp"), F.count_if(~F.col("p") & F.col("g")).alias("fn"))
    return n.withColumn("accuracy", K.ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def by_character(blocks: DataFrame, predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, tn over characters."""
    chars = lambda df, c: df.select("block_id", F.explode(F.sequence("start_offset", F.col("end_offset") - 1)).alias("at")).distinct().withColumn(c, F.lit(1))
    both = chars(predictions, "p").join(chars(truth, "g"), ["block_id", "at"], "full").fillna(0, ["p", "g"])
    n = both.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(k) for k, x in (("tp", F.col("p") * F.col("g")), ("fp", F.col("p") * (1 - F.col("g"))), ("fn", F.col("g") * (1 - F.col("p"))))])
    total = blocks.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("total"))
    rows = n.crossJoin(total)  # one row each
    rows = rows.withColumn("tn", F.greatest(F.lit(0), F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))).drop("total")
    return rows.withColumn("accuracy", K.ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
