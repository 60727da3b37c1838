"""Content recall, page gates, deck summaries and structural audits, all in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp01
from ..functions.text import content_text, numbers

#: What a page must reach.
GATES = {"overall": 0.98, "content": 0.995, "layout": 0.96, "appearance": 0.96, "editability": 1.0}


def content_recall(expected: Column, actual: Column) -> Column:
    """struct(score, missing, criticalNumbersMissing) of expected phrases in the joined actual texts.

    A phrase is there if it is contained or all its words are; without expected phrases the score is 1.
    """
    want = F.filter(F.transform(F.coalesce(expected, F.array()), content_text), lambda p: p != "")
    have = content_text(F.array_join(F.coalesce(actual, F.array()), " "))
    tokens = F.split(have, " ")
    missing = F.filter(
        want, lambda p: ~F.contains(have, p) & ~F.forall(F.split(p, " "), lambda t: F.array_contains(tokens, t))
    )
    figures = F.array_distinct(F.flatten(F.transform(want, numbers)))
    return F.struct(
        F.when(F.size(want) == 0, F.lit(1.0)).otherwise(clamp01(1 - F.try_divide(F.size(missing), F.size(want)))).alias("score"),
        missing.alias("missing"),
        F.filter(figures, lambda n: ~F.contains(have, n)).alias("criticalNumbersMissing"),
    )


def editability_failures(audit: Column) -> Column:
    count = lambda name: F.coalesce(audit[name], F.lit(0))
    return F.array_compact(
        F.array(
            F.when(count("filledTextShapeCount") > 0, "filled text box"),
            F.when((count("textShapeCount") > 0) & audit["minFontPt"].isNull(), "font size not written"),
            F.when(F.coalesce(audit["imageOnlyPage"], F.lit(False)), "image only"),
            F.when((count("rasterPictureCount") > 0) & (count("shapeCount") == 0), "no native shape"),
        )
    )


def page_quality(pages: DataFrame, gates: dict[str, float] | None = None) -> DataFrame:
    """Scores, gates and diagnostics of pages (page_id, expected, actual, audit, visual, model).

    model may be null: local metrics alone then decide. A critical diagnostic fails a page whatever its scores.
    """
    gate = GATES | (gates or {})
    visual, model = F.col("visual"), F.col("model")
    with_model = model.isNotNull()
    blend = lambda name: F.when(with_model, clamp01(visual[name] * 0.72 + clamp01(model[name]) * 0.28)).otherwise(clamp01(visual[name]))
    df = pages.withColumn("content", content_recall(F.col("expected"), F.col("actual")))
    df = df.withColumn("failures", editability_failures(F.col("audit")))
    local = F.col("content.score")
    content = F.when(with_model, F.least(local, clamp01(local * 0.8 + clamp01(model["contentScore"]) * 0.2))).otherwise(local)
    df = df.withColumns(
        {
            "contentScore": content,
            "layoutScore": blend("layoutScore"),
            "appearanceScore": blend("appearanceScore"),
            "editabilityScore": clamp01(1 - F.size("failures") * 0.34),
        }
    )
    total = F.col("contentScore") * 0.3 + F.col("layoutScore") * 0.25 + F.col("appearanceScore") * 0.25 + F.col("editabilityScore") * 0.2
    df = df.withColumn("overallScore", clamp01(total))
    note = lambda category, severity, text: F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), text.alias("message"))
    own = F.array_compact(
        F.array(
            F.when(F.size("content.missing") > 0, note("content", "critical", F.array_join(F.slice("content.missing", 1, 5), "; "))),
            F.when(F.size("content.criticalNumbersMissing") > 0, note("content", "critical", F.array_join("content.criticalNumbersMissing", ", "))),
        )
    )
    failed = F.transform("failures", lambda f: note("editability", "critical", f))
    weak = F.array_compact(
        F.array(
            F.when(F.col("layoutScore") < gate["layout"], note("layout", "major", F.lit("layout below its gate"))),
            F.when(F.col("appearanceScore") < gate["appearance"], note("appearance", "major", F.lit("appearance below its gate"))),
        )
    )
    said = F.transform(
        F.filter(F.coalesce(model["criticalErrors"], F.array()), lambda e: e["severity"] == "critical"),
        lambda e: F.struct(F.coalesce(e["category"], F.lit("semantic")).alias("category"), F.lit("critical").alias("severity"), F.coalesce(e["description"], F.lit("")).alias("message")),
    )
    df = df.withColumn("diagnostics", F.concat(own, failed, weak, said))
    passed = F.forall("diagnostics", lambda d: d["severity"] != "critical")
    for name, least in gate.items():
        passed = passed & (F.col(f"{name}Score") >= least)
    level = F.when(with_model, "full-model-and-local").otherwise("local-precheck")
    return df.withColumns({"passed": passed, "validationLevel": level, "pixelSimilarity": visual["similarity"]}).drop("failures")


def failed_page(pages: DataFrame, scored: DataFrame) -> DataFrame:
    """All pages; one without a score counts as a critical failure with zero scores."""
    out = pages.select("page_id").join(scored, "page_id", "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("overallScore", "layoutScore", "appearanceScore", "contentScore", "editabilityScore")}
    return out.withColumns(zero | {"passed": F.coalesce("passed", F.lit(False)), "validationLevel": F.coalesce("validationLevel", F.lit("failed"))})


def deck_summary(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts and means over pages; a missing score counts as zero, an empty deck has not passed."""
    mean = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0))
    full = F.coalesce(F.bool_and(F.col("validationLevel") == "full-model-and-local"), F.lit(True))
    return pages.groupBy(*(keys or [])).agg(
        F.count("*").alias("pageCount"),
        F.count_if("passed").alias("passedPages"),
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("allPassed"),
        mean("overallScore").alias("averageScore"),
        mean("layoutScore").alias("averageLayout"),
        mean("appearanceScore").alias("averageAppearance"),
        F.when(full, "full-model-and-local").otherwise("local-precheck").alias("validationLevel"),
    )


def evaluated_deck(items: DataFrame, inputs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Page scores and the summary of decks in one go: items (page_id, *keys), inputs of page_quality where a page has them.

    A page without inputs (it was not rendered or analysed) fails with zero scores and counts in its deck.
    """
    scored = failed_page(items, page_quality(inputs).drop(*keys)).join(items.select("page_id", *keys), "page_id")
    return scored, deck_summary(scored, keys)


def component_summary(components: DataFrame) -> DataFrame:
    """Counts by type of a page's components and the largest share of a fragment."""
    kinds = ("line", "ellipse", "roundRect", "outlineRect", "rect", "icon", "semanticIcon", "picture", "fragment")
    counts = [F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds]
    largest = F.coalesce(F.max(F.when(F.col("type") == "fragment", F.col("areaRatio"))), F.lit(0.0))
    return components.groupBy("page_id").agg(F.count("*").alias("n"), *counts, largest.alias("max_fragment_ratio"))


def audit_flags(slides: DataFrame) -> DataFrame:
    """Deck flags over audited slides; each is true for a deck without slides."""
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    return slides.groupBy("deck_id").agg(
        every(F.col("filledTextShapeCount") == 0).alias("passedTransparentText"),
        every((F.col("textShapeCount") == 0) | F.col("minFontPt").isNotNull()).alias("hasAppliedFontSizes"),
        every(~F.col("imageOnlyPage")).alias("passedEditablePages"),
    )


def replayed_loop(scores: DataFrame, most: int = 10, patience: int = 2, gain: float = 0.0005) -> DataFrame:
    """Replay of an improvement loop over (run_id, iteration, score, passed): where it stops and what is best.

    It stops on a pass, after `patience` rounds without a gain, or after `most` rounds; the best score stays.
    """
    row = F.sort_array(F.collect_list(F.struct("iteration", "score", "passed")))
    state = F.struct(
        F.lit(float("-inf")).alias("best"), F.lit(0).alias("best_at"), F.lit(0).alias("idle"), F.lit(0).alias("n"),
        F.lit("").alias("why"), F.lit(False).alias("best_passed"),
    )

    def step(s: Column, r: Column) -> Column:
        better = (r["score"] > s["best"] + gain) | (s["n"] == 0)
        idle = F.when(better, 0).otherwise(s["idle"] + 1)
        n = s["n"] + 1
        why = F.when(r["passed"], "quality-gates-passed").when(idle >= patience, "stagnated").when(n >= most, "iteration-limit").otherwise("")
        new = F.struct(
            F.when(better, r["score"]).otherwise(s["best"]).alias("best"), F.when(better, n).otherwise(s["best_at"]).alias("best_at"),
            idle.alias("idle"), n.alias("n"), why.alias("why"), F.when(better, r["passed"]).otherwise(s["best_passed"]).alias("best_passed"),
        )
        return F.when(s["why"] != "", s).otherwise(new)

    out = scores.groupBy("run_id").agg(F.aggregate(row, state, step).alias("s"))
    return out.select(
        "run_id", F.col("s.best").alias("best_score"), F.col("s.best_at").alias("best_iteration"), F.col("s.n").alias("iterations"),
        F.when(F.col("s.why") == "", "iteration-limit").otherwise(F.col("s.why")).alias("stop_reason"), F.col("s.best_passed").alias("passed"),
    )


def difference_metrics(pixels: DataFrame, keys: list[str], changed: float = 24.0) -> DataFrame:
    """Mean absolute error, share of changed pixels and similarity of pixel pairs (left, right arrays)."""
    gaps = F.zip_with(F.slice("left", 1, 3), F.slice("right", 1, 3), lambda a, b: F.abs(a - b))
    error = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / 3
    mean = F.coalesce(F.avg("error"), F.lit(0.0))
    return pixels.withColumn("error", error).groupBy(*keys).agg(
        mean.alias("mae"),
        F.coalesce(F.count_if(F.col("error") > changed) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("changed_ratio"),
        clamp01(1 - mean / 255).alias("similarity"),
    )


def numbered(df: DataFrame, *order: str, page: str = "page_id") -> DataFrame:
    """seq within a page in the given order: rows have no order of their own."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(page).orderBy(*order)) - 1)
