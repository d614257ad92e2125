"""Expert verdicts against machine scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as nm
from ..functions import ordered
from ..functions import text as tx
from ..functions.arrays import unnest
from ..session import cut_lineage

# ---- fixed values ----
CRITERIA = ("meaning", "terminology", "completeness", "expression")
SIGNIFICANT_GAP = 1.0
CONTRADICTION_WINDOW = 8
VERDICTS_IN_PROMPT = 12
TREND_MIN_ROWS = 4
HIGHER = " (lần đó bạn chấm CAO hơn AI {} điểm)"
LOWER = " (lần đó bạn chấm THẤP hơn AI {} điểm)"
# ---- end of fixed values ----


def has_reason() -> Column:
    return ~tx.blank(F.col("note"))


def attempt_context(attempts: DataFrame, turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Attempt to turn to session to workspace."""
    return attempts.join(turns, "turn_id").join(
        sessions.select(F.col("id").alias("session_id"), "workspace_id"), "session_id"
    )


def dominant_category(turn_terms: DataFrame, glossary: DataFrame) -> DataFrame:
    """Most frequent category of a turn's terms; equal counts go to the first name.

    turn_terms: turn_id, glossary_id. A term listed twice counts once.
    """
    terms = turn_terms.select("turn_id", "glossary_id").distinct()
    known = terms.join(
        glossary.filter(F.col("category").isNotNull()).select(F.col("id").alias("glossary_id"), "category"),
        "glossary_id",
    )
    tally = known.groupBy("turn_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return tally.groupBy("turn_id").agg(F.min(F.struct((-F.col("n")).alias("o"), "category")).alias("__top")).select(
        "turn_id", F.col("__top.category").alias("category"), (-F.col("__top.o")).alias("n_terms")
    )


def expert_overall(verdicts: DataFrame) -> DataFrame:
    """Adds ``e_overall``: mean of the criteria the expert gave."""
    return verdicts.withColumn("e_overall", nm.row_mean([F.col(f"e_{c}") for c in CRITERIA]))


def machine_overall(scores: DataFrame) -> DataFrame:
    return scores.withColumn("a_overall", nm.row_mean([F.col(f"a_{c}") for c in CRITERIA]))


def latest_score(scores: DataFrame, order: list[str]) -> DataFrame:
    """Newest machine score per attempt; ``order`` makes ties explicit."""
    others = [c for c in scores.columns if c != "attempt_id" and c not in order]
    newest = scores.groupBy("attempt_id").agg(F.max(F.struct(*order, *others)).alias("__s"))
    return newest.select("attempt_id", *[F.col(f"__s.{c}").alias(c) for c in [*order, *others]])


def compared(verdicts: DataFrame, scores: DataFrame, latest_only: list[str] | None = None) -> DataFrame:
    """Verdicts with every score of their attempt (re-scores multiply rows).

    ``latest_only`` takes the newest score by the given order columns instead.
    """
    chosen = latest_score(scores, latest_only) if latest_only else scores
    return verdicts.join(chosen.select("attempt_id", *[f"a_{c}" for c in CRITERIA], "a_overall"), "attempt_id")


def contradictions(verdicts: DataFrame, order: list[str], ties: list[str] | None = None,
                   window: int = CONTRADICTION_WINDOW) -> DataFrame:
    """Pairs of a reasoned verdict and an older one that points the other way.

    verdicts: verdict_id, workspace_id, category, note, direction (expert minus
    machine) and the ``order`` columns, first one time. With ``ties`` a verdict
    has a row for every score of its attempt; it asks once, with the direction
    of the last by ``ties``, and each row can contradict. Each verdict is
    compared with the ``window`` latest reasoned rows before it in its workspace
    and category; without a category of its own, in the whole workspace. A row
    without direction takes up its place among them, but contradicts nothing.

    No verdict meets more than ``window`` others, and no workspace is one task:
    they come from one ordered scan (:func:`ordered.recent`).
    """
    shared, ties = ["workspace_id", "category", "verdict_id", *order], ties or []
    standing = verdicts.filter(has_reason()).select(*shared, *ties, F.col("direction").cast("double").alias("direction"))
    asks = F.col("direction")
    if ties:        # a verdict has as many rows as its attempt has scores; the first of them asks
        own = Window.partitionBy(*shared)
        first = F.row_number().over(own.orderBy(*ties)) == 1
        asks = F.when(first, F.max_by("direction", F.struct(*ties)).over(own))
    rows = cut_lineage(standing.withColumn("__asks", F.when(F.abs(asks) >= SIGNIFICANT_GAP, asks)))     # read by both scans below
    place = [F.col(c) for c in (*order, "verdict_id", *ties)]

    def seen(part: DataFrame, keys: list[str]) -> DataFrame:
        return ordered.recent(part, keys, place, F.struct("verdict_id", "direction"), window, "__before").filter("__asks IS NOT NULL")

    in_category = seen(rows.filter("category IS NOT NULL"), ["workspace_id", "category"])
    in_all = seen(rows, ["workspace_id"]).filter("category IS NULL")
    pairs = unnest(in_category.unionByName(in_all), ["workspace_id", "verdict_id", "__asks"], F.col("__before"), "old")
    opposite = (F.col("old.direction") * F.col("__asks") < 0) & (F.abs("old.direction") >= SIGNIFICANT_GAP)
    return pairs.filter(opposite).select(
        "workspace_id", "verdict_id", F.col("old.verdict_id").alias("old_verdict_id"),
        F.col("old.direction").alias("old_gap"),
        F.when(F.col("old.direction") > 0, "raised").otherwise("lowered").alias("old_direction"),
    )


def pin_translations(turns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Turns whose reference is the newest translation an expert pinned.

    turns: turn_id, reference_translation, reference_tier. verdicts: turn_id,
    verdict_id, pinned_translation.
    """
    pins = verdicts.filter(~tx.blank(F.col("pinned_translation"))).groupBy("turn_id").agg(
        F.max_by(tx.strip(F.col("pinned_translation")), "verdict_id").alias("__pin")
    )
    return turns.join(pins, "turn_id", "left").withColumns({
        "reference_translation": F.coalesce("__pin", "reference_translation"),
        "reference_tier": F.when(F.col("__pin").isNotNull(), "expert_pinned").otherwise(F.col("reference_tier")),
    }).drop("__pin")


def relevant_verdicts(
    verdicts: DataFrame, wanted: DataFrame, order: list[Column], limit: int = VERDICTS_IN_PROMPT
) -> DataFrame:
    """Per (workspace, category asked for) the reasoned verdicts that matter most.

    verdicts: workspace_id, note, related_category, ... joined with their
    scores. wanted: workspace_id, category (one row per question, category may
    be NULL). Same category first, then the newest.

    Only the first ``limit`` verdicts per category and of the whole workspace
    can be chosen, so both lists are cut before they meet the questions.
    """
    reasoned = verdicts.filter(has_reason())
    by_category = ordered.first_per_key(reasoned, ["workspace_id", "related_category"], order, limit, "__n").drop("__n")
    # Enough of the newest to fill up whatever the same-category part leaves.
    newest = ordered.first_per_key(reasoned, ["workspace_id"], order, 2 * limit, "__n").drop("__n")
    same = wanted.join(
        by_category.withColumn("category", F.col("related_category")), ["workspace_id", "category"]
    ).withColumn("priority", F.lit(0))
    rest = wanted.join(newest, "workspace_id").filter(
        F.col("category").isNull() | ~F.col("related_category").eqNullSafe(F.col("category"))
    ).withColumn("priority", F.lit(1))
    window = Window.partitionBy("workspace_id", "category").orderBy("priority", *order)
    return same.unionByName(rest).withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit)


def calibration_text(relevant: DataFrame) -> DataFrame:
    """One text per (workspace, category): a line per chosen verdict, in rank order."""
    gap = F.col("e_overall") - F.col("a_overall")
    shown = F.format_string("%.1f", F.abs(gap).cast("double"))

    def wording(template: str) -> Column:
        before, after = template.split("{}")
        return F.concat(F.lit(before), shown, F.lit(after))

    direction = F.when(gap >= nm.GAP_THRESHOLD, wording(HIGHER)).when(
        gap <= -nm.GAP_THRESHOLD, wording(LOWER)
    ).otherwise("")
    category = F.col("related_category").cast("string")
    tag = F.when(F.coalesce(category, F.lit("")) != "", F.concat(F.lit("["), category, F.lit("] "))).otherwise("")
    line = F.concat(F.lit("- "), tag, tx.strip(F.col("note")), direction)
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return relevant.groupBy("workspace_id", "category").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("calibration_text")
    )


def _unpivoted(pairs: DataFrame) -> DataFrame:
    gaps = F.array(*[
        F.struct(
            F.lit(i).alias("no"), F.lit(c).alias("criterion"),
            (F.col(f"e_{c}") - F.col(f"a_{c}")).cast("decimal(5,1)").alias("gap"),
        )
        for i, c in enumerate(CRITERIA)
    ])
    return pairs.select("workspace_id", F.explode(gaps).alias("g")).select("workspace_id", "g.*")


def divergence(pairs: DataFrame) -> DataFrame:
    """Per workspace and criterion: n, mean gap, mean absolute gap, times adjusted."""
    return (
        _unpivoted(pairs).groupBy("workspace_id", "criterion").agg(
            F.count("gap").alias("n"),
            nm.mean_of(F.col("gap"), 2).alias("mean_gap"),
            nm.mean_of(F.abs("gap"), 2).alias("mean_abs_gap"),
            F.count_if(F.abs("gap") >= nm.GAP_THRESHOLD).alias("times_adjusted"),
        )
    )


def timeline(pairs: DataFrame) -> DataFrame:
    """Gaps of every verdict, by time."""
    return pairs.select(
        "workspace_id", "session_id", "attempt_id", "created_at", "action",
        *[(F.col(f"e_{c}") - F.col(f"a_{c}")).cast("double").alias(f"gap_{c}") for c in CRITERIA],
        F.col("a_overall").cast("double").alias("machine_overall"),
        F.col("e_overall").cast("double").alias("expert_overall"),
    ).orderBy("workspace_id", "created_at")


def gap_trend(pairs: DataFrame, order: list[Column]) -> DataFrame:
    """Mean absolute gap of the first half of a workspace's verdicts against the rest.

    Rows are counted per value of the first order column; only those of the one
    value in which a workspace's middle falls are put in order one by one.
    """
    names = [F.col(f"__o{i}") for i in range(len(order))]
    scored = cut_lineage(pairs.filter(F.col("e_overall").isNotNull() & F.col("a_overall").isNotNull() & F.col("workspace_id").isNotNull()).select(
        "workspace_id", nm.tenths(F.abs(F.col("e_overall") - F.col("a_overall"))).alias("__gap"),
        *[o.alias(f"__o{i}") for i, o in enumerate(order)],
    ))      # counting and ordering read it
    steps = scored.groupBy("workspace_id", "__o0").agg(F.count(F.lit(1)).alias("__n"), F.sum("__gap").alias("__s"))
    steps = cut_lineage(ordered.running(cut_lineage(steps), ["workspace_id"], [names[0]], F.col("__n"), "__upto", F.sum))
    halves = steps.groupBy("workspace_id").agg(F.floor(F.sum("__n") / 2).alias("__half"))
    placed = steps.join(halves, "workspace_id")
    before = F.col("__upto") - F.col("__n")
    split = (F.col("__upto") > F.col("__half")) & (before < F.col("__half"))

    def sides(rows: DataFrame, first: Column, n: Column, gaps: Column) -> DataFrame:
        return rows.groupBy("workspace_id").agg(*[
            F.sum(F.when(chosen, value)).alias(f"__{side}_{name}")
            for side, chosen in (("early", first), ("late", ~first)) for name, value in (("n", n), ("s", gaps))])

    whole = sides(placed.filter(~split), F.col("__upto") <= F.col("__half"), F.col("__n"), F.col("__s"))
    middle = placed.filter(split).select("workspace_id", F.col("__o0").alias("__step"), (F.col("__half") - before).alias("__left"))
    inside = scored.join(middle, "workspace_id").filter(F.col("__o0").eqNullSafe(F.col("__step"))).drop("__step")
    cut = sides(ordered.positions(inside, ["workspace_id"], names, "__place"), F.col("__place") <= F.col("__left"), F.lit(1).cast("bigint"), F.col("__gap"))
    sums = [F.coalesce(F.sum(f"__{side}_{name}"), F.lit(0)).alias(f"__{side}_{name}") for side in ("early", "late") for name in ("n", "s")]
    total = whole.unionByName(cut).groupBy("workspace_id").agg(*sums)

    def mean(side: str) -> Column:
        return (F.col(f"__{side}_s").cast("decimal(20,0)") / (F.nullif(F.col(f"__{side}_n"), F.lit(0)) * 10)).alias(side)

    means = total.select("workspace_id", (F.col("__early_n") + F.col("__late_n")).alias("n"), mean("early"), mean("late"))
    change = nm.sign_of_change(F.col("early"), F.col("late"), nm.TREND_BAND, inclusive=False)
    return means.select(
        "workspace_id", "n",
        F.when(F.col("n") >= TREND_MIN_ROWS, F.round("early", 1)).cast("double").alias("early"),
        F.when(F.col("n") >= TREND_MIN_ROWS, F.round("late", 1)).cast("double").alias("late"),
        F.when(F.col("n") >= TREND_MIN_ROWS,
               F.when(change == "down", "narrowing").when(change == "up", "widening").otherwise("flat")).alias("trend"),
    )


def heaviest_criterion(pairs: DataFrame) -> DataFrame:
    """The criterion with the largest total absolute gap; equal totals keep the usual order."""
    totals = _unpivoted(pairs).groupBy("workspace_id", "no", "criterion").agg(
        F.sum(F.abs("gap")).alias("total"), F.count_if(F.abs("gap") >= nm.GAP_THRESHOLD).alias("times_adjusted"),
        nm.mean_of(F.col("gap"), 2).alias("mean_gap"),
    )
    return (
        totals.groupBy("workspace_id").agg(
            F.max_by(F.struct("criterion", "total", "times_adjusted", "mean_gap"),
                     F.struct(F.coalesce("total", F.lit(0)), -F.col("no"))).alias("__top")
        )
        .filter(F.col("__top.total") > 0)
        .select("workspace_id", "__top.criterion", F.col("__top.total").cast("double").alias("total_abs_gap"),
                "__top.times_adjusted", "__top.mean_gap")
    )


def verdict_counts(verdicts: DataFrame, pairs: DataFrame) -> DataFrame:
    """n_verdicts, n_agree and n_compared per workspace."""
    from . import counts

    return counts.per_workspace([
        (verdicts, {"n_verdicts": counts.every_row(), "n_agree": F.col("action") == "agree"}),
        (pairs, {"n_compared": counts.every_row()}),
    ])


def reset_calibration(verdicts: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Verdicts with the reasons of some workspaces cleared; scores stay. Adds ``was_reset``."""
    chosen = workspaces.select("workspace_id", F.lit(True).alias("__reset")).distinct()
    hit = F.coalesce("__reset", F.lit(False)) & has_reason()
    return (
        verdicts.join(chosen, "workspace_id", "left").withColumn("was_reset", hit)
        .withColumn("note", F.when(~F.col("was_reset"), F.col("note"))).select(*verdicts.columns, "was_reset")
    )


def verdict_history(
    verdicts: DataFrame, scores: DataFrame, turns: DataFrame, order: list[Column], limit: int = 100
) -> DataFrame:
    """Newest verdicts per workspace with their turn and machine scores.

    The cut is made on the joined rows, because re-scores multiply them; rows
    that cannot be among the first ``limit`` are dropped before the joins.
    """
    head = ordered.first_per_key(verdicts, ["workspace_id"], order, limit, "__n").drop("__n")
    joined = head.join(scores.select("attempt_id", "score_no", "a_overall"), "attempt_id", "left").join(
        turns, "attempt_id", "left"
    )
    return ordered.first_per_key(joined, ["workspace_id"], [*order, F.col("score_no")], limit)
