"""Scores, eligibility and choice of language models by cost and capability.

Models have model_id, name, provider, tier, cost, score, speed, context,
latency and modality.  A catalogue is small; still everything is an expression
or a join, with the frontier as the only global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .analytics import forgetful_sums, skyline

#: Factors of cost and score by effort, and the most that a score can be.
EFFORTS = {"low": (0.6, 0.95), "medium": (1.0, 1.0), "high": (1.8, 1.04), "max": (3.2, 1.07)}
MOST_SCORE = 100.0
#: Licences by kind.
PERMISSIVE = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "0bsd", "cc0-1.0")
COPYLEFT = ("gpl-2.0", "gpl-3.0", "agpl-3.0", "lgpl-2.1", "lgpl-3.0", "mpl-2.0", "epl-2.0")
#: Parts of the names of models that make media, not text.
MEDIA_NAMES = ("lyria", "whisper", "tts", "dall-e", "midjourney", "flux", "sora", "kling", "hailuo", "runway", "luma", "recraft", "ltx-video", "cogvideox")
#: Least cost that is told apart, and the proximity from which a model is near the frontier.
LEAST_COST, NEAR = 0.0001, 0.95
#: Fixed values of the tiers: least scores of the challenger and the drafter.
CHALLENGER_FROM, DRAFTER_FROM = 88.0, 86.0


def at_effort(cost: Column, score: Column, effort: Column) -> tuple[Column, Column]:
    """Cost and score of a model at an effort; an unknown effort changes nothing."""
    level = F.lower(F.coalesce(effort, F.lit("")))
    factor = lambda i: F.coalesce(*[F.when(level == name, F.lit(f[i])) for name, f in EFFORTS.items()], F.lit(1.0))
    return F.round(cost * factor(0), 6), F.least(F.lit(MOST_SCORE), F.round(score * factor(1), 2))


def licence_kind(spdx: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(spdx, F.lit(""))))
    return F.when(name.isin(*PERMISSIVE), "permissive").when(name.isin(*COPYLEFT), "copyleft").otherwise("unknown")


def repository_score(stars: Column, licence: Column, has_tests: Column, archived: Column) -> Column:
    """Credibility of a repository, 0 to 1: an archived one has 0.2, others 0.4 and what they earn."""
    by_stars = F.when(stars >= 1000, 0.3).when(stars >= 200, 0.2).when(stars >= 50, 0.1).otherwise(0.0)
    by_licence = F.when(licence == "permissive", 0.2).when(licence == "copyleft", 0.05).otherwise(0.0)
    earned = F.lit(0.4) + by_stars + by_licence + F.when(has_tests, 0.1).otherwise(0.0)
    return F.when(archived, 0.2).otherwise(F.round(F.least(F.lit(1.0), earned), 2))


def eligible(domain: str | None = None) -> Column:
    """Whether a model serves interactive production in a domain: no free, batch, shared or local offer, and of the right modality."""
    model, name = F.lower("model_id"), F.lower(F.coalesce("name", F.lit("")))
    modality = F.coalesce("modality", F.lit("text"))
    offer = model.endswith(":free") | model.endswith(":batch") | model.contains("contributor") | name.contains("contributor") | model.contains("data-sharing")
    local = (F.col("tier") == "local_zero_cost") | F.col("provider").isin("ollama", "local")
    media = {"image_gen": "image", "image_generation": "image", "video_gen": "video", "video_generation": "video"}
    kind = media.get((domain or "").lower())
    text = ~modality.isin("image", "video") & ~model.rlike("|".join(MEDIA_NAMES))
    return ~F.coalesce(offer | local, F.lit(False)) & ((modality == kind) if kind else text)


def frontier_proximity(models: DataFrame) -> DataFrame:
    """Models with proximity, near, gap_score, gap_cost and opportunity, measured against the skyline of the eligible ones.

    Cost (as a logarithm) and score are scaled to the range of the eligible
    models; a model's distance is that to the polyline through the skyline, its
    gaps are those to the polyline at its cost and at its score.  The skyline is
    an array on every row: it has one entry per model that none outdoes.
    """
    pool = models.filter(eligible())
    floor = F.greatest("cost", F.lit(LEAST_COST))
    bounds = pool.agg(F.min(F.ln(floor)).alias("c0"), F.max(F.ln(floor)).alias("c1"), F.min("score").alias("s0"), F.max("score").alias("s1"))
    front = skyline(pool.select("model_id", "cost", "score"), "cost", "score", tie="model_id")
    points = front.agg(F.array_sort(F.collect_list(F.struct("cost", "score"))).alias("line"), F.collect_set("model_id").alias("best"))
    rows = models.crossJoin(F.broadcast(bounds)).crossJoin(F.broadcast(points))  # one row each
    width = lambda a, b: F.when(F.col(b) > F.col(a), F.col(b) - F.col(a)).otherwise(1.0)
    x = lambda cost: (F.ln(F.greatest(cost, F.lit(LEAST_COST))) - F.col("c0")) / width("c0", "c1")
    y = lambda score: (score - F.col("s0")) / width("s0", "s1")
    rows = rows.withColumn("px", x(F.col("cost"))).withColumn("py", y(F.col("score")))
    scaled = F.transform("line", lambda p: F.struct(x(p["cost"]).alias("x"), y(p["score"]).alias("y"), p["cost"].alias("cost"), p["score"].alias("score")))
    rows = rows.withColumn("line", scaled)
    # every stretch of the line; a line of one point is one stretch without length
    after = F.when(F.size("line") > 1, F.slice("line", 2, F.size("line"))).otherwise(F.col("line"))
    before = F.slice("line", 1, F.size(after))
    rows = rows.withColumn("stretches", F.arrays_zip(before.alias("a"), after.alias("b")))

    def apart(s: Column) -> Column:
        vx, vy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        length = vx * vx + vy * vy
        along = F.when(length > 0, ((F.col("px") - s["a"]["x"]) * vx + (F.col("py") - s["a"]["y"]) * vy) / length).otherwise(0.0)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.sqrt(F.pow(F.col("px") - s["a"]["x"] - t * vx, 2) + F.pow(F.col("py") - s["a"]["y"] - t * vy, 2))

    def reached(own: Column, by: str, what: str) -> Column:
        """Value of the line where ``by`` is ``own``, held at its ends."""
        first, last = F.element_at("line", 1), F.element_at("line", -1)
        fit = F.filter("stretches", lambda s: (s["a"][by] <= own) & (own <= s["b"][by]) & (s["b"][by] > s["a"][by]))
        s = F.get(fit, F.lit(0))
        between = s["a"][what] + (own - s["a"][by]) / (s["b"][by] - s["a"][by]) * (s["b"][what] - s["a"][what])
        return F.when(own <= first[by], first[what]).when(own >= last[by], last[what]).otherwise(between)

    on_line = F.array_contains("best", F.col("model_id"))
    proximity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.array_min(F.transform("stretches", apart))))
    cost = F.greatest("cost", F.lit(LEAST_COST))
    bonus = (
        F.when(F.col("speed") >= 110, 0.10).when(F.col("speed") >= 80, 0.05).otherwise(0.0)
        + F.when(F.col("context") >= 500_000, 0.08).otherwise(0.0)
        + F.when((F.col("latency") > 0) & (F.col("latency") <= 0.40), 0.06).otherwise(0.0)
    )
    out = rows.withColumn("proximity", F.when(on_line, 1.0).otherwise(F.round(proximity, 4)))
    out = out.withColumn("near", ~on_line & (proximity >= NEAR))
    out = out.withColumn("gap_score", F.when(on_line, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(reached(cost, "cost", "score") - F.col("score"), 2))))
    out = out.withColumn("gap_cost", F.when(on_line, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(cost - reached(F.col("score"), "score", "cost"), 6))))
    return out.withColumn("opportunity", F.round(F.col("proximity") * (1 + bonus), 4)).select(*models.columns, "proximity", "near", "gap_score", "gap_cost", "opportunity")


def critical_candidates(measured: DataFrame) -> DataFrame:
    """(role, model_id): arbiter (greatest score), challenger (greatest opportunity from a score on) and drafter (fastest from a score on), all different.

    Where no other model has the score, all others are looked at.  Ties go to
    the smaller id.
    """
    def pick(pool: DataFrame, role: str, by: str, least: float | None) -> DataFrame:
        fit = F.lit(True) if least is None else F.col("score") >= least
        return pool.orderBy(fit.desc(), F.col(by).desc(), "model_id").limit(1).select(F.lit(role).alias("role"), "model_id")

    arbiter = pick(measured, "frontier_arbiter", "score", None)
    rest = measured.join(F.broadcast(arbiter), "model_id", "left_anti")
    challenger = pick(rest, "balanced_challenger", "opportunity", CHALLENGER_FROM)
    drafter = pick(rest.join(F.broadcast(challenger), "model_id", "left_anti"), "fast_drafter", "speed", DRAFTER_FROM)
    return drafter.unionByName(challenger).unionByName(arbiter)


def forgetful_profile(observations: DataFrame, *, forget: float = 0.995) -> DataFrame:
    """(type, n, tokens_per_mb, tokens_per_chunk, ok_share): sums of a format that forget older documents.

    ``observations`` has type, at (order), mb, tokens, chunks and ok.  The
    weight of a document is ``forget`` to the number of later ones; documents
    without chunks count for ``ok_share`` only, and don't age the others' sums.
    """
    paid = (F.col("chunks") > 0) & (F.col("tokens") > 0) & (F.col("mb") > 0)
    sums = {c: ("paid", F.col(c)) for c in ("tokens", "mb", "chunks")} | {"good": ("all", F.when(F.col("ok"), 1.0).otherwise(0.0)), "whole": ("all", F.lit(1.0))}
    got = forgetful_sums(observations, "type", "at", sums, forgetting=forget, among={"all": F.lit(True), "paid": paid})
    share = lambda a, b: F.round(F.col(a) / F.col(b), 6)
    return got.select(
        "type", F.col("n_all").alias("n"), share("tokens", "mb").alias("tokens_per_mb"), share("tokens", "chunks").alias("tokens_per_chunk"), share("good", "whole").alias("ok_share"),
    )
