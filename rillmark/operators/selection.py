"""Slices of questions, coverage of a universe, gates and the choice among measured configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import source_group

#: Languages that settle nothing, and the names of slices and groups.
UNDECIDED = ("", "indefinido", "misto")
SLICES = ("mesma-língua", "cross-lingual", "não declarado")
GROUPS = ("email", "reuniao", "escritorio", "misto")
#: Replicates that an arm needs, and the cosine up to which two vectors count as different.
LEAST_REPLICATES, SAME_COSINE = 2, 0.9999


# -- slices ------------------------------------------------------------------------


def decided(language: Column) -> Column:
    return ~F.coalesce(language, F.lit("")).isin(*UNDECIDED)


def pair_slice(question: Column, source: Column) -> Column:
    """Slice of a question and its source by their languages."""
    same, cross, none = SLICES
    return F.when(~decided(question) | ~decided(source), none).when(question == source, same).otherwise(cross)


def question_groups(sources: DataFrame) -> DataFrame:
    """(query_id, group): the group that all sources (``path``) of a question are of, else 'misto'."""
    kinds = F.collect_set(F.when(F.col("path").isNotNull(), source_group(F.col("path"))))
    found = sources.groupBy("query_id").agg(kinds.alias("kinds"))
    return found.select("query_id", F.when(F.size("kinds") == 1, F.element_at("kinds", 1)).otherwise("misto").alias("group"))


def set_language(sources: DataFrame) -> DataFrame:
    """(query_id, language): the one language of a question's sources, 'misto' for several, 'indefinido' with any undecided."""
    known = F.coalesce("language", F.lit(""))
    found = sources.groupBy("query_id").agg(F.collect_set(known).alias("seen"), F.min(decided(F.col("language")).cast("int")).alias("settled"))
    language = F.when(F.col("settled") == 0, "indefinido").when(F.size("seen") == 1, F.element_at("seen", 1)).otherwise("misto")
    return found.select("query_id", language.alias("language"))


def language_differences(questions: DataFrame, measured: DataFrame) -> DataFrame:
    """Questions whose annotated source language (``annotated``, '' or null: none) isn't the measured one, and how."""
    rows = questions.join(measured, "query_id", "left").withColumn("language", F.coalesce("language", F.lit("indefinido")))
    given = F.coalesce("annotated", F.lit("")) != ""
    kind = F.when(~given & decided(F.col("language")), "sem_anotacao").when(given & (F.col("annotated") != F.col("language")), "divergente")
    return rows.withColumn("kind", kind).filter("kind is not null").select("query_id", "kind", "annotated", "language")


def means_by(judged: DataFrame, keys: dict[str, tuple[str, ...]], metrics: tuple[str, ...]) -> DataFrame:
    """Means of metrics by one key with all its values, or by two: non-empty values of the first with all of the second.

    ``keys`` maps a column to its fixed values.
    """
    names = list(keys)
    means = judged.groupBy(*names).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])
    last = F.explode(F.array(*map(F.lit, keys[names[-1]]))).alias(names[-1])
    frame = judged.sparkSession.range(1).select(last) if len(names) == 1 else judged.select(names[0]).distinct().select(names[0], last)
    return frame.join(means, names, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def unexercised(before: DataFrame, after: DataFrame, slices: DataFrame) -> DataFrame:
    """(slice, common, untouched): whether both runs gave one ranking for every common question of a slice.

    Runs have query_id, item, rank; ``slices`` has query_id and slice.  It tells
    a tie from a variable that reaches no document of the slice.
    """
    listed = lambda run, name: run.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item")))["item"].alias(name))
    pairs = listed(before, "was").join(listed(after, "now"), "query_id").join(slices, "query_id")
    return pairs.groupBy("slice").agg(F.count("*").alias("common"), F.bool_and(F.col("was") == F.col("now")).alias("untouched"))


# -- coverage ----------------------------------------------------------------------


def top_folder(path: Column) -> Column:
    """First folder of a path; '(raiz)' for a file outside all folders."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("(raiz)")


def coverage_by_folder(universe: DataFrame, sources: DataFrame) -> DataFrame:
    """(folder, documents, sources): distinct paths of the universe, and of the questions' sources, by top folder."""
    docs = universe.select("path").distinct().groupBy(top_folder(F.col("path")).alias("folder")).agg(F.count("*").alias("documents"))
    named = sources.select("path").distinct().groupBy(top_folder(F.col("path")).alias("folder")).agg(F.count("*").alias("sources"))
    return docs.join(named, "folder", "left").withColumn("sources", F.coalesce("sources", F.lit(0)).cast("long"))


def coverage(universe: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: documents, covered (in folders that a source is of), reach, sources, inside, outside and their fraction of the universe."""
    folders = coverage_by_folder(universe, sources).agg(
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.when(F.col("sources") > 0, F.col("documents"))), F.lit(0)).alias("covered")
    )
    known = universe.select("path").distinct().withColumn("known", F.lit(1))
    named = sources.select("path").distinct().join(known, "path", "left").agg(F.count("*").alias("sources"), F.count("known").alias("inside"))
    ratio = lambda a: F.round(F.when(F.col("documents") > 0, F.col(a) / F.col("documents")).otherwise(0.0), 6)
    # one row each
    return folders.crossJoin(named).select(
        "documents", "covered", ratio("covered").alias("reach"), "sources", "inside", (F.col("sources") - F.col("inside")).alias("outside"), ratio("inside").alias("fraction")
    )


def scope_findings(questions: DataFrame, sources: DataFrame, indexed: DataFrame, *, of_content: bool = True) -> DataFrame:
    """Questions (query_id, mode 'todas' or 'qualquer', in_scope) that the index can't answer though they are in scope, or could though they are marked as outside.

    Returns query_id, kind ('silenciosa' or 'anotacao_velha'), missing and sources.
    """
    known = indexed.select("path").distinct().withColumn("known", F.lit(1))
    found = sources.select("query_id", "path").distinct().join(known, "path", "left").groupBy("query_id").agg(F.count("*").alias("sources"), F.count("known").alias("present"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = questions.join(found, "query_id", "left").select("query_id", "mode", "in_scope", zero("sources"), zero("present"))
    whole = F.col("present") == F.col("sources")
    enough = F.when(F.col("mode") == "todas", whole).otherwise(F.col("present") > 0)
    kind = F.when(F.col("in_scope") & ~enough, "silenciosa").when(F.lit(of_content) & ~F.col("in_scope") & whole, "anotacao_velha")
    return rows.withColumn("kind", kind).filter("kind is not null").select("query_id", "kind", (F.col("sources") - F.col("present")).alias("missing"), "sources")


def vector_agreement(a: DataFrame, b: DataFrame, *, cosine_at_most: float = SAME_COSINE) -> DataFrame:
    """One row over two vector maps (id, v): common, only_a, only_b, least and mean cosine, and how many are at most ``cosine_at_most``."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    pairs = a.select("id", F.col("v").alias("va")).join(b.select("id", F.col("v").alias("vb")), "id", "full")
    size = F.sqrt(dot(F.col("va"), F.col("va"))) * F.sqrt(dot(F.col("vb"), F.col("vb")))
    both = F.col("va").isNotNull() & F.col("vb").isNotNull()
    rows = pairs.withColumn("cosine", F.when(both, F.when(size > 0, dot(F.col("va"), F.col("vb")) / size).otherwise(0.0)))
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    return rows.agg(
        F.count_if(both).alias("common"), F.count_if(F.col("vb").isNull()).alias("only_a"), F.count_if(F.col("va").isNull()).alias("only_b"),
        zero(F.min("cosine")).alias("least"), zero(F.avg("cosine")).alias("mean"), F.count_if(F.col("cosine") <= cosine_at_most).alias("different"),
    )


# -- gates and choices -------------------------------------------------------------


def gate_violations(samples: DataFrame, gates: DataFrame) -> DataFrame:
    """(operation, kind, p95, bound): measured operations above the bound of a gate; unmeasured ones violate nothing."""
    return samples.select("operation", "p95").join(gates, "operation").filter(F.col("p95") > F.col("bound")).select("operation", "kind", "p95", "bound")


def fastest_sound(results: DataFrame, *, least_recall: float) -> DataFrame:
    """The result with the least p95, then the fewest probes, of those with enough recall; none if there is none."""
    return results.filter(F.col("recall") >= least_recall).orderBy("p95", "nprobes").limit(1)


def arm_contrast(runs: DataFrame, *, base: str = "livre") -> DataFrame:
    """(arm, replicates, median, changed, ratio, verdict): the median of each arm's replicate medians against the base arm.

    ``runs`` has arm, median (of one replicate) and changed (whether the
    machine's state changed).  One arm with too few replicates refuses all:
    medians and ratios are null then.
    """
    arms = runs.groupBy("arm").agg(F.count("*").alias("replicates"), F.round(F.median(F.round("median", 4)), 4).alias("median"), F.bool_or("changed").alias("changed"))
    # one row per arm
    whole = W.partitionBy()
    thin = F.min("replicates").over(whole) < LEAST_REPLICATES
    basis = F.max(F.when(F.col("arm") == base, F.col("median"))).over(whole)
    ratio = F.when(basis > 0, F.round(F.col("median") / basis, 2))
    out = arms.withColumn("thin", thin).withColumn("ratio", ratio)
    return out.select(
        "arm", "replicates", F.when(~F.col("thin"), F.col("median")).alias("median"), "changed", F.when(~F.col("thin"), F.col("ratio")).alias("ratio"),
        F.when(F.col("thin"), "recusado").otherwise("medido").alias("verdict"),
    )


def best_point(points: DataFrame, *, least_traps: int = 4) -> DataFrame:
    """The point with enough resolved traps that has the greatest MRR, then recall@1, then the least weight of names."""
    return points.filter(F.col("traps") >= least_traps).orderBy(F.col("mrr").desc(), F.col("recall_at_1").desc(), "name_weight").limit(1)


def staged_choice(points: DataFrame, *, least_traps: int, margin: float, trail_reference: float) -> DataFrame:
    """(passed_traps, passed_mean, passed_cross, passed_group, chosen): how many points each stage leaves, and the choice.

    ``points`` has id, is_reference, traps, mrr, mrr_cross, mrr_group and the
    weights path, name and trail.  Stages: traps, mean MRR and cross-lingual
    MRR not below the reference's, group MRR above it by more than ``margin``.
    Ties go to smaller path and name weights, then to the trail weight nearest
    the reference.  ``chosen`` is null if a stage leaves none.
    """
    reference = points.filter("is_reference").select(*[F.col(c).alias(f"ref_{c}") for c in ("mrr", "mrr_cross", "mrr_group")])
    # one row
    rows = points.filter("not is_reference").crossJoin(F.broadcast(reference))
    traps = F.col("traps") >= least_traps
    mean = traps & (F.col("mrr") >= F.col("ref_mrr"))
    cross = mean & (F.col("mrr_cross") >= F.col("ref_mrr_cross"))
    group = cross & (F.col("mrr_group") > F.col("ref_mrr_group") + margin)
    order = F.struct(F.col("mrr_group").alias("a"), (-F.col("path")).alias("b"), (-F.col("name")).alias("c"), (-F.abs(F.col("trail") - trail_reference)).alias("d"))
    return rows.agg(
        *[F.count_if(c).alias(f"passed_{n}") for n, c in (("traps", traps), ("mean", mean), ("cross", cross), ("group", group))],
        F.max_by(F.when(group, F.col("id")), F.when(group, order)).alias("chosen"),
    )


def interleaved(arms: list[str], replicates: int) -> list[str]:
    """Arms in turn, as often as there are replicates: A B A B, not A A B B."""
    if replicates < 1:
        raise ValueError("at least one replicate is needed")
    return arms * replicates


def weighted_turns(weights: dict[str, float], length: int) -> list[str]:
    """Names in proportion to their weights, spread evenly: every turn all gain their share of credit and the richest pays one."""
    total, credit, out = sum(weights.values()), dict.fromkeys(weights, 0.0), []
    while len(out) < length:
        credit = {name: c + weights[name] / total for name, c in credit.items()}
        richest = max(credit.items(), key=lambda item: (item[1], item[0]))[0]
        credit[richest] -= 1.0
        out.append(richest)
    return out


def shrunk(local: Column, prior: Column, n: Column, half_at: float) -> Column:
    """Blend of a local value and a prior: the prior without observations, half of each at ``half_at`` of them."""
    weight = n / (n + F.lit(float(half_at)))
    return F.when(n > 0, weight * local + (1 - weight) * prior).otherwise(prior)


def session_report(turns: DataFrame) -> DataFrame:
    """(session, turns, followups, one_shot_pct): one-shot successes that follow no other turn, per cent of all; 100 without turns.

    A row with a null turn stands for a session that has none.
    """
    counted = turns.groupBy("session").agg(
        F.count("turn").alias("turns"), F.count_if(F.col("followup")).alias("followups"), F.count_if(F.col("success") & ~F.col("followup")).alias("hits")
    )
    share = F.when(F.col("turns") > 0, F.round(F.col("hits") * 100 / F.col("turns"), 1)).otherwise(100.0)
    return counted.select("session", "turns", "followups", share.alias("one_shot_pct"))


def call_parts(calls: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Mean seconds of each part of a call, and of what no part explains (never below 0)."""
    rest = F.greatest(F.lit(0.0), F.col("total") - sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))
    return calls.groupBy("operation").agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(p, F.lit(0.0))), 6).alias(p) for p in parts], F.round(F.avg(rest), 6).alias("rest"))


def work_map(files: DataFrame, registry: DataFrame) -> DataFrame:
    """(type, files, bytes, done, remaining, remaining_bytes, unchanged): the census by type against what needs no work.

    ``files`` has path, type, size; ``registry`` has path and needs_work.  A
    file is done when it is registered and needs no work.
    """
    known = registry.select("path", F.coalesce("needs_work", F.lit(True)).alias("needs_work"))
    rows = files.join(known, "path", "left").withColumn("done", F.coalesce(~F.col("needs_work"), F.lit(False)))
    left = ~F.col("done")
    return rows.groupBy("type").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if("done").alias("done"), F.count_if(left).alias("remaining"),
        F.coalesce(F.sum(F.when(left, F.col("size"))), F.lit(0)).alias("remaining_bytes"),
    )
