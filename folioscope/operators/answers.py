"""Quality of generated answers: citations, judged correctness, agreement with people, grading sheets, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.bm25 import tokens
from folioscope.operators.guards import require_empty


def citations(cited: Column, context: Column) -> Column:
    """Struct ``kept, dropped, validity``: distinct cited ids in order, split by whether the context has them; validity is 1 where nothing is cited. Nulls are empty lists."""
    none = F.array().cast("array<string>")
    once, there = F.array_distinct(F.coalesce(cited, none)), F.coalesce(context, none)
    kept = F.filter(once, lambda x: F.array_contains(there, x))
    validity = F.when(F.size(once) == 0, 1.0).otherwise(F.size(kept) / F.size(once))
    return F.struct(kept.alias("kept"), F.array_except(once, there).alias("dropped"), validity.alias("validity"))


def cited_pages(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """``grade_id, cited_pages``: the pages of the kept citations as ``doc p.N; doc p.M``, each once, in the order cited.

    ``chunks`` is unique in ``chunk_id``; a citation of an unknown chunk has no page. Answers without pages have ''.
    """
    kept = answers.select("grade_id", F.posexplode_outer(citations(F.col("cited_ids"), F.col("context_ids"))["kept"]).alias("at", "chunk_id"))
    paged = kept.join(chunks.select("chunk_id", "doc_id", "page_num"), "chunk_id", "left")
    first = paged.groupBy("grade_id", "doc_id", "page_num").agg(F.min("at").alias("at"))
    entry = F.when(F.col("doc_id").isNotNull(), F.struct("at", F.format_string("%s p.%d", "doc_id", "page_num").alias("page")))
    return first.groupBy("grade_id").agg(F.array_sort(F.collect_list(entry)).alias("p")).select("grade_id", F.array_join(F.transform("p", lambda x: x["page"]), "; ").alias("cited_pages"))


def cited_texts(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """``grade_id, chunk_id, at``: the context chunks that lie on a cited page, in the context's order; a page may give several."""
    page = chunks.select("chunk_id", "doc_id", "page_num")
    context = answers.select("grade_id", F.posexplode("context_ids").alias("at", "chunk_id")).groupBy("grade_id", "chunk_id").agg(F.min("at").alias("at")).join(page, "chunk_id")
    cited = answers.select("grade_id", F.explode(citations(F.col("cited_ids"), F.col("context_ids"))["kept"]).alias("chunk_id")).join(page, "chunk_id")
    return context.join(cited.select("grade_id", "doc_id", "page_num").distinct(), ["grade_id", "doc_id", "page_num"], "left_semi").select("grade_id", "chunk_id", "at")


def faithfulness(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """``grade_id, faithfulness`` without a model: the share of an answer's distinct terms that the chunks it cites have, at six decimals; 0 where it cites none that its context has.

    ``answers`` has ``grade_id, generated_answer, cited_ids, context_ids``, unique in ``grade_id``; ``chunks`` is unique in ``chunk_id``. An answer without terms has 0.
    """
    said = answers.select("grade_id", F.array_distinct(tokens(F.col("generated_answer"))).alias("said"), citations(F.col("cited_ids"), F.col("context_ids"))["kept"].alias("kept"))
    terms = said.select("grade_id", F.explode("said").alias("term"))
    shown = said.select("grade_id", F.explode("kept").alias("chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id")
    shown = shown.select("grade_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    found = terms.join(shown, ["grade_id", "term"], "left_semi").groupBy("grade_id").agg(F.count("*").alias("n"))
    share = F.when(F.size("said") > 0, F.round(F.coalesce("n", F.lit(0)) / F.size("said"), 6)).otherwise(0.0)
    return said.join(found, "grade_id", "left").select("grade_id", share.alias("faithfulness"))


def tier2_report(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, group, n, correct_pct, incorrect_pct, refused_pct, mean_citation_validity, mean_faithfulness, scored, uncited, prompt_tokens, completion_tokens``, overall and by answer type.

    ``records`` has ``answer_type, verdict, refused, uncited, citation_validity, faithfulness, prompt_tokens, completion_tokens``.
    Percentages are of all records; citation validity and faithfulness are of those that aren't refusals, where an answer that cites nothing, or
    whose faithfulness is not known, counts as 0.
    """
    own = F.explode(F.array(F.lit("overall"), F.col("answer_type"))).alias("group")
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 1)
    answered = ~F.coalesce(F.col("refused"), F.lit(False))
    return (
        records.select("*", own)
        .groupBy(*by, "group")
        .agg(
            F.count("*").alias("n"),
            pct(F.col("verdict") == "correct").alias("correct_pct"),
            pct(F.col("verdict") == "incorrect").alias("incorrect_pct"),
            pct(F.coalesce(F.col("refused"), F.lit(False))).alias("refused_pct"),
            F.round(F.avg(F.when(answered, F.col("citation_validity"))), 4).alias("mean_citation_validity"),
            F.round(F.avg(F.when(answered, F.when(F.col("uncited"), 0.0).otherwise(F.coalesce("faithfulness", F.lit(0.0))))), 4).alias("mean_faithfulness"),
            F.count_if(answered).alias("scored"),
            F.count_if(F.col("uncited") & answered).alias("uncited"),
            F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
            F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        )
    )


VERDICTS = ("correct", "incorrect", "refused")


def agreement(sheet: DataFrame, judged: DataFrame) -> DataFrame:
    """One row of how human and judge agree: ``n, agreement, kappa``, the four counts, ``disagreements, refused, ungraded``.

    ``sheet`` has ``grade_id, answer_hash, human_verdict``, ``judged`` ``grade_id, answer_hash, verdict``. Blank
    verdicts count as ungraded, refusals apart. A verdict of another word, a row that the judge lacks and an
    answer that changed since raise. Without graded rows agreement and kappa are 0; where chance
    alone agrees fully, kappa is 1 if they do and else 0.
    """
    human = F.lower(F.trim(F.coalesce("human_verdict", F.lit(""))))
    rows = sheet.select("grade_id", "answer_hash", human.alias("human"))
    require_empty(rows.where(~F.col("human").isin("", *VERDICTS)), "verdicts are not valid")
    joined = rows.join(judged.select("grade_id", F.col("answer_hash").alias("judged_hash"), F.col("verdict").alias("judge")), "grade_id", "left")
    graded = joined.where(F.col("human").isin("correct", "incorrect"))
    require_empty(graded.where("judge IS NULL"), "graded answers have no judgement")
    require_empty(graded.where(~F.col("answer_hash").eqNullSafe(F.col("judged_hash"))), "answers changed since they were graded")
    is_ = lambda h, j: F.count_if((F.col("human") == h) & (F.col("judge") == j))
    counts = joined.agg(
        is_("correct", "correct").alias("correct_correct"),
        is_("correct", "incorrect").alias("correct_incorrect"),
        is_("incorrect", "correct").alias("incorrect_correct"),
        is_("incorrect", "incorrect").alias("incorrect_incorrect"),
        F.count_if(F.col("human") == "refused").alias("refused"),
        F.count_if(F.col("human") == "").alias("ungraded"),
    )
    cc, ci, ic, ii = (F.col(c) for c in ("correct_correct", "correct_incorrect", "incorrect_correct", "incorrect_incorrect"))
    n = cc + ci + ic + ii
    po, pe = (cc + ii) / n, ((cc + ci) * (cc + ic) + (ic + ii) * (ci + ii)) / (n * n)
    kappa = F.when(n == 0, 0.0).when(pe >= 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return counts.select(n.alias("n"), F.when(n == 0, 0.0).otherwise(F.round(po, 6)).alias("agreement"), F.round(kappa, 6).alias("kappa"), "correct_correct", "correct_incorrect", "incorrect_correct", "incorrect_incorrect", (ci + ic).alias("disagreements"), "refused", "ungraded")


def grading_sheet(records: DataFrame) -> DataFrame:
    """``grade_id, qid, answer_type, question, gold_answer, generated_answer, cited_pages, answer_hash, human_verdict``: the sheet to grade, refusals filled in, the judge's verdicts left out."""
    verdict = F.when(F.coalesce("refused", F.lit(False)), "refused").otherwise("")
    return records.select("grade_id", "qid", "answer_type", "question", "gold_answer", "generated_answer", "cited_pages", F.sha2("generated_answer", 256).alias("answer_hash"), verdict.alias("human_verdict"))


def latency(samples: DataFrame, stage: str, millis: str, *, bins: int = 4096) -> DataFrame:
    """``stage, n, p50, p95``, exact, interpolated linearly, two decimals; NaN counts as no sample.

    Each stage's range is cut into ``bins`` of equal width and counted, which tasks do before the shuffle; only the samples in the bins that hold the
    ranks on both sides of a percentile are then put in order. Where most samples have one value, equal ones are counted as one row.
    """
    rows = samples.where(F.col(millis).isNotNull() & ~F.isnan(millis)).select(F.col(stage).alias("_stage"), F.col(millis).cast("double").alias("_v"))
    ends = rows.groupBy("_stage").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))  # a row for each stage
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(0).cast("int")
    same = F.col("_stage").eqNullSafe(F.col("_own"))
    binned = rows.join(ends.withColumnRenamed("_stage", "_own"), same).withColumn("_bin", place).drop("_own")
    counts = binned.groupBy("_stage", "_n", "_bin").agg(F.count("*").alias("_c"))
    below = counts.withColumn("_below", F.sum("_c").over(Window.partitionBy("_stage").orderBy("_bin")) - F.col("_c"))  # over a stage's bins
    ranks = [F.floor((F.col("_n") - 1) * q) + d for q in (0.5, 0.95) for d in (0, 1)]
    holds = F.exists(F.array(*ranks), lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_c")))
    wanted = below.where(holds).select(F.col("_stage").alias("_own"), F.col("_bin").alias("_b"), "_below")
    values = binned.join(wanted, same & (F.col("_bin") == F.col("_b"))).groupBy("_stage", "_n", "_bin", "_below", "_v").agg(F.count("*").alias("_c"))
    first = F.col("_below") + F.sum("_c").over(Window.partitionBy("_stage", "_bin").orderBy("_v")) - F.col("_c")
    placed = values.select("_stage", "_n", "_v", first.alias("_first"), "_c")
    at = lambda r: F.max(F.when((r >= F.col("_first")) & (r < F.col("_first") + F.col("_c")), F.col("_v")))
    found = placed.groupBy("_stage", "_n").agg(*[at(r).alias(f"_r{k}") for k, r in enumerate(ranks)])
    between = lambda q, k: F.round(F.col(f"_r{k}") + (F.coalesce(f"_r{k + 1}", f"_r{k}") - F.col(f"_r{k}")) * ((F.col("_n") - 1) * q - F.floor((F.col("_n") - 1) * q)), 2)
    return found.select(F.col("_stage").alias(stage), F.col("_n").alias("n"), between(0.5, 0).alias("p50"), between(0.95, 2).alias("p95"))


def prompt_context(ranked: DataFrame, chunks: DataFrame, top: int) -> DataFrame:
    """``qid, context, context_ids``: the first ``top`` chunks, best first, each as ``[id] (doc, page N)`` and its text, with an empty line between.

    ``top`` bounds what is collected for a question."""
    text = chunks.select("chunk_id", "doc_id", "page_num", "text")
    block = F.concat(F.lit("["), F.col("chunk_id"), F.lit("] ("), F.col("doc_id"), F.lit(", page "), F.col("page_num").cast("string"), F.lit(")\n"), F.coalesce("text", F.lit("")))
    rows = ranked.where(F.col("rank") <= top).select("qid", "rank", "chunk_id").join(text, "chunk_id").select("qid", F.struct("rank", "chunk_id", block.alias("block")).alias("b"))
    listed = rows.groupBy("qid").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return listed.select("qid", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"), F.transform("b", lambda x: x["chunk_id"]).alias("context_ids"))


def judge_keys(records: DataFrame, signature: str) -> DataFrame:
    """``grade_id, judgment_key``: NUL-joined question, gold answer, judge signature, number of cited texts and their ids, hashed; what decides the judgement and nothing else."""
    none = F.array().cast("array<string>")
    kept = citations(F.col("cited_ids"), F.col("context_ids"))["kept"]
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined = F.concat_ws("\x00", part("question"), part("gold_answer"), part("generated_answer"), F.lit(signature), F.size(kept).cast("string"), F.array_join(F.coalesce(kept, none), "\x00"))
    return records.select("grade_id", F.sha2(joined, 256).alias("judgment_key"))


def parse_verdict(reply: Column) -> Column:
    """Struct ``verdict, reason`` of a judge's JSON reply; null unless the verdict is correct or incorrect and the reason a text."""
    read = F.from_json(reply, "verdict string, reason string")
    verdict = F.lower(F.trim(read["verdict"]))
    return F.when(verdict.isin("correct", "incorrect") & read["reason"].isNotNull(), F.struct(verdict.alias("verdict"), read["reason"].alias("reason")))
