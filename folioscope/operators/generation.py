"""Model calls, given from outside, behind content-addressed caches: answers to questions and judgements of answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.hashing import joined_key
from folioscope.operators import caches
from folioscope.operators.answers import citations, judge_keys, parse_verdict

#: (prompt) -> reply; runs on the executors, once for each key that the cache lacks.
Model = Callable[[str], str]

PROMPT = "Answer from these excerpts alone and name the ids of those you use.\n\n{context}\n\nWhat is asked: {question}"


class QuotaExhausted(RuntimeError):
    """The model takes no more calls for now; what was answered before is in the cache."""


def retrying(model: Model, *, attempts: int = 5, wait: float = 1.0, longest: float = 60.0, exhausted: tuple[type[Exception], ...] = (QuotaExhausted,), sleep: Callable[[float], None] = time.sleep) -> Model:
    """``model`` called again after a failure, each time after twice the wait, ``attempts`` times at most; an error in ``exhausted`` stops at once."""

    def call(prompt: str) -> str:
        for attempt in range(attempts):
            try:
                return model(prompt)
            except exhausted:
                raise
            except Exception:
                if attempt + 1 == attempts:
                    raise
                sleep(min(longest, wait * 2**attempt))
        raise ValueError("attempts must be at least 1")

    return call


def _called(keyed: DataFrame, key: str, model: Model) -> DataFrame:
    """``key, reply`` of every row's ``prompt``; a call that fails stops the run, and what the cache has stays."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "reply": [model(p) for p in pdf["prompt"]]})

    return keyed.select(key, "prompt").mapInPandas(call, f"{key} string, reply string")


def generate(questions: DataFrame, contexts: DataFrame, cache: DataFrame, model: Model, signature: str) -> tuple[DataFrame, DataFrame]:
    """(answers, additions to the cache). ``contexts`` is ``qid, context, context_ids``; ``cache`` is ``generation_key, reply``.

    The key hashes the question, the model's signature and the context's ids in order. A reply is JSON with
    ``answer, citations, insufficient_evidence``; one that can't be read gives nulls. Citations that the context lacks are
    dropped. Additions are to be written before answers are used a second time, or the model is called again.
    """
    asked = questions.select("qid", "question").join(contexts, "qid")
    keyed = asked.withColumn("generation_key", joined_key(F.col("question"), F.lit(signature), F.array_join("context_ids", "\x00")))
    prompt = F.replace(F.replace(F.lit(PROMPT), F.lit("{context}"), F.col("context")), F.lit("{question}"), F.coalesce("question", F.lit("")))
    known, added = caches.through_cache(keyed.withColumn("prompt", prompt), cache.select("generation_key", "reply"), "generation_key", lambda miss: _called(miss, "generation_key", model))
    read = F.from_json("reply", "answer string, citations array<string>, insufficient_evidence boolean")
    answered = keyed.join(known.withColumn("r", read), "generation_key").withColumn("c", citations(F.col("r.citations"), F.col("context_ids")))
    return answered.select("qid", "question", F.col("r.answer").alias("text"), F.col("c.kept").alias("cited_ids"), F.col("c.dropped").alias("dropped"), F.col("c.validity").alias("citation_validity"), "context_ids", F.col("r.insufficient_evidence").alias("insufficient_evidence")), added


def judge(records: DataFrame, cache: DataFrame, model: Model, signature: str) -> tuple[DataFrame, DataFrame]:
    """(``grade_id, verdict, reason, faithfulness``, additions to the cache): judgements of the answers that aren't refusals.

    A reply is JSON with ``verdict``, ``reason`` and, if the model was shown the cited texts, ``faithfulness`` from 0 to 1; an answer
    without a citation that holds has 0 whatever the reply says.

    ``records`` has ``grade_id, question, gold_answer, generated_answer, cited_ids, context_ids, refused``; ``cache`` is
    ``judgment_key, reply``. Only the reply is cached; whatever follows from the record is computed again. A reply that can't be read gives a null verdict.
    """
    open_ = records.where(~F.coalesce("refused", F.lit(False)))
    keyed = open_.join(judge_keys(open_, signature), "grade_id")
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    prompt = F.concat(F.lit("Question: "), part("question"), F.lit("\nReference: "), part("gold_answer"), F.lit("\nAnswer: "), part("generated_answer"))
    known, added = caches.through_cache(keyed.withColumn("prompt", prompt), cache.select("judgment_key", "reply"), "judgment_key", lambda miss: _called(miss, "judgment_key", model))
    read = known.withColumn("v", parse_verdict(F.col("reply"))).withColumn("f", F.from_json("reply", "faithfulness double")["faithfulness"])
    cited = F.size(citations(F.col("cited_ids"), F.col("context_ids"))["kept"]) > 0
    judged = keyed.select("grade_id", "judgment_key", cited.alias("cited")).join(read, "judgment_key")
    return judged.select("grade_id", F.col("v.verdict").alias("verdict"), F.col("v.reason").alias("reason"), F.when(F.col("cited"), F.col("f")).otherwise(0.0).alias("faithfulness")), added
