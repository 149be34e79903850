"""Conditions from retrieval to accuracy: contexts, prompts, a model's answers, and how many are right."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import format_context, parse_answer
from loomspark.operators import metrics, models, prompts, retrieval
from loomspark.operators.ablation import replacement_profiles
from loomspark.sources import io

PLAIN = "no_rag"


def contexts(docs: DataFrame, questions: DataFrame, k: tuple[int, int, int] = (64, 8, 1), most: int = 4500) -> DataFrame:
    """(condition, q_id, context) of the cascade's last stage over docs (doc_id, text), for questions with q_id, full,
    core, profile."""
    found = retrieval.cascade(docs, questions, k).where("stage = 'final'")
    rows = found.join(docs.select("doc_id", "text"), "doc_id")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])  # at most k[2] a question
    return rows.groupBy("condition", "q_id").agg(format_context(texts, most).alias("context"))


def conditions(docs: DataFrame, questions: DataFrame, k: tuple[int, int, int] = (64, 8, 1)) -> DataFrame:
    """A row for each question and condition, with its context; without retrieval there is none (condition no_rag)."""
    names = questions.sparkSession.createDataFrame([(c,) for c in (PLAIN, *retrieval.CONDITIONS)], "condition string")
    rows = questions.crossJoin(F.broadcast(names))  # five conditions
    return rows.join(contexts(docs, questions, k), ["condition", "q_id"], "left").withColumn("context", F.coalesce("context", F.lit("")))


def run(docs: DataFrame, questions: DataFrame, model: Callable[[list[str]], Iterable[str]], k: tuple[int, int, int] = (64, 8, 1)) -> DataFrame:
    """conditions() with prompt, answer and the letter in it; questions also have question, options, and may have scenario."""
    rows = conditions(docs, questions, k)
    scenario = F.col("scenario") if "scenario" in rows.columns else None
    rows = rows.withColumn("prompt", prompts.mcqa_prompt(F.col("question"), F.col("options"), F.col("context"), F.col("profile"), scenario))
    return models.answered(rows, "prompt", "answer", model).withColumn("predicted", parse_answer(F.col("answer")))


def report(answers: DataFrame, correct: str = "correct_answer", population: str = "target_population") -> DataFrame:
    """Accuracy by population of each condition, in the order of conditions."""
    out = None
    for c in (PLAIN, *retrieval.CONDITIONS):
        part = metrics.accuracy(answers.where(F.col("condition") == c), "predicted", correct, population).select(F.lit(c).alias("condition"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def with_trajectories(questions: DataFrame, found: DataFrame, docs: DataFrame, condition: str, k: tuple[int, int, int], backend: str = "bm25") -> DataFrame:
    """questions (q_id, ...) with what a condition of the cascade found: retrieval_trajectory, and the texts of its stages in
    candidate_texts, middle_texts and retrieved_texts. docs has doc_id, text and maybe metadata (a map of texts)."""
    metadata = F.col("metadata") if "metadata" in docs.columns else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    texts = docs.select("doc_id", "text", metadata.alias("metadata"))
    rows = found.where(F.col("condition") == condition).join(texts, "doc_id")
    one = F.struct("rank", F.col("doc_id").alias("corpus_index"), "score", "text", "metadata")
    by_rank = F.array_sort(F.collect_list(one), lambda a, b: F.when(a["rank"] < b["rank"], -1).otherwise(1))
    staged = rows.groupBy("q_id", "stage").agg(by_rank.alias("documents"))  # at most k
    first, middle, final = retrieval.CONDITIONS[condition]
    kinds = {"initial": first, "middle": middle, "final": final or middle}
    out = questions
    parts = []
    for n, stage in enumerate(kinds):
        had = staged.where(F.col("stage") == stage).select("q_id", F.col("documents").alias(f"_{stage}"))
        out = out.join(had, "q_id", "left")
        documents = F.coalesce(F.col(f"_{stage}"), F.array().cast(had.schema[f"_{stage}"].dataType))
        info = [F.lit(kinds[stage]).alias("query_kind"), F.col(kinds[stage]).alias("query"), F.lit(k[n]).cast("long").alias("requested_k")]
        parts.append(F.struct(*info, F.lit(stage == "final" and final is not None).alias("reranked"), documents.alias("documents")).alias(stage))
    out = out.withColumn("retrieval_trajectory", F.struct(F.lit(condition).alias("condition"), F.lit(backend).alias("backend"), *parts))
    named = {"candidate_texts": "initial", "middle_texts": "middle", "retrieved_texts": "final"}
    return out.withColumns({c: F.transform(F.col("retrieval_trajectory")[s]["documents"], lambda d: d["text"]) for c, s in named.items()}).drop(*[f"_{s}" for s in kinds])


def ablation(
    questions: DataFrame,
    docs: DataFrame,
    folder: str,
    command: str,
    names: list[str],
    model: Callable[[list[str]], Iterable[str]],
    facts: dict[str, str],
    index: retrieval.Postings | None = None,
    k: tuple[int, int, int] = (64, 8, 1),
    most: int = 4500,
    seed: int = 42,
    limit: int = 120,
    skip_existing: bool = False,
) -> DataFrame:
    """Accuracy of each condition of an ablation, one row a condition, which is also put into the folder's metrics.

    "ranking" takes conditions of the cascade with the questions' own profiles, "profile" the condition prof_rag with
    profiles replaced as each name says. questions has q_id, full, core, profile, question, options, correct_answer and
    target_population; facts name corpus, model and dataset. A condition's result is written under them; one that is there
    is taken if it fits and skip_existing is set, and is an error else.
    """
    if command not in ("ranking", "profile"):
        raise ValueError(f"unknown ablation {command}")
    spark, out = questions.sparkSession, None
    n = questions.count()
    for name in names:
        path = io.result_path(f"{folder.rstrip('/')}/{command}", name, *facts.values())
        if io.exists(spark, path) and not skip_existing:
            raise FileExistsError(f"{path} already exists")

        def build(name=name):
            rows = questions.withColumn("ablation_profile", F.col("profile"))
            if command == "profile":
                rows = replacement_profiles(questions, name, "q_id", "target_population", "profile", seed, limit).withColumnRenamed("new_profile", "ablation_profile")
            rows = retrieval.written(rows)
            condition = name if command == "ranking" else "prof_rag"
            asked = rows.withColumn("profile", F.col("ablation_profile"))
            found = retrieval.cascade(docs, asked, k, index, {condition: retrieval.CONDITIONS[condition]})
            got = with_trajectories(asked, found, docs, condition, k)
            context = format_context(F.col("retrieved_texts"), most)
            got = got.withColumn("_prompt", prompts.mcqa_prompt(F.col("question"), F.col("options"), context))
            got = models.answered(got, "_prompt", "_answer", model)
            return got.withColumn("ablation_answer", parse_answer(F.col("_answer"))).drop("_prompt", "_answer")

        result = io.result_or(spark, path, n, ["ablation_answer"], build)
        said = metrics.accuracy(result, "ablation_answer", "correct_answer", "target_population")
        wide = said.groupBy().agg(
            *[F.max(F.when(F.col("population") == p, F.col(c))).alias(c if p == "All" else f"{c}_{p.lower()}") for p in ("All", *metrics.POPULATIONS) for c in ("n", "correct", "unparsed", "accuracy") if p == "All" or c in ("n", "accuracy")]
        )  # four rows
        row = wide.select(F.lit(command).alias("ablation"), F.lit(name).alias("condition"), *[F.lit(v).alias(c) for c, v in facts.items()], "*")
        out = row if out is None else out.unionByName(row)
    out = retrieval.written(out)
    place = f"{folder.rstrip('/')}/{command}/metrics.parquet"
    old = spark.read.parquet(place) if io.exists(spark, place) else out.limit(0)
    io.write_table(retrieval.written(metrics.upsert(old, out, ["ablation", "condition", *facts])), place, overwrite=True)
    return out
