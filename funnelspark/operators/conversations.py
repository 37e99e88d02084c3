"""Turns and sessions of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelspark.functions import text as T


def turn_pairs(messages: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per user message and the assistant message that follows at once: session_id, message_id, question, answer, turn."""
    w = Window.partitionBy(session).orderBy(order)
    m = messages.withColumn("_role", F.lead(role).over(w)).withColumn("_text", F.lead(text).over(w))
    m = m.filter((F.col(role) == "user") & (F.col("_role") == "assistant"))
    sid = F.col(session).cast("string")
    return m.select(sid.alias("session_id"), F.concat_ws(":", sid, F.col(order)).alias("message_id"), F.coalesce(text, F.lit("")).alias("question"), F.coalesce("_text", F.lit("")).alias("answer"), F.col(order).cast("long").alias("turn"))


def session_pos(df: DataFrame, session: str, *order: Column) -> DataFrame:
    """1-based position in the session; nulls of the order come last."""
    return df.withColumn("session_pos", F.row_number().over(Window.partitionBy(session).orderBy(*[c.asc_nulls_last() for c in order])).cast("long"))


def featurise(turns: DataFrame, positive: list[str], negative: list[str], negators: list[str], aliases: dict[str, str]) -> DataFrame:
    """Turn features: intent, stage and its index, sentiments, mentioned, unsolicited and endorsed names, word counts."""
    stage = T.classify_stage(T.stage_scores(F.col("question")))
    names = list(T.vocab.STAGES)
    out = turns.withColumn("intent", T.classify_intent(F.col("question"))).withColumn("funnel_stage", stage)
    out = out.withColumn("funnel_stage_idx", (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("funnel_stage")) - 1).cast("long"))
    for side in ("question", "answer"):
        out = out.withColumn(f"{side}_sentiment", T.lexicon_sentiment(F.col(side), positive, negative, negators)).withColumn(f"{side}_words", T.word_count(F.col(side)).cast("long"))
        out = out.withColumn(f"brands_{side[0]}", T.extract_terms(F.col(side), aliases))
    out = out.withColumn("brands_unsolicited", F.array_except("brands_a", "brands_q")).withColumn("brands_endorsed", F.array_sort(F.array_intersect("brands_a", "brands_q")))
    return out.withColumn("asks_recommendation", F.col("intent") == "purchase")


def rollup(turns: DataFrame) -> DataFrame:
    """One row per session of featurised turns with session_pos."""
    lists = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("session_pos", "funnel_stage"))), lambda x: x["funnel_stage"])
    return turns.groupBy("session_id").agg(
        F.count("*").alias("n_turns"),
        F.min_by("intent", "session_pos").alias("first_intent"),
        F.mode("intent", True).alias("dominant_intent"),
        F.bround(F.avg("question_sentiment"), 4).alias("mean_question_sentiment"),
        F.bround(F.avg("answer_sentiment"), 4).alias("mean_answer_sentiment"),
        F.bround(F.max_by("question_sentiment", "session_pos") - F.min_by("question_sentiment", "session_pos"), 4).alias("sentiment_trend"),
        F.bround(F.avg(F.col("asks_recommendation").cast("double")), 4).alias("asks_recommendation_share"),
        F.max("funnel_stage_idx").alias("max_funnel_stage_idx"),
        F.array_distinct(in_order).alias("journey_path"),
        lists("brands_q").alias("brands_q"),
        lists("brands_a").alias("brands_a"),
        F.sum(F.size("brands_unsolicited")).alias("n_unsolicited_recommendations"),
        F.sum("question_words").alias("question_words"),
        F.sum("answer_words").alias("answer_words"),
    )
