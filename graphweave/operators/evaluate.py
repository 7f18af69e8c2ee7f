"""Answer metrics, score roll-ups, catalogues and freshness."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweave.functions import text as X
from graphweave.functions import vocabulary as V


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def answer_score(answer: Column, truth: Column) -> Column:
    """1 for the same text, .8 if the answer holds the truth, .5 if it holds a word of it longer than three, else 0."""
    a, t = F.lower(F.trim(answer)), F.lower(F.trim(truth))
    some = F.exists(F.filter(X.words(t), lambda w: F.length(w) > 3), lambda w: a.contains(w))
    return F.when(a == t, 1.0).when(a.contains(t), 0.8).when(some, 0.5).otherwise(0.0)


def cites(answer: Column, more: bool = False) -> Column:
    return _any([answer.rlike(p) for p in (*V.CITES, *((V.CITES_MORE,) if more else ()))])


def hedges(answer: Column) -> Column:
    return _any([F.lower(answer).contains(p) for p in V.HEDGES])


def metrics(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """One row of answers(question_id, answer, latency_ms, cost_usd): accuracy over known questions, rates over all answers."""
    q = questions.select("question_id", "ground_truth")
    a = answers.join(q, "question_id", "left")
    known = F.when(F.col("ground_truth").isNotNull(), answer_score(F.col("answer"), F.col("ground_truth")))
    share = lambda c: F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    return a.agg(
        F.coalesce(F.avg(known), F.lit(0.0)).alias("accuracy"), share(hedges(F.col("answer")) & ~cites(F.col("answer"))).alias("hallucination_rate"), share(cites(F.col("answer"), True)).alias("citation_rate"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("latency_ms"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.count("*").alias("n"),
    )


def roll_up(scores: DataFrame, passing: int = 7) -> DataFrame:
    """(pack, condition, mean, accuracy, n) of scores(pack, condition, score), with the grand total under pack null."""
    s = scores.groupingSets([["pack", "condition"], ["condition"]], "pack", "condition")
    return s.agg(F.round(F.avg("score"), 4).alias("mean"), F.round(F.avg(F.when(F.col("score") >= passing, 100.0).otherwise(0.0)), 4).alias("accuracy"), F.count("*").alias("n"))


def catalog_summary(scores: DataFrame, first: str, second: str, passing: int = 8) -> DataFrame:
    """One row: packs that each of two conditions wins, ties, and both shares of scores from `passing` on."""
    mean = scores.groupBy("pack").agg(*(F.avg(F.when(F.col("condition") == c, F.col("score"))).alias(n) for c, n in ((first, "a"), (second, "b"))))
    wins = mean.agg(F.count(F.when(F.col("a") > F.col("b"), 1)).alias("first_wins"), F.count(F.when(F.col("b") > F.col("a"), 1)).alias("second_wins"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("ties"))
    rate = scores.agg(*(F.round(F.avg(F.when(F.col("condition") == c, F.when(F.col("score") >= passing, 100.0).otherwise(0.0))), 4).alias(n) for c, n in ((first, "first_accuracy"), (second, "second_accuracy"))))
    return wins.join(rate, F.lit(True))  # one row each


def catalogue(manifests: DataFrame, scores: DataFrame, first: str = "training", second: str = "enhanced", passing: int = 8) -> DataFrame:
    """(pack, articles, entities, relationships, first_accuracy, second_accuracy): every pack with its evaluation, if it has one.

    manifests(pack, articles, entities, relationships); scores(pack, condition, score).
    """
    share = lambda c: F.round(F.avg(F.when(F.col("condition") == c, F.when(F.col("score") >= passing, 100.0).otherwise(0.0))), 4)
    told = scores.groupBy("pack").agg(share(first).alias("first_accuracy"), share(second).alias("second_accuracy"))
    return manifests.select("pack", "articles", "entities", "relationships").join(told, "pack", "left")


def catalogue_totals(entries: DataFrame) -> DataFrame:
    """One row over catalogue(): packs, their sums, how many were evaluated under both conditions, wins of the second and ties."""
    both = F.col("first_accuracy").isNotNull() & F.col("second_accuracy").isNotNull()
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("articles", "entities", "relationships")]
    return entries.agg(F.count("*").alias("packs"), *sums, F.count_if(both).alias("evaluated"), F.count_if(both & (F.col("second_accuracy") > F.col("first_accuracy"))).alias("wins"), F.count_if(both & (F.col("second_accuracy") == F.col("first_accuracy"))).alias("ties"))


def mean_authority(found: DataFrame) -> DataFrame:
    """One row: the mean authority of found(authority), 0 of none."""
    return found.agg(F.round(F.coalesce(F.avg("authority"), F.lit(0.0)), 4).alias("authority"))


def composite(judge: Column, syntax: Column, required: Column, forbidden: Column, constructs: Column, execution: Column) -> Column:
    """Weighted score of a coding task to four places; without an execution result the judge's share stands in."""
    return F.round(0.4 * judge / 10 + 0.15 * syntax + 0.15 * required + 0.1 * forbidden + 0.1 * constructs + 0.1 * F.coalesce(execution, judge / 10), 4)


def condition_summary(results: DataFrame, passing: int = 7) -> DataFrame:
    """By condition: means and shares, to the places of the report."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 2)
    return results.groupBy("condition").agg(
        F.round(F.avg("judge"), 2).alias("judge"), F.round(F.avg("composite"), 4).alias("composite"), share(F.col("syntax_ok")).alias("syntax_rate"), share(F.col("judge") >= passing).alias("pass_rate"),
        F.round(F.avg("latency"), 0).alias("latency"), F.round(F.sum("cost"), 4).alias("cost"), F.round(F.avg("tool_calls"), 1).alias("tool_calls"), F.count("*").alias("n"),
    )


def changed(prefix_old: str = "old_", prefix_new: str = "new_") -> Column:
    """Whether a page changed: by its hash where both have one, else its tag, else its date; nothing known is no change."""
    out = F.lit(False)
    for name in ("last_modified", "etag", "hash"):
        old, new = F.col(prefix_old + name), F.col(prefix_new + name)
        out = F.when(old.isNotNull() & new.isNotNull(), old != new).otherwise(out)
    return out


def freshness(checked: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(pack, checked, changed, rate, needs_rebuild) of checked(pack, ok, changed)."""
    n, c = F.count(F.when(F.col("ok"), 1)), F.count(F.when(F.col("ok") & F.col("changed"), 1))
    rate = c / F.greatest(n, F.lit(1))
    return checked.groupBy("pack").agg(n.alias("checked"), c.alias("changed"), rate.alias("rate"), (rate >= threshold).alias("needs_rebuild"))


def question_ids(questions: DataFrame) -> DataFrame:
    """Questions of each pack without repeats in any letters, numbered in order: prefix_001 and on."""
    from pyspark.sql import Window

    first = questions.withColumn("k", F.lower(F.trim(F.col("question")))).groupBy("pack", "k").agg(F.min_by(F.struct("question", "ord"), "ord").alias("q")).select("pack", "q.*")
    n = F.row_number().over(Window.partitionBy("pack").orderBy("ord"))
    return first.select("pack", F.concat(F.lower(F.substring("pack", 1, 2)), F.format_string("_%03d", n)).alias("id"), "question")


def difficulty_counts(total: Column) -> dict[str, Column]:
    """Two fifths easy and medium and one hard, medium taking the rest."""
    easy, hard = F.bround(total * 20 / 50).cast("int"), F.bround(total * 10 / 50).cast("int")
    return {"easy": easy, "medium": (total - easy - hard).cast("int"), "hard": hard}


def question_errors(questions: DataFrame) -> DataFrame:
    """(id, errors): questions(id, question, ground_truth, difficulty) with empty fields, unknown difficulty or a repeated id."""
    repeats = questions.groupBy("id").agg(F.count("*").alias("n"))
    empty = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", f"empty {c}") for c in ("id", "question", "ground_truth")]
    bad = [*empty, F.when(~F.coalesce(F.col("difficulty").isin("easy", "medium", "hard"), F.lit(False)), "unknown difficulty"), F.when(F.col("n") > 1, "repeated id")]
    return questions.join(repeats, "id").select("id", F.array_compact(F.array(*bad)).alias("errors")).where(F.size("errors") > 0)


def code_blocks(output: Column) -> Column:
    return F.regexp_extract_all(output, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1))


def balanced(code: Column) -> Column:
    """Whether brackets of every kind are closed but for one at most."""
    n = lambda c: F.length(code) - F.length(F.replace(code, F.lit(c), F.lit("")))
    return (F.abs(n("(") - n(")")) <= 1) & (F.abs(n("[") - n("]")) <= 1) & (F.abs(n("{") - n("}")) <= 1)


def contains_each(tokens: Column, output: Column) -> Column:
    """struct(token, held) of every token."""
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), output.contains(t).alias("held")))


def _parses(language: str, code: str) -> bool:
    try:
        if language in ("python", "py"):
            compile(code, "answer", "exec", dont_inherit=True)
        elif language == "json":
            json.loads(code)
        else:
            return all(abs(code.count(a) - code.count(b)) <= 1 for a, b in ("()", "[]", "{}"))
    except (SyntaxError, ValueError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def syntax_ok(language: pd.Series, code: pd.Series) -> pd.Series:
    """Whether code parses: by Python's compiler, as JSON, or by its brackets for other languages; nothing is run."""
    return pd.Series([_parses((a or "").lower(), b or "") for a, b in zip(language, code)], dtype=bool)


def validation(tasks: DataFrame) -> DataFrame:
    """(id, syntax, required, forbidden, constructs): shares of each check passed, of tasks(id, language, output,
    must_contain, must_not_contain, expected_constructs). A construct without marks of a pattern is sought as text."""
    code = F.when(F.size(code_blocks(F.col("output"))) > 0, F.array_join(code_blocks(F.col("output")), "\n")).otherwise(F.col("output"))
    share = lambda tokens, test: F.when(F.size(tokens) > 0, F.size(F.filter(tokens, test)) / F.size(tokens)).otherwise(1.0)
    t = tasks.withColumn("code", code)
    sound = lambda c: ~c.rlike(r"[\\^$.|?*+()\[\]{}]")  # noqa: E731  plain words need no pattern
    return t.select(
        "id", F.when(syntax_ok("language", "code"), 1.0).otherwise(0.0).alias("syntax"), share(F.col("must_contain"), lambda x: F.col("output").contains(x)).alias("required"),
        share(F.col("must_not_contain"), lambda x: ~F.col("output").contains(x)).alias("forbidden"), share(F.col("expected_constructs"), lambda c: F.when(sound(c), F.col("code").contains(c)).otherwise(F.regexp_like("code", c))).alias("constructs"),
    )
