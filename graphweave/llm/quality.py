"""Quality rules by weak supervision: rules vote or abstain, and the posterior probability decides.

Everything is DataFrame and SQL functions; the text is read once, for the counts of each document,
and the votes, their fit and the posterior come from that narrow table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.llm import weak
from graphweave.llm.common import store

BLANK = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Positions whose 3-word window stands in the text more than once; h are the windows' hashes. Sorting
#: puts equal windows side by side, in n log n; most texts have none and skip it.
_REPEATED = """
aggregate(
  transform(array(sort_array(transform(
    filter(transform(array(sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))), s ->
      transform(s, (x, k) -> named_struct('i', x.i, 'twice', coalesce(x.h = get(s, k + 1).h, false) OR coalesce(x.h = get(s, k - 1).h, false))))[0],
      y -> y.twice),
    y -> y.i))), p -> transform(p, (v, k) -> least(3, coalesce(get(p, k + 1) - v, 3))))[0],
  0L, (total, v) -> total + v)
"""

#: All counts of one text t (not null). w: its words; h: hashes of its 3-word windows.
_COUNTS = f"""
transform(array(array_remove(split(t, r'{BLANK}', -1), '')), w -> named_struct(
  'n_words', CAST(size(w) AS BIGINT),
  'word_chars', CAST(length(translate(t, '{WHITE}', '')) AS BIGINT),
  'n_repeat_words', CASE WHEN size(w) < 4 THEN 0L ELSE
    transform(array(transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2)))), h ->
      CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {_REPEATED} END)[0] END
))[0]
"""


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with a struct column gw_counts beside theirs."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select("*", text.alias("gw_text"))
    sql = _COUNTS.replace("(t,", "(gw_text,")
    lines = F.filter(F.split("gw_text", "\n", -1), lambda x: F.translate(x, WHITE, "") != "")
    no_symbols = F.translate("gw_text", SYMBOLS, "")
    return df.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.struct(
            F.expr(sql).alias("words"),
            (F.length("gw_text") - F.length(no_symbols)).cast("long").alias("n_symbols"),
            F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
            F.size(F.split("gw_text", "\n", -1)).cast("long").alias("n_lines"),
            F.length(F.regexp_replace("gw_text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            F.length(F.regexp_replace("gw_text", r"[\P{L}]+", "")).cast("long").alias("n_letters"),
        ).alias("gw_counts"),
    )


def votes(c: Column) -> dict[str, Column]:
    """The rules: 1 for good, -1 for bad, 0 where a rule has nothing to say."""

    def rule(bad: Column, good: Column | None = None) -> Column:
        vote = F.when(bad, -1)
        return (vote if good is None else vote.when(good, 1)).otherwise(0)

    w = c["words"]
    words = F.greatest(w["n_words"], F.lit(1))
    mean, letters = w["word_chars"] / words, F.greatest(c["n_letters"], F.lit(1))
    return {
        "length": rule(w["n_words"] < 20, w["n_words"] >= 200),
        "word_length": rule((mean < 2.5) | (mean > 15)),
        "symbols": rule(c["n_symbols"] > 0.2 * words, c["n_symbols"] * 100 <= words),
        "repeated_lines": rule(c["n_dup_lines"] > 0.3 * c["n_lines"]),
        "repeated_words": rule(w["n_repeat_words"] > 0.3 * words),
        "letters": rule(c["n_letters"] < 0.8 * w["word_chars"], c["n_letters"] > 0.9 * w["word_chars"]),
        "capitals": rule(c["n_upper"] > 0.4 * letters),
    }


def score(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Counts, votes and the posterior quality of every row: the columns `keep` and one struct gw.

    The model is fitted on the vote patterns of all rows. gw holds the counts, base_failed, the
    posterior and kept. A null text counts as empty, a text without words fails; repeated rows are
    scored each; columns of docs may have any names but gw, gw_counts, gw_text. An empty table gives
    an empty table. Kept columns pass through the shared table, so a stage can carry its texts along.
    """
    seen = store(counts(docs, text_col).select(*(F.col(f"`{c}`") for c in keep or []), "gw_counts"), "quality")
    rules = votes(F.col("gw_counts"))
    seen_patterns = seen.select(*(v.alias(k) for k, v in rules.items())).groupBy(*rules).count().collect()
    model = weak.fit([(r[:-1], r[-1]) for r in seen_patterns], len(rules))
    words = F.col("gw_counts.words")
    failed = (words["n_words"] < 50) | (100 * words["n_repeat_words"] > 50 * words["n_words"])
    quality = model.posterior_column(list(rules.values()))
    return seen.select(
        *(F.col(f"`{c}`") for c in keep or []),
        F.struct(
            words["n_words"].alias("n_words"), words["word_chars"].alias("word_chars"), F.col("gw_counts.n_symbols").alias("n_symbols"),
            F.col("gw_counts.n_dup_lines").alias("n_dup_lines"), words["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"), (~failed & (quality >= threshold)).alias("kept"), quality.alias("quality"),
        ).alias("gw"),
    )
