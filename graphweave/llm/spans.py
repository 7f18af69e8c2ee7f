"""Regex matches with their positions, and work on lists of spans, in SQL expressions only.

Spark has no function that gives positions. Splitting a text at a pattern gives what stands between
the matches, and extracting gives the matches; adding up both lengths gives every start, in code
points, end exclusive. Patterns must never match the empty string. Texts without a match pay one
search.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "STRUCT<start: BIGINT, end: BIGINT, hit: STRING, part: STRING, before: STRING>"


#: Matches are added up in runs of so many, then the runs, so that no array is copied at every match.
RUN = 64


def matches(text: str, pattern: str, group: int = 0, context: int = 0) -> Column:
    """array<SPAN> of all leftmost, non-overlapping matches in the column named `text` (not null).

    hit is the match, part its group, before up to `context` code points between it and the match before.
    """
    t, p = f"`{text}`", "r\"" + pattern + "\""
    before = f"right(x.`0`, {context})" if context else "''"
    parts = f"split({t}, {p}, -1), regexp_extract_all({t}, {p}, 0)" + (f", regexp_extract_all({t}, {p}, {group})" if group else "")
    part, long = "x.`2`" if group else "x.`1`", "length(x.`0`) + coalesce(length(x.`1`), 0)"
    added = f"""aggregate(run, named_struct('at', at, 'out', CAST(array() AS ARRAY<{SPAN}>)),
        (a, x) -> named_struct('at', a.at + {long}, 'out', CASE WHEN x.`1` IS NULL THEN a.out ELSE concat(a.out, array(named_struct(
          'start', a.at + length(x.`0`), 'end', a.at + {long}, 'hit', x.`1`, 'part', {part}, 'before', {before}))) END), a -> a.out)"""
    return F.expr(f"""
      CASE WHEN {t} RLIKE {p} THEN transform(array(arrays_zip({parts})), every ->
        CASE WHEN size(every) <= {RUN} THEN transform(array(struct(every AS run, 0L AS at)), r -> transform(array(r.run), run -> transform(array(r.at), at -> {added})[0])[0])[0]
        ELSE transform(array(transform(sequence(0, (size(every) - 1) div {RUN}), k -> slice(every, CAST(k * {RUN} + 1 AS INT), {RUN}))), runs ->
          flatten(zip_with(runs,
            aggregate(transform(runs, run -> aggregate(run, 0L, (n, x) -> n + {long})), array(0L), (o, n) -> concat(o, array(element_at(o, -1) + n))),
            (run, at) -> CASE WHEN run IS NULL THEN CAST(array() AS ARRAY<{SPAN}>) ELSE {added} END)))[0] END)[0]
      ELSE CAST(array() AS ARRAY<{SPAN}>) END""")


def joined(spans: Column) -> Column:
    """kind:start:end of array<struct<kind, start, end>>, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def by_start(spans: Column) -> Column:
    """Sorted by start, then rank, then end; of array<struct<kind, rank, start, end>>."""
    return F.transform(
        F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end")),
    )


def by_rank(spans: Column) -> Column:
    """Sorted by rank, then start, then end."""
    return F.transform(
        F.sort_array(F.transform(spans, lambda x: F.struct(x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end")),
    )


def masked(text: str, spans: str) -> Column:
    """The text in column `text` with every span of column `spans` replaced by its kind in square brackets.

    Spans that overlap one already replaced lose the overlapping part and add no second mark: chains
    of overlapping spans, which are rare, are joined first. The text is cut at runs of spans, and each
    part at its spans, so that a long text isn't walked once for every span.
    """
    kept = "named_struct('start', x.start, 'end', x.end, 'kind', x.kind)"
    joined = f"""aggregate(s, named_struct('at', 0L, 'out', CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT, kind: STRING>>)),
        (a, x) -> named_struct('at', greatest(a.at, x.end), 'out', CASE WHEN x.start >= a.at OR size(a.out) = 0 THEN concat(a.out, array({kept}))
          ELSE concat(slice(a.out, 1, size(a.out) - 1), array(named_struct('start', element_at(a.out, -1).start, 'end', greatest(a.at, x.end), 'kind', element_at(a.out, -1).kind))) END), a -> a.out)"""
    mark = lambda whole, at: f"concat(substring({whole}, CAST(CASE WHEN i = 0 THEN 0 ELSE run[i - 1].end - {at} END + 1 AS INT), CAST(x.start - CASE WHEN i = 0 THEN {at} ELSE run[i - 1].end END AS INT)), '[', upper(x.kind), ']')"
    return F.expr(f"""
      CASE WHEN size(`{spans}`) = 0 THEN `{text}` ELSE
        transform(transform(array(sort_array(transform(`{spans}`, x -> {kept}))), s ->
          CASE WHEN exists(transform(s, (x, i) -> i > 0 AND x.start < s[greatest(i, 1) - 1].end), y -> y) THEN {joined} ELSE s END),
        s -> concat(
          array_join(transform(sequence(0, (size(s) - 1) div {RUN}), k ->
            transform(array(named_struct('run', slice(s, CAST(k * {RUN} + 1 AS INT), {RUN}), 'at', CASE WHEN k = 0 THEN 0L ELSE s[CAST(k * {RUN} AS INT) - 1].end END)), r ->
              transform(array(named_struct('run', r.run, 'at', r.at, 'part', substring(`{text}`, CAST(r.at + 1 AS INT), CAST(element_at(r.run, -1).end - r.at AS INT)))), q ->
                array_join(transform(array(q.run), run -> array_join(transform(run, (x, i) -> {mark("q.part", "q.at")}), '')), ''))[0])[0]), ''),
          substring(`{text}`, CAST(element_at(s, -1).end + 1 AS INT))))[0] END""")
