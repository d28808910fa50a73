"""The chain of parsers: the cheapest first, then whom the quality gate asks for.

A document's way through the chain is a small state, and what a parser gave
moves it on, as Column expressions.  ``resolve`` plays the way over given
outcomes; ``parse`` takes it in rounds, each of which reads only the documents
that are not done, by the parser that is their turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import quality
from leafmill.functions.quality import QualityConfig
from leafmill.scratch import Scratch
from leafmill.sources import parsers

OUTCOME = "struct<parser:string,ok:boolean,quality:double,escalate_to:string,unrecoverable:boolean,reason:string,error:string>"
_FAILURE = "struct<parser:string,error:string>"


def start(candidates: Column) -> Column:
    """The state of a document that ``candidates``, the cheapest first, may read."""
    return F.struct(
        candidates.alias("candidates"),
        F.array().cast("array<string>").alias("tried"),
        F.get(candidates, F.lit(0)).alias("turn"),
        F.lit(False).alias("escalating"),
        F.lit(None).cast(OUTCOME).alias("best"),
        F.lit(None).cast(_FAILURE).alias("failure"),
        F.lit(None).cast("string").alias("unmet"),
    )


def advance(state: Column, outcome: Column) -> Column:
    """The state after the parser whose turn it was gave ``outcome``.

    A failure hands on to the next candidate, unless the gate had asked for the
    parser: then the way ends.  A success is kept if it is the best so far, and
    hands on to the parser that the gate asks for, if it takes the file and has
    not had its turn.
    """
    ok = F.coalesce(outcome["ok"], F.lit(False))
    tried = F.array_append(state["tried"], state["turn"])
    rest = F.array_except(state["candidates"], tried)
    asked = F.when(F.array_contains(rest, outcome["escalate_to"]), outcome["escalate_to"])
    better = ok & (state["best"].isNull() | (outcome["quality"] > state["best"]["quality"]))
    failure = F.struct(state["turn"].alias("parser"), outcome["error"].alias("error"))
    return F.struct(
        state["candidates"].alias("candidates"),
        tried.alias("tried"),
        F.when(ok, asked).when(~state["escalating"], F.get(rest, F.lit(0))).alias("turn"),
        F.when(ok, asked.isNotNull()).otherwise(state["escalating"]).alias("escalating"),
        F.when(better, outcome).otherwise(state["best"]).cast(OUTCOME).alias("best"),
        F.coalesce(state["failure"], F.when(~ok, failure)).cast(_FAILURE).alias("failure"),
        F.coalesce(F.when(~ok & state["escalating"], outcome["error"]), state["unmet"]).alias("unmet"),
    )


def final(state: Column) -> Column:
    """struct(parser, status, quality, error): ``degraded`` where the gate found
    damage that stays, or its wish was not met by the best outcome."""
    best, failure = state["best"], state["failure"]
    wish = F.concat(F.lit("escalation to "), best["escalate_to"], F.lit(" for "), best["reason"], F.lit(" gave nothing better"))
    unmet = F.concat(wish, F.coalesce(F.concat(F.lit(": "), state["unmet"]), F.lit("")))
    made = lambda parser, status, value, error: F.struct(
        parser.cast("string").alias("parser"), F.lit(status).alias("status"), value.cast("double").alias("quality"), error.cast("string").alias("error")
    )
    none, zero = F.lit(None), F.lit(0.0)
    return (
        F.when(F.size(state["candidates"]) == 0, made(none, "failed", zero, F.lit("no parser can handle the file")))
        .when(best.isNull(), made(failure["parser"], "failed", zero, failure["error"]))
        .when(best["unrecoverable"], made(best["parser"], "degraded", best["quality"], best["reason"]))
        .when(best["escalate_to"].isNull() | (best["escalate_to"] == best["parser"]), made(best["parser"], "ok", best["quality"], none))
        .otherwise(made(best["parser"], "degraded", best["quality"], unmet))
    )


def resolve(outcomes: DataFrame) -> DataFrame:
    """(document_id, parser, status, quality, error, tried) from what each parser
    would give: (document_id, cost, outcome)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("cost", "outcome.parser", "outcome"))), lambda x: x["outcome"])
    docs = outcomes.groupBy("document_id").agg(listed.alias("all"))
    docs = docs.withColumn("names", F.transform("all", lambda o: o["parser"]))

    def step(state: Column, _: Column) -> Column:
        given = F.get(F.filter("all", lambda o: o["parser"] == state["turn"]), F.lit(0))
        return F.when(state["turn"].isNull(), state).otherwise(advance(state, given))

    state = F.aggregate("all", start(F.col("names")), step)
    done = docs.select("document_id", state.alias("state"))
    return done.select("document_id", final(F.col("state")).alias("f"), "state.tried").select("document_id", "f.*", "tried")


def measure(parsed: DataFrame) -> DataFrame:
    """``parsed`` (blocks, page_count, ...) with the figures that the gate reads:
    chars (per page), bad_chars, plausibility, script_validity, empty_tables."""
    whole = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    rows = quality.measure(parsed.withColumn("_whole", whole), "_whole")
    pages = F.col("page_count")
    empty = F.size(F.filter("blocks", lambda b: (b["kind"] == "table") & (F.btrim(b["text"], F.lit(" \t\r\n\x0b\x0c")) == "")))
    return rows.withColumns(
        {"chars": F.when(pages > 0, F.length("_whole") / pages).otherwise(0.0), "empty_tables": empty}
    ).drop("_whole", "n_tokens", "vowel_rate", "function_words", "repetition")


def judged(parsed: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:  # noqa: B008
    """``parsed`` with ``outcome`` for the chain, and ``image_heavy``."""
    rows = measure(parsed)
    c = [F.col(n) for n in ("chars", "bad_chars", "plausibility", "empty_tables")]
    rows = rows.withColumns(
        {
            "_score": F.when(F.col("status") == "ok", quality.score(*c, cfg)),
            "_gate": quality.gate(*c, F.col("script_validity"), F.col("image_count"), cfg),
        }
    )
    outcome = F.struct(
        F.col("parser"), (F.col("status") == "ok").alias("ok"), F.col("_score").alias("quality"), F.col("_gate.escalate_to"), F.col("_gate.unrecoverable"),
        F.col("_gate.trigger").alias("reason"), F.col("error"),
    )
    return rows.withColumn("outcome", outcome.cast(OUTCOME)).withColumn("image_heavy", F.col("_gate.image_heavy")).drop("_score", "_gate")


def parse(files: DataFrame, scratch: Scratch, cfg: QualityConfig = QualityConfig()) -> DataFrame:  # noqa: B008
    """Outcomes of ``files`` (path, content) after the whole chain: (path,
    status, parser, error, quality, encoding, page_count, image_count,
    image_heavy, blocks, outline); blocks are those of the best parse.

    There are as many rounds as a document has candidates at most; a document
    that is done is not read again.
    """
    state = scratch.keep(files.select("path", start(parsers.candidates(F.col("path"))).alias("state")), "state-0")
    rounds: list[DataFrame] = []
    while not (due := state.where("state.turn is not null").select("path", F.col("state.turn").alias("parser"))).isEmpty():
        given = judged(parsers.parse_files(files.join(due, "path")), cfg)
        rounds.append(scratch.keep(given, f"round-{len(rounds)}"))
        moved = state.join(rounds[-1].select("path", "outcome"), "path", "left")
        after = F.when(F.col("outcome").isNull(), F.col("state")).otherwise(advance(F.col("state"), F.col("outcome")))
        state = scratch.keep(moved.select("path", after.alias("state")), f"state-{len(rounds)}")
    done = state.select("path", final(F.col("state")).alias("f")).select("path", "f.*")
    if not rounds:
        rounds.append(judged(parsers.parse_files(files.limit(0))))
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    best = every.select("path", "parser", "encoding", "page_count", "image_count", "image_heavy", "blocks", "outline")
    out = done.join(best, ["path", "parser"], "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(best.schema[c].dataType)) for c in ("blocks", "outline")}).withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("page_count", "image_count")}
    )
