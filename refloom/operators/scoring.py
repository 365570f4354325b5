"""Scorers: whatever answers a prompt with text. None is called unless one is given.

A scorer is a function of a list of prompts that returns as many replies, each a string
or None; it runs on executors, a batch at a time (mapInPandas), and must be picklable.
Replies that came in another way, from a batch service for one, are a table instead.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify as K

Scorer = Callable[[list[str]], list[str | None]]
SIGNALS = {"signal1": "How far can this provision be applied by fixed rules?", "signal2": "How vague is this provision?"}


def with_retries(call: Callable, tries: int = 3, wait: float = 1.0, final: tuple = ()) -> Callable:
    """call, tried again after wait, 2 * wait, ... seconds; errors of the kinds `final`
    are not tried again, and the last error is raised."""

    def run(*args):
        for k in range(tries):
            try:
                return call(*args)
            except final:
                raise
            except Exception:
                if k == tries - 1:
                    raise
                time.sleep(wait * 2**k)

    return run


def replies(requests: DataFrame, scorer: Scorer, size: int = 64) -> DataFrame:
    """requests (prompt and what else the rows carry) with reply: null where the scorer
    gave none or failed on the batch and on the prompt alone."""
    at = requests.columns

    def answer(prompts: list[str]) -> list[str | None]:
        try:
            got = list(scorer(prompts))
            if len(got) == len(prompts):
                return got
        except Exception:
            pass
        return [None] if len(prompts) == 1 else [r for p in prompts for r in answer([p])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            prompts = f["prompt"].tolist()
            yield f.assign(reply=[r for i in range(0, len(prompts), size) for r in answer(prompts[i : i + size])])[[*at, "reply"]]

    return requests.mapInPandas(run, T.StructType([*requests.schema.fields, T.StructField("reply", T.StringType())]))


def signal_requests(sections: DataFrame, questions: dict[str, str] = SIGNALS) -> DataFrame:
    """(node_id, signal, custom_id, prompt): a request for each section and signal."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), K.batch_request(k, F.col("node_id"), K.signal_prompt(F.col("text"), q)).alias("r")) for k, q in questions.items()]))
    return sections.select("node_id", each.alias("e")).select("node_id", "e.signal", "e.r.custom_id", "e.r.prompt")


def signals(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """(node_id, signal1, signal2) from requests and their answers (custom_id, reply).
    Answers that no request asked for are skipped; what failed, is malformed or is missing
    is null; of several answers to a request the least counts."""
    got = answered.groupBy("custom_id").agg(F.min("reply").alias("reply"))
    rows = requests.join(got, "custom_id", "left").withColumn("s", K.parsed_signal(F.col("reply")))
    return rows.groupBy("node_id").agg(*[F.max(F.when(F.col("signal") == k, F.col("s"))).alias(k) for k in SIGNALS])


def scored_sections(sections: DataFrame, scorer: Scorer) -> DataFrame:
    """(node_id, signal1, signal2) of sections by a scorer."""
    requests = signal_requests(sections)
    return signals(requests, replies(requests.select("custom_id", "prompt"), scorer))


def settled_citations(rows: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """rows (ref_text, text, ...) with relation and relation_confidence. Only what the
    words near the citation leave open goes to the scorer."""
    found = rows.withColumn("_r", K.relation(F.col("ref_text"), F.col("text")))
    if scorer is None:
        out = found.withColumn("_s", K.settled(F.col("_r")))
    else:
        open_ = found.where("_r is null").withColumn("prompt", K.relation_prompt(F.col("ref_text"), F.col("text")))
        said = K.variant_string(F.try_parse_json(K.unfenced(F.col("reply"))), "relation")
        done = replies(open_, scorer).withColumn("_s", K.settled(F.col("_r"), said)).drop("prompt", "reply")
        out = found.where("_r is not null").withColumn("_s", F.col("_r")).unionByName(done)
    return out.select(*rows.columns, F.col("_s.relation").alias("relation"), F.col("_s.confidence").alias("relation_confidence"))


def batch_answers(submit: Callable, status: Callable, fetch: Callable, requests: list, wait: float = 30.0):
    """A batch service from the driver: submits, asks every `wait` seconds until it has
    ended, and returns what fetch gives ((custom_id, reply or None) pairs)."""
    name = submit(requests)
    while status(name) != "ended":
        time.sleep(wait)
    return fetch(name)


def title_hits(fragments: DataFrame, fetch: Callable[[str], list[dict]], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(title, pos, name, id) for fragments (title, pos, fragment): what a titles service
    finds for each. fetch is tried again on errors; a fragment that fails finds nothing."""
    call = with_retries(fetch, tries, wait)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for title, pos, fragment in f.itertuples(index=False):
                try:
                    hits = call(fragment)
                except Exception:
                    hits = []
                out += [(title, pos, h.get("name"), h.get("id")) for h in hits]
            yield pd.DataFrame(out, columns=["title", "pos", "name", "id"])

    return fragments.select("title", "pos", "fragment").mapInPandas(run, "title string, pos int, name string, id string")
