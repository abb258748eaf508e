"""Hooks for models that live outside: rule extraction, reading of pictures, answers. A provider is a plain function."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.config import DEFAULTS
from folioforge.operators.chunking import batches

log = logging.getLogger(__name__)


class Fatal(Exception):
    """An error that no repetition mends."""


#: Waits of a durable step, which is tried four times.
STEP_WAITS = (0.25, 0.75, 2.0)


def durable[T](call: Callable[[], T], waits: Sequence[float] = STEP_WAITS, sleep: Callable[[float], None] = time.sleep) -> T:
    """A step of ingestion: any error but a fatal one is tried again after each wait; the last one is raised."""
    for wait in waits:
        try:
            return call()
        except Fatal:
            raise
        except Exception:
            log.warning("a step failed and is tried again", exc_info=True)
            sleep(wait)
    return call()


def retried[T](call: Callable[[], T], waits: Sequence[float] = (0.25, 0.75), transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result; errors that may pass are tried again after each wait."""
    for wait in waits:
        try:
            return call()
        except transient:
            sleep(wait)
    return call()


def extract_rules(chunks: DataFrame, provider: Callable[[list[dict]], list[dict]], settings=DEFAULTS) -> DataFrame:
    """(document_id, position, source_chunk_id, statement, evidence_quote, confidence): what the provider finds, batch by batch.

    chunks(document_id, ordinal, chunk_id, text). A batch has at most ten chunks and 12 000 characters. Candidates
    are not checked here.
    """
    dealt = batches(chunks, "document_id", "ordinal", most=settings.batch_chunks, chars=settings.batch_chars).join(chunks, ["document_id", "ordinal"])
    key = dealt.schema["document_id"].dataType.simpleString()
    names = ["document_id", "position", "source_chunk_id", "statement", "evidence_quote", "confidence"]

    def one(pair: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sent = rows.sort_values("ordinal")[["chunk_id", "text"]].to_dict("records")
        found = retried(lambda: provider(sent))
        out = [(pair[0], pair[1] * 1000 + k, c.get("source_chunk_id"), c.get("statement"), c.get("evidence_quote"), c.get("confidence")) for k, c in enumerate(found)]
        return pd.DataFrame(out, columns=names)

    return dealt.groupBy("document_id", "batch").applyInPandas(one, f"document_id {key}, position long, source_chunk_id string, statement string, evidence_quote string, confidence double")


def read_pictures(images: DataFrame, provider: Callable[[list[tuple[str, bytes]]], list[str]], most_bytes: int = 8 << 20, batch: int = 8, most: int = 20) -> DataFrame:
    """(document_id, image_index, insight, problem) of images(document_id, image_index, media_type, data), a row each.

    insight is the provider's JSON. problem says why there is none: 'size' (above most_bytes), 'limit' (beyond the
    first `most` of a document that are not too large) or 'failed' (the provider raised for its batch).
    """
    schema = "document_id string, image_index int, insight string, problem string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                problem = None
                try:
                    said = retried(lambda p=part: provider([(m, bytes(d)) for m, d in zip(p["media_type"], p["data"], strict=True)]))
                except Exception:  # one batch must not cost the others
                    log.warning("pictures could not be read", exc_info=True)
                    said, problem = [None] * len(part), "failed"
                yield pd.DataFrame({"document_id": part["document_id"], "image_index": part["image_index"], "insight": said, "problem": problem}).astype(object)

    fits = F.coalesce(F.length("data") <= most_bytes, F.lit(False))
    rows = images.select(F.col("document_id").cast("string").alias("document_id"), F.col("image_index").cast("int").alias("image_index"), "media_type", "data", fits.alias("_fits"))
    place = F.row_number().over(Window.partitionBy("document_id", "_fits").orderBy("image_index"))
    rows = rows.withColumn("problem", F.when(~F.col("_fits"), "size").when(place > most, "limit"))
    left = rows.where("problem IS NOT NULL").select("document_id", "image_index", F.lit(None).cast("string").alias("insight"), "problem")
    return rows.where("problem IS NULL").select("document_id", "image_index", "media_type", "data").mapInPandas(run, schema).unionByName(left)


_INSIGHT = "struct<visibleText:string,description:string,keyFacts:array<string>>"


def insight_text(insight: Column, alt: Column | None = None) -> Column:
    """The text of a picture's insight in JSON: alternative text, what can be read, what is shown, key facts; '' if there is nothing."""
    x = F.from_json(insight, _INSIGHT)
    facts = F.array_join(F.filter(F.transform(F.coalesce(x["keyFacts"], F.array().cast("array<string>")), lambda f: F.trim(f)), lambda f: f != ""), "; ")
    said = [("Text: ", F.trim(x["visibleText"])), ("Shown: ", F.trim(x["description"])), ("Facts: ", facts)]
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(label), v)) for label, v in said]
    body = F.concat_ws("\n", *lines)
    head = F.when(F.coalesce(alt, F.lit("")) != "", F.concat(F.lit("Alternative: "), alt)) if alt is not None else F.lit(None).cast("string")
    return F.when(body == "", "").otherwise(F.concat_ws("\n", head, body))


def answer(contexts: DataFrame, provider: Callable[[str, list[dict]], dict], key: str = "request_id") -> DataFrame:
    """(key, answer, citation_chunk_ids, insufficient_evidence, failed): contexts(key, query, position, chunk_id, text), one call a request."""
    kind = contexts.schema[key].dataType.simpleString()

    def one(pair: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        try:
            got = retried(lambda: provider(rows["query"].iloc[0], rows[["chunk_id", "text"]].to_dict("records")))
            out = (pair[0], str(got.get("answer") or ""), [str(c) for c in got.get("citation_chunk_ids") or []], bool(got.get("insufficient_evidence")), False)
        except Exception:  # a failed call is an answer of its own
            out = (pair[0], "", [], True, True)
        return pd.DataFrame([out], columns=[key, "answer", "citation_chunk_ids", "insufficient_evidence", "failed"])

    return contexts.groupBy(key).applyInPandas(one, f"{key} {kind}, answer string, citation_chunk_ids array<string>, insufficient_evidence boolean, failed boolean")
