"""Progress events as lines of JSON: a parser over fragments, a gate that only lets progress go forward, and a writer."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The stages of a search in order.
STAGES = ("searching", "expanding", "ranking", "answering", "verifying")


def valid(event: object) -> bool:
    if not isinstance(event, dict):
        return False
    if event.get("type") == "progress":
        return event.get("stage") in STAGES
    return (event.get("type") == "result" and isinstance(event.get("result"), dict)) or (event.get("type") == "error" and isinstance(event.get("error"), str))


class Parser:
    """Fragments of text in, whole events out; a line may come in pieces."""

    def __init__(self) -> None:
        self.rest = ""

    def _event(self, line: str) -> dict:
        try:
            event = json.loads(line)
        except ValueError as e:
            raise ValueError("a line of the stream is no JSON") from e
        if not valid(event):
            raise ValueError("a line of the stream is no known event")
        return event

    def push(self, fragment: str) -> list[dict]:
        *lines, self.rest = (self.rest + fragment).split("\n")
        return [self._event(x) for x in lines if x.strip()]

    def finish(self) -> list[dict]:
        rest, self.rest = self.rest, ""
        return [self._event(rest)] if rest.strip() else []


def parse_fragments(fragments: DataFrame, key: str = "request_id", order: str = "seq", text: str = "fragment") -> DataFrame:
    """(key, n, type, stage, valid): the events of each request's fragments, joined in order and cut at line ends."""
    whole = fragments.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("t"))
    rows = whole.select(key, F.posexplode_outer(F.filter(F.split("t", "\n"), lambda x: F.trim(x) != "")).alias("n", "line")).where("line IS NOT NULL")
    e = F.from_json("line", "struct<type:string,stage:string,error:string,result:string>")
    ok = ((e["type"] == "progress") & e["stage"].isin(*STAGES)) | ((e["type"] == "result") & e["result"].isNotNull()) | ((e["type"] == "error") & e["error"].isNotNull())
    return rows.select(key, "n", e["type"].alias("type"), e["stage"].alias("stage"), F.coalesce(ok, F.lit(False)).alias("valid"))


def forward_only(events: DataFrame, key: str = "request_id", order: str = "n", stages: Iterable[str] = STAGES) -> DataFrame:
    """Events with `forward`: whether the stage is the same as or later than all before it."""
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_p", place).withColumn("forward", F.col("_p") >= F.coalesce(F.max("_p").over(before), F.lit(0))).drop("_p")


def lines(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, value): one line of JSON per event, for a text sink."""
    rest = [c for c in events.columns if c not in (key, order)]
    return events.select(key, order, F.to_json(F.struct(*rest)).alias("value"))


def write_lines(events: Iterable[dict]) -> Iterator[str]:
    for event in events:
        yield json.dumps(event, ensure_ascii=False) + "\n"
