"""OAI-PMH records as a stream: the days are the offsets, a day is a task, and resumption tokens live inside it.

A batch covers the days from the last one done to the day the service calls today; each day is a partition, whose task follows the tokens from page to page. Offsets name
days only, so a batch that comes again asks for the same days, also after its tokens are gone. A token that expired under way starts its day again, and records that
this task gave before are not given twice. Deleted records come with `deleted` set and without metadata. A day without records is no error; another error of the service fails the task,
which Spark tries again.

Register with spark.dataSource.register(HarvestSource); format "harvest", options:
fetch - module:function(dict of parameters) -> XML text; called in the tasks.
today - module:function() -> ISO day; called on the driver for each batch. The day itself is not over and is left to the next batch.
first - ISO day to begin with; prefix (oai_dc) and set - as the protocol has them; tries (3) - how often a day may start.
"""

from __future__ import annotations

import datetime
import importlib
import json
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "id string, day string, deleted boolean, sets array<string>, license string, metadata string"
DAY = datetime.timedelta(days=1)


class Refused(RuntimeError):
    """An error that the service named."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


def _named(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def _first(node, name: str):
    return next((x for x in node.iter() if _bare(x.tag) == name), None)


def parsed(xml: str) -> tuple[list[tuple], str | None]:
    """(records, token) of a page; a page without a token, or with an empty one, is the last."""
    root = ElementTree.fromstring(xml)
    error = _first(root, "error")
    if error is not None:
        raise Refused(error.get("code", "unknown"), error.text or "")
    rows = []
    for record in (x for x in root.iter() if _bare(x.tag) == "record"):
        header, body = _first(record, "header"), _first(record, "metadata")
        name = None if header is None else _first(header, "identifier")
        if name is None or not (name.text or "").strip():
            continue
        stamp, deleted = _first(header, "datestamp"), header.get("status") == "deleted"
        license_ = None if body is None or deleted else next((x.text.strip() for x in body.iter() if _bare(x.tag) in ("license", "rights") and x.text and x.text.strip()), None)
        held = None if body is None or deleted or not len(body) else ElementTree.tostring(body[0], encoding="unicode")
        rows.append((name.text.strip(), None if stamp is None else stamp.text, deleted, [x.text for x in header if _bare(x.tag) == "setSpec"], license_, held))
    token = _first(root, "resumptionToken")
    return rows, (token.text or "").strip() or None if token is not None else None


def harvested(fetch, asked: dict[str, str], tries: int = 3) -> Iterator[tuple]:
    """All records of a request, page by page; one page is held at a time, and the (id, day) of what was given."""
    given: set[tuple] = set()
    for left in range(tries - 1, -1, -1):
        token = None
        try:
            while True:
                rows, token = parsed(fetch({"verb": "ListRecords", "resumptionToken": token} if token else {"verb": "ListRecords", **asked}))
                for row in rows:
                    if row[:2] not in given:
                        given.add(row[:2])
                        yield row
                if not token:
                    return
        except Refused as e:
            if e.code == "noRecordsMatch":
                return
            if e.code != "badResumptionToken" or not left:
                raise


class HarvestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"day": self.options["first"]}

    def latestOffset(self) -> dict:
        return {"day": _named(self.options["today"])()}

    def partitions(self, start: dict, end: dict):
        day, stop = (datetime.date.fromisoformat(x["day"]) for x in (start, end))
        return [InputPartition(json.dumps((day + k * DAY).isoformat())) for k in range((stop - day).days)]

    def read(self, partition) -> Iterator[tuple]:
        day = json.loads(partition.value)
        asked = {"metadataPrefix": self.options.get("prefix", "oai_dc"), "from": day, "until": day}
        if self.options.get("set"):
            asked["set"] = self.options["set"]
        yield from harvested(_named(self.options["fetch"]), asked, int(self.options.get("tries", 3)))

    def commit(self, end: dict) -> None:
        pass
