"""WARC derivatives: each response record gets a metadata record and a plain-text conversion record.

A response is a record with its headers (a map), and its block: an HTTP response. The derivatives refer to it by
WARC-Refers-To, keep its target URI and date, carry its digests and its HTTP headers in the metadata block, and have
digests of their own. Record ids are name-based UUIDs of the response's id and the kind of record, so a task that runs
twice makes the same records. Records are made batch by batch from the rows alone: no shuffle, no state.

Defined results: a null body is an empty body, whose conversion record is empty; a null URL leaves WARC-Target-URI out; a
null id is the empty name; rows that repeat make records that repeat, with the same ids; bytes that are no UTF-8 become
U+FFFD; an empty table gives no records; extra columns do not matter. Comments, scripts and styles that nothing ends run to
the end of the page; other elements that nothing ends lose their tag only.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import batched, only, table

NAMESPACE = uuid.UUID("6f0c2f0a-55a3-5c0e-9d0b-5d6b8a3c1e77")
VERSION, CRLF = "WARC/1.1", "\r\n"
#: What stands in a tag after its name. No pattern below looks at a character of a page more than a few times.
_REST = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
#: Comments and raw text, which run to the end of the page if nothing ends them.
RAW = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b{_REST}.*?(?:</\1\s*+>|\Z)")
#: Elements whose content is no text, if they are closed.
HIDDEN = {name: (re.compile(rf"(?is)<{name}\b{_REST}.*?</{name}\s*+>"), re.compile(rf"(?i)</{name}\s*+>")) for name in ("noscript", "template", "svg")}
TITLE, TITLE_END = re.compile(rf"(?i)<title\b{_REST}"), re.compile(r"(?i)</title\s*+>")
#: Elements that end a line.
BREAKS = re.compile(rf"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b{_REST}")
TAGS = re.compile(rf"<{_REST}")
SPACES, LINES = re.compile(r"[ \t\f\v\xa0]+"), re.compile(r" ?[\r\n][ \r\n]*")

RECORD = "record_type string, record_id string, refers_to string, target_uri string, date string, headers map<string,string>, block string, block_digest string"


def record_id(kind: str, *names: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join([kind, *('' if n is None else str(n) for n in names)]))}>"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """The title, and the text of the body with a line for each block.

    The head needs no end: apart from the title it holds tags, which are no text, and what RAW and HIDDEN leave out.
    """
    page = RAW.sub(" ", page)
    for element, end in HIDDEN.values():
        last = max((m.end() for m in end.finditer(page)), default=0)  # after it none is closed
        page = element.sub(" ", page[:last]) + page[last:]
    title = ""
    if begin := TITLE.search(page):
        end = TITLE_END.search(page, begin.end())
        if end:
            title, page = page[begin.end() : end.start()] + "\n", page[: begin.start()] + " " + page[end.end() :]
    text = html.unescape(title + TAGS.sub("", BREAKS.sub("\n", page)))
    return LINES.sub("\n", SPACES.sub(" ", text)).strip()


def http_head(block: str) -> tuple[str, dict[str, str], str]:
    """Status line, headers and body of an HTTP response."""
    head, _, body = block.partition(CRLF * 2)
    first, *lines = head.split(CRLF)
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def response_record(page_id: object, url: str | None, page: str | None, date: str) -> dict[str, object]:
    body = page or ""
    n, data = len(body.encode("utf-8", "replace")), body.encode("utf-8", "replace")
    block = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {n}", "", body])
    rid = record_id("response", page_id, url, hashlib.sha1(data).hexdigest())
    return made("response", rid, None, url, date, "application/http; msgtype=response", block, {"WARC-Payload-Digest": digest(data)})


def made(kind: str, rid: str, refers_to: str | None, url: str | None, date: str, content: str, block: str, more: dict[str, str]) -> dict[str, object]:
    data = block.encode("utf-8", "replace")
    headers = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": date, "Content-Type": content, "Content-Length": str(len(data)), "WARC-Block-Digest": digest(data)}
    headers |= ({"WARC-Refers-To": refers_to} if refers_to else {}) | ({"WARC-Target-URI": url} if url else {}) | more
    return {"record_type": kind, "record_id": rid, "refers_to": refers_to, "target_uri": url, "date": date, "headers": headers, "block": block, "block_digest": headers["WARC-Block-Digest"]}


def derivatives(rec: dict[str, object]) -> list[dict[str, object]]:
    """The metadata record and the conversion record of a response."""
    status, http, body = http_head(str(rec["block"] or ""))
    source, url, date = str(rec["record_id"]), rec["target_uri"], str(rec["date"])
    headers = dict(rec["headers"] or {})
    text = plain_text(body)
    conversion_id = record_id("conversion", source)
    about = [("source-status", status), *((f"source-http-{k}", v) for k, v in sorted(http.items())), *((f"source-{k.lower()}", headers[k]) for k in sorted(headers) if k.lower().endswith("digest")), ("conversion-record-id", conversion_id), ("conversion-characters", str(len(text)))]
    meta = "".join(f"{k}: {v}{CRLF}" for k, v in about)
    more = {"WARC-Source-Payload-Digest": headers["WARC-Payload-Digest"]} if headers.get("WARC-Payload-Digest") else {}
    return [
        made("metadata", record_id("metadata", source), source, url, date, "application/warc-fields", meta, more),
        made("conversion", conversion_id, source, url, date, "text/plain; charset=utf-8", text, more),
    ]


def serialise(rec: dict[str, object]) -> bytes:
    """The record as it stands in a WARC file."""
    head = CRLF.join([VERSION, *(f"{k}: {v}" for k, v in dict(rec["headers"]).items())])
    return f"{head}{CRLF * 2}{rec['block']}{CRLF * 2}".encode("utf-8", "replace")


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records for a table of pages, with the page's id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b[id_col].tolist()
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                rows = [response_record(None if pd.isna(p) else p, _text(u), _text(h), date) for p, u, h in zip(ids[i : i + 256], part[url_col], part[html_col], strict=True)]
                yield pd.DataFrame({id_col: part[id_col].to_numpy()} | {k: [r[k] for r in rows] for k in rows[0]})

    src = only(pages, [id_col, url_col, html_col]).withColumn(id_col, F.col(f"`{id_col}`").cast("string"))
    kind = pages.schema[id_col].dataType.simpleString()
    return batched(src, run, f"`{id_col}` string, {RECORD}").withColumn(id_col, F.col(f"`{id_col}`").cast(kind))


def derive(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The derivative records of the response records; other kinds of record have none."""
    fields = ["record_id", "target_uri", "date", "headers", "block"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                got = [(k, d) for k, rec in enumerate(part[fields].to_dict("records")) for d in derivatives(rec | {"target_uri": _text(rec["target_uri"])})]
                at = [k for k, _ in got]
                yield pd.DataFrame({id_col: part[id_col].iloc[at].to_numpy()} | {k: [d[k] for _, d in got] for k in got[0][1]})

    src = only(records.where("record_type = 'response'"), [id_col, *fields]).withColumn(id_col, F.col(f"`{id_col}`").cast("string"))
    kind = records.schema[id_col].dataType.simpleString()
    return batched(src, run, f"`{id_col}` string, {RECORD}").withColumn(id_col, F.col(f"`{id_col}`").cast(kind))


def as_warc(records: DataFrame) -> DataFrame:
    """The records with a binary column warc, ready to be concatenated into files."""
    head = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), CRLF)
    return records.withColumn("warc", F.encode(F.concat(F.lit(VERSION + CRLF), head, F.lit(CRLF * 2), F.col("block"), F.lit(CRLF * 2)), "UTF-8"))


def parsed(stream: BinaryIO) -> Iterator[dict[str, object]]:
    """The records of a WARC stream, compressed or not, one at a time. What follows a broken record is left out."""
    f = io.BufferedReader(stream)
    if f.peek(2)[:2] == b"\x1f\x8b":
        f = io.BufferedReader(gzip.GzipFile(fileobj=f))
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            return
        headers: dict[str, str] = {}
        last = ""
        while (line := f.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and last:
                headers[last] += " " + text.strip()
            else:
                last, _, value = text.partition(":")
                headers[last := last.strip()] = value.strip()
        known = {k.lower(): v for k, v in headers.items()}
        if not known.get("content-length", "").isdigit():
            return
        block = f.read(int(known["content-length"]))
        if len(block) < int(known["content-length"]):
            return
        yield {
            "record_type": known.get("warc-type"),
            "record_id": known.get("warc-record-id"),
            "refers_to": known.get("warc-refers-to"),
            "target_uri": known.get("warc-target-uri"),
            "date": known.get("warc-date"),
            "headers": headers,
            "block": block.decode("utf-8", "replace"),
            "block_digest": known.get("warc-block-digest"),
        }


def opened(path: str) -> BinaryIO:
    from pyarrow import fs

    if "://" not in path:
        path = "file://" + path
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inner)


def read_warc(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The records of WARC files (plain or gzip), with source (the path) and at (the record's number); a task for each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for b in batches for p in b["source"]):
            rows, held = [], 0
            with opened(path) as f:
                for at, r in enumerate(parsed(f)):
                    rows.append({"source": path, "at": at} | r)
                    held += len(str(r["block"]))
                    if len(rows) >= 256 or held > 1 << 22:
                        yield pd.DataFrame(rows)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows)

    named = spark.createDataFrame([(p,) for p in paths], "source string").repartition(max(1, len(paths)))
    return named.mapInPandas(run, f"source string, at long, {RECORD}")


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derive(responses(table(spark, sf_dir, "pages")))
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "date", F.to_json("headers").alias("headers"), "block", "block_digest")
