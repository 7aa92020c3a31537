"""Posts of social sites as a data source for Spark: spark.read.format("social_posts").

The source reads pages of results, as the site's interface gives them, from JSON files (option path; a client that saves
its replies is the user's). It keeps up to `limit` posts of a term, and stops after `empty_rounds` pages without a new one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "term string, url string, image string, title string, description string, at long"


def pin(term: str, r: dict) -> tuple | None:
    """A pin that is no video, not promoted, and links somewhere."""
    if r.get("type") != "pin" or r.get("videos") or r.get("is_promoted") or not r.get("link"):
        return None
    return term, r["link"], (r.get("images") or {}).get("orig", {}).get("url"), r.get("title"), r.get("description"), r.get("at")


def post(term: str, r: dict) -> tuple | None:
    """A picture (media_type 1) of a tag's recent section."""
    m = r.get("media", r)
    if m.get("media_type") != 1:
        return None
    image = ((m.get("image_versions2") or {}).get("candidates") or [{}])[0].get("url")
    return term, m.get("code"), image, term, (m.get("caption") or {}).get("text"), m.get("taken_at")


def results(page: dict) -> list[dict]:
    if "results" in page:
        return page["results"]
    sections = page.get("data", {}).get("recent", {}).get("sections", [])
    return [m for s in sections for m in s.get("layout_content", {}).get("medias", [])]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, with or without a scheme, and the path within it."""
    if ":" not in path.split("/")[0]:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


class _Term(InputPartition):
    def __init__(self, term: str, files: list[str]) -> None:
        self.term, self.files = term, files


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.limit, self.rounds = options["path"], int(options.get("limit", 250)), int(options.get("empty_rounds", 3))
        self.kind = options.get("kind", "pin")

    def partitions(self) -> list[_Term]:
        """One for each term: a folder of numbered pages."""
        store, root = _store(self.path)
        found = lambda at, kind: sorted(f.path for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == kind)
        return [_Term(os.path.basename(d), [f for f in found(d, fs.FileType.File) if f.endswith(".json")]) for d in found(root, fs.FileType.Directory)]

    def read(self, partition: _Term) -> Iterator[tuple]:
        made, seen, empty = {"pin": pin, "post": post}[self.kind], set(), 0
        store = _store(self.path)[0]
        for name in partition.files:
            with store.open_input_stream(name) as f:
                rows = [x for x in (made(partition.term, r) for r in results(json.loads(f.read()))) if x and x[1] not in seen]
            empty = 0 if rows else empty + 1
            for r in rows:
                if len(seen) >= self.limit:
                    return
                if r[1] not in seen:
                    seen.add(r[1])
                    yield r
            if empty >= self.rounds:
                return


class SocialPosts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "social_posts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_posts(spark: SparkSession, path: str, kind: str = "pin", limit: int = 250) -> DataFrame:
    spark.dataSource.register(SocialPosts)
    return spark.read.format("social_posts").options(path=path, kind=kind, limit=limit).load()


def letters_only(posts: DataFrame) -> DataFrame:
    """Descriptions with their words of letters alone, as the tag search stores them."""
    return posts.withColumn("description", F.array_join(F.regexp_extract_all(F.coalesce("description", F.lit("")), F.lit("[a-zA-Z]+"), 0), " "))
