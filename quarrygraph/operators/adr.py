"""Architecture decision records: one document per project, kept as sections in a fixed order."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADERS = ("PURPOSE", "STACK", "ARCHITECTURE", "PATTERNS", "TRADEOFFS", "PHILOSOPHY")
MAX_CHARS = 8000
SCHEMA = "project string, content string, created_at string, updated_at string"


def parse_sections(content: str) -> dict[str, str]:
    """Sections by header (``## NAME``); text before the first header is dropped, later duplicates win."""
    out: dict[str, str] = {}
    name, lines = None, []
    for line in (content or "").splitlines():
        m = re.match(r"##\s+(.+?)\s*$", line)
        if m:
            if name is not None:
                out[name] = "\n".join(lines).strip()
            name, lines = m[1].strip().upper(), []
        elif name is not None:
            lines.append(line)
    if name is not None:
        out[name] = "\n".join(lines).strip()
    return out


def render_sections(sections: dict[str, str]) -> str:
    """Known headers in their order, then others by name."""
    names = [h for h in HEADERS if h in sections] + sorted(set(sections) - set(HEADERS))
    return "\n\n".join(f"## {n}\n{sections[n]}".rstrip() for n in names)


def sections_frame(docs: DataFrame) -> DataFrame:
    """(project, header, body) of many records at once: headers are carried forward over their lines."""
    lines = docs.select("project", F.posexplode(F.split("content", "\r\n|\r|\n", -1)).alias("pos", "line"))
    header = F.when(F.col("line").rlike(r"^##\s+\S"), F.upper(F.regexp_extract("line", r"^##\s+(.+?)\s*$", 1)))
    up_to = W.partitionBy("project").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("own", header).withColumns({"header": F.last("own", ignorenulls=True).over(up_to), "n": F.count("own").over(up_to)})
    body = rows.filter("own is null and header is not null").groupBy("project", "header", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    heads = rows.filter("own is not null").groupBy("project", "header").agg(F.max("n").alias("n"))
    text = F.coalesce(F.btrim(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit(" \t\n")), F.lit(""))
    return heads.join(body, ["project", "header", "n"], "left").select("project", "header", text.alias("body"))


class Records:
    """Records of all projects in one small table; each change writes a new version of it."""

    def __init__(self, spark: SparkSession, rows: list[tuple] = ()):
        self.spark, self.rows = spark, {r[0]: r for r in rows}

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.rows.values()), SCHEMA)

    def exists(self, project: str) -> bool:
        return project in self.rows

    def get(self, project: str) -> str | None:
        return self.rows[project][1] if project in self.rows else None

    def store(self, project: str, content: str, now: str | None = None) -> None:
        """Write a record; the time of its creation stays."""
        if len(content) > MAX_CHARS:
            raise ValueError(f"a record holds at most {MAX_CHARS} characters")
        now = now or datetime.now(timezone.utc).isoformat()
        created = self.rows[project][2] if project in self.rows else now
        self.rows[project] = (project, content, created, now)

    def update(self, project: str, sections: dict[str, str], now: str | None = None) -> str:
        merged = parse_sections(self.get(project) or "") | {k.upper(): v.strip() for k, v in sections.items()}
        text = render_sections(merged)
        self.store(project, text, now)
        return text

    def delete(self, project: str) -> bool:
        return self.rows.pop(project, None) is not None


def manage(records: Records, project: str, mode: str = "get", content: str | None = None, imported: str | None = None) -> dict:
    """``get`` (importing a file's content on first access), ``store``, ``update`` by sections, ``sections``."""
    if mode == "store":
        records.store(project, content or "")
        return {"status": "stored", "content": records.get(project)}
    if mode == "update":
        return {"status": "updated", "content": records.update(project, parse_sections(content or ""))}
    if not records.exists(project) and imported:
        records.store(project, imported)
    if mode == "sections":
        return {"sections": list(parse_sections(records.get(project) or ""))}
    if mode != "get":
        raise ValueError(f"unknown mode: {mode!r}")
    if not records.exists(project):
        return {"content": None, "adr_hint": "No record yet: store one with sections " + ", ".join(HEADERS)}
    return {"content": records.get(project)}
