"""File sources and sinks: JSON, JSONL, URL and topic lists, manifests, packs."""

from __future__ import annotations

import json
import re
import shutil
import tarfile
import tempfile
from collections.abc import Mapping
from datetime import datetime, timedelta
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions import text as X

QUESTION = "id string, domain string, difficulty string, question string, ground_truth string, source string"
REQUIRED = ("id", "domain", "difficulty", "question", "ground_truth")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 1 in each. A file is one task's, so lists of lines are meant, not corpora."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n", -1)).alias("at", "value"))
    return whole.select("file", (F.col("at") + 1).alias("line"), "value")


def strict(spark: SparkSession, path: str, schema: str, required: tuple[str, ...], what: str) -> DataFrame:
    """(line, ...) of a JSONL file; a line that is no object or lacks a required field is an error that names it."""
    raw = numbered(spark, path).where(F.trim("value") != "")
    q = raw.select("file", "line", F.from_json("value", schema).alias("q"))
    bad = q.where(F.col("q").isNull() | F.greatest(*(F.col(f"q.{c}").isNull() for c in required))).orderBy("file", "line").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}: line {bad[0]['line']} is no {what} with the fields {', '.join(required)}")
    return q.select("line", "q.*")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSONL file, each with its line."""
    return strict(spark, path, QUESTION, REQUIRED, "question")


def first_questions(spark: SparkSession, path: str, n: int) -> DataFrame:
    return questions(spark, path).orderBy("line").limit(n)


TASK = "id string, pack_name string, task_type string, difficulty string, prompt string, ground_truth_code string, ground_truth_description string, validation struct<language:string,must_contain:array<string>,must_not_contain:array<string>,expected_constructs:array<string>,execution_test:string>, tags array<string>"


def tasks(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Coding tasks of a JSONL file with their lines; a limit of none or 0 is no limit."""
    found = strict(spark, path, TASK, ("id", "prompt"), "task")
    return found.orderBy("line").limit(limit) if limit else found


def examples(spark: SparkSession, path: str, schema: str, most: int = 1000) -> DataFrame:
    """Few-shot examples of a JSON array or of JSON lines, told apart by the first character; the first `most`."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    many = bool(head) and head[0][0].lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", many).json(path).limit(most)


def urls(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """https lines of a list, in order, without comments; a limit of none or 0 is no limit."""
    u = numbered(spark, path).select(F.col("line").alias("ord"), F.trim("value").alias("url")).where(~F.col("url").startswith("#") & F.col("url").startswith("https://"))
    return u.orderBy("ord").limit(limit) if limit else u


def urls_loosely(spark: SparkSession, path: str) -> DataFrame:
    """Every line that isn't blank and doesn't begin with #."""
    u = numbered(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return u.select(F.col("line").alias("ord"), F.trim("value").alias("url"))


def topics(spark: SparkSession, path: str) -> DataFrame:
    """Topics of a list without bullets and numbers, blank lines and comments."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim("value"), r"^[-*]\s+", ""), r"^\d+\.\s+", ""))
    raw = numbered(spark, path).where(~F.trim("value").startswith("#"))
    return raw.select(F.col("line").alias("ord"), t.alias("topic")).where("topic <> ''")


MANIFEST = "name string, version string, description string, graph_stats struct<articles:bigint,entities:bigint,relationships:bigint,size_mb:double>, eval_scores struct<accuracy:double,hallucination_rate:double,citation_quality:double>, source_urls array<string>, created string, created_at string, license string, author string, topics array<string>"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """manifest.json of every folder under root, with the folder's name, sorted by it."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{root}/*/manifest.json")
    return m.select(F.regexp_extract("_metadata.file_path", "([^/]+)/manifest.json$", 1).alias("folder"), *m.columns).orderBy("folder")


def manifest_errors(m: DataFrame) -> DataFrame:
    """(folder, errors): what is wrong with each manifest, nothing if it is sound."""
    s, e = F.col("graph_stats"), F.col("eval_scores")
    rules = [
        F.when(~F.coalesce(X.pack_name_ok(F.col("name")), F.lit(False)), "name"), F.when(X.version(F.col("version")).isNull(), "version"), F.when(F.coalesce(F.trim("description"), F.lit("")) == "", "description"),
        *(F.when(F.coalesce(s[c], F.lit(0)) < 0, f"graph_stats.{c}") for c in ("articles", "entities", "relationships", "size_mb")),
        *(F.when(~F.coalesce(e[c].between(0, 1), F.lit(True)), f"eval_scores.{c}") for c in ("accuracy", "hallucination_rate", "citation_quality")),
        F.when(F.exists(F.coalesce("source_urls", F.array().cast("array<string>")), lambda u: ~u.startswith("https://")), "source_urls"),
        F.when(F.coalesce("created", "created_at").try_cast("timestamp").isNull(), "created"), F.when(F.coalesce(F.trim("license"), F.lit("")) == "", "license"),
    ]
    return m.select("folder", F.array_compact(F.array(*rules)).alias("errors"))


def package(folder: Path, archive: Path) -> Path:
    """A pack's folder as a compressed archive; it needs a manifest."""
    if not (folder / "manifest.json").is_file():
        raise ValueError(f"{folder} has no manifest.json")
    archive.parent.mkdir(parents=True, exist_ok=True)
    with tarfile.open(archive, "w:gz") as tar:
        for p in sorted(folder.rglob("*")):
            if p.is_file() and not p.is_symlink():
                tar.add(p, p.relative_to(folder).as_posix())
    return archive


def plain_name(name: object) -> bool:
    """Whether a pack's name is one folder's: letters, digits, - and _, beginning with a letter or digit, 64 at most."""
    return isinstance(name, str) and re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}", name) is not None


def inside(root: Path, name: object) -> Path:
    """The folder of a pack's name under root; an error for a name that leads anywhere else."""
    if not plain_name(name):
        raise ValueError(f"no name of a pack: {name!r}")
    place = root / str(name)
    if place.is_symlink() or place.resolve().parent != root.resolve():
        raise ValueError(f"{name} is not a folder of {root}")
    return place


def unpackage(archive: Path, root: Path, keep: str = "eval/results", whole: bool = False) -> Path:
    """Unpack into root under the manifest's name, in place of an older version whose `keep` folder stays.

    Members that would leave the folder, links, and names that aren't one plain folder's are refused
    before anything is touched; so is, on request, a folder that isn't a whole pack. The new folder is
    made beside the old one and takes its place by renaming; if that fails the old one stays.
    """
    root.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(prefix=".unpack-", dir=root) as tmp:  # the same disk, so that renaming is one step
        fresh, old = Path(tmp) / "new", Path(tmp) / "old"
        fresh.mkdir()
        with tarfile.open(archive) as tar:
            for m in tar.getmembers():
                if not (m.isfile() or m.isdir()) or Path(m.name).is_absolute() or ".." in Path(m.name).parts:
                    raise ValueError(f"unsafe member {m.name}")
            tar.extractall(fresh, filter="data")
        if not (fresh / "manifest.json").is_file():
            raise ValueError(f"{archive} has no manifest.json")
        manifest = json.loads((fresh / "manifest.json").read_text())
        target = inside(root, manifest.get("name") if isinstance(manifest, dict) else None)
        if whole and (errors := pack_errors(fresh)):
            raise ValueError(f"{archive}: {'; '.join(errors)}")
        if (target / keep).is_dir():
            shutil.rmtree(fresh / keep, ignore_errors=True)
            shutil.copytree(target / keep, fresh / keep)
        if target.exists():
            target.rename(old)
        try:
            fresh.rename(target)
        except BaseException:
            if old.exists():
                old.rename(target)
            raise
    return target


def update_pack(archive: Path, root: Path, name: str) -> tuple[str, str]:
    """(old version, new version) of an installed pack, replaced by an archive of the same name that isn't older."""
    place = inside(root, name)
    if not (place / "manifest.json").is_file():
        raise FileNotFoundError(f"{name} is not installed")
    with tarfile.open(archive) as tar:
        held = next((m for m in tar.getmembers() if m.isfile() and Path(m.name).as_posix() == "manifest.json"), None)
        if held is None:
            raise ValueError(f"{archive} has no manifest.json")
        new = json.loads(tar.extractfile(held).read())
    old = json.loads((place / "manifest.json").read_text())
    if new.get("name") != name:
        raise ValueError(f"{archive} holds {new.get('name')!r}, not {name}")
    number = lambda v: [int(x) for x in re.findall(r"\d+", str(v))[:3]]
    if number(new.get("version")) < number(old.get("version")):
        raise ValueError(f"{new.get('version')} is older than {old.get('version')}")
    unpackage(archive, root)
    return old.get("version"), new.get("version")


# What the folder of an installed pack holds.
PACK_PARTS = ("manifest.json", "pack.db", "skill.md", "kg_config.json")


def pack_errors(folder: Path) -> list[str]:
    """What keeps a folder from being a pack: parts it lacks, and a manifest or configuration that can't be read or is incomplete."""
    errors = [f"no {part}" for part in PACK_PARTS if not (folder / part).exists()]
    for part, fields in (("manifest.json", ("name", "version", "description", "graph_stats", "license")), ("kg_config.json", ())):
        if (folder / part).is_file():
            try:
                held = json.loads((folder / part).read_text())
                errors += [f"{part} lacks {x}" for x in fields if not held.get(x)]
            except (OSError, ValueError, AttributeError):
                errors.append(f"{part} can't be read")
    return errors


def packs(root: Path) -> list[Path]:
    """Folders under root that are whole packs."""
    return [p for p in sorted(root.iterdir()) if p.is_dir() and not pack_errors(p)] if root.is_dir() else []


def remove(root: Path, name: str) -> None:
    """Deletes an installed pack."""
    shutil.rmtree(inside(root, name))


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A table as JSON lines by Spark, or, small as reports are, as one JSON array or one Markdown table."""
    if kind == "jsonl":
        df.write.mode("overwrite").json(path)
        return
    rows = [json.loads(x) for x in df.toJSON().collect()]
    if kind == "json":
        Path(path).write_text(json.dumps(rows, indent=2, ensure_ascii=False))
    elif kind == "markdown":
        cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
        lines = [df.columns, ["---"] * len(df.columns), *([cell(r.get(c)) for c in df.columns] for r in rows)]
        Path(path).write_text("\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n")
    else:
        raise ValueError(f"no report of kind {kind}")


def fresh(spark: SparkSession, path: str, now: datetime, days: float = 7) -> DataFrame:
    """(file, at, fresh) of a cache's files: whether each was written in the last `days`."""
    f = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("modificationTime").alias("at"))
    return f.withColumn("fresh", F.col("at") >= F.lit(now - timedelta(days=days)))


class Source(Protocol):
    """What builds a graph from somewhere: pages of titles, their sections and their links, as DataFrames."""

    def articles(self, titles: DataFrame) -> DataFrame:
        """(title, text, categories) of titles(title)."""

    def sections(self, articles: DataFrame) -> DataFrame:
        """(title, section_index, level, heading, content)."""

    def links(self, articles: DataFrame) -> DataFrame:
        """(src, dst)."""


def settings(path: str | None = None, environment: Mapping[str, str] | None = None, prefix: str = "GRAPHWEAVE_", **defaults: str | int | float | bool) -> dict[str, str | int | float | bool]:
    """Defaults, over them a file of `name: value` lines or a JSON object, over it the environment; values have the defaults' types."""
    held: dict[str, object] = {}
    if path:
        raw = Path(path).read_text()
        pairs = (line.split("#")[0].partition(":") for line in raw.splitlines())
        held = json.loads(raw) if raw.lstrip().startswith("{") else {k.strip(): v.strip().strip("'\"") for k, mark, v in pairs if mark}
    held |= {k: environment[prefix + k.upper()] for k in defaults if prefix + k.upper() in (environment or {})}
    if unknown := sorted(set(held) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    read = lambda v, d: str(v).lower() in ("1", "true", "yes", "on") if isinstance(d, bool) else type(d)(v)
    return defaults | {k: read(v, defaults[k]) for k, v in held.items()}


def cascade(found: DataFrame, most: int, order: tuple[str, ...] = ("sitemap", "rss", "crawl", "llm")) -> DataFrame:
    """(source, url, method, content_score) of found(source, method, ord, url): methods in order until `most` URLs."""
    from graphweave.schema import top

    # How far each way of finding a URL is trusted.
    trust = {"sitemap": 0.8, "rss": 0.85, "crawl": 0.75, "llm": 0.9}
    place = F.array_position(F.array(*map(F.lit, order)), F.col("method"))
    score = F.create_map(*(F.lit(x) for k, v in trust.items() for x in (k, v)))
    once = found.withColumn("place", place).groupBy("source", "url").agg(F.min(F.struct("place", "ord", "method")).alias("m")).select("source", "url", "m.*")
    return top(once, ["source"], [F.col("place"), F.col("ord")], most, "n").select("source", "url", "method", F.try_element_at(score, F.col("method")).alias("content_score"))
