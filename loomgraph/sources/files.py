"""Files of a source tree, git history and side files as DataFrames."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import rules

# What is no source of a project.
SKIPPED_DIRS = [".git", ".hg", ".svn", ".idea", ".vscode", ".cache", ".turbo", ".next", "node_modules", "dist", "build", "target", "out", ".github"]
SKIPPED_NAMES = ["package.json", "tsconfig.json"]
FAST_NAMES = ["LICENSE", "license", "go.sum", "go.work.sum", "yarn.lock", "package-lock.json", "pnpm-lock.yaml", "pnpm-lock.yml"]
BINARY = "png jpg jpeg gif svg ico pyc class o obj so dll dylib a zip gz tgz bz2 7z exe bin jar dat mp3 mp4 mov avi woff woff2".split()
MAX_BYTES = 8 * 1024 * 1024


def ignore_rules(root: str, names: tuple[str, ...] = (".gitignore",)) -> list[tuple[str, str, bool]]:
    """(directory, pattern, negated) of all ignore files, outer ones first."""
    out = []
    for folder, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED_DIRS)
        for name in names:
            if name in files:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    for line in map(str.strip, f):
                        if line and not line.startswith("#"):
                            out.append((os.path.relpath(folder, root).removeprefix(".").strip("/"), line.lstrip("!").strip("/"), line.startswith("!")))
    return out


def ignored(path, table: list[tuple[str, str, bool]]):
    """Whether the last rule that matches a path says so; a rule matches by substring below its directory."""
    out = F.lit(False)
    for folder, pattern, negated in table:
        below = path.startswith(f"{folder}/") if folder else F.lit(True)
        body = pattern.strip("*")
        hit = below & (path.endswith(body) if pattern.startswith("*") else path.contains(body))
        out = F.when(hit, F.lit(not negated)).otherwise(out)
    return out


def discover(spark: SparkSession, root: str, fast: bool = False, table: list[tuple[str, str, bool]] | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """file_path, language, size, mtime and content of the text files below root that Spark can list."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    rows = raw.select(path.alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content").where(F.col("size") <= MAX_BYTES)
    skipped = F.col("file_path").rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS) + ")/")
    name = rules.basename(F.col("file_path"))
    bad = skipped | name.isin(SKIPPED_NAMES + (FAST_NAMES if fast else [])) | F.col("file_path").rlike(r"\.(" + "|".join(BINARY) + ")$")
    if fast:
        bad = bad | name.rlike(r"(\.d\.ts|\.pb\.go)$")
    kept = rows.where(~bad & ~ignored(F.col("file_path"), table or []))
    texts = kept.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
    language = rules.language(F.col("file_path"), overrides, F.col("content"))
    return texts.select("file_path", language.alias("language"), "size", "mtime", "content")


def extension_map(text: str) -> dict[str, str]:
    """Languages by extension from entries such as `.x=python,y=go`; the first of an extension counts."""
    out: dict[str, str] = {}
    for key, sign, value in (entry.partition("=") for entry in text.split(",")):
        if sign and key.strip():
            out.setdefault(key.strip().lstrip(".").lower(), value.strip().lower())
    return out


def _git(root: str, *args: str, needed: bool = False) -> str:
    """What git prints; where it fails, nothing, or ValueError with its words if the answer is needed."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    if done.returncode and needed:
        raise ValueError(f"git {args[0]}: {done.stderr.strip()}")
    return done.stdout if done.returncode == 0 else ""


def commits(spark: SparkSession, root: str, since: str = "1 year ago", most: int = 10_000) -> DataFrame:
    """commit_id and file_path of the history, tracked files alone; at most `most` commits."""
    rows, commit = [], ""
    for line in _git(root, "log", "--name-only", "--pretty=format:COMMIT:%H", f"--since={since}", f"--max-count={most}").splitlines():
        if line.startswith("COMMIT:"):
            commit = line[7:]
        elif line.strip():
            rows.append((commit, line.strip()))
    return spark.createDataFrame(rows, "commit_id string, file_path string").where(rules.is_tracked(F.col("file_path")))


def since_commit(root: str, since: str) -> str:
    """A commit of a name or an ISO date; the root commit where the date is older; ValueError if neither."""
    if found := _git(root, "rev-parse", "--verify", "--quiet", f"{since}^{{commit}}").strip():
        return found
    parts = since.split("-")
    if len(since) == 10 and len(parts) == 3 and all(p.isdigit() for p in parts) and 1 <= int(parts[1]) <= 12 and 1 <= int(parts[2]) <= 31:
        return _git(root, "rev-list", "-1", f"--before={since}", "HEAD").strip() or _git(root, "rev-list", "--max-parents=0", "HEAD").split("\n")[0]
    raise ValueError(f"neither a commit nor a date: {since}")


def changed_files(spark: SparkSession, root: str, base: str = "main", since: str | None = None) -> DataFrame:
    """file_path and place of what differs from the base or in the work tree, each once; ValueError where
    git does not know the base."""
    start = since_commit(root, since) if since else base
    found = _git(root, "diff", "--name-only", f"{start}...HEAD", needed=True).splitlines() + _git(root, "diff", "--name-only", "HEAD", needed=True).splitlines()
    return spark.createDataFrame([(p, i) for i, p in enumerate(dict.fromkeys(x for x in found if x))], "file_path string, place int")


OVERLAY = "version string, source string, documents array<struct<rel_path: string, language: string, symbols: array<struct<symbol: string, qualified_name: string, display_name: string, kind: string, start_line: int, end_line: int, properties_json: string>>, occurrences: array<struct<symbol: string, role: string, start_line: int, end_line: int>>>>"
KINDS = ["function", "method", "class", "interface", "trait", "enum", "module", "variable"]


def overlay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, symbols and occurrences of a JSON symbol overlay, with defaults filled in."""
    docs = spark.read.schema(OVERLAY).option("multiLine", "true").json(path).select(F.explode("documents").alias("d")).select("d.*").where("rel_path != ''")
    s = docs.select("rel_path", F.explode("symbols").alias("s")).select("rel_path", "s.*")
    kind = F.lower("kind")
    label = F.when(kind.isin(KINDS), F.initcap(kind)).when(kind == "struct", "Class").otherwise("Symbol")
    name = F.coalesce(F.nullif(F.col("display_name"), F.lit("")), F.element_at(F.split("symbol", r"[/.#:]+"), -1))
    symbols = s.select("rel_path", "symbol", F.coalesce(F.nullif(F.col("qualified_name"), F.lit("")), F.col("symbol")).alias("qualified_name"), name.alias("name"), label.alias("label"), F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", "start_line", F.lit(0)).alias("end_line"), F.coalesce("properties_json", F.lit("{}")).alias("properties"))
    occurrences = docs.select("rel_path", F.explode("occurrences").alias("o")).select("rel_path", "o.symbol", F.coalesce("o.role", F.lit("reference")).alias("role"), F.coalesce("o.start_line", F.lit(0)).alias("start_line"), F.coalesce("o.end_line", "o.start_line", F.lit(0)).alias("end_line")).distinct()
    return docs.select("rel_path", "language"), symbols, occurrences


RESOLUTIONS = "documents array<struct<rel_path: string, language: string, resolved_calls: array<struct<caller_qualified_name: string, callee_name: string, full_callee_name: string, resolved_qualified_name: string, strategy: string, confidence: double>>>>"


def resolutions(spark: SparkSession, path: str, languages: tuple[str, ...] = ("go",)) -> DataFrame:
    """file_path, caller, callee, target and confidence of a JSON side file of resolved calls."""
    docs = spark.read.schema(RESOLUTIONS).option("multiLine", "true").json(path).select(F.explode("documents").alias("d")).select("d.*").where(F.lower("language").isin(*languages))
    return docs.select(F.col("rel_path").alias("file_path"), F.explode("resolved_calls").alias("c")).select("file_path", F.col("c.caller_qualified_name").alias("caller"), F.coalesce(F.nullif(F.col("c.full_callee_name"), F.lit("")), F.col("c.callee_name")).alias("callee"), F.col("c.resolved_qualified_name").alias("target"), F.coalesce("c.confidence", F.lit(1.0)).alias("confidence"))
