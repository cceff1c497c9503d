"""Artifacts of a run: a manifest that grows over calls, stage outputs, errors, and reports; written where Spark can write."""

from __future__ import annotations

import hashlib
import html
import json
import platform
import subprocess
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lists of a manifest that grow over calls, what the first call keeps, and what a later one overrides only if it says something.
GROWING, FIRST = ("papers", "stages_attempted", "stages_completed"), ("timestamp_start",)
REFINED = ("schema_version", "prompt_version", "cascade_signature", "git_commit", "config", "models", "thresholds", "chunk_size")


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that Spark knows; it appears whole, by renaming."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(conf).exists(target):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def config_digest(config: dict) -> str:
    """SHA-256 of a configuration as canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def git_commit(folder: str = ".") -> str | None:
    """The commit of a working folder; None if there is none to be had."""
    try:
        done = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=False)
    except OSError:
        return None
    return done.stdout.strip() or None


def merged(prior: dict, current: dict) -> dict:
    """A run's manifest after another call: rosters grow in order, the start stays, what the call refines is its own, extras merge;
    the status is running again, without end or error."""
    out = {**prior, **current, "status": "running", "timestamp_end": None, "error": None}
    for k in GROWING:
        out[k] = list(dict.fromkeys([*prior.get(k, []), *current.get(k, [])]))
    for k in FIRST:
        out[k] = prior.get(k) or current.get(k)
    for k in REFINED:
        say = current.get(k)
        out[k] = say if say or (k == "chunk_size" and say is not None) else prior.get(k)
    out["extra"] = {**prior.get("extra", {}), **current.get("extra", {})}
    return out


class RunArtifacts:
    """The folder of a run: manifest.json, a folder for each stage (and paper), and logs of errors.

    Where the folder has a manifest already, as when papers share a run, the two are merged. Outputs that are not required
    never fail the run: their errors are logged.
    """

    def __init__(self, spark: SparkSession, root: str, run_id: str, **fields: object):
        self.spark, self.folder = spark, f"{root}/{run_id}"
        new = {"run_id": run_id, "status": "running", "timestamp_start": _now(), "papers": [], "stages_attempted": [], "stages_completed": [], "extra": {}, **fields}
        before = read_text(spark, f"{self.folder}/manifest.json")
        try:
            self.manifest = merged(json.loads(before), new) if before else new
        except ValueError:
            self.manifest = new
        self._save()

    def _save(self) -> None:
        write_text(self.spark, f"{self.folder}/manifest.json", json.dumps(self.manifest, indent=1, sort_keys=True, ensure_ascii=False))

    def _add(self, key: str, value: str) -> None:
        if value and value not in self.manifest[key]:
            self.manifest[key].append(value)
            self._save()

    def add_paper(self, pmcid: str) -> None:
        self._add("papers", pmcid)

    def attempted(self, stage: str) -> None:
        self._add("stages_attempted", stage)

    def completed(self, stage: str) -> None:
        self.attempted(stage)
        self._add("stages_completed", stage)

    def finish(self, status: str, error: str | None = None) -> None:
        self.manifest |= {"status": status, "timestamp_end": _now()} | ({"error": error} if error else {})
        self._save()

    def path(self, stage: str, name: str, pmcid: str | None = None) -> str:
        return "/".join([self.folder, stage, *([pmcid] if pmcid else []), name])

    def write(self, stage: str, name: str, rows: DataFrame, pmcid: str | None = None, required: bool = False) -> bool:
        """Rows of a stage as JSON lines; whether that went well. A required output raises."""
        try:
            rows.write.mode("overwrite").json(self.path(stage, name, pmcid))
        except Exception as e:
            self.error(stage, str(e), pmcid)
            if required:
                raise
            return False
        return True

    def error(self, stage: str, message: str, pmcid: str | None = None) -> None:
        write_text(self.spark, f"{self.folder}/logs/stage_errors/{uuid.uuid4().hex}.json", json.dumps({"ts": _now(), "stage": stage, "pmcid": pmcid, "error": message}, ensure_ascii=False))


def batch_manifest(spark: SparkSession, path: str, run_id: str, config: dict, totals: DataFrame, documents: DataFrame, asked: dict, most: int = 100_000) -> dict:
    """A batch's manifest: what was asked, the configuration and its digest, the code, sums (section, key, value) and a row a
    document (pmcid, status, ...); an error beyond `most` documents, which are then better kept as a table."""
    rows = [r.asDict() for r in documents.orderBy("pmcid").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a manifest lists at most {most} documents")
    summary: dict[str, dict] = {}
    for r in totals.orderBy("section", "key").collect():  # one row a counter
        summary.setdefault(r["section"], {})[r["key"]] = r["value"]
    out = {"run_id": run_id, "finished_at": _now(), "git": git_commit(), "python": platform.python_version(), "input": asked, "config_digest": config_digest(config), "config": config, "summary": summary, "documents": rows}
    write_text(spark, path, json.dumps(out, indent=1, sort_keys=True, ensure_ascii=False, default=str))
    return out


def persisted(rows: DataFrame, path: str, run: str, stage: str, key: list[str]) -> DataFrame:
    """Replace a stage's rows of one run and return its id map (the key's columns, id): ids come from the key, so they stay the same
    when a run is repeated, and need no counter."""
    identity = F.concat_ws("\x1f", F.lit(run), F.lit(stage), *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in key))
    with_id = rows.withColumn("id", F.substring(F.sha2(identity, 256), 1, 16)).withColumn("run", F.lit(run)).withColumn("stage", F.lit(stage))
    with_id.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "stage").parquet(path)
    return rows.sparkSession.read.schema(with_id.schema).parquet(path).where((F.col("run") == run) & (F.col("stage") == stage)).select(*key, "id").distinct()


def html_report(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """Small results as one HTML page, a table each; a table shows `most` rows, and says so if there are more."""
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, rows in tables.items():
        head = rows.limit(most + 1).collect()
        cell = lambda v, tag="td": f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
        body = "".join(f"<tr>{''.join(map(cell, r))}</tr>" for r in head[:most])
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(cell(c, 'th') for c in rows.columns)}</tr>{body}</table>" + (f"<p>The first {most} rows.</p>" if len(head) > most else ""))
    return "\n".join(parts)


def text_histogram(counts: list[tuple[str, int]], width: int = 40) -> str:
    """Counts as bars of text, the largest `width` wide, with shares."""
    top, total = max([n for _, n in counts], default=0) or 1, sum(n for _, n in counts) or 1
    return "\n".join(f"{name}  {n:6d}  {100 * n / total:5.1f}%  {'#' * round(width * n / top)}" for name, n in counts)
